"""Windows of a fixed number of symbols: where the same window starts more than once in a table of texts.

Neighbouring windows that share their least gram (their minimizer) form one super-window, a grouping that depends on the
windows' own content only. So equal windows always lie in super-windows of the same gram, and a table of super-windows,
some fifteen to a hundred and fifty times shorter than one of windows, tells which can repeat at all."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alertloom.llm.common import HOT_KEYS, documents, in_batches, stage, stage_result

CHUNK = 1 << 18
BASE, OTHER = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
TEXT = ["t", "size"]
SUPER = "t bigint, size int, m int, lo int, hi int, gram bigint, whole bigint"


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class Rolling:
    """Hashes of any stretch of a sequence of 64-bit symbols from sums of its prefixes."""

    def __init__(self, longest: int, base: int = BASE):
        self.up, self.down = powers(base, longest + 1), powers(pow(base, -1, 1 << 64), longest + 1)

    def prefix(self, values: np.ndarray) -> np.ndarray:
        return np.concatenate([np.zeros(1, np.uint64), np.cumsum(values * self.up[: len(values)], dtype=np.uint64)])

    def span(self, prefix: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        x = (prefix[high] - prefix[low]) * self.down[low]
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(32))


def super_windows(values: np.ndarray, width: int, gram: int, rolling: Rolling) -> list[np.ndarray]:
    """Columns m, lo, hi, gram, whole: windows starting at lo..hi have their least gram (the leftmost, on ties) at m; `whole` is a
    hash of all their symbols and of the place of m in them."""
    parts, span = [], width - gram + 1
    for first in range(0, len(values) - width + 1, CHUNK):
        part = values[first : first + CHUNK + width - 1]
        starts = len(part) - width + 1
        prefix = rolling.prefix(part)
        at = np.arange(len(part) - gram + 1)
        hashes = rolling.span(prefix, at, at + gram)
        low_bits = np.uint64((1 << 20) - 1)
        keys = (hashes & ~low_bits) | at.astype(np.uint64)
        padded = np.full(-(-len(keys) // span) * span, np.iinfo(np.uint64).max, np.uint64)
        padded[: len(keys)] = keys
        rows = padded.reshape(-1, span)
        before = np.minimum.accumulate(rows, axis=1).reshape(-1)
        after = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].reshape(-1)
        m = (np.minimum(after[:starts], before[span - 1 : span - 1 + starts]) & low_bits).astype(np.int64)
        lo = np.concatenate([[0], np.flatnonzero(np.diff(m)) + 1])
        hi = np.concatenate([lo[1:] - 1, [starts - 1]])
        m = m[lo]
        whole = rolling.span(prefix, lo, hi + width) + (m - lo).astype(np.uint64) * np.uint64(OTHER)
        parts.append((m + first, lo + first, hi + first, hashes[m], whole))
    return [np.concatenate(c) for c in zip(*parts)] if parts else [np.empty(0, np.int64)] * 3 + [np.empty(0, np.uint64)] * 2


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text and the two columns that name a text: a 64-bit hash and its length in bytes. Rows with the same text, whatever their
    ids, get the same answer."""
    return documents(docs).withColumns({"t": F.xxhash64("text"), "size": F.octet_length("text")})


def candidates(docs: DataFrame, symbols: Callable[[str], np.ndarray], width: int, gram: int) -> DataFrame:
    """The super-windows whose gram occurs again, the only table that stays staged: SUPER and `state`. 'same': the whole super-window occurs again,
    so all its windows do. 'lead': the same, and it stands for its copies where others have the gram too. 'open': its windows must be
    looked at one by one.

    Grams and whole super-windows are counted by aggregates that are combined before the shuffle; those with over 1/1000
    of the rows come back by broadcast."""
    return stage_result(docs.sparkSession, lambda: _judged(docs, symbols, width, gram), "candidates")


def _judged(docs: DataFrame, symbols: Callable[[str], np.ndarray], width: int, gram: int) -> DataFrame:
    tools = []

    def cut(rows: pa.RecordBatch) -> pa.RecordBatch:
        if not tools:
            tools.append(Rolling(CHUNK + width))
        found = [super_windows(symbols(x), width, gram, tools[0]) for x in rows.column("text").to_pylist()]
        counts = np.array([len(f[0]) for f in found])
        m, lo, hi, grams, whole = (np.concatenate(c) for c in zip(*found))
        keys = [pa.array(np.repeat(rows.column(c).to_numpy(zero_copy_only=False), counts)) for c in TEXT]
        columns = [*keys, *(pa.array(c, pa.int32()) for c in (m, lo, hi)), pa.array(grams.view(np.int64)), pa.array(whole.view(np.int64))]
        return pa.RecordBatch.from_arrays(columns, ["t", "size", "m", "lo", "hi", "gram", "whole"])

    supers = stage(in_batches(keyed(docs).select("t", "size", "text"), cut, SUPER), "supers")
    grams = supers.groupBy("gram").agg(F.count("*").alias("n"), F.min("whole").alias("a"), F.max("whole").alias("b")).where("n > 1")
    again = stage(_among(supers, stage(grams, "grams"), ["gram"], supers.count()), "again").withColumn("mixed", F.col("a") != F.col("b"))
    place = F.struct("t", "size", "m")
    mixed = again.where("mixed").drop("n", "a", "b", "mixed")
    wholes = stage(mixed.groupBy("gram", "whole").agg(F.count("*").alias("n"), F.min(place).alias("first")), "wholes")
    state = F.when(F.col("n") == 1, "open").when(place == F.col("first"), "lead").otherwise("same")
    told = _among(mixed, wholes, ["gram", "whole"], mixed.count()).select(*supers.columns, state.alias("state"))
    return again.where("not mixed").select(*supers.columns, F.lit("same").alias("state")).unionByName(told)


def _among(rows: DataFrame, counted: DataFrame, key: list[str], total: int) -> DataFrame:
    hot = F.col("n") * HOT_KEYS > F.lit(total)
    heads = F.broadcast(counted.where(hot))
    return rows.join(heads, key).unionByName(rows.join(heads, key, "left_anti").join(counted.where(~hot), key))


def texts_with(docs: DataFrame, per_text: DataFrame) -> DataFrame:
    """Each different text once, with the columns that per_text (one row per t and size) has for it."""
    texts = keyed(docs).groupBy(*TEXT).agg(F.first("text").alias("text"))
    return texts.join(per_text, TEXT, "left")


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The union of half-open ranges, in order; ranges that touch become one."""
    out: list[tuple[int, int]] = []
    for low, high in sorted(ranges):
        if out and low <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], high))
        else:
            out.append((low, high))
    return out
