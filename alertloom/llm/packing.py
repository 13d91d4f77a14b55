"""Packing of tokenized documents into sequences: dominance reduction, then best fit, on the counts of piece lengths."""

from __future__ import annotations

import base64
import math
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from alertloom.llm.common import documents, in_batches, stage

CAPACITY = 1024
END = 2
#: The special token of the 50k vocabulary, as its tokenizer file names it.
SPECIAL = {"<|endoftext|>": 50256}


@lru_cache(maxsize=2)
def encoder(path: str, special: tuple[tuple[str, int], ...] = ()):
    """The byte-level vocabulary in `path` (a rank file) and the special tokens (string, id); other tokens' strings are ordinary text."""
    import public_tokenizers
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    return tiktoken.Encoding("packing", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=dict(special))


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def cuts(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens; only the first piece may be shorter than the capacity."""
    first = n % capacity
    return ([(0, first)] if first else []) + [(k, capacity) for k in range(first, n, capacity)]


def pieces(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None, special: dict[str, int] | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: the token ids of each text and an end id, cut into pieces."""
    special = special or {}

    def batch(rows: pa.RecordBatch) -> pa.RecordBatch:
        encode = encoder(path or vocabulary(), tuple(special.items())).encode
        at, out = [], []
        for i, text in enumerate(rows.column("text").to_pylist()):
            ids = np.array([*encode(text, allowed_special=set(special), disallowed_special=()), END], "<u4")
            for k, (start, length) in enumerate(cuts(len(ids), capacity)):
                at.append(i)
                out.append((k, start, length, zlib.crc32(ids[start : start + length].tobytes())))
        columns = list(zip(*out)) or [[]] * 4
        kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64())
        return pa.RecordBatch.from_arrays(
            [rows.column("doc_id").take(pa.array(at, pa.int64())), *(pa.array(c, k) for c, k in zip(columns, kinds))],
            ["doc_id", "piece", "start", "length", "ids_crc32"],
        )

    docs = documents(docs)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return in_batches(docs, batch, f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint")


def reduce_by_dominance(left: dict[int, int], capacity: int) -> list[tuple[int, list[int]]]:
    """Fix sets of lengths that dominate every other set with the same longest member; take them out of `left`
    (length -> count) and return (how often, lengths).

    For the longest length s, in falling order: (1) nothing fits beside it: it stays alone; (2) its exact complement
    is there: a full pair dominates whatever else s could go with; (3) only one more piece can ever be added: s goes with the
    longest that fits; (4) no two pieces that fit beside s are longer together than the longest single one that fits, and
    no three fit: that one can take their place, so the pair dominates."""
    fixed = []
    for s in sorted(left, reverse=True):
        while left.get(s):
            here = sorted(x for x, n in left.items() if n > (x == s))
            room = capacity - s
            fitting = [x for x in here if x <= room]
            if not fitting:
                sets, times = [s], left[s]
            else:
                best = fitting[-1]
                two = fitting[0] + (fitting[0] if left[fitting[0]] - (fitting[0] == s) > 1 else fitting[1] if len(fitting) > 1 else capacity)
                if best != room and two <= room and not _pair_dominates(fitting, left, s, room, best):
                    break
                sets, times = [s, best], left[s] // 2 if best == s else min(left[s], left[best])
            fixed.append((times, sets))
            for x in sets:
                left[x] -= times
    for x in [x for x, n in left.items() if not n]:
        del left[x]
    return fixed


def _pair_dominates(fitting: list[int], left: dict[int, int], s: int, room: int, best: int) -> bool:
    smallest = [x for x in fitting[:3] for _ in range(min(3, left[x] - (x == s)))][:3]
    if len(smallest) == 3 and sum(smallest) <= room:
        return False
    i, j, most = 0, len(fitting) - 1, 0
    while i <= j:
        if fitting[i] + fitting[j] > room:
            j -= 1
        else:
            if i < j or left[fitting[i]] - (fitting[i] == s) > 1:
                most = max(most, fitting[i] + fitting[j])
            i += 1
    return most <= best


def best_fit(left: dict[int, int], capacity: int) -> list[tuple[int, list[int]]]:
    """Best fit, longest first, for all pieces of one length at once: open sequences are kept as (how often, lengths) by the
    room they have; a piece goes where least room is left after it."""
    rooms: list[list] = [[] for _ in range(capacity + 1)]
    for s in sorted(left, reverse=True):
        n = left[s]
        while n:
            room = next((r for r in range(s, capacity) if rooms[r]), None)
            if room is None:
                per = capacity // s
                whole, rest = divmod(n, per)
                if whole:
                    rooms[capacity - per * s].append((whole, [s] * per))
                if rest:
                    rooms[capacity - rest * s].append((1, [s] * rest))
                break
            times, lengths = rooms[room].pop()
            per = room // s
            if n >= per * times:
                rooms[room - per * s].append((times, lengths + [s] * per))
                n -= per * times
            elif n >= per:
                whole = n // per
                rooms[room - per * s].append((whole, lengths + [s] * per))
                rooms[room].append((times - whole, lengths))
                n -= whole * per
            else:
                rooms[room - n * s].append((1, lengths + [s] * n))
                if times > 1:
                    rooms[room].append((times - 1, lengths))
                n = 0
    return [x for group in rooms for x in group]


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, list[int]]]:
    left = {s: n for s, n in counts.items() if n}
    return reduce_by_dominance(left, capacity) + best_fit(left, capacity)


def pack(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None, special: dict[str, int] | None = None) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Strings in `special` (op6 and the pipeline give SPECIAL) become the id they have there; without it they are ordinary text.

    A null or empty text is its end id alone. Texts of over `capacity` tokens are cut; only the first piece may be
    shorter. Rows that repeat a doc_id, or have none, are packed like any other. An empty table gives no rows.

    The plan is made from the count of each length (at most `capacity` numbers, whatever the size of the table): sets that
    dominate are fixed, best fit takes the rest. Pieces then find their place by their rank among those of their
    length; ranks are counted within parts, a number that grows with the root of the table, so that neither a part nor the list of parts
    is large. The plan's slots are as few
    as lengths and rooms allow and independent of the number of pieces, so they are broadcast."""
    spark = docs.sparkSession
    rows = stage(pieces(docs, capacity, path, special), "pieces")
    total = rows.count()
    parts = max(1, math.isqrt(total) // 8)
    salt = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(parts)).cast("int")
    rows = stage(rows.withColumn("part", salt), "parted") if parts > 1 else rows.withColumn("part", F.lit(0))
    sizes = rows.groupBy("length", "part").count()
    counted = {r["length"]: r["sum(count)"] for r in sizes.groupBy("length").sum("count").collect()}
    slots, first = [], 0
    used = dict.fromkeys(counted, 0)
    for times, lengths in plan(counted, capacity):
        offset = 0
        for s in lengths:
            slots.append((s, used[s], used[s] + times, first - used[s], offset))
            used[s] += times
            offset += s
        first += times
    before = F.sum("count").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select("length", "part", F.coalesce(before, F.lit(0)).alias("before"))
    order = Window.partitionBy("length", "part").orderBy("doc_id", "piece", "start", "ids_crc32")
    ranked = rows.withColumn("at", F.row_number().over(order) - 1).join(starts, ["length", "part"]).withColumn("rank", F.col("at") + F.col("before"))
    places = spark.createDataFrame(slots, "length bigint, low bigint, high bigint, shift bigint, offset bigint")
    inside = (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high"))
    placed = ranked.join(F.broadcast(places.withColumnRenamed("length", "size")), (F.col("length") == F.col("size")) & inside)
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("rank") + F.col("shift")).alias("sequence_id"), "offset")
