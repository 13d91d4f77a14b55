"""Benchmark decontamination: SimHash of item-sized windows, a multi-index over Hamming blocks, exact shingle similarity."""

from __future__ import annotations

import re
from collections import Counter
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alertloom.llm.common import documents, in_batches

WIDTH = 5
SIMILARITY = 0.8
RADIUS = 20
BLOCKS = 7
BLOCK_BYTES = 32 << 20
CHUNK = 4096
WORD = re.compile(r"[^\W_]+")
ROLL = np.uint64(0x9E3779B97F4A7C15)
BLOOM_BITS = 22


def words(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def shingles(tokens: list[str], width: int) -> list[str]:
    return [" ".join(tokens[i : i + width]) for i in range(len(tokens) - width + 1)]


def similarity(a: Counter, b: Counter) -> float:
    """Weighted Jaccard: a shingle weighs as often as it occurs."""
    least = sum((a & b).values())
    return least / (sum(a.values()) + sum(b.values()) - least) if least else 0.0


def bits(parts: list[str]) -> np.ndarray:
    h = np.array([xxhash.xxh64_intdigest(p.encode("utf-8", "replace"), 7) for p in parts], "<u8")
    return np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def pack_bits(rows: np.ndarray) -> np.ndarray:
    return np.packbits(rows, axis=1, bitorder="little").view("<u8").reshape(-1)


class Items:
    """Benchmark items with their fingerprints, and for each block of bits the items by the block's value."""

    def __init__(self, rows: list[tuple]):
        self.ids, self.counts, self.lengths, self.widths, prints = [], [], [], [], []
        self.by_shingle: dict[int, dict[str, set[tuple[int, int]]]] = {}
        for item, text in rows:
            tokens = words(text)
            if not tokens:
                continue
            width = min(WIDTH, len(tokens))
            parts = shingles(tokens, width)
            self.ids.append(item)
            self.counts.append(Counter(parts))
            self.lengths.append(len(tokens))
            self.widths.append(width)
            prints.append(pack_bits(2 * bits(parts).sum(0, keepdims=True, dtype=np.int64) > len(parts))[0])
            for part in set(parts):
                self.by_shingle.setdefault(width, {}).setdefault(part, set()).add((len(tokens), width))
        self.prints = np.array(prints, np.uint64)
        edges = [round(64 * k / BLOCKS) for k in range(BLOCKS + 1)]
        self.blocks = []
        for low, high in zip(edges, edges[1:]):
            values = (self.prints >> np.uint64(low)) & np.uint64((1 << (high - low)) - 1)
            table: dict[int, list[int]] = {}
            for i, v in enumerate(values.tolist()):
                table.setdefault(v, []).append(i)
            near = [sum(1 << b for b in turn) for r in range(RADIUS // BLOCKS + 1) for turn in combinations(range(high - low), r)]
            self.blocks.append((low, high - low, table, near))
        self.sieve: dict[int, np.ndarray] = {}

    def sieves(self) -> dict[int, np.ndarray]:
        """Per shingle width a bit table over this process's hashes of the items' shingles."""
        if not self.sieve:
            for width, parts in self.by_shingle.items():
                seen = np.zeros(1 << BLOOM_BITS, bool)
                for part in parts:
                    seen[roll(part.split(" "), width) >> np.uint64(64 - BLOOM_BITS)] = True
                self.sieve[width] = seen
        return self.sieve

    def within(self, prints: np.ndarray, length: int, width: int) -> list[tuple[int, int, int]]:
        """(window, item, distance) for all items of this length within RADIUS bits: at least one of the BLOCKS
        blocks then differs in RADIUS // BLOCKS bits or fewer, so no item is missed."""
        out = []
        for k, value in enumerate(prints.tolist()):
            found = set()
            for low, size, table, near in self.blocks:
                own = (value >> low) & ((1 << size) - 1)
                for turn in near:
                    found.update(table.get(own ^ turn, ()))
            for i in found:
                if self.lengths[i] == length and (d := (value ^ int(self.prints[i])).bit_count()) <= RADIUS:
                    out.append((k, i, d))
        return out


def roll(tokens: list[str], width: int) -> np.ndarray:
    h = np.fromiter(map(hash, tokens), np.int64, len(tokens)).view(np.uint64)
    n = max(0, len(h) - width + 1)
    out = h[:n].copy()
    for k in range(1, width):
        out = out * ROLL + h[k : k + n]
    return out * ROLL


def leaks_of(text: str, items: Items) -> list[tuple]:
    """(item, start word, words, similarity, distance) of the best window for each item that leaks into the text.

    A window as similar as asked shares a shingle with its item, so only windows that hold a shingle of an item of their
    length are fingerprinted."""
    tokens = words(text)
    best: dict[int, tuple] = {}
    for width, seen in items.sieves().items():
        hits = np.flatnonzero(seen[roll(tokens, width) >> np.uint64(64 - BLOOM_BITS)])
        spans: dict[int, list[tuple[int, int]]] = {}
        for j in hits.tolist():
            for length, _ in items.by_shingle[width].get(" ".join(tokens[j : j + width]), ()):
                own = spans.setdefault(length, [])
                low, high = max(0, j - (length - width)), min(j, max(0, len(tokens) - length))
                if low <= high:
                    if own and low <= own[-1][1] + 1:
                        own[-1] = (own[-1][0], max(own[-1][1], high))
                    else:
                        own.append((low, high))
        for length, ranges in spans.items():
            size = min(length, len(tokens))
            for low, high in ranges:
                for start in range(low, high + 1, CHUNK):
                    stop = min(high + 1, start + CHUNK)
                    parts = shingles(tokens[start : stop - 1 + size], width)
                    per = size - width + 1
                    sums = np.cumsum(np.vstack([np.zeros((1, 64), np.int64), bits(parts)]), axis=0)
                    prints = pack_bits(2 * (sums[per:] - sums[:-per]) > per)
                    for k, i, d in items.within(prints, length, width):
                        if (s := similarity(Counter(parts[k : k + per]), items.counts[i])) >= SIMILARITY:
                            best[i] = max(best.get(i, (0.0, 0)), (s, -(start + k), size, d))
    return [(items.ids[i], -at, size, s, d) for i, (s, at, size, d) in best.items()]


def find_leaks(docs: DataFrame, benchmark: DataFrame, item_id: str = "item_id") -> DataFrame:
    """One row per document and benchmark item found in it: doc_id, item_id, start, n_words, similarity, distance.

    Words are runs of letters and digits, lower-cased. Windows have as many words as the item (the whole text if it is
    shorter); shingles have five words (fewer if the item has fewer); a leak has a weighted shingle similarity of 0.8 or
    more; of several windows the most similar, then the first is returned. Empty texts and items have no leaks; rows without a doc_id are
    searched too; repeated rows give repeated rows; no benchmark or no documents: no rows.

    Items are broadcast in portions of at most BLOCK_BYTES of text; a larger benchmark is searched portion by portion."""
    docs, spark = documents(docs), docs.sparkSession
    tests = benchmark.select(item_id, F.coalesce("text", F.lit("")).alias("text"))
    size = tests.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    portions = max(1, -(-2 * size // BLOCK_BYTES)) if size > BLOCK_BYTES else 1
    kind = docs.schema["doc_id"].dataType.simpleString()
    out = None
    for portion in range(portions):
        own = tests if portions == 1 else tests.where(F.pmod(F.xxhash64("text"), F.lit(portions)) == portion)
        shared = spark.sparkContext.broadcast([tuple(r) for r in own.distinct().collect()])
        found = in_batches(docs, _search(shared), f"doc_id {kind}, item_id bigint, start bigint, n_words bigint, similarity double, distance int")
        out = found if out is None else out.unionByName(found)
    return out


def _search(shared):
    built = []

    def batch(rows: pa.RecordBatch) -> pa.RecordBatch:
        if not built:
            built.append(Items(shared.value))
        at, out = [], []
        for i, text in enumerate(rows.column("text").to_pylist()):
            for leak in leaks_of(text, built[0]):
                at.append(i)
                out.append(leak)
        columns = list(zip(*out)) or [[]] * 5
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int32())
        return pa.RecordBatch.from_arrays(
            [rows.column("doc_id").take(pa.array(at, pa.int64())), *(pa.array(c, k) for c, k in zip(columns, kinds))],
            ["doc_id", "item_id", "start", "n_words", "similarity", "distance"],
        )

    return batch
