"""Substring dedup on bytes: suffixes at anchors, sorted deep and shallow, tell which long strings start more than once."""

from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alertloom.llm.common import attach, in_batches, ship_package, stage
from alertloom.llm.windows import OTHER, TEXT, Rolling, candidates, keyed, merged, texts_with

WIDTH = 400
GRAM = 100
SHALLOW = 64
STEP = 8
GROUP_ROWS = 4096
RANGES = "array<struct<lo:int,hi:int>>"
BYTE = np.array([int.from_bytes(hashlib.blake2b(bytes([b]), digest_size=8).digest(), "little") for b in range(256)], np.uint64)


def symbols(text: str) -> np.ndarray:
    return BYTE[np.frombuffer(text.encode("utf-8", "replace"), np.uint8)]


def common_prefix(a: bytes, b: bytes, start: int = 0) -> int:
    """Length of the longest common prefix of a and b, which agree before `start`."""
    low, high = start, min(len(a), len(b))
    if a[low:high] == b[low:high]:
        return high
    while high - low > 1:
        middle = (low + high) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle
    return low


def deep_shallow(strings: list[bytes], shallow: int = SHALLOW) -> list[int]:
    """Indices in the order of the strings. Multikey quicksort on STEP bytes at a time down to the shallow depth; groups that
    still agree there are ordered by a blind trie."""
    order: list[int] = []
    stack = [(list(range(len(strings))), 0)]
    while stack:
        group, depth = stack.pop()
        if len(group) < 2:
            order += group
        elif depth >= shallow:
            order += blind_trie(strings, group, depth)
        else:
            keys = {i: strings[i][depth : depth + STEP] for i in group}
            pivot = sorted((keys[group[0]], keys[group[len(group) // 2]], keys[group[-1]]))[1]
            less, same, more = [], [], []
            for i in group:
                (same if keys[i] == pivot else less if keys[i] < pivot else more).append(i)
            stack += [(more, depth), (same, depth + STEP if len(pivot) == STEP else shallow), (less, depth)]
    return order


def blind_trie(strings: list[bytes], group: list[int], depth: int) -> list[int]:
    """Order of strings that agree before `depth`. Inner nodes keep only the depth at which strings part and the byte there
    (-1: the string ends); a string is led down blindly, compared once with a leaf, then put in at the depth found."""
    at = lambda i, d: strings[i][d] if d < len(strings[i]) else -1
    root: list = [None, [group[0]]]
    for i in group[1:]:
        node = root
        while node[0] is not None:
            node = node[1].get(at(i, node[0])) or next(iter(node[1].values()))
        leaf = node[1][0]
        part = common_prefix(strings[leaf], strings[i], depth)
        if part == len(strings[leaf]) == len(strings[i]):
            node[1].append(i)
            continue
        node = root
        while node[0] is not None and node[0] < part:
            node = node[1][at(i, node[0])]
        if node[0] == part:
            node[1][at(i, part)] = [None, [i]]
        else:
            node[:] = [part, {at(leaf, part): node[:], at(i, part): [None, [i]]}]
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        if node[0] is None:
            order += node[1]
        else:
            stack += [node[1][k] for k in sorted(node[1], reverse=True)]
    return order


def repeated_offsets(texts: list[bytes], offsets: list[int], width: int) -> list[list[tuple[int, int]]]:
    """texts all have the same gram at their offset. For each, the ranges of d for which its `width` bytes from d before the
    gram on are those of another text, too.

    Suffixes from the gram on, and the reversed bytes before it, are sorted once each. As d grows, fewer bytes after the gram and
    more before it must agree; the classes of equal bytes change only at the lengths of neighbours' common prefixes, so one count per stretch
    between those is enough."""
    n = len(texts)
    both = [x[o:] for x, o in zip(texts, offsets)], [x[:o][::-1] for x, o in zip(texts, offsets)]
    if n == 2:
        first, last = width - common_prefix(*both[0]), common_prefix(*both[1])
        return [[(max(0, first), min(last, width))] if first <= last else []] * 2
    sides = []
    for strings in both:
        order = deep_shallow(strings)
        shared = np.array([common_prefix(strings[a], strings[b]) for a, b in zip(order, order[1:])], np.int64)
        sides.append((np.array(order), shared))
    (right, ahead), (left, behind) = sides
    turns = np.unique(np.concatenate([[0], width - ahead, behind + 1]))
    turns = turns[(turns >= 0) & (turns <= width)].tolist()
    out: list[list[tuple[int, int]]] = [[] for _ in range(n)]
    a, b = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for first, stop in zip(turns, [*turns[1:], width + 1]):
        a[right[1:]] = np.cumsum(ahead < width - first)
        b[left[1:]] = np.cumsum(behind < first)
        codes = (a * n + b).tolist()
        times = Counter(codes)
        if len(times) < n:
            for i, code in enumerate(codes):
                if times[code] > 1:
                    out[i].append((first, stop - 1))
    return out


def remove_repeats(docs: DataFrame, width: int = WIDTH, gram: int = GRAM, group_rows: int = GROUP_ROWS) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans (half-open byte ranges that were removed).

    A string of `width` bytes that starts anywhere else too, in the same text or another, goes with its first occurrence;
    strings are judged on the input. Null and empty texts have no bytes; shorter texts than a string stay whole. Rows
    with the same text get the same answer, with or without a doc_id; an empty table gives no rows.

    Suffixes start at anchors, the least grams of their neighbourhood, so that equal strings have the same anchor inside. Where all
    copies of an anchor's surroundings are alike, hashes decide; the others are sorted, one representative of each kind, group by
    group. A group of over `group_rows` kinds is not sorted in one task: the hashes of all its strings are counted by an
    aggregate instead, which gives the same answer. The texts themselves are shuffled once."""
    spark = docs.sparkSession
    ship_package(spark)
    found = candidates(docs, symbols, width, gram)
    whole = found.where("state <> 'open'").groupBy(*TEXT).agg(F.collect_set(F.struct("lo", "hi")).alias("ranges"))
    lines = found.where("state <> 'same'").select(*TEXT, F.struct("lo", "hi", "m", "gram", (F.col("state") == "open").alias("own")).alias("x"))
    lines = lines.groupBy(*TEXT).agg(F.collect_set("x").alias("look"))
    rows = texts_with(docs, whole.join(lines, TEXT, "full"))
    names = ["n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "text", "ranges", "parts"]
    pair = pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32())]))
    part = pa.list_(pa.struct([("gram", pa.int64()), ("bytes", pa.binary()), ("at", pa.int32()), ("m", pa.int32()), ("own", pa.bool_())]))
    shape = pa.schema([
        ("t", pa.int64()), ("size", pa.int32()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()),
        ("kept_sha256", pa.string()), ("spans", pair), ("text", pa.string()), ("ranges", pair), ("parts", part),
    ])

    def first_pass(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for t, size, text, ranges, look in zip(*(batch.column(c).to_pylist() for c in ("t", "size", "text", "ranges", "look"))):
            if look:
                raw = text.encode("utf-8", "replace")
                cut = [{"gram": x["gram"], "bytes": raw[x["lo"] : x["hi"] + width], "at": x["m"] - x["lo"], "m": x["m"], "own": x["own"]} for x in look]
                made = (None, None, None, None, None, text, ranges or [], cut)
            else:
                made = (*finish(text, ranges or [], width), None, None, None)
            out.append({"t": t, "size": size} | dict(zip(names, made)))
        return pa.RecordBatch.from_pylist(out, schema=shape)

    done = f"t bigint, size int, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, spans {RANGES}"
    parts = "array<struct<gram:bigint,bytes:binary,at:int,m:int,own:boolean>>"
    looked = stage(in_batches(rows, first_pass, f"{done}, text string, ranges {RANGES}, parts {parts}"), "looked")
    pending = looked.where("parts is not null")
    each = pending.select(*TEXT, F.explode("parts").alias("x")).select(*TEXT, "x.*")
    sizes = each.groupBy("gram").agg(F.count("*").alias("n")).where("n > 1")
    grouped = attach(each, stage(sizes, "groups"), ["gram"], "n").where("n is not null")

    whole_groups = grouped.where(F.col("n") <= group_rows).repartition("gram").sortWithinPartitions("gram")
    hits = whole_groups.select("gram", *TEXT, "bytes", "at", "m", "own").mapInArrow(_sort_groups(width), "t bigint, size int, lo int, hi int")
    strings = in_batches(grouped.where(F.col("n") > group_rows).select(*TEXT, "bytes", "at", "m", "own"), _hashes(width), "t bigint, size int, p int, own boolean, h1 bigint, h2 bigint")
    strings = stage(strings, "strings")
    twice = stage(strings.groupBy("h1", "h2").agg(F.count("*").alias("n")).where("n > 1"), "twice")
    many = attach(strings.where("own"), twice, ["h1", "h2"], "n").where("n is not null").selectExpr("t", "size", "p lo", "p hi")
    starts = hits.unionByName(many).groupBy(*TEXT).agg(F.collect_set(F.struct("lo", "hi")).alias("starts"))

    def second_pass(batch: pa.RecordBatch) -> pa.RecordBatch:
        columns = zip(*(batch.column(c).to_pylist() for c in ("t", "size", "text", "ranges", "starts")))
        made = [{"t": t, "size": s} | dict(zip(names, finish(x, r + (p or []), width))) for t, s, x, r, p in columns]
        return pa.RecordBatch.from_pylist(made, schema=pa.schema(list(shape)[:7]))

    late = in_batches(pending.select(*TEXT, "text", "ranges").join(starts, TEXT, "left"), second_pass, done)
    answers = looked.where("parts is null").drop("text", "ranges", "parts").unionByName(late)
    ids = stage(keyed(docs).select("doc_id", *TEXT), "ids")
    answers = stage(answers, "answers").join(ids.groupBy(*TEXT).agg(F.count("*").alias("n")), TEXT)
    return attach(ids, answers, TEXT, "n").select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans")


def _sort_groups(width: int):
    """Ranges of starts that occur again, from rows in the order of their gram. A group may go on in the next batch; it has at most
    GROUP_ROWS rows."""

    def ranges(group: list[tuple]) -> list[tuple]:
        found = repeated_offsets([r[3] for r in group], [r[4] for r in group], width)
        return [
            (t, size, m - min(high, at), m - max(low, at + width - len(raw)))
            for (_, t, size, raw, at, m, own), own_ranges in zip(group, found) if own
            for low, high in own_ranges if max(low, at + width - len(raw)) <= min(high, at)
        ]

    def run(batches):
        group: list[tuple] = []
        for batch in batches:
            hits = []
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if group and group[0][0] != row[0]:
                    hits += ranges(group)
                    group = []
                group.append(row)
            yield _as_batch(hits)
        if group:
            yield _as_batch(ranges(group))

    return run


def _as_batch(hits: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*hits)) or [[]] * 4
    kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["t", "size", "lo", "hi"])


def _hashes(width: int):
    def batch(rows: pa.RecordBatch):
        for t, size, raw, at, m, own in zip(*(rows.column(c).to_pylist() for c in ("t", "size", "bytes", "at", "m", "own"))):
            values = BYTE[np.frombuffer(raw, np.uint8)]
            p = np.arange(len(raw) - width + 1)
            h1, h2 = ((r := Rolling(len(values), base)).span(r.prefix(values), p, p + width).view(np.int64) for base in (OTHER, OTHER ^ 0xFF00FF00))
            n = len(p)
            yield pa.RecordBatch.from_arrays(
                [pa.array([t] * n, pa.int64()), pa.array([size] * n, pa.int32()), pa.array(p + m - at, pa.int32()), pa.array([own] * n, pa.bool_()), pa.array(h1), pa.array(h2)],
                ["t", "size", "p", "own", "h1", "h2"],
            )

    return batch


def finish(text: str, ranges: list[dict], width: int) -> tuple:
    raw = text.encode("utf-8", "replace")
    gone = merged([(r["lo"], r["hi"] + width) for r in ranges])
    kept, at = [], 0
    for low, high in gone:
        kept.append(raw[at:low])
        at = high
    kept = b"".join([*kept, raw[at:]])
    return len(raw), len(raw) - len(kept), len(gone), hashlib.sha256(kept).hexdigest(), [{"lo": a, "hi": b} for a, b in gone]
