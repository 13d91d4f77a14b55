"""SimHash fingerprints, and near-duplicate links by anchor-point covering."""

from __future__ import annotations

from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from alertloom.llm.common import attach, components, documents, forget, in_batches, stage, stage_result, staged

SEED = 42
HOMES_PER_ANCHOR = 512
BLOCK_ROWS = 1 << 15
SLICE = 1 << 16
LANES = np.array([sum(((b >> i) & 1) << (8 * i) for i in range(8)) for b in range(256)], np.uint64)


def bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many of the 64-bit hashes have each bit set. Eight bits are counted at once, in the bytes of a word, over runs
    of up to 255 hashes."""
    if not len(hashes):
        return np.zeros(64, np.int64)
    words = LANES[hashes.astype("<u8").view(np.uint8).reshape(-1, 8)]
    runs = np.add.reduceat(words, np.arange(0, len(words), 255), axis=0)
    return np.ascontiguousarray(runs.astype("<u8")).view(np.uint8).reshape(len(runs), 64).sum(0, dtype=np.int64)


def fingerprint(text: str, width: int) -> int:
    """A bit is 1 if it is set in over half of the XXH64 hashes of the shingles; no words: zero. Long texts are taken in slices."""
    words = text.encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    shingles = iter([b" ".join(words)]) if len(words) < width else map(b" ".join, zip(*(islice(words, k, None) for k in range(width))))
    n, counts = 0, np.zeros(64, np.int64)
    while part := [xxhash.xxh64_intdigest(s, SEED) for s in islice(shingles, SLICE)]:
        n += len(part)
        counts += bit_counts(np.array(part, np.uint64))
    return int((np.left_shift(np.uint64(1), np.arange(64, dtype=np.uint64)) * (2 * counts > n)).sum(dtype=np.uint64).view(np.int64))


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """doc_id and fp, the fingerprint as a signed 64-bit integer."""

    def batch(rows: pa.RecordBatch) -> pa.RecordBatch:
        fps = [fingerprint(t, width) for t in rows.column("text").to_pylist()]
        return pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(fps, pa.int64())], ["doc_id", "fp"])

    docs = documents(docs)
    return in_batches(docs, batch, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, fp bigint")


def blocks_for(n: int) -> int:
    """Number of blocks of the code: about HOMES_PER_ANCHOR of n fingerprints have the same anchor, at every n."""
    return min(21, max(4, (max(1, n) // HOMES_PER_ANCHOR).bit_length()))


def anchors(fps: np.ndarray, blocks: int, radius: int) -> list[np.ndarray]:
    """For each fingerprint the anchors it is sent to, as one array of numbers per fingerprint; its own anchor comes first.

    The code is a direct sum of repetition codes: the 64 bits are cut into blocks, a code word has equal bits in each
    block. Its covering radius is the sum of half the block lengths; a fingerprint's own anchor is the majority of each
    block. Another fingerprint within `radius` bits has, block by block, either the same majority or one whose bits had
    to be turned; so it is enough to go to those anchors within covering radius plus `radius` whose blocks can be
    turned with `radius` bits in all."""
    edges = [round(64 * k / blocks) for k in range(blocks + 1)]
    home = np.zeros(len(fps), np.int64)
    cost = np.empty((len(fps), blocks), np.int64)
    for k, (low, high) in enumerate(zip(edges, edges[1:])):
        size = high - low
        ones = np.bitwise_count((fps >> np.uint64(low)) & np.uint64((1 << size) - 1)).astype(np.int64)
        major = 2 * ones > size
        home |= major.astype(np.int64) << k
        cost[:, k] = np.where(major, ones - size // 2, size // 2 + 1 - ones)
    out = []
    for own, prices in zip(home.tolist(), cost.tolist()):
        near = [(own, radius)]
        for k, price in enumerate(prices):
            if price <= radius:
                near += [(a ^ (1 << k), left - price) for a, left in near if left >= price]
        out.append(np.array([a for a, _ in near], np.int64))
    return out


def forest(homes: np.ndarray, others: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what pairs of a home and another fingerprint within `radius` bits connect: at most one
    less than there are different fingerprints. Pairs are compared in small blocks and never kept."""
    values = np.unique(np.concatenate([homes, others]))
    homes, others = np.unique(homes), np.unique(others)
    at_home, at_other = np.searchsorted(values, homes), np.searchsorted(values, others)
    label = np.arange(len(values))
    step = max(1, (1 << 21) // max(1, len(homes)))
    for start in range(0, len(others), step):
        part = others[start : start + step]
        i, j = np.nonzero(np.bitwise_count(part[:, None] ^ homes[None, :]) <= radius)
        a, b = at_other[start + i], at_home[j]
        while True:
            low = np.minimum(label[a], label[b])
            if (label[a] == label[b]).all():
                break
            np.minimum.at(label, label[a], low)
            np.minimum.at(label, label[b], low)
            while (label != label[label]).any():
                label = label[label]
    moved = np.flatnonzero(label != np.arange(len(values)))
    return values[moved], values[label[moved]]


def links(fps: DataFrame, radius: int = 2) -> DataFrame:
    """(a, b): links between different values of the column fp; any two within `radius` bits are connected through them.

    Every fingerprint is sent to its anchors and compared, at each, with those whose own anchor it is. An anchor with
    many fingerprints is cut into a grid of blocks of at most BLOCK_ROWS by BLOCK_ROWS rows, which meet every pair once."""
    spark = fps.sparkSession
    fps = stage(fps.select("fp").distinct(), "fps")
    blocks = blocks_for(fps.count())

    def send(rows: pa.RecordBatch) -> pa.RecordBatch:
        own = rows.column("fp").to_numpy(zero_copy_only=False)
        near = anchors(own.view(np.uint64), blocks, radius)
        sizes = [len(x) for x in near]
        home = np.zeros(sum(sizes), bool)
        home[np.cumsum([0, *sizes[:-1]])] = True
        return pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate(near)), pa.array(np.repeat(own, sizes)), pa.array(home)], ["anchor", "fp", "home"]
        )

    sent = stage(in_batches(fps, send, "anchor bigint, fp bigint, home boolean"), "anchors")
    grid = sent.groupBy("anchor").agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("side"), F.count("*").alias("n"))
    rows = attach(sent, grid, ["anchor"], "n")
    part = F.pmod(F.xxhash64("fp"), F.col("side")).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.col("side") - 1))
    as_home = rows.where("home").select("anchor", "fp", F.lit(True).alias("home"), part.alias("i"), every.alias("j"))
    as_other = rows.select("anchor", "fp", F.lit(False).alias("home"), every.alias("i"), part.alias("j"))

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        values, home = group["fp"].to_numpy().view(np.uint64), group["home"].to_numpy()
        a, b = forest(values[home], values[~home], radius)
        return pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})

    return as_home.unionByName(as_other).groupBy("anchor", "i", "j").applyInPandas(compare, "a bigint, b bigint").distinct()


def near_duplicates(docs: DataFrame, width: int = 3, radius: int = 2) -> DataFrame:
    """One row per document: doc_id, fp, component_id.

    Fingerprints link at `radius` or fewer different bits; component_id is the smallest doc_id that links reach. A-Z are
    lower-cased, words are split at ASCII white space; null and empty texts have fingerprint zero and link like any
    other. A row without a doc_id gets a component_id too (null only if no row of the component has an id). Repeated rows
    give repeated rows. An empty table gives no rows."""
    rows = stage(fingerprints(docs, width), "fingerprints")
    classes = rows.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n"))
    classes = stage(classes, "classes")
    roots = components(links(classes, radius)).withColumnRenamed("node", "fp")
    placed = classes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = placed.groupBy("root").agg(F.min("first_id").alias("component_id"), F.count("*").alias("size"))
    named = attach(placed, least, ["root"], "size").select("fp", "n", "component_id")
    return attach(rows, stage(named, "named"), ["fp"], "n").select("doc_id", "fp", "component_id")


TABLES = 12
SAMPLED = 4
PAIR_BLOCK = 512
PORTION = 1 << 13
SPREAD = np.array([[0x9E3779B97F4A7C15 * (2 * k + 1) % (1 << 64)] for k in range(TABLES * SAMPLED)], np.uint64)


def shingle_hashes(text: str, width: int) -> np.ndarray:
    """The different hashes of the text's shingles, in order."""
    words = text.encode("utf-8", "replace").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter((xxhash.xxh64_intdigest(w, SEED) for w in words), np.uint64, len(words))
    n = max(1, len(h) - width + 1)
    mixed = np.zeros(n, np.uint64)
    for k in range(min(width, len(h))):
        mixed = mixed * np.uint64(0x100000001B3) + h[k : k + n]
    mixed = (mixed ^ (mixed >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    mixed ^= mixed >> np.uint64(29)
    return np.unique(mixed)


def sampled_fingerprints(own: np.ndarray) -> list[int]:
    """TABLES fingerprints, each the SimHash of SAMPLED shingles that min-wise permutations of all of them choose: texts of
    similarity s agree in one with chance s ** SAMPLED. Long texts are taken in slices."""
    chosen = None
    for start in range(0, len(own), SLICE):
        part = own[start : start + SLICE] if chosen is None else np.concatenate([chosen, own[start : start + SLICE]])
        best = np.empty(TABLES * SAMPLED, np.uint64)
        for k, factor in enumerate(SPREAD[:, 0]):
            spread = part * factor
            best[k] = part[(spread ^ (spread >> np.uint64(32))).argmin()]
        chosen = best
    out = []
    for part in chosen.reshape(TABLES, SAMPLED):
        counts = bit_counts(part * np.uint64(0xD6E8FEB86659FD93))
        out.append(int((np.left_shift(np.uint64(1), np.arange(64, dtype=np.uint64)) * (2 * counts > SAMPLED)).sum(dtype=np.uint64).view(np.int64)))
    return out


def alike(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sets of different shingle hashes."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) or len(b) else 1.0


def set_keys(sets: list[np.ndarray]) -> pa.Array:
    """What tells sets of shingle hashes apart."""
    return pa.array(np.array([xxhash.xxh64_intdigest(s.tobytes(), SEED) for s in sets], np.uint64).view(np.int64))


def widened(roots: DataFrame, links: DataFrame) -> DataFrame:
    """The roots after more links: those found before stand for all links that led to them."""
    return components(roots.toDF("a", "b").unionByName(links))


def rooted(keys: DataFrame, roots: DataFrame) -> DataFrame:
    """keys with the column root: what their fp is linked to, or the fp itself."""
    found = keys.groupBy("fp").agg(F.count("*").alias("n")).join(roots.withColumnRenamed("node", "fp"), "fp", "left")
    found = stage(found.withColumn("root", F.coalesce("root", "fp")), "roots")
    return attach(keys, found, ["fp"], "n").select("key", "fp", "samples", "root")


def open_groups(keys: DataFrame) -> DataFrame:
    """key, fp, root, table, sample and heads of the groups with one sampled fingerprint whose members are not all linked yet. Heads are two members:
    the one that is in the largest groups by all its samples, which of near copies with few changes each is the one with the fewest, and any other."""
    tables = keys.select("key", "fp", "root", F.posexplode("samples").alias("table", "sample"))
    groups = tables.groupBy("table", "sample").agg(F.count("*").alias("n"), F.min("root").alias("low"), F.max("root").alias("high"))
    groups = stage(groups.where("low <> high").select("table", "sample", "n"), "samples")
    met = stage(attach(tables, groups, ["table", "sample"], "n").where("n is not null"), "members")
    central = met.groupBy("key").agg(F.sum("n").alias("central"))
    own = F.struct("key", "fp", "root")
    heads = F.array_distinct(F.array(F.min(F.struct(-F.col("central"), own.alias("own")))["own"], F.min(F.struct(F.xxhash64("key"), own.alias("own")))["own"]))
    heads = stage(met.join(central, "key").groupBy("table", "sample").agg(F.count("*").alias("n"), heads.alias("heads")), "heads")
    return attach(met.drop("n"), heads, ["table", "sample"], "n").drop("n")


def compared(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (ka, fa, kb, fb) of keys with the similarity of their whole sets. A key may be in very many pairs."""
    for side in ("a", "b"):
        used = pairs.groupBy(f"k{side}").agg(F.count("*").alias("n"))
        used = stage(used.join(sets.select(F.col("key").alias(f"k{side}"), F.col("hashes").alias(f"h{side}")), f"k{side}"), "partners")
        pairs = attach(pairs, used, [f"k{side}"], "n").drop("n")

    def compare(batch: pa.RecordBatch) -> pa.RecordBatch:
        ones, others = (batch.column(c) for c in ("ha", "hb"))
        found = [alike(ones[i].values.to_numpy(), others[i].values.to_numpy()) for i in range(batch.num_rows)]
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("ka", "fa", "kb", "fb")), pa.array(found, pa.float64())], ["ka", "fa", "kb", "fb", "like"])

    return in_batches(pairs.select("ka", "fa", "kb", "fb", "ha", "hb"), compare, "ka bigint, fa bigint, kb bigint, fb bigint, like double", rows=64)


def close(pairs: DataFrame, similarity: float) -> DataFrame:
    return pairs.where(F.col("like") >= similarity).select(F.col("fa").alias("a"), F.col("fb").alias("b"))


def left_over(met: DataFrame, keys: DataFrame) -> DataFrame:
    """key, fp and root of the members of groups in which documents that are no heads are still in different components."""
    rest = met.where(~F.expr("exists(heads, x -> x.key = key)")).select("key", "table", "sample")
    rest = stage(rest.join(keys.select("key", "fp", "root"), "key"), "rest")
    groups = rest.groupBy("table", "sample").agg(F.count("*").alias("n"), F.min("root").alias("low"), F.max("root").alias("high"))
    groups = stage(groups.where("low <> high").select("table", "sample", "n"), "open")
    return attach(rest, groups, ["table", "sample"], "n").where("n is not null").select("key", "fp", "root").distinct()


def distances(pairs: DataFrame, most: int = 2) -> DataFrame:
    """key and pivots: heads that a document has been compared with, and how far it is from each; a head is at distance 0 from itself. Of
    many heads the `most` are kept that most documents have been compared with, so that documents have pivots in common."""
    heads = stage(pairs.groupBy(F.col("kb").alias("pivot")).agg(F.count("*").alias("n")), "pivots")
    far = attach(pairs.select(F.col("ka").alias("key"), F.col("kb").alias("pivot"), (1 - F.col("like")).alias("far")), heads, ["pivot"], "n")
    far = far.unionByName(heads.select(F.col("pivot").alias("key"), "pivot", F.lit(0.0).alias("far"), "n"))
    best = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("n"), "pivot"))
    return far.withColumn("place", best).where(F.col("place") <= most).groupBy("key").agg(F.sort_array(F.collect_list(F.struct("place", "pivot", "far"))).alias("pivots"))


def overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many values each sorted set on the left shares with each on the right, by products of 0/1 matrices over portions of the shared values."""
    shared = np.intersect1d(np.concatenate(left), np.concatenate(right))
    total = np.zeros((len(left), len(right)), np.float32)

    def marks(sets: list[np.ndarray], part: np.ndarray) -> np.ndarray:
        out = np.zeros((len(sets), len(part)), np.float32)
        for row, own in zip(out, sets):
            own = own[np.searchsorted(own, part[0]) : np.searchsorted(own, part[-1], "right")]
            at = np.searchsorted(part, own)
            row[at[part[at] == own]] = 1
        return out

    for start in range(0, len(shared), PORTION):
        part = shared[start : start + PORTION]
        total += marks(left, part) @ marks(right, part).T
    return total


def pivot_links(members: DataFrame, sets: DataFrame, pivots: DataFrame, similarity: float) -> DataFrame:
    """(a, b): links between members (key, fp, root) with the same first pivot. Those that are not in the pivot's component yet are compared with all others
    of the pivot, block by block; sets are compared where they are and only links come out, at most one less than a block has members."""
    first = pivots.select("key", F.col("pivots")[0]["pivot"].alias("pivot"), F.col("pivots")[0]["far"].alias("far"))
    near = members.join(first, "key")
    sizes = near.groupBy("pivot").agg(F.count("*").alias("n"), F.mode("root", True).alias("most"))
    alone = F.count_if(F.col("root") != F.col("most"))
    sizes = stage(attach(near, sizes, ["pivot"], "n").groupBy("pivot", "most").agg(F.count("*").alias("n"), alone.alias("alone")).where("alone > 0"), "pivoted")
    rows = attach(near, sizes, ["pivot"], "n").where("alone is not null")
    rows = rows.withColumns({"rows_side": F.ceil(F.col("n") / PAIR_BLOCK).cast("int"), "alone_side": F.ceil(F.col("alone") / PAIR_BLOCK).cast("int")}).join(sets, "key")
    part = lambda side: F.pmod(F.xxhash64("key"), F.col(side)).cast("int")
    every = lambda side: F.explode(F.sequence(F.lit(0), F.col(side) - 1))
    columns = ["key", "fp", "root", "far", "hashes"]
    asking = rows.where("root <> most").select("pivot", part("alone_side").alias("i"), every("rows_side").alias("j"), F.lit(True).alias("asks"), *columns)
    asked = rows.select("pivot", every("alone_side").alias("i"), part("rows_side").alias("j"), F.lit(False).alias("asks"), *columns)

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        one, other = group[group["asks"]], group[~group["asks"]]
        found = []
        if len(one) and len(other):
            sizes = [np.array([len(x) for x in g["hashes"]], np.float32) for g in (one, other)]
            both = overlaps(*[[np.asarray(x).view(np.uint64) for x in g["hashes"]] for g in (one, other)])
            like = both / (sizes[0][:, None] + sizes[1][None, :] - both)
            ok = (like >= similarity - 1e-6) & (one["root"].to_numpy()[:, None] != other["root"].to_numpy()[None, :])
            ok &= np.abs(one["far"].to_numpy()[:, None] - other["far"].to_numpy()[None, :]) <= 1 - similarity + 1e-9
            up = {}

            def top(x):
                while x in up:
                    x = up[x]
                return x

            for a, b in zip(*np.nonzero(ok)):
                meet = float(both[a, b])
                if meet / (float(sizes[0][a]) + float(sizes[1][b]) - meet) < similarity:
                    continue
                x, y = top(int(one["fp"].iat[a])), top(int(other["fp"].iat[b]))
                if x != y:
                    up[x] = y
                    found.append((x, y))
        return pd.DataFrame(found, columns=["a", "b"])

    return asking.unionByName(asked).groupBy("pivot", "i", "j").applyInPandas(compare, "a bigint, b bigint")


def may_be_close(pivots: pa.ListArray, a: np.ndarray, b: np.ndarray, most: float) -> np.ndarray:
    """Which pairs (a, b) of rows their distances from common pivots leave open. The distance 1 - similarity obeys the triangle inequality, so
    two documents whose distances from one pivot differ by more than `most` are further than that from each other."""
    sizes = pivots.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    owner = np.repeat(np.arange(len(pivots)), sizes)
    flat = pivots.flatten()
    names, far = flat.field("pivot").to_numpy(zero_copy_only=False), flat.field("far").to_numpy(zero_copy_only=False)
    ok = np.ones(len(a), bool)
    for name in np.unique(names):
        own = np.full(len(pivots), np.nan)
        own[owner[names == name]] = far[names == name]
        ok &= ~(np.abs(own[a] - own[b]) > most + 1e-9)
    return ok


def same_first(pivots: pa.ListArray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which pairs have the same first pivot, so that `pivot_links` has compared them."""
    first = [None if p is None else p[0]["pivot"] for p in pivots.to_pylist()]
    number = pd.factorize(np.array(first, dtype=object))[0]
    return (number[a] == number[b]) & (number[a] >= 0)


def crowded(members: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The members that can have a partner: a set of n shingles of which more than n - similarity * n are in no other set is similar enough to none."""
    shingles = members.select("key").join(sets, "key").select("key", F.explode("hashes").alias("h"))
    own = shingles.groupBy("h").agg(F.count("*").alias("n"), F.min("key").alias("key")).where("n = 1").groupBy("key").agg(F.count("*").alias("own"))
    sizes = members.join(sets.select("key", F.size("hashes").alias("size")), "key").join(own, "key", "left")
    return sizes.where(F.coalesce("own", F.lit(0)) <= F.col("size") - F.ceil(similarity * F.col("size") - 1e-9)).select(*members.columns)


def partners(members: DataFrame, sets: DataFrame, similarity: float, pivots: DataFrame) -> DataFrame:
    """Pairs (ka, fa, kb, fb) of members of different components, with every pair whose sets are as similar as asked and that has not the same first pivot.

    Of a set of n shingles, at least similarity * n are in a partner's, so in any one order of all shingles the two share one of
    their first n - similarity * n + 1. The order is: those that only one component has, then by rising number of members. So a
    passage that many share comes last, and documents meet by what is rare in them. Members that hold too much of their own to have a partner go before
    shingles are looked up (`crowded`). Groups that are large nevertheless are cut into a
    grid of blocks, which meet every pair; sizes, places in the order and distances from common pivots leave out pairs that cannot be similar
    enough, and no others: those near a pivot, which are linked through it, are not compared with those far from it."""
    members = stage(crowded(members, sets, similarity), "crowded").join(pivots, "key", "left")
    rows = members.select("key", "fp", "root").join(sets, "key").select("key", "root", F.size("hashes").alias("size"), F.explode("hashes").alias("h"))
    seen = rows.groupBy("h").agg(F.count("*").alias("n"), F.min("root").alias("low"), F.max("root").alias("high"))
    seen = stage(seen.where("low <> high").select("h", "n"), "shared")
    shared = attach(rows.select("key", "size", "h"), seen, ["h"], "n").where("n is not null")
    own = Window.partitionBy("key")
    at = F.col("size") - F.count("*").over(own) + F.row_number().over(own.orderBy("n", "h")) - 1
    first = shared.withColumn("at", at).where(F.col("at") <= F.col("size") - F.ceil(similarity * F.col("size") - 1e-9))
    first = stage(first.select("key", "size", "h", "at").join(members, "key"), "first")
    groups = first.groupBy("h").agg(F.count("*").alias("n"), F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high")
    groups = stage(groups.select("h", "n", F.ceil(F.col("n") / PAIR_BLOCK).cast("int").alias("side")), "sides")
    rows = attach(first, groups, ["h"], "n").where("side is not null")
    part, other = F.pmod(F.xxhash64("key"), F.col("side")).cast("int"), F.explode(F.sequence(F.lit(0), F.col("side") - 1))
    rows = rows.withColumn("part", part).withColumn("other", other).withColumns({"i": F.least("part", "other"), "j": F.greatest("part", "other")})
    columns = ["key", "fp", "root", "size", "at"]
    blocks = rows.groupBy("h", "i", "j").agg(F.collect_list(F.struct(*columns, "pivots")).alias("own"))

    def pair(batch: pa.RecordBatch):
        for own in batch.column("own"):
            key, fp, root, size, at = (own.values.field(c).to_numpy().astype(np.int64) for c in columns)
            a, b = np.nonzero((root[:, None] != root[None, :]) & (key[:, None] < key[None, :]))
            least = similarity / (1 + similarity) * (size[a] + size[b]) - 1e-9
            ok = np.minimum(size[a] - at[a], size[b] - at[b]) >= least
            a, b = a[ok], b[ok]
            pivots = own.values.field("pivots")
            ok = may_be_close(pivots, a, b, 1 - similarity) & ~same_first(pivots, a, b)
            a, b = a[ok], b[ok]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (key[a], fp[a], key[b], fp[b])], ["ka", "fa", "kb", "fb"])

    return in_batches(blocks.select("own"), pair, "ka bigint, fa bigint, kb bigint, fb bigint", rows=64).distinct()


def similar_documents(docs: DataFrame, width: int = 5, similarity: float = 0.8, radius: int = 2) -> DataFrame:
    """One row per document: doc_id, component_id (the smallest doc_id that links reach).

    Documents link if their whole fingerprints differ in `radius` or fewer bits, or if one of their sampled fingerprints agrees and
    the similarity of their shingle sets, taken whole, is `similarity` or more. At a similarity of 0.8 twelve samples of four miss about two pairs in a
    thousand. In a group with one sampled fingerprint each document is compared with two heads; where that leaves other members
    in different components, they are compared among themselves by their rarest shingles (`partners`), which misses no pair.
    doc_id may be of any type that can be ordered; null and empty texts are one group.

    The result is staged. Sets, longer than the texts, are written for documents with an open group only, from their texts once those groups are known;
    what a later table replaces is removed."""
    return stage_result(docs.sparkSession, lambda: _placed(docs, width, similarity, radius), "similar")


def _placed(docs: DataFrame, width: int, similarity: float, radius: int) -> DataFrame:
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType.simpleString()

    def batch(rows: pa.RecordBatch) -> pa.RecordBatch:
        texts = rows.column("text").to_pylist()
        sets = [shingle_hashes(t, width) for t in texts]
        samples = pa.array([sampled_fingerprints(s) if len(s) else [] for s in sets], pa.list_(pa.int64()))
        fps = pa.array([fingerprint(t, width) for t in texts], pa.int64())
        return pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column("text_hash"), fps, set_keys(sets), samples], ["doc_id", "text_hash", "fp", "key", "samples"])

    def batch_of_sets(rows: pa.RecordBatch) -> pa.RecordBatch:
        sets = [shingle_hashes(t, width) for t in rows.column("text").to_pylist()]
        return pa.RecordBatch.from_arrays([set_keys(sets), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], ["key", "hashes"])

    texts = documents(docs).withColumn("text_hash", F.xxhash64("text"))
    whole = stage(in_batches(texts, batch, f"doc_id {kind}, text_hash bigint, fp bigint, key bigint, samples array<bigint>"), "whole")
    whole_path = staged()[-1]
    rows = stage(whole.select("doc_id", "fp", "key"), "rows")
    classes = stage(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n")), "classes")
    kept = [F.min("fp").alias("fp"), F.min("text_hash").alias("text_hash"), F.first("samples").alias("samples")]
    keys = stage(whole.where("size(samples) > 0").groupBy("key").agg(*kept), "keys")
    forget(spark, [whole_path])
    same = rows.select("key", F.col("fp").alias("a")).distinct().join(keys.select("key", F.col("fp").alias("b")), "key").select("a", "b")
    edges = stage_result(spark, lambda: links(classes, radius).unionByName(same.where("a <> b")), "links")
    roots = components(edges)
    met = stage_result(spark, lambda: open_groups(rooted(keys, roots)), "met")
    used = keys.select("key", "text_hash").join(met.select("key").distinct(), "key").select("text_hash")
    used = texts.groupBy("text_hash").agg(F.first("text").alias("text")).join(used, "text_hash", "left_semi")
    sets = stage(in_batches(used.select("text"), batch_of_sets, "key bigint, hashes array<bigint>"), "sets")
    pairs = met.select("key", "fp", "root", F.explode("heads").alias("head")).where("root <> head.root")
    pairs = stage(pairs.selectExpr("key ka", "fp fa", "head.key kb", "head.fp fb").distinct(), "pairs")
    near = stage_result(spark, lambda: compared(pairs, sets), "compared")
    roots = widened(roots, close(near, similarity))
    rest = stage_result(spark, lambda: left_over(met, rooted(keys, roots)), "members")
    if not rest.isEmpty():
        pivots = stage_result(spark, lambda: distances(near), "distances")
        roots = widened(roots, stage_result(spark, lambda: pivot_links(rest, sets, pivots, similarity), "inside"))
        rest = stage_result(spark, lambda: left_over(met, rooted(keys, roots)), "members")
        pairs = stage_result(spark, lambda: partners(rest, sets, similarity, pivots), "pairs")
        roots = widened(roots, stage_result(spark, lambda: close(compared(pairs, sets), similarity), "close"))
    roots = roots.withColumnRenamed("node", "fp")
    placed = classes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = placed.groupBy("root").agg(F.min("first_id").alias("component_id"), F.count("*").alias("size"))
    named = attach(placed, least, ["root"], "size").select("fp", "n", "component_id")
    return attach(rows.select("doc_id", "fp"), stage(named, "named"), ["fp"], "n").select("doc_id", "component_id")
