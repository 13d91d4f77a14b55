"""Hard negatives of anchors, scored with subset-sum tables over bit planes (the method of the Four Russians)."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from alertloom.llm.common import attach, in_batches, stage

#: Components are floor(SCALE * x), held within plus or minus LARGEST, so that scores of up to 5,000 dimensions times 100 fit 64 bits.
SCALE, LARGEST = 256, 1 << 22
#: Dimensions of one table: eight bits of a plane make the byte that is looked up.
GROUP = 8
CANDIDATE_ROWS, ANCHOR_ROWS = 1 << 14, 1 << 10
SCORED_AT_ONCE = 1 << 20
NO_ID = (1 << 63) - 1
SUBSETS = ((np.arange(256)[:, None] >> np.arange(GROUP)) & 1).astype(np.int64)


def usable(vectors: DataFrame) -> DataFrame:
    """id, label and q (whole numbers) of the rows that take part: no null label, vector or component, all of them finite."""
    whole = F.transform("embedding", lambda x: x.cast("double"))
    bad = F.exists(whole, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.where(F.col("label").isNotNull() & F.col("embedding").isNotNull()).where(~bad)
    q = F.transform(whole, lambda x: F.when(x * SCALE >= LARGEST, F.lit(LARGEST)).when(x * SCALE <= -LARGEST, F.lit(-LARGEST)).otherwise(F.floor(x * SCALE)).cast("int"))
    return rows.select(F.coalesce(F.col("vec_id").cast("long"), F.lit(NO_ID)).alias("id"), F.col("label").cast("long").alias("label"), q.alias("q")).distinct()


def as_matrix(column: pa.Array, width: int) -> np.ndarray:
    """The lists as rows of a matrix; shorter ones are filled with zeros."""
    sizes = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(column), width), np.int64)
    out[np.arange(width) < sizes[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
    return out


def bit_planes(q: np.ndarray, planes: int) -> np.ndarray:
    """Two's complement in bit planes: byte [row, plane, group] has that bit of the eight components of the group."""
    bits = (q[:, None, :] >> np.arange(planes)[:, None]) & 1
    return np.packbits(bits.astype(np.uint8), axis=2, bitorder="little")


def subset_sums(q: np.ndarray) -> np.ndarray:
    """[group, byte, anchor]: for each anchor and group of eight dimensions, the sum of the components chosen by the byte."""
    groups = q.reshape(len(q), -1, GROUP)
    return np.ascontiguousarray(np.einsum("agd,sd->gsa", groups, SUBSETS))


def scores(bytes_: np.ndarray, tables: np.ndarray) -> np.ndarray:
    """[candidate, anchor]: inner products. For each plane, highest first, the sum so far is doubled and the tables' entries at the
    plane's bytes are added; the highest plane is the sign and counts negative."""
    planes, groups = bytes_.shape[1:]
    total = np.zeros((len(bytes_), tables.shape[2]), tables.dtype)
    for p in reversed(range(planes)):
        total += total
        for g in range(groups):
            found = tables[g][bytes_[:, p, g]]
            total = total - found if p == planes - 1 else np.add(total, found, out=total)
    return total


def best(anchor: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the first k entries of each anchor, by score from the highest, then by id."""
    order = np.lexsort((ids, -score, anchor))
    start = np.r_[True, anchor[order][1:] != anchor[order][:-1]] if len(order) else np.empty(0, bool)
    place = np.arange(len(order)) - np.maximum.accumulate(np.where(start, np.arange(len(order)), 0))
    return order[place < k]


def _top(column: np.ndarray, k: int) -> np.ndarray:
    """Where each column of the matrix is at least its k-th highest value: ties stay."""
    if len(column) <= k:
        return np.ones(column.shape, bool)
    return column >= np.partition(column, len(column) - k, axis=0)[len(column) - k]


def _blocks(group: pd.DataFrame, dtype: type, width: int, planes: int):
    """The anchors of a cell, in portions, with the scores of all its candidates."""
    held = group[group["planes"].notna()]
    bytes_ = np.frombuffer(b"".join(held["planes"]), np.uint8).reshape(len(held), planes, width // GROUP)
    ids, labels = held["id"].to_numpy(), held["label"].to_numpy()
    asking = group[group["planes"].isna()].reset_index(drop=True)
    step = max(1, SCORED_AT_ONCE // max(1, len(held)))
    for start in range(0, len(asking), step) if len(held) else ():
        part = asking.iloc[start : start + step]
        q = np.stack([np.frombuffer(x, np.int32) for x in part["q"]]).astype(np.int64)
        yield part, ids, labels, scores(bytes_, subset_sums(q).astype(dtype))


def mine(vectors: DataFrame, anchor: Column, positives: int = 5, negatives: int = 5, least: int = 80, most: int = 100) -> DataFrame:
    """Hard negatives: anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    vectors: vec_id, label, embedding; `anchor` is a condition on vec_id. Components are floor(256 * x). A row's score is its inner
    product with the anchor; higher scores come first, ties by smaller vec_id. An anchor's positives are the first rows of its label
    with another vec_id. For each positive the first rows of other labels are returned whose score is at least `least` and at most
    `most` per cent of the positive's; a positive with a negative score thus has none.

    Candidates are packed once into bit planes and cut by hash into blocks, anchors into blocks too; a cell, one task's work, is one
    block of each, so no task's size depends on a label, a vector that many rows have, or the number of anchors. Positives are sought
    in blocks of the anchor's label only. All scores are exact.

    Rows with a null label, vector or component, or one that is not finite, take no part. Rows that repeat vec_id, label and vector count
    once; different rows with one vec_id count each, and each of them is an anchor. A row without vec_id comes last among ties and has a
    null id in the result. Vectors of different length are filled with zeros; empty ones are zero. Components beyond 16,384 count as
    that. No rows, or no anchors, give an empty result. Other columns are not read."""
    rows = stage(usable(vectors), "vectors")
    top = rows.agg(F.count("*"), F.max(F.size("q")), F.max(F.array_max("q")), F.min(F.array_min("q"))).first()
    n, width = top[0], -(-max(1, top[1] or 0) // GROUP) * GROUP
    low, high = min(0, top[3] or 0), max(0, top[2] or 0)
    planes = max(int(high).bit_length(), int(~low).bit_length()) + 1
    dtype = np.int32 if width * max(high, -low, 1) << planes < 1 << 31 else np.int64
    chosen = rows.where(F.when(F.col("id") != NO_ID, F.col("id")).isNotNull()).withColumn("vec_id", F.col("id")).where(anchor)

    def pack(batch: pa.RecordBatch) -> pa.RecordBatch:
        made = bit_planes(as_matrix(batch.column("q"), width), planes)
        return pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), pa.array([r.tobytes() for r in made], pa.binary())], ["id", "label", "planes"])

    def raw(batch: pa.RecordBatch) -> pa.RecordBatch:
        q = as_matrix(batch.column("q"), width).astype(np.int32)
        key = pa.array([r.tobytes() for r in q], pa.binary())
        return pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), key], ["id", "label", "q"])

    held = stage(in_batches(rows, pack, "id bigint, label bigint, planes binary", rows=8192), "planes")
    asking = stage(in_batches(chosen.select("id", "label", "q"), raw, "id bigint, label bigint, q binary", rows=8192), "anchors")
    asking_rows = asking.count()
    spread = lambda side, salt: F.pmod(F.xxhash64("id", F.lit(salt)), side)
    every = lambda side: F.explode(F.sequence(F.lit(0).cast("bigint"), side - 1))
    anchor_side = max(1, -(-asking_rows // ANCHOR_ROWS))
    blocks = held.groupBy("label").agg(F.ceil(F.count("*") / CANDIDATE_ROWS).alias("side"), F.count("*").alias("n"))
    blocks = stage(blocks, "labels")

    # Positives: a cell is one block of a label's candidates with one block of the label's anchors.
    none = lambda kind, name: F.lit(None).cast(kind).alias(name)
    own = attach(asking, blocks, ["label"], "n").select("label", "id", "q", spread(F.lit(anchor_side), 1).alias("i"), every(F.col("side")).alias("j"), none("binary", "planes"))
    there = attach(held, blocks, ["label"], "n").join(asking.select("label").distinct(), "label", "left_semi")
    there = there.select("label", "id", none("binary", "q"), every(F.lit(anchor_side).cast("bigint")).alias("i"), spread(F.col("side"), 2).alias("j"), "planes")

    def find_positives(group: pd.DataFrame) -> pd.DataFrame:
        out = []
        for part, ids, labels, s in _blocks(group, dtype, width, planes):
            own_ids = part["id"].to_numpy()
            s = s.astype(np.int64)
            s[ids[:, None] == own_ids[None, :]] = np.iinfo(np.int64).min
            c, a = np.nonzero(_top(s, positives) & (s > np.iinfo(np.int64).min))
            keep = best(a, s[c, a], ids[c], positives)
            a, c = a[keep], c[keep]
            out.append(pd.DataFrame({"id": own_ids[a], "label": part["label"].to_numpy()[a], "q": part["q"].to_numpy()[a], "positive": ids[c], "score": s[c, a]}))
        return pd.concat(out) if out else pd.DataFrame({"id": [], "label": [], "q": [], "positive": [], "score": []})

    found = own.unionByName(there).groupBy("label", "i", "j").applyInPandas(find_positives, "id bigint, label bigint, q binary, positive bigint, score bigint")
    first = Window.partitionBy("id", "label", "q").orderBy(F.desc("score"), "positive")
    found = found.withColumn("r", F.row_number().over(first)).where(F.col("r") <= positives)
    wanted = found.groupBy("id", "label", "q").agg(F.sort_array(F.collect_list(F.struct("r", "positive", "score"))).alias("p"))
    wanted = stage(wanted.where(F.exists("p", lambda x: x["score"] >= 0)), "positives")

    # Negatives: all blocks of candidates, whatever their label, with all blocks of anchors.
    side = max(1, -(-n // CANDIDATE_ROWS))
    own = wanted.select("label", "id", "q", spread(F.lit(anchor_side), 1).alias("i"), every(F.lit(side).cast("bigint")).alias("j"), none("binary", "planes"), F.transform("p", lambda x: x["score"]).alias("p"))
    there = held.select("label", "id", none("binary", "q"), every(F.lit(anchor_side).cast("bigint")).alias("i"), spread(F.lit(side), 2).alias("j"), "planes", none("array<bigint>", "p"))

    def find_negatives(group: pd.DataFrame) -> pd.DataFrame:
        out = []
        for part, ids, labels, s in _blocks(group, dtype, width, planes):
            bound = np.full((len(part), positives), -1, np.int64)
            for row, p in enumerate(part["p"]):
                bound[row, : len(p)] = p
            low, high = -(-least * bound // 100), most * bound // 100
            some = bound >= 0
            floor = np.where(some, low, np.iinfo(np.int64).max).min(1)
            a, c = np.nonzero(((s >= floor) & (s <= high.max(1)) & (labels[:, None] != part["label"].to_numpy())).T)
            value = s[c, a].astype(np.int64)
            order = np.lexsort((ids[c], -value, a))
            a, c, value = a[order], c[order], value[order]
            for k in range(positives):
                ok = some[a, k] & (value >= low[a, k]) & (value <= high[a, k])
                who, what, worth = a[ok], c[ok], value[ok]
                start = np.r_[True, who[1:] != who[:-1]] if len(who) else np.empty(0, bool)
                place = np.arange(len(who)) - np.maximum.accumulate(np.where(start, np.arange(len(who)), 0))
                take = place < negatives
                out.append(pd.DataFrame({
                    "id": part["id"].to_numpy()[who[take]], "label": part["label"].to_numpy()[who[take]], "q": part["q"].to_numpy()[who[take]],
                    "r": np.int32(k + 1), "negative": ids[what[take]], "negative_score": worth[take],
                }))
        return pd.concat(out) if out else pd.DataFrame({"id": [], "label": [], "q": [], "r": [], "negative": [], "negative_score": []})

    near = own.unionByName(there).groupBy("i", "j").applyInPandas(find_negatives, "id bigint, label bigint, q binary, r int, negative bigint, negative_score bigint")
    key = ["id", "label", "q"]
    first = Window.partitionBy(*key, "r").orderBy(F.desc("negative_score"), "negative")
    near = near.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= negatives)
    pairs = wanted.select(*key, F.explode("p").alias("p")).select(*key, "p.r", "p.positive", "p.score")
    known = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
    return near.join(pairs, [*key, "r"]).select(
        F.col("id").alias("anchor_id"), known("positive").alias("positive_id"), "rank", known("negative").alias("negative_id"),
        F.col("score").alias("positive_score"), "negative_score",
    )
