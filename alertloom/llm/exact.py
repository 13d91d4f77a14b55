"""Exact dedup over an extendible-hash index kept in shared files. DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alertloom.llm.common import HOT_KEYS, attach, documents, stage

CAPACITY = 1 << 16
FIRST_DEPTH = 4
MAX_DEPTH = 24


def directory(keys: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(slot, depth, n): the leaf buckets of the index over the keys `h`. A slot is the leading `depth` bits of the key.
    The directory doubles while a bucket of full depth holds more than `capacity` different keys; it has about as many
    slots as there are buckets. One aggregation at full depth serves all shallower depths."""
    depth = FIRST_DEPTH
    while True:
        leaves = keys.groupBy(_slot(depth).alias("slot")).count()
        top = leaves.agg(F.max("count")).first()[0] or 0
        if top <= capacity or depth >= MAX_DEPTH:
            break
        depth += max(1, (top // capacity).bit_length() - 1)
        depth = min(depth, MAX_DEPTH)
    levels = leaves.withColumn("depth", F.explode(F.sequence(F.lit(0), F.lit(depth))))
    levels = levels.groupBy("depth", F.expr(f"shiftright(slot, {depth} - depth)").alias("slot")).agg(F.sum("count").alias("n"))
    fits = levels.where((F.col("n") <= capacity) | (F.col("depth") == depth))
    above = levels.where(F.col("n") > capacity).select((F.col("depth") + 1).alias("depth"), F.col("slot").alias("up"))
    inner = fits.withColumn("up", F.shiftright("slot", 1)).join(above, ["depth", "up"], "left_semi").select("slot", "depth", "n")
    return inner.unionByName(fits.where("depth = 0").select("slot", "depth", "n"))


def _slot(depth: int) -> F.Column:
    return F.shiftrightunsigned("h", 64 - depth) if depth else F.lit(0).cast("long")


def _key(hash_bits: int) -> F.Column:
    key = F.xxhash64("text")
    return key if hash_bits == 64 else F.shiftleft(F.shiftrightunsigned(key, 64 - hash_bits), 64 - hash_bits)


def index_entries(docs: DataFrame, hash_bits: int = 64, capacity: int = CAPACITY) -> tuple[DataFrame, DataFrame]:
    """The index, as two staged tables. Entries: doc_id, h (key), text_sha256. Buckets: one row per key with the number of
    its entries and the bucket (start of its key range) that the directory gives it, written
    range by range so that each owner task has whole key ranges."""
    entries = stage(docs.select("doc_id", _key(hash_bits).alias("h"), F.sha2("text", 256).alias("text_sha256")), "entries")
    keys = stage(entries.groupBy("h").agg(F.count("*").alias("entries")), "keys")
    buckets = directory(keys, capacity)
    depths = [r[0] for r in buckets.select("depth").distinct().collect()]
    owned = None
    for depth in depths:
        part = keys.withColumn("slot", _slot(depth)).join(buckets.where(F.col("depth") == depth), "slot").drop("n")
        owned = part if owned is None else owned.unionByName(part)
    owned = keys.withColumns({"slot": F.lit(0).cast("long"), "depth": F.lit(0)}) if owned is None else owned
    start = F.when(F.col("depth") == 0, F.lit(0).cast("long")).otherwise(F.expr("shiftleft(slot, 64 - depth)"))
    owned = owned.select("h", "entries", start.alias("bucket"))
    return entries, stage(owned.repartitionByRange("bucket", "h").sortWithinPartitions("bucket", "h"), "buckets")


def exact_dedup(docs: DataFrame, hash_bits: int = 64, capacity: int = CAPACITY) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256, bucket (start of the key range that owns it).

    Texts are equal when their bytes are; null counts as empty. Of equal texts the row with the largest doc_id stays; a row
    without a doc_id stays only where no copy has one. Rows that repeat a doc_id with the same text all carry the same
    answer. An empty table gives no rows.

    A key with one entry is done. The chain of a key with more entries is made by grouping its texts themselves, which
    compares bytes; copies are combined before the shuffle. Chains with several texts (collisions of the key) are told
    apart by their sha256; `hash_bits` below 64 makes collisions, for tests."""
    docs = documents(docs)
    entries, buckets = index_entries(docs, hash_bits, capacity)
    rows, total = docs.select("doc_id", "text", _key(hash_bits).alias("h")), buckets.agg(F.sum("entries")).first()[0] or 0
    hot = F.col("entries") * HOT_KEYS > F.lit(total)
    shared = buckets.where("entries > 1").select("h", "bucket", "entries")
    own = ["bucket", "h", "text"]
    totals = [F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size")]
    heads = F.broadcast(shared.where(hot))
    common = rows.join(heads, "h").groupBy(*own).agg(*totals)
    rare = rows.join(heads, "h", "left_anti").join(shared.where(~hot).hint("merge"), "h").groupBy(*own).agg(*totals)
    chains = common.unionByName(rare).select("bucket", "h", F.sha2("text", 256).alias("text_sha256"), "keep_id", "group_size")
    single = entries.join(buckets.where("entries = 1"), "h").select("bucket", "h", "text_sha256", F.col("doc_id").alias("keep_id"), F.col("entries").alias("group_size"))
    found = attach(entries, stage(chains.unionByName(single), "chains"), ["h", "text_sha256"], "group_size")
    return found.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256", "bucket")
