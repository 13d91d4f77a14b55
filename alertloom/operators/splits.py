"""Leak-free splits. Groups are ordered by a hash of seed and key, so the same seed gives
the same split whatever the row order or partitioning."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alertloom import fixed
from alertloom.functions import columns as C
from alertloom.operators.scans import attach_row, group_key, hash_order, rank_rows
from alertloom.session import cut_lineage


def hash_rank(keys: DataFrame, key: str, seed: int | str, by: Sequence[str] = ()) -> DataFrame:
    """Add `rank` in hash order and `n_total`, the number of keys in the group."""
    hashed = keys.withColumn("__h", hash_order(seed, key))
    return rank_rows(hashed, "__h", by, [key], total="n_total").drop("__h")


def group_split(df: DataFrame, group: str, frac: float = 0.25, seed: int = 0) -> DataFrame:
    """Add `fold` (test or train); whole groups go to one side, ceil(frac x groups) to
    test; rows without a group are one."""
    ranked = hash_rank(df.select(group).distinct(), group, seed)
    fold = F.when(F.col("rank") <= F.ceil(F.col("n_total") * frac), "test").otherwise("train")
    folds = ranked.select(group_key([group]).alias("__g"), fold.alias("fold"))
    return df.withColumn("__g", group_key([group])).join(folds, "__g").drop("__g")


def stratified_split(campaigns: DataFrame, frac: float = 0.75, seed: int = 0, strata: Sequence[str] = ("class", "framework", "benign_subtype"), key: str = "campaign_id") -> DataFrame:
    """Add `fold` (train or eval) per stratum: int(frac x n) train campaigns, at least one
    on each side; a campaign alone in its stratum trains."""
    strata = list(strata)
    filled = campaigns.withColumns({s: F.coalesce(F.col(s), F.lit("")) for s in strata})
    n = F.col("n_total")
    cut = F.least(F.greatest(F.lit(1), F.floor(n * frac)), n - 1)
    fold = F.when((n == 1) | (F.col("rank") <= cut), "train").otherwise("eval")
    return hash_rank(filled, key, seed, strata).withColumn("fold", fold).drop("n_total", "rank")


def class_weight(df: DataFrame, y: str = "label") -> DataFrame:
    """Weight (1-p)/p for positives and 1 for negatives, p being the positive share."""
    share = df.agg(F.avg(F.col(y).cast("double")).alias("__p"))
    weight = F.when((F.col(y) == 1) & (F.col("__p") < 1), F.try_divide(1 - F.col("__p"), F.col("__p"))).otherwise(1.0)
    return attach_row(df, share).withColumn("weight", weight).drop("__p")


def fit_scaler(train: DataFrame, cols: Sequence[str], floor: float = 1e-6) -> DataFrame:
    """One row of means and population deviations of the train rows; tiny deviations become 1."""
    stats = train.agg(
        *[F.avg(c).alias(f"mean_{c}") for c in cols], *[F.stddev_pop(c).alias(f"std_{c}") for c in cols]
    )
    return stats.select(
        *[f"mean_{c}" for c in cols],
        *[F.when(F.col(f"std_{c}") < floor, 1.0).otherwise(F.col(f"std_{c}")).alias(f"std_{c}") for c in cols],
    )


def apply_scaler(df: DataFrame, scaler: DataFrame, cols: Sequence[str]) -> DataFrame:
    wide = attach_row(df, scaler)
    scaled = wide.withColumns({c: (F.col(c) - F.col(f"mean_{c}")) / F.col(f"std_{c}") for c in cols})
    return scaled.select(*df.columns)


def benchmark_splits(
    sessions: DataFrame, seed: int = 0, n_heldout: int = 1, held_super_family: str | None = None,
    ratios: Sequence[float] = fixed.PUBLIC_RATIOS,
) -> DataFrame:
    """Add `split`: held-out agent families, held-out stealth variants, and a 60/20/20
    public pool. sessions: session_id (unique), family, klass, stealth."""
    agents = sessions.filter((F.col("klass") == "agent") & (F.coalesce("family", F.lit("")) != ""))
    fams = agents.groupBy("family").agg(
        F.bool_or("stealth").alias("__quiet"), F.bool_or(~F.col("stealth")).alias("__loud")
    )
    by_rule = C.super_family(F.col("family")) == (held_super_family or "")
    fams = fams.withColumn("__super", by_rule & F.lit(bool(held_super_family)))
    eligible = hash_rank(fams.filter(~F.col("__super")).select("family"), "family", seed)
    picked = eligible.filter(F.col("rank") > F.col("n_total") - n_heldout).select("family", F.lit(True).alias("__picked"))
    held = F.col("__super") | F.coalesce("__picked", F.lit(False))
    roles = cut_lineage(fams.join(picked, "family", "left").select(
        "family", held.alias("__held"), (~held & F.col("__quiet") & F.col("__loud")).alias("__mixed")
    ))
    placed = sessions.join(roles, "family", "left").withColumn(
        "split",
        F.when(F.col("__held"), "private_heldout_family").when(F.col("__mixed") & F.col("stealth"), "private_heldout_stealth"),
    ).drop("__held", "__mixed")
    pool = placed.filter(F.col("split").isNull())
    ranked = hash_rank(pool.drop("split"), "session_id", f"{seed}+1")
    n_train, n_dev = F.bround(F.col("n_total") * ratios[0]), F.bround(F.col("n_total") * ratios[1])
    public = ranked.withColumn(
        "split",
        F.when(F.col("rank") <= n_train, "public_train").when(F.col("rank") <= n_train + n_dev, "public_dev").otherwise("public_test"),
    ).drop("n_total", "rank")
    return public.unionByName(placed.filter(F.col("split").isNotNull()))


def split_checksums(key: str = "session_id") -> list:
    """Two checksums of a set of ids that do not depend on their order: sums of two 52-bit pieces of the id hashes. They need
    no sorted list, so a split of any size is combined map-side."""
    digest = F.sha2(F.col(key).cast("string"), 256)
    return [
        F.sum(F.conv(F.substring(digest, at, 13), 16, 10).cast("decimal(20,0)")).cast("string").alias(name)
        for at, name in ((1, "ids_checksum"), (14, "ids_checksum_2"))
    ]


def split_summary(splits: DataFrame) -> DataFrame:
    """Per split: size and two order-free checksums of its ids. (The sha256 of the sorted ids belongs to a split file, which
    holds the list as one value: see `sources.logs`.)"""
    return splits.groupBy("split").agg(F.count(F.lit(1)).alias("n"), *split_checksums())


def split_counts(splits: DataFrame) -> DataFrame:
    """Sessions per split by family and by class."""
    pairs = F.array(
        F.struct(F.lit("family").alias("axis"), F.coalesce(C.blank_to_null(F.col("family")), F.lit("?")).alias("value")),
        F.struct(F.lit("class").alias("axis"), F.coalesce(C.blank_to_null(F.col("klass")), F.lit("?")).alias("value")),
    )
    return splits.select("split", F.explode(pairs).alias("p")).groupBy("split", "p.axis", "p.value").agg(F.count(F.lit(1)).alias("n"))


def overlaps(splits: DataFrame) -> DataFrame:
    """Ids that sit in more than one split; empty when the splits are disjoint."""
    seen = splits.groupBy("session_id").agg(F.count_distinct("split").alias("n_splits"))
    return seen.filter(F.col("n_splits") > 1)


def assert_disjoint(splits: DataFrame) -> None:
    if not overlaps(splits).isEmpty():
        raise ValueError("some session ids are in more than one split")


def set_diff(expected: DataFrame, got: DataFrame, key: str = "session_id") -> DataFrame:
    """Ids on one side only or on both: missing, extra, common. Duplicates count once."""
    a = expected.select(key, F.lit(1).alias("__a"), F.lit(0).alias("__b"))
    b = got.select(key, F.lit(0).alias("__a"), F.lit(1).alias("__b"))
    sides = a.unionByName(b).groupBy(key).agg(F.max("__a").alias("__a"), F.max("__b").alias("__b"))
    kind = F.when(F.col("__b") == 0, "missing").when(F.col("__a") == 0, "extra").otherwise("common")
    return sides.select(key, kind.alias("kind"))
