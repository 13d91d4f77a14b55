"""Process trees: depth and malicious closure by pointer doubling.

Each round doubles the reach of every open pointer, so a tree of depth d takes about
log2(d) rounds. Finished rows leave the loop. The rows are checkpointed every round,
which keeps the plan short and lets a lost executor be replaced by a re-read."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alertloom.session import cut_lineage


def parent_links(procs: DataFrame) -> DataFrame:
    """One row per process: its parent by the latest row, ties by event id."""
    rows = procs.filter(F.coalesce("guid", F.lit("")) != "")
    parent = F.coalesce("parent_guid", F.lit(""))
    return rows.groupBy("guid").agg(F.max_by(parent, F.struct("ts", "event_id")).alias("parent"))


def _cycle_members(open_rows: DataFrame) -> DataFrame:
    """Processes on a parent cycle. After at least as many doublings as there are rows,
    every pointer has run into its cycle, and the pointers cover exactly its members."""
    n = open_rows.count()
    walk, reach = open_rows.select("guid", "up"), 1
    while reach < n:
        step = walk.select(F.col("guid").alias("up"), F.col("up").alias("next"))
        walk = cut_lineage(walk.join(step, "up").select("guid", F.col("next").alias("up")))
        reach *= 2
    return walk.select(F.col("up").alias("guid")).distinct()


def _climb(state: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """Double the pointers until no row is open or the open rows no longer shrink.
    state: guid, up (ancestor or null when finished), hops to it. Returns the finished
    parts and the rows that never finish because they lead into a cycle."""
    state = cut_lineage(state)
    finished, left = [state.filter(F.col("up").isNull())], state.filter(F.col("up").isNotNull())
    known = state
    before = -1
    while True:
        remaining = left.count()
        if remaining == 0 or remaining == before:
            return finished, left
        before = remaining
        above = known.select(F.col("guid").alias("up"), F.col("up").alias("up2"), F.col("hops").alias("hops2"))
        moved = cut_lineage(
            left.join(above, "up", "left").select(
                "guid", F.col("up2").alias("up"), (F.col("hops") + F.coalesce("hops2", F.lit(0))).alias("hops")
            )
        )
        finished.append(moved.filter(F.col("up").isNull()))
        left = moved.filter(F.col("up").isNotNull())
        known = finished[0]
        for part in finished[1:]:
            known = known.unionByName(part)
        known = known.unionByName(left)


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def process_depth(procs: DataFrame) -> DataFrame:
    """guid -> depth. A process without a parent, or its own parent, has depth 0; one
    whose parent is not in the table is 1 below it. Members of a parent cycle are 0.
    procs: guid, parent_guid, ts, event_id."""
    links = parent_links(procs)
    listed = links.select(F.col("guid").alias("parent"), F.lit(True).alias("__known"))
    rooted = (F.col("parent") == "") | (F.col("parent") == F.col("guid"))
    state = links.join(listed, "parent", "left").select(
        "guid",
        F.when(rooted | F.col("__known").isNull(), None).otherwise(F.col("parent")).alias("up"),
        F.when(rooted, 0).otherwise(1).cast("long").alias("hops"),
    )
    finished, looped = _climb(state)
    if looped.isEmpty():
        return _union(finished).select("guid", F.col("hops").cast("int").alias("depth"))
    done = _union(finished)
    rest = state.join(looped.select("guid"), "guid", "left_semi")
    members = _cycle_members(cut_lineage(rest)).withColumn("__on", F.lit(True))
    broken = rest.join(members, "guid", "left").select(
        "guid", F.when(F.col("__on"), None).otherwise(F.col("up")).alias("up"),
        F.when(F.col("__on"), 0).otherwise(F.col("hops")).cast("long").alias("hops"),
    )
    fixed_rows, _ = _climb(broken)
    return done.unionByName(_union(fixed_rows)).select("guid", F.col("hops").cast("int").alias("depth"))


def malicious_closure(procs: DataFrame, seeds: DataFrame, max_depth: int | None = None) -> DataFrame:
    """Every process at or below a seed process, with `hops` to the nearest seed.
    procs: guid, parent_guid, ts, event_id (process creations); seeds: guid."""
    seed = seeds.select("guid").filter(F.col("guid") != "").distinct()
    links = parent_links(procs).filter((F.col("parent") != "") & (F.col("parent") != F.col("guid")))
    flags = seed.withColumn("__s", F.lit(True))
    parent_flags = flags.select(F.col("guid").alias("parent"), F.col("__s").alias("__ps"))
    state = cut_lineage(
        links.join(seed, "guid", "left_anti")
        .join(parent_flags, "parent", "left")
        .select(
            "guid", F.when(F.col("__ps"), None).otherwise(F.col("parent")).alias("up"),
            F.lit(1).cast("long").alias("span"), F.when(F.col("__ps"), 1).cast("long").alias("hops"),
        )
    )
    found = [state.filter(F.col("hops").isNotNull()).select("guid", "hops")]
    left, before = state.filter(F.col("hops").isNull()), -1
    while True:
        remaining = left.count()
        if remaining == 0 or remaining == before:
            break
        before = remaining
        hits = _union(found).select(F.col("guid").alias("up"), F.col("hops").alias("far"), F.lit(None).cast("string").alias("up2"), F.lit(None).cast("long").alias("span2"))
        open_ = left.select(F.col("guid").alias("up"), F.lit(None).cast("long").alias("far"), F.col("up").alias("up2"), F.col("span").alias("span2"))
        moved = cut_lineage(
            left.join(hits.unionByName(open_), "up").select(
                "guid", F.col("up2").alias("up"), (F.col("span") + F.col("span2")).alias("span"),
                (F.col("span") + F.col("far")).alias("hops"),
            )
        )
        found.append(moved.filter(F.col("hops").isNotNull()).select("guid", "hops"))
        left = moved.filter(F.col("hops").isNull()).select("guid", "up", "span", "hops")
    closed = seed.withColumn("hops", F.lit(0).cast("long")).unionByName(_union(found))
    return closed if max_depth is None else closed.filter(F.col("hops") <= max_depth)
