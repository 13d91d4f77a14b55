"""Count-based event windows and the features read from them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from alertloom import fixed
from alertloom.operators.scans import exact_percentiles, group_key, rank_in_key

FEATURES = [
    "dt_mean", "dt_median", "dt_std", "events_per_sec", "distinct_targets", "target_churn",
    "depth_max", "depth_mean", "ai_artifact_mean", "ai_artifact_max",
]


def share_columns(actions: Sequence[str] = fixed.ACTIONS) -> list[str]:
    return [f"act_{a}" for a in actions]


def window_members(
    events: DataFrame,
    size: int = fixed.WINDOW_EVENTS,
    stride: int = fixed.WINDOW_STRIDE,
    key: str = "campaign_id",
    ties: Sequence[str] = ("event_id",),
) -> DataFrame:
    """One row per (window, event): `window_id`, `pos` in the window and `dt` to the event
    before it. An event lies in size/stride windows. Windows never cross a campaign.
    Windows too short to count are still present; `complete` drops them."""
    ranked = rank_in_key(events, key, "ts", list(ties))
    first = F.greatest(F.lit(0), F.ceil((F.col("rn") - (size - 1)) / stride)).cast("long")
    last = F.floor(F.col("rn") / stride).cast("long")
    spread = ranked.select(*events.columns, "rn", "prev_ts", F.explode(F.sequence(first, last)).alias("window_id"))
    pos = F.col("rn") - F.col("window_id") * stride
    return (
        spread.withColumn("pos", pos.cast("int"))
        .withColumn("dt", F.when(F.col("pos") > 0, F.col("ts") - F.col("prev_ts")))
        .drop("rn", "prev_ts")
    )


def complete(n_events: Column, window_id: Column, size: int = fixed.WINDOW_EVENTS) -> Column:
    """A window counts when it is full, or when it is the only one of a short campaign
    that still fills half a window."""
    return (n_events == size) | ((window_id == 0) & (n_events >= size // 2))


def count_windows(events: DataFrame, size: int = fixed.WINDOW_EVENTS, stride: int = fixed.WINDOW_STRIDE, **options) -> DataFrame:
    """Window boundaries: first and last event time and event count."""
    members = window_members(events, size, stride, **options)
    return (
        members.groupBy("campaign_id", "window_id")
        .agg(F.count(F.lit(1)).alias("n_events"), F.min("ts").alias("start_ts"), F.max("ts").alias("end_ts"))
        .filter(complete(F.col("n_events"), F.col("window_id"), size))
    )


def aggregate_features(
    members: DataFrame, keys: Sequence[str], actions: Sequence[str] = fixed.ACTIONS, size: int = fixed.WINDOW_EVENTS,
    extra: Sequence[Column] = (),
) -> DataFrame:
    """The 15 window features. A window holds at most `size` events, so the set of its
    targets and its median are bounded."""
    dt = F.when(F.col("dt") >= 0, F.col("dt"))
    typed = F.greatest(F.count("action"), F.lit(1))
    rows = members.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_events"),
        F.min("ts").alias("start_ts"),
        F.max("ts").alias("end_ts"),
        F.max("label").cast("int").alias("label"),
        F.coalesce(F.avg(dt), F.lit(0.0)).alias("dt_mean"),
        F.coalesce(F.median(dt), F.lit(0.0)).alias("dt_median"),
        F.coalesce(F.stddev_pop(dt), F.lit(0.0)).alias("dt_std"),
        F.size(F.collect_set("target")).alias("distinct_targets"),
        F.max("depth").cast("int").alias("depth_max"),
        F.avg(F.col("depth").cast("double")).alias("depth_mean"),
        F.avg("artifact_ai").alias("ai_artifact_mean"),
        F.max("artifact_ai").alias("ai_artifact_max"),
        *[F.coalesce(F.count_if(F.col("action") == a) / typed, F.lit(0.0)).alias(f"act_{a}") for a in actions],
        *extra,
    )
    n = F.col("n_events")
    return (
        rows.filter(complete(n, F.col("window_id"), size))
        .withColumn("events_per_sec", n / (F.col("end_ts") - F.col("start_ts") + F.lit(1e-6)))
        .withColumn("target_churn", F.col("distinct_targets") / n)
    )


def window_features(
    events: DataFrame, actions: Sequence[str] = fixed.ACTIONS, size: int = fixed.WINDOW_EVENTS,
    stride: int = fixed.WINDOW_STRIDE, **options,
) -> DataFrame:
    members = window_members(events, size, stride, **options)
    return aggregate_features(members, ["campaign_id", "window_id"], actions, size)


def event_features(members: DataFrame, actions: Sequence[str] = fixed.ACTIONS, size: int = fixed.WINDOW_EVENTS) -> DataFrame:
    """Per-event features inside a window: action one-hot (all 0 for an unknown action),
    log gap, scaled depth, artifact score and position."""
    return members.select(
        "campaign_id", "window_id", "pos",
        *[F.coalesce((F.col("action") == a).cast("double"), F.lit(0.0)).alias(f"is_{a}") for a in actions],
        F.log1p(F.greatest(F.lit(0.0), F.coalesce("dt", F.lit(0.0)))).alias("log_dt"),
        (F.col("depth") / 6.0).alias("depth_scaled"),
        F.col("artifact_ai").cast("double").alias("ai"),
        (F.col("pos") / F.lit(float(size))).alias("position"),
    )


def sequence_tensor(members: DataFrame, actions: Sequence[str] = fixed.ACTIONS, size: int = fixed.WINDOW_EVENTS) -> DataFrame:
    """One array of per-event feature arrays per window, in event order (at most `size` long)."""
    rows = event_features(members, actions, size)
    names = [c for c in rows.columns if c not in ("campaign_id", "window_id", "pos")]
    packed = F.array_sort(F.collect_list(F.struct("pos", F.array(*names).alias("x"))))
    return (
        rows.groupBy("campaign_id", "window_id")
        .agg(packed.alias("__s"))
        .select("campaign_id", "window_id", F.transform("__s", lambda s: s["x"]).alias("seq"))
        .filter(complete(F.size("seq"), F.col("window_id"), size))
    )


def modal(members: DataFrame, keys: Sequence[str], value: str, name: str, skip_blank: bool = True) -> DataFrame:
    """Most frequent value per key, ties to the smallest; counted in two steps so that a
    hot key is combined before the shuffle."""
    kept = members.filter(F.col(value).isNotNull() & (F.col(value) != "")) if skip_blank else members
    counts = kept.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("__n"))
    return counts.groupBy(*keys).agg(F.min_by(value, F.struct(-F.col("__n"), F.col(value))).alias(name))


def window_tactic(members: DataFrame, size: int = fixed.WINDOW_EVENTS) -> DataFrame:
    """Modal non-empty tactic of each window, '' where it has none."""
    keys = ["campaign_id", "window_id"]
    all_windows = members.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_events")).filter(
        complete(F.col("n_events"), F.col("window_id"), size)
    )
    named = modal(members, keys, "tactic", "tactic")
    return all_windows.join(named, keys, "left").select(*keys, F.coalesce("tactic", F.lit("")).alias("tactic"))


def window_eid_mix(members: DataFrame, size: int = fixed.WINDOW_EVENTS) -> DataFrame:
    """Dominant event id of each window (ties to the lowest), its share, and how many ids occur."""
    keys = ["campaign_id", "window_id"]
    counts = members.groupBy(*keys, "eid").agg(F.count(F.lit(1)).alias("__n"))
    mix = counts.groupBy(*keys).agg(
        F.sum("__n").alias("n_events"),
        F.min_by("eid", F.struct(-F.col("__n"), F.col("eid"))).alias("dominant_eid"),
        F.max("__n").alias("__top"),
        F.count_if(F.col("eid") != -1).alias("n_distinct_eids"),
    )
    return mix.filter(complete(F.col("n_events"), F.col("window_id"), size)).select(
        *keys, "dominant_eid", (F.col("__top") / F.col("n_events")).alias("share_dominant"), "n_distinct_eids"
    )


def window_multihot(members: DataFrame, labels: Sequence[str] = fixed.TACTICS, size: int = fixed.WINDOW_EVENTS) -> DataFrame:
    """Which tactics occur among the attack events of each window."""
    hit = [
        F.max(F.when((F.col("label") == 1) & (F.col("tactic") == t), 1).otherwise(0)).alias(f"has_{t}") for t in labels
    ]
    return (
        members.groupBy("campaign_id", "window_id")
        .agg(F.count(F.lit(1)).alias("n_events"), *hit)
        .filter(complete(F.col("n_events"), F.col("window_id"), size))
        .drop("n_events")
    )


def promote_labels(events: DataFrame, key: str = "campaign_id") -> DataFrame:
    """Give every event the label of its campaign (attack if any event is); events without a campaign count as one."""
    rows = events.withColumn("__g", group_key([key]))
    top = rows.groupBy("__g").agg(F.max("label").cast("int").alias("__label"))
    return rows.join(top, "__g").withColumn("label", F.col("__label")).drop("__label").select(*events.columns)


def secs_per_window(windows: DataFrame, size: int = fixed.WINDOW_EVENTS) -> DataFrame:
    """One row: seconds a window stands for, from the median gap of benign windows, then
    of all windows, then 1 second; never below 1."""
    both = windows.select("dt_median", "label").withColumn("who", F.explode(F.array(F.lit("all"), F.lit("benign"))))
    kept = both.filter((F.col("who") == "all") | (F.col("label") == 0))
    medians = exact_percentiles(kept, "dt_median", [0.5], ["who"])
    one = medians.agg(
        F.max(F.when(F.col("who") == "benign", F.col("value"))).alias("benign"),
        F.max(F.when(F.col("who") == "all", F.col("value"))).alias("overall"),
    )
    positive = lambda c: F.when(c > 0, c)
    gap = F.coalesce(positive(F.col("benign")), positive(F.col("overall")), F.lit(1.0))
    return one.select(F.greatest(F.lit(1.0), gap * float(size)).alias("secs_per_window"))


def bigram_shares(members: DataFrame, actions: Sequence[str] = fixed.ACTIONS, size: int = fixed.WINDOW_EVENTS) -> DataFrame:
    """Share of each ordered action pair among the consecutive pairs of a window: the
    order signal that the averages of `window_features` cannot see."""
    keys = ["campaign_id", "window_id"]
    order = Window.partitionBy(*keys).orderBy("pos")
    pairs = members.withColumn("__before", F.lag("action").over(order))
    typed = F.greatest(F.count("__before"), F.lit(1))
    shares = [
        (F.count_if((F.col("__before") == a) & (F.col("action") == b)) / typed).alias(f"seq_{a}_{b}")
        for a in actions for b in actions
    ]
    return (
        pairs.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("n_events"), *shares)
        .filter(complete(F.col("n_events"), F.col("window_id"), size))
        .drop("n_events")
    )


def bigram_columns(actions: Sequence[str] = fixed.ACTIONS) -> list[str]:
    return [f"seq_{a}_{b}" for a in actions for b in actions]

