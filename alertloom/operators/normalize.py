"""From source tables to the normalized event schema."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from alertloom import fixed
from alertloom.functions import columns as C
from alertloom.operators.graph import process_depth
from alertloom.operators.scans import rank_in_key

REQUIRED = ["campaign_id", "ts", "action", "target", "label"]


def adapt_generic(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """Rename source columns, check the required ones, fill depth and artifact_ai."""
    out = df.withColumnsRenamed(mapping)
    missing = [c for c in REQUIRED if c not in out.columns]
    if missing:
        raise ValueError(f"columns still missing after the mapping: {missing}")
    defaults = {"depth": F.lit(0), "artifact_ai": F.lit(0.0)}
    return out.withColumns({c: v for c, v in defaults.items() if c not in out.columns})


def with_delta(
    events: DataFrame, key: str = "campaign_id", ts: str = "ts", ties: Sequence[str] = ("event_id",),
    first: float | None = 0.0,
) -> DataFrame:
    """Seconds since the event before in the same key; `first` (0 or null) for the first one."""
    ranked = rank_in_key(events, key, ts, list(ties))
    gap = F.col(ts) - F.col("prev_ts")
    return ranked.withColumn("delta_s", gap if first is None else F.coalesce(gap, F.lit(first))).drop("rn", "prev_ts")


def label_by_guid(events: DataFrame, guids: DataFrame, guid: str = "guid") -> DataFrame:
    """Label 1 for events of the listed processes, else 0. Events without a process id
    cannot match and stay out of the join key's way."""
    listed = guids.select(F.col("guid").alias("__g")).distinct().withColumn("__hit", F.lit(1))
    key = C.blank_to_null(F.col(guid))
    joined = events.join(listed, key == F.col("__g"), "left")
    return joined.withColumn("label", F.coalesce("__hit", F.lit(0))).drop("__g", "__hit")


def adapt_winlog(
    df: DataFrame, guids: DataFrame | None = None, event_key: str = "event_key",
    use_label_column: bool = True, keep: Sequence[str] = (),
) -> DataFrame:
    """Windows event log table -> normalized events.

    `event_key` names a column that tells events apart; it is carried through so that
    later steps can join by it. An explicit label column beats `guids`, which beats 0.
    Rows without a readable time are dropped."""
    ts, eid = C.pick(df, fixed.TS_FIELDS), C.pick(df, fixed.EVENTID_FIELDS)
    if ts is None or eid is None:
        raise ValueError("no timestamp or event id column found")
    name = {
        "host": C.pick(df, fixed.HOST_FIELDS), "channel": C.pick(df, fixed.CHANNEL_FIELDS),
        "guid": C.pick(df, fixed.PGUID_FIELDS), "parent": C.pick(df, fixed.PPGUID_FIELDS),
        "campaign": C.pick(df, fixed.CAMPAIGN_FIELDS), "label": C.pick(df, fixed.LABEL_FIELDS),
        "technique": C.pick(df, fixed.TECHNIQUE_FIELDS),
    }
    column = lambda k, default: C.quoted(name[k]).cast("string") if name[k] else F.lit(default)
    host = column("host", "host")
    base = df.select(
        F.col(event_key).alias("event_key"),
        (column("campaign", "") if name["campaign"] else host).alias("campaign_id"),
        C.to_unix(df, ts).alias("ts"),
        C.action_of(column("channel", "sysmon"), C.quoted(eid)).alias("action"),
        C.target_of(df, host).alias("target"),
        F.lit(0.0).alias("artifact_ai"),
        *([C.quoted(name["label"]).cast("int").alias("__label")] if name["label"] else []),
        F.coalesce(column("technique", ""), F.lit("")).alias("technique"),
        C.event_id_number(C.quoted(eid)).alias("eid"),
        host.alias("host"),
        F.coalesce(column("guid", ""), F.lit("")).alias("guid"),
        F.coalesce(column("parent", ""), F.lit("")).alias("parent_guid"),
        *[C.quoted(k) for k in keep],
    )
    base = base.filter(F.col("ts").isNotNull()).withColumn("tactic", C.tactic_of(F.col("technique")))
    if name["label"] and use_label_column:
        labelled = base.withColumn("label", F.col("__label"))
    elif guids is not None:
        labelled = label_by_guid(base, guids)
    else:
        labelled = base.withColumn("label", F.lit(0))
    depth = process_depth(base.select("guid", "parent_guid", "ts", F.col("event_key").alias("event_id")))
    out = labelled.join(depth, "guid", "left").withColumn("depth", F.coalesce("depth", F.lit(0)))
    first = ["event_key", "campaign_id", "ts", "action", "target", "depth", "artifact_ai", "label", "technique", "tactic"]
    return out.select(*first, "eid", "host", "guid", "parent_guid", *keep)


def normalize_campaign(df: DataFrame, campaign_id: str, guids: DataFrame | None = None, **options) -> DataFrame:
    """The same adapter with one campaign id for the whole operation."""
    return adapt_winlog(df, guids, **options).withColumn("campaign_id", F.lit(campaign_id))


def drop_eid(events: DataFrame, eid: int) -> DataFrame:
    """Leave out one event id; events whose id could not be read always stay."""
    return events.filter(F.col("eid").isNull() | (F.col("eid") != eid))


def dropout_copies(events: DataFrame, eids: Sequence[int]) -> DataFrame:
    """One copy of the events per left-out id (`dropped_eid`). The ids come from a fixed
    collector vocabulary, so the growth factor is bounded by its size."""
    return events.withColumn("dropped_eid", F.explode(F.array(*[F.lit(int(e)) for e in eids]))).filter(
        F.col("eid").isNull() | (F.col("eid") != F.col("dropped_eid"))
    )


def trailing(df: DataFrame, now: float, window_s: float, ts: str = "ts") -> DataFrame:
    """Rows of the last `window_s` seconds before `now`."""
    return df.filter(F.col(ts) >= F.lit(float(now) - float(window_s)))


def carry_labels(filtered: DataFrame, labelled: DataFrame, key: str = "event_key") -> DataFrame:
    """Give the rows of a filtered pass the labels of the first pass, joined by event key,
    then promote them to the campaign."""
    from alertloom.operators.windows import promote_labels

    labels = labelled.groupBy(key).agg(F.max("label").alias("__l"))
    joined = filtered.join(labels, key, "left").withColumn("label", F.coalesce("__l", F.lit(0))).drop("__l")
    return promote_labels(joined)


def stack(*frames: DataFrame) -> DataFrame:
    """Rows of all frames, matched by column name."""
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame, allowMissingColumns=True)
    return out
