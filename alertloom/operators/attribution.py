"""What each event id contributes: the events are windowed and scored again without it, but only in the campaigns where it
occurs; everywhere else the full windows stand."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alertloom import fixed
from alertloom.operators.scans import attach_row, group_key
from alertloom.operators.windows import aggregate_features, window_members

FULL = -2


def event_ids(events: DataFrame) -> DataFrame:
    """(campaign_id, dropped_eid): the readable event ids that occur, by campaign."""
    known = F.col("eid").isNotNull() & (F.col("eid") != -1)
    return events.filter(known).select("campaign_id", F.col("eid").cast("int").alias("dropped_eid")).distinct()


def dropout_windows(events: DataFrame, actions: Sequence[str] = fixed.ACTIONS, **options) -> DataFrame:
    """Window features of the full events (`dropped_eid` = FULL), and of a campaign's events without an id that occurs in it.
    A copy's label is the campaign's label among its surviving events."""
    rows = events.withColumn("__g", group_key(["campaign_id"]))
    pairs = event_ids(events).select(group_key(["campaign_id"]).alias("__g"), "dropped_eid")
    copies = rows.join(pairs, "__g").filter(F.col("eid").isNull() | (F.col("eid") != F.col("dropped_eid")))
    keyed = rows.withColumn("dropped_eid", F.lit(FULL)).unionByName(copies).drop("__g")
    keyed = keyed.withColumn("copy_id", F.concat_ws("|", F.col("dropped_eid"), F.col("campaign_id")))
    members = window_members(keyed, key="copy_id", **options)
    return aggregate_features(members, ["dropped_eid", "campaign_id", "window_id"], actions)


def _rates(events: DataFrame, scored: DataFrame, tau: float) -> DataFrame:
    """Per event id: n and rate of the windows without it, and those of the full events. An id's total is the full total,
    with the campaigns it occurs in exchanged for their copies."""
    own = scored.groupBy("dropped_eid", group_key(["campaign_id"]).alias("__g")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("score") >= tau).alias("hits"))
    pairs = event_ids(events).select("dropped_eid", group_key(["campaign_id"]).alias("__g"))
    full = own.filter(F.col("dropped_eid") == FULL).select("__g", F.col("n").alias("full_n"), F.col("hits").alias("full_hits"))
    both = pairs.join(own, ["dropped_eid", "__g"], "left").join(full, "__g", "left")
    change = lambda c: F.sum(F.coalesce(c, F.lit(0)) - F.coalesce(f"full_{c}", F.lit(0))).alias(f"more_{c}")
    totals = full.agg(F.coalesce(F.sum("full_n"), F.lit(0)).alias("n_full"), F.coalesce(F.sum("full_hits"), F.lit(0)).alias("hits_full"))
    per = attach_row(both.groupBy("dropped_eid").agg(change("n"), change("hits")), totals)
    n, hits = F.col("n_full") + F.col("more_n"), F.col("hits_full") + F.col("more_hits")
    return per.select(F.col("dropped_eid").alias("eid"), n.alias("n"), F.try_divide(hits, n).alias("rate"), "n_full", F.try_divide("hits_full", "n_full").alias("full"))


def _contributions(events: DataFrame, per: DataFrame, rate: str, contribution: str, count: str, empty: str) -> DataFrame:
    known = F.col("eid").isNotNull() & (F.col("eid") != -1)
    counted = events.groupBy(F.col("eid").cast("int").alias("eid")).agg(F.count(F.lit(1)).alias("n_events_dropped"))
    total = counted.agg(F.coalesce(F.sum("n_events_dropped"), F.lit(0)).alias("__all"))
    rows = attach_row(counted.filter(known), total).join(per, "eid")
    return rows.select(
        "eid", "n_events_dropped", (F.col("n_events_dropped") / F.greatest("__all", F.lit(1))).alias("share_events"),
        F.col("full").alias(rate.replace("_dropout", "_full")), F.col("n_full").alias("n_windows_full"), F.col("n").alias(count), F.col("rate").alias(rate),
        (F.col("full") - F.col("rate")).alias(contribution), F.when(F.col("rate").isNull(), F.lit(empty)).alias("note"),
    )


def eid_dropout_fp(events: DataFrame, score: Callable[[DataFrame], DataFrame], tau: float, actions: Sequence[str] = fixed.ACTIONS, **options) -> DataFrame:
    """Per event id of benign campaigns: false-alarm rate without it, and what it adds."""
    scored = score(dropout_windows(events.withColumn("label", F.lit(0)), actions, **options))
    return _contributions(events, _rates(events, scored, tau), "fp_rate_dropout", "contribution_to_fp_rate", "n_windows_dropout", "no windows after dropout")


def eid_dropout_detect(events: DataFrame, score: Callable[[DataFrame], DataFrame], tau: float, actions: Sequence[str] = fixed.ACTIONS, **options) -> DataFrame:
    """Per event id of attack campaigns: detection rate without it, and what it adds. Labels
    are the events' own, promoted to the campaign after each dropout."""
    windows = dropout_windows(events, actions, **options).withColumn("__g", group_key(["campaign_id"]))
    top = windows.groupBy("dropped_eid", "__g").agg(F.max("label").alias("__l"))
    attack = windows.join(top.filter(F.col("__l") == 1), ["dropped_eid", "__g"], "left_semi").drop("__g")
    return _contributions(events, _rates(events, score(attack), tau), "detect_rate_dropout", "contribution_to_detect_rate", "n_attack_windows_dropout", "no attack windows survived")
