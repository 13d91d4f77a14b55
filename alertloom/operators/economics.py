"""Alert economics: false-alarm rates, alarms per hour per deployment, time to detect,
event-rate calibration, per-event-id cost and benefit."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from alertloom import fixed
from alertloom.functions import columns as C
from alertloom.operators.scans import attach_row
from alertloom.operators.thresholds import deployment_rows

STRIDE = fixed.WINDOW_STRIDE


def with_manifest(windows: DataFrame, manifest: DataFrame) -> DataFrame:
    """Windows with their campaign's class, framework, hard-negative kind and start."""
    m = manifest.select("campaign_id", "class", "framework", F.coalesce("benign_subtype", F.lit("")).alias("benign_subtype"), "ts_start")
    return windows.join(m, "campaign_id", "left").withColumn("class", F.coalesce("class", F.lit("unknown")))


def _group_name():
    normal = F.when(F.col("class") == "normal", F.lit("normal"))
    hard = F.when((F.col("class") == "hard_negative") & (F.col("benign_subtype") != ""), F.col("benign_subtype"))
    return F.coalesce(normal, hard)


def fp_rates(scored: DataFrame, tau: float, by: Sequence[str] = ()) -> DataFrame:
    """Share of flagged windows of normal campaigns and of each hard-negative kind."""
    kind = F.when(F.col("class") == "normal", "class").otherwise("subtype")
    rows = scored.withColumn("name", _group_name()).filter(F.col("name").isNotNull())
    return rows.groupBy(*by, kind.alias("kind"), "name").agg(
        F.count(F.lit(1)).alias("n_windows"), F.count_if(F.col("score") >= tau).alias("fp_windows"),
        (F.count_if(F.col("score") >= tau) / F.count(F.lit(1))).alias("fp_rate"),
    )


def fp_campaigns(scored: DataFrame) -> DataFrame:
    """The campaigns behind each hard-negative kind, one row each."""
    hard = scored.filter((F.col("class") == "hard_negative") & (F.col("benign_subtype") != ""))
    return hard.select("benign_subtype", "campaign_id").distinct()


def mttd_by_framework(scored: DataFrame, tau: float, window_s: float | DataFrame) -> DataFrame:
    """Per attack framework: campaigns, detected, and seconds to the first flagged window."""
    attack = scored.filter(F.col("class") == "attack")
    per = attack.groupBy("framework", "campaign_id").agg(F.min(F.when(F.col("score") >= tau, F.col("window_id"))).alias("first"))
    rows = per.groupBy("framework").agg(
        F.count(F.lit(1)).alias("n_campaigns"), F.count("first").alias("n_detected"),
        F.avg("first").alias("__mean"), F.percentile("first", 0.95).alias("__p95"),
    )
    rows = attach_row(rows, window_s) if isinstance(window_s, DataFrame) else rows.withColumn("window_s", F.lit(float(window_s)))
    return rows.select(
        "framework", "n_campaigns", "n_detected", (F.col("n_detected") / F.col("n_campaigns")).alias("detect_rate"),
        (F.col("__mean") * F.col("window_s")).alias("mttd_s"), (F.col("__p95") * F.col("window_s")).alias("mttd_s_p95"),
    )


def _rate_columns(scored: DataFrame, tau: float, subtypes: Sequence[str], by: Sequence[str]) -> DataFrame:
    name, hit = _group_name(), F.col("score") >= tau
    rate = lambda n: F.coalesce(F.try_divide(F.count_if((name == n) & hit), F.count_if(name == n)), F.lit(0.0))
    return scored.groupBy(*by).agg(rate("normal").alias("normal_rate"), *[rate(s).alias(f"rate_{s}") for s in subtypes])


def fp_breakdown(
    scored: DataFrame, tau: float, deployments: Sequence[tuple] | DataFrame = fixed.DEPLOYMENTS,
    bursts: Sequence[tuple] = fixed.BURST_SHAPES, by: Sequence[str] = (),
) -> DataFrame:
    """Alarms per hour from each hard-negative kind and deployment; kinds without any
    flagged window are left out."""
    rates = deployment_rows(_rate_columns(scored, tau, [b[0] for b in bursts], by), deployments)
    items = [
        F.struct(
            F.lit(name).alias("benign_subtype"), F.col(f"rate_{name}").alias("fp_rate"),
            F.lit(max(1.0, seconds * rate / STRIDE)).alias("windows_per_burst"),
            (F.lit(float(per_day)) * F.col("hosts") / 24.0).alias("bursts_per_hour"),
        )
        for name, per_day, seconds, rate in bursts
    ]
    flat = rates.select(*by, "deployment", F.explode(F.array(*items)).alias("b")).select(*by, "deployment", "b.*").filter(F.col("fp_rate") > 0)
    return flat.withColumn("fp_per_hour", F.col("fp_rate") * F.col("windows_per_burst") * F.col("bursts_per_hour"))


def fp_per_hour(
    scored: DataFrame, tau: float, deployments: Sequence[tuple] | DataFrame = fixed.DEPLOYMENTS,
    bursts: Sequence[tuple] = fixed.BURST_SHAPES, by: Sequence[str] = (),
) -> DataFrame:
    """Expected alarms per hour per deployment: steady traffic plus hard-negative bursts."""
    rates = deployment_rows(_rate_columns(scored, tau, [b[0] for b in bursts], by), deployments)
    hard = F.lit(0.0)
    for name, per_day, seconds, rate in bursts:
        hard = hard + F.col(f"rate_{name}") * max(1.0, seconds * rate / STRIDE) * (F.lit(float(per_day)) * F.col("hosts") / 24.0)
    return rates.select(
        *by, "deployment", "hosts", "events_per_sec_per_host", "windows_per_hour",
        (F.col("normal_rate") * F.col("windows_per_hour")).alias("normal_fp_per_hour"), hard.alias("hard_negative_fp_per_hour"),
    ).withColumn("total_fp_per_hour", F.col("normal_fp_per_hour") + F.col("hard_negative_fp_per_hour"))


def daily_fp(scored: DataFrame, tau: float, deployments=fixed.DEPLOYMENTS, bursts=fixed.BURST_SHAPES) -> DataFrame:
    """The same estimate per UTC day of the campaign start, at one fixed threshold."""
    return fp_per_hour(scored.withColumn("day", C.utc_day(F.col("ts_start"))), tau, deployments, bursts, ["day"])


def daily_distribution(daily: DataFrame) -> DataFrame:
    """Spread of the daily totals per deployment."""
    total = "total_fp_per_hour"
    return daily.groupBy("deployment").agg(
        F.count(F.lit(1)).alias("n_days"), F.median(total).alias("median_total"), F.percentile(total, 0.95).alias("p95_total"),
        F.min(total).alias("min_total"), F.max(total).alias("max_total"),
    )


def calibrate_rates(events: DataFrame, bucket_s: float = 60.0) -> DataFrame:
    """One row: hosts, span, overall event rate per host and the spread of bucket rates.
    Empty buckets count as zero through their frequency; the last bucket is closed on the
    right and the partial tail is left out. events: ts, host."""
    usable = events.filter((F.col("ts") > 0) & ~F.isnan("ts"))
    stats = usable.agg(
        F.count(F.lit(1)).alias("n_events"), F.greatest(F.count_distinct("host"), F.lit(1)).alias("n_hosts"),
        F.min("ts").alias("__t0"), (F.max("ts") - F.min("ts")).alias("span_s"),
    ).withColumn("n_buckets", F.greatest(F.lit(1), F.floor(F.col("span_s") / bucket_s)).cast("long"))
    slot = F.floor((F.col("ts") - F.col("__t0")) / bucket_s)
    placed = attach_row(usable.select("ts"), stats).withColumn(
        "__b", F.when(slot < F.col("n_buckets"), slot).when(F.col("ts") == F.col("__t0") + F.col("n_buckets") * bucket_s, F.col("n_buckets") - 1)
    )
    counts = placed.filter(F.col("__b").isNotNull()).groupBy("__b").agg(F.count(F.lit(1)).alias("c")).withColumn("f", F.lit(1).cast("long"))
    filled = counts.agg(F.count(F.lit(1)).alias("__k"))
    gaps = attach_row(stats, filled).select(F.lit(None).cast("long").alias("__b"), F.lit(0).cast("long").alias("c"), (F.col("n_buckets") - F.col("__k")).alias("f"))
    spread = counts.unionByName(gaps.filter(F.col("f") > 0)).agg(
        F.percentile("c", 0.5, F.col("f")).alias("p50"), F.percentile("c", 0.95, F.col("f")).alias("p95"), F.max("c").alias("top"), F.sum("c").alias("inside"),
    )
    one = attach_row(stats, spread)
    short = F.col("span_s") < bucket_s
    single = F.col("n_events") / F.greatest(F.col("span_s"), F.lit(1.0)) / F.col("n_hosts")
    rate = lambda c: F.when(short, single).otherwise(c / bucket_s / F.col("n_hosts"))
    return one.select(
        "n_events", "n_hosts", "span_s", single.alias("overall"),
        rate(F.col("inside") / F.col("n_buckets")).alias("bucket_mean"), rate(F.col("p50")).alias("bucket_p50"),
        rate(F.col("p95")).alias("bucket_p95"), rate(F.col("top")).alias("bucket_max"), "n_buckets",
    )


def eid_rates(events: DataFrame) -> DataFrame:
    """Count, rate per host and share of each readable event id. events: ts, host, eid."""
    usable = events.filter(F.col("ts") > 0)
    stats = usable.agg(
        F.count(F.lit(1)).alias("__n"), F.greatest(F.count_distinct("host"), F.lit(1)).alias("__h"), (F.max("ts") - F.min("ts")).alias("__span")
    )
    per = usable.filter(F.col("eid").isNotNull() & (F.col("eid") != -1)).groupBy("eid").agg(F.count(F.lit(1)).alias("count"))
    return attach_row(per, stats).filter(F.col("__span") > 0).select(
        "eid", "count", (F.col("count") / F.col("__span") / F.col("__h")).alias("events_per_sec_per_host"), (F.col("count") / F.col("__n")).alias("share")
    )


def suggest_deployments(calibration: DataFrame, hosts: Sequence[int]) -> DataFrame:
    """Deployment shapes at the measured mean rate, plus one at the busy-bucket rate."""
    size = lambda h: "small_office" if h <= 25 else "med_business" if h <= 100 else "large_business"
    item = lambda name, h, rate, source: F.struct(
        F.lit(name).alias("name"), F.lit(int(h)).alias("hosts"), F.round(rate, 4).alias("events_per_sec_per_host"), F.lit(source).alias("source")
    )
    steady = [item(f"calibrated_{size(h)}_{h}h", h, F.col("overall"), "calibrated_overall_mean") for h in hosts]
    top = max(hosts)
    burst = F.when(F.col("bucket_p95") > 0, item(f"calibrated_burst_p95_{top}h", top, F.col("bucket_p95"), "calibrated_minute_bucket_p95"))
    rows = calibration.select(F.explode(F.filter(F.array(*steady, burst), lambda d: d.isNotNull())).alias("d"))
    return rows.select("d.*")


def fp_by_dominant_eid(mix: DataFrame, scored: DataFrame, tau: float) -> DataFrame:
    """Windows grouped by their dominant event id: flagged share and mean dominance."""
    joined = mix.join(scored.select("campaign_id", "window_id", "score"), ["campaign_id", "window_id"])
    return joined.groupBy("dominant_eid").agg(
        F.count(F.lit(1)).alias("n_windows"), F.count_if(F.col("score") >= tau).alias("n_flagged"),
        (F.count_if(F.col("score") >= tau) / F.count(F.lit(1))).alias("fp_rate"), F.avg("share_dominant").alias("mean_share_dominant"),
    )


def eid_contributions(benign: DataFrame, deployments: Sequence[tuple] | DataFrame = fixed.DEPLOYMENTS) -> DataFrame:
    """Alarms per hour each event id adds in each deployment.
    benign: eid, share_events, contribution_to_fp_rate (null rows are left out)."""
    rows = benign.filter(F.col("contribution_to_fp_rate").isNotNull()).select("eid", "share_events", "contribution_to_fp_rate")
    spread = deployment_rows(rows, deployments)
    return spread.select("deployment", "eid", "share_events", "contribution_to_fp_rate", (F.col("contribution_to_fp_rate") * F.col("windows_per_hour")).alias("fp_per_hour"))


def join_attribution(benign: DataFrame, attack: DataFrame) -> DataFrame:
    """Event ids measured on both sides, with both contributions."""
    b = benign.filter(F.col("contribution_to_fp_rate").isNotNull()).select("eid", F.col("share_events").alias("share_events_benign"), "contribution_to_fp_rate")
    a = attack.filter(F.col("contribution_to_detect_rate").isNotNull()).select("eid", F.col("share_events").alias("share_events_attack"), "contribution_to_detect_rate")
    return b.join(a, "eid")


def eid_cost_benefit(
    benign: DataFrame, attack: DataFrame, deployments: Sequence[tuple] | DataFrame = fixed.DEPLOYMENTS, recall_weight: float = 100.0
) -> DataFrame:
    """Alarms saved minus weighted recall lost when an event id is no longer collected."""
    spread = deployment_rows(join_attribution(benign, attack), deployments)
    saved, lost = F.col("contribution_to_fp_rate") * F.col("windows_per_hour"), F.col("contribution_to_detect_rate")
    return spread.select(
        "deployment", "eid", "share_events_benign", "share_events_attack", saved.alias("fp_per_hour_saved"),
        lost.alias("recall_lost"), (saved - recall_weight * lost).alias("ranking_score"),
    )


def rank_by_abs(df: DataFrame, column: str, tie: str = "eid") -> DataFrame:
    return df.orderBy(F.abs(F.col(column)).desc(), tie)


def exclusion_catalog(spark: SparkSession) -> DataFrame:
    """The fixed exclusion rules, one row per predicate; an id without predicates is dropped whole."""
    rows = [
        (eid, group, field, condition, value)
        for eid, group, predicates in fixed.EXCLUSION_CATALOG
        for field, condition, value in (predicates or [(None, None, None)])
    ]
    return spark.createDataFrame(rows, "eid int, rule_group string, field string, condition string, value string")


def filter_candidates(ranked: DataFrame, n: int = 5, score: str = "ranking_score") -> DataFrame:
    """The n best event ids with a positive score, per deployment when there is one."""
    keys = ["deployment"] if "deployment" in ranked.columns else []
    from pyspark.sql import Window

    w = Window.partitionBy(*keys).orderBy(F.col(score).desc(), "eid")
    return ranked.filter(F.col(score) > 0).withColumn("place", F.row_number().over(w)).filter(F.col("place") <= n)


def exclusion_rules(candidates: DataFrame) -> DataFrame:
    """Candidates with their rule predicates; `skipped` marks ids that have no template."""
    rules = exclusion_catalog(candidates.sparkSession)
    return candidates.join(F.broadcast(rules), "eid", "left").withColumn("skipped", F.col("rule_group").isNull())


def top_share(per_eid: DataFrame, n: int = 8) -> DataFrame:
    return per_eid.orderBy(F.col("share").desc(), "eid").limit(n)
