"""From scores to decisions: precision-recall, thresholds under an alert budget, sweeps."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from alertloom import fixed
from alertloom.operators.scans import attach_row, exact_percentiles, prefix_sum

F1_GRID = [float(x) for x in np.linspace(0.05, 0.95, 19)]
SWEEP_GRID = [round(0.05 * i, 2) for i in range(1, 20)]


def score_table(df: DataFrame, y: str, score: str, by: Sequence[str] = ()) -> DataFrame:
    """Positives and negatives per distinct score; combined before the shuffle."""
    return df.groupBy(*by, score).agg(
        F.count_if(F.col(y) == 1).alias("pos"), F.count_if(F.col(y) == 0).alias("neg")
    )


def running_counts(df: DataFrame, y: str, score: str, by: Sequence[str] = ()) -> DataFrame:
    """tp and fp when alerting at each distinct score or above."""
    return prefix_sum(score_table(df, y, score, by), score, {"tp": "pos", "fp": "neg"}, by, descending=True)


def average_precision(df: DataFrame, y: str = "y", score: str = "score", by: Sequence[str] = ()) -> DataFrame:
    """Step-wise average precision over distinct scores; null when only one class occurs."""
    run = running_counts(df, y, score, by)
    step = F.col("pos") * F.col("tp") / (F.col("tp") + F.col("fp"))
    sums = run.groupBy(*by).agg(F.sum(step).alias("s"), F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"))
    both = (F.col("n_pos") > 0) & (F.col("n_neg") > 0)
    return sums.select(*by, "n_pos", "n_neg", F.when(both, F.try_divide("s", "n_pos")).alias("pr_auc"))


def pr_curve(df: DataFrame, y: str = "y", score: str = "score", points: int = 20) -> DataFrame:
    """About `points` samples of the precision-recall curve, thresholds ascending, plus
    the closing point (1, 0) when the sampling step hits it."""
    table = score_table(df, y, score).withColumn("one", F.lit(1).cast("long"))
    run = prefix_sum(
        table, score, {"tp": "pos", "fp": "neg", "k": "one"}, descending=True, totals={"t": "k", "all_pos": "tp"}
    )
    step = F.greatest(F.lit(1), F.floor((F.col("t") + 1) / points))
    placed = run.select(
        (F.col("t") - F.col("k")).alias("idx"), F.col(score).alias("threshold"),
        (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"),
        F.when(F.col("all_pos") > 0, F.try_divide("tp", "all_pos")).otherwise(1.0).alias("recall"),
        step.alias("step"),
    )
    closing = run.agg(F.max("t").alias("t")).select(
        F.col("t").alias("idx"), F.lit(None).cast("double").alias("threshold"), F.lit(1.0).alias("precision"),
        F.lit(0.0).alias("recall"), step.alias("step"),
    )
    return placed.unionByName(closing).filter(F.col("idx") % F.col("step") == 0).drop("step")


def session_hours(df: DataFrame, duration: str = "duration_s") -> DataFrame:
    return df.agg((F.sum(F.greatest(F.col(duration), F.lit(0.0))) / 3600.0).alias("hours"))


def window_hours(windows: DataFrame, spw: DataFrame, benign_only: bool = False, label: str = "label") -> DataFrame:
    """Hours a set of windows stands for. The serving metrics count all windows; the
    alert-fatigue arithmetic counts the benign ones."""
    kept = windows.filter(F.col(label) == 0) if benign_only else windows
    n = kept.agg(F.count(F.lit(1)).alias("n_windows"))
    return attach_row(n, spw).select((F.col("n_windows") * F.col("secs_per_window") / 3600.0).alias("hours"))


def fp_hour(n_fp: Column, hours: Column) -> Column:
    return n_fp / F.greatest(hours, F.lit(1e-9))


def tau_for_budget(
    df: DataFrame, hours: DataFrame | float, budget: float, y: str = "y", score: str = "score"
) -> DataFrame:
    """The lowest score that keeps false alarms within budget x hours (1.0 when none does).
    Equal scores go in or out together, so applying `score >= threshold` stays in budget."""
    run = running_counts(df, y, score)
    if isinstance(hours, DataFrame):
        run = attach_row(run, hours)
    else:
        run = run.withColumn("hours", F.lit(float(hours)))
    fits = F.col("fp") <= F.greatest(F.lit(0.0), F.col("hours") * budget)
    picked = run.agg(
        F.min(F.when(fits, F.col(score))).alias("t"),
        F.max(F.when(fits, F.col("fp"))).alias("fp_in"),
        F.sum(F.when(F.col(score) >= 1.0, F.col("neg"))).alias("fp_top"),
        F.max("hours").alias("hours"),
    )
    n_fp = F.coalesce(F.when(F.col("t").isNotNull(), F.col("fp_in")).otherwise(F.col("fp_top")), F.lit(0))
    return picked.select(
        F.coalesce("t", F.lit(1.0)).alias("threshold"), n_fp.cast("long").alias("fp_count"),
        fp_hour(n_fp, F.col("hours")).alias("fp_per_hour"), "hours",
    )


def tau_for_budget_quantile(
    df: DataFrame, spw: DataFrame, budget: float, y: str = "y", score: str = "score", points: int = 201
) -> DataFrame:
    """The lowest of the score's quantile points whose estimated false alarms per hour
    fit the budget; the highest point and infinity when none does."""
    probs = [i / (points - 1) for i in range(points)]
    grid = exact_percentiles(df, score, probs).agg(F.array_sort(F.collect_set("value")).alias("grid"))
    table = score_table(df, y, score)
    below = F.size(F.filter("grid", lambda t: t <= F.col(score)))
    per_step = (
        attach_row(table, grid).withColumn("step", below).groupBy("step")
        .agg(F.sum("neg").alias("neg"), F.sum(F.col("pos") + F.col("neg")).alias("n"))
    )
    packed = per_step.agg(F.sum("n").alias("n"), F.collect_list(F.struct("step", "neg")).alias("steps"))
    one = attach_row(attach_row(packed, grid), spw)
    fp = lambda i: F.aggregate(
        F.filter("steps", lambda s: s["step"] > i), F.lit(0).cast("long"), lambda a, s: a + s["neg"]
    )
    points_ = one.select(
        F.posexplode("grid").alias("i", "threshold"), "steps", F.col("n"), "secs_per_window", F.element_at("grid", -1).alias("top")
    ).withColumn("fp", fp(F.col("i")))
    fph = F.col("fp") / (F.col("n") * F.col("secs_per_window") / 3600.0 + 1e-9)
    best = points_.withColumn("fph", fph).agg(
        F.min(F.when(F.col("fph") <= budget, F.struct("threshold", "fph"))).alias("b"), F.max("top").alias("top")
    )
    return best.select(
        F.coalesce("b.threshold", "top").alias("threshold"),
        F.coalesce("b.fph", F.lit(float("inf"))).alias("fp_per_hour"),
    )


def counts_on_grid(
    df: DataFrame, grid: Sequence[float], y: str = "y", score: str = "score", by: Sequence[str] = ()
) -> DataFrame:
    """tp, fp, n_pos, n_neg at every grid threshold, in one aggregation."""
    at = [
        F.struct(
            F.lit(float(t)).alias("tau"),
            F.count_if((F.col(score) >= t) & (F.col(y) == 1)).alias("tp"),
            F.count_if((F.col(score) >= t) & (F.col(y) == 0)).alias("fp"),
        )
        for t in grid
    ]
    totals = [F.count_if(F.col(y) == 1).alias("n_pos"), F.count_if(F.col(y) == 0).alias("n_neg")]
    wide = df.groupBy(*by).agg(F.array(*at).alias("g"), *totals)
    return wide.select(*by, "n_pos", "n_neg", F.explode("g").alias("g")).select(*by, "g.tau", "g.tp", "g.fp", "n_pos", "n_neg")


def precision_recall_f1(tp: Column, fp: Column, n_pos: Column) -> tuple[Column, Column, Column]:
    p = F.coalesce(F.try_divide(tp, tp + fp), F.lit(0.0))
    r = F.coalesce(F.try_divide(tp, n_pos), F.lit(0.0))
    return p, r, F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0))


def tau_best_f1(df: DataFrame, y: str = "y", score: str = "score", by: Sequence[str] = (), grid: Sequence[float] = F1_GRID) -> DataFrame:
    """Grid threshold with the highest F1, the lowest one on ties."""
    _, _, f1 = precision_recall_f1(F.col("tp"), F.col("fp"), F.col("n_pos"))
    rows = counts_on_grid(df, grid, y, score, by).withColumn("f1", f1)
    best = rows.groupBy(*by).agg(F.max(F.struct(F.col("f1"), -F.col("tau"))).alias("b"))
    return best.select(*by, (-F.col("b.col2")).alias("threshold"), F.col("b.f1").alias("f1"))


def prf(df: DataFrame, tau: float | Column, y: str = "y", score: str = "score", by: Sequence[str] = ()) -> DataFrame:
    """Confusion counts, precision, recall and F1 at a threshold; 0 where undefined."""
    hit = F.col(score) >= tau
    c = df.groupBy(*by).agg(
        F.count_if(hit & (F.col(y) == 1)).alias("tp"), F.count_if(hit & (F.col(y) == 0)).alias("fp"),
        F.count_if(~hit & (F.col(y) == 1)).alias("fn"), F.count_if(~hit & (F.col(y) == 0)).alias("tn"),
    )
    p, r, f1 = precision_recall_f1(F.col("tp"), F.col("fp"), F.col("tp") + F.col("fn"))
    return c.select("*", p.alias("precision"), r.alias("recall"), f1.alias("f1"))


def deployment_rows(df: DataFrame, deployments: Sequence[tuple] | DataFrame) -> DataFrame:
    """Every row once per deployment shape. Shapes are a short configuration list."""
    if isinstance(deployments, DataFrame):
        shapes = deployments.agg(
            F.collect_list(F.struct(F.col("name").alias("deployment"), "hosts", "events_per_sec_per_host")).alias("__d")
        )
        spread = attach_row(df, shapes).withColumn("__d", F.explode("__d"))
    else:
        items = [
            F.struct(F.lit(n).alias("deployment"), F.lit(int(h)).alias("hosts"), F.lit(float(r)).alias("events_per_sec_per_host"))
            for n, h, r in deployments
        ]
        spread = df.withColumn("__d", F.explode(F.array(*items)))
    return spread.select(*df.columns, "__d.*").withColumn(
        "windows_per_hour", F.col("hosts") * F.col("events_per_sec_per_host") * 3600.0 / fixed.WINDOW_STRIDE
    )


def sweep_tau(
    windows: DataFrame, deployments: Sequence[tuple] | DataFrame = fixed.DEPLOYMENTS,
    grid: Sequence[float] = SWEEP_GRID, y: str = "label", score: str = "score",
) -> DataFrame:
    """Detection rate, false-alarm rate and alarms per hour for every threshold and deployment."""
    c = counts_on_grid(windows, grid, y, score)
    rates = c.select(
        "tau", F.try_divide("tp", "n_pos").alias("detect_rate"), F.try_divide("fp", "n_neg").alias("fp_rate")
    )
    return deployment_rows(rates, deployments).withColumn("fp_per_hour", F.col("fp_rate") * F.col("windows_per_hour"))


def pareto(curve: DataFrame) -> DataFrame:
    """Per deployment: points no other point beats in both detection and alarms per hour.
    The curve has one row per grid threshold."""
    order = Window.partitionBy("deployment").orderBy(F.col("detect_rate").desc(), "fp_per_hour", "tau")
    best = F.min("fp_per_hour").over(order.rowsBetween(Window.unboundedPreceding, -1))
    kept = curve.filter(F.col("detect_rate").isNotNull() & F.col("fp_per_hour").isNotNull()).withColumn("__best", best)
    return kept.filter(F.col("__best").isNull() | (F.col("fp_per_hour") < F.col("__best"))).drop("__best")


def pick_composite(curve: DataFrame, weight: float = 100.0) -> DataFrame:
    """Per deployment: the threshold with the highest recall - weight x alarms per hour / 100."""
    worth = F.col("detect_rate") - F.col("fp_per_hour") * (weight / 100.0)
    rows = curve.withColumn("composite", worth).filter(F.col("composite").isNotNull())
    best = rows.groupBy("deployment").agg(F.max(F.struct(F.col("composite"), -F.col("tau"), F.col("detect_rate"), F.col("fp_per_hour"))).alias("b"))
    return best.select("deployment", (-F.col("b.col2")).alias("tau"), "b.composite", "b.detect_rate", "b.fp_per_hour")


def consecutive_flag(ticks: DataFrame, tau: float, k: int = 2) -> DataFrame:
    """First time `k` ticks in a row reach the threshold, as the seen share of the session
    times its duration. ticks: session_id, tick (1, 2, ...), seen, n_req, duration_s, score.
    Each tick votes for the k run ends it can belong to, so no session is one task."""
    hits = ticks.filter(F.col("score") >= tau)
    votes = hits.select("session_id", F.explode(F.sequence(F.col("tick"), F.col("tick") + (k - 1))).alias("tick"))
    runs = votes.groupBy("session_id", "tick").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") == k)
    first = runs.join(ticks, ["session_id", "tick"]).groupBy("session_id").agg(
        F.min_by(F.struct("seen", "n_req", "duration_s"), "tick").alias("t"), F.min("tick").alias("tick")
    )
    return first.select("session_id", "tick", (F.col("t.seen") / F.col("t.n_req") * F.col("t.duration_s")).alias("flag_after_s"))


def spend_cutoff(cells: DataFrame, cap: float | None, seq: str = "seq", cost: str = "cost_cents") -> DataFrame:
    """Which cells run while the running spend stays within the cap. The first cell over
    it, or one after the cap is used up, stops everything behind it. Unpriced cells cost 0."""
    if cap is None:
        return cells.withColumn("running_cents", F.lit(None).cast("double")).withColumn("runs", F.lit(True))
    priced = cells.withColumn("__c", F.coalesce(F.col(cost), F.lit(0.0))).withColumn("__one", F.lit(1).cast("long"))
    run = prefix_sum(priced, seq, {"running_cents": "__c", "__k": "__one"})
    within = (F.col("running_cents") <= cap) & ((F.col("running_cents") - F.col("__c") < cap) | (F.col("__k") == 1))
    return run.withColumn("runs", within).drop("__c", "__one", "__k")


def top_events(contributions: DataFrame, k: int = 3, weight: str = "weight") -> DataFrame:
    """The k heaviest events of each window, given in event order."""
    w = Window.partitionBy("campaign_id", "window_id").orderBy(F.col(weight).desc(), F.col("pos").desc())
    top = contributions.withColumn("__r", F.row_number().over(w)).filter(F.col("__r") <= k)
    order = Window.partitionBy("campaign_id", "window_id").orderBy("pos")
    return top.withColumn("span_pos", F.row_number().over(order)).drop("__r")


def top_windows(scored: DataFrame, n: int = 3, score: str = "score", label: str = "label") -> DataFrame:
    return scored.filter(F.col(label) == 1).orderBy(F.col(score).desc(), "campaign_id", "window_id").limit(n)


def first_alert(scored: DataFrame, events: DataFrame, tau: float | None = None) -> DataFrame:
    """Per campaign: first alert time, onset (first attack event, else first event) and the
    seconds between. scored: campaign_id, end_ts, score and, with no `tau`, threshold."""
    limit = F.col("threshold") if tau is None else F.lit(float(tau))
    alerts = scored.groupBy("campaign_id").agg(F.min(F.when(F.col("score") >= limit, F.col("end_ts"))).alias("alert_ts"))
    starts = events.groupBy("campaign_id").agg(
        F.max("label").cast("int").alias("is_attack"),
        F.coalesce(F.min(F.when(F.col("label") == 1, F.col("ts"))), F.min("ts")).alias("onset_ts"),
    )
    joined = starts.join(alerts, "campaign_id", "left")
    return joined.withColumn("detected", F.col("alert_ts").isNotNull()).withColumn("mttd_s", F.col("alert_ts") - F.col("onset_ts"))
