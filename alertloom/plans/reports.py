"""Whole reports made of the operators: alert fatigue, benchmark evaluation, release,
serving. Intermediate tables that several parts read are written once."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alertloom import fixed
from alertloom.operators import attribution, economics, governance, models, slices, splits, thresholds, web
from alertloom.operators.scans import attach_row, exact_percentiles
from alertloom.operators.windows import aggregate_features, bigram_shares, secs_per_window, window_members, window_tactic
from alertloom.session import cut_lineage


def labelled_windows(events: DataFrame, manifest: DataFrame, actions: Sequence[str] = fixed.ACTIONS, **options) -> DataFrame:
    """Window features with campaign label, modal tactic and manifest columns."""
    members = window_members(events, **options)
    features = aggregate_features(members, ["campaign_id", "window_id"], actions)
    named = features.join(window_tactic(members), ["campaign_id", "window_id"])
    return economics.with_manifest(promote_windows(named, events), manifest)


def promote_windows(windows: DataFrame, events: DataFrame) -> DataFrame:
    """Give every window the label of its campaign. Windows are far fewer than events, so
    the label is joined here and not to the events."""
    top = events.groupBy("campaign_id").agg(F.max("label").cast("int").alias("__label"))
    return windows.join(top, "campaign_id").withColumn("label", F.col("__label")).drop("__label")


def benign_gap(train: DataFrame) -> DataFrame:
    """One row: median window gap of the benign train windows, 1 second when there is none."""
    gap = exact_percentiles(train.filter(F.col("label") == 0), "dt_median", [0.5]).agg(F.max("value").alias("g"))
    return gap.select(F.coalesce(F.when(F.col("g") != 0, F.col("g")), F.lit(1.0)).alias("benign_dt_median"))


def alert_fatigue(
    events: DataFrame, manifest: DataFrame, budget: float = 1.0, actions: Sequence[str] = fixed.ACTIONS,
    deployments: Sequence[tuple] | DataFrame = fixed.DEPLOYMENTS, bursts: Sequence[tuple] = fixed.BURST_SHAPES,
    frac: float = 0.75, seed: int = 0, fit: Callable[[DataFrame], models.Scorer] | None = None,
    attribute: bool = False, recall_weight: float = 100.0, **options,
) -> dict[str, DataFrame]:
    """Train on a stratified part of the campaigns, pick the threshold that keeps false
    alarms in budget on the rest, and report what that means for each deployment.
    With `attribute`, also what each event id costs and brings."""
    fit = fit or (lambda train: models.fit_gbt(train, models.aggregate_columns(actions), seed=seed))
    windows = cut_lineage(labelled_windows(events, manifest, actions, **options))
    present = manifest.join(windows.select("campaign_id").distinct(), "campaign_id", "left_semi")
    folds = cut_lineage(splits.stratified_split(present, frac, seed).select("campaign_id", "fold"))
    placed = windows.join(folds, "campaign_id")
    train, held = placed.filter(F.col("fold") == "train").drop("fold"), placed.filter(F.col("fold") == "eval").drop("fold")
    if held.isEmpty():
        held = train
    if models.single_class(train, "label"):
        raise ValueError("the train part has a single class: at least one attack and one benign campaign are needed")
    scorer = fit(train)
    scored = cut_lineage(scorer.score(held))
    gap = cut_lineage(benign_gap(train))
    spw = gap.select(F.greatest(F.lit(1.0), F.col("benign_dt_median") * fixed.WINDOW_EVENTS).alias("secs_per_window"))
    picked = thresholds.tau_for_budget(scored, thresholds.window_hours(scored, spw, benign_only=True), budget, "label")
    summary = cut_lineage(attach_row(picked, gap).withColumn("window_seconds", F.col("benign_dt_median") * fixed.WINDOW_EVENTS))
    top = summary.first()
    tau, window_s = float(top["threshold"]), float(top["window_seconds"])
    daily = economics.daily_fp(scored, tau, deployments, bursts)
    report = {
        "summary": summary,
        "folds": folds,
        "scored": scored,
        "fp_rates": economics.fp_rates(scored, tau),
        "fp_campaigns": economics.fp_campaigns(scored),
        "time_to_detect": economics.mttd_by_framework(scored, tau, window_s),
        "recall_by_tactic": slices.recall_by_tactic(scored, tau),
        "deployments": economics.fp_per_hour(scored, tau, deployments, bursts),
        "breakdown": economics.fp_breakdown(scored, tau, deployments, bursts),
        "daily": daily,
        "daily_distribution": economics.daily_distribution(daily),
        "sweep": thresholds.sweep_tau(scored, deployments),
    }
    if attribute:
        of_class = lambda names: events.join(manifest.filter(F.col("class").isin(names)).select("campaign_id"), "campaign_id", "left_semi")
        benign = cut_lineage(attribution.eid_dropout_fp(of_class(["normal"]), scorer.score, tau, actions, **options))
        attack = cut_lineage(attribution.eid_dropout_detect(of_class(["attack"]), scorer.score, tau, actions, **options))
        report["eid_benign"], report["eid_attack"] = benign, attack
        report["eid_contributions"] = economics.eid_contributions(benign, deployments)
        report["eid_cost_benefit"] = economics.eid_cost_benefit(benign, attack, deployments, recall_weight)
    return report


def evaluate_scores(
    truth: DataFrame, scores: DataFrame, split_table: DataFrame, mode: str = "public_test", budget: float = 1.0
) -> dict[str, DataFrame]:
    """Score-table checks, then threshold, precision-recall and all slices on the splits the
    mode may read. A faulty score table is refused."""
    wanted = ["public_test"] if mode == "public_test" else ["public_test", "private_heldout_family", "private_heldout_stealth"]
    allowed = cut_lineage(governance.split_for(mode, split_table, wanted))
    part = cut_lineage(truth.join(allowed.select("session_id"), "session_id", "left_semi"))
    faults = governance.validate_scores(scores, part).limit(3).collect()
    if faults:
        raise ValueError(f"the score table is not valid: {faults}")
    words = governance.forbidden_words(scores, "accuracy").limit(1).collect()
    if words:
        raise ValueError(f"the score table holds a forbidden word: {words}")
    scored = cut_lineage(slices.with_scores(part, scores))
    public = slices.in_split(scored, allowed, "public_test")
    picked = cut_lineage(thresholds.tau_for_budget(public, thresholds.session_hours(public), budget, "y", "agent_score"))
    tau = float(picked.first()["threshold"])
    report = {
        "primary": attach_row(picked, thresholds.average_precision(scored, "y", "agent_score")),
        "by_family": slices.rate_by_family(scored, tau),
        "by_target": slices.rate_by_target(scored, tau),
        "by_stealth": slices.rate_by_stealth(scored, tau),
        "by_backend": slices.rate_by_backend(scored, tau),
        "by_model_target": slices.rate_by_model_target(scored, tau),
        "agent_vs_benign": slices.agent_vs_benign(scored, tau),
        "benign_family_fp": slices.benign_family_fp(scored, tau),
        "pr_curve": thresholds.pr_curve(scored, "y", "agent_score"),
    }
    if mode == "heldout":
        report["heldout"] = models.heldout_metrics(truth, scores, allowed, budget)
    return report


def build_release(
    sessions: DataFrame, consent: DataFrame, seed: int = 0, n_heldout: int = 1, held_super_family: str | None = None,
    coverage: Sequence[tuple[str, bool]] = fixed.CONSENT_VERSIONS,
) -> dict[str, DataFrame]:
    """Tables of a public release: consent filter, splits, public features and truth of the
    published sessions, the excluded sessions, counts. Refused when a published text field
    holds personal data or a secret.
    sessions: the output of `web.join_sessions` plus consent_id."""
    kept, excluded = governance.publishable(sessions, consent, coverage)
    kept = cut_lineage(kept)
    if not kept.groupBy("session_id").count().filter("count > 1").isEmpty():
        raise ValueError("duplicate session_id: splits would not be repeatable")
    placed = cut_lineage(splits.benchmark_splits(kept, seed, n_heldout, held_super_family))
    table = placed.select("session_id", "split")
    splits.assert_disjoint(table)
    public = cut_lineage(placed.filter(F.col("split").startswith("public_")))
    texts = public.select("session_id", F.concat_ws("\n", "session_id", "target_app", "family", "klass", "src_label").alias("text"))
    hits = cut_lineage(governance.scan_pii(texts, "session_id"))
    if not hits.isEmpty():
        raise ValueError(f"personal data or a secret in the release: {hits.limit(3).collect()}")
    return {
        "splits": table,
        "summary": splits.split_summary(table),
        "split_counts": splits.split_counts(placed),
        "features": web.public_features(public),
        "train": web.train_features(placed.filter(F.col("split").isin("public_train", "public_dev"))),
        "truth": web.truth(public),
        "excluded": excluded,
        "counts": slices.release_counts(public),
    }


def write_release(release: dict[str, DataFrame], path: str) -> None:
    for name, df in release.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def serving(
    events: DataFrame, actions: Sequence[str] = fixed.ACTIONS, budget: float = 1.0, frac: float = 0.25, seed: int = 0, **options
) -> dict:
    """Train the hybrid scorer on part of the campaigns, tune it to the alarm budget on the
    train part, and measure it on the rest, in alarms per hour and time to detect."""
    members = window_members(events, **options)
    features = aggregate_features(members, ["campaign_id", "window_id"], actions)
    windows = cut_lineage(promote_windows(features.join(bigram_shares(members, actions), ["campaign_id", "window_id"]), events))
    placed = cut_lineage(splits.group_split(windows, "campaign_id", frac, seed))
    train, test = placed.filter(F.col("fold") == "train"), placed.filter(F.col("fold") == "test")
    scorer = models.fit_hybrid(train, actions, linear=True)
    spw = cut_lineage(secs_per_window(windows))
    picked = cut_lineage(thresholds.tau_for_budget_quantile(scorer.score(train), spw, budget, "label"))
    tau = float(picked.first()["threshold"])
    scored = cut_lineage(scorer.score(test))
    held = events.join(test.select("campaign_id").distinct(), "campaign_id", "left_semi")
    quality = attach_row(thresholds.prf(scored, tau, "label"), thresholds.window_hours(scored, spw))
    return {
        "scorer": scorer,
        "threshold": tau,
        "tuned": picked,
        "quality": quality.withColumn("fp_per_hour", thresholds.fp_hour(F.col("fp"), F.col("hours"))),
        "pr_auc": thresholds.average_precision(scored, "label"),
        "first_alerts": thresholds.first_alert(scored, held, tau),
        "scored": scored,
        "test_campaigns": test.select("campaign_id").distinct(),
    }
