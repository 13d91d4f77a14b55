"""Alert rates cut by family, target, stealth, backend, tactic, mode and campaign class."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alertloom import fixed
from alertloom.functions import columns as C
from alertloom.operators.scans import attach_row, group_key, rank_rows
from alertloom.operators.windows import modal

BENIGN_KINDS = ["benign_bot", "human"]


def with_scores(truth: DataFrame, scores: DataFrame, key: str = "session_id", score: str = "agent_score") -> DataFrame:
    """Truth rows with their score, 0 where the scorer gave none."""
    return truth.join(scores.select(key, score), key, "left").withColumn(score, F.coalesce(score, F.lit(0.0)))


def in_split(df: DataFrame, splits: DataFrame, name: str, key: str = "session_id") -> DataFrame:
    return df.join(splits.filter(F.col("split") == name).select(key), key, "left_semi")


def leave_out(df: DataFrame, held_out: Column) -> tuple[DataFrame, DataFrame]:
    """(train, held out) by a predicate; rows where it is unknown stay in train."""
    out = F.coalesce(held_out, F.lit(False))
    return df.filter(~out), df.filter(out)


def _filled(column: str) -> Column:
    return F.coalesce(C.blank_to_null(F.col(column)), F.lit("?"))


def _alerts(score: str, tau: float) -> Column:
    return F.count_if(F.col(score) >= tau)


def _kind_rates(kind: Column, rate: Column) -> list[Column]:
    return [
        F.when(kind == "agent", rate).alias("recall_if_agent"),
        F.when(kind.isin(BENIGN_KINDS), rate).alias("fp_rate_if_benign"),
    ]


def rate_by_source(scored: DataFrame, tau: float, score: str = "agent_score") -> DataFrame:
    rows = scored.groupBy("src_label").agg(F.count(F.lit(1)).alias("n"), _alerts(score, tau).alias("alerts"), F.max("y").alias("__y"))
    return rows.select(
        "src_label", "n", "alerts", (F.col("alerts") / F.col("n")).alias("alert_rate"),
        F.when(F.col("__y") == 1, "agent").otherwise("benign").alias("kind"),
    )


def rate_by_family(scored: DataFrame, tau: float, score: str = "agent_score") -> DataFrame:
    """Alert rate per family; its most frequent class says whether that is recall or a false-alarm rate."""
    rows = scored.withColumn("family", _filled("family"))
    rates = rows.groupBy("family").agg(F.count(F.lit(1)).alias("n"), _alerts(score, tau).alias("alerts"))
    kinds = modal(rows, ["family"], "klass", "kind", skip_blank=False)
    rate = F.col("alerts") / F.col("n")
    return rates.join(kinds, "family").select("family", "n", "alerts", rate.alias("alert_rate"), "kind", *_kind_rates(F.col("kind"), rate))


def _truth_counts() -> list[Column]:
    return [F.count_if(F.col("y") == 1).alias("n_agent_truth"), F.count_if(F.col("y") == 0).alias("n_benign_truth")]


def rate_by_target(scored: DataFrame, tau: float, score: str = "agent_score") -> DataFrame:
    rows = scored.withColumn("target_app", _filled("target_app")).groupBy("target_app")
    out = rows.agg(F.count(F.lit(1)).alias("n"), _alerts(score, tau).alias("alerts"), *_truth_counts())
    return out.withColumn("alert_rate", F.col("alerts") / F.col("n"))


def rate_by_stealth(scored: DataFrame, tau: float, score: str = "agent_score") -> DataFrame:
    """Stealth totals and family x stealth cells in one pass; family is null on the totals, blank and missing families
    have no cell."""
    sets = [[F.col("stealth")], [F.col("family"), F.col("stealth")]]
    rows = scored.withColumn("family", F.coalesce("family", F.lit("")))
    out = rows.groupingSets(sets, "family", "stealth").agg(
        F.grouping("family").alias("__all"),
        F.count(F.lit(1)).alias("n"), _alerts(score, tau).alias("alerts"), *_truth_counts(),
        F.min_by("klass", "session_id").alias("__kind"),
    )
    rate = F.col("alerts") / F.col("n")
    kind = F.when(F.col("__all") == 0, F.col("__kind"))
    return out.filter((F.col("__all") == 1) | (F.col("family") != "")).select(
        "family", "stealth", "n", "alerts", "n_agent_truth", "n_benign_truth", rate.alias("alert_rate"),
        kind.alias("kind"), *_kind_rates(kind, rate),
    )


def agent_vs_benign(scored: DataFrame, tau: float, score: str = "agent_score") -> DataFrame:
    hit = F.col(score) >= tau
    agent, bot = F.col("klass") == "agent", F.col("klass") == "benign_bot"
    c = scored.agg(
        F.count_if(agent & hit).alias("agent_alert"), F.count_if(agent & ~hit).alias("agent_miss"),
        F.count_if(bot & hit).alias("benign_bot_alert"), F.count_if(bot & ~hit).alias("benign_bot_quiet"),
    )
    return c.select(
        "*", F.try_divide("agent_alert", F.col("agent_alert") + F.col("agent_miss")).alias("agent_recall"),
        F.try_divide("benign_bot_alert", F.col("benign_bot_alert") + F.col("benign_bot_quiet")).alias("benign_bot_fp_rate"),
    )


def benign_family_fp(scored: DataFrame, tau: float, score: str = "agent_score") -> DataFrame:
    rows = scored.filter(F.col("klass") == "benign_bot").withColumn("family", _filled("family")).groupBy("family")
    out = rows.agg(F.count(F.lit(1)).alias("n"), _alerts(score, tau).alias("false_positives"))
    return out.withColumn("fp_rate", F.col("false_positives") / F.col("n"))


def _backend_rows(scored: DataFrame) -> DataFrame:
    return scored.withColumns({
        "backend": C.backend_of(F.col("family")), "model": C.model_slug_of(F.col("family")), "target_app": _filled("target_app"),
    }).filter(F.col("backend").isNotNull())


def _recall(score: str, tau: float) -> Column:
    hit = F.count_if((F.col(score) >= tau) & (F.col("y") == 1))
    return F.try_divide(hit, F.count_if(F.col("y") == 1)).alias("recall")


def rate_by_backend(scored: DataFrame, tau: float, score: str = "agent_score") -> DataFrame:
    """Per backend of the agent families: alerts, recall, and how many targets and models occur.
    Both distinct counts come from small (backend, model, target) cells."""
    cells = _backend_rows(scored).groupBy("backend", "model", "target_app").agg(
        F.count(F.lit(1)).alias("n"), _alerts(score, tau).alias("alerts"), F.count_if(F.col("y") == 1).alias("pos"),
        F.count_if((F.col(score) >= tau) & (F.col("y") == 1)).alias("hit"),
    )
    out = cells.groupBy("backend").agg(
        F.sum("n").alias("n"), F.sum("alerts").alias("alerts"), F.sum("pos").alias("n_agent_truth"), F.sum("hit").alias("hit"),
        F.count_distinct("target_app").alias("n_target_apps"), F.count_distinct("model").alias("n_models"),
    )
    return out.withColumn("alert_rate", F.col("alerts") / F.col("n")).withColumn("recall", F.try_divide("hit", "n_agent_truth")).drop("hit")


def rate_by_model_target(scored: DataFrame, tau: float, score: str = "agent_score") -> DataFrame:
    out = _backend_rows(scored).groupBy("backend", "model", "target_app").agg(
        F.count(F.lit(1)).alias("n"), _alerts(score, tau).alias("alerts"), F.count_if(F.col("y") == 1).alias("n_agent_truth"),
        _recall(score, tau), F.bool_or("stealth").alias("stealth_seen"),
    )
    return out.withColumn("alert_rate", F.col("alerts") / F.col("n"))


def honeypot_precision(sessions: DataFrame, traps: Sequence[str] = fixed.HONEYPOTS) -> DataFrame:
    """Share of agents among the sessions that tripped a trap, overall ('any') and per trap."""
    flags = {t: F.col(t) > 0 for t in traps}
    anyone = F.greatest(*[F.col(t) for t in traps]) > 0
    cell = lambda name, hit: F.struct(
        F.lit(name).alias("honeypot"), F.count_if(hit).alias("tripped"),
        F.try_divide(F.count_if(hit & (F.col("y") == 1)), F.count_if(hit)).alias("precision"),
    )
    wide = sessions.agg(F.array(cell("any", anyone), *[cell(t, f) for t, f in flags.items()]).alias("c"))
    return wide.select(F.explode("c").alias("c")).select("c.*")


def trip_rates(sessions: DataFrame, traps: Sequence[str] = fixed.HONEYPOTS) -> DataFrame:
    """Trip rate of each trap per source label."""
    wide = sessions.groupBy("src_label").agg(
        F.count(F.lit(1)).alias("sessions"),
        F.array(*[F.struct(F.lit(t).alias("honeypot"), F.count_if(F.col(t) > 0).alias("hits")) for t in traps]).alias("c"),
    )
    flat = wide.select("src_label", "sessions", F.explode("c").alias("c"))
    return flat.select("src_label", "c.honeypot", "c.hits", "sessions", F.round(F.col("c.hits") / F.col("sessions"), 4).alias("rate"))


def recall_by_tactic(scored: DataFrame, tau: float, score: str = "score", label: str = "label") -> DataFrame:
    """Recall of attack windows per tactic, and of all tactics with support as '(macro)'."""
    attack = scored.filter((F.col(label) == 1) & (F.col("tactic") != ""))
    rows = attack.groupBy("tactic").agg(
        F.count(F.lit(1)).alias("n"), _alerts(score, tau).alias("flagged"),
    ).withColumn("recall", F.col("flagged") / F.col("n"))
    macro = rows.agg(F.sum("n").alias("n"), F.sum("flagged").alias("flagged"), F.avg("recall").alias("recall"))
    return rows.unionByName(macro.filter(F.col("n").isNotNull()).withColumn("tactic", F.lit("(macro)")))


def recall_by_mode(scored: DataFrame, tau: float, score: str = "score", label: str = "label", modes: Sequence[str] = fixed.ATTACK_MODES) -> DataFrame:
    """Recall per attack mode, null for a mode without attack windows."""
    cell = lambda m: F.struct(
        F.lit(m).alias("mode"), F.count_if((F.col("mode") == m) & (F.col(label) == 1)).alias("n"),
        F.try_divide(
            F.count_if((F.col("mode") == m) & (F.col(label) == 1) & (F.col(score) >= tau)),
            F.count_if((F.col("mode") == m) & (F.col(label) == 1)),
        ).alias("recall"),
    )
    return scored.agg(F.array(*[cell(m) for m in modes]).alias("c")).select(F.explode("c").alias("c")).select("c.*")


def label_counts(df: DataFrame, column: str = "src_label") -> DataFrame:
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def axes(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Distinct values of each axis column, one row per (axis, value)."""
    pairs = F.array(*[F.struct(F.lit(c).alias("axis"), F.col(c).cast("string").alias("value")) for c in columns])
    return df.select(F.explode(pairs).alias("p")).select("p.*").distinct()


def release_counts(sessions: DataFrame) -> DataFrame:
    """Session counts by class, family, target and stealth, with the total, in one pass."""
    names = {"by_class": "klass", "by_family": "family", "by_target_app": "target_app", "by_stealth": "stealth"}
    text = {
        "klass": _filled("klass"), "family": _filled("family"), "target_app": _filled("target_app"),
        "stealth": F.when(F.col("stealth"), "stealth=true").otherwise("stealth=false"),
    }
    pairs = [F.struct(F.lit(a).alias("axis"), text[c].alias("value")) for a, c in names.items()]
    pairs.append(F.struct(F.lit("total").alias("axis"), F.lit("").alias("value")))
    return sessions.select(F.explode(F.array(*pairs)).alias("p")).groupBy("p.axis", "p.value").agg(F.count(F.lit(1)).alias("n"))


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The newest row of each key; `order` ends with a line number so that ties go to the later line."""
    row = F.struct(*[F.col(c) for c in df.columns])
    top = df.groupBy(*keys).agg(F.max_by(row, F.struct(*order)).alias("__r"))
    return top.select("__r.*")


def rank_leaderboard(entries: DataFrame, metric: str, groups: Sequence[str] = ("splits_version", "split", "seed"), tie: str = "submission_hash") -> DataFrame:
    """Rank in each group by a metric, best first, entries without a number last."""
    groups = list(groups)
    value = F.when(~F.isnan(metric), F.col(metric))
    rows = entries.withColumn("__has", value.isNotNull()).withColumn("__v", F.coalesce(value, F.lit(0.0)))
    ranked = rank_rows(rows, "__v", [*groups, "__has"], [tie], descending=True, name="__r")
    counted = rows.groupBy(group_key(groups).alias("__g")).agg(F.count_if("__has").alias("__n"))
    shift = F.when(F.col("__has"), 0).otherwise(F.col("__n"))
    return ranked.withColumn("__g", group_key(groups)).join(counted, "__g").select(*entries.columns, (F.col("__r") + shift).alias("rank"))


def seed_summary(runs: DataFrame) -> DataFrame:
    """Mean, population deviation, minimum and maximum of each metric over repeated runs."""
    return runs.groupBy("metric").agg(
        F.count(F.lit(1)).alias("n_runs"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"),
        F.min("value").alias("min"), F.max("value").alias("max"),
    )


def wins(runs: DataFrame, better: str, worse: Sequence[str], strict: bool = True) -> DataFrame:
    """In how many runs one metric beats the best of the others, and its mean lead."""
    pick = lambda names: F.max(F.when(F.col("metric").isin(list(names)), F.col("value")))
    per = runs.groupBy("seed").agg(pick([better]).alias("a"), pick(worse).alias("b"))
    won = (F.col("a") > F.col("b")) if strict else (F.col("a") >= F.col("b"))
    return per.agg(F.count_if(won).alias("wins"), F.count(F.lit(1)).alias("n_runs"), F.avg(F.col("a") - F.col("b")).alias("mean_lead"))


def lift_table(scored: DataFrame, models: Sequence[str], baseline: str, y: str = "label") -> DataFrame:
    """Average precision of several score columns on one split and the lift over a baseline."""
    from alertloom.operators.thresholds import average_precision

    pairs = F.array(*[F.struct(F.lit(m).alias("model"), F.col(m).alias("score")) for m in models])
    long = scored.select(F.col(y).alias("y"), F.explode(pairs).alias("p")).select("y", "p.*")
    ap = average_precision(long, by=["model"])
    base = ap.agg(F.max(F.when(F.col("model") == baseline, F.col("pr_auc"))).alias("__b"))
    return attach_row(ap, base).withColumn("lift", F.col("pr_auc") - F.col("__b")).drop("__b")
