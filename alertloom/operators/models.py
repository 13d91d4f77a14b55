"""Scorers fitted with pyspark.ml, rule scorers under one interface, and the evaluations
that refit them. A fitted scorer carries its preparation, so it can be saved and reused."""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.ml import PipelineModel, Pipeline
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from alertloom import fixed
from alertloom.operators import slices, thresholds, web
from alertloom.operators.scans import attach_row, exact_percentiles, rank_by_sort
from alertloom.operators.splits import class_weight, group_split
from alertloom.operators.windows import FEATURES, bigram_columns, share_columns
from alertloom.session import cut_lineage

FITS_AT_ONCE = 4


@dataclass
class Scorer:
    """A fitted model and its input columns; without a model every row scores 0.5."""

    cols: list[str]
    model: PipelineModel | None

    def score(self, df: DataFrame, name: str = "score") -> DataFrame:
        if self.model is None:
            return df.withColumn(name, F.lit(0.5))
        out = self.model.transform(df).withColumn(name, vector_to_array("probability")[1])
        return out.select(*[c for c in df.columns if c != name], name)

    def save(self, path: str) -> None:
        """The model, if there is one, and the columns beside it."""
        if self.model is not None:
            self.model.write().overwrite().save(f"{path}/model")
        spark = SparkSession.getActiveSession()
        spark.createDataFrame([(json.dumps(self.cols), self.model is None)], "cols string, constant boolean").write.mode("overwrite").parquet(f"{path}/columns")

    @staticmethod
    def load(spark: SparkSession, path: str) -> "Scorer":
        saved = spark.read.parquet(f"{path}/columns").first()
        return Scorer(json.loads(saved["cols"]), None if saved["constant"] else PipelineModel.load(f"{path}/model"))

    def linear(self) -> "LinearScorer":
        """The logistic model with its scaling folded in: what a streaming task needs."""
        if self.model is None:
            return LinearScorer(list(self.cols), [0.0] * len(self.cols), 0.0)
        scaler, logistic = self.model.stages[1], self.model.stages[2]
        mean, std = scaler.mean.toArray(), scaler.std.toArray()
        safe = [s if s > 0 else 1.0 for s in std]
        coef = [float(c) / s for c, s in zip(logistic.coefficients.toArray(), safe)]
        shift = float(logistic.intercept) - sum(c * m for c, m in zip(coef, mean))
        return LinearScorer(list(self.cols), coef, shift)


@dataclass
class LinearScorer:
    """Logistic score of named features: a few numbers that ship with a task's closure."""

    cols: list[str]
    coef: list[float]
    intercept: float


def _class_size(train: DataFrame, y: str) -> int:
    """Number of rows, or 0 when they are all of one class: there is nothing to fit."""
    ends = train.agg(F.min(y).alias("lo"), F.max(y).alias("hi"), F.count(F.lit(1)).alias("n")).first()
    return 0 if ends["lo"] == ends["hi"] else ends["n"]


def single_class(train: DataFrame, y: str) -> bool:
    return _class_size(train, y) == 0


def fit_gbt(train: DataFrame, cols: Sequence[str], y: str = "label", rounds: int = 300, depth: int = 6, step: float = 0.06, seed: int = 0) -> Scorer:
    """Boosted trees on class-balanced rows."""
    if single_class(train, y):
        return Scorer(list(cols), None)
    weighted = class_weight(train, y).withColumn("__y", F.col(y).cast("double"))
    assembler = VectorAssembler(inputCols=list(cols), outputCol="__x", handleInvalid="keep")
    # The fit runs a job per tree level and sends the plan of its rows with every task: short rows and a cut plan.
    rows = cut_lineage(assembler.transform(weighted).select("__x", "__y", "weight"))
    trees = GBTClassifier(featuresCol="__x", labelCol="__y", weightCol="weight", maxIter=rounds, maxDepth=depth, stepSize=step, seed=seed)
    return Scorer(list(cols), PipelineModel([assembler, trees.fit(rows)]))


def side_by_side(fits: Sequence[Callable[[], Scorer]]) -> list[Scorer]:
    """Runs fits that do not depend on each other at the same time: the jobs of one fill the pauses between the jobs of another."""
    with ThreadPoolExecutor(FITS_AT_ONCE) as pool:
        return list(pool.map(lambda fit: fit(), fits))


def fit_logistic(train: DataFrame, cols: Sequence[str], y: str = "y", c: float = 1.0) -> Scorer:
    """Standardized logistic regression with an L2 term of 1 / (C n)."""
    n = _class_size(train, y)
    if n == 0:
        return Scorer(list(cols), None)
    rows = train.withColumn("__y", F.col(y).cast("double"))
    stages = [
        VectorAssembler(inputCols=list(cols), outputCol="__raw"),
        StandardScaler(inputCol="__raw", outputCol="__x", withMean=True, withStd=True),
        LogisticRegression(featuresCol="__x", labelCol="__y", regParam=1.0 / (c * n), maxIter=1000, standardization=False),
    ]
    return Scorer(list(cols), Pipeline(stages=stages).fit(rows))


def aggregate_columns(actions: Sequence[str]) -> list[str]:
    return FEATURES + share_columns(actions)


def fit_order_model(train: DataFrame, actions: Sequence[str] = fixed.ACTIONS, y: str = "label") -> Scorer:
    """Sees only which action follows which."""
    return fit_logistic(train, bigram_columns(actions), y)


def fit_hybrid(train: DataFrame, actions: Sequence[str] = fixed.ACTIONS, y: str = "label", traps: Sequence[str] = (), linear: bool = False, rounds: int = 300) -> Scorer:
    """Aggregates and order together, plus trap flags when given; leave `traps` empty for
    the ablated head. `linear` gives the form a streaming task can carry."""
    cols = aggregate_columns(actions) + bigram_columns(actions) + list(traps)
    return fit_logistic(train, cols, y) if linear else fit_gbt(train, cols, y, rounds)


def fit_session_heads(train: DataFrame, y: str = "y") -> dict[str, Scorer]:
    """The session scorer with and without the trap flags, and, where sessions carry transition features, with the order of
    requests, and with that order alone."""
    heads = {"with_hp": web.SESSION_FEATURES + fixed.HONEYPOTS, "ml_only": web.SESSION_FEATURES}
    if set(web.TRANSITIONS) <= set(train.columns):
        heads |= {"ordered": web.SESSION_FEATURES + web.TRANSITIONS + fixed.HONEYPOTS, "order_only": web.TRANSITIONS}
    return {name: fit_logistic(train, cols, y) for name, cols in heads.items()}


def fit_tactics(train: DataFrame, cols: Sequence[str], tactics: Sequence[str] = fixed.TACTICS) -> dict[str, Scorer]:
    """One binary scorer per tactic; label columns has_<tactic>."""
    return {t: fit_logistic(train, cols, f"has_{t}") for t in tactics}


def score_tactics(df: DataFrame, scorers: dict[str, Scorer]) -> DataFrame:
    for t, s in scorers.items():
        df = s.score(df, f"p_{t}")
    return df


def event_contributions(members: DataFrame, scorer: Scorer, actions: Sequence[str]) -> DataFrame:
    """How much each event pushes a linear window score up, through its action, artifact
    score and depth. Feeds `top_events` for the span shown with an alert."""
    lin = scorer.linear()
    weight = dict(zip(lin.cols, lin.coef))
    by_action = F.lit(0.0)
    for a in actions:
        by_action = F.when(F.col("action") == a, weight.get(f"act_{a}", 0.0)).otherwise(by_action)
    push = by_action + F.col("artifact_ai") * weight.get("ai_artifact_mean", 0.0) + F.col("depth") * weight.get("depth_mean", 0.0)
    return members.withColumn("weight", push)


# Scorers that take session tables: name -> (train, sessions, request features) -> scores.
def _aggregate_only(train, sessions, features):
    return fit_logistic(train, web.SESSION_FEATURES).score(sessions, "agent_score").select("session_id", "agent_score")


def _hybrid(train, sessions, features):
    """Aggregates, traps and the order of requests; the train sessions carry their transition features."""
    cols = web.SESSION_FEATURES + web.TRANSITIONS + fixed.HONEYPOTS
    return fit_logistic(train, cols).score(web.with_transitions(sessions, features), "agent_score").select("session_id", "agent_score")


SCORERS: dict[str, Callable[[DataFrame, DataFrame, DataFrame], DataFrame]] = {
    "honeypot_only": lambda train, sessions, features: web.honeypot_rule(sessions),
    "ua_rule": lambda train, sessions, features: web.ua_rule(features, sessions),
    "timing_threshold": lambda train, sessions, features: web.timing_rule(features),
    "aggregate_only": _aggregate_only,
    "hybrid": _hybrid,
}


def python_scorer(predict: Callable[[pd.DataFrame], Sequence[float]], columns: Sequence[str] | None = None) -> Callable[[DataFrame, DataFrame, DataFrame], DataFrame]:
    """A scorer from a plain Python function: it gets pandas frames of sessions with the feature columns and returns one score per row.

    Spark sends the sessions in Arrow batches, so the function sees a bounded number of them at a time and must score each row by itself; it never sees a
    label. What it returns is held to the score contract like that of any other scorer (`run_scorer`). The function must be importable on the executors or defined
    in the calling program."""
    wanted = list(columns or [*web.SESSION_FEATURES, *fixed.HONEYPOTS])

    def score(train: DataFrame, sessions: DataFrame, features: DataFrame) -> DataFrame:
        kind = sessions.schema["session_id"].dataType.simpleString()

        def run(batches):
            for rows in batches:
                scores = list(predict(rows[wanted]))
                if len(scores) != len(rows):
                    raise ValueError(f"{len(scores)} scores for {len(rows)} sessions")
                yield pd.DataFrame({"session_id": rows["session_id"], "agent_score": scores})

        return sessions.select("session_id", *wanted).mapInPandas(run, f"session_id {kind}, agent_score double")

    return score


def run_scorer(name: str | Callable, train: DataFrame, sessions: DataFrame, features: DataFrame) -> DataFrame:
    """Scores of a registered scorer, or of one given as such, refused when they break the score contract."""
    from alertloom.operators.governance import validate_scores

    blind = sessions.select("session_id", "target_app", *web.SESSION_FEATURES, *fixed.HONEYPOTS)
    scores = cut_lineage((SCORERS[name] if isinstance(name, str) else name)(train, blind, features))
    faults = validate_scores(scores, blind).limit(3).collect()
    if faults:
        raise ValueError(f"scorer {name} broke the score contract: {faults}")
    return scores


def heldout_families(
    sessions: DataFrame, budget: float, fit: Callable[[DataFrame], Scorer] | None = None, frac: float = 0.3, seed: int = 0,
    families: Sequence[str] | None = None,
) -> DataFrame:
    """Does the scorer recognise a family, or a stealth variant, that it never saw?

    Per agent family: recall when left out against recall in the usual split, `flag` when
    it falls below half. Per benign family: false-alarm rate, `flag` when it more than
    doubles. Per mixed family: the stealth rows left out. Each row needs its own fit, so
    there are as many fits as families; families are a closed vocabulary, and the fits, which do not depend on each
    other, run side by side."""
    fit = fit or (lambda train: fit_logistic(train, web.SESSION_FEATURES))
    sessions = cut_lineage(sessions)
    parts = cut_lineage(group_split(sessions, "session_id", frac, seed))
    train, test = parts.filter(F.col("fold") == "train"), parts.filter(F.col("fold") == "test")
    scored = cut_lineage(fit(train).score(test, "agent_score"))
    tau = thresholds.tau_for_budget(scored, thresholds.session_hours(scored), budget, "y", "agent_score").first()["threshold"]
    groups = sessions.filter(F.col("klass").isin("agent", "benign_bot") & (F.coalesce("family", F.lit("")) != "")).groupBy("klass", "family").agg(
        F.bool_or("stealth").alias("quiet"), F.bool_or(~F.col("stealth")).alias("loud")
    )
    if families is not None:
        groups = groups.filter(F.col("family").isin(list(families)))
    rows = groups.orderBy("klass", "family").collect()
    cases = [("agent_family" if r["klass"] == "agent" else "benign_family", r["family"]) for r in rows]
    cases += [("stealth", r["family"]) for r in rows if r["klass"] == "agent" and r["quiet"] and r["loud"]]

    def rate(df: DataFrame):
        return F.avg((df["agent_score"] >= tau).cast("double"))

    def one_case(case):
        kind, family = case
        of_family = F.col("family") == family
        held = of_family & F.col("stealth") if kind == "stealth" else of_family
        rest, left = slices.leave_out(sessions, held)
        usual = scored.filter(of_family & ~F.col("stealth") if kind == "stealth" else of_family)
        skipped = single_class(rest, "y")
        heldout = fit(rest).score(left, "agent_score")
        one = heldout.agg(F.count(F.lit(1)).alias("n_holdout"), rate(heldout).alias("heldout_rate"))
        return attach_row(one, usual.agg(rate(usual).alias("in_dist_rate"))).select(
            F.lit(kind).alias("kind"), F.lit(family).alias("family"), F.lit(skipped).alias("skipped"), "n_holdout",
            F.when(~F.lit(skipped), F.col("heldout_rate")).alias("heldout_rate"), "in_dist_rate",
        )

    with ThreadPoolExecutor(FITS_AT_ONCE) as pool:
        out = reduce(DataFrame.unionByName, pool.map(one_case, cases))
    ratio = F.when(F.col("in_dist_rate") > 1e-9, F.col("heldout_rate") / F.col("in_dist_rate"))
    fails = F.when(F.col("kind") == "benign_family", F.col("heldout_rate") > 2.0 * F.greatest("in_dist_rate", F.lit(1e-6))).otherwise(
        (F.col("in_dist_rate") > 0) & (F.col("heldout_rate") < 0.5 * F.col("in_dist_rate"))
    )
    return out.withColumn("heldout_ratio", ratio).withColumn("flag", fails).withColumn("threshold", F.lit(float(tau)))


def framework_swap(windows: DataFrame, cols: Sequence[str], budget: float, fit: Callable[[DataFrame], Scorer] | None = None, tau_on: str = "eval") -> DataFrame:
    """Train on one emulation framework, evaluate on the other, both ways. Benign windows
    are cut 75/25 in campaign order. windows: features, label, class, framework."""
    fit = fit or (lambda train: fit_gbt(train, cols))
    windows = cut_lineage(windows)
    benign = windows.filter(F.col("class").isin("normal", "hard_negative"))
    ranked = rank_by_sort(benign, "campaign_id", "window_id")
    early = F.col("rank") <= F.greatest(F.lit(1), F.floor(F.col("n_total") * 0.75))
    benign_train, benign_eval = [ranked.filter(c).drop("rank", "n_total") for c in (early, ~early)]
    out = None
    attack = lambda fw: windows.filter((F.col("class") == "attack") & (F.col("framework") == fw))
    ways = [("caldera", "atomic"), ("atomic", "caldera")]
    scorers = side_by_side([lambda a=a: fit(attack(a).unionByName(benign_train)) for a, _ in ways])
    for (a, b), scorer in zip(ways, scorers):
        scored = cut_lineage(scorer.score(attack(b).unionByName(benign_eval)))
        picked_on = scored if tau_on == "eval" else scorer.score(attack(a).unionByName(benign_train))
        gap = exact_percentiles(scored.filter(F.col("label") == 0), "dt_median", [0.5]).agg(F.max("value").alias("m"))
        spw = gap.select(F.greatest(F.lit(1.0), fixed.WINDOW_EVENTS * F.coalesce("m", F.lit(1.0))).alias("secs_per_window"))
        tau = thresholds.tau_for_budget(picked_on, thresholds.window_hours(picked_on, spw), budget, "label").select("threshold", "fp_count", "fp_per_hour")
        row = attach_row(thresholds.average_precision(scored, "label"), tau).withColumn("direction", F.lit(f"train_{a}_eval_{b}"))
        out = row if out is None else out.unionByName(row)
    return out


def heldout_metrics(truth: DataFrame, scores: DataFrame, splits: DataFrame, budget: float) -> DataFrame:
    """One row: threshold and false alarms on the public test sessions, and how the scorer
    does on the held-out families and stealth variants at that threshold."""
    rows = cut_lineage(slices.with_scores(truth, scores).join(splits.select("session_id", "split"), "session_id"))
    public = rows.filter(F.col("split") == "public_test")
    tau = thresholds.tau_for_budget(public, thresholds.session_hours(public), budget, "y", "agent_score")
    evaluated = rows.filter(F.col("split").isin("public_test", "private_heldout_family", "private_heldout_stealth"))
    overall = thresholds.average_precision(evaluated, "y", "agent_score").select("pr_auc")
    family = F.col("split") == "private_heldout_family"
    mixed = rows.filter((family & (F.col("y") == 1)) | ((F.col("split") == "public_test") & (F.col("y") == 0)))
    held = thresholds.average_precision(mixed, "y", "agent_score").select(F.col("pr_auc").alias("heldout_family_pr_auc"))
    hit = F.col("agent_score") >= F.col("threshold")
    positive = lambda split: (F.col("split") == split) & (F.col("y") == 1)
    recalls = attach_row(rows, tau.select("threshold")).agg(
        F.try_divide(F.count_if(positive("private_heldout_family") & hit), F.count_if(positive("private_heldout_family"))).alias("heldout_family_recall"),
        F.try_divide(F.count_if(positive("private_heldout_stealth") & hit), F.count_if(positive("private_heldout_stealth"))).alias("heldout_stealth_recall"),
        F.count_if(positive("private_heldout_family")).alias("n_family_positives"),
        F.count_if(positive("private_heldout_stealth")).alias("n_stealth_positives"),
    )
    return attach_row(attach_row(attach_row(tau, overall), held), recalls)
