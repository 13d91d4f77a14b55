"""Fitted scorers, held-out evaluations, per-event-id attribution, whole reports. Queries
whose result depends on a fit have no SQL; the arithmetic around them is checked with the
fixed rule score."""

import numpy as np
from pyspark.sql import functions as F

from alertloom import fixed
from alertloom.operators import attribution as A
from alertloom.operators import economics as E
from alertloom.operators import models as M
from alertloom.operators import slices as S
from alertloom.operators import splits as P
from alertloom.operators import thresholds as T
from alertloom.operators import web as B
from alertloom.operators import windows as W
from alertloom.plans import reports, staging
from alertloom.session import cut_lineage
from catalog.registry import EV, SCORED, query
from catalog.scores import _SPLITS, scored, splits
from catalog.web import SESS, inputs, sessions
from catalog.windows import members, rounded

ACTIONS = staging.ACTIONS


def window_table(spark, sf):
    """Window features, action pairs, tactic flags and manifest columns, written once."""
    m = members(spark, sf)
    keys = ["campaign_id", "window_id"]
    wide = W.aggregate_features(m, keys, ACTIONS).join(W.bigram_shares(m, ACTIONS), keys).join(W.window_multihot(m), keys).join(W.window_tactic(m), keys)
    return cut_lineage(E.with_manifest(wide, staging.manifest(spark, sf)))


def folds(spark, sf):
    placed = cut_lineage(P.group_split(window_table(spark, sf), "campaign_id", 0.3, 1))
    return placed.filter(F.col("fold") == "train"), placed.filter(F.col("fold") == "test")


@query("M6_boosted_trees")
def boosted_trees(spark, sf):
    train, test = folds(spark, sf)
    return M.fit_gbt(train, M.aggregate_columns(ACTIONS)).score(test).select("campaign_id", "window_id", "label", "score")


@query("M7_logistic_sessions")
def logistic_sessions(spark, sf):
    rows = cut_lineage(P.group_split(sessions(spark, sf), "session_id", 0.3, 1))
    scorer = M.fit_logistic(rows.filter(F.col("fold") == "train"), B.SESSION_FEATURES)
    return scorer.score(rows.filter(F.col("fold") == "test"), "agent_score").select("session_id", "y", "agent_score")


@query("M7_logistic_vectors")
def logistic_vectors(spark, sf):
    e = staging.table(spark, sf, "embeddings")
    rows = e.select("vec_id", (F.col("label") % 2).alias("y"), *[F.col("embedding")[i].cast("double").alias(f"x{i}") for i in range(64)])
    rows = cut_lineage(P.group_split(rows, "vec_id", 0.3, 1))
    scorer = M.fit_logistic(rows.filter(F.col("fold") == "train"), [f"x{i}" for i in range(64)])
    return scorer.score(rows.filter(F.col("fold") == "test")).select("vec_id", "y", "score")


@query("M9_order_model")
def order_model(spark, sf):
    train, test = folds(spark, sf)
    return M.fit_order_model(train, ACTIONS).score(test).select("campaign_id", "window_id", "label", "score")


@query("M10_tactic_scorers")
def tactic_scorers(spark, sf):
    train, test = folds(spark, sf)
    out = M.score_tactics(test, M.fit_tactics(train, M.aggregate_columns(ACTIONS)))
    return out.select("campaign_id", "window_id", *[c for c in out.columns if c.startswith(("p_", "has_"))])


@query("M10_risk_spans")
def risk_spans(spark, sf):
    train, test = folds(spark, sf)
    scorer = M.fit_logistic(train, M.aggregate_columns(ACTIONS), "label")
    top = T.top_windows(scorer.score(test), 3).select("campaign_id", "window_id", "score")
    spans = T.top_events(M.event_contributions(members(spark, sf), scorer, ACTIONS), 3)
    return spans.join(top, ["campaign_id", "window_id"]).select("campaign_id", "window_id", "score", "pos", "span_pos", "action", "technique")


@query("M11_hybrid_lift")
def hybrid_lift(spark, sf):
    train, test = folds(spark, sf)
    hybrid, aggregate = M.side_by_side([lambda: M.fit_hybrid(train, ACTIONS), lambda: M.fit_gbt(train, M.aggregate_columns(ACTIONS))])
    both = aggregate.score(hybrid.score(test, "hybrid"), "aggregate")
    return S.lift_table(cut_lineage(both), ["hybrid", "aggregate"], "aggregate")


@query("M11_session_heads")
def session_heads(spark, sf):
    table = B.with_transitions(sessions(spark, sf), B.request_features(inputs(spark, sf)[0]))
    rows = cut_lineage(P.group_split(table, "session_id", 0.3, 0))
    train, out = rows.filter(F.col("fold") == "train"), rows.filter(F.col("fold") == "test")
    for name, head in M.fit_session_heads(train).items():
        out = head.score(out, name)
    return out.select("session_id", "y", "with_hp", "ml_only", "ordered", "order_only")


@query("M4_framework_swap")
def framework_swap(spark, sf):
    cols = M.aggregate_columns(ACTIONS)
    return M.framework_swap(window_table(spark, sf), cols, 0.01, lambda train: M.fit_gbt(train, cols))


@query("M17_heldout_families")
def heldout_families(spark, sf):
    table = cut_lineage(sessions(spark, sf).withColumn("klass", F.when(F.col("y") == 1, "agent").otherwise("benign_bot")))
    return M.heldout_families(table, 0.05)


@query("F1_scorer_registry")
def scorer_registry(spark, sf):
    req = inputs(spark, sf)[0]
    table = B.with_transitions(sessions(spark, sf), B.request_features(req))
    rows = cut_lineage(P.group_split(table, "session_id", 0.3, 0))
    train, test = rows.filter(F.col("fold") == "train"), rows.filter(F.col("fold") == "test")
    features = cut_lineage(B.public_sequences(req, test))
    out = None
    for name in M.SCORERS:
        one = M.run_scorer(name, train, test, features).withColumn("scorer", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


@query("F1_python_scorer", f"WITH {SESS} SELECT session_id, round(1 / (1 + exp(3 - log_n - 2 * frac_4xx)), 9) AS agent_score FROM ss")
def python_scorer(spark, sf):
    """A scorer that a user brings as a function over pandas frames."""
    table = cut_lineage(sessions(spark, sf))
    scorer = M.python_scorer(lambda rows: 1 / (1 + np.exp(3 - rows["log_n"] - 2 * rows["frac_4xx"])))
    return rounded(M.run_scorer(scorer, table, table, None), {"agent_score": 9})


@query("F2_saved_scorer")
def saved_scorer(spark, sf):
    from catalog.host import fresh_folder

    train, test = folds(spark, sf)
    path = fresh_folder(spark)
    M.fit_logistic(train, M.aggregate_columns(ACTIONS), "label").save(path)
    return M.Scorer.load(spark, path).score(test).select("campaign_id", "window_id", "score")


_HELD = f"""{SCORED}, {_SPLITS}, al AS (SELECT sc.*, split FROM sc JOIN spl USING (session_id)), pb AS (SELECT * FROM al WHERE split = 'public_test'),
tab AS (SELECT agent_score AS s, count(*) FILTER (WHERE y = 1) AS pos, count(*) FILTER (WHERE y = 0) AS neg FROM pb GROUP BY 1), run AS (SELECT *, sum(neg) OVER (ORDER BY s DESC) AS fp FROM tab),
h AS (SELECT sum(greatest(duration_s, 0)) / 3600 AS hours FROM pb), p AS (SELECT min(s) FILTER (WHERE fp <= 2 * hours) AS t, coalesce(max(fp) FILTER (WHERE fp <= 2 * hours), 0) AS f, max(hours) AS hours FROM run, h),
th AS (SELECT coalesce(t, 1.0) AS t, f, hours FROM p)"""
_AP = lambda name, cond: f"""{name}t AS (SELECT agent_score AS s, count(*) FILTER (WHERE y = 1) AS pos, count(*) FILTER (WHERE y = 0) AS neg FROM al WHERE {cond} GROUP BY 1),
{name}r AS (SELECT *, sum(pos) OVER (ORDER BY s DESC) AS tp, sum(neg) OVER (ORDER BY s DESC) AS fp FROM {name}t), {name} AS (SELECT CASE WHEN sum(pos) > 0 AND sum(neg) > 0 THEN sum(pos * tp / (tp + fp)) / sum(pos) END AS v FROM {name}r)"""
_REC = lambda s: f"round((SELECT count(*) FROM al WHERE split = '{s}' AND y = 1 AND agent_score >= (SELECT t FROM th)) / nullif((SELECT count(*) FROM al WHERE split = '{s}' AND y = 1), 0), 9)"


@query("M22_heldout_metrics", f"""WITH {_HELD}, {_AP('allsc', "split IN ('public_test', 'private_heldout_family', 'private_heldout_stealth')")}, {_AP('famsc', "(split = 'private_heldout_family' AND y = 1) OR (split = 'public_test' AND y = 0)")}
SELECT t AS threshold, CAST(th.f AS BIGINT) AS fp_count, round(th.f / greatest(hours, 1e-9), 6) AS fp_per_hour, round(hours, 6) AS hours, round((SELECT v FROM allsc), 9) AS pr_auc, round((SELECT v FROM famsc), 9) AS heldout_family_pr_auc,
  {_REC('private_heldout_family')} AS heldout_family_recall, {_REC('private_heldout_stealth')} AS heldout_stealth_recall, (SELECT count(*) FROM al WHERE split = 'private_heldout_family' AND y = 1) AS n_family_positives,
  (SELECT count(*) FROM al WHERE split = 'private_heldout_stealth' AND y = 1) AS n_stealth_positives FROM th""")
def heldout_metrics(spark, sf):
    sc = scored(spark, sf)
    out = M.heldout_metrics(B.truth(sc), sc.select("session_id", "agent_score"), splits(spark, sf), 2.0)
    return rounded(out, {"fp_per_hour": 6, "hours": 6, "pr_auc": 9, "heldout_family_pr_auc": 9, "heldout_family_recall": 9, "heldout_stealth_recall": 9})


def _dropout_sql(keep):
    return f"""{EV}, cp AS (SELECT ev.* REPLACE (CAST({{label}} AS INTEGER) AS label), d FROM ev, (SELECT unnest([-2, 1, 3, 10, 11, 13]) AS d) WHERE eid <> d AND {keep}),
ranked AS (SELECT *, row_number() OVER w - 1 AS rn, lag(ts) OVER w AS prev_ts FROM cp WINDOW w AS (PARTITION BY d, campaign_id ORDER BY ts, event_id)),
spread AS (SELECT *, unnest(generate_series(greatest(0, CAST(ceil((rn - 31) / 16.0) AS BIGINT)), rn // 16)) AS window_id FROM ranked),
dw AS (SELECT d, campaign_id, window_id, least(1.0, (max(depth) * 24 + count(DISTINCT target) * 4 + window_id % 5) / 256.0) AS score FROM spread GROUP BY d, campaign_id, window_id HAVING count(*) = 32 OR (window_id = 0 AND count(*) >= 16)),
per AS (SELECT d, count(*) AS n, avg(CAST(score >= 0.75 AS INTEGER)) AS rate FROM dw GROUP BY 1), tot AS (SELECT count(*) AS n FROM ev WHERE {keep}),
dr AS (SELECT eid, count(*) AS nd FROM ev WHERE {keep} GROUP BY 1)"""


_D_BENIGN = _dropout_sql("CAST(campaign_id AS BIGINT) % 5 >= 2").replace("{label}", "0")
_D_ATTACK = _dropout_sql("CAST(campaign_id AS BIGINT) % 5 = 0").replace("{label}", "1")


def rule(df):
    return df.withColumn("score", staging.rule_score())


def of_kind(spark, sf, benign):
    kind = F.col("campaign_id").cast("long") % 5
    return staging.events(spark, sf).filter(kind >= 2 if benign else kind == 0)


@query("M18_dropout_false_alarms", f"""WITH {_D_BENIGN} SELECT dr.eid, nd AS n_events_dropped, round(nd / tot.n, 9) AS share_events, round(f.rate, 9) AS fp_rate_full, f.n AS n_windows_full, coalesce(per.n, 0) AS n_windows_dropout, round(per.rate, 9) AS fp_rate_dropout,
  round(f.rate - per.rate, 9) AS contribution_to_fp_rate, CASE WHEN per.rate IS NULL THEN 'no windows after dropout' END AS note FROM dr, tot, (SELECT * FROM per WHERE d = -2) f LEFT JOIN per ON per.d = dr.eid""")
def dropout_false_alarms(spark, sf):
    out = A.eid_dropout_fp(of_kind(spark, sf, True), rule, 0.75, ACTIONS)
    return rounded(out, dict.fromkeys(["share_events", "fp_rate_full", "fp_rate_dropout", "contribution_to_fp_rate"], 9))


@query("M19_dropout_detection", f"""WITH {_D_ATTACK} SELECT dr.eid, nd AS n_events_dropped, round(nd / tot.n, 9) AS share_events, round(f.rate, 9) AS detect_rate_full, f.n AS n_windows_full, coalesce(per.n, 0) AS n_attack_windows_dropout, round(per.rate, 9) AS detect_rate_dropout,
  round(f.rate - per.rate, 9) AS contribution_to_detect_rate, CASE WHEN per.rate IS NULL THEN 'no attack windows survived' END AS note FROM dr, tot, (SELECT * FROM per WHERE d = -2) f LEFT JOIN per ON per.d = dr.eid""")
def dropout_detection(spark, sf):
    out = A.eid_dropout_detect(of_kind(spark, sf, False), rule, 0.75, ACTIONS)
    return rounded(out, dict.fromkeys(["share_events", "detect_rate_full", "detect_rate_dropout", "contribution_to_detect_rate"], 9))


def both_sides(spark, sf):
    benign = A.eid_dropout_fp(of_kind(spark, sf, True), rule, 0.75, ACTIONS)
    attack = A.eid_dropout_detect(of_kind(spark, sf, False), rule, 0.75, ACTIONS)
    return benign, attack


def _named(sql, p):
    for n in ["cp", "ranked", "spread", "dw", "per", "tot", "dr"]:
        sql = sql.replace(f"{n} AS (", f"{p}{n} AS (").replace(f"FROM {n} ", f"FROM {p}{n} ").replace(f"FROM {n})", f"FROM {p}{n})")
    return sql


_BOTH = _named(_D_BENIGN, "b") + "," + _named(_D_ATTACK, "a")[len(EV) + 1:]
_CB = f"""{_BOTH}, dep AS (SELECT * FROM (VALUES ('small_office', 10 * 1.0 * 3600 / 16), ('med_business', 50 * 1.5 * 3600 / 16), ('large_business', 200 * 2.0 * 3600 / 16)) v(deployment, w)),
bs AS (SELECT bdr.eid, nd / btot.n AS share, f.rate - p.rate AS c FROM bdr, btot, (SELECT * FROM bper WHERE d = -2) f JOIN bper p ON p.d = bdr.eid),
ats AS (SELECT adr.eid, nd / atot.n AS share, f.rate - p.rate AS c FROM adr, atot, (SELECT * FROM aper WHERE d = -2) f JOIN aper p ON p.d = adr.eid),
cb AS (SELECT deployment, eid, bs.share AS sb, ats.share AS sa, bs.c * w AS saved, ats.c AS lost, bs.c * w - 100 * ats.c AS ranking FROM bs JOIN ats USING (eid), dep)"""


@query("M20_cost_benefit", f"WITH {_CB} SELECT deployment, eid, round(sb, 9) AS share_events_benign, round(sa, 9) AS share_events_attack, round(saved, 6) AS fp_per_hour_saved, round(lost, 9) AS recall_lost, round(ranking, 6) AS ranking_score FROM cb")
def cost_benefit(spark, sf):
    out = E.eid_cost_benefit(*both_sides(spark, sf))
    return rounded(out, {"share_events_benign": 9, "share_events_attack": 9, "fp_per_hour_saved": 6, "recall_lost": 9, "ranking_score": 6})


@query("J8_join_attribution", f"WITH {_CB} SELECT eid, round(bs.share, 9) AS share_events_benign, round(bs.c, 9) AS contribution_to_fp_rate, round(ats.share, 9) AS share_events_attack, round(ats.c, 9) AS contribution_to_detect_rate FROM bs JOIN ats USING (eid)")
def join_attribution(spark, sf):
    out = E.join_attribution(*both_sides(spark, sf))
    return rounded(out, dict.fromkeys(["share_events_benign", "contribution_to_fp_rate", "share_events_attack", "contribution_to_detect_rate"], 9))


@query("T2_ranked_contributions", f"WITH {_CB} SELECT deployment, eid, round(share, 9) AS share_events, round(c, 9) AS contribution_to_fp_rate, round(c * w, 6) AS fp_per_hour FROM bs, dep")
def ranked_contributions(spark, sf):
    out = E.rank_by_abs(E.eid_contributions(both_sides(spark, sf)[0]), "fp_per_hour")
    return rounded(out, {"share_events": 9, "contribution_to_fp_rate": 9, "fp_per_hour": 6})


@query("T3_filter_candidates", f"""WITH {_CB}, r AS (SELECT *, row_number() OVER (PARTITION BY deployment ORDER BY ranking DESC, eid) AS place FROM cb WHERE ranking > 0)
SELECT deployment, eid, CAST(place AS INTEGER) AS place, round(ranking, 6) AS ranking_score FROM r WHERE place <= 2""")
def filter_candidates(spark, sf):
    out = E.filter_candidates(E.eid_cost_benefit(*both_sides(spark, sf)), 2)
    return rounded(out.select("deployment", "eid", "place", "ranking_score"), {"ranking_score": 6})


@query("P32_exclusion_rules", f"""WITH {_CB}, cat AS (SELECT * FROM (VALUES {", ".join("({}, '{}', {}, {}, {})".format(e, g, *(f"'{x}'" for x in p)) for e, g, ps in fixed.EXCLUSION_CATALOG for p in ps)}, (5, 'ProcessTerminate', NULL, NULL, NULL)) v(eid, rule_group, field, condition, value)),
r AS (SELECT *, row_number() OVER (PARTITION BY deployment ORDER BY ranking DESC, eid) AS place FROM cb WHERE ranking > 0)
SELECT deployment, eid, rule_group, field, condition, value, rule_group IS NULL AS skipped FROM r LEFT JOIN cat USING (eid) WHERE place <= 5""")
def exclusion_rules(spark, sf):
    ranked = E.filter_candidates(E.eid_cost_benefit(*both_sides(spark, sf)), 5)
    return E.exclusion_rules(ranked).select("deployment", "eid", "rule_group", "field", "condition", "value", "skipped")


@query("M21_alert_fatigue")
def alert_fatigue(spark, sf):
    cols = M.aggregate_columns(ACTIONS)
    report = reports.alert_fatigue(
        staging.events(spark, sf), staging.manifest(spark, sf), 0.01, ACTIONS, fit=lambda train: M.fit_gbt(train, cols), attribute=True
    )
    return report["deployments"]


@query("benchmark_evaluation")
def benchmark_evaluation(spark, sf):
    sc = scored(spark, sf)
    table = cut_lineage(splits(spark, sf).select("session_id", "split"))
    asked = table.filter(~F.col("split").isin("public_train", "public_dev"))
    scores = sc.join(asked, "session_id", "left_semi").select("session_id", "agent_score")
    report = reports.evaluate_scores(B.truth(sc), scores, table, "heldout", 2.0)
    return report["by_family"]


@query("D7_build_release")
def build_release(spark, sf):
    table = sessions(spark, sf).withColumn("family", F.when(F.col("klass") == "human", "human_real").otherwise(F.col("family")))
    table = table.withColumn("consent_id", F.when(F.col("n_req") % 2 == 0, F.concat(F.lit("k"), F.col("n_req"))))
    consent = table.select("consent_id", F.lit(0.0).alias("ts"), F.lit("v1").alias("consent_text_version")).filter("consent_id is not null").distinct()
    return reports.build_release(cut_lineage(table), consent)["counts"]


@query("serving_quality")
def serving_quality(spark, sf):
    return reports.serving(staging.events(spark, sf), ACTIONS, 0.01)["first_alerts"]
