"""Scores, thresholds, slices and splits."""

from pyspark.sql import functions as F

from alertloom import fixed
from alertloom.operators import slices as S
from alertloom.operators import splits as P
from alertloom.operators import thresholds as T
from alertloom.operators import windows as W
from alertloom.operators.scans import exact_percentiles
from alertloom.plans import staging
from alertloom.session import cut_lineage
from catalog.registry import EV, MEMBERS, SCORED, WINDOWS, WSCORED, list_sql, query
from catalog.windows import features, members, rounded

TAU = 0.5
WTAU = 0.75


def scored(spark, sf):
    return staging.scored(spark, sf)


def scored_windows(spark, sf):
    """Windows with the fixed rule score and their manifest columns."""
    win = features(spark, sf).withColumn("score", staging.rule_score())
    return win.join(staging.manifest(spark, sf), "campaign_id", "left")


RUN = """tab AS (SELECT {s} AS s, count(*) FILTER (WHERE {y} = 1) AS pos, count(*) FILTER (WHERE {y} = 0) AS neg FROM {t} GROUP BY 1),
run AS (SELECT *, sum(pos) OVER o AS tp, sum(neg) OVER o AS fp, row_number() OVER o AS k FROM tab WINDOW o AS (ORDER BY s DESC))"""
RUN_SC = RUN.format(s="agent_score", y="y", t="sc")
RUN_WS = RUN.format(s="score", y="label", t="ws")


@query("J7_with_scores", f"""WITH {SCORED}
SELECT session_id, y, family, CASE WHEN CAST(session_id AS BIGINT) % 3 = 0 THEN 0.0 ELSE agent_score END AS agent_score FROM sc""")
def with_scores(spark, sf):
    sc = scored(spark, sf)
    scores = sc.filter(F.col("session_id").cast("long") % 3 != 0).select("session_id", "agent_score")
    return S.with_scores(sc.select("session_id", "y", "family"), scores)


@query("W5_average_precision", f"""WITH {SCORED}, {RUN_SC}
SELECT CAST(sum(pos) AS BIGINT) AS n_pos, CAST(sum(neg) AS BIGINT) AS n_neg, round(sum(pos * tp / (tp + fp)) / sum(pos), 9) AS pr_auc FROM run""")
def average_precision(spark, sf):
    return rounded(T.average_precision(scored(spark, sf), "y", "agent_score"), {"pr_auc": 9})


@query("W5_average_precision_windows", f"""WITH {WSCORED}, {RUN_WS}
SELECT CAST(sum(pos) AS BIGINT) AS n_pos, CAST(sum(neg) AS BIGINT) AS n_neg, round(sum(pos * tp / (tp + fp)) / sum(pos), 9) AS pr_auc FROM run""")
def average_precision_windows(spark, sf):
    return rounded(T.average_precision(scored_windows(spark, sf), "label"), {"pr_auc": 9})


@query("W6_pr_curve", f"""WITH {SCORED}, {RUN_SC},
tot AS (SELECT count(*) AS t, sum(pos) AS p FROM tab),
pts AS (SELECT t - k AS idx, s AS threshold, tp / (tp + fp) AS precision, tp / p AS recall FROM run, tot
        UNION ALL SELECT t, NULL, 1.0, 0.0 FROM tot)
SELECT idx, threshold, round(precision, 9) AS precision, round(recall, 9) AS recall FROM pts, tot
WHERE idx % greatest(1, (t + 1) // 20) = 0""")
def pr_curve(spark, sf):
    return rounded(T.pr_curve(scored(spark, sf), "y", "agent_score"), {"precision": 9, "recall": 9})


@query("W7_tau_for_budget", f"""WITH {SCORED}, {RUN_SC}, h AS (SELECT sum(greatest(duration_s, 0)) / 3600 AS hours FROM sc),
p AS (SELECT min(s) FILTER (WHERE fp <= 0.5 * hours) AS t, max(fp) FILTER (WHERE fp <= 0.5 * hours) AS f,
             sum(neg) FILTER (WHERE s >= 1) AS top, max(hours) AS hours FROM run, h)
SELECT coalesce(t, 1.0) AS threshold, CAST(coalesce(CASE WHEN t IS NOT NULL THEN f ELSE top END, 0) AS BIGINT) AS fp_count,
       round(coalesce(CASE WHEN t IS NOT NULL THEN f ELSE top END, 0) / greatest(hours, 1e-9), 6) AS fp_per_hour, round(hours, 6) AS hours FROM p""")
def tau_for_budget(spark, sf):
    sc = scored(spark, sf)
    return rounded(T.tau_for_budget(sc, T.session_hours(sc), 0.5, "y", "agent_score"), {"fp_per_hour": 6, "hours": 6})


_SPW = """spw AS (SELECT greatest(1.0, 32 * coalesce(nullif(greatest(median(dt_median) FILTER (WHERE label = 0), 0), 0),
       nullif(greatest(median(dt_median), 0), 0), 1.0)) AS spw FROM win)"""


@query("W7_tau_for_budget_windows", f"""WITH {WSCORED}, {RUN_WS}, {_SPW},
h AS (SELECT count(*) FILTER (WHERE label = 0) * max(spw) / 3600 AS hours FROM ws, spw),
p AS (SELECT min(s) FILTER (WHERE fp <= 0.002 * hours) AS t, max(fp) FILTER (WHERE fp <= 0.002 * hours) AS f, max(hours) AS hours FROM run, h)
SELECT coalesce(t, 1.0) AS threshold, CAST(coalesce(f, 0) AS BIGINT) AS fp_count, round(coalesce(f, 0) / hours, 6) AS fp_per_hour, round(hours, 4) AS hours FROM p""")
def tau_for_budget_windows(spark, sf):
    ws = cut_lineage(scored_windows(spark, sf))
    hours = T.window_hours(ws, W.secs_per_window(ws), benign_only=True)
    return rounded(T.tau_for_budget(ws, hours, 0.002, "label"), {"fp_per_hour": 6, "hours": 4})


@query("W8_tau_for_budget_quantile", f"""WITH {WSCORED}, {_SPW},
g AS (SELECT DISTINCT unnest((SELECT quantile_cont(score, {list_sql([i / 200 for i in range(201)])}) FROM ws)) AS th),
f AS (SELECT th, (SELECT count(*) FROM ws WHERE score >= th AND label = 0) / ((SELECT count(*) FROM ws) * spw / 3600 + 1e-9) AS fph FROM g, spw),
ok AS (SELECT * FROM f WHERE fph <= 0.002 ORDER BY th LIMIT 1)
SELECT round(coalesce((SELECT th FROM ok), (SELECT max(th) FROM g)), 9) AS threshold,
       round(coalesce((SELECT fph FROM ok), 'inf'::DOUBLE), 9) AS fp_per_hour""")
def tau_for_budget_quantile(spark, sf):
    ws = cut_lineage(scored_windows(spark, sf))
    out = T.tau_for_budget_quantile(ws, W.secs_per_window(ws), 0.002, "label")
    return rounded(out, {"threshold": 9, "fp_per_hour": 9})


_GRID = "grid AS (SELECT unnest({g}::DOUBLE[]) AS tau), cnt AS (SELECT tau, count(*) FILTER (WHERE {s} >= tau AND {y} = 1) AS tp, " \
    "count(*) FILTER (WHERE {s} >= tau AND {y} = 0) AS fp, count(*) FILTER (WHERE {y} = 1) AS np, count(*) FILTER (WHERE {y} = 0) AS nn FROM {t}, grid GROUP BY tau)"


@query("W9_tau_best_f1", f"""WITH {SCORED}, {_GRID.format(g=list_sql(T.F1_GRID), s="agent_score", y="y", t="sc")},
f AS (SELECT tau, CASE WHEN tp = 0 THEN 0 ELSE 2 * (tp / (tp + fp)) * (tp / np) / ((tp / (tp + fp)) + (tp / np)) END AS f1 FROM cnt)
SELECT tau AS threshold, round(f1, 9) AS f1 FROM f ORDER BY round(f1, 12) DESC, tau LIMIT 1""")
def tau_best_f1(spark, sf):
    return rounded(T.tau_best_f1(scored(spark, sf), "y", "agent_score"), {"f1": 9})


_DEPS = "dep AS (SELECT * FROM (VALUES " + ", ".join(f"('{n}', {h}, {r}::DOUBLE)" for n, h, r in fixed.DEPLOYMENTS) + \
    ") v(deployment, hosts, events_per_sec_per_host)), depw AS (SELECT *, hosts * events_per_sec_per_host * 3600 / 16 AS windows_per_hour FROM dep)"
_SWEEP = f"""{_GRID.format(g=list_sql(T.SWEEP_GRID), s="score", y="label", t="ws")}, {_DEPS},
curve AS (SELECT tau, tp / np AS detect_rate, fp / nn AS fp_rate, depw.*, fp / nn * windows_per_hour AS fp_per_hour FROM cnt, depw)"""


@query("W10_sweep_tau", f"""WITH {WSCORED}, {_SWEEP}
SELECT * REPLACE (round(detect_rate, 9) AS detect_rate, round(fp_rate, 9) AS fp_rate, round(fp_per_hour, 6) AS fp_per_hour) FROM curve""")
def sweep_tau(spark, sf):
    return rounded(T.sweep_tau(scored_windows(spark, sf)), {"detect_rate": 9, "fp_rate": 9, "fp_per_hour": 6})


@query("W11_pareto_front", f"""WITH {WSCORED}, {_SWEEP},
b AS (SELECT *, min(fp_per_hour) OVER (PARTITION BY deployment ORDER BY detect_rate DESC, fp_per_hour, tau ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM curve)
SELECT deployment, tau, round(detect_rate, 9) AS detect_rate, round(fp_per_hour, 6) AS fp_per_hour FROM b WHERE best IS NULL OR fp_per_hour < best""")
def pareto_front(spark, sf):
    front = T.pareto(T.sweep_tau(scored_windows(spark, sf))).select("deployment", "tau", "detect_rate", "fp_per_hour")
    return rounded(front, {"detect_rate": 9, "fp_per_hour": 6})


@query("W12_pick_composite", f"""WITH {WSCORED}, {_SWEEP},
c AS (SELECT *, detect_rate - fp_per_hour * (10.0 / 100.0) AS composite FROM curve),
r AS (SELECT *, row_number() OVER (PARTITION BY deployment ORDER BY composite DESC, tau) AS r FROM c)
SELECT deployment, tau, round(composite, 6) AS composite, round(detect_rate, 9) AS detect_rate, round(fp_per_hour, 6) AS fp_per_hour FROM r WHERE r = 1""")
def pick_composite(spark, sf):
    out = T.pick_composite(T.sweep_tau(scored_windows(spark, sf)), 10.0)
    return rounded(out, {"composite": 6, "detect_rate": 9, "fp_per_hour": 6})


@query("W13_latest_per_key", f"""WITH {EV}, r AS (SELECT *, row_number() OVER (PARTITION BY campaign_id, action ORDER BY floor(ts / 86400) DESC, event_id DESC) AS r FROM ev)
SELECT campaign_id, action, event_id, target FROM r WHERE r = 1""")
def latest_per_key(spark, sf):
    rows = staging.events(spark, sf).withColumn("day", F.floor(F.col("ts") / 86400))
    return S.latest_per_key(rows, ["campaign_id", "action"], ["day", "event_id"]).select("campaign_id", "action", "event_id", "target")


@query("W14_rank_leaderboard", f"""WITH {SCORED}, e AS (SELECT session_id AS submission_hash, 'v1' AS splits_version, target_app AS split,
  CAST(CAST(session_id AS BIGINT) % 2 AS INTEGER) AS seed, CASE WHEN CAST(session_id AS BIGINT) % 9 = 0 THEN NULL ELSE agent_score END AS pr_auc FROM sc)
SELECT *, row_number() OVER (PARTITION BY splits_version, split, seed ORDER BY pr_auc DESC NULLS LAST, submission_hash) AS rank FROM e""")
def rank_leaderboard(spark, sf):
    number = F.col("session_id").cast("long")
    entries = scored(spark, sf).select(
        F.col("session_id").alias("submission_hash"), F.lit("v1").alias("splits_version"), F.col("target_app").alias("split"),
        (number % 2).cast("int").alias("seed"), F.when(number % 9 != 0, F.col("agent_score")).alias("pr_auc"),
    )
    return S.rank_leaderboard(entries, "pr_auc")


@query("W15_first_alert", f"""WITH {WSCORED}, odd AS (SELECT *, CAST(event_id % 7 = 0 AND label = 1 AS INTEGER) AS lab FROM ev),
a AS (SELECT campaign_id, min(end_ts) FILTER (WHERE score >= {WTAU}) AS alert_ts FROM ws GROUP BY 1),
s AS (SELECT campaign_id, max(lab) AS is_attack, coalesce(min(ts) FILTER (WHERE lab = 1), min(ts)) AS onset_ts FROM odd GROUP BY 1)
SELECT campaign_id, is_attack, onset_ts, alert_ts, alert_ts IS NOT NULL AS detected, alert_ts - onset_ts AS mttd_s FROM s LEFT JOIN a USING (campaign_id)""")
def first_alert(spark, sf):
    ev = staging.events(spark, sf).withColumn("label", ((F.col("event_id") % 7 == 0) & (F.col("label") == 1)).cast("int"))
    return T.first_alert(scored_windows(spark, sf), ev, WTAU)


@query("W16_consecutive_flag", f"""WITH {WSCORED}, n AS (SELECT campaign_id, count(*) AS n_req, max(ts) - min(ts) AS d FROM ev GROUP BY 1),
t AS (SELECT campaign_id AS session_id, window_id + 1 AS tick, window_id * 16 + 32 AS seen, n_req, d, score FROM ws JOIN n USING (campaign_id)),
h AS (SELECT *, score >= {WTAU} AND lag(score) OVER (PARTITION BY session_id ORDER BY tick) >= {WTAU} AS two FROM t),
f AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY tick) AS r FROM h WHERE two)
SELECT session_id, tick, round(seen / n_req * d, 4) AS flag_after_s FROM f WHERE r = 1""")
def consecutive_flag(spark, sf):
    sizes = staging.events(spark, sf).groupBy("campaign_id").agg(
        F.count(F.lit(1)).alias("n_req"), (F.max("ts") - F.min("ts")).alias("duration_s")
    )
    ticks = scored_windows(spark, sf).join(sizes, "campaign_id").select(
        F.col("campaign_id").alias("session_id"), (F.col("window_id") + 1).alias("tick"),
        (F.col("window_id") * 16 + 32).alias("seen"), "n_req", "duration_s", "score",
    )
    return rounded(T.consecutive_flag(ticks, WTAU), {"flag_after_s": 4})


@query("W18_top_events", f"""WITH {MEMBERS}, kept AS (SELECT campaign_id, window_id FROM members GROUP BY ALL HAVING count(*) = 32 OR (window_id = 0 AND count(*) >= 16)),
w AS (SELECT campaign_id, window_id, pos, action, tactic, depth * 64 + artifact_ai AS weight FROM members JOIN kept USING (campaign_id, window_id)),
r AS (SELECT *, row_number() OVER (PARTITION BY campaign_id, window_id ORDER BY weight DESC, pos DESC) AS r FROM w)
SELECT campaign_id, window_id, pos, action, tactic, weight, CAST(row_number() OVER (PARTITION BY campaign_id, window_id ORDER BY pos) AS INTEGER) AS span_pos FROM r WHERE r <= 3""")
def top_events(spark, sf):
    m = members(spark, sf)
    kept = W.count_windows(staging.events(spark, sf)).select("campaign_id", "window_id")
    weights = m.join(kept, ["campaign_id", "window_id"]).select(
        "campaign_id", "window_id", "pos", "action", "tactic", (F.col("depth") * 64 + F.col("artifact_ai")).alias("weight")
    )
    return T.top_events(weights, 3)


@query("T4_top_windows", f"""WITH {WSCORED} SELECT campaign_id, window_id, score FROM ws WHERE label = 1 ORDER BY score DESC, campaign_id, window_id LIMIT 3""")
def top_windows(spark, sf):
    return T.top_windows(scored_windows(spark, sf)).select("campaign_id", "window_id", "score")


@query("M15_precision_recall_f1", f"""WITH {SCORED}, c AS (SELECT count(*) FILTER (WHERE agent_score >= {TAU} AND y = 1) AS tp, count(*) FILTER (WHERE agent_score >= {TAU} AND y = 0) AS fp,
  count(*) FILTER (WHERE agent_score < {TAU} AND y = 1) AS fn, count(*) FILTER (WHERE agent_score < {TAU} AND y = 0) AS tn FROM sc),
m AS (SELECT *, CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END AS precision, CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn) END AS recall FROM c)
SELECT tp, fp, fn, tn, round(precision, 9) AS precision, round(recall, 9) AS recall,
       round(CASE WHEN tp = 0 THEN 0 ELSE 2 * precision * recall / (precision + recall) END, 9) AS f1 FROM m""")
def precision_recall(spark, sf):
    return rounded(T.prf(scored(spark, sf), TAU, "y", "agent_score"), {"precision": 9, "recall": 9, "f1": 9})


@query("M16_fp_per_hour", f"""WITH {WSCORED}, {_SPW}, c AS (SELECT count(*) FILTER (WHERE score >= {WTAU} AND label = 0) AS n_fp, count(*) * max(spw) / 3600 AS hours FROM ws, spw)
SELECT n_fp, round(hours, 4) AS hours, round(n_fp / greatest(hours, 1e-9), 9) AS fp_per_hour FROM c""")
def fp_per_hour(spark, sf):
    from alertloom.operators.scans import attach_row

    ws = cut_lineage(scored_windows(spark, sf))
    n_fp = ws.agg(F.count_if((F.col("score") >= WTAU) & (F.col("label") == 0)).alias("n_fp"))
    both = attach_row(n_fp, T.window_hours(ws, W.secs_per_window(ws)))
    return rounded(both.withColumn("fp_per_hour", T.fp_hour(F.col("n_fp"), F.col("hours"))), {"hours": 4, "fp_per_hour": 9})


@query("A39_session_hours", f"WITH {SCORED} SELECT round(sum(greatest(duration_s, 0)) / 3600, 6) AS hours FROM sc")
def session_hours(spark, sf):
    return rounded(T.session_hours(scored(spark, sf)), {"hours": 6})


@query("exact_percentiles", f"""WITH {SCORED}, q AS (SELECT target_app, unnest([0.1, 0.5, 0.95]) AS prob, unnest(quantile_cont(agent_score, [0.1, 0.5, 0.95])) AS value FROM sc GROUP BY target_app)
SELECT target_app, prob::DOUBLE AS prob, round(value, 9) AS value FROM q""")
def percentiles(spark, sf):
    return rounded(exact_percentiles(scored(spark, sf), "agent_score", [0.1, 0.5, 0.95], ["target_app"]), {"value": 9})


@query("A13_rate_by_source", f"""WITH {SCORED} SELECT src_label, count(*) AS n, count(*) FILTER (WHERE agent_score >= {TAU}) AS alerts,
  round(count(*) FILTER (WHERE agent_score >= {TAU}) / count(*), 9) AS alert_rate, CASE WHEN max(y) = 1 THEN 'agent' ELSE 'benign' END AS kind FROM sc GROUP BY 1""")
def rate_by_source(spark, sf):
    return rounded(S.rate_by_source(scored(spark, sf), TAU), {"alert_rate": 9})


_RATES = {"alert_rate": 9, "recall_if_agent": 9, "fp_rate_if_benign": 9}


@query("A14_rate_by_family", f"""WITH {SCORED}, kc AS (SELECT family, klass, count(*) AS c FROM sc GROUP BY ALL),
k AS (SELECT family, klass AS kind FROM (SELECT *, row_number() OVER (PARTITION BY family ORDER BY c DESC, klass) AS r FROM kc) WHERE r = 1),
a AS (SELECT family, count(*) AS n, count(*) FILTER (WHERE agent_score >= {TAU}) AS alerts FROM sc GROUP BY 1)
SELECT family, n, alerts, round(alerts / n, 9) AS alert_rate, kind, CASE WHEN kind = 'agent' THEN round(alerts / n, 9) END AS recall_if_agent,
       CASE WHEN kind IN ('benign_bot', 'human') THEN round(alerts / n, 9) END AS fp_rate_if_benign FROM a JOIN k USING (family)""")
def rate_by_family(spark, sf):
    return rounded(S.rate_by_family(scored(spark, sf), TAU), _RATES)


@query("A15_rate_by_target", f"""WITH {SCORED} SELECT target_app, count(*) AS n, count(*) FILTER (WHERE agent_score >= {TAU}) AS alerts, count(*) FILTER (WHERE y = 1) AS n_agent_truth,
  count(*) FILTER (WHERE y = 0) AS n_benign_truth, round(count(*) FILTER (WHERE agent_score >= {TAU}) / count(*), 9) AS alert_rate FROM sc GROUP BY 1""")
def rate_by_target(spark, sf):
    return rounded(S.rate_by_target(scored(spark, sf), TAU), {"alert_rate": 9})


@query("A16_rate_by_stealth", f"""WITH {SCORED}, g AS (SELECT family, stealth, count(*) AS n, count(*) FILTER (WHERE agent_score >= {TAU}) AS alerts, count(*) FILTER (WHERE y = 1) AS n_agent_truth,
  count(*) FILTER (WHERE y = 0) AS n_benign_truth, CASE WHEN family IS NOT NULL THEN arg_min(klass, session_id) END AS kind FROM sc GROUP BY GROUPING SETS ((stealth), (family, stealth)))
SELECT *, round(alerts / n, 9) AS alert_rate, CASE WHEN kind = 'agent' THEN round(alerts / n, 9) END AS recall_if_agent,
       CASE WHEN kind IN ('benign_bot', 'human') THEN round(alerts / n, 9) END AS fp_rate_if_benign FROM g""")
def rate_by_stealth(spark, sf):
    return rounded(S.rate_by_stealth(scored(spark, sf), TAU), _RATES)


@query("A17_agent_vs_benign", f"""WITH {SCORED}, c AS (SELECT count(*) FILTER (WHERE klass = 'agent' AND agent_score >= {TAU}) AS agent_alert, count(*) FILTER (WHERE klass = 'agent' AND agent_score < {TAU}) AS agent_miss,
  count(*) FILTER (WHERE klass = 'benign_bot' AND agent_score >= {TAU}) AS benign_bot_alert, count(*) FILTER (WHERE klass = 'benign_bot' AND agent_score < {TAU}) AS benign_bot_quiet FROM sc)
SELECT *, round(agent_alert / nullif(agent_alert + agent_miss, 0), 9) AS agent_recall, round(benign_bot_alert / nullif(benign_bot_alert + benign_bot_quiet, 0), 9) AS benign_bot_fp_rate FROM c""")
def agent_vs_benign(spark, sf):
    return rounded(S.agent_vs_benign(scored(spark, sf), TAU), {"agent_recall": 9, "benign_bot_fp_rate": 9})


@query("A17_benign_family_fp", f"""WITH {SCORED} SELECT family, count(*) AS n, count(*) FILTER (WHERE agent_score >= {TAU}) AS false_positives,
  round(count(*) FILTER (WHERE agent_score >= {TAU}) / count(*), 9) AS fp_rate FROM sc WHERE klass = 'benign_bot' GROUP BY 1""")
def benign_family_fp(spark, sf):
    return rounded(S.benign_family_fp(scored(spark, sf), TAU), {"fp_rate": 9})


_LLM = "lm AS (SELECT *, regexp_extract(family, '^llm_(openai|anthropic)_(.+)$', 1) AS backend, regexp_extract(family, '^llm_(openai|anthropic)_(.+)$', 2) AS model FROM sc WHERE regexp_matches(family, '^llm_(openai|anthropic)_(.+)$'))"


@query("A18_rate_by_backend", f"""WITH {SCORED}, {_LLM} SELECT backend, count(*) AS n, count(*) FILTER (WHERE agent_score >= {TAU}) AS alerts, count(*) FILTER (WHERE y = 1) AS n_agent_truth,
  count(DISTINCT target_app) AS n_target_apps, count(DISTINCT model) AS n_models, round(count(*) FILTER (WHERE agent_score >= {TAU}) / count(*), 9) AS alert_rate,
  round(count(*) FILTER (WHERE agent_score >= {TAU} AND y = 1) / nullif(count(*) FILTER (WHERE y = 1), 0), 9) AS recall FROM lm GROUP BY 1""")
def rate_by_backend(spark, sf):
    out = S.rate_by_backend(scored(spark, sf), TAU)
    return rounded(out, {"alert_rate": 9, "recall": 9})


@query("A19_rate_by_model_target", f"""WITH {SCORED}, {_LLM} SELECT backend, model, target_app, count(*) AS n, count(*) FILTER (WHERE agent_score >= {TAU}) AS alerts, count(*) FILTER (WHERE y = 1) AS n_agent_truth,
  round(count(*) FILTER (WHERE agent_score >= {TAU} AND y = 1) / nullif(count(*) FILTER (WHERE y = 1), 0), 9) AS recall, bool_or(stealth) AS stealth_seen,
  round(count(*) FILTER (WHERE agent_score >= {TAU}) / count(*), 9) AS alert_rate FROM lm GROUP BY ALL""")
def rate_by_model_target(spark, sf):
    return rounded(S.rate_by_model_target(scored(spark, sf), TAU), {"alert_rate": 9, "recall": 9})




@query("A21_recall_by_tactic", f"""WITH {WSCORED},
cnt AS (SELECT campaign_id, window_id, tactic, count(*) AS c FROM members WHERE tactic <> '' GROUP BY ALL),
best AS (SELECT campaign_id, window_id, tactic FROM (SELECT *, row_number() OVER (PARTITION BY campaign_id, window_id ORDER BY c DESC, tactic) AS r FROM cnt) WHERE r = 1),
t AS (SELECT tactic, count(*) AS n, count(*) FILTER (WHERE score >= {WTAU}) AS flagged FROM ws JOIN best USING (campaign_id, window_id) WHERE label = 1 GROUP BY 1)
SELECT tactic, n, flagged, round(flagged / n, 9) AS recall FROM t UNION ALL SELECT '(macro)', CAST(sum(n) AS BIGINT), CAST(sum(flagged) AS BIGINT), round(avg(flagged / n), 9) FROM t HAVING count(*) > 0""")
def recall_by_tactic(spark, sf):
    tactics = W.window_tactic(members(spark, sf))
    ws = scored_windows(spark, sf).join(tactics, ["campaign_id", "window_id"])
    return rounded(S.recall_by_tactic(ws, WTAU), {"recall": 9})


@query("A22_recall_by_mode", f"""WITH {WSCORED}, m AS (SELECT *, {list_sql(fixed.ATTACK_MODES)}[CAST(campaign_id AS BIGINT) // 5 % 4 + 1] AS mode FROM ws),
k AS (SELECT unnest({list_sql(fixed.ATTACK_MODES)}) AS mode)
SELECT k.mode, count(score) FILTER (WHERE label = 1) AS n, round(count(*) FILTER (WHERE label = 1 AND score >= {WTAU}) / nullif(count(score) FILTER (WHERE label = 1), 0), 9) AS recall
FROM k LEFT JOIN m ON k.mode = m.mode GROUP BY 1""")
def recall_by_mode(spark, sf):
    at = (F.floor(F.col("campaign_id").cast("long") / 5) % 4 + 1).cast("int")
    mode = F.element_at(F.array(*[F.lit(m) for m in fixed.ATTACK_MODES]), at)
    return rounded(S.recall_by_mode(scored_windows(spark, sf).withColumn("mode", mode), WTAU), {"recall": 9})


@query("A42_label_counts", f"WITH {SCORED} SELECT src_label, count(*) AS n FROM sc GROUP BY 1")
def label_counts(spark, sf):
    return S.label_counts(scored(spark, sf))


@query("A42_axes", f"""WITH {SCORED} SELECT DISTINCT * FROM (SELECT unnest([{{axis: 'target_app', value: target_app}}, {{axis: 'family', value: family}}, {{axis: 'stealth', value: CAST(stealth AS VARCHAR)}}], recursive := true) FROM sc)""")
def axes(spark, sf):
    return S.axes(scored(spark, sf), ["target_app", "family", "stealth"])


@query("A31_release_counts", f"""WITH {SCORED} SELECT 'by_class' AS axis, klass AS value, count(*) AS n FROM sc GROUP BY ALL UNION ALL SELECT 'by_family', family, count(*) FROM sc GROUP BY ALL
UNION ALL SELECT 'by_target_app', target_app, count(*) FROM sc GROUP BY ALL UNION ALL SELECT 'by_stealth', CASE WHEN stealth THEN 'stealth=true' ELSE 'stealth=false' END, count(*) FROM sc GROUP BY ALL
UNION ALL SELECT 'total', '', count(*) FROM sc""")
def release_counts(spark, sf):
    return S.release_counts(scored(spark, sf))


@query("A40_seed_summary", f"""WITH {SCORED}, runs AS (SELECT unnest([{{metric: 'score', value: agent_score}}, {{metric: 'hours', value: duration_s}}], recursive := true), CAST(session_id AS BIGINT) % 50 AS seed FROM sc),
r AS (SELECT metric, seed, sum(value) AS value FROM runs GROUP BY ALL)
SELECT metric, count(*) AS n_runs, round(avg(value), 6) AS mean, round(stddev_pop(value), 5) AS std, min(value) AS min, max(value) AS max FROM r GROUP BY 1""")
def seed_summary(spark, sf):
    pair = F.array(F.struct(F.lit("score").alias("metric"), F.col("agent_score").alias("value")), F.struct(F.lit("hours").alias("metric"), F.col("duration_s").alias("value")))
    runs = scored(spark, sf).select((F.col("session_id").cast("long") % 50).alias("seed"), F.explode(pair).alias("p")).groupBy("p.metric", "seed").agg(F.sum("p.value").alias("value"))
    return rounded(S.seed_summary(runs), {"mean": 6, "std": 5})


@query("M23_lift_table", f"""WITH {WSCORED}, l AS (SELECT label AS y, unnest([{{model: 'score', s: score}}, {{model: 'ai', s: ai_artifact_mean}}], recursive := true) FROM ws),
tab AS (SELECT model, s, count(*) FILTER (WHERE y = 1) AS pos, count(*) FILTER (WHERE y = 0) AS neg FROM l GROUP BY ALL),
run AS (SELECT *, sum(pos) OVER o AS tp, sum(neg) OVER o AS fp FROM tab WINDOW o AS (PARTITION BY model ORDER BY s DESC)),
ap AS (SELECT model, CAST(sum(pos) AS BIGINT) AS n_pos, CAST(sum(neg) AS BIGINT) AS n_neg, sum(pos * tp / (tp + fp)) / sum(pos) AS v FROM run GROUP BY 1)
SELECT model, n_pos, n_neg, round(v, 9) AS pr_auc, round(v - (SELECT v FROM ap WHERE model = 'ai'), 9) AS lift FROM ap""")
def lift_table(spark, sf):
    ws = scored_windows(spark, sf).withColumn("ai", F.col("ai_artifact_mean"))
    return rounded(S.lift_table(ws, ["score", "ai"], "ai"), {"pr_auc": 9, "lift": 9})


@query("M1_group_split", f"""WITH {EV}, g AS (SELECT campaign_id, row_number() OVER (ORDER BY substr(md5('7:' || campaign_id), 1, 13), campaign_id) AS r, count(*) OVER () AS n FROM (SELECT DISTINCT campaign_id FROM ev))
SELECT event_id, campaign_id, CASE WHEN r <= ceil(n * 0.25) THEN 'test' ELSE 'train' END AS fold FROM ev JOIN g USING (campaign_id)""")
def group_split(spark, sf):
    return P.group_split(staging.events(spark, sf).select("event_id", "campaign_id"), "campaign_id", 0.25, 7)


@query("M2_stratified_split", f"""WITH {WSCORED}, r AS (SELECT campaign_id, class, framework, benign_subtype, row_number() OVER (PARTITION BY class, framework, benign_subtype ORDER BY substr(md5('0:' || campaign_id), 1, 13), campaign_id) AS r,
  count(*) OVER (PARTITION BY class, framework, benign_subtype) AS n FROM man)
SELECT campaign_id, class, framework, benign_subtype, CASE WHEN n = 1 OR r <= least(greatest(1, floor(n * 0.75)), n - 1) THEN 'train' ELSE 'eval' END AS fold FROM r""")
def stratified_split(spark, sf):
    return P.stratified_split(staging.manifest(spark, sf)).select("campaign_id", "class", "framework", "benign_subtype", "fold")


_SPLITS = """fam AS (SELECT family, bool_or(stealth) AS q, bool_or(NOT stealth) AS l,
   coalesce(nullif(regexp_extract(family, '^llm_(openai|anthropic)_(.+)$', 1), ''), family) = 'openai' AS sup FROM sc WHERE klass = 'agent' AND family <> '' GROUP BY 1),
el AS (SELECT family, row_number() OVER (ORDER BY substr(md5('3:' || family), 1, 13), family) AS r, count(*) OVER () AS e FROM fam WHERE NOT sup),
rol AS (SELECT fam.family, sup OR coalesce(r > e - 2, false) AS held, q AND l AS mixed FROM fam LEFT JOIN el USING (family)),
pl AS (SELECT sc.*, CASE WHEN held THEN 'private_heldout_family' WHEN NOT held AND mixed AND stealth THEN 'private_heldout_stealth' END AS sp FROM sc LEFT JOIN rol USING (family)),
pool AS (SELECT *, row_number() OVER (ORDER BY substr(md5('3+1:' || session_id), 1, 13), session_id) AS r, count(*) OVER () AS n FROM pl WHERE sp IS NULL),
spl AS (SELECT session_id, family, klass, CASE WHEN r <= round_even(n * 0.6, 0) THEN 'public_train' WHEN r <= round_even(n * 0.6, 0) + round_even(n * 0.2, 0) THEN 'public_dev' ELSE 'public_test' END AS split FROM pool
        UNION ALL SELECT session_id, family, klass, sp FROM pl WHERE sp IS NOT NULL)"""


def splits(spark, sf):
    return P.benchmark_splits(scored(spark, sf), 3, 2, "openai")


@query("M3_benchmark_splits", f"WITH {SCORED}, {_SPLITS} SELECT session_id, split FROM spl")
def benchmark_splits(spark, sf):
    return splits(spark, sf).select("session_id", "split")


@query("A30_split_summary", f"""WITH {SCORED}, {_SPLITS}
SELECT split, count(*) AS n, CAST(CAST(sum(CAST('0x' || substr(sha256(session_id), 1, 13) AS BIGINT)) AS HUGEINT) AS VARCHAR) AS ids_checksum,
       CAST(CAST(sum(CAST('0x' || substr(sha256(session_id), 14, 13) AS BIGINT)) AS HUGEINT) AS VARCHAR) AS ids_checksum_2 FROM spl GROUP BY 1""")
def split_summary(spark, sf):
    return P.split_summary(splits(spark, sf))


@query("A30_split_counts", f"""WITH {SCORED}, {_SPLITS} SELECT split, 'family' AS axis, family AS value, count(*) AS n FROM spl GROUP BY ALL UNION ALL SELECT split, 'class', klass, count(*) FROM spl GROUP BY ALL""")
def split_counts(spark, sf):
    return P.split_counts(splits(spark, sf))


@query("U2_split_overlaps", f"""WITH {SCORED}, {_SPLITS}, twice AS (SELECT session_id, split FROM spl UNION ALL SELECT session_id, 'public_dev' FROM sc WHERE CAST(session_id AS BIGINT) % 11 = 0)
SELECT session_id, count(DISTINCT split) AS n_splits FROM twice GROUP BY 1 HAVING count(DISTINCT split) > 1""")
def split_overlaps(spark, sf):
    extra = scored(spark, sf).filter(F.col("session_id").cast("long") % 11 == 0).select("session_id", F.lit("public_dev").alias("split"))
    return P.overlaps(splits(spark, sf).select("session_id", "split").unionByName(extra))


@query("U3_set_diff", f"""WITH {SCORED}, a AS (SELECT session_id FROM sc WHERE CAST(session_id AS BIGINT) % 3 <> 0), b AS (SELECT session_id FROM sc WHERE CAST(session_id AS BIGINT) % 5 <> 0)
SELECT session_id, 'missing' AS kind FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT session_id, 'extra' FROM (SELECT * FROM b EXCEPT SELECT * FROM a)
UNION ALL SELECT session_id, 'common' FROM (SELECT * FROM a INTERSECT SELECT * FROM b)""")
def set_diff(spark, sf):
    sc = scored(spark, sf).select("session_id", F.col("session_id").cast("long").alias("k"))
    return P.set_diff(sc.filter(F.col("k") % 3 != 0), sc.filter(F.col("k") % 5 != 0))


@query("J13_in_split", f"WITH {SCORED}, {_SPLITS} SELECT sc.session_id, y FROM sc JOIN spl USING (session_id) WHERE split = 'public_test'")
def in_split(spark, sf):
    return S.in_split(scored(spark, sf), splits(spark, sf), "public_test").select("session_id", "y")


@query("J14_leave_out", f"WITH {SCORED} SELECT session_id, 'held_out' AS side FROM sc WHERE family = 'src2' UNION ALL SELECT session_id, 'train' FROM sc WHERE family <> 'src2'")
def leave_out(spark, sf):
    train, held = S.leave_out(scored(spark, sf), F.col("family") == "src2")
    return train.select("session_id", F.lit("train").alias("side")).unionByName(held.select("session_id", F.lit("held_out").alias("side")))


@query("M5_class_weight", f"WITH {SCORED}, p AS (SELECT avg(y) AS p FROM sc) SELECT session_id, y, round(CASE WHEN y = 1 THEN (1 - p) / p ELSE 1 END, 9) AS weight FROM sc, p")
def class_weight(spark, sf):
    return rounded(P.class_weight(scored(spark, sf).select("session_id", "y"), "y"), {"weight": 9})


@query("M8_standardize", f"""WITH {WINDOWS}, s AS (SELECT avg(dt_mean) AS m1, stddev_pop(dt_mean) AS s1, avg(ai_artifact_mean) AS m2, stddev_pop(ai_artifact_mean) AS s2 FROM win WHERE CAST(campaign_id AS BIGINT) % 2 = 0)
SELECT campaign_id, window_id, round((dt_mean - m1) / CASE WHEN s1 < 1e-6 THEN 1 ELSE s1 END, 7) AS dt_mean, round((ai_artifact_mean - m2) / CASE WHEN s2 < 1e-6 THEN 1 ELSE s2 END, 7) AS ai_artifact_mean FROM win, s""")
def standardize(spark, sf):
    win = features(spark, sf).select("campaign_id", "window_id", "dt_mean", "ai_artifact_mean")
    scaler = P.fit_scaler(win.filter(F.col("campaign_id").cast("long") % 2 == 0), ["dt_mean", "ai_artifact_mean"])
    return rounded(P.apply_scaler(win, scaler, ["dt_mean", "ai_artifact_mean"]), {"dt_mean": 7, "ai_artifact_mean": 7})


@query("S11_split_files", f"WITH {SCORED}, {_SPLITS} SELECT session_id, split FROM spl")
def split_files(spark, sf):
    """Splits written to disk and read back through their checksums."""
    from alertloom.sources import logs
    from catalog.host import fresh_folder

    path = fresh_folder(spark)
    logs.write_split(splits(spark, sf).select("session_id", "split"), path)
    return logs.read_splits(spark, path)
