"""Hand-valued cases for scores, thresholds, economics, web rows and governance."""

import math
import threading

import pytest
from pyspark.ml.classification import GBTClassifier
from pyspark.sql import functions as F

from alertloom import fixed
from alertloom.functions import columns as C
from alertloom.operators import attribution as A
from alertloom.operators import economics as E
from alertloom.operators import governance as D
from alertloom.operators import graph as G
from alertloom.operators import models as M
from alertloom.operators import normalize as N
from alertloom.operators import rollups as R
from alertloom.operators import slices as S
from alertloom.operators import splits as P
from alertloom.operators import thresholds as T
from alertloom.operators import web as B
from alertloom.sources import logs


def scores(spark, rows):
    return spark.createDataFrame([(y, float(s)) for y, s in rows], "y int, score double")


def test_average_precision_with_ties(spark):
    df = scores(spark, [(1, 0.9), (0, 0.8), (1, 0.8), (0, 0.3), (1, 0.1)])
    assert T.average_precision(df).first()["pr_auc"] == pytest.approx(0.7555555, abs=1e-6)
    assert T.average_precision(scores(spark, [(1, 0.9), (1, 0.2)])).first()["pr_auc"] is None


def test_budget_keeps_ties_together(spark):
    df = scores(spark, [(1, 0.9), (0, 0.7), (0, 0.7), (1, 0.5), (0, 0.4)])
    one = T.tau_for_budget(df, 1.0, 1.0).first()
    assert (one["threshold"], one["fp_count"]) == (0.9, 0)
    two = T.tau_for_budget(df, 1.0, 2.0).first()
    assert (two["threshold"], two["fp_count"]) == (0.5, 2)
    none = T.tau_for_budget(scores(spark, [(0, 0.9)]), 1.0, 0.0).first()
    assert none["threshold"] == 1.0


def test_spend_cutoff(spark):
    cells = spark.createDataFrame([(i, 2.0) for i in range(5)], "seq long, cost_cents double")
    runs = lambda cap: T.spend_cutoff(cells, cap).filter("runs").count()
    assert (runs(None), runs(0.0), runs(5.0), runs(100.0)) == (5, 0, 2, 5)


def test_cost_hand_value(spark):
    row = spark.createDataFrame([("openai", "gpt-4o-mini", 600, 400), ("x", "y", 1, 1)], "backend string, model string, tokens_in long, tokens_out long")
    cents = {r["backend"]: r["cost_cents"] for r in R.with_cost(row).collect()}
    assert cents["openai"] == pytest.approx(0.033) and cents["x"] is None


def test_pareto_is_strict(spark):
    rows = [("d", 0.1, 0.9, 9.0), ("d", 0.2, 0.9, 8.0), ("d", 0.3, 0.7, 8.0), ("d", 0.4, 0.6, 2.0)]
    front = T.pareto(spark.createDataFrame(rows, "deployment string, tau double, detect_rate double, fp_per_hour double"))
    assert sorted(r["tau"] for r in front.collect()) == [0.2, 0.4]


def test_consecutive_flag_needs_a_run(spark):
    rows = [("a", i, i * 5, 20, 100.0, s) for i, s in enumerate([0.9, 0.1, 0.9, 0.9], 1)] + [("b", i, i * 5, 20, 100.0, s) for i, s in enumerate([0.9, 0.1, 0.9, 0.1], 1)]
    out = T.consecutive_flag(spark.createDataFrame(rows, "session_id string, tick long, seen long, n_req long, duration_s double, score double"), 0.5).collect()
    assert [(r["session_id"], r["tick"], r["flag_after_s"]) for r in out] == [("a", 4, 100.0)]


def test_recall_weight_extremes(spark):
    benign = spark.createDataFrame([(1, 0.5, 0.4), (3, 0.5, 0.1)], "eid int, share_events double, contribution_to_fp_rate double")
    attack = spark.createDataFrame([(1, 0.5, 0.6), (3, 0.5, 0.0)], "eid int, share_events double, contribution_to_detect_rate double")
    shape = [("d", 10, 1.0)]
    zero = {r["eid"]: r for r in E.eid_cost_benefit(benign, attack, shape, 0.0).collect()}
    assert all(r["ranking_score"] == r["fp_per_hour_saved"] for r in zero.values())
    assert zero[1]["fp_per_hour_saved"] == pytest.approx(0.4 * 10 * 3600 / 16)
    heavy = {r["eid"]: r["ranking_score"] for r in E.eid_cost_benefit(benign, attack, shape, 10000.0).collect()}
    assert heavy[3] > heavy[1]


def test_fp_per_hour_formula(spark):
    rows = [("c1", "normal", "", 0.9), ("c1", "normal", "", 0.1), ("c2", "hard_negative", "wmi", 0.9)]
    ws = spark.createDataFrame(rows, "campaign_id string, class string, benign_subtype string, score double")
    got = E.fp_per_hour(ws, 0.5, [("d", 24, 1.0)]).first()
    assert got["normal_fp_per_hour"] == pytest.approx(0.5 * 24 * 3600 / 16)
    assert got["hard_negative_fp_per_hour"] == pytest.approx(1.0 * (60 * 5.0 / 16) * 12)


def procs(spark, pairs):
    return spark.createDataFrame([(g, p, float(i), i) for i, (g, p) in enumerate(pairs)], "guid string, parent_guid string, ts double, event_id long")


def test_process_depth_cases(spark):
    p = procs(spark, [("a", ""), ("b", "a"), ("c", "b"), ("x", "gone"), ("self", "self"), ("m", "n"), ("n", "m"), ("below", "m")])
    got = {r["guid"]: r["depth"] for r in G.process_depth(p).collect()}
    assert got == {"a": 0, "b": 1, "c": 2, "x": 1, "self": 0, "m": 0, "n": 0, "below": 1}


def test_process_depth_of_a_long_chain_and_wide_parent(spark):
    pairs = [("n0", "")] + [(f"n{i}", f"n{i - 1}") for i in range(1, 70)] + [(f"w{i}", "n5") for i in range(50)]
    got = {r["guid"]: r["depth"] for r in G.process_depth(procs(spark, pairs)).collect()}
    assert all(got[f"n{i}"] == i for i in range(70)) and all(got[f"w{i}"] == 6 for i in range(50))


def test_closure(spark):
    p = procs(spark, [("a", ""), ("b", "a"), ("c", "b"), ("d", "c"), ("e", "a"), ("l1", "l2"), ("l2", "l1")])
    seeds = spark.createDataFrame([("b",), ("l1",)], "guid string")
    got = {r["guid"]: r["hops"] for r in G.malicious_closure(p, seeds).collect()}
    assert got == {"b": 0, "c": 1, "d": 2, "l1": 0, "l2": 1}
    assert G.malicious_closure(p, seeds, 1).count() == 4


def test_access_line(spark):
    lines = spark.createDataFrame([
        ('192.168.1.42 - - [10/Oct/2025:13:55:36 -0700] "GET /search?q=test HTTP/1.1" 200 1842 "-" "Mozilla/5.0"',), ("garbage",), ("",),
        ('1.2.3.4 - - [bad time] "GET / HTTP/1.1" 200 - "-" "x"',), ('1.2.3.4 - - [10/Oct/2025:13:55:36 +0000] "GET / HTTP/1.1" 200 - "-" "x"',)], "value string")
    rows = logs.parse_access_log(lines).orderBy("ts").collect()
    assert len(rows) == 2
    assert (rows[1]["src_ip"], rows[1]["method"], rows[1]["path"], rows[1]["qs_len"], rows[1]["status"], rows[1]["resp_bytes"]) == ("192.168.1.42", "GET", "/search", 6, 200, 1842)
    assert rows[1]["ts"] - rows[0]["ts"] == 7 * 3600 and rows[0]["resp_bytes"] == 0


def test_session_split_at_the_gap(spark):
    rows = [(i, t, "1.1.1.1", "ua") for i, t in enumerate([0.0, 30.0, 2000.0, 3800.0, 5600.5])]
    out = B.stitch_sessions(spark.createDataFrame(rows, "line_id long, ts double, src_ip string, ua string")).orderBy("line_id").collect()
    assert [r["is_new_session"] for r in out] == [True, False, True, False, True]
    assert [r["delta_ms"] for r in out] == [None, 30000, None, 1800000, None]
    assert len({r["session_id"] for r in out}) == 3


def test_max_rps_closed_span(spark):
    rows = [("s", t) for t in [0.0, 0.5, 1.0, 1.000001, 2.0, 2.0, 2.9, 3.0]]
    out = B.max_rps(spark.createDataFrame(rows, "session_id string, ts double")).first()
    naive = max(sum(1 for _, u in rows if t <= u <= t + 1.0) for _, t in rows)
    assert out["max_rps"] == naive


def test_scan_finds_planted_text(spark):
    planted = {
        "ipv4": "10.1.2.3", "ipv6": "fe80:1:2:3:4:5:6:7", "raw_ua_mozilla": "Mozilla/5.0", "raw_ua_curl": "curl/8.4", "auth_header_value": "authorization: Bearer abcdef",
        "cookie_header_value": "Cookie: a=b", "set_cookie_value": "Set-Cookie: sid=1", "api_key_shape": "sk-test-" + "a" * 90, "pem_private_key": "-----BEGIN RSA PRIVATE KEY-----",
        "github_pat": "ghp_" + "a" * 36, "aws_access_key": "AKIA" + "A" * 16, "jwt": ".".join(["eyJ" + "a" * 20, "eyJ" + "b" * 20, "c" * 20]),
    }
    docs = spark.createDataFrame([(k, f"clean line\nsee {v} here\r\nend") for k, v in planted.items()] + [("none", "nothing to see\nat all")], "k string, text string")
    hits = D.scan_pii(docs, "k").collect()
    assert {(r["k"], r["pattern"]) for r in hits} >= {(k, k) for k in planted}
    assert all(r["line"] == 2 for r in hits) and not [r for r in hits if r["k"] == "none"]
    long = next(r for r in hits if r["pattern"] == "api_key_shape")["matched"]
    assert len(long) == 80 and long.endswith("...")


def test_consent_reasons(spark):
    s = spark.createDataFrame([("a", "human_real", "1"), ("b", "human_real", None), ("c", "human_real", "9"), ("d", "human_real", "2"), ("e", "human_sim", None), ("f", None, None)], "session_id string, family string, consent_id string")
    c = spark.createDataFrame([(0.0, "1", "v1"), (0.0, "2", "v7")], "ts double, consent_id string, consent_text_version string")
    kept, out = D.publishable(s, c)
    assert {r["session_id"] for r in kept.collect()} == {"a", "e", "f"}
    assert {r["session_id"]: r["reason"] for r in out.collect()} == {"b": "missing_consent_id", "c": "consent_not_found", "d": "unknown_consent_version"}


def test_leaderboard_keeps_latest(spark):
    rows = [("h", "v", "s", 0, "2025-01-01T00:00:00Z", 1, 0.5), ("h", "v", "s", 0, "2025-01-01T00:00:00Z", 2, 0.9), ("k", "v", "s", 0, "2025-01-01T00:00:00Z", 3, float("nan"))]
    df = spark.createDataFrame(rows, "submission_hash string, splits_version string, split string, seed int, submitted_at string, line int, pr_auc double")
    latest = S.latest_per_key(df, ["submission_hash", "splits_version", "split", "seed"], ["submitted_at", "line"])
    ranked = {r["submission_hash"]: (r["rank"], r["line"]) for r in S.rank_leaderboard(latest, "pr_auc").collect()}
    assert ranked == {"h": (1, 2), "k": (2, 3)}


def test_split_access(spark):
    t = spark.createDataFrame([("a", "public_test"), ("b", "private_heldout_family")], "session_id string, split string")
    assert D.split_for("public_test", t).count() == 1 and D.split_for("heldout", t).count() == 2
    with pytest.raises(PermissionError):
        D.split_for("public_test", t, ["private_heldout_family"])


def test_splits_are_disjoint_repeatable_and_leak_free(spark):
    fam = F.concat(F.lit("llm_openai_m"), F.col("id") % 2)
    s = spark.range(300).select(
        F.col("id").cast("string").alias("session_id"), F.when(F.col("id") % 3 == 0, fam).otherwise(F.concat(F.lit("f"), F.col("id") % 5)).alias("family"),
        F.when(F.col("id") % 4 == 0, "human").otherwise("agent").alias("klass"), (F.col("id") % 7 == 0).alias("stealth"),
    )
    one = P.benchmark_splits(s, 1, 1, "openai")
    two = P.benchmark_splits(s.repartition(7), 1, 1, "openai")
    rows = lambda df: sorted((r["session_id"], r["split"]) for r in df.collect())
    assert rows(one) == rows(two) and one.count() == 300
    P.assert_disjoint(one.select("session_id", "split"))
    outside = one.filter(F.col("split") != "private_heldout_family")
    assert outside.filter(F.col("family").startswith("llm_openai")).isEmpty()
    with pytest.raises(ValueError):
        P.assert_disjoint(one.select("session_id", "split").unionByName(s.select("session_id", F.lit("public_dev").alias("split"))))


def test_dropout_counts_add_up(spark, sf):
    from alertloom.plans import staging

    ev = staging.events(spark, sf).filter(F.col("campaign_id") == "0")
    rows = A.eid_dropout_fp(ev, lambda df: df.withColumn("score", staging.rule_score()), 0.75, actions=staging.ACTIONS).collect()
    assert sum(r["n_events_dropped"] for r in rows) == ev.count()
    for r in rows:
        if r["fp_rate_dropout"] is not None:
            assert r["contribution_to_fp_rate"] == pytest.approx(r["fp_rate_full"] - r["fp_rate_dropout"])


def test_adapt_generic_reports_missing(spark):
    with pytest.raises(ValueError, match="ts"):
        N.adapt_generic(spark.range(1), {"id": "campaign_id"})


def test_column_functions(spark):
    row = spark.sql("select 'T1059.001' t, cast(null as double) n, 'zz' bad, '00ff00ff' hex, 'OpenAI' b, 'GPT-4o mini!' m").select(
        C.tactic_of(F.col("t")).alias("tactic"), C.safe_log1p(F.col("n")).alias("zero"), C.safe_log1p(F.lit(-4.0)).alias("neg"), C.hex_norm(F.col("bad")).alias("bad"),
        C.hex_norm(F.col("hex")).alias("hex"), C.family_name(F.col("b"), F.col("m")).alias("family"), C.alerts_per_hour(F.lit(0.01), F.lit(2.0)).alias("aph"),
        C.path_bucket(F.lit("/a"), exact=True).alias("exact"),
    ).first()
    assert (row["tactic"], row["zero"], row["neg"], row["bad"]) == ("command_execution", 0.0, 0.0, 0.0)
    assert row["hex"] == pytest.approx(0x00FF00FF / 16**8) and row["family"] == "llm_openai_gpt_4o_mini" and row["aph"] == pytest.approx(0.3)
    import hashlib

    assert row["exact"] == int.from_bytes(hashlib.blake2b(b"/a", digest_size=4).digest(), "big") % 16 / 16


def test_fixed_values_are_consistent():
    assert set(fixed.TECHNIQUE_TACTIC.values()) == set(fixed.TACTICS)
    assert {b[0] for b in fixed.BURST_SHAPES} == set(fixed.BENIGN_SUBTYPES) - {""}
    assert math.isclose(sum(fixed.PUBLIC_RATIOS), 1.0)


def test_forbidden_words_are_values_not_names(spark):
    from alertloom.operators import governance

    df = spark.sql("select named_struct('License', 1, 'tags', array('a', 'my license')) a, map('license', 2) b, named_struct('License', 'none') c, 'free' d")
    found = {(r["path"], r["kind"]): r["n"] for r in governance.forbidden_words(df, "license").collect()}
    assert found == {("$.a.License", "name"): None, ("$.c.License", "name"): None, ("$.a", "value"): 1, ("$.b", "value"): 1}


def test_constant_scorer_is_saved(spark, tmp_path):
    from alertloom.operators.models import Scorer

    constant = Scorer(["x"], None)
    constant.save(str(tmp_path))
    again = Scorer.load(spark, str(tmp_path))
    assert again == constant and again.linear().coef == [0.0]
    assert again.score(spark.range(2)).select("score").distinct().collect() == [(0.5,)]


def test_a_python_scorer_is_held_to_the_contract(spark):
    from alertloom import fixed
    from alertloom.operators import models, web

    columns = [*web.SESSION_FEATURES, *fixed.HONEYPOTS]
    rows = [(f"s{i}", "app", *[float(i + k) for k in range(len(columns))]) for i in range(5)]
    table = spark.createDataFrame(rows, ["session_id", "target_app", *columns])
    half = models.python_scorer(lambda r: r["log_n"] / 10, ["log_n"])
    assert {r.session_id: r.agent_score for r in models.run_scorer(half, table, table, None).collect()} == {f"s{i}": i / 10 for i in range(5)}
    with pytest.raises(ValueError):
        models.run_scorer(models.python_scorer(lambda r: r["log_n"], ["log_n"]), table, table, None)  # beyond 1
    with pytest.raises(Exception, match="scores for"):
        models.run_scorer(models.python_scorer(lambda r: [0.5], ["log_n"]), table, table.coalesce(1), None)


def test_both_ways_of_a_framework_swap_are_fitted_at_the_same_time(spark):
    windows = spark.createDataFrame(
        [(f"{k}-{i}", i, k if k in ("normal",) else "attack", k, int(k != "normal"), 1.0) for k in ("caldera", "atomic", "normal") for i in range(8)],
        "campaign_id string, window_id long, class string, framework string, label int, dt_median double",
    )
    both = threading.Barrier(2, timeout=60)

    def fit(train):
        both.wait()
        return M.Scorer(["dt_median"], None)

    rows = M.framework_swap(windows, ["dt_median"], 1.0, fit).collect()
    assert [r["direction"] for r in rows] == ["train_caldera_eval_atomic", "train_atomic_eval_caldera"]


def test_boosted_trees_get_short_rows_with_a_cut_plan(spark, monkeypatch):
    seen, fitted = [], GBTClassifier.fit
    monkeypatch.setattr(GBTClassifier, "fit", lambda self, rows, params=None: seen.append(rows) or fitted(self, rows, params))
    train = spark.createDataFrame([(float(i), float(i % 3), "not a feature", int(i > 20)) for i in range(40)], "a double, b double, note string, label int").filter("a >= 0")
    scorer = M.fit_gbt(train, ["a", "b"], rounds=3, depth=2)
    assert seen[0].columns == ["__x", "__y", "weight"]
    assert "Filter" not in seen[0]._jdf.queryExecution().analyzed().toString()
    assert scorer.model.transform(train).where("prediction = label").count() == 40
