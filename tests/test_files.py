"""Readers, writers and whole reports on small folders."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from alertloom.operators import models as M
from alertloom.operators import normalize as N
from alertloom.operators import web as B
from alertloom.plans import reports, staging
from alertloom.sources import logs


def test_missing_file_is_empty(spark, tmp_path):
    assert logs.read_jsonl(spark, str(tmp_path / "none.jsonl"), "a int").count() == 0


def test_interleaved_and_truncated_lines_are_skipped(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"a":1}\n\n{"a":2}{"a":3}\n{"a":\n[1]\n{"a":4}\n')
    assert sorted(r["a"] for r in logs.read_jsonl(spark, str(tmp_path / "x.jsonl"), "a int").collect()) == [1, 4]


@pytest.mark.parametrize("wrap", [True, False])
def test_json_array(spark, tmp_path, wrap):
    rows = [{"EventID": 1, "Hostname": "h"}, {"EventID": 3, "Hostname": "g"}]
    (tmp_path / "x.json").write_text(json.dumps({"events": rows} if wrap else rows))
    out = logs.read_json_events(spark, str(tmp_path / "x.json"), "EventID int, Hostname string")
    assert sorted((r["EventID"], r["Hostname"]) for r in out.collect()) == [(1, "h"), (3, "g")]


def campaign(root, name, meta_file, meta, events):
    folder = root / name
    folder.mkdir()
    (folder / meta_file).write_text(json.dumps(meta))
    (folder / "sysmon.jsonl").write_text("\n".join(json.dumps(e) for e in events))


def test_campaign_folders(spark, tmp_path):
    event = lambda i, g, p: {"@timestamp": 100.0 + i, "Hostname": "h", "EventID": 1, "Channel": "sysmon", "ProcessGuid": g, "ParentProcessGuid": p}
    step = {"host": "h", "technique_id": "T1059", "t_start": 103.0, "t_end": 103.5}
    campaign(tmp_path, "c1", "caldera_op.json", {"operation": {"steps": [step]}}, [event(i, f"g{i}", f"g{i - 1}" if i else "") for i in range(40)])
    campaign(tmp_path, "c2", "workload.json", {"class": "normal"}, [event(i, f"w{i}", "") for i in range(40)])
    (tmp_path / "c3").mkdir()
    (tmp_path / "c3" / "sysmon.jsonl").write_text("{}")
    rows = logs.read_campaigns(spark, str(tmp_path))
    assert {(r["campaign_id"], r["source"]) for r in rows.select("campaign_id", "source").distinct().collect()} == {("c1", "caldera"), ("c2", "workload")}
    steps = logs.campaign_steps(spark, str(tmp_path))
    assert [(r["campaign_id"], r["t_end"]) for r in steps.collect()] == [("c1", 103.5)]
    assert logs.read_workloads(spark, str(tmp_path)).first()["class"] == "normal"
    norm = N.adapt_winlog(rows.drop("campaign_id", "source").withColumn("dataset", F.split("event_key", ":")[0]))
    assert norm.filter("campaign_id = 'c1'").agg(F.max("depth")).first()[0] == 39


def test_split_file_checksum(spark, tmp_path):
    ids = ["b", "a", "c"]
    body = {"split": "public_test", "session_ids": ids, "__checksum": hashlib.sha256("\n".join(sorted(ids)).encode()).hexdigest()}
    (tmp_path / "s.json").write_text(json.dumps(body))
    assert logs.read_split(spark, str(tmp_path / "s.json")).count() == 3
    (tmp_path / "t.json").write_text(json.dumps({**body, "session_ids": ids + ["d"]}))
    with pytest.raises(ValueError):
        logs.read_split(spark, str(tmp_path / "t.json"))


def test_written_splits_are_verified(spark, tmp_path):
    table = spark.range(50).select(F.col("id").cast("string").alias("session_id"), F.when(F.col("id") % 2 == 0, "public_dev").otherwise("public_test").alias("split"))
    logs.write_split(table, str(tmp_path / "s"))
    assert logs.read_splits(spark, str(tmp_path / "s")).count() == 50
    spark.createDataFrame([("x", "public_dev")], "session_id string, split string").write.mode("append").partitionBy("split").parquet(str(tmp_path / "s" / "ids"))
    with pytest.raises(ValueError):
        logs.read_splits(spark, str(tmp_path / "s"))


def test_deployments(spark, tmp_path):
    (tmp_path / "d.json").write_text(json.dumps({"deployments": [{"name": "a", "hosts": 3, "events_per_sec_per_host": 1.5}]}))
    assert logs.read_deployments(spark, str(tmp_path / "d.json")).first()["hosts"] == 3
    (tmp_path / "e.json").write_text(json.dumps([{"name": "a"}]))
    with pytest.raises(ValueError):
        logs.read_deployments(spark, str(tmp_path / "e.json"))


def test_release_pair(spark, tmp_path):
    (tmp_path / "f.jsonl").write_text("\n".join(json.dumps({"session_id": s, "target_app": "t", "agg": [0.0] * 12, "seq": q, "hp": [0.0] * 4}) for s, q in [("a", []), ("b", [[1.0] * 9] * 2)]))
    (tmp_path / "t.jsonl").write_text("\n".join(json.dumps({"session_id": s, "y": 1, "family": "f", "klass": "agent", "stealth": False, "duration_s": 1.0, "src_label": "f"}) for s in "ab"))
    sessions, seq = logs.read_release(spark, str(tmp_path / "f.jsonl"), str(tmp_path / "t.jsonl"))
    assert sessions.count() == 2
    assert sorted((r["session_id"], r["pos"], r["x"][0]) for r in seq.collect()) == [("a", 0, 0.0), ("b", 0, 1.0), ("b", 1, 1.0)]


def test_alert_fatigue_report_adds_up(spark, sf):
    cols = M.aggregate_columns(staging.ACTIONS)
    report = reports.alert_fatigue(staging.events(spark, sf), staging.manifest(spark, sf), 0.01, staging.ACTIONS, fit=lambda t: M.fit_logistic(t, cols, "label"))
    shape = report["deployments"].collect()
    assert len(shape) == 3
    for r in shape:
        assert r["total_fp_per_hour"] == pytest.approx(r["normal_fp_per_hour"] + r["hard_negative_fp_per_hour"]) and r["total_fp_per_hour"] >= 0
    days = report["daily_distribution"].collect()
    assert all(r["min_total"] <= r["median_total"] <= r["p95_total"] + 1e-9 <= r["max_total"] + 2e-9 for r in days)


def test_constant_scorer_for_single_class(spark):
    train = spark.createDataFrame([(1, 0.1), (1, 0.2)], "y int, x double")
    assert [r["score"] for r in M.fit_logistic(train, ["x"]).score(train).collect()] == [0.5, 0.5]


def test_release_refuses_personal_data(spark):
    cols = {c: F.lit(0.0) for c in B.SESSION_FEATURES + ["canary", "invisible_field", "admin_secrets", "robots_read", "duration_s"]}
    s = spark.range(20).select(
        F.col("id").cast("string").alias("session_id"), F.lit("fam").alias("family"), F.lit("agent").alias("klass"), F.lit(False).alias("stealth"), F.lit("app").alias("target_app"),
        F.when(F.col("id") == 3, "10.9.8.7").otherwise("src").alias("src_label"), F.lit(1).alias("y"), F.lit(None).cast("string").alias("consent_id"),
    ).withColumns(cols)
    consent = spark.createDataFrame([], "ts double, consent_id string, consent_text_version string")
    with pytest.raises(ValueError, match="personal data"):
        reports.build_release(s, consent, n_heldout=0)
    assert reports.build_release(s.withColumn("src_label", F.lit("src")), consent, n_heldout=0)["truth"].count() == 20


def test_access_log_files(spark, tmp_path):
    line = '1.2.3.4 - - [10/Oct/2025:13:55:36 +0000] "GET /a?b=c HTTP/1.1" 200 5 "-" "curl/8"'
    (tmp_path / "a.log").write_text(line + "\nrotated\n")
    (tmp_path / "b.log").write_text(line + "\n")
    rows = logs.read_access_log(spark, str(tmp_path)).collect()
    assert len(rows) == 2 and len({r["line_id"] for r in rows}) == 2 and {r["path"] for r in rows} == {"/a"}
    assert B.stitch_sessions(logs.read_access_log(spark, str(tmp_path))).select("session_id").distinct().count() == 1


def test_read_any_by_suffix(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"a":1}\n{"a":2}\n')
    (tmp_path / "x.json").write_text('[{"a":1},\n{"a":2},{"a":3}]')
    (tmp_path / "x.csv").write_text("a,b\n1,x\n")
    sizes = [logs.read_any(spark, str(tmp_path / f"x.{s}")).count() for s in ("jsonl", "json", "csv")]
    assert sizes == [2, 3, 1]
    with pytest.raises(ValueError):
        logs.read_any(spark, "x.bin")


def test_top_rows_are_limited_before_the_shuffle(spark, sf):
    from alertloom.operators import rollups

    plan = rollups.profile(staging.events(spark, sf).select("action", "host"))._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan
