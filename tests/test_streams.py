"""Streams, in several micro-batches, against plain Python loops."""

import datetime
import math
import os

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from alertloom.operators import web as B
from alertloom.operators import windows as W
from alertloom.plans import staging
from alertloom.sources import growing
from alertloom.streaming import ordered as O
from alertloom.streaming import streams as X

ACTIONS = staging.ACTIONS
SCORER = O.LinearScorer(["distinct_targets", "depth_mean", "act_click", "seq_click_view"], [0.02, 0.8, 1.5, 2.0], -1.2)


def in_batches(spark, df, path, parts=3, key="ts", closing=None, late_s=0.0):
    """Write the rows as one file per part, so each is one micro-batch: in time order, or with rows up to `late_s` seconds late. A closing
    row, if asked for, ends the log."""
    import random

    draw = random.Random(7)
    rows = sorted(df.collect(), key=lambda r: r[key] + draw.random() * late_s)
    step = math.ceil(len(rows) / parts)
    files = [spark.createDataFrame(rows[i * step:(i + 1) * step], df.schema) for i in range(parts)]
    if closing:
        files.append(X.closing_row(df, closing, max(r[key] for r in rows)))
    for f in files:
        f.coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def vector(w):
    """The window features of up to 32 events, in plain Python."""
    n, ts = len(w), w["ts"].tolist()
    gaps = [b - a for a, b in zip(ts, ts[1:])] or [0.0]
    acts, targets = w["action"].tolist(), w["target"].nunique()
    mean = sum(gaps) / len(gaps)
    half = sorted(gaps)
    out = {
        "dt_mean": mean, "dt_median": (half[(len(half) - 1) // 2] + half[len(half) // 2]) / 2, "dt_std": math.sqrt(sum((g - mean) ** 2 for g in gaps) / len(gaps)),
        "events_per_sec": n / (ts[-1] - ts[0] + 1e-6), "distinct_targets": float(targets), "target_churn": targets / n,
        "depth_max": w["depth"].max(), "depth_mean": w["depth"].sum() / n, "ai_artifact_mean": w["artifact_ai"].sum() / n, "ai_artifact_max": w["artifact_ai"].max(),
    }
    pairs = list(zip(acts, acts[1:]))
    for a in ACTIONS:
        out[f"act_{a}"] = acts.count(a) / n
        for b in ACTIONS:
            out[f"seq_{a}_{b}"] = pairs.count((a, b)) / max(len(pairs), 1)
    return out


def chance(scorer, features):
    return 1 / (1 + math.exp(-(scorer.intercept + sum(c * features[k] for k, c in zip(scorer.cols, scorer.coef)))))


def naive_alerts(ev, tau):
    out = {}
    for c, g in ev.sort_values(["ts", "event_id"]).groupby("campaign_id"):
        for seen in range(16, len(g) + 1, 16):
            w = g.iloc[max(0, seen - 32):seen]
            risk = chance(SCORER, vector(w))
            if risk >= tau:
                out[c] = (float(w["ts"].iloc[-1]), seen)
                break
    return out


@pytest.mark.parametrize("late_s", [0.0, 80_000.0], ids=["in_time", "shuffled"])
def test_campaign_alerts_equal_a_loop(spark, sf, tmp_path, late_s):
    ev = staging.events(spark, sf)
    live = in_batches(spark, ev, str(tmp_path / "in"), closing="campaign_id", late_s=late_s)
    got = X.run_to_table(spark, O.alert_campaigns(live, SCORER, 0.62, ACTIONS), str(tmp_path))
    want = naive_alerts(ev.toPandas(), 0.62)
    assert 0 < len(want) < 15
    assert {r["campaign_id"]: (r["ts"], r["events_seen"]) for r in got.collect()} == want


def test_window_vectors_equal_batch_features(spark, sf):
    members = W.window_members(staging.events(spark, sf))
    batch = W.aggregate_features(members, ["campaign_id", "window_id"], ACTIONS).join(W.bigram_shares(members, ACTIONS), ["campaign_id", "window_id"])
    row = batch.orderBy("campaign_id", "window_id").first()
    events = members.filter((F.col("campaign_id") == row["campaign_id"]) & (F.col("window_id") == row["window_id"])).orderBy("pos").toPandas()
    plain = vector(events)
    alerter = O.CampaignAlerter(O.LinearScorer(list(plain), [0.0] * len(plain), 0.0), 0.0, ACTIONS, 32, 16, 1.0)
    seen = {}
    alerter_probability = O.probability
    try:
        O.probability = lambda scorer, vectors, names: seen.update(zip(names, vectors[-1])) or alerter_probability(scorer, vectors, names)
        alerter.score(("c",), events.reset_index(drop=True), 0, 0)
    finally:
        O.probability = alerter_probability
    for name, value in plain.items():
        assert row[name] == pytest.approx(value, rel=1e-9, abs=1e-9), name
        assert seen[name] == pytest.approx(value, rel=1e-9, abs=1e-9), name


def naive_session_alerts(req, scorer, tau, every, k, closed):
    def hit(total):
        return O.probability(scorer, O.prefix_vectors(*[np.array([x], dtype=float) for x in total]), O.PREFIX_FEATURES)[0] >= tau

    out = {}
    for sid, g in req.sort_values(["ts", "line_id"]).groupby("session_id"):
        total, run = None, 0
        for i, r in enumerate(g.itertuples()):
            part = g.iloc[: i + 1]
            d = part["delta_ms"].dropna()
            total = (i + 1, float(d.sum()), float((d**2).sum()), len(d), int(part["status"].between(400, 499).sum()), int(part["status"].between(500, 599).sum()), part["ts"].iloc[0], r.ts)
            if (i + 1) % every == 0:
                run = run + 1 if hit(total) else 0
                if run >= k:
                    out[sid] = i + 1
                    break
        else:
            if sid in closed and total[0] % every:
                run = run + 1 if hit(total) else 0
                if run >= k:
                    out[sid] = total[0]
    return out


@pytest.mark.parametrize("late_s", [0.0, 1500.0], ids=["in_time", "shuffled"])
def test_session_alerts_equal_a_loop(spark, tmp_path, late_s):
    rows, line = [], 0
    for s in range(12):
        for i in range(7 + s):
            rows.append((f"s{s}", 1e6 + 1000.0 * s + 20.0 * i, line, 500 if (i + s) % 3 == 0 else 200, None if i == 0 else 20000))
            line += 1
    rows.append(("late", 1e7, line, 200, None))
    req = spark.createDataFrame(rows, "session_id string, ts double, line_id long, status int, delta_ms long")
    scorer = O.LinearScorer(O.PREFIX_FEATURES, [0.3, 0.0, 0.0, 0.0, 4.0, 0.0], -2.0)
    live = in_batches(spark, req, str(tmp_path / "in"), 4, closing="session_id", late_s=late_s)
    got = X.run_to_table(spark, O.alert_sessions(live, scorer, 0.5, 5, 2, 1800, "30 minutes"), str(tmp_path))
    want = naive_session_alerts(req.toPandas(), scorer, 0.5, 5, 2, {f"s{i}" for i in range(12)})
    assert 0 < len(want) < 12
    assert {r["session_id"]: r["seen"] for r in got.collect()} == want


def test_live_sessions_equal_batch(spark, sf, tmp_path):
    req = staging.requests(spark, sf).select("line_id", "ts", "src_ip", "ua")
    live = in_batches(spark, req, str(tmp_path / "in"), 5)
    got = X.run_to_table(spark, X.stream_sessions(live, "43200 seconds", "1 minute"), str(tmp_path), "complete")
    batch = B.stitch_sessions(req, 43200).groupBy("session_id").agg(F.count(F.lit(1)).alias("n"))
    assert {r["session_id"]: r["n_req"] for r in got.collect()} == {r["session_id"]: r["n"] for r in batch.collect()}


@pytest.mark.parametrize("cut", [(1, 0.0), (4, 0.0), (5, 40_000.0)], ids=["one_batch", "in_time", "shuffled"])
def test_stitched_requests_equal_batch_whatever_the_cut(spark, sf, tmp_path, cut):
    req = staging.requests(spark, sf).select("line_id", "ts", "src_ip", "ua").filter("line_id < 400")
    live = in_batches(spark, req, str(tmp_path / "in"), cut[0], closing="src_ip", late_s=cut[1])
    got = X.run_to_table(spark, O.stitch_stream(live, 43200, "12 hours"), str(tmp_path))
    columns = ["line_id", "session_id", "is_new_session", "delta_ms", "uah"]
    assert sorted(map(tuple, got.select(*columns).collect())) == sorted(map(tuple, B.stitch_sessions(req, 43200).select(*columns).collect()))


class Clock:
    def __init__(self, ms):
        self.ms = ms

    def getCurrentWatermarkInMs(self):
        return self.ms


class Handle:
    """State of one key, as the engine keeps it."""

    def __init__(self):
        self.value, self.timers = None, set()

    def getValueState(self, name, schema):
        return self

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value

    def clear(self):
        self.value = None

    def registerTimer(self, ms):
        self.timers.add(ms)

    def deleteTimer(self, ms):
        self.timers.remove(ms)


def test_state_is_dropped_after_the_gap():
    import pandas as pd

    handle, step = Handle(), O.Stitcher(100, ["ts", "line_id"])
    step.names = ["event_time", "ts", "line_id", "src_ip", "uah", O.TIME]
    step.init(handle)
    at = lambda s, n: (pd.Timestamp(s, unit="s"), float(s), n, "ip", "ua", s * 1_000_000)
    feed = lambda rows, wm: [x for f in step.handleInputRows(("ip", "ua"), iter([pd.DataFrame(rows, columns=step.names)]), Clock(wm * 1000)) for x in f["line_id"]]
    assert feed([at(50, 2), at(10, 1)], 0) == [] and handle.timers == {10_000}
    assert feed([at(20, 3)], 30) == [1, 3] and handle.timers == {10_000, 50_000}
    handle.timers.discard(10_000)  # the engine removes a timer that has gone off
    assert [x for f in step.handleExpiredTimer(("ip", "ua"), Clock(60_000), None) for x in f["line_id"]] == [2]
    handle.timers.discard(50_000)
    assert handle.value is not None and len(handle.timers) == 1 and min(handle.timers) > 150_000
    list(step.handleExpiredTimer(("ip", "ua"), Clock(151_000), None))
    assert handle.value is None


def test_trailing_rates_equal_plain_sums(spark, tmp_path):
    rows = [(float(t * 7 % 400), "ab"[t % 2], t % 5) for t in range(300)]
    df = spark.createDataFrame(rows, "ts double, k string, v int")
    live = in_batches(spark, df, str(tmp_path / "in"), 4, closing="k", late_s=50.0)
    out = O.trailing_rates(live, ["k"], "60 seconds", "4 seconds", "1 minute", ["v"])
    got = X.run_to_table(spark, out, str(tmp_path)).collect()
    state = {}
    for r in sorted(got, key=lambda r: r.window_end):
        state.setdefault(r.k, []).append((r.window_end, r.n, r.sum_v))
    for k in "ab":
        assert state[k][-1][1:] == (0, 0)
        for end in range(4, 480, 4):
            inside = [v for ts, key, v in rows if key == k and end - 60 <= ts < end]
            last = [x[1:] for x in state[k] if x[0] <= end][-1:] or [(0, 0)]
            assert last[0] == (len(inside), sum(inside)), (k, end)
    plan = out._jdf.queryExecution().analyzed().toString()
    assert "Expand" not in plan


def test_growing_files_give_each_line_once(spark, tmp_path):
    folder = tmp_path / "logs"
    folder.mkdir()
    log = folder / "access.log"
    seen = []

    def step():
        stream = growing.follow_files(spark, f"{folder}/*.log*", block_bytes=16)
        X.run_to_table(spark, stream, str(tmp_path / "run"))
        seen.append(sorted(r.value for r in spark.read.parquet(str(tmp_path / "run" / "out")).collect()))

    log.write_bytes(b"one\ntwo is a line that spans blocks\nthr")
    step()
    with log.open("ab") as f:
        f.write("ée\r\n\nfive".encode())
    step()
    log.rename(folder / "access.log.1")  # rotated: the old file is read to its end, the new one from its start
    with (folder / "access.log.1").open("ab") as f:
        f.write(b" and a half\n")
    log.write_bytes(b"one\nsix\n")
    step()
    step()
    long = sorted(["one", "two is a line that spans blocks"])
    assert seen[0] == long
    assert seen[1] == sorted([*long, "thrée", ""])
    assert seen[2] == seen[3] == sorted([*seen[1], "five and a half", "one", "six"])


def test_a_file_that_was_emptied_is_read_again(tmp_path):
    log = tmp_path / "a.log"
    log.write_bytes(b"a long first line\n")
    reader = growing.GrowingLinesReader({"path": str(log)})
    first = reader.latestOffset()
    log.write_bytes(b"b\nc")
    second = reader.latestOffset()
    parts = reader.partitions(first, second)
    assert [x for p in parts for b in reader.read(p) for x in b.column("value").to_pylist()] == ["b"]
    os.remove(log)
    assert reader.partitions(second, reader.latestOffset()) == []


@pytest.mark.parametrize("n", [40, 0])
def test_growing_log_passes_over_empty_pieces(spark, tmp_path, n):
    """One row group read in many splits: the first split has no rows, and its piece of the log no bytes."""
    import __spark_entry__ as entry

    kinds = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
    start = datetime.datetime(2024, 1, 1)
    rows = [(i, start + datetime.timedelta(seconds=i), i % 5, ACTIONS[i % 5], float(i), '{"k": %d}' % i) for i in range(n)]
    spark.createDataFrame(rows, kinds).coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "512b")
    spark.conf.set("spark.sql.files.openCostInBytes", "1b")
    try:
        found = entry.queries()["S12_follow_growing_log"](spark, str(tmp_path))
        assert found.count() == sum(i % 97 != 0 for i in range(n))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_rows_are_sorted_as_pandas_sorts_them_and_kept_with_their_types():
    rows = pd.DataFrame({"ts": [2.0, 1.0, 1.0, 2.0, 1.0], "n": [3.0, None, 5.0, 1.0, 5.0], "s": ["b", None, "a", "c", "d"], "m": [1, 2, 3, 4, 5]})
    rows["d"] = pd.array([1, None, 3, None, 5], dtype="Int64")
    for order in (["ts", "n"], ["ts", "s"], ["ts", "d"], ["ts"]):
        pd.testing.assert_frame_equal(O.in_order(rows, order), rows.sort_values(order, kind="stable"))
    pd.testing.assert_frame_equal(O.unpacked(O.packed(rows)), rows)
