"""Windows and ordered scans against plain Python loops."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from alertloom.operators import scans
from alertloom.operators import windows as W
from alertloom.plans import staging


def naive_windows(n, size=32, stride=16):
    out = []
    for start in range(0, max(1, n - size + 1), stride):
        length = min(size, n - start)
        if length >= size // 2:
            out.append((start // stride, length))
    return out


@pytest.mark.parametrize("n, expected", [(15, 0), (16, 1), (31, 1), (32, 1), (47, 1), (48, 2), (60, 2), (64, 3)])
def test_window_count_by_campaign_length(spark, n, expected):
    ev = spark.range(n).select(F.lit("c").alias("campaign_id"), F.col("id").cast("double").alias("ts"), F.col("id").alias("event_id"))
    got = sorted((r["window_id"], r["n_events"]) for r in W.count_windows(ev).collect())
    assert len(got) == expected and got == naive_windows(n)


def hot_events(spark, seed=5):
    """One campaign holds more than a third of all rows, some at equal times."""
    rnd = random.Random(seed)
    rows = []
    for i in range(3000):
        c = "hot" if rnd.random() < 0.4 else f"c{rnd.randrange(40)}"
        rows.append((i, c, float(rnd.randrange(4000)) + rnd.choice([0.0, 0.25, 0.5])))
    return spark.createDataFrame(rows, "event_id long, campaign_id string, ts double")


def test_rank_in_key_equals_one_window(spark):
    ev = hot_events(spark).unionByName(spark.createDataFrame([(9000 + k, None, float(k)) for k in range(5)], "event_id long, campaign_id string, ts double"))
    w = Window.partitionBy("campaign_id").orderBy("ts", "event_id")
    plain = ev.withColumn("rn", (F.row_number().over(w) - 1).cast("long")).withColumn("prev_ts", F.lag("ts").over(w))
    key = lambda df: sorted(map(str, df.select("event_id", "rn", "prev_ts").collect()))
    assert key(plain) == key(scans.rank_in_key(ev, "campaign_id", "ts", ["event_id"]))


def test_parts_are_even_on_any_values(spark, monkeypatch):
    """One time of 0, one outlier of 1e12 and one key with a burst at a single instant."""
    rows = [(k, "hot", 1.7e9) for k in range(6000)] + [(6000, "hot", 0.0), (6001, "hot", 1e12)] + [(7000 + k, f"c{k % 9}", 1.7e9 + k) for k in range(2000)]
    ev = spark.createDataFrame(rows, "event_id long, campaign_id string, ts double").repartition(7)
    monkeypatch.setattr(scans, "PART_ROWS", 500)
    sizes = [r["count"] for r in scans.in_parts(ev, ["campaign_id"], ["ts", "event_id"]).groupBy("__g", "__part").count().collect()]
    assert max(sizes) <= 500 and len(sizes) >= 20
    got = {r["event_id"]: r["rn"] for r in scans.rank_in_key(ev, "campaign_id", "ts", ["event_id"]).filter("campaign_id = 'hot'").collect()}
    assert [got[6000], got[0], got[5999], got[6001]] == [0, 1, 6000, 6001]
    run = {r["event_id"]: r["n"] for r in scans.prefix_sum(ev.withColumn("one", F.lit(1)), "ts", {"n": "one"}, ties=["event_id"]).collect()}
    assert sorted(run.values()) == list(range(1, len(rows) + 1)) and run[6000] == 1 and run[6001] == len(rows)


@pytest.mark.parametrize("part_rows", [1 << 20, 40])
def test_cut_scans_equal_one_window(spark, monkeypatch, part_rows):
    """Scores crowded below 1e-9, a value that most rows share, nulls, a null group and ties, in rising and falling order."""
    monkeypatch.setattr(scans, "PART_ROWS", part_rows)
    rnd = random.Random(3)
    score = lambda: rnd.choice([rnd.random() * 1e-9, rnd.random() * 1e-300, 0.5, 0.5, 1.0, None, rnd.random()])
    rows = [(i, score(), rnd.randrange(9), rnd.choice(["a", "a", "a", "b", None])) for i in range(3000)]
    df = spark.createDataFrame(rows, "id long, x double, v long, g string")
    w = Window.partitionBy("g")
    for descending, order in ((False, F.col("x").asc()), (True, F.col("x").desc())):
        got = scans.prefix_sum(df, "x", {"s": "v"}, ["g"], ["id"], descending, totals={"t": "s"})
        want = df.withColumn("s", F.sum("v").over(w.orderBy(order, "id"))).withColumn("t", F.sum("v").over(w))
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    ranked = scans.rank_in_key(df, "g", "x", ["id"]).select("id", "rn", "prev_ts")
    want = df.select("id", (F.row_number().over(w.orderBy("x", "id")) - 1).cast("long").alias("rn"), F.lag("x").over(w.orderBy("x", "id")).alias("prev_ts"))
    assert sorted(map(str, ranked.collect())) == sorted(map(str, want.collect()))


def test_scans_write_no_rows_and_sort_once(spark, sf):
    plan = scans.rank_in_key(staging.events(spark, sf), "campaign_id", "ts", ["event_id"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "rangepartitioning" not in plan and "ExistingRDD" not in plan


def test_no_row_is_lost_on_null_keys(spark):
    from alertloom.operators import slices, splits, thresholds, web

    entries = spark.createDataFrame([("v1", "a", 1, "h1", 0.5), ("v1", "a", None, "h2", 0.6), (None, "a", 1, "h3", None)], "splits_version string, split string, seed int, submission_hash string, m double")
    assert sorted((r["submission_hash"], r["rank"]) for r in slices.rank_leaderboard(entries, "m").collect()) == [("h1", 1), ("h2", 1), ("h3", 1)]
    scored = spark.createDataFrame([(None, 1, 0.9), (None, 0, 0.1), ("a", 1, 0.2), ("a", 0, 0.8)], "g string, y int, score double")
    assert {r["g"]: r["pr_auc"] for r in thresholds.average_precision(scored, by=["g"]).collect()} == {None: 1.0, "a": 0.5}
    assert scans.exact_percentiles(scored, "score", [0.0, 1.0], ["g"]).count() == 4
    req = spark.createDataFrame([(1, 0.0, None, "x"), (2, 5.0, None, "x"), (3, 1.0, "1.2.3.4", None)], "line_id long, ts double, src_ip string, ua string")
    assert sorted(r["line_id"] for r in web.stitch_sessions(req).collect()) == [1, 2, 3]
    rows = spark.createDataFrame([(None, 1.0, 1, "a"), (None, 2.0, 2, None), ("s", 1.0, 3, None)], "k string, ts double, id long, v string")
    assert {r["id"]: r["c"] for r in scans.carry_forward(rows, ["k"], "ts", ["id"], "v", "c").collect()} == {1: "a", 2: "a", 3: None}
    ev = spark.createDataFrame([(None, 0), (None, 1), ("c", 0)], "campaign_id string, label int")
    assert sorted(str(tuple(r)) for r in W.promote_labels(ev).collect()) == ["('c', 0)", "(None, 1)", "(None, 1)"]
    assert splits.group_split(ev, "campaign_id", 0.5).count() == 3
    rates = slices.rate_by_stealth(spark.createDataFrame([("s1", None, True, 0.9, "agent", 1), ("s2", "f", True, 0.9, "agent", 1)], "session_id string, family string, stealth boolean, agent_score double, klass string, y int"), 0.5)
    assert sorted(str((r["family"], r["n"])) for r in rates.collect()) == ["('f', 1)", "(None, 2)"]


def test_prefix_sum_equals_running_sum(spark):
    rnd = random.Random(1)
    values = [(i, rnd.choice([rnd.random(), rnd.random() * 1e-6, 0.5]), rnd.randrange(9), rnd.choice("ab")) for i in range(2000)]
    df = spark.createDataFrame(values, "id long, x double, v long, g string")
    for descending in (False, True):
        got = {r["id"]: (r["s"], r["t"]) for r in scans.prefix_sum(df, "x", {"s": "v"}, ["g"], ["id"], descending, totals={"t": "s"}).collect()}
        for g in "ab":
            part = sorted((r for r in values if r[3] == g), key=lambda r: (-r[1] if descending else r[1], r[0]))
            total, run = sum(r[2] for r in part), 0
            for i, _, v, _ in part:
                run += v
                assert got[i] == (run, total)


def test_exact_percentiles(spark):
    import numpy as np

    rnd = random.Random(2)
    values = [rnd.choice([rnd.random(), 0.25]) for _ in range(777)]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    probs = [0.0, 0.05, 0.5, 0.95, 1.0]
    got = {r["prob"]: r["value"] for r in scans.exact_percentiles(df, "x", probs).collect()}
    for p in probs:
        assert got[p] == pytest.approx(float(np.quantile(values, p)), abs=1e-12)


def test_rank_by_sort(spark):
    df = spark.range(500).select(F.concat(F.lit("k"), F.col("id") % 37).alias("a"), F.col("id"))
    got = [(r["a"], r["id"], r["rank"], r["n_total"]) for r in scans.rank_by_sort(df, "a", "id").collect()]
    want = sorted((a, i) for a, i in ((f"k{i % 37}", i) for i in range(500)))
    assert sorted(got, key=lambda r: r[2]) == [(a, i, k + 1, 500) for k, (a, i) in enumerate(want)]


def test_carry_forward(spark):
    rows = [("s", float(t), t, v) for t, v in [(0, None), (10, "a"), (70, None), (200, None), (260, "b"), (261, None), (900, None)]]
    df = spark.createDataFrame(rows, "k string, ts double, id long, v string")
    got = [r["c"] for r in scans.carry_forward(df, ["k"], "ts", ["id"], "v", "c").orderBy("ts").collect()]
    assert got == [None, "a", "a", "a", "b", "b", "b"]


def test_row_order_does_not_matter(spark, sf):
    ev = staging.events(spark, sf)
    shuffled = ev.orderBy(F.rand(3)).repartition(5)
    rows = lambda df: sorted(map(str, W.count_windows(df).collect()))
    assert rows(ev) == rows(shuffled)


def test_dyadic_cells_cover_spans_exactly(spark):
    """Ten years, one base cell, a span before 1970 and random ones: few cells, which hold the span's base cells and no others."""
    rnd = random.Random(4)
    spans = [(0, 0.0, 3.15e8), (1, 61.0, 62.0), (2, -1000.0, 1000.0), (3, 5.0, -5.0)]
    spans += [(k, s := rnd.uniform(-1e4, 1e6), s + rnd.choice([0.0, 59.0, 1e3, 1e5])) for k in range(4, 60)]
    df = spark.createDataFrame(spans, "id long, lo double, hi double")
    got = {}
    for r in df.select("id", scans.dyadic_cells(F.col("lo"), F.col("hi"), 60.0).alias("at")).collect():
        got.setdefault(r.id, []).append((r.at.level, r.at.cell))
    assert len(got[0]) < 60 and 3 not in got
    for k, lo, hi in spans[1:]:
        base = sorted(c for level, cell in got.get(k, []) for c in range(cell << level, (cell + 1) << level))
        assert base == list(range(int(lo // 60), int(hi // 60) + 1)), (lo, hi)


def test_labels_by_host_window_equal_plain_search(spark):
    from alertloom.operators import labelling

    rnd = random.Random(5)
    spans = [(k, rnd.choice(["a", "b", None]), s := rnd.uniform(0, 5000), s + rnd.choice([-1.0, 0.0, 3.0, 200.0, 9000.0])) for k in range(25)] + [(99, "c", 0.0, 3e9)]
    events = [(k, rnd.choice(["a", "b", "c", None]), rnd.choice([rnd.uniform(0, 9000), float(rnd.randrange(9000))]), k % 5 == 0) for k in range(800)]
    steps = spark.createDataFrame(spans, "step_id long, host string, t_start double, t_end double")
    ev = spark.createDataFrame([(k, h, t, int(b)) for k, h, t, b in events], "id long, host string, ts double, label int").withColumn("guid", F.concat(F.lit("g"), F.col("id") % 50))
    inside = lambda h, t, pad: [k for k, sh, lo, hi in spans if h is not None and sh == h and lo - pad <= t <= hi + pad]
    assert {r.id: r.label for r in labelling.label_by_host_window(ev, steps).collect()} == {k: int(bool(inside(h, t, 0.0)) or b) for k, h, t, b in events}
    pairs = {(s, f"g{k % 50}") for k, h, t, _ in events for s in inside(h, t, 5.0)}
    assert {tuple(r) for r in labelling.match_steps(steps, ev).collect()} == pairs
    assert {r.guid for r in labelling.matched_guids(steps, ev).collect()} == {g for _, g in pairs}
    assert {r.step_id for r in labelling.unmatched_steps(steps, ev).collect()} == {k for k, *_ in spans} - {s for s, _ in pairs}
