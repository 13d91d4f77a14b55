"""Streaming operators, each run over stored rows until nothing is left."""

import os
from glob import glob
from urllib.parse import urlparse

from pyspark.sql import functions as F

from alertloom.operators import slices as S
from alertloom.operators import thresholds as T
from alertloom.operators.scans import prefix_sum, rank_in_key
from alertloom.plans import staging
from alertloom.sources import growing, logs
from alertloom.streaming import ordered as O
from alertloom.streaming import streams as X
from catalog.host import fresh_folder
from catalog.models import ACTIONS
from catalog.registry import EV, query
from catalog.web import GAP, RQ, ST, stitched
from catalog.windows import rounded

RUNS = 3


def in_turns(spark, df, folder, make, mode="append", closing=None, jitter_s=0.0, runs=RUNS):
    """The rows arrive in `runs` turns of time; after each the stream goes on from its checkpoint, so that state is carried
    from micro-batch to micro-batch. With `jitter_s` a row may be late by up to so many seconds and comes in a later turn, behind younger
    ones. `closing` names the key column of streams in event order: a closing row ends the log. make: from the live rows to
    the streamed result."""
    low, high = df.agg(F.min("ts"), F.max("ts")).first()
    late = F.pmod(F.xxhash64(*df.columns), F.lit(1000)) / 1000 * jitter_s
    turn = F.least(F.floor((F.col("ts") + late - low) / max(high - low, 1e-9) * runs), F.lit(runs - 1))
    parts = [df.filter(turn == k) for k in range(runs)]
    if closing:
        parts.append(X.closing_row(df, closing, high))
    for part in parts:
        part.write.mode("append").parquet(folder + "/in")
        live = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 100).parquet(folder + "/in")
        out = X.run_to_table(spark, make(live), folder, mode)
    return out


# A fixed linear scorer, so that the alerts have SQL to be compared with.
SCORER = X.LinearScorer(["depth_max", "distinct_targets"], [0.5, 0.0625], -3.75)
TAU = 0.51
TICKS = EV + """,
r AS (SELECT *, row_number() OVER (PARTITION BY campaign_id ORDER BY ts, event_id) AS rn, count(*) OVER (PARTITION BY campaign_id) AS n FROM ev),
tick AS (SELECT *, unnest(generate_series(CAST(ceil(rn / 16.0) AS BIGINT) * 16, least(n, rn + 31), 16)) AS seen FROM r),
z AS (SELECT campaign_id, seen, arg_max(ts, rn) AS ts, 1 / (1 + exp(-(max(depth) * 0.5 + count(DISTINCT target) * 0.0625 - 3.75))) AS risk FROM tick GROUP BY ALL),
al AS (SELECT *, row_number() OVER (PARTITION BY campaign_id ORDER BY seen) AS k FROM z WHERE risk >= 0.51)"""


@query("R1_campaign_alerts", f"WITH {TICKS} SELECT campaign_id, ts, round(risk, 9) AS risk, CAST(seen AS BIGINT) AS events_seen FROM al WHERE k = 1")
def campaign_alerts(spark, sf):
    folder = fresh_folder(spark)
    alerts = lambda live: O.alert_campaigns(live, SCORER, TAU, ACTIONS)
    return rounded(in_turns(spark, staging.events(spark, sf), folder, alerts, closing="campaign_id", jitter_s=80_000), {"risk": 9})


@query("R2_replay", f"""WITH {TICKS}, s AS (SELECT campaign_id, max(label) AS is_attack, coalesce(min(ts) FILTER (WHERE label = 1), min(ts)) AS onset_ts FROM ev GROUP BY 1)
SELECT campaign_id, is_attack, onset_ts, al.ts AS alert_ts, round(risk, 9) AS risk, CAST(seen AS BIGINT) AS events_seen, al.ts IS NOT NULL AS detected, al.ts - onset_ts AS mttd_s FROM s LEFT JOIN (SELECT * FROM al WHERE k = 1) al USING (campaign_id)""")
def replay(spark, sf):
    folder = fresh_folder(spark)
    e = staging.events(spark, sf)
    e.repartitionByRange("ts").write.parquet(folder + "/in")
    ddl = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in e.schema.fields)
    return rounded(X.replay(spark, folder + "/in", ddl, SCORER, TAU, folder, actions=ACTIONS), {"risk": 9})


PREFIX = [0.8, -0.2, 0.1, 2.0, 3.0, -0.05]


@query("R3_session_alerts", f"""WITH {ST},
k AS (SELECT session_id, ts, row_number() OVER w AS seen, count(*) OVER (PARTITION BY session_id) AS n, coalesce(sum(delta_ms) OVER w, 0)::DOUBLE AS sd, coalesce(sum(delta_ms::HUGEINT * delta_ms) OVER w, 0)::DOUBLE AS sd2,
  count(delta_ms) OVER w AS nd, count(*) FILTER (WHERE status BETWEEN 400 AND 499) OVER w AS c4, count(*) FILTER (WHERE status BETWEEN 500 AND 599) OVER w AS c5, min(ts) OVER w AS t0
  FROM st WINDOW w AS (PARTITION BY session_id ORDER BY ts, line_id)),
m AS (SELECT *, sd / greatest(nd, 1) AS mean FROM k WHERE seen % 5 = 0 OR seen = n),
z AS (SELECT *, 0.8 * ln(1 + seen) - 0.2 * ln(1 + mean) + 0.1 * ln(1 + sqrt(greatest(0, sd2 / greatest(nd, 1) - mean * mean))) + 2.0 * c4 / seen + 3.0 * c5 / seen - 0.05 * ln(1 + (ts - t0) * 1000) - 0.5 AS z FROM m),
h AS (SELECT *, 1 / (1 + exp(-z)) >= 0.4 AS hit FROM z), t AS (SELECT *, hit AND lag(hit) OVER (PARTITION BY session_id ORDER BY seen) AS two FROM h)
SELECT session_id, min(seen) AS seen, arg_min(ts - t0, seen) AS flag_after_s FROM t WHERE two GROUP BY session_id""")
def session_alerts(spark, sf):
    """Requests are stitched live, and the alerter reads the stitcher's stream: two stateful operators in one query."""
    folder = fresh_folder(spark)
    scorer = O.LinearScorer(O.PREFIX_FEATURES, PREFIX, -0.5)
    rows = staging.requests(spark, sf).select("line_id", "ts", "src_ip", "ua", "status")
    alerts = lambda live: O.alert_sessions(O.stitch_stream(live, GAP, "1 day"), scorer, 0.4, 5, 2, GAP, None)
    return in_turns(spark, rows, folder, alerts, closing="src_ip", jitter_s=80_000)


@query("R4_live_requests", f"WITH {ST} SELECT line_id, session_id, is_new_session, delta_ms FROM st")
def live_requests(spark, sf):
    """Every request with its session as it happens, in event order though a third of a day's rows come late."""
    folder = fresh_folder(spark)
    rows = staging.requests(spark, sf).select("line_id", "ts", "src_ip", "ua")
    out = in_turns(spark, rows, folder, lambda live: O.stitch_stream(live, GAP, "1 day"), closing="src_ip", jitter_s=80_000)
    return out.select("line_id", "session_id", "is_new_session", "delta_ms")


@query("R5_rates_from_panes", f"""WITH {RQ}, p AS (SELECT (floor(ts / 2) + 1) * 2 AS e, method, CAST(status AS INTEGER) AS status, count(*) AS n, sum(resp_bytes) AS b FROM rq GROUP BY ALL),
c AS (SELECT e, method, status, n, b FROM p UNION ALL SELECT e + 86400, method, status, -n, -b FROM p), d AS (SELECT e, method, status, sum(n) AS n, sum(b) AS b FROM c GROUP BY ALL)
SELECT e::DOUBLE AS window_end, method, status, (sum(n) OVER w)::BIGINT AS n, (sum(b) OVER w)::BIGINT AS sum_resp_bytes FROM d WINDOW w AS (PARTITION BY method, status ORDER BY e)""")
def rates_from_panes(spark, sf):
    """The last 24 hours, to two seconds."""
    folder = fresh_folder(spark)
    rows = staging.requests(spark, sf).select("ts", "method", "status", "resp_bytes")
    rates = lambda live: O.trailing_rates(live, ["method", "status"], "24 hours", "2 seconds", "1 day", ["resp_bytes"])
    return in_turns(spark, rows, folder, rates, closing="method", jitter_s=80_000)


FOLLOWED = f"WITH {RQ} SELECT ts, src_ip, method, path, CAST(length(qs) AS BIGINT) AS qs_len, CAST(status AS INTEGER) AS status, resp_bytes, ua, referer FROM rq WHERE line_id % 97 <> 0"


@query("S12_follow_access_log", FOLLOWED)
def follow_access_log(spark, sf):
    folder = fresh_folder(spark)
    staging.access_lines(spark, sf).select("value").write.text(folder + "/in")
    return X.run_to_table(spark, X.stream_access_log(spark, folder + "/in", 1), folder)


@query("S12_follow_growing_log", FOLLOWED)
def follow_growing_log(spark, sf):
    """One file that grows by pieces which end in the middle of lines, and is rotated once."""
    folder = fresh_folder(spark)
    staging.access_lines(spark, sf).select("value").write.text(folder + "/parts")
    home = urlparse(folder).path
    pieces = [p for p in sorted(glob(f"{home}/parts/part-*")) if os.path.getsize(p)]  # a partition without rows may leave an empty file
    if not pieces:
        open(f"{home}/access.log", "ab").close()
        return X.run_to_table(spark, logs.parse_access_log(growing.follow_files(spark, f"{home}/access.log*").select("value")), folder)
    for k, piece in enumerate(pieces):
        if k == len(pieces) // 2:
            os.rename(f"{home}/access.log", f"{home}/access.log.1") if k else None
        with open(piece, "rb") as source:
            for part in iter(lambda: source.read(max(1, os.path.getsize(piece) * 2 // 3)), b""):
                with open(f"{home}/access.log", "ab") as log:
                    log.write(part)
                if k in (0, len(pieces) - 1):
                    out = X.run_to_table(spark, logs.parse_access_log(growing.follow_files(spark, f"{home}/access.log*").select("value")), folder)
    return out


@query("R4_live_sessions", f"WITH {ST} SELECT session_id, any_value(src_ip) AS src_ip, any_value(uah) AS uah, count(*) AS n_req, min(ts) AS ts_start, max(ts) AS ts_end FROM st GROUP BY session_id")
def live_sessions(spark, sf):
    folder = fresh_folder(spark)
    rows = staging.requests(spark, sf).select("line_id", "ts", "src_ip", "ua")
    return in_turns(spark, rows, folder, lambda live: X.stream_sessions(live, f"{GAP} seconds", "1 day"), "complete")


@query("R4_closed_sessions", f"""WITH {ST} SELECT session_id, any_value(src_ip) AS src_ip, any_value(uah) AS uah, count(*) AS n_req, min(ts) AS ts_start, max(ts) AS ts_end FROM st GROUP BY session_id
HAVING max(ts) + {GAP} <= (SELECT max(ts) FROM rq) - 86400""")
def closed_sessions(spark, sf):
    """Append mode: sessions still open at the end of the input are held back."""
    folder = fresh_folder(spark)
    rows = staging.requests(spark, sf).select("line_id", "ts", "src_ip", "ua")
    return in_turns(spark, rows, folder, lambda live: X.stream_sessions(live, f"{GAP} seconds", "1 day"))


@query("R5_trailing_rates", f"""WITH {RQ}, w AS (SELECT method, status, unnest(generate_series((floor(ts / 7200)::BIGINT - 2) * 7200 + 21600, (floor(ts / 7200)::BIGINT) * 7200 + 21600, 7200))::DOUBLE AS window_end, resp_bytes FROM rq)
SELECT window_end, method, CAST(status AS INTEGER) AS status, count(*) AS n, CAST(sum(resp_bytes) AS BIGINT) AS sum_resp_bytes FROM w GROUP BY ALL""")
def trailing_rates(spark, sf):
    folder = fresh_folder(spark)
    rows = staging.requests(spark, sf).select("ts", "method", "status", "resp_bytes")
    rates = lambda live: X.stream_rates(live, ["method", "status"], "6 hours", "2 hours", "1 day", ["resp_bytes"])
    return in_turns(spark, rows, folder, rates, "complete")


@query("R6_append_and_latest", f"WITH {EV} SELECT campaign_id, max(event_id) AS event_id FROM ev GROUP BY 1")
def append_and_latest(spark, sf):
    folder = fresh_folder(spark)
    rows = staging.events(spark, sf).select("event_id", "campaign_id", "ts")
    rows.repartitionByRange("ts").write.parquet(folder + "/in")
    live = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(folder + "/in")
    X.append_stream(live, folder + "/table", folder + "/state", "parquet").awaitTermination()
    rows = spark.read.parquet(folder + "/table")
    return S.latest_per_key(rows, ["campaign_id"], ["ts", "event_id"]).select("campaign_id", "event_id")


@query("R7_watermark_batch", f"WITH {RQ} SELECT line_id, ts FROM rq")
def watermark_batch(spark, sf):
    """In a batch run the watermark drops nothing."""
    return X.with_lateness(staging.requests(spark, sf)).select("line_id", "ts")


@query("R3_session_ticks", f"""WITH {ST}, k AS (SELECT session_id, ts, row_number() OVER w AS seen, count(*) OVER (PARTITION BY session_id) AS n, count(*) FILTER (WHERE status >= 400) OVER w AS bad, min(ts) OVER (PARTITION BY session_id) AS t0, max(ts) OVER (PARTITION BY session_id) AS t1 FROM st WINDOW w AS (PARTITION BY session_id ORDER BY ts, line_id)),
t AS (SELECT *, seen // 5 AS tick, bad / seen >= 0.3 AS hit FROM k WHERE seen % 5 = 0), h AS (SELECT *, hit AND lag(hit) OVER (PARTITION BY session_id ORDER BY tick) AS two FROM t)
SELECT session_id, min(tick) AS tick, round(min(tick) * 5 / any_value(n) * any_value(t1 - t0), 4) AS flag_after_s FROM h WHERE two GROUP BY 1""")
def session_ticks(spark, sf):
    """The batch twin: a tick every fifth request, flagged after two in a row."""
    st = stitched(spark, sf)
    ranked = rank_in_key(st, "session_id", "ts", ["line_id"]).withColumn("tick", F.floor(F.col("rn") / 5) + 1)
    whole = st.groupBy("session_id").agg(F.count(F.lit(1)).alias("n_req"), (F.max("ts") - F.min("ts")).alias("duration_s"))
    per = ranked.groupBy("session_id", "tick").agg(F.count(F.lit(1)).alias("c"), F.count_if(F.col("status") >= 400).alias("bad"))
    run = prefix_sum(per, "tick", {"seen": "c", "bads": "bad"}, ["session_id"]).filter(F.col("c") == 5)
    ticks = run.join(whole, "session_id").withColumn("score", F.col("bads") / F.col("seen"))
    out = T.consecutive_flag(ticks, 0.3)
    return out.withColumn("flag_after_s", F.round("flag_after_s", 4))
