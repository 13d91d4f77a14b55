"""Host telemetry: sources, normalization, process trees, labels, alert economics."""

import os
import uuid

from pyspark.sql import functions as F

from alertloom import fixed
from alertloom.functions import columns as C
from alertloom.operators import economics as E
from alertloom.operators import graph as G
from alertloom.operators import labelling as L
from alertloom.operators import normalize as N
from alertloom.operators import windows as W
from alertloom.plans import staging
from alertloom.session import cut_lineage, shared_folder
from alertloom.sources import logs
from catalog.registry import EV, MEMBERS, WSCORED, case_map, query, tactic_sql
from catalog.scores import WTAU, scored_windows
from catalog.windows import _MIX, features, members, rounded


def fresh_folder(spark):
    return os.path.join(shared_folder(spark), f"run-{uuid.uuid4().hex}")


PT = EV + """,
pr AS (SELECT *, row_number() OVER (PARTITION BY campaign_id ORDER BY ts, event_id) AS r FROM ev),
pt AS (SELECT a.event_id, a.ts, a.host, a.eid, 'g' || a.event_id AS guid, coalesce('g' || b.event_id, '') AS parent_guid
       FROM pr a LEFT JOIN pr b ON a.campaign_id = b.campaign_id AND a.r // 2 = b.r),
steps AS (SELECT event_id AS step_id, host, technique AS technique_id, ts AS t_start, ts + 1 AS t_end FROM ev WHERE event_id % 50 = 0)"""


@query("S1_json_lines", f"WITH {EV} SELECT event_id, campaign_id, ts, action, depth FROM ev WHERE event_id % 10 <> 3")
def json_lines(spark, sf):
    path = fresh_folder(spark)
    e = staging.events(spark, sf).select("event_id", "campaign_id", "ts", "action", "depth")
    line = F.to_json(F.struct("*"))
    lines = e.select(F.when(F.col("event_id") % 10 == 3, F.concat(line, F.lit('{"'))).otherwise(line).alias("value"))
    lines.unionByName(lines.select(F.lit("").alias("value"))).write.text(path)
    return logs.read_jsonl(spark, path, "event_id long, campaign_id string, ts double, action string, depth int")


@query("S2_json_arrays", f"WITH {EV} SELECT event_id, campaign_id, ts, action, depth FROM ev")
def json_arrays(spark, sf):
    """Files of 500 events each, every second one with its array under "events"."""
    path = fresh_folder(spark)
    e = staging.events(spark, sf).select("event_id", "campaign_id", "ts", "action", "depth")
    text = F.to_json(F.collect_list(F.struct(*e.columns)))
    files = e.groupBy(F.floor(F.col("event_id") / 500).alias("file")).agg(text.alias("value"))
    wrapped = F.when(F.col("file") % 2 == 1, F.concat(F.lit('{"events":'), "value", F.lit("}"))).otherwise(F.col("value"))
    files.select("file", wrapped.alias("value")).write.partitionBy("file").text(path)
    return logs.read_json_events(spark, path + "/*", "event_id long, campaign_id string, ts double, action string, depth int")


@query("S3_csv_and_parquet", f"WITH {EV} SELECT event_id, action, artifact_ai FROM ev")
def csv_and_parquet(spark, sf):
    path = fresh_folder(spark)
    e = staging.events(spark, sf).select("event_id", "action", "artifact_ai")
    e.filter(F.col("event_id") % 2 == 0).write.option("header", True).csv(path + ".csv")
    e.filter(F.col("event_id") % 2 == 1).write.parquet(path + ".parquet")
    schema = "event_id long, action string, artifact_ai double"
    return N.stack(logs.read_any(spark, path + ".csv", schema), logs.read_any(spark, path + ".parquet"))


@query("S8_append", f"WITH {EV} SELECT event_id, action, campaign_id FROM ev")
def append_twice(spark, sf):
    path = fresh_folder(spark)
    e = staging.events(spark, sf).select("event_id", "action", "campaign_id")
    logs.append(e.filter(F.col("event_id") % 3 == 0), path, "parquet", ["action"])
    logs.append(e.filter(F.col("event_id") % 3 != 0), path, "parquet", ["action"])
    return spark.read.parquet(path)


def _step_reports(spark, sf, fields, flat=False):
    """One JSON report per step, in several of the shapes the readers accept."""
    s = staging.steps(spark, sf)
    kind = F.col("step_id") / 50 % 4
    iso = lambda c: F.date_format(F.timestamp_seconds(c), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    plain = F.struct(F.col("host"), F.col("technique_id"), F.col("t_start"), F.col("t_end"))
    nested = F.struct(F.struct(F.col("host").alias("hostname")).alias("host"), F.struct("technique_id").alias("technique"), (F.col("t_start") * 1000).alias(fields[0]), (F.col("t_end") * 1000).alias(fields[1]))
    if flat:
        nested = F.struct(F.col("host").alias("ComputerName"), F.col("technique_id").alias("attack_technique"), (F.col("t_start") * 1000).alias(fields[0]), (F.col("t_end") * 1000).alias(fields[1]))
    text = F.struct(F.col("host"), F.col("technique_id"), iso("t_start").alias(fields[0]))
    broken = F.struct(F.col("host"), F.lit("").alias("technique_id"), F.col("t_start"))
    step = F.when(kind == 0, F.to_json(plain)).when(kind == 1, F.to_json(nested)).when(kind == 2, F.to_json(text)).otherwise(F.to_json(broken))
    return s.select("step_id", kind.alias("kind"), step.alias("step"))


_STEP_SQL = f"""WITH {PT} SELECT step_id, host, technique_id, round(t_start, 3) AS t_start, round(CASE WHEN step_id // 50 % 4 = 2 THEN t_start + 5 ELSE t_end END, 3) AS t_end FROM steps WHERE step_id // 50 % 4 <> 3"""


@query("S5_operation_steps", _STEP_SQL)
def operation_steps(spark, sf):
    rows = _step_reports(spark, sf, ("decide", "finish"))
    body = F.when(F.col("kind") == 0, F.concat(F.lit('{"operation":{"steps":['), "step", F.lit("]}}"))).otherwise(F.concat(F.lit('{"links":['), "step", F.lit("]}")))
    out = logs.caldera_steps(rows.select("step_id", body.alias("value")))
    return rounded(out.select("step_id", "host", "technique_id", "t_start", "t_end"), {"t_start": 3, "t_end": 3})


@query("S6_invocation_steps", _STEP_SQL)
def invocation_steps(spark, sf):
    rows = _step_reports(spark, sf, ("start", "end"), flat=True)
    body = F.concat(F.lit('{"invocations":['), "step", F.lit("]}"))
    out = logs.atomic_steps(rows.select("step_id", body.alias("value")))
    return rounded(out.select("step_id", "host", "technique_id", "t_start", "t_end"), {"t_start": 3, "t_end": 3})


@query("P1_adapt_generic", "SELECT event_id, CAST(user_id AS VARCHAR) AS campaign_id, epoch_us(ts) / 1e6 AS ts, event_type AS action, props AS target, CAST(0 AS INTEGER) AS label, CAST(0 AS INTEGER) AS depth, 0.0::DOUBLE AS artifact_ai FROM events")
def adapt_generic(spark, sf):
    raw = staging.table(spark, sf, "events")
    raw = raw.withColumn("user_id", F.col("user_id").cast("string")).withColumn("ts", C.to_unix(raw, "ts")).withColumn("bad", F.lit(0)).drop("value")
    return N.adapt_generic(raw, {"user_id": "campaign_id", "event_type": "action", "props": "target", "bad": "label"})


@query("P3_unix_times", "SELECT event_id, epoch_us(date_trunc('second', ts)) / 1e6 AS from_text, epoch_us(date_trunc('second', ts)) / 1e6 AS from_ms, CASE WHEN event_id % 5 = 0 THEN 'unknown' ELSE strftime(ts, '%Y-%m-%d') END AS day FROM events")
def unix_times(spark, sf):
    raw = staging.table(spark, sf, "events").withColumn("text", F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    seconds = F.floor(C.to_unix(raw, "ts"))
    bad = F.when(F.col("event_id") % 5 != 0, seconds)
    return raw.select("event_id", C.to_unix(raw, "text").alias("from_text"), C.to_unix_ms_aware(F.when(F.col("event_id") % 2 == 0, seconds * 1000).otherwise(seconds)).alias("from_ms"), C.utc_day(bad).alias("day"))


def winlog(spark, sf):
    """Raw Sysmon-like rows: the source column names the adapter looks for."""
    e = staging.events(spark, sf).select("event_id", "technique", "target", "campaign_id")
    p = staging.processes(spark, sf).join(e, "event_id")
    n = F.col("event_id")
    return p.select(
        n.alias("event_key"), F.date_format(F.timestamp_seconds(F.floor("ts")), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("UtcTime"), F.col("host").alias("Hostname"),
        F.col("campaign_id").alias("dataset"), F.when(n % 3 == 0, "Security").when(n % 3 == 1, "Microsoft-Windows-Sysmon/Operational").otherwise("other").alias("Channel"),
        F.when(n % 11 == 0, "bad").when(n % 7 == 0, "4624").otherwise(F.col("eid").cast("string")).alias("EventID"),
        F.col("guid").alias("ProcessGuid"), F.col("parent_guid").alias("ParentProcessGuid"), "technique",
        F.when(n % 2 == 0, F.col("target")).otherwise("").alias("TargetFilename"), F.when(n % 5 == 0, "image.exe").alias("Image"),
    )


_ACT = f"""CASE WHEN event_id % 11 = 0 THEN 'unknown' ELSE CASE event_id % 3
  WHEN 1 THEN coalesce({case_map('x', fixed.SYSMON_ACTIONS)}, 'sysmon_' || x) WHEN 0 THEN coalesce({case_map('x', fixed.SECURITY_ACTIONS)}, 'security_' || x)
  ELSE coalesce({case_map('x', fixed.SYSMON_ACTIONS)}, {case_map('x', fixed.SECURITY_ACTIONS)}, 'event_' || x) END END"""
_TGT = "CASE WHEN event_id % 2 = 0 AND target <> '' THEN target WHEN event_id % 5 = 0 THEN 'image.exe' ELSE host END"


@query("P5_event_actions", f"WITH {EV}, w AS (SELECT *, CASE WHEN event_id % 7 = 0 THEN 4624 ELSE eid END AS x FROM ev) SELECT event_id AS event_key, {_ACT} AS action, CASE WHEN event_id % 11 = 0 THEN -1 ELSE x END AS eid, {_TGT} AS target FROM w")
def event_actions(spark, sf):
    w = winlog(spark, sf)
    return w.select("event_key", C.action_of(F.col("Channel"), F.col("EventID")).alias("action"), C.event_id_number(F.col("EventID")).alias("eid"), C.target_of(w, F.col("Hostname")).alias("target"))


@query("P7_tactics", f"WITH {EV} SELECT event_id, {tactic_sql('technique')} AS tactic FROM ev")
def tactics(spark, sf):
    return staging.events(spark, sf).select("event_id", C.tactic_of(F.col("technique")).alias("tactic"))


@query("P9_adapt_winlog", f"""WITH RECURSIVE {PT}, d AS (SELECT guid, 0 AS depth FROM pt WHERE parent_guid = '' UNION ALL SELECT pt.guid, d.depth + 1 FROM pt JOIN d ON pt.parent_guid = d.guid),
w AS (SELECT ev.*, CASE WHEN event_id % 7 = 0 THEN 4624 ELSE eid END AS x FROM ev)
SELECT event_id AS event_key, campaign_id, floor(ts)::DOUBLE AS ts, {_ACT} AS action, {_TGT} AS target, d.depth, 0.0::DOUBLE AS artifact_ai, CAST(event_id % 4 = 0 AS INTEGER) AS label, technique, tactic
FROM w JOIN d ON d.guid = 'g' || w.event_id""")
def adapt_winlog(spark, sf):
    w = cut_lineage(winlog(spark, sf))
    guids = w.filter(F.col("event_key") % 4 == 0).select(F.col("ProcessGuid").alias("guid"))
    return N.adapt_winlog(w, guids).drop("eid", "host", "guid", "parent_guid")


@query("P26_dropout_copies", f"WITH {EV}, x AS (SELECT unnest([1, 3, 10, 11, 13]) AS dropped_eid) SELECT CAST(dropped_eid AS INTEGER) AS dropped_eid, count(*) AS n FROM ev, x WHERE eid <> dropped_eid GROUP BY 1")
def dropout_copies(spark, sf):
    return N.dropout_copies(staging.events(spark, sf), [1, 3, 10, 11, 13]).groupBy("dropped_eid").agg(F.count(F.lit(1)).alias("n"))


@query("G1_process_depth", f"WITH RECURSIVE {PT}, d AS (SELECT guid, 0 AS depth FROM pt WHERE parent_guid = '' UNION ALL SELECT pt.guid, d.depth + 1 FROM pt JOIN d ON pt.parent_guid = d.guid) SELECT guid, CAST(depth AS INTEGER) AS depth FROM d")
def process_depth(spark, sf):
    return G.process_depth(staging.processes(spark, sf))


@query("G2_malicious_closure", f"WITH RECURSIVE {PT}, c AS (SELECT guid, 0 AS hops FROM pt WHERE event_id % 97 = 5 UNION ALL SELECT pt.guid, c.hops + 1 FROM pt JOIN c ON pt.parent_guid = c.guid) SELECT guid, CAST(min(hops) AS BIGINT) AS hops FROM c GROUP BY 1")
def malicious_closure(spark, sf):
    procs = staging.processes(spark, sf)
    return G.malicious_closure(procs, procs.filter(F.col("event_id") % 97 == 5).select("guid"))


def creations(spark, sf):
    return staging.processes(spark, sf).filter(F.col("eid") == 1)


_HIT = "s.host = p.host AND p.ts BETWEEN s.t_start - {pad} AND s.t_end + {pad}"


@query("J2_match_steps", f"WITH {PT} SELECT DISTINCT step_id, guid FROM steps s JOIN pt p ON {_HIT.format(pad=600)} WHERE p.eid = 1")
def match_steps(spark, sf):
    return L.match_steps(staging.steps(spark, sf), creations(spark, sf), 600.0)


@query("J3_unmatched_steps", f"WITH {PT} SELECT step_id, host, technique_id, t_start, t_end FROM steps s WHERE NOT EXISTS (SELECT 1 FROM pt p WHERE p.eid = 1 AND {_HIT.format(pad=5)})")
def unmatched_steps(spark, sf):
    return L.unmatched_steps(staging.steps(spark, sf), creations(spark, sf))


@query("J4_label_by_host_window", f"WITH {PT} SELECT event_id, CAST(EXISTS (SELECT 1 FROM steps s WHERE {_HIT.format(pad=0)}) AS INTEGER) AS label FROM pt p")
def label_by_host_window(spark, sf):
    windows = staging.steps(spark, sf)
    ev = staging.events(spark, sf).withColumn("label", F.lit(0))
    return L.label_by_host_window(ev, windows).select("event_id", "label")


@query("J5_label_by_guid", f"WITH {PT} SELECT event_id, CAST(event_id % 6 = 0 AS INTEGER) AS label FROM pt")
def label_by_guid(spark, sf):
    procs = staging.processes(spark, sf)
    return N.label_by_guid(procs, procs.filter(F.col("event_id") % 6 == 0)).select("event_id", "label")


@query("A38_tactic_coverage", f"WITH {PT}, t AS (SELECT unnest(['recon', 'discovery', 'credential_access', 'command_execution', 'lateral_movement', 'exfiltration']) AS tactic) SELECT tactic, tactic IN (SELECT {tactic_sql('technique_id')} FROM steps) AS covered FROM t")
def tactic_coverage(spark, sf):
    return L.tactic_coverage(staging.steps(spark, sf))


@query("G3_resolve_labels", f"""WITH RECURSIVE {PT}, pc AS (SELECT * FROM pt WHERE eid = 1), seeds AS (SELECT DISTINCT guid FROM pc p WHERE EXISTS (SELECT 1 FROM steps s WHERE {_HIT.format(pad=5)})),
c AS (SELECT guid FROM seeds UNION SELECT pc.guid FROM pc JOIN c ON pc.parent_guid = c.guid),
un AS (SELECT * FROM steps s WHERE NOT EXISTS (SELECT 1 FROM pc p WHERE {_HIT.format(pad=5)}))
SELECT event_id, CAST(guid IN (SELECT guid FROM c) OR EXISTS (SELECT 1 FROM un s WHERE {_HIT.format(pad=0)}) AS INTEGER) AS label FROM pt p""")
def resolve_labels(spark, sf):
    guids, windows, _ = L.resolve_labels(staging.steps(spark, sf), cut_lineage(creations(spark, sf)))
    return L.apply_labels(staging.processes(spark, sf), guids, windows).select("event_id", "label")


@query("J15_carry_labels", f"WITH {EV} SELECT event_id, max(CAST(event_id % 29 = 0 AS INTEGER)) OVER (PARTITION BY campaign_id) AS label FROM ev WHERE eid <> 10")
def carry_labels(spark, sf):
    ev = staging.events(spark, sf)
    return N.carry_labels(N.drop_eid(ev, 10), ev.withColumn("label", (F.col("event_id") % 29 == 0).cast("int")), "event_id").select("event_id", "label")


@query("U1_stack", f"WITH {EV} SELECT event_id, action, CASE WHEN event_id % 2 = 0 THEN depth END AS depth FROM ev")
def stack(spark, sf):
    ev = staging.events(spark, sf)
    return N.stack(ev.filter(F.col("event_id") % 2 == 0).select("event_id", "action", "depth"), ev.filter(F.col("event_id") % 2 == 1).select("event_id", "action"))


@query("J6_with_manifest", f"WITH {WSCORED} SELECT campaign_id, window_id, class, framework, benign_subtype, ts_start FROM ws")
def with_manifest(spark, sf):
    return E.with_manifest(features(spark, sf).select("campaign_id", "window_id"), staging.manifest(spark, sf))


_GRP = "CASE WHEN class = 'normal' THEN 'normal' WHEN class = 'hard_negative' THEN nullif(benign_subtype, '') END"


@query("A23_fp_rates", f"""WITH {WSCORED}, g AS (SELECT *, {_GRP} AS name, CASE WHEN class = 'normal' THEN 'class' ELSE 'subtype' END AS kind FROM ws)
SELECT kind, name, count(*) AS n_windows, count(*) FILTER (WHERE score >= {WTAU}) AS fp_windows, round(count(*) FILTER (WHERE score >= {WTAU}) / count(*), 9) AS fp_rate FROM g WHERE name IS NOT NULL GROUP BY ALL""")
def fp_rates(spark, sf):
    return rounded(E.fp_rates(scored_windows(spark, sf), WTAU), {"fp_rate": 9})


@query("A23_fp_campaigns", f"WITH {WSCORED} SELECT DISTINCT benign_subtype, campaign_id FROM ws WHERE class = 'hard_negative' AND benign_subtype <> ''")
def fp_campaigns(spark, sf):
    return E.fp_campaigns(scored_windows(spark, sf))


@query("A24_time_to_detect", f"""WITH {WSCORED}, p AS (SELECT framework, campaign_id, min(window_id) FILTER (WHERE score >= {WTAU}) AS f FROM ws WHERE class = 'attack' GROUP BY ALL)
SELECT framework, count(*) AS n_campaigns, count(f) AS n_detected, round(count(f) / count(*), 9) AS detect_rate, round(avg(f) * 40.0, 6) AS mttd_s, round(quantile_cont(f, 0.95) * 40.0, 6) AS mttd_s_p95 FROM p GROUP BY 1""")
def time_to_detect(spark, sf):
    return rounded(E.mttd_by_framework(scored_windows(spark, sf), WTAU, 40.0), {"detect_rate": 9, "mttd_s": 6, "mttd_s_p95": 6})


_VALUES = lambda rows: ", ".join("(" + ", ".join(f"'{v}'" if isinstance(v, str) else f"{v}::DOUBLE" for v in r) + ")" for r in rows)
_FPH = f"""dep AS (SELECT deployment, CAST(hosts AS INTEGER) AS hosts, r AS events_per_sec_per_host, hosts * r * 3600 / 16 AS windows_per_hour FROM (VALUES {_VALUES(fixed.DEPLOYMENTS)}) v(deployment, hosts, r)),
burst AS (SELECT * FROM (VALUES {_VALUES(fixed.BURST_SHAPES)}) v(name, per_day, dur, rate)),
gr AS (SELECT strftime(make_timestamp(CAST(ts_start * 1e6 AS BIGINT)), '%Y-%m-%d') AS day, {_GRP} AS name, score FROM ws),
rates AS (SELECT {{d}} name, count(*) FILTER (WHERE score >= {WTAU}) / count(*) AS fp FROM gr WHERE name IS NOT NULL GROUP BY ALL),
days AS (SELECT DISTINCT {{dd}} FROM gr),
br AS (SELECT {{d}} deployment, burst.name AS benign_subtype, fp AS fp_rate, greatest(1, dur * rate / 16) AS windows_per_burst, per_day * hosts / 24 AS bursts_per_hour, fp * greatest(1, dur * rate / 16) * (per_day * hosts / 24) AS fp_per_hour
       FROM rates JOIN burst USING (name), dep WHERE fp > 0)"""
_TOTAL = _FPH.format(d="", dd="1 AS one")
_DAILY = _FPH.format(d="day,", dd="day")


@query("A25_fp_per_hour", f"""WITH {WSCORED}, {_TOTAL}
SELECT *, round(n + h, 6) AS total_fp_per_hour FROM (SELECT dep.*, round(coalesce((SELECT fp FROM rates WHERE name = 'normal'), 0) * windows_per_hour, 6) AS normal_fp_per_hour,
  round(coalesce((SELECT sum(fp_per_hour) FROM br WHERE br.deployment = dep.deployment), 0), 6) AS hard_negative_fp_per_hour, coalesce((SELECT fp FROM rates WHERE name = 'normal'), 0) * windows_per_hour AS n,
  coalesce((SELECT sum(fp_per_hour) FROM br WHERE br.deployment = dep.deployment), 0) AS h FROM dep)""".replace("SELECT *, round(n + h", "SELECT * EXCLUDE (n, h), round(n + h"))
def fp_per_hour(spark, sf):
    return rounded(E.fp_per_hour(scored_windows(spark, sf), WTAU), dict.fromkeys(["normal_fp_per_hour", "hard_negative_fp_per_hour", "total_fp_per_hour"], 6))


@query("A25_fp_breakdown", f"WITH {WSCORED}, {_TOTAL} SELECT deployment, benign_subtype, round(fp_rate, 9) AS fp_rate, windows_per_burst, round(bursts_per_hour, 9) AS bursts_per_hour, round(fp_per_hour, 6) AS fp_per_hour FROM br")
def fp_breakdown(spark, sf):
    return rounded(E.fp_breakdown(scored_windows(spark, sf), WTAU), {"fp_rate": 9, "bursts_per_hour": 9, "fp_per_hour": 6})


_DAY = """dy AS (SELECT days.day, deployment, coalesce((SELECT fp FROM rates WHERE name = 'normal' AND rates.day = days.day), 0) * windows_per_hour
  + coalesce((SELECT sum(fp_per_hour) FROM br WHERE br.deployment = dep.deployment AND br.day = days.day), 0) AS total FROM days, dep)"""


@query("A26_daily_fp", f"WITH {WSCORED}, {_DAILY}, {_DAY} SELECT day, deployment, round(total, 6) AS total_fp_per_hour FROM dy")
def daily_fp(spark, sf):
    return rounded(E.daily_fp(scored_windows(spark, sf), WTAU).select("day", "deployment", "total_fp_per_hour"), {"total_fp_per_hour": 6})


@query("A26_daily_distribution", f"WITH {WSCORED}, {_DAILY}, {_DAY} SELECT deployment, count(*) AS n_days, round(median(total), 6) AS median_total, round(quantile_cont(total, 0.95), 6) AS p95_total, round(min(total), 6) AS min_total, round(max(total), 6) AS max_total FROM dy GROUP BY 1")
def daily_distribution(spark, sf):
    return rounded(E.daily_distribution(E.daily_fp(scored_windows(spark, sf), WTAU)), dict.fromkeys(["median_total", "p95_total", "min_total", "max_total"], 6))


_CAL = f"""s AS (SELECT count(*) AS n_events, count(DISTINCT host) AS n_hosts, min(ts) AS t0, max(ts) - min(ts) AS span_s FROM ev), nb AS (SELECT *, CAST(floor(span_s / 3600) AS BIGINT) AS n_buckets FROM s),
b AS (SELECT CAST(floor((ts - t0) / 3600) AS BIGINT) AS i, count(*) AS c FROM ev, nb GROUP BY 1), f AS (SELECT k AS i, coalesce(c, 0) AS c FROM (SELECT unnest(generate_series(0, (SELECT n_buckets - 1 FROM nb))) AS k) LEFT JOIN b ON b.i = k)"""
_CALDIG = {"span_s": 4, "overall": 12, "bucket_mean": 12, "bucket_p50": 12, "bucket_p95": 12, "bucket_max": 12}


@query("A27_calibrate_rates", f"""WITH {EV}, {_CAL} SELECT n_events, n_hosts, round(span_s, 4) AS span_s, round(n_events / span_s / n_hosts, 12) AS overall, round((SELECT avg(c) FROM f) / 3600 / n_hosts, 12) AS bucket_mean,
  round((SELECT median(c) FROM f) / 3600 / n_hosts, 12) AS bucket_p50, round((SELECT quantile_cont(c, 0.95) FROM f) / 3600 / n_hosts, 12) AS bucket_p95, round((SELECT max(c) FROM f) / 3600 / n_hosts, 12) AS bucket_max, n_buckets FROM nb""")
def calibrate_rates(spark, sf):
    """A28 is part of this row: the spread over fixed buckets, empty ones included."""
    return rounded(E.calibrate_rates(staging.events(spark, sf), 3600.0), _CALDIG)


@query("A28_bucket_rates_orders", """WITH ev AS (SELECT epoch_us(o_orderdate) / 1e6 AS ts, CAST(o_custkey % 50 AS VARCHAR) AS host FROM orders), s AS (SELECT min(ts) AS t0, max(ts) - min(ts) AS span_s FROM ev), nb AS (SELECT *, CAST(floor(span_s / 86400) AS BIGINT) AS n_buckets FROM s),
b AS (SELECT least(CAST(floor((ts - t0) / 86400) AS BIGINT), n_buckets - 1) AS i, count(*) AS c FROM ev, nb GROUP BY 1), f AS (SELECT k AS i, coalesce(c, 0) AS c FROM (SELECT unnest(generate_series(0, (SELECT n_buckets - 1 FROM nb))) AS k) LEFT JOIN b ON b.i = k)
SELECT round(avg(c) / 86400 / 50, 12) AS bucket_mean, round(median(c) / 86400 / 50, 12) AS bucket_p50, round(quantile_cont(c, 0.95) / 86400 / 50, 12) AS bucket_p95, round(max(c) / 86400 / 50, 12) AS bucket_max, (SELECT n_buckets FROM nb) AS n_buckets FROM f""")
def bucket_rates_orders(spark, sf):
    o = staging.table(spark, sf, "orders")
    ev = o.select(C.to_unix(o, "o_orderdate").alias("ts"), (F.col("o_custkey") % 50).cast("string").alias("host"))
    out = E.calibrate_rates(ev, 86400.0).select("bucket_mean", "bucket_p50", "bucket_p95", "bucket_max", "n_buckets")
    return rounded(out, {c: 12 for c in out.columns if c != "n_buckets"})


_EID = "e AS (SELECT eid, count(*) AS count, count(*) / (SELECT max(ts) - min(ts) FROM ev) / (SELECT count(DISTINCT host) FROM ev) AS r, count(*) / (SELECT count(*) FROM ev) AS share FROM ev GROUP BY 1)"


@query("A27_event_id_rates", f"WITH {EV}, {_EID} SELECT eid, count, round(r, 12) AS events_per_sec_per_host, round(share, 9) AS share FROM e")
def event_id_rates(spark, sf):
    return rounded(E.eid_rates(staging.events(spark, sf)), {"events_per_sec_per_host": 12, "share": 9})


@query("T5_top_share", f"WITH {EV}, {_EID} SELECT eid, count, round(share, 9) AS share FROM e ORDER BY share DESC, eid LIMIT 3")
def top_share(spark, sf):
    return rounded(E.top_share(E.eid_rates(staging.events(spark, sf)), 3).select("eid", "count", "share"), {"share": 9})


@query("A29_suggest_deployments", f"""WITH {EV}, {_CAL}, r AS (SELECT n_events / span_s / n_hosts AS o, (SELECT quantile_cont(c, 0.95) FROM f) / 3600 / n_hosts AS p FROM nb)
SELECT name, CAST(h AS INTEGER) AS hosts, round(o, 4) AS events_per_sec_per_host, 'calibrated_overall_mean' AS source FROM r, (VALUES ('calibrated_small_office_20h', 20), ('calibrated_large_business_400h', 400)) v(name, h)
UNION ALL SELECT 'calibrated_burst_p95_400h', 400, round(p, 4), 'calibrated_minute_bucket_p95' FROM r WHERE p > 0""")
def suggest_deployments(spark, sf):
    return E.suggest_deployments(E.calibrate_rates(staging.events(spark, sf), 3600.0), [20, 400])


@query("A10_fp_by_dominant_event", f"""WITH {WSCORED}, {_MIX} SELECT dominant_eid, count(*) AS n_windows, count(*) FILTER (WHERE score >= {WTAU}) AS n_flagged, round(count(*) FILTER (WHERE score >= {WTAU}) / count(*), 9) AS fp_rate, round(avg(share_dominant), 9) AS mean_share_dominant
FROM mix JOIN ws USING (campaign_id, window_id) GROUP BY 1""")
def fp_by_dominant_event(spark, sf):
    mix = W.window_eid_mix(members(spark, sf))
    return rounded(E.fp_by_dominant_eid(mix, scored_windows(spark, sf), WTAU), {"fp_rate": 9, "mean_share_dominant": 9})


@query("D5_check_manifest", f"""WITH {WSCORED}, m AS (SELECT campaign_id, CASE CAST(campaign_id AS BIGINT) % 7 WHEN 3 THEN 'odd' ELSE class END AS class, CASE WHEN CAST(campaign_id AS BIGINT) % 11 = 1 THEN '' ELSE benign_subtype END AS benign_subtype,
  CASE WHEN CAST(campaign_id AS BIGINT) % 2 = 0 THEN '' ELSE framework END AS framework, CASE WHEN CAST(campaign_id AS BIGINT) % 3 = 0 THEN 'tool' ELSE framework END AS generator FROM man)
SELECT campaign_id, CASE WHEN framework <> '' THEN framework WHEN generator IN ('caldera', 'atomic', 'scripted', 'manual') THEN generator ELSE 'manual' END AS framework,
  CASE WHEN class = 'odd' THEN 'unknown class' WHEN class = 'hard_negative' AND benign_subtype = '' THEN 'hard_negative without benign_subtype' END AS violation FROM m""")
def check_manifest(spark, sf):
    from alertloom.operators.governance import check_manifest as op

    n = F.col("campaign_id").cast("long")
    m = staging.manifest(spark, sf)
    m = m.withColumns({
        "class": F.when(n % 7 == 3, "odd").otherwise(F.col("class")), "benign_subtype": F.when(n % 11 == 1, "").otherwise(F.col("benign_subtype")),
        "generator": F.when(n % 3 == 0, "tool").otherwise(F.col("framework")), "framework": F.when(n % 2 == 0, "").otherwise(F.col("framework")),
    })
    return op(m).select("campaign_id", "framework", "violation")


@query("P31_config_hash", f"WITH {EV} SELECT event_id, substr(sha256('{{\"action\":\"' || action || '\",\"depth\":' || depth || ',\"host\":\"' || host || '\"}}'), 1, 8) AS config_sha FROM ev")
def config_hash(spark, sf):
    e = staging.events(spark, sf)
    return e.select("event_id", C.config_sha({"host": F.col("host"), "depth": F.col("depth"), "action": F.col("action")}).alias("config_sha"))


@query("P10_one_campaign", f"WITH {EV} SELECT event_id AS event_key, 'operation-7' AS campaign_id, CAST(event_id % 4 = 0 AS INTEGER) AS label FROM ev")
def one_campaign(spark, sf):
    w = cut_lineage(winlog(spark, sf))
    guids = w.filter(F.col("event_key") % 4 == 0).select(F.col("ProcessGuid").alias("guid"))
    return N.normalize_campaign(w, "operation-7", guids).select("event_key", "campaign_id", "label")


@query("P13_safe_log1p", f"WITH {EV} SELECT event_id, round(CASE WHEN event_id % 3 = 0 OR event_id % 3 = 1 AND depth < 2 THEN 0 ELSE ln(1 + artifact_ai) END, 9) AS log_value FROM ev")
def safe_log1p(spark, sf):
    n = F.col("event_id") % 3
    v = F.when(n == 0, F.lit(float("nan"))).when((n == 1) & (F.col("depth") == 0), -F.col("artifact_ai")).when((n == 1) & (F.col("depth") == 1), None).otherwise(F.col("artifact_ai"))
    return staging.events(spark, sf).select("event_id", F.round(C.safe_log1p(v), 9).alias("log_value"))


@query("P15_hex_scale", f"WITH {EV} SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 0.0 ELSE CAST('0x' || substr(sha256(action), 1, 8) AS BIGINT) / 4294967296.0 END::DOUBLE AS scaled FROM ev")
def hex_scale(spark, sf):
    digest = F.substring(F.sha2("action", 256), 1, 8)
    text = F.when(F.col("event_id") % 10 == 0, "xyz").when(F.col("event_id") % 5 == 0, "").otherwise(digest)
    return staging.events(spark, sf).select("event_id", C.hex_norm(text).alias("scaled"))


@query("J9_rates_by_deployment", f"WITH {WSCORED}, {_TOTAL} SELECT name, deployment, round(fp * windows_per_hour, 6) AS fp_per_hour FROM rates, dep")
def rates_by_deployment(spark, sf):
    from alertloom.operators.thresholds import deployment_rows

    rates = E.fp_rates(scored_windows(spark, sf), WTAU).select("name", "fp_rate")
    shapes = spark.createDataFrame(fixed.DEPLOYMENTS, "name string, hosts int, events_per_sec_per_host double")
    spread = deployment_rows(rates, shapes)
    return spread.select("name", "deployment", F.round(F.col("fp_rate") * F.col("windows_per_hour"), 6).alias("fp_per_hour"))


@query("S10_deployment_file", f"""WITH {EV}, {_CAL}, r AS (SELECT n_events / span_s / n_hosts AS o, (SELECT quantile_cont(c, 0.95) FROM f) / 3600 / n_hosts AS p FROM nb)
SELECT name, CAST(h AS INTEGER) AS hosts, round(o, 4) AS events_per_sec_per_host FROM r, (VALUES ('calibrated_small_office_20h', 20), ('calibrated_large_business_400h', 400)) v(name, h)
UNION ALL SELECT 'calibrated_burst_p95_400h', 400, round(p, 4) FROM r WHERE p > 0""")
def deployment_file(spark, sf):
    """The shapes suggested from the events, written as a file and read back."""
    path = fresh_folder(spark)
    shapes = E.suggest_deployments(E.calibrate_rates(staging.events(spark, sf), 3600.0), [20, 400])
    body = F.concat(F.lit('{"deployments":'), F.to_json(F.collect_list(F.struct("name", "hosts", "events_per_sec_per_host"))), F.lit("}"))
    shapes.agg(body.alias("value")).write.text(path)
    return logs.read_deployments(spark, path)
