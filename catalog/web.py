"""Web sessions."""

from pyspark.sql import functions as F

from alertloom import fixed
from alertloom.functions import columns as C
from alertloom.operators import web as B
from alertloom.plans import staging
from alertloom.session import cut_lineage
from alertloom.sources import logs
from catalog.registry import EV, list_sql, query
from catalog.windows import rounded

GAP = 43200

RQ = EV + f""",
rq AS (SELECT event_id AS line_id, floor(ts)::DOUBLE AS ts, '10.0.' || CAST(campaign_id AS BIGINT) % 7 || '.' || CAST(campaign_id AS BIGINT) % 250 AS src_ip,
  CASE WHEN action = 'purchase' THEN 'POST' ELSE 'GET' END AS method, '/' || action || '/' || CAST(target AS INTEGER) % 10 AS path,
  CASE WHEN CAST(target AS INTEGER) % 3 = 0 THEN 'q=' || target ELSE '' END AS qs, CASE WHEN CAST(target AS INTEGER) >= 90 THEN 500 WHEN CAST(target AS INTEGER) >= 75 THEN 404 ELSE 200 END AS status,
  CAST(target AS BIGINT) * 37 AS resp_bytes, {list_sql(staging.USER_AGENTS)}[CAST(campaign_id AS BIGINT) % 7 + 1] AS ua,
  CASE WHEN CAST(target AS INTEGER) % 2 = 0 THEN 'http://ref.example/' || target ELSE '-' END AS referer FROM ev)"""

ST = RQ + f""",
g AS (SELECT *, substr(sha1(ua), 1, 8) AS uah, lag(ts) OVER (PARTITION BY src_ip, substr(sha1(ua), 1, 8) ORDER BY ts, line_id) AS prev FROM rq),
n AS (SELECT *, prev IS NULL OR ts - prev > {GAP} AS is_new_session FROM g),
i AS (SELECT *, sum(CAST(is_new_session AS INTEGER)) OVER (PARTITION BY src_ip, uah ORDER BY ts, line_id ROWS UNBOUNDED PRECEDING) AS no FROM n),
st AS (SELECT * EXCLUDE (no, prev), CASE WHEN NOT is_new_session THEN CAST(floor(greatest(0, ts - prev) * 1000) AS BIGINT) END AS delta_ms,
       substr(sha1(src_ip || '|' || uah || '|' || CAST(min(ts) OVER (PARTITION BY src_ip, uah, no) AS BIGINT)), 1, 24) AS session_id FROM i)"""

_QS = "CASE WHEN qs = '' THEN 0 ELSE length(qs) END AS qs_len"


def stitched(spark, sf):
    r = staging.requests(spark, sf).withColumn("qs_len", F.length("qs").cast("long"))
    return B.stitch_sessions(r, GAP)


@query("S4_access_log", f"WITH {RQ} SELECT line_id, ts, src_ip, method, path, CAST({_QS.split(' AS ')[0]} AS BIGINT) AS qs_len, CAST(status AS INTEGER) AS status, resp_bytes, ua, referer FROM rq WHERE line_id % 97 <> 0")
def access_log(spark, sf):
    """The text is written first, as a log on disk would be."""
    return logs.parse_access_log(cut_lineage(staging.access_lines(spark, sf)))


@query("W3_stitch_sessions", f"WITH {ST} SELECT line_id, session_id, is_new_session, delta_ms FROM st")
def stitch(spark, sf):
    return stitched(spark, sf).select("line_id", "session_id", "is_new_session", "delta_ms")


@query("P20_request_rows", f"""WITH {ST} SELECT line_id, ts, session_id, src_ip, 'prod_traffic' AS src_label, method, path, CAST(length(qs) AS BIGINT) AS qs_len, CAST(status AS INTEGER) AS status, CAST(0 AS BIGINT) AS req_bytes,
  resp_bytes, substr(ua, 1, 300) AS ua, substr(sha1(uah || '|' || substr(referer, 1, 80)), 1, 8) AS header_hash, CAST(0 AS INTEGER) AS header_count, delta_ms, is_new_session, false AS has_auth_header, false AS has_cookie_header,
  '' AS content_type, CAST(0 AS INTEGER) AS elapsed_ms, 'unknown' AS class, 'prod_traffic' AS family, 'prod' AS target_app, 'na' AS security_level, false AS stealth FROM st""")
def request_rows(spark, sf):
    return B.to_request_rows(stitched(spark, sf))


RR = ST + """,
rr AS (SELECT line_id, ts, session_id, src_ip, ['sqlmap', 'googlebot', 'human_real', '', 'other'][k % 5 + 1] AS src_label, method,
  CASE k % 20 WHEN 0 THEN '/__canary' WHEN 1 THEN '/robots.txt' WHEN 2 THEN '/__admin_secrets/x' ELSE path END AS path, qs, CAST(status AS INTEGER) AS status, CAST(0 AS BIGINT) AS req_bytes, resp_bytes, ua, referer,
  substr(sha1(uah || '|' || substr(referer, 1, 80)), 1, 8) AS header_hash, k AS header_count, delta_ms,
  ['', 'agent', 'human'][k % 3 + 1] AS class, 'fam' || k % 4 AS family, CASE WHEN k % 5 = 0 THEN '' ELSE 'app' || k % 2 END AS target_app, k % 2 = 0 AS stealth,
  CASE WHEN method = 'POST' THEN 'application/x-www-form-urlencoded' ELSE '' END AS content_type, CASE WHEN k % 4 = 0 THEN 'a=1&email_verify=x' || k ELSE 'email_verify=&b=2' END AS body, k
  FROM (SELECT *, CAST(resp_bytes // 37 AS INTEGER) AS k FROM st)),
bc AS (SELECT session_id, ts, line_id, CASE WHEN k % 12 = 0 THEN 'ready' ELSE 'loaded' END AS kind, k * 10.0 AS t, k * 1.5 AS ttfi FROM rr WHERE k % 6 = 0),
tr AS (SELECT line_id, ts, session_id, src_label, 'invisible_field' AS honeypot FROM rr WHERE method = 'POST' AND k % 4 = 0
  UNION ALL SELECT line_id, ts, session_id, src_label, CASE k % 20 WHEN 0 THEN 'canary' WHEN 1 THEN 'robots_read' ELSE 'admin_secrets' END FROM rr WHERE k % 20 < 3),
mt AS (SELECT DISTINCT session_id FROM rr WHERE substr(session_id, 1, 1) < '6')"""


def inputs(spark, sf):
    """Request rows with labels, beacons, trap hits and provenance rows. Written once, as
    a stored log would be, because several branches read them."""
    s = stitched(spark, sf)
    k = F.col("k")
    at = lambda values, i: F.element_at(F.array(*[F.lit(v) for v in values]), (i + 1).cast("int"))
    path = F.when(k % 20 == 0, "/__canary").when(k % 20 == 1, "/robots.txt").when(k % 20 == 2, "/__admin_secrets/x").otherwise(F.col("path"))
    req = cut_lineage(
        B.to_request_rows(s, keep=["qs", "referer"])
        .withColumn("k", (F.col("resp_bytes") / 37).cast("int"))
        .withColumns({
            "src_label": at(["sqlmap", "googlebot", "human_real", "", "other"], k % 5), "class": at(["", "agent", "human"], k % 3),
            "family": F.concat(F.lit("fam"), k % 4), "target_app": F.when(k % 5 == 0, "").otherwise(F.concat(F.lit("app"), k % 2)),
            "stealth": k % 2 == 0, "path": path, "header_count": k,
            "content_type": F.when(F.col("method") == "POST", "application/x-www-form-urlencoded").otherwise(""),
            "body": F.when(k % 4 == 0, F.concat(F.lit("a=1&email_verify=x"), k)).otherwise("email_verify=&b=2"),
        })
    )
    event = F.struct(
        F.when(k % 12 == 0, "ready").otherwise("loaded").alias("type"), (k * 10.0).alias("t"), (k * 1.5).alias("ttfi_candidate")
    )
    beacons = req.filter(k % 6 == 0).select("session_id", "ts", "line_id", event.alias("event"))
    meta = req.filter(F.substring("session_id", 1, 1) < "6").groupBy("session_id").agg(F.min("ts").alias("ts"), F.min("line_id").alias("line_id")).select(
        "session_id", "ts", "line_id", F.lit("benign_bot").alias("class"), F.lit("").alias("family"), F.lit("meta_app").alias("target_app"), F.lit(True).alias("stealth")
    )
    return req, beacons, B.honeypot_trips(req), meta


_LOG = lambda x: f"ln(1 + greatest(0, coalesce({x}, 0)))"
_UA = "CASE WHEN ua = '' THEN 0.0 WHEN contains(ua, 'Chrome') OR contains(ua, 'Chromium') THEN 1.0 WHEN contains(ua, 'Mozilla') THEN 0.6 WHEN contains(ua, 'curl') OR contains(lower(ua), 'python') OR contains(ua, 'wget') THEN 0.3 ELSE 0.1 END::DOUBLE"
_F9 = {c: 9 for c in ["log_delta", "log_req_bytes", "log_resp_bytes", "log_header_count", "header_hash_scaled"]}
FEAT = f"""ft AS (SELECT session_id, ts, line_id, {_LOG('delta_ms')} AS log_delta, status / 100.0::DOUBLE AS status_scaled, CAST(method = 'POST' AS INTEGER)::DOUBLE AS is_post,
  (CAST('0x' || substr(sha256(path), 57, 8) AS BIGINT) % 16) / 16.0::DOUBLE AS path_bucket, {_LOG('req_bytes')} AS log_req_bytes, {_LOG('resp_bytes')} AS log_resp_bytes, {_UA} AS ua_score,
  {_LOG('header_count')} AS log_header_count, CAST('0x' || header_hash AS BIGINT) / 4294967296.0::DOUBLE AS header_hash_scaled FROM rr)"""


@query("P12_request_features", f"WITH {RR}, {FEAT} SELECT * REPLACE ({', '.join(f'round({c}, 9) AS {c}' for c in _F9)}) FROM ft")
def request_features(spark, sf):
    return rounded(B.request_features(inputs(spark, sf)[0]), _F9)


@query("M9_request_transitions", f"""WITH {RR}, {FEAT}, kd AS (SELECT session_id, is_post::INT || '|' || floor(status_scaled)::INT || '|' || round(path_bucket * 16)::INT AS kind, ts, line_id FROM ft),
tn AS (SELECT session_id, lag(kind) OVER (PARTITION BY session_id ORDER BY ts, line_id) || '>' || kind AS pair FROM kd),
sl AS (SELECT session_id, CAST(CAST('0x' || substr(sha256(pair), 57, 8) AS BIGINT) % {B.TRANSITION_SLOTS} AS INTEGER) AS slot, count(*) AS n FROM tn WHERE pair IS NOT NULL GROUP BY ALL)
SELECT session_id, slot, n, n / sum(n) OVER (PARTITION BY session_id) AS share FROM sl""")
def request_transitions(spark, sf):
    """The sparse order features of a session beside the shares that the scorer reads."""
    features = B.request_features(inputs(spark, sf)[0])
    wide = B.transition_features(features)
    share = F.element_at(F.array(*B.TRANSITIONS), F.col("slot") + 1).alias("share")
    return B.transitions(features).join(wide, "session_id").select("session_id", "slot", "n", share)


@query("P14_path_bucket_exact")
def path_bucket_exact(spark, sf):
    """Rows-only: DuckDB has no blake2b."""
    return inputs(spark, sf)[0].select("path").distinct().select("path", C.path_bucket(F.col("path"), exact=True).alias("bucket"))


@query("P17_ua_buckets", f"""WITH {RQ} SELECT line_id, {_UA} AS score, CASE WHEN regexp_matches(ua, '(?i)\\bFirefox/') THEN 'firefox-' || d WHEN regexp_matches(ua, '(?i)\\b(Chrome|Chromium|Edg|OPR|Brave|CriOS)/') THEN 'chrome-' || d
  WHEN regexp_matches(ua, '(?i)\\bSafari/') THEN 'safari-' || d ELSE 'other' END AS bucket
FROM (SELECT *, CASE WHEN regexp_matches(ua, '(?i)\\b(iPhone|iPad|iPod|Android|Mobile|Mobi)\\b') THEN 'mobile' ELSE 'desktop' END AS d FROM rq)""")
def ua_buckets(spark, sf):
    r = staging.requests(spark, sf)
    return r.select("line_id", C.ua_score(F.col("ua")).alias("score"), C.ua_bucket(F.col("ua")).alias("bucket"))


@query("P18_redact", f"""WITH {RR} SELECT line_id, CASE WHEN family <> 'fam2' THEN src_ip END AS src_ip,
 CASE WHEN family <> 'fam2' THEN ua WHEN contains(ua, 'Firefox/') THEN 'firefox-desktop' WHEN contains(ua, 'Chrome/') THEN 'chrome-desktop' WHEN contains(ua, 'Safari/') THEN 'safari-mobile' ELSE 'other' END AS ua FROM rr""")
def redact(spark, sf):
    return B.redact(inputs(spark, sf)[0], "fam2").select("line_id", "src_ip", "ua")


@query("P19_header_set_hash", f"WITH {RQ} SELECT line_id, substr(sha1(CASE WHEN line_id % 2 = 0 THEN 'accept,host,user-agent' ELSE 'cookie,host' END), 1, 8) AS header_hash FROM rq")
def header_hash(spark, sf):
    one = F.create_map(F.lit("User-Agent"), "ua", F.lit("Host"), F.lit("h"), F.lit("ACCEPT"), F.lit("*"))
    two = F.create_map(F.lit("Host"), F.lit("h"), F.lit("Cookie"), F.lit("c"))
    r = staging.requests(spark, sf)
    return r.select("line_id", C.header_set_hash(F.when(F.col("line_id") % 2 == 0, one).otherwise(two)).alias("header_hash"))


@query("P21_source_classes", f"""WITH {RR} SELECT line_id, CASE src_label WHEN 'sqlmap' THEN 'agent' WHEN 'googlebot' THEN 'benign_bot' WHEN 'human_real' THEN 'human' ELSE 'unknown' END AS class FROM rr""")
def source_classes(spark, sf):
    return inputs(spark, sf)[0].select("line_id", C.class_of(F.col("src_label")).alias("class"))


@query("P22_label_schema", f"""WITH {RR} SELECT line_id, CASE WHEN k % 3 = 0 THEN 'agent' WHEN src_label = 'sqlmap' THEN 'agent' WHEN src_label = 'googlebot' THEN 'benign_bot' WHEN src_label = 'human_real' THEN 'human' ELSE 'unknown' END AS class,
  CASE WHEN k % 3 = 0 THEN 'tagged' ELSE src_label END AS family, 'dvwa' AS target_app, 'na' AS security_level, k % 3 = 0 AS stealth FROM rr""")
def label_schema(spark, sf):
    tags = F.create_map(F.lit("x-label-class"), F.lit("agent"), F.lit("x-label-family"), F.lit("tagged"), F.lit("x-label-stealth"), F.lit("True"))
    empty = F.create_map().cast("map<string,string>")
    req = inputs(spark, sf)[0].withColumn("tags", F.when(F.col("k") % 3 == 0, tags).otherwise(empty))
    return B.label_schema(req).select("line_id", "class", "family", "target_app", "security_level", "stealth")


@query("W4_inherit_labels", f"""WITH {RR}, x AS (SELECT *, k % 7 = 0 AS explicit, CASE WHEN src_label NOT IN ('', 'unknown') AND k % 7 = 0 THEN src_label END AS own, 'na' AS security_level FROM rr),
y AS (SELECT *, last_value(own IGNORE NULLS) OVER w AS latest, min(CASE WHEN explicit THEN ts * 1e7 + line_id END) OVER (PARTITION BY session_id) AS fat FROM x WINDOW w AS (PARTITION BY session_id ORDER BY ts, line_id ROWS UNBOUNDED PRECEDING)),
f AS (SELECT session_id, arg_min(struct_pack(c := class, f := family, t := target_app, s := stealth), ts * 1e7 + line_id) AS f FROM x WHERE explicit GROUP BY 1)
SELECT line_id, CASE WHEN src_label IN ('', 'unknown') THEN coalesce(latest, src_label) ELSE src_label END AS src_label,
  CASE WHEN NOT explicit AND fat < ts * 1e7 + line_id THEN f.f.c ELSE class END AS class, CASE WHEN NOT explicit AND fat < ts * 1e7 + line_id THEN f.f.f ELSE family END AS family,
  CASE WHEN NOT explicit AND fat < ts * 1e7 + line_id THEN f.f.t ELSE target_app END AS target_app, CASE WHEN NOT explicit AND fat < ts * 1e7 + line_id THEN f.f.s ELSE stealth END AS stealth
FROM y LEFT JOIN f USING (session_id)""")
def inherit_labels(spark, sf):
    req = inputs(spark, sf)[0].withColumn("explicit", F.col("k") % 7 == 0).withColumn("security_level", F.lit("na"))
    return B.inherit_labels(req).select("line_id", "src_label", "class", "family", "target_app", "stealth")


@query("P23_honeypot_trips", f"WITH {RR} SELECT * FROM tr")
def honeypot_trips(spark, sf):
    return inputs(spark, sf)[2].select("line_id", "ts", "session_id", "src_label", "honeypot")


@query("A3_max_rps", f"""WITH {RR}, w AS (SELECT session_id, count(*) OVER (PARTITION BY session_id ORDER BY ts RANGE BETWEEN CURRENT ROW AND 7200 FOLLOWING) AS c FROM rr)
SELECT session_id, max(c) AS max_rps FROM w GROUP BY 1""")
def max_rps(spark, sf):
    return B.max_rps(inputs(spark, sf)[0], 7200.0)


_BS = """bs AS (SELECT session_id, 1.0::DOUBLE AS js_ran, coalesce(arg_min(ttfi, ts * 1e7 + line_id) FILTER (WHERE kind = 'loaded'), 0)::DOUBLE AS ttfi,
  coalesce(greatest(0, arg_min(t, ts * 1e7 + line_id) FILTER (WHERE kind = 'loaded') - arg_min(t, ts * 1e7 + line_id) FILTER (WHERE kind = 'ready')), 0)::DOUBLE AS d,
  bool_or(kind = 'loaded') AND bool_or(kind = 'ready') AS pair FROM bc GROUP BY 1),
bsum AS (SELECT session_id, js_ran, ttfi, CASE WHEN pair THEN d ELSE 0 END AS dom_read FROM bs)"""


@query("A4_beacon_summary", f"WITH {RR}, {_BS} SELECT * FROM bsum")
def beacon_summary(spark, sf):
    return B.beacon_summary(inputs(spark, sf)[1])


_HP = "hp AS (SELECT session_id, " + ", ".join(f"max(CAST(honeypot = '{t}' AS INTEGER))::DOUBLE AS {t}" for t in fixed.HONEYPOTS) + " FROM tr GROUP BY 1)"


@query("A5_honeypot_flags", f"WITH {RR}, {_HP} SELECT * FROM hp")
def honeypot_flags(spark, sf):
    return B.honeypot_flags(inputs(spark, sf)[2])


@query("A7_min_requests", f"WITH {RR} SELECT session_id, count(*) AS n_req FROM rr GROUP BY 1 HAVING count(*) >= 3")
def min_requests(spark, sf):
    return B.min_requests(inputs(spark, sf)[0])


_AGG = f"""mr AS (SELECT session_id, max(c) AS max_rps FROM (SELECT session_id, count(*) OVER (PARTITION BY session_id ORDER BY ts RANGE BETWEEN CURRENT ROW AND 1 FOLLOWING) AS c FROM rr) GROUP BY 1),
ag AS (SELECT session_id, count(*) AS n_req, min(ts) AS ts_start, max(ts) - min(ts) AS duration_s, avg(delta_ms) AS m, stddev_pop(delta_ms) AS s, quantile_cont(delta_ms, 0.95) AS p, count(DISTINCT path) AS np,
  count(*) FILTER (WHERE status >= 400 AND status < 500) / count(*) AS frac_4xx, count(*) FILTER (WHERE status >= 500) / count(*) AS frac_5xx FROM rr GROUP BY 1 HAVING count(*) >= 3),
agg AS (SELECT session_id, n_req, ts_start, duration_s, {_LOG('n_req')} AS log_n, {_LOG('m')} AS log_delta_mean, {_LOG('s')} AS log_delta_std, {_LOG('p')} AS log_delta_p95, {_LOG('np')} AS log_paths,
  frac_4xx, frac_5xx, max_rps::DOUBLE AS max_rps, coalesce(js_ran, 0) AS js_ran, {_LOG('ttfi')} AS log_ttfi, {_LOG('dom_read')} AS log_dom_read, {_LOG('duration_s * 1000')} AS log_duration_ms
  FROM ag JOIN mr USING (session_id) LEFT JOIN bsum USING (session_id))"""
_L9 = {c: 9 for c in B.SESSION_FEATURES if c.startswith(("log", "frac"))}
_R9 = ", ".join(f"round({c}, 9) AS {c}" for c in _L9)


@query("A2_session_aggregates", f"WITH {RR}, {_BS}, {_AGG} SELECT * REPLACE ({_R9}) FROM agg")
def session_aggregates(spark, sf):
    req, beacons, _, _ = inputs(spark, sf)
    return rounded(B.session_aggregates(req, beacons), _L9)


_MAJ = lambda c: f"{c}m AS (SELECT session_id, {c} AS major_{c} FROM (SELECT session_id, {c}, row_number() OVER (PARTITION BY session_id ORDER BY count(*) DESC, min(ts * 1e7 + line_id)) AS r FROM rr WHERE {c} <> '' GROUP BY session_id, {c}) WHERE r = 1)"
_LAB = f"""{_MAJ('class')}, {_MAJ('family')}, {_MAJ('target_app')},
sl AS (SELECT session_id, arg_max(src_label, ts * 1e7 + line_id) FILTER (WHERE src_label <> '') AS src, count(*) FILTER (WHERE stealth) * 2 > count(*) AS vote FROM rr GROUP BY 1),
tl AS (SELECT session_id, arg_min(src_label, ts * 1e7 + line_id) AS tsrc FROM tr GROUP BY 1),
lb AS (SELECT sl.session_id, coalesce(src, tsrc, 'unknown') AS src_label, coalesce(CASE WHEN mt.session_id IS NOT NULL THEN 'benign_bot' END, major_class,
   CASE coalesce(src, tsrc, 'unknown') WHEN 'sqlmap' THEN 'agent' WHEN 'googlebot' THEN 'benign_bot' WHEN 'human_real' THEN 'human' ELSE 'unknown' END) AS klass,
   coalesce(major_family, src, tsrc, 'unknown') AS family, coalesce(CASE WHEN mt.session_id IS NOT NULL THEN 'meta_app' END, major_target_app, 'dvwa') AS target_app,
   coalesce(CASE WHEN mt.session_id IS NOT NULL THEN true END, vote) AS stealth
   FROM sl LEFT JOIN tl USING (session_id) LEFT JOIN classm USING (session_id) LEFT JOIN familym USING (session_id) LEFT JOIN target_appm USING (session_id) LEFT JOIN mt USING (session_id)),
lab AS (SELECT *, CAST(klass = 'agent' AS INTEGER) AS y FROM lb)"""


@query("A6_session_labels", f"WITH {RR}, {_LAB} SELECT * FROM lab")
def session_labels(spark, sf):
    req, _, trips, meta = inputs(spark, sf)
    return B.resolve_session_labels(req, meta, trips)


SESS = f"{RR}, {_BS}, {_AGG}, {_LAB}, {_HP}, ss AS (SELECT agg.*, lab.* EXCLUDE (session_id), " + ", ".join(f"coalesce({t}, 0) AS {t}" for t in fixed.HONEYPOTS) + \
    " FROM agg JOIN lab USING (session_id) LEFT JOIN hp USING (session_id))"


def sessions(spark, sf):
    req, beacons, trips, meta = inputs(spark, sf)
    return B.join_sessions(req, beacons, trips, meta)


@query("J1_join_sessions", f"WITH {SESS} SELECT * REPLACE ({_R9}) FROM ss")
def join_sessions(spark, sf):
    return rounded(sessions(spark, sf), _L9)


@query("P25_train_features", f"WITH {SESS} SELECT session_id, target_app, [round(x, 9) FOR x IN [{', '.join(B.SESSION_FEATURES)}]] AS agg, [{', '.join(fixed.HONEYPOTS)}] AS hp, y, family, klass, stealth FROM ss")
def train_features(spark, sf):
    out = B.train_features(cut_lineage(sessions(spark, sf)))
    return out.withColumn("agg", F.transform("agg", lambda x: F.round(x, 9)))


@query("P25_truth", f"WITH {SESS} SELECT session_id, y, family, klass, stealth, target_app, duration_s, src_label FROM ss")
def truth(spark, sf):
    return B.truth(sessions(spark, sf))


@query("A20_honeypot_precision", f"""WITH {SESS}, l AS (SELECT y, unnest([{{honeypot: 'any', hit: greatest({', '.join(fixed.HONEYPOTS)}) > 0}}, {', '.join(f"{{honeypot: '{t}', hit: {t} > 0}}" for t in fixed.HONEYPOTS)}], recursive := true) FROM ss)
SELECT honeypot, count(*) FILTER (WHERE hit) AS tripped, round(count(*) FILTER (WHERE hit AND y = 1) / nullif(count(*) FILTER (WHERE hit), 0), 9) AS precision FROM l GROUP BY 1""")
def honeypot_precision(spark, sf):
    from alertloom.operators.slices import honeypot_precision as op

    return rounded(op(sessions(spark, sf)), {"precision": 9})


@query("A20_trip_rates", f"""WITH {SESS}, l AS (SELECT src_label, unnest([{', '.join(f"{{honeypot: '{t}', hit: {t} > 0}}" for t in fixed.HONEYPOTS)}], recursive := true) FROM ss)
SELECT src_label, honeypot, count(*) FILTER (WHERE hit) AS hits, count(*) AS sessions, round(count(*) FILTER (WHERE hit) / count(*), 4) AS rate FROM l GROUP BY ALL""")
def trip_rates(spark, sf):
    from alertloom.operators.slices import trip_rates as op

    return op(sessions(spark, sf))


@query("M12_honeypot_rule", f"WITH {SESS} SELECT session_id, CASE WHEN greatest({', '.join(fixed.HONEYPOTS)}) > 0 THEN 0.95 ELSE 0.05 END::DOUBLE AS agent_score FROM ss")
def honeypot_rule(spark, sf):
    return B.honeypot_rule(sessions(spark, sf))


@query("M13_ua_rule", f"""WITH {RR}, {FEAT}, m AS (SELECT session_id, ua_score AS b, row_number() OVER (PARTITION BY session_id ORDER BY count(*) DESC, min(ts * 1e7 + line_id)) AS r FROM ft GROUP BY session_id, ua_score)
SELECT session_id, CASE WHEN b <= 0.2 THEN 0.05 WHEN b <= 0.4 THEN 0.9 WHEN b <= 0.8 THEN 0.2 ELSE 0.1 END::DOUBLE AS agent_score FROM m WHERE r = 1""")
def ua_rule(spark, sf):
    return B.ua_rule(B.request_features(inputs(spark, sf)[0]))


@query("M14_timing_rule", f"WITH {RR}, {FEAT} SELECT session_id, round(1 / (1 + exp((median(log_delta) - ln(501)) / 1.5)), 9) AS agent_score FROM ft GROUP BY 1")
def timing_rule(spark, sf):
    return rounded(B.timing_rule(B.request_features(inputs(spark, sf)[0])), {"agent_score": 9})


@query("A35_class_cadence", f"""WITH {RR}, p AS (SELECT session_id, CAST(floor(coalesce(median(delta_ms), 0)) AS BIGINT) AS gap, arg_min(class, ts * 1e7 + line_id) AS class FROM rr GROUP BY 1),
b AS (SELECT DISTINCT session_id, 1 AS b FROM bc)
SELECT class, count(*) AS sessions, CAST(floor(coalesce(median(gap) FILTER (WHERE gap > 0), 0)) AS BIGINT) AS median_delta_ms, round(count(b) / count(*), 3) AS beacon_present_ratio FROM p LEFT JOIN b USING (session_id) GROUP BY 1""")
def class_cadence(spark, sf):
    req, beacons, _, _ = inputs(spark, sf)
    return B.class_cadence(req, beacons)


_NOW, _WIN = 1705000000.0, 500000.0


@query("A34_request_rate", f"""WITH {RR} SELECT coalesce(nullif(src_label, ''), nullif(family, ''), '?') AS family, coalesce(nullif(target_app, ''), '?') AS target_app, count(*) AS n_requests, max(ts) AS last_ts,
  count(*) FILTER (WHERE status >= 200 AND status < 300) AS status_2xx, count(*) FILTER (WHERE status >= 400 AND status < 500) AS status_4xx, count(*) FILTER (WHERE status >= 500 AND status < 600) AS status_5xx,
  round(count(*) / {_WIN}, 12) AS req_per_s FROM rr WHERE ts >= {_NOW - _WIN} GROUP BY ALL""")
def request_rate(spark, sf):
    return rounded(B.request_rate(inputs(spark, sf)[0], _NOW, _WIN), {"req_per_s": 12})


@query("P27_trailing", f"WITH {RQ} SELECT line_id, ts FROM rq WHERE ts >= {_NOW - _WIN}")
def trailing(spark, sf):
    from alertloom.operators.normalize import trailing as op

    return op(staging.requests(spark, sf), _NOW, _WIN).select("line_id", "ts")


@query("A44_alerts_per_hour", f"""WITH {SESS} SELECT family, round(count(*) FILTER (WHERE max_rps >= 2) / count(*) * 60 / (sum(duration_s) / count(*) / 60), 9) AS alerts_per_hour FROM ss GROUP BY 1 HAVING sum(duration_s) > 0""")
def alerts_per_hour(spark, sf):
    per = sessions(spark, sf).groupBy("family").agg(
        (F.count_if(F.col("max_rps") >= 2) / F.count(F.lit(1))).alias("rate"), (F.sum("duration_s") / F.count(F.lit(1)) / 60).alias("minutes")
    ).filter(F.col("minutes") > 0)
    return rounded(per.select("family", C.alerts_per_hour(F.col("rate"), F.col("minutes")).alias("alerts_per_hour")), {"alerts_per_hour": 9})


@query("S9_release_pair", f"WITH {SESS} SELECT session_id, target_app, y, family, klass, stealth, round(duration_s, 3) AS duration_s, src_label, CAST(1 AS BIGINT) AS n_requests FROM ss")
def release_pair(spark, sf):
    """Features and truth written as JSON lines and read back as sessions."""
    from catalog.host import fresh_folder

    path = fresh_folder(spark)
    table = cut_lineage(sessions(spark, sf))
    empty = F.array().cast("array<array<double>>")
    logs.append(B.public_features(table).withColumn("seq", empty), path + "/features")
    logs.append(B.truth(table), path + "/truth")
    rows, seq = logs.read_release(spark, path + "/features", path + "/truth")
    n = seq.groupBy("session_id").agg(F.count(F.lit(1)).alias("n_requests"))
    out = rows.join(n, "session_id").select("session_id", "target_app", "y", "family", "klass", "stealth", "duration_s", "src_label", "n_requests")
    return rounded(out, {"duration_s": 3})
