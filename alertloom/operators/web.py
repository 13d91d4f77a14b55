"""Web sessions: stitching, label inheritance, request and session features, rule scorers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from alertloom import fixed
from alertloom.functions import columns as C
from alertloom.operators.scans import carry_forward, group_key, previous_in_key, time_cell

REQUEST_FEATURES = [
    "log_delta", "status_scaled", "is_post", "path_bucket", "log_req_bytes", "log_resp_bytes", "ua_score",
    "log_header_count", "header_hash_scaled",
]
SESSION_FEATURES = [
    "log_n", "log_delta_mean", "log_delta_std", "log_delta_p95", "log_paths", "frac_4xx", "frac_5xx", "max_rps",
    "js_ran", "log_ttfi", "log_dom_read", "log_duration_ms",
]


def stitch_sessions(req: DataFrame, gap_s: float = fixed.SESSION_GAP_S, cell_s: float = 60.0) -> DataFrame:
    """Add session_id, is_new_session and delta_ms per (src_ip, user-agent hash); a pause
    longer than `gap_s` starts a new session.

    Events of one time cell (no wider than the gap) belong together, so session starts
    are decided on a table of cells. Rows are ordered only inside their cell.
    req: line_id, ts, src_ip, ua."""
    cell_s = min(float(cell_s), float(gap_s))
    rows = req.withColumn("uah", C.ua_hash(F.col("ua"))).withColumn("__cell", time_cell(F.col("ts"), cell_s))
    rows = rows.withColumn("__g", group_key(["src_ip", "uah"]))
    cells = rows.groupBy("__g", "__cell").agg(F.min("ts").alias("__first"), F.max("ts").alias("__last"))
    order = Window.partitionBy("__g").orderBy("__cell")
    cells = cells.withColumn("__prev", F.lag("__last").over(order)).withColumn(
        "__new", F.col("__prev").isNull() | (F.col("__first") - F.col("__prev") > gap_s)
    )
    start = F.last(F.when(F.col("__new"), F.col("__first")), ignorenulls=True).over(
        order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    cells = cells.withColumn("__start", start).drop("__first", "__last")
    inside = Window.partitionBy("__g", "__cell").orderBy("ts", "line_id")
    local = rows.withColumn("__before", F.lag("ts").over(inside)).join(cells, ["__g", "__cell"])
    is_new = F.col("__before").isNull() & F.col("__new")
    last = F.coalesce("__before", "__prev")
    sid = F.substring(F.sha1(F.concat_ws("|", "src_ip", "uah", F.bround("__start").cast("long").cast("string"))), 1, 24)
    return local.select(
        *req.columns, "uah", sid.alias("session_id"), is_new.alias("is_new_session"),
        F.when(~is_new, F.floor(F.greatest(F.lit(0.0), F.col("ts") - last) * 1000).cast("long")).alias("delta_ms"),
    )


def to_request_rows(
    stitched: DataFrame, family: str = "prod_traffic", klass: str = "unknown", target_app: str = "prod", ua_limit: int = 300,
    keep: Sequence[str] = (),
) -> DataFrame:
    """Stitched access rows in the request schema; fields an access log lacks get constants.
    `keep` names further columns to carry along."""
    header = F.substring(F.sha1(F.concat(C.ua_hash(F.col("ua")), F.lit("|"), F.substring(F.coalesce("referer", F.lit("")), 1, 80))), 1, 8)
    return stitched.select(
        "line_id", "ts", "session_id", "src_ip", F.lit(family).alias("src_label"), "method", "path", "qs_len",
        "status", F.lit(0).cast("long").alias("req_bytes"), "resp_bytes", F.substring("ua", 1, ua_limit).alias("ua"),
        header.alias("header_hash"), F.lit(0).alias("header_count"), "delta_ms", "is_new_session",
        F.lit(False).alias("has_auth_header"), F.lit(False).alias("has_cookie_header"), F.lit("").alias("content_type"),
        F.lit(0).alias("elapsed_ms"), F.lit(klass).alias("class"), F.lit(family).alias("family"),
        F.lit(target_app).alias("target_app"), F.lit("na").alias("security_level"), F.lit(False).alias("stealth"), *keep,
    )


def redact(req: DataFrame, human: str = "human_real") -> DataFrame:
    """Drop the address and coarsen the user agent of the human channel only."""
    person = F.coalesce(F.col("family") == human, F.lit(False))
    return req.withColumn("src_ip", F.when(~person, F.col("src_ip"))).withColumn(
        "ua", F.when(person, C.ua_bucket(F.col("ua"))).otherwise(F.col("ua"))
    )


def label_schema(req: DataFrame, tags: str = "tags", prefix: str = "x-label-", default_app: str = fixed.DEFAULT_TARGET_APP) -> DataFrame:
    """Class, family, target, level and stealth from a map of request tags, with defaults
    from the source label for sources that send none."""
    tag = lambda name: F.col(tags)[F.lit(prefix + name)]
    known = C.class_of(F.col("src_label"))
    legacy_class = F.when(known != "unknown", known)
    return req.withColumns({
        "class": F.coalesce(tag("class"), legacy_class, F.lit("unknown")),
        "family": F.coalesce(tag("family"), F.col("src_label")),
        "target_app": F.coalesce(tag("targetapp"), F.lit(default_app)),
        "security_level": F.coalesce(tag("securitylevel"), F.lit("na")),
        "stealth": F.lower(F.coalesce(tag("stealth"), F.lit(""))).isin("1", "true", "yes"),
    })


SCHEMA_COLUMNS = ["class", "family", "target_app", "security_level", "stealth"]


def inherit_labels(req: DataFrame, explicit: str = "explicit", cell_s: float = 60.0) -> DataFrame:
    """Rows without labels of their own take them from their session: the latest explicit
    source label so far, and the first explicit label schema so far.
    req: session_id, ts, line_id, src_label, explicit, and the schema columns."""
    named = ~F.coalesce("src_label", F.lit("")).isin("", "unknown")
    rows = req.withColumn("__src", F.when(named & F.col(explicit), F.col("src_label")))
    rows = carry_forward(rows, ["session_id"], "ts", ["line_id"], "__src", "__latest", cell_s)
    rows = rows.withColumn("src_label", F.when(named, F.col("src_label")).otherwise(F.coalesce("__latest", "src_label")))
    at = F.struct("ts", "line_id")
    first = rows.filter(F.col(explicit)).groupBy("session_id").agg(
        F.min_by(F.struct(*SCHEMA_COLUMNS), at).alias("__schema"), F.min(at).alias("__at")
    )
    joined = rows.join(first, "session_id", "left")
    take = ~F.col(explicit) & F.col("__at").isNotNull() & (F.col("__at") < at)
    picked = {c: F.when(take, F.col(f"__schema.{c}")).otherwise(F.col(c)) for c in SCHEMA_COLUMNS}
    return joined.withColumns(picked).select(*req.columns)


def request_features(req: DataFrame, exact_path: bool = False) -> DataFrame:
    """The nine per-request features, one row per request, in session order by (ts, line_id)."""
    return req.select(
        "session_id", "ts", "line_id",
        C.safe_log1p(F.col("delta_ms")).alias("log_delta"),
        (F.coalesce("status", F.lit(0)) / F.lit(100.0)).alias("status_scaled"),
        F.when(F.col("method") == "POST", 1.0).otherwise(0.0).alias("is_post"),
        C.path_bucket(F.col("path"), exact=exact_path).alias("path_bucket"),
        C.safe_log1p(F.col("req_bytes")).alias("log_req_bytes"),
        C.safe_log1p(F.col("resp_bytes")).alias("log_resp_bytes"),
        C.ua_score(F.col("ua")).alias("ua_score"),
        C.safe_log1p(F.col("header_count")).alias("log_header_count"),
        C.hex_norm(F.col("header_hash")).alias("header_hash_scaled"),
    )


def max_rps(req: DataFrame, span_s: float = 1.0) -> DataFrame:
    """Most requests in any closed span of `span_s` seconds that starts at a request.

    Requests at the same instant are counted together first. Each count serves the cell
    it lies in and the cell before, so a span never needs more than two cells of rows."""
    at = req.groupBy("session_id", "ts").agg(F.count(F.lit(1)).alias("n"))
    own = time_cell(F.col("ts"), span_s)
    both = at.withColumn("__cell", F.explode(F.array(own, own - 1))).withColumn("__own", F.col("__cell") == own)
    ahead = f"RANGE BETWEEN CURRENT ROW AND {float(span_s)}D FOLLOWING"
    inside = F.expr(f"sum(n) OVER (PARTITION BY session_id, __cell ORDER BY ts {ahead})")
    counts = both.withColumn("__in", inside).filter("__own")
    return counts.groupBy("session_id").agg(F.max("__in").alias("max_rps"))


def beacon_summary(beacons: DataFrame) -> DataFrame:
    """Per session: did a script report, time to first interaction, and time from ready to
    loaded. beacons: session_id, ts, line_id, event{type, t, ttfi_candidate}."""
    at = F.struct("ts", "line_id")
    kind = lambda name: F.col("event.type") == name
    first = lambda value, name: F.min_by(value, F.when(kind(name), at))
    per = beacons.filter(C.blank_to_null(F.col("session_id")).isNotNull()).groupBy("session_id").agg(
        F.lit(1.0).alias("js_ran"),
        F.coalesce(first(F.coalesce("event.ttfi_candidate", F.lit(0.0)), "loaded"), F.lit(0.0)).alias("ttfi"),
        first(F.coalesce("event.t", F.lit(0.0)), "loaded").alias("__loaded"),
        first(F.coalesce("event.t", F.lit(0.0)), "ready").alias("__ready"),
    )
    gap = F.coalesce(F.greatest(F.lit(0.0), F.col("__loaded") - F.col("__ready")), F.lit(0.0))
    both = F.col("__loaded").isNotNull() & F.col("__ready").isNotNull()
    return per.select("session_id", "js_ran", "ttfi", F.when(both, gap).otherwise(0.0).alias("dom_read"))


def honeypot_trips(req: DataFrame) -> DataFrame:
    """Trap hits found in request rows: the three trap paths, and a form post that fills
    the invisible field. req: path, method, content_type, body, qs, referer, ua."""
    posted = (F.col("method") == "POST") & F.lower(F.coalesce("content_type", F.lit(""))).contains("application/x-www-form-urlencoded")
    filled = F.regexp_extract(F.coalesce("body", F.lit("")), "(?:^|&)email_verify=([^&]+)", 1)
    typed = posted & (filled != "")
    cut = lambda c, n: F.substring(F.coalesce(c, F.lit("")), 1, n)
    path = F.col("path")
    trap = (
        F.when(path == "/__canary", "canary").when(path.startswith("/__admin_secrets"), "admin_secrets")
        .when(path == "/robots.txt", "robots_read")
    )
    evidence = (
        F.when(trap == "canary", F.create_map(F.lit("qs"), cut("qs", 120), F.lit("ref"), cut("referer", 200)))
        .when(trap == "admin_secrets", F.create_map(F.lit("path"), path))
        .when(trap == "robots_read", F.create_map(F.lit("ua"), cut("ua", 200)))
    )
    value_len = F.length(F.try_url_decode(filled)).cast("string")
    form = F.create_map(F.lit("path"), path, F.lit("value_len"), value_len)
    hits = F.array(
        F.when(typed, F.struct(F.lit("invisible_field").alias("honeypot"), form.alias("evidence"))),
        F.when(trap.isNotNull(), F.struct(trap.alias("honeypot"), evidence.alias("evidence"))),
    )
    rows = req.select("line_id", "ts", "session_id", "src_label", F.explode(F.filter(hits, lambda h: h.isNotNull())).alias("h"))
    return rows.select("line_id", "ts", "session_id", "src_label", "h.honeypot", "h.evidence")


def honeypot_flags(trips: DataFrame, traps: Sequence[str] = fixed.HONEYPOTS) -> DataFrame:
    hit = lambda t: F.max(F.when(F.col("honeypot") == t, 1.0).otherwise(0.0)).alias(t)
    return trips.groupBy("session_id").agg(*[hit(t) for t in traps])


def min_requests(req: DataFrame, n: int = 3) -> DataFrame:
    """Sessions with at least n requests."""
    sizes = req.filter(C.blank_to_null(F.col("session_id")).isNotNull()).groupBy("session_id")
    return sizes.agg(F.count(F.lit(1)).alias("n_req")).filter(F.col("n_req") >= n)


def session_aggregates(req: DataFrame, beacons: DataFrame | None = None, min_n: int = 3) -> DataFrame:
    """The twelve session features plus n_req, duration_s and ts_start. Gaps are whole
    milliseconds below the session gap, so the exact percentile has a bounded buffer."""
    rows = req.filter(C.blank_to_null(F.col("session_id")).isNotNull())
    status = F.coalesce("status", F.lit(0))
    n = F.count(F.lit(1))
    base = rows.groupBy("session_id").agg(
        n.alias("n_req"), F.min("ts").alias("ts_start"), (F.max("ts") - F.min("ts")).alias("duration_s"),
        F.avg("delta_ms").alias("__mean"), F.stddev_pop("delta_ms").alias("__std"), F.percentile("delta_ms", 0.95).alias("__p95"),
        F.count_distinct(F.coalesce("path", F.lit(""))).alias("__paths"),
        (F.count_if((status >= 400) & (status < 500)) / n).alias("frac_4xx"),
        (F.count_if((status >= 500) & (status < 600)) / n).alias("frac_5xx"),
    ).filter(F.col("n_req") >= min_n)
    wide = base.join(max_rps(rows), "session_id")
    if beacons is not None:
        wide = wide.join(beacon_summary(beacons), "session_id", "left")
    else:
        wide = wide.withColumns({"js_ran": F.lit(0.0), "ttfi": F.lit(0.0), "dom_read": F.lit(0.0)})
    return wide.select(
        "session_id", "n_req", "ts_start", "duration_s",
        C.safe_log1p(F.col("n_req")).alias("log_n"), C.safe_log1p(F.col("__mean")).alias("log_delta_mean"),
        C.safe_log1p(F.col("__std")).alias("log_delta_std"), C.safe_log1p(F.col("__p95")).alias("log_delta_p95"),
        C.safe_log1p(F.col("__paths")).alias("log_paths"), "frac_4xx", "frac_5xx",
        F.col("max_rps").cast("double").alias("max_rps"), F.coalesce("js_ran", F.lit(0.0)).alias("js_ran"),
        C.safe_log1p(F.col("ttfi")).alias("log_ttfi"), C.safe_log1p(F.col("dom_read")).alias("log_dom_read"),
        C.safe_log1p(F.col("duration_s") * 1000.0).alias("log_duration_ms"),
    )


def majority(req: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Most frequent non-empty value of each column per session, ties to the first seen."""
    pairs = F.array(*[F.struct(F.lit(c).alias("attr"), F.col(c).cast("string").alias("value")) for c in columns])
    long = req.select("session_id", "ts", "line_id", F.explode(pairs).alias("p")).filter(C.blank_to_null(F.col("p.value")).isNotNull())
    counts = long.groupBy("session_id", "p.attr", "p.value").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("ts", "line_id")).alias("seen"))
    best = lambda c: F.min_by("value", F.when(F.col("attr") == c, F.struct(-F.col("n"), F.col("seen")))).alias(f"major_{c}")
    return counts.groupBy("session_id").agg(*[best(c) for c in columns])


def resolve_session_labels(
    req: DataFrame, meta: DataFrame | None = None, trips: DataFrame | None = None, default_app: str = fixed.DEFAULT_TARGET_APP
) -> DataFrame:
    """Class, family, target, stealth and y per session: the provenance row first, then the
    majority of the request rows, then the source label.
    meta: session_id, ts, line_id, class, family, target_app, stealth."""
    at = F.struct("ts", "line_id")
    named = C.blank_to_null(F.col("src_label")).isNotNull()
    base = req.groupBy("session_id").agg(
        F.max_by("src_label", F.when(named, at)).alias("__src"),
        F.count_if("stealth").alias("__yes"), F.count("stealth").alias("__votes"),
    )
    base = base.join(majority(req, ["class", "family", "target_app"]), "session_id", "left")
    if trips is not None:
        base = base.join(trips.groupBy("session_id").agg(F.min_by("src_label", at).alias("__trip")), "session_id", "left")
    else:
        base = base.withColumn("__trip", F.lit(None).cast("string"))
    if meta is not None:
        latest = meta.groupBy("session_id").agg(F.max_by(F.struct("class", "family", "target_app", "stealth"), at).alias("m"))
        base = base.join(latest, "session_id", "left")
    else:
        base = base.withColumn("m", F.lit(None).cast("struct<class:string,family:string,target_app:string,stealth:boolean>"))
    src = F.coalesce("__src", "__trip", F.lit("unknown"))
    value = lambda c, fallback: F.coalesce(C.blank_to_null(F.col(f"m.{c}")), F.col(f"major_{c}"), fallback)
    voted = F.col("__votes") > 0
    klass = value("class", C.class_of(src))
    return base.select(
        "session_id", src.alias("src_label"), klass.alias("klass"), value("family", src).alias("family"),
        value("target_app", F.lit(default_app)).alias("target_app"),
        F.coalesce(F.col("m.stealth"), voted & (F.col("__yes") * 2 > F.col("__votes"))).alias("stealth"),
        F.when(klass == "agent", 1).otherwise(0).alias("y"),
    )


def join_sessions(
    req: DataFrame, beacons: DataFrame | None = None, trips: DataFrame | None = None, meta: DataFrame | None = None, min_n: int = 3
) -> DataFrame:
    """One row per session: features, trap flags and labels. All sides are aggregated to
    one row per session before they are joined."""
    wide = session_aggregates(req, beacons, min_n).join(resolve_session_labels(req, meta, trips), "session_id")
    if trips is not None:
        wide = wide.join(honeypot_flags(trips), "session_id", "left")
    flag = lambda t: F.coalesce(F.col(t), F.lit(0.0)) if trips is not None else F.lit(0.0)
    return wide.withColumns({t: flag(t) for t in fixed.HONEYPOTS})


def public_features(sessions: DataFrame) -> DataFrame:
    """What a scorer may see: no labels. Request sequences stay in `request_features`."""
    return sessions.select(
        "session_id", "target_app", F.array(*SESSION_FEATURES).alias("agg"), F.array(*fixed.HONEYPOTS).alias("hp")
    )


def train_features(sessions: DataFrame) -> DataFrame:
    labels = sessions.select("session_id", "y", "family", "klass", "stealth")
    return public_features(sessions).join(labels, "session_id")


def truth(sessions: DataFrame) -> DataFrame:
    return sessions.select("session_id", "y", "family", "klass", "stealth", "target_app", "duration_s", "src_label")


def public_sequences(req: DataFrame, sessions: DataFrame) -> DataFrame:
    """The request features of the released sessions, one row per request."""
    return request_features(req).join(sessions.select("session_id"), "session_id", "left_semi")


TRANSITION_SLOTS = 32
TRANSITIONS = [f"go_{k}" for k in range(TRANSITION_SLOTS)]


def transitions(features: DataFrame, slots: int = TRANSITION_SLOTS) -> DataFrame:
    """(session_id, slot, n): how often a session goes from one kind of request to the next, by hashed slot. A kind is the method (POST or not),
    the status class and the path bucket, so what is seen is the order of requests, not their number or pace.
    features: the request features."""
    kind = F.concat_ws("|", F.col("is_post").cast("int"), F.floor("status_scaled").cast("int"), F.round(F.col("path_bucket") * 16).cast("int"))
    kinds = features.select("session_id", "ts", "line_id", kind.alias("kind"))
    pairs = previous_in_key(kinds, "session_id", "ts", ["line_id"], "kind", "before").filter(F.col("before").isNotNull())
    digest = F.sha2(F.concat_ws(">", "before", "kind"), 256)
    slot = (F.conv(F.substring(digest, 57, 8), 16, 10).cast("long") % slots).cast("int")
    return pairs.groupBy("session_id", slot.alias("slot")).agg(F.count(F.lit(1)).alias("n"))


def transition_features(features: DataFrame) -> DataFrame:
    """One row per session with two or more requests: the share of its transitions in each slot, as columns go_0, go_1, and so on."""
    counts = transitions(features)
    shares = [(F.sum(F.when(F.col("slot") == k, F.col("n")).otherwise(0)) / F.sum("n")).alias(c) for k, c in enumerate(TRANSITIONS)]
    return counts.groupBy("session_id").agg(*shares)


def with_transitions(sessions: DataFrame, features: DataFrame) -> DataFrame:
    """Sessions with their transition features, 0 where a session has none."""
    return sessions.join(transition_features(features), "session_id", "left").fillna(0.0, TRANSITIONS)


def honeypot_rule(sessions: DataFrame) -> DataFrame:
    tripped = F.greatest(*[F.col(t) for t in fixed.HONEYPOTS]) > 0
    return sessions.select("session_id", F.when(tripped, 0.95).otherwise(0.05).alias("agent_score"))


def ua_rule(features: DataFrame, sessions: DataFrame | None = None) -> DataFrame:
    """Score from the most frequent user-agent score of the session (first seen on ties);
    a session without requests counts as a common browser."""
    counts = features.withColumn("b", F.round("ua_score", 1)).groupBy("session_id", "b").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("ts", "line_id")).alias("seen")
    )
    modal = counts.groupBy("session_id").agg(F.min_by("b", F.struct(-F.col("n"), F.col("seen"))).alias("b"))
    if sessions is not None:
        modal = sessions.select("session_id").join(modal, "session_id", "left").withColumn("b", F.coalesce("b", F.lit(1.0)))
    b = F.col("b")
    score = F.when(b <= 0.20, 0.05).when(b <= 0.40, 0.90).when(b <= 0.80, 0.20).otherwise(0.10)
    return modal.select("session_id", score.alias("agent_score"))


def timing_rule(features: DataFrame, boundary_ms: float = 500.0, scale: float = 1.5) -> DataFrame:
    """Faster median cadence, higher score: a logistic curve around the boundary."""
    centre = F.log1p(F.lit(boundary_ms))
    med = features.groupBy("session_id").agg(F.median("log_delta").alias("m"))
    return med.select("session_id", (1.0 / (1.0 + F.exp((F.col("m") - centre) / scale))).alias("agent_score"))


def class_cadence(req: DataFrame, beacons: DataFrame) -> DataFrame:
    """Per class: sessions, median of the positive per-session median gaps, share with beacons."""
    at = F.struct("ts", "line_id")
    per = req.filter(C.blank_to_null(F.col("session_id")).isNotNull()).groupBy("session_id").agg(
        F.floor(F.coalesce(F.median("delta_ms"), F.lit(0.0))).cast("long").alias("gap"),
        F.coalesce(F.min_by("class", at), F.lit("?")).alias("class"),
    )
    seen = beacons.select("session_id", F.lit(1).alias("__b")).distinct()
    joined = per.join(seen, "session_id", "left")
    return joined.groupBy("class").agg(
        F.count(F.lit(1)).alias("sessions"),
        F.floor(F.coalesce(F.median(F.when(F.col("gap") > 0, F.col("gap"))), F.lit(0.0))).cast("long").alias("median_delta_ms"),
        F.round(F.count("__b") / F.count(F.lit(1)), 3).alias("beacon_present_ratio"),
    )


def class_family_counts(meta: DataFrame) -> DataFrame:
    name = lambda c: F.coalesce(F.col(c), F.lit("?")).alias(c)
    return meta.groupBy(name("class"), name("family")).agg(F.count(F.lit(1)).alias("n"))


def request_rate(req: DataFrame, now: float, window_s: float = 60.0) -> DataFrame:
    """Requests per second per (label, target) in the trailing window, with status classes."""
    label = F.coalesce(C.blank_to_null(F.col("src_label")), C.blank_to_null(F.col("family")), F.lit("?"))
    status: Column = F.coalesce("status", F.lit(0))
    recent = req.filter(F.col("ts") >= now - window_s)
    app = F.coalesce(C.blank_to_null(F.col("target_app")), F.lit("?"))
    group = recent.groupBy(label.alias("family"), app.alias("target_app"))
    band = lambda lo: F.count_if((status >= lo) & (status < lo + 100)).alias(f"status_{lo // 100}xx")
    out = group.agg(F.count(F.lit(1)).alias("n_requests"), F.max("ts").alias("last_ts"), band(200), band(400), band(500))
    return out.withColumn("req_per_s", F.col("n_requests") / max(float(window_s), 1.0))
