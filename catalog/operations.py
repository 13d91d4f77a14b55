"""Operations rollups, profiles, plans and governance gates."""

from pyspark.sql import functions as F

from alertloom import fixed
from alertloom.functions import columns as C
from alertloom.operators import governance as D
from alertloom.operators import rollups as R
from alertloom.operators import thresholds as T
from alertloom.plans import staging
from catalog.registry import EV, SCORED, case_map, list_sql, query
from catalog.scores import scored
from catalog.windows import rounded

_SLUG = lambda c: f"trim(regexp_replace(lower({c}), '[^a-z0-9]+', '_', 'g'), '_')"
_PAIRS = staging.BACKEND_MODELS
SP = f"""sp AS (SELECT 'c' || conv_id AS session_id, (conv_id * 600)::DOUBLE AS ts, CASE WHEN conv_id % 7 = 6 THEN 'scrapy' ELSE 'llm_' || {_SLUG('b')} || '_' || {_SLUG('m')} END AS family, 'agent' AS class,
  CASE WHEN conv_id % 3 = 0 THEN 'dvwa' ELSE 'webgoat' END AS target_app, CASE WHEN conv_id % 2 = 0 THEN 'low' ELSE 'medium' END AS security_level, conv_id % 4 = 0 AS stealth, b AS backend, m AS model,
  'template_' || conv_id % 3 AS prompt_template_id, tokens_in, tokens_out, conv_id
  FROM (SELECT conv_id, {list_sql([b for b, _ in _PAIRS])}[conv_id % 7 + 1] AS b, {list_sql([m for _, m in _PAIRS])}[conv_id % 7 + 1] AS m,
     CAST(coalesce(sum(length(text)) FILTER (WHERE role <> 'assistant'), 0) AS BIGINT) AS tokens_in, CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS tokens_out FROM conversations GROUP BY conv_id)),
price AS (SELECT * FROM (VALUES {', '.join(f"('{b}', '{m}', {i}::DOUBLE, {o}::DOUBLE)" for b, m, i, o in fixed.PRICES)}) v(backend, model, price_in, price_out)),
cost AS (SELECT sp.*, (tokens_in * price_in + tokens_out * price_out) / 1000000 AS cost_cents FROM sp LEFT JOIN price USING (backend, model))"""


def spend(spark, sf):
    return R.with_cost(staging.spend(spark, sf))


@query("P30_session_cost", f"WITH {SP} SELECT session_id, backend, model, tokens_in, tokens_out, round(cost_cents, 9) AS cost_cents FROM cost")
def session_cost(spark, sf):
    return rounded(spend(spark, sf).select("session_id", "backend", "model", "tokens_in", "tokens_out", "cost_cents"), {"cost_cents": 9})


@query("J12_with_prices", f"WITH {SP} SELECT session_id, price_in, price_out FROM sp LEFT JOIN price USING (backend, model)")
def with_prices(spark, sf):
    return R.with_prices(staging.spend(spark, sf)).select("session_id", "price_in", "price_out")


_CUT = 3000.0


@query("A32_spend_rollup", f"""WITH {SP}, r AS (SELECT * FROM cost WHERE ts >= {_CUT} AND starts_with(family, 'llm_')),
c AS (SELECT prompt_template_id, backend, model, count(*) AS n, sum(tokens_in) AS ti, sum(tokens_out) AS tu, coalesce(sum(cost_cents), 0) AS c, count(*) FILTER (WHERE cost_cents IS NULL) AS f FROM r GROUP BY ALL)
SELECT prompt_template_id, backend, model, CAST(sum(n) AS BIGINT) AS n_sessions, CAST(sum(ti) AS BIGINT) AS tokens_in, CAST(sum(tu) AS BIGINT) AS tokens_out, round(sum(c), 6) AS cost_cents, CAST(sum(f) AS BIGINT) AS unpriced_sessions, count(*) AS n_cells,
  CASE GROUPING(prompt_template_id) * 2 + GROUPING(backend) WHEN 0 THEN 'template_model' WHEN 1 THEN 'template' WHEN 2 THEN 'model' ELSE 'total' END AS scope, sum(f) > 0 AS unpriced
FROM c GROUP BY GROUPING SETS ((), (backend, model), (prompt_template_id), (prompt_template_id, backend, model))""")
def spend_rollup(spark, sf):
    return rounded(R.spend_rollup(spend(spark, sf), _CUT + 86400.0), {"cost_cents": 6})


@query("A33_sessions_by_family", f"""WITH {SP}, r AS (SELECT * FROM sp WHERE ts >= {_CUT})
SELECT family, count(*) AS n, count(*) FILTER (WHERE stealth) AS stealth, count(*) FILTER (WHERE NOT stealth) AS no_stealth, max(ts) AS last_seen, count(*) FILTER (WHERE target_app = 'dvwa') AS on_dvwa, count(*) FILTER (WHERE class = 'agent') AS as_agent FROM r GROUP BY 1""")
def sessions_by_family(spark, sf):
    out = R.sessions_by_family(staging.spend(spark, sf), _CUT + 300.0)
    zero = F.lit(0).cast("long")
    return out.select("family", "n", "stealth", "no_stealth", "last_seen", F.coalesce(F.col("by_target_app")["dvwa"], zero).alias("on_dvwa"), F.coalesce(F.col("by_class")["agent"], zero).alias("as_agent"))


def provenance(spark, sf):
    s = spend(spark, sf)
    extra = F.struct("backend", "model", "tokens_in", "tokens_out", F.col("cost_cents").alias("estimated_cost_cents"), "prompt_template_id")
    return s.withColumn("extra", extra).withColumn("generator", F.lit("agent"))


@query("T1_recent_sessions", f"""WITH {SP} SELECT ts, session_id, class, family, target_app, security_level, stealth, 'agent' AS generator,
  CASE WHEN cost_cents IS NULL THEN 'backend,model,prompt_template_id,tokens_in,tokens_out' ELSE 'backend,estimated_cost_cents,model,prompt_template_id,tokens_in,tokens_out' END AS extra_keys, tokens_in, tokens_out, round(cost_cents, 9) AS estimated_cost_cents
FROM cost ORDER BY ts DESC LIMIT 20""")
def recent_sessions(spark, sf):
    return rounded(R.recent_sessions(provenance(spark, sf), 20), {"estimated_cost_cents": 9})


@query("P24_family_names", f"""WITH {SP} SELECT session_id, family, nullif(regexp_extract(family, '^llm_(openai|anthropic)_(.+)$', 1), '') AS backend_part, nullif(regexp_extract(family, '^llm_(openai|anthropic)_(.+)$', 2), '') AS model_part,
  coalesce(nullif(regexp_extract(family, '^llm_(openai|anthropic)_(.+)$', 1), ''), family) AS super_family FROM sp""")
def family_names(spark, sf):
    f = F.col("family")
    return staging.spend(spark, sf).select("session_id", "family", C.backend_of(f).alias("backend_part"), C.model_slug_of(f).alias("model_part"), C.super_family(f).alias("super_family"))


@query("A43_project_cost", f"""WITH {SP}, cells AS (SELECT target_app, backend, model, count(*) AS sessions FROM sp GROUP BY ALL)
SELECT target_app, backend, model, sessions, round((9000 * price_in + 2250 * price_out) / 1000000, 9) AS cents_per_session, round((9000 * price_in + 2250 * price_out) / 1000000 * sessions, 6) AS cents_total FROM cells LEFT JOIN price USING (backend, model)""")
def project_cost(spark, sf):
    cells = staging.spend(spark, sf).groupBy("target_app", "backend", "model").agg(F.count(F.lit(1)).alias("sessions"))
    return rounded(R.project_cost(cells), {"cents_per_session": 9, "cents_total": 6})


@query("A43_projection_summary", f"""WITH {SP}, cells AS (SELECT target_app, backend, model, count(*) AS sessions FROM sp GROUP BY ALL)
SELECT round(coalesce(sum((9000 * price_in + 2250 * price_out) / 1000000 * sessions), 0), 6) AS total_cents, count(*) FILTER (WHERE price_in IS NULL) AS unpriced_cells FROM cells LEFT JOIN price USING (backend, model)""")
def projection_summary(spark, sf):
    cells = staging.spend(spark, sf).groupBy("target_app", "backend", "model").agg(F.count(F.lit(1)).alias("sessions"))
    return rounded(R.projection_summary(R.project_cost(cells)), {"total_cents": 6})


@query("W17_spend_cutoff", f"""WITH {SP}, r AS (SELECT conv_id AS seq, round(cost_cents, 6) AS c, sum(coalesce(round(cost_cents, 6), 0)) OVER (ORDER BY conv_id ROWS UNBOUNDED PRECEDING) AS run, row_number() OVER (ORDER BY conv_id) AS k FROM cost)
SELECT seq, c AS cost_cents, round(run, 6) AS running_cents, run <= 0.35 AND (run - coalesce(c, 0) < 0.35 OR k = 1) AS runs FROM r""")
def spend_cutoff(spark, sf):
    cells = spend(spark, sf).select(F.substring("session_id", 2, 20).cast("long").alias("seq"), F.round("cost_cents", 6).alias("cost_cents"))
    return rounded(T.spend_cutoff(cells, 0.35), {"running_cents": 6})


@query("A36_profile", " UNION ALL ".join(f"""SELECT '{c}' AS "column", '{t}' AS dtype, count(DISTINCT {c}) AS cardinality, round(count(DISTINCT {c}) / count(*), 3) AS card_ratio, count(*) - count({c}) AS n_missing,
  (SELECT string_agg(v, ', ' ORDER BY v) FROM (SELECT DISTINCT CAST({c} AS VARCHAR) AS v FROM {tab} ORDER BY v LIMIT 3)) AS sample FROM {tab}""" for tab, c, t in [
    ("orders", "o_orderkey", "bigint"), ("orders", "o_custkey", "bigint"), ("orders", "o_orderstatus", "string"), ("orders", "o_orderpriority", "string")]))
def profile(spark, sf):
    return R.profile(staging.table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"))


@query("A36_profile_sketch")
def profile_sketch(spark, sf):
    """Rows-only: distinct counts are sketches."""
    return R.profile(staging.table(spark, sf, "lineitem"), exact=False)


@query("A37_suggest_mapping", """WITH f AS (SELECT count(DISTINCT user_id) / count(*) AS share, count(DISTINCT event_type) AS kinds, count(DISTINCT props) AS texts FROM events)
SELECT 'campaign_id' AS field, true AS required, CASE WHEN share < 0.5 THEN 'user_id' ELSE 'event_id' END AS source, CASE WHEN share < 0.5 THEN 2.8 ELSE 2.0 END::DOUBLE AS score FROM f
UNION ALL SELECT 'ts', true, 'ts', 2.0 UNION ALL SELECT 'action', true, 'event_type', CASE WHEN kinds BETWEEN 2 AND 50 THEN 2.6 ELSE 2.0 END FROM f
UNION ALL SELECT 'target', true, CASE WHEN texts > 10 THEN 'props' END, CASE WHEN texts > 10 THEN 0.5 ELSE 0 END FROM f
UNION ALL SELECT unnest(['label', 'depth', 'artifact_ai']), unnest([true, false, false]), NULL, 0.0""")
def suggest_mapping(spark, sf):
    return R.suggest_mapping(staging.table(spark, sf, "events"))


@query("U4_plan_matrix", f"""WITH {SCORED} SELECT target_app, family, stealth FROM (SELECT DISTINCT target_app FROM sc), (SELECT DISTINCT family FROM sc), (SELECT unnest([false, true]) AS stealth) WHERE NOT (family = 'src2' AND stealth)""")
def plan_matrix(spark, sf):
    row = R.axis_row(scored(spark, sf), {"target_app": F.col("target_app"), "family": F.col("family")}).withColumn("stealth", F.array(F.lit(False), F.lit(True)))
    return R.plan_matrix(row, ["target_app", "family", "stealth"], ~((F.col("family") == "src2") & F.col("stealth")))


_PLAN = f"""plan AS (SELECT t AS target_app, b AS backend, m AS model, s AS stealth, CAST(2 AS INTEGER) AS sessions, 'llm_' || {_SLUG('b')} || '_' || {_SLUG('m')} AS family, CASE WHEN t = 'dvwa' THEN 'na' ELSE 'low' END AS security_level
  FROM (SELECT unnest({list_sql(fixed.BROWSER_TARGETS)}) AS t), (VALUES ('openai', 'gpt-4o-mini'), ('anthropic', 'claude-haiku-4-5')) v(b, m), (SELECT unnest([false, true]) AS s))"""


@query("J10_plan_census", f"""WITH {SP}, {_PLAN} SELECT plan.*, (SELECT count(*) FROM sp WHERE sp.target_app = plan.target_app AND sp.family = plan.family AND sp.stealth = plan.stealth AND (sp.security_level = plan.security_level OR plan.security_level = 'na')) AS sessions_observed,
  EXISTS (SELECT 1 FROM sp WHERE sp.target_app = plan.target_app AND sp.family = plan.family AND sp.stealth = plan.stealth AND (sp.security_level = plan.security_level OR plan.security_level = 'na')) AS any_provenance_seen FROM plan""")
def plan_census(spark, sf):
    """U5 builds the plan, J10 counts the sessions of the table that match it."""
    plan = R.agent_plan(spark).withColumn("security_level", F.when(F.col("target_app") == "dvwa", "na").otherwise("low"))
    return R.plan_census(plan, staging.spend(spark, sf))


@query("U4_sweep_census", f"""WITH {SP}, x AS (SELECT unnest([{', '.join("{t: '" + t + "', f: '" + f + "'}" for t, fs in fixed.TARGET_FAMILIES.items() for f in fs)}], recursive := true)),
plan AS (SELECT t AS target_app, f AS family, CASE WHEN t = 'vampi' THEN 'na' ELSE l END AS security_level, s AS stealth, CAST(2 AS INTEGER) AS sessions FROM x, (SELECT unnest(['low', 'medium', 'high']) AS l), (SELECT unnest([false, true]) AS s) WHERE NOT (f = 'sqlmap' AND s AND l = 'high') AND NOT (t = 'vampi' AND l <> 'low'))
SELECT plan.*, (SELECT count(*) FROM sp WHERE sp.target_app = plan.target_app AND sp.family = plan.family AND sp.stealth = plan.stealth AND (sp.security_level = plan.security_level OR plan.security_level = 'na')) AS sessions_observed,
  EXISTS (SELECT 1 FROM sp WHERE sp.target_app = plan.target_app AND sp.family = plan.family AND sp.stealth = plan.stealth AND (sp.security_level = plan.security_level OR plan.security_level = 'na')) AS any_provenance_seen FROM plan""")
def sweep_census(spark, sf):
    return R.plan_census(R.sweep_plan(spark, levels=("low", "medium", "high")), staging.spend(spark, sf))


@query("D1_validate_scores", f"""WITH {SCORED}, s AS (SELECT CASE WHEN CAST(session_id AS BIGINT) % 17 = 0 THEN '' ELSE session_id END AS session_id, CASE CAST(session_id AS BIGINT) % 5 WHEN 0 THEN 'high' WHEN 1 THEN '1.5' ELSE CAST(agent_score AS VARCHAR) END AS v FROM sc WHERE CAST(session_id AS BIGINT) % 7 <> 0
  UNION ALL SELECT session_id, '0.5' FROM sc WHERE CAST(session_id AS BIGINT) % 13 = 2),
e AS (SELECT session_id FROM sc WHERE CAST(session_id AS BIGINT) % 11 <> 3)
SELECT session_id, CASE WHEN session_id = '' THEN 'missing or empty session_id' WHEN v = 'high' THEN 'agent_score not numeric' ELSE 'agent_score out of [0, 1]' END AS error FROM s WHERE session_id = '' OR v = 'high' OR v = '1.5'
UNION ALL SELECT session_id, 'duplicate session_id' FROM s WHERE session_id <> '' GROUP BY 1 HAVING count(*) > 1
UNION ALL SELECT session_id, 'not scored' FROM e WHERE session_id NOT IN (SELECT session_id FROM s)
UNION ALL SELECT DISTINCT session_id, 'not in the requested split' FROM s WHERE session_id <> '' AND session_id NOT IN (SELECT session_id FROM e)""")
def validate_scores(spark, sf):
    sc = scored(spark, sf)
    n = F.col("session_id").cast("long")
    value = F.when(n % 5 == 0, "high").when(n % 5 == 1, "1.5").otherwise(F.col("agent_score").cast("string"))
    got = sc.filter(n % 7 != 0).select(F.when(n % 17 == 0, "").otherwise(F.col("session_id")).alias("session_id"), value.alias("agent_score"))
    twice = sc.filter(n % 13 == 2).select("session_id", F.lit("0.5").alias("agent_score"))
    return D.validate_scores(got.unionByName(twice), sc.filter(n % 11 != 3))


@query("D2_forbidden_words", """SELECT '$.text' AS path, 'value' AS kind, count(*) AS n FROM documents WHERE contains(lower(text), 'license') HAVING count(*) > 0
UNION ALL SELECT '$.license_note', 'name', NULL UNION ALL SELECT '$.info.License', 'name', NULL""")
def forbidden_words(spark, sf):
    d = staging.table(spark, sf, "documents").withColumn("license_note", F.lit("x")).withColumn("info", F.struct(F.col("lang"), F.lit(1).alias("License")))
    return D.forbidden_words(d, "license")


def _scan_sql(table, key, text):
    rows = ", ".join(f"('{n}', '{p}')" for n, p in fixed.SCAN_PATTERNS)
    breaks = r"\r\n|[\n\r\x0B\x0C\x1C\x1D\x1E\x{85}\x{2028}\x{2029}]"
    return f"""WITH p AS (SELECT * FROM (VALUES {rows}) v(pattern, rx)),
parts AS (SELECT {key}, regexp_split_to_array({text}, '{breaks}') AS l FROM {table}),
ln AS (SELECT {key}, unnest(l) AS ln, CAST(generate_subscripts(l, 1) AS INTEGER) AS line FROM parts),
h AS (SELECT {key}, line, pattern, regexp_extract(ln, rx) AS m FROM ln, p WHERE regexp_matches(ln, rx))
SELECT {key}, line, pattern, CASE WHEN length(m) > 80 THEN substr(m, 1, 77) || '...' ELSE m END AS matched FROM h"""


@query("D3_scan_documents", _scan_sql("documents", "doc_id", "text"))
def scan_documents(spark, sf):
    return D.scan_pii(staging.table(spark, sf, "documents").select("doc_id", "text"), "doc_id")


@query("D3_scan_pages", _scan_sql("pages", "page_id", "html"))
def scan_pages(spark, sf):
    return D.scan_pii(staging.table(spark, sf, "pages").select("page_id", "html"), "page_id", "html")


CON = f"""{SCORED}, hs AS (SELECT session_id, CASE WHEN klass = 'human' THEN 'human_real' ELSE family END AS family, CASE WHEN CAST(session_id AS BIGINT) % 4 = 0 THEN NULL ELSE 'k' || CAST(session_id AS BIGINT) % 30 END AS consent_id FROM sc),
cs AS (SELECT 'k' || x AS consent_id, CASE x % 3 WHEN 0 THEN 'v1' WHEN 1 THEN 'v0' ELSE 'draft' END AS version FROM (SELECT DISTINCT CAST(session_id AS BIGINT) % 25 AS x FROM sc)),
cj AS (SELECT hs.*, CASE WHEN family <> 'human_real' THEN NULL WHEN consent_id IS NULL THEN 'missing_consent_id' WHEN version IS NULL THEN 'consent_not_found' WHEN version = 'draft' THEN 'unknown_consent_version' WHEN version = 'v0' THEN 'version_not_publishable' END AS reason FROM hs LEFT JOIN cs USING (consent_id))"""


def consent_inputs(spark, sf):
    n = F.col("session_id").cast("long")
    sc = scored(spark, sf)
    sessions = sc.withColumn("family", F.when(F.col("klass") == "human", "human_real").otherwise(F.col("family"))).withColumn(
        "consent_id", F.when(n % 4 != 0, F.concat(F.lit("k"), n % 30)))
    x = sc.select((n % 25).alias("x")).distinct()
    version = F.when(F.col("x") % 3 == 0, "v1").when(F.col("x") % 3 == 1, "v0").otherwise("draft")
    consent = x.select(F.lit(0.0).alias("ts"), F.concat(F.lit("k"), "x").alias("consent_id"), version.alias("consent_text_version"))
    return sessions, consent, [("v1", True), ("v0", False)]


@query("J11_consent_join", f"WITH {CON} SELECT session_id, family, reason, reason IS NULL AS publishable FROM cj")
def consent_join(spark, sf):
    sessions, consent, coverage = consent_inputs(spark, sf)
    return D.consent_join(sessions, consent, coverage).select("session_id", "family", "reason", "publishable")


@query("D4_excluded_sessions", f"WITH {CON} SELECT session_id, family, reason FROM cj WHERE reason IS NOT NULL")
def excluded_sessions(spark, sf):
    return D.publishable(*consent_inputs(spark, sf))[1]


@query("D6_split_access", "WITH s AS (SELECT CAST(doc_id AS VARCHAR) AS session_id, ['public_train', 'public_dev', 'public_test', 'private_heldout_family'][doc_id % 4 + 1] AS split FROM documents) SELECT * FROM s WHERE split <> 'private_heldout_family'")
def split_access(spark, sf):
    names = F.array(*[F.lit(s) for s in ["public_train", "public_dev", "public_test", "private_heldout_family"]])
    d = staging.table(spark, sf, "documents")
    splits = d.select(F.col("doc_id").cast("string").alias("session_id"), F.element_at(names, (F.col("doc_id") % 4 + 1).cast("int")).alias("split"))
    return D.split_for("public_test", splits)
