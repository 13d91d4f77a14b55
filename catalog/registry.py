"""Collects (name, Spark query, optional DuckDB SQL) triples, and the SQL for the
typed inputs that `alertloom.plans.staging` derives from the shared tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from alertloom import fixed
from alertloom.plans import staging

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        @wraps(fn)
        def run(spark, sf_dir):
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return fn(spark, sf_dir)

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql.strip()
        return fn

    return add


def case_map(column: str, entries: dict, default: str = "NULL") -> str:
    quote = lambda v: f"'{v}'" if isinstance(v, str) else str(v)
    arms = " ".join(f"WHEN {quote(k)} THEN {quote(v)}" for k, v in entries.items())
    return f"(CASE {column} {arms} ELSE {default} END)"


def list_sql(values) -> str:
    return "[" + ", ".join(f"'{v}'" if isinstance(v, str) else str(v) for v in values) + "]"


def tactic_sql(column: str) -> str:
    return case_map(f"split_part(trim({column}), '.', 1)", fixed.TECHNIQUE_TACTIC, "''")


EV = f"""ev AS (
  SELECT event_id, CAST(user_id AS VARCHAR) AS campaign_id, epoch_us(ts) / 1e6 AS ts, event_type AS action,
         json_extract_string(props, '$.k') AS target,
         CAST(least(5, floor(value / 50)) AS INTEGER) AS depth, least(1.0, floor(value) / 256.0)::DOUBLE AS artifact_ai,
         CAST(user_id % 5 = 0 AS INTEGER) AS label, {case_map('event_type', staging.EVENT_IDS)} AS eid,
         CAST(user_id % 10 AS VARCHAR) AS host,
         {list_sql(staging.TECHNIQUES)}[event_id % {len(staging.TECHNIQUES)} + 1] AS technique,
         {tactic_sql(f"{list_sql(staging.TECHNIQUES)}[event_id % {len(staging.TECHNIQUES)} + 1]")} AS tactic
  FROM events)"""

MEMBERS = EV + """,
ranked AS (
  SELECT *, row_number() OVER w - 1 AS rn, lag(ts) OVER w AS prev_ts FROM ev
  WINDOW w AS (PARTITION BY campaign_id ORDER BY ts, event_id)),
spread AS (
  SELECT *, unnest(generate_series(greatest(0, CAST(ceil((rn - 31) / 16.0) AS BIGINT)), rn // 16)) AS window_id FROM ranked),
members AS (
  SELECT * EXCLUDE (prev_ts, rn), CAST(rn - 16 * window_id AS INTEGER) AS pos,
         CASE WHEN rn - 16 * window_id > 0 THEN ts - prev_ts END AS dt FROM spread)"""

KEEP = "(count(*) = 32 OR (window_id = 0 AND count(*) >= 16))"

_ACTS = ", ".join(
    f"count(*) FILTER (WHERE action = '{a}') / count(action) AS act_{a}" for a in staging.ACTIONS
)
WINDOWS = MEMBERS + f""",
win AS (
  SELECT campaign_id, window_id, count(*) AS n_events, min(ts) AS start_ts, max(ts) AS end_ts, max(label) AS label,
         coalesce(avg(dt) FILTER (WHERE dt >= 0), 0) AS dt_mean, coalesce(median(dt) FILTER (WHERE dt >= 0), 0) AS dt_median,
         coalesce(stddev_pop(dt) FILTER (WHERE dt >= 0), 0) AS dt_std,
         count(*) / (max(ts) - min(ts) + 1e-6) AS events_per_sec,
         CAST(count(DISTINCT target) AS INTEGER) AS distinct_targets, count(DISTINCT target) / count(*) AS target_churn,
         max(depth) AS depth_max, avg(depth) AS depth_mean, avg(artifact_ai) AS ai_artifact_mean,
         max(artifact_ai) AS ai_artifact_max, {_ACTS}
  FROM members GROUP BY campaign_id, window_id HAVING {KEEP})"""

WSCORED = WINDOWS + """,
man AS (
  SELECT campaign_id, min(ts) AS ts_start, max(ts) AS ts_end,
         CASE CAST(campaign_id AS BIGINT) % 5 WHEN 0 THEN 'attack' WHEN 1 THEN 'hard_negative' ELSE 'normal' END AS class,
         CASE WHEN CAST(campaign_id AS BIGINT) % 5 = 0 THEN ['caldera', 'atomic'][CAST(campaign_id AS BIGINT) % 2 + 1]
              ELSE 'scripted' END AS framework,
         CASE WHEN CAST(campaign_id AS BIGINT) % 5 = 1
              THEN ['ps_remoting', 'wmi', 'sched_task', 'sanctioned_scan', 'backup'][CAST(campaign_id AS BIGINT) // 5 % 5 + 1]
              ELSE '' END AS benign_subtype
  FROM ev GROUP BY campaign_id),
ws AS (
  SELECT win.*, man.* EXCLUDE (campaign_id),
         least(1.0, (depth_max * 24 + distinct_targets * 4 + window_id % 5) / 256.0)::DOUBLE AS score
  FROM win JOIN man USING (campaign_id))"""

SCORED = """sc AS (
  SELECT CAST(doc_id AS VARCHAR) AS session_id, toxic AS y, (n_chars % 997) / 1024.0::DOUBLE AS agent_score,
         CASE num % 5 WHEN 0 THEN 'llm_openai_m' || num % 3 WHEN 1 THEN 'llm_anthropic_m' || num % 3 ELSE source END AS family,
         source AS src_label, lang AS target_app, doc_id % 2 = 1 AS stealth,
         CASE WHEN toxic = 1 THEN 'agent' WHEN lang = 'en' THEN 'human' ELSE 'benign_bot' END AS klass,
         n_chars / 8.0::DOUBLE AS duration_s
  FROM (SELECT d.*, l.toxic, CAST(regexp_extract(d.source, '([0-9]+)', 1) AS INTEGER) AS num
        FROM documents d JOIN labels l USING (doc_id)))"""
