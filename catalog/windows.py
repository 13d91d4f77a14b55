"""Windows over events and their features."""

from pyspark.sql import functions as F

from alertloom import fixed
from alertloom.functions import columns as C
from alertloom.operators import windows as W
from alertloom.plans import staging
from catalog.registry import KEEP, MEMBERS, WINDOWS, EV, query


def rounded(df, digits: dict):
    return df.withColumns({c: F.round(c, d) for c, d in digits.items()})


WINDOW_DIGITS = {"dt_mean": 6, "dt_median": 6, "dt_std": 4, "events_per_sec": 9, "target_churn": 6}
_ROUNDED = "round(dt_mean, 6) AS dt_mean, round(dt_median, 6) AS dt_median, round(dt_std, 4) AS dt_std, " \
    "round(events_per_sec, 9) AS events_per_sec, round(target_churn, 6) AS target_churn"


def members(spark, sf):
    return W.window_members(staging.events(spark, sf))


def features(spark, sf):
    return W.window_features(staging.events(spark, sf), staging.ACTIONS)


@query("W1_count_windows", f"""WITH {MEMBERS}
SELECT campaign_id, window_id, count(*) AS n_events, min(ts) AS start_ts, max(ts) AS end_ts
FROM members GROUP BY campaign_id, window_id HAVING {KEEP}""")
def count_windows(spark, sf):
    return W.count_windows(staging.events(spark, sf))


@query("A1_window_features", f"""WITH {WINDOWS}
SELECT * REPLACE ({_ROUNDED}), FROM win""")
def window_features(spark, sf):
    return rounded(features(spark, sf), WINDOW_DIGITS)


@query("W2_event_gaps", f"""WITH {EV}
SELECT event_id, coalesce(ts - lag(ts) OVER (PARTITION BY campaign_id ORDER BY ts, event_id), 0) AS delta_s FROM ev""")
def event_gaps(spark, sf):
    from alertloom.operators.normalize import with_delta

    return with_delta(staging.events(spark, sf)).select("event_id", "delta_s")


@query("P11_event_features", f"""WITH {MEMBERS}
SELECT campaign_id, window_id, pos, {", ".join(f"CAST(action = '{a}' AS INTEGER)::DOUBLE AS is_{a}" for a in staging.ACTIONS)},
       round(ln(1 + greatest(0, coalesce(dt, 0))), 9) AS log_dt, depth / 6.0::DOUBLE AS depth_scaled,
       artifact_ai AS ai, pos / 32.0::DOUBLE AS position
FROM members""")
def event_features(spark, sf):
    return rounded(W.event_features(members(spark, sf), staging.ACTIONS), {"log_dt": 9})


@query("P11_sequence_tensor", f"""WITH {MEMBERS}
SELECT campaign_id, window_id, list([{", ".join(f"round(CAST(action = '{a}' AS INTEGER)::DOUBLE, 9)" for a in staging.ACTIONS)}, round(ln(1 + greatest(0, coalesce(dt, 0))), 9),
       round(depth / 6.0::DOUBLE, 9), round(artifact_ai, 9), round(pos / 32.0::DOUBLE, 9)] ORDER BY pos) AS seq
FROM members GROUP BY campaign_id, window_id HAVING {KEEP}""")
def sequence_tensor(spark, sf):
    rows = W.sequence_tensor(members(spark, sf), staging.ACTIONS)
    return rows.withColumn("seq", F.transform("seq", lambda event: F.transform(event, lambda x: F.round(x, 9))))


@query("A8_window_tactic", f"""WITH {MEMBERS},
kept AS (SELECT campaign_id, window_id FROM members GROUP BY ALL HAVING {KEEP}),
cnt AS (SELECT campaign_id, window_id, tactic, count(*) AS c FROM members WHERE tactic <> '' GROUP BY ALL),
best AS (SELECT *, row_number() OVER (PARTITION BY campaign_id, window_id ORDER BY c DESC, tactic) AS r FROM cnt)
SELECT kept.campaign_id, kept.window_id, coalesce(tactic, '') AS tactic
FROM kept LEFT JOIN (SELECT * FROM best WHERE r = 1) b USING (campaign_id, window_id)""")
def window_tactic(spark, sf):
    return W.window_tactic(members(spark, sf))


_MIX = f"""mixc AS (SELECT campaign_id, window_id, eid, count(*) AS c FROM members GROUP BY ALL),
mixr AS (SELECT *, row_number() OVER (PARTITION BY campaign_id, window_id ORDER BY c DESC, eid) AS r,
         sum(c) OVER (PARTITION BY campaign_id, window_id) AS n, count(*) OVER (PARTITION BY campaign_id, window_id) AS d FROM mixc),
mix AS (SELECT campaign_id, window_id, eid AS dominant_eid, CAST(c / n AS DOUBLE) AS share_dominant, d AS n_distinct_eids
        FROM mixr WHERE r = 1 AND (n = 32 OR (window_id = 0 AND n >= 16)))"""


@query("A9_window_event_mix", f"WITH {MEMBERS}, {_MIX} SELECT * REPLACE (round(share_dominant, 6) AS share_dominant) FROM mix")
def window_event_mix(spark, sf):
    return rounded(W.window_eid_mix(members(spark, sf)), {"share_dominant": 6})


@query("A11_window_multihot", f"""WITH {MEMBERS}
SELECT campaign_id, window_id,
  {", ".join(f"max(CASE WHEN label = 1 AND tactic = '{t}' THEN 1 ELSE 0 END) AS has_{t}" for t in fixed.TACTICS)}
FROM members GROUP BY campaign_id, window_id HAVING {KEEP}""")
def window_multihot(spark, sf):
    return W.window_multihot(members(spark, sf))


@query("A12_promote_labels", f"""WITH {EV}, odd AS (SELECT event_id, campaign_id, CAST(event_id % 13 = 0 AS INTEGER) AS label FROM ev)
SELECT event_id, campaign_id, max(label) OVER (PARTITION BY campaign_id) AS label FROM odd""")
def promote_labels(spark, sf):
    odd = staging.events(spark, sf).withColumn("label", (F.col("event_id") % 13 == 0).cast("int"))
    return W.promote_labels(odd).select("event_id", "campaign_id", "label")


@query("A41_secs_per_window", f"""WITH {WINDOWS}
SELECT round(greatest(1.0, 32 * coalesce(nullif(greatest(median(dt_median) FILTER (WHERE label = 0), 0), 0),
       nullif(greatest(median(dt_median), 0), 0), 1.0)), 4) AS secs_per_window FROM win""")
def secs_per_window(spark, sf):
    return rounded(W.secs_per_window(features(spark, sf)), {"secs_per_window": 4})


@query("M9_bigram_shares", f"""WITH {MEMBERS},
pairs AS (SELECT *, lag(action) OVER (PARTITION BY campaign_id, window_id ORDER BY pos) AS b FROM members)
SELECT campaign_id, window_id, {", ".join(f"round(count(*) FILTER (WHERE b = '{x}' AND action = '{y}') / greatest(count(b), 1), 6) AS seq_{x}_{y}" for x in staging.ACTIONS for y in staging.ACTIONS)}
FROM pairs GROUP BY campaign_id, window_id HAVING {KEEP}""")
def bigram_shares(spark, sf):
    return rounded(W.bigram_shares(members(spark, sf), staging.ACTIONS), dict.fromkeys(W.bigram_columns(staging.ACTIONS), 6))
