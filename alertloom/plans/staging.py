"""Typed inputs for the operators, derived by Spark from the shared test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from alertloom.functions import columns as C

ACTIONS = ["click", "error", "purchase", "signup", "view"]
EVENT_IDS = {"click": 1, "error": 10, "purchase": 13, "signup": 11, "view": 3}
TECHNIQUES = ["T1595", "T1046.001", "T1003", "T1059.001", "T1021", "T1041", "T9999"]
SUBTYPES = ["ps_remoting", "wmi", "sched_task", "sanctioned_scan", "backup"]
FRAMEWORK_BY_PARITY = ["caldera", "atomic"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normalized events: one campaign per user. Scores are multiples of 1/256 so that
    sums are exact in any order."""
    raw = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k")
    user, number = F.col("user_id"), F.col("event_id")
    technique = F.element_at(F.array(*[F.lit(t) for t in TECHNIQUES]), (number % len(TECHNIQUES) + 1).cast("int"))
    return raw.select(
        number.alias("event_id"),
        user.cast("string").alias("campaign_id"),
        (F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1e6)).alias("ts"),
        F.col("event_type").alias("action"),
        k.alias("target"),
        F.least(F.lit(5), F.floor(F.col("value") / 50)).cast("int").alias("depth"),
        F.least(F.lit(1.0), F.floor("value") / F.lit(256.0)).alias("artifact_ai"),
        (user % 5 == 0).cast("int").alias("label"),
        C.literal_map(EVENT_IDS)[F.col("event_type")].alias("eid"),
        (user % 10).cast("string").alias("host"),
        technique.alias("technique"),
        C.tactic_of(technique).alias("tactic"),
    )


def processes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A process tree per user: the event of rank r is started by the event of rank r // 2.
    Ranks come from the id order, which equals the time order of the table."""
    from alertloom.operators.scans import rank_in_key

    ranked = rank_in_key(events(spark, sf_dir), "campaign_id", "ts", ["event_id"]).withColumn("r", F.col("rn") + 1)
    parents = ranked.select(F.col("campaign_id"), F.col("r").alias("pr"), F.col("event_id").alias("parent_id"))
    own = ranked.withColumn("pr", F.floor(F.col("r") / 2).cast("long"))
    joined = own.join(parents, ["campaign_id", "pr"], "left")
    return joined.select(
        F.col("event_id"), F.col("ts"), F.col("host"), F.col("eid"),
        F.concat(F.lit("g"), F.col("event_id")).alias("guid"),
        F.coalesce(F.concat(F.lit("g"), F.col("parent_id")), F.lit("")).alias("parent_guid"),
    )


def steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Emulation steps: every 50th event of the table starts one."""
    e = events(spark, sf_dir).filter(F.col("event_id") % 50 == 0)
    return e.select(
        F.col("event_id").alias("step_id"), "host", F.col("technique").alias("technique_id"),
        F.col("ts").alias("t_start"), (F.col("ts") + 1).alias("t_end"),
    )


def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One manifest row per user: class, framework and hard-negative kind by id."""
    ev = events(spark, sf_dir)
    user = F.col("campaign_id").cast("long")
    kind = user % 5
    klass = F.when(kind == 0, "attack").when(kind == 1, "hard_negative").otherwise("normal")
    names = lambda values, at: F.element_at(F.array(*[F.lit(v) for v in values]), (at + 1).cast("int"))
    return ev.groupBy("campaign_id").agg(F.min("ts").alias("ts_start"), F.max("ts").alias("ts_end")).select(
        "campaign_id", "ts_start", "ts_end",
        klass.alias("class"),
        F.when(kind == 0, names(FRAMEWORK_BY_PARITY, user % 2)).otherwise("scripted").alias("framework"),
        F.when(kind == 1, names(SUBTYPES, F.floor(user / 5) % 5)).otherwise("").alias("benign_subtype"),
    )


def rule_score() -> "F.Column":
    """A fixed window score in steps of 1/256, so that score queries need no trained model."""
    return F.least(F.lit(1.0), (F.col("depth_max") * 24 + F.col("distinct_targets") * 4 + F.col("window_id") % 5) / F.lit(256.0))


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored sessions: one per labelled document."""
    d, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    y, n = F.col("toxic"), F.col("n_chars")
    number = F.regexp_extract("source", "([0-9]+)", 1).cast("int")
    family = (
        F.when(number % 5 == 0, F.concat(F.lit("llm_openai_m"), number % 3))
        .when(number % 5 == 1, F.concat(F.lit("llm_anthropic_m"), number % 3))
        .otherwise(F.col("source"))
    )
    return d.join(labels, "doc_id").select(
        F.col("doc_id").cast("string").alias("session_id"),
        y.cast("int").alias("y"),
        ((n % 997) / F.lit(1024.0)).alias("agent_score"),
        family.alias("family"),
        F.col("source").alias("src_label"),
        F.col("lang").alias("target_app"),
        (F.col("doc_id") % 2 == 1).alias("stealth"),
        F.when(y == 1, "agent").when(F.col("lang") == "en", "human").otherwise("benign_bot").alias("klass"),
        (n / F.lit(8.0)).alias("duration_s"),
    )


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parsed access rows: one per event."""
    e = events(spark, sf_dir)
    k = F.col("target").cast("int")
    user = F.col("campaign_id").cast("long")
    agents = F.array(*[F.lit(u) for u in USER_AGENTS])
    return e.select(
        F.col("event_id").alias("line_id"),
        F.floor("ts").cast("double").alias("ts"),
        F.concat(F.lit("10.0."), user % 7, F.lit("."), user % 250).alias("src_ip"),
        F.when(F.col("action") == "purchase", "POST").otherwise("GET").alias("method"),
        F.concat(F.lit("/"), F.col("action"), F.lit("/"), k % 10).alias("path"),
        F.when(k % 3 == 0, F.concat(F.lit("q="), k)).otherwise("").alias("qs"),
        F.when(k >= 90, 500).when(k >= 75, 404).otherwise(200).alias("status"),
        (k * 37).cast("long").alias("resp_bytes"),
        F.element_at(agents, (user % len(USER_AGENTS) + 1).cast("int")).alias("ua"),
        F.when(k % 2 == 0, F.concat(F.lit("http://ref.example/"), k)).otherwise("-").alias("referer"),
    )


USER_AGENTS = [
    "Mozilla/5.0 (X11; Linux x86_64) Chrome/120.0 Safari/537.36",
    "Mozilla/5.0 (iPhone; CPU iPhone OS 17_0) Version/17.0 Mobile/15E148 Safari/604.1",
    "Mozilla/5.0 (Windows NT 10.0; rv:121.0) Gecko/20100101 Firefox/121.0",
    "curl/8.4.0",
    "python-requests/2.31",
    "",
    "FeedFetcher",
]


def access_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same requests written as combined-format text, with some broken lines."""
    r = requests(spark, sf_dir)
    when = F.date_format(F.timestamp_seconds("ts"), "dd/MMM/yyyy:HH:mm:ss")
    uri = F.when(F.col("qs") == "", F.col("path")).otherwise(F.concat_ws("?", "path", "qs"))
    size = F.when(F.col("resp_bytes") == 0, "-").otherwise(F.col("resp_bytes").cast("string"))
    line = F.concat(
        F.col("src_ip"), F.lit(" - - ["), when, F.lit(' +0000] "'), F.col("method"), F.lit(" "), uri,
        F.lit(' HTTP/1.1" '), F.col("status"), F.lit(" "), size, F.lit(' "'), F.col("referer"), F.lit('" "'),
        F.col("ua"), F.lit('"'),
    )
    broken = F.concat(F.lit("rotated "), line)
    return r.select("line_id", F.when(F.col("line_id") % 97 == 0, broken).otherwise(line).alias("value"))


def spend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Agent sessions with token counts: one per conversation."""
    c = table(spark, sf_dir, "conversations")
    size = F.length("text")
    answer = F.col("role") == "assistant"
    per = c.groupBy("conv_id").agg(
        F.coalesce(F.sum(F.when(~answer, size)), F.lit(0)).alias("tokens_in"),
        F.coalesce(F.sum(F.when(answer, size)), F.lit(0)).alias("tokens_out"),
    )
    slot = F.col("conv_id") % 7
    pairs = F.array(*[F.struct(F.lit(b).alias("b"), F.lit(m).alias("m")) for b, m in BACKEND_MODELS])
    pair = F.element_at(pairs, (slot + 1).cast("int"))
    return per.select(
        F.concat(F.lit("c"), F.col("conv_id")).alias("session_id"),
        (F.col("conv_id") * 600).cast("double").alias("ts"),
        F.when(slot == 6, "scrapy").otherwise(C.family_name(pair["b"], pair["m"])).alias("family"),
        F.lit("agent").alias("class"),
        F.when(F.col("conv_id") % 3 == 0, "dvwa").otherwise("webgoat").alias("target_app"),
        F.when(F.col("conv_id") % 2 == 0, "low").otherwise("medium").alias("security_level"),
        (F.col("conv_id") % 4 == 0).alias("stealth"),
        pair["b"].alias("backend"), pair["m"].alias("model"),
        F.concat(F.lit("template_"), F.col("conv_id") % 3).alias("prompt_template_id"),
        F.col("tokens_in").cast("long").alias("tokens_in"), F.col("tokens_out").cast("long").alias("tokens_out"),
    )


BACKEND_MODELS = [
    ("openai", "gpt-4o-mini"), ("openai", "gpt-4o"), ("openai", "gpt-4-turbo"),
    ("anthropic", "claude-haiku-4-5"), ("anthropic", "unlisted"), ("openai", "gpt-4o-mini"), ("anthropic", "claude-haiku-4-5"),
]
