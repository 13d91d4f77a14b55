"""Readers and writers for the log files: JSON lines, JSON arrays, CSV, Parquet, access
logs, emulation reports, campaign folders, release files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from alertloom import fixed
from alertloom.functions import columns as C

SYSMON_SCHEMA = (
    "`@timestamp` double, Hostname string, dataset string, Channel string, EventID int, Image string, ProcessGuid string, "
    "ParentProcessGuid string, technique string, is_malicious int, TargetFilename string, DestinationHostname string, "
    "DestinationIp string, DestinationPort string, TargetUserName string, TaskName string"
)
MANIFEST_SCHEMA = (
    "ts double, campaign_id string, ts_start double, ts_end double, class string, generator string, generator_version string, "
    "framework string, benign_subtype string, caldera_adversary string, caldera_op_id string, abilities array<string>, "
    "tactic_coverage array<string>, host_list array<string>, config_sha string, sysmon_config_sha string, source_path string, "
    "notes string, extra map<string,string>"
)
REQUEST_SCHEMA = (
    "ts double, session_id string, src_ip string, src_label string, method string, path string, qs_len long, status int, "
    "req_bytes long, resp_bytes long, ua string, header_hash string, header_count int, delta_ms long, is_new_session boolean, "
    "has_auth_header boolean, has_cookie_header boolean, content_type string, elapsed_ms int, class string, family string, "
    "target_app string, security_level string, stealth boolean"
)
BEACON_SCHEMA = (
    "ts double, session_id string, src_ip string, src_label string, ua string, "
    "event struct<type:string,t:double,ttfi_candidate:double,dom:double>"
)
HONEYPOT_SCHEMA = "ts double, session_id string, src_label string, honeypot string, evidence map<string,string>"
SESSION_SCHEMA = (
    "ts double, session_id string, src_label string, class string, family string, target_app string, security_level string, "
    "stealth boolean, generator string, generator_version string, generator_config_sha string, "
    "extra struct<backend:string,model:string,tokens_in:long,tokens_out:long,estimated_cost_cents:double,"
    "prompt_template_id:string,consent_id:string,pricing_table_version:string>"
)
CONSENT_SCHEMA = "ts double, consent_id string, consent_text_version string, ua_bucket string"
LEADERBOARD_SCHEMA = (
    "submitted_at string, submission string, submission_hash string, splits_version string, split string, seed int, "
    "primary map<string,double>, resource map<string,double>, runner string"
)


def _or_empty(spark: SparkSession, schema: str | T.StructType, read) -> DataFrame:
    """The read, or no rows where the path does not exist."""
    try:
        return read()
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def read_jsonl(spark: SparkSession, path: str | Sequence[str], schema: str) -> DataFrame:
    """JSON lines with a fixed schema; blank and unreadable lines are skipped, a missing
    path is an empty table.

    Each line is parsed as a one-element array: unlike the JSON reader, this also refuses
    a line whose object is followed by more text, as two interleaved writes leave it."""
    def read() -> DataFrame:
        lines = spark.read.text(path if isinstance(path, str) else list(path))
        parsed = F.from_json(F.concat(F.lit("["), "value", F.lit("]")), f"array<struct<{_struct_ddl(schema)}>>")
        one = lines.select(parsed.alias("r")).filter((F.size("r") == 1) & F.col("r")[0].isNotNull())
        return one.select(F.col("r")[0].alias("r")).select("r.*")

    return _or_empty(spark, schema, read)


def read_json_events(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON array of events, bare or under "events"."""
    text = spark.read.option("wholetext", True).text(path)
    array = f"array<struct<{_struct_ddl(schema)}>>"
    wrapped = F.from_json("value", f"struct<events:{array}>")["events"]
    return text.select(F.explode(F.coalesce(wrapped, F.from_json("value", array))).alias("e")).select("e.*")


def _struct_ddl(schema: str) -> str:
    return ", ".join(f"`{f.name}`:{f.dataType.simpleString()}" for f in T._parse_datatype_string(schema).fields)


def read_any(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """CSV, Parquet or JSON by the file suffix. Pass a schema for large CSV or JSON input
    to avoid a pass that only infers types."""
    low = path.lower()
    reader = spark.read.schema(schema) if schema else spark.read
    if low.endswith(".parquet"):
        return reader.parquet(path)
    if low.endswith(".csv"):
        return reader.option("header", True).option("inferSchema", schema is None).csv(path)
    if low.endswith((".jsonl", ".ndjson")):
        return reader.json(path)
    if low.endswith(".json"):
        return reader.option("multiLine", True).json(path)
    raise ValueError(f"unknown file suffix: {path}")


def parse_access_log(lines: DataFrame, column: str = "value") -> DataFrame:
    """Combined-format lines -> typed rows; lines of another shape or with a bad time are
    dropped. Other columns of the input, such as a line number, stay.

    The pattern runs once per line: it rewrites a matching line into its parts, joined by
    a character that no field of the format can hold. The generator keeps later filters
    from repeating it."""
    mark = "\x01"
    text = F.regexp_replace(F.translate(column, mark, ""), r"[\r\n]+$", "")
    parts = F.split(F.regexp_replace(text, fixed.ACCESS_LINE + r"[\s\S]*$", mark.join(f"${i}" for i in range(1, 12))), mark, -1)
    others = [c for c in lines.columns if c != column]
    rows = lines.select(*others, F.explode(F.filter(F.array(parts), lambda p: F.size(p) == 11)).alias("p"))
    g = lambda i: F.col("p")[i - 1]
    uri = g(6)
    query = F.instr(uri, "?")
    number = lambda c: F.coalesce(c.try_cast("long"), F.lit(0))
    when = F.unix_micros(F.try_to_timestamp(g(4), F.lit(fixed.ACCESS_TIME))) / F.lit(1e6)
    return rows.select(
        *others, when.alias("ts"), g(1).alias("src_ip"), g(5).alias("method"),
        F.when(query > 0, F.substring_index(uri, "?", 1)).otherwise(uri).alias("path"),
        F.when(query > 0, F.length(uri) - query).otherwise(0).cast("long").alias("qs_len"),
        number(g(8)).cast("int").alias("status"), number(g(9)).alias("resp_bytes"), g(11).alias("ua"), g(10).alias("referer"),
    ).filter(F.col("ts").isNotNull())


def read_access_log(spark: SparkSession, path: str) -> DataFrame:
    """Access-log files; the line id orders lines by file and position of the text."""
    lines = spark.read.text(path).select(
        "value", F.xxhash64(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.col("value")).alias("line_id")
    )
    return parse_access_log(lines)


def _clean_steps(rows: DataFrame, host: Column, technique: Column, start: Column, end: Column, name: Column, digest: Column) -> DataFrame:
    """Common clean-up of emulation steps: no technique or no time drops a step; a missing
    start is the end, a missing or earlier end is 5 seconds after the start."""
    t0, t1 = C.text_to_unix(start), C.text_to_unix(end)
    timed = rows.select(
        *[c for c in rows.columns if c != "step"], F.coalesce(host, F.lit("unknown")).alias("host"),
        technique.alias("technique_id"), F.coalesce(t0, t1).alias("t_start"), t1.alias("__end"),
        F.coalesce(name, F.lit("")).alias("ability_name"), F.coalesce(digest, F.lit("")).alias("command_hash"),
    ).filter(F.col("technique_id").isNotNull() & F.col("t_start").isNotNull())
    end_ok = F.col("__end") >= F.col("t_start")
    return timed.withColumn("t_end", F.when(end_ok, F.col("__end")).otherwise(F.col("t_start") + 5.0)).drop("__end")


def _field(*paths: str) -> Column:
    """First filled value among JSON paths of the step text."""
    return F.coalesce(*[C.blank_to_null(F.get_json_object("step", p)) for p in paths])


def _time_field(*paths: str) -> Column:
    """As `_field`, where 0 counts as not filled."""
    return F.coalesce(*[F.nullif(C.blank_to_null(F.get_json_object("step", p)), F.lit("0")) for p in paths])


def _text_field(*paths: str) -> Column:
    """As `_field`, for values that must be text: objects do not count."""
    return F.coalesce(*[
        F.when(~F.get_json_object("step", p).startswith("{"), C.blank_to_null(F.get_json_object("step", p))) for p in paths
    ])


def caldera_steps(reports: DataFrame, column: str = "value") -> DataFrame:
    """Steps of operation reports held as JSON text, one report per row."""
    lists = "struct<operation:struct<steps:array<string>,links:array<string>>,steps:array<string>,links:array<string>>"
    r = F.from_json(column, lists)
    some = lambda a: F.when(F.size(a) > 0, a)
    inner = F.coalesce(some(r["operation"]["steps"]), some(r["operation"]["links"]))
    outer = F.when(r["operation"].isNull(), F.coalesce(some(r["steps"]), some(r["links"])))
    others = [c for c in reports.columns if c != column]
    rows = reports.select(*others, F.explode(F.coalesce(inner, outer)).alias("step"))
    return _clean_steps(
        rows, F.coalesce(_text_field("$.host"), _field("$.host.hostname"), F.when(F.get_json_object("step", "$.host").isNull(), _field("$.paw"))),
        F.coalesce(_field("$.technique_id"), _field("$.technique.technique_id"), _field("$.attack_id")),
        _time_field("$.t_start", "$.decide", "$.start"), _time_field("$.t_end", "$.finish", "$.status_changed"),
        _field("$.ability_name", "$.ability_id"), _field("$.command_hash"),
    )


def atomic_steps(reports: DataFrame, column: str = "value") -> DataFrame:
    """Steps of test-invocation reports held as JSON text, one report per row."""
    r = F.from_json(column, "struct<invocations:array<string>,steps:array<string>>")
    some = lambda a: F.when(F.size(a) > 0, a)
    others = [c for c in reports.columns if c != column]
    rows = reports.select(*others, F.explode(F.coalesce(some(r["invocations"]), some(r["steps"]))).alias("step"))
    return _clean_steps(
        rows, F.coalesce(_text_field("$.host"), _field("$.host.hostname"), _field("$.Hostname"), _field("$.ComputerName")),
        F.coalesce(_field("$.technique_id"), _text_field("$.technique"), _field("$.attack_technique")),
        _time_field("$.t_start", "$.start"), _time_field("$.t_end", "$.finish", "$.end"),
        _field("$.atomic_name", "$.name"), _field("$.command_hash"),
    )


def _reports(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("wholetext", True).text(path)


def read_caldera_steps(spark: SparkSession, path: str) -> DataFrame:
    return caldera_steps(_reports(spark, path))


def read_atomic_steps(spark: SparkSession, path: str) -> DataFrame:
    return atomic_steps(_reports(spark, path))


def _folder_of(file: str) -> Column:
    """Name of the folder that holds the file a row was read from."""
    return F.regexp_extract(F.col("_metadata.file_path"), "/([^/]+)/" + file.replace(".", "\\."), 1)


KIND_FILES = [("caldera", "caldera_op.json"), ("atomic", "atomic_invocations.json"), ("workload", "workload.json")]


def campaign_kinds(spark: SparkSession, root: str) -> DataFrame:
    """campaign_id, source kind: the first metadata file present decides. Only paths are read."""
    paths = spark.read.format("binaryFile").option("recursiveFileLookup", False).load(f"{root}/*/*.json").select("path")
    parts = paths.select(F.element_at(F.split("path", "/"), -2).alias("campaign_id"), F.element_at(F.split("path", "/"), -1).alias("file"))
    rank = F.coalesce(*[F.when(F.col("file") == f, i) for i, (_, f) in enumerate(KIND_FILES)])
    kinds = F.array(*[F.lit(k) for k, _ in KIND_FILES])
    best = parts.withColumn("r", rank).filter(F.col("r").isNotNull()).groupBy("campaign_id").agg(F.min("r").alias("r"))
    return best.select("campaign_id", F.element_at(kinds, F.col("r") + 1).alias("source"))


def read_campaigns(spark: SparkSession, root: str, schema: str = SYSMON_SCHEMA) -> DataFrame:
    """Host events of every campaign folder in one scan, with campaign id and source kind;
    folders without a metadata file are left out."""
    reader = spark.read.schema(schema).option("mode", "DROPMALFORMED")
    events = reader.json(f"{root}/*/sysmon.jsonl").select(
        "*", _folder_of("sysmon.jsonl").alias("campaign_id"),
        F.concat_ws(":", _folder_of("sysmon.jsonl"), F.xxhash64("*").cast("string")).alias("event_key"),
    )
    return events.join(campaign_kinds(spark, root), "campaign_id")


def campaign_steps(spark: SparkSession, root: str) -> DataFrame:
    """Emulation steps of every campaign folder, operation reports before test invocations."""
    def rows(file: str) -> DataFrame:
        return _or_empty(spark, "value string, campaign_id string", lambda: _reports(spark, f"{root}/*/{file}").select(
            "value", _folder_of(file).alias("campaign_id")))

    operations, tests = rows("caldera_op.json"), rows("atomic_invocations.json")
    rest = tests.join(operations.select("campaign_id"), "campaign_id", "left_anti")
    return caldera_steps(operations).unionByName(atomic_steps(rest))


def read_workloads(spark: SparkSession, root: str) -> DataFrame:
    """Class, framework and hard-negative kind of the benign campaign folders."""
    body = "struct<class:string,framework:string,benign_subtype:string,host_list:array<string>,ts_start:double,ts_end:double>"
    rows = _reports(spark, f"{root}/*/workload.json").select(
        _folder_of("workload.json").alias("campaign_id"), F.from_json("value", body).alias("w")
    )
    return rows.select(
        "campaign_id", F.coalesce("w.class", F.lit("normal")).alias("class"), F.coalesce("w.framework", F.lit("scripted")).alias("framework"),
        F.coalesce("w.benign_subtype", F.lit("")).alias("benign_subtype"), "w.host_list", "w.ts_start", "w.ts_end",
    )


def append(df: DataFrame, path: str, fmt: str = "json", partition_by: Sequence[str] = ()) -> None:
    """Add rows to a folder of files. Committed per job, so a failed write leaves nothing."""
    df.write.mode("append").partitionBy(*partition_by).format(fmt).save(path)


def read_release(spark: SparkSession, features: str, truth: str) -> tuple[DataFrame, DataFrame]:
    """Released features and truth -> (sessions, request sequences in long form). A session
    without requests gets one all-zero request."""
    f = read_jsonl(spark, features, "session_id string, target_app string, agg array<double>, seq array<array<double>>, hp array<double>")
    t = read_jsonl(spark, truth, "session_id string, y int, family string, klass string, stealth boolean, duration_s double, src_label string")
    zero = F.array(F.array(*[F.lit(0.0)] * 9))
    both = f.join(t, "session_id").withColumn("seq", F.when(F.coalesce(F.size("seq"), F.lit(0)) <= 0, zero).otherwise(F.col("seq")))
    return both.drop("seq"), both.select("session_id", F.posexplode("seq").alias("pos", "x"))


def read_deployments(spark: SparkSession, path: str) -> DataFrame:
    """Deployment shapes from a list or {"deployments": [...]}; incomplete items are an error."""
    item = "array<struct<name:string,hosts:int,events_per_sec_per_host:double>>"
    text = _reports(spark, path)
    rows = text.select(
        F.explode(F.coalesce(F.from_json("value", f"struct<deployments:{item}>")["deployments"], F.from_json("value", item))).alias("d")
    ).select("d.*")
    bad = rows.filter(F.col("name").isNull() | F.col("hosts").isNull() | F.col("events_per_sec_per_host").isNull())
    if rows.isEmpty() or not bad.isEmpty():
        raise ValueError(f"{path} must be a non-empty list of name, hosts and events_per_sec_per_host")
    return rows


def write_split(splits: DataFrame, path: str, version: str = "v1") -> None:
    """Splits as Parquet, partitioned by split name, with the order-free checksum table beside."""
    from alertloom.operators.splits import split_summary

    splits.select("split", "session_id").write.mode("overwrite").partitionBy("split").parquet(f"{path}/ids")
    split_summary(splits).withColumn("splits_version", F.lit(version)).write.mode("overwrite").parquet(f"{path}/summary")


def read_splits(spark: SparkSession, path: str) -> DataFrame:
    """Splits written by `write_split`, refused when ids no longer match their checksum."""
    from alertloom.operators.splits import split_checksums

    ids = spark.read.parquet(f"{path}/ids")
    now = ids.groupBy("split").agg(F.count(F.lit(1)).alias("n"), *split_checksums())
    summary = spark.read.parquet(f"{path}/summary").select("split", *[F.col(c).alias(f"was_{c}") for c in now.columns[1:]])
    same = [F.col(c).eqNullSafe(F.col(f"was_{c}")) for c in now.columns[1:]]
    wrong = summary.join(now, "split", "full").filter(~(same[0] & same[1] & same[2]))
    if not wrong.isEmpty():
        raise ValueError(f"checksum mismatch in {path}: the split has been edited")
    return ids.select("session_id", "split")


def read_split(spark: SparkSession, path: str) -> DataFrame:
    """Ids of split files in JSON form (one file is one value in one row, as its checksum is over its whole list), refused when `__checksum` does not match the ids."""
    rows = spark.read.schema("split string, session_ids array<string>, __checksum string").option("multiLine", True).json(path)
    wrong = rows.filter(~C.sorted_ids_sha256(F.coalesce("session_ids", F.array().cast("array<string>"))).eqNullSafe(F.col("__checksum")))
    if not wrong.isEmpty():
        raise ValueError(f"checksum mismatch in {path}: the split has been edited")
    return rows.select(F.explode("session_ids").alias("session_id"), "split")

