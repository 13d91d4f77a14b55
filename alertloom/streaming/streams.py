"""Structured Streaming: the same results as the batch operators, kept up to date.

The operators that depend on the order of a key's rows are in `ordered`. Limits on the source (maxFilesPerTrigger,
maxBytesPerTrigger) bound how many rows a micro-batch brings."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from alertloom.functions import columns as C
from alertloom.operators.models import LinearScorer
from alertloom.sources import logs
from alertloom.streaming.ordered import CampaignAlerter, alert_campaigns

def with_lateness(df: DataFrame, delay: str = "10 minutes", ts: str = "ts") -> DataFrame:
    """Event time as a timestamp with a watermark. Rows later than `delay` are dropped in
    append mode; a batch run is exact."""
    return df.withColumn("event_time", F.timestamp_seconds(F.col(ts))).withWatermark("event_time", delay)


def stream_access_log(spark: SparkSession, path: str, max_files: int = 100) -> DataFrame:
    """Parsed rows of access-log files as they appear in a folder."""
    lines = spark.readStream.option("maxFilesPerTrigger", max_files).text(path)
    return logs.parse_access_log(lines)


def stream_sessions(rows: DataFrame, gap: str = "30 minutes", delay: str = "10 minutes") -> DataFrame:
    """Inactivity sessions per (src_ip, user-agent hash). Use append or complete mode."""
    keyed = with_lateness(rows, delay).withColumn("uah", C.ua_hash(F.col("ua")))
    out = keyed.groupBy(F.session_window("event_time", gap).alias("w"), "src_ip", "uah").agg(
        F.count(F.lit(1)).alias("n_req"), F.min("ts").alias("ts_start"), F.max("ts").alias("ts_end")
    )
    sid = F.substring(F.sha1(F.concat_ws("|", "src_ip", "uah", F.bround("ts_start").cast("long").cast("string"))), 1, 24)
    return out.select(sid.alias("session_id"), "src_ip", "uah", "n_req", "ts_start", "ts_end")


def stream_rates(rows: DataFrame, keys: Sequence[str], window: str = "60 seconds", slide: str = "2 seconds", delay: str = "10 seconds", sums: Sequence[str] = ()) -> DataFrame:
    """Counts and sums per key over a trailing window, refreshed every slide."""
    w = F.window("event_time", window, slide).alias("w")
    out = with_lateness(rows, delay).groupBy(w, *keys).agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(f"sum_{c}") for c in sums])
    return out.select(F.unix_timestamp("w.end").cast("double").alias("window_end"), *keys, "n", *[f"sum_{c}" for c in sums])


def append_stream(df: DataFrame, path: str, checkpoint: str, fmt: str = "json"):
    """Put each micro-batch into a folder of its own number below `path`; a batch that is run again replaces itself, so no
    row is there twice. Readers see the number as the column `batch` and take the latest row per key."""
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").format(fmt).save(f"{path}/batch={batch_id}")

    return df.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def run_to_table(spark: SparkSession, stream: DataFrame, folder: str, mode: str = "append") -> DataFrame:
    """Run a stream over everything that is there now and return its output table."""
    writer = stream.writeStream.option("checkpointLocation", f"{folder}/state").trigger(availableNow=True)
    if mode == "append":
        query = writer.format("parquet").option("path", f"{folder}/out").outputMode("append").start()
    else:
        def replace(batch: DataFrame, batch_id: int) -> None:
            batch.write.mode("overwrite").parquet(f"{folder}/out")

        query = writer.foreachBatch(replace).outputMode(mode).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")


CLOSING, CLOSE_AFTER_S = "~closing", 400 * 86400.0


def closing_row(rows: DataFrame, key: str, ts: float) -> DataFrame:
    """One row far after `ts`. Streams in event order hold back what the watermark has not passed; this row ends a log that is complete."""
    kinds = StructType([StructField(f.name, f.dataType) for f in rows.schema.fields])
    values = [CLOSING if f.name == key else ts + CLOSE_AFTER_S if f.name == "ts" else None for f in kinds.fields]
    return rows.sparkSession.createDataFrame([tuple(values)], kinds)


def replay(spark: SparkSession, path: str, schema: str, scorer: LinearScorer, tau: float, folder: str, prepare: Callable[[DataFrame], DataFrame] | None = None, batch_bytes: int = 1 << 30, **options) -> DataFrame:
    """Replay stored events (Parquet) through the alerter, then a closing row; per campaign: onset, alert, seconds. Files may come
    in any order within the delay (option `delay`)."""
    stored = spark.read.schema(schema).parquet(path)
    live = spark.readStream.schema(schema).option("maxBytesPerTrigger", batch_bytes).parquet(path)
    if prepare is not None:
        stored, live = prepare(stored), prepare(live)
    columns = ["campaign_id", *CampaignAlerter.columns]
    kept = stored.select(*columns)
    kept.limit(0).write.parquet(f"{folder}/closing")
    live = live.select(*columns).unionByName(spark.readStream.schema(kept.schema).parquet(f"{folder}/closing"))
    alerts = alert_campaigns(live, scorer, tau, **options)
    run_to_table(spark, alerts, folder)
    last = stored.agg(F.max("ts")).first()[0] or 0.0
    closing_row(kept, "campaign_id", last).write.mode("append").parquet(f"{folder}/closing")
    alerts = run_to_table(spark, alerts, folder)
    starts = stored.groupBy("campaign_id").agg(
        F.max("label").cast("int").alias("is_attack"), F.coalesce(F.min(F.when(F.col("label") == 1, F.col("ts"))), F.min("ts")).alias("onset_ts")
    )
    joined = starts.join(alerts.select("campaign_id", F.col("ts").alias("alert_ts"), "risk", "events_seen"), "campaign_id", "left")
    return joined.withColumn("detected", F.col("alert_ts").isNotNull()).withColumn("mttd_s", F.col("alert_ts") - F.col("onset_ts"))
