"""What the operators share: document input, staged tables, skew-safe lookups, components, Python batches."""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType, StructType

from alertloom.session import shared_folder, ship_package

BATCH_ROWS = 512
HOT_KEYS = 1000
SMALL_ROWS = 1 << 14


def documents(docs: DataFrame, *columns: str) -> DataFrame:
    """doc_id, text (null counts as empty) and the named columns; other columns, whatever their names, are dropped."""
    return docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), *columns)


def remainder(modulus: int) -> F.Column:
    """crc32 of the doc_id as text, modulo; a row without a doc_id counts as the empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % modulus


def row_id(first: bool) -> F.Column:
    """What tells rows apart that repeat a doc_id or have none: the id, then a hash of the text. Rows without an id come last
    if `first` (the smallest id wins), else first."""
    none = F.col("doc_id").isNull()
    return F.struct((none if first else ~none).alias("rank"), F.coalesce("doc_id", F.lit(0)).alias("id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("h"))


def keep_rows(docs: DataFrame, key: F.Column, kept: DataFrame, once: bool = False) -> DataFrame:
    """The rows of docs, with all their columns, whose key is in the one column of `kept`; of rows with the same key only
    one if `once`."""
    name = "__llm_row_key"
    rows = docs.withColumn(name, key).join(kept.toDF(name).distinct(), name, "left_semi")
    return (rows.dropDuplicates([name]) if once else rows).select(*[F.col(f"`{c}`") for c in docs.columns])


_own = threading.local()
RELEASE_S = 0.5
_released = [0.0]


def release(spark: SparkSession) -> None:
    """Let the driver collect its garbage, at most every RELEASE_S seconds: Spark removes the shuffle files of plans that nothing refers to only then,
    and a driver with a small heap of plans may not collect for half an hour while executors' disks fill."""
    if time.monotonic() - _released[0] > RELEASE_S:
        spark.sparkContext._jvm.java.lang.System.gc()
        _released[0] = time.monotonic()


def staged() -> list[str]:
    """The folders that this thread has staged and not removed, in order."""
    if not hasattr(_own, "paths"):
        _own.paths = []
    return _own.paths


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write the rows once to the shared folder and go on from the files: later jobs, and tasks that are run again
    after an executor is lost, read the same rows. Shuffle files that earlier jobs left, the caller's too, go before the write, its own after it."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/llm/{label}-{uuid.uuid4().hex}"
    release(spark)
    df.write.parquet(path)
    staged().append(path)
    release(spark)
    return _read(spark, df.schema, path)


def _read(spark: SparkSession, schema: StructType, path: str) -> DataFrame:
    """The staged table, whose list of files the driver does not keep in Spark's cache for all tables: it would stay there when the table is gone."""
    name = "spark.sql.hive.filesourcePartitionFileCacheSize"
    size = spark.conf.get(name)
    spark.conf.set(name, "0")
    try:
        return spark.read.schema(schema).parquet(path)
    finally:
        spark.conf.set(name, size)


def stage_result(spark: SparkSession, make: Callable[[], DataFrame], label: str) -> DataFrame:
    """Stage what `make` returns, then remove what it has staged on the way: once the result is written, nothing reads that again."""
    before = len(staged())
    result = stage(make(), label)
    forget(spark, staged()[before:-1])
    return result


def forget(spark: SparkSession, paths: list[str]) -> None:
    """Remove staged tables that no table still in use is read from: whatever was made of them has been staged in its turn."""
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(hadoop).delete(folder, True)
        staged().remove(path)


def in_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | Iterator[pa.RecordBatch]], schema: str | StructType, rows: int = BATCH_ROWS) -> DataFrame:
    """Run fn over Arrow batches of few rows, so that a worker's memory does not grow with the partition."""
    spark = df.sparkSession
    ship_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                made = fn(batch)
                yield from [made] if isinstance(made, pa.RecordBatch) else made

    return df.mapInArrow(run, schema)


def attach(rows: DataFrame, table: DataFrame, key: list[str], weight: str) -> DataFrame:
    """Left join of rows with a table that has one row per key; weight is the table's column with the number of rows of
    the key. Keys with over 1/1000 of the rows, of which there are fewer than 1000, come by broadcast, so that no task
    gets all rows of a hot key; the others by an ordinary join. There is one join where no key is hot, and one by broadcast for a table
    of numbers with SMALL_ROWS rows or fewer."""
    total, most, n = table.agg(F.sum(weight), F.max(weight), F.count("*")).first()
    extra = [c for c in table.columns if c not in key]
    small = n <= SMALL_ROWS and all(isinstance(f.dataType, NumericType) for f in table.schema)
    if small or not total or most * HOT_KEYS <= total:
        return rows.join(F.broadcast(table) if small else table, key, "left").select(*rows.columns, *extra)
    hot = F.col(weight) * HOT_KEYS > F.lit(total)
    heads = table.where(hot).select(*key, F.struct(*extra).alias("_hot"))
    common = rows.join(F.broadcast(heads), key).select(*rows.columns, *[F.col(f"_hot.{c}").alias(c) for c in extra])
    rare = rows.join(F.broadcast(heads), key, "left_anti").join(table.where(~hot), key, "left").select(*rows.columns, *extra)
    return common.unionByName(rare)


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of the undirected edges (a, b); root is the smallest node that can be reached. Rounds of large and small stars,
    about log2 of the longest path, each staged in place of the one before, until all edges are stars around the smallest nodes. The smallest
    neighbour of a node is an aggregate that is combined before the shuffle, so a node with many edges is no hot group."""
    before = len(staged())
    now = stage(edges.where("a <> b").selectExpr("greatest(a, b) a", "least(a, b) b").distinct(), "edges")
    while not _stars(now):
        both = now.unionByName(now.selectExpr("b a", "a b"))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"), F.count("*").alias("n"))
        large = attach(both, low, ["a"], "n").where("b > a").selectExpr("b a", "m b").where("a <> b").distinct()
        large = stage(large, "large")
        low = large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
        small = attach(large, low, ["a"], "n").selectExpr("b a", "m b").unionByName(low.selectExpr("a", "m b"))
        now = stage(small.where("a <> b").distinct(), "small")
        forget(edges.sparkSession, staged()[before:-1])
    return now.selectExpr("a node", "b root").unionByName(now.selectExpr("b node", "b root").distinct())


def _stars(edges: DataFrame) -> bool:
    """Whether each node has one edge to a smaller node and none to a larger, or none to a smaller."""
    ends = edges.selectExpr("stack(2, a, 1, b, 0) as (node, up)").groupBy("node").agg(F.sum("up").alias("up"), F.count("*").alias("n"))
    return ends.where("up > 0 and n > 1").isEmpty()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
