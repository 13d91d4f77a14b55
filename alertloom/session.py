"""Session settings the operators rely on, and the checkpoint folder rule."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "alertloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session with UTC time and AQE on. Cluster settings passed by
    spark-submit win: nothing here sets memory, executors or the checkpoint folder."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        **{k.replace("__", "."): v for k, v in conf.items()},
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The shared folder named by the cluster in spark.checkpoint.dir. A folder of the driver's machine is used only in local
    mode without that setting, as in a test; on a cluster a missing setting is an error, as executors would not share the files.

    Everything the library writes lies below this folder: checkpoints, staged tables (`llm/`) and the `run-*` folders of
    queries. None of it is needed once the application has ended; whoever owns the folder can then empty it."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named
    if spark.sparkContext.getCheckpointDir() is not None:
        return spark.sparkContext.getCheckpointDir()
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return os.path.join(tempfile.gettempdir(), "alertloom-checkpoints")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write the rows to the reliable checkpoint folder and continue from there, so
    that an iterative plan stays short and a lost executor costs one re-read."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application. Needed only by the
    operators that run Python on the executors."""
    import shutil

    context = spark.sparkContext
    if getattr(context, "_alertloom_shipped", False):
        return
    here = os.path.dirname(os.path.abspath(__file__))
    archive = shutil.make_archive(os.path.join(tempfile.mkdtemp(prefix="alertloom-"), "alertloom"), "zip", os.path.dirname(here), "alertloom")
    context.addPyFile(archive)
    context._alertloom_shipped = True
