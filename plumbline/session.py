"""Session defaults and the shared folder used for written intermediates."""

from __future__ import annotations

import logging
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "8", app: str = "plumbline", **extra: str) -> SparkSession:
    """A local session for tests and benchmarks; on a cluster pass your own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for key, value in extra.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    # Failing queries of a log are data; their stack traces are not wanted.
    logging.getLogger("SQLQueryContextLogger").setLevel(logging.CRITICAL)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The shared folder named by the cluster in spark.checkpoint.dir.

    Only when the session names none is a folder of our own set, which is
    right for a local session and nothing else.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    return spark.sparkContext.getCheckpointDir() or _own_dir(spark)


def _own_dir(spark: SparkSession) -> str:
    folder = tempfile.mkdtemp(prefix="plumbline-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder; never reused between calls.

    Everything an application leaves behind lies in one folder, which may be
    removed once the application has ended.
    """
    return f"{shared_dir(spark)}/plumbline/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Write a small, often reused result to the shared folder and read it from there."""
    spark = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint()


def spread(df: DataFrame) -> DataFrame:
    """Spread few input files over all cores; with enough files the scan stays as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if len(df.inputFiles()) < cores else df


def stored(df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
    """Write an intermediate that several steps read to the shared folder, once.

    Later readers prune their columns from the file instead of running the
    steps before it again, and a lost executor costs no more than a re-read.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)
