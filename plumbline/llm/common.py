"""Small helpers shared by the corpus operators."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.session import scratch_path

_SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)


def id_hash(doc_id: Column) -> Column:
    """crc32 of the id as text, as the held-out rules define it."""
    return F.crc32(doc_id.cast("string").cast("binary"))


def without(df: DataFrame, *names: str) -> DataFrame:
    """Drop columns that would clash with result columns, whatever their case."""
    taken = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in taken])


def small_side(df: DataFrame, max_rows: int) -> DataFrame:
    """Mark a side for broadcast if its counted rows stay below the bound; else leave it to a shuffle."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def kept(df: DataFrame, name: str) -> DataFrame:
    """Write an intermediate to the shared folder and read it from there.

    The shuffle files of the write go as soon as it has ended; nothing reads them again.
    """
    spark = df.sparkSession
    path, before = scratch_path(spark, name), spark.conf.get(_SHUFFLE_CLEANUP, None)
    spark.conf.set(_SHUFFLE_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(_SHUFFLE_CLEANUP)
        else:
            spark.conf.set(_SHUFFLE_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def discard(*written: DataFrame) -> None:
    """Delete what `kept` wrote, once everything that follows from it has been written as well."""
    for df in written:
        spark = df.sparkSession
        for folder in {name.rsplit("/", 1)[0] for name in df.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)
