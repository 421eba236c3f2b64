"""Failure and repair counts of a prediction log that is still being written."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.operators.runs import failure_counts

SCHEMA = "tag string, question_id long, execution_error string, attempts int"


def follow(spark: SparkSession, log: str, counts: str, checkpoint: str) -> None:
    """Fold new files of `log` (one JSON prediction per line) into running counts per run.

    Processes what is there and stops; call again, or run it on a schedule. Each
    batch writes the changed counts under its own number, so that a batch that
    is repeated after a failure replaces itself.
    """
    stream = failure_counts(spark.readStream.schema(SCHEMA).json(log))

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{counts}/batch={number}")

    query = (
        stream.writeStream.outputMode("update")
        .option("checkpointLocation", checkpoint)
        .foreachBatch(put)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def current(spark: SparkSession, counts: str) -> DataFrame:
    """The latest counts per run."""
    newest = W.partitionBy("tag").orderBy(F.desc("batch"))
    stored = spark.read.parquet(counts)
    return stored.withColumn("_nth", F.row_number().over(newest)).filter("_nth = 1").drop("_nth", "batch")
