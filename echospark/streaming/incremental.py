"""Incremental runs: new files of a table are processed once, with a checkpoint, and appended."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def run_new_files(spark: SparkSession, source: str, schema, job: Callable[[DataFrame], DataFrame], sink: str, checkpoint: str, partition_by: str | None = None) -> None:
    """Applies `job` to the Parquet files of `source` that no earlier run has seen and appends its result to `sink`.

    Each micro-batch is written under its batch id; a batch that is repeated after a failure
    overwrites its own folder, so rows are stored exactly once.
    """

    def store(batch: DataFrame, batch_id: int) -> None:
        writer = job(batch).write.mode("overwrite")
        if partition_by:
            writer = writer.partitionBy(partition_by)
        writer.parquet(f"{sink}/batch={batch_id}")

    stream = spark.readStream.schema(schema).parquet(source).writeStream
    stream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(store).start().awaitTermination()
