"""The request journal as a stream: append-only JSON lines, each key taken once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import JOURNAL


def read_journal(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(JOURNAL).option("maxFilesPerTrigger", files_per_trigger).json(path)


def successes(journal: DataFrame, late: str = "1 hour") -> DataFrame:
    """The first success of each key; state older than the watermark is dropped."""
    timed = journal.where("ok").withColumn("event_time", F.timestamp_seconds("timestamp"))
    return timed.withWatermark("event_time", late).dropDuplicatesWithinWatermark(["cache_key"])


def append_to(stream: DataFrame, path: str, checkpoint: str, available_now: bool = True):
    """Append micro-batches to a memo table; a batch that runs again replaces its own folder."""

    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
