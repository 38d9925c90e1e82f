"""The attempt log as a stream: each new file of events is priced once and appended."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.operators import accounting


def priced_stream(spark: SparkSession, events_folder: str, schema, prices: DataFrame) -> DataFrame:
    """A streaming frame of priced attempts; the prices are a static dimension of a few rows."""
    events = spark.readStream.schema(schema).parquet(events_folder)
    return accounting.priced(accounting.attempts_of_events(events), prices)


def drain(stream: DataFrame, out: str, checkpoint: str, once: bool = True, seconds: int = 2) -> None:
    """The worker loop: appends what has come, exactly once; `once` stops when nothing is left, else it polls until stopped."""
    writer = stream.withColumn("cost", F.col("cost").cast("double")).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
    query = (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=f"{seconds} seconds")).start()
    query.awaitTermination()
