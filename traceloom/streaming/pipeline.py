"""The same operators over streams: files as they arrive, and sessions with late events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from traceloom.operators.store import insert_if_absent


def table_stream(spark: SparkSession, path: str, schema: str, per_trigger: int = 100) -> DataFrame:
    """New Parquet files of a folder as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path)


def insert_stream(stream: DataFrame, path: str, keys: list[str], order: str, checkpoint: str):
    """Appends each micro-batch's rows whose keys the table does not hold; a replayed batch adds nothing."""

    def write(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        try:
            existing = spark.read.schema(batch.schema).parquet(path)
        except Exception:  # noqa: BLE001 - no table yet
            existing = spark.createDataFrame([], batch.schema)
        insert_if_absent(existing, batch, keys, order).write.mode("append").parquet(path)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def counts_by_hour(stream: DataFrame, time: str, by: str, lateness: str = "1 day") -> DataFrame:
    """Tumbling hourly counts with a watermark."""
    return stream.withWatermark(time, lateness).groupBy(F.window(time, "1 hour"), by).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("hour"), by, "n")
