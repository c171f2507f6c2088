"""Structured Streaming: panels from event streams, and features that follow new dates."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def event_panel(events: DataFrame, every: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(date, asset, value): mean value of each event type in tumbling windows; a window closes once the watermark passes it."""
    ts = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    out = ts.groupBy(F.window("ts", every), F.col("event_type").alias("asset")).agg(F.avg("value").alias("value"))
    return out.select(F.col("window.start").alias("date"), "asset", "value")


def follow(panel: DataFrame, store: str, features: str, make: Callable[[DataFrame], DataFrame], lookback: int, checkpoint: str) -> StreamingQuery:
    """Appends new panel rows to ``store``, and for each batch makes features of the last ``lookback`` dates before its first new date
    and the new ones, and writes those of the new dates. A batch that is repeated writes its own folder again."""

    def batch(rows: DataFrame, number: int) -> None:
        if rows.isEmpty():
            return
        spark = rows.sparkSession
        rows.write.mode("overwrite").parquet(f"{store}/batch={number}")
        first = rows.agg(F.min("date")).first()[0]
        every = spark.read.parquet(store).where(F.col("batch") <= number).drop("batch")
        dates = every.where(F.col("date") < F.lit(first)).select("date").distinct().orderBy(F.col("date").desc()).limit(lookback)
        start = dates.agg(F.min("date")).first()[0]
        recent = every if start is None else every.where(F.col("date") >= F.lit(start))
        make(recent).where(F.col("date") >= F.lit(first)).write.mode("overwrite").parquet(f"{features}/batch={number}")

    return panel.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).outputMode("append").start()
