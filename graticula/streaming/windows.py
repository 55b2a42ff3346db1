"""The same statistics over streams: event-time windows with a watermark, and a batch form with equal results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graticula.sources.tables import table


def windowed(events: DataFrame, width: str = "1 hour", late: str = "10 minutes", ts: str = "ts", by: str = "event_type", value: str = "value") -> DataFrame:
    """count, sum, min, max by window and kind; on a stream, rows more than `late` behind the newest are dropped and windows close."""
    if events.isStreaming:
        events = events.withWatermark(ts, late)
    g = events.groupBy(F.window(ts, width).alias("w"), by)
    out = g.agg(F.count(value).alias("n"), F.sum(value).alias("total"), F.min(value).alias("low"), F.max(value).alias("high"))
    return out.select(F.col("w.start").alias("start"), by, "n", "total", "low", "high")


def read_stream(spark: SparkSession, folder: str, schema) -> DataFrame:
    return spark.readStream.schema(schema).parquet(folder)


def _events(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "events", "ts", "event_type", "value").withColumn("ts", F.col("ts").cast("timestamp"))


QUERIES = {
    "st_windowed_statistics": lambda s, d: windowed(_events(s, d)).select(F.unix_timestamp("start").alias("start"), "event_type", "n", F.round("total", 4).alias("total"), "low", "high"),
}
ORACLES = {
    "st_windowed_statistics": "SELECT (floor(epoch(ts) / 3600) * 3600)::BIGINT AS start, event_type, count(value) AS n, round(sum(value), 4) AS total, min(value) AS low, max(value) AS high FROM events GROUP BY 1, 2",
}
