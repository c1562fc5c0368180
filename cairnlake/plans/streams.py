"""Streaming queries over the event table, drained and compared with batch SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnlake.sources.tables import table
from cairnlake.streaming.live import drained


def _events(spark: SparkSession, sf: str) -> DataFrame:
    schema = table(spark, sf, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)


def stream_windows(spark: SparkSession, sf: str) -> DataFrame:
    """Hourly counts and sums per kind of event."""
    e = _events(spark, sf).withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", "1 hour")
    out = e.groupBy(F.window("at", "1 hour"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total"))
    return drained(out, "complete").select(F.col("window.start").cast("timestamp_ntz").alias("hour"), "event_type", "n", "total")


def stream_sliding(spark: SparkSession, sf: str) -> DataFrame:
    """Counts in windows of two hours that begin every hour."""
    e = _events(spark, sf).withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", "1 hour")
    out = e.groupBy(F.window("at", "2 hours", "1 hour")).agg(F.count(F.lit(1)).alias("n"))
    return drained(out, "complete").select(F.col("window.start").cast("timestamp_ntz").alias("start"), "n")


def stream_users(spark: SparkSession, sf: str) -> DataFrame:
    """Running totals per user."""
    out = _events(spark, sf).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.max("event_id").alias("last_event"))
    return drained(out, "complete")


def stream_filtered(spark: SparkSession, sf: str) -> DataFrame:
    """A stateless pass: the events above a value."""
    return drained(_events(spark, sf).where("value > 75").select("event_id", "user_id", "event_type"))


QUERIES = {f.__name__: f for f in (stream_windows, stream_sliding, stream_users, stream_filtered)}
ORACLES = {
    "stream_windows": "SELECT date_trunc('hour', ts)::TIMESTAMP AS hour, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2",
    "stream_sliding": "SELECT date_trunc('hour', ts)::TIMESTAMP - o * INTERVAL '1 hour' AS start, count(*) AS n FROM events, (VALUES (0), (1)) t(o) GROUP BY 1",
    "stream_users": "SELECT user_id, count(*) AS n, max(event_id) AS last_event FROM events GROUP BY user_id",
    "stream_filtered": "SELECT event_id, user_id, event_type FROM events WHERE value > 75",
}
