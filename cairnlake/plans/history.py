"""The query history: executions as a frame, and the dashboard's aggregates over it."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "at timestamp, seconds double, state string, shape string"


def executions(spark: SparkSession, history: list[dict], keep_days: int = 30, now: float | None = None) -> DataFrame:
    """The executions of an engine that are not older than ``keep_days``."""
    rows = [(dt.datetime.fromtimestamp(h["at"], dt.UTC).replace(tzinfo=None), h["seconds"], h["state"], h["shape"]) for h in history]
    df = spark.createDataFrame(rows, SCHEMA)
    limit = F.current_timestamp() if now is None else F.timestamp_seconds(F.lit(now))
    return df.where(F.col("at") >= limit - F.make_dt_interval(days=F.lit(keep_days)))


def statistics(e: DataFrame) -> DataFrame:
    """One row: executions, failures, median and 95th percentile of the seconds."""
    return e.agg(
        F.count(F.lit(1)).alias("executions"), F.count_if(F.col("state") != "ok").alias("failures"),
        F.median("seconds").alias("median_s"), F.percentile("seconds", 0.95).alias("p95_s"),
    )


def trend(e: DataFrame) -> DataFrame:
    """Executions and failures by day."""
    return e.groupBy(F.to_date("at").alias("day")).agg(F.count(F.lit(1)).alias("executions"), F.count_if(F.col("state") != "ok").alias("failures"))


def patterns(e: DataFrame, n: int = 20) -> DataFrame:
    """The shapes that took most time in total."""
    per = e.groupBy("shape").agg(F.count(F.lit(1)).alias("executions"), F.sum("seconds").alias("seconds"), F.max_by("state", "at").alias("last_state"))
    return per.orderBy(F.desc("seconds"), "shape").limit(n)


def failures(e: DataFrame) -> DataFrame:
    """How often each error code came, and when last."""
    return e.where("state <> 'ok'").groupBy("state").agg(F.count(F.lit(1)).alias("n"), F.max("at").alias("last_at"))
