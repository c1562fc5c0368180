"""A delivery queue over a table: what can be processed, and what goes aside as dead letters until it is requeued."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def sorted_out(deliveries: DataFrame, message_id: Column, payload: Column, required: Column, most_deliveries: int) -> DataFrame:
    """The deliveries with ``message_id`` and ``reason``, null for those that can be processed.

    ``required`` is a JSON path by kind of message that the payload must hold. A message that came more than
    ``most_deliveries`` times is dead whatever it holds: it was claimed and not acknowledged each time. The count is a
    combining aggregate that meets the table by an ordinary join; a message with very many rows is split by AQE.
    """
    rows = deliveries.withColumn("message_id", message_id).withColumn("_doc", F.try_parse_json(payload))
    many = rows.where("message_id IS NOT NULL").groupBy("message_id").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > most_deliveries).select("message_id", F.lit(True).alias("_many"))
    reason = (
        F.when(F.col("message_id").isNull(), "no identifier").when(F.col("_doc").isNull(), "bad payload")
        .when(F.call_function("get_json_object", payload, required).isNull(), "missing field").when(F.col("_many"), "too many deliveries")
    )
    return rows.join(many, "message_id", "left").withColumn("reason", reason).drop("_doc", "_many")


def requeued(dead: DataFrame, repaired: DataFrame, key: str) -> DataFrame:
    """Dead letters that were repaired, with the repaired columns in place of their own and no reason."""
    new = [c for c in repaired.columns if c != key]
    rows = dead.drop(*new).join(repaired, key)
    return rows.select(*[F.lit(None).cast("string").alias(c) if c == "reason" else F.col(c) for c in dead.columns])


def claims(deliveries: DataFrame, partition: str, order: list[str], n: int) -> DataFrame:
    """The next ``n`` deliveries of each partition in order. Spark limits each group before the shuffle, so that a
    partition with most of the rows sends ``n`` a task."""
    place = F.row_number().over(Window.partitionBy(partition).orderBy(*order))
    return deliveries.withColumn("place", place).where(F.col("place") <= n)
