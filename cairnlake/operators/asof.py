"""As-of join: the latest row of the right side at or before each row of the left."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def asof_join(left: DataFrame, right: DataFrame, key: str, at: str, value: list[str], span: str = "1 day") -> DataFrame:
    """``left`` with the columns ``value`` of the latest row of ``right`` of the same ``key`` whose ``at`` is not later.

    Both sides are one sorted stream per key and time span, so that a key with a third of all rows is spread over as many
    tasks as it has spans. A span takes over the last row of the spans before it, which is found among one row per key
    and span. Of several right rows at one time the greatest by ``value`` counts. Rows with a null key or time have no
    partner. Columns of ``left`` keep their names; those of ``right`` other than ``value`` are not read.
    """
    bucket = F.window(F.col(at), span)["start"]
    held = F.struct(*[F.col(v).alias(v) for v in value])
    r = right.where(F.col(key).isNotNull() & F.col(at).isNotNull()).select(F.col(key).alias("_k"), F.col(at).alias("_t"), bucket.alias("_b"), held.alias("_v"))
    # One row per key and span: its last value, carried to the next span that any row of the key falls in.
    last = r.groupBy("_k", "_b").agg(F.max(F.struct("_t", "_v")).getField("_v").alias("_last"))
    l = left.where(F.col(key).isNotNull() & F.col(at).isNotNull()).withColumn("_b", bucket)
    spans = l.select(F.col(key).alias("_k"), "_b").distinct().join(last, ["_k", "_b"], "full")
    before = Window.partitionBy("_k").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    carried = spans.withColumn("_carried", F.last("_last", True).over(before)).select("_k", "_b", "_carried")
    both = l.select(F.col(key).alias("_k"), F.col(at).alias("_t"), "_b", F.lit(1).alias("_side"), F.struct(*left.columns).alias("_row"), F.lit(None).cast(r.schema["_v"].dataType).alias("_v")).unionByName(
        r.withColumn("_side", F.lit(0)).withColumn("_row", F.lit(None).cast(left.select(F.struct(*left.columns).alias("x")).schema["x"].dataType))
    )
    upto = Window.partitionBy("_k", "_b").orderBy("_t", "_side", "_v").rowsBetween(Window.unboundedPreceding, 0)
    met = both.withColumn("_here", F.last("_v", True).over(upto)).where("_side = 1").join(carried, ["_k", "_b"], "left")
    found = met.withColumn("_found", F.coalesce("_here", "_carried"))
    alone = left.where(F.col(key).isNull() | F.col(at).isNull()).select("*", *[F.lit(None).cast(right.schema[v].dataType).alias(v) for v in value])
    return found.select("_row.*", *[F.col("_found").getField(v).alias(v) for v in value]).unionByName(alone)
