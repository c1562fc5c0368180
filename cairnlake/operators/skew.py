"""Per-key results when a few keys hold most of the rows.

Heavy hitters are found by a frequent-items sketch that is combined map-side, verified by an exact count of the
candidates, and then processed apart: the heavy keys meet their (at most ``1 / share``) dimension rows by a broadcast
join (``join_by_key``) or are aggregated per key and salt (``aggregate_by_key``), all other keys go through one ordinary
shuffle, and the two are united.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairnlake.session import cut

#: Counters of the sketch per requested heavy key. The sketch's count error is below 4 rows in each
#: ``SKETCH_FACTOR / share`` rows, so that no key at or above the share can be missing among the first candidates.
SKETCH_FACTOR = 256
#: Salts over which the rows of each heavy key are spread.
SALTS = 64


def heavy_candidates(df: DataFrame, key: str, share: float) -> DataFrame:
    """Keys that may hold ``share`` of the rows with a key: one column ``key``, at most ``4 / share`` rows.

    The frequent-items sketch undercounts by less than ``share / 64`` of the rows, so every key at or above the
    share is among them; keys below it may be too.
    """
    k = math.ceil(4 / share)
    tracked = min(1_000_000, math.ceil(SKETCH_FACTOR / share))
    top = df.where(F.col(key).isNotNull()).agg(F.expr(f"approx_top_k(`{key}`, {k}, {max(tracked, k)})").alias("t"))
    return top.select(F.explode("t").alias("t")).select(F.col("t.item").alias("key")).where("key IS NOT NULL").distinct()


def heavy_keys(df: DataFrame, key: str, share: float) -> DataFrame:
    """Exactly the keys that hold at least ``share`` of the rows with a key.

    Returns ``key`` and ``n`` (rows of the key). Rows whose key is null count neither in ``n`` nor in the total.
    Repeated rows count each time. An empty table, or one of null keys only, has no heavy keys.
    The result has at most ``1 / share`` rows, the bound on which the broadcast joins of this module rest.
    """
    keyed = df.where(F.col(key).isNotNull()).select(F.col(key).alias("key"))
    cand = heavy_candidates(df, key, share).select(F.col("key").alias("cand"))
    # One pass over the key column counts the candidates and, under the null candidate, everything else.
    counted = (
        keyed.join(F.broadcast(cand), F.col("key") == F.col("cand"), "left")
        .groupBy("cand")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    # One window over at most 4 / share + 1 rows.
    total = F.sum("n").over(Window.partitionBy())
    return (
        counted.withColumn("total", total)
        .where(F.col("cand").isNotNull() & (F.col("n") >= F.col("total") * F.lit(share)))
        .select(F.col("cand").alias("key"), "n")
    )


def aggregate_by_key(
    df: DataFrame,
    key: str,
    sums: dict[str, Column],
    maxima: dict[str, Column] | None = None,
    minima: dict[str, Column] | None = None,
    distinct: dict[str, Column] | None = None,
    share: float = 1 / 40,
) -> DataFrame:
    """Sums, extremes and distinct counts for every key, with the heavy keys spread over salts.

    ``sums``, ``maxima``, ``minima`` and ``distinct`` map an output name to an expression over ``df``. Null values
    are passed over, a sum without any value is null and a distinct count without any value is 0. Rows whose key is
    null form a group of their own with ``key_value`` null (they are spread like a heavy key). The column
    ``is_heavy`` names the keys at or above ``share``. An empty table gives no rows. Columns of ``df`` outside the
    expressions are neither read nor returned, so clashing names do no harm.
    """
    maxima, minima, distinct = maxima or {}, minima or {}, distinct or {}
    parts = {f"_s_{n}": e for n, e in sums.items()} | {f"_x_{n}": e for n, e in maxima.items()}
    parts |= {f"_i_{n}": e for n, e in minima.items()} | {f"_d_{n}": e for n, e in distinct.items()}
    slim = df.select(F.col(key).alias("_key"), *[e.alias(n) for n, e in parts.items()])
    heavy = heavy_keys(df, key, share).select(F.col("key").alias("_heavy"))
    marked = slim.join(F.broadcast(heavy), F.col("_key") == F.col("_heavy"), "left")
    is_hot = F.col("_heavy").isNotNull() | F.col("_key").isNull()

    def first(extra: Sequence[Column]) -> list[Column]:
        out = [F.sum(f"_s_{n}").alias(f"_s_{n}") for n in sums] + [F.max(f"_x_{n}").alias(f"_x_{n}") for n in maxima]
        return out + [F.min(f"_i_{n}").alias(f"_i_{n}") for n in minima] + list(extra)

    def last(d: DataFrame, flag: bool) -> DataFrame:
        return d.select(
            F.col("_key").alias("key_value"),
            (F.col("_key").isNotNull() & F.lit(flag)).alias("is_heavy"),
            *[F.col(f"_s_{n}").alias(n) for n in sums],
            *[F.col(f"_x_{n}").alias(n) for n in maxima],
            *[F.col(f"_i_{n}").alias(n) for n in minima],
            *[F.col(f"_d_{n}").alias(n) for n in distinct],
        )

    cold = marked.where(~is_hot).groupBy("_key").agg(*first([F.countDistinct(f"_d_{n}").alias(f"_d_{n}") for n in distinct]))
    hot_rows = marked.where(is_hot)
    # Salted by the value counted: each distinct value falls under one salt, so the counts of the salts add up. Without
    # one, rows stay with the salt of the part of the table they were read from.
    salt = F.pmod(F.xxhash64(*[f"_d_{n}" for n in distinct]) if distinct else F.spark_partition_id(), F.lit(SALTS))
    if len(distinct) > 1:
        raise ValueError("one distinct count at a time: each needs a salt of its own")
    spread = (
        hot_rows.withColumn("_salt", salt)
        .groupBy("_key", "_salt")
        .agg(*first([F.countDistinct(f"_d_{n}").alias(f"_d_{n}") for n in distinct]))
    )
    hot = spread.groupBy("_key").agg(*first([F.sum(f"_d_{n}").alias(f"_d_{n}") for n in distinct]))
    return last(cold, False).unionByName(last(hot, True))


def join_by_key(facts: DataFrame, key: str, dimension: DataFrame, dimension_key: str, share: float = 1 / 40) -> DataFrame:
    """``facts`` left-joined to a dimension with one row per key at most, heavy keys apart.

    The dimension rows of the heavy keys (at most ``1 / share``) are broadcast to the fact rows of those keys, which
    therefore stay where they are; all other rows meet the dimension by an ordinary join, and both are united. Rows whose
    key is null have no partner and pass directly. A dimension that holds a key twice would repeat fact rows, as any join
    does. Columns of the dimension beside its key are added; of names that both have, the facts' column stays.
    """
    heavy = cut(heavy_keys(facts, key, share).select(F.col("key").alias("_heavy")))
    added = [c for c in dimension.columns if c != dimension_key and c not in facts.columns]
    d = dimension.select(F.col(dimension_key).alias("_dim"), *added)
    hot_rows = d.join(F.broadcast(heavy), F.col("_dim") == F.col("_heavy"), "left_semi")
    of_heavy = F.col(key) == F.col("_heavy")
    hot = facts.join(F.broadcast(heavy), of_heavy, "left_semi").join(F.broadcast(hot_rows), F.col(key) == F.col("_dim"), "left")
    cold = facts.where(F.col(key).isNotNull()).join(F.broadcast(heavy), of_heavy, "left_anti").join(d, F.col(key) == F.col("_dim"), "left")
    none = facts.where(F.col(key).isNull()).select("*", *[F.lit(None).cast(d.schema[c].dataType).alias(c) for c in added])
    return hot.drop("_dim").unionByName(cold.drop("_dim")).unionByName(none)
