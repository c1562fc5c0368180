"""Exactly one copy of each message that was delivered at least once.

Identifiers are brought to one form and their frequencies are aggregated with a map-side combine. Rows of messages
delivered once pass directly, as those without a partner among the repeated identifiers; only rows of repeated groups
are ranked by arrival, and both are united. The row of rank 1 is taken by a combining aggregate of whole rows, so an
identifier with a third of all rows sends one row per task and is never sorted in one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairnlake.session import cut

#: Identifiers with this part of all repeated rows are joined apart; there are at most so many.
HOT_PARTS = 200

# White space around identifiers, the no-break kinds included.
_SPACE = r"[\s\p{Z}\u001c-\u001f\u0085﻿]*"
_HEX = "([0-9a-fA-F]{8}-?[0-9a-fA-F]{4}-?[0-9a-fA-F]{4}-?[0-9a-fA-F]{4}-?[0-9a-fA-F]{12})"
_UUID = rf"(?:[uU][rR][nN]:[uU][uU][iI][dD]:)?[{{(]?{_HEX}[)}}]?"


def trimmed(c: Column) -> Column:
    """The text without white space at its ends."""
    return F.regexp_replace(c, rf"^{_SPACE}|{_SPACE}$", "")


def canonical_uuid(c: Column) -> Column:
    """Lower case with hyphens, for plain, braced, URN and hyphenless spellings; other texts are only trimmed."""
    t = trimmed(c)
    h = F.lower(F.regexp_replace(F.regexp_extract(t, rf"^{_UUID}$", 1), "-", ""))
    dashed = F.regexp_replace(h, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")
    return F.when(h == "", t).otherwise(dashed)


def canonical_message_id(c: Column) -> Column:
    """``capture:<uuid>:<generation>``, ``observation:<uuid>`` or ``lineage:<kind of record>:<uuid>``.

    Only the spelling of the UUID, leading zeros of the generation and white space around the parts are levelled.
    A text of another form is its own identifier once trimmed; null and blank texts have none (null).
    """
    t = trimmed(c)
    # Most identifiers are written in the form that is wanted, which one match tells.
    as_wanted = c.rlike(r"^(?:capture:[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}:(?:0|[1-9][0-9]*)|(?:observation|lineage:[a-z_]+):[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12})\z")
    shape = rf"^((?:lineage{_SPACE}:[^:]*)|[^:]*?){_SPACE}:{_SPACE}{_UUID}{_SPACE}(?::{_SPACE}0*([0-9]+))?$"
    prefix, uuid, generation = (F.regexp_extract(t, shape, i) for i in (1, 2, 3))
    joined = F.concat(prefix, F.lit(":"), canonical_uuid(uuid), F.when(generation == "", "").otherwise(F.concat(F.lit(":"), generation)))
    return F.when(as_wanted, c).when(t == "", None).when(uuid == "", t).otherwise(joined)


def work_message_id(acquisition: Column, generation: Column) -> Column:
    """The message id of a unit of capture work; null where a part is missing or blank."""
    a = canonical_uuid(acquisition)
    return F.when(a != "", F.concat(F.lit("capture:"), a, F.lit(":"), generation.cast("string")))


def frequencies(df: DataFrame, message_id: Column) -> DataFrame:
    """``message_id`` and ``n``, the rows of each identifier; rows without an identifier are left out.

    The count combines before the shuffle, so an identifier with a third of all rows sends one row per task.
    """
    return df.select(message_id.alias("message_id")).where("message_id IS NOT NULL").groupBy("message_id").agg(F.count(F.lit(1)).alias("n"))


def repeated_messages(df: DataFrame, message_id: Column) -> DataFrame:
    """``message_id`` and ``n`` of the messages with more than one row."""
    return frequencies(df, message_id).where("n > 1")


def _partners(rows: DataFrame, repeated: DataFrame, how: str) -> DataFrame:
    """Semi or anti join of rows with the repeated identifiers, those with a ``HOT_PARTS``-th of all repeated rows apart.

    The hot ones (at most ``HOT_PARTS``) are broadcast; all others meet by an ordinary join, which becomes a broadcast
    where their table is small.
    """
    total = repeated.agg(F.sum("n").alias("total"))
    hot = repeated.join(F.broadcast(total), F.col("n") * HOT_PARTS >= F.col("total")).select(F.col("message_id").alias("_id"))  # one row, and so many at most
    cold = repeated.join(F.broadcast(total), F.col("n") * HOT_PARTS < F.col("total")).select(F.col("message_id").alias("_id"))
    if how == "left_anti":
        return rows.join(F.broadcast(hot), "_id", "left_anti").join(cold, "_id", "left_anti")
    return rows.join(F.broadcast(hot), "_id", "left_semi").unionByName(rows.join(cold, "_id", "left_semi"))


def deliver_once(new: DataFrame, message_id: Column, order_no: str, stored: DataFrame | None = None) -> DataFrame:
    """One row of each message of ``new`` and ``stored``, with its ``message_id`` in canonical form and ``copies``.

    ``order_no`` is the delivery number; among copies the least one stands, whatever batch the others came in, and one
    without a number after all others. Copies with the same number are told apart by a hash of the row, and rows alike
    in all columns are one. With ``stored``, earlier deliveries are counted too, so a message that was already stored
    is not taken again from a new batch. Rows without an identifier cannot be copies of anything: each stays, with
    ``copies`` 1. An existing ``message_id`` column is replaced; an existing ``copies`` column too. Empty input gives
    no rows.
    """
    allrows = new if stored is None else stored.unionByName(new, allowMissingColumns=True)
    names = [c for c in allrows.columns if c not in ("message_id", "copies")]
    rows = allrows.select(message_id.alias("_id"), *[F.col(f"`{c}`") for c in names])
    repeated = cut(frequencies(allrows, message_id).where("n > 1"))
    single = _partners(rows.where("_id IS NOT NULL"), repeated, "left_anti").unionByName(rows.where("_id IS NULL"))
    plain = [F.col(f"`{f.name}`") for f in rows.schema.fields if f.name != "_id" and "map" not in f.dataType.simpleString()]
    rank = F.struct(F.col(order_no).isNull(), F.col(order_no), F.xxhash64(*plain))
    group = _partners(rows.where("_id IS NOT NULL"), repeated, "left_semi").groupBy("_id")
    ranked = group.agg(F.min_by(F.struct(*[F.col(f"`{c}`") for c in names]), rank).alias("_row"), F.count(F.lit(1)).alias("copies"))
    columns = [F.col("_id").alias("message_id"), *[F.col(f"`{c}`") for c in names]]
    first = ranked.select("_id", *[F.col("_row").getField(c).alias(c) for c in names], "copies").select(*columns, "copies")
    return single.select(*columns, F.lit(1).cast("bigint").alias("copies")).unionByName(first)
