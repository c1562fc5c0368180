"""Opaque cursors of keyset pages: the sort key of the last row as JSON in base64."""

from __future__ import annotations

import base64
import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def encode(*values: str | None) -> str:
    return base64.b64encode(json.dumps(list(values), ensure_ascii=False, separators=(",", ":")).encode()).decode()


def decode(cursor: str, parts: int) -> list[str | None]:
    """The values of a cursor; ``ValueError`` for one that this module did not make."""
    try:
        values = json.loads(base64.b64decode(cursor, validate=True))
    except ValueError as e:
        raise ValueError("the cursor is broken") from e
    if not isinstance(values, list) or len(values) != parts or not all(v is None or isinstance(v, str) for v in values):
        raise ValueError("the cursor is of another query")
    return values


def cursor(*keys: Column) -> Column:
    """The cursor of each row by its sort key."""
    # Without the line breaks that Spark sets into long ones.
    return F.regexp_replace(F.base64(F.encode(F.to_json(F.array(*[k.cast("string") for k in keys])), "utf-8")), r"\s", "")


def page(df: DataFrame, keys: Sequence[str], n: int, after: str | None = None, descending: bool = True) -> DataFrame:
    """The next ``n`` rows after a cursor with the column ``cursor``, by a comparison of the whole key that reaches the scan
    and a top-n. Null keys stand at the end and are reached by no cursor."""
    rows = df.where(" AND ".join(f"`{k}` IS NOT NULL" for k in keys))
    if after is not None:
        here = F.struct(*[F.col(k) for k in keys])
        there = F.struct(*[F.lit(v).cast(df.schema[k].dataType).alias(k) for k, v in zip(keys, decode(after, len(keys)))])
        rows = rows.where(here < there if descending else here > there)
    order = [F.desc(k) if descending else F.asc(k) for k in keys]
    return rows.orderBy(*order).limit(n).withColumn("cursor", cursor(*map(F.col, keys)))
