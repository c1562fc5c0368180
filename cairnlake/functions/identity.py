"""Deterministic ids: UUIDv5 as a column of built-in functions, and the ids of the evidence records."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column
from pyspark.sql import functions as F

# Namespaces of this library's own derived ids.
ATTEMPT_SPACE = uuid.uuid5(uuid.NAMESPACE_URL, "cairnlake:attempt")
DOCUMENT_SPACE = uuid.uuid5(uuid.NAMESPACE_URL, "cairnlake:document")
LINK_SPACE = uuid.uuid5(uuid.NAMESPACE_URL, "cairnlake:link")
OCCURRENCE_SPACE = uuid.uuid5(uuid.NAMESPACE_URL, "cairnlake:occurrence")


def uuid5(space: uuid.UUID, name: Column) -> Column:
    """The UUIDv5 of a text in a namespace; null for a null text. Equal to Python's ``uuid.uuid5``."""
    h = F.sha1(F.concat(F.unhex(F.lit(space.hex)), F.encode(name, "utf-8")))
    variant = F.lower(F.hex(F.conv(F.substring(h, 17, 2), 16, 10).cast("int").bitwiseAND(63).bitwiseOR(128)))
    return F.concat(
        F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"), F.substring(h, 14, 3), F.lit("-"),
        variant, F.substring(h, 19, 2), F.lit("-"), F.substring(h, 21, 12),
    )


def attempt_id(visit_id: Column, index: Column) -> Column:
    return uuid5(ATTEMPT_SPACE, F.concat(visit_id, F.lit(":"), index.cast("string")))


def document_id(visit_id: Column) -> Column:
    return uuid5(DOCUMENT_SPACE, visit_id)


def link_id(source: Column, target: Column) -> Column:
    """One id for each pair of addresses: the pair as canonical JSON (compact, non-ASCII kept)."""

    def text(c: Column) -> Column:
        escaped = F.regexp_replace(F.regexp_replace(c, r"\\", r"\\\\"), '"', r'\\"')
        return F.concat(F.lit('"'), escaped, F.lit('"'))

    return uuid5(LINK_SPACE, F.concat(F.lit("v1:["), text(source), F.lit(","), text(target), F.lit("]")))


def occurrence_id(document: Column, element_index: Column) -> Column:
    return uuid5(OCCURRENCE_SPACE, F.concat(F.lit("v1:"), document, F.lit(":"), element_index.cast("string")))


def canonical_json(value: object) -> str:
    """Sorted keys, compact separators, non-ASCII kept."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
