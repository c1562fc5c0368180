"""Optional rewrites of analysed queries: exact text through the word index."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnlake.operators.projections import page_terms
from cairnlake.plans.engine import PassDecision

NAME = "exact_text_candidates"
MAX_CONTENTS, MAX_NODES_PER_CONTENT, MAX_NODES = 128, 1_024, 16_384
_TEXT = re.compile(r"\btext\s*=\s*'((?:[^']|'')*)'", re.I)
_OTHER = re.compile(r"\b(JOIN|WITH|UNION|INTERSECT|EXCEPT|OVER|COLLATE|LIMIT|GROUP|HAVING|DISTINCT|OR|NOT|content_id)\b|\(\s*SELECT\b|[?$]", re.I)
_INTERIOR = re.compile(r"(?<= )[A-Za-z]{3,}(?= )")


def literal_word(value: str) -> str | None:
    """The longest plain word inside a text that spaces bound on both sides; such a word is a token wherever it stands."""
    found = _INTERIOR.findall(value)
    return max(found, key=len).lower() if found else None


def exact_text(spark: SparkSession, sql: str, df: DataFrame) -> PassDecision:
    """Narrows ``SELECT ... FROM html_element WHERE text = '...'`` to the nodes the index has for one of its words.

    The original equality stays, so a stale or wide candidate set cannot change the result. Shapes other than one
    direct filter of html_element are not applicable; too many candidates exceed the budget.
    """
    m = _TEXT.search(sql)
    tail = re.split(r"\bWHERE\b", sql, maxsplit=1, flags=re.I)
    if not m or len(tail) != 2 or not re.search(r"\bFROM\s+(?:public_v1\s*\.\s*)?html_element\s*$", tail[0].strip(), re.I) or _OTHER.search(tail[1].replace(m.group(0), "")):
        return PassDecision(NAME, "not_applicable", "shape")
    word = literal_word(m.group(1).replace("''", "'"))
    if word is None:
        return PassDecision(NAME, "not_applicable", "no_interior_word")
    if [t for t, _, _ in page_terms(word)] != [word]:
        return PassDecision(NAME, "not_applicable", "no_single_term")
    if not spark.catalog.tableExists("html_terms"):
        return PassDecision(NAME, "contract_mismatch", "no_index")
    hits = spark.table("html_terms").where(F.col("term") == word).select("content_sha256", "node_indexes").limit(MAX_CONTENTS + 1).collect()
    if len(hits) > MAX_CONTENTS:
        return PassDecision(NAME, "budget_exceeded", "contents")
    if any(len(h.node_indexes) > MAX_NODES_PER_CONTENT for h in hits) or sum(len(h.node_indexes) for h in hits) > MAX_NODES:
        return PassDecision(NAME, "budget_exceeded", "nodes")
    rows = [(h.content_sha256, i) for h in hits for i in h.node_indexes]
    schema = "content_id string, node_index int"
    keys = spark.createDataFrame(rows, schema)
    narrow = spark.table("html_element").where(F.col("content_id").isin(sorted({r[0] for r in rows})) if rows else F.lit(False))
    narrow.join(F.broadcast(keys), ["content_id", "node_index"], "left_semi").createOrReplaceTempView("html_element_candidates")
    from cairnlake.plans.dialect import translate

    text = translate(re.sub(r"(\bFROM\s+)(?:public_v1\s*\.\s*)?html_element\b", r"\1html_element_candidates", sql, count=1, flags=re.I))
    return PassDecision(NAME, "applied", "index", spark.sql(text))
