"""Material projections of captured HTML: elements, word postings, JSON-LD and links.

A page is parsed once; one Arrow pass returns a row per content that nests all projections, and each material table is
an ``inline`` of that row. Contents are independent, so the pass is narrow.
"""

from __future__ import annotations

import bisect
import json
import re
import unicodedata
from collections.abc import Iterator
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType, StructField, StructType

from cairnlake.functions import identity
from cairnlake.functions.urls import normalize_url, relation_scope
from cairnlake.operators.nested import read_json
from cairnlake.sources.html import HTML, Element, elements, parse

_BIT = r"[^\W_][̀-ͯ᪰-᫿⃐-⃿]*|_"
_LETTER, _DIGIT = r"[^\W\d_]", r"\d"
_TOKEN = re.compile(rf"(?:{_BIT})+(?:(?:(?<={_LETTER})[.:·’'‧](?={_LETTER})|(?<={_DIGIT})[.,;’'](?={_DIGIT}))(?:{_BIT})+)*")
_ALNUM = re.compile(r"[^\W_]")


def page_terms(text: str) -> Iterator[tuple[str, int, int]]:
    """``term, start, end``: the words of a text, case-folded in NFC, with code-point spans of the original.

    Word boundaries follow the default rules for letters, digits, joined numbers and inner apostrophes; a run of
    ideographs or kana is one word, since no dictionary is at hand.
    """
    for m in _TOKEN.finditer(text):
        if _ALNUM.search(m.group()):
            yield unicodedata.normalize("NFC", m.group().casefold()), m.start(), m.end()


def postings(found: list[Element], text: str) -> dict[str, list[int]]:
    """Term to the sorted nodes whose span holds the whole word."""
    words = list(page_terms(text))
    starts, ends = [w[1] for w in words], [w[2] for w in words]
    out: dict[str, list[int]] = {}
    for e in found:
        lo, hi = bisect.bisect_left(starts, e.text_start), bisect.bisect_right(ends, e.text_end)
        for term in {w[0] for w in words[lo:hi]}:
            out.setdefault(term, []).append(e.node_index)
    return out


def strict_json(text: str) -> bool:
    """Whether a text is JSON without the extensions Python's parser allows, at any depth."""

    def refuse(name: str) -> None:
        raise ValueError(name)

    try:
        json.loads(text, parse_constant=refuse)
        return True
    except ValueError:
        return False
    except RecursionError:
        try:
            read_json(text, strict=True)
            return True
        except ValueError:
            return False


@F.pandas_udf(BooleanType())
def is_json(text: pd.Series) -> pd.Series:
    """``strict_json`` of a column."""
    return text.map(lambda t: t is not None and strict_json(t))


def jsonld(found: list[Element], text: str) -> list[tuple[int, str | None, str | None]]:
    """``node_index, value, parse_error`` of each JSON-LD script."""
    out = []
    for e in found:
        kind = (e.attributes.get("type") or "").split(";")[0].strip(" \t\n\f\r").lower()
        if e.tag == "script" and e.namespace == HTML and kind == "application/ld+json":
            body = text[e.text_start : e.text_end]
            if not body.strip():
                out.append((e.node_index, None, "Empty JSON-LD script"))
            elif not strict_json(body):
                out.append((e.node_index, None, "Invalid JSON syntax"))
            else:
                out.append((e.node_index, body, None))
    return out


def anchors(found: list[Element]) -> tuple[str | None, list[tuple[int, str]]]:
    """The first usable base of the head, and ``node_index, href`` of the anchors with a non-blank href."""
    head = next((e for e in found if e.tag == "head" and e.namespace == HTML), None)
    base = None
    for e in found:
        if base is None and e.tag == "base" and head and head.node_index < e.node_index < head.subtree_end_index:
            href = (e.attributes.get("href") or "").strip()
            # A base of another scheme is none, and leaves the place to the next one.
            scheme = re.match(r"[a-z][a-z0-9+.-]*(?=:)", href, re.I)
            base = href if href and (not scheme or scheme.group().lower() in ("http", "https")) else None
    return base, [(e.node_index, e.attributes["href"]) for e in found if e.tag.lower() == "a" and (e.attributes.get("href") or "").strip()]


#: Characters of pages whose rows a Python worker holds at once.
HANDED = 1_000_000
NESTED = """content_sha256 string,
elements array<struct<node_index:int,parent_index:int,subtree_end_index:int,sibling_index:int,depth:int,tag:string,namespace:string,attributes:map<string,string>,text_direct:string,text:string,text_start:bigint,text_end:bigint>>,
terms array<struct<term:string,node_indexes:array<int>>>,
jsonld array<struct<node_index:int,value:string,parse_error:string>>,
base string, anchors array<struct<element_index:int,raw_href:string>>"""


def project(contents: DataFrame) -> DataFrame:
    """One nested row per content: ``content_sha256`` and all projections of its ``html`` (text or bytes).

    A null ``html`` parses as an empty page. Give distinct contents: a content shared by many visits is parsed once.
    Rows are handed over as soon as their pages have ``HANDED`` characters: their Python objects take many times that.
    """
    columns = ["content_sha256", "elements", "terms", "jsonld", "base", "anchors"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows, held = [], 0
            for key, source in zip(b.content_sha256, b.html):
                found, text = elements(parse(source if source is not None else ""))
                es = [
                    (e.node_index, e.parent_index, e.subtree_end_index, e.sibling_index, e.depth, e.tag, e.namespace, e.attributes, e.text_direct, text[e.text_start : e.text_end], e.text_start, e.text_end)
                    for e in found
                ]
                names = ("node_index", "parent_index", "subtree_end_index", "sibling_index", "depth", "tag", "namespace", "attributes", "text_direct", "text", "text_start", "text_end")
                base, links = anchors(found)
                rows.append(
                    (
                        key, [dict(zip(names, e)) for e in es], [{"term": t, "node_indexes": n} for t, n in sorted(postings(found, text).items())],
                        [dict(zip(("node_index", "value", "parse_error"), j)) for j in jsonld(found, text)], base,
                        [{"element_index": i, "raw_href": h} for i, h in links],
                    )
                )
                held += len(source or "")
                if held >= HANDED:
                    yield pd.DataFrame(rows, columns=columns)
                    rows, held = [], 0
            if rows:
                yield pd.DataFrame(rows, columns=columns)

    return contents.select("content_sha256", "html").mapInPandas(run, NESTED)


def stored_anchors(stored: DataFrame) -> DataFrame:
    """``content_sha256, base, anchors`` of stored elements, as ``project`` gives them for the page."""
    e = stored.where("lower(tag) IN ('a', 'base', 'head')")
    grouped = e.groupBy("content_sha256").agg(F.collect_list(F.struct("node_index", "subtree_end_index", "tag", "namespace", F.to_json("attributes").alias("attributes"))).alias("found"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for key, found in zip(b.content_sha256, b.found):
                es = [Element(e["node_index"], None, e["subtree_end_index"], 0, 0, e["tag"], e["namespace"], json.loads(e["attributes"]), "", 0, 0) for e in found]
                base, links = anchors(sorted(es, key=lambda e: e.node_index))
                rows.append((key, base, [{"element_index": i, "raw_href": h} for i, h in links]))
            yield pd.DataFrame(rows, columns=["content_sha256", "base", "anchors"])

    return grouped.mapInPandas(run, "content_sha256 string, base string, anchors array<struct<element_index:int,raw_href:string>>")


def html_elements(projected: DataFrame) -> DataFrame:
    return projected.select("content_sha256", F.inline("elements"))


def html_terms(projected: DataFrame) -> DataFrame:
    return projected.select("content_sha256", F.inline("terms")).select("term", "content_sha256", "node_indexes")


def html_jsonld(projected: DataFrame) -> DataFrame:
    return projected.select("content_sha256", F.inline("jsonld"))


def resolve(source: str | None, base: str | None, href: str) -> tuple[str, str] | None:
    """``target_url, relation_scope`` of an anchor, None if it is no web address."""
    page = normalize_url(source)
    if page is None:
        return None
    try:
        root = normalize_url(urljoin(page, base)) if base else None
        target = normalize_url(urljoin(root or page, href.strip()))
    except ValueError:
        return None
    return (target, relation_scope(page, target)) if target else None


@F.pandas_udf(StructType([StructField("target_url", StringType()), StructField("relation_scope", StringType())]))
def _resolved(source: pd.Series, base: pd.Series, href: pd.Series) -> pd.DataFrame:
    memo: dict[tuple, tuple] = {}
    out = []
    for key in zip(source, base, href):
        if key not in memo:
            memo[key] = resolve(*key) or (None, None)
        out.append(memo[key])
    return pd.DataFrame(out, columns=["target_url", "relation_scope"])


def link_occurrences(projected: DataFrame, visits: DataFrame, documents: DataFrame) -> DataFrame:
    """One row per document and anchor that leads to a web address.

    The page's address is the effective one, else the one asked for. Ids are derived, so a rebuild gives the same.
    """
    a = projected.select("content_sha256", "base", F.inline("anchors"))
    d = documents.where(F.lower("detected_media_type") == "text/html").select("document_id", "visit_id", "content_sha256", "observed_at")
    v = visits.select("visit_id", F.coalesce("effective_url", "requested_url").alias("source_url"))
    rows = a.join(d.join(v, "visit_id"), "content_sha256").withColumn("r", _resolved("source_url", "base", "raw_href"))
    return rows.where("r.target_url IS NOT NULL").select(
        identity.occurrence_id(F.col("document_id"), F.col("element_index")).alias("occurrence_id"),
        identity.link_id(F.col("source_url"), F.col("r.target_url")).alias("link_id"),
        "visit_id", "document_id", "content_sha256", "element_index", "observed_at", "raw_href", "source_url",
        F.col("r.target_url").alias("target_url"), F.col("r.relation_scope").alias("relation_scope"),
    )


def navigation(projected: DataFrame, content: str, source_url: str) -> DataFrame:
    """The links of one page with the parts of both addresses, for page-local SQL over ``nav.links``."""
    a = projected.where(F.col("content_sha256") == content).select("content_sha256", "base", F.inline("anchors")).withColumn("source_url", F.lit(source_url))
    rows = a.withColumn("r", _resolved("source_url", "base", "raw_href")).where("r.target_url IS NOT NULL")

    def parts(prefix: str, c: str) -> list:
        url = F.col(c)
        return [
            F.parse_url(url, F.lit(p)).alias(f"{prefix}_{n}") for p, n in (("PROTOCOL", "scheme"), ("HOST", "host"), ("PATH", "path"), ("QUERY", "query"))
        ] + [F.regexp_extract(url, r"^\w+://[^/]*:(\d+)", 1).alias(f"{prefix}_port")]

    flat = rows.select("content_sha256", "source_url", F.col("r.target_url").alias("target_url"), F.col("r.relation_scope").alias("relation_scope"), "raw_href", "element_index")
    return flat.select("*", *parts("source", "source_url"), *parts("target", "target_url"), F.regexp_extract("raw_href", "#(.*)$", 1).alias("target_fragment"))


def visit_readiness(visits: DataFrame) -> DataFrame:
    """One row for each processed visit, whether it had HTML or not."""
    return visits.select("visit_id", "finished_at").distinct()


def owners(documents: DataFrame, retired: DataFrame | None = None) -> DataFrame:
    """``content_sha256, document_id, visit_id``: each content's owner, the least document id that is not retired."""
    d = documents if retired is None else documents.join(retired.select("document_id"), "document_id", "left_anti")
    o = d.groupBy("content_sha256").agg(F.min_by(F.struct("document_id", "visit_id"), "document_id").alias("o"))
    return o.select("content_sha256", "o.document_id", "o.visit_id")
