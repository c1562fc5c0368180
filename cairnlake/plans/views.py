"""The public views over evidence and material tables, the search function and their registry.

A view is a function of the frames it reads, so the same definition serves a live table, a pinned snapshot and a test.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_SEARCH_TERMS = 32
# White space of the HTML standard.
HTML_SPACE = "[ \\t\\n\\f\\r]+"
XHTML = "http://www.w3.org/1999/xhtml"


def capture(visits: DataFrame, documents: DataFrame) -> DataFrame:
    """One row per visit with an HTML document."""
    html = documents.where(F.lower("detected_media_type") == "text/html")
    v = visits.select("visit_id", "requested_url", "effective_url", "observed_at", "finished_at", "status_code", "document_id")
    d = html.select("document_id", "visit_id", F.col("observed_at").alias("seen_at"), "content_sha256", "content_bytes", "charset")
    return v.join(d, ["document_id", "visit_id"]).select(
        F.col("visit_id").alias("capture_id"), F.col("requested_url").alias("page_url"), "effective_url", F.col("seen_at").alias("captured_at"),
        F.col("status_code").alias("http_status_code"), F.col("content_sha256").alias("content_id"), F.col("content_bytes").alias("byte_length"), F.col("charset").alias("encoding"),
    )


def html_element(elements: DataFrame) -> DataFrame:
    """The elements without their text offsets."""
    names = ("node_index", "parent_index", "subtree_end_index", "sibling_index", "depth", "tag", "namespace", "attributes", "text_direct", "text")
    return elements.select(F.col("content_sha256").alias("content_id"), *names)


def html_jsonld(jsonld: DataFrame) -> DataFrame:
    return jsonld.select(F.col("content_sha256").alias("content_id"), "node_index", "value", "parse_error")


def link(occurrences: DataFrame, captures: DataFrame) -> DataFrame:
    """The link occurrences of visits that are captures."""
    o = occurrences.select(F.col("visit_id").alias("capture_id"), F.col("element_index").alias("node_index"), "target_url", "raw_href")
    return o.join(captures.select("capture_id"), "capture_id", "left_semi")


def page(captures: DataFrame, links: DataFrame) -> DataFrame:
    """The distinct addresses that were asked for, led to or linked to."""
    urls = [captures.select(F.col("page_url").alias("url")), captures.select(F.col("effective_url").alias("url")), links.select(F.col("target_url").alias("url"))]
    return urls[0].union(urls[1]).union(urls[2]).where("url IS NOT NULL").distinct()


def html_metadata(elements: DataFrame) -> DataFrame:
    """``content_id, node_index, kind, name, value``: titles, meta tags, link relations and attributes of html.

    One scan: every element makes the array of its entries, and one ``inline`` emits them.
    """
    a: Callable[[str], Column] = lambda k: F.try_element_at("attributes", F.lit(k))
    none = F.lit(None).cast("string")

    def entry(kind: str, name: Column, value: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), name.alias("name"), value.alias("value"))

    def one(condition: Column, e: Column) -> Column:
        return F.when(condition, F.array(e)).otherwise(F.array().cast("array<struct<kind:string,name:string,value:string>>"))

    tag = F.col("tag")
    rels = F.array_distinct(F.filter(F.split(F.coalesce(a("rel"), F.lit("")), HTML_SPACE), lambda x: x != ""))
    relations = F.transform(rels, lambda x: F.struct(F.lit("link_rel").alias("kind"), x.alias("name"), a("href").alias("value")))
    attributes = F.transform(F.map_entries("attributes"), lambda e: F.struct(F.lit("html_attribute").alias("kind"), e["key"].alias("name"), e["value"].alias("value")))
    meta = tag == "meta"
    entries = F.concat(
        one(tag == "title", entry("title", none, F.col("text"))),
        one(meta & a("name").isNotNull(), entry("meta_name", a("name"), a("content"))),
        one(meta & a("property").isNotNull(), entry("meta_property", a("property"), a("content"))),
        one(meta & a("http-equiv").isNotNull(), entry("meta_http_equiv", a("http-equiv"), a("content"))),
        one(meta & a("charset").isNotNull(), entry("meta_charset", none, a("charset"))),
        F.when(tag == "link", relations).otherwise(F.array().cast("array<struct<kind:string,name:string,value:string>>")),
        F.when(tag == "html", attributes).otherwise(F.array().cast("array<struct<kind:string,name:string,value:string>>")),
    )
    xhtml = elements.where(tag.isin("title", "meta", "link", "html") & (F.col("namespace").isNull() | (F.col("namespace") == XHTML) | (F.col("namespace") == "html")))
    return xhtml.select("content_id", "node_index", F.inline(entries))


def search(terms_table: DataFrame, terms: Sequence[str | None] | None) -> DataFrame:
    """``content_id, node_indexes, score``: contents with any of the terms, scored by how many they have.

    At most 32 keys; null, empty and repeated ones add nothing. One term is an equality without regrouping; several
    are a literal ``IN`` that reaches the scan.
    """
    if terms is not None and len(terms) > MAX_SEARCH_TERMS:
        raise ValueError(f"search accepts at most {MAX_SEARCH_TERMS} term keys")
    keys = sorted({t for t in terms or () if t})
    t = terms_table.select("term", F.col("content_sha256").alias("content_id"), "node_indexes")
    if len(keys) <= 1:
        hit = t.where(F.col("term") == keys[0]) if keys else t.where(F.lit(False))
        return hit.select("content_id", "node_indexes", F.lit(1.0).alias("score"))
    return (
        t.where(F.col("term").isin(keys)).groupBy("content_id")
        .agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("node_indexes")))).alias("node_indexes"), F.count_distinct("term").cast("double").alias("score"))
    )


SEARCH_SQL = """
CREATE OR REPLACE TEMPORARY FUNCTION search(terms ARRAY<STRING>)
RETURNS TABLE(content_id STRING, node_indexes ARRAY<INT>, score DOUBLE)
RETURN SELECT content_sha256, array_sort(array_distinct(flatten(collect_list(node_indexes)))), CAST(count(DISTINCT term) AS DOUBLE)
FROM html_terms
WHERE CASE WHEN size(terms) > 32 THEN raise_error('search accepts at most 32 term keys') ELSE array_contains(terms, term) END AND term <> ''
GROUP BY content_sha256
"""


@dataclass(frozen=True)
class Helper:
    """What the catalogue says of a view or function."""

    name: str
    kind: str
    columns: tuple[str, ...]
    notes: str
    parameters: tuple[str, ...] = ()
    version: str = "1"


REGISTRY = (
    Helper("page", "view", ("url",), "distinct addresses seen, led to or linked to"),
    Helper("capture", "view", ("capture_id", "page_url", "effective_url", "captured_at", "http_status_code", "content_id", "byte_length", "encoding"), "HTML captures"),
    Helper("link", "view", ("capture_id", "node_index", "target_url", "raw_href"), "anchors of captures"),
    Helper("html_element", "view", ("content_id", "node_index", "parent_index", "subtree_end_index", "sibling_index", "depth", "tag", "namespace", "attributes", "text_direct", "text"), "elements in preorder"),
    Helper("html_metadata", "view", ("content_id", "node_index", "kind", "name", "value"), "titles, meta tags, relations"),
    Helper("html_jsonld", "view", ("content_id", "node_index", "value", "parse_error"), "embedded JSON-LD"),
    Helper("search", "table_macro", ("content_id", "node_indexes", "score"), "any-word search", ("terms",)),
)
NAMESPACES = ("public_v1", "experimental")


def install(spark: SparkSession, visits: DataFrame, documents: DataFrame, elements: DataFrame, jsonld: DataFrame, terms: DataFrame, occurrences: DataFrame) -> None:
    """Registers the six views of both namespaces and the search function, and checks their columns."""
    captures = capture(visits, documents)
    links = link(occurrences, captures)
    views = {
        "capture": captures, "link": links, "page": page(captures, links), "html_element": html_element(elements),
        "html_jsonld": html_jsonld(jsonld), "html_metadata": html_metadata(html_element(elements)),
    }
    for h in REGISTRY:
        if h.kind == "view":
            if tuple(views[h.name].columns) != h.columns:
                raise ValueError(f"view {h.name} has columns {views[h.name].columns}")
            views[h.name].createOrReplaceTempView(h.name)
            views[h.name].createOrReplaceTempView(f"experimental_{h.name}")
    terms.createOrReplaceTempView("html_terms")
    spark.sql(SEARCH_SQL)
