"""Projections and the lake over whole tables: the documents dressed as captured pages, and the stored elements.

Each document becomes a page of one form, its text escaped, so that SQL can say which rows every projection must give.
"""

from __future__ import annotations

import uuid
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnlake.operators import evidence, projections
from cairnlake.plans import views
from cairnlake.session import ensure_checkpoint_dir, written
from cairnlake.sources.lake import Lake, validations
from cairnlake.sources.tables import table
from cairnlake.streaming.live import follow, rebuild

# The day that parts the first delivery from the second, the time at which policies are judged, and the source that is purged.
FIRST_UNTIL, JUDGED_AT, PURGED = "2015-01-15 00:00:00", "2015-02-15 00:00:00", "query-walkthroughs"


def _escaped(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit('"'), F.lit("&quot;"))


def pages(spark: SparkSession, sf: str) -> DataFrame:
    """The documents with the ``html`` of their page and its hash; a document without text has no page."""
    d = table(spark, sf, "documents")
    html = F.concat(
        F.lit('<!DOCTYPE html><html lang="'), _escaped(F.coalesce("lang", F.lit(""))), F.lit('"><head><title> '), _escaped(F.coalesce("source", F.lit("none"))), F.lit(" </title></head><body><p> § "),
        _escaped(F.col("text")), F.lit(' </p><p><a href="/next#top">next</a> <a href="mailto:a@b.example">mail</a> <a href="'), _escaped(F.coalesce("url", F.lit(""))),
        F.lit('">self</a> </p><script type="application/ld+json">{"@type":"Document"}</script></body></html>'),
    )
    return d.withColumn("html", html).withColumn("content_sha256", F.sha2("html", 256))


def visits(p: DataFrame) -> DataFrame:
    at = F.col("observed_at").cast("timestamp")
    return p.select(
        F.concat(F.lit("v"), "doc_id").alias("visit_id"), F.coalesce("url", F.lit("https://none.example/")).alias("requested_url"), F.lit(None).cast("string").alias("effective_url"),
        at.alias("admitted_at"), at.alias("started_at"), at.alias("observed_at"), at.alias("finished_at"), F.when(F.col("text").isNull(), "failed").otherwise("succeeded").alias("outcome"),
        F.lit(200).alias("status_code"), F.when(F.col("text").isNotNull(), F.concat(F.lit("d"), "doc_id")).alias("document_id"),
        F.when(F.col("source").isNotNull(), '{"retention_days": 30}').alias("capture_policy"),
    )


def documents(p: DataFrame) -> DataFrame:
    """The evidence of the pages; those without a source were no HTML."""
    size = F.octet_length("html").cast("bigint")
    return p.where("text IS NOT NULL").select(
        F.concat(F.lit("d"), "doc_id").alias("document_id"), F.concat(F.lit("v"), "doc_id").alias("visit_id"), F.lit(None).cast("string").alias("attempt_id"),
        F.col("observed_at").cast("timestamp").alias("observed_at"), F.lit("rendered_html").alias("representation"), F.lit(None).cast("string").alias("declared_media_type"),
        F.when(F.col("source").isNull(), "application/pdf").when(F.col("doc_id") % 2 == 0, "TEXT/HTML").otherwise("text/html").alias("detected_media_type"), F.lit("utf-8").alias("charset"),
        "content_sha256", size.alias("content_bytes"), F.concat(F.lit("o/"), "content_sha256").alias("object_key"), F.lit("identity").alias("storage_encoding"), size.alias("stored_bytes"),
    )


def contents(p: DataFrame) -> DataFrame:
    return p.where("text IS NOT NULL").select("content_sha256", "html").dropDuplicates(["content_sha256"])


def _projected(spark: SparkSession, sf: str) -> DataFrame:
    return written(projections.project(contents(pages(spark, sf))), "projected")


_ELEMENT = ("content_sha256", "node_index", "parent_index", "subtree_end_index", "sibling_index", "depth", "tag", "text_direct", "text", "text_start", "text_end")


def proj_elements(spark: SparkSession, sf: str) -> DataFrame:
    e = projections.html_elements(_projected(spark, sf))
    return e.select(*_ELEMENT, *[F.try_element_at("attributes", F.lit(a)).alias(a) for a in ("lang", "href", "type")])


def proj_terms(spark: SparkSession, sf: str) -> DataFrame:
    return projections.html_terms(_projected(spark, sf))


def proj_jsonld(spark: SparkSession, sf: str) -> DataFrame:
    return projections.html_jsonld(_projected(spark, sf))


def proj_links(spark: SparkSession, sf: str) -> DataFrame:
    p = pages(spark, sf)
    links = projections.link_occurrences(_projected(spark, sf), visits(p), documents(p))
    return links.select("visit_id", "document_id", "content_sha256", "element_index", "raw_href", "source_url", "target_url", "relation_scope")


def proj_readiness(spark: SparkSession, sf: str) -> DataFrame:
    v = visits(pages(spark, sf))
    return projections.visit_readiness(v).select("visit_id", F.col("finished_at").cast("timestamp_ntz").alias("finished_at"))


def proj_owners(spark: SparkSession, sf: str) -> DataFrame:
    """The owner of each content, first with all documents, then after those of one source are retired."""
    p = pages(spark, sf)
    all_of, less = projections.owners(documents(p)), projections.owners(documents(p), documents(p.where(F.col("source") == PURGED)))
    return all_of.withColumn("retired", F.lit(False)).unionByName(less.withColumn("retired", F.lit(True)))


def proj_stored_links(spark: SparkSession, sf: str) -> DataFrame:
    """The links of the stored anchors, resolved against the address each content was captured at, in its secure form."""
    e = table(spark, sf, "html_element").where("tag IN ('a', 'base')").select("content_id", "node_index", "tag", F.try_element_at("attributes", F.lit("href")).alias("raw_href")).distinct()
    base = e.where("tag = 'base'").groupBy("content_id").agg(F.min_by("raw_href", "node_index").alias("base"))
    c = table(spark, sf, "capture").select("capture_id", "content_id", F.regexp_replace("page_url", "^http:", "https:").alias("source_url")).distinct()
    rows = e.where("tag = 'a' AND trim(raw_href) <> ''").join(base, "content_id", "left").join(c, "content_id")
    rows = rows.withColumn("r", projections._resolved("source_url", "base", "raw_href")).where("r.target_url IS NOT NULL")
    return rows.select("capture_id", "node_index", F.col("r.target_url").alias("target_url"), "raw_href").distinct()


def proj_stored_jsonld(spark: SparkSession, sf: str) -> DataFrame:
    """The JSON-LD of the stored script elements."""
    e = table(spark, sf, "html_element").where("tag = 'script'").select("content_id", "node_index", "attributes", "text")
    kind = F.lower(F.trim(F.split_part(F.try_element_at("attributes", F.lit("type")), F.lit(";"), F.lit(1))))
    rows = e.where(kind == "application/ld+json").select("content_id", "node_index", "text").distinct()
    error = F.when(~F.col("text").rlike(r"\S"), "Empty JSON-LD script").when(~projections.is_json("text"), "Invalid JSON syntax")
    return rows.select("content_id", "node_index", F.when(error.isNull(), F.col("text")).alias("value"), error.alias("parse_error"))


def view_capture(spark: SparkSession, sf: str) -> DataFrame:
    p = pages(spark, sf)
    return views.capture(visits(p), documents(p)).withColumn("captured_at", F.col("captured_at").cast("timestamp_ntz"))


def view_html_element(spark: SparkSession, sf: str) -> DataFrame:
    e = views.html_element(projections.html_elements(_projected(spark, sf)))
    return e.where("tag IN ('p', 'title')").select("content_id", "node_index", "tag", "text")


def view_html_jsonld(spark: SparkSession, sf: str) -> DataFrame:
    return views.html_jsonld(projections.html_jsonld(_projected(spark, sf)))


def view_link(spark: SparkSession, sf: str) -> DataFrame:
    p = pages(spark, sf)
    v, d = visits(p), documents(p)
    return views.link(projections.link_occurrences(_projected(spark, sf), v, d), views.capture(v, d))


def search_one(spark: SparkSession, sf: str) -> DataFrame:
    """Search by one term: an equality over the postings."""
    return views.search(projections.html_terms(_projected(spark, sf)), ("garden",))


def search_many(spark: SparkSession, sf: str) -> DataFrame:
    return views.search(projections.html_terms(_projected(spark, sf)), ("garden", "hafen", "für", "où", None, ""))


# -- the lake ---------------------------------------------------------------------------------------------------------
@lru_cache(maxsize=4)
def _lake(application: str, sf: str) -> Lake:
    """A lake with five snapshots: the first delivery (1), everything (2), the projections (3), one table compacted (4),
    one source purged (5). Deliveries are repeated in between, which changes nothing."""
    spark = SparkSession.getActiveSession()
    lake = Lake(spark, f"{ensure_checkpoint_dir(spark).rstrip('/')}/lake-{uuid.uuid4().hex}")
    p = pages(spark, sf)
    v, d = written(visits(p), "visits"), written(documents(p), "documents")
    first = v.where(F.col("finished_at") < F.lit(FIRST_UNTIL).cast("timestamp"))
    lake.append({"visits": first}, receipt="first", message="first delivery")
    lake.append({"visits": first.unionByName(first)}, receipt="first")
    lake.append({"visits": first.unionByName(first)})
    lake.append({"visits": v, "documents": d}, message="all")
    rebuild(lake, contents(p))
    lake.compact("html_terms")
    lake.purge(visits(p.where(F.col("source") == PURGED)))
    return lake


def lake(spark: SparkSession, sf: str) -> Lake:
    return _lake(spark.sparkContext.applicationId, sf)


def _plain_visits(df: DataFrame) -> DataFrame:
    return df.select("visit_id", "requested_url", "outcome", F.col("finished_at").cast("timestamp_ntz").alias("finished_at"))


def lake_visits(spark: SparkSession, sf: str) -> DataFrame:
    """All visits, each once however often it was delivered."""
    return _plain_visits(lake(spark, sf).read("visits", 2))


def lake_time_travel(spark: SparkSession, sf: str) -> DataFrame:
    return _plain_visits(lake(spark, sf).read("visits", 1))


def lake_changes(spark: SparkSession, sf: str) -> DataFrame:
    return _plain_visits(lake(spark, sf).changes("visits", 1, 2))


def lake_snapshots(spark: SparkSession, sf: str) -> DataFrame:
    return lake(spark, sf).snapshots().groupBy("version", "message").agg(F.count(F.lit(1)).alias("tables"))


def lake_inventory(spark: SparkSession, sf: str) -> DataFrame:
    return lake(spark, sf).inventory().select("table_name", (F.col("files") > 0).alias("has_files"), (F.col("bytes") > 0).alias("has_bytes"))


def lake_elements(spark: SparkSession, sf: str) -> DataFrame:
    """The elements of the rebuilt generation."""
    return lake(spark, sf).read("html_elements", 3).select("content_sha256", "node_index", "tag", "text")


def lake_compacted(spark: SparkSession, sf: str) -> DataFrame:
    """How the terms differ before and after their files were rewritten: not at all."""
    a, b = (lake(spark, sf).read("html_terms", n).withColumn("at", F.array("node_indexes")).select("term", "content_sha256", F.hash("node_indexes").alias("h")) for n in (3, 4))
    rows = a.withColumn("w", F.lit(1)).unionByName(b.withColumn("w", F.lit(-1))).groupBy("term", "content_sha256", "h").agg(F.sum("w").alias("w"))
    return rows.agg(F.count_if(F.col("w") != 0).alias("different"))


def lake_purged(spark: SparkSession, sf: str) -> DataFrame:
    """After the purge: visits, and the contents that some document still has."""
    now = lake(spark, sf)
    a = now.read("visits", 5).select(F.lit("visits").alias("table_name"), F.col("visit_id").alias("id"))
    return a.unionByName(now.read("html_elements", 5).select(F.lit("html_elements").alias("table_name"), F.col("content_sha256").alias("id")).distinct())


def lake_retention(spark: SparkSession, sf: str) -> DataFrame:
    return lake(spark, sf).retention_plan(JUDGED_AT)


def lake_validations(spark: SparkSession, sf: str) -> DataFrame:
    return spark.createDataFrame(sorted(validations(lake(spark, sf)).items()), "check string, broken bigint")


def lake_problems(spark: SparkSession, sf: str) -> DataFrame:
    """Rules of evidence that are broken: the document ids of this feed are not derived ones, all else holds."""
    now = lake(spark, sf)
    found = evidence.visit_problems(now.read("visits", 2)).unionByName(evidence.document_problems(now.read("documents", 2)))
    return found.groupBy("table_name", "rule").agg(F.count(F.lit(1)).alias("n"))


def lake_ready(spark: SparkSession, sf: str) -> DataFrame:
    """What each visit of the first delivery waits for."""
    now = lake(spark, sf)
    wanted = now.read("visits", 1)
    return evidence.observation_readiness(wanted, now.read("visits", 3), now.read("documents", 3), now.read("visit_readiness", 3), now.read("html_elements", 3))


def lake_stream(spark: SparkSession, sf: str) -> DataFrame:
    """Visits that arrive twice as files, materialised batch by batch: the links of each visit once."""
    base = f"{ensure_checkpoint_dir(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"
    p = pages(spark, sf)
    target = Lake(spark, f"{base}/lake")
    target.append({"documents": documents(p)})
    v = visits(p)
    v.coalesce(1).write.parquet(f"{base}/in")
    v.where(F.col("finished_at") < F.lit(FIRST_UNTIL).cast("timestamp")).coalesce(1).write.mode("append").parquet(f"{base}/in")
    follow(spark, target, f"{base}/in", lambda: contents(p), f"{base}/state", files_per_batch=1).awaitTermination()
    return target.read("link_occurrences").groupBy("visit_id", "relation_scope").agg(F.count(F.lit(1)).alias("links"))


QUERIES = {
    f.__name__: f
    for f in (
        proj_elements, proj_terms, proj_jsonld, proj_links, proj_readiness, proj_owners, proj_stored_links, proj_stored_jsonld, view_capture, view_html_element, view_html_jsonld,
        view_link, search_one, search_many, lake_visits, lake_time_travel, lake_changes, lake_snapshots, lake_inventory, lake_elements, lake_compacted, lake_purged, lake_retention,
        lake_validations, lake_problems, lake_ready, lake_stream,
    )
}

_ESC = "replace(replace(replace({}, '&', '&amp;'), '<', '&lt;'), '\"', '&quot;')"
_BREAKS = "replace(replace({}, chr(13) || chr(10), chr(10)), chr(13), chr(10))"
_PAGES = f"""
WITH page AS (
  SELECT *, sha256('<!DOCTYPE html><html lang="' || {_ESC.format("coalesce(lang, '')")} || '"><head><title> ' || {_ESC.format("coalesce(source, 'none')")} || ' </title></head><body><p> § ' || {_ESC.format("text")}
    || ' </p><p><a href="/next#top">next</a> <a href="mailto:a@b.example">mail</a> <a href="' || {_ESC.format("coalesce(url, '')")}
    || '">self</a> </p><script type="application/ld+json">{{"@type":"Document"}}</script></body></html>') AS content_sha256,
    ' ' || coalesce(source, 'none') || ' ' AS title, ' § ' || {_BREAKS.format("text")} || ' ' AS body
  FROM documents
), one AS (SELECT content_sha256, any_value(lang) AS lang, any_value(url) AS url, any_value(title) AS title, any_value(body) AS body FROM page WHERE text IS NOT NULL GROUP BY content_sha256)"""

# node, parent, end, sibling, depth, tag, own text, text, and where it starts and ends, for the page's one form.
_TAIL, _LD = "'next mail self '", """'{"@type":"Document"}'"""
_EL = (
    (2, "NULL", 21, 0, 0, "html", "''", f"title || body || {_TAIL} || {_LD}", "0"),
    (3, "2", 6, 0, 1, "head", "''", "title", "0"),
    (4, "3", 6, 0, 2, "title", "title", "title", "0"),
    (6, "2", 21, 1, 1, "body", "''", f"body || {_TAIL} || {_LD}", "length(title)"),
    (7, "6", 9, 0, 2, "p", "body", "body", "length(title)"),
    (9, "6", 19, 1, 2, "p", "'   '", _TAIL, "length(title || body)"),
    (10, "9", 12, 0, 3, "a", "'next'", "'next'", "length(title || body)"),
    (13, "9", 15, 1, 3, "a", "'mail'", "'mail'", "length(title || body) + 5"),
    (16, "9", 18, 2, 3, "a", "'self'", "'self'", "length(title || body) + 10"),
    (19, "6", 21, 2, 2, "script", _LD, _LD, "length(title || body) + 15"),
)
_ELEMENTS = _PAGES + ", el AS (" + " UNION ALL ".join(
    f"SELECT content_sha256, {n}::INT AS node_index, {p}::INT AS parent_index, {e}::INT AS subtree_end_index, {s}::INT AS sibling_index, {d}::INT AS depth, '{t}' AS tag, {own} AS text_direct, {text} AS text, ({at})::BIGINT AS text_start, "
    f"{'coalesce(lang, chr(0))' if t == 'html' else 'NULL'} AS lang0, {dict([(10, repr('/next#top')), (13, repr('mailto:a@b.example')), (16, 'coalesce(url, chr(0))')]).get(n, 'NULL')} AS href0 FROM one"
    for n, p, e, s, d, t, own, text, at in _EL
) + ")"
_L, _N, _M = r"[\p{L}\p{Nl}\p{No}]", r"\p{Nd}", r"[\x{300}-\x{36f}\x{1ab0}-\x{1aff}\x{20d0}-\x{20ff}]*"
_WORD = rf"(?:{_L}(?:[.:·’''‧]{_L})*{_M}|{_N}(?:[.,;’'']{_N})*{_M}|_)+"
_TERMS = _ELEMENTS + rf""", word AS (SELECT content_sha256, node_index, unnest(regexp_extract_all(text, '{_WORD}')) AS w FROM el),
posting AS (SELECT DISTINCT nfc_normalize(replace(lower(w), 'ß', 'ss')) AS term, content_sha256, node_index FROM word WHERE regexp_matches(w, '[\p{{L}}\p{{N}}]')),
terms AS (SELECT term, content_sha256, list_sort(list(node_index)) AS node_indexes FROM posting GROUP BY ALL)"""
_HTML = "page WHERE text IS NOT NULL AND source IS NOT NULL"
_SOURCE = "coalesce(url, 'https://none.example/')"
_HOST = "regexp_extract({}, '^https?://[^/?#]+')"
_LINKS = _PAGES + f""", links AS (
  SELECT 'v' || doc_id AS visit_id, 'd' || doc_id AS document_id, content_sha256, 10 AS element_index, '/next#top' AS raw_href, {_SOURCE} AS source_url, {_HOST.format(_SOURCE)} || '/next' AS target_url,
    CASE WHEN {_SOURCE} = {_HOST.format(_SOURCE)} || '/next' THEN 'self' ELSE 'same_origin' END AS relation_scope FROM {_HTML}
  UNION ALL SELECT 'v' || doc_id, 'd' || doc_id, content_sha256, 16, url, url, url, 'self' FROM {_HTML} AND url IS NOT NULL)"""
_FIRST = f"observed_at < TIMESTAMP '{FIRST_UNTIL}'"
_VISIT = "SELECT 'v' || doc_id AS visit_id, coalesce(url, 'https://none.example/') AS requested_url, CASE WHEN text IS NULL THEN 'failed' ELSE 'succeeded' END AS outcome, observed_at AS finished_at FROM documents"

ORACLES = {
    "proj_elements": _ELEMENTS + " SELECT * EXCLUDE (lang0, href0), text_start + length(text) AS text_end, replace(lang0, chr(0), '') AS lang, replace(href0, chr(0), '') AS href, CASE WHEN tag = 'script' THEN 'application/ld+json' END AS type FROM el",
    "proj_terms": _TERMS + " SELECT * FROM terms",
    "proj_jsonld": _PAGES + " SELECT content_sha256, 19 AS node_index, '{\"@type\":\"Document\"}' AS value, NULL::VARCHAR AS parse_error FROM one",
    "proj_links": _LINKS + " SELECT * FROM links",
    "proj_readiness": "SELECT 'v' || doc_id AS visit_id, observed_at AS finished_at FROM documents",
    "proj_owners": _PAGES + f", o AS (SELECT content_sha256, 'd' || doc_id AS document_id, source, FALSE AS retired FROM page WHERE text IS NOT NULL UNION ALL SELECT content_sha256, 'd' || doc_id, source, TRUE FROM page WHERE text IS NOT NULL AND source IS DISTINCT FROM '{PURGED}') SELECT content_sha256, min(document_id) AS document_id, 'v' || substr(min(document_id), 2) AS visit_id, retired FROM o GROUP BY content_sha256, retired",
    "proj_stored_links": "SELECT DISTINCT capture_id, node_index, target_url, raw_href FROM link",
    "proj_stored_jsonld": "SELECT DISTINCT content_id, node_index, CASE WHEN parse_error IS NULL THEN value END AS value, parse_error FROM html_jsonld",
    "view_capture": _PAGES + f" SELECT 'v' || doc_id AS capture_id, {_SOURCE} AS page_url, NULL::VARCHAR AS effective_url, observed_at AS captured_at, 200 AS http_status_code, content_sha256 AS content_id, octet_length(encode('<!DOCTYPE html><html lang=\"' || {_ESC.format('''coalesce(lang, '')''')} || '\"><head><title> ' || {_ESC.format('''coalesce(source, 'none')''')} || ' </title></head><body><p> § ' || {_ESC.format('text')} || ' </p><p><a href=\"/next#top\">next</a> <a href=\"mailto:a@b.example\">mail</a> <a href=\"' || {_ESC.format('''coalesce(url, '')''')} || '\">self</a> </p><script type=\"application/ld+json\">{{\"@type\":\"Document\"}}</script></body></html>'))::BIGINT AS byte_length, 'utf-8' AS encoding FROM {_HTML}",
    "view_html_element": _ELEMENTS + " SELECT content_sha256 AS content_id, node_index, tag, text FROM el WHERE tag IN ('p', 'title')",
    "view_html_jsonld": _PAGES + " SELECT content_sha256 AS content_id, 19 AS node_index, '{\"@type\":\"Document\"}' AS value, NULL::VARCHAR AS parse_error FROM one",
    "view_link": _LINKS + " SELECT visit_id AS capture_id, element_index AS node_index, target_url, raw_href FROM links",
    "search_one": _TERMS + " SELECT content_sha256 AS content_id, node_indexes, 1.0::DOUBLE AS score FROM terms WHERE term = 'garden'",
    "search_many": _TERMS + " SELECT content_sha256 AS content_id, list_sort(list_distinct(flatten(list(node_indexes)))) AS node_indexes, count(DISTINCT term)::DOUBLE AS score FROM terms WHERE term IN ('garden', 'hafen', 'für', 'où') GROUP BY 1",
    "lake_visits": _VISIT,
    "lake_time_travel": f"{_VISIT} WHERE {_FIRST}",
    "lake_changes": f"{_VISIT} WHERE NOT {_FIRST}",
    "lake_snapshots": "SELECT * FROM (VALUES (1::BIGINT, 'first delivery', 1::BIGINT), (2, 'all', 2), (3, 'rebuild', 7), (4, 'compact html_terms', 7), (5, 'purge', 7)) t(version, message, tables)",
    "lake_inventory": "SELECT *, TRUE AS has_files, TRUE AS has_bytes FROM (VALUES ('visits'), ('documents'), ('html_elements'), ('html_terms'), ('html_jsonld'), ('link_occurrences'), ('visit_readiness')) t(table_name)",
    "lake_elements": _ELEMENTS + f" SELECT content_sha256, node_index, tag, text FROM el WHERE content_sha256 IN (SELECT content_sha256 FROM {_HTML})",
    "lake_compacted": "SELECT 0::BIGINT AS different",
    "lake_purged": _PAGES + f" SELECT 'visits' AS table_name, 'v' || doc_id AS id FROM page WHERE source IS DISTINCT FROM '{PURGED}' UNION ALL SELECT DISTINCT 'html_elements', content_sha256 FROM {_HTML} AND source <> '{PURGED}'",
    "lake_retention": f"SELECT 'v' || doc_id AS visit_id FROM documents WHERE source <> '{PURGED}' AND observed_at + INTERVAL 30 DAY < TIMESTAMP '{JUDGED_AT}'",
    "lake_validations": "SELECT unnest(['html_elements: broken span', 'html_elements: repeated identity', 'html_jsonld: repeated identity', 'html_jsonld: value and error', 'html_terms: empty or unsorted', 'html_terms: repeated identity', 'link_occurrences: repeated identity', 'link_occurrences: unknown visit', 'visit_readiness: repeated identity', 'visit_readiness: unknown visit']) AS check, 0::BIGINT AS broken",
    "lake_problems": "SELECT 'documents' AS table_name, 'derived id' AS rule, count(text) AS n FROM documents",
    "lake_ready": f"SELECT 'v' || doc_id AS visit_id, CASE WHEN text IS NULL THEN 'failed' WHEN source IS NULL THEN 'not_html' ELSE 'ready' END AS reason FROM documents WHERE {_FIRST}",
    "lake_stream": _LINKS + " SELECT visit_id, relation_scope, count(*) AS links FROM links GROUP BY ALL",
}
