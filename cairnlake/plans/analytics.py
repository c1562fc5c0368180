"""Operational and analysts' queries over the public views, as DataFrame plans.

The tables of the data directory have the shape of the views, so each query takes them as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cairnlake.plans import views
from cairnlake.sources.tables import table

# Fixed value: terms of the demonstration search.
SEARCH_TERMS = ("map", "harbour", "garden", "gärten", "été", "años", "2014")


def host(c: Column) -> Column:
    return F.lower(F.regexp_extract(c, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]+)", 1))


def captures(spark: SparkSession, sf: str) -> DataFrame:
    """Captures, each once."""
    return table(spark, sf, "capture").distinct()


def elements(spark: SparkSession, sf: str, *names: str) -> DataFrame:
    """Elements, each once, by the columns asked for."""
    return table(spark, sf, "html_element").select("content_id", "node_index", *names).distinct()


def latest(c: DataFrame) -> DataFrame:
    """The latest capture of each page address: a combining aggregate, so no page's history meets in one task."""
    last = c.groupBy("page_url").agg(F.max_by("capture_id", F.struct("captured_at", "capture_id")).alias("capture_id"))
    return c.join(last.select("capture_id"), "capture_id", "left_semi")


def ref_page(spark: SparkSession, sf: str) -> DataFrame:
    return views.page(table(spark, sf, "capture"), table(spark, sf, "link"))


def ref_html_metadata(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "html_element")
    return views.html_metadata(e).distinct()


def ref_latest_capture(spark: SparkSession, sf: str) -> DataFrame:
    return latest(captures(spark, sf)).select("page_url", "capture_id", "captured_at", "content_id")


def ref_latest_title(spark: SparkSession, sf: str) -> DataFrame:
    titles = elements(spark, sf, "tag", "text").where("tag = 'title'").groupBy("content_id").agg(F.min_by("text", "node_index").alias("title"))
    return latest(captures(spark, sf)).join(titles, "content_id", "left").select("page_url", "capture_id", "title")


def ref_coverage_by_site(spark: SparkSession, sf: str) -> DataFrame:
    c = captures(spark, sf).withColumn("site", host(F.col("page_url")))
    per = c.groupBy("site").agg(
        F.count(F.lit(1)).alias("captures"), F.count_distinct("page_url").alias("pages"), F.count_distinct("content_id").alias("contents"),
        F.count_if(F.col("http_status_code") >= 400).alias("bad"),
    )
    total = c.agg(F.count(F.lit(1)).alias("total"))
    return per.join(F.broadcast(total), F.lit(True)).withColumn("share", F.round(F.col("captures") / F.col("total"), 6)).drop("total")  # one row


def ref_most_linked(spark: SparkSession, sf: str) -> DataFrame:
    newest = latest(captures(spark, sf)).select("capture_id", host(F.col("page_url")).alias("site"))
    links = table(spark, sf, "link").select("capture_id", "node_index", "target_url").distinct()
    counts = links.join(newest, "capture_id").groupBy("target_url").agg(F.count(F.lit(1)).alias("links"), F.count_distinct("site").alias("sites"))
    return counts.orderBy(F.desc("links"), "target_url").limit(50)


def ref_external_destinations(spark: SparkSession, sf: str) -> DataFrame:
    c = captures(spark, sf).select("capture_id", host(F.col("page_url")).alias("site"))
    links = table(spark, sf, "link").select("capture_id", host(F.col("target_url")).alias("target"))
    return links.join(c, "capture_id").where("site <> target AND target <> ''").groupBy("target").agg(F.count_distinct("site").alias("sites"), F.count(F.lit(1)).alias("links"))


def ref_headings(spark: SparkSession, sf: str) -> DataFrame:
    h = elements(spark, sf, "tag", "text").where(F.col("tag").isin("h1", "h2", "h3", "h4", "h5", "h6"))
    pages = captures(spark, sf).select("content_id", "page_url").distinct()
    return h.join(pages, "content_id").select("page_url", "content_id", "node_index", F.substring("tag", 2, 1).cast("int").alias("level"), F.trim(F.regexp_replace("text", r"\s+", " ")).alias("heading"))


def ref_main_links(spark: SparkSession, sf: str) -> DataFrame:
    """Anchors inside main, article and nav elements: an interval join within a content."""
    e = elements(spark, sf, "subtree_end_index", "tag", F.try_element_at("attributes", F.lit("href")).alias("href"))
    main = e.where("tag IN ('main', 'article', 'nav')").select("content_id", F.col("node_index").alias("lo"), F.col("subtree_end_index").alias("hi"))
    a = e.where("tag = 'a' AND href IS NOT NULL")
    return a.join(main, "content_id").where("node_index > lo AND node_index < hi").select("content_id", "node_index", "href").distinct()


def ref_jsonld_of_latest(spark: SparkSession, sf: str) -> DataFrame:
    j = table(spark, sf, "html_jsonld").where("parse_error IS NULL").distinct()
    typed = j.withColumn("type", F.get_json_object("value", "$['@type']")).withColumn("name", F.get_json_object("value", "$.name"))
    return latest(captures(spark, sf)).join(typed, "content_id").select("page_url", "node_index", "type", "name")


def ref_parse_errors(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "html_jsonld").groupBy("parse_error").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("content_id").alias("contents"))


# A word: letters, digits and underscores, joined inside by points, colons and apostrophes between letters and by
# separators between digits; both Java's and RE2's expressions read it alike.
_L, _N, _M = r"[\p{L}\p{Nl}\p{No}]", r"\p{Nd}", r"[\x{300}-\x{36f}\x{1ab0}-\x{1aff}\x{20d0}-\x{20ff}]*"
_TERM = rf"(?:{_L}(?:[.:·’'‧]{_L})*{_M}|{_N}(?:[.,;’']{_N})*{_M}|_)+"


def terms(spark: SparkSession, sf: str) -> DataFrame:
    """``term, content_sha256, node_indexes``: the words of the stored elements in lower case, with every element whose
    text holds the word, ancestors included."""
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(_TERM), F.lit(0)))
    e = elements(spark, sf, "text").select("content_id", "node_index", F.explode(words).alias("term")).where(F.col("term").rlike(r"[\p{L}\p{N}]"))
    return e.groupBy("term", "content_id").agg(F.array_sort(F.collect_set("node_index")).alias("node_indexes")).withColumnRenamed("content_id", "content_sha256")


def ref_postings(spark: SparkSession, sf: str) -> DataFrame:
    return terms(spark, sf)


def ref_search(spark: SparkSession, sf: str) -> DataFrame:
    """Any-word search joined to captures: the best pages for the terms."""
    hits = views.search(terms(spark, sf), SEARCH_TERMS)
    pages = captures(spark, sf).groupBy("content_id").agg(F.min("page_url").alias("page_url"))
    return hits.join(pages, "content_id").select("page_url", "content_id", F.size("node_indexes").alias("nodes"), "score")


def ref_activity_by_day(spark: SparkSession, sf: str) -> DataFrame:
    c = captures(spark, sf)
    return c.groupBy(F.date_trunc("day", "captured_at").cast("timestamp_ntz").alias("day")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("http_status_code") != 200).alias("not_ok"))


def ref_velocity(spark: SparkSession, sf: str) -> DataFrame:
    """Starts per domain and overall in the last 6 and 24 hours, the ten busiest domains of each window."""
    a = table(spark, sf, "domain_activity").distinct()
    now = a.agg(F.max("as_of").alias("now"))
    spans = spark.createDataFrame([(6,), (24,)], "hours int")
    recent = a.join(F.broadcast(now), F.lit(True)).join(F.broadcast(spans), F.col("as_of") > F.col("now") - F.make_dt_interval(hours=F.col("hours")))
    g = recent.groupingSets([["hours"], ["hours", "domain"]], "hours", "domain").agg(
        F.grouping("domain").cast("int").alias("overall"), F.sum("started").alias("started"), F.sum("dispatched").alias("dispatched")
    )
    w = Window.partitionBy("hours", "overall").orderBy(F.desc("started"), F.asc_nulls_last("domain"))
    return g.withColumn("place", F.row_number().over(w)).where("place <= 10").drop("place")


def ref_storage(spark: SparkSession, sf: str) -> DataFrame:
    per = captures(spark, sf).groupBy("content_id").agg(F.max("byte_length").alias("bytes"), F.count(F.lit(1)).alias("captures"))
    return per.agg(
        F.count(F.lit(1)).alias("contents"), F.sum("captures").alias("captures"), F.sum("bytes").alias("unique_bytes"),
        F.round(F.median("bytes"), 2).alias("median_bytes"), F.round(F.percentile("bytes", 0.95), 2).alias("p95_bytes"),
    )


def ref_readiness(spark: SparkSession, sf: str) -> DataFrame:
    """Each capture's state: ready, waiting for projection, or failed."""
    present = table(spark, sf, "html_element").select("content_id").distinct().withColumn("projected", F.lit(True))
    state = F.when(F.col("content_id").isNull(), "no content").when(F.col("projected"), "ready").otherwise("waiting")
    return captures(spark, sf).join(present, "content_id", "left").select("capture_id", state.alias("state")).distinct()


def ref_exact_history(spark: SparkSession, sf: str) -> DataFrame:
    """The history of the page captured most often."""
    c = captures(spark, sf)
    top = c.groupBy("page_url").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "page_url").limit(1).select("page_url")
    return c.join(F.broadcast(top), "page_url", "left_semi").select("page_url", "capture_id", "captured_at", "http_status_code")  # one row


def ref_arrivals_page(spark: SparkSession, sf: str) -> DataFrame:
    """A page of the arrival feed after a cursor, by keyset."""
    key = F.struct("captured_at", "capture_id")
    cursor = F.struct(F.lit("2015-01-15 00:00:00").cast("timestamp_ntz").alias("captured_at"), F.lit("8").alias("capture_id"))
    c = captures(spark, sf).withColumn("captured_at", F.col("captured_at").cast("timestamp_ntz"))
    return c.where(key > cursor).orderBy("captured_at", "capture_id", "page_url", "effective_url").limit(100).select("captured_at", "capture_id", "page_url")


def ref_sections(spark: SparkSession, sf: str) -> DataFrame:
    """Text below each second-level heading up to the next one of the same parent."""
    e = elements(spark, sf, "parent_index", "sibling_index", "tag", "text").where("tag IN ('h2', 'p')")
    w = Window.partitionBy("content_id", "parent_index").orderBy("sibling_index").rowsBetween(Window.unboundedPreceding, 0)
    s = e.withColumn("section", F.max(F.when(F.col("tag") == "h2", F.col("node_index"))).over(w)).where("section IS NOT NULL AND tag = 'p'")
    return s.groupBy("content_id", "section").agg(F.count(F.lit(1)).alias("paragraphs"), F.sum(F.length("text")).alias("characters"))


def ref_dangling_links(spark: SparkSession, sf: str) -> DataFrame:
    """Links whose capture is unknown, and captures whose content is not projected: counts by kind."""
    c = table(spark, sf, "capture")
    a = table(spark, sf, "link").join(c.select("capture_id"), "capture_id", "left_anti").agg(F.count(F.lit(1)).alias("n")).withColumn("kind", F.lit("link"))
    b = c.select("content_id").distinct().join(table(spark, sf, "html_element").select("content_id"), "content_id", "left_anti")
    return a.unionByName(b.agg(F.count(F.lit(1)).alias("n")).withColumn("kind", F.lit("content")))


def ref_identity_checks(spark: SparkSession, sf: str) -> DataFrame:
    """Broken intervals and parents outside of their place among the elements."""
    e = elements(spark, sf, "parent_index", "subtree_end_index", "depth")
    p = e.select("content_id", F.col("node_index").alias("parent_index"), F.col("subtree_end_index").alias("up_end"), F.col("depth").alias("up_depth"))
    j = e.where("parent_index IS NOT NULL").join(p, ["content_id", "parent_index"], "left")
    bad = F.col("up_end").isNull() | (F.col("subtree_end_index") > F.col("up_end")) | (F.col("depth") != F.col("up_depth") + 1)
    return j.agg(F.count_if(bad).alias("broken"), F.count(F.lit(1)).alias("checked"))


_LATEST = "newest AS (SELECT DISTINCT c.* FROM capture c JOIN (SELECT page_url, arg_max(capture_id, (captured_at, capture_id)) AS capture_id FROM capture GROUP BY page_url) USING (capture_id, page_url))"
_HOST = "lower(regexp_extract({}, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]+)', 1))"
_CAP = "cap AS (SELECT DISTINCT * FROM capture)"

QUERIES = {
    f.__name__: f
    for f in (
        ref_page, ref_html_metadata, ref_latest_capture, ref_latest_title, ref_coverage_by_site, ref_most_linked, ref_external_destinations, ref_headings,
        ref_main_links, ref_jsonld_of_latest, ref_parse_errors, ref_postings, ref_search, ref_activity_by_day, ref_velocity, ref_storage, ref_readiness,
        ref_exact_history, ref_arrivals_page, ref_sections, ref_dangling_links, ref_identity_checks,
    )
}

_SQL_TERM = _TERM.replace("'", "''")
_TERMS = rf"terms AS (SELECT term, content_id AS content_sha256, list_sort(list(DISTINCT node_index)) AS node_indexes FROM (SELECT DISTINCT content_id, node_index, unnest(regexp_extract_all(lower(text), '{_SQL_TERM}')) AS term FROM html_element) WHERE regexp_matches(term, '[\p{{L}}\p{{N}}]') GROUP BY ALL)"

ORACLES = {
    "ref_page": "SELECT page_url AS url FROM capture WHERE page_url IS NOT NULL UNION SELECT effective_url FROM capture WHERE effective_url IS NOT NULL UNION SELECT target_url FROM link WHERE target_url IS NOT NULL",
    "ref_html_metadata": r"""WITH e AS (SELECT DISTINCT content_id, node_index, tag, attributes, text FROM html_element WHERE namespace IS NULL OR namespace IN ('html', 'http://www.w3.org/1999/xhtml'))
SELECT DISTINCT * FROM (
SELECT content_id, node_index, 'title' AS kind, NULL::VARCHAR AS name, text AS value FROM e WHERE tag = 'title'
UNION ALL SELECT content_id, node_index, 'meta_name', attributes['name'], attributes['content'] FROM e WHERE tag = 'meta' AND attributes['name'] IS NOT NULL
UNION ALL SELECT content_id, node_index, 'meta_property', attributes['property'], attributes['content'] FROM e WHERE tag = 'meta' AND attributes['property'] IS NOT NULL
UNION ALL SELECT content_id, node_index, 'meta_http_equiv', attributes['http-equiv'], attributes['content'] FROM e WHERE tag = 'meta' AND attributes['http-equiv'] IS NOT NULL
UNION ALL SELECT content_id, node_index, 'meta_charset', NULL, attributes['charset'] FROM e WHERE tag = 'meta' AND attributes['charset'] IS NOT NULL
UNION ALL SELECT content_id, node_index, 'link_rel', unnest(list_distinct(list_filter(regexp_split_to_array(attributes['rel'], '[ \t\n\f\r]+'), lambda x: x <> ''))), attributes['href'] FROM e WHERE tag = 'link'
UNION ALL SELECT content_id, node_index, 'html_attribute', unnest(map_keys(attributes)), unnest(map_values(attributes)) FROM e WHERE tag = 'html')""",
    "ref_latest_capture": f"WITH {_LATEST} SELECT page_url, capture_id, captured_at, content_id FROM newest",
    "ref_latest_title": f"WITH {_LATEST}, t AS (SELECT content_id, arg_min(text, node_index) AS title FROM html_element WHERE tag = 'title' GROUP BY content_id) SELECT page_url, capture_id, title FROM newest LEFT JOIN t USING (content_id)",
    "ref_coverage_by_site": f"WITH {_CAP} SELECT {_HOST.format('page_url')} AS site, count(*) AS captures, count(DISTINCT page_url) AS pages, count(DISTINCT content_id) AS contents, count(*) FILTER (WHERE http_status_code >= 400) AS bad, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM cap GROUP BY 1",
    "ref_most_linked": f"WITH {_LATEST}, l AS (SELECT DISTINCT capture_id, node_index, target_url FROM link) SELECT target_url, count(*) AS links, count(DISTINCT {_HOST.format('page_url')}) AS sites FROM l JOIN newest USING (capture_id) GROUP BY 1 ORDER BY links DESC, target_url LIMIT 50",
    "ref_external_destinations": f"WITH {_CAP}, c AS (SELECT capture_id, {_HOST.format('page_url')} AS site FROM cap), l AS (SELECT capture_id, {_HOST.format('target_url')} AS target FROM link) SELECT target, count(DISTINCT site) AS sites, count(*) AS links FROM l JOIN c USING (capture_id) WHERE site <> target AND target <> '' GROUP BY 1",
    "ref_headings": "SELECT p.page_url, e.content_id, e.node_index, substr(e.tag, 2, 1)::INT AS level, trim(regexp_replace(e.text, '\\s+', ' ', 'g')) AS heading FROM (SELECT DISTINCT content_id, node_index, tag, text FROM html_element WHERE tag IN ('h1','h2','h3','h4','h5','h6')) e JOIN (SELECT DISTINCT content_id, page_url FROM capture) p USING (content_id)",
    "ref_main_links": "WITH e AS (SELECT DISTINCT content_id, node_index, subtree_end_index, tag, attributes['href'] AS href FROM html_element) SELECT DISTINCT a.content_id, a.node_index, a.href FROM e a JOIN e m ON a.content_id = m.content_id AND m.tag IN ('main', 'article', 'nav') AND a.node_index > m.node_index AND a.node_index < m.subtree_end_index WHERE a.tag = 'a' AND a.href IS NOT NULL",
    "ref_jsonld_of_latest": f"WITH {_LATEST}, j AS (SELECT DISTINCT content_id, node_index, value FROM html_jsonld WHERE parse_error IS NULL) SELECT page_url, node_index, json_extract_string(value, '$.\"@type\"') AS type, json_extract_string(value, '$.name') AS name FROM newest JOIN j USING (content_id)",
    "ref_parse_errors": "SELECT parse_error, count(*) AS n, count(DISTINCT content_id) AS contents FROM html_jsonld GROUP BY 1",
    "ref_postings": f"WITH {_TERMS} SELECT * FROM terms",
    "ref_search": f"WITH {_TERMS}, hits AS (SELECT content_sha256 AS content_id, count(DISTINCT term)::DOUBLE AS score, len(list_distinct(flatten(list(node_indexes))))::INT AS nodes FROM terms WHERE term IN {SEARCH_TERMS} GROUP BY 1), p AS (SELECT content_id, min(page_url) AS page_url FROM capture GROUP BY 1) SELECT page_url, content_id, nodes, score FROM hits JOIN p USING (content_id)",
    "ref_activity_by_day": f"WITH {_CAP} SELECT date_trunc('day', captured_at)::TIMESTAMP AS day, count(*) AS n, count(*) FILTER (WHERE http_status_code <> 200) AS not_ok FROM cap GROUP BY 1",
    "ref_velocity": """WITH a AS (SELECT DISTINCT * FROM domain_activity), w(hours) AS (VALUES (6), (24)), n AS (SELECT max(as_of) AS now FROM a),
g AS (SELECT hours, domain, grouping(domain)::INT AS overall, sum(started)::BIGINT AS started, sum(dispatched)::BIGINT AS dispatched FROM a, w, n WHERE as_of > now - hours * INTERVAL '1 hour' GROUP BY GROUPING SETS ((hours), (hours, domain)))
SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY hours, overall ORDER BY started DESC, domain NULLS LAST) <= 10""",
    "ref_storage": f"WITH {_CAP}, p AS (SELECT content_id, max(byte_length) AS bytes, count(*) AS captures FROM cap GROUP BY 1) SELECT count(*) AS contents, sum(captures)::BIGINT AS captures, sum(bytes)::BIGINT AS unique_bytes, round(median(bytes), 2) AS median_bytes, round(quantile_cont(bytes, 0.95), 2) AS p95_bytes FROM p",
    "ref_readiness": "SELECT DISTINCT capture_id, CASE WHEN content_id IS NULL THEN 'no content' WHEN content_id IN (SELECT content_id FROM html_element) THEN 'ready' ELSE 'waiting' END AS state FROM capture",
    "ref_exact_history": f"WITH {_CAP}, t AS (SELECT page_url FROM cap GROUP BY 1 ORDER BY count(*) DESC, page_url LIMIT 1) SELECT page_url, capture_id, captured_at, http_status_code FROM cap WHERE page_url IN (SELECT page_url FROM t)",
    "ref_arrivals_page": f"WITH {_CAP} SELECT captured_at, capture_id, page_url FROM cap WHERE (captured_at, capture_id) > (TIMESTAMP '2015-01-15 00:00:00', '8') ORDER BY captured_at, capture_id, page_url, effective_url LIMIT 100",
    "ref_sections": """WITH e AS (SELECT DISTINCT content_id, node_index, parent_index, sibling_index, tag, text FROM html_element WHERE tag IN ('h2', 'p')),
s AS (SELECT *, max(CASE WHEN tag = 'h2' THEN node_index END) OVER (PARTITION BY content_id, parent_index ORDER BY sibling_index ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS section FROM e)
SELECT content_id, section, count(*) AS paragraphs, sum(length(text))::BIGINT AS characters FROM s WHERE section IS NOT NULL AND tag = 'p' GROUP BY 1, 2""",
    "ref_dangling_links": "SELECT 'link' AS kind, count(*) AS n FROM link WHERE capture_id NOT IN (SELECT capture_id FROM capture) UNION ALL SELECT 'content', count(DISTINCT content_id) FROM capture WHERE content_id NOT IN (SELECT content_id FROM html_element)",
    "ref_identity_checks": """WITH e AS (SELECT DISTINCT content_id, node_index, parent_index, subtree_end_index, depth FROM html_element)
SELECT count(*) FILTER (WHERE p.node_index IS NULL OR e.subtree_end_index > p.subtree_end_index OR e.depth <> p.depth + 1) AS broken, count(*) AS checked
FROM e LEFT JOIN e p ON p.content_id = e.content_id AND p.node_index = e.parent_index WHERE e.parent_index IS NOT NULL""",
}
