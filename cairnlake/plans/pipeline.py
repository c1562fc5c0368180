"""Queries of the general training-data problems: nested records (p1), heavy keys (p5), repeated messages (p7)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnlake.operators import delivery, nested, skew
from cairnlake.sources.tables import table

#: A key is heavy from one fortieth of the rows that have a key.
HEAVY_SHARE = 1 / 40


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return nested.objects(table(spark, sf, "html_jsonld"))


def p1_types(spark: SparkSession, sf: str) -> DataFrame:
    return nested.object_types(table(spark, sf, "html_jsonld"))


def p1_fields(spark: SparkSession, sf: str) -> DataFrame:
    return nested.fields(table(spark, sf, "html_jsonld"))


def p1_elements(spark: SparkSession, sf: str) -> DataFrame:
    return nested.elements(table(spark, sf, "html_jsonld"))


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    link = skew.heavy_keys(table(spark, sf, "link"), "target_url", HEAVY_SHARE)
    activity = skew.heavy_keys(table(spark, sf, "domain_activity"), "domain", HEAVY_SHARE)
    named = [(link, "link"), (activity, "domain_activity")]
    parts = [d.select(F.lit(n).alias("table_name"), F.col("key").alias("key_value")) for d, n in named]
    return parts[0].unionByName(parts[1])


def p5_link_counts(spark: SparkSession, sf: str) -> DataFrame:
    one = F.lit(1).cast("bigint")
    return skew.aggregate_by_key(
        table(spark, sf, "link"), "target_url", {"n_rows": one}, distinct={"n_captures": F.col("capture_id")}, share=HEAVY_SHARE
    )


def p5_link_targets(spark: SparkSession, sf: str) -> DataFrame:
    """Every link with what the lake has of its target: the captures of that address and the last of them."""
    pages = table(spark, sf, "capture").groupBy("page_url").agg(F.count_distinct("capture_id").alias("n_captures"), F.max("captured_at").alias("last_at"))
    links = table(spark, sf, "link").select("capture_id", "node_index", "target_url")
    return skew.join_by_key(links, "target_url", pages, "page_url", share=HEAVY_SHARE).distinct()


def p5_domain_sums(spark: SparkSession, sf: str) -> DataFrame:
    names = ("queued", "dispatched", "started", "unique_queued_urls", "request_queued_urls")
    sums = {"n_rows": F.lit(1).cast("bigint")} | {f"sum_{n}": F.col(n).cast("bigint") for n in names}
    return skew.aggregate_by_key(
        table(spark, sf, "domain_activity"), "domain", sums,
        maxima={"last_as_of": F.col("as_of")}, minima={"first_wait_at": F.col("oldest_wait_at")}, share=HEAVY_SHARE,
    )


def _streams(spark: SparkSession, sf: str):
    d, w = table(spark, sf, "frontier_delivery"), table(spark, sf, "capture_work")
    yield "frontier_delivery", d, delivery.canonical_message_id(F.col("message_id"))
    yield "capture_work", w, delivery.work_message_id(F.col("acquisition_id"), F.col("generation"))


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    """The messages of which ``deliver_once`` took one copy out of several."""
    a, b = [
        delivery.deliver_once(d, mid, "delivery_no").where("copies > 1").select(F.lit(name).alias("stream"), "message_id")
        for name, d, mid in _streams(spark, sf)
    ]
    return a.unionByName(b)


def p7_messages(spark: SparkSession, sf: str) -> DataFrame:
    """One copy of each message of either stream, by delivery number."""
    a, b = [
        delivery.deliver_once(d, mid, "delivery_no").select(
            F.lit(name).alias("stream"), "delivery_no", "message_id", "batch_no", "delivered_at", "copies"
        )
        for name, d, mid in _streams(spark, sf)
    ]
    return a.unionByName(b)


def p7_stored(spark: SparkSession, sf: str) -> DataFrame:
    """The same when all but the last batch are stored already and the last one is delivered to them."""
    parts = []
    for name, d, mid in _streams(spark, sf):
        last = d.agg(F.max("batch_no").alias("last"))
        marked = d.join(F.broadcast(last), F.lit(True))  # one row
        stored, new = marked.where("batch_no < last").drop("last"), marked.where("NOT coalesce(batch_no < last, false)").drop("last")
        once = delivery.deliver_once(new, mid, "delivery_no", stored)
        parts.append(once.select(F.lit(name).alias("stream"), "delivery_no", "message_id", "batch_no", "delivered_at", "copies"))
    return parts[0].unionByName(parts[1])


_COUNTS = """
SELECT target_url AS key_value, count(*)::BIGINT AS n_rows, count(DISTINCT capture_id)::BIGINT AS n_captures,
  target_url IS NOT NULL AND count(*) >= (SELECT count(target_url) FROM link) / 40.0 AS is_heavy
FROM link GROUP BY target_url"""

_SUMS = """
SELECT domain AS key_value, count(*)::BIGINT AS n_rows, sum(queued)::BIGINT AS sum_queued,
  sum(dispatched)::BIGINT AS sum_dispatched, sum(started)::BIGINT AS sum_started,
  sum(unique_queued_urls)::BIGINT AS sum_unique_queued_urls, sum(request_queued_urls)::BIGINT AS sum_request_queued_urls,
  max(as_of) AS last_as_of, min(oldest_wait_at) AS first_wait_at,
  domain IS NOT NULL AND count(*) >= (SELECT count(domain) FROM domain_activity) / 40.0 AS is_heavy
FROM domain_activity GROUP BY domain"""

_HEAVY = """
SELECT 'link' AS table_name, target_url AS key_value FROM link WHERE target_url IS NOT NULL GROUP BY target_url
HAVING count(*) >= (SELECT count(target_url) FROM link) / 40.0
UNION ALL
SELECT 'domain_activity', domain FROM domain_activity WHERE domain IS NOT NULL GROUP BY domain
HAVING count(*) >= (SELECT count(domain) FROM domain_activity) / 40.0"""

_HEX = "([0-9a-fA-F]{8})-?([0-9a-fA-F]{4})-?([0-9a-fA-F]{4})-?([0-9a-fA-F]{4})-?([0-9a-fA-F]{12})"
_OPEN, _SHUT = r"(?:[uU][rR][nN]:[uU][uU][iI][dD]:)?[{]?", r"[}]?"
_NAMED = rf"""
WITH named AS (
  SELECT 'frontier_delivery' AS stream, delivery_no, batch_no, delivered_at,
    regexp_replace(trim(message_id, chr(9) || chr(10) || chr(13) || chr(32) || chr(160)), '{_OPEN}{_HEX}{_SHUT}', '\1-\2-\3-\4-\5') AS raw FROM frontier_delivery
  UNION ALL
  SELECT 'capture_work', delivery_no, batch_no, delivered_at,
    'capture:' || regexp_replace(trim(acquisition_id, chr(9) || chr(10) || chr(13) || chr(32) || chr(160)), '{_OPEN}{_HEX}{_SHUT}', '\1-\2-\3-\4-\5') || ':' || generation FROM capture_work
), ids AS (SELECT stream, delivery_no, batch_no, delivered_at, lower(raw) AS message_id FROM named)
"""

_WALK = r"""
WITH RECURSIVE docs AS (SELECT DISTINCT content_id, node_index, value FROM html_jsonld WHERE parse_error IS NULL AND value IS NOT NULL),
walk(content_id, node_index, path, parent, field, place, v) AS (
  SELECT content_id, node_index, '#', '', '', '', value::JSON FROM docs
  UNION ALL
  SELECT w.content_id, w.node_index, w.path || '/' || replace(replace(c.k, '~', '~0'), '/', '~1'), CASE WHEN json_type(w.v) = 'OBJECT' THEN w.path ELSE w.parent END,
    CASE WHEN json_type(w.v) = 'OBJECT' THEN c.k ELSE w.field END, CASE WHEN json_type(w.v) = 'OBJECT' THEN '' WHEN w.place = '' THEN c.k ELSE w.place || '/' || c.k END, c.v
  FROM walk w, LATERAL (SELECT e.key AS k, e.value AS v FROM json_each(w.v) e) c
  WHERE json_type(w.v) IN ('OBJECT', 'ARRAY') AND json_type(c.v) IN ('OBJECT', 'ARRAY'))
"""
_KIND = "CASE json_type(e.value) WHEN 'VARCHAR' THEN 'string' WHEN 'NULL' THEN 'null' WHEN 'BOOLEAN' THEN 'boolean' ELSE 'number' END"
_TEXT = r"CASE WHEN json_type(e.value) = 'DOUBLE' AND NOT regexp_matches(e.value::VARCHAR, '[eE]') THEN regexp_replace(e.value::VARCHAR, '\.?0+$', '') ELSE json_extract_string(e.value, '$') END"

_ONCE = """SELECT stream, delivery_no, message_id, batch_no, delivered_at, copies FROM (
      SELECT *, count(*) OVER (PARTITION BY stream, message_id)::BIGINT AS copies,
        row_number() OVER (PARTITION BY stream, message_id ORDER BY delivery_no) AS rn FROM ids WHERE message_id IS NOT NULL)
    WHERE rn = 1"""

QUERIES = {f.__name__: f for f in (p1_found, p1_types, p1_fields, p1_elements, p5_found, p5_link_counts, p5_domain_sums, p7_found, p7_messages, p7_stored, p5_link_targets)}

ORACLES = {
    "p5_found": _HEAVY,
    "p5_link_counts": _COUNTS,
    "p5_domain_sums": _SUMS,
    "p7_found": _NAMED + "SELECT stream, message_id FROM ids WHERE message_id IS NOT NULL GROUP BY ALL HAVING count(*) > 1",
    "p7_messages": _NAMED + _ONCE,
    "p7_stored": _NAMED + _ONCE,
    "p5_link_targets": """
WITH d AS (SELECT page_url, count(DISTINCT capture_id) AS n_captures, max(captured_at) AS last_at FROM capture GROUP BY 1)
SELECT DISTINCT capture_id, node_index, target_url, n_captures, last_at FROM link LEFT JOIN d ON target_url = page_url""",
    "p1_found": _WALK + "SELECT DISTINCT content_id, node_index, path AS obj_path, parent AS parent_path FROM walk WHERE json_type(v) = 'OBJECT'",
    "p1_types": _WALK
    + """SELECT DISTINCT content_id, node_index, path AS obj_path, e.key::INT AS type_no, json_extract_string(e.value, '$') AS obj_type
FROM walk, LATERAL (SELECT key, value FROM json_each(CASE WHEN json_type(v, '$."@type"') = 'ARRAY' THEN v->'$."@type"' ELSE json_array(v->'$."@type"') END)) e
WHERE json_type(v) = 'OBJECT' AND json_type(e.value) = 'VARCHAR'""",
    "p1_fields": _WALK
    + f"""SELECT DISTINCT content_id, node_index, path AS obj_path, e.key AS field, {_KIND} AS kind, {_TEXT} AS text
FROM walk, LATERAL (SELECT key, value FROM json_each(v)) e WHERE json_type(v) = 'OBJECT' AND json_type(e.value) NOT IN ('OBJECT', 'ARRAY')""",
    "p1_elements": _WALK
    + f"""SELECT DISTINCT content_id, node_index, parent AS obj_path, field, CASE WHEN place = '' THEN e.key ELSE place || '/' || e.key END AS place, {_KIND} AS kind, {_TEXT} AS text
FROM walk, LATERAL (SELECT key, value FROM json_each(v)) e WHERE json_type(v) = 'ARRAY' AND json_type(e.value) NOT IN ('OBJECT', 'ARRAY')""",
}
