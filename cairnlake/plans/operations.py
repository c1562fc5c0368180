"""Operational queries: feeds by keyset, lineage, documents and downloads, the delivery queue, and the query service itself."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnlake.functions import cursors
from cairnlake.operators import asof, delivery, queue
from cairnlake.plans import feed
from cairnlake.plans.analytics import captures, host
from cairnlake.plans.engine import Engine, Limits, QueryError, shape, summarize
from cairnlake.sources import objects
from cairnlake.sources.tables import register, table
from cairnlake.streaming.live import drained

# Where the demonstration pages begin, and their length.
HISTORY_AFTER, ARRIVALS_AFTER, LINEAGE_AFTER = cursors.encode("2030-01-01 00:00:00", "m"), cursors.encode("2015-01-10 00:00:00", "8"), cursors.encode("https://m", "captured", "0")
PAGE_ROWS, CLAIMED, MOST_DELIVERIES = 100, 20, 3


def ops_latest_successes(spark: SparkSession, sf: str) -> DataFrame:
    """The five captures that succeeded last."""
    return captures(spark, sf).where("http_status_code BETWEEN 200 AND 299").orderBy(F.desc("captured_at"), "capture_id").limit(5).select("capture_id", "page_url", "captured_at")


def ops_collection_history(spark: SparkSession, sf: str) -> DataFrame:
    """A page of the domains by their last activity, with their totals and captures, after a cursor."""
    a = table(spark, sf, "domain_activity").distinct().where("domain IS NOT NULL").groupBy("domain").agg(F.max("as_of").alias("last_at"), F.sum("started").alias("started"))
    c = captures(spark, sf).groupBy(host(F.col("page_url")).alias("domain")).agg(F.count(F.lit(1)).alias("captures"))
    rows = a.join(c, "domain", "left").withColumn("captures", F.coalesce("captures", F.lit(0)))
    return cursors.page(rows, ["last_at", "domain"], PAGE_ROWS, HISTORY_AFTER)


def ops_lineage(spark: SparkSession, sf: str) -> DataFrame:
    """A page of what is known of each address: its captures, and the captures whose pages link to it."""
    c = captures(spark, sf)
    own = c.select(F.col("page_url").alias("address"), F.lit("captured").alias("how"), "capture_id")
    linked = table(spark, sf, "link").select(F.col("target_url").alias("address"), "capture_id").distinct()
    known = linked.join(c.select(F.col("page_url").alias("address")), "address", "left_semi").select("address", F.lit("linked").alias("how"), "capture_id")
    return cursors.page(own.unionByName(known).distinct(), ["address", "how", "capture_id"], PAGE_ROWS, LINEAGE_AFTER, descending=False)


def ops_arrivals(spark: SparkSession, sf: str) -> DataFrame:
    """A page of the captures as they arrived, with whether their content can be read yet."""
    present = table(spark, sf, "html_element").select("content_id").distinct().withColumn("ready", F.lit(True))
    c = captures(spark, sf).select("captured_at", "capture_id", "content_id").distinct()
    rows = c.join(present, "content_id", "left").withColumn("ready", F.coalesce("ready", F.lit(False)))
    return cursors.page(rows, ["captured_at", "capture_id"], PAGE_ROWS, ARRIVALS_AFTER, descending=False)


def _stored_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Documents with text, one for each text: the first by number."""
    d = table(spark, sf, "documents").where("text IS NOT NULL").withColumn("object_key", F.sha2("text", 256))
    return d.groupBy("object_key").agg(
        F.min("doc_id").alias("doc_id"), F.min_by("source", "doc_id").alias("source"), F.count(F.lit(1)).alias("copies"), F.min(F.octet_length("text")).cast("bigint").alias("bytes")
    )


def ops_documents(spark: SparkSession, sf: str) -> DataFrame:
    """The second page of the stored documents, the largest first."""
    return _stored_documents(spark, sf).orderBy(F.desc("bytes"), "doc_id").offset(50).limit(50)


def ops_documents_summary(spark: SparkSession, sf: str) -> DataFrame:
    return _stored_documents(spark, sf).agg(F.count(F.lit(1)).alias("objects"), F.sum("copies").alias("documents"), F.sum("bytes").alias("unique_bytes"), F.sum(F.col("bytes") * F.col("copies")).alias("all_bytes"))


def ops_media_types(spark: SparkSession, sf: str) -> DataFrame:
    return feed.documents(feed.pages(spark, sf)).select(F.lower("detected_media_type").alias("media_type")).distinct().orderBy("media_type")


def ops_download(spark: SparkSession, sf: str) -> DataFrame:
    """For each stored content the document by which it is downloaded: the least one."""
    d = feed.documents(feed.pages(spark, sf))
    return d.groupBy("object_key").agg(F.min("document_id").alias("document_id"), F.min_by("content_bytes", "document_id").alias("content_bytes"))


def ops_objects(spark: SparkSession, sf: str) -> DataFrame:
    """Every stored body, packed and opened again with size and hash checked."""
    p = feed.pages(spark, sf)
    back = objects.opened(objects.stored(feed.contents(p)))
    return back.select("content_sha256", F.octet_length("html").cast("bigint").alias("bytes"), (F.sha2("html", 256) == F.col("content_sha256")).alias("same"), "problem")


def ops_arrow(spark: SparkSession, sf: str) -> DataFrame:
    """A small relation through an Arrow IPC file."""
    data = table(spark, sf, "nation").toArrow()  # 25 rows
    sink = pa.BufferOutputStream()
    with pa.ipc.new_file(sink, data.schema) as w:
        w.write_table(data)
    return objects.read_ipc(spark, "nation_ipc", sink.getvalue().to_pybytes())


def ops_columns(spark: SparkSession, sf: str) -> DataFrame:
    """The catalogue's columns of the evidence views."""
    names = ("capture", "html_element", "html_jsonld", "link")
    register(spark, sf, *names)
    return spark.createDataFrame([(n, c.name) for n in names for c in spark.catalog.listColumns(n)], "table_name string, column_name string")


def ops_frontier_order(spark: SparkSession, sf: str) -> DataFrame:
    """The deliveries that are claimed next of each kind."""
    d = table(spark, sf, "frontier_delivery").select("delivery_no", "kind", "delivered_at")
    return queue.claims(d, "kind", ["delivered_at", "delivery_no"], CLAIMED)


def _sorted_out(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "frontier_delivery")
    needs = F.when(F.col("kind") == "capture", "$.acquisition_id").when(F.col("kind") == "observation", "$.visit.visit_id").otherwise("$.record_id")
    # A generation above 2 stands for a field the consumer does not know.
    payload = F.when(F.get_json_object("payload", "$.generation").cast("int") > 2, '{"generation":3}').otherwise(F.col("payload"))
    return queue.sorted_out(d, delivery.canonical_message_id(F.col("message_id")), payload, needs, MOST_DELIVERIES)


def ops_dead_letters(spark: SparkSession, sf: str) -> DataFrame:
    return _sorted_out(spark, sf).where("reason IS NOT NULL").select("delivery_no", "message_id", "reason")


def ops_requeued(spark: SparkSession, sf: str) -> DataFrame:
    """Dead letters for a missing field, repaired from the identifier, among those that can be processed."""
    rows = _sorted_out(spark, sf).select("delivery_no", "message_id", "kind", "payload", "reason")
    dead = rows.where("reason = 'missing field'")
    repaired = dead.select("delivery_no", F.concat(F.lit('{"acquisition_id":"'), F.split_part("message_id", F.lit(":"), F.lit(2)), F.lit('"}')).alias("payload"))
    both = rows.where("reason IS NULL").unionByName(queue.requeued(dead, repaired, "delivery_no"))
    return both.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.get_json_object("payload", "$.acquisition_id").isNotNull()).alias("with_acquisition"))


def ops_asof(spark: SparkSession, sf: str) -> DataFrame:
    """Each event with the last purchase-like event of its user before it."""
    e = table(spark, sf, "events")
    bought = e.where("event_type = 'purchase'").select("user_id", "ts", F.col("event_id").alias("last_purchase"), F.col("value").alias("last_value"))
    return asof.asof_join(e.select("event_id", "user_id", "ts"), bought, "user_id", "ts", ["last_purchase", "last_value"], "7 days")


def stream_sessions(spark: SparkSession, sf: str) -> DataFrame:
    """Sessions of each user: events no more than half an hour apart."""
    schema = table(spark, sf, "events").schema
    e = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf).withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", "1 hour")
    out = e.groupBy(F.session_window("at", "30 minutes"), "user_id").agg(F.count(F.lit(1)).alias("n"), F.max("event_id").alias("last_event"))
    return drained(out, "complete").select("user_id", F.col("session_window.start").cast("timestamp_ntz").alias("start"), "n", "last_event")


# -- the query service ------------------------------------------------------------------------------------------------
# Statements and what becomes of them.
STATEMENTS = (
    ("SELECT 1 AS x", "ok"), ("SELECT count(*) AS n FROM public_v1.capture", "ok"), ("WITH a AS (SELECT * FROM nation) SELECT n_name FROM a", "ok"), ("DESCRIBE nation", "ok"),
    ("SUMMARIZE region", "ok"), ("EXPLAIN SELECT * FROM nation", "ok"), ("SHOW TABLES FROM public_v1", "ok"), ("SELECT n_name FROM nation WHERE n_name COLLATE NOCASE = 'france'", "ok"),
    ("DROP TABLE nation", "sql_invalid"), ("SELECT 1; SELECT 2", "sql_invalid"), ("SELECT * FROM secrets", "sql_invalid"), ("SELECT * FROM a.b.nation", "sql_invalid"),
    ("SELECT * FROM read_csv('/etc/passwd')", "sql_invalid"), ("SELECT getenv('HOME')", "sql_invalid"), ("SELECT (SELECT max(x) FROM hidden)", "sql_invalid"),
    ("SELECT 1 WHERE 1 IN (SELECT k FROM hidden)", "sql_invalid"), ("SELECT 1 WHERE EXISTS (SELECT 1 FROM nation n WHERE n.n_name IN (SELECT reflect('a', 'b')))", "sql_invalid"),
    ("SELECT current_setting('x')", "sql_invalid"), ("FROM nation", "sql_invalid"), ("SELECT * FROM nation ASOF JOIN region USING (r)", "sql_invalid"), ("SET x = 1", "sql_invalid"),
    ("SELECT error('no') AS e", "query_failed"), ("SELECT nothing FROM nation", "sql_invalid"),
)
SHAPES = ("SELECT a FROM t WHERE b = 1", "select  a from t where b=2", "SELECT a FROM t WHERE b IN (1, 2, 3)", "SELECT a FROM t WHERE b IN ('x')", "SELECT c FROM t WHERE b = 1")
RELATIONS = ("nation", "region", "capture", "orders", "page")


def _engine(spark: SparkSession, sf: str) -> Engine:
    register(spark, sf, "nation", "region", "capture", "orders")
    return Engine(spark, RELATIONS)


def engine_statements(spark: SparkSession, sf: str) -> DataFrame:
    engine, rows = _engine(spark, sf), []
    for i, (sql, _) in enumerate(STATEMENTS):
        try:
            engine.execute(sql, limits=Limits(max_seconds=120))
            rows.append((i, "ok"))
        except QueryError as e:
            rows.append((i, e.code))
    return spark.createDataFrame(rows, "statement int, outcome string")


def engine_limits(spark: SparkSession, sf: str) -> DataFrame:
    """What bounds do to a result of 25 rows: rows given and why it ends."""
    engine, rows = _engine(spark, sf), []
    for name, limits in (("none", Limits(max_seconds=120)), ("rows", Limits(max_rows=7, max_seconds=120)), ("bytes", Limits(max_bytes=40, max_seconds=120))):
        r = engine.execute("SELECT n_nationkey FROM nation ORDER BY n_nationkey", limits=limits)
        rows.append((name, len(r.rows) if name != "bytes" else None, r.truncated))
    return spark.createDataFrame(rows, "bound string, n int, truncated string")


def engine_shapes(spark: SparkSession, sf: str) -> DataFrame:
    """Statements that differ in literals alone have one shape: the first of each."""
    found = [shape(s) for s in SHAPES]
    return spark.createDataFrame([(i, found.index(x)) for i, x in enumerate(found)], "statement int, first_alike int")


def engine_urls(spark: SparkSession, sf: str) -> DataFrame:
    """Seed addresses by SQL, normalised and each once."""
    engine = _engine(spark, sf)
    sql = "SELECT url FROM (VALUES (1, 'HTTPS://A.example:443'), (2, 'https://a.example/#x'), (3, 'mailto:x'), (4, 'http://b.example:8080/p?q#f')) t(i, url) ORDER BY i"
    return spark.createDataFrame([(u,) for u in engine.urls(sql, 10)], "url string")


def engine_describe(spark: SparkSession, sf: str) -> DataFrame:
    return _engine(spark, sf).prepare("DESCRIBE orders").frame.select("column_name")


def engine_summarize(spark: SparkSession, sf: str) -> DataFrame:
    s = summarize(table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus"))
    return s.select("column_name", "min", "max", F.col("count"), F.col("null_percentage").cast("double").alias("null_percentage"))


def engine_collate(spark: SparkSession, sf: str) -> DataFrame:
    return _engine(spark, sf).frame(COLLATED)[1]


COLLATED = "SELECT n_nationkey, n_name FROM nation WHERE n_name COLLATE NOCASE IN ('nation_1', 'Nation_02', 'FRANCE', 'japan') OR n_name COLLATE NOCASE LIKE 'NATION%3'"

QUERIES = {
    f.__name__: f
    for f in (
        ops_latest_successes, ops_collection_history, ops_lineage, ops_arrivals, ops_documents, ops_documents_summary, ops_media_types, ops_download, ops_objects, ops_arrow, ops_columns,
        ops_frontier_order, ops_dead_letters, ops_requeued, ops_asof, stream_sessions, engine_statements, engine_limits, engine_shapes, engine_urls, engine_describe, engine_summarize, engine_collate,
    )
}

_CAP = "cap AS (SELECT DISTINCT * FROM capture)"
_HOST = "lower(regexp_extract(page_url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]+)', 1))"
_STORED = "d AS (SELECT sha256(text) AS object_key, min(doc_id) AS doc_id, arg_min(source, doc_id) AS source, count(*) AS copies, min(octet_length(encode(text)))::BIGINT AS bytes FROM documents WHERE text IS NOT NULL GROUP BY 1)"


def _cursor(*keys: str) -> str:
    return "to_base64(encode('[' || " + " || ',' || ".join(f"to_json({k})::VARCHAR" for k in keys) + " || ']')) AS cursor"


def _time(c: str) -> str:
    """A timestamp as Spark writes it: no more digits of the second than it has."""
    return f"regexp_replace(regexp_replace(strftime({c}, '%Y-%m-%d %H:%M:%S.%f'), '0+$', ''), '\\.$', '')"


def _letters() -> str:
    from cairnlake.plans.pipeline import _NAMED

    return _NAMED + f""", counted AS (SELECT message_id FROM ids WHERE stream = 'frontier_delivery' GROUP BY 1 HAVING count(*) > {MOST_DELIVERIES}),
letters AS (SELECT f.delivery_no, i.message_id, f.kind, f.payload, CASE WHEN i.message_id IS NULL THEN 'no identifier' WHEN f.kind = 'capture' AND (f.payload->>'$.generation')::INT > 2 THEN 'missing field'
  WHEN i.message_id IN (SELECT message_id FROM counted) THEN 'too many deliveries' END AS reason
  FROM frontier_delivery f JOIN ids i ON i.stream = 'frontier_delivery' AND i.delivery_no = f.delivery_no)"""


def _values(rows) -> str:
    return ", ".join("(" + ", ".join("NULL" if v is None else "'" + v + "'" if isinstance(v, str) else str(v) for v in r) + ")" for r in rows)


ORACLES = {
    "ops_latest_successes": f"WITH {_CAP} SELECT capture_id, page_url, captured_at FROM cap WHERE http_status_code BETWEEN 200 AND 299 ORDER BY captured_at DESC, capture_id LIMIT 5",
    "ops_collection_history": f"WITH {_CAP}, a AS (SELECT domain, max(as_of) AS last_at, sum(started)::BIGINT AS started FROM (SELECT DISTINCT * FROM domain_activity) WHERE domain IS NOT NULL GROUP BY 1), c AS (SELECT {_HOST} AS domain, count(*) AS captures FROM cap GROUP BY 1) SELECT a.*, coalesce(captures, 0) AS captures, {_cursor(_time('last_at'), 'domain')} FROM a LEFT JOIN c USING (domain) WHERE (last_at, domain) < (TIMESTAMP '2030-01-01 00:00:00', 'm') ORDER BY last_at DESC, domain DESC LIMIT {PAGE_ROWS}",
    "ops_lineage": f"WITH r AS (SELECT DISTINCT page_url AS address, 'captured' AS how, capture_id FROM capture UNION SELECT target_url, 'linked', capture_id FROM link WHERE target_url IN (SELECT page_url FROM capture)) SELECT *, {_cursor('address', 'how', 'capture_id')} FROM r WHERE address IS NOT NULL AND capture_id IS NOT NULL AND (address, how, capture_id) > ('https://m', 'captured', '0') ORDER BY address, how, capture_id LIMIT {PAGE_ROWS}",
    "ops_arrivals": f"WITH c AS (SELECT DISTINCT captured_at, capture_id, content_id FROM capture) SELECT *, coalesce(content_id IN (SELECT content_id FROM html_element), FALSE) AS ready, {_cursor(_time('captured_at'), 'capture_id')} FROM c WHERE (captured_at, capture_id) > (TIMESTAMP '2015-01-10 00:00:00', '8') ORDER BY captured_at, capture_id LIMIT {PAGE_ROWS}",
    "ops_documents": f"WITH {_STORED} SELECT * FROM d ORDER BY bytes DESC, doc_id LIMIT 50 OFFSET 50",
    "ops_documents_summary": f"WITH {_STORED} SELECT count(*) AS objects, sum(copies)::BIGINT AS documents, sum(bytes)::BIGINT AS unique_bytes, sum(bytes * copies)::BIGINT AS all_bytes FROM d",
    "ops_media_types": "SELECT DISTINCT CASE WHEN source IS NULL THEN 'application/pdf' ELSE 'text/html' END AS media_type FROM documents WHERE text IS NOT NULL",
    "ops_download": feed.ORACLES["view_capture"].replace(f" FROM {feed._HTML}", ", 'd' || doc_id AS document_id FROM page WHERE text IS NOT NULL").replace(" SELECT 'v'", ", dl AS (SELECT 'v'", 1) + ") SELECT 'o/' || content_id AS object_key, min(document_id) AS document_id, arg_min(byte_length, document_id) AS content_bytes FROM dl GROUP BY content_id",
    "ops_objects": feed.ORACLES["view_capture"].replace(f" FROM {feed._HTML}", " FROM page WHERE text IS NOT NULL").replace(" SELECT 'v'", ", dl AS (SELECT 'v'", 1) + ") SELECT DISTINCT content_id AS content_sha256, byte_length AS bytes, TRUE AS same, NULL::VARCHAR AS problem FROM dl",
    "ops_arrow": "SELECT * FROM nation",
    "ops_columns": "SELECT table_name, column_name FROM duckdb_columns() WHERE table_name IN ('capture', 'html_element', 'html_jsonld', 'link')",
    "ops_frontier_order": f"SELECT delivery_no, kind, delivered_at, row_number() OVER (PARTITION BY kind ORDER BY delivered_at, delivery_no)::INT AS place FROM frontier_delivery QUALIFY place <= {CLAIMED}",
    "ops_dead_letters": _letters() + " SELECT delivery_no, message_id, reason FROM letters WHERE reason IS NOT NULL",
    "ops_requeued": _letters() + " SELECT kind, count(*) AS n, count(*) FILTER (WHERE reason = 'missing field' OR payload->>'$.acquisition_id' IS NOT NULL) AS with_acquisition FROM letters WHERE reason IS NULL OR reason = 'missing field' GROUP BY kind",
    "ops_asof": "SELECT e.event_id, e.user_id, e.ts, b.event_id AS last_purchase, b.value AS last_value FROM events e LEFT JOIN events b ON b.event_type = 'purchase' AND b.user_id = e.user_id AND b.ts <= e.ts QUALIFY row_number() OVER (PARTITION BY e.event_id ORDER BY b.ts DESC, b.event_id DESC) = 1",
    "stream_sessions": "WITH g AS (SELECT *, sum(CASE WHEN ts < before + INTERVAL 30 MINUTE THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events)) SELECT user_id, min(ts) AS start, count(*) AS n, max(event_id) AS last_event FROM g GROUP BY user_id, s",
    "engine_statements": f"SELECT * FROM (VALUES {_values([(i, c) for i, (_, c) in enumerate(STATEMENTS)])}) t(statement, outcome)",
    "engine_limits": "SELECT * FROM (VALUES ('none', 25, NULL), ('rows', 7, 'rows'), ('bytes', NULL, 'bytes')) t(bound, n, truncated)",
    "engine_shapes": "SELECT * FROM (VALUES (0, 0), (1, 0), (2, 2), (3, 2), (4, 4)) t(statement, first_alike)",
    "engine_urls": "SELECT * FROM (VALUES ('https://a.example/'), ('http://b.example:8080/p?q')) t(url)",
    "engine_describe": "SELECT column_name FROM (DESCRIBE orders)",
    "engine_summarize": "SELECT column_name, min, max, count, null_percentage::DOUBLE AS null_percentage FROM (SUMMARIZE SELECT o_orderkey, o_custkey, o_orderstatus FROM orders)",
    "engine_collate": COLLATED,
}
