import json

import pytest

from cairnlake.plans import passes, views
from cairnlake.plans.dialect import UnsupportedSql, translate
from cairnlake.plans.engine import Engine, Limits, QueryError, exported, shape, wire


@pytest.fixture(scope="module")
def engine(spark):
    spark.createDataFrame([(f"c{i}", i, "p", f"say the word{i % 3} now") for i in range(30)], "content_id string, node_index int, tag string, text string").createOrReplaceTempView("html_element")
    spark.createDataFrame([("word1", "c1", [1]), ("word1", "c4", [4]), ("say", "c1", [1])], "term string, content_sha256 string, node_indexes array<int>").createOrReplaceTempView("html_terms")
    spark.createDataFrame([("u1", "c1"), ("u2", None)], "page_url string, content_id string").createOrReplaceTempView("capture")
    return Engine(spark, ["html_element", "capture"], passes=[(passes.NAME, passes.exact_text)])


ACCEPT = [
    "SELECT 1", "SELECT * FROM capture", "SELECT * FROM public_v1.capture", "WITH a AS (SELECT * FROM capture) SELECT * FROM a UNION ALL SELECT * FROM capture",
    "SELECT page_url FROM capture c WHERE EXISTS (SELECT 1 FROM html_element h WHERE h.content_id = c.content_id);", "EXPLAIN SELECT * FROM capture",
    "EXPLAIN ANALYZE SELECT 1", "DESCRIBE capture", "DESCRIBE SELECT 1 AS x", "SUMMARIZE capture", "SHOW TABLES FROM public_v1",
    "SELECT a FROM (VALUES (1), (2)) t(a) ORDER BY a LIMIT 1", "SELECT count(*) FROM html_element, capture",
]
REJECT = [
    "", "DROP TABLE capture", "INSERT INTO capture VALUES (1)", "SELECT 1; SELECT 2", "SELECT * FROM secrets", "SELECT * FROM other.capture", "SELECT * FROM a.b.capture",
    "SET x = 1", "CREATE TABLE t AS SELECT 1", "SELECT * FROM parquet.`/etc/x`", "SELECT reflect('java.lang.System', 'getProperty', 'x')", "SELECT java_method('a', 'b')",
    "SELECT input_file_name() FROM capture", "SELECT * FROM read_csv('x')", "SHOW TABLES FROM ingest", "SHOW ALL TABLES", "SELECT getenv('HOME')", "FROM capture",
    "SELECT * EXCLUDE (page_url) FROM capture", "SELECT COLUMNS('x') FROM capture", "SELECT * FROM capture ASOF JOIN html_element USING (content_id)",
    "SELECT (SELECT max(x) FROM hidden)", "WITH capture2 AS (SELECT * FROM nowhere) SELECT * FROM capture2", "SELECT {'a': 1}", "ADD JAR x",
]


@pytest.mark.parametrize("sql", ACCEPT)
def test_accepted(engine, sql):
    assert engine.prepare(sql).frame is not None


@pytest.mark.parametrize("sql", REJECT)
def test_rejected(engine, sql):
    with pytest.raises(QueryError) as e:
        engine.prepare(sql)
    assert e.value.code == "sql_invalid"


def test_limits(engine):
    r = engine.execute("SELECT node_index FROM html_element ORDER BY node_index", limits=Limits(max_rows=5))
    assert [x[0] for x in r.rows] == [0, 1, 2, 3, 4] and r.truncated == "rows"
    assert engine.execute("SELECT text FROM html_element", limits=Limits(max_bytes=100)).truncated == "bytes"
    assert engine.execute("SELECT 1 AS x").truncated is None
    with pytest.raises(QueryError) as e:
        engine.execute("SELECT ?", [1] * 101)
    assert e.value.code == "resource_limit"
    engine._slot.acquire()
    try:
        with pytest.raises(QueryError) as e:
            engine.execute("SELECT 1")
        assert e.value.code == "service_busy"
    finally:
        engine._slot.release()


def test_parameters(engine):
    assert engine.execute("SELECT content_id FROM html_element WHERE node_index = ? AND tag = ?", [3, "p"]).rows == [["c3"]]
    assert engine.execute("SELECT content_id FROM html_element WHERE node_index = $1", [3]).rows == [["c3"]]
    assert engine.execute("SELECT content_id FROM html_element WHERE node_index = $n", {"n": 3}).rows == [["c3"]]


def test_stream_and_export(engine):
    frames = [json.loads(x) for x in engine.stream("SELECT node_index FROM html_element", batch_rows=10)]
    assert [f["type"] for f in frames] == ["metadata", "rows", "rows", "rows", "complete"]
    assert json.loads(next(engine.stream("DROP TABLE x")))["code"] == "sql_invalid"
    r = engine.execute("SELECT page_url, content_id FROM capture ORDER BY page_url")
    assert exported(r, "csv") == "page_url,content_id\nu1,c1\nu2,\n" and json.loads(exported(r, "json"))[1] == {"page_url": "u2", "content_id": None}
    assert engine.prepare("SELECT * FROM capture CROSS JOIN html_element").diagnostics[0]["code"] == "cartesian_product"


def test_wire():
    assert [wire(x) for x in (2**53, -5, float("nan"), float("inf"), b"ab", None, True, {"a": [2**60]})] == [str(2**53), -5, "NaN", "Infinity", "YWI=", None, True, {"a": [str(2**60)]}]


def test_shape():
    assert shape("SELECT a FROM t WHERE b = 1") == shape("select A from T where B='x'") != shape("SELECT a FROM t WHERE c = 1")
    assert shape("SELECT 1 IN (1, 2)") == shape("SELECT 1 IN (1, 2, 3, 4)")


def test_exact_text_pass_keeps_the_result(engine):
    sql = "SELECT content_id FROM html_element WHERE text = 'say the word1 now'"
    plain = sorted(map(tuple, engine.execute(sql).rows))
    assert len(plain) == 10
    for q, status in (
        ("SELECT content_id FROM html_element WHERE text = 'say it'", "not_applicable"),
        ("SELECT content_id FROM html_element WHERE text = 'a the b' OR tag = 'p'", "not_applicable"),
        ("SELECT h.content_id FROM html_element h JOIN capture c ON true WHERE text = 'say the word1 now'", "not_applicable"),
        ("SELECT content_id FROM html_element WHERE text = 'say the word1 now' LIMIT 2", "not_applicable"),
    ):
        assert engine.prepare(q, experimental=True).passes[0]["status"] == status, q
    p = engine.prepare(sql, experimental=True)
    assert p.passes[0]["status"] == "applied" and {r[0] for r in p.frame.collect()} <= {r[0] for r in plain}


def test_unsupported_names_the_construct():
    for sql, name in (("SELECT * FROM a POSITIONAL JOIN b", "POSITIONAL JOIN"), ("PIVOT t ON x", "PIVOT"), ("SELECT * FROM t USING SAMPLE 5", "USING SAMPLE"), ("SELECT x[1:2] FROM t", "list slice")):
        with pytest.raises(UnsupportedSql, match=name.replace("(", "\\(")):
            translate(sql)


def test_search(spark):
    t = spark.createDataFrame([("a", "c1", [3, 1]), ("b", "c1", [1, 5]), ("a", "c2", [2])], "term string, content_sha256 string, node_indexes array<int>")
    get = lambda terms: {r.content_id: (r.node_indexes, r.score) for r in views.search(t, terms).collect()}
    assert get(["a", "b", "a", None, ""]) == {"c1": ([1, 3, 5], 2.0), "c2": ([2], 1.0)}
    assert get(["b"]) == {"c1": ([1, 5], 1.0)} and get([]) == get(None) == {}
    with pytest.raises(ValueError, match="search accepts at most 32 term keys"):
        views.search(t, ["x"] * 33)
    t.createOrReplaceTempView("html_terms")
    spark.sql(views.SEARCH_SQL)
    assert {(r.content_id, r.score) for r in spark.sql("SELECT * FROM search(array('a', 'b', null))").collect()} == {("c1", 2.0), ("c2", 1.0)}


def test_dbapi_history_and_cases(engine, spark):
    from cairnlake.plans import cases, dbapi, history

    with dbapi.connect(engine) as c:
        cur = c.cursor().execute("SELECT node_index, tag FROM html_element WHERE node_index < ? ORDER BY node_index", [3])
        assert cur.fetchone() == (0, "p") and cur.fetchall() == [(1, "p"), (2, "p")] and cur.fetchone() is None
        assert [d[0] for d in cur.description] == ["node_index", "tag"] and cur.rowcount == 3
        with pytest.raises(dbapi.ProgrammingError):
            cur.execute("DROP TABLE x")
    e = history.executions(spark, engine.history)
    s = history.statistics(e).first()
    assert s.executions == len(engine.history) and s.failures >= 1
    assert history.trend(e).count() == 1 and {r.state for r in history.failures(e).collect()} >= {"sql_invalid"}
    assert history.patterns(e, 2).count() == 2
    out = cases.run(engine, cases.Case("x", "SELECT tag, count(*) AS n FROM html_element GROUP BY tag", "SELECT 'p' AS tag, count(*) AS n FROM html_element"))
    assert out["equal"] and not cases.run(engine, cases.Case("y", "SELECT 1 AS a", "SELECT 2 AS a"), 1)["equal"]


def test_urls(engine, spark):
    spark.createDataFrame([("HTTP://A.example#x",), ("http://a.example/",), ("nonsense",), ("https://b.example/p",)], "url string").createOrReplaceTempView("page")
    e = Engine(spark, ["page"])
    assert e.urls("SELECT url FROM page WHERE url NOT LIKE 'x%' ORDER BY url", 5) == ["http://a.example/", "https://b.example/p"]
    with pytest.raises(QueryError):
        e.urls("SELECT url AS u FROM page", 5)
    with pytest.raises(QueryError):
        e.urls("SELECT url FROM page", 1)


def test_deadline(engine, spark):
    from pyspark.sql import functions as F

    spark.range(4).select((F.col("id") % 2).alias("tag")).createOrReplaceTempView("slow")
    e = Engine(spark, ["slow"], limits=Limits(max_seconds=1.0))
    with pytest.raises(QueryError) as x:
        e.execute("SELECT count(*) FROM slow a, (SELECT explode(sequence(1, 40000)) AS i) b, (SELECT explode(sequence(1, 40000)) AS j) c WHERE a.tag + i * j % 7 = 3")
    assert x.value.code == "resource_limit"
