import datetime as dt
import hashlib

import pytest
from pyspark.sql import functions as F

from cairnlake.functions import identity
from cairnlake.operators import evidence, projections
from cairnlake.plans import views
from cairnlake.schemas import TABLES
from cairnlake.sources.lake import CommitConflict, EvidenceConflict, Lake, RewrittenRange, validations
from cairnlake.streaming.live import follow, materialize, rebuild

T0 = dt.datetime(2024, 1, 1)
PAGES = {
    "p1": '<html lang="en"><head><title>One</title><meta name="d" content="x"></head><body> <h1>Cats</h1> <a href="/two">two</a> <a href="/two">again</a></body></html>',
    "p2": '<p>fish and cats</p> <a href="https://other.example/">o</a><script type="application/ld+json">{"@type":"Thing"}</script>',
}


def made(spark, n=5):
    """Visits 0 and 1 share a content, 2 has another, 3 is a PDF, 4 failed."""
    visits, docs, contents = [], [], {}
    for i in range(n):
        vid, html = f"v{i}", PAGES["p1" if i < 2 else "p2"]
        at = T0 + dt.timedelta(hours=i)
        did = f"d{i}" if i < 4 else None
        visits.append((vid, f"https://a.example/{min(i, 1)}", None if i else "https://a.example/zero", at, at, at, at, "succeeded" if i < 4 else "failed", 200, did, '{"retention_days": 30}'))
        if did:
            sha = hashlib.sha256(html.encode()).hexdigest()
            contents[sha] = html
            docs.append((did, vid, None, at, "rendered_html", None, ["text/html", "TEXT/HTML", "text/html", "application/pdf"][min(i, 3)], "utf-8", sha, len(html), f"o/{sha}", "zstd", 10))
    return (
        spark.createDataFrame(visits, TABLES["visits"].schema), spark.createDataFrame(docs, TABLES["documents"].schema),
        spark.createDataFrame(list(contents.items()), "content_sha256 string, html string"),
    )


def state(lake):
    return {t: sorted(map(str, lake.read(t).collect())) for t in ("html_elements", "html_terms", "html_jsonld", "link_occurrences", "visit_readiness")}


def test_append_is_idempotent_and_detects_conflicts(spark, tmp_path):
    lake = Lake(spark, str(tmp_path))
    visits, docs, _ = made(spark)
    lake.append({"visits": visits.unionByName(visits), "documents": docs}, receipt="r1")
    v1 = lake.manifest().version
    assert lake.append({"visits": visits}, receipt="r1").version == v1
    assert lake.append({"visits": visits}).version == v1 and lake.read("visits").count() == 5
    with pytest.raises(EvidenceConflict):
        lake.append({"visits": visits.withColumn("status_code", F.lit(500))})
    with pytest.raises(EvidenceConflict):
        lake.append({"visits": visits.withColumn("visit_id", F.lit("same"))})
    with pytest.raises(ValueError, match="required"):
        lake.append({"visits": visits.withColumn("outcome", F.lit(None).cast("string"))})
    assert lake.read("visits", 0).count() == 0 and lake.changes("visits", 0).count() == 5
    with pytest.raises(CommitConflict):
        lake.commit(lake.manifest(0), {})
    assert {r.table_name: r.files for r in lake.inventory().collect()} == {"visits": 1, "documents": 1}


def test_rebuild_equals_incremental(spark, tmp_path):
    visits, docs, contents = made(spark)
    a, b = Lake(spark, str(tmp_path / "a")), Lake(spark, str(tmp_path / "b"))
    for lake in (a, b):
        lake.append({"visits": visits, "documents": docs})
    rebuild(a, contents)
    for i in (3, 0, 1, 4, 2):
        materialize(b, visits.where(F.col("visit_id") == f"v{i}"), docs, contents, receipt=f"batch {i}")
    materialize(b, visits, docs, contents, receipt="batch 0")  # a receipt that is known
    materialize(b, visits, docs, contents)  # and a replay without one
    assert state(a) == state(b)
    assert len(a.read("link_occurrences").collect()) == 5 and set(validations(a).values()) == {0}
    before = a.manifest().version
    a.compact("html_elements")
    assert state(a) == state(b) and a.reclaimable(a.manifest().version) and not a.reclaimable(1)
    assert a.read("html_elements", before).count() == a.read("html_elements").count()


def test_stream_materialises_each_visit_once(spark, tmp_path):
    visits, docs, contents = made(spark)
    lake = Lake(spark, str(tmp_path / "lake"))
    lake.append({"documents": docs})
    inbox = str(tmp_path / "in")
    visits.limit(3).coalesce(1).write.parquet(inbox)
    run = lambda: follow(spark, lake, inbox, lambda: contents, str(tmp_path / "cp")).awaitTermination()
    run()
    visits.coalesce(1).write.mode("append").parquet(inbox)  # some are delivered again
    run()
    run()
    assert lake.read("visits").count() == 5 and lake.read("visit_readiness").count() == 5
    assert set(validations(lake).values()) == {0}


def test_views_of_a_graph(spark, tmp_path):
    visits, docs, contents = made(spark)
    pages = projections.project(contents).cache()
    links = projections.link_occurrences(pages, visits, docs)
    views.install(spark, visits, docs, projections.html_elements(pages), projections.html_jsonld(pages), projections.html_terms(pages), links)
    assert spark.table("capture").count() == 3 and spark.table("experimental_capture").count() == 3
    assert {r.url for r in spark.table("page").collect()} == {"https://a.example/0", "https://a.example/1", "https://a.example/zero", "https://a.example/two", "https://other.example/"}
    assert spark.table("link").count() == 5
    meta = {(r.kind, r.name, r.value) for r in spark.table("html_metadata").collect()}
    assert {("title", None, "One"), ("meta_name", "d", "x"), ("html_attribute", "lang", "en")} == meta
    assert [r.value for r in spark.table("html_jsonld").collect()] == ['{"@type":"Thing"}']
    assert spark.sql("SELECT DISTINCT c.page_url FROM search(array('cats')) s JOIN capture c USING (content_id)").count() == 2
    nav = projections.navigation(pages, contents.where("html LIKE '%fish%'").first()[0], "https://a.example/1")
    assert [(r.target_host, r.relation_scope) for r in nav.collect()] == [("other.example", "external")]


def test_purge_keeps_shared_content(spark, tmp_path):
    visits, docs, contents = made(spark)
    lake = Lake(spark, str(tmp_path))
    lake.append({"visits": visits, "documents": docs})
    rebuild(lake, contents)
    n = lake.read("html_elements").count()
    assert lake.retention_plan("2024-01-10").count() == 0 and lake.retention_plan("2024-03-01").count() == 5
    lake.purge(visits.where("visit_id = 'v0'").select("visit_id"))
    assert lake.read("html_elements").count() == n and lake.read("visits").count() == 4
    lake.purge(visits.where("visit_id = 'v1'").select("visit_id"))
    assert 0 < lake.read("html_elements").count() < n and set(validations(lake).values()) == {0}


def test_owner_is_the_least_document(spark):
    _, docs, _ = made(spark)
    first = {r.content_sha256: r.document_id for r in projections.owners(docs).collect()}
    assert sorted(first.values()) == ["d0", "d2"]
    assert "d1" in {r.document_id for r in projections.owners(docs, docs.where("document_id = 'd0'")).collect()}


def test_evidence_rules(spark):
    visits, docs, contents = made(spark)
    assert evidence.visit_problems(visits).count() == 0
    bad = visits.withColumn("outcome", F.lit("odd")).withColumn("status_code", F.lit(99))
    assert {r.rule for r in evidence.visit_problems(bad).collect()} == {"outcome", "status", "document only if succeeded"}
    assert {r.rule for r in evidence.document_problems(docs).collect()} == {"derived id"}
    fixed = docs.withColumn("document_id", identity.document_id(F.col("visit_id")))
    assert evidence.document_problems(fixed).count() == 0
    assert evidence.content_problems(contents, docs).count() == 0
    assert {r.rule for r in evidence.content_problems(contents.withColumn("html", F.lit("x")), docs).collect()} == {"hash"}
    wanted = spark.createDataFrame([(f"v{i}",) for i in range(6)], "visit_id string")
    ready = spark.createDataFrame([("v0",), ("v2",)], "visit_id string")
    present = contents.where("html LIKE '%Cats%'").select("content_sha256")
    got = {r.visit_id: r.reason for r in evidence.observation_readiness(wanted, visits, docs, ready, present).collect()}
    assert got == {"v0": "ready", "v1": "pending", "v2": "missing_content", "v3": "not_html", "v4": "failed", "v5": "unknown"}


def test_rows_with_moved_values_are_other_evidence(spark, tmp_path):
    visits, _, _ = made(spark)
    lake = Lake(spark, str(tmp_path))
    one = visits.where("visit_id = 'v1'").withColumn("effective_url", F.lit("x")).withColumn("document_id", F.lit(None).cast("string"))
    lake.append({"visits": one})
    with pytest.raises(EvidenceConflict):
        lake.append({"visits": one.withColumn("effective_url", F.lit(None).cast("string")).withColumn("document_id", F.lit("x"))})
    with pytest.raises(EvidenceConflict):
        lake.append({"visits": one.withColumn("finished_at", F.col("finished_at") + F.expr("INTERVAL 1 MICROSECOND"))})


def test_rebuild_catches_up(spark, tmp_path):
    visits, docs, contents = made(spark)
    a, b = Lake(spark, str(tmp_path / "a")), Lake(spark, str(tmp_path / "b"))
    a.append({"visits": visits.where("visit_id < 'v2'"), "documents": docs})
    rebuild(a, contents, lambda: a.append({"visits": visits}))
    b.append({"visits": visits, "documents": docs})
    rebuild(b, contents)
    assert state(a) == state(b) and set(validations(a).values()) == {0}
    with pytest.raises(RewrittenRange):
        a.changes("html_elements", 1)
    assert a.changes("visits", 1).count() == 3


def test_a_swap_on_an_old_snapshot_fails(spark, tmp_path):
    visits, docs, _ = made(spark)
    lake = Lake(spark, str(tmp_path))
    lake.append({"documents": docs})
    base = lake.manifest()
    lake.append({"visits": visits}, receipt="r")
    assert lake.committed("r") and not lake.committed("s")
    with pytest.raises(CommitConflict):
        lake.replace({"documents": docs.limit(1)}, "late", base)


def test_reclamation_has_grace_and_limit(spark, tmp_path):
    visits, _, _ = made(spark)
    lake = Lake(spark, str(tmp_path))
    for i in range(3):
        lake.append({"visits": visits.where(F.col("visit_id") == f"v{i}")})
    lake.compact("visits")
    now = lake.manifest().version
    assert len(lake.reclaimable(now)) == 3 and not lake.reclaimable(now, 3600) and not lake.reclaimable(1)
    assert len(lake.reclaim(now, 0.0, 2)) == 2 and len(lake.reclaim(now, 0.0)) == 1 and not lake.reclaim(now, 0.0)
    assert lake.read("visits").count() == 3
