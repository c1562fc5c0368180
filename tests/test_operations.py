import random

import pytest
from pyspark.sql import functions as F

from cairnlake.functions import cursors
from cairnlake.operators import asof, queue
from cairnlake.sources import objects


def test_cursors_walk_a_table(spark):
    df = spark.createDataFrame([(i % 7, f"k{i}") for i in range(40)] + [(None, "n")], "a int, b string")
    seen, after = [], None
    while True:
        rows = cursors.page(df, ["a", "b"], 9, after).collect()
        if not rows:
            break
        seen += [(r.a, r.b) for r in rows]
        after = rows[-1].cursor
    assert seen == sorted(((i % 7, f"k{i}") for i in range(40)), reverse=True)
    for broken in ("%%", cursors.encode("a"), "eyJhIjoxfQ=="):
        with pytest.raises(ValueError):
            cursors.decode(broken, 2)
    assert cursors.decode(cursors.encode("ü", None), 2) == ["ü", None]


def test_dead_letters(spark):
    data = [(1, "a", '{"x":1}'), (2, "b", "{"), (3, None, '{"x":1}'), (4, "c", "{}"), (5, "d", '{"x":1}'), (6, "d", '{"x":1}'), (7, "d", None)]
    df = spark.createDataFrame(data, "no int, message_id string, payload string")
    out = queue.sorted_out(df, F.col("message_id"), F.col("payload"), F.lit("$.x"), 2)
    assert {r.no: r.reason for r in out.collect()} == {1: None, 2: "bad payload", 3: "no identifier", 4: "missing field", 5: "too many deliveries", 6: "too many deliveries", 7: "bad payload"}
    again = queue.requeued(out.where("reason = 'missing field'"), spark.createDataFrame([(4, '{"x":2}')], "no int, payload string"), "no")
    assert [(r.no, r.payload, r.reason) for r in again.collect()] == [(4, '{"x":2}', None)]
    assert queue.sorted_out(df.limit(0), F.col("message_id"), F.col("payload"), F.lit("$.x"), 2).count() == 0


def test_asof_against_brute_force(spark):
    rng = random.Random(2)
    left = [(i, "hot" if i % 2 else rng.choice(["a", "b", None]), rng.choice([None, *range(400_000)])) for i in range(300)]
    right = [("hot" if i % 3 else rng.choice(["a", "c"]), rng.randrange(400_000), i) for i in range(200)] + [("b", None, 1), (None, 5, 2)]
    l = spark.createDataFrame(left, "i int, k string, s int").withColumn("t", F.timestamp_seconds("s"))
    r = spark.createDataFrame(right, "k string, s int, v int").withColumn("t", F.timestamp_seconds("s"))
    got = {x.i: x.v for x in asof.asof_join(l, r, "k", "t", ["v"], "1 day").collect()}

    def best(k, s):
        found = [(y, v) for q, y, v in right if k is not None and q == k and s is not None and y is not None and y <= s]
        return max(found)[1] if found else None

    assert got == {i: best(k, s) for i, k, s in left}
    assert asof.asof_join(l.limit(0), r, "k", "t", ["v"]).count() == 0


def test_objects_are_checked(spark):
    df = spark.createDataFrame([("x" * 5000,), ("ü",), ("",), (None,)], "html string").withColumn("content_sha256", F.sha2("html", 256)).select("content_sha256", "html")
    kept = objects.stored(df.unionByName(df))
    assert {r.storage_encoding for r in kept.collect()} == {"zstd", "identity"} and kept.count() == 3
    assert {r.problem for r in objects.opened(kept).collect()} == {None}
    bad = kept.withColumn("content_bytes", F.col("content_bytes") - 1).where("content_bytes > 100")
    assert [r.problem for r in objects.opened(bad).collect()] == ["size"]
    assert {r.problem for r in objects.opened(kept.withColumn("content_sha256", F.lit("0"))).collect()} == {"hash"}
    assert {r.problem for r in objects.opened(kept.withColumn("storage_encoding", F.lit("lzma"))).collect()} == {"encoding"}
    assert {r.problem for r in objects.opened(kept.where("content_bytes > 100"), most_bytes=100).collect()} == {"size"}
    with pytest.raises(ValueError):
        objects.read_ipc(spark, "big", b"x" * (objects.IPC_BYTES + 1))
