from collections import Counter

from pyspark.sql import functions as F

from cairnlake.operators import skew


def test_heavy_keys_exact_at_the_bound(spark):
    data = ["hot"] * 100 + ["even"] * 10 + ["below"] * 9 + [f"k{i}" for i in range(281)] + [None] * 500
    df = spark.createDataFrame([(x, "n") for x in data], "k string, n string")
    got = {r.key: r.n for r in skew.heavy_keys(df, "k", 1 / 40).collect()}
    assert got == {"hot": 100, "even": 10}


def test_heavy_keys_of_empty_and_null_tables(spark):
    assert skew.heavy_keys(spark.createDataFrame([], "k string"), "k", 0.025).count() == 0
    assert skew.heavy_keys(spark.createDataFrame([(None,)] * 5, "k string"), "k", 0.025).count() == 0


def test_sums_and_distincts(spark):
    data = [("a" if i % 3 == 0 else None if i % 50 == 1 else f"k{i % 90}", i % 7, f"c{i % 11}" if i % 5 else None) for i in range(3000)]
    df = spark.createDataFrame(data, "k string, v int, c string").withColumn("is_heavy", F.lit(1)).withColumn("key", F.lit("x"))
    got = {r.key_value: r for r in skew.aggregate_by_key(df, "k", {"n": F.lit(1), "s": F.col("v")}, distinct={"d": F.col("c")}).collect()}
    n, s, d = Counter(), Counter(), {}
    for k, v, c in data:
        n[k] += 1
        s[k] += v
        d.setdefault(k, set()).update({c} - {None})
    assert {k: (r.n, r.s, r.d) for k, r in got.items()} == {k: (n[k], s[k], len(d[k])) for k in n}
    assert got["a"].is_heavy and not got[None].is_heavy
    assert skew.aggregate_by_key(df.limit(0), "k", {"n": F.lit(1)}).count() == 0


def test_join_by_key(spark):
    facts = spark.createDataFrame([("hot" if i % 2 else None if i % 50 == 0 else f"k{i % 70}", i) for i in range(2000)], "k string, v int")
    dim = spark.createDataFrame([("hot", "h", 1), *[(f"k{i}", f"d{i}", i) for i in range(0, 70, 4)]], "key string, name string, v int")
    got = sorted(tuple(r) for r in skew.join_by_key(facts, "k", dim, "key").fillna("-").collect())
    assert got == sorted(tuple(r) for r in facts.join(dim.select(F.col("key").alias("k"), "name"), "k", "left").select("k", "v", "name").fillna("-").collect())
    assert skew.join_by_key(facts.limit(0), "k", dim, "key").count() == 0
