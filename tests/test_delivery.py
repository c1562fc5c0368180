from pyspark.sql import functions as F

from cairnlake.operators import delivery

U = "3d8dcad2-3911-5792-b0af-f68a64231398"
HEX = U.replace("-", "")


def ids(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    return [r[0] for r in df.select(delivery.canonical_message_id(F.col("t"))).collect()]


def test_spellings(spark):
    same = [f"capture:{U}:2", f" capture:{U.upper()}:2\n", f"capture:{HEX}:2", f"capture:{{{U}}}:2", f"capture:urn:uuid:{U}:2", f"capture:{U}:02", f" capture:{HEX.upper()}:2"]
    assert set(ids(spark, same)) == {f"capture:{U}:2"}
    assert ids(spark, [f"capture:{U}:3"]) == [f"capture:{U}:3"]
    assert ids(spark, [f"lineage:fulfillment:{HEX}", f"lineage:fulfillment_v2:{U}"]) == [f"lineage:fulfillment:{U}", f"lineage:fulfillment_v2:{U}"]
    assert ids(spark, [f"observation:{{{HEX.upper()}}}", None, "  ", "odd "]) == [f"observation:{U}", None, None, "odd"]


def test_once(spark):
    data = [(1, f"observation:{U}", 1), (2, "x", 1), (3, f"observation:{HEX} ", 2), (4, None, 2), (5, None, 3), (6, "y", 3), (7, "y", 3)]
    df = spark.createDataFrame(data, "delivery_no bigint, message_id string, copies int")
    got = {r.delivery_no: (r.message_id, r.copies) for r in delivery.deliver_once(df, delivery.canonical_message_id(F.col("message_id")), "delivery_no").collect()}
    assert got == {1: (f"observation:{U}", 2), 2: ("x", 1), 4: (None, 1), 5: (None, 1), 6: ("y", 2)}
    rep = {r.message_id: r.n for r in delivery.repeated_messages(df, delivery.canonical_message_id(F.col("message_id"))).collect()}
    assert rep == {f"observation:{U}": 2, "y": 2}
    assert delivery.deliver_once(df.limit(0), F.col("message_id"), "delivery_no").count() == 0


def test_stored_messages_are_not_taken_again(spark):
    stored = spark.createDataFrame([(1, "x"), (2, "y")], "delivery_no bigint, message_id string")
    new = spark.createDataFrame([(3, "y"), (4, "z"), (5, "z")], "delivery_no bigint, message_id string")
    got = sorted((r.delivery_no, r.message_id) for r in delivery.deliver_once(new, F.col("message_id"), "delivery_no", stored).collect())
    assert got == [(1, "x"), (2, "y"), (4, "z")]


def test_work_ids(spark):
    df = spark.createDataFrame([(f"{{{U}}}", 1), (U.upper(), 1), (None, 1), (U, None), (" ", 2)], "a string, g int")
    got = [r[0] for r in df.select(delivery.work_message_id(F.col("a"), F.col("g"))).collect()]
    assert got == [f"capture:{U}:1", f"capture:{U}:1", None, None, None]


def test_copies_alike_and_without_numbers(spark):
    data = [(1, "a", "x"), (1, "a", "x"), (None, "b", "y"), (None, "c", "z"), (7, "c", "w"), (7, "c", "v"), (9, "d", None)]
    df = spark.createDataFrame(data, "delivery_no bigint, message_id string, `pay load` string").withColumn("m", F.create_map(F.lit("k"), F.col("message_id")))
    got = sorted((r.message_id, r.delivery_no, r.copies) for r in delivery.deliver_once(df, F.col("message_id"), "delivery_no").collect())
    assert got == [("a", 1, 2), ("b", None, 1), ("c", 7, 3), ("d", 9, 1)]
    both = delivery.deliver_once(df, F.col("message_id"), "delivery_no", df)
    assert sorted((r.message_id, r.copies) for r in both.collect()) == [("a", 4), ("b", 2), ("c", 6), ("d", 2)]
    assert {r["pay load"] for r in delivery.deliver_once(df, F.col("message_id"), "delivery_no").where("message_id = 'c'").collect()} <= {"v", "w"}


def test_a_hot_message(spark):
    df = spark.range(3000).selectExpr("id AS delivery_no", "if(id % 3 = 0, 'hot', concat('m', id % 900)) AS message_id")
    got = {r.message_id: (r.delivery_no, r.copies) for r in delivery.deliver_once(df, F.col("message_id"), "delivery_no").collect()}
    assert got["hot"] == (0, 1000) and len(got) == 601 and sum(c for _, c in got.values()) == 3000
