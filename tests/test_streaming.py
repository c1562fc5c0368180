import datetime as dt

from pyspark.sql import functions as F

from cairnlake.operators import delivery
from cairnlake.streaming.live import drained, messages_once

U = "3d8dcad2-3911-5792-b0af-f68a64231398"
SCHEMA = "delivery_no bigint, message_id string, delivered_at timestamp"


def stream(spark, path, rows):
    for i, part in enumerate(rows):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(f"{path}/in")
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")


def test_messages_once_over_batches(spark, tmp_path):
    t = dt.datetime(2024, 1, 1)
    rows = [
        [(1, f"observation:{U}", t), (2, "x", t)],
        [(3, f"observation:{U.upper()}", t + dt.timedelta(minutes=5)), (4, "y", t + dt.timedelta(minutes=6))],
        [(5, f" observation:{{{U}}}", t + dt.timedelta(minutes=9)), (6, "x", t + dt.timedelta(minutes=9))],
    ]
    got = drained(messages_once(stream(spark, str(tmp_path), rows), "message_id", "delivered_at", "1 hour")).collect()
    assert sorted(r.message_id for r in got) == [f"observation:{U}", "x", "y"]


def test_late_copies_fall_to_the_stored_table(spark):
    t = dt.datetime(2024, 1, 1)
    stored = spark.createDataFrame([(1, f"observation:{U}", t)], SCHEMA)
    late = spark.createDataFrame([(9, f"observation:{U.upper()}", t + dt.timedelta(days=9)), (10, "new", t)], SCHEMA)
    got = delivery.deliver_once(late, delivery.canonical_message_id(F.col("message_id")), "delivery_no", stored)
    assert sorted((r.delivery_no, r.copies) for r in got.collect()) == [(1, 2), (10, 1)]


def test_windows_of_a_stream_equal_the_batch(spark, tmp_path):
    t = dt.datetime(2024, 1, 1)
    rows = [[(i, "m", t + dt.timedelta(minutes=7 * i + 60 * k)) for i in range(20)] for k in range(3)]
    s = stream(spark, str(tmp_path), rows).groupBy(F.window("delivered_at", "1 hour")).count()
    got = {(r.window.start, r["count"]) for r in drained(s, "complete").collect()}
    batch = spark.createDataFrame([r for part in rows for r in part], SCHEMA).groupBy(F.window("delivered_at", "1 hour")).count()
    assert got == {(r.window.start, r["count"]) for r in batch.collect()}


def test_empty_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    s = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
    assert drained(s.where("delivery_no > 1")).count() == 0
