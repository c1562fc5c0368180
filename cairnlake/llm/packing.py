"""Items of varying length in containers of fixed capacity with minimum slack.

Only lengths decide which items share a container, and no length exceeds the capacity once longer items are cut. So
the packing is solved on the histogram of lengths - at most ``capacity`` rows, however many items there are - and the
solution, a short list of repeated container patterns, is carried back to the items by their rank within a length.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairnlake.llm.tokens import TOKENIZER_DIR, VOCABULARY, sizes
from cairnlake.session import cut

#: Tokens a container holds.
CAPACITY = 2048
#: Rows meant for one rank bucket of a length.
BUCKET_ROWS = 250_000


def best_fill(counts: dict[int, int], room: int) -> dict[int, int]:
    """The multiset of remaining lengths whose sum comes closest to ``room`` without exceeding it.

    Bitset subset sums: bit ``s`` says that sum ``s`` can be reached. The copies of a length are taken in powers of
    two; the bitset before each step is kept, and going back over the steps gives the count of each length.
    """
    reach, steps, mask = 1, [], (1 << (room + 1)) - 1
    for length in sorted(counts, reverse=True):
        copies = min(counts[length], room // length)
        k = 1
        while copies > 0:
            take = min(k, copies)
            steps.append((length, take, reach))
            reach |= (reach << (length * take)) & mask
            copies -= take
            k *= 2
        if reach >> room & 1:
            break
    s, chosen = reach.bit_length() - 1, {}
    for length, take, before in reversed(steps):
        if not before >> s & 1:
            chosen[length] = chosen.get(length, 0) + take
            s -= length * take
    return chosen


def patterns(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[dict[int, int], int]]:
    """Container patterns and how often each is used, until no length is left.

    The longest remaining length opens a container and the best fill completes it. The pattern is used as often as
    the counts allow, so each pattern uses up some length and there are at most about ``2 * capacity`` of them.
    """
    left = {k: v for k, v in counts.items() if k > 0 and v > 0}
    out = []
    while left:
        longest = max(left)
        rest = dict(left)
        rest[longest] -= 1
        chosen = best_fill({k: v for k, v in rest.items() if v}, capacity - longest)
        chosen[longest] = chosen.get(longest, 0) + 1
        times = min(left[k] // v for k, v in chosen.items())
        out.append((chosen, times))
        for k, v in chosen.items():
            left[k] -= v * times
            if not left[k]:
                del left[k]
    return out


def solution(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Rows ``(length, rank_from, rank_to, per, container_from)`` and the number of containers.

    The items of ``length`` with ranks ``rank_from .. rank_to - 1`` go, ``per`` each, into the containers from
    ``container_from`` on.
    """
    rows, rank, container = [], dict.fromkeys(counts, 0), 0
    for chosen, times in patterns(counts, capacity):
        for length, per in chosen.items():
            rows.append((length, rank[length], rank[length] + per * times, per, container))
            rank[length] += per * times
        container += times
    return rows, container


def pack(documents: DataFrame, capacity: int = CAPACITY, directory: str = TOKENIZER_DIR, vocabulary: str = VOCABULARY) -> DataFrame:
    """Every document's place: ``doc_id, part_no, first_token, n_tokens, container_id``.

    A text of at most ``capacity`` tokens is one part. A longer one is cut into full containers and a rest, each a
    part with its ``part_no`` and ``first_token``. Null and empty texts take no room: each is one part of 0 tokens,
    spread evenly over the containers. ``doc_id`` should be unique; rows with the same one are ranked in an order
    fixed by their sizes. An empty table gives no rows.

    The histogram (at most ``capacity`` rows) is all that comes to the driver, and the solution's rows (at most a few
    times ``capacity``) all that is broadcast. Ranks within a length are taken per hash bucket and shifted by the
    running sum of the buckets' counts, so a length that a third of all items share is never one task's.
    """
    spark = documents.sparkSession
    sized = cut(sizes(documents, directory, vocabulary))
    cap = F.lit(capacity)
    # A text of exactly k * capacity tokens has k full parts and no rest.
    n_parts = F.greatest(F.lit(1), F.ceil(F.col("n_tokens") / cap)).cast("int")
    parts = sized.select("doc_id", "n_tokens", F.explode(F.sequence(F.lit(0), n_parts - 1)).alias("part_no")).select(
        "doc_id",
        "part_no",
        (F.col("part_no") * cap).alias("first_token"),
        F.least(cap, F.col("n_tokens") - F.col("part_no") * cap).cast("int").alias("n_tokens"),
    )
    counts = {r["n_tokens"]: r["n"] for r in parts.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n")).collect()}
    rows, containers = solution(counts, capacity)
    n_buckets = max(8, -(-sum(counts.values()) // BUCKET_ROWS))
    names = ["n_tokens", "rank_from", "rank_to", "per", "container_from"]
    arrays = np.array(rows, np.int64).reshape(-1, 5)
    plan = spark.createDataFrame(pa.table({n: arrays[:, i] for i, n in enumerate(names)}))
    bucketed = parts.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "part_no"), F.lit(n_buckets)))
    # Rows: lengths times buckets. The window runs over the buckets of one length.
    shifts = (
        bucketed.where("n_tokens > 0").groupBy("n_tokens", "bucket")
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("shift", F.sum("n").over(Window.partitionBy("n_tokens").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)))
        .select("n_tokens", "bucket", F.coalesce("shift", F.lit(0)).alias("shift"))
    )
    local = F.row_number().over(Window.partitionBy("n_tokens", "bucket").orderBy("doc_id", "part_no")) - 1
    ranked = (
        bucketed.where("n_tokens > 0").withColumn("local", local)
        .join(shifts, ["n_tokens", "bucket"])
        .withColumn("rank", F.col("local") + F.col("shift"))
    )
    fits = (F.col("rank") >= F.col("rank_from")) & (F.col("rank") < F.col("rank_to"))
    placed = (
        ranked.join(F.broadcast(plan), (ranked["n_tokens"] == plan["n_tokens"]) & fits)
        .select(
            "doc_id", "part_no", "first_token", ranked["n_tokens"],
            (F.col("container_from") + F.floor((F.col("rank") - F.col("rank_from")) / F.col("per"))).cast("bigint").alias("container_id"),
        )
    )
    nothing = parts.where("n_tokens = 0").select(
        "doc_id", "part_no", "first_token", "n_tokens",
        F.pmod(F.xxhash64("doc_id"), F.lit(max(1, containers))).alias("container_id"),
    )
    return placed.unionByName(nothing)


def container_fill(packed: DataFrame) -> DataFrame:
    """``container_id, n_items, n_tokens, slack`` of each container of ``pack`` with the default capacity."""
    per = packed.groupBy("container_id").agg(F.count(F.lit(1)).alias("n_items"), F.sum("n_tokens").alias("n_tokens"))
    return per.withColumn("slack", F.lit(CAPACITY) - F.col("n_tokens"))
