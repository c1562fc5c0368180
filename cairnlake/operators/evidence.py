"""Validation of capture evidence, declaratively and without bringing rows to the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairnlake.functions import identity

# What the evidence tables may say.
VISIT_OUTCOMES = ("succeeded", "failed", "cancelled", "skipped")
ATTEMPT_OUTCOMES = (*VISIT_OUTCOMES, "uncertain")
STEP_ACTIONS = ("wait_dynamic", "wait_fixed", "scroll", "expand")
REPRESENTATIONS = ("response_body", "rendered_html")
FULFILLMENT_MODES = ("acquired", "shared", "reused")


def _problems(df: DataFrame, table: str, key: Column, rules: dict[str, Column]) -> DataFrame:
    """``table_name, record, rule`` for each rule a row breaks; a rule that is null for a row counts as kept."""
    broken = F.array(*[F.when(~F.coalesce(ok, F.lit(True)), F.lit(name)) for name, ok in rules.items()])
    return df.select(F.lit(table).alias("table_name"), key.cast("string").alias("record"), F.explode(F.filter(broken, lambda x: x.isNotNull())).alias("rule"))


def visit_problems(visits: DataFrame) -> DataFrame:
    c = F.col
    return _problems(visits, "visits", c("visit_id"), {
        "outcome": c("outcome").isin(*VISIT_OUTCOMES),
        "admitted before finished": c("admitted_at") <= c("finished_at"),
        "started between": (c("started_at") >= c("admitted_at")) & (c("started_at") <= c("finished_at")),
        "observed before finished": c("observed_at") <= c("finished_at"),
        "document only if succeeded": c("document_id").isNull() | (c("outcome") == "succeeded"),
        "status": c("status_code").between(100, 599),
    })


def attempt_problems(attempts: DataFrame) -> DataFrame:
    c = F.col
    place = F.row_number().over(Window.partitionBy("visit_id").orderBy("attempt_index")) - 1
    failed = c("outcome").isin("failed", "uncertain")
    return _problems(attempts.withColumn("_place", place), "attempts", c("attempt_id"), {
        "outcome": c("outcome").isin(*ATTEMPT_OUTCOMES),
        "contiguous index": c("_place") == c("attempt_index"),
        "derived id": c("attempt_id") == identity.attempt_id(c("visit_id"), c("attempt_index")),
        "started before finished": c("started_at") <= c("finished_at"),
        "failure fields": F.when(failed, c("failure_code").isNotNull()).otherwise(c("failure_code").isNull() & c("failure_stage").isNull() & c("failure_message").isNull()),
    })


def step_problems(steps: DataFrame) -> DataFrame:
    c = F.col
    place = F.row_number().over(Window.partitionBy("attempt_id").orderBy("step_index")) - 1
    return _problems(steps.withColumn("_place", place), "steps", F.concat_ws(":", "attempt_id", "step_index"), {
        "action": c("action").isin(*STEP_ACTIONS),
        "contiguous index": c("_place") == c("step_index"),
        "duration": c("duration_ms") >= 0,
        "parameters": F.try_parse_json("parameters").isNotNull(),
    })


def document_problems(documents: DataFrame) -> DataFrame:
    c = F.col
    return _problems(documents, "documents", c("document_id"), {
        "representation": c("representation").isin(*REPRESENTATIONS),
        "derived id": c("document_id") == identity.document_id(c("visit_id")),
        "hash": c("content_sha256").rlike("^[0-9a-f]{64}$"),
        "sizes": (c("content_bytes") >= 0) & (c("stored_bytes") >= 0),
    })


def fulfillment_problems(fulfillments: DataFrame) -> DataFrame:
    c = F.col
    return _problems(fulfillments, "fulfillments", c("record_id"), {
        "mode": c("mode").isin(*FULFILLMENT_MODES),
        "depth": c("depth") >= 0,
        "root has no parent": (c("depth") > 0) | c("parent_observation_id").isNull(),
    })


def content_problems(contents: DataFrame, documents: DataFrame) -> DataFrame:
    """Stored bytes whose hash or length is not the declared one: ``content_sha256, rule``."""
    d = documents.select("content_sha256", "content_bytes").distinct()
    j = contents.join(d, "content_sha256")
    body = F.col("html").cast("binary")
    wrong = F.when(F.sha2(body, 256) != F.col("content_sha256"), "hash").when(F.octet_length(body) != F.col("content_bytes"), "length")
    return j.select("content_sha256", wrong.alias("rule")).where("rule IS NOT NULL")


def observation_readiness(wanted: DataFrame, visits: DataFrame, documents: DataFrame, readiness: DataFrame, present: DataFrame) -> DataFrame:
    """``visit_id, reason`` for each wanted id: unknown, failed, no_document, not_html, pending, missing_content or ready.

    Evidence may arrive in any order, so nothing is inferred from what is absent elsewhere: each id keeps its row.
    """
    v = visits.select("visit_id", F.lit(True).alias("known"), "outcome", "document_id")
    d = documents.select("document_id", F.lower("detected_media_type").alias("kind"), "content_sha256")
    r = readiness.select("visit_id", F.lit(True).alias("proven")).distinct()
    p = present.select("content_sha256", F.lit(True).alias("there")).distinct()
    j = wanted.select("visit_id").distinct().join(v, "visit_id", "left").join(d, "document_id", "left").join(r, "visit_id", "left").join(p, "content_sha256", "left")
    reason = (
        F.when(F.col("known").isNull(), "unknown").when(F.col("outcome") != "succeeded", "failed").when(F.col("document_id").isNull() | F.col("kind").isNull(), "no_document")
        .when(F.col("kind") != "text/html", "not_html").when(F.col("proven").isNull(), "pending").when(F.col("there").isNull(), "missing_content").otherwise("ready")
    )
    return j.select("visit_id", reason.alias("reason"))


def collection_readiness(collections: DataFrame, outcomes: DataFrame, fulfillments: DataFrame, readiness: DataFrame) -> DataFrame:
    """``collection_id, state, fulfilled, ready``: open, waiting, inconsistent or complete.

    A collection is inconsistent if its outcome counts fewer supplied pages than it has fulfillments.
    """
    f = fulfillments.select("collection_id", F.col("observation_id").alias("visit_id")).distinct().join(readiness.select("visit_id", F.lit(1).alias("r")).distinct(), "visit_id", "left")
    per = f.groupBy("collection_id").agg(F.count(F.lit(1)).alias("fulfilled"), F.count("r").alias("ready"))
    o = outcomes.groupBy("collection_id").agg(F.max("supplied_pages").alias("supplied"), F.count_distinct("outcome").alias("kinds"))
    j = collections.select("collection_id").distinct().join(o, "collection_id", "left").join(per, "collection_id", "left")
    fulfilled, ready = F.coalesce("fulfilled", F.lit(0)), F.coalesce("ready", F.lit(0))
    state = (
        F.when(F.col("supplied").isNull(), "open").when((F.col("kinds") > 1) | (F.col("supplied") < fulfilled), "inconsistent")
        .when((F.col("supplied") > fulfilled) | (ready < fulfilled), "waiting").otherwise("complete")
    )
    return j.select("collection_id", state.alias("state"), fulfilled.alias("fulfilled"), ready.alias("ready"))
