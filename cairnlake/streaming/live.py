"""Incremental processing with Structured Streaming.

New evidence files are a stream; each micro-batch is materialised by the same functions as a full rebuild and
committed to the lake under a receipt, so a batch that is delivered again changes nothing.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from cairnlake.operators import delivery, projections
from cairnlake.schemas import TABLES
from cairnlake.session import ensure_checkpoint_dir, lean, passing, written
from cairnlake.sources.lake import CommitConflict, Lake, Manifest

MATERIAL_NAMES = ("html_elements", "html_terms", "html_jsonld", "link_occurrences", "visit_readiness")
#: Contents of a batch up to which their ids are a filter of the scan.
FILTERED = 1000


def materialize(lake: Lake, visits: DataFrame, documents: DataFrame, contents: DataFrame, receipt: str | None = None) -> Manifest:
    """Projects the contents of some visits and appends all material tables in one snapshot.

    A content that an earlier batch projected is not parsed again, its links are made of its stored elements; links and
    readiness are made for every visit. ``contents`` has ``content_sha256`` and ``html``.
    """
    docs = documents.join(visits.select("visit_id"), "visit_id", "left_semi")
    html = docs.where(F.lower("detected_media_type") == "text/html").select("content_sha256").distinct()
    stored = lake.read("html_elements")
    with lean(lake.spark), passing(html, "wanted") as wanted, passing(_known(stored, wanted), "known") as known:
        new = wanted.join(known, "content_sha256", "left_anti")
        if new.isEmpty():
            return _append(lake, None, projections.stored_anchors(stored.join(known, "content_sha256", "left_semi")), visits, docs, receipt)
        distinct = contents.join(new, "content_sha256", "left_semi").dropDuplicates(["content_sha256"])
        with passing(projections.project(distinct), "projected") as pages:
            anchors = pages.select("content_sha256", "base", "anchors")
            if not known.isEmpty():
                anchors = anchors.unionByName(projections.stored_anchors(stored.join(known, "content_sha256", "left_semi")))
            return _append(lake, pages, anchors, visits, docs, receipt)


def _append(lake: Lake, fresh: DataFrame | None, anchors: DataFrame, visits: DataFrame, docs: DataFrame, receipt: str | None) -> Manifest:
    frames = {} if fresh is None else {"html_elements": projections.html_elements(fresh), "html_terms": projections.html_terms(fresh), "html_jsonld": projections.html_jsonld(fresh)}
    frames |= {"link_occurrences": projections.link_occurrences(anchors, visits, docs), "visit_readiness": projections.visit_readiness(visits)}
    return lake.append(frames, receipt=receipt)


def _known(stored: DataFrame, pages: DataFrame) -> DataFrame:
    """The contents among ``pages`` that are stored. For a batch of up to ``FILTERED`` contents their ids reach the scan
    as a filter, and files sorted by content are skipped; larger batches meet the table by a join."""
    ids = [r[0] for r in pages.select("content_sha256").limit(FILTERED + 1).collect()]
    if len(ids) <= FILTERED:
        return stored.where(F.col("content_sha256").isin(ids)).select("content_sha256").distinct() if ids else stored.select("content_sha256").limit(0)
    return stored.select("content_sha256").distinct()


def _projected(visits: DataFrame, documents: DataFrame, contents: DataFrame) -> tuple[DataFrame, DataFrame]:
    docs = documents.join(visits.select("visit_id"), "visit_id", "left_semi")
    html = docs.where(F.lower("detected_media_type") == "text/html").select("content_sha256").distinct()
    return docs, written(projections.project(contents.join(html, "content_sha256", "left_semi").dropDuplicates(["content_sha256"])), "projected")


def rebuild(lake: Lake, contents: DataFrame, meanwhile: Callable[[], None] | None = None) -> Manifest:
    """A new generation of all material tables from the evidence, swapped in at once.

    The generation is built beside the current one from the evidence of one snapshot. What was appended while it was
    built is projected in turn, until the snapshot covered is the current one; then the swap is published on that
    snapshot, and only on it. ``meanwhile`` runs once before the first look for new evidence (a hook for tests).
    """
    covered, generation = 0, {n: [] for n in MATERIAL_NAMES}
    while True:
        base = lake.manifest()
        if base.version > covered or not covered:
            visits = lake.changes("visits", covered, base.version) if covered else lake.read("visits", base.version)
            docs, pages = _projected(visits, lake.read("documents", base.version), contents)
            done = generation["html_elements"]
            stored = lake.spark.read.schema(TABLES["html_elements"].schema).parquet(*done) if done else lake.spark.createDataFrame([], TABLES["html_elements"].schema)
            fresh = pages.join(_known(stored, pages), "content_sha256", "left_anti")
            frames = {
                "html_elements": projections.html_elements(fresh), "html_terms": projections.html_terms(fresh), "html_jsonld": projections.html_jsonld(fresh),
                "link_occurrences": projections.link_occurrences(pages, visits, docs), "visit_readiness": projections.visit_readiness(visits),
            }
            for name, df in frames.items():
                generation[name].append(lake.write_files(name, df))
            covered = base.version
            if meanwhile:
                meanwhile, _ = None, meanwhile()
            continue
        try:
            return lake.commit(base, base.tables | generation, None, "rebuild", MATERIAL_NAMES)
        except CommitConflict:
            continue  # another snapshot was first: catch up with it


def follow(spark: SparkSession, lake: Lake, incoming: str, contents: Callable[[], DataFrame], checkpoint: str, files_per_batch: int = 100) -> StreamingQuery:
    """Materialises visits that arrive as Parquet files in ``incoming`` until none is left.

    The checkpoint moves only after a batch was committed. The receipt names the stream and batch.
    """
    stream = spark.readStream.schema(TABLES["visits"].schema).option("maxFilesPerTrigger", files_per_batch).parquet(incoming)
    name = uuid.uuid5(uuid.NAMESPACE_URL, checkpoint).hex

    def run(batch: DataFrame, number: int) -> None:
        receipt = f"{name}:{number}"
        if lake.committed(receipt):
            return
        with passing(batch.dropDuplicates(["visit_id"]), "visits") as visits:
            lake.append({"visits": visits}, receipt=f"{receipt}:evidence")
            materialize(lake, visits, lake.read("documents"), contents(), receipt)

    return stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def drained(stream: DataFrame, mode: str = "append") -> DataFrame:
    """The result of a bounded stream: run until nothing is left, each batch written to the shared folder.

    With mode complete the last batch stands, with append and update all of them.
    """
    spark = stream.sparkSession
    base = f"{ensure_checkpoint_dir(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"
    seen: list[int] = []

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/out/{number}")
        seen.append(number)

    q = stream.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    if not seen:
        return spark.createDataFrame([], stream.schema)
    paths = [f"{base}/out/{n}" for n in (seen[-1:] if mode == "complete" else sorted(set(seen)))]
    return spark.read.schema(stream.schema).parquet(*paths)


def messages_once(stream: DataFrame, column: str, event_time: str, delay: str) -> DataFrame:
    """A stream of messages without those whose identifier came within ``delay`` before, by keyed state.

    Later copies are a matter of the stored table: ``delivery.deliver_once`` with ``stored`` holds for any delay.
    """
    named = stream.withColumn("message_id", delivery.canonical_message_id(F.col(column)))
    return named.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(["message_id"])
