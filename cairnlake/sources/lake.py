"""An append-only lake of Parquet tables with numbered snapshots.

A snapshot is one JSON manifest that names the files of every table; it becomes current when its file appears, by an
atomic create, so a commit of many tables is all or nothing and readers of an older manifest are never disturbed.
Idempotent appends compare new rows with stored ones by join; nothing of the data passes through the driver. Manifests
and receipts are reached through Hadoop's file systems, like the data.
"""

from __future__ import annotations

import hashlib
import json
import time
import uuid
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cairnlake.schemas import TABLES, conform, null_violation
from cairnlake.session import cut, lean
from cairnlake.sources.files import Folder


class EvidenceConflict(ValueError):
    """An identity was used again with different evidence."""


class CommitConflict(RuntimeError):
    """Another commit made the expected next snapshot first."""


class RewrittenRange(ValueError):
    """Between two snapshots a table was rewritten, so that its new files are not its new rows."""


@dataclass
class Manifest:
    """``rewritten`` has the last snapshot in which a table's stored files were replaced."""

    version: int
    tables: dict[str, list[str]]
    receipt: str | None = None
    message: str = ""
    rewritten: dict[str, int] = field(default_factory=dict)


_NULL, _TWICE, _OTHER = "null in a required column", "an identity stands twice with different evidence", "a stored identity has different evidence"
_REFUSALS = ((_NULL, ValueError), (_TWICE, EvidenceConflict), (_OTHER, EvidenceConflict))


def _refusal(name: str, why: str) -> str:
    return f"{name}: {why}"


def _refuse(name: str, why: str) -> Column:
    return F.raise_error(F.lit(_refusal(name, why))).cast("boolean")


def _row(df: DataFrame) -> Column:
    """The whole row as one value that compares null-safely, maps in the order of their keys."""
    maps = [f.name for f in df.schema.fields if f.dataType.typeName() == "map"]
    return F.struct(*[F.array_sort(F.map_entries(df[c])).alias(c) if c in maps else df[c] for c in df.columns])


class Lake:
    """Tables below ``root``, a folder that the driver and all executors share."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._manifests, self._receipts, self._files = (Folder(spark, f"{self.root}{x}") for x in ("/manifests", "/receipts", ""))

    # -- snapshots ------------------------------------------------------------------------------------------------
    def versions(self) -> list[int]:
        return sorted(int(n[:-5]) for n in self._manifests.names() if n.endswith(".json") and n[:-5].isdigit())

    def manifest(self, version: int | None = None) -> Manifest:
        """A snapshot's manifest; the current one without a number, an empty one before the first commit."""
        if version is None:
            known = self.versions()
            version = known[-1] if known else 0
        if version == 0:
            return Manifest(0, {})
        return Manifest(**json.loads(self._manifests.read(f"{version:012d}.json")))

    def commit(self, base: Manifest, tables: dict[str, list[str]], receipt: str | None = None, message: str = "", rewritten: Sequence[str] = ()) -> Manifest:
        """Publishes the next snapshot; fails if another writer was first."""
        version = base.version + 1
        new = Manifest(version, tables, receipt, message, base.rewritten | dict.fromkeys(rewritten, version))
        if receipt is not None:
            # The receipt names its snapshot first; it counts only once that snapshot is there and names the receipt.
            self._receipts.create(self._receipt_name(receipt), str(version), replace=True)
        try:
            self._manifests.create(f"{version:012d}.json", json.dumps(new.__dict__))
        except FileExistsError:
            raise CommitConflict(f"snapshot {version} exists") from None
        return new

    @staticmethod
    def _receipt_name(receipt: str) -> str:
        return hashlib.sha256(receipt.encode()).hexdigest()

    def committed(self, receipt: str) -> bool:
        """Whether a commit under this receipt was published; two small files are read, however long the history."""
        name = self._receipt_name(receipt)
        if not self._receipts.exists(name):
            return False
        version = int(self._receipts.read(name))
        return self._manifests.exists(f"{version:012d}.json") and self.manifest(version).receipt == receipt

    def snapshots(self) -> DataFrame:
        """``version, message, table_name, folders`` of all snapshots."""
        rows = [(m.version, m.message, t, len(fs)) for m in map(self.manifest, self.versions()) for t, fs in m.tables.items()]
        return self.spark.createDataFrame(rows, "version bigint, message string, table_name string, folders bigint")

    # -- reads ----------------------------------------------------------------------------------------------------
    def read(self, name: str, version: int | None = None) -> DataFrame:
        """A table at a snapshot, the current one without a number. A table without files is empty."""
        files = self.manifest(version).tables.get(name, [])
        schema = TABLES[name].schema
        if not files:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*files)

    def changes(self, name: str, after: int, to: int | None = None) -> DataFrame:
        """The rows inserted into a table after one snapshot up to another. Only appends may lie between them."""
        until = self.manifest(to)
        if after < until.rewritten.get(name, 0):
            raise RewrittenRange(f"{name} was rewritten in snapshot {until.rewritten[name]}")
        old, new = set(self.manifest(after).tables.get(name, [])), until.tables.get(name, [])
        files = [f for f in new if f not in old]
        schema = TABLES[name].schema
        return self.spark.read.schema(schema).parquet(*files) if files else self.spark.createDataFrame([], schema)

    def inventory(self) -> DataFrame:
        """``table_name, files, bytes`` of the current snapshot, from file status alone."""
        sizes = {t: [self._files.size(f) for f in fs] for t, fs in self.manifest().tables.items()}
        rows = [(t, sum(n for n, _ in xs), sum(b for _, b in xs)) for t, xs in sizes.items()]
        return self.spark.createDataFrame(rows, "table_name string, files bigint, bytes bigint")

    # -- writes ---------------------------------------------------------------------------------------------------
    def write_files(self, name: str, df: DataFrame) -> str:
        """Writes rows as sorted, compressed Parquet files; returns their folder.

        Rows are spread over ranges of the sort key, sampled from the data, as many as the session's shuffle partitions
        and merged by size where they are small: a hot hash or month is no single task's.
        """
        t = TABLES[name]
        path = f"{self.root}/data/{name}/{uuid.uuid4().hex}"
        rows = conform(df, name)
        self._store(name, rows.repartitionByRange(*t.sort), path)
        return path

    def _store(self, name: str, ranges: DataFrame, path: str) -> None:
        # Postings repeat each content's hash in every file; one dictionary of the file's contents spares the copies.
        wide = {"parquet.dictionary.page.size": str(32 << 20)} if name == "html_terms" else {}
        ranges.sortWithinPartitions(*TABLES[name].sort).write.option("compression", "zstd").options(**wide).parquet(path)

    def append(self, frames: dict[str, DataFrame], receipt: str | None = None, message: str = "") -> Manifest:
        """Idempotent append of several tables in one snapshot.

        Rows of one identity within a batch must agree and enter once; rows already stored identically are passed
        over; a stored row that differs raises ``EvidenceConflict``. A receipt that was committed before makes the
        append do nothing. A null in a column that must not be null is an error.
        """
        base = self.manifest()
        if receipt is not None and self.committed(receipt):
            return base
        tables = {k: list(v) for k, v in base.tables.items()}
        changed = False
        with lean(self.spark):
            for name, df in frames.items():
                folder = self._insert(name, conform(df, name), base.version)
                if folder:
                    tables.setdefault(name, []).append(folder)
                    changed = True
        return self.commit(base, tables, receipt, message) if changed or receipt else base

    def _insert(self, name: str, df: DataFrame, version: int) -> str | None:
        """Writes the rows to insert and returns their folder, None if there are none. They are compared on their way to
        the files, and no copy of them is kept; the files of a batch that is refused are deleted."""
        if df.isEmpty():
            return None
        t = TABLES[name]
        path = f"{self.root}/data/{name}/{uuid.uuid4().hex}"
        kept = False
        try:
            rows = self._unstored(name, df, version)
            if t.sort == t.identity:  # equal identities meet in one range of the files
                ranges = self._once(name, rows.repartitionByRange(*t.sort))
            else:
                ranges = self._once(name, rows).repartitionByRange(*t.sort)
            self._store(name, ranges, path)
            kept = not self.spark.read.schema(t.schema).parquet(path).isEmpty()
        except PySparkException as e:
            said = f"{e}\n{getattr(e, '_stackTrace', None)}"  # with the causes
            for text, kind in ((_refusal(name, x), k) for x, k in _REFUSALS):
                if text in said:
                    raise kind(text) from None
            raise
        finally:
            if not kept:
                self._files.delete(path)
        return path if kept else None

    def _unstored(self, name: str, df: DataFrame, version: int) -> DataFrame:
        """The rows that are not stored; their evaluation fails at a null that must not be and at other stored evidence.

        The failing conditions stand above a join or window and need its result, so that none is drawn below a filter of
        the frame itself.
        """
        keys = list(TABLES[name].identity)
        stored = self.read(name, version)
        if not self.manifest(version).tables.get(name) or stored.select(*keys).join(df.select(*keys), keys, "left_semi").isEmpty():
            return df
        old = stored.select(*keys, _row(stored).alias("_old"))
        unequal = F.when(null_violation(name), _refuse(name, _NULL)).when(F.col("_old").isNull(), True).when(F.col("_old").eqNullSafe(_row(df)), False).otherwise(_refuse(name, _OTHER))
        return df.join(old, keys, "left").where(unequal).select(*df.columns)

    @staticmethod
    def _once(name: str, df: DataFrame) -> DataFrame:
        """Each row once; the evaluation fails at a null that must not be and if an identity has two different rows."""
        keys = list(TABLES[name].identity)
        before = df.withColumn("_before", F.lag(_row(df)).over(Window.partitionBy(*keys).orderBy(*keys)))
        first = F.when(null_violation(name), _refuse(name, _NULL)).when(F.col("_before").isNull(), True).when(F.col("_before").eqNullSafe(_row(df)), False).otherwise(_refuse(name, _TWICE))
        return before.where(first).select(*df.columns)

    def replace(self, frames: dict[str, DataFrame], message: str = "", base: Manifest | None = None) -> Manifest:
        """Swaps whole tables in one snapshot. ``base`` is the snapshot the frames were read from: if another one was
        published meanwhile, the swap fails rather than lose its rows."""
        base = base or self.manifest()
        tables = dict(base.tables) | {n: [self.write_files(n, df)] for n, df in frames.items()}
        return self.commit(base, tables, None, message, list(frames))

    def compact(self, name: str) -> Manifest:
        """Rewrites a table's files as one clustered set."""
        base = self.manifest()
        return self.replace({name: self.read(name, base.version)}, f"compact {name}", base)

    # -- retention ------------------------------------------------------------------------------------------------
    def retention_plan(self, now: str, days_of: str = "$.retention_days") -> DataFrame:
        """``visit_id`` of the visits whose policy's days are over and which no fulfillment refers to."""
        v = self.read("visits").withColumn("days", F.get_json_object("capture_policy", days_of).try_cast("int")).where("days IS NOT NULL")
        over = v.where(F.col("finished_at") + F.make_interval(days=F.col("days")) < F.lit(now).cast("timestamp"))
        used = self.read("fulfillments").select(F.col("observation_id").alias("visit_id"))
        return over.select("visit_id").join(used, "visit_id", "left_anti")

    def purge(self, visits: DataFrame) -> Manifest:
        """Removes observations: visit-grain rows of every table, and content-grain rows no other document needs."""
        base = self.manifest()
        read = lambda n: self.read(n, base.version)
        gone = cut(visits.select("visit_id").distinct())
        docs = read("documents")
        left = docs.join(gone, "visit_id", "left_anti")
        contents = cut(docs.join(gone, "visit_id", "left_semi").select("content_sha256").distinct().join(left.select("content_sha256").distinct(), "content_sha256", "left_anti"))
        attempts = read("attempts").join(gone, "visit_id", "left_semi").select("attempt_id")
        by = {n: (gone, "visit_id") for n in ("visits", "attempts", "documents", "link_occurrences", "visit_readiness")}
        by |= {"steps": (attempts, "attempt_id")} | {n: (contents, "content_sha256") for n in ("html_elements", "html_terms", "html_jsonld")}
        # Tables without such rows keep their files.
        touched = {n: (d, key) for n, (d, key) in by.items() if n in base.tables and not read(n).join(d, key, "left_semi").isEmpty()}
        return self.replace({n: read(n).join(d, key, "left_anti") for n, (d, key) in touched.items()}, "purge", base) if touched else base

    def reclaimable(self, horizon: int, grace_seconds: float = 0.0, limit: int | None = None) -> list[str]:
        """Data folders that no snapshot from ``horizon`` on refers to and that were last changed before the grace time:
        a commit under way has its files, but not yet its manifest."""
        kept = {self._files.qualified(f) for v in self.versions() if v >= horizon for fs in self.manifest(v).tables.values() for f in fs}
        before = (time.time() - grace_seconds) * 1000
        return [p for p, at in self._files.folders("data") if self._files.qualified(p) not in kept and at <= before][:limit]

    def reclaim(self, horizon: int, grace_seconds: float = 3600.0, limit: int | None = None) -> list[str]:
        """Deletes what is ``reclaimable`` and returns it. Snapshots before the horizon can no longer be read."""
        gone = self.reclaimable(horizon, grace_seconds, limit)
        for p in gone:
            self._files.delete(p)
        return gone


def validations(lake: Lake, version: int | None = None) -> dict[str, int]:
    """Counts that must be 0: repeated identities of each material table, broken spans and dangling references."""
    out = {}
    for t in ("html_elements", "html_terms", "html_jsonld", "link_occurrences", "visit_readiness"):
        keys: Sequence[str] = TABLES[t].identity
        out[f"{t}: repeated identity"] = lake.read(t, version).groupBy(*keys).count().where("count > 1").count()
    e = lake.read("html_elements", version)
    out["html_elements: broken span"] = e.where("subtree_end_index <= node_index OR text_end < text_start OR length(text) <> text_end - text_start").count()
    out["html_terms: empty or unsorted"] = lake.read("html_terms", version).where("size(node_indexes) = 0 OR node_indexes <> array_sort(array_distinct(node_indexes))").count()
    out["html_jsonld: value and error"] = lake.read("html_jsonld", version).where("(value IS NULL) = (parse_error IS NULL)").count()
    visits = lake.read("visits", version).select("visit_id")
    out["link_occurrences: unknown visit"] = lake.read("link_occurrences", version).join(visits, "visit_id", "left_anti").count()
    out["visit_readiness: unknown visit"] = lake.read("visit_readiness", version).join(visits, "visit_id", "left_anti").count()
    return out
