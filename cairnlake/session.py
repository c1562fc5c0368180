"""Session construction and lineage cutting."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str = "local[*]", shuffle_partitions: int | None = None, **conf: str) -> SparkSession:
    """A session with the settings the engine expects: UTC, AQE with skew handling, duplicate JSON keys kept.

    Keyword names use ``__`` for the dots of a Spark setting. ``shuffle_partitions`` is meant for tests and small
    machines; on a cluster AQE coalesces from the cluster's own setting.
    """
    b = (
        SparkSession.builder.master(master)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.variant.allowDuplicateKeys", "true")
        .config("spark.ui.enabled", "false")
    )
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    return b.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder of the session. Where none is named, a local session gets a temporary one of this
    machine; on a cluster that is an error, since executors would not see each other's files."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return sc._jsc.sc().getCheckpointDir().get()
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not named and not sc.master.startswith("local"):
        raise RuntimeError("name a folder that all executors share in spark.checkpoint.dir")
    sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="cairnlake-checkpoint-"))
    return sc._jsc.sc().getCheckpointDir().get()


def release(spark: SparkSession) -> None:
    """Deletes the tables this application has written to the checkpoint folder; results that read them are void."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{ensure_checkpoint_dir(spark).rstrip('/')}/tables")
    path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder; a lost executor never forces the plan above to run again."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, name: str, partitions: int | None = None) -> DataFrame:
    """``df`` written once as a table in the shared checkpoint folder and read again; its lineage ends there."""
    spark = df.sparkSession
    path = _table_path(spark, name)
    (df.repartition(partitions) if partitions else df).write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _table_path(spark: SparkSession, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/tables/{name}-{uuid.uuid4().hex}"


@contextmanager
def passing(df: DataFrame, name: str) -> Iterator[DataFrame]:
    """Like ``written``, for the time of a ``with`` block; the table is deleted at its end."""
    spark = df.sparkSession
    path = _table_path(spark, name)
    try:
        df.write.option("compression", "zstd").parquet(path)
        yield spark.read.schema(df.schema).parquet(path)
    finally:
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(folder, True)


@contextmanager
def lean(spark: SparkSession) -> Iterator[None]:
    """Within the block the session's shuffle files go at the end of each query, not when the driver collects its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before) if before is not None else spark.conf.unset(name)


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Hands the library's code to the executors' Python workers, once an application, wherever it is installed."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    package = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="cairnlake-code-"), f"{package.name}-code.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(package.rglob("*.py")):
            z.write(p, p.relative_to(package.parent))
    sc.addPyFile(str(archive))
    _SHIPPED.add(sc.applicationId)
