"""Stored objects: bodies by the hash of their content, compressed or as they are, read back with size and hash checked."""

from __future__ import annotations

import hashlib
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: The largest Arrow file that is read as a relation, in bytes.
IPC_BYTES = 16 * 2**20
STORED = "content_sha256 string, storage_encoding string, content_bytes bigint, stored_bytes bigint, body binary"


def stored(contents: DataFrame, smallest: int = 1024) -> DataFrame:
    """The bodies of ``content_sha256, html``, one row per content; those from ``smallest`` bytes on compressed (zstd)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        packer = zstandard.ZstdCompressor(level=3)
        for b in batches:
            raw = [t.encode() for t in b.column(1).to_pylist()]
            packed = [packer.compress(x) if len(x) >= smallest else x for x in raw]
            kinds = ["zstd" if len(x) >= smallest else "identity" for x in raw]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(kinds), pa.array(list(map(len, raw)), pa.int64()), pa.array(list(map(len, packed)), pa.int64()), pa.array(packed, pa.binary())],
                names=["content_sha256", "storage_encoding", "content_bytes", "stored_bytes", "body"],
            )

    once = contents.where("html IS NOT NULL").dropDuplicates(["content_sha256"]).select("content_sha256", "html")
    return once.mapInArrow(run, STORED)


def opened(objects: DataFrame, most_bytes: int = 64 * 2**20) -> DataFrame:
    """``content_sha256, html, problem``: each body unpacked to no more than its declared size.

    ``problem`` is encoding, size or hash where a body is not what it is declared to be, and ``html`` is null then.
    A body is never unpacked beyond its declared size or ``most_bytes``, whatever it claims inside.
    """

    def one(sha: str, kind: str, size: int, body: bytes) -> tuple[str | None, str | None]:
        import zstandard

        if size > most_bytes or kind not in ("zstd", "identity"):
            return None, "size" if kind in ("zstd", "identity") else "encoding"
        try:
            raw = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(body)).read(size + 1) if kind == "zstd" else body
        except zstandard.ZstdError:
            return None, "encoding"
        if len(raw) != size:
            return None, "size"
        return (raw.decode("utf-8", "replace"), None) if hashlib.sha256(raw).hexdigest() == sha else (None, "hash")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            both = [one(*x) for x in zip(*(b.column(i).to_pylist() for i in range(4)))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x for x, _ in both], pa.string()), pa.array([p for _, p in both], pa.string())], names=["content_sha256", "html", "problem"])

    return objects.select("content_sha256", "storage_encoding", "content_bytes", "body").mapInArrow(run, "content_sha256 string, html string, problem string")


def registered(spark: SparkSession, name: str, data: pa.Table) -> DataFrame:
    """An Arrow table as a temporary view; it passes through the driver, so it has the bound of ``read_ipc``."""
    if data.nbytes > IPC_BYTES:
        raise ValueError(f"at most {IPC_BYTES} bytes")
    df = spark.createDataFrame(data)
    df.createOrReplaceTempView(name)
    return df


def read_ipc(spark: SparkSession, name: str, blob: bytes) -> DataFrame:
    """An Arrow IPC file (file or stream format) of at most ``IPC_BYTES`` as a temporary view."""
    if len(blob) > IPC_BYTES:
        raise ValueError(f"at most {IPC_BYTES} bytes")
    source = pa.py_buffer(blob)
    try:
        data = pa.ipc.open_file(source).read_all()
    except pa.ArrowInvalid:
        data = pa.ipc.open_stream(source).read_all()
    return registered(spark, name, data)
