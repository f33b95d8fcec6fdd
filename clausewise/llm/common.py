"""Helpers that the training-data operators share."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes that one step of an Arrow function works on; long texts come alone.
STEP_BYTES = 4 << 20

_own_dir: list[str] = []


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole table of documents."""
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def small_batches(spark: SparkSession, rows: int = 2000) -> None:
    """Bounds the rows and bytes of one Arrow batch, since texts may be long.

    Plans read these settings when they run, after an operator has returned, so they can't be put back; what the
    session has set lower stays.
    """
    for name, most in (("maxRecordsPerBatch", rows), ("maxBytesPerBatch", 16 << 20)):
        at = spark.conf.get(f"spark.sql.execution.arrow.{name}", None)
        if not (at or "").isdigit() or not 0 < int(at) <= most:
            spark.conf.set(f"spark.sql.execution.arrow.{name}", str(most))


def shared_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names; a temporary one only in local mode, where all tasks see it."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    if not _own_dir:
        _own_dir.append(tempfile.mkdtemp(prefix="clausewise-"))
    return _own_dir[0]


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, name: str) -> DataFrame:
    """`df` as a Parquet table in the shared folder: cuts lineage and survives lost executors.

    The shuffle files of its plan go once it is written (a setting of Spark 4.1, put back afterwards).
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/clausewise-{name}-{uuid.uuid4().hex}"
    with _cleaned(spark):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def _cleaned(spark: SparkSession) -> Iterator[None]:
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)


@contextmanager
def passing(spark: SparkSession) -> Iterator[Callable[..., DataFrame]]:
    """Writes tables as `written` does, whose files go at the end: a database of its own in the shared folder.

    With a column and a number, a table is dealt over as many buckets by that column. Groups of it in one table, or in two
    dealt alike, then need no shuffle. What is written by a name again is added to the table, and the whole returned.
    """
    own = f"clausewise_{uuid.uuid4().hex}"
    folder = f"{shared_dir(spark).rstrip('/')}/{own}".replace("\\", "\\\\").replace("'", "\\'")
    spark.sql(f"CREATE DATABASE {own} LOCATION '{folder}'")

    def write(df: DataFrame, name: str, by: str | None = None, buckets: int = 0) -> DataFrame:
        table = f"{own}.{name}"
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
        spark.sql(f"CREATE TABLE IF NOT EXISTS {table} ({columns}) USING parquet OPTIONS (compression 'zstd')" + (f" CLUSTERED BY (`{by}`) INTO {buckets} BUCKETS" if by else ""))
        with _cleaned(spark):
            (df.repartition(buckets, by) if by else df).write.insertInto(table)
        return spark.table(table)

    try:
        yield write
    finally:
        spark.sql(f"DROP DATABASE {own} CASCADE")


def id_crc(col: str = "doc_id") -> Column:
    """crc32 of an id written as text; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary"))


def no_null(arr: pa.Array | pa.ChunkedArray) -> pa.Array:
    """A string column without nulls, in one chunk."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    return pc.fill_null(arr, "") if arr.null_count else arr


def byte_view(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column without nulls, and where each text starts and ends in them."""
    _, offsets, data = arr.buffers()
    off = np.frombuffer(offsets, np.int32)[arr.offset : arr.offset + len(arr) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def release() -> None:
    """Gives free memory back: Python workers stay for later tasks, also of other operators."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass


def steps(batches: Iterator[pa.RecordBatch], text: str, limit: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches of at most `limit` text bytes, or one text if it is longer."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(size, dtype=np.int64)
        at = 0
        while at < n:
            before = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, before + limit, "right")))
            yield batch.slice(at, to - at)
            at = to
    release()
