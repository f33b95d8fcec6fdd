"""Parquet tables by name, and file manifests."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clausewise.sources.stored import settings, written

#: Bytes of the largest file whose content is one value of a row.
WHOLE = 64 << 20
#: Files of these suffixes are unpacked by all of Spark's readers but that of whole files.
PACKED = ("gz", "bz2", "deflate", "snappy", "lz4", "zst", "passthrough")
#: Bytes beyond any file's, so that a task has one file, and the whole of it.
BEYOND = 1 << 40
HEAD = 5
_MARK = b"\xef\xbb\xbf"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def manifest(spark: SparkSession, pattern: str) -> DataFrame:
    """One row a file: name, size, SHA-256 of the content. Files go through tasks one at a time; of those larger than `WHOLE` a task holds some lines at a time.

    Such files are looked through when this is called. A line, of any bytes up to the next line feed, is one value; packed files are, too.
    """
    read = spark.read.format("binaryFile")
    row = lambda files: files.select(F.element_at(F.split("path", "/"), -1).alias("file_name"), F.col("length").alias("n_bytes"), F.sha2("content", 256).alias("sha256"))
    files = read.load(pattern)
    out = row(files.where(F.col("length") <= WHOLE))  # the content of others isn't read
    if not files.where(F.col("length") > WHOLE).select("path").limit(1).count():
        return out
    packed = read.option("pathGlobFilter", f"*.{{{','.join(PACKED)}}}").load(pattern).where(F.col("length") > WHOLE)
    return out.unionByName(_large(spark, pattern)).unionByName(row(packed))


def _large(spark: SparkSession, pattern: str) -> DataFrame:
    """The manifest of files larger than `WHOLE`, each the only one of its task."""
    read = spark.read.option("lineSep", "\n").text(pattern).select("value", "_metadata.file_name", "_metadata.file_size").where((F.col("file_size") > WHOLE) & ~F.col("file_name").rlike(rf"\.({'|'.join(PACKED)})$"))
    first = F.monotonically_increasing_id() % (1 << 33) == 0  # of its task
    rows = read.select(F.concat(F.col("value").cast("binary"), F.lit(b"\n")).alias("line"), F.when(first, F.col("file_name")).alias("file_name"), F.when(first, F.col("file_size")).alias("file_size"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, size, seen, end = None, 0, 0, b""
        plain, marked = hashlib.sha256(), hashlib.sha256(_MARK)  # a mark of UTF-8 at the beginning isn't in the first line
        for batch in batches:
            if not batch.num_rows:
                continue
            if name is None:
                name, size = batch.column("file_name")[0].as_py(), batch.column("file_size")[0].as_py()
            lines = batch.column("line").cast(pa.large_binary())
            _, offsets, data = lines.buffers()
            a, b = (int.from_bytes(offsets[8 * i : 8 * i + 8], "little") for i in (lines.offset, lines.offset + len(lines)))
            for h in (plain, marked):
                h.update(end)
                h.update(memoryview(data)[a : b - 1])
            seen, end = seen + b - a, b"\n"
        if name is None:
            return
        found = [h for h, n in ((plain, seen), (marked, seen + len(_MARK))) if size in (n, n - 1)]  # the last line may have no end
        if not found:
            raise ValueError(f"{name}: {seen} bytes read of {size}")
        if size in (seen, seen + len(_MARK)):
            found[0].update(end)
        yield pa.RecordBatch.from_arrays([pa.array([unquote(name)]), pa.array([size], pa.int64()), pa.array([found[0].hexdigest()])], names=["file_name", "n_bytes", "sha256"])

    with settings(spark, {"spark.sql.files.maxPartitionBytes": str(BEYOND), "spark.sql.files.openCostInBytes": str(BEYOND), "spark.sql.files.minPartitionNum": "1", "spark.sql.execution.arrow.maxBytesPerBatch": str(16 << 20)}):
        return written(rows.mapInArrow(run, "file_name string, n_bytes long, sha256 string"), "manifest")


def heads(spark: SparkSession, pattern: str) -> DataFrame:
    """(path, content) of files, `content` being the first 5 bytes. Those larger than `WHOLE` are opened here, one after the other, for these bytes alone."""
    files = spark.read.format("binaryFile").load(pattern)
    small = files.where(F.col("length") <= WHOLE).select("path", F.substring("content", 1, HEAD).alias("content"))
    large = [(r.path, _first_bytes(spark, r.path)) for r in files.where(F.col("length") > WHOLE).select("path").toLocalIterator()]
    return small.unionByName(spark.createDataFrame(large, "path string, content binary")) if large else small


def _first_bytes(spark: SparkSession, path: str) -> bytearray:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    stream = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).open(at)
    try:
        got = [stream.read() for _ in range(HEAD)]
    finally:
        stream.close()
    return bytearray(b for b in got if b >= 0)


def signature(files: DataFrame) -> DataFrame:
    """Kind of each file (content binary, its first bytes at least) by its first bytes: pdf, zip container, parquet or other."""
    head = F.hex(F.substring("content", 1, HEAD))
    kind = F.when(head == "255044462D", "pdf").when(head.startswith("504B0304"), "zip").when(head.startswith("50415231"), "parquet").otherwise("other")
    return files.withColumn("kind", kind)
