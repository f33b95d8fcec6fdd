"""Tables that are written once and read by several steps or queries."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_own: list[str] = []
_kept: dict[tuple, DataFrame] = {}
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder that `spark.checkpoint.dir` names; a temporary one only in local mode, where all tasks see it."""
    named, master = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext.master
    if named:
        return named.rstrip("/")
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="clausewise-"))
    return _own[0]


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/clausewise-{name}-{uuid.uuid4().hex}"


@contextmanager
def settings(spark: SparkSession, of: dict[str, str]) -> Iterator[None]:
    """The session's settings `of`, put back afterwards; for plans that run inside."""
    before = {name: spark.conf.get(name, None) for name in of}
    for name, value in of.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def written(df: DataFrame, name: str, by: list[str] | None = None, **options: str) -> DataFrame:
    """`df` as a Parquet table, partitioned by the columns `by`. Its plan's shuffle files go once it is written."""
    spark = df.sparkSession
    path, before = new_path(spark, name), spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").options(**options).partitionBy(*by or []).parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def kept(of: DataFrame, name: str, make: Callable[[], DataFrame]) -> DataFrame:
    """What `make` has written for the files of `of`, made once a session; files stand for what they were then."""
    at = (of.sparkSession.sparkContext.applicationId, name, hash(tuple(sorted(of.inputFiles()))))
    if at not in _kept:
        _kept[at] = make()
    return _kept[at]
