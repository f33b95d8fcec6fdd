"""Which rows a reader may see, and which are current."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def current(rows: DataFrame, versions: DataFrame, version: str, ready: Column) -> DataFrame:
    """Rows without a version, or whose version is the current one of its document and ready.

    `versions` has a row for each current version, with the column `version`.
    """
    ok = versions.where(ready).select(F.col(version).alias("_version")).distinct()
    return rows.join(ok, rows[version] == ok._version, "left").where(rows[version].isNull() | ok._version.isNotNull()).drop("_version")


def visible(rows: DataFrame, members: DataFrame, key: str, admin: bool) -> DataFrame:
    """All rows for an administrator, for others those they are a member of."""
    return rows if admin else rows.join(members.select(key).distinct(), key, "left_semi")


def any_like(columns: list[str], needle: str | None) -> Column:
    """Case-insensitive substring in any of the columns; `%` and `_` are ordinary characters. No needle: true."""
    if not needle:
        return F.lit(True)
    found = F.lit(False)
    for c in columns:
        found = found | F.coalesce(F.lower(F.col(c)).contains(needle.lower()), F.lit(False))
    return found


def conjunction(df: DataFrame, **equal) -> DataFrame:
    """Keeps rows equal to every value that isn't None."""
    for c, v in equal.items():
        if v is not None:
            df = df.where(F.col(c) == v)
    return df


def stale(jobs: DataFrame, status: str, started: str, cutoff: Column, batch: int, order: list) -> DataFrame:
    """Jobs that are queued, or running since before the cutoff: the oldest ones."""
    return jobs.where((F.col(status) == "QUEUED") | ((F.col(status) == "RUNNING") & (F.col(started) < cutoff))).orderBy(*order).limit(batch)
