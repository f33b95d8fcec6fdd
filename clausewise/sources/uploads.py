"""Checks of uploaded files: type, size, and whether the content is what the name says.

An office file is a ZIP archive with `[Content_Types].xml` and a root of its kind. Its members come from the archive's
central directory, which the end record in the last bytes points to; members aren't unpacked.
"""

from __future__ import annotations

import struct

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

# Roots of office files by suffix, the member that all have, signatures.
ROOTS = {"docx": "word/", "xlsx": "xl/", "pptx": "ppt/"}
TYPES_MEMBER, PDF = "[Content_Types].xml", b"%PDF-"
_END, _ENTRY = b"PK\x05\x06", b"PK\x01\x02"
#: Bytes of a file at most.
LARGEST = 50 << 20


def zip_names(data: bytes) -> list[str] | None:
    """The names in an archive's central directory; None if there is none, or it is broken."""
    tail = max(0, len(data) - 22 - 65_535)
    at = data.rfind(_END, tail)
    if at < 0 or at + 22 > len(data):
        return None
    count, size, start = struct.unpack("<HII", data[at + 10 : at + 20])
    start = at - size if start + size > at else start + (at - size - start)  # what stands before the archive shifts it
    names = []
    for _ in range(count):
        if start < 0 or data[start : start + 4] != _ENTRY or start + 46 > at:
            return None
        n, extra, comment = struct.unpack("<HHH", data[start + 28 : start + 34])
        flags = struct.unpack("<H", data[start + 8 : start + 10])[0]
        names.append(data[start + 46 : start + 46 + n].decode("utf-8" if flags & 0x800 else "cp437", "replace"))
        start += 46 + n + extra + comment
    return names


@F.udf(ArrayType(StringType()), useArrow=True)
def _names(data: bytes) -> list[str] | None:
    return zip_names(data) if data is not None else None


def checked(files: DataFrame, largest: int = LARGEST) -> DataFrame:
    """(name, n_bytes, issue) of `files` (path, length, content), the issue null if a file is taken.

    Issues, first one named: TYPE (no suffix that is taken), EMPTY, TOO_LARGE, CONTENT (a PDF without its head, an office
    file that is no archive or has another kind's members). Suffixes may be in capitals.
    """
    name = F.element_at(F.split("path", "/"), -1)
    suffix = F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1))
    names = F.when(suffix.isin(*ROOTS) & F.col("length").between(1, largest), _names("content"))
    root = F.create_map(*[F.lit(x) for pair in ROOTS.items() for x in pair])[suffix]
    office = F.array_contains("_names", TYPES_MEMBER) & F.exists("_names", lambda n: n.startswith(F.col("_root")))
    content = F.when(F.col("_suffix") == "pdf", F.substring("content", 1, 5) == F.lit(PDF)).otherwise(F.coalesce(office, F.lit(False)))
    rows = files.select(name.alias("name"), F.col("length").alias("n_bytes"), "content", suffix.alias("_suffix"), names.alias("_names"), root.alias("_root"))
    issue = F.when(~F.col("_suffix").isin("pdf", *ROOTS), "TYPE").when(F.col("n_bytes") == 0, "EMPTY").when(F.col("n_bytes") > largest, "TOO_LARGE").when(~F.coalesce(content, F.lit(False)), "CONTENT")
    return rows.select("name", "n_bytes", issue.alias("issue"))


def read(spark: SparkSession, pattern: str, largest: int = LARGEST, names: DataFrame | None = None) -> DataFrame:
    """(path, length, content) of files; the content of those that are too large isn't read.

    A scan has no rows of empty files: those of `names` (path or name) that it hasn't are given as empty.
    """
    files = spark.read.format("binaryFile").load(pattern)
    small = files.where(F.col("length") <= largest).select("path", "length", "content")
    rows = small.unionByName(files.where(F.col("length") > largest).select("path", "length", F.lit(None).cast("binary").alias("content")))
    if names is None:
        return rows
    name = lambda c: F.element_at(F.split(c, "/"), -1)
    left = names.toDF("path").join(files.select(name("path").alias("_name")), name("path") == F.col("_name"), "left_anti")
    return rows.unionByName(left.select("path", F.lit(0).cast("long").alias("length"), F.lit(b"").alias("content")))
