"""Citations of answers: which sources an answer may name, and the answer without the others."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Kinds of sources, in the order in which citations are listed, and a marker of one.
KINDS = ("Evidence", "Legal", "Report")
MARKER = r"【(Evidence|Legal|Report):\s*([0-9a-fA-F-]{36})】"
ANY_MARKER = r"【(?:Evidence|Legal|Report):[^】]*】"
#: Sources that stand for an answer that names none.
FALLBACK = 8


def verified(answers: DataFrame, allowed: DataFrame, message: str = "message", fallback: bool = False) -> DataFrame:
    """(message, answer, citations) of `answers` (message, answer): an array of (kind, id, quote), by kind and first mention, each once.

    `allowed` (message, kind, id, place, quote) are the sources that the answer was made from, met as a map of a message; ids are told
    apart as they are written. Markers of others, and broken ones, go; so does white space around what is left. With
    `fallback` an answer that cites nothing gets its first `FALLBACK` sources by place.
    """
    own = F.struct("kind", "id", "quote")
    by = allowed.groupBy(message).agg(F.collect_list(F.struct(F.concat_ws(":", "kind", "id").alias("key"), "place", own.alias("x"))).alias("_all"))
    both = answers.select(message, "answer").join(by, message, "left")
    every = F.array_sort(F.coalesce("_all", F.array().cast(dict(both.dtypes)["_all"])), lambda a, b: F.when(a.place < b.place, -1).when(a.place > b.place, 1).when(a.key < b.key, -1).when(a.key > b.key, 1).otherwise(0))
    keys = F.transform(every, lambda e: e.key)
    text = F.coalesce("answer", F.lit(""))
    rows = both.select(message, text.alias("answer"), every.alias("_every"), keys.alias("_keys"), F.split(text, ANY_MARKER).alias("_pieces"), F.regexp_extract_all(text, F.lit(ANY_MARKER), F.lit(0)).alias("_marks"))
    key = lambda m: F.concat_ws(":", F.nullif(F.regexp_extract(m, MARKER, 1), F.lit("")), F.nullif(F.regexp_extract(m, MARKER, 2), F.lit("")))
    rows = rows.withColumn("_named", F.transform("_marks", key))
    kept = F.zip_with("_marks", "_named", lambda m, k: F.when(F.array_contains("_keys", k), m).otherwise(""))
    answer = F.array_join(F.zip_with("_pieces", kept, lambda p, m: F.concat(p, F.coalesce(m, F.lit("")))), "")
    at = lambda k: F.get("_every", (F.array_position("_keys", k) - 1).cast("int")).x
    named = F.array_distinct(F.filter("_named", lambda k: F.array_contains("_keys", k)))
    of = lambda kind: F.filter(named, lambda k: k.startswith(f"{kind}:"))
    cited = F.transform(F.flatten(F.array(*map(of, KINDS))), at)
    first = F.transform(F.slice("_every", 1, FALLBACK), lambda e: e.x)
    out = F.when(F.size(cited) > 0, cited).otherwise(first) if fallback else cited
    return rows.select(message, F.regexp_replace(answer, r"^(?U)\s+|(?U)\s+$", "").alias("answer"), out.alias("citations"))
