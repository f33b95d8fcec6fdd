"""Chunks, packs and diverse selections: orders whose next step depends on the last.

Each group (a document, a run, a query's candidates) becomes one row with its members in order, and
an Arrow function folds over many such rows at a time. Groups are small and independent.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from clausewise.functions.clauses import ITEM, NUMERIC, START, oversized_parts, starts_clause, stripped, with_clauses

TARGET, MOST, OVERLAP = 1800, 2400, 120


def _folded(df: DataFrame, key: str, order: list, fold: Callable[[list[dict]], list[dict]], schema: StructType) -> DataFrame:
    """Rows that `fold` makes of each key's rows, which it gets in order."""
    members = F.array_sort(F.collect_list(F.struct(*[F.expr(o) if isinstance(o, str) else o for o in order], F.struct(*df.columns).alias("_row"))))
    groups = df.groupBy(key).agg(members.alias("_rows")).select(F.transform("_rows", lambda x: x["_row"]).alias("rows"))
    kind = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[dict] = []
            for group in batch.column("rows"):  # one group at a time is held as rows
                out += fold(group.as_py())
                if len(out) >= 10_000:
                    yield pa.RecordBatch.from_pylist(out, kind)
                    out = []
            yield pa.RecordBatch.from_pylist(out, kind)

    return groups.mapInArrow(run, schema)


# Kinds that stay alone, ends of sentences, beginnings that go on with one.
ATOMIC = ("TABLE", "IMAGE")
SENTENCE_CLOSED = r"(?U)[。！？；：;:]\s*$"
GOES_ON = r"^(?:[，、；;。！？）)】]|(?:以内|以上|以下|以及|或者|并且|且|并|但|而|的|了|内|外))"
#: Lengths up to which list items and sibling clauses stay with what is before them, and of a group of siblings.
SHORT, SIBLINGS = 360, 1000
STARTS, LISTED, NUMBERED = 1, 2, 4


def _numbers(sizes, kinds, sections, clauses, parents, marks, target: int, most: int) -> list[int]:
    """The chunk of each node of a document, -1 for nodes that are in none (headings, blanks)."""
    out, chunk = [], -1
    held: list[int] = []  # nodes of the open chunk
    total = 0
    for i, (n, kind) in enumerate(zip(sizes, kinds)):
        if not n or kind == "SECTION":
            out.append(-1)
            continue
        if kind in ATOMIC:
            chunk, held, total = chunk + 1, [], 0
            out.append(chunk)
            continue
        if held:
            last, family = held[-1], parents[i] is not None
            child = family and marks[i] & LISTED and n <= SHORT and any(parents[i] in (clauses[j], parents[j]) for j in held)
            sibling = family and marks[i] & NUMBERED and marks[last] & NUMBERED and n <= SHORT and sizes[last] <= SHORT and parents[last] == parents[i]
            longer = total + n + 1
            over = longer > most or total >= target or (sibling and longer > SIBLINGS)
            if over or sections[held[0]] != sections[i] or (marks[i] & STARTS and not child and not sibling):
                held, total = [], 0
        if not held:
            chunk += 1
        held.append(i)
        total += n + 1
        out.append(chunk)
    return out


def _numbering(target: int, most: int):
    @F.pandas_udf("array<int>")
    def number(sizes: pd.Series, kinds: pd.Series, sections: pd.Series, clauses: pd.Series, parents: pd.Series, marks: pd.Series) -> pd.Series:
        return pd.Series([_numbers(*x, target, most) for x in zip(*(map(list, c) for c in (sizes, kinds, sections, clauses, parents, marks)))])

    return number


def chunk_nodes(nodes: DataFrame, key: str, target: int = TARGET, most: int = MOST, overlap: int = OVERLAP) -> DataFrame:
    """(key, chunk, part, section, first, last, n_nodes, page_first, page_last, kinds, clauses, parents, text) of nodes (key, order_no, kind, section, page, content).

    Nodes of a section are put together until the target is reached; a chunk also ends where a
    clause begins, but short list items stay with their clause and short numbered siblings with each other. Tables
    and images are chunks of their own, headings only part of the section. A chunk longer than `most`
    is split between sentences. What decides are lengths and marks: texts stay in the JVM.
    """
    nodes = with_clauses(nodes.select(key, "order_no", F.upper("kind").alias("kind"), F.coalesce("section", F.lit("")).alias("section"), "page", stripped(F.coalesce("content", F.lit(""))).alias("content")), [key], "order_no")
    text = F.col("content")
    marks = F.when(text.rlike(START), STARTS).otherwise(0) + F.when(text.rlike(ITEM), LISTED).otherwise(0) + F.when(text.rlike(NUMERIC), NUMBERED).otherwise(0)
    rows = nodes.withColumn("marks", marks).withColumn("size", F.length(text))
    docs = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("order_no", "kind", "section", "page", "content", "clause", "parent", "marks", "size"))).alias("nodes"))
    of = lambda name: F.transform("nodes", lambda x: x[name])
    docs = docs.withColumn("chunks", _numbering(target, most)(*(of(c) for c in ("size", "kind", "section", "clause", "parent", "marks"))))
    each = docs.select(key, F.inline(F.arrays_zip("nodes", "chunks"))).where("chunks >= 0").select(key, F.col("chunks").alias("chunk"), "nodes.*")
    member = F.array_sort(F.collect_list(F.struct("order_no", "kind", "section", "page", "content", "clause", "parent")))
    whole = each.groupBy(key, "chunk").agg(member.alias("m"))
    of = lambda name: F.transform("m", lambda x: x[name])
    known = lambda name: F.array_distinct(F.filter(of(name), lambda x: x.isNotNull()))
    return whole.select(
        key, "chunk", F.posexplode(oversized_parts(F.array_join(of("content"), "\n"), most, overlap)).alias("part", "text"),
        F.col("m")[0]["section"].alias("section"), F.col("m")[0]["order_no"].alias("first"), F.element_at("m", -1)["order_no"].alias("last"), F.size("m").alias("n_nodes"),
        F.array_min(of("page")).alias("page_first"), F.array_max(of("page")).alias("page_last"), known("kind").alias("kinds"), known("clause").alias("clauses"), known("parent").alias("parents"),
    )


def pack_batches(items: DataFrame, key: str, order: str, size: str, most_items: int, most_size: int, overhead: int = 0) -> DataFrame:
    """Adds `batch`: items in order, a new batch where the next item would be one too many or too large."""

    def fold(rows: list[dict]) -> list[dict]:
        batch = n = total = 0
        out = []
        for r in rows:
            s = r[size] + overhead
            if n and (n >= most_items or total + s > most_size):
                batch, n, total = batch + 1, 0, 0
            n, total = n + 1, total + s
            out.append({**r, "batch": batch})
        return out

    return _folded(items, key, [order], fold, StructType([*items.schema, StructField("batch", IntegerType())]))


def diverse(candidates: DataFrame, query: str, limit: int, weight: float = 0.8) -> DataFrame:
    """Maximal marginal relevance: `place` of the chosen (query, id, score, words), words being a distinct array.

    Relevance is the score's share of the best one, or falls with the rank if no score is positive.
    """
    candidates = candidates.select(query, "id", "score", "words")

    def fold(rows: list[dict]) -> list[dict]:
        peak = rows[0]["score"]
        rel = [r["score"] / peak if peak > 0 else 1 - i / len(rows) for i, r in enumerate(rows)]
        words = [set(r["words"] or ()) for r in rows]
        near, chosen, left = [0.0] * len(rows), [], list(range(len(rows)))
        while left and len(chosen) < limit:
            best = max(left, key=lambda i: (weight * rel[i] - (1 - weight) * near[i], -i))
            left.remove(best)
            chosen.append(best)
            for i in left:
                union = len(words[i] | words[best])
                near[i] = max(near[i], len(words[i] & words[best]) / union if union else 0.0)
        return [{query: rows[i][query], "id": rows[i]["id"], "place": place} for place, i in enumerate(chosen)]

    schema = StructType([candidates.schema[query], candidates.schema["id"], StructField("place", IntegerType())])
    return _folded(candidates, query, [(-F.col("score")).alias("_s"), "id"], fold, schema)


def merge_residues(nodes: DataFrame, key: str, short: int = 28) -> DataFrame:
    """Adds `into`: the order_no of the node that a short residue joins, its own for others.

    A residue follows on the same page, is no table or image and begins no clause; what it joins is no
    table or image, and doesn't end a sentence or the residue goes on in the middle of one. A node that takes a residue is
    longer and may take the next.
    """
    text = F.coalesce("content", F.lit(""))
    visible = F.length(F.regexp_replace(text, r"(?U)\s+", ""))
    block = F.upper("kind").isin(*ATOMIC)
    may = ~block & ~starts_clause(text) & (visible > 0) & (visible <= short)
    # a residue that joins ends what it joins, so whether a node's end is open depends on the row before only
    w = Window.partitionBy(key).orderBy("order_no")
    rows = nodes.withColumn("_open", ~text.rlike(SENTENCE_CLOSED)).withColumn("_may", may).withColumn("_block", block)
    joins = F.col("_may") & (F.lag("page").over(w).eqNullSafe(F.col("page"))) & ~F.coalesce(F.lag("_block").over(w), F.lit(True)) & (F.lag("_open").over(w) | text.rlike(GOES_ON))
    own = F.when(F.coalesce(joins, F.lit(False)), None).otherwise(F.col("order_no"))
    rows = rows.withColumn("_own", own)
    return rows.withColumn("into", F.last("_own", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_open", "_may", "_block", "_own")
