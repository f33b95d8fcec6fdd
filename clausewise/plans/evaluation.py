"""Retrieval evaluation: which expected texts are found, and at what rank."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausewise.sources.stored import written

_SPACES = " 　"
#: Cases of a block, all of which are looked for in one pass over the texts; the letter at which texts are cut to pieces, and a piece's least length.
BLOCK, CUT, LEAST = 4096, "e", 3
#: Blocks that go to every task at once; more are looked for one after the other.
BLOCKS = 16
#: One text in so many is looked through first.
FIRST = 64


def _with_blocks(rows: DataFrame, held: DataFrame, n: int) -> DataFrame:
    """Every row with every one of the n blocks (block, and more), of which tasks hold `BLOCKS` at a time."""
    parts = [held] if n <= BLOCKS else [held.where(F.col("block").between(b, b + BLOCKS - 1)) for b in range(0, n, BLOCKS)]
    return reduce(DataFrame.unionByName, [rows.join(F.broadcast(part)) for part in parts])


def squeezed(text):
    """Without ASCII and ideographic spaces."""
    return F.translate(text, _SPACES, "")


def contained(cases: DataFrame, docs: DataFrame, case: str = "item_id") -> DataFrame:
    """(case, n_docs): in how many rows of `docs` each case's text occurs, spaces aside; cases and rows may repeat.

    Texts are cut at a letter. What a case has between two cuts is a whole piece of every text that
    has the case, so only texts with a case's longest piece are searched for it. Cases without such a piece are
    searched for in every text. Cases go in blocks, each one row, of which `BLOCKS` are broadcast at a time; every text is read once for these.
    """
    rows = cases.select(case, squeezed(F.col("text")).alias("needle"))
    pieces = F.split("needle", CUT)
    inner = F.filter(F.slice(pieces, 2, F.greatest(F.size(pieces) - 2, F.lit(0))), lambda x: F.length(x) >= LEAST)
    anchor = F.element_at(F.transform(F.array_sort(F.transform(inner, lambda x: F.struct(F.length(x).alias("n"), x.alias("x")))), lambda x: x["x"]), -1)
    rows = rows.withColumn("anchor", F.when(F.size(inner) > 0, anchor))
    n = max(1, -(-rows.count() // BLOCK))
    block = F.pmod(F.xxhash64("anchor", "needle"), F.lit(n))
    held = rows.groupBy(block.alias("block")).agg(F.array_sort(F.collect_set(F.struct("anchor", "needle"))).alias("cases"), F.collect_set("anchor").alias("anchors"))
    hay = docs.select(squeezed(F.col("text")).alias("hay")).where("hay is not null")
    both = _with_blocks(hay, held, n).withColumn("own", F.array_intersect("anchors", F.split("hay", CUT)))
    found = F.filter("cases", lambda c: (c["anchor"].isNull() | F.array_contains("own", c["anchor"])) & F.col("hay").contains(c["needle"]))
    hits = both.select(F.explode(found).alias("c")).groupBy(F.col("c.needle").alias("needle")).agg(F.count("*").alias("n_docs"))
    return rows.select(case, "needle").join(hits, "needle", "left").select(case, F.coalesce("n_docs", F.lit(0)).alias("n_docs"))


def run(cases: DataFrame, ranked: DataFrame, texts: DataFrame, case: str, key: str) -> DataFrame:
    """(case, passed, rank, observed) of each of `cases` (case, expected): the first of its ranked texts (case, key, rank) that contains what is expected, spaces aside."""
    seen = ranked.join(texts.select(key, "text"), key).join(cases.select(case, "expected"), case)
    hit = squeezed(F.col("text")).contains(squeezed(F.col("expected")))
    best = seen.groupBy(case).agg(F.min(F.when(hit, F.col("rank"))).alias("rank"), F.count("*").alias("observed"))
    return cases.select(case).join(best, case, "left").select(case, F.col("rank").isNotNull().alias("passed"), "rank", F.coalesce("observed", F.lit(0)).alias("observed"))


def _recall(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, F.bround(part / whole, 4)).otherwise(0.0)


def summary(ran: DataFrame, scope: str) -> DataFrame:
    """(scope, cases, passed, recall, mrr) of what `run` gave, by scope and of all."""
    n, passed = F.count("*"), F.count("rank")
    return ran.rollup(scope).agg(n.alias("cases"), passed.alias("passed"), _recall(passed, n).alias("recall"), F.bround(F.sum(F.coalesce(1 / F.col("rank"), F.lit(0.0))) / n, 4).alias("mrr"))


def recall_at(ran: DataFrame, k: int, skipped: Column) -> DataFrame:
    """One row (cases, passed, skipped, recall): cases found among their first k; skipped ones don't count."""
    tried = F.count_if(~skipped)
    passed = F.count_if(~skipped & F.coalesce(F.col("rank") <= k, F.lit(False)))
    return ran.agg(F.count("*").alias("cases"), passed.alias("passed"), F.count_if(skipped).alias("skipped"), _recall(passed, tried).alias("recall"))


def _met(rows: DataFrame, wants: DataFrame, scope: str) -> DataFrame:
    """(scope, groups), each once, of `wants` (scope, groups) that a row (scope, low) of the scope meets: it has a term of every group."""
    parts = -(-wants.count() // (BLOCK * BLOCKS))
    if not parts:
        return wants
    held = wants.groupBy(F.col(scope).alias("_scope"), F.pmod(F.xxhash64("groups"), F.lit(parts)).alias("block")).agg(F.collect_list("groups").alias("wants"))
    on = rows[scope].eqNullSafe(F.col("_scope"))
    # all at once, some at a time, or, for very many scopes, with the scopes' texts
    if parts <= BLOCKS:
        both = reduce(DataFrame.unionByName, [rows.join(F.broadcast(held.where(F.col("block") == b)), on) for b in range(parts)])
    else:
        both = rows.join(held, on)
    met = F.filter("wants", lambda w: F.forall(w, lambda g: F.exists(g, lambda t: F.col("low").contains(t))))
    return both.select(scope, F.explode(met).alias("groups")).distinct()


def golden_recall(terms: DataFrame, least: DataFrame, texts: DataFrame, scope: str) -> DataFrame:
    """(scope, n, found, recall, mandatory_recall, passed): items of a golden set for which a text of the scope has a term of every group.

    `terms` is as from golden_terms, a set that people wrote; `least` has the thresholds requirement_recall and mandatory_recall.

    Equal items are looked for once, the group of the longest terms first, as it is most often not met. One text in `FIRST` is looked
    through for all of them, every other text for what its scope hasn't met by then.
    """
    # a group's rank is the length of its shortest term
    group = F.struct((-F.array_min(F.transform("terms", F.length))).alias("n"), F.array_sort(F.array_distinct(F.transform("terms", F.lower))).alias("terms"))
    items = written(terms.groupBy("item", "mandatory").agg(F.transform(F.array_sort(F.collect_set(group)), lambda g: g["terms"]).alias("groups")), "items")
    scopes = written(texts.select(scope).distinct(), "scopes")
    all_ = scopes.join(F.broadcast(items.select("groups").distinct()))
    part = F.pmod(F.xxhash64("text"), F.lit(FIRST)) == 0
    low = lambda rows: rows.where("text is not null").select(scope, F.lower("text").alias("low"))
    early = written(_met(low(texts.where(part)), all_, scope), "early")
    left = written(all_.join(early.withColumnRenamed(scope, "_scope"), all_[scope].eqNullSafe(F.col("_scope")) & (all_["groups"] == early["groups"]), "left_anti"), "left")
    met = early.unionByName(_met(low(texts.where(~part)), left, scope))
    each = scopes.join(items)
    met = met.select(F.col(scope).alias("_scope"), F.col("groups").alias("_groups"), F.lit(True).alias("found"))
    whole = each.join(met, each[scope].eqNullSafe(F.col("_scope")) & (F.col("groups") == F.col("_groups")), "left")  # the result's rows, before they are counted
    n, hits, must, kept = F.count("*"), F.count("found"), F.count_if("mandatory"), F.count_if(F.col("mandatory") & F.col("found").isNotNull())
    out = whole.groupBy(scope).agg(n.alias("n"), hits.alias("found"), _recall(hits, n).alias("recall"), _recall(kept, must).alias("mandatory_recall"))
    limits = least.agg(*(F.coalesce(F.max(F.when(F.col("name") == x, F.col("least"))), F.lit(0.0)).alias(f"_{x}") for x in ("requirement_recall", "mandatory_recall")))
    return out.join(F.broadcast(limits)).select(scope, "n", "found", "recall", "mandatory_recall", ((F.col("recall") >= F.col("_requirement_recall")) & (F.col("mandatory_recall") >= F.col("_mandatory_recall"))).alias("passed"))
