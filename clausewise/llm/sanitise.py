"""Personal data: base patterns, and information-theoretic sanitisation of what reveals them.

Base spans are found by pattern, leftmost and non-overlapping per kind, and validated. Protected
entities are each span's value, its class (an email's domain, an address's first two parts, a
card's first six digits, a phone's first four) and its kind: a term can give away a single value, or that a
text holds a card number of some issuer, or a card number at all. A term is a run of three letters
or more outside the base spans of a text, however far from them. Over the distinct texts of the corpus, so
that copies reveal nothing by themselves, the pointwise mutual information of term and entity,

    log2(n(term, entity) * N / (n(term) * n(entity))),

as a share of the entity's own information log2(N / n(entity)), says how much of the entity a
reader learns from the term: 1 if the term is only found with it. A term with at least `SUPPORT`
texts in common with the entity is edited wherever it is in the entity's texts at a share of
`GENERALISE`. It is generalised to the longest of its first 3, 6, 12, ... letters for which
all terms of the corpus that start alike, counted together, tell less than that; it is removed if there is none,
or at a share of `REMOVE`. Documents without an entity are left as they are.

Everything is a DataFrame expression; matches, terms and counts are found without Python.

Edge cases: null text counts as empty in the digest and stays null in `sanitised`; null ids are
kept; equal texts get equal results; an empty table gives an empty result; columns of any name
besides doc_id and text are carried along.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausewise.llm.common import written

# The base patterns. Possessive runs and the look-behind only keep the search linear.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9]){11,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
KINDS = [*PATTERNS, "term"]
REPLACED = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]"}
TERM = r"\p{L}{3,}+"
#: Letters of the most general form of a term; the next ones have twice as many each.
STEM, STEMS = 3, 12
SUPPORT, GENERALISE, REMOVE = 3, 0.8, 0.95
#: Rows of small tables (pairs, entities, repeated texts, spans) that may be broadcast.
BROADCAST_ROWS = 1 << 17

_SPAN = "struct<start:int,end:int,value:string>"
_CHUNK = 256  # appended to at a time, so that many matches in a text don't copy each other


def located(text: Column, pattern: str) -> Column:
    """Leftmost non-overlapping matches with start and end in code points."""
    found = F.regexp_extract_all(text, F.lit(pattern), 0)
    pieces = F.zip_with(F.split(text, pattern, -1), found, lambda p, m: F.struct(F.length(p).alias("gap"), F.length(m).alias("len"), m.alias("value")))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<array<{_SPAN}>>").alias("done"), F.array().cast(f"array<{_SPAN}>").alias("cur"))

    def add(acc: Column, x: Column) -> Column:
        full = F.size(acc["cur"]) >= _CHUNK
        a = acc["at"] + x["gap"]
        span = F.array(F.struct(a.alias("start"), (a + x["len"]).alias("end"), x["value"].alias("value")))
        more = F.struct(
            (a + x["len"]).alias("at"),
            F.when(full, F.concat(acc["done"], F.array(acc["cur"]))).otherwise(acc["done"]).alias("done"),
            F.when(full, span).otherwise(F.concat(acc["cur"], span)).alias("cur"),
        )
        return F.when(x["value"].isNull(), acc).otherwise(more)  # the last piece has no match after it

    return F.aggregate(pieces, start, add, lambda acc: F.flatten(F.concat(acc["done"], F.array(acc["cur"]))))


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _luhn(value: Column) -> Column:
    d = F.reverse(_digits(value))
    # from the right, every second digit is doubled; 9 is taken from what has two digits
    total = F.aggregate(F.sequence(F.lit(1), F.length(d)), F.lit(0), lambda a, i: a + _weighed(F.substring(d, i, F.lit(1)).cast("int"), i))
    return total % 10 == 0


def _weighed(x: Column, i: Column) -> Column:
    return F.when(i % 2 == 1, x).when(x > 4, 2 * x - 9).otherwise(2 * x)


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        part = lambda x: F.coalesce(F.nullif(F.regexp_replace(x, "^0+", ""), F.lit("")), F.lit("0"))
        return F.forall(F.split(value, r"\."), lambda x: (F.length(part(x)) <= 3) & (part(x).cast("decimal(38,0)") <= 255))
    if kind == "card":
        return F.length(_digits(value)).between(12, 19) & _luhn(value)
    if kind == "phone":
        return F.length(_digits(value)).between(9, 15)
    return F.lit(True)


def _checked(spans: Column, i: int, kind: str) -> Column:
    valid = F.filter(spans, lambda x: _valid(kind, x["value"]))
    return F.transform(valid, lambda x: F.struct(x["start"].alias("start"), F.lit(i).alias("kind"), x["end"].alias("end"), x["value"].alias("value")))


# What a text must contain for a pattern to match at all.
_HINTS = {"email": lambda t: t.contains("@"), "ip": lambda t: t.rlike(r"[0-9]\.[0-9]"), "card": lambda t: t.rlike("[0-9][0-9 -]{10}"), "phone": lambda t: t.contains("+")}


def with_base(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds `base`: spans (start, kind, end, value) by start, then kind as listed (kind: 0 for email and so on)."""
    t = F.col(text)
    each = []
    for i, (kind, pattern) in enumerate(PATTERNS.items()):
        spans = _checked(located(t, pattern), i, kind)
        each.append(F.when(_HINTS[kind](t), spans).otherwise(F.array().cast("array<struct<start:int,kind:int,end:int,value:string>>")))
    return docs.withColumn("base", F.coalesce(F.array_sort(F.concat(*each)), F.array().cast("array<struct<start:int,kind:int,end:int,value:string>>")))


def _masked(text: Column, base: Column) -> Column:
    """The text with its base spans overwritten by as many digits: terms are found around them, at their places in the text."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def cover(acc: Column, x: Column) -> Column:
        a, b = F.greatest(acc["at"], x["start"]), F.greatest(acc["at"], x["end"])
        piece = F.concat(F.substring(text, acc["at"] + 1, a - acc["at"]), F.repeat(F.lit("0"), b - a))
        return F.struct(b.alias("at"), F.concat(acc["out"], F.array(piece)).alias("out"))

    whole = F.aggregate(base, start, cover, lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(text, acc["at"] + 1, F.length(text))))
    return F.when(F.size(base) > 0, whole).otherwise(text)


def _entities(base: Column) -> Column:
    """Values, classes and kinds of the spans."""
    digits = lambda b: _digits(b["value"])
    block = lambda b: F.when(b["kind"] == 0, F.lower(F.substring_index(b["value"], "@", -1))).when(b["kind"] == 1, F.substring_index(b["value"], ".", 2)).when(b["kind"] == 2, F.substring(digits(b), 1, 6)).otherwise(F.substring(digits(b), 1, 4))
    each = F.transform(base, lambda b: F.array(F.concat_ws(":", b["kind"].cast("string"), b["value"]), F.concat_ws("/", b["kind"].cast("string"), block(b)), b["kind"].cast("string")))
    return F.array_distinct(F.flatten(each))


def candidates(docs: DataFrame) -> DataFrame:
    """(key, entities, found) of each text of `docs` (text, key, base) that has entities; found: (start, end, term) of every term of the text."""
    found = located(_masked(F.col("text"), F.col("base")), TERM)
    terms = F.transform(found, lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), F.lower(m["value"]).alias("term")))
    return docs.where(F.size("base") > 0).select("key", _entities(F.col("base")).alias("entities"), terms.alias("found")).dropDuplicates(["key"])


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _distinct_texts(docs: DataFrame) -> tuple[DataFrame, int]:
    """Each text of `docs` once, and their number. Only texts that occur again are moved."""
    texts = docs.where("text is not null").select("text", F.md5("text").alias("key"))
    again = written(texts.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "again")
    total = texts.count() - (again.agg(F.sum(F.col("n") - 1).alias("n")).first().n or 0)
    keys = _small(again.select("key"))
    return texts.join(keys, "key", "left_anti").unionByName(texts.join(keys, "key", "left_semi").dropDuplicates(["key"])).select("text"), total


def _share(n_te: Column, n_t: Column, total: int) -> Column:
    """What part of an entity's information (`n_e` texts of `total`) a reader learns from what occurs `n_t` times, `n_te` of them with it."""
    own = F.log2(F.lit(total) / F.col("n_e"))
    return F.when(own > 0, F.log2(n_te * F.lit(total) / (n_t * F.col("n_e"))) / own).otherwise(0.0)


def _stems(term: Column) -> Column:
    """The first 3, 6, 12, ... letters of a term, none of them all."""
    sizes = F.array(*[F.lit(STEM << i) for i in range(STEMS)])
    return F.transform(F.filter(sizes, lambda n: n < F.length(term)), lambda n: F.substring(term, F.lit(1), n))


def disclosing(cands: DataFrame, docs: DataFrame) -> DataFrame:
    """(entity, term, share, keep) of the terms whose share of disclosure reaches GENERALISE; keep: letters that may stay."""
    each = cands.select(F.explode("entities").alias("entity"), F.array_distinct(F.transform("found", lambda x: x["term"])).alias("terms"))
    # a term can't have more texts in common with an entity than the entity has
    n_e = written(each.groupBy("entity").agg(F.count("*").alias("n_e")).where(F.col("n_e") >= SUPPORT), "entities")
    both = each.join(_small(n_e), "entity").select("entity", "n_e", F.explode("terms").alias("term"))
    pairs = _small(written(both.groupBy("entity", "n_e", "term").agg(F.count("*").alias("n_te")).where(F.col("n_te") >= SUPPORT), "pairs"))

    texts, total = _distinct_texts(docs)
    words = F.transform(F.regexp_extract_all(_masked(F.col("text"), F.col("base")), F.lit(TERM), F.lit(0)), F.lower)
    n_t = written(with_base(texts).select(F.explode(F.array_distinct(words)).alias("term")).groupBy("term").agg(F.count("*").alias("n_t")), "terms")
    told = n_t.join(pairs, "term").select("entity", "n_e", "term", _share(F.col("n_te"), F.col("n_t"), total).alias("share")).where(F.col("share") >= GENERALISE)
    told = written(told, "told")

    # what may stay of the terms that need not go altogether
    asked = told.where(F.col("share") < REMOVE).select("entity", "n_e", "term", F.explode(_stems(F.col("term"))).alias("stem"))
    stems, entities = _small(asked.select("stem").distinct()), _small(asked.select("entity").distinct())
    n_s = n_t.select("n_t", F.explode(F.array_append(_stems(F.col("term")), F.col("term"))).alias("stem")).join(stems, "stem", "left_semi").groupBy("stem").agg(F.sum("n_t").alias("n_s"))
    own = each.join(entities, "entity", "left_semi").select("entity", F.explode("terms").alias("term"))
    n_se = own.select("entity", F.explode(F.array_append(_stems(F.col("term")), F.col("term"))).alias("stem")).join(stems, "stem", "left_semi").groupBy("entity", "stem").agg(F.count("*").alias("n_se"))
    general = asked.join(n_s, "stem").join(n_se, ["entity", "stem"]).where(_share(F.col("n_se"), F.col("n_s"), total) < GENERALISE).groupBy("entity", "term").agg(F.max(F.length("stem")).alias("keep"))
    return told.join(_small(written(general, "general")), ["entity", "term"], "left").select("entity", "term", "share", F.coalesce("keep", F.lit(0)).alias("keep"))


_TERMS = "array<struct<start:int,end:int,share:double,keep:int>>"


def with_spans(docs: DataFrame) -> DataFrame:
    """(row, text, base, terms) of the rows of `docs` (text and more): `row` is the whole row, terms are (start, end, share, keep) of the disclosing terms.

    `keep` is how many first letters of the term may stay.
    """
    rows = with_base(docs.select(F.struct("*").alias("row"), "text")).withColumn("key", F.when(F.size("base") > 0, F.md5("text")))
    cands = written(candidates(rows.select("text", "key", "base")), "candidates")
    told = written(disclosing(cands, docs), "told-terms")
    entities = _small(told.select("entity").distinct())
    found = cands.select("key", F.explode("entities").alias("entity"), "found").join(entities, "entity", "left_semi").select("key", "entity", F.explode("found").alias("m"))
    found = found.select("key", "entity", "m.*").join(_small(told), ["entity", "term"])
    spans = found.groupBy("key", "start", "end").agg(F.max("share").alias("share"), F.min("keep").alias("keep"))
    terms = written(spans.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("start", "end", "share", "keep"))).alias("terms")), "spans")
    if (terms.agg(F.sum(F.size("terms")).alias("n")).first().n or 0) <= BROADCAST_ROWS:
        out = rows.join(F.broadcast(terms), "key", "left")
    else:  # only rows that have entities are moved
        none = rows.where(F.size("base") == 0).withColumn("terms", F.lit(None).cast(_TERMS))
        out = none.unionByName(rows.where(F.size("base") > 0).join(terms, "key", "left"))
    return out.withColumn("terms", F.coalesce("terms", F.array().cast(_TERMS))).drop("key")


def sanitised(docs: DataFrame) -> DataFrame:
    """`docs` with base spans replaced by their kind, disclosing terms generalised or removed; columns as they were."""
    rows = with_spans(docs)
    text = F.col("text")
    what = F.create_map(*[F.lit(x) for i, k in enumerate(PATTERNS) for x in (i, REPLACED[k])])
    edits = F.array_sort(F.concat(
        F.transform("base", lambda b: F.struct(b["start"].alias("start"), b["end"].alias("end"), F.element_at(what, b["kind"]).alias("by"))),
        F.transform("terms", lambda t: F.struct(t["start"].alias("start"), t["end"].alias("end"), F.when(t["keep"] > 0, F.concat(F.substring(text, t["start"] + 1, t["keep"]), F.lit("*"))).otherwise("").alias("by"))),
    ))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def edit(acc: Column, x: Column) -> Column:
        """What overlaps an earlier span goes with it."""
        piece = F.concat(F.substring(text, acc["at"] + 1, x["start"] - acc["at"]), x["by"])
        return F.struct(F.greatest(acc["at"], x["end"]).alias("at"), F.when(x["start"] < acc["at"], acc["out"]).otherwise(F.concat(acc["out"], F.array(piece))).alias("out"))

    whole = F.aggregate(edits, start, edit, lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(text, acc["at"] + 1, F.length(text))))
    new = F.when(F.size("base") + F.size("terms") > 0, whole).otherwise(text)
    return rows.select(*((new if c == "text" else F.col("row")[c]).alias(c) for c in docs.columns))


def digest(docs: DataFrame) -> DataFrame:
    """Contract of op9."""
    rows = with_spans(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")))
    names = F.array(*[F.lit(k) for k in KINDS])
    said = lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["start"].cast("string"), x["end"].cast("string"))
    count = lambda i: F.size(F.filter("base", lambda x: x["kind"] == i)).cast("long")
    every = F.array_sort(F.concat(
        F.transform("base", lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end"))),
        F.transform("terms", lambda x: F.struct(x["start"].alias("start"), F.lit(len(PATTERNS)).alias("kind"), x["end"].alias("end"))),
    ))
    return rows.select(
        F.col("row.doc_id").alias("doc_id"), *(count(i).alias(f"n_{k}") for i, k in enumerate(PATTERNS)),
        F.sha2(F.array_join(F.transform("base", said), ","), 256).alias("base_sha256"),
        F.array_join(F.transform(every, said), ",").alias("spans"),
        F.size("terms").cast("long").alias("n_term"), F.size(F.filter("terms", lambda t: t["keep"] > 0)).cast("long").alias("n_generalised"),
    )
