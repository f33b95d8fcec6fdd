"""Requirements against materials with three-valued conditions, and the decision on a bid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausewise.operators.ranking import first_per
from clausewise.operators.scores import share

MISSING, UNCERTAIN, MATCHED = "MISSING", "UNCERTAIN", "MATCHED"


def rank(status: Column) -> Column:
    return F.when(status == MATCHED, 2).when(status == UNCERTAIN, 1).otherwise(0)


def evaluate(conditions: list[Column], confirmed: Column, valid_to: Column, deadline: Column) -> Column:
    """Status of one requirement and material. A condition is true, false, or null if the facts don't tell.

    Unconfirmed or expired: missing. Any false: missing. Any null: uncertain. Else matched, also without conditions.
    """
    expired = F.coalesce(valid_to < deadline, F.lit(False))
    no, unknown = F.lit(False), F.lit(False)
    for c in conditions:
        no = no | F.coalesce(~c, F.lit(False))
        unknown = unknown | c.isNull()
    return F.when(~F.coalesce(confirmed, F.lit(False)) | expired | no, MISSING).when(unknown, UNCERTAIN).otherwise(MATCHED)


def amount_at_least(amount: Column, asked: Column) -> Column:
    """An unreadable demand is unknown; a missing amount is no."""
    return F.when(asked.isNotNull(), F.coalesce(amount >= asked, F.lit(False)))


def level_is(level: Column, asked: Column) -> Column:
    return F.when(level.isNotNull(), (asked == level) | asked.isin("", "None"))


def has_tag(kind: Column, allowed: Column, tags: Column, tag: Column) -> Column:
    """Unknown tag: null. Wrong kind of material: false. No list of tags: null. Else whether it is listed."""
    return F.when(allowed.isNull(), None).when(~F.array_contains(allowed, kind), False).when(tags.isNotNull(), F.array_contains(tags, tag))


def all_present(have: Column, need: Column) -> Column:
    """True if everything needed is there; something that isn't listed is unknown, not false."""
    return F.when(F.size(F.array_except(need, have)) == 0, True)


def _given(text: Column) -> Column:
    """A trimmed text, null if nothing is left."""
    return F.nullif(F.trim(text), F.lit(""))


def personnel(kind: Column, persons: Column, wanted: Column, tag: Column | None = None) -> Column:
    """Whether a list of persons (role, certificate, years) has who is wanted: structs (role, certificate, years) of texts and numbers.

    Each wanted one needs a person of the role, if one is named, with just the certificate and at least the years. Nobody of a
    named role, or only persons with too few years: false. A certificate that is missing or named otherwise, unknown years, nothing listed or
    nothing wanted: null. The first wanted one that isn't met decides. `tag` false rules a material out.
    """

    def met(want: Column) -> Column:
        role, certificate = _given(want["role"]), _given(want["certificate"])
        there = F.filter(persons, lambda p: role.isNull() | F.coalesce(_given(p["role"]) == role, F.lit(False)))
        held = lambda p: certificate.isNull() | F.coalesce(_given(p["certificate"]) == certificate, F.lit(False))
        fits = F.exists(there, lambda p: held(p) & (want["years"].isNull() | F.coalesce(p["years"] >= want["years"], F.lit(False))))
        unsure = F.exists(there, lambda p: ~held(p) | (want["years"].isNotNull() & p["years"].isNull()))
        return F.when(F.size(there) == 0, F.when(role.isNotNull(), False)).when(fits, True).when(unsure, None).otherwise(False)

    results = F.transform(wanted, met)
    first = F.element_at(F.filter(results, lambda r: ~F.coalesce(r, F.lit(False))), 1)
    all_met = F.forall(results, lambda r: F.coalesce(r, F.lit(False)))
    out = F.when(all_met, True).otherwise(F.when(F.size(F.filter(results, lambda r: ~F.coalesce(r, F.lit(False)))) > 0, first))
    nothing = wanted.isNull() | persons.isNull() | (F.size(wanted) == 0) | (F.size(persons) == 0)
    return F.when(~(kind == "PERSONNEL") | ~F.coalesce(F.lit(True) if tag is None else tag, F.lit(True)), False).when(nothing, None).otherwise(out)


def financial(kind: Column, revenue: Column, debt: Column, years: Column, least_revenue: Column, most_debt: Column, least_years: Column, tag: Column | None = None) -> Column:
    """Revenue, debt ratio and years of reports against what is asked of them, in this order: the first that is unknown or fails decides. Nothing asked: null."""
    wrong = ~(kind == "FINANCE") | ~F.coalesce(F.lit(True) if tag is None else tag, F.lit(True))
    out = F.when(wrong, False)
    for asked, have, ok in ((least_revenue, revenue, revenue >= least_revenue), (most_debt, debt, debt <= most_debt), (least_years, years, years >= least_years)):
        out = out.when(asked.isNotNull() & have.isNull(), None).when(asked.isNotNull() & ~ok, False)
    return out.when(least_revenue.isNotNull() | most_debt.isNotNull() | least_years.isNotNull(), True)


def experience(kind: Column, projects: Column, amount: Column, sort: Column, wanted: Column) -> Column:
    """Number, amount and type of earlier projects against all of `wanted`: structs (projects, amount, type).

    Too few projects or too small or no amount: false. An unknown number, and a type that is unknown or another, is a matter of
    judgement: null, as is a null among the wanted.
    """

    def fails(w: Column) -> Column:
        return F.coalesce(projects < w["projects"], F.lit(False)) | (w["amount"].isNotNull() & (amount.isNull() | F.coalesce(amount < w["amount"], F.lit(False))))

    def unsure(w: Column) -> Column:
        type_ = _given(w["type"])
        return w.isNull() | (w["projects"].isNotNull() & projects.isNull()) | (type_.isNotNull() & ~F.coalesce(_given(sort) == type_, F.lit(False)))

    known = F.coalesce(wanted, F.array(F.lit(None).cast("struct<projects:int,amount:double,type:string>")))
    return F.when(~(kind == "PROJECT_EXPERIENCE"), False).when(F.exists(known, lambda w: F.coalesce(fails(w), F.lit(False))), False).when(F.exists(known, unsure), None).otherwise(True)


def best_material(pairs: DataFrame, requirement: str, material: str, status: str = "status", order: list | None = None) -> DataFrame:
    """The best material of each requirement: a strictly better status wins, else the first. If the best is missing there is none."""
    best = first_per(pairs, [requirement], [F.desc(rank(F.col(status))), *(order or [material])])
    return best.withColumn(material, F.when(F.col(status) != MISSING, F.col(material)))


def decision(matches: DataFrame, risks: DataFrame, key: str) -> DataFrame:
    """(key, score, decision): an open high risk rules a bid out; else 80 per cent of requirements must be matched."""
    m = matches.groupBy(key).agg(F.count("*").alias("n"), F.count_if(F.col("final_status") == MATCHED).alias("matched"))
    open_high = F.col("severity").isin("CRITICAL", "HIGH") & (F.col("status") == "OPEN")
    r = risks.groupBy(key).agg(F.bool_or(open_high).alias("blocked"))
    x = m.join(r, key, "full")
    score = share(F.coalesce("matched", F.lit(0)), F.coalesce("n", F.lit(0)))
    out = x.select(key, score.alias("score"), F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("blocked", F.lit(False)).alias("blocked"))
    return out.select(key, "score", F.when(F.col("blocked"), "NO_BID").when((F.col("n") > 0) & (F.col("score") >= 80), "BID").otherwise("PENDING").alias("decision"))
