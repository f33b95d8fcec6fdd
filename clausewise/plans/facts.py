"""Facts of a project from reviewed extractions: fields, requirements and the deadline, each with where it comes from."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clausewise.functions.values import deadline

# Tags that become requirements, what mandatory ones begin with, the tag of the deadline.
MATCHABLE = (
    "QUAL_BUSINESS_LICENSE", "QUAL_REGISTERED_CAPITAL", "QUAL_QUALIFICATION", "QUAL_SIMILAR_EXPERIENCE", "QUAL_FINANCIAL", "QUAL_CREDIT",
    "QUAL_TAX", "QUAL_SAFETY", "QUAL_PERSONNEL", "QUAL_EQUIPMENT", "QUAL_INSURANCE",
)
MANDATORY, DEADLINE = "QUAL_", "TIME_BID_DEADLINE"


def _first_of(text: str, other: str):
    return F.coalesce(F.nullif(text, F.lit("")), F.nullif(other, F.lit("")), F.lit(""))


def traced(reviewed: DataFrame, evidence: DataFrame, nodes: DataFrame) -> DataFrame:
    """`reviewed` (project, version, evidence, node, and more) with `primary`, the evidence that bears a row out, and `lineage`.

    It is the row's own if that is evidence (project, version, evidence) of the same project and version (OWN), else the first, by ordinal, of its node's in
    `nodes` (project, version, node, evidence, ordinal) (NODE), else none.
    """
    by = ["project", "version"]
    own = evidence.select(*by, "evidence", F.lit(True).alias("_own")).distinct()
    first = nodes.groupBy(*by, "node").agg(F.min_by("evidence", F.struct("ordinal", "evidence")).alias("_node"))
    both = reviewed.join(own, [*by, "evidence"], "left").join(first, [*by, "node"], "left")
    primary = F.when(F.col("_own").isNotNull(), F.col("evidence")).otherwise(F.col("_node"))
    lineage = F.when(F.col("_own").isNotNull(), "OWN").when(F.col("_node").isNotNull(), "NODE")
    return both.select(*reviewed.columns, primary.alias("primary"), lineage.alias("lineage"))


def projected(reviewed: DataFrame, evidence: DataFrame, nodes: DataFrame, tags: DataFrame) -> DataFrame:
    """(project, kind, code, title, description, value, mandatory, source, primary, lineage) of reviewed rows.

    A FIELD for each of `reviewed` (project, version, code, value VARIANT, human_edited, note, source_text, evidence, node); for those
    of `MATCHABLE` also a REQUIREMENT, with the name in `tags` (code, name), its code without one, and the note or else the
    source text. Values are JSON; a requirement's is its condition. `reviewed` has a row a project and code.
    """
    names = tags.groupBy("code").agg(F.max("name").alias("_name"))
    rows = traced(reviewed, evidence, nodes).join(F.broadcast(names) if names.count() <= 1 << 17 else names, "code", "left")
    field = F.struct(F.lit("FIELD").alias("kind"), F.lit(None).cast("string").alias("title"), F.lit(None).cast("string").alias("description"), F.to_json("value").alias("value"), F.lit(None).cast("boolean").alias("mandatory"))
    condition = F.concat(F.lit('{"items":[{"dimension":"'), F.col("code"), F.lit('","value":'), F.coalesce(F.to_json("value"), F.lit("null")), F.lit("}]}"))
    requirement = F.struct(F.lit("REQUIREMENT").alias("kind"), F.coalesce("_name", "code").alias("title"), _first_of("note", "source_text").alias("description"), condition.alias("value"), F.col("code").startswith(MANDATORY).alias("mandatory"))
    both = F.when(F.col("code").isin(*MATCHABLE), F.array(field, requirement)).otherwise(F.array(field))
    source = F.when(F.col("human_edited"), "PIPELINE_HUMAN").otherwise("PIPELINE_AUTO")
    return rows.withColumn("_x", F.explode(both)).select("project", "_x.kind", "code", "_x.title", "_x.description", "_x.value", "_x.mandatory", source.alias("source"), "primary", "lineage")


def deadlines(projects: DataFrame, reviewed: DataFrame) -> DataFrame:
    """(project, deadline, source) of `projects` (the same): one set by hand stays, else the reviewed one counts if it is a time, else what was there.

    Sources are ranked and the least one taken, in one aggregation.
    """
    there = projects.select("project", F.struct(F.when(F.col("source") == "MANUAL", 0).otherwise(2).alias("rank"), "deadline", "source").alias("x"))
    text = F.try_variant_get("value", "$", "string")
    new = reviewed.where(F.col("code") == DEADLINE).select("project", deadline(text).alias("at")).where("at is not null").join(projects.select("project"), "project", "left_semi")
    new = new.select("project", F.struct(F.lit(1).alias("rank"), F.col("at").alias("deadline"), F.lit("PIPELINE").alias("source")).alias("x"))
    return there.unionByName(new).groupBy("project").agg(F.min_by("x", F.struct("x.rank", "x.deadline")).alias("x")).select("project", "x.deadline", "x.source")


def replaced(previous: DataFrame, facts: DataFrame, documents: DataFrame) -> DataFrame:
    """`previous` (project, document, source, and more) without what people confirmed earlier in the `documents` (project, document) that are projected anew, and `facts`."""
    again = documents.select("project", "document").distinct().withColumn("_again", F.lit(True))
    stay = previous.join(again, ["project", "document"], "left").where(F.col("_again").isNull() | ~F.col("source").eqNullSafe(F.lit("PIPELINE_HUMAN")))
    return stay.select(previous.columns).unionByName(facts, allowMissingColumns=True)
