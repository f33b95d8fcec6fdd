"""Reports: Markdown from rows, quotes in place of markers, lines of an export."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Identifiers and the markers that name them.
UUID = r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}"
MARKER = rf"【Evidence:\s*({UUID})】"
BULLET = ("- ", "* ")
MOST_QUOTED = 500


def render_quotes(text: Column, quotes: Column, table: str = "**{}**\n\n{}", label: str = "原文依据（{}）") -> Column:
    """Markers replaced by what `quotes`, a map of id to (source, quote, table), has of them; identifiers go.

    A table is shown as it is, a quote folded to one line and cut to `MOST_QUOTED`; unknown markers go.
    """
    ids = F.regexp_extract_all(text, F.lit(MARKER), F.lit(1))

    def shown(i: Column) -> Column:
        q = F.try_element_at(quotes, i)
        source = F.concat(F.lit(label.split("{}")[0]), q["source"], F.lit(label.split("{}")[1]))
        line = F.trim(F.regexp_replace(q["quote"], r"(?U)\s+", " "))
        cut = F.when(F.length(line) > MOST_QUOTED, F.concat(F.substring(line, 1, MOST_QUOTED), F.lit("……"))).otherwise(line)
        return F.when(q.isNull(), "").when(q["table"].isNotNull(), F.concat(F.lit("\n\n**"), source, F.lit("**\n\n"), q["table"])).otherwise(F.concat(F.lit("\n\n> "), source, F.lit("："), cut))

    pieces = F.zip_with(F.split(text, MARKER, -1), ids, lambda p, i: F.concat(p, F.when(i.isNull(), "").otherwise(shown(i))))
    return F.regexp_replace(F.array_join(pieces, ""), rf"\b{UUID}\b", "")


def export_lines(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, pos, kind, level, text) of the lines of Markdown as an export lays them out: headings to level 3, bullets, blanks, text."""
    lines = df.select(key, F.posexplode(F.split(F.regexp_replace(text, r"\r\n?", "\n"), "\n")).alias("pos", "line")).withColumn("line", F.trim("line"))
    level = F.when(F.col("line").rlike("^#{1,3} "), F.length(F.regexp_extract("line", "^#{1,3}", 0)))
    bullet = F.col("line").startswith(BULLET[0]) | F.col("line").startswith(BULLET[1])
    kind = F.when(level.isNotNull(), "HEADING").when(bullet, "BULLET").when(F.col("line") == "", "BLANK").otherwise("TEXT")
    plain = F.when(level.isNotNull(), F.expr("substring(line, _level + 2)")).when(bullet, F.expr("substring(line, 3)")).otherwise(F.col("line"))
    return lines.withColumn("_level", level).select(key, "pos", kind.alias("kind"), F.col("_level").alias("level"), plain.alias("text"))


def section(title: str, rows: DataFrame, key: str, order: list[str], line: Column, none: str) -> tuple[str, DataFrame, str]:
    """A section of a report: what it says of each key, a bullet a row in order."""
    lines = rows.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, line.alias("_line")))), lambda x: F.concat(F.lit("- "), x["_line"])), "\n").alias("_body"))
    return title, lines, none


def render(head: DataFrame, key: str, title: Column, sections: list[tuple[str, DataFrame, str]]) -> DataFrame:
    """(key, report) of the rows of `head`: the title and each section, which says so if it has no rows."""
    out = head.select(key, F.concat(F.lit("# "), title).alias("_title"))
    parts = [F.col("_title")]
    for i, (name, lines, none) in enumerate(sections):
        out = out.join(lines.select(key, F.col("_body").alias(f"_s{i}")), key, "left")
        parts.append(F.concat(F.lit(f"## {name}\n\n"), F.coalesce(f"_s{i}", F.lit(none))))
    return out.select(key, F.concat_ws("\n\n", *parts).alias("report"))
