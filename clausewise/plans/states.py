"""States of jobs and derived results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def illegal(log: DataFrame, keys: list[str], order: list[str], status: str, legal: list[tuple[str, str]]) -> DataFrame:
    """Rows of a status log whose change from the row before (`prev`) isn't legal."""
    moves = F.array(*[F.lit(f"{a}\x1f{b}") for a, b in legal])
    rows = log.withColumn("prev", F.lag(status).over(Window.partitionBy(*keys).orderBy(*order)))
    return rows.where(F.col("prev").isNotNull() & ~F.array_contains(moves, F.concat_ws("\x1f", "prev", status)))


def cascade(rows: DataFrame, stages: list[str]) -> DataFrame:
    """Adds stale_<stage> for each stage after the first: it has no time, or one before a stage that it follows."""
    out = rows
    for i, stage in enumerate(stages[1:], 1):
        newest = F.greatest(*stages[:i]) if i > 1 else F.col(stages[0])
        out = out.withColumn(f"stale_{stage}", F.col(stage).isNull() | F.coalesce(newest > F.col(stage), F.lit(False)))
    return out


# States of documents that are being worked on, of reports and of analyses under way.
WORKING = ("QUEUED", "PARSING", "CLEANING", "BUILDING_EVIDENCE", "INDEXING")
REPORTING = ("QUEUED", "GENERATING")
ANALYSING = ("QUEUED", "RUNNING", "REPORT_QUEUED")


def phase(archived: Column, documents: Column, report: Column, stale: Column, analysis: Column) -> Column:
    """A project's phase from the states of its documents (an array), its report and its last analysis (null if there is none).

    Documents come first: none, one under way, one that failed; then the report, then the analysis, then whether a document is ready.
    """
    has = lambda *states: F.arrays_overlap(documents, F.array(*map(F.lit, states)))
    of_report = F.when(F.coalesce(stale, F.lit(False)), "REPORT_STALE").when(report == "READY", "REPORT_READY").when(report.isin(*REPORTING), "REPORT_GENERATING").otherwise("REPORT_FAILED")
    of_analysis = F.when(analysis.isin(*ANALYSING), "ANALYSIS_RUNNING").when(analysis == "FAILED", "ANALYSIS_FAILED").otherwise("ANALYSIS_FINISHED")
    none = documents.isNull() | (F.size(documents) == 0)
    return (
        F.when(archived, "ARCHIVED").when(none, "NO_DOCUMENT").when(has(*WORKING), "DOCUMENT_PROCESSING").when(has("FAILED"), "DOCUMENT_FAILED")
        .when(report.isNotNull(), of_report).when(analysis.isNotNull(), of_analysis).when(has("READY"), "DOCUMENT_READY").otherwise("DOCUMENT_UPLOADED")
    )
