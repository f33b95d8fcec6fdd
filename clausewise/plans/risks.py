"""A run of risk rules: what it found against what was there, as a new snapshot that a pointer then names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KEY = ["project", "version", "subject"]


def run(found: DataFrame, there: DataFrame, versions: DataFrame) -> DataFrame:
    """(project, version, subject, rule, risk_type, severity, title, description, status, change) after a run.

    `found` (project, rule, subject, title, description) counts where its rule has an active version in `versions` (rule,
    version, risk_type, severity, active), whose type and severity it takes. Found rows that were `there` (project, version, subject, rule,
    risk_type, severity, title, description, status) keep the status people gave them; new ones are OPEN; those
    not found again are GONE. Of equal keys found twice the last title and description by text are kept. A project without
    anything found loses all its risks.
    """
    active = versions.where("active").select("rule", "version", "risk_type", "severity")
    new = found.join(F.broadcast(active), "rule") if active.count() <= 1 << 17 else found.join(active, "rule")
    new = new.groupBy(*KEY).agg(F.max(F.struct("title", "description", "rule", "risk_type", "severity")).alias("x")).select(*KEY, "x.*", F.lit(True).alias("_new"))
    old = there.select(*KEY, *(F.col(c).alias(f"_{c}") for c in ("rule", "risk_type", "severity", "title", "description", "status")), F.lit(True).alias("_old"))
    both = new.join(old, KEY, "full")
    is_new, was = F.col("_new").isNotNull(), F.col("_old").isNotNull()
    fresh = lambda c: F.when(is_new, F.col(c)).otherwise(F.col(f"_{c}")).alias(c)
    status = F.when(was, F.col("_status")).otherwise("OPEN")
    change = F.when(is_new & was, "KEPT").when(is_new, "NEW").otherwise("GONE")
    return both.select(*KEY, *map(fresh, ("rule", "risk_type", "severity", "title", "description")), status.alias("status"), change.alias("change"))


def publish(rows: DataFrame, base: str, run_id: str) -> None:
    """Writes the rows of a run beside those of earlier runs and, once that is done, a pointer to them; a run that fails changes nothing that is read."""
    spark = rows.sparkSession
    rows.where("change <> 'GONE'").drop("change").write.mode("overwrite").parquet(f"{base}/run={run_id}")
    spark.createDataFrame([(run_id,)], "run string").select("run", F.current_timestamp().alias("at")).coalesce(1).write.mode("append").parquet(f"{base}/_pointers")


def published(spark: SparkSession, base: str) -> DataFrame:
    """The rows that the newest pointer names."""
    newest = spark.read.parquet(f"{base}/_pointers").orderBy(F.desc("at"), F.desc("run")).first()
    return spark.read.parquet(f"{base}/run={newest.run}")
