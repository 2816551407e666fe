"""Writing facts: whole partitions, so a rerun leaves the same files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_owned(facts: DataFrame, path: str, owner: str = "repo") -> None:
    """Replace the partitions of the owners in ``facts``; those of others stay."""
    facts.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(owner).parquet(path)


def export_json(facts: DataFrame, path: str) -> None:
    """One JSON object a line; nulls are left out."""
    facts.select(F.to_json(F.struct("*")).alias("value")).write.mode("overwrite").text(path)


def replace_claims(stored: DataFrame, run: DataFrame, job: int) -> DataFrame:
    """Stored claims (key, fields, removed_job) after a run's claims (key, fields): new and revived ones live, missing ones are marked."""
    old = stored.select("key", F.col("fields").alias("old"), "removed_job")
    both = old.join(run.select("key", F.col("fields").alias("new")), "key", "full_outer")
    removed = F.when(F.col("new").isNotNull(), F.lit(None).cast("int")).otherwise(F.coalesce("removed_job", F.lit(job)))
    return both.select("key", F.coalesce("new", "old").alias("fields"), removed.alias("removed_job"))
