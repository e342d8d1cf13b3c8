"""Changed files of a pull request, as the hosting service lists them in JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The file states the service reports.
STATUSES = ("added", "modified", "renamed", "removed", "copied", "changed", "unchanged")

FILE_SCHEMA = (
    "filename string, status string, previous_filename string, patch string, "
    "additions long, deletions long"
)


def read_changed_files(spark: SparkSession, path: str) -> DataFrame:
    """Recorded payload files (one JSON array each) with their origin, files in listed order.

    Folders like ``repo=../pr=..`` below ``path`` become the columns of the review's key.
    """
    raw = spark.read.option("wholetext", "true").text(path)
    keys = [c for c in raw.columns if c != "value"]
    return parse_changed_files(
        raw.select(*keys, F.col("_metadata.file_path").alias("origin"), F.col("value").alias("payload"))
    )


def parse_changed_files(payloads: DataFrame, payload: str = "payload") -> DataFrame:
    """One row per file of each payload column (a JSON array), in listed order."""
    keys = [c for c in payloads.columns if c != payload]
    files = payloads.select(
        *keys, F.posexplode(F.from_json(payload, f"array<struct<{_typed()}>>")).alias("seq", "_f")
    )
    return _shape(files.select(*keys, "seq", "_f.*"), [*keys, "seq"])


def _typed() -> str:
    return ", ".join(f"{c.split()[0]}: {c.split()[1]}" for c in FILE_SCHEMA.split(", "))


def _shape(files: DataFrame, keys: list[str]) -> DataFrame:
    # A state this version does not know is read as a modification.
    known = F.when(F.col("status").isin(*STATUSES), F.col("status")).otherwise("modified")
    return files.select(
        *keys,
        F.col("filename").alias("path"),
        known.alias("status"),
        F.col("previous_filename").alias("previous_path"),
        "patch",
        F.coalesce("additions", F.lit(0)).alias("additions"),
        F.coalesce("deletions", F.lit(0)).alias("deletions"),
    )
