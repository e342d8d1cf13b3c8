"""Source files as rows: ``path, content, language``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stmtlens.session import sorted_joins

#: The file types that are read.
LANGUAGES = (".sql", ".java")


def extension(path: Column) -> Column:
    """Final extension of the last path segment, lower-cased; '' where there is none."""
    name = F.regexp_extract(path, r"([^/]*)\z", 1)
    return F.lower(F.regexp_extract(name, r"[^.](?:.*)(\.[^.]+)\z", 1))


def read_sources(spark: SparkSession, root: str) -> DataFrame:
    """Whole files under ``root`` (one row each), restricted to known languages."""
    files = spark.read.option("recursiveFileLookup", "true").text(root, wholetext=True)
    return scan_sources(
        files.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))
    )


def scan_sources(files: DataFrame) -> DataFrame:
    """Keep files some extractor claims and add their ``language``."""
    return files.withColumn("language", extension(F.col("path"))).filter(
        F.col("language").isin(*LANGUAGES)
    )


def apply_run_dialect(
    sources: DataFrame, repo_dialect: DataFrame, keys: tuple[str, ...] = ("repo",),
    default: str = "postgres",
) -> DataFrame:
    """``.sql`` files get their run's dialect (``repo_dialect(keys, run_dialect)``)."""
    labelled = sources.join(sorted_joins(repo_dialect), list(keys), "left")
    sql = F.lower("path").endswith(".sql")
    return labelled.withColumn(
        "dialect", F.when(sql, F.coalesce("run_dialect", F.lit(default))).otherwise(F.lit(default))
    ).drop("run_dialect")


def relabel_queries(
    queries: DataFrame, repo_dialect: DataFrame, keys: tuple[str, ...] = ("repo",),
    default: str = "postgres",
) -> DataFrame:
    """Queries still on the default dialect take their run's."""
    joined = queries.join(sorted_joins(repo_dialect), list(keys), "left")
    return joined.withColumn(
        "dialect",
        F.when(F.col("dialect") == default, F.coalesce("run_dialect", "dialect")).otherwise(
            F.col("dialect")
        ),
    ).drop("run_dialect")
