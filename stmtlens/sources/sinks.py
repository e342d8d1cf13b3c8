"""Writing results: findings as parquet or JSON, one directory per repository; response documents as JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_findings(
    findings: DataFrame, path: str, fmt: str = "parquet", by: str = "repo", mode: str = "errorifexists"
) -> None:
    """Write findings partitioned by repository.

    Rows are rebalanced by repository first: small ones fill one file, and one with a third of
    all findings is split over many tasks.  ``mode`` says what happens to an earlier review.
    """
    findings.hint("rebalance", by).write.mode(mode).partitionBy(by).format(fmt).save(path)


def write_responses(documents: DataFrame, overflow: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Write response documents, one JSON object a line, and beside them the findings they had no room for."""
    documents.write.mode(mode).json(f"{path}/documents")
    overflow.write.mode(mode).json(f"{path}/overflow")
