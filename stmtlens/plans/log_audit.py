"""Statement logs to repeated shapes: the whole job as one function."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from stmtlens.operators.repeated import ranked, repeated_statements
from stmtlens.sources.logs import parse_log, read_log_lines


def audit_logs(spark: SparkSession, path: str, min_count: int = 2) -> DataFrame:
    """Repeated statement shapes of all log files under ``path``, worst first per file."""
    return ranked(repeated_statements(parse_log(read_log_lines(spark, path)), min_count))
