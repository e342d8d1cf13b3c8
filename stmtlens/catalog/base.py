"""Helpers shared by the registered queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Spread the narrow source rows over all tasks before text is made of them.

    The given tables are single files, so one task would write all the text.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def pick(number: Column, options: list) -> Column:
    """Option number ``number % len(options)``; options are strings or Columns."""
    cols = [F.lit(o) if isinstance(o, str) else o for o in options]
    return F.element_at(F.array(*cols), (number % len(cols) + 1).cast("int"))


def fill(template: Column, **values: Column) -> Column:
    """Replace ``{name}`` marks in a template column."""
    return reduce(
        lambda text, kv: F.replace(text, F.lit("{" + kv[0] + "}"), kv[1].cast("string")),
        values.items(),
        template,
    )


def sql_quote(text) -> str:
    if text is None:
        return "NULL"
    if isinstance(text, bool):
        return "true" if text else "false"
    if isinstance(text, (int, float)):
        return str(text)
    return "'" + text.replace("'", "''") + "'"


def sql_values(rows: list[tuple], columns: str) -> str:
    """``(VALUES ...) x(columns)`` for a DuckDB FROM clause."""
    body = ",\n".join("(" + ", ".join(sql_quote(v) for v in row) + ")" for row in rows)
    return f"(VALUES {body}) x({columns})"
