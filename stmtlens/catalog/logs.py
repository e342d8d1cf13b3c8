"""Statement-log queries.  Input: log lines written from ``orders``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stmtlens.catalog.base import fill, pick, spread, table
from stmtlens.functions.lexing import normalize_sql
from stmtlens.operators.repeated import repeated_statements, usable_groups
from stmtlens.sources.logs import analysable, parse_log

# Template number is o_custkey % 6.
_SQL = [
    "SELECT o.id FROM orders o WHERE o.id = {k}",
    "select * from priorities where name = '{p}'",
    "SHOW search_path",
    "SELECT a || '|' || b FROM \"T\" WHERE c = 'x|{k7}' /* {k} */",
    "SELECT id FROM items WHERE id IN ({list})",
    "{verb}  stock\tSET qty = qty - 1.5 WHERE sku = 'it''s {c}' AND on_hand = TRUE -- 'n",
]
_CATEGORY = ["statement"] * 6 + ["batch", " batch ", "resultset", "info"]


def log_lines(spark: SparkSession, folder: str) -> DataFrame:
    """``source, seq, value``: one line per order, some of them malformed."""
    o = spread(
        table(spark, folder, "orders").select(
            "o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority"
        ),
        "o_orderkey",
    )
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    numbers = [F.lit("7"), F.concat(k.cast("string"), F.lit(", 8")), F.lit("1, 2,3")]
    sql = fill(
        pick(c, _SQL), k7=k % 7, k=k, p=F.col("o_orderpriority"), list=pick(k, numbers), c=c,
        verb=F.when(k % 2 == 0, "UPDATE").otherwise("update"),
    )
    good = F.concat_ws(
        "|",
        (F.datediff(F.to_date("o_orderdate"), F.lit("1970-01-01").cast("date")).cast("long") * 86400000 + k).cast("string"),
        F.concat(F.lit(" "), (k % 20).cast("string")),
        pick(k, _CATEGORY),
        F.concat(sql, F.lit(" ")),
    )
    value = (
        F.when(k % 97 == 0, "garbage line")
        .when(k % 97 == 1, F.concat(F.lit("x|12|statement|SELECT "), k.cast("string")))
        .when(k % 97 == 2, "  ")
        .when(k % 97 == 3, "123|4|statement")
        .when(k % 97 == 4, "123|1.5|statement|SELECT 1")
        .otherwise(good)
    )
    return o.select(
        F.concat(F.lit("app-"), (c % 4).cast("string")).alias("source"), k.alias("seq"),
        value.alias("value"),
    )


def _log(spark, folder):
    return parse_log(log_lines(spark, folder))


def log_scan(spark, folder):
    return _log(spark, folder)


def category_filter(spark, folder):
    return analysable(_log(spark, folder)).groupBy("source", "category").agg(
        F.count("*").alias("n"), F.sum("elapsed_ms").alias("ms")
    )


def normalized(spark, folder):
    return _log(spark, folder).select("seq", normalize_sql(F.col("sql")).alias("normalized_sql"))


def repeated(spark, folder):
    return repeated_statements(_log(spark, folder)).withColumnRenamed("first_seq", "seq")


def usable(spark, folder):
    return usable_groups(repeated_statements(_log(spark, folder))).select(
        "source", "normalized_sql", "count", "distinct_variants"
    )


QUERIES = {
    "log_scan": log_scan,
    "category_filter": category_filter,
    "normalize_sql": normalized,
    "repeated_statements": repeated,
    "usable_groups": usable,
}

_LOG = """
WITH log AS (
  SELECT 'app-' || (o_custkey % 4) AS source, o_orderkey AS seq,
         epoch_ms(o_orderdate) + o_orderkey AS timestamp_ms, o_orderkey % 20 AS elapsed_ms,
         CASE WHEN o_orderkey % 10 < 6 THEN 'statement' WHEN o_orderkey % 10 < 8 THEN 'batch'
              WHEN o_orderkey % 10 = 8 THEN 'resultset' ELSE 'info' END AS category,
         CASE o_custkey % 6
           WHEN 0 THEN 'SELECT o.id FROM orders o WHERE o.id = ' || o_orderkey
           WHEN 1 THEN 'select * from priorities where name = ''' || o_orderpriority || ''''
           WHEN 2 THEN 'SHOW search_path'
           WHEN 3 THEN 'SELECT a || ''|'' || b FROM "T" WHERE c = ''x|' || (o_orderkey % 7)
                       || ''' /* ' || o_orderkey || ' */'
           WHEN 4 THEN 'SELECT id FROM items WHERE id IN (' || CASE o_orderkey % 3
                       WHEN 0 THEN '7' WHEN 1 THEN o_orderkey || ', 8' ELSE '1, 2,3' END || ')'
           ELSE CASE WHEN o_orderkey % 2 = 0 THEN 'UPDATE' ELSE 'update' END || '  stock' || chr(9)
                || 'SET qty = qty - 1.5 WHERE sku = ''it''''s ' || o_custkey
                || ''' AND on_hand = TRUE -- ''n' END AS sql,
         CASE o_custkey % 6
           WHEN 0 THEN 'SELECT o.id FROM orders o WHERE o.id = ?'
           WHEN 1 THEN 'SELECT * FROM priorities WHERE name = ?'
           WHEN 2 THEN 'SHOW search_path'
           WHEN 3 THEN 'SELECT a || ? || b FROM "T" WHERE c = ?'
           WHEN 4 THEN 'SELECT id FROM items WHERE id IN (' || CASE o_orderkey % 3
                       WHEN 0 THEN '?' WHEN 1 THEN '?, ?' ELSE '?, ?, ?' END || ')'
           ELSE 'UPDATE stock SET qty = qty - ? WHERE sku = ? AND on_hand = TRUE' END AS shape
  FROM orders WHERE o_orderkey % 97 NOT IN (0, 1, 2, 3, 4)
)
"""
_GROUPS = """
, groups AS (
  SELECT source, shape AS normalized_sql, count(*) AS "count",
         count(DISTINCT sql) AS distinct_variants,
         CAST(sum(elapsed_ms) AS BIGINT) AS total_elapsed_ms,
         arg_min(sql, seq) AS example_sql, min(seq) AS seq,
         CAST(sum(elapsed_ms) AS DOUBLE) / count(*) AS mean_elapsed_ms
  FROM log WHERE category IN ('statement', 'batch') GROUP BY ALL HAVING count(*) >= 2
)
"""

ORACLES = {
    "log_scan": _LOG + "SELECT source, seq, timestamp_ms, elapsed_ms, category, sql FROM log",
    "category_filter": _LOG
    + """SELECT source, category, count(*) AS n, CAST(sum(elapsed_ms) AS BIGINT) AS ms FROM log
         WHERE category IN ('statement', 'batch') GROUP BY ALL""",
    "normalize_sql": _LOG + "SELECT seq, shape AS normalized_sql FROM log",
    "repeated_statements": _LOG + _GROUPS + "SELECT * FROM groups",
    "usable_groups": _LOG
    + _GROUPS
    + """SELECT source, normalized_sql, "count", distinct_variants FROM groups
         WHERE "count" >= 3 AND distinct_variants > 1""",
}
