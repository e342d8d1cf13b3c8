import pytest
from pyspark.sql import functions as F

from stmtlens.functions.lexing import normalize_sql
from stmtlens.operators.repeated import repeated_statements, usable_groups
from stmtlens.plans.log_audit import audit_logs
from stmtlens.sources.logs import parse_log

LINES = [
    "1|5|statement|SHOW search_path",
    "2|5|statement|SHOW search_path",
    *[f"{i}|{i}|statement|select * from child where parent = {i}" for i in range(3, 9)],
    "9|1|resultset|select 9",
    "10|1|batch|insert into t values ('a|b')",
    "",
    "no bars",
    "x|1|statement|select 1",
    "11|y|statement|select 1",
    "12|1|statement",
]


def shape(spark, text, dialect=None):
    df = spark.createDataFrame([(text, dialect)], "t string, d string")
    return df.select(normalize_sql(F.col("t"), F.col("d") if dialect else None)).first()[0]


def test_malformed_lines_are_dropped(spark):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(LINES)], "seq int, value string")
    rows = parse_log(df).collect()
    assert len(rows) == 10
    assert [r.sql for r in rows if r.category == "batch"] == ["insert into t values ('a|b')"]


def test_byte_order_mark(spark):
    df = spark.createDataFrame([(0, "﻿1|2|statement| select 1 ")], "seq int, value string")
    row = parse_log(df).first()
    assert (row.timestamp_ms, row.elapsed_ms, row.sql) == (1, 2, "select 1")


def test_files_to_groups(spark, tmp_path):
    (tmp_path / "a.log").write_text("\n".join(LINES))
    rows = audit_logs(spark, str(tmp_path)).collect()
    assert [(r["count"], r.distinct_variants, r.total_elapsed_ms) for r in rows] == [(6, 6, 33), (2, 1, 10)]
    assert rows[0].example_sql.endswith("= 3")


@pytest.mark.parametrize("partitions", [1, 8])
def test_grouping_does_not_depend_on_partitions(spark, partitions):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(LINES)], "seq int, value string")
    log = parse_log(df.orderBy(F.rand(3)).repartition(partitions)).withColumn("source", F.lit("a"))
    groups = repeated_statements(log)
    assert sorted((r["count"], r.example_sql) for r in groups.collect()) == [
        (2, "SHOW search_path"), (6, "select * from child where parent = 3")
    ]
    assert usable_groups(groups).count() == 1


@pytest.mark.parametrize(
    ("a", "b", "same"),
    [
        ("select  1 from t", "SELECT 22 FROM t", True),
        ("select 'it''s' from t", "select 'x' from t", True),
        ("select a from t where x in (1,2)", "select a from t where x in (1,2,3)", False),
        ('select "1" from t', 'select "2" from t', False),
        ("select a from t where b = true", "select a from t where b = false", False),
        ("select a from t -- c 1", "select a /* 2 */ from t", True),
        ("SHOW a", "SHOW b", False),
        ("select lower(a) from t", "select LOWER( a ) from t", True),
        ("select a from t where b != 1", "select a from t where b <> 2;", True),
        ("select $q$a;b$q$", "select 'z'", True),
        ("select :p", "select :q", False),
    ],
)
def test_shapes(spark, a, b, same):
    assert (shape(spark, a) == shape(spark, b)) is same


def test_unreadable_text_is_trimmed_only(spark):
    assert shape(spark, "  select 'open  ") == "select 'open"
    assert shape(spark, " select (1 ") == "select (1"


def test_mysql_quoting(spark):
    assert shape(spark, r"select `a` from t where b = 'it\'s' and c = \"x\"".replace('\\"', '"'), "mysql") == (
        "SELECT `a` FROM t WHERE b = ? AND c = ?"
    )


def test_long_literal_does_not_recurse(spark):
    text = "select '" + "a''" * 300_000 + "', /*" + "x" * 300_000 + "*/ b"
    assert shape(spark, text) == "SELECT ?, b"
