import pytest

from stmtlens.operators import rules as ru
from stmtlens.operators import statements as st

CASES = [
    ("UPDATE t SET a = 1", {"missing-where"}),
    ("DELETE FROM t", {"missing-where"}),
    ("TRUNCATE TABLE t", set()),
    ("UPDATE t SET a = (SELECT b FROM u WHERE u.id = 1)", {"missing-where"}),
    ("DELETE FROM a USING b WHERE a.id = b.id", set()),
    ("SELECT a FROM t", {"no-limit"}),
    ("SELECT 1", set()),
    ("SELECT now()", set()),
    ("SELECT COUNT(*) FROM t", set()),
    ("SELECT COUNT(*) + 1 FROM t", {"no-limit"}),
    ("SELECT COUNT(*) OVER () FROM t", {"no-limit"}),
    ("SELECT a FROM (SELECT a FROM t WHERE x = 1) s", {"no-limit"}),
    ("SELECT a FROM t, u", {"no-limit"}),
    ("SELECT a.x FROM a JOIN b ON a.id = b.id AND b.k IN (1, 2)", set()),
    ("SELECT a.x FROM a JOIN b ON a.id = b.id AND b.k <> 5", {"no-limit"}),
    ("SELECT a.x FROM a LEFT OUTER JOIN b ON b.k = 5", {"no-limit"}),
    ("SELECT DISTINCT * FROM t WHERE id = 1", {"select-star"}),
    ("SELECT a, t.* FROM t WHERE id = 1", {"select-star"}),
    ("SELECT EXISTS (SELECT * FROM t WHERE id = 1)", {"select-star"}),
    ("SELECT 2 * id FROM t WHERE id = 1", set()),
    ("SELECT a FROM t WHERE name LIKE '%x%'", {"leading-wildcard"}),
    ("SELECT a FROM t WHERE LOWER(name) LIKE '%x'", set()),
    ("SELECT a FROM t WHERE name LIKE 'x%'", set()),
    ("SELECT a FROM t WHERE name LIKE :p", set()),
    ("SELECT a FROM t WHERE UPPER(name) = 'X'", {"wrapped-column"}),
    ("SELECT a FROM t WHERE name = UPPER('x')", set()),
    ("SELECT a FROM t WHERE 5 = ABS(qty)", {"wrapped-column"}),
    ("SELECT a FROM t WHERE CAST(id AS text) = '5'", {"explicit-cast"}),
    ("SELECT a FROM t WHERE id::text = '5'", {"explicit-cast"}),
    ("SELECT a FROM t WHERE id = CAST(:p AS int)", set()),
    ("SELECT a FROM t WHERE (id = 1 OR LOWER(name) = 'x') AND NOT a IS NULL", {"wrapped-column"}),
    ("SHOW search_path", set()),
    ("SELECT a FROM t WHERE name = 'open", set()),
    ("INSERT INTO t (a) VALUES (1)", set()),
    ("SELECT a FROM t WHERE EXTRACT(YEAR FROM d) = 2020", {"wrapped-column"}),
    ("WITH x AS (SELECT a FROM t) SELECT a FROM x", {"no-limit"}),
]


def tables(spark, texts, schema=None, kind="raw_sql"):
    df = spark.createDataFrame(
        [(i, t, "postgres", kind) for i, t in enumerate(texts)],
        "qid long, text string, dialect string, kind string",
    )
    return ru.audit_tables(df, schema)


def test_rule_cases(spark):
    found = ru.run_rules(tables(spark, [c for c, _ in CASES])).collect()
    got = {i: set() for i in range(len(CASES))}
    for row in found:
        got[row.qid].add(row.check)
    wrong = [(CASES[i][0], got[i], CASES[i][1]) for i in got if got[i] != CASES[i][1]]
    assert wrong == []


def test_schema_rules(spark):
    schema = spark.createDataFrame(
        [("Customers", ["id", "Email"], {"email": "VARCHAR(9)", "age": "int"}), ("orders", [], {})],
        "table_name string, indexed_columns array<string>, column_types map<string,string>",
    )
    texts = [
        "SELECT id FROM customers WHERE country = 'x' AND Country <> 'y'",
        "SELECT id FROM customers c JOIN orders o ON o.cid = c.id WHERE total > 5 AND o.total > 5",
        "SELECT id FROM elsewhere WHERE a = 1",
        "SELECT id FROM customers WHERE email = 5 AND age = 5 AND EMAIL = '5'",
        "SELECT id FROM customers WHERE LOWER(country) = 'x'",
    ]
    t = tables(spark, texts, schema)
    unindexed = sorted((r.qid, r.title, r.suggestion_sql) for r in ru.rule_unindexed_filter(t).collect())
    assert unindexed == [
        (0, "Filter on `customers.country`, which has no index",
         "CREATE INDEX idx_customers_country ON customers (country);"),
        (1, "Filter on `orders.total`, which has no index", "CREATE INDEX idx_orders_total ON orders (total);"),
        (3, "Filter on `customers.age`, which has no index", "CREATE INDEX idx_customers_age ON customers (age);"),
    ]
    assert [(r.qid, r.title) for r in ru.rule_implicit_cast(t).collect()] == [
        (3, "Comparison on `email` requires a type conversion")
    ]


def test_derived_queries_are_inferred_and_may_select_star(spark):
    t = tables(spark, ["SELECT *\nFROM t\nWHERE LOWER(a) = LOWER(?)"], kind=ru.DERIVED_KIND)
    rows = ru.run_rules(t).collect()
    assert [(r.check, r.confidence) for r in rows] == [("wrapped-column", 0.5)]


@pytest.mark.parametrize(
    ("content", "expected"),
    [
        ("SELECT 1;\n-- x;\n;SELECT\n 2 ;", [(1, 1, "SELECT 1"), (2, 3, "SELECT\n 2")]),
        ("﻿", []),
        (" \n", []),
        ("SELECT 'a;b'; DO $$ x; $$", [(1, 1, "SELECT 'a;b'"), (2, 1, "DO $$ x; $$")]),
    ],
)
def test_statement_split(spark, content, expected):
    df = spark.createDataFrame([("f.sql", content, "postgres")], "path string, content string, dialect string")
    rows = st.split_statements(df).orderBy("ordinal").collect()
    assert [(r.ordinal, r.line, r.text) for r in rows] == expected


def test_unreadable_file_is_one_row(spark):
    df = spark.createDataFrame([("f.sql", "SELECT 1; SELECT (2; SELECT 3)", "postgres")],
                               "path string, content string, dialect string")
    row, = st.split_statements(df).collect()
    assert row.id == "f.sql:1" and row.line == 1 and row.parse_error and row.text.startswith("SELECT 1;")


def test_one_scan_and_one_shuffle(spark):
    """A rule reads the statements once and moves their text once; so do all rules together."""
    schema = spark.createDataFrame(
        [("t", ["id"], {"id": "int"})], "table_name string, indexed_columns array<string>, column_types map<string,string>"
    )
    for t, found in ((tables(spark, ["SELECT a FROM t"]), ru.rule_no_limit), (tables(spark, ["SELECT a FROM t"]), ru.run_rules)):
        plan = found(t)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 1 and plan.count("Scan ExistingRDD") == 1
    for found in (ru.rule_unindexed_filter, ru.run_rules):
        plan = found(tables(spark, ["SELECT a FROM t"], schema))._jdf.queryExecution().executedPlan().toString()
        # The second scan is that of the schema.
        assert plan.count("Scan ExistingRDD") == 2
        assert plan.count("Exchange hashpartitioning(qid") == 1
