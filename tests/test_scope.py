"""Faults that the registered fixtures do not reach: long paths, listed order, locks, schemas by repository."""

from stmtlens.operators import rules
from stmtlens.operators.records import table_aliases
from stmtlens.operators import schema as sc
from stmtlens.plans.review import review_changes

CHANGED = (
    "repo string, pr int, seq int, path string, status string, patch string, additions int, deletions int"
)
POLICY = (
    "repo string, block_severities array<string>, ignored_severities array<string>, block_rules array<string>, "
    "warn_rules array<string>, ignore_rules array<string>, advisory boolean"
)


def _review(spark, files, **options):
    content = "SELECT 1;\nDELETE FROM t;\n"
    touched = "@@ -1,1 +1,2 @@\n SELECT 1;\n+DELETE FROM t;"
    other = "@@ -1,1 +1,2 @@\n+SELECT 1;\n DELETE FROM t;"
    rows = [("r", 1, i, path, "modified", touched if hit else other, 1, 0) for i, (path, hit) in enumerate(files)]
    changed = spark.createDataFrame(rows, CHANGED)
    heads = spark.createDataFrame(
        [("r", 1, path, content, "postgres") for path, _ in files],
        "repo string, pr int, path string, content string, dialect string",
    )
    return review_changes(changed, heads, spark.createDataFrame([], POLICY), **options)


def test_paths_that_share_a_long_beginning(spark):
    long = "d/" * 300
    out = _review(spark, [(f"{long}a.sql", True), (f"{long}b.sql", False)])
    assert [r.file for r in out.findings.collect()] == [f"{long}a.sql"]


def test_ties_keep_the_listed_order(spark):
    out = _review(spark, [("longer_name.sql", True), ("a.sql", True)], max_findings=1)
    assert [r.file for r in out.shown.collect()] == ["longer_name.sql"]
    assert _review(spark, [("longer_name.sql", True), ("a.sql", True)]).shown.count() == 2


def test_every_xml_file_may_be_a_root(spark):
    files = spark.createDataFrame([("r", i, f"f{i}.XML", "") for i in range(250)], "repo string, seq int, path string, content string")
    assert sc.xml_files(files).count() == 250


def _queries(spark, rows):
    return spark.createDataFrame(
        [(i, repo, text, "postgres", "raw_sql") for i, (repo, text) in enumerate(rows)],
        "qid int, repo string, text string, dialect string, kind string",
    )


def test_row_locks_are_no_tables(spark):
    texts = ["SKIP LOCKED", "NOWAIT", ""]
    queries = _queries(spark, [("r", f"SELECT id FROM orders WHERE country = 'x' FOR UPDATE {t}") for t in texts])
    tables = table_aliases(rules.audit_tables(queries).records).collect()
    assert sorted((r["qid"], r["table_name"]) for r in tables) == [(i, "orders") for i in range(3)]
    update = table_aliases(rules.audit_tables(_queries(spark, [("r", "UPDATE orders SET a = 1")])).records).collect()
    assert [r["table_name"] for r in update] == ["orders"]


def test_a_schema_speaks_for_its_own_repository(spark):
    text = "SELECT id FROM orders WHERE country = 'x' LIMIT 1"
    schema = spark.createDataFrame(
        [("r1", "orders", ["id"], {}), ("r2", "orders", ["country"], {})],
        "repo string, table_name string, indexed_columns array<string>, column_types map<string,string>",
    )
    tables = rules.audit_tables(_queries(spark, [("r1", text), ("r2", text), ("r3", text)]), schema)
    assert [r["qid"] for r in rules.rule_unindexed_filter(tables).collect()] == [0]
