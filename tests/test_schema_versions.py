"""Schemas at the base and at the heads of changes."""

import pytest

from stmtlens.operators.schema_versions import schema_versions
from stmtlens.sources.config import review_dialects

ROOT = '<databaseChangeLog>{}<include file="a.xml" relativeToChangelogFile="true"/>{}</databaseChangeLog>'
TABLE = (
    '<databaseChangeLog><changeSet id="1" author="x"><createTable tableName="t"><column name="id" type="bigint">'
    '<constraints primaryKey="true"/></column><column name="email" type="${{text}}"/></createTable>'
    '<createIndex tableName="t" indexName="ix"><column name="email"/></createIndex>{}</changeSet></databaseChangeLog>'
)
DROP = '<dropIndex tableName="t" indexName="ix"/>'
PLAIN, DROPPED = TABLE.format(""), TABLE.format(DROP)
SETTING = '<property name="text" value="{}"/>'
CONFIG = "src/main/resources/application.properties"


def run(spark, files, changed, explicit=()):
    base = spark.createDataFrame(files, "repo string, path string, content string")
    names = "repo string, pr int, path string, status string, previous_path string"
    paths = spark.createDataFrame([(*c[:3], c[3] if len(c) > 3 else "modified", c[5] if len(c) > 5 else None) for c in changed], names)
    heads = spark.createDataFrame([(*c[:3], c[4]) for c in changed if len(c) > 4 and c[4] is not None], "repo string, pr int, path string, content string")
    roots = spark.createDataFrame(list(explicit), "repo string, root string")
    out = schema_versions(base, paths, heads, roots)
    schema = {(r.repo, r.rev): (r.indexed_columns, r.column_types) for r in out.schema.collect() if r.table_name == "t"}
    return {
        (r.repo, r.pr): (r.source, *schema.get((r.repo, r.rev), (None, None))) for r in out.sources.collect()
    }


@pytest.fixture(scope="module")
def outcome(spark):
    tree = lambda r: [(r, "db/root.xml", ROOT.format(SETTING.format("varchar(9)"), "")), (r, "db/a.xml", PLAIN)]
    files = [
        *tree("e"), *tree("x"), *tree("c"), (("c"), CONFIG, "db.liquibase.change-log=/db/root.xml"),
        ("c", "src/main/resources/db/root.xml", ROOT.format("", "")), ("c", "src/main/resources/db/a.xml", PLAIN),
        *tree("s"), ("n", "README.md", "x"),
        ("w", "db/root.xml", "<databaseChangeLog>"),
    ]
    changed = [
        ("e", 1, "q.sql", "modified", "SELECT 1"),
        ("e", 2, "db/a.xml", "modified", DROPPED),
        ("e", 3, "db/a.xml", "modified", "<databaseChangeLog>"),
        ("e", 4, "db/a.xml", "removed"),
        ("e", 5, "other.xml", "added", "<databaseChangeLog/>"),
        ("e", 6, "db/root.xml", "modified", ROOT.format(SETTING.format("text"), '<changeSet id="2">' + DROP + "</changeSet>")),
        ("e", 7, "db/b.xml", "renamed", DROPPED, "db/a.xml"),
        ("e", 7, "db/root.xml", "modified", ROOT.format("", "").replace("a.xml", "b.xml")),
        ("e", 8, "db/a.xml", "modified", None),
        ("x", 1, "q.sql", "modified", "SELECT 1"),
        ("c", 1, "q.sql", "modified", "SELECT 1"),
        ("c", 2, "src/main/resources/db/a.xml", "modified", DROPPED),
        ("c", 3, CONFIG, "modified", "db.liquibase.change-log=gone.xml"),
        ("c", 4, "src/main/resources/application.yml", "added", "db:\n  liquibase:\n    change-log: other.xml\n"),
        ("s", 1, "q.sql", "modified", "SELECT 1"),
        ("s", 2, "db/a.xml", "modified", DROPPED),
        ("s", 3, "db/changelog-2.xml", "added", PLAIN),
        ("n", 1, "q.sql", "modified", "SELECT 1"),
        ("n", 2, "db/changelog.xml", "added", PLAIN),
        ("w", 1, "db/root.xml", "modified", PLAIN),
        ("w", 2, "q.sql", "modified", "SELECT 1"),
        ("gone", 1, "q.sql", "modified", "SELECT 1"),
    ]
    return run(spark, files, changed, [("e", "db/root.xml"), ("x", "db/none.xml"), ("w", "db/root.xml")])


BOTH, ONE = ["email", "id"], ["id"]
TEXT = {"id": "bigint", "email": "varchar(9)"}
RAW = {"id": "bigint", "email": "${text}"}


@pytest.mark.parametrize(
    "review,expected",
    [
        (("e", 1), ("explicit-base", BOTH, TEXT)),
        (("e", 2), ("explicit-head", ONE, TEXT)),  # this change alone drops the index
        (("e", 3), ("explicit-base", BOTH, TEXT)),  # its head doesn't parse
        (("e", 4), ("explicit-base", BOTH, TEXT)),  # its head lacks a file
        (("e", 5), ("explicit-base", BOTH, TEXT)),  # not of the tree
        (("e", 6), ("explicit-head", ONE, {"id": "bigint", "email": "text"})),
        (("e", 7), ("explicit-head", ONE, RAW)),  # moved, and its property gone
        (("e", 8), ("explicit-base", BOTH, TEXT)),  # its content could not be read
        (("x", 1), ("unknown", None, None)),  # a configured root is never second-guessed
        (("c", 1), ("config", BOTH, RAW)),
        (("c", 2), ("config", ONE, RAW)),
        (("c", 3), ("unknown", None, None)),  # the declared file is gone and two trees look alike
        (("c", 4), ("unknown", None, None)),  # two declarations disagree
        (("s", 1), ("scoring", BOTH, TEXT)),
        (("s", 2), ("scoring", ONE, TEXT)),
        (("s", 3), ("unknown", None, None)),  # two files look like roots
        (("n", 1), ("unknown", None, None)),
        (("n", 2), ("scoring", BOTH, RAW)),
        (("w", 1), ("unknown", None, None)),  # nothing to rebuild from without a base
        (("w", 2), ("unknown", None, None)),
        (("gone", 1), ("unknown", None, None)),
    ],
)
def test_each_review_sees_its_own_schema(outcome, review, expected):
    assert outcome[review] == expected


def test_an_include_between_the_events_of_a_file(spark):
    """Events of an included file lie between those of the file that includes it."""
    late = '<changeSet id="3"><createIndex tableName="t" indexName="ix"><column name="id"/><column name="email"/></createIndex></changeSet>'
    early = '<changeSet id="0"><createTable tableName="t"><column name="email" type="old"/></createTable></changeSet>'
    files = [("r", "db/root.xml", ROOT.format(early, late)), ("r", "db/a.xml", PLAIN)]
    changed = [("r", 1, "q.sql"), ("r", 2, "db/root.xml", "modified", ROOT.format(late, early))]
    got = run(spark, files, changed, [("r", "db/root.xml")])
    # At the base the later event gives the index to id; at the head the included file comes last for the index.
    assert got[("r", 1)] == ("explicit-base", ["id"], RAW)
    assert got[("r", 2)] == ("explicit-head", BOTH, {"id": "bigint", "email": "old"})


def test_dialects_at_the_head(spark):
    files = [
        ("m", "src/main/resources/application.properties", "a=1\nurl=jdbc:mysql://h"), ("m", "svc/src/main/resources/application.yml", "url: jdbc:oracle:x"),
        ("p", "svc/src/main/resources/bootstrap.yml", "url: jdbc:sqlserver://h"), ("p", "docs/application.md", "jdbc:mysql:"), ("n", "a.sql", ""),
    ]
    changed = [
        ("m", 1, "svc/src/A.java", None), ("m", 2, "src/main/resources/application.properties", "url=jdbc:postgresql://h"),
        ("m", 3, "src/main/resources/application.properties", None), ("m", 3, "svc/src/A.java", None),
        ("p", 1, "svc/src/A.java", None), ("p", 2, "other/src/A.java", None), ("n", 1, "a.sql", "x"),
    ]
    base = spark.createDataFrame(files, "repo string, path string, content string")
    paths = spark.createDataFrame([c[:3] for c in changed], "repo string, pr int, path string")
    heads = spark.createDataFrame([c for c in changed if c[3]], "repo string, pr int, path string, content string")
    got = {(r.repo, r.pr): r.run_dialect for r in review_dialects(base, paths, heads).collect()}
    # The third change of m removes the root's file; the second one of p touches another module.
    assert got == {("m", 1): "mysql", ("m", 2): "postgres", ("m", 3): "oracle", ("p", 1): "tsql"}
