import pytest
from pyspark.sql import functions as F

from stmtlens.operators import review as rv
from stmtlens.plans.review import review_changes
from stmtlens.sources.changes import read_changed_files
from stmtlens.sources.corpus import read_sources


def findings(spark, rows):
    return spark.createDataFrame(
        rows, "repo string, pr int, seq int, rule_id string, severity string, query_id string, file string, line int, title string"
    )


def test_rank_drops_exact_repeats_and_keeps_nulls_apart(spark):
    rows = [
        ("r", 1, 1, "a", "LOW", None, "f", None, "t"), ("r", 1, 2, "a", "LOW", None, "f", None, "t"),
        ("r", 1, 3, "a", "LOW", "q", "f", None, "t"), ("r", 1, 4, "b", "CRITICAL", None, "f", 1, "t"),
    ]
    got = rv.in_order(rv.rank_findings(findings(spark, rows))).collect()
    assert [r.seq for r in got] == [4, 1, 3]


def test_cap(spark):
    ranked = rv.rank_findings(findings(spark, [("r", 1, i, "a", "HIGH", str(i), "f", 1, "t") for i in range(30)]))
    assert [r.seq for r in rv.cap_findings(ranked).orderBy("position").collect()] == list(range(20))
    assert rv.omitted_counts(ranked).first().omitted == 10
    with pytest.raises(ValueError):
        rv.cap_findings(ranked, -1)


def test_cost_delta_never_flatters(spark):
    rows = [(100.0, 0.04, "100.00 → 0.04 (99% lower)"), (100.0, 100.5, "100.00 → 100.50 (1% higher)"),
            (0.0, 5.0, "0.00 → 5.00"), (None, 5.0, None)]
    df = spark.createDataFrame(rows, "b double, a double, want string")
    assert [r for r in df.withColumn("got", rv.cost_delta(F.col("b"), F.col("a"))).collect() if r.got != r.want] == []


def test_hard_truncate(spark):
    body = "intro\n\n```sql\n" + "x" * 500
    df = spark.createDataFrame([(body,), ("short",)], "b string")
    cut, short = [r[0] for r in df.select(rv.hard_truncate(F.col("b"), 300)).collect()]
    assert cut == "intro" + rv.TRUNCATION_NOTICE and short == "short"


def test_payload_file(spark, tmp_path):
    (tmp_path / "files.json").write_text(
        '[{"filename": "a.sql", "status": "weird", "additions": 2}, {"filename": "b.sql", "status": "renamed", "previous_filename": "c.sql"}]'
    )
    rows = read_changed_files(spark, str(tmp_path / "files.json")).orderBy("path").collect()
    assert [(r.path, r.status, r.previous_path, r.additions, r.deletions) for r in rows] == [
        ("a.sql", "modified", None, 2, 0), ("b.sql", "renamed", "c.sql", 0, 0)
    ]


def test_review_end_to_end(spark):
    """A written line is reported and blocks; the untouched one below it is only counted."""
    content = "SELECT id FROM t WHERE id = 1;\nDELETE FROM t;\nSELECT 1;\nUPDATE t SET a = 1;\n"
    patch = "@@ -1,3 +1,4 @@\n SELECT id FROM t WHERE id = 1;\n+DELETE FROM t;\n SELECT 1;\n UPDATE t SET a = 1;"
    changed = spark.createDataFrame(
        [("r", 1, 0, "a.sql", "modified", patch, 1, 0), ("r", 2, 0, "b.sql", "modified", "@@ nonsense", 1, 0),
         ("r", 3, 0, "c.md", "modified", patch, 1, 0)],
        "repo string, pr int, seq int, path string, status string, patch string, additions int, deletions int",
    )
    heads = spark.createDataFrame(
        [("r", 1, "a.sql", content, "postgres"), ("r", 2, "b.sql", content, "postgres")],
        "repo string, pr int, path string, content string, dialect string",
    )
    policy = spark.createDataFrame(
        [], "repo string, block_severities array<string>, ignored_severities array<string>, block_rules array<string>, "
            "warn_rules array<string>, ignore_rules array<string>, advisory boolean"
    )
    out = review_changes(changed, heads, policy)
    assert [(r.query_id, r.rule_id, r.blocks) for r in out.findings.collect()] == [("a.sql:2", "missing-where", True)]
    assert {r.pr: r.status for r in out.statuses.collect()} == {1: "BLOCKED", 2: "FAILED", 3: "PASS"}
    lines = {r.pr: r.headline for r in out.digest.collect()}
    assert lines[1] == "4 queries read, 1 finding. Outside the change: 1."
    assert lines[3] == "No SQL here."


def test_payload_folders_name_the_review_and_keep_the_order(spark, tmp_path):
    folder = tmp_path / "repo=r" / "pr=7"
    folder.mkdir(parents=True)
    (folder / "files.json").write_text(
        '[{"filename": "z.sql", "status": "added", "patch": "+x"}, {"filename": "a.sql", "status": "odd"}]'
    )
    rows = read_changed_files(spark, str(tmp_path)).orderBy("seq").collect()
    assert [(r.repo, r.pr, r.seq, r.path, r.status) for r in rows] == [
        ("r", 7, 0, "z.sql", "added"), ("r", 7, 1, "a.sql", "modified"),
    ]


def test_sources_are_read_whole(spark, tmp_path):
    (tmp_path / "x").mkdir()
    (tmp_path / "x" / "a.SQL").write_text("SELECT 1;\nSELECT 2;")
    (tmp_path / "b.md").write_text("no")
    rows = read_sources(spark, str(tmp_path)).collect()
    assert [(r.path.rsplit("/", 1)[1], r.content, r.language) for r in rows] == [("a.SQL", "SELECT 1;\nSELECT 2;", ".sql")]
