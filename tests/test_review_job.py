"""The whole review of a change with Java files: queries, N+1 findings, ignored paths, disabled rules."""

from stmtlens.plans.review import review_changes
from tests.test_scope import CHANGED, POLICY

REPOSITORY = '''package a;
public interface ItemRepository extends JpaRepository<Item, Long> {
    @Query(value = "DELETE FROM orders", nativeQuery = true)
    void wipe();
    @Query(value = """
        SELECT *
        FROM orders WHERE id = 1
        """, nativeQuery = true)
    Item one();
    Item findByCountry(String c);
}
'''
SERVICE = '''package a;
public class Service {
    private final ItemRepository orders;
    void run(List<Long> ids) {
        for (Long id : ids) {
            orders.findByCountry(id);
        }
    }
}
'''


def _whole(text):
    lines = text.rstrip("\n").split("\n")
    return f"@@ -0,0 +1,{len(lines)} @@\n" + "\n".join("+" + line for line in lines)


def _review(spark, **options):
    files = [("x/ItemRepository.java", REPOSITORY), ("x/Service.java", SERVICE)]
    changed = [(r, 1, i, p, "added", _whole(t), 9, 0) for r in ("r1", "r2") for i, (p, t) in enumerate(files)]
    heads = [(r, 1, p, t, "postgres") for r in ("r1", "r2") for p, t in files]
    return review_changes(
        spark.createDataFrame(changed, CHANGED),
        spark.createDataFrame(heads, "repo string, pr int, path string, content string, dialect string"),
        spark.createDataFrame([], POLICY),
        **options,
    )


def test_java_only_change(spark):
    schema = spark.createDataFrame(
        [("r1", "item", ["id"], {})],
        "repo string, table_name string, indexed_columns array<string>, column_types map<string,string>",
    )
    groups = spark.createDataFrame(
        [("r2", 'SELECT * FROM item WHERE country = ?', 40, 30, 90, 1)],
        "repo string, normalized_sql string, count long, distinct_variants long, total_elapsed_ms long, first_seq long",
    )
    off = spark.createDataFrame([("r2", "select-star")], "repo string, rule_id string")
    out = _review(spark, schema=schema, groups=groups, disabled=off)
    got = sorted((r.repo, r.file[2:], r.rule_id, r.line, r.severity) for r in out.findings.collect())
    repository, service = "ItemRepository.java", "Service.java"
    call = "nplusone-repository-call-in-loop"
    assert got == [
        ("r1", repository, "missing-where", 3, "CRITICAL"),
        ("r1", repository, "select-star", 6, "MEDIUM"),
        ("r1", repository, "unindexed-filter", 10, "HIGH"),
        ("r1", service, call, 6, "HIGH"),
        ("r2", repository, "missing-where", 3, "CRITICAL"),
        ("r2", service, call, 6, "HIGH"),
    ]
    backed = {r.repo: r.confidence is None for r in out.findings.collect() if r.rule_id == call}
    assert backed == {"r1": False, "r2": True}
    assert {r.status for r in out.statuses.collect()} == {"BLOCKED"}


def test_ignored_files(spark):
    ignored = spark.createDataFrame([("r1", "x/**"), ("r2", "**/ItemRepository.java")], "repo string, pattern string")
    out = _review(spark, ignored=ignored)
    # Without its declaration the receiver is a repository by its name only.
    assert [(r.repo, r.file, r.severity) for r in out.findings.collect()] == [("r2", "x/Service.java", "MEDIUM")]
