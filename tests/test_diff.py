from stmtlens.operators import diff

PATCH = """diff --git a/x b/x
@@ -1,3 +1,4 @@ class
 a
+b
+c
-d
 e
@@ -20 +30,2 @@
-x
+y
+z
\\ No newline at end of file"""


def files(spark, *rows):
    return spark.createDataFrame(list(rows), "path string, patch string")


def test_lines_and_ranges(spark):
    lines = diff.patch_lines(files(spark, ("f", PATCH)))
    assert [(r.head_start, r.head_lines) for r in diff.hunks(lines).orderBy("hunk").collect()] == [(1, 4), (30, 2)]
    assert sorted((r.hunk, r.lo, r.hi) for r in diff.added_ranges(lines).collect()) == [(1, 2, 3), (2, 30, 31)]
    assert diff.malformed_patches(files(spark, ("f", PATCH))).count() == 0


def test_malformed(spark):
    bad = diff.malformed_patches(
        files(
            spark,
            ("count", "@@ -1 +1,5 @@\n+a"),
            ("line", "@@ -1 +1 @@\n+a\n?b"),
            ("header", "+a\n"),
            ("empty", "  "),
            ("deleted", "@@ -1,2 +0,0 @@\n-a\n-b"),
            ("blank", "@@ -1,2 +1,2 @@\n a\n\n"),
        )
    )
    assert {r.path: r.fault for r in bad.collect()} == {
        "count": "wrong count", "line": "unknown line", "header": "no hunk header"
    }


def test_interrupted_additions_merge_over_removed_lines(spark):
    lines = diff.patch_lines(files(spark, ("f", "@@ -1,1 +5,2 @@\n+a\n-x\n+b")))
    assert [(r.lo, r.hi) for r in diff.added_ranges(lines).collect()] == [(5, 6)]


def test_scope(spark):
    lines = diff.patch_lines(
        spark.createDataFrame(
            [("r", 1, "f", PATCH), ("r", 1, "d", "@@ -5,3 +5,2 @@\n a\n-b\n c")],
            "repo string, pr int, file string, patch string",
        ), ("repo", "pr", "file"),
    )
    rows = [
        ("r", 1, 1, "f", 2, None, None, 0, True),
        ("r", 1, 2, "f", 1, None, None, 0, False),       # context line
        ("r", 1, 3, "f", 1, None, None, 1, True),        # second line of the statement
        ("r", 1, 4, "f", 9, 1, 31, 0, True),             # the call line was written
        ("r", 1, 5, "f", 9, 1, 99, 0, False),            # only the inside was
        ("r", 1, 6, "f", None, None, None, 0, True),
        ("r", 1, 7, "other", 7, None, None, 0, True),
        ("r", 1, 8, "d", 6, None, None, 0, True),        # no added lines: the hunk's span
        ("r", 1, 9, "d", 7, None, None, 0, False),
        ("r", 1, 10, "f", 1, None, None, 100000, True),
    ]
    df = spark.createDataFrame(
        rows, "repo string, pr int, seq int, file string, line int, span_start int, span_end int, extent int, want boolean"
    )
    got = diff.scope_changes(df, diff.change_ranges(lines, ("repo", "pr", "file")), diff.hunks(lines, ("repo", "pr", "file")))
    assert [r.seq for r in got.filter("want != in_scope").collect()] == []


def test_changed_lines(spark):
    lines = diff.patch_lines(files(spark, ("f", PATCH)))
    points = spark.createDataFrame([("f", 4), ("f", 5), ("g", 5)], "path string, line int")
    got = {(r.path, r.line): r.is_changed for r in diff.changed_lines(points, diff.hunks(lines)).collect()}
    assert got == {("f", 4): True, ("f", 5): False, ("g", 5): True}
