"""Diff queries.  Input: patches written from ``orders``, two hunks each."""

from __future__ import annotations

from pyspark.sql import functions as F

from stmtlens.catalog.base import pick, spread, table
from stmtlens.operators import diff
from stmtlens.session import cut_lineage
from stmtlens.sources.changes import parse_changed_files

_KEYS = ("repo", "pr", "path")
_EXT = [".sql", ".SQL", ".java", ".md", "/Makefile", ".sql"]
_STATUS = ["added", "modified", "renamed", "removed", "copied", "changed", "unchanged", "moved"]


def _hunk(h: int):
    """Text of hunk ``h``: line i is '+', '-', ' ' or empty by arithmetic on the keys."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    flag = lambda i: (k * 7 + i * i * 3 + c + h) % 5
    index = F.sequence(F.lit(1), (k % 6 + h).cast("int"))
    line = lambda i: F.when(flag(i) < 2, F.concat(F.lit("+a"), i.cast("string"))).when(
        flag(i) == 2, F.concat(F.lit("-r"), i.cast("string"))
    ).when(flag(i) == 3, F.concat(F.lit(" c"), i.cast("string"))).otherwise("")
    head = F.size(F.filter(index, lambda i: flag(i) != 2))
    if h == 2:
        head = head + F.when(k % 31 == 0, 1).otherwise(0)
    base = F.size(F.filter(index, lambda i: flag(i) >= 2))
    counted = lambda n: F.when((n == 1) & (k % 2 == 0), F.lit("")).otherwise(
        F.concat(F.lit(","), n.cast("string"))
    )
    header = F.concat(
        F.lit(f"@@ -{10 * h}"), counted(base), F.lit(" +"),
        (k % 7 + 100 * h).cast("string"), counted(head), F.lit(" @@ context\n"),
    )
    return F.concat(
        F.when(k % 23 == 2, F.lit("")).otherwise(header),
        F.array_join(F.transform(index, line), "\n"),
    )


def patches(spark, folder):
    """``repo, pr, path, patch`` (NULL patch for every 11th order)."""
    o = spread(table(spark, folder, "orders").select("o_orderkey", "o_custkey"), "o_orderkey")
    k = F.col("o_orderkey")
    text = F.concat(
        F.when(k % 3 == 0, "diff --git a/x b/x\n?noise\n").otherwise(""),
        _hunk(1), F.lit("\n"), _hunk(2),
        F.when(k % 5 == 0, "\n\\ No newline at end of file").otherwise(""),
        F.when(k % 29 == 1, "\n?odd").otherwise(""),
        F.lit("\n"),
    )
    return o.select(
        F.concat(F.lit("r"), (F.col("o_custkey") % 50).cast("string")).alias("repo"),
        (k % 40).alias("pr"),
        F.concat(F.lit("p"), k.cast("string"), pick(k, _EXT)).alias("path"),
        F.when(k % 11 == 0, F.lit(None)).otherwise(text).alias("patch"),
        k.alias("k"),
    )


def _lines(spark, folder):
    return diff.patch_lines(patches(spark, folder), _KEYS)


def changed_file_rows(spark, folder):
    k = F.col("k")
    payload = F.to_json(
        F.array(
            F.struct(
                F.col("path").alias("filename"), pick(k, _STATUS).alias("status"),
                F.when(k % 8 == 2, F.concat(F.lit("old/"), "path")).alias("previous_filename"),
                "patch", F.when(k % 22 == 0, 0).otherwise(k % 9).alias("additions"),
                (k % 22 % 2).alias("deletions"), F.lit("ignored").alias("sha"),
            )
        )
    )
    rows = patches(spark, folder).select("repo", "pr", "k", payload.alias("payload"))
    return parse_changed_files(rows)


def changed_files(spark, folder):
    return changed_file_rows(spark, folder).select(
        "repo", "pr", "path", "status", "previous_path", "additions", "deletions",
        F.col("patch").isNotNull().alias("has_patch"),
    )


def hunks(spark, folder):
    return diff.hunks(_lines(spark, folder), _KEYS)


def head_lines(spark, folder):
    return _lines(spark, folder).filter("advances").select(*_KEYS, "hunk", "raw", "head_line")


def added_ranges(spark, folder):
    return diff.added_ranges(_lines(spark, folder), _KEYS)


def malformed(spark, folder):
    return diff.malformed_patches(patches(spark, folder), _KEYS)


def outcome(spark, folder):
    # Read for their patches, for their texts and for themselves: the payloads are parsed once.
    files = cut_lineage(changed_file_rows(spark, folder))
    # Every 13th head text could not be read.
    heads = files.filter(F.col("k") % 13 != 0).select(*_KEYS, F.col("path").alias("content"))
    return diff.ingest_outcome(files, heads, _KEYS)


def _findings(spark, folder):
    """Four findings per patched file: a statement of 3 lines, one line, a span, no line."""
    p = patches(spark, folder)
    k = F.col("k")
    row = lambda n, line, lo, hi, extent: F.struct(
        F.lit(n).alias("n"), line.cast("int").alias("line"), lo.cast("int").alias("span_start"),
        hi.cast("int").alias("span_end"), F.lit(extent).alias("extent"),
    )
    none = F.lit(None)
    rows = F.array(
        row(0, 100 + k % 9, none, none, 2), row(1, 200 + k % 9, none, none, 0),
        row(2, 150 + k % 3, 100 + k % 9, 203 + k % 5, 0), row(3, none, none, none, 0),
    )
    return p.select("repo", "pr", F.col("path").alias("file"), "k", F.explode(rows).alias("_r")).select(
        "repo", "pr", "file", (k * 4 + F.col("_r.n")).alias("seq"), "_r.line", "_r.span_start",
        "_r.span_end", "_r.extent",
    )


def scope(spark, folder):
    lines = diff.range_lines(patches(spark, folder), _KEYS).withColumnRenamed("path", "file")
    keys = ("repo", "pr", "file")
    ranges = diff.change_ranges(lines, keys)
    return diff.scope_changes(
        _findings(spark, folder), ranges, diff.hunks(lines, keys)
    ).select("repo", "pr", "seq", "in_scope")


def changed_lines(spark, folder):
    """Four lines of every file, patched or not: which lie inside a hunk?"""
    p = patches(spark, folder)
    k = F.col("k")
    lines = F.array(*[(n + k % 11).cast("int") for n in (100, 104, 200, 300)])
    points = p.select(*_KEYS, F.explode(lines).alias("line"))
    return diff.changed_lines(points, diff.hunks(_lines(spark, folder), _KEYS), _KEYS)


QUERIES = {
    "changed_lines": changed_lines,
    "changed_files": changed_files,
    "hunks": hunks,
    "head_lines": head_lines,
    "added_ranges": added_ranges,
    "malformed_patches": malformed,
    "ingest_outcome": outcome,
    "scope_changes": scope,
}

_FILES = """
WITH files AS (
  SELECT o_orderkey AS k, o_custkey AS c, 'r' || (o_custkey % 50) AS repo, o_orderkey % 40 AS pr,
         'p' || o_orderkey || CASE o_orderkey % 6 WHEN 0 THEN '.sql' WHEN 1 THEN '.SQL' WHEN 2 THEN '.java'
           WHEN 3 THEN '.md' WHEN 4 THEN '/Makefile' ELSE '.sql' END AS path,
         o_orderkey % 11 <> 0 AS has_patch, o_orderkey % 23 <> 2 AS has_headers
  FROM orders
), lines AS (
  SELECT *, (k * 7 + i * i * 3 + c + hunk) % 5 AS flag FROM (
    SELECT *, unnest(range(1, CAST(k % 6 + hunk + 1 AS BIGINT))) AS i
    FROM (SELECT *, unnest([1, 2]) AS hunk FROM files WHERE has_patch))
), numbered AS (
  SELECT *, CAST(100 * hunk + k % 7 + sum(CASE WHEN flag <> 2 THEN 1 ELSE 0 END)
            OVER (PARTITION BY k, hunk ORDER BY i) - 1 AS INTEGER) AS head_line
  FROM lines
), counts AS (
  SELECT k, repo, pr, path, hunk, CAST(count(*) FILTER (flag >= 2) AS INTEGER) AS base_lines,
         CAST(count(*) FILTER (flag <> 2) AS INTEGER) AS real_lines FROM lines GROUP BY ALL
), ranges AS (
  SELECT repo, pr, path, k, hunk, min(head_line) AS lo, max(head_line) AS hi FROM (
    SELECT *, head_line - row_number() OVER (PARTITION BY k, hunk ORDER BY i) AS island
    FROM numbered WHERE flag < 2) GROUP BY repo, pr, path, k, hunk, island
)
"""

ORACLES = {
    "changed_lines": _FILES
    + """, spans AS (
        SELECT k, 100 * hunk + k % 7 AS lo, 100 * hunk + k % 7 + real_lines + CASE WHEN hunk = 2 AND k % 31 = 0 THEN 1 ELSE 0 END - 1 AS hi
        FROM counts WHERE k % 23 <> 2)
      SELECT repo, pr, path, CAST(n + k % 11 AS INTEGER) AS line,
        NOT (has_patch AND has_headers) OR EXISTS (SELECT 1 FROM spans s WHERE s.k = f.k AND n + f.k % 11 BETWEEN s.lo AND s.hi) AS is_changed
      FROM files f, (VALUES (100), (104), (200), (300)) v(n)""",
    "changed_files": _FILES
    + """SELECT repo, pr, path, CASE k % 8 WHEN 0 THEN 'added' WHEN 1 THEN 'modified' WHEN 2 THEN 'renamed'
      WHEN 3 THEN 'removed' WHEN 4 THEN 'copied' WHEN 5 THEN 'changed' WHEN 6 THEN 'unchanged'
      ELSE 'modified' END AS status, CASE WHEN k % 8 = 2 THEN 'old/' || path END AS previous_path,
      CASE WHEN k % 22 = 0 THEN 0 ELSE k % 9 END AS additions, k % 22 % 2 AS deletions, has_patch
      FROM files""",
    "hunks": _FILES
    + """SELECT repo, pr, path, hunk, 10 * hunk AS base_start, base_lines,
      CAST(100 * hunk + k % 7 AS INTEGER) AS head_start,
      real_lines + CASE WHEN hunk = 2 AND k % 31 = 0 THEN 1 ELSE 0 END AS head_lines
      FROM counts WHERE k % 23 <> 2""",
    "head_lines": _FILES
    + """SELECT repo, pr, path, hunk, CASE WHEN flag < 2 THEN '+a' || i WHEN flag = 3 THEN ' c' || i ELSE '' END
      AS raw, head_line FROM numbered WHERE flag <> 2 AND has_headers""",
    "added_ranges": _FILES + "SELECT repo, pr, path, hunk, lo, hi FROM ranges WHERE k % 23 <> 2",
    "malformed_patches": _FILES
    + """SELECT repo, pr, path, CASE WHEN NOT has_headers THEN 'no hunk header'
      WHEN k % 29 = 1 THEN 'unknown line' ELSE 'wrong count' END AS fault
      FROM files WHERE has_patch AND (NOT has_headers OR k % 29 = 1 OR k % 31 = 0)""",
    "ingest_outcome": _FILES
    + """, judged AS (SELECT repo, pr, path, CASE WHEN k % 8 = 3 THEN 'deleted'
        WHEN k % 6 IN (3, 4) THEN 'unsupported-language'
        WHEN NOT has_patch AND k % 22 = 0 THEN 'no-text-change' END AS reason,
      NOT has_patch OR NOT has_headers OR k % 29 = 1 OR k % 31 = 0 OR k % 13 = 0 AS broken FROM files)
      SELECT repo, pr, path, reason, CASE WHEN reason IS NOT NULL THEN 'skipped' WHEN broken THEN 'degraded'
        ELSE 'source' END AS outcome, CASE WHEN reason IS NULL AND broken THEN 'ingest:' || path END AS marker
      FROM judged""",
    "scope_changes": _FILES
    + """, spans AS (
        SELECT k, lo, hi FROM ranges WHERE k % 23 <> 2
        UNION ALL
        SELECT k, 100 * hunk + k % 7, 100 * hunk + k % 7 + real_lines
               + CASE WHEN hunk = 2 AND k % 31 = 0 THEN 1 ELSE 0 END - 1
        FROM counts WHERE k % 23 <> 2 AND NOT EXISTS (
          SELECT 1 FROM ranges r WHERE r.k = counts.k AND r.hunk = counts.hunk)
      ), probes AS (
        SELECT k, 0 AS n, 100 + k % 9 AS lo, 102 + k % 9 AS hi FROM files
        UNION ALL SELECT k, 1, 200 + k % 9, 200 + k % 9 FROM files
        UNION ALL SELECT k, 2, 100 + k % 9, 100 + k % 9 FROM files
        UNION ALL SELECT k, 2, 203 + k % 5, 203 + k % 5 FROM files
      ), hits AS (
        SELECT DISTINCT p.k, p.n FROM probes p JOIN spans s ON p.k = s.k AND p.lo <= s.hi AND s.lo <= p.hi
          AND s.lo <= s.hi
      )
      SELECT f.repo, f.pr, f.k * 4 + v.n AS seq,
             (NOT f.has_patch OR NOT f.has_headers OR v.n = 3 OR h.k IS NOT NULL) AS in_scope
      FROM files f CROSS JOIN (SELECT unnest([0, 1, 2, 3]) AS n) v
      LEFT JOIN hits h ON h.k = f.k AND h.n = v.n""",
}
