"""Unified diffs: hunks, head line numbers, added ranges, ingest outcome, change scope.

A patch is one cell, so windows are keyed by one file of one review and hold the
lines of that cell only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stmtlens.operators.statements import hash_spread
from stmtlens.session import cut_lineage, sorted_joins
from stmtlens.sources.corpus import LANGUAGES, extension

_HEADER = r"\A@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@"


def _marked_lines(files: DataFrame, keys: tuple[str, ...], patch: str) -> DataFrame:
    """All patch lines with their kind; lines before the first header are hunk 0."""
    text = F.regexp_replace(F.col(patch), r"(?:\r\n|\n|\r)\z", "")
    exploded = hash_spread(
        files.filter(F.col(patch).isNotNull()).select(*keys, text.alias("_patch")), *keys
    ).select(*keys, F.posexplode(F.split("_patch", r"\r\n|\n|\r")).alias("n", "raw"))
    order = W.partitionBy(*keys).orderBy("n")
    running = order.rowsBetween(W.unboundedPreceding, W.currentRow)
    raw = F.col("raw")
    number = lambda i: F.regexp_extract(raw, _HEADER, i)
    count = lambda i: F.when(number(i) == "", 1).otherwise(number(i).try_cast("int"))
    header = F.when(
        F.col("is_header"),
        F.struct(
            number(1).cast("int").alias("base_start"),
            count(2).alias("base_lines"),
            number(3).cast("int").alias("head_start"),
            count(4).alias("head_lines"),
        ),
    )
    first = F.substring(raw, 1, 1)
    return (
        exploded.withColumn("is_header", F.rlike(raw, F.lit(_HEADER)))
        .withColumns(
            {
                "hunk": F.sum(F.col("is_header").cast("int")).over(running),
                "_header": header,
                "kind": F.when(F.col("is_header"), "header")
                .when(first == "\\", "note")
                .when(first == "-", "removed")
                .when(first == "+", "added")
                .when((first == " ") | (raw == ""), "context")
                .otherwise("unknown"),
            }
        )
        .withColumn("advances", F.col("kind").isin("added", "context"))
    )


def patch_lines(files: DataFrame, keys: tuple[str, ...] = ("path",), patch: str = "patch") -> DataFrame:
    """One row per patch line from the first hunk header on.

    ``hunk`` counts headers, ``advances`` says the line exists in the head file and
    ``head_line`` is its number there.
    """
    order = W.partitionBy(*keys).orderBy("n").rowsBetween(W.unboundedPreceding, W.currentRow)
    marked = _marked_lines(files, keys, patch).withColumn("_header", F.last("_header", ignorenulls=True).over(order))
    in_hunk = W.partitionBy(*keys, "hunk").orderBy("n").rowsBetween(W.unboundedPreceding, W.currentRow)
    return (
        marked.withColumn("_done", F.sum(F.col("advances").cast("int")).over(in_hunk))
        .filter(F.col("hunk") > 0)
        .withColumn(
            "head_line",
            F.when(F.col("advances"), (F.col("_header.head_start") + F.col("_done") - 1).cast("int")),
        )
        .select(*keys, "hunk", "n", "raw", "kind", "advances", "head_line", "_header.*")
    )


def range_lines(files: DataFrame, keys: tuple[str, ...] = ("path",), patch: str = "patch") -> DataFrame:
    """The headers and added lines of :func:`patch_lines`, written once: hunks and ranges read them three times."""
    lines = patch_lines(files, keys, patch).filter(F.col("kind").isin("header", "added"))
    return cut_lineage(lines.drop("raw", "advances"))


def hunks(lines: DataFrame, keys: tuple[str, ...] = ("path",)) -> DataFrame:
    return lines.filter(F.col("kind") == "header").select(
        *keys, "hunk", "base_start", "base_lines", "head_start", "head_lines"
    )


def added_ranges(lines: DataFrame, keys: tuple[str, ...] = ("path",)) -> DataFrame:
    """Inclusive head-line ranges the change wrote: gaps and islands over ``+`` lines."""
    order = W.partitionBy(*keys, "hunk").orderBy("n")
    return (
        lines.filter(F.col("kind") == "added")
        .withColumn("_island", F.col("head_line") - F.row_number().over(order))
        .groupBy(*keys, "hunk", "_island")
        .agg(F.min("head_line").alias("lo"), F.max("head_line").alias("hi"))
        .drop("_island")
    )


def change_ranges(lines: DataFrame, keys: tuple[str, ...] = ("path",)) -> DataFrame:
    """Ranges that count as changed: added ranges, or the span of a hunk without any."""
    added = added_ranges(lines, keys)
    bare = hunks(lines, keys).join(sorted_joins(added.select(*keys, "hunk").distinct()), [*keys, "hunk"], "left_anti")
    spans = bare.filter("head_lines > 0").select(
        *keys, "hunk", F.col("head_start").alias("lo"),
        (F.col("head_start") + F.col("head_lines") - 1).alias("hi"),
    )
    return added.unionByName(spans)


def hunk_table(lines: DataFrame, keys: tuple[str, ...] = ("path",)) -> DataFrame:
    """Hunks with their ranges as one sorted array (a part of one patch cell)."""
    ranges = added_ranges(lines, keys).groupBy(*keys, "hunk").agg(
        F.sort_array(F.collect_list(F.struct("lo", "hi"))).alias("added_ranges")
    )
    return hunks(lines, keys).join(sorted_joins(ranges), [*keys, "hunk"], "left")


def malformed_patches(files: DataFrame, keys: tuple[str, ...] = ("path",), patch: str = "patch") -> DataFrame:
    """Files whose patch contradicts itself, with the first kind of fault found."""
    per_hunk = _marked_lines(files, keys, patch).groupBy(*keys, "hunk").agg(
        F.bool_or((F.col("hunk") > 0) & (F.col("kind") == "unknown")).alias("unknown"),
        ((F.col("hunk") > 0) & (F.sum(F.col("advances").cast("int")) != F.max("_header.head_lines"))).alias("wrong"),
        F.bool_or(F.rlike("raw", F.lit(r"\S"))).alias("written"),
    )
    return (
        per_hunk.groupBy(*keys)
        .agg(
            ((F.max("hunk") == 0) & F.bool_or("written")).alias("headless"),
            F.bool_or("unknown").alias("unknown"), F.bool_or("wrong").alias("wrong"),
        )
        .select(
            *keys,
            F.when(F.col("headless"), "no hunk header").when(F.col("unknown"), "unknown line")
            .when(F.col("wrong"), "wrong count").alias("fault"),
        )
        .filter("fault is not null")
    )


def ingest_outcome(
    files: DataFrame, heads: DataFrame, keys: tuple[str, ...] = ("path",)
) -> DataFrame:
    """Each changed file is a source, skipped (why), or degraded (``ingest:<path>``).

    ``heads(keys, content)`` holds the readable head texts.
    """
    bad = malformed_patches(files, keys).select(*keys, F.lit(True).alias("_bad"))
    readable = heads.select(*keys, F.lit(True).alias("_readable"))
    joined = files.join(sorted_joins(bad), list(keys), "left").join(sorted_joins(readable), list(keys), "left")
    no_patch = F.col("patch").isNull()
    skip = (
        F.when(F.col("status") == "removed", "deleted")
        .when(~extension(F.col("path")).isin(*LANGUAGES), "unsupported-language")
        .when(no_patch & (F.col("additions") == 0) & (F.col("deletions") == 0), "no-text-change")
    )
    degraded = no_patch | F.col("_bad").isNotNull() | F.col("_readable").isNull()
    return (
        joined.withColumn("reason", skip)
        .withColumn(
            "outcome",
            F.when(F.col("reason").isNotNull(), "skipped").when(degraded, "degraded").otherwise("source"),
        )
        .withColumn(
            "marker", F.when(F.col("outcome") == "degraded", F.concat(F.lit("ingest:"), "path"))
        )
        .select(*keys, "outcome", "reason", "marker")
    )


# --- scope ---------------------------------------------------------------------------

_BUCKET = 256


def _buckets(lo: str, hi: str) -> Column:
    return F.explode(F.sequence(F.floor(F.col(lo) / _BUCKET), F.floor(F.col(hi) / _BUCKET)))


def scope_changes(
    findings: DataFrame,
    ranges: DataFrame,
    diffed_files: DataFrame,
    keys: tuple[str, ...] = ("repo", "pr"),
) -> DataFrame:
    """Adds ``in_scope``: the finding concerns a line this change wrote.

    ``findings(keys, seq, file, line, span_start, span_end, extent)``; ``extent`` is the
    number of line breaks in the statement (0 for derived methods).  ``ranges(keys,
    file, lo, hi)`` as of :func:`change_ranges`; ``diffed_files(keys, file)`` are files
    that have hunks.  A span counts by its two ends only, a statement by all lines.

    The interval test is an equi join on line buckets.  Ranges of a file are
    disjoint, so a probe meets at most a bucket's worth of them however many
    findings or ranges one file has.
    """
    join_keys = [*keys, "file"]
    probe = F.when(
        F.col("span_start").isNotNull() & F.col("span_end").isNotNull(),
        F.array(
            F.struct(F.col("span_start").alias("lo"), F.col("span_start").alias("hi")),
            F.struct(F.col("span_end").alias("lo"), F.col("span_end").alias("hi")),
        ),
    ).otherwise(
        F.array(F.struct(F.col("line").alias("lo"), (F.col("line") + F.col("extent")).alias("hi")))
    )
    probes = (
        findings.filter(F.col("line").isNotNull())
        .select(*keys, "seq", "file", F.explode(probe).alias("_p"))
        .select(*keys, "seq", "file", "_p.lo", "_p.hi")
        .withColumn("bucket", _buckets("lo", "hi"))
    )
    spread = ranges.select(
        *join_keys, F.col("lo").alias("r_lo"), F.col("hi").alias("r_hi")
    ).withColumn("bucket", _buckets("r_lo", "r_hi"))
    touched = (
        probes.join(sorted_joins(spread), [*join_keys, "bucket"], "inner")
        .filter((F.col("lo") <= F.col("r_hi")) & (F.col("r_lo") <= F.col("hi")))
        .select(*keys, "seq")
        .distinct()
        .withColumn("_touched", F.lit(True))
    )
    diffed = diffed_files.select(*join_keys).distinct().withColumn("_diffed", F.lit(True))
    return (
        findings.join(sorted_joins(diffed), join_keys, "left")
        .join(sorted_joins(touched), [*keys, "seq"], "left")
        .withColumn(
            "in_scope",
            F.col("_diffed").isNull() | F.col("line").isNull() | F.col("_touched").isNotNull(),
        )
        .drop("_diffed", "_touched")
    )


def changed_lines(points: DataFrame, hunk_rows: DataFrame, keys: tuple[str, ...] = ("path",)) -> DataFrame:
    """Adds ``is_changed`` to ``points(keys, line)``: inside a hunk's span, or no hunks."""
    spans = hunk_rows.filter("head_lines > 0").select(
        *keys, F.col("head_start").alias("r_lo"),
        (F.col("head_start") + F.col("head_lines") - 1).alias("r_hi"),
    ).withColumn("bucket", _buckets("r_lo", "r_hi"))
    hit = (
        points.withColumn("bucket", F.floor(F.col("line") / _BUCKET))
        .join(sorted_joins(spans), [*keys, "bucket"])
        .filter(F.col("line").between(F.col("r_lo"), F.col("r_hi")))
        .select(*keys, "line").distinct().withColumn("_hit", F.lit(True))
    )
    has = hunk_rows.select(*keys).distinct().withColumn("_has", F.lit(True))
    return (
        points.join(sorted_joins(hit), [*keys, "line"], "left").join(sorted_joins(has), list(keys), "left")
        .withColumn("is_changed", F.col("_has").isNull() | F.col("_hit").isNotNull())
        .drop("_hit", "_has")
    )
