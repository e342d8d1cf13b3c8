"""Changed files to a decision per review: the operators in their one right order.

Duplicates go before the change scope; the gate sees every scoped finding; the cap
comes last and only limits what is shown.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stmtlens.functions import lexing as lx
from stmtlens.functions.paths import split_ignored
from stmtlens.operators import diff, review, rules
from stmtlens.operators import statements as st
from stmtlens.operators.java import JavaFacts
from stmtlens.operators.schema_versions import schema_versions
from stmtlens.plans.nplusone import nplusone_findings
from stmtlens.session import cut_lineage, sorted_joins
from stmtlens.sources.config import review_dialects
from stmtlens.sources.corpus import apply_run_dialect

KEYS = ("repo", "pr", "path")


@dataclass(frozen=True)
class ReviewTables:
    findings: DataFrame
    shown: DataFrame
    statuses: DataFrame
    digest: DataFrame


def _extent(text):
    return F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))


def _place(file_seq, ordinal, rule_order, seq, other) -> Column:
    """Where a finding was raised: an order of numbers, no padded text that could be cut."""
    names = ("file_seq", "ordinal", "rule_order", "seq")
    parts = [F.col(c) if isinstance(c, str) else c for c in (file_seq, ordinal, rule_order, seq)]
    return F.struct(*(p.cast("long").alias(n) for p, n in zip(parts, names)), other.cast("string").alias("other"))


_UNREADABLE = "unterminated or unbalanced text"


def _review_key() -> Column:
    """One value that stands for (repo, pr) where the Java operators look for a repository."""
    return F.to_json(F.struct("repo", "pr"))


def _java_queries(facts: JavaFacts, sources: DataFrame) -> DataFrame:
    """The queries of Java files in the columns of the SQL files' statements."""
    reviews = sources.select(*KEYS, "dialect", _review_key().alias("_review"))
    found = facts.queries.withColumnRenamed("repo", "_review")
    well = lx.sql_well_formed(F.col("text"), F.col("dialect"))
    return found.join(sorted_joins(reviews), ["_review", "path"]).select(
        *KEYS, "ordinal", "line", "text", "dialect", F.when(~well, F.lit(_UNREADABLE)).alias("parse_error"), "id",
        "kind", "extent",
    )


def _java_findings(facts: JavaFacts, sources: DataFrame, groups: DataFrame | None) -> DataFrame:
    reviews = sources.select("repo", "pr", _review_key().alias("_review")).distinct()
    if groups is not None:
        groups = groups.join(sorted_joins(reviews), "repo").drop("repo", "pr").withColumnRenamed("_review", "repo")
    found = nplusone_findings(facts, groups).withColumnRenamed("repo", "_review")
    return found.join(sorted_joins(reviews), "_review").drop("_review")


def review_changes(
    changed: DataFrame,
    heads: DataFrame,
    policy: DataFrame,
    schema: DataFrame | None = None,
    cross_findings: DataFrame | None = None,
    max_findings: int | None = None,
    groups: DataFrame | None = None,
    disabled: DataFrame | None = None,
    ignored: DataFrame | None = None,
    files: DataFrame | None = None,
    roots: DataFrame | None = None,
) -> ReviewTables:
    """Review changes of SQL and Java files.

    ``changed(repo, pr, seq, path, status, patch, additions, deletions)``, ``heads(repo,
    pr, path, content, dialect)``, ``policy`` as of ``layer_policy``.  ``schema`` as of
    ``table_schema``; with a ``repo`` each repository sees its own.  ``groups`` are the
    ``repeated_statements`` per ``repo`` and back up N+1 findings.  ``cross_findings`` carry the
    columns of ``findings`` below.  ``disabled(repo, rule_id)`` switches rules off,
    ``ignored(repo, pattern)`` leaves files out.  With ``files(repo, path, content)``, the repositories
    at their base, the schema of each review is read from its changelogs, at the head where the change
    touches them (``schema_versions``; ``roots`` are its configured roots), and ``heads`` hold the
    changelogs and configurations of the change, too; ``schema`` is not read then, and the SQL files' dialect
    is the one that the configuration names.  ``max_findings`` limits what is shown; without
    it all is.  Findings of equal rank keep the listed order of their files.

    The statements, the ranked findings and, for Java files, their facts are written to the shared
    folder while the plan is built, as several results read them.
    """
    if ignored is not None:
        changed = split_ignored(changed, ignored).filter("not ignored").drop("ignored")
    shown_at_most = (1 << 31) - 1 if max_findings is None else max_findings
    versions = None
    if files is not None:
        versions = schema_versions(files, changed, heads, roots)
        dialects = cut_lineage(review_dialects(files, changed, heads))
        heads = apply_run_dialect(heads, dialects, ("repo", "pr"))
    outcome = diff.ingest_outcome(changed, heads, KEYS)
    sources = heads.join(sorted_joins(outcome.filter("outcome = 'source'").select(*KEYS)), list(KEYS), "left_semi")
    queries = st.split_statements(sources.filter(F.lower("path").endswith(".sql")), KEYS)
    queries = queries.withColumns({"kind": F.lit("raw_sql"), "extent": _extent(F.col("text"))})
    java = cut_lineage(sources.filter(F.lower("path").endswith(".java")))
    facts = None
    if not java.isEmpty():
        facts = JavaFacts(java.select(_review_key().alias("repo"), "path", "content"))
        queries = queries.unionByName(_java_queries(facts, java))
    # The rules, what they found, and three results read these rows; their texts are split once.
    queries = cut_lineage(queries.withColumn("qid", F.to_json(F.struct(*KEYS, "ordinal"))))
    judged_by = queries
    if versions is not None:
        schema = versions.schema
        judged_by = queries.join(sorted_joins(versions.sources.select("repo", "pr", "rev")), ["repo", "pr"])
    found = rules.run_rules(rules.audit_tables(judged_by, schema)).join(
        sorted_joins(queries.select("qid", *KEYS, "ordinal", "id", "line", "extent")), "qid"
    ).join(sorted_joins(changed.select(*KEYS, F.col("seq").cast("long").alias("file_seq"))), list(KEYS))
    none = F.lit(None).cast("int")
    static = found.select(
        "repo", "pr", _place("file_seq", "ordinal", "rule_order", "seq", F.lit("")).alias("seq"),
        "rule_id", "severity", F.col("id").alias("query_id"), F.col("path").alias("file"), "line", "title",
        "explanation", "suggestion", "suggestion_sql", "confidence", "confidence_basis", "extent",
        none.alias("span_start"), none.alias("span_end"),
    )
    crossing = [] if facts is None else [_java_findings(facts, java, groups)]
    if cross_findings is not None:
        crossing.append(cross_findings)
    zero = F.lit(0)
    merged = review.merge_findings(
        static, *(c.withColumn("seq", _place(zero, zero, zero, zero, F.col("seq"))) for c in crossing)
    )
    if disabled is not None:
        merged = review.disable_rules(merged, disabled)
    ranked = review.rank_findings(merged, order=("stage", "seq"))
    lines = diff.range_lines(changed, KEYS).withColumnRenamed("path", "file")
    file_keys = ("repo", "pr", "file")
    # Four results read these rows; without the cut each would do all of the above again.
    scoped = cut_lineage(diff.scope_changes(ranked, diff.change_ranges(lines, file_keys), diff.hunks(lines, file_keys)))
    kept = scoped.filter("in_scope")
    judged = review.should_block(kept, policy)
    runs = changed.select("repo", "pr").distinct()
    markers = outcome.join(sorted_joins(changed.select(*KEYS, "seq")), list(KEYS)).filter("marker is not null")
    degraded = review.degraded_markers(
        queries.join(sorted_joins(changed.select(*KEYS, F.col("seq").alias("file_seq"))), list(KEYS)), initial=markers
    )
    unchanged = scoped.groupBy("repo", "pr").agg(F.count_if(~F.col("in_scope")).alias("n_unchanged"))
    return ReviewTables(
        findings=judged,
        shown=review.cap_findings(kept, shown_at_most, order=("stage", "seq")),
        statuses=review.review_status(runs, judged, queries, degraded),
        digest=review.review_digest(runs, kept, queries, degraded, unchanged, shown_at_most),
    )
