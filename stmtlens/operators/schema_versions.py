"""The schema each review is judged by: at the base of its change, or rebuilt at its head.

A *version* is a repository at its base, or at the head of one review.  Base and heads share all files
but the touched ones, so every file version is parsed once and folded once to what it leaves behind:
the last event of each index and column it names.  A version's schema is the fold of those few rows in
the order its include tree gives the files.  As a file's events all lie between those of the files
visited around it or of its own includes, the last of its last events is the last of all.

Heads are built only for reviews that touch what the schema hangs on; all others share the base's.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stmtlens.operators import schema as sc
from stmtlens.session import cut_lineage, sorted_joins
from stmtlens.sources.changelog import scan_changelogs
from stmtlens.sources.config import CANDIDATE_PATHS

#: Where a version comes from; a review's is a mark and its number.
BASE = ""
FILE = ("repo", "rev", "path")
SCOPE = ("version", "root")


@dataclass(frozen=True)
class SchemaVersions:
    """``sources(repo, pr, source, root, rev)`` for each review, and ``schema(repo, rev, ...)`` as of
    ``table_schema`` for each version that a source names."""

    sources: DataFrame
    schema: DataFrame


def review_rev(pr: Column) -> Column:
    return F.concat(F.lit("@"), F.coalesce(pr.cast("string"), F.lit("")))


def _version() -> Column:
    """One value for (repo, rev), where the operators on changelogs look for a repository."""
    return F.to_json(F.struct("repo", "rev"))


def _is_xml() -> Column:
    return F.lower("path").endswith(".xml")


def _is_config() -> Column:
    return F.col("path").isin(*CANDIDATE_PATHS)


def skeleton(scan: DataFrame) -> DataFrame:
    """What a version needs of each file to find its roots and walk its includes."""
    rows = scan.filter(F.col("op").isin("file", "include", "includeAll")).select(
        *FILE, "op", "item", "name", "value", "relative"
    )
    none = F.lit(None).cast("string")
    changes = scan.filter("op = 'changeSet'").select(*FILE, "op").distinct().select(
        *FILE, "op", F.lit(0).alias("item"), none.alias("name"), none.alias("value"), F.lit(False).alias("relative")
    )
    return rows.unionByName(changes)


def file_folds(scan: DataFrame) -> dict[str, DataFrame]:
    """What each file version leaves behind: names of tables, last events of indexes and columns, properties."""
    local = scan.withColumn("order_key", F.array("item", "seq"))
    last = lambda *fields: F.max_by(F.struct(*fields, "order_key"), "order_key").alias("_last")
    return {
        "tables": sc.named_tables(local, FILE),
        "indexes": sc.index_events(local, FILE).groupBy(*FILE, "table_name", "index_name").agg(last("kind", "columns"))
        .select(*FILE, "table_name", "index_name", "_last.*"),
        "columns": sc.column_events(local, FILE).groupBy(*FILE, "table_name", "column").agg(last("type"))
        .select(*FILE, "table_name", "column", "_last.*"),
        "properties": local.filter("op = 'property'").select(*FILE, "name", "value", "order_key"),
    }


def fold_versions(tree: DataFrame, folds: dict[str, DataFrame]) -> DataFrame:
    """The tables of each scope from its tree (``SCOPE, FILE, order_key``) and the files' own folds."""

    def placed(rows: DataFrame) -> DataFrame:
        at = tree.select(*SCOPE, *FILE, F.col("order_key").alias("_file_key"))
        return rows.join(sorted_joins(at), list(FILE)).withColumn("order_key", F.concat("_file_key", "order_key")).drop(*FILE, "_file_key")

    columns = (
        placed(folds["columns"]).groupBy(*SCOPE, "table_name", "column")
        .agg(F.max_by(F.struct("type", "order_key"), "order_key").alias("_last"))
        .select(*SCOPE, "table_name", "column", "_last.*", F.to_json(F.struct("table_name", "column")).alias("row_id"))
    )
    typed = sc.substitute_properties(columns, placed(folds["properties"]), SCOPE)
    tables = folds["tables"].join(sorted_joins(tree.select(*SCOPE, *FILE)), list(FILE)).select(*SCOPE, "table_name").distinct()
    indexes = sc.index_state(placed(folds["indexes"]), SCOPE)
    return sc.table_schema(tables, indexes, typed.select(*SCOPE, "table_name", "column", "type"), SCOPE)


def _walk(versions: DataFrame, bones: DataFrame, configs: DataFrame, explicit: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(order, choice) of ``versions(repo, rev)``: the include trees of their possible roots, and for each
    version ``kind, root`` of the one that gives its schema (null if none does).

    ``bones`` and ``configs`` hold the files as the versions see them.  A configured root is the only one;
    else the declared one, if it loads; else the only best-looking file, unless declarations disagree.
    """
    named = versions.select(_version().alias("version"), "repo", "rev")
    as_repo = lambda rows: rows.select(_version().alias("repo"), *[c for c in rows.columns if c not in ("repo", "rev")])
    files = cut_lineage(as_repo(bones))
    found = sc.discover_changelog(as_repo(configs), named.select(F.col("version").alias("repo")))
    scored = sc.pick_root(sc.score_roots(files), named.select(F.col("version").alias("repo")))
    asked = cut_lineage(
        named.join(sorted_joins(explicit.select("repo", F.col("root").alias("e"))), "repo", "left")
        .join(sorted_joins(found.select(F.col("repo").alias("version"), "status", F.col("changelog_path").alias("d"))), "version", "left")
        .join(sorted_joins(scored.select(F.col("repo").alias("version"), F.col("changelog_path").alias("s"))), "version", "left")
    )
    possible = F.when(F.col("e").isNotNull(), F.array("e")).otherwise(F.array_distinct(F.array_compact(F.array("d", "s"))))
    order = sc.include_order(asked.select(F.col("version").alias("repo"), F.explode(possible).alias("root")), files)
    good = sc.loadable_roots(order, files).filter("loadable").groupBy(F.col("repo").alias("version")).agg(
        F.collect_set("root").alias("_good")  # three at most
    )
    ok = lambda c: F.coalesce(F.array_contains("_good", F.col(c)), F.lit(False))
    kind = (
        F.when(F.col("e").isNotNull(), F.when(ok("e"), "explicit"))
        .when(ok("d"), "config").when(F.col("status") == "ambiguous", None).when(ok("s"), "scoring")
    )
    root = F.when(F.col("kind") == "explicit", F.col("e")).when(F.col("kind") == "config", F.col("d")).when(F.col("kind") == "scoring", F.col("s"))
    chosen = asked.join(sorted_joins(good), "version", "left").withColumn("kind", kind).select("repo", "rev", "version", "kind", root.alias("root"))
    return order.withColumnRenamed("repo", "version"), cut_lineage(chosen)


def _overlay(base: DataFrame, heads: DataFrame, touched: DataFrame, paths: DataFrame) -> DataFrame:
    """``repo, rev, path, file_rev``: the files of each touched review's head, base files where it left them."""
    left = (
        touched.join(sorted_joins(base.select("repo", "path").distinct()), "repo")
        .join(sorted_joins(paths.select("repo", "rev", "path")), ["repo", "rev", "path"], "left_anti")
        .select("repo", "rev", "path", F.lit(BASE).alias("file_rev"))
    )
    return left.unionByName(heads.select("repo", "rev", "path", F.col("rev").alias("file_rev")).distinct())


def _seen(view: DataFrame, rows: DataFrame) -> DataFrame:
    """Rows of file versions, once for each version that sees the file."""
    of = rows.withColumnRenamed("rev", "file_rev")
    return view.join(sorted_joins(of), ["repo", "file_rev", "path"]).drop("file_rev")


def schema_versions(files: DataFrame, changed: DataFrame, heads: DataFrame, explicit: DataFrame | None = None) -> SchemaVersions:
    """The schema of each review in ``changed(repo, pr, path[, previous_path])``.

    ``files(repo, path, content)`` are the repositories at their base, ``heads(repo, pr, path, content)``
    the changed files that exist at the head, ``explicit(repo, root)`` the configured roots, one a
    repository at most.  ``source`` is explicit-head, explicit-base, config, scoring or unknown:

    * a configured root is read at the base; if the change touches its tree, at the head, and if that
      doesn't load, at the base after all;
    * without one the root is looked for at the head, in declarations and then among all XML files.  A
      change that touches neither sees what the base gives, which is the same.

    Written to the shared folder while the plan is built: the scans, the trees and the choices.
    """
    spark = files.sparkSession
    if explicit is None:
        explicit = spark.createDataFrame([], "repo string, root string")
    wanted = _is_xml() | _is_config()
    rev = review_rev(F.col("pr")).alias("rev")
    paths = changed.select("repo", rev, "path")
    if "previous_path" in changed.columns:
        paths = paths.union(changed.filter("previous_path is not null").select("repo", rev, "previous_path"))
    paths = paths.distinct()
    base = files.filter(wanted).select("repo", F.lit(BASE).alias("rev"), "path", "content")
    scan = cut_lineage(scan_changelogs(base.filter(_is_xml()), FILE))
    reviews = changed.select("repo", "pr", rev).distinct()
    repos = files.select("repo").union(reviews.select("repo")).distinct().withColumn("rev", F.lit(BASE))
    order, chosen = _walk(repos, skeleton(scan), base.filter(_is_config()), explicit)

    tree = chosen.filter("kind = 'explicit'").join(sorted_joins(order), ["version", "root"]).select("repo", "path")
    in_tree = paths.join(sorted_joins(tree), ["repo", "path"], "left_semi")
    free = paths.filter(wanted).join(sorted_joins(explicit.select("repo")), "repo", "left_anti")
    touched = cut_lineage(in_tree.select("repo", "rev").union(free.select("repo", "rev")).distinct())

    own = heads.filter(wanted).select("repo", rev, "path", "content")
    own = own.join(sorted_joins(touched), ["repo", "rev"], "left_semi").join(sorted_joins(paths), list(FILE), "left_semi")
    own_scan = cut_lineage(scan_changelogs(own.filter(_is_xml()), FILE))
    view = cut_lineage(_overlay(base, own, touched, paths))
    every = scan.unionByName(own_scan)
    every_config = base.filter(_is_config()).unionByName(own.filter(_is_config()))
    head_order, head_chosen = _walk(touched, _seen(view, skeleton(every)), _seen(view, every_config), explicit)

    at_base = chosen.select("repo", F.col("kind").alias("_base"), F.col("root").alias("_base_root"))
    at_head = head_chosen.select("repo", "rev", F.lit(True).alias("_touched"), F.col("kind").alias("_head"), F.col("root").alias("_head_root"))
    joined = (
        reviews.join(sorted_joins(at_base), "repo", "left").join(sorted_joins(at_head), ["repo", "rev"], "left")
        .join(sorted_joins(explicit.select("repo", F.lit(True).alias("_explicit"))), "repo", "left")
    )
    built = F.col("_touched").isNotNull() & (F.col("_explicit").isNull() | (F.col("_head") == "explicit") & F.col("_base").isNotNull())
    kind = F.when(built, F.col("_head")).otherwise(F.col("_base"))
    source = F.when(kind == "explicit", F.when(built, "explicit-head").otherwise("explicit-base")).otherwise(F.coalesce(kind, F.lit("unknown")))
    sources = cut_lineage(
        joined.withColumn("_built", F.coalesce(built, F.lit(False))).select(
            "repo", "pr", source.alias("source"), F.when(F.col("_built"), F.col("_head_root")).otherwise(F.col("_base_root")).alias("root"),
            F.when(F.col("_built"), F.col("rev")).otherwise(F.lit(BASE)).alias("rev"),
        )
    )
    used = sources.filter("root is not null").select("repo", "rev", "root").distinct()
    base_view = base.select("repo", "rev", "path", F.col("rev").alias("file_rev"))
    trees = (
        used.withColumn("version", _version())
        .join(sorted_joins(order.unionByName(head_order)), ["version", "root"])
        .join(sorted_joins(base_view.unionByName(view)), ["repo", "rev", "path"])
        .select(*SCOPE, "repo", F.col("file_rev").alias("rev"), "path", "order_key")
    )
    schema = fold_versions(cut_lineage(trees), file_folds(every))
    back = F.from_json("version", "repo string, rev string")
    return SchemaVersions(sources, schema.select(back["repo"].alias("repo"), back["rev"].alias("rev"), *schema.columns[2:]))
