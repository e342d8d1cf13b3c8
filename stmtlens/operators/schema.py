"""Tables, indexes and column types rebuilt from ordered schema changes.

``scan`` is the output of ``scan_changelogs``.  A *scope* is one changelog root of one
repository: ``(repo, root)``.  An order key is the array of child numbers from the
root file down to the operation; arrays compare element by element, so it is the
order in which a depth-first walk meets the operations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stmtlens.functions.paths import dirname, join_path, normpath, unquote
from stmtlens.session import cut_lineage, sorted_joins
from stmtlens.sources.changelog import ROOT_TAG
from stmtlens.sources.config import CANDIDATE_PATHS, CHANGELOG_KEY, config_entries, yaml_changelog

SCOPE = ("repo", "root")
#: Parts of conventional names of a root file.
# Parts of names that change histories go by.
_NAMING_HINTS = ("changelog", "changeset", "db-changelog", "dbchangelog")


def include_target(path: Column, value: Column, relative: Column, other_dir: Column) -> Column:
    return normpath(join_path(F.when(relative, dirname(path)).otherwise(other_dir), value))


def include_order(roots: DataFrame, scan: DataFrame) -> DataFrame:
    """``repo, root, path, order_key``: every reachable file at its first visit.

    Breadth-first relaxation: a file keeps its smallest order key; a later, larger one
    is dropped with all that would follow from it, which also ends cycles.  Each round
    is one distributed join; only "is anything new" reaches the driver, and rounds are
    as many as the tree is deep.  Keys only fall, so the rounds end by themselves.  ``roots(repo, root)``.
    """
    # Each round reads the edges, so they are a table of their own, without the other operations.
    edges = cut_lineage(
        scan.filter((F.col("op") == "include") & (F.coalesce("value", F.lit("")) != "")).select(
            "repo", "path", "item", "value", "relative"
        )
    )
    best = cut_lineage(
        roots.select(
            "repo", "root", normpath(F.col("root")).alias("path"),
            F.array().cast("array<int>").alias("order_key"),
        )
    )
    frontier = best
    while True:
        reached = (
            frontier.join(edges, ["repo", "path"])
            .select(
                "repo", "root",
                include_target(F.col("path"), F.col("value"), F.col("relative"),
                               dirname(normpath(F.col("root")))).alias("path"),
                F.array_append("order_key", F.col("item")).alias("order_key"),
            )
            .groupBy("repo", "root", "path")
            .agg(F.min("order_key").alias("order_key"))
        )
        known = best.withColumnRenamed("order_key", "_known")
        frontier = cut_lineage(
            reached.join(known, ["repo", "root", "path"], "left")
            .filter(F.col("_known").isNull() | (F.col("order_key") < F.col("_known")))
            .drop("_known")
        )
        if frontier.isEmpty():
            return best
        best = cut_lineage(
            best.unionByName(frontier).groupBy("repo", "root", "path").agg(
                F.min("order_key").alias("order_key")
            )
        )


def loadable_roots(order: DataFrame, scan: DataFrame) -> DataFrame:
    """``repo, root, loadable``: every file of the tree exists and is well-formed XML."""
    files = scan.filter("op = 'file'").select("repo", "path", F.col("value").isNull().alias("_ok"))
    return (
        order.join(sorted_joins(files), ["repo", "path"], "left")
        .groupBy("repo", "root")
        .agg(F.bool_and(F.coalesce("_ok", F.lit(False))).alias("loadable"))
    )


def ordered_operations(order: DataFrame, scan: DataFrame) -> DataFrame:
    """Operations and properties of each scope with their full order key."""
    return (
        order.join(scan.filter(~F.col("op").isin("file", "include", "includeAll", "changeSet")), ["repo", "path"])
        .withColumn("order_key", F.concat("order_key", F.array("item", "seq")))
        .drop("item", "seq", "relative")
    )


# --- properties ------------------------------------------------------------------------


def substitute_properties(
    typed: DataFrame, properties: DataFrame, keys: tuple[str, ...] = SCOPE
) -> DataFrame:
    """Replace ``${name}`` in ``type`` by the property's value *as of* the row.

    ``typed(keys, row_id, order_key, type, ...)`` and ``properties(keys, name, value,
    order_key)``.  The definitions of a name in a scope are few and become one row, an array in order;
    each use meets that row and takes the last definition before it.  A name that a third of all columns
    use is one key of an equi join, which the planner splits.  Unknown names stay as written.
    """
    marked = typed.filter(F.col("type").contains("${"))
    uses = marked.select(
        *keys, "row_id", "order_key",
        F.explode(F.array_distinct(F.regexp_extract_all("type", F.lit(r"\$\{([^}]*)\}"), F.lit(1)))).alias("name"),
    )
    definitions = (
        properties.filter(F.col("name").isNotNull() & (F.col("name") != "") & F.col("value").isNotNull())
        .groupBy(*keys, "name")
        .agg(F.sort_array(F.collect_list(F.struct("order_key", "value"))).alias("_defined"))
    )
    before = F.filter("_defined", lambda d: d["order_key"] <= F.col("order_key"))
    values = (
        uses.join(sorted_joins(definitions), [*keys, "name"])
        .withColumn("value", F.try_element_at(before, F.lit(-1))["value"])
        .filter(F.col("value").isNotNull())
        .groupBy(*keys, "row_id")
        .agg(F.collect_list(F.struct("name", "value")).alias("_values"))
    )
    replaced = F.aggregate(
        F.coalesce("_values", F.array().cast("array<struct<name:string,value:string>>")),
        F.col("type"),
        lambda text, p: F.replace(text, F.concat(F.lit("${"), p["name"], F.lit("}")), p["value"]),
    )
    return (
        typed.join(sorted_joins(values), [*keys, "row_id"], "left").withColumn("type", replaced).drop("_values")
    )


# --- events and folds --------------------------------------------------------------------


def column_events(ops: DataFrame, keys: tuple[str, ...] = SCOPE) -> DataFrame:
    """``keys, table_name, column, type, pk, uniq, order_key`` of createTable/addColumn."""
    return (
        ops.filter(F.col("op").isin("createTable", "addColumn") & (F.coalesce("table_name", F.lit("")) != ""))
        .select(*keys, "table_name", "order_key", F.posexplode("columns").alias("_i", "_c"))
        .filter(F.col("_c.name") != "")
        .select(
            *keys, "table_name", F.col("_c.name").alias("column"), F.col("_c.type").alias("type"),
            "_c.pk", "_c.uniq", F.array_append("order_key", F.col("_i")).alias("order_key"),
        )
    )


def index_events(ops: DataFrame, keys: tuple[str, ...] = SCOPE) -> DataFrame:
    """``keys, table_name, index_name, kind, columns, order_key`` in change order.

    Inline and unnamed constraints get synthetic names, as each backs an index.
    """
    table = F.col("table_name")
    named = ops.filter((F.coalesce("table_name", F.lit("")) != ""))
    names = F.transform(F.filter("columns", lambda c: c["name"] != ""), lambda c: c["name"])
    indexes = named.filter((F.col("op") == "createIndex") & (F.coalesce("index_name", F.lit("")) != "")).select(
        *keys, "table_name", "index_name", F.lit("create").alias("kind"), names.alias("columns"), "order_key"
    )
    unnamed = F.when(F.col("op") == "addPrimaryKey", "primary key of ").otherwise("unique of ")
    constraints = named.filter(
        F.col("op").isin("addPrimaryKey", "addUniqueConstraint") & (F.coalesce("value", F.lit("")) != "")
    ).select(
        *keys, "table_name",
        F.when(F.coalesce("index_name", F.lit("")) != "", F.col("index_name")).otherwise(F.concat(unnamed, table)).alias("index_name"),
        F.lit("create").alias("kind"), names.alias("columns"), "order_key",
    )
    drops = named.filter((F.col("op") == "dropIndex") & (F.coalesce("index_name", F.lit("")) != "")).select(
        *keys, "table_name", "index_name", F.lit("drop").alias("kind"),
        F.array().cast("array<string>").alias("columns"), "order_key",
    )
    inline = column_events(ops, keys).select(
        *keys, "table_name", "order_key", "column",
        F.explode(
            F.concat(
                F.when(F.col("pk"), F.array(F.lit("primary key"))).otherwise(F.array().cast("array<string>")),
                F.when(F.col("uniq"), F.array(F.lit("unique"))).otherwise(F.array().cast("array<string>")),
            )
        ).alias("_constraint"),
    ).select(
        *keys, "table_name",
        F.concat_ws(" ", "_constraint", "table_name", "column").alias("index_name"),
        F.lit("create").alias("kind"), F.array("column").alias("columns"), "order_key",
    )
    return (
        indexes.unionByName(constraints).unionByName(drops).unionByName(inline)
        # an index without columns is not registered and replaces nothing
        .filter((F.col("kind") == "drop") | (F.size("columns") > 0))
    )


def index_state(events: DataFrame, keys: tuple[str, ...] = SCOPE) -> DataFrame:
    """Live indexes: the last event of each (table, index) decides."""
    return (
        events.groupBy(*keys, "table_name", "index_name")
        .agg(F.max_by(F.struct("kind", "columns"), "order_key").alias("_last"))
        .filter(F.col("_last.kind") == "create")
        .select(*keys, "table_name", "index_name", "_last.columns")
    )


def column_state(events: DataFrame, keys: tuple[str, ...] = SCOPE) -> DataFrame:
    """Last declared type of each (table, column)."""
    return events.groupBy(*keys, "table_name", "column").agg(F.max_by("type", "order_key").alias("type"))


def table_schema(
    tables: DataFrame, indexes: DataFrame, columns: DataFrame, keys: tuple[str, ...] = SCOPE
) -> DataFrame:
    """``keys, table_name, indexed_columns, column_types``.

    A table exists if any operation named it (``tables(keys, table_name)``).  Arrays
    and maps hold the columns of one table.
    """
    blank = F.lit(None).cast("string")
    rows = (
        tables.select(*keys, "table_name", blank.alias("lead"), blank.alias("column"), blank.alias("type"))
        .unionByName(indexes.select(*keys, "table_name", F.get("columns", F.lit(0)).alias("lead"),
                                    blank.alias("column"), blank.alias("type")))
        .unionByName(columns.select(*keys, "table_name", blank.alias("lead"), "column", "type"))
    )
    return rows.groupBy(*keys, "table_name").agg(
        F.array_sort(F.collect_set("lead")).alias("indexed_columns"),
        F.map_from_entries(
            F.collect_set(F.when(F.col("column").isNotNull(), F.struct("column", "type")))
        ).alias("column_types"),
    )


def named_tables(ops: DataFrame, keys: tuple[str, ...] = SCOPE) -> DataFrame:
    has = lambda c: F.coalesce(c, F.lit("")) != ""
    return (
        ops.filter(
            has("table_name")
            & (
                F.col("op").isin("createTable", "addColumn")
                | ((F.col("op") == "createIndex") & has("index_name"))
                | (F.col("op").isin("addPrimaryKey", "addUniqueConstraint") & has("value"))
            )
        )
        .select(*keys, "table_name")
        .distinct()
    )


def schema_from_changelogs(roots: DataFrame, scan: DataFrame) -> DataFrame:
    """The whole chain for each ``(repo, root)``; unreadable trees give no tables."""
    # The XML is parsed once: scan and operations are each read several times below.
    scan = cut_lineage(scan)
    order = include_order(roots, scan)
    good = loadable_roots(order, scan).filter("loadable").select("repo", "root")
    ops = cut_lineage(ordered_operations(order.join(good, ["repo", "root"], "left_semi"), scan))
    typed = column_events(ops).withColumn("row_id", F.to_json(F.struct("table_name", "order_key")))
    properties = ops.filter("op = 'property'").select(*SCOPE, "name", "value", "order_key")
    columns = substitute_properties(typed, properties)
    return table_schema(named_tables(ops), index_state(index_events(ops)), column_state(columns))


def schema_lookup(asked: DataFrame, schema: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """``asked(keys, table_name, column)`` with folded ``indexed_columns`` and ``column_type``.

    NULL ``indexed_columns``: the table is unknown.  Empty: known, without any index.
    """
    folded = schema.select(
        *keys,
        F.lower("table_name").alias("_table"),
        F.array_sort(F.transform("indexed_columns", F.lower)).alias("indexed_columns"),
        F.col("column_types").alias("_types"),
    )
    joined = asked.withColumn("_table", F.lower("table_name")).join(sorted_joins(folded), [*keys, "_table"], "left")
    typed = F.map_values(F.map_filter("_types", lambda k, v: F.lower(k) == F.lower(F.col("column"))))
    return joined.withColumn("column_type", F.lower(F.get(typed, F.lit(0)))).drop("_table", "_types")


def changelog_touch(changed: DataFrame, tree: DataFrame, reviews: DataFrame, keys: tuple[str, ...] = ("repo", "pr")) -> DataFrame:
    """Adds ``touches`` to ``reviews(keys)``: does a changed path lie in the tree?"""
    hit = (
        changed.join(sorted_joins(tree.select("repo", "path").distinct()), ["repo", "path"], "left_semi")
        .select(*keys).distinct().withColumn("_hit", F.lit(True))
    )
    return reviews.join(sorted_joins(hit), list(keys), "left").withColumn(
        "touches", F.coalesce("_hit", F.lit(False))
    ).drop("_hit")


# --- where is the changelog? -------------------------------------------------------------


def resolve_reference(raw: Column, resource_root: Column) -> Column:
    """Repository path of a declared changelog reference."""
    value = F.replace(unquote(F.regexp_replace(raw, r"\A\s+|\s+\z", "")), F.lit("\\"), F.lit("/"))
    value = F.regexp_replace(F.regexp_replace(value, r"\Aclasspath:", ""), r"\A/+", "")
    direct = (resource_root == "") | F.rlike(value, F.lit(r"\A(?:src|test)/"))
    return normpath(F.when(direct, value).otherwise(join_path(resource_root, value)))


def discover_changelog(configs: DataFrame, repos: DataFrame) -> DataFrame:
    """``repo, status, changelog_path, source_file`` from ``configs(repo, path, content)``."""
    candidates = configs.filter(F.col("path").isin(*CANDIDATE_PATHS))
    yaml = candidates.filter(F.col("path").rlike(r"\.ya?ml$")).select(
        "repo", "path", yaml_changelog(F.col("content")).alias("raw")
    )
    properties = config_entries(
        candidates.filter(F.col("path").endswith(".properties")).select("repo", "path", "content")
    ).filter(F.col("key") == CHANGELOG_KEY).select("repo", "path", F.col("value").alias("raw"))
    paths = F.array(*[F.lit(p) for p in CANDIDATE_PATHS])
    declared = (
        properties.unionByName(yaml)
        .filter(F.col("raw").isNotNull())
        .withColumn("priority", F.array_position(paths, F.col("path")))
        .withColumn("blank", F.regexp_replace("raw", r"\s", "") == "")
        .withColumn("target", F.when(~F.col("blank"), resolve_reference(F.col("raw"), dirname(F.col("path")))))
    )
    judged = declared.groupBy("repo").agg(
        F.min("target").alias("_low"),
        F.max("target").alias("_high"),
        F.min_by("path", F.when(~F.col("blank"), F.col("priority"))).alias("_source"),
        F.min_by("path", F.when(F.col("blank"), F.col("priority"))).alias("_blank"),
    )
    one = F.col("_low") == F.col("_high")
    return repos.select("repo").distinct().join(sorted_joins(judged), "repo", "left").select(
        "repo",
        F.when(one, "discovered")
        .when(F.col("_low").isNotNull(), "ambiguous")
        .when(F.col("_blank").isNotNull(), "invalid")
        .otherwise("not_found").alias("status"),
        F.when(one, F.col("_low")).alias("changelog_path"),
        F.when(one, F.col("_source")).when(F.col("_low").isNull(), F.col("_blank")).alias("source_file"),
    )


def xml_files(files: DataFrame) -> DataFrame:
    """The XML files, each of which may be a root."""
    return files.filter(F.lower("path").endswith(".xml"))


def score_roots(scan: DataFrame) -> DataFrame:
    """``repo, path, confidence``: how root-shaped each changelog file is.

    medium: includes others and is not included, or stands alone with changes of its
    own under a conventional name.  low: everything else.
    """
    flags = scan.groupBy("repo", "path").agg(
        F.bool_or((F.col("op") == "file") & F.coalesce(F.col("name") == ROOT_TAG, F.lit(False))).alias("_is_root"),
        F.bool_or(F.col("op").isin("include", "includeAll")).alias("includes"),
        F.bool_or(F.col("op") == "changeSet").alias("has_changes"),
    ).filter("_is_root")
    valid = scan.join(sorted_joins(flags.select("repo", "path")), ["repo", "path"], "left_semi")
    named = valid.filter((F.col("op") == "include") & (F.coalesce("value", F.lit("")) != "")).select(
        "repo",
        include_target(F.col("path"), F.col("value"), F.col("relative"), F.lit("")).alias("path"),
    ).distinct().withColumn("_referenced", F.lit(True))
    hint = F.lower("path").rlike("|".join(_NAMING_HINTS))
    free = F.col("_referenced").isNull()
    medium = free & (F.col("includes") | (F.col("has_changes") & hint))
    return flags.join(sorted_joins(named), ["repo", "path"], "left").select(
        "repo", "path", F.when(medium, "medium").otherwise("low").alias("confidence")
    )


def pick_root(scored: DataFrame, repos: DataFrame) -> DataFrame:
    """``repo, status, changelog_path``: the only file of the best tier, if it is alone."""
    best = scored.groupBy("repo").agg(
        F.count_if(F.col("confidence") == "medium").alias("_medium"),
        F.count("*").alias("_all"),
        F.min(F.when(F.col("confidence") == "medium", F.col("path"))).alias("_path"),
        F.min("path").alias("_any"),
    )
    n = F.when(F.col("_medium") > 0, F.col("_medium")).otherwise(F.col("_all"))
    return repos.select("repo").distinct().join(sorted_joins(best), "repo", "left").select(
        "repo",
        F.when(n.isNull(), "not_found").when(n == 1, "discovered").otherwise("ambiguous").alias("status"),
        F.when(n == 1, F.coalesce("_path", "_any")).alias("changelog_path"),
    )


def schema_precedence(
    repos: DataFrame,
    explicit: DataFrame,
    touched: DataFrame,
    discovered: DataFrame,
    scored: DataFrame,
    loadable: DataFrame,
) -> DataFrame:
    """Which changelog each review's schema comes from, and at which state.

    In: ``repos(repo, pr)``, ``explicit(repo, root)``, ``touched(repo, pr, touches)``,
    ``discovered``/``scored`` ``(repo, status, changelog_path)``, ``loadable(repo, root,
    state, loadable)`` with state ``base`` or ``head``.  Out: ``source`` is explicit-head,
    explicit-base, config, scoring or unknown.
    """
    repos, explicit, touched, discovered, scored, loadable = map(sorted_joins, (repos, explicit, touched, discovered, scored, loadable))
    ok = loadable.filter("loadable").select("repo", "root", "state")
    at = lambda state, name: ok.filter(F.col("state") == state).select(
        "repo", F.col("root").alias(name), F.lit(True).alias(f"_{name}_{state}")
    )
    joined = (
        repos.join(explicit.select("repo", F.col("root").alias("e")), "repo", "left")
        .join(discovered.select("repo", F.col("status").alias("_ds"), F.col("changelog_path").alias("d")), "repo", "left")
        .join(scored.select("repo", F.col("changelog_path").alias("s")), "repo", "left")
        .join(touched, ["repo", "pr"], "left")
        .join(at("base", "e"), ["repo", "e"], "left")
        .join(at("head", "e"), ["repo", "e"], "left")
        .join(at("head", "d"), ["repo", "d"], "left")
        .join(at("head", "s"), ["repo", "s"], "left")
    )
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    source = (
        F.when(
            F.col("e").isNotNull(),
            F.when(~yes("_e_base"), "unknown")
            .when(yes("touches") & yes("_e_head"), "explicit-head")
            .otherwise("explicit-base"),
        )
        .when(yes("_d_head"), "config")
        .when(F.col("_ds") == "ambiguous", "unknown")
        .when(yes("_s_head"), "scoring")
        .otherwise("unknown")
    )
    return joined.withColumn("source", source).select(
        "repo", "pr", "source",
        F.when(F.col("source").startswith("explicit"), F.col("e"))
        .when(F.col("source") == "config", F.col("d"))
        .when(F.col("source") == "scoring", F.col("s")).alias("root"),
    )
