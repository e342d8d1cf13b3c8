"""Application configuration files: properties lines and the one YAML key we need."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stmtlens.functions.paths import strip, unquote
from stmtlens.session import sorted_joins

#: The changelog key and where configuration is looked for, in order.
CHANGELOG_KEY = "db.liquibase.change-log"
CANDIDATE_PATHS = (
    "src/main/resources/application.properties",
    "src/main/resources/application.yml",
    "src/main/resources/application.yaml",
    "application.properties",
    "application.yml",
    "application.yaml",
)
_LINE_BREAK = r"\r\n|\n|\r"


def config_lines(files: DataFrame, content: str = "content") -> DataFrame:
    """All lines with ``line_no`` (0-based)."""
    keys = [c for c in files.columns if c != content]
    return files.select(*keys, F.posexplode(F.split(content, _LINE_BREAK)).alias("line_no", "raw"))


def config_entries(files: DataFrame, content: str = "content") -> DataFrame:
    """``key, value`` of properties files; the last entry of a key wins."""
    keys = [c for c in files.columns if c != content]
    line = strip(F.col("raw"))
    pattern = r"\A([^=:]*)[=:]([\s\S]*)\z"
    rows = (
        config_lines(files, content)
        .withColumn("_line", line)
        .filter(~F.rlike("_line", F.lit(r"\A(?:[#!]|\z)")) & F.rlike("_line", F.lit(pattern)))
        .select(
            *keys,
            "line_no",
            strip(F.regexp_extract("_line", pattern, 1)).alias("key"),
            unquote(strip(F.regexp_extract("_line", pattern, 2))).alias("value"),
        )
        .filter("key <> ''")
    )
    return rows.groupBy(*keys, "key").agg(F.max_by("value", "line_no").alias("value"))


def yaml_changelog(content: Column) -> Column:
    """Value of the changelog key in the nested or the dotted YAML form, else NULL.

    A fold over the lines whose state is the stack of enclosing keys, as deep as the
    nesting.  List items are skipped.
    """
    # Drop a comment: `#` at the start or after white space, outside quotes.
    code = r"""\A((?:'[^']*+(?:'|\z)|"[^"]*+(?:"|\z)|(?<=\S)\#|[^'"\#])*+)"""
    start = F.expr(
        "named_struct('stack', cast(array() as array<struct<depth:int,key:string>>), "
        "'found', cast(null as string))"
    )

    def step(acc, raw):
        line = F.regexp_extract(raw, code, 1)
        body = strip(line)
        indent = F.length(line) - F.length(F.ltrim(line))
        key = unquote(strip(F.regexp_extract(body, r"\A([^:]*):", 1)))
        value = unquote(strip(F.regexp_extract(body, r"\A[^:]*:([\s\S]*)\z", 1)))
        skip = (body == "") | body.startswith("- ") | ~body.contains(":") | acc["found"].isNotNull()
        stack = F.array_append(
            F.filter(acc["stack"], lambda e: e["depth"] < indent),
            F.struct(indent.alias("depth"), key.alias("key")),
        )
        path = F.array_join(F.transform(stack, lambda e: e["key"]), "\u0001")
        hit = (value != "") & (
            (path == "db\u0001liquibase\u0001change-log") | (key == CHANGELOG_KEY)
        )
        return F.when(skip, acc).otherwise(
            F.struct(stack.alias("stack"), F.when(hit, value).alias("found"))
        )

    return F.aggregate(F.split(content, _LINE_BREAK), start, step, lambda acc: acc["found"])


# --- SQL dialect -----------------------------------------------------------------------

# JDBC protocol to dialect.  In-memory databases say nothing.
JDBC_DIALECTS = [
    ("mysql", "mysql"),
    ("mariadb", "mysql"),
    ("postgresql", "postgres"),
    ("oracle", "oracle"),
    ("sqlserver", "tsql"),
]
_CONFIG_FILES = [
    f"{name}.{ext}" for name in ("application", "bootstrap") for ext in ("properties", "yml", "yaml")
]


def config_candidates(changed_paths: DataFrame, repos: DataFrame, keys: tuple[str, ...] = ("repo",)) -> DataFrame:
    """``keys, path, priority``: root locations first, then those of changed modules."""
    root = list(CANDIDATE_PATHS)
    root += [f"src/main/resources/bootstrap.{e}" for e in ("properties", "yml", "yaml")]
    root += [f"bootstrap.{e}" for e in ("properties", "yml", "yaml")]
    fixed = repos.select(*keys).distinct().select(
        *keys, F.posexplode(F.array(*[F.lit(p) for p in root])).alias("_i", "path")
    ).select(*keys, "path", F.struct(F.lit("").alias("module"), F.col("_i").alias("i")).alias("priority"))
    modules = (
        changed_paths.filter(F.col("path").contains("/src/") & ~F.col("path").startswith("src/"))
        .select(*keys, F.regexp_extract("path", r"\A(.*?)/src/", 1).alias("module"))
        .distinct()
    )
    inside = modules.select(
        *keys, "module", F.posexplode(F.array(*[F.lit(p) for p in _CONFIG_FILES])).alias("_i", "_f")
    ).select(
        *keys,
        F.concat("module", F.lit("/src/main/resources/"), "_f").alias("path"),
        F.struct("module", F.col("_i").alias("i")).alias("priority"),
    )
    # A module named '' cannot occur, so root candidates sort first.
    return fixed.unionByName(inside).groupBy(*keys, "path").agg(F.min("priority").alias("priority"))


def detect_dialect(
    configs: DataFrame, candidates: DataFrame, keys: tuple[str, ...] = ("repo",)
) -> DataFrame:
    """``keys, run_dialect``: the first recognised JDBC protocol in candidate order."""
    ranked = configs.join(sorted_joins(candidates), [*keys, "path"])
    protocol = F.lower(F.regexp_extract(F.col("_line"), r"(?i)jdbc:([a-z0-9]+):", 1))
    known = F.create_map(*[F.lit(x) for pair in JDBC_DIALECTS for x in pair])
    lines = (
        config_lines(ranked.select(*keys, "path", "priority", "content"))
        .withColumn("_line", strip(F.col("raw")))
        .filter(~F.rlike("_line", F.lit(r"\A(?:[#!]|//)")))
        .withColumn("run_dialect", F.get(F.map_values(F.map_filter(known, lambda k, v: k == protocol)), F.lit(0)))
        .filter(F.col("run_dialect").isNotNull())
    )
    return lines.groupBy(*keys).agg(
        F.min_by("run_dialect", F.struct("priority", "line_no")).alias("run_dialect")
    )


def review_dialects(files: DataFrame, changed: DataFrame, heads: DataFrame) -> DataFrame:
    """``repo, pr, run_dialect``: the dialect that the configuration at each review's head names.

    ``files(repo, path, content)`` are the repositories at their base, ``changed(repo, pr, path)`` and
    ``heads(repo, pr, path, content)`` the changes.  Each version of a configuration file is read once
    for the first protocol it names; a review then picks among its candidates by numbers and names only.
    """
    named = F.regexp_extract("path", r"([^/]*)\z", 1).isin(*_CONFIG_FILES)
    none = F.lit(None).cast(changed.schema["pr"].dataType)
    base = files.filter(named).select("repo", none.alias("pr"), F.lit(False).alias("at_head"), "path", "content")
    own = heads.filter(named).select("repo", "pr", F.lit(True).alias("at_head"), "path", "content")
    versions = base.unionByName(own).withColumn("file", F.to_json(F.struct("repo", "pr", "at_head", "path")))
    alone = versions.select("file", "path", F.struct(F.lit("").alias("module"), F.lit(0).alias("i")).alias("priority"))
    read = detect_dialect(versions.select("file", "path", "content"), alone, ("file",))
    known = versions.select("file", "repo", "pr", "at_head", "path").join(sorted_joins(read), "file").drop("file")
    keys = ("repo", "pr")
    asked = config_candidates(changed, changed, keys).join(
        sorted_joins(changed.select(*keys, "path", F.lit(True).alias("_touched")).distinct()), [*keys, "path"], "left"
    )
    kept = asked.filter(F.col("_touched").isNull()).join(sorted_joins(known.filter(~F.col("at_head")).select("repo", "path", "run_dialect")), ["repo", "path"])
    fresh = asked.filter(F.col("_touched").isNotNull()).join(sorted_joins(known.filter("at_head").select(*keys, "path", "run_dialect")), [*keys, "path"])
    columns = [*keys, "priority", "run_dialect"]
    return kept.select(*columns).unionByName(fresh.select(*columns)).groupBy(*keys).agg(
        F.min_by("run_dialect", "priority").alias("run_dialect")
    )
