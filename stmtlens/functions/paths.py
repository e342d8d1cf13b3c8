"""Path, glob and small text functions on Columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stmtlens.session import sorted_joins


def dirname(path: Column) -> Column:
    """Everything before the last slash ('' without one)."""
    return F.regexp_replace(F.regexp_extract(path, r"\A([\s\S]*)/[^/]*\z", 1), r"(?<=.)/+\z", "")


def join_path(base: Column, name: Column) -> Column:
    return (
        F.when(name.startswith("/") | (base == ""), name)
        .when(base.endswith("/"), F.concat(base, name))
        .otherwise(F.concat(base, F.lit("/"), name))
    )


def normpath(path: Column) -> Column:
    """POSIX normal form: no empty or ``.`` parts, ``..`` resolved where possible."""
    # Bound as a variable, so that the text is worked out once; a path without such parts stays as it is.
    bent = F.lit(r"(?:\A|/)\.{0,2}(?:/|\z)")
    return F.get(F.transform(F.array(path), lambda p: F.when(F.rlike(p, bent), _resolved(p)).otherwise(p)), F.lit(0))


def _resolved(path: Column) -> Column:
    absolute = path.startswith("/")
    parts = F.filter(F.split(path, "/"), lambda p: ~p.isin("", "."))

    def step(stack, part):
        up = (part == "..") & (F.size(stack) > 0) & (F.coalesce(F.get(stack, F.size(stack) - 1), F.lit("")) != "..")
        return (
            F.when(up, F.slice(stack, F.lit(1), F.greatest(F.size(stack) - 1, F.lit(0))))
            .when((part == "..") & absolute, stack)
            .otherwise(F.array_append(stack, part))
        )

    empty = F.array().cast("array<string>")
    body = F.array_join(F.aggregate(parts, empty, step), "/")
    rooted = F.concat(F.when(absolute, "/").otherwise(""), body)
    return F.when(rooted == "", ".").otherwise(rooted)


def unquote(value: Column) -> Column:
    """Strip one matching pair of quotes."""
    return F.regexp_replace(value, r"""\A(?:"([\s\S]*)"|'([\s\S]*)')\z""", "$1$2")


def strip(value: Column) -> Column:
    return F.regexp_replace(value, r"\A\s+|\s+\z", "")


def glob_to_regex(pattern: Column) -> Column:
    """``**`` crosses directories, ``*`` and ``?`` do not; a leading slash is dropped."""
    pieces = F.regexp_extract_all(
        F.regexp_replace(pattern, r"\A/+", ""), F.lit(r"\*\*/|\*\*|\*|\?|[^*?]+"), F.lit(0)
    )
    translated = F.transform(
        pieces,
        lambda p: F.when(p == "**/", r"(?:.*/)?")
        .when(p == "**", ".*")
        .when(p == "*", "[^/]*")
        .when(p == "?", "[^/]")
        .otherwise(F.regexp_replace(p, r"([^A-Za-z0-9_/])", r"\\$1")),
    )
    return F.concat(F.lit(r"\A"), F.array_join(translated, ""), F.lit(r"\z"))


def split_ignored(
    sources: DataFrame, patterns: DataFrame, keys: tuple[str, ...] = ("repo",)
) -> DataFrame:
    """Adds ``ignored`` by the repository's ``patterns(keys, pattern)``.

    The patterns of a repository fold to one alternation, so the join is an equi join
    on the repository and adds no rows.
    """
    rules = patterns.groupBy(*keys).agg(
        F.array_join(F.collect_set(glob_to_regex(F.col("pattern"))), "|").alias("_regex")
    )
    return (
        sources.join(sorted_joins(rules), list(keys), "left")
        .withColumn("ignored", F.coalesce(F.rlike("path", F.col("_regex")), F.lit(False)))
        .drop("_regex")
    )


# Credential shapes.
TOKEN_PATTERN = (
    r"gh[pousr]_[A-Za-z0-9]{16,}|github_pat_[A-Za-z0-9_]{20,}|gsk_[A-Za-z0-9]{20,}"
)


def redact(text: Column) -> Column:
    return F.regexp_replace(text, TOKEN_PATTERN, "<redacted>")
