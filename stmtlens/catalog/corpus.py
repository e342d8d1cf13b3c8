"""SQL-file and rule queries.  Input: files and statements written from ``part``."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stmtlens.catalog.base import fill, pick, spread, sql_values, table
from stmtlens.operators import records as rc
from stmtlens.operators import rules as ru
from stmtlens.operators import statements as st
from stmtlens.sources.corpus import scan_sources

# --- statements: one per part, template p_partkey % len(TEMPLATES) --------------------
# Per template: text, verb, target table, flags (w where, l limit, f fetch, g group,
# u using, j target join, r from), aliases, and the findings to expect.

MISSING = ("missing-where", "missing-where", "CRITICAL")
NOLIMIT = ("no-limit", "no-limit", "HIGH")
STAR = ("select-star", "select-star", "MEDIUM")
UNINDEXED = ("unindexed-filter", "unindexed-filter", "HIGH")
WILD = ("non-sargable", "leading-wildcard", "MEDIUM")
WRAP = ("non-sargable", "wrapped-column", "MEDIUM")
CAST = ("non-sargable", "explicit-cast", "MEDIUM")
COERCE = ("non-sargable", "implicit-cast", "MEDIUM")

_UPD = "UPDATE has no WHERE clause and affects every row"
_DEL = "DELETE has no WHERE clause and affects every row"
_ALL = "SELECT reads an entire table with no row limit"
_STARS = "Query selects every column with `SELECT *`"
_CONV = "Comparison on `{}` requires a type conversion"
_LIKE = "LIKE pattern starts with a wildcard on `{}`"


def _noindex(column, table_name="t{k}"):
    return f"Filter on `{table_name}.{column}`, which has no index"


def _t(text, verb, flags="", aliases=(("t{k}", "t{k}"),), findings=()):
    return {"text": text, "verb": verb, "flags": flags, "aliases": aliases, "findings": findings}


_AB = (("t{k}", "t{k}"), ("other", "other"))

TEMPLATES = [
    _t("UPDATE t{k} SET status = 'x;y'", "UPDATE", findings=[(*MISSING, _UPD)]),
    _t("DELETE FROM t{k}", "DELETE", "r", findings=[(*MISSING, _DEL)]),
    _t("UPDATE t{k} SET status = o.s FROM other o", "UPDATE", "r",
       (*_AB, ("o", "other")), [(*MISSING, _UPD)]),
    _t("delete from t{k} -- where id = 1", "DELETE", "r", findings=[(*MISSING, _DEL)]),
    _t("DELETE FROM t{k} USING other WHERE t{k}.id = other.id", "DELETE", "wur", _AB),
    _t("DELETE FROM t{k} USING other", "DELETE", "ur", _AB),
    _t("UPDATE t{k} JOIN other ON t{k}.id = other.id SET t{k}.status = 1", "UPDATE", "j", _AB),
    _t("DELETE FROM t{k} LIMIT 5", "DELETE", "lr"),
    _t("UPDATE t{k} SET status = 'WHERE' WHERE id = {k}", "UPDATE", "w"),
    _t("SELECT id, country FROM t{k}", "SELECT", "r", findings=[(*NOLIMIT, _ALL)]),
    _t("SELECT country, COUNT(*) AS n FROM t{k} GROUP BY country", "SELECT", "gr",
       findings=[(*NOLIMIT, _ALL)]),
    _t("SELECT t{k}.id FROM t{k} LEFT JOIN other o ON o.id = t{k}.id AND o.kind = :kind",
       "SELECT", "r", (*_AB, ("o", "other")), [(*NOLIMIT, _ALL)]),
    _t("SELECT t{k}.id FROM t{k} JOIN other o ON o.id = t{k}.id", "SELECT", "r",
       (*_AB, ("o", "other")), [(*NOLIMIT, _ALL)]),
    _t("SELECT t{k}.id FROM t{k} INNER JOIN other o ON o.id = t{k}.id AND o.kind = ?",
       "SELECT", "r", (*_AB, ("o", "other"))),
    _t("SELECT COUNT(*), SUM(amount) AS total, MAX(id) top_id FROM t{k}", "SELECT", "r"),
    _t("SELECT id FROM t{k} LIMIT 10", "SELECT", "lr"),
    _t("SELECT id FROM t{k} ORDER BY id FETCH FIRST 10 ROWS ONLY", "SELECT", "fr"),
    _t("SELECT (SELECT MAX(id) FROM t{k})", "SELECT", ""),
    _t("SELECT id FROM t{k} UNION ALL SELECT id FROM other", "SET OPERATION", "", _AB),
    _t("SELECT * FROM t{k} c WHERE c.id = 5", "SELECT", "wr",
       (("t{k}", "t{k}"), ("c", "t{k}")), [(*STAR, _STARS)]),
    _t("SELECT c.* FROM t{k} AS c WHERE c.id IN (1, 2)", "SELECT", "wr",
       (("t{k}", "t{k}"), ("c", "t{k}")), [(*STAR, _STARS)]),
    _t("WITH recent AS (SELECT * FROM t{k}) SELECT id FROM recent WHERE id > 7", "SELECT", "wr",
       (("t{k}", "t{k}"), ("recent", "recent")), [(*STAR, _STARS)]),
    _t("SELECT COUNT(*) FROM t{k} WHERE id = 3", "SELECT", "wr"),
    _t("SELECT price * qty FROM t{k} WHERE id = 3", "SELECT", "wr"),
    _t("SELECT 'a * b', \"*\" FROM t{k} WHERE id = 3", "SELECT", "wr"),
    _t("SELECT id FROM t{k} WHERE country = 'NO'", "SELECT", "wr",
       findings=[(*UNINDEXED, _noindex("country"))]),
    _t("SELECT id FROM t{k} x WHERE x.Status NOT IN ('a', 'b') AND 9 < x.amount", "SELECT", "wr",
       (("t{k}", "t{k}"), ("x", "t{k}")),
       [(*UNINDEXED, _noindex("Status")), (*UNINDEXED, _noindex("amount"))]),
    _t("SELECT id FROM t{k} WHERE amount BETWEEN 1 AND 9 AND amount > 2 OR (id) = 3", "SELECT",
       "wr", findings=[(*UNINDEXED, _noindex("amount"))]),
    _t("SELECT t{k}.id FROM t{k}, other WHERE other.kind = 3 AND status = 'q'", "SELECT", "wr",
       _AB),
    _t("SELECT id FROM t{k} WHERE amount + 1 = 2 AND id = ANY (:ids)", "SELECT", "wr"),
    _t("SELECT id FROM t{k} WHERE full_name LIKE '%son' AND id < 9", "SELECT", "wr",
       findings=[(*WILD, _LIKE.format("full_name"))]),
    _t("SELECT id FROM t{k} z WHERE z.email NOT ILIKE '%x' OR z.email LIKE 'x%'", "SELECT", "wr",
       (("t{k}", "t{k}"), ("z", "t{k}")), [(*WILD, _LIKE.format("z.email"))]),
    _t("SELECT id FROM t{k} WHERE full_name LIKE 'son%' OR full_name LIKE :p", "SELECT", "wr"),
    _t("SELECT id FROM t{k} WHERE LOWER(email) = 'q' AND lower(email) = 'z'", "SELECT", "wr",
       findings=[(*WRAP, "Filtered column is wrapped in `LOWER(...)`")]),
    _t("SELECT id FROM t{k} WHERE COALESCE(TRIM(email), '') IN ('q') AND id = ABS(-3)", "SELECT",
       "wr", findings=[(*WRAP, "Filtered column is wrapped in `COALESCE(...)`")]),
    _t("SELECT id FROM t{k} WHERE id = LENGTH('abc')", "SELECT", "wr"),
    _t("SELECT id FROM t{k} q WHERE CAST(q.id AS TEXT) = '5'", "SELECT", "wr",
       (("t{k}", "t{k}"), ("q", "t{k}")), [(*CAST, _CONV.format("q.id"))]),
    _t("SELECT id FROM t{k} WHERE id::varchar(9) = '5' AND '6' <> id::text", "SELECT", "wr",
       findings=[(*CAST, _CONV.format("id")), (*CAST, _CONV.format("id"))]),
    _t("SELECT id FROM t{k} WHERE id = CAST('5' AS bigint)", "SELECT", "wr"),
    _t("SELECT id FROM t{k} WHERE email = 5 OR 6 <> t{k}.email", "SELECT", "wr",
       findings=[(*COERCE, _CONV.format("email")), (*COERCE, _CONV.format("t{k}.email")),
                 (*UNINDEXED, _noindex("email"))]),
    _t("SELECT id FROM t{k} WHERE amount = 5 OR email = '5' OR email > 5", "SELECT", "wr",
       findings=[(*UNINDEXED, _noindex("amount")), (*UNINDEXED, _noindex("email"))]),
    _t("SELECT id FROM t{k} WHERE EXISTS (SELECT 1 FROM other o WHERE o.kind = t{k}.country)",
       "SELECT", "wr", (*_AB, ("o", "other")), [(*UNINDEXED, _noindex("country"))]),
    _t("INSERT INTO t{k} (id, email) SELECT id, email FROM other WHERE kind = 2", "INSERT", "",
       _AB),
    _t("SELECT id FROM srv.db.dbo.t{k} w WHERE srv.db.dbo.t{k}.country = 'x'", "SELECT", "wr",
       (("t{k}", "t{k}"), ("w", "t{k}")), [(*UNINDEXED, _noindex("country"))]),
    _t("SELECT id FROM t{k} WHERE a.b.c.id::text = 'x' AND a.b.id::text = 'y'", "SELECT", "wr",
       findings=[(*CAST, _CONV.format("a.b.c.id")), (*CAST, _CONV.format("a.b.id"))]),
    _t("SELECT id FROM t{k} WHERE country = 'x' FOR UPDATE SKIP LOCKED", "SELECT", "wr",
       findings=[(*UNINDEXED, _noindex("country"))]),
    _t("SELECT id FROM t{k} WHERE country = 'x' FOR UPDATE NOWAIT", "SELECT", "wr",
       findings=[(*UNINDEXED, _noindex("country"))]),
    _t("SELECT id FROM t{k} WHERE id > DATE_SUB(NOW(), INTERVAL 1 DAY) AND id < date_trunc('day', DATE '2020-01-01')",
       "SELECT", "wr"),
    _t("SELECT id FROM t{k} WHERE id > MAKE_INTERVAL(days => 3)", "SELECT", "wr"),
    _t("SELECT t{k}.id FROM t{k} JOIN other o ON o.d >= DATE '2020-01-01'", "SELECT", "r",
       (*_AB, ("o", "other"))),
    _t("SELECT id FROM t{k} WHERE LOWER(a.b.c.email) = 'q' AND id >= TIMESTAMP '2020-01-01 00:00:00'", "SELECT", "wr",
       findings=[(*WRAP, "Filtered column is wrapped in `LOWER(...)`")]),
]
N = len(TEMPLATES)
# Columns the schema table declares for t{k}; `id` is always indexed, `country` for
# every second block of N parts.  `other` is unknown to the schema.


def query_corpus(spark: SparkSession, folder: str) -> DataFrame:
    p = spread(table(spark, folder, "part").select("p_partkey"), "p_partkey")
    k = F.col("p_partkey")
    return p.select(
        k.alias("qid"),
        fill(pick(k, [t["text"] for t in TEMPLATES]), k=k).alias("text"),
        F.lit("postgres").alias("dialect"),
        F.lit("raw_sql").alias("kind"),
    )


def corpus_schema(spark: SparkSession, folder: str) -> DataFrame:
    p = table(spark, folder, "part").select("p_partkey")
    k = F.col("p_partkey")
    return p.select(
        F.concat(F.lit("T"), k.cast("string")).alias("table_name"),
        F.when(F.floor(k / N) % 2 == 0, F.array(F.lit("id"), F.lit("Country")))
        .otherwise(F.array(F.lit("id"))).alias("indexed_columns"),
        F.create_map(
            F.lit("ID"), F.lit("bigint"), F.lit("Email"), F.lit("VARCHAR(80)"),
            F.lit("amount"), F.lit("numeric"), F.lit("country"), F.lit("TEXT"),
        ).alias("column_types"),
    )


def _tables(spark, folder, schema=False):
    return ru.audit_tables(
        query_corpus(spark, folder), corpus_schema(spark, folder) if schema else None
    )


_EXPECTED_FINDINGS = sql_values(
    [
        (n, rule, check, severity, title)
        for n, t in enumerate(TEMPLATES)
        for rule, check, severity, title in t["findings"]
    ],
    "t, rule_id, check_name, severity, title",
)


def _rule_query(rule, schema=False):
    def run(spark, folder):
        return rule(_tables(spark, folder, schema)).select(
            "qid", "rule_id", "severity", "title"
        )

    return run


def _rule_oracle(check):
    return f"""
SELECT p_partkey AS qid, rule_id, severity, replace(title, '{{k}}', CAST(p_partkey AS VARCHAR)) AS title
FROM part JOIN {_EXPECTED_FINDINGS} ON p_partkey % {N} = t
WHERE check_name = '{check}'
  AND NOT (check_name = 'unindexed-filter' AND title LIKE '%.country`%' AND (p_partkey // {N}) % 2 = 0)
"""


def clause_facts(spark, folder):
    return _tables(spark, folder).records.select(
        "qid", "verb", "has_where", "has_limit", "has_fetch", "has_group", "has_using",
        "has_target_join", "has_from", "is_set_operation",
    )


_FACTS = sql_values(
    [
        (n, t["verb"], *[f in t["flags"] for f in "wlfgujr"], t["verb"] == "SET OPERATION")
        for n, t in enumerate(TEMPLATES)
    ],
    "t, verb, has_where, has_limit, has_fetch, has_group, has_using, has_target_join, has_from, is_set_operation",
)


def aliases(spark, folder):
    return rc.table_aliases(_tables(spark, folder).records)


_ALIASES = sql_values(
    [(n, a, b) for n, t in enumerate(TEMPLATES) for a, b in t["aliases"]], "t, alias, table_name"
)


def resolve(spark, folder):
    """Each statement asks for `id`, `t{k}.id` and `zz.id`: which table is it?"""
    asked = F.array(F.lit(None).cast("string"), F.concat(F.lit("T"), F.col("qid").cast("string")), F.lit("zz"))
    rows = F.transform(asked, lambda q: F.struct(q.alias("qualifier"), rc.table_of(q).alias("table_name")))
    return _tables(spark, folder).records.select("qid", F.explode(rows).alias("_r")).select("qid", "_r.*")


_ONE_TABLE = sql_values(
    [(n, len({b for _, b in t["aliases"]}) == 1) for n, t in enumerate(TEMPLATES)], "t, single"
)


def sql_tokens(spark, folder):
    return st.sql_tokens(query_corpus(spark, folder)).groupBy("qid").agg(
        F.count("*").alias("n_tokens"),
        F.max("depth").alias("deepest"),
        F.count_if(F.col("kind") == "string").alias("n_strings"),
        F.count_if(F.col("kind") == "number").alias("n_numbers"),
    )


def _token_facts(text):
    """(tokens, deepest bracket, strings, numbers) of a template, by a lexer of its own for what templates hold."""
    text = re.sub(r"--[^\n]*", " ", text.replace("{k}", "1"))
    found = re.findall(r"'(?:[^']|'')*'|\"[^\"]*\"|:\w+|[A-Za-z_]\w*|\d+|<>|::|=>|>=|<=|\S", text)
    # A colon pair is no parameter: `id::text`.
    depth = deepest = 0
    for token in found:
        depth -= token == ")"
        deepest = max(deepest, depth)
        depth += token == "("
    return len(found), deepest, sum(t[0] == "'" for t in found), sum(t.isdigit() for t in found)


_TOKENS = sql_values(
    [(n, *_token_facts(t["text"].replace("::", " :: "))) for n, t in enumerate(TEMPLATES)],
    "t, n_tokens, deepest, n_strings, n_numbers",
)


def mark_inferred(spark, folder):
    """Statements of odd parts are read as derived methods; every third has a confidence."""
    q = query_corpus(spark, folder).withColumn(
        "kind", F.when(F.col("qid") % 2 == 1, ru.DERIVED_KIND).otherwise("raw_sql")
    )
    found = ru.rule_no_limit(ru.audit_tables(q)).join(q.select("qid", "kind"), "qid")
    return ru.mark_inferred(
        found.withColumn("confidence", F.when(F.col("qid") % 3 == 0, F.lit(0.9)))
        .withColumn("confidence_basis", F.when(F.col("qid") % 3 == 0, F.lit("given")))
    ).select("qid", "kind", "confidence", "confidence_basis")


# --- files: one per part --------------------------------------------------------------
# Template p_partkey % 12: content, then (ordinal, line, text) of each statement.

FILES = [
    ("SELECT 1;", [(1, "SELECT 1")]),
    ("SELECT 'a;b' AS x;\nSELECT {k};", [(1, "SELECT 'a;b' AS x"), (2, "SELECT {k}")]),
    ("-- only a note; here\n;\n;;\nSELECT {k} -- tail\n;", [(4, "SELECT {k} -- tail")]),
    ("﻿\nUPDATE t\nSET a = 1;\n\n  DELETE FROM t", [(2, "UPDATE t\nSET a = 1"), (5, "DELETE FROM t")]),
    ("CREATE FUNCTION f() AS $$ BEGIN; END; $$;\n/* x;\ny */ SELECT f();",
     [(1, "CREATE FUNCTION f() AS $$ BEGIN; END; $$"), (3, "SELECT f()")]),
    ("   \n \t", []),
    ("SELECT \"a;b\", 'it''s; {k}' FROM t; -- end", [(1, "SELECT \"a;b\", 'it''s; {k}' FROM t")]),
    ("SELECT 'open {k};\nSELECT 2;", None),
    ("SELECT (1;\nSELECT 2);", None),
    ("/* c1 */\n-- c2\nSELECT a\n  FROM t\n;SELECT b;SELECT {k};",
     [(3, "SELECT a\n  FROM t"), (5, "SELECT b"), (5, "SELECT {k}")]),
    ("SELECT $t$;{k}$t$, $1;\n\n\nSELECT 3", [(1, "SELECT $t$;{k}$t$, $1"), (4, "SELECT 3")]),
    ("SELECT 1 /* never closed; {k}", None),
]
_PATHS = ["db/m{k}.sql", "db/M{k}.SQL", "src/A{k}.java", "db/m{k}.sql.bak", "README{k}.md", "db/sql"]


def sql_sources(spark: SparkSession, folder: str) -> DataFrame:
    p = spread(table(spark, folder, "part").select("p_partkey", "p_brand"), "p_partkey")
    k = F.col("p_partkey")
    return p.select(
        F.col("p_brand").alias("repo"),
        F.concat(F.lit("db/m"), k.cast("string"), F.lit(".sql")).alias("path"),
        fill(pick(k, [c for c, _ in FILES]), k=k).alias("content"),
        F.lit("postgres").alias("dialect"),
    )


def source_scan(spark, folder):
    p = table(spark, folder, "part").select("p_partkey")
    k = F.col("p_partkey")
    files = p.select(
        fill(pick(k, _PATHS), k=k).alias("path"), F.concat(F.lit("-- "), k.cast("string")).alias("content")
    )
    return scan_sources(files)


_split = lambda spark, folder: st.split_statements(sql_sources(spark, folder), ("repo", "path"))


def statement_split(spark, folder):
    return _split(spark, folder).filter("parse_error is null").select(
        "repo", "path", "ordinal", "line", "text"
    )


def unanalyzable(spark, folder):
    return _split(spark, folder).filter("parse_error is not null").select("repo", "path", "id", "line", "text")


def query_ids(spark, folder):
    return _split(spark, folder).select("repo", "id")


_GOOD = sql_values(
    [
        (n, o, line, text)
        for n, (_, stmts) in enumerate(FILES)
        for o, (line, text) in enumerate(stmts or [], 1)
    ],
    "t, ordinal, line, text",
)
_BAD = sql_values([(n, content.strip()) for n, (content, stmts) in enumerate(FILES) if stmts is None], "t, text")
_FILE_ROWS = f"""
WITH good AS (
  SELECT p_brand AS repo, 'db/m' || p_partkey || '.sql' AS path, ordinal, line,
         replace(text, '{{k}}', CAST(p_partkey AS VARCHAR)) AS text
  FROM part JOIN {_GOOD} ON p_partkey % {len(FILES)} = t
), bad AS (
  SELECT p_brand AS repo, 'db/m' || p_partkey || '.sql' AS path, 1 AS ordinal, 1 AS line,
         replace(text, '{{k}}', CAST(p_partkey AS VARCHAR)) AS text
  FROM part JOIN {_BAD} ON p_partkey % {len(FILES)} = t
)
"""

QUERIES = {
    "source_scan": source_scan,
    "sql_tokens": sql_tokens,
    "statement_split": statement_split,
    "unanalyzable": unanalyzable,
    "query_ids": query_ids,
    "clause_facts": clause_facts,
    "table_aliases": aliases,
    "resolve_table": resolve,
    "rule_missing_where": _rule_query(ru.rule_missing_where),
    "rule_no_limit": _rule_query(ru.rule_no_limit),
    "rule_select_star": _rule_query(ru.rule_select_star),
    "rule_unindexed_filter": _rule_query(ru.rule_unindexed_filter, True),
    "rule_leading_wildcard": _rule_query(ru.rule_leading_wildcard),
    "rule_wrapped_column": _rule_query(ru.rule_wrapped_column),
    "rule_explicit_cast": _rule_query(ru.rule_explicit_cast),
    "rule_implicit_cast": _rule_query(ru.rule_implicit_cast, True),
    "mark_inferred": mark_inferred,
}

ORACLES = {
    "sql_tokens": f"""
SELECT p_partkey AS qid, n_tokens, deepest, n_strings, n_numbers FROM part JOIN {_TOKENS} ON p_partkey % {N} = t""",
    "source_scan": """
SELECT CASE p_partkey % 6 WHEN 0 THEN 'db/m' || p_partkey || '.sql' WHEN 1 THEN 'db/M' || p_partkey || '.SQL'
            ELSE 'src/A' || p_partkey || '.java' END AS path,
       '-- ' || p_partkey AS content,
       CASE WHEN p_partkey % 6 = 2 THEN '.java' ELSE '.sql' END AS language
FROM part WHERE p_partkey % 6 < 3""",
    "statement_split": _FILE_ROWS + "SELECT repo, path, ordinal, line, text FROM good",
    "unanalyzable": _FILE_ROWS + "SELECT repo, path, path || ':1' AS id, line, text FROM bad",
    "query_ids": _FILE_ROWS
    + "SELECT repo, path || ':' || ordinal AS id FROM good UNION ALL SELECT repo, path || ':1' FROM bad",
    "clause_facts": f"""
SELECT p_partkey AS qid, x.* EXCLUDE (t) FROM part JOIN {_FACTS} ON p_partkey % {N} = t""",
    "table_aliases": f"""
SELECT p_partkey AS qid, replace(alias, '{{k}}', CAST(p_partkey AS VARCHAR)) AS alias,
       replace(table_name, '{{k}}', CAST(p_partkey AS VARCHAR)) AS table_name
FROM part JOIN {_ALIASES} ON p_partkey % {N} = t""",
    "resolve_table": f"""
SELECT p_partkey AS qid, NULL AS qualifier,
       CASE WHEN single THEN 't' || p_partkey END AS table_name
FROM part JOIN {_ONE_TABLE} ON p_partkey % {N} = t
UNION ALL SELECT p_partkey, 'T' || p_partkey, 't' || p_partkey FROM part
UNION ALL SELECT p_partkey, 'zz', NULL FROM part""",
    **{
        f"rule_{c.replace('-', '_')}": _rule_oracle(c)
        for c in ("missing-where", "no-limit", "select-star", "unindexed-filter",
                  "leading-wildcard", "wrapped-column", "explicit-cast", "implicit-cast")
    },
    "mark_inferred": f"""
SELECT p_partkey AS qid, CASE WHEN p_partkey % 2 = 1 THEN 'spring_data_derived' ELSE 'raw_sql' END AS kind,
       CASE WHEN p_partkey % 3 = 0 THEN 0.9 WHEN p_partkey % 2 = 1 THEN 0.5 END AS confidence,
       CASE WHEN p_partkey % 3 = 0 THEN 'given' WHEN p_partkey % 2 = 1 THEN '{ru.INFERRED_BASIS.replace("'", "''")}' END
         AS confidence_basis
FROM part JOIN {_EXPECTED_FINDINGS} ON p_partkey % {N} = t WHERE check_name = 'no-limit'""",
}
