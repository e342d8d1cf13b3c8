"""The rule families, as expressions over one record per statement.

Each ``rule_*`` function takes :class:`AuditTables` and returns finding rows:
``qid, rule_id, check, seq, severity, title, explanation, suggestion, suggestion_sql``.
Rows with a parse error and opaque commands never reach the tables.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stmtlens.functions import lexing as lx
from stmtlens.operators import records
from stmtlens.operators import statements as st
from stmtlens.session import sorted_joins

SEVERITIES = ("CRITICAL", "HIGH", "MEDIUM", "LOW", "INFO")

DERIVED_KIND = "spring_data_derived"
INFERRED_CONFIDENCE = 0.5
INFERRED_BASIS = (
    "the SQL shown is rendered from the repository method's name, and "
    "Spring Data may issue a different statement (a join, for example)"
)

#: Columns that tell whose schema a statement is judged by, where queries and schema have them.
SCHEMA_SCOPE = ("repo", "rev")

_FINDING_TYPE = (
    "struct<rule_id:string,check:string,seq:bigint,severity:string,title:string,explanation:string,"
    "suggestion:string,suggestion_sql:string>"
)
FINDING_COLUMNS = [
    "qid", "rule_id", "check", "seq", "severity", "title", "explanation", "suggestion",
    "suggestion_sql",
]


@dataclass(frozen=True)
class AuditTables:
    """What all rules read: a record of each statement (``records.statement_records``), and the schema."""

    records: DataFrame
    schema: DataFrame | None = None


def audit_tables(queries: DataFrame, schema: DataFrame | None = None) -> AuditTables:
    """The records of ``queries(qid, text, dialect, kind[, repo][, rev][, parse_error])``.

    Nothing is computed here, and nothing is kept: a rule is a filter of the records, and all rules
    together are one pass over them.
    """
    opaque = F.upper(F.regexp_extract(F.ltrim("text"), r"\A\s*([A-Za-z]+)", 1)).isin(
        lx.OPAQUE_VERBS
    )
    usable = queries.filter(~opaque & lx.sql_well_formed(F.col("text"), F.col("dialect")))
    if "parse_error" in queries.columns:
        usable = usable.filter(F.col("parse_error").isNull())
    carry = ("kind", *(c for c in SCHEMA_SCOPE if c in queries.columns))
    return AuditTables(records=records.statement_records(usable, carry=carry), schema=schema)


def _finding(rule_id: str, severity: str, check: str | None = None, *, title: Column, explanation: Column,
             suggestion: str | Column, suggestion_sql: Column | None = None, seq: Column | None = None) -> Column:
    return F.struct(
        F.lit(rule_id).alias("rule_id"),
        F.lit(check or rule_id).alias("check"),
        (seq if seq is not None else F.lit(0)).cast("long").alias("seq"),
        F.lit(severity).alias("severity"),
        title.alias("title"),
        explanation.alias("explanation"),
        (F.lit(suggestion) if isinstance(suggestion, str) else suggestion).alias("suggestion"),
        (suggestion_sql if suggestion_sql is not None else F.lit(None).cast("string")).alias("suggestion_sql"),
    )


def _if(condition: Column, finding: Column) -> Column:
    """The finding in an array, or none."""
    return F.filter(F.array(finding), lambda f: F.coalesce(condition, F.lit(False)))


def _tick(*parts) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def missing_where() -> Column:
    hit = (
        F.col("verb").isin("UPDATE", "DELETE")
        & ~F.col("has_where")
        & ~F.col("has_using")
        & ~F.col("has_limit")
        & ~F.col("has_target_join")
    )
    return _if(hit, _finding(
        "missing-where", "CRITICAL",
        title=_tick(F.col("verb"), " has no WHERE clause and affects every row"),
        explanation=_tick(
            "Nothing limits the rows this ", F.col("verb"), " touches on ",
            F.coalesce(_tick("`", st.unquote_name(F.col("target")), "`"), F.lit("the target table")), "."
        ),
        suggestion="State the predicate that names the intended rows.",
    ))


def no_limit() -> Column:
    def bounds(p):
        exactly_one = p["left_has_column"] != p["right_has_column"]
        inner = (p["section"] == "ON") & ~p["outer_join"]
        return inner & (
            (p["u"].isin("=", "<", "<=", ">", ">=") & exactly_one) | ((p["u"] == "IN") & p["left_has_column"])
        )

    hit = (
        (F.col("verb") == "SELECT")
        & ~F.col("is_set_operation")
        & F.col("has_from")
        & ~(F.col("has_where") | F.col("has_limit") | F.col("has_fetch"))
        & (F.col("has_group") | ~F.coalesce(F.col("all_aggregates"), F.lit(False)))
        & ~F.coalesce(F.exists("predicates", bounds), F.lit(False))
    )
    return _if(hit, _finding(
        "no-limit", "HIGH",
        title=F.lit("SELECT reads an entire table with no row limit"),
        explanation=_tick(
            "Neither WHERE nor LIMIT/FETCH bounds the rows read from ",
            F.coalesce(_tick("`", st.unquote_name(F.col("target")), "`"), F.lit("the source table")), "."
        ),
        suggestion="Bound the result with a predicate, paging by key, or a streaming cursor.",
    ))


def select_star() -> Column:
    return _if(F.col("has_star") & (F.col("kind") != DERIVED_KIND), _finding(
        "select-star", "MEDIUM",
        title=F.lit("Query selects every column with `SELECT *`"),
        explanation=F.lit("The projection returns all columns of each row it matches."),
        suggestion="Name the columns the caller reads.",
    ))


def _where_predicates(*operators: str) -> Column:
    """The comparisons of a statement's own WHERE."""
    wanted = lambda p: (p["section"] == "WHERE") & F.col("owned") & p["u"].isin(*operators)
    return F.filter("predicates", wanted)


def _column_text(qualifier: Column, name: Column) -> Column:
    return F.concat_ws(".", qualifier, name)


def leading_wildcard() -> Column:
    def wild(p):
        return (
            p["left_name"].isNotNull() & (p["right_shape"] == "s") & (p["right_len"] == 1)
            & F.rlike(p["right_token"], F.lit(r"\A[nN]?'%"))
        )

    def found(p):
        pattern = F.replace(F.regexp_replace(p["right_token"], r"\A[nN]?'|'\z", ""), F.lit("''"), F.lit("'"))
        return _finding(
            "non-sargable", "MEDIUM", "leading-wildcard", seq=p["pos"],
            title=_tick("LIKE pattern starts with a wildcard on `", _column_text(p["left_qualifier"], p["left_name"]), "`"),
            explanation=_tick("The pattern `", pattern, "` begins with `%`, so no index prefix can be sought."),
            suggestion="Use an index made for substring search, or store the value reversed.",
        )

    return F.transform(F.filter(_where_predicates("LIKE", "ILIKE"), wild), found)


_COMPARING = ["=", "<>", "!=", "<", "<=", ">", ">=", "IN", "BETWEEN"]
_ONE_SIDED = ["IN", "BETWEEN"]


def _sides(fields: tuple[str, ...]) -> Column:
    """The operands of WHERE comparisons as structs ``pos, side, fields``."""

    def both(p):
        side = lambda n, prefix: F.struct(p["pos"].alias("pos"), F.lit(n).alias("side"), *(p[f"{prefix}_{c}"].alias(c) for c in fields))
        return F.when(p["u"].isin(_ONE_SIDED), F.array(side(0, "left"))).otherwise(F.array(side(0, "left"), side(1, "right")))

    return F.flatten(F.transform(_where_predicates(*_COMPARING), both))


_SHAPES = ("shape", "ahead", "len", "token", "inner_bare", "lo", "hi", "has_column")


def _side_text(s: Column) -> Column:
    return F.trim(F.regexp_replace(F.substring(F.col("text"), s["lo"] + 1, s["hi"] - s["lo"]), r"\s+", " "))


def wrapped_column() -> Column:
    def call(s):
        return (s["len"] == 3) & (s["shape"] == "f()") & s["has_column"] & ~F.upper(s["token"]).isin("CONVERT")

    def read(s):
        text = _side_text(s)
        function = F.upper(s["token"])
        canonical = F.concat(function, F.substring(text, F.length(s["token"]) + 1, F.length(text)))
        return F.struct(canonical.alias("canonical"), s["pos"].alias("pos"), function.alias("function"))

    def found(c):
        return _finding(
            "non-sargable", "MEDIUM", "wrapped-column", seq=c["pos"],
            title=_tick("Filtered column is wrapped in `", c["function"], "(...)`"),
            explanation=_tick("The filter compares `", c["canonical"], "` instead of the column itself."),
            suggestion="Move the function to the other side, or index the expression.",
            suggestion_sql=_tick("CREATE INDEX ... ON <table> ((", c["canonical"], "));"),
        )

    return F.transform(_least_of_each(F.transform(F.filter(_sides(_SHAPES), call), read), "canonical"), found)


def _least_of_each(rows: Column, *same: str) -> Column:
    """Of the structs alike in ``same``, which are their first fields, the least."""

    def marked(x, i, ordered):
        before = F.get(ordered, i - 1)
        alike = F.lit(True)
        for c in same:
            alike = alike & F.coalesce(before[c] == x[c], F.lit(False))
        return F.struct(x.alias("x"), alike.alias("again"))

    # A transform of one element binds the sorted array to a name.
    bound = F.transform(F.array(F.array_sort(rows)), lambda ordered: F.filter(
        F.transform(ordered, lambda x, i: marked(x, i, ordered)), lambda y: ~y["again"]
    ))
    return F.transform(F.flatten(bound), lambda y: y["x"])


_PART = r"(?:[A-Za-z_\x{80}-\x{FFFF}][\w$\x{80}-\x{FFFF}]*+|\"[^\"]*+\"|`[^`]*+`|\[[^\]]*+\])"
#: A name of any number of parts, then a cast.
_CAST_NAME = rf"\A{_PART}(?:\s*+\.\s*+{_PART})*+\s*+::"


def explicit_cast() -> Column:
    def cast(s):
        # Names of three parts and more reach beyond the codes ahead; their text decides below.
        prefix = (s["len"] >= 3) & s["ahead"].startswith("ct") | ((s["len"] >= 5) & s["ahead"].startswith("c.ct"))
        long = (s["len"] >= 7) & s["ahead"].startswith("c.c.c")
        return ((s["len"] == 3) & (s["shape"] == "x()") & s["inner_bare"]) | prefix | long

    def read(s):
        return F.struct(s.alias("s"), _side_text(s).alias("text"))

    def parted(x):
        return ~x["s"]["ahead"].startswith("c.c.c") | F.rlike(x["text"], F.lit(_CAST_NAME))

    def found(x):
        call, text = x["s"]["shape"] == "x()", x["text"]
        column = F.when(call, F.regexp_extract(text, r"\(\s*(.*?)\s+(?i:as)\s", 1)).otherwise(
            F.trim(F.regexp_extract(text, r"\A(.*?)\s*::", 1))
        )
        target = F.upper(
            F.when(call, F.regexp_extract(text, r"\s(?i:as)\s+(.*?)\s*\)\z", 1)).otherwise(
                F.trim(F.regexp_extract(text, r"::\s*(.*)\z", 1))
            )
        )
        return _finding(
            "non-sargable", "MEDIUM", "explicit-cast", seq=x["s"]["pos"] * 2 + x["s"]["side"],
            title=_tick("Comparison on `", column, "` requires a type conversion"),
            explanation=_tick("`", column, "` is cast to ", target, " before it is compared."),
            suggestion="Bind the parameter in the column's own type.",
        )

    casts = F.filter(_sides(_SHAPES), lambda s: F.coalesce(cast(s), F.lit(False)))
    return F.transform(F.filter(F.transform(casts, read), parted), found)


# --- rules that look a column up ----------------------------------------------------------


def _resolved(columns: Column) -> Column:
    """``columns`` (structs ``pos, side, qualifier, name``) with the ``table_name`` they belong to, where that
    is known: the qualifier's table, or the only one."""

    def placed(c):
        table = records.table_of(c["qualifier"])
        return F.struct(
            F.lower(table).alias("table_key"), F.lower(st.unquote_name(c["name"])).alias("column_key"), c["pos"].alias("pos"),
            c["side"].alias("side"), table.alias("table_name"), st.unquote_name(c["name"]).alias("column"),
            F.concat_ws(".", c["qualifier"], c["name"]).alias("shown"),
        )

    return F.filter(F.transform(columns, placed), lambda c: c["table_name"].isNotNull())


def filtered_columns() -> Column:
    """Bare columns that WHERE compares, each column of a table once."""
    return _least_of_each(_resolved(F.filter(_sides(("qualifier", "name")), lambda s: s["name"].isNotNull())), "table_key", "column_key")


def unindexed_filter(c: Column, indexed: Column, types: Column) -> Column:
    listed = F.array_join(F.sort_array(indexed), ", ")
    return _if(~F.array_contains(indexed, c["column_key"]), _finding(
        "unindexed-filter", "HIGH", seq=c["pos"],
        title=_tick("Filter on `", c["table_name"], ".", c["column"], "`, which has no index"),
        explanation=_tick(
            "`", c["column"], "` leads no index of `", c["table_name"], "` (leading columns: ",
            F.when(listed == "", "none").otherwise(listed), ").",
        ),
        suggestion=_tick("An index on `", c["column"], "` would serve it."),
        suggestion_sql=_tick(
            "CREATE INDEX idx_", F.lower(c["table_name"]), "_", c["column_key"], " ON ", c["table_name"], " (", c["column"], ");",
        ),
    ))


def numbered_columns() -> Column:
    """Bare columns that WHERE compares with a number."""

    def compared(p):
        number = lambda side: (p[f"{side}_shape"] == "n") & (p[f"{side}_len"] == 1)
        on_left = p["left_name"].isNotNull() & number("right")
        on_right = p["right_name"].isNotNull() & number("left")
        pick = lambda c: F.when(on_left, p[f"left_{c}"]).when(on_right, p[f"right_{c}"])
        return F.struct(p["pos"].alias("pos"), F.lit(0).alias("side"), pick("qualifier").alias("qualifier"), pick("name").alias("name"))

    columns = F.transform(_where_predicates("=", "<>", "!="), compared)
    return _resolved(F.filter(columns, lambda c: c["name"].isNotNull()))


def implicit_cast(c: Column, indexed: Column, types: Column) -> Column:
    declared = F.lower(F.get(F.map_values(F.map_filter(types, lambda k, v: F.lower(k) == c["column_key"])), F.lit(0)))
    return _if(F.rlike(declared, F.lit(r"\A(char|text|varchar|citext|uuid)")), _finding(
        "non-sargable", "MEDIUM", "implicit-cast", seq=c["pos"],
        title=_tick("Comparison on `", c["shown"], "` requires a type conversion"),
        explanation=_tick("Text (", declared, ") in `", c["shown"], "` against a number."),
        suggestion="Quote the number.",
    ))


#: All rules in the order their findings are raised for one query: the findings of a record, or the
#: columns of it to look up and the findings of one of them.
RULES = (
    ("missing-where", missing_where, None),
    ("no-limit", no_limit, None),
    ("non-sargable", leading_wildcard, None),
    ("non-sargable", wrapped_column, None),
    ("non-sargable", explicit_cast, None),
    ("non-sargable", numbered_columns, implicit_cast),
    ("select-star", select_star, None),
    ("unindexed-filter", filtered_columns, unindexed_filter),
)


def _known_tables(schema: DataFrame, scope: list[str]) -> DataFrame:
    """``scope, table_key, indexed, types``; should a schema list a table twice, the greatest entry counts."""
    return schema.groupBy(*scope, F.lower("table_name").alias("table_key")).agg(
        F.max(F.transform("indexed_columns", F.lower)).alias("indexed"),
        F.max_by("column_types", F.to_json("column_types")).alias("types"),
    )


def _raised(t: AuditTables, chosen: list[int]) -> DataFrame:
    """``qid, kind, rule_order`` and the findings of the chosen rules, from one pass over the records.

    A record's findings and the columns it asks the schema for are exploded together; where the queries
    and the schema both name a repository (and a version of it), a table is looked up in its own only.
    A finding that needs no look-up meets nothing there: its key is its statement's, so that findings
    spread over all tasks.
    """
    plain = [i for i in chosen if RULES[i][2] is None]
    asking = [i for i in chosen if RULES[i][2] is not None]
    tagged = lambda i, column, name: F.transform(column, lambda f: F.struct(F.lit(i).alias("rule_order"), f.alias(name)))
    columns = [F.concat(*(tagged(i, RULES[i][1](), "f") for i in plain)).alias("_found")] if plain else []
    asked = [F.concat(*(tagged(i, RULES[i][1](), "c") for i in asking)).alias("_asked")] if asking else []
    scope = [c for c in SCHEMA_SCOPE if t.schema is not None and c in t.schema.columns and c in t.records.columns]
    rows = t.records.select("qid", "kind", *scope, *columns, *asked)
    if not asking:
        return rows.select("qid", "kind", F.explode("_found").alias("_r")).select("qid", "kind", "_r.rule_order", "_r.f.*")
    probe = F.transform("_asked", lambda r: F.struct(
        r["c"]["table_key"].alias("table_key"), r["rule_order"].alias("rule_order"), r["c"].alias("c"), *([F.lit(None).cast(_FINDING_TYPE).alias("f")] if plain else []),
    ))
    if plain:
        none = F.transform("_asked", lambda r: r["c"])
        done = F.transform("_found", lambda r: F.struct(
            F.concat(F.lit("\x00"), F.col("qid").cast("string")).alias("table_key"), r["rule_order"].alias("rule_order"),
            F.get(F.filter(none, lambda c: F.lit(False)), F.lit(0)).alias("c"), r["f"].alias("f"),
        ))
        probe = F.concat(done, probe)
    rows = rows.select("qid", "kind", *scope, F.explode(probe).alias("_r")).select("qid", "kind", *scope, "_r.*")
    tables = _known_tables(t.schema, scope)
    # One schema is a lookup; those of all repositories grow with them.
    tables = sorted_joins(tables) if scope else tables
    known = rows.join(tables, [*scope, "table_key"], "left" if plain else "inner")
    found = F.array().cast(f"array<{_FINDING_TYPE}>")
    for i in asking:
        found = F.when(
            (F.col("rule_order") == i) & F.col("indexed").isNotNull(), RULES[i][2](F.col("c"), F.col("indexed"), F.col("types"))
        ).otherwise(found)
    if plain:
        found = F.when(F.col("f").isNotNull(), F.array("f")).otherwise(found)
    return known.select("qid", "kind", "rule_order", F.explode(found).alias("_f")).select("qid", "kind", "rule_order", "_f.*")


def rule(t: AuditTables, name: str, check: str | None = None) -> DataFrame:
    """The findings of one rule (of one of its checks): ``FINDING_COLUMNS``."""
    chosen = [i for i, (rule_id, _, look_up) in enumerate(RULES) if rule_id == name and (look_up is None or t.schema is not None)]
    if check is not None:
        chosen = [i for i in chosen if _CHECKS.get(i) == check]
    return _raised(t, chosen).select(*FINDING_COLUMNS)


_CHECKS = {2: "leading-wildcard", 3: "wrapped-column", 4: "explicit-cast", 5: "implicit-cast"}


def rule_missing_where(t: AuditTables) -> DataFrame:
    return rule(t, "missing-where")


def rule_no_limit(t: AuditTables) -> DataFrame:
    return rule(t, "no-limit")


def rule_select_star(t: AuditTables) -> DataFrame:
    return rule(t, "select-star")


def rule_unindexed_filter(t: AuditTables) -> DataFrame:
    return rule(t, "unindexed-filter")


def rule_leading_wildcard(t: AuditTables) -> DataFrame:
    return rule(t, "non-sargable", "leading-wildcard")


def rule_wrapped_column(t: AuditTables) -> DataFrame:
    return rule(t, "non-sargable", "wrapped-column")


def rule_explicit_cast(t: AuditTables) -> DataFrame:
    return rule(t, "non-sargable", "explicit-cast")


def rule_implicit_cast(t: AuditTables) -> DataFrame:
    return rule(t, "non-sargable", "implicit-cast")


def mark_inferred(findings: DataFrame) -> DataFrame:
    """Findings on derived-method queries get a confidence, unless one is set.

    In: a ``kind`` column beside ``confidence`` and ``confidence_basis``.
    """
    fill = (F.col("kind") == DERIVED_KIND) & F.col("confidence").isNull()
    return findings.withColumn(
        "confidence_basis", F.when(fill, F.lit(INFERRED_BASIS)).otherwise(F.col("confidence_basis"))
    ).withColumn(
        "confidence", F.when(fill, F.lit(INFERRED_CONFIDENCE)).otherwise(F.col("confidence"))
    )


def severity_rank(severity: Column) -> Column:
    return F.array_position(F.array(*[F.lit(s) for s in SEVERITIES]), severity) - 1


def run_rules(t: AuditTables, disabled: tuple[str, ...] = ()) -> DataFrame:
    """All findings with ``rule_order``, worst first, with the inferred marking applied."""
    chosen = [
        i for i, (rule_id, _, look_up) in enumerate(RULES)
        if rule_id not in disabled and (look_up is None or t.schema is not None)
    ]
    return mark_inferred(
        _raised(t, chosen)
        .withColumn("confidence", F.lit(None).cast("double"))
        .withColumn("confidence_basis", F.lit(None).cast("string"))
    )
