"""SQL files to statements, and statements to token, clause and predicate tables.

Partitioning: rows are hashed on the file or statement key *before* its text is
exploded, so the one shuffle moves the text once and every window and grouping
below runs inside that partitioning.  All windows are keyed by one file or one
statement, whose text was one cell to begin with.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stmtlens.functions import lexing as lx

DEFAULT_DIALECT = "postgres"


def _py_strip(text: Column) -> Column:
    return F.regexp_replace(text, r"\A\s++|\s++\z", "")


def hash_spread(df: DataFrame, *keys: str) -> DataFrame:
    """Hash rows on ``keys`` into the cluster's configured number of partitions.

    A fixed number on purpose: the text is about to be exploded to many times its
    size, so the bytes shuffled here say nothing about the work to come, and adaptive
    coalescing would pile it on a few tasks.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def among(name: str, words) -> Column:
    """Whether a column is one of many words: one expression, not one for each word."""
    return F.expr(f"`{name}` IN ({', '.join(repr(w) for w in words)})")


def _newlines(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))


def strip_bom(text: Column) -> Column:
    return F.regexp_replace(text, r"\A\x{FEFF}", "")


# --- files to statements -------------------------------------------------------------


def split_statements(
    sources: DataFrame,
    keys: tuple[str, ...] = ("path",),
    content: str = "content",
    dialect: str | None = "dialect",
) -> DataFrame:
    """One row per statement of each SQL file.

    Out: ``keys, ordinal, line, text, dialect, parse_error, id``.  A file that cannot
    be lexed is one row with ``parse_error`` set.  ``id`` is ``path:ordinal``.
    """
    speech = F.col(dialect) if dialect else F.lit(DEFAULT_DIALECT)
    files = (
        sources.select(
            *keys, strip_bom(F.col(content)).alias("_content"), speech.alias("dialect")
        )
        .filter(_py_strip(F.col("_content")) != "")
        .withColumn("_ok", lx.sql_well_formed(F.col("_content"), F.col("dialect")))
    )
    files = hash_spread(files, *keys)
    pieces = files.select(
        *keys,
        "dialect",
        "_ok",
        F.posexplode(
            F.when(F.col("_ok"), lx.sql_segments(F.col("_content"), F.col("dialect"))).otherwise(
                F.array("_content")
            )
        ).alias("_seg", "_raw"),
    )
    by_file = W.partitionBy(*keys).orderBy("_seg")
    before = by_file.rowsBetween(W.unboundedPreceding, -1)
    located = (
        pieces.withColumn(
            "_body",
            F.when(
                F.col("_ok"), lx.strip_leading_trivia(F.col("_raw"), F.col("dialect"))
            ).otherwise(F.col("_raw")),
        )
        .withColumn("_lines_before", F.coalesce(F.sum(_newlines(F.col("_raw"))).over(before), F.lit(0)))
        .withColumn(
            "line",
            F.when(
                F.col("_ok"),
                1
                + F.col("_lines_before")
                + _newlines(F.col("_raw"))
                - _newlines(F.col("_body")),
            )
            .otherwise(1)
            .cast("int"),
        )
        .withColumn("text", _py_strip(F.regexp_replace("_body", r";\z", "")))
        .withColumn("text", F.when(F.col("_ok"), F.col("text")).otherwise(_py_strip(F.col("_raw"))))
        .filter(F.col("text") != "")
    )
    return (
        located.withColumn("ordinal", F.row_number().over(by_file))
        .withColumn(
            "parse_error", F.when(~F.col("_ok"), F.lit("unterminated or unbalanced text"))
        )
        .select(
            *keys,
            "ordinal",
            "line",
            "text",
            "dialect",
            "parse_error",
            F.concat_ws(":", F.col("path"), F.col("ordinal").cast("string")).alias("id")
            if "path" in keys
            else F.col("ordinal").cast("string").alias("id"),
        )
    )


def query_id(path: Column, ordinal: Column, symbol: Column | None = None) -> Column:
    """``path:symbol`` where the source names the query, else ``path:ordinal``."""
    suffix = ordinal.cast("string")
    if symbol is not None:
        suffix = F.coalesce(symbol, suffix)
    return F.concat(path, F.lit(":"), suffix)


# --- tokens --------------------------------------------------------------------------

_CLAUSES = (
    "SELECT FROM WHERE GROUP HAVING ORDER LIMIT OFFSET FETCH SET VALUES RETURNING WINDOW "
    "UNION INTERSECT EXCEPT MINUS USING ON JOIN INTO UPDATE DELETE INSERT MERGE FOR"
).split()

_VERBS = ["SELECT", "INSERT", "UPDATE", "DELETE", "MERGE"]
_SET_WORDS = ["UNION", "INTERSECT", "EXCEPT", "MINUS"]

#: Words that end an operand (a comparison never reaches over them).
_OPERAND_ENDS = (
    "AND OR XOR NOT WHERE ON HAVING WHEN THEN ELSE END CASE SELECT DISTINCT FROM GROUP ORDER "
    "BY LIMIT OFFSET FETCH RETURNING UNION INTERSECT EXCEPT MINUS JOIN INNER CROSS FULL "
    "NATURAL SET VALUES USING WINDOW FOR ESCAPE ASC DESC"
).split()

_COMPARISONS = ["=", "<>", "!=", "<", "<=", ">", ">=", "<=>"]

#: Types that may stand before a string literal (``DATE '2020-01-01'``).
_TYPED = ["DATE", "TIME", "TIMESTAMP", "TIMESTAMPTZ", "DATETIME", "INTERVAL"]
#: Units of time, singular; a plural S is allowed.
_UNIT = r"\A(?:MICROSECOND|MILLISECOND|SECOND|MINUTE|HOUR|DAY|WEEK|MONTH|QUARTER|YEAR|DECADE|CENTURY)S?\z"
#: Calls whose first argument is a unit, not a column.
_UNIT_CALLS = ["TIMESTAMPADD", "TIMESTAMPDIFF", "DATEADD", "DATEDIFF", "DATEPART", "DATENAME", "EXTRACT"]


def _is_no_column() -> Column:
    """A name that is part of a constant or a label: a literal's type, a unit, an argument's name."""
    u = F.col("u")
    literal = u.isin(_TYPED) & (F.col("k1") == "string")
    length = (u == "INTERVAL") & F.col("k1").isin("string", "number", "param")
    unit = F.rlike("u", F.lit(_UNIT)) & (
        (F.col("p2") == "INTERVAL") | (F.col("p1") == "TO") | ((F.col("p1") == "(") & F.col("p2").isin(_UNIT_CALLS))
    )
    label = F.col("n1").isin("=>", ":=") & F.col("p1").isin("(", ",")
    return F.coalesce((F.col("kind") != "quoted") & (literal | length | unit), F.lit(False)) | F.coalesce(label, F.lit(False))


def sql_tokens(
    queries: DataFrame, key: str = "qid", text: str = "text", dialect: str | None = "dialect",
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """Token table: one row per significant token; with ``carry`` a struct ``carried`` of those columns.

    Columns: ``key, pos, off, end, line, tok, u, kind, depth, code`` and the next
    three tokens.  ``u`` is the upper-cased word, ``depth`` counts open parentheses
    around the token (a pair shares the value outside it); ``_n`` numbers all pieces of the
    text, ``_piece`` is the token with the blanks and comments before it.  ``code`` is one letter for
    the token's role: c column-like name, f function name, x cast, k reserved word,
    n number, s string, p parameter, else the symbol.
    """
    speech = F.col(dialect) if dialect else F.lit(DEFAULT_DIALECT)
    beside = [F.struct(*carry).alias("carried")] if carry else []
    kept = ["carried"] if carry else []
    pieces = hash_spread(
        queries.select(key, F.col(text).alias("_text"), speech.alias("_dialect"), *beside), key
    ).select(
        key,
        "_dialect",
        *kept,
        F.posexplode(lx.sql_pieces(F.col("_text"), F.col("_dialect"))).alias("_n", "_piece"),
    )
    order = W.partitionBy(key).orderBy("_n")
    running = order.rowsBetween(W.unboundedPreceding, W.currentRow)
    tok, d = F.col("tok"), F.col("_dialect")
    kind = (
        F.when(lx.is_string_literal(tok, d), "string")
        .when(lx.is_number_literal(tok), "number")
        .when(lx.is_quoted_name(tok, d), "quoted")
        .when(lx.is_plain_name(tok), F.when(among("u", lx.SQL_KEYWORDS), "word").otherwise("name"))
        .when(F.rlike(tok, F.lit(r"\A(?:\?|%s|%\(|\$\d|@\w|:[\w#])")), "param")
        .otherwise("symbol")
    )
    plain = (
        pieces.withColumns(
            {
                "tok": lx.strip_leading_trivia(F.col("_piece"), d),
                "end": F.sum(F.length("_piece")).over(running),
                "_nl": F.sum(_newlines(F.col("_piece"))).over(running),
            }
        )
        .filter(tok != "")
        .withColumns(
            {
                "off": F.col("end") - F.length(tok),
                "line": (1 + F.col("_nl") - _newlines(tok)).cast("int"),
                "u": F.upper(tok),
            }
        )
        .withColumn("kind", kind)
    )
    opens, closes = (tok == "(").cast("int"), (tok == ")").cast("int")
    full = plain.withColumns(
        {
            "pos": F.row_number().over(order),
            "depth": F.sum(opens - closes).over(running) - opens,
            "n1": F.lead("u", 1).over(order),
            "n2": F.lead("u", 2).over(order),
            "n4": F.lead("u", 4).over(order),
            "k1": F.lead("kind", 1).over(order),
            "k3": F.lead("kind", 3).over(order),
            "p1": F.lag("u", 1).over(order),
            "p2": F.lag("u", 2).over(order),
        }
    )
    calls = F.coalesce(F.col("n1") == "(", F.lit(False))
    code = (
        F.when(F.col("kind") == "string", "s")
        .when(F.col("kind") == "number", "n")
        .when(F.col("kind") == "param", "p")
        .when(F.col("u").isin("CAST", "TRY_CAST") & calls, "x")
        .when((F.col("kind") == "name") & calls, "f")
        .when(F.col("u").isin("LEFT", "RIGHT") & calls, "f")
        .when(F.col("kind").isin("name", "quoted"), F.when(_is_no_column(), "k").otherwise("c"))
        .when(F.col("kind") == "word", "k")
        .when(tok == "::", "t")
        .when(tok.isin("(", ")", ".", ",", "*"), tok)
        .otherwise("o")
    )
    return full.withColumn("code", code).select(
        key, "pos", "off", "end", "line", "tok", "u", "kind", "code", "depth",
        "n1", "n2", "n4", "k1", "k3", "p1", "p2", "_n", "_piece", *kept,
    )


def section_marks() -> tuple[Column, Column, Column]:
    """(opens a root clause, is a root JOIN, has a side) of a token."""
    opener = (F.col("depth") == 0) & among("u", _CLAUSES) & (F.col("kind") == "word")
    # `IS DISTINCT FROM` compares, it opens no clause.
    opener = opener & ~((F.col("u") == "FROM") & F.coalesce(F.col("p1") == "DISTINCT", F.lit(False)) & F.coalesce(F.col("p2").isin("IS", "NOT"), F.lit(False)))
    sides = ["LEFT", "RIGHT", "FULL"]
    outer = F.coalesce(F.col("p1").isin(sides), F.lit(False)) | F.coalesce(
        (F.col("p1") == "OUTER") & F.col("p2").isin(sides), F.lit(False)
    )
    return opener, (F.col("depth") == 0) & (F.col("u") == "JOIN"), outer


def owns_clauses(first: Column, main: Column, is_set: Column) -> Column:
    """Whether a statement's clauses are its own: by its first word, its first verb and its set words."""
    own = ["SELECT", "UPDATE", "DELETE"]
    return F.coalesce((first.isin(*own, "FROM") | ((first == "WITH") & main.isin(own))) & ~is_set, F.lit(False))


def clause_aggregates() -> list[Column]:
    """What a statement's facts are made of, gathered over its tokens."""
    root = F.col("depth") == 0
    u = F.col("u")
    first = F.min_by(u, F.col("pos"))
    has = lambda *words: F.bool_or(root & among("u", words) & (F.col("kind") == "word"))
    return [
        first.alias("_first"),
        F.min_by(u, F.when(root & u.isin(_VERBS), F.col("pos"))).alias("_main"),
        has(*_SET_WORDS).alias("is_set_operation"),
        has("WHERE").alias("_where"),
        (
            has("LIMIT")
            | F.bool_or(root & (u == "TOP") & F.coalesce(F.col("p1").isin("SELECT", "DISTINCT", "DELETE", "UPDATE"), F.lit(False)))
        ).alias("_limit"),
        has("FETCH").alias("_fetch"),
        has("GROUP").alias("_group"),
        has("USING").alias("_using"),
        F.bool_or(
            root
            & (
                (u == "JOIN")
                | ((u == ",") & F.col("section").isin("FROM", "JOIN", "UPDATE", "DELETE"))
            )
        ).alias("_joins"),
        # joins that hang on the target of a write: before SET or WHERE
        F.bool_or(root & (u == "JOIN") & (F.col("kind") == "word")).alias("_join_word"),
        F.bool_or(root & (u == ",") & (F.col("section") == "UPDATE")).alias("_target_comma"),
        F.min(F.when(root & (u == "SET"), F.col("pos"))).alias("_set_pos"),
        F.min(F.when(root & (u == "JOIN"), F.col("pos"))).alias("_join_pos"),
        F.bool_or(root & (u == "FROM") & (F.col("section") == "FROM")).alias("_from"),
        F.min_by("tok", F.when(root & F.col("code").isin("c") & F.col("p1").isin("UPDATE", "FROM", "ONLY", "INTO", "JOIN"), F.col("pos"))).alias("target"),
    ]


CLAUSE_FACTS = [
    "verb", "is_set_operation", "has_where", "has_limit", "has_fetch", "has_group", "has_using", "has_joins",
    "has_target_join", "has_from", "is_opaque", "target",
]


def clause_columns(facts: DataFrame) -> DataFrame:
    """``facts`` (with the columns of :func:`clause_aggregates`) with the ``CLAUSE_FACTS``."""
    verb = (
        F.when(F.col("is_set_operation") & F.col("_first").isin("SELECT", "(", "WITH"), "SET OPERATION")
        .when(F.col("_first") == "WITH", F.col("_main"))
        .when(F.col("_first") == "FROM", F.lit("SELECT"))
        .otherwise(F.col("_first"))
    )
    own = F.col("verb").isin("SELECT", "UPDATE", "DELETE")
    return facts.withColumn("verb", verb).withColumns(
        {
            "has_where": F.col("_where") & own,
            "has_limit": F.col("_limit") & own,
            "has_fetch": F.col("_fetch") & own,
            "has_group": F.col("_group") & own,
            "has_using": F.col("_using") & (F.col("verb") == "DELETE"),
            "has_joins": F.col("_joins") & own,
            "has_target_join": F.coalesce(
                (F.col("verb").isin("UPDATE") & (F.col("_target_comma") | (F.col("_join_pos") < F.col("_set_pos"))))
                | (F.col("verb").isin("DELETE") & F.col("_join_word")),
                F.lit(False),
            ),
            "has_from": F.col("_from") & own,
            "is_opaque": F.col("verb").isin(*lx.OPAQUE_VERBS),
        }
    )


# --- operand structure ---------------------------------------------------------------


def names_column() -> Column:
    """Whether a token ends the name of a column."""
    # `EXTRACT(YEAR FROM d)`: that FROM introduces a column.
    of_unit = (F.col("p1") == "FROM") & F.rlike("p2", F.lit(_UNIT))
    return (
        (F.col("code") == "c")
        & ~F.coalesce(F.col("n1") == ".", F.lit(False))
        & ~F.coalesce(F.col("p1").isin("AS", "::", "FROM", "JOIN", "INTO", "UPDATE") & ~F.coalesce(of_unit, F.lit(False)), F.lit(False))
    )


def cast_of_column() -> Column:
    """At an opening bracket: ``(col AS`` or ``(q.col AS`` follows."""
    name = F.col("k1").isin("name", "quoted")
    return (F.col("tok") == "(") & F.coalesce(
        (name & (F.col("n2") == "AS"))
        | (name & (F.col("n2") == ".") & F.col("k3").isin("name", "quoted") & (F.col("n4") == "AS")),
        F.lit(False),
    )


def operand_marks() -> tuple[Column, Column]:
    """(is a comparison, ends an operand) of a level's token."""
    u = F.col("u")
    is_op = ~F.col("delimiter") & (
        among("u", _COMPARISONS) | ((F.col("kind") == "word") & u.isin("IN", "BETWEEN", "LIKE", "ILIKE"))
    )
    ends = (
        F.col("delimiter")
        | ((F.col("kind") == "word") & among("u", _OPERAND_ENDS))
        | ((F.col("kind") == "word") & u.isin("LEFT", "RIGHT") & (F.col("code") == "k"))
        | u.isin(",", ";")
    )
    return is_op, ends


# --- tables and aliases --------------------------------------------------------------


def unquote_name(token: Column) -> Column:
    return F.regexp_replace(token, r'^["`\[]|["`\]]$', "")


def level_clause() -> Column:
    """The clause a level's token opens, ``|`` for the brackets around the level."""
    word = (F.col("kind") == "word") & ~F.col("delimiter")
    clauses = (
        "SELECT", "FROM", "WHERE", "GROUP", "HAVING", "ORDER", "LIMIT", "SET", "VALUES", "RETURNING", "ON", "JOIN",
        "DELETE", "UPDATE", "INTO", "USING",
    )
    return F.when(F.col("delimiter"), "|").when(word & among("u", clauses), F.col("u"))


def starts_table() -> Column:
    """Whether a table's name begins at a token, by the two words and clauses (``lclause``) before it."""
    # FROM inside EXTRACT(..), TRIM(..) or IS DISTINCT FROM introduces no table.
    from_ok = F.col("prev2_clause").isin("SELECT", "DELETE", "SET", "FROM") & ~(
        F.coalesce(F.col("prev2_u") == "DISTINCT", F.lit(False))
    )
    return (
        ~F.col("delimiter")
        & (F.col("code").isin("c") | ((F.col("code") == "f") & (F.col("prev_u") == "INTO")))
        & (
            F.col("prev_u").isin("JOIN", "INTO", "ONLY")
            # A row lock (FOR [NO KEY] UPDATE ..) and an upsert's branch name no table.
            | ((F.col("prev_u") == "UPDATE") & ~F.coalesce(F.col("prev2_u").isin("FOR", "KEY", "DO"), F.lit(False)))
            | ((F.col("prev_u") == "TABLE"))
            | ((F.col("prev_u") == "USING") & (F.col("prev2_clause").isin("FROM", "JOIN", "INTO")))
            | ((F.col("prev_u") == "FROM") & from_ok)
            | ((F.col("prev_u") == ",") & F.col("lclause").isin("FROM", "JOIN", "UPDATE", "USING"))
            | ((F.col("prev_u") == "LATERAL"))
        )
    )
