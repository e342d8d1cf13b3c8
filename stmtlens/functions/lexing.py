"""Lexing of SQL and Java text with one regular expression per language.

A piece is *leading trivia* (white space and comments) followed by one token, so
the concatenated pieces are the whole text and offsets are running lengths.  All
repeated groups are possessive: the regex engine then walks them in a loop and
never recurses, so a literal of any length is safe.

Known limits, all on purpose: there is no grammar here.  "Not analysable" means
an unterminated quote or comment, or brackets that do not pair up.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- SQL -------------------------------------------------------------------------

_TRIVIA_ANSI = r"(?:\s++|--[^\n]*+|/\*[\s\S]*?\*/)"
_TRIVIA_MYSQL = r"(?:\s++|--[^\n]*+|\#[^\n]*+|/\*[\s\S]*?\*/)"

_NAME = r"[A-Za-z_\x{80}-\x{FFFF}][\w$\x{80}-\x{FFFF}]*+"
_NUMBER = r"\d++(?:\.\d*+)?+(?:[eE][+-]?+\d++)?+|\.\d++(?:[eE][+-]?+\d++)?+"
_PARAM = r":\#\{[^}]*+\}|:[A-Za-z_]\w*+|\?\d*+|%s|%\(\w++\)s|\$\d++|@\w++"
_SYMBOL = r"<=>|<>|<=|>=|=>|!=|\|\||::|->>|->|:=|/\*|[\s\S]"

_STRING_ANSI = (
    r"[eE]'(?:[^'\\]|\\[\s\S]|'')*+'"
    r"|[nNbBxX]?+(?:'[^']*+')++"
    r"|\$(?<tag>[A-Za-z_]\w*+|)\$[\s\S]*?\$\k<tag>\$"
)
_STRING_MYSQL = r"(?:'(?:[^'\\]|\\[\s\S])*+')++" r'|(?:"(?:[^"\\]|\\[\s\S])*+")++'
_QUOTED_ANSI = r'(?:"[^"]*+")++'
_QUOTED_MYSQL = r"(?:`[^`]*+`)++"
_QUOTED_TSQL = r'(?:"[^"]*+")++|\[[^\]]*+\]'


def _pattern(trivia: str, string: str, quoted: str) -> str:
    token = "|".join([string, quoted, _NAME, _NUMBER, "::", _PARAM, _SYMBOL])
    return rf"{trivia}*+({token}|\z)"


SQL_PATTERNS = {
    "ansi": _pattern(_TRIVIA_ANSI, _STRING_ANSI, _QUOTED_ANSI),
    "mysql": _pattern(_TRIVIA_MYSQL, _STRING_MYSQL, _QUOTED_MYSQL),
    "tsql": _pattern(_TRIVIA_ANSI, _STRING_ANSI, _QUOTED_TSQL),
}
SQL_TRIVIA = {"ansi": _TRIVIA_ANSI, "mysql": _TRIVIA_MYSQL, "tsql": _TRIVIA_ANSI}

#: One statement, up to and with its closing semicolon.
_SEGMENT = {
    "ansi": rf"(?:{_TRIVIA_ANSI}|{_STRING_ANSI}|{_QUOTED_ANSI}|[^;])*+(?:;|\z)",
    "mysql": rf"(?:{_TRIVIA_MYSQL}|{_STRING_MYSQL}|{_QUOTED_MYSQL}|[^;])*+(?:;|\z)",
    "tsql": rf"(?:{_TRIVIA_ANSI}|{_STRING_ANSI}|{_QUOTED_TSQL}|[^;])*+(?:;|\z)",
}
#: Text that lexes without a stray quote or an unclosed comment.
_WELL_FORMED = {
    "ansi": rf"\A(?:{_TRIVIA_ANSI}|{_STRING_ANSI}|{_QUOTED_ANSI}|(?!/\*)[^'\"])*+\z",
    "mysql": rf"\A(?:{_TRIVIA_MYSQL}|{_STRING_MYSQL}|{_QUOTED_MYSQL}|(?!/\*)[^'\"`])*+\z",
    "tsql": rf"\A(?:{_TRIVIA_ANSI}|{_STRING_ANSI}|{_QUOTED_TSQL}|(?!/\*)[^'\"])*+\z",
}
#: Quoted text and comments, to be blanked before brackets are counted.
_OPAQUE = {
    "ansi": rf"{_TRIVIA_ANSI}|{_STRING_ANSI}|{_QUOTED_ANSI}",
    "mysql": rf"{_TRIVIA_MYSQL}|{_STRING_MYSQL}|{_QUOTED_MYSQL}",
    "tsql": rf"{_TRIVIA_ANSI}|{_STRING_ANSI}|{_QUOTED_TSQL}",
}


def by_dialect(dialect: Column | None, make) -> Column:
    """``make(flavour)`` for the lexical flavour of each row's dialect."""
    if dialect is None:
        return make("ansi")
    return (
        F.when(dialect == "mysql", make("mysql"))
        .when(dialect == "tsql", make("tsql"))
        .otherwise(make("ansi"))
    )


def bind(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once per row.

    A lambda that mentions an outer expression computes it again for each element;
    a lambda *variable* is computed once.
    """
    return F.transform(F.array(value), use)[0]


def sql_pieces(text: Column, dialect: Column | None = None) -> Column:
    """Array of trivia+token pieces; their concatenation is the text."""
    return by_dialect(
        dialect, lambda d: F.regexp_extract_all(text, F.lit(SQL_PATTERNS[d]), F.lit(0))
    )


def sql_token_texts(text: Column, dialect: Column | None = None) -> Column:
    """Array of the tokens alone (no white space, no comments)."""
    tokens = by_dialect(
        dialect, lambda d: F.regexp_extract_all(text, F.lit(SQL_PATTERNS[d]), F.lit(1))
    )
    return F.filter(tokens, lambda t: t != "")


def strip_leading_trivia(piece: Column, dialect: Column | None = None) -> Column:
    return by_dialect(
        dialect, lambda d: F.regexp_replace(piece, rf"\A{SQL_TRIVIA[d]}*+", "")
    )


def sql_segments(content: Column, dialect: Column | None = None) -> Column:
    """Array of statement segments, semicolons included."""
    return by_dialect(
        dialect, lambda d: F.regexp_extract_all(content, F.lit(_SEGMENT[d]), F.lit(0))
    )


def sql_well_formed(text: Column, dialect: Column | None = None) -> Column:
    """Every quote and comment closes, and brackets pair up within each statement."""
    closed = by_dialect(dialect, lambda d: F.rlike(text, F.lit(_WELL_FORMED[d])))
    bare = by_dialect(dialect, lambda d: F.regexp_replace(text, _OPAQUE[d], " "))
    # A fold with two integers as its state: linear in the number of brackets.
    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("lowest"))

    def step(acc, mark):
        depth = acc["depth"] + F.when(mark == "(", 1).when(mark == ")", -1).otherwise(0)
        # A semicolon ends a statement, so nothing may be open there.
        low = F.when((mark == ";") & (acc["depth"] > 0), -1).otherwise(depth)
        return F.struct(depth.alias("depth"), F.least(acc["lowest"], low).alias("lowest"))

    paired = F.aggregate(
        F.regexp_extract_all(bare, F.lit("[();]"), F.lit(0)),
        start,
        step,
        lambda acc: (acc["depth"] == 0) & (acc["lowest"] == 0),
    )
    return closed & paired


# Words that are written in upper case whatever the author used, and
# that are therefore never columns, tables or aliases.
SQL_KEYWORDS = (
    "ALL ALTER AND ANY AS ASC BETWEEN BOTH BY CASE CAST CHECK COLLATE COLUMN CONFLICT "
    "CONSTRAINT CREATE CROSS CURRENT_DATE CURRENT_TIME CURRENT_TIMESTAMP DEFAULT DELETE "
    "DESC DISTINCT DO DROP ELSE END ESCAPE EXCEPT EXISTS FALSE FETCH FILTER FIRST FOR "
    "FOREIGN FROM FULL GROUP HAVING ILIKE IN INDEX INNER INSERT INTERSECT INTERVAL INTO "
    "IS JOIN LATERAL LEADING LEFT LIKE LIMIT MATCHED MERGE MINUS NATURAL NEXT NOT NOTHING "
    "NULL NULLS OFFSET ON ONLY OR ORDER OUTER OVER PARTITION PRIMARY REFERENCES RETURNING "
    "RIGHT ROW ROWS SELECT SET SOME TABLE THEN TOP TRAILING TRUE TRUNCATE UNION UNIQUE "
    "UPDATE USING VALUES VIEW WHEN WHERE WINDOW WITH WITHIN XOR"
).split()

# Statements kept as opaque text (no structure to read).
OPAQUE_VERBS = (
    "CALL DISCARD EXECUTE EXPLAIN GRANT LISTEN LOAD NOTIFY OPTIMIZE PREPARE RESET "
    "REVOKE SHOW VACUUM"
).split()

# Functions that fold a set of rows to one.
AGGREGATE_FUNCTIONS = (
    "COUNT SUM AVG MIN MAX STDDEV STDDEV_POP STDDEV_SAMP VARIANCE VAR_POP VAR_SAMP "
    "ARRAY_AGG STRING_AGG GROUP_CONCAT LISTAGG JSON_AGG JSONB_AGG JSON_ARRAYAGG "
    "JSON_OBJECT_AGG BOOL_AND BOOL_OR EVERY MEDIAN CORR COVAR_POP COVAR_SAMP "
    "APPROX_COUNT_DISTINCT ANY_VALUE COUNT_IF"
).split()


def _first(token: Column) -> Column:
    return F.substring(token, 1, 1)


def is_string_literal(token: Column, dialect: Column | None = None) -> Column:
    """By first characters only: the lexer has already delimited the token."""
    first, second = _first(token), F.substring(token, 2, 1)
    many = F.length(token) > 1
    ansi = (
        ((first == "'") & many)
        | (first.isin(*"eEnNbBxX") & (second == "'"))
        | ((first == "$") & many & token.endswith("$"))
    )
    if dialect is None:
        return ansi
    return ansi | ((dialect == "mysql") & (first == '"') & many)


def is_number_literal(token: Column) -> Column:
    first = _first(token)
    return first.between("0", "9") | ((first == ".") & (F.length(token) > 1))


def is_plain_name(token: Column) -> Column:
    first = _first(token)
    letter = (
        first.between("a", "z") | first.between("A", "Z") | (first == "_") | (first > "\x7f")
    )
    return letter & (F.substring(token, 2, 1) != "'")


def is_quoted_name(token: Column, dialect: Column | None = None) -> Column:
    first, many = _first(token), F.length(token) > 1
    double = first == '"'
    if dialect is not None:
        double = double & (dialect != "mysql")
    return (double | first.isin("`", "[")) & many


def tokens_balanced(tokens: Column) -> Column:
    """No stray quote or unclosed comment, and brackets pair up within a statement."""
    # A fold with two integers as its state: linear in the number of tokens.
    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("lowest"))

    def step(acc, token):
        depth = acc["depth"] + F.when(token == "(", 1).when(token == ")", -1).otherwise(0)
        broken = token.isin("'", '"', "`", "/*") | ((token == ";") & (acc["depth"] > 0))
        low = F.when(broken, -1).otherwise(depth)
        return F.struct(depth.alias("depth"), F.least(acc["lowest"], low).alias("lowest"))

    return F.aggregate(
        tokens, start, step, lambda acc: (acc["depth"] == 0) & (acc["lowest"] == 0)
    )


def normalize_sql(text: Column, dialect: Column | None = None) -> Column:
    """Statement shape: literals become ``?``, layout and keyword case are unified.

    Quoted names, existing parameters and TRUE/FALSE/NULL stay.  Commands without
    structure and text that cannot be lexed come back trimmed and otherwise as
    written.  Only equality of shapes is promised, not the marker itself.
    """
    def render(body):
        def canonical(token, index):
            upper = F.upper(token)
            is_word = upper.isin(SQL_KEYWORDS)
            calls = F.coalesce(F.get(body, index + 1) == "(", F.lit(False))
            shown = (
                F.when(is_string_literal(token, dialect) | is_number_literal(token), F.lit("?"))
                .when(token == "!=", F.lit("<>"))
                .when(is_word | (is_plain_name(token) & calls), upper)
                .otherwise(token)
            )
            before = F.coalesce(F.get(body, index - 1), F.lit("("))
            called = (token == "(") & is_plain_name(before) & ~F.upper(before).isin(SQL_KEYWORDS)
            tight = token.isin(".", ",", ")") | before.isin(".", "(") | called
            return F.concat(F.when(tight, F.lit("")).otherwise(F.lit(" ")), shown)

        return F.array_join(F.transform(body, canonical), "")

    trimmed = F.regexp_replace(text, r"\A\s++|\s++\z", "")
    opaque = F.upper(F.regexp_extract(text, r"\A\s*([A-Za-z]+)", 1)).isin(OPAQUE_VERBS)
    shape = bind(
        sql_token_texts(text, dialect),
        lambda tokens: F.when(
            tokens_balanced(tokens), bind(F.filter(tokens, lambda t: t != ";"), render)
        ),
    )
    return F.when(opaque, trimmed).otherwise(F.coalesce(shape, trimmed))


# --- Java ------------------------------------------------------------------------

_JAVA_TRIVIA = r"(?:\s++|//[^\n]*+|/\*[\s\S]*?\*/)"
_JAVA_LITERAL = (
    r'"""(?:[^"\\]|\\[\s\S]|"(?!""))*+"""'
    r'|"(?:[^"\\\n]|\\.)*+"'
    r"|'(?:[^'\\\n]|\\.)*+'"
)
_JAVA_TOKEN = (
    rf"{_JAVA_LITERAL}"
    r"|[A-Za-z_$][A-Za-z0-9_$]*+"
    r"|[0-9][A-Za-z0-9_.]*+"
    r"|->|::|==|!=|<=|>=|&&|\|\||\+\+|--|\+=|-=|\*=|/=|%=|[\s\S]"
)
JAVA_PATTERN = rf"{_JAVA_TRIVIA}*+({_JAVA_TOKEN}|\z)"
JAVA_TRIVIA = _JAVA_TRIVIA


def java_pieces(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(JAVA_PATTERN), F.lit(0))
