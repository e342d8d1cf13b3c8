"""Repository method names that are queries: decoding and SQL-shaped rendering."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_METHOD = (
    r"\A(find|read|get|query|search|stream|count|exists|delete|remove)"
    r"((?:First|Top)\d*)?By([A-Z][A-Za-z0-9]*)\z"
)
_CONNECTOR = r"(And|Or)(?=[A-Z])"
_ORDER = r"\A(.*?)OrderBy([A-Z][A-Za-z0-9]*?)(Asc|Desc)\z"

# Property suffix and what it compares.
OPERATORS = [
    ("IsNotNull", "is_not_null"), ("IsNull", "is_null"), ("LessThanEqual", "less_than_equal"),
    ("GreaterThanEqual", "greater_than_equal"), ("StartingWith", "starting_with"),
    ("EndingWith", "ending_with"), ("Containing", "containing"), ("NotLike", "not_like"),
    ("NotIn", "not_in"), ("GreaterThan", "greater_than"), ("LessThan", "less_than"),
    ("After", "greater_than"), ("Before", "less_than"), ("Between", "between"),
    ("Equals", "equals"), ("IsNot", "not_equals"), ("Not", "not_equals"), ("Like", "like"),
    ("In", "in"), ("True", "true"), ("False", "false"), ("Is", "equals"),
]
# SQL of each comparison; {l} is the column, {p} the parameter.
RENDERINGS = [
    ("equals", "{l} = {p}"), ("not_equals", "{l} <> {p}"), ("less_than", "{l} < {p}"),
    ("less_than_equal", "{l} <= {p}"), ("greater_than", "{l} > {p}"),
    ("greater_than_equal", "{l} >= {p}"), ("between", "{l} BETWEEN ? AND ?"),
    ("like", "{l} LIKE {p}"), ("not_like", "{l} NOT LIKE {p}"), ("starting_with", "{l} LIKE {p}"),
    ("ending_with", "{l} LIKE {p}"), ("containing", "{l} LIKE {p}"), ("in", "{l} IN (?)"),
    ("not_in", "{l} NOT IN (?)"), ("true", "{l} = TRUE"), ("false", "{l} = FALSE"),
    ("is_null", "{l} IS NULL"), ("is_not_null", "{l} IS NOT NULL"),
]


def _lookup(pairs: list[tuple[str, str]], key: Column) -> Column:
    found = F.lit(None).cast("string")
    for name, value in reversed(pairs):
        found = F.when(key == name, F.lit(value)).otherwise(found)
    return found


def camel_to_snake(name: Column) -> Column:
    return F.lower(F.regexp_replace(name, r"(?<=[a-z0-9])(?=[A-Z])", "_"))


def entity_table(name: Column) -> Column:
    entity = F.regexp_replace(name, r"Repository\z", "")
    return F.when(entity == "", "unknown_entity").otherwise(camel_to_snake(entity))


def decode_method(name: Column) -> Column:
    """Struct of a derived query, NULL for any name outside the supported grammar.

    Fields: ``operation, predicates, order_property, order_direction, row_limit``; a
    predicate is ``property, operator, conjunction, ignore_case``.
    """
    verb = F.regexp_extract(name, _METHOD, 1)
    limit = F.regexp_extract(name, _METHOD, 2)
    criteria = F.regexp_extract(name, _METHOD, 3)
    ordered = F.rlike(criteria, F.lit(_ORDER))
    body = F.when(ordered, F.regexp_extract(criteria, _ORDER, 1)).otherwise(criteria)
    suffixes = "|".join(s for s, _ in sorted(OPERATORS, key=lambda p: -len(p[0])))
    # The shortest property wins, that is the longest suffix.
    split_suffix = rf"\A(.+?)({suffixes})\z"

    def predicate(segment, index):
        ignore = segment.endswith("IgnoreCase")
        core = F.regexp_replace(segment, r"IgnoreCase\z", "")
        suffix = F.regexp_extract(core, split_suffix, 2)
        return F.struct(
            F.when(suffix == "", core).otherwise(F.regexp_extract(core, split_suffix, 1)).alias("property"),
            F.coalesce(_lookup(OPERATORS, suffix), F.lit("equals")).alias("operator"),
            F.when(
                index > 0,
                F.upper(F.get(F.regexp_extract_all(body, F.lit(_CONNECTOR), F.lit(1)), index - 1)),
            ).alias("conjunction"),
            ignore.alias("ignore_case"),
        )

    segments = F.split(body, r"(?:And|Or)(?=[A-Z])", -1)
    predicates = F.transform(segments, predicate)
    digits = F.regexp_extract(limit, r"(\d+)\z", 1)
    supported = (
        (verb != "")
        & (ordered | ~criteria.contains("OrderBy"))
        & (body != "")
        & ~F.exists(segments, lambda s: s.endswith("AllIgnoreCase"))
        & ~F.exists(predicates, lambda p: p["property"] == "")
    )
    operation = (
        F.when(verb.isin("count", "exists", "delete", "remove"), verb).otherwise(F.lit("find"))
    )
    return F.when(
        supported,
        F.struct(
            operation.alias("operation"),
            predicates.alias("predicates"),
            F.when(ordered, F.regexp_extract(criteria, _ORDER, 2)).alias("order_property"),
            F.when(ordered, F.upper(F.regexp_extract(criteria, _ORDER, 3))).alias("order_direction"),
            F.when(limit == "", None).when(digits == "", 1).otherwise(digits.try_cast("int")).alias("row_limit"),
        ),
    )


def render_method(query: Column, table: Column) -> Column:
    """SQL-shaped text of a decoded method over ``table``; NULL stays NULL."""

    def shown(p, index):
        column = camel_to_snake(p["property"])
        left = F.when(p["ignore_case"], F.concat(F.lit("LOWER("), column, F.lit(")"))).otherwise(column)
        parameter = F.when(p["ignore_case"], "LOWER(?)").otherwise("?")
        text = F.replace(F.replace(_lookup(RENDERINGS, p["operator"]), F.lit("{p}"), parameter), F.lit("{l}"), left)
        return F.when(index == 0, text).otherwise(F.concat(F.lit("\n"), p["conjunction"], F.lit(" "), text))

    where = F.concat(F.lit("WHERE "), F.array_join(F.transform(query["predicates"], shown), ""))
    verb = query["operation"]
    head = (
        F.when(verb == "find", "SELECT *").when(verb == "count", "SELECT COUNT(*)")
        .when(verb == "exists", "SELECT 1").otherwise("DELETE")
    )
    finds = verb == "find"
    order = F.when(
        finds & query["order_property"].isNotNull(),
        F.concat(F.lit("\nORDER BY "), camel_to_snake(query["order_property"]), F.lit(" "), query["order_direction"]),
    ).otherwise("")
    limit = F.when(
        finds & query["row_limit"].isNotNull(),
        F.concat(F.lit("\nLIMIT "), query["row_limit"].cast("string")),
    ).otherwise("")
    return F.when(
        query.isNotNull(), F.concat(head, F.lit("\nFROM "), table, F.lit("\n"), where, order, limit)
    )
