"""One record per statement with all that the rules read: facts, operands of comparisons, tables, projections.

The text is read once and moved once.  Windows over a statement's tokens (by number) and over its levels
(by level and number) describe each token by its neighbours; one grouping then gathers a statement's
comparisons, the marks that end operands and the beginnings of names as arrays in order, where the
neighbour of an element is the element beside it.  A statement's text was one cell, and its arrays hold
a few numbers a token.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stmtlens.functions import lexing as lx
from stmtlens.operators import statements as st


def _gathered(condition: Column, *fields) -> Column:
    """The rows that meet ``condition`` as an array of structs in the order of their fields."""
    return F.array_sort(F.collect_list(F.when(condition, F.struct(*fields))))


def _level_tokens(queries: DataFrame, key: str, carry: tuple[str, ...]) -> DataFrame:
    """Tokens by nesting level; each bracket also delimits the level inside it.

    Every row carries the codes of the next five tokens *of its level*, the running number of column names
    over the whole statement and that of runs over the level, so that operands are described by two
    positions and never collected.  A run is a name with all its parts (``a.b.c``), however many, or any
    other single token.
    """
    tokens = st.sql_tokens(queries, key, carry=carry)
    running = W.partitionBy(key).orderBy("_n").rowsBetween(W.unboundedPreceding, W.currentRow)
    opener, joins, outer = st.section_marks()
    counted = tokens.withColumns(
        {
            "section": F.last(F.when(opener, F.col("u")), ignorenulls=True).over(running),
            "outer_join": F.last(F.when(joins, outer), ignorenulls=True).over(running),
            "n_columns": F.sum(st.names_column().cast("int")).over(running),
            "cast_of_column": st.cast_of_column(),
        }
    )
    bracket = F.col("tok").isin("(", ")")
    rows = counted.withColumn(
        "level", F.explode(F.when(bracket, F.array(F.col("depth"), F.col("depth") + 1)).otherwise(F.array("depth")))
    ).withColumn("delimiter", F.col("level") != F.col("depth"))
    rows = rows.withColumn("code", F.when(F.col("delimiter"), F.lit("|")).otherwise(F.col("code")))
    order = W.partitionBy(key, "level").orderBy("_n")
    before = order.rowsBetween(W.unboundedPreceding, W.currentRow)
    dot = (F.col("tok") == ".") & ~F.col("delimiter")
    near = rows.withColumns(
        {
            "lpos": F.row_number().over(order),
            "ahead": F.concat(*[F.coalesce(F.lead("code", i).over(order), F.lit("|")) for i in range(1, 6)]),
            "opens_run": ~(dot | F.coalesce(F.lag(dot, 1).over(order), F.lit(False))),
            "last": F.struct("tok", "code", F.lag("tok", 2).over(order).alias("qualifier"), F.lag("code", 2).over(order).alias("qualifier_code")),
            "t1": F.lead("tok", 1).over(order),
            "off1": F.lead("off", 1).over(order),
            "inner_bare": F.lead("cast_of_column", 2).over(order),
            "prev_end": F.lag("end", 1).over(order),
            "prev_u": F.lag("u", 1).over(order),
            "prev2_u": F.lag("u", 2).over(order),
            "lclause": F.last(st.level_clause(), ignorenulls=True).over(before),
        }
    )
    return near.withColumns(
        {
            "n_runs": F.sum(F.col("opens_run").cast("int")).over(before),
            "prev_last": F.lag("last", 1).over(order),
            "prev2_clause": F.lag("lclause", 2).over(order),
            "closes": F.lead("lpos", 1).over(order).isNull(),
        }
    )


def _beside(array: str, *steps: int) -> Column:
    """Elements ``m`` with those some steps away (``b1``, ``b2``, ``n1``, ``n2``) on the same level."""

    def joined(m, i):
        other = lambda step: F.get(F.col(array), i + step)
        names = {-2: "b2", -1: "b1", 1: "n1", 2: "n2"}
        return F.struct(m.alias("m"), *(F.when(other(s)["level"] == m["level"], other(s)).alias(names[s]) for s in steps))

    return F.transform(array, joined)


def _predicates() -> Column:
    """Comparisons, IN, BETWEEN and LIKE with both operands described, from the marks in order.

    For each side: ``*_shape`` (codes of its own-level tokens), ``*_len``, ``*_qualifier``/``*_name`` (bare
    columns), ``*_has_column``, ``*_lo``/``*_hi`` (text offsets) and ``*_token``.  The level's last token
    stands in for a mark that isn't there.
    """
    ops = F.filter(_beside("_marks", -2, -1, 1), lambda x: x["m"]["is_op"])

    def bounded(x):
        m, after = x["m"], x["n1"]
        negated = F.coalesce(m["prev_u"] == "NOT", F.lit(False))
        mark = F.coalesce(after["mark"], F.lit(False))
        # `x NOT IN (...)`: NOT stands between the operand and the operator.
        return F.struct(
            m.alias("m"), negated.alias("negated"), F.when(negated, x["b2"]).otherwise(x["b1"]).alias("start"),
            F.when(negated, x["b1"]).otherwise(m).alias("stop"),
            F.when(mark, after["prev_end"]).when(after.isNotNull(), after["end"]).otherwise(m["end"]).alias("right_hi"),
            F.coalesce(after["lpos"] - m["lpos"] - mark.cast("int"), F.lit(0)).alias("right_len"),
            F.coalesce(after["n_runs"] - m["n_runs"] - mark.cast("int"), F.lit(0)).alias("right_runs"),
            F.coalesce(after["n_columns"] > m["n_columns"], F.lit(False)).alias("right_has_column"),
            F.when(mark, after["prev_last"]).when(after.isNotNull(), after["last"]).otherwise(m["last"]).alias("right_tail"),
        )

    def sized(x):
        start, stop = x["start"], x["stop"]
        zero = F.lit(0)
        return F.struct(
            x.alias("x"),
            # Before the first mark of a level stands nothing.
            (stop["lpos"] - F.coalesce(start["lpos"], zero) - 1).alias("left_len"),
            (stop["n_runs"] - F.coalesce(start["n_runs"], zero) - 1).alias("left_runs"),
            (x["m"]["n_columns"] > F.coalesce(start["n_columns"], zero)).alias("left_has_column"),
            F.substring(start["ahead"], F.lit(1), F.greatest(F.least(stop["lpos"] - F.coalesce(start["lpos"], zero) - 1, F.lit(5)), zero)).alias("left_shape"),
            F.substring(x["m"]["ahead"], F.lit(1), F.greatest(F.least(x["right_len"], F.lit(5)), zero)).alias("right_shape"),
        )

    def side(prefix, at, tail, n, runs, shape, hi, has_column):
        # One name, with as many parts as it likes.
        bare = (runs == 1) & shape.startswith("c") & (tail["code"] == "c")
        fields = {
            "shape": shape, "ahead": at["ahead"], "len": n, "token": at["t1"], "name": F.when(bare, tail["tok"]),
            "qualifier": F.when(bare & (n >= 3) & (tail["qualifier_code"] == "c"), tail["qualifier"]),
            "inner_bare": F.coalesce(at["inner_bare"], F.lit(False)), "lo": at["off1"], "hi": hi, "has_column": has_column,
        }
        return [c.alias(f"{prefix}_{name}") for name, c in fields.items()]

    def described(y):
        x = y["x"]
        m, stop = x["m"], x["stop"]
        return F.struct(
            m["pos"].alias("pos"), m["u"].alias("u"), m["section"].alias("section"), m["outer_join"].alias("outer_join"),
            *side("left", x["start"], stop["prev_last"], y["left_len"], y["left_runs"], y["left_shape"], stop["prev_end"], y["left_has_column"]),
            *side("right", m, x["right_tail"], x["right_len"], x["right_runs"], y["right_shape"], x["right_hi"], x["right_has_column"]),
        )

    return F.transform(F.transform(F.transform(ops, bounded), sized), described)


def _table_entries() -> Column:
    """(alias, pos, table_name): every name a table goes by, in that order; a table is its own alias."""
    starts = F.filter(_beside("_runs", 1, 2), lambda x: x["m"]["starts"])

    def ended(x):
        m, after = x["m"], x["n1"]
        runs = F.coalesce(after["opens_run"], F.lit(False))
        return F.struct(
            m["pos"].alias("pos"), m["prev_u"].alias("prev_u"), F.when(runs, after).alias("next"),
            F.when(F.coalesce(x["n2"]["opens_run"], F.lit(False)), x["n2"]).alias("next2"),
            F.when(runs, after["prev_last"]).when(after.isNotNull(), after["last"]).otherwise(m["last"]).alias("last"),
        )

    # `FROM series(..)` is a call; `USING (..)` of a join is a column list.
    tables = F.filter(F.transform(starts, ended), lambda x: ~((x["last"]["code"] == "f") & (x["prev_u"] != "INTO")))

    def named(x):
        alias = F.when(x["next"]["code"] == "c", x["next"]["tok"]).when(
            (F.upper(x["next"]["tok"]) == "AS") & (x["next2"]["code"] == "c"), x["next2"]["tok"]
        )
        table = st.unquote_name(x["last"]["tok"])
        entry = lambda name: F.struct(F.lower(name).alias("alias"), x["pos"].alias("pos"), table.alias("table_name"))
        return F.when(alias.isNull(), F.array(entry(table))).otherwise(F.array(entry(table), entry(st.unquote_name(alias))))

    return F.array_sort(F.flatten(F.transform(tables, named)))


def _last_of_each_alias() -> Column:
    """Of the entries of one alias the last counts."""
    keep = F.transform(
        "_entries",
        lambda e, i: F.struct(e.alias("e"), F.coalesce(F.get(F.col("_entries"), i + 1)["alias"] != e["alias"], F.lit(True)).alias("last")),
    )
    return F.transform(F.filter(keep, lambda x: x["last"]), lambda x: F.struct(x["e"]["alias"].alias("alias"), x["e"]["table_name"].alias("table_name")))


def _all_aggregates() -> Column:
    """Every root projection is one aggregate call; null without a projection."""
    blank = F.lit(None).cast("string")
    start = F.struct(
        F.lit(None).cast("boolean").alias("all"), F.lit(0).alias("n"), *(blank.alias(c) for c in ("first", "second", "last", "last_kind", "before_last"))
    )

    def closed(a):
        call = (
            a["first"].isin(lx.AGGREGATE_FUNCTIONS) & (a["second"] == "(")
            & ((a["n"] == 3) | ((a["n"] == 4) & a["last_kind"].isin("name", "quoted")) | ((a["n"] == 5) & (a["before_last"] == "AS")))
        )
        return F.when(a["n"] == 0, a["all"]).otherwise(F.coalesce(a["all"], F.lit(True)) & F.coalesce(call, F.lit(False)))

    def step(a, t):
        fresh = F.struct(closed(a).alias("all"), F.lit(0).alias("n"), *(blank.alias(c) for c in ("first", "second", "last", "last_kind", "before_last")))
        more = F.struct(
            a["all"].alias("all"), (a["n"] + 1).alias("n"), F.when(a["n"] == 0, t["u"]).otherwise(a["first"]).alias("first"),
            F.when(a["n"] == 0, t["n1"]).otherwise(a["second"]).alias("second"), t["u"].alias("last"), t["kind"].alias("last_kind"),
            t["p1"].alias("before_last"),
        )
        return F.when(t["tok"] == ",", fresh).otherwise(more)

    return F.aggregate("_projection", start, step, closed)


def table_of(qualifier: Column) -> Column:
    """The table of a record that a column with this qualifier (or none) belongs to; null where unknown."""
    tables = F.transform("aliases", lambda a: a["table_name"])
    only = F.when(F.array_min(tables) == F.array_max(tables), F.array_min(tables))
    named = F.filter("aliases", lambda a: a["alias"] == F.lower(st.unquote_name(qualifier)))
    return F.when(qualifier.isNotNull(), F.get(named, F.lit(0))["table_name"]).otherwise(only)


def table_aliases(records: DataFrame, key: str = "qid") -> DataFrame:
    """``key, alias, table_name``: every table and alias of the whole statement.

    ``alias`` is lower-cased, ``table_name`` as written; a table is its own alias.
    """
    return records.select(key, F.explode("aliases").alias("_a")).select(key, "_a.*")


def statement_records(queries: DataFrame, key: str = "qid", carry: tuple[str, ...] = ("kind",)) -> DataFrame:
    """One row per statement: ``key``, the carried columns, the clause facts, ``owned``, ``predicates``,
    ``aliases``, ``all_aggregates``, ``has_star``, ``n_tokens`` and ``text``.

    ``queries(key, text, dialect, carry)``.  One scan and one exchange; what a caller doesn't select is
    not gathered.
    """
    rows = _level_tokens(queries, key, carry)
    is_op, ends = st.operand_marks()
    mark = is_op | ends
    real = ~F.col("delimiter")
    star = (F.col("tok") == "*") & (
        F.col("p1").isin("SELECT", "DISTINCT", "ALL", ",", ".")
        | ((F.col("p2") == "TOP") & F.rlike("p1", F.lit(r"\A\d")))
    )
    projected = real & (F.col("depth") == 0) & (F.col("section") == "SELECT") & (
        ~F.col("u").isin("SELECT", "DISTINCT", "ALL") | (F.col("kind") != "word")
    )
    grouped = rows.groupBy(key).agg(
        *([F.first("carried").alias("carried")] if carry else []),
        *st.clause_aggregates(),
        _gathered(
            mark | F.col("closes"), "level", "pos", mark.alias("mark"), is_op.alias("is_op"), "u", "section", "outer_join", "prev_u", "end",
            "prev_end", "last", "prev_last", "lpos", "n_columns", "n_runs", "ahead", "t1", "off1", "inner_bare",
        ).alias("_marks"),
        _gathered(
            F.col("opens_run") | F.col("closes"), "level", "pos", "opens_run", (F.col("opens_run") & F.coalesce(st.starts_table(), F.lit(False))).alias("starts"),
            "tok", "code", "prev_u", "last", "prev_last",
        ).alias("_runs"),
        _gathered(projected, "pos", "tok", "u", "kind", "n1", "p1").alias("_projection"),
        _gathered(real, "_n", "_piece").alias("_pieces"),
        # `COUNT(ALL *)` and `COUNT(DISTINCT *)` are calls, not projections.
        F.bool_or(F.coalesce(star, F.lit(False)) | ((F.col("pos") == 1) & (F.col("u") == "FROM"))).alias("has_star"),
    )
    facts = st.clause_columns(grouped).withColumns(
        {
            "owned": st.owns_clauses(F.col("_first"), F.col("_main"), F.col("is_set_operation")),
            "predicates": _predicates(),
            "_entries": _table_entries(),
            "all_aggregates": _all_aggregates(),
            "n_tokens": F.size("_pieces"),
            "text": F.array_join(F.transform("_pieces", lambda p: p["_piece"]), ""),
        }
    )
    return facts.withColumn("aliases", _last_of_each_alias()).select(
        key, *(F.col(f"carried.{c}").alias(c) for c in carry), *st.CLAUSE_FACTS, "owned", "predicates", "aliases", "all_aggregates", "has_star",
        "n_tokens", "text",
    )
