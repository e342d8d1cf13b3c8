"""Structural facts of Java sources, as jobs over a token table.

Keys are ``(repo, path)``.  The file text is hashed once and exploded in place; the
windows below are keyed by one file.  ``level`` is the bracket nesting: between an
opening bracket and its partner no other token has the same level, so "the partner"
is the next row of the level.  Containment in spans joins on offset buckets, so a
point meets only the spans of its neighbourhood, never all of its file.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from stmtlens.functions import lexing as lx
from stmtlens.functions.brackets import structure
from stmtlens.functions.derived import decode_method, entity_table, render_method
from stmtlens.functions.paths import dirname
from stmtlens.operators.statements import _newlines, hash_spread
from stmtlens.session import cut_lineage

FILE = ("repo", "path")

# Fixed values of the Spring Data and JPA vocabulary.
REPOSITORY_BASES = (
    "Repository CrudRepository ListCrudRepository PagingAndSortingRepository "
    "ListPagingAndSortingRepository JpaRepository JpaSpecificationExecutor MongoRepository "
    "ReactiveCrudRepository ReactiveMongoRepository R2dbcRepository ElasticsearchRepository "
    "CassandraRepository KeyValueRepository QuerydslPredicateExecutor RevisionRepository"
).split()
LAZY_BY_DEFAULT = ("OneToMany", "ManyToMany")
EAGER_BY_DEFAULT = ("ManyToOne", "OneToOne")
# Methods of the Java library that call a lambda once per element, of collections and iterators, then of streams.
EACH_ELEMENT = ("forEach", "forEachOrdered", "forEachRemaining", "removeIf")
EACH_STREAM_ELEMENT = (
    "map flatMap filter peek mapToObj mapToInt mapToLong mapToDouble anyMatch allMatch "
    "noneMatch takeWhile dropWhile sorted collect reduce"
).split()
# The reserved keywords and literals of the Java Language Specification (3.9, 3.10), in its order.
RESERVED_WORDS = (
    "abstract assert boolean break byte case catch char class const continue default do double else enum extends "
    "final finally float for goto if implements import instanceof int interface long native new package private "
    "protected public return short static strictfp super switch synchronized this throw throws transient try void "
    "volatile while true false null"
).split()
# Those of them that are types (4.2), and void; the others begin no declaration's type and name nothing.
PRIMITIVE_TYPES = ("byte", "short", "int", "long", "char", "float", "double", "boolean", "void")
NO_TYPES = [w for w in RESERVED_WORDS if w not in PRIMITIVE_TYPES]
TYPE_WORDS = ("class", "interface", "enum", "record")
#: What the facts below read of the levels, besides calls, arrows, declarations and heads of types: these words wherever they stand.
READ = {"words": ("for", "while", "do", "package", "import", "Table", *LAZY_BY_DEFAULT, *EAGER_BY_DEFAULT)}

#: What is read of files with annotated queries: the annotations and their arguments.
QUERIES = {"inside": ("Query",)}


def _false(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


# --- tokens --------------------------------------------------------------------------------


_LOOKS = "pos int, off bigint, end bigint, line int, tok string, kind string"
#: Columns of a token; the neighbours are those of the file, whatever the brackets.
_TOKEN = (
    f"{_LOOKS}, depth bigint, braces bigint, p1 string, p2 string, p1kind string, p2kind string, n1 string, n1kind string, "
    "n2 string, break_line int, line_first_off bigint, above_end bigint"
)
#: Columns of a token in its bracket level.
_LEVEL = (
    f"{_LOOKS}, braces bigint, p1 string, p2 string, p1kind string, p2kind string, n1 string, n1kind string, n2 string, "
    "break_line int, line_first_off bigint, above_end bigint, level bigint, delim boolean, block int, block_tok string, seg bigint, "
    "l1 struct<tok:string,off:bigint,end:bigint,pos:int,line:int>, l2 struct<tok:string,off:bigint,end:bigint>, "
    "l3 struct<tok:string,off:bigint,line:int>, l4 struct<off:bigint>, "
    "b1 struct<tok:string,kind:string,pos:int,start_tok:string>, b2 struct<tok:string,pos:int>, b3 struct<tok:string>, "
    "angle bigint, start struct<off:bigint,line:int,p1:string>, "
    "term struct<pos:int,tok:string,off:bigint,delim:boolean,next_off:bigint>, part bigint, "
    "semi_end bigint, part_end bigint, live boolean, declares boolean, head boolean"
)


def _structure(files: DataFrame, columns: str, levels: bool, literals: bool, read: dict | None = None) -> DataFrame:
    """Texts are spread and lexed by Spark; brackets and neighbours are running sums over the tokens of a batch of files."""
    # Whether a file can repeat anything at all; a text without these words has no loop and no lambda.
    repeats = F.rlike("content", F.lit(r"\b(?:for|while|do)\b|->"))
    texts = hash_spread(files.select(*FILE, "content"), *FILE).select(
        *FILE, repeats.alias("repeats"), lx.java_pieces(F.col("content")).alias("pieces")
    )
    keys = (*FILE, "repeats")
    kept = ", ".join(f"{k} {texts.schema[k].dataType.simpleString()}" for k in keys)
    schema = StructType.fromDDL(f"{kept}, {columns}")
    return texts.mapInArrow(structure(to_arrow_schema(schema), keys, lx.JAVA_TRIVIA, levels, literals, tuple(NO_TYPES), TYPE_WORDS, read), schema)


def java_tokens(files: DataFrame, literals: bool = False, columns: str = _TOKEN) -> DataFrame:
    """``repo, path, pos, off, end, line, tok, kind, depth, braces`` and neighbours, or some of them.

    Comments never become tokens; string, character and text-block literals do only
    with ``literals``, and are never structure.  ``depth`` counts all open brackets,
    ``braces`` the curly ones; a pair shares the value outside it.
    """
    return _structure(files, columns, False, literals)


def java_levels(
    files: DataFrame, literals: bool = False, columns: tuple[str, ...] = (), read: dict[str, tuple[str, ...]] | None = None
) -> DataFrame:
    """Tokens by bracket level, cut into blocks, statements and comma parts; with all columns or some of them.
    All tokens, or those that the facts of this module read (``read=READ``, or ``QUERIES`` for annotations).

    ``block`` is the position of the enclosing opening bracket, ``seg`` numbers the
    statement (it ends with, and includes, ``;``, ``{`` or ``}``), ``part`` the piece
    between top-level commas.  ``term*`` describes the end of the statement, ``start*``
    its first token; ``l1..l4`` are the next tokens of the level and ``b1..b3`` those before.
    ``part_end`` is where the part ends, ``semi_end`` the end of the level's next ``;``.
    ``live`` rows come before a part's ``=`` or ``:``; ``declares`` marks parts with two names there, the last at its end, and nothing odd;
    ``head`` statements open a block and hold a word of a type declaration.
    """
    asked = [f for f in StructType.fromDDL(_LEVEL) if not columns or f.name in columns]
    return _structure(files, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in asked), True, literals, read)


# --- containment ------------------------------------------------------------------------------

_BUCKET = 4096


def _cell(at: str) -> Column:
    return F.floor(F.col(at) / _BUCKET)


def _cells(spans: DataFrame, start: str, end: str) -> DataFrame:
    return spans.withColumn("_cell", F.explode(F.sequence(_cell(start), _cell(end))))


def containing(points: DataFrame, spans: DataFrame) -> DataFrame:
    """Pairs of ``points(FILE, off, ...)`` and ``spans(FILE, start, end, ...)``, half open.

    Spans nest, so a point meets those that begin in its bucket and those around it.
    """
    return (
        points.withColumn("_cell", _cell("off"))
        .join(_cells(spans, "start", "end"), [*FILE, "_cell"])
        .filter((F.col("off") >= F.col("start")) & (F.col("off") < F.col("end")))
        .drop("_cell")
    )


def innermost(points: DataFrame, spans: DataFrame, keep: dict[str, str]) -> DataFrame:
    """``points`` (unique by file and ``off``) with columns of the shortest span around.

    ``keep`` maps span columns to output names; NULL where nothing contains the point.
    """
    span = spans.select(
        *FILE, F.col("start").alias("_lo"), F.col("end").alias("_hi"), F.struct(*[F.col(c).alias(n) for c, n in keep.items()]).alias("_s")
    )
    rest = [c for c in points.columns if c not in (*FILE, "off")]
    around = (F.col("off") >= F.col("_lo")) & (F.col("off") < F.col("_hi"))
    # The bucket is part of the grouping, so that the rows are grouped where they met.
    return (
        points.withColumn("_cell", _cell("off"))
        .join(_cells(span, "_lo", "_hi"), [*FILE, "_cell"], "left")
        .groupBy(*FILE, "_cell", "off")
        .agg(
            F.first(F.struct(F.lit(0).alias("_"), *rest)).alias("_p"),
            F.min_by("_s", F.when(around, F.struct(F.col("_hi") - F.col("_lo"), F.col("_lo")))).alias("_s"),
        )
        .select(*FILE, "off", *[F.col(f"_p.`{c}`") for c in rest], *[F.col(f"_s.`{n}`") for n in keep.values()])
    )


def enclosing(points: DataFrame, spans: DataFrame) -> DataFrame:
    """``FILE, off, nesting, loops``: all spans around a point, outermost first.

    ``spans`` are iterations; the array is as long as the nesting is deep.
    """
    entry = F.struct(
        (F.col("start") - F.col("end")).alias("order"), F.col("line").alias("iteration_line"),
        "iteration_kind", "element", "element_type", "iterable", "start", "end",
    )
    return (
        containing(points.select(*FILE, "off").distinct(), spans)
        .groupBy(*FILE, "off")
        .agg(F.count("*").alias("nesting"), F.sort_array(F.collect_list(entry)).alias("loops"))
    )


# --- text of spans ----------------------------------------------------------------------------

#: Characters of a piece of text.
_PIECE = 256


def text_pieces(files: DataFrame) -> DataFrame:
    """``FILE, pieces``: the text of each file in pieces of equal length, so that a place is found at once."""
    return files.select(*FILE, F.regexp_extract_all("content", F.lit(rf"(?s).{{1,{_PIECE}}}+"), F.lit(0)).alias("pieces"))


def with_texts(spans: DataFrame, pieces: DataFrame, **cuts: tuple[str, str]) -> DataFrame:
    """``spans`` with the text between two of their offset columns under each name; null without offsets.

    The spans of a file meet its pieces once, and each reads the pieces it covers: the work is that of
    the texts cut, whatever the file's length.  Files without spans are not read.
    """

    def cut(s, lo, hi):
        first, long = F.floor(s[lo] / _PIECE).cast("int"), F.greatest(s[hi] - s[lo], F.lit(0)).cast("int")
        covered = F.slice("pieces", first + 1, F.floor((s[lo] % _PIECE + long) / _PIECE).cast("int") + 1)
        return F.substring(F.array_join(covered, ""), (s[lo] % _PIECE).cast("int") + 1, long)

    rest = [c for c in spans.columns if c not in FILE]
    grouped = spans.groupBy(*FILE).agg(F.collect_list(F.struct(*rest)).alias("_spans"))
    read = F.transform("_spans", lambda s: F.struct(
        *(s[c].alias(c) for c in rest), *(F.when(s[lo].isNotNull() & s[hi].isNotNull(), cut(s, lo, hi)).alias(n) for n, (lo, hi) in cuts.items())
    ))
    return grouped.join(pieces, list(FILE)).select(*FILE, F.explode(read).alias("_s")).select(*FILE, "_s.*")


def one_line(text: Column) -> Column:
    """White space collapsed."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


# --- declarations --------------------------------------------------------------------------------


def java_types(levels: DataFrame) -> DataFrame:
    """One row per class, interface, enum, record with a body.

    ``name, kind, line, off, start, end, open_pos, member_braces, supertypes, first_argument,
    annotations``; the span is the body with its braces.
    """
    # The names of a statement that opens a block are gathered once; its type words are found among them.
    statements = levels.filter(~F.col("delim") & F.col("head") & (F.col("kind") == "name")).groupBy(*FILE, "level", "seg").agg(
        F.sort_array(F.collect_list(F.struct("pos", "tok", "line", "off", "angle", "braces", "p1", "n1", "n1kind"))).alias("_words"),
        F.first("term").alias("term"),
    )
    among = lambda word, words: word["tok"].isin(*words)
    keyword = lambda w: among(w, TYPE_WORDS) & ~_false(w["p1"] == ".") & _false(w["n1kind"] == "name")
    heads = statements.filter((F.col("term.tok") == "{") & ~F.col("term.delim") & F.col("term.next_off").isNotNull()).select(
        *FILE, "term", "_words", F.explode(F.filter("_words", keyword)).alias("_k")
    )
    clause = ("extends", "implements", "permits")
    after = F.filter("_words", lambda w: w["pos"] > F.col("_k.pos"))
    # From the first of these words on, names are types above.
    opens = F.get(F.filter(after, lambda w: among(w, clause)), F.lit(0))["pos"]
    above = F.filter(after, lambda w: (w["pos"] > F.col("_opens")) & ~among(w, clause))
    supers = F.filter("_above", lambda w: (w["angle"] == 0) & ~_false(w["n1"] == ".") & ~_false(w["p1"] == "@"))
    notes = F.filter("_words", lambda w: (w["pos"] < F.col("_k.pos")) & _false(w["p1"] == "@"))
    named = lambda words: F.coalesce(F.transform(words, lambda w: w["tok"]), F.array().cast("array<string>"))
    return heads.withColumn("_opens", opens).withColumn("_above", above).select(
        *FILE, F.col("_k.tok").alias("kind"), F.col("_k.n1").alias("name"), F.col("_k.line").alias("line"), F.col("_k.off").alias("off"),
        F.col("term.off").alias("start"), (F.col("term.next_off") + 1).alias("end"), F.col("term.pos").alias("open_pos"),
        (F.col("_k.braces") + 1).alias("member_braces"), named(supers).alias("supertypes"),
        F.get(F.filter("_above", lambda w: w["angle"] == 1), F.lit(0))["tok"].alias("first_argument"),
        named(notes).alias("annotations"),
    )


def java_methods(levels: DataFrame, types: DataFrame) -> DataFrame:
    """Methods and constructors: ``name, line, off, declaring_type, params_*, body_*, annotations``."""
    member = types.select(*FILE, F.col("member_braces").alias("braces")).distinct()
    has_body = (F.col("term.tok") == "{") & F.col("term.next_off").isNotNull()
    previous = F.col("p1")
    typed = ((F.col("p1kind") == "name") & ~previous.isin(*NO_TYPES)) | previous.isin(">", "]")
    rows = levels.filter(
        ~F.col("delim") & (F.col("kind") == "name") & ~F.col("tok").isin(*RESERVED_WORDS, *TYPE_WORDS)
        & _false(F.col("l1.tok") == "(") & _false(F.col("l2.tok") == ")") & F.col("p1").isNotNull()
        & ((F.col("term.tok") == ";") | has_body) & ~F.col("term.delim")
    ).select(*FILE, "off", "pos", "line", "tok", "level", "seg", "braces", "l1", "l2", "term", typed.alias("_typed"))
    # Most calls have no type before them; of these only such as bear a type's name can be constructors.
    named = types.select(*FILE, F.col("name").alias("tok")).distinct()
    rows = rows.filter("_typed").unionByName(rows.filter("not _typed").join(named, [*FILE, "tok"], "left_semi"))
    owned = innermost(rows.join(member, [*FILE, "braces"], "left_semi"), types, {"name": "declaring_type"})
    declared = owned.filter(_false(F.col("tok") == F.col("declaring_type")) | F.col("_typed"))
    return declared.select(
        *FILE, F.col("tok").alias("name"), "line", "off", "pos", "level", "seg", "declaring_type",
        F.col("l1.pos").alias("params_pos"), F.col("l1.off").alias("params_start"),
        (F.col("l2.off") + 1).alias("params_end"),
        F.when(has_body, F.col("term.off") + 1).alias("body_start"),
        F.when(has_body, F.col("term.next_off")).alias("body_end"),
        F.when(has_body, F.col("term.pos")).alias("body_pos"),
    )


def bodies(methods: DataFrame) -> DataFrame:
    return methods.filter(F.col("body_start").isNotNull()).select(
        *FILE, F.col("body_start").alias("start"), F.col("body_end").alias("end"), "name", "body_pos"
    )


def declared_variables(levels: DataFrame) -> DataFrame:
    """``<Type> <name>`` fragments: one row per comma part of a statement that is one.

    ``type, variable, level, block, seg, part, term_tok, start_line, start_p1, start_off,
    end_tok`` where ``end_tok`` is ``=``, ``:`` or NULL.
    """
    tok = F.col("tok")
    live = F.col("live")
    name = (
        live & (F.col("kind") == "name") & (F.col("angle") == 0) & ~tok.isin(*NO_TYPES)
        & ~_false(F.col("p1") == "@") & ~_false(F.col("n1") == ".")
    )
    found = levels.filter("declares").groupBy(*FILE, "level", "seg", "part").agg(
        F.max(F.when(live, F.col("block"))).alias("block"),
        F.first("start").alias("start"),
        F.first("term").alias("term"),
        F.min_by("tok", F.when(name, F.col("pos"))).alias("type"),
        F.max_by("tok", F.when(name, F.col("pos"))).alias("variable"),
        F.max(F.when(name, F.col("pos"))).alias("_var_pos"),
        F.max(F.when(live, F.col("pos"))).alias("_last_pos"),
        F.min_by("tok", F.when(tok.isin("=", ":") & (F.col("angle") == 0) & ~F.col("delim"), F.col("pos"))).alias("end_tok"),
        F.min(F.when(tok.isin("=", ":") & (F.col("angle") == 0) & ~F.col("delim"), F.col("end"))).alias("end_off"),
    )
    return found.filter(F.col("_var_pos") == F.col("_last_pos")).select(
        *FILE, "level", "seg", "part", "block", "type", "variable", "end_tok", "end_off",
        F.col("start.line").alias("start_line"), F.col("start.p1").alias("start_p1"),
        F.col("start.off").alias("start_off"), F.col("term.tok").alias("term_tok"),
        F.col("term.off").alias("term_off"), F.col("term.delim").alias("term_delim"),
    )


# --- loops ---------------------------------------------------------------------------------------


def java_iterations(levels: DataFrame, variables: DataFrame, pieces: DataFrame) -> DataFrame:
    """Bodies that run once per element: ``iteration_kind, start, end, line, element, element_type, iterable``.

    The header of a loop is never part of its body.
    """
    tok = F.col("tok")
    levels = levels.filter("repeats")
    code = levels.filter(~F.col("delim"))
    # A body without braces ends at the next `;` of its level.
    heads = code.filter(tok.isin("for", "while", "do") & (F.col("kind") == "name"))
    block_or_statement = lambda after, close: (
        F.when(F.col(f"{after}.tok") == "{", F.col(f"{after}.off") + 1).otherwise(F.col(f"{after}.off")),
        F.when(F.col(f"{after}.tok") == "{", F.col(f"{close}.off")).otherwise(F.col("semi_end")),
    )
    start_do, end_do = block_or_statement("l1", "l2")
    dos = heads.filter(tok == "do").select(
        *FILE, F.lit("do-while").alias("iteration_kind"), start_do.alias("start"), end_do.alias("end"), F.col("l1.line").alias("line"),
        F.lit(None).cast("int").alias("head_pos"),
    )
    start_for, end_for = block_or_statement("l3", "l4")
    # `while` right after a `do` body belongs to it.
    closes_do = _false((F.col("b1.tok") == "}") & (F.col("b2.tok") == "{") & (F.col("b3.tok") == "do"))
    loops = (
        heads.filter(
            tok.isin("for", "while")
            & _false(F.col("l1.tok") == "(") & _false(F.col("l2.tok") == ")")
        )
        .filter((tok == "for") | ~(closes_do | _false((F.col("b1.tok") == ";") & (F.col("b1.start_tok") == "do"))))
        .select(
            *FILE, tok.alias("iteration_kind"), start_for.alias("start"), end_for.alias("end"), F.col("l3.line").alias("line"),
            F.col("l1.pos").alias("head_pos"), F.col("l2.off").alias("head_end"),
        )
    )
    headers = variables.filter((F.col("end_tok") == ":") & (F.col("part") == 0)).select(
        *FILE, F.col("block").alias("head_pos"), F.col("variable").alias("element"),
        F.col("type").alias("element_type"),
    )
    colons = (
        code.filter((tok == ":") & (F.col("angle") == 0) & (F.col("block_tok") == "("))
        .groupBy(*FILE, F.col("block").alias("head_pos")).agg(F.min("end").alias("colon_end"))
    )
    enhanced = (
        loops.join(colons, [*FILE, "head_pos"], "left")
        .join(headers, [*FILE, "head_pos"], "left")
        .withColumn(
            "iteration_kind",
            F.when((F.col("iteration_kind") == "for") & F.col("colon_end").isNotNull(), "enhanced-for").otherwise(F.col("iteration_kind")),
        )
    )
    is_enhanced = F.col("iteration_kind") == "enhanced-for"
    shaped = enhanced.select(
        *FILE, "iteration_kind", "start", "end", "line",
        F.when(is_enhanced, F.col("element")).alias("element"),
        F.when(is_enhanced, F.col("element_type")).alias("element_type"),
        F.when(is_enhanced, F.col("colon_end")).alias("text_lo"),
        F.when(is_enhanced, F.col("head_end")).alias("text_hi"),
    )
    none = lambda t: F.lit(None).cast(t)
    blank = [none("string").alias("element"), none("string").alias("element_type"),
             none("long").alias("text_lo"), none("long").alias("text_hi")]
    spans = (
        shaped.unionByName(dos.select(*FILE, "iteration_kind", "start", "end", "line", *blank))
        .unionByName(_lambdas(levels))
        .filter(F.col("start").isNotNull() & F.col("end").isNotNull())
    )
    # Only the loops over elements show a part of the text.
    shown = with_texts(spans.filter(F.col("text_lo").isNotNull()), pieces, iterable=("text_lo", "text_hi"))
    plain = spans.filter(F.col("text_lo").isNull()).withColumn("iterable", none("string"))
    return shown.unionByName(plain).select(
        *FILE, "iteration_kind", "start", "end", "element", "element_type", F.col("line").cast("int").alias("line"),
        one_line(F.col("iterable")).alias("iterable"),
    )


def _lambdas(levels: DataFrame) -> DataFrame:
    """Lambdas whose consumer runs them once per element."""
    tok = F.col("tok")
    called = levels.filter(~F.col("delim") & (F.col("kind") == "name") & _false(F.col("l1.tok") == "("))
    opener = tok.isin("stream", "parallelStream") & _false(F.col("n1") == "(") & _false(F.col("n2") == ")")
    # Calls that could consume a lambda, with "was a stream opened earlier in this statement?".
    inside = W.partitionBy(*FILE, "level", "seg").orderBy("pos").rowsBetween(W.unboundedPreceding, -1)
    calls = (
        called.filter(opener | tok.isin(*EACH_ELEMENT, *EACH_STREAM_ELEMENT))
        .withColumn("_streamed", _false(F.max(opener).over(inside)))
        .filter(tok.isin(*EACH_ELEMENT, *EACH_STREAM_ELEMENT))
        .select(*FILE, F.col("l1.pos").alias("block"), F.col("tok").alias("method"), "_streamed")
    )
    arrows = (
        levels.filter((tok == "->") & ~F.col("delim") & (F.col("block_tok") == "("))
        .select(
            *FILE, "level", "block", "pos", "seg", "part", "b1", "b2", "l1", "l2",
            F.col("p1").alias("before"), F.col("part_end").alias("_stop"),
        )
    )
    admitted = arrows.join(calls, [*FILE, "block"]).filter(
        F.col("method").isin(*EACH_ELEMENT)
        | (F.col("method").isin(*EACH_STREAM_ELEMENT) & F.col("_streamed"))
    )
    parameter = F.when(F.col("b1.kind") == "name", F.col("b1.tok")).when(
        (F.col("before") == ")") & (F.col("b2.tok") == "("), F.lit(None)
    )
    # `(x) ->` and `(Type x) ->`: the one parameter inside the parentheses.
    inner = levels.filter(~F.col("delim") & (F.col("block_tok") == "(") & (F.col("kind") == "name") & (F.col("angle") == 0) & ~F.col("tok").isin(*NO_TYPES)).groupBy(
        *FILE, F.col("block").alias("_open")
    ).agg(F.max_by("tok", "pos").alias("_inner"), F.max("part").alias("_parts"))
    close_block = F.col("l1.tok") == "{"
    return (
        admitted.withColumn("_open", F.when(F.col("b1.tok") == ")", F.col("b2.pos")))
        .join(inner, [*FILE, "_open"], "left")
        .select(
            *FILE,
            F.when(F.col("method").isin(*EACH_ELEMENT), "lambda-for-each").otherwise("lambda-stream").alias("iteration_kind"),
            F.when(close_block, F.col("l1.off") + 1).otherwise(F.col("l1.off")).alias("start"),
            F.when(close_block, F.col("l2.off")).otherwise(F.col("_stop")).alias("end"), F.col("l1.line").alias("line"),
            F.coalesce(parameter, F.when(F.col("_parts") == 0, F.col("_inner"))).alias("element"),
            F.lit(None).cast("string").alias("element_type"),
            F.lit(None).cast("long").alias("text_lo"), F.lit(None).cast("long").alias("text_hi"),
        )
    )


# --- repositories and handles --------------------------------------------------------------------------


def repository_closure(types: DataFrame) -> DataFrame:
    """``repo, type_name``: interfaces that are repositories, up the hierarchy to a fixpoint.

    Never by name.  The links double: after a round they lead 2, 4, 8 .. levels up, and what is known
    reaches as far, so the rounds grow with the logarithm of the hierarchy's depth.  A round writes
    the types it found and the links of those still unknown; whether it found any reaches the driver.
    """
    interfaces = types.filter(F.col("kind") == "interface")
    direct = F.arrays_overlap("supertypes", F.array(*[F.lit(b) for b in REPOSITORY_BASES]))
    found = cut_lineage(
        interfaces.filter(direct | F.array_contains("annotations", "Repository"))
        .select("repo", F.col("name").alias("type_name")).distinct()
    )
    known = found
    links = cut_lineage(
        interfaces.select("repo", F.col("name").alias("type_name"), F.explode("supertypes").alias("parent"))
        .distinct().join(known, ["repo", "type_name"], "left_anti")
    )
    while True:
        found = cut_lineage(
            links.join(known.select("repo", F.col("type_name").alias("parent")), ["repo", "parent"], "left_semi")
            .select("repo", "type_name").distinct()
        )
        if found.isEmpty():
            return known
        known = known.unionByName(found)
        open_ = links.join(found, ["repo", "type_name"], "left_anti")
        # A type found just now still leads those below it on.
        farther = links.select("repo", F.col("type_name").alias("parent"), F.col("parent").alias("_above"))
        links = cut_lineage(
            open_.join(farther, ["repo", "parent"]).select("repo", "type_name", F.col("_above").alias("parent")).distinct()
        )


def java_handles(
    variables: DataFrame, types: DataFrame, methods: DataFrame, repositories: DataFrame, pieces: DataFrame
) -> DataFrame:
    """Fields, parameters and locals that hold a repository.

    ``identifier, repository_type, injection, line, start, end`` (the scope).
    """
    known = repositories.select("repo", F.col("type_name").alias("type"), F.lit(True).alias("_known"))
    variables = variables.join(known, ["repo", "type"], "left").withColumn(
        "_holds", F.col("_known").isNotNull() | F.col("type").endswith("Repository")
    )
    fields = (
        variables.filter(F.col("_holds") & (F.col("part") == 0) & (F.col("term_tok") == ";") & ~F.col("term_delim"))
        .join(types.select(*FILE, F.col("open_pos").alias("block"), "start", "end"), [*FILE, "block"])
        .select(*FILE, F.col("variable").alias("identifier"), F.col("type").alias("repository_type"),
                F.lit("field").alias("injection"), F.col("start_line").alias("line"), "start", "end")
    )
    owners = methods.filter(F.col("body_start").isNotNull()).select(
        *FILE, F.col("params_pos").alias("block"), F.col("line"), F.col("body_start").alias("start"),
        F.col("body_end").alias("end"),
        F.when(F.col("name") == F.col("declaring_type"), "constructor-parameter").otherwise("method-parameter").alias("injection"),
    )
    parameters = variables.filter(F.col("_holds") & F.col("end_tok").isNull()).join(owners, [*FILE, "block"]).select(
        *FILE, F.col("variable").alias("identifier"), F.col("type").alias("repository_type"),
        "injection", "line", "start", "end",
    )
    named = fields.unionByName(parameters)
    # Locals: the statement follows a `;` or opens the method body, as written.
    locals_ = with_texts(
        variables.filter(
            (F.col("end_tok") == "=") & (F.col("part") == 0) & F.col("start_p1").isin(";", "{")
            & (F.col("_holds") | (F.col("type") == "var"))
        ),
        pieces, _right=("end_off", "term_off"),
    ).withColumns({"_right": F.regexp_replace(one_line(F.col("_right")), r"\Athis\.", ""), "off": F.col("start_off")})
    inside = innermost(locals_, bodies(methods).withColumn("s", F.col("start")).withColumn("e", F.col("end")),
                       {"s": "start", "e": "end", "body_pos": "body_pos"}).filter(F.col("start").isNotNull())
    sources = named.groupBy(*FILE, F.col("identifier").alias("_right")).agg(
        F.max_by("repository_type", F.struct("injection", "line")).alias("_from")
    )
    local_handles = (
        inside.join(sources, [*FILE, "_right"], "left")
        .withColumn("repository_type", F.when(F.col("_holds"), F.col("type")).otherwise(F.col("_from")))
        .filter(F.col("repository_type").isNotNull())
        # `{` counts only when it opens the body itself.
        .filter((F.col("start_p1") == ";") | (F.col("block") == F.col("body_pos")))
        .select(*FILE, F.col("variable").alias("identifier"), "repository_type",
                F.lit("local-variable").alias("injection"), F.col("start_line").alias("line"), "start", "end")
    )
    return named.unionByName(local_handles)


def resolve_handles(points: DataFrame, handles: DataFrame) -> DataFrame:
    """Narrowest handle in scope: ``points(FILE, off, identifier)`` plus type and injection.

    Handles without a scope are known everywhere and come last.
    """
    named = handles.withColumnRenamed("identifier", "_id")
    scoped = containing(points, named.filter(F.col("start").isNotNull())).filter(F.col("identifier") == F.col("_id"))
    best = scoped.groupBy(*FILE, "off", "identifier").agg(
        F.min_by(F.struct("repository_type", "injection"), F.struct(F.col("end") - F.col("start"), "start")).alias("_h")
    )
    everywhere = named.filter(F.col("start").isNull()).groupBy(*FILE, F.col("_id").alias("identifier")).agg(
        F.first(F.struct("repository_type", "injection")).alias("_g")
    )
    return (
        points.join(best, [*FILE, "off", "identifier"], "left")
        .join(everywhere, [*FILE, "identifier"], "left")
        .withColumn("_h", F.coalesce("_h", "_g"))
        .select(*points.columns, "_h.repository_type", "_h.injection")
    )


# --- calls ---------------------------------------------------------------------------------------------


def _calls(levels: DataFrame) -> DataFrame:
    """``receiver.method(`` with its argument span."""
    return levels.filter(
        ~F.col("delim") & (F.col("kind") == "name") & ~F.col("tok").isin(*RESERVED_WORDS)
        & _false(F.col("l1.tok") == "(") & _false(F.col("l2.tok") == ")") & _false(F.col("p1") == ".")
        & _false(F.col("p2kind") == "name") & ~_false(F.col("p2") == "this")
    ).select(
        *FILE, "off", "line", F.col("tok").alias("method_name"), F.col("p2").alias("identifier"),
        (F.col("l1.end")).alias("args_lo"), F.col("l2.off").alias("args_hi"),
    )


def _placed(points: DataFrame, types: DataFrame, methods: DataFrame, iterations: DataFrame) -> DataFrame:
    """``points`` with their enclosing type, method and loops; each looked up by key."""
    keys = points.select(*FILE, "off").distinct()
    types_around = innermost(keys, types, {"name": "enclosing_type"})
    methods_around = innermost(keys, bodies(methods), {"name": "enclosing_method"})
    return (
        points.join(types_around, [*FILE, "off"], "left")
        .join(methods_around, [*FILE, "off"], "left")
        .join(enclosing(keys, iterations), [*FILE, "off"], "left")
    )


def call_sites(
    levels: DataFrame, types: DataFrame, methods: DataFrame, handles: DataFrame,
    iterations: DataFrame, repositories: DataFrame, pieces: DataFrame,
) -> DataFrame:
    """Calls on repository handles with the loops around them and their argument dependency."""
    # The calls that matter are few; from here on they are read three times.
    resolved = cut_lineage(
        resolve_handles(_calls(levels), handles).filter(F.col("repository_type").isNotNull())
    )
    known = repositories.select("repo", F.col("type_name").alias("repository_type"), F.lit(True).alias("_known"))
    rows = (
        _placed(with_texts(resolved, pieces, arguments=("args_lo", "args_hi")), types, methods, iterations)
        .join(known, ["repo", "repository_type"], "left")
        .withColumn("arguments", one_line(F.col("arguments")))
        .withColumn("resolution", F.when(F.col("_known"), "declared").otherwise("name-convention"))
    )
    return argument_dependency(rows).drop("_known", "args_lo", "args_hi")


def argument_dependency(sites: DataFrame) -> DataFrame:
    """Adds ``dependency`` and ``dependency_element`` from ``arguments`` and ``loops``.

    An element counts when it occurs as a whole name; the innermost such loop is named.
    """
    words = F.filter(
        F.regexp_extract_all("arguments", F.lit(lx.JAVA_PATTERN), F.lit(1)),
        lambda t: F.rlike(t, F.lit(r"\A[A-Za-z_$]")),
    )
    elements = F.filter(
        F.transform(F.reverse("loops"), lambda s: s["element"]),
        lambda e: e.isNotNull() & F.array_contains(F.col("_words"), e),
    )
    return (
        sites.withColumn("_words", words)
        .withColumn("dependency_element", F.when(F.col("arguments") != "", F.get(elements, F.lit(0))))
        .withColumn(
            "dependency",
            F.when(F.col("arguments") == "", "no-arguments")
            .when(F.col("dependency_element").isNotNull(), "loop-element-argument")
            .otherwise("independent"),
        )
        .drop("_words")
    )


def unresolved_types(sites: DataFrame, repositories: DataFrame) -> DataFrame:
    """``repo, repository_type``: receivers never declared as a repository."""
    return (
        sites.select("repo", "repository_type").distinct()
        .join(repositories.select("repo", F.col("type_name").alias("repository_type")), ["repo", "repository_type"], "left_anti")
    )


# --- entities ---------------------------------------------------------------------------------------------


def entity_tables(types: DataFrame, levels: DataFrame, pieces: DataFrame) -> DataFrame:
    """``repo, entity, table_name`` from ``@Entity`` with ``@Table(name = ..)``."""
    entities = types.filter(F.array_contains("annotations", "Entity")).select(
        *FILE, F.col("name").alias("entity"), F.col("start").alias("_body")
    )
    notes = levels.filter(
        ~F.col("delim") & (F.col("tok") == "Table") & _false(F.col("p1") == "@") & _false(F.col("l1.tok") == "(")
    ).select(*FILE, F.col("term.off").alias("_body"), F.col("l1.end").alias("lo"), F.col("l2.off").alias("hi"), "off")
    nearest = entities.join(notes, [*FILE, "_body"]).groupBy(*FILE, "entity", "_body").agg(
        F.max_by(F.struct("lo", "hi"), "off").alias("_n")
    )
    read = with_texts(nearest.select(*FILE, "entity", "_body", "_n.*"), pieces, text=("lo", "hi"), tail=("lo", "_body"))
    return (
        # a brace between the annotation and the body ends the search for it
        read.filter(~F.rlike(F.regexp_replace("tail", r'"[^"\n]*"', ""), F.lit("[{}]")))
        .withColumn("table_name", F.regexp_extract("text", r"""name\s*=\s*["']([^"']+)["']""", 1))
        .filter("table_name <> ''")
        .select("repo", "entity", "table_name")
    )


def entity_relations(types: DataFrame, levels: DataFrame, variables: DataFrame, pieces: DataFrame) -> DataFrame:
    """Lazy associations of entities: ``entity, field, accessor, association, line``."""
    entities = types.filter(F.array_contains("annotations", "Entity")).select(
        *FILE, F.col("name").alias("entity"), F.col("open_pos").alias("block")
    )
    fields = (
        variables.filter((F.col("part") == 0) & (F.col("term_tok") == ";") & ~F.col("term_delim"))
        .join(entities, [*FILE, "block"])
    )
    notes = levels.filter(
        ~F.col("delim") & F.col("tok").isin(*LAZY_BY_DEFAULT, *EAGER_BY_DEFAULT) & _false(F.col("p1") == "@")
    ).select(
        *FILE, "level", "seg", F.struct("pos", F.col("tok").alias("association"),
                                        F.when(F.col("l1.tok") == "(", F.col("l1.end")).alias("lo"),
                                        F.when(F.col("l1.tok") == "(", F.col("l2.off")).alias("hi")).alias("_n"),
    ).groupBy(*FILE, "level", "seg").agg(F.min("_n").alias("_n"))
    bare = lambda text: F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r'"[^"\n]*"', "")
    spans = fields.join(notes, [*FILE, "level", "seg"]).withColumns({"lo": F.col("_n.lo"), "hi": F.col("_n.hi")})
    joined = (
        with_texts(spans, pieces, _tail=("lo", "term_off"), _inner=("lo", "hi"))
        .withColumn("_braced", F.rlike(bare("_tail"), F.lit("[{}]")))
        .withColumn("_args", F.when(F.col("_braced"), "").otherwise(bare("_inner")))
    )
    association = F.col("_n.association")
    lazy = ~F.col("_args").contains("EAGER") & (association.isin(*LAZY_BY_DEFAULT) | F.col("_args").contains("LAZY"))
    return joined.filter(lazy).select(
        *FILE, "entity", F.col("variable").alias("field"),
        F.concat(F.lit("get"), F.upper(F.substring("variable", 1, 1)), F.expr("substring(variable, 2)")).alias("accessor"),
        association.alias("association"), F.col("start_line").alias("line"),
    )


def lazy_accesses(
    levels: DataFrame, types: DataFrame, methods: DataFrame, iterations: DataFrame, relations: DataFrame
) -> DataFrame:
    """``element.getX()`` in a loop whose element is declared as an entity with lazy X."""
    elements = (
        iterations.filter(F.col("element").isNotNull() & F.col("element_type").isNotNull())
        .groupBy(*FILE, F.col("element").alias("identifier"))
        .agg(F.max_by("element_type", "start").alias("entity"))
    )
    lazy = relations.groupBy("repo", "entity", F.col("accessor").alias("method_name")).agg(
        F.min(F.struct("path", "line", "field", "association")).alias("_r")
    ).select("repo", "entity", "method_name", "_r.field", "_r.association")
    hits = cut_lineage(
        _calls(levels).join(elements, [*FILE, "identifier"]).join(lazy, ["repo", "entity", "method_name"])
    )
    return (
        _placed(hits, types, methods, iterations)
        .filter(F.col("nesting").isNotNull())
        .drop("args_lo", "args_hi")
    )


# --- queries in Java ---------------------------------------------------------------------------------------


def _unescape(body: Column) -> Column:
    parts = F.regexp_extract_all(body, F.lit(r"\\[\s\S]|[^\\]+"), F.lit(0))
    return F.array_join(
        F.transform(
            parts,
            lambda p: F.when(p == "\\n", "\n").when(p == "\\r", "\r").when(p == "\\t", "\t")
            .when(p == "\\b", "\b").when(p == "\\f", "\f")
            .when(p.startswith("\\"), F.substring(p, 2, 1)).otherwise(p),
        ),
        "",
    )


def annotated_queries(files: DataFrame) -> DataFrame:
    """``@Query`` annotations: ``off, end, line, kind, text``; ``text`` NULL where unsupported.

    The value is the first argument that is one literal, alone or after ``value =``.
    """
    # Only files that mention the annotation are lexed with their literals.
    read = ("pos", "off", "tok", "kind", "line", "p1", "delim", "block", "block_tok", "part", "l1", "l2", "b1")
    tok = F.col("tok")
    levels = cut_lineage(java_levels(files.filter(F.rlike("content", F.lit(r"@\s*Query\b"))), literals=True, columns=read, read=QUERIES))
    heads = levels.filter(
        ~F.col("delim") & (tok == "Query") & _false(F.col("p1") == "@") & _false(F.col("l1.tok") == "(")
        & _false(F.col("l2.tok") == ")")
    ).select(
        *FILE, F.col("b1.pos").alias("at_pos"), F.col("l1.pos").alias("block"), F.col("l2.end").alias("end"), "off"
    )
    inside = levels.filter(~F.col("delim") & (F.col("block_tok") == "(")).join(heads.select(*FILE, "block"), [*FILE, "block"], "left_semi")
    args = inside.groupBy(*FILE, "block", "part").agg(
        F.sort_array(F.collect_list(F.when(tok != ",", F.struct("pos", "tok", "kind", "line")))).alias("_t")
    )
    size = F.size("_t")
    t = lambda i: F.get("_t", F.lit(i))
    literal = (
        F.when((size == 1) & (t(0)["kind"] == "literal"), t(0))
        .when((size == 3) & (t(0)["tok"] == "value") & (t(1)["tok"] == "=") & (t(2)["kind"] == "literal"), t(2))
    )
    native = (size == 3) & (t(0)["tok"] == "nativeQuery") & (t(1)["tok"] == "=") & (t(2)["tok"] == "true")
    read = args.withColumn("_lit", literal).withColumn("_lit", F.when(F.col("_lit.tok").startswith('"'), F.col("_lit"))).groupBy(*FILE, "block").agg(
        F.min_by("_lit", F.when(F.col("_lit").isNotNull(), F.col("part"))).alias("_lit"),
        F.max_by(_false(native), F.when((size == 3) & (t(0)["tok"] == "nativeQuery"), F.col("part"))).alias("_native"),
    )
    raw = F.col("_lit.tok")
    block = raw.startswith('"""')
    opening = F.rlike(raw, F.lit(r'\A"""\r?\n'))
    text = F.when(block, F.regexp_replace(raw, r'\A"""(?:\r?\n)?|"""\z', "")).otherwise(
        _unescape(F.regexp_replace(raw, r'\A"|"\z', ""))
    )
    return heads.join(read, [*FILE, "block"], "left").select(
        *FILE, (F.col("off") - 1).alias("off"), "end",
        (F.col("_lit.line") + F.when(block & opening, 1).otherwise(0)).cast("int").alias("line"),
        F.when(_false(F.col("_native")), "sql").otherwise("jpql").alias("kind"), text.alias("text"),
        # Lines of the source that the text goes on over: only a text block holds more than one.
        F.when(block, _newlines(text)).otherwise(0).alias("extent"),
    )


#: Stands for the table in a rendered query until it is known; no character of a Java name.
_TABLE_MARK = "\0"


def derived_methods(levels: DataFrame, types: DataFrame, annotated: DataFrame) -> DataFrame:
    """Query-by-name declarations in ``XRepository`` interfaces: ``off, line, symbol, text``.

    A declaration right below an ``@Query`` is not one.
    """
    calls = levels.filter(
        ~F.col("delim") & (F.col("kind") == "name")
        & F.rlike("tok", F.lit(r"\A(?:find|read|get|query|search|stream|count|exists|delete|remove)(?:First|Top)?\d*By\w+\z"))
        & _false(F.col("l1.tok") == "(") & _false(F.col("l2.tok") == ")") & _false(F.col("l3.tok") == ";")
        & (F.col("break_line").isNull() | (F.col("break_line") < F.col("line")))
    ).select(*FILE, "off", "line", F.col("tok").alias("symbol"), "line_first_off", "above_end")
    homes = types.filter((F.col("kind") == "interface") & F.rlike("name", F.lit(r"\A[A-Za-z][A-Za-z0-9]*Repository\z")))
    inside = innermost(calls, homes, {"name": "home"}).filter(F.col("home").isNotNull())
    free = inside.join(
        annotated.select(*FILE, F.col("end").alias("above_end")).distinct(), [*FILE, "above_end"], "left_anti"
    )
    # Names recur from file to file: each different one is decoded once, as that is by far the dearest step.
    names = free.select("symbol").distinct().withColumn("_q", decode_method(F.col("symbol"))).filter(F.col("_q").isNotNull())
    shown = names.select("symbol", render_method(F.col("_q"), F.lit(_TABLE_MARK)).alias("_shown"))
    return free.join(shown, "symbol").select(
        *FILE, F.col("line_first_off").alias("off"), "line", "symbol",
        F.replace("_shown", F.lit(_TABLE_MARK), entity_table(F.col("home"))).alias("text"),
    )


def java_queries(files: DataFrame, levels: DataFrame, types: DataFrame) -> DataFrame:
    """All queries a Java file declares, in source order: ``id, ordinal, kind, line, symbol, text, extent``."""
    annotated = annotated_queries(files)
    none = F.lit(None).cast("string")
    rows = annotated.filter(F.col("text").isNotNull()).select(
        *FILE, "off", "line", "kind", none.alias("symbol"), "text", "extent"
    ).unionByName(
        derived_methods(levels, types, annotated).select(
            *FILE, "off", "line", F.lit("spring_data_derived").alias("kind"), "symbol", "text", F.lit(0).alias("extent")
        )
    )
    order = W.partitionBy(*FILE).orderBy("off", F.col("symbol").isNotNull())
    return rows.withColumn("ordinal", F.row_number().over(order)).withColumn(
        "id", F.concat(F.col("path"), F.lit(":"), F.coalesce("symbol", F.col("ordinal").cast("string")))
    ).drop("off")


def method_queries(methods: DataFrame, types: DataFrame, queries: DataFrame, repositories: DataFrame) -> DataFrame:
    """Repository methods with the query declared between the previous member and them.

    An as-of lookup: queries and methods are merged by line and each query goes to the
    next method at or below it.
    """
    homes = types.join(repositories.select("repo", F.col("type_name").alias("name")), ["repo", "name"], "left_semi").select(
        *FILE, F.col("name").alias("declaring_type"), F.col("line").alias("type_line")
    )
    members = methods.join(homes, [*FILE, "declaring_type"]).select(
        *FILE, "declaring_type", "name", "line", "off", "type_line"
    )
    order = W.partitionBy(*FILE, "declaring_type").orderBy("line", "off")
    members = members.withColumn("previous_line", F.coalesce(F.lag("line").over(order), F.col("type_line")))
    method_rows = members.filter(F.col("previous_line") < F.col("line")).select(
        *FILE, "line", F.struct("line", "off", "previous_line").alias("_m"), F.lit(None).cast("string").alias("query_id")
    )
    per_line = queries.groupBy(*FILE, "line").agg(F.max_by("id", "ordinal").alias("query_id"))
    merged = method_rows.unionByName(
        per_line.select(*FILE, "line", F.lit(None).cast(method_rows.schema["_m"].dataType).alias("_m"), "query_id")
    )
    # Below first: at one line the method precedes the query, so it is seen when the query is reached.
    down = W.partitionBy(*FILE).orderBy(F.col("line").desc(), F.col("_m").isNull()).rowsBetween(W.unboundedPreceding, W.currentRow)
    assigned = (
        merged.withColumn("_next", F.last("_m", ignorenulls=True).over(down))
        .filter(F.col("query_id").isNotNull() & (F.col("line") > F.col("_next.previous_line")))
        .groupBy(*FILE, F.col("_next.line").alias("line"), F.col("_next.off").alias("off"))
        .agg(F.min_by("query_id", "line").alias("query_id"))
    )
    return members.join(assigned, [*FILE, "line", "off"], "left").select(
        *FILE, F.col("declaring_type").alias("repository_type"), "name", "line", "off", "query_id"
    )


# --- imports ------------------------------------------------------------------------------------------------


def package_imports(levels: DataFrame, pieces: DataFrame) -> DataFrame:
    """``FILE, word, name, off`` of package and import declarations."""
    heads = levels.filter(
        ~F.col("delim") & F.col("tok").isin("package", "import") & ~_false(F.col("p1") == ".") & (F.col("term.tok") == ";")
    ).select(*FILE, "tok", "off", "end", F.col("term.off").alias("stop"))
    words = F.filter(F.regexp_extract_all("text", F.lit(r"[A-Za-z_$][A-Za-z0-9_$]*|\*"), F.lit(0)), lambda w: w != "static")
    return with_texts(heads, pieces, text=("end", "stop")).select(
        *FILE, F.col("tok").alias("word"), F.array_join(words, ".").alias("name"), "off"
    ).filter("name <> ''")


def import_paths(wanted: DataFrame, declared: DataFrame) -> DataFrame:
    """``wanted(FILE, type_name)`` plus ``import_path``: where the type's file should be.

    The root is the file's directory minus its package; NULL where the package is
    missing or no suffix of it.
    """
    package = declared.filter(F.col("word") == "package").groupBy(*FILE).agg(F.max_by("name", "off").alias("package"))
    imports = declared.filter(F.col("word") == "import").select(
        *FILE, F.regexp_extract("name", r"([^.]*)\z", 1).alias("type_name"), "name", "off"
    ).groupBy(*FILE, "type_name").agg(F.min_by("name", "off").alias("_import"))
    joined = wanted.join(package, list(FILE), "left").join(imports, [*FILE, "type_name"], "left")
    suffix = F.replace("package", F.lit("."), F.lit("/"))
    folder = dirname(F.col("path"))
    fits = F.col("package").isNotNull() & F.col("path").contains("/") & folder.endswith(suffix)
    root = F.substring(folder, F.lit(1), F.length(folder) - F.length(suffix))
    same = F.concat(root, suffix, F.lit("/"), "type_name", F.lit(".java"))
    target = F.when(
        F.col("_import").isNotNull(), F.concat(root, F.replace("_import", F.lit("."), F.lit("/")), F.lit(".java"))
    ).when(same != F.col("path"), same)
    return joined.withColumn("import_path", F.when(fits, target)).drop("package", "_import")


# --- everything at once ---------------------------------------------------------------------------------------


class JavaFacts:
    """The shared tables of ``files(repo, path, content)``, each written when first asked for.

    Every later step reads several of them, so they are tables in the shared folder:
    text is lexed once, and a lost executor costs no second lexing.
    """

    def __init__(self, files: DataFrame):
        self.files = files

    @cached_property
    def pieces(self) -> DataFrame:
        return cut_lineage(text_pieces(self.files))

    @cached_property
    def levels(self) -> DataFrame:
        return cut_lineage(java_levels(self.files, read=READ))

    @cached_property
    def types(self) -> DataFrame:
        return cut_lineage(java_types(self.levels))

    @cached_property
    def methods(self) -> DataFrame:
        return cut_lineage(java_methods(self.levels, self.types))

    @cached_property
    def variables(self) -> DataFrame:
        return cut_lineage(declared_variables(self.levels))

    @cached_property
    def repositories(self) -> DataFrame:
        return repository_closure(self.types)

    @cached_property
    def iterations(self) -> DataFrame:
        return cut_lineage(java_iterations(self.levels, self.variables, self.pieces))

    @cached_property
    def handles(self) -> DataFrame:
        return cut_lineage(
            java_handles(self.variables, self.types, self.methods, self.repositories, self.pieces)
        )

    @cached_property
    def relations(self) -> DataFrame:
        return entity_relations(self.types, self.levels, self.variables, self.pieces)

    @cached_property
    def sites(self) -> DataFrame:
        return call_sites(
            self.levels, self.types, self.methods, self.handles, self.iterations,
            self.repositories, self.pieces,
        )

    @cached_property
    def lazy(self) -> DataFrame:
        return lazy_accesses(self.levels, self.types, self.methods, self.iterations, self.relations)

    @cached_property
    def queries(self) -> DataFrame:
        return cut_lineage(java_queries(self.files, self.levels, self.types))
