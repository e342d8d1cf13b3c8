import random
import time

import pytest
from pyspark.sql import functions as F

from stmtlens.functions import derived as de
from stmtlens.functions import paths as pa
from stmtlens.operators import java as jv
from stmtlens.session import cut_lineage


def facts(spark, **sources):
    rows = [("r", f"src/{name}.java", text) for name, text in sources.items()]
    return jv.JavaFacts(spark.createDataFrame(rows, "repo string, path string, content string"))


def service(body):
    return "class S {\n private final OrderRepository repo;\n void run(java.util.List<Long> ids, Map<Long, X> m) {\n" + body + "\n }\n}\n"


BODIES = {
    "a_for": ("for (Long id : ids) { repo.findById(id); }", [("enhanced-for", "loop-element-argument")]),
    "b_header": ("for (X x : repo.findAll()) { x.y(); }", [(None, "no-arguments")]),
    "c_comment": ("for (Long id : ids) { /* repo.findById(id); */ }", []),
    "d_string": ('for (Long id : ids) { log("repo.findById(id)"); }', []),
    "e_optional": ("opt.map(id -> repo.findById(id));", [(None, "independent")]),
    "f_stream": ("ids.stream().map(id -> repo.findById(id)).toList();", [("lambda-stream", "loop-element-argument")]),
    "g_callback": ("executor.submit(() -> repo.findById(3L));", [(None, "independent")]),
    "h_each": ("ids.forEach((Long id) -> { repo.findById(id); });", [("lambda-for-each", "loop-element-argument")]),
    "i_two": ("m.forEach((k, v) -> repo.findById(k));", [("lambda-for-each", "independent")]),
    "j_substring": ("for (Long id : ids) { repo.findById(idx); }", [("enhanced-for", "independent")]),
    "k_while": ("while (repo.next()) { go(); }", [(None, "no-arguments")]),
    "l_do": ("do { repo.find(1); } while (more());", [("do-while", "independent")]),
    "m_after": ("for (Long id : ids) { go(id); }\n repo.findAll();", [(None, "no-arguments")]),
    "n_reference": ("ids.forEach(repo::findById);", []),
    "o_other": ("for (Long id : ids) { helper.findById(id); }", []),
    "p_this": ("for (Long id : ids) this.repo.findById(id);", [("enhanced-for", "loop-element-argument")]),
    "q_statement_bound": ("ids.stream().count(); opt.map(id -> repo.findById(id));", [(None, "independent")]),
}


def test_call_sites(spark):
    f = facts(spark, **{k: service(b) for k, (b, _) in BODIES.items()})
    got = {k: [] for k in BODIES}
    for r in f.sites.orderBy("path", "off").collect():
        inner = r.loops[-1].iteration_kind if r.loops else None
        got[r.path[4:-5]].append((inner, r.dependency))
    assert {k: v for k, v in got.items() if v != BODIES[k][1]} == {}
    assert {r.repository_type for r in jv.unresolved_types(f.sites, f.repositories).collect()} == {"OrderRepository"}


def test_nesting_outermost_first(spark):
    f = facts(spark, S=service("for (A a : as) {\n for (B b : bs) {\n repo.find(a, b); } }"))
    row = f.sites.first()
    assert [l.element for l in row.loops] == ["a", "b"] and row.nesting == 2 and row.dependency_element == "b"


def test_scopes(spark):
    f = facts(spark, S="class Outer {\n OrderRepository repo;\n void a() { repo.x(); }\n static class Inner {\n"
                       " UserRepository repo;\n void b() { repo.y(); }\n }\n}\n")
    assert {(r.method_name, r.repository_type, r.enclosing_type) for r in f.sites.collect()} == {
        ("x", "OrderRepository", "Outer"), ("y", "UserRepository", "Inner")
    }


def test_query_annotations(spark):
    f = facts(spark, R='interface ARepository extends JpaRepository<A, Long> {\n'
                       '  @Query(value = "select \\"a\\"\\n", nativeQuery = true) A x();\n'
                       '  @Query("one" + "two") A y();\n  // @Query("no")\n'
                       '  @Query\n  A z();\n  List<A> findByB(int b);\n'
                       '  @Query("q")\n  List<A> findByC(int c);\n}\n')
    rows = f.queries.orderBy("ordinal").collect()
    assert [(r.ordinal, r.line, r.kind, r.text) for r in rows] == [
        (1, 2, "sql", 'select "a"\n'),
        (2, 7, "spring_data_derived", "SELECT *\nFROM a\nWHERE b = ?"),
        (3, 8, "jpql", "q"),
    ]


def test_relations_need_lazy(spark):
    f = facts(spark, E="@Entity class E {\n @OneToMany(fetch = FetchType.EAGER) List<A> a;\n @OneToOne B b;\n"
                       " @OneToOne(fetch = LAZY) C c;\n @ManyToMany Set<D> d;\n}\nclass N { @OneToMany List<A> a; }\n")
    assert {r.accessor for r in f.relations.collect()} == {"getC", "getD"}


@pytest.mark.parametrize(
    ("name", "text"),
    [
        ("findByAAndBOrC", "SELECT *\nFROM t\nWHERE a = ?\nAND b = ?\nOR c = ?"),
        ("findFirst5ByAOrderByBDesc", "SELECT *\nFROM t\nWHERE a = ?\nORDER BY b DESC\nLIMIT 5"),
        ("findByAIgnoreCase", "SELECT *\nFROM t\nWHERE LOWER(a) = LOWER(?)"),
        ("findDistinctByA", None),
        ("findByAOrderByB", None),
        ("save", None),
    ],
)
def test_derived(spark, name, text):
    df = spark.createDataFrame([(name,)], "n string")
    assert df.select(de.render_method(de.decode_method(F.col("n")), F.lit("t"))).first()[0] == text


@pytest.mark.parametrize(
    ("pattern", "path", "hit"),
    [
        ("**/test/**", "src/test/a.sql", True), ("**/test/**", "test/a.sql", True), ("*.sql", "a/b.sql", False),
        ("/db/*.sql", "db/x.sql", True), ("a?.sql", "a/.sql", False), ("db/**", "db/x/y.sql", True), ("a.sql", "axsql", False),
    ],
)
def test_globs(spark, pattern, path, hit):
    df = spark.createDataFrame([(pattern, path)], "g string, p string")
    assert df.select(F.rlike("p", pa.glob_to_regex(F.col("g")))).first()[0] is hit


def test_normpath(spark):
    cases = [("a/../b", "b"), ("./a//b/", "a/b"), ("../a/../../b", "../../b"), ("/../a", "/a"), ("", "."), ("a/..", ".")]
    df = spark.createDataFrame(cases, "p string, want string")
    assert [r for r in df.withColumn("got", pa.normpath(F.col("p"))).collect() if r.got != r.want] == []


def test_deep_hierarchies_take_few_rounds(spark, monkeypatch):
    """A chain of 150 interfaces, cycles, and random links, against a walk; rounds follow the logarithm."""
    pick = random.Random(3)
    links = {("chain", f"C{i}"): [f"C{i - 1}"] for i in range(1, 150)} | {("chain", "C0"): ["JpaRepository"]}
    links |= {("chain", "X"): ["Y"], ("chain", "Y"): ["X"], ("other", "C5"): ["C4"]}
    links |= {("mesh", f"M{i}"): [f"M{pick.randrange(60)}" for _ in range(pick.randint(0, 2))] for i in range(1, 60)}
    links[("mesh", "M7")] = ["CrudRepository", "M9"]
    rows = [(repo, "p", name, "interface", ups, []) for (repo, name), ups in links.items()] + [("mesh", "p", "M0", "interface", [], ["Repository"])]
    types = spark.createDataFrame(rows, "repo string, path string, name string, kind string, supertypes array<string>, annotations array<string>")
    known = {("chain", "C0"), ("mesh", "M7"), ("mesh", "M0")}
    while more := {k for k, ups in links.items() if any((k[0], u) in known for u in ups)} - known:
        known |= more
    written = []
    monkeypatch.setattr(jv, "cut_lineage", lambda df: written.append(1) or cut_lineage(df))
    got = [(r.repo, r.type_name) for r in jv.repository_closure(types).collect()]
    assert sorted(got) == sorted(known) and len(written) <= 2 * 9 + 2


def test_span_texts_are_the_files_own(spark):
    text = "a é😀\n\t" * 200 + "end"
    spans = [(lo, lo + n) for lo in (0, 1, 255, 256, 257, 700) for n in (0, 1, 2, 255, 256, 300)] + [(len(text) - 3, len(text))]
    files = spark.createDataFrame([("r", "p", text), ("r", "q", "")], "repo string, path string, content string")
    asked = spark.createDataFrame([("r", "p", *s) for s in spans] + [("r", "p", None, 5)], "repo string, path string, lo int, hi int")
    got = {(r.lo, r.hi): r.t for r in jv.with_texts(asked, jv.text_pieces(files), t=("lo", "hi")).collect()}
    assert got == {(lo, hi): text[lo:hi] for lo, hi in spans} | {(None, 5): None}


def test_span_texts_take_time_in_line_with_the_file(spark):
    """Ten thousand calls in a file of 0.5 and in one of 5 MB: ten times the text, not a hundred times the work."""
    seconds = {}
    for size in (500_000, 5_000_000):
        text, step = "x" * size, size // 10_000
        files = spark.createDataFrame([("r", "p", text)], "repo string, path string, content string")
        pieces = cut_lineage(jv.text_pieces(files))
        asked = spark.range(10_000).selectExpr("'r' AS repo", "'p' AS path", f"id * {step} AS lo", f"id * {step} + 40 AS hi")
        began = time.time()
        assert jv.with_texts(asked, pieces, t=("lo", "hi")).filter("length(t) = 40").count() == 10_000
        seconds[size] = time.time() - began
    assert seconds[5_000_000] < 10 * max(seconds[500_000], 1)


def test_brackets_and_neighbours_of_a_file_that_does_not_balance(spark):
    """Neighbours stay in the file, levels go on after a stray bracket, and a null text has no tokens."""
    rows = [("r", "a", "f(a, /* ; */ b);\n} g[1]"), ("r", "b", "x"), ("r", "n", None), ("r", "e", " // x")]
    files = spark.createDataFrame(rows, "repo string, path string, content string")
    inner = jv.java_levels(files).filter("path = 'a' and level = 1").orderBy("pos").collect()
    assert [(r.tok, r.delim, r.block, r.seg, r.part, r.line, r.off, r.part_end) for r in inner] == [
        ("(", True, 2, 0, 0, 1, 1, 1), ("a", False, 2, 1, 0, 1, 2, 3), (",", False, 2, 1, 0, 1, 3, 3), ("b", False, 2, 1, 1, 1, 13, 14),
        (")", True, 2, 1, 1, 1, 14, 14),
    ]
    tokens = {(r.path, r.pos): r for r in jv.java_tokens(files).collect()}
    assert [tokens["a", n].tok for n in range(1, 13)] == ["f", "(", "a", ",", "b", ")", ";", "}", "g", "[", "1", "]"]
    assert (tokens["a", 12].n1, tokens["b", 1].p1, tokens["b", 1].n1) == (None, None, None)
    assert [tokens["a", n].depth for n in (1, 2, 3, 6, 7, 8, 9, 11)] == [0, 0, 1, 0, 0, -1, -1, 0]


def test_levels_of_one_large_file(spark):
    """A file of 100,000 tokens on one level; by windows over its statements it took more than three minutes."""
    text = "class A { void f() { int x = 1; } }\n" * 6000
    files = spark.createDataFrame([("r", "p", text)], "repo string, path string, content string")
    levels = cut_lineage(jv.java_levels(files))
    began = time.time()
    assert jv.java_types(levels).count() == 6000
    assert [r.variable for r in jv.declared_variables(levels).select("variable").distinct().collect()] == ["x"]
    assert levels.filter("not delim and tok = 'x'").agg(F.max("line")).first()[0] == 6000
    assert time.time() - began < 60


def test_names_are_decoded_once_whatever_their_number(spark):
    """Ten thousand equal declarations: one decoding of the name, not one for each."""
    body = "".join(f"List<A> findByBAndC{n % 2 or ''}(int b);\n" for n in range(10_000))
    f = facts(spark, R="interface ARepository extends JpaRepository<A, Long> {\n" + body + "}\n", Q="interface BRepository {\nA findByB(int b);\n}\n")
    rows = f.queries.groupBy("text").count().collect()
    assert {(r.text.replace("\n", " "), r["count"]) for r in rows} == {
        ("SELECT * FROM a WHERE b = ? AND c = ?", 5000), ("SELECT * FROM a WHERE b = ? AND c1 = ?", 5000), ("SELECT * FROM b WHERE b = ?", 1)
    }


def test_only_the_tokens_that_facts_read_are_written(spark):
    """Every fact is the same from all tokens, on whole files and on files cut anywhere, and most tokens are not written."""
    whole = {
        "S": service("".join(f"{b}\n" for b, _ in BODIES.values()) + "int a = 1, b[] = {2}; var x = repo; Map<K, List<V>> m2 = of(); x: for (;;) a--;"),
        "E": "package a.b;\nimport static c.D.*;\n@Entity @Table(name = \"e\") class E<T extends F> extends G<H> implements I, J.K {\n"
             "@OneToMany List<A> a;\n@ManyToOne(fetch = FetchType.LAZY) private B b, c;\n@Deprecated(since = \"1\") int f(final int... z) throws X { return z; }\n}",
        "R": "@Repository interface ARepository extends JpaRepository<A, Long> {\n@Query(\"q\")\nA x();\nA findByB(int b); default A g() { return findByC(1); }\n}",
    }
    pick = random.Random(5)
    cut = {f"{k}{n}": t[pick.randrange(len(t) // 2):][: pick.randrange(len(t))] for k, t in whole.items() for n in range(20)}
    read = facts(spark, **whole, **cut)
    assert read.levels.count() < jv.java_levels(read.files).count() / 2
    every = jv.JavaFacts(read.files)
    every.__dict__["levels"] = cut_lineage(jv.java_levels(read.files))
    tables = lambda f: {
        **{n: getattr(f, n) for n in ("types", "methods", "variables", "repositories", "iterations", "handles", "relations", "sites", "lazy", "queries")},
        "entities": jv.entity_tables(f.types, f.levels, f.pieces), "imports": jv.package_imports(f.levels, f.pieces),
    }
    some, all_ = tables(read), tables(every)
    rows = {n: (sorted(map(repr, some[n].collect())), sorted(map(repr, all_[n].collect()))) for n in some}
    assert {n for n, (a, b) in rows.items() if a != b} == set()
    assert {n for n, (a, _) in rows.items() if not a} <= {"lazy"}


def test_arguments_are_not_written_but_parameters_of_lambdas_are(spark):
    """Of what stands in parentheses only the parameters before an arrow are read, and of a type's head only the names."""
    f = facts(spark, S="class S<T> extends B<T> {\n void f(int n) {\n for (X x : xs) go(a, b, c);\n m.forEach((k, v) -> h(k + d));\n ids.stream().map((Y y) -> y);\n }\n}\n")
    rows = {r.tok: r for r in f.levels.filter("not delim").collect()}
    assert not {"a", "b", "c", "d", "<", "{"} & set(rows) and {"k", "v", "y", "Y", "x", "X", "S", "B", "T"} <= set(rows)
    assert rows["go"].b1 is None and rows["S"].l1 is None and rows["->"].b1.tok == ")" and rows["->"].p2 is None
    assert sorted((r.iteration_kind, r.element) for r in f.iterations.collect() if r.element) == [("enhanced-for", "x"), ("lambda-stream", "y")]
    assert [(r.name, r.supertypes, r.first_argument) for r in f.types.collect()] == [("S", ["B"], "T")]


def test_a_call_named_like_a_type_around_it_stays_a_candidate(spark):
    """Constructors have no type before them; calls of other names without one are left out before they meet the types."""
    f = facts(spark, S="class S {\n S() { }\n int n = go();\n S other() { return null; }\n class I { I(int a) { go(); } S of(); }\n}\n")
    assert sorted((r.name, r.declaring_type) for r in f.methods.collect()) == [("I", "I"), ("S", "S"), ("of", "I"), ("other", "S")]
