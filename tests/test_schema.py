from stmtlens.operators import schema as sc
from stmtlens.sources.changelog import scan_changelogs

HEAD = "<databaseChangeLog>"
TAIL = "</databaseChangeLog>"


def build(spark, **files):
    rows = [("r", name.replace("__", "/") + ".xml", HEAD + text + TAIL) for name, text in files.items()]
    scan = scan_changelogs(spark.createDataFrame(rows, "repo string, path string, content string"))
    roots = spark.createDataFrame([("r", "root.xml")], "repo string, root string")
    return {r.table_name: (r.indexed_columns, r.column_types) for r in sc.schema_from_changelogs(roots, scan).collect()}


def table(name, *columns):
    return f'<createTable tableName="{name}">' + "".join(f'<column name="{c}" type="int"/>' for c in columns) + "</createTable>"


def index(name, *columns, drop=False):
    if drop:
        return f'<dropIndex tableName="t" indexName="{name}"/>'
    return f'<createIndex tableName="t" indexName="{name}">' + "".join(f'<column name="{c}"/>' for c in columns) + "</createIndex>"


def change(*ops):
    return "<changeSet>" + "".join(ops) + "</changeSet>"


def test_drop_one_of_two_covering_indexes(spark):
    got = build(spark, root=change(table("t", "a", "b"), index("i", "a"), index("j", "a", "b"), index("i", drop=True)))
    assert got["t"][0] == ["a"]


def test_drop_then_recreate_and_drop_before_create(spark):
    got = build(spark, root=change(index("k", drop=True), table("t", "a"), index("i", "a"), index("i", drop=True), index("i", "b"), index("k", "a")))
    assert got["t"][0] == ["a", "b"]


def test_property_applies_only_forward(spark):
    add = lambda c: change(f'<addColumn tableName="t"><column name="{c}" type="${{x}}"/></addColumn>')
    got = build(spark, root=add("a") + '<property name="x" value="int"/>' + add("b") + '<property name="x" value="text"/>' + add("c"))
    assert got["t"][1] == {"a": "${x}", "b": "int", "c": "text"}


def test_include_runs_where_it_stands(spark):
    got = build(
        spark,
        root=change(table("t", "a"), index("i", "a")) + '<include file="sub/b.xml"/>' + change(index("i", "b")),
        sub__b='<include file="../root.xml" relativeToChangelogFile="true"/>' + change(index("i", drop=True)),
    )
    assert got["t"][0] == ["b"]


def test_missing_include_means_no_schema(spark):
    assert build(spark, root=change(table("t", "a")) + '<include file="gone.xml"/>') == {}


def test_raw_sql_names_no_table(spark):
    assert build(spark, root=change("<sql>CREATE TABLE t (a int)</sql>")) == {}


def test_a_property_that_most_columns_use(spark):
    """Each use takes the last definition before it; a hot name is a join key, no window's partition."""
    rows = [("r", "p", i, [i], "${hot} " + ("${cold}" if i % 7 == 0 else "${none}")) for i in range(20_000)]
    uses = spark.createDataFrame(rows, "repo string, root string, row_id int, order_key array<int>, type string")
    defined = spark.createDataFrame(
        [("r", "p", "hot", f"v{at}", [at]) for at in (10, 5000, 12000)] + [("r", "p", "cold", "c", [15000]), ("x", "p", "none", "n", [0])],
        "repo string, root string, name string, value string, order_key array<int>",
    )
    out = sc.substitute_properties(uses, defined)
    assert "Window" not in out._jdf.queryExecution().executedPlan().toString()
    last = lambda i: next((f"v{at}" for at in (12000, 5000, 10) if at <= i), "${hot}")
    want = {i: f"{last(i)} {('c' if i >= 15000 else '${cold}') if i % 7 == 0 else '${none}'}" for i in range(20_000)}
    assert {r.row_id: r.type for r in out.collect()} == want
