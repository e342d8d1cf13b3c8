"""Config, changelog and schema queries.  Input: files written from ``customer``."""

from __future__ import annotations

from pyspark.sql import functions as F

from stmtlens.catalog import corpus
from stmtlens.catalog.base import fill, pick, spread, sql_values, table
from stmtlens.functions import paths as pa
from stmtlens.operators import schema as sc
from stmtlens.session import cut_lineage
from stmtlens.sources import config as cf
from stmtlens.sources.changelog import scan_changelogs
from stmtlens.sources.corpus import apply_run_dialect, relabel_queries


def _k():
    return F.col("c_custkey")


def _repo():
    return F.concat(F.lit("c"), _k().cast("string")).alias("repo")


_PROPERTIES = [
    "spring.datasource.url=jdbc:mysql://h/db{k}\ndb.liquibase.change-log=classpath:/db/changelog/root{k}.xml\n",
    "# jdbc:oracle:thin\nurl: jdbc:h2:mem:x\n! c\nname = 'n{k}'\nname=m{k}\n",
    "url=JDBC:PostgreSQL://h\n db.liquibase.change-log = \"src/main/resources/x/../root{k}.xml\"\n",
    "//jdbc:mysql:\nurl=jdbc:sqlserver://h\ndb.liquibase.change-log=\n",
    "a=1\r\nb:2=3\r\n=skip\r\nplain\r\n  c = \"q{k}'\r\n",
    "u=jdbc:h2:mem;x=jdbc:mariadb://h\ndb.liquibase.change-log=db\\root{k}.xml",
]
_ENTRIES = sql_values(
    [
        (0, "spring.datasource.url", "jdbc:mysql://h/db{k}"),
        (0, "db.liquibase.change-log", "classpath:/db/changelog/root{k}.xml"),
        (1, "url", "jdbc:h2:mem:x"), (1, "name", "m{k}"),
        (2, "url", "JDBC:PostgreSQL://h"),
        (2, "db.liquibase.change-log", "src/main/resources/x/../root{k}.xml"),
        (3, "//jdbc", "mysql:"), (3, "url", "jdbc:sqlserver://h"), (3, "db.liquibase.change-log", ""),
        (4, "a", "1"), (4, "b", "2=3"), (4, "c", "\"q{k}'"),
        (5, "u", "jdbc:h2:mem;x=jdbc:mariadb://h"), (5, "db.liquibase.change-log", "db\\root{k}.xml"),
    ],
    "t, key, value",
)
_YAML = [
    "db:\n  liquibase:\n    change-log: classpath:/db/changelog/root{k}.xml # c\n  url: jdbc:oracle:thin\n",
    "db.liquibase.change-log: 'other{k}.xml'\n",
    "db:\n  # c\n  liquibase:\n    - change-log: no\n  other:\n    change-log: nope\n",
    "db:\n  liquibase:\n    enabled: true\n    change-log: \"a#b{k}.xml\"\nspring:\n  url: jdbc:mariadb://x\n",
    "liquibase:\n  change-log: top{k}.xml\n",
]


def customers(spark, folder):
    return spread(table(spark, folder, "customer").select("c_custkey"), "c_custkey")


def configs(spark, folder):
    c = customers(spark, folder)
    first = F.struct(
        F.lit("src/main/resources/application.properties").alias("path"),
        fill(pick(_k(), _PROPERTIES), k=_k()).alias("content"),
    )
    second = F.struct(
        pick(_k(), ["svc/src/main/resources/bootstrap.yml", "application.yaml"]).alias("path"),
        fill(pick(_k(), _YAML), k=_k()).alias("content"),
    )
    return c.select(_repo(), F.explode(F.array(first, second)).alias("_f")).select("repo", "_f.*")


def config_kv(spark, folder):
    files = configs(spark, folder).filter(F.col("path").endswith(".properties"))
    return cf.config_entries(files).select("repo", "key", "value")


def changed_paths(spark, folder):
    return customers(spark, folder).select(
        _repo(), F.when(_k() % 3 == 0, "svc/src/main/java/A.java").otherwise("src/main/java/B.java").alias("path")
    )


def _dialects(spark, folder):
    c = configs(spark, folder)
    return cf.detect_dialect(c, cf.config_candidates(changed_paths(spark, folder), c))


def dialect(spark, folder):
    return _dialects(spark, folder)


_DIALECT = """
WITH dialects AS (
  SELECT 'c' || c_custkey AS repo, CASE
    WHEN c_custkey % 6 = 0 THEN 'mysql' WHEN c_custkey % 6 = 2 THEN 'postgres' WHEN c_custkey % 6 = 3 THEN 'tsql'
    WHEN c_custkey % 2 = 1 OR c_custkey % 3 = 0 THEN
      CASE c_custkey % 5 WHEN 0 THEN 'oracle' WHEN 3 THEN 'mysql' END END AS run_dialect
  FROM customer)
"""


def label(spark, folder):
    """One source per customer, and one query extracted as the default or as mysql."""
    c = customers(spark, folder)
    d = _dialects(spark, folder)
    sources = c.select(_repo(), pick(_k(), ["a.sql", "B.SQL", "C.java"]).alias("path"))
    queries = c.select(_repo(), pick(_k(), ["postgres", "tsql"]).alias("dialect"))
    return (
        apply_run_dialect(sources, d).select("repo", F.col("path"), F.col("dialect").alias("source_dialect"))
        .join(relabel_queries(queries, d).withColumnRenamed("dialect", "query_dialect"), "repo")
    )


def discovery(spark, folder):
    c = configs(spark, folder)
    return sc.discover_changelog(c, c)


# --- changelogs ----------------------------------------------------------------------------

_NS = 'xmlns="http://www.liquibase.org/xml/ns/dbchangelog"'
_ROOT = (
    f'<databaseChangeLog {_NS}>\n<property name="text.type" value="varchar({{k}})"/>\n'
    '<include file="a.xml" relativeToChangelogFile="true"/>\n'
    '<property name="text.type" value="clob"/>\n<include file="sub/b.xml"{rel}/>\n'
    '<changeSet id="9" author="x"><sql>DROP TABLE t</sql><dropIndex tableName="t" indexName="ix_drop"/>'
    "{extra}</changeSet>\n</databaseChangeLog>"
)
_A = (
    f'<databaseChangeLog {_NS}>{{cycle}}<changeSet id="1" author="x">\n'
    '<preConditions><not/></preConditions><createTable tableName="t">'
    '<column name="id" type="bigint"><constraints primaryKey="true"/></column>'
    '<column name="email" type="${text.type}"/><column name="note" type="${unknown}"/></createTable>'
    '<createIndex tableName="t" indexName="ix_email"><column name="email"/><column name="id"/></createIndex>'
    '<createIndex tableName="t" indexName="ix_drop"><column name="note"/></createIndex>'
    '<addUniqueConstraint tableName="t" columnNames=" note , id"/>'
    '<dropIndex tableName="t" indexName="never_made"/></changeSet></databaseChangeLog>'
)
_B = (
    '<databaseChangeLog><include file="../a.xml" relativeToChangelogFile="true"/>{missing}'
    '<changeSet id="2"><addColumn tableName="t"><column name="bio" type="${text.type}"/></addColumn>'
    '<createTable tableName="u{k}"><column name="x" type="int"><constraints unique="true"/></column>'
    "</createTable></changeSet></databaseChangeLog>"
)
_OTHER = '<databaseChangeLog><changeSet id="1"><sql>SELECT {k}</sql></changeSet></databaseChangeLog>'


def changelog_files(spark, folder):
    """Per customer: a root, two included files, sometimes a lone one, a POM, a broken file."""
    file = lambda path, text, seq, when=None: F.when(
        F.lit(True) if when is None else when,
        F.struct(F.lit(path).alias("path"), text.alias("content"), F.lit(seq).alias("seq")),
    )
    text = lambda t, **kw: fill(F.lit(t), k=_k(), **kw)
    mark = lambda cond, yes: F.when(cond, yes).otherwise("")
    files = F.array(
        file("db/root.xml", text(
            _ROOT, rel=mark(_k() % 5 == 0, ' relativeToChangelogFile=" TRUE "'),
            extra=mark(_k() % 2 == 0, '<dropIndex tableName="t" indexName="ix_email"/>')), 1),
        file("db/a.xml", text(_A, cycle=mark(_k() % 3 == 2, '<include file="root.xml" relativeToChangelogFile="true"/>')), 2),
        file("db/sub/b.xml", text(_B, missing=mark(_k() % 3 == 1, '<include file="gone.xml"/>')), 3),
        file("legacy/other-ChangeLog.xml", text(_OTHER), 4, _k() % 2 == 0),
        file("pom.xml", F.lit("<project/>"), 5),
        file("broken.xml", F.lit("<databaseChangeLog>"), 6),
    )
    return customers(spark, folder).select(
        _repo(), F.explode(F.filter(files, lambda f: f.isNotNull())).alias("_f")
    ).select("repo", "_f.*")


def _scan(spark, folder):
    """Scanned once and kept in the shared folder: the include walk reads it per round."""
    return cut_lineage(scan_changelogs(changelog_files(spark, folder)))


def _roots(spark, folder):
    return customers(spark, folder).select(_repo(), F.lit("db/root.xml").alias("root"))


def changelog_scan(spark, folder):
    return _scan(spark, folder).groupBy("op", "path").agg(
        F.count("*").alias("n"), F.sum(F.size("columns")).alias("n_columns")
    )


def include_order(spark, folder):
    return sc.include_order(_roots(spark, folder), _scan(spark, folder)).select(
        "repo", "path", F.array_join(F.transform("order_key", lambda i: i.cast("string")), ".").alias("order_key")
    )


def substitute(spark, folder):
    scan = _scan(spark, folder)
    order = sc.include_order(_roots(spark, folder), scan)
    ops = sc.ordered_operations(order, scan)
    typed = sc.column_events(ops).withColumn("row_id", F.to_json(F.struct("table_name", "order_key")))
    properties = ops.filter("op = 'property'").select("repo", "root", "name", "value", "order_key")
    return sc.substitute_properties(typed, properties).select("repo", "table_name", "column", "type")


def schema_rows(spark, folder):
    built = sc.schema_from_changelogs(_roots(spark, folder), scan_changelogs(changelog_files(spark, folder)))
    return built.select(
        "repo", "table_name", F.array_join("indexed_columns", ",").alias("indexed_columns"),
        F.array_join(
            F.array_sort(F.transform(F.map_entries("column_types"), lambda e: F.concat(e["key"], F.lit(":"), e["value"]))), ","
        ).alias("column_types"),
    )


def _part_events(spark, folder):
    p = table(spark, folder, "part")
    k = F.col("p_partkey")
    return p.select(
        F.col("p_brand").alias("repo"), F.lit("db/root.xml").alias("root"),
        F.concat(F.lit("t"), (F.col("p_size") % 10).cast("string")).alias("table_name"),
        F.concat(F.lit("ix"), (k % 3).cast("string")).alias("index_name"),
        F.when(k % 5 < 3, "create").otherwise("drop").alias("kind"),
        F.when(k % 5 < 3, F.array(F.lower("p_type"), F.lit("id"))).otherwise(F.array().cast("array<string>")).alias("columns"),
        F.lower("p_type").alias("column"), F.concat(F.lit("v"), k.cast("string")).alias("type"),
        F.array(k).alias("order_key"),
    )


def index_state(spark, folder):
    return sc.index_state(_part_events(spark, folder)).select(
        "repo", "table_name", "index_name", F.get("columns", F.lit(0)).alias("leading")
    )


def column_state(spark, folder):
    return sc.column_state(_part_events(spark, folder)).select("repo", "table_name", "column", "type")


def lookup(spark, folder):
    """Ask for two columns of each part's table, and for an unknown table."""
    p = table(spark, folder, "part").select("p_partkey")
    k = F.col("p_partkey").cast("string")
    asked = p.select(
        F.explode(F.array(
            F.struct(F.concat(F.lit("t"), k).alias("table_name"), F.lit("EMAIL").alias("column")),
            F.struct(F.concat(F.lit("T"), k).alias("table_name"), F.lit("nope").alias("column")),
            F.struct(F.concat(F.lit("x"), k).alias("table_name"), F.lit("id").alias("column")),
        )).alias("_a")
    ).select("_a.*")
    return sc.schema_lookup(asked, corpus.corpus_schema(spark, folder)).select(
        "table_name", "column", F.array_join("indexed_columns", ",").alias("indexed_columns"), "column_type"
    )


def touch(spark, folder):
    o = table(spark, folder, "orders").select("o_orderkey", "o_custkey")
    k = F.col("o_orderkey")
    repo = F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("repo")
    changed = o.select(
        repo, k.alias("pr"), pick(k, ["db/a.xml", "db/sub/b.xml", "db/zzz.xml", "src/A.java"]).alias("path")
    )
    scan = _scan(spark, folder)
    order = sc.include_order(_roots(spark, folder), scan)
    good = sc.loadable_roots(order, scan).filter("loadable")
    tree = order.join(good.select("repo", "root"), ["repo", "root"], "left_semi")
    return sc.changelog_touch(changed, tree, o.select(repo, k.alias("pr")))


def root_scoring(spark, folder):
    # The files are parsed once; their flags and what they include are read from the table.
    scan = cut_lineage(scan_changelogs(sc.xml_files(changelog_files(spark, folder))))
    return sc.pick_root(sc.score_roots(scan), _roots(spark, folder))


def precedence(spark, folder):
    c = customers(spark, folder)
    k = _k()
    runs = c.select(_repo(), (k % 7).alias("pr"))
    explicit = c.filter(k % 4 == 0).select(_repo(), F.lit("e.xml").alias("root"))
    touched = c.select(_repo(), (k % 7).alias("pr"), (k % 8 == 0).alias("touches"))
    found = c.select(
        _repo(), pick(k, ["discovered", "not_found", "ambiguous"]).alias("status"),
        F.when(k % 3 == 0, "d.xml").alias("changelog_path"),
    )
    scored = c.select(_repo(), F.when(k % 5 < 3, "s.xml").alias("changelog_path"))
    state = lambda root, s, ok: F.struct(F.lit(root).alias("root"), F.lit(s).alias("state"), ok.alias("loadable"))
    loadable = c.select(
        _repo(),
        F.explode(F.array(
            state("e.xml", "base", k % 11 != 0), state("e.xml", "head", k % 16 != 0),
            state("d.xml", "head", k % 2 == 0), state("s.xml", "head", k % 13 != 0),
        )).alias("_l"),
    ).select("repo", "_l.*")
    return sc.schema_precedence(runs, explicit, touched, found, scored, loadable)


def ignore(spark, folder):
    p = table(spark, folder, "part").select("p_partkey", "p_brand")
    k = F.col("p_partkey")
    number = F.regexp_extract("p_brand", r"(\d+)", 1).cast("int")
    paths = ["src/test/db/m{k}.sql", "db/m{k}.sql", "db/x/m{k}.sql", "a/b/gen/x{k}.sql", "gen{k}/x.sql", "test/t.sql"]
    sources = p.select(F.col("p_brand").alias("repo"), k.alias("seq"), fill(pick(k, paths), k=k % 10).alias("path"))
    lists = F.element_at(
        F.array(
            F.array(F.lit("**/test/**"), F.lit("/db/*.sql")), F.array(F.lit("gen?/*")),
            F.array(F.lit("**/gen/*.sql"), F.lit("test/**")), F.array().cast("array<string>"),
        ),
        number % 4 + 1,
    )
    patterns = p.select("p_brand", F.explode(lists).alias("pattern")).distinct().select(
        F.col("p_brand").alias("repo"), "pattern"
    )
    return pa.split_ignored(sources, patterns).select("repo", "seq", "path", "ignored")


def redact(spark, folder):
    d = table(spark, folder, "documents").select("doc_id", "text")
    k = F.col("doc_id").cast("string")
    secret = pick(
        F.col("doc_id"),
        [
            F.concat(F.lit(" ghp_AbCdEfGhIjKlMnOp"), k), F.concat(F.lit(" (github_pat_11_AAAAAAAAAAAAAAAAAAAA_"), k, F.lit(")")),
            F.concat(F.lit(" gsk_0123456789abcdefghij"), k, F.lit("!")), F.lit(" ghx_AbCdEfGhIjKlMnOp ghp_short"),
        ],
    )
    return d.select("doc_id", F.md5(pa.redact(F.concat("text", secret))).alias("digest"))


QUERIES = {
    "config_kv": config_kv,
    "detect_dialect": dialect,
    "apply_dialect": label,
    "changelog_discovery": discovery,
    "changelog_scan": changelog_scan,
    "include_order": include_order,
    "substitute_props": substitute,
    "index_state": index_state,
    "column_state": column_state,
    "table_schema": schema_rows,
    "schema_lookup": lookup,
    "changelog_touch": touch,
    "root_scoring": root_scoring,
    "schema_precedence": precedence,
    "ignore_paths": ignore,
    "redact": redact,
}

ORACLES = {
    "config_kv": f"""
SELECT 'c' || c_custkey AS repo, key, replace(value, '{{k}}', CAST(c_custkey AS VARCHAR)) AS value
FROM customer JOIN {_ENTRIES} ON c_custkey % 6 = t""",
    "detect_dialect": _DIALECT + "SELECT * FROM dialects WHERE run_dialect IS NOT NULL",
    "apply_dialect": _DIALECT
    + """SELECT repo, CASE c_custkey % 3 WHEN 0 THEN 'a.sql' WHEN 1 THEN 'B.SQL' ELSE 'C.java' END AS path,
      CASE WHEN c_custkey % 3 < 2 THEN coalesce(run_dialect, 'postgres') ELSE 'postgres' END AS source_dialect,
      CASE WHEN c_custkey % 2 = 1 THEN 'tsql' ELSE coalesce(run_dialect, 'postgres') END AS query_dialect
      FROM customer JOIN dialects ON repo = 'c' || c_custkey""",
    "changelog_discovery": """
WITH d AS (
  SELECT 'c' || c_custkey AS repo, c_custkey % 6 = 3 AS blank,
    CASE c_custkey % 6 WHEN 0 THEN 'src/main/resources/db/changelog/root' || c_custkey || '.xml'
      WHEN 2 THEN 'src/main/resources/root' || c_custkey || '.xml'
      WHEN 5 THEN 'src/main/resources/db/root' || c_custkey || '.xml' END AS a,
    CASE WHEN c_custkey % 2 = 1 THEN CASE c_custkey % 5 WHEN 0 THEN 'db/changelog/root' || c_custkey || '.xml'
      WHEN 1 THEN 'other' || c_custkey || '.xml' WHEN 3 THEN 'a#b' || c_custkey || '.xml' END END AS b
  FROM customer)
SELECT repo, CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN 'ambiguous'
         WHEN a IS NOT NULL OR b IS NOT NULL THEN 'discovered' WHEN blank THEN 'invalid' ELSE 'not_found' END AS status,
  CASE WHEN a IS NULL OR b IS NULL THEN coalesce(a, b) END AS changelog_path,
  CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN NULL WHEN a IS NOT NULL THEN 'src/main/resources/application.properties'
       WHEN b IS NOT NULL THEN 'application.yaml' WHEN blank THEN 'src/main/resources/application.properties' END
    AS source_file
FROM d""",
    "changelog_scan": """
SELECT op, path, CAST(sum(n) AS BIGINT) AS n, CAST(sum(n * cols) AS BIGINT) AS n_columns FROM (
  SELECT op, path, cols, CASE WHEN kind = 'all' THEN n WHEN kind = 'even' AND c_custkey % 2 = 0 THEN n
    WHEN kind = 'gone' AND c_custkey % 3 = 1 THEN n WHEN kind = 'cycle' AND c_custkey % 3 = 2 THEN n ELSE 0 END AS n
  FROM customer, (VALUES
    ('file', 'db/root.xml', 'all', 1, 0), ('property', 'db/root.xml', 'all', 2, 0), ('include', 'db/root.xml', 'all', 2, 0),
    ('changeSet', 'db/root.xml', 'all', 1, 0), ('dropIndex', 'db/root.xml', 'all', 1, 0), ('dropIndex', 'db/root.xml', 'even', 1, 0),
    ('file', 'db/a.xml', 'all', 1, 0), ('include', 'db/a.xml', 'cycle', 1, 0), ('changeSet', 'db/a.xml', 'all', 1, 0),
    ('createTable', 'db/a.xml', 'all', 1, 3), ('createIndex', 'db/a.xml', 'all', 1, 2), ('createIndex', 'db/a.xml', 'all', 1, 1),
    ('addUniqueConstraint', 'db/a.xml', 'all', 1, 2), ('dropIndex', 'db/a.xml', 'all', 1, 0),
    ('file', 'db/sub/b.xml', 'all', 1, 0), ('include', 'db/sub/b.xml', 'all', 1, 0), ('include', 'db/sub/b.xml', 'gone', 1, 0),
    ('changeSet', 'db/sub/b.xml', 'all', 1, 0), ('addColumn', 'db/sub/b.xml', 'all', 1, 1), ('createTable', 'db/sub/b.xml', 'all', 1, 1),
    ('file', 'legacy/other-ChangeLog.xml', 'even', 1, 0), ('changeSet', 'legacy/other-ChangeLog.xml', 'even', 1, 0),
    ('file', 'pom.xml', 'all', 1, 0), ('file', 'broken.xml', 'all', 1, 0)) x(op, path, kind, n, cols))
GROUP BY op, path""",
    "include_order": """
SELECT 'c' || c_custkey AS repo, path, order_key FROM customer, (VALUES
  ('db/root.xml', '', 0), ('db/a.xml', '1', 0), ('db/sub/b.xml', '3', 0), ('db/gone.xml', '3.1', 1))
  x(path, order_key, only_one) WHERE only_one = 0 OR c_custkey % 3 = 1""",
    "substitute_props": """
SELECT 'c' || c_custkey AS repo, replace(table_name, '{k}', CAST(c_custkey AS VARCHAR)) AS table_name, "column",
       replace(type, '{k}', CAST(c_custkey AS VARCHAR)) AS type FROM customer, (VALUES
  ('t', 'id', 'bigint'), ('t', 'email', 'varchar({k})'), ('t', 'note', '${unknown}'), ('t', 'bio', 'clob'),
  ('u{k}', 'x', 'int')) x(table_name, "column", type)""",
    "table_schema": """
SELECT 'c' || c_custkey AS repo, 't' AS table_name,
       CASE WHEN c_custkey % 2 = 0 THEN 'id,note' ELSE 'email,id,note' END AS indexed_columns,
       'bio:clob,email:varchar(' || c_custkey || '),id:bigint,note:${unknown}' AS column_types
FROM customer WHERE c_custkey % 3 <> 1
UNION ALL SELECT 'c' || c_custkey, 'u' || c_custkey, 'x', 'x:int' FROM customer WHERE c_custkey % 3 <> 1""",
    "index_state": """
SELECT p_brand AS repo, 't' || (p_size % 10) AS table_name, 'ix' || (p_partkey % 3) AS index_name,
       arg_max(lower(p_type), p_partkey) AS leading
FROM part GROUP BY 1, 2, 3 HAVING arg_max(p_partkey % 5, p_partkey) < 3""",
    "column_state": """
SELECT p_brand AS repo, 't' || (p_size % 10) AS table_name, lower(p_type) AS "column",
       'v' || max(p_partkey) AS type FROM part GROUP BY 1, 2, 3""",
    "schema_lookup": f"""
SELECT 't' || p_partkey AS table_name, 'EMAIL' AS "column",
  CASE WHEN (p_partkey // {corpus.N}) % 2 = 0 THEN 'country,id' ELSE 'id' END AS indexed_columns,
  'varchar(80)' AS column_type FROM part
UNION ALL SELECT 'T' || p_partkey, 'nope', CASE WHEN (p_partkey // {corpus.N}) % 2 = 0 THEN 'country,id' ELSE 'id' END,
  NULL FROM part
UNION ALL SELECT 'x' || p_partkey, 'id', NULL, NULL FROM part""",
    "changelog_touch": """
SELECT 'c' || o_custkey AS repo, o_orderkey AS pr, o_orderkey % 4 < 2 AND o_custkey % 3 <> 1 AS touches FROM orders""",
    "root_scoring": """
WITH m AS (
  SELECT c_custkey AS k, c_custkey % 3 <> 2 AS r, c_custkey % 5 <> 0 AS b, c_custkey % 2 = 0 AS o FROM customer
), n AS (SELECT *, CAST(r AS INT) + CAST(b AS INT) + CAST(o AS INT) AS n FROM m)
SELECT 'c' || k AS repo, CASE WHEN n = 1 THEN 'discovered' ELSE 'ambiguous' END AS status,
  CASE WHEN n = 1 THEN CASE WHEN r THEN 'db/root.xml' WHEN b THEN 'db/sub/b.xml'
    ELSE 'legacy/other-ChangeLog.xml' END END AS changelog_path FROM n""",
    "schema_precedence": """
WITH s AS (SELECT c_custkey AS k, CASE
    WHEN c_custkey % 4 = 0 THEN CASE WHEN c_custkey % 11 = 0 THEN 'unknown'
      WHEN c_custkey % 8 = 0 AND c_custkey % 16 <> 0 THEN 'explicit-head' ELSE 'explicit-base' END
    WHEN c_custkey % 3 = 0 AND c_custkey % 2 = 0 THEN 'config'
    WHEN c_custkey % 3 = 2 THEN 'unknown'
    WHEN c_custkey % 5 < 3 AND c_custkey % 13 <> 0 THEN 'scoring' ELSE 'unknown' END AS source FROM customer)
SELECT 'c' || k AS repo, k % 7 AS pr, source, CASE WHEN source LIKE 'explicit%' THEN 'e.xml'
  WHEN source = 'config' THEN 'd.xml' WHEN source = 'scoring' THEN 's.xml' END AS root FROM s""",
    "ignore_paths": """
WITH s AS (SELECT p_brand AS repo, p_partkey AS seq, p_partkey % 6 AS t, p_partkey % 10 AS d,
             CAST(replace(p_brand, 'Brand#', '') AS INT) % 4 AS b FROM part)
SELECT repo, seq, CASE t WHEN 0 THEN 'src/test/db/m' || d || '.sql' WHEN 1 THEN 'db/m' || d || '.sql'
    WHEN 2 THEN 'db/x/m' || d || '.sql' WHEN 3 THEN 'a/b/gen/x' || d || '.sql' WHEN 4 THEN 'gen' || d || '/x.sql'
    ELSE 'test/t.sql' END AS path,
  CASE b WHEN 0 THEN t IN (0, 1, 5) WHEN 1 THEN t = 4 WHEN 2 THEN t IN (3, 5) ELSE false END AS ignored FROM s""",
    "redact": """
SELECT doc_id, md5(regexp_replace(text || CASE doc_id % 4 WHEN 0 THEN ' ghp_AbCdEfGhIjKlMnOp' || doc_id
    WHEN 1 THEN ' (github_pat_11_AAAAAAAAAAAAAAAAAAAA_' || doc_id || ')'
    WHEN 2 THEN ' gsk_0123456789abcdefghij' || doc_id || '!' ELSE ' ghx_AbCdEfGhIjKlMnOp ghp_short' END,
  'gh[pousr]_[A-Za-z0-9]{16,}|github_pat_[A-Za-z0-9_]{20,}|gsk_[A-Za-z0-9]{20,}', '<redacted>', 'g')) AS digest
FROM documents""",
}
