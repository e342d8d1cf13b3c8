"""Access-pattern queries: candidates, evidence, explanations, the batched summary."""

from __future__ import annotations

from pyspark.sql import functions as F

from stmtlens.catalog import java, logs
from stmtlens.catalog.base import pick, spread, sql_values, table
from stmtlens.operators import nplusone as np1
from stmtlens.operators.repeated import repeated_statements


def summary(spark, folder):
    rows = np1.order_summary(
        table(spark, folder, "customer").select("c_custkey", "c_name"),
        table(spark, folder, "orders").select("o_custkey", "o_totalprice"),
    )
    return rows.withColumn("total_spend", F.round("total_spend", 2))


def declaration(spark, folder):
    o = table(spark, folder, "orders").select("o_orderkey", "o_custkey")
    p = table(spark, folder, "part").select("p_partkey", "p_size")
    k, pk = F.col("o_orderkey"), F.col("p_partkey")
    name = lambda prefix, c, n: F.concat(F.lit(prefix), (c % n).cast("string"))
    sites = o.select(name("c", F.col("o_custkey"), 20).alias("repo"), name("R", k, 6).alias("repository_type"),
                     name("find", k, 11).alias("method_name"), k.alias("off"))
    methods = p.select(name("c", pk, 20).alias("repo"), name("R", pk, 7).alias("repository_type"),
                       name("find", F.col("p_size"), 9).alias("name"), name("f", pk, 3).alias("path"),
                       pk.alias("line"), F.concat(F.lit("q"), pk.cast("string")).alias("query_id"))
    return np1.call_declarations(sites, methods)


_TYPES = ["OrderRepository", "ItemRepository", "StockRepository", "PriorityRepository", "TRepository"]
_ENTITIES = ["Order", "Items", None, "Nope", "Missing"]


def correlation(spark, folder):
    """Candidates of each customer against the log of its application."""
    c = table(spark, folder, "customer").select("c_custkey")
    k = F.col("c_custkey")
    rows = c.select(
        F.concat(F.lit("app-"), (k % 4).cast("string")).alias("source"), k.alias("cid"),
        pick(k, _TYPES).alias("type_name"), pick(k, [F.lit(e).cast("string") for e in _ENTITIES]).alias("entity"),
    )
    mapped = rows.filter(F.col("entity") == "Order").select(
        "source", "entity", F.lit("Orders").alias("table_name")
    ).distinct()
    tables = np1.candidate_tables(rows, mapped, "cid", "source")
    groups = np1.evidence_groups(repeated_statements(logs._log(spark, folder)))
    reads = np1.group_tables(groups)
    return np1.runtime_correlation(tables, groups, reads, "cid")


def found_candidates(spark, folder):
    facts = java._facts(spark, folder)
    return np1.candidates(facts.sites, facts.lazy).select(
        "repo", "kind", "file", "line", "repository_type", "method_name", "iteration_kind", "iteration_line",
        "iterable", "element", "loop_depth", "dependency",
    )


_ITERATION = {0: ("enhanced-for", 17, "customers"), 2: ("lambda-for-each", 17, None), 3: ("lambda-stream", 17, None),
              7: ("enhanced-for", 20, "ids"), 8: ("enhanced-for", 17, "ids")}


def _inner(t, line):
    if t == 5:
        return ("while", 18, None, None) if line == 19 else ("for", 18, None, None)
    kind, at, over = _ITERATION[t]
    return (kind, at, over, "customer" if t == 0 else "id")


_CANDIDATES = sql_values(
    [
        (s[0], np1.REPOSITORY_CALL, s[1], s[3], s[6], *_inner(s[0], s[1]), s[8], s[9])
        for s in java.SITES if s[8] > 0
    ]
    + [(9, np1.LAZY_ASSOCIATION, 18, None, m, "enhanced-for", 17, "cs", "c", 1, "no-arguments") for m in ("getOrders", "getRegion")],
    "t, kind, line, repository_type, method_name, iteration_kind, iteration_line, iterable, element, loop_depth, dependency",
)


def graded(spark, folder):
    """Candidates by arithmetic on line items; many share an identity."""
    li = spread(
        table(spark, folder, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity"),
        "l_orderkey", "l_linenumber",
    )
    ok, pk, ln, q = F.col("l_orderkey"), F.col("l_partkey"), F.col("l_linenumber"), F.col("l_quantity").cast("int")
    lazy = pk % 4 == 0
    pad = lambda c, n: F.lpad(c.cast("string"), n, "0")
    return li.select(
        F.concat(F.lit("r"), (ok % 30).cast("string")).alias("repo"),
        F.concat_ws("-", pad(ok, 12), pad(pk, 12), pad(ln, 2), pad(F.col("l_suppkey"), 12), pad(q, 4)).alias("seq"),
        F.when(lazy, np1.LAZY_ASSOCIATION).otherwise(np1.REPOSITORY_CALL).alias("kind"),
        F.concat(F.lit("src/F"), (pk % 13).cast("string"), F.lit(".java")).alias("file"),
        (ln * 10).alias("line"),
        F.when(~lazy, F.concat(F.lit("R"), (pk % 3).cast("string"))).alias("repository_type"),
        pick(pk, ["findById", "load", "getOrders"]).alias("method_name"), (ln * 10 - q % 3).alias("iteration_line"),
        F.when(~lazy, F.when(pk % 5 == 0, "name-convention").otherwise("declared")).alias("resolution"),
        pick(pk, ["no-arguments", "loop-element-argument", "independent"]).alias("dependency"),
        F.when(q % 7 == 0, q * 1000).cast("long").alias("runtime_count"),
    ).withColumn(
        "tier",
        np1.evidence_tier(F.col("kind"), F.col("resolution"), F.col("dependency"), F.col("runtime_count").isNotNull()),
    )


def tiers(spark, folder):
    t = F.col("tier")
    return graded(spark, folder).select(
        "seq", "tier", np1.tier_severity(t).alias("severity"), np1.tier_confidence(t).alias("confidence")
    )


def dedup(spark, folder):
    return np1.dedup_candidates(graded(spark, folder)).select("repo", *np1.IDENTITY, "tier", "seq")


def findings(spark, folder):
    none = F.lit(None).cast("string")
    rows = np1.dedup_candidates(graded(spark, folder)).withColumns(
        {
            "iteration_kind": pick(F.col("line"), ["for", "while", "lambda-stream"]),
            "iterable": F.when(F.col("line") % 20 == 0, "rows"), "element": F.when(F.col("line") % 20 == 0, "row"),
            "loop_depth": F.col("line") % 30 / 10 + 1, "enclosing_method": F.lit("run"), "enclosing_type": F.lit("S"),
            "dependency_detail": F.when(F.col("dependency") == "loop-element-argument", "`row` flows"),
            "declaration_file": F.when(F.col("resolution") == "declared", "R.java"), "declaration_line": F.lit(3),
            "query_id": F.when(F.col("resolution") == "declared", "R.java:1"),
            "runtime_variants": F.col("runtime_count") / 2, "runtime_ms": F.col("runtime_count") * 3,
            "normalized_sql": F.lit("SELECT ?"), "matched_on": F.lit("statement reads `t`"),
        }
    ).withColumn("loop_depth", F.col("loop_depth").cast("int"))
    labels = F.array_join(F.transform("evidence", lambda e: e["label"]), ",")
    return np1.candidate_findings(rows).select(
        "repo", "seq", "rule_id", "severity", "title", "impact", "span_start", "span_end", "query_id", "confidence",
        labels.alias("evidence"), F.size("suggestions").alias("n_suggestions"), F.col("confidence_basis").isNull().alias("observed"),
    )


# --- explanations ------------------------------------------------------------------------------------

# Suffix by (conv_id * 7 + turn) % 8; the flags say: claims a count, names a foreign place.
SUFFIXES = [
    (" The lookup repeats per row.", False, False),
    (" It ran about 1,204 times yesterday.", True, False),
    (" We measured a cost of 12 here.", True, False),
    (" In total 300 database round-trips were observed.", True, False),
    (" See Here.java:10 for the loop.", False, False),
    (" See OTHER.java for the loop.", False, True),
    (" See here.java:99 for the loop.", False, True),
    (" It ran. Then 5 times nothing; Decl.java:12 is fine.", False, False),
]


def prose(spark, folder):
    c = table(spark, folder, "conversations").select("conv_id", "turn", "text")
    n = F.col("conv_id") * 7 + F.col("turn")
    in_reasoning = F.col("turn") % 2 == 0
    tail = pick(n, [s for s, _, _ in SUFFIXES])
    return c.select(
        "conv_id", "turn", F.concat(F.lit(" "), "text", F.when(in_reasoning, "").otherwise(tail)).alias("summary"),
        F.when(in_reasoning, tail).otherwise("").alias("reasoning"),
        F.array(F.lit("Batch it. "), F.lit("  ")).alias("remediation"),
    )


def _places(spark, folder):
    c = table(spark, folder, "conversations").select("conv_id", "turn")
    return c.select(
        "conv_id", "turn", (F.col("conv_id") % 3 == 0).alias("has_runtime"), F.lit("a/b/Here.java").alias("file"),
        F.lit("Decl.java").alias("declaration_file"), F.lit(10).alias("line"), F.lit(9).alias("iteration_line"),
        F.lit(12).alias("declaration_line"),
    )


def claims(spark, folder):
    rows = prose(spark, folder).join(_places(spark, folder), ["conv_id", "turn"])
    return np1.claims_runtime(rows).select("conv_id", "turn")


def foreign(spark, folder):
    rows = prose(spark, folder).join(_places(spark, folder), ["conv_id", "turn"])
    return np1.names_foreign_location(rows).select("conv_id", "turn")


def merged(spark, folder):
    told = prose(spark, folder).filter(F.col("conv_id") % 5 != 0)
    base = table(spark, folder, "conversations").select(
        "conv_id", "turn", F.lit("Fact.").alias("explanation"),
        F.array(F.struct(F.lit("loop").alias("label"), F.lit("x").alias("detail"))).alias("evidence"),
        F.array(F.lit("Join it.")).alias("suggestions"),
    )
    return np1.reconcile(base, _places(spark, folder), told, ["conv_id", "turn"]).select(
        "conv_id", "turn", F.length("explanation").alias("n_chars"),
        F.array_join("suggestions", "|").alias("suggestions"), F.size("evidence").alias("n_evidence"),
    )


QUERIES = {
    "order_summary": summary,
    "call_declaration": declaration,
    "runtime_correlation": correlation,
    "candidates": found_candidates,
    "evidence_tier": tiers,
    "dedup_candidates": dedup,
    "candidate_findings": findings,
    "runtime_claims": claims,
    "foreign_locations": foreign,
    "merge_explanations": merged,
}

_GRADED = """
WITH raw AS (
  SELECT 'r' || (l_orderkey % 30) AS repo,
    lpad(CAST(l_orderkey AS VARCHAR), 12, '0') || '-' || lpad(CAST(l_partkey AS VARCHAR), 12, '0') || '-'
      || lpad(CAST(l_linenumber AS VARCHAR), 2, '0') || '-' || lpad(CAST(l_suppkey AS VARCHAR), 12, '0') || '-'
      || lpad(CAST(CAST(l_quantity AS INTEGER) AS VARCHAR), 4, '0') AS seq,
    l_partkey % 4 = 0 AS lazy, l_partkey AS pk, l_linenumber AS ln, CAST(l_quantity AS INTEGER) AS q FROM lineitem
), graded AS (
  SELECT repo, seq, CASE WHEN lazy THEN 'lazy-association-in-loop' ELSE 'repository-call-in-loop' END AS kind,
    'src/F' || (pk % 13) || '.java' AS file, ln * 10 AS line, CASE WHEN NOT lazy THEN 'R' || (pk % 3) END AS repository_type,
    CASE pk % 3 WHEN 0 THEN 'findById' WHEN 1 THEN 'load' ELSE 'getOrders' END AS method_name,
    ln * 10 - q % 3 AS iteration_line,
    CASE WHEN NOT lazy THEN CASE WHEN pk % 5 = 0 THEN 'name-convention' ELSE 'declared' END END AS resolution,
    CASE pk % 3 WHEN 0 THEN 'no-arguments' WHEN 1 THEN 'loop-element-argument' ELSE 'independent' END AS dependency,
    CASE WHEN q % 7 = 0 THEN q * 1000 END AS runtime_count, lazy,
    CASE WHEN lazy THEN CASE WHEN q % 7 = 0 THEN 'high' ELSE 'medium' END
         WHEN q % 7 = 0 THEN 'very-high' WHEN pk % 5 = 0 THEN 'low' WHEN pk % 3 = 1 THEN 'medium-high' ELSE 'medium' END AS tier
  FROM raw
), graded2 AS (
  SELECT *, CASE WHEN tier IN ('medium', 'low') THEN 'MEDIUM' ELSE 'HIGH' END AS severity,
    CASE tier WHEN 'medium-high' THEN 0.75 WHEN 'medium' THEN 0.6 WHEN 'low' THEN 0.4 END AS confidence,
    list_position(['very-high', 'high', 'medium-high', 'medium', 'low'], tier) AS tier_rank FROM graded
), best AS (
  SELECT * FROM graded2 QUALIFY row_number() OVER (PARTITION BY repo, kind, file, line, repository_type, method_name,
    iteration_line ORDER BY tier_rank, seq) = 1
)
"""
_FLAGS = sql_values([(n, c, f) for n, (_, c, f) in enumerate(SUFFIXES)], "s, claims, is_foreign")
_LENGTHS = sql_values([(n, len(s.strip())) for n, (s, _, _) in enumerate(SUFFIXES)], "s, chars")

ORACLES = {
    "order_summary": """
SELECT c_custkey, c_name, count(o_orderkey) AS order_count, round(coalesce(sum(o_totalprice), 0), 2) AS total_spend
FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey, c_name""",
    "call_declaration": """
WITH m AS (SELECT 'c' || (p_partkey % 20) AS repo, 'R' || (p_partkey % 7) AS repository_type,
    'find' || (p_size % 9) AS method_name, min(p_partkey) AS line FROM part GROUP BY 1, 2, 3)
SELECT s.repo, s.repository_type, s.method_name, off, 'f' || (line % 3) AS declaration_file, line AS declaration_line,
  'q' || line AS query_id
FROM (SELECT 'c' || (o_custkey % 20) AS repo, 'R' || (o_orderkey % 6) AS repository_type,
        'find' || (o_orderkey % 11) AS method_name, o_orderkey AS off FROM orders) s
LEFT JOIN m USING (repo, repository_type, method_name)""",
    "runtime_correlation": logs._LOG + logs._GROUPS
    + """, usable AS (
        SELECT *, CASE WHEN normalized_sql LIKE '%FROM orders%' THEN 'orders' WHEN normalized_sql LIKE '%items%' THEN 'items'
            WHEN normalized_sql LIKE '%stock%' THEN 'stock' WHEN normalized_sql LIKE '%"T"%' THEN 't' ELSE 'priorities' END AS tab
        FROM groups WHERE "count" >= 3 AND distinct_variants > 1 AND normalized_sql <> 'SHOW search_path'
      ), want AS (
        SELECT 'app-' || (c_custkey % 4) AS source, c_custkey AS cid, CASE c_custkey % 5 WHEN 0 THEN 'orders' WHEN 1 THEN 'items'
            WHEN 2 THEN 'stock' WHEN 4 THEN 't' END AS tab,
          CASE c_custkey % 5 WHEN 0 THEN '`Order` maps to `Orders` via `@Table`' WHEN 1 THEN '`Items` by naming convention'
            WHEN 2 THEN '`StockRepository` by naming convention' WHEN 4 THEN '`TRepository` by naming convention' END AS reason
        FROM customer)
      SELECT w.source, cid, normalized_sql, "count" AS runtime_count, distinct_variants AS runtime_variants,
        total_elapsed_ms AS runtime_ms, 'statement reads `' || w.tab || '`; ' || reason AS matched_on
      FROM want w JOIN usable u ON w.source = u.source AND w.tab = u.tab
      QUALIFY row_number() OVER (PARTITION BY cid ORDER BY "count" DESC, seq) = 1""",
    "candidates": java._per_customer(
        f"""kind, replace('{java.SERVICE}', '{{k}}', CAST(c_custkey AS VARCHAR)) AS file, line, repository_type,
        method_name, iteration_kind, iteration_line, iterable, element, loop_depth, dependency""",
        _CANDIDATES, java._T),
    "evidence_tier": _GRADED + "SELECT seq, tier, severity, confidence FROM graded2",
    "dedup_candidates": _GRADED
    + "SELECT repo, kind, file, line, repository_type, method_name, iteration_line, tier, seq FROM best",
    "candidate_findings": _GRADED
    + """SELECT repo, seq, CASE WHEN lazy THEN 'nplusone-lazy-association-in-loop' ELSE 'nplusone-repository-call-in-loop' END
        AS rule_id, severity, CASE WHEN lazy THEN 'Potential N+1 from a lazy association loaded inside a loop'
          WHEN tier = 'very-high' THEN 'N+1 query pattern, corroborated by a captured statement log'
          ELSE 'Potential N+1 query pattern' END AS title,
        CASE WHEN runtime_count IS NULL THEN 'Statements grow with the number of elements.'
          ELSE format('Logged: {:,} runs, {:,} sets of values, {:,} ms.',
               runtime_count, runtime_count // 2, runtime_count * 3) END AS impact,
        iteration_line AS span_start, line AS span_end, CASE WHEN resolution = 'declared' THEN 'R.java:1' END AS query_id,
        confidence,
        'loop' || CASE WHEN line % 30 <> 0 THEN ',depth' ELSE '' END
          || CASE WHEN dependency = 'loop-element-argument' THEN ',element' ELSE '' END
          || CASE WHEN resolution = 'declared' THEN ',declared' ELSE '' END
          || CASE WHEN runtime_count IS NOT NULL THEN ',log' ELSE '' END || ',grade' AS evidence,
        CASE WHEN lazy THEN 1 ELSE 2 END AS n_suggestions, tier IN ('very-high', 'high') AS observed FROM best""",
    "runtime_claims": f"""
SELECT conv_id, turn FROM conversations JOIN {_FLAGS} ON (conv_id * 7 + turn) % 8 = s WHERE claims AND conv_id % 3 <> 0""",
    "foreign_locations": f"""
SELECT conv_id, turn FROM conversations JOIN {_FLAGS} ON (conv_id * 7 + turn) % 8 = s WHERE is_foreign""",
}
ORACLES["merge_explanations"] = f"""
WITH c AS (
  SELECT conv_id, turn, conv_id % 5 <> 0 AND NOT is_foreign AND (NOT claims OR conv_id % 3 = 0) AS told,
    length(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) AS n_text, length(regexp_replace(text, '^\\s+', '')) AS n_left, chars
  FROM conversations JOIN {_FLAGS} ON (conv_id * 7 + turn) % 8 = x.s
  JOIN {_LENGTHS.replace(") x(", ") y(")} ON (conv_id * 7 + turn) % 8 = y.s)
SELECT conv_id, turn, CASE WHEN NOT told THEN 5 WHEN turn % 2 = 0 THEN n_text + 1 + chars + 7 ELSE n_left + 1 + chars + 7 END AS n_chars,
  CASE WHEN told THEN 'Join it.|Batch it.' ELSE 'Join it.' END AS suggestions, CASE WHEN told THEN 2 ELSE 1 END AS n_evidence
FROM c"""
