"""Review queries.  Input: findings from ``lineitem``, policies from ``nation``."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from stmtlens.catalog.base import pick, spread, sql_quote, table
from stmtlens.operators import review as rv
from stmtlens.session import shared_folder
from stmtlens.sources.sinks import write_findings, write_responses

_SEV = ["CRITICAL", "HIGH", "MEDIUM", "LOW", "INFO"]
_RULES = ["missing-where", "no-limit", "select-star", "unindexed-filter", "non-sargable", "n1", "n2", "n3"]


def findings(spark, folder):
    """One finding per line item, repeated where the supplier is a multiple of 7."""
    li = spread(
        table(spark, folder, "lineitem").select(
            "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity"
        ),
        "l_orderkey", "l_linenumber",
    )
    ok, pk, sk, ln = (F.col(c) for c in ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"))
    copies = F.when(sk % 7 == 0, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array(F.lit("a")))
    pad = lambda c, n: F.lpad(c.cast("string"), n, "0")
    return li.withColumn("copy", F.explode(copies)).select(
        F.concat(F.lit("nation-"), (sk % 25).cast("string")).alias("repo"),
        (ok % 40).alias("pr"),
        F.concat_ws(
            "-", pad(ok, 12), pad(pk, 12), pad(ln, 2), pad(sk, 12),
            pad(F.col("l_quantity").cast("int"), 4), F.col("copy"),
        ).alias("seq"),
        pick(pk, _RULES).alias("rule_id"),
        pick(ln, _SEV).alias("severity"),
        F.when(pk % 3 == 0, F.lit(None)).otherwise(F.concat(F.lit("q"), (pk % 11).cast("string"))).alias("query_id"),
        F.concat(F.lit("f"), (ok % 17).cast("string"), F.lit(".sql")).alias("file"),
        F.when(ln == 5, F.lit(None)).otherwise(ln * 10 + pk % 2).cast("int").alias("line"),
        F.concat(F.lit("title "), (pk % 5).cast("string")).alias("title"),
        F.when(pk % 4 < 3, (pk % 4 + 1) * 0.25).alias("confidence"),
    )


_FINDINGS = """
WITH raw AS (
  SELECT 'nation-' || (l_suppkey % 25) AS repo, l_orderkey % 40 AS pr,
    lpad(CAST(l_orderkey AS VARCHAR), 12, '0') || '-' || lpad(CAST(l_partkey AS VARCHAR), 12, '0') || '-'
      || lpad(CAST(l_linenumber AS VARCHAR), 2, '0') || '-' || lpad(CAST(l_suppkey AS VARCHAR), 12, '0') || '-'
      || lpad(CAST(CAST(l_quantity AS INTEGER) AS VARCHAR), 4, '0') || '-' || copy AS seq,
    CASE l_partkey % 8 WHEN 0 THEN 'missing-where' WHEN 1 THEN 'no-limit' WHEN 2 THEN 'select-star'
      WHEN 3 THEN 'unindexed-filter' WHEN 4 THEN 'non-sargable' WHEN 5 THEN 'n1' WHEN 6 THEN 'n2' ELSE 'n3' END
      AS rule_id,
    CASE l_linenumber % 5 WHEN 0 THEN 'CRITICAL' WHEN 1 THEN 'HIGH' WHEN 2 THEN 'MEDIUM' WHEN 3 THEN 'LOW'
      ELSE 'INFO' END AS severity, l_linenumber % 5 AS severity_rank,
    CASE WHEN l_partkey % 3 <> 0 THEN 'q' || (l_partkey % 11) END AS query_id,
    'f' || (l_orderkey % 17) || '.sql' AS file,
    CASE WHEN l_linenumber <> 5 THEN CAST(l_linenumber * 10 + l_partkey % 2 AS INTEGER) END AS line,
    'title ' || (l_partkey % 5) AS title,
    CASE l_partkey % 4 WHEN 0 THEN 0.25 WHEN 1 THEN 0.5 WHEN 2 THEN 0.75 END AS confidence
  FROM (SELECT *, unnest(CASE WHEN l_suppkey % 7 = 0 THEN ['a', 'b'] ELSE ['a'] END) AS copy FROM lineitem)
), ranked AS (
  SELECT * FROM raw QUALIFY row_number() OVER (
    PARTITION BY repo, pr, rule_id, query_id, file, line, title ORDER BY seq) = 1
), capped AS (
  SELECT *, row_number() OVER (PARTITION BY repo, pr ORDER BY severity_rank, seq) AS position
  FROM ranked QUALIFY position <= 20
)
"""


def _ranked(spark, folder):
    return rv.rank_findings(findings(spark, folder))


def merge(spark, folder):
    """Static findings are the even parts' rules, cross-query ones the rest."""
    f = findings(spark, folder)
    cross = F.col("rule_id").isin("n1", "n2", "n3")
    merged = rv.merge_findings(f.filter(~cross), f.filter(cross).drop("confidence"))
    return merged.groupBy("repo", "pr", "stage", "rule_id").agg(
        F.count("*").alias("n"), F.min("seq").alias("first_seq"), F.count("confidence").alias("n_confidence")
    )


def rank(spark, folder):
    return rv.in_order(_ranked(spark, folder)).select(
        "repo", "pr", "seq", "rule_id", "severity", "severity_rank", "query_id", "file", "line", "title"
    )


def cap(spark, folder):
    ranked = _ranked(spark, folder)
    kept = rv.cap_findings(ranked)
    return kept.join(rv.omitted_counts(ranked), ["repo", "pr"]).select(
        "repo", "pr", "position", "seq", "found", "omitted"
    )


def org_policy(spark, folder):
    n = table(spark, folder, "nation")
    k = F.col("n_nationkey")
    arr = lambda *xs: F.array(*[F.lit(x) for x in xs]).cast("array<string>")
    return n.select(
        F.concat(F.lit("nation-"), k.cast("string")).alias("repo"),
        F.when(k % 4 == 1, arr("CRITICAL")).when(k % 4 == 2, arr("MEDIUM", "LOW")).alias("block_severities"),
        F.when(k % 4 == 3, arr("HIGH")).alias("ignored_severities"),
        F.when(k % 3 == 0, arr("select-star")).alias("block_rules"),
        F.when(k % 3 == 1, arr("no-limit")).alias("warn_rules"),
        F.when(k % 3 == 2, arr("n1", "n2")).alias("ignore_rules"),
        (F.col("n_regionkey") == 0).alias("advisory"),
    )


def repo_config(spark, folder):
    n = table(spark, folder, "nation").filter("n_nationkey % 5 <> 4")
    k = F.col("n_nationkey")
    arr = lambda *xs: F.array(*[F.lit(x) for x in xs]).cast("array<string>")
    return n.select(
        F.concat(F.lit("nation-"), k.cast("string")).alias("repo"),
        F.when(k % 5 == 0, arr("INFO")).alias("block_severities"),
        F.when(k % 5 == 1, arr("n3", "select-star")).otherwise(arr()).alias("block_rules"),
        F.when(k % 5 == 2, arr("no-limit", "n3")).otherwise(arr()).alias("warn_rules"),
    )


def _policy(spark, folder):
    return rv.layer_policy(org_policy(spark, folder), repo_config(spark, folder))


def policy(spark, folder):
    """Layered policy, with how many findings of the repository it governs."""
    show = lambda c: F.array_join(F.sort_array(c), ",").alias(c)
    counts = findings(spark, folder).groupBy("repo").agg(F.count("*").alias("n_findings"))
    return _policy(spark, folder).select(
        "repo", show("block_severities"), show("ignored_severities"), show("block_rules"),
        show("warn_rules"), show("ignore_rules"), "advisory",
    ).join(counts, "repo", "left")


_POLICY = """
policy AS (
  SELECT 'nation-' || n_nationkey AS repo,
    CASE n_nationkey % 4 WHEN 1 THEN 'CRITICAL' WHEN 2 THEN 'LOW,MEDIUM'
      ELSE CASE WHEN n_nationkey % 5 = 0 THEN 'INFO' ELSE 'CRITICAL,HIGH' END END AS block_severities,
    CASE WHEN n_nationkey % 4 = 3 THEN 'HIGH' ELSE '' END AS ignored_severities,
    CASE WHEN n_nationkey % 5 = 1 THEN 'n3,select-star' WHEN n_nationkey % 3 = 0 THEN 'select-star' ELSE '' END
      AS block_rules,
    CASE WHEN n_nationkey % 5 = 2 THEN 'n3,no-limit' WHEN n_nationkey % 3 = 1 THEN 'no-limit' ELSE '' END
      AS warn_rules,
    CASE WHEN n_nationkey % 3 = 2 THEN 'n1,n2' ELSE '' END AS ignore_rules,
    n_regionkey = 0 AS advisory
  FROM nation
)
"""
_JUDGE = """
CASE WHEN advisory THEN false
     WHEN list_contains(string_split(ignore_rules, ','), rule_id)
       OR list_contains(string_split(warn_rules, ','), rule_id) THEN false
     WHEN list_contains(string_split(block_rules, ','), rule_id) THEN true
     WHEN list_contains(string_split(ignored_severities, ','), severity) THEN false
     ELSE list_contains(string_split(block_severities, ','), severity) END"""


def blocks(spark, folder):
    judged = rv.should_block(_ranked(spark, folder), _policy(spark, folder))
    return judged.select("repo", "pr", "seq", "rule_id", "severity", "blocks")


# Runs: every (repo, pr) of a nation and a customer number; half have no findings at all.


def reviews(spark, folder):
    c = table(spark, folder, "customer").select("c_custkey", "c_nationkey")
    return c.select(
        F.concat(F.lit("nation-"), F.col("c_nationkey").cast("string")).alias("repo"),
        (F.col("c_custkey") % 80).alias("pr"),
    ).distinct()


def review_queries(spark, folder):
    """Extracted queries: one per order, none for every 8th review number."""
    o = table(spark, folder, "orders").select("o_orderkey", "o_custkey")
    k = F.col("o_orderkey")
    return o.filter(k % 80 % 8 != 7).select(
        F.concat(F.lit("nation-"), (F.col("o_custkey") % 25).cast("string")).alias("repo"),
        (k % 80).alias("pr"),
        F.concat(F.lit("f"), (k % 17).cast("string"), F.lit(".sql")).alias("path"),
        (k % 17).alias("file_seq"),
        F.when((k % 80 % 5 == 1) | (k % 13 == 0), F.lit("unreadable")).alias("parse_error"),
    )


def initial_markers(spark, folder):
    s = table(spark, folder, "supplier")
    k = F.col("s_suppkey")
    return s.select(
        F.concat(F.lit("nation-"), (k % 25).cast("string")).alias("repo"),
        (k * 7 % 80).alias("pr"), k.alias("seq"),
        F.concat(F.lit("ingest:f"), k.cast("string")).alias("marker"),
    )


def _degraded(spark, folder):
    return rv.degraded_markers(review_queries(spark, folder), initial_markers(spark, folder))


def degraded(spark, folder):
    return _degraded(spark, folder)


_RUNS = """
reviews AS (SELECT DISTINCT 'nation-' || c_nationkey AS repo, c_custkey % 80 AS pr FROM customer),
queries AS (
  SELECT 'nation-' || (o_custkey % 25) AS repo, o_orderkey % 80 AS pr, 'f' || (o_orderkey % 17) || '.sql' AS path,
         o_orderkey % 17 AS file_seq, (o_orderkey % 80 % 5 = 1 OR o_orderkey % 13 = 0) AS unreadable
  FROM orders WHERE o_orderkey % 80 % 8 <> 7
), degraded AS (
  SELECT repo, pr, 1 AS stage, min(file_seq) AS seq, 'extract:' || path AS marker FROM queries WHERE unreadable
  GROUP BY repo, pr, path
  UNION ALL
  SELECT 'nation-' || (s_suppkey % 25), s_suppkey * 7 % 80, 0, s_suppkey, 'ingest:f' || s_suppkey FROM supplier
)
"""


def status(spark, folder):
    judged = rv.should_block(_ranked(spark, folder), _policy(spark, folder))
    return rv.review_status(
        reviews(spark, folder), judged, review_queries(spark, folder), _degraded(spark, folder)
    ).select("repo", "pr", "status", "n_findings", "n_blocking", "n_warning")


def event(spark, folder):
    return rv.review_event(spark, status(spark, folder)).select(
        "repo", "pr", "status", "event", "exit_code"
    )


_STATUS = f"""
, judged AS (SELECT r.*, {_JUDGE} AS blocks FROM ranked r JOIN policy USING (repo)),
found AS (SELECT repo, pr, count(*) AS n_findings, count(*) FILTER (blocks) AS n_blocking FROM judged GROUP BY ALL),
statuses AS (
  SELECT v.repo, v.pr, coalesce(n_findings, 0) AS n_findings, coalesce(n_blocking, 0) AS n_blocking,
    CASE WHEN n_blocking > 0 THEN 'BLOCKED'
         WHEN q.n IS NULL AND n_findings IS NULL AND d.n > 0 THEN 'FAILED'
         WHEN d.n > 0 THEN 'DEGRADED' ELSE 'PASS' END AS status
  FROM reviews v LEFT JOIN found USING (repo, pr)
  LEFT JOIN (SELECT repo, pr, count(*) AS n FROM queries GROUP BY ALL) q USING (repo, pr)
  LEFT JOIN (SELECT repo, pr, count(*) AS n FROM degraded GROUP BY ALL) d USING (repo, pr)
)
"""


def unchanged(spark, folder):
    """Findings out of scope, as counted by the scope step: rules `n3` here."""
    return _ranked(spark, folder).filter("rule_id = 'n3' and pr % 2 = 0").groupBy("repo", "pr").agg(
        F.count("*").alias("n_unchanged")
    )


def digest(spark, folder):
    return rv.review_digest(
        reviews(spark, folder), _ranked(spark, folder), review_queries(spark, folder),
        _degraded(spark, folder), unchanged(spark, folder),
    ).drop("n_low", "n_info")


def budget(spark, folder):
    capped = rv.cap_findings(_ranked(spark, folder))
    block = F.repeat(F.lit("x"), (F.length("title") + F.coalesce(F.col("line"), F.lit(7)) * 10).cast("int"))
    return rv.body_budget(capped.withColumn("block", block), fixed_chars=100, max_chars=4000).select(
        "repo", "pr", "n_shown", "n_trimmed"
    )


def cost(spark, folder):
    o = table(spark, folder, "orders")
    k = F.col("o_orderkey")
    before = F.when(k % 7 == 0, None).when(k % 7 == 1, F.lit(0.0)).otherwise((k % 1000 + 1) * 8.0)
    after = F.when(k % 11 == 0, None).otherwise((k % 1500) * 4.0)
    return o.select(
        "o_orderkey", rv.cost_delta(before.cast("double"), after.cast("double")).alias("delta")
    )


def disable(spark, folder):
    off = table(spark, folder, "nation").select(
        F.concat(F.lit("nation-"), F.col("n_nationkey").cast("string")).alias("repo"),
        pick(F.col("n_nationkey"), _RULES).alias("rule_id"),
    )
    return rv.disable_rules(findings(spark, folder), off).groupBy("repo", "rule_id").agg(
        F.count("*").alias("n")
    )


def sink(spark, folder):
    """Write all ranked findings, read them back, count per partition."""
    path = f"{shared_folder(spark)}/findings-{uuid.uuid4().hex}"
    write_findings(_ranked(spark, folder), path)
    return spark.read.parquet(path).groupBy("repo", "severity").agg(
        F.count("*").alias("n"), F.max("seq").alias("last_seq")
    )


def response(spark, folder):
    """Documents of at most three findings and markers, written as JSON and read back with their overflow."""
    judged = rv.should_block(_ranked(spark, folder), _policy(spark, folder))
    marks = _degraded(spark, folder)
    statuses = rv.review_status(reviews(spark, folder), judged, review_queries(spark, folder), marks)
    documents, overflow = rv.response_documents(statuses, judged, marks, unchanged(spark, folder), max_items=3)
    path = f"{shared_folder(spark)}/responses-{uuid.uuid4().hex}"
    write_responses(documents, overflow, path)
    back = spark.read.schema(documents.schema).json(f"{path}/documents")
    left = spark.read.schema(overflow.schema).json(f"{path}/overflow").groupBy("repo", "pr").agg(
        F.count("*").alias("n_overflow"), F.min("seq").alias("first_overflow")
    )
    shown = F.transform("findings", lambda f: F.concat_ws(":", f["position"].cast("string"), f["rule_id"], f["title"], f["blocks"].cast("string")))
    return back.join(left, ["repo", "pr"], "left").select(
        "repo", "pr", "status", "verdict", "blocked", F.col("counts.warnings").alias("warnings"), F.col("counts.omitted").alias("omitted"),
        F.col("counts.unchanged").alias("n_unchanged"), F.array_join(shown, ",").alias("findings"),
        F.array_join("degraded_stages", ",").alias("degraded_stages"), F.coalesce("n_overflow", F.lit(0)).alias("n_overflow"),
    )


def truncate(spark, folder):
    """Texts of paragraphs, some inside an open code fence, cut to 200 characters."""
    p = table(spark, folder, "part").select("p_partkey")
    k = F.col("p_partkey")
    line = F.concat(F.lit("line "), (k % 10).cast("string"))
    fence = F.when(k % 3 == 0, "```sql\n").otherwise("")
    body = F.concat(line, F.lit("\n\n"), fence, F.array_join(F.array_repeat(line, (k % 40).cast("int")), "\n\n"))
    return p.select("p_partkey", rv.hard_truncate(body, 200).alias("body"))


QUERIES = {
    "review_response": response,
    "hard_truncate": truncate,
    "merge_findings": merge,
    "rank_findings": rank,
    "cap_findings": cap,
    "layer_policy": policy,
    "should_block": blocks,
    "degraded": degraded,
    "review_status": status,
    "review_event": event,
    "review_digest": digest,
    "body_budget": budget,
    "cost_delta": cost,
    "disable_rules": disable,
    "findings_sink": sink,
}

ORACLES = {
    "review_response": _FINDINGS + "," + _POLICY + "," + _RUNS + _STATUS
    + """, placed AS (
        SELECT *, row_number() OVER (PARTITION BY repo, pr ORDER BY severity_rank, seq) AS place FROM judged
      ), shown AS (
        SELECT repo, pr, string_agg(concat_ws(':', place, rule_id, title, blocks), ',' ORDER BY place) AS findings
        FROM placed WHERE place <= 3 GROUP BY ALL
      ), marks AS (
        SELECT repo, pr, string_agg(marker, ',' ORDER BY stage, seq, marker) AS degraded_stages FROM (
          SELECT * FROM degraded QUALIFY row_number() OVER (PARTITION BY repo, pr ORDER BY stage, seq, marker) <= 3) GROUP BY ALL
      ), outside AS (
        SELECT repo, pr, count(*) AS n FROM ranked WHERE rule_id = 'n3' AND pr % 2 = 0 GROUP BY ALL)
      SELECT repo, pr, CASE WHEN degraded_stages IS NULL THEN 'completed' ELSE 'degraded' END AS status, status AS verdict,
        n_blocking > 0 AS blocked, n_findings - n_blocking AS warnings, greatest(n_findings - 3, 0) AS omitted,
        coalesce(o.n, 0) AS n_unchanged, coalesce(findings, '') AS findings, coalesce(degraded_stages, '') AS degraded_stages,
        greatest(n_findings - 3, 0) AS n_overflow
      FROM statuses LEFT JOIN shown USING (repo, pr) LEFT JOIN marks USING (repo, pr) LEFT JOIN outside o USING (repo, pr)""",
    "hard_truncate": f"""
      WITH t AS (
        SELECT p_partkey, 'line ' || (p_partkey % 10) || chr(10) || chr(10) || CASE WHEN p_partkey % 3 = 0 THEN '```sql' || chr(10) ELSE '' END
          || array_to_string(list_transform(range(p_partkey % 40), lambda i: 'line ' || (p_partkey % 10)), chr(10) || chr(10)) AS body FROM part
      ), cut AS (SELECT *, substr(body, 1, {200 - len(rv.TRUNCATION_NOTICE) - 8}) AS head FROM t),
      last AS (SELECT *, length(head) - strpos(reverse(head), chr(10) || chr(10)) - 1 AS upto FROM cut),
      kept AS (SELECT p_partkey, body, substr(head, 1, upto) AS kept FROM last)
      SELECT p_partkey, CASE WHEN length(body) <= 200 THEN body
        ELSE kept || CASE WHEN contains(kept, '```') THEN chr(10) || '```' ELSE '' END || {sql_quote(rv.TRUNCATION_NOTICE)} END AS body
      FROM kept""",
    "merge_findings": _FINDINGS
    + """SELECT repo, pr, CASE WHEN rule_id IN ('n1','n2','n3') THEN 1 ELSE 0 END AS stage, rule_id,
      count(*) AS n, min(seq) AS first_seq,
      count(CASE WHEN rule_id NOT IN ('n1','n2','n3') THEN confidence END) AS n_confidence
      FROM raw GROUP BY ALL""",
    "rank_findings": _FINDINGS
    + "SELECT repo, pr, seq, rule_id, severity, severity_rank, query_id, file, line, title FROM ranked",
    "cap_findings": _FINDINGS
    + """SELECT c.repo, c.pr, position, c.seq, found, greatest(found - 20, 0) AS omitted FROM capped c
      JOIN (SELECT repo, pr, count(*) AS found FROM ranked GROUP BY ALL) USING (repo, pr)""",
    "layer_policy": _FINDINGS + "," + _POLICY
    + """SELECT p.*, n_findings FROM policy p
      LEFT JOIN (SELECT repo, count(*) AS n_findings FROM raw GROUP BY ALL) USING (repo)""",
    "should_block": _FINDINGS + "," + _POLICY
    + f"SELECT r.repo, pr, seq, rule_id, severity, {_JUDGE} AS blocks FROM ranked r JOIN policy USING (repo)",
    "degraded": "WITH " + _RUNS + "SELECT repo, pr, stage, seq, marker FROM degraded",
    "review_status": _FINDINGS + "," + _POLICY + "," + _RUNS + _STATUS
    + "SELECT repo, pr, status, n_findings, n_blocking, n_findings - n_blocking AS n_warning FROM statuses",
    "review_event": _FINDINGS + "," + _POLICY + "," + _RUNS + _STATUS
    + """SELECT repo, pr, status, CASE WHEN status = 'BLOCKED' THEN 'REQUEST_CHANGES' ELSE 'COMMENT' END AS event,
      CASE status WHEN 'BLOCKED' THEN 2 WHEN 'FAILED' THEN 1 ELSE 0 END AS exit_code FROM statuses""",
    "review_digest": _FINDINGS + "," + _RUNS
    + """, per AS (
        SELECT repo, pr, count(*) AS n_found, count(*) FILTER (severity = 'CRITICAL') AS n_critical,
          count(*) FILTER (severity = 'HIGH') AS n_high, count(*) FILTER (severity = 'MEDIUM') AS n_medium,
          count(*) FILTER (confidence = 0.75) AS n_strong, count(*) FILTER (confidence = 0.5) AS n_moderate,
          count(*) FILTER (confidence = 0.25) AS n_weak,
          count(*) FILTER (rule_id = 'n3' AND pr % 2 = 0) AS n_unchanged FROM ranked GROUP BY ALL
      ), q AS (
        SELECT repo, pr, count(*) AS n_queries, count(*) FILTER (unreadable) AS n_unreadable FROM queries GROUP BY ALL
      ), d AS (SELECT DISTINCT repo, pr, true AS is_degraded FROM degraded),
      j AS (
        SELECT v.repo, v.pr, coalesce(n_found, 0) AS n_found, coalesce(n_critical, 0) AS n_critical,
          coalesce(n_high, 0) AS n_high, coalesce(n_medium, 0) AS n_medium, coalesce(n_strong, 0) AS n_strong,
          coalesce(n_moderate, 0) AS n_moderate, coalesce(n_weak, 0) AS n_weak,
          coalesce(n_unchanged, 0) AS n_unchanged, coalesce(n_queries, 0) AS n_queries,
          coalesce(n_unreadable, 0) AS n_unreadable, coalesce(is_degraded, false) AS is_degraded
        FROM reviews v LEFT JOIN per USING (repo, pr) LEFT JOIN q USING (repo, pr) LEFT JOIN d USING (repo, pr)
      ), k AS (SELECT *, n_queries - n_unreadable AS n_analyzed, least(n_found, 20) AS n_shown,
                 greatest(n_found - 20, 0) AS n_omitted FROM j)
      SELECT * EXCLUDE (is_degraded),
        CASE WHEN n_queries = 0 AND is_degraded THEN 'Nothing readable here.'
             WHEN n_queries = 0 THEN 'No SQL here.'
             WHEN n_analyzed = 0 THEN n_queries || CASE WHEN n_queries = 1 THEN ' query' ELSE ' queries' END || ', all unreadable.'
             ELSE n_analyzed || CASE WHEN n_analyzed = 1 THEN ' query' ELSE ' queries' END || ' read, '
               || CASE n_found WHEN 0 THEN 'all fine' WHEN 1 THEN '1 finding' ELSE n_found || ' findings' END
               || CASE WHEN n_omitted = 0 THEN '' ELSE ' (first 20 listed)' END || '.' END
        || CASE WHEN n_unchanged = 0 THEN '' ELSE ' Outside the change: ' || n_unchanged || '.' END
        || CASE WHEN is_degraded OR n_unreadable > 0 THEN ' Parts were not read.' ELSE '' END AS headline
      FROM k""",
    "body_budget": _FINDINGS
    + """, sized AS (
        SELECT repo, pr, position, sum(7 + coalesce(line, 7) * 10) OVER (
          PARTITION BY repo, pr ORDER BY position) AS upto,
          count(*) OVER (PARTITION BY repo, pr) AS n FROM capped
      ), tried AS (
        SELECT DISTINCT repo, pr, n, n // CAST(pow(2, h) AS BIGINT) AS m FROM sized, (SELECT unnest(range(0, 5)) AS h)
        WHERE n // CAST(pow(2, h) AS BIGINT) > 0
      ), fit AS (
        SELECT t.repo, t.pr, max(t.m) AS m FROM tried t JOIN sized s
          ON s.repo = t.repo AND s.pr = t.pr AND s.position = t.m WHERE s.upto + 100 <= 4000 GROUP BY ALL
      )
      SELECT DISTINCT s.repo, s.pr, coalesce(m, 0) AS n_shown, n - coalesce(m, 0) AS n_trimmed
      FROM sized s LEFT JOIN fit USING (repo, pr)""",
    "cost_delta": """
      WITH o AS (SELECT o_orderkey,
        CASE WHEN o_orderkey % 7 = 0 THEN NULL WHEN o_orderkey % 7 = 1 THEN 0 ELSE (o_orderkey % 1000 + 1) * 8 END AS b,
        CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE (o_orderkey % 1500) * 4 END AS a FROM orders)
      SELECT o_orderkey, CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN
        format('{:,}.00 → {:,}.00', b, a) || CASE WHEN b <= 0 THEN ''
          WHEN a <= b THEN ' (' || CAST(floor((b - a)::DOUBLE / b * 100) AS BIGINT) || '% lower)'
          ELSE ' (' || CAST(ceil((a - b)::DOUBLE / b * 100) AS BIGINT) || '% higher)' END END AS delta FROM o""",
    "disable_rules": _FINDINGS
    + """SELECT repo, rule_id, count(*) AS n FROM raw WHERE NOT EXISTS (
        SELECT 1 FROM nation WHERE repo = 'nation-' || n_nationkey AND rule_id = CASE n_nationkey % 8
          WHEN 0 THEN 'missing-where' WHEN 1 THEN 'no-limit' WHEN 2 THEN 'select-star'
          WHEN 3 THEN 'unindexed-filter' WHEN 4 THEN 'non-sargable' WHEN 5 THEN 'n1' WHEN 6 THEN 'n2' ELSE 'n3' END)
      GROUP BY ALL""",
    "findings_sink": _FINDINGS
    + "SELECT repo, severity, count(*) AS n, max(seq) AS last_seq FROM ranked GROUP BY ALL",
}
