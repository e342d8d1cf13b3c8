"""Time the headline queries; prints one JSON line."""

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from stmtlens.catalog import all_queries  # noqa: E402
from stmtlens.session import local_session  # noqa: E402

HEADLINE = [
    "repeated_statements", "normalize_sql", "log_scan", "statement_split", "clause_facts",
    "rule_missing_where", "rule_select_star", "rule_no_limit", "rule_unindexed_filter",
    "added_ranges", "malformed_patches", "rank_findings", "cap_findings", "review_status",
    "index_state", "dedup_candidates", "order_summary", "scope_changes", "table_schema", "review_digest",
    "java_iterations", "call_sites", "review_job", "nplusone_job",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = local_session(cores, "bench")
    queries = all_queries()
    # One small query first, so that the first figure does not hold the JVM's start.
    queries["category_filter"](spark, folder).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in names:
        began = time.time()
        queries[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - began, 3)
    print(
        json.dumps(
            {
                "metric": "total_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": Path(folder).name.removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
