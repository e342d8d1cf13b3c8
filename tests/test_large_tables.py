"""What must hold for tables of any size: steps taken once, and joins that keep no whole table in a task."""

import posixpath
import random

import pytest
from pyspark.sql import DataFrameWriter
from pyspark.sql import functions as F

import __spark_entry__ as entry
from stmtlens.catalog import changes, jobs
from stmtlens.functions import paths as pa
from stmtlens.operators import diff
from stmtlens.operators import java as jv
from stmtlens.session import cut_lineage

FOLDER = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_precedence_gathers_no_table(spark):
    """Eight look-ups by repository; their sides are as many as the reviews."""
    assert "Broadcast" not in plan(entry.queries()["schema_precedence"](spark, FOLDER))


def test_schema_review_gathers_no_table(spark, monkeypatch):
    """Repositories, files and reviews are as many as the data; the planner takes them for their compressed keys."""
    plans, write = [], DataFrameWriter.parquet

    def seen(self, *args, **options):
        plans.append(plan(self._df))
        return write(self, *args, **options)

    monkeypatch.setattr(DataFrameWriter, "parquet", seen)
    found = entry.queries()["schema_review_job"](spark, FOLDER)
    assert plans and not [p for p in [*plans, plan(found)] if "Broadcast" in p]


def test_written_tables_are_merged(spark):
    """The bytes of a compressed file say little about its rows."""
    rows = cut_lineage(spark.range(1000).select(F.concat(F.lit("repo"), F.col("id")).alias("repo")))
    narrow = rows.filter("repo <> 'x'").select("repo").distinct()
    joined = spark.range(10).select(F.concat(F.lit("repo"), F.col("id")).alias("repo")).join(narrow, "repo")
    assert "Broadcast" not in plan(joined) and joined.count() == 10


@pytest.mark.parametrize(("name", "step"), [("scope_changes", "posexplode"), ("root_scoring", "MapInPandas"), ("table_schema", "MapInPandas")])
def test_texts_are_read_once(spark, name, step):
    """Patches are cut to lines, and changelogs parsed, into a table that all later steps read."""
    assert step not in plan(entry.queries()[name](spark, FOLDER))


def test_range_lines_give_the_same_ranges(spark):
    files = changes.patches(spark, FOLDER)
    keys = ("repo", "pr", "path")
    every, few = diff.patch_lines(files, keys), diff.range_lines(files, keys)
    for step in (diff.hunks, diff.added_ranges, diff.change_ranges):
        assert sorted(map(tuple, step(every, keys).collect())) == sorted(map(tuple, step(few, keys).collect()))


def test_paths_as_posix_has_them(spark):
    pick = random.Random(2)
    names = ["".join(pick.choice("a./") for _ in range(pick.randint(0, 9))) for _ in range(2000)] + ["a.b/..c/.d", "x...", "..."]
    # Two leading slashes are one here; POSIX leaves them to the system.
    names = [n for n in names if not n.startswith("//")]
    got = spark.createDataFrame([(n,) for n in names], "p string").select("p", pa.normpath(F.col("p")).alias("n")).collect()
    assert [(r.p, r.n) for r in got if r.n != posixpath.normpath(r.p)] == []
    assert spark.createDataFrame([(None,)], "p string").select(pa.normpath(F.col("p"))).first()[0] is None


def test_a_log_is_lexed_once_for_evidence(spark):
    """The groups are read for their tables, for the look-up and for its rank; lines of a log have columns cut by bars."""
    text = plan(entry.queries()["runtime_correlation"](spark, FOLDER))
    assert "o_orderkey" not in text and "elapsed_ms" in text


def test_payloads_are_parsed_once(spark):
    """Changed files are read for their patches, their head texts and themselves."""
    text = plan(entry.queries()["ingest_outcome"](spark, FOLDER))
    assert "from_json" not in text and "o_orderkey" not in text


def test_log_lines_are_made_by_all_tasks(spark):
    """The given table is one file: without a spread one task would write and parse the lines of all repositories."""
    assert jobs.statement_lines(spark, FOLDER).rdd.getNumPartitions() >= int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_java_steps_sort_little(spark):
    """Names of type heads are gathered in one grouping; of files with annotated queries only these and their arguments are handed over."""
    files = spark.createDataFrame([("r", "a", 'interface A extends B { @Query("q") int x(int y); void z(int a, int b); }')], "repo string, path string, content string")
    assert "Window" not in plan(jv.java_types(jv.java_levels(files, read=jv.READ)))
    read = jv.java_levels(files, literals=True, columns=("tok", "pos"), read=jv.QUERIES)
    assert [r.tok for r in read.orderBy("pos").collect()] == ["Query", '"q"']
