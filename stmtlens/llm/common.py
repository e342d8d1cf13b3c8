"""Helpers of the training-text operators: input columns, tables in the shared folder, components."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stmtlens.session import shared_folder

#: White space of the word rule: everything else is part of a word.
SPACES = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share."""
    return f"{shared_folder(spark)}/llm-{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table of the shared folder: lineage ends there."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_PACKAGE = "stmtlens-tasks.zip"


def ship(spark: SparkSession) -> None:
    """Give this package's modules to the Python workers, as ``--py-files`` would."""
    context = spark.sparkContext
    if any(str(f).endswith(_PACKAGE) for f in context.listFiles):
        return
    top = Path(__file__).resolve().parent.parent
    made = Path(tempfile.mkdtemp(prefix="stmtlens-")) / _PACKAGE
    with zipfile.ZipFile(made, "w") as archive:
        for path in sorted(top.rglob("*.py")):
            archive.write(path, path.relative_to(top.parent))
    context.addPyFile(str(made))


def parallelism(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Rows whose texts a Python task holds as strings at a time.
PART_ROWS = 1000


def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of the batches, some at a time: an Arrow batch may hold ten thousand texts."""
    for batch in batches:
        for at in range(0, batch.num_rows, PART_ROWS):
            yield batch.slice(at, PART_ROWS)


def map_texts(df: DataFrame, key: str, text: str, one: Callable[[str], tuple], schema: str) -> DataFrame:
    """``one(text)`` for every row, in Arrow batches: (key, *one(text)); a null text is empty.

    ``schema`` holds the columns that ``one`` returns.  Each row stands alone, so memory is
    bounded by a batch and a lost task is simply run again.
    """
    rows = df.select(F.col(key).alias("_key"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    out = df.sparkSession.createDataFrame([], schema).schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            made = [one(t) for t in batch.column(1).to_pylist()]
            columns = list(zip(*made)) if made else [[] for _ in out]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, type=t) for c, t in zip(columns, kinds))], names=[key, *out]
            )

    ship(df.sparkSession)
    kinds = arrow_types(df.sparkSession, schema)
    key_type = df.schema[key].dataType.simpleString()
    return rows.mapInArrow(run, f"`{key}` {key_type}, {schema}")


def arrow_types(spark: SparkSession, schema: str) -> list[pa.DataType]:
    known = {"bigint": pa.int64(), "array<bigint>": pa.list_(pa.int64()), "boolean": pa.bool_(), "string": pa.string(), "double": pa.float64(), "int": pa.int32()}
    return [known[f.dataType.simpleString()] for f in spark.createDataFrame([], schema).schema]


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node that each node of ``edges`` (a, b) can reach.

    Every round passes the smallest label over the links and then follows the label's own
    label, so the rounds grow with the logarithm of a chain, not its length.  Labels live in
    tables of the shared folder; all that reaches the driver is whether one changed.  Joins
    keep planner-made exchanges (so skewed hubs are split) and minima combine on the map side.
    Nodes without a link are not returned.
    """
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    links = written(both.filter("a <> b"), "links")
    labels = written(
        links.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("root")), "labels"
    )
    while True:
        offered = (
            links.join(labels, links.b == labels.node)
            .groupBy("a")
            .agg(F.min("root").alias("offer"))
        )
        lower = labels.join(offered, labels.node == offered.a, "left").select(
            "node", F.col("root").alias("old"), F.least("root", "offer").alias("root")
        )
        lower = written(lower, "lower")
        up = lower.select(F.col("node").alias("via"), F.col("root").alias("above"))
        after = lower.join(up, lower.root == up.via, "left").select(
            "node", "old", F.least("root", "above").alias("root")
        )
        after = written(after, "labels")
        labels = after.select("node", "root")
        if after.filter("root <> old").isEmpty():
            return labels
