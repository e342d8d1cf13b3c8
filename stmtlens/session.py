"""Session helpers: local defaults, checkpoint folder, checked broadcasts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Settings for a local run.  A cluster passes its own; none of them is needed
#: for right results.
LOCAL_CONF = {
    "spark.sql.shuffle.partitions": "8",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.driver.memory": "8g",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Plans here have thousands of column expressions; noting the Python line of each costs seconds.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def local_session(cores: int | str = 8, name: str = "stmtlens") -> SparkSession:
    builder = SparkSession.builder.master(f"local[{cores}]").appName(name)
    for key, value in LOCAL_CONF.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_LOCAL_FOLDER: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors see, as the cluster names it in ``spark.checkpoint.dir``.

    Only where that is unset and all tasks run in one process (tests, a laptop) a local one
    stands in; on a cluster its absence is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not _LOCAL_FOLDER:
        _LOCAL_FOLDER.append(tempfile.mkdtemp(prefix="stmtlens-"))
    return _LOCAL_FOLDER[0]


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    One pass over ``df``, unlike an eager checkpoint, which computes it twice; lost
    executors cost nothing.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/stmtlens-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return sorted_joins(spark.read.schema(df.schema).parquet(path))


def sorted_joins(df: DataFrame) -> DataFrame:
    """``df`` as a table that grows with the data: its joins sort and merge.

    The planner takes the bytes of compressed files for a table's size, and a million keys come to a few
    megabytes, so without this they are gathered on the driver and kept whole in the memory of every task.
    """
    return df.hint("merge")


def literal_rows(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A fixed lookup table.  Its size is that of the code, never of the data."""
    return spark.createDataFrame(rows, schema)


def fixed_broadcast(df: DataFrame) -> DataFrame:
    """Broadcast hint for a table made by :func:`literal_rows`."""
    return F.broadcast(df)
