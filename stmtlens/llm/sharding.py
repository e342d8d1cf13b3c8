"""Extendible hashing of documents into shards below a byte limit, with DataFrame operations only.

A directory is indexed by the leading bits of a hash of the key.  Only a bucket that is too large
is split on one more bit, so shards differ in depth and an entry of the directory points to the
bucket with its own (local) depth.

One aggregate gives the bytes of every cell at a depth at which a cell is a small part of the
limit; the coarser levels are sums of those, so the levels of the directory cost no pass over
the documents.  Cells that are still too large (a few long documents together) are counted again
some bits deeper, over their own rows alone, until they fit or can't be split.  Rows whose hashes
are equal go on with the bits of a second hash, over key, text digest and a copy number, so that
only a single row can be over the limit; such a shard is marked.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stmtlens.llm.common import table, written

#: Bytes of text in a shard.
LIMIT = 16 << 20
#: Bits of the hash: fifteen hexadecimal digits of MD5.
BITS = 60
#: Bits by which the first count is finer than one cell per shard, and by which each next one is.
FINER = 4


def key_hash(key: str) -> Column:
    """The hash of the key as a number of ``BITS`` bits; a null key is hashed as an empty one."""
    digest = F.md5(F.coalesce(F.col(key).cast("string"), F.lit("")))
    return F.conv(F.substring(digest, 1, BITS // 4), 16, 10).cast("bigint")


def _prefix(hashed: Column, depth: Column) -> Column:
    return F.shiftright(hashed, BITS - depth) if isinstance(depth, int) else F.expr(
        f"shiftright(hashed, {BITS} - depth)"
    )


def _cells(rows: DataFrame, depth: int, by: list[str]) -> DataFrame:
    """Bytes and rows of each cell at ``depth``, and whether it can be split further."""
    return rows.groupBy(*by, _prefix(F.col("hashed"), depth).alias("cell")).agg(
        F.sum("bytes").alias("bytes"), F.count("*").alias("rows"), (F.min("hashed") < F.max("hashed")).alias("splits")
    )


def _leaves(cells: DataFrame, base: int, depth: int, limit: int, by: list[str]) -> DataFrame:
    """(cell, leaf depth) for the cells counted at ``depth``, whose cells at ``base`` are too large.

    The leaf of a cell is the first level on its path that fits; one whose own bytes are too many
    has the depth null.
    """
    levels = cells.select(
        *by, "cell", "bytes", F.explode(F.sequence(F.lit(base), F.lit(depth))).alias("depth")
    ).select(*by, "cell", "bytes", "depth", F.expr(f"shiftright(cell, {depth} - depth)").alias("node"))
    nodes = levels.groupBy(*by, "depth", "node").agg(F.sum("bytes").alias("node_bytes"))
    fits = levels.join(nodes, [*by, "depth", "node"]).groupBy(*by, "cell").agg(
        F.min(F.when(F.col("node_bytes") <= limit, F.col("depth"))).alias("leaf")
    )
    return fits


def directory(rows: DataFrame, limit: int = LIMIT, by: tuple[str, ...] = ()) -> DataFrame:
    """(depth, prefix): the buckets that the rows (hashed, bytes) fill, as leaves of the directory.

    With ``by``, one directory for each value of those columns.  Every row lies in exactly one.  A bucket at the depth ``BITS`` may be over the limit.
    """
    by = list(by)
    total = rows.groupBy(*by).agg(F.sum("bytes").alias("t")).agg(F.max("t").alias("t")).first()["t"] or 0
    base, depth = 0, min(BITS, max(0, math.ceil(math.log2(max(1, total / limit)))) + FINER)
    found, left = None, rows
    while True:
        cells = written(_cells(left, depth, by), "cells")
        leaves = written(_leaves(cells, base, depth, limit, by).join(cells, [*by, "cell"]), "leaves")
        # What can't be split is a leaf where it parts from the others; any depth from here names it.
        done = leaves.filter(F.col("leaf").isNotNull() | ~F.col("splits")).select(
            *by, F.coalesce("leaf", F.lit(depth)).alias("depth"),
            F.expr(f"shiftright(cell, {depth} - coalesce(leaf, {depth}))").alias("prefix"),
        ).distinct()
        found = done if found is None else found.union(done)
        deeper = leaves.filter(F.col("leaf").isNull() & F.col("splits")).select(*by, "cell")
        if depth == BITS or deeper.isEmpty():
            return found
        left = written(
            left.withColumn("cell", _prefix(F.col("hashed"), depth)).join(deeper, [*by, "cell"], "left_semi").select(
                *by, "hashed", "bytes"
            ),
            "large",
        )
        base, depth = depth, min(BITS, depth + FINER)


def _place(rows: DataFrame, limit: int, by: tuple[str, ...] = ()) -> DataFrame:
    """``rows`` with the depth and prefix of the bucket of each."""
    leaves = written(directory(rows, limit, by), "directory")
    # Depths that occur are few; a row meets its bucket by equality on one of them.
    depths = sorted(r["depth"] for r in leaves.select("depth").distinct().collect())
    sought = rows.withColumn(
        "depth", F.explode(F.array(*[F.lit(d) for d in depths]).cast("array<int>"))
    ).withColumn("prefix", F.expr(f"shiftright(hashed, {BITS} - depth)")) if depths else rows.withColumns(
        {"depth": F.lit(0), "prefix": F.lit(0).cast("bigint")}
    )
    names = [*by, "depth", "prefix"]
    return written(sought.join(leaves, names).select(*rows.columns, "depth", "prefix"), "placed")


def _bits() -> Column:
    return F.when(F.col("depth") == 0, "").otherwise(F.expr("lpad(bin(prefix), depth, '0')"))


def _assign(rows: DataFrame, limit: int) -> DataFrame:
    """(_id, bytes, copy, shard) of the rows (_id, bytes, hashed, digest, copy).

    Rows without a copy number get one among those alike where a bucket's key can't split it.
    """
    rows = written(rows, "rows")
    placed = _place(rows, limit).withColumn("shard", _bits())
    large = written(
        placed.groupBy("shard").agg(F.sum("bytes").alias("b"), F.count("*").alias("n"))
        .filter((F.col("b") > limit) & (F.col("n") > 1)).select("shard"),
        "large",
    )
    if large.isEmpty():
        return placed.select("_id", "bytes", "copy", "shard")
    alike = ["_id", "bytes", "digest", "copy", "shard"]
    counted = placed.join(large, "shard", "left_semi").groupBy(*alike).agg(F.count("*").alias("n"))
    second = F.md5(F.to_json(F.struct("_id", "digest", "copy", "nth")))
    parted = counted.select(*alike, F.explode(F.sequence(F.lit(1), F.col("n"))).alias("nth")).select(
        *alike, F.conv(F.substring(second, 1, BITS // 4), 16, 10).cast("bigint").alias("hashed")
    )
    parted = _place(written(parted, "parted"), limit, ("shard",))
    return placed.join(large, "shard", "left_anti").select("_id", "bytes", "copy", "shard").union(
        parted.select("_id", "bytes", "copy", F.concat("shard", _bits()).alias("shard"))
    )


def _rows(docs: DataFrame, key: str, text: str, copy: Column) -> DataFrame:
    return docs.select(
        F.col(key).alias("_id"),
        F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint").alias("bytes"),
        key_hash(key).alias("hashed"), F.xxhash64(text).alias("digest"), copy.cast("bigint").alias("copy"),
    )


def assign_shards(docs: DataFrame, limit: int = LIMIT, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_bytes, shard, depth, shard_rows, shard_bytes, over_limit) for every row of ``docs``.

    ``shard`` is the bit string of the bucket ("" if one shard holds all).  A null text has no
    bytes, a null key is hashed as an empty text.  Rows with equal keys share a shard if it fits,
    else a second hash parts them; a shard with a single row may be over the limit and says so.
    Other columns are not read; an empty table gives an empty result.
    """
    placed = written(_assign(_rows(docs, key, text, F.lit(None)), limit), "assigned")
    sizes = placed.groupBy("shard").agg(F.count("*").alias("shard_rows"), F.sum("bytes").alias("shard_bytes"))
    return placed.join(written(sizes, "sizes"), "shard").select(
        F.col("_id").alias(key), F.col("bytes").alias("n_bytes"), "shard",
        F.length("shard").cast("bigint").alias("depth"), "shard_rows", "shard_bytes",
        (F.col("shard_bytes") > limit).alias("over_limit"),
    )


def write_shards(docs: DataFrame, path: str, limit: int = LIMIT, key: str = "doc_id", text: str = "text") -> None:
    """Write ``docs`` with one folder per shard; rows are numbered in a table of the shared folder."""
    numbered = written(docs.withColumn("_llm_row", F.monotonically_increasing_id()), "numbered")
    shards = _assign(_rows(numbered, key, text, F.col("_llm_row")), limit).select(
        F.col("copy").alias("_llm_row"), F.col("shard").alias("_shard")
    )
    (
        numbered.join(shards, "_llm_row")
        .drop("_llm_row")
        .repartition("_shard")
        .write.partitionBy("_shard")
        .parquet(path)
    )


def op1_sharding(spark: SparkSession, folder: str) -> DataFrame:
    return assign_shards(table(spark, folder, "documents"))


#: The same leaves by definition: sums at every depth, the first that fits on each row's path.
#: A bucket that never fits is a leaf at the depth where the query stops counting.
OP1_SQL = f"""
WITH rows AS (
  SELECT doc_id, coalesce(strlen(text), 0)::BIGINT AS n_bytes,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, {BITS // 4}))::BIGINT AS hashed
  FROM documents),
levels AS (
  SELECT d.depth, r.hashed >> ({BITS} - d.depth) AS prefix, sum(n_bytes) AS bytes, count(*) AS n
  FROM rows r, generate_series(0, 40) d(depth) GROUP BY 1, 2),
leaf AS (
  SELECT r.doc_id, r.n_bytes, r.hashed, min(l.depth) AS depth
  FROM rows r JOIN levels l ON l.prefix = r.hashed >> ({BITS} - l.depth)
  WHERE l.bytes <= {LIMIT} GROUP BY ALL),
named AS (
  SELECT doc_id, n_bytes, depth, hashed >> ({BITS} - depth) AS prefix FROM leaf)
SELECT doc_id, n_bytes,
       CASE WHEN depth = 0 THEN '' ELSE lpad(bin(prefix), depth::INT, '0') END AS shard, depth::BIGINT AS depth,
       count(*) OVER (PARTITION BY depth, prefix) AS shard_rows,
       (sum(n_bytes) OVER (PARTITION BY depth, prefix))::BIGINT AS shard_bytes, false AS over_limit
FROM named
"""
