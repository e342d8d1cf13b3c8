"""Embedding near-duplicates by int8 tile products with rigorous error bounds.

Equal vectors are one class with a count, so copies cost one row.  Classes are dealt into blocks,
and every pair of blocks is a task: its vectors are scaled to unit length, u = s q + e with int8
values q, and the length of the rest e is kept.  Then u.v lies within |sq||f| + |e||tr| + |e||f| of
the integer tile product st(q.r).  Pairs whose interval lies above or below the threshold are
decided by it; only pairs possibly on either side are recomputed in double precision.

A task returns, for each of its classes, the rows linked to it and one label of its local
component, never the pairs, so a group of near copies of any size costs a row per member and task.
The products are quadratic in the number of distinct vectors, as an exact join of unstructured
vectors is; memory is bounded by a pair of blocks.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stmtlens.llm.common import components, ship, table, written

THRESHOLD = 0.9
#: Vectors of one block, at most on average, and the least number of blocks.
BLOCK = 4096
LEAST_BLOCKS = 16
#: Rows of a block whose products are held at once.
_STRIP = 512
#: Rounding of the double-precision sums themselves; such pairs are recomputed, too.
_SLACK = 1e-9


class Quantised:
    """Vectors as int8 values with scales and the lengths that the bounds need."""

    def __init__(self, vectors: np.ndarray):
        self.full = vectors
        peak = np.abs(vectors).max(axis=1, keepdims=True)
        unit = vectors / peak
        unit /= np.linalg.norm(unit, axis=1, keepdims=True)
        self.scale = np.abs(unit).max(axis=1) / 127
        self.values = np.rint(unit / self.scale[:, None]).astype(np.int8)
        near = self.values * self.scale[:, None]
        self.length = np.linalg.norm(near, axis=1)
        self.rest = np.linalg.norm(unit - near, axis=1) + 1e-12
        # Sums of products of int8 values are exact in single precision up to 2 ** 24.
        exact = np.float32 if vectors.shape[1] * 127 * 127 < 1 << 24 else np.float64
        self.operand = self.values.astype(exact)

    def strip(self, part: slice) -> "Quantised":
        out = object.__new__(Quantised)
        for name, value in self.__dict__.items():
            setattr(out, name, value[part])
        return out


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, in double precision."""
    a = a / np.abs(a).max(axis=1, keepdims=True)
    b = b / np.abs(b).max(axis=1, keepdims=True)
    return (a * b).sum(axis=1) / (np.sqrt((a * a).sum(axis=1)) * np.sqrt((b * b).sum(axis=1)))


def linked(a: Quantised, b: Quantised, threshold: float) -> np.ndarray:
    """Which pairs have a cosine of ``threshold`` or more, as a matrix."""
    near = (a.operand @ b.operand.T).astype(np.float64) * a.scale[:, None] * b.scale[None, :]
    bound = a.length[:, None] * b.rest[None, :] + a.rest[:, None] * (b.length + b.rest)[None, :] + _SLACK
    sure = near - bound >= threshold
    left, right = np.nonzero((near + bound >= threshold) & ~sure)
    for at in range(0, len(left), 1 << 16):
        i, j = left[at : at + (1 << 16)], right[at : at + (1 << 16)]
        sure[i, j] = cosine(a.full[i], b.full[j]) >= threshold
    return sure


def _join_labels(labels: np.ndarray, left: np.ndarray, right: np.ndarray) -> None:
    """Give linked nodes the least label of their component, in place."""
    while True:
        a, b = labels[left], labels[right]
        apart = a != b
        if not apart.any():
            return
        a, b = a[apart], b[apart]
        np.minimum.at(labels, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = labels[labels]
            if (up == labels).all():
                break
            labels[:] = up


def _tile(rows: pd.DataFrame, threshold: float) -> pd.DataFrame:
    """Links of one pair of blocks: (cls, links, label)."""
    i, j = int(rows["_i"].iloc[0]), int(rows["_j"].iloc[0])
    first = np.flatnonzero((rows["block"] == i).to_numpy())
    second = first if i == j else np.flatnonzero((rows["block"] == j).to_numpy())
    weight = rows["n"].to_numpy()
    links, labels = np.zeros(len(rows), dtype=np.int64), np.arange(len(rows))
    if len(first) and len(second):
        all_rows = Quantised(np.stack(rows["embedding"].to_list()).astype(np.float64))
        others = all_rows.strip(second)
        for at in range(0, len(first), _STRIP):
            own = first[at : at + _STRIP]
            hit = linked(all_rows.strip(own), others, threshold)
            if i == j:
                hit[np.arange(len(own)), at + np.arange(len(own))] = False
            links[own] += hit @ weight[second]
            if i != j:
                links[second] += weight[own] @ hit
            x, y = np.nonzero(hit)
            _join_labels(labels, own[x], second[y])
    cls = rows["cls"].to_numpy()
    out = pd.DataFrame({"cls": cls, "links": links, "label": cls[labels]})
    return out[out["links"] > 0]


def near_vectors(
    vectors: DataFrame, threshold: float = THRESHOLD, key: str = "vec_id", vector: str = "embedding"
) -> DataFrame:
    """(key, n_links, component_id, kept) for every row of ``vectors``.

    Null, empty and zero vectors and those with a null or non-finite component link with nothing
    and are kept (unless their key is null, which is never kept); vectors of different lengths
    don't link.  Repeated rows count as vectors of their own.  A component is named by its least
    key.  Other columns are not read; an empty table gives an empty result.
    """
    rows = vectors.select(F.col(key).alias("k"), F.col(vector).cast("array<double>").alias("embedding"))
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    usable = F.coalesce(
        F.col("embedding").isNotNull() & ~bad & F.exists("embedding", lambda x: x != 0), F.lit(False)
    )
    # Minus zero and zero are one value to a grouping as well as to a product.
    rows = rows.withColumn("usable", usable)
    distinct = rows.filter("usable").groupBy("embedding").agg(F.count("*").alias("n"), F.min("k").alias("first"))
    classes = written(distinct.withColumn("cls", F.monotonically_increasing_id()), "classes")
    blocks = max(LEAST_BLOCKS, -(-classes.count() // BLOCK))
    dealt = classes.select(
        "cls", "n", "embedding", F.size("embedding").alias("size"),
        F.pmod(F.xxhash64("cls"), F.lit(blocks)).cast("int").alias("block"),
        F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("other"),
    ).select("cls", "n", "embedding", "size", "block", F.least("block", "other").alias("_i"), F.greatest("block", "other").alias("_j"))
    ship(vectors.sparkSession)
    tiles = written(
        dealt.groupBy("size", "_i", "_j").applyInPandas(
            lambda rows: _tile(rows, threshold), "cls bigint, links bigint, label bigint"
        ),
        "tiles",
    )
    links = tiles.groupBy("cls").agg(F.sum("links").alias("links"))
    roots = components(tiles.filter("cls <> label").select(F.col("cls").alias("a"), F.col("label").alias("b")))
    named = written(
        classes.select("cls", "embedding", "n", "first")
        .join(links, "cls", "left")
        .join(roots.withColumnRenamed("node", "cls"), "cls", "left")
        .select(
            "embedding", "first", F.coalesce("root", "cls").alias("root"),
            (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"),
        ),
        "named",
    )
    least = written(named.groupBy("root").agg(F.min("first").alias("component_id")), "least")
    by_vector = written(
        named.join(least, "root").select(F.col("embedding").alias("same"), "n_links", "component_id"), "vectors"
    )
    placed = rows.join(by_vector, rows.usable & (rows.embedding == by_vector.same), "left")
    component = F.when(F.col("usable"), F.col("component_id")).otherwise(F.col("k"))
    return placed.select(
        F.col("k").alias(key), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
        component.alias("component_id"), F.coalesce(F.col("k") == component, F.lit(False)).alias("kept"),
    )


def op9_embeddings(spark: SparkSession, folder: str) -> DataFrame:
    return near_vectors(table(spark, folder, "embeddings"))
