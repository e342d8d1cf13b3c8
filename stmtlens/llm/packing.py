"""Conflict-constrained best-fit packing of documents into training sequences.

A bin holds ``capacity`` units (words and one end mark per document).  It takes one document of a
duplicate cluster and at most ``per_source`` documents of a source.  Documents longer than a bin
are cut: their full pieces fill bins alone, the rest is packed.

Documents are dealt into groups of about ``GROUP_BINS`` bins by a hash, so a group is bounded
whatever the table holds, and each group is packed by best-fit decreasing: its bins lie in order
of their residual and carry bitmaps of their sources and clusters; the search for the successor of
a document's length goes on until it meets the first, hence tightest, bin without a conflict.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stmtlens.llm.common import SPACES, ship, table, written

CAPACITY = 4096
PER_SOURCE = 4
#: About so many bins in one group, the unit of work of a task.
GROUP_BINS = 128


def best_fit(items: list[tuple[int, int, int]], capacity: int, per_source: int) -> list[int]:
    """The bin of each item (length, source, cluster), in the order given.

    Sources and clusters are small numbers, bits of the bins' bitmaps.  Bitmap j of a bin's
    sources holds those with more than j documents in it; the last one tells a conflict.
    """
    order: list[tuple[int, int]] = []  # (residual, bin), ascending
    sources: list[list[int]] = []
    clusters: list[int] = []
    out, before, at = [], None, 0
    for item in items:
        length, source, cluster = item
        if item != before:
            at = bisect_left(order, (length, -1))
        # Else the search goes on where the last one ended: all bins passed hold this cluster.
        before = item
        source_bit, cluster_bit = 1 << source, 1 << cluster
        while at < len(order):
            number = order[at][1]
            if not (clusters[number] & cluster_bit or sources[number][-1] & source_bit):
                break
            at += 1
        if at < len(order):
            residual, number = order.pop(at)
            at += 1
        else:
            residual, number = capacity, len(clusters)
            sources.append([0] * per_source)
            clusters.append(0)
            at = len(order) + 1
        insort(order, (residual - length, number))
        clusters[number] |= cluster_bit
        for plane in range(per_source):
            if not sources[number][plane] & source_bit:
                sources[number][plane] |= source_bit
                break
        out.append(number)
    return out


def _pack_group(rows: pd.DataFrame, capacity: int, per_source: int) -> pd.DataFrame:
    """Bins of one group: columns _g, _row, length, source, cluster -> piece rows."""
    rows = rows.sort_values(["rest", "cluster", "source", "order", "nth"], ascending=[False, True, True, True, True])
    source = pd.factorize(rows["source"])[0]
    cluster = pd.factorize(rows["cluster"])[0]
    bins = best_fit(
        list(zip(rows["rest"].tolist(), source.tolist(), cluster.tolist())), capacity, per_source
    )
    used = max(bins, default=-1) + 1
    base = int(rows["_g"].iloc[0]) << 32
    out = {"_id": [], "nth": [], "piece": [], "start": [], "length": [], "bin": []}

    def add(key, nth, piece, length, number):
        for name, value in zip(out, (key, nth, piece, piece * capacity, length, base + number)):
            out[name].append(value)

    for key, nth, length, rest, number in zip(rows["_id"], rows["nth"], rows["length"], rows["rest"], bins):
        full = (length - rest) // capacity
        for piece in range(full):
            add(key, nth, piece, capacity, used)
            used += 1
        add(key, nth, full, rest, number)
    return pd.DataFrame(out)


def words_and_cluster(text: str = "text") -> tuple[Column, Column]:
    """(number of words, hash of the lower-case words): length and duplicate cluster of a text."""
    plain = F.btrim(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit(SPACES))
    words = F.split(plain, r"[\x20\x09-\x0D]+")
    return F.when(plain == "", F.lit(0)).otherwise(F.size(words)).cast("bigint"), F.xxhash64(words)


def pack(
    docs: DataFrame,
    capacity: int = CAPACITY,
    per_source: int = PER_SOURCE,
    key: str = "doc_id",
    text: str = "text",
    source: str = "source",
    length: Column | None = None,
    cluster: Column | None = None,
    group_bins: int = GROUP_BINS,
) -> DataFrame:
    """(key, copy, piece, start, length, bin): where every piece of every document lies.

    ``length`` and ``cluster`` default to the words of the text and their hash, so that texts
    alike but for case and white space are one cluster.  The end mark counts one unit in the
    last piece.  A null or empty text takes one unit; null sources are one source without a
    name; null keys stay null; repeated rows are told apart by ``copy`` (1, 2, ...) and, as one
    cluster, never share a bin.  Other columns are not read; an empty table gives an empty result.
    """
    words, same = words_and_cluster(text)
    rows = docs.select(
        F.col(key).cast("string").alias("_id"), F.xxhash64(F.col(source)).alias("source"),
        (F.coalesce(length if length is not None else words, F.lit(0)) + 1).cast("bigint").alias("length"),
        F.coalesce(cluster if cluster is not None else same, F.lit(0)).cast("bigint").alias("cluster"),
    )
    # The key travels as text: pandas would turn integers beside a null into floats.
    # Rows alike in all of these get numbers, so that even they spread over the groups.
    counted = rows.groupBy("_id", "source", "length", "cluster").agg(F.count("*").alias("n"))
    single = written(
        counted.select("_id", "source", "length", "cluster", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("nth"))
        .withColumn("rest", (F.col("length") - 1) % capacity + 1)
        .withColumn("order", F.xxhash64("_id", "source", "length", "cluster", "nth")),
        "lengths",
    )
    total = single.agg(F.sum("rest").alias("t")).first()["t"] or 0
    groups = max(1, -(-total // (capacity * group_bins)))
    dealt = single.withColumn("_g", F.pmod("order", F.lit(groups)))
    kind = docs.schema[key].dataType.simpleString()
    ship(docs.sparkSession)
    packed = dealt.groupBy("_g").applyInPandas(
        lambda rows: _pack_group(rows, capacity, per_source),
        "_id string, nth bigint, piece bigint, start bigint, length bigint, bin bigint",
    )
    return packed.select(F.col("_id").cast(kind).alias(key), F.col("nth").alias("copy"), "piece", "start", "length", "bin")


def op3_packing(spark: SparkSession, folder: str) -> DataFrame:
    return pack(table(spark, folder, "documents"))
