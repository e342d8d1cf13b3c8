"""Product codes of vectors, their codebooks trained by ball k-means.

Every part position has a codebook of its own.  The members of an entry form a ball around it.  By the
triangle inequality an entry can be as near to a member as its own only if the two entries are at most
twice the member's distance apart, so

* an entry's neighbours are those within twice the ball's radius,
* members nearer to their entry than half the way to the nearest neighbour, the stable core, do no work,
* the rest lie in rings: one in the ring between the halves of the ways to the m-th and the next
  neighbour is compared with the m nearest neighbours only.

All of it is done in squared integers, so the bounds are exact and ties go to the lower index.  The balls
are those of the rows that a task holds at a time: their radii are no larger than those of all rows, so
they leave out no entry that the balls of the whole table would keep.

A round is one pass over the vectors: a task assigns its rows, writes them with their new codes (the next
round's balls) and ends with the sums and counts of its entries, a number of rows fixed by the codebooks.
Those are added up by Spark, and the new entries, a few thousand numbers, travel with the next round.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stmtlens.llm.common import ship, table, written

SCALE = 4096
PARTS = 8
ENTRIES = 16
ROUNDS = 6
#: Rows whose balls are formed at a time.
_BLOCK = 1 << 14


def cuts(size: int, parts: int) -> list[int]:
    """Where the parts begin and end; the last ones are shorter where they can't be equal."""
    return [-(-size * i // parts) for i in range(parts + 1)]


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of rows to rows, in exact integers."""
    return ((a - b) ** 2).sum(axis=-1)


def first_assignment(rows: np.ndarray, book: np.ndarray) -> np.ndarray:
    """The nearest entry of every row, where there are no balls yet."""
    code, best = np.zeros(len(rows), dtype=np.int64), squared(rows, book[0])
    for i in range(1, len(book)):
        far = squared(rows, book[i])
        nearer = far < best
        code[nearer], best[nearer] = i, far[nearer]
    return code


def ball_assignment(rows: np.ndarray, book: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(entry, squared distance to it, comparisons made) of every row, from the entries ``code`` of the balls.

    The comparisons of members with their own entry, which give the radii, are counted in.
    """
    out, own = code.copy(), squared(rows, book[code])
    best, made = own.copy(), len(rows)
    ways = squared(book[:, None, :], book[None, :, :])
    order = np.argsort(code, kind="stable")
    ends = np.searchsorted(code[order], np.arange(len(book) + 1))
    for ball in range(len(book)):
        members = order[ends[ball] : ends[ball + 1]]
        if not len(members):
            continue
        reach = 4 * own[members]
        others = np.flatnonzero(ways[ball] <= reach.max())
        others = others[others != ball]
        others = others[np.argsort(ways[ball][others], kind="stable")]
        # Members by falling distance: those that still reach a neighbour come first.
        outer = np.argsort(-reach, kind="stable")
        members, reach = members[outer], reach[outer]
        rings = np.searchsorted(-reach, -ways[ball][others], side="right")
        for other, count in zip(others.tolist(), rings.tolist()):
            ring = members[:count]
            far = squared(rows[ring], book[other])
            made += count
            nearer = (far < best[ring]) | (far == best[ring]) & (other < out[ring])
            out[ring[nearer]], best[ring[nearer]] = other, far[nearer]
    return out, best, made


def _usable(vector: str):
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(F.col(vector).isNotNull() & ~bad, F.lit(False))


def integers(vectors: DataFrame, key: str, vector: str, label: str, scale: int, parts: int) -> tuple[DataFrame, int, np.dtype]:
    """(k, label, v) with the integers of the kept vectors packed, their length and their type.

    Kept are the vectors without null or non-finite components that have the table's most frequent
    length (the longer one of ties).
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(key).alias("k"), F.col(label).alias("label"), F.col(vector).cast("array<double>").alias("x"))
    rows = rows.filter(_usable("x"))
    peak = F.max(F.coalesce(F.array_max(F.transform("x", F.abs)), F.lit(0.0)))
    sizes = rows.groupBy(F.size("x").alias("size")).agg(F.count("*").alias("n"), peak.alias("peak"))
    most = sizes.orderBy(F.desc("n"), F.desc("size")).limit(1).collect()
    size, top = (most[0]["size"], most[0].peak * scale + 1) if most else (0, 0)
    widest = max(b - a for a, b in zip(cuts(size, parts), cuts(size, parts)[1:]))
    # Four squared distances must fit, as the rings compare such numbers.
    if 4 * widest * (2 * top) ** 2 >= 2**62:
        raise ValueError(f"components up to {top / scale:g} are too large for integer distances of scale {scale}")
    kind = np.dtype("<i2" if top < 1 << 15 else "<i4")
    ship(spark)
    key_type, label_type = (rows.schema[c].dataType.simpleString() for c in ("k", "label"))

    def pack(batches):
        for batch in batches:
            lists = batch.column(2)
            flat = np.floor(lists.flatten().to_numpy(zero_copy_only=False) * scale).astype(kind)
            made = flat.reshape(batch.num_rows, size) if batch.num_rows else flat.reshape(0, size)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([r.tobytes() for r in made], type=pa.binary())], names=["k", "label", "v"]
            )

    packed = rows.filter(F.size("x") == size).mapInArrow(pack, f"k {key_type}, label {label_type}, v binary")
    return packed, size, kind


def first_books(packed: DataFrame, entries: int, kind: np.dtype, at: list[int]) -> list[np.ndarray]:
    """The parts of the vectors with the smallest keys, ascending: one codebook for each position."""
    least = packed.orderBy(F.asc_nulls_last("k"), "v").limit(entries).select("v").collect()
    rows = np.array([np.frombuffer(r.v, dtype=kind) for r in least], dtype=np.int64).reshape(len(least), at[-1])
    return [rows[:, a:b] for a, b in zip(at, at[1:])]


def assigned(rows: DataFrame, books: list[np.ndarray], kind: np.dtype, at: list[int], balls: bool) -> DataFrame:
    """``rows`` (k, label, v, code) with new codes and errors, and the rows (slot, total) of the sums.

    ``code`` holds an entry for each part position, one byte each, and is read only with ``balls``.  A
    slot is a component of an entry of a position, or, in the last place of each, the count.
    """
    spans = list(zip(at, at[1:]))
    first = np.cumsum([0, *((b - a + 1) * len(book) for (a, b), book in zip(spans, books))])
    held = rows.sparkSession.sparkContext.broadcast(books)
    names = ["k", "label", "v", "code", "error", "slot", "total"]
    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in ("k", "label"))
    ship(rows.sparkSession)

    def run(batches):
        books, totals, types = held.value, np.zeros(first[-1], dtype=np.int64), None
        for whole in batches:
            types = [whole.schema.field(i).type for i in range(2)]
            for low in range(0, whole.num_rows, _BLOCK):
                batch = whole.slice(low, _BLOCK)
                n = batch.num_rows
                values = np.frombuffer(b"".join(batch.column(2).to_pylist()), dtype=kind).reshape(n, at[-1]).astype(np.int64)
                codes, error = np.zeros((n, len(books)), dtype=np.uint8), np.zeros(n, dtype=np.int64)
                before = np.frombuffer(b"".join(batch.column(3).to_pylist()), dtype=np.uint8).reshape(n, -1) if balls else None
                for p, ((a, b), book) in enumerate(zip(spans, books)):
                    part = np.ascontiguousarray(values[:, a:b])
                    start = before[:, p].astype(np.int64) if balls else first_assignment(part, book)
                    code, far, _ = ball_assignment(part, book, start) if balls else (start, squared(part, book[start]), 0)
                    codes[:, p] = code
                    error += far
                    sums = np.zeros((len(book), b - a + 1), dtype=np.int64)
                    np.add.at(sums, code, np.concatenate([part, np.ones((n, 1), dtype=np.int64)], axis=1))
                    totals[first[p] : first[p + 1]] += sums.ravel()
                none = pa.nulls(n, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns[:3], pa.array([c.tobytes() for c in codes], type=pa.binary()), pa.array(error), none, none], names=names
                )
        if types:
            n, empty = len(totals), pa.nulls(len(totals), pa.binary())
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(n, types[0]), pa.nulls(n, types[1]), empty, empty, pa.nulls(n, pa.int64()), pa.array(np.arange(n)), pa.array(totals)],
                names=names,
            )

    schema = f"{kinds}, v binary, code binary, error bigint, slot bigint, total bigint"
    return rows.select("k", "label", "v", "code").mapInArrow(run, schema)


def new_books(sums: DataFrame, books: list[np.ndarray]) -> list[np.ndarray]:
    """The entries replaced by the means of their members, rounded down; unused ones stay."""
    flat = np.zeros(sum(book.size + len(book) for book in books), dtype=np.int64)
    # As many rows as the codebooks have numbers.
    for r in sums.filter(F.col("slot").isNotNull()).groupBy("slot").agg(F.sum("total").alias("total")).collect():
        flat[r.slot] = r.total
    out, begin = [], 0
    for book in books:
        made = flat[begin : begin + book.size + len(book)].reshape(len(book), -1)
        begin += made.size
        count = made[:, -1:]
        out.append(np.where(count > 0, made[:, :-1] // np.maximum(count, 1), book))
    return out


def digest(books: list[np.ndarray]) -> str:
    """SHA-256 of all components in decimal, by part, entry and position within the part."""
    return hashlib.sha256(",".join(str(x) for book in books for x in book.ravel().tolist()).encode()).hexdigest()


def compress(
    vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE,
    key: str = "vec_id", vector: str = "embedding", label: str = "label",
) -> tuple[DataFrame, list[np.ndarray]]:
    """((k, label, code, error) of every kept vector, the codebooks): ``code`` has a byte for each part.

    Vectors that are null or hold a null or non-finite component are dropped, and so are those of
    another length than the table's most frequent one; empty vectors have empty parts.  A codebook
    starts with fewer entries if fewer vectors are kept.  Null keys come last where the first entries
    are chosen; repeated rows count as rows of their own.  Components too large for exact integer
    distances raise ValueError.  Up to 256 entries.  An empty table gives an empty result.
    """
    if not 0 < entries <= 256:
        raise ValueError("a code has one byte for each part")
    packed, size, kind = integers(vectors, key, vector, label, scale, parts)
    rows, at = written(packed, "vectors"), cuts(size, parts)
    books = first_books(rows, entries, kind, at)
    coded = rows.withColumn("code", F.lit(None).cast("binary"))
    if not len(books[0]):
        return coded.withColumn("error", F.lit(0).cast("bigint")).drop("v"), books
    for done in range(rounds + 1):
        made = written(assigned(coded, books, kind, at, balls=done > 0), "codes")
        coded = made.filter(F.col("slot").isNull()).select("k", "label", "v", "code", "error")
        if done < rounds:
            books = new_books(made, books)
    return coded.drop("v"), books


def op12_vector_codes(spark: SparkSession, folder: str) -> DataFrame:
    coded, books = compress(table(spark, folder, "embeddings"))
    by_label = coded.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"))
    same = F.col("label").eqNullSafe(F.col("of"))
    # A merge at every size: the number of labels is not known, and a hot one is split by the planner.
    return coded.join(by_label.hint("merge"), same).select(
        F.col("k").alias("vec_id"), F.lower(F.hex("code")).alias("code"), "error", "label_error",
        F.lit(digest(books)).alias("codebooks_sha256"),
    )


def _round_sql(i: int) -> str:
    return f"""
code{i} AS MATERIALIZED (
  SELECT r, p, arg_min(e, (far, e)) AS e, min(far) AS far FROM (
    SELECT c.r, c.p, b.e, sum((c.x - b.x) * (c.x - b.x))::BIGINT AS far
    FROM cells c JOIN book{i} b USING (p, j) GROUP BY ALL)
  GROUP BY ALL),"""


def _book_sql(i: int) -> str:
    return f"""
book{i} AS MATERIALIZED (
  SELECT p, j, b.e, coalesce(floor(m.total / m.n)::BIGINT, b.x) AS x FROM book{i - 1} b LEFT JOIN (
    SELECT p, j, e, sum(x) AS total, count(*) AS n FROM cells JOIN code{i - 1} USING (r, p) GROUP BY ALL) m
  USING (p, j, e)),"""


OP12_SQL = f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id NULLS LAST) AS r, vec_id, label, embedding, len(embedding) // {PARTS} AS width
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
cells AS MATERIALIZED (
  SELECT r, i // width AS p, i % width AS j, floor({SCALE} * x::DOUBLE)::BIGINT AS x
  FROM (SELECT r, width, unnest(embedding) AS x, generate_subscripts(embedding, 1) - 1 AS i FROM kept)),
book0 AS MATERIALIZED (SELECT p, j, r - 1 AS e, x FROM cells WHERE r <= {ENTRIES}),
{"".join(_round_sql(i) + _book_sql(i + 1) for i in range(ROUNDS))}
{_round_sql(ROUNDS)}
coded AS MATERIALIZED (
  SELECT r, string_agg(printf('%02x', e), '' ORDER BY p) AS code, sum(far)::BIGINT AS error FROM code{ROUNDS} GROUP BY 1)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error,
       (SELECT sha256(string_agg(x::VARCHAR, ',' ORDER BY p, e, j)) FROM book{ROUNDS}) AS codebooks_sha256
FROM kept JOIN coded USING (r)
"""
