"""Importance resampling towards a target distribution, with a head-tail vocabulary.

Features are the runs of one to ``longest`` words of a text; each is hashed to a bucket by the CRC-32 of
its bytes.  Words are found as bytes.  The frequent words (the head) travel to every task with their
exact CRC state, the frequent pairs with their bucket; a word of the tail takes its CRC directly, and a
run is the state of its first word fed with the rest.  Head and tail give the same numbers, so the choice
of the head changes no result: it is taken from mergeable counts of bounded size.

Every task adds up its buckets and returns one row for each bucket it met, so the exact totals cost a
shuffle of buckets, not of words.  The bucket numbers of a text are kept beside its key, and the gains of
all buckets (a table of fixed size) are looked up in them.  The drawn rows get their ranks from a sort by
ranges: a row's rank is its place in its range and the rows of the ranges before.
"""

from __future__ import annotations

import math
from binascii import crc32
from collections import Counter
from collections.abc import Iterator
from itertools import islice, pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stmtlens.llm.common import arrow_types, parallelism, parts, ship, table, written

BUCKETS = 10_000
LONGEST = 1
SEED = 2024
LEAST_WORDS = 20
DRAWN_PERCENT = 10
#: Frequent words, and frequent pairs, that travel to every task: a fixed bound of some megabytes.
HEAD = 1 << 15
#: Longer words are never of the head, so that the bound on its number bounds its bytes.
HEAD_BYTES = 64
#: Counters that a task may hold while it looks for frequent words.
_COUNTERS = 4 * HEAD
#: Words of one text that are held as objects at a time.
_BLOCK = 1 << 16

_KEPT = b"0123456789abcdefghijklmnopqrstuvwxyz" + bytes(range(128, 256))
#: Lower case for A-Z; every byte that is no part of a word is a space.
_BYTES = bytes(c if c in _KEPT else 32 for c in bytes(range(256)).lower())


def words_of(text: bytes) -> list[bytes]:
    """The words of a UTF-8 text: A-Z lower-cased, then runs of digits, letters and all beyond ASCII."""
    return text.translate(_BYTES).split()


class States(dict):
    """CRC states of words: those of the head are held, one of the tail is worked out."""

    def __missing__(self, word: bytes) -> int:
        return crc32(word)


class Pairs(dict):
    """Buckets of pairs of words: those of the head are held, one of the tail is worked out."""

    def __init__(self, states: States, pairs: list[tuple[bytes, bytes]], buckets: int):
        super().__init__((p, crc32(b" ".join(p)) % buckets) for p in pairs)
        self.states, self.buckets = states, buckets

    def __reduce__(self):
        return Pairs, (self.states, list(self), self.buckets)

    def __missing__(self, pair: tuple[bytes, bytes]) -> int:
        return crc32(b" " + pair[1], self.states[pair[0]]) % self.buckets


class Vocabulary:
    """The head of words and pairs, and the buckets of the runs of a list of words."""

    def __init__(self, words: list[bytes], pairs: list[tuple[bytes, bytes]], buckets: int):
        self.buckets = buckets
        self.states = States((w, crc32(w)) for w in words)
        self.pairs = Pairs(self.states, pairs, buckets)

    def features(self, words: list[bytes], longest: int, begun: int) -> np.ndarray:
        """The buckets of all runs of one to ``longest`` words that begin in the first ``begun`` words."""
        states = np.fromiter(map(self.states.__getitem__, words[:begun]), np.int64, min(begun, len(words)))
        out = [states % self.buckets]
        if longest > 1:
            count = max(0, min(begun, len(words) - 1))
            out.append(np.fromiter(map(self.pairs.__getitem__, islice(pairwise(words), count)), np.int64, count))
        state = states.tolist() if longest > 2 else []
        for more in range(1, longest if longest > 2 else 0):
            state = [crc32(b" " + w, s) for s, w in zip(state, words[more:])]
            if more > 1:
                out.append(np.array(state, dtype=np.int64) % self.buckets)
        return np.concatenate(out)


def _blocks(words: list[bytes], longest: int) -> Iterator[tuple[list[bytes], int]]:
    """Blocks of a text's words with the words that runs begun in them reach, and the words of the block."""
    for at in range(0, len(words), _BLOCK):
        yield words[at : at + _BLOCK + longest - 1], min(_BLOCK, len(words) - at)


def _bucket_type(buckets: int) -> np.dtype:
    return np.dtype("<u2" if buckets <= 1 << 16 else "<u4")


def _trimmed(counts: Counter, most: int) -> Counter:
    """The counts less the count of the one after the first ``most``: every share over 1 / most stays."""
    if len(counts) <= most:
        return counts
    cut = int(np.partition(np.fromiter(counts.values(), np.int64, len(counts)), -most - 1)[-most - 1])
    return Counter({w: n - cut for w, n in counts.items() if n > cut})


def frequent(texts: DataFrame, longest: int = LONGEST, head: int = HEAD) -> tuple[list, list]:
    """The frequent words and (for runs of two or more) pairs of all texts, ``head`` of each at most.

    Each task keeps counters of bounded number, which lose no word that makes up more than one in
    ``_COUNTERS`` of its words; the sums of all tasks rank them.  ``texts`` has one binary column.
    """
    ship(texts.sparkSession)

    def run(batches):
        counts = (Counter(), Counter())
        for batch in parts(batches):
            for text in batch.column(0).to_pylist():
                words = words_of(text or b"")
                for block, own in _blocks(words, 2):
                    counts[0].update(block[:own])
                    if longest > 1:
                        counts[1].update(pairwise(block))
                    counts = tuple(_trimmed(c, _COUNTERS) if len(c) > 2 * _COUNTERS else c for c in counts)
        rows = [(0, w, b"", n) for w, n in counts[0].most_common(head) if len(w) <= HEAD_BYTES]
        rows += [(1, *p, n) for p, n in counts[1].most_common(head) if len(p[0]) + len(p[1]) <= HEAD_BYTES]
        kinds = [pa.int32(), pa.binary(), pa.binary(), pa.int64()]
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[i] for r in rows], type=k) for i, k in enumerate(kinds)], names=["kind", "a", "b", "n"]
        )

    counted = written(
        texts.mapInArrow(run, "kind int, a binary, b binary, n bigint").groupBy("kind", "a", "b").agg(F.sum("n").alias("n")),
        "frequent",
    )
    found = []
    for kind in (0, 1) if longest > 1 else (0,):
        found.append(counted.filter(F.col("kind") == kind).orderBy(F.desc("n"), "a", "b").limit(head).select("a", "b"))
    rows = [[(bytes(r.a), bytes(r.b)) for r in f.collect()] for f in found]
    return [a for a, _ in rows[0]], rows[1] if longest > 1 else []


def bucket_rows(
    docs: DataFrame, key: str, text: str, vocabulary: Vocabulary, longest: int = LONGEST
) -> DataFrame:
    """(k, n_words, n_features, buckets, bucket, n): a row for each document with the bucket numbers of all
    its features as packed numbers (the last two null), and rows with a bucket and how many features
    of some of the documents it holds (the others null)."""
    kind, size = _bucket_type(vocabulary.buckets), vocabulary.buckets
    head = docs.sparkSession.sparkContext.broadcast(vocabulary)
    key_type = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("k"), F.col(text).cast("binary").alias("t"))
    schema = f"k {key_type}, n_words bigint, n_features bigint, buckets binary, bucket bigint, n bigint"
    ship(docs.sparkSession)
    names = ["k", "n_words", "n_features", "buckets", "bucket", "n"]
    longs = arrow_types(docs.sparkSession, "n bigint")[0]

    def run(batches):
        totals, key_kind = np.zeros(size, dtype=np.int64), None
        for batch in parts(batches):
            key_kind = batch.schema.field(0).type
            n_words, n_features, packed = [], [], []
            for value in batch.column(1).to_pylist():
                words, found = words_of(value or b""), []
                for block, own in _blocks(words, longest):
                    # A run that begins in the next block is counted there.
                    found.append(head.value.features(block, longest, own).astype(kind))
                every = np.concatenate(found) if found else np.zeros(0, dtype=kind)
                totals += np.bincount(every, minlength=size)
                n_words.append(len(words))
                n_features.append(len(every))
                packed.append(every.tobytes())
            empty = pa.nulls(batch.num_rows, longs)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n_words, longs), pa.array(n_features, longs), pa.array(packed, pa.binary()), empty, empty], names=names
            )
        hit = np.flatnonzero(totals)
        if len(hit):
            none = pa.nulls(len(hit), longs)
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(len(hit), key_kind), none, none, pa.nulls(len(hit), pa.binary()), pa.array(hit, longs), pa.array(totals[hit], longs)],
                names=names,
            )

    return rows.mapInArrow(run, schema)


def _totals(rows: DataFrame) -> DataFrame:
    """Features in each bucket; a table of as many rows as there are buckets."""
    return rows.filter(F.col("bucket").isNotNull()).groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(source: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> list[int]:
    """The gain of every bucket, from tables (bucket, n) of the source and of the target."""
    sides = source.select("bucket", F.col("n").alias("s"), F.lit(0).cast("bigint").alias("t")).union(
        target.select("bucket", F.lit(0).cast("bigint"), "n")
    )
    met = {r.bucket: (r.s, r.t) for r in sides.groupBy("bucket").agg(F.sum("s").alias("s"), F.sum("t").alias("t")).collect()}
    every_s, every_t = (float(sum(x[i] for x in met.values()) + buckets) for i in (0, 1))
    rows = (met.get(b, (0, 0)) for b in range(buckets))
    return [math.floor(1000 * math.log(float(t + 1) * every_s / (float(s + 1) * every_t))) for s, t in rows]


def noise(key: Column, seed: int = SEED) -> Column:
    """1000 Gumbel variates, rounded down, from a hash of the seed and the key."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def ranked(rows: DataFrame, order: list[Column], draw: int, name: str = "rank") -> DataFrame:
    """``rows`` with the place 1, 2, ... of the first ``draw`` in ``order``; of the others it is null.

    One shuffle by ranges; rows that are alike in all columns of the order lie in several ranges.
    """
    spark = rows.sparkSession
    salted = rows.withColumn("_llm_salt", F.monotonically_increasing_id())
    dealt = salted.repartitionByRange(parallelism(spark), *order, "_llm_salt").sortWithinPartitions(*order, "_llm_salt")
    # This number is the task's, times 2 ** 33, and the row's place in the task.
    placed = written(dealt.drop("_llm_salt").withColumn("_llm_at", F.monotonically_increasing_id()), "ranked")
    own = F.shiftright("_llm_at", 33)
    sizes = sorted((r.task, r.n) for r in placed.groupBy(own.alias("task")).agg(F.count("*").alias("n")).collect())
    before = [0, *np.cumsum([n for _, n in sizes]).tolist()]
    starts = spark.createDataFrame([(t, b) for (t, _), b in zip(sizes, before)], "_llm_task bigint, _llm_before bigint")
    # A row for each range.
    joined = placed.join(F.broadcast(starts), own == F.col("_llm_task"))
    place = F.col("_llm_before") + F.col("_llm_at").bitwiseAND((1 << 33) - 1) + 1
    return joined.select(*(F.col(f"`{c}`") for c in rows.columns), F.when(place <= draw, place).alias(name))


def resample(
    docs: DataFrame, target: DataFrame, longest: int = LONGEST, buckets: int = BUCKETS, seed: int = SEED,
    least_words: int = LEAST_WORDS, percent: int = DRAWN_PERCENT, key: str = "doc_id", text: str = "text",
    target_text: str = "text", head: int = HEAD,
) -> DataFrame:
    """(key, n_features, weight, score, rank) for every row of ``docs``: a draw of ``percent`` of the
    documents of ``least_words`` words or more, without replacement, by importance towards ``target``.

    A null or empty text has no features and weight 0, and is never drawn where ``least_words`` is
    over 0.  A null key takes the hash of an empty one and comes last among ties.  Repeated rows are
    rows of their own with neighbouring ranks.  Words of any length and texts of any length count
    whole.  An empty target leaves every gain to the source alone; an empty table of documents gives
    an empty result.  Other columns are not read.
    """
    spark = docs.sparkSession
    vocabulary = Vocabulary(*frequent(docs.select(F.col(text).cast("binary")), longest, head), buckets)
    made = written(bucket_rows(docs, key, text, vocabulary, longest), "buckets")
    aim = target.select(F.lit(0).alias("k"), F.col(target_text).alias("t"))
    gain = np.array(gains(_totals(made), _totals(bucket_rows(aim, "k", "t", vocabulary, longest)), buckets), dtype=np.int64)
    kind = _bucket_type(buckets)
    rows = made.filter(F.col("bucket").isNull()).select("k", "n_words", "n_features", "buckets")

    def weigh(batches):
        for batch in batches:
            sums = [int(gain[np.frombuffer(b, dtype=kind)].sum()) for b in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(sums, type=pa.int64())], names=["k", "n_words", "n_features", "weight"]
            )

    kept = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields[:3])
    weighed = rows.mapInArrow(weigh, f"{kept}, weight bigint")
    scored = written(weighed.withColumn("score", F.col("weight") + noise(F.col("k"), seed)), "scored")
    able = scored.filter(F.col("n_words") >= least_words)
    order = [F.desc("score"), F.asc_nulls_last("k")]
    drawn = ranked(able, order, percent * able.count() // 100)
    rest = scored.filter(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("bigint"))
    return drawn.unionByName(rest).select(F.col("k").alias(key), "n_features", "weight", "score", "rank")


def op11_importance_resampling(spark: SparkSession, folder: str) -> DataFrame:
    return resample(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


OP11_SQL = rf"""
WITH texts AS (
  SELECT doc_id, true AS source, coalesce(text, '') AS text FROM documents
  UNION ALL SELECT NULL, false, coalesce(text, '') FROM benchmark),
numbered AS (
  SELECT row_number() OVER () AS r, doc_id, source,
         regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
  FROM texts),
counted AS (SELECT r, source, word, count(*) AS n FROM (SELECT r, source, unnest(words) AS word FROM numbered) GROUP BY ALL),
rule AS (
  SELECT list(c ORDER BY b) AS crc FROM (
    SELECT b, list_reduce(list_concat([b], range(8)), lambda c, i: xor(c >> 1, 3988292384 * (c & 1))) AS c
    FROM (SELECT unnest(range(256)) AS b))),
hashed AS (
  SELECT word, xor(list_reduce(
           list_concat([4294967295::BIGINT], list_transform(range(1, 1 + strlen(word)),
             lambda i: ('0x' || substr(hex(encode(word)), (2 * i - 1)::BIGINT, 2))::BIGINT)),
           lambda c, b: xor(c >> 8, crc[1 + (xor(c, b) & 255)])), 4294967295) % {BUCKETS} AS bucket
  FROM (SELECT DISTINCT word FROM counted), rule),
sides AS (
  SELECT bucket, coalesce(sum(n) FILTER (source), 0) AS s, coalesce(sum(n) FILTER (NOT source), 0) AS t
  FROM counted JOIN hashed USING (word) GROUP BY 1),
gain AS (
  SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * ((SELECT sum(s) FROM sides) + {BUCKETS})::DOUBLE
    / ((s + 1)::DOUBLE * ((SELECT sum(t) FROM sides) + {BUCKETS})::DOUBLE)))::BIGINT AS gain
  FROM sides),
weights AS (SELECT r, sum(n * gain)::BIGINT AS weight FROM counted JOIN hashed USING (word) JOIN gain USING (bucket) GROUP BY 1),
scored AS (
  SELECT doc_id, len(words)::BIGINT AS n_features, coalesce(weight, 0) AS weight,
         coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('{SEED}:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT
           + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
  FROM numbered LEFT JOIN weights USING (r) WHERE source),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY n_features >= {LEAST_WORDS} ORDER BY score DESC, doc_id NULLS LAST) AS place,
         count(*) OVER (PARTITION BY n_features >= {LEAST_WORDS}) AS able
  FROM scored)
SELECT doc_id, n_features, weight, score,
       CASE WHEN n_features >= {LEAST_WORDS} AND place <= {DRAWN_PERCENT} * able // 100 THEN place END AS rank
FROM placed
"""
