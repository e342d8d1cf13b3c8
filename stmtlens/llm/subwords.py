"""Quality classifier on supervised subword embeddings, trained by stochastic gradient descent in numpy.

A text is a bag of hashed features: its words, the character n-grams inside them (with marks at a word's
ends), the pairs of neighbouring words, and a mark for each line.  A pair of equal words is one feature
whatever the word is, so that repetition can be learned from words never seen.  Every bucket has a
learned vector; the mean of a text's vectors goes through a linear layer and a softmax over the classes.

The model is trained in one task on a sample of labelled rows, at most ``TRAIN_ROWS``, the first in the
order of a hash of their keys.  Their features are counted in parallel before; the task holds buckets and
counts, never texts.  All texts are then scored where they lie: as mean and layer are linear, a feature
adds one fixed-point number to the odds, so a text's score is a sum of integers in any order.

Features are found for many texts at a time: with S[i] the sum of x[j] B^j before i, the hash of any
stretch i..k of the code points x is (S[k] - S[i]) B^-i, all modulo 2^64.
"""

from __future__ import annotations

import re
from binascii import crc32
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stmtlens.llm.common import parts, ship, table, written

#: Labelled rows that the model is trained on, at most.
TRAIN_ROWS = 8192
BUCKETS = 1 << 16
DIMENSIONS = 16
#: Lengths of the character n-grams.
GRAMS = (3, 4, 5)
EPOCHS = 5
RATE = 0.5
SEED = 13
FOLDS = 3
HELD_OUT = 1
#: Code points whose features are found at a time; longer texts go by pieces.
_BLOCK = 1 << 18
_SPACE = re.compile(r"[\x20\x09-\x0D]")
_BASE = 0x9E3779B97F4A7C15
#: Fixed point of a feature's part of the odds.
_UNIT = 1 << 32


def _mixed(values: np.ndarray, salt: int) -> np.ndarray:
    """Buckets of 64-bit hashes; ``salt`` tells kinds of features apart."""
    values = (values + np.uint64(salt * 0x632BE59BD9B4E019 % 2**64)) * np.uint64(0xD6E8FEB86659FD93)
    values ^= values >> np.uint64(32)
    values *= np.uint64(0xD6E8FEB86659FD93)
    return (values >> np.uint64(40)).astype(np.int64) % BUCKETS


_LINE, _SAME = _mixed(np.array([1, 2], dtype=np.uint64), 1).tolist()
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> list[np.ndarray]:
    """B^i and B^-i modulo 2^64 for i below ``n`` or more."""
    if not _POWERS or len(_POWERS[0]) < n:
        both = np.ones((2, n + 1), dtype=np.uint64)
        both[:, 1:] = np.array([[_BASE], [pow(_BASE, -1, 2**64)]], dtype=np.uint64)
        _POWERS[:] = list(np.cumprod(both, axis=1, dtype=np.uint64))
    return _POWERS


def _pieces(texts: list[str]) -> Iterator[list[tuple[int, str]]]:
    """Blocks of (number of the text, piece); texts are cut only before white space."""
    block, held = [], 0
    for owner, text in enumerate(texts):
        at = 0
        while at < len(text) or not at:
            cut = _SPACE.search(text, at + _BLOCK) if len(text) - at > _BLOCK else None
            end = cut.start() if cut else len(text)
            block.append((owner, text[at:end]))
            held += end - at + 1
            if held >= _BLOCK:
                yield block
                block, held = [], 0
            at = max(end, 1)
    if block:
        yield block


def features(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks of (numbers of the texts, ascending; buckets): every feature of every text once for each time.

    Words are runs without white space.  A word's n-grams are those of the word with a space at both ends.
    """
    carried = None  # the text that the last block ended in, and the hash of its last word
    for block in _pieces(texts):
        codes = np.frombuffer((" " + "".join(piece + " " for _, piece in block)).encode("utf-32-le", "surrogatepass"), dtype="<u4")
        space = (codes == 32) | (codes >= 9) & (codes <= 13)
        owners = np.array([o for o, _ in block])
        begins = np.cumsum([1, *(len(piece) + 1 for _, piece in block)])
        owner = np.repeat(owners, np.diff(begins))  # of codes[1:]
        power, back = _powers(len(codes) + 1)
        sums = np.zeros(len(codes) + 1, dtype=np.uint64)
        np.cumsum(np.where(space, 32, codes).astype(np.uint64) * power[: len(codes)], dtype=np.uint64, out=sums[1:])
        found = []
        spaces = np.concatenate([[0], np.cumsum(space)])
        for n in GRAMS:
            at = np.flatnonzero(spaces[n - 1 : len(codes)] == spaces[1 : len(codes) - n + 2]) if len(codes) >= n else np.zeros(0, int)
            found.append((owner[at], _mixed((sums[at + n] - sums[at]) * back[at], n)))
        edges = np.flatnonzero(space[1:] != space[:-1]) + 1
        first, last = edges[::2], edges[1::2]
        words, own = (sums[last] - sums[first]) * back[first], owner[first - 1]
        found.append((own, _mixed(words, 0)))
        if carried and len(words) and carried[0] == own[0]:
            words, own = np.concatenate([[carried[1]], words]), np.concatenate([own[:1], own])
        if len(words):
            carried = own[-1], words[-1]
        near = own[1:] == own[:-1]
        pairs = _mixed(words[:-1] * np.uint64(3) + words[1:], 2)
        found.append((own[1:][near], np.where(words[1:] == words[:-1], _SAME, pairs)[near]))
        lines = owner[np.flatnonzero(codes[1:] == 10)]
        found.append((lines, np.full(len(lines), _LINE)))
        yield from found
    yield np.arange(len(texts)), np.full(len(texts), _LINE)


def bags(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """The buckets of each text's features, ascending, and how often each occurs."""
    out = []
    for text in texts:
        counts = np.zeros(BUCKETS, dtype=np.int64)
        for _, found in features([text]):
            counts += np.bincount(found, minlength=BUCKETS)
        hit = np.flatnonzero(counts)
        out.append((hit.astype("<u4"), counts[hit].astype("<u4")))
    return out


class Model:
    """Vectors of the buckets and the output layer (a row for each class)."""

    def __init__(self, vectors: np.ndarray, layer: np.ndarray):
        self.vectors, self.layer = vectors, layer

    def margins(self) -> np.ndarray:
        """What each bucket adds to the odds of the second class against the first, in fixed point."""
        return np.rint(self.vectors.astype(np.float64) @ (self.layer[1] - self.layer[0]).astype(np.float64) * _UNIT).astype(np.int64)


def train(rows: list[tuple[int, np.ndarray, np.ndarray]], epochs: int = EPOCHS, rate: float = RATE, seed: int = SEED) -> Model:
    """The model after ``epochs`` over the rows (class, buckets, counts), one step a row."""
    pick = np.random.default_rng(seed)
    vectors = pick.uniform(-1 / DIMENSIONS, 1 / DIMENSIONS, (BUCKETS, DIMENSIONS)).astype(np.float32)
    layer = np.zeros((2, DIMENSIONS), dtype=np.float32)
    shares = [(c, f, (n / n.sum()).astype(np.float32)) for c, f, n in rows]
    done, steps = 0, max(1, epochs * len(shares))
    for _ in range(epochs):
        for i in pick.permutation(len(shares)):
            label, found, share = shares[i]
            mean = share @ vectors[found]
            out = layer @ mean
            out = np.exp(out - out.max())
            slope = out / out.sum()
            slope[label] -= 1
            slope *= rate * (1 - done / steps)
            back = slope @ layer
            layer -= np.outer(slope, mean)
            vectors[found] -= np.outer(share, back)
            done += 1
    return Model(vectors, layer)


def labelled(labels: DataFrame, label: str, key: str, most: int = TRAIN_ROWS) -> DataFrame:
    """(key, label) of the sample: ``most`` keys at most, of those with one label, 0 or 1, outside the
    held-out fold, the first in the order of their hash."""
    rows = labels.select(F.col(key).alias("k"), F.col(label).cast("int").alias("label"))
    rows = rows.filter(F.col("k").isNotNull() & F.col("label").isin(0, 1) & ~held_out(F.col("k")))
    single = rows.groupBy("k").agg(F.min("label").alias("label"), F.max("label").alias("top")).filter("label = top")
    return single.orderBy(F.xxhash64("k"), "k").limit(most).select("k", "label")


def held_out(key: Column, folds: int = FOLDS, fold: int = HELD_OUT) -> Column:
    """Whether a row is of the fold that is never learned from; a null key counts as an empty one."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit(""))) % folds == fold


def fit(
    docs: DataFrame, labels: DataFrame, label: str = "quality", key: str = "doc_id", text: str = "text", most: int = TRAIN_ROWS
) -> Model:
    """The model of ``label`` from the labelled sample; without any row it knows nothing (all scores 0.5).

    Keys that are null, whose labels differ or aren't 0 or 1, or that no document has are not used; of
    documents with one key the least text is.  Long texts count whole.
    """
    ship(docs.sparkSession)
    # ``most`` rows of two numbers, whatever the size of the tables.
    chosen = F.broadcast(labelled(labels, label, key, most))
    texts = docs.select(F.col(key).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    sample = texts.join(chosen, "k").groupBy("k", "label").agg(F.min("t").alias("t"))

    def count(batches):
        for batch in parts(batches):
            made = bags(batch.column(2).to_pylist())
            packed = [pa.array([x[i].tobytes() for x in made], type=pa.binary()) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *packed], names=["k", "label", "found", "counts"])

    key_type = docs.schema[key].dataType.simpleString()
    counted = written(sample.mapInArrow(count, f"k {key_type}, label int, found binary, counts binary"), "bags")

    def learn(batches):
        rows = [r for batch in batches for r in zip(*(batch.column(i).to_pylist() for i in range(4)))]
        rows.sort(key=lambda r: (crc32(str(r[0]).encode()), str(r[0])))  # an order that no partitioning changes
        made = train([(c, np.frombuffer(f, dtype="<u4"), np.frombuffer(n, dtype="<u4")) for _, c, f, n in rows])
        yield pa.RecordBatch.from_pydict({"vectors": [made.vectors.tobytes()], "layer": [made.layer.tobytes()]})

    # One task: the sample is bounded, and so is the model that comes back.
    model = counted.coalesce(1).mapInArrow(learn, "vectors binary, layer binary").collect()
    if not model:
        return train([])
    shapes = zip((model[0].vectors, model[0].layer), ((BUCKETS, DIMENSIONS), (2, DIMENSIONS)))
    return Model(*(np.frombuffer(x, dtype=np.float32).reshape(s) for x, s in shapes))


def scores(texts: list[str], margins: np.ndarray) -> np.ndarray:
    """Probabilities of the second class."""
    totals, counts = np.zeros(len(texts), dtype=np.int64), np.zeros(len(texts), dtype=np.int64)
    for owner, found in features(texts):
        ends = np.searchsorted(owner, np.arange(len(texts) + 1))
        totals += np.diff(np.concatenate([[0], np.cumsum(margins[found])])[ends])
        counts += np.diff(ends)
    odds = totals / _UNIT / counts
    return np.exp(-np.logaddexp(0, -odds))


def predict(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, held_out, score, predicted) for every row of ``docs``.

    A null text is an empty one, which has a single line mark; a null key is in no held-out fold.  Rows
    stand alone, so repeated rows get equal scores; 0.5 is predicted as 1; texts of any length count
    whole; other columns are not read; an empty table gives an empty result.
    """
    held = docs.sparkSession.sparkContext.broadcast(model.margins())
    rows = docs.select(F.col(key).alias("k"), held_out(F.col(key)).alias("h"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    names = [key, "held_out", "score", "predicted"]
    key_type = docs.schema[key].dataType.simpleString()
    ship(docs.sparkSession)

    def run(batches):
        for batch in parts(batches):
            made = scores(batch.column(2).to_pylist(), held.value)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(made), pa.array((made >= 0.5).astype(np.int32))], names=names
            )

    return rows.mapInArrow(run, f"`{key}` {key_type}, held_out boolean, score double, predicted int")


def op13_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return predict(docs, fit(docs, table(spark, folder, "labels")))
