"""Language-model scoring with an n-gram trie in Elias-Fano form.

Training counts words and three-token windows.  Words are numbered by the order of their hashes,
in parts of bounded size; a part holds the hashes and the running sums of the counts as monotone
sequences.  Windows (a, b, c) are dealt to shards by a, or by (a, b) where a is frequent, so that
no frequent word's windows meet in one task.  A shard is a trie of three levels.  The children of a node
are kept relative to it: node i's child c is i * K + c in one monotone sequence for the level, so
a child is found by a successor search, and monotone pointers give the number of children.  With
absolute discounting,

    p(c|ab) = (n(abc) - D) / n(ab) + D * children(ab) / n(ab) * p(c|b)
    p(c|b)  = (n(bc) - D) / n(b) + D * children(b) / n(b) * p(c),  p(c) = (n(c) + 1) / (N + V + 1)

the first terms and the weights of words are kept as quantised logarithms.  Files are mapped into memory by
the scoring tasks; the driver holds counts of parts and shards, never words or windows.

Tasks count in compressed sorted runs, which a shard's task merges.  All files lie in the folder
of ``spark.checkpoint.dir``, which must be mounted under the same path everywhere.
"""

from __future__ import annotations

import math
import os
from collections import Counter
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stmtlens.llm import elias_fano as ef
from stmtlens.llm.common import parts, shared_path, ship, table, written

FOLDS, HELD_OUT = 7, 2
DISCOUNT = 0.75
#: About so many words in a part of the vocabulary, and training tokens in a shard of the trie.
PART_WORDS = 1 << 17
SHARD_TOKENS = 1 << 20
#: Words whose count is above this share of a shard are dealt by two words.
HOT_SHARE = 8
#: Tokens that a task holds at once.
HELD_TOKENS = 1 << 20
#: Steps of a quantised logarithm to base ten.
STEPS = 2048
#: Counts are kept as shares of this one, which makes their logarithms negative, too.
MOST = 1e13
#: The end of a text.  No word: it holds a separator.
END = b"\n"


def tokens(text: str) -> list[bytes]:
    """Words in lower case (A-Z), then the end."""
    return [*text.encode("utf-8", "surrogatepass").lower().split(), END]


def quantise(log10: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(-log10 * STEPS), 0, 65535).astype(np.uint16)


_RESTORED = 10.0 ** (np.arange(65536) / -STEPS)


def restore(code: np.ndarray) -> np.ndarray:
    return _RESTORED[code]


def word_hashes(words: list[bytes]) -> np.ndarray:
    """63-bit hashes of words."""
    from xxhash import xxh64_intdigest

    return (np.fromiter(map(xxh64_intdigest, words, repeat(42)), dtype=np.uint64, count=len(words)) >> np.uint64(1)).astype(np.int64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _mounted(path: str) -> str:
    scheme, _, rest = path.partition(":")
    if not rest or "/" in scheme:
        return path
    if scheme != "file":
        raise ValueError(f"spark.checkpoint.dir must be a folder mounted on all workers, not {path}")
    return "/" + rest.lstrip("/")


class Plan:
    """What tasks must know of a model: sizes and places, a few numbers for a part or shard."""

    def __init__(self, folder: str, bits: int, shard_tokens: int = SHARD_TOKENS):
        self.folder, self.bits, self.shard_tokens = folder, bits, shard_tokens
        self.offsets = np.zeros((1 << bits) + 1, dtype=np.int64)
        self.total = self.words = self.texts = self.shards = 0
        self.hot_words = np.zeros(0, dtype=np.int64)
        self.hot_weights = np.zeros(0)

    @property
    def hot(self) -> int:
        return self.shard_tokens // HOT_SHARE

    @property
    def unknown(self) -> int:
        return self.words

    @property
    def begin(self) -> int:
        return self.words + 1

    @property
    def after(self) -> int:
        return self.words + 2

    @property
    def kinds(self) -> int:
        return self.words + 3

    def shard(self, a: np.ndarray, b: np.ndarray, count: np.ndarray) -> np.ndarray:
        """The shard of windows that begin with a, b; those of frequent words come after the others."""
        frequent = count > self.hot
        mixed = _mix(_mix(a + 1) + np.where(frequent, b + 1, 0).astype(np.uint64))
        return (mixed % np.uint64(self.shards)).astype(np.int64) + frequent * self.shards


class Vocabulary:
    """Numbers and counts of words, from the mapped parts."""

    def __init__(self, plan: Plan):
        self.plan, self.parts = plan, {}

    def _part(self, number: int):
        if number not in self.parts:
            arrays = ef.load(f"{self.plan.folder}/words-{number}")
            self.parts[number] = (ef.Sequence(ef.part("hash", arrays)), ef.Sequence(ef.part("sums", arrays)))
        return self.parts[number]

    def look_up(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(number, count) of each word.

        Each different hash is sought once; in their order they go from part to part and through each
        part from its beginning to its end.
        """
        bits = self.plan.bits
        hashes, which = np.unique(word_hashes(words), return_inverse=True)
        ids = np.full(len(hashes), self.plan.unknown, dtype=np.int64)
        counts = np.zeros(len(hashes), dtype=np.int64)
        edges = np.searchsorted(hashes >> (63 - bits), np.arange((1 << bits) + 1))
        for number in range(1 << bits):
            low, high = edges[number], edges[number + 1]
            if low == high or self.plan.offsets[number] == self.plan.offsets[number + 1]:
                continue
            known, sums = self._part(number)
            at = known.find(hashes[low:high] & ((1 << (63 - bits)) - 1))
            own, at = low + np.flatnonzero(at >= 0), at[at >= 0]
            ids[own] = self.plan.offsets[number] + at
            counts[own] = sums.gaps(at)
        return ids[which], counts[which]


def _windows(plan: Plan, lengths: np.ndarray, ids: np.ndarray, counts: np.ndarray):
    """(a, b, c, count of a, count of b) for every token c of texts laid end to end."""
    ends = np.cumsum(lengths)
    starts = ends - lengths
    first = np.zeros(len(ids), dtype=bool)
    first[starts] = True
    second = np.concatenate([[False], first[:-1]])
    b, b_count = np.concatenate([[0], ids[:-1]]), np.concatenate([[0], counts[:-1]])
    a, a_count = np.concatenate([[0], b[:-1]]), np.concatenate([[0], b_count[:-1]])
    b, b_count = np.where(first, plan.begin, b), np.where(first, plan.texts, b_count)
    a = np.where(first | second, plan.begin, a)
    a_count = np.where(first | second, plan.texts, a_count)
    return a, b, ids, a_count, b_count


def _held(batches, least: int = HELD_TOKENS):
    """Token lists of several rows at a time: (keys, token lists), about ``least`` tokens together."""
    keys, texts, held = [], [], 0
    for batch in parts(batches):
        for key, value in zip(batch.column(0), batch.column(1).to_pylist()):
            made = tokens(value)
            keys.append(key)
            texts.append(made)
            held += len(made)
            if held >= least:
                yield keys, texts
                keys, texts, held = [], [], 0
    if texts:
        yield keys, texts


def _count_words(batches):
    for _, texts in _held(batches):
        found = Counter()
        for words in texts:
            found.update(words)
        hashes = pa.array(word_hashes(list(found)))
        yield pa.RecordBatch.from_arrays([hashes, pa.array(found.values(), type=pa.int64())], names=["h", "n"])


def _write_words(folder: str, bits: int):
    def run(rows: pa.Table) -> pa.Table:
        hashes = rows["h"].to_numpy()
        order = np.argsort(hashes)
        counts = rows["n"].to_numpy()[order]
        part = int(hashes[0] >> (63 - bits))
        sums = np.concatenate([[0], np.cumsum(counts)])
        ef.save(
            f"{folder}/words-{part}",
            ef.nested("hash", ef.encode(hashes[order] & ((1 << (63 - bits)) - 1), 1 << (63 - bits)))
            | ef.nested("sums", ef.encode(sums, int(sums[-1]) + 1)),
        )
        return pa.table({"part": [part], "words": [len(counts)], "total": [int(sums[-1])]})

    return run


def _planes(values: np.ndarray) -> bytes:
    """Bytes of equal weight together: those of small numbers are nearly all alike."""
    import zstandard

    planes = np.ascontiguousarray(values.astype("<i8").view(np.uint8).reshape(-1, 8).T)
    return zstandard.compress(planes.tobytes(), 1)


def _unplanes(blob: bytes) -> np.ndarray:
    import zstandard

    planes = np.frombuffer(zstandard.decompress(blob), dtype=np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view("<i8").ravel()


def _folded(a, b, c, n):
    """Sorted windows, each once, with the sum of its counts."""
    order = np.lexsort((c, a * (int(b.max()) + 1) + b))
    a, b, c, n = a[order], b[order], c[order], n[order]
    new = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (c[1:] != c[:-1])])
    return a[new], b[new], c[new], np.add.reduceat(n, np.flatnonzero(new))


def _count_windows(plan: Plan):
    def run(batches):
        vocabulary = Vocabulary(plan)
        for _, texts in _held(batches):
            lengths = np.array([len(t) for t in texts], dtype=np.int64)
            ids, counts = vocabulary.look_up([w for t in texts for w in t])
            a, b, c, a_count, b_count = _windows(plan, lengths, ids, counts)
            # What follows the end is one more child, so that n(ab) is the sum over children.
            last = np.cumsum(lengths) - 1
            a, b, c = (np.concatenate([x, y]) for x, y in ((a, b[last]), (b, c[last]), (c, np.full(len(last), plan.after))))
            a_count = np.concatenate([a_count, b_count[last]])
            shard = plan.shard(a, b, a_count)
            order = np.argsort(shard, kind="stable")
            for own in np.split(order, np.flatnonzero(np.diff(shard[order])) + 1):
                runs = _folded(a[own], b[own], c[own], np.ones(len(own), dtype=np.int64))
                runs = (np.diff(runs[0], prepend=0), *runs[1:])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([int(shard[own[0]])], type=pa.int64()), *(pa.array([_planes(x)], type=pa.binary()) for x in runs)],
                    names=["shard", "a", "b", "c", "n"],
                )

    return run


def _write_shard(plan: Plan):
    """Merge the runs of one shard into its trie; returns children of the words that others share."""

    def run(rows: pa.Table) -> pa.Table:
        shard = rows["shard"][0].as_py()
        runs = [[_unplanes(x) for x in rows[name].to_pylist()] for name in "abcn"]
        a, b, c, n = _folded(np.concatenate([np.cumsum(x) for x in runs[0]]), *(np.concatenate(x) for x in runs[1:]))
        kinds = plan.kinds
        new2 = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
        at2, parent2 = np.flatnonzero(new2), np.cumsum(new2) - 1
        n2 = np.add.reduceat(n, at2)
        a2, b2 = a[at2], b[at2]
        new1 = np.concatenate([[True], a2[1:] != a2[:-1]])
        at1, parent1 = np.flatnonzero(new1), np.cumsum(new1) - 1
        real = (b2 != plan.begin).astype(np.int64)  # begin and begin are no two tokens of a text
        n1 = np.maximum(1, np.add.reduceat(n2 * real, at1))
        children = np.add.reduceat(real, at1)
        ef.save(
            f"{plan.folder}/shard-{shard}",
            ef.nested("level1", ef.encode(a2[at1], kinds))
            | {"weight1": quantise(np.log10(np.maximum(DISCOUNT * children / n1, 1e-30)))}
            | ef.nested("level2", ef.encode(parent1 * kinds + b2, len(at1) * kinds))
            | {"part2": quantise(np.log10((n2 - DISCOUNT) / MOST))}
            | ef.nested("pointers", ef.encode(np.append(at2, len(a)), len(a) + 1))
            | ef.nested("level3", ef.encode(parent2 * kinds + c, len(at2) * kinds))
            | {"part3": quantise(np.log10((n - DISCOUNT) / n2[parent2]))},
        )
        # Only a frequent word's children lie in several shards.
        some = slice(0, len(at1) if shard >= plan.shards else 0)
        return pa.table({"a": a2[at1][some], "children": children[some]})

    return run


class Trie:
    """The mapped shards, queried for many windows at a time."""

    def __init__(self, plan: Plan):
        self.plan, self.shards = plan, {}

    def _shard(self, number: int) -> dict | None:
        if number not in self.shards:
            path = f"{self.plan.folder}/shard-{number}"
            found = None
            if os.path.exists(path):
                arrays = ef.load(path)
                found = {x: arrays[x] for x in ("weight1", "part2", "part3")}
                found |= {x: ef.Sequence(ef.part(x, arrays)) for x in ("level1", "level2", "pointers", "level3")}
            self.shards[number] = found
        return self.shards[number]

    def _by_shard(self, a: np.ndarray, b: np.ndarray, count: np.ndarray):
        if not len(a) or not self.plan.shards:
            return
        shard = self.plan.shard(a, b, count)
        order = np.argsort(shard, kind="stable")
        for own in np.split(order, np.flatnonzero(np.diff(shard[order])) + 1):
            number = int(shard[own[0]])
            if self._shard(number):
                yield own, number

    def _nodes(self, found: dict, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nodes of a and of (a, b), -1 where there is none; equal neighbours in ``a`` are sought once."""
        new = np.concatenate([[True], a[1:] != a[:-1]])
        first = found["level1"].find(a[new])[np.cumsum(new) - 1]
        second = np.full(len(a), -1, dtype=np.int64)
        known = np.flatnonzero(first >= 0)
        second[known] = found["level2"].find(first[known] * self.plan.kinds + b[known])
        return first, second

    def probability(self, a, b, c, a_count, b_count, c_count, first) -> np.ndarray:
        """p(c | a b) of every window; ``first`` marks those that begin a text.

        The windows lie in the order of the texts, so the node of (a, b) is that of (b, c) one
        window earlier, but for the first.
        """
        plan = self.plan
        p = (c_count + 1) / (plan.total + plan.words + 1)
        weight = np.ones(len(c))
        if len(plan.hot_words):
            at = np.minimum(np.searchsorted(plan.hot_words, b), len(plan.hot_words) - 1)
            weight = np.where(plan.hot_words[at] == b, plan.hot_weights[at], weight)
        # Each different pair (b, c) is sought once, and in their order, which is that of the sequences.
        seen = np.flatnonzero((b_count > 0) & (c_count > 0))
        pair = b[seen] * plan.kinds + c[seen]
        order = np.argsort(pair)
        new = np.ones(len(order), dtype=bool)
        new[1:] = np.diff(pair[order]) > 0
        which = np.empty(len(order), dtype=np.int64)
        which[order] = np.cumsum(new) - 1
        once = seen[order[new]]
        shard, node = np.full(len(once), -1, dtype=np.int64), np.full(len(once), -1, dtype=np.int64)
        second, back = np.zeros(len(once)), weight[once]
        for own, number in self._by_shard(b[once], c[once], b_count[once]):
            found, count = self.shards[number], b_count[once[own]]
            node1, node2 = self._nodes(found, b[once[own]], c[once[own]])
            cold = (node1 >= 0) & (count <= plan.hot)
            back[own[cold]] = restore(found["weight1"][node1[cold]])
            known = node2 >= 0
            shard[own], node[own] = number, node2
            second[own[known]] = restore(found["part2"][node2[known]]) * MOST / count[known]
        part, shards, nodes = np.zeros(len(c)), np.full(len(c), -1, dtype=np.int64), np.full(len(c), -1, dtype=np.int64)
        part[seen], weight[seen], shards[seen], nodes[seen] = second[which], back[which], shard[which], node[which]
        # A word that no training text has still needs the weight of the word before it.
        rest = np.flatnonzero((b_count > 0) & (c_count == 0) & (b_count <= plan.hot))
        for own, number in self._by_shard(b[rest], c[rest], b_count[rest]):
            own, found = rest[own], self.shards[number]
            node1 = found["level1"].find(b[own])
            weight[own[node1 >= 0]] = restore(found["weight1"][node1[node1 >= 0]])
        p = part + weight * p
        shards, nodes = np.concatenate([[-1], shards[:-1]]), np.concatenate([[-1], nodes[:-1]])
        nodes[first] = -1
        starts = np.flatnonzero(first & (a_count > 0))
        for own, number in self._by_shard(a[starts], b[starts], a_count[starts]):
            own = starts[own]
            shards[own], nodes[own] = number, self._nodes(self.shards[number], a[own], b[own])[1]
        part, weight = np.zeros(len(c)), np.ones(len(c))
        seen = np.flatnonzero(nodes >= 0)
        order = seen[np.argsort((shards[seen] << 40) + nodes[seen])]
        for own in np.split(order, np.flatnonzero(np.diff(shards[order])) + 1) if len(order) else []:
            found, node = self.shards[int(shards[own[0]])], nodes[own]
            children = found["pointers"].gaps(node)
            weight[own] = DISCOUNT * children / (restore(found["part2"][node]) * MOST + DISCOUNT)
            third = found["level3"].find(node * plan.kinds + c[own])
            known = third >= 0
            part[own[known]] = restore(found["part3"][third[known]])
        return part + weight * p


def _score(plan: Plan):
    def run(batches):
        vocabulary, trie = Vocabulary(plan), Trie(plan)
        for keys, texts in _held(batches):
            lengths = np.array([len(t) for t in texts], dtype=np.int64)
            ids, counts = vocabulary.look_up([w for t in texts for w in t])
            a, b, c, a_count, b_count = _windows(plan, lengths, ids, counts)
            starts = np.cumsum(lengths) - lengths
            base = np.log10((counts + 1) / (plan.total + plan.words + 1))
            first = np.zeros(len(c), dtype=bool)
            first[starts] = True
            p = trie.probability(a, b, c, a_count, b_count, counts, first)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(keys), pa.array(lengths),
                    pa.array(np.add.reduceat((counts > 0).astype(np.int64), starts)),
                    pa.array(np.add.reduceat(base, starts)), pa.array(np.add.reduceat(np.log10(p), starts)),
                ],
                names=["_id", "n_tokens", "n_known", "base_score", "score"],
            )

    return run


def _texts(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.select(F.col(key).cast("string").alias("_id"), F.coalesce(F.col(text), F.lit("")).alias("_text"))


def train(docs: DataFrame, key: str = "doc_id", text: str = "text", shard_tokens: int = SHARD_TOKENS) -> Plan:
    """Count the texts of ``docs`` and write the trie; the plan tells tasks where it lies."""
    spark = docs.sparkSession
    ship(spark)
    folder = _mounted(shared_path(spark, "model"))
    os.makedirs(folder)
    rows = _texts(docs, key, text)
    words = written(
        rows.mapInArrow(_count_words, "h bigint, n bigint").groupBy("h").agg(F.sum("n").alias("n")), "words"
    )
    bits = max(0, math.ceil(math.log2(max(1, words.count()) / PART_WORDS)))
    plan = Plan(folder, bits, shard_tokens)
    parts = (
        words.withColumn("part", F.shiftright("h", 63 - bits))
        .groupBy("part")
        .applyInArrow(_write_words(folder, bits), "part bigint, words bigint, total bigint")
        .collect()
    )
    for row in parts:
        plan.offsets[row["part"] + 1] = row["words"]
        plan.total += row["total"]
    plan.offsets = np.cumsum(plan.offsets)
    plan.words = int(plan.offsets[-1])
    plan.texts = docs.count()
    plan.shards = -(-plan.total // shard_tokens)
    if not plan.total:
        return plan
    runs = rows.mapInArrow(_count_windows(plan), "shard bigint, a binary, b binary, c binary, n binary")
    shared = runs.groupBy("shard").applyInArrow(_write_shard(plan), "a bigint, children bigint")
    # The words that lie in several shards are at most HOT_SHARE for each of them.
    hot = written(shared, "hot").groupBy("a").agg(F.sum("children").alias("children")).collect()
    if hot:
        hot = sorted((r["a"], r["children"]) for r in hot)
        plan.hot_words = np.array([a for a, _ in hot], dtype=np.int64)
        plan.hot_weights = DISCOUNT * np.array([n for _, n in hot], dtype=float) / _hot_counts(plan)
    return plan


def _hot_counts(plan: Plan) -> np.ndarray:
    """The counts of the frequent words, read from the parts of the vocabulary by number."""
    out = np.zeros(len(plan.hot_words))
    for i, word in enumerate(plan.hot_words.tolist()):
        if word == plan.begin:
            out[i] = plan.texts
            continue
        part = int(np.searchsorted(plan.offsets, word, side="right")) - 1
        sums = ef.Sequence(ef.part("sums", ef.load(f"{plan.folder}/words-{part}")))
        at = word - plan.offsets[part]
        low, high = sums[np.array([at, at + 1])]
        out[i] = high - low
    return out


def score(docs: DataFrame, plan: Plan, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_tokens, n_known, base_score, score) of every whole text; a null text is empty.

    An empty text is the end alone.  Repeated rows and null keys give a row each; other columns
    are not read; an empty table gives an empty result.
    """
    ship(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()
    made = _texts(docs, key, text).mapInArrow(
        _score(plan), "_id string, n_tokens bigint, n_known bigint, base_score double, score double"
    )
    return made.select(F.col("_id").cast(kind).alias(key), "n_tokens", "n_known", "base_score", "score")


def held_out(key: str = "doc_id"):
    """Whether a document is kept from training; a null key is hashed as an empty text."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit(""))) % FOLDS == HELD_OUT


def score_held_out(
    docs: DataFrame, key: str = "doc_id", text: str = "text", shard_tokens: int = SHARD_TOKENS
) -> DataFrame:
    """Train on the documents that are not held out and score all of them.

    Without training tokens every token has the probability 1.  Cases as in :func:`score`.
    """
    docs = docs.select(key, text)
    plan = train(docs.filter(~held_out(key)), key, text, shard_tokens)
    return score(docs, plan, key, text).select(
        key, held_out(key).alias("held_out"), "n_tokens", "n_known",
        F.lit(plan.total).cast("bigint").alias("train_tokens"), "base_score", "score",
    )


def op7_language_model(spark: SparkSession, folder: str) -> DataFrame:
    return score_held_out(table(spark, folder, "documents"))
