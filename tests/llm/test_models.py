"""Resampling, vector codes and the quality classifier against plain versions."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest_llm import rows_of
from stmtlens.llm import resampling, subwords, vector_codes


def plain_runs(text, longest):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", text)
    return words, [" ".join(words[i : i + n]).encode() for n in range(1, longest + 1) for i in range(len(words) - n + 1)]


def plain_resample(docs, target, longest, buckets, seed, least, percent):
    totals = []
    for texts in ([t for _, t in docs], target):
        totals.append(Counter(zlib.crc32(f) % buckets for t in texts for f in plain_runs(t, longest)[1]))
    every_s, every_t = (sum(c.values()) for c in totals)
    s, t = totals
    gain = [
        math.floor(1000 * math.log((t[b] + 1) * (every_s + buckets) / ((s[b] + 1) * (every_t + buckets))))
        for b in range(buckets)
    ]
    rows = []
    for key, text in docs:
        words, runs = plain_runs(text, longest)
        weight = sum(gain[zlib.crc32(f) % buckets] for f in runs)
        h = int(hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
        rows.append([key, len(runs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None, len(words)])
    able = sorted((r for r in rows if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for i, r in enumerate(able[: percent * len(able) // 100]):
        r[4] = i + 1
    return sorted((tuple(r[:5]) for r in rows), key=repr)


@pytest.mark.parametrize("longest,head,buckets", [(1, 1 << 15, 10_000), (2, 7, 97), (3, 50, 70_000), (2, 0, 97)])
def test_resampling_is_the_plain_one(spark, documents, odd, longest, head, buckets):
    docs = documents.select("doc_id", "text").union(odd.select("doc_id", "text"))
    docs = docs.union(spark.createDataFrame([(9001, "ÀÉ straße Été 12ab! " * 9)], "doc_id bigint, text string"))
    target = [r.text for r in documents.filter("doc_id % 7 = 0").collect()] + [None, "", "one two"]
    aim = spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id bigint, text string")
    got = resampling.resample(docs, aim, longest=longest, buckets=buckets, head=head)
    want = plain_resample(rows_of(docs), target, longest, buckets, 2024, 20, 10)
    assert sorted(rows_of(got), key=repr) == want


def test_resampling_long_texts_and_ties(spark, monkeypatch):
    rng = random.Random(2)
    long = " ".join(rng.choice("abcdefgh") * rng.randint(1, 3) for _ in range(200_000))
    # Repeated rows of one key: their ranks follow each other and none is left out.
    docs = spark.createDataFrame([(1, long)] + [(5, "a b c " * 10)] * 300, "doc_id bigint, text string").repartition(5)
    aim = spark.createDataFrame([("a b",)], "text string")
    got = resampling.resample(docs, aim, longest=2, percent=50)
    assert sorted(rows_of(got), key=repr) == plain_resample(rows_of(docs), ["a b"], 2, 10_000, 2024, 20, 50)
    assert sorted(r.rank for r in got.collect() if r.rank) == list(range(1, 151))


def test_frequent_words_are_found_in_bounded_counters(spark, monkeypatch):
    counts = Counter({f"w{i}".encode(): 1 + 3 * (i < 40) for i in range(500)})
    kept = resampling._trimmed(counts, 50)
    assert len(kept) <= 50 and {f"w{i}".encode() for i in range(40)} <= set(kept)
    texts = spark.createDataFrame([("the cat " * 50 + "the dog",), ("x y z",), (None,)], "text string")
    words, pairs = resampling.frequent(texts.select(F.col("text").cast("binary")), longest=2, head=2)
    assert words == [b"the", b"cat"] and set(pairs) == {(b"the", b"cat"), (b"cat", b"the")}


def test_resampling_of_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id bigint, text string, rank string")
    some = spark.createDataFrame([(1, "a " * 30, "r")], "doc_id bigint, text string, rank string")
    assert rows_of(resampling.resample(none, some)) == []
    assert rows_of(resampling.resample(some, none, percent=100))[0][4] == 1
    assert resampling.resample(some, some).columns == ["doc_id", "n_features", "weight", "score", "rank"]


def plain_codes(rows, parts, entries, rounds, scale=4096):
    """By comparing every part with every entry."""
    kept = [(k, label, [math.floor(scale * x) for x in v]) for k, label, v in rows]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, np.array(r[2], dtype="<i2").tobytes()))
    width = len(kept[0][2]) // parts
    cells = np.array([r[2] for r in kept], dtype=np.int64).reshape(len(kept), parts, width)
    books = [cells[:entries, p].copy() for p in range(parts)]

    def nearest(p):
        far = ((cells[:, p, None, :] - books[p][None]) ** 2).sum(axis=2)
        return far.argmin(axis=1), far.min(axis=1)

    for _ in range(rounds):
        for p in range(parts):
            code = nearest(p)[0]
            for e in range(len(books[p])):
                if (code == e).any():
                    books[p][e] = np.floor_divide(cells[code == e, p].sum(axis=0), (code == e).sum())
    found = [nearest(p) for p in range(parts)]
    codes, errors = np.stack([f[0] for f in found], axis=1), sum(f[1] for f in found)
    return sorted(((r[0], r[1], c.astype(np.uint8).tobytes().hex(), int(e)) for r, c, e in zip(kept, codes, errors)), key=repr), books


def vector_rows(spark, rows):
    return spark.createDataFrame(rows, "vec_id bigint, label int, embedding array<float>, code string, v int").repartition(4)


@pytest.mark.parametrize("seed,n,dims,parts,entries", [(1, 400, 12, 4, 16), (2, 60, 8, 8, 16), (3, 5, 8, 2, 16), (4, 300, 6, 3, 5)])
def test_codes_are_those_of_a_full_search(spark, monkeypatch, seed, n, dims, parts, entries):
    monkeypatch.setattr(vector_codes, "_BLOCK", 64)
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, dims))
    vectors = (centres[rng.integers(0, 6, n)] + rng.normal(scale=0.2, size=(n, dims))).astype(np.float32)
    vectors[n // 2 :] = np.round(vectors[n // 2 :])  # many ties and equal vectors
    good = [(i if i % 11 else None, i % 3 or None, v.tolist()) for i, v in enumerate(vectors)]
    bad = [(i, 1, v) for i, v in enumerate([None, [None] * dims, [float("nan")] * dims, [float("inf")] + [0.0] * (dims - 1)])]
    odd = [(9000, 2, [1.0] * (dims + 1))]
    table = vector_rows(spark, [(*r, "x", 7) for r in good + bad + odd + good[:1]])
    coded, books = vector_codes.compress(table, parts=parts, entries=entries, rounds=3)
    want, plain = plain_codes([*good, good[0]], parts, entries, 3)
    got = sorted(((r.k, r.label, bytes(r.code).hex(), r.error) for r in coded.collect()), key=repr)
    assert got == want and all((a == b).all() for a, b in zip(books, plain, strict=True))


def test_balls_leave_work_out_and_change_nothing():
    rng = np.random.default_rng(5)
    centres = rng.integers(-4000, 4000, (16, 8))
    rows = centres[rng.integers(0, 16, 5000)] + rng.integers(-300, 300, (5000, 8))
    full = vector_codes.first_assignment(rows, centres)
    start = full.copy()
    start[::50] = rng.integers(0, 16, 100)  # some sit in a wrong ball
    code, far, made = vector_codes.ball_assignment(rows, centres, start)
    assert (code == full).all() and (far == vector_codes.squared(rows, centres[full])).all()
    assert made < 2.5 * len(rows)  # a full search makes sixteen for each


def test_codes_of_empty_and_odd_tables(spark):
    none = vector_rows(spark, [])
    coded, _ = vector_codes.compress(none)
    assert coded.collect() == [] and set(coded.columns) == {"k", "label", "code", "error"}
    hollow, _ = vector_codes.compress(vector_rows(spark, [(1, 1, [], "x", 7), (2, None, None, "x", 7)]))
    assert [(r.k, r.error) for r in hollow.collect()] == [(1, 0)]
    wide, _ = vector_codes.compress(vector_rows(spark, [(i, 1, [i / 7.0] * 10, "x", 7) for i in range(5)]), parts=4)
    assert [r.error for r in wide.collect()] == [0] * 5
    with pytest.raises(ValueError):
        vector_codes.compress(vector_rows(spark, [(1, 1, [3e38] * 8, "x", 7)]))


@pytest.mark.parametrize("name", ["op11_importance_resampling", "op12_vector_codes"])
def test_queries_match_their_sql(spark, name):
    from stmtlens.llm import queries
    from tools import check

    folder, con = "/root/testdata/sf0.001", duckdb.connect()
    for t in ("documents", "benchmark", "embeddings"):
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    df = queries.QUERIES[name](spark, folder)
    found = con.execute(queries.ORACLES[name])
    names = [d[0] for d in found.description]
    assert check.canon(df.columns, rows_of(df)) == check.canon(names, found.fetchall())


def plain_bag(text):
    """The features as strings: what shares a bucket by chance apart, the bags must be alike."""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    out = Counter({"line": text.count("\n") + 1})
    for w in words:
        out["w " + w] += 1
        out.update(f"{n} {f' {w} '[i : i + n]}" for n in (3, 4, 5) for i in range(len(w) + 3 - n))
    out.update("=" if a == b else f"p {a} {b}" for a, b in zip(words, words[1:]))
    return out


@pytest.mark.parametrize("block", [5, 40, 1 << 18])
def test_features_are_those_of_words_and_grams(monkeypatch, block):
    monkeypatch.setattr(subwords, "_BLOCK", block)
    texts = ["", "a", "one two two\nthree", " x\t\n y ", "é😀 straße é😀", "aaaa" * 30, "\n\n", "ab cd " * 20, "ends with it", "it ends"]
    bucket_of = {}
    for text, (found, counts) in zip(texts, subwords.bags(texts)):
        want = plain_bag(text)
        assert counts.sum() == want.total()
        # Each plain feature has one bucket in all texts: alone or by sums, the counts agree.
        alone = {f: subwords.bags([f[2:]]) for f in want if f.startswith("w ")}
        assert all(set(b[0][0]) - {subwords._LINE} <= set(found) for b in alone.values())
        bucket_of[text] = dict(zip(found.tolist(), counts.tolist()))
    assert bucket_of["one two two\nthree"][subwords._SAME] == 1 and bucket_of["\n\n"] == {subwords._LINE: 3}
    together = {}
    for owner, found in subwords.features(texts):
        for o, f in zip(owner.tolist(), found.tolist()):
            together.setdefault(o, Counter())[f] += 1
    assert [dict(together[i]) for i in range(len(texts))] == [bucket_of[t] for t in texts]


def test_classifier_learns_from_its_fold_alone(spark, odd):
    rng = random.Random(4)

    def word():
        return "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8)))

    docs, labels = [], []
    for i in range(600):
        words = [word() for _ in range(rng.randint(1, 80))]
        kind = i % 4
        text = " ".join(w.upper() + "!!" if kind == 0 else words[0] if kind == 1 else w for w in words) if i % 97 else ""
        docs.append((i, text, i % 2 * 1.0, "z"))
        labels.append((i, int(kind > 1) if text else 0, 0))
    labels += [(2, None, 0), (None, 1, 0), (4, 7, 0), (6, 0, 0), (6, 1, 0)]
    docs.append((3, "again", 0.0, "z"))
    docs = spark.createDataFrame(docs, "doc_id bigint, text string, score double, k string")
    labels = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    model = subwords.fit(docs, labels)
    got = {r.doc_id: r for r in subwords.predict(docs, model).collect() if r.doc_id != 3}
    truth = {r.doc_id: r.quality for r in labels.collect() if r.doc_id in got and r.quality in (0, 1)}
    assert all(r.held_out == (zlib.crc32(str(k).encode()) % 3 == 1) for k, r in got.items())
    held = [(r.predicted, truth[k]) for k, r in got.items() if r.held_out]
    assert sum(a == b for a, b in held) > 0.95 * len(held)
    # Other labels of the held-out fold change nothing.
    flipped = labels.withColumn("quality", F.when(subwords.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    assert (subwords.fit(docs.repartition(7), flipped).vectors == model.vectors).all()
    strange = subwords.predict(odd, model)
    assert strange.count() == odd.count() and all(0 <= r.score <= 1 for r in strange.collect())
    assert subwords.predict(docs.limit(0), model).collect() == []
    unknown = subwords.fit(docs, labels.limit(0))
    assert {r.score for r in subwords.predict(docs, unknown).collect()} == {0.5}
