"""Operators on whole tables: against brute force on small fixtures."""

import math
import random
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from conftest_llm import least_roots, rows_of
from pyspark.sql import functions as F

import corpus_pipeline
from stmtlens.llm import elias_fano, embeddings, language_model, line_dedup, packing, sharding, simhash


def test_simhash_components(spark, documents, odd):
    texts = {r["doc_id"]: r["text"] for r in documents.collect()}
    print_of = {i: simhash.fingerprint(t) for i, t in texts.items()}
    ids = sorted(texts)
    links = [
        (a, b) for n, a in enumerate(ids) for b in ids[n + 1 :]
        if ((print_of[a] ^ print_of[b]) & (2**64 - 1)).bit_count() <= simhash.RADIUS
    ]
    roots = least_roots(ids, links)
    got = rows_of(simhash.simhash_classes(documents))
    assert sorted(got) == [(i, f"{print_of[i] % 2**64:016x}", roots[i]) for i in ids]
    kept = simhash.keep_one(documents).collect()
    assert sorted(r["doc_id"] for r in kept) == sorted(set(roots.values()))
    assert len(rows_of(simhash.simhash_classes(odd))) == odd.count()
    assert simhash.keep_one(odd).columns == odd.columns
    assert simhash.keep_one(odd.limit(0)).count() == 0


def test_ball_links_keep_components(spark):
    pick = random.Random(5)
    prints = set()
    for _ in range(250):
        base = pick.getrandbits(64)
        prints.add(base)
        for _ in range(pick.choice([0, 1, 3])):
            prints.add(base ^ sum(1 << k for k in pick.sample(range(64), pick.randint(1, 5))))
    prints = sorted(x - (1 << 64) if x >> 63 else x for x in prints)
    links = [
        (a, b) for n, a in enumerate(prints) for b in prints[n + 1 :] if ((a ^ b) & (2**64 - 1)).bit_count() <= 3
    ]
    found = rows_of(simhash.ball_links(spark.createDataFrame([(x,) for x in prints], "fp bigint")))
    assert all(((a ^ b) & (2**64 - 1)).bit_count() <= 3 for a, b in found)
    assert least_roots(prints, found) == least_roots(prints, links)


def test_near_duplicate_stage_finds_similar_texts(spark, odd):
    pick = random.Random(11)
    words = ["".join(pick.choice("abcdefghij") for _ in range(5)) for _ in range(3000)]
    rows = []
    for i in range(60):
        base = [pick.choice(words) for _ in range(120)]
        rows.append((10 * i, " ".join(base)))
        near, far = list(base), list(base)
        for at in (20, 70):  # shares 106 of 126 five-word shingles: 0.84
            near[at] = "other"
        for at in (20, 40, 60, 80, 100):  # 91 of 141: 0.65
            far[at] = "other"
        rows += [(10 * i + 1, " ".join(near)), (10 * i + 2, " ".join(far))]
    docs = spark.createDataFrame([(i, t, "s") for i, t in rows], "doc_id bigint, text string, source string")
    kept = {r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()}
    grams = {i: set(simhash.compared_shingles(t)) for i, t in rows}
    ids = sorted(grams)
    links = [
        (a, b) for n, a in enumerate(ids) for b in ids[n + 1 : n + 3]
        if len(grams[a] & grams[b]) >= 0.8 * len(grams[a] | grams[b])
    ]
    roots = set(least_roots(ids, links).values())
    assert len(links) >= 60 and roots <= kept and len(kept - roots) <= 2
    # More are further apart than the radius of op8.
    apart = [((simhash.fingerprint(dict(rows)[a]) ^ simhash.fingerprint(dict(rows)[b])) & (2**64 - 1)).bit_count() for a, b in links]
    assert sum(x > simhash.RADIUS for x in apart) > 40
    assert simhash.keep_one(odd, similarity=0.8).columns == odd.columns
    assert simhash.keep_one(odd.limit(0), similarity=0.8).count() == 0


def met(prints):
    return {(r["a"], r["b"]) for r in simhash.block_links(prints).collect()}


def test_near_copies_meet_among_strangers(spark):
    """Two words a few bits apart whose every group is led by rows that share nothing but the group's blocks."""
    make = np.random.default_rng(7)
    word = lambda: make.integers(0, 2**63, 2, dtype=np.uint64) * 2 + make.integers(0, 2, 2, dtype=np.uint64)
    rows, want = [], set()
    for i in range(20):
        a = word()
        b = a.copy()
        for k in make.choice(128, 5, replace=False):
            b[k // 64] ^= np.uint64(1) << np.uint64(k % 64)
        rows += [(10_000 + 2 * i, a), (10_001 + 2 * i, b)]
        want.add((10_000 + 2 * i, 10_001 + 2 * i))
        for w, x, y in ((w, x, y) for w in range(2) for x in range(4) for y in range(x + 1, 4)):
            mask = np.uint64(0xFFFF << 16 * x | 0xFFFF << 16 * y)
            for _ in range(8):
                stranger = word()
                stranger[w] = stranger[w] & ~mask | a[w] & mask
                rows.append((len(rows), stranger))
    df = spark.createDataFrame([(r, *f.view(np.int64).tolist()) for r, f in rows], "rep bigint, fp bigint, fq bigint")
    assert want <= met(df)


def test_texts_of_one_template_are_joined(spark):
    """Every link of 0.8 or more among 300 texts around one template, but for one in a hundred at most."""
    pick = random.Random(5)
    base = ["".join(pick.choice("abcdefgh") for _ in range(6)) for _ in range(600)]
    texts = {}
    for i in range(300):
        words = list(base)
        for _ in range(pick.choice((4, 8))):
            words[pick.randrange(600)] = f"x{pick.randrange(10**6)}"
        texts[i] = " ".join(words)
    sets = {i: set(simhash.compared_shingles(t)) for i, t in texts.items()}
    links = [(a, b) for a in sets for b in range(a + 1, 300) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    prints = spark.createDataFrame([(i, *simhash.wide_print(t)[1:]) for i, t in texts.items()], "rep bigint, fp bigint, fq bigint")
    seen = met(prints)
    roots = least_roots(texts, [x for x in links if x in seen])
    assert len(links) > 1000 and sum(roots[a] == roots[b] for a, b in links) >= 0.99 * len(links)


def test_a_crowd_of_unlike_texts_hides_no_similar_pair(spark, monkeypatch):
    """Texts of one template, most of them below 0.8, some pairs and chains above it: exactly their components."""
    pick = random.Random(3)
    template = ["".join(pick.choice("abcdefgh") for _ in range(6)) for _ in range(400)]
    edit = lambda words, n: [f"x{pick.randrange(10**6)}" if i in at else w for at in [set(pick.sample(range(400), n))] for i, w in enumerate(words)]
    texts = {}
    for i in range(400):
        words = edit(template, 14)
        texts[10 * i] = " ".join(words)
        for k in range(i % 3):
            words = edit(words, pick.choice((4, 7, 9, 10)))
            texts[10 * i + 1 + k] = " ".join(words)
    sets = {i: set(simhash.compared_shingles(t)) for i, t in texts.items()}
    ids = sorted(texts)
    links = [(a, b) for n, a in enumerate(ids) for b in ids[n + 1 :] if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    roots = set(least_roots(ids, links).values())
    assert 500 < len(roots) < len(ids) - 100
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    kept = lambda: sorted(r["doc_id"] for r in simhash.keep_one(docs, similarity=0.8).select("doc_id").collect())
    assert kept() == sorted(roots)
    # The same by many small tiles and with counters that say nothing.
    monkeypatch.setattr(simhash, "TILE", 50)
    monkeypatch.setattr(simhash, "TILE_SHINGLES", 50 * 300)
    monkeypatch.setattr(simhash, "shingle_counts", lambda docs, text: np.zeros(simhash.COUNTERS, dtype=np.int32))
    assert kept() == sorted(roots)


def test_tiles_link_all_similar_sets():
    make = np.random.default_rng(4)
    base = make.integers(-(2**63), 2**63, 300)
    sets = []
    for _ in range(90):
        own = base.copy()
        own[make.choice(300, make.choice((10, 30, 60)), replace=False)] = make.integers(-(2**63), 2**63, 1)
        sets.append(np.unique(own))
    close = lambda a, b: len(np.intersect1d(sets[a], sets[b])) >= 0.8 * len(np.union1d(sets[a], sets[b]))
    sizes, grams = np.array([len(x) for x in sets]), np.concatenate(sets)
    for left in (np.ones(90, dtype=bool), np.arange(90) < 40):
        pairs = [(a, b) for a in range(90) for b in range(a + 1, 90) if (left.all() or left[a] != left[b]) and close(a, b)]
        got = simhash.similar_sets(sizes, grams, left, 0.8)
        assert len(got) < 90 and all(close(a, b) for a, b in got)
        assert least_roots(range(90), got) == least_roots(range(90), pairs) and pairs


def test_sketches_decide_as_whole_sets_do(spark):
    make = random.Random(9)
    sets, pairs = {}, []
    for i in range(200):
        size = make.choice((0, 1, 3, 100, 128, 129, 700))
        shared = {make.randrange(-(2**63), 2**63) for _ in range(size)}
        own = lambda n: {make.randrange(-(2**63), 2**63) for _ in range(n)}
        sets[2 * i], sets[2 * i + 1] = shared | own(make.choice((0, size // 9, size // 8))), shared | own(make.choice((0, size // 9, size // 8, size)))
        pairs.append((2 * i, 2 * i + 1))
    rows = [(i, list(x), simhash.sketch(list(x))) for i, x in sets.items()]
    df = spark.createDataFrame(rows, "node bigint, grams array<bigint>, small array<bigint>")
    got = simhash.alike(spark.createDataFrame(pairs, "a bigint, b bigint"), df, 0.8)
    want = [(a, b) for a, b in pairs if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    assert sorted(rows_of(got)) == want and 50 < len(want) < 190


def test_fingerprints_propose_near_copies(spark):
    """Sets that meet in no shingle: texts within the radius of their fingerprints are found by these, and then compared."""
    pick = random.Random(5)
    words = ["".join(pick.choice("abcdefghij") for _ in range(5)) for _ in range(3000)]
    texts, joined, unlike = [], set(), 0
    while len(joined) < 5 or unlike < 5:
        base = [pick.choice(words) for _ in range(120)]
        at = ((60,), (30, 60, 90))[len(joined) >= 5]
        a, b = " ".join(base), " ".join(pick.choice(words) if i in at else w for i, w in enumerate(base))
        if ((simhash.fingerprint(a) ^ simhash.fingerprint(b)) & (2**64 - 1)).bit_count() <= simhash.RADIUS:
            grams = [set(simhash.compared_shingles(t)) for t in (a, b)]
            similar = len(grams[0] & grams[1]) >= 0.8 * len(grams[0] | grams[1])
            joined |= {len(texts) + 1} if similar else set()
            unlike += not similar
            texts += [a, b]
    counts = np.zeros(simhash.COUNTERS, dtype=np.int32)
    rows = [(k, k, t, *simhash.prefix_print(t, counts, 0.8)[:-1], []) for k, t in enumerate(texts)]
    df = spark.createDataFrame(
        rows, "k bigint, d bigint, _text string, node bigint, fp bigint, n int, bits array<bigint>, prefix array<bigint>"
    )
    got = simhash.similar_classes(df.drop("_text"), df.select("k", "d", "_text"), F.struct("k", "d"), 0.8)
    assert {r["first"]["k"] for r in got.collect()} == set(range(len(texts))) - joined


def slow_best_fit(items, capacity, per_source):
    bins, out = [], []
    for length, source, cluster in items:
        fits = [
            (room, n) for n, (room, sources, clusters) in enumerate(bins)
            if room >= length and cluster not in clusters and sources.count(source) < per_source
        ]
        if fits:
            at = min(fits)[1]
        else:
            at = len(bins)
            bins.append([capacity, [], set()])
        bins[at][0] -= length
        bins[at][1].append(source)
        bins[at][2].add(cluster)
        out.append(at)
    return out


def test_best_fit_against_brute_force():
    pick = random.Random(6)
    for _ in range(60):
        items = sorted(((pick.choice([3, 5, 5, 8, 20]), pick.randint(0, 4), pick.randint(0, 15)) for _ in range(120)), reverse=True)
        assert packing.best_fit(items, 40, 3) == slow_best_fit(items, 40, 3)


def test_packing_keeps_all_and_obeys(documents, odd):
    texts = {r["doc_id"]: (r["text"].lower().split(), r["source"]) for r in documents.collect()}
    got = packing.pack(documents, capacity=200, group_bins=8).collect()
    room, sources, words, lengths = Counter(), Counter(), Counter(), Counter()
    for r in got:
        room[r["bin"]] += r["length"]
        sources[r["bin"], texts[r["doc_id"]][1]] += 1
        words[r["bin"], tuple(texts[r["doc_id"]][0])] += 1
        lengths[r["doc_id"]] += r["length"]
    assert max(room.values()) <= 200 and max(sources.values()) <= packing.PER_SOURCE and max(words.values()) == 1
    assert lengths == {i: len(w) + 1 for i, (w, _) in texts.items()}
    assert packing.pack(odd).count() == odd.count()  # no text here is longer than a bin
    assert packing.pack(odd.limit(0)).count() == 0


def test_sharding_against_brute_force(spark, documents, odd):
    sizes = {r["doc_id"]: len(r["text"].encode()) for r in documents.collect()}
    hashes = {i: int(__import__("hashlib").md5(str(i).encode()).hexdigest()[:15], 16) for i in sizes}
    limit = 6000

    def split(ids, prefix):
        if sum(sizes[i] for i in ids) <= limit or len(ids) == 1:
            return {i: prefix for i in ids}
        at = sharding.BITS - 1 - len(prefix)
        return split([i for i in ids if not hashes[i] >> at & 1], prefix + "0") | split(
            [i for i in ids if hashes[i] >> at & 1], prefix + "1"
        ) if ids else {}

    want = split(list(sizes), "")
    got = {r["doc_id"]: r["shard"] for r in sharding.assign_shards(documents, limit).collect()}
    assert len(set(got.values())) > 20 and got == want
    assert len(rows_of(sharding.assign_shards(odd, 10))) == odd.count()
    assert sharding.assign_shards(odd.limit(0)).count() == 0


def test_sharding_parts_rows_of_one_key(spark, tmp_path):
    rows = [(7, "x" * 90 + str(i)) for i in range(40)] + [(None, "same" * 20)] * 40 + [(i, "y" * 50) for i in range(100, 130)]
    rows += [(8, "z" * 2000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = sharding.assign_shards(docs, 500).collect()
    assert sorted((r[0] or 0, r["n_bytes"]) for r in got) == sorted((i or 0, len(t)) for i, t in rows)
    sums = Counter()
    for r in got:
        sums[r["shard"]] += r["n_bytes"]
    assert all(r["shard_bytes"] == sums[r["shard"]] for r in got)
    assert [(r["doc_id"], r["shard_rows"]) for r in got if r["over_limit"]] == [(8, 1)]
    assert not any(a != b and b.startswith(a) for a in sums for b in sums)
    sharding.write_shards(docs, f"{tmp_path}/out", 500)
    back = spark.read.parquet(f"{tmp_path}/out")
    assert sorted(map(str, rows_of(back.select("doc_id", "text")))) == sorted(map(str, rows))


def test_line_dedup(documents, odd):
    rows = documents.collect()
    sites, first = {}, {}
    for r in rows:
        for x in r["text"].split("\n"):
            sites.setdefault(x.strip(" "), set()).add(r["source"])
            first[x.strip(" ")] = min(first.get(x.strip(" "), r["doc_id"]), r["doc_id"])
    gone = {x for x, s in sites.items() if len(s) >= line_dedup.MIN_SITES and x}
    want = {
        r["doc_id"]: "\n".join(x for x in r["text"].split("\n") if x.strip(" ") not in gone or first[x.strip(" ")] == r["doc_id"])
        for r in rows
    }
    assert gone
    assert {r["doc_id"]: r["text"] for r in line_dedup.remove_spread_lines(documents).collect()} == want
    assert line_dedup.remove_spread_lines(odd).count() == odd.count()
    assert line_dedup.clean_documents(odd.limit(0)).columns == odd.columns


def test_line_dedup_removes_repeated_passages(spark):
    long, other = (" ".join(f"{x}{i}" for i in range(51)) for x in "ab")
    just = " ".join(f"c{i}" for i in range(50))
    rows = [(1, f"{long}\none\n{just}", "a"), (2, f"two\n {long}", "a"), (3, f"{just}\nthree", "a"),
            (4, "spread\nfour", "a"), (5, "spread\nfive", "b"), (6, other, "c"), (7, other, "c")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    got = {r["doc_id"]: r["text"] for r in line_dedup.clean_documents(docs).collect()}
    # A heading on two sites is no boilerplate.
    assert got == {i: t for i, t, _ in rows} | {2: "two"}


@pytest.mark.parametrize("threshold", [2, 3, 20])
def test_line_spread_at_and_around_the_threshold(spark, monkeypatch, threshold):
    """Lines on 2, 3, 4, 20 and 200 sites: near the threshold they are counted, beyond it the sketch decides."""
    spread = {2: "on two", 3: "on three", 4: "on four", 19: "on nineteen", 20: "on twenty", 21: "on more", 200: "on all"}
    rows = [
        (i, "\n".join([f"own {i}", *(t for n, t in spread.items() if i < n)]), f"site{i}") for i in range(200)
    ] + [(1000 + i, "on one", "site7") for i in range(50)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string").repartition(7)
    asked = []
    seen = line_dedup.F.count_distinct
    monkeypatch.setattr(line_dedup.F, "count_distinct", lambda *c: asked.append(c) or seen(*c))
    got = {r["doc_id"]: r["text"] for r in line_dedup.remove_spread_lines(docs, threshold, passages=False).collect()}
    gone = {t for n, t in spread.items() if n >= threshold}
    assert got == {i: "\n".join(x for x in t.split("\n") if x not in gone or i == 0) for i, t, _ in rows}
    assert asked  # the same path at every threshold


def test_line_dedup_with_clashing_columns(spark):
    names = "doc_id bigint, text string, source string, k string, d bigint, h int, s int, first int, pos int, line string"
    docs = spark.createDataFrame([(i, f"same\n{i}", f"s{i}", "k", 1, 2, 3, 4, 5, "l") for i in range(4)], names)
    got = line_dedup.clean_documents(docs)
    assert got.columns == docs.columns
    assert sorted((r["doc_id"], r["text"], r["k"], r["d"]) for r in got.collect()) == [
        (i, "same\n0" if i == 0 else str(i), "k", 1) for i in range(4)
    ]


def test_elias_fano(tmp_path):
    make = np.random.default_rng(1)
    for n, universe in ((0, 10), (1, 1), (5, 1000), (1000, 1200), (20000, 1 << 45), (300, 301)):
        values = np.sort(make.choice(min(universe, 1 << 22), size=n, replace=False) * max(1, universe >> 22))
        elias_fano.save(f"{tmp_path}/x", elias_fano.nested("s", elias_fano.encode(values, universe)))
        made = elias_fano.Sequence(elias_fano.part("s", elias_fano.load(f"{tmp_path}/x")))
        asked = np.concatenate([values, make.integers(0, universe + 5, 300)])
        where = {int(v): i for i, v in enumerate(values)}
        assert made.find(asked).tolist() == [where.get(int(v), -1) for v in asked]
        if n:
            assert (made[np.arange(n)] == values).all()
            assert (made.gaps(np.arange(n - 1)) == np.diff(values)).all()


def slow_scores(rows, discount=language_model.DISCOUNT):
    out_of = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    texts = [language_model.tokens(t or "") for i, t in rows if not out_of(i)]
    c1, c2, c3, n2, n3 = Counter(w for t in texts for w in t), Counter(), Counter(), Counter(), Counter()
    for t in texts:
        t = ["", "", *t]
        for a, b, c in zip(t, t[1:], t[2:]):
            c2[b, c] += 1
            c3[a, b, c] += 1
            n2[b] += 1
            n3[a, b] += 1
    kinds2, kinds3 = Counter(a for a, _ in c2), Counter((a, b) for a, b, _ in c3)
    total, words, out = sum(c1.values()), len(c1), []
    for i, text in rows:
        made, score, base = language_model.tokens(text or ""), 0, 0
        for a, b, c in zip(["", "", *made], ["", *made], made):
            p = (c1[c] + 1) / (total + words + 1)
            base += math.log10(p)
            if n2[b]:
                p = max(c2[b, c] - discount, 0) / n2[b] + discount * kinds2[b] / n2[b] * p
            if n3[a, b]:
                p = max(c3[a, b, c] - discount, 0) / n3[a, b] + discount * kinds3[a, b] / n3[a, b] * p
            score += math.log10(p)
        out.append((i, out_of(i), len(made), sum(c1[w] > 0 for w in made), total, base, score))
    return out


@pytest.mark.parametrize("shard_tokens", [1 << 20, 1 << 11])
def test_language_model_against_brute_force(documents, shard_tokens):
    rows = [(r["doc_id"], r["text"]) for r in documents.collect()]
    got = sorted(rows_of(language_model.score_held_out(documents, shard_tokens=shard_tokens)))
    for a, b in zip(got, sorted(slow_scores(rows)), strict=True):
        assert a[:5] == b[:5]
        assert a[5] == pytest.approx(b[5]) and abs(a[6] - b[6]) < 0.001 * a[2]
    held = [r for r in got if r[1]]
    assert sum(r[6] for r in held) > sum(r[5] for r in held)  # better than single words on unseen texts


def test_language_model_odd_rows(odd):
    got = rows_of(language_model.score_held_out(odd))
    assert len(got) == odd.count() and all(r[6] <= 0 for r in got)
    assert rows_of(language_model.score_held_out(odd.limit(0))) == []


def test_embeddings_against_brute_force(spark):
    make = np.random.default_rng(2)
    centres = make.normal(size=(12, 24))
    vectors = np.concatenate([c + make.normal(scale=0.3, size=(25, 24)) for c in centres] + [centres, centres])
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(vectors.astype(np.float32))]
    unit = np.array([v for _, v in rows])
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    near = unit @ unit.T >= embeddings.THRESHOLD
    np.fill_diagonal(near, False)
    roots = least_roots(range(len(rows)), zip(*map(lambda x: x.tolist(), np.nonzero(near))))
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    assert sorted(rows_of(embeddings.near_vectors(df))) == [
        (i, int(near[i].sum()), roots[i], roots[i] == i) for i in range(len(rows))
    ]
    odd = [(1, [1.0, 0.0]), (1, [2.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [math.nan, 1.0]), (6, [None, 1.0]), (None, [1.0, 0.1]), (8, [1.0]), (9, [])]
    df = spark.createDataFrame(odd, "vec_id bigint, embedding array<float>")
    got = rows_of(embeddings.near_vectors(df))
    assert sorted(r[1] for r in got) == [0] * 6 + [2] * 3 and (5, 0, 5, True) in got
    assert embeddings.near_vectors(df.limit(0)).count() == 0


def test_oracles_of_the_registered_queries(spark):
    folder = "/root/testdata/sf0.001"
    duck = duckdb.connect()
    duck.execute(f"create view documents as select * from '{folder}/documents.parquet'")
    for query, sql in ((sharding.op1_sharding, sharding.OP1_SQL), (line_dedup.op10_line_dedup, line_dedup.OP10_SQL)):
        df = query(spark, folder)
        want = duck.execute(f"select {', '.join(df.columns)} from ({sql})").fetchall()
        assert sorted(rows_of(df)) == sorted(want)


def test_pipeline_stages(spark, documents, odd):
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "quality_rules", "line_dedup", "simhash_near_dedup", "pii", "best_fit_packing",
    ]
    from stmtlens.llm import quality

    docs = documents
    want = {r["doc_id"]: r["text"] for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:4]:
        docs = stage(spark, docs, "")
        got = {r["doc_id"]: r["text"] for r in docs.collect()}
        if name == "quality_rules":
            want = {i: quality.judge(t)[-1] for i, t in want.items() if quality.judge(t)[6]}
            assert got == want
        assert set(got) <= set(want) and docs.columns == documents.columns
        want = got
    assert not any("@" in t or "4111-1111" in t for t in want.values())
    assert {r["doc_id"] for r in corpus_pipeline.packed(spark, docs, "").collect()} == set(want)
    for _, stage in corpus_pipeline.STAGES[:4]:
        assert stage(spark, odd, "").columns == odd.columns
