"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints at most three bits apart have a bit string between them, at most one flip from
one of them and two from the other.  Every distinct fingerprint therefore emits all variants
within half the radius, and the variants are shuffled.  Parity tells which half it takes:

* all emit their 64 variants at one flip: pairs at distance 2 have the same parity and meet;
* odd fingerprints also emit themselves, so pairs at distance 1 meet in an even one's variant;
* odd fingerprints also emit their variants at two flips in the same half of the word: pairs at
  distance 3 differ in parity, and of three flips two lie in one half; the even side makes the third.

In one variant's group all members but those two flips away are pairwise within the radius, and
each of these is within the radius of all the others.  So links from one centre to all members
join the group without emitting its pairs, and a group holds at most 1,057 fingerprints.  Pairs
of two-flip members need no link there: if they are within the radius, they meet elsewhere.
Links are deduplicated and verified against the radius.

A stage that removes near copies asks for texts whose sets of five-word shingles are alike, wherever their
fingerprints lie.  ``keep_one`` finds all of them with a given similarity.  Links of fingerprints are candidates, and
so are texts that meet in a shingle, which also finds what lies outside the radius: of two such sets, each put in one
order of all shingles, the first common shingle is among the first few of either, so a set is shuffled by those
alone and all that meet in a shingle are candidates.  Counters put shingles of many texts last; they decide
how many meet, not what is found.  Where few meet, all pairs are taken.  Where many do, each is first linked to one
centre; groups that this leaves in several components are compared whole, in tiles of bounded size
whose tasks return no more links than join their rows.  Pairs are told apart by lengths and
by the parities of 512 bits, which bound what the sets share; the whole sets decide the others.
"""

from __future__ import annotations

import zlib
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stmtlens.llm.common import components, map_texts, parts, ship, table, written

SHINGLE = 3
SEED = 42
RADIUS = 3
#: Words of the shingles of wide fingerprints, and of those that are compared.
WIDE_SHINGLE = 2
COMPARED_SHINGLE = 5
#: Least hashes of a text's shingles that its sketch holds; texts with no more are compared by it exactly.
SKETCH = 128
#: Counters of shingles by the low bits of their hashes, and how many of them a row holds as they are summed.
COUNTERS = 1 << 20
_SLICE = 1 << 10
#: Bits of a set, each the parity of the shingles that fall on it.
PARITIES = 512
#: Sets that meet in a shingle up to which all their pairs are taken; more are compared in tiles.
FEW = 32
#: Most sets of a tile, and most shingles but for those of its last set.
TILE = 512
TILE_SHINGLES = 1 << 19
#: What products of real numbers may be off; bounds give way by it, the last comparison decides.
_SLACK = 1e-6
#: Shingles whose bits are summed at once.
_BLOCK = 1 << 16

#: The bits of each half of a fingerprint: (first, last, mask).
_HALVES = ((0, 31, 0x00000000FFFFFFFF), (32, 63, -0x100000000))


def _literal(flips: list[int]) -> str:
    """An SQL array of bit masks; a constant of the plan, unlike a transform of a sequence."""
    signed = (f"{f}L" if f < 1 << 63 else f"({f - (1 << 64) + 1}L - 1L)" for f in flips)
    return f"array({', '.join(signed)})"


def _one_flip(first: int, last: int) -> list[int]:
    return [1 << i for i in range(first, last + 1)]


def _two_flips(first: int, last: int) -> list[int]:
    return [1 << i | 1 << j for i in range(first, last) for j in range(i + 1, last + 1)]


def fingerprint(text: str) -> int:
    """The fingerprint as a signed 64-bit number; zero for a text without words."""
    from xxhash import xxh64_intdigest

    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) < SHINGLE:
        hashes = [xxh64_intdigest(joined, SEED)]
    else:
        ends = list(accumulate((len(w) + 1 for w in words)))
        starts = [0, *ends]
        hashes = [xxh64_intdigest(joined[a : b - 1], SEED) for a, b in zip(starts, ends[SHINGLE - 1 :])]
    total = np.zeros(64, dtype=np.int64)
    every = np.array(hashes, dtype="<u8")
    for at in range(0, len(every), _BLOCK):
        bits = np.unpackbits(every[at : at + _BLOCK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        total += bits.sum(axis=0, dtype=np.int64)
    made = np.packbits(2 * total > len(every), bitorder="little").view("<u8")[0]
    return int(made.astype(np.int64))


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, fp bigint) for every row."""
    return map_texts(docs, key, text, lambda value: (fingerprint(value),), "fp bigint")


def _words(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").lower().split()


def _shingles(words: list[bytes], size: int) -> list[bytes]:
    """All runs of ``size`` words; a shorter text is one shingle, one without words none."""
    if len(words) <= size:
        return [b" ".join(words)] if words else []
    return [b" ".join(words[i : i + size]) for i in range(len(words) - size + 1)]


def wide_print(text: str) -> tuple[int, int, int]:
    """(hash of the words, two words of a 128-bit fingerprint)."""
    from xxhash import xxh3_128_digest, xxh64_intdigest

    words = _words(text)
    node = xxh64_intdigest(b" ".join(words), SEED)
    shingles = _shingles(words, WIDE_SHINGLE)
    total = np.zeros(128, dtype=np.int64)
    for at in range(0, len(shingles), _BLOCK):
        hashes = b"".join(xxh3_128_digest(s, SEED) for s in shingles[at : at + _BLOCK])
        total += np.unpackbits(np.frombuffer(hashes, dtype=np.uint8).reshape(-1, 16), axis=1).sum(axis=0, dtype=np.int64)
    low, high = np.packbits(2 * total > len(shingles)).view("<i8").tolist()
    return node - (1 << 64) * (node >> 63), low, high


def _compared(text: str) -> np.ndarray:
    from xxhash import xxh64_intdigest

    words = _words(text)
    joined = b" ".join(words)
    if len(words) <= COMPARED_SHINGLE:
        made = [xxh64_intdigest(joined, SEED)] if words else []
    else:
        ends = list(accumulate(len(w) + 1 for w in words))
        starts = [0, *ends]
        made = [xxh64_intdigest(joined[a : b - 1], SEED) for a, b in zip(starts, ends[COMPARED_SHINGLE - 1 :])]
    return np.unique(np.array(made, dtype="<u8").view("<i8"))


def compared_shingles(text: str) -> list[int]:
    """The hashes of the distinct shingles that decide whether texts are similar."""
    return _compared(text).tolist()


def compared(text: str) -> tuple[list[int], list[int]]:
    grams = compared_shingles(text)
    return grams, sketch(grams)


def shingle_counts(docs: DataFrame, text: str) -> np.ndarray:
    """In how many rows the shingles of each counter are, over all rows; one table of bounded size."""
    rows = docs.select(F.coalesce(F.col(text), F.lit("")).alias("_text"))

    def count(batches):
        held, waiting, size = np.zeros(COUNTERS, dtype=np.int64), [], 0
        for batch in parts(batches):
            for value in batch.column(0):
                waiting.append(_compared(value.as_py()) & (COUNTERS - 1))
                size += len(waiting[-1])
                if size >= COUNTERS:
                    held += np.bincount(np.concatenate(waiting), minlength=COUNTERS)
                    waiting, size = [], 0
        if waiting:
            held += np.bincount(np.concatenate(waiting), minlength=COUNTERS)
        # Most counters of a small task are zero.
        slices = [(n, zlib.compress(part.tobytes(), 1)) for n, part in enumerate(held.reshape(-1, _SLICE)) if part.any()]
        yield pa.RecordBatch.from_pydict(
            {"slice": pa.array([n for n, _ in slices], pa.int64()), "held": pa.array([b for _, b in slices], pa.binary())}
        )

    def add(rows: pa.Table) -> pa.Table:
        total = np.zeros(_SLICE, dtype=np.int64)
        for value in rows.column("held"):
            total += np.frombuffer(zlib.decompress(value.as_py()), dtype=np.int64)
        return pa.table({"slice": rows.column("slice").slice(0, 1), "held": pa.array([total.tobytes()], pa.binary())})

    ship(docs.sparkSession)
    schema = "slice bigint, held binary"
    counts = np.zeros((COUNTERS // _SLICE, _SLICE), dtype=np.int32)
    for row in rows.mapInArrow(count, schema).groupBy("slice").applyInArrow(add, schema).collect():
        counts[row["slice"]] = np.minimum(np.frombuffer(row["held"], dtype=np.int64), 2**31 - 1)
    return counts.reshape(-1)


def _least(share: float, size: int) -> int:
    """The least whole number that is ``share`` of ``size``, or one less where the product may be off."""
    return int(np.ceil(share * size - _SLACK))


def prefix_print(text: str, counts: np.ndarray, similarity: float) -> tuple[int, int, int, list[int], list[int]]:
    """(hash of the words, fingerprint, number of shingles, parities, the first shingles in the order of ``counts``).

    Sets that share ``similarity`` of their union share that of either, so one of the first shingles is common.
    """
    from xxhash import xxh64_intdigest

    node = xxh64_intdigest(b" ".join(_words(text)), SEED)
    grams = _compared(text)
    bits = np.bincount((grams >> 20) & (PARITIES - 1), minlength=PARITIES).astype(np.uint8) & 1
    order = np.lexsort((grams, counts[grams & (COUNTERS - 1)]))
    first = order[: len(grams) - _least(similarity, len(grams)) + 1]
    return node - (1 << 64) * (node >> 63), fingerprint(text), len(grams), np.packbits(bits).view("<i8").tolist(), grams[first].tolist()


def hex16(fp: str | Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def ball_links(distinct: DataFrame) -> DataFrame:
    """(a, b): links between the distinct fingerprints of column ``fp`` that keep its components."""
    links = [_links_by_half(distinct, *_HALVES[1], *_HALVES[0][:2]), _links_by_half(distinct, *_HALVES[0], *_HALVES[1][:2])]
    return links[0].union(links[1]).distinct()


def _links_by_half(distinct: DataFrame, first: int, last: int, mask: int, low: int, high: int) -> DataFrame:
    """The links whose two flips lie in the bits ``low`` to ``high``.

    Those flips leave the other half of a variant as it is, so rows are shuffled on that half
    (33 for a fingerprint: itself and its flips there) and make the rest of their variants after it.
    """
    odd = F.bit_count("fp") % 2 == 1
    one, two = _one_flip(low, high), _two_flips(low, high)
    keyed = distinct.select("fp", F.explode(F.expr(_literal([0, *_one_flip(first, last)]))).alias("moved"))
    keyed = keyed.select(
        "fp", "moved", F.col("fp").bitwiseXOR(F.col("moved")).bitwiseAND(F.lit(mask)).alias("half")
    ).repartition("half")
    flips = (
        F.when(F.col("moved") != 0, F.array("moved"))
        .when(odd, F.expr(_literal([0, *one, *two])))
        .otherwise(F.expr(_literal(one)))
    )
    variants = keyed.select("fp", "half", F.explode(flips).alias("flip")).select(
        "fp", "half", F.col("fp").bitwiseXOR(F.col("flip")).alias("variant")
    )
    near = F.bit_count(F.col("fp").bitwiseXOR(F.col("variant"))) <= 1
    centre = F.min(F.when(near, F.col("fp"))).over(Window.partitionBy("half", "variant"))
    return (
        variants.select("fp", centre.alias("centre"))
        .filter("centre <> fp")
        .select(F.least("fp", "centre").alias("a"), F.greatest("fp", "centre").alias("b"))
        .filter(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= RADIUS)
    )


def near_classes(prints: DataFrame, first: Column) -> DataFrame:
    """(fp, first): the least ``first`` of the component of each fingerprint in ``prints`` (fp, ...)."""
    distinct = written(prints.groupBy("fp").agg(F.min(first).alias("first")), "distinct")
    roots = components(ball_links(distinct.select("fp")))
    named = distinct.join(roots, distinct.fp == roots.node, "left").select(
        "fp", "first", F.coalesce("root", "fp").alias("root")
    )
    named = written(named, "named")
    least = written(named.groupBy("root").agg(F.min("first").alias("least")), "least")
    return written(
        named.join(least, "root").select("fp", F.col("least").alias("first")), "classes"
    )


def block_links(prints: DataFrame) -> DataFrame:
    """(a, b): all pairs of the rows (rep, fp, fq) that agree in two blocks of a word but for a bit in each.

    Rows are shuffled on one block (17 for each of 12 pairs of blocks: itself and its flips there)
    and make the variants of the other block after it.  The pairs of a group grow with its square;
    ``keep_one`` finds texts alike by their shingles and does not use them.
    """
    at = lambda word, block: f"int(shiftrightunsigned({word}, {16 * block}) & 65535L)"
    couples = [(w, i, j) for w in ("fp", "fq") for i in range(4) for j in range(i + 1, 4)]
    blocks = ", ".join(
        f"struct({n} as t, {at(w, i)} as moving, {at(w, j)} as other)" for n, (w, i, j) in enumerate(couples)
    )
    flips = ", ".join(str(f) for f in [0, *_one_flip(0, 15)])
    keyed = prints.select("rep", F.explode(F.expr(f"array({blocks})")).alias("b")).select(
        "rep", "b.*", F.explode(F.expr(f"array({flips})")).alias("moved")
    )
    keyed = keyed.select(
        "rep", F.expr("(t << 16) | (moving ^ moved)").alias("half"), F.expr("if(moved = 0, other, other | 65536)").alias("other")
    )
    variants = keyed.select(
        "rep", "half", F.explode(F.expr(f"if(other >= 65536, array(0), array({flips}))")).alias("flip"), "other"
    ).select("rep", "half", F.expr("(other & 65535) ^ flip").alias("variant"))
    one, two = variants.withColumnRenamed("rep", "a"), variants.withColumnRenamed("rep", "b")
    return one.join(two.hint("merge"), ["half", "variant"]).filter("a < b").select("a", "b").distinct()


def sketch(grams: list[int]) -> list[int]:
    """The ``SKETCH`` least of the hashes, in order."""
    return sorted(grams)[:SKETCH]


def alike(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The ``pairs`` (a, b) whose ``sets`` (node, grams, small) have at least this Jaccard similarity.

    First by sizes and sketches, a bounded number of hashes for each side; the whole sets are joined for
    the pairs that those leave open.  A pair of sets no larger than their sketches is decided by them;
    of others, the hashes up to the end of both sketches are known, and what differs there differs in the sets.
    """
    narrow = sets.select("node", "small", F.size("grams").alias("n"))
    side = lambda name: narrow.select(F.col("node").alias(name), F.col("small").alias(f"s{name}"), F.col("n").alias(f"n{name}"))
    judged = pairs.join(side("a"), "a").join(side("b"), "b")
    end = lambda name: F.when(F.col(f"n{name}") > SKETCH, F.element_at(f"s{name}", -1))
    cut = F.least(end("a"), end("b"))
    known = lambda name: F.filter(f"s{name}", lambda x: x <= cut)
    differ = F.size(F.array_except(known("a"), "sb")) + F.size(F.array_except(known("b"), "sa"))
    whole = F.greatest("na", "nb") <= SKETCH
    shared = F.size(F.array_intersect("sa", "sb"))
    exact = shared >= F.lit(similarity) * (F.col("na") + F.col("nb") - shared)
    judged = judged.filter(_sizes_fit(similarity) & F.when(whole, exact).otherwise(differ <= _most_apart(similarity)))
    judged = written(judged.select("a", "b", whole.alias("decided")), "judged")
    open_ = judged.filter("not decided").select("a", "b")
    full = open_.join(sets.select(F.col("node").alias("a"), F.col("grams").alias("ga")), "a").join(
        sets.select(F.col("node").alias("b"), F.col("grams").alias("gb")), "b"
    )
    common = F.size(F.array_intersect("ga", "gb"))
    full = full.filter(common >= F.lit(similarity) * (F.size("ga") + F.size("gb") - common)).select("a", "b")
    return judged.filter("decided").select("a", "b").union(full)


def _sizes_fit(similarity: float) -> Column:
    """Whether sets of ``na`` and ``nb`` shingles can be so similar."""
    return F.least("na", "nb") >= F.lit(similarity) * F.greatest("na", "nb") - _SLACK


def _most_apart(similarity: float) -> Column:
    """How many shingles may be in one set only, of ``na`` and ``nb``, if they are so similar."""
    return F.lit((1 - similarity) / (1 + similarity)) * (F.col("na") + F.col("nb")) + _SLACK


def candidates(held: DataFrame, sets: DataFrame, similarity: float, near: DataFrame) -> DataFrame:
    """(a, b): pairs of ``sets`` (node, n, bits) that the bounds leave open: the links ``near``, and those that meet in ``held``.

    All pairs of a shingle that few hold, and each of many with their centre.
    """
    some = held.filter(F.col("held") <= FEW)
    side = lambda name: some.select("token", F.col("node").alias(name), F.col("n").alias(f"n{name}"), F.col("at").alias(f"at{name}"))
    # The first common shingle stands still further ahead in the smaller set, as the larger bounds what is shared, too.
    ahead = lambda name: F.col(f"at{name}") <= F.col(f"n{name}") - F.ceil(
        F.lit(2 * similarity / (1 + similarity)) * F.col(f"n{name}") - _SLACK
    )
    met = side("a").join(side("b").hint("merge"), "token").filter(
        (F.col("a") < F.col("b")) & _sizes_fit(similarity) & F.when(F.col("na") <= F.col("nb"), ahead("a")).otherwise(ahead("b"))
    )
    stars = held.filter((F.col("held") > FEW) & (F.col("node") != F.col("centre"))).select(
        F.least("node", "centre").alias("a"), F.greatest("node", "centre").alias("b")
    )
    pairs = met.select("a", "b").union(stars).union(near).distinct()
    side = lambda name: sets.select(F.col("node").alias(name), F.col("n").alias(f"n{name}"), F.col("bits").alias(f"bits{name}"))
    apart = F.expr("aggregate(zip_with(bitsa, bitsb, (x, y) -> bit_count(x ^ y)), 0, (s, x) -> s + x)")
    bound = pairs.join(side("a").hint("merge"), "a").join(side("b").hint("merge"), "b")
    return bound.filter(_sizes_fit(similarity) & (apart <= _most_apart(similarity))).select("a", "b")


def _forest(near: np.ndarray) -> list[tuple[int, int]]:
    """Links that keep the components of a symmetric matrix, no more than it has rows."""
    out, seen = [], np.zeros(len(near), dtype=bool)
    for start in range(len(near)):
        waiting = [] if seen[start] else [start]
        seen[start] = True
        while waiting:
            at = waiting.pop()
            new = np.flatnonzero(near[at] & ~seen)
            seen[new] = True
            out += [(at, n) for n in new.tolist()]
            waiting += new.tolist()
    return out


def similar_sets(sizes: np.ndarray, grams: np.ndarray, left: np.ndarray, similarity: float) -> list[tuple[int, int]]:
    """Links that keep the components of similar sets; sets lie one after another in ``grams``.

    Sets marked ``left`` are compared with the others, or all with all if all are marked.
    """
    _, column, times = np.unique(grams, return_inverse=True, return_counts=True)
    common = times > 1
    column = np.where(common, np.cumsum(common) - 1, -1)[column]
    row = np.repeat(np.arange(len(sizes)), sizes)
    row, column = row[column >= 0], column[column >= 0]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    one = np.flatnonzero(left)
    two = one if left.all() else np.flatnonzero(~left)
    shared = np.zeros((len(one), len(two)))
    for at in range(0, int(common.sum()), 4096):
        a, b = np.searchsorted(column, (at, at + 4096))
        block = np.zeros((len(sizes), 4096), dtype=np.float32)
        block[row[a:b], column[a:b] - at] = 1
        shared += block[one] @ block[two].T
    close = shared >= similarity * (sizes[one][:, None] + sizes[two][None, :] - shared)
    near = np.zeros((len(sizes), len(sizes)), dtype=bool)
    near[np.ix_(one, two)] = close
    return _forest(near | near.T)


def crowd_links(crowd: DataFrame, roots: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """(a, b): links that join all similar sets of each shingle in ``crowd`` (token, node, n) that ``roots`` leave apart.

    The rows of a shingle lie in tiles in the order of their components; every two tiles are compared whole in a task
    of their own, but for those that hold one component alone.
    """
    token = Window.partitionBy("token")
    rows = crowd.join(roots.hint("merge"), "node", "left").select("token", "node", "n", F.coalesce("root", "node").alias("root"))
    rows = rows.withColumn("mixed", F.min("root").over(token) != F.max("root").over(token)).filter("mixed")
    weight = F.greatest(F.col("n").cast("bigint"), F.lit(TILE_SHINGLES // TILE))
    before = F.sum(weight).over(token.orderBy("root", "node").rowsBetween(Window.unboundedPreceding, 0)) - weight
    tiles = written(rows.select("token", "node", "root", F.floor(before / TILE_SHINGLES).alias("tile")), "tiles")
    ends = tiles.groupBy("token", "tile").agg(F.min("root").alias("low"), F.max("root").alias("high"))
    one = ends.select("token", F.col("tile").alias("i"), F.col("low").alias("li"), F.col("high").alias("hi"))
    two = ends.select("token", F.col("tile").alias("j"), F.col("low").alias("lj"), F.col("high").alias("hj"))
    couples = one.join(two.hint("merge"), "token").filter("i <= j and not (li = hi and lj = hj and li = lj)")
    couples = couples.select("token", "i", "j", F.explode(F.array_distinct(F.array("i", "j"))).alias("tile"))
    dealt = tiles.select("token", "tile", "node").join(couples.hint("merge"), ["token", "tile"]).join(
        sets.select("node", "grams").hint("merge"), "node"
    )

    def compare(rows: pa.Table) -> pa.Table:
        grams = rows.column("grams").combine_chunks()
        sizes = grams.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        left = rows.column("tile").to_numpy() == rows.column("i").to_numpy()
        links = similar_sets(sizes, grams.flatten().to_numpy(zero_copy_only=False), left, similarity)
        nodes = rows.column("node").to_numpy()
        ends = np.array(links, dtype=np.int64).reshape(-1, 2)
        return pa.table({"a": nodes[ends[:, 0]], "b": nodes[ends[:, 1]]})

    ship(crowd.sparkSession)
    return dealt.groupBy("token", "i", "j").applyInArrow(compare, "a bigint, b bigint")


def print_links(nodes: DataFrame) -> DataFrame:
    """(a, b), a < b: links that join all ``nodes`` (node, fp) whose fingerprints reach each other within the radius."""
    leads = written(nodes.groupBy("fp").agg(F.min("node").alias("lead")), "leads")
    alike_ = nodes.select("node", "fp").join(leads.hint("merge"), "fp").filter("node <> lead")
    side = lambda name: leads.select(F.col("fp").alias(name), F.col("lead").alias(f"l{name}")).hint("merge")
    near = ball_links(leads.select("fp")).join(side("a"), "a").join(side("b"), "b")
    return alike_.select(F.col("lead").alias("a"), F.col("node").alias("b")).union(near.select(F.least("la", "lb"), F.greatest("la", "lb")))


def similar_classes(prints: DataFrame, texts: DataFrame, first: Column, similarity: float) -> DataFrame:
    """(node, first): the least ``first`` of each component of texts at least so similar.

    ``prints`` holds (node, fp, n, bits, prefix) for every row of ``texts`` (k, d, _text); ``first`` ends with
    the fields k and d of a row.  Nodes are distinct up to case and white space.
    """
    nodes = written(
        prints.groupBy("node").agg(
            F.min(first).alias("first"), *(F.first(c).alias(c) for c in ("fp", "n", "bits", "prefix"))
        ),
        "nodes",
    )
    token = Window.partitionBy("token")
    # Another centre for each shingle, so that one text unlike the others does not lead all groups.
    centre = F.min(F.struct(F.xxhash64("node", "token").alias("h"), "node")).over(token)["node"]
    held = nodes.select("node", "n", F.posexplode("prefix").alias("at", "token"))
    held = held.select("*", F.count("*").over(token).alias("held"), centre.alias("centre")).filter("held > 1")
    held = written(held, "held")
    crowd = held.filter(F.col("held") > FEW).select("token", "node", "n")
    pairs = written(candidates(held, nodes.select("node", "n", "bits"), similarity, print_links(nodes)), "pairs")
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("node")).union(crowd.select("node")).distinct()
    wanted = wanted.join(nodes.select("node", "first").hint("merge"), "node")
    wanted = written(wanted.select("node", F.col("first.k").alias("wk"), F.col("first.d").alias("wd")), "wanted")
    found = texts.join(wanted.hint("merge"), texts["k"].eqNullSafe(wanted["wk"]) & (texts["d"] == wanted["wd"]))
    found = found.groupBy("node").agg(F.first("_text").alias("_text"))
    sets = written(
        map_texts(found, "node", "_text", compared, "grams array<bigint>, small array<bigint>"), "sets"
    )
    links = written(alike(pairs, sets, similarity), "links")
    roots = components(links)
    rest = written(crowd_links(crowd, roots, sets, similarity), "rest")
    if not rest.isEmpty():
        roots = components(links.union(rest))
    named = written(
        nodes.select("node", "first").join(roots.hint("merge"), "node", "left").select(
            "node", "first", F.coalesce("root", "node").alias("root")
        ),
        "named",
    )
    least = written(named.groupBy("root").agg(F.min("first").alias("least")), "least")
    return written(named.join(least, "root").select("node", F.col("least").alias("first")), "classes")


def simhash_classes(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, fingerprint, component_id) for every row of ``docs``.

    Texts without words share the fingerprint zero and are linked like any others.  Repeated rows
    and ties come out as often as they go in; a null key keeps its row and never names a
    component that has another key; other columns are not read; an empty table gives an empty
    result.
    """
    prints = written(fingerprints(docs, key, text), "fingerprints")
    classes = near_classes(prints, F.col(key)).withColumnRenamed("first", "component_id")
    return prints.join(classes, "fp").select(key, hex16("fp").alias("fingerprint"), "component_id")


def keep_one(
    docs: DataFrame, key: str = "doc_id", text: str = "text", similarity: float | None = None
) -> DataFrame:
    """``docs`` with one row of each component: that of the least key, then the least text digest.

    Components are those of :func:`simhash_classes`, or with ``similarity`` those of texts whose
    five-word shingles have at least this Jaccard similarity, all of them, within the radius or not.
    Of rows alike in key and text one stays; null keys come last; all columns stay.
    """
    digest = F.xxhash64(F.coalesce(F.col(text), F.lit("")))
    # The digest is taken beside the fingerprint, so that the text is read once.
    wide = similarity is not None
    if wide:
        counts = docs.sparkSession.sparkContext.broadcast(shingle_counts(docs, text))
        one = lambda value: prefix_print(value, counts.value, similarity)
        schema = "node bigint, fp bigint, n int, bits array<bigint>, prefix array<bigint>"
    else:
        one, schema = (lambda value: (fingerprint(value),), "fp bigint")
    narrow = docs.select(F.struct(F.col(key).alias("k"), digest.alias("d")).alias("_row"), F.col(text).alias("_text"))
    # Read once, by the grouping that follows.
    prints = map_texts(narrow.select(F.to_json("_row").alias("_id"), "_text"), "_id", "_text", one, schema)
    kind = docs.schema[key].dataType.simpleString()
    row = F.from_json("_id", f"k {kind}, d bigint")
    order = F.struct(row["k"].isNull().alias("n"), row["k"].alias("k"), row["d"].alias("d"))
    texts = narrow.select("_row.k", "_row.d", F.coalesce("_text", F.lit("")).alias("_text"))
    classes = similar_classes(prints, texts, order, similarity) if wide else near_classes(prints, order)
    keepers = classes.select(
        F.col("first.k").alias("_llm_key"), F.col("first.d").alias("_llm_digest")
    ).distinct()
    marked = docs.withColumn("_llm_own", digest)
    joined = marked.join(
        keepers.hint("merge"), marked[key].eqNullSafe(F.col("_llm_key")) & (F.col("_llm_own") == F.col("_llm_digest"))
    )
    once = Window.partitionBy("_llm_key", "_llm_digest").orderBy(F.lit(0))
    return (
        joined.withColumn("_llm_nth", F.row_number().over(once))
        .filter("_llm_nth = 1")
        .select(*(F.col(f"`{c}`") for c in docs.columns))
    )


def op8_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return simhash_classes(table(spark, folder, "documents"))
