"""Operators on single texts: against the libraries and plain Python."""

import hashlib
import random
import re

import public_tokenizers
import sentencepiece
from conftest_llm import rows_of

from stmtlens.llm import byte_bpe, pii, quality, token_counts

MODEL = public_tokenizers.path(token_counts.MODEL)
ALPHABET = "  aab the\n▁é①漢字\t's <s>0 1ing.\x00　\r\n'll  "


def random_texts(n, size, seed):
    pick = random.Random(seed)
    return ["".join(pick.choice(ALPHABET) for _ in range(pick.randint(0, size))) for _ in range(n)]


def test_transducer_counts_like_the_library(monkeypatch):
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    machine = token_counts.Transducer(MODEL)
    texts = random_texts(800, 60, 1) + ["a" * 20000, " " * 5000 + "x", "the" * 3000]
    want = [len(library.encode(t)) for t in texts]
    assert [machine.count(t) for t in texts] == want
    monkeypatch.setattr(token_counts, "CHUNK", 7)  # many chunks, same counts
    assert [machine.count(t) for t in texts] == want


def test_chunk_maps_compose_associatively():
    machine = token_counts.Transducer(MODEL)
    maps = [machine.chunk_map(x) for x in ("the ca", "t sat", "on", " the\nmat ", " and")]
    left = maps[0]
    for m in maps[1:]:
        left = machine.compose(left, m)
    right = maps[-1]
    for m in reversed(maps[:-1]):
        right = machine.compose(m, right)
    assert left == right


def test_token_counts_odd_rows(spark, odd):
    got = rows_of(token_counts.token_counts(odd, limit=3))
    assert len(got) == odd.count()
    assert (2, 0, 0, False) in got and (4, 3, 1, False) in got
    assert rows_of(token_counts.token_counts(odd.limit(0))) == []


def test_bpe_cuts_are_safe_and_round_trip():
    made = byte_bpe.encoder(public_tokenizers.path(byte_bpe.RANKS), public_tokenizers.PATTERN)
    for text in random_texts(800, 80, 2):
        ids = made.encode(text, 5)
        assert ids == made.library.encode_ordinary(text)
        assert made.decode(ids) == text.encode()
    for text in (" " * 300_000 + "a", "x" + "\n" * 200_000, "a" * 200_000):
        assert made.decode(made.encode(text)) == text.encode()


def test_bpe_long_white_space_is_a_part_of_its_own():
    made = byte_bpe.encoder(public_tokenizers.path(byte_bpe.RANKS), public_tokenizers.PATTERN)
    for space in " \n":
        run = space * 1_000_100
        for text in ("w" + run, "one two" + run + "word", run + "w", "a1" + run + "," + run):
            ids = made.encode(text)
            assert made.decode(ids) == text.encode()
    # Where the library bears the run, the ids are its own.
    for text in (a + s * 70_000 + b for a in ("", "w", "a, ", "1") for s in " \n\t\u3000" for b in ("", "w", "1x", "!", "\x1c.")):
        assert made.encode(text) == made.library.encode_ordinary(text)


def test_bpe_odd_rows(odd):
    got = rows_of(byte_bpe.bpe_digest(odd))
    empty = hashlib.sha256(b"").hexdigest()
    assert (2, 0, empty, empty) in got and len(got) == odd.count()
    listed = {r["doc_id"]: r["ids"] for r in byte_bpe.bpe_encode(odd).collect()}
    assert listed[2] == [] and len(listed[4]) >= 1


def slow_repeats(words):
    seen, marked = {}, set()
    for i in range(len(words) - 2):
        seen.setdefault(tuple(words[i : i + 3]), []).append(i)
    for places in seen.values():
        if len(places) > 1:
            marked.update(p + k for p in places for k in range(3))
    return len(marked)


def test_quality_counts_against_plain_python():
    pick = random.Random(3)
    for _ in range(300):
        text = "".join(pick.choice(["a ", "b ", "c\n", "#", "d\t", "\n", "é ", "a b c "]) for _ in range(pick.randint(0, 90)))
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        got = quality.judge(text)
        assert got[:3] == (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)))
        assert got[3] == len(lines) - len(set(lines))
        assert got[4] == slow_repeats(words)
        assert got[5] == (len(words) < 50 or 100 * got[4] > 50 * len(words))


def test_quality_keeps_prose_and_drops_furniture(odd):
    pick = random.Random(9)
    words = ["".join(pick.choice("abcdefgh") for _ in range(5)) for _ in range(300)]
    prose = "\n".join(" ".join(pick.sample(words, 8)).capitalize() + "." for _ in range(12))
    assert quality.judge(prose)[6]
    menu = "\n".join(f"Home{i} | About{i} | Contact{i} | Imprint{i} | Jobs{i} | News{i}" for i in range(12))
    assert not quality.judge(menu)[6]
    kept = quality.judge(prose + "\nHome | About | Contact\nAll rights reserved.")
    assert kept[6] and kept[-1] == prose
    assert len(rows_of(quality.quality(odd))) == odd.count()
    assert quality.clean_documents(odd).columns == odd.columns


def test_quality_boilerplate_is_words_and_most_of_a_line():
    fault = lambda line: quality.line_fault(line, line.split())
    for line in ("They teach design in the old town hall.", "We repaint every sign interiors people ask for.",
                 "The news was spread more widely than before.", "It stays fresh because cookies were baked today.",
                 "Visitors had to sign in at the desk before the morning session began."):
        assert fault(line) is None
    for line in ("All rights reserved.", "Please sign in to continue.", "Click here to read more about us.", "Zur Datenschutzerklärung.",
                 "We use cookies to improve your experience.", "This work is licensed under the GNU General Public License, version 3."):
        assert fault(line) == "boilerplate"


KINDS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def base_spans(text):
    out = []
    for kind, pattern in KINDS.items():
        for m in re.finditer(pattern, text or ""):
            digits = [int(c) for c in re.sub("[^0-9]", "", m[0])]
            doubled = [d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(reversed(digits))]
            if kind == "ip" and any(int(x) > 255 for x in m[0].split(".")):
                continue
            if kind == "card" and not (16 <= len(digits) <= 19 and sum(doubled) % 10 == 0):
                continue
            if kind == "phone" and not 8 <= len(digits) <= 15:
                continue
            out.append((kind, m.start(), m.end()))
    return out


def test_pii_base_against_plain_python(spark):
    pick = random.Random(4)
    parts = ["a", "b@", "@", ".", "com", "1", "255", "256", " ", "-", "+", "(", "4111 1111 1111 1111", "+1 (743) 555-3824",
             "é", "😀", "x@y.org", "_", "1.2.3.4", "\n", "(743) 555-3824", "Dr. Anna Schmidt ", "joe [at] web.de "]
    rows = [(i, "".join(pick.choice(parts) for _ in range(pick.randint(0, 40)))) for i in range(400)]
    rows += [(900, None), (900, None), (None, "x@y.org"), (901, "a@b.co " * 300), (902, "x@" + "a." * 20000 + "b")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id bigint, text string, k int")
    got = pii.pii_spans(df).collect()

    def digest(text):
        return hashlib.sha256(",".join("%s:%d:%d" % s for s in base_spans(text)).encode()).hexdigest()

    def order(rows):
        return sorted(rows, key=repr)

    assert order((r[0], *r[1:6]) for r in got) == order(
        (i, *(sum(s[0] == k for s in base_spans(t)) for k in KINDS), digest(t)) for i, t in rows
    )
    texts = dict(rows)
    for r in got:
        for kind, start, end in base_spans(texts[r["doc_id"]]):
            assert f"{kind}:{start}:{end}" in r["spans"].split(",")
    clean = {r["doc_id"]: r["text"] for r in pii.redact(df).collect()}
    assert clean[901].split() == ["[EMAIL]"] * 300 and clean[900] is None
    assert pii.pii_spans(df.limit(0)).count() == 0


def test_pii_classifier_learns_from_votes(spark):
    rows = [(i, f"please call {200 + i % 700} 555-{1000 + i} today") for i in range(200)]
    rows += [(1000 + i, f"order serial invoice 0{i % 90 + 10} 555-{1000 + i}") for i in range(200)]
    got = {r["doc_id"]: r["spans"] for r in pii.pii_spans(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert sum(bool(got[i]) for i in range(200)) > 180
    assert sum(bool(got[1000 + i]) for i in range(200)) < 20
