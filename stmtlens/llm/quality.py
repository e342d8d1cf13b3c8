"""Line-first cleaning: judge and drop lines, then reject documents that lose too much text."""

from __future__ import annotations

import re
from collections import Counter

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stmtlens.llm.common import WORD, map_texts, parts, ship, table

#: Marks between the entries of a menu or a trail.
_MENU = re.compile(r"\s[|»›•·>/]+(?:\s|$)")
_SYMBOL = re.compile(r"[#*$%&|<>]")
_WORD = re.compile(WORD)
_END = tuple(".!?…:;\"'”’»)]。！？」』。।؟")
#: Phrases of page furniture; a line is short and they are a good part of its words, or it stays.
BOILERPLATE = (
    "all rights reserved", "terms of use", "terms of service", "privacy policy", "cookie policy",
    "accept cookies", "use cookies", "enable javascript", "javascript is disabled", "sign in",
    "log in to", "subscribe to our", "click here", "read more", "share this", "back to top",
    "skip to content", "powered by", "tous droits réservés", "politique de confidentialité",
    "alle rechte vorbehalten", "datenschutz", "impressum", "todos los derechos reservados",
    "política de privacidad", "lorem ipsum", "licensed under", "permission is hereby granted",
    "datenschutzerklärung", "datenschutzhinweise", "datenschutzbestimmungen", "this work is licensed under",
    "general public license", "apache license", "creative commons",
)
#: Longer phrases first, as one may begin another.
_BOILERPLATE = re.compile(rf"\b(?:{'|'.join(map(re.escape, sorted(BOILERPLATE, key=len, reverse=True)))})\b")
#: The least share of a line's words that lie in such phrases.
FURNITURE = 0.25
#: A document that loses more than this share of the characters in its words is rejected.
MAX_LOST = 0.5


def line_fault(line: str, words: list[str]) -> str | None:
    """Which rule a line with these words fails: symbols, navigation, boilerplate, punctuation or none."""
    chars = sum(map(len, words))
    if not any(c.isalnum() for c in line) or len(_SYMBOL.findall(line)) * 4 > chars:
        return "symbols"
    marks = len(_MENU.findall(line))
    if marks >= 2 and len(words) <= 5 * (marks + 1):
        return "navigation"
    if len(words) <= 30 and sum(len(x.split()) for x in _BOILERPLATE.findall(line.lower())) >= FURNITURE * len(words):
        return "boilerplate"
    if len(words) < 4 and not line.rstrip().endswith(_END):
        return "punctuation"
    return None


def repeated_words(words: list[str]) -> int:
    """Words inside three-word windows that the text holds twice or more."""
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) == len(windows):
        return 0
    often = {w for w, n in Counter(windows).items() if n > 1}
    total = end = 0
    for i, w in enumerate(windows):
        if w in often:
            total += i + 3 - max(i, end)
            end = i + 3
    return total


def judge(text: str) -> tuple:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, n_lines_removed,
    lost_chars, cleaned text)"""
    words = _WORD.findall(text)
    n, chars = len(words), sum(map(len, words))
    seen, repeated, lost, removed, left = set(), 0, 0, 0, []
    for line in text.split("\n"):
        own = _WORD.findall(line)
        if own:
            if line in seen:
                repeated += 1
            seen.add(line)
            if line_fault(line, own):
                removed += 1
                lost += sum(map(len, own))
                continue
        left.append(line)
    again = repeated_words(words)
    failed = n < 50 or 100 * again > 50 * n
    kept = not failed and lost <= MAX_LOST * chars
    return n, chars, len(_SYMBOL.findall(text)), repeated, again, failed, kept, removed, lost, "\n".join(left)


_SCHEMA = (
    "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, "
    "base_failed boolean, kept boolean, n_lines_removed bigint, lost_chars bigint"
)


def quality(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document with the base counts, the verdict and what line cleaning took.

    A null or empty text has no words and fails; a line without a word is never judged; repeated
    rows and null keys give a row each; other columns are not read; an empty table gives an
    empty result.  Ties: a document that loses exactly ``MAX_LOST`` is kept.
    """
    return map_texts(docs, key, text, lambda value: judge(value)[:-1], _SCHEMA)


def clean_documents(docs: DataFrame, text: str = "text") -> DataFrame:
    """The kept documents with their failing lines removed; all columns of ``docs`` stay.

    ``n_chars`` (where there is one) follows the new text.  Rows stand alone: repeated rows and
    null keys stay as they are; rows with a null text go, as they have no words.
    """
    import pyarrow as pa

    ship(docs.sparkSession)
    names = docs.columns
    at = names.index(text)

    def run(batches):
        for batch in parts(batches):
            made = [judge(t or "") for t in batch.column(at).to_pylist()]
            keep = pa.array([m[6] for m in made], type=pa.bool_())
            fresh = pa.array([m[-1] for m in made], type=batch.schema.field(at).type)
            yield batch.set_column(at, batch.schema.field(at), fresh).filter(keep)

    cleaned = docs.mapInArrow(run, docs.schema)
    return with_length(cleaned, text)


def with_length(docs: DataFrame, text: str = "text") -> DataFrame:
    """``n_chars`` set to the length of the text, if the table has that column."""
    if "n_chars" not in docs.columns:
        return docs
    kind = docs.schema["n_chars"].dataType
    return docs.withColumn("n_chars", F.length(text).cast(kind))


def op5_quality(spark: SparkSession, folder: str) -> DataFrame:
    return quality(table(spark, folder, "documents"))
