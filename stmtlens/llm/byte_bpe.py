"""Byte-level BPE encoding and decoding with the tiktoken library and a local rank file.

Long texts are cut where the split pattern must end a match whatever stands around: between
something and white space after it, before the last white space of a longer run, and between a
letter and a digit.  A very long run of white space is a part of its own, wherever it stands.  The
matches, and so the ids, are those of the whole text, while the library's matcher never meets a text
that outgrows its stack.
"""

from __future__ import annotations

import base64
import hashlib

from pyspark.sql import DataFrame, SparkSession

from stmtlens.llm.common import map_texts, table

RANKS = "byte_bpe_multi_50k.tiktoken"
#: Characters from which a text is cut, and about the length of the parts.
LONG = 1 << 16

_ENCODERS: dict = {}


class Encoder:
    def __init__(self, rank_file: str, pattern: str):
        import regex
        import tiktoken

        with open(rank_file, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.library = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.decimal = [str(i) for i in range(max(ranks.values()) + 1)]
        self.run = regex.compile(r"\s{%d,}+" % LONG)
        #: A safe cut is the place before this match.
        self.cut = regex.compile(r"(?<=\S)\s|(?<=\s)\s(?=\S)|(?<=\p{L})\p{N}|(?<=\p{N})\p{L}")

    def parts(self, text: str, size: int = LONG) -> list[str]:
        """``text`` cut at safe places, each part about ``size`` long where the text allows it."""
        out, at = [], 0
        for run in self.run.finditer(text):
            # Before something, the last white space is no part of the run's match.
            end = run.end() - (run.end() < len(text))
            if run.start() > at:
                out += self._cut(text[at : run.start()], size)
            out.append(text[run.start() : end])
            at = end
        return out + self._cut(text[at:], size) if at < len(text) else out

    def _cut(self, text: str, size: int) -> list[str]:
        """Parts of a text without very long runs; what it was cut from goes on at a safe place."""
        out, at = [], 0
        while len(text) - at > size:
            found = self.cut.search(text, at + size)
            if not found:
                break
            out.append(text[at : found.start()])
            at = found.start()
        return [*out, text[at:]]

    def encode(self, text: str, size: int = LONG) -> list[int]:
        if len(text) <= size:
            return self._plain(text)
        return [i for part in self.parts(text, size) for i in self._plain(part)]

    def _plain(self, part: str) -> list[int]:
        if len(part) > LONG and part.isspace():
            # One match; the library's matcher would not survive it.
            return self.library._encode_single_piece(part)
        return self.library.encode_ordinary(part)

    def decode(self, ids: list[int]) -> bytes:
        """The bytes of the ids; no text decoding, so no replacement characters."""
        return self.library.decode_bytes(ids)


def encoder(rank_file: str, pattern: str) -> Encoder:
    if (rank_file, pattern) not in _ENCODERS:
        _ENCODERS[rank_file, pattern] = Encoder(rank_file, pattern)
    return _ENCODERS[rank_file, pattern]


def _local(ranks: str) -> Encoder:
    import os

    import public_tokenizers

    return encoder(ranks if os.path.isabs(ranks) else public_tokenizers.path(ranks), public_tokenizers.PATTERN)


def bpe_encode(docs: DataFrame, ranks: str = RANKS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids): the ids of every whole text.

    A null or empty text has no ids; repeated rows and null keys give a row each; other columns
    are not read; an empty table gives an empty result.
    """
    from pyspark.sql import functions as F

    def one(value: str) -> tuple:
        return (",".join(_joined(_local(ranks), _local(ranks).encode(value))),)

    made = map_texts(docs, key, text, one, "joined string")
    ids = F.when(F.col("joined") == "", F.array().cast("array<int>")).otherwise(
        F.split("joined", ",").cast("array<int>")
    )
    return made.select(key, ids.alias("ids"))


def _joined(made: Encoder, ids: list[int]) -> list[str]:
    names = made.decimal
    return [names[i] for i in ids]


def bpe_digest(docs: DataFrame, ranks: str = RANKS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256): encode, decode, and digest both in one pass.

    Cases as in :func:`bpe_encode`.
    """

    def one(value: str) -> tuple:
        made = _local(ranks)
        ids = made.encode(value)
        listed = ",".join(_joined(made, ids)).encode()
        return len(ids), hashlib.sha256(listed).hexdigest(), hashlib.sha256(made.decode(ids)).hexdigest()

    return map_texts(docs, key, text, one, "n_tokens bigint, ids_sha256 string, decoded_sha256 string")


def op6_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return bpe_digest(table(spark, folder, "documents"))
