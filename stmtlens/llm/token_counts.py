"""Token counts of a piece vocabulary by a compiled finite-state transducer.

The merges of a piece vocabulary are local: a text is cut into t1 t2 ... tn exactly if every
neighbouring pair (ti, ti+1) cuts that way on its own.  So the last piece of a prefix follows
from the last pieces of a bounded number of shorter prefixes, and a left-to-right machine can
do the work.  Its state holds the longest suffix of the text read that can still grow into a
piece, with the last piece and the relative count at each cut of that suffix.  A transition on
a character is annotated with the number of tokens that it emits (it may be negative: a merge
takes tokens back).  States and transitions are compiled when first met and kept.

Chunks of a text become state maps.  No piece goes on into a space after something else, and
none holds a character outside the vocabulary, so the machine forgets its state there; a
chunk's map is therefore (head, body, exit): the head still to be read in the unknown entry
state, the count after it, and the state at the end.  Maps compose associatively, and the
chunks of one text are combined as a tree of neighbours (a parallel prefix scan).
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stmtlens.llm.common import map_texts, table

MODEL = "piece_bpe_32k.model"
LIMIT = 4096
#: Characters of one chunk of a long text.
CHUNK = 1 << 15
#: Kept transitions and word maps; beyond that they are compiled anew (memory, not results).
KEEP = 500_000

_SPACE = "▁"
#: A stretch between two places at which the machine forgets its state.
_STRETCH = re.compile(r" *[^ \n]+| +|\n")
_UNKNOWN = -1


class Transducer:
    """The machine of one vocabulary file.  ``count`` is all that a caller needs."""

    def __init__(self, model_file: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        self.score = {
            model.id_to_piece(i).replace(_SPACE, " "): model.get_score(i)
            for i in range(model.get_piece_size())
            if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))
        }
        if any(" " in piece.lstrip(" ") or "\n" in piece for piece in self.score):
            raise ValueError("a piece goes on after a space or a line break: words can't be cut apart")
        #: What can still grow into a longer piece.
        self.growing = {piece[:n] for piece in self.score for n in range(len(piece))}
        self.fits: dict[tuple, bool] = {}
        self.states: list[tuple] = []
        self.numbers: dict[tuple, int] = {}
        self.steps: list[dict[str, tuple[int, int]]] = []
        self.words: dict[str, int] = {}
        self.start = 0
        self._reset()

    def _reset(self) -> None:
        self.states, self.numbers, self.steps, self.words = [], {}, [], {}
        self.start = self._number(("", ((None, 0),)))

    def _number(self, state: tuple) -> int:
        if state not in self.numbers:
            self.numbers[state] = len(self.states)
            self.states.append(state)
            self.steps.append({})
        return self.numbers[state]

    def merged(self, text: str) -> list[str]:
        """The pieces of a short text by their definition: best score first, then leftmost."""
        parts, score = list(text), self.score
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if best is None:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def _fit(self, left: str | int | None, right: str) -> bool:
        if left == _UNKNOWN:
            left = None
        known = self.fits.get((left, right))
        if known is None:
            cut = [right] if left is None else [left, right]
            known = self.fits[left, right] = self.merged("".join(cut)) == cut
            if len(self.fits) > 4 * KEEP:
                self.fits.clear()
        return known

    def _compile(self, number: int, char: str) -> tuple[int, int]:
        """The transition on ``char``: (next state, tokens emitted)."""
        suffix, cuts = self.states[number]
        if char not in self.score:
            n = len(char.encode("utf-8", "surrogatepass"))
            step = (self._number(("", ((_UNKNOWN, 0),))), n)
        else:
            text = suffix + char
            for k in range(len(text)):  # the longest piece that ends here and fits what is before
                piece = text[k:]
                if cuts[k] and piece in self.score and self._fit(cuts[k][0], piece):
                    emitted = cuts[k][1] + 1
                    break
            else:
                raise AssertionError(f"no piece ends at {text!r}")
            drop = next(k for k in range(len(text) + 1) if text[k:] in self.growing)
            # Only cuts from which a piece can still grow are part of the state.
            kept = [
                (cuts[k][0], cuts[k][1] - emitted) if cuts[k] and text[k:] in self.growing else None
                for k in range(drop, len(text))
            ]
            step = (self._number((text[drop:], (*kept, (piece, 0)))), emitted)
        self.steps[number][char] = step
        return step

    def run(self, state: tuple, text: str) -> tuple[tuple, int]:
        """Read ``text`` from ``state``: (state after it, tokens emitted)."""
        if len(self.states) > KEEP:
            self._reset()
        steps, at, total = self.steps, self._number(state), 0
        for char in text:
            step = steps[at].get(char) or self._compile(at, char)
            at = step[0]
            total += step[1]
        return self.states[at], total

    def stretch(self, text: str) -> int:
        """Tokens of a stretch read from the start state; words are kept as transitions of their own."""
        n = self.words.get(text)
        if n is None:
            n = self.run(("", ((None, 0),)), text)[1]
            if len(text) <= 48:
                if len(self.words) > KEEP:
                    self.words.clear()
                self.words[text] = n
        return n

    def chunk_map(self, chunk: str) -> tuple[str, int | None, str]:
        """(head, body, tail): the map of one chunk; body None: no forgetting inside.

        The exit state is kept as the tail that leads to it from the start state.
        """
        first = re.search(r"(?<=[^ ]) |\n", chunk)
        if first is None:
            return chunk, None, ""
        parts = _STRETCH.findall(chunk[first.start() :])
        tail = parts.pop()
        words = self.words
        known = [words.get(p) for p in parts]
        body = sum(self.stretch(p) if n is None else n for p, n in zip(parts, known))
        return chunk[: first.start()], body, tail

    def compose(self, a: tuple, b: tuple) -> tuple:
        """The map of two neighbouring chunks.  Associative."""
        if a[1] is None:
            return a[0] + b[0], b[1], b[2]
        if b[1] is None:
            return a[0], a[1], a[2] + b[0]
        middle = sum(map(self.stretch, _STRETCH.findall(a[2] + b[0])))
        return a[0], a[1] + middle + b[1], b[2]

    def count(self, text: str) -> int:
        if not text:
            return 0
        text = " " + text.replace(_SPACE, " ")
        maps = [self.chunk_map(text[i : i + CHUNK]) for i in range(0, len(text), CHUNK)]
        while len(maps) > 1:
            pairs = [self.compose(maps[i], maps[i + 1]) for i in range(0, len(maps) - 1, 2)]
            maps = pairs + maps[len(pairs) * 2 :]
        head, body, tail = maps[0]
        return sum(map(self.stretch, _STRETCH.findall(head))) + (body or 0) + sum(map(self.stretch, _STRETCH.findall(tail)))


_MACHINES: dict[str, Transducer] = {}


def machine(model_file: str) -> Transducer:
    """The compiled machine of this Python worker."""
    if model_file not in _MACHINES:
        _MACHINES[model_file] = Transducer(model_file)
    return _MACHINES[model_file]


def token_counts(
    docs: DataFrame, model: str = MODEL, limit: int = LIMIT, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """(key, n_bytes, n_tokens, over_limit) for every row of ``docs``, whole texts.

    ``model`` names a file of the tokenizer folder or is a path of its own.  A null or empty
    text has no bytes and no tokens; repeated rows and null keys give a row each; other
    columns are not read; an empty table gives an empty result.
    """

    def one(value: str) -> tuple:
        import os

        import public_tokenizers

        made = machine(model if os.path.isabs(model) else public_tokenizers.path(model))
        n = made.count(value)
        return len(value.encode("utf-8", "surrogatepass")), n, n > limit

    return map_texts(docs, key, text, one, "n_bytes bigint, n_tokens bigint, over_limit boolean")


def op4_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return token_counts(docs).select("doc_id", "n_bytes", "n_tokens", F.col("over_limit"))
