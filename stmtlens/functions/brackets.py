"""Neighbours, brackets and statements of token lists, for many files at a time.

Spark lexes the texts and spreads the files; a task gets the tokens of some files as one Arrow
array, and every step here is a running sum, maximum or shift over all of them, so neither the
tokens nor the files are walked one by one and nothing is sorted but a few integers.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle

# Ship the functions themselves to the executors: they need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Tokens that a task works on at a time, and rows it hands over; a larger file makes a batch of its own.
_TOKENS, _ROWS = 1 << 17, 1 << 14


def kind_of(token: str) -> str:
    first = token[0]
    if first in "\"'" and len(token) > 1:
        return "literal"
    if "a" <= first <= "z" or "A" <= first <= "Z" or first in "_$":
        return "name"
    return "number" if "0" <= first <= "9" else "symbol"


class _Groups:
    """Rows that lie together: where the group of each row begins, and shifts that stay inside it."""

    def __init__(self, begins: np.ndarray):
        self.rows = np.arange(len(begins))
        self.first = np.maximum.accumulate(np.where(begins, self.rows, 0))
        after = np.append(self.rows[1:][begins[1:]], len(begins))
        self.end = after[np.cumsum(begins) - 1] if len(begins) else self.rows

    def back(self, n: int) -> np.ndarray:
        """The row ``n`` above, -1 outside the group."""
        return np.where(self.rows - n >= self.first, self.rows - n, -1)

    def ahead(self, n: int) -> np.ndarray:
        return np.where(self.rows + n < self.end, self.rows + n, -1)

    def last(self, at: np.ndarray, upto: int = 0) -> np.ndarray:
        """The last marked row that is ``upto`` or more rows above, -1 if there is none."""
        found = np.maximum.accumulate(np.where(at, self.rows, -1))
        if upto:
            found = np.concatenate([np.full(upto, -1), found])[: len(at)]
        return np.where(found >= self.first, found, -1)

    def next(self, at: np.ndarray) -> np.ndarray:
        """The first marked row from here on, -1 if there is none."""
        found = np.minimum.accumulate(np.where(at, self.rows, len(at))[::-1])[::-1]
        return np.where(found < self.end, found, -1)

    def total(self, values: np.ndarray) -> np.ndarray:
        """Running sum with the row itself."""
        summed = np.cumsum(values)
        return summed - (summed - values)[self.first]

    def whole(self, at: np.ndarray) -> np.ndarray:
        """How many rows of the group are marked."""
        summed = np.append(0, np.cumsum(at))
        return summed[self.end] - summed[self.first]


def _taken(values: pa.Array, rows: np.ndarray) -> pa.Array:
    return values.take(pa.array(rows, mask=rows < 0))


def _struct(rows: np.ndarray, **fields: pa.Array) -> pa.Array:
    """One struct for each row, of the fields at ``rows``; null where that is -1."""
    return pa.StructArray.from_arrays(
        [_taken(f, rows) for f in fields.values()], list(fields), mask=pa.array(rows < 0)
    )


class _Words:
    """The tokens by number, with answers worked out once for each different token."""

    def __init__(self, tokens: pa.Array):
        coded = tokens.dictionary_encode()
        self.codes, self.words = coded.indices.to_numpy(), coded.dictionary
        self.known = self.words.to_pylist()
        self.kinds = np.array([kind_of(w) if w else "" for w in self.known], dtype=object)

    def among(self, *words: str) -> np.ndarray:
        wanted = frozenset(words)
        return np.array([w in wanted for w in self.known], dtype=bool)[self.codes]

    def kept(self, rows: np.ndarray) -> _Words:
        other = object.__new__(_Words)
        other.codes, other.words, other.known, other.kinds = self.codes[rows], self.words, self.known, self.kinds
        return other

    def is_kind(self, kind: str) -> np.ndarray:
        return (self.kinds == kind)[self.codes]

    def texts(self) -> pa.Array:
        return self.words.take(pa.array(self.codes))

    def kind_texts(self) -> pa.Array:
        return pa.array(self.kinds, pa.string()).take(pa.array(self.codes))


def _without_trivia(pieces: pa.Array, trivia: re.Pattern) -> pa.Array:
    """The tokens of the pieces; few pieces begin with a comment, so only those meet the pattern."""
    bare = pc.ascii_ltrim(pieces, " \t\n\x0b\f\r")
    noted = pc.or_(pc.starts_with(bare, "//"), pc.starts_with(bare, "/*"))
    if not pc.any(noted).as_py():
        return bare
    return pc.replace_with_mask(bare, noted, pa.array([trivia.sub("", t, count=1) for t in bare.filter(noted).to_pylist()], bare.type))


def _tokens(file: np.ndarray, pieces: pa.Array, trivia: re.Pattern, literals: bool):
    """File of each token, the tokens, and their columns in order."""
    tokens = _without_trivia(pieces, trivia)
    words = _Words(tokens)
    length = pc.utf8_length(tokens).to_numpy().astype(np.int64)
    inner = pc.count_substring(tokens, "\n").to_numpy().astype(np.int64)
    files = _Groups(np.append(True, file[1:] != file[:-1]))
    end = files.total(pc.utf8_length(pieces).to_numpy().astype(np.int64))
    line = 1 + files.total(pc.count_substring(pieces, "\n").to_numpy().astype(np.int64)) - inner
    keep = length > 0
    if not literals:
        keep &= ~words.is_kind("literal")
    keep = np.flatnonzero(keep)
    words, file, end, line, length = words.kept(keep), file[keep], end[keep], line[keep], length[keep]
    files = _Groups(np.append(True, file[1:] != file[:-1])[: len(file)])
    off = end - length
    opens, closes = words.among("(", "[", "{").astype(np.int64), words.among(")", "]", "}").astype(np.int64)
    curly = words.among("{").astype(np.int64)
    before = files.back(1)
    starts_line = (before < 0) | (line[before] < line)
    fresh = starts_line & (before >= 0)
    tok, kind = words.texts(), words.kind_texts()
    whole = lambda values: pa.array(values, pa.int64())
    above = files.last(fresh)
    columns = {
        "pos": pa.array(files.rows - files.first + 1, pa.int32()), "off": whole(off), "end": whole(end),
        "line": pa.array(line, pa.int32()), "tok": tok, "kind": kind,
        "depth": whole(files.total(opens - closes) - opens), "braces": whole(files.total(curly - words.among("}")) - curly),
        "p1": lambda: _taken(tok, before), "p1kind": lambda: _taken(kind, before),
        "p2": lambda: _taken(tok, files.back(2)), "p2kind": lambda: _taken(kind, files.back(2)),
        "n1": lambda: _taken(tok, files.ahead(1)), "n1kind": lambda: _taken(kind, files.ahead(1)),
        "n2": lambda: _taken(tok, files.ahead(2)),
        # line of the last `;`, `{` or `}` before this token
        "break_line": lambda: _taken(pa.array(line, pa.int32()), files.last(words.among(";", "{", "}"), 1)),
        # first token of this line, and end of the last token on a line above
        "line_first_off": lambda: _taken(whole(off), files.last(starts_line)),
        "above_end": lambda: _taken(whole(end), np.where(above < 0, -1, before[above])),
    }
    return file, words, columns


def _levels(
    file: np.ndarray, words: _Words, tokens: dict, no_types: tuple[str, ...], heads: tuple[str, ...], read: dict | None, repeats: np.ndarray
):
    """``file`` and columns of the tokens by bracket level, all or those that are ``read``; rows name the token they stand for."""
    depth = tokens["depth"].to_numpy()
    bracket = words.among("(", ")", "[", "]", "{", "}")
    row = np.repeat(np.arange(len(file)), 1 + bracket)
    delim = np.append(False, row[1:] == row[:-1])[: len(row)]
    level = depth[row] + delim
    # Rows come by file and position; a stable sort by file and level keeps the positions in order.
    low, span = level.min(initial=0), np.ptp(level) + 1 if len(level) else 1
    order = np.argsort(file[row] * span + (level - low), kind="stable")
    row, delim, level = row[order], delim[order], level[order]
    file, words = file[row], words.kept(row)
    turns = np.append(True, (file[1:] != file[:-1]) | (level[1:] != level[:-1]))[: len(row)]
    groups = _Groups(turns)
    col = {name: tokens[name].take(pa.array(row)) for name in ("pos", "off", "end", "line", "tok", "kind")}
    number = lambda name: col[name].to_numpy()
    whole = lambda values: pa.array(values, pa.int64())
    breaks = words.among(";", "{", "}")
    ends = delim | breaks
    opener = groups.last(delim & words.among("(", "[", "{"))
    seg = groups.total(ends.astype(np.int64)) - ends
    segments = _Groups(turns | np.append(True, seg[1:] != seg[:-1])[: len(row)])
    less = words.among("<").astype(np.int64)
    angle = segments.total(less - words.among(">")) - less
    comma = words.among(",") & (angle == 0)
    part = segments.total(comma.astype(np.int64)) - comma
    parts = _Groups((segments.first == segments.rows) | np.append(True, part[1:] != part[:-1])[: len(row)])
    term, ahead = segments.end - 1, groups.ahead(1)
    p1 = tokens["p1"]().take(pa.array(row))
    # A fragment goes on to `=`, `:`, a break or a bracket of its own; two names, the last one at its end, declare one.
    split = words.among("=", ":") & (angle == 0)
    live = ~delim & ~breaks & ~comma & (parts.total(split | ends) == 0)
    off_types = words.among(*no_types)
    is_name = words.is_kind("name")
    marked = pc.fill_null(pc.equal(p1, "@"), False).to_numpy(zero_copy_only=False)
    dotted = pc.fill_null(pc.equal(tokens["n1"](), "."), False).to_numpy(zero_copy_only=False)[row]
    name = live & is_name & (angle == 0) & ~off_types & ~marked & ~dotted
    odd = live & ~is_name & ~words.among("[", "]", ".", "<", ">", "@", "(", ")", ",", "?", "&")
    # The live rows of a part lie together, so the last one is that which no live row follows.
    follows = parts.ahead(1)
    last_live = live & ~((follows >= 0) & live[follows])
    declares = (parts.whole(name) == 2) & (parts.whole(odd) == 0) & (parts.whole(name & last_live) == 1)
    opens = words.among("{")[term] & ~delim[term] & (ahead[term] >= 0)
    head = opens & (segments.whole(is_name & words.among(*heads)) > 0)
    at = np.arange(len(row))
    # Which rows name what is around them: all, or those where the facts read it.
    called = near = framed = declared = np.ones(len(row), dtype=bool)
    # What follows a bracket's partner, or comes before the bracket, is read where the bracket itself stands, a level above.
    stands = np.zeros(len(col["tok"]) and row.max() + 1, dtype=np.int64)
    stands[row[~delim]] = np.flatnonzero(~delim)
    if read is not None and "inside" in read:
        named = words.among(*read["inside"])
        owner = groups.back(1)[stands[row[opener]]]
        at = np.flatnonzero(~delim & (named | (opener >= 0) & words.among("(")[opener] & (owner >= 0) & named[owner]))
    elif read is not None:
        calls = is_name & (ahead >= 0) & words.among("(")[ahead]
        inside = (opener >= 0) & words.among("(")[opener] & (angle == 0)
        after = groups.ahead(2)[stands[row[opener]]]
        parameters = inside & (after >= 0) & words.among("->")[after]
        looped = inside & words.among(":") | parameters & is_name & ~off_types & repeats[file] | words.among("->")
        marks = is_name & words.among(*read["words"])
        at = np.flatnonzero(~delim & (calls | head & is_name | looped | marks | declares & (name | split)))
        called, framed, declared = calls, words.among("for", "while", "do", "->"), declares
        near = calls | marks | framed
    off, end, pos, tok, kind, line = (col[n] for n in ("off", "end", "pos", "tok", "kind", "line"))
    kept = lambda rows, where: np.where(where, rows, -1)[at]
    # What is read of calls alone, and is made for these alone.
    aside = ("p2", "p2kind", "n2", "break_line", "line_first_off", "above_end")
    columns = {name: lambda values=values: values.take(pa.array(at)) for name, values in (col | {"p1": p1}).items()} | {
        name: lambda name=name: _taken(tokens[name](), kept(row, called)) for name in aside
    } | {
        "level": whole(level[at]), "delim": pa.array(delim[at]), "seg": whole(seg[at]), "angle": whole(angle[at]), "part": whole(part[at]),
        "block": lambda: _taken(pos, opener[at]), "block_tok": lambda: _taken(tok, opener[at]),
        "l1": lambda: _struct(kept(ahead, near), tok=tok, off=off, end=end, pos=pos, line=line),
        "l2": lambda: _struct(kept(groups.ahead(2), near), tok=tok, off=off, end=end),
        "l3": lambda: _struct(kept(groups.ahead(3), near), tok=tok, off=off, line=line),
        "l4": lambda: _struct(kept(groups.ahead(4), framed), off=off),
        "start": lambda: _struct(kept(segments.first, declared), off=off, line=line, p1=p1),
        "b1": lambda: _struct(kept(groups.back(1), framed), tok=tok, kind=kind, pos=pos, start_tok=_taken(tok, segments.first)),
        "b2": lambda: _struct(kept(groups.back(2), framed), tok=tok, pos=pos), "b3": lambda: _struct(kept(groups.back(3), framed), tok=tok),
        "term": lambda: _struct(term[at], pos=pos, tok=tok, off=off, delim=pa.array(delim), next_off=_taken(off, ahead)),
        "semi_end": lambda: _taken(end, kept(groups.next(words.among(";")), framed)),
        "part_end": lambda: _taken(off, kept(parts.end - 1, framed)), "live": pa.array(live[at]), "declares": pa.array(declares[at]),
        "head": pa.array(head[at]),
    }
    return file[at], row[at], columns


def _spans(lists: pa.Array) -> Iterator[tuple[int, int]]:
    """Ranges of lists that hold about ``_TOKENS`` elements together."""
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy()
    at, held = 0, 0
    for n, size in enumerate(sizes):
        if held and held + size > _TOKENS:
            yield at, n
            at, held = n, 0
        held += size
    if held:
        yield at, len(sizes)


def structure(schema: pa.Schema, keys: tuple[str, ...], trivia: str, levels: bool, literals: bool, no_types: tuple[str, ...],
              heads: tuple[str, ...], read: dict[str, tuple[str, ...]] | None = None):
    """A function for ``mapInArrow`` over rows of ``keys`` and ``pieces``: the columns of ``schema``.

    ``trivia`` is the pattern of what comes before a piece's token; a statement that opens a block and holds one of ``heads``
    is a head.  With ``read`` only those rows of the levels are made that the facts read: calls, loops, arrows and their
    parameters, declarations, names of heads, and its ``words``; tokens around a row are null where no fact reads them.
    With names ``inside`` only these and what stands in parentheses right after them.
    """

    def run(batches):
        leading = re.compile(rf"\A{trivia}*+", re.ASCII)
        for batch in batches:
            lists = batch.column("pieces")
            for lo, hi in _spans(lists):
                some = batch.slice(lo, hi - lo)
                pieces = some.column("pieces")
                file = pc.list_parent_indices(pieces).to_numpy().astype(np.int64)
                file, words, columns = _tokens(file, pieces.flatten(), leading, literals)
                if not len(file):
                    continue
                row = None
                if levels:
                    tokens = columns
                    repeats = pc.fill_null(some.column("repeats"), False).to_numpy(zero_copy_only=False) if read else None
                    file, row, columns = _levels(file, words, tokens, no_types, heads, read, repeats)
                of = pa.array(file)

                def column(name):
                    if name in keys:
                        return some.column(name).take(of)
                    if name in columns:
                        made = columns[name]
                        return made() if callable(made) else made
                    made = tokens[name]
                    return (made() if callable(made) else made).take(pa.array(row))

                made = pa.RecordBatch.from_arrays(
                    [column(f.name).cast(f.type) for f in schema], schema=schema
                )
                for at in range(0, made.num_rows, _ROWS):
                    yield made.slice(at, _ROWS)

    return run
