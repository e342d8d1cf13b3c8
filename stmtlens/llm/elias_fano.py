"""Monotone sequences in Elias-Fano form, read from memory-mapped files, many queries at a time."""

from __future__ import annotations

import json
import os
import uuid

import numpy as np

_ONE = np.uint64(1)
_HALVES = tuple((np.uint64(s), np.uint64((1 << s) - 1)) for s in (32, 16, 8, 4, 2, 1))
_ALL = (1 << 64) - 1
_ROWS = 1 << 16


def encode(values: np.ndarray, universe: int) -> dict[str, np.ndarray]:
    """The arrays of a sorted sequence of numbers below ``universe`` (at most 2 ** 63)."""
    values = values.astype(np.uint64)
    n = len(values)
    width = max(0, (max(1, universe) // max(1, n)).bit_length() - 1)
    packed = []
    for at in range(0, n, _ROWS):  # whole bytes, as the rows of a strip are a multiple of eight
        part = values[at : at + _ROWS, None] >> np.arange(width, dtype=np.uint64)
        packed.append(np.packbits((part & np.uint64(1)).astype(np.uint8).ravel(), bitorder="little"))
    low = np.concatenate([*packed, np.zeros(16, dtype=np.uint8)])
    low = low[: len(low) // 8 * 8].view(np.uint64)
    high = (values >> np.uint64(width)).astype(np.int64)
    bits = np.zeros(-(-(n + (universe >> width) + 2) // 64) * 64, dtype=np.uint8)
    bits[high + np.arange(n)] = 1
    words = np.packbits(bits, bitorder="little")
    words = np.concatenate([words.view(np.uint64), np.zeros(2, dtype=np.uint64)])
    ones = np.concatenate([[0], np.cumsum(np.bitwise_count(words[:-2]).astype(np.int64))])
    return {
        "shape": np.array([n, width], dtype=np.int64),
        "low": low,
        "high": words,
        "ones": ones.astype(np.int64),
        "zeros": np.arange(len(ones), dtype=np.int64) * 64 - ones,
    }


class Sequence:
    """Random access and search in the arrays of :func:`encode`."""

    def __init__(self, arrays: dict[str, np.ndarray]):
        self.n, self.width = (int(x) for x in arrays["shape"])
        self.low, self.high = arrays["low"], arrays["high"]
        self.ones, self.zeros = arrays["ones"], arrays["zeros"]

    def _lows(self, at: np.ndarray) -> np.ndarray:
        if self.width == 0:
            return np.zeros(len(at), dtype=np.uint64)
        bit = at * self.width
        word, shift = bit >> 6, (bit & 63).astype(np.uint64)
        value = self.low[word] >> shift
        over = self.low[word + 1] << ((np.uint64(64) - shift) & np.uint64(63))
        value = np.where(shift > 0, value | over, value)
        return value & np.uint64((1 << self.width) - 1)

    def _select(self, rank: np.ndarray, directory: np.ndarray, flip: int) -> np.ndarray:
        """Position of the bit number ``rank`` among the ones (or zeros, with ``flip`` all ones)."""
        at = np.searchsorted(directory, rank, side="right") - 1
        left = (rank - directory[at]).astype(np.uint64)
        word = self.high[at] ^ np.uint64(flip)
        place = np.zeros(len(rank), dtype=np.uint64)
        for half, mask in _HALVES:
            below = np.bitwise_count(word & mask).astype(np.uint64)
            up = left >= below
            left -= below * up
            step = half * up
            word >>= step
            place += step
        return at * 64 + place.astype(np.int64)

    def _run(self, bit: np.ndarray, flip: int) -> np.ndarray:
        """Length of the run of zeros (or ones, with ``flip`` all ones) that begins at each bit, up to 64."""
        word, shift = bit >> 6, (bit & 63).astype(np.uint64)
        window = self.high[word] >> shift
        over = self.high[word + 1] << ((np.uint64(64) - shift) & np.uint64(63))
        window = np.where(shift > 0, window | over, window) ^ np.uint64(flip)
        return np.bitwise_count((window & (~window + _ONE)) - _ONE).astype(np.int64)

    def __getitem__(self, at: np.ndarray) -> np.ndarray:
        high = self._select(at, self.ones, 0) - at
        return (high << self.width) | self._lows(at).astype(np.int64)

    def gaps(self, at: np.ndarray) -> np.ndarray:
        """By how much the next value is larger."""
        place = self._select(at, self.ones, 0)
        run = self._run(place + 1, 0)
        rise = run.copy()
        far = np.flatnonzero(run >= 64)
        rise[far] = self._select(at[far] + 1, self.ones, 0) - place[far] - 1
        low = self._lows(np.concatenate([at, at + 1])).astype(np.int64)
        return (rise << self.width) + low[len(at) :] - low[: len(at)]

    def find(self, values: np.ndarray) -> np.ndarray:
        """The index of each value, or -1: the successor of a value is it, or it isn't there.

        The high part names a short run between two zeros of the upper bits; the successor is
        sought among the low parts of that run.
        """
        values = values.astype(np.uint64)
        if self.n == 0 or not len(values):
            return np.full(len(values), -1, dtype=np.int64)
        high = (values >> np.uint64(self.width)).astype(np.int64)
        low = values & np.uint64((1 << self.width) - 1)
        inside = high < self.zeros[-1]
        bound = np.where(inside, high, 0)
        before = self._select(np.maximum(bound - 1, 0), self.zeros, _ALL)
        place = np.where(bound > 0, before + 1, 0)
        run = self._run(place, _ALL)
        far = np.flatnonzero(run >= 64)
        run[far] = self._select(bound[far], self.zeros, _ALL) - place[far]
        start = place - bound
        end = start + run
        start, end = np.where(inside, start, 0), np.where(inside, end, 0)
        low_end, last = start.copy(), end
        active = np.flatnonzero(start < end)
        at, stop = start[active], end[active]
        while len(active):  # halve the runs; most hold one or two
            middle = (at + stop) >> 1
            less = self._lows(middle) < low[active]
            at, stop = np.where(less, middle + 1, at), np.where(less, stop, middle)
            ended = at >= stop
            low_end[active[ended]] = at[ended]
            active, at, stop = active[~ended], at[~ended], stop[~ended]
        out = np.full(len(values), -1, dtype=np.int64)
        found = np.flatnonzero(low_end < last)
        found = found[self._lows(low_end[found]) == low[found]]
        out[found] = low_end[found]
        return out


def save(path: str, arrays: dict[str, np.ndarray]) -> None:
    """Write named arrays as one file, whole or not at all: a repeated task replaces it by the same."""
    head, at = {}, 0
    for name, array in arrays.items():
        head[name] = (array.dtype.str, len(array), at)
        at += -(-array.nbytes // 8) * 8
    text = json.dumps(head).encode()
    text += b" " * (-(len(text) + 8) % 8)
    made = f"{path}.{uuid.uuid4().hex}"
    with open(made, "wb") as file:
        file.write(len(text).to_bytes(8, "little") + text)
        for array in arrays.values():
            file.write(np.ascontiguousarray(array).tobytes() + b"\0" * (-array.nbytes % 8))
    os.replace(made, path)


def load(path: str) -> dict[str, np.ndarray]:
    """The arrays of a file, mapped into memory: a page is read when it is touched."""
    data = np.memmap(path, dtype=np.uint8, mode="r").view(np.ndarray)
    size = int(data[:8].view(np.int64)[0])
    head = json.loads(bytes(data[8 : 8 + size]))
    return {
        name: data[8 + size + at : 8 + size + at + n * np.dtype(kind).itemsize].view(kind)
        for name, (kind, n, at) in head.items()
    }


def nested(name: str, arrays: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    return {f"{name}.{k}": v for k, v in arrays.items()}


def part(name: str, arrays: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    return {k.removeprefix(f"{name}."): v for k, v in arrays.items() if k.startswith(f"{name}.")}
