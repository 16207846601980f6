"""Short runs of bytes inside a slice of texts, looked up exactly and many at once.

A run of at most ``LONGEST`` bytes, none of them zero, is three 64-bit words.  A table
with open addressing holds the words of known runs, so a lookup compares whole runs:
two runs never pass for each other, whatever their hashes.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa

#: Longest run that fits a key.
LONGEST = 24
#: Zero bytes behind the texts, so that a key can be read at every place.
PADDING = 2 * LONGEST

_MASKS = np.array([(1 << 8 * k) - 1 for k in range(8)] + [(1 << 64) - 1], np.uint64)
#: Odd multipliers of the hash, one for each word of a key and one for the sum.
_FACTORS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)
_LAST = np.uint64(0xD6E8FEB86659FD93)


def joined(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts one after another, padded with zeros, and where each begins.

    The last of the beginnings is where the bytes end.  Null counts as empty.
    """
    texts = texts.cast(pa.large_string()).fill_null("")
    ends = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, 8 * texts.offset)
    size = int(ends[-1] - ends[0])
    data = np.zeros(size + PADDING, np.uint8)
    if size:
        data[:size] = np.frombuffer(texts.buffers()[2], np.uint8, size, int(ends[0]))
    return data, ends - ends[0]


def keys_at(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> list[np.ndarray]:
    """The three words of each run of ``data``, which ends in ``PADDING`` zeros."""
    words = np.ndarray(len(data) - 7, "<u8", data, strides=(1,))
    return [
        words[starts + at] & _MASKS[np.clip(lengths - at, 0, 8)] for at in range(0, LONGEST, 8)
    ]


class RunTable:
    """Numbers of known runs, from 0 in the order of their addition."""

    def __init__(self, most: int):
        """``most``: how many runs it will hold at most."""
        bits = max(4, (2 * most).bit_length())
        self._shift = np.uint64(64 - bits)
        self._wrap = (1 << bits) - 1
        self._held = np.zeros(1 << bits, np.int32)
        self._keys = [np.zeros(1024, np.uint64) for _ in range(3)]
        self.size = 0

    def _place(self, keys: list[np.ndarray]) -> np.ndarray:
        mixed = sum(key * np.uint64(factor) for key, factor in zip(keys, _FACTORS))
        mixed ^= mixed >> np.uint64(32)
        return (mixed * _LAST >> self._shift).astype(np.int64)

    def find(self, keys: list[np.ndarray]) -> np.ndarray:
        """Number of each run, -1 where it is unknown."""
        places = self._place(keys)
        found = self._held[places].astype(np.int64) - 1
        same = np.logical_and.reduce([known[found] == key for known, key in zip(self._keys, keys)])
        open_ = np.flatnonzero((found >= 0) & ~same)
        while len(open_):
            places[open_] = (places[open_] + 1) & self._wrap
            held = self._held[places[open_]].astype(np.int64) - 1
            found[open_] = held
            same = np.logical_and.reduce([k[held] == key[open_] for k, key in zip(self._keys, keys)])
            open_ = open_[(held >= 0) & ~same]
        return found

    def add(self, runs: list[bytes]) -> None:
        """Number new runs, which differ from each other and from all known ones."""
        packed = np.frombuffer(b"".join(run.ljust(LONGEST, b"\0") for run in runs), "<u8").reshape(-1, 3)
        keys = [np.ascontiguousarray(packed[:, k]) for k in range(3)]
        while self.size + len(runs) > len(self._keys[0]):
            self._keys = [np.concatenate([key, np.zeros_like(key)]) for key in self._keys]
        for known, key in zip(self._keys, keys):
            known[self.size : self.size + len(runs)] = key
        places, open_ = self._place(keys), np.arange(len(runs))
        while len(open_):
            free = open_[self._held[places[open_]] == 0]
            _, first = np.unique(places[free], return_index=True)
            taken = free[first]
            self._held[places[taken]] = self.size + taken + 1
            open_ = np.setdiff1d(open_, taken, assume_unique=True)
            places[open_] = (places[open_] + 1) & self._wrap
        self.size += len(runs)


#: Classes of bytes: between words, letters, a unit of its own, other signs, and what sends a word elsewhere.
BLANK, LETTER, SINGLE, MARK, OTHER = range(5)
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
#: First byte of the UTF-8 form of U+00C0 to U+00FF, and the second bytes that are no letters.
LATIN, _TIMES, _DIVIDED = 0xC3, 0x97, 0xB7


def classes(blank: str, other: str, single: str = "") -> np.ndarray:
    """Class of each byte: ASCII letters, the characters named, and printable ASCII as marks."""
    kinds = np.full(256, OTHER, np.uint8)
    for code in range(0x21, 0x7F):
        kinds[code] = LETTER if chr(code).isalpha() else MARK
    for chars, kind in ((blank, BLANK), (single, SINGLE), (other, OTHER)):
        kinds[[ord(c) for c in chars]] = kind
    return kinds


def cut_units(
    data: np.ndarray, begins: np.ndarray, kinds: np.ndarray, whole: bool = False
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Where units begin and end, whether a unit is plain, and the bytes in lower case.

    Words lie between blanks and ends of texts.  A word of letters (ASCII, Latin-1), singles
    and marks is cut into runs of letters, runs of marks and singles; these units are plain.
    Any other word, and with ``whole`` every word, is one unit that is not.
    """
    size = int(begins[-1])
    raw = data[:size]
    kind, low = kinds[raw], LOWER[data]
    if size and raw.max() >= 0x80:
        second = np.flatnonzero((raw & 0xC0) == 0x80)
        value = raw[second]
        letter = (raw[second - 1] == LATIN) & (value != _TIMES) & (value != _DIVIDED)
        kind[second[letter]] = LETTER
        kind[second[letter] - 1] = LETTER
        low[second[letter & (value < 0x9F)]] += 0x20  # the capitals, U+00C0 to U+00DE
    filled = kind != BLANK
    edge = np.zeros(size + 1, bool)
    edge[begins] = True
    behind = np.empty(size, bool)  # is a blank or nothing before this byte?
    behind[:1], behind[1:] = True, ~filled[:-1]
    words = filled & (behind | edge[:-1])
    starts = words
    odd = np.zeros(0, np.int64)
    if not whole:
        change = np.empty(size, bool)
        change[:1], change[1:] = True, kind[1:] != kind[:-1]
        starts = filled & (change | (kind == SINGLE) | words)
        odd = np.flatnonzero(kind == OTHER)
    at = np.flatnonzero(starts)
    plain = np.full(len(at), not whole)
    if len(odd):
        opening = np.flatnonzero(words)
        bad = np.zeros(len(opening), bool)
        bad[np.searchsorted(opening, odd, "right") - 1] = True
        word = np.searchsorted(opening, at, "right") - 1
        keep = ~bad[word] | (opening[word] == at)
        starts[at[~keep]] = False
        at, plain = at[keep], ~bad[word][keep]
    after = np.ones(size, bool)  # does a unit or a blank begin at the next byte, or a text end?
    after[:-1] = starts[1:] | ~filled[1:] | edge[1:size]
    return at, np.flatnonzero(filled & after) + 1, plain, low


def _with(array: np.ndarray, used: int, more: np.ndarray) -> np.ndarray:
    """``array``, of which ``used`` places are taken, with ``more`` behind them; grows by doubling."""
    if used + len(more) > len(array):
        grown = np.empty(max(2 * len(array), used + len(more)), array.dtype)
        grown[:used] = array[:used]
        array = grown
    array[used : used + len(more)] = more
    return array


Learn = Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]]


class UnitMemory:
    """Values of units, computed once for each distinct unit that a worker meets.

    ``runs`` gets new plain units in lower case, ``others`` new ones of the rest as they
    are; both return all values in one array and the number of values of each unit.
    What is kept of unit ``u`` is ``values[begin[u]:begin[u] + counts[u]]``.  Beyond
    ``most`` units, or ``most_bytes`` of those too long for a key, the memory starts anew, which costs time only.
    """

    def __init__(self, runs: Learn, others: Learn, most: int = 1_000_000, most_bytes: int = 64 << 20):
        self._learn_runs, self._learn_others = runs, others
        self._most, self._most_bytes = most, most_bytes
        self._forget()

    def _forget(self) -> None:
        self._runs = RunTable(self._most)
        self._number_of_run = np.zeros(0, np.int64)
        self._others: dict[bytes, int] = {}
        self._bytes = 0
        self.values, self.counts = self._learn_runs([])
        self.begin = np.zeros(0, np.int64)
        self.size = self._held = 0

    def _keep(self, values: np.ndarray, counts: np.ndarray) -> np.ndarray:
        first, held = self.size, self._held
        self.begin = _with(self.begin, first, held + np.cumsum(counts) - counts)
        self.counts = _with(self.counts, first, counts)
        self.values = _with(self.values, held, values)
        self.size, self._held = first + len(counts), held + len(values)
        return np.arange(first, self.size)

    def numbers(
        self, data: np.ndarray, low: np.ndarray, starts: np.ndarray, ends: np.ndarray, plain: np.ndarray
    ) -> np.ndarray:
        """Number of each unit of a slice."""
        lengths = ends - starts
        numbers = np.empty(len(starts), np.int64)
        short = np.flatnonzero(plain & (lengths <= LONGEST))
        keys = keys_at(low, starts[short], lengths[short])
        found = self._runs.find(keys)
        missed = short[found < 0]
        new = list({low[a:b].tobytes() for a, b in zip(starts[missed].tolist(), ends[missed].tolist())})
        rest = np.flatnonzero(~plain | (lengths > LONGEST))
        bodies = [data[a:b].tobytes() for a, b in zip(starts[rest].tolist(), ends[rest].tolist())]
        others = list(set(bodies).difference(self._others))
        size = sum(map(len, others))
        full = self.size + len(new) + len(others) > self._most or self._bytes + size > self._most_bytes
        if full and self.size:
            self._forget()
            return self.numbers(data, low, starts, ends, plain)
        if new:
            if self._runs.size + len(new) > self._most:  # a single slice with more units than the memory
                self._runs = RunTable(len(new))
            self._runs.add(new)
            self._number_of_run = np.concatenate([self._number_of_run, self._keep(*self._learn_runs(new))])
            found = self._runs.find(keys)
        if others:
            self._others.update(zip(others, self._keep(*self._learn_others(others)).tolist()))
            self._bytes += size
        numbers[short] = self._number_of_run[found]
        numbers[rest] = np.fromiter(map(self._others.__getitem__, bodies), np.int64, len(bodies))
        return numbers

    def spread(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values of all units in order, and how many there are before each unit and in all."""
        counts = self.counts[numbers]
        ends = np.r_[0, np.cumsum(counts)]
        places = np.repeat(self.begin[numbers] - ends[:-1], counts) + np.arange(ends[-1])
        return self.values[places], ends
