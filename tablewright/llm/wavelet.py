"""Wavelet matrix of a token sequence, in one compressed file.

Level 0 holds the highest bit of every token; after each level the tokens are
stably parted, zeros first, so level ``k`` holds bit ``k`` in the order that the
levels above left.  With the number of ones before each block, rank and select
need one block, and access, counting and occurrence lookup need one or two blocks
a level.

File layout (integers little-endian)::

    magic "TKWMAT01"
    blocks of every level, one zstd frame each (or raw, where that is not larger)
    sections, each one zstd frame
    directory: JSON with place and size of every section, and the sizes
    length of the directory (8 bytes), magic

Sections: ``doc_ids`` (int64), ``doc_known`` (one byte each, 0 for a null id),
``doc_ends`` (int64, tokens up to the end of each document), and for each level
``ones`` (int64, ones before each block) and ``at`` (int64, where each block begins
in the file, and where the last one ends).
"""

from __future__ import annotations

import functools
import json
from collections.abc import Callable

import numpy as np
import zstandard

MAGIC = b"TKWMAT01"
BLOCK_BITS = 1 << 16


def build(
    tokens: np.ndarray, doc_ids: np.ndarray, doc_known: np.ndarray, doc_ends: np.ndarray, levels: int
) -> bytes:
    """Content of the file for tokens below ``2**levels``."""
    if len(tokens) and (tokens.min() < 0 or tokens.max() >> levels):
        raise ValueError(f"tokens need more than {levels} bits")
    pack = zstandard.ZstdCompressor(level=1).compress
    out, place = [MAGIC], len(MAGIC)
    sections: dict[str, tuple[int, int]] = {}

    def add(data: bytes) -> int:
        nonlocal place
        out.append(data)
        place += len(data)
        return place

    zeros = []
    current = tokens.astype(np.uint16 if levels <= 16 else np.uint32)
    tables: dict[str, np.ndarray] = {
        "doc_ids": doc_ids.astype("<i8"),
        "doc_known": doc_known.astype(np.uint8),
        "doc_ends": doc_ends.astype("<i8"),
    }
    for level in range(levels):
        bits = (current >> (levels - 1 - level)).astype(np.uint8) & 1
        plane = np.packbits(bits, bitorder="little")
        at, ones = [place], [0]
        for start in range(0, len(plane), BLOCK_BITS // 8):
            raw = plane[start : start + BLOCK_BITS // 8]
            ones.append(ones[-1] + int(np.bitwise_count(raw).sum()))
            packed, raw = pack(raw.tobytes()), raw.tobytes()
            at.append(add(packed if len(packed) < len(raw) else raw))
        tables[f"ones{level}"], tables[f"at{level}"] = np.array(ones, "<i8"), np.array(at, "<i8")
        mask = bits.view(bool)
        current = np.concatenate([current[~mask], current[mask]])
        zeros.append(len(bits) - ones[-1])
    for name, table in tables.items():
        begin = place
        sections[name] = (begin, add(pack(table.tobytes())) - begin)
    directory = {"tokens": len(tokens), "documents": len(doc_ids), "levels": levels}
    directory |= {"block_bits": BLOCK_BITS, "zeros": zeros, "sections": sections}
    text = json.dumps(directory).encode()
    out += [text, len(text).to_bytes(8, "little"), MAGIC]
    return b"".join(out)


class WaveletFile:
    """Reads such a file through ``read(offset, length)``; blocks are fetched as needed."""

    def __init__(self, read: Callable[[int, int], bytes], size: int):
        self._read = read
        end = read(size - 16, 16)
        if size < 24 or end[8:] != MAGIC or read(0, 8) != MAGIC:
            raise ValueError("not a token file")
        length = int.from_bytes(end[:8], "little")
        if length > size - 24:
            raise ValueError("token file is damaged")
        self.directory = json.loads(read(size - 16 - length, length))
        self.n, self.levels = self.directory["tokens"], self.directory["levels"]
        self.zeros = self.directory["zeros"]
        self._unpack = zstandard.ZstdDecompressor().decompress
        self.doc_ids = self._table("doc_ids", "<i8")
        self.doc_known = self._table("doc_known", "u1").astype(bool)
        self.doc_ends = self._table("doc_ends", "<i8")
        self._ones = [self._table(f"ones{k}", "<i8") for k in range(self.levels)]
        self._at = [self._table(f"at{k}", "<i8") for k in range(self.levels)]
        self.block = functools.lru_cache(maxsize=256)(self._block)

    @classmethod
    def of_bytes(cls, data: bytes) -> WaveletFile:
        return cls(lambda at, length: data[at : at + length], len(data))

    def _table(self, name: str, kind: str) -> np.ndarray:
        at, length = self.directory["sections"][name]
        return np.frombuffer(self._unpack(self._read(at, length)), kind)

    def _block(self, level: int, index: int) -> np.ndarray:
        """Bits of a block, one byte each."""
        bits = min(BLOCK_BITS, self.n - index * BLOCK_BITS)
        at, end = int(self._at[level][index]), int(self._at[level][index + 1])
        data = self._read(at, end - at)
        if len(data) < (bits + 7) // 8:
            data = self._unpack(data)
        return np.unpackbits(np.frombuffer(data, np.uint8), count=bits, bitorder="little")

    def rank(self, level: int, position: int) -> int:
        """Ones of a level before a position."""
        index, rest = divmod(position, BLOCK_BITS)
        inside = int(self.block(level, index)[:rest].sum()) if rest else 0
        return int(self._ones[level][index]) + inside

    def select(self, level: int, bit: int, nth: int) -> int:
        """Position of the ``nth`` (from 0) one or zero of a level."""
        ones = self._ones[level]
        before = ones if bit else np.minimum(np.arange(len(ones)) * BLOCK_BITS, self.n) - ones
        index = int(np.searchsorted(before, nth, "right")) - 1
        inside = np.flatnonzero(self.block(level, index) == bit)[nth - int(before[index])]
        return index * BLOCK_BITS + int(inside)

    def _select_all(self, level: int, bit: int, nth: np.ndarray) -> np.ndarray:
        """Positions of many ones or zeros of a level, in ascending order, block by block."""
        ones = self._ones[level]
        before = ones if bit else np.minimum(np.arange(len(ones)) * BLOCK_BITS, self.n) - ones
        index = np.searchsorted(before, nth, "right") - 1
        found = np.empty_like(nth)
        edges = np.flatnonzero(np.diff(index, prepend=-1, append=-1)) if len(nth) else np.zeros(1, np.int64)
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
            block = int(index[a])
            inside = np.flatnonzero(self.block(level, block) == bit)
            found[a:b] = block * BLOCK_BITS + inside[nth[a:b] - before[block]]
        return found

    def access(self, position: int) -> int:
        """The token at a position."""
        if not 0 <= position < self.n:
            raise IndexError(position)
        token = 0
        for level in range(self.levels):
            bit = int(self.block(level, position // BLOCK_BITS)[position % BLOCK_BITS])
            ones = self.rank(level, position)
            position = self.zeros[level] + ones if bit else position - ones
            token = token << 1 | bit
        return token

    def _range(self, token: int, start: int, stop: int) -> tuple[int, int]:
        """Where the occurrences of a token lie below the last level."""
        for level in range(self.levels):
            first, last = self.rank(level, start), self.rank(level, stop)
            if token >> (self.levels - 1 - level) & 1:
                start, stop = self.zeros[level] + first, self.zeros[level] + last
            else:
                start, stop = start - first, stop - last
        return start, stop

    def count(self, token: int, start: int = 0, stop: int | None = None) -> int:
        """Occurrences of a token among the positions from ``start`` to before ``stop``."""
        if token < 0 or token >> self.levels:
            return 0
        first, last = self._range(token, start, self.n if stop is None else stop)
        return last - first

    def occurrences(self, token: int, start: int = 0, stop: int | None = None) -> list[int]:
        """Positions of a token, in order."""
        if token < 0 or token >> self.levels:
            return []
        places = np.arange(*self._range(token, start, self.n if stop is None else stop))
        for level in range(self.levels - 1, -1, -1):
            bit = token >> (self.levels - 1 - level) & 1
            places = self._select_all(level, bit, places - self.zeros[level] * bit)
        return places.tolist()

    def tokens(self) -> np.ndarray:
        """The whole sequence: the parting of every level undone, last level first."""
        current = np.zeros(self.n, np.uint16 if self.levels <= 16 else np.uint32)
        for level in range(self.levels - 1, -1, -1):
            blocks = [self._block(level, i) for i in range(len(self._at[level]) - 1)]
            mask = np.concatenate(blocks).view(bool) if blocks else np.zeros(0, bool)
            before = np.empty_like(current)
            before[~mask] = current[: self.zeros[level]]
            before[mask] = current[self.zeros[level] :] | (1 << (self.levels - 1 - level))
            current = before
        return current
