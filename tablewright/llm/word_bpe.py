"""Word BPE of the ``tokenizers`` library over many texts at once, on their bytes.

The tokenizers meant here drop white space and cut words with a regular expression.
Stretches between blanks made of printable ASCII and the Latin-1 letters are put in
lower case and cut into units by comparing neighbouring bytes, all texts of a slice
together; the library encodes each distinct unit once, and an exact table keeps its
ids.  Every other stretch (apostrophes, control characters, other scripts, the
strings of special tokens) goes to the library whole, and its ids are kept as well.
"""

from __future__ import annotations

import functools
import json
import os
from itertools import chain

import numpy as np
import pyarrow as pa

from tablewright.llm.byte_runs import UnitMemory, classes, cut_units, joined

#: Fixed value: the word pattern whose cuts this module makes on bytes.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

_KINDS = classes(blank=" \n", other="'|", single="0123456789")


class WordEncoder:
    """Encodes texts with a tokenizer of the ``tokenizers`` library that drops white space."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.levels = max(1, (self.library.get_vocab_size(with_added_tokens=True) - 1).bit_length())
        self._check()
        self._read_pattern()
        self._memory = UnitMemory(self._encode_units, self._encode)

    def _read_pattern(self) -> None:
        """Does the tokenizer cut words as this module does, and which ids end a unit?"""
        spec = json.loads(self.library.to_str())
        normal = (spec["normalizer"] or {}).get("normalizers", [])
        steps = (spec["pre_tokenizer"] or {}).get("pretokenizers", [{}])
        lower = [n["type"] for n in normal] == ["NFC", "Replace", "Lowercase"]
        cut = steps[0].get("type") == "Split" and steps[0].get("invert") and steps[0]["behavior"] == "Removed"
        plain = len(steps) == 2 and not steps[1].get("use_regex", True)
        end = spec["model"].get("end_of_word_suffix")
        special = all(t["content"].startswith("<|") and t["content"].endswith("|>") for t in spec["added_tokens"])
        self._units = bool(lower and cut and plain and end and special)
        self._units = self._units and steps[0]["pattern"].get("Regex") == PATTERN
        size = self.library.get_vocab_size(with_added_tokens=True)
        self._ends = np.array([bool(end) and (self.library.id_to_token(i) or "").endswith(end) for i in range(size)])

    def _check(self) -> None:
        samples = ["a b", "Ab\ncd 12", "x. y", "é è"]
        for text in samples:
            whole = self.library.encode(text, add_special_tokens=False).ids
            parts = [self.library.encode(w, add_special_tokens=False).ids for w in text.split()]
            if whole != [i for p in parts for i in p]:
                raise ValueError("the tokenizer joins words over white space")

    def _encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        texts = [text.decode("utf-8", "replace") for text in texts]
        found = [e.ids for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]
        lengths = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter(chain.from_iterable(found), np.int32, lengths.sum()), lengths

    def _encode_units(self, units: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Many units in one text, with blanks between: each ends with an id that ends a word."""
        lines = [b" ".join(units[i : i + 100]) for i in range(0, len(units), 100)]
        ids, _ = self._encode(lines)
        ends = np.flatnonzero(self._ends[ids]) + 1
        return (ids, np.diff(ends, prepend=0)) if len(ends) == len(units) else self._encode(units)

    def encode(self, texts: pa.Array | list[str], end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, each followed by ``end_id``, and where each text ends."""
        data, begins = joined(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()))
        starts, ends, plain, low = cut_units(data, begins, _KINDS, whole=not self._units)
        ids, before = self._memory.spread(self._memory.numbers(data, low, starts, ends, plain))
        stops = before[np.searchsorted(starts, begins[1:])]
        return np.insert(ids, stops, end_id), stops + np.arange(1, len(stops) + 1)


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> WordEncoder:
    """The encoder that this worker keeps for a tokenizer file."""
    return WordEncoder(path)
