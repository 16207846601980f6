"""Fill-in-middle transformation: a text is cut at two units and its parts change places.

Units are maximal runs of ASCII letters and single other code points.  The bytes of a
text are cut into blocks of fixed size; a Fenwick tree over the blocks stores how many
units and how many code points begin in each.  A cut is found by descending the tree
in steps of powers of two to the block where the unit begins, then by a scan of that
block alone.  The trees, descents and scans of all texts of a slice run together.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.llm.byte_runs import joined
from tablewright.llm.common import id_and_text, slices

#: Bytes of a block.
BLOCK = 256
#: The marks before prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Of 100 texts, how many stay plain, and of 100 others, how many begin with the suffix.
PLAIN_SHARE, SPM_SHARE = 10, 20

_LETTER = np.zeros(256, bool)
_LETTER[[c for c in range(128) if chr(c).isalpha()]] = True


class BlockCounts:
    """Units and code points of many texts, in one Fenwick tree over the blocks of each.

    ``data`` holds the bytes of all texts, ``begins`` where each begins and the last ends.
    """

    def __init__(self, data: np.ndarray, begins: np.ndarray, block: int = BLOCK):
        size = int(begins[-1])
        raw = data[:size]
        self._point = (raw & 0xC0) != 0x80
        letter = _LETTER[raw]
        inside = np.zeros(size, bool)
        inside[1:] = letter[1:] & letter[:-1]
        inside[begins[:-1][begins[:-1] < size]] = False
        self._unit = self._point & ~inside
        self._begins, self._block = begins, block
        sizes = np.diff(begins)
        self._blocks = -(-sizes // block)
        last = np.cumsum(self._blocks)
        self._first = last - self._blocks
        total = int(last[-1]) if len(last) else 0
        text = np.repeat(np.arange(len(sizes)), self._blocks)
        number = np.arange(total) - self._first[text] + 1  # from 1 inside a text
        starts = begins[text] + (number - 1) * block
        self.units = self._tree(self._unit, starts, text, number)
        self.points = self._tree(self._point, starts, text, number)
        self.total_units = self._sums(self._unit)
        self.total_points = self._sums(self._point)

    def _sums(self, marks: np.ndarray) -> np.ndarray:
        upto = np.r_[0, np.cumsum(marks, dtype=np.int64)]
        return np.diff(upto[self._begins])

    def _tree(self, marks: np.ndarray, starts: np.ndarray, text: np.ndarray, number: np.ndarray) -> np.ndarray:
        """Node ``i`` of a text (from 1) holds the sum of the blocks from ``i - (i & -i)`` to before ``i``."""
        if not len(starts):
            return np.zeros(0, np.int64)
        sums = np.r_[0, np.cumsum(np.add.reduceat(marks, starts, dtype=np.int64))]
        upto = self._first[text] + number
        return sums[upto] - sums[upto - (number & -number)]

    def cut(self, texts: np.ndarray, units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Byte place (from the text's begin) and code points before unit ``units`` of each text.

        The number of units of a text asks for its end.
        """
        place = np.zeros(len(texts), np.int64)
        left, points = units.astype(np.int64), np.zeros(len(texts), np.int64)
        blocks, first = self._blocks[texts], self._first[texts]
        step = 1 << max(0, int(blocks.max(initial=0)).bit_length() - 1)
        while step:
            ahead = place + step
            node = np.where(ahead <= blocks, first + ahead - 1, 0)
            if len(self.units):
                go = (ahead <= blocks) & (self.units[node] <= left)
                left -= np.where(go, self.units[node], 0)
                points += np.where(go, self.points[node], 0)
                place = np.where(go, ahead, place)
            step >>= 1
        within = np.flatnonzero(place < blocks)  # the others end with their text
        start = place * self._block
        found = np.diff(self._begins)[texts]
        if len(within):
            begin = self._begins[texts[within]] + start[within]
            most = self._begins[texts[within] + 1]
            at = begin[:, None] + np.arange(self._block)
            valid = at < most[:, None]
            at = np.minimum(at, len(self._unit) - 1)
            units_in = np.cumsum(self._unit[at] & valid, axis=1)
            inside = (units_in > left[within, None]).argmax(axis=1)
            points_in = np.cumsum(self._point[at] & valid, axis=1)
            before = np.where(inside > 0, points_in[np.arange(len(within)), inside - 1], 0)
            found[within] = start[within] + inside
            points[within] += before
        return found, points


def draws(ids: list[int | None]) -> np.ndarray:
    """Four unsigned 32-bit numbers of each id: the first of the SHA-256 of ``1:`` and the id."""
    texts = (b"1:%d" % i if i is not None else b"1:" for i in ids)
    heads = b"".join(hashlib.sha256(t).digest()[:16] for t in texts)
    return np.frombuffer(heads, ">u4").reshape(-1, 4).astype(np.int64)


def fill_in_middle(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``id, n, form, prefix_chars, middle_chars, output``.

    ``n`` units; ``form`` is ``plain``, ``psm`` or ``spm``; the lengths are in code points,
    null for plain texts.  The cuts and the form follow from the id alone.

    Null text counts as empty; empty texts, and texts that hold a mark, stay plain.  A
    null id draws from an empty number; rows that share an id are cut by the same
    draws.  An empty table gives no rows.  Texts are taken whole, however long.
    """
    marks = [mark.encode() for mark in (PREFIX, SUFFIX, MIDDLE)]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            data, begins = joined(batch.column("text"))
            counts = BlockCounts(data, begins)
            n = counts.total_units
            rows = np.arange(len(n))
            h = draws(batch.column("id").to_pylist())
            one, two = h[:, 0] % (n + 1), h[:, 1] % (n + 1)
            first, first_points = counts.cut(rows, np.minimum(one, two))
            second, second_points = counts.cut(rows, np.maximum(one, two))
            whole = data[: int(begins[-1])].tobytes()
            kept = h[:, 2] % 100 >= 100 - PLAIN_SHARE
            suffix_first = h[:, 3] % 100 < SPM_SHARE
            forms, outputs = [], []
            for k, (a, b) in enumerate(zip(begins.tolist(), begins[1:].tolist())):
                text = whole[a:b]
                if not text or kept[k] or any(mark in text for mark in marks):
                    forms.append("plain")
                    outputs.append(text)
                    continue
                i, j = int(first[k]), int(second[k])
                before, middle, after = text[:i], text[i:j], text[j:]
                forms.append("spm" if suffix_first[k] else "psm")
                head = [marks[1], after, marks[0], before] if suffix_first[k] else [marks[0], before, marks[1], after]
                outputs.append(b"".join([*head, marks[2], middle]))
            plain = np.array([form == "plain" for form in forms], bool)
            ends = np.cumsum([0, *map(len, outputs)])
            texts = pa.Array.from_buffers(
                pa.string(),
                len(outputs),
                [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(b"".join(outputs))],
            )
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id"),
                    pa.array(n, pa.int64()),
                    pa.array(forms, pa.string()),
                    pa.array(first_points, pa.int64(), mask=plain),
                    pa.array(second_points - first_points, pa.int64(), mask=plain),
                    texts,
                ],
                ["id", "n", "form", "prefix_chars", "middle_chars", "output"],
            )

    return id_and_text(df, id_col, text_col).mapInArrow(
        work, "id bigint, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string"
    )


def restored(output: Column, form: Column) -> Column:
    """The text that an output and its form stand for: built-in functions only.

    No part holds a mark, and none can arise where parts meet, since a mark begins with
    ``<`` and ends with ``>``.
    """
    width = len(PREFIX) + 1
    middle = F.substring_index(output, MIDDLE, -1)
    head = F.substring_index(output, MIDDLE, 1)
    every = F.lit(1 << 30)

    def parts(mark: str) -> tuple[Column, Column]:
        return F.substr(F.substring_index(head, mark, 1), F.lit(width), every), F.substring_index(head, mark, -1)

    before, after = parts(SUFFIX)
    late_after, late_before = parts(PREFIX)
    return (
        F.when(form == "plain", output)
        .when(form == "psm", F.concat(before, middle, after))
        .otherwise(F.concat(late_before, middle, late_after))
    )
