"""Best-two-fit packing of token sequences.

Only the number of pieces of each length decides which lengths share a sequence, so
the rule runs on that table: at most ``budget`` rows, however many documents there
are.  One sequence after another is filled greedily with the longest piece that fits;
then its smallest piece gives way to two unpacked pieces, together longer, that fit
the gap so enlarged most tightly.  A filling is repeated as long as the rule would
choose it again, so the result is that of packing sequence by sequence.

The fillings say which places pieces of a length get.  A piece finds its place from
its rank among the pieces of its length: the pieces of that length in tasks before,
plus those before it in its own task's file.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablewright.llm.common import id_and_text, slices, stored
from tablewright.llm.word_bpe import encoder

#: Tokens of a sequence.
BUDGET = 4096
#: Bits of a rank in a sort key, next to those of a length.
_RANK_BITS = 44

PIECES = "id bigint, piece int, start bigint, length bigint, ids array<int>, ids_crc32 bigint, part int, nth bigint"


def fillings(counts: dict[int, int], budget: int = BUDGET) -> list[tuple[int, list[tuple[int, int]]]]:
    """Best-two-fit on numbers of pieces by length: ``(repeats, [(length, pieces), ...])``.

    Lengths are from 1 to ``budget``.  The number of fillings does not depend on how
    many pieces there are, only on how many lengths: each ends with a length that is
    used up but for fewer pieces than one more sequence would need.
    """
    left = np.zeros(budget + 1, np.int64)
    for length, count in counts.items():
        left[length] = count
    every = np.arange(budget + 1)
    found = []
    while True:
        below = np.maximum.accumulate(np.where(left > 0, every, 0))  # longest length left up to each
        greedy: dict[int, int] = {}
        gap = budget
        length = int(below[gap])
        while length:
            greedy[length] = min(int(left[length]), gap // length)
            gap -= greedy[length] * length
            length = int(below[min(gap, length - 1)])
        if not greedy:
            return found
        final, pair = dict(greedy), {}
        smallest = min(greedy)
        if gap and sum(greedy.values()) > 1 and (two := _best_pair(left, greedy, smallest, smallest + gap)):
            final[smallest] -= 1
            for length in two:
                pair[length] = pair.get(length, 0) + 1
                final[length] = final.get(length, 0) + 1
            final = {length: n for length, n in final.items() if n}
        repeats = min(
            (int(left[n]) - greedy.get(n, 0) - pair.get(n, 0)) // used + 1 for n, used in final.items()
        )
        for length, used in final.items():
            left[length] -= repeats * used
        found.append((repeats, sorted(final.items(), reverse=True)))


def _best_pair(left: np.ndarray, greedy: dict[int, int], least: int, most: int) -> tuple[int, int] | None:
    """Two unpacked lengths whose sum is largest, above ``least`` and at most ``most``."""
    free = left[: most + 1].copy()
    for length, taken in greedy.items():
        if length <= most:
            free[length] -= taken
    below = np.maximum.accumulate(np.where(free > 0, np.arange(len(free)), 0))
    short = np.flatnonzero(free[: most // 2 + 1] > 0)
    long = below[most - short]
    alone = (long == short) & (free[short] < 2)
    long = np.where(alone | (long < short), 0, long)
    sums = np.where(long > 0, short + long, 0)
    if not len(sums) or sums.max() <= least:
        return None
    best = int(sums.argmax())  # of equal sums, the one with the shortest and the longest piece
    return int(long[best]), int(short[best])


class Places:
    """Where the pieces of each length go: ``(sequence, offset)`` by length and rank."""

    def __init__(self, filled: list[tuple[int, list[tuple[int, int]]]]):
        rows, sequence = [], 0
        for repeats, content in filled:
            offset = 0
            for length, pieces in content:
                rows.append((length, repeats * pieces, sequence, pieces, offset))
                offset += length * pieces
            sequence += repeats
        table = np.array(rows, np.int64).reshape(-1, 5)
        table = table[np.argsort(table[:, 0], kind="stable")]
        length, size = table[:, 0], table[:, 1]
        total = np.cumsum(size)
        opening = np.searchsorted(length, length)
        ranks = total - size - np.r_[0, total][opening]
        self.sequences = sequence
        self._key, self._rank = length << _RANK_BITS | ranks, ranks
        self._sequence, self._pieces, self._offset = table[:, 2], table[:, 3], table[:, 4]

    def __call__(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        row = np.searchsorted(self._key, length << _RANK_BITS | rank, "right") - 1
        turn, place = np.divmod(rank - self._rank[row], self._pieces[row])
        return self._sequence[row] + turn, self._offset[row] + place * length


def write_pieces(
    df: DataFrame,
    model_path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    budget: int = BUDGET,
    end_id: int = 1,
) -> DataFrame:
    """Encode all texts, each followed by ``end_id``, and cut those over ``budget``: one row per piece.

    Columns ``id, piece, start, length, ids, ids_crc32`` (unsigned CRC-32 of the ids
    as little-endian unsigned 32-bit integers), ``part`` (the task) and ``nth`` (pieces of
    that length before it in the task), written once to the shared folder.

    Null text counts as empty: one piece that holds the end id alone.  Ids may be null
    or repeat; every row is a document of its own.  An empty table gives no pieces.
    """
    if not 0 < budget < 1 << 63 - _RANK_BITS:
        raise ValueError(f"budget must be between 1 and {(1 << 63 - _RANK_BITS) - 1}")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = encoder(model_path)
        part = TaskContext.get().partitionId()
        seen = np.zeros(budget + 1, np.int64)
        for batch in slices(batches):
            ids, stops = tool.encode(batch.column("text"), end_id)
            sizes = np.diff(stops, prepend=0)
            pieces = -(-sizes // budget)
            row = np.repeat(np.arange(len(sizes)), pieces)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            start = piece * budget
            length = np.minimum(sizes[row] - start, budget)
            # pieces of a length in order: how many of it came before in this task
            order = np.argsort(length, kind="stable")
            nth = np.empty(len(row), np.int64)
            nth[order] = np.arange(len(row)) - np.searchsorted(length[order], length[order])
            nth += seen[length]
            seen += np.bincount(length, minlength=budget + 1)
            ends = np.cumsum(length)
            data = memoryview(np.ascontiguousarray(ids, "<u4")).cast("B")
            crcs = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip((ends - length).tolist(), ends.tolist())]
            lists = pa.ListArray.from_arrays(
                pa.array(np.r_[0, ends], pa.int32()), pa.array(ids, pa.int32())
            )
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id").take(pa.array(row)),
                    pa.array(piece, pa.int32()),
                    pa.array(start),
                    pa.array(length),
                    lists,
                    pa.array(crcs, pa.int64()),
                    pa.array(np.full(len(row), part), pa.int32()),
                    pa.array(nth),
                ],
                ["id", "piece", "start", "length", "ids", "ids_crc32", "part", "nth"],
            )

    return stored(id_and_text(df, id_col, text_col).mapInArrow(work, PIECES), "pieces")


def place(pieces: DataFrame, budget: int = BUDGET) -> DataFrame:
    """Pack stored pieces: the columns of ``pieces`` but ``ids``, with ``sequence_id`` and ``offset``.

    Sequences are numbered from 0 without gaps, and filled from offset 0 without gaps.
    Of pieces of one length it does not matter which gets which place: they are taken
    in the order of tasks and files.  The table of places that tasks get is bounded by
    ``budget``, not by the data.
    """
    counted = stored(pieces.groupBy("part", "length").agg(F.count("*").alias("pieces")), "piece-lengths")
    totals = counted.groupBy("length").agg(F.sum("pieces").alias("pieces")).collect()
    places = Places(fillings({r["length"]: r["pieces"] for r in totals}, budget))
    shared = pieces.sparkSession.sparkContext.broadcast(places)
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = counted.select("part", "length", F.coalesce(F.sum("pieces").over(earlier), F.lit(0)).alias("before"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = shared.value
        for batch in batches:
            sequence, offset = find(batch.column("length").to_numpy(), batch.column("rank").to_numpy())
            columns = [batch.column(name) for name in batch.schema.names if name != "rank"]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(sequence), pa.array(offset)],
                [*(n for n in batch.schema.names if n != "rank"), "sequence_id", "offset"],
            )

    # shuffled: the table of earlier pieces grows with the tasks, and Spark takes its packed size for small
    ranked = pieces.drop("ids").join(before.hint("merge"), ["part", "length"])
    ranked = ranked.select(
        "id", "piece", "start", "length", "ids_crc32", "part", "nth", (F.col("nth") + F.col("before")).alias("rank")
    )
    fields = "id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, part int, nth bigint"
    return ranked.mapInArrow(work, f"{fields}, sequence_id bigint, offset bigint")


def sequences(pieces: DataFrame, placed: DataFrame) -> DataFrame:
    """The packed sequences: ``sequence_id``, its token ``ids`` and the ``ends`` of its pieces.

    A sequence is at most ``budget`` tokens, so a group of this is bounded.
    """
    keys = ["part", "length", "nth"]
    parts = pieces.select(*keys, "ids").join(placed.select(*keys, "sequence_id", "offset"), keys)
    held = F.sort_array(F.collect_list(F.struct("offset", "length", "ids")))
    return parts.groupBy("sequence_id").agg(held.alias("held")).select(
        "sequence_id",
        F.flatten(F.col("held.ids")).alias("ids"),
        F.transform("held", lambda p: p["offset"] + p["length"]).alias("ends"),
    )
