"""Token counts of a SentencePiece BPE model without making ids: heap and linked list.

The symbols of a span form a linked list.  A heap holds the adjacent pairs that form
a piece, ordered by rank and then from left to right; the first is popped and
merged, its new neighbours are pushed, entries overtaken by other merges are
skipped.  The count is the number of initial symbols minus the merges.  A character
that is no piece starts as the number of its UTF-8 bytes, as byte fallback spells it.
"""

from __future__ import annotations

from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from tablewright.llm.common import id_and_text, slices
from tablewright.llm.piece_model import PieceModel, load

#: Distinct spans that a worker remembers; beyond it the memory starts anew.
MEMORY = 800_000

_memory: dict[str, dict[str, int]] = {}


def count_span(span: str, model: PieceModel) -> int:
    """Number of tokens of one span.

    The symbol that begins at ``i`` ends before ``end[i]``, where the next one
    begins; ``previous[i]`` is the beginning of the one before.
    """
    rank_of = model.ranks.get
    size = len(span)
    end = list(range(1, size + 1))
    previous = list(range(-1, size - 1))
    heap = [
        (rank, i, i + 1, i + 2)
        for i in range(size - 1)
        if (rank := rank_of(span[i : i + 2])) is not None
    ]
    heapify(heap)
    merges = 0
    while heap:
        _, left, right, stop = heappop(heap)
        if end[left] != right or end[right] != stop:
            continue  # one of the two has grown or is gone
        merges += 1
        end[left] = stop
        end[right] = -1
        if stop < size:
            previous[stop] = left
            rank = rank_of(span[left : end[stop]])
            if rank is not None:
                heappush(heap, (rank, left, stop, end[stop]))
        ahead = previous[left]
        if ahead >= 0:
            rank = rank_of(span[ahead:stop])
            if rank is not None:
                heappush(heap, (rank, ahead, left, stop))
    extra = 0
    if not model.characters.issuperset(span):
        extra = sum(
            len(c.encode("utf-8", "surrogatepass")) - 1
            for i, c in enumerate(span)
            if c not in model.characters and end[i] == i + 1
        )
    return size - merges + extra


def count_texts(texts: list[str], model: PieceModel, memory: dict[str, int]) -> np.ndarray:
    """Token counts of texts; ``memory`` holds the counts of spans by key."""
    keys = [model.keys(t) for t in texts]
    new = set(chain.from_iterable(keys)).difference(memory)
    if len(memory) + len(new) > MEMORY:
        memory.clear()
        new = set(chain.from_iterable(keys))
    for key in new:
        memory[key] = count_span(model.symbols(key), model)
    counts = np.fromiter(map(len, keys), np.int64, len(keys))
    spans = np.fromiter(map(memory.__getitem__, chain.from_iterable(keys)), np.int64, counts.sum())
    total = np.r_[0, np.cumsum(spans)]
    ends = np.cumsum(counts)
    return total[ends] - total[ends - counts]


def token_counts(
    df: DataFrame,
    model_path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    limit: int = 4096,
) -> DataFrame:
    """One row per input row: ``id, n_bytes, n_tokens, over_limit``.

    No begin or end token counts; texts are taken whole.  Null text counts as
    empty: no bytes, no tokens.  Ids may be null or repeat; an empty table gives
    no rows.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, memory = load(model_path), _memory.setdefault(model_path, {})
        for batch in slices(batches):
            found = count_texts(batch.column("text").to_pylist(), model, memory)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id"),
                    pc.binary_length(batch.column("text")).cast(pa.int64()),
                    pa.array(found),
                    pa.array(found > limit),
                ],
                ["id", "n_bytes", "n_tokens", "over_limit"],
            )

    return id_and_text(df, id_col, text_col).mapInArrow(
        work, "id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean"
    )
