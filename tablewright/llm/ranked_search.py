"""Ranked lexical search, accumulator-limited and term at a time.

One pass cuts all documents into terms and stores, for each, its length and the terms
that some item asks for.  Term counts over all documents give the weights.  A second
pass takes the stored rows block by block.  Within a block an item's terms come rarest
first; a term adds its scores to the documents' accumulators.  No accumulators
are created any more once the terms still to come, at their best in this block,
cannot lift a new document to the ``k``-th best score found so far, here or in the
task's earlier blocks; the accumulators that exist go on to exact scores.  Each
task hands on at most ``k`` rows an item, and a window over these ranks them.

Items are taken in groups whose terms fit ``ITEM_BYTES``, whatever their number; each group is
one pass over the documents.  No accumulator is dropped for space, so the ranking is
exact.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablewright.functions.columns import col, require_columns
from tablewright.llm.byte_runs import LONGEST, RunTable, joined, keys_at
from tablewright.llm.common import id_and_text, slices, stored, text_or_empty

#: Documents of each item's ranking.
TOP = 50
#: Bytes of items' terms that go to every task at once.
ITEM_BYTES = 16 << 20
#: Postings of a block.
BLOCK_POSTINGS = 2_000_000

#: Which bytes belong to a term, and ASCII in lower case.
_IN_TERM = np.array([b >= 0x80 or chr(b).isalnum() for b in range(256)], bool)
_LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)


def _term_places(data: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the terms of texts begin and end, in order."""
    size = int(begins[-1])
    inside = np.zeros(size + 1, bool)
    inside[:-1] = _IN_TERM[data[:size]]
    edge = np.zeros(size + 1, bool)
    edge[begins] = True
    start = inside.copy()
    start[1:] &= ~inside[:-1] | edge[1:]
    stop = inside[:-1] & (~inside[1:] | edge[1:])
    return np.flatnonzero(start), np.flatnonzero(stop) + 1


def _distinct_terms(text: str) -> set[bytes]:
    data, begins = joined(pa.array([text], pa.string()))
    low = _LOWER[data]
    starts, ends = _term_places(data, begins)
    return {low[a:b].tobytes() for a, b in zip(starts.tolist(), ends.tolist())}


class Vocabulary:
    """The terms that items ask for, numbered from 0: short ones in an exact table, long ones in a dict."""

    def __init__(self, terms: list[bytes]):
        short = [t for t in terms if len(t) <= LONGEST]
        self.terms = short + [t for t in terms if len(t) > LONGEST]
        self._table = RunTable(max(1, len(short)))
        if short:
            self._table.add(short)
        self._long = {t: k for k, t in enumerate(self.terms) if k >= len(short)}

    def find(self, low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Number of each term, -1 if no item asks for it."""
        lengths = ends - starts
        numbers = np.full(len(starts), -1, np.int64)
        short = lengths <= LONGEST
        if self._table.size:
            numbers[short] = self._table.find(keys_at(low, starts[short], lengths[short]))
        if self._long:
            for k in np.flatnonzero(~short).tolist():
                numbers[k] = self._long.get(low[starts[k] : ends[k]].tobytes(), -1)
        return numbers


def item_terms(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """``item, terms``: the distinct terms of each item, rows of one id taken together."""
    require_columns(items, [id_col, text_col])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = [sorted(_distinct_terms(t)) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("item"), pa.array(sets, pa.list_(pa.binary()))], ["item", "terms"]
            )

    rows = items.select(col(id_col).cast("bigint").alias("item"), text_or_empty(text_col).alias("text"))
    found = rows.mapInArrow(work, "item bigint, terms array<binary>")
    return found.groupBy("item").agg(F.array_distinct(F.flatten(F.collect_list("terms"))).alias("terms"))


def _count_terms(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """Stored ``id, n, terms, tfs``: length of each document, and its asked-for terms with their counts."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    width = max(1, len(vocabulary.terms))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in slices(batches):
            data, begins = joined(batch.column("text"))
            low = _LOWER[data]
            starts, ends = _term_places(data, begins)
            upto = np.searchsorted(starts, begins[1:])
            sizes = np.diff(upto, prepend=0)
            numbers = known.find(low, starts, ends)
            wanted = numbers >= 0
            pairs = np.repeat(np.arange(len(sizes)), sizes)[wanted] * width + numbers[wanted]
            pairs, tfs = np.unique(pairs, return_counts=True)
            row, term = np.divmod(pairs, width)
            ends_of = pa.array(np.searchsorted(row, np.arange(len(sizes) + 1)), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id"),
                    pa.array(sizes, pa.int64()),
                    pa.ListArray.from_arrays(ends_of, pa.array(term, pa.int32())),
                    pa.ListArray.from_arrays(ends_of, pa.array(tfs, pa.int64())),
                ],
                ["id", "n", "terms", "tfs"],
            )

    return stored(docs.mapInArrow(work, "id bigint, n bigint, terms array<int>, tfs array<bigint>"), "postings")


def _frequencies(postings: DataFrame, width: int) -> np.ndarray:
    """Documents that hold each term, counted in the tasks and added up."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(width, np.int64)
        for batch in batches:
            held = batch.column("terms").flatten().to_numpy()
            counts += np.bincount(held, minlength=width)
        term = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(term, pa.int32()), pa.array(counts[term])], ["term", "df"])

    rows = postings.select("terms").mapInArrow(work, "term int, df bigint").groupBy("term").agg(F.sum("df").alias("df"))
    found = np.zeros(width, np.int64)
    for row in rows.collect():  # one row per term that items of this group ask for
        found[row["term"]] = row["df"]
    return found


def weight(documents: int, frequency: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * frequency + 1)))


class Block:
    """Postings of some documents, grouped by term, with the scores they give."""

    def __init__(self, n: np.ndarray, sizes: np.ndarray, terms: np.ndarray, tfs: np.ndarray,
                 weights: np.ndarray, documents: int, length: int):
        m = 50 + 50 * n * documents // max(1, length)
        rows = np.repeat(np.arange(len(n)), sizes)
        order = np.argsort(terms.astype(np.uint16) if len(weights) <= 1 << 16 else terms, kind="stable")
        terms, self._rows = terms[order], rows[order]
        tf = tfs[order]
        self._scores = weights[terms] * (1_000_000_000 * tf // (1000 * tf + 20 * m[self._rows]))
        self._edges = np.searchsorted(terms, np.arange(len(weights) + 1))
        filled = np.flatnonzero(np.diff(self._edges))
        self.best = np.zeros(len(weights), np.int64)
        if len(filled):
            self.best[filled] = np.maximum.reduceat(self._scores, self._edges[filled])
        self._sum = np.zeros(len(n), np.int64)

    def postings(self, term: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows that hold a term, ascending, and its score in each."""
        some = slice(self._edges[term], self._edges[term + 1])
        return self._rows[some], self._scores[some]

    def rank(self, terms: np.ndarray, floor: int, top: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows that can be among the ``top`` best, with exact scores, for terms in the order of rarity.

        ``floor`` is the ``top``-th best score known from elsewhere, 0 if there is none.
        A row left out scores below ``floor`` or below ``top`` rows of the result.
        """
        terms = terms[self.best[terms] > 0]
        rest = np.r_[np.cumsum(self.best[terms][::-1])[::-1], 0]  # the most that term k and the later ones add
        total = self._sum
        touched = []
        done = 0
        for term in terms.tolist():
            if rest[done] < floor:
                break
            rows, scores = self.postings(term)
            total[rows] += scores
            touched.append(rows)
            done += 1
            if done < len(terms) and total[rows].max() > rest[done]:
                live = np.unique(np.concatenate(touched))
                touched = [live]
                if len(live) >= top:
                    floor = max(floor, int(np.partition(total[live], -top)[-top]))
        rows = np.unique(np.concatenate(touched)) if touched else np.zeros(0, np.int64)
        found = total[rows]
        total[rows] = 0
        for term in terms[done:].tolist():
            held, scores = self.postings(term)
            at = np.searchsorted(held, rows)
            at[at == len(held)] = 0
            same = held[at] == rows
            found[same] += scores[at[same]]
        keep = found > 0
        return rows[keep], found[keep]


class Best:
    """The best documents of each item so far: ties go to the smaller id, null ids come last."""

    def __init__(self, top: int):
        self._top = top
        self._held: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}

    def floor(self, item: int) -> int:
        held = self._held.get(item)
        return int(held[2][-1]) if held is not None and len(held[2]) == self._top else 0

    def add(self, item: int, ids: np.ndarray, known: np.ndarray, scores: np.ndarray) -> None:
        if item in self._held:
            ids, known, scores = map(np.concatenate, zip(self._held[item], (ids, known, scores)))
        if len(scores) > self._top:  # ids and marks only for those that can stay
            least = np.partition(scores, -self._top)[-self._top]
            able = scores >= least
            ids, known, scores = ids[able], known[able], scores[able]
        order = np.lexsort((ids, ~known, -scores))[: self._top]
        self._held[item] = ids[order], known[order], scores[order]

    def rows(self) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        for item, held in self._held.items():
            yield item, *held


def _rank_group(
    docs: DataFrame, group: list[tuple[int | None, list[bytes]]], top: int
) -> DataFrame:
    """``item_no, id, score``: at most ``top`` rows per item and task, the best of all among them."""
    vocabulary = Vocabulary(sorted({term for _, terms in group for term in terms}))
    number = {term: k for k, term in enumerate(vocabulary.terms)}
    postings = _count_terms(docs, vocabulary)
    total = postings.agg(F.count_if(F.col("n") > 0).alias("N"), F.coalesce(F.sum("n"), F.lit(0)).alias("L")).first()
    df = _frequencies(postings, max(1, len(number)))
    weights = np.array([weight(total["N"], f) for f in df.tolist()], np.int64)
    asked = []
    for _, terms in group:
        numbers = np.array(sorted((number[t] for t in terms), key=lambda k: (df[k], k)), np.int64)
        asked.append(numbers[df[numbers] > 0])
    shared = docs.sparkSession.sparkContext.broadcast((asked, weights, total["N"], total["L"]))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, weights, documents, length = shared.value
        best = Best(top)
        held: list[pa.RecordBatch] = []

        def score() -> None:
            table = pa.Table.from_batches(held).combine_chunks()
            held.clear()
            lists = table.column("terms").combine_chunks()
            ids = table.column("id").combine_chunks()
            known = ids.is_valid().to_numpy(zero_copy_only=False)
            names = ids.fill_null(0).to_numpy()
            block = Block(
                table.column("n").to_numpy(),
                lists.value_lengths().to_numpy(),
                lists.flatten().to_numpy(),
                table.column("tfs").combine_chunks().flatten().to_numpy(),
                weights, documents, length,
            )
            for item, terms in enumerate(asked):
                rows, scores = block.rank(terms, best.floor(item), top)
                if len(rows):
                    best.add(item, names[rows], known[rows], scores)

        size = 0
        for batch in batches:
            held.append(batch)
            size += len(batch.column("terms").flatten())
            if size >= BLOCK_POSTINGS:
                score()
                size = 0
        if held:
            score()
        for item, ids, known, scores in best.rows():
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(len(ids), item), pa.int32()),
                    pa.array(ids, pa.int64(), mask=~known),
                    pa.array(scores),
                ],
                ["item_no", "id", "score"],
            )

    return postings.mapInArrow(work, "item_no int, id bigint, score bigint")


def ranked_search(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    top: int = TOP,
    item_bytes: int = ITEM_BYTES,
) -> DataFrame:
    """The ``top`` best documents of each item: ``item, rank, id, score``, with score above 0.

    Rows of one item id, null included, are one item with the terms of all.  Every row of
    ``docs`` is a document, also where ids repeat; null ids come after others of equal
    score.  Null text has no terms.  Items without terms, or whose terms no document
    holds, have no rows; an empty table on either side gives no rows.
    """
    if top < 1:
        raise ValueError("top must be at least 1")
    spark = docs.sparkSession
    wanted = stored(item_terms(items, item_col, item_text_col), "item-terms")
    size = F.lit(64) + F.aggregate("terms", F.lit(0).cast("bigint"), lambda s, t: s + F.octet_length(t) + 64)
    total = wanted.agg(F.sum(size)).first()[0] or 0
    groups = -(-total // item_bytes)
    texts = id_and_text(docs, id_col, text_col)
    empty = spark.createDataFrame([], "item bigint, rank int, id bigint, score bigint")
    found = []
    for number in range(groups):
        share = wanted.where(F.pmod(F.xxhash64("item"), F.lit(groups)) == number)
        group = [(r["item"], [bytes(t) for t in r["terms"]]) for r in share.collect()]
        if not group:
            continue
        best = Window.partitionBy("item_no").orderBy(F.desc("score"), F.asc_nulls_last("id"))
        rows = _rank_group(texts, group, top).withColumn("rank", F.row_number().over(best))
        names = spark.createDataFrame([(k, i) for k, (i, _) in enumerate(group)], "item_no int, item bigint")
        rows = rows.where(F.col("rank") <= top).join(F.broadcast(names), "item_no")
        found.append(rows.select("item", "rank", "id", "score"))
    if not found:
        return empty
    result = found[0]
    for rows in found[1:]:
        result = result.unionAll(rows)
    return result
