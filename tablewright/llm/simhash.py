"""SimHash fingerprints and near-duplicate components by deletion-variant signatures.

Fingerprint: a text is lower-cased (A-Z only) and cut into words at ASCII white
space; XXH64 (seed 42) of every run of ``words`` words, repeats included; a bit of
the fingerprint is one when it is set in over half of the hashes.

Search: fingerprints within ``d`` bits of each other, cut into only ``d // 2 + 1``
parts (two for three bits), agree in one part up to a single bit.  Each distinct
fingerprint is indexed under each part as it is, and under the part with each single
bit wiped out.  Equal signatures give candidates, and the bit count of the whole
decides.

Hot signatures: a signature held by more than ``BUCKET`` fingerprints is not
paired.  Its members are indexed again by the bits that are still free, cut the same
way, until at most ``FREE`` bits are left.  Then a signature has a bounded number of
members by construction (2,048 for three bits), and gives a spanning forest of their
links.  No link is lost on the way and no unbounded group reaches a task.

Components are found by alternating star contractions (each node's neighbours are
attached to its smallest neighbour), every round written to the shared folder.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.functions.columns import col, union_all
from tablewright.llm.common import Scratch, id_and_text, is_small, joinable, scratch, slices, stored, without
from tablewright.session import row_bytes

SEED = 42
DISTANCE = 3
BUCKET = 200
FREE = 8
#: Least number of documents whose shingles are counted to find frequent ones, the count that makes
#: one frequent, and about how many are taken.  They decide the order of shingles, never the result.
ORDER_SAMPLE = 8_000
ORDER_COUNT = 4
ORDER_LIMIT = 200_000
#: Orders in which the members of a shingle of many documents meet, and neighbours of each member in one order.
SEEDS = 4
NEAREST = 4
#: Bytes of the members that go to every task at once, to be tried against all others.
OUTSIDE_BYTES = 16 << 20
_PAIRS_AT_ONCE = 500_000

_BITS_OF_BYTE = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)
_BYTE_PLACES = np.arange(8) * 256
_ROWS_AT_ONCE = 20_000


def fingerprint(text: str, words: int = 3) -> int:
    """Unsigned 64-bit SimHash of a text; zero when it has no word."""
    found = text.encode("utf-8", "replace").lower().split()
    if not found:
        return 0
    line = b" ".join(found)
    count = len(found)
    digest = xxhash.xxh64_intdigest
    if count < words:
        hashes = [digest(line, SEED)]
    else:
        ends = np.cumsum(np.fromiter(map(len, found), np.int64, count) + 1) - 1
        starts = [0, *(ends[: count - words] + 1).tolist()]
        hashes = [digest(line[a:b], SEED) for a, b in zip(starts, ends[words - 1 :].tolist())]
    return _majority(np.array(hashes, np.uint64))


def _majority(hashes: np.ndarray) -> int:
    """The number whose bits are set in over half of the hashes."""
    places = hashes.astype("<u8").view(np.uint8).reshape(-1, 8) + _BYTE_PLACES
    counts = np.bincount(places.ravel(), minlength=2048).reshape(8, 256) @ _BITS_OF_BYTE
    bits = (2 * counts > len(hashes)).astype(np.uint8)
    return int.from_bytes(np.packbits(bits, axis=1).tobytes(), "little")


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """``id`` and ``fp``, the fingerprint as a signed bigint."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            values = [fingerprint(t, words) for t in batch.column("text").to_pylist()]
            found = pa.array(np.array(values, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("id"), found], ["id", "fp"])

    return id_and_text(df, id_col, text_col).mapInArrow(work, "id bigint, fp bigint")


def _bits(value: Column, shift: int, width: int) -> Column:
    mask = -1 if width == 64 else (1 << width) - 1
    return F.shiftrightunsigned(value, shift).bitwiseAND(F.lit(mask))


def _signatures(part: Column, width: int, which: int) -> Column:
    """The part as it is, and with each of its bits wiped out; tagged by part and bit."""
    tag = F.lit(which * 64 + width)
    whole = F.struct(tag.alias("tag"), part.alias("rest"))
    wiped = [
        F.struct(F.lit(which * 64 + bit).alias("tag"), part.bitwiseAND(F.lit(~(1 << bit))).alias("rest"))
        for bit in range(width)
    ]
    return F.array(whole, *wiped)


def _widths(width: int, parts: int) -> list[int]:
    return [width // parts + (i < width % parts) for i in range(parts)]


def _entry(level: int, free: Column, left: int) -> Callable[[Column], Column]:
    return lambda s: F.struct(
        s["tag"].alias(f"t{level}"),
        s["rest"].alias(f"r{level}"),
        free.alias("free"),
        F.lit(left).alias("left"),
    )


def _indexed(members: DataFrame, keys: list[str], level: int, width: int, parts: int) -> DataFrame:
    """Index members under the signatures of the parts of ``free``, their free bits.

    The new key is ``(tN, rN)``; ``free`` and ``left`` become the bits outside the part.
    """
    free = F.col("free")
    entries, shift = [], 0
    for i, own in enumerate(_widths(width, parts)):
        others = _bits(free, 0, shift)
        if shift + own < width:
            above = F.shiftrightunsigned(free, shift + own)
            others = others.bitwiseOR(F.shiftleft(above, shift))
        entries.append(
            F.transform(
                _signatures(_bits(free, shift, own), own, i),
                _entry(level, others, width - own),
            )
        )
        shift += own
    return members.select("fp", *keys, F.inline(F.concat(*entries)))


def _pairs(indexed: DataFrame, keys: list[str], distance: int) -> DataFrame:
    """Verified links among members with equal signatures, each pair once per signature.

    Spark sizes the signatures like the fingerprints before their explode, and would broadcast them.
    """
    left = indexed.select(F.col("fp").alias("a"), *keys)
    right = indexed.select(F.col("fp").alias("b"), *keys)
    joined = left.join(right.hint("merge"), keys).where("a < b")
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance
    return joined.where(near).select("a", "b")


def _spanning(fps: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Places of links that connect the fingerprints as all links within the distance do."""
    left = np.arange(len(fps))
    found: list[tuple[int, int]] = []
    while len(left):
        frontier, left = [int(left[0])], left[1:]
        while frontier and len(left):
            at = frontier.pop()
            near = np.bitwise_count(fps[left] ^ fps[at]) <= distance
            found += [(at, i) for i in left[near].tolist()]
            frontier += left[near].tolist()
            left = left[~near]
    return found


def _forest(indexed: DataFrame, keys: list[str], distance: int) -> DataFrame:
    """Spanning forest of the links inside each signature: ``a, b``.

    The members of a signature, bounded by the bits that are still free, are held together.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, waiting = None, []
        for batch in chain(batches, [None]):
            if batch is not None:
                waiting.append(batch)
                if sum(b.num_rows for b in waiting) < _ROWS_AT_ONCE:
                    continue
            if held is not None:  # a signature may have gone on
                waiting.insert(0, held)
            held, waiting = pa.concat_batches(waiting) if waiting else None, []
            if held is None or not held.num_rows:
                continue
            change = np.zeros(held.num_rows - 1, bool)
            for key in keys:
                column = held.column(key).to_numpy()
                change |= column[1:] != column[:-1]
            starts = np.r_[0, np.flatnonzero(change) + 1]
            done, held = held, None
            if batch is not None:
                last = int(starts[-1])
                done, held = done.slice(0, last), done.slice(last)
                starts = starts[:-1]
            sizes = np.diff(starts, append=done.num_rows)
            fps = done.column("fp").to_numpy()
            bits = fps.view(np.uint64)
            two = starts[sizes == 2]
            two = two[np.bitwise_count(bits[two] ^ bits[two + 1]) <= distance]
            links = list(zip(two.tolist(), (two + 1).tolist()))
            for start, size in zip(starts[sizes > 2].tolist(), sizes[sizes > 2].tolist()):
                links += [(start + i, start + j) for i, j in _spanning(bits[start : start + size], distance)]
            ends = np.array(links, np.int64).reshape(-1, 2)
            a, b = fps[ends[:, 0]], fps[ends[:, 1]]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    # the smallest fingerprint comes first, so that many signatures agree on their links
    runs = indexed.select("fp", *keys).repartition(*keys).sortWithinPartitions(*keys, "fp")
    return runs.mapInArrow(work, "a bigint, b bigint")


def _index_all(members: DataFrame, keys: list[str], level: int, widths: set[int], parts: int) -> DataFrame:
    tables = [
        _indexed(members.where(F.col("left") == width), keys, level, width, parts) for width in sorted(widths)
    ]
    return union_all(tables)


def links(distinct: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """Links ``a, b`` that connect the distinct fingerprints ``fp`` as all pairs within the distance do."""
    parts = distance // 2 + 1
    tasks = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    members = distinct.select("fp", F.col("fp").alias("free"), F.lit(64).alias("left")).repartition(tasks)
    keys: list[str] = []
    widths, level = {64}, 0
    found: list[DataFrame] = []
    while True:
        indexed = _index_all(members, keys, level, widths, parts)
        keys = [*keys, f"t{level}", f"r{level}"]
        widths = {width - own for width in widths for own in _widths(width, parts)}
        counted = indexed.groupBy(*keys).count().where(F.col("count") > BUCKET)
        hot = stored(counted.select(*keys), "simhash-hot")
        if hot.isEmpty():
            found.append(_pairs(indexed, keys, distance))
            break
        hot = joinable(hot)
        found.append(_pairs(indexed.join(hot, keys, "left_anti"), keys, distance))
        members = indexed.join(hot, keys, "left_semi")
        if max(widths) <= FREE:
            found.append(_forest(members, keys, distance))
            break
        members = stored(members, "simhash-members").repartition(tasks)
        level += 1
    return union_all(found).distinct()


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` for every node of ``edges (a, b)``: the smallest node it reaches.

    Edges with a null end, and of a node with itself, are left out.
    """
    edges = stored(
        edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(),
        "components-0",
    )
    rounds = 0
    while True:
        rounds += 1
        sized = (lambda df: df) if is_small(edges) else (lambda df: df.hint("merge"))
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = (
            both.where("v > u").join(sized(least), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        )
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(sized(lowest), "u")
            .select(F.explode(F.array(F.struct(F.col("v").alias("u"), "m"), F.struct("u", "m"))).alias("e"))
            .select(F.col("e.u").alias("u"), F.col("e.m").alias("v"))
            .where("u <> v")
            .distinct()
        )
        after = stored(small, f"components-{rounds}")
        # done when every node hangs on one root and no root hangs on another
        loose = (
            after.groupBy("u")
            .count()
            .where("count > 1")
            .select("u")
            .unionByName(after.select(F.col("v").alias("u")).intersect(after.select("u")))
        )
        edges = after
        if loose.isEmpty():
            break
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def near_duplicates(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3
) -> DataFrame:
    """One row per input row: ``id, fp, component_id``.

    ``component_id`` is the smallest id reachable over links of at most three
    differing bits, the row's own included.  Null and blank texts have fingerprint
    zero and link like any other.  Null ids rank after all others.  Repeated rows
    repeat in the result; an empty table gives no rows.
    """
    prints = stored(fingerprints(df, id_col, text_col, words), "simhash-prints")
    distinct = stored(prints.groupBy("fp").agg(F.min("id").alias("least")), "simhash-distinct")
    linked = components(links(distinct)).withColumnRenamed("node", "fp")
    labelled = distinct.join(linked, "fp", "left").withColumn("root", F.coalesce("component", "fp"))
    smallest = labelled.groupBy("root").agg(F.min("least").alias("component_id"))
    of_print = labelled.join(smallest, "root").select("fp", "component_id")
    return prints.join(of_print, "fp").select("id", "fp", "component_id")


def _close_prints(heads: DataFrame) -> DataFrame:
    """Pairs ``a, b`` of ``heads (id, fp)`` whose fingerprints differ in at most ``DISTANCE`` bits.

    Documents of one fingerprint are tied to the first of them, and the first ones of
    linked fingerprints to each other, so that many equal fingerprints stay linear.
    """
    first = stored(heads.groupBy("fp").agg(F.min("id").alias("first")), "simhash-first")
    same = heads.join(joinable(first), "fp").where("id <> first").select(F.col("first").alias("a"), F.col("id").alias("b"))
    ends = links(first.select("fp"))
    ends = ends.join(joinable(first.select(F.col("fp").alias("a"), F.col("first").alias("i"))), "a")
    ends = ends.join(joinable(first.select(F.col("fp").alias("b"), F.col("first").alias("j"))), "b")
    return same.unionByName(ends.select(F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b")))


def shingle_set(text: str, words: int) -> np.ndarray:
    """Distinct hashes of the runs of ``words`` words; of the whole text when it has fewer."""
    found = text.encode("utf-8", "replace").lower().split()
    runs = [b" ".join(found[i : i + words]) for i in range(max(1, len(found) - words + 1))]
    return np.unique(np.array([xxhash.xxh64_intdigest(r, SEED) for r in runs], np.uint64)).view(np.int64)


#: Hashes of frequent shingles, sorted, and how frequent each is: they come last, the most frequent at the end.
Order = tuple[np.ndarray, np.ndarray]


def _frequent_first_out(counted: DataFrame, keep: Scratch) -> Order:
    """The order that ``counted (h, count)`` asks for, of about its ``ORDER_LIMIT`` most frequent shingles.

    Numbers of shingles by frequency say which these are, and no others reach the driver (a sort with a
    limit would send that many from each task).  Of the last frequency the leading bits of the hash decide.
    """
    counted = keep(counted.select("h", "count"), "counted")
    if counted.count() > ORDER_LIMIT:
        # each frequency up to 4,096 by itself, above in 256 steps for each doubling
        above = (4096 + 256 * F.log2(F.col("count") / 4096)).cast("bigint")
        step = F.when(F.col("count") < 4096, F.col("count")).otherwise(above)
        steps = counted.groupBy(step.alias("step")).agg(F.count("*").alias("rows")).collect()  # some 10,000 at most
        last, room = 0, ORDER_LIMIT
        for last, rows in sorted(map(tuple, steps), reverse=True):
            if rows > room:
                break
            room -= rows
        leading = F.shiftrightunsigned("h", 48) < room * (1 << 16) // rows
        counted = counted.where((step > last) | ((step == last) & leading))
    found = counted.toArrow()
    late, counts = (found.column(name).to_numpy() for name in ("h", "count"))
    order = np.argsort(late)
    return late[order], counts[order]


def _sampled_order(texts: DataFrame, words: int, keep: Scratch) -> Order:
    """Frequent shingles of a sample of ``texts (id, text)``, large enough to hold
    most of those that over ``BUCKET`` documents share."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            for text in batch.column("text").to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(shingle_set(text, words))], ["h"])

    share = min(1.0, max(ORDER_SAMPLE / max(1, texts.count()), 2 * ORDER_COUNT / BUCKET))
    sample = texts.where(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < int(share * 1_000_000))
    counted = sample.mapInArrow(work, "h bigint").groupBy("h").count().where(F.col("count") >= ORDER_COUNT)
    return _frequent_first_out(counted, keep)


def _prefixes(whole: np.ndarray, sizes: np.ndarray, similarity: float, order: Order) -> tuple[np.ndarray, np.ndarray]:
    """The first shingles of each set, so many that two sets of the similarity share one, and their numbers.

    ``whole`` holds the sets one after another, each sorted.
    """
    late, counts = order
    of = np.repeat(np.arange(len(sizes)), sizes)
    if len(late):
        at = np.minimum(np.searchsorted(late, whole), len(late) - 1)
        frequent = np.where(late[at] == whole, counts[at], 0)
        whole = whole[np.lexsort((frequent, of))]  # stable: equally frequent ones stay in order of their hashes
    taken = np.clip(sizes - np.ceil(similarity * sizes - 1e-9).astype(np.int64) + 1, 1, sizes)
    place = np.arange(len(whole)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    return whole[place < taken[of]], taken


def _lists(values: np.ndarray, sizes: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)], pa.int32()), pa.array(values))


def marks_of(shingles: np.ndarray) -> bytes:
    """Parity marks: each shingle flips one of two to four times as many bits as there are shingles.

    Two sets differ in at least as many shingles as their marks do in bits.  The marks
    of a larger set, folded in half, are what the set would have in half as many bits.
    """
    bits = max(64, 2 << (len(shingles) - 1).bit_length())
    flips = np.bincount(shingles & (bits - 1), minlength=bits) & 1
    return np.packbits(flips.astype(np.uint8), bitorder="little").tobytes()


def marks_apart(a: bytes, b: bytes) -> int:
    """Least number of shingles in which two sets with these marks differ."""
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    while len(x) > len(y):
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


def _shingle_rows(texts: DataFrame, words: int, similarity: float, order: Order | None) -> DataFrame:
    """``id, n, d1, d2`` (size and digest of the shingle set), ``fp`` (fingerprint), ``marks`` and ``shingles``.

    With an ``order`` the shingles are only the first ones, see ``_prefixes``.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = batch.column("text").to_pylist()
            sets = [shingle_set(t, words) for t in texts]
            prints = [fingerprint(t, words) if order is not None else 0 for t in texts]
            sizes = np.array([len(s) for s in sets], np.int64)
            digests = np.array(
                [[xxhash.xxh64_intdigest(s.tobytes(), seed) for seed in (1, 2)] for s in sets], np.uint64
            ).view(np.int64).reshape(-1, 2)
            whole, taken = np.concatenate([np.zeros(0, np.int64), *sets]), sizes
            if order is not None:
                whole, taken = _prefixes(whole, sizes, similarity, order)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id"),
                    pa.array(sizes, pa.int32()),
                    pa.array(np.ascontiguousarray(digests[:, 0])),
                    pa.array(np.ascontiguousarray(digests[:, 1])),
                    pa.array(np.array(prints, np.uint64).view(np.int64)),
                    pa.array([marks_of(s) for s in sets], pa.binary()),
                    _lists(whole, taken),
                ],
                ["id", "n", "d1", "d2", "fp", "marks", "shingles"],
            )

    kinds = "id bigint, n int, d1 bigint, d2 bigint, fp bigint, marks binary, shingles array<bigint>"
    return texts.mapInArrow(work, kinds)


def _ordered_anew(sets: DataFrame, similarity: float, order: Order) -> DataFrame:
    """``id, n, shingles`` of whole sets, cut to the first shingles of another order."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("shingles")
            sizes = lists.value_lengths().to_numpy().astype(np.int64)
            whole, taken = _prefixes(lists.flatten().to_numpy(), sizes, similarity, order)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("n"), _lists(whole, taken)], ["id", "n", "shingles"])

    return sets.select("id", "n", "shingles").mapInArrow(work, "id bigint, n int, shingles array<bigint>")


def _sharing(heads: DataFrame, similarity: float) -> DataFrame:
    """Distinct pairs ``a, b`` of ``heads (id, n, shingles)`` that share a shingle, whose sizes and the
    shingle's place in both allow the similarity.  All members of a shingle of more than
    ``BUCKET`` come as ``h, a, pos`` instead.

    The first shingle that two sets share has all others behind it in both, so at least
    one shared shingle of a pair of the similarity passes.
    """
    schema = "h bigint, a bigint, b bigint, pos int"
    share = similarity / (1 + similarity)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, hot_key, waiting = None, None, []
        for batch in chain(batches, [None]):
            if batch is not None:
                waiting.append(batch)
                if sum(b.num_rows for b in waiting) < _ROWS_AT_ONCE:
                    continue
            waiting = [held, *waiting] if held is not None else waiting
            held = None
            if not waiting:
                continue
            rows = pa.concat_batches(waiting)
            waiting = []
            if not rows.num_rows:
                continue
            h, ids, n, pos = (rows.column(c).to_numpy() for c in ("h", "id", "n", "pos"))
            starts = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
            sizes = np.diff(starts, append=len(h))
            hot = sizes > BUCKET
            hot[0] |= hot_key is not None and h[0] == hot_key
            hot_key = h[-1] if hot[-1] else None
            if batch is not None and not hot[-1]:  # the last shingle may go on
                held = rows.slice(int(starts[-1]))
                starts, sizes, hot = starts[:-1], sizes[:-1], hot[:-1]
            if hot.any():
                at = np.flatnonzero(np.repeat(hot, sizes))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h[at]), pa.array(ids[at]), pa.nulls(len(at), pa.int64()), pa.array(pos[at])],
                    ["h", "a", "b", "pos"],
                )
            for size in np.unique(sizes[~hot & (sizes > 1)]):
                begin = starts[~hot & (sizes == size)]
                i, j = np.triu_indices(int(size), 1)
                step = max(1, _PAIRS_AT_ONCE // len(i))
                for k in range(0, len(begin), step):
                    left = (begin[k : k + step, None] + i).ravel()
                    right = (begin[k : k + step, None] + j).ravel()
                    fits = np.minimum(n[left], n[right]) >= similarity * np.maximum(n[left], n[right]) - 1e-9
                    common = np.minimum(n[left] - pos[left], n[right] - pos[right])
                    fits &= common >= share * (n[left] + n[right]) - 1e-9
                    fits &= ids[left] != ids[right]
                    both = np.unique(np.stack([ids[left[fits]], ids[right[fits]]], 1), axis=0)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.nulls(len(both), pa.int64()),
                            pa.array(both[:, 0].copy()),
                            pa.array(both[:, 1].copy()),
                            pa.nulls(len(both), pa.int32()),
                        ],
                        ["h", "a", "b", "pos"],
                    )

    entries = heads.select(F.posexplode("shingles").alias("pos", "h"), "id", "n")
    runs = entries.repartition("h").sortWithinPartitions("h", "id")
    return runs.mapInArrow(work, schema).distinct()


def _only(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """``rows`` of the distinct ``ids``, so that no others travel; all rows when the ids are too many to broadcast."""
    return rows.join(F.broadcast(ids), "id", "left_semi") if is_small(ids) else rows


def _with_ends(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """``pairs (a, b)`` with the other columns of ``rows (id, ...)`` as ``c_a`` and ``c_b``."""
    rows = _only(rows, pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct())
    columns = [c for c in rows.columns if c != "id"]
    side = lambda name: rows.select(F.col("id").alias(name), *[F.col(c).alias(f"{c}_{name}") for c in columns])
    small = F.broadcast(pairs) if is_small(pairs) else pairs
    return small.join(side("b"), "b").join(side("a"), "a")


def _possible(pairs: DataFrame, marks: DataFrame, similarity: float) -> DataFrame:
    """Those of the stored pairs ``a, b`` whose ``marks (id, n, marks)`` allow the similarity; none is lost."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = (batch.column("n_a").to_numpy() + batch.column("n_b").to_numpy()).astype(np.int64)
            most = both * ((1 - similarity) / (1 + similarity)) + 1e-6
            apart = map(marks_apart, batch.column("marks_a").to_pylist(), batch.column("marks_b").to_pylist())
            keep = np.fromiter(apart, np.int64, batch.num_rows) <= most
            yield pa.RecordBatch.from_arrays(
                [batch.column(c).filter(pa.array(keep)) for c in ("a", "b")], ["a", "b"]
            )

    known = _with_ends(pairs, marks.select("id", "n", "marks"))
    return known.select("a", "b", "n_a", "n_b", "marks_a", "marks_b").mapInArrow(work, "a bigint, b bigint")


def _measured(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The stored pairs ``a, b`` and the similarity ``s`` of their whole sets."""
    common = F.size(F.array_intersect("shingles_a", "shingles_b"))
    share = common / (F.size("shingles_a") + F.size("shingles_b") - common)
    return _with_ends(pairs, sets.select("id", "shingles")).select("a", "b", share.alias("s"))


def _neighbours(hot: DataFrame, known: DataFrame, seed: int, similarity: float) -> DataFrame:
    """Distinct pairs ``a, b`` of members of one shingle of ``hot (h, id, pos)`` that are next to each other
    in an order that brings like sets together, and whose marks allow the similarity.

    Each member is tried against ``NEAREST`` others, so this is linear.  Members of a
    shingle are ordered by the least mixed hash of their sets, ``key{seed}`` of ``known``.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tail: list[tuple[int, int, int, bytes]] = []
        for batch in batches:
            rows = tail + list(zip(*(batch.column(c).to_pylist() for c in ("h", "id", "n", "marks"))))
            found = []
            for i in range(len(tail), len(rows)):
                h, b, n, marks = rows[i]
                for g, a, m, others in rows[max(0, i - NEAREST) : i]:
                    if g == h and a != b and min(m, n) >= similarity * max(m, n) - 1e-9:
                        most = (m + n) * ((1 - similarity) / (1 + similarity)) + 1e-6
                        if marks_apart(marks, others) <= most:
                            found.append((min(a, b), max(a, b)))
            tail = rows[-NEAREST:]
            pairs = np.array(sorted(set(found)), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], ["a", "b"])

    order = ["h", f"key{seed}", "id"]
    rows = joinable(hot).join(known, "id").select(*order, "n", "marks").repartitionByRange(*order).sortWithinPartitions(*order)
    return rows.mapInArrow(work, "a bigint, b bigint").distinct()


def _keys(sets: DataFrame) -> DataFrame:
    """``id`` and, for each of ``SEEDS`` mixings of the hashes, the least one of the set."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        draw = np.random.default_rng(SEED)
        factors = [np.int64(f | 1) for f in draw.integers(-(1 << 62), 1 << 62, SEEDS)]
        for batch in batches:
            lists = batch.column("shingles")
            sizes, whole = lists.value_lengths().to_numpy(), lists.flatten().to_numpy()
            begins = (np.cumsum(sizes) - sizes).astype(np.int64)
            mixed = [np.minimum.reduceat(whole * f, begins) if len(whole) else whole for f in factors]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), *map(pa.array, mixed)], ["id", *(f"key{k}" for k in range(SEEDS))]
            )

    columns = ", ".join(f"key{k} bigint" for k in range(SEEDS))
    return sets.select("id", "shingles").mapInArrow(work, f"id bigint, {columns}")


def _folds(marks: bytes) -> dict[int, np.ndarray]:
    """Marks as they are and folded once, by their number of words."""
    words = np.frombuffer(marks, np.uint64)
    half = len(words) // 2
    return {len(words): words, **({half: words[:half] ^ words[half:]} if half else {})}


def _by_marks(asked: pa.Table) -> dict[int, tuple[np.ndarray, ...]]:
    """Columns of ``asked (h, id, n, pos, g, marks)`` in order of ``h``, by the number of words of the
    marks, which come as they are and folded once."""
    columns = [asked.column(c).to_numpy().astype(np.int64) for c in ("h", "id", "n", "pos", "g")]
    marks = asked.column("marks").to_pylist()
    lengths = np.fromiter(map(len, marks), np.int64, len(marks)) // 8
    parts: dict[int, list] = {}
    for size in np.unique(lengths).tolist():
        at = np.flatnonzero(lengths == size)
        words = np.frombuffer(b"".join(marks[i] for i in at.tolist()), np.uint64).reshape(len(at), size)
        parts.setdefault(size, []).append((at, words))
        if half := size // 2:
            parts.setdefault(half, []).append((at, words[:, :half] ^ words[:, half:]))
    found = {}
    for size, own in parts.items():
        at, words = (np.concatenate(x) for x in zip(*own))
        order = np.argsort(columns[0][at], kind="stable")
        found[size] = (*(c[at[order]] for c in columns), words[order])
    return found


def _tried(rows: DataFrame, shared: Broadcast, similarity: float) -> DataFrame:
    """Pairs ``a, b`` of ``rows (h, id, n, pos, g, marks)`` and the ``shared`` ones of ``_by_marks`` that
    share ``h`` but not ``g``, and whose sizes, places and marks allow the similarity."""
    share, apart = similarity / (1 + similarity), (1 - similarity) / (1 + similarity)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for batch in batches:
            found = set()
            h = batch.column("h").to_numpy()
            ids, ns, places, groups = (batch.column(c).to_numpy().tolist() for c in ("id", "n", "pos", "g"))
            folds = [_folds(m) for m in batch.column("marks").to_pylist()]
            for size, (hs, *others, marks) in table.items():
                begins, ends = hs.searchsorted(h, "left"), hs.searchsorted(h, "right")
                for k in np.flatnonzero(begins < ends).tolist():
                    words = folds[k].get(size)
                    if words is None:
                        continue
                    own = slice(begins[k], ends[k])
                    their, m, pos, g = (c[own] for c in others)
                    fits = (np.minimum(m, ns[k]) >= similarity * np.maximum(m, ns[k]) - 1e-9) & (g != groups[k])
                    fits &= np.minimum(m - pos, ns[k] - places[k]) >= share * (m + ns[k]) - 1e-9
                    at = np.flatnonzero(fits)
                    differ = np.bitwise_count(marks[own][at] ^ words).sum(axis=1)
                    for j in their[at[differ <= (m[at] + ns[k]) * apart + 1e-6]].tolist():
                        found.add((min(ids[k], j), max(ids[k], j)))
            pairs = np.array(sorted(found), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], ["a", "b"])

    return rows.select("h", "id", "n", "pos", "g", "marks").mapInArrow(work, "a bigint, b bigint")


def _hot_links(
    hot: DataFrame, sets: DataFrame, marks: DataFrame, links: DataFrame, similarity: float, keep: Scratch
) -> DataFrame:
    """``links (a, b)`` and more of them, which connect the members of every shingle of
    ``hot (h, id, pos)`` as all its pairs of the similarity do.

    First each member is measured against its neighbours in several orders, which ties
    the many copies of one text together.  Then all members of a shingle that
    are not in its largest group so far are tried against the members of other
    groups, in blocks of ``OUTSIDE_BYTES``: what sizes, places of the shingle and marks
    allow is measured, and nothing is left untried.
    """
    if hot.isEmpty():
        return links
    members = hot.select("id").distinct()
    known = keep(_only(marks, members).join(_keys(_only(sets, members)), "id"), "keys")
    for seed in range(SEEDS):
        near = keep(_neighbours(hot, known, seed, similarity).join(joinable(links), ["a", "b"], "left_anti"), "near")
        linked = _measured(near, sets).where(F.col("s") >= similarity).select("a", "b")
        links = keep(links.unionByName(linked), "links")
    group = components(links)
    labelled = hot.join(joinable(group), hot["id"] == group["node"], "left").join(joinable(known.select("id", "n")), "id")
    labelled = keep(labelled.select("h", "id", "n", "pos", F.coalesce("component", "id").alias("g")), "labelled")
    largest = labelled.groupBy("h", "g").count().groupBy("h").agg(F.max_by("g", F.struct("count", "g")).alias("main"))
    labelled = labelled.join(known.select("id", "marks"), "id")
    outside = keep(labelled.join(largest, "h").where("g <> main").drop("main"), "outside")
    blocks = -(-(outside.agg(F.sum(row_bytes(outside))).first()[0] or 0) // OUTSIDE_BYTES)
    for block in range(blocks):
        asked = outside.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == block)
        shared = asked.sparkSession.sparkContext.broadcast(_by_marks(asked.toArrow()))
        rest = _tried(labelled, shared, similarity).distinct()
        rest = keep(rest.join(joinable(links), ["a", "b"], "left_anti"), "rest")
        linked = _measured(rest, sets).where(F.col("s") >= similarity).select("a", "b")
        links = links.unionByName(keep(linked, "linked"))
        shared.destroy()
    return links


def similar_documents(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, similarity: float = 0.8
) -> DataFrame:
    """``id, keep_id`` of the documents that are not the first of their group.

    Two documents link when the Jaccard similarity of their sets of ``words``-word
    shingles is at least ``similarity``; a group is all that links reach, and
    ``keep_id`` its smallest id.  Candidates are first the documents whose SimHash fingerprints
    (of the same shingles) are at most ``DISTANCE`` bits apart, found as in
    ``near_duplicates``.  What fingerprints cannot see is added exactly: in any fixed order of shingles, two
    such sets share one of their first ``n - ceil(similarity * n) + 1``, so no link is missed.  Documents of
    equal sets count once.  Pairs that share such a shingle, and whose sizes, marks and
    places of the shingle allow it, are measured on the whole sets.

    Documents that share a shingle with over ``BUCKET`` others there are ordered anew, by
    how frequent shingles are among these documents alone, as long as that leaves at
    most half of them; the rest is solved by ``_hot_links``.

    Blank texts are alike.  Rows without an id are left alone; rows of one id are one
    document, of which the smaller set counts.  An empty table gives no rows.
    Intermediate tables are deleted before the result is returned.
    """
    with scratch(df.sparkSession) as keep:
        texts = id_and_text(df, id_col, text_col).where("id is not null")
        of_set = ["n", "d1", "d2"]
        heads = keep(_shingle_rows(texts, words, similarity, _sampled_order(texts, words, keep)), "heads")
        own = heads.groupBy("id").agg(F.min(F.struct(*of_set)).alias("own")).select("id", "own.*")
        own = keep(own, "own")
        repeated = heads.count() != own.count()
        least = keep(own.groupBy(*of_set).agg(F.min("id").alias("keep")), "distinct")
        equal = own.join(joinable(least), of_set).where("id <> keep").select(F.col("keep").alias("a"), F.col("id").alias("b"))
        equal = keep(equal, "equal")
        spare = equal.select(F.col("b").alias("id"))  # stands for the set already: far fewer than those that stay
        spare = joinable(spare, equal)

        def once(rows: DataFrame) -> DataFrame:
            if repeated:
                rows = rows.join(joinable(own), ["id", *of_set], "left_semi").dropDuplicates(["id"])
            return rows.join(spare, "id", "left_anti")

        def whole_sets(ids: DataFrame, name: str) -> DataFrame:
            wanted = texts.join(joinable(ids), "id", "left_semi")
            return keep(once(_shingle_rows(wanted, words, similarity, None)).select("id", "n", "shingles"), name)

        marks = once(heads).select("id", "n", "marks")
        sharing = keep(_sharing(once(heads), similarity), "sharing")
        alike = [_close_prints(once(heads).select("id", "fp")), sharing.where("b is not null").select("a", "b")]
        hot = sharing.where("b is null").select("h", F.col("a").alias("id"), "pos")
        before, now = None, hot.count()
        while now and (before is None or 2 * now <= before):
            sets = whole_sets(keep(hot.select("id").distinct(), "hot-members"), "hot-sets")
            counted = sets.select(F.explode("shingles").alias("h")).groupBy("h").count()
            order = _frequent_first_out(counted.where(F.col("count") > 1), keep)
            sharing = keep(_sharing(_ordered_anew(sets, similarity, order), similarity), "sharing")
            alike.append(sharing.where("b is not null").select("a", "b"))
            hot = sharing.where("b is null").select("h", F.col("a").alias("id"), "pos")
            before, now = now, hot.count()
        ends = [F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")]
        candidates = keep(union_all(alike).select(*ends).distinct(), "candidates")
        pairs = keep(_possible(candidates, marks, similarity), "pairs")
        members = pairs.select(F.explode(F.array("a", "b")).alias("id")).unionByName(hot.select("id"))
        sets = whole_sets(keep(members.distinct(), "members"), "sets")
        links = keep(_measured(pairs, sets).where(F.col("s") >= similarity).select("a", "b"), "links")
        links = _hot_links(hot, sets, marks, links, similarity, keep)
        found = components(links.unionByName(equal)).where("node <> component")
        return stored(found.select(F.col("node").alias("id"), F.col("component").alias("keep_id")), "near-copies")


def keep_one_of_each(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, similarity: float = 0.8
) -> DataFrame:
    """``df`` with all its columns, less the rows of ``similar_documents``.

    Rows that share an id go together, whatever their texts.
    """
    found = similar_documents(df, id_col, text_col, words, similarity)
    dropped = stored(found.select("id").distinct(), "near-dropped")
    return without(df, dropped, {"id": col(id_col).cast("bigint")})
