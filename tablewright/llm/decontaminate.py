"""Benchmark decontamination by templates.

A text becomes a sequence of words in lower case, where numbers, units after numbers
and names (runs of capitalised words inside a sentence) are typed slots.  Windows of
``WINDOW`` words are hashed and joined with those of the benchmark; an item shorter
than that is one window of its own length.  Two things follow a match: in windows
that share an alignment each slot value of the item must stand for one value of the
document, so that "twice the 3 apples plus 3" cannot match "twice the 4 plus 5" (windows
that hold a value with two meanings are left out, unless all their values are the
item's own); and a
document counts as contaminated by an item only when it holds enough of the item's
windows.

Every text is also taken in a plain form in which names are ordinary words, so that
a change of case does not hide a passage.  In that form a window with too few literal
words is an exact one, of the words with their own values.  Scripts that are written
without blanks are cut into characters.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.functions.columns import col
from tablewright.llm.byte_runs import LATIN, MARK, UnitMemory, classes, cut_units, joined
from tablewright.llm.common import id_and_text, is_small, slices, stored, text_or_empty, without

WINDOW = 8
#: Fewest words of a window that are not slots, as a share of the window.
LITERAL_SHARE = 0.5
#: Items with fewer words than this are not searched for.
LEAST_WORDS = 1
#: Share of an item's windows that makes a document contaminated.
LEAST_SHARE = 0.3
#: So many consecutive windows of an item do as well, whatever their share.
LEAST_RUN = 24
#: Bits of each half of the filter that decides inside the scan which windows to join.
FILTER_BITS = 20

# Words that count as numbers, and as units when they follow a number.
NUMBER_WORDS = frozenset(
    "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen "
    "fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy "
    "eighty ninety hundred thousand million billion".split()
)
UNIT_WORDS = frozenset(
    "% ° $ € £ ¥ percent mm cm m km inch inches foot feet ft yard yards mile miles mg g kg "
    "gram grams kilogram kilograms ton tons lb lbs pound pounds oz ounce ounces ml liter "
    "liters litre litres gallon gallons sec second seconds min minute minutes hour hours "
    "day days week weeks month months year years dollar dollars cent cents euro euros mph kmh "
    "km/h m/s degree degrees meter meters metre metres kilometer kilometers kilometre "
    "kilometres kw mw hz khz mhz ghz kb mb gb tb".split()
)

# Scripts without blanks: Thai, Lao, Myanmar, Khmer, Japanese kana, Han.
_UNSPACED = (
    r"\u0e00-\u0e3e\u0e40-\u0eff\u1000-\u109f\u1780-\u17ff\u3005-\u3007\u3040-\u30ff\u31f0-\u31ff"
    r"\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\uff66-\uff9f\U00020000-\U0003ffff"
)
_LETTERS = rf"[^\W\d_{_UNSPACED}]+"
_TOKEN = re.compile(rf"\d+(?:[.,:/]\d+)*|[{_UNSPACED}]|{_LETTERS}(?:['’/]{_LETTERS})*|[%°$€£¥]")
_NUMBER, _CAPITAL, _UNIT, _ENDS, _SYMBOL = 1, 2, 4, 8, 16
_VALUES = np.dtype([("word", "<u8"), ("flags", "u1")])
_BASE = np.uint64(0x9E3779B97F4A7C15)
_EXACT = np.uint64(0xD6E8FEB86659FD93)
#: Words of ASCII letters, Latin-1 letters and marks are cut on their bytes; the pattern cuts the others.
_KINDS = classes(blank="\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f ", other="0123456789'/%$")
_ENDING = np.isin(np.arange(256), [ord(c) for c in ".!?:;"])


def _code(word: str) -> int:
    return xxhash.xxh64_intdigest(word)


_SLOTS = {kind: np.uint64(_code(f"<{kind}>")) for kind in ("number", "unit", "name")}


def _flags(lower: str) -> int:
    flags = _NUMBER if lower[0].isdigit() or lower in NUMBER_WORDS else 0
    return flags | (_UNIT if lower in UNIT_WORDS else 0)


def _learn_runs(runs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Runs of letters in lower case: hash and flags of each."""
    found = [(xxhash.xxh64_intdigest(run), _flags(run.decode())) for run in runs]
    return np.array(found, _VALUES), np.ones(len(runs), np.int64)


def _learn_words(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of each word: hash of the lower-case token, and flags."""
    found: list[tuple[int, int]] = []
    counts = np.zeros(len(words), np.int64)
    for i, word in enumerate(words):
        for raw in word.decode("utf-8", "replace").split():
            end = None
            for match in _TOKEN.finditer(raw):
                token, end = match[0], match.end()
                lower = token.lower()
                flags = _flags(lower) | (_SYMBOL if token in "%°$€£¥" else 0)
                flags |= _CAPITAL if token[0].isupper() and len(token) > 1 else 0
                found.append((_code(lower), flags))
                counts[i] += 1
            if end is not None and any(c in ".!?:;…" for c in raw[end:]):
                found[-1] = (found[-1][0], found[-1][1] | _ENDS)
    return np.array(found, _VALUES), counts


_COLUMNS = ("text", "form", "length", "pos", "hash", "slots", "exact")


class Templates:
    """Template windows of texts, remembering the words of earlier texts."""

    def __init__(self) -> None:
        self._memory = UnitMemory(_learn_runs, _learn_words)

    def _tokens(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Hashes and flags of the tokens of all texts, and where each text ends."""
        data, begins = joined(texts)
        starts, ends, plain, low = cut_units(data, begins, _KINDS)
        mark = plain & (_KINDS[data[starts]] == MARK)
        at = np.flatnonzero(~mark)
        numbers = self._memory.numbers(data, low, starts[at], ends[at], plain[at])
        tokens, before = self._memory.spread(numbers)
        # what depends on the place of a run of letters: a capital, and an end of sentence after it
        tight = np.r_[starts[1:] == ends[:-1], False]  # in one word with the next unit (or at a text's end)
        if len(starts):
            tight[np.searchsorted(starts, begins[1:-1][begins[1:-1] < begins[-1]]) - 1] = False
        ending = np.r_[0, np.cumsum(_ENDING[data[: begins[-1]]])]
        stops = mark & ~tight & (ending[ends] > ending[starts])
        last = tight & np.r_[stops[1:], False]
        first, length = data[starts[at]], (ends - starts)[at]
        latin = first == LATIN
        capital = np.where(latin, (low[starts[at] + 1] != data[starts[at] + 1]) & (length > 2), (first != low[starts[at]]) & (length > 1))
        extra = (capital * _CAPITAL | last[at] * _ENDS) * plain[at]
        tokens["flags"] |= np.repeat(extra, np.diff(before)).astype(np.uint8)
        return tokens, before[np.searchsorted(starts[at], begins[1:])]

    def forms(self, texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """For form 0 (plain) and 1 (names are slots): text index, template code, slot
        value and slot mark of every word; form 1 holds only texts with names."""
        tokens, ends = self._tokens(texts)
        of = np.repeat(np.arange(len(texts)), np.diff(ends, prepend=0))
        flags, word = tokens["flags"], tokens["word"]
        same = np.r_[False, of[1:] == of[:-1]] if len(of) else np.zeros(0, bool)
        has = lambda bit: (flags & bit) > 0
        shifted = lambda mask: np.r_[False, mask[:-1]] & same if len(mask) else mask
        number = has(_NUMBER)
        after_number = shifted(number)
        next_number = np.r_[(number & same)[1:], False] if len(of) else number
        unit = has(_UNIT) & ~number & (after_number | (has(_SYMBOL) & next_number))
        keep = ~has(_SYMBOL) | unit
        starts = ~same | shifted(has(_ENDS))
        name = has(_CAPITAL) & ~starts & ~number & ~unit
        code = np.where(number, _SLOTS["number"], np.where(unit, _SLOTS["unit"], word))
        yield 0, of[keep], code[keep], word[keep], (number | unit)[keep]
        if not name.any():
            return
        named = np.zeros(len(texts), bool)
        named[of[name]] = True
        first = ~(name & shifted(name))  # a run of names is one slot
        value = np.add.reduceat(word, np.flatnonzero(first))
        mask = (keep & named[of])[first]
        yield (
            1,
            of[first][mask],
            np.where(name, _SLOTS["name"], code)[first][mask],
            value[mask],
            (number | unit | name)[first][mask],
        )

    def windows(self, texts: pa.Array, lengths: list[int], accept=None) -> dict[str, list]:
        """Windows of the given lengths: text index, form, length, position, hash, slot values,
        and whether the window is exact (then it has no slots).

        ``accept`` maps hashes to a mask of those to keep.
        """
        out: dict[str, list] = {k: [] for k in _COLUMNS}
        for form, of, code, value, slot in self.forms(texts):
            begin = np.searchsorted(of, np.arange(len(texts)))
            literal = np.r_[0, np.cumsum(~slot)]
            slots_before = np.r_[0, np.cumsum(slot)]
            slot_values = value[slot].view(np.int64)
            for length in lengths:
                count = len(code) - length + 1
                if count <= 0:
                    continue
                hashes = np.full(count, np.uint64(length))
                for j in range(length):
                    hashes = hashes * _BASE + code[j : j + count]
                hashes ^= hashes >> np.uint64(32)  # the low bits depend on all words
                good = of[:count] == of[length - 1 :]
                exact = good & (literal[length:] - literal[:count] < max(3, length * LITERAL_SHARE))
                if form == 0:
                    poor = np.flatnonzero(exact)
                    own = np.full(len(poor), np.uint64(length))
                    for j in range(length):
                        own = own * _BASE + value[poor + j]
                    own ^= _EXACT
                    hashes[poor] = own ^ (own >> np.uint64(32))
                else:
                    good &= ~exact
                if accept is not None:
                    good &= accept(hashes)
                at = np.flatnonzero(good)
                out["text"] += of[at].tolist()
                out["form"] += [form] * len(at)
                out["length"] += [length] * len(at)
                out["pos"] += (at - begin[of[at]]).tolist()
                out["hash"] += hashes[at].view(np.int64).tolist()
                ends = np.where(exact[at], slots_before[at], slots_before[at + length])
                out["slots"] += [slot_values[a:b] for a, b in zip(slots_before[at], ends)]
                out["exact"] += exact[at].tolist()
        return out


_WINDOWS = "id bigint, form int, length int, pos int, hash bigint, slots array<bigint>, words int, exact boolean"
_templates: list[Templates] = []


def _scan(
    rows: DataFrame, lengths: list[int] | None, filters: list[bytes] | None = None, least: int = LEAST_WORDS
) -> DataFrame:
    """Template windows of ``rows (id, text)``; without lengths, of each text's own length
    up to ``WINDOW``, and of none with fewer words than ``least``.  ``words`` is the number of windows of the text in that form."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not _templates:
            _templates.append(Templates())
        tool = _templates[0]
        accept = None
        if filters is not None:
            low, high = (np.unpackbits(np.frombuffer(f, np.uint8)).view(bool) for f in filters)
            mask, shift = np.uint64((1 << FILTER_BITS) - 1), np.uint64(FILTER_BITS)
            accept = lambda h: low[h & mask] & high[(h >> shift) & mask]
        for batch in slices(batches):
            texts, ids = batch.column("text"), batch.column("id")
            if lengths is None:
                found = {k: [] for k in _COLUMNS}
                for i in range(len(texts)):
                    text = texts.slice(i, 1)
                    for form, of, *_ in tool.forms(text):
                        own = tool.windows(text, [min(WINDOW, len(of))]) if len(of) >= least else {}
                        for k, column in own.items():
                            found[k] += [
                                i if k == "text" else x for x, f in zip(column, own["form"]) if f == form
                            ]
            else:
                found = tool.windows(texts, lengths, accept)
            text = np.array(found["text"], np.int64)
            form = np.array(found["form"], np.int32)
            sizes = np.bincount(text * 2 + form, minlength=1) if len(text) else np.zeros(1, np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    ids.take(pa.array(text)),
                    pa.array(form),
                    pa.array(found["length"], pa.int32()),
                    pa.array(found["pos"], pa.int32()),
                    pa.array(found["hash"], pa.int64()),
                    pa.array(found["slots"], pa.list_(pa.int64())),
                    pa.array(sizes[text * 2 + form] if len(text) else [], pa.int32()),
                    pa.array(found["exact"], pa.bool_()),
                ],
                ["id", "form", "length", "pos", "hash", "slots", "words", "exact"],
            )

    return rows.mapInArrow(work, _WINDOWS)


def _filters(items: DataFrame) -> list[bytes]:
    """Two bitmaps of fixed size over the hashes of the benchmark."""
    size = 1 << FILTER_BITS
    bits = [F.col("hash"), F.shiftrightunsigned("hash", FILTER_BITS)]
    maps = []
    for part in bits:
        marked = np.zeros(size, np.uint8)
        places = items.select(part.bitwiseAND(F.lit(size - 1)).cast("int").alias("p")).distinct().toPandas()
        marked[places["p"].to_numpy(np.int64)] = 1  # at most 2**FILTER_BITS rows
        maps.append(np.packbits(marked).tobytes())
    return maps


def contaminated(
    df: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    least_share: float = LEAST_SHARE,
    least_words: int = LEAST_WORDS,
) -> DataFrame:
    """Pairs of a document and a benchmark item that it holds.

    Columns: ``id, item_id, matched`` (windows of the item found), ``windows`` (of
    the item), ``share``, ``same_values`` (every slot has the item's own value).  Exact windows
    count on both sides or, when that gives the larger share, on neither.
    Documents without such an item have no row: it takes ``least_share`` of the windows, or
    ``LEAST_RUN`` consecutive ones.

    Null and blank texts match nothing, on either side; nor do items under
    ``least_words`` words.  Items of one and two words are searched for as exact windows,
    that is wherever their words stand.  Rows of one id are judged together; null ids are one id.
    An empty table on either side gives no rows.
    """
    items = stored(_scan(id_and_text(benchmark, item_col, item_text_col), None, least=max(1, least_words)), "benchmark-windows")
    lengths = sorted(r["length"] for r in items.select("length").distinct().collect())  # at most WINDOW
    place = F.struct("pos", "hash")
    sizes = items.groupBy("id", "form").agg(
        F.countDistinct(place).alias("windows"),
        F.countDistinct(F.when(~F.col("exact"), place)).alias("free_windows"),
    )
    found = _scan(id_and_text(df, id_col, text_col), lengths, _filters(items))
    wanted = items.select(
        F.col("id").alias("item_id"),
        F.col("form").alias("item_form"),
        F.col("pos").alias("item_pos"),
        F.col("slots").alias("item_slots"),
        "hash",
        "length",
        F.col("exact").alias("item_exact"),
    )
    wanted = F.broadcast(wanted) if is_small(items) else wanted
    pairs = F.arrays_zip(F.col("item_slots").alias("i"), F.col("slots").alias("d"))
    runs = (
        found.join(wanted, ["hash", "length"])
        .where((F.size("slots") == F.size("item_slots")) & (F.col("exact") == F.col("item_exact")))
        .groupBy("id", "form", "item_id", "item_form", (F.col("pos") - F.col("item_pos")).alias("shift"))
        .agg(
            F.collect_set(F.struct("item_pos", "hash", "exact", pairs.alias("pairs"))).alias("places"),
            F.array_distinct(F.flatten(F.collect_set(pairs))).alias("pairs"),
        )
    )
    # consistent slots: each value of the item stands for one value of the document
    values = F.transform("pairs", lambda p: p["i"])
    twice = F.filter(F.array_distinct(values), lambda v: F.size(F.filter("pairs", lambda p: p["i"] == v)) > 1)
    runs = runs.withColumn("twice", twice).withColumn(
        "places",
        F.filter(
            "places",
            lambda w: F.forall(w["pairs"], lambda p: p["i"] == p["d"])
            | ~F.exists(w["pairs"], lambda p: F.array_contains("twice", p["i"])),
        ),
    )
    start = F.struct(F.lit(-2).alias("last"), F.lit(0).alias("run"), F.lit(0).alias("longest"))

    def follow(done, pos):
        run = F.when(pos == done["last"] + 1, done["run"] + 1).otherwise(1)
        return F.struct(pos.alias("last"), run.alias("run"), F.greatest(done["longest"], run).alias("longest"))

    positions = F.array_sort(F.array_distinct(F.transform("places", lambda w: w["item_pos"])))
    runs = runs.withColumn("longest", F.aggregate(positions, start, follow, lambda done: done["longest"]))
    differs = F.exists("at.pairs", lambda p: p["i"] != p["d"])
    at = F.struct("at.item_pos", "at.hash")
    matched = (
        runs.select("id", "form", "item_id", "item_form", "longest", F.explode("places").alias("at"))
        .groupBy("id", "form", "item_id", "item_form")
        .agg(
            F.countDistinct(at).alias("matched"),
            F.countDistinct(F.when(~F.col("at.exact"), at)).alias("free_matched"),
            F.max("longest").alias("longest"),
            (~F.bool_or(differs)).alias("same_values"),
        )
    )
    item_sizes = sizes.select(F.col("id").alias("s_id"), F.col("form").alias("s_form"), "windows", "free_windows")
    same_item = F.col("item_id").eqNullSafe(F.col("s_id")) & (F.col("item_form") == F.col("s_form"))
    count = lambda m, w: F.struct(F.col(m).alias("matched"), F.col(w).alias("windows"))
    counts = F.explode(F.array(count("matched", "windows"), count("free_matched", "free_windows")))
    scored = (
        matched.join(item_sizes, same_item)
        .select("id", "item_id", "same_values", "longest", counts.alias("c"))
        .select("id", "item_id", "same_values", "longest", "c.*")
        .where("windows > 0")
        .withColumn("share", F.col("matched") / F.col("windows"))
    )
    best = F.max(F.struct("share", "same_values", "matched", "windows")).alias("best")
    return (
        scored.where((F.col("share") >= least_share) | (F.col("longest") >= LEAST_RUN))
        .groupBy("id", "item_id")
        .agg(best)
        .select("id", "item_id", "best.matched", "best.windows", "best.share", "best.same_values")
    )


def drop_contaminated(
    df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``df`` with all its columns, less the documents that hold a benchmark item.

    Each text is judged by itself: rows that share an id, or have none, go only where
    their own text holds an item.  A row is known by a 64-bit hash of its id and text.
    """
    key = F.xxhash64(col(id_col).cast("bigint"), text_or_empty(text_col))
    rows = df.select(key.alias("key"), text_or_empty(text_col).alias("text"))
    found = stored(contaminated(rows, benchmark, "key").select("id").distinct(), "contaminated")
    return without(df, found, {"id": key})
