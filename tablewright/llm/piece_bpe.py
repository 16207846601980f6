"""SentencePiece BPE encoding by vectorised merge rounds, and decoding.

The distinct spans of a slice of texts lie in flat symbol arrays.  Every round finds
the smallest pair rank of each span by a segmented minimum, merges all leftmost
non-overlapping pairs of that rank at once, and drops finished spans from the
arrays, until no pair remains.

The library merges one pair at a time: smallest rank first, leftmost on ties.  A
round gives the same result unless one of its merges, done alone or with the
others, creates a pair of equal or smaller rank, which would be due before the rest
of the round.  Spans where that happens merge only their leftmost pair.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from tablewright.llm.common import SpanMemory, id_and_text, slices
from tablewright.llm.piece_model import BYTE, CONTROL, SPACE, UNKNOWN, PieceModel, load

#: Distinct spans that a worker remembers; beyond it the memory starts anew.
MEMORY = 300_000
NO_RANK = np.int32(2**31 - 1)


class PairTable:
    """Rank and merged symbol of every pair of symbols that forms a piece.

    A symbol is a piece id, or the vocabulary size plus the code point for a
    character that is no piece.
    """

    def __init__(self, model: PieceModel):
        self.size = len(model.pieces)
        self.of_char = np.arange(self.size, self.size + 0x110000, dtype=np.int64)
        for piece, i in model.ids.items():
            if len(piece) == 1:
                self.of_char[ord(piece)] = i
        pairs = {}
        for piece, i in model.ids.items():
            for cut in range(1, len(piece)):
                left, right = self._symbol(model, piece[:cut]), self._symbol(model, piece[cut:])
                if left is not None and right is not None:
                    pairs[(left << 32) | right] = (model.ranks[piece], i)
        self.keys = np.array(sorted(pairs) or [-1], np.int64)
        self.ranks = np.array([pairs[k][0] for k in sorted(pairs)] or [NO_RANK], np.int32)
        self.merged = np.array([pairs[k][1] for k in sorted(pairs)] or [0], np.int64)

    def _symbol(self, model: PieceModel, part: str) -> int | None:
        found = model.ids.get(part)
        return found if found is not None or len(part) > 1 else int(self.of_char[ord(part)])

    def look_up(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        wanted = (left << 32) | right
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        hit = self.keys[at] == wanted
        return np.where(hit, self.ranks[at], NO_RANK), self.merged[at]


def _leftmost(chosen: np.ndarray) -> np.ndarray:
    """Of neighbouring chosen pairs, every second one from the left."""
    at = np.flatnonzero(chosen)
    first = np.ones(len(at), bool)
    first[1:] = at[1:] != at[:-1] + 1
    run_start = at[np.maximum.accumulate(np.where(first, np.arange(len(at)), 0))]
    return at[(at - run_start) % 2 == 0]


def merge_rounds(spans: list[str], model: PieceModel, table: PairTable) -> tuple[np.ndarray, np.ndarray]:
    """Token ids of all spans in one array, and the number of ids of each span."""
    lengths = np.fromiter(map(len, spans), np.int64, len(spans))
    codes = np.frombuffer("".join(spans).encode("utf-32-le", "surrogatepass"), "<u4")
    symbols = table.of_char[codes]
    owner = np.repeat(np.arange(len(spans), dtype=np.int32), lengths)
    ranks, into = np.full(len(symbols), NO_RANK), np.zeros(len(symbols), np.int64)
    inner = np.flatnonzero(owner[1:] == owner[:-1])
    ranks[inner], into[inner] = table.look_up(symbols[inner], symbols[inner + 1])
    done: list[tuple[np.ndarray, np.ndarray]] = []
    while len(symbols):
        first = np.ones(len(symbols), bool)
        np.not_equal(owner[1:], owner[:-1], out=first[1:])
        starts = np.flatnonzero(first)
        sizes = np.diff(starts, append=len(symbols))
        least = np.minimum.reduceat(ranks, starts)
        open_spans = least != NO_RANK
        if not open_spans.all():
            stay = np.repeat(open_spans, sizes)
            done.append((owner[~stay], symbols[~stay]))
            symbols, owner, ranks, into = symbols[stay], owner[stay], ranks[stay], into[stay]
            sizes, least = sizes[open_spans], least[open_spans]
            if not len(symbols):
                break
        due = np.repeat(least, sizes)
        chosen = _leftmost(ranks == due)
        while True:
            keep = np.ones(len(symbols), bool)
            keep[chosen + 1] = False
            here = chosen - np.arange(len(chosen))  # where the merged symbols move to
            new_symbols, new_owner, new_due = symbols[keep], owner[keep], due[keep]
            new_ranks, new_into = ranks[keep], into[keep]
            new_symbols[here] = into[chosen]
            touched = np.concatenate([here[here < len(new_symbols) - 1], here[here > 0] - 1])
            new_ranks[here] = NO_RANK
            new_ranks[here[here > 0] - 1] = NO_RANK
            paired = touched[new_owner[touched] == new_owner[touched + 1]]
            new_ranks[paired], new_into[paired] = table.look_up(new_symbols[paired], new_symbols[paired + 1])
            early = new_owner[paired[new_ranks[paired] <= new_due[paired]]]
            # where two merges touch, the first would have met the second's left symbol
            of = owner[chosen]
            close = np.flatnonzero((chosen[1:] == chosen[:-1] + 2) & (of[1:] == of[:-1]))
            met, _ = table.look_up(into[chosen[close]], symbols[chosen[close] + 2])
            early = np.concatenate([early, of[close[met <= due[chosen[close]]]]])
            if not len(early):
                break
            # sequential order in these spans: only the leftmost pair, then a fresh look
            fewer = chosen[np.r_[True, of[1:] != of[:-1]] | ~np.isin(of, early)]
            if len(fewer) == len(chosen):
                break
            chosen = fewer
        symbols, owner, ranks, into = new_symbols, new_owner, new_ranks, new_into

    owner = np.concatenate([o for o, _ in done]) if done else np.zeros(0, np.int64)
    symbols = np.concatenate([s for _, s in done]) if done else np.zeros(0, np.int64)
    order = np.argsort(owner, kind="stable")
    owner, symbols = owner[order], symbols[order]
    unknown = np.flatnonzero(symbols >= table.size)
    if len(unknown):
        raw = [chr(c).encode("utf-8", "surrogatepass") for c in (symbols[unknown] - table.size).tolist()]
        counts = np.ones(len(symbols), np.int64)
        counts[unknown] = [len(b) for b in raw]
        begin = np.cumsum(counts) - counts
        symbols, owner = np.repeat(symbols, counts), np.repeat(owner, counts)
        for at, data in zip(begin[unknown].tolist(), raw):
            symbols[at : at + len(data)] = [model.byte_ids[b] for b in data]
    return symbols.astype(np.int32), np.bincount(owner, minlength=len(spans))


class Encoder:
    """Encodes slices of texts, remembering the spans it has seen."""

    def __init__(self, path: str):
        self.model = load(path)
        self.table = PairTable(self.model)
        self._ids_of = SpanMemory(self._learn, MEMORY)

    def _learn(self, keys: list[str]) -> tuple[np.ndarray, np.ndarray]:
        return merge_rounds([self.model.symbols(k) for k in keys], self.model, self.table)

    def encode(self, texts: list[str], end_id: int | None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in one array, and where each text ends in it."""
        ids, ends = self._ids_of([self.model.keys(t) for t in texts])
        if end_id is None:
            return ids, ends
        return np.insert(ids, ends, end_id), ends + np.arange(1, len(texts) + 1)


class Decoder:
    """Turns ids back into text, as the library's ``decode`` does."""

    def __init__(self, path: str):
        model = load(path)
        self.data: list[bytes] = []
        for piece, kind in zip(model.pieces, model.kinds):
            if kind == CONTROL:
                self.data.append(b"")
            elif kind == UNKNOWN:
                self.data.append(model.unk_surface.encode())
            elif kind == BYTE:
                self.data.append(bytes([int(piece[3:5], 16)]))
            else:
                self.data.append(piece.replace(SPACE, " ").encode())
        self.control = np.array([kind == CONTROL for kind in model.kinds])
        self.spaced = np.array([piece.startswith(SPACE) for piece in model.pieces])

    def decode(self, ids: np.ndarray, ends: np.ndarray) -> list[str]:
        """Texts of the id sequences that end at ``ends`` in ``ids``."""
        if len(ids) and (ids.min() < 0 or ids.max() >= len(self.data)):
            raise ValueError("token id outside the vocabulary")
        starts = np.r_[0, ends[:-1]] if len(ends) else ends
        silent = np.r_[0, np.cumsum(self.control[ids])]
        inner = silent[np.maximum(ends - 1, starts)] - silent[starts]
        texts = []
        for start, stop, split in zip(starts.tolist(), ends.tolist(), (inner > 0).tolist()):
            own = ids[start:stop]
            parts = [own]
            if split:  # bytes on the two sides of a control token form no character
                parts = np.split(own, np.flatnonzero(self.control[own]))
                own = own[~self.control[own]]
            text = "".join(map(self._text, parts))
            texts.append(text[1:] if len(own) and self.spaced[own[0]] else text)
        return texts

    def _text(self, ids: np.ndarray) -> str:
        data = b"".join(map(self.data.__getitem__, ids.tolist()))
        try:
            return data.decode("utf-8")
        except UnicodeDecodeError:
            return _decode_bytewise(data)


def _decode_bytewise(data: bytes) -> str:
    """UTF-8 with one replacement character for each byte that belongs to no character."""
    out, at = [], 0
    while at < len(data):
        width = next((n for n in (1, 2, 3, 4) if _is_character(data[at : at + n])), 0)
        out.append(data[at : at + width].decode() if width else "�")
        at += width or 1
    return "".join(out)


def _is_character(data: bytes) -> bool:
    try:
        return len(data.decode("utf-8")) == 1
    except UnicodeDecodeError:
        return False


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """The encoder that this worker keeps for a model file."""
    return Encoder(path)


@functools.lru_cache(maxsize=2)
def decoder(path: str) -> Decoder:
    return Decoder(path)


def encode_texts(
    df: DataFrame,
    model_path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    end_id: bool = True,
    decode: bool = False,
) -> DataFrame:
    """One row per input row: ``id`` and ``ids``, the token ids of the whole text.

    ``end_id`` appends the model's end id; ``decode`` adds ``decoded``, the text that
    the ids give back.  Null text counts as empty and has the end id alone.  Ids may
    be null or repeat; an empty table gives no rows.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool, back = encoder(model_path), decoder(model_path)
        end = tool.model.end_id if end_id else None
        for batch in slices(batches):
            ids, ends = tool.encode(batch.column("text").to_pylist(), end)
            lists = pa.ListArray.from_arrays(pa.array(np.r_[0, ends], pa.int32()), pa.array(ids))
            columns = {"id": batch.column("id"), "ids": lists}
            if decode:
                columns["decoded"] = pa.array(back.decode(ids, ends), pa.string())
            yield pa.RecordBatch.from_arrays([*columns.values()], [*columns])

    schema = "id bigint, ids array<int>" + ", decoded string" * decode
    return id_and_text(df, id_col, text_col).mapInArrow(work, schema)


def decode_ids(df: DataFrame, model_path: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """``df`` with its ids turned back into text; null ids give null.

    An output column that ``df`` already has is replaced.
    """
    kept = [c for c in df.columns if c != out_col]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name in kept)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = decoder(model_path)
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                lists = part.column(ids_col)
                ends = np.cumsum(pc.list_value_length(lists).fill_null(0).to_numpy(), dtype=np.int64)
                texts = pa.array(tool.decode(lists.flatten().to_numpy(), ends), pa.string())
                texts = pc.if_else(lists.is_valid(), texts, None)
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in kept), texts], [*kept, out_col]
                )

    return df.select(*[df[f"`{c}`"] for c in kept]).mapInArrow(work, f"{schema}, `{out_col}` string")
