"""Toxicity classifier: subword-bag embeddings averaged into a linear softmax.

A word is the bag of its character 3- to 5-grams and itself, each hashed to a row of
an embedding table; its vector is the mean of these rows.  A passage of ``PASSAGE``
words is the mean of its words, and a linear softmax over it gives the two classes.
Embeddings and softmax are trained jointly, in numpy.  Misspelt and inflected words
share n-grams with the words seen in training.

Labels mark whole documents while a few words make them toxic.  So a document's log
odds are those of its passages weighted by a softmax over themselves, which sharpens
from the plain mean to the strongest passage during training; scores use the
strongest passage of all, over the whole text.

Training takes a sample of labelled rows of documented size (``SAMPLE_ROWS`` of each
class, ``SAMPLE_BYTES`` of text in all), in the order of a hash of the id.  Since softmax
and means are linear, a fitted model scores with one number per table row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.functions.columns import col
from tablewright.llm.common import SpanMemory, id_and_text, slices, stored

PASSAGE = 5
GRAMS = (3, 4, 5)
TABLE = 1 << 18
DIMENSIONS = 8
#: Most labelled rows of each class, and bytes of text in all, that training takes.
SAMPLE_ROWS = 1_000
SAMPLE_BYTES = 32 * 1024 * 1024
EPOCHS = 80
RATE = 0.3
DECAY = 0.002
_MEMORY = 300_000
_TRIM = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum()) + "«»“”„‘’…–—¡¿"
_BASE = np.uint64(0x9E3779B97F4A7C15)


def _rows(hashes: np.ndarray, length: int) -> np.ndarray:
    mixed = (hashes + np.uint64(length)) * _BASE
    return ((mixed ^ (mixed >> np.uint64(29))) * _BASE >> np.uint64(64 - TABLE.bit_length() + 1)).astype(np.int64)


def word_features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Table rows of the features of each word, word by word, and their number."""
    bare = [f"<{w.lower().strip(_TRIM)}>" for w in words]
    lengths = np.fromiter(map(len, bare), np.int64, len(bare))
    codes = np.frombuffer("".join(bare).encode("utf-32-le", "replace"), "<u4").astype(np.uint64)
    owner = np.repeat(np.arange(len(bare)), lengths)
    begin = np.cumsum(lengths) - lengths
    place = np.arange(len(codes)) - np.repeat(begin, lengths)
    powers = np.cumprod(np.full(int(lengths.max(initial=0)) + 1, _BASE))
    whole = np.add.reduceat(codes * powers[place], begin) if len(bare) else np.zeros(0, np.uint64)
    owners, rows = [np.arange(len(bare))], [_rows(whole, 0)]
    for n in GRAMS:
        count = len(codes) - n + 1
        if count <= 0:
            continue
        hashes = np.zeros(count, np.uint64)
        for j in range(n):
            hashes = hashes * _BASE + codes[j : j + count]
        inside = owner[:count] == owner[n - 1 :]
        owners.append(owner[:count][inside])
        rows.append(_rows(hashes[inside], n))
    owner = np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    return np.concatenate(rows)[order], np.bincount(owner, minlength=len(bare))


def strongest(values: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mean of the passage that begins at each word, and where it ends; texts end at ``ends``.

    A passage has ``PASSAGE`` words or is the whole of a shorter text; the mask says
    which words begin one.
    """
    starts = np.r_[0, ends[:-1]] if len(ends) else ends
    text_end = np.repeat(ends, ends - starts)
    text_start = np.repeat(starts, ends - starts)
    at = np.arange(len(values))
    stop = np.minimum(at + PASSAGE, text_end)
    total = np.r_[0.0, np.cumsum(values)]
    means = (total[stop] - total[at]) / np.maximum(stop - at, 1)
    return means, stop, (at + PASSAGE <= text_end) | (at == text_start)


class Model:
    """Log odds per table row, and the bias."""

    def __init__(self, table: np.ndarray, bias: float):
        self.table, self.bias = table.astype(np.float32), float(bias)

    def words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Log odds of each word, one value a word."""
        rows, counts = word_features(words)
        begin = np.cumsum(counts) - counts
        sums = np.add.reduceat(self.table[rows], begin) if len(words) else np.zeros(0, np.float32)
        return (sums / counts).astype(np.float64), np.ones(len(words), np.int64)

    def score(self, texts: list[str], memory: SpanMemory) -> np.ndarray:
        values, ends = memory([t.split() for t in texts])
        starts = np.r_[0, ends[:-1]]
        means, _, begins = strongest(values, ends)
        means[~begins] = -np.inf
        odds = np.zeros(len(texts))
        filled = ends > starts
        if filled.any():
            odds[filled] = np.maximum.reduceat(means, starts[filled])
        return 1 / (1 + np.exp(-np.clip(odds + self.bias, -700, 700)))


def fit(texts: list[str], labels: list[int], seed: int = 0) -> Model:
    """Train on texts with labels 0 and 1; without both, the model scores 0.5."""
    y = np.array(labels, np.float64)
    if len(set(labels)) < 2:
        return Model(np.zeros(TABLE), 0.0)
    split = [t.split() for t in texts]
    split = [w or [""] for w in split]
    index: dict[str, int] = {}
    flat = np.array([index.setdefault(w, len(index)) for words in split for w in words])
    ends = np.cumsum([len(w) for w in split])
    starts = np.r_[0, ends[:-1]]
    rows, counts = word_features(list(index))
    used = np.flatnonzero(np.bincount(rows, minlength=TABLE))
    place = np.zeros(TABLE, np.int32)
    place[used] = np.arange(len(used))
    rows = place[rows]
    owner = np.repeat(np.arange(len(index), dtype=np.int32), counts)
    begin = np.cumsum(counts) - counts

    draw = np.random.default_rng(seed)
    embedding = draw.normal(0, 0.1, (DIMENSIONS, len(used)))
    softmax = draw.normal(0, 0.1, (DIMENSIONS, 2))
    bias = np.zeros(2)
    parameters = (embedding, softmax, bias)
    speeds = [np.zeros(p.shape) for p in parameters]
    weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean())) / len(y)
    for epoch in range(1, EPOCHS + 1):
        sharpness = 20.0 * (epoch / EPOCHS) ** 2
        vectors = np.stack([np.add.reduceat(e[rows], begin) / counts for e in embedding], axis=1)
        odds_of_word = vectors @ (softmax[:, 1] - softmax[:, 0])
        means, stop, begins = strongest(odds_of_word[flat], ends)
        means[~begins] = -np.inf
        top = np.repeat(np.maximum.reduceat(means, starts), ends - starts)
        share = np.exp(sharpness * (means - top))
        share /= np.repeat(np.add.reduceat(share, starts), ends - starts)
        odds = np.add.reduceat(np.where(begins, share * np.where(begins, means, 0), 0), starts) + bias[1] - bias[0]
        error = weight * (1 / (1 + np.exp(-odds)) - y)  # of the log odds of class 1
        # each passage passes its part on to its words
        part = np.repeat(error, ends - starts) * share / np.maximum(stop - np.arange(len(stop)), 1)
        change = np.r_[part, 0] - np.bincount(stop, part, minlength=len(part) + 1)
        of_word = np.bincount(flat, np.cumsum(change[:-1]), minlength=len(index))
        of_word += DECAY * odds_of_word / len(index)
        towards = softmax[:, 1] - softmax[:, 0]
        on_softmax = vectors.T @ of_word
        per_row = np.bincount(rows, (of_word / counts)[owner], minlength=len(used))
        gradients = [
            towards[:, None] * per_row,
            np.column_stack([-on_softmax, on_softmax]),
            np.array([-error.sum(), error.sum()]),
        ]
        step = RATE * (1 - 0.9 * epoch / EPOCHS)
        for p, g, speed in zip(parameters, gradients, speeds):
            speed *= 0.8
            speed += 0.2 * g
            p -= step * speed / max(np.abs(speed).max(), 1e-12)  # the clearest evidence moves most
    table = np.zeros(TABLE)
    table[used] = (softmax[:, 1] - softmax[:, 0]) @ embedding
    return Model(table, bias[1] - bias[0])


def training_sample(df: DataFrame, marks: DataFrame, id_col: str = "doc_id", text_col: str = "text"):
    """Texts and labels of the sample: of each class the first ``SAMPLE_ROWS`` ids, in the order of a
    hash, that have a label and a document, as far as half of ``SAMPLE_BYTES`` reaches.

    Of rows that share an id the text with the smallest hash is learnt, and ids that are null are not.
    """
    texts = id_and_text(df, id_col, text_col)
    facts = texts.groupBy("id").agg(F.min(F.struct(F.xxhash64("text").alias("h"), F.octet_length("text").alias("size"))).alias("own"))
    known = stored(marks.join(facts, "id").select("id", "label", "own.*", F.xxhash64("id").alias("key")), "toxicity-labelled")
    chosen: list[tuple[int, int, int]] = []
    for label in (0, 1):
        own = known.where(F.col("label") == label).orderBy("key", "id").limit(SAMPLE_ROWS)
        used = 0
        for row in sorted(own.collect(), key=lambda r: (r["key"], r["id"])):
            used += row["size"]
            if used > SAMPLE_BYTES // 2:
                break
            chosen.append((row["id"], row["h"], label))
    sample = df.sparkSession.createDataFrame(chosen, "id bigint, h bigint, label int")
    rows = texts.withColumn("h", F.xxhash64("text")).join(F.broadcast(sample), ["id", "h"])
    found = rows.dropDuplicates(["id"]).orderBy("id").collect()  # at most two times SAMPLE_ROWS
    return [r["text"] for r in found], [r["label"] for r in found]


def score(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``id, score``, higher where label 1 is likelier.

    Null text counts as empty, and an empty text gets the score of the bias alone.
    Ids may be null or repeat; an empty table gives no rows.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = SpanMemory(model.words, _MEMORY)
        for batch in slices(batches):
            found = model.score(batch.column("text").to_pylist(), memory)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(found)], ["id", "score"])

    return id_and_text(df, id_col, text_col).mapInArrow(work, "id bigint, score double")
