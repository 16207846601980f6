"""Token files: whole texts as ids, in ascending id order, one wavelet matrix file per shard.

Texts are spread by ranges of the document id, encoded inside the tasks and written
at once, so ids never travel.  A task cuts its range into shards of about
``SHARD_TOKENS`` tokens, at document ends.  The manifest, a Parquet table written by
Spark, names the file of every shard; the files of lost attempts are not in it.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablewright.llm.common import id_and_text, slices
from tablewright.llm.files import ranges, read_all, write_new
from tablewright.llm.wavelet import WaveletFile, build
from tablewright.llm.word_bpe import encoder
from tablewright.session import scratch_path

SHARD_TOKENS = 1 << 22

MANIFEST = "part int, seq int, path string, documents bigint, tokens bigint, bytes bigint"


def write_token_files(
    df: DataFrame,
    model_path: str,
    folder: str | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    end_id: int = 2,
    shard_tokens: int = SHARD_TOKENS,
) -> DataFrame:
    """Encode and write all texts; returns the manifest (``part, seq, path, documents, tokens, bytes``).

    Shards follow ascending ids, null ids first; ``(part, seq)`` orders them.  Rows
    of one id stay in one shard range, in any order.  Null text counts as empty and
    holds the end id alone.  An empty table gives an empty manifest.
    """
    folder = folder or scratch_path(df.sparkSession, "tokens")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
        tool = encoder(model_path)
        part = TaskContext.get().partitionId()
        seq, ids, lengths, names, known = 0, [], [], [], []

        def shard() -> pa.RecordBatch:
            tokens, sizes = np.concatenate(ids), np.concatenate(lengths)
            data = build(
                tokens, np.concatenate(names), np.concatenate(known), np.cumsum(sizes), tool.levels
            )
            path = write_new(folder, ".wmat", data)
            row = [part, seq, path, len(sizes), len(tokens), len(data)]
            for held in (ids, lengths, names, known):
                held.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array([v], t) for v, t in zip(row, kinds)], MANIFEST.replace(",", "").split()[::2]
            )

        kinds = [pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
        for batch in slices(batches):
            found, ends = tool.encode(batch.column("text"), end_id)
            ids.append(found)
            lengths.append(np.diff(ends, prepend=0))
            names.append(batch.column("id").fill_null(0).to_numpy())
            known.append(batch.column("id").is_valid().to_numpy(zero_copy_only=False))
            if sum(map(len, ids)) >= shard_tokens:
                yield shard()
                seq += 1
        if ids:
            yield shard()

    rows = id_and_text(df, id_col, text_col)
    ordered = rows.repartitionByRange("id").sortWithinPartitions("id")
    ordered.mapInArrow(work, MANIFEST).write.parquet(f"{folder}/manifest")
    return df.sparkSession.read.parquet(f"{folder}/manifest")


def with_starts(manifest: DataFrame) -> DataFrame:
    """The manifest with ``start``: tokens of all shards before this one."""
    ahead = Window.unboundedPreceding, -1
    parts = manifest.groupBy("part").agg(F.sum("tokens").alias("part_tokens"))
    offset = F.coalesce(F.sum("part_tokens").over(Window.orderBy("part").rowsBetween(*ahead)), F.lit(0))
    inside = F.sum("tokens").over(Window.partitionBy("part").orderBy("seq").rowsBetween(*ahead))
    parts = parts.select("part", offset.alias("part_start"))
    return manifest.join(parts, "part").select(
        *manifest.columns, (F.col("part_start") + F.coalesce(inside, F.lit(0))).alias("start")
    )


def read_token_files(manifest: DataFrame) -> DataFrame:
    """One row per document, from the files: ``id, start, n_tokens, ids_crc32``.

    ``start`` counts the tokens of all documents before, ``ids_crc32`` is the
    unsigned CRC-32 of the ids as little-endian unsigned 32-bit integers.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist()):
                file = WaveletFile.of_bytes(read_all(path))
                data = file.tokens().astype("<u4")
                begins = np.r_[0, file.doc_ends[:-1]]
                crcs = [zlib.crc32(data[a:b]) for a, b in zip(begins.tolist(), file.doc_ends.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(file.doc_ids, pa.int64(), mask=~file.doc_known),
                        pa.array(start + begins),
                        pa.array(file.doc_ends - begins),
                        pa.array(crcs, pa.int64()),
                    ],
                    ["id", "start", "n_tokens", "ids_crc32"],
                )

    shards = with_starts(manifest).select("path", "start")
    tasks = max(1, min(manifest.count(), 10_000))
    return shards.repartition(tasks, "path").mapInArrow(
        work, "id bigint, start bigint, n_tokens bigint, ids_crc32 bigint"
    )


def token_occurrences(manifest: DataFrame, token: int) -> DataFrame:
    """Where a token occurs: ``id, position`` inside the document, found by the wavelet matrix,
    of which only the blocks on the way are read."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                with ranges(path) as (read, size):
                    file = WaveletFile(read, size)
                    at = np.array(file.occurrences(token), np.int64)
                doc = np.searchsorted(file.doc_ends, at, "right")
                inside = at - np.r_[0, file.doc_ends][doc]
                names = pa.array(file.doc_ids[doc], pa.int64(), mask=~file.doc_known[doc])
                yield pa.RecordBatch.from_arrays([names, pa.array(inside)], ["id", "position"])

    tasks = max(1, min(manifest.count(), 10_000))
    return manifest.select("path").repartition(tasks, "path").mapInArrow(work, "id bigint, position bigint")
