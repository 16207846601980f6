import itertools
import zlib
from collections import Counter, defaultdict

import pytest

from tablewright.llm import hilbert
from tests.llm.samples import documents, no_documents, odd_documents


@pytest.mark.parametrize("axes,bits", [(2, 3), (3, 2), (3, 3)])
def test_index_walks_through_neighbours(spark, axes, bits):
    names = [f"a{i}" for i in range(axes)]
    cells = spark.createDataFrame(list(itertools.product(range(2**bits), repeat=axes)), names)
    rows = hilbert.hilbert_index(cells, names, bits, "h").orderBy("h").collect()
    assert [r["h"] for r in rows] == list(range(2 ** (axes * bits)))
    for before, after in zip(rows, rows[1:]):
        assert sum(abs(before[n] - after[n]) for n in names) == 1


def check(df, found, shards):
    rows = found.collect()
    source = Counter((r["doc_id"], len((r["text"] or "").encode()) + 16, zlib.crc32((r["text"] or "").encode())) for r in df.collect())
    assert Counter((r["id"], r["size"], r["text_crc32"]) for r in rows) == source
    slots = defaultdict(list)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
    for own in slots.values():
        assert sorted(own) == list(range(len(own)))
    sizes = [len(slots[s]) for s in range(shards)]
    assert max(sizes) - min(sizes) <= 1
    curve = [r["curve"] for r in sorted(rows, key=lambda r: (r["shard"], r["slot"]))]
    assert curve == sorted(curve)


def test_shards(spark):
    df = odd_documents(spark)
    check(df, hilbert.hilbert_shards(df, shards=4), 4)
    check(df, hilbert.hilbert_shards(df, shards=40), 40)  # more shards than rows


def test_hot_cell(spark):
    df = documents(spark, ["same text"] * 500 + [f"other {i}" for i in range(300)])
    check(df, hilbert.hilbert_shards(df, shards=7), 7)


def test_empty_table(spark):
    assert hilbert.hilbert_shards(no_documents(spark)).count() == 0


def test_written_shards_are_pruned(spark, tmp_path):
    df = documents(spark, [f"text {'x' * (i % 50)}" for i in range(400)])
    ranges = hilbert.write_shards(df, str(tmp_path / "shards"), shards=8)
    assert sum(r["rows"] for r in ranges.collect()) == 400
    written = spark.read.parquet(str(tmp_path / "shards"))
    got = hilbert.read_pruned(written, ranges, {"source": "src2"})
    assert got.columns == df.columns
    assert got.count() == df.where("source = 'src2'").count() > 0
    held = ranges.where("'src2' between source_min and source_max").count()
    assert held < 8
