import bisect
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import __spark_entry__ as entry
from tablewright.llm import packing
from tests.llm.samples import no_documents, odd_documents

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def one_by_one(lengths, budget):
    """Best-two-fit on single pieces, all pairs tried."""
    left, bins = sorted(lengths), []
    while left:
        held, gap = [], budget
        while (at := bisect.bisect_right(left, gap) - 1) >= 0:
            held.append(left.pop(at))
            gap -= held[-1]
        if gap and len(held) > 1:
            sums = [a + b for i, a in enumerate(left) for b in left[:i] if held[-1] < a + b <= held[-1] + gap]
            pairs = [(a, b) for i, a in enumerate(left) for b in left[:i] if sums and a + b == max(sums)]
            if pairs:
                pair = max(pairs)
                smallest = held.pop()
                for piece in pair:
                    left.remove(piece)
                bisect.insort(left, smallest)
                held += pair
        bins.append(sorted(held, reverse=True))
    return bins


@pytest.mark.parametrize("budget", [1, 10, 37, 100])
def test_fillings_are_those_of_the_rule_piece_by_piece(budget):
    draw = random.Random(budget)
    for _ in range(60):
        lengths = [min(budget, max(1, int(draw.expovariate(3 / budget)))) for _ in range(draw.randrange(90))]
        found = []
        for repeats, content in packing.fillings(Counter(lengths), budget):
            found += [[length for length, n in content for _ in range(n)]] * repeats
        assert found == one_by_one(lengths, budget)


def test_fillings_of_many_pieces_are_few_and_full():
    lengths = np.minimum(4096, np.random.default_rng(0).lognormal(6, 1.2, 2_000_000).astype(int) + 1)
    counts = {n: c * 10**6 for n, c in Counter(lengths.tolist()).items()}
    found = packing.fillings(counts)
    needed = -(-sum(n * c for n, c in counts.items()) // 4096)
    assert len(found) < 3 * 4096
    assert needed <= sum(repeats for repeats, _ in found) < needed * 1.0001
    used = Counter()
    for repeats, content in found:
        for length, n in content:
            used[length] += repeats * n
    assert used == counts


def check(rows, budget):
    """Every sequence is filled from 0 without gaps, and numbers have no gaps."""
    held = defaultdict(list)
    for r in rows:
        held[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in held.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= budget
    assert sorted(held) == list(range(len(held)))


@pytest.mark.parametrize("budget", [4096, 50, 1])
def test_pieces_and_places(spark, library, budget):
    docs = odd_documents(spark)
    if budget == 1:
        docs = docs.where("length(text) < 200 or text is null")
    pieces = packing.write_pieces(docs, PATH, budget=budget)
    placed = packing.place(pieces, budget)
    rows = placed.collect()
    check(rows, budget)
    wanted = []
    for r in docs.collect():
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids + [1]
        for k, start in enumerate(range(0, len(ids), budget)):
            part = ids[start : start + budget]
            wanted.append((r["doc_id"], k, start, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    by = lambda t: tuple((x is None, x) for x in t)
    found = [(r["id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows]
    assert sorted(found, key=by) == sorted(wanted, key=by)
    assert len({r["sequence_id"] for r in rows}) == len(one_by_one([w[3] for w in wanted], budget)) or budget > 50
    whole = {r["sequence_id"]: r for r in packing.sequences(pieces, placed).collect()}
    for r in rows:
        ids = whole[r["sequence_id"]]["ids"][r["offset"] : r["offset"] + r["length"]]
        assert zlib.crc32(np.array(ids, "<u4").tobytes()) == r["ids_crc32"]
        assert r["offset"] + r["length"] in whole[r["sequence_id"]]["ends"]


def test_many_pieces_of_one_length(spark):
    docs = spark.range(30_000).selectExpr("id AS doc_id", "if(id % 3 = 0, 'the cat', repeat('the ', int(id % 97))) AS text")
    rows = packing.place(packing.write_pieces(docs.repartition(7), PATH, budget=64), 64).collect()
    check(rows, 64)
    needed = -(-sum(r["length"] for r in rows) // 64)
    assert len({r["sequence_id"] for r in rows}) <= needed * 1.05


def test_empty_table(spark):
    pieces = packing.write_pieces(no_documents(spark), PATH)
    assert packing.place(pieces).count() == 0
    with pytest.raises(ValueError):
        packing.write_pieces(no_documents(spark), PATH, budget=0)


def test_registered(spark, library):
    folder = "/root/testdata/sf0.001"
    df = entry.queries()["op11_packing"](spark, folder)
    assert [(n, t) for n, t in df.dtypes] == [
        ("doc_id", "bigint"), ("piece", "int"), ("start", "bigint"), ("length", "bigint"),
        ("ids_crc32", "bigint"), ("sequence_id", "bigint"), ("offset", "bigint"),
    ]
    rows = df.collect()
    check(rows, 4096)
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    pieces = Counter()
    for r in rows:
        ids = library.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids + [1]
        part = ids[r["start"] : r["start"] + 4096]
        assert (r["start"], r["length"]) == (4096 * r["piece"], len(part))
        assert r["ids_crc32"] == zlib.crc32(np.array(part, "<u4").tobytes())
        pieces[r["doc_id"]] += len(part)
        assert pieces[r["doc_id"]] <= len(ids)
    assert set(pieces) == set(texts)
