import random
import time
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tablewright.llm import token_store, wavelet, word_bpe
from tests.llm.samples import no_documents, odd_documents

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def test_encoding_equals_the_library(library):
    draw = random.Random(2)
    latin = "ab'sdltremv 1²½é́ñÑİıſß!<|>.日Σ\n\t"
    texts = ["".join(draw.choice(latin) for _ in range(draw.randrange(30))) for _ in range(1_500)]
    texts += ["".join(chr(draw.choice([32, draw.randrange(33, 127), draw.randrange(0x80, 0x400), draw.randrange(1, 0x2FFF)])) for _ in range(draw.randrange(30))) for _ in range(1_500)]
    texts += ["", " ", "a\tb\x1cc\x85d e", "don't WE'LL it's", "<|endoftext|> a<|startoftext|>b", "İstanbul ΑΣ"]
    ids, ends = word_bpe.WordEncoder(PATH).encode(texts, 2)
    for text, got in zip(texts, np.split(ids, ends[:-1])):
        assert got.tolist() == library.encode(text, add_special_tokens=False).ids + [2]


@pytest.mark.parametrize("n,top", [(0, 4), (1, 1), (1_000, 60), (200_000, 49_408)])
def test_wavelet_matrix(n, top):
    draw = np.random.default_rng(n)
    tokens = np.minimum(draw.geometric(0.01, n), top - 1) if top > 1_000 else draw.integers(0, top, n)
    levels = max(1, (top - 1).bit_length())
    data = wavelet.build(tokens, np.array([7, 8]), np.array([1, 0]), np.array([n // 2, n]), levels)
    file = wavelet.WaveletFile.of_bytes(data)
    assert (file.tokens() == tokens).all()
    assert file.doc_ids.tolist() == [7, 8] and file.doc_known.tolist() == [True, False]
    for at in draw.integers(0, n, 20).tolist() if n else []:
        assert file.access(at) == tokens[at]
    for token in {0, 1, top - 1, *tokens[:5].tolist()}:
        a, b = sorted(draw.integers(0, n + 1, 2).tolist())
        assert file.count(token) == (tokens == token).sum()
        assert file.count(token, a, b) == (tokens[a:b] == token).sum()
        where = np.flatnonzero(tokens == token)
        if len(where) < 300:
            assert file.occurrences(token) == where.tolist()
    assert file.count(1 << levels) == 0 and file.occurrences(-1) == []


def test_many_occurrences_are_found_together():
    tokens = np.random.default_rng(4).integers(0, 5, 500_000)
    file = wavelet.WaveletFile.of_bytes(wavelet.build(tokens, np.array([1]), np.array([1]), np.array([len(tokens)]), 16))
    began = time.perf_counter()
    found = file.occurrences(3)
    assert time.perf_counter() - began < 1
    assert found == np.flatnonzero(tokens == 3).tolist() and len(found) > 90_000
    assert file.occurrences(3, 1_000, 70_000) == [i for i in found if 1_000 <= i < 70_000]


def test_damaged_file():
    data = wavelet.build(np.arange(9), np.zeros(1), np.ones(1), np.array([9]), 4)
    for bad in (data[:-1], b"x" + data[1:], data[:20]):
        with pytest.raises(ValueError):
            wavelet.WaveletFile.of_bytes(bad)
    with pytest.raises(ValueError):
        wavelet.build(np.array([16]), np.zeros(1), np.ones(1), np.array([1]), 4)


@pytest.mark.parametrize("shard_tokens", [1 << 22, 50])
def test_files(spark, library, shard_tokens):
    docs = odd_documents(spark)
    manifest = token_store.write_token_files(docs, PATH, shard_tokens=shard_tokens)
    rows = token_store.read_token_files(manifest).collect()
    wanted = {r["doc_id"]: library.encode(r["text"] or "", add_special_tokens=False).ids + [2] for r in docs.collect()}
    assert len(rows) == docs.count()
    start = 0
    order = sorted(rows, key=lambda r: r["start"])
    assert [r["id"] for r in order] == sorted((r["id"] for r in rows), key=lambda i: -1 if i is None else i)
    for r in order:
        ids = wanted[r["id"]]
        crc = zlib.crc32(np.array(ids, "<u4").tobytes())
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(ids), crc)
        start += len(ids)
    token = wanted[4][0]
    found = sorted((r["id"], r["position"]) for r in token_store.token_occurrences(manifest, token).collect())
    assert found == sorted((r["id"], k) for r in rows for k, t in enumerate(wanted[r["id"]]) if t == token)


def test_empty_table(spark):
    manifest = token_store.write_token_files(no_documents(spark), PATH)
    assert token_store.read_token_files(manifest).count() == 0
