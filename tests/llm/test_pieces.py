import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from tablewright.llm import piece_bpe, token_counts
from tablewright.llm.piece_model import load
from tests.llm.samples import no_documents, odd_documents, ODD_TEXTS

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def random_texts():
    draw = random.Random(5)
    alphabets = [
        "ab  ▁the=-_.\n日é🙂erin\t",
        "    \n\r",
        "".join(map(chr, [*range(1, 400), *range(0x3000, 0x3100), *range(0x1F300, 0x1F340)])),
    ]
    texts = ["".join(draw.choice(a) for _ in range(draw.randrange(60))) for a in alphabets for _ in range(400)]
    texts += [" " * draw.randrange(90) + "the" + " " * draw.randrange(90) + draw.choice(["", "a", ".", "日"]) for _ in range(200)]
    return texts + [t or "" for t in ODD_TEXTS]


def test_encoding_equals_the_library(library):
    texts = random_texts()
    tool = piece_bpe.Encoder(PATH)
    for end in (None, 2):
        ids, ends = tool.encode(texts, end)
        got = [x.tolist() for x in np.split(ids, ends[:-1])]
        assert got == [x + ([] if end is None else [end]) for x in library.encode(texts)]


def test_counts_equal_the_library(library):
    texts = random_texts()
    got = token_counts.count_texts(texts, load(PATH), {})
    assert got.tolist() == [len(x) for x in library.encode(texts)]


def test_decoding_equals_the_library(library):
    draw = random.Random(6)
    lists = [[draw.randrange(32_000) if draw.random() < 0.5 else draw.randrange(262) for _ in range(draw.randrange(12))] for _ in range(2_000)]
    lists += library.encode(random_texts())
    flat = np.array([i for x in lists for i in x], np.int32)
    got = piece_bpe.Decoder(PATH).decode(flat, np.cumsum([len(x) for x in lists]))
    assert got == library.decode(lists)
    with pytest.raises(ValueError):
        piece_bpe.Decoder(PATH).decode(np.array([32_000]), np.array([1]))


def test_memory_may_start_anew(library, monkeypatch):
    monkeypatch.setattr(piece_bpe, "MEMORY", 3)
    monkeypatch.setattr(token_counts, "MEMORY", 3)
    tool, memory = piece_bpe.Encoder(PATH), {}
    for text in ("a b c d e", "e f a", "a b c d e f g"):
        assert tool.encode([text], None)[0].tolist() == library.encode(text)
        assert token_counts.count_texts([text], load(PATH), memory).tolist() == [len(library.encode(text))]


def test_tables(spark, library):
    docs = odd_documents(spark)
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    both = piece_bpe.decode_ids(piece_bpe.encode_texts(docs, PATH), PATH)
    rows = both.collect()
    assert len(rows) == len(ODD_TEXTS) + 4
    for r in rows:
        assert r["ids"] == [*library.encode(texts[r["id"]]), 2]
        assert r["decoded"] == library.decode(r["ids"])
    counted = token_counts.token_counts(docs, PATH, limit=100).collect()
    assert len(counted) == len(rows)
    for r in counted:
        text = texts[r["id"]]
        n = len(library.encode(text))
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(text.encode()), n, n > 100)
    assert piece_bpe.encode_texts(no_documents(spark), PATH).count() == 0
    assert token_counts.token_counts(no_documents(spark), PATH).count() == 0
