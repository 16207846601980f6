import re
from itertools import combinations

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

import __spark_entry__ as entry
import corpus_pipeline
from tablewright.llm import decontaminate, quality
from tests.llm.samples import no_documents, odd_documents
from tests.llm.test_simhash import jaccard

FOLDER = "/root/testdata/sf0.001"


def test_registered():
    names = list(entry.queries())
    assert "pipeline" in names
    for n in range(1, 14):
        assert len([x for x in names if x.startswith(f"op{n}_")]) == 1
    assert [f.__name__ for _, f in corpus_pipeline.STAGES] == [
        "drop_low_quality", "drop_exact_copies", "drop_near_copies", "drop_benchmark_passages", "encode_pieces",
    ]


def test_against_brute_force(spark):
    """Each stage by a plain rule over all documents or all pairs."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    marks = quality.one_label_each(spark.read.parquet(f"{FOLDER}/labels.parquet"), "quality")
    marks = marks.where("crc32(cast(cast(id as string) as binary)) % 3 <> 1")
    model = quality.train(quality.document_statistics(docs), marks)
    good = [i for i in sorted(texts) if model.score(quality.features([texts[i]]))[0] >= 0.5]
    first = {}
    for i in good:
        first.setdefault(re.sub("[\x20\x09-\x0d]+", " ", texts[i]), i)
    single = sorted(first.values())
    alike = [(a, b) for a, b in combinations(single, 2) if jaccard(texts[a], texts[b]) >= 0.8]
    items = spark.read.parquet(f"{FOLDER}/benchmark.parquet")
    dirty = {r["id"] for r in decontaminate.contaminated(docs, items).collect()}
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, FOLDER).collect()}
    root = {i: i for i in single}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in alike:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    assert set(got) == {i for i in single if find(i) == i} - dirty
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    for i, row in got.items():
        assert row["ids"] == [*library.encode(texts[i]), 2] and row["n_tokens"] == len(row["ids"])
        assert row["decoded"] == library.decode(row["ids"])


@pytest.mark.parametrize("table", [odd_documents, no_documents])
def test_stages_on_odd_tables(spark, table):
    docs = table(spark)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, FOLDER)
        if name != "encoding":
            assert out.columns == docs.columns
        assert out.count() <= docs.count()


def test_op_queries_against_plain_rules(spark):
    """Sizes and checks of the registered queries that have no SQL."""
    n = spark.read.parquet(f"{FOLDER}/documents.parquet").count()
    for name in ("op5_toxicity", "op10_quality"):
        rows = entry.queries()[name](spark, FOLDER).collect()
        assert len(rows) == n and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in rows)
    shards = entry.queries()["op4_hilbert_shards"](spark, FOLDER).collect()
    counts = np.bincount([r["shard"] for r in shards], minlength=40)
    assert len(shards) == n and counts.max() - counts.min() <= 1
