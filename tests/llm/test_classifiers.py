import zlib

import numpy as np
import pytest

from tablewright.llm import quality, toxicity
from tablewright.llm.common import SpanMemory
from tests.llm.samples import documents, no_documents, odd_documents, words

FOLDER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def tables(spark):
    return tuple(spark.read.parquet(f"{FOLDER}/{t}.parquet") for t in ("documents", "labels"))


def held_out(ids, divisor, remainder):
    return np.array([zlib.crc32(str(i).encode()) % divisor == remainder for i in ids])


def test_discriminant_is_the_gaussian_log_density_difference():
    draw = np.random.default_rng(0)
    x = [draw.normal(size=(200, quality.SIZE)) @ draw.normal(size=(quality.SIZE, quality.SIZE)) for _ in range(2)]
    counts = np.array([len(v) for v in x], float)
    model = quality.Discriminant.fit(counts, np.array([v.sum(0) for v in x]), np.array([v.T @ v for v in x]))
    own = [np.cov(v.T, bias=True) for v in x]
    pooled = (own[0] + own[1]) / 2
    d, c = quality.DIAGONAL_SHRINKAGE, quality.CLASS_SHRINKAGE
    target = (1 - d) * pooled + d * np.diag(np.diag(pooled))
    points = draw.normal(size=(20, quality.SIZE)) * 3
    logs = []
    for v, s in zip(x, own):
        s = (1 - c) * s + c * target + quality.LEAST_DEVIATION**2 * np.eye(quality.SIZE)
        z = points - v.mean(0)
        logs.append(-np.einsum("ij,jk,ik->i", z, np.linalg.inv(s), z) / 2 - np.linalg.slogdet(s)[1] / 2)
    np.testing.assert_allclose(model.margin(points), logs[1] - logs[0], rtol=1e-6)


def test_quality_on_held_out_rows(spark, tables):
    docs, labels = tables
    marks = quality.one_label_each(labels, "quality")
    statistics = quality.document_statistics(docs)
    truth = {r["id"]: r["label"] for r in marks.collect()}
    ids = sorted(truth)
    out = dict(zip(ids, held_out(ids, 3, 1)))
    train = spark.createDataFrame([(i, truth[i]) for i in ids if not out[i]], "id bigint, label int")
    model = quality.train(statistics, train)
    # the same moments without Spark
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    x = quality.features([texts[i] for i in ids if not out[i]])
    y = np.array([truth[i] for i in ids if not out[i]])
    parts = [x[y == k] for k in (0, 1)]
    plain = quality.Discriminant.fit(np.array([len(p) for p in parts], float), np.array([p.sum(0) for p in parts]), np.array([p.T @ p for p in parts]))
    scores = {r["id"]: r["score"] for r in quality.score(statistics, model).collect()}
    every = sorted(texts)
    np.testing.assert_allclose([scores[i] for i in every], plain.score(quality.features([texts[i] for i in every])), atol=1e-6)
    right = [(scores[i] >= 0.5) == truth[i] for i in ids if out[i]]
    assert np.mean(right) > 0.97
    kept = {r["doc_id"] for r in quality.keep_good(docs, model).collect()}
    assert kept == {i for i in every if scores[i] >= 0.5}


def test_quality_of_odd_and_empty_tables(spark, tables):
    docs, labels = tables
    model = quality.train(quality.document_statistics(docs), quality.one_label_each(labels, "quality"))
    odd = odd_documents(spark)
    scores = quality.score(quality.document_statistics(odd), model).collect()
    assert len(scores) == odd.count() and all(0 <= r["score"] <= 1 for r in scores)
    assert quality.keep_good(odd, model).columns == odd.columns
    nothing = quality.document_statistics(no_documents(spark))
    unknown = quality.train(nothing, quality.one_label_each(labels, "quality"))
    assert quality.score(nothing, unknown).count() == 0
    assert unknown.score(quality.features(["any"])).tolist() == [0.5]
    marks = spark.createDataFrame([(1, 1), (1, 0), (2, None), (None, 1), (3, 5), (4, 1)], "doc_id bigint, quality int")
    assert sorted(map(tuple, quality.one_label_each(marks, "quality").collect())) == [(1, 0), (4, 1)]


def test_word_features_share_grams():
    rows, counts = toxicity.word_features(["Stupid!", "stupid", "stupidd", "", "日本"])
    parts = np.split(rows, np.cumsum(counts)[:-1])
    assert parts[0].tolist() == parts[1].tolist()
    assert len(set(parts[1]) & set(parts[2])) >= 10
    assert all(len(p) for p in parts) and rows.min() >= 0 and rows.max() < toxicity.TABLE


def test_toxicity_learns_words_and_misspellings():
    bad = ["horrid", "nastyfool", "grubling"]
    texts, labels = [], []
    for i in range(240):
        text = words(30 + i % 50, i)
        if i % 3 == 0:
            text[i % len(text)] = bad[i % 9 // 3]
        texts.append(" ".join(text))
        labels.append(int(i % 3 == 0))
    model = toxicity.fit(texts, labels)
    memory = SpanMemory(model.words, 1_000)
    clean = " ".join(words(400, 999))
    middle = len(clean) // 2
    score = lambda *t: model.score(list(t), memory).tolist()
    assert score(clean, "")[0] < 0.5 and score("")[0] < 0.5
    for word in (*bad, "horridd", "Nastyfools", "grublingg"):
        assert score(f"{clean[:middle]} {word} {clean[middle:]}")[0] > 0.5, word
    assert toxicity.fit(["a"], [1]).score(["a"], SpanMemory(toxicity.fit([], []).words, 9)).tolist() == [0.5]


def test_toxicity_tables(spark, tables):
    docs, labels = tables
    marks = quality.one_label_each(labels, "toxic")
    truth = {r["id"]: r["label"] for r in marks.collect()}
    ids = sorted(truth)
    out = dict(zip(ids, held_out(ids, 5, 0)))
    train = spark.createDataFrame([(i, truth[i]) for i in ids if not out[i]], "id bigint, label int")
    texts, seen = toxicity.training_sample(docs, train)
    assert len(texts) == len([i for i in ids if not out[i]]) and sum(seen) == sum(truth[i] for i in ids if not out[i])
    model = toxicity.fit(texts, seen)
    scores = {r["id"]: r["score"] for r in toxicity.score(docs, model).collect()}
    assert len(scores) == docs.count()
    right = [(scores[i] >= 0.5) == truth[i] for i in ids if out[i]]
    assert np.mean(right) > 0.9
    odd = odd_documents(spark)
    assert toxicity.score(odd, model).count() == odd.count()
    assert toxicity.score(no_documents(spark), model).count() == 0
    assert toxicity.training_sample(no_documents(spark), marks) == ([], [])


def test_sample_is_bounded(spark, tables, monkeypatch):
    docs, labels = tables
    marks = quality.one_label_each(labels, "toxic")
    monkeypatch.setattr(toxicity, "SAMPLE_ROWS", 20)
    monkeypatch.setattr(toxicity, "SAMPLE_BYTES", 60_000)
    texts, seen = toxicity.training_sample(docs, marks)
    assert 0 < len(texts) <= 40 and sum(len(t.encode()) for t in texts) <= 60_000


def test_toxicity_sample_follows_the_hash_of_ids(spark, monkeypatch):
    """Labels without a document take no place, and the bound on bytes prefers no length."""
    texts = ["x" * (10 if i % 2 else 400) for i in range(40)]
    docs = documents(spark, texts)
    marks = spark.createDataFrame([(i, i // 20 % 2) for i in range(40)] + [(i, i % 2) for i in range(1_000, 1_200)], "id bigint, label int")
    monkeypatch.setattr(toxicity, "SAMPLE_ROWS", 10)
    found, labels = toxicity.training_sample(docs, marks)
    assert sorted(labels) == [0] * 10 + [1] * 10
    monkeypatch.setattr(toxicity, "SAMPLE_BYTES", 3_000)
    found, labels = toxicity.training_sample(docs, marks)
    assert {len(t) for t in found} == {10, 400} and {0, 1} == set(labels)
    for label in (0, 1):
        assert sum(len(t) for t, mark in zip(found, labels) if mark == label) <= 1_500
