import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import types as T

from tablewright.llm import ranked_search
from tests.llm.samples import documents, no_documents, odd_documents

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
ITEMS = T.StructType([T.StructField("item_id", T.LongType()), T.StructField("text", T.StringType())])


def terms(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return TERM.findall(low)


def plain(docs, items, top):
    held = [(i, Counter(terms(t))) for i, t in docs]
    N = sum(1 for _, c in held if c)
    L = sum(c.total() for _, c in held)
    df = Counter(t for _, c in held for t in c)
    asked = {}
    for item, text in items:
        asked.setdefault(item, set()).update(terms(text))
    out = []
    for item, wanted in asked.items():
        found = []
        for i, c in held:
            n = c.total()
            score = sum(
                math.floor(1000 * math.log((2 * N + 2) / (2 * df[t] + 1)))
                * (10**9 * c[t] // (1000 * c[t] + 20 * (50 + 50 * n * N // L)))
                for t in wanted
                if c[t]
            )
            if score > 0:
                found.append((-score, i is None, i, score))
        found.sort(key=lambda f: (f[0], f[1], f[2] or 0))
        out += [(item, k + 1, f[2], f[3]) for k, f in enumerate(found[:top])]
    return sorted(out, key=str)


def run(docs, items, spark, **how):
    rows = ranked_search.ranked_search(docs, spark.createDataFrame(items, ITEMS), **how).collect()
    return sorted([tuple(r) for r in rows], key=str)


def corpus(count, seed):
    draw = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(300)] + ["Ünï", "日本語", "x" * 30, "X" * 25]
    weights = [1 / (k + 1) for k in range(len(vocabulary))]
    texts = [" ".join(draw.choices(vocabulary, weights, k=draw.randrange(1, 80))) for _ in range(count)]
    return texts + texts[:20] + [texts[0]] * 90, vocabulary, draw


@pytest.mark.parametrize("how", [{}, {"top": 5}, {"top": 1}, {"top": 5, "item_bytes": 400}])
def test_equals_scores_of_all_documents(spark, how):
    texts, vocabulary, draw = corpus(600, 1)
    docs = documents(spark, texts).unionAll(odd_documents(spark))
    items = [(k, ", ".join(draw.sample(vocabulary, draw.randrange(1, 25)))) for k in range(25)]
    items += [(90, None), (91, ""), (92, "nowhere"), (3, "w1 w250"), (None, "w5 日本語"), (93, "same again repeat me")]
    wanted = plain([(r["doc_id"], r["text"]) for r in docs.collect()], items, how.get("top", 50))
    assert run(docs.repartition(5), items, spark, **how) == wanted


def test_small_blocks():
    """Blocks within one process: accumulators stop early and the ranking stays exact."""
    texts, vocabulary, draw = corpus(3_000, 2)
    number = {v: k for k, v in enumerate(dict.fromkeys(terms(v)[0] for v in vocabulary))}
    counts = [Counter(number[t] for t in terms(text)) for text in texts]
    n = np.array([c.total() for c in counts])
    df = np.bincount([t for c in counts for t in c], minlength=len(number))
    N, L = len(texts), int(n.sum())
    weights = np.array([ranked_search.weight(N, f) for f in df.tolist()])
    for _ in range(20):
        asked = np.array(sorted(draw.sample(sorted(number.values()), 12), key=lambda t: (df[t], t)))
        best, created = ranked_search.Best(10), 0
        for at in range(0, N, 500):
            part = counts[at : at + 500]
            block = ranked_search.Block(
                n[at : at + 500], np.array([len(c) for c in part]),
                np.array([t for c in part for t in sorted(c)]), np.array([c[t] for c in part for t in sorted(c)]),
                weights, N, L,
            )
            rows, scores = block.rank(asked, best.floor(0), 10)
            created += len(rows)
            best.add(0, at + rows, np.ones(len(rows), bool), scores)
        every = [
            (-sum(int(weights[t]) * (10**9 * c[t] // (1000 * c[t] + 20 * (50 + 50 * int(n[i]) * N // L))) for t in asked.tolist() if t in c), i)
            for i, c in enumerate(counts)
        ]
        every = sorted(e for e in every if e[0])[:10]
        ((_, ids, _, scores),) = best.rows()
        assert [(-s, i) for s, i in zip(scores.tolist(), ids.tolist())] == every
        assert created < sum(1 for c in counts if any(t in c for t in asked.tolist()))


def test_empty_tables(spark):
    assert run(no_documents(spark), [(1, "a b")], spark) == []
    assert run(odd_documents(spark), [], spark) == []
    with pytest.raises(ValueError):
        run(no_documents(spark), [(1, "a")], spark, top=0)
