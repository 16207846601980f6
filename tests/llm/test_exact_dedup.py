import hashlib
import re
from collections import defaultdict

import pytest

from tablewright.llm import exact_dedup
from tests.llm.samples import CLASHES, documents, no_documents, odd_documents


def brute(rows):
    normal = [(r["doc_id"], re.sub("[\x20\x09-\x0d]+", " ", r["text"] or "")) for r in rows]
    groups = defaultdict(list)
    for i, t in normal:
        groups[t].append(i)
    out = []
    for i, t in normal:
        known = [x for x in groups[t] if x is not None]
        keep = min(known) if known else None
        out.append((i, keep, len(groups[t]), i == keep, hashlib.sha256(t.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("small", [True, False])
def test_against_brute_force(spark, monkeypatch, small):
    if not small:
        monkeypatch.setattr(exact_dedup, "is_small", lambda df: False)
        monkeypatch.setattr("tablewright.llm.common.is_small", lambda df: False)
    docs = odd_documents(spark)
    # equal lengths and prefixes, different ends
    more = documents(spark, ["p" * 300 + c for c in "aabbc"], [100, 101, 102, 103, 104])
    df = docs.unionByName(more)
    found = exact_dedup.exact_duplicates(df, digests=True)
    rows = [(r["id"], r["keep_id"], r["group_size"], r["kept"], r["digest"]) for r in found.collect()]
    assert sorted(rows, key=str) == brute(df.collect())


def test_drop_keeps_columns_and_repeated_rows(spark):
    docs = odd_documents(spark)
    kept = exact_dedup.drop_exact_duplicates(docs)
    assert kept.columns == docs.columns
    ids = sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None)
    # 1 equals 0 (null is empty), 3 equals 2 and 6 equals 5 (white space), 50 equals 4
    assert ids == [0, 2, 4, 5, 7, 8, 9, 10, 11, 12, 13, 60, 60]
    assert len(CLASHES) + 5 == len(kept.columns)


def test_same_id_other_text_is_not_dropped(spark):
    docs = documents(spark, ["a", "a", "b"], [1, 2, 2])
    left = [(r["doc_id"], r["text"]) for r in exact_dedup.drop_exact_duplicates(docs).collect()]
    assert sorted(left) == [(1, "a"), (2, "b")]


def test_empty_table(spark):
    assert exact_dedup.exact_duplicates(no_documents(spark)).count() == 0
    assert exact_dedup.drop_exact_duplicates(no_documents(spark)).count() == 0
