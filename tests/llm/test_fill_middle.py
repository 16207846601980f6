import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tablewright.llm import byte_runs, fill_middle
from tests.llm.samples import documents, no_documents, odd_documents


def plain(doc_id, text):
    """The transformation on single units."""
    text = text or ""
    units = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    n = len(units)
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    before, middle, after = ("".join(units[i:j]) for i, j in ((0, a), (a, b), (b, n)))
    if not text or any(mark in text for mark in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return (doc_id, n, "plain", None, None, text)
    if h[3] % 100 < 20:
        return (doc_id, n, "spm", len(before), len(middle), f"<S>{after}<P>{before}<M>{middle}")
    return (doc_id, n, "psm", len(before), len(middle), f"<P>{before}<S>{after}<M>{middle}")


def test_equals_the_plain_form_and_restores(spark):
    draw = random.Random(4)
    letters = "abZ <>PSM.\n12éñ日🙂́"
    texts = ["".join(draw.choice(letters) for _ in range(draw.choice([0, 1, 5, 60, 2_000]))) for _ in range(400)]
    texts += ["a<P>b", "<S>", "x <M> y", "a" * 700 + " " + "b" * 700, "é" * 3_000, "<" * 40, "S>P>M>" * 30]
    docs = documents(spark, texts, [i * 7 for i in range(len(texts))]).unionAll(odd_documents(spark))
    found = fill_middle.fill_in_middle(docs).withColumn("back", fill_middle.restored(F.col("output"), F.col("form")))
    rows = found.collect()
    assert [tuple(r)[:-1] for r in rows] == [plain(r["doc_id"], r["text"]) for r in docs.collect()]
    assert [r["back"] for r in rows] == [r["text"] or "" for r in docs.collect()]
    assert {r["form"] for r in rows} == {"plain", "psm", "spm"}


@pytest.mark.parametrize("block", [1, 3, 256])
def test_every_cut_of_a_text(block):
    texts = ["", "abc déf  🙂g.", "x" * 40 + "1", "", "日本語" * 9, "z"]
    data, begins = byte_runs.joined(pa.array(texts))
    counts = fill_middle.BlockCounts(data, begins, block)
    for k, text in enumerate(texts):
        units = re.findall("[A-Za-z]+|[^A-Za-z]", text)
        assert counts.total_units[k] == len(units) and counts.total_points[k] == len(text)
        for cut in range(len(units) + 1):
            place, points = counts.cut(np.array([k]), np.array([cut]))
            head = "".join(units[:cut])
            assert (place[0], points[0]) == (len(head.encode()), len(head))


def test_empty_table(spark):
    assert fill_middle.fill_in_middle(no_documents(spark)).count() == 0
