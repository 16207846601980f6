import random
import re

import numpy as np
import pyarrow as pa

from tablewright.llm import decontaminate
from tests.llm.samples import documents, no_documents, odd_documents, words

ITEMS = {
    1: "A train leaves Boston with 120 people and after 3 hours it has only 45 people left on board.",
    2: "Mix two cups of flour with one egg. Then bake the dough for 25 minutes in a hot oven and cool it.",
    3: "short one here now",
    4: "too short",
    5: "Anna has 7 red balls and Bob has 9 blue balls, so Anna gives 7 balls away and then Bob keeps 9 balls.",
    6: None,
    7: "",
}


def benchmark(spark):
    return spark.createDataFrame(list(ITEMS.items()), "item_id bigint, text string")


def noise(seed, n=60):
    return " ".join(words(n, seed))


def found(spark, texts, ids=None, **how):
    rows = decontaminate.contaminated(documents(spark, texts, ids), benchmark(spark), **how).collect()
    return {(r["id"], r["item_id"]): r for r in rows}


def test_planted_passages(spark):
    new_numbers = ITEMS[1].replace("120", "95").replace("45", "1,300").replace("Boston", "New Haven")
    got = found(
        spark,
        [
            f"{noise(1)} {ITEMS[1]} {noise(2)}",
            f"{noise(3)} {new_numbers} {noise(4)}",  # other numbers and another name
            ITEMS[2].upper(),
            ITEMS[2].lower().replace(" ", "\n"),
            noise(5, 400),
            f"{noise(6)}\n{ITEMS[3]}",
            ITEMS[4],
            f"{ITEMS[1]} {noise(7)} {ITEMS[1]}",
            ITEMS[1].replace("leaves", "departs"),  # one word changed
        ],
    )
    assert set(got) == {(0, 1), (1, 1), (2, 2), (3, 2), (5, 3), (6, 4), (7, 1), (8, 1)}
    assert got[0, 1]["share"] == 1.0 and got[0, 1]["same_values"]
    assert got[1, 1]["share"] == 1.0 and not got[1, 1]["same_values"]
    assert got[8, 1]["share"] < 1.0


def test_slots_must_be_consistent(spark):
    consistent = ITEMS[5].replace("7", "70").replace("9", "11")
    mixed = "Anna has 70 red balls and Bob has 9 blue balls, so Anna gives 5 balls away and then Bob keeps 8 balls."
    got = found(spark, [consistent, mixed])
    assert set(got) == {(0, 5)}


def pairs_of(spark, items, texts):
    table = spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string")
    rows = decontaminate.contaminated(documents(spark, texts), table).collect()
    return {(r["id"], r["item_id"]): r["share"] for r in rows}


def test_items_poor_in_literals(spark):
    items = [
        "Solve 3x + 7 = 22",
        "Compute 12 + 35 - 7 * 4 + 18",
        "Simplify 3/4 + 5/6",
        "3 14 15 92 65 35 89 79 32 38 46 26",
        "小明有三个苹果",
        "ร้านนี้ขายผลไม้สดทุกวัน",
    ]
    texts = [f"{noise(20 + k)} {item} {noise(40 + k)}" for k, item in enumerate(items)]
    texts[4] = "昨天老师说小明有三个苹果然后回家了"
    texts[5] = "แม่บอกว่าร้านนี้ขายผลไม้สดทุกวันนะ"
    texts += [text.replace("35", "36").replace("7", "8").replace("5/6", "1/6") for text in texts[:3]]
    texts.append("昨天老师说小红有五个香蕉然后回家了")
    got = pairs_of(spark, items, texts)
    assert got == {(k, k): 1.0 for k in range(6)}


def test_one_conflict_leaves_other_windows(spark):
    filler = [words(22, 70), words(22, 71)]
    item = " ".join(["lend", "7", "coins", *filler[0], "lend", "7", "coins", *filler[1], "then", "4", "more"])
    prose = " ".join([*words(20, 72), "one", *words(20, 73), "one", *words(10, 74)])
    edited = "lend 8 coins".join(item.rsplit("lend 7 coins", 1))
    other = edited.replace("7", "70").replace("then 4", "then 5")
    got = pairs_of(spark, [item, prose], [edited, other, "two".join(prose.rsplit("one", 1))])
    assert set(got) == {(0, 0), (1, 0), (2, 1)} and all(0.5 < share < 1 for share in got.values())


def test_excerpt_of_a_long_item(spark):
    item = words(400, 80)
    texts = [f"{noise(81)} {' '.join(item[100:200])} {noise(82)}", f"{noise(83)} {' '.join(item[100:110])} {noise(84)}"]
    got = pairs_of(spark, [" ".join(item)], texts)
    assert set(got) == {(0, 0)} and got[0, 0] < 0.3


def test_brute_force_on_tables(spark):
    folder = "/root/testdata/sf0.001"
    docs, items = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "benchmark"))
    bare = lambda t: " ".join(t.lower().replace(".", " ").replace(",", " ").split())
    wanted = {
        (d["doc_id"], i["item_id"])
        for d in docs.collect()
        for i in items.collect()
        if f" {bare(i['text'])} " in f" {bare(d['text'])} "
    }
    got = {(r["id"], r["item_id"]) for r in decontaminate.contaminated(docs, items).collect() if r["share"] == 1.0}
    assert wanted == got and wanted


def test_odd_and_empty_tables(spark):
    docs = odd_documents(spark)
    left = decontaminate.drop_contaminated(docs, benchmark(spark))
    assert left.columns == docs.columns and left.count() == docs.count()
    same = documents(spark, [ITEMS[1], ITEMS[1], noise(1)], [None, 3, 3])
    pairs = [(r["id"], r["item_id"]) for r in decontaminate.contaminated(same, benchmark(spark)).collect()]
    assert sorted(pairs, key=str) == [(3, 1), (None, 1)]
    assert decontaminate.contaminated(no_documents(spark), benchmark(spark)).count() == 0
    assert decontaminate.contaminated(docs, benchmark(spark).where("false")).count() == 0


def test_shortest_items(spark):
    texts = ["that was too short, he said", "Too SHORT", "too long and too far short", "too\nshort"]
    assert set(found(spark, texts)) == {(0, 4), (1, 4), (3, 4)}
    assert found(spark, texts, least_words=3) == {}


def test_rows_that_share_an_id(spark):
    texts = [f"{noise(1)} {ITEMS[1]}", noise(2), f"{noise(3)} {ITEMS[2]}", noise(4), None]
    docs = documents(spark, texts, [None, None, 7, 7, 7])
    left = decontaminate.drop_contaminated(docs, benchmark(spark))
    assert left.columns == docs.columns
    assert sorted([(r["doc_id"], r["text"]) for r in left.collect()], key=str) == sorted(
        [(None, texts[1]), (7, texts[3]), (7, None)], key=str
    )


def test_tokens_on_bytes_are_those_of_the_pattern():
    """The cut on bytes against the pattern on whole words, on texts of awkward characters."""
    draw = random.Random(8)
    letters = "abZÀéÿßÞ×÷ '/%$.,:;!?…_-12\n\t\x1c\xa0日Ωı²"
    texts = ["".join(draw.choice(letters) for _ in range(draw.randrange(25))) for _ in range(3_000)]
    texts += ["", "Twenty km.", "A b. C", "x" * 60 + ". Y", "É. é", "É" * 30 + "!", "end.", ".Start"]
    tokens, ends = decontaminate.Templates()._tokens(pa.array(texts, pa.string()))
    wanted = [decontaminate._learn_words([w.encode() for w in re.split("[\t-\r\x1c-\x1f ]+", t) if w]) for t in texts]
    assert np.diff(ends, prepend=0).tolist() == [len(w) for w, _ in wanted]
    assert (tokens == np.concatenate([w for w, _ in wanted])).all()
