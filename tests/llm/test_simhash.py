import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tablewright.llm import simhash
from tablewright.llm.common import stored, without
from tests.llm.samples import components, documents, no_documents, odd_documents, words


def plain_fingerprint(text, size):
    found = [w for w in (text or "").encode().translate(bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))).split()]
    if not found:
        return 0
    runs = [b" ".join(found[i : i + size]) for i in range(max(1, len(found) - size + 1))]
    hashes = [xxhash.xxh64_intdigest(r, 42) for r in runs]
    return sum((2 * sum(h >> b & 1 for h in hashes) > len(hashes)) << b for b in range(64))


def signed(value):
    return value - (1 << 64) if value >> 63 else value


def test_table(spark):
    texts = [" ".join(words(40, i)) for i in range(5)]
    texts += [texts[0] + " x", texts[0].upper(), texts[1].replace(" ", "\t\n "), "", None]
    df = documents(spark, texts, range(100, 110)).unionByName(odd_documents(spark))
    rows = simhash.near_duplicates(df).collect()
    source = df.select("doc_id", "text").collect()
    prints = [(r["doc_id"], signed(plain_fingerprint(r["text"], 3))) for r in source]
    assert sorted([(r["id"], r["fp"]) for r in rows], key=str) == sorted(prints, key=str)
    distinct = sorted({f for _, f in prints})
    root = components(distinct, lambda a, b: ((a ^ b) & (1 << 64) - 1).bit_count() <= 3)
    least = {}
    for i, f in prints:
        if i is not None:
            least[root[f]] = min(i, least.get(root[f], i))
    for r in rows:
        assert r["component_id"] == least[root[r["fp"]]]


@pytest.mark.parametrize("bucket", [200, 5])
def test_links_with_hot_signatures(spark, monkeypatch, bucket):
    monkeypatch.setattr(simhash, "BUCKET", bucket)
    draw = np.random.default_rng(3 + bucket)
    prints = set()
    for _ in range(3):  # clusters whose members share most bits
        base = int(draw.integers(0, 1 << 63))
        for _ in range(25):
            flips = draw.choice(24, int(draw.integers(0, 5)), replace=False) * 2
            prints.add(signed(base ^ sum(1 << int(b) for b in flips)))
    prints |= {signed(int(x)) for x in draw.integers(0, 1 << 63, 40)}
    found = simhash.links(spark.createDataFrame([(f,) for f in prints], "fp bigint")).collect()
    near = lambda a, b: ((a ^ b) & (1 << 64) - 1).bit_count() <= 3
    pairs = {(r["a"], r["b"]) for r in found}
    assert all(near(a, b) and a < b for a, b in pairs)
    linked = components(sorted(prints), lambda a, b: (min(a, b), max(a, b)) in pairs)
    assert linked == components(sorted(prints), near)
    if bucket == 200:
        assert pairs == {(a, b) for a in prints for b in prints if a < b and near(a, b)}


def executed_plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_signatures_are_not_broadcast(spark):
    """33 signatures a part and fingerprint, which Spark sizes like the fingerprints themselves."""
    draw = np.random.default_rng(9)
    prints = [(int(f),) for f in draw.integers(-(1 << 62), 1 << 62, 3_000)]
    distinct = stored(spark.createDataFrame(prints, "fp bigint"), "prints")
    plan = executed_plan(simhash.links(distinct))
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


def test_many_rows_to_leave_out_are_not_broadcast(spark):
    """Ids without gaps take little room in files, so that Spark takes their table for a small one."""
    rows = stored(spark.range(400_000), "rows")
    plan = executed_plan(without(rows, stored(spark.range(300_000), "gone"), {"id": F.col("id")}))
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


def test_components_of_long_chains(spark):
    edges = [(i, i + 1) for i in range(60)] + [(200, 100), (100, 300), (5, 5)]
    found = simhash.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()
    got = {r["node"]: r["component"] for r in found}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 200: 100, 300: 100}
    assert len(found) == len(got)
    assert simhash.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def jaccard(a, b):
    a, b = (set(simhash.shingle_set(t or "", 5).tolist()) for t in (a, b))
    return len(a & b) / len(a | b)


def test_near_copies(spark):
    texts, ids = [], []
    for g in range(12):
        base = words(120 + 10 * g, g)
        for copy in range(4):
            edited = list(base)
            for at in range(copy):
                edited[(37 * at + 11 * copy) % len(base)] = "edit" + str(copy)
            texts.append(" ".join(edited))
            ids.append(g * 10 + copy)
    df = documents(spark, texts, ids).unionByName(documents(spark, ["", None, " ", "same", "same"], [900, 901, 902, 903, 903]))
    kept = {r["doc_id"]: r["text"] for r in simhash.keep_one_of_each(df).collect()}
    whole = {r["doc_id"]: r["text"] for r in df.collect()}
    sets = {i: set(simhash.shingle_set(t or "", 5).tolist()) for i, t in whole.items()}
    near = lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])
    group = components(sorted(whole), near)
    assert {i for i in whole if group[i] == i} == set(kept)
    assert len(set(group.values())) < 40
    assert 900 in kept and 901 not in kept and 902 not in kept and 903 in kept


@pytest.mark.parametrize("bucket", [200, 3])
def test_no_near_copy_is_missed(spark, monkeypatch, bucket):
    """Against all pairs: lines in another order, cut and appended copies, scattered edits."""
    monkeypatch.setattr(simhash, "BUCKET", bucket)
    texts = []
    for g in range(8):
        base = words(150, 500 + g)
        lines = [" ".join(base[i : i + 10]) for i in range(0, 150, 10)]
        again = " ".join(base)
        texts += ["\n".join(lines[::-1]), again, again.upper(), again + " " + base[-1]]
        texts += [" ".join(base[:k]) for k in (136, 130, 123, 110)]
        texts += [" ".join(base + words(k, 900 + g)) for k in (15, 25, 35, 60)]
        texts += [" ".join(f"e{g}" if i in (20 * k, 70 + k) else w for i, w in enumerate(base)) for k in range(4)]
        texts.append("a very common line that stands in one text of each group " + " ".join(words(30, 700 + g)))
    df = documents(spark, texts)
    sets = [set(simhash.shingle_set(t, 5).tolist()) for t in texts]
    near = lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])
    group = components(range(len(texts)), near)
    got = {r["id"]: r["keep_id"] for r in simhash.similar_documents(df).collect()}
    assert got == {i: k for i, k in group.items() if i != k}
    assert 1 not in got and got[2] == 1  # tied to each other, not to the smallest of their word set


def test_cut_and_appended_copies(spark):
    """Copies that lack or add one passage, one pair each: all of 0.8 or more are found."""
    texts = []
    for g in range(60):
        base = words(200, 2000 + g)
        size = 10 + g % 30
        texts.append(" ".join(base))
        texts.append(" ".join(base[:-size] if g % 2 else base + words(size, 3000 + g)))
    wanted = {2 * g + 1: 2 * g for g in range(60) if jaccard(texts[2 * g], texts[2 * g + 1]) >= 0.8}
    got = {r["id"]: r["keep_id"] for r in simhash.similar_documents(documents(spark, texts)).collect()}
    assert got == wanted and len(wanted) >= 50


def test_links_are_verified(spark):
    """Documents near by their signatures, yet under the similarity, all stay."""
    base = words(200, 1)
    texts = [" ".join([f"n{k}x{i}" if i % 20 == k else w for i, w in enumerate(base)]) for k in range(8)]
    assert all(jaccard(texts[a], texts[b]) < 0.8 for a in range(8) for b in range(a))
    assert simhash.keep_one_of_each(documents(spark, texts)).count() == 8


def test_only_the_order_reaches_the_driver(spark, monkeypatch):
    """Two million shingles in many tasks, with little room for results: about the limit is taken, the most frequent first."""
    rows = spark.range(0, 2_000_000, 1, 24).selectExpr("xxhash64(id) AS h", "if(id % 100 = 0, 9000 + id % 7, 2 + id % 2) AS count")
    settings = spark.sparkContext._jsc.sc().conf()
    settings.set("spark.driver.maxResultSize", "20m")
    try:
        late, counts = simhash._frequent_first_out(rows, stored)
    finally:
        settings.set("spark.driver.maxResultSize", "1g")
    assert (late[1:] > late[:-1]).all() and (counts >= 9000).sum() == 20_000 and counts.min() == 3
    assert abs(len(late) - simhash.ORDER_LIMIT) < 3_000
    few = spark.createDataFrame([(5, 2), (-3, 9), (4, 1 << 40)], "h bigint, count bigint")
    late, counts = simhash._frequent_first_out(few, stored)
    assert late.tolist() == [-3, 4, 5] and counts.tolist() == [9, 1 << 40, 2]
    monkeypatch.setattr(simhash, "ORDER_LIMIT", 2)
    late, counts = simhash._frequent_first_out(few, stored)
    assert late.tolist() == [-3, 4] and counts.tolist() == [9, 1 << 40]


def test_marks_bound_the_difference():
    draw = np.random.default_rng(5)
    for n in (1, 2, 63, 64, 65, 500, 513, 3_000):
        a = np.unique(draw.integers(-(1 << 62), 1 << 62, n))
        for share in (0, 0.05, 0.2, 1):
            fresh = draw.integers(-(1 << 62), 1 << 62, int(share * n) + (share > 0))
            b = np.unique(np.concatenate([a[len(fresh) // 2 :], fresh]))
            apart = len(np.setxor1d(a, b))
            found = simhash.marks_apart(simhash.marks_of(a), simhash.marks_of(b))
            assert found <= apart and (found >= 0.4 * apart - 9 or apart > 1.5 * n)


def test_a_shingle_of_many_documents_pairs_few(spark, monkeypatch):
    """4,000 documents that share one shingle, wherever the order puts it, and are else unlike."""
    formed = []
    possible = simhash._possible
    monkeypatch.setattr(simhash, "_possible", lambda pairs, *rest: (formed.append(pairs.count()), possible(pairs, *rest))[1])
    monkeypatch.setattr(simhash, "ORDER_COUNT", 1 << 30)  # the sample finds no frequent shingle
    docs = spark.range(4_000).selectExpr(
        "id AS doc_id",
        "concat('the very same five words ', array_join(transform(sequence(1, 12), i -> concat('w', id, 'x', i)), ' ')) AS text",
    )
    docs = docs.unionAll(docs.where("doc_id % 1000 = 7").selectExpr("doc_id + 10000", "concat(text, ' end')"))
    got = {r["id"]: r["keep_id"] for r in simhash.similar_documents(docs).collect()}
    assert got == {10_007: 7, 11_007: 1_007, 12_007: 2_007, 13_007: 3_007}
    assert sum(formed) <= 4_004


@pytest.mark.parametrize("bucket", [3, 12])
def test_many_copies_with_edits(spark, monkeypatch, bucket):
    """Copies around one text, linked and not linked, of which all shingles are frequent."""
    monkeypatch.setattr(simhash, "BUCKET", bucket)
    base = words(100, 40)
    texts = []
    for k in range(60):
        edited = list(base)
        for at in range(k % 7):
            edited[(13 * k + 29 * at) % 100] = f"e{(k + at) % 5}"
        texts.append(" ".join(edited))
    sets = [set(simhash.shingle_set(t, 5).tolist()) for t in texts]
    near = lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])
    group = components(range(len(texts)), near)
    got = {r["id"]: r["keep_id"] for r in simhash.similar_documents(documents(spark, texts)).collect()}
    assert got == {i: k for i, k in group.items() if i != k}


def test_odd_and_empty_tables(spark):
    docs = odd_documents(spark)
    left = simhash.keep_one_of_each(docs)
    assert left.columns == docs.columns
    ids = [r["doc_id"] for r in left.collect()]
    assert None in ids and ids.count(60) == 2 and {4, 5, 7, 10} <= set(ids)
    assert simhash.near_duplicates(no_documents(spark)).count() == 0
    assert simhash.keep_one_of_each(no_documents(spark)).count() == 0


def test_close_fingerprints_are_candidates(spark, monkeypatch):
    """The stage takes candidates from fingerprints too, and measures them: no link below the similarity stays."""
    base = words(400, 7)
    texts = [" ".join(base), " ".join([*base, "end"]), " ".join(words(300, 8)), " ".join(["a"] * 300 + base[:8]), " ".join(["a"] * 300 + base[20:28])]
    df = documents(spark, texts, range(5))
    heads = spark.createDataFrame([(i, signed(plain_fingerprint(t, 5))) for i, t in enumerate(texts)], "id bigint, fp bigint")
    pairs = {(r["a"], r["b"]) for r in simhash._close_prints(heads).collect()}
    assert (0, 1) in pairs and (3, 4) in pairs and jaccard(texts[3], texts[4]) < 0.8
    nothing = spark.createDataFrame([], "h bigint, a bigint, b bigint, pos int")
    monkeypatch.setattr(simhash, "_sharing", lambda heads, similarity: nothing)  # fingerprints alone
    found = {(r["id"], r["keep_id"]) for r in simhash.similar_documents(df).collect()}
    assert found == {(1, 0)}
