"""Small tables that hold the awkward cases, and plain versions of a few operators."""

import random

from pyspark.sql import types as T

#: Names that operators use inside, or return, as extra columns of the input.
CLASHES = ("id", "keep_id", "kept", "digest", "component", "shard", "slot", "score", "fp", "x", "ids", "id_r", "refers_to")

DOCUMENTS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
        *(T.StructField(name, T.StringType()) for name in CLASHES),
    ]
)

LONG = " ".join(f"w{i % 997}x{i}" for i in range(30_000))
ODD_TEXTS = [
    None,
    "",
    " ",
    "\t\n",
    "one",
    "two  words",
    "two words",
    "Ünïcödé ñ 日本 🙂 ΑΣ İ",
    "a" * 5_000,
    " " * 700 + "x",
    LONG,
    "repeat me " * 50,
    "<s> </s> <|endoftext|> <0x41> ▁▁",
    "1,000.5 km!? “quoted” – dash",
]


def documents(spark, texts, ids=None):
    rows = [
        (i, t, None if k % 3 == 0 else "en", f"src{k % 4}" if k % 5 else None, None, *(["y"] * len(CLASHES)))
        for k, (i, t) in enumerate(zip(ids if ids is not None else range(len(texts)), texts))
    ]
    return spark.createDataFrame(rows, DOCUMENTS)


def odd_documents(spark):
    """Null, empty, blank and long texts, a null id, and a row that is there twice."""
    texts = [*ODD_TEXTS, "one", "same again", "same again", "same again"]
    ids = [*range(len(ODD_TEXTS)), 50, 60, 60, None]
    return documents(spark, texts, ids)


def no_documents(spark):
    return documents(spark, [])


def words(count, seed):
    draw = random.Random(seed)
    heads, tails = ("the", "of", "on", "er", "in", "an"), ("tion", "ly", "sh", "ed", "", "nd")
    return [draw.choice(heads) + draw.choice(tails) + str(draw.randrange(60)) for _ in range(count)]


def components(nodes, near):
    """Component of each node (smallest node it reaches), over all pairs."""
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    order = list(nodes)
    for i, a in enumerate(order):
        for b in order[:i]:
            if near(a, b):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}
