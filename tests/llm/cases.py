"""A small table of documents with the awkward cases, and plain-Python references."""

import random

from pyspark.sql import types as T

SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("block", T.StringType()), T.StructField("part", T.IntegerType()),
    T.StructField("key", T.StringType()), T.StructField("content", T.StringType()), T.StructField("findings", T.StringType()), T.StructField("n_words", T.StringType()),
])


def texts():
    """(doc_id, text): copies, near copies, shared passages, other alphabets, blanks, nulls, repeated rows, ties."""
    r = random.Random(5)
    vocabulary = ["".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(1, 8))) for _ in range(150)] + ["Été", "straße", "λόγος", "漢字", "don't", "x=1;", "42nd", "😀", "a b"]
    words = lambda n: [r.choice(vocabulary) for _ in range(n)]
    passage, base = words(30), words(120)
    out = [(100 + i, " ".join(words(r.randint(1, 90)))) for i in range(40)]
    out += [(200 + i, " ".join(words(10) + passage + words(8))) for i in range(12)]
    for i in range(10):
        near = list(base)
        near[r.randrange(len(near))] = "changed"
        out.append((300 + i, "  ".join(near) if i % 2 else "\n".join(near)))
    out += [(310, " ".join(base).upper()), (20, " ".join(base)), (21, " ".join(base)), (7, "the of " * 60), (8, "aaaa" * 60), (9, "aaaa" * 61), (10, "aaaa" * 60)]
    out += [(1, None), (2, ""), (3, " \t\n "), (4, "one"), (5, "One two"), (6, "one two"), (11, "one"), (None, " ".join(base)), (None, None), (400, " ".join(words(4000))), (401, "y" * 5000)]
    out += [(402, " ".join(passage)), (402, " ".join(passage)), (402, " ".join(passage[:20] + words(5))), (0, " ".join(passage)), (-5, " ".join(words(3) + base + ["end"]))]
    r.shuffle(out)
    return out


def frame(spark, rows):
    return spark.createDataFrame([(d, t, "b", 1, "k", "c", "f", "w") for d, t in rows], SCHEMA).repartition(3)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


LAST = 1 << 63


def order(doc_id):
    return LAST if doc_id is None else doc_id
