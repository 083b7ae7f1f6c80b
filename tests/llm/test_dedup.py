"""Repeated byte strings, repeated windows of words, similar sets: against brute force."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from cases import empty, frame, order, texts
from pyspark.sql import functions as F

from wardlight.llm import ngram_join, suffix_dedup
from wardlight.llm.blocks import Block, part_of
from wardlight.llm.ngram_join import divide_skip, required, similar_documents
from wardlight.llm.suffix_dedup import merge_runs, remove_repeated_bytes
from wardlight.llm.window_dedup import level_lengths, longest_repeats, remove_repeated_windows

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def covered(sequences, width):
    """For each (doc_id, sequence): which places lie in a window that starts in an earlier document too."""
    first = {}
    for d, s in sequences:
        for i in range(len(s) - width + 1):
            w = tuple(s[i:i + width])
            first[w] = min(first.get(w, order(d)), order(d))
    out = []
    for d, s in sequences:
        gone = [False] * len(s)
        for i in range(len(s) - width + 1):
            if first[tuple(s[i:i + width])] < order(d):
                gone[i:i + width] = [True] * width
        out.append(gone)
    return out


@pytest.mark.parametrize("window", [50, 24])
def test_repeated_bytes(spark, window):
    rows = [(d, t) for d, t in texts() if d != 400]
    raw = [(d, (t or "").encode()) for d, t in rows]
    want = Counter()
    for (d, b), gone in zip(raw, covered(raw, window), strict=True):
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        spans = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        want[(d, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest())] += 1
    got = Counter(tuple(r)[:5] for r in remove_repeated_bytes(frame(spark, rows), window).collect())
    assert got == want
    assert sum(k[2] > 0 for k in want) > 10


def a_block(n_bytes=400_000):
    rng = random.Random(8)
    syllables = [a + b for a in ("th", "s", "on", "re", "h", "t") for b in ("an", "e", "ing", "o", " in ", " ")]
    docs = ["".join(rng.choice(syllables) for _ in range(rng.randrange(900))).encode() for _ in range(n_bytes // 1000)]
    return Block(0, np.arange(len(docs)), np.concatenate(([0], np.cumsum([len(d) for d in docs]))), np.frombuffer(b"".join(docs), np.uint8))


def test_anchors_are_dealt_evenly():
    block = a_block()
    at, h = suffix_dedup.anchors(block, 50)
    counts = np.bincount(part_of(h, 32).astype(int), minlength=32)
    assert len(at) > 10_000 and counts.max() < 1.5 * counts.mean() and counts.min() > counts.mean() / 1.5
    sliced = suffix_dedup.anchors(block, 50, 5_000)
    assert np.array_equal(at, sliced[0]) and np.array_equal(h, sliced[1])


def test_runs_are_squeezed(monkeypatch):
    monkeypatch.setattr(suffix_dedup, "gather", lambda keys, *rest: np.ones(len(keys), bool))
    found = suffix_dedup._Suffixes(a_block(), 50, 4, {})
    runs = found.runs()
    rows = np.concatenate([suffix_dedup._read_run(runs[p], 84)[1] for p in sorted(runs)])
    assert np.array_equal(rows, found.rows[found.new])
    assert sum(map(len, runs.values())) < 50 * len(rows)  # of 84 bytes each


def test_blocks_hold_more_than_is_hashed_at_a_time(spark, monkeypatch):
    """Messages number blocks times ranges."""
    made = []
    monkeypatch.setattr(suffix_dedup, "send", lambda blocks, function, parts, *rest, f=suffix_dedup.send: (made.append((blocks.count(), parts, blocks.rdd.getNumPartitions())), f(blocks, function, parts, *rest))[1])
    text = F.concat_ws(" ", *[F.sha2(F.concat(F.col("id").cast("string"), F.lit(f"/{k}")), 512) for k in range(40)])
    docs = spark.range(700, numPartitions=1).select(F.col("id").alias("doc_id"), text.alias("text"))  # 3.6 MB
    remove_repeated_bytes(docs).count()
    assert len(made) == 2 and all(n == 1 and parts <= max(4, partitions) for n, parts, partitions in made)


def test_window_bounds(spark):
    with pytest.raises(ValueError):
        remove_repeated_bytes(empty(spark), 90)


@pytest.mark.parametrize("words", [13, 5, 20])
def test_repeated_windows(spark, words):
    rows = texts()
    split = [(d, WORD.findall((t or "").encode())) for d, t in rows]
    want = Counter()
    for (d, w), gone in zip(split, covered(split, words), strict=True):
        kept = b" ".join(x for x, g in zip(w, gone, strict=True) if not g)
        want[(d, len(w), sum(gone), hashlib.sha256(kept).hexdigest(), kept.decode())] += 1
    got = Counter(tuple(r) for r in remove_repeated_windows(frame(spark, rows), words).collect())
    assert got == want


def test_levels_double():
    assert level_lengths(13) == [7, 13]
    assert level_lengths(50) == [7, 13, 25, 50]


def test_longest_repeats(spark):
    found = {r.doc_id: r.longest for r in longest_repeats(frame(spark, [(1, "a b c d e f g h i j"), (2, "x b c d e f g h i y"), (3, "q r s"), (4, None)]), 4).collect()}
    assert found == {1: 8, 2: 8, 3: 0, 4: 0}


@pytest.mark.parametrize("runs", [1, 2, 5, 13])
def test_merge_of_runs_keeps_order_and_prefixes(runs):
    r = random.Random(runs)
    width = 8
    parts = [sorted({bytes(r.choice(b"ab") for _ in range(width)) for _ in range(r.randint(1, 40))}) for _ in range(runs)]

    def common(x, y):
        return next((i for i in range(width) if x[i] != y[i]), width)

    prefixes = [[0] + [common(a, b) for a, b in zip(p, p[1:], strict=False)] for p in parts]
    which, lcp = merge_runs(parts, prefixes, width)
    place, out = [0] * runs, []
    for k in which:
        out.append(parts[k][place[k]])
        place[k] += 1
    assert out == sorted(x for p in parts for x in p)
    assert lcp[1:] == [common(a, b) for a, b in zip(out, out[1:], strict=False)]


def sets_of(rows):
    out = []
    for _, t in rows:
        w = WORD.findall(bytes(c + 32 if 65 <= c <= 90 else c for c in (t or "").encode()))
        out.append(frozenset(tuple(w[i:i + 3]) for i in range(max(1, len(w) - 2))) if w else frozenset())
    return out


@pytest.mark.parametrize("percent", [90, 60])
def test_similar_documents(spark, percent):
    rows = texts()
    sets = sets_of(rows)
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    want = Counter((d, len(sets[i]), least.get(find(i)) if sets[i] else d) for i, (d, _) in enumerate(rows))
    assert Counter(tuple(r) for r in similar_documents(frame(spark, rows), percent).collect()) == want


def test_divide_skip_is_exact():
    import numpy as np

    r = np.random.default_rng(3)
    query = np.sort(r.choice(1000, 200, replace=False)).astype(np.uint64)
    sets = []
    for k in range(40):
        own = np.concatenate((r.choice(query, 200 - 2 * k, replace=False), 2000 + r.choice(1000, k, replace=False).astype(np.uint64)))
        sets.append(np.sort(own))
    sizes = np.array([len(s) for s in sets])
    want = [j for j, s in enumerate(sets) if 100 * len(np.intersect1d(query, s)) >= 90 * len(np.union1d(query, s))]
    assert sorted(divide_skip(query, len(query), sets, sizes, 90)) == want
    assert required(np.array([10]), np.array([10]), 90)[0] == 10


@pytest.mark.parametrize("operator", [remove_repeated_bytes, remove_repeated_windows, similar_documents])
def test_empty_tables(spark, operator):
    assert operator(empty(spark)).count() == 0


@pytest.mark.parametrize("n", [200, 800])
def test_a_group_of_near_copies_asks_for_nothing(spark, n):
    """Rows between chunks are made for lists with two components only: none for one group, as many as outsiders and chunks otherwise."""
    postings = spark.range(n).select(F.explode(F.array(F.lit(1), F.lit(2), F.col("id") % 5 + 10)).alias("h"), F.col("id").alias("key"))
    ranked = spark.range(n).select(F.col("id").alias("key"), (F.col("id") % 20).alias("chunk"), F.struct(F.lit(n).cast("long").alias("size"), F.lit(0).cast("long").alias("label")).alias("rank"))
    queries, tops = ngram_join.asking(postings, ranked)
    assert queries.count() == 0 and tops.count() == 0
    outsider = spark.createDataFrame([(1, n)], "h int, key long"), spark.createDataFrame([(n, 99, (1, n))], "key long, chunk long, rank struct<size:long,label:long>")
    queries, tops = ngram_join.asking(postings.union(outsider[0]), ranked.union(outsider[1]))
    assert [r["key"] for r in queries.collect()] == [n] and tops.count() == 21
    assert ngram_join.open_queries(postings.union(outsider[0]), ranked.union(outsider[1]).select("key", "chunk"), ranked.select(F.col("key").alias("v"), F.lit(0).cast("long").alias("label"))).count() == 20
