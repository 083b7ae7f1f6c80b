"""Importance resampling: against a plain-Python version, and bytes in awkward places."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
from cases import empty, frame, order, texts

from wardlight.llm.importance import BUCKETS, bucket_counts, checksums, gains, resample

TOKEN = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(text):
    return TOKEN.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def buckets(text):
    w = words(text)
    return [zlib.crc32(" ".join(w[i:i + n]).encode()) % BUCKETS for n in (1, 2, 3) for i in range(len(w) - n + 1)]


def brute(rows, target, percent, least, seed):
    s, t = Counter(b for _, x in rows for b in buckets(x)), Counter(b for x in target for b in buckets(x))
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (s.total() + BUCKETS) / ((s[b] + 1) * (t.total() + BUCKETS)))) for b in set(s)}
    out = []
    for d, x in rows:
        found = buckets(x)
        h = int(hashlib.sha256(f"{seed}:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in found)
        out.append([d, len(words(x)), len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    able = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], order(r[0]), r[1], r[2]))
    for k, r in enumerate(able[:percent * len(able) // 100]):
        r[5] = k + 1
    return Counter(map(tuple, out))


def test_against_plain_python(spark):
    rows = texts() + [(900, "Ａ ΟΔΟΣ Straße\x7fx\x00y " * 20), (901, "one" + "\x00" * 40 + "two"), (902, "x" * 3000 + " " + "y" * 700)]
    target = [t for _, t in texts()[:6]] + [None, "", "one two three one two three"]
    frame_ = spark.createDataFrame([(t,) for t in target], "text string")
    got = resample(frame(spark, rows), frame_, percent=30)
    assert got.columns == ["doc_id", "n_words", "n_features", "weight", "score", "rank"]
    assert Counter(map(tuple, got.collect())) == brute(rows, target, 30, 20, 42)
    assert Counter(map(tuple, resample(frame(spark, rows), frame_.limit(0), percent=100, least_words=1, seed=7).collect())) == brute(rows, [], 100, 1, 7)
    assert resample(empty(spark), frame_).count() == 0


def test_words_of_awkward_bytes():
    r = random.Random(4)
    rows = ["".join(r.choice("aZ9 .\x00\x7f\nßé漢😀") for _ in range(r.randrange(60))) for _ in range(300)] + ["", " ", "a", "a b", "a  b\tc d"]
    for t, (n, found) in zip(rows, bucket_counts([t.encode() for t in rows]), strict=True):
        assert n == len(words(t)) and found.tolist() == sorted(buckets(t))


def test_checksums():
    r = np.random.default_rng(2)
    data = r.integers(0, 256, 3000).astype(np.uint8)
    starts = r.integers(0, 1500, 200)
    ends = np.sort(starts[:, None] + r.integers(1, 1400, (200, 3)), axis=1)
    ends[:50] = starts[:50, None] + np.sort(r.integers(1, 30, (50, 3)), axis=1)
    want = [[zlib.crc32(data[a:e].tobytes()) for e in row] for a, row in zip(starts, ends, strict=True)]
    assert checksums(data, starts, ends).tolist() == want


def test_gains():
    one = np.zeros(BUCKETS, np.int64)
    assert set(gains(one, one)) == {0}
    one[5] = 3
    assert gains(np.zeros(BUCKETS, np.int64), one)[5] == math.floor(1000 * math.log(4 * 10000 / 10003))
