"""Importance resampling towards a target distribution, over hashed word n-grams.

A text is lower-cased (A-Z), its separators are collapsed to single spaces, and one overlapped regular expression walks over
the boundaries: each match is the longest run of up to three words from there, the shorter runs end at the boundaries in between. The spans
go straight into checksums, for all spans of a batch at once. Bucket counts of every document are kept as a table; a second pass weighs them.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardlight.functions.scans import global_rank
from wardlight.llm.blocks import pack_sorted, unpack_sorted, write_table

BUCKETS = 10_000
LONGEST = 3  # words of a feature
SPACE, END = 32, 0  # between words, after a text
BATCH_BYTES = 2_000_000
LOCKSTEP = 512  # bytes; spans beyond are hashed one by one


def _plain() -> bytes:
    """A-Z become a-z, all other bytes that no word holds become spaces; bytes of characters beyond ASCII stay."""
    def to(b: int) -> int:
        if 65 <= b <= 90:
            return b + 32
        return b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else SPACE

    return bytes(to(b) for b in range(256))


PLAIN = _plain()
# A boundary, then up to three words; the lookaround keeps the last one whole.
SPANS = regex.compile(rb" [^ \x00]++(?: [^ \x00]++(?: [^ \x00]++)?+)?+(?![^ \x00])")


def collapsed(text: bytes) -> bytes:
    """The words of a text, a space before each and the mark of the end behind the last."""
    words = text.translate(PLAIN).split()
    return (b" " + b" ".join(words) if words else b"") + bytes([END])


def feature_spans(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """First bytes of all words of ``data`` (several collapsed texts) and the ends (words, LONGEST) of the runs of 1, 2, .. words from there; runs that a text cuts short repeat an end."""
    match_end = type(SPANS.search(b" a")).end  # unbound, for map
    ends = np.fromiter(map(match_end, SPANS.finditer(data, overlapped=True)), np.int64)
    bounds = np.flatnonzero(np.frombuffer(data, np.uint8) == SPACE)  # each starts a match
    runs = np.empty((len(bounds), LONGEST), np.int64)
    for k in range(1, LONGEST + 1):
        runs[:, k - 1] = ends
        runs[:len(bounds) - k, k - 1] = np.minimum(bounds[k:], ends[:len(bounds) - k])
    return bounds + 1, runs


def _crc_table() -> np.ndarray:
    """The state after each byte, from a state of zero; the polynomial of zlib's CRC-32."""
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, (c >> 1) ^ np.uint32(0xEDB88320), c >> 1)
    return c


CRC = _crc_table()


def checksums(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """CRC-32 of data[start:end] for each row of ``starts`` and each column of ``ends`` (which rise along a row); one walk for all columns."""
    out = np.zeros(ends.shape, np.uint32)
    last = ends[:, -1] - starts
    for i in np.flatnonzero(last > LOCKSTEP):
        for k, e in enumerate(ends[i]):
            out[i, k] = zlib.crc32(data[starts[i]:e])
    rows = np.flatnonzero(last <= LOCKSTEP)
    rows = rows[np.argsort(-last[rows], kind="stable")]
    at, sizes = starts[rows], ends[rows] - starts[rows, None]
    state = np.full(len(rows), 0xFFFFFFFF, np.uint32)
    live = np.searchsorted(-sizes[:, -1], -np.arange(int(sizes[:, -1].max(initial=0)) + 1), side="left")  # rows longer than j bytes
    got = np.zeros(sizes.shape, np.uint32)
    for j, n in enumerate(live[:-1]):
        s = state[:n]
        np.bitwise_xor(CRC[(s ^ data[at[:n] + j]) & 255], s >> 8, out=s)
        for k in range(sizes.shape[1]):
            done = np.flatnonzero(sizes[:n, k] == j + 1)
            got[done, k] = s[done]
    out[rows] = ~got
    return out


def bucket_counts(texts: list[bytes]) -> Iterator[tuple[int, np.ndarray]]:
    """For each text: number of words, sorted buckets of its features, repeats included."""
    parts = [collapsed(t) for t in texts]
    data = b"".join(parts)
    starts, ends = feature_spans(data)
    buckets = checksums(np.frombuffer(data, np.uint8), starts, ends) % BUCKETS
    real = np.ones(ends.shape, bool)
    real[:, 1:] = ends[:, 1:] > ends[:, :-1]
    owner = np.searchsorted(np.cumsum([len(p) for p in parts]), starts, side="right")
    keys = np.sort((owner[:, None] * BUCKETS + buckets)[real])
    cut = np.searchsorted(keys, np.arange(len(parts) + 1) * BUCKETS)
    words = np.bincount(owner, minlength=len(parts))
    for i in range(len(parts)):
        yield int(words[i]), keys[cut[i]:cut[i + 1]] - i * BUCKETS


def count_features(rows: DataFrame, key: str, label: str) -> DataFrame:
    """(key, n_words, n_features, buckets) for each row of ``rows`` (key, text); a table in the shared folder."""
    def run(batches):
        def counted(keys, texts):
            found = list(bucket_counts(texts))
            return pa.RecordBatch.from_pydict({
                key: pa.array(keys, pa.int64()), "n_words": pa.array([n for n, _ in found], pa.int64()), "n_features": pa.array([len(b) for _, b in found], pa.int64()),
                "buckets": pa.array([pack_sorted(b) for _, b in found], pa.binary()),
            })

        for batch in batches:
            keys, texts, held = [], [], 0
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                keys.append(k)
                texts.append((t.as_py() or "").encode())
                held += len(texts[-1])
                if held >= BATCH_BYTES:
                    yield counted(keys, texts)
                    keys, texts, held = [], [], 0
            if keys:
                yield counted(keys, texts)

    named = rows.select(F.col(key).cast("long").alias(key), F.col("text").cast("string").alias("text"))
    return write_table(named.mapInArrow(run, f"{key} long, n_words long, n_features long, buckets binary"), label)


def bucket_totals(counted: DataFrame) -> np.ndarray:
    """Features of all rows in each bucket: a sum per task, then per bucket; what reaches the driver has BUCKETS rows."""
    def run(batches):
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for b in batch.column(0):
                total += np.bincount(unpack_sorted(b.as_buffer())[0].astype(np.int64), minlength=BUCKETS)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"bucket": pa.array(used, pa.int32()), "n": pa.array(total[used], pa.int64())})

    sums = counted.select("buckets").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(BUCKETS, np.int64)
    for r in sums.collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln) of how much likelier the target makes each bucket, with one added to every count."""
    s, t = corpus.astype(float), target.astype(float)
    ratio = (t + 1) * (s.sum() + BUCKETS) / ((s + 1) * (t.sum() + BUCKETS))
    return np.array([math.floor(1000 * math.log(x)) for x in ratio], np.int64)


def weigh(counted: DataFrame, gain: np.ndarray, key: str = "doc_id") -> DataFrame:
    """(key, n_words, n_features, weight): the sum of the gains of a row's features."""
    def run(batches):
        for batch in batches:
            weight = [int(gain[unpack_sorted(b.as_buffer())[0].astype(np.int64)].sum()) for b in batch.column(3)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(weight, pa.int64())], [key, "n_words", "n_features", "weight"])

    return counted.select(key, "n_words", "n_features", "buckets").mapInArrow(run, f"{key} long, n_words long, n_features long, weight long")


def resample(docs: DataFrame, target: DataFrame, percent: int = 5, least_words: int = 20, seed: int = 42) -> DataFrame:
    """doc_id, n_words, n_features, weight, score, rank for each row of ``docs`` (doc_id, text), drawn towards ``target`` (text).

    weight: sum of the bucket gains of a text's features (runs of 1 to 3 words, repeats counted), 0 without any. score: weight plus
    1000 times a Gumbel draw that depends on ``seed`` and doc_id alone, both floored. Of the N rows with ``least_words`` words or more the floor(``percent`` * N / 100)
    highest scores are drawn without replacement; rank numbers them from 1, ties go to the smaller doc_id, other rows have null.

    Null texts have no words. A null doc_id is hashed as an empty name and comes after all others among ties. Rows of one doc_id are rows of their own with
    the same draw; among those alike in score the one with fewer words, then features, is first. Other columns are not read. An empty target gives gains by the
    corpus alone; an empty table gives an empty result.
    """
    counted = count_features(docs, "doc_id", "features")
    wanted = count_features(target.select(F.lit(0).alias("item"), "text"), "item", "target-features")
    weighed = weigh(counted, gains(bucket_totals(counted), bucket_totals(wanted)))
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("double")
    draw = F.floor(-1000.0 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))
    scored = write_table(weighed.withColumn("score", F.col("weight") + draw), "scores")
    able = scored.where(F.col("n_words") >= least_words)
    tie = F.struct(F.coalesce("doc_id", F.lit((1 << 63) - 1)).alias("id"), "n_words", "n_features").alias("tie")
    ranked = global_rank(able.select("*", tie), "score", "tie", descending=True).drop("tie")
    drawn = F.when(F.col("rank") <= percent * able.count() // 100, F.col("rank"))
    rest = scored.where(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long"))
    return ranked.withColumn("rank", drawn).unionByName(rest).select("doc_id", "n_words", "n_features", "weight", "score", "rank")
