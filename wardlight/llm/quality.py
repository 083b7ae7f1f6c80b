"""Quality scores by a regularised quadratic discriminant over document statistics.

Each text becomes a short vector of statistics, transformed so that they are roughly normal. Per class, the mean and a
covariance shrunk towards the pooled covariance and towards its diagonal are fitted from sums that every task adds up
by itself, over all labelled rows. Scores are differences of log densities, from Mahalanobis distances by Cholesky
factors that are computed once and sent to the tasks.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardlight.llm.blocks import write_table

CLASSES = {name: np.isin(np.arange(256), list(chars)) for name, chars in {
    "upper": range(65, 91), "lower": range(97, 123), "digit": range(48, 58), "space": (32,), "line": (10,), "stop": b".", "comma": b",", "shout": b"!?",
    "symbol": b"#$%&*@^~+=<>|\\/_[]{}", "wide": range(128, 256),
}.items()}
STATISTICS = (*CLASSES, "chars", "words", "word_length", "length_spread", "distinct", "top_word", "pair_repeats", "line_repeats", "word_entropy", "byte_entropy", "short_words", "long_words", "sentence")
ADD = 0.5  # added to counts before shares are taken


def statistics(raw: bytes) -> list[float]:
    """Transformed statistics of one text (UTF-8); shares as logits, counts as logarithms. Defined for an empty text."""
    size = len(raw)
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    logit = lambda k, n: np.log((k + ADD) / (max(n - k, 0) + ADD))
    out = [logit(int(counts[flags].sum()), size) for flags in CLASSES.values()]
    words = raw.split()
    n = len(words)
    lengths = np.fromiter(map(len, words), np.int64, n)
    tally: dict[bytes, int] = {}
    for w in words:
        tally[w] = tally.get(w, 0) + 1
    often = np.fromiter(tally.values(), np.int64, len(tally))
    pairs = len(set(zip(words, words[1:], strict=False)))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    shares, bytes_ = often / max(n, 1), counts[counts > 0] / max(size, 1)
    out += [
        np.log1p(size), np.log1p(n), np.log1p(lengths.mean() if n else 0), np.log1p(lengths.std() if n else 0),
        logit(len(tally), n), logit(int(often.max()) if n else 0, n), logit(max(n - 1, 0) - pairs, max(n - 1, 0)), logit(len(lines) - len(set(lines)), len(lines)),
        float(-(shares * np.log(shares)).sum()) if n else 0.0, float(-(bytes_ * np.log(bytes_)).sum()), logit(int((lengths <= 3).sum()), n), logit(int((lengths >= 9).sum()), n),
        np.log1p(n / (1 + int(counts[46] + counts[33] + counts[63]))),
    ]
    return [float(x) for x in out]


def with_statistics(docs: DataFrame, key: str | None = None) -> DataFrame:
    """(doc_id, x) and the long column ``key`` of ``docs``, if named: one narrow pass over whole texts."""
    def run(batches):
        for batch in batches:
            texts = batch.column(1).cast(pa.large_binary())
            rows = [statistics(t.as_py() or b"") for t in texts]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "x": pa.array(rows, pa.list_(pa.float64()))} | ({key: batch.column(2)} if key else {}))

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *([key] if key else [])).mapInArrow(run, "doc_id long, x array<double>" + (f", {key} long" if key else ""))


@dataclass(frozen=True)
class Discriminant:
    """Fitted densities of classes 0 and 1. ``factors`` are inverse lower Cholesky factors of the covariances."""

    means: np.ndarray
    factors: np.ndarray
    logdets: np.ndarray
    prior: np.ndarray  # log

    def log_density(self, x: np.ndarray, k: int) -> np.ndarray:
        z = (x - self.means[k]) @ self.factors[k].T
        return -0.5 * ((z * z).sum(axis=1) + self.logdets[k]) + self.prior[k]

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of class 1, between 0 and 1."""
        d = self.log_density(x, 1) - self.log_density(x, 0)
        return 1.0 / (1.0 + np.exp(-np.clip(d, -500, 500)))


def moments(rows: DataFrame) -> dict[int, tuple[float, np.ndarray, np.ndarray]]:
    """Count, sum and sum of products per class of (x, label); each task sends one row per class."""
    def run(batches):
        total: dict[int, list] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.array(batch.column(0).to_pylist(), float)
            y = np.array(batch.column(1).to_pylist())
            for k in (0, 1):
                z = x[y == k]
                if len(z):
                    n, s, q = total.get(k, (0, 0.0, 0.0))
                    total[k] = (n + len(z), s + z.sum(axis=0), q + z.T @ z)
        yield pa.RecordBatch.from_pydict({
            "label": pa.array(list(total), pa.int32()), "n": pa.array([float(v[0]) for v in total.values()], pa.float64()),
            "v": pa.array([np.concatenate((v[1], v[2].ravel())).tolist() for v in total.values()], pa.list_(pa.float64())),
        })

    parts = rows.select("x", "label").mapInArrow(run, "label int, n double, v array<double>")
    long = parts.select("label", "n", F.posexplode("v").alias("i", "v"))
    summed = long.groupBy("label", "i").agg(F.sum("v").alias("v"), F.sum("n").alias("n")).toPandas()  # 2 (d + d * d) rows
    d, out = len(STATISTICS), {}
    for k, part in summed.sort_values("i").groupby("label"):
        v = part["v"].to_numpy()
        out[int(k)] = (float(part["n"].iloc[0]), v[:d], v[d:].reshape(d, d))
    return out


def fit(sums: dict, pooled: float = 0.3, diagonal: float = 0.02, floor: float = 1e-3) -> Discriminant:
    """``pooled``: weight of the pooled covariance in each class; ``diagonal``: of the diagonal after that.

    A class without labelled rows takes the pooled mean and covariance, so that all scores are the prior; without any
    labelled row all scores are 0.5.
    """
    d = len(STATISTICS)
    n = np.array([sums[k][0] if k in sums else 0.0 for k in (0, 1)])
    mean = np.array([sums[k][1] / sums[k][0] if k in sums else np.zeros(d) for k in (0, 1)])
    scatter = [sums[k][2] - n[k] * np.outer(mean[k], mean[k]) if k in sums else np.zeros((d, d)) for k in (0, 1)]
    common = (scatter[0] + scatter[1]) / max(n.sum() - 2, 1)
    for k in (0, 1):
        if not n[k]:
            mean[k] = mean[1 - k]
    factors, logdets = [], []
    for k in (0, 1):
        own = scatter[k] / max(n[k] - 1, 1)
        weight = pooled + (1 - pooled) * d / (d + n[k])  # few rows: nearer to the pooled covariance
        c = (1 - weight) * own + weight * common
        c = (1 - diagonal) * c + diagonal * np.diag(np.diag(c)) + floor * np.eye(d)
        lower = np.linalg.cholesky(c)
        factors.append(np.linalg.inv(lower))
        logdets.append(2 * np.log(np.diag(lower)).sum())
    prior = np.log((n + 1) / (n.sum() + 2))
    return Discriminant(mean, np.array(factors), np.array(logdets), prior)


def held_out():
    """Is a document kept from learning: crc32 of doc_id as text, modulo 5, is 0? A null doc_id is."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(True))


def score_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, key: str | None = None) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of ``docs`` (doc_id, text).

    Learns from all rows of ``labels`` (doc_id, quality) that are not held out and whose quality is 0 or 1; a document with
    several labels counts once for each. Null and empty texts have statistics of their own and get a score; rows with
    the same doc_id each get a row; a null doc_id is held out. An empty table gives an empty result; without labels
    every score is 0.5. With ``key`` the long column of that name comes back too, to tell rows of one doc_id apart.
    """
    x = write_table(with_statistics(docs, key), "statistics")
    known = labels.where(F.col("quality").isin(0, 1)).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("label"))
    model = fit(moments(x.join(known, "doc_id").where(~held_out()).select("x", "label")))

    def run(batches):
        for batch in batches:
            rows = batch.column(1).to_pylist()
            scores = model.score(np.array(rows, float)) if rows else np.zeros(0)
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "score": pa.array(scores, pa.float64())} | ({key: batch.column(2)} if key else {}))

    scored = x.mapInArrow(run, "doc_id long, score double" + (f", {key} long" if key else ""))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), *([key] if key else []))
