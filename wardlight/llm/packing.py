"""Documents packed into sequences of a fixed number of tokens, best fit decreasing.

Overlong documents are cut into full windows first; only their rests and short documents are packed. Pieces of one
length are alike, so best fit decreasing needs no more than the number of pieces of each length: the driver runs it over that table
(as many rows as a window has tokens), whole runs of equal windows at a time, with a segment tree over the
remaining capacities that finds the tightest open window. The tasks then number the pieces of each length and look
up where each number goes.
"""

from __future__ import annotations

import zlib
from collections import deque

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wardlight.llm.blocks import BLOCK_BYTES, NO_ID, block_of, packer, write_table
from wardlight.llm.tokens import encoder, with_end
from wardlight.session import small_or_self


class OpenWindows:
    """Open windows by remaining capacity; a segment tree finds the least capacity that is large enough."""

    def __init__(self, capacity: int) -> None:
        self.size = 1 << capacity.bit_length()
        self.tree = [0] * (2 * self.size)  # is there an open window in this range of capacities?
        self.runs: list[deque[tuple[int, int]]] = [deque() for _ in range(self.size)]  # (first sequence, how many)

    def _set(self, capacity: int) -> None:
        node = capacity + self.size
        self.tree[node] = int(bool(self.runs[capacity]))
        while node > 1:
            node >>= 1
            self.tree[node] = self.tree[2 * node] | self.tree[2 * node + 1]

    def add(self, capacity: int, first: int, count: int) -> None:
        if count and capacity:
            self.runs[capacity].append((first, count))
            self._set(capacity)

    def tightest(self, least: int) -> int | None:
        """The smallest capacity of at least ``least`` that an open window has."""
        node = least + self.size
        if self.tree[node]:
            return least
        while node > 1:
            if node % 2 == 0 and self.tree[node + 1]:
                node += 1
                while node < self.size:
                    node = 2 * node if self.tree[2 * node] else 2 * node + 1
                return node - self.size
            node >>= 1
        return None

    def take(self, capacity: int, most: int) -> tuple[int, int]:
        """(first sequence, how many) of up to ``most`` windows of this capacity."""
        first, count = self.runs[capacity].popleft()
        if count > most:
            self.runs[capacity].appendleft((first + most, count - most))
            count = most
        self._set(capacity)
        return first, count


def best_fit_decreasing(lengths: dict[int, int], window: int) -> list[tuple[int, int, int, int, int, int]]:
    """Placements (length, from rank, to rank, pieces a window, first sequence, offset) of ``lengths``: length -> pieces."""
    open_, out, sequences = OpenWindows(window), [], 0
    for length in sorted(lengths, reverse=True):
        rank, total = 0, lengths[length]
        while rank < total:
            capacity = open_.tightest(length)
            if capacity is None:
                capacity = window
                each = capacity // length
                first, count = sequences, -(-(total - rank) // each)
                sequences += count
            else:
                each = capacity // length  # a window stays the tightest until it is full
                first, count = open_.take(capacity, -(-(total - rank) // each))
            placed = min(count * each, total - rank)
            out.append((length, rank, rank + placed, each, first, window - capacity))
            full, rest = divmod(placed, each)
            open_.add(capacity - each * length, first, full)
            if rest:
                open_.add(capacity - rest * length, first + full, 1)
            rank += placed
    return out


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, task int, local long"


def pieces_of(docs: DataFrame, vocabulary: str, window: int, end: int, ids: bool) -> DataFrame:
    """Full windows and rests of encoded documents, numbered by length within each task; a table in the shared folder."""
    def run(batches):
        task, seen = TaskContext.get().partitionId(), np.zeros(window + 1, np.int64)
        for packed in packer(BLOCK_BYTES)(batches):
            block = block_of(packed.to_pylist()[0])
            tokens, counts = with_end(*encoder(vocabulary, names=True).encode(block), end)
            number = (counts + window - 1) // window
            doc = np.repeat(np.arange(len(counts)), number)
            start = (np.arange(len(doc)) - np.repeat(np.cumsum(number) - number, number)) * window
            length = np.minimum(window, counts[doc] - start)
            order = np.argsort(length, kind="stable")
            sizes = np.bincount(length, minlength=window + 1)
            local = np.empty(len(doc), np.int64)
            local[order] = np.arange(len(doc)) - (np.cumsum(sizes) - sizes)[length[order]] + seen[length[order]]
            seen += sizes
            raw = memoryview(tokens.astype("<u4").tobytes())
            at = (np.cumsum(counts) - counts)[doc] + start
            parts = [raw[4 * a:4 * (a + n)] for a, n in zip(at.tolist(), length.tolist(), strict=True)]
            ids_ = block.ids[doc]
            out = {
                "doc_id": pa.array(ids_, mask=ids_ == NO_ID), "start": pa.array(start), "length": pa.array(length), "ids_crc32": pa.array([zlib.crc32(p) for p in parts], pa.int64()),
                "doc_tokens": pa.array(counts[doc]), "task": pa.array([task] * len(doc), pa.int32()), "local": pa.array(local),
            }
            if ids:
                out["ids"] = pa.array([p.tobytes() for p in parts], pa.binary())
            yield pa.RecordBatch.from_pydict(out)

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return write_table(rows.mapInArrow(run, PIECES + (", ids binary" if ids else "")), "pieces")


def pack_documents(docs: DataFrame, vocabulary: str, window: int = 2048, end: int = 1, ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset; with ``ids`` its ids (32-bit little endian).

    Every id of each document, ``end`` behind its text included, lies in one piece; pieces of a sequence follow each other without
    gaps from offset 0. Null and empty texts are the id ``end`` alone; repeated rows are packed each; a null doc_id
    stays null. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    pieces = pieces_of(docs, vocabulary, window, end, ids)
    counts = write_table(pieces.groupBy("task", "length").count(), "piece-counts")
    # ``window`` rows at most
    lengths = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("count").alias("n")).collect()}
    places = spark.createDataFrame(best_fit_decreasing(lengths, window), "length long, low long, high long, each long, first long, base long")
    upto = F.sum("count").over(Window.partitionBy("length").orderBy("task"))  # one row per task
    bases = counts.select("task", "length", (upto - F.col("count")).alias("before"))
    ranked = pieces.join(small_or_self(bases, 200_000), ["task", "length"]).withColumn("rank", F.col("before") + F.col("local"))
    # a few rows per length: bounded by the window, whatever the corpus
    placed = ranked.join(F.broadcast(places), "length").where((F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high")))
    nth = F.col("rank") - F.col("low")
    sequence, offset = F.col("first") + F.floor(nth / F.col("each")), F.col("base") + (nth % F.col("each")) * F.col("length")
    return placed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", sequence.cast("long").alias("sequence_id"), offset.cast("long").alias("offset"), *(["ids"] if ids else []))
