"""Documents in blocks of a few MB, and the exchange by which blocks learn what other blocks hold.

A block is one row: the texts of many documents as one byte string, with their ids and sizes. Numpy works on a block
at a time. Blocks are written once, bucketed by block id, so that what comes back to a block meets it without moving
the texts again. What leaves a block is one short byte string per partition of a key space (sorted, delta coded), and
each key occurs once per block there: the rows of a key are summed before the shuffle, however many copies it has.
The answer to such a message lists something for each of its keys, in the same order.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardlight.session import materialize, scratch_path

BLOCK_BYTES = 2_000_000
NO_ID = np.iinfo(np.int64).max  # stands for a null doc_id: later than every other document
MASK = (1 << 64) - 1
U64 = np.uint64


@dataclass
class Block:
    """Documents of one block: ids, the offsets of their texts (one more than documents), the UTF-8 bytes."""

    number: int
    ids: np.ndarray
    offsets: np.ndarray
    data: np.ndarray

    def owner(self) -> np.ndarray:
        """The place of the document of each byte."""
        return np.repeat(np.arange(len(self.ids)), np.diff(self.offsets))


def packer(block_bytes: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def pack(batches):
        number = TaskContext.get().partitionId() << 32
        ids, sizes, chunks, total = [], [], [], 0

        def close():
            return pa.RecordBatch.from_pydict({
                "block": pa.array([number], pa.int64()),
                "ids": pa.array([np.concatenate(ids).tobytes()], pa.binary()),
                "sizes": pa.array([np.concatenate(sizes).tobytes()], pa.binary()),
                "data": pa.array([b"".join(chunks)], pa.binary()),
            })

        for batch in batches:
            if not batch.num_rows:
                continue
            text = batch.column(1).cast(pa.large_binary()).fill_null(b"")
            at = np.frombuffer(text.buffers()[1], np.int64)[text.offset:text.offset + len(text) + 1]
            raw = text.buffers()[2]
            doc = batch.column(0).fill_null(int(NO_ID)).to_numpy(zero_copy_only=False)
            i = 0
            while i < len(doc):
                # as many documents as fit, one at least
                j = max(i + 1, int(np.searchsorted(at, at[i] + block_bytes - total, side="right")) - 1)
                ids.append(doc[i:j])
                sizes.append(np.diff(at[i:j + 1]))
                if raw is not None:
                    chunks.append(raw.slice(int(at[i]), int(at[j] - at[i])).to_pybytes())
                total += int(at[j] - at[i])
                i = j
                if total >= block_bytes or i < len(doc):
                    yield close()
                    number, ids, sizes, chunks, total = number + 1, [], [], [], 0
        if ids:
            yield close()

    return pack


def pack_blocks(docs: DataFrame, block_bytes: int = BLOCK_BYTES, codec: str | None = None) -> DataFrame:
    """``docs`` (doc_id, text) as a bucketed table of blocks in the shared folder; nothing is shuffled for it.

    ``codec`` compresses the files; without one the session's does.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    packed = rows.mapInArrow(packer(block_bytes), "block long, ids binary, sizes binary, data binary")
    name = f"blocks_{uuid.uuid4().hex}"
    # no fewer buckets than shuffle partitions, or a join would move the blocks to that many
    buckets = max(4, rows.rdd.getNumPartitions(), int(spark.conf.get("spark.sql.shuffle.partitions")))
    writer = packed.write.option("path", scratch_path(spark, name))
    if codec:
        writer = writer.option("compression", codec)
    writer.bucketBy(buckets, "block").saveAsTable(name)
    return spark.table(name)


def partitions_of(blocks: DataFrame) -> int:
    """As many partitions of the key space as the table has files' partitions: messages stay as small as blocks."""
    return max(4, blocks.rdd.getNumPartitions())


def block_of(row: dict) -> Block:
    sizes = np.frombuffer(row["sizes"], np.int64)
    return Block(row["block"], np.frombuffer(row["ids"], np.int64), np.concatenate(([0], np.cumsum(sizes))), np.frombuffer(row["data"], np.uint8))


def map_blocks(blocks: DataFrame, function, schema: str, answers: list[DataFrame] = ()) -> DataFrame:
    """``function(block, *answers)`` for each block gives dicts of columns; each answer is a dict part -> bytes."""
    names = []
    for k, table in enumerate(answers):
        name = f"answer{k}"
        names.append(name)
        listed = table.groupBy("block").agg(F.collect_list(F.struct("part", "answer")).alias(name))
        blocks = blocks.join(listed.hint("shuffle_hash"), "block", "left")
    columns = [c.split()[0] for c in schema.split(",")]

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                given = [{x["part"]: x["answer"] for x in row[n] or []} for n in names]
                out = function(block_of(row), *given)
                if out is not None:
                    yield pa.RecordBatch.from_pydict({c: out[c] for c in columns})

    return blocks.mapInArrow(run, schema)


def send(blocks: DataFrame, function, parts: int, answers: list[DataFrame] = ()) -> DataFrame:
    """Messages (part, block, message) from ``function(block, *answers)``, a dict part -> bytes."""
    def rows(block, *given):
        out = function(block, *given)
        return {
            "part": pa.array(list(out), pa.int32()), "block": pa.array([block.number] * len(out), pa.int64()),
            "message": pa.array(list(out.values()), pa.binary()),
        }

    return map_blocks(blocks, rows, "part int, block long, message binary", answers)


def reply(messages: DataFrame, function, label: str) -> DataFrame:
    """``function(list of messages of a part)`` gives the list of answers; kept as a table in the shared folder."""
    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks().sort_by("block")
        out = function([x.as_buffer() for x in table.column("message")])
        return pa.table({"part": table.column("part"), "block": table.column("block"), "answer": pa.array(out, pa.binary())})

    return materialize(messages.groupBy("part").applyInArrow(run, "part int, block long, answer binary"), label)


# Byte strings of arrays

def pack_array(values: np.ndarray) -> bytes:
    """Unsigned 64-bit values, as many bytes of each as the largest needs, byte by byte of significance."""
    values = np.ascontiguousarray(values, U64)
    width = (int(values.max()).bit_length() + 7) // 8 if len(values) else 0
    return np.array([len(values), width], np.int64).tobytes() + values.view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def unpack_array(message, at: int = 0) -> tuple[np.ndarray, int]:
    """The values at byte ``at`` and where the next array begins."""
    n, width = (int(x) for x in np.frombuffer(message, np.int64, 2, at))
    out = np.zeros((n, 8), np.uint8)
    if width:
        out[:, :width] = np.frombuffer(message, np.uint8, n * width, at + 16).reshape(width, n).T
    return out.view(U64).reshape(-1), at + 16 + n * width


def pack_sorted(values: np.ndarray) -> bytes:
    return pack_array(np.diff(values, prepend=U64(0)))


def unpack_sorted(message, at: int = 0) -> tuple[np.ndarray, int]:
    values, at = unpack_array(message, at)
    return np.cumsum(values, dtype=U64), at


def pack_bits(flags: np.ndarray) -> bytes:
    return np.packbits(flags).tobytes()


def unpack_bits(message, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(message, np.uint8), count=n).astype(bool)


def squeeze(message: bytes) -> bytes:
    """A long message, compressed: the shuffle's own fast codec leaves a third more of text."""
    return np.int64(len(message)).tobytes() + pa.Codec("zstd", compression_level=3).compress(message, asbytes=True)


def unsqueeze(message) -> bytes:
    return pa.Codec("zstd").decompress(message[8:], int(np.frombuffer(message, np.int64, 1)[0]), asbytes=True)


# Hashes

def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finish of 64-bit values."""
    h = h ^ (h >> U64(31))
    h = h * U64(0x9E3779B97F4A7C15)
    h = h ^ (h >> U64(29))
    h = h * U64(0xBF58476D1CE4E5B9)
    return h ^ (h >> U64(32))


BYTE_KEYS = mix(np.arange(1, 257, dtype=U64))
BASE = 0xD1342543DE82EF95  # odd


def powers(n: int, base: int = BASE) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    out = np.full(n, base, U64)
    out[:1] = 1
    return np.cumprod(out, dtype=U64)


def part_of(keys: np.ndarray, parts: int, bits: int = 64) -> np.ndarray:
    """Equal ranges of the key space, in the order of the keys."""
    return ((keys >> U64(bits - 32)) * U64(parts)) >> U64(32)


def ranges_of(keys: np.ndarray, parts: int, bits: int = 64) -> Iterator[tuple[int, int, int]]:
    """(part, from, to) of the sorted keys, without empty parts."""
    part = part_of(keys, parts, bits)
    cut = np.flatnonzero(np.diff(part)) + 1
    start = np.concatenate(([0], cut)).astype(np.int64) if len(keys) else np.zeros(0, np.int64)
    stop = np.concatenate((cut, [len(keys)])).astype(np.int64)
    for i, a in enumerate(start):
        yield int(part[a]), int(a), int(stop[i])


SPACES = np.zeros(256, bool)
SPACES[[32, 9, 10, 11, 12, 13]] = True


def words_of(block: Block, spaces: np.ndarray = SPACES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First byte, end and document of each word (runs of bytes that are no white space) of a block."""
    inside = ~spaces[block.data]
    n = len(inside)
    edge = np.zeros(n + 1, bool)  # words end where documents end
    edge[block.offsets] = True
    before = np.zeros(n, bool)
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.zeros(n, bool)
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(block.offsets, starts, side="right") - 1


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte strings [start, end), which do not overlap."""
    if not len(starts):
        return np.zeros(0, U64)
    sizes = ends - starts
    power = powers(int(sizes.max()) + 1)
    first = np.cumsum(sizes) - sizes
    inner = np.arange(int(sizes.sum())) - np.repeat(first, sizes)
    terms = BYTE_KEYS[data[np.repeat(starts, sizes) + inner]] * power[inner]
    return mix(np.add.reduceat(terms, first) + sizes.astype(U64))


def repeated(messages: list) -> list[bytes]:
    """Of sorted distinct keys, one array per block: which of them occur in another block too."""
    arrays = [unpack_sorted(m)[0] for m in messages]
    every = np.sort(np.concatenate(arrays))
    twice = np.unique(every[1:][every[1:] == every[:-1]])
    out = []
    for a in arrays:
        at = np.searchsorted(twice, a)
        out.append(pack_bits(twice[np.minimum(at, len(twice) - 1)] == a if len(twice) else np.zeros(len(a), bool)))
    return out


def gather(keys: np.ndarray, parts: int, answers: dict[int, bytes], read: Callable, bits: int = 64) -> np.ndarray:
    """What came back for sorted distinct keys, in their order; ``read(answer, n)`` gives the values of one part."""
    got = [read(answers[p], b - a) for p, a, b in ranges_of(keys, parts, bits)]
    return np.concatenate(got) if got else np.zeros(0, bool)


def write_table(df: DataFrame, label: str) -> DataFrame:
    """A table in the shared folder; see ``wardlight.session.materialize``."""
    return materialize(df, label)


def documents(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def unused(columns: Iterable[str], name: str) -> str:
    """``name``, with underscores behind it until no column is called so (names of columns differ by more than case)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name
