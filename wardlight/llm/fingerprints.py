"""I-Match fingerprints with randomised lexicons, and their likeness.

Terms are words between white space. The lexicon keeps terms whose inverse document frequency, as a share of the largest possible one, lies in a
band. A fingerprint has one hash per random subset of the lexicon: of the sorted distinct terms of the document that
are in the subset. Subsets come at rates 1, 1/2, 1/4 ...; a document uses the three rates at which a subset keeps about
one of its terms, so that short and long documents are told apart equally well.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wardlight.llm.blocks import (
    NO_ID, U64, Block, gather, map_blocks, mix, pack_array, pack_bits, pack_blocks, pack_sorted, partitions_of, ranges_of, reply, send,
    unpack_array, unpack_bits, unpack_sorted, word_hashes, words_of, write_table,
)

SUBSETS = 32
KEPT = 0.7  # terms of a document that a subset keeps, about
TERM_BITS = 40


def neighbours(blocks: DataFrame) -> DataFrame:
    """(block, idx, next_block, next_idx): the next document by (doc_id, place), of the last one the first.

    Sorted in ranges by small rows without texts; only the first row of each range crosses to the one before.
    """
    def places(block: Block):
        n = len(block.ids)
        return {"doc_id": pa.array(block.ids), "block": pa.array([block.number] * n, pa.int64()), "idx": pa.array(np.arange(n), pa.int64())}

    rows = map_blocks(blocks, places, "doc_id long, block long, idx long").repartitionByRange("doc_id", "block", "idx").withColumn("range", F.spark_partition_id())
    rows = write_table(rows, "order")  # ranges are drawn from a sample: written once, read twice
    me = F.struct("block", "idx")
    firsts = rows.groupBy("range").agg(F.min(F.struct("doc_id", "block", "idx")).alias("f"))  # one row per range
    after = firsts.select("range", F.lead("f").over(Window.orderBy("range")).alias("after"), F.first("f").over(Window.orderBy("range")).alias("very_first"))
    ordered = rows.withColumn("n", F.lead(me).over(Window.partitionBy("range").orderBy("doc_id", "block", "idx")))
    joined = ordered.join(after, "range").select("block", "idx", "n", F.coalesce("after", "very_first").alias("f"))
    return joined.select("block", "idx", F.coalesce("n.block", "f.block").alias("next_block"), F.coalesce("n.idx", "f.idx").alias("next_idx"))


def _texts(block: Block) -> list[bytes]:
    raw = block.data.tobytes()
    at = block.offsets.tolist()
    return [raw[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]


def _give(block: Block, wanted: dict[int, bytes]):
    """Texts that other blocks ask for: each key of ``wanted`` is a place here, with the places elsewhere that want it."""
    texts, block_to, part, out = _texts(block), [], [], []
    for i, asked in wanted.items():
        for item in asked.decode().split(","):
            b, j = item.split(":")
            block_to.append(int(b)), part.append(int(j)), out.append(texts[i])
    return {"part": pa.array(part, pa.int32()), "block": pa.array(block_to, pa.int64()), "answer": pa.array(out, pa.binary())}


def _with_guests(block: Block, guests: dict[int, bytes]) -> tuple[Block, dict[int, int]]:
    """The block with texts of other blocks behind its own, and where each place's guest is."""
    order = sorted(guests)
    sizes = [len(guests[i]) for i in order]
    data = np.concatenate((block.data, np.frombuffer(b"".join(guests[i] for i in order), np.uint8)))
    offsets = np.concatenate((block.offsets, block.offsets[-1] + np.cumsum(sizes, dtype=np.int64)))
    ids = np.concatenate((block.ids, np.full(len(order), NO_ID)))
    return Block(block.number, ids, offsets, data), {i: len(block.ids) + k for k, i in enumerate(order)}


def _terms(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """Term and document of each word."""
    starts, ends, doc = words_of(block)
    return word_hashes(block.data, starts, ends), doc


def _edit(block: Block, guests: dict, nexts: dict) -> tuple[Block, Block, np.ndarray, list[int]]:
    """The block with its guests, the edited texts as a block, where each document's next one is, and sizes in characters."""
    whole, guest_at = _with_guests(block, guests)
    n = len(block.ids)
    follower = np.array([guest_at[i] if i in guest_at else int(nexts[i]) for i in range(n)], np.int64)
    texts = [t.decode() for t in _texts(whole)]
    edited, chars = [], []
    for i in range(n):
        size = len(texts[i])
        cut = size // 4
        chars.append(size)
        edited.append((texts[i][:size - cut] + texts[follower[i]][:cut]).encode())
    offsets = np.concatenate(([0], np.cumsum([len(t) for t in edited], dtype=np.int64)))
    return whole, Block(block.number, block.ids, offsets, np.frombuffer(b"".join(edited), np.uint8)), follower, chars


def _lexicon_keys(own: int, whole: Block, edited: Block) -> tuple[np.ndarray, np.ndarray]:
    """Keys of all terms that are fingerprinted, and how many of the block's ``own`` documents have each.

    Guests and edited texts ask without being counted: an edit makes words that no text of the block need have.
    """
    term, doc = _terms(whole)
    key = term >> U64(64 - TERM_BITS)
    order = np.lexsort((doc, key))
    key, doc = key[order], doc[order]
    pair = np.ones(len(key), bool)
    pair[1:] = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])
    key, doc = key[pair], doc[pair]
    found, start = np.unique(key, return_index=True)
    keys = np.union1d(found, _terms(edited)[0] >> U64(64 - TERM_BITS))
    counts = np.zeros(len(keys), np.int64)
    if len(start):
        counts[np.searchsorted(keys, found)] = np.add.reduceat((doc < own).astype(np.int64), start)
    return keys, counts


def _document_frequencies(documents: int, band: tuple[float, float]):
    """Answers: is the term's share log(N / df) / log(N) of the largest inverse document frequency in the band?"""
    def run(messages: list) -> list[bytes]:
        read = []
        for m in messages:
            k, at = unpack_sorted(m)
            read.append((k, unpack_array(m, at)[0].astype(np.int64)))
        keys = np.unique(np.concatenate([k for k, _ in read]))
        df = np.zeros(len(keys), np.int64)
        for k, c in read:
            df[np.searchsorted(keys, k)] += c
        idf = np.log(documents / np.maximum(df, 1)) / np.log(max(documents, 2))
        inside = (df > 0) & (idf >= band[0]) & (idf <= band[1])
        return [pack_bits(inside[np.searchsorted(keys, k)]) for k, _ in read]
    return run


def fingerprints(block: Block, keys: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lowest rate (as a power), (documents, 3, SUBSETS) hashes of 16 bits and how many terms each document has.

    A subset without a term of the document gives 0. A document without terms in the band uses all its terms.
    """
    n = len(block.ids)
    term, doc = _terms(block)
    at = np.minimum(np.searchsorted(keys, term >> U64(64 - TERM_BITS)), max(len(keys) - 1, 0))
    good = inside[at] & (keys[at] == term >> U64(64 - TERM_BITS)) if len(keys) else np.zeros(len(term), bool)
    good |= np.bincount(doc[good], minlength=n)[doc] == 0
    term, doc = term[good], doc[good]
    order = np.lexsort((term, doc))
    term, doc = term[order], doc[order]
    new = np.ones(len(term), bool)
    new[1:] = (term[1:] != term[:-1]) | (doc[1:] != doc[:-1])
    term, doc = term[new], doc[new]
    size = np.bincount(doc, minlength=n)
    low = np.maximum(0, np.rint(np.log2(np.maximum(size, 1) / KEPT)).astype(np.int64) - 1)
    out = np.zeros((n, 3, SUBSETS), np.uint16)
    seeds = mix(np.arange(1001, 1001 + SUBSETS, dtype=U64))
    shift = low.astype(U64)
    for s in range(SUBSETS):
        draw = mix(term ^ seeds[s])
        for r in range(3):
            keep = (draw >> (U64(63) - (shift[doc] + U64(r)))) < U64(2)  # a rate of 2 ** -(low + r)
            d, drawn = doc[keep], draw[keep]
            if not len(d):
                break
            start = np.flatnonzero(np.diff(d, prepend=-1))
            h = mix(np.add.reduceat(mix(drawn * U64(0x9E3779B97F4A7C15)), start))
            out[d[start], r, s] = (h >> U64(48)).astype(np.uint16) | 1
    return low, out, size


def likeness(low_a, hash_a, size_a, low_b, hash_b, size_b) -> np.ndarray:
    """Share of the subsets with a term of either document whose hashes agree, at a rate that both documents use."""
    level = np.where(np.abs(low_a - low_b) <= 1, np.maximum(low_a, low_b) + 1, np.maximum(low_a, low_b))
    ra, rb = level - low_a, level - low_b
    far = (ra > 2) | (rb > 2)
    i = np.arange(len(level))
    x, y = hash_a[i, np.clip(ra, 0, 2)], hash_b[i, np.clip(rb, 0, 2)]
    either = ((x > 0) | (y > 0)).sum(axis=1)
    share = ((x == y) & (x > 0)).sum(axis=1) / np.maximum(either, 1)
    same = (hash_a == hash_b).all(axis=(1, 2)) & (low_a == low_b) & (size_a == size_b)
    return np.where(same, 1.0, np.where(far | (size_a == 0) | (size_b == 0), 0.0, share))


def _hex(low: np.ndarray, hashes: np.ndarray, size: np.ndarray) -> list[str]:
    """A document without terms: an empty string."""
    swapped = hashes.astype(">u2").reshape(len(low), -1)
    return [f"{a:02x}{row.tobytes().hex()}" if s else "" for a, row, s in zip(low.tolist(), swapped, size.tolist(), strict=True)]


def _rows(block: Block, guests: dict, nexts: dict, answers: dict, parts: int):
    n = len(block.ids)
    whole, edited, follower, chars = _edit(block, guests, nexts)
    keys, _ = _lexicon_keys(n, whole, edited)
    inside = gather(keys, parts, answers, unpack_bits, TERM_BITS)
    own, other = fingerprints(whole, keys, inside), fingerprints(edited, keys, inside)
    mine, behind = [x[:n] for x in own], [x[follower] for x in own]
    return {
        "doc_id": pa.array(block.ids, mask=block.ids == NO_ID), "n_chars": pa.array(chars, pa.int64()),
        "edited_sha256": [hashlib.sha256(t).hexdigest() for t in _texts(edited)],
        "fingerprint": _hex(*mine), "edited_fingerprint": _hex(*other),
        "near_edited": likeness(*mine, *other), "near_next": likeness(*mine, *behind),
    }


def fingerprint_documents(docs: DataFrame, band: tuple[float, float] = (0.25, 0.95)) -> DataFrame:
    """doc_id, n_chars, fingerprint, and the same of the text whose last quarter is replaced by the head of the next document.

    Columns: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next (0 to 1). ``band``: least
    and largest inverse document frequency of a term, as shares of log(number of documents); a document without such terms uses all its terms.
    Null texts count as empty; a document without words has the empty fingerprint and likeness 1 only to another of
    them. Documents with one doc_id follow each other in a fixed, arbitrary order, null ids come last and stay null.
    An empty table gives an empty result; a single document is its own next one.
    """
    blocks = pack_blocks(docs)
    parts = partitions_of(blocks)
    order = write_table(neighbours(blocks), "next")
    local = order.select("block", F.col("idx").cast("int").alias("part"), F.when(F.col("block") == F.col("next_block"), F.col("next_idx")).otherwise(-1).cast("string").cast("binary").alias("answer"))
    asked = order.where("block <> next_block").groupBy(F.col("next_block").alias("block"), F.col("next_idx").cast("int").alias("part"))
    asked = asked.agg(F.array_join(F.collect_list(F.concat_ws(":", "block", "idx")), ",").cast("binary").alias("answer"))
    guests = write_table(map_blocks(blocks, _give, "part int, block long, answer binary", [asked]), "guests")
    documents = order.count()

    def terms(block: Block, given: dict, nexts: dict):
        whole, edited, _, _ = _edit(block, given, nexts)
        keys, counts = _lexicon_keys(len(block.ids), whole, edited)
        return {p: pack_sorted(keys[a:b]) + pack_array(counts[a:b].astype(U64)) for p, a, b in ranges_of(keys, parts, TERM_BITS)}

    lexicon = reply(send(blocks, terms, parts, [guests, local]), _document_frequencies(documents, band), "lexicon")
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return map_blocks(blocks, lambda block, given, nexts, answers: _rows(block, given, nexts, answers, parts), schema, [guests, local, lexicon])
