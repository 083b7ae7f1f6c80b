"""Repeated passages of words, found by level-wise doubling.

Windows of half the wanted length are compared first; only positions at which both halves are repeated alone are
extended to the full length and compared again, and so on. Blocks exchange hashes of distinct windows only, so a
passage that a third of all documents hold is one key per block.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardlight.llm.blocks import (
    NO_ID, U64, Block, gather, map_blocks, mix, pack_array, pack_bits, pack_blocks, pack_sorted, partitions_of, powers, ranges_of,
    repeated, reply, send, unpack_array, unpack_bits, unpack_sorted, word_hashes, words_of,
)

FILTER_BITS = 40  # of the hashes of a level that only thins out candidates; a collision costs work, no result


def level_lengths(words: int, first: int = 7) -> list[int]:
    """Lengths that double (the halves share a word where the length is odd), up to ``words``."""
    lengths = [words]
    while lengths[0] > first:
        lengths.insert(0, (lengths[0] + 1) // 2)
    return lengths


class _Windows:
    """The windows of a block at one level: hashes by first word, which of them lie in one document, candidates."""

    def __init__(self, block: Block, length: int) -> None:
        self.starts, self.ends, self.doc = words_of(block)
        self.count = np.bincount(self.doc, minlength=len(block.ids))
        self.last = np.cumsum(self.count)[self.doc] if len(self.doc) else self.doc
        self.length = 1
        self.hash = word_hashes(block.data, self.starts, self.ends)
        power, out = powers(length), np.zeros(max(0, len(self.hash) - length + 1), U64)
        for j in range(length):
            out += self.hash[j:j + len(out)] * power[j]
        self.hash, self.length = mix(out), length
        self.candidate = self._inside()

    def _inside(self) -> np.ndarray:
        return np.arange(len(self.hash)) + self.length <= self.last[:len(self.hash)]

    def extend(self, flags: np.ndarray, length: int) -> None:
        """On to ``length``: both halves must be repeated."""
        shift = length - self.length
        n = max(0, len(self.hash) - shift)
        self.hash = mix(self.hash[:n] * U64(0x9E3779B97F4A7C15) + self.hash[shift:shift + n])
        self.length = length
        self.candidate = self._inside() & flags[:n] & flags[shift:shift + n]

    def filter_keys(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at = np.flatnonzero(self.candidate)
        keys, back, count = np.unique(self.hash[at] >> U64(64 - FILTER_BITS), return_inverse=True, return_counts=True)
        return at, keys, (back, count)

    def apply(self, parts: int, answers: dict) -> np.ndarray:
        """Which windows are repeated, after a thinning level."""
        at, keys, (back, count) = self.filter_keys()
        seen = gather(keys, parts, answers, unpack_bits, FILTER_BITS) | (count > 1)
        flags = np.zeros(len(self.hash), bool)
        flags[at] = seen[back] if len(at) else False
        return flags

    def final_keys(self, ids: np.ndarray):
        """Distinct windows with the smallest document of the block that holds each."""
        at = np.flatnonzero(self.candidate)
        doc = ids[self.doc[at]]
        order = np.lexsort((doc, self.hash[at]))
        key, doc = self.hash[at][order], doc[order]
        new = np.ones(len(key), bool)
        new[1:] = key[1:] != key[:-1]
        return at[order], key[new], doc[new], np.cumsum(new) - 1, doc


def _thin(lengths: list[int], parts: int):
    """Messages of the thinning level ``len(answers)``."""
    def run(block: Block, *answers):
        w = _walk(block, lengths, parts, answers)
        _, keys, _ = w.filter_keys()
        return {p: pack_sorted(keys[a:b]) for p, a, b in ranges_of(keys, parts, FILTER_BITS)}
    return run


def _walk(block: Block, lengths: list[int], parts: int, answers) -> _Windows:
    w = _Windows(block, lengths[0])
    for k, given in enumerate(answers):
        w.extend(w.apply(parts, given), lengths[k + 1])
    return w


def _full(lengths: list[int], parts: int):
    def run(block: Block, *answers):
        w = _walk(block, lengths, parts, answers)
        _, keys, docs, _, _ = w.final_keys(block.ids)
        out = {}
        for p, a, b in ranges_of(keys, parts):
            low = int(docs[a:b].min())
            out[p] = pack_sorted(keys[a:b]) + np.int64(low).tobytes() + pack_array((docs[a:b] - low).astype(U64))
        return out
    return run


def _earlier(messages: list) -> list[bytes]:
    """Of each block's windows: does the window start in a document before the block's first with it?"""
    keys, docs, sizes = [], [], []
    for m in messages:
        k, at = unpack_sorted(m)
        low = np.frombuffer(m, np.int64, 1, at)[0]
        d, _ = unpack_array(m, at + 8)
        keys.append(k), docs.append(d.astype(np.int64) + low), sizes.append(len(k))
    key, doc = np.concatenate(keys), np.concatenate(docs)
    order = np.argsort(key, kind="stable")
    new = np.ones(len(key), bool)
    new[1:] = key[order][1:] != key[order][:-1]
    least = np.minimum.reduceat(doc[order], np.flatnonzero(new))[np.cumsum(new) - 1]
    bits = np.zeros(len(key), bool)
    bits[order] = least < doc[order]
    return [pack_bits(x) for x in np.split(bits, np.cumsum(sizes)[:-1])]


def _result(lengths: list[int], parts: int):
    def run(block: Block, *answers):
        w = _walk(block, lengths, parts, answers[:-1])
        at, keys, _, group, doc = w.final_keys(block.ids)
        bits = gather(keys, parts, answers[-1], unpack_bits)
        first = np.minimum.reduceat(doc, np.flatnonzero(np.diff(group, prepend=-1))) if len(group) else doc
        hit = at[bits[group] | (doc > first[group])] if len(group) else at
        edge = np.zeros(len(w.starts) + 1, np.int64)
        np.add.at(edge, hit, 1)
        np.add.at(edge, hit + w.length, -1)
        removed = np.cumsum(edge[:-1]) > 0
        return kept_words(block, w.starts, w.ends, w.doc, removed)
    return run


def kept_words(block: Block, starts, ends, doc, removed) -> dict:
    """One row per document: the words that stay, joined by one space, as a digest and as text."""
    n = len(block.ids)
    keep = ~removed
    size = np.where(keep, ends - starts + 1, 0)  # each word with a space behind it
    total = np.bincount(doc, weights=size, minlength=n).astype(np.int64)
    out = np.full(int(total.sum()), 32, np.uint8)
    length = (ends - starts)[keep]
    if len(length):
        target = np.cumsum(size[keep]) - size[keep]
        inner = np.arange(int(length.sum())) - np.repeat(np.cumsum(length) - length, length)
        out[np.repeat(target, length) + inner] = block.data[np.repeat(starts[keep], length) + inner]
    at = np.concatenate(([0], np.cumsum(total)))
    texts = [out[at[i]:max(at[i], at[i + 1] - 1)].tobytes() for i in range(n)]
    return {
        "doc_id": pa.array(block.ids, mask=block.ids == NO_ID),
        "n_words": pa.array(np.bincount(doc, minlength=n), pa.int64()),
        "n_removed": pa.array(np.bincount(doc[removed], minlength=n), pa.int64()),
        "kept_sha256": [hashlib.sha256(t).hexdigest() for t in texts],
        "kept": pa.array(texts, pa.binary()).cast(pa.string()),
    }


SCHEMA = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string"


def remove_repeated_windows(docs: DataFrame, words: int = 13, first: int = 7) -> DataFrame:
    """Remove every word covered by a window of ``words`` words that also starts in a document with a smaller doc_id.

    ``docs`` needs doc_id and text; other columns are not read. One row per input row: doc_id, n_words, n_removed,
    kept_sha256, kept (the words that stay, joined by one space). A null or blank text has no words and an empty
    result; rows with the same doc_id never remove each other's words; a null doc_id counts as later than all others
    and stays null. An empty table gives an empty table.
    """
    blocks = pack_blocks(docs)
    parts, lengths, answers = partitions_of(blocks), level_lengths(words, first), []
    for _ in lengths[:-1]:
        answers.append(reply(send(blocks, _thin(lengths, parts), parts, answers), repeated, "windows-level"))
    answers.append(reply(send(blocks, _full(lengths, parts), parts, answers), _earlier, "windows-first"))
    return map_blocks(blocks, _result(lengths, parts), SCHEMA, answers)


def longest_repeats(docs: DataFrame, first: int = 8) -> DataFrame:
    """The longest of the lengths first, 2 first, 4 first ... at which each document shares a window with another or itself.

    Windows are doubled until no candidates survive anywhere. Columns doc_id, longest (0: not even ``first``). Lengths
    are judged by 40-bit hashes of halves that are all repeated, so this is a report, no removal.
    """
    blocks = pack_blocks(docs)
    parts, lengths, answers = partitions_of(blocks), [first], []
    while True:
        answers.append(reply(send(blocks, _thin(lengths, parts), parts, answers), repeated, "windows-level"))

        def level(block: Block, *given, steps=tuple(lengths)):
            w = _walk(block, steps, parts, given[:-1])
            flags = w.apply(parts, given[-1])
            seen = np.bincount(w.doc[:len(flags)][flags], minlength=len(block.ids)) > 0
            return {"doc_id": pa.array(block.ids, mask=block.ids == NO_ID), "longest": pa.array(np.where(seen, steps[-1], 0), pa.int64())}

        found = map_blocks(blocks, level, "doc_id long, longest long", answers)
        if len(lengths) == 1:
            result = found
        else:
            result = result.join(found.groupBy("doc_id").agg(F.max("longest").alias("l")), "doc_id", "left").select("doc_id", F.greatest("longest", F.coalesce("l", F.lit(0))).alias("longest"))
        if not found.where("longest > 0").take(1):
            return result
        lengths.append(2 * lengths[-1])
