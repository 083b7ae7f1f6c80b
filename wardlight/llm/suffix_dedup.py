"""Repeated byte strings, found by a distributed merge of sorted suffixes.

Only suffixes at anchors take part: positions whose 16-byte string is the smallest, by hash, of all those of some
wanted window. Equal windows have the same anchor at the same place, so no repeat is lost, and about one position in
eighteen is left. Each block sorts the suffixes of its repeated anchors (the bytes to the right, then those to the left
backwards) and sends them front coded, one run per range of anchors. A loser tree that carries common prefix lengths
merges the runs; it compares two suffixes only from the prefix on that both are known to share with the last output.
Neighbours with the common prefixes tell for each window the first document that holds it.

A block sends a run to nearly every range, so runs number blocks times ranges: blocks are larger than what is hashed at
a time, and a range holds the anchors of a few blocks. An anchor's hash is the least of many and so near zero; ranges
are cut from it mixed once more, and hold about equally many anchors.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from wardlight.llm.blocks import (
    BLOCK_BYTES, BYTE_KEYS, NO_ID, U64, Block, gather, map_blocks, mix, pack_array, pack_blocks, pack_sorted, part_of, partitions_of, ranges_of,
    repeated, reply, send, squeeze, unpack_array, unpack_bits, unsqueeze,
)

GRAM = 16  # bytes of an anchor
END = 0xFF  # no byte of UTF-8 text: stands for what lies outside a document
FILTER_BITS = 40
BLOCKS_PER_PART = 4  # merged at a time: the suffixes of about so many blocks
SLICE_BYTES = BLOCK_BYTES // 2  # hashed at a time: several arrays of eight bytes per byte of text


def _spread(values: np.ndarray, width: int, best) -> np.ndarray:
    """``best`` (np.minimum or np.maximum) of each run of ``width`` values."""
    size, out = 1, values
    while 2 * size <= width:
        out = best(out[:-size], out[size:])
        size *= 2
    rest = width - size
    return best(out[:-rest], out[rest:]) if rest else out


def anchors(block: Block, window: int, size: int = SLICE_BYTES) -> tuple[np.ndarray, np.ndarray]:
    """Positions and evenly spread 64-bit hashes of the anchors of a block, found in slices of whole documents of about ``size`` bytes."""
    found, i = [(np.zeros(0, np.int64), np.zeros(0, U64))], 0
    while i < len(block.ids):
        a = block.offsets[i]
        j = max(i + 1, int(np.searchsorted(block.offsets, a + size, side="right")) - 1)
        at, h = _anchors(Block(block.number, block.ids[i:j], block.offsets[i:j + 1] - a, block.data[a:block.offsets[j]]), window)
        found.append((at + a, mix(h)))
        i = j
    return np.concatenate([at for at, _ in found]), np.concatenate([h for _, h in found])


def _anchors(block: Block, window: int) -> tuple[np.ndarray, np.ndarray]:
    n = len(block.data)
    if n < window:
        return np.zeros(0, np.int64), np.zeros(0, U64)
    h, size = BYTE_KEYS[block.data], 1
    while size < GRAM:
        h = h[:-size] * U64(0x9E3779B97F4A7C15) + (h[size:] ^ (h[size:] >> U64(29)))
        size *= 2
    h = mix(h)
    rank = (h >> U64(32)).astype(np.uint32) | np.uint32(1)
    span = window - GRAM + 1
    least = _spread(rank, span, np.minimum)
    ends = block.offsets[1:]
    edge = np.zeros(n + 1, np.int32)
    np.add.at(edge, np.maximum(block.offsets[:-1], ends - window + 1), 1)
    np.add.at(edge, ends, -1)
    least[np.cumsum(edge, dtype=np.int32)[:len(least)] != 0] = 0  # windows that leave their document
    none = np.zeros(span - 1, np.uint32)
    most = _spread(np.concatenate((none, least, none)), span, np.maximum)
    at = np.flatnonzero(most[:len(rank)] == rank)
    return at, h[at]


class _Suffixes:
    """The suffixes of a block at its repeated anchors, sorted; one record per distinct context."""

    def __init__(self, block: Block, window: int, parts: int, answers: dict) -> None:
        self.window, self.left = window, window - GRAM
        at, h = anchors(block, window)
        keys, back, count = np.unique(h >> U64(64 - FILTER_BITS), return_inverse=True, return_counts=True)
        seen = gather(keys, parts, answers, unpack_bits, FILTER_BITS) | (count > 1)
        pick = seen[back] if len(at) else np.zeros(0, bool)
        at, h = at[pick], h[pick]
        doc = np.searchsorted(block.offsets, at, side="right") - 1
        rows = self._rows(block, at, doc)
        ids, part = block.ids[doc], part_of(h, parts)
        text = rows.view(f"S{rows.shape[1]}").ravel()
        order = np.argsort(ids, kind="stable")
        order = order[np.argsort(text[order], kind="stable")]
        order = order[np.argsort(part[order], kind="stable")]
        self.at, self.ids, self.rows = at[order], ids[order], rows[order]
        new = np.ones(len(order), bool)
        new[1:] = (self.rows[1:] != self.rows[:-1]).any(axis=1)
        self.new, self.group = np.flatnonzero(new), np.cumsum(new) - 1
        self.part = part[order][self.new]

    def _rows(self, block: Block, at: np.ndarray, doc: np.ndarray) -> np.ndarray:
        padded = np.concatenate((np.full(self.left, END, np.uint8), block.data, np.full(self.window, END, np.uint8)))
        rows = np.empty((len(at), self.window + self.left), np.uint8)
        start, end = block.offsets[doc], block.offsets[doc + 1]
        for j in range(self.window):
            rows[:, j] = np.where(at + j < end, padded[at + self.left + j], END)
        for j in range(self.left):
            rows[:, self.window + j] = np.where(at - 1 - j >= start, padded[at + self.left - 1 - j], END)
        return rows

    def runs(self) -> dict[int, bytes]:
        """The front-coded run of each part: common prefix lengths, the bytes behind them, first documents; squeezed."""
        rows, ids = self.rows[self.new], self.ids[self.new]
        cut = np.flatnonzero(np.diff(self.part)) + 1
        out = {}
        for a, b in zip(np.concatenate(([0], cut)), np.concatenate((cut, [len(rows)])), strict=True):
            if a == b:
                continue
            part, low = rows[a:b], int(ids[a:b].min())
            lcp = np.zeros(b - a, np.uint8)
            lcp[1:] = (part[1:] != part[:-1]).argmax(axis=1)
            rest = part[np.arange(part.shape[1]) >= lcp[:, None]]
            out[int(self.part[a])] = squeeze(b"".join((np.array([b - a, len(rest), low], np.int64).tobytes(), lcp.tobytes(), rest.tobytes(), pack_array((ids[a:b] - low).astype(U64)))))
        return out


def _read_run(message, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Common prefix lengths, whole suffixes and first documents of a run."""
    message = unsqueeze(message)
    n, size, low = (int(x) for x in np.frombuffer(message, np.int64, 3))
    lcp = np.frombuffer(message, np.uint8, n, 24)
    own = np.arange(width) >= lcp[:, None]
    rows = np.zeros((n, width), np.uint8)
    rows[own] = np.frombuffer(message, np.uint8, size, 24 + n)
    source = np.maximum.accumulate(np.where(own, np.arange(n)[:, None], 0), axis=0)
    docs, _ = unpack_array(message, 24 + n + size)
    return lcp, np.take_along_axis(rows, source, axis=0), docs.astype(np.int64) + low


def merge_runs(runs: list[list[bytes]], prefixes: list[list[int]], width: int) -> tuple[list[int], list[int]]:
    """Merge sorted runs by a loser tree: for each output its run and its common prefix with the output before.

    Each loser is kept with the length of the prefix it shares with the winner of its match. Where the lengths differ,
    the longer one is the smaller string and nothing is compared; where they agree, bytes are compared behind them.
    """
    k = len(runs)
    heads = [r[0] for r in runs]
    place, size = [0] * k, [len(r) for r in runs]

    def match(x: bytes, y: bytes, h: int) -> int:
        """Common prefix of x and y, which share h bytes at least."""
        return width - ((int.from_bytes(x[h:], "big") ^ int.from_bytes(y[h:], "big")).bit_length() + 7) // 8

    loser, known = [0] * k, [0] * k
    winner = [0] * k + list(range(k))
    for node in range(k - 1, 0, -1):
        a, b = winner[2 * node], winner[2 * node + 1]
        h = match(heads[a], heads[b], 0)
        if h < width and heads[b][h] < heads[a][h]:
            a, b = b, a
        winner[node], loser[node], known[node] = a, b, h
    best, h = winner[1] if k > 1 else 0, 0
    out_run, out_lcp = [], []
    while h >= 0:
        out_run.append(best)
        out_lcp.append(h)
        i = place[best] + 1
        if i < size[best]:
            place[best], heads[best], h = i, runs[best][i], prefixes[best][i]
        else:
            h = -1  # an empty run loses every match
        node = (best + k) >> 1
        while node:
            other = known[node]
            if other > h:
                loser[node], best = best, loser[node]
                known[node], h = h, other
            elif other == h and h >= 0:
                x, y = heads[best], heads[loser[node]]
                common = match(x, y, h)
                if common < width and y[common] < x[common]:
                    loser[node], best = best, loser[node]
                known[node] = common
            node >>= 1
    return out_run, out_lcp


def _first_documents(window: int):
    """For each suffix of each run: the windows around its anchor that also start in an earlier document."""
    left = window - GRAM
    width = window + left

    def run(messages: list) -> list[bytes]:
        read = [_read_run(m, width) for m in messages]
        texts = []
        for _, rows, _ in read:
            raw = rows.tobytes()
            texts.append([raw[i:i + width] for i in range(0, len(raw), width)])
        out_run, out_lcp = merge_runs(texts, [lcp.tolist() for lcp, _, _ in read], width)
        del texts
        place = np.argsort(np.array(out_run), kind="stable")
        lcp = np.array(out_lcp)
        rows, docs = np.empty((len(lcp), width), np.uint8), np.empty(len(lcp), np.int64)
        rows[place] = np.concatenate([r for _, r, _ in read])
        docs[place] = np.concatenate([d for _, _, d in read])
        new = lcp < width
        group = np.cumsum(new) - 1
        first = np.minimum.reduceat(docs, np.flatnonzero(new))
        rows, lcp = rows[new], lcp[new]
        gram = np.cumsum(lcp < GRAM) - 1
        many = np.flatnonzero(np.bincount(gram)[gram] > 1)  # contexts that share their anchor with others
        behind = np.zeros(len(many), U64)
        masks = np.zeros(len(docs), U64)
        for o in range(left + 1):
            if o:
                behind = mix(behind * U64(0x9E3779B97F4A7C15) + BYTE_KEYS[rows[many, window + o - 1]])
            least = first.copy()
            if len(many):
                # the same bytes to the right (one stretch of the sorted order) and to the left
                key = mix(np.cumsum(lcp[many] < window - o).astype(U64) * U64(0xD1342543DE82EF95) + behind)
                order = np.argsort(key)
                start = np.flatnonzero(np.concatenate(([True], key[order][1:] != key[order][:-1])))
                value = np.minimum.reduceat(first[many][order], start)
                least[many[order]] = np.repeat(value, np.diff(np.concatenate((start, [len(order)]))))
            masks |= ((least[group] < docs) & _inside(rows, window, o)[group]).astype(U64) << U64(o)
        return [pack_array(m) for m in np.split(masks[place], np.cumsum([len(d) for _, _, d in read])[:-1])]

    return run


def _inside(rows: np.ndarray, window: int, o: int) -> np.ndarray:
    """Does the window that begins ``o`` bytes before the anchor lie in the document?"""
    inside = rows[:, window - o - 1] != END
    return inside & (rows[:, window + o - 1] != END) if o else inside


def _result(window: int, parts: int):
    def run(block: Block, answers, masks):
        s = _Suffixes(block, window, parts, answers)
        cut = np.flatnonzero(np.diff(s.part)) + 1
        known = [unpack_array(masks[int(p[0])])[0] for p in np.split(s.part, cut) if len(p)]
        known = np.concatenate(known) if known else np.zeros(0, U64)
        later = s.ids > s.ids[s.new][s.group] if len(s.ids) else np.zeros(0, bool)
        n = len(block.data)
        flag = np.zeros(n + window, bool)
        for o in range(s.left + 1):
            hit = np.where(later, _inside(s.rows, window, o), (known[s.group] >> U64(o)) & U64(1) == 1)
            flag[s.at[hit] - o] = True
        sums = np.concatenate((np.zeros(window, np.int32), np.cumsum(flag[:n], dtype=np.int32)))
        removed = sums[window:] > sums[:-window]
        return kept_bytes(block, removed)
    return run


def kept_bytes(block: Block, removed: np.ndarray) -> dict:
    start = removed.copy()
    start[1:] &= ~removed[:-1]
    firsts = block.offsets[:-1][np.diff(block.offsets) > 0]
    start[firsts] = removed[firsts]
    total = lambda flags: np.diff(np.concatenate((np.zeros(1, np.int32), np.cumsum(flags, dtype=np.int32)))[block.offsets])
    kept = block.data[~removed]
    at = np.concatenate(([0], np.cumsum(total(~removed), dtype=np.int64)))
    texts = [kept[a:b].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)]
    return {
        "doc_id": pa.array(block.ids, mask=block.ids == NO_ID),
        "n_bytes": pa.array(np.diff(block.offsets), pa.int64()),
        "n_removed": pa.array(total(removed), pa.int64()),
        "n_spans": pa.array(total(start), pa.int64()),
        "kept_sha256": [hashlib.sha256(t).hexdigest() for t in texts],
        "kept": pa.array(texts, pa.binary()),
    }


def remove_repeated_bytes(docs: DataFrame, window: int = 50) -> DataFrame:
    """Remove every byte covered by a string of ``window`` bytes that also starts in a document with a smaller doc_id.

    ``window`` lies between 20 and 79. ``docs`` needs doc_id and text; other columns are not read. One row per input row: doc_id, n_bytes, n_removed,
    n_spans, kept_sha256, kept (the bytes that stay; a cut may lie inside a character). A null text is an empty one.
    Rows with the same doc_id never remove each other's bytes; a null doc_id counts as later than all others and stays
    null. An empty table gives an empty table.
    """
    if not GRAM + 4 <= window < GRAM + 64:
        raise ValueError("window must lie between 20 and 79 bytes")
    blocks = pack_blocks(docs, 2 * BLOCK_BYTES, "zstd")
    parts = max(partitions_of(blocks), blocks.count() // BLOCKS_PER_PART)

    def keys(block: Block):
        found = np.unique(anchors(block, window)[1] >> U64(64 - FILTER_BITS))
        return {p: pack_sorted(found[a:b]) for p, a, b in ranges_of(found, parts, FILTER_BITS)}

    seen = reply(send(blocks, keys, parts), repeated, "anchors")
    runs = send(blocks, lambda block, answers: _Suffixes(block, window, parts, answers).runs(), parts, [seen])
    masks = reply(runs, _first_documents(window), "suffixes")
    return map_blocks(blocks, _result(window, parts), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary", [seen, masks])
