"""Token ids of whole texts by the tokenizers library, a block of documents at a time.

The pre-tokenizer of a byte-level vocabulary never joins some neighbours: a letter and punctuation, or either and the
white space behind it. Texts are cut there; each distinct piece of a block is encoded once, and a worker remembers
pieces it has met. The ids are those of the whole text (tests compare them). An added token of the vocabulary (``<|endoftext|>``)
that a text holds is a piece of its own, as the library splits texts there first.
"""

from __future__ import annotations

import json
import os
import re

import numpy as np

from wardlight.llm.blocks import Block, word_hashes

REMEMBERED = 400_000  # pieces of each of two generations; about 150 MB
JOINED = 256  # new pieces that are encoded as one text

LETTER, PUNCTUATION, SPACE, OTHER = 1, 2, 3, 0
KINDS = np.zeros(256, np.uint8)
KINDS[[c for c in range(128) if chr(c).isalpha()]] = LETTER
KINDS[[c for c in range(33, 127) if not chr(c).isalnum() and chr(c) != "'"]] = PUNCTUATION
KINDS[[9, 10, 11, 12, 13, 32]] = SPACE

_SPACES, _CLOSERS = frozenset(np.flatnonzero(KINDS == SPACE).tolist()), frozenset(np.flatnonzero((KINDS == LETTER) | (KINDS == PUNCTUATION)).tolist())


def byte_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def added_tokens(tokenizer) -> re.Pattern | None:
    """Finds the added tokens of a vocabulary in UTF-8 texts, the longest of those that start at one place."""
    listed = json.loads(tokenizer.to_str())["added_tokens"]
    if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in listed) or len({t["normalized"] for t in listed}) > 1:
        raise ValueError("added tokens that take white space, match whole words only or are found in two rounds cannot be cut out of a text")
    names = sorted((t["content"].encode() for t in listed if t["content"]), key=len, reverse=True)
    return re.compile(b"|".join(map(re.escape, names))) if names else None


def pieces(block: Block, added: re.Pattern | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the pieces of a block's texts; every byte lies in one piece, each match of ``added`` is one."""
    data = block.data
    kind = KINDS[data]
    # two-byte letters of Latin-1 (without the signs for times and divided by)
    lead = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] != 0x97) & (data[1:] != 0xB7)) if len(data) else np.zeros(0, np.int64)
    kind[lead] = LETTER
    kind[lead + 1] = LETTER
    cut = np.zeros(len(data) + 1, bool)
    before, after = kind[:-1], kind[1:]
    cut[1:-1] = ((before == LETTER) & ((after == PUNCTUATION) | (after == SPACE))) | ((before == PUNCTUATION) & ((after == LETTER) | (after == SPACE)))
    if added:
        raw, edge = data.tobytes(), block.offsets.tolist()
        for a, b in zip(edge[:-1], edge[1:], strict=True):
            for m in added.finditer(raw, a, b):
                cut[m.start():m.end()] = False
                cut[[m.start(), m.end()]] = True
    cut[block.offsets] = True
    at = np.flatnonzero(cut)
    return at[:-1], at[1:]


class Encoder:
    """Encodes blocks. Names of special tokens inside a text are ordinary text, or with ``names`` those tokens (the library's default)."""

    def __init__(self, path: str, names: bool = False) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = not names
        self.added = added_tokens(self.tokenizer) if names else None
        # bytes of each id (a byte-level vocabulary writes a character for each byte); none if an added token could lie across joined pieces
        listed = {t["content"] for t in json.loads(self.tokenizer.to_str())["added_tokens"]}
        every = self.tokenizer.get_vocab()
        self.sizes = np.zeros(max(every.values(), default=0) + 1, np.int64)
        for token, i in every.items():
            self.sizes[i] = 0 if token in listed else len(token)
        self.joins = not any(c.isspace() for token in listed for c in token)
        self.young: dict[bytes, np.ndarray] = {}
        self.old: dict[bytes, np.ndarray] = {}

    def _encode(self, texts: list[bytes]) -> list[bytes]:
        """The ids of each new piece.

        Between a letter or punctuation and the white space behind it the pre-tokenizer always cuts, so pieces that begin with the one and end in the
        other are encoded many as one text, and its ids are dealt back by the bytes they stand for. Where these do not meet the pieces' ends, and for all other pieces, each is a text.
        """
        out: list[bytes | None] = [None] * len(texts)
        fit = [i for i, t in enumerate(texts) if t[0] in _SPACES and t[-1] in _CLOSERS] if self.joins else []
        groups = [fit[k:k + JOINED] for k in range(0, len(fit), JOINED)]
        found = self.tokenizer.encode_batch_fast([b"".join([texts[i] for i in g]).decode() for g in groups], add_special_tokens=False)
        for group, e in zip(groups, found, strict=True):
            ids = np.array(e.ids, "<u4")
            ends, want = np.cumsum(self.sizes[ids]), np.cumsum([len(texts[i]) for i in group])
            last = np.searchsorted(ends, want)
            if len(ends) and ends[-1] == want[-1] and (ends[last] == want).all():
                raw, cut = ids.tobytes(), (4 * (last + 1)).tolist()
                for i, a, b in zip(group, [0, *cut], cut, strict=False):
                    out[i] = raw[a:b]
        single = [i for i, ids in enumerate(out) if ids is None]
        for i, e in zip(single, self.tokenizer.encode_batch_fast([texts[i].decode() for i in single], add_special_tokens=False), strict=True):
            out[i] = np.array(e.ids, "<u4").tobytes()
        return out

    def _remember(self, texts: list[bytes]) -> list[bytes]:
        """The ids of each piece, as 32-bit little-endian bytes."""
        young, old = self.young, self.old
        got = [young.get(t) for t in texts]
        missing = []
        for i, g in enumerate(got):
            if g is None:
                g = old.get(texts[i])
                if g is None:
                    missing.append(i)
                else:
                    got[i] = young[texts[i]] = g
        if missing:
            for i, ids in zip(missing, self._encode([texts[i] for i in missing]), strict=True):
                got[i] = young[texts[i]] = ids
        if len(young) > REMEMBERED:
            self.young, self.old = {}, young
        return got

    def encode(self, block: Block) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a block, and how many each document has."""
        n = len(block.ids)
        if not len(block.data):
            return np.zeros(0, np.uint32), np.zeros(n, np.int64)
        starts, ends = pieces(block, self.added)
        _, first, place = np.unique(word_hashes(block.data, starts, ends), return_index=True, return_inverse=True)
        raw = block.data.tobytes()
        known = self._remember([raw[a:b] for a, b in zip(starts[first].tolist(), ends[first].tolist(), strict=True)])
        flat = np.frombuffer(b"".join(known), "<u4")
        sizes = np.fromiter(map(len, known), np.int64, len(known)) // 4
        begin = np.cumsum(sizes) - sizes
        count = sizes[place]
        total = np.cumsum(count)
        ids = flat[np.arange(int(total[-1])) + np.repeat(begin[place] - (total - count), count)]
        upto = np.concatenate(([0], total))[np.searchsorted(starts, block.offsets)]
        return ids, np.diff(upto)


def encoder(path: str, names: bool = False) -> Encoder:
    """One per worker process, vocabulary file and reading of ``names``. It is kept at the library's module: functions of this one reach workers by value."""
    import tokenizers

    kept = vars(tokenizers).setdefault("_kept_encoders", {})
    if (path, names) not in kept:
        kept[path, names] = Encoder(path, names)
    return kept[path, names]


def with_end(ids: np.ndarray, counts: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids of documents in one array, each with ``end`` behind it, and the new counts."""
    out = np.full(len(ids) + len(counts), end, np.uint32)
    out[np.arange(len(ids)) + np.repeat(np.arange(len(counts)), counts)] = ids
    return out, counts + 1
