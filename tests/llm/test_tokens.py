"""Token ids, the compact file, packing: against the tokenizers library and plain packing."""

import zlib
from collections import Counter

import numpy as np
import pytest
from cases import empty, frame, order, texts
from hypothesis import given, settings
from hypothesis import strategies as st

from wardlight.llm.blocks import Block
from wardlight.llm.packing import best_fit_decreasing, pack_documents
from wardlight.llm.token_file import LIMIT, canonical_codes, code_lengths, decode_documents, decode_tables, encode_documents, read_token_file, write_token_file
from wardlight.llm.tokens import byte_vocabulary, encoder
from wardlight.session import scratch_path


def whole(text):
    from tokenizers import Tokenizer

    if not hasattr(whole, "t"):
        whole.t = Tokenizer.from_file(byte_vocabulary())
        whole.t.encode_special_tokens = True
    return whole.t.encode(text or "", add_special_tokens=False).ids


def block(parts):
    raw = [p.encode() for p in parts]
    return Block(0, np.arange(len(raw)), np.concatenate(([0], np.cumsum([len(r) for r in raw], dtype=np.int64))), np.frombuffer(b"".join(raw), np.uint8))


ALPHABET = st.sampled_from(list("abZ é×÷Àß'\"’.,!|_-  \n\t\r\x0b\x1c  İ漢😀1²½٣") + ["'s", "'ll", " the", "\n\n", "<|endoftext|>"])


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(ALPHABET, max_size=30).map("".join), min_size=1, max_size=4))
def test_ids_are_those_of_the_whole_text(parts):
    ids, counts = encoder(byte_vocabulary()).encode(block(parts))
    got = [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])]
    assert got == [whole(p) for p in parts]


def untouched(text):
    from tokenizers import Tokenizer

    if not hasattr(untouched, "t"):
        untouched.t = Tokenizer.from_file(byte_vocabulary())
    return untouched.t.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(ALPHABET | st.sampled_from(["<|endoftext|>", "<|endof", "text|>", "<", " "]), max_size=30).map("".join), min_size=1, max_size=4))
def test_ids_with_names_are_those_of_an_untouched_tokenizer(parts):
    ids, counts = encoder(byte_vocabulary(), names=True).encode(block(parts))
    assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == [untouched(p) for p in parts]


NAMED = [(1, "a <|endoftext|> b"), (2, "<|endoftext|>"), (3, "x  <|endoftext|><|endoftext|>\n\n y"), (4, "<|endof"), (5, "text|> <|endoftext|"), (6, "plain words"), (7, "é<|endoftext|>'s")]


def test_operators_read_names_of_added_tokens(spark):
    assert untouched(NAMED[1][1]) == [50256]
    folder = scratch_path(spark, "file")
    write_token_file(frame(spark, NAMED), folder, byte_vocabulary(), 0)
    want = {d: untouched(t) for d, t in NAMED}
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in read_token_file(spark, folder).collect()}
    at = 0
    for d, _ in NAMED:
        assert got[d] == (at, len(want[d]) + 1, crc(want[d] + [0]))
        at += len(want[d]) + 1
    packed = pack_documents(frame(spark, NAMED), byte_vocabulary(), window=2048, end=1).collect()
    assert {r.doc_id: (r.doc_tokens, r.ids_crc32) for r in packed} == {d: (len(x) + 1, crc(x + [1])) for d, x in want.items()}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 10**6), min_size=1, max_size=300), st.integers(9, 16))
def test_code_lengths(counts, limit):
    lengths = code_lengths(np.array(counts), limit)
    used = np.array(counts) > 0
    assert ((lengths > 0) == used).all() and lengths.max(initial=0) <= limit
    if used.sum() > 1:
        assert sum(2.0 ** -float(x) for x in lengths[used]) == 1.0


def test_code_lengths_are_optimal_without_a_limit():
    import heapq

    counts = np.array([1, 1, 2, 3, 5, 8, 13, 21, 40, 0])
    heap, cost = [int(c) for c in counts if c], 0
    heapq.heapify(heap)
    while len(heap) > 1:
        s = heapq.heappop(heap) + heapq.heappop(heap)
        cost += s
        heapq.heappush(heap, s)
    assert int((code_lengths(counts, 16) * counts).sum()) == cost
    with pytest.raises(ValueError):
        code_lengths(np.ones(40, int), 5)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 40).map(lambda x: x * x), min_size=1, max_size=700), min_size=1, max_size=6))
def test_codes_round_trip(documents):
    ids, counts = np.concatenate([np.array(d) for d in documents]), np.array([len(d) for d in documents])
    lengths = code_lengths(np.bincount(ids))
    data, first, marks = encode_documents(ids, counts, canonical_codes(lengths), lengths)
    assert decode_documents(data, first[:-1], counts, np.concatenate(marks), decode_tables(lengths, LIMIT)).tolist() == ids.tolist()


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_token_file(spark):
    rows = texts()
    folder = scratch_path(spark, "file")
    write_token_file(frame(spark, rows), folder, byte_vocabulary(), 0)
    got = sorted(read_token_file(spark, folder, ids=True).collect(), key=lambda r: r.start)
    want = Counter((d, tuple(whole(t) + [0])) for d, t in rows)
    read = [(r.doc_id, tuple(np.frombuffer(r.ids, "<u4").tolist())) for r in got]
    assert Counter(read) == want
    assert [order(d) for d, _ in read] == sorted(order(d) for d, _ in rows)
    at = 0
    for r, (_, ids) in zip(got, read, strict=True):
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), crc(ids))
        at += len(ids)


def test_segments_of_a_token_file(spark, monkeypatch):
    from wardlight.llm import token_file

    monkeypatch.setattr(token_file, "SEGMENT_IDS", 500)
    code = token_file.encode_documents
    seen = spark.sparkContext.accumulator(0)

    def counted(ids, *given):
        seen.add(1)
        return code(ids, *given)

    monkeypatch.setattr(token_file, "encode_documents", counted)
    rows = [(i * 7 % 400, f"text {i} of a few words") for i in range(400)] + [(150, f"copy {i} of one id") for i in range(300)] + [(None, f"no id {i}") for i in range(200)]
    folder = scratch_path(spark, "file")
    write_token_file(frame(spark, rows), folder, byte_vocabulary(), 0)
    blocks = spark.read.parquet(f"{folder}/blocks").collect()
    # each block of documents is encoded once, for the shuffle and not for its bounds too
    assert 0 < seen.value <= frame(spark, rows).rdd.getNumPartitions()
    assert len(blocks) > 8 and max(np.frombuffer(b.counts, np.int64).sum() for b in blocks) < 4 * 500
    got = sorted(read_token_file(spark, folder, ids=True).collect(), key=lambda r: r.start)
    assert [order(r.doc_id) for r in got] == sorted(order(d) for d, _ in rows)
    assert Counter((r.doc_id, r.ids) for r in got) == Counter((d, np.array(whole(t) + [0], "<u4").tobytes()) for d, t in rows)
    assert [r.start for r in got] == np.cumsum([0, *(r.n_tokens for r in got)])[:-1].tolist()


def test_new_pieces_are_encoded_many_at_a_time():
    from wardlight.llm.tokens import Encoder

    parts = [f"word{i} {i:x}, and  other\n things{i * 3}. é{i} <|endoftext|> {i}" for i in range(500)]
    for names, want in ((False, whole), (True, untouched)):
        made = Encoder(byte_vocabulary(), names)
        calls, real = [], made.tokenizer

        class Counting:
            def encode_batch_fast(self, texts, **given):
                calls.extend(texts)
                return real.encode_batch_fast(texts, **given)

        made.tokenizer = Counting()
        ids, counts = made.encode(block(parts))
        assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == [want(p) for p in parts]
        assert len(calls) < 0.8 * len(made.young)


def test_packing(spark):
    rows = texts()
    got = pack_documents(frame(spark, rows), byte_vocabulary(), window=256, end=1, ids=True).collect()
    documents = Counter((d, tuple(whole(t) + [1])) for d, t in rows)
    sequences = {}
    for r in got:
        ids = np.frombuffer(r.ids, "<u4").tolist()
        assert len(ids) == r.length and crc(ids) == r.ids_crc32
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 256
    pieces = Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in got)
    want = Counter()
    for (d, ids), n in documents.items():
        for a in range(0, len(ids), 256):
            want[(d, a, len(ids[a:a + 256]), crc(ids[a:a + 256]), len(ids))] += n
    assert pieces == want
    total = sum(len(ids) * n for (_, ids), n in documents.items())
    assert total / (256 * len(sequences)) > 0.97


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 30), max_size=25))
def test_best_fit_decreasing_is_that_of_single_pieces(lengths):
    window, open_ = 40, []
    for length in sorted(lengths, reverse=True):
        for _ in range(lengths[length]):
            fits = [i for i, free in enumerate(open_) if free >= length]
            if fits:
                open_[min(fits, key=lambda i: open_[i])] -= length
            else:
                open_.append(window - length)
    filled, seen = {}, Counter()
    for length, low, high, each, first, base in best_fit_decreasing(lengths, window):
        for rank in range(low, high):
            s, offset = first + (rank - low) // each, base + (rank - low) % each * length
            assert filled.get(s, 0) == offset
            filled[s] = offset + length
            seen[length] += 1
    assert seen == Counter(lengths) and sorted(window - f for f in filled.values()) == sorted(open_)


def test_empty_tables(spark):
    folder = scratch_path(spark, "file")
    write_token_file(empty(spark), folder, byte_vocabulary())
    assert read_token_file(spark, folder).count() == 0
    assert pack_documents(empty(spark), byte_vocabulary()).count() == 0
