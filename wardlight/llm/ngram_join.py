"""Documents whose sets of word shingles are alike, by T-occurrence search.

Documents with one set are one class. Every shingle's document frequency is counted exactly over the classes; the list
of a shingle that one class alone has is empty for all others, so a class with too few shared shingles is out. For the
rest, the shortest lists name candidates; each search then merges the short lists by a heap, and probes the long ones by
binary search only for candidates that can still reach the required overlap (DivideSkip).

Only components are wanted. Documents that share short lists are dealt into chunks and searched there, then in the chunks
of their lists' leaders, at last in every chunk with which they share a list and not the component. No pairs are made:
a search returns links only, and what is connected already is not searched for.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardlight.llm.blocks import (
    NO_ID, U64, Block, gather, map_blocks, mix, pack_array, pack_blocks, pack_sorted, partitions_of, ranges_of, reply, send, unpack_array,
    unpack_sorted, word_hashes, words_of, write_table,
)
from wardlight.llm.components import components

SHINGLE = 3
KEY_BITS = 40  # of a shingle while its frequency is counted; a collision only makes a list look longer
CHUNK = 200  # documents of a group that is searched within, about
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def shingles(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (shingle, document) of a block, by document, then shingle."""
    low = Block(block.number, block.ids, block.offsets, LOWER[block.data])
    starts, ends, doc = words_of(low)
    h = word_hashes(low.data, starts, ends)
    n = np.bincount(doc, minlength=len(block.ids))
    whole = (doc[:max(0, len(h) - 2)] == doc[2:]) if len(h) > 2 else np.zeros(0, bool)
    at = np.flatnonzero(whole)
    c = [U64(0x9E3779B97F4A7C15), U64(0xD1342543DE82EF95), U64(0xBF58476D1CE4E5B9)]
    s = mix(h[at] * c[0] + mix(h[at + 1] * c[1] + mix(h[at + 2] * c[2])))
    first = np.flatnonzero(np.diff(doc, prepend=-1)) if len(doc) else doc
    short = first[n[doc[first]] < SHINGLE]
    two = short[n[doc[short]] == 2]
    one = short[n[doc[short]] == 1]
    s = np.concatenate((s, mix(h[one] ^ c[0]), mix(mix(h[two] ^ c[1]) + h[two + 1])))
    d = np.concatenate((doc[at], doc[one], doc[two]))
    order = np.lexsort((s, d))
    s, d = s[order], d[order]
    new = np.ones(len(s), bool)
    new[1:] = (s[1:] != s[:-1]) | (d[1:] != d[:-1])
    return s[new], d[new]


def required(n: np.ndarray, m: np.ndarray, percent: int) -> np.ndarray:
    """Least overlap of sets of n and m shingles at a Jaccard similarity of ``percent`` hundredths."""
    return -((-percent * (n + m)) // (100 + percent))


def _sets(block: Block):
    """(doc_id, block, idx, n, key): a set's size and a 64-bit name that equal sets share."""
    s, d = shingles(block)
    n = np.bincount(d, minlength=len(block.ids))
    start = np.flatnonzero(np.diff(d, prepend=-1)) if len(d) else d
    key = np.zeros(len(block.ids), U64)
    if len(d):
        key[d[start]] = mix(np.add.reduceat(mix(s ^ U64(0x5851F42D4C957F2D)), start) + n[d[start]].astype(U64))
    k = len(block.ids)
    return {
        "doc_id": pa.array(block.ids, mask=block.ids == NO_ID), "block": pa.array([block.number] * k, pa.int64()), "idx": pa.array(np.arange(k), pa.int32()),
        "n": pa.array(n, pa.int64()), "key": pa.array(key.view(np.int64)),
    }


def _own(block: Block, chosen: dict):
    """Shingles of the documents that stand for their class, and the class of each document."""
    s, d = shingles(block)
    pick = np.zeros(len(block.ids), bool)
    pick[list(chosen)] = True
    return s[pick[d]], d[pick[d]]


def _frequencies(parts: int):
    def run(block: Block, chosen: dict):
        s, _ = _own(block, chosen)
        keys, count = np.unique(s >> U64(64 - KEY_BITS), return_counts=True)
        return {p: pack_sorted(keys[a:b]) + pack_array(count[a:b].astype(U64) - U64(1)) for p, a, b in ranges_of(keys, parts, KEY_BITS)}
    return run


def _orders(messages: list) -> list[bytes]:
    """For each shingle of each block 0 if one class has it, else a number that grows with its document frequency."""
    read = []
    for m in messages:
        k, at = unpack_sorted(m)
        read.append((k, unpack_array(m, at)[0].astype(np.int64) + 1))
    keys = np.unique(np.concatenate([k for k, _ in read]))
    df = np.zeros(len(keys), np.int64)
    for k, c in read:
        df[np.searchsorted(keys, k)] += c
    order = np.where(df > 1, 1 + np.rint(4 * np.log2(df)), 0).astype(np.uint8)  # below 256 for any 63-bit count
    return [order[np.searchsorted(keys, k)].tobytes() for k, _ in read]


def _survivors(parts: int, percent: int):
    """(key, n, short, shared) of classes that can have a partner: shingles of their short lists, all shared shingles."""
    def run(block: Block, chosen: dict, answers: dict):
        s, d = _own(block, chosen)
        keys, back = np.unique(s >> U64(64 - KEY_BITS), return_inverse=True)
        order = gather(keys, parts, answers, lambda m, n: np.frombuffer(m, np.uint8, n), KEY_BITS)
        order = order[back] if len(s) else np.zeros(0, np.uint8)
        n = np.bincount(d, minlength=len(block.ids))
        least = required(n, -((-percent * n) // 100), percent)
        shared = order > 0
        possible = np.bincount(d[shared], minlength=len(n)) >= np.maximum(least, 1)
        keep = shared & possible[d]
        s, d, order = s[keep], d[keep], order[keep]
        rank = np.lexsort((s, order, d))  # shortest lists first
        docs = np.unique(d)
        size = np.bincount(d, minlength=len(n))[docs]
        begin = np.cumsum(size) - size
        lists = n[docs] - least[docs] + 1 - (n[docs] - size)  # the lists of the others are empty
        ranked = s[rank]
        return {
            "key": pa.array([int(chosen[i].decode()) for i in docs.tolist()], pa.int64()), "n": pa.array(n[docs], pa.int64()),
            "short": pa.array([ranked[a:a + k].tobytes() for a, k in zip(begin.tolist(), lists.tolist(), strict=True)], pa.binary()),
            "shared": pa.array([s[a:a + k].tobytes() for a, k in zip(begin.tolist(), size.tolist(), strict=True)], pa.binary()),
        }
    return run


def divide_skip(query: np.ndarray, n: int, sets: list[np.ndarray], sizes: np.ndarray, percent: int) -> list[int]:
    """Which of the ``sets`` (sorted shingles) share enough with ``query`` (sorted); ``sizes`` and ``n`` count all their shingles.

    The lists of the query's shingles hold places in ``sets``. The longest are set aside, as many as the threshold allows by the
    rule of thumb T / (0.01 log2(longest) + 1); the others are merged by a heap, and who can still reach the
    threshold is looked up in the long lists by binary search.
    """
    least = required(np.full(len(sets), n), sizes, percent)
    lists: list[list[int]] = [[] for _ in range(len(query))]
    for j, s in enumerate(sets):
        at = np.minimum(np.searchsorted(query, s), len(query) - 1)
        for i in at[query[at] == s].tolist():
            lists[i].append(j)
    threshold = int(least.min())
    order = sorted(range(len(lists)), key=lambda i: len(lists[i]))
    long = min(threshold - 1, int(threshold / (0.01 * np.log2(max(2, len(lists[order[-1]]))) + 1)))
    short = order[:len(order) - long]
    found: dict[int, int] = {}
    for j in heapq.merge(*(lists[i] for i in short)):
        found[j] = found.get(j, 0) + 1
    probe = np.sort(query[order[len(order) - long:]])
    out = []
    for j, count in found.items():
        if count < least[j] - long:
            continue
        at = np.minimum(np.searchsorted(sets[j], probe), len(sets[j]) - 1)
        if count + int((sets[j][at] == probe).sum()) >= least[j]:
            out.append(j)
    return out


def links(members: DataFrame, survivors: DataFrame, labels: DataFrame | None, percent: int) -> DataFrame:
    """Links (a, b) found by searching each group of ``members`` (g, key, asks), one document after another.

    Documents that ask are searched for among the others of the group; if all ask, among each other.

    What is connected already, by ``labels`` or by a link of the group, is not searched again: groups of copies take one
    search per copy, not one per pair.
    """
    rows = members.join(survivors.select("key", "n", "shared"), "key")
    rows = rows.withColumn("label", F.col("key")) if labels is None else rows.join(labels.withColumnRenamed("v", "key"), "key", "left").withColumn("label", F.coalesce("label", "key"))

    def search(table: pa.Table) -> pa.Table:
        rows = table.sort_by("key").to_pydict()
        keys, sets, sizes = rows["key"], [np.frombuffer(x, U64) for x in rows["shared"]], np.array(rows["n"], np.int64)
        above: dict[int, int] = {}

        def find(x: int) -> int:
            while x in above:
                x = above[x]
            return x

        a, b = [], []
        asking, among = [i for i, x in enumerate(rows["asks"]) if x], [i for i, x in enumerate(rows["asks"]) if not x]
        for i in asking:
            own = find(rows["label"][i])
            others = [j for j in among or range(i + 1, len(keys)) if find(rows["label"][j]) != own]
            for k in divide_skip(sets[i], int(sizes[i]), [sets[j] for j in others], sizes[others], percent) if others else []:
                own, other = find(own), find(rows["label"][others[k]])
                if own != other:
                    above[other] = own
                    a.append(keys[i]), b.append(keys[others[k]])
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return rows.select("g", "key", "asks", "n", "shared", "label").groupBy("g").applyInArrow(search, "a long, b long")


def asked(queries: DataFrame, chunks: DataFrame) -> DataFrame:
    """Groups (g, key, asks) in which each document of ``queries`` (key, chunk) is searched for among those of its ``chunk``.

    A chunk with many queries is searched in several groups.
    """
    parts = queries.groupBy("chunk").agg(F.ceil(F.count(F.lit(1)) / CHUNK).cast("int").alias("parts"))
    asks = queries.join(parts, "chunk").select(F.xxhash64("chunk", F.pmod(F.xxhash64("key"), "parts").cast("int")).alias("g"), "key", F.lit(True).alias("asks"))
    own = parts.select("chunk", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")).join(chunks, "chunk")
    return asks.union(own.select(F.xxhash64("chunk", "part").alias("g"), "key", F.lit(False).alias("asks")))


def asking(postings: DataFrame, ranked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of the lists that hold two components: the documents that ask (h, key, chunk, rank), all but those of the largest one; and (h, to, top), the chunks with their largest component.

    A list within one component, as most lists of a group of copies are, has neither.
    """
    lists = postings.select("h", "key").join(ranked, "key")
    label = F.col("rank.label")
    open_ = lists.groupBy("h").agg(F.min(label).alias("low"), F.max(label).alias("high"), F.max("rank").alias("best")).where("low < high").select("h", "best")
    lists = write_table(lists.join(open_, "h"), "open-lists")
    return lists.where(F.col("rank") < F.col("best")).drop("best"), lists.groupBy("h", F.col("chunk").alias("to")).agg(F.max("rank").alias("top"))


def open_queries(postings: DataFrame, chunks: DataFrame, label: DataFrame) -> DataFrame:
    """(key, chunk): chunks that hold, in a list of the document, one of another and larger component.

    Of two documents that may be linked the one of the smaller component asks, so a large group of copies asks for nothing.
    """
    named = chunks.join(label.withColumnRenamed("v", "key"), "key", "left").withColumn("label", F.coalesce("label", "key"))
    sizes = named.groupBy("label").agg(F.count(F.lit(1)).alias("size"))
    ranked = write_table(named.join(sizes, "label").select("key", "chunk", F.struct("size", "label").alias("rank")), "ranked")
    queries, tops = asking(postings, ranked)
    wanted = queries.join(tops, "h").where((F.col("chunk") != F.col("to")) & (F.col("top") > F.col("rank")))
    return wanted.select("key", F.col("to").alias("chunk")).distinct()


def similar_documents(docs: DataFrame, percent: int = 90) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable by links) for each row of ``docs`` (doc_id, text).

    Words lie between white space, A-Z in lower case; a set holds the distinct runs of three words, or all words of a shorter text.
    Two sets link when 100 * intersection >= ``percent`` * union. A null, empty or blank text has an empty set and no link,
    equal texts always link. Rows of one doc_id are documents of their own; a null doc_id stays null and names no
    component that has another id. An empty table gives an empty result.
    """
    blocks = pack_blocks(docs)
    parts = partitions_of(blocks)
    rows = write_table(map_blocks(blocks, _sets, "doc_id long, block long, idx int, n long, key long"), "sets")
    # one document of each class: copies go no further
    chosen = rows.where("n > 0").groupBy("key").agg(F.min(F.struct("block", "idx")).alias("at"))
    chosen = write_table(chosen.select(F.col("at.block").alias("block"), F.col("at.idx").alias("part"), F.col("key").cast("string").cast("binary").alias("answer")), "classes")
    orders = reply(send(blocks, _frequencies(parts), parts, [chosen]), _orders, "frequencies")
    survivors = write_table(map_blocks(blocks, _survivors(parts, percent), "key long, n long, short binary, shared binary", [chosen, orders]), "survivors")

    def unroll(batches):
        for batch in batches:
            for row in batch.to_pylist():
                h = np.frombuffer(row["short"], np.int64)
                yield pa.RecordBatch.from_pydict({"h": pa.array(h), "key": pa.array([row["key"]] * len(h), pa.int64()), "n": pa.array([row["n"]] * len(h), pa.int64())})

    postings = write_table(survivors.select("key", "n", "short").mapInArrow(unroll, "h long, key long, n long"), "postings")
    # every list has a leader; documents are dealt into chunks by the smallest leader of their lists
    leaders = write_table(postings.groupBy("h").agg(F.min("key").alias("leader")), "leaders")
    family = postings.join(leaders, "h").groupBy("key").agg(F.min("leader").alias("family"))
    family = write_table(family, "families")
    sizes = family.groupBy("family").agg(F.ceil(F.count(F.lit(1)) / CHUNK).alias("chunks"))
    chunks = family.join(sizes, "family").select("key", F.xxhash64("family", F.pmod(F.xxhash64("key"), "chunks")).alias("chunk"))
    chunks = write_table(chunks, "chunks")
    edges = write_table(links(chunks.select(F.col("chunk").alias("g"), "key", F.lit(True).alias("asks")), survivors, None, percent), "links")
    label = components(edges)
    # between chunks: first among those of each list's leader
    leads = postings.select("h", "key").join(leaders, "h").where("key <> leader").select("key", "leader").distinct()
    of = chunks.select(F.col("key").alias("leader"), F.col("chunk").alias("to"))
    near = leads.join(of, "leader").join(chunks, "key").where("chunk <> to").select("key", F.col("to").alias("chunk")).distinct()
    edges = edges.union(write_table(links(asked(write_table(near, "queries"), chunks), survivors, label, percent), "links"))
    label = components(edges)
    # then wherever a list still holds two components
    rest = write_table(open_queries(postings, chunks, label), "queries")
    if rest.take(1):
        edges = edges.union(links(asked(rest, chunks), survivors, label, percent))
        label = components(edges)
    named = rows.join(label.withColumnRenamed("v", "key"), "key", "left").withColumn("label", F.coalesce("label", "key"))
    named = write_table(named.select("doc_id", "n", "label"), "named")
    smallest = named.where("n > 0").groupBy("label").agg(F.min("doc_id").alias("component"))
    joined = named.join(smallest, "label", "left")
    return joined.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc_id")).alias("component_id"))
