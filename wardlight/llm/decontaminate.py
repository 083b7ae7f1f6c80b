"""Benchmark passages in training documents, found in a positional inverted index.

The index holds, for the rarest terms of each benchmark window, every position in every distinct text. The lists of a
window's terms, moved by their offsets, are intersected from the rarest on, within a few words' distance: that gives the
proximity matches, and those at no distance are compared word for word with the text. Equal texts are one entry of the
index, windows are numbers until the end, and items are listed once for each set of windows. Everything is DataFrame work.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardlight.llm.blocks import unused, write_table
from wardlight.session import small_or_self

SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PROBES = 3  # of the rarest terms whose lists are intersected before words are compared
SLOP = 2  # words by which a term may stand nearer or farther in a proximity match
STRIP = 16  # positions of a strip of the index


def words_of(text: Column) -> Column:
    """Words as they stand: runs of letters and digits of ASCII and of all other characters."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SEPARATORS), "")


def lower_ascii(word: Column) -> Column:
    return F.translate(word, UPPER, LOWER)


def window_rows(benchmark: DataFrame, window: int) -> DataFrame:
    """(window, terms, item), once each: the terms in lower case, a 128-bit number of them, and an item that holds them."""
    words = benchmark.select(F.col("item_id").cast("string").alias("item"), F.transform(words_of(F.col("text")), lower_ascii).alias("w")).where(F.size("w") > 0)
    last = F.greatest(F.size("w") - window, F.lit(0))
    terms = F.transform(F.sequence(F.lit(0), last), lambda i: F.slice("w", i + 1, F.lit(window)))
    rows = words.select("item", F.explode(terms).alias("terms"))
    return rows.select(F.unhex(F.md5(F.array_join("terms", " ").cast("binary"))).alias("window"), "terms", "item").distinct()


def benchmark_windows(benchmark: DataFrame, window: int) -> DataFrame:
    """(window, terms) of the distinct windows."""
    return window_rows(benchmark, window).select("window", "terms").distinct()


def tokens(docs: DataFrame) -> DataFrame:
    """(text_key, pos, term) of every word; terms by full lower case, of which the exact comparison keeps a part."""
    exploded = docs.select(text_key(), F.posexplode(words_of(F.col("text"))).alias("pos", "word"))
    return exploded.select("text_key", "pos", F.lower("word").alias("term"))


def text_key() -> Column:
    return F.md5(F.col("text").cast("binary")).alias("text_key")


def rarest_probes(docs: DataFrame, windows: DataFrame) -> DataFrame:
    """Windows whose terms all occur, with their rarest terms (term, off) in rising order of frequency."""
    listed = windows.select("window", F.posexplode(F.transform("terms", F.lower)).alias("off", "term"))
    vocabulary = small_or_self(listed.select("term").distinct(), 200_000)
    counts = tokens(docs).join(vocabulary, "term").groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    ranked = listed.join(small_or_self(write_table(counts, "term-counts"), 200_000), "term", "left")
    probes = F.slice(F.array_sort(F.collect_list(F.struct("n", "term", "off"))), 1, PROBES)
    return ranked.groupBy("window").agg(probes.alias("probes"), F.min(F.coalesce("n", F.lit(0))).alias("least")).where("least > 0").drop("least")


def build_index(docs: DataFrame, probes: DataFrame) -> DataFrame:
    """Postings (term, text_key, pos) of the probe terms over all texts; a table in the shared folder."""
    terms = small_or_self(probes.select(F.explode("probes.term").alias("term")).distinct(), 200_000)
    return write_table(tokens(docs).join(terms, "term").select("term", "text_key", "pos").distinct(), "postings")


def strips(index: DataFrame, slop: int) -> DataFrame:
    """Postings in strips of positions: (term, text_key, strip, positions). A strip holds ``slop`` positions beyond either end, so one strip answers for any place."""
    ends = [F.floor((F.col("pos") + d) / STRIP) for d in (-slop, slop)]
    spread = index.select("term", "text_key", "pos", F.explode(F.array_distinct(F.sequence(*ends))).alias("strip"))
    return write_table(spread.groupBy("term", "text_key", "strip").agg(F.collect_list("pos").alias("positions")), "strips")


def near_matches(index: DataFrame, probes: DataFrame, slop: int = SLOP) -> DataFrame:
    """Proximity: (text_key, window, start, distance) where the rarest probe of a window stands and each of its other probes is at most
    ``slop`` words from where the window has it; ``distance`` is that of the farthest one, 0 if all stand as in the window.

    Lists are intersected from the rarest on. A place asks one strip of each list, so a term that fills a text gives no pairs.
    """
    def probe(k: int) -> Column:  # a window of few words repeats its last probe
        return F.element_at("probes", F.least(F.lit(k), F.size("probes")))

    small = small_or_self(probes, 200_000)
    first = small.select("window", "probes", probe(1)["term"].alias("term"), probe(1)["off"].alias("off"))
    found = index.join(first, "term").select("text_key", "window", "probes", (F.col("pos") - F.col("off")).alias("start"), F.lit(0).alias("distance")).where("start >= 0")
    lists = strips(index, slop)
    for k in range(2, PROBES + 1):
        place = F.col("start") + probe(k)["off"]
        here = found.withColumns({"term": probe(k)["term"], "place": place, "strip": F.floor(place / STRIP)}).join(lists, ["term", "text_key", "strip"])
        away = F.array_min(F.transform("positions", lambda p: F.abs(p - F.col("place"))))
        found = here.select("text_key", "window", "probes", "start", F.greatest("distance", away).alias("distance")).where(F.col("distance") <= slop)
    return found.select("text_key", "window", "start", "distance")


def compared(docs: DataFrame, named: DataFrame) -> DataFrame:
    """(text_key, n_hit, windows) of texts in which candidates (text_key, start, window, terms) prove right, word for word."""
    keys = write_table(named.groupBy("text_key").agg(F.collect_set(F.struct("start", "window", "terms")).alias("occurrences")), "occurrences")
    texts = docs.select(text_key(), "text").join(small_or_self(keys.select("text_key")), "text_key", "left_semi").groupBy("text_key").agg(F.first("text").alias("text"))
    rows = texts.withColumn("words", words_of(F.col("text"))).drop("text").join(keys, "text_key")

    def matches(o: Column) -> Column:
        return F.transform(F.slice("words", o["start"] + 1, F.size(o["terms"])), lower_ascii) == o["terms"]

    rows = rows.select("text_key", F.filter("occurrences", matches).alias("o")).where(F.size("o") > 0)
    covered = F.array_distinct(F.flatten(F.transform("o", lambda o: F.sequence(o["start"], o["start"] + F.size(o["terms"]) - 1))))
    return rows.select("text_key", F.size(covered).cast("long").alias("n_hit"), F.sort_array(F.array_distinct(F.transform("o", lambda o: o["window"]))).alias("windows"))


def listed_items(hits: DataFrame, holders: DataFrame) -> DataFrame:
    """(windows, items): of each set of windows that texts hold, the items as sorted strings. ``holders``: (window, item)."""
    sets = hits.select("windows").distinct().withColumn("set", F.md5(F.array_join(F.transform("windows", F.hex), "").cast("binary")))
    pairs = sets.select("set", F.explode("windows").alias("window")).join(holders, "window").select("set", "item").distinct()
    items = pairs.groupBy("set").agg(F.sort_array(F.collect_list("item")).alias("items"))
    return sets.join(items, "set").select("windows", "items")


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 13, share: int = 20, prefix: str = "", slop: int = SLOP) -> DataFrame:
    """Every column of ``docs`` and what of its words benchmark windows cover; ``prefix`` stands before the new names.

    A window: ``window`` consecutive words of an item, or all words of a shorter one. New columns (they replace columns of the same name): n_words, n_hit (words
    inside any occurrence of a window), n_items, items (distinct item ids as sorted strings), contaminated (a hit, and
    at least one in ``share`` words), n_near (windows of which the rarest terms, up to three, stand at most ``slop`` words from their places, exact
    occurrences included; terms compare by full lower case, and a window counts only if all its terms are somewhere in ``docs``). Null and wordless texts have no words and
    are clean; items without words are not looked for; a null item_id counts as an item without a name, which no list holds. Repeated rows each get their own,
    equal, row; doc_id is not read. Empty tables give an empty result or clean documents. Benchmark tables are broadcast while they have at most 200,000 rows, else joined by shuffles.
    """
    name = {c: prefix + c for c in ("n_words", "n_hit", "n_items", "items", "contaminated", "n_near")}
    docs = docs.drop(*name.values())
    held = write_table(window_rows(benchmark, window), "held")
    windows = write_table(held.select("window", "terms").distinct(), "windows")
    probes = write_table(rarest_probes(docs, windows), "probes")
    near = write_table(near_matches(build_index(docs, probes), probes, slop), "near")
    exact = near.where("distance = 0").select("text_key", "window", "start").join(small_or_self(windows, 200_000), "window")
    hits = write_table(compared(docs, exact), "hits")
    lists = write_table(listed_items(hits, held.select("window", "item")), "items")
    close = near.groupBy("text_key").agg(F.count_distinct("window").alias("n_near"))
    key, words, own_hit, own_set, own_items, own_near = (unused(docs.columns, c) for c in ("__text_key", "__words", "__hit", "__set", "__items", "__near"))
    hits = hits.select(F.col("text_key").alias(key), F.col("n_hit").alias(own_hit), F.col("windows").alias(own_set))
    lists = lists.select(F.col("windows").alias(own_set), F.col("items").alias(own_items))
    close = write_table(close.select(F.col("text_key").alias(key), F.col("n_near").alias(own_near)), "close")
    rows = docs.withColumn(key, text_key()).withColumn(words, F.size(words_of(F.col("text"))).cast("long")).join(small_or_self(hits), key, "left").join(small_or_self(close), key, "left").join(small_or_self(lists), own_set, "left")
    hit, items = F.coalesce(own_hit, F.lit(0).cast("long")), F.coalesce(own_items, F.array().cast("array<string>"))
    return rows.select(
        *[F.col(f"`{c}`") for c in docs.columns], F.col(words).alias(name["n_words"]), hit.alias(name["n_hit"]), F.size(items).cast("long").alias(name["n_items"]), items.alias(name["items"]),
        ((hit > 0) & (share * hit >= F.col(words))).alias(name["contaminated"]), F.coalesce(own_near, F.lit(0).cast("long")).alias(name["n_near"]),
    )
