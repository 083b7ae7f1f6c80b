"""Ordered work (positions, ranks, running values) that holds when one key owns a large share of the rows.

A plain ``Window.partitionBy(key)`` sorts all rows of a key in one task.  Here the order axis is cut into buckets by
value: each (key, bucket) is one small window, the buckets are reduced to one row each by a partially aggregated
``groupBy``, and only that reduced table is scanned per key.  Buckets come from values, or from row positions in a sorted
table that was written once, so a re-run task sees the same buckets.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardlight.session import materialize

# Up to this many rows a top-k is one small sort; beyond it the cut is found by distributed ranking.
TOPK_ROWS = 100_000


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join on ``keys`` where null matches null; the result has ``keys`` once, from the left."""
    other = right.withColumnsRenamed({k: f"__right_{k}" for k in keys})
    match = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__right_{k}")) for k in keys])
    joined = left.join(other, match, how)
    return joined.drop(*[f"__right_{k}" for k in keys])


def exclusive_running(parts: DataFrame, keys: Sequence[str], order: Sequence[str], specs: dict[str, tuple[str, str]]) -> DataFrame:
    """For each reduced row, the running value over the earlier rows of its key.

    ``specs`` maps an output column to ``(kind, column)`` with kind ``sum``, ``max`` or ``last`` (last non-null).
    The first row of a key gets null (``sum``: 0).
    """
    window = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    kinds = {
        "sum": lambda c: F.coalesce(F.sum(c).over(window), F.lit(0)),
        "max": lambda c: F.max(c).over(window),
        "last": lambda c: F.last(c, ignorenulls=True).over(window),
    }
    return parts.withColumns({out: kinds[kind](column) for out, (kind, column) in specs.items()})


def position_in_group(df: DataFrame, keys: Sequence[str], order: str, width: int = 4096, out: str = "position") -> DataFrame:
    """1-based position of each row inside its group, in the order of the integer column ``order``.

    ``order`` is unique within a group, so a bucket of ``width`` values holds at most ``width`` rows however large the
    group is.  One shuffle of the rows, by (group, bucket); the bucket counts are partially aggregated.
    """
    # one column for the whole key, in which null is a value: windows, counts and the join then agree on one exchange of the rows
    bucketed = df.withColumns({"__key": F.struct(*keys), "__bucket": F.floor(F.col(order) / F.lit(width)).cast("long")})
    counts = bucketed.groupBy("__key", "__bucket").agg(F.count(F.lit(1)).alias("__rows"))
    offsets = exclusive_running(counts, ["__key"], ["__bucket"], {"__offset": ("sum", "__rows")}).drop("__rows")
    ranked = bucketed.withColumn("__rank", F.row_number().over(Window.partitionBy("__key", "__bucket").orderBy(order)))
    joined = ranked.join(offsets, ["__key", "__bucket"])
    return joined.withColumn(out, (F.col("__offset") + F.col("__rank")).cast("long")).select(*df.columns, out)


def ordered_blocks(df: DataFrame, order: Sequence[str], rows: int, parts: int | None = None) -> DataFrame:
    """``df`` sorted by ``order`` over the whole table, in blocks of at most ``rows`` consecutive rows: ``__block`` rises with the order, ``__place`` rises inside a block.

    Blocks are cut by row position, so neither a busy key nor many rows of one value make a large one. The rows are dealt by sampled cuts of ``order`` and written sorted; positions
    are those of the written table, so a re-run task sees the same ones. ``order`` should be unique, or rows that are equal in it stand in any order.
    """
    dealt = df.repartitionByRange(parts, *order) if parts else df.repartitionByRange(*order)
    at = F.monotonically_increasing_id()  # its partition above bit 33, the place in the partition below
    placed = materialize(dealt.sortWithinPartitions(*order).withColumn("__at", at), "ordered")
    place = F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    block = F.shiftleft(F.shiftright("__at", 33), 33) + F.floor(place / F.lit(rows))
    return placed.withColumns({"__block": block.cast("long"), "__place": (place % rows).cast("int")}).drop("__at")


def global_rank(df: DataFrame, value: str, tie: str, out: str = "rank", descending: bool = False, parts: int | None = None) -> DataFrame:
    """1-based rank of every row by ``value`` and then rising ``tie`` over the whole table, without a single-task sort.

    The rows are dealt to ``parts`` ranges (default: the shuffle partitions) of the pair, cut at pairs that Spark samples, and each
    range is sorted; rank = rows of the ranges before + place in the range. Ties are cut like anything else, so a value that most rows share does
    not end up in one task. Nulls come first (last if ``descending``), NaN counts as the largest number. The input is evaluated once.
    """
    order = [F.col(value).desc() if descending else F.col(value).asc(), F.col(tie).asc()]
    kept = materialize(df, "to-rank")
    dealt = kept.repartitionByRange(parts, *order) if parts else kept.repartitionByRange(*order)
    placed = materialize(dealt.sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id()), "ranked")
    # the id of a row: its partition above bit 33, its place in the partition below
    part, place = F.shiftright("__at", 33), F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    counts = placed.groupBy(part.alias("__part")).agg(F.count(F.lit(1)).alias("__rows"))
    # a row for each range: one constant key, one small window
    before = exclusive_running(counts.withColumn("__all", F.lit(1)), ["__all"], ["__part"], {"__before": ("sum", "__rows")})
    ranked = placed.withColumn("__part", part).join(F.broadcast(before.select("__part", "__before")), "__part")
    return ranked.select(*[F.col(c) for c in df.columns], (F.col("__before") + place + 1).cast("long").alias(out))


def take_smallest(df: DataFrame, value: str, tie: str, k: int, rank: str | None = None, topk_rows: int = TOPK_ROWS, descending: bool = False) -> DataFrame:
    """The ``k`` first rows by ``value`` (largest first if ``descending``) and rising ``tie``, with their 1-based rank when ``rank`` names a column.

    A small ``k`` is a top-k (each task keeps ``k`` rows, one task merges and numbers them).  A large ``k`` is cut by
    distributed rank.
    """
    out = rank or "__rank"
    order = [F.col(value).desc() if descending else F.col(value).asc(), F.col(tie).asc()]
    if k <= topk_rows:
        top = df.orderBy(*order).limit(k)
        if rank is None:
            return top
        # at most topk_rows rows: one small window
        return top.withColumn(rank, F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(*order)).cast("long"))
    ranked = global_rank(df, value, tie, out=out, descending=descending).filter(F.col(out) <= k)
    return ranked if rank else ranked.drop(out)


def row_index(df: DataFrame, order: str, tie: str, out: str = "index", small_rows: int = TOPK_ROWS) -> DataFrame:
    """1-based row number over a whole table: one small window when the table is small, distributed rank otherwise."""
    if df.limit(small_rows + 1).count() <= small_rows:
        return df.withColumn(out, F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(order, tie)).cast("long"))
    return global_rank(df, order, tie, out=out)
