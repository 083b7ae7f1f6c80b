"""Exact quantiles per group (linear interpolation between order statistics), at any group size.

The built-in ``percentile`` keeps the distinct values of a group in one buffer.  That is the right plan while a group
is known to be small.  Past ``DIRECT_ROWS`` the quantile is selected in rounds: cut at approximate quantiles, count rows
between the cuts exactly (partial aggregation), keep only the stretches that hold a wanted rank, and rank just the survivors.
The first round is over the rows as they come, so no task ever holds the distinct values of a large group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardlight.functions.scans import exclusive_running, null_safe_join
from wardlight.functions.sketches import quantiles_of, sketches_by
from wardlight.session import materialize

DIRECT_ROWS = 100_000
FIRST_LEVELS = 8  # the first round cuts a large group into 2 ** FIRST_LEVELS bins


def direct_quantiles(df: DataFrame, keys: Sequence[str], value: str, probs: dict[str, float], more: Sequence[Column] = ()) -> DataFrame:
    """Quantiles of groups known to be small, with further aggregates: one buffer per group for all quantiles."""
    wanted = F.percentile(value, F.array(*[F.lit(float(p)) for p in probs.values()])).alias("__quantiles")
    found = df.groupBy(*keys).agg(wanted, *more)
    names = [F.col("__quantiles")[i].alias(name) for i, name in enumerate(probs)]
    return found.select(*[F.col(c) for c in found.columns if c != "__quantiles"], *names)


def largest_group(df: DataFrame, keys: Sequence[str]) -> int:
    """Rows in the largest group: one partially aggregated count, one number to the driver."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"))
    return counts.agg(F.max("rows").alias("rows")).first()["rows"] or 0


def quantiles_by(
    df: DataFrame, keys: Sequence[str], value: str, probs: dict[str, float], group_rows: int | None = None, direct_rows: int = DIRECT_ROWS, sketch: int | None = None,
) -> DataFrame:
    """One row per group with the named quantiles of ``value``.

    ``group_rows`` is an upper bound on the rows of a group that the caller has proven (for example the number of
    runs); without it the largest group is counted first.  ``probs`` maps output names to probabilities.
    ``sketch`` gives approximate quantiles instead, from one pass with sketches of that size (see ``functions/sketches.py``).
    """
    if sketch is not None:
        return quantiles_of(sketches_by(df, keys, value, sketch), keys, probs)
    if group_rows is None:
        group_rows = largest_group(df, keys)
    if group_rows <= direct_rows:
        return direct_quantiles(df, keys, value, probs)
    return select_quantiles(df, keys, value, probs, direct_rows)


def _binned(df: DataFrame, value: Column, levels: int) -> DataFrame:
    """``__bin``: how many of the ``2 ** levels - 1`` rising numbers in ``__cuts`` are not above ``value``, by binary search; 0 without cuts."""
    df = df.withColumn("__bin", F.lit(0))
    for half in (2**i for i in reversed(range(levels))):
        df = df.withColumn("__bin", F.col("__bin") + F.when(F.get("__cuts", F.col("__bin") + F.lit(half - 1)) <= value, half).otherwise(0))
    return df


def _near_ranks(df: DataFrame, keys: Sequence[str], groups: DataFrame, rows: int, levels: int) -> DataFrame:
    """``df`` (keys, ``__v``) with ``__base``, without the rows of large groups that no wanted rank can be near.

    A group of more than ``rows`` rows is cut at approximate quantiles of its rows: two cuts that differ have few rows between them, whatever value many rows share. Only bins that
    hold a wanted rank stay, and ``__base`` is the rank at which a bin begins. There is one large group for ``rows`` rows at most, so a broadcast of these stays small; no row is moved.
    """
    large = materialize(groups.filter(F.col("__total") > rows).select(*keys, "__ranks"), "quantile-large")
    if large.isEmpty():
        return df.withColumn("__base", F.lit(0).cast("long"))
    pivots = 2**levels
    cuts = F.percentile_approx("__v", [i / pivots for i in range(1, pivots)], 1000)
    inside = null_safe_join(df, F.broadcast(large.select(*keys)), keys)
    large = materialize(null_safe_join(large, inside.groupBy(*keys).agg(cuts.alias("__cuts")), keys), "quantile-cuts")
    cells = _binned(null_safe_join(df, F.broadcast(large.select(*keys, "__cuts")), keys), F.col("__v"), levels)
    counts = exclusive_running(cells.groupBy(*keys, "__bin").agg(F.count(F.lit(1)).alias("__rows")), keys, ["__bin"], {"__before": ("sum", "__rows")})
    hit = F.exists("__ranks", lambda r: (r >= F.col("__before")) & (r < F.col("__before") + F.col("__rows")))
    edge = lambda i: F.get("__cuts", i)  # noqa: E731 - null before the first cut and after the last
    span = F.struct(edge(F.col("__bin") - 1).alias("low"), edge(F.col("__bin")).alias("high"), F.col("__before").alias("base"))
    spans = null_safe_join(counts, large, keys).filter(hit).groupBy(*keys).agg(F.collect_list(span).alias("__spans"))
    spans = materialize(spans, "quantile-spans")
    placed = null_safe_join(df, F.broadcast(spans), keys, "left")
    v = F.col("__v")
    own = F.filter("__spans", lambda s: (s["low"].isNull() | (s["low"] <= v)) & (s["high"].isNull() | (v < s["high"])))
    base = F.when(F.col("__spans").isNull(), F.lit(0).cast("long")).otherwise(F.get(own, F.lit(0))["base"])
    return placed.select(*keys, "__v", base.alias("__base")).filter(F.col("__base").isNotNull())


def select_quantiles(df: DataFrame, keys: Sequence[str], value: str, probs: dict[str, float], rows: int = DIRECT_ROWS, pivots: int = 64, levels: int = FIRST_LEVELS) -> DataFrame:
    """``quantiles_by`` without any group-sized buffer: bounded state per task whatever the group size or spread.

    The first round keeps the rows near the wanted ranks (``_near_ranks``). From then on values are cut at approximate quantiles of the distinct values, so every round leaves about
    1 in ``pivots`` of them however they are spread; rows are counted exactly between the cuts and only stretches that hold a wanted
    rank stay. Rounds go on until no stretch has more than ``rows`` distinct values. Groups of missing values only get nulls. ``df`` is evaluated up to four times.
    """
    keys = list(keys)
    groups = df.groupBy(*keys).agg(F.count(value).alias("__total"))
    position = {name: (F.col("__total") - 1) * F.lit(float(p)) for name, p in probs.items()}
    wanted = F.array_distinct(F.concat(*[F.array(F.floor(h), F.ceil(h)) for h in position.values()]))
    groups = materialize(groups.withColumn("__ranks", wanted), "quantile-groups")
    present = df.filter(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("__v"))
    near = _near_ranks(present, keys, groups, rows, levels)
    # equal values collapse to one row with a count, map side first
    freq = near.groupBy(*keys, "__base", "__v").agg(F.count(F.lit(1)).alias("__n"))
    stretches = materialize(null_safe_join(freq, groups.select(*keys, "__ranks"), keys).select(*keys, "__v", "__n", "__ranks", "__base"), "quantile-values")
    while True:
        cell = [*keys, "__base"]  # the rank at which a stretch begins names it
        largest = stretches.groupBy(*cell).count().agg(F.max("count").alias("n")).first()["n"] or 0
        if largest <= rows:
            break
        cuts = F.percentile_approx("__v", [i / pivots for i in range(1, pivots)], 1000)
        cells = null_safe_join(stretches, stretches.groupBy(*cell).agg(F.array_distinct(cuts).alias("__cuts")), cell)
        cells = cells.withColumn("__bin", F.size(F.filter("__cuts", lambda c: c <= F.col("__v")))).drop("__cuts")
        counts = cells.groupBy(*cell, "__bin").agg(F.sum("__n").alias("__rows"), F.first("__ranks").alias("__of"))
        counts = exclusive_running(counts, cell, ["__bin"], {"__before": ("sum", "__rows")})
        start = F.col("__base") + F.col("__before")
        hit = F.exists("__of", lambda r: (r >= start) & (r < start + F.col("__rows")))
        kept = counts.filter(hit).select(*cell, "__bin", start.alias("__new_base"))
        cells = null_safe_join(cells, kept, [*cell, "__bin"])
        stretches = materialize(cells.select(*keys, "__v", "__n", "__ranks", F.col("__new_base").alias("__base")), "quantile-values")

    running = Window.partitionBy(*keys, "__base").orderBy("__v").rowsBetween(Window.unboundedPreceding, 0)
    placed = stretches.withColumn("__end", F.col("__base") + F.sum("__n").over(running)).withColumn("__start", F.col("__end") - F.col("__n"))
    inside = F.filter("__ranks", lambda r: (r >= F.col("__start")) & (r < F.col("__end")))
    by_rank = placed.select(*keys, "__v", F.explode(inside).alias("__rank"))
    # at most two ranks per quantile and group from here on
    at = by_rank.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("__rank", "__v"))).alias("__at"))
    final = null_safe_join(groups.select(*keys, "__total"), at, keys, "left")

    def interpolate(h: Column) -> Column:
        low, high = F.try_element_at("__at", F.floor(h)), F.try_element_at("__at", F.ceil(h))
        # between equal neighbours nothing is added, so infinities and NaN stay what they are
        return F.when(low == high, low).otherwise(low + (h - F.floor(h)) * (high - low))

    return final.select(*keys, *[interpolate(h).alias(name) for name, h in position.items()])
