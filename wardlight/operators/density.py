"""Gaussian kernel densities per parameter and period, on a fixed grid.

Samples are first spread linearly over a fixed number of bins (a combinable aggregation), then the bins, not the
samples, are smoothed.  The work after the first aggregation depends on the grid size only, however many samples there
are; it is also how the usual statistical density routine computes its curve.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wardlight.functions.scans import null_safe_join
from wardlight.operators.summary import describe_by
from wardlight.session import small_or_self

GRID = 512
SLICE = 32


def bandwidths(samples: DataFrame, keys: Sequence[str], value: str = "value", group_rows: int | None = None) -> DataFrame:
    """Rule-of-thumb bandwidth ``0.9 * min(sd, IQR / 1.34) * n^(-1/5)``; falls back to sd, then 1, when a spread is 0.

    Result: keys, ``n``, ``min``, ``max``, ``bw``.
    """
    stats = describe_by(samples, keys, value, {"q25": 0.25, "q75": 0.75}, ["sd", "n", "min", "max"], group_rows)
    iqr = (F.col("q75") - F.col("q25")) / 1.34
    sd = F.coalesce(F.col("sd"), F.lit(0.0))
    spread = F.when(F.least(sd, iqr) > 0.0, F.least(sd, iqr)).when(sd > 0.0, sd).otherwise(F.lit(1.0))
    return stats.select(*keys, "n", "min", "max", (0.9 * spread * F.pow(F.col("n").cast("double"), F.lit(-0.2))).alias("bw"))


def densities(
    samples: DataFrame, facet: Sequence[str], keys: Sequence[str], value: str = "value", grid: int = GRID, group_rows: int | None = None
) -> DataFrame:
    """Density of ``value`` per group at ``grid`` points over the range of its facet, scaled to a maximum of 1.

    ``facet`` (a subset of ``keys``) gives the shared range, e.g. one parameter across periods.  Result: keys, ``i``
    (grid index), ``x``, ``density``, ``scaled``.
    """
    facet, keys = list(facet), list(keys)
    shape = small_or_self(bandwidths(samples, keys, value, group_rows))
    ranges = shape.groupBy(*facet).agg(F.min("min").alias("__from"), F.max("max").alias("__to"))
    shape = null_safe_join(shape.drop("min", "max"), ranges, facet)
    low, high = F.col("__from") - 4.0 * F.col("bw"), F.col("__to") + 4.0 * F.col("bw")
    # one row per group: held small when it is
    shape = small_or_self(shape.withColumns({"__low": low, "__delta": (high - low) / float(grid - 1)}))

    # each sample gives 1 - f to the bin on its left and f to the bin on its right
    at = (F.col(value) - F.col("__low")) / F.col("__delta")
    cells = null_safe_join(samples.select(*keys, value), shape.select(*keys, "__low", "__delta"), keys)
    cells = cells.withColumn("__at", at).withColumn("__bin", F.floor("__at"))
    share = F.col("__at") - F.col("__bin")
    left = cells.groupBy(*keys, "__bin").agg(F.sum(1.0 - share).alias("__here"), F.sum(share).alias("__next"))
    halves = F.array(F.struct(F.col("__bin").alias("bin"), F.col("__here").alias("w")), F.struct((F.col("__bin") + 1).alias("bin"), F.col("__next").alias("w")))
    weights = left.select(*keys, F.explode(halves).alias("h")).select(*keys, "h.bin", "h.w")

    # at most two weights for each of `grid` bins per group: one array per group, spread over the tasks by slices of the grid
    packed = weights.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("bin", "w"))).alias("__bins"))
    slices = null_safe_join(shape, packed, keys).withColumn("__slice", F.explode(F.sequence(F.lit(0), F.lit((grid - 1) // SLICE))))
    slices = slices.repartition(samples.sparkSession.sparkContext.defaultParallelism, *keys, "__slice")
    first = F.col("__slice") * SLICE
    points = slices.withColumn("i", F.explode(F.sequence(first, F.least(first + SLICE - 1, F.lit(grid - 1)))))
    points = points.withColumn("x", F.col("__from") + F.col("i") * (F.col("__to") - F.col("__from")) / float(grid - 1))

    def smooth(centre):
        def add(total, b):
            z = (centre - b["bin"]) * F.col("__delta") / F.col("bw")
            return total + b["w"] * F.exp(-0.5 * z * z)

        return F.aggregate("__bins", F.lit(0.0), add)

    # the curve is evaluated at bin centres and interpolated linearly to the grid point
    where = (F.col("x") - F.col("__low")) / F.col("__delta")
    points = points.withColumn("__where", where).withColumn("__left", F.floor("__where"))
    points = points.withColumns({"__y0": smooth(F.col("__left")), "__y1": smooth(F.col("__left") + 1)})
    norm = F.col("n") * F.col("bw") * math.sqrt(2.0 * math.pi)
    height = (F.col("__y0") + (F.col("__where") - F.col("__left")) * (F.col("__y1") - F.col("__y0"))) / norm
    curve = points.select(*keys, "i", "x", height.alias("density"))
    peak = F.max("density").over(Window.partitionBy(*keys))
    return curve.withColumn("scaled", F.col("density") / peak)
