"""Rejection approximate Bayesian computation on the long form ``(siminputrow, month, rate)``.

The month is the join key between statistics and target, so nothing depends on column order.  Intermediate tables
that several steps read are written once to the shared folder.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wardlight.functions.quantiles import quantiles_by
from wardlight.functions.scans import take_smallest
from wardlight.session import materialize, small_or_self

MAD_SCALE = 1.4826


@dataclass
class Rejection:
    """Result of one rejection step.

    ``accepted``: siminputrow, distance, accept_rank.  ``distances``: every set.  ``scale``: month, target, median,
    mad.  ``statistics``: the prepared long statistics.  ``n`` sets were compared, ``k`` accepted.
    """

    accepted: DataFrame
    distances: DataFrame
    scale: DataFrame
    statistics: DataFrame
    n: int
    k: int

    def parameters(self, design: DataFrame) -> DataFrame:
        """Accepted rows of the design table, with distance and rank."""
        return design.join(small_or_self(self.accepted), "siminputrow")

    def retained(self) -> DataFrame:
        """Unscaled statistics of the accepted sets, indexed by rank: ``i``, month, rate, ``type``."""
        ranks = small_or_self(self.accepted.select("siminputrow", F.col("accept_rank").alias("i")))
        kept = self.statistics.join(ranks, "siminputrow")
        return kept.select("siminputrow", "i", "month", "rate", F.lit("sim").alias("type"))


def accepted_count(n: int, tol: float) -> int:
    return math.ceil(n * tol)


def align(statistics: DataFrame, target: DataFrame, months: int) -> DataFrame:
    """Statistics with the target of their month and a completeness flag per parameter set.

    One shuffle, by ``siminputrow``; a set has at most one row per month, so the window stays small.  Every row of a
    set carries ``complete``: whether all ``months`` target months are present and not null.
    """
    joined = statistics.select("siminputrow", "month", "rate").join(target, "month")
    per_set = Window.partitionBy("siminputrow")
    return joined.withColumn("complete", F.count("rate").over(per_set) == months)


def month_alignment(statistics: DataFrame, target: DataFrame) -> DataFrame:
    """Months of either side: ``sets`` with a rate in the statistics, and whether the month is ``wanted`` by the target."""
    have = statistics.groupBy("month").agg(F.count("rate").alias("sets"))
    both = have.join(target.select("month", F.lit(True).alias("wanted")), "month", "full")
    return both.select("month", F.coalesce("sets", F.lit(0).cast("long")).alias("sets"), F.coalesce("wanted", F.lit(False)).alias("wanted"))


def mad_scale(aligned: DataFrame, n: int | None = None) -> DataFrame:
    """Per month: target, median and ``mad = 1.4826 * median(|x - median|)`` over the complete sets.

    ``n`` bounds the rows of a month (number of sets).
    """
    complete = aligned.filter("complete")
    middle = small_or_self(quantiles_by(complete, ["month", "target"], "rate", {"median": 0.5}, group_rows=n))
    spread = complete.join(middle.drop("target"), "month").withColumn("deviation", F.abs(F.col("rate") - F.col("median")))
    mad = quantiles_by(spread, ["month", "target", "median"], "deviation", {"raw": 0.5}, group_rows=n)
    return mad.select("month", "target", "median", (F.lit(MAD_SCALE) * F.col("raw")).alias("mad"))


def scaled_distances(aligned: DataFrame, scale: DataFrame) -> DataFrame:
    """Euclidean distance of every set to the target, each month divided by its mad (unscaled when the mad is 0).

    A set with a missing month gets null here, as do all sets when none is complete.
    """
    unit = F.when(F.col("mad") == 0.0, F.lit(1.0)).otherwise(F.col("mad"))
    term = (F.col("rate") - F.col("target")) / unit
    joined = aligned.join(small_or_self(scale.select("month", "mad")), "month", "left")
    total = joined.groupBy("siminputrow").agg(F.sum(term * term).alias("total"), F.bool_and("complete").alias("complete"))
    return total.select("siminputrow", F.when(F.col("complete"), F.sqrt("total")).alias("distance"))


def rank_incomplete_last(distances: DataFrame) -> DataFrame:
    """Sets with a missing statistic get a distance above every complete one: ``floor(max + 10)``."""
    beyond = F.coalesce(distances.agg(F.floor(F.max("distance") + 10.0).cast("double")).scalar(), F.lit(0.0))
    return distances.withColumn("distance", F.coalesce(F.col("distance"), beyond))


def accept(distances: DataFrame, tol: float, n: int | None = None, topk_rows: int | None = None) -> DataFrame:
    """The nearest ``ceil(n * tol)`` sets; ties at the cut go to the lower ``siminputrow``."""
    n = distances.count() if n is None else n
    extra = {} if topk_rows is None else {"topk_rows": topk_rows}
    return take_smallest(distances, "distance", "siminputrow", accepted_count(n, tol), rank="accept_rank", **extra)


def reject(statistics: DataFrame, target: DataFrame, tol: float) -> Rejection:
    """Distance of every parameter set to the target series, and the accepted sets.

    Fails when a target month has no statistic at all.
    """
    wanted = small_or_self(target.select("month", F.col("rate").alias("target")))
    months = wanted.count()
    aligned = materialize(align(statistics, wanted, months), "abc-aligned")
    sets = [r["count"] for r in aligned.groupBy("month").count().collect()]  # one row per target month
    if len(sets) < months:
        raise ValueError(f"{months - len(sets)} target months have no statistic")
    scale = small_or_self(mad_scale(aligned, max(sets, default=0)))
    distances = materialize(scaled_distances(aligned, scale), "abc-distances")
    n = distances.count()
    distances = rank_incomplete_last(distances)
    return Rejection(accept(distances, tol, n), distances, scale, aligned, n, accepted_count(n, tol))
