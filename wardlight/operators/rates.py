"""Monthly incidence rates and outbreak case counts from cumulative daily counters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wardlight.functions.scans import null_safe_join
from wardlight.operators.timeline import month_key
from wardlight.schema import RUN_KEYS
from wardlight.session import small_or_self

INFECTIONS = "total_hospital_infections"
OCCUPIED = "current_inpatients"


def monthly_parts(dated: DataFrame, keys: Sequence[str] = RUN_KEYS, counter: str = INFECTIONS, occupied: str = OCCUPIED, date: str = "date_sim") -> DataFrame:
    """Per group and month: last and first value of the counter, patient-days, days.

    All four combine before the shuffle (a run with a third of the rows sends one row per month and task), and combine
    again when groups are pooled later.
    """
    return dated.groupBy(*keys, month_key(date).alias("month")).agg(
        F.max(counter).alias("last"), F.min(counter).alias("first"), F.sum(occupied).alias("occupied"), F.count(F.lit(1)).alias("n_days")
    )


def pool_parts(parts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Parts of larger groups from the parts of smaller ones; without ``month`` in ``keys`` over all months."""
    return parts.groupBy(*keys).agg(F.max("last").alias("last"), F.min("first").alias("first"), F.sum("occupied").alias("occupied"), F.sum("n_days").alias("n_days"))


def rate_of_parts(parts: DataFrame, keys: Sequence[str], boundary: str = "month") -> DataFrame:
    """Infections per 1000 patient-days from monthly parts; see ``monthly_rate``."""
    first = F.col("first")
    if boundary == "carry":
        # one row per group and month: the window is as long as the calendar
        previous = F.lag("last").over(Window.partitionBy(*keys).orderBy("month"))
        first = F.coalesce(previous, first)
    elif boundary != "month":
        raise ValueError("boundary must be 'month' or 'carry'")
    rate = F.try_divide((F.col("last") - first).cast("double"), F.col("occupied").cast("double")) * 1000.0
    return parts.select(*keys, "month", rate.alias("rate"), "n_days")


def monthly_rate(
    dated: DataFrame, keys: Sequence[str] = RUN_KEYS, boundary: str = "month", counter: str = INFECTIONS, occupied: str = OCCUPIED, date: str = "date_sim"
) -> DataFrame:
    """Infections per 1000 patient-days for every run and month.

    The numerator is ``max - min`` of the cumulative counter.  ``boundary="month"`` takes both inside the month, so an
    increment between the last day of a month and the first of the next is not counted; ``boundary="carry"`` starts
    from the last value of the previous month.  A month without patient-days gets null.
    """
    return rate_of_parts(monthly_parts(dated, keys, counter, occupied, date), keys, boundary)


def mean_over_seeds(rates: DataFrame, keys: Sequence[str] = ("siminputrow",), skip_missing: bool = False) -> DataFrame:
    """Mean rate per parameter set (or per seed) and month.

    A month in which any run has no rate is missing, so that the set is masked later; ``skip_missing`` averages the others.
    """
    mean = F.avg("rate")
    return rates.groupBy(*keys, "month").agg((mean if skip_missing else F.when(F.count("rate") == F.count(F.lit(1)), mean)).alias("rate"))


def two_level_mean(rates: DataFrame, value: Sequence[str], seed: str = "random_seed") -> DataFrame:
    """Mean over months per (value, seed), then mean and sd over seeds per value."""
    per_seed = rates.groupBy(*value, seed).agg(F.avg("rate").alias("rate"))
    return per_seed.groupBy(*value).agg(F.avg("rate").alias("mean_rate"), F.stddev_samp("rate").alias("sd_rate"))


def outbreak_cases(windowed: DataFrame, keys: Sequence[str], counter: str = INFECTIONS) -> DataFrame:
    """Rise of the cumulative counter inside the window, per group.

    The largest value of ``counter - group minimum`` equals ``max - min``, so one aggregation is enough.
    """
    return windowed.groupBy(*keys).agg((F.max(counter) - F.min(counter)).alias("outbreak_cases"))


def first_per_key(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """The first row of every key by ``order`` (unique within a key), with all columns.

    ``min_by`` per column keeps the aggregation combinable before the shuffle; all columns come from the same row.
    """
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(*[F.min_by(c, order).alias(c) for c in rest])


def attach_parameters(attributes: DataFrame, rates: DataFrame, keys: Sequence[str] = RUN_KEYS) -> DataFrame:
    """Right join of run attributes (one row per run) to monthly rates."""
    return attributes.join(rates, list(keys), "right")


def with_group_minimum(df: DataFrame, keys: Sequence[str], column: str, out: str) -> DataFrame:
    """Every row with the minimum of its group.

    The minimum is aggregated and joined back instead of using a window: the aggregation combines before the shuffle,
    and a hot group is split by the adaptive skew join instead of landing in one window.
    """
    lowest = df.groupBy(*keys).agg(F.min(column).alias(out))
    return null_safe_join(df, small_or_self(lowest), list(keys))
