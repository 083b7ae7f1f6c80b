"""Posterior predictive checks and sensitivity curves from run output."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardlight.operators import rates, reshape, summary, timeline
from wardlight.plans.calibration import run_rates
from wardlight.session import materialize, small_or_self

OUTBREAK = ("2004-10-01", "2005-05-31")


def series_by_run(runs: DataFrame, keys: Sequence[str] = ("siminputrow",), dates: str = "auto") -> DataFrame:
    """Monthly series per parameter set (or per seed), with a row for every month that occurs in any run."""
    monthly = materialize(run_rates(runs, dates).select(*rates.RUN_KEYS, "month", "rate"), "run-rates")
    complete = reshape.complete_cells(monthly, rates.RUN_KEYS, "month", "rate")
    return rates.mean_over_seeds(complete, keys)


def predictive_check(runs: DataFrame, observed: DataFrame, dates: str = "auto", group_rows: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(band per month next to the observed series, summary before and during the outbreak of the simulated and of the observed rates)."""
    monthly = materialize(run_rates(runs, dates).select(*rates.RUN_KEYS, "month", "rate"), "run-rates")
    complete = reshape.complete_cells(monthly, rates.RUN_KEYS, "month", "rate")
    band = summary.series_table(summary.quantile_band(complete, ["month"], "rate", group_rows), observed)
    return band, summary.period_comparison(monthly, observed, "month", "rate", *OUTBREAK)


def sensitivity_parts(runs: DataFrame, posterior: DataFrame, dates: str = "auto") -> DataFrame:
    """Monthly parts of every run inside the outbreak step window, written once.

    The only pass over the daily rows.  Everything a sensitivity curve needs is a maximum, a minimum or a sum, so the
    varied value is joined to these reduced rows, not to the daily ones.
    """
    dated = timeline.assign_dates(timeline.drop_burn_in(runs), dates)
    inside = timeline.in_step_window(dated, timeline.step_window(posterior))
    return materialize(rates.monthly_parts(inside), "sensitivity-parts")


def pooled_rates(parts: DataFrame, levels: DataFrame, value: Sequence[str], seed: str = "random_seed") -> DataFrame:
    """Monthly rate per seed and value.  Sets that share a value are pooled, as the study groups by value."""
    keys = [seed, *value]
    joined = parts.join(small_or_self(levels), "siminputrow")
    return rates.rate_of_parts(rates.pool_parts(joined, [*keys, "month"]), keys)


def pooled_cases(parts: DataFrame, levels: DataFrame, value: Sequence[str], seed: str = "random_seed") -> DataFrame:
    """Outbreak cases (rise of the counter over the window) per seed and value."""
    joined = parts.join(small_or_self(levels), "siminputrow")
    pooled = rates.pool_parts(joined, [seed, *value])
    return pooled.select(seed, *value, (F.col("last") - F.col("first")).alias("outbreak_cases"))


def sensitivity_curves(parts: DataFrame, levels: DataFrame, value: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(mean and sd of the rate per value, mean and sd of the outbreak cases per value)."""
    curve = rates.two_level_mean(pooled_rates(parts, levels, value), value)
    cases = pooled_cases(parts, levels, value).groupBy(*value)
    return curve, cases.agg(F.avg("outbreak_cases").alias("mean_cases"), F.stddev_samp("outbreak_cases").alias("sd_cases"))
