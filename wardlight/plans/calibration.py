"""Two-stage calibration from run output to posterior, and the design of the next stage."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardlight.operators import abc, design, rates, timeline
from wardlight.operators.summary import mean_sd_band, quantile_band
from wardlight.session import materialize
from wardlight.sources import tables

# --- fixed values: stage settings ------------------------------------------------------------------------------
STAGE_ONE_BEFORE = "2004-10-01"
STAGE_ONE = {"samples": 800, "seeds": 3, "tol": 0.05}
STAGE_TWO = {"samples": 1000, "seeds": 3, "tol": 0.025}
OVERSAMPLE = 4
# --- end of fixed values ---------------------------------------------------------------------------------------


@dataclass
class Calibration:
    """``posterior``: accepted design rows with distance and rank.  ``rejection``: everything behind it."""

    rejection: abc.Rejection
    posterior: DataFrame

    def mean_band(self) -> DataFrame:
        return mean_sd_band(self.rejection.retained(), ["month"], "rate")

    def quantile_band(self) -> DataFrame:
        return quantile_band(self.rejection.retained(), ["month"], "rate", group_rows=self.rejection.k)


def run_rates(runs: DataFrame, dates: str = "auto", keys: Sequence[str] = rates.RUN_KEYS) -> DataFrame:
    """Monthly rate of every run, from raw run output."""
    return rates.monthly_rate(timeline.assign_dates(timeline.drop_burn_in(runs), dates, keys=keys), keys)


def monthly_statistics(runs: DataFrame, dates: str = "auto") -> DataFrame:
    """Summary statistics in the long form: mean monthly rate per parameter set."""
    return rates.mean_over_seeds(run_rates(runs, dates))


def calibrate(runs: DataFrame, parameters: DataFrame, observed: DataFrame, tol: float, before: str | None = None, dates: str = "auto") -> Calibration:
    """One calibration stage.

    ``before`` cuts the observed series (stage one: the months before the outbreak); without it the whole observed
    series is the target (stage two).
    """
    target = observed if before is None else timeline.before(observed, "month", before)
    rejection = abc.reject(monthly_statistics(runs, dates), target, tol)
    return Calibration(rejection, rejection.parameters(parameters))


def stage_two_priors(posterior: DataFrame, knobs: design.BoundKnobs | None = None, params: Sequence[str] | None = None, rows: int | None = None) -> DataFrame:
    """Priors of stage two: derived outbreak and control bounds, and the baseline quartiles. ``rows``: the accepted sets, if counted."""
    params = list(design.BASELINE_PRIORS) if params is None else list(params)
    return design.derived_priors(design.priors_from_posterior(posterior, params, rows), design.outbreak_rules(knobs or design.BoundKnobs()))


Generator = Callable[..., DataFrame]  # (prior table, samples, names, **options) -> one row per parameter set


def stage_two_names(params: Sequence[str] | None = None, knobs: design.BoundKnobs | None = None) -> list[str]:
    """The parameters of stage two: those of stage one, then the outbreak and control ones."""
    return [*(design.BASELINE_PRIORS if params is None else params), *[r.param for r in design.outbreak_rules(knobs or design.BoundKnobs())]]


def stage_two_design(
    priors: DataFrame, samples: int = STAGE_TWO["samples"], seeds: Sequence[int] = (), names: Sequence[str] | None = None, seed: int = 42, oversample: int = OVERSAMPLE,
    generator: Generator = design.design_from_table, uniform: design.Uniform | None = None,
) -> DataFrame:
    """Draw ``oversample`` times too many sets from a prior table, keep the plausible ones, take ``samples`` of them (numbered anew, 1 to ``samples``), cross with seeds.

    ``generator`` makes the draws (``design.lhs_from_table`` for a Latin hypercube); ``uniform`` replaces the hash uniforms of draws and sampling. Without ``seeds`` there is
    one row per set. Fails when fewer than ``samples`` sets are plausible.
    """
    drawn = materialize(generator(priors, samples * oversample, names or stage_two_names(), seed=seed, uniform=uniform), "stage-two-draws")
    order = uniform(F.col("siminputrow"), F.lit("sample")) if uniform else None
    kept = design.sample_rows(design.keep_plausible(drawn), samples, seed=seed, uniform=order, rank="__set")
    design_ = design.bind_constants(kept.drop("siminputrow").withColumnRenamed("__set", "siminputrow"), design.CONSTANTS)
    return design.cross_seeds(design_, seeds) if len(seeds) else design_


@dataclass
class TwoStage:
    """Both stages of a calibration: each one's result, the priors between them, and the design that they gave (one row per parameter set)."""

    one: Calibration
    priors: DataFrame
    design: DataFrame
    two: Calibration

    def write_posterior(self, path: str, names: Sequence[str] | None = None) -> None:
        """The accepted sets of stage two as a parameter file."""
        tables.write_param_file(self.two.posterior, names or stage_two_names(), path)


def two_stage(
    first_design: DataFrame, first: DataFrame, second: Callable[[DataFrame], DataFrame], observed: DataFrame, last: str | None = None, settings: tuple[Mapping, Mapping] = (STAGE_ONE, STAGE_TWO),
    knobs: design.BoundKnobs | None = None, params: Sequence[str] | None = None, generator: Generator = design.design_from_table, uniform: design.Uniform | None = None, seed: int = 42,
) -> TwoStage:
    """Calibrate, derive priors from what was accepted, draw the next design, calibrate again.

    ``first``: monthly statistics (siminputrow, month, rate) of the sets in ``first_design``. ``second`` is called with the drawn design and gives the monthly
    statistics of its sets: that is where simulations are run or stored output is read. Stage one sees the observed months before the outbreak, stage two all up to ``last``.
    """
    one_rejection = abc.reject(first, timeline.before(observed, "month", STAGE_ONE_BEFORE), settings[0]["tol"])
    one = Calibration(one_rejection, one_rejection.parameters(first_design))
    priors = materialize(stage_two_priors(one.posterior, knobs, params, one_rejection.k), "stage-two-priors")
    drawn = materialize(stage_two_design(priors, settings[1]["samples"], (), stage_two_names(params, knobs), seed, generator=generator, uniform=uniform), "stage-two-design")
    target = observed if last is None else observed.filter(F.col("month") <= F.to_date(F.lit(last)))
    two_rejection = abc.reject(second(drawn), target, settings[1]["tol"])
    return TwoStage(one, priors, drawn, Calibration(two_rejection, two_rejection.parameters(drawn)))


def uniform_design(
    posterior: DataFrame, params: Sequence[str], samples: int, seeds: Sequence[int], seed: int = 42, generator: Generator = design.design_from_table, uniform: design.Uniform | None = None
) -> DataFrame:
    """Design of the uniform-prior simulations: draws from mean ± sd."""
    drawn = generator(design.uniform_around_mean(posterior, params), samples, params, seed=seed, uniform=uniform)
    return design.cross_seeds(design.bind_constants(drawn, design.CONSTANTS), seeds)


def mean_design(posterior: DataFrame, params: Sequence[str], seeds: Sequence[int]) -> DataFrame:
    """Design of the mean-parameter simulations: one row of posterior means per seed."""
    one = design.fix_all_but(posterior, params, []).withColumn("siminputrow", F.lit(1).cast("long"))
    return design.cross_seeds(design.bind_constants(one, design.CONSTANTS), seeds)


def predictive_design(spark: SparkSession, posterior: DataFrame, samples: int, seed: int = 42, uniform: design.Uniform | None = None) -> DataFrame:
    """Design of the predictive check: posterior rows drawn with replacement, each with its own seed. ``uniform`` replaces the hash uniforms of the draws."""
    draws = design.bootstrap_draws(spark, samples, seed)
    drawn = design.bootstrap(posterior, draws.withColumn("u", uniform(F.col("draw"), F.lit("bootstrap"))) if uniform else draws)
    return drawn.drop("u", "siminputrow", "distance", "accept_rank").withColumnRenamed("draw", "siminputrow")
