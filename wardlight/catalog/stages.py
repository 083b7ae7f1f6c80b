"""Queries over prior tables, design generators and the whole two-stage calibration."""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from wardlight.catalog.blocks import BLOCKS, abc_blocks, block, real, with_blocks
from wardlight.catalog.designs import POSTERIOR, derived_priors_sql
from wardlight.catalog.fits import _target
from wardlight.catalog.registry import Registry
from wardlight.catalog.series import _stats
from wardlight.functions import sketches
from wardlight.functions.qfun import register_vector_qfun
from wardlight.functions.uniform import named_uniform
from wardlight.operators import design
from wardlight.plans import calibration
from wardlight.plans.calibration import run_rates
from wardlight.session import materialize, scratch_path
from wardlight.sources import derived, tables

SEEDS = [11, 23, 47]
BASELINE = list(design.BASELINE_PRIORS)
SETS = 100  # of the uniform-prior and of the predictive simulations


def _logistic(p: pd.Series, location: float = 0.0, scale: float = 1.0) -> np.ndarray:
    return (location + scale * (np.log(p) - np.log1p(-p))).to_numpy()


register_vector_qfun("logistic", _logistic)


def _prior_table(spark, sf):
    """Mean ± sd of the posterior columns, as a table."""
    return design.uniform_around_mean(derived.posterior(spark, sf), POSTERIOR)


def b1_draw_table(spark, sf):
    """As many draws as there are parts from each row of a prior table."""
    return design.draw_table(_prior_table(spark, sf), derived.table(spark, sf, "part").count(), uniform=named_uniform)


def b2_vector_quantiles(spark, sf):
    """A quantile function of the user's own, given as a vectorised function: each supplier's balance and key are its fields."""
    priors = derived.table(spark, sf, "supplier").select(
        F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("param"), F.when(F.col("s_suppkey") % 3 == 0, "logistic").otherwise("qunif").alias("qfun"),
        F.col("s_acctbal").cast("double").alias("location"), (1.0 + F.col("s_suppkey") % 7).alias("scale"), F.lit(0.0).alias("min"), F.col("s_nationkey").cast("double").alias("max"),
    )
    return design.draw_table(priors, 20, uniform=lambda row, param: (named_uniform(row, param) + 0.001) / 1.01, vectors=["logistic"])


def b6_lhs_from_table(spark, sf):
    drawn = design.lhs_from_table(_prior_table(spark, sf), derived.table(spark, sf, "supplier").count() * 10, POSTERIOR, uniform=named_uniform)
    return drawn.select("siminputrow", *POSTERIOR)


def r3_uniform_design(spark, sf):
    """The design behind the uniform-prior simulations."""
    return calibration.uniform_design(derived.posterior(spark, sf), POSTERIOR, SETS, SEEDS, uniform=named_uniform)


def r5_predictive_design(spark, sf):
    """The design behind the predictive check: posterior rows drawn with replacement."""
    posterior = derived.posterior(spark, sf).select((F.col("siminputrow") + 1).alias("accept_rank"), F.lit(0.0).alias("distance"), "siminputrow", *POSTERIOR)
    return calibration.predictive_design(spark, posterior, SETS, uniform=named_uniform).drop("seed_value")


def _first_design(spark, sf):
    """Stage one's design: draws from the study's priors for every parameter set of the run table."""
    rows = derived.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("siminputrow"))
    return design.draw(rows, design.BASELINE_PRIORS, lambda n: named_uniform(F.col("siminputrow"), n))


def _two_stage(spark, sf):
    stats = materialize(_stats(spark, sf), "statistics")
    return calibration.two_stage(
        _first_design(spark, sf), stats, lambda drawn: stats.join(drawn.select("siminputrow"), "siminputrow", "left_semi"), _target(stats), "2008-05-01", uniform=named_uniform)


def r7_two_stage(spark, sf):
    """Daily rows to stage one's accepted sets, their quartiles to stage two's priors, draws from these to the plausible sampled design, by seed."""
    return design.cross_seeds(_two_stage(spark, sf).design, SEEDS)


def r7_two_stage_posterior(spark, sf):
    """What stage two accepts of the sets drawn from stage one's posterior."""
    names = calibration.stage_two_names()
    return _two_stage(spark, sf).two.posterior.select("siminputrow", "accept_rank", *names)


def r2_posterior_file(spark, sf):
    """Stage two's posterior written as a parameter file and read back."""
    path = scratch_path(spark, "posterior-file")
    _two_stage(spark, sf).write_posterior(path)
    return tables.param_long(tables.read_param_file(spark, path))


def a2_clustered_runs(spark, sf):
    """Monthly rates from runs that are stored clustered by run."""
    name, path = f"runs_{uuid.uuid4().hex}", scratch_path(spark, "clustered-runs")
    # a bucket for each partition that derived.runs deals its runs to
    tables.write_clustered_runs(derived.runs(spark, sf), name, path, int(spark.conf.get("spark.sql.shuffle.partitions")), dealt=True)
    stored = spark.table(name)
    rates_ = run_rates(stored, "gapless")
    spark.sql(f"DROP TABLE {name}")  # the plan has resolved it; its files stay
    return rates_


def e7_sketch_band(spark, sf):
    """Quantiles of the monthly rates from sketches by experiment and month that were stored and merged over experiments: their ranks among the true values."""
    k = 1_000
    monthly = materialize(run_rates(derived.runs(spark, sf), "gapless").withColumn("part", F.col("siminputrow") % 4), "run-rates")
    stored = materialize(sketches.sketches_by(monthly, ["part", "month"], "rate", k), "sketches")
    probs = {"q_low": 0.25, "m": 0.5, "q_high": 0.75}
    found = sketches.quantiles_of(sketches.merge_sketches(stored, ["month"], k), ["month"], probs)
    long_ = found.unpivot(["month"], list(probs), "name", "value")
    p = F.when(F.col("name") == "q_low", 0.25).when(F.col("name") == "m", 0.5).otherwise(0.75)
    ranked = monthly.filter(F.col("rate").isNotNull()).join(long_, "month").groupBy("month", "name").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("rate") < F.col("value")).alias("below"), F.count_if(F.col("rate") <= F.col("value")).alias("up_to"))
    slack = F.col("n") * sketches.rank_error(k) * 2 + 1
    return ranked.select("month", "name", "n", ((F.col("below") <= p * F.col("n") + slack) & (F.col("up_to") >= p * F.col("n") - slack)).alias("within"))


def _md5_uniform(row: str, label: str) -> str:
    return f"(('0x' || substr(md5({row} || ':' || {label}), 1, 8))::BIGINT / {real(float(2**32))})"


def _unif(u: str) -> str:
    return f"ROUND(min + {u} * (max - min), 3)"


def _wide(names: list[str]) -> str:
    return ", ".join(f"MAX(value) FILTER (WHERE param = '{n}') AS {n}" for n in names)


def register_blocks() -> None:
    if "stage_two_design" in BLOCKS:
        return
    names = calibration.stage_two_names()
    block("prior_table", "SELECT param, mean - sd AS min, mean + sd AS max FROM posterior_summary", "posterior_summary")
    columns = ", ".join(
        f"ROUND({real(float(p['min']))} + {_md5_uniform('s_suppkey', repr(n))} * ({real(float(p['max']))} - {real(float(p['min']))}), 3) AS {n}" for n, p in design.BASELINE_PRIORS.items()
    )
    block("stage_one_design", f"SELECT s_suppkey AS siminputrow, {columns} FROM supplier")
    block("stage_one_long", f"SELECT param, value FROM (SELECT d.* FROM stage_one_design d JOIN pre_accepted a ON a.siminputrow = d.siminputrow) UNPIVOT (value FOR param IN ({', '.join(BASELINE)}))", "stage_one_design", "pre_accepted")
    block("b", "SELECT param, QUANTILE_CONT(value, 0.25) AS min, QUANTILE_CONT(value, 0.75) AS max, AVG(value) AS mean, STDDEV_SAMP(value) AS sd FROM stage_one_long GROUP BY 1", "stage_one_long")
    block("stage_two_priors", derived_priors_sql(), "b")
    drawn = calibration.STAGE_TWO["samples"] * calibration.OVERSAMPLE
    block(
        "stage_two_draws",
        f"SELECT i + 1 AS siminputrow, {_wide(names)} FROM (SELECT i, param, {_unif(_md5_uniform('(i + 1)', 'param'))} AS value FROM stage_two_priors, range({drawn}) g(i)) t GROUP BY 1", "stage_two_priors",
    )
    plausible = " AND ".join(f"o_{n} >= {n}" for n in design.CONSTRAINED)
    block(
        "stage_two_design",
        f"""SELECT * EXCLUDE (rn, siminputrow), rn AS siminputrow FROM (SELECT *, ROW_NUMBER() OVER (ORDER BY {_md5_uniform('siminputrow', "'sample'")}, siminputrow) AS rn FROM stage_two_draws WHERE {plausible}) t
        WHERE rn <= {calibration.STAGE_TWO['samples']}""", "stage_two_draws",
    )
    abc_blocks("two", f"s.month <= DATE '2008-05-01' AND s.siminputrow BETWEEN 1 AND {calibration.STAGE_TWO['samples']}")
    block(
        "two_accepted",
        f"""SELECT * FROM (SELECT siminputrow, distance, ROW_NUMBER() OVER (ORDER BY distance, siminputrow) AS accept_rank FROM two_distance) r
        WHERE accept_rank <= (SELECT CAST(CEIL(COUNT(*) * {real(calibration.STAGE_TWO['tol'])}) AS BIGINT) FROM two_distance)""", "two_distance",
    )


def register(r: Registry) -> None:
    register_blocks()
    names = calibration.stage_two_names()
    constants = ", ".join(f"CAST({v} AS {'INTEGER' if isinstance(v, int) else 'DOUBLE'}) AS {k}" for k, v in design.CONSTANTS.items())
    reals = [k for k, v in design.CONSTANTS.items() if isinstance(v, float)]
    seeds = f"(SELECT CAST(s AS BIGINT) AS random_seed FROM (VALUES {', '.join(f'({s})' for s in SEEDS)}) v(s)) seeds"
    r.add(
        "b1_draw_table", b1_draw_table,
        with_blocks(f"SELECT i + 1 AS siminputrow, param, {_unif(_md5_uniform('(i + 1)', 'param'))} AS value FROM prior_table, range((SELECT COUNT(*) FROM part)) g(i)", "prior_table"), ["value"],
    )
    u = f"(({_md5_uniform('(i + 1)', 'param')} + {real(0.001)}) / {real(1.01)})"
    r.add(
        "b2_vector_quantiles", b2_vector_quantiles,
        f"""SELECT i + 1 AS siminputrow, param, ROUND(CASE WHEN k % 3 = 0 THEN CAST(s_acctbal AS DOUBLE) + (1 + k % 7) * (LN({u}) - LN(1 - {u})) ELSE {u} * s_nationkey END, 3) AS value
        FROM (SELECT 's' || s_suppkey AS param, s_suppkey AS k, s_acctbal, s_nationkey FROM supplier) t, range(20) g(i)""", ["value"],
    )
    r.add(
        "b6_lhs_from_table", b6_lhs_from_table,
        with_blocks(
            f"""SELECT siminputrow, {_wide(POSTERIOR)} FROM (SELECT siminputrow, param, {_unif('(ROW_NUMBER() OVER (PARTITION BY param ORDER BY u, siminputrow) - 1 + u) / COUNT(*) OVER (PARTITION BY param)')} AS value
            FROM (SELECT i + 1 AS siminputrow, param, min, max, {_md5_uniform('(i + 1)', 'param')} AS u FROM prior_table, range((SELECT COUNT(*) * 10 FROM supplier)) g(i)) t) q GROUP BY 1""", "prior_table"),
        POSTERIOR,
    )
    r.add(
        "r3_uniform_design", r3_uniform_design,
        with_blocks(
            f"""SELECT d.*, {constants}, random_seed FROM (SELECT i + 1 AS siminputrow, {_wide(POSTERIOR)} FROM (SELECT i, param, {_unif(_md5_uniform('(i + 1)', 'param'))} AS value FROM prior_table, range({SETS}) g(i)) t GROUP BY 1) d
            CROSS JOIN {seeds}""", "prior_table"), [*POSTERIOR, *reals],
    )
    r.add(
        "r5_predictive_design", r5_predictive_design,
        with_blocks(
            f"""SELECT i + 1 AS siminputrow, {', '.join(f'p.{n}' for n in POSTERIOR)} FROM range({SETS}) g(i)
            JOIN posterior p ON p.siminputrow = CAST(FLOOR({_md5_uniform('(i + 1)', "'bootstrap'")} * (SELECT COUNT(*) FROM posterior)) AS BIGINT)""", "posterior"), POSTERIOR,
    )
    r.add("a2_clustered_runs", a2_clustered_runs, with_blocks("SELECT * FROM monthly", "monthly"), ["rate"])
    r.add(
        "e7_sketch_band", e7_sketch_band,
        with_blocks("SELECT month, name, n, TRUE AS within FROM (SELECT month, COUNT(rate) AS n FROM monthly WHERE rate IS NOT NULL GROUP BY 1) t CROSS JOIN (VALUES ('q_low'), ('m'), ('q_high')) v(name)", "monthly"),
    )
    r.add("r7_two_stage", r7_two_stage, with_blocks(f"SELECT d.*, {constants}, random_seed FROM stage_two_design d CROSS JOIN {seeds}", "stage_two_design"), [*names, *reals])
    accepted = f"SELECT a.siminputrow, a.accept_rank, {', '.join(f'd.{n}' for n in names)} FROM two_accepted a JOIN stage_two_design d ON d.siminputrow = a.siminputrow"
    r.add("r7_two_stage_posterior", r7_two_stage_posterior, with_blocks(accepted, "two_accepted", "stage_two_design"), names)
    r.add(
        "r2_posterior_file", r2_posterior_file,
        with_blocks(f"SELECT param, accept_rank, value FROM (SELECT * FROM ({accepted}) a) UNPIVOT (value FOR param IN ({', '.join(names)}))", "two_accepted", "stage_two_design"), ["value"],
    )
