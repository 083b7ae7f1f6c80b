"""Queries over experiment designs and priors."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from wardlight.catalog.blocks import real, with_blocks
from wardlight.catalog.registry import Registry
from wardlight.functions import qfun
from wardlight.functions.uniform import hash_uniform
from wardlight.operators import design
from wardlight.operators.reshape import pivot_longer
from wardlight.sources import derived

SEEDS = [11, 23, 47]
PAIR = {
    "toilet_cleaning_rate": {"min": 0.5, "max": 3.0, "mean": 1.0, "sd": 0.2, "qfun": "qunif"},
    "side_room_delay_mean": {"min": 0.01, "max": 7.0},
}
UNIFORM_OF = {"toilet_cleaning_rate": "u1", "side_room_delay_mean": "u2"}
BASELINE = list(design.BASELINE_PRIORS)
POSTERIOR = list(derived.POSTERIOR_COLUMNS)


def _draws(spark, sf):
    return derived.uniforms(spark, sf).withColumnRenamed("row_id", "siminputrow")


def b1_design_random(spark, sf):
    """Hash-based draws for every row, checked by count, bounds, rounding and mean."""
    drawn = design.draw(_draws(spark, sf), design.BASELINE_PRIORS, lambda n: hash_uniform(F.col("siminputrow"), 42, n))
    tall = pivot_longer(drawn, [], BASELINE, "param", "value")
    low = F.create_map(*[F.lit(x) for n, p in design.BASELINE_PRIORS.items() for x in (n, float(p["min"]))])
    high = F.create_map(*[F.lit(x) for n, p in design.BASELINE_PRIORS.items() for x in (n, float(p["max"]))])
    scaled = (F.col("value") - low[F.col("param")]) / (high[F.col("param")] - low[F.col("param")])
    checked = tall.withColumn("u", scaled)
    return checked.groupBy("param").agg(
        F.count(F.lit(1)).alias("n"), F.count_if((F.col("u") > -0.01) & (F.col("u") < 1.01)).alias("in_bounds"),
        F.count_if(F.abs(F.col("value") * 1000 - F.round(F.col("value") * 1000)) < 1e-6).alias("rounded"),
        # five standard errors of a uniform mean
        (F.abs(F.avg("u") - 0.5) < 5.0 / F.sqrt(12.0 * F.count(F.lit(1)))).alias("mean_fits"),
    )


def b1_design_random_rows(spark, sf):
    """The drawn design itself."""
    return design.draw(_draws(spark, sf), design.BASELINE_PRIORS, lambda n: hash_uniform(F.col("siminputrow"), 42, n)).drop("u1", "u2")


def b1_design_from_uniforms(spark, sf):
    return design.draw(_draws(spark, sf), PAIR, lambda n: F.col(UNIFORM_OF[n])).drop("u1", "u2")


def b2_normal_quantiles(spark, sf):
    draws = derived.uniforms(spark, sf)
    return draws.select("row_id", qfun.apply_qfun(F.col("u1"), {"qfun": "qnorm", "mean": 1.0, "sd": 2.0}).alias("x"), qfun.apply_qfun(F.col("u2") * 1e-9, {"qfun": "qnorm"}).alias("far"))


def _normal_sql(p: str) -> str:
    """The normal quantile in SQL from the same coefficients."""
    def ratio(r, parts):
        above, below = (reduce(lambda acc, c: f"({acc}) * {r} + {real(c)}", part[1:], real(part[0])) for part in parts)
        return f"({above}) / ({below})"

    q, r = f"({p} - {real(0.5)})", f"sqrt(-ln(least({p}, 1 - {p})))"
    tail = f"CASE WHEN {r} <= 5 THEN {ratio(f'({r} - {real(1.6)})', qfun.TAIL)} ELSE {ratio(f'({r} - 5)', qfun.FAR_TAIL)} END"
    return f"CASE WHEN {p} <= 0 THEN CAST('-inf' AS DOUBLE) WHEN abs({q}) <= {real(0.425)} THEN {q} * {ratio(f'({real(0.180625)} - {q} * {q})', qfun.CENTRE)} ELSE sign({q}) * ({tail}) END"


def b2_quantile_functions(spark, sf):
    specs = {
        "toilet_cleaning_rate": {"qfun": "qexp", "rate": 2.0, "mean": 9.0},
        "side_room_delay_mean": {"qfun": "qunif", "min": 1.0, "max": 2.0, "sd": 9.0},
    }
    return design.draw(_draws(spark, sf), specs, lambda n: F.col(UNIFORM_OF[n])).drop("u1", "u2")


def b3_precision(spark, sf):
    value = F.col("p_size") * 0.125 + 0.0625 * 2
    parts = derived.table(spark, sf, "part").select("p_partkey", F.round(value, 2).alias("half_up"), F.bround(value, 2).alias("half_even"), F.round(value, 3).alias("three"))
    return parts


def b4_constants(spark, sf):
    bound = design.bind_constants(derived.design(spark, sf), {**design.CONSTANTS, "outbreak": False})
    return bound.withColumns({"wards_total": F.col("wards_total").cast("long"), "bedspaces_per_ward": F.col("bedspaces_per_ward").cast("long")})


def b5_design_by_seed(spark, sf):
    return design.cross_seeds(derived.design(spark, sf), SEEDS)


def b6_latin_hypercube(spark, sf):
    return design.design_lhs(_draws(spark, sf), PAIR, UNIFORM_OF)


def b7_zip_values(spark, sf):
    grid = {"c_prescription": design.linspace(0.01, 0.99, 10), "c_cleaning": design.linspace(F.col("toilet_cleaning_rate"), 4.0, 10)}
    return design.zip_values(derived.design(spark, sf), grid).select("siminputrow", "position", "c_prescription", "c_cleaning")


def b8_mean_design(spark, sf):
    from wardlight.plans.calibration import mean_design

    one = mean_design(derived.posterior(spark, sf), BASELINE, SEEDS)
    return one.withColumns({"wards_total": F.col("wards_total").cast("long"), "bedspaces_per_ward": F.col("bedspaces_per_ward").cast("long")})


def b9_linspace(spark, sf):
    per_nation = derived.table(spark, sf, "supplier").groupBy("s_nationkey").agg(F.min("s_acctbal").alias("low"), F.max("s_acctbal").alias("high"))
    values = design.linspace(F.col("low"), F.col("high"), 1 + F.col("s_nationkey") % 7)
    return per_nation.select(F.col("s_nationkey").cast("long").alias("nation"), F.posexplode(values).alias("i", "value")).withColumn("i", F.col("i").cast("long"))


def b10_factorial(spark, sf):
    levels = {"bay_proportion": design.stepped(0.0, 0.1, 1.0), "wards_total": F.array(F.lit(4).cast("long"), F.lit(24).cast("long"))}
    return design.design_factorial(derived.design(spark, sf).select("siminputrow", "toilet_cleaning_rate"), levels)


def b11_keep_plausible(spark, sf):
    wanted = [c for name in design.CONSTRAINED for c in (name, f"o_{name}")]
    return design.keep_plausible(derived.full_posterior(spark, sf).select("siminputrow", *wanted))


def b12_sample_rows(spark, sf):
    draws = derived.uniforms(spark, sf)
    return design.sample_rows(draws, draws.count() // 4, key="row_id", uniform="u1")


def b13_bootstrap(spark, sf):
    indexed = derived.posterior(spark, sf).select((F.col("siminputrow") + 1).alias("accept_rank"), "toilet_cleaning_rate", "antibiotic_effect")
    draws = derived.uniforms(spark, sf).select(F.col("row_id").alias("draw"), F.col("u2").alias("u"))
    return design.bootstrap(indexed, draws).drop("u")


def b14_priors_from_posterior(spark, sf):
    return design.priors_from_posterior(derived.posterior(spark, sf), POSTERIOR)


def b15_derived_priors(spark, sf):
    priors = design.priors_from_posterior(derived.posterior(spark, sf), BASELINE)
    return design.derived_priors(priors, design.outbreak_rules(design.BoundKnobs()))


def b16_time_triggers(spark, sf):
    orders = derived.table(spark, sf, "orders").groupBy("o_custkey").agg(F.to_date(F.min("o_orderdate")).alias("first"), F.to_date(F.max("o_orderdate")).alias("last"))
    triggers = design.time_triggers(orders, "1995-01-01", F.col("first"), F.date_add("first", 45), F.col("last"))
    return triggers.drop("first", "last")


def b17_uniform_around_mean(spark, sf):
    return design.uniform_around_mean(derived.posterior(spark, sf), POSTERIOR)


def b18_fix_all_but(spark, sf):
    return design.fix_all_but(derived.posterior(spark, sf), POSTERIOR, ["c_antibiotic_prescription_rate", "antibiotic_effect"], {"toilet_cleaning_effect": 1.0})


def derived_priors_sql() -> str:
    """The priors of stage two from a table ``b`` of the baseline parameters (param, min, max, mean, sd)."""
    a = design.CONSTANTS["antibiotic_prescription_rate"]

    def from_source(param: str, source: str, low: str, high: str) -> str:
        return f"SELECT '{param}' AS param, {low} AS min, {high} AS max, NULL AS mean, NULL AS sd FROM b WHERE param = '{source}'"

    def const(param: str, low: float, high: float) -> str:
        return f"SELECT '{param}', {real(low)}, {real(high)}, NULL, NULL"

    rows = [
        "SELECT param, min, max, mean, sd FROM b",
        from_source("o_toilet_frequenting_rate", "toilet_frequenting_rate", "min", "2 * mean"),
        from_source("o_toilet_contamination_effect", "toilet_contamination_effect", "min", f"LEAST({real(0.99)}, 2 * mean)"),
        from_source("o_toilet_cleaning_effect", "toilet_cleaning_effect", f"GREATEST({real(0.01)}, mean - mean)", "max"),
        from_source("o_toilet_cleaning_rate", "toilet_cleaning_rate", real(0.5), "max"),
        from_source("o_community_colonisation_rate", "community_colonisation_rate", "min", "2 * mean"),
        from_source("c_toilet_cleaning_effect", "toilet_cleaning_effect", "min", real(0.99)),
        from_source("c_toilet_cleaning_rate", "toilet_cleaning_rate", "min", "2 * mean"),
        const("o_antibiotic_prescription_rate", a, min(0.99, a + a)),
        const("c_antibiotic_prescription_rate", 0.01, a),
        const("o_side_room_delay_mean", 0.01, 7.0),
        const("c_side_room_delay_mean", 0.01, 7.0),
        const("outbreak_start", 914.0, 1094.0),
        const("outbreak_end", 1156.0, 1336.0),
        const("control_end", 1306.0, 1366.0),
    ]
    return " UNION ALL ".join(rows)


def register(r: Registry) -> None:
    def unif(u: str, lo: float, hi: float) -> str:
        return f"ROUND({real(lo)} + {u} * ({real(hi)} - {real(lo)}), 3)"

    names = ", ".join(f"('{n}')" for n in BASELINE)
    r.add(
        "b1_design_random", b1_design_random,
        f"SELECT param, n, n AS in_bounds, n AS rounded, TRUE AS mean_fits FROM (VALUES {names}) v(param) CROSS JOIN (SELECT COUNT(*) AS n FROM part) c",
    )
    r.add("b1_design_random_rows", b1_design_random_rows)
    pair = list(PAIR)
    r.add(
        "b1_design_from_uniforms", b1_design_from_uniforms,
        with_blocks(f"SELECT row_id AS siminputrow, {unif('u1', 0.5, 3.0)} AS {pair[0]}, {unif('u2', 0.01, 7.0)} AS {pair[1]} FROM uniforms", "uniforms"), pair,
    )
    r.add(
        "b2_normal_quantiles", b2_normal_quantiles,
        with_blocks(f"SELECT row_id, 1 + 2 * ({_normal_sql('u1')}) AS x, {_normal_sql('t')} AS far FROM (SELECT *, u2 * CAST('1e-9' AS DOUBLE) AS t FROM uniforms)", "uniforms"), ["x", "far"],
    )
    r.add(
        "b2_quantile_functions", b2_quantile_functions,
        with_blocks(f"SELECT row_id AS siminputrow, ROUND(-ln(1 - u1) / 2, 3) AS {pair[0]}, {unif('u2', 1.0, 2.0)} AS {pair[1]} FROM uniforms", "uniforms"), pair,
    )
    value = f"(p_size * {real(0.125)} + {real(0.125)})"
    r.add("b3_precision", b3_precision, f"SELECT p_partkey, ROUND({value}, 2) AS half_up, round_even({value}, 2) AS half_even, ROUND({value}, 3) AS three FROM part", ["half_up", "half_even", "three"])
    c = design.CONSTANTS
    constants = ", ".join(f"CAST({v} AS {'BIGINT' if isinstance(v, int) else 'DOUBLE'}) AS {k}" for k, v in c.items())
    reals = [k for k, v in c.items() if isinstance(v, float)]
    params = ["toilet_cleaning_rate", "community_colonisation_rate", "o_community_colonisation_rate"]
    r.add("b4_constants", b4_constants, with_blocks(f"SELECT *, {constants}, FALSE AS outbreak FROM design", "design"), [*params, *reals])
    seeds = ", ".join(f"({s})" for s in SEEDS)
    seed_table = f"(SELECT CAST(s AS BIGINT) AS random_seed FROM (VALUES {seeds}) v(s)) seeds"
    r.add("b5_design_by_seed", b5_design_by_seed, with_blocks(f"SELECT design.*, random_seed FROM design CROSS JOIN {seed_table}", "design"), params)

    def stratified(u: str, lo: float, hi: float) -> str:
        return unif(f"((ROW_NUMBER() OVER (ORDER BY {u}, row_id) - 1 + {u}) / COUNT(*) OVER ())", lo, hi)

    r.add(
        "b6_latin_hypercube", b6_latin_hypercube,
        with_blocks(f"SELECT row_id AS siminputrow, {stratified('u1', 0.5, 3.0)} AS {pair[0]}, {stratified('u2', 0.01, 7.0)} AS {pair[1]} FROM uniforms", "uniforms"), pair,
    )
    r.add(
        "b7_zip_values", b7_zip_values,
        with_blocks(
            f"""SELECT siminputrow, i + 1 AS position, {real(0.01)} + i * ({real(0.99)} - {real(0.01)}) / 9 AS c_prescription,
            toilet_cleaning_rate + i * (4 - toilet_cleaning_rate) / 9 AS c_cleaning FROM design CROSS JOIN range(10) g(i)""", "design"),
        ["c_prescription", "c_cleaning"],
    )
    means = ", ".join(f"AVG({p}) AS {p}" for p in BASELINE)
    r.add(
        "b8_mean_design", b8_mean_design,
        with_blocks(f"SELECT m.*, CAST(1 AS BIGINT) AS siminputrow, {constants}, random_seed FROM (SELECT {means} FROM posterior) m CROSS JOIN {seed_table}", "posterior"), [*BASELINE, *reals],
    )
    r.add(
        "b9_linspace", b9_linspace,
        """SELECT nation, i, low + i * (high - low) / GREATEST(n - 1, 1) AS value FROM
        (SELECT CAST(s_nationkey AS BIGINT) AS nation, MIN(s_acctbal) AS low, MAX(s_acctbal) AS high, 1 + s_nationkey % 7 AS n FROM supplier GROUP BY s_nationkey) t
        JOIN range(7) g(i) ON g.i < t.n""", ["value"],
    )
    r.add(
        "b10_factorial", b10_factorial,
        with_blocks(
            f"""SELECT siminputrow, toilet_cleaning_rate, i * {real(0.1)} AS bay_proportion, CAST(w AS BIGINT) AS wards_total
            FROM design CROSS JOIN range(11) g(i) CROSS JOIN (VALUES (4), (24)) v(w)""", "design"), ["toilet_cleaning_rate", "bay_proportion"],
    )
    limited = [c for name in design.CONSTRAINED for c in (name, f"o_{name}")]
    r.add("b11_keep_plausible", b11_keep_plausible, with_blocks(
        f"SELECT siminputrow, {', '.join(limited)} FROM full_posterior WHERE " + " AND ".join(f"o_{n} >= {n}" for n in design.CONSTRAINED), "full_posterior"), limited)
    r.add(
        "b12_sample_rows", b12_sample_rows,
        with_blocks("SELECT row_id, u1, u2 FROM (SELECT *, ROW_NUMBER() OVER (ORDER BY u1, row_id) AS rn FROM uniforms) t WHERE rn <= (SELECT COUNT(*) // 4 FROM part)", "uniforms"), ["u1", "u2"],
    )
    r.add(
        "b13_bootstrap", b13_bootstrap,
        with_blocks(
            """SELECT p.siminputrow + 1 AS accept_rank, u.row_id AS draw, p.toilet_cleaning_rate, p.antibiotic_effect FROM uniforms u
            JOIN posterior p ON p.siminputrow = CAST(FLOOR(u.u2 * (SELECT COUNT(*) FROM posterior)) AS BIGINT)""", "uniforms", "posterior"), ["toilet_cleaning_rate", "antibiotic_effect"],
    )
    r.add(
        "b14_priors_from_posterior", b14_priors_from_posterior,
        with_blocks("SELECT param, q25 AS min, q75 AS max, mean, sd, mean - sd AS lower_sd, mean + sd AS upper_sd, 'qunif' AS qfun FROM posterior_summary", "posterior_summary"),
        ["min", "max", "mean", "sd", "lower_sd", "upper_sd"],
    )
    names_in = ", ".join(f"'{n}'" for n in BASELINE)
    base = f"SELECT param, q25 AS min, q75 AS max, mean, sd FROM posterior_summary WHERE param IN ({names_in})"
    union = derived_priors_sql()
    r.add(
        "b15_derived_priors", b15_derived_priors,
        with_blocks(f"SELECT param, min, max, mean, sd, 'qunif' AS qfun FROM (WITH b AS ({base}) {union}) t", "posterior_summary"), ["min", "max", "mean", "sd"],
    )
    r.add(
        "b16_time_triggers", b16_time_triggers,
        """SELECT o_custkey, date_diff('day', DATE '1995-01-01', CAST(MIN(o_orderdate) AS DATE)) AS outbreak_start, date_diff('day', DATE '1995-01-01', CAST(MIN(o_orderdate) AS DATE)) + 45 AS control_start,
        date_diff('day', DATE '1995-01-01', CAST(MAX(o_orderdate) AS DATE)) AS outbreak_end, date_diff('day', DATE '1995-01-01', CAST(MAX(o_orderdate) AS DATE)) + 90 AS control_end
        FROM orders GROUP BY 1""",
    )
    r.add("b17_uniform_around_mean", b17_uniform_around_mean, with_blocks("SELECT param, mean - sd AS min, mean + sd AS max, 'qunif' AS qfun FROM posterior_summary", "posterior_summary"), ["min", "max"])
    kept = [p for p in POSTERIOR if p not in ("c_antibiotic_prescription_rate", "antibiotic_effect")]
    fixed = ", ".join(f"{real(1.0)} AS {p}" if p == "toilet_cleaning_effect" else f"AVG({p}) AS {p}" for p in kept)
    r.add("b18_fix_all_but", b18_fix_all_but, with_blocks(f"SELECT {fixed} FROM posterior", "posterior"), kept)
