"""Queries over run output: sources, timelines, rates, joins, bands."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardlight.catalog.blocks import PRE, real, with_blocks
from wardlight.catalog.registry import Registry
from wardlight.functions.scans import position_in_group
from wardlight.operators import rates, summary, timeline
from wardlight.plans import checks
from wardlight.plans.calibration import monthly_statistics, run_rates
from wardlight.session import scratch_path, small_or_self
from wardlight.sources import derived, tables

KEYS = rates.RUN_KEYS


def _dated(spark: SparkSession, sf: str) -> DataFrame:
    # derived.runs has every day of every run
    return timeline.assign_dates(timeline.drop_burn_in(derived.runs(spark, sf)), "gapless")


def _rates(spark: SparkSession, sf: str) -> DataFrame:
    return run_rates(derived.runs(spark, sf), "gapless")


def _stats(spark: SparkSession, sf: str) -> DataFrame:
    return monthly_statistics(derived.runs(spark, sf), "gapless")


def _run_bound(spark: SparkSession, sf: str) -> int:
    """Upper bound on the number of runs: parameter sets x seeds."""
    return derived.table(spark, sf, "supplier").count() * 3


def _observed(spark: SparkSession, sf: str) -> DataFrame:
    return _stats(spark, sf).groupBy("month").agg(F.avg("rate").alias("rate"))


def a1_read_observed(spark, sf):
    month_number = F.months_between("month", F.to_date(F.lit("2002-01-01")))
    series = _observed(spark, sf).select((month_number + 0.957).alias("x"), F.round("rate", 4).alias("rates"))
    path = scratch_path(spark, "observed")
    tables.write_observed(series, path)
    return tables.read_observed(spark, path)


def a2_write_read_runs(spark, sf):
    path = scratch_path(spark, "runs")
    tables.write_runs(derived.runs(spark, sf), path, dealt=True)
    counters = ["total_colonised", "total_patients_admitted", "total_hospital_infections"]
    return tables.read_runs(spark, path).groupBy("experiment", *KEYS).agg(
        F.count(F.lit(1)).alias("rows"), *[F.max(c).alias(c) for c in counters],
        F.sum("current_inpatients").alias("inpatients"), F.sum("current_colonised").alias("colonised"),
    )


def c1_burn_in(spark, sf):
    kept = timeline.drop_burn_in(derived.runs(spark, sf))
    return kept.groupBy("experiment", *KEYS).agg(F.count(F.lit(1)).alias("rows"), F.min("step").cast("long").alias("first_step"), F.max("total_patients_admitted").alias("admitted"))


def c2_assign_dates(spark, sf):
    """Runs with gaps: the date follows the position in the run, not the step."""
    return timeline.assign_dates(timeline.drop_burn_in(derived.sparse_runs(spark, sf)), "position").select(*KEYS, F.col("step").cast("long").alias("step"), "date_sim")


def c2_assign_dates_stretches(spark, sf):
    """Runs with a gap of some days (by run, every third run has none): dates from their stretches."""
    rows = derived.runs(spark, sf).filter((F.col("siminputrow") % 3 == 0) | (F.pmod(F.col("step") + F.col("siminputrow") * 7, F.lit(900)) > 40))
    return timeline.assign_dates(timeline.drop_burn_in(rows), "stretches").groupBy(*KEYS, F.trunc("date_sim", "MM").alias("month")).agg(
        F.min("step").cast("long").alias("first_step"), F.max("step").cast("long").alias("last_step"), F.count(F.lit(1)).alias("rows"))


def c2_assign_dates_auto(spark, sf):
    """Runs without gaps: the check finds none and no row is shuffled for the dates."""
    dated = timeline.assign_dates(timeline.drop_burn_in(derived.runs(spark, sf)), "auto")
    return dated.groupBy(*KEYS).agg(F.min("date_sim").alias("first_date"), F.max("date_sim").alias("last_date"), F.count(F.lit(1)).alias("rows"))


def c3_calendar_split(spark, sf):
    days = derived.table(spark, sf, "orders").select(F.to_date("o_orderdate").alias("date_sim"))
    split = timeline.calendar_split(days)
    return split.groupBy(F.col("year").cast("long").alias("year"), "month").agg(F.count(F.lit(1)).alias("rows"))


def c4_date_from_parts(spark, sf):
    parts = timeline.calendar_split(derived.table(spark, sf, "orders").select(F.to_date("o_orderdate").alias("date_sim")))
    parts = parts.withColumn("plain_month", F.month("date_sim"))
    both = timeline.date_from_parts(timeline.date_from_parts(parts, out="from_padded"), month="plain_month", out="from_plain")
    return both.groupBy("from_padded", "from_plain").agg(F.count(F.lit(1)).alias("rows"))


def c5_calendar_filters(spark, sf):
    monthly = _rates(spark, sf)
    observed = _observed(spark, sf).filter(F.col("month") < "2008-06-01")
    parts = {
        "before": timeline.before(monthly, "month", "2004-10-01"),
        "up_to_last": timeline.up_to_last(monthly, "month", observed, "month"),
        "within": timeline.within(monthly, "month", "2004-10-01", "2005-05-31"),
    }
    counted = [df.groupBy("month").agg(F.count(F.lit(1)).alias("rows"), F.avg("rate").alias("rate")).withColumn("filter", F.lit(n)) for n, df in parts.items()]
    return counted[0].unionByName(counted[1]).unionByName(counted[2])


def c6_step_window(spark, sf):
    window = timeline.step_window(derived.posterior(spark, sf))
    inside = timeline.in_step_window(timeline.drop_burn_in(derived.runs(spark, sf)), window)
    return inside.groupBy(*KEYS).agg(F.min("step").cast("long").alias("step_from"), F.max("step").cast("long").alias("step_to"), F.count(F.lit(1)).alias("rows"))


def d1_right_join(spark, sf):
    kept = timeline.drop_burn_in(derived.runs(spark, sf)).select(*KEYS, "step", "total_patients_admitted", "current_inpatients")
    attributes = rates.first_per_key(kept, KEYS, "step").select(*KEYS, F.col("total_patients_admitted").alias("first_admitted"), F.col("current_inpatients").alias("first_inpatients"))
    return rates.attach_parameters(attributes, _rates(spark, sf)).drop("n_days")


def d4_zip_target(spark, sf):
    """Statistics next to the target of the same month (a month key instead of a position)."""
    return _stats(spark, sf).join(small_or_self(_observed(spark, sf).withColumnRenamed("rate", "target")), "month")


def _outbreak_parts(spark, sf):
    """Monthly parts of every run inside the outbreak window: the daily rows are reduced before anything is joined."""
    window = timeline.step_window(derived.posterior(spark, sf))
    return rates.monthly_parts(timeline.in_step_window(_dated(spark, sf), window))


def e3_windowed_rate(spark, sf):
    return checks.pooled_rates(_outbreak_parts(spark, sf), derived.sensitivity_design(spark, sf), ["arm", "level"]).drop("n_days")


def e4_two_level_mean(spark, sf):
    pooled = checks.pooled_rates(rates.monthly_parts(_dated(spark, sf)), derived.sensitivity_design(spark, sf), ["level"])
    return rates.two_level_mean(pooled, ["level"])


def e5_outbreak_cases(spark, sf):
    return checks.pooled_cases(_outbreak_parts(spark, sf), derived.sensitivity_design(spark, sf), ["arm", "level"])


def e6_mean_sd_band(spark, sf):
    return summary.mean_sd_band(_stats(spark, sf), ["month"], "rate")


def e7_quantile_band(spark, sf):
    return summary.quantile_band(_rates(spark, sf), ["month"], "rate", group_rows=_run_bound(spark, sf))


def e7_quantile_band_selected(spark, sf):
    """Quantiles of large groups, selected in rounds without a group-sized buffer."""
    from wardlight.functions.quantiles import select_quantiles

    lines = derived.table(spark, sf, "lineitem").select("l_returnflag", "l_linestatus", "l_extendedprice")
    return select_quantiles(lines, ["l_returnflag", "l_linestatus"], "l_extendedprice", {"q_low": 0.25, "m": 0.5, "q_high": 0.75, "q99": 0.99})


def e8_period_summary(spark, sf):
    return summary.period_summary(_rates(spark, sf), "month", "rate", "2004-10-01", "2005-05-31")


def e11_ratio_of_counts(spark, sf):
    orders = derived.stays(spark, sf).withColumn("colonised", F.col("community_infection") | F.col("hospital_infection_date").isNotNull())
    return summary.ratio_of_counts(orders, ["ward"], F.col("colonised")).withColumn("ward", F.col("ward").cast("long"))


def f1_position_in_run(spark, sf):
    return position_in_group(derived.sparse_runs(spark, sf), KEYS, "step", width=512).select(*KEYS, F.col("step").cast("long").alias("step"), "position")


def f2_group_minimum(spark, sf):
    rows = rates.with_group_minimum(derived.sparse_runs(spark, sf), KEYS, "current_inpatients", "lowest")
    return rows.select(*KEYS, F.col("step").cast("long").alias("step"), (F.col("current_inpatients") - F.col("lowest")).alias("above_lowest"))


def h1_first_per_key(spark, sf):
    first = rates.first_per_key(timeline.drop_burn_in(derived.sparse_runs(spark, sf)), KEYS, "step")
    return first.withColumn("step", F.col("step").cast("long"))


def s2_head(spark, sf):
    """The six busiest runs (a top-k report)."""
    monthly = _rates(spark, sf).groupBy(*KEYS).agg(F.sum("rate").alias("total"))
    return monthly.orderBy(F.desc(F.round("total", 6)), *KEYS).limit(6)


def a2_read_simulator_csv(spark, sf):
    """All runs exported under the simulator's hyphenated names and read back."""
    path = scratch_path(spark, "simulator-csv")
    tables.write_simulator_csv(derived.runs(spark, sf).drop("experiment"), path)
    back = tables.read_simulator_csv(spark, path, "from_csv")
    return back.groupBy("experiment", *KEYS).agg(
        F.count(F.lit(1)).alias("rows"), F.max("total_colonised").alias("total_colonised"), F.sum("current_inpatients").alias("inpatients"), F.sum("current_colonised").alias("colonised")
    )


def e2_mean_over_seeds_missing(spark, sf):
    """Some runs have months without a rate, as a month without patient-days gives: the set's month is missing then."""
    known = (F.col("siminputrow") * 3 + F.col("random_seed") + F.month("month")) % 11 != 0
    return rates.mean_over_seeds(_rates(spark, sf).withColumn("rate", F.when(known, F.col("rate"))))


def register(r: Registry) -> None:
    doubles = ["rate"]
    r.add(
        "a1_read_observed", a1_read_observed,
        with_blocks(f"SELECT month, ROUND(rate, 4) AS rate, date_diff('month', DATE '2002-01-01', month) + {real(0.957)} AS x FROM observed", "observed"), ["rate", "x"],
    )
    r.add(
        "a2_read_simulator_csv", a2_read_simulator_csv,
        with_blocks(
            """SELECT 'from_csv' AS experiment, siminputrow, random_seed, COUNT(*) AS rows, MAX(total_colonised) AS total_colonised, SUM(current_inpatients) AS inpatients,
            CAST(SUM(current_colonised) AS BIGINT) AS colonised FROM runs GROUP BY 2, 3""", "runs"), ["inpatients"],
    )
    r.add(
        "a2_write_read_runs", a2_write_read_runs,
        with_blocks(
            """SELECT experiment, siminputrow, random_seed, COUNT(*) AS rows, MAX(total_colonised) AS total_colonised, MAX(total_patients_admitted) AS total_patients_admitted,
            MAX(total_hospital_infections) AS total_hospital_infections, SUM(current_inpatients) AS inpatients, CAST(SUM(current_colonised) AS BIGINT) AS colonised
            FROM runs GROUP BY 1, 2, 3""", "runs"), ["inpatients"],
    )
    r.add(
        "c1_burn_in", c1_burn_in,
        with_blocks("SELECT experiment, siminputrow, random_seed, COUNT(*) AS rows, CAST(MIN(step) AS BIGINT) AS first_step, MAX(total_patients_admitted) AS admitted FROM runs WHERE step > 31 GROUP BY 1, 2, 3", "runs"),
    )
    r.add(
        "c2_assign_dates", c2_assign_dates,
        with_blocks(
            """SELECT siminputrow, random_seed, CAST(step AS BIGINT) AS step, CAST(DATE '2002-01-01' + CAST(ROW_NUMBER() OVER (PARTITION BY siminputrow, random_seed ORDER BY step) - 1 AS INTEGER) AS DATE) AS date_sim
            FROM sparse WHERE step > 31""", "sparse"),
    )
    r.add(
        "c2_assign_dates_stretches", c2_assign_dates_stretches,
        with_blocks(
            """SELECT siminputrow, random_seed, CAST(date_trunc('month', d) AS DATE) AS month, CAST(MIN(step) AS BIGINT) AS first_step, CAST(MAX(step) AS BIGINT) AS last_step, COUNT(*) AS rows FROM
            (SELECT siminputrow, random_seed, step, DATE '2002-01-01' + CAST(ROW_NUMBER() OVER (PARTITION BY siminputrow, random_seed ORDER BY step) - 1 AS INTEGER) AS d FROM runs
             WHERE step > 31 AND (siminputrow % 3 = 0 OR (step + siminputrow * 7) % 900 > 40)) t GROUP BY 1, 2, 3""", "runs"),
    )
    r.add(
        "c2_assign_dates_auto", c2_assign_dates_auto,
        with_blocks("SELECT siminputrow, random_seed, MIN(date_sim) AS first_date, MAX(date_sim) AS last_date, COUNT(*) AS rows FROM dated GROUP BY 1, 2", "dated"),
    )
    r.add("c3_calendar_split", c3_calendar_split, "SELECT year(o_orderdate) AS year, lpad(CAST(month(o_orderdate) AS VARCHAR), 2, '0') AS month, COUNT(*) AS rows FROM orders GROUP BY 1, 2")
    r.add(
        "c4_date_from_parts", c4_date_from_parts,
        "SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS from_padded, CAST(date_trunc('month', o_orderdate) AS DATE) AS from_plain, COUNT(*) AS rows FROM orders GROUP BY 1, 2",
    )
    parts = {"before": f"month < {PRE}", "up_to_last": "month <= (SELECT MAX(month) FROM observed WHERE month < DATE '2008-06-01')", "within": f"month BETWEEN {PRE} AND DATE '2005-05-31'"}
    r.add(
        "c5_calendar_filters", c5_calendar_filters,
        with_blocks(" UNION ALL ".join(f"SELECT month, COUNT(*) AS rows, AVG(rate) AS rate, '{n}' AS filter FROM monthly WHERE {c} GROUP BY 1" for n, c in parts.items()), "monthly", "observed"), doubles,
    )
    window = """(SELECT CAST(round_even(LEAST(AVG(outbreak_start), AVG(outbreak_end), AVG(control_end)), 0) AS INTEGER) AS step_from,
        CAST(round_even(GREATEST(AVG(outbreak_start), AVG(outbreak_end), AVG(control_end)), 0) AS INTEGER) AS step_to FROM posterior)"""
    r.add(
        "c6_step_window", c6_step_window,
        with_blocks(
            f"""SELECT siminputrow, random_seed, CAST(MIN(step) AS BIGINT) AS step_from, CAST(MAX(step) AS BIGINT) AS step_to, COUNT(*) AS rows
            FROM runs JOIN {window} w ON step > 31 AND step >= w.step_from AND step <= w.step_to GROUP BY 1, 2""", "runs", "posterior"),
    )
    r.add(
        "d1_right_join", d1_right_join,
        with_blocks(
            """SELECT m.siminputrow, m.random_seed, a.first_admitted, a.first_inpatients, m.month, m.rate FROM
            (SELECT siminputrow, random_seed, arg_min(total_patients_admitted, step) AS first_admitted, arg_min(current_inpatients, step) AS first_inpatients FROM runs WHERE step > 31 GROUP BY 1, 2) a
            RIGHT JOIN monthly m ON a.siminputrow = m.siminputrow AND a.random_seed = m.random_seed""", "runs", "monthly"), ["rate", "first_inpatients"],
    )
    r.add("d4_zip_target", d4_zip_target, with_blocks("SELECT s.siminputrow, s.month, s.rate, o.rate AS target FROM stats s JOIN observed o ON o.month = s.month", "stats", "observed"), ["rate", "target"])
    r.add("e1_monthly_rate", lambda s, d: _rates(s, d), with_blocks("SELECT * FROM monthly", "monthly"), doubles)
    r.add(
        "e1_monthly_rate_carry", lambda s, d: rates.monthly_rate(_dated(s, d), boundary="carry"),
        with_blocks(
            """SELECT siminputrow, random_seed, month, (last - COALESCE(LAG(last) OVER (PARTITION BY siminputrow, random_seed ORDER BY month), first)) / occupied * 1000 AS rate, n_days
            FROM (SELECT siminputrow, random_seed, CAST(date_trunc('month', date_sim) AS DATE) AS month, MAX(total_hospital_infections) AS last, MIN(total_hospital_infections) AS first,
            SUM(current_inpatients) AS occupied, COUNT(*) AS n_days FROM dated GROUP BY 1, 2, 3) t""", "dated"), doubles,
    )
    r.add("e2_mean_over_seeds", lambda s, d: _stats(s, d), with_blocks("SELECT * FROM stats", "stats"), doubles)
    gap = "(siminputrow * 3 + random_seed + month(month)) % 11 = 0"
    r.add(
        "e2_mean_over_seeds_missing", e2_mean_over_seeds_missing,
        with_blocks(f"SELECT siminputrow, month, CASE WHEN COUNT(*) FILTER (WHERE {gap}) = 0 THEN AVG(rate) END AS rate FROM monthly GROUP BY 1, 2", "monthly"), ["rate"],
    )
    r.add("e2_mean_by_seed", lambda s, d: rates.mean_over_seeds(_rates(s, d), ["random_seed"]), with_blocks("SELECT random_seed, month, AVG(rate) AS rate FROM monthly GROUP BY 1, 2", "monthly"), doubles)
    windowed = f"""SELECT d.random_seed, s.arm, s.level, d.date_sim, d.step, d.total_hospital_infections, d.current_inpatients
        FROM dated d JOIN {window} w ON d.step >= w.step_from AND d.step <= w.step_to JOIN sensitivity s ON s.siminputrow = d.siminputrow"""
    rate = "(MAX(total_hospital_infections) - MIN(total_hospital_infections)) / SUM(current_inpatients) * 1000 AS rate"
    month = "CAST(date_trunc('month', date_sim) AS DATE) AS month"
    r.add("e3_windowed_rate", e3_windowed_rate, with_blocks(f"SELECT random_seed, arm, level, {month}, {rate} FROM ({windowed}) t GROUP BY 1, 2, 3, 4", "dated", "posterior", "sensitivity"), ["rate", "level"])
    r.add(
        "e4_two_level_mean", e4_two_level_mean,
        with_blocks(
            f"""SELECT level, AVG(rate) AS mean_rate, STDDEV_SAMP(rate) AS sd_rate FROM (SELECT level, random_seed, AVG(rate) AS rate FROM
            (SELECT random_seed, level, {month}, {rate} FROM dated JOIN sensitivity USING (siminputrow) GROUP BY 1, 2, 3) a GROUP BY 1, 2) b GROUP BY 1""", "dated", "sensitivity"),
        ["level", "mean_rate", "sd_rate"],
    )
    r.add(
        "e5_outbreak_cases", e5_outbreak_cases,
        with_blocks(
            f"""SELECT random_seed, arm, level, MAX(above) AS outbreak_cases FROM (SELECT random_seed, arm, level,
            total_hospital_infections - MIN(total_hospital_infections) OVER (PARTITION BY random_seed, arm, level) AS above FROM ({windowed}) t) u GROUP BY 1, 2, 3""", "dated", "posterior", "sensitivity"),
        ["level"],
    )
    r.add(
        "e6_mean_sd_band", e6_mean_sd_band,
        with_blocks("SELECT month, AVG(rate) AS mean, STDDEV_SAMP(rate) AS sd, AVG(rate) - STDDEV_SAMP(rate) AS lower, AVG(rate) + STDDEV_SAMP(rate) AS upper FROM stats GROUP BY 1", "stats"),
        ["mean", "sd", "lower", "upper"],
    )
    band = "QUANTILE_CONT({v}, 0.25) AS q_low, MEDIAN({v}) AS m, QUANTILE_CONT({v}, 0.75) AS q_high"
    r.add("e7_quantile_band", e7_quantile_band, with_blocks(f"SELECT month, {band.format(v='rate')} FROM monthly GROUP BY 1", "monthly"), ["q_low", "m", "q_high"])
    r.add(
        "e7_quantile_band_selected", e7_quantile_band_selected,
        f"SELECT l_returnflag, l_linestatus, {band.format(v='l_extendedprice')}, QUANTILE_CONT(l_extendedprice, 0.99) AS q99 FROM lineitem GROUP BY 1, 2", ["q_low", "m", "q_high", "q99"],
    )
    r.add(
        "e8_period_summary", e8_period_summary,
        with_blocks(
            f"""SELECT period, QUANTILE_CONT(rate, 0.25) AS q_low, MEDIAN(rate) AS median, QUANTILE_CONT(rate, 0.75) AS q_high, MIN(rate) AS min, MAX(rate) AS max, AVG(rate) AS mean, COUNT(rate) AS n FROM
            (SELECT CASE WHEN month < {PRE} THEN 'pre_outbreak' WHEN month <= DATE '2005-05-31' THEN 'outbreak' END AS period, rate FROM monthly) t WHERE period IS NOT NULL GROUP BY 1""", "monthly"),
        ["q_low", "median", "q_high", "min", "max", "mean"],
    )
    colonised = "community_infection OR hospital_infection_date IS NOT NULL"
    r.add(
        "e11_ratio_of_counts", e11_ratio_of_counts,
        with_blocks(f"SELECT CAST(ward AS BIGINT) AS ward, COUNT(*) FILTER (WHERE {colonised}) / CAST(NULLIF(COUNT(*) FILTER (WHERE NOT ({colonised})), 0) AS DOUBLE) AS ratio FROM stays GROUP BY 1", "stays"), ["ratio"],
    )
    r.add(
        "f1_position_in_run", f1_position_in_run,
        with_blocks("SELECT siminputrow, random_seed, CAST(step AS BIGINT) AS step, ROW_NUMBER() OVER (PARTITION BY siminputrow, random_seed ORDER BY step) AS position FROM sparse", "sparse"),
    )
    r.add(
        "f2_group_minimum", f2_group_minimum,
        with_blocks(
            """SELECT siminputrow, random_seed, CAST(step AS BIGINT) AS step, current_inpatients - MIN(current_inpatients) OVER (PARTITION BY siminputrow, random_seed) AS above_lowest FROM sparse""", "sparse"), ["above_lowest"],
    )
    r.add(
        "h1_first_per_key", h1_first_per_key,
        with_blocks(
            """SELECT siminputrow, random_seed, CAST(step AS BIGINT) AS step, current_hospital_infections, current_inpatients FROM
            (SELECT *, ROW_NUMBER() OVER (PARTITION BY siminputrow, random_seed ORDER BY step) AS rn FROM sparse WHERE step > 31) t WHERE rn = 1""", "sparse"), ["current_inpatients"],
    )
    r.add("s2_head", s2_head, with_blocks("SELECT siminputrow, random_seed, SUM(rate) AS total FROM monthly GROUP BY 1, 2 ORDER BY ROUND(total, 6) DESC, 1, 2 LIMIT 6", "monthly"), ["total"])
