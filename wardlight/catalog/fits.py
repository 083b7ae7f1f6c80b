"""Queries over rejection, posterior summaries, densities and the end-to-end results."""

from __future__ import annotations

from pyspark.sql import functions as F

from wardlight.catalog.blocks import PRE, real, with_blocks
from wardlight.catalog.registry import Registry
from wardlight.catalog.series import _rates, _stats
from wardlight.catalog.shapes import OCP, POSTERIOR, _returns
from wardlight.operators import abc, density, summary
from wardlight.operators.reshape import pivot_longer
from wardlight.plans import calibration, checks
from wardlight.session import materialize, small_or_self
from wardlight.sources import derived

PARAMS = ["toilet_cleaning_rate", "community_colonisation_rate", "o_community_colonisation_rate"]
GRID = 512


def _target(stats, last=None):
    """All-run mean series; ``last`` limits the months."""
    series = stats.groupBy("month").agg(F.avg("rate").alias("rate"))
    return small_or_self(series if last is None else series.filter(F.col("month") <= last))


def _calibration(spark, sf, stage):
    """Run a calibration stage from daily rows."""
    stats = materialize(_stats(spark, sf), "statistics")
    target = _target(stats, "2004-09-01" if stage == 1 else "2008-05-01")
    setting = calibration.STAGE_ONE if stage == 1 else calibration.STAGE_TWO
    rejection = abc.reject(stats, target, setting["tol"])
    return calibration.Calibration(rejection, rejection.parameters(derived.design(spark, sf)))


def _returned(spark, sf):
    """Per supplier and quarter: returned quantity; a supplier has about as many lines in any table, so a few always lack a quarter."""
    return materialize(_returns(spark, sf, "quarter"), "returns")


def j1_complete_cases(spark, sf):
    """Sets with a missing statistic are not used for scaling and rank after every complete set."""
    stats = _returned(spark, sf)
    target = _target(stats)
    return abc.reject(stats, target, 0.6).accepted


def j7_month_alignment(spark, sf):
    """A target that begins and ends half a year later than the statistics: months are missing on either side."""
    stats = materialize(_stats(spark, sf), "statistics")
    return abc.month_alignment(stats, _target(stats).withColumn("month", F.add_months("month", 6)))


def j2_mad_scale(spark, sf):
    stats = materialize(_stats(spark, sf), "statistics")
    target = _target(stats, "2004-09-01").withColumnRenamed("rate", "target")
    aligned = materialize(abc.align(stats, target, target.count()), "aligned")
    return abc.mad_scale(aligned, derived.table(spark, sf, "supplier").count())


def j3_distance(spark, sf):
    return _calibration(spark, sf, 1).rejection.distances


def j3_distance_to_own_series(spark, sf):
    """The series of one set as the target: its own distance is 0 and it ranks first."""
    stats = materialize(_stats(spark, sf), "statistics")
    own = stats.agg(F.min("siminputrow")).scalar()
    target = small_or_self(stats.filter(F.col("siminputrow") == own).select("month", "rate"))
    return abc.reject(stats, target, 0.1).accepted


def j4_accept(spark, sf):
    return _calibration(spark, sf, 1).rejection.accepted


def j4_accept_by_rank(spark, sf):
    """The same cut over the parts, taken by distributed rank instead of a top-k."""
    draws = derived.uniforms(spark, sf).select(F.col("row_id").alias("siminputrow"), F.round(F.abs(F.col("u1") - 0.5), 2).alias("distance"))
    return abc.accept(draws, 0.3, topk_rows=0)


def j5_accepted_parameters(spark, sf):
    return _calibration(spark, sf, 1).posterior


def j6_retained_series(spark, sf):
    return _calibration(spark, sf, 1).rejection.retained().drop("siminputrow")


def e9_column_summary(spark, sf):
    return summary.column_summary(derived.posterior(spark, sf), POSTERIOR)


def e10_posterior_table(spark, sf):
    return summary.posterior_table(derived.posterior(spark, sf), POSTERIOR)


def _sensitivity_cases(spark, sf):
    """Outbreak cases of four one-parameter experiments; each has its own value column."""
    parts = checks.sensitivity_parts(derived.runs(spark, sf), derived.posterior(spark, sf), "gapless")
    cases = checks.pooled_cases(parts, derived.sensitivity_design(spark, sf), ["arm", "level"])
    names = list(summary.SENSITIVITY_LABELS)
    return {n: cases.filter(F.col("arm") == i).select("random_seed", F.col("level").alias(n), "outbreak_cases") for i, n in enumerate(names)}


def e12_sensitivity_summary(spark, sf):
    return summary.sensitivity_summary(_sensitivity_cases(spark, sf))


def e12_sensitivity_mean_sd(spark, sf):
    return summary.sensitivity_mean_sd(_sensitivity_cases(spark, sf))


def k1_density(spark, sf):
    names = small_or_self(summary.period_and_name(spark.createDataFrame([(n,) for n in OCP], "name string")))
    tall = pivot_longer(derived.posterior(spark, sf), [], OCP, "name", "value").join(names, "name")
    return density.densities(tall, ["label"], ["label", "period"], grid=GRID).withColumn("i", F.col("i").cast("long"))


def k3_series_table(spark, sf):
    stats = materialize(_stats(spark, sf), "statistics")
    band = summary.quantile_band(stats, ["month"], "rate", group_rows=derived.table(spark, sf, "supplier").count())
    observed = stats.groupBy("month").agg(F.avg("rate").alias("rate")).filter(F.col("month") <= "2008-05-01")
    return summary.series_table(band, observed)


def k5_headline_values(spark, sf):
    return summary.headline_values(derived.full_posterior(spark, sf))


def r1_stage_one_posterior(spark, sf):
    fit = _calibration(spark, sf, 1)
    return fit.posterior.select("siminputrow", "accept_rank", *PARAMS)


def r1_stage_one_band(spark, sf):
    return _calibration(spark, sf, 1).mean_band()


def r2_stage_two_posterior(spark, sf):
    fit = _calibration(spark, sf, 2)
    return fit.posterior.select("siminputrow", "accept_rank", *PARAMS)


def r2_stage_two_band(spark, sf):
    return _calibration(spark, sf, 2).quantile_band()


def r3_uniform_summary(spark, sf):
    """Period summary of all simulations, as for the uniform-prior runs."""
    stats = _stats(spark, sf)
    return summary.period_summary(stats, "month", "rate", *checks.OUTBREAK)


def r4_mean_runs_by_seed(spark, sf):
    return checks.series_by_run(derived.runs(spark, sf), ["random_seed"], "gapless")


def _observed_rounded(spark, sf):
    return small_or_self(_rates(spark, sf).groupBy("month").agg(F.max("rate").alias("rate")))


def r5_predictive_band(spark, sf):
    bound = derived.table(spark, sf, "supplier").count() * 3
    band, _ = checks.predictive_check(derived.runs(spark, sf), _observed_rounded(spark, sf), "gapless", bound)
    return band


def r5_predictive_summary(spark, sf):
    bound = derived.table(spark, sf, "supplier").count() * 3
    _, periods = checks.predictive_check(derived.runs(spark, sf), _observed_rounded(spark, sf), "gapless", bound)
    return periods


def _curves(spark, sf):
    parts = checks.sensitivity_parts(derived.runs(spark, sf), derived.posterior(spark, sf), "gapless")
    return checks.sensitivity_curves(parts, derived.sensitivity_design(spark, sf), ["arm", "level"])


def r6_sensitivity_rates(spark, sf):
    return _curves(spark, sf)[0]


def r6_sensitivity_cases(spark, sf):
    return _curves(spark, sf)[1]


def register(r: Registry) -> None:
    r.add(
        "j1_complete_cases", j1_complete_cases,
        f"""WITH st AS (SELECT l_suppkey AS siminputrow, CAST(date_trunc('quarter', l_shipdate) AS DATE) AS month, SUM(l_quantity) AS rate FROM lineitem
            WHERE l_returnflag = 'R' GROUP BY 1, 2),
        ta AS (SELECT month, AVG(rate) AS target FROM st GROUP BY 1),
        n AS (SELECT siminputrow, COUNT(*) = (SELECT COUNT(*) FROM ta) AS complete FROM st GROUP BY 1),
        cc AS (SELECT st.*, ta.target FROM st JOIN n USING (siminputrow) JOIN ta USING (month) WHERE complete),
        md AS (SELECT month, MEDIAN(rate) AS med FROM cc GROUP BY 1),
        mad AS (SELECT month, {real(1.4826)} * MEDIAN(ABS(rate - med)) AS mad FROM cc JOIN md USING (month) GROUP BY 1),
        dc AS (SELECT siminputrow, SQRT(SUM(POWER((rate - target) / CASE WHEN mad = 0 THEN 1 ELSE mad END, 2))) AS distance FROM cc JOIN mad USING (month) GROUP BY 1),
        di AS (SELECT n.siminputrow, COALESCE(distance, FLOOR((SELECT MAX(distance) FROM dc) + 10)) AS distance FROM n LEFT JOIN dc USING (siminputrow))
        SELECT * FROM (SELECT siminputrow, distance, ROW_NUMBER() OVER (ORDER BY distance, siminputrow) AS accept_rank FROM di) t
        WHERE accept_rank <= (SELECT CAST(CEIL(COUNT(*) * {real(0.6)}) AS BIGINT) FROM di)""", ["distance"],
    )
    r.add(
        "j7_month_alignment", j7_month_alignment,
        with_blocks(
            """SELECT COALESCE(s.month, t.month) AS month, COALESCE(s.sets, 0) AS sets, t.month IS NOT NULL AS wanted FROM (SELECT month, COUNT(rate) AS sets FROM stats GROUP BY 1) s
            FULL JOIN (SELECT DISTINCT CAST(month + INTERVAL 6 MONTH AS DATE) AS month FROM stats) t ON t.month = s.month""", "stats"),
    )
    r.add("j2_mad_scale", j2_mad_scale, with_blocks("SELECT month, target, median, mad FROM pre_mad", "pre_mad"), ["target", "median", "mad"])
    r.add("j3_distance", j3_distance, with_blocks("SELECT * FROM pre_distance", "pre_distance"), ["distance"])
    r.add(
        "j3_distance_to_own_series", j3_distance_to_own_series,
        with_blocks(
            f"""SELECT * FROM (SELECT siminputrow, distance, ROW_NUMBER() OVER (ORDER BY distance, siminputrow) AS accept_rank FROM
            (SELECT s.siminputrow, SQRT(SUM(POWER((s.rate - t.rate) / CASE WHEN m.mad = 0 THEN 1 ELSE m.mad END, 2))) AS distance
             FROM stats s JOIN (SELECT month, rate FROM stats WHERE siminputrow = (SELECT MIN(siminputrow) FROM stats)) t ON t.month = s.month
             JOIN (SELECT s.month, {real(1.4826)} * MEDIAN(ABS(rate - med)) AS mad FROM stats s JOIN (SELECT month, MEDIAN(rate) AS med FROM stats GROUP BY 1) d ON d.month = s.month GROUP BY 1) m ON m.month = s.month
             GROUP BY 1) x) y WHERE accept_rank <= (SELECT CAST(CEIL(COUNT(DISTINCT siminputrow) * {real(0.1)}) AS BIGINT) FROM stats)""", "stats"),
        ["distance"],
    )
    r.add("j4_accept", j4_accept, with_blocks("SELECT * FROM pre_accepted", "pre_accepted"), ["distance"])
    r.add(
        "j4_accept_by_rank", j4_accept_by_rank,
        with_blocks(
            f"""SELECT * FROM (SELECT siminputrow, distance, ROW_NUMBER() OVER (ORDER BY distance, siminputrow) AS accept_rank FROM (SELECT row_id AS siminputrow, ROUND(ABS(u1 - {real(0.5)}), 2) AS distance FROM uniforms) t) y
            WHERE accept_rank <= (SELECT CAST(CEIL(COUNT(*) * {real(0.3)}) AS BIGINT) FROM uniforms)""", "uniforms"), ["distance"],
    )
    accepted = "SELECT a.siminputrow, a.distance, a.accept_rank, " + ", ".join(f"d.{p}" for p in PARAMS) + " FROM {b}_accepted a JOIN design d ON d.siminputrow = a.siminputrow"
    r.add("j5_accepted_parameters", j5_accepted_parameters, with_blocks(accepted.format(b="pre"), "pre_accepted", "design"), ["distance", *PARAMS])
    retained = "SELECT a.accept_rank AS i, s.month, s.rate, 'sim' AS type FROM {b}_stats s JOIN {b}_accepted a ON a.siminputrow = s.siminputrow"
    r.add("j6_retained_series", j6_retained_series, with_blocks(retained.format(b="pre"), "pre_stats", "pre_accepted"), ["rate"])
    r.add("e9_column_summary", e9_column_summary, with_blocks("SELECT * FROM posterior_summary", "posterior_summary"), ["mean", "sd", "q25", "median", "q75"])

    scale = f"CASE WHEN param IN ({', '.join(repr(p) for p in summary.PERCENT_COLUMNS)}) THEN 100 ELSE 1 END"
    number = "regexp_replace(CAST(ROUND({c} * {s}, 2) AS VARCHAR), '\\.0$', '')"
    cell = " || ".join([number.format(c="median", s=scale), "' ('", number.format(c="q25", s=scale), "'–'", number.format(c="q75", s=scale), "')'"])
    names = [(p[2:] if p[:2] in ("o_", "c_") else p) for p in OCP]
    meta = ", ".join(f"('{n}', '{summary.PARAM_LABELS[n]}', '{summary.PARAM_UNITS[n]}')" for n in dict.fromkeys(names))
    kept = ", ".join(f"'{p}'" for p in OCP)
    r.add(
        "e10_posterior_table", e10_posterior_table,
        with_blocks(
            f"""SELECT v.param, v.label, v.units, MAX(cell) FILTER (WHERE period = 'b') AS baseline, MAX(cell) FILTER (WHERE period = 'o') AS outbreak, MAX(cell) FILTER (WHERE period = 'c') AS control
            FROM (SELECT CASE WHEN param LIKE 'o\\_%' ESCAPE '\\' THEN 'o' WHEN param LIKE 'c\\_%' ESCAPE '\\' THEN 'c' ELSE 'b' END AS period, regexp_replace(param, '^(o|c)_', '') AS name, {cell} AS cell
                  FROM posterior_summary WHERE param IN ({kept})) t JOIN (VALUES {meta}) v(param, label, units) ON v.param = t.name GROUP BY 1, 2, 3""", "posterior_summary"),
    )
    window = """(SELECT CAST(round_even(LEAST(AVG(outbreak_start), AVG(outbreak_end), AVG(control_end)), 0) AS INTEGER) AS step_from,
        CAST(round_even(GREATEST(AVG(outbreak_start), AVG(outbreak_end), AVG(control_end)), 0) AS INTEGER) AS step_to FROM posterior)"""
    windowed = f"dated d JOIN {window} w ON d.step >= w.step_from AND d.step <= w.step_to JOIN sensitivity s ON s.siminputrow = d.siminputrow"
    cases = f"SELECT d.random_seed, s.arm, s.level, MAX(total_hospital_infections) - MIN(total_hospital_infections) AS outbreak_cases FROM {windowed} GROUP BY 1, 2, 3"
    arms = ", ".join(f"({i}, '{n}', '{label}')" for i, (n, label) in enumerate(summary.SENSITIVITY_LABELS.items()))
    r.add(
        "e12_sensitivity_summary", e12_sensitivity_summary,
        with_blocks(
            f"""SELECT v.param, c.level AS value, v.label, QUANTILE_CONT(outbreak_cases, 0.25) AS q_low, MEDIAN(outbreak_cases) AS med_cases, QUANTILE_CONT(outbreak_cases, 0.75) AS q_high
            FROM ({cases}) c JOIN (VALUES {arms}) v(arm, param, label) ON v.arm = c.arm GROUP BY 1, 2, 3""", "dated", "posterior", "sensitivity"), ["value", "q_low", "med_cases", "q_high"],
    )
    r.add(
        "e12_sensitivity_mean_sd", e12_sensitivity_mean_sd,
        with_blocks(
            f"""SELECT v.param, c.level AS value, AVG(outbreak_cases) AS mean_cases, STDDEV_SAMP(outbreak_cases) AS sd_cases
            FROM ({cases}) c JOIN (VALUES {arms}) v(arm, param, label) ON v.arm = c.arm GROUP BY 1, 2""", "dated", "posterior", "sensitivity"), ["value", "mean_cases", "sd_cases"],
    )

    def label(p: str) -> str:
        text = p[2:] if p[:2] in ("o_", "c_") else p
        return text.replace("antibiotic", "antimicrobial").replace("_", " ").replace("colonisation", "infection").title()

    periods = {"o_": "Outbreak", "c_": "Control"}
    kde = ", ".join(f"('{p}', '{label(p)}', '{periods.get(p[:2], 'Baseline')}')" for p in OCP)
    last = GRID - 1
    r.add(
        "k1_density", k1_density,
        with_blocks(
            f"""SELECT label, period, i, x, density, density / MAX(density) OVER (PARTITION BY label, period) AS scaled FROM (
            WITH sa AS (SELECT v.label, v.period, value FROM posterior_long p JOIN (VALUES {kde}) v(param, label, period) ON v.param = p.param),
            fr AS (SELECT label, MIN(value) AS f, MAX(value) AS t FROM sa GROUP BY 1),
            bw AS (SELECT label, period, COUNT(*) AS n, {real(0.9)} * LEAST(STDDEV_SAMP(value), (QUANTILE_CONT(value, 0.75) - QUANTILE_CONT(value, 0.25)) / {real(1.34)}) * POWER(COUNT(*), {real(-0.2)}) AS bw FROM sa GROUP BY 1, 2),
            sh AS (SELECT bw.*, f, t, f - 4 * bw AS lo, ((t + 4 * bw) - (f - 4 * bw)) / {last} AS delta FROM bw JOIN fr USING (label)),
            po AS (SELECT label, period, (value - lo) / delta AS pos FROM sa JOIN sh USING (label, period)),
            bi AS (SELECT label, period, bin, SUM(w) AS w FROM (SELECT label, period, CAST(FLOOR(pos) AS BIGINT) AS bin, 1 - (pos - FLOOR(pos)) AS w FROM po
                   UNION ALL SELECT label, period, CAST(FLOOR(pos) AS BIGINT) + 1, pos - FLOOR(pos) FROM po) u GROUP BY 1, 2, 3),
            gr AS (SELECT sh.*, g.i, f + g.i * (t - f) / {last} AS x FROM sh CROSS JOIN range({GRID}) g(i)),
            ev AS (SELECT gr.*, (x - lo) / delta AS pos FROM gr),
            su AS (SELECT ev.label, ev.period, ev.i, ANY_VALUE(x) AS x, ANY_VALUE(pos) AS pos, ANY_VALUE(n) AS n, ANY_VALUE(bw) AS bw,
                   SUM(w * EXP(-POWER((FLOOR(pos) - bin) * delta / bw, 2) / 2)) AS y0, SUM(w * EXP(-POWER((FLOOR(pos) + 1 - bin) * delta / bw, 2) / 2)) AS y1
                   FROM ev JOIN bi ON bi.label = ev.label AND bi.period = ev.period GROUP BY 1, 2, 3)
            SELECT label, period, i, x, (y0 + (pos - FLOOR(pos)) * (y1 - y0)) / (n * bw * SQRT(2 * PI())) AS density FROM su) d""", "posterior_long"),
        ["x", "density", "scaled"],
    )
    band = "QUANTILE_CONT(rate, 0.25) AS q_low, MEDIAN(rate) AS m, QUANTILE_CONT(rate, 0.75) AS q_high"
    r.add(
        "k3_series_table", k3_series_table,
        with_blocks(f"SELECT s.month, {band.replace('rate', 's.rate')}, MAX(o.rate) AS observed FROM stats s LEFT JOIN observed o ON o.month = s.month AND o.month <= DATE '2008-05-01' GROUP BY 1", "stats", "observed"),
        ["q_low", "m", "q_high", "observed"],
    )
    means = " UNION ALL ".join(
        f"SELECT '{p}' AS param, ROUND(AVG({p}) * {100 if p in summary.PERCENT_COLUMNS else 1}, 2) AS value FROM full_posterior" for p in summary.HEADLINE_COLUMNS
    )
    r.add("k5_headline_values", k5_headline_values, with_blocks(means, "full_posterior"), ["value"])
    fitted = "SELECT a.siminputrow, a.accept_rank, " + ", ".join(f"d.{p}" for p in PARAMS) + " FROM {b}_accepted a JOIN design d ON d.siminputrow = a.siminputrow"
    r.add("r1_stage_one_posterior", r1_stage_one_posterior, with_blocks(fitted.format(b="pre"), "pre_accepted", "design"), PARAMS)
    r.add(
        "r1_stage_one_band", r1_stage_one_band,
        with_blocks(f"SELECT month, AVG(rate) AS mean, STDDEV_SAMP(rate) AS sd, AVG(rate) - STDDEV_SAMP(rate) AS lower, AVG(rate) + STDDEV_SAMP(rate) AS upper FROM ({retained.format(b='pre')}) t GROUP BY 1", "pre_stats", "pre_accepted"),
        ["mean", "sd", "lower", "upper"],
    )
    r.add("r2_stage_two_posterior", r2_stage_two_posterior, with_blocks(fitted.format(b="full"), "full_accepted", "design"), PARAMS)
    r.add("r2_stage_two_band", r2_stage_two_band, with_blocks(f"SELECT month, {band} FROM ({retained.format(b='full')}) t GROUP BY 1", "full_stats", "full_accepted"), ["q_low", "m", "q_high"])
    summary_sql = f"""SELECT period, QUANTILE_CONT(rate, 0.25) AS q_low, MEDIAN(rate) AS median, QUANTILE_CONT(rate, 0.75) AS q_high, MIN(rate) AS min, MAX(rate) AS max, AVG(rate) AS mean, COUNT(rate) AS n FROM
        (SELECT CASE WHEN month < {PRE} THEN 'pre_outbreak' WHEN month <= DATE '2005-05-31' THEN 'outbreak' END AS period, rate FROM {{t}}) t WHERE period IS NOT NULL GROUP BY 1"""
    doubles = ["q_low", "median", "q_high", "min", "max", "mean"]
    r.add("r3_uniform_summary", r3_uniform_summary, with_blocks(summary_sql.format(t="stats"), "stats"), doubles)
    r.add("r4_mean_runs_by_seed", r4_mean_runs_by_seed, with_blocks("SELECT random_seed, month, AVG(rate) AS rate FROM monthly GROUP BY 1, 2", "monthly"), ["rate"])
    r.add("r5_predictive_band", r5_predictive_band, with_blocks(f"SELECT month, {band}, MAX(rate) AS observed FROM monthly GROUP BY 1", "monthly"), ["q_low", "m", "q_high", "observed"])
    both = "SELECT 'sim' AS type, month, rate FROM monthly UNION ALL SELECT 'obs', month, MAX(rate) FROM monthly GROUP BY month"
    compared = f"""SELECT type, period, QUANTILE_CONT(rate, 0.25) AS q_low, MEDIAN(rate) AS median, QUANTILE_CONT(rate, 0.75) AS q_high, MIN(rate) AS min, MAX(rate) AS max, AVG(rate) AS mean, COUNT(rate) AS n FROM
        (SELECT type, CASE WHEN month < {PRE} THEN 'pre_outbreak' WHEN month <= DATE '2005-05-31' THEN 'outbreak' END AS period, rate FROM ({both}) b) t WHERE period IS NOT NULL GROUP BY 1, 2"""
    r.add("r5_predictive_summary", r5_predictive_summary, with_blocks(compared, "monthly"), doubles)
    r.add(
        "r6_sensitivity_rates", r6_sensitivity_rates,
        with_blocks(
            f"""SELECT arm, level, AVG(rate) AS mean_rate, STDDEV_SAMP(rate) AS sd_rate FROM (SELECT arm, level, random_seed, AVG(rate) AS rate FROM
            (SELECT d.random_seed, s.arm, s.level, CAST(date_trunc('month', date_sim) AS DATE) AS month, (MAX(total_hospital_infections) - MIN(total_hospital_infections)) / SUM(current_inpatients) * 1000 AS rate
             FROM {windowed} GROUP BY 1, 2, 3, 4) a GROUP BY 1, 2, 3) b GROUP BY 1, 2""", "dated", "posterior", "sensitivity"), ["level", "mean_rate", "sd_rate"],
    )
    r.add(
        "r6_sensitivity_cases", r6_sensitivity_cases,
        with_blocks(f"SELECT arm, level, AVG(outbreak_cases) AS mean_cases, STDDEV_SAMP(outbreak_cases) AS sd_cases FROM ({cases}) c GROUP BY 1, 2", "dated", "posterior", "sensitivity"),
        ["level", "mean_cases", "sd_cases"],
    )
