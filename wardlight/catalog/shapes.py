"""Queries over column selection, reshaping, unions and parameter files."""

from __future__ import annotations

from pyspark.sql import functions as F

from wardlight.catalog.blocks import with_blocks
from wardlight.catalog.registry import Registry
from wardlight.catalog.series import _observed, _rates, _stats
from wardlight.functions import selectors
from wardlight.operators import reshape, summary, timeline
from wardlight.session import scratch_path
from wardlight.sources import derived, tables

POSTERIOR = list(derived.POSTERIOR_COLUMNS)
MONTHS = [f"{2002 + i // 12}_{i % 12 + 1:02d}" for i in range(33)]
OCP = [p for p in POSTERIOR if p not in summary.TRIGGERS]


def _posterior(spark, sf):
    return derived.posterior(spark, sf).withColumn("accept_rank", F.col("siminputrow") + 1)


def a3_read_param_file(spark, sf):
    path = scratch_path(spark, "params")
    tables.write_param_file(_posterior(spark, sf), POSTERIOR, path)
    return tables.param_means(tables.read_param_file(spark, path))


def a4_write_param_file(spark, sf):
    path = scratch_path(spark, "params")
    tables.write_param_file(_posterior(spark, sf), POSTERIOR, path)
    return tables.param_long(tables.read_param_file(spark, path))


def a5_save_load_results(spark, sf):
    root = scratch_path(spark, "results")
    tables.save_results({"design": derived.design(spark, sf), "observed": _observed(spark, sf)}, root)
    loaded = tables.load_results(spark, root)
    return loaded["design"].select(F.lit("design").alias("result"), F.col("siminputrow").alias("key"), F.col("toilet_cleaning_rate").alias("value")).unionByName(
        loaded["observed"].select(F.lit("observed").alias("result"), F.datediff("month", F.to_date(F.lit("2002-01-01"))).cast("long").alias("key"), F.col("rate").alias("value"))
    )


def a6_export_single_set(spark, sf):
    posterior = _posterior(spark, sf)
    path = scratch_path(spark, "single")
    tables.export_single_set(posterior, POSTERIOR, 3, path)
    return tables.param_means(tables.read_param_file(spark, path), 6)


def c7_name_filters(spark, sf):
    tall = reshape.pivot_longer(derived.posterior(spark, sf), [], POSTERIOR, "param", "value")
    named = tall.filter(F.col("param").isin(summary.TRIGGERS) | (F.col("param") == "antibiotic_effect"))
    others = tall.filter(~F.col("param").isin(summary.TRIGGERS) & (F.col("param") != "antibiotic_effect"))
    count = lambda df, label: df.groupBy("param").agg(F.count(F.lit(1)).alias("rows"), F.avg("value").alias("mean")).withColumn("side", F.lit(label))
    return count(named, "in").unionByName(count(others, "out"))


def c8_select_columns(spark, sf):
    posterior = derived.posterior(spark, sf)
    names = [c for c in selectors.contains(posterior, "toilet") if c in selectors.starts_with(posterior, "o_", "c_")]
    kept = selectors.except_for(posterior.select("siminputrow", *names, *selectors.any_of(posterior, ["antibiotic_effect", "absent"])), ["absent"])
    return posterior.select(*kept)


def c9_reorder_columns(spark, sf):
    return selectors.relocate(selectors.sort_columns(derived.design(spark, sf), ["siminputrow"]), "toilet_cleaning_rate", after="siminputrow")


def c10_rename(spark, sf):
    return selectors.prefix_unprefixed(derived.design(spark, sf), keep=["siminputrow"])


def c11_percent(spark, sf):
    return summary.scale_percent(derived.design(spark, sf))


def d2_natural_right_join(spark, sf):
    return reshape.natural_right_join(derived.design(spark, sf), _stats(spark, sf))


def g1_pivot_wider(spark, sf):
    named = timeline.before(_stats(spark, sf), "month", "2004-10-01").withColumn("name", F.date_format("month", "yyyy_MM"))
    return reshape.pivot_wider(named, ["siminputrow"], "name", "rate", MONTHS, prefix="rate_")


def g2_pivot_longer(spark, sf):
    design = derived.design(spark, sf).withColumn("o_community_colonisation_rate", F.when(F.col("siminputrow") % 3 == 0, F.col("o_community_colonisation_rate")))
    return reshape.pivot_longer(design, ["siminputrow"], selectors.except_for(design, ["siminputrow"]), "param", "value", drop_missing=True)


def _returns(spark, sf, unit="month"):
    """Returned lines per supplier and ship month (or quarter); months without returns have no row."""
    lines = derived.table(spark, sf, "lineitem").filter(F.col("l_returnflag") == "R")
    month = F.trunc(F.to_date("l_shipdate"), unit).alias("month")
    return lines.groupBy(F.col("l_suppkey").alias("siminputrow"), month).agg(F.sum("l_quantity").alias("rate"))


def g3_complete_cells(spark, sf):
    return reshape.complete_cells(_returns(spark, sf), ["siminputrow"], "month", "rate")


def g4_split_names(spark, sf):
    named = selectors.prefix_unprefixed(derived.posterior(spark, sf).select("siminputrow", *OCP), keep=["siminputrow"])
    tall = reshape.pivot_longer_periods(named, ["siminputrow"], selectors.except_for(named, ["siminputrow"]))
    return tall.groupBy("period", "param").agg(F.count(F.lit(1)).alias("rows"), F.avg("value").alias("mean"))


def g5_bind_rows(spark, sf):
    design = derived.design(spark, sf)
    a = design.select("siminputrow", F.col("toilet_cleaning_rate").alias("c_toilet_cleaning_rate"))
    b = design.select("siminputrow", F.col("community_colonisation_rate").alias("c_community_colonisation_rate"))
    return reshape.bind_rows(a, b)


def g6_transpose(spark, sf):
    stats = summary.column_summary(derived.posterior(spark, sf), POSTERIOR)
    return reshape.transpose(stats, "param", ["mean", "sd", "q25", "median", "q75"], POSTERIOR, out="statistic")


def g7_overlay(spark, sf):
    band = _rates(spark, sf).groupBy("month").agg(F.max("rate").alias("rate"))
    return reshape.overlay(band, _observed(spark, sf))


def k2_period_and_name(spark, sf):
    names = reshape.pivot_longer(derived.posterior(spark, sf), [], OCP, "name", "value")
    return summary.period_and_name(names).groupBy("name", "period", "sort_key", "label").agg(F.count(F.lit(1)).alias("rows"))


def k4_label_lookup(spark, sf):
    tall = reshape.pivot_longer(derived.posterior(spark, sf), [], POSTERIOR, "param", "value")
    return reshape.label_lookup(tall.groupBy("param").agg(F.max("value").alias("value")), summary.PARAM_LABELS, "param", "label")


def register(r: Registry) -> None:
    r.add("a3_read_param_file", a3_read_param_file, with_blocks("SELECT param, ROUND(AVG(value), 3) AS value FROM posterior_long GROUP BY 1", "posterior_long"), ["value"])
    r.add("a4_write_param_file", a4_write_param_file, with_blocks("SELECT param, siminputrow + 1 AS accept_rank, value FROM posterior_long", "posterior_long"), ["value"])
    r.add(
        "a5_save_load_results", a5_save_load_results,
        with_blocks(
            """SELECT 'design' AS result, siminputrow AS key, toilet_cleaning_rate AS value FROM design
            UNION ALL SELECT 'observed', date_diff('day', DATE '2002-01-01', month), rate FROM observed""", "design", "observed"), ["value"],
    )
    r.add("a6_export_single_set", a6_export_single_set, with_blocks("SELECT param, ROUND(value, 6) AS value FROM posterior_long WHERE siminputrow = 2", "posterior_long"), ["value"])
    names = ", ".join(f"'{p}'" for p in [*summary.TRIGGERS, "antibiotic_effect"])
    r.add(
        "c7_name_filters", c7_name_filters,
        with_blocks(f"SELECT param, COUNT(*) AS rows, AVG(value) AS mean, CASE WHEN param IN ({names}) THEN 'in' ELSE 'out' END AS side FROM posterior_long GROUP BY 1", "posterior_long"), ["mean"],
    )
    picked = [p for p in POSTERIOR if "toilet" in p and p[:2] in ("o_", "c_")] + ["antibiotic_effect"]
    r.add("c8_select_columns", c8_select_columns, with_blocks(f"SELECT siminputrow, {', '.join(picked)} FROM posterior", "posterior"), picked)
    params = ["toilet_cleaning_rate", "community_colonisation_rate", "o_community_colonisation_rate"]
    r.add("c9_reorder_columns", c9_reorder_columns, with_blocks(f"SELECT siminputrow, {', '.join(params)} FROM design", "design"), params)
    r.add(
        "c10_rename", c10_rename,
        with_blocks("SELECT siminputrow, toilet_cleaning_rate AS b_toilet_cleaning_rate, community_colonisation_rate AS b_community_colonisation_rate, o_community_colonisation_rate FROM design", "design"),
        ["b_toilet_cleaning_rate", "b_community_colonisation_rate", "o_community_colonisation_rate"],
    )
    r.add(
        "c11_percent", c11_percent,
        with_blocks("SELECT * REPLACE (community_colonisation_rate * 100 AS community_colonisation_rate, o_community_colonisation_rate * 100 AS o_community_colonisation_rate) FROM design", "design"), params,
    )
    r.add("d2_natural_right_join", d2_natural_right_join, with_blocks("SELECT s.siminputrow, s.month, s.rate, d.* EXCLUDE (siminputrow) FROM design d RIGHT JOIN stats s ON s.siminputrow = d.siminputrow", "stats", "design"), ["rate", *params])
    wide = ", ".join(f"MAX(rate) FILTER (WHERE strftime(month, '%Y_%m') = '{m}') AS rate_{m}" for m in MONTHS)
    r.add("g1_pivot_wider", g1_pivot_wider, with_blocks(f"SELECT siminputrow, {wide} FROM stats WHERE month < DATE '2004-10-01' GROUP BY 1", "stats"), [f"rate_{m}" for m in MONTHS])
    r.add(
        "g2_pivot_longer", g2_pivot_longer,
        with_blocks(
            " UNION ALL ".join(f"SELECT siminputrow, '{p}' AS param, {p} AS value FROM design" + (" WHERE siminputrow % 3 = 0" if p.startswith("o_") else "") for p in params), "design"), ["value"],
    )
    r.add(
        "g3_complete_cells", g3_complete_cells,
        """WITH t AS (SELECT l_suppkey AS siminputrow, CAST(date_trunc('month', l_shipdate) AS DATE) AS month, SUM(l_quantity) AS rate FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1, 2)
        SELECT k.siminputrow, m.month, t.rate FROM (SELECT DISTINCT siminputrow FROM t) k CROSS JOIN (SELECT DISTINCT month FROM t) m LEFT JOIN t ON t.siminputrow = k.siminputrow AND t.month = m.month""", ["rate"],
    )
    ocp = ", ".join(f"'{p}'" for p in OCP)
    r.add(
        "g4_split_names", g4_split_names,
        with_blocks(
            f"""SELECT CASE WHEN param LIKE 'o\\_%' ESCAPE '\\' THEN 'o' WHEN param LIKE 'c\\_%' ESCAPE '\\' THEN 'c' ELSE 'b' END AS period, regexp_replace(param, '^(o|c)_', '') AS param, COUNT(*) AS rows, AVG(value) AS mean
            FROM posterior_long WHERE param IN ({ocp}) GROUP BY 1, 2""", "posterior_long"), ["mean"],
    )
    r.add(
        "g5_bind_rows", g5_bind_rows,
        with_blocks(
            """SELECT siminputrow, toilet_cleaning_rate AS c_toilet_cleaning_rate, NULL AS c_community_colonisation_rate FROM design
            UNION ALL SELECT siminputrow, NULL, community_colonisation_rate FROM design""", "design"), ["c_toilet_cleaning_rate", "c_community_colonisation_rate"],
    )
    rows = " UNION ALL ".join(f"SELECT '{s}' AS statistic, " + ", ".join(f"MAX({s}) FILTER (WHERE param = '{p}') AS {p}" for p in POSTERIOR) + " FROM posterior_summary" for s in ("mean", "sd", "q25", "median", "q75"))
    r.add("g6_transpose", g6_transpose, with_blocks(rows, "posterior_summary"), POSTERIOR)
    r.add("g7_overlay", g7_overlay, with_blocks("SELECT month, MAX(rate) AS rate, 'sim' AS type FROM monthly GROUP BY 1 UNION ALL SELECT month, rate, 'obs' FROM observed", "monthly", "observed"), ["rate"])

    def label(p: str) -> str:
        text = p[2:] if p[:2] in ("o_", "c_") else p
        return text.replace("antibiotic", "antimicrobial").replace("_", " ").replace("colonisation", "infection").title()

    periods = {"o_": ("Outbreak", 2), "c_": ("Control", 3)}
    meta = ", ".join(f"('{p}', '{periods.get(p[:2], ('Baseline', 1))[0]}', CAST({periods.get(p[:2], ('Baseline', 1))[1]} AS BIGINT), '{label(p)}')" for p in OCP)
    r.add(
        "k2_period_and_name", k2_period_and_name,
        with_blocks(f"SELECT v.name, period, sort_key, label, COUNT(*) AS rows FROM posterior_long p JOIN (VALUES {meta}) v(name, period, sort_key, label) ON v.name = p.param GROUP BY 1, 2, 3, 4", "posterior_long"),
    )
    labels = ", ".join(f"('{k}', '{v}')" for k, v in summary.PARAM_LABELS.items())
    r.add(
        "k4_label_lookup", k4_label_lookup,
        with_blocks(f"SELECT p.param, MAX(value) AS value, COALESCE(ANY_VALUE(label), p.param) AS label FROM posterior_long p LEFT JOIN (VALUES {labels}) v(param, label) ON v.param = p.param GROUP BY 1", "posterior_long"), ["value"],
    )
