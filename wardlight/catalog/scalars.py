"""Queries over the scalar function groups."""

from __future__ import annotations

from pyspark.sql import functions as F

from wardlight.catalog.blocks import real, with_blocks
from wardlight.catalog.registry import Registry
from wardlight.functions import scalar
from wardlight.functions.uniform import hash_seed, hash_uniform
from wardlight.operators.design import linspace
from wardlight.sources import derived


def fn_string(spark, sf):
    name, brand = F.col("p_name"), F.col("p_type")
    return derived.table(spark, sf, "part").select(
        "p_partkey",
        scalar.pad_number(F.col("p_size")).alias("padded"),
        scalar.remove_first(brand, "o").alias("removed"),
        scalar.replace_first(brand, "e", "-").alias("first_replaced"),
        scalar.replace_all(brand, "e", "-").alias("all_replaced"),
        F.concat_ws("-", brand, F.col("p_size").cast("string")).alias("pasted"),
        F.concat(F.lit("rate_"), F.col("p_brand")).alias("glued"),
        brand.startswith("P").alias("starts"),
        scalar.title_case(F.lower(brand)).alias("title"),
        F.regexp_extract(F.concat(F.lit("o-"), name), "(b|o|c)-(.*)", 2).alias("rest"),
        scalar.number_text(F.col("p_retailprice") / 7, 2).alias("number"),
    )


def fn_date(spark, sf):
    day = F.to_date("o_orderdate")
    return derived.table(spark, sf, "orders").select(
        "o_orderkey", F.year(day).cast("long").alias("year"), F.month(day).cast("long").alias("month"), scalar.month_date(F.year(day), F.month(day)).alias("first_of_month"),
        scalar.days_between(F.to_date(F.lit("1995-01-01")), day).cast("long").alias("days"), F.add_months(F.trunc(day, "MM"), 3).alias("in_three_months"),
        F.size(F.sequence(F.trunc(day, "MM"), day)).cast("long").alias("days_so_far"), F.to_date(F.date_format(day, "yyyy-M-d"), "yyyy-M-d").alias("reparsed"),
    )


def fn_math(spark, sf):
    x = F.col("u1")
    return derived.uniforms(spark, sf).select(
        "row_id", F.sqrt(x).alias("root"), F.exp(-x).alias("decay"), F.floor(x * 10).alias("tenth"), scalar.clamp(x, 0.25, 0.75).alias("clamped"),
        scalar.round_half_even(F.floor(x * 64) / 8, 2).alias("even"), scalar.round_half_up(F.floor(x * 64) / 8, 2).alias("up"), scalar.percent(x, 2).alias("percent"),
        scalar.risk(x).alias("risk"), F.least(x, F.col("u2")).alias("low"), F.greatest(x, F.col("u2")).alias("high"),
    )


def fn_conditional(spark, sf):
    size = F.col("p_size")
    return derived.table(spark, sf, "part").select(
        "p_partkey", F.when(size < 10, "small").when(size < 30, "medium").otherwise("large").alias("class"), F.when(size % 2 == 0, size * 2).otherwise(size).cast("long").alias("doubled"),
    )


def fn_array(spark, sf):
    grid = linspace(F.col("u1"), F.col("u1") + F.col("u2"), 5)
    arrays = derived.uniforms(spark, sf).withColumn("grid", grid)
    total = F.aggregate("grid", F.lit(0.0), lambda a, x: a + x)
    squares = F.transform("grid", lambda x: x * x)
    return arrays.select(
        "row_id", (total / F.size("grid")).alias("mean"), F.aggregate(F.zip_with("grid", squares, lambda a, b: a + b), F.lit(0.0), lambda a, x: a + x).alias("zipped"),
        F.size(F.filter("grid", lambda x: x > 0.5)).cast("long").alias("above"), F.array_max("grid").alias("top"),
    )


def fn_statistic(spark, sf):
    return derived.table(spark, sf, "supplier").groupBy(F.col("s_nationkey").cast("long").alias("nation")).agg(
        F.avg("s_acctbal").alias("mean"), F.stddev_samp("s_acctbal").alias("sd"), F.min("s_acctbal").alias("min"), F.max("s_acctbal").alias("max"), F.sum("s_acctbal").alias("sum"), F.count(F.lit(1)).alias("n"),
    )


def fn_random(spark, sf):
    """Hash draws per order: mean and spread of the uniforms within five standard errors, all seeds non-negative."""
    draws = derived.table(spark, sf, "orders").select(hash_uniform(F.col("o_orderkey"), 7, "u").alias("u"), hash_seed(F.col("o_orderkey"), 7).alias("s"))
    n = F.count(F.lit(1))
    return draws.agg(
        n.alias("n"), ((F.min("u") >= 0) & (F.max("u") < 1)).alias("in_range"), (F.abs(F.avg("u") - 0.5) < 5.0 / F.sqrt(12.0 * n)).alias("mean_fits"),
        (F.abs(F.var_samp("u") - 1.0 / 12.0) < 5.0 * F.sqrt(F.lit(1.0 / 180.0) / n)).alias("spread_fits"), (F.min("s") >= 0).alias("seeds_ok"),
    )


def register(r: Registry) -> None:
    number = "regexp_replace(CAST(ROUND(p_retailprice / 7, 2) AS VARCHAR), '\\.0$', '')"
    r.add(
        "fn_string", fn_string,
        f"""SELECT p_partkey, lpad(CAST(p_size AS VARCHAR), CAST(GREATEST(2, length(CAST(p_size AS VARCHAR))) AS INTEGER), '0') AS padded, regexp_replace(p_type, 'o', '') AS removed, regexp_replace(p_type, 'e', '-') AS first_replaced,
        replace(p_type, 'e', '-') AS all_replaced, p_type || '-' || CAST(p_size AS VARCHAR) AS pasted, 'rate_' || p_brand AS glued, starts_with(p_type, 'P') AS starts,
        array_to_string(list_transform(string_split(lower(p_type), ' '), lambda w: upper(w[1]) || w[2:]), ' ') AS title, p_name AS rest, {number} AS number FROM part""",
    )
    r.add(
        "fn_date", fn_date,
        """SELECT o_orderkey, year(o_orderdate) AS year, month(o_orderdate) AS month, CAST(date_trunc('month', o_orderdate) AS DATE) AS first_of_month, date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) AS days,
        CAST(date_trunc('month', o_orderdate) + INTERVAL 3 MONTH AS DATE) AS in_three_months, CAST(day(o_orderdate) AS BIGINT) AS days_so_far, CAST(o_orderdate AS DATE) AS reparsed FROM orders""",
    )
    r.add(
        "fn_math", fn_math,
        with_blocks(
            f"""SELECT row_id, SQRT(u1) AS root, EXP(-u1) AS decay, CAST(FLOOR(u1 * 10) AS BIGINT) AS tenth, LEAST({real(0.75)}, GREATEST({real(0.25)}, u1)) AS clamped, round_even(FLOOR(u1 * 64) / 8, 2) AS even,
            ROUND(FLOOR(u1 * 64) / 8, 2) AS up, ROUND(u1 * 100, 2) AS percent, 1 - EXP(-u1) AS risk, LEAST(u1, u2) AS low, GREATEST(u1, u2) AS high FROM uniforms""", "uniforms"),
        ["root", "decay", "clamped", "even", "up", "percent", "risk", "low", "high"],
    )
    r.add("fn_conditional", fn_conditional, "SELECT p_partkey, CASE WHEN p_size < 10 THEN 'small' WHEN p_size < 30 THEN 'medium' ELSE 'large' END AS class, CAST(CASE WHEN p_size % 2 = 0 THEN p_size * 2 ELSE p_size END AS BIGINT) AS doubled FROM part")
    r.add(
        "fn_array", fn_array,
        with_blocks(
            f"""SELECT row_id, AVG(v) AS mean, SUM(v + v * v) AS zipped, COUNT(*) FILTER (WHERE v > 0.5) AS above, MAX(v) AS top FROM
            (SELECT row_id, u1 + i * ((u1 + u2) - u1) / 4 AS v FROM uniforms CROSS JOIN range(5) g(i)) t GROUP BY 1""", "uniforms"), ["mean", "zipped", "top"],
    )
    r.add(
        "fn_statistic", fn_statistic,
        "SELECT CAST(s_nationkey AS BIGINT) AS nation, AVG(s_acctbal) AS mean, STDDEV_SAMP(s_acctbal) AS sd, MIN(s_acctbal) AS min, MAX(s_acctbal) AS max, SUM(s_acctbal) AS sum, COUNT(*) AS n FROM supplier GROUP BY s_nationkey",
        ["mean", "sd", "min", "max", "sum"],
    )
    r.add("fn_random", fn_random, "SELECT COUNT(*) AS n, TRUE AS in_range, TRUE AS mean_fits, TRUE AS spread_fits, TRUE AS seeds_ok FROM orders")
