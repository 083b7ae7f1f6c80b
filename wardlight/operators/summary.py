"""Bands, period summaries and posterior tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardlight.functions.quantiles import DIRECT_ROWS, direct_quantiles, largest_group, select_quantiles
from wardlight.functions.scalar import number_text, title_case
from wardlight.functions.scans import null_safe_join
from wardlight.functions.selectors import any_of, prefix_unprefixed
from wardlight.operators.reshape import bind_rows, pivot_longer, pivot_wider
from wardlight.session import materialize

TRIGGERS = ["outbreak_start", "outbreak_end", "control_end"]

# --- fixed values: report labels -------------------------------------------------------------------------------
PERIODS = {"b": "Baseline", "o": "Outbreak", "c": "Control"}
PERIOD_ORDER = {"Baseline": 1, "Outbreak": 2, "Control": 3}
PARAM_LABELS = {
    "toilet_frequenting_rate": "Patient toilet frequenting rate",
    "toilet_cleaning_rate": "Toilet cleaning rate",
    "toilet_contamination_effect": "Toilet contamination effect",
    "toilet_cleaning_effect": "Toilet cleaning effect",
    "community_colonisation_rate": "Community infection rate",
    "antibiotic_prescription_rate": "Antimicrobial prescription rate",
    "antibiotic_effect": "Antimicrobial effect ($m$)",
    "random_colonisation": "Baseline infection rate (*r*~0~)",
    "side_room_delay_mean": "Side room delay mean",
}
PARAM_UNITS = {
    "toilet_frequenting_rate": "times per day",
    "toilet_cleaning_rate": "times per day",
    "toilet_contamination_effect": "",
    "toilet_cleaning_effect": "",
    "community_colonisation_rate": "percentage of patients",
    "antibiotic_prescription_rate": "percentage of admissions",
    "antibiotic_effect": "relative risk",
    "random_colonisation": "cases per 10,000 bed days",
    "side_room_delay_mean": "days",
}
SENSITIVITY_LABELS = {
    "c_antibiotic_prescription_rate": "Antimicrobial prescription rate",
    "c_side_room_delay_mean": "Side room delay mean (days)",
    "c_toilet_cleaning_rate": "Toilet cleaning rate (per day)",
    "c_toilet_cleaning_effect": "Toilet cleaning effect",
}
PERCENT_COLUMNS = [
    "community_colonisation_rate", "o_community_colonisation_rate", "o_antibiotic_prescription_rate", "c_antibiotic_prescription_rate",
]
HEADLINE_COLUMNS = [*PERCENT_COLUMNS, "toilet_cleaning_rate", "o_toilet_cleaning_rate", "c_toilet_cleaning_rate"]
# --- end of fixed values ---------------------------------------------------------------------------------------


def describe_by(
    df: DataFrame, keys: Sequence[str], value: str, probs: dict[str, float], moments: Sequence[str] = (), group_rows: int | None = None
) -> DataFrame:
    """Quantiles and moments (``mean``, ``sd``, ``min``, ``max``, ``n``) of ``value`` per group.

    One aggregation while groups are known or measured to be small; otherwise the quantiles are selected in rounds
    and joined to the combinable moments.
    """
    makers = {"mean": F.avg, "sd": F.stddev_samp, "min": F.min, "max": F.max, "n": F.count}
    wanted = [makers[m](value).alias(m) for m in moments]
    if group_rows is None:
        group_rows = largest_group(df, keys)
    if group_rows <= DIRECT_ROWS:
        return direct_quantiles(df, keys, value, probs, wanted)
    chosen = select_quantiles(df, keys, value, probs)
    return null_safe_join(df.groupBy(*keys).agg(*wanted), chosen, keys) if wanted else chosen


def mean_sd_band(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Mean, sd and the lines one sd below and above the mean."""
    stats = df.groupBy(*keys).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"))
    return stats.withColumns({"lower": F.col("mean") - F.col("sd"), "upper": F.col("mean") + F.col("sd")})


def quantile_band(df: DataFrame, keys: Sequence[str], value: str, group_rows: int | None = None) -> DataFrame:
    """Median and quartiles per group."""
    return describe_by(df, keys, value, {"q_low": 0.25, "m": 0.5, "q_high": 0.75}, group_rows=group_rows)


def period_summary(df: DataFrame, date: str, value: str, outbreak_from: str, outbreak_to: str, group_rows: int | None = None, by: Sequence[str] = ()) -> DataFrame:
    """Median, quartiles, min, max and mean before and during the outbreak, in one pass; for each ``by`` where given."""
    day = F.col(date)
    start, end = F.to_date(F.lit(outbreak_from)), F.to_date(F.lit(outbreak_to))
    period = F.when(day < start, "pre_outbreak").when(day <= end, "outbreak")
    tagged = df.select(*by, period.alias("period"), value).filter(F.col("period").isNotNull())
    if group_rows is None:
        tagged = materialize(tagged, "period-rows")  # read several times, and often behind a long plan
    return describe_by(tagged, [*by, "period"], value, {"q_low": 0.25, "median": 0.5, "q_high": 0.75}, ["min", "max", "mean", "n"], group_rows)


def period_comparison(simulated: DataFrame, observed: DataFrame, date: str, value: str, outbreak_from: str, outbreak_to: str, group_rows: int | None = None) -> DataFrame:
    """``period_summary`` of both series in one pass: ``type`` is ``sim`` or ``obs``. A period without rows of a type has no line."""
    both = simulated.select(F.lit("sim").alias("type"), date, value).unionByName(observed.select(F.lit("obs").alias("type"), date, value))
    return period_summary(both, date, value, outbreak_from, outbreak_to, group_rows, ["type"])


def column_summary(df: DataFrame, columns: Sequence[str], group_rows: int | None = None) -> DataFrame:
    """Mean, sd and quartiles of every column: one unpivot and one grouping instead of one aggregate per column."""
    tall = pivot_longer(df, [], columns, "param", "value")
    return describe_by(tall, ["param"], "value", {"q25": 0.25, "median": 0.5, "q75": 0.75}, ["mean", "sd"], group_rows)


def headline_values(posterior: DataFrame, columns: Sequence[str] = HEADLINE_COLUMNS) -> DataFrame:
    """Posterior means at 2 decimals, rates as percentages."""
    present = any_of(posterior, columns)
    means = pivot_longer(posterior, [], present, "param", "value").groupBy("param").agg(F.avg("value").alias("mean"))
    scaled = F.when(F.col("param").isin(PERCENT_COLUMNS), F.col("mean") * 100.0).otherwise(F.col("mean"))
    return means.select("param", F.round(scaled, 2).alias("value"))


def scale_percent(df: DataFrame, columns: Sequence[str] = PERCENT_COLUMNS) -> DataFrame:
    """Selected columns as percentages."""
    return df.withColumns({c: F.col(c) * 100.0 for c in any_of(df, columns)})


def posterior_table(posterior: DataFrame, params: Sequence[str], group_rows: int | None = None) -> DataFrame:
    """Parameter by period, each cell ``median (q25–q75)`` at 2 decimals, with labels and units."""
    kept = [p for p in params if p not in TRIGGERS]
    named = prefix_unprefixed(scale_percent(posterior.select(*kept)))
    stats = column_summary(named, named.columns, group_rows)
    text = F.concat(number_text(F.col("median")), F.lit(" ("), number_text(F.col("q25")), F.lit("–"), number_text(F.col("q75")), F.lit(")"))
    cells = stats.select(
        F.regexp_extract("param", "^(b|o|c)_(.*)$", 1).alias("period"), F.regexp_extract("param", "^(b|o|c)_(.*)$", 2).alias("param"), text.alias("cell")
    )
    wide = pivot_wider(cells, ["param"], "period", "cell", list(PERIODS))
    wide = wide.withColumnsRenamed({"b": "baseline", "o": "outbreak", "c": "control"})
    return wide.select(
        "param", _lookup(F.col("param"), PARAM_LABELS).alias("label"), _lookup(F.col("param"), PARAM_UNITS).alias("units"), "baseline", "outbreak", "control"
    )


def _lookup(column: Column, labels: dict[str, str]) -> Column:
    pairs = [F.lit(x) for pair in labels.items() for x in pair]
    return F.coalesce(F.element_at(F.create_map(*pairs), column), column)


def period_and_name(tall: DataFrame, name: str = "name") -> DataFrame:
    """Period label, its sort key and a readable name from a prefixed parameter name."""
    col = F.col(name)
    period = F.when(col.startswith("o_"), "Outbreak").when(col.startswith("c_"), "Control").otherwise("Baseline")
    order = F.when(col.startswith("o_"), 2).when(col.startswith("c_"), 3).otherwise(1)
    text = F.regexp_replace(col, "^o_|^c_", "")
    text = F.replace(F.replace(F.replace(text, F.lit("antibiotic"), F.lit("antimicrobial")), F.lit("_"), F.lit(" ")), F.lit("colonisation"), F.lit("infection"))
    return tall.withColumns({"period": period, "sort_key": order.cast("long"), "label": title_case(text)})


def sensitivity_summary(cases: dict[str, DataFrame], group_rows: int | None = None) -> DataFrame:
    """Pool several one-parameter results, then median and quartiles of the cases per (parameter, value).

    ``cases`` maps a parameter column to a table with that column and ``outbreak_cases``.  The label comes from the
    column, not from the name the result was stored under.
    """
    pooled = bind_rows(*cases.values())
    tall = pivot_longer(pooled, ["outbreak_cases"], list(cases), "param", "value", drop_missing=True)
    band = describe_by(tall, ["param", "value"], "outbreak_cases", {"q_low": 0.25, "med_cases": 0.5, "q_high": 0.75}, group_rows=group_rows)
    return band.withColumn("label", _lookup(F.col("param"), SENSITIVITY_LABELS))


def sensitivity_mean_sd(cases: dict[str, DataFrame]) -> DataFrame:
    """The same pooling with mean and sd."""
    tall = pivot_longer(bind_rows(*cases.values()), ["outbreak_cases"], list(cases), "param", "value", drop_missing=True)
    return tall.groupBy("param", "value").agg(F.avg("outbreak_cases").alias("mean_cases"), F.stddev_samp("outbreak_cases").alias("sd_cases"))


def ratio_of_counts(df: DataFrame, keys: Sequence[str], condition: Column, out: str = "ratio") -> DataFrame:
    """Rows meeting a condition divided by the rows that do not; null when none fails it."""
    met = F.count_if(condition).cast("double")
    return df.groupBy(*keys).agg(F.try_divide(met, F.count_if(~condition).cast("double")).alias(out))


def series_table(band: DataFrame, observed: DataFrame, month: str = "month") -> DataFrame:
    """Simulated band next to the observed series, by month."""
    return band.join(observed.select(month, F.col("rate").alias("observed")), month, "left")


