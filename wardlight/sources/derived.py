"""Input tables of the operators, derived from the warehouse tables (orders, lineitem, part, supplier, events).

``FIXTURES.md`` gives the same mapping in SQL.  All sizes grow with the source tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

FIRST_DAY = "1995-01-01"
DAYS = 2557
WARDS = 24

# Posterior-shaped columns: name -> (low, high, multiplier of the part key whose fractional part is the draw).
# --- fixed values: ranges of the calibrated study; the multipliers are arbitrary irrational-looking numbers -----
POSTERIOR_COLUMNS = {
    "outbreak_start": (933.0, 1094.0, 0.6180339887),
    "outbreak_end": (1166.0, 1333.0, 0.7548776662),
    "control_end": (1307.0, 1366.0, 0.5698402909),
    "toilet_frequenting_rate": (0.64, 1.22, 0.4142135623),
    "toilet_cleaning_rate": (1.88, 2.73, 0.7320508075),
    "toilet_contamination_effect": (0.04, 0.31, 0.2360679774),
    "toilet_cleaning_effect": (0.71, 0.88, 0.6457513110),
    "community_colonisation_rate": (0.022, 0.046, 0.3166247903),
    "antibiotic_effect": (1.49, 1.68, 0.6055512754),
    "random_colonisation": (5.2, 9.1, 0.1231056256),
    "side_room_delay_mean": (0.62, 4.04, 0.3588989435),
    "o_toilet_frequenting_rate": (0.74, 2.09, 0.7958315233),
    "o_community_colonisation_rate": (0.023, 0.08, 0.3851648071),
    "o_antibiotic_prescription_rate": (0.5, 0.97, 0.5677643628),
    "c_antibiotic_prescription_rate": (0.016, 0.47, 0.0827625302),
    "c_toilet_cleaning_rate": (2.08, 4.27, 0.4031242374),
}
# --- end of fixed values ---------------------------------------------------------------------------------------


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def daily_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per run and day with activity: infection counts, admissions and occupied beds."""
    lines = table(spark, sf_dir, "lineitem")
    return lines.groupBy(
        F.col("l_suppkey").alias("siminputrow"),
        (F.col("l_linenumber") % 3).cast("long").alias("random_seed"),
        (F.date_diff(F.to_date("l_shipdate"), F.to_date(F.lit(FIRST_DAY))) + 1).cast("int").alias("step"),
    ).agg(
        F.count_if(F.col("l_returnflag") == "R").alias("hospital"),
        F.count_if(F.col("l_returnflag") == "A").alias("community"),
        F.count(F.lit(1)).alias("admitted"),
        F.sum("l_quantity").alias("beds"),
    )


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Run output: one row per run and day with cumulative and point-in-time counters.

    Days without activity repeat the counters.  They are filled by exploding each active day up to the next one, so
    no day table is joined: one shuffle for the daily counts, one to bring the days of a run together (at most
    ``DAYS`` rows per run after the aggregation).  The runs are dealt to all shuffle partitions and not merged by size:
    a row becomes many days, so bytes say little about what a task sorts and counts afterwards.
    """
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    daily = daily_counts(spark, sf_dir).repartition(parts, "siminputrow", "random_seed")
    by_day = Window.partitionBy("siminputrow", "random_seed").orderBy("step")
    so_far = by_day.rowsBetween(Window.unboundedPreceding, 0)
    spans = daily.select(
        "*",
        F.sum("hospital").over(so_far).alias("cum_hospital"),
        F.sum("admitted").over(so_far).alias("cum_admitted"),
        F.sum(F.col("hospital") + F.col("community")).over(so_far).alias("cum_colonised"),
        F.when(F.lag("step").over(by_day).isNull(), F.lit(1)).otherwise(F.col("step")).alias("from_step"),
        F.coalesce(F.lead("step").over(by_day) - 1, F.greatest(F.col("step"), F.lit(DAYS))).alias("to_step"),
    )
    days = spans.withColumn("day_step", F.explode(F.sequence("from_step", "to_step")))
    active, started = F.col("day_step") == F.col("step"), F.col("day_step") >= F.col("step")

    def when(condition: Column, name: str) -> Column:
        return F.when(condition, F.col(name)).otherwise(F.lit(0)).cast("long")

    return days.select(
        F.concat(F.lit("exp_"), (F.col("siminputrow") % 4).cast("string")).alias("experiment"),
        "siminputrow",
        "random_seed",
        F.col("day_step").alias("step"),
        when(started, "cum_colonised").alias("total_colonised"),
        when(started, "cum_admitted").alias("total_patients_admitted"),
        when(started, "cum_hospital").alias("total_hospital_infections"),
        when(active, "community").alias("current_community_infections"),
        when(active, "hospital").alias("current_hospital_infections"),
        (F.lit(100.0) + F.when(active, F.col("beds")).otherwise(F.lit(0.0))).alias("current_inpatients"),
        (when(active, "community") + when(active, "hospital")).alias("current_colonised"),
    )


def sparse_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Run output with gaps: only the days with activity have a row."""
    return daily_counts(spark, sf_dir).select(
        "siminputrow", "random_seed", "step", F.col("hospital").alias("current_hospital_infections"),
        (F.lit(100.0) + F.col("beds")).alias("current_inpatients"),
    )


def design(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Design table: one row per parameter set (supplier)."""
    key = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(
        key.alias("siminputrow"),
        F.round(0.5 + 2.5 * F.col("s_nationkey") / 24.0, 3).alias("toilet_cleaning_rate"),
        F.round(0.01 + 0.09 * (F.col("s_acctbal") + 1000.0) / 11000.0, 3).alias("community_colonisation_rate"),
        F.round(0.01 + 0.000907 * ((key * 37) % 101), 3).alias("o_community_colonisation_rate"),
    )


def schedule_design(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Design table with period triggers and baseline / outbreak / control values of every scheduled parameter."""
    key = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(
        key.alias("siminputrow"),
        (900.0 + (key * 37) % 200).alias("outbreak_start"),
        (1150.0 + (key * 53) % 200).alias("outbreak_end"),
        F.lit(1049.0).alias("control_start"),
        (1300.0 + (key * 29) % 60).alias("control_end"),
        *[
            (base + step * (key % 10)).alias(f"{period}{name}")
            for name, values in SCHEDULE_COLUMNS.items()
            for period, base, step in values
        ],
    )


# parameter -> (period prefix, value for key 0, increment per key modulo 10)
SCHEDULE_COLUMNS = {
    "toilet_frequenting_rate": [("", 1.0, 0.125), ("o_", 2.0, 0.125)],
    "toilet_contamination_effect": [("", 0.25, 0.03125), ("o_", 0.5, 0.03125)],
    "toilet_cleaning_effect": [("", 0.5, 0.03125), ("o_", 0.25, 0.03125), ("c_", 0.75, 0.015625)],
    "toilet_cleaning_rate": [("", 2.0, 0.125), ("o_", 1.0, 0.125), ("c_", 3.0, 0.125)],
    "community_colonisation_rate": [("", 0.015625, 0.0078125), ("o_", 0.03125, 0.0078125)],
    "antibiotic_prescription_rate": [("", 0.5, 0.0), ("o_", 0.75, 0.015625), ("c_", 0.25, 0.015625)],
    "proportion_redistributed": [("", 1.0, 0.125), ("o_", 2.0, 0.125), ("c_", 3.0, 0.125)],
    "side_room_delay_mean": [("", 2.0, 0.125), ("o_", 4.0, 0.125), ("c_", 1.0, 0.125)],
}


def sensitivity_design(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One varied parameter per supplier: the experiment is ``siminputrow % 4``, 25 levels each."""
    key = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(
        key.alias("siminputrow"), (key % 4).alias("arm"), (0.015625 * (1 + F.floor(key / 4) % 25)).alias("level")
    )


def uniforms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deterministic draws in [0, 1) from the part keys."""
    key = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(
        key.alias("row_id"), ((key * 0.6180339887) % 1.0).alias("u1"), ((key * 0.7548776662) % 1.0).alias("u2")
    )


def posterior(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A posterior-shaped table: one row per part, one column per parameter."""
    key = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(
        key.alias("siminputrow"),
        *[(low + (high - low) * ((key * mult) % 1.0)).alias(name) for name, (low, high, mult) in POSTERIOR_COLUMNS.items()],
    )


# Further columns of the full posterior: name -> (low, high, multiplier).
EXTRA_COLUMNS = {
    "o_toilet_contamination_effect": (0.05, 0.5, 0.1354001728), "o_toilet_cleaning_rate": (1.0, 3.0, 0.9282032303),
}


def full_posterior(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The posterior with the outbreak columns that the constraints and the headline values also need."""
    key = F.col("siminputrow")
    return posterior(spark, sf_dir).select("*", *[(low + (high - low) * ((key * mult) % 1.0)).alias(name) for name, (low, high, mult) in EXTRA_COLUMNS.items()])


def rooms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(
        (F.col("p_partkey") % WARDS + 1).cast("int").alias("ward"),
        (F.floor(F.col("p_partkey") / WARDS) + 1).cast("int").alias("room"),
        (F.col("p_size") <= 7).alias("is_bay"),
    )


def stays(spark: SparkSession, sf_dir: str) -> DataFrame:
    admit, key = F.to_date("o_orderdate"), F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        key.alias("stay_id"),
        (F.col("o_custkey") % WARDS + 1).cast("int").alias("ward"),
        (F.col("o_custkey") % 10 + 1).cast("int").alias("bed"),
        admit.alias("admit"),
        F.date_add(admit, (1 + key % 9).cast("int")).alias("discharge"),
        (F.col("o_orderstatus") == "F").alias("community_infection"),
        F.when(F.col("o_orderstatus") == "P", F.date_add(admit, F.floor((key % 9) / 2).cast("int"))).alias("hospital_infection_date"),
        F.col("o_orderpriority").isin("1-URGENT", "2-HIGH").alias("antibiotic"),
    )


def queue_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    infected = stays(spark, sf_dir).filter(F.col("community_infection") | F.col("hospital_infection_date").isNotNull())
    return infected.select(
        "stay_id",
        F.coalesce("hospital_infection_date", "admit").alias("entry"),
        (F.col("stay_id") % 4).cast("int").alias("delay_days"),
        F.col("discharge").alias("leave"),
    )


def toilet_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("toilet_id"),
        "event_id",
        "ts",
        F.when(F.col("event_type") == "purchase", F.lit("clean")).otherwise(F.lit("use")).alias("kind"),
        (~F.col("event_type").isin("purchase", "view")).alias("colonised"),
        F.least(F.col("value") / 500.0, F.lit(0.4)).alias("amount"),
    )
