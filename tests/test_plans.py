"""Physical plans: what reaches the scan, how often rows are shuffled, what never appears."""

import pytest
from pyspark.sql import functions as F

from wardlight.operators import hospital, rates, timeline
from wardlight.session import small_or_self
from wardlight.sources import derived, tables


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def stored(spark, sf, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("runs") / "runs")
    tables.write_runs(derived.runs(spark, sf), path)
    return path


def test_rate_is_one_shuffle_over_a_pruned_scan(spark, stored):
    runs = timeline.drop_burn_in(tables.read_runs(spark, stored, "exp_1"))
    text = plan(rates.monthly_rate(timeline.assign_dates(runs, "gapless")))
    assert text.count("Exchange hashpartitioning") == 1
    assert "GreaterThan(step,31)" in text
    assert "experiment" in text.split("PartitionFilters:")[1].split("PushedFilters")[0]
    columns = text.split("FileScan parquet [")[1].split("]")[0]
    read = {c.split("#")[0] for c in columns.split(",")}
    assert read == {"siminputrow", "random_seed", "step", "total_hospital_infections", "current_inpatients", "experiment"}
    assert "HashAggregate" in text and "SortAggregate" not in text and "Window" not in text


def test_first_row_per_run_combines_before_the_shuffle(spark, stored):
    text = plan(rates.first_per_key(tables.read_runs(spark, stored).drop("experiment"), rates.RUN_KEYS, "step"))
    assert "partial_min_by" in text and "SortAggregate" not in text


def test_step_window_bounds_are_subqueries(spark, sf, stored):
    text = plan(timeline.in_step_window(tables.read_runs(spark, stored), timeline.step_window(derived.posterior(spark, sf))))
    assert "Subquery" in text and "NestedLoop" not in text


def test_events_are_dealt_by_position(spark, sf):
    text = plan(hospital.contamination_levels(derived.toilet_events(spark, sf), block_rows=20))
    assert "hashpartitioning(__block" in text and "hashpartitioning(toilet_id" not in text.split("Window")[1]


def test_daily_measures_are_summed_before_the_window(spark, sf):
    text = plan(hospital.daily_census(derived.stays(spark, sf)))
    window, partial = text.index("Window"), text.index("partial_sum")
    assert window < partial  # printed top down: the window reads the sums


def test_only_small_tables_are_broadcast(spark):
    assert "ResolvedHint" in small_or_self(spark.range(10))._jdf.queryExecution().analyzed().toString()
    large = spark.range(100)
    assert small_or_self(large, max_rows=50) is large


def test_stored_runs_are_partitioned_and_complete(spark, sf, stored):
    runs = tables.read_runs(spark, stored)
    assert runs.count() == derived.runs(spark, sf).count()
    assert {r["experiment"] for r in runs.select("experiment").distinct().collect()} == {f"exp_{i}" for i in range(4)}
    assert runs.agg(F.min("step"), F.max("step")).first() == (1, derived.DAYS)


def test_runs_are_dealt_to_all_partitions_and_never_merged(spark, sf):
    runs = derived.runs(spark, sf)
    assert "hashpartitioning(siminputrow" in plan(runs).split("Window")[-1].split("REPARTITION_BY_NUM")[0] and "REPARTITION_BY_NUM" in plan(runs)
    assert runs.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_dealt_runs_are_clustered_without_moving_again(spark, sf, tmp_path):
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    runs, path = derived.runs(spark, sf), tmp_path / "dealt"
    tables.write_clustered_runs(runs, "dealt_runs", str(path), parts, dealt=True)
    try:
        stored = spark.table("dealt_runs")
        dated = timeline.assign_dates(timeline.drop_burn_in(stored), "gapless")
        assert "Exchange" not in plan(rates.monthly_rate(dated))
        # one file for each bucket at most: every bucket was written by one task
        assert len([f for f in path.iterdir() if f.name.startswith("part-")]) <= parts
        assert stored.exceptAll(runs).count() == 0 == runs.exceptAll(stored).count()
    finally:
        spark.sql("DROP TABLE dealt_runs")


def test_dealt_runs_are_written_without_moving_again(spark, sf, stored, tmp_path):
    tables.write_runs(derived.runs(spark, sf), str(tmp_path / "dealt"), dealt=True)
    one, other = tables.read_runs(spark, str(tmp_path / "dealt")), tables.read_runs(spark, stored)
    assert one.exceptAll(other).count() == 0 == other.exceptAll(one).count()
    # a run was not split: its rows stand in one file, in the order of their steps
    files = one.select(*timeline.RUN_KEYS, F.input_file_name().alias("file")).groupBy(*timeline.RUN_KEYS).agg(F.count_distinct("file").alias("files"))
    assert files.where("files > 1").count() == 0


def test_clustered_runs_need_no_exchange(spark, sf, tmp_path):
    runs, path = derived.runs(spark, sf), str(tmp_path / "clustered")
    tables.write_clustered_runs(runs, "clustered_runs", path, 6)
    spark.sql("DROP TABLE clustered_runs")
    stored = tables.attach_clustered_runs(spark, "clustered_runs", path, runs.schema, 6)
    try:
        dated = timeline.assign_dates(timeline.drop_burn_in(stored), "gapless")
        for df in (rates.monthly_rate(dated), rates.outbreak_cases(stored, list(timeline.RUN_KEYS))):
            assert "Exchange" not in plan(df)
        assert stored.count() == runs.count() and rates.monthly_rate(dated).count() > 0
    finally:
        spark.sql("DROP TABLE clustered_runs")
