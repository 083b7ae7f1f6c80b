"""Operators against brute force on small fixtures, with skew, ties, gaps and missing cells."""

import csv
import datetime as dt
import math
import random
from statistics import NormalDist

import numpy as np
import pytest
from pyspark.sql import functions as F

from wardlight.functions import qfun, selectors, sketches
from wardlight.functions.qfun import apply_qfun
from wardlight.functions.quantiles import quantiles_by, select_quantiles
from wardlight.functions.scans import global_rank, position_in_group, row_index, take_smallest
from wardlight.operators import abc, density, design, hospital, rates, reshape, summary, timeline
from wardlight.plans import calibration
from wardlight.schema import file_name, table_name
from wardlight.sources import tables

DAY = dt.date(2020, 1, 1)


def rows_of(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


# ---- scans and quantiles ----------------------------------------------------------------------------------------


def test_position_with_gaps_and_a_hot_run(spark):
    rng = random.Random(1)
    rows = [(1, s) for s in sorted(rng.sample(range(20_000), 5_000))] + [(k, s) for k in (2, 3) for s in sorted(rng.sample(range(300), 40))]
    df = spark.createDataFrame(rows, "k long, step int").repartition(7)
    got = rows_of(position_in_group(df, ["k"], "step", width=100), "k", "step", "position")
    want, seen = [], {}
    for k, s in sorted(rows):
        seen[k] = seen.get(k, 0) + 1
        want.append((k, s, seen[k]))
    assert got == want


def test_stretches_give_the_dates_of_positions(spark, monkeypatch):
    rng = random.Random(12)
    rows = [(1, None, s) for s in range(40, 700) if s not in (64, 127, 128, 300, 301)] + [(2, 5, s) for s in [-130, -129, -65, -64, -1, 0, 1, 63, 64, 65, 6_400]] + [(None, 1, 9)]
    rows += [(3, k, s) for k in range(3) for s in sorted(rng.sample(range(2_000), 1_900))]
    df = spark.createDataFrame(rows, "siminputrow long, random_seed long, step int").repartition(4)
    want = rows_of(timeline.assign_dates(df, "position").withColumn("key", F.concat_ws("/", F.col("siminputrow"), F.col("random_seed"))), "key", "step", "date_sim")
    for most in (10_000, 3):  # few stretches by run, or too many
        monkeypatch.setattr(timeline, "STRETCHES_PER_RUN", most)
        for dates in ("stretches", "auto"):
            got = timeline.assign_dates(df, dates).withColumn("key", F.concat_ws("/", F.col("siminputrow"), F.col("random_seed")))
            assert rows_of(got, "key", "step", "date_sim") == want
    monkeypatch.setattr(timeline, "STRETCHES_PER_RUN", 10_000)
    few = timeline.assign_dates(df.filter("siminputrow = 1"), "stretches")
    assert "Exchange hashpartitioning" not in few._jdf.queryExecution().executedPlan().toString()
    assert [(r["first"], r["last"], r["before"]) for r in timeline.stretches(df.filter("siminputrow = 2")).orderBy("first").collect()] == [
        (-130, -129, 0), (-65, -64, 2), (-1, 1, 4), (63, 65, 7), (6_400, 6_400, 10)]


def test_position_keeps_null_keys(spark):
    df = spark.createDataFrame([(None, 5), (None, 9), (1, 3)], "k long, step int")
    assert sorted((r["k"] or 0, r["step"], r["position"]) for r in position_in_group(df, ["k"], "step", width=4).collect()) == [(0, 5, 1), (0, 9, 2), (1, 3, 1)]


@pytest.mark.parametrize("shape", ["uniform", "outlier", "ties", "constant", "most equal, NaN and nulls"])
def test_global_rank(spark, shape):
    rng = random.Random(2)
    value = {
        "uniform": rng.random, "outlier": lambda: rng.random() if rng.random() < 0.999 else 1e9, "ties": lambda: float(rng.randrange(3)), "constant": lambda: 4.0,
        "most equal, NaN and nulls": lambda: rng.choice([1.0] * 6 + [rng.random(), float("nan"), None, 2.0]),
    }[shape]
    rows = [(i, value()) for i in range(3_000)]
    df = spark.createDataFrame(rows, "id long, v double").repartition(5)

    def key(r):
        return (-1, 0.0) if r[1] is None else (1, 0.0) if math.isnan(r[1]) else (0, r[1])

    ranked = global_rank(df, "v", "id", parts=16)
    assert {r["id"]: r["rank"] for r in ranked.collect()} == {i: n + 1 for n, (i, _) in enumerate(sorted(rows, key=lambda r: (key(r), r[0])))}
    down = {r["id"]: r["rank"] for r in global_rank(df, "v", "id", descending=True).collect()}
    assert down == {i: n + 1 for n, (i, _) in enumerate(sorted(rows, key=lambda r: (-key(r)[0], -key(r)[1], r[0])))}
    few = rows_of(take_smallest(df, "v", "id", 700, topk_rows=10), "id")
    assert few == rows_of(take_smallest(df, "v", "id", 700), "id")
    assert rows_of(take_smallest(df, "v", "id", 40, topk_rows=10, descending=True), "id") == sorted((i,) for i, n in down.items() if n <= 40)
    assert rows_of(row_index(df, "v", "id", small_rows=1), "id", "index") == rows_of(row_index(df, "v", "id"), "id", "index")


@pytest.mark.parametrize("shape", ["uniform", "outlier", "ties", "constant"])
def test_selected_quantiles(spark, shape):
    rng = random.Random(3)
    value = {"uniform": rng.random, "outlier": lambda: rng.random() if rng.random() < 0.999 else -1e12, "ties": lambda: float(rng.randrange(4)), "constant": lambda: 4.0}[shape]
    rows = [("hot", value()) for _ in range(2_500)] + [("cold", value()) for _ in range(7)] + [(None, 1.0), (None, 2.0)]
    df = spark.createDataFrame(rows, "g string, v double")
    probs = {"q0": 0.0, "q25": 0.25, "q50": 0.5, "q90": 0.9, "q100": 1.0}
    got = {r["g"]: [r[n] for n in probs] for r in select_quantiles(df, ["g"], "v", probs, rows=5, pivots=4).collect()}
    for g in ("hot", "cold", None):
        want = np.quantile([v for k, v in rows if k == g], list(probs.values()))
        assert np.allclose(got[g], want, rtol=1e-12, atol=1e-12)
    direct = {r["g"]: [r[n] for n in probs] for r in quantiles_by(df, ["g"], "v", probs).collect()}
    measured = {r["g"]: [r[n] for n in probs] for r in quantiles_by(df, ["g"], "v", probs, direct_rows=5).collect()}
    for g in direct:
        assert np.allclose(direct[g], measured[g], rtol=1e-12)


def test_quantiles_of_missing_and_special_values(spark):
    inf, nan = float("inf"), float("nan")
    rows = [("none", None)] * 3 + [(None, None)] + [("ends", v) for v in (-inf, 1.0, 2.0, 3.0, inf)] + [("nan", v) for v in (1.0, nan, nan, 5.0, None)] + [("wide", 10.0 ** (i % 600 - 300)) for i in range(600)]
    df = spark.createDataFrame(rows, "g string, v double")
    probs = {"q0": 0.0, "q50": 0.5, "q100": 1.0}
    text = lambda found: sorted(str([r["g"], *[r[n] for n in probs]]) for r in found.collect())
    assert text(select_quantiles(df, ["g"], "v", probs, rows=20, pivots=4)) == text(quantiles_by(df, ["g"], "v", probs, group_rows=600))


def test_selected_quantiles_keep_rows_near_the_ranks_only(spark, monkeypatch):
    """No table of a large group's distinct values is made: what is written has few of them."""
    from wardlight.functions import quantiles

    rng = np.random.default_rng(8)
    values = {"spread": rng.normal(size=20_000), "ties": np.where(rng.random(9_000) < 0.9, 7.0, rng.random(9_000) * 20)}
    df = spark.createDataFrame([(g, float(v)) for g, vs in values.items() for v in vs] + [("few", 1.0), (None, 3.0)], "g string, v double").repartition(5)
    written, write = [], quantiles.materialize
    monkeypatch.setattr(quantiles, "materialize", lambda d, label: written.append((label, write(d, label))) or written[-1][1])
    found = {r["g"]: (r["a"], r["b"]) for r in select_quantiles(df, ["g"], "v", {"a": 0.25, "b": 0.99}, rows=1_000).collect()}
    for g, vs in values.items():
        assert np.allclose(found[g], np.quantile(vs, [0.25, 0.99]), rtol=1e-12)
    assert found["few"] == (1.0, 1.0) and found[None] == (3.0, 3.0)
    assert next(d for label, d in written if label == "quantile-values").count() < 1_000


def test_large_sides_are_merged_not_broadcast(spark):
    """Rows that an explode makes, and values stored in small files, look small to the planner: neither may be broadcast."""
    priors = spark.createDataFrame([("a", 0.0, 1.0, "qunif"), ("b", 0.0, 1.0, "qunif")], "param string, min double, max double, qfun string")
    strata = design.stratified(design.draw_rows(priors, 50).withColumn("u", F.rand(1)))
    cells = reshape.complete_cells(spark.createDataFrame([(1, "x", 1.0), (2, "y", 2.0)], "k int, n string, v double"), ["k"], "n", "v")
    for df in (strata, cells):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


def test_period_summary_evaluates_its_input_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(row):
        seen.add(1)
        return row

    rows = [(dt.date(2004, 9 + i % 3, 1), float(i)) for i in range(30)]
    df = spark.createDataFrame(spark.sparkContext.parallelize(rows, 2).map(count), "month date, rate double")
    found = rows_of(summary.period_summary(df, "month", "rate", "2004-10-01", "2005-05-31"), "period", "n", "max")
    assert found == [("outbreak", 20, 29.0), ("pre_outbreak", 10, 27.0)] and seen.value == 30


def test_mean_over_seeds_keeps_missing_months(spark):
    df = spark.createDataFrame([(1, 1, 2.0), (1, 1, None), (2, 1, 2.0), (2, 1, 4.0)], "siminputrow int, month int, rate double")
    assert {r["siminputrow"]: r["rate"] for r in rates.mean_over_seeds(df).collect()} == {1: None, 2: 3.0}
    assert {r["siminputrow"]: r["rate"] for r in rates.mean_over_seeds(df, skip_missing=True).collect()} == {1: 2.0, 2: 3.0}


def test_wide_form_refuses_what_it_would_lose(spark):
    df = spark.createDataFrame([(1, "a", 1.0), (1, "b", 2.0), (2, "a", None)], "k int, n string, v double")
    assert reshape.pivot_wider(df, ["k"], "n", "v", ["a", "b"]).count() == 2
    for bad, names in ((df, ["a"]), (df.union(df.limit(1)), ["a", "b"])):
        with pytest.raises(Exception, match="no column for b|two rows in one cell"):
            reshape.pivot_wider(bad, ["k"], "n", "v", names).collect()


def test_param_file_keeps_missing_values(spark, tmp_path):
    df = spark.createDataFrame([(1, 1.5), (2, None), (3, 2.5)], "accept_rank long, p double")
    tables.write_param_file(df, ["p"], str(tmp_path / "f"))
    assert sorted((r["accept_rank"], r["value"]) for r in tables.param_long(tables.read_param_file(spark, str(tmp_path / "f"))).collect()) == [(1, 1.5), (2, None), (3, 2.5)]


def test_describe_takes_both_paths(spark, monkeypatch):
    df = spark.createDataFrame([("a", float(i % 17)) for i in range(400)] + [("b", 1.5)], "g string, v double")
    small = rows_of(summary.describe_by(df, ["g"], "v", {"m": 0.5}, ["mean", "n"]), "g", "m", "mean", "n")
    monkeypatch.setattr(summary, "DIRECT_ROWS", 10)
    assert rows_of(summary.describe_by(df, ["g"], "v", {"m": 0.5}, ["mean", "n"]), "g", "m", "mean", "n") == small


def test_sketches_merge_and_keep_their_error(spark):
    df = spark.range(60_000).select((F.col("id") % 3).alias("g"), (F.col("id") % 7).alias("part"), (F.xxhash64("id") % 100_003).cast("double").alias("v"))
    df = df.union(spark.createDataFrame([(9, 0, None), (9, 1, float("nan")), (0, 0, None)], df.schema))
    probs = {f"q{i}": i / 10 for i in range(11)}
    merged = sketches.merge_sketches(sketches.sketches_by(df, ["g", "part"], "v"), ["g"])
    assert {r["g"]: r["n"] for r in merged.collect()} == {0: 20_000, 1: 20_000, 2: 20_000, 9: 0}
    values = {g: np.sort([r["v"] for r in df.filter((F.col("g") == g) & F.col("v").isNotNull()).collect()]) for g in (0, 1, 2)}
    for found in (sketches.quantiles_of(merged, ["g"], probs), quantiles_by(df, ["g"], "v", probs, sketch=200)):
        for r in found.collect():
            for name, p in probs.items():
                if r["g"] == 9:
                    assert r[name] is None
                else:
                    v = values[r["g"]]
                    low, high = np.searchsorted(v, r[name], "left") / len(v), np.searchsorted(v, r[name], "right") / len(v)
                    assert low - 0.03 <= p <= high + 0.03
    exact = quantiles_by(df.filter("g < 9"), ["g"], "v", {"m": 0.5})
    assert "kll" not in exact._jdf.queryExecution().executedPlan().toString()


# ---- timelines and rates ----------------------------------------------------------------------------------------


@pytest.mark.parametrize("case", ["regular", "one gap", "late start", "all odd"])
def test_auto_dates_equal_dates_by_position(spark, case):
    runs = {(1, 1): range(32, 60), (1, 2): range(32, 60), (2, 1): range(32, 50)}
    if case == "one gap":
        runs[(1, 2)] = [s for s in range(32, 60) if s != 40]
    elif case == "late start":
        runs[(1, 2)] = range(45, 60)
    elif case == "all odd":
        runs = {k: [s for s in v if s % 7] for k, v in runs.items()}
    rows = [(*k, s) for k, v in runs.items() for s in v]
    df = spark.createDataFrame(rows, "siminputrow long, random_seed long, step int")
    got = rows_of(timeline.assign_dates(df), "siminputrow", "random_seed", "step", "date_sim")
    assert got == rows_of(timeline.assign_dates(df, "position"), "siminputrow", "random_seed", "step", "date_sim")
    want = sorted((*k, s, dt.date(2002, 1, 1) + dt.timedelta(days=i)) for k, v in runs.items() for i, s in enumerate(v))
    assert got == want


def test_rate_without_patient_days_is_null_and_carry_counts_the_boundary(spark):
    rows = [(1, 1, dt.date(2002, 1, 31), 5, 10), (1, 1, dt.date(2002, 1, 30), 3, 10), (1, 1, dt.date(2002, 2, 1), 9, 4), (1, 1, dt.date(2002, 2, 2), 10, 6), (1, 1, dt.date(2002, 3, 1), 10, 0)]
    df = spark.createDataFrame(rows, "siminputrow long, random_seed long, date_sim date, total_hospital_infections long, current_inpatients long")
    plain = [r[0] for r in rates.monthly_rate(df).orderBy("month").select("rate").collect()]
    carry = [r[0] for r in rates.monthly_rate(df, boundary="carry").orderBy("month").select("rate").collect()]
    assert plain == [2 / 20 * 1000, 1 / 10 * 1000, None]
    assert carry == [2 / 20 * 1000, 5 / 10 * 1000, None]


def test_outbreak_cases_equal_largest_rise(spark, sf):
    from wardlight.sources import derived

    runs = derived.runs(spark, sf).filter("step between 900 and 1300")
    cases = rows_of(rates.outbreak_cases(runs, rates.RUN_KEYS), "siminputrow", "random_seed", "outbreak_cases")
    above = rates.with_group_minimum(runs, rates.RUN_KEYS, rates.INFECTIONS, "low").withColumn("above", F.col(rates.INFECTIONS) - F.col("low"))
    assert cases == rows_of(above.groupBy(*rates.RUN_KEYS).agg(F.max("above").alias("m")), "siminputrow", "random_seed", "m")


def test_first_per_key_keeps_nulls_of_the_first_row(spark):
    df = spark.createDataFrame([(1, 2, 7, "b"), (1, 1, None, "a"), (2, 5, 3, None)], "k long, step int, x long, s string")
    assert sorted((r["k"], r["x"] is None, r["s"]) for r in rates.first_per_key(df, ["k"], "step").collect() if r["k"] == 1) == [(1, True, "a")]


# ---- rejection --------------------------------------------------------------------------------------------------


def brute_rejection(stats, target, tol):
    sets, months = sorted({s for s, _, _ in stats}), sorted(target)
    cell = {(s, m): r for s, m, r in stats}
    complete = [s for s in sets if all(cell.get((s, m)) is not None for m in months)]
    scale = {}
    for m in months:
        x = np.array([cell[(s, m)] for s in complete])
        mad = 1.4826 * np.median(np.abs(x - np.median(x)))
        scale[m] = mad if mad > 0 else 1.0
    d = {s: math.sqrt(sum(((cell[(s, m)] - target[m]) / scale[m]) ** 2 for m in months)) for s in complete}
    far = math.floor(max(d.values()) + 10)
    full = [(d.get(s, far), s) for s in sets]
    return sorted(full)[: math.ceil(len(sets) * tol)]


@pytest.fixture(scope="module")
def stats():
    rng = random.Random(5)
    months = [dt.date(2002, m, 1) for m in range(1, 7)]
    rows = [(s, m, 3.0 if m.month == 4 else round(rng.gauss(2, 1), 3)) for s in range(60) for m in months]  # month 4 is constant: mad 0
    rows = [r for r in rows if r[:2] != (7, months[1])]  # set 7 lacks a month
    rows = [(s, m, None) if (s, m) == (9, months[0]) else (s, m, r) for s, m, r in rows]  # set 9 has a null
    rows += [(s, dt.date(2003, 1, 1), 99.0) for s in range(60)]  # beyond the target
    return rows, {m: 2.5 for m in months}


@pytest.mark.parametrize("tol", [0.05, 0.5, 1.0])
def test_rejection(spark, stats, tol):
    rows, target = stats
    df = spark.createDataFrame(rows, "siminputrow long, month date, rate double")
    tgt = spark.createDataFrame(list(target.items()), "month date, rate double")
    fit = abc.reject(df, tgt, tol)
    want = brute_rejection(rows, target, tol)
    got = fit.accepted.orderBy("accept_rank").collect()
    assert [r["siminputrow"] for r in got] == [s for _, s in want]
    assert np.allclose([r["distance"] for r in got], [d for d, _ in want])
    assert [r["accept_rank"] for r in got] == list(range(1, fit.k + 1))
    by_rank = abc.accept(fit.distances, tol, topk_rows=0)
    assert rows_of(by_rank, "siminputrow", "accept_rank") == rows_of(fit.accepted, "siminputrow", "accept_rank")


def test_accepted_sets_grow_with_tolerance_and_belong_to_the_design(spark, stats):
    rows, target = stats
    df = spark.createDataFrame(rows, "siminputrow long, month date, rate double")
    tgt = spark.createDataFrame(list(target.items()), "month date, rate double")
    few, many = abc.reject(df, tgt, 0.1), abc.reject(df, tgt, 0.3)
    a, b = ({r["siminputrow"] for r in f.accepted.collect()} for f in (few, many))
    assert a < b and len(a) == few.k == 6
    params = spark.range(60).select(F.col("id").alias("siminputrow"), (F.col("id") * 2.0).alias("p"))
    assert {r["p"] for r in few.parameters(params).collect()} == {2.0 * s for s in a}
    assert few.retained().count() == 6 * 6


def test_own_series_has_distance_zero(spark, stats):
    rows, _ = stats
    df = spark.createDataFrame([r for r in rows if r[1].year == 2002], "siminputrow long, month date, rate double")
    own = df.filter("siminputrow = 20").select("month", "rate")
    first = abc.reject(df, own, 0.02).accepted.orderBy("accept_rank").first()
    assert (first["siminputrow"], first["distance"]) == (20, 0.0)


def test_missing_target_month_fails(spark, stats):
    rows, _ = stats
    df = spark.createDataFrame(rows, "siminputrow long, month date, rate double")
    tgt = spark.createDataFrame([(dt.date(1999, 1, 1), 1.0)], "month date, rate double")
    with pytest.raises(ValueError, match="no statistic"):
        abc.reject(df, tgt, 0.1)


# ---- designs ----------------------------------------------------------------------------------------------------


def test_random_design_is_reproducible_and_bounded(spark):
    a = design.design_random(spark, design.BASELINE_PRIORS, 500)
    b = design.design_random(spark, design.BASELINE_PRIORS, 500).repartition(13)
    names = list(design.BASELINE_PRIORS)
    assert rows_of(a, "siminputrow", *names) == rows_of(b, "siminputrow", *names)
    for name, spec in design.BASELINE_PRIORS.items():
        low, high = a.agg(F.min(name), F.max(name)).first()
        assert spec["min"] <= low < high <= spec["max"]


def test_latin_hypercube_has_one_draw_per_stratum(spark):
    n, priors = 200, {"x": {"min": 0.0, "max": 1.0}, "y": {"min": 0.0, "max": 1.0}}
    rows = spark.range(1, n + 1).withColumnRenamed("id", "siminputrow")
    lhs = design.design_lhs(rows, priors, precision=9, cells=8)
    for name in priors:
        assert sorted(math.floor(r[name] * n) for r in lhs.collect()) == list(range(n))


def test_quantile_functions(spark):
    df = spark.createDataFrame([(0.5,), (0.975,)], "p double")
    got = df.select(apply_qfun(F.col("p"), {"qfun": "qnorm", "mean": 1.0, "sd": 2.0, "min": 9.0}).alias("x")).collect()
    assert np.allclose([r["x"] for r in got], [1.0, 1.0 + 2.0 * 1.959963984540054])
    probs = [1e-300, 1e-12, 1e-5, 0.0749, 0.0751, 0.3, 0.5, 0.9, 0.99999, 1 - 1e-12]
    found = spark.createDataFrame([(x,) for x in [*probs, 0.0, 1.0, None, float("nan")]], "p double").select(apply_qfun(F.col("p"), {"qfun": "qnorm"}).alias("x")).collect()
    assert np.allclose([r["x"] for r in found[:10]], [NormalDist().inv_cdf(x) for x in probs], rtol=1e-12, atol=1e-15)
    assert [r["x"] for r in found[10:13]] == [-math.inf, math.inf, None] and math.isnan(found[13]["x"])
    with pytest.raises(ValueError, match="unknown quantile"):
        apply_qfun(F.col("p"), {"qfun": "nope"})


def test_grids(spark):
    row = spark.range(1).select(design.linspace(0.25, 4.0, 4).alias("a"), design.linspace(2.0, 9.0, 1).alias("b"), design.stepped(0.0, 0.1, 1.0).alias("c")).first()
    assert np.allclose(row["a"], [0.25, 1.5, 2.75, 4.0]) and row["b"] == [2.0]
    assert np.allclose(row["c"], np.arange(11) / 10)
    zipped = design.design_distinct(spark, {"x": [1.0, 2.0], "y": [5.0, 6.0]}, [7, 8, 9], {"k": 3})
    assert rows_of(zipped, "siminputrow", "x", "y", "k", "random_seed") == [(i, float(i), i + 4.0, 3, s) for i in (1, 2) for s in (7, 8, 9)]
    with pytest.raises(ValueError, match="equal length"):
        design.design_distinct(spark, {"x": [1.0], "y": []}, [1])
    assert len(set(design.make_seeds(100))) == 100
    assert design.design_simple(spark, {"k": 1}, [4, 5]).count() == 2


def test_samples(spark):
    df = spark.range(50).withColumnRenamed("id", "siminputrow")
    taken = design.sample_rows(df, 20)
    assert taken.count() == taken.distinct().count() == 20
    with pytest.raises(ValueError, match="cannot take"):
        design.sample_rows(df, 51)
    indexed = df.select((F.col("siminputrow") + 1).alias("accept_rank"), "siminputrow")
    drawn = design.bootstrap(indexed, design.bootstrap_draws(spark, 400))
    assert drawn.count() == 400 and drawn.select("siminputrow").distinct().count() > 40


def test_draws_from_a_prior_table(spark, monkeypatch):
    priors = spark.createDataFrame([(n, float(p["min"]), float(p["max"]), None) for n, p in design.BASELINE_PRIORS.items()], "param string, min double, max double, qfun string")
    names = list(design.BASELINE_PRIORS)
    want = rows_of(design.design_random(spark, design.BASELINE_PRIORS, 50, seed=9), "siminputrow", *names)
    assert rows_of(design.design_from_table(priors, 50, names, seed=9), "siminputrow", *names) == want
    monkeypatch.setattr(design, "DRAW_BLOCK", 7)
    assert rows_of(design.design_from_table(priors, 50, names, seed=9), "siminputrow", *names) == want
    assert design.draw_table(priors, 0).count() == 0 and design.draw_table(priors.limit(0), 5).count() == 0
    # as many parameters as a dictionary on the driver should not hold; no crossing of tables in the plan
    many = spark.range(30_000).select(F.concat(F.lit("p"), F.col("id").cast("string")).alias("param"), F.col("id").cast("double").alias("min"), (F.col("id") + 1.0).alias("max"))
    drawn = design.draw_table(many, 3)
    assert drawn.count() == 90_000 and "NestedLoop" not in drawn._jdf.queryExecution().executedPlan().toString()
    off = drawn.withColumn("low", F.substring("param", 2, 9).cast("double")).filter((F.col("value") < F.col("low")) | (F.col("value") > F.col("low") + 1))
    assert off.count() == 0
    with pytest.raises(Exception, match="unknown quantile function none"):
        design.draw_table(many.limit(1).withColumn("qfun", F.lit("none")), 1).collect()


def test_vector_quantile_functions(spark):
    def triangle(p, low=0.0, high=1.0):
        return low + (high - low) * np.sqrt(p)

    qfun.register_vector_qfun("triangle", triangle)
    df = spark.createDataFrame([(0.0,), (0.25,), (1.0,)], "p double")
    assert rows_of(df.select(apply_qfun(F.col("p"), {"qfun": "triangle", "high": 3.0, "sd": 9.0}).alias("x")), "x") == [(0.0,), (1.5,), (3.0,)]
    priors = spark.createDataFrame([("a", "triangle", 1.0, None), ("b", "qunif", None, 5.0)], "param string, qfun string, low double, max double")
    got = {r["param"]: r["value"] for r in design.draw_table(priors, 1, uniform=lambda row, param: F.lit(0.25), vectors=["triangle"]).collect()}
    assert got == {"a": 1.0, "b": 1.25}
    # a column form of the same name goes first: no Python in the plan
    qfun.register_vector_qfun("qexp", triangle)
    assert "Python" not in df.select(apply_qfun(F.col("p"), {"qfun": "qexp"}))._jdf.queryExecution().executedPlan().toString()
    for bad in (lambda p, low: p, lambda p, low=True: p, lambda p, low="x": p):
        with pytest.raises(TypeError, match="numeric defaults"):
            qfun.register_vector_qfun("bad", bad)
    qfun.register_vector_qfun("short", lambda p: p.head(1).to_numpy())
    with pytest.raises(Exception, match="expected 3 doubles"):
        df.repartition(1).select(apply_qfun(F.col("p"), {"qfun": "short"})).collect()
    with pytest.raises(ValueError, match="unknown quantile function"):
        apply_qfun(F.col("p"), {"qfun": "nobody"})


def test_two_stages_hand_over(spark):
    """Stage two's priors and sets come from what stage one accepted."""
    first = design.design_random(spark, design.BASELINE_PRIORS, 40, seed=3)
    months = [dt.date(2004, 8, 1), dt.date(2004, 9, 1), dt.date(2004, 12, 1)]
    observed = spark.createDataFrame([(m, 5.0) for m in months], "month date, rate double")
    series = first.select("siminputrow", F.explode(F.array(*[F.lit(m) for m in months])).alias("month"), (F.col("antibiotic_effect") * 5 - 2.0).alias("rate"))
    asked = []

    def second(drawn):
        asked.append(drawn.columns)
        return drawn.select("siminputrow", F.explode(F.array(*[F.lit(m) for m in months])).alias("month"), (F.col("o_side_room_delay_mean") + 1.0).alias("rate"))

    out = calibration.two_stage(first, series, second, observed, settings=({"tol": 0.1}, {"samples": 30, "tol": 0.1}), seed=5)
    near = sorted(first.collect(), key=lambda r: abs(r["antibiotic_effect"] * 5 - 7.0))[:4]
    assert sorted(r["siminputrow"] for r in out.one.posterior.collect()) == sorted(r["siminputrow"] for r in near)
    prior = {r["param"]: r for r in out.priors.collect()}["antibiotic_effect"]
    assert prior["min"] == pytest.approx(np.quantile([r["antibiotic_effect"] for r in near], 0.25)) and len(asked) == 1
    drawn = out.design.collect()
    assert len(drawn) == 30 and all(prior["min"] - 1e-3 <= r["antibiotic_effect"] <= prior["max"] + 1e-3 for r in drawn)
    best = sorted(drawn, key=lambda r: (abs(r["o_side_room_delay_mean"] - 4.0), r["siminputrow"]))[:3]
    assert [r["siminputrow"] for r in out.two.posterior.orderBy("accept_rank").collect()] == [r["siminputrow"] for r in best]


def test_second_stage_design(spark):
    params = list(design.BASELINE_PRIORS)
    accepted = design.design_random(spark, design.BASELINE_PRIORS, 60)
    priors = calibration.stage_two_priors(accepted)
    assert priors.count() == 8 + 14
    drawn = calibration.stage_two_design(priors, 40, [1, 2, 3]).cache()
    assert drawn.count() == 120 and rows_of(drawn.select("siminputrow").distinct(), "siminputrow") == [(i,) for i in range(1, 41)]
    with pytest.raises(ValueError, match="cannot take"):
        calibration.stage_two_design(priors, 40, [1], oversample=0)
    for name in design.CONSTRAINED:
        assert drawn.filter(F.col(f"o_{name}") < F.col(name)).count() == 0
    assert calibration.mean_design(accepted, params, [1, 2]).count() == 2
    assert calibration.uniform_design(accepted, params, 10, [1, 2]).count() == 20
    bounds = design.uniform_around_mean(accepted, ["antibiotic_effect"]).first()
    cells = calibration.uniform_design(accepted, params, 10, [1], generator=design.lhs_from_table).collect()
    assert sorted(int((r["antibiotic_effect"] - bounds["min"]) / (bounds["max"] - bounds["min"]) * 10) for r in cells) == list(range(10))
    posterior = accepted.withColumn("accept_rank", F.col("siminputrow")).withColumn("distance", F.lit(0.0))
    predictive = calibration.predictive_design(spark, posterior, 30)
    assert predictive.count() == 30 and {"siminputrow", "seed_value", *params} <= set(predictive.columns)


# ---- shapes and files -------------------------------------------------------------------------------------------


def test_transpose_twice_is_identity(spark):
    df = spark.createDataFrame([("a", 1.0, 2.0), ("b", 3.0, 4.0)], "name string, x double, y double")
    once = reshape.transpose(df, "name", ["x", "y"])
    back = reshape.transpose(once, "param", ["a", "b"], out="name")
    assert rows_of(back, "name", "x", "y") == rows_of(df, "name", "x", "y")


def test_complete_cells(spark):
    df = spark.createDataFrame([(1, "x", 1.0), (2, "y", 2.0)], "k long, n string, v double")
    assert sorted((r["k"], r["n"], r["v"] or -1) for r in reshape.complete_cells(df, ["k"], "n", "v").collect()) == [(1, "x", 1.0), (1, "y", -1), (2, "x", -1), (2, "y", 2.0)]


def test_param_file_has_one_line_per_parameter_at_any_size(spark, tmp_path, monkeypatch):
    posterior = spark.range(25).select((F.col("id") + 1).alias("accept_rank"), (F.col("id") * 0.5).alias("o_rate"), (F.col("id") * 2.0).alias("mean_delay"))
    names = ["o_rate", "mean_delay"]
    want = sorted((n, r["accept_rank"], r[n]) for r in posterior.collect() for n in names)
    tables.write_param_file(posterior, names, str(tmp_path / "one"))
    lines = [r["value"] for r in spark.read.text(str(tmp_path / "one")).collect()]
    assert len(lines) == 2 and lines[0].startswith('"o-rate",0.0,0.5,1.0,')
    assert rows_of(tables.param_long(tables.read_param_file(spark, str(tmp_path / "one"))), "param", "accept_rank", "value") == want
    monkeypatch.setattr(tables, "SETS_PER_CHUNK", 10)
    tables.write_param_file(posterior.repartition(4), names, str(tmp_path / "many"))
    params = tables.read_param_file(spark, str(tmp_path / "many"))
    assert [r["value"] for r in spark.read.text(str(tmp_path / "many")).collect()] == lines
    assert {r["param"]: r["value"] for r in tables.param_means(params).collect()} == {"o_rate": 6.0, "mean_delay": 24.0}
    tables.export_single_set(posterior, names, 3, str(tmp_path / "single"))
    assert {r["param"]: r["value"] for r in tables.param_means(tables.read_param_file(spark, str(tmp_path / "single"))).collect()} == {"o_rate": 1.0, "mean_delay": 4.0}


def test_param_file_of_many_sets_is_plain_csv(spark, tmp_path):
    posterior = spark.range(100_000).select((F.col("id") + 1).alias("accept_rank"), (F.col("id") % 1000 * 0.001).alias("o_rate"), F.when(F.col("id") != 77_777, F.col("id") * 1.0).alias("late"))
    tables.write_param_file(posterior, ["o_rate", "late"], str(tmp_path / "f"))
    files = [f for f in (tmp_path / "f").iterdir() if f.name.startswith("part-")]
    assert len(files) == 1
    with files[0].open() as f:
        rows = list(csv.reader(f))
    assert [r[0] for r in rows] == ["o-rate", "late"] and [len(r) for r in rows] == [100_001, 100_001]
    assert [float(x) if x else None for x in rows[1][1:]] == [None if i == 77_777 else float(i) for i in range(100_000)]


def test_param_file_sends_numbers_to_the_task_that_writes(spark):
    posterior = spark.range(25).select((F.col("id") + 1).alias("accept_rank"), F.when(F.col("id") != 3, F.col("id") * 0.5).alias("o_rate"))
    row = tables.param_values(posterior, ["o_rate"]).first()
    assert (row["position"], row["param"]) == (1, "o_rate") and row["chunks"] == [[None if i == 3 else i * 0.5 for i in range(25)]]


def test_results_are_published_together(spark, tmp_path):
    root = str(tmp_path / "results")
    one = tables.save_results({"a": spark.range(3), "b": spark.range(2)}, root)
    pinned = tables.load_results(spark, root)
    broken = spark.range(5).select(F.raise_error(F.lit("lost")).cast("long").alias("id"))
    with pytest.raises(Exception, match="lost"):
        tables.save_results({"a": spark.range(9), "b": broken}, root)
    assert {n: df.count() for n, df in tables.load_results(spark, root).items()} == {"a": 3, "b": 2}
    two = tables.save_results({"a": spark.range(7)}, root)
    assert {n: df.count() for n, df in tables.load_results(spark, root).items()} == {"a": 7} and two > one
    assert {n: df.count() for n, df in pinned.items()} == {"a": 3, "b": 2} == {n: df.count() for n, df in tables.load_results(spark, root, one).items()}
    with pytest.raises(ValueError, match="no results"):
        tables.load_results(spark, root, "never")


def test_simulator_csv(spark, tmp_path):
    path = tmp_path / "runs.csv"
    path.write_text("siminputrow,random-seed,[step],total-hospital-infections,current-inpatients,outbreak?,o-rate\n1,-5,32,7,100,1,0.25\n")
    row = tables.read_simulator_csv(spark, str(path), "stage").first()
    assert (row["random_seed"], row["step"], row["total_hospital_infections"], row["current_inpatients"], row["o_rate"], row["experiment"]) == (-5, 32, 7, 100.0, 0.25, "stage")
    assert (table_name("outbreak?"), table_name("[step]"), file_name("o_rate")) == ("outbreak", "step", "o-rate")


def test_simulator_csv_is_written_compressed_in_bounded_files(spark, tmp_path):
    runs = spark.range(50).select((F.col("id") % 5).alias("siminputrow"), F.lit(-5).cast("long").alias("random_seed"), F.col("id").cast("int").alias("step"), (F.col("id") * 2).alias("total_hospital_infections"), (100.0 + F.col("id")).alias("current_inpatients"))
    path = tmp_path / "runs"
    tables.write_simulator_csv(runs.coalesce(1), str(path), rows_per_file=20)
    files = [f.name for f in path.iterdir() if f.name.startswith("part-")]
    assert len(files) == 3 and all(f.endswith(".csv.gz") for f in files)
    back = tables.read_simulator_csv(spark, str(path), "stage")
    assert rows_of(back, *runs.columns) == rows_of(runs, *runs.columns) and back.filter("experiment = 'stage'").count() == 50


def test_results_round_trip(spark, tmp_path):
    tables.save_results({"a": spark.range(3), "b": spark.range(5)}, str(tmp_path))
    assert {n: df.count() for n, df in tables.load_results(spark, str(tmp_path)).items()} == {"a": 3, "b": 5}


def test_selectors(spark):
    df = spark.createDataFrame([(1, 2, 3)], "b long, o_x long, a long")
    assert selectors.sort_columns(df).columns == ["a", "b", "o_x"]
    assert selectors.relocate(df, "a", after="b").columns == ["b", "a", "o_x"]
    assert selectors.prefix_unprefixed(df).columns == ["b_b", "o_x", "b_a"]
    with pytest.raises(ValueError, match="not found"):
        selectors.all_of(df, ["zz"])


# ---- densities --------------------------------------------------------------------------------------------------


def test_density_matches_the_direct_sum(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(5, 2, 400)
    df = spark.createDataFrame([("p", "a", float(v)) for v in x] + [("p", "b", float(v)) for v in x[:40] + 3], "f string, g string, value double")
    got = density.densities(df, ["f"], ["f", "g"]).filter("g = 'a'").orderBy("i").toPandas()
    q75, q25 = np.percentile(x, [75, 25])
    bw = 0.9 * min(x.std(ddof=1), (q75 - q25) / 1.34) * len(x) ** -0.2
    exact = np.exp(-0.5 * ((got["x"].to_numpy()[:, None] - x[None, :]) / bw) ** 2).mean(axis=1) / (bw * math.sqrt(2 * math.pi))
    assert len(got) == 512 and got["scaled"].max() == 1.0
    assert np.abs(got["density"] - exact).max() < 1e-3 * exact.max()
    assert got["x"].max() == pytest.approx(max(x.max(), (x[:40] + 3).max()))


# ---- hospital ---------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def stay_rows():
    rng = random.Random(8)
    rows = []
    for i in range(400):
        admit = DAY + dt.timedelta(rng.randrange(60))
        discharge = admit + dt.timedelta(rng.randrange(0, 9))  # zero-day stays included
        caught = admit + dt.timedelta(rng.randrange(-1, 9)) if rng.random() < 0.4 else None
        bed = 1 if rng.random() < 0.35 else rng.randrange(2, 30)  # one bed with a third of the stays
        rows.append((i, 1 + bed % 3, bed, admit, discharge, rng.random() < 0.2, caught, rng.random() < 0.5))
    return rows


STAYS = "stay_id long, ward int, bed int, admit date, discharge date, community_infection boolean, hospital_infection_date date, antibiotic boolean"


def test_census(spark, stay_rows):
    got = {r["day"]: tuple(r)[1:] for r in hospital.daily_census(spark.createDataFrame(stay_rows, STAYS)).collect()}
    last = max(r[4] for r in stay_rows)
    for n in range((last - DAY).days + 1):
        day = DAY + dt.timedelta(n)
        here = [r for r in stay_rows if r[3] <= day < r[4]]
        caught = [r for r in here if r[6] is not None and max(r[6], r[3]) <= day]
        want = (len(here), sum(r[5] for r in here), len(caught), sum(r[5] or r in caught for r in here))
        assert got.get(day, (0, 0, 0, 0)) == want


def test_double_occupancy(spark, stay_rows):
    got = {r["stay_id"] for r in hospital.double_occupancy(spark.createDataFrame(stay_rows, STAYS)).collect()}
    want = {r[0] for r in stay_rows if any(o[1:3] == r[1:3] and (o[3], o[0]) < (r[3], r[0]) and o[4] > r[3] for o in stay_rows)}
    assert got == want and want


def test_counters_and_repeat_infections(spark, stay_rows):
    df = spark.createDataFrame(stay_rows, STAYS)
    events = hospital.cumulative_counters(df).orderBy(F.desc("day")).first()
    patients = hospital.cumulative_counters(df, distinct_patients=True).orderBy(F.desc("day")).first()
    community, caught = sum(r[5] for r in stay_rows), sum(r[6] is not None for r in stay_rows)
    assert (events["admitted"], events["colonised"], events["hospital_infections"]) == (400, community + caught, caught)
    assert patients["colonised"] == sum(r[5] or r[6] is not None for r in stay_rows)


def test_queues(spark):
    rows = [(1, DAY, 2, DAY + dt.timedelta(5)), (2, DAY, 0, DAY + dt.timedelta(1)), (3, DAY, 9, DAY + dt.timedelta(3)), (4, DAY, 1, DAY)]
    got = {r["day"]: (r["delay_queue"], r["ready_queue"]) for r in hospital.queue_lengths(spark.createDataFrame(rows, "stay_id long, entry date, delay_days int, leave date")).collect()}
    assert [got[DAY + dt.timedelta(n)] for n in range(6)] == [(2, 1), (2, 0), (1, 1), (0, 1), (0, 1), (0, 0)]


@pytest.fixture(scope="module")
def toilet_rows():
    rng = random.Random(11)
    rows = []
    for i in range(1_500):
        toilet = 1 if rng.random() < 0.4 else rng.randrange(2, 20)
        ts = dt.datetime(2024, 3, 30) + dt.timedelta(minutes=rng.randrange(3 * 1440))  # ties within a toilet occur
        kind = "clean" if rng.random() < 0.2 else "use"
        rows.append((toilet, i, ts, kind, kind == "use" and rng.random() < 0.6, round(rng.random() * 0.4, 3)))
    return rows


EVENTS = "toilet_id long, event_id long, ts timestamp_ntz, kind string, colonised boolean, amount double"


def replay(rows, effect=0.8):
    level, out = {}, {}
    for toilet, event, ts, kind, colonised, amount in sorted(rows, key=lambda r: (r[0], r[2], r[1])):
        before = level.get(toilet, 0.0)
        after = before * (1 - effect) if kind == "clean" else min(1.0, before + amount) if colonised else before
        level[toilet], out[event] = after, (before, after)
    return out


@pytest.mark.parametrize(("block_rows", "effect", "groups"), [(5, 0.8, 2), (256, 0.8, 256), (64, 1.0, 3), (256, 0.0, 256), (256, 0.999, 2)])
def test_contamination_levels(spark, toilet_rows, monkeypatch, block_rows, effect, groups):
    monkeypatch.setattr(hospital, "GROUP_BLOCKS", groups)
    events = spark.createDataFrame(toilet_rows, EVENTS).repartition(3)
    want = replay(toilet_rows, effect)
    got = hospital.contamination_levels(events, effect, block_rows=block_rows, parts=4).collect()
    assert len(got) == len(want)
    assert max(max(abs(r["level_before"] - want[r["event_id"]][0]), abs(r["level_after"] - want[r["event_id"]][1])) for r in got) < 1e-11
    last = {}
    for toilet, event, ts, *_ in sorted(toilet_rows, key=lambda r: (r[0], r[2], r[1])):
        last[toilet] = (want[event][1], last.get(toilet, (0, 0))[1] + 1)
    final = {r["toilet_id"]: (r["level"], r["events"]) for r in hospital.final_levels(events, effect, block_rows=block_rows, parts=4).collect()}
    assert final.keys() == last.keys() and all(abs(final[t][0] - last[t][0]) < 1e-11 and final[t][1] == last[t][1] for t in last)


def test_one_second_with_most_events(spark):
    """50,000 events of one toilet in one second are spread over tasks and blocks."""
    second = dt.datetime(2024, 3, 1, 12, 0, 0)
    rows = spark.range(60_000).select(
        F.when(F.col("id") < 50_000, 1).otherwise(F.col("id") % 40).cast("long").alias("toilet_id"), F.col("id").alias("event_id"), F.when(F.col("id") < 50_000, F.lit(second)).otherwise(F.lit(dt.datetime(2024, 3, 2))).alias("ts"),
        F.when(F.col("id") % 9 == 0, "clean").otherwise("use").alias("kind"), (F.col("id") % 9 != 0).alias("colonised"), (F.col("id") % 7 * 0.05).alias("amount"),
    )
    levels = hospital.contamination_levels(rows, parts=8)
    text = levels._jdf.queryExecution().executedPlan().toString()
    want = replay([tuple(r) for r in rows.collect()])
    assert max(abs(r["level_after"] - want[r["event_id"]][1]) for r in levels.collect()) < 1e-11
    placed = hospital.ordered_blocks(rows, ["toilet_id", "ts", "event_id"], 256, 8)
    sizes = placed.groupBy(F.shiftright("__block", 33).alias("part")).count().collect()
    assert len(sizes) == 8 and max(r["count"] for r in sizes) < 20_000 and placed.groupBy("__block").count().agg(F.max("count")).first()[0] <= 256
    assert text.count("Window [") == 3


@pytest.mark.parametrize("block_rows", [5, 8_192])
def test_exposure_asof(spark, toilet_rows, block_rows):
    events = spark.createDataFrame(toilet_rows, EVENTS)
    exposing = (F.col("kind") == "use") & ~F.col("colonised")
    levels = hospital.contamination_levels(events)
    want = replay(toilet_rows)
    for table in (levels.filter(~exposing), levels):  # a level of the use itself is not before it
        got = hospital.exposure_asof(events.filter(exposing), table, block_rows=block_rows, parts=5).collect()
        assert len(got) == sum(r[3] == "use" and not r[4] for r in toilet_rows)
        assert max(abs(r["exposure"] - want[r["event_id"]][0]) for r in got) < 1e-11


def test_infection_risk(spark):
    days = spark.createDataFrame([(1, DAY, True, 8.0), (2, DAY, False, 8.0)], "patient_id long, day date, antibiotic boolean, baseline double")
    uses = spark.createDataFrame([(1, DAY, True, 0.3), (1, DAY, True, 0.1)], "patient_id long, day date, antibiotic boolean, exposure double")
    got = {r["patient_id"]: r for r in hospital.infection_risk(days, uses, effect=1.5).collect()}
    novo, toilet = 1 - math.exp(-8e-4 * 1.5), 1 - math.exp(-0.4 * 1.5)
    assert got[1]["uses"] == 2 and got[2]["p_toilet"] == 0.0
    assert got[1]["p_infection"] == pytest.approx(1 - (1 - novo) * (1 - toilet))


def test_schedule_edges(spark):
    """Half-open periods, control over outbreak, baseline after control even while the outbreak lasts."""
    one = spark.createDataFrame([(1, 10.0, 40.0, 20.0, 30.0, 1.0, 2.0, 3.0, 5.0, 6.0)], "siminputrow long, outbreak_start double, outbreak_end double, control_start double, control_end double, toilet_cleaning_rate double, o_toilet_cleaning_rate double, c_toilet_cleaning_rate double, toilet_frequenting_rate double, o_toilet_frequenting_rate double")
    days = spark.createDataFrame([(1, t) for t in (10, 11, 20, 21, 30, 31, 40, 41)], "siminputrow long, step int")
    got = hospital.scheduled_parameters(days, one).orderBy("step").collect()
    assert [r["now_toilet_cleaning_rate"] for r in got] == [1.0, 2.0, 2.0, 3.0, 3.0, 1.0, 1.0, 1.0]
    assert [r["now_toilet_frequenting_rate"] for r in got] == [5.0, 6.0, 6.0, 6.0, 6.0, 6.0, 6.0, 5.0]


def test_layout_allocation_clamps(spark):
    wards = spark.range(1, 4).withColumnRenamed("id", "ward")
    assert hospital.allocate_evenly(wards, 4, 1.0).filter("is_bay").count() == 12
    assert rows_of(hospital.allocate_evenly(wards, 4, 0.4).filter("is_bay").groupBy("ward").count(), "ward", "count") == [(1, 2), (2, 1), (3, 1)]


def _covering(t, rows):
    hits = [(-p, n, a, b, v) for n, a, b, p, v in rows if t is not None and a < t <= b]
    return (min(hits)[1], min(hits)[4]) if hits else (None, None)


def test_period_lookup_against_every_pair(spark):
    rng = random.Random(8)
    periods = [(f"p{i}", a, a + rng.choice([0.0, 0.5, 1.0, 7.25, 60.0, 400.0]), rng.randrange(4), float(i)) for i in range(300) for a in [rng.choice([rng.uniform(-50, 520), float(rng.randrange(500))])]]
    periods += [("all", float("-inf"), float("inf"), -1, -1.0), ("never", 5.0, 5.0, 9, 0.0), ("back", 9.0, 3.0, 9, 0.0)]
    points = [*range(-5, 520), None, 77, 77]
    table = spark.createDataFrame(periods, "name string, t_from double, t_to double, priority int, rate double")
    got = hospital.period_lookup(spark.createDataFrame([(t,) for t in points], "t int"), table, "t", ["rate"])
    assert sorted(((r["t"] is None, r["t"], r["period"], r["rate"]) for r in got.collect()), key=str) == sorted(((t is None, t, *_covering(t, periods)) for t in points), key=str)
    assert not {"CartesianProduct", "NestedLoop"} & set(got._jdf.queryExecution().executedPlan().toString().split())
    empty = hospital.period_lookup(spark.createDataFrame([(1,)], "t int"), table.limit(0), "t", ["rate"])
    assert [tuple(r) for r in empty.collect()] == [(1, None, None)]
    assert hospital.period_lookup(spark.createDataFrame([], "t int"), table, "t", ["rate"]).count() == 0


def test_period_lookup_by_key_and_date(spark):
    rng = random.Random(9)
    day = lambda n: dt.date(2020, 1, 1) + dt.timedelta(n)
    periods = [(rng.choice([1, 2, None]), f"p{i}", a, a + rng.randrange(9), rng.randrange(3), float(i)) for i in range(80) for a in [rng.randrange(60)]]
    points = [(k, rng.randrange(60)) for k in (1, 2, 3, None) for _ in range(40)]
    table = spark.createDataFrame([(k, n, day(a), day(b), p, v) for k, n, a, b, p, v in periods], "ward int, name string, t_from date, t_to date, priority int, rate double")
    got = hospital.period_lookup(spark.createDataFrame([(k, day(t)) for k, t in points], "ward int, day date"), table, "day", ["rate"], ["ward"])
    want = [(k, day(t), *_covering(t, [x[1:] for x in periods if x[0] == k])) for k, t in points]
    assert sorted(map(str, (tuple(r) for r in got.collect()))) == sorted(map(str, want))


def test_a_million_periods(spark):
    periods = spark.range(1_000_000).select(
        F.concat(F.lit("p"), F.col("id").cast("string")).alias("name"), (F.col("id") - 0.5).alias("t_from"), (F.col("id") + 0.5 + F.when(F.col("id") % 1000 == 0, 500_000.0).otherwise(0.0)).alias("t_to"),
        F.when(F.col("id") % 1000 == 0, 0).otherwise(1).alias("priority"), F.col("id").alias("rate"),
    )
    points = spark.range(0, 1_400_000, 7).select(F.col("id").alias("t"))
    got = hospital.period_lookup(points, periods, "t", ["rate"])
    right = F.when((F.col("t") < 1_000_000) & (F.col("t") % 1000 != 0), F.col("rate") == F.col("t")).otherwise(F.col("rate") % 1000 == 0)
    assert got.filter(right).count() == 200_000
