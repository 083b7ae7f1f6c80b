"""Published and recomputed values of the study's two small data files."""

import pytest
from pyspark.sql import functions as F

from wardlight.operators import abc, design, hospital, summary, timeline
from wardlight.sources import tables

# --- fixed values: observed monthly rates per 1000 patient-days, 2002-01 to 2008-05 ------------------------------
RATES = [
    2.2843, 0.991, 1.4055, 0.3891, 1.1035, 1.887, 1.4707, 1.8851, 1.3764, 0.1064, 0.936, 0.6605,
    0.98, 1.2813, 0.8683, 2.1767, 0.5732, 0.7279, 0.7545, 0.6435, 1.1921, 1.2735, 1.1718, 1.1707,
    2.2595, 1.0681, 1.5616, 1.4507, 1.3582, 3.152, 1.8507, 2.3442, 1.5557, 4.6408, 5.4274, 4.3367,
    3.4474, 2.9427, 3.8391, 3.6367, 2.3262, 1.7391, 1.3536, 1.3435, 1.3424, 1.0485, 1.3405, 1.4494,
    1.7231, 1.2185, 1.7211, 1.4455, 1.298, 1.3885, 1.3327, 1.7163, 1.0467, 1.3205, 0.7518, 1.639,
    1.0519, 2.1682, 1.2332, 1.0124, 0.8283, 0.7633, 0.6249, 0.8253, 1.1174, 0.9241, 0.6209, 0.9496,
    0.9761, 0.7645, 0.6811, 0.552, 1.1187,
]
# accepted values of four parameters (25 sets)
ACCEPTED = {
    "outbreak-start": [
        1011.21, 1083.496, 1089.819, 1079.574, 1007.388, 966.549, 1056.284, 1077.691, 939.867, 1071.382, 933.795, 1001.678, 1036.722,
        974.75, 1034.739, 1034.018, 1056.403, 1041.225, 1093.869, 1030.702, 1017.678, 955.427, 1084.621, 1024.763, 1045.396,
    ],
    "outbreak-end": [
        1166.418, 1321.696, 1332.883, 1214.199, 1304.129, 1279.596, 1274.446, 1224.461, 1182.935, 1234.854, 1210.115, 1217.464, 1281.528,
        1227.804, 1181.208, 1259.592, 1248.258, 1228.404, 1314.319, 1292.367, 1173.046, 1291.715, 1217.367, 1260.41, 1230.511,
    ],
    "control-end": [
        1307.77, 1329.041, 1347.535, 1324.383, 1328.548, 1320.524, 1356.352, 1364.46, 1328.477, 1334.287, 1365.185, 1347.391, 1307.812,
        1318.512, 1355.969, 1342.138, 1336.539, 1323.443, 1358.523, 1344.549, 1345.848, 1316.212, 1309.042, 1328.451, 1348.335,
    ],
    "toilet-cleaning-rate": [
        2.55, 2.551, 2.349, 2.378, 2.726, 2.209, 2.568, 1.925, 2.147, 2.213, 2.142, 2.54, 2.714,
        2.251, 2.64, 2.359, 2.556, 2.159, 2.376, 2.612, 2.684, 2.417, 2.235, 2.087, 1.883,
    ],
}
# --- end of fixed values -----------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def observed(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("observed") / "series.csv"
    path.write_text("x,rates\n" + "".join(f"{i + 0.957},{r}\n" for i, r in enumerate(RATES)))
    return tables.read_observed(spark, str(path)).cache()


@pytest.fixture(scope="module")
def parameters(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("params") / "params.csv"
    path.write_text("".join(f'"{n}",' + ",".join(map(str, v)) + "\n" for n, v in ACCEPTED.items()))
    return tables.read_param_file(spark, str(path)).cache()


@pytest.fixture(scope="module")
def posterior(parameters):
    return tables.param_long(parameters).groupBy("accept_rank").pivot("param").agg(F.first("value")).cache()


def test_observed_series(observed):
    rows = observed.orderBy("month").collect()
    assert len(rows) == 77
    assert (str(rows[0]["month"]), rows[0]["rate"]) == ("2002-01-01", 2.2843)
    assert (str(rows[-1]["month"]), rows[-1]["rate"]) == ("2008-05-01", 1.1187)


def test_period_summary(observed):
    rows = {r["period"]: r for r in summary.period_summary(observed, "month", "rate", "2004-10-01", "2005-05-31").collect()}
    before, during = rows["pre_outbreak"], rows["outbreak"]
    assert (before["n"], during["n"]) == (33, 8)
    assert [round(before[c], 4) for c in ("q_low", "median", "q_high")] == [0.936, 1.2735, 1.5616]
    assert [round(during[c], 6) for c in ("q_low", "median", "q_high", "min", "max")] == [3.321225, 3.7379, 4.412725, 2.3262, 5.4274]


def test_parameter_means(parameters):
    means = {r["param"]: r["value"] for r in tables.param_means(parameters).collect()}
    assert means == {"outbreak_start": 1029.962, "outbreak_end": 1246.789, "control_end": 1335.573, "toilet_cleaning_rate": 2.371}


def test_priors_from_posterior(posterior):
    row = design.priors_from_posterior(posterior, ["toilet_cleaning_rate"]).first()
    assert [round(row[c], 3) for c in ("min", "max")] == [2.209, 2.556]
    assert round(row["sd"], 4) == 0.2407
    stats = summary.column_summary(posterior, ["toilet_cleaning_rate"]).first()
    assert round(stats["median"], 3) == 2.376


def test_step_window(posterior):
    row = timeline.step_window(posterior).first()
    assert (row["step_from"], row["step_to"]) == (1030, 1336)


def test_time_triggers(spark):
    row = design.time_triggers(spark.range(1)).first()
    assert (row["outbreak_start"], row["control_start"], row["outbreak_end"], row["control_end"]) == (1004, 1049, 1246, 1336)


@pytest.mark.parametrize(("n", "tol", "k"), [(800, 0.05, 40), (1000, 0.025, 25), (50, 0.2, 10)])
def test_accepted_count(n, tol, k):
    assert abc.accepted_count(n, tol) == k


def test_hospital_layout(spark):
    wards = spark.range(1, 25).withColumnRenamed("id", "ward")
    rooms = hospital.allocate_evenly(wards, 18, 0.13).cache()
    row = hospital.layout_summary(rooms).first()
    assert (row["wards"], row["bays"], row["side_rooms"], row["capacity"], row["median_capacity"]) == (24, 56, 376, 600, 24.0)
    per_ward = rooms.groupBy("ward").agg(F.count_if("is_bay").alias("bays")).groupBy("bays").count().collect()
    assert {r["bays"]: r["count"] for r in per_ward} == {3: 8, 2: 16}
    assert rooms.filter("is_bay").agg(F.max("room")).first()[0] == 3


def test_simulated_dates(spark):
    """1125 ticks end on 2004-12-29, 2585 on 2008-12-28."""
    for ticks, last in ((1125, "2004-12-29"), (2585, "2008-12-28")):
        runs = spark.range(1, ticks + 1).select(F.lit(1).alias("siminputrow"), F.lit(1).alias("random_seed"), F.col("id").cast("int").alias("step"))
        dated = timeline.assign_dates(timeline.drop_burn_in(runs))
        assert str(dated.agg(F.max("date_sim")).first()[0]) == last
