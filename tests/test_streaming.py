"""Streams against batch results, with repeated, late and out-of-order rows over several micro-batches."""

import datetime as dt
import os
import random
import uuid

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from test_operators import replay

from wardlight.operators import rates
from wardlight.streaming import contamination, monthly

RUNS = "siminputrow long, random_seed long, step int, total_hospital_infections long, current_inpatients double, ts timestamp"


def test_monthly_stream_over_batches(spark, tmp_path):
    source, out, checkpoint = (str(tmp_path / n) for n in ("source", "out", "checkpoint"))
    start = dt.datetime(2002, 1, 1)
    rows = [(s, k, 32 + d, d * (s + 1) // 3, 100.0 + d % 5, start + dt.timedelta(days=d)) for s in range(3) for k in range(2) for d in range(300)]
    first, second = [r for r in rows if r[2] < 180], [r for r in rows if r[2] >= 180]
    repeated = [r for r in first if r[2] >= 160]
    late = [(0, 0, 9_999, 10**6, 1.0, start + dt.timedelta(days=3))]
    for batch in (first, second + repeated, late):
        spark.createDataFrame(batch, RUNS).coalesce(2).write.mode("append").parquet(source)
        stream = spark.readStream.schema(RUNS).parquet(source)
        query = monthly.start_monthly(stream, out, checkpoint)
        query.awaitTermination()
    # of 300 days of 6 runs the state holds those of the delay, and keys of repeated rows for twice as long
    held = sorted(op["numRowsTotal"] for op in query.lastProgress["stateOperators"])
    assert 0 < held[0] <= 6 * 48 and 0 < held[1] <= 6 * 93
    got = monthly.latest_rates(spark, out)
    want = rates.monthly_rate(spark.createDataFrame(rows, RUNS).withColumn("date_sim", F.to_date("ts")))
    columns = ["siminputrow", "random_seed", "month", "n_days", "rate"]
    assert sorted(map(tuple, got.select(columns).collect())) == sorted(map(tuple, want.select(columns).collect()))


def test_monthly_deliveries_bound_the_state(spark, tmp_path):
    source, out, checkpoint = (str(tmp_path / n) for n in ("source", "out", "checkpoint"))
    start = dt.datetime(2002, 1, 1)
    rows = [(s, 0, 32 + d, d * (s + 1) // 3, 100.0 + d % 5, start + dt.timedelta(days=d)) for s in range(3) for d in range(900)]
    random.Random(2).shuffle(rows)  # each file holds all times
    stored = spark.createDataFrame(rows, RUNS).repartition(5)
    queries = monthly.run_deliveries(stored, source, out, checkpoint, months=3, twice=F.year("ts") == 2003)
    progress = [p for q in queries for p in q.recentProgress]
    assert max(p["numInputRows"] for p in progress) <= 3 * 92 and sum(p["numInputRows"] for p in progress) == 3 * (900 + 365)
    # a delivery and twice the delay are held, not all 900 days; the sums have a row for 16 days and month, not for each day
    held = [sorted(op["numRowsTotal"] for op in p["stateOperators"]) for p in progress if p["stateOperators"]]
    assert max(h[1] for h in held) <= 3 * (92 + 92 + 92) and max(h[0] for h in held) <= 3 * 30
    got = monthly.latest_rates(spark, out)
    want = rates.monthly_rate(spark.createDataFrame(rows, RUNS).withColumn("date_sim", F.to_date("ts")))
    columns = ["siminputrow", "random_seed", "month", "n_days", "rate"]
    assert sorted(map(tuple, got.select(columns).collect())) == sorted(map(tuple, want.select(columns).collect()))
    assert spark.read.parquet(out).count() < 900


def test_deliveries_compute_the_rows_once(spark, tmp_path):
    source, out, checkpoint, counts = (str(tmp_path / n) for n in ("source", "out", "checkpoint", "counts"))
    os.mkdir(counts)

    def counted(batches):
        for batch in batches:
            with open(f"{counts}/{uuid.uuid4().hex}", "w") as f:
                f.write(str(batch.num_rows))
            yield batch

    start = dt.datetime(2002, 1, 1)
    rows = [(s, 0, 32 + d, d * (s + 1) // 3, 100.0, start + dt.timedelta(days=d)) for s in range(2) for d in range(400)] + [(5, 0, 7, 1, 100.0, None)]
    queries = monthly.run_deliveries(spark.createDataFrame(rows, RUNS).mapInArrow(counted, RUNS), source, out, checkpoint, twice=F.month("ts") == 3)
    assert sum(int((tmp_path / "counts" / f).read_text()) for f in os.listdir(counts)) == len(rows)
    read = [sum(p["numInputRows"] for p in q.recentProgress) for q in queries]
    assert read == [1, 2 * 181, 2 * 31, 2 * 184, 2 * 35]  # no time, half a year, March again, the rest
    assert "__delivery" not in spark.read.parquet(source).columns
    got = monthly.latest_rates(spark, out).filter("month is not null")
    want = rates.monthly_rate(spark.createDataFrame(rows[:-1], RUNS).withColumn("date_sim", F.to_date("ts")))
    columns = ["siminputrow", "random_seed", "month", "n_days", "rate"]
    assert sorted(map(tuple, got.select(columns).collect())) == sorted(map(tuple, want.select(columns).collect()))


def test_no_deliveries(spark, tmp_path):
    source, out, checkpoint = (str(tmp_path / n) for n in ("source", "out", "checkpoint"))
    monthly.run_deliveries(spark.createDataFrame([], RUNS), source, out, checkpoint)
    assert monthly.latest_rates(spark, out).count() == 0


EVENTS = "toilet_id long, event_id long, ts timestamp, kind string, colonised boolean, amount double"


@pytest.fixture(params=["UTC", "America/New_York"])
def zone(request, spark):
    spark.conf.set("spark.sql.session.timeZone", request.param)
    yield request.param
    spark.conf.set("spark.sql.session.timeZone", "UTC")


@pytest.mark.parametrize("batches", [1, 4])
def test_contamination_stream_over_batches(spark, tmp_path, batches, zone):
    source, out, checkpoint = (str(tmp_path / n) for n in ("source", "out", "checkpoint"))
    rng = random.Random(4)
    start = dt.datetime(2024, 1, 1)
    rows = []
    for i in range(600):
        kind = "clean" if rng.random() < 0.2 else "use"
        rows.append((rng.randrange(5), i, start + dt.timedelta(seconds=i * 60), kind, kind == "use" and rng.random() < 0.7, round(rng.random() * 0.4, 3)))
    size = len(rows) // batches
    parts = [rows[i * size : (i + 1) * size] for i in range(batches)]
    for i in range(batches - 1):  # the last rows of a batch arrive with the next one, still inside the watermark
        held, parts[i] = parts[i][-20:], parts[i][:-20]
        parts[i + 1] = held + parts[i + 1]
    late = [(1, 9_999, start + dt.timedelta(seconds=1), "clean", False, 0.0)] if batches > 1 else []
    for i, part in enumerate(parts):
        rng.shuffle(part)
        spark.createDataFrame(part + (late if i == batches - 1 else []), EVENTS).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(EVENTS).parquet(source)
        query = contamination.contamination_stream(stream, "1 hour").writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
        query.outputMode("append").trigger(availableNow=True).start().awaitTermination()
    want = replay(rows)
    emitted = spark.read.parquet(out)
    done = (max(r[2] for r in rows) - dt.timedelta(hours=1)).replace(second=0)
    done -= dt.timedelta(minutes=done.minute % 10)
    got = {r["event_id"]: (r["level_before"], r["level_after"]) for r in emitted.collect()}
    assert set(got) == {e for e in want if rows[e][2] < done}
    closing = contamination.closing_levels(spark.read.parquet(source), emitted, "1 hour").collect()
    assert {r["event_id"] for r in closing} == set(want) - set(got)
    got.update({r["event_id"]: (r["level_before"], r["level_after"]) for r in closing})
    assert max(abs(got[e][0] - want[e][0]) + abs(got[e][1] - want[e][1]) for e in want) < 1e-11


@pytest.mark.parametrize("effect", [0.0, 0.3, 0.8, 1.0])
def test_vectorised_levels(effect):
    r = np.random.default_rng(2)
    clean = r.random(3_000) < 0.6
    added = np.where(clean, 0.0, r.random(3_000))
    level, want = 0.25, []
    for c, a in zip(clean, added, strict=True):
        level = level * (1 - effect) if c else min(1.0, level + a)
        want.append(level)
    assert np.abs(contamination.replay_levels(0.25, clean, added, effect) - want).max() < 1e-11


class _Calls:
    """A state handle that keeps one key's state in memory and counts the calls to it."""

    def __init__(self):
        self.n, self.timers = 0, []

    def __getattr__(self, name):
        if name in ("getValueState", "getListState", "getMapState"):
            return lambda label, *_: _State(self)
        self.n += 1
        return {"registerTimer": self.timers.append, "deleteTimer": self.timers.remove}[name]


class _State:
    def __init__(self, calls):
        self.calls, self.kept = calls, None

    def __getattr__(self, name):
        self.calls.n += 1

        def put(value):
            self.kept = value

        def append(value):
            self.kept = [*(self.kept or []), *value]

        return {
            "exists": lambda: self.kept is not None, "get": lambda: self.kept, "update": put, "put": put, "appendList": append, "clear": lambda: put(None),
            "containsKey": lambda k: False, "updateValue": lambda k, v: None,
        }[name]


class _Times:
    def __init__(self, watermark):
        self.watermark = watermark

    def getCurrentWatermarkInMs(self):
        return self.watermark

    def getExpiryTimeInMs(self):
        return self.watermark - 1


def test_calls_to_the_state_do_not_grow_with_events():
    """Events that all stand in time buckets of their own: a batch and a pass of the watermark take a few calls each, not some for each event."""
    events = pd.DataFrame({"micros": [i * 900_000_000 for i in range(500)], "event_id": range(500), "kind": "use", "colonised": True, "amount": 0.125})
    replayed, calls = contamination.ContaminationReplay(), _Calls()
    replayed.init(calls)
    assert list(replayed.handleInputRows((1,), iter([events]), _Times(0))) == []
    assert calls.n < 10 and calls.timers == [600_000 - 1]
    out = next(replayed.handleExpiredTimer((1,), _Times(300 * 900_000), _Times(600_000)))
    assert out["event_id"].tolist() == list(range(300)) and out["level_after"].tolist()[:9] == [min(1.0, 0.125 * (i + 1)) for i in range(9)]
    assert calls.n < 20
