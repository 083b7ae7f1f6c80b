"""Rows per second of the core operators on larger stored run tables.

``python bench_scale.py 4 35`` copies the sf0.1 run table (7.7 M daily rows) 4 and 35 times under new keys, stores it, and
times the monthly rate, the outbreak cases and a whole rejection stage on it; then the same with one run that holds a
third of all rows.  Prints one JSON line per table.
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import functions as F

from wardlight.operators import abc, rates, timeline
from wardlight.plans.calibration import run_rates
from wardlight.session import build_session, materialize, scratch_path
from wardlight.sources import derived, tables


def timed(action) -> float:
    start = time.perf_counter()
    action()
    return round(time.perf_counter() - start, 2)


def sink(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def measure(spark, runs, posterior, label: str) -> None:
    rows = runs.count()
    seconds = {
        "rate_gapless": timed(lambda: sink(run_rates(runs, "gapless"))),
        "rate_auto": timed(lambda: sink(run_rates(runs, "auto"))),
        "rate_stretches": timed(lambda: sink(run_rates(runs, "stretches"))),
        "rate_position": timed(lambda: sink(run_rates(runs, "position"))),
        "cases": timed(lambda: sink(rates.outbreak_cases(timeline.in_step_window(runs, timeline.step_window(posterior)), rates.RUN_KEYS))),
    }

    def stage() -> None:
        stats = materialize(rates.mean_over_seeds(run_rates(runs, "gapless")).filter(F.col("month") < "2008-06-01"), "statistics")
        target = stats.groupBy("month").agg(F.avg("rate").alias("rate"))
        sink(abc.reject(stats, target, 0.025).accepted)

    seconds["rejection_stage"] = timed(stage)
    print(json.dumps({"table": label, "rows": rows, "seconds": seconds, "rate_rows_per_second": int(rows / seconds["rate_gapless"])}), flush=True)


def main() -> None:
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count()))
    spark = build_session("bench-scale", f"local[{cpus}]", {
        "spark.sql.shuffle.partitions": str(4 * int(cpus)), "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "20g",
    })
    spark.sparkContext.setLogLevel("ERROR")
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    base, posterior = materialize(derived.runs(spark, sf_dir), "base"), derived.posterior(spark, sf_dir)
    for copies in map(int, sys.argv[1:] or ["4"]):
        path = scratch_path(spark, "runs")
        spread = base.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
        tables.write_runs(spread.withColumn("siminputrow", F.col("siminputrow") + F.col("copy") * 1_000_000).drop("copy"), path)
        measure(spark, tables.read_runs(spark, path), posterior, f"{copies} copies")
    # one run with a third of all rows: a third of the runs become consecutive stretches of run (0, 0)
    third = (F.col("siminputrow") % 3 == 0)
    hot = base.withColumn("step", F.when(third, F.col("step") + (F.col("siminputrow") * 3 + F.col("random_seed")).cast("int") * derived.DAYS).otherwise(F.col("step")))
    hot = hot.withColumns({"siminputrow": F.when(third, F.lit(0)).otherwise(F.col("siminputrow")).cast("long"), "random_seed": F.when(third, F.lit(0)).otherwise(F.col("random_seed")).cast("long")})
    path = scratch_path(spark, "hot")
    tables.write_runs(hot, path)
    measure(spark, tables.read_runs(spark, path), posterior, "one run with a third of the rows")


if __name__ == "__main__":
    main()
