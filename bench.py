"""Headline queries on one machine; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default: all cores) set the data and the cores.
Each query is run BENCH_REPEATS times (default 2) and the fastest run counts; results are fully computed and
discarded (noop sink).
"""

from __future__ import annotations

import json
import os
import time
from pathlib import Path

from wardlight.catalog import build_registry
from wardlight.session import build_session

HEADLINE = [
    "e1_monthly_rate", "e2_mean_over_seeds", "e5_outbreak_cases", "e7_quantile_band", "e7_quantile_band_selected", "c2_assign_dates", "h1_first_per_key",
    "j4_accept", "r2_stage_two_posterior", "b6_latin_hypercube", "b14_priors_from_posterior", "g3_complete_cells", "k1_density",
    "l1_daily_census", "l6_double_occupancy", "l8_final_levels", "l9_infection_risk", "l11_period_params",
    "c2_assign_dates_stretches", "l11_interval_join", "r7_two_stage",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count()))
    repeats = int(os.environ.get("BENCH_REPEATS", "2"))
    spark = build_session("bench", f"local[{cpus}]", {
        "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "16g",
    })
    spark.sparkContext.setLogLevel("ERROR")
    queries = build_registry().queries
    spark.range(1000).selectExpr("sum(id)").collect()
    seconds = {}
    for name in HEADLINE:
        runs = []
        for _ in range(repeats):
            start = time.perf_counter()
            queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - start)
        seconds[name] = round(min(runs), 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": Path(sf_dir).name.removeprefix("sf")}))


if __name__ == "__main__":
    main()
