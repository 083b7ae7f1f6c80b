"""Readers and writers: run output, observed series, parameter files, result sets."""

from __future__ import annotations

import time
import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from wardlight.functions.scans import row_index
from wardlight.operators.reshape import pivot_longer
from wardlight.schema import OBSERVED_FILE, RUN_KEYS, file_name, table_name

FIRST_MONTH = "2002-01-01"
SETS_PER_CHUNK = 10_000
CSV_ROWS = 4_000_000
INDEX = "_results"
MANIFEST = "version string, names array<string>"


def write_runs(runs: DataFrame, path: str, mode: str = "errorifexists", dealt: bool = False) -> None:
    """Run output as Parquet, one folder per experiment, sorted by run and step inside each file.

    The rebalance hint lets the adaptive plan split a large experiment over many files and keep small ones together. ``dealt`` says that ``runs`` stand in
    partitions of few experiments and no great size already: no row is moved then, and a task writes a file for each experiment that it holds.
    """
    spread = runs if dealt else runs.hint("rebalance", "experiment")
    spread.sortWithinPartitions("experiment", *RUN_KEYS, "step").write.mode(mode).partitionBy("experiment").parquet(path)


def write_clustered_runs(runs: DataFrame, name: str, path: str, buckets: int, keys: Sequence[str] = RUN_KEYS, dealt: bool = False) -> None:
    """Run output as a table of the session's catalog, its rows dealt to ``buckets`` files by run and sorted by step.

    ``dealt`` says that ``runs`` stand in ``buckets`` partitions by ``keys`` already (``repartition(buckets, *keys)`` before they were exploded), so no row is moved again.

    Rates, dates and cases of runs then need no exchange: all rows of a run stand in one bucket. That suits tables of many runs; one run with a large share of the rows
    makes a large bucket, for which ``write_runs`` is the better form. The folder at ``path`` stays when the table is dropped.
    """
    by_bucket = runs if dealt else runs.repartition(buckets, *keys)
    by_bucket.write.option("path", path).bucketBy(buckets, *keys).sortBy(*keys, "step").saveAsTable(name)


def attach_clustered_runs(spark: SparkSession, name: str, path: str, schema: StructType, buckets: int, keys: Sequence[str] = RUN_KEYS) -> DataFrame:
    """The table that ``write_clustered_runs`` left at ``path``, made known to another session's catalog."""
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    listed = ", ".join(f"`{k}`" for k in keys)
    spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY ({listed}) SORTED BY ({listed}, `step`) INTO {buckets} BUCKETS LOCATION '{path}'")
    return spark.table(name)


def read_runs(spark: SparkSession, path: str, experiment: str | None = None) -> DataFrame:
    """Stored run output; a given experiment reads its folder only."""
    runs = spark.read.parquet(path)
    return runs if experiment is None else runs.filter(F.col("experiment") == experiment)


def write_simulator_csv(runs: DataFrame, path: str, rows_per_file: int = CSV_ROWS) -> None:
    """Run output as CSV under the simulator's own column names, as ``read_simulator_csv`` takes it.

    Files are gzip files: counters that mostly repeat shrink to a fraction of their text. Such a file is read by one task, so none has more than ``rows_per_file`` rows.
    """
    named = runs.withColumnsRenamed(simulator_names(runs.columns))
    fast = {"maxRecordsPerFile": rows_per_file, "zlib.compress.level": "BEST_SPEED"}
    named.write.options(**fast).csv(path, header=True, compression="gzip")


def read_simulator_csv(spark: SparkSession, path: str, experiment: str) -> DataFrame:
    """Run output exported as CSV under the simulator's own column names."""
    raw = spark.read.option("header", True).csv(path)
    named = raw.withColumnsRenamed({c: table_name(c) for c in raw.columns})
    keys = {"siminputrow": "long", "random_seed": "long", "step": "int"}
    typed = {c: F.col(c).cast(keys.get(c, "double" if c == "current_inpatients" or not c.startswith(("total_", "current_")) else "long")) for c in named.columns}
    return named.withColumns(typed).withColumn("experiment", F.lit(experiment))


def read_observed(spark: SparkSession, path: str, first_month: str = FIRST_MONTH) -> DataFrame:
    """Observed series ``month, rate`` from a CSV ``x,rates``: months count up by row, rows ordered by ``x``."""
    raw = spark.read.schema(OBSERVED_FILE).csv(path, header=True)
    placed = row_index(raw, "x", "x", out="__row")
    month = F.add_months(F.to_date(F.lit(first_month)), (F.col("__row") - 1).cast("int"))
    return placed.select(month.alias("month"), F.col("rates").alias("rate"), "x")


def write_observed(series: DataFrame, path: str) -> None:
    series.select("x", "rates").write.csv(path, header=True)


def read_param_file(spark: SparkSession, path: str) -> DataFrame:
    """Headerless file, one line per parameter: quoted name, then its accepted values -> ``param, values``.  An empty field is a missing value."""
    parts = F.split("value", ",")
    name = F.translate(F.regexp_replace(F.get(parts, F.lit(0)), '"', ""), "-", "_")
    values = F.transform(F.slice(parts, F.lit(2), F.size(parts) - 1), lambda v: F.nullif(F.trim(v), F.lit("")).cast("double"))
    return spark.read.text(path).filter(F.length(F.trim("value")) > 0).select(name.alias("param"), values.alias("values"))


def param_means(params: DataFrame, digits: int = 3) -> DataFrame:
    """Mean of every parameter's values, rounded: the settings the simulator takes from the file."""
    present = F.filter("values", lambda v: v.isNotNull())
    total = F.aggregate(present, F.lit(0.0), lambda acc, v: acc + v)
    lines = params.select("param", total.alias("total"), F.size(present).alias("n"))
    return lines.groupBy("param").agg(F.round(F.sum("total") / F.sum("n"), digits).alias("value"))


def param_long(params: DataFrame) -> DataFrame:
    """``param, accept_rank, value`` from the array form."""
    return params.select("param", F.posexplode("values").alias("at", "value")).select("param", (F.col("at") + 1).cast("long").alias("accept_rank"), "value")


def param_values(posterior: DataFrame, params: Sequence[str], rank: str = "accept_rank") -> DataFrame:
    """The transposed posterior: ``position, param, chunks``, the values of a parameter in rank order, in chunks of ``SETS_PER_CHUNK``.

    ``rank`` runs 1, 2, 3, ...  What sorts numbers never holds more than a chunk.
    """
    tall = pivot_longer(posterior, [rank], params, "param", "value")
    tall = tall.withColumn("chunk", F.floor((F.col(rank) - 1) / SETS_PER_CHUNK).cast("long"))
    values = F.transform(F.array_sort(F.collect_list(F.struct(rank, "value"))), lambda s: s["value"])
    chunks = tall.groupBy("param", "chunk").agg(values.alias("values"))
    line = F.transform(F.array_sort(F.collect_list(F.struct("chunk", "values"))), lambda s: s["values"])
    position = F.array_position(F.array(*[F.lit(p) for p in params]), F.col("param"))
    return chunks.groupBy("param").agg(line.alias("chunks")).select(position.alias("position"), "param", "chunks")


def write_param_file(posterior: DataFrame, params: Sequence[str], path: str, rank: str = "accept_rank") -> None:
    """Write the transposed posterior as a headerless CSV under the hyphenated names: one file with one line per parameter, whatever the number of sets.

    One file is written by one task. Numbers go to it as numbers, about half of their text; it makes the text, one line at a time and chunk by chunk.
    A line is one string, so a parameter's text must stay below 2 GB (some 100 million sets).
    """
    rows = param_values(posterior, params, rank).orderBy("position")
    # a missing value is an empty field
    text = F.transform("chunks", lambda c: F.array_join(F.transform(c, lambda v: v.cast("string")), ",", ""))
    rows.select(F.concat(F.lit('"'), F.translate("param", "_", "-"), F.lit('",'), F.array_join(text, ",")).alias("value")).coalesce(1).write.text(path)


def export_single_set(posterior: DataFrame, params: Sequence[str], n: int, path: str, rank: str = "accept_rank") -> None:
    """Write the ``n``-th accepted set in the same format."""
    write_param_file(posterior.filter(F.col(rank) == n).withColumn(rank, F.lit(1).cast("long")), params, path, rank)


def save_results(results: Mapping[str, DataFrame], root: str) -> str:
    """Store every named result as a table under one root and publish them together; returns the name of the version.

    Tables go to a folder of their own version. The manifest, one row in one file, is added after the last table, so readers see the whole set or the one before:
    a save that fails publishes nothing, a repeated one publishes a second version. Old versions are left in place.
    """
    if not results:
        raise ValueError("nothing to save")
    version = f"{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"
    for name, df in results.items():
        df.write.parquet(f"{root}/{version}/{name}")
    spark = next(iter(results.values())).sparkSession
    spark.createDataFrame([(version, list(results))], MANIFEST).coalesce(1).write.mode("append").parquet(f"{root}/{INDEX}")
    return version


def load_results(spark: SparkSession, root: str, version: str | None = None) -> dict[str, DataFrame]:
    """The named results of a version (default: the last one published), read lazily. The tables belong to one version even if others are saved meanwhile."""
    manifest = spark.read.schema(MANIFEST).parquet(f"{root}/{INDEX}")
    found = manifest.orderBy(F.desc("version")).first() if version is None else manifest.filter(F.col("version") == version).first()
    if found is None:
        raise ValueError(f"no results {version or ''} under {root}")
    return {name: spark.read.parquet(f"{root}/{found['version']}/{name}") for name in found["names"]}


def simulator_names(columns: Sequence[str]) -> dict[str, str]:
    """Map of table columns to the hyphenated file names."""
    return {c: file_name(c) for c in columns}
