"""Schemas of the input tables, and the map between table column names and the simulator's own names."""

from __future__ import annotations

from pyspark.sql import types as T

RUN_KEYS = ["siminputrow", "random_seed"]
CUMULATIVE = ["total_colonised", "total_patients_admitted", "total_hospital_infections"]
CURRENT = ["current_community_infections", "current_hospital_infections", "current_inpatients", "current_colonised"]

RUNS = T.StructType(
    [
        T.StructField("experiment", T.StringType()),
        T.StructField("siminputrow", T.LongType()),
        T.StructField("random_seed", T.LongType()),
        T.StructField("step", T.IntegerType()),
        *[T.StructField(name, T.LongType()) for name in CUMULATIVE],
        *[T.StructField(name, T.DoubleType() if name == "current_inpatients" else T.LongType()) for name in CURRENT],
    ]
)

OBSERVED_FILE = T.StructType([T.StructField("x", T.DoubleType()), T.StructField("rates", T.DoubleType())])

PRIORS = T.StructType(
    [
        T.StructField("param", T.StringType()),
        T.StructField("min", T.DoubleType()),
        T.StructField("max", T.DoubleType()),
        T.StructField("mean", T.DoubleType()),
        T.StructField("sd", T.DoubleType()),
        T.StructField("qfun", T.StringType()),
        T.StructField("values", T.ArrayType(T.DoubleType())),
    ]
)


def table_name(name: str) -> str:
    """Simulator name -> column name: ``[step]`` -> ``step``, ``outbreak?`` -> ``outbreak``, ``a-b`` -> ``a_b``."""
    return name.strip("[]").rstrip("?").replace("-", "_")


def file_name(column: str) -> str:
    """Column name -> the hyphenated name used in parameter files."""
    return column.replace("_", "-")
