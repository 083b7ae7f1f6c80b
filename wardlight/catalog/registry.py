"""The registry of queries and of the SQL each is checked against."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

DIGITS = 6
Query = Callable[[SparkSession, str], DataFrame]


def tidy(df: DataFrame) -> DataFrame:
    """Doubles rounded for comparison; adding zero turns -0.0 into 0.0."""
    return df.select(*[(F.round(f.name, DIGITS) + F.lit(0.0)).alias(f.name) if isinstance(f.dataType, T.DoubleType) else F.col(f.name) for f in df.schema.fields])


class Registry:
    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def add(self, name: str, query: Query, sql: str | None = None, doubles: Sequence[str] = ()) -> None:
        """Register a query; ``doubles`` names the columns of the SQL that are rounded like the Spark side."""
        if name in self.queries:
            raise ValueError(f"{name} is registered twice")
        self.queries[name] = lambda spark, sf_dir: tidy(query(spark, sf_dir))
        if sql is not None:
            rounded = ", ".join(f"ROUND({c}, {DIGITS}) + 0.0 AS {c}" for c in doubles)
            self.sql[name] = f"SELECT * REPLACE ({rounded}) FROM ({sql}) AS q" if rounded else sql
