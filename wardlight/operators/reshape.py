"""Long and wide forms, completion of missing cells, unions of unlike tables, transposition."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardlight.functions.scalar import split_period
from wardlight.session import small_or_self

MAX_PIVOT_COLUMNS = 5_000


def pivot_wider(df: DataFrame, keys: Sequence[str], name: str, value: str, names: Sequence[str] | None = None, prefix: str = "") -> DataFrame:
    """One column per distinct ``name``.

    With explicit ``names`` there is no extra job and the column order is fixed, and a name outside the list is an
    error; otherwise the names are read first (they become columns, so their number is checked).  Two rows in one
    cell are an error.
    """
    if names is None:
        found = df.select(F.col(name).cast("string").alias("n")).distinct().limit(MAX_PIVOT_COLUMNS + 1).collect()
        if len(found) > MAX_PIVOT_COLUMNS:
            raise ValueError(f"more than {MAX_PIVOT_COLUMNS} columns; keep the long form")
        names = sorted(r["n"] for r in found if r["n"] is not None)
    text = F.col(name).cast("string")
    listed = F.when(text.isin(list(names)), text).otherwise(F.raise_error(F.concat(F.lit("no column for "), F.coalesce(text, F.lit("null")))).cast("string"))
    cell = F.when(F.count(F.lit(1)) > 1, F.raise_error(F.lit("two rows in one cell")).cast(df.schema[value].dataType)).otherwise(F.first(value))
    wide = df.withColumn("__name", listed).groupBy(*keys).pivot("__name", list(names)).agg(cell)
    return wide.withColumnsRenamed({n: f"{prefix}{n}" for n in names})


def pivot_longer(df: DataFrame, keys: Sequence[str], columns: Sequence[str], name: str = "name", value: str = "value", drop_missing: bool = False) -> DataFrame:
    """One row per key and column.  All ``columns`` are read as doubles."""
    typed = df.select(*keys, *[F.col(c).cast("double").alias(c) for c in columns])
    tall = typed.unpivot(list(keys), list(columns), name, value)
    return tall.filter(F.col(value).isNotNull()) if drop_missing else tall


def pivot_longer_periods(df: DataFrame, keys: Sequence[str], columns: Sequence[str], value: str = "value") -> DataFrame:
    """``pivot_longer`` that splits ``b_x`` / ``o_x`` / ``c_x`` into the columns ``period`` and ``param``."""
    tall = df.select(*keys, *columns).unpivot(list(keys), list(columns), "__name", value)
    period, param = split_period(F.col("__name"))
    return tall.select(*keys, period.alias("period"), param.alias("param"), value)


def complete_cells(df: DataFrame, keys: Sequence[str], name: str, value: str) -> DataFrame:
    """Every key with every ``name`` that occurs anywhere; cells without a row get null.

    The distinct names are the column set of the wide form.  They come as one array from a subquery and are exploded
    next to the distinct keys, so no join of keys and names is planned.  The values are merged in, never broadcast: their
    size as stored says little about their size in memory.
    """
    names = df.agg(F.sort_array(F.collect_set(name)).alias("names")).scalar()
    cells = df.select(*keys).distinct().withColumn("__names", names).select(*keys, F.explode("__names").alias(name))
    return cells.join(df.select(*keys, name, value).hint("merge"), [*keys, name], "left")


def bind_rows(*tables: DataFrame) -> DataFrame:
    """Union by name; columns that a table lacks are null."""
    first, *rest = tables
    for other in rest:
        first = first.unionByName(other, allowMissingColumns=True)
    return first


def transpose(df: DataFrame, row_name: str, columns: Sequence[str], names: Sequence[object] | None = None, out: str = "param") -> DataFrame:
    """Columns become rows (named in ``out``), the values of ``row_name`` become columns."""
    tall = pivot_longer(df, [row_name], columns, "__column", "value")
    wanted = None if names is None else [str(n) for n in names]
    return pivot_wider(tall, ["__column"], row_name, "value", wanted).withColumnRenamed("__column", out)


def natural_right_join(left: DataFrame, right: DataFrame) -> DataFrame:
    """Right join on all shared columns."""
    shared = [c for c in left.columns if c in right.columns]
    if not shared:
        raise ValueError("no shared columns to join on")
    return left.join(right, shared, "right")


def tag(df: DataFrame, label: str, column: str = "type") -> DataFrame:
    return df.withColumn(column, F.lit(label))


def overlay(simulated: DataFrame, observed: DataFrame) -> DataFrame:
    """Simulated and observed series in one table, told apart by ``type``."""
    return bind_rows(tag(simulated, "sim"), tag(observed, "obs"))


def label_lookup(df: DataFrame, labels: dict[str, str], column: str, out: str) -> DataFrame:
    """Join a fixed label table; rows without a label keep their own text."""
    table = df.sparkSession.createDataFrame(sorted(labels.items()), f"`{column}` string, __label string")
    joined = df.join(small_or_self(table), column, "left")
    return joined.withColumn(out, F.coalesce("__label", column)).drop("__label")
