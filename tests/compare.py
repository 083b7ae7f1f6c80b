"""Run a registered query and its SQL side by side and compare rows, types and values."""

from __future__ import annotations

import math

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _cell(v: object) -> str:
    if v is None or v is pd.NaT or (isinstance(v, float) and math.isnan(v)):
        return "null"
    if isinstance(v, float):
        return repr(v)
    return str(v)


def _rows(columns: list[str], rows: list[tuple]) -> list[tuple[str, ...]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_cell(r[i]) for i in order) for r in rows)


def spark_rows(df) -> tuple[list[str], list[tuple]]:
    return df.columns, [tuple(r) for r in df.collect()]


KINDS = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "date": "DATE", "boolean": "BOOLEAN", "timestamp": "TIMESTAMP", "timestamp_ntz": "TIMESTAMP"}


def compare(df, con, sql: str) -> str | None:
    """None when equal, otherwise a description of the first difference."""
    columns, left = spark_rows(df)
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    kinds = {d[0]: str(d[1]) for d in cursor.description}
    right = cursor.fetchall()
    if sorted(columns) != sorted(names):
        return f"columns {sorted(columns)} != {sorted(names)}"
    bad = {f.name: (f.dataType.simpleString(), kinds[f.name]) for f in df.schema.fields if KINDS.get(f.dataType.simpleString(), "?") != kinds[f.name]}
    if bad:
        return f"types {bad}"
    if len(left) != len(right):
        return f"rows {len(left)} != {len(right)}"
    if not left:
        return "no rows"
    a, b = _rows(columns, left), _rows(names, right)
    for x, y in zip(a, b):
        if x != y:
            return f"{sorted(columns)}: {x} != {y}; {sum(p != q for p, q in zip(a, b))} of {len(a)} rows differ"
    return None
