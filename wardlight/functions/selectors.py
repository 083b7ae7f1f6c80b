"""Column-name selectors, resolved on ``df.columns`` before planning."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame


def all_of(df: DataFrame, names: Iterable[str]) -> list[str]:
    names = list(names)
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"columns not found: {missing}")
    return names


def any_of(df: DataFrame, names: Iterable[str]) -> list[str]:
    wanted = set(names)
    return [c for c in df.columns if c in wanted]


def starts_with(df: DataFrame, *prefixes: str) -> list[str]:
    return [c for c in df.columns if c.startswith(prefixes)]


def contains(df: DataFrame, text: str) -> list[str]:
    return [c for c in df.columns if text in c]


def except_for(df: DataFrame, names: Iterable[str]) -> list[str]:
    unwanted = set(names)
    return [c for c in df.columns if c not in unwanted]


def everything(df: DataFrame) -> list[str]:
    return list(df.columns)


def sort_columns(df: DataFrame, first: Iterable[str] = ()) -> DataFrame:
    """Columns sorted by name, with ``first`` kept in front."""
    lead = all_of(df, first)
    return df.select(*lead, *sorted(except_for(df, lead)))


def relocate(df: DataFrame, name: str, after: str) -> DataFrame:
    rest = [c for c in df.columns if c != name]
    at = rest.index(after) + 1
    return df.select(*rest[:at], name, *rest[at:])


def prefix_unprefixed(df: DataFrame, prefix: str = "b_", known: tuple[str, ...] = ("o_", "c_"), keep: Iterable[str] = ()) -> DataFrame:
    """Add ``prefix`` to every column that has none of the ``known`` prefixes; ``keep`` columns stay."""
    kept = set(keep)
    return df.withColumnsRenamed({c: prefix + c for c in df.columns if c not in kept and not c.startswith(known)})
