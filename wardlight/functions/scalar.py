"""Scalar helpers with the semantics of the study scripts.  All are plain Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_half_up(col: Column, digits: int = 0) -> Column:
    return F.round(col, digits)


def round_half_even(col: Column, digits: int = 0) -> Column:
    return F.bround(col, digits)


def clamp(col: Column, low: float | None = None, high: float | None = None) -> Column:
    """``col`` kept inside ``[low, high]``; a missing bound is open."""
    if low is not None:
        col = F.greatest(F.lit(float(low)), col)
    if high is not None:
        col = F.least(F.lit(float(high)), col)
    return col


def percent(col: Column, digits: int | None = None) -> Column:
    scaled = col * 100.0
    return scaled if digits is None else F.round(scaled, digits)


def pad_number(col: Column, width: int = 2) -> Column:
    """Zero-pad a number on the left; wider numbers are left as they are (``lpad`` alone would cut them)."""
    text = col.cast("string")
    return F.when(F.length(text) >= width, text).otherwise(F.lpad(text, width, "0"))


def remove_first(col: Column, literal: str) -> Column:
    """Remove the first occurrence of a literal string."""
    return replace_first(col, literal, "")


def replace_first(col: Column, literal: str, new: str) -> Column:
    at = F.locate(literal, col)
    swapped = F.concat(F.substring(col, F.lit(1), at - 1), F.lit(new), F.substring(col, at + len(literal), F.length(col)))
    return F.when(at > 0, swapped).otherwise(col)


def replace_all(col: Column, literal: str, new: str) -> Column:
    return F.replace(col, F.lit(literal), F.lit(new))


def title_case(col: Column) -> Column:
    return F.initcap(col)


def number_text(col: Column, digits: int = 2) -> Column:
    """A rounded number as text without a trailing ``.0`` (``3``, ``2.4``, ``0.12``)."""
    return F.regexp_replace(F.round(col, digits).cast("string"), r"\.0$", "")


def split_period(col: Column) -> tuple[Column, Column]:
    """``b-x`` / ``o-x`` / ``c-x`` (or the same with ``_``) -> (period letter, parameter name)."""
    pattern = r"(b|o|c)[-_](.*)"
    return F.regexp_extract(col, pattern, 1), F.regexp_extract(col, pattern, 2)


def month_date(year: Column, month: Column) -> Column:
    """First day of a month from its parts; the month may be a padded string or a number."""
    return F.make_date(year.cast("int"), month.cast("int"), F.lit(1))


def days_between(start: str | Column, end: str | Column) -> Column:
    start_col = F.to_date(F.lit(start)) if isinstance(start, str) else start
    end_col = F.to_date(F.lit(end)) if isinstance(end, str) else end
    return F.date_diff(end_col, start_col)


def risk(hazard: Column) -> Column:
    """Probability of at least one event from a hazard: ``1 - exp(-h)``."""
    return 1.0 - F.exp(-hazard)
