"""Burn-in, calendar dates and time windows of run output."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardlight.functions.scalar import month_date, pad_number, round_half_even
from wardlight.functions.scans import exclusive_running, null_safe_join, position_in_group
from wardlight.schema import RUN_KEYS
from wardlight.session import materialize, small_or_self

BURN_IN = 31
ORIGIN = "2002-01-01"
TRIGGERS = ("outbreak_start", "outbreak_end", "control_end")


def drop_burn_in(runs: DataFrame, burn_in: int = BURN_IN) -> DataFrame:
    """Rows after the burn-in; a plain comparison, so it reaches the Parquet scan."""
    return runs.filter(F.col("step") > burn_in)


def _profile(runs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per run: first step and whether every step up to the last is there.  Reads keys and step only."""
    per_run = runs.groupBy(*keys).agg(F.min("step").alias("first"), F.max("step").alias("last"), F.count(F.lit(1)).alias("rows"))
    return per_run.select(*keys, "first", (F.col("last") - F.col("first") + 1 == F.col("rows")).alias("whole"))


def _by_step(runs: DataFrame, first_step: int, origin: str, out: str) -> DataFrame:
    return runs.withColumn(out, F.date_add(F.to_date(F.lit(origin)), (F.col("step") - first_step).cast("int")))


def _by_position(runs: DataFrame, keys: Sequence[str], origin: str, out: str) -> DataFrame:
    placed = position_in_group(runs, keys, "step", out="__position")
    return placed.withColumn(out, F.date_add(F.to_date(F.lit(origin)), (F.col("__position") - 1).cast("int"))).drop("__position")


def stretches(runs: DataFrame, keys: Sequence[str] = RUN_KEYS) -> DataFrame:
    """The gap-free stretches of every run: ``first``, ``last`` and ``before``, the rows of the run before it.

    Reads keys and steps only. 64 steps are one number, put together before the shuffle; what its first and last step need to know of their neighbours comes along as two flags. So
    what is ordered per run is one row per stretch, not per step.  Steps are unique in a run.
    """
    word, bit = F.floor(F.col("step") / 64).cast("long"), F.pmod(F.col("step").cast("long"), F.lit(64)).cast("int")
    zero, no = F.lit(0).cast("long"), F.lit(False)
    own = runs.select(*keys, word.alias("word"), F.expr("shiftleft(1L, CAST(pmod(CAST(step AS BIGINT), 64) AS INT))").alias("bits"), no.alias("left"), no.alias("right"))
    edges = runs.where(bit.isin(0, 63)).select(*keys, F.when(bit == 63, word + 1).otherwise(word - 1).alias("word"), zero.alias("bits"), (bit == 63).alias("left"), (bit == 0).alias("right"))
    words = own.union(edges).groupBy(*keys, "word").agg(F.bit_or("bits").alias("bits"), F.bool_or("left").alias("left"), F.bool_or("right").alias("right")).where("bits != 0")
    begins = F.expr("bits & ~(shiftleft(bits, 1) | IF(left, 1L, 0L))")
    ends = F.expr("bits & ~(shiftrightunsigned(bits, 1) | IF(right, shiftleft(1L, 63), 0L))")

    def at(mask: Column, kind: int) -> Column:
        places = F.filter(F.sequence(F.lit(0), F.lit(63)), lambda i: F.getbit(mask, i) == 1)
        return F.transform(places, lambda i: F.struct((F.col("word") * 64 + i).alias("step"), F.lit(kind).alias("kind")))

    marks = words.select(*keys, begins.alias("begins"), ends.alias("ends"), "word").where("begins != 0 or ends != 0")
    marks = marks.select(*keys, F.explode(F.concat(at(F.col("begins"), 0), at(F.col("ends"), 1))).alias("m")).select(*keys, "m.*")
    in_run = Window.partitionBy(*keys).orderBy("step", "kind")
    found = marks.withColumn("last", F.lead("step").over(in_run)).where("kind = 0").withColumnRenamed("step", "first")
    lengths = found.select(*keys, "first", "last", (F.col("last") - F.col("first") + 1).alias("rows"))
    return exclusive_running(lengths, keys, ["first"], {"before": ("sum", "rows")}).drop("rows")


STRETCHES_PER_RUN = 64


def _by_stretches(runs: DataFrame, keys: Sequence[str], origin: str, out: str) -> DataFrame:
    """Dates by position from the stretches of the runs, without moving a row, while these are few; else by counting rows."""
    listed = stretches(runs, keys).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("first", "before"))).alias("__stretches"))
    listed = materialize(listed, "stretches")  # at most a row per run, read twice
    small = small_or_self(listed)
    if small is listed or (listed.agg(F.max(F.size("__stretches")).alias("n")).first()["n"] or 0) > STRETCHES_PER_RUN:
        return _by_position(runs, keys, origin, out)
    joined = null_safe_join(runs, small, keys)
    own = F.element_at(F.filter("__stretches", lambda s: s["first"] <= F.col("step")), -1)
    return joined.withColumn(out, F.date_add(F.to_date(F.lit(origin)), (F.col("step") - own["first"] + own["before"]).cast("int"))).drop("__stretches")


def assign_dates(
    runs: DataFrame, dates: str = "auto", first_step: int = BURN_IN + 1, origin: str = ORIGIN, keys: Sequence[str] = RUN_KEYS, out: str = "date_sim"
) -> DataFrame:
    """Give every kept row a date: the first kept row of a run is ``origin``, one day per row after it.

    ``dates="position"`` counts rows inside the run (exact for any steps, one shuffle of the rows);
    ``dates="stretches"`` gives the same dates from the gap-free stretches of each run: no row is moved while runs have few gaps, otherwise it counts;
    ``dates="gapless"`` computes the date from the step (no shuffle; right when every run has every step from
    ``first_step`` on).  ``dates="auto"`` profiles the runs first (one narrow scan, one row to the driver): runs that
    have all steps from the common first one take the arithmetic, only the others are dated by their stretches.
    """
    if dates == "gapless":
        return _by_step(runs, first_step, origin, out)
    if dates == "position":
        return _by_position(runs, keys, origin, out)
    if dates == "stretches":
        return _by_stretches(runs, keys, origin, out)
    if dates != "auto":
        raise ValueError("dates must be 'auto', 'stretches', 'position' or 'gapless'")
    common = F.min(F.when(F.col("whole"), F.col("first")))
    found = _profile(runs, keys).agg(common.alias("common"), F.bool_and("whole").alias("whole"), F.max("first").alias("latest")).first()
    if found["common"] is None:
        return _by_stretches(runs, keys, origin, out)
    if found["whole"] and found["latest"] == found["common"]:
        return _by_step(runs, found["common"], origin, out)
    odd = small_or_self(_profile(runs, keys).filter(~F.col("whole") | (F.col("first") != found["common"])).select(*keys))
    regular, irregular = null_safe_join(runs, odd, keys, "left_anti"), null_safe_join(runs, odd, keys, "left_semi")
    return _by_step(regular, found["common"], origin, out).unionByName(_by_stretches(irregular, keys, origin, out))


def calendar_split(df: DataFrame, date: str = "date_sim") -> DataFrame:
    """Year and zero-padded month of a date column."""
    return df.withColumns({"year": F.year(date), "month": pad_number(F.month(date))})


def month_key(date: str | Column = "date_sim") -> Column:
    """The canonical month key: first day of the month."""
    return F.trunc(date, "MM")


def date_from_parts(df: DataFrame, year: str = "year", month: str = "month", out: str = "date_sim") -> DataFrame:
    return df.withColumn(out, month_date(F.col(year), F.col(month)))


def before(df: DataFrame, date: str, limit: str) -> DataFrame:
    return df.filter(F.col(date) < F.to_date(F.lit(limit)))


def up_to_last(df: DataFrame, date: str, other: DataFrame, other_date: str) -> DataFrame:
    """Rows up to the latest date of another table (a one-value subquery)."""
    return df.filter(F.col(date) <= other.agg(F.max(other_date)).scalar())


def within(df: DataFrame, date: str, first: str, last: str) -> DataFrame:
    """Rows of a closed date interval."""
    return df.filter(F.col(date).between(F.to_date(F.lit(first)), F.to_date(F.lit(last))))


def step_window(posterior: DataFrame, triggers: Sequence[str] = TRIGGERS) -> DataFrame:
    """One row ``(step_from, step_to)``: smallest and largest posterior mean of the triggers, rounded half to even."""
    means = posterior.agg(*[F.avg(t).alias(t) for t in triggers])
    return means.select(
        round_half_even(F.least(*triggers)).cast("int").alias("step_from"),
        round_half_even(F.greatest(*triggers)).cast("int").alias("step_to"),
    )


def in_step_window(runs: DataFrame, window: DataFrame) -> DataFrame:
    """Rows whose step lies in the one-row ``window``, both ends included; the bounds are scalar subqueries."""
    low, high = window.select("step_from").scalar(), window.select("step_to").scalar()
    return runs.filter((F.col("step") >= low) & (F.col("step") <= high))
