"""Experiment designs: draws from priors, grids, seeds, and priors for the next stage."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wardlight.functions.qfun import apply_qfun, row_quantile
from wardlight.functions.scalar import clamp, days_between
from wardlight.functions.scans import exclusive_running, take_smallest
from wardlight.functions.uniform import hash_seed, hash_uniform
from wardlight.operators.summary import column_summary
from wardlight.session import small_or_self

Prior = Mapping[str, object]

# --- fixed values: priors, constants and dates of the study ----------------------------------------------------
BASELINE_PRIORS: dict[str, Prior] = {
    "community_colonisation_rate": {"min": 0.01, "max": 0.1, "qfun": "qunif"},
    "toilet_contamination_effect": {"min": 0.01, "max": 0.99, "qfun": "qunif"},
    "toilet_cleaning_effect": {"min": 0.01, "max": 0.99, "qfun": "qunif"},
    "toilet_frequenting_rate": {"min": 0.5, "max": 5.0, "qfun": "qunif"},
    "antibiotic_effect": {"min": 1.31, "max": 1.87, "qfun": "qunif"},
    "toilet_cleaning_rate": {"min": 0.5, "max": 3.0, "qfun": "qunif"},
    "random_colonisation": {"min": 2.8, "max": 12.1, "qfun": "qunif"},
    "side_room_delay_mean": {"min": 0.01, "max": 7.0, "qfun": "qunif"},
}
CONSTANTS = {
    "wards_total": 24,
    "bedspaces_per_ward": 18,
    "antibiotic_prescription_rate": 0.499,
    "admission_days": 4.6,
    "bay_proportion": 0.13,
    "control_start": 1049.0,
}
DATE_ORIGIN = "2002-01-01"
CONTROL_START_DATE = "2004-11-15"
OUTBREAK_START_DATE = "2004-10-01"
OUTBREAK_END_DATE = "2005-05-31"
CONTROL_EXTRA_DAYS = 90
TRIGGER_DAYS = {"outbreak_start": 1004, "outbreak_end": 1246, "control_end": 1336}
TRIGGER_WINDOWS = {"outbreak_start": 90, "outbreak_end": 90, "control_end": 30}
SHARE_FLOOR, SHARE_CAP = 0.01, 0.99
CLEANING_RATE_LOW = 0.5
SIDE_ROOM_DELAY = (0.01, 7.0)
# --- end of fixed values ---------------------------------------------------------------------------------------

# outbreak value must not lie below the baseline value
CONSTRAINED = ["toilet_contamination_effect", "toilet_frequenting_rate", "community_colonisation_rate"]


# ---- draws -----------------------------------------------------------------------------------------------------


def draw(df: DataFrame, priors: Mapping[str, Prior], uniform: Callable[[str], Column], precision: int = 3) -> DataFrame:
    """Add one column per prior: its quantile at ``uniform(name)``, rounded."""
    return df.withColumns({name: F.round(apply_qfun(uniform(name), spec), precision) for name, spec in priors.items()})


def design_random(spark: SparkSession, priors: Mapping[str, Prior], samples: int, seed: int = 42, precision: int = 3) -> DataFrame:
    """Independent draws: one row per parameter set.  Narrow: no shuffle at any size."""
    rows = spark.range(1, samples + 1).withColumnRenamed("id", "siminputrow")
    return draw(rows, priors, lambda name: hash_uniform(F.col("siminputrow"), seed, name), precision)


def design_lhs(df: DataFrame, priors: Mapping[str, Prior], uniforms: Mapping[str, str] | None = None, seed: int = 42, precision: int = 3, cells: int = 1024) -> DataFrame:
    """Latin hypercube over the rows of ``df`` (key ``siminputrow``): one draw in each of ``n`` equal strata per parameter.

    The stratum of a row is the rank of its uniform.  All parameters are ranked in one long table: rows fall into
    ``cells`` equal cells of the uniform (balanced by construction), each cell is a small window, and cell counts give
    the offsets.  ``uniforms`` names existing columns to use as draws.
    """
    names = list(priors)
    u = {n: F.col(uniforms[n]) if uniforms else hash_uniform(F.col("siminputrow"), seed, n) for n in names}
    wide = df.select("siminputrow", *[u[n].alias(n) for n in names])
    strata = stratified(wide.unpivot(["siminputrow"], names, "param", "u"), cells)
    back = strata.groupBy("siminputrow").pivot("param", names).agg(F.first("p"))
    return back.select("siminputrow", *[F.round(apply_qfun(F.col(n), spec), precision).alias(n) for n, spec in priors.items()])


def stratified(tall: DataFrame, cells: int = 1024) -> DataFrame:
    """``tall`` (siminputrow, param, u, ...) with ``p``: the draw ``u`` moved into the stratum of its rank among the ``n`` draws of the parameter."""
    tall = tall.withColumn("__cell", F.floor(F.col("u") * cells).cast("long"))
    counts = tall.groupBy("param", "__cell").agg(F.count(F.lit(1)).alias("__rows"))
    offsets = exclusive_running(counts, ["param"], ["__cell"], {"__before": ("sum", "__rows")}).withColumn("__n", F.sum("__rows").over(Window.partitionBy("param"))).drop("__rows")
    in_cell = Window.partitionBy("param", "__cell").orderBy("u", "siminputrow")
    # rows made by an explode look few to the planner, which would broadcast them: a merge join keeps them in the exchange of the window
    placed = tall.withColumn("__inside", F.row_number().over(in_cell)).join(offsets.hint("merge"), ["param", "__cell"])
    p = (F.col("__before") + F.col("__inside") - 1 + F.col("u")) / F.col("__n")
    return placed.withColumn("p", p).drop("__cell", "__before", "__inside", "__n")


# ---- draws from a prior table ----------------------------------------------------------------------------------

DRAW_BLOCK = 4_096
Uniform = Callable[[Column, Column], Column]


def draw_rows(priors: DataFrame, samples: int) -> DataFrame:
    """Every row of ``priors`` once for each ``siminputrow`` 1..``samples``.

    The priors stay a table: each row is exploded into blocks of ``DRAW_BLOCK`` numbers, the blocks are dealt out, and a task explodes its own.
    """
    blocks = F.sequence(F.lit(0).cast("long"), F.lit((samples - 1) // DRAW_BLOCK).cast("long"))
    cut = priors.withColumn("__block", F.explode(blocks if samples > 0 else F.array().cast("array<bigint>")))
    if samples > DRAW_BLOCK:
        cut = cut.repartition("param", "__block")
    first = F.col("__block") * DRAW_BLOCK + 1
    return cut.withColumn("siminputrow", F.explode(F.sequence(first, F.least(first + DRAW_BLOCK - 1, F.lit(samples).cast("long"))))).drop("__block")


def draw_table(priors: DataFrame, samples: int, seed: int = 42, precision: int = 3, uniform: Uniform | None = None, lhs: bool = False, vectors: Sequence[str] = ()) -> DataFrame:
    """Draws from a prior table in the long form ``siminputrow, param, value``; independent, or one in each stratum with ``lhs``.

    ``priors``: ``param`` (unique), ``qfun`` and the fields of the quantile functions as columns. ``uniform(row, param)`` gives other uniforms; the default gives
    the numbers of ``design_random`` for the same priors and seed. An empty prior table gives no draws.
    """
    own = uniform or (lambda row, param: hash_uniform(row, seed, param))
    rows = draw_rows(priors, samples).withColumn("u", own(F.col("siminputrow"), F.col("param")))
    rows = stratified(rows) if lhs else rows.withColumn("p", F.col("u"))
    return rows.select("siminputrow", "param", F.round(row_quantile(F.col("p"), priors.columns, vectors), precision).alias("value"))


def design_from_table(priors: DataFrame, samples: int, names: Sequence[str], **options: object) -> DataFrame:
    """The draws of ``draw_table`` as a design: one row per set, one column per name. Parameters of other names are left out; a name without a prior is null."""
    return draw_table(priors.where(F.col("param").isin(list(names))), samples, **options).groupBy("siminputrow").pivot("param", list(names)).agg(F.first("value"))


def lhs_from_table(priors: DataFrame, samples: int, names: Sequence[str], **options: object) -> DataFrame:
    """A Latin hypercube from a prior table, as ``design_from_table``."""
    return design_from_table(priors, samples, names, lhs=True, **options)


def bind_constants(design: DataFrame, constants: Mapping[str, object]) -> DataFrame:
    return design.withColumns({k: F.lit(v) for k, v in constants.items()})


def make_seeds(n: int, seed: int = 42) -> list[int]:
    """``n`` distinct reproducible seeds."""
    import random

    return random.Random(seed).sample(range(-(2**31), 2**31), n)


def cross_seeds(design: DataFrame, seeds: Sequence[int], out: str = "random_seed") -> DataFrame:
    """Each parameter row once per seed: an explode of the seed list, row by row."""
    return design.withColumn(out, F.explode(F.array(*[F.lit(int(s)).cast("long") for s in seeds])))


def row_seeds(design: DataFrame, seed: int = 42, key: str = "siminputrow", out: str = "seed_value") -> DataFrame:
    """One seed per design row."""
    return design.withColumn(out, hash_seed(F.col(key), seed))


# ---- grids -----------------------------------------------------------------------------------------------------


def linspace(low: Column | float, high: Column | float, n: Column | int) -> Column:
    """Array of ``n`` evenly spaced values, both ends included; ``n = 1`` gives the lower end."""
    low, high = (x if isinstance(x, Column) else F.lit(float(x)) for x in (low, high))
    count = n if isinstance(n, Column) else F.lit(int(n))
    steps = F.greatest(count - 1, F.lit(1))
    return F.transform(F.sequence(F.lit(0), (count - 1).cast("int")), lambda i: low + i * (high - low) / steps)


def stepped(first: float, step: float, last: float) -> Column:
    """Array ``first, first + step, ... <= last`` (a small slack absorbs the floating error of the last step)."""
    count = int((last - first) / step + 1e-9)
    return F.transform(F.sequence(F.lit(0), F.lit(count)), lambda i: F.lit(float(first)) + i * F.lit(float(step)))


def zip_values(df: DataFrame, arrays: Mapping[str, Column]) -> DataFrame:
    """One row per position of the value lists, which run in lockstep (no cross product); ``position`` is 1-based."""
    zipped = F.arrays_zip(*[a.alias(n) for n, a in arrays.items()])
    kept = df.select("*", F.posexplode(zipped).alias("__at", "__row"))
    row = [F.col(f"__row.`{n}`").alias(n) for n in arrays]
    return kept.select(*[F.col(c) for c in df.columns if c not in arrays], (F.col("__at") + 1).cast("long").alias("position"), *row)


def design_distinct(spark: SparkSession, values: Mapping[str, Sequence[float]], seeds: Sequence[int], constants: Mapping[str, object] | None = None) -> DataFrame:
    """Zip the value lists (i-th of each), bind constants, cross with seeds."""
    if len({len(v) for v in values.values()}) != 1:
        raise ValueError("value lists must have equal length")
    one = spark.range(1).drop("id")
    zipped = zip_values(one, {n: F.array(*[F.lit(float(x)) for x in v]) for n, v in values.items()})
    return cross_seeds(bind_constants(zipped.withColumnRenamed("position", "siminputrow"), constants or {}), seeds)


def design_simple(spark: SparkSession, constants: Mapping[str, object], seeds: Sequence[int]) -> DataFrame:
    """Constants only, once per seed."""
    return cross_seeds(bind_constants(spark.range(1, 2).withColumnRenamed("id", "siminputrow"), constants), seeds)


def design_factorial(base: DataFrame, levels: Mapping[str, Column]) -> DataFrame:
    """Every row of ``base`` with every combination of the level arrays."""
    for name, values in levels.items():
        base = base.withColumn(name, F.explode(values))
    return base


# ---- filters and samples ---------------------------------------------------------------------------------------


def keep_plausible(design: DataFrame, names: Sequence[str] = CONSTRAINED) -> DataFrame:
    """Keep draws whose outbreak value is at least the baseline value."""
    for name in names:
        design = design.filter(F.col(f"o_{name}") >= F.col(name))
    return design


def sample_rows(df: DataFrame, n: int, key: str = "siminputrow", seed: int = 42, uniform: str | Column | None = None, rank: str | None = None) -> DataFrame:
    """``n`` rows without replacement: the smallest by a uniform per row, numbered in that order when ``rank`` names a column.  Fails when fewer rows exist."""
    available = df.count()
    if available < n:
        raise ValueError(f"cannot take {n} rows from {available}")
    own = hash_uniform(F.col(key), seed, "sample") if uniform is None else F.col(uniform) if isinstance(uniform, str) else uniform
    return take_smallest(df.withColumn("__u", own), "__u", key, n, rank=rank).drop("__u")


def bootstrap(indexed: DataFrame, draws: DataFrame, index: str = "accept_rank", uniform: str = "u", rows: int | None = None) -> DataFrame:
    """Rows of ``indexed`` drawn with replacement: draw ``u`` takes the row with 1-based index ``floor(u * n) + 1``."""
    rows = indexed.count() if rows is None else rows
    picked = draws.withColumn(index, (F.floor(F.col(uniform) * rows) + 1).cast("long"))
    return picked.join(small_or_self(indexed), index)


def bootstrap_draws(spark: SparkSession, n: int, seed: int = 42) -> DataFrame:
    """``n`` draws for ``bootstrap`` with their seeds."""
    rows = spark.range(1, n + 1).withColumnRenamed("id", "draw")
    return rows.select("draw", hash_uniform(F.col("draw"), seed, "bootstrap").alias("u"), hash_seed(F.col("draw"), seed).alias("seed_value"))


# ---- priors from a posterior -----------------------------------------------------------------------------------


def priors_from_posterior(posterior: DataFrame, params: Sequence[str], group_rows: int | None = None) -> DataFrame:
    """Per parameter: quartiles as bounds, mean, sd, and mean ± sd."""
    stats = column_summary(posterior, params, group_rows)
    return stats.select(
        "param", F.col("q25").alias("min"), F.col("q75").alias("max"), "mean", "sd",
        (F.col("mean") - F.col("sd")).alias("lower_sd"), (F.col("mean") + F.col("sd")).alias("upper_sd"),
        F.lit("qunif").alias("qfun"),
    )


@dataclass(frozen=True)
class Bound:
    """``base + scale * term`` kept inside ``[floor, cap]``; base and term are prior fields or numbers."""

    base: str | float
    scale: float = 0.0
    term: str | float = 0.0
    floor: float | None = None
    cap: float | None = None


@dataclass(frozen=True)
class PriorRule:
    param: str
    source: str | None
    low: Bound
    high: Bound


@dataclass(frozen=True)
class BoundKnobs:
    """Which prior field the derived bounds start from and how far they reach."""

    upper: str = "mean"
    upper_scale: float = 1.0
    lower: str = "mean"
    lower_scale: float = 1.0
    prescription_rate: float = CONSTANTS["antibiotic_prescription_rate"]
    triggers: dict[str, int] = field(default_factory=lambda: dict(TRIGGER_DAYS))


def outbreak_rules(knobs: BoundKnobs) -> list[PriorRule]:
    """Bounds of the outbreak and control parameters in terms of the baseline priors."""
    raised = Bound(knobs.upper, knobs.upper_scale, knobs.upper)
    rate = knobs.prescription_rate
    delay_low, delay_high = SIDE_ROOM_DELAY
    triggers = [PriorRule(n, None, Bound(float(knobs.triggers[n] - w)), Bound(float(knobs.triggers[n] + w))) for n, w in TRIGGER_WINDOWS.items()]
    return [
        *triggers,
        PriorRule("o_toilet_frequenting_rate", "toilet_frequenting_rate", Bound("min"), raised),
        PriorRule("o_toilet_contamination_effect", "toilet_contamination_effect", Bound("min"), Bound(knobs.upper, knobs.upper_scale, knobs.upper, cap=SHARE_CAP)),
        PriorRule("o_toilet_cleaning_effect", "toilet_cleaning_effect", Bound(knobs.lower, -knobs.lower_scale, knobs.upper, floor=SHARE_FLOOR), Bound("max")),
        PriorRule("o_toilet_cleaning_rate", "toilet_cleaning_rate", Bound(CLEANING_RATE_LOW), Bound("max")),
        PriorRule("o_community_colonisation_rate", "community_colonisation_rate", Bound("min"), raised),
        PriorRule("o_antibiotic_prescription_rate", None, Bound(rate), Bound(rate, knobs.upper_scale, rate, cap=SHARE_CAP)),
        PriorRule("o_side_room_delay_mean", None, Bound(delay_low), Bound(delay_high)),
        PriorRule("c_toilet_cleaning_effect", "toilet_cleaning_effect", Bound("min"), Bound(SHARE_CAP)),
        PriorRule("c_toilet_cleaning_rate", "toilet_cleaning_rate", Bound("min"), raised),
        PriorRule("c_antibiotic_prescription_rate", None, Bound(rate, -knobs.lower_scale, rate, floor=SHARE_FLOOR), Bound(rate)),
        PriorRule("c_side_room_delay_mean", None, Bound(delay_low), Bound(delay_high)),
    ]


def _bound_column(bound: Bound) -> Column:
    def pick(x: str | float) -> Column:
        return F.col(x) if isinstance(x, str) else F.lit(float(x))

    value = pick(bound.base)
    if bound.scale:
        value = value + F.lit(bound.scale) * pick(bound.term)
    return clamp(value, bound.floor, bound.cap)


def derived_priors(baseline: DataFrame, rules: Sequence[PriorRule]) -> DataFrame:
    """Priors of the next stage: one row per rule, followed by the baseline priors themselves.

    ``baseline`` has one row per parameter (``param, min, max, mean, sd``).  Each rule is expanded next to its source
    row, so the small rule list travels in the plan and no join is needed.
    """
    fields = ["param", "min", "max", "mean", "sd"]
    base = baseline.select(*fields)

    def row(rule: PriorRule) -> Column:
        low, high = _bound_column(rule.low).cast("double"), _bound_column(rule.high).cast("double")
        return F.struct(F.lit(rule.param).alias("param"), low.alias("min"), high.alias("max"))

    def cases(source: str) -> Column:
        return F.array(*[row(r) for r in rules if r.source == source])

    sources = sorted({r.source for r in rules if r.source})
    by_source = {source: cases(source) for source in sources}
    chosen = F.coalesce(*[F.when(F.col("param") == source, rows) for source, rows in by_source.items()])
    from_source = base.select(F.explode(chosen).alias("r")).select("r.param", "r.min", "r.max")
    constant = base.limit(1).select(F.explode(F.array(*[row(r) for r in rules if r.source is None])).alias("r")).select("r.param", "r.min", "r.max")
    return from_source.unionByName(constant).unionByName(base, allowMissingColumns=True).withColumn("qfun", F.lit("qunif"))


def uniform_around_mean(posterior: DataFrame, params: Sequence[str], group_rows: int | None = None) -> DataFrame:
    """New prior per parameter: mean ± sd."""
    stats = priors_from_posterior(posterior, params, group_rows)
    return stats.select("param", F.col("lower_sd").alias("min"), F.col("upper_sd").alias("max"), "qfun")


def fix_all_but(posterior: DataFrame, params: Sequence[str], varied: Sequence[str], overrides: Mapping[str, float] | None = None) -> DataFrame:
    """One row of posterior means for every parameter except the varied ones; ``overrides`` replace single values."""
    overrides = overrides or {}
    kept = [p for p in params if p not in varied]
    means = posterior.agg(*[F.avg(p).alias(p) for p in kept])
    return means.select(*[F.lit(float(overrides[p])).alias(p) if p in overrides else F.col(p) for p in kept])


def time_triggers(
    df: DataFrame, origin: str = DATE_ORIGIN, outbreak_start: str | Column = OUTBREAK_START_DATE,
    control_start: str | Column = CONTROL_START_DATE, outbreak_end: str | Column = OUTBREAK_END_DATE, extra_days: int = CONTROL_EXTRA_DAYS,
) -> DataFrame:
    """Triggers as days since ``origin``, with the control period ending ``extra_days`` after the outbreak."""
    end = days_between(origin, outbreak_end)
    return df.withColumns(
        {
            "outbreak_start": days_between(origin, outbreak_start).cast("long"),
            "control_start": days_between(origin, control_start).cast("long"),
            "outbreak_end": end.cast("long"),
            "control_end": (end + extra_days).cast("long"),
        }
    )
