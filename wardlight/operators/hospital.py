"""Analytics over hospital event tables: census, counters, layout, queues, contamination and infection risk."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardlight.functions.scalar import risk
from wardlight.functions.scans import exclusive_running, null_safe_join, ordered_blocks
from wardlight.session import materialize, small_or_self

BAY_BEDS = 4
CLEANING_EFFECT = 0.8
ANTIBIOTIC_EFFECT = 1.5
PER_BED_DAYS = 10_000.0


def _running_by_day(changes: DataFrame, by: Sequence[str], measures: Sequence[str], fill: bool) -> DataFrame:
    """Sum the changes per day (before the shuffle), run them up over the days, and repeat values on quiet days.

    After the sum there is one row per day, so the running window is as long as the calendar, not as the data.
    """
    daily = changes.groupBy(*by, "day").agg(*[F.sum(m).cast("long").alias(m) for m in measures])
    order = Window.partitionBy(*(by or [F.lit(1)])).orderBy("day")
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    totals = daily.select(
        *by, "day", *[F.sum(m).over(so_far).alias(m) for m in measures],
        F.coalesce(F.date_sub(F.lead("day").over(order), 1), F.col("day")).alias("__until"),
    )
    if not fill:
        return totals.drop("__until")
    return totals.select(*by, F.explode(F.sequence("day", "__until")).alias("day"), *measures)


def daily_census(stays: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Per day: inpatients, community infections, hospital infections, and colonised (either).

    A stay counts on ``admit <= day < discharge``.  Each stay becomes two or three changes instead of one row per
    day; zero-day stays never count.
    """
    present = stays.filter(F.col("discharge") > F.col("admit"))
    community = F.col("community_infection").cast("long")
    caught = F.when(F.col("hospital_infection_date").isNotNull(), F.greatest("hospital_infection_date", "admit"))
    in_time = F.coalesce(caught < F.col("discharge"), F.lit(False))
    hospital = in_time.cast("long")
    colonised = F.greatest(community, hospital)

    def change(day: Column, inpatients: Column, comm: Column, hosp: Column, either: Column) -> Column:
        return F.struct(day.alias("day"), inpatients.alias("inpatients"), comm.alias("community"), hosp.alias("hospital"), either.alias("colonised"))

    one, zero = F.lit(1).cast("long"), F.lit(0).cast("long")
    changes = F.array(
        change(F.col("admit"), one, community, zero, community),
        change(F.when(in_time, caught).otherwise(F.col("admit")), zero, zero, hospital, colonised - community),
        change(F.col("discharge"), -one, -community, -hospital, -colonised),
    )
    rows = present.select(*by, F.explode(changes).alias("c")).select(*by, "c.*")
    return _running_by_day(rows, list(by), ["inpatients", "community", "hospital", "colonised"], fill=True)


def cumulative_counters(stays: DataFrame, by: Sequence[str] = (), distinct_patients: bool = False) -> DataFrame:
    """Running totals per day: admitted, colonised, hospital infections.

    Colonised counts events, so a patient admitted infected who is infected again in hospital counts twice;
    ``distinct_patients`` counts each patient at the first event only.
    """
    community = F.col("community_infection").cast("long")
    hospital = F.col("hospital_infection_date").isNotNull().cast("long")
    again = F.when(F.col("community_infection"), F.lit(0)).otherwise(hospital) if distinct_patients else hospital
    one, zero = F.lit(1).cast("long"), F.lit(0).cast("long")
    changes = F.array(
        F.struct(F.col("admit").alias("day"), one.alias("admitted"), community.alias("colonised"), zero.alias("hospital_infections")),
        F.struct(
            F.coalesce("hospital_infection_date", "admit").alias("day"), zero.alias("admitted"), again.cast("long").alias("colonised"),
            hospital.alias("hospital_infections"),
        ),
    )
    rows = stays.select(*by, F.explode(changes).alias("c")).select(*by, "c.*")
    return _running_by_day(rows, list(by), ["admitted", "colonised", "hospital_infections"], fill=False)


def length_of_stay(stays: DataFrame) -> DataFrame:
    return stays.withColumn("los", F.date_diff("discharge", "admit").cast("long"))


def length_of_stay_summary(stays: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Distribution of the length of stay: counts per length first, then weighted exact quantiles on those."""
    counts = length_of_stay(stays).groupBy(*by, "los").agg(F.count(F.lit(1)).alias("n"))
    quantile = lambda p: F.percentile("los", F.lit(p), F.col("n"))
    total = F.sum("n")
    return counts.groupBy(*by).agg(
        total.alias("stays"), F.min("los").alias("min"), quantile(0.25).alias("q25"), quantile(0.5).alias("median"), quantile(0.75).alias("q75"),
        F.max("los").alias("max"), (F.sum(F.col("los") * F.col("n")) / total).alias("mean"),
    )


def layout_summary(rooms: DataFrame) -> DataFrame:
    """Wards, capacity, bays (4 beds), side rooms (1 bed), and min / median / max of bays and capacity per ward."""
    bay = F.col("is_bay")
    wards = rooms.groupBy("ward").agg(
        F.count_if(bay).alias("bays"), F.count_if(~bay).alias("side_rooms"), F.sum(F.when(bay, BAY_BEDS).otherwise(1)).alias("capacity")
    )
    spread = [f(c).cast("double").alias(f"{name}_{c}") for c in ("bays", "capacity") for name, f in (("min", F.min), ("median", F.median), ("max", F.max))]
    return wards.agg(
        F.count(F.lit(1)).alias("wards"), F.sum("capacity").alias("capacity"), F.sum("bays").alias("bays"), F.sum("side_rooms").alias("side_rooms"), *spread
    )


def allocate_evenly(wards: DataFrame, rooms_per_ward: int, bay_proportion: float) -> DataFrame:
    """Spread ``floor(proportion * rooms)`` bays over the wards (numbered 1..W): equal shares, the rest to the first
    wards, never more than the rooms of a ward.  Result: ward, room, is_bay."""
    count = wards.agg(F.count(F.lit(1))).scalar()
    bays = F.floor(F.lit(float(bay_proportion)) * count * rooms_per_ward)
    share = F.floor(bays / count)
    rest = bays - share * count
    mine = F.least(F.lit(rooms_per_ward).cast("long"), share + (F.col("ward") <= rest).cast("long"))
    sized = wards.select("ward", mine.alias("bays"))
    return sized.select("ward", F.explode(F.sequence(F.lit(1), F.lit(rooms_per_ward))).alias("room"), "bays").select("ward", "room", (F.col("room") <= F.col("bays")).alias("is_bay"))


def double_occupancy(stays: DataFrame, bed: Sequence[str] = ("ward", "bed")) -> DataFrame:
    """Stays that begin while an earlier stay (by admit day, then id) still holds the same bed.

    Stays are reduced to one row per bed and admit day (latest discharge, first id that holds the bed overnight); the
    running maximum over earlier days sees only those, and the stays join back to their own day.
    """
    bed = list(bed)
    overnight = F.col("discharge") > F.col("admit")
    days = stays.groupBy(*bed, "admit").agg(F.max("discharge").alias("__until"), F.min(F.when(overnight, F.col("stay_id"))).alias("__first"))
    days = exclusive_running(days, bed, ["admit"], {"__held_until": ("max", "__until")}).drop("__until")
    joined = stays.join(days, [*bed, "admit"])
    clash = F.coalesce(F.col("__held_until") > F.col("admit"), F.lit(False)) | F.coalesce(F.col("__first") < F.col("stay_id"), F.lit(False))
    return joined.filter(clash).select("stay_id", *bed, "admit", "discharge")


def queue_lengths(queue_events: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Patients per day in the delay queue and in the ready queue.

    A patient waits ``[entry, entry + delay)``, is ready ``[entry + delay, leave)``; no delay goes straight to ready.
    """
    ready = F.date_add("entry", F.col("delay_days"))
    waits = (ready > F.col("entry")) & (F.col("leave") > F.col("entry"))
    gets_ready = ready < F.col("leave")
    w, r = waits.cast("long"), gets_ready.cast("long")
    zero = F.lit(0).cast("long")
    changes = F.array(
        F.struct(F.col("entry").alias("day"), w.alias("delay_queue"), zero.alias("ready_queue")),
        F.struct(F.least(ready, F.col("leave")).alias("day"), (-w).alias("delay_queue"), r.alias("ready_queue")),
        F.struct(F.col("leave").alias("day"), zero.alias("delay_queue"), (-r).alias("ready_queue")),
    )
    rows = queue_events.select(*by, F.explode(changes).alias("c")).select(*by, "c.*")
    return _running_by_day(rows, list(by), ["delay_queue", "ready_queue"], fill=True)


# ---- contamination ---------------------------------------------------------------------------------------------
#
# Every event maps the level x to min(m, a * x + b).  Such maps compose:
#   (a2, b2, m2) after (a1, b1, m1)  =  (a2 * a1, a2 * b1 + b2, min(m2, a2 * m1 + b2))      (a2 >= 0)
# Inside a block of events they need no composing: with A the product of all a so far, the level divided by A only grows by b / A
# and is held below 1 / A, so it is a running sum P and a running minimum:  x / A = P + min(x0, min over events of 1 / A - P).
# Events are cut into blocks by row position, a block is one map, a group of blocks is one map, and only groups are followed toilet by toilet.

BLOCK_ROWS = 256
GROUP_BLOCKS = 256
FULL = 1.0 - 1e-12  # a cleaning that removes everything counts as this much
SPAN = 250.0  # powers of ten that 1 / A may grow by inside a block


def _block_rows(cleaning_effect: float, rows: int) -> int:
    """Rows of a block: ``rows``, or as many as cleanings may follow each other before 1 / A leaves the range of doubles."""
    shrink = -math.log10(1.0 - min(cleaning_effect, FULL))
    return max(1, min(rows, int(SPAN / shrink))) if shrink > 0 else rows


def _adds() -> Column:
    return F.when((F.col("kind") == "use") & F.col("colonised"), F.col("amount")).otherwise(F.lit(0.0))


def _replayed(events: DataFrame, cleaning_effect: float, key: str, rows: int, parts: int | None) -> DataFrame:
    """The events in blocks with the map from the level at the start of the block to that before (``A0, P0, M0``) and after the event (``A, P, M``)."""
    keep = F.lit(1.0 - min(cleaning_effect, FULL))
    blocks = ordered_blocks(events.filter(F.col(key).isNotNull()), [key, "ts", "event_id"], _block_rows(cleaning_effect, rows), parts)
    before = Window.partitionBy("__block", key).orderBy("__place").rowsBetween(Window.unboundedPreceding, -1)
    cleans = (F.col("kind") == "clean").cast("int")
    df = blocks.withColumn("A0", F.pow(keep, F.coalesce(F.sum(cleans).over(before), F.lit(0))))
    df = df.withColumn("A", F.when(F.col("kind") == "clean", F.col("A0") * keep).otherwise(F.col("A0"))).withColumn("__term", _adds() / F.col("A"))
    df = df.withColumn("P0", F.coalesce(F.sum("__term").over(before), F.lit(0.0))).withColumn("P", F.col("P0") + F.col("__term"))
    df = df.withColumn("__cap", F.lit(1.0) / F.col("A") - F.col("P"))
    return df.withColumn("M0", F.min("__cap").over(before)).withColumn("M", F.least("M0", "__cap")).drop("__term", "__cap")


def _level(a: Column, p: Column, cap: Column, start: Column) -> Column:
    return a * (p + F.least(start, cap))


def _block_maps(replayed: DataFrame, key: str) -> DataFrame:
    """One map (a, b, m) per toilet and block, with its number of events."""
    last = F.max_by(F.struct("A", "P", "M"), "__place")
    maps = replayed.groupBy(key, "__block").agg(last.alias("e"), F.count(F.lit(1)).alias("n"))
    return maps.select(key, "__block", F.col("e.A").alias("a"), (F.col("e.A") * F.col("e.P")).alias("b"), (F.col("e.A") * (F.col("e.P") + F.col("e.M"))).alias("m"), "n")


def _group() -> Column:
    """Groups of ``GROUP_BLOCKS`` blocks of a partition; they rise with the blocks."""
    part = F.shiftleft(F.shiftright("__block", 33), 33)
    return (part + F.floor((F.col("__block") - part) / F.lit(GROUP_BLOCKS))).cast("long")


def _sorted_maps(at: str) -> Column:
    return F.array_sort(F.collect_list(F.struct(at, "a", "b", "m", "n")))


def _group_maps(blocks: DataFrame, key: str) -> DataFrame:
    """The maps of at most ``GROUP_BLOCKS`` blocks composed to one."""
    def step(acc: Column, x: Column) -> Column:
        return F.struct((x["a"] * acc["a"]).alias("a"), (x["a"] * acc["b"] + x["b"]).alias("b"), F.least(x["m"], x["a"] * acc["m"] + x["b"]).alias("m"), (acc["n"] + x["n"]).alias("n"))

    none = F.struct(F.lit(1.0).alias("a"), F.lit(0.0).alias("b"), F.lit(float("inf")).alias("m"), F.lit(0).cast("long").alias("n"))
    listed = blocks.withColumn("__group", _group()).groupBy(key, "__group").agg(_sorted_maps("__block").alias("x"))
    return listed.select(key, "__group", F.aggregate("x", none, step).alias("e")).select(key, "__group", "e.*")


def _starts(maps: Column, start: Column, at: str) -> Column:
    """The level before each map of a sorted array."""
    kind = f"array<struct<{at}:bigint,start:double>>"

    def step(acc: Column, x: Column) -> Column:
        own = F.array(F.struct(x[at].alias(at), acc["level"].alias("start")))
        return F.struct(F.least(x["m"], x["a"] * acc["level"] + x["b"]).alias("level"), F.concat(acc["out"], own).alias("out"))

    return F.aggregate(maps, F.struct(start.alias("level"), F.array().cast(kind).alias("out")), step, lambda acc: acc["out"])


def contamination_levels(
    events: DataFrame, cleaning_effect: float = CLEANING_EFFECT, key: str = "toilet_id", block_rows: int = BLOCK_ROWS, parts: int | None = None, starts: DataFrame | None = None
) -> DataFrame:
    """Every event with the contamination level of its toilet just before and just after it, starting from 0 (or from the ``level`` of the toilet in ``starts``).

    A use by a colonised patient adds ``amount`` up to 1, a cleaning removes the share ``cleaning_effect``, any other
    use leaves the level.  Order is ``(ts, event_id)``; events without a toilet are left out.  Events are sorted by ranges and cut by position, so one toilet with most of the events, or one
    second with many, is spread over all tasks: three running sums and minima inside blocks of ``block_rows`` events, then blocks and groups of blocks as one map each.
    ``parts`` sets the number of ranges.
    """
    replayed = _replayed(events, cleaning_effect, key, block_rows, parts)
    blocks = materialize(_block_maps(replayed, key), "block-maps")
    groups = _group_maps(blocks, key).groupBy(key).agg(_sorted_maps("__group").alias("x"))
    first = F.lit(0.0)
    if starts is not None:
        groups = groups.join(starts.select(key, F.col("level").alias("__first")), key, "left")
        first = F.coalesce("__first", first)
    group_starts = groups.select(key, F.explode(_starts(F.col("x"), first, "__group")).alias("s")).select(key, "s.*")
    listed = blocks.withColumn("__group", _group()).groupBy(key, "__group").agg(_sorted_maps("__block").alias("x")).join(group_starts, [key, "__group"])
    starts = listed.select(key, F.explode(_starts(F.col("x"), F.col("start"), "__block")).alias("s")).select(key, "s.__block", "s.start")
    joined = replayed.join(starts, [key, "__block"])
    start = F.col("start")
    return joined.select(*events.columns, _level(F.col("A0"), F.col("P0"), F.col("M0"), start).alias("level_before"), _level(F.col("A"), F.col("P"), F.col("M"), start).alias("level_after"))


def final_levels(events: DataFrame, cleaning_effect: float = CLEANING_EFFECT, key: str = "toilet_id", block_rows: int = BLOCK_ROWS, parts: int | None = None) -> DataFrame:
    """Level of every toilet after its last event, and its number of events.

    Only maps are composed: blocks to groups, groups to the toilet. No event is joined or replayed.
    """
    groups = _group_maps(_block_maps(_replayed(events, cleaning_effect, key, block_rows, parts), key), key)
    maps = groups.groupBy(key).agg(_sorted_maps("__group").alias("x"))
    level = F.aggregate("x", F.lit(0.0), lambda acc, x: F.least(x["m"], x["a"] * acc + x["b"]))
    events_ = F.aggregate("x", F.lit(0).cast("long"), lambda acc, x: acc + x["n"])
    return maps.select(key, level.alias("level"), events_.alias("events"))


ASOF_ROWS = 8_192


def exposure_asof(uses: DataFrame, levels: DataFrame, key: str = "toilet_id", level: str = "level_after", block_rows: int = ASOF_ROWS, parts: int | None = None) -> DataFrame:
    """Each use with the latest level strictly before it in ``(ts, event_id)`` order; 0 when there is none.

    As-of join by union: both tables are sorted by ranges and cut into blocks by position, a use looks back inside its block, and
    the last level of earlier blocks is carried in from the reduced table of blocks.
    """
    both = uses.withColumns({"__level_row": F.lit(False), "__level": F.lit(None).cast("double")}).unionByName(
        levels.select(key, "ts", "event_id", F.lit(True).alias("__level_row"), F.col(level).alias("__level")), allowMissingColumns=True
    )
    blocks = ordered_blocks(both, [key, "ts", "event_id", "__level_row"], block_rows, parts)  # a level of the same event comes after the use
    earlier = Window.partitionBy(key, "__block").orderBy("__place").rowsBetween(Window.unboundedPreceding, -1)
    seen = blocks.withColumn("__seen", F.last("__level", ignorenulls=True).over(earlier)).filter(~F.col("__level_row"))
    tails = blocks.groupBy(key, "__block").agg(F.max_by("__level", F.when(F.col("__level").isNotNull(), F.col("__place"))).alias("__tail"))
    carried = exclusive_running(tails, [key], ["__block"], {"__carried": ("last", "__tail")}).drop("__tail")
    found = null_safe_join(seen, carried, [key, "__block"])
    return found.select(*uses.columns, F.coalesce("__seen", "__carried", F.lit(0.0)).alias("exposure"))


# ---- risk and schedules ----------------------------------------------------------------------------------------


def infection_risk(patient_days: DataFrame, uses: DataFrame, effect: float = ANTIBIOTIC_EFFECT, keys: Sequence[str] = ("patient_id", "day")) -> DataFrame:
    """Daily infection risk per patient: de novo, by toilet use, and combined.

    ``patient_days``: keys, ``antibiotic``, ``baseline`` (cases per 10,000 bed days).  ``uses``: keys, ``antibiotic``,
    ``exposure`` (contamination level met).  Independent risks multiply, so hazards add: the combined risk is
    ``1 - exp(-sum)`` and one combinable sum replaces the product.
    """

    def multiplier() -> Column:
        return F.when(F.col("antibiotic"), F.lit(effect)).otherwise(F.lit(1.0))

    zero = F.lit(0.0)
    novo = patient_days.select(*keys, (F.col("baseline") / PER_BED_DAYS * multiplier()).alias("h_novo"), zero.alias("h_toilet"), F.lit(0).cast("long").alias("use"))
    toilet = uses.select(*keys, zero.alias("h_novo"), (F.col("exposure") * multiplier()).alias("h_toilet"), F.lit(1).cast("long").alias("use"))
    total = novo.unionByName(toilet).groupBy(*keys).agg(F.sum("h_novo").alias("h_novo"), F.sum("h_toilet").alias("h_toilet"), F.sum("use").alias("uses"))
    return total.select(
        *keys, "uses", risk(F.col("h_novo")).alias("p_de_novo"), risk(F.col("h_toilet")).alias("p_toilet"),
        risk(F.col("h_novo") + F.col("h_toilet")).alias("p_infection"),
    )


# parameters switched by both periods, and by the outbreak only
SHARED_PARAMS = ["toilet_cleaning_effect", "toilet_cleaning_rate", "antibiotic_prescription_rate", "proportion_redistributed", "side_room_delay_mean"]
OUTBREAK_PARAMS = ["toilet_frequenting_rate", "toilet_contamination_effect", "community_colonisation_rate"]


def scheduled_parameters(days: DataFrame, design: DataFrame, outbreak: bool = True, control: bool = True, step: str = "step") -> DataFrame:
    """The value of every scheduled parameter on every day of a run.

    Periods are half-open on the left: outbreak ``start < t <= end``, control likewise; control overrides the outbreak
    for the shared parameters, and after the control end those are back at baseline even if the outbreak goes on.
    The trigger columns live on the design row, so one equi-join and a conditional replace a range join.
    """
    shared, own = ([p for p in names if p in design.columns] for names in (SHARED_PARAMS, OUTBREAK_PARAMS))
    t = F.col(step)
    joined = days.join(small_or_self(design), "siminputrow")

    def in_outbreak(name: str) -> Column:
        if not outbreak:
            return F.col(name)
        return F.when(t > F.col("outbreak_end"), F.col(name)).when(t > F.col("outbreak_start"), F.col(f"o_{name}")).otherwise(F.col(name))

    def in_control(name: str) -> Column:
        if not control:
            return in_outbreak(name)
        return F.when(t > F.col("control_end"), F.col(name)).when(t > F.col("control_start"), F.col(f"c_{name}")).otherwise(in_outbreak(name))

    return joined.select(*days.columns, *[in_outbreak(p).alias(f"now_{p}") for p in own], *[in_control(p).alias(f"now_{p}") for p in shared])


def period_lookup(points: DataFrame, periods: DataFrame, at: str, values: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Values of the highest-priority period covering each point (``t_from < t <= t_to``); a smaller name wins ties. Points outside all periods get nulls.

    ``at`` is an integer or date column of ``points``; ``periods`` has ``name, t_from, t_to, priority``, the columns ``values`` and, where each key has a schedule of its own, the key
    columns ``by`` (nulls match nulls). An interval join without comparing points and periods: a period is cut into the few aligned stretches of 1, 2, 4, ... steps that make it up,
    each stretch keeps its best period in a combinable aggregation, and a point asks the stretch of every size that it lies in. Work grows with
    the number of periods and of distinct points times the logarithm of the range, not with how many periods cover a point.
    """
    by = list(by)
    day = points.schema[at].dataType.simpleString() == "date"

    def number(c: Column) -> Column:
        return (F.unix_date(c) if day else c).cast("long")

    moments = materialize(points.select(*by, F.col(at).alias("__at"), number(F.col(at)).alias("__t")).filter(F.col("__t").isNotNull()).distinct(), "moments")
    ends = moments.agg(F.min("__t").alias("low"), F.max("__t").alias("high")).first()
    low, high = (ends["low"], ends["high"]) if ends["low"] is not None else (0, 0)
    levels = (high - low).bit_length() + 1
    whole = (lambda c: F.unix_date(F.to_date(c)).cast("long")) if day else (lambda c: F.floor(F.least(F.greatest(c.cast("double"), F.lit(low - 1.0)), F.lit(high + 1.0))).cast("long"))
    best = F.struct((-F.col("priority")).alias("order"), "name", "t_from", "t_to", *values)
    # first and one past the last step, counted from ``low``
    first = F.greatest(whole(F.col("t_from")) + 1, F.lit(low)) - low
    past = F.least(whole(F.col("t_to")), F.lit(high)) + 1 - low

    def climb(acc: Column, level: Column) -> Column:
        a, z, open_ = acc["a"], acc["z"], acc["a"] < acc["z"]
        left, right = open_ & (a % 2 == 1), open_ & (z % 2 == 1)
        node = lambda n: F.array(F.struct(level.alias("level"), n.alias("node")))
        none = F.array().cast("array<struct<level:int,node:bigint>>")
        found = F.concat(acc["found"], F.when(left, node(a)).otherwise(none), F.when(right & (z - 1 >= F.when(left, a + 1).otherwise(a)), node(z - 1)).otherwise(none))
        return F.struct(F.floor((F.when(left, a + 1).otherwise(a)) / 2).alias("a"), F.floor((F.when(right, z - 1).otherwise(z)) / 2).alias("z"), found.alias("found"))

    start = F.struct(first.cast("long").alias("a"), past.cast("long").alias("z"), F.array().cast("array<struct<level:int,node:bigint>>").alias("found"))
    cut = F.aggregate(F.sequence(F.lit(0), F.lit(levels)), start, climb, lambda acc: acc["found"])
    kept = periods.filter((F.col("t_from") < F.col("t_to")) & (first < past)).select(*by, best.alias("best"), F.explode(cut).alias("n"))
    stretches = kept.groupBy(*by, "n.level", "n.node").agg(F.min("best").alias("best"))
    asked = moments.select(*by, "__at", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(levels)), lambda k: F.floor((F.col("__t") - low) / F.pow(F.lit(2.0), k)).cast("long"))).alias("level", "node"))
    found = null_safe_join(asked, stretches, [*by, "level", "node"]) if by else asked.join(stretches, ["level", "node"])
    answers = found.groupBy(*by, "__at").agg(F.min("best").alias("__best")).withColumnRenamed("__at", at)
    joined = null_safe_join(points, answers, [*by, at], "left")
    return joined.select(*[F.col(c) for c in points.columns], F.col("__best.name").alias("period"), *[F.col(f"__best.{v}").alias(v) for v in values])
