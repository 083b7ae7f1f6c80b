"""Queries over hospital event tables, in batch and streaming form."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import functions as F

from wardlight.catalog.blocks import real, with_blocks
from wardlight.catalog.registry import Registry
from wardlight.operators import hospital, timeline
from wardlight.session import scratch_path
from wardlight.sources import derived
from wardlight.sources.derived import SCHEDULE_COLUMNS
from wardlight.streaming import contamination, monthly

SCHEDULED = [*hospital.OUTBREAK_PARAMS, *hospital.SHARED_PARAMS]


def _long(df, *columns):
    return df.withColumns({c: F.col(c).cast("long") for c in columns})


def l1_daily_census(spark, sf):
    return hospital.daily_census(derived.stays(spark, sf))


def l1_daily_census_by_ward(spark, sf):
    return _long(hospital.daily_census(derived.stays(spark, sf), ["ward"]), "ward")


def l2_cumulative_counters(spark, sf):
    return hospital.cumulative_counters(derived.stays(spark, sf))


def l2_counters_by_ward(spark, sf):
    return _long(hospital.cumulative_counters(derived.stays(spark, sf), ["ward"], distinct_patients=True), "ward")


def l3_length_of_stay(spark, sf):
    return _long(hospital.length_of_stay_summary(derived.stays(spark, sf), ["ward"]), "ward")


def l4_layout_summary(spark, sf):
    return hospital.layout_summary(derived.rooms(spark, sf))


def l5_allocate_evenly(spark, sf):
    wards = derived.table(spark, sf, "supplier").select((F.col("s_suppkey") + 1).alias("ward"))
    return _long(hospital.allocate_evenly(wards, 18, 0.13), "room")


def l6_double_occupancy(spark, sf):
    return _long(hospital.double_occupancy(derived.stays(spark, sf)), "ward", "bed")


def l7_queue_lengths(spark, sf):
    return hospital.queue_lengths(derived.queue_events(spark, sf))


def l8_contamination_levels(spark, sf):
    return hospital.contamination_levels(derived.toilet_events(spark, sf)).select("toilet_id", "event_id", "level_before", "level_after")


def l8_final_levels(spark, sf):
    return hospital.final_levels(derived.toilet_events(spark, sf))


def _exposing():
    return (F.col("kind") == "use") & ~F.col("colonised")


def l10_exposure_asof(spark, sf):
    """Uses by patients who are not colonised, with the level left by the earlier events, from two tables."""
    events = derived.toilet_events(spark, sf)
    levels = hospital.contamination_levels(events).filter(~_exposing()).select("toilet_id", "event_id", "ts", "level_after")
    return hospital.exposure_asof(events.filter(_exposing()).select("toilet_id", "event_id", "ts"), levels).drop("ts")


def l9_infection_risk(spark, sf):
    """Patients are identified with the toilet they use: one patient per user and day."""
    keyed = {"day": F.to_date("ts"), "antibiotic": F.col("patient_id") % 2 == 0}
    # the level before a use is what its patient meets: the replay gives it without a second table
    replayed = hospital.contamination_levels(derived.toilet_events(spark, sf)).filter(_exposing())
    uses = replayed.withColumnRenamed("toilet_id", "patient_id").withColumns(keyed).select("patient_id", "day", "antibiotic", F.col("level_before").alias("exposure"))
    events = derived.toilet_events(spark, sf).withColumnRenamed("toilet_id", "patient_id").withColumns(keyed)
    days = events.select("patient_id", "day", "antibiotic").distinct().withColumn("baseline", F.lit(6.7))
    return hospital.infection_risk(days, uses)


def l11_period_params(spark, sf):
    """Schedule over the days of every run, as spans of equal values per parameter set."""
    days = derived.runs(spark, sf).select("siminputrow", "random_seed", "step")
    values = hospital.scheduled_parameters(days, derived.schedule_design(spark, sf))
    names = [f"now_{p}" for p in SCHEDULED]
    spans = values.groupBy("siminputrow", *names).agg(F.min("step").alias("first_step"), F.max("step").alias("last_step"), F.count(F.lit(1)).alias("rows"))
    return _long(spans, "first_step", "last_step")


def l11_period_lookup(spark, sf):
    """One short schedule for all run days: the fixed calibrated triggers."""
    periods = spark.createDataFrame(
        [("baseline", 0.0, float("inf"), 0, 2.376), ("outbreak", 1029.962, 1246.789, 1, 1.574), ("control", 1049.0, 1335.573, 2, 3.36)],
        "name string, t_from double, t_to double, priority int, cleaning_rate double",
    )
    days = derived.runs(spark, sf).select("siminputrow", "random_seed", "step")
    found = hospital.period_lookup(days, periods, "step", ["cleaning_rate"])
    return found.groupBy("siminputrow", "period", "cleaning_rate").agg(F.count(F.lit(1)).alias("rows"), F.min("step").cast("long").alias("first_step"))


def l11_interval_join(spark, sf):
    """Every shipped line as a point of a ward's calendar, every stay as a period with a priority: which stay's bed counts on that day."""
    stays = derived.stays(spark, sf)
    periods = stays.select(
        "ward", F.col("stay_id").cast("string").alias("name"), F.col("admit").alias("t_from"), F.col("discharge").alias("t_to"), (F.col("stay_id") % 5).cast("int").alias("priority"), "bed")
    lines = derived.table(spark, sf, "lineitem").select((F.col("l_suppkey") % derived.WARDS + 1).cast("int").alias("ward"), F.to_date("l_shipdate").alias("day"))
    found = hospital.period_lookup(lines, periods, "day", ["bed"], ["ward"])
    return found.groupBy(F.col("ward").cast("long").alias("ward"), "day", "period", F.col("bed").cast("long").alias("bed")).agg(F.count(F.lit(1)).alias("lines"))


@contextmanager
def _stream_settings(spark, more=()):
    """RocksDB state and one state partition per core while a stream starts; state partitions are not coalesced."""
    wanted = {
        "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
        "spark.sql.shuffle.partitions": str(spark.sparkContext.defaultParallelism),
        **dict(more),
    }
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


# What a stream that goes on for long leaves on disk: old versions of its state are removed as it goes, shuffle files with each batch.
SHORT_HISTORY = {
    "spark.sql.streaming.minBatchesToRetain": "2",
    "spark.sql.streaming.stateStore.maintenanceInterval": "10s",
    "spark.sql.streaming.stateStore.rocksdb.compression": "lz4",  # each commit writes the state anew
    "spark.sql.streaming.stateStore.rocksdb.trackTotalNumberOfRows": "false",
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
}


def t1_monthly_stream(spark, sf):
    """Daily rows delivered as files in order of time, those of one year twice, read as a stream; equals the batch rate."""
    rows = timeline.assign_dates(timeline.drop_burn_in(derived.runs(spark, sf)), "gapless")
    rows = rows.select(*timeline.RUN_KEYS, "step", "total_hospital_infections", "current_inpatients", F.to_timestamp("date_sim").alias("ts"))
    out, checkpoint = scratch_path(spark, "t1-out"), scratch_path(spark, "t1-checkpoint")
    with _stream_settings(spark, SHORT_HISTORY):
        monthly.run_deliveries(rows, scratch_path(spark, "t1-source"), out, checkpoint, twice=F.year("ts") == 2003)
    return monthly.latest_rates(spark, out)


def t2_contamination_stream(spark, sf):
    """Toilet events as a stream; what still waits for the watermark when it ends is replayed as a batch from the levels that it left."""
    events = derived.toilet_events(spark, sf).withColumn("ts", F.col("ts").cast("timestamp"))
    source = scratch_path(spark, "t2-source")
    events.write.parquet(source)
    stream = spark.readStream.schema(events.schema).parquet(source)
    out = scratch_path(spark, "t2-out")
    levels = contamination.contamination_stream(stream, "1 hour")
    with _stream_settings(spark):
        sink = levels.writeStream.format("parquet").option("path", out).option("checkpointLocation", scratch_path(spark, "t2-checkpoint"))
        sink.outputMode("append").trigger(availableNow=True).start().awaitTermination()
    emitted = spark.read.parquet(out)
    closing = contamination.closing_levels(spark.read.parquet(source), emitted, "1 hour")
    return emitted.unionByName(closing).select("toilet_id", "event_id", "level_before", "level_after")


def register(r: Registry) -> None:
    present = "s.admit <= d.day AND d.day < s.discharge"
    hospital_now = "s.hospital_infection_date IS NOT NULL AND GREATEST(s.hospital_infection_date, s.admit) <= d.day"

    def census(by: str) -> str:
        pick, group, cond = ("", "1", "") if not by else ("CAST(d.ward AS BIGINT) AS ward, ", "1, 2", " AND s.ward = d.ward")
        days = (
            "SELECT CAST(MIN(admit) + CAST(i AS INTEGER) AS DATE) AS day FROM stays, range(4000) g(i) GROUP BY i HAVING MIN(admit) + CAST(i AS INTEGER) <= MAX(discharge)"
            if not by
            else "SELECT ward, CAST(MIN(admit) + CAST(i AS INTEGER) AS DATE) AS day FROM stays, range(4000) g(i) GROUP BY ward, i HAVING MIN(admit) + CAST(i AS INTEGER) <= MAX(discharge)"
        )
        days = days.replace("FROM stays,", f"FROM (SELECT {'ward, ' if by else ''}MIN(admit) AS admit, MAX(discharge) AS discharge FROM stays{' GROUP BY 1' if by else ''}) b,")
        return f"""SELECT {pick}d.day, COUNT(s.stay_id) AS inpatients, COUNT(*) FILTER (WHERE s.community_infection) AS community,
            COUNT(*) FILTER (WHERE {hospital_now}) AS hospital, COUNT(*) FILTER (WHERE s.community_infection OR ({hospital_now})) AS colonised
            FROM ({days}) d LEFT JOIN stays s ON {present}{cond} GROUP BY {group}"""

    r.add("l1_daily_census", l1_daily_census, with_blocks(census(""), "stays"))
    r.add("l1_daily_census_by_ward", l1_daily_census_by_ward, with_blocks(census("ward"), "stays"))

    def counters(by: str) -> str:
        pick, part = ("CAST(ward AS BIGINT) AS ward, ", "PARTITION BY ward ") if by else ("", "")
        ward = "ward, " if by else ""
        return f"""SELECT {pick}day, CAST(SUM(a) OVER w AS BIGINT) AS admitted, CAST(SUM(c) OVER w AS BIGINT) AS colonised, CAST(SUM(h) OVER w AS BIGINT) AS hospital_infections FROM
            (SELECT {ward}day, SUM(a) AS a, SUM(c) AS c, SUM(h) AS h FROM (SELECT {ward}admit AS day, 1 AS a, CAST(community_infection AS INTEGER) AS c, 0 AS h FROM stays
             UNION ALL SELECT {ward}hospital_infection_date, 0, 1, 1 FROM stays WHERE hospital_infection_date IS NOT NULL) e GROUP BY {'1, 2' if by else '1'}) t
            WINDOW w AS ({part}ORDER BY day ROWS UNBOUNDED PRECEDING)"""

    r.add("l2_cumulative_counters", l2_cumulative_counters, with_blocks(counters(""), "stays"))
    r.add("l2_counters_by_ward", l2_counters_by_ward, with_blocks(counters("ward"), "stays"))
    los = "date_diff('day', admit, discharge)"
    r.add(
        "l3_length_of_stay", l3_length_of_stay,
        with_blocks(
            f"""SELECT CAST(ward AS BIGINT) AS ward, COUNT(*) AS stays, MIN({los}) AS min, QUANTILE_CONT(CAST({los} AS DOUBLE), 0.25) AS q25, MEDIAN({los}) AS median, QUANTILE_CONT(CAST({los} AS DOUBLE), 0.75) AS q75,
            MAX({los}) AS max, AVG({los}) AS mean FROM stays GROUP BY 1""", "stays"), ["q25", "median", "q75", "mean"],
    )
    spread = ", ".join(f"CAST({f.upper()}({c}) AS DOUBLE) AS {f}_{c}" for c in ("bays", "capacity") for f in ("min", "median", "max"))
    r.add(
        "l4_layout_summary", l4_layout_summary,
        with_blocks(
            f"""SELECT COUNT(*) AS wards, CAST(SUM(capacity) AS BIGINT) AS capacity, CAST(SUM(bays) AS BIGINT) AS bays, CAST(SUM(side_rooms) AS BIGINT) AS side_rooms, {spread} FROM
            (SELECT ward, COUNT(*) FILTER (WHERE is_bay) AS bays, COUNT(*) FILTER (WHERE NOT is_bay) AS side_rooms, SUM(CASE WHEN is_bay THEN 4 ELSE 1 END) AS capacity FROM rooms GROUP BY 1) t""", "rooms"),
        [f"{f}_{c}" for c in ("bays", "capacity") for f in ("min", "median", "max")],
    )
    r.add(
        "l5_allocate_evenly", l5_allocate_evenly,
        f"""WITH n AS (SELECT COUNT(*) AS w, CAST(FLOOR({real(0.13)} * COUNT(*) * 18) AS BIGINT) AS bays FROM supplier)
        SELECT s_suppkey + 1 AS ward, i + 1 AS room, i < LEAST(18, bays // w + CASE WHEN s_suppkey + 1 <= bays % w THEN 1 ELSE 0 END) AS is_bay FROM supplier CROSS JOIN n CROSS JOIN range(18) g(i)""",
    )
    r.add(
        "l6_double_occupancy", l6_double_occupancy,
        with_blocks(
            """SELECT stay_id, CAST(ward AS BIGINT) AS ward, CAST(bed AS BIGINT) AS bed, admit, discharge FROM
            (SELECT *, MAX(discharge) OVER (PARTITION BY ward, bed ORDER BY admit, stay_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS held FROM stays) t WHERE held > admit""", "stays"),
    )
    r.add(
        "l7_queue_lengths", l7_queue_lengths,
        with_blocks(
            """SELECT d.day, COUNT(*) FILTER (WHERE d.day >= q.entry AND d.day < LEAST(q.entry + q.delay_days, q.leave)) AS delay_queue,
            COUNT(*) FILTER (WHERE d.day >= q.entry + q.delay_days AND d.day < q.leave) AS ready_queue FROM
            (SELECT CAST(a + CAST(i AS INTEGER) AS DATE) AS day FROM (SELECT MIN(entry) AS a, MAX(leave) AS b FROM queue_events) r, range(4000) g(i) WHERE a + CAST(i AS INTEGER) <= b) d
            LEFT JOIN queue_events q ON d.day >= q.entry AND d.day < q.leave GROUP BY 1""", "queue_events"),
    )
    levels = ["level_before", "level_after"]
    r.add("l8_contamination_levels", l8_contamination_levels, with_blocks("SELECT toilet_id, event_id, level_before, level_after FROM replay", "replay", recursive=True), levels)
    r.add(
        "l8_final_levels", l8_final_levels,
        with_blocks("SELECT toilet_id, arg_max(level_after, rn) AS level, COUNT(*) AS events FROM replay GROUP BY 1", "replay", recursive=True), ["level"],
    )
    r.add("l10_exposure_asof", l10_exposure_asof, with_blocks("SELECT toilet_id, event_id, level_before AS exposure FROM replay WHERE kind = 'use' AND NOT colonised", "replay", recursive=True), ["exposure"])
    effect = f"CASE WHEN patient_id % 2 = 0 THEN {real(1.5)} ELSE 1 END"
    r.add(
        "l9_infection_risk", l9_infection_risk,
        with_blocks(
            f"""SELECT patient_id, day, CAST(uses AS BIGINT) AS uses, 1 - EXP(-hn) AS p_de_novo, 1 - EXP(-ht) AS p_toilet, 1 - (1 - (1 - EXP(-hn))) * (1 - (1 - EXP(-ht))) AS p_infection FROM
            (SELECT patient_id, day, {real(6.7)} / 10000 * {effect} AS hn, COALESCE(SUM(level_before) FILTER (WHERE kind = 'use' AND NOT colonised), 0) * {effect} AS ht,
             COUNT(*) FILTER (WHERE kind = 'use' AND NOT colonised) AS uses FROM (SELECT toilet_id AS patient_id, CAST(ts AS DATE) AS day, kind, colonised, level_before FROM replay) r GROUP BY 1, 2) t""",
            "replay", recursive=True), ["p_de_novo", "p_toilet", "p_infection"],
    )

    def scheduled(name: str) -> str:
        periods = [p for p, _, _ in SCHEDULE_COLUMNS[name]]
        value = f"CASE WHEN t > outbreak_end THEN s.{name} WHEN t > outbreak_start THEN s.o_{name} ELSE s.{name} END"
        if "c_" in periods:
            value = f"CASE WHEN t > control_end THEN s.{name} WHEN t > control_start THEN s.c_{name} ELSE {value} END"
        return f"{value} AS now_{name}"

    names = ", ".join(f"now_{p}" for p in SCHEDULED)
    r.add(
        "l11_period_params", l11_period_params,
        with_blocks(
            f"""SELECT siminputrow, {names}, MIN(t) AS first_step, MAX(t) AS last_step, COUNT(*) AS rows FROM
            (SELECT d.siminputrow, d.t, {', '.join(scheduled(p) for p in SCHEDULED)} FROM (SELECT siminputrow, CAST(step AS BIGINT) AS t FROM runs) d JOIN schedule s ON s.siminputrow = d.siminputrow) x
            GROUP BY ALL""", "runs", "schedule"), [f"now_{p}" for p in SCHEDULED],
    )
    r.add(
        "l11_period_lookup", l11_period_lookup,
        with_blocks(
            f"""SELECT siminputrow, period, cleaning_rate, COUNT(*) AS rows, CAST(MIN(step) AS BIGINT) AS first_step FROM
            (SELECT siminputrow, step, CASE WHEN step > 1049 AND step <= 1335.573 THEN 'control' WHEN step > 1029.962 AND step <= 1246.789 THEN 'outbreak' ELSE 'baseline' END AS period,
             CASE WHEN step > 1049 AND step <= 1335.573 THEN {real(3.36)} WHEN step > 1029.962 AND step <= 1246.789 THEN {real(1.574)} ELSE {real(2.376)} END AS cleaning_rate FROM runs) t GROUP BY 1, 2, 3""", "runs"),
        ["cleaning_rate"],
    )
    r.add(
        "l11_interval_join", l11_interval_join,
        with_blocks(
            """SELECT l.ward, l.day, p.best.name AS period, CAST(p.best.bed AS BIGINT) AS bed, l.lines FROM
            (SELECT CAST(l_suppkey % 24 + 1 AS BIGINT) AS ward, CAST(l_shipdate AS DATE) AS day, COUNT(*) AS lines FROM lineitem GROUP BY 1, 2) l LEFT JOIN
            (SELECT d.ward, d.day, MIN({'order': -(stay_id % 5), 'name': CAST(stay_id AS VARCHAR), 'bed': bed}) AS best FROM (SELECT DISTINCT l_suppkey % 24 + 1 AS ward, CAST(l_shipdate AS DATE) AS day FROM lineitem) d
             JOIN stays s ON s.ward = d.ward AND d.day > s.admit AND d.day <= s.discharge GROUP BY 1, 2) p ON p.ward = l.ward AND p.day = l.day""", "stays"),
    )
    r.add("t1_monthly_stream", t1_monthly_stream, with_blocks("SELECT * FROM monthly", "monthly"), ["rate"])
    r.add("t2_contamination_stream", t2_contamination_stream, with_blocks("SELECT toilet_id, event_id, level_before, level_after FROM replay", "replay", recursive=True), levels)
