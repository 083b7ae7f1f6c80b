"""SQL of the input tables and of the common steps, as named blocks for ``WITH`` clauses."""

from __future__ import annotations

from wardlight.sources.derived import DAYS, EXTRA_COLUMNS, FIRST_DAY, POSTERIOR_COLUMNS, SCHEDULE_COLUMNS, WARDS

BLOCKS: dict[str, tuple[tuple[str, ...], str]] = {}


def block(name: str, sql: str, *needs: str) -> None:
    BLOCKS[name] = (needs, sql)


def with_blocks(sql: str, *names: str, recursive: bool = False) -> str:
    """``sql`` behind the named blocks and everything they need."""
    order: list[str] = []

    def visit(name: str) -> None:
        if name in order:
            return
        for need in BLOCKS[name][0]:
            visit(need)
        order.append(name)

    for name in names:
        visit(name)
    clauses = ",\n".join(f"{n} AS ({BLOCKS[n][1]})" for n in order)
    return f"WITH {'RECURSIVE ' if recursive else ''}{clauses}\n{sql}"


def real(value: float) -> str:
    """A DOUBLE literal (a plain decimal literal would be DECIMAL)."""
    return f"CAST({value!r} AS DOUBLE)"


block("spine", f"SELECT CAST(i AS INTEGER) + 1 AS step FROM range(0, {DAYS}) t(i)")
block(
    "daily",
    f"""SELECT l_suppkey AS siminputrow, CAST(l_linenumber % 3 AS BIGINT) AS random_seed,
    CAST(CAST(l_shipdate AS DATE) - DATE '{FIRST_DAY}' AS INTEGER) + 1 AS step,
    COUNT(*) FILTER (WHERE l_returnflag = 'R') AS hospital, COUNT(*) FILTER (WHERE l_returnflag = 'A') AS community,
    COUNT(*) AS admitted, SUM(l_quantity) AS beds FROM lineitem GROUP BY 1, 2, 3""",
)
block(
    "runs",
    """SELECT 'exp_' || CAST(k.siminputrow % 4 AS VARCHAR) AS experiment, k.siminputrow, k.random_seed, s.step,
    CAST(SUM(COALESCE(hospital, 0) + COALESCE(community, 0)) OVER w AS BIGINT) AS total_colonised,
    CAST(SUM(COALESCE(admitted, 0)) OVER w AS BIGINT) AS total_patients_admitted,
    CAST(SUM(COALESCE(hospital, 0)) OVER w AS BIGINT) AS total_hospital_infections,
    COALESCE(community, 0) AS current_community_infections, COALESCE(hospital, 0) AS current_hospital_infections,
    CAST(100 + COALESCE(beds, 0) AS DOUBLE) AS current_inpatients, COALESCE(community, 0) + COALESCE(hospital, 0) AS current_colonised
    FROM (SELECT DISTINCT siminputrow, random_seed FROM daily) k CROSS JOIN spine s
    LEFT JOIN daily d ON d.siminputrow = k.siminputrow AND d.random_seed = k.random_seed AND d.step = s.step
    WINDOW w AS (PARTITION BY k.siminputrow, k.random_seed ORDER BY s.step ROWS UNBOUNDED PRECEDING)""",
    "daily", "spine",
)
block(
    "dated",
    """SELECT *, CAST(DATE '2002-01-01' + CAST(ROW_NUMBER() OVER (PARTITION BY siminputrow, random_seed ORDER BY step) - 1 AS INTEGER) AS DATE) AS date_sim
    FROM runs WHERE step > 31""",
    "runs",
)
block(
    "monthly",
    """SELECT siminputrow, random_seed, CAST(date_trunc('month', date_sim) AS DATE) AS month,
    (MAX(total_hospital_infections) - MIN(total_hospital_infections)) / SUM(current_inpatients) * 1000 AS rate, COUNT(*) AS n_days
    FROM dated GROUP BY 1, 2, 3""",
    "dated",
)
block("stats", "SELECT siminputrow, month, AVG(rate) AS rate FROM monthly GROUP BY 1, 2", "monthly")
block("observed", "SELECT month, AVG(rate) AS rate FROM stats GROUP BY 1", "stats")
block(
    "sparse",
    """SELECT siminputrow, random_seed, step, hospital AS current_hospital_infections, 100 + beds AS current_inpatients FROM daily""",
    "daily",
)

PRE = "DATE '2004-10-01'"


def abc_blocks(prefix: str, month_filter: str) -> None:
    """Blocks ``<prefix>_stats``, ``_median``, ``_mad``, ``_distance`` for one month filter."""
    block(
        f"{prefix}_stats",
        f"SELECT s.siminputrow, s.month, s.rate, o.rate AS target FROM stats s JOIN observed o ON o.month = s.month WHERE {month_filter}",
        "stats", "observed",
    )
    block(f"{prefix}_median", f"SELECT month, MEDIAN(rate) AS median FROM {prefix}_stats GROUP BY 1", f"{prefix}_stats")
    block(
        f"{prefix}_mad",
        f"""SELECT s.month, s.target, m.median, {real(1.4826)} * MEDIAN(ABS(s.rate - m.median)) AS mad
        FROM {prefix}_stats s JOIN {prefix}_median m ON m.month = s.month GROUP BY 1, 2, 3""",
        f"{prefix}_median",
    )
    block(
        f"{prefix}_distance",
        f"""SELECT s.siminputrow, SQRT(SUM(POWER((s.rate - s.target) / CASE WHEN m.mad = 0 THEN 1 ELSE m.mad END, 2))) AS distance
        FROM {prefix}_stats s JOIN {prefix}_mad m ON m.month = s.month GROUP BY 1""",
        f"{prefix}_mad",
    )


abc_blocks("pre", f"s.month < {PRE}")
abc_blocks("full", "s.month <= DATE '2008-05-01'")
for _name, _tol in (("pre", "0.05"), ("full", "0.025")):
    block(
        f"{_name}_accepted",
        f"""SELECT * FROM (SELECT siminputrow, distance, ROW_NUMBER() OVER (ORDER BY distance, siminputrow) AS accept_rank FROM {_name}_distance) r
        WHERE accept_rank <= (SELECT CAST(CEIL(COUNT(*) * CAST({_tol} AS DOUBLE)) AS BIGINT) FROM {_name}_distance)""",
        f"{_name}_distance",
    )

block(
    "design",
    f"""SELECT s_suppkey AS siminputrow,
    ROUND({real(0.5)} + {real(2.5)} * s_nationkey / {real(24.0)}, 3) AS toilet_cleaning_rate,
    ROUND({real(0.01)} + {real(0.09)} * (s_acctbal + 1000) / {real(11000.0)}, 3) AS community_colonisation_rate,
    ROUND({real(0.01)} + {real(0.000907)} * ((s_suppkey * 37) % 101), 3) AS o_community_colonisation_rate FROM supplier""",
)
block("sensitivity", f"SELECT s_suppkey AS siminputrow, s_suppkey % 4 AS arm, {real(0.015625)} * (1 + (s_suppkey // 4) % 25) AS level FROM supplier")
block(
    "uniforms",
    f"SELECT p_partkey AS row_id, (p_partkey * {real(0.6180339887)}) % {real(1.0)} AS u1, (p_partkey * {real(0.7548776662)}) % {real(1.0)} AS u2 FROM part",
)
block(
    "posterior",
    "SELECT p_partkey AS siminputrow, "
    + ", ".join(f"{real(lo)} + ({real(hi)} - {real(lo)}) * ((p_partkey * {real(m)}) % {real(1.0)}) AS {n}" for n, (lo, hi, m) in POSTERIOR_COLUMNS.items())
    + " FROM part",
)
block("full_posterior", "SELECT *, " + ", ".join(f"{real(low)} + ({real(high)} - {real(low)}) * ((siminputrow * {real(mult)}) % {real(1.0)}) AS {name}" for name, (low, high, mult) in EXTRA_COLUMNS.items()) + " FROM posterior", "posterior")
block("posterior_long", f"SELECT siminputrow, param, value FROM posterior UNPIVOT (value FOR param IN ({', '.join(POSTERIOR_COLUMNS)}))", "posterior")
block(
    "posterior_summary",
    """SELECT param, AVG(value) AS mean, STDDEV_SAMP(value) AS sd, QUANTILE_CONT(value, 0.25) AS q25, MEDIAN(value) AS median, QUANTILE_CONT(value, 0.75) AS q75
    FROM posterior_long GROUP BY 1""",
    "posterior_long",
)
block(
    "rooms",
    f"SELECT CAST(p_partkey % {WARDS} AS INTEGER) + 1 AS ward, CAST(p_partkey // {WARDS} AS INTEGER) + 1 AS room, p_size <= 7 AS is_bay FROM part",
)
block(
    "stays",
    f"""SELECT o_orderkey AS stay_id, CAST(o_custkey % {WARDS} AS INTEGER) + 1 AS ward, CAST(o_custkey % 10 AS INTEGER) + 1 AS bed,
    CAST(o_orderdate AS DATE) AS admit, CAST(o_orderdate AS DATE) + CAST(1 + o_orderkey % 9 AS INTEGER) AS discharge,
    o_orderstatus = 'F' AS community_infection,
    CASE WHEN o_orderstatus = 'P' THEN CAST(o_orderdate AS DATE) + CAST((o_orderkey % 9) // 2 AS INTEGER) END AS hospital_infection_date,
    o_orderpriority IN ('1-URGENT', '2-HIGH') AS antibiotic FROM orders""",
)
block(
    "queue_events",
    """SELECT stay_id, COALESCE(hospital_infection_date, admit) AS entry, CAST(stay_id % 4 AS INTEGER) AS delay_days, discharge AS leave
    FROM stays WHERE community_infection OR hospital_infection_date IS NOT NULL""",
    "stays",
)
block(
    "toilet_events",
    f"""SELECT user_id AS toilet_id, event_id, ts, CASE WHEN event_type = 'purchase' THEN 'clean' ELSE 'use' END AS kind,
    event_type NOT IN ('purchase', 'view') AS colonised, LEAST(value / {real(500.0)}, {real(0.4)}) AS amount FROM events""",
)
block("ordered_events", "SELECT *, ROW_NUMBER() OVER (PARTITION BY toilet_id ORDER BY ts, event_id) AS rn FROM toilet_events", "toilet_events")
block(
    "replay",
    f"""SELECT toilet_id, rn, event_id, ts, kind, colonised, {real(0.0)} AS level_before,
    CASE WHEN kind = 'use' AND colonised THEN LEAST({real(1.0)}, amount) ELSE {real(0.0)} END AS level_after FROM ordered_events WHERE rn = 1
    UNION ALL
    SELECT e.toilet_id, e.rn, e.event_id, e.ts, e.kind, e.colonised, r.level_after,
    CASE WHEN e.kind = 'clean' THEN r.level_after * ({real(1.0)} - {real(0.8)})
         WHEN e.colonised THEN LEAST({real(1.0)}, r.level_after + e.amount) ELSE r.level_after END
    FROM replay r JOIN ordered_events e ON e.toilet_id = r.toilet_id AND e.rn = r.rn + 1""",
    "ordered_events",
)


def _schedule_value(base: float, step: float, name: str) -> str:
    return f"{real(base)} + {real(step)} * (s_suppkey % 10) AS {name}"


block(
    "schedule",
    f"""SELECT s_suppkey AS siminputrow, CAST(900 + (s_suppkey * 37) % 200 AS DOUBLE) AS outbreak_start, CAST(1150 + (s_suppkey * 53) % 200 AS DOUBLE) AS outbreak_end,
    {real(1049.0)} AS control_start, CAST(1300 + (s_suppkey * 29) % 60 AS DOUBLE) AS control_end, """
    + ", ".join(_schedule_value(b, s, p + n) for n, values in SCHEDULE_COLUMNS.items() for p, b, s in values)
    + " FROM supplier",
)
