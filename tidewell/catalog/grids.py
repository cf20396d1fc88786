"""Resampling, grids, index moves and gaps."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewell.catalog.base import CTE_BINS, CTE_EVENTS, bins, both, events, query, table
from tidewell.frames import Shape, tick
from tidewell.functions.durations import from_micros
from tidewell.operators import gaps as g
from tidewell.operators import resampling as r

HOUR = 3_600_000_000


def _resampled(step: str) -> str:
    """Bins counted from midnight of the first day, on the full grid."""
    return f"""o AS (SELECT metric, date_trunc('day', min(timestamp)) AS origin FROM e GROUP BY metric),
    b AS (SELECT metric, time_bucket({step}, timestamp, origin) AS bin, avg(value) AS value, arg_min(value, timestamp) AS f
    FROM e JOIN o USING (metric) GROUP BY ALL),
    p AS (SELECT metric, unnest(generate_series(min(bin), max(bin), {step})) AS bin FROM b GROUP BY metric),
    x AS (SELECT metric, bin AS timestamp, b.value, b.f FROM p LEFT JOIN b USING (metric, bin))"""


for _name, _freq, _step in (("", "7min", "INTERVAL 7 MINUTE"), ("_hours", "1h", "INTERVAL 1 HOUR"), ("_days", "2D", "INTERVAL 2 DAY")):

    @query(
        f"resample_datetime_index_using_mean{_name}",
        f"WITH {CTE_EVENTS}, {_resampled(_step)} SELECT metric, timestamp, value FROM x",
        {"value": 9},
    )
    def _resample(spark, sf_dir, freq=_freq):
        return r.resample(events(spark, sf_dir), freq)


@query("source_resample_first", f"WITH {CTE_EVENTS}, {_resampled('INTERVAL 1 HOUR')} SELECT metric, timestamp, f AS value FROM x")
def _resample_first(spark, sf_dir):
    return r.resample(events(spark, sf_dir), "1h", "first")


@query(
    "resample_calendar_months",
    """WITH e AS (SELECT o_orderdate AS timestamp, o_orderpriority AS metric, o_totalprice AS value FROM orders),
    b AS (SELECT metric, date_trunc('month', timestamp) AS bin, avg(value) AS value FROM e GROUP BY ALL),
    p AS (SELECT metric, unnest(generate_series(min(bin), max(bin), INTERVAL 1 MONTH)) AS bin FROM b GROUP BY metric)
    SELECT metric, CAST(last_day(bin) AS TIMESTAMP) AS timestamp, value FROM p LEFT JOIN b USING (metric, bin)""",
    {"value": 8},
)
def _resample_months(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(
        F.col("o_orderdate").cast("timestamp").alias("timestamp"),
        F.col("o_orderpriority").alias("metric"),
        F.col("o_totalprice").alias("value"),
    )
    return r.resample(rows, "M")


USERS = Shape(("user_id",), "event_id", "value")
CTE_USERS = "u AS (SELECT user_id, event_id, value FROM events)"


@query(
    "resample_numeric_index_using_mean",
    f"""WITH {CTE_USERS}, p AS (SELECT user_id, unnest(generate_series(min(event_id), max(event_id), 5)) AS event_id, true AS grid
    FROM u GROUP BY user_id), j AS (SELECT user_id, event_id, value, grid FROM u FULL JOIN p USING (user_id, event_id)),
    m AS (SELECT *, avg(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS m FROM j)
    SELECT user_id, event_id, m AS value FROM m WHERE grid""",
    {"value": 8},
)
def _resample_numeric(spark, sf_dir):
    return r.resample_numeric(table(spark, sf_dir, "events").select("user_id", "event_id", "value"), 5, USERS)


def _filled(source: str, key: str, position: str) -> str:
    """Known neighbours of every row and the straight line between them; the last value is kept behind the end."""
    return f"""n AS (SELECT *, last_value(CASE WHEN value IS NOT NULL THEN {position} END IGNORE NULLS) OVER f AS pa,
    last_value(value IGNORE NULLS) OVER f AS va, last_value(CASE WHEN value IS NOT NULL THEN {position} END IGNORE NULLS) OVER b AS pb,
    last_value(value IGNORE NULLS) OVER b AS vb FROM {source}
    WINDOW f AS (PARTITION BY {key} ORDER BY {position} ROWS UNBOUNDED PRECEDING),
    b AS (PARTITION BY {key} ORDER BY {position} DESC ROWS UNBOUNDED PRECEDING)),
    y AS (SELECT *, coalesce(value, CASE WHEN va IS NOT NULL AND vb IS NOT NULL
    THEN va + (vb - va) * (({position} - pa) / (pb - pa)) ELSE va END) AS filled FROM n)"""


@query(
    "linear_interpolation_datetime_index",
    f"""WITH {CTE_BINS}, p AS (SELECT metric, unnest(generate_series(time_bucket(INTERVAL 30 MINUTE, min(timestamp)),
    time_bucket(INTERVAL 30 MINUTE, max(timestamp)), INTERVAL 30 MINUTE)) AS timestamp FROM l GROUP BY metric),
    x AS (SELECT metric, timestamp, value, epoch_us(timestamp)::DOUBLE AS pos FROM p LEFT JOIN l USING (metric, timestamp)),
    {_filled('x', 'metric', 'pos')} SELECT metric, timestamp, filled AS value FROM y""",
)
def _on_grid(spark, sf_dir):
    return r.interpolate_on_grid(bins(spark, sf_dir), "30min")


@query(
    "linear_interpolation_numeric_index",
    f"""WITH {CTE_USERS}, p AS (SELECT user_id, unnest(generate_series(min(event_id), max(event_id), 7)) AS event_id, true AS grid
    FROM u GROUP BY user_id), x AS (SELECT user_id, event_id, value, grid FROM u FULL JOIN p USING (user_id, event_id)),
    {_filled('x', 'user_id', 'event_id')} SELECT user_id, event_id, filled AS value FROM y WHERE grid""",
)
def _on_numeric_grid(spark, sf_dir):
    return r.interpolate_on_numeric_grid(table(spark, sf_dir, "events").select("user_id", "event_id", "value"), 7, USERS)


@query("shift_datetime_index", f"WITH {CTE_EVENTS} SELECT timestamp + INTERVAL 60 MINUTE AS timestamp, metric, value FROM e")
def _shift(spark, sf_dir):
    return r.shift_index(events(spark, sf_dir), "20min", 3)


@query(
    "shift_datetime_index_months",
    """SELECT CAST(last_day(CASE WHEN last_day(o_orderdate) = CAST(o_orderdate AS DATE) THEN o_orderdate + INTERVAL 2 MONTH
    ELSE date_trunc('month', o_orderdate) + INTERVAL 1 MONTH END) AS TIMESTAMP) AS timestamp, o_orderkey, o_totalprice AS value FROM orders""",
)
def _shift_months(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(
        F.col("o_orderdate").cast("timestamp").alias("timestamp"), "o_orderkey", F.col("o_totalprice").alias("value")
    )
    return r.shift_index(rows, "M", 2, Shape(("o_orderkey",)))


@query("add_timedelta_to_index", f"WITH {CTE_EVENTS} SELECT timestamp - INTERVAL 4 SECOND AS timestamp, metric, value FROM e")
def _timedelta(spark, sf_dir):
    return r.add_timedelta(events(spark, sf_dir), "-4s")


@query("fixed_replacement_value", f"WITH {CTE_EVENTS} SELECT metric, timestamp, 42.5 AS value FROM e")
def _fixed(spark, sf_dir):
    return r.fixed_values(events(spark, sf_dir).withColumn("value", F.col("timestamp")), 42.5)


# Gaps ------------------------------------------------------------------------------------------

LOW, HIGH = "2024-01-03T00:00:00Z", "2024-01-27T12:00:00Z"
BOUNDS = "TIMESTAMP '2024-01-03' AND TIMESTAMP '2024-01-27 12:00:00'"
ORDER = "(PARTITION BY metric ORDER BY timestamp)"
CTE_BOUNDED = f"""c AS (SELECT * FROM e WHERE timestamp BETWEEN {BOUNDS}),
    w AS (SELECT timestamp, metric, value FROM c UNION ALL
    SELECT t, metric, NULL FROM (SELECT DISTINCT metric FROM e), (SELECT unnest([TIMESTAMP '2024-01-03', TIMESTAMP '2024-01-27 12:00:00']) AS t)
    WHERE (t, metric) NOT IN (SELECT (timestamp, metric) FROM c)),
    d AS (SELECT *, lag(timestamp) OVER {ORDER} AS before, lag(value) OVER {ORDER} AS left_value,
    epoch_us(timestamp) - lag(epoch_us(timestamp)) OVER {ORDER} AS distance FROM w),
    k AS (SELECT *, row_number() OVER (PARTITION BY metric ORDER BY distance) - 1 AS rank, count(*) OVER (PARTITION BY metric) AS n
    FROM d WHERE distance IS NOT NULL),
    q AS (SELECT metric, distance AS frequency FROM k WHERE rank = CAST(round_even((n - 1) * 0.9, 0) AS BIGINT))"""


@query("constrict_series", f"WITH {CTE_EVENTS} SELECT timestamp, metric, value FROM e WHERE timestamp BETWEEN {BOUNDS}")
def _constrict(spark, sf_dir):
    return g.constrict_series(events(spark, sf_dir), LOW, HIGH)


@query("add_range_bounds", f"WITH {CTE_EVENTS}, {CTE_BOUNDED} SELECT timestamp, metric, value FROM w")
def _bounds(spark, sf_dir):
    rows = events(spark, sf_dir)
    return g.add_bounds(g.constrict_series(rows, LOW, HIGH), LOW, HIGH, keys=rows)


@query(
    "expected_frequency",
    f"""WITH {CTE_EVENTS}, r AS (SELECT unnest([date_trunc('day', min(timestamp)), date_trunc('day', max(timestamp)) + INTERVAL 1 DAY]) AS t FROM e),
    c AS (SELECT * FROM e WHERE timestamp BETWEEN (SELECT min(t) FROM r) AND (SELECT max(t) FROM r)),
    w AS (SELECT timestamp, metric FROM c UNION ALL SELECT t, metric FROM (SELECT DISTINCT metric FROM e) m, r
    WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.timestamp = t AND c.metric IS NOT DISTINCT FROM m.metric)),
    d AS (SELECT metric, epoch_us(timestamp) - lag(epoch_us(timestamp)) OVER {ORDER} AS distance FROM w),
    k AS (SELECT *, row_number() OVER (PARTITION BY metric ORDER BY distance) - 1 AS rank, count(*) OVER (PARTITION BY metric) AS n
    FROM d WHERE distance IS NOT NULL)
    SELECT metric, distance AS frequency FROM k WHERE rank = CAST(round_even((n - 1) * 0.9, 0) AS BIGINT)""",
)
def _frequency(spark, sf_dir):
    """Over all events: the processing range runs from the first day's beginning to the last day's end."""
    rows = events(spark, sf_dir)
    day, stamp = F.expr("INTERVAL 1 DAY"), "yyyy-MM-dd'T'HH:mm:ss'Z'"
    ends = (F.date_trunc("day", F.min("timestamp")), F.date_trunc("day", F.max("timestamp")) + day)
    low, high = rows.agg(*[F.date_format(end, stamp).alias(f"end{i}") for i, end in enumerate(ends)]).first()
    bounded = g.add_bounds(g.constrict_series(rows, low, high), low, high, keys=rows)
    return g.expected_frequency(bounded, 0.9, 11)


@query(
    "normalised_distances",
    f"""WITH {CTE_EVENTS}, d AS (SELECT metric, lag(timestamp) OVER {ORDER} AS start_time, timestamp AS end_time FROM e)
    SELECT *, (epoch_us(end_time) - epoch_us(start_time)) / 3.6e9 AS normalised FROM d WHERE start_time IS NOT NULL""",
    {"normalised": 11},
)
def _normalised(spark, sf_dir):
    return g.normalised_distances(events(spark, sf_dir), HOUR)


@query(
    "wide_gaps",
    f"""WITH {CTE_EVENTS}, d AS (SELECT metric, lag(timestamp) OVER {ORDER} AS start_time, timestamp AS end_time FROM e)
    SELECT *, false AS start_inclusive, false AS end_inclusive FROM d
    WHERE epoch_us(end_time) - epoch_us(start_time) > 1.5 * 3600000000""",
)
def _wide(spark, sf_dir):
    return g.wide_gaps(events(spark, sf_dir), HOUR, 1.5)


@query(
    "rhythm_floor_and_ceil",
    f"""WITH {CTE_EVENTS}, m AS (SELECT *, (epoch_us(timestamp) - 120000000) % 420000000 AS past FROM e)
    SELECT timestamp, metric, make_timestamp(epoch_us(timestamp) - past) AS floor,
    make_timestamp(epoch_us(timestamp) + CASE WHEN past = 0 THEN 0 ELSE 420000000 - past END) AS ceil FROM m""",
)
def _rhythm(spark, sf_dir):
    rows = events(spark, sf_dir)
    at, step, offset = tick(rows, "timestamp"), F.lit(420_000_000), F.lit(120_000_000)
    return rows.select(
        "timestamp", "metric",
        from_micros(g.rhythm_floor(at, step, offset)).alias("floor"), from_micros(g.rhythm_ceil(at, step, offset)).alias("ceil"),
    )


@query(
    "missing_rhythm_points",
    f"""WITH {CTE_BINS}, p AS (SELECT metric, unnest(generate_series(min(timestamp), max(timestamp), INTERVAL 10 MINUTE)) AS t
    FROM l GROUP BY metric) SELECT metric, t AS start_time, t AS end_time, true AS start_inclusive, true AS end_inclusive
    FROM p ANTI JOIN l ON p.metric = l.metric AND p.t = l.timestamp""",
)
def _missing(spark, sf_dir):
    return g.missing_rhythm_points(bins(spark, sf_dir), 600_000_000)


@query(
    "points_to_intervals",
    f"""WITH {CTE_EVENTS} SELECT metric, timestamp AS start_time, timestamp AS end_time, true AS start_inclusive,
    true AS end_inclusive FROM e""",
)
def _points(spark, sf_dir):
    return g.points_to_intervals(events(spark, sf_dir))


CTE_INTERVALS = """i AS (SELECT o_orderpriority AS metric, o_orderdate + to_hours(o_custkey % 24) AS start_time,
    o_orderdate + to_hours(o_custkey % 24 + o_orderkey % 7) AS end_time, o_orderkey % 2 = 0 OR o_orderkey % 7 = 0 AS start_inclusive,
    o_orderkey % 3 = 0 OR o_orderkey % 7 = 0 AS end_inclusive FROM orders)"""


def _order_intervals(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").withColumn("day", F.unix_micros(F.col("o_orderdate").cast("timestamp")))
    start = F.col("day") + F.col("o_custkey") % 24 * HOUR
    point = F.col("o_orderkey") % 7 == 0
    return rows.select(
        F.col("o_orderpriority").alias("metric"),
        from_micros(start).alias("start_time"),
        from_micros(start + F.col("o_orderkey") % 7 * HOUR).alias("end_time"),
        ((F.col("o_orderkey") % 2 == 0) | point).alias("start_inclusive"),
        ((F.col("o_orderkey") % 3 == 0) | point).alias("end_inclusive"),
    )


RANGE = "TIMESTAMP '1996-01-01 05:00:00'", "TIMESTAMP '1999-07-01 11:00:00'"


@query(
    "constrict_intervals",
    f"""WITH {CTE_INTERVALS} SELECT metric, greatest(start_time, {RANGE[0]}) AS start_time, least(end_time, {RANGE[1]}) AS end_time,
    start_inclusive OR start_time < {RANGE[0]} AS start_inclusive, end_inclusive OR end_time > {RANGE[1]} AS end_inclusive
    FROM i WHERE (end_time > {RANGE[0]} OR (end_time = {RANGE[0]} AND end_inclusive))
    AND (start_time < {RANGE[1]} OR (start_time = {RANGE[1]} AND start_inclusive))""",
)
def _clip(spark, sf_dir):
    return g.constrict_intervals(_order_intervals(spark, sf_dir), "1996-01-01T05:00:00Z", "1999-07-01T11:00:00Z")


@query(
    "merge_intervals",
    f"""WITH {CTE_INTERVALS}, c AS (SELECT metric, epoch_us(start_time) * 2 + CASE WHEN start_inclusive THEN 0 ELSE 1 END AS a,
    epoch_us(end_time) * 2 + CASE WHEN end_inclusive THEN 1 ELSE 0 END AS b FROM i),
    m AS (SELECT *, max(b) OVER (PARTITION BY metric ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM c),
    n AS (SELECT *, sum(CASE WHEN reach IS NULL OR a > reach THEN 1 ELSE 0 END) OVER (PARTITION BY metric ORDER BY a, b
    ROWS UNBOUNDED PRECEDING) AS island FROM m),
    s AS (SELECT metric, min(a) AS a, max(b) AS b FROM n GROUP BY metric, island)
    SELECT metric, make_timestamp(a // 2) AS start_time, make_timestamp(b // 2) AS end_time, a % 2 = 0 AS start_inclusive,
    b % 2 = 1 AS end_inclusive FROM s""",
)
def _merge(spark, sf_dir):
    return g.merge_intervals(_order_intervals(spark, sf_dir))


CTE_MORNINGS = """v AS (SELECT metric, day + INTERVAL 6 HOUR AS start_time, day + INTERVAL 9 HOUR AS end_time,
    true AS start_inclusive, false AS end_inclusive FROM (SELECT DISTINCT metric, date_trunc('day', timestamp) AS day FROM l))"""


@query(
    "boundary_values",
    f"""WITH {CTE_BINS}, {CTE_MORNINGS}, a AS (SELECT v.*, l.value AS value_to_left FROM v ASOF LEFT JOIN l
    ON v.metric = l.metric AND v.start_time > l.timestamp)
    SELECT a.*, l.value AS value_to_right FROM a ASOF LEFT JOIN l ON a.metric = l.metric AND a.end_time <= l.timestamp""",
)
def _boundary(spark, sf_dir):
    rows = bins(spark, sf_dir)
    days = rows.select("metric", F.date_trunc("day", "timestamp").alias("day")).distinct()
    mornings = days.select(
        "metric",
        (F.col("day") + F.expr("INTERVAL 6 HOURS")).alias("start_time"),
        (F.col("day") + F.expr("INTERVAL 9 HOURS")).alias("end_time"),
        F.lit(True).alias("start_inclusive"),
        F.lit(False).alias("end_inclusive"),
    )
    return g.boundary_values(rows, mornings)


INFO = """metric, start_time, end_time, start_inclusive, end_inclusive, (epoch_us(end_time) - epoch_us(start_time)) / 1e6 AS
    gap_size_in_seconds, value_to_left, value_to_right, (value_to_left + value_to_right) / 2 AS mean_left_right"""


@query(
    "gap_detection_intervals",
    f"""WITH {CTE_EVENTS}, {CTE_BOUNDED}, z AS (SELECT metric, before AS start_time, timestamp AS end_time, false AS start_inclusive,
    false AS end_inclusive, left_value AS value_to_left, value AS value_to_right FROM d JOIN q USING (metric)
    WHERE distance / frequency > 1.2) SELECT {INFO} FROM z""",
    {"gap_size_in_seconds": 6, "mean_left_right": 6},
)
def _detect(spark, sf_dir):
    return g.detect_gaps(events(spark, sf_dir), LOW, HIGH, percentile=0.9, factor=1.2)[0]


@query(
    "gap_info",
    f"""WITH {CTE_BINS}, p AS (SELECT metric, unnest(generate_series(min(timestamp), max(timestamp), INTERVAL 10 MINUTE)) AS t
    FROM l GROUP BY metric), i AS (SELECT metric, t AS start_time, t AS end_time, true AS start_inclusive, true AS end_inclusive
    FROM p ANTI JOIN l ON p.metric = l.metric AND p.t = l.timestamp),
    a AS (SELECT i.*, l.value AS value_to_left FROM i ASOF LEFT JOIN l ON i.metric = l.metric AND i.start_time > l.timestamp),
    z AS (SELECT a.*, l.value AS value_to_right FROM a ASOF LEFT JOIN l ON a.metric = l.metric AND a.end_time < l.timestamp)
    SELECT {INFO} FROM z""",
    {"mean_left_right": 6},
)
def _info(spark, sf_dir):
    rows = bins(spark, sf_dir)
    return g.gap_info(rows, g.missing_rhythm_points(rows, 600_000_000))


@query(
    "gap_detection_with_offset",
    f"""WITH {CTE_BINS}, d AS (SELECT metric, lag(timestamp) OVER {ORDER} AS start_time, timestamp AS end_time, value AS value_to_right,
    lag(value) OVER {ORDER} AS value_to_left, false AS start_inclusive, false AS end_inclusive FROM l)
    SELECT {INFO} FROM d WHERE start_time + INTERVAL 10 MINUTE < end_time""",
    {"mean_left_right": 6},
)
def _detect_offset(spark, sf_dir):
    return g.detect_gaps(bins(spark, sf_dir), auto_frequency=False, frequency="10min", offset="0s")[0]


@query(
    "default_rhythm_offset",
    f"WITH {CTE_EVENTS} SELECT metric, epoch_us(min(timestamp)) % 420000000 AS \"offset\" FROM e GROUP BY metric",
)
def _offset(spark, sf_dir):
    return g.default_offset(events(spark, sf_dir), 420_000_000)


CTE_OWN = f"""d AS (SELECT metric, lag(timestamp) OVER {ORDER} AS s, timestamp AS t FROM e),
    w AS (SELECT * FROM d WHERE t - s > INTERVAL 30 MINUTE)"""


@query(
    "rhythm_points_in_intervals",
    f"""WITH {CTE_EVENTS}, {CTE_OWN}, p AS (SELECT *, unnest(generate_series(s, t, INTERVAL 7 MINUTE)) AS timestamp FROM w)
    SELECT metric, timestamp FROM p WHERE timestamp > s AND timestamp < t""",
)
def _own_rhythm(spark, sf_dir):
    gaps = g.wide_gaps(events(spark, sf_dir), HOUR // 2)
    return g.rhythm_points(gaps, 420_000_000, None)


@query(
    "replacement_locations_for_gaps",
    f"""WITH {CTE_EVENTS}, o AS (SELECT metric, min(epoch_us(timestamp)) % 420000000 AS o FROM e GROUP BY metric), {CTE_OWN},
    p AS (SELECT metric, s, t, unnest(generate_series(s - to_microseconds((epoch_us(s) - o) % 420000000), t, INTERVAL 7 MINUTE)) AS timestamp
    FROM w JOIN o USING (metric))
    SELECT metric, timestamp, CAST(NULL AS DOUBLE) AS value FROM p WHERE timestamp > s AND timestamp < t""",
)
def _locations(spark, sf_dir):
    rows = events(spark, sf_dir)
    return g.replacement_locations(g.wide_gaps(rows, HOUR // 2), rows, frequency="7min")
