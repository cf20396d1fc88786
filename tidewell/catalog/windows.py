"""Rolling, running and neighbouring-row operators, and the flagship alert query."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewell.catalog.base import CTE_BINS, CTE_EVENTS, both, events, query, table
from tidewell.frames import Shape
from tidewell.operators import health as h
from tidewell.operators import recursive as rec
from tidewell.operators import windows as w
from tidewell.operators.filters import drop_missing
from tidewell.sources.series import read_multits

# Names of the statistics and their SQL.
MOVING = {
    "average": ("mean", "avg"),
    "maximum": ("max", "max"),
    "minimum": ("min", "min"),
    "median": ("median", "median"),
    "standard_deviation": ("std", "stddev_samp"),
}
# The frame is open on the left, so it reaches back one microsecond less than its width.
THREE_HOURS = "RANGE BETWEEN 10799999999 PRECEDING AND CURRENT ROW"
ORDER = "(PARTITION BY metric ORDER BY timestamp)"

for _name, (_kind, _sql) in MOVING.items():

    @query(
        f"moving_{_name}_number",
        f"""WITH {CTE_EVENTS} SELECT timestamp, metric, CASE WHEN count(value) OVER f = 12 THEN {_sql}(value) OVER f END AS value
        FROM e WINDOW f AS (PARTITION BY metric ORDER BY timestamp ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)""",
        {"value": 9},
    )
    def _number(spark, sf_dir, kind=_kind):
        return w.moving_number(events(spark, sf_dir), kind, 12)

    @query(
        f"moving_{_name}_time",
        f"""WITH {CTE_EVENTS} SELECT timestamp, metric, {_sql}(value) OVER (PARTITION BY metric
        ORDER BY epoch_us(timestamp) {THREE_HOURS}) AS value FROM e""",
        {"value": 9},
    )
    def _time(spark, sf_dir, kind=_kind):
        return w.moving_time(events(spark, sf_dir), kind, "180min")


@query(
    "mavg_smoothing",
    f"""WITH {CTE_EVENTS} SELECT timestamp, metric, avg(CASE WHEN value < 90 THEN value END) OVER (PARTITION BY metric
    ORDER BY epoch_us(timestamp) {THREE_HOURS}) AS value FROM e""",
    {"value": 8},
)
def _smooth(spark, sf_dir):
    rows = events(spark, sf_dir).withColumn("value", F.when(F.col("value") < 90, F.col("value")))
    return w.smooth(rows, "3h")


@query(
    "mavg_outlier_filter",
    f"""WITH {CTE_EVENTS}, s AS (SELECT *, avg(value) OVER f AS m, stddev_samp(value) OVER f AS d FROM e
    WINDOW f AS (PARTITION BY metric ORDER BY epoch_us(timestamp) {THREE_HOURS}))
    SELECT timestamp, metric, value FROM s WHERE value > m - 1.7 * d AND value < m + 1.7 * d""",
)
def _outliers(spark, sf_dir):
    return w.filter_outliers(events(spark, sf_dir), 1.7, "180min")


@query(
    "cumulative_sum",
    f"""WITH {CTE_EVENTS} SELECT timestamp, metric, CASE WHEN value < 90 THEN sum(CASE WHEN value < 90 THEN value END)
    OVER (PARTITION BY metric ORDER BY timestamp ROWS UNBOUNDED PRECEDING) END AS value FROM e""",
    {"value": 4},
)
def _cumulative(spark, sf_dir):
    return w.cumulative_sum(events(spark, sf_dir).withColumn("value", F.when(F.col("value") < 90, F.col("value"))))


@query(
    "consecutive_differences",
    f"""WITH {CTE_EVENTS}, d AS (SELECT timestamp, metric, value - lag(value) OVER {ORDER} AS value FROM e)
    SELECT * FROM d WHERE value IS NOT NULL""",
    {"value": 6},
)
def _differences(spark, sf_dir):
    return w.consecutive_differences(events(spark, sf_dir))


QUOTIENT = f"(value - lag(value) OVER {ORDER}) / ((epoch_us(timestamp) - lag(epoch_us(timestamp)) OVER {ORDER}) / 1e6)"


@query(
    "derivate",
    f"WITH {CTE_EVENTS}, d AS (SELECT timestamp, metric, {QUOTIENT} AS value FROM e) SELECT * FROM d WHERE value IS NOT NULL",
    {"value": 8},
)
def _derivative(spark, sf_dir):
    return w.derivative(events(spark, sf_dir))


@query(
    "series_difference_quotients",
    """WITH d AS (SELECT event_id, ts AS timestamp, event_type AS metric, (value - lag(value) OVER o)
    / ((epoch_us(ts) - lag(epoch_us(ts)) OVER o) / 1e6) AS value FROM events
    WINDOW o AS (PARTITION BY event_type ORDER BY event_id DESC)) SELECT * FROM d WHERE value IS NOT NULL""",
    {"value": 8},
)
def _quotients(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(
        "event_id", F.col("ts").cast("timestamp").alias("timestamp"), F.col("event_type").alias("metric"), "value"
    )
    backwards = rows.withColumn("_place", -F.col("event_id"))
    shape = Shape(tie=("_place",))
    return w.difference_quotients(backwards, shape, ("_place",)).drop("_place")


@query("shift_values", f"WITH {CTE_EVENTS} SELECT timestamp, metric, lag(value, 4) OVER {ORDER} AS value FROM e")
def _shift(spark, sf_dir):
    return w.shift_values(events(spark, sf_dir), 4)


@query("shift_values_back", f"WITH {CTE_EVENTS} SELECT timestamp, metric, lead(value, 3) OVER {ORDER} AS value FROM e")
def _shift_back(spark, sf_dir):
    return w.shift_values(events(spark, sf_dir), -3)


@query(
    "time_gaps",
    f"""WITH {CTE_EVENTS}, d AS (SELECT metric, timestamp, (epoch_us(timestamp) - lag(epoch_us(timestamp)) OVER {ORDER})
    / 1e6 AS gap FROM e) SELECT * FROM d WHERE gap IS NOT NULL""",
    {"gap": 8},
)
def _gaps(spark, sf_dir):
    return w.time_gaps(events(spark, sf_dir))


for _name, _edge, _test in (
    ("both", 0.0, "state <> before"),
    ("rising", 1.0, "state > before"),
    ("falling", -1.0, "state < before"),
):

    @query(
        f"count_level_crossings_{_name}",
        f"""WITH {CTE_EVENTS}, s AS (SELECT *, CASE WHEN value > 45 THEN 1 WHEN value < 35 THEN -1 END AS state FROM e),
        b AS (SELECT *, last_value(state IGNORE NULLS) OVER (PARTITION BY metric ORDER BY timestamp
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM s)
        SELECT metric, timestamp, CAST(sum(CASE WHEN {_test} THEN 1 ELSE 0 END) OVER (PARTITION BY metric ORDER BY timestamp
        ROWS UNBOUNDED PRECEDING) AS BIGINT) AS crossings FROM b""",
    )
    def _crossings(spark, sf_dir, edge=_edge):
        return w.count_level_crossings(events(spark, sf_dir), 40.0, 10.0, edge)


@query(
    "interpolate_timeseries",
    f"""WITH {CTE_BINS}, u AS (SELECT timestamp, metric, l.value AS raw, coalesce(r.value > 40, false) AS flag
    FROM l FULL JOIN r USING (timestamp, metric)),
    b AS (SELECT *, CASE WHEN NOT flag THEN raw END AS v, epoch_us(timestamp)::DOUBLE AS p FROM u),
    n AS (SELECT *, last_value(CASE WHEN v IS NOT NULL THEN p END IGNORE NULLS) OVER f AS pa,
    last_value(v IGNORE NULLS) OVER f AS va, last_value(CASE WHEN v IS NOT NULL THEN p END IGNORE NULLS) OVER g AS pb,
    last_value(v IGNORE NULLS) OVER g AS vb FROM b
    WINDOW f AS (PARTITION BY metric ORDER BY timestamp ROWS UNBOUNDED PRECEDING),
    g AS (PARTITION BY metric ORDER BY timestamp DESC ROWS UNBOUNDED PRECEDING))
    SELECT metric, timestamp, coalesce(v, CASE WHEN va IS NOT NULL AND vb IS NOT NULL
    THEN va + (vb - va) * ((p - pa) / (pb - pa)) ELSE coalesce(va, vb) END) AS value FROM n""",
)
def _interpolate(spark, sf_dir):
    raw, other = both(spark, sf_dir)
    flags = other.withColumn("value", F.col("value") > 40)
    return w.interpolate(raw, flags, limit_direction="both")["interpolated"]


# The flagged points of the query above alone, and at most one of them from each known point on.
FILLED = f"""{CTE_BINS}, u AS (SELECT timestamp, metric, l.value AS raw, coalesce(r.value > 40, false) AS flag
    FROM l FULL JOIN r USING (timestamp, metric)),
    b AS (SELECT *, CASE WHEN NOT flag THEN raw END AS v, epoch_us(timestamp)::DOUBLE AS p,
    row_number() OVER (PARTITION BY metric ORDER BY timestamp) AS i FROM u),
    n AS (SELECT *, last_value(CASE WHEN v IS NOT NULL THEN p END IGNORE NULLS) OVER f AS pa,
    last_value(CASE WHEN v IS NOT NULL THEN i END IGNORE NULLS) OVER f AS ia, last_value(v IGNORE NULLS) OVER f AS va,
    last_value(CASE WHEN v IS NOT NULL THEN p END IGNORE NULLS) OVER g AS pb, last_value(v IGNORE NULLS) OVER g AS vb FROM b
    WINDOW f AS (PARTITION BY metric ORDER BY timestamp ROWS UNBOUNDED PRECEDING),
    g AS (PARTITION BY metric ORDER BY timestamp DESC ROWS UNBOUNDED PRECEDING))"""


@query(
    "interpolate_timeseries_new_values",
    f"""WITH {FILLED} SELECT metric, timestamp, CASE WHEN va IS NOT NULL AND vb IS NOT NULL
    THEN va + (vb - va) * ((p - pa) / (pb - pa)) ELSE coalesce(va, vb) END AS value FROM n WHERE flag""",
)
def _interpolate_new(spark, sf_dir):
    raw, other = both(spark, sf_dir)
    flags = other.withColumn("value", F.col("value") > 40)
    return w.interpolate(raw, flags, limit_direction="both")["new_values"]


@query(
    "interpolate_timeseries_limit",
    f"""WITH {FILLED} SELECT metric, timestamp, coalesce(v, CASE WHEN va IS NOT NULL AND vb IS NOT NULL AND i - ia <= 1
    THEN va + (vb - va) * ((p - pa) / (pb - pa)) END) AS value FROM n""",
)
def _interpolate_limit(spark, sf_dir):
    raw, other = both(spark, sf_dir)
    flags = other.withColumn("value", F.col("value") > 40)
    return w.interpolate(raw, flags, limit=1, limit_area="inside")["interpolated"]


# Slopes at the known points of the queries above, and the cubic between two of them.
STEPS = f"""{FILLED},
    s1 AS (SELECT metric, p, v, p - lag(p) OVER o AS ha, lead(p) OVER o - p AS hb, (v - lag(v) OVER o) / (p - lag(p) OVER o) AS ma,
    (lead(v) OVER o - v) / (lead(p) OVER o - p) AS mb, row_number() OVER o AS i, count(*) OVER (PARTITION BY metric) AS c
    FROM n WHERE v IS NOT NULL WINDOW o AS (PARTITION BY metric ORDER BY p)),
    s2 AS (SELECT *, lag(ha) OVER o AS ha2, lag(ma) OVER o AS ma2, lead(hb) OVER o AS hb2, lead(mb) OVER o AS mb2 FROM s1
    WINDOW o AS (PARTITION BY metric ORDER BY p))"""
BETWEEN = """SELECT n.metric, n.timestamp, coalesce(n.v, CASE WHEN pa IS NOT NULL AND pb IS NOT NULL THEN
    va + (n.p - pa) * (x.s + (n.p - pa) * ((3 * x.mb - 2 * x.s - y.s) / x.hb + (n.p - pa) * (x.s + y.s - 2 * x.mb) / (x.hb * x.hb))) END)
    AS value FROM n LEFT JOIN slopes x ON x.metric = n.metric AND x.p = pa LEFT JOIN slopes y ON y.metric = n.metric AND y.p = pb"""
_END = """CASE WHEN sign(((2 * {0} + {1}) * {2} - {0} * {3}) / ({0} + {1})) <> sign({2}) THEN 0
    WHEN sign({2}) <> sign({3}) AND abs(((2 * {0} + {1}) * {2} - {0} * {3}) / ({0} + {1})) > 3 * abs({2}) THEN 3 * {2}
    ELSE ((2 * {0} + {1}) * {2} - {0} * {3}) / ({0} + {1}) END"""


def _curve(spark, sf_dir, method: str):
    raw, other = both(spark, sf_dir)
    flags = other.withColumn("value", F.col("value") > 40)
    return w.interpolate(raw, flags, method, "both", limit_area="inside")["interpolated"]


@query(
    "interpolate_timeseries_pchip",
    f"""WITH {STEPS}, slopes AS (SELECT *, CASE WHEN ma IS NULL THEN coalesce({_END.format("hb", "hb2", "mb", "mb2")}, mb)
    WHEN mb IS NULL THEN coalesce({_END.format("ha", "ha2", "ma", "ma2")}, ma)
    WHEN ma * mb > 0 THEN 3 * (ha + hb) / ((2 * hb + ha) / ma + (hb + 2 * ha) / mb) ELSE 0 END AS s FROM s2) {BETWEEN}""",
    {"value": 9},
)
def _pchip(spark, sf_dir):
    return _curve(spark, sf_dir, "pchip")


@query(
    "interpolate_timeseries_akima",
    f"""WITH {STEPS}, e1 AS (SELECT *, CASE WHEN ma IS NULL THEN 2 * mb - mb2 ELSE ma END AS l1,
    CASE WHEN mb IS NULL THEN 2 * ma - ma2 ELSE mb END AS r1 FROM s2),
    e2 AS (SELECT *, coalesce(ma2, 2 * l1 - r1) AS l2, coalesce(mb2, 2 * r1 - l1) AS r2 FROM e1),
    e3 AS (SELECT *, abs(l1 - l2) AS f, abs(r2 - r1) AS g, max(abs(l1 - l2) + abs(r2 - r1)) OVER (PARTITION BY metric) AS top FROM e2),
    slopes AS (SELECT *, CASE WHEN f + g > 1e-9 * top THEN (g * l1 + f * r1) / (f + g) ELSE (l2 + r2) / 2 END AS s FROM e3) {BETWEEN}""",
    {"value": 6},
)
def _akima(spark, sf_dir):
    return _curve(spark, sf_dir, "akima")


@query(
    "interpolate_timeseries_cubic",
    f"""WITH RECURSIVE {STEPS}, q AS (SELECT *, CASE WHEN i IN (1, c) OR i = 2 THEN 0 WHEN i = c - 1 THEN ha - hb * hb / ha ELSE ha END AS low,
    CASE WHEN i IN (1, c) OR i = c - 1 THEN 0 WHEN i = 2 THEN hb - ha * ha / hb ELSE hb END AS up,
    CASE WHEN i IN (1, c) THEN 1 ELSE 2 * (ha + hb) + CASE WHEN i = 2 THEN ha * (ha + hb) / hb ELSE 0 END
    + CASE WHEN i = c - 1 THEN hb * (ha + hb) / ha ELSE 0 END END AS mid,
    CASE WHEN i IN (1, c) THEN 0 ELSE 6 * (mb - ma) END AS rhs FROM s2),
    fw AS (SELECT metric, i, up / mid AS cc, rhs / mid AS dd FROM q WHERE i = 1
    UNION ALL SELECT q.metric, q.i, q.up / (q.mid - q.low * fw.cc), (q.rhs - q.low * fw.dd) / (q.mid - q.low * fw.cc)
    FROM fw JOIN q ON q.metric = fw.metric AND q.i = fw.i + 1),
    bw AS (SELECT metric, i, dd AS x FROM fw JOIN (SELECT metric, max(i) AS i FROM q GROUP BY 1) USING (metric, i)
    UNION ALL SELECT fw.metric, fw.i, fw.dd - fw.cc * bw.x FROM bw JOIN fw ON fw.metric = bw.metric AND fw.i = bw.i - 1),
    m1 AS (SELECT q.*, x, lag(x) OVER o AS xa, lag(x, 2) OVER o AS xa2, lead(x) OVER o AS xb, lead(x, 2) OVER o AS xb2
    FROM q JOIN bw USING (metric, i) WINDOW o AS (PARTITION BY metric ORDER BY i)),
    m2 AS (SELECT *, CASE WHEN i = 1 THEN ((hb + hb2) * xb - hb * xb2) / hb2 WHEN i = c THEN ((ha + ha2) * xa - ha * xa2) / ha2 ELSE x END AS w FROM m1),
    m3 AS (SELECT *, lag(w) OVER o AS wa, lead(w) OVER o AS wb FROM m2 WINDOW o AS (PARTITION BY metric ORDER BY i)),
    slopes AS (SELECT *, coalesce(mb - hb * (2 * w + wb) / 6, ma + ha * (2 * w + wa) / 6) AS s FROM m3) {BETWEEN}""",
    {"value": 5},
)
def _cubic(spark, sf_dir):
    return _curve(spark, sf_dir, "cubic")


@query(
    "timeshifted_value_table",
    f"""WITH {CTE_BINS} SELECT metric, a.timestamp + INTERVAL 10 MINUTE AS timestamp, a.value AS "shifted_1_times_10min",
    b.value AS "shifted_2_times_10min", c.value AS "shifted_3_times_10min" FROM l a
    LEFT JOIN (SELECT timestamp + INTERVAL 10 MINUTE AS timestamp, metric, value FROM l) b USING (timestamp, metric)
    LEFT JOIN (SELECT timestamp + INTERVAL 20 MINUTE AS timestamp, metric, value FROM l) c USING (timestamp, metric)""",
)
def _shifted_table(spark, sf_dir):
    return w.timeshifted_table(both(spark, sf_dir)[0], "10min", 3)


@query(
    "merge_timeseries_deduplicating_timestamps",
    """WITH g AS (SELECT o_orderdate AS t, count(*) AS m, lead(o_orderdate) OVER (ORDER BY o_orderdate) AS nxt
    FROM orders GROUP BY o_orderdate),
    k AS (SELECT *, row_number() OVER (PARTITION BY o_orderdate ORDER BY o_orderkey) - 1 AS k FROM orders)
    SELECT make_timestamp(CAST(epoch_us(t) + floor(k * least(coalesce(epoch_us(nxt) - epoch_us(t), 172800000000), 172800000000) / m) AS BIGINT))
    AS timestamp, o_orderkey, o_totalprice AS value FROM k JOIN g ON o_orderdate = t""",
)
def _merge(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(
        F.col("o_orderdate").cast("timestamp").alias("timestamp"),
        F.col("o_orderpriority").alias("metric"),
        "o_orderkey",
        F.col("o_totalprice").alias("value"),
    )
    return w.merge_distributing_duplicates(rows, "2 days", Shape(tie=("o_orderkey",)))


@query("sort_by_index", f"WITH {CTE_EVENTS} SELECT timestamp, metric, value FROM e ORDER BY metric, timestamp")
def _sort(spark, sf_dir):
    return w.sort_by_index(events(spark, sf_dir))


def _recursion(gain: str, sign: str) -> str:
    """First-order recursion in SQL, one step per row of a series."""
    return f"""WITH RECURSIVE {CTE_EVENTS}, c AS (SELECT metric, tan(pi() / 2 * 0.00001 / (0.5 * count(*)
    / ((epoch_us(max(timestamp)) - epoch_us(min(timestamp))) / 1e6))) AS k FROM e GROUP BY metric),
    n AS (SELECT metric, timestamp, value, lag(value, 1, 0) OVER {ORDER} AS before, row_number() OVER {ORDER} AS i FROM e),
    d AS (SELECT metric, i, timestamp, {gain} / (1 + k) * (value {sign} before) AS x, (1 - k) / (1 + k) AS decay
    FROM n JOIN c USING (metric)),
    y AS (SELECT metric, i, timestamp, x AS value FROM d WHERE i = 1
    UNION ALL SELECT d.metric, d.i, d.timestamp, d.x + d.decay * y.value FROM y JOIN d ON d.metric = y.metric AND d.i = y.i + 1)
    SELECT metric, timestamp, value FROM y"""


@query("lowpass_filter", _recursion("k", "+"), {"value": 7})
def _lowpass(spark, sf_dir):
    return rec.lowpass(events(spark, sf_dir), 0.00001)


@query("highpass_filter", _recursion("1", "-"), {"value": 7})
def _highpass(spark, sf_dir):
    return rec.highpass(events(spark, sf_dir), 0.00001)


@query(
    "lowpass_filter_missing_input",
    """WITH RECURSIVE e AS (SELECT event_id, ts AS timestamp, CASE WHEN event_id % 9000 <> 17 THEN value END AS value FROM events),
    c AS (SELECT tan(pi() / 2 * 0.00001 / (0.5 * count(*) / ((epoch_us(max(timestamp)) - epoch_us(min(timestamp))) / 1e6))) AS k FROM e),
    n AS (SELECT *, lag(value, 1, 0) OVER (ORDER BY timestamp, event_id) AS before,
    row_number() OVER (ORDER BY timestamp, event_id) AS i FROM e),
    d AS (SELECT i, event_id, timestamp, k / (1 + k) * (value + before) AS x, (1 - k) / (1 + k) AS decay FROM n, c),
    y AS (SELECT i, event_id, timestamp, x AS value FROM d WHERE i = 1
    UNION ALL SELECT d.i, d.event_id, d.timestamp, d.x + d.decay * y.value FROM y JOIN d ON d.i = y.i + 1)
    SELECT event_id, timestamp, value FROM y""",
    {"value": 7},
)
def _lowpass_missing(spark, sf_dir):
    """All events as one series, in which single values are missing: all after the first of them is missing."""
    value = F.when(F.col("event_id") % 9000 != 17, F.col("value"))
    rows = table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("timestamp"), value.alias("value"))
    return rec.lowpass(rows, 0.00001, Shape((), tie=("event_id",)))


@query(
    "moving_median_time_wide",
    f"""WITH {CTE_EVENTS} SELECT timestamp, metric, median(value) OVER (PARTITION BY metric
    ORDER BY epoch_us(timestamp) RANGE BETWEEN {20 * 86_400_000_000 - 1} PRECEDING AND CURRENT ROW) AS value FROM e""",
    {"value": 9},
)
def _median_wide(spark, sf_dir):
    return w.moving_time(events(spark, sf_dir), "median", "20d")


@query(
    "moving_standard_deviation_number_wide",
    f"""WITH {CTE_EVENTS} SELECT timestamp, metric, CASE WHEN count(value) OVER f = 700 THEN stddev_samp(value) OVER f END AS value
    FROM e WINDOW f AS (PARTITION BY metric ORDER BY timestamp ROWS BETWEEN 699 PRECEDING AND CURRENT ROW)""",
    {"value": 8},
)
def _deviation_wide(spark, sf_dir):
    return w.moving_number(events(spark, sf_dir), "std", 700)


ALERT_SQL = f"""f AS (SELECT *, CASE WHEN score > 45 THEN 1 ELSE 0 END AS above FROM s)
    SELECT metric, timestamp, coalesce(above - lag(above) OVER {ORDER}, 0) AS alert FROM f"""


@query("alerts_from_score", f"WITH {CTE_EVENTS}, s AS (SELECT *, value AS score FROM e), {ALERT_SQL}")
def _alerts(spark, sf_dir):
    return h.alerts_from_score(events(spark, sf_dir), 45)


@query(
    "volatility_alert",
    f"""WITH {CTE_EVENTS}, s AS (SELECT metric, timestamp, stddev_samp(value) OVER (PARTITION BY metric
    ORDER BY epoch_us(timestamp) {THREE_HOURS}) AS score FROM e
    WHERE timestamp BETWEEN TIMESTAMP '2024-01-02' AND TIMESTAMP '2024-01-28' AND metric IN ('click', 'purchase', 'view')),
    g AS (SELECT * FROM s WHERE score IS NOT NULL),
    f AS (SELECT *, CASE WHEN score > 45 THEN 1 ELSE 0 END AS above FROM g),
    a AS (SELECT metric, timestamp, coalesce(above - lag(above) OVER {ORDER}, 0) AS alert FROM f)
    SELECT * FROM a WHERE alert <> 0""",
)
def _volatility(spark, sf_dir):
    mapping = {"timestamp": "ts", "metric": "event_type"}
    chosen = read_multits(
        table(spark, sf_dir, "events"), "2024-01-02T00:00:00Z", "2024-01-28T00:00:00Z", "click,purchase,view", mapping
    )
    spread = drop_missing(w.moving_time(chosen, "std", "180min"))
    return h.alerts_from_score(spread, 45).where(F.col("alert") != 0)


@query(
    "univariate_linear_rul_regression",
    f"""WITH {CTE_EVENTS}, b AS (SELECT *, (epoch_us(timestamp) - min(epoch_us(timestamp)) OVER (PARTITION BY metric)) / 1e6 AS x,
    min(timestamp) OVER (PARTITION BY metric) AS first FROM e),
    f AS (SELECT metric, any_value(first) AS first, regr_intercept(value, x) AS intercept, regr_slope(value, x) AS slope
    FROM b GROUP BY metric)
    SELECT metric, intercept, slope, (200 - intercept) / slope / 86400 AS days FROM f""",
    {"intercept": 6, "slope": 12, "days": 4},
)
def _life(spark, sf_dir):
    rows = events(spark, sf_dir)
    fit = h.remaining_life(rows, 200.0)["fit"]
    first = rows.groupBy("metric").agg(F.min("timestamp").alias("first"))
    days = (F.unix_micros("violation") - F.unix_micros("first")) / F.lit(86400e6)
    return fit.join(first, "metric").select("metric", "intercept", "slope", days.alias("days"))


@query(
    "univariate_linear_rul_predictions",
    f"""WITH {CTE_EVENTS}, b AS (SELECT *, (epoch_us(timestamp) - min(epoch_us(timestamp)) OVER (PARTITION BY metric)) / 1e6 AS x
    FROM e), f AS (SELECT metric, min(timestamp) AS low, max(timestamp) + INTERVAL 3 DAY AS high,
    regr_intercept(value, x) AS intercept, regr_slope(value, x) AS slope FROM b GROUP BY metric),
    g AS (SELECT *, unnest(generate_series(low, high, INTERVAL 5 MINUTE)) AS timestamp FROM f)
    SELECT metric, timestamp, intercept + slope * (epoch_us(timestamp) - epoch_us(low)) / 1e6 AS value FROM g""",
    {"value": 6},
)
def _life_line(spark, sf_dir):
    return h.remaining_life(events(spark, sf_dir), 200.0)["predictions"]
