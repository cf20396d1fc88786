"""Projections, comparisons, filters and checks."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewell.catalog.base import CTE_BINS, CTE_EVENTS, both, events, query, table
from tidewell.frames import Shape, parse_any, validate_multits
from tidewell.operators import columns as c
from tidewell.operators import filters as f

LINES = Shape(("l_orderkey",), "l_linenumber", "l_extendedprice")


@query("multits_validation", f"WITH {CTE_EVENTS} SELECT timestamp, metric, value FROM e")
def _validate(spark, sf_dir):
    return validate_multits(events(spark, sf_dir))


@query("any_parse", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def _any(spark, sf_dir):
    parsed = table(spark, sf_dir, "events").withColumn("v", parse_any(F.col("props")))
    return parsed.select("event_id", F.try_variant_get("v", "$.k", "bigint").alias("k"))


@query("select_column_from_dataframe", "SELECT l_orderkey, l_linenumber, l_discount AS l_extendedprice FROM lineitem")
def _select(spark, sf_dir):
    return c.select_column(table(spark, sf_dir, "lineitem"), "l_discount", LINES)


@query("name_series", "SELECT ts AS timestamp, 'load' AS metric, value FROM events")
def _name(spark, sf_dir):
    return c.name_series(events(spark, sf_dir), "load")


@query("convert_series_to_dataframe", f"WITH {CTE_EVENTS} SELECT metric, timestamp, value AS load FROM e")
def _to_frame(spark, sf_dir):
    return c.series_to_frame(events(spark, sf_dir), "load")


@query("dataframe_to_series", "SELECT l_orderkey, l_linenumber, l_tax AS l_extendedprice FROM lineitem")
def _to_series(spark, sf_dir):
    return c.frame_to_series(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_tax"), LINES)


@query("pass_through_boolean", "SELECT doc_id, CAST(quality AS BOOLEAN) AS quality FROM labels")
def _boolean(spark, sf_dir):
    return c.pass_typed(table(spark, sf_dir, "labels").select("doc_id", "quality"), "quality", "boolean")


@query("pass_through_integer", "SELECT l_orderkey, CAST(l_quantity AS BIGINT) AS l_quantity FROM lineitem")
def _integer(spark, sf_dir):
    return c.pass_typed(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_quantity"), "l_quantity", "int")


@query("pass_through_float", "SELECT p_partkey, CAST(p_size AS DOUBLE) AS p_size FROM part")
def _float(spark, sf_dir):
    return c.pass_typed(table(spark, sf_dir, "part").select("p_partkey", "p_size"), "p_size", "float")


@query("pass_through_string", "SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, o_totalprice FROM orders")
def _string(spark, sf_dir):
    return c.pass_typed(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey", "string")


@query("pass_through_series", f"WITH {CTE_EVENTS} SELECT metric, timestamp, value FROM e")
def _series(spark, sf_dir):
    return c.pass_series(events(spark, sf_dir))


@query("pass_through_dataframe", "SELECT CAST(o_custkey AS DOUBLE) AS o_custkey, o_orderkey FROM orders")
def _frame(spark, sf_dir):
    schema = T.StructType([T.StructField("o_custkey", T.DoubleType()), T.StructField("o_orderkey", T.LongType())])
    return c.pass_frame(table(spark, sf_dir, "orders"), schema)


@query("pass_through_multitsframe", f"WITH {CTE_EVENTS} SELECT timestamp, metric, value FROM e")
def _multits(spark, sf_dir):
    return c.pass_multits(events(spark, sf_dir))


# Comparison operators in SQL, and the result where a side is missing.
COMPARISON_SQL = {
    "equality": ("=", "false"),
    "inequality": ("<>", "true"),
    "greater": (">", "false"),
    "greater_or_equal": (">=", "false"),
    "smaller": ("<", "false"),
    "smaller_or_equal": ("<=", "false"),
}

for _key, (_op, _missing) in COMPARISON_SQL.items():

    @query(
        _key,
        f"WITH {CTE_BINS} SELECT timestamp, metric, coalesce(l.value {_op} r.value, {_missing}) AS result "
        "FROM l FULL JOIN r USING (timestamp, metric)",
    )
    def _aligned(spark, sf_dir, key=_key):
        return f.compare(*both(spark, sf_dir), key)

    @query(f"{_key}_scalar", f"WITH {CTE_EVENTS} SELECT metric, timestamp, value {_op} 12.31 AS result FROM e")
    def _scalar(spark, sf_dir, key=_key):
        return f.compare(events(spark, sf_dir), 12.31, key)


@query(
    "filter",
    f"WITH {CTE_EVENTS} SELECT timestamp, metric, value FROM e WHERE value < 100 AND (value > 50 OR value > 10)",
)
def _filter(spark, sf_dir):
    rows = events(spark, sf_dir).withColumn("reading", F.col("value"))
    value = F.col("value")
    mask = rows.where(value < 100).withColumn("value", F.when(value <= 50, (value > 10).cast("double")))
    # Two events of a metric may share a timestamp; the mask's rows are told apart by the reading they come from.
    return f.filter_by(rows, mask, Shape(tie=("reading",))).drop("reading")


@query(
    "restrict_to_time_interval",
    f"WITH {CTE_EVENTS} SELECT timestamp, metric, value FROM e "
    "WHERE timestamp BETWEEN TIMESTAMP '2024-01-05 06:00:00' AND TIMESTAMP '2024-01-20 18:30:00'",
)
def _restrict(spark, sf_dir):
    return f.restrict_to_time_interval(events(spark, sf_dir), "2024-01-05T06:00:00Z", "2024-01-20T19:30:00+01:00")


@query("cut_values_above_limit", f"WITH {CTE_EVENTS} SELECT timestamp, metric, value FROM e WHERE value <= 60")
def _above(spark, sf_dir):
    return f.cut_above(events(spark, sf_dir), 60.0)


@query(
    "cut_values_above_limit_frame",
    "SELECT l_orderkey, l_linenumber, CASE WHEN l_extendedprice <= 30 THEN l_extendedprice END AS l_extendedprice, "
    "CASE WHEN l_quantity <= 30 THEN l_quantity END AS l_quantity FROM lineitem",
)
def _above_frame(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity")
    return f.cut_above(rows, 30.0, LINES, frame=True)


@query("cut_values_below_limit", f"WITH {CTE_EVENTS} SELECT timestamp, metric, value FROM e WHERE value >= 60")
def _below(spark, sf_dir):
    return f.cut_below(events(spark, sf_dir), 60.0)


@query(
    "cut_values_below_limit_frame",
    "SELECT l_orderkey, l_linenumber, CASE WHEN l_discount >= 0.05 THEN l_discount END AS l_discount, "
    "CASE WHEN l_tax >= 0.05 THEN l_tax END AS l_tax FROM lineitem",
)
def _below_frame(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_discount", "l_tax")
    return f.cut_below(rows, 0.05, LINES, frame=True)


@query(
    "drop_nan_values",
    "SELECT l_orderkey, l_linenumber, l_discount, l_tax FROM lineitem WHERE l_discount >= 0.05 AND l_tax >= 0.05",
)
def _drop_missing(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_discount", "l_tax")
    return f.drop_missing(f.cut_below(rows, 0.05, LINES, frame=True), LINES)


@query(
    "drop_duplicates",
    f"WITH {CTE_EVENTS} SELECT min(timestamp) AS timestamp, metric, value FROM e GROUP BY metric, value",
)
def _drop_duplicates(spark, sf_dir):
    return f.drop_duplicates(events(spark, sf_dir))


@query(
    "eval_expression_on_dataframe",
    "SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) > 30000 AND l_tax < 0.04 AS result FROM lineitem",
)
def _eval_frame(spark, sf_dir):
    expression = "l_extendedprice * (1 - l_discount) > 30000 and l_tax < 0.04"
    return f.eval_on_frame(table(spark, sf_dir, "lineitem"), expression, LINES)


@query(
    "eval_expression_python_syntax",
    """SELECT l_orderkey, l_linenumber, (l_quantity > 10 AND l_quantity <= 30) OR (l_tax = 0.02 AND NOT l_discount > 0.05)
    OR l_returnflag IN ('R', 'N') AND sqrt(l_extendedprice) ** 2 % 7 < 1.5 AS result FROM lineitem""",
)
def _eval_python(spark, sf_dir):
    expression = (
        "10 < l_quantity <= 30 | (`l_tax` == 0.02 & not l_discount > 0.05)"
        " | l_returnflag in ['R', 'N'] & sqrt(l_extendedprice) ** 2 % 7 < 1.5"
    )
    return f.eval_on_frame(table(spark, sf_dir, "lineitem"), expression, LINES)


@query("eval_expression_on_series", f"WITH {CTE_EVENTS} SELECT metric, timestamp, value * value - 3 * value AS result FROM e", {"result": 5})
def _eval_series(spark, sf_dir):
    return f.eval_on_series(events(spark, sf_dir), "x * x - 3 * x")


FEW = [
    {"start": "2024-01-02T00:00:00Z", "end": "2024-01-04T12:00:00Z", "correction_value": 1.5},
    {"start": "2024-01-04T00:00:00Z", "end": "2024-01-09T00:00:00Z", "start_inclusive": False, "correction_value": -2},
    {"start": "2024-01-20T08:00:00Z", "end": "2024-01-20T20:00:00Z", "end_inclusive": False, "correction_value": 7},
]


def _many() -> list[dict]:
    """Intervals of growing length, one starting every half day, more than fit into literals."""
    start = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
    items = []
    for i in range(60):
        low = start + dt.timedelta(hours=12 * i)
        items.append({"start": low.isoformat(), "end": (low + dt.timedelta(hours=(i % 7) * 3 + 1)).isoformat(), "correction_value": i})
    return items


MANY_SQL = (
    "i AS (SELECT n AS pos, TIMESTAMP '2024-01-01' + to_hours(12 * n) AS s, "
    "TIMESTAMP '2024-01-01' + to_hours(12 * n + (n % 7) * 3 + 1) AS t FROM (SELECT unnest(range(60)) AS n))"
)


@query(
    "select_time_intervals",
    f"""WITH {CTE_EVENTS} SELECT metric, timestamp,
    timestamp BETWEEN TIMESTAMP '2024-01-02' AND TIMESTAMP '2024-01-04 12:00:00'
    OR (timestamp > TIMESTAMP '2024-01-04' AND timestamp <= TIMESTAMP '2024-01-09')
    OR (timestamp >= TIMESTAMP '2024-01-20 08:00:00' AND timestamp < TIMESTAMP '2024-01-20 20:00:00') AS result FROM e""",
)
def _intervals(spark, sf_dir):
    return f.select_time_intervals(events(spark, sf_dir), FEW)


@query(
    "select_time_intervals_many",
    f"""WITH {CTE_EVENTS}, {MANY_SQL} SELECT metric, timestamp,
    EXISTS (SELECT 1 FROM i WHERE e.timestamp BETWEEN i.s AND i.t) AS result FROM e""",
)
def _intervals_many(spark, sf_dir):
    return f.select_time_intervals(events(spark, sf_dir), _many())


@query(
    "correct_time_intervals_nested",
    f"""WITH {CTE_EVENTS}, i AS (SELECT pos, epoch_us(TIMESTAMP '2024-01-01') + pos * 60000000 AS s,
    epoch_us(TIMESTAMP '2024-02-01') - pos * 60000000 AS t FROM range(20000) r(pos)),
    h AS (SELECT timestamp, max(pos) AS pos FROM (SELECT DISTINCT timestamp FROM e) JOIN i ON epoch_us(timestamp) BETWEEN s AND t GROUP BY 1)
    SELECT timestamp, metric, coalesce(CAST(pos AS DOUBLE), value) AS value FROM e LEFT JOIN h USING (timestamp)""",
)
def _correct_nested(spark, sf_dir):
    """Twenty thousand intervals, each inside the one before."""
    start, end = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc), dt.datetime(2024, 2, 1, tzinfo=dt.timezone.utc)
    step = dt.timedelta(minutes=1)
    nested = [{"start": start + k * step, "end": end - k * step, "correction_value": k} for k in range(20_000)]
    return f.correct_time_intervals(events(spark, sf_dir), [{**i, "start": i["start"].isoformat(), "end": i["end"].isoformat()} for i in nested])


@query(
    "correct_time_intervals_with_fixed_values",
    f"""WITH {CTE_EVENTS} SELECT timestamp, metric, CASE
    WHEN timestamp >= TIMESTAMP '2024-01-20 08:00:00' AND timestamp < TIMESTAMP '2024-01-20 20:00:00' THEN 7.0
    WHEN timestamp > TIMESTAMP '2024-01-04' AND timestamp <= TIMESTAMP '2024-01-09' THEN -2.0
    WHEN timestamp BETWEEN TIMESTAMP '2024-01-02' AND TIMESTAMP '2024-01-04 12:00:00' THEN 1.5
    ELSE value END AS value FROM e""",
)
def _correct(spark, sf_dir):
    return f.correct_time_intervals(events(spark, sf_dir), FEW)


@query(
    "correct_time_intervals_many",
    f"""WITH {CTE_EVENTS}, {MANY_SQL}, h AS (SELECT timestamp, max(pos) AS pos FROM e JOIN i ON timestamp BETWEEN s AND t
    GROUP BY timestamp) SELECT timestamp, metric, coalesce(CAST(pos AS DOUBLE), value) AS value
    FROM e LEFT JOIN h USING (timestamp)""",
)
def _correct_many(spark, sf_dir):
    return f.correct_time_intervals(events(spark, sf_dir), _many())


@query(
    "reduce_data_set_by_leaving_out_values",
    f"""WITH {CTE_EVENTS}, n AS (SELECT *, row_number() OVER (PARTITION BY metric ORDER BY timestamp) - 1 AS rn,
    count(*) OVER (PARTITION BY metric) AS c FROM e)
    SELECT timestamp, metric, value FROM n
    WHERE rn % CASE WHEN c >= 150 THEN greatest(CAST(round_even((c - 1) / 149, 0) AS BIGINT), 1) ELSE 1 END = 0""",
)
def _thin(spark, sf_dir):
    return f.thin_out(events(spark, sf_dir), 150)


@query(
    "value_range_check",
    f"""WITH {CTE_EVENTS} SELECT metric, timestamp, value < 10 AS "low_IS_BELOW", value > 40 AS "low_IS_ABOVE",
    value BETWEEN 10 AND 40 AS low, value <= 40 AS "high_IS_BELOW", value >= 90 AS "high_IS_ABOVE",
    value > 40 AND value < 90 AS high, NOT (value BETWEEN 10 AND 40) AND NOT (value > 40 AND value < 90) AS "_violates_all",
    NOT (value BETWEEN 10 AND 40) OR NOT (value > 40 AND value < 90) AS "_violates_any", timestamp AS "_timestamp" FROM e""",
)
def _ranges(spark, sf_dir):
    def span(low: float, high: float, closed: bool) -> dict:
        return {"min_value": low, "max_value": high, "min_value_inclusive": closed, "max_value_inclusive": closed}

    return f.value_range_check(events(spark, sf_dir), {"low": span(10.0, 40.0, True), "high": span(40.0, 90.0, False)})
