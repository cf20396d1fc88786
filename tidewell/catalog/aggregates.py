"""Aggregations, regression and scaling."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewell.catalog.base import CTE_BINS, CTE_EVENTS, both, events, query, table
from tidewell.frames import Shape
from tidewell.operators import aggregates as a

LINES = Shape(("l_returnflag",), "l_shipdate", "l_extendedprice")
MEASURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]

for _key, (_function, _sql) in {
    "average": (a.average, "avg"),
    "maximum": (a.maximum, "max"),
    "minimum": (a.minimum, "min"),
    "median": (a.median, "median"),
    "standard_deviation": (a.standard_deviation, "stddev_samp"),
}.items():

    @query(_key, f"WITH {CTE_EVENTS} SELECT metric, {_sql}(value) AS value FROM e GROUP BY metric", {"value": 7})
    def _single(spark, sf_dir, function=_function):
        return function(events(spark, sf_dir))

    @query(
        f"{_key}_frame",
        f"SELECT l_returnflag, {', '.join(f'{_sql}({m}) AS {m}' for m in MEASURES)} FROM lineitem GROUP BY 1",
        dict.fromkeys(MEASURES, 5),
    )
    def _frame(spark, sf_dir, function=_function):
        return function(table(spark, sf_dir, "lineitem"), LINES, MEASURES)


@query("sum_up_series", f"WITH {CTE_EVENTS} SELECT metric, sum(value) AS value FROM e GROUP BY metric", {"value": 4})
def _sum(spark, sf_dir):
    return a.sum_up(events(spark, sf_dir))


@query(
    "sum_columns",
    """SELECT l_orderkey, l_linenumber, coalesce(l_quantity, 0) + coalesce(CASE WHEN l_extendedprice <= 40000
    THEN l_extendedprice END, 0) + l_tax AS total FROM lineitem""",
    {"total": 4},
)
def _sum_columns(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").withColumn(
        "l_extendedprice", F.when(F.col("l_extendedprice") <= 40000, F.col("l_extendedprice"))
    )
    shape = Shape(("l_orderkey",), "l_linenumber", "l_extendedprice")
    return a.sum_columns(rows, "total", shape, ["l_quantity", "l_extendedprice", "l_tax"])


@query(
    "integrate",
    f"""WITH {CTE_EVENTS} SELECT metric, sum(area) AS integral FROM (SELECT metric,
    (epoch_us(timestamp) - lag(epoch_us(timestamp)) OVER w) / 1e6 * (value + lag(value) OVER w) / 2 AS area
    FROM e WINDOW w AS (PARTITION BY metric ORDER BY timestamp)) GROUP BY metric""",
    {"integral": 1},
)
def _integrate(spark, sf_dir):
    return a.integrate(events(spark, sf_dir))


@query(
    "first_datetime_index",
    f"WITH {CTE_EVENTS} SELECT metric, strftime(min(timestamp), '%Y-%m-%dT%H:%M:%S.%fZ') AS first_index FROM e GROUP BY 1",
)
def _first(spark, sf_dir):
    return a.first_datetime(events(spark, sf_dir))


@query(
    "last_datetime_index",
    f"WITH {CTE_EVENTS} SELECT metric, strftime(max(timestamp), '%Y-%m-%dT%H:%M:%S.%fZ') AS last_index FROM e GROUP BY 1",
)
def _last(spark, sf_dir):
    return a.last_datetime(events(spark, sf_dir))


@query(
    "linear_regression_two_series",
    f"""WITH {CTE_BINS}, p AS (SELECT timestamp, metric, l.value AS x, r.value AS y FROM l JOIN r USING (timestamp, metric)),
    f AS (SELECT metric, regr_intercept(y, x) AS intercept, regr_slope(y, x) AS slope FROM p GROUP BY metric)
    SELECT metric, timestamp, intercept + slope * x AS preds, intercept + slope * x - y AS diffs FROM p JOIN f USING (metric)""",
    {"preds": 6, "diffs": 6},
)
def _regression_two(spark, sf_dir):
    return a.regression_of_two(*both(spark, sf_dir))["scored"]


@query(
    "linear_regression",
    """WITH m AS (SELECT avg(l_quantity) AS q, avg(l_tax) AS t, avg(l_extendedprice) AS p, avg(l_discount) AS d,
    var_pop(l_quantity) AS qq, var_pop(l_tax) AS tt, covar_pop(l_quantity, l_tax) AS qt,
    covar_pop(l_extendedprice, l_quantity) AS pq, covar_pop(l_extendedprice, l_tax) AS pt,
    covar_pop(l_discount, l_quantity) AS dq, covar_pop(l_discount, l_tax) AS dt FROM lineitem),
    c AS (SELECT *, (pq * tt - pt * qt) / (qq * tt - qt * qt) AS b1, (pt * qq - pq * qt) / (qq * tt - qt * qt) AS b2,
    (dq * tt - dt * qt) / (qq * tt - qt * qt) AS d1, (dt * qq - dq * qt) / (qq * tt - qt * qt) AS d2 FROM m)
    SELECT 'l_extendedprice' AS target, unnest(['intercept', 'l_quantity', 'l_tax']) AS term,
    unnest([p - b1 * q - b2 * t, b1, b2]) AS coefficient FROM c
    UNION ALL SELECT 'l_discount', unnest(['intercept', 'l_quantity', 'l_tax']), unnest([d - d1 * q - d2 * t, d1, d2]) FROM c""",
    {"coefficient": 5},
)
def _regression(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    return a.linear_regression(lines, ["l_quantity", "l_tax"], ["l_extendedprice", "l_discount"])["coefficients"]


@query(
    "standard_scale",
    f"""WITH {CTE_EVENTS} SELECT timestamp, metric, (value - avg(value) OVER w) / stddev_pop(value) OVER w AS value
    FROM e WINDOW w AS (PARTITION BY metric)""",
    {"value": 7},
)
def _scale(spark, sf_dir):
    return a.standard_scale(events(spark, sf_dir))


@query(
    "timeseries_summary",
    f"""WITH {CTE_EVENTS}, g AS (SELECT *, (epoch_us(timestamp) - lag(epoch_us(timestamp)) OVER (PARTITION BY metric
    ORDER BY timestamp)) / 1e6 AS gap FROM e)
    SELECT metric, count(*) AS length, count(value) AS value_count, avg(value) AS value_mean,
    stddev_samp(value) AS value_std, min(value) AS value_min, max(value) AS value_max, count(gap) AS distance_count,
    avg(gap) AS distance_mean, stddev_samp(gap) AS distance_std, min(gap) AS distance_min, max(gap) AS distance_max,
    min(timestamp) AS first_index, max(timestamp) AS last_index, arg_min(value, timestamp) AS first_value,
    arg_max(value, timestamp) AS last_value, count(*) - count(DISTINCT value) AS duplicate_values,
    count(*) - count(DISTINCT timestamp) AS duplicate_index,
    (epoch_us(max(timestamp)) - epoch_us(min(timestamp))) / 1e6 AS duration,
    {', '.join(f'quantile_cont(value, {p}) AS value_p{i}, quantile_cont(gap, {p}) AS distance_p{i}'
    for i, p in enumerate(a.SUMMARY_PERCENTILES))} FROM g GROUP BY metric""",
    {c: 6 for c in ("value_mean", "value_std", "distance_mean", "distance_std", "duration")}
    | {f"{k}_p{i}": 6 for k in ("value", "distance") for i in range(7)},
)
def _summary(spark, sf_dir):
    found = a.summary(events(spark, sf_dir))
    parts = [
        F.col(f"{k}_percentiles")[i].alias(f"{k}_p{i}") for k in ("value", "distance") for i in range(7)
    ]
    return found.select("*", *parts).drop("value_percentiles", "distance_percentiles")
