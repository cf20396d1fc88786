"""Joins, alignment and reshaping."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewell.catalog.base import CTE_BINS, CTE_EVENTS, bins, both, events, query, table
from tidewell.operators import joins as j
from tidewell.operators import reshape as r

for _how, _join in {"inner": "JOIN", "left": "LEFT JOIN", "right": "RIGHT JOIN", "outer": "FULL JOIN"}.items():
    _key = {"inner": "c.nationkey", "left": "c.nationkey", "right": "n.nationkey"}.get(_how, "coalesce(c.nationkey, n.nationkey)")

    @query(
        f"merge_dataframes_on_single_column_{_how}",
        f"""WITH c AS (SELECT nullif(c_nationkey, 3) AS nationkey, c_name AS name, c_acctbal FROM customer),
        n AS (SELECT nullif(n_nationkey, 3) AS nationkey, n_name AS name FROM nation)
        SELECT {_key} AS nationkey, c.name AS name_x, c_acctbal, n.name AS name_y
        FROM c {_join} n ON c.nationkey IS NOT DISTINCT FROM n.nationkey""",
    )
    def _merge(spark, sf_dir, how=_how):
        left = table(spark, sf_dir, "customer").select(
            F.nullif("c_nationkey", F.lit(3)).alias("nationkey"), F.col("c_name").alias("name"), "c_acctbal"
        )
        right = table(spark, sf_dir, "nation").select(
            F.nullif("n_nationkey", F.lit(3)).alias("nationkey"), F.col("n_name").alias("name")
        )
        return j.merge_on_column(left, right, "nationkey", how)


@query(
    "combine_into_dataframe",
    f"""WITH {CTE_BINS} SELECT metric, timestamp, l.value, r.value AS "value_1" FROM l LEFT JOIN r USING (timestamp, metric)""",
)
def _combine(spark, sf_dir):
    left, right = both(spark, sf_dir)
    return j.combine_into_frame(left, right, "value")


@query(
    "combine_as_named_column_into_dataframe",
    f"WITH {CTE_BINS} SELECT metric, timestamp, l.value, r.value AS previous FROM l LEFT JOIN r USING (timestamp, metric)",
)
def _combine_named(spark, sf_dir):
    left, right = both(spark, sf_dir)
    return j.combine_as_named(left.withColumn("previous", F.lit(0)), right, "previous")


@query(
    "combine_two_series_into_dataframe",
    f"""WITH {CTE_BINS} SELECT metric, timestamp, l.value, r.value AS a, s.value AS "0" FROM l
    LEFT JOIN r USING (timestamp, metric)
    LEFT JOIN (SELECT timestamp + INTERVAL 10 MINUTE AS timestamp, metric, value FROM r) s USING (timestamp, metric)""",
)
def _combine_two(spark, sf_dir):
    left, right = both(spark, sf_dir)
    later = right.withColumn("timestamp", F.col("timestamp") + F.expr("INTERVAL 10 MINUTES"))
    return j.combine_two(left, right, later, ("a", None))


@query(
    "restrict_to_common_index",
    f"""WITH {CTE_BINS} SELECT 1 AS side, timestamp, metric, value FROM l SEMI JOIN r USING (timestamp, metric)
    UNION ALL SELECT 2, timestamp, metric, value FROM r SEMI JOIN l USING (timestamp, metric)""",
)
def _common(spark, sf_dir):
    a, b = j.restrict_to_common_index(*both(spark, sf_dir))
    return a.withColumn("side", F.lit(1)).unionByName(b.withColumn("side", F.lit(2)))


@query(
    "apply_substitution_timeseries",
    f"""WITH {CTE_BINS}, s AS (SELECT timestamp, metric, CASE WHEN value >= 25 THEN value END AS sub FROM r)
    SELECT timestamp, metric, CASE WHEN s.timestamp IS NOT NULL THEN sub ELSE l.value END AS value
    FROM l FULL JOIN s USING (timestamp, metric)
    WHERE sub IS NOT NULL OR s.timestamp IS NULL OR l.timestamp IS NULL""",
)
def _substitute(spark, sf_dir):
    raw, sub = both(spark, sf_dir)
    return j.apply_substitution(raw, sub.withColumn("value", F.when(F.col("value") >= 25, F.col("value"))))


@query(
    "time_to_length_constant_speed",
    f"""WITH {CTE_EVENTS} SELECT metric, timestamp, value,
    (epoch_us(timestamp) - min(epoch_us(timestamp)) OVER (PARTITION BY metric)) / 1e6 * 2.5 AS length FROM e""",
    {"length": 8},
)
def _length(spark, sf_dir):
    return j.time_to_length(events(spark, sf_dir), 2.5)


@query(
    "time_to_length",
    f"""WITH {CTE_BINS}, s AS (SELECT *, coalesce((epoch_us(timestamp) - lag(epoch_us(timestamp)) OVER w) / 1e6
    * (value + lag(value) OVER w) / 2, 0) AS area FROM r WINDOW w AS (PARTITION BY metric ORDER BY timestamp)),
    c AS (SELECT timestamp, metric, sum(area) OVER (PARTITION BY metric ORDER BY timestamp
    ROWS UNBOUNDED PRECEDING) AS length FROM s)
    SELECT metric, timestamp, length, value FROM l JOIN c USING (timestamp, metric)""",
    {"length": 2},
)
def _length_series(spark, sf_dir):
    return j.time_to_length(*both(spark, sf_dir))


@query(
    "add_timeseries_to_multitsframe",
    f"WITH {CTE_EVENTS} SELECT * FROM e UNION ALL SELECT o_orderdate, 'orders', o_totalprice FROM orders",
)
def _append(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(
        F.col("o_orderdate").cast("timestamp").alias("timestamp"), F.col("o_totalprice").alias("value")
    )
    return r.append_series(events(spark, sf_dir), orders, "orders")


@query(
    "timeseries_dataframe",
    """SELECT o_orderdate AS timestamp, 'metric_0' AS metric, o_totalprice AS value FROM orders
    UNION ALL SELECT ts, 'metric_1', value FROM events""",
)
def _timeseries_frame(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(
        F.col("o_orderdate").cast("timestamp").alias("timestamp"), F.col("o_totalprice").alias("value")
    )
    return r.timeseries_frame(orders, events(spark, sf_dir).select("timestamp", "value"))


@query(
    "convert_dataframe_to_multitsframe",
    """SELECT l_shipdate AS timestamp, unnest(['l_quantity', 'l_discount', 'l_tax']) AS metric,
    unnest([l_quantity, CASE WHEN l_discount > 0.02 THEN l_discount END, l_tax]) AS value FROM lineitem""",
)
def _wide_to_long(spark, sf_dir):
    wide = table(spark, sf_dir, "lineitem").select(
        F.col("l_shipdate").cast("timestamp").alias("timestamp"),
        "l_quantity",
        F.when(F.col("l_discount") > 0.02, F.col("l_discount")).alias("l_discount"),
        "l_tax",
    )
    return r.wide_to_long(wide)


@query(
    "convert_multitsframe_to_dataframe",
    f"WITH {CTE_BINS} SELECT timestamp, "
    + ", ".join(f"max(value) FILTER (metric = '{m}') AS {m}" for m in ("click", "error", "purchase", "signup", "view"))
    + " FROM l GROUP BY timestamp",
)
def _long_to_wide(spark, sf_dir):
    return r.long_to_wide(bins(spark, sf_dir))


@query(
    "grid_2d",
    """WITH b AS (SELECT CAST(floor(sqrt(count(*))) AS BIGINT) AS n, min(l_quantity) AS x0, max(l_quantity) AS x1,
    min(l_tax) AS y0, max(l_tax) AS y1 FROM lineitem)
    SELECT p AS position, x0 + (p % n) / (n - 1) * (x1 - x0) AS x, y0 + (p // n) / (n - 1) * (y1 - y0) AS y
    FROM (SELECT *, unnest(range(n * n)) AS p FROM b)""",
    {"x": 8, "y": 8},
)
def _grid(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    b = lines.agg(F.count("*"), F.min("l_quantity"), F.max("l_quantity"), F.min("l_tax"), F.max("l_tax")).first()
    return r.grid_2d(spark, b[1], b[2], b[3], b[4], int(b[0] ** 0.5))
