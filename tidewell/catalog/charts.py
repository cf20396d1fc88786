"""Chart-ready tables, metadata, map values and scoring."""

from __future__ import annotations

import json

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from tidewell.catalog.base import CTE_BINS, CTE_EVENTS, both, events, query, table
from tidewell.operators import attributes as at
from tidewell.operators import charts as c
from tidewell.operators import health as h
from tidewell.operators import scoring as s

MEASURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query(
    "correlation_matrix",
    " UNION ALL ".join(f"SELECT '{a}' AS x, '{b}' AS y, corr({a}, {b}) AS corr FROM lineitem" for a in MEASURES for b in MEASURES),
    {"corr": 9},
)
def _correlation(spark, sf_dir):
    return c.correlation_matrix(table(spark, sf_dir, "lineitem"), MEASURES)


@query(
    "correlation_matrix_wide",
    """WITH v AS (SELECT o_orderkey AS k, i, CASE WHEN (o_custkey + i) % 11 <> 0 THEN (o_totalprice * (i + 1)) % 101 END AS v
    FROM orders, range(30) r(i))
    SELECT 'c' || a.i AS x, 'c' || b.i AS y, corr(a.v, b.v) AS corr FROM v a JOIN v b USING (k)
    WHERE a.v IS NOT NULL AND b.v IS NOT NULL GROUP BY ALL""",
    {"corr": 8},
)
def _correlation_wide(spark, sf_dir):
    """Thirty columns with gaps of their own."""
    orders = table(spark, sf_dir, "orders")
    columns = {
        f"c{i}": F.when((F.col("o_custkey") + i) % 11 != 0, (F.col("o_totalprice") * (i + 1)) % 101) for i in range(30)
    }
    return c.correlation_matrix(orders.select(*[value.alias(name) for name, value in columns.items()]), list(columns))


@query(
    "correlation_matrix_pairwise",
    "WITH p AS (SELECT l_quantity AS a, CASE WHEN l_discount > 0.02 THEN l_discount END AS b, CASE WHEN l_tax < 0.06 THEN l_tax END AS c FROM lineitem) "
    + " UNION ALL ".join(f"SELECT '{x}' AS x, '{y}' AS y, corr({x}, {y}) AS corr FROM p" for x in "abc" for y in "abc"),
    {"corr": 9},
)
def _correlation_pairs(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(
        F.col("l_quantity").alias("a"),
        F.when(F.col("l_discount") > 0.02, F.col("l_discount")).alias("b"),
        F.when(F.col("l_tax") < 0.06, F.col("l_tax")).alias("c"),
    )
    return c.correlation_matrix(rows, ["a", "b", "c"])


@query(
    "pie_chart_shares",
    """SELECT o_orderpriority, sum(o_totalprice) AS total, sum(o_totalprice) / sum(sum(o_totalprice)) OVER () AS share
    FROM orders GROUP BY o_orderpriority""",
    {"total": 2, "share": 9},
)
def _pie(spark, sf_dir):
    return c.shares(table(spark, sf_dir, "orders"), "o_totalprice", "o_orderpriority")


@query(
    "scatter_colored_by_index",
    f"WITH {CTE_BINS} SELECT metric, timestamp, l.value AS x, r.value AS y FROM l JOIN r USING (metric, timestamp)",
)
def _scatter(spark, sf_dir):
    return c.scatter_by_index(*both(spark, sf_dir))


OVERLAY = f"""WITH {CTE_BINS}, s AS (SELECT 'series_1' AS series, metric, timestamp, value FROM l
    UNION ALL SELECT 'series_2', metric, timestamp, value FROM r)"""


@query("compare_two_timeseries", f"{OVERLAY} SELECT * FROM s ORDER BY series, metric, timestamp")
def _compare(spark, sf_dir):
    return c.overlay(*both(spark, sf_dir))


@query(
    "two_timeseries_with_two_y_axes",
    f"{OVERLAY}, a AS (SELECT series, min(value) AS low, max(value) AS high FROM s GROUP BY series) SELECT * FROM s JOIN a USING (series)",
)
def _axes(spark, sf_dir):
    parts = c.overlay_with_axes(*both(spark, sf_dir))
    return parts["rows"].join(F.broadcast(parts["axes"]), "series")


@query(
    "timeseries_panels",
    f"""WITH {CTE_EVENTS} SELECT metric, min(timestamp) AS first, max(timestamp) AS last, min(value) AS low, max(value) AS high
    FROM e GROUP BY metric""",
)
def _panels(spark, sf_dir):
    return c.panels(events(spark, sf_dir))["bounds"]


@query("timeseries_panel_rows", f"WITH {CTE_EVENTS} SELECT timestamp, metric, value FROM e ORDER BY metric, timestamp")
def _panel_rows(spark, sf_dir):
    return c.panels(events(spark, sf_dir))["rows"]


@query(
    "timeseries_substitution_classes",
    f"""WITH {CTE_BINS}, p AS (SELECT timestamp, metric, l.value AS raw, CASE WHEN r.value >= 25 THEN r.value END AS sub,
    l.timestamp IS NOT NULL AS hr, r.timestamp IS NOT NULL AS hs FROM l FULL JOIN r USING (timestamp, metric))
    SELECT timestamp, metric, 'handled' AS class, CASE WHEN hs THEN sub ELSE raw END AS value FROM p WHERE sub IS NOT NULL OR NOT hs OR NOT hr
    UNION ALL SELECT timestamp, metric, 'replaced', raw FROM p WHERE hr AND hs AND sub IS NOT NULL
    UNION ALL SELECT timestamp, metric, 'replacement', sub FROM p WHERE hr AND hs AND sub IS NOT NULL
    UNION ALL SELECT timestamp, metric, 'new', sub FROM p WHERE NOT hr
    UNION ALL SELECT timestamp, metric, 'ignored', raw FROM p WHERE hr AND hs AND sub IS NULL""",
)
def _classes(spark, sf_dir):
    raw, sub = both(spark, sf_dir)
    return c.substitution_classes(raw, sub.withColumn("value", F.when(F.col("value") >= 25, F.col("value"))))


@query(
    "plot_time_series_and_value_intervals",
    f"""WITH {CTE_EVENTS}, b AS (SELECT unnest([0, 1]) AS position, unnest(['low', 'high']) AS name, unnest(['Low', 'high']) AS label,
    unnest([0.0::DOUBLE, 90.0]) AS low, unnest([10.0::DOUBLE, 400.0]) AS high, unnest(['rgb(40, 251, 0)', 'red']) AS line_color,
    unnest(['rgba(40, 251, 0, 0.15)', 'red']) AS fill_color),
    s AS (SELECT metric, min(timestamp) AS x0, max(timestamp) AS x1 FROM e GROUP BY metric)
    SELECT s.*, b.*, make_timestamp(epoch_us(x0) + ((position + 1) * (epoch_us(x1) - epoch_us(x0))) // 24) AS label_x FROM s, b""",
)
def _boxes(spark, sf_dir):
    intervals = {
        "low": {"min_value": 0.0, "max_value": 10.0, "display_name": "Low"},
        "high": {"min_value": 90.0, "max_value": 400.0, "fill_color": "red"},
    }
    return c.value_interval_boxes(events(spark, sf_dir), intervals)


@query(
    "rul_regression_result_table",
    f"""WITH {CTE_EVENTS}, b AS (SELECT *, (epoch_us(timestamp) - min(epoch_us(timestamp)) OVER (PARTITION BY metric)) / 1e6 AS x
    FROM e), f AS (SELECT metric, min(timestamp) AS low, max(timestamp) + INTERVAL 3 DAY AS high,
    regr_intercept(value, x) AS intercept, regr_slope(value, x) AS slope FROM b GROUP BY metric),
    g AS (SELECT *, unnest(generate_series(low, high, INTERVAL 1 HOUR)) AS timestamp FROM f)
    SELECT 'base' AS series, metric, timestamp, value FROM e UNION ALL
    SELECT 'prediction', metric, timestamp, intercept + slope * (epoch_us(timestamp) - epoch_us(low)) / 1e6 FROM g""",
    {"value": 6},
)
def _life(spark, sf_dir):
    rows = events(spark, sf_dir)
    parts = h.remaining_life(rows, 200.0, freq="1h")
    return c.remaining_life_table(rows, parts["predictions"], parts["fit"], 200.0)["rows"]


@query(
    "display_table_widths",
    """SELECT position, "column", CAST(width AS INTEGER) AS width FROM (
    SELECT 0 AS position, 'o_orderkey' AS "column", 16 AS width UNION ALL SELECT 1, 'o_custkey', 16
    UNION ALL SELECT 2, 'o_orderstatus', greatest(least(max(length(o_orderstatus)), 200), 12, 13) FROM orders
    UNION ALL SELECT 3, 'o_totalprice', 16 UNION ALL SELECT 4, 'o_orderdate', 32
    UNION ALL SELECT 5, 'o_orderpriority', greatest(least(max(length(o_orderpriority)), 200), 12, 15) FROM orders)""",
)
def _widths(spark, sf_dir):
    return c.table_widths(table(spark, sf_dir, "orders"))


@query(
    "scatter_map_colors",
    """SELECT c_custkey, c_mktsegment, CASE c_mktsegment WHEN 'MACHINERY' THEN 'red' WHEN 'HOUSEHOLD' THEN 'blue' END AS color
    FROM customer""",
)
def _colours(spark, sf_dir):
    points = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    return c.colour_points(points, {"MACHINERY": "red", "HOUSEHOLD": "blue"}, "c_mktsegment")


# Metadata and maps -------------------------------------------------------------------------------

for _kind in ("series", "dataframe", "multitsframe"):

    @query(
        f"attributes_{_kind}",
        f"""WITH {CTE_EVENTS} SELECT timestamp, metric, value, '{{"owner": "b", "unit": "kW"}}' AS attributes
        FROM e""",
    )
    def _attributes(spark, sf_dir, kind=_kind):
        update, read = {
            "series": (at.update_series_attributes, at.series_attributes),
            "dataframe": (at.update_frame_attributes, at.frame_attributes),
            "multitsframe": (at.update_multits_attributes, at.multits_attributes),
        }[kind]
        marked = update(update(events(spark, sf_dir), {"unit": "kW", "owner": "a"}), {"owner": "b"})
        return marked.withColumn("attributes", F.lit(json.dumps(read(marked), sort_keys=True)))


@query(
    "addupdate_value_in_dictionary",
    "SELECT event_id, CAST(event_id AS DOUBLE) AS k, value AS extra FROM events",
)
def _dictionary(spark, sf_dir):
    rows = table(spark, sf_dir, "events").withColumn("m", F.from_json("props", "map<string,double>"))
    rows = rows.withColumn("m", at.put_in_map(F.col("m"), F.lit("k"), F.col("event_id").cast("double")))
    rows = rows.withColumn("m", at.put_in_map(F.col("m"), F.lit("extra"), F.col("value")))
    return rows.select("event_id", F.col("m")["k"].alias("k"), F.col("m")["extra"].alias("extra"))


# Scoring -----------------------------------------------------------------------------------------


class Line:
    """A fitted straight line with the two methods a scored model has."""

    def __init__(self, slope: float, intercept: float):
        self.slope, self.intercept = slope, intercept

    def predict(self, inputs):
        return self.intercept + self.slope * inputs.iloc[:, 0]

    def decision_function(self, inputs):
        return inputs.iloc[:, 1] - self.predict(inputs)


FIT = """f AS (SELECT regr_slope(l_extendedprice, l_quantity) AS b, regr_intercept(l_extendedprice, l_quantity) AS a FROM lineitem)"""


@query(
    "predict_trained_model",
    f"WITH {FIT} SELECT l_orderkey, l_linenumber, l_quantity, a + b * l_quantity AS prediction FROM lineitem, f",
    {"prediction": 4},
)
def _predict(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice")
    features = VectorAssembler(inputCols=["l_quantity"], outputCol="features").transform(rows)
    model = LinearRegression(labelCol="l_extendedprice", solver="normal").fit(features)
    return s.predict(features, model).select("l_orderkey", "l_linenumber", "l_quantity", "prediction")


def _line(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice")
    fit = rows.agg(F.regr_slope("l_extendedprice", "l_quantity"), F.regr_intercept("l_extendedprice", "l_quantity")).first()
    return rows, Line(fit[0], fit[1])


@query(
    "predict_python_model",
    f"WITH {FIT} SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice, a + b * l_quantity AS prediction FROM lineitem, f",
    {"prediction": 4},
)
def _predict_python(spark, sf_dir):
    rows, model = _line(spark, sf_dir)
    return s.score_batches(rows, model, ["l_quantity"])


@query(
    "decision_function_trained_model",
    f"""WITH {FIT} SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice,
    l_extendedprice - (a + b * l_quantity) AS decision_function_values FROM lineitem, f""",
    {"decision_function_values": 4},
)
def _decision(spark, sf_dir):
    rows, model = _line(spark, sf_dir)
    return s.score_batches(rows, model, ["l_quantity", "l_extendedprice"], "decision_function")


# With one feature of two values, the fitted score is the logit of each value's share of good labels.
@query(
    "decision_function_classifier",
    """WITH x AS (SELECT doc_id, (n_chars > 1500)::INT AS long FROM documents),
    p AS (SELECT long, avg(quality::DOUBLE) AS p FROM x JOIN labels USING (doc_id) GROUP BY long)
    SELECT doc_id, ln(p / (1 - p)) AS decision_function_values FROM x JOIN p USING (long)""",
    {"decision_function_values": 3},
)
def _decision_classifier(spark, sf_dir):
    long = (F.col("n_chars") > 1500).cast("double").alias("long")
    docs = table(spark, sf_dir, "documents").select("doc_id", long)
    features = VectorAssembler(inputCols=["long"], outputCol="features").transform(docs)
    labelled = features.join(table(spark, sf_dir, "labels"), "doc_id")
    model = LogisticRegression(labelCol="quality", maxIter=200, tol=1e-12, standardization=False).fit(labelled)
    return s.decision_values(features, model).select("doc_id", "decision_function_values")
