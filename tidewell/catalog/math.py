"""Scalar functions and two-series arithmetic."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewell.catalog.base import CTE_BINS, CTE_EVENTS, both, events, query
from tidewell.operators import arithmetic as a

# Argument of the function, and what it is in SQL where defined.
UNARY_SQL = {
    "abs": ("value - 50", "abs(value - 50)"),
    "signum": ("value - 50", "CASE WHEN value > 50 THEN 1.0 WHEN value < 50 THEN -1.0 ELSE 0.0 END"),
    "exp": ("value / 100", "exp(value / 100)"),
    "ln": ("value - 5", "CASE WHEN value > 5 THEN ln(value - 5) END"),
    "sqrt": ("value - 5", "CASE WHEN value >= 5 THEN sqrt(value - 5) END"),
    "arcuscosine": ("value / 100", "CASE WHEN value <= 100 THEN acos(value / 100) END"),
    "arcussine": ("value / 100", "CASE WHEN value <= 100 THEN asin(value / 100) END"),
    "arcustangent": ("value", "atan(value)"),
    "cosine": ("value", "cos(value)"),
    "sine": ("value", "sin(value)"),
    "tangent": ("value / 1000", "tan(value / 1000)"),
}

for _key, (_argument, _sql) in UNARY_SQL.items():

    @query(_key, f"WITH {CTE_EVENTS} SELECT timestamp, metric, {_sql} AS value FROM e", {"value": 9})
    def _unary(spark, sf_dir, key=_key, argument=_argument):
        return a.apply_unary(events(spark, sf_dir).withColumn("value", F.expr(argument)), key)


@query("round", f"WITH {CTE_EVENTS} SELECT timestamp, metric, round_even(value, 1) AS value FROM e", {"value": 4})
def _round(spark, sf_dir):
    return a.round_values(events(spark, sf_dir), 1)


# The remainder of SQL has the sign of the dividend.
MODULO = "CASE WHEN {a} % {b} <> 0 AND ({a} % {b} < 0) <> ({b} < 0) THEN {a} % {b} + {b} ELSE {a} % {b} END"

BINARY_SQL = {
    "add": "l.value + r.value",
    "subtract": "l.value - r.value",
    "multiply": "l.value * r.value",
    "divide": "l.value / nullif(r.value, 0)",
    "power": "pow(l.value, r.value)",
    "log_to_base": "CASE WHEN l.value > 0 AND r.value > 0 AND r.value <> 1 THEN ln(l.value) / ln(r.value) END",
    "nth_root": "CASE WHEN r.value <> 0 THEN pow(l.value, 1 / r.value) END",
    "modulo": MODULO.format(a="l.value", b="nullif(r.value, 0)"),
}

for _key, _sql in BINARY_SQL.items():
    # Arguments of powers are moved close to 1, to keep the digits comparable.
    _scale = "/ 200 + 0.5" if _key in ("power", "nth_root") else ""
    _value = _sql.replace("l.value", f"(l.value {_scale})").replace("r.value", f"(r.value {_scale})")

    @query(
        _key,
        f"WITH {CTE_BINS} SELECT timestamp, metric, {_value} AS value FROM l FULL JOIN r USING (timestamp, metric)",
        {"value": 6},
    )
    def _binary(spark, sf_dir, key=_key, scale=_scale):
        left, right = both(spark, sf_dir)
        if scale:
            left, right = (s.withColumn("value", F.col("value") / 200 + 0.5) for s in (left, right))
        return a.apply_binary(left, right, key)


SCALAR_SQL = {
    "add": "value + 3",
    "subtract": "3 - value",
    "multiply": "value * 3",
    "divide": "3 / nullif(value, 0)",
    "modulo": MODULO.format(a="value", b="0.1::DOUBLE"),
    "power": "pow(1.01, value)",
    "log_to_base": "CASE WHEN value > 0 THEN ln(value) / ln(2.0) END",
    "nth_root": "pow(value, 1 / 3.0)",
}

for _key, _sql in SCALAR_SQL.items():

    @query(f"{_key}_scalar", f"WITH {CTE_EVENTS} SELECT timestamp, metric, {_sql} AS value FROM e", {"value": 7})
    def _scalar(spark, sf_dir, key=_key):
        rows = events(spark, sf_dir)
        if key in ("subtract", "divide"):
            return a.apply_binary(3.0, rows, key)
        if key == "power":
            return a.apply_binary(1.01, rows, key)
        other = {"add": 3, "multiply": 3, "modulo": 0.1, "log_to_base": 2, "nth_root": 3}[key]
        return a.apply_binary(rows, other, key)
