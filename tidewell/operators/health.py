"""Alerts from scores, and remaining life from a linear trend."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.frames import LONG, Shape, tick
from tidewell.functions.durations import UNIT_MICROS, from_micros, positive_duration
from tidewell.plans.blocks import grid, join_per_series, lay_out, narrowed, neighbour


def alerts_from_score(df: DataFrame, threshold: float, shape: Shape = LONG) -> DataFrame:
    """Changes of ``score > threshold``: 1 where it starts, -1 where it ends, 0 elsewhere."""
    above = F.coalesce((F.col(shape.value) > F.lit(float(threshold))).cast("int"), F.lit(0))
    flagged = lay_out(narrowed(df.withColumn("_above", above), df), shape)
    stepped = neighbour(flagged, {"_before": F.col("_above")}).rows()
    change = F.coalesce(F.col("_above") - F.col("_before"), F.lit(0))
    return stepped.select(*shape.index, *shape.tie, change.alias("alert"))


def remaining_life(
    df: DataFrame, limit: float, days: int = 3, freq: str = "5min", shape: Shape = LONG
) -> dict[str, DataFrame]:
    """Least squares line over the seconds since the start, per series.

    Gives coefficients and the time the line reaches ``limit`` (missing for a flat line), and
    the line on a grid until ``days`` after the last point.
    """
    points = df.na.drop("any", subset=[shape.value])
    at = tick(df, shape.ts)
    starts = points.groupBy(*shape.keys).agg(F.min(at).alias("_start"), F.max(at).alias("_end"))
    joined = join_per_series(points, starts, shape.keys)
    seconds = (at - F.col("_start")) / F.lit(1e6)
    fit = joined.groupBy(*shape.keys, "_start", "_end").agg(
        F.regr_slope(F.col(shape.value), seconds).alias("slope"),
        F.regr_intercept(F.col(shape.value), seconds).alias("intercept"),
    )
    reached = F.try_divide(F.lit(float(limit)) - F.col("intercept"), F.col("slope"))
    violation = from_micros(F.floor(F.col("_start") + reached * F.lit(1e6)))
    table = fit.select(*shape.keys, "intercept", "slope", violation.alias("violation"))
    step = positive_duration(freq)
    bounds = fit.withColumn("_until", F.col("_end") + F.lit(days * UNIT_MICROS["D"]))
    points_at = grid(bounds, shape.keys, "_start", "_until", step, "_at")
    line = F.col("intercept") + F.col("slope") * (F.col("_at") - F.col("_start")) / F.lit(1e6)
    return {
        "fit": table,
        "predictions": points_at.select(*shape.keys, from_micros(F.col("_at")).alias(shape.ts), line.alias(shape.value)),
    }
