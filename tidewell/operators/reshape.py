"""Appending series, and turning frames between wide and long."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.frames import FrameError, require_columns


def append_series(multits: DataFrame, series: DataFrame, metric: str) -> DataFrame:
    """Append the rows of a series to a long frame as one more metric."""
    require_columns(series, "timestamp", "value")
    return multits.unionByName(series.select("timestamp", F.lit(metric).alias("metric"), "value"), allowMissingColumns=True)


def next_metric_name(multits: DataFrame) -> str:
    """The next free ``metric_<i>``: one more than the highest number in use."""
    number = F.regexp_extract("metric", r"^metric_(\d+)$", 1).try_cast("bigint")
    highest = multits.agg(F.max(number)).first()[0]
    return f"metric_{0 if highest is None else highest + 1}"


def timeseries_frame(first: DataFrame, series: DataFrame, name: str | None = None, first_name: str | None = None) -> DataFrame:
    """Long frame from two series, or a long frame with one more series."""
    if "metric" not in first.columns:
        first = first.select("timestamp", F.lit(first_name or "metric_0").alias("metric"), "value")
    if name is None:
        name = next_metric_name(first)
    return append_series(first, series, name)


def wide_to_long(df: DataFrame, timestamp: str = "timestamp") -> DataFrame:
    """One row per cell; missing cells stay as NULL rows."""
    columns = [c for c in df.columns if c != timestamp]
    return df.unpivot(timestamp, columns, "metric", "value").withColumnRenamed(timestamp, "timestamp")


def long_to_wide(multits: DataFrame, metrics: list[str] | None = None) -> DataFrame:
    """One column per metric. A repeated (timestamp, metric) stops the job.

    The metric names become columns, so without ``metrics`` they are listed first; their number
    is bounded by ``spark.sql.pivotMaxValues``.
    """
    require_columns(multits, "timestamp", "metric", "value")
    if metrics is None:
        limit = int(multits.sparkSession.conf.get("spark.sql.pivotMaxValues", "10000"))
        names = multits.select("metric").distinct().orderBy("metric").limit(limit + 1).collect()
        if len(names) > limit:
            raise FrameError(f"more than {limit} metrics do not fit into columns")
        metrics = [row["metric"] for row in names]
    cells = multits.groupBy("timestamp", "metric").agg(
        F.count(F.lit(1)).alias("_times"), F.first("value").alias("value")
    )
    message = F.concat(F.lit("duplicate (timestamp, metric) for "), F.col("metric"))
    single = F.when(F.col("_times") == 1, True).otherwise(F.raise_error(message).cast("boolean"))
    return cells.where(single).groupBy("timestamp").pivot("metric", metrics).agg(F.first("value"))


def grid_2d(spark: SparkSession, x_min: float, x_max: float, y_min: float, y_max: float, n: int) -> DataFrame:
    """n x n points of two linear scales, row by row."""
    if n < 1:
        raise FrameError("n must be positive")
    at = F.col("id")
    column, line = at % n, F.floor(at / n)
    part = F.lit(max(n - 1, 1))
    return spark.range(n * n).select(
        at.alias("position"),
        (F.lit(float(x_min)) + column / part * F.lit(float(x_max - x_min))).alias("x"),
        (F.lit(float(y_min)) + line / part * F.lit(float(y_max - y_min))).alias("y"),
    )


def grid_axis(spark: SparkSession, low: float, high: float, n: int) -> DataFrame:
    """One linear scale of n points."""
    step = F.col("id") / F.lit(max(n - 1, 1))
    return spark.range(n).select(
        F.col("id").alias("position"), (F.lit(float(low)) + step * F.lit(float(high - low))).alias("value")
    )
