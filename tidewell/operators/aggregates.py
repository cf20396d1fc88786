"""Aggregations per series: all of them fold on the map side."""

from __future__ import annotations

import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.frames import LONG, FrameError, Shape, elapsed, is_time, numeric_columns, require_columns, tick
from tidewell.operators.joins import align, trapezoid
from tidewell.plans.blocks import join_null_safe, join_per_series, lay_out, neighbour
from tidewell.plans.ranks import quantiles

# The percentiles of a summary.
SUMMARY_PERCENTILES = (0.05, 0.10, 0.25, 0.50, 0.75, 0.90, 0.95)


def _per_series(df: DataFrame, shape: Shape, make, columns: list[str] | None) -> DataFrame:
    columns = columns or [shape.value]
    require_columns(df, *columns)
    return df.groupBy(*shape.keys).agg(*[make(F.col(c)).alias(c) for c in columns])


def average(df: DataFrame, shape: Shape = LONG, columns: list[str] | None = None) -> DataFrame:
    return _per_series(df, shape, F.avg, columns)


def maximum(df: DataFrame, shape: Shape = LONG, columns: list[str] | None = None) -> DataFrame:
    return _per_series(df, shape, F.max, columns)


def minimum(df: DataFrame, shape: Shape = LONG, columns: list[str] | None = None) -> DataFrame:
    return _per_series(df, shape, F.min, columns)


def median(df: DataFrame, shape: Shape = LONG, columns: list[str] | None = None) -> DataFrame:
    """Exact interpolated median."""
    columns = columns or [shape.value]
    require_columns(df, *columns)
    if len(columns) == 1:
        return quantiles(df, shape.keys, columns[0], [0.5]).select(*shape.keys, F.col("quantiles")[0].alias(columns[0]))
    # All columns in one pass: a column is a key like those of the series.
    cells = F.array(*[F.struct(F.lit(i).alias("c"), F.col(c).cast("double").alias("v")) for i, c in enumerate(columns)])
    long = df.select(*shape.keys, F.explode(cells).alias("_cell")).select(*shape.keys, F.col("_cell.c").alias("_column"), F.col("_cell.v").alias("_v"))
    found = quantiles(long, [*shape.keys, "_column"], "_v", [0.5])
    middle = F.col("quantiles")[0]
    return found.groupBy(*shape.keys).agg(*[F.max(F.when(F.col("_column") == i, middle)).alias(c) for i, c in enumerate(columns)])


def standard_deviation(df: DataFrame, shape: Shape = LONG, columns: list[str] | None = None) -> DataFrame:
    """Sample standard deviation."""
    return _per_series(df, shape, F.stddev_samp, columns)


def sum_up(df: DataFrame, shape: Shape = LONG) -> DataFrame:
    """Sum of a series, 0 when it holds no value."""
    return df.groupBy(*shape.keys).agg(F.coalesce(F.sum(shape.value), F.lit(0.0)).alias(shape.value))


def sum_columns(df: DataFrame, name: str, shape: Shape = LONG, columns: list[str] | None = None) -> DataFrame:
    """Row-wise sum over the numeric columns; missing cells count as 0."""
    columns = columns or numeric_columns(df, shape)
    total: Column = F.lit(0.0)
    for c in columns:
        total = total + F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    return df.select(*shape.index, *shape.tie, total.alias(name))


def integrate(df: DataFrame, shape: Shape = LONG) -> DataFrame:
    """Trapezoid integral over the index (seconds for a time index); fewer than two points are an error."""
    points = df.na.drop("any", subset=[shape.value])
    now, value = tick(points, shape.ts), F.col(shape.value)
    steps = neighbour(lay_out(points, shape), {"_t": now, "_v": value}).rows()
    area = trapezoid(points, now, F.col("_t"), value, F.col("_v"), shape)
    sums = steps.groupBy(*shape.keys).agg(F.sum(area).alias("_area"), F.count(F.lit(1)).alias("_count"))
    message = F.lit("integrate needs at least two points per series")
    checked = F.when(F.col("_count") >= 2, F.col("_area")).otherwise(F.raise_error(message).cast("double"))
    return sums.select(*shape.keys, checked.alias("integral"))


ISO = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"


def first_datetime(df: DataFrame, shape: Shape = LONG) -> DataFrame:
    """Earliest index value as ISO text."""
    return df.groupBy(*shape.keys).agg(F.date_format(F.min(shape.ts), ISO).alias("first_index"))


def last_datetime(df: DataFrame, shape: Shape = LONG) -> DataFrame:
    """Latest index value as ISO text."""
    return df.groupBy(*shape.keys).agg(F.date_format(F.max(shape.ts), ISO).alias("last_index"))


def regression_of_two(x: DataFrame, y: DataFrame, shape: Shape = LONG) -> dict[str, DataFrame]:
    """Least squares line of y on x, paired by index, per series: coefficients and residuals."""
    pairs = align(x, y, shape, "inner").where(F.col("left").isNotNull() & F.col("right").isNotNull())
    fit = pairs.groupBy(*shape.keys).agg(
        F.regr_intercept("right", "left").alias("intercept"), F.regr_slope("right", "left").alias("slope")
    )
    joined = join_per_series(pairs, fit, shape.keys)
    predicted = F.col("intercept") + F.col("slope") * F.col("left")
    scored = joined.select(*shape.index, predicted.alias("preds"), (predicted - F.col("right")).alias("diffs"))
    return {"fit": fit, "scored": scored}


def linear_regression(df: DataFrame, x_columns: list[str], y_columns: list[str], index: tuple[str, ...] = ()) -> dict:
    """Least squares of several targets on several features: coefficients and residuals.

    All means and covariances come from one aggregation over the rows, whatever the number of
    targets; the driver solves a system of the size of the feature list. Rows with a missing
    feature or target are left out.
    """
    require_columns(df, *x_columns, *y_columns, *index)
    rows = df.na.drop("any", subset=[*x_columns, *y_columns])
    means = [F.avg(c).alias(f"m_{c}") for c in (*x_columns, *y_columns)]
    pairs = [(a, b) for a in x_columns for b in (*x_columns, *y_columns)]
    moments = rows.agg(*means, *[F.covar_pop(a, b).alias(f"c{i}") for i, (a, b) in enumerate(pairs)]).first()
    if moments[0] is None:
        raise FrameError("a regression needs rows without missing values")
    spread = {pair: moments[f"c{i}"] for i, pair in enumerate(pairs)}
    matrix = np.array([[spread[a, b] for b in x_columns] for a in x_columns])
    scored, coefficients, out = rows, [], []
    for target in y_columns:
        weights = np.linalg.lstsq(matrix, np.array([spread[a, target] for a in x_columns]), rcond=None)[0]
        intercept = moments[f"m_{target}"] - sum(w * moments[f"m_{c}"] for w, c in zip(weights, x_columns, strict=True))
        coefficients.append((target, "intercept", float(intercept)))
        coefficients += [(target, c, float(w)) for c, w in zip(x_columns, weights, strict=True)]
        line: Column = F.lit(float(intercept))
        for c, w in zip(x_columns, weights, strict=True):
            line = line + F.lit(float(w)) * F.col(c)
        out += [line.alias(f"{target}_pred"), (line - F.col(target)).alias(f"{target}_diff")]
    table = df.sparkSession.createDataFrame(coefficients, "target string, term string, coefficient double")
    return {"coefficients": table, "scored": scored.select(*index, *out)}


def fit_regression(df: DataFrame, x_columns: list[str], target: str) -> PipelineModel:
    """A pyspark.ml model of one target, for the model store and for batch scoring."""
    rows = df.na.drop("any", subset=[*x_columns, target])
    assemble = VectorAssembler(inputCols=x_columns, outputCol="features")
    fit = LinearRegression(featuresCol="features", labelCol=target, solver="normal", regParam=0.0)
    return Pipeline(stages=[assemble, fit]).fit(rows)


def standard_scale(df: DataFrame, shape: Shape = LONG, columns: list[str] | None = None) -> DataFrame:
    """z-score per series with the population deviation; without spread the divisor is 1."""
    columns = columns or [shape.value]
    stats = df.groupBy(*shape.keys).agg(
        *[F.avg(c).alias(f"_avg_{c}") for c in columns], *[F.stddev_pop(c).alias(f"_std_{c}") for c in columns]
    )
    joined = join_per_series(df, stats, shape.keys)
    scaled = {
        c: (F.col(c) - F.col(f"_avg_{c}")) / F.when(F.col(f"_std_{c}") == 0, F.lit(1.0)).otherwise(F.col(f"_std_{c}"))
        for c in columns
    }
    return joined.withColumns(scaled).select(*df.columns)


def _describe(value: Column, prefix: str) -> list[Column]:
    return [
        F.count(value).alias(f"{prefix}_count"),
        F.avg(value).alias(f"{prefix}_mean"),
        F.stddev_samp(value).alias(f"{prefix}_std"),
        F.min(value).alias(f"{prefix}_min"),
        F.max(value).alias(f"{prefix}_max"),
    ]


def summary(df: DataFrame, shape: Shape = LONG) -> DataFrame:
    """Length, distribution of values and of index distances, duplicates, first and last point."""
    if not is_time(df, shape.ts):
        raise FrameError("summary needs a time index")
    at = tick(df, shape.ts)
    blocks = lay_out(df, shape)
    small = not blocks.split
    stepped = neighbour(blocks, {"_t": at}).rows()
    gaps = stepped.withColumn("_gap", elapsed(df, at, F.col("_t"), shape.ts))
    value, gap = F.col(shape.value), F.col("_gap")
    wanted = F.array(*[F.lit(p) for p in SUMMARY_PERCENTILES])
    facts = gaps.groupBy(*shape.keys).agg(
        F.count(F.lit(1)).alias("length"),
        *_describe(value, "value"),
        *_describe(gap, "distance"),
        F.min(shape.ts).alias("first_index"),
        F.max(shape.ts).alias("last_index"),
        F.min_by(shape.value, F.struct(*shape.order)).alias("first_value"),
        F.max_by(shape.value, F.struct(*shape.order)).alias("last_value"),
        F.count_if(F.col("_t") == at).alias("duplicate_index"),
        # Series of one block: their percentile states are small enough for this aggregation.
        *([F.percentile(value, wanted).alias("value_percentiles")] if small else []),
        *([F.percentile(gap, wanted).alias("distance_percentiles")] if small else []),
    )
    per_value = df.groupBy(*shape.keys, shape.value).count().groupBy(*shape.keys)
    parts = [per_value.agg(F.sum(F.col("count") - 1).alias("duplicate_values"))]
    if not small:
        parts.append(_percentiles(df, shape, shape.value, "value_percentiles"))
        parts.append(_percentiles(gaps, shape, "_gap", "distance_percentiles"))
    for part in parts:
        facts = join_null_safe(facts, part, shape.keys, "left") if shape.keys else facts.crossJoin(part)
    first, last = (F.unix_micros(F.col(c).cast("timestamp")) for c in ("first_index", "last_index"))
    return facts.withColumn("duration", (last - first) / F.lit(1e6))


def _percentiles(df: DataFrame, shape: Shape, column: str, out: str) -> DataFrame:
    """Percentiles of series that do not all fit one block."""
    found = quantiles(df, shape.keys, column, SUMMARY_PERCENTILES, small=False)
    return found.select(*shape.keys, F.col("quantiles").alias(out))
