"""Projections: picking, naming and typing columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewell.frames import (
    LONG,
    SCALAR_TYPES,
    FrameError,
    Shape,
    check_schema,
    require_columns,
    validate_multits,
    value_columns,
)


def select_column(df: DataFrame, column: str, shape: Shape = LONG) -> DataFrame:
    """One column of a frame as a series."""
    require_columns(df, column)
    return df.select(*shape.index, *shape.tie, F.col(column).alias(shape.value))


def name_series(df: DataFrame, name: str, shape: Shape = LONG) -> DataFrame:
    """Name a series; in the long model the name of a series is its metric."""
    if "metric" in shape.keys:
        return df.withColumn("metric", F.lit(name))
    return df.select(F.lit(name).alias("metric"), *df.columns)


def series_to_frame(df: DataFrame, name: str, shape: Shape = LONG) -> DataFrame:
    """One-column frame whose column carries the name of the series."""
    require_columns(df, shape.value)
    return df.select(*shape.index, F.col(shape.value).alias(name))


def frame_to_series(df: DataFrame, shape: Shape = LONG) -> DataFrame:
    """Series from a frame with exactly one value column."""
    columns = value_columns(df, shape)
    if len(columns) != 1:
        raise FrameError(f"only a frame with one value column becomes a series, this one has {columns}")
    return df.select(*shape.index, F.col(columns[0]).alias(shape.value))


def pass_typed(df: DataFrame, column: str, kind: str, on_error: str = "fail") -> DataFrame | tuple[DataFrame, DataFrame]:
    """Cast ``column`` to a declared scalar type.

    ``on_error``: ``fail`` stops the job at the first value that does not fit, ``null`` keeps
    the row without it, ``quarantine`` returns the fitting and the offending rows.
    """
    require_columns(df, column)
    raw = F.col(column)
    cast = raw.try_cast(SCALAR_TYPES[kind])
    misfit = raw.isNotNull() & cast.isNull()
    if on_error == "quarantine":
        return df.where(~misfit).withColumn(column, cast), df.where(misfit)
    if on_error == "null":
        return df.withColumn(column, cast)
    if on_error != "fail":
        raise FrameError(f"unknown on_error {on_error!r}")
    message = F.concat(F.lit(f"column {column} does not hold {kind}: "), raw.cast("string"))
    return df.withColumn(column, F.when(misfit, F.raise_error(message).cast(SCALAR_TYPES[kind])).otherwise(cast))


def pass_series(df: DataFrame, kind: str = "float", shape: Shape = LONG) -> DataFrame:
    """Enforce the schema of a series: keys, index and one typed value."""
    typed = pass_typed(check_schema(df, "series", shape), shape.value, kind)
    return typed.select(*shape.index, *shape.tie, shape.value)


def pass_frame(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Enforce a given schema: reorders and casts columns, refuses what does not fit."""
    return df.to(schema)


def pass_multits(df: DataFrame) -> DataFrame:
    """Enforce the long-frame rules."""
    return validate_multits(df)
