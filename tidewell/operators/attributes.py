"""Metadata of frames, and map-typed values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.frames import LONG, Shape, get_attributes, require_columns, update_attributes


def update_series_attributes(df: DataFrame, attributes: dict, shape: Shape = LONG) -> DataFrame:
    return update_attributes(df, attributes, shape.ts)


def update_frame_attributes(df: DataFrame, attributes: dict, column: str | None = None) -> DataFrame:
    """Attributes of a frame live on a designated column, by default the first one."""
    return update_attributes(df, attributes, column or df.columns[0])


def update_multits_attributes(df: DataFrame, attributes: dict) -> DataFrame:
    require_columns(df, "timestamp", "metric")
    return update_attributes(df, attributes, "timestamp")


def series_attributes(df: DataFrame, shape: Shape = LONG) -> dict:
    return get_attributes(df, shape.ts)


def frame_attributes(df: DataFrame, column: str | None = None) -> dict:
    return get_attributes(df, column or df.columns[0])


def multits_attributes(df: DataFrame) -> dict:
    return get_attributes(df, "timestamp")


def put_in_map(entries: Column, key: Column, value: Column) -> Column:
    """Add or replace one entry of a map column."""
    rest = F.map_filter(entries, lambda k, _: k != key)
    return F.map_concat(rest, F.create_map(key, value))
