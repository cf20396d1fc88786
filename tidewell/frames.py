"""Data model: the long frame, its column roles, typing, validation and metadata."""

from __future__ import annotations

import json
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class Shape:
    """Which columns of a frame are the series keys, the index, the value and the tie-break.

    Rows with the same keys and index are ordered by ``tie`` and then by the value, so that
    every order-sensitive operator has one well-defined result.
    """

    keys: tuple[str, ...] = ("metric",)
    ts: str = "timestamp"
    value: str = "value"
    tie: tuple[str, ...] = ()

    @property
    def index(self) -> tuple[str, ...]:
        return (*self.keys, self.ts)

    @property
    def order(self) -> tuple[str, ...]:
        rest = (*self.tie, self.value)
        return (self.ts, *dict.fromkeys(c for c in rest if c != self.ts))

    def with_value(self, value: str) -> Shape:
        return replace(self, value=value)


LONG = Shape()

MULTITS_SCHEMA = T.StructType(
    [
        T.StructField("timestamp", T.TimestampType(), False),
        T.StructField("metric", T.StringType(), False),
        T.StructField("value", T.DoubleType(), True),
    ]
)

# The declared scalar types of the data model and their Spark types.
SCALAR_TYPES = {"int": "bigint", "float": "double", "string": "string", "boolean": "boolean"}


class FrameError(ValueError):
    """A frame does not have the declared kind."""


def nan_to_null(df: DataFrame) -> DataFrame:
    """Missing is NULL everywhere behind the readers; NaN would win every max and sort."""
    floats = [f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in floats}) if floats else df


def is_time(df: DataFrame, column: str) -> bool:
    return isinstance(df.schema[column].dataType, (T.TimestampType, T.TimestampNTZType))


def tick(df: DataFrame, column: str) -> Column:
    """The index as a number: microseconds since the epoch, or the numeric index itself."""
    if is_time(df, column):
        return F.unix_micros(F.col(column).cast("timestamp"))
    return F.col(column)


def elapsed(df: DataFrame, later: Column, earlier: Column, column: str) -> Column:
    """Distance of two ticks in seconds for a time index, in index units otherwise."""
    diff = later - earlier
    return diff / F.lit(1e6) if is_time(df, column) else diff.cast("double")


def numeric_columns(df: DataFrame, shape: Shape) -> list[str]:
    skip = {*shape.keys, shape.ts, *shape.tie}
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType) and f.name not in skip]


def value_columns(df: DataFrame, shape: Shape) -> list[str]:
    skip = {*shape.keys, shape.ts, *shape.tie}
    return [c for c in df.columns if c not in skip]


def require_columns(df: DataFrame, *names: str) -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise FrameError(f"missing columns {missing}; the frame has {df.columns}")


def check_schema(df: DataFrame, kind: str, shape: Shape = LONG) -> DataFrame:
    """Analysis-time check that ``df`` is a 'series', 'dataframe' or 'multitsframe'."""
    if kind == "multitsframe":
        require_columns(df, "timestamp", "metric")
        if len(df.columns) < 3:
            raise FrameError("a long frame needs timestamp, metric and at least one value column")
        if not is_time(df, "timestamp"):
            raise FrameError("column timestamp must be a timestamp")
    elif kind == "series":
        require_columns(df, *shape.keys, shape.ts, shape.value)
        if not isinstance(df.schema[shape.ts].dataType, (T.TimestampType, T.TimestampNTZType, T.NumericType)):
            raise FrameError(f"index {shape.ts} must be a timestamp or a number")
    elif kind != "dataframe":
        raise FrameError(f"unknown kind {kind!r}")
    return df


def validate_multits(df: DataFrame, mode: str = "strict") -> DataFrame | tuple[DataFrame, DataFrame]:
    """Long-frame rules: both key columns present and non-null, metric a string, UTC timestamp.

    ``strict`` fails the job on the first offending row, inside the scan stage, without a
    separate pass. ``quarantine`` returns the good and the bad rows.
    """
    typed = check_schema(df, "multitsframe").withColumns(
        {"timestamp": F.col("timestamp").cast("timestamp"), "metric": F.col("metric").cast("string")}
    )
    good = F.col("timestamp").isNotNull() & F.col("metric").isNotNull()
    if mode == "quarantine":
        return typed.where(good), typed.where(~good)
    if mode != "strict":
        raise FrameError(f"unknown mode {mode!r}")
    message = F.lit("a long frame must not have null in timestamp or metric")
    return typed.where(F.when(good, True).otherwise(F.raise_error(message).cast("boolean")))


def parse_any(column: Column) -> Column:
    """JSON-decode a string up to twice into a variant; what does not parse stays a string."""
    text = column.cast("string")
    once = F.try_parse_json(text)
    inner = F.try_variant_get(once, "$", "string")
    is_text = F.schema_of_variant(once) == "STRING"
    twice = F.when(is_text, F.coalesce(F.try_parse_json(inner), once)).otherwise(once)
    return F.coalesce(twice, text.cast("variant"))


_ATTRS = "attrs"


def get_attributes(df: DataFrame, column: str) -> dict:
    """Metadata dictionary carried by ``column``."""
    return json.loads(df.schema[column].metadata.get(_ATTRS, "{}"))


def update_attributes(df: DataFrame, attributes: dict, column: str) -> DataFrame:
    """Add or replace metadata entries; they survive filters, projections and parquet files."""
    merged = {**get_attributes(df, column), **attributes}
    field = df.schema[column].metadata or {}
    return df.withMetadata(column, {**field, _ATTRS: json.dumps(merged)})
