"""Arithmetic on series: with a scalar, or with another series aligned on the index."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.frames import LONG, Shape, numeric_columns
from tidewell.functions import math as m
from tidewell.operators.joins import align, unique_index
from tidewell.plans.blocks import join_null_safe

BINARY: dict[str, Callable[[Column, Column], Column]] = {
    "add": lambda a, b: a + b,
    "subtract": lambda a, b: a - b,
    "multiply": lambda a, b: a * b,
    "divide": F.try_divide,
    "modulo": m.floored_modulo,
    "power": m.power,
    "log_to_base": m.log_to_base,
    "nth_root": m.nth_root,
}

UNARY: dict[str, Callable[[Column], Column]] = {
    "abs": m.absolute,
    "signum": m.signum,
    "exp": m.exponential,
    "ln": m.natural_log,
    "sqrt": m.square_root,
    "arcuscosine": m.arc_cosine,
    "arcussine": m.arc_sine,
    "arcustangent": m.arc_tangent,
    "cosine": m.cosine,
    "sine": m.sine,
    "tangent": m.tangent,
}


def apply_unary(df: DataFrame, kind: str, shape: Shape = LONG, columns: list[str] | None = None) -> DataFrame:
    """Apply a function to the value, or to several columns of a frame, in one projection."""
    function = UNARY[kind]
    return df.withColumns({c: function(F.col(c)) for c in columns or [shape.value]})


def round_values(df: DataFrame, decimals: int = 0, shape: Shape = LONG, columns: list[str] | None = None) -> DataFrame:
    """Round half to even."""
    return df.withColumns({c: m.rounded(F.col(c), decimals) for c in columns or [shape.value]})


def apply_binary(
    a: DataFrame | float, b: DataFrame | float, kind: str, shape: Shape = LONG, columns: list[str] | None = None
) -> DataFrame:
    """Combine two series, or a series and a scalar on either side.

    Two series meet in a full outer join on keys and index; where one is missing, so is the result.
    """
    function = BINARY[kind]
    if isinstance(a, DataFrame) and isinstance(b, DataFrame):
        pairs = align(a, b, shape)
        return pairs.select(*shape.index, function(F.col("left"), F.col("right")).alias(shape.value))
    if isinstance(a, DataFrame):
        return a.withColumns({c: function(F.col(c), F.lit(float(b))) for c in columns or [shape.value]})
    return b.withColumns({c: function(F.lit(float(a)), F.col(c)) for c in columns or [shape.value]})


def apply_to_frames(a: DataFrame, b: DataFrame, kind: str, shape: Shape = LONG) -> DataFrame:
    """Combine the equally named numeric columns of two frames, which are aligned on the index once."""
    shared = [c for c in numeric_columns(a, shape) if c in numeric_columns(b, shape)]
    sides = [
        unique_index(df.select(*shape.index, *[F.col(c).alias(f"_{side}_{i}") for i, c in enumerate(shared)]), shape,
                     [f"_{side}_{i}" for i in range(len(shared))])
        for side, df in (("a", a), ("b", b))
    ]
    joined = join_null_safe(*sides, shape.index, "full")
    return joined.select(*shape.index, *[BINARY[kind](F.col(f"_a_{i}"), F.col(f"_b_{i}")).alias(c) for i, c in enumerate(shared)])
