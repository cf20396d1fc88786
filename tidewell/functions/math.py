"""Scalar functions on columns. An undefined result is NULL, never NaN or infinity."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def defined(column: Column) -> Column:
    """NULL for NaN and the infinities."""
    infinite = F.abs(column) == F.lit(float("inf"))
    return F.when(~F.isnan(column) & ~infinite, column)


def absolute(x: Column) -> Column:
    return F.abs(x)


def rounded(x: Column, decimals: int = 0) -> Column:
    """Half to even; negative decimals round to tens, hundreds and so on."""
    return F.bround(x, decimals)


def signum(x: Column) -> Column:
    return F.signum(x)


def exponential(x: Column) -> Column:
    return defined(F.exp(x))


def natural_log(x: Column) -> Column:
    return F.ln(x)


def log_to_base(x: Column, base: Column) -> Column:
    return F.try_divide(F.ln(x), F.ln(base))


def floored_modulo(a: Column, b: Column) -> Column:
    """Exact remainder with the sign of the divisor; NULL for a divisor of 0."""
    rest = F.try_mod(a, b)
    return F.when((rest != 0) & ((rest < 0) != (b < 0)), rest + b).otherwise(rest)


def nth_root(x: Column, n: Column) -> Column:
    return defined(F.pow(x, F.try_divide(F.lit(1.0), n)))


def power(base: Column, exponent: Column) -> Column:
    return defined(F.pow(base, exponent))


def square_root(x: Column) -> Column:
    return defined(F.sqrt(x))


def arc_cosine(x: Column) -> Column:
    return defined(F.acos(x))


def arc_sine(x: Column) -> Column:
    return defined(F.asin(x))


def arc_tangent(x: Column) -> Column:
    return F.atan(x)


def cosine(x: Column) -> Column:
    return defined(F.cos(x))


def sine(x: Column) -> Column:
    return defined(F.sin(x))


def tangent(x: Column) -> Column:
    return defined(F.tan(x))
