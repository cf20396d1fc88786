"""Piecewise cubic curves through the known points of a series, as coefficients at every point."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewell.frames import Shape
from tidewell.plans.blocks import BLOCK, Blocks, join_null_safe, join_per_series, lay_out, number_rows, row_frames

#: Differences of neighbouring slopes below this share of the series' largest one count as none (Akima).
FLAT = 1e-9


def _near(df: DataFrame, shape: Shape, names: tuple[str, ...], reach: int) -> DataFrame:
    """``<name>_a1``, ``<name>_b1``, ...: the values so many known points before (a) and after (b) each one."""

    def shifted(name: str, k: int):
        return lambda over: F.lag(name, k).over(over) if k > 0 else F.lead(name, -k).over(over)

    made = {f"{n}_a{k}": shifted(n, k) for n in names for k in range(1, reach + 1)}
    made |= {f"{n}_b{k}": shifted(n, -k) for n in names for k in range(1, reach + 1)}
    return row_frames(lay_out(df, shape), reach, reach, made)


def _steps(df: DataFrame, reach: int) -> DataFrame:
    """``h_a1``, ``m_a1``, ...: width and slope of the intervals before and after each point, NULL beyond the ends."""
    places = {0: ("_p", "_v")} | {k: (f"_p_{'a' if k < 0 else 'b'}{abs(k)}", f"_v_{'a' if k < 0 else 'b'}{abs(k)}") for k in range(-reach, reach + 1) if k}
    for k in range(1, reach + 1):
        for side, (left, right) in (("a", (-k, 1 - k)), ("b", (k - 1, k))):
            (p0, v0), (p1, v1) = places[left], places[right]
            df = df.withColumn(f"h_{side}{k}", (F.col(p1) - F.col(p0)).cast("double"))
            df = df.withColumn(f"m_{side}{k}", (F.col(v1) - F.col(v0)) / F.col(f"h_{side}{k}"))
    return df


def _end_slope(h0: Column, h1: Column, m0: Column, m1: Column) -> Column:
    """Three-point slope at an end that keeps the shape of the data."""
    d = ((2 * h0 + h1) * m0 - h0 * m1) / (h0 + h1)
    limited = F.when((F.signum(m0) != F.signum(m1)) & (F.abs(d) > 3 * F.abs(m0)), 3 * m0).otherwise(d)
    return F.when(F.signum(d) != F.signum(m0), F.lit(0.0)).otherwise(limited)


def _pchip(known: DataFrame, shape: Shape) -> DataFrame:
    """Slopes of the monotone curve: weighted harmonic means, 0 at local extremes."""
    df = _steps(_near(known, shape, ("_p", "_v"), 2), 2)
    ha, hb, ma, mb = (F.col(c) for c in ("h_a1", "h_b1", "m_a1", "m_b1"))
    w1, w2 = 2 * hb + ha, hb + 2 * ha
    inner = F.when(ma * mb > 0, (w1 + w2) / (w1 / ma + w2 / mb)).otherwise(0.0)
    first = F.coalesce(_end_slope(hb, F.col("h_b2"), mb, F.col("m_b2")), mb)
    last = F.coalesce(_end_slope(ha, F.col("h_a2"), ma, F.col("m_a2")), ma)
    return df.withColumn("_s", F.when(ma.isNull(), first).when(mb.isNull(), last).otherwise(inner))


def _akima(known: DataFrame, shape: Shape) -> DataFrame:
    """Slopes weighted by how much the neighbouring slopes change; two more intervals are assumed at each end."""
    df = _steps(_near(known, shape, ("_p", "_v"), 2), 2)
    a, b, a2, b2 = (F.col(c) for c in ("m_a1", "m_b1", "m_a2", "m_b2"))
    only = F.coalesce(a, b)
    # Of two points alone, all slopes are that of their line.
    two = (a.isNull() & b2.isNull()) | (b.isNull() & a2.isNull())
    left = F.when(a.isNull(), 2 * b - b2).otherwise(a)
    right = F.when(b.isNull(), 2 * a - a2).otherwise(b)
    df = df.withColumns({"_l1": F.when(two, only).otherwise(left), "_r1": F.when(two, only).otherwise(right)})
    l1, r1 = F.col("_l1"), F.col("_r1")
    df = df.withColumns({"_l2": F.coalesce(a2, 2 * l1 - r1), "_r2": F.coalesce(b2, 2 * r1 - l1)})
    before, after = F.abs(l1 - F.col("_l2")), F.abs(F.col("_r2") - r1)
    df = df.withColumns({"_before": before, "_after": after})
    both = F.col("_before") + F.col("_after")
    most = df.groupBy(*shape.keys).agg(F.max(both).alias("_most"))
    df = join_per_series(df, most, list(shape.keys))
    weighted = (F.col("_after") * l1 + F.col("_before") * r1) / both
    return df.withColumn("_s", F.when(both > FLAT * F.col("_most"), weighted).otherwise((F.col("_l2") + F.col("_r2")) / 2))


def _solved(lower: np.ndarray, diagonal: np.ndarray, upper: np.ndarray, right: np.ndarray) -> np.ndarray:
    """A tridiagonal system for several right sides in log2(n) vector steps: each halves what rows depend on."""
    a, b, c, d = lower.copy(), diagonal.copy(), upper.copy(), right.copy()
    a[:1], c[-1:] = 0.0, 0.0
    reach = 1
    while reach < len(b):
        before, after = np.zeros_like(b), np.zeros_like(b)
        before[reach:] = -a[reach:] / b[:-reach]
        after[:-reach] = -c[:-reach] / b[reach:]
        a1, b1, c1, d1 = np.zeros_like(a), b.copy(), np.zeros_like(c), d.copy()
        b1[reach:] += before[reach:] * c[:-reach]
        b1[:-reach] += after[:-reach] * a[reach:]
        d1[reach:] += before[reach:, None] * d[:-reach]
        d1[:-reach] += after[:-reach, None] * d[reach:]
        a1[reach:] = before[reach:] * a[:-reach]
        c1[:-reach] = after[:-reach] * c[reach:]
        a, b, c, d, reach = a1, b1, c1, d1, 2 * reach
    return d / b[:, None]


def _borders(pdf: pd.DataFrame) -> pd.DataFrame:
    """Unknowns of the neighbouring blocks (``_left``: last one before, ``_right``: first one after) for all blocks.

    ``x_k = p_k + q_k * last_(k-1) + r_k * first_(k+1)`` for the first and last unknown of each block: a chain of
    two by two systems.
    """
    pdf = pdf.sort_values(BLOCK, ignore_index=True)
    p, q, r = (pdf[[f"{c}_first", f"{c}_last"]].to_numpy() for c in "pqr")
    count = len(pdf)
    factors, rights = np.zeros((count, 2, 2)), np.zeros((count, 2))
    for k in range(count):
        # Unknowns before are p' - C' x; only the last one of them enters.
        system = np.eye(2)
        right = p[k].copy()
        if k:
            system -= np.outer(q[k], -factors[k - 1][1])
            right += q[k] * rights[k - 1][1]
        forward = np.column_stack([-r[k], np.zeros(2)])
        factors[k], rights[k] = np.linalg.solve(system, forward), np.linalg.solve(system, right)
    x = np.zeros((count, 2))
    for k in range(count - 1, -1, -1):
        x[k] = rights[k] - (factors[k] @ x[k + 1] if k + 1 < count else 0.0)
    return pdf.assign(_left=np.concatenate([[0.0], x[:-1, 1]]), _right=np.concatenate([x[1:, 0], [0.0]]))


def _curvatures(rows: DataFrame, blocks: Blocks) -> DataFrame:
    """``_c``: the second derivatives that make the curve smooth at every inner point (0 at the ends for now).

    Each block solves its equations for its own right side and for the unknowns of its two neighbours; these
    are found in a small system with two unknowns per block, and put in.
    """
    keys, group = list(blocks.shape.keys), blocks.group
    schema = T.StructType([*rows.schema.fields, *[T.StructField(c, T.DoubleType()) for c in ("_cp", "_cq", "_cr")]])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_row", ignore_index=True)
        lower, diagonal, upper = (pdf[c].to_numpy(dtype=float) for c in ("_low", "_mid", "_up"))
        right = np.zeros((len(pdf), 3))
        right[:, 0] = pdf["_rhs"].to_numpy(dtype=float)
        right[0, 1], right[-1, 2] = -lower[0], -upper[-1]
        found = _solved(lower, diagonal, upper, right)
        return pdf.assign(_cp=found[:, 0], _cq=found[:, 1], _cr=found[:, 2])

    local = rows.groupBy(*group).applyInPandas(run, schema)
    if not blocks.split:
        return local.withColumnRenamed("_cp", "_c")
    ends = local.groupBy(*group).agg(
        *[pick(f"_c{c}", "_row").alias(f"{c}_{end}") for c in "pqr" for end, pick in (("first", F.min_by), ("last", F.max_by))]
    )
    wide = T.StructType([*ends.schema.fields, T.StructField("_left", T.DoubleType()), T.StructField("_right", T.DoubleType())])
    borders = ends.groupBy(*keys).applyInPandas(_borders, wide).select(*group, "_left", "_right")
    joined = join_null_safe(local, borders, group)
    return joined.withColumn("_c", F.col("_cp") + F.col("_cq") * F.col("_left") + F.col("_cr") * F.col("_right"))


def _spline(known: DataFrame, shape: Shape) -> DataFrame:
    """Slopes of the cubic spline without knots at the second and the last but one point."""
    df = _steps(_near(known, shape, ("_p", "_v"), 1), 1)
    counts = df.groupBy(*shape.keys).agg(F.count(F.lit(1)).alias("_n"))
    blocks = number_rows(lay_out(join_per_series(df, counts, list(shape.keys)), shape))
    row, n, ha, hb = F.col("_row"), F.col("_n"), F.col("h_a1"), F.col("h_b1")
    end = (row == 1) | (row == n)
    second, last_but_one, three = row == 2, row == n - 1, n == 3
    equations = {
        "_low": F.when(end | second | three, 0.0).when(last_but_one, ha - hb * hb / ha).otherwise(ha),
        "_up": F.when(end | last_but_one | three, 0.0).when(second, hb - ha * ha / hb).otherwise(hb),
        "_mid": F.when(end, 1.0).when(three, 3 * (ha + hb))
        .otherwise(
            2 * (ha + hb) + F.when(second, ha * (ha + hb) / hb).otherwise(0.0) + F.when(last_but_one, hb * (ha + hb) / ha).otherwise(0.0)
        ),
        "_rhs": F.when(end, 0.0).otherwise(6 * (F.col("m_b1") - F.col("m_a1"))),
    }
    rows = blocks.df.withColumns(equations)
    solved = _curvatures(rows, blocks).select(*known.columns, "_n", "_c")
    # At the ends the third derivative goes on: the curvature follows from the next two.
    df = _steps(_near(solved, shape, ("_p", "_v", "_c"), 2), 2)

    def outer(side: str) -> Column:
        h, g, c1, c2 = (F.col(c) for c in (f"h_{side}1", f"h_{side}2", f"_c_{side}1", f"_c_{side}2"))
        return F.when(F.col("_n") == 2, 0.0).when(F.col("_n") == 3, c1).otherwise(((h + g) * c1 - h * c2) / g)

    first, last = F.col("m_a1").isNull(), F.col("m_b1").isNull()
    df = df.withColumn("_own", F.when(first, outer("b")).when(last, outer("a")).otherwise(F.col("_c")))
    # The point before the last one's neighbour is inner, except in a series of two.
    next_is_last = F.col("m_b2").isNull()
    after = F.when(F.col("_n") == 2, 0.0).when(F.col("_n") == 3, F.coalesce(F.when(first, F.col("_c_b1")), F.col("_c")))
    after = after.when(next_is_last, ((F.col("h_b1") + F.col("h_a1")) * F.col("_c") - F.col("h_b1") * F.col("_c_a1")) / F.col("h_a1"))
    after = after.otherwise(F.col("_c_b1"))
    slope = F.col("m_b1") - F.col("h_b1") * (2 * F.col("_own") + after) / 6
    before_last = F.when(F.col("_n") == 2, 0.0).when(F.col("_n") == 3, F.col("_c_a1")).otherwise(F.col("_c_a1"))
    at_end = F.col("m_a1") + F.col("h_a1") * (2 * F.col("_own") + before_last) / 6
    return df.withColumn("_s", F.when(last, at_end).otherwise(slope))


SLOPES = {"pchip": _pchip, "akima": _akima, "spline": _spline}


def coefficients(known: DataFrame, kind: str, shape: Shape) -> DataFrame:
    """Index, and ``_s``, ``_q``, ``_k``: the curve at a point is ``v + s x + q x² + k x³`` up to the next one.

    ``known`` has the index, ``_p`` (position) and ``_v`` (value), each position once per series. At the last point
    the curve of the interval before it goes on. A series of one point has no curve (NULL).
    """
    shape = Shape(shape.keys, shape.ts, "_v")
    sloped = SLOPES[kind](known, shape).select(*shape.index, "_p", "_v", "_s")
    df = _steps(_near(sloped, shape, ("_p", "_v", "_s"), 1), 1)

    def cubic(h: Column, m: Column, s0: Column, s1: Column) -> tuple[Column, Column]:
        return (3 * m - 2 * s0 - s1) / h, (s0 + s1 - 2 * m) / (h * h)

    q, k = cubic(F.col("h_b1"), F.col("m_b1"), F.col("_s"), F.col("_s_b1"))
    q_before, k_before = cubic(F.col("h_a1"), F.col("m_a1"), F.col("_s_a1"), F.col("_s"))
    return df.select(
        *shape.index, "_s",
        F.coalesce(q, q_before + 3 * k_before * F.col("h_a1")).alias("_q"),
        F.coalesce(k, k_before).alias("_k"),
    )


