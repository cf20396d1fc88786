"""Rolling, running and neighbouring-row operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

from tidewell.frames import LONG, FrameError, Shape, elapsed, require_columns, tick
from tidewell.functions.durations import from_micros, parse_duration, positive_duration
from tidewell.operators.curves import coefficients
from tidewell.operators.joins import unique_index
from tidewell.plans.blocks import (
    BLOCK, DENSE_FRAME_ROWS, defined, join_null_safe, lay_out, narrowed, neighbour, number_rows, rolling_rows, row_frames, running,
    time_frames, with_facts,
)
from tidewell.plans.wide import wide_frames

STATISTICS = ("mean", "std", "min", "max", "median")


def _statistic(kind: str, value: Column, over: WindowSpec) -> Column:
    if kind == "median":
        return F.percentile(value, 0.5).over(over)
    return {"mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max}[kind](value).over(over)


def moving_number(df: DataFrame, kind: str, n: int, shape: Shape = LONG) -> DataFrame:
    """Statistic over the last ``n`` points, missing until there are n of them.

    Medians, and frames of many rows, run in Arrow blocks, so that a row costs the same for any n. Frames of
    more rows than half a block are put together from blocks.
    """
    if n < 1:
        raise FrameError("n must be positive")
    points = narrowed(df.na.drop("any", subset=[shape.value]), df)
    value = F.col(shape.value)

    def make(over: WindowSpec) -> Column:
        frame = over.rowsBetween(-(n - 1), 0)
        return F.when(F.count(value).over(frame) == n, defined(_statistic(kind, value, frame)))

    blocks = lay_out(points, shape)
    if blocks.split and n - 1 > blocks.block_rows // 2:
        framed = with_facts(wide_frames(points, shape, {"_stat": kind}, n=n), blocks.facts)
    elif kind == "median" or n > DENSE_FRAME_ROWS:
        framed = rolling_rows(blocks, n, {"_stat": kind}, shape.value)
    else:
        framed = row_frames(blocks, n - 1, 0, {"_stat": make})
    return narrowed(framed.withColumn(shape.value, F.col("_stat")).drop("_stat"), framed)


def moving_time(df: DataFrame, kind: str, t: str, shape: Shape = LONG) -> DataFrame:
    """Statistic over the points in ``(ts - t, ts]``."""
    points = narrowed(df.na.drop("any", subset=[shape.value]), df)
    framed = time_frames(points, shape, positive_duration(t), {"_stat": kind})
    return narrowed(framed.withColumn(shape.value, F.col("_stat")).select(*df.columns), framed)


def smooth(df: DataFrame, window_size: str, shape: Shape = LONG) -> DataFrame:
    """Moving mean over a time window; rows with a missing value stay and are skipped in the mean."""
    framed = time_frames(df, shape, positive_duration(window_size), {"_stat": "mean"})
    return narrowed(framed.withColumn(shape.value, F.col("_stat")).select(*df.columns), framed)


def filter_outliers(df: DataFrame, factor: float, window_size: str, shape: Shape = LONG) -> DataFrame:
    """Rows strictly inside ``mean ± factor * std`` of their trailing window; a lone first row drops out."""
    framed = time_frames(df, shape, positive_duration(window_size), {"_mean": "mean", "_std": "std"})
    reach = F.lit(float(factor)) * F.col("_std")
    value = F.col(shape.value)
    inside = (value > F.col("_mean") - reach) & (value < F.col("_mean") + reach)
    return narrowed(framed.where(inside).select(*df.columns), framed)


def cumulative_sum(df: DataFrame, shape: Shape = LONG) -> DataFrame:
    """Running sum; a missing value stays missing and does not count."""
    value = F.col(shape.value)
    summed = running(lay_out(df, shape), {"_sum": ("sum", value)}).rows()
    result = summed.withColumn(shape.value, F.when(value.isNotNull(), F.col("_sum"))).select(*df.columns)
    return narrowed(result, summed)


def _require_two(df: DataFrame, shape: Shape, what: str) -> None:
    shortest = df.groupBy(*shape.keys).count().agg(F.min("count")).first()[0]
    if shortest is None or shortest < 2:
        raise FrameError(f"{what} needs at least two points per series")


def consecutive_differences(df: DataFrame, shape: Shape = LONG) -> DataFrame:
    """Each value minus the one before; the first point of a series is left out."""
    points = narrowed(df.na.drop("any", subset=[shape.value]), df)
    value = F.col(shape.value)
    stepped = neighbour(lay_out(points, shape), {"_v": value}).rows()
    moved = stepped.where(F.col("_v").isNotNull()).withColumn(shape.value, value - F.col("_v"))
    return narrowed(moved.select(*df.columns), stepped)


def derivative(df: DataFrame, shape: Shape = LONG, strict: bool = False) -> DataFrame:
    """Difference quotient by the index (per second on a time index).

    ``strict`` refuses series with fewer than two points; otherwise they give no rows.
    """
    points = narrowed(df.na.drop("any", subset=[shape.value]), df)
    if strict:
        _require_two(points, shape, "derivative")
    stepped = _quotients(points, shape)
    return narrowed(stepped.where(F.col("_present")).select(*df.columns), stepped)


def difference_quotients(
    df: DataFrame, shape: Shape = LONG, order: tuple[str, ...] | None = None, dropna: bool = True
) -> DataFrame:
    """Difference quotient between neighbouring rows in the given order, without sorting by the index."""
    result = _quotients(df, shape, order)
    if dropna:
        result = result.where(F.col(shape.value).isNotNull())
    return result.select(*df.columns)


def _quotients(df: DataFrame, shape: Shape, order: tuple[str, ...] | None = None) -> DataFrame:
    now, value = tick(df, shape.ts), F.col(shape.value)
    before = {"_t": now, "_v": value, "_present": F.lit(True)}
    stepped = neighbour(lay_out(df, shape, order), before).rows()
    quotient = F.try_divide(value - F.col("_v"), elapsed(df, now, F.col("_t"), shape.ts))
    return narrowed(stepped.withColumn(shape.value, quotient), stepped)


def shift_values(df: DataFrame, periods: int, shape: Shape = LONG) -> DataFrame:
    """Move the values by rows against the index; vacated rows are missing."""
    value = F.col(shape.value)

    def make(over: WindowSpec) -> Column:
        return F.lag(value, periods).over(over) if periods >= 0 else F.lead(value, -periods).over(over)

    blocks = lay_out(df, shape)
    if blocks.split:
        # By row number, so that a long shift copies no more rows than a short one.
        numbered = number_rows(blocks).df
        source = numbered.select(*shape.keys, (F.col("_row") + periods).alias("_row"), value.alias("_moved"))
        framed = join_null_safe(numbered.drop(BLOCK), source, [*shape.keys, "_row"], "left")
        return narrowed(framed.withColumn(shape.value, F.col("_moved")).select(*df.columns), df)
    framed = row_frames(blocks, max(periods, 0), max(-periods, 0), {"_moved": make})
    return narrowed(framed.withColumn(shape.value, F.col("_moved")).select(*df.columns), framed)


def time_gaps(df: DataFrame, shape: Shape = LONG, order: tuple[str, ...] | None = None, strict: bool = False) -> DataFrame:
    """Distance of each index value to the one before, in the given order."""
    if strict:
        _require_two(df, shape, "time_gaps")
    now = tick(df, shape.ts)
    stepped = neighbour(lay_out(df, shape, order), {"_t": now}).rows().where(F.col("_t").isNotNull())
    gap = elapsed(df, now, F.col("_t"), shape.ts)
    return stepped.select(*shape.index, *shape.tie, gap.alias("gap"))


def count_level_crossings(
    df: DataFrame, level: float, hysteresis: float = 0.0, edge: float = 0.0, shape: Shape = LONG
) -> DataFrame:
    """Running count of crossings of the band ``level ± hysteresis / 2``.

    ``edge`` > 0 counts rising, < 0 falling, 0 both. Values inside the band change nothing.
    """
    if hysteresis < 0:
        raise FrameError(f"hysteresis must not be negative, it is {hysteresis}")
    require_columns(df, shape.value)
    value = F.col(shape.value)
    high, low = F.lit(level + hysteresis / 2), F.lit(level - hysteresis / 2)
    states = df.withColumn("_state", F.when(value > high, 1).when(value < low, -1))
    known = running(lay_out(states, shape), {"_before": ("last", F.col("_state"))}, exclusive=True)
    rising = (F.col("_state") == 1) & (F.col("_before") == -1)
    falling = (F.col("_state") == -1) & (F.col("_before") == 1)
    wanted = rising if edge > 0 else falling if edge < 0 else rising | falling
    flagged = known.with_frame(known.df.withColumn("_hit", F.when(wanted, 1).otherwise(0).cast("bigint")))
    counted = running(flagged, {"crossings": ("sum", F.col("_hit"))}).rows()
    return narrowed(counted.select(*shape.index, *shape.tie, "crossings"), counted)


def fill_between(
    df: DataFrame, position: Column, method: str, both: bool, shape: Shape, limit: int | None = None,
    area: str | None = None, backward: bool = False,
) -> DataFrame:
    """Column ``filled``: the value, or an interpolation between the known neighbours.

    ``position`` is the axis of the linear formula. Behind the last known value that value is
    kept; before the first one it is used only with ``both``, or with ``backward`` instead of the former.
    ``limit`` fills so many rows from a known one on in that direction, ``area`` only the rows
    ``inside`` (between known ones) or ``outside``.
    """
    value = F.col(shape.value)
    placed = narrowed(df.withColumn("_p", position), df)
    blocks = lay_out(placed, shape)
    if limit is not None:
        blocks = number_rows(blocks)
    row = F.lit(0) if limit is None else F.col("_row")
    known = F.when(value.isNotNull(), F.struct(F.col("_p").alias("p"), value.alias("v"), row.alias("row")))
    sides = running(running(blocks, {"_a": ("last", known)}), {"_b": ("last", known)}, reverse=True).rows()
    a, b = F.col("_a"), F.col("_b")
    share = F.try_divide(F.col("_p") - a["p"], b["p"] - a["p"])
    between = {
        "linear": a["v"] + (b["v"] - a["v"]) * share,
        "ffill": a["v"],
        "bfill": b["v"],
        "nearest": F.when(F.col("_p") - a["p"] <= b["p"] - F.col("_p"), a["v"]).otherwise(b["v"]),
    }[method]
    if method == "ffill":
        edges = F.coalesce(a["v"], b["v"]) if both else a["v"]
    elif method == "bfill":
        edges = F.coalesce(b["v"], a["v"]) if both else b["v"]
    else:
        edges = F.when(a.isNotNull() & b.isNotNull(), between).when(a.isNotNull(), a["v"])
        edges = F.coalesce(edges, b["v"]) if both else edges
        if method == "nearest" and not both:
            edges = F.when(a.isNotNull() & b.isNotNull(), between)
    inner = a.isNotNull() & b.isNotNull()
    if backward and method not in ("ffill", "nearest"):
        edges = F.when(b.isNotNull(), F.when(a.isNotNull(), between).otherwise(b["v"]))
    if limit is not None:
        after, before = F.col("_row") - a["row"] <= limit, b["row"] - F.col("_row") <= limit
        near = F.coalesce(after, F.lit(False)) if not backward else F.lit(False)
        near = near | F.coalesce(before, F.lit(False)) if both or backward else near
        edges = F.when(near, edges)
    if area is not None:
        edges = F.when(inner if area == "inside" else ~inner, edges)
    return sides.withColumn("filled", F.coalesce(value, edges)).drop("_a", "_b", "_p", "_row")


# Accepted method names, the formula each one stands for, and whether it goes on beyond the ends.
INTERPOLATION_METHODS = {
    "time": "linear", "linear": "linear", "index": "linear", "values": "linear",
    "ffill": "ffill", "pad": "ffill", "bfill": "bfill", "backfill": "bfill", "nearest": "nearest",
}
CURVES = {"pchip": ("pchip", True), "akima": ("akima", False), "cubicspline": ("spline", True), "cubic": ("spline", False)}
INNER_METHODS = {"slinear": "linear", "zero": "ffill"}


def _on_curve(df: DataFrame, position: Column, kind: str, beyond: bool, shape: Shape) -> DataFrame:
    """Column ``filled``: the value, or that of the curve through the known points."""
    placed = df.withColumn("_p", position)
    points = placed.where(F.col(shape.value).isNotNull())
    known = unique_index(points.select(*shape.index, "_p", F.col(shape.value).alias("_v")), shape, ["_p", "_v"])
    curve = coefficients(known, kind, shape)
    rows = join_null_safe(placed, curve, shape.index, "left")
    value = F.col(shape.value)
    held = F.struct(F.col("_p").alias("p"), value.alias("v"), F.col("_s").alias("s"), F.col("_q").alias("q"), F.col("_k").alias("k"))
    here = F.when(value.isNotNull(), held)
    # Nothing is handed on from `df`: the join has moved its rows.
    sides = running(running(lay_out(rows, shape), {"_a": ("last", here)}), {"_b": ("last", here)}, reverse=True).rows()
    a, b = F.col("_a"), F.col("_b")

    def at(point: Column) -> Column:
        x = (F.col("_p") - point["p"]).cast("double")
        return point["v"] + x * (point["s"] + x * (point["q"] + x * point["k"]))

    outside = F.when(a.isNotNull(), at(a)).otherwise(at(b)) if beyond else F.lit(None).cast("double")
    found = F.when(a.isNotNull() & b.isNotNull(), at(a)).otherwise(outside)
    return sides.withColumn("filled", F.coalesce(value, found)).drop("_s", "_q", "_k")


def _kept(filled: DataFrame, direction: str, limit: int | None, area: str | None, shape: Shape) -> DataFrame:
    """The filled values that direction, limit and area allow."""
    a, b = F.col("_a").isNotNull(), F.col("_b").isNotNull()
    allowed = {"forward": a, "backward": b, "both": F.lit(True)}[direction]
    if limit is not None:
        numbered = number_rows(lay_out(filled, shape))
        known = F.when(F.col(shape.value).isNotNull(), F.col("_row"))
        near = running(running(numbered, {"_last": ("last", known)}), {"_next": ("last", known)}, reverse=True).rows()
        filled = near
        after = F.coalesce(F.col("_row") - F.col("_last") <= limit, F.lit(False))
        before = F.coalesce(F.col("_next") - F.col("_row") <= limit, F.lit(False))
        allowed = allowed & {"forward": after, "backward": before, "both": after | before}[direction]
    if area is not None:
        allowed = allowed & ((a & b) if area == "inside" else ~(a & b))
    kept = F.when(F.col(shape.value).isNotNull() | allowed, F.col("filled"))
    return filled.withColumn("filled", kept)


def interpolate(
    df: DataFrame, flags: DataFrame, method: str = "time", limit_direction: str | None = None,
    shape: Shape = LONG, flag: str = "value", limit: int | None = None, limit_area: str | None = None, order: int | None = None,
) -> dict[str, DataFrame]:
    """Recompute the flagged positions (also new timestamps) from the remaining points.

    ``limit_direction`` is ``forward``, ``backward`` or ``both``; the default is ``backward`` for
    backward filling and else ``forward``. ``limit`` is the number of consecutive positions that are filled
    from a known one on, ``limit_area`` keeps to those ``inside`` or ``outside`` the known points.

    Besides lines and neighbours there are curves: ``pchip`` and ``cubicspline``, which go on beyond the ends,
    ``akima`` and ``cubic`` (also ``polynomial`` with ``order=3``), which like ``slinear`` and ``zero`` fill between known
    points only. Curves need every index once; a series with one known point has none.
    """
    if method == "polynomial" and order in (1, 3):
        method = "slinear" if order == 1 else "cubic"
    if method not in INTERPOLATION_METHODS and method not in CURVES and method not in INNER_METHODS:
        raise FrameError(f"method {method!r} is not supported" + (f" with order {order}" if order else ""))
    if method in INNER_METHODS:
        limit_area = limit_area or "inside"
    kind = INTERPOLATION_METHODS.get(method) or INNER_METHODS.get(method)
    direction = limit_direction or ("backward" if kind == "bfill" else "forward")
    if direction not in ("forward", "backward", "both") or limit_area not in (None, "inside", "outside"):
        raise FrameError(f"limit direction {direction!r} or area {limit_area!r} is unknown")
    if limit is not None and limit < 1:
        raise FrameError("limit must be positive")
    marks = flags.groupBy(*shape.index).agg(F.max(F.col(flag).cast("boolean")).alias("_flag"))
    union = join_null_safe(df.select(*shape.index, shape.value), marks, shape.index, "full")
    flagged = F.coalesce(F.col("_flag"), F.lit(False))
    blanked = union.withColumn("_flag", flagged).withColumn(shape.value, F.when(~flagged, F.col(shape.value)))
    position = tick(df, shape.ts)
    if method in CURVES:
        shape = Shape(shape.keys, shape.ts, shape.value)
        on_curve = _on_curve(blanked, position, *CURVES[method], shape)
        filled = _kept(on_curve, direction, limit, limit_area, shape)
    else:
        filled = fill_between(blanked, position.cast("double"), kind, direction == "both", shape, limit, limit_area, direction == "backward")
    full = filled.select(*shape.index, F.col("filled").alias(shape.value), "_flag")
    return {"interpolated": full.drop("_flag"), "new_values": full.where("_flag").drop("_flag")}


def timeshifted_table(df: DataFrame, freq: str, periods: int, shape: Shape = LONG) -> DataFrame:
    """Columns ``shifted_<k>_times_<freq>`` with copies of the series moved by k steps.

    The rows are those of the first copy; the others are matched to it by index.
    """
    if periods == 0:
        raise FrameError("periods must not be 0")
    step = parse_duration(freq)
    sign = 1 if periods > 0 else -1
    counts = [sign * k for k in range(1, abs(periods) + 1)]
    moved = unique_index(df, shape, [shape.value]).select(
        *shape.keys,
        tick(df, shape.ts).alias("_t"),
        F.col(shape.value).alias("_v"),
        F.explode(F.array(*[F.lit(k).cast("bigint") for k in counts])).alias("_k"),
    ).withColumn("_t", F.col("_t") + F.col("_k") * F.lit(step))
    cells = moved.groupBy(*shape.keys, "_t").agg(
        F.max(F.col("_k") == counts[0]).alias("_own"),
        *[F.max(F.when(F.col("_k") == k, F.col("_v"))).alias(f"shifted_{k}_times_{freq}") for k in counts],
    )
    names = [f"shifted_{k}_times_{freq}" for k in counts]
    return cells.where("_own").select(*shape.keys, from_micros(F.col("_t")).alias(shape.ts), *names)


def merge_distributing_duplicates(df: DataFrame, max_delta: str, shape: Shape = LONG) -> DataFrame:
    """One series from all rows in which equal timestamps are spread towards the next one.

    The k-th of m rows at a timestamp moves by ``k/m`` of the distance to the next distinct
    timestamp, at most of ``max_delta``.
    """
    limit = positive_duration(max_delta)
    merged = Shape((), "_t", shape.value, (*shape.tie, *shape.keys))
    ticked = df.withColumn("_t", tick(df, shape.ts))
    blocks = number_rows(lay_out(ticked, merged))
    before, after = {"_before": F.col("_t")}, {"_after": F.col("_t")}
    near = neighbour(neighbour(blocks, before), after, reverse=True)
    # The first and last row of a timestamp and the next timestamp, carried over the blocks from both sides.
    begins = F.col("_before").isNull() | (F.col("_before") != F.col("_t"))
    ends = F.col("_after").isNull() | (F.col("_after") != F.col("_t"))
    last = F.when(ends, F.struct(F.col("_row").alias("row"), F.col("_after").alias("next")))
    counted = running(near, {"_first": ("last", F.when(begins, F.col("_row")))})
    rows = running(counted, {"_last": ("last", last)}, reverse=True).rows()
    span = F.least(F.col("_last.next") - F.col("_t"), F.lit(limit))
    k, m = F.col("_row") - F.col("_first"), F.col("_last.row") - F.col("_first") + 1
    return rows.withColumn(shape.ts, from_micros(F.col("_t") + F.floor(k * span / m))).select(shape.ts, *shape.tie, shape.value)


def sort_by_index(df: DataFrame, shape: Shape = LONG, within_partitions: bool = False) -> DataFrame:
    """Global order by keys and index, or the cheaper order inside each partition."""
    columns = [*shape.keys, *shape.order]
    return df.sortWithinPartitions(*columns) if within_partitions else df.orderBy(*columns)
