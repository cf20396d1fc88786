"""Regular grids: resampling, interpolation onto a grid, moving the index."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewell.frames import LONG, FrameError, Shape, is_time, tick, value_columns
from tidewell.functions.durations import (
    UNIT_MICROS,
    Calendar,
    add_frequency,
    from_micros,
    parse_duration,
    parse_frequency,
    positive_duration,
)
from tidewell.operators.joins import duplicate_message, unique_index
from tidewell.operators.windows import fill_between
from tidewell.plans.blocks import (
    BLOCK, GRID_CHUNK, Blocks, grid, grid_facts, join_null_safe, join_per_series, lay_out, narrowed, neighbour, row_frames, running,
    series_bounds, with_facts,
)

DAY = UNIT_MICROS["D"]


def _need_time(df: DataFrame, shape: Shape) -> None:
    if not is_time(df, shape.ts):
        raise FrameError("the index must be a timestamp")


def _bin_bounds(df: DataFrame, step: int, shape: Shape) -> DataFrame:
    """First and last bin of each series in microseconds, counted from midnight of its first day."""
    bounds = series_bounds(df, shape)
    width = F.lit(step).cast("bigint")
    origin = F.lit(0).cast("bigint") if DAY % step == 0 else F.floor(F.col("_low") / F.lit(DAY)) * F.lit(DAY)
    placed = bounds.withColumn("_origin", origin)

    def bin_of(c: str) -> Column:
        return F.col("_origin") + F.floor((F.col(c) - F.col("_origin")) / width) * width

    return placed.withColumns({"_low": bin_of("_low"), "_high": bin_of("_high")})


def _with_bins(df: DataFrame, bounds: DataFrame, step: int, shape: Shape) -> DataFrame:
    """Column ``_bin``: start of the bin of each row in microseconds."""
    at = tick(df, shape.ts)
    if DAY % step == 0:
        return df.withColumn("_bin", F.floor(at / F.lit(step)) * F.lit(step).cast("bigint"))
    joined = join_per_series(df, bounds.select(*shape.keys, "_origin"), shape.keys)
    origin = F.col("_origin")
    return joined.withColumn("_bin", origin + F.floor((at - origin) / F.lit(step)) * F.lit(step)).drop("_origin")


def resample(df: DataFrame, freq: str, how: str = "mean", shape: Shape = LONG, columns: list[str] | None = None) -> DataFrame:
    """Bins closed and labelled on the left, empty bins kept as missing.

    Calendar frequencies give one bin per month, quarter or year, labelled at its first or last
    day. ``how`` is ``mean`` or ``first`` (the first known value of the bin in time order).
    """
    _need_time(df, shape)
    columns = columns or [shape.value]
    frequency = parse_frequency(freq)

    def fold(column: str) -> Column:
        if how == "mean":
            return F.avg(column).alias(column)
        if how == "first":
            place = F.struct(*[F.col(c) for c in shape.order])
            return F.min_by(column, F.when(F.col(column).isNotNull(), place)).alias(column)
        raise FrameError(f"unknown statistic {how!r}")

    if isinstance(frequency, Calendar):
        return _resample_calendar(df, frequency, [fold(c) for c in columns], shape)
    if frequency <= 0:
        raise FrameError(f"frequency {freq!r} must be positive")
    bounds = _bin_bounds(df, frequency, shape)
    bins = _with_bins(df, bounds, frequency, shape).groupBy(*shape.keys, "_bin").agg(*[fold(c) for c in columns])
    points = grid(bounds, shape.keys, "_low", "_high", frequency, "_bin").select(*shape.keys, "_bin")
    filled = join_null_safe(points, bins, [*shape.keys, "_bin"], "left")
    result = filled.select(*shape.keys, from_micros(F.col("_bin")).alias(shape.ts), *columns)
    return with_facts(result, grid_facts(bounds, shape, "_low", "_high", frequency))


def _resample_calendar(df: DataFrame, frequency: Calendar, folds: list[Column], shape: Shape) -> DataFrame:
    """Bins of whole months counted from the period that holds the first point of the series."""
    months = abs(frequency.months)
    ts = F.col(shape.ts)
    number = F.year(ts) * 12 + F.month(ts) - 1
    unit = next(g for g in (12, 3, 1) if months % g == 0)
    periods = df.withColumn("_period", F.floor(number / F.lit(unit)))
    first = periods.groupBy(*shape.keys).agg(F.min("_period").alias("_first"))
    joined = join_per_series(periods, first, shape.keys)
    size = months // unit
    # Periods labelled at their end close there, so the first one is a bin of its own.
    shift = size - 1 if frequency.at_end else 0
    offset = F.col("_period") - F.col("_first")
    bins = joined.withColumn("_bin", F.floor((offset + shift) / F.lit(size))).groupBy(*shape.keys, "_first", "_bin").agg(*folds)
    last = bins.groupBy(*shape.keys, "_first").agg(F.max("_bin").alias("_last"))
    points = last.withColumn("_bin", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_last")))).drop("_last")
    filled = join_null_safe(points, bins, [*shape.keys, "_first", "_bin"], "left")
    period = F.col("_first") + F.col("_bin") * F.lit(size)
    start_month = (period * unit).cast("int")
    month_count = start_month + (unit - 1) if frequency.at_end else start_month
    day = F.make_date(F.floor(month_count / 12).cast("int"), (month_count % 12 + 1).cast("int"), F.lit(1))
    label = (F.last_day(day) if frequency.at_end else day).cast("timestamp")
    columns = [c for c in bins.columns if c not in (*shape.keys, "_first", "_bin")]
    return filled.select(*shape.keys, label.alias(shape.ts), *columns)


def _forward(df: DataFrame, shape: Shape) -> Blocks:
    """``_low``, the lowest index, and ``_next``, the index of the next row in a struct, NULL behind the last one.

    A duplicate index stops the job wherever ``_low`` is used: equal ones are neighbours here, so this needs no shuffle of
    its own. The first window takes a plain column, so that no made-up one is shuffled for it.
    """
    here, after = F.col(shape.ts), F.col("_next")
    rows = narrowed(df.select(*shape.index, shape.value), df)
    laid = lay_out(rows, shape)
    if laid.split:
        # A missing index comes first, as in the order.
        laid = laid.with_frame(laid.df.withColumn(BLOCK, F.when(here.isNull(), F.lit(-(2**63))).otherwise(F.col(BLOCK))))
    low = running(laid, {"_low": ("min", here)})
    ahead = neighbour(low, {"_next": F.struct(here.alias("at"))}, reverse=True, unique=True)
    twice = after.isNotNull() & after["at"].eqNullSafe(here)
    stop = F.raise_error(duplicate_message([here if c == shape.ts else F.col(c) for c in shape.index]))
    checked = F.when(twice, stop.cast(rows.schema[shape.ts].dataType)).otherwise(F.col("_low"))
    return ahead.with_frame(ahead.df.withColumn("_low", checked))


def _with_stretches(rows: DataFrame, after: Column, step: int, shape: Shape) -> DataFrame:
    """The numbers of the grid points from each row on and before the next one, whose index is ``after``.

    ``_hit`` says whether the row lies on the grid ``_low, _low + step, ...``; ``_from`` to ``_to`` are the points behind
    it. Fractional points are compared as numbers of the index, so a rounded quotient does no harm.
    """
    here, low = F.col(shape.ts), F.col("_low")
    if isinstance(rows.schema[shape.ts].dataType, T.IntegralType):
        width = F.lit(step).cast("bigint")
        behind, ahead = here.cast("bigint") - low, F.coalesce(after.cast("bigint") - 1, here) - low
        return rows.withColumns(
            {
                "_hit": F.coalesce(behind % width == 0, F.lit(False)),
                "_from": F.call_function("div", behind, width) + 1,
                "_to": F.call_function("div", ahead, width),
            }
        )

    def at_or_before(x: Column) -> Column:
        k = F.floor((x - low) / F.lit(step)).cast("bigint")
        return F.when(_point(k, step) > x, k - 1).when(_point(k + 1, step) <= x, k + 1).otherwise(k)

    last = at_or_before(here)
    end = at_or_before(after)
    before_next = F.when(_point(end, step) == after, end - 1).otherwise(end)
    beyond = F.floor((here - low) / F.lit(step)).cast("bigint")
    return rows.withColumns(
        {
            "_hit": F.coalesce(_point(last, step) == here, F.lit(False)),
            "_from": last + 1,
            "_to": F.when(after.isNull(), beyond).otherwise(before_next),
        }
    )


def _point(k: Column, step: int) -> Column:
    return F.col("_low") + k * F.lit(step)


def _numbers(first: Column, last: Column) -> Column:
    return F.when(last >= first, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))


def resample_numeric(df: DataFrame, d: int, shape: Shape = LONG) -> DataFrame:
    """Centred mean over ``d`` rows of the data joined with the grid ``first, first + d, ...``, read on the grid.

    Grid points with no row of the data in reach of their frame are missing. Points are made where they lie and take no
    part in the frames: a point's place among rows and points together says which rows near it are in reach.
    """
    if d < 1:
        raise FrameError("d must be positive")
    before, after = d // 2, (d - 1) // 2
    value, hit = F.col(shape.value), F.col("_hit")
    ahead = _forward(df, shape)
    placed = ahead.with_frame(_with_stretches(ahead.df, F.col("_next.at"), d, shape).drop("_next"))
    counted = running(placed, {"_place": ("sum", F.when(hit, 0).otherwise(1).cast("bigint"))})
    counted = counted.with_frame(counted.df.withColumn("_place", F.col("_place") + F.coalesce(F.col("_from"), F.lit(0))))
    member = F.when(value.isNotNull(), F.struct(F.col("_place").alias("place"), value.alias("value")))

    def make(over: WindowSpec) -> Column:
        return F.collect_list(member).over(over.rowsBetween(-before, after))

    framed = row_frames(counted, before, after, {"_around": make})
    start = F.when(hit, F.col("_from") - 1).otherwise(F.col("_from"))
    head = F.least(F.col("_to"), F.col("_from") + (before - 1))
    tail = F.greatest(head + 1, F.col("_to") - (after - 1))
    ends = {"_start": start, "_head": head, "_tail": tail}
    mean = _mean_of(df.select(shape.value))

    def at(k: Column) -> Column:
        place = F.col("_place") + (k - F.col("_from") + 1)
        return mean(F.col("_around"), lambda e: e["place"].between(place - before, place + after))

    rows = framed.withColumns(ends).where(F.col("_to") >= F.col("_start"))
    near = F.concat(_numbers(F.col("_start"), F.col("_head")), _numbers(F.col("_tail"), F.col("_to")))
    whole = F.col("_to") - F.col("_start") < GRID_CHUNK
    points = F.when(whole, F.sequence("_start", "_to")).otherwise(near)
    found = rows.withColumns({"_means": F.transform(near, at), "_points": points}).withColumn("_k", F.explode("_points"))
    k, means = F.col("_k"), F.col("_means")
    first = F.col("_head") - F.col("_start") + 1
    nearby = (
        F.when(k <= F.col("_head"), F.get(means, (k - F.col("_start")).cast("int")))
        .when(k >= F.col("_tail"), F.get(means, (first + k - F.col("_tail")).cast("int")))
    )
    made = found.select(*shape.keys, _point(k, d).alias(shape.ts), nearby.alias(shape.value))
    far = placed.rows().withColumns(ends).where(F.col("_to") - F.col("_start") >= GRID_CHUNK)
    inner = far.select(*shape.index, "_low", (F.col("_head") + 1).alias("_first"), (F.col("_tail") - 1).alias("_last"))
    missing = grid(inner, shape.index, "_first", "_last", 1, "_k").select(
        *shape.keys, _point(k, d).alias(shape.ts), F.lit(None).cast(made.schema[shape.value].dataType).alias(shape.value)
    )
    return made.unionByName(missing)


def _mean_of(values: DataFrame) -> Callable[[Column, Callable[[Column], Column]], Column]:
    """The mean of the members of an array that a condition holds for, added up in the types of Spark's own mean."""
    kind = values.schema[0].dataType
    mean = values.select(F.avg(values.columns[0])).schema[0].dataType
    total = T.DecimalType(min(38, kind.precision + 10), kind.scale) if isinstance(kind, T.DecimalType) else mean
    zero = F.struct(F.lit(0).cast(total).alias("sum"), F.lit(0).cast("bigint").alias("n"))

    def of(members: Column, holds: Callable[[Column], Column]) -> Column:
        def add(state: Column, e: Column) -> Column:
            more = F.struct((state["sum"] + e["value"].cast(total)).cast(total).alias("sum"), (state["n"] + 1).alias("n"))
            return F.when(holds(e), more).otherwise(state)

        return F.aggregate(members, zero, add, lambda state: F.try_divide(state["sum"], state["n"]).cast(mean))

    return of


def interpolate_on_grid(df: DataFrame, t: str, shape: Shape = LONG) -> DataFrame:
    """Values that lie exactly on the grid, linearly interpolated by position between them.

    Points off the grid are not used. Behind the last known value it is repeated, before the
    first one there is none.
    """
    _need_time(df, shape)
    step = positive_duration(t)
    data = unique_index(df, shape, [shape.value])
    bounds = _bin_bounds(df, step, shape)
    bins = _with_bins(data, bounds, step, shape)
    on_grid = bins.where(F.col("_bin") == tick(df, shape.ts)).select(*shape.keys, "_bin", shape.value)
    points = grid(bounds, shape.keys, "_low", "_high", step, "_bin").select(*shape.keys, "_bin")
    placed = join_null_safe(points, on_grid, [*shape.keys, "_bin"], "left").select(
        *shape.keys, from_micros(F.col("_bin")).alias(shape.ts), shape.value
    )
    placed = with_facts(placed, grid_facts(bounds, shape, "_low", "_high", step))
    filled = fill_between(placed, tick(placed, shape.ts).cast("double"), "linear", False, shape)
    return filled.select(*shape.index, F.col("filled").alias(shape.value))


def interpolate_on_numeric_grid(df: DataFrame, d: int, shape: Shape = LONG) -> DataFrame:
    """Linear interpolation by index value at ``first, first + d, ...`` up to the last index.

    The points between two known rows have the same neighbours, and are made with their values where they lie. Rows
    without a value matter only at the ends of a series.
    """
    if d < 1:
        raise FrameError("d must be positive")
    here, value = F.col(shape.ts), F.col(shape.value)
    known = F.when(value.isNotNull(), F.struct(here.cast("double").alias("p"), value.alias("v")))
    ahead = _forward(df, shape)
    ends = ahead.with_frame(ahead.df.where((F.col("_low") == here) | value.isNotNull() | F.col("_next").isNull()).drop("_next"))
    sides = neighbour(running(ends, {"_a": ("last", known)}), {"_b": known, "_after": here}, reverse=True, unique=True)
    rows = _with_stretches(sides.rows(), F.col("_after"), d, shape).drop("_after")
    stretches = rows.withColumn("_from", F.when(F.col("_hit"), F.col("_from") - 1).otherwise(F.col("_from"))).drop("_hit")
    points = _spread_points(stretches, shape).withColumn("_at", _point(F.col("_k"), d))
    a, b = F.col("_a"), F.col("_b")
    share = F.try_divide(F.col("_at").cast("double") - a["p"], b["p"] - a["p"])
    line = F.when(a.isNotNull() & b.isNotNull(), a["v"] + (b["v"] - a["v"]) * share).when(a.isNotNull(), a["v"])
    filled = F.coalesce(F.when(F.col("_at") == here, value), line)
    return points.select(*shape.keys, F.col("_at").alias(shape.ts), filled.alias(shape.value))


def _spread_points(stretches: DataFrame, shape: Shape) -> DataFrame:
    """Column ``_k``: the points ``_from`` to ``_to`` of each row. Stretches of up to a chunk of points stay in their task."""
    short = F.col("_to") - F.col("_from") < GRID_CHUNK
    here = stretches.where(short & (F.col("_to") >= F.col("_from"))).withColumn("_k", F.explode(F.sequence("_from", "_to")))
    dealt = grid(stretches.where(~short), shape.index, "_from", "_to", 1, "_k")
    return here.unionByName(dealt.select(*here.columns))


def shift_index(df: DataFrame, frequency: str, periods: int, shape: Shape = LONG) -> DataFrame:
    """Move every timestamp by a number of periods; calendar frequencies land on their anchors."""
    _need_time(df, shape)
    return df.withColumn(shape.ts, add_frequency(F.col(shape.ts), parse_frequency(frequency), periods))


def add_timedelta(df: DataFrame, timedelta: str, shape: Shape = LONG) -> DataFrame:
    """Add a duration, possibly negative, to every timestamp."""
    _need_time(df, shape)
    return df.withColumn(shape.ts, from_micros(tick(df, shape.ts) + F.lit(parse_duration(timedelta))))


def fixed_values(locations: DataFrame, value: float, shape: Shape = LONG) -> DataFrame:
    """A series of one constant at the given timestamps.

    The timestamps are the index; a value column of timestamps is accepted if it repeats them.
    """
    columns = value_columns(locations, shape)
    stamped = [c for c in columns if is_time(locations, c)]
    if not is_time(locations, shape.ts) if shape.ts in locations.columns else not stamped:
        raise FrameError("neither the index nor the values are timestamps")
    if shape.ts not in locations.columns:
        return locations.select(*shape.keys, F.col(stamped[0]).alias(shape.ts), F.lit(float(value)).alias(shape.value))
    rows = locations
    for c in stamped:
        message = F.lit(f"index {shape.ts} and values {c} differ")
        agree = F.when(F.col(c).eqNullSafe(F.col(shape.ts)), True).otherwise(F.raise_error(message).cast("boolean"))
        rows = rows.where(agree)
    return rows.select(*shape.index, F.lit(float(value)).alias(shape.value))
