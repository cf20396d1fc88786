"""Gaps in series: where data is missing, and where replacements belong.

Interval frames have the columns of :data:`INTERVAL` beside the series keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.frames import LONG, FrameError, Shape, get_attributes, require_columns, tick
from tidewell.functions.durations import from_micros, parse_duration, positive_duration
from tidewell.operators.filters import parse_instant
from tidewell.plans.blocks import Blocks, grid, join_null_safe, join_per_series, lay_out, neighbour, pin, running, settle
from tidewell.plans.ranks import quantiles

INTERVAL = ("start_time", "end_time", "start_inclusive", "end_inclusive")


def constrict_series(df: DataFrame, start=None, end=None, shape: Shape = LONG) -> DataFrame:
    """Rows inside the closed processing range; either end may be missing."""
    low, high = parse_instant(start), parse_instant(end)
    if low is not None:
        df = df.where(F.col(shape.ts) >= F.lit(low))
    if high is not None:
        df = df.where(F.col(shape.ts) <= F.lit(high))
    return df


def add_bounds(df: DataFrame, start=None, end=None, shape: Shape = LONG, keys: DataFrame | None = None) -> DataFrame:
    """The ends of the processing range as points without a value, where a series has none there.

    The bounds of a series come from a count per series, so series without rows get them only
    when listed in ``keys``.
    """
    bounds = [m for m in (parse_instant(start), parse_instant(end)) if m is not None]
    rows = df.select(*shape.index, shape.value)
    if not bounds:
        return rows
    hits = [F.max(F.when(F.col(shape.ts) == F.lit(m), True)).alias(f"_hit{i}") for i, m in enumerate(bounds)]
    present = df.groupBy(*shape.keys).agg(*hits)
    if keys is not None and shape.keys:
        present = keys.select(*shape.keys).distinct().transform(join_null_safe, present, shape.keys, "left")
    wanted = F.array(*[F.when(F.col(f"_hit{i}").isNull(), F.lit(m)) for i, m in enumerate(bounds)])
    missing = present.select(*shape.keys, F.explode(F.array_distinct(F.array_compact(wanted))).alias(shape.ts))
    blank = F.lit(None).cast(df.schema[shape.value].dataType)
    return rows.unionByName(missing.withColumn(shape.value, blank).select(*shape.index, shape.value))


def _steps(df: DataFrame, shape: Shape) -> tuple[DataFrame, bool]:
    """Neighbouring points with their values and distance, and whether each series fits one block."""
    now, value = tick(df, shape.ts), F.col(shape.value)
    blocks = lay_out(df, shape)
    stepped = neighbour(blocks, {"_before": now, "_left": value}).rows().where(F.col("_before").isNotNull())
    distance = (now - F.col("_before")).alias("_distance")
    rows = stepped.select(*shape.keys, "_before", now.alias("_now"), distance, "_left", value.alias("_right"))
    return rows, not blocks.split


def expected_frequency(df: DataFrame, percentile: float = 0.5, min_points: int = 0, shape: Shape = LONG) -> DataFrame:
    """Nearest-rank quantile of the index distances per series, in microseconds.

    Series with fewer than ``min_points`` points stop the job.
    """
    if not 0 < percentile <= 1:
        raise FrameError("the percentile must be in (0, 1]")
    rows, small = _steps(df, shape)
    found = quantiles(rows, shape.keys, "_distance", [percentile], nearest=True, small=small)
    enough = F.when(F.col("n") + 1 >= F.lit(min_points), F.col("quantiles")[0]).otherwise(
        F.raise_error(F.lit(f"fewer than {min_points} data points")).cast("double")
    )
    return found.select(*shape.keys, enough.cast("bigint").alias("frequency"))


def _with_frequency(rows: DataFrame, frequency: int | DataFrame, shape: Shape) -> DataFrame:
    if not isinstance(frequency, DataFrame):
        return rows.withColumn("frequency", F.lit(frequency))
    return join_per_series(rows, frequency, shape.keys)


def _normalised_steps(df: DataFrame, frequency: int | DataFrame, shape: Shape) -> DataFrame:
    rows = _with_frequency(_steps(df, shape)[0], frequency, shape)
    return rows.select(
        *shape.keys,
        from_micros(F.col("_before")).alias("start_time"),
        from_micros(F.col("_now")).alias("end_time"),
        (F.col("_distance") / F.col("frequency")).alias("normalised"),
        F.lit(False).alias("start_inclusive"),
        F.lit(False).alias("end_inclusive"),
        F.col("_left").alias("value_to_left"),
        F.col("_right").alias("value_to_right"),
    )


def normalised_distances(df: DataFrame, frequency: int | DataFrame, shape: Shape = LONG) -> DataFrame:
    """Distance of each point to the one before, as a multiple of the expected frequency."""
    return _normalised_steps(df, frequency, shape).select(*shape.keys, "start_time", "end_time", "normalised")


def _wide_steps(df: DataFrame, frequency: int | DataFrame, factor: float, shape: Shape) -> DataFrame:
    return _normalised_steps(df, frequency, shape).where(F.col("normalised") > F.lit(float(factor)))


def wide_gaps(df: DataFrame, frequency: int | DataFrame, factor: float = 1.0, shape: Shape = LONG) -> DataFrame:
    """Open intervals between neighbouring points further apart than ``factor`` times the frequency."""
    return _wide_steps(df, frequency, factor, shape).select(*shape.keys, *INTERVAL)


def rhythm_floor(at: Column, frequency: Column, offset: Column) -> Column:
    """Last point ``offset + k * frequency`` not after ``at`` (all in microseconds)."""
    return at - F.pmod(at - offset, frequency)


def rhythm_ceil(at: Column, frequency: Column, offset: Column) -> Column:
    """First point ``offset + k * frequency`` not before ``at``."""
    return at + F.pmod(offset - at, frequency)


def points_to_intervals(points: DataFrame, shape: Shape = LONG) -> DataFrame:
    """Each timestamp as a closed interval of length zero."""
    closed = F.lit(True)
    return points.select(
        *shape.keys, F.col(shape.ts).alias("start_time"), F.col(shape.ts).alias("end_time"),
        closed.alias("start_inclusive"), closed.alias("end_inclusive"),
    )


def missing_rhythm_points(
    df: DataFrame, frequency: int, offset: int = 0, start=None, end=None, shape: Shape = LONG,
    keys: DataFrame | None = None,
) -> DataFrame:
    """Expected points ``offset + k * frequency`` of the range without a data point, as intervals.

    A missing range end is taken from the first or last point of the series. Series listed in
    ``keys`` are looked at even if they have no point in the range.
    """
    at = tick(df, shape.ts)
    step, shift = F.lit(frequency), F.lit(offset)
    low, high = parse_instant(start), parse_instant(end)
    ends = df.groupBy(*shape.keys).agg(F.min(at).alias("_first"), F.max(at).alias("_last"))
    if keys is not None and shape.keys:
        ends = keys.select(*shape.keys).distinct().transform(join_null_safe, ends, shape.keys, "left")
    if low is not None:
        ends = ends.withColumn("_first", F.unix_micros(F.lit(low)))
    if high is not None:
        ends = ends.withColumn("_last", F.unix_micros(F.lit(high)))
    bounds = ends.select(
        *shape.keys,
        rhythm_ceil(F.col("_first"), step, shift).alias("_low"),
        rhythm_floor(F.col("_last"), step, shift).alias("_high"),
    )
    expected = grid(bounds, shape.keys, "_low", "_high", frequency, "_at").select(
        *shape.keys, from_micros(F.col("_at")).alias(shape.ts)
    )
    return points_to_intervals(join_null_safe(expected, df.select(*shape.index), shape.index, "left_anti"), shape)


def constrict_intervals(intervals: DataFrame, start=None, end=None) -> DataFrame:
    """Clip intervals to the processing range; a clipped end becomes inclusive, empty ones drop out."""
    require_columns(intervals, *INTERVAL)
    low, high = parse_instant(start), parse_instant(end)
    if low is not None:
        cut = F.col("start_time") < F.lit(low)
        beyond = (F.col("end_time") < F.lit(low)) | ((F.col("end_time") == F.lit(low)) & ~F.col("end_inclusive"))
        intervals = intervals.where(~beyond).withColumns(
            {
                "start_inclusive": F.when(cut, True).otherwise(F.col("start_inclusive")),
                "start_time": F.greatest(F.col("start_time"), F.lit(low)),
            }
        )
    if high is not None:
        cut = F.col("end_time") > F.lit(high)
        beyond = (F.col("start_time") > F.lit(high)) | ((F.col("start_time") == F.lit(high)) & ~F.col("start_inclusive"))
        intervals = intervals.where(~beyond).withColumns(
            {
                "end_inclusive": F.when(cut, True).otherwise(F.col("end_inclusive")),
                "end_time": F.least(F.col("end_time"), F.lit(high)),
            }
        )
    return intervals


def merge_intervals(intervals: DataFrame, keys: tuple[str, ...] = ("metric",)) -> DataFrame:
    """Union of overlapping intervals; touching ones merge if one of the touching ends is inclusive.

    Sweep: an interval opens a new island if it starts behind the furthest end seen before it.
    An end is one number, twice its tick plus one if inclusive; a start is twice its tick, plus
    one if exclusive, so "touching" is a plain comparison.
    """
    require_columns(intervals, *keys, *INTERVAL)
    start, end = F.unix_micros("start_time"), F.unix_micros("end_time")
    coded = intervals.select(
        *keys,
        start.alias("_at"),
        (start * 2 + F.when(F.col("start_inclusive"), 0).otherwise(1)).alias("_open"),
        (end * 2 + F.when(F.col("end_inclusive"), 1).otherwise(0)).alias("_close"),
    )
    shape = Shape(tuple(keys), "_at", "_open", ("_open",))
    order = ("_at", "_open", "_close")
    reach = running(lay_out(coded, shape, order), {"_reach": ("max", F.col("_close"))}, exclusive=True)
    fresh = F.when(F.col("_reach").isNull() | (F.col("_open") > F.col("_reach")), 1).otherwise(0).cast("bigint")
    islands = running(reach.with_frame(reach.df.withColumn("_fresh", fresh)), {"_island": ("sum", F.col("_fresh"))})
    merged = islands.rows().groupBy(*keys, "_island").agg(F.min("_open").alias("_open"), F.max("_close").alias("_close"))
    return merged.select(
        *keys,
        from_micros(F.floor(F.col("_open") / 2)).alias("start_time"),
        from_micros(F.floor(F.col("_close") / 2)).alias("end_time"),
        (F.pmod(F.col("_open"), F.lit(2)) == 0).alias("start_inclusive"),
        (F.pmod(F.col("_close"), F.lit(2)) == 1).alias("end_inclusive"),
    )


def boundary_values(df: DataFrame, intervals: DataFrame, shape: Shape = LONG) -> DataFrame:
    """Last value before each interval and first value after it, as ``value_to_left`` and ``value_to_right``.

    A point on an inclusive bound belongs to the interval and is not looked at; a point on an
    exclusive bound is the neighbour. Points and bounds are ordered together, a bound before or
    behind the points of its timestamp, and the neighbours are running last values.
    """
    keys = list(shape.keys)
    points = df.select(*keys, (tick(df, shape.ts) * 4 + 1).alias("_at"), F.col(shape.value).cast("double").alias("_v"))
    points = points.withColumns({"_id": F.lit(None).cast("string"), "_side": F.lit(None).cast("string")})
    name = F.concat_ws("/", F.unix_micros("start_time"), F.unix_micros("end_time"), "start_inclusive", "end_inclusive")
    start = F.unix_micros("start_time") * 4 + F.when(F.col("start_inclusive"), 0).otherwise(2)
    end = F.unix_micros("end_time") * 4 + F.when(F.col("end_inclusive"), 2).otherwise(0)
    none = F.lit(None).cast("double")
    bounds = intervals.select(
        *keys, name.alias("_id"), F.explode(F.array(
            F.struct(start.alias("_at"), F.lit("left").alias("_side")), F.struct(end.alias("_at"), F.lit("right").alias("_side")),
        )).alias("_b"),
    ).select(*keys, F.col("_b._at"), none.alias("_v"), "_id", F.col("_b._side"))
    both = points.unionByName(bounds)
    known = F.when(F.col("_side").isNull(), F.struct(F.col("_v").alias("v")))
    placed = Shape(shape.keys, "_at", "_v", ("_id", "_side"))
    blocks = lay_out(both, placed)
    around: Blocks = running(running(blocks, {"_left": ("last", known)}), {"_right": ("last", known)}, reverse=True)
    probes = around.rows().where(F.col("_side").isNotNull())
    sides = probes.groupBy(*keys, "_id").agg(
        F.max(F.when(F.col("_side") == "left", F.col("_left.v"))).alias("value_to_left"),
        F.max(F.when(F.col("_side") == "right", F.col("_right.v"))).alias("value_to_right"),
    )
    return join_null_safe(intervals.withColumn("_id", name), sides, [*keys, "_id"], "left").drop("_id")


def gap_info(df: DataFrame, intervals: DataFrame, shape: Shape = LONG) -> DataFrame:
    """Merged intervals with size in seconds, the values beside them and their mean."""
    return _described(boundary_values(df, pin(merge_intervals(intervals, shape.keys)), shape), shape)


def _described(gaps: DataFrame, shape: Shape) -> DataFrame:
    size = (F.unix_micros("end_time") - F.unix_micros("start_time")) / F.lit(1e6)
    left, right = F.col("value_to_left").cast("double"), F.col("value_to_right").cast("double")
    return gaps.select(
        *shape.keys, *INTERVAL, size.alias("gap_size_in_seconds"), left.alias("value_to_left"),
        right.alias("value_to_right"), ((left + right) / 2).alias("mean_left_right"),
    )


def _range_of(df: DataFrame, start, end, shape: Shape) -> tuple:
    attrs = get_attributes(df, shape.ts)
    start = start or attrs.get("ref_interval_start_timestamp") or attrs.get("from")
    end = end or attrs.get("ref_interval_end_timestamp") or attrs.get("to")
    low, high = parse_instant(start), parse_instant(end)
    if low is not None and high is not None and low > high:
        raise FrameError(f"the range starts at {start} after its end {end}")
    return low, high


def detect_gaps(
    df: DataFrame,
    start: str | None = None,
    end: str | None = None,
    auto_frequency: bool = True,
    percentile: float = 0.5,
    min_points: int = 11,
    frequency: str | None = None,
    factor: float = 1.0,
    offset: str | None = None,
    gap_timestamps: DataFrame | None = None,
    gap_intervals: DataFrame | None = None,
    only_external: bool = False,
    shape: Shape = LONG,
) -> tuple[DataFrame, int | DataFrame | None]:
    """Gaps of every series and the frequency used (microseconds, or a frame with one per series).

    Gaps are distances wider than ``factor`` times the frequency, missing points of the rhythm
    if an offset is given, and externally given points and intervals, merged into one list.
    """
    attrs = get_attributes(df, shape.ts)
    low, high = _range_of(df, start, end, shape)
    if frequency is None and "ref_data_frequency" in attrs:
        frequency, auto_frequency = attrs["ref_data_frequency"], False
    if offset is None and "ref_data_frequency_offset" in attrs:
        offset, auto_frequency = attrs["ref_data_frequency_offset"], False
    if factor <= 0:
        raise FrameError("the allowed variance factor must be positive")
    if not only_external and auto_frequency == (frequency is not None):
        raise FrameError("give a frequency or let it be determined, not both")
    if offset is not None and frequency is None:
        raise FrameError("an offset needs a frequency")

    bare = constrict_series(df, low, high, shape)
    series = df if low is not None or high is not None else None
    bounded = add_bounds(bare, low, high, shape, series)
    used: int | DataFrame | None = None
    if not only_external:
        used = positive_duration(frequency) if not auto_frequency else None
        if auto_frequency:
            used = settle(expected_frequency(bounded, percentile, min_points, shape))
        if offset is None and gap_timestamps is None and gap_intervals is None:
            # Gaps between neighbours do not overlap, and the neighbours are the values beside them.
            return _described(_wide_steps(bounded, used, factor, shape), shape), used
    parts: list[DataFrame] = []
    if used is not None:
        parts.append(wide_gaps(bounded, used, factor, shape))
        if offset is not None:
            parts.append(missing_rhythm_points(bare, used, parse_duration(offset), low, high, shape, series))
    if gap_timestamps is not None:
        parts.append(points_to_intervals(constrict_series(gap_timestamps, low, high, shape), shape))
    if gap_intervals is not None:
        parts.append(constrict_intervals(gap_intervals.select(*shape.keys, *INTERVAL), low, high))
    if not parts:
        raise FrameError("nothing to detect gaps from")
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    # The intervals are used several times from here on and are few beside the rows.
    return gap_info(bounded, pin(found), shape), used


def default_offset(df: DataFrame, frequency: int, start=None, shape: Shape = LONG) -> DataFrame:
    """Phase of the rhythm per series: first point (else range start) modulo the frequency."""
    low = parse_instant(start)
    first = F.min(tick(df, shape.ts))
    if low is not None:
        first = F.coalesce(first, F.unix_micros(F.lit(low)))
    return df.groupBy(*shape.keys).agg(F.pmod(first, F.lit(frequency)).alias("offset"))


def rhythm_points(
    intervals: DataFrame, frequency: int | DataFrame, offset: int | DataFrame | None, all_gap_points: bool = True,
    shape: Shape = LONG,
) -> DataFrame:
    """Points of the rhythm inside each interval, honouring open and closed ends.

    Without an offset every interval starts its own rhythm. Intervals of length zero are kept
    as they are with ``all_gap_points``.
    """
    keys = list(shape.keys)
    rows = _with_frequency(intervals.select(*keys, *INTERVAL), frequency, shape)
    low, high = F.unix_micros("start_time"), F.unix_micros("end_time")
    if isinstance(offset, DataFrame):
        rows = join_per_series(rows, offset, keys, "left")
        rows = rows.withColumn("offset", F.coalesce("offset", low))
    else:
        rows = rows.withColumn("offset", low if offset is None else F.lit(offset))
    single = (low == high) & F.lit(all_gap_points)
    first = F.when(single, low).otherwise(rhythm_ceil(low, F.col("frequency"), F.col("offset")))
    last = F.when(single, high).otherwise(rhythm_floor(high, F.col("frequency"), F.col("offset")))
    steps = rows.withColumns({"_single": single, "_from": low, "_to": high, "_first": first, "_last": last}).withColumns(
        {"_zero": F.lit(0).cast("bigint"), "_steps": F.floor((F.col("_last") - F.col("_first")) / F.col("frequency"))}
    )
    numbered = grid(steps, (*keys, "start_time"), "_zero", "_steps", 1, "_k")
    at = F.col("_first") + F.col("_k") * F.col("frequency")
    held = (
        F.col("_single")
        | ((at > F.col("_from")) | F.col("start_inclusive")) & ((at < F.col("_to")) | F.col("end_inclusive"))
    )
    return numbered.where(held).select(*keys, from_micros(at).alias(shape.ts))


def replacement_locations(
    intervals: DataFrame,
    df: DataFrame | None = None,
    start: str | None = None,
    end: str | None = None,
    auto_frequency: bool = False,
    percentile: float = 0.5,
    min_points: int = 11,
    frequency: str | None = None,
    offset: str | None = None,
    all_gap_points: bool = True,
    shape: Shape = LONG,
) -> DataFrame:
    """Timestamps at which the gaps need values, without values."""
    low, high = parse_instant(start), parse_instant(end)
    if df is not None:
        attrs = get_attributes(df, shape.ts)
        low, high = _range_of(df, start, end, shape)
        if frequency is None and "ref_data_frequency" in attrs:
            frequency, auto_frequency = attrs["ref_data_frequency"], False
        offset = offset or attrs.get("ref_data_frequency_offset")
    if auto_frequency == (frequency is not None) or (auto_frequency and df is None):
        raise FrameError("give a frequency, or a series to determine it from")
    bare = None if df is None else constrict_series(df, low, high, shape)
    used: int | DataFrame
    if auto_frequency:
        used = settle(expected_frequency(add_bounds(bare, low, high, shape), percentile, min_points, shape))
    else:
        used = positive_duration(frequency)
    phase: int | DataFrame | None = None
    if offset is not None:
        phase = parse_duration(offset)
    elif bare is not None:
        # Any point of the rhythm serves as its phase.
        phase = bare.groupBy(*shape.keys).agg(F.min(tick(bare, shape.ts)).alias("offset"))
    elif low is not None:
        phase = int(low.timestamp() * 1_000_000)
    merged = merge_intervals(constrict_intervals(intervals, low, high), shape.keys)
    points = rhythm_points(merged, used, phase, all_gap_points, shape)
    return points.withColumn(shape.value, F.lit(None).cast("double"))
