"""Row filters, comparisons and range checks."""

from __future__ import annotations

import datetime as dt
import heapq
import operator
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewell.frames import LONG, FrameError, Shape, numeric_columns, require_columns, tick, value_columns
from tidewell.functions.expressions import to_column
from tidewell.operators.joins import align
from tidewell.plans.blocks import any_of, join_null_safe, join_per_series, lay_out, narrowed, number_rows

LITERAL_INTERVALS = 16

COMPARISONS: dict[str, tuple[Callable, bool]] = {
    "equality": (operator.eq, False),
    "inequality": (operator.ne, True),
    "greater": (operator.gt, False),
    "greater_or_equal": (operator.ge, False),
    "smaller": (operator.lt, False),
    "smaller_or_equal": (operator.le, False),
}


def compare(left: DataFrame, right: DataFrame | float | str | bool, kind: str, shape: Shape = LONG) -> DataFrame:
    """Compare a series with a scalar, or with a series aligned on the index.

    A missing side compares false, except for ``inequality`` where it compares true.
    """
    test, missing = COMPARISONS[kind]
    if isinstance(right, DataFrame):
        pairs = align(left, right, shape)
        return pairs.select(
            *shape.index, F.coalesce(test(F.col("left"), F.col("right")), F.lit(missing)).alias("result")
        )
    hit = F.coalesce(test(F.col(shape.value), F.lit(right)), F.lit(missing))
    return left.select(*shape.index, *shape.tie, hit.alias("result"))


def filter_by(data: DataFrame, mask: DataFrame, shape: Shape = LONG, flag: str = "value") -> DataFrame:
    """Rows whose index is flagged by ``mask``; a missing flag value counts as true, a missing row as false.

    Rows of one index are told apart by the tie-break of ``shape``. Rows of the mask with equal index and tie-break
    must agree; if their flags differ, the job stops.
    """
    place = [*dict.fromkeys((*shape.index, *shape.tie))]
    value = F.col(flag)
    keep = F.coalesce(value.cast("boolean"), F.lit(True))
    flags = mask.select(F.struct(*place).alias("_place"), keep.alias("_keep")).groupBy("_place")
    folded = flags.agg(F.min("_keep").alias("_all"), F.max("_keep").alias("_any"))
    named = F.concat_ws(" ", *[F.col(f"_place.`{c}`").cast("string") for c in place])
    message = F.concat(F.lit("duplicate index with different flags "), named)
    agreed = F.when(F.col("_all") == F.col("_any"), F.col("_any")).otherwise(F.raise_error(message).cast("boolean"))
    kept = folded.where(agreed).select(*[F.col(f"_place.`{c}`").alias(c) for c in place])
    return narrowed(join_null_safe(data, kept, place, "left_semi"), data)


def parse_instant(text: str | dt.datetime | None) -> dt.datetime | None:
    """ISO-8601 text as UTC; without an offset it is taken as UTC."""
    if text is None:
        return None
    moment = text if isinstance(text, dt.datetime) else dt.datetime.fromisoformat(text)
    return moment.replace(tzinfo=dt.timezone.utc) if moment.tzinfo is None else moment.astimezone(dt.timezone.utc)


def restrict_to_time_interval(
    df: DataFrame, start: str | None = None, stop: str | None = None, shape: Shape = LONG
) -> DataFrame:
    """Closed slice ``[start, stop]``; either bound may be missing. Reaches the scan as a pushed filter."""
    low, high = parse_instant(start), parse_instant(stop)
    if low is not None and high is not None and low > high:
        raise ValueError(f"start {start} is after stop {stop}")
    kept = df
    if low is not None:
        kept = kept.where(F.col(shape.ts) >= F.lit(low))
    if high is not None:
        kept = kept.where(F.col(shape.ts) <= F.lit(high))
    return narrowed(kept, df)


def cut_above(df: DataFrame, limit: float, shape: Shape = LONG, frame: bool = False) -> DataFrame:
    """Series: drop rows above the limit (and missing ones). Frame: blank the cells, keep the rows."""
    return _cut(df, lambda c: c <= F.lit(limit), shape, frame)


def cut_below(df: DataFrame, limit: float, shape: Shape = LONG, frame: bool = False) -> DataFrame:
    """Mirror image of :func:`cut_above`."""
    return _cut(df, lambda c: c >= F.lit(limit), shape, frame)


def _cut(df: DataFrame, keep: Callable[[Column], Column], shape: Shape, frame: bool) -> DataFrame:
    if not frame:
        return narrowed(df.where(keep(F.col(shape.value))), df)
    return narrowed(df.withColumns({c: F.when(keep(F.col(c)), F.col(c)) for c in numeric_columns(df, shape)}), df)


def drop_missing(df: DataFrame, shape: Shape = LONG) -> DataFrame:
    """Rows without a missing value in any value column."""
    return narrowed(df.na.drop("any", subset=value_columns(df, shape)), df)


def drop_duplicates(df: DataFrame, shape: Shape = LONG) -> DataFrame:
    """First occurrence of each value (row of values, for frames) inside a series.

    The first row is a minimum, so a value that a third of all rows share is folded on the map
    side and never gathered in one window.
    """
    values = value_columns(df, shape)
    place = F.struct(shape.ts, *shape.tie)
    first = df.groupBy(*shape.keys, *values).agg(F.min(place).alias("_first"))
    return first.select(
        *[F.col(c) if c in (*shape.keys, *values) else F.col(f"_first.{c}").alias(c) for c in df.columns]
    )


def eval_on_frame(df: DataFrame, expression: str, shape: Shape = LONG, syntax: str = "python") -> DataFrame:
    """Evaluate an expression over the columns of a frame, in Python's syntax or as ``sql``."""
    names = {c: F.col("`" + c.replace("`", "``") + "`") for c in df.columns}
    result = F.expr(expression) if syntax == "sql" else to_column(expression, names)
    return df.select(*shape.index, *shape.tie, result.alias("result"))


def eval_on_series(df: DataFrame, expression: str, shape: Shape = LONG, syntax: str = "python") -> DataFrame:
    """Evaluate an expression in which ``x`` stands for the value of the series."""
    named = df.withColumnRenamed(shape.value, "x")
    result = F.expr(expression) if syntax == "sql" else to_column(expression, {"x": F.col("x")})
    return named.select(*shape.index, *shape.tie, result.alias("result"))


def _checked_intervals(intervals: list[dict], corrected: bool = False) -> list[dict]:
    checked = []
    for pos, item in enumerate(intervals):
        start, end = parse_instant(item["start"]), parse_instant(item["end"])
        open_start = not item.get("start_inclusive", True)
        open_end = not item.get("end_inclusive", True)
        if end < start or ((open_start or open_end) and end == start):
            raise FrameError(f"time interval {pos} is empty: {item}")
        if corrected and item.get("correction_value") is None:
            raise FrameError(f"time interval {pos} has no correction value: {item}")
        checked.append({**item, "start": start, "end": end, "open_start": open_start, "open_end": open_end, "pos": pos})
    return checked


def _inside(at: Column, item: dict) -> Column:
    low = at > F.lit(item["start"]) if item["open_start"] else at >= F.lit(item["start"])
    high = at < F.lit(item["end"]) if item["open_end"] else at <= F.lit(item["end"])
    return low & high


def _micros(moment: dt.datetime) -> int:
    return (moment - dt.datetime(1970, 1, 1, tzinfo=dt.timezone.utc)) // dt.timedelta(microseconds=1)


def disjoint_pieces(intervals: list[tuple[int, int, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and ranks of pieces that do not overlap, in order: the highest rank wins wherever some meet.

    ``intervals`` are (first, last, rank) in whole ticks. A sweep over the starts keeps the open intervals in a
    queue by rank; an interval is taken out when it comes first and has ended. At most twice as many pieces.
    """
    waiting = sorted(i for i in intervals if i[0] <= i[1])
    borders = sorted({i[0] for i in waiting} | {i[1] + 1 for i in waiting})
    pieces: list[list[int]] = []
    queue: list[tuple[int, int]] = []
    at = 0
    for first, following in zip(borders, borders[1:], strict=False):
        while at < len(waiting) and waiting[at][0] == first:
            heapq.heappush(queue, (-waiting[at][2], waiting[at][1]))
            at += 1
        while queue and queue[0][1] < first:
            heapq.heappop(queue)
        if not queue:
            continue
        rank = -queue[0][0]
        if pieces and pieces[-1][1] == first - 1 and pieces[-1][2] == rank:
            pieces[-1][1] = following - 1
        else:
            pieces.append([first, following - 1, rank])
    table = np.array(pieces, dtype=np.int64).reshape(-1, 3)
    return table[:, 0], table[:, 1], table[:, 2]


def _match(df: DataFrame, intervals: list[dict], shape: Shape) -> DataFrame:
    """All rows with ``_pos``: the last interval around the index, NULL if there is none.

    Overlapping intervals become disjoint pieces once, and a row looks for its piece by binary search in
    Arrow batches: no shuffle, and one piece at most whatever the overlap. The pieces travel with the tasks, as
    the intervals are an argument and fit the driver.
    """
    ticks = [
        (_micros(i["start"]) + i["open_start"], _micros(i["end"]) - i["open_end"], i["pos"]) for i in intervals
    ]
    pieces = df.sparkSession.sparkContext.broadcast(disjoint_pieces(ticks))
    schema = T.StructType([*df.schema.fields, T.StructField("_pos", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts, ends, ranks = pieces.value
        for batch in batches:
            at = batch.column("_at")
            missing = at.is_null().to_numpy(zero_copy_only=False)
            ticks = at.fill_null(0).to_numpy()
            near = np.searchsorted(starts, ticks, side="right") - 1
            hit = (near >= 0) & ~missing
            hit &= ticks <= ends[np.maximum(near, 0)] if len(ends) else False
            found = np.where(hit, ranks[np.maximum(near, 0)] if len(ranks) else 0, 0)
            columns = [c for c, name in zip(batch.columns, batch.schema.names, strict=True) if name != "_at"]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(found, pa.int64(), mask=~hit)], schema.names)

    return df.withColumn("_at", tick(df, shape.ts)).mapInArrow(run, schema)


def select_time_intervals(df: DataFrame, intervals: list[dict], shape: Shape = LONG) -> DataFrame:
    """Boolean series: is the timestamp in any of the intervals (open or closed at each end).

    A missing timestamp is in none.
    """
    items = _checked_intervals(intervals)
    if len(items) <= LITERAL_INTERVALS:
        hit = any_of([_inside(F.col(shape.ts), i) for i in items])
        return df.select(*shape.index, *shape.tie, F.coalesce(hit, F.lit(False)).alias("result"))
    found = _match(df, items, shape)
    return found.select(*shape.index, *shape.tie, F.col("_pos").isNotNull().alias("result"))


def correct_time_intervals(df: DataFrame, intervals: list[dict], shape: Shape = LONG) -> DataFrame:
    """Replace values inside the intervals by their ``correction_value``; the last interval wins.

    Every interval needs the value; a missing timestamp keeps its own.
    """
    items = _checked_intervals(intervals, corrected=True)
    value = F.col(shape.value)
    if len(items) <= LITERAL_INTERVALS:
        for item in items:
            value = F.when(_inside(F.col(shape.ts), item), F.lit(float(item["correction_value"]))).otherwise(value)
        return df.withColumn(shape.value, value)
    found = _match(df, items, shape)
    corrections = df.sparkSession.sparkContext.broadcast(np.array([float(i["correction_value"]) for i in items]))
    schema = T.StructType([*found.schema.fields, T.StructField("_correction", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pos = batch.column("_pos")
            values = corrections.value[pos.fill_null(0).to_numpy()]
            made = pa.array(values, pa.float64(), mask=pos.is_null().to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([*batch.columns, made], schema.names)

    corrected = F.coalesce(F.col("_correction"), value)
    return found.mapInArrow(run, schema).withColumn(shape.value, corrected).select(*df.columns)


def thin_out(df: DataFrame, points: int, shape: Shape = LONG) -> DataFrame:
    """Every n-th row of each series so that about ``points`` remain; the first row always stays."""
    if points < 2:
        return df
    counts = df.groupBy(*shape.keys).agg(F.count(F.lit(1)).alias("_count"))
    n = F.bround((F.col("_count") - 1) / F.lit(points - 1)).cast("bigint")
    strides = counts.withColumn("_stride", F.when(F.col("_count") >= points, F.greatest(n, F.lit(1))).otherwise(F.lit(1)))
    numbered = number_rows(lay_out(df, shape)).rows()
    joined = join_per_series(numbered, strides, shape.keys)
    return joined.where((F.col("_row") - 1) % F.col("_stride") == 0).select(*df.columns)


def value_range_check(df: DataFrame, ranges: dict[str, dict], shape: Shape = LONG) -> DataFrame:
    """Below, above and inside flags per named range, and whether all or any ranges are violated."""
    require_columns(df, shape.value)
    value = F.col(shape.value)
    flags: dict[str, Column] = {}
    for name, spec in ranges.items():
        if name.endswith(("_IS_BELOW", "_IS_ABOVE")) or name in ("_violates_all", "_violates_any", "_timestamp"):
            raise FrameError(f"range name {name!r} is reserved")
        low, high = spec["min_value"], spec["max_value"]
        low_in, high_in = spec["min_value_inclusive"], spec["max_value_inclusive"]
        if high < low or (not (low_in and high_in) and high == low):
            raise FrameError(f"range {name!r} is empty")
        flags[f"{name}_IS_BELOW"] = value < low if low_in else value <= low
        flags[f"{name}_IS_ABOVE"] = value > high if high_in else value >= high
        flags[name] = ~(flags[f"{name}_IS_BELOW"] | flags[f"{name}_IS_ABOVE"])
    outside = [~flags[name] for name in ranges]
    none_inside = F.lit(True)
    for test in outside:
        none_inside = none_inside & test
    flags["_violates_all"] = none_inside
    flags["_violates_any"] = any_of(outside)
    flags["_timestamp"] = F.col(shape.ts)
    return df.where(value.isNotNull()).select(
        *shape.index, *shape.tie, *[test.alias(name) for name, test in flags.items()]
    )
