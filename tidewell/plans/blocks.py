"""Ordered work in blocks.

A window over one series puts that series into one task. Here a series is cut into blocks of
consecutive rows, the window runs per block, and what a block needs from its neighbours (a
running total, the previous row, a few rows of context) is carried over separately.

Blocks are cells of equal time width where the rows spread evenly enough. Where one cell would
still hold too many rows (a burst, or one timestamp repeated millions of times), the blocks are
the partitions of a range sort over the whole order and a row number, which parts equal rows too. The
range sort samples its borders, so its result is written once to the shared scratch folder and
read from there: two uses of it must see the same borders.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from functools import reduce
from weakref import WeakKeyDictionary

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewell.frames import Shape, tick
from tidewell.plans.rolling import statistics, time_bounds
from tidewell.session import scratch_dir

BLOCK = "_block"
BLOCK_ROWS_CONF = "tidewell.block.rows"
#: A Python worker holds a block, or up to four in a burst, with a few copies of its columns.
DEFAULT_BLOCK_ROWS = 100_000
HOT_FACTOR = 4
SERIES_BROADCAST = 10_000


@dataclass(frozen=True)
class Spread:
    """How the rows lie on the time axis: rows of the longest series, all rows, lowest and highest tick.

    The ticks are None where they were not looked at.
    """

    longest: int
    total: int
    low: float | None = None
    high: float | None = None


@dataclass
class Facts:
    """What is known about a frame: its spread, the series too long for one block, and how full
    the fullest of their cells is.

    The numbers are upper bounds, so they hold for every frame made by dropping rows or
    changing values. Operators hand them on, and a chain of operators counts its rows once.
    ``hot`` has a row of keys, count and tick range per long series; it is None if there are
    more of them than may be broadcast.
    """

    keys: tuple[str, ...]
    ts: str
    limit: int
    spread: Spread
    hot: pa.Table | None = None
    fullest: dict[int, int] = field(default_factory=dict)


_FACTS: WeakKeyDictionary[DataFrame, Facts] = WeakKeyDictionary()


def facts_of(df: DataFrame, shape: Shape) -> Facts | None:
    facts = _FACTS.get(df)
    return facts if facts and (facts.keys, facts.ts) == (shape.keys, shape.ts) else None


def with_facts(df: DataFrame, facts: Facts | None) -> DataFrame:
    """Hand known facts on to a frame with no other index values and no more rows."""
    if facts is not None:
        _FACTS[df] = facts
    return df


def narrowed(df: DataFrame, source: DataFrame) -> DataFrame:
    """Like :func:`with_facts`, from the frame the rows come from."""
    return with_facts(df, _FACTS.get(source))


@dataclass(frozen=True)
class Blocks:
    """A frame with a block number that grows with the order inside every series."""

    df: DataFrame
    shape: Shape
    order: tuple[str, ...]
    split: bool
    block_rows: int
    facts: Facts | None = None

    @property
    def group(self) -> list[str]:
        return [*self.shape.keys, BLOCK] if self.split else list(self.shape.keys)

    def window(self, reverse: bool = False) -> WindowSpec:
        columns = [F.col(c).desc() if reverse else F.col(c).asc() for c in self.order]
        return Window.partitionBy(*self.group).orderBy(*columns)

    def with_frame(self, df: DataFrame) -> Blocks:
        return replace(self, df=df)

    def rows(self) -> DataFrame:
        return with_facts(self.df.drop(BLOCK), self.facts)


def block_rows(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get(BLOCK_ROWS_CONF, str(DEFAULT_BLOCK_ROWS)))


def pin(df: DataFrame) -> DataFrame:
    """Write a frame once to the shared scratch folder and continue from the written rows."""
    path = f"{scratch_dir(df.sparkSession).rstrip('/')}/tidewell-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def measure(df: DataFrame, shape: Shape, limit: int, ticks: bool = False) -> Facts:
    """Row counts, and the range of ticks if asked for or needed.

    A frame that fits one block as a whole is settled by one count, which for a plain table
    comes from the file footers. Otherwise one more pass counts per series on the map side, and
    the series longer than a block come to the driver, up to the broadcast limit.
    """
    at = tick(df, shape.ts)
    range_of = [F.min(at).alias("low"), F.max(at).alias("high")]
    count = F.count(F.lit(1)).alias("n")
    row = df.agg(count, *range_of).first() if ticks else df.agg(count).first()
    low, high = row[1:] if ticks else (None, None)
    if row["n"] <= limit:
        return Facts(shape.keys, shape.ts, limit, Spread(row["n"], row["n"], low, high))
    long = df.groupBy(*shape.keys).agg(count, *range_of).where(F.col("n") > limit)
    hot = long.limit(SERIES_BROADCAST + 1).toArrow()
    if hot.num_rows > SERIES_BROADCAST:
        longest, low, high = long.agg(F.max("n"), F.min("low"), F.max("high")).first()
        return Facts(shape.keys, shape.ts, limit, Spread(longest, row["n"], low, high))
    longest = max(hot["n"].to_pylist(), default=limit)
    return Facts(shape.keys, shape.ts, limit, Spread(longest, row["n"], low, high), hot)


def learn(df: DataFrame, shape: Shape, limit: int, ticks: bool = False) -> Facts:
    """Facts of a frame, measured unless they are known."""
    facts = facts_of(df, shape)
    if facts is None or facts.limit != limit or (facts.spread.low is None and ticks and facts.spread.total):
        facts = measure(df, shape, limit, ticks)
        with_facts(df, facts)
    return facts


def _cell_width(count: int, low: float, high: float, limit: int, at_least: int) -> float:
    span = high - low
    if isinstance(low, int):
        return max(1, at_least, span * limit // count)
    return max(span * limit / count, float(at_least)) or 1.0


def _with_cells(df: DataFrame, shape: Shape, facts: Facts, at_least: int = 0) -> DataFrame:
    """Column ``_width``: the cell width of the row's series, NULL for a series of one block.

    Every long series gets the width at which its cells hold a block of rows on average.
    """
    spread, hot = facts.spread, facts.hot
    if hot is None:
        width = _cell_width(spread.longest, spread.low, spread.high, facts.limit, at_least)
        return df.withColumn("_width", F.lit(width))
    widths = [
        _cell_width(n, low, high, facts.limit, at_least)
        for n, low, high in zip(*(hot[c].to_pylist() for c in ("n", "low", "high")), strict=True)
    ]
    if not shape.keys:
        return df.withColumn("_width", F.lit(widths[0]))
    table = hot.select(list(shape.keys)).append_column("_width", pa.array(widths))
    small = df.sparkSession.createDataFrame(table)
    return join_null_safe(df, F.broadcast(small), shape.keys, "left")


def _cell(at: Column) -> Column:
    return F.coalesce(F.floor(at / F.col("_width")), F.lit(0).cast("bigint"))


def _fullest_cell(cells: DataFrame, shape: Shape, facts: Facts, at_least: int = 0) -> int:
    """Rows of the fullest cell of the long series, counted on the map side."""
    if at_least not in facts.fullest:
        long = cells.where(F.col("_width").isNotNull())
        counts = long.groupBy(*shape.keys, _cell(tick(cells, shape.ts)).alias("cell")).count()
        facts.fullest[at_least] = counts.agg(F.max("count")).first()[0] or 0
    return facts.fullest[at_least]


def lay_out(
    df: DataFrame, shape: Shape, order: tuple[str, ...] | None = None, by_range: bool = False, small: bool = False
) -> Blocks:
    """Cut every series into blocks of consecutive rows, each small enough for one task.

    ``small`` says that the caller knows the series to fit one block, for instance because they
    hold no more rows than a frame laid out before.
    """
    order = order or shape.order
    limit = block_rows(df)
    if small:
        return Blocks(df, shape, order, False, limit, facts_of(df, shape))
    facts = learn(df, shape, limit)
    if facts.spread.longest <= limit and not by_range:
        return Blocks(df, shape, order, False, limit, facts)
    if order[0] == shape.ts and not by_range:
        cells = _with_cells(df, shape, facts)
        if _fullest_cell(cells, shape, facts) <= HOT_FACTOR * limit:
            cells = cells.withColumn(BLOCK, _cell(tick(df, shape.ts))).drop("_width")
            return Blocks(cells, shape, order, True, limit, facts)
    parts = max(1, -(-facts.spread.total // limit))
    # Equal rows differ in their number, so that a range can end among them.
    numbered = df.withColumn("_number", F.monotonically_increasing_id())
    ranged = numbered.repartitionByRange(parts, *shape.keys, *order, "_number").drop("_number").withColumn(BLOCK, F.spark_partition_id().cast("bigint"))
    return Blocks(pin(ranged), shape, order, True, limit, facts)


def join_null_safe(left: DataFrame, right: DataFrame, keys: tuple[str, ...] | list[str], how: str = "inner") -> DataFrame:
    """Equi join in which NULL meets NULL, as it does in windows and groups."""
    named = right.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    same = [F.col(k).eqNullSafe(F.col(f"_right_{k}")) for k in keys]
    joined = left.join(named, reduce(lambda a, b: a & b, same), how)
    if how in ("full", "right"):
        joined = joined.withColumns({k: F.coalesce(F.col(k), F.col(f"_right_{k}")) for k in keys})
    return joined.drop(*[f"_right_{k}" for k in keys])


def settle(table: DataFrame) -> DataFrame:
    """Compute a small table once: as literal rows up to the broadcast limit, else as written rows."""
    small = _as_literals(table)
    return pin(table) if small is None else small


def _as_literals(table: DataFrame) -> DataFrame | None:
    """The table as literal rows of the plan, or nothing if it has more rows than may be broadcast."""
    rows = table.limit(SERIES_BROADCAST + 1).toArrow()
    if rows.num_rows > SERIES_BROADCAST:
        return None
    return table.sparkSession.createDataFrame(rows)


def join_per_series(df: DataFrame, facts: DataFrame, keys: tuple[str, ...] | list[str], how: str = "inner") -> DataFrame:
    """Join a table with one row per series to the rows.

    Up to ``SERIES_BROADCAST`` series, which is checked by fetching no more rows than that, the
    facts are broadcast, so the rows are not shuffled by a key that may hold a third of them.
    With more series it is a shuffle join, in which adaptive execution splits hot keys.
    """
    if not keys:
        # Without keys the facts are one row.
        return df.crossJoin(F.broadcast(facts))
    small = _as_literals(facts)
    return join_null_safe(df, facts if small is None else F.broadcast(small), keys, how)


# Running state -----------------------------------------------------------------------------


def _add(carry: Column, local: Column) -> Column:
    return F.coalesce(carry + local, local, carry)


_MERGE: dict[str, Callable[[Column, Column], Column]] = {
    "sum": _add,
    "max": lambda carry, local: F.greatest(carry, local),
    "min": lambda carry, local: F.least(carry, local),
    "last": lambda carry, local: F.coalesce(local, carry),
}


def _over(kind: str, value: Column) -> Column:
    if kind == "last":
        return F.last(value, ignorenulls=True)
    return {"sum": F.sum, "max": F.max, "min": F.min}[kind](value)


def running(
    blocks: Blocks, specs: dict[str, tuple[str, Column]], *, exclusive: bool = False, reverse: bool = False
) -> Blocks:
    """Running sum, max, min or last known value from the start of each series.

    ``exclusive`` leaves the current row out, ``reverse`` runs from the end. With split series
    the carry table has one row per series and block; it shares the partitioning of the rows.
    """
    frame = (Window.unboundedPreceding, -1 if exclusive else 0)
    over = blocks.window(reverse).rowsBetween(*frame)
    local = blocks.df.withColumns({out: _over(kind, value).over(over) for out, (kind, value) in specs.items()})
    if not blocks.split:
        return blocks.with_frame(local)
    place = F.struct(*[F.col(c) for c in blocks.order])
    pick = F.min_by if reverse else F.max_by
    totals = blocks.df.groupBy(*blocks.group).agg(
        *[
            (pick(value, F.when(value.isNotNull(), place)) if kind == "last" else _over(kind, value)).alias(out)
            for out, (kind, value) in specs.items()
        ]
    )
    by_block = F.col(BLOCK).desc() if reverse else F.col(BLOCK).asc()
    before = Window.partitionBy(*blocks.shape.keys).orderBy(by_block).rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.select(
        *blocks.group, *[_over(kind, F.col(out)).over(before).alias(f"_carry_{out}") for out, (kind, _) in specs.items()]
    )
    joined = join_null_safe(local, carry, blocks.group, "left")
    merged = {out: _MERGE[kind](F.col(f"_carry_{out}"), F.col(out)) for out, (kind, _) in specs.items()}
    return blocks.with_frame(joined.withColumns(merged).drop(*[f"_carry_{out}" for out in specs]))


def neighbour(blocks: Blocks, columns: dict[str, Column], *, reverse: bool = False, unique: bool = False) -> Blocks:
    """Values of the row before (``reverse``: after) in the same series, NULL at its border.

    ``unique`` says that no rows are equal in the order, so that one sort does for both directions.
    """
    names = list(columns)
    held = F.struct(*[columns[n].alias(n) for n in names])
    near = F.lead(held, 1).over(blocks.window()) if reverse and unique else F.lag(held, 1).over(blocks.window(reverse))
    local = blocks.df.withColumn("_near", near)
    if blocks.split:
        place = F.struct(*[F.col(c) for c in blocks.order])
        pick = F.min_by if reverse else F.max_by
        ends = blocks.df.groupBy(*blocks.group).agg(pick(held, place).alias("_end"))
        by_block = F.col(BLOCK).desc() if reverse else F.col(BLOCK).asc()
        across = Window.partitionBy(*blocks.shape.keys).orderBy(by_block)
        carry = ends.select(*blocks.group, F.lag("_end", 1).over(across).alias("_far"))
        local = join_null_safe(local, carry, blocks.group, "left").withColumn("_near", F.coalesce("_near", "_far")).drop("_far")
    return blocks.with_frame(local.withColumns({n: F.col(f"_near.{n}") for n in names}).drop("_near"))


def number_rows(blocks: Blocks, out: str = "_row") -> Blocks:
    """Position of each row inside its series, from 1."""
    if not blocks.split:
        return blocks.with_frame(blocks.df.withColumn(out, F.row_number().over(blocks.window()).cast("bigint")))
    return running(blocks, {out: ("sum", F.lit(1).cast("bigint"))})


# Row frames ---------------------------------------------------------------------------------


def row_frames(
    blocks: Blocks, before: int, after: int, columns: dict[str, Callable[[WindowSpec], Column]]
) -> DataFrame:
    """Windows that look at most ``before`` rows back and ``after`` rows ahead.

    Split series are renumbered into blocks of equally many rows; the rows a neighbouring block
    needs as context are copied to it, and only rows at home in a block are kept.
    """
    if not blocks.split:
        over = blocks.window()
        framed = blocks.df.withColumns({out: make(over) for out, make in columns.items()})
        return with_facts(framed, blocks.facts)
    copies = _with_context(blocks, before, after)
    over = Window.partitionBy(*blocks.shape.keys, BLOCK).orderBy("_row")
    framed = copies.withColumns({out: make(over) for out, make in columns.items()})
    return with_facts(framed.where(F.col("_home") == F.col(BLOCK)).drop("_home", "_row", BLOCK), blocks.facts)


def _with_context(blocks: Blocks, before: int, after: int) -> DataFrame:
    """Rows by number in blocks of equally many, ``_home``, and copied to the blocks that look at them."""
    size = max(blocks.block_rows, 4 * (before + after))
    numbered = number_rows(blocks).df.drop(BLOCK)
    at = F.col("_row") - 1
    home = F.floor(at / size)
    lowest = F.greatest(F.floor((at - after) / size), F.lit(0))
    return numbered.withColumn("_home", home).withColumn(
        BLOCK, F.explode(F.sequence(lowest, F.floor((at + before) / size)))
    )


def defined(statistic: Column) -> Column:
    """NULL for NaN: the mean of both infinities, or the deviation in a frame with an infinite value."""
    return F.when(~F.isnan(statistic.cast("double")), statistic)


def _with_statistics(framed: DataFrame, group: list[str], order: list[str], value: str, columns: dict[str, str], bounds) -> DataFrame:
    """Moving statistics of whole groups in Arrow blocks; ``bounds`` gives the frames of the sorted rows."""
    schema = T.StructType([*framed.schema.fields, *[T.StructField(out, T.DoubleType()) for out in columns]])

    def run(block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values(order, kind="stable", na_position="first", ignore_index=True)
        first, last, whole = bounds(block)
        found = statistics(block[value].to_numpy(dtype=float), first, last, set(columns.values()))
        return block.assign(**{out: np.where(whole, found[kind], np.nan) for out, kind in columns.items()})

    found = framed.groupBy(*group).applyInPandas(run, schema)
    return found.withColumns({out: defined(F.col(out)) for out in columns})


def rolling_rows(blocks: Blocks, n: int, columns: dict[str, str], value: str) -> DataFrame:
    """Statistics over the last ``n`` rows in Arrow blocks, NULL until there are n rows.

    The cost of a row does not grow with ``n``, unlike that of a window.
    """
    framed = _with_context(blocks, n - 1, 0) if blocks.split else blocks.df
    group = [*blocks.shape.keys, BLOCK] if blocks.split else list(blocks.shape.keys)
    order = ["_row"] if blocks.split else list(blocks.order)

    def bounds(block: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        last = np.arange(len(block))
        return np.maximum(last - (n - 1), 0), last, last >= n - 1

    framed = _with_statistics(framed, group, order, value, columns, bounds)
    if blocks.split:
        framed = framed.where(F.col("_home") == F.col(BLOCK)).drop("_home", "_row", BLOCK)
    return with_facts(framed, blocks.facts)


# Time frames --------------------------------------------------------------------------------

#: Frames of more rows, and medians, run in Arrow blocks: a window goes through a whole frame for each row.
DENSE_FRAME_ROWS = 200


def _direct(kind: str, value: Column, over: WindowSpec) -> Column:
    return {"mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max}[kind](value).over(over)


def time_frames(df: DataFrame, shape: Shape, width: int, columns: dict[str, str]) -> DataFrame:
    """Statistics over ``(ts - width, ts]``: rows of the same timestamp see each other.

    Long series are cut into cells of at least the frame width; every row is also copied to the
    cells whose frames reach back to it. Where such a cell holds too many rows, because the frame is
    wide or the rows lie in a burst, the frames are put together from blocks (:mod:`tidewell.plans.wide`).
    Cells of no more rows than a dense frame are small, whatever the block.
    """
    limit = block_rows(df)
    facts = learn(df, shape, limit, ticks=True)
    spread = facts.spread
    value = F.col(shape.value)
    whole_series = spread.longest <= limit
    span = max(1, int((spread.high or 0) - (spread.low or 0)))
    dense = spread.longest * min(1.0, width / span) > DENSE_FRAME_ROWS
    most = max(HOT_FACTOR * limit // 2, DENSE_FRAME_ROWS)
    if not whole_series and _fullest_cell(_with_cells(df, shape, facts, width), shape, facts, width) > most:
        from tidewell.plans.wide import wide_frames  # which is built on this module

        return with_facts(wide_frames(df, shape, columns, width=width), facts)
    ticked = df.withColumn("_tick", tick(df, shape.ts))
    if whole_series:
        group, copies = list(shape.keys), ticked
    else:
        group, copies = [*shape.keys, BLOCK], _copy_to_cells(_with_cells(ticked, shape, facts, width), width)
    if dense or "median" in columns.values():

        def bounds(block: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, bool]:
            return *time_bounds(block["_tick"].to_numpy(), width), True

        framed = _with_statistics(copies, group, ["_tick"], shape.value, columns, bounds)
    else:
        over = Window.partitionBy(*group).orderBy("_tick").rangeBetween(-(width - 1), 0)
        framed = copies.withColumns({out: defined(_direct(kind, value, over)) for out, kind in columns.items()})
    if not whole_series:
        framed = framed.where(F.col("_home") == F.col(BLOCK)).drop("_home", BLOCK)
    return with_facts(framed.drop("_tick"), facts)


def _copy_to_cells(cells: DataFrame, width: int) -> DataFrame:
    """Every row in its own cell and in the later cells whose frames reach back to it."""
    reach = F.sequence(F.col("_home"), _cell(F.col("_tick") + (width - 1)))
    copies = cells.withColumn("_home", _cell(F.col("_tick"))).withColumn(BLOCK, F.explode(reach))
    return copies.drop("_width")


# Grids --------------------------------------------------------------------------------------

GRID_CHUNK = 4096


def series_bounds(df: DataFrame, shape: Shape) -> DataFrame:
    """Lowest and highest tick of each series, computed once."""
    at = tick(df, shape.ts)
    return settle(df.groupBy(*shape.keys).agg(F.min(at).alias("_low"), F.max(at).alias("_high")))


def grid_facts(bounds: DataFrame, shape: Shape, low: str, high: str, step: int | float) -> Facts | None:
    """Facts of the grid over ``bounds``, if it fits one block; a larger grid is measured when it is used."""
    limit = block_rows(bounds)
    points = bounds.select((F.floor((F.col(high) - F.col(low)) / F.lit(step)) + 1).alias("n"))
    rows = points.limit(SERIES_BROADCAST + 1).collect()
    total = sum(r["n"] for r in rows)
    if len(rows) > SERIES_BROADCAST or total > limit:
        return None
    return Facts(shape.keys, shape.ts, limit, Spread(total, total))


def grid(bounds: DataFrame, keys: tuple[str, ...], low: str, high: str, step: int | float, out: str) -> DataFrame:
    """All points ``low, low + step, ... <= high`` of each row of ``bounds``.

    The points come out in two rounds with a shuffle between them, so that one long series does
    not make one task or one array hold its whole grid.
    """
    last = F.floor((F.col(high) - F.col(low)) / F.lit(step)).cast("bigint")
    chunks = (
        bounds.where(F.col(high) >= F.col(low))
        .withColumn("_last", last)
        .withColumn("_chunk", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor(F.col("_last") / GRID_CHUNK))))
        .repartition(*keys, "_chunk")
    )
    first = F.col("_chunk") * GRID_CHUNK
    position = F.explode(F.sequence(first, F.least(first + (GRID_CHUNK - 1), F.col("_last"))))
    return (
        chunks.withColumn("_position", position)
        .withColumn(out, F.col(low) + F.col("_position") * F.lit(step))
        .drop("_last", "_chunk")
    )


# Points in intervals ------------------------------------------------------------------------

BROADCAST_ROWS = 100_000


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))
