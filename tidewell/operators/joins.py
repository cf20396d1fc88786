"""Joins and alignment on the index."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.frames import LONG, FrameError, Shape, elapsed, is_time, require_columns, tick, value_columns
from tidewell.plans.blocks import (
    SERIES_BROADCAST, block_rows, join_null_safe, join_per_series, lay_out, neighbour, running,
)


def duplicate_message(index: list[Column]) -> Column:
    return F.concat(F.lit("duplicate index "), F.concat_ws(" ", *[c.cast("string") for c in index]))


def unique_index(df: DataFrame, shape: Shape, columns: list[str] | None = None) -> DataFrame:
    """One row per index value; a duplicate stops the job.

    The check is an aggregation on the columns the following join partitions by, so it adds no
    shuffle of its own, and duplicates are folded on the map side.
    """
    columns = columns or value_columns(df, shape)
    return _unique(df, shape, columns).select(*[F.col(f"_index.{c}").alias(c) for c in shape.index], *columns)


def _unique(df: DataFrame, shape: Shape, columns: list[str]) -> DataFrame:
    """One row per index value, packed as ``_index``: structs are equal where their missing parts agree."""
    packed = df.select(F.struct(*shape.index).alias("_index"), *columns)
    grouped = packed.groupBy("_index").agg(F.count(F.lit(1)).alias("_times"), *[F.first(c).alias(c) for c in columns])
    message = duplicate_message([F.col(f"_index.{c}") for c in shape.index])
    single = F.when(F.col("_times") == 1, True).otherwise(F.raise_error(message).cast("boolean"))
    return grouped.where(single).select("_index", *columns)


def align(left: DataFrame, right: DataFrame, shape: Shape = LONG, how: str = "full") -> DataFrame:
    """Two series side by side as columns ``left`` and ``right``, joined on keys and index.

    A missing key is a series like any other, so it meets the missing key of the other side.
    """
    a = _unique(left.select(*shape.index, F.col(shape.value).alias("left")), shape, ["left"])
    b = _unique(right.select(*shape.index, F.col(shape.value).alias("right")), shape, ["right"])
    joined = a.join(b, "_index", how)
    return joined.select(*[F.col(f"_index.{c}").alias(c) for c in shape.index], "left", "right")


def _hot_keys(a: DataFrame, b: DataFrame) -> DataFrame | None:
    """Keys with more rows on one side than a block holds: ``_key`` and the rows of both sides, ``_na`` and ``_nb``.

    None if there are none, or more than may be broadcast. A side that fits a block as a whole is not looked at
    by key; counts by key are combined on the map side.
    """
    limit = block_rows(a)
    counts = [df.groupBy(F.col(c).alias("_key")).agg(F.count(F.lit(1)).alias("_n")) for df, c in ((a, "_a"), (b, "_b"))]
    hot = [own.where(F.col("_n") > limit).select("_key") for own, df in zip(counts, (a, b), strict=True) if df.count() > limit]
    if not hot:
        return None
    keys = reduce(DataFrame.union, hot).distinct()
    for name, own in zip(("_na", "_nb"), counts, strict=True):
        keys = join_null_safe(keys, own.withColumnRenamed("_n", name), ["_key"], "left")
    found = keys.na.fill(0, ["_na", "_nb"]).limit(SERIES_BROADCAST + 1).toArrow()
    if not 0 < found.num_rows <= SERIES_BROADCAST:
        return None
    return F.broadcast(a.sparkSession.createDataFrame(found))


def _spread_join(a: DataFrame, b: DataFrame, hot: DataFrame, how: str) -> DataFrame:
    """The join by ``_a`` and ``_b`` with the rows of frequent keys spread over many tasks.

    All other keys are joined plainly. Of a frequent key, the side with more rows is dealt out into parts of
    a block, and the other side goes to every part. The counts say whether it has rows at all, so
    an outer join needs nothing more: without them, the rows stay alone.
    """
    limit = block_rows(a)
    same = F.col("_a").eqNullSafe(F.col("_b"))
    marked = {}
    for df, c in ((a, "_a"), (b, "_b")):
        marked[c] = df.join(hot.withColumn("_hot", F.lit(True)), F.col(c).eqNullSafe(F.col("_key")), "left").drop("_key")
    cold = {c: df.where("_hot is null").drop("_hot", "_na", "_nb") for c, df in marked.items()}
    warm = {c: df.where("_hot").drop("_hot") for c, df in marked.items()}
    parts = F.ceil(F.greatest("_na", "_nb") / limit)
    dealt = F.pmod(F.monotonically_increasing_id(), parts)
    every = F.explode(F.sequence(F.lit(0).cast("bigint"), parts - 1))
    met = {}
    for c, more in (("_a", F.col("_na") >= F.col("_nb")), ("_b", F.col("_na") < F.col("_nb"))):
        both = warm[c].where("_na > 0 and _nb > 0")
        split, copied = both.where(more).withColumn("_part", dealt), both.where(~more).withColumn("_part", every)
        met[c] = split.unionByName(copied).withColumnRenamed("_part", f"_part{c}").drop("_na", "_nb")
    columns = [*a.columns, *b.columns]
    pairs = met["_a"].join(met["_b"], same & (F.col("_part_a") == F.col("_part_b"))).select(*columns)
    out = cold["_a"].join(cold["_b"], same, how).select(*columns).unionByName(pairs)
    if how in ("left", "outer"):
        out = out.unionByName(warm["_a"].where("_nb = 0").drop("_na", "_nb"), allowMissingColumns=True)
    if how in ("right", "outer"):
        out = out.unionByName(warm["_b"].where("_na = 0").drop("_na", "_nb"), allowMissingColumns=True)
    return out


def merge_on_column(left: DataFrame, right: DataFrame, column: str, how: str = "inner") -> DataFrame:
    """Join on one column; NULL keys match each other, overlapping columns get ``_x`` and ``_y``."""
    if how not in ("inner", "left", "right", "outer"):
        raise FrameError(f"how must be inner, left, right or outer, not {how!r}")
    require_columns(left, column)
    require_columns(right, column)
    both = (set(left.columns) & set(right.columns)) - {column}
    a = left.select(*[F.col(c).alias(f"{c}_x" if c in both else c) for c in left.columns if c != column], F.col(column).alias("_a"))
    b = right.select(*[F.col(c).alias(f"{c}_y" if c in both else c) for c in right.columns if c != column], F.col(column).alias("_b"))
    hot = _hot_keys(a, b)
    joined = a.join(b, F.col("_a").eqNullSafe(F.col("_b")), how) if hot is None else _spread_join(a, b, hot, how)
    key = {"inner": F.col("_a"), "left": F.col("_a"), "right": F.col("_b"), "outer": F.coalesce("_a", "_b")}[how]
    rest = [c for c in (*a.columns, *b.columns) if c not in ("_a", "_b")]
    return joined.select(key.alias(column), *rest)


def _free_name(wanted: str | None, taken: list[str]) -> str:
    if wanted is None:
        return next(str(i) for i in range(len(taken) + 1) if str(i) not in taken)
    if wanted not in taken:
        return wanted
    return next(f"{wanted}_{i}" for i in range(1, len(taken) + 2) if f"{wanted}_{i}" not in taken)


def combine_into_frame(
    frame: DataFrame, series: DataFrame, name: str | None = None, shape: Shape = LONG
) -> DataFrame:
    """Add a series as a column to a frame by index; a taken name gets the next free suffix."""
    column = _free_name(name, value_columns(frame, shape))
    added = unique_index(series.select(*shape.index, F.col(shape.value).alias(column)), shape, [column])
    return join_null_safe(frame, added, shape.index, "left")


def combine_as_named(frame: DataFrame, series: DataFrame, column: str, shape: Shape = LONG) -> DataFrame:
    """Add a series under a given column name, replacing a column of that name."""
    return combine_into_frame(frame.drop(column), series, column, shape)


def combine_two(
    frame: DataFrame, first: DataFrame, second: DataFrame, names: tuple[str | None, str | None] = (None, None),
    shape: Shape = LONG,
) -> DataFrame:
    """Add two series one after the other."""
    return combine_into_frame(combine_into_frame(frame, first, names[0], shape), second, names[1], shape)


def restrict_to_common_index(a: DataFrame, b: DataFrame, shape: Shape = LONG) -> tuple[DataFrame, DataFrame]:
    """Both inputs restricted to index values present in both; duplicates survive."""
    index = list(shape.index)
    return (
        join_null_safe(a, b.select(*index).distinct(), index, "left_semi"),
        join_null_safe(b, a.select(*index).distinct(), index, "left_semi"),
    )


def _first_per_index(df: DataFrame, shape: Shape, out: str) -> DataFrame:
    place = F.struct(*shape.tie, F.col(shape.value)) if shape.tie else F.struct(F.col(shape.value))
    held = F.min(F.struct(place.alias("place"), F.col(shape.value).alias("v")))
    return df.groupBy(*shape.index).agg(held.alias("_h")).select(
        *shape.index, F.col("_h.v").alias(out), F.lit(True).alias(f"_has_{out}")
    )


def substitution_pairs(raw: DataFrame, substitution: DataFrame, shape: Shape = LONG) -> DataFrame:
    """Raw and substitute values per index with presence flags; of duplicates the first counts."""
    first = [_first_per_index(df, shape, name) for df, name in ((raw, "raw"), (substitution, "sub"))]
    pairs = join_null_safe(*first, shape.index, "full")
    return pairs.withColumns(
        {"_has_raw": F.coalesce("_has_raw", F.lit(False)), "_has_sub": F.coalesce("_has_sub", F.lit(False))}
    )


def apply_substitution(raw: DataFrame, substitution: DataFrame, shape: Shape = LONG) -> DataFrame:
    """Replace, delete (by a NULL substitute) and add points."""
    pairs = substitution_pairs(raw, substitution, shape)
    kept = pairs.where(F.col("sub").isNotNull() | ~F.col("_has_sub") | ~F.col("_has_raw"))
    value = F.when(F.col("_has_sub"), F.col("sub")).otherwise(F.col("raw"))
    return kept.select(*shape.index, value.alias(shape.value))


def time_to_length(data: DataFrame, speed: DataFrame | float, shape: Shape = LONG) -> DataFrame:
    """Re-index a time series by travelled length.

    A constant speed gives ``speed * seconds since the first point``; a speed series is
    integrated by trapezoids and joined on common timestamps.
    """
    if not is_time(data, shape.ts):
        raise FrameError("time_to_length needs a time index")
    if not isinstance(speed, DataFrame):
        start = data.groupBy(*shape.keys).agg(F.min(tick(data, shape.ts)).alias("_start"))
        joined = join_per_series(data, start, shape.keys)
        length = (tick(data, shape.ts) - F.col("_start")) / F.lit(1e6) * F.lit(float(speed))
        return joined.select(*shape.index, length.alias("length"), shape.value)
    ordered = lay_out(speed.na.drop("any", subset=[shape.value]), shape)
    now = tick(speed, shape.ts)
    value = F.col(shape.value)
    steps = neighbour(ordered, {"_t": now, "_v": value})
    area = trapezoid(speed, now, F.col("_t"), value, F.col("_v"), shape)
    lengths = running(steps.with_frame(steps.df.withColumn("_area", F.coalesce(area, F.lit(0.0)))), {"length": ("sum", F.col("_area"))})
    travelled = lengths.rows().select(*shape.index, "length")
    return join_null_safe(data, travelled, shape.index).select(*shape.index, "length", shape.value)


def trapezoid(df: DataFrame, now: Column, before: Column, value: Column, previous: Column, shape: Shape) -> Column:
    return elapsed(df, now, before, shape.ts) * (value + previous) / 2
