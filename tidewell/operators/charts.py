"""Chart-ready tables: the data step behind each plot, without the drawing."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewell.frames import LONG, FrameError, Shape, require_columns
from tidewell.functions.durations import from_micros
from tidewell.operators.joins import align, substitution_pairs


#: From so many columns on, pairs are counted in matrices instead of an expression each.
MANY_COLUMNS = 24
#: Share of the squares below which a spread is rounding.
ROUNDING = 1e-13


def correlation_matrix(df: DataFrame, columns: list[str]) -> DataFrame:
    """Pearson correlation of every pair of columns over the rows where both are known.

    Few columns take one aggregation with an expression for each pair. Many take two scans: their means, and matrices
    of products of what is left, with masks for missing values, which a task adds up over its Arrow batches.
    """
    require_columns(df, *columns)
    if len(columns) >= MANY_COLUMNS:
        return _wide_correlation(df, columns)
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    both = [F.col(a).isNotNull() & F.col(b).isNotNull() for a, b in pairs]

    def corr(x: Column, y: Column) -> Column:
        """NULL where a side has no spread, which ``F.corr`` takes for a division by zero."""
        return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))

    aggs = [
        corr(F.when(known, F.col(a)), F.when(known, F.col(b))).alias(f"c{i}")
        for i, ((a, b), known) in enumerate(zip(pairs, both, strict=True))
    ]
    row = df.agg(*aggs)
    cells = []
    for i, (a, b) in enumerate(pairs):
        value = F.col(f"c{i}")
        value = F.when(~F.isnan(value), value).alias("corr")
        for x, y in {(a, b), (b, a)}:
            cells.append(F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"), value))
    return row.select(F.explode(F.array(*cells)).alias("cell")).select("cell.*")


_GRAM = "n array<double>, s array<double>, q array<double>, c array<double>"


def _wide_correlation(df: DataFrame, columns: list[str]) -> DataFrame:
    """Matrices of the pairs: rows where both are known, sums, squares and products of the distances to the means."""
    values = [F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(columns)]
    numbers = df.select(*values)
    means = numbers.agg(*[F.coalesce(F.avg(F.nanvl(f"x{i}", F.lit(None))), F.lit(0.0)) for i in range(len(columns))]).first()
    centre, names, width = np.array(list(means), dtype=float), np.array(columns), len(columns)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((4, width, width))
        for batch in batches:
            held = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns]) if batch.num_rows else np.zeros((0, width))
            known = ~np.isnan(held)
            away = np.where(known, held - centre, 0.0)
            mask = known.astype(float)
            total += np.stack([mask.T @ mask, away.T @ mask, (away**2).T @ mask, away.T @ away])
        rows = [pa.array(list(m), pa.list_(pa.float64())) for m in total]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(width), pa.int32()), *rows], ["i", *"nsqc"])

    # One row a column and task; rows of a column are added up a hundred tasks at a time, then all.
    parts = numbers.mapInArrow(add, f"i int, {_GRAM}").withColumn("g", F.pmod(F.spark_partition_id(), F.lit(100)))
    for group in (["i", "g"], ["i"]):
        parts = parts.groupBy(*group).applyInArrow(_added(group), ", ".join([f"{g} int" for g in group] + [_GRAM]))

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(width, row["i"]), pa.int32()), pa.array(np.arange(width), pa.int32()), *(pa.array(row[k], pa.float64()) for k in "nsqc")],
                    ["i", "j", *"nsqc"],
                )

    flat = parts.mapInArrow(cells, "i int, j int, n double, s double, q double, c double")
    other = flat.select(F.col("i").alias("j"), F.col("j").alias("i"), F.col("s").alias("s2"), F.col("q").alias("q2"))
    both = flat.join(other, ["i", "j"])
    n = F.col("n")
    top = F.col("c") - F.try_divide(F.col("s") * F.col("s2"), n)

    def spread(square: str, total: str) -> Column:
        """Squared distances from the mean of the pair's rows; what is left of equal values by rounding is none."""
        left = F.col(square) - F.try_divide(F.col(total) ** 2, n)
        return F.when(left > ROUNDING * F.col(square), left)

    value = top / F.sqrt(spread("q", "s") * spread("q2", "s2"))
    labels = F.array(*[F.lit(c) for c in names.tolist()])
    return both.select(F.get(labels, F.col("i")).alias("x"), F.get(labels, F.col("j")).alias("y"), F.when(value.isNotNull(), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), value))).alias("corr"))


def _added(group: list[str]) -> Callable[[pa.Table], pa.Table]:
    """The sum of the rows of one column's matrices."""

    def run(rows: pa.Table) -> pa.Table:
        key = {g: rows.column(g).slice(0, 1).combine_chunks() for g in group}
        sums = {k: pa.array([np.sum(np.array(rows.column(k).to_pylist()), axis=0).tolist()], pa.list_(pa.float64())) for k in "nsqc"}
        return pa.table({**key, **sums})

    return run


def shares(df: DataFrame, value_column: str, group_column: str) -> DataFrame:
    """Sum per group and its share of the whole."""
    sums = df.groupBy(group_column).agg(F.sum(value_column).alias("total"))
    whole = sums.agg(F.sum("total").alias("_whole"))
    # One row, so the broadcast does not grow with the data.
    joined = sums.crossJoin(F.broadcast(whole))
    return joined.select(group_column, "total", F.try_divide("total", "_whole").alias("share"))


def scatter_by_index(x: DataFrame, y: DataFrame, shape: Shape = LONG) -> DataFrame:
    """Pairs of two series on common index values; the index is the colour."""
    pairs = align(x, y, shape, "inner")
    return pairs.select(*shape.index, F.col("left").alias("x"), F.col("right").alias("y"))


def _labelled(parts: dict[str, DataFrame], shape: Shape) -> DataFrame:
    result = None
    for label, df in parts.items():
        part = df.select(F.lit(label).alias("series"), *shape.index, F.col(shape.value).cast("double").alias(shape.value))
        result = part if result is None else result.unionByName(part)
    return result


def overlay(first: DataFrame, second: DataFrame, shape: Shape = LONG, names: tuple[str, str] = ("series_1", "series_2")) -> DataFrame:
    """Two series under each other with a label, ordered for drawing."""
    return _labelled(dict(zip(names, (first, second), strict=True)), shape).orderBy("series", *shape.index)


def overlay_with_axes(
    first: DataFrame, second: DataFrame, shape: Shape = LONG, names: tuple[str, str] = ("series_1", "series_2")
) -> dict[str, DataFrame]:
    """Two series with the value range of each one's own axis."""
    rows = _labelled(dict(zip(names, (first, second), strict=True)), shape)
    axes = rows.groupBy("series").agg(F.min(shape.value).alias("low"), F.max(shape.value).alias("high"))
    return {"rows": rows.orderBy("series", *shape.index), "axes": axes}


def panels(multits: DataFrame, shape: Shape = LONG) -> dict[str, DataFrame]:
    """One panel per metric: ordered rows, and the bounds of both axes."""
    bounds = multits.groupBy(*shape.keys).agg(
        F.min(shape.ts).alias("first"),
        F.max(shape.ts).alias("last"),
        F.min(shape.value).alias("low"),
        F.max(shape.value).alias("high"),
    )
    return {"rows": multits.orderBy(*shape.keys, *shape.order), "bounds": bounds}


def substitution_classes(raw: DataFrame, substitution: DataFrame, shape: Shape = LONG) -> DataFrame:
    """Points of a substitution by class: handled, replaced, replacement, new and ignored."""
    pairs = substitution_pairs(raw, substitution, shape)
    has_raw, has_sub = F.col("_has_raw"), F.col("_has_sub")
    known = F.col("sub").isNotNull()
    replaced = has_raw & has_sub & known

    def entry(name: str, when: Column, value: Column) -> Column:
        return F.when(when, F.struct(F.lit(name).alias("class"), value.cast("double").alias(shape.value)))

    raw_value, sub_value = F.col("raw"), F.col("sub")
    entries = F.array_compact(
        F.array(
            entry("handled", known | ~has_sub | ~has_raw, F.when(has_sub, sub_value).otherwise(raw_value)),
            entry("replaced", replaced, raw_value),
            entry("replacement", replaced, sub_value),
            entry("new", ~has_raw, sub_value),
            entry("ignored", has_raw & has_sub & ~known, raw_value),
        )
    )
    return pairs.select(*shape.index, F.explode(entries).alias("_e")).select(*shape.index, "_e.*")


# Default colours of a box are those of its parameters.
def value_interval_boxes(
    df: DataFrame,
    intervals: dict[str, dict],
    line_color: str = "rgb(40, 251, 0)",
    fill_color: str = "rgba(40, 251, 0, 0.15)",
    shape: Shape = LONG,
) -> DataFrame:
    """A rectangle per value interval over the time range of each series, and the place of its label."""
    rows = []
    for pos, (name, spec) in enumerate(intervals.items()):
        low, high = spec.get("min_value"), spec.get("max_value")
        if low is None or high is None or high < low:
            raise FrameError(f"value interval {name!r} is empty")
        fill = spec.get("fill_color")
        line = spec.get("line_color") or fill or line_color
        label = spec.get("display_name") or name
        rows.append((pos, name, label, float(low), float(high), line, fill or fill_color))
    schema = "position int, name string, label string, low double, high double, line_color string, fill_color string"
    boxes = df.sparkSession.createDataFrame(rows, schema)
    span = df.groupBy(*shape.keys).agg(F.min(shape.ts).alias("x0"), F.max(shape.ts).alias("x1"))
    first, last = F.unix_micros("x0"), F.unix_micros("x1")
    # The boxes are an argument of the call, a handful of rows.
    joined = span.crossJoin(F.broadcast(boxes))
    label_x = from_micros(first + F.floor((F.col("position") + 1) * (last - first) / F.lit(12 * len(rows))))
    return joined.withColumn("label_x", label_x)


def remaining_life_table(
    base: DataFrame, predictions: DataFrame, limits: DataFrame, limit: float, shape: Shape = LONG
) -> dict[str, DataFrame]:
    """Base series and prediction line in one frame, and the limit with the time it is reached."""
    rows = _labelled({"base": base, "prediction": predictions}, shape)
    return {"rows": rows, "limit": limits.select(*shape.keys, F.lit(float(limit)).alias("limit"), "violation")}


# Display widths in characters per kind of column.
NUMBER_WIDTH, BOOLEAN_WIDTH, TIME_WIDTH, OBJECT_WIDTH = 16, 6, 32, 32
TEXT_WIDTH_RANGE = (12, 200)


def table_widths(df: DataFrame) -> DataFrame:
    """Display width of every column from its type, its name and, for text, its longest entry."""
    text = [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
    lengths = df.agg(F.lit(1).alias("_one"), *[F.max(F.length(c)).alias(f"_len{i}") for i, c in enumerate(text)])
    cells = []
    for place, field in enumerate(df.schema):
        if isinstance(field.dataType, T.StringType):
            low, high = TEXT_WIDTH_RANGE
            longest = F.coalesce(F.col(f"_len{text.index(field.name)}"), F.lit(0))
            width = F.greatest(F.least(longest, F.lit(high)), F.lit(low))
        elif isinstance(field.dataType, T.BooleanType):
            width = F.lit(BOOLEAN_WIDTH)
        elif isinstance(field.dataType, T.NumericType):
            width = F.lit(NUMBER_WIDTH)
        elif isinstance(field.dataType, (T.TimestampType, T.TimestampNTZType, T.DateType)):
            width = F.lit(TIME_WIDTH)
        else:
            width = F.lit(OBJECT_WIDTH)
        shown = F.greatest(width, F.lit(len(field.name)))
        cells.append(F.struct(F.lit(place).alias("position"), F.lit(field.name).alias("column"), shown.alias("width")))
    return lengths.select(F.explode(F.array(*cells)).alias("cell")).select("cell.*")


def table_preview(df: DataFrame, rows: int = 100, order: tuple[str, ...] = ()) -> DataFrame:
    """The first ``rows`` rows for display, by the given columns or else by all that can be ordered."""
    sortable = [f.name for f in df.schema if not isinstance(f.dataType, (T.MapType, T.VariantType))]
    return df.orderBy(*(order or sortable)).limit(rows)


def colour_points(df: DataFrame, colours: dict[str, str], category: str) -> DataFrame:
    """Map points with the colour of their category; points of an unlisted category have none."""
    require_columns(df, category)
    table = df.sparkSession.createDataFrame(list(colours.items()), f"`{category}` string, color string")
    # The colour map is an argument of the call, one row per category.
    return df.join(F.broadcast(table), category, "left")
