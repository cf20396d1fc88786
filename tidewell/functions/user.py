"""User code: whole-frame functions, per-series and per-batch pandas functions, own sources."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource

from tidewell.frames import LONG, FrameError, Shape
from tidewell.plans.blocks import BLOCK_ROWS_CONF, measure

Outputs = DataFrame | dict[str, DataFrame]

#: Rows of a series that user code may get as one frame.
WHOLE_SERIES_ROWS = 1_000_000


def run_component(function: Callable[..., Outputs], outputs: list[str] | None = None, **inputs: object) -> Outputs:
    """Call a user function with named inputs; several outputs come as a dictionary."""
    result = function(**inputs)
    if outputs is not None:
        if not isinstance(result, dict) or set(result) != set(outputs):
            raise FrameError(f"the function must return the outputs {outputs}")
    return result


def per_series(
    df: DataFrame, function: Callable[..., pd.DataFrame | Iterator[pd.DataFrame]], schema: T.StructType | str,
    shape: Shape = LONG, pieces: bool = False,
) -> DataFrame:
    """Arbitrary pandas code on each series, in order.

    With ``pieces`` the code takes an iterator over consecutive pieces of its series and gives one back. A series
    may then have any length: Spark sorts it, and a task holds one piece at a time.

    Without, the code gets its whole series as one frame, so the size is checked first: a series beyond
    ``WHOLE_SERIES_ROWS`` (or ``tidewell.block.rows``, if set) is refused instead of overrunning the task.
    """
    order = [*shape.order]
    if pieces:
        return _in_pieces(df, function, schema, shape)
    limit = int(df.sparkSession.conf.get(BLOCK_ROWS_CONF, str(WHOLE_SERIES_ROWS)))
    longest = measure(df, shape, limit).spread.longest
    if longest > limit:
        raise FrameError(
            f"a series of {longest} rows does not fit one task (limit {limit}); "
            "use pieces, per_batch for row-local code, or a narrower key"
        )

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return function(pdf.sort_values(order, kind="stable", ignore_index=True))

    return df.groupBy(*shape.keys).applyInPandas(run, schema)


def _in_pieces(
    df: DataFrame, function: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], schema: T.StructType | str, shape: Shape
) -> DataFrame:
    """The groups of sorted partitions keep their order, as they are sorted by the keys first."""
    keys = [*shape.keys]
    dealt = df.repartition(*keys) if keys else df.repartition(1)
    ordered = dealt.sortWithinPartitions(*keys, *[F.col(c).asc_nulls_last() for c in shape.order])

    def run(pieces: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from function(pieces)

    return ordered.groupBy(*keys).applyInPandas(run, schema)


def per_batch(df: DataFrame, function: Callable[[pd.DataFrame], pd.DataFrame], schema: T.StructType | str) -> DataFrame:
    """Row-local pandas code on Arrow batches, without a shuffle."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield function(batch)

    return df.mapInPandas(run, schema)


def register_source(spark: SparkSession, source: type[DataSource]) -> str:
    """Register a user format for reading and writing; returns its name."""
    spark.dataSource.register(source)
    return source.name()
