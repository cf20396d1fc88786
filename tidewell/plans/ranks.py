"""Exact quantiles without holding a series in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewell.frames import Shape
from tidewell.plans.blocks import block_rows, join_per_series, lay_out, learn, pin, running


def quantiles(
    df: DataFrame,
    keys: Sequence[str],
    column: str,
    probabilities: Sequence[float],
    nearest: bool = False,
    small: bool | None = None,
) -> DataFrame:
    """Per key an array ``quantiles`` of exact quantiles of ``column`` and the row count ``n``.

    Rows are counted per distinct value on the map side. The running count over the ordered
    values then tells which value holds each rank, block by block for series with many distinct
    values. ``nearest`` takes the nearest rank (ties to even) instead of interpolating. ``small`` tells, if
    known, whether every series fits one block.
    """
    shape = Shape(tuple(keys), "_value", "_value")
    present = df.select(*keys, F.col(column).alias("_value")).where(F.col("_value").isNotNull())
    counts = present.groupBy(*keys, "_value").agg(F.count(F.lit(1)).alias("_n"))
    if small is None:
        small = learn(present, shape, block_rows(df)).spread.longest <= block_rows(df)
    if not small:
        # The counts are measured and read several times; what they come from runs once.
        counts = pin(counts)
    blocks = lay_out(counts, shape, small=small)
    if not blocks.split and not nearest:
        wanted = F.percentile("_value", F.array(*[F.lit(float(p)) for p in probabilities]), F.col("_n"))
        return counts.groupBy(*keys).agg(F.sum("_n").alias("n"), wanted.alias("quantiles"))
    upto = running(blocks, {"_upto": ("sum", F.col("_n"))}).rows()
    if not blocks.split:
        ranked = upto.withColumn("n", F.sum("_n").over(Window.partitionBy(*keys)))
    else:
        ranked = join_per_series(upto, counts.groupBy(*keys).agg(F.sum("_n").alias("n")), keys)
    before = F.col("_upto") - F.col("_n")

    def at(rank):
        return F.max(F.when((before <= rank) & (rank < F.col("_upto")), F.col("_value")))

    picks = []
    for i, p in enumerate(probabilities):
        rank = (F.col("n") - 1) * F.lit(float(p))
        if nearest:
            picks.append(at(F.bround(rank)).cast("double").alias(f"q{i}"))
        else:
            picks += [at(F.floor(rank)).alias(f"lo{i}"), at(F.ceil(rank)).alias(f"hi{i}")]
    held = ranked.groupBy(*keys, "n").agg(*picks)
    if nearest:
        out = [F.col(f"q{i}") for i in range(len(probabilities))]
    else:
        out = []
        for i, p in enumerate(probabilities):
            rank = (F.col("n") - 1) * F.lit(float(p))
            out.append(F.col(f"lo{i}") + (F.col(f"hi{i}") - F.col(f"lo{i}")) * (rank - F.floor(rank)))
    return held.select(*keys, "n", F.array(*out).alias("quantiles"))
