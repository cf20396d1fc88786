"""First-order recursive filters as block-local runs and a carry between the blocks."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewell.frames import LONG, FrameError, Shape, is_time, tick
from tidewell.plans.blocks import BLOCK, join_null_safe, join_per_series, lay_out, neighbour


def _scan(drive: np.ndarray, decay: np.ndarray, sign: np.ndarray) -> np.ndarray:
    """``y[t] = drive[t] + decay[t] * y[t - 1]`` in log2(n) vector steps, each of which doubles the reach.

    Missing and infinite values travel apart from the numbers, so that they stay however small the decay
    becomes: from a missing one on all is missing; an infinite one stays, with the sign of the decays since,
    and meeting one of the other sign gives missing. ``sign`` is that of the decay where it underflows.
    """
    infinite, missing = np.isinf(drive), np.isnan(drive)
    out, decay, reach = np.where(infinite | missing, 0.0, drive), decay.astype(float), 1
    while reach < len(out) and decay.any():
        out[reach:] = out[reach:] + decay[reach:] * out[:-reach]
        decay[reach:] = decay[reach:] * decay[:-reach]
        decay[:reach] = 0.0
        reach *= 2
    if infinite.any():
        turned = np.cumprod(sign)
        signs = np.where(infinite, np.sign(drive) * turned, 0.0)
        first = signs[infinite.argmax()]
        missing |= infinite & (signs != first)
        out = np.where(np.maximum.accumulate(infinite), first * turned * np.inf, out)
    return np.where(np.maximum.accumulate(missing), np.nan, out)


def lowpass(df: DataFrame, frequency: float, shape: Shape = LONG) -> DataFrame:
    """First-order Butterworth low pass with zero initial state; ``frequency`` in hertz."""
    return _first_order(df, frequency, shape, high=False)


def highpass(df: DataFrame, frequency: float, shape: Shape = LONG) -> DataFrame:
    """First-order Butterworth high pass with zero initial state; ``frequency`` in hertz."""
    return _first_order(df, frequency, shape, high=True)


def _first_order(df: DataFrame, frequency: float, shape: Shape, high: bool) -> DataFrame:
    """``y = b0 x + b1 x_before - a1 y_before`` with coefficients from the bilinear transform.

    The Nyquist frequency is half the mean sampling rate of the series. A missing input makes
    all later outputs of its series missing.
    """
    if not is_time(df, shape.ts):
        raise FrameError("a frequency filter needs a time index")
    at = tick(df, shape.ts)
    spans = df.groupBy(*shape.keys).agg(
        F.count(F.lit(1)).alias("_n"), ((F.max(at) - F.min(at)) / F.lit(1e6)).alias("_span")
    )
    nyquist = 0.5 * F.col("_n") / F.col("_span")
    share = F.lit(float(frequency)) / nyquist
    message = F.lit("the cut-off frequency must lie between 0 and the Nyquist frequency")
    legal = F.when((share > 0) & (share < 1), share).otherwise(F.raise_error(message).cast("double"))
    k = F.tan(F.lit(math.pi / 2) * legal)
    rates = spans.select(*shape.keys, k.alias("_k")).select(
        *shape.keys,
        ((F.lit(1.0) if high else F.col("_k")) / (1 + F.col("_k"))).alias("_gain"),
        ((1 - F.col("_k")) / (1 + F.col("_k"))).alias("_decay"),
    )
    keys = list(shape.keys)
    blocks = lay_out(df.withColumn("_x", F.col(shape.value).cast("double")), shape)
    stepped = neighbour(blocks, {"_before": F.coalesce(F.col("_x"), F.lit(float("nan")))})
    rows = join_per_series(stepped.df, rates, keys)
    before = F.coalesce("_before", F.lit(0.0))
    x = F.coalesce(F.col("_x"), F.lit(float("nan")))
    driven = rows.withColumn("_drive", F.col("_gain") * ((x - before) if high else (x + before)))
    driven = driven.drop("_x", "_before", "_gain")

    order = [*shape.order]
    schema = T.StructType(
        [*driven.schema.fields, T.StructField("_y", T.DoubleType()), T.StructField("_pos", T.LongType())]
    )

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable", ignore_index=True)
        decay = pdf["_decay"].to_numpy(dtype=float)
        return pdf.assign(_y=_scan(pdf["_drive"].to_numpy(dtype=float), decay, np.sign(decay)), _pos=np.arange(1, len(pdf) + 1))

    local = driven.groupBy(*blocks.group).applyInPandas(run, schema)
    if blocks.split:
        ends = local.groupBy(*blocks.group).agg(
            F.max_by("_y", "_pos").alias("_last"), F.max("_pos").alias("_count"), F.first("_decay").alias("_rate")
        )
        carried = T.StructType([*ends.schema.fields, T.StructField("_carry", T.DoubleType())])

        def chain(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values(BLOCK, ignore_index=True)
            rate, count = pdf["_rate"].to_numpy(dtype=float), pdf["_count"].to_numpy()
            state = _scan(pdf["_last"].to_numpy(dtype=float), rate**count, np.sign(rate) ** count)
            return pdf.assign(_carry=np.concatenate([[0.0], state[:-1]]))

        carry = ends.groupBy(*keys).applyInPandas(chain, carried).select(*blocks.group, "_carry")
        # An infinite state does not fade with the power of the decay.
        odd = (F.col("_decay") < 0) & (F.col("_pos") % 2 == 1)
        endless = F.when(odd, -F.col("_carry")).otherwise(F.col("_carry"))
        faded = F.pow(F.col("_decay"), F.col("_pos")) * F.col("_carry")
        held = F.when(F.abs("_carry") == float("inf"), endless).otherwise(faded)
        local = join_null_safe(local, carry, blocks.group).withColumn("_y", F.col("_y") + held)
    result = F.when(~F.isnan("_y"), F.col("_y"))
    return local.withColumn(shape.value, result).select(*df.columns)
