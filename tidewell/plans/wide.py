"""Moving statistics over frames wider than a block.

A wide frame is the end of one block, whole blocks, and the start of another one. Blocks are summed up
once, and only the two border blocks of a frame are looked at row by row. Medians are found by counting:
sorted samples of the blocks bound the values that can be in the middle, and only these are fetched.
"""

from __future__ import annotations

from dataclasses import replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewell.frames import Shape, tick
from tidewell.plans import blocks as b
from tidewell.plans.rolling import Summary, medians, moments, result, statistics, summarise

#: Sorted samples of a block; a band of candidates is at most so much wider than needed as the blocks' number
#: divided by it.
SAMPLES = 512
#: Parts in which a block's rows are sent to the frames that begin or end in it.
SALTS = 16


def _bounded(numbered: DataFrame, shape: Shape, n: int | None, width: int | None) -> DataFrame:
    """``_first`` and ``_last``: the rows of a row's frame by number, from 0.

    For time frames the rows and two marks a row, one before the frame's first tick and one behind its last
    one, are put in order, and the rows before each mark are counted.
    """
    at = F.col("_row") - 1
    if width is None:
        return numbered.withColumns({"_first": F.greatest(at - (n - 1), F.lit(0)), "_last": at})
    marks = F.array(
        *[F.struct(when.cast("bigint").alias("t"), F.lit(kind).alias("k")) for when, kind in (
            (F.col("_tick") - (width - 1), 0), (F.col("_tick"), 1), (F.col("_tick"), 2),
        )]
    )
    events = numbered.select(*shape.keys, "_row", F.explode(marks).alias("_mark"))
    events = events.select(*shape.keys, "_row", F.col("_mark.t").alias("_tick"), F.col("_mark.k").alias("_kind"))
    laid = b.lay_out(events, Shape(shape.keys, "_tick", "_kind", ("_kind", "_row")))
    counted = b.running(laid, {"_rows": ("sum", F.when(F.col("_kind") == 1, 1).otherwise(0).cast("bigint"))}).df
    found = counted.where("_kind <> 1").groupBy(*shape.keys, "_row").agg(
        F.max(F.when(F.col("_kind") == 0, F.col("_rows"))).alias("_first"),
        (F.max(F.when(F.col("_kind") == 2, F.col("_rows"))) - 1).alias("_last"),
    )
    return b.join_null_safe(numbered, found, [*shape.keys, "_row"])


def _summed_up(block: pd.DataFrame, keys: list[str]) -> pd.DataFrame:
    """One row for a block: its summary and sorted samples of its values."""
    values = block["_v"].to_numpy(dtype=float)
    s = summarise(values, np.array([0]), np.array([len(values) - 1]))
    known = np.sort(values[~np.isnan(values)])
    places = np.unique(np.linspace(0, max(0, len(known) - 1), SAMPLES).astype(int)) if len(known) else np.array([], int)
    row = {k: [block[k].iloc[0]] for k in [*keys, "_b"]}
    row |= {c: [getattr(s, c)[0]] for c in ("n", "mean", "m2", "low", "high", "plus", "minus")}
    return pd.DataFrame({**row, "places": [places.tolist()], "samples": [known[places].tolist()]})


_SUMMARY = "n bigint, mean double, m2 double, low double, high double, plus bigint, minus bigint"


def _merged(part: pd.DataFrame) -> dict:
    """Summary of some blocks."""
    held = part[part["n"] > 0]
    n = int(held["n"].sum())
    weights = held["n"].to_numpy(dtype=float)
    means = held["mean"].to_numpy()
    mean = means[0] + float((weights * (means - means[0])).sum()) / n if n else np.nan
    m2 = float((held["m2"].to_numpy() + weights * (means - mean) ** 2).sum()) if n else np.nan
    extremes = (held["low"].min(), held["high"].max()) if n else (np.nan, np.nan)
    return dict(zip(_names(_SUMMARY), (n, mean, m2, *extremes, int(part["plus"].sum()), int(part["minus"].sum())), strict=True))


def _names(ddl: str) -> list[str]:
    return [f.split()[0] for f in ddl.split(", ")]


def _band(part: pd.DataFrame, around: int) -> tuple[float, float]:
    """Values between which the blocks' ``around`` values before and behind their middle lie for certain."""
    held = part[part["samples"].map(len) > 0]
    if not len(held):
        return -np.inf, np.inf
    samples = [np.asarray(s, dtype=float) for s in held["samples"]]
    places = [np.asarray(p, dtype=np.int64) for p in held["places"]]
    total = sum(int(p[-1]) + 1 for p in places)
    every = np.unique(np.concatenate(samples))

    def below_at_most(x: float) -> int:
        """No more values than this are less than x."""
        return sum(int(p[i]) if (i := int(np.searchsorted(s, x, "left"))) < len(s) else int(p[-1]) + 1 for s, p in zip(samples, places, strict=True))

    def up_to_at_least(x: float) -> int:
        """So many values at least are not above x."""
        return sum(int(p[i - 1]) + 1 if (i := int(np.searchsorted(s, x, "right"))) else 0 for s, p in zip(samples, places, strict=True))

    least, most = total // 2 - around, -(-total // 2) + around
    low, high = 0, len(every)  # the first sample that has too many values below it
    while low < high:
        at = (low + high) // 2
        low, high = (at + 1, high) if below_at_most(every[at]) <= least else (low, at)
    lower = float(every[low - 1]) if low else -np.inf
    low, high = 0, len(every)  # the first sample with enough values up to it
    while low < high:
        at = (low + high) // 2
        low, high = (low, at) if up_to_at_least(every[at]) >= most else (at + 1, high)
    return lower, float(every[low]) if low < len(every) else np.inf


def _middles(keys: list[str], around: int, kinds: set[str]):
    """For each pair of border blocks, the summary of the blocks between, and the band of its middle values."""

    def run(pairs: pd.DataFrame, sums: pd.DataFrame) -> pd.DataFrame:
        sums = sums.sort_values("_b", ignore_index=True)
        at = sums["_b"].to_numpy()
        rows = []
        for lb, hb in zip(pairs["_lb"], pairs["_hb"], strict=True):
            part = sums.iloc[np.searchsorted(at, lb + 1) : np.searchsorted(at, hb)]
            band = _band(part, around) if "median" in kinds else (np.nan, np.nan)
            rows.append({"_lb": lb, "_hb": hb, **_merged(part), "lower": band[0], "upper": band[1]})
        found = pd.DataFrame(rows)
        return found.assign(**{k: pairs[k].iloc[0] for k in keys})[[*keys, *found.columns]]

    return run


def _banded(keys: list[str]):
    """A block's values inside the bands of the frames that hold it whole, with their numbers; NaN: those below."""

    def run(wanted: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        values = np.sort(rows["_v"].dropna().to_numpy(dtype=float))
        out = []
        for lb, hb, lower, upper in zip(*(wanted[c] for c in ("_lb", "_hb", "lower", "upper")), strict=True):
            start, end = np.searchsorted(values, lower, "left"), np.searchsorted(values, upper, "right")
            known, count = np.unique(values[start:end], return_counts=True)
            out.append(pd.DataFrame({"_lb": lb, "_hb": hb, "value": np.append(known, np.nan), "count": np.append(count, start)}))
        found = pd.concat(out) if out else pd.DataFrame(columns=["_lb", "_hb", "value", "count"])
        return found.assign(**{k: (wanted[k].iloc[0] if len(wanted) else None) for k in keys})[[*keys, "_lb", "_hb", "value", "count"]]

    return run


def _around_middle(band: pd.DataFrame, total: int, around: int) -> np.ndarray:
    """Values for the middle of ``total`` ones: the band's, with as many infinite ones as it lies off the centre."""
    band = band.sort_values("value")
    below = int(band["count"][band["value"].isna()].sum())
    band = band[band["value"].notna()]
    ends = below + np.cumsum(band["count"].to_numpy(dtype=np.int64))
    starts = ends - band["count"].to_numpy(dtype=np.int64)
    low, high = max(0, total // 2 - around), min(total, -(-total // 2) + around)
    copies = np.clip(np.minimum(ends, high) - np.maximum(starts, low), 0, None)
    middle = np.repeat(band["value"].to_numpy(), copies)
    # Values before `low` and behind `high` cancel one by one; what is left over stands on one side.
    off = low - (total - high)
    return np.concatenate([np.full(max(off, 0), -np.inf), middle, np.full(max(-off, 0), np.inf)])


def _answers(keys: list[str], columns: dict[str, str], size: int, around: int):
    """All frames that begin in one block and end in another one, or in the same."""

    def run(key: tuple, parts: pd.DataFrame) -> pd.DataFrame:
        lb, hb = key[-2:]
        kind = parts["_tag"].to_numpy()
        frames = parts[kind == 0].sort_values("_last", ignore_index=True)
        first, last = (frames[c].to_numpy(dtype=np.int64) for c in ("_first", "_last"))
        rows = parts[kind == 1].sort_values("_first")
        at, values = rows["_first"].to_numpy(dtype=np.int64), rows["_v"].to_numpy(dtype=float)
        middle = parts[kind == 2]
        head, tail = values[at // size == lb], values[at // size == hb]
        if lb == hb:
            found = statistics(values, first - at[0], last - at[0], set(columns.values()))
        else:
            start, end = first - at[0], last - hb * size
            found = {}
            if len(middle):
                whole = {c: middle[c].iloc[0] for c in _names(_SUMMARY)}
                between = np.array([])
                if "median" in columns.values():
                    total = int(whole["n"]) + int(whole["plus"]) + int(whole["minus"])
                    between = _around_middle(parts[kind == 3].rename(columns={"_v": "value", "n": "count"}), total, around)
                summary = _across(head, tail, start, end, whole)
            else:
                between = np.array([])
                summary = summarise(np.concatenate([head, tail]), start, len(head) + end)
            for kind_ in set(columns.values()) - {"median"}:
                found[kind_] = result(kind_, summary)
            if "median" in columns.values():
                joined = np.concatenate([head, between, tail])
                found["median"] = medians(joined, start, len(head) + len(between) + end)
        made = {c: frames[c] for c in [*keys, "_last"]} | {out: found[kind_] for out, kind_ in columns.items()}
        return pd.DataFrame(made)

    return run


def _across(head: np.ndarray, tail: np.ndarray, start: np.ndarray, end: np.ndarray, whole: dict) -> Summary:
    """Frames from ``start`` of the head over whole blocks to ``end`` of the tail."""
    count = np.zeros(len(start), dtype=np.int64)
    reference = whole["mean"] if whole["n"] else None
    if reference is None:
        joined = summarise(np.concatenate([head, tail]), start, len(head) + end)
        return replace(joined, plus=joined.plus + whole["plus"], minus=joined.minus + whole["minus"])
    n, plus, minus = count + int(whole["n"]), count + int(whole["plus"]), count + int(whole["minus"])
    s1, s2 = np.zeros(len(start)), np.full(len(start), float(whole["m2"]))
    low, high = np.full(len(start), whole["low"]), np.full(len(start), whole["high"])
    with np.errstate(over="ignore", invalid="ignore"):
        for values, at in ((head[::-1], len(head) - 1 - start), (tail, end)):
            finite = np.isfinite(values)
            away = np.where(finite, values - reference, 0.0)
            s1 += np.cumsum(away)[at]
            s2 += np.cumsum(away**2)[at]
            n += np.cumsum(finite)[at]
            plus += np.cumsum(values == np.inf)[at]
            minus += np.cumsum(values == -np.inf)[at]
            low = np.minimum(low, np.minimum.accumulate(np.where(finite, values, np.inf))[at])
            high = np.maximum(high, np.maximum.accumulate(np.where(finite, values, -np.inf))[at])
        mean, m2 = moments(n, reference, s1, s2)
    return Summary(n, mean, m2, low, high, plus, minus)


def wide_frames(df: DataFrame, shape: Shape, columns: dict[str, str], n: int | None = None, width: int | None = None) -> DataFrame:
    """Statistics over the last ``n`` rows, or over ``(ts - width, ts]``, however many rows a frame holds.

    Rows are numbered and cut into blocks of equally many. Frames with the same first and last block are
    answered in one task, from the rows of these two blocks, one summary of all blocks between, and for medians
    the values around the middle of these blocks. So a task holds about four blocks even where a frame is as
    long as its series. Results go back to the rows by the number of a frame's last row, which
    rows of one timestamp share; a block asks once for each.
    """
    keys = list(shape.keys)
    size = max(1, b.block_rows(df) // 2)
    kinds = set(columns.values())
    around = size + 2
    laid = b.lay_out(df.withColumn("_tick", tick(df, shape.ts)) if width is not None else df, shape)
    numbered = b.pin(b.number_rows(laid).df.drop(b.BLOCK))
    home = {"_b": F.floor((F.col("_row") - 1) / size), "_lb": F.floor(F.col("_first") / size), "_hb": F.floor(F.col("_last") / size)}
    rows = b.pin(_bounded(numbered, shape, n, width).withColumns(home))
    held = rows.select(*keys, "_b", (F.col("_row") - 1).alias("_first"), F.col(shape.value).cast("double").alias("_v"))
    kept = T.StructType([f for f in rows.schema.fields if f.name in keys])

    def schema(fields: str) -> T.StructType:
        return T.StructType([*kept.fields, *T._parse_datatype_string(fields).fields])

    sums = held.groupBy(*keys, "_b").applyInPandas(
        lambda block: _summed_up(block, keys), schema(f"_b bigint, {_SUMMARY}, places array<bigint>, samples array<double>")
    )
    frames = rows.select(*keys, "_lb", "_hb", "_first", "_last").distinct()
    pairs = b.settle(frames.select(*keys, "_lb", "_hb").distinct())
    far = pairs.where("_hb - _lb > 1")
    middles = far.withColumn("_all", F.lit(0)).groupBy(*keys, "_all").cogroup(
        sums.withColumn("_all", F.lit(0)).groupBy(*keys, "_all")
    ).applyInPandas(_cut(_middles(keys, around, kinds)), schema(f"_lb bigint, _hb bigint, {_SUMMARY}, lower double, upper double"))
    middles = b.pin(middles)
    parts = [
        frames.select(*keys, "_lb", "_hb", F.lit(0).alias("_tag"), "_first", "_last"),
        _to_pairs(held, pairs, keys).select(*keys, "_lb", "_hb", F.lit(1).alias("_tag"), "_first", "_v"),
        middles.select(*keys, "_lb", "_hb", F.lit(2).alias("_tag"), *_names(_SUMMARY)),
    ]
    if "median" in kinds:
        wanted = middles.withColumn("_b", F.explode(F.sequence(F.col("_lb") + 1, F.col("_hb") - 1)))
        banded = wanted.select(*keys, "_b", "_lb", "_hb", "lower", "upper").groupBy(*keys, "_b").cogroup(
            held.groupBy(*keys, "_b")
        ).applyInPandas(_cut(_banded(keys)), schema("_lb bigint, _hb bigint, value double, count bigint"))
        counted = banded.groupBy(*keys, "_lb", "_hb", "value").agg(F.sum("count").alias("n"))
        parts.append(counted.select(*keys, "_lb", "_hb", F.lit(3).alias("_tag"), F.col("value").alias("_v"), "n"))
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part, allowMissingColumns=True)
    made = ", ".join(f"`{out}` double" for out in columns)
    answered = every.groupBy(*keys, "_lb", "_hb").applyInPandas(
        _answers(keys, columns, size, around), schema(f"_last bigint, {made}")
    )
    asked = b.join_null_safe(rows.select(*keys, "_b", "_last").distinct(), answered, [*keys, "_last"])
    framed = b.join_null_safe(rows, asked, [*keys, "_b", "_last"])
    defined = {out: F.when(~F.isnan(out), F.col(out)) for out in columns}
    if n is not None:
        defined = {out: F.when(F.col("_row") >= n, value) for out, value in defined.items()}
    return framed.withColumns(defined).drop("_row", "_first", "_last", "_b", "_lb", "_hb", "_tick")


def _cut(function):
    """The function of two groups where both have rows, else none."""

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        return function(left, right) if len(left) and len(right) else pd.DataFrame()

    return run


def _to_pairs(held: DataFrame, pairs: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of a block, copied to every pair that begins or ends in it; parts of a block in tasks of their own."""
    ends = pairs.withColumn("_b", F.explode(F.array_distinct(F.array("_lb", "_hb"))))
    ends = ends.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = held.withColumn("_salt", F.pmod("_first", F.lit(SALTS)).cast("int"))
    return b.join_null_safe(salted, ends, [*keys, "_b", "_salt"])
