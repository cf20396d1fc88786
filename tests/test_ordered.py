"""Ordered operators against brute force, in every layout of the series."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from conftest import assert_close, by_place, long_frame, ordered, random_series, to_spark
from pyspark.sql import functions as F

from tidewell.frames import FrameError, Shape
from tidewell.operators import aggregates, filters, health, recursive, windows
from tidewell.plans import blocks
from tidewell.plans.ranks import quantiles

SHAPE = Shape(tie=("place",))


def expect(frame: pd.DataFrame, per_series) -> dict:
    out = {}
    for _, part in ordered(frame).groupby("metric"):
        out.update(zip(part["place"], per_series(part), strict=True))
    return out


@pytest.mark.parametrize("kind", ["mean", "std", "min", "max", "median"])
def test_moving_number_of_many_rows(spark, layout, kind):
    frame = random_series(3)
    known = frame.dropna()
    found = by_place(windows.moving_number(to_spark(spark, frame), kind, 210, SHAPE))
    assert_close(found, expect(known, lambda part: getattr(part["value"].rolling(210), kind)()))


@pytest.mark.parametrize("periods", [1, -3, 60, -200])
def test_long_shifts(spark, layout, periods):
    frame = random_series(6)
    found = by_place(windows.shift_values(to_spark(spark, frame), periods, SHAPE))
    assert_close(found, expect(frame, lambda part: part["value"].shift(periods)))


@pytest.mark.parametrize("kind", ["mean", "std", "median"])
def test_moving_number(spark, layout, kind):
    frame = random_series(1)
    known = frame.dropna()
    found = by_place(windows.moving_number(to_spark(spark, frame), kind, 7, SHAPE))
    assert_close(found, expect(known, lambda p: getattr(p["value"].rolling(7), kind)()))


def peers(part: pd.DataFrame, width: int, kind: str) -> list[float]:
    at = part["timestamp"].astype("int64").to_numpy() // 1000
    values = part["value"].to_numpy()
    return [getattr(pd.Series(values[(at > t - width) & (at <= t)]), kind)() for t in at]


KINDS = ["mean", "std", "min", "max", "median"]


@pytest.mark.parametrize("dense", [0, 10**9])
@pytest.mark.parametrize("seconds", [1, 300])
def test_moving_time(spark, layout, seconds, dense, monkeypatch):
    """All statistics, once as windows and once as rolling blocks, against brute force."""
    monkeypatch.setattr(blocks, "DENSE_FRAME_ROWS", dense)
    frame = random_series(2)
    rows = to_spark(spark, frame).na.drop("any")
    kinds = KINDS if dense == 0 else KINDS[:4]
    found = blocks.time_frames(rows, SHAPE, seconds * 1_000_000, {k: k for k in kinds}).cache()
    for kind in kinds:
        assert_close(by_place(found, kind), expect(frame.dropna(), lambda p, k=kind: peers(p, seconds * 1_000_000, k)))


def with_infinities() -> pd.DataFrame:
    frame = random_series(8)
    frame.loc[frame.index[5:400:40], "value"] = np.inf
    frame.loc[frame.index[21:400:80], "value"] = -np.inf
    return frame


def extended(values: pd.Series, kind: str) -> float:
    """The statistic where infinite values count; NaN where it isn't defined."""
    values = values.dropna().to_numpy()
    if not len(values) or (kind == "std" and (len(values) < 2 or np.isinf(values).any())):
        return np.nan
    with np.errstate(invalid="ignore"):
        return values.std(ddof=1) if kind == "std" else getattr(np, kind)(values)


@pytest.mark.parametrize("dense", [0, 10**9])
def test_infinite_values_in_time_frames(spark, layout, dense, monkeypatch):
    monkeypatch.setattr(blocks, "DENSE_FRAME_ROWS", dense)
    frame, width = with_infinities(), 60_000_000
    rows = to_spark(spark, frame).na.drop("any")
    kinds = KINDS if dense == 0 else KINDS[:4]
    found = blocks.time_frames(rows, SHAPE, width, {k: k for k in kinds}).cache()

    def frames(part, kind):
        at, values = part["timestamp"].astype("int64").to_numpy() // 1000, part["value"]
        return [extended(values[(at > t - width) & (at <= t)], kind) for t in at]

    for kind in kinds:
        assert_close(by_place(found, kind), expect(frame.dropna(), lambda p, k=kind: frames(p, k)))


@pytest.mark.parametrize("dense", [0, 10**9])
@pytest.mark.parametrize("kind", KINDS)
def test_infinite_values_in_row_frames(spark, kind, dense, monkeypatch):
    monkeypatch.setattr(windows, "DENSE_FRAME_ROWS", dense)
    frame = with_infinities()

    def frames(part):
        values = part["value"]
        return [np.nan if k < 6 else extended(values.iloc[k - 6 : k + 1], kind) for k in range(len(values))]

    assert_close(by_place(windows.moving_number(to_spark(spark, frame), kind, 7, SHAPE)), expect(frame.dropna(), frames))


def test_time_frame_is_open_on_the_left(spark, layout):
    at = pd.to_datetime([0, 9_999_999, 10_000_000, 19_999_999], unit="us")
    frame = pd.DataFrame({"timestamp": at, "metric": "a", "value": [1.0, 2.0, 4.0, 8.0], "place": range(4)})
    found = by_place(windows.moving_time(to_spark(spark, frame), "max", "10s", SHAPE))
    assert found == {0: 1.0, 1: 2.0, 2: 4.0, 3: 8.0}
    mean = by_place(windows.moving_time(to_spark(spark, frame), "mean", "10s", SHAPE))
    assert mean == {0: 1.0, 1: 1.5, 2: 3.0, 3: 6.0}


def test_smoothing_keeps_missing_rows(spark, layout):
    frame = random_series(3, repeated=False)
    found = by_place(windows.smooth(to_spark(spark, frame), "2min", SHAPE))
    assert_close(found, expect(frame, lambda p: p.set_index("timestamp")["value"].rolling("2min").mean()))


def test_outlier_filter(spark, layout):
    frame = random_series(4, repeated=False, missing=0)
    kept = windows.filter_outliers(to_spark(spark, frame), 1.2, "5min", SHAPE)

    def inside(part):
        rolled = part.set_index("timestamp")["value"].rolling("5min")
        mean, std = rolled.mean().to_numpy(), rolled.std().to_numpy()
        value = part["value"].to_numpy()
        return (value > mean - 1.2 * std) & (value < mean + 1.2 * std)

    assert set(by_place(kept)) == {k for k, v in expect(frame, inside).items() if v}


def test_cumulative_sum(spark, layout):
    frame = random_series(5)
    found = by_place(windows.cumulative_sum(to_spark(spark, frame), SHAPE))
    assert_close(found, expect(frame, lambda p: p["value"].cumsum()))


def test_consecutive_differences(spark, layout):
    frame = random_series(6)
    found = by_place(windows.consecutive_differences(to_spark(spark, frame), SHAPE))
    expected = {k: v for k, v in expect(frame.dropna(), lambda p: p["value"].diff()).items() if not np.isnan(v)}
    assert_close(found, expected)


def test_derivative(spark, layout):
    frame = random_series(7, repeated=False)
    found = by_place(windows.derivative(to_spark(spark, frame), SHAPE))
    seconds = 1e9

    def quotient(part):
        return part["value"].diff() / (part["timestamp"].astype("int64").diff() / seconds)

    expected = {k: v for k, v in expect(frame.dropna(), quotient).items() if not np.isnan(v)}
    assert_close(found, expected)


@pytest.mark.parametrize("periods", [-2, 40])
def test_shift_values(spark, layout, periods):
    frame = random_series(8)
    found = by_place(windows.shift_values(to_spark(spark, frame), periods, SHAPE))
    assert_close(found, expect(frame, lambda p: p["value"].shift(periods)))


def crossings(values: np.ndarray, low: float, high: float, edge: int) -> list[int]:
    state, count, out = 0, 0, []
    for v in values:
        new = 1 if v > high else -1 if v < low else 0
        if new and state and new != state and (edge == 0 or new == np.sign(edge)):
            count += 1
        state = new or state
        out.append(count)
    return out


@pytest.mark.parametrize("edge", [0, 1, -1])
def test_level_crossings(spark, layout, edge):
    frame = random_series(9)
    found = by_place(windows.count_level_crossings(to_spark(spark, frame), 50, 10, edge, SHAPE), "crossings")
    assert found == expect(frame, lambda p: crossings(p["value"].to_numpy(), 45, 55, edge))


@pytest.mark.parametrize("direction", ["forward", "backward", "both"])
@pytest.mark.parametrize("area", [None, "inside", "outside"])
def test_interpolate_limits(spark, layout, direction, area):
    frame = ordered(random_series(seed=5, rows=80, repeated=False, missing=0.5))
    rows = to_spark(spark, frame).drop("place")
    none = rows.where("1 = 0").withColumn("value", F.lit(True))
    found = windows.interpolate(rows, none, limit_direction=direction, limit=2, limit_area=area)["interpolated"]
    got = {(r["metric"], r["timestamp"].replace(tzinfo=None)): r["value"] for r in found.collect()}
    want = {}
    for metric, part in frame.groupby("metric"):
        series = part.set_index("timestamp")["value"]
        if series.notna().any():
            series = series.interpolate("time", limit_direction=direction, limit=2, limit_area=area)
        want.update({(metric, t.to_pydatetime()): v for t, v in series.items()})
    assert_close(got, want)


def test_interpolate(spark, layout):
    frame = random_series(10, repeated=False).drop_duplicates(["metric", "timestamp"])
    rows = to_spark(spark, frame)
    flags = rows.where(F.col("place") % 4 == 0).select("timestamp", "metric", F.lit(True).alias("value"))
    parts = windows.interpolate(rows.drop("place"), flags, limit_direction="both")
    found = {(r["metric"], r["timestamp"]): r["value"] for r in parts["interpolated"].collect()}

    for metric, part in ordered(frame).groupby("metric"):
        series = part.assign(value=part["value"].where(part["place"] % 4 != 0)).set_index("timestamp")["value"]
        want = series.interpolate("time", limit_direction="both")
        for at, value in want.items():
            got = found[(metric, at.to_pydatetime())]
            assert (got is None) if np.isnan(value) else got == pytest.approx(value)
    assert parts["new_values"].count() == (frame["place"] % 4 == 0).sum()


@pytest.mark.parametrize("method", ["ffill", "bfill", "linear"])
def test_interpolate_methods(spark, method):
    at = pd.to_datetime(np.arange(6) * 1_000_000, unit="us")
    value = [np.nan, 1.0, np.nan, np.nan, 4.0, np.nan]
    frame = pd.DataFrame({"timestamp": at, "metric": "a", "value": value, "place": range(6)})
    none = to_spark(spark, frame).limit(0).select("timestamp", "metric", F.lit(True).alias("value"))
    full = windows.interpolate(to_spark(spark, frame).drop("place"), none, method)["interpolated"]
    found = [r["value"] for r in full.orderBy("timestamp").collect()]
    series = pd.Series(value, index=at)
    want = getattr(series, method)() if method != "linear" else series.interpolate("time")
    assert found == [None if np.isnan(v) else v for v in want]


def test_thin_out(spark, layout):
    frame = random_series(11)
    found = set(by_place(filters.thin_out(to_spark(spark, frame), 50, SHAPE)))
    want = set()
    for _, part in ordered_by_order(frame).groupby("metric"):
        n = round((len(part) - 1) / 49) if len(part) >= 50 else 1
        want |= set(part["place"].iloc[:: max(n, 1)])
    assert found == want


def ordered_by_order(frame):
    return frame.sort_values(["metric", "timestamp", "place"], ignore_index=True)


@pytest.mark.parametrize("high", [False, True])
def test_recursive_filters(spark, layout, high):
    frame = random_series(12, repeated=False, missing=0).query("metric != 'single'")
    filtered = (recursive.highpass if high else recursive.lowpass)(to_spark(spark, frame), 0.001, SHAPE)

    def loop(part):
        at = part["timestamp"].astype("int64").to_numpy() / 1e9
        nyquist = 0.5 * len(part) / (at[-1] - at[0])
        k = np.tan(np.pi / 2 * 0.001 / nyquist)
        a = (k - 1) / (k + 1)
        b0, b1 = (1 / (1 + k), -1 / (1 + k)) if high else (k / (1 + k), k / (1 + k))
        y, x_before, y_before = [], 0.0, 0.0
        for x in part["value"]:
            y_before = b0 * x + b1 * x_before - a * y_before
            x_before = x
            y.append(y_before)
        return y

    assert_close(by_place(filtered), expect(frame, loop))


def test_lowpass_missing_input_spoils_the_rest(spark, layout):
    frame = random_series(13, repeated=False, missing=0).query("metric == 'big'")
    late = frame["timestamp"].sort_values().iloc[200]
    frame.loc[frame["timestamp"] == late, "value"] = np.nan
    found = by_place(recursive.lowpass(to_spark(spark, frame), 0.001, SHAPE))
    for place, at in zip(frame["place"], frame["timestamp"], strict=True):
        assert (found[place] is None) == (at >= late)


def test_alerts(spark, layout):
    frame = random_series(14)
    found = by_place(health.alerts_from_score(to_spark(spark, frame), 60, SHAPE), "alert")
    assert found == expect(frame, lambda p: (p["value"] > 60).astype(int).diff().fillna(0).astype(int))


def test_golden_alerts(spark):
    at = pd.to_datetime([0, 1, 2], unit="s")
    frame = pd.DataFrame({"timestamp": at, "metric": "a", "value": [42.2, 18.7, 25.9], "place": range(3)})
    assert by_place(health.alerts_from_score(to_spark(spark, frame), 30, SHAPE), "alert") == {0: 0, 1: -1, 2: 0}


def test_distributing_duplicates(spark, layout):
    frame = random_series(15)
    frame["timestamp"] = frame["timestamp"].dt.floor("20s")
    found = by_place(windows.merge_distributing_duplicates(to_spark(spark, frame), "8s", Shape(tie=("place",))), "timestamp")
    rows = frame.sort_values(["timestamp", "place"], ignore_index=True)
    distinct = sorted(rows["timestamp"].unique())
    following = dict(zip(distinct, distinct[1:], strict=False))
    limit = pd.Timedelta("8s")
    for at, part in rows.groupby("timestamp"):
        span = min(following.get(at, at + limit) - at, limit)
        for k, place in enumerate(part["place"]):
            moved = at + pd.Timedelta((k * span.value // 1000) // len(part), unit="us")
            assert found[place] == moved.to_pydatetime()
    assert len(set(found.values())) == len(found)


@pytest.mark.parametrize("p", [0.05, 0.5, 1.0])
def test_quantiles(spark, layout, p):
    frame = random_series(16).dropna()
    rows = to_spark(spark, frame)
    linear = {r["metric"]: r["quantiles"][0] for r in quantiles(rows, ["metric"], "value", [p]).collect()}
    nearest = {r["metric"]: r["quantiles"][0] for r in quantiles(rows, ["metric"], "value", [p], nearest=True).collect()}
    for metric, part in frame.groupby("metric"):
        assert linear[metric] == pytest.approx(part["value"].quantile(p))
        assert nearest[metric] == part["value"].quantile(p, interpolation="nearest")


def test_summary(spark, layout):
    frame = random_series(17)
    rows = {r["metric"]: r for r in aggregates.summary(to_spark(spark, frame), SHAPE).collect()}
    for metric, part in ordered(frame).groupby("metric"):
        row, described = rows[metric], part["value"].describe(percentiles=list(aggregates.SUMMARY_PERCENTILES))
        assert row["length"] == len(part)
        assert row["value_mean"] == pytest.approx(described["mean"])
        assert row["value_percentiles"] == pytest.approx(list(described[4:11]))
        assert row["duplicate_index"] == part["timestamp"].duplicated().sum()
        gaps = part["timestamp"].diff().dropna().dt.total_seconds()
        assert row["distance_count"] == len(gaps)
        if len(gaps):
            assert row["distance_max"] == pytest.approx(gaps.max())


def test_integrate(spark, layout):
    frame = random_series(18, repeated=False).query("metric != 'single'")
    found = {r["metric"]: r["integral"] for r in aggregates.integrate(to_spark(spark, frame), SHAPE).collect()}
    for metric, part in ordered(frame.dropna()).groupby("metric"):
        seconds = part["timestamp"].astype("int64") / 1e9
        assert found[metric] == pytest.approx(np.trapezoid(part["value"], seconds))


def test_integrate_needs_two_points(spark):
    with pytest.raises(Exception, match="two points"):
        aggregates.integrate(to_spark(spark, random_series(18)), SHAPE).collect()


def test_one_series_without_keys(spark, layout):
    frame = random_series(19)
    shape = Shape((), tie=("place",))
    found = by_place(windows.cumulative_sum(to_spark(spark, frame), shape))
    rows = frame.sort_values(["timestamp", "place"])
    assert_close(found, dict(zip(rows["place"], rows["value"].cumsum(), strict=True)))


def test_empty_frame(spark):
    empty = to_spark(spark, random_series(20)).limit(0)
    assert windows.cumulative_sum(empty, SHAPE).count() == 0
    assert windows.moving_time(empty, "mean", "1h", SHAPE).count() == 0
    assert windows.moving_number(empty, "mean", 3, SHAPE).count() == 0


def test_all_rows_on_one_timestamp(spark, monkeypatch):
    """A burst that no time cell can split: the range sort spreads it by the tie-break."""
    spark.conf.set(blocks.BLOCK_ROWS_CONF, "20")
    try:
        frame = random_series(21, missing=0)
        frame.loc[frame["metric"] == "big", "timestamp"] = pd.Timestamp(0)
        rows = to_spark(spark, frame)
        laid = blocks.lay_out(rows, SHAPE)
        biggest = laid.df.groupBy(*laid.group).count().agg(F.max("count")).first()[0]
        assert laid.split and biggest <= 3 * 20
        found = by_place(windows.cumulative_sum(rows, SHAPE))
        assert_close(found, expect(frame, lambda p: p["value"].cumsum()))
        moved = by_place(windows.moving_time(rows, "median", "1s", SHAPE))
        assert_close(moved, expect(frame, lambda p: peers(p, 1_000_000, "median")))
    finally:
        spark.conf.unset(blocks.BLOCK_ROWS_CONF)


@pytest.mark.parametrize("kind, n", [("std", 30), ("median", 30), ("median", 333), ("mean", 333), ("max", 333)])
def test_row_frames_wider_than_a_block(spark, layout, kind, n):
    frame = with_infinities()

    def frames(part):
        values = part["value"]
        return [np.nan if k < n - 1 else extended(values.iloc[k - n + 1 : k + 1], kind) for k in range(len(values))]

    assert_close(by_place(windows.moving_number(to_spark(spark, frame), kind, n, SHAPE)), expect(frame.dropna(), frames))


@pytest.mark.parametrize("seconds", [400, 100_000])
def test_time_frames_as_long_as_a_series(spark, layout, seconds):
    frame = random_series(5)
    rows = to_spark(spark, frame)
    found = blocks.time_frames(rows, SHAPE, seconds * 1_000_000, {k: k for k in KINDS}).cache()
    for kind in KINDS:
        assert_close(by_place(found, kind), expect(frame, lambda p, k=kind: peers(p, seconds * 1_000_000, k)))


@pytest.mark.parametrize("kind", KINDS)
def test_one_value_over_most_of_a_series(spark, layout, kind):
    """Medians among values that are mostly equal, and one timestamp that holds a third of the rows."""
    frame = random_series(12, missing=0)
    frame.loc[frame.index[: len(frame) * 2 // 3], "value"] = 3.0
    frame.loc[frame.index[100:280], "timestamp"] = pd.Timestamp("1970-01-01 00:20:00")
    found = by_place(windows.moving_time(to_spark(spark, frame), kind, "40min", SHAPE))
    assert_close(found, expect(frame, lambda p: peers(p, 2_400_000_000, kind)))


@pytest.mark.parametrize("n", [199, 200, 201, 260])
def test_a_huge_value_leaves_no_trace(spark, layout, n):
    """Deviations on both sides of the change of plans, long after a value of 1e12."""
    values = [0.1 * (i % 7) for i in range(600)]
    values[10] = 1e12
    frame = pd.DataFrame({"timestamp": pd.to_datetime(np.arange(600), unit="s"), "metric": "a", "value": values, "place": range(600)})
    rows = to_spark(spark, frame)
    for found, width in ((windows.moving_number(rows, "std", n, SHAPE), n), (windows.moving_time(rows, "std", f"{n}s", SHAPE), n)):
        got = by_place(found)
        assert all(got[i] == pytest.approx(np.std(values[i - width + 1 : i + 1], ddof=1), rel=1e-9) for i in range(n + 10, 600))
    kept = by_place(windows.filter_outliers(rows, 1.2, f"{n}s", SHAPE))
    inside = [abs(v - np.mean(w)) < 1.2 * np.std(w, ddof=1) for v, w in ((values[i], values[i - n + 1 : i + 1]) for i in range(n + 10, 600))]
    assert sorted(k for k in kept if k >= n + 10) == [i for i, x in zip(range(n + 10, 600), inside, strict=True) if x]


def test_wide_frames_of_null_keys(spark, layout):
    frame = random_series(7, missing=0)
    rows = to_spark(spark, frame).withColumn("metric", F.when(F.col("metric") != "big", F.col("metric")))
    found = by_place(windows.moving_time(rows, "median", "1h", SHAPE))
    assert_close(found, expect(frame, lambda p: peers(p, 3_600_000_000, "median")))


def test_tasks_of_wide_frames_hold_few_blocks(spark, monkeypatch, tmp_path):
    """Frames as long as the series: what one task gets is bounded by the block, not by the series."""
    from tidewell.plans import wide

    seen, inner = str(tmp_path / "sizes"), wide._answers

    def watched(*args):
        run = inner(*args)

        def count(key, parts):
            with open(seen, "a", encoding="utf-8") as file:
                file.write(f"{len(parts)}\n")
            return run(key, parts)

        return count

    monkeypatch.setattr(wide, "_answers", watched)
    spark.conf.set(blocks.BLOCK_ROWS_CONF, "200")
    at = pd.to_datetime(np.arange(4000), unit="s")
    frame = pd.DataFrame({"timestamp": at, "metric": "a", "value": np.arange(4000) % 97 * 1.0, "place": range(4000)})
    found = by_place(windows.moving_time(to_spark(spark, frame), "median", "4000s", SHAPE))
    spark.conf.unset(blocks.BLOCK_ROWS_CONF)
    assert found[3999] == np.median(np.arange(4000) % 97) and found[10] == 5.0
    with open(seen, encoding="utf-8") as file:
        assert 0 < max(map(int, file)) <= 4 * 200



@pytest.mark.parametrize("high", [False, True])
@pytest.mark.parametrize("odd", [[np.nan], [np.inf], [-np.inf, -np.inf], [np.inf, -np.inf], [np.inf, np.nan]])
def test_missing_and_infinite_inputs_of_long_series(spark, high, odd):
    """A missing input spoils all that follows, over far more rows than the decay reaches, in every layout."""
    rows = 12_000
    values = np.random.default_rng(4).normal(0, 1, rows)
    values[10], values[40 : 40 + len(odd) - 1] = odd[0], odd[1:]
    at = pd.to_datetime(np.arange(rows), unit="s")
    frame = to_spark(spark, pd.DataFrame({"timestamp": at, "metric": "a", "value": values, "place": range(rows)}))
    k = np.tan(np.pi / 2 * 0.05 / (0.5 * rows / (rows - 1)))
    gain, decay, state, before, want = (1.0 if high else k) / (1 + k), (1 - k) / (1 + k), 0.0, 0.0, {}
    for i, x in enumerate(values.tolist()):
        state = gain * (x - before if high else x + before) + decay * state
        want[i], before = (None if np.isnan(state) else state), x
    operator = recursive.highpass if high else recursive.lowpass
    for limit in (100_000, 1000):
        spark.conf.set(blocks.BLOCK_ROWS_CONF, str(limit))
        found = by_place(operator(frame, 0.05, SHAPE))
        spark.conf.unset(blocks.BLOCK_ROWS_CONF)
        assert_close(found, want)


def plain_curve(kind: str, x: np.ndarray, y: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The curve through all points of one series, by a direct solve; beyond the ends the outer pieces go on."""
    n, h = len(x), np.diff(x)
    m = np.diff(y) / h
    if n == 2:
        s = np.array([m[0], m[0]])
    elif kind == "spline":
        system, right = np.zeros((n, n)), np.zeros(n)
        for i in range(1, n - 1):
            system[i, i - 1 : i + 2] = h[i - 1], 2 * (h[i - 1] + h[i]), h[i]
            right[i] = 6 * (m[i] - m[i - 1])
        system[0, :3] = h[1], -(h[0] + h[1]), h[0]
        system[-1, -3:] = h[-1], -(h[-2] + h[-1]), h[-2]
        if n == 3:
            system[0, :3], system[-1, -3:] = (1, -1, 0), (0, -1, 1)
        c = np.linalg.solve(system, right)
        s = np.append(m - h * (2 * c[:-1] + c[1:]) / 6, m[-1] + h[-1] * (2 * c[-1] + c[-2]) / 6)
    elif kind == "pchip":
        def end(h0, h1, m0, m1):
            d = ((2 * h0 + h1) * m0 - h0 * m1) / (h0 + h1)
            if np.sign(d) != np.sign(m0):
                return 0.0
            return 3 * m0 if np.sign(m0) != np.sign(m1) and abs(d) > 3 * abs(m0) else d

        s = np.zeros(n)
        s[0], s[-1] = end(h[0], h[1], m[0], m[1]), end(h[-1], h[-2], m[-1], m[-2])
        for i in range(1, n - 1):
            if m[i - 1] * m[i] > 0:
                w1, w2 = 2 * h[i] + h[i - 1], h[i] + 2 * h[i - 1]
                s[i] = (w1 + w2) / (w1 / m[i - 1] + w2 / m[i])
    else:
        left, right = [3 * m[0] - 2 * m[1], 2 * m[0] - m[1]], [2 * m[-1] - m[-2], 3 * m[-1] - 2 * m[-2]]
        e = np.concatenate([left, m, right])
        d = np.abs(np.diff(e))
        f1, f2 = d[2:], d[:-2]
        s = np.where(f1 + f2 > 1e-9 * (f1 + f2).max(), (f1 * e[1:-2] + f2 * e[2:-1]) / np.where(f1 + f2 > 0, f1 + f2, 1), (e[3:] + e[:-3]) / 2)
    k = np.clip(np.searchsorted(x, at, side="right") - 1, 0, n - 2)
    u = at - x[k]
    q = (3 * m[k] - 2 * s[k] - s[k + 1]) / h[k]
    r = (s[k] + s[k + 1] - 2 * m[k]) / h[k] ** 2
    found = y[k] + u * (s[k] + u * (q + u * r))
    return found if kind != "akima" else np.where((at < x[0]) | (at > x[-1]), np.nan, found)


@pytest.mark.parametrize(
    "method, kind, direction", [("pchip", "pchip", "both"), ("akima", "akima", "both"), ("cubicspline", "spline", "forward"), ("cubic", "spline", "both")]
)
def test_curves_equal_a_direct_solve(spark, method, kind, direction):
    curves_equal_a_direct_solve(spark, method, kind, direction)


def test_splines_over_blocks_equal_a_direct_solve(spark, monkeypatch):
    """The small system of the block borders, in time cells and in range-sorted parts."""
    spark.conf.set(blocks.BLOCK_ROWS_CONF, "90")
    curves_equal_a_direct_solve(spark, "cubicspline", "spline", "both")
    monkeypatch.setattr(blocks, "HOT_FACTOR", 0)
    curves_equal_a_direct_solve(spark, "cubicspline", "spline", "both")
    spark.conf.unset(blocks.BLOCK_ROWS_CONF)


def curves_equal_a_direct_solve(spark, method, kind, direction):
    rng = np.random.default_rng(9)
    rows, flagged, want = [], [], {}
    for metric, count in (("many", 260), ("flat", 60), ("four", 4), ("three", 3), ("two", 2), (None, 30)):
        at = np.sort(rng.choice(4_000, count + 20, replace=False)) * 1_000_000
        value = np.where(rng.random(len(at)) < 0.3, 5.0, np.round(rng.normal(0, 9, len(at)), 1)) if metric != "flat" else np.repeat([1.0, 3.0], len(at))[: len(at)]
        gone = np.sort(rng.choice(len(at), 20, replace=False))
        stays = np.setdiff1d(np.arange(len(at)), gone)
        moment = [pd.Timestamp(int(t), unit="us", tz="UTC").to_pydatetime() for t in at]
        rows += [(moment[i], metric, float(value[i])) for i in range(len(at)) if i % 2 or i in stays]
        flagged += [(moment[i], metric, True) for i in gone] + [(moment[i], metric, False) for i in stays[:3]]
        curve = plain_curve(kind, at[stays] / 1e6, value[stays], at / 1e6)
        inside = (np.arange(len(at)) >= stays[0]) & (np.arange(len(at)) <= stays[-1])
        want[metric] = {moment[i]: (value[i] if i in stays else curve[i] if inside[i] or method in ("pchip", "cubicspline") else np.nan) for i in range(len(at))}
    frame = spark.createDataFrame(rows, "timestamp timestamp, metric string, value double").repartition(3)
    flags = spark.createDataFrame(flagged, "timestamp timestamp, metric string, value boolean")
    found = windows.interpolate(frame, flags, method=method, limit_direction=direction)["interpolated"]
    got: dict = {}
    for r in found.select("metric", F.unix_micros("timestamp").alias("t"), "value").collect():
        got.setdefault(r["metric"], {})[r["t"]] = r["value"]
    assert got.keys() == want.keys()
    blank = {(m, t) for t, m, flag in flagged if flag}
    for metric, values in want.items():
        first = min(t for t, m, _ in rows if m == metric and (m, t) not in blank)
        for t, v in values.items():
            have = got[metric][int(t.timestamp() * 1e6 + 0.5)]
            if np.isnan(v) or (direction == "forward" and t < first):
                assert have is None
            else:
                assert have == pytest.approx(v, rel=1e-7, abs=1e-7), (metric, t)


def test_curves_of_few_points_and_limits(spark):
    rows = long_frame(spark, [(f"2024-01-01T00:0{i}:00Z", float(v)) for i, v in enumerate([1, 2, 4, 8, 9])])
    none = long_frame(spark, [("2024-01-01T00:00:00Z", "b", 1.0)])
    flags = rows.where("minute(timestamp) in (1, 2)").withColumn("value", F.lit(True)).unionByName(
        long_frame(spark, [("2024-01-01T00:05:00Z", "a", 0.0), ("2024-01-01T00:01:00Z", "b", 0.0)]).withColumn("value", F.lit(True))
    )
    both = rows.unionByName(none)
    one = {(r["metric"], r["timestamp"].minute): r["value"] for r in windows.interpolate(both, flags, "pchip", limit=1)["new_values"].collect()}
    assert one["a", 2] is None and one["b", 1] is None and one["a", 1] is not None and one["a", 5] is not None
    inside = windows.interpolate(both, flags, "cubicspline", "both", limit_area="inside")["new_values"].where("value is not null")
    assert sorted(r["timestamp"].minute for r in inside.collect()) == [1, 2]
    with pytest.raises(FrameError):
        windows.interpolate(both, flags, "polynomial", order=2)
    with pytest.raises(Exception, match="duplicate index"):
        windows.interpolate(rows.unionByName(rows), flags, "akima")["interpolated"].collect()
