"""Row-wise, joining and reshaping operators: documented examples and edge cases."""

from __future__ import annotations

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from conftest import long_frame, stamp
from pyspark.sql import functions as F

from tidewell.frames import FrameError, Shape, nan_to_null, parse_any, validate_multits
from tidewell.functions.durations import Calendar, add_frequency, parse_duration, parse_frequency
from tidewell.operators import aggregates, arithmetic, attributes, charts, columns, filters, joins, resampling, reshape, windows
from tidewell.plans import blocks

NOON = "2020-01-01T12:00:0"


def points(spark, values, metric="a"):
    return long_frame(spark, [(f"{NOON}{i}Z", v) for i, v in enumerate(values)], metric)


def values(df, column="value"):
    return [r[column] for r in df.orderBy("metric", "timestamp").collect()]


@pytest.mark.parametrize(
    ("text", "micros"),
    [("180min", 10_800_000_000), ("1h30min", 5_400_000_000), ("-4s", -4_000_000), ("D", 86_400_000_000),
     ("00:00:04", 4_000_000), ("1 days 00:00:01", 86_401_000_000), ("250ms", 250_000), ("0.5s", 500_000), ("60s", 60_000_000)],
)
def test_durations(text, micros):
    assert parse_duration(text) == micros


@pytest.mark.parametrize("text", ["", "5 parsecs", "B", "0.1us"])
def test_bad_durations(text):
    with pytest.raises(ValueError):
        parse_duration(text)


@pytest.mark.parametrize("alias", ["M", "MS", "Q", "QS", "Y", "YS", "2M"])
@pytest.mark.parametrize("periods", [1, 2, -1, -3])
def test_calendar_shift_equals_pandas(spark, alias, periods):
    days = pd.to_datetime(["2019-12-31 05:00", "2020-01-15", "2020-02-29", "2020-03-31", "2020-06-30 23:59", "2020-07-01", "2021-01-01"], format="mixed")
    offset = {"M": "ME", "2M": "2ME", "Q": "QE", "Y": "YE"}.get(alias, alias)
    want = [d + periods * pd.tseries.frequencies.to_offset(offset) for d in days]
    frame = spark.createDataFrame([(i, d.to_pydatetime().replace(tzinfo=dt.timezone.utc)) for i, d in enumerate(days)], "i int, t timestamp")
    moved = frame.select("i", add_frequency(F.col("t"), parse_frequency(alias), periods).alias("t")).orderBy("i")
    assert [r["t"] for r in moved.collect()] == [w.to_pydatetime() for w in want]
    assert isinstance(parse_frequency(alias), Calendar)


def test_validation(spark):
    rows = spark.createDataFrame([(stamp(f"{NOON}0Z"), "a", 1.0), (None, "a", 2.0), (stamp(f"{NOON}1Z"), None, 3.0)], "timestamp timestamp, metric string, value double")
    with pytest.raises(Exception, match="must not have null"):
        validate_multits(rows).collect()
    good, bad = validate_multits(rows, "quarantine")
    assert (good.count(), bad.count()) == (1, 2)
    with pytest.raises(FrameError):
        validate_multits(rows.drop("metric"))
    with pytest.raises(FrameError):
        validate_multits(rows.drop("value"))


def test_nan_is_missing(spark):
    rows = nan_to_null(points(spark, [1.0, float("nan")]))
    assert values(rows) == [1.0, None]
    assert aggregates.maximum(rows).first()["value"] == 1.0


def test_parse_any(spark):
    rows = spark.createDataFrame([('{"a": 1}',), ('"{\\"a\\": 2}"',), ("plain",), ("3",)], "v string")
    found = [r["j"] for r in rows.select(F.to_json(parse_any(F.col("v"))).alias("j")).collect()]
    assert found == ['{"a":1}', '{"a":2}', '"plain"', "3"]


def test_typed_pass_through(spark):
    rows = spark.createDataFrame([("1",), ("x",), (None,)], "v string")
    with pytest.raises(Exception, match="does not hold int"):
        columns.pass_typed(rows, "v", "int").collect()
    assert [r["v"] for r in columns.pass_typed(rows, "v", "int", "null").collect()] == [1, None, None]
    good, bad = columns.pass_typed(rows, "v", "int", "quarantine")
    assert (good.count(), [r["v"] for r in bad.collect()]) == (2, ["x"])


def test_frame_to_series_refuses_several_columns(spark):
    with pytest.raises(FrameError):
        columns.frame_to_series(points(spark, [1.0]).withColumn("b", F.lit(1)))


@pytest.mark.parametrize(("kind", "want"), [("equality", [True, False, False]), ("inequality", [False, True, True]), ("greater", [False, False, False])])
def test_comparison_of_missing_sides(spark, kind, want):
    left, right = points(spark, [1.0, 5.0]), points(spark, [1.0, None, 3.0])
    assert values(filters.compare(left, right, kind), "result") == want


def test_duplicate_index_is_refused(spark):
    twice = points(spark, [1.0]).unionByName(points(spark, [2.0]))
    with pytest.raises(Exception, match="duplicate index"):
        arithmetic.apply_binary(twice, points(spark, [1.0]), "add").collect()


def test_filter_takes_missing_flags_as_true(spark):
    data = points(spark, [1.0, 2.0, 3.0, 4.0])
    mask = points(spark, [0.0, 1.0, None])
    assert values(filters.filter_by(data, mask)) == [2.0, 3.0]


def test_filter_tells_rows_of_one_index_apart(spark):
    at = [stamp("2020-01-01T00:00:00Z")] * 5
    rows = spark.createDataFrame(
        [(t, "a", v, v) for t, v in zip(at, (1.0, 2.0, 3.0, 3.0, None), strict=True)],
        "timestamp timestamp, metric string, value double, reading double",
    )
    mask = rows.withColumn("value", (F.col("reading") > 1.5).cast("double"))
    kept = filters.filter_by(rows, mask, Shape(tie=("reading",)))
    assert sorted((r["value"] for r in kept.collect()), key=lambda v: (v is None, v)) == [2.0, 3.0, 3.0, None]
    with pytest.raises(Exception, match="different flags"):
        filters.filter_by(rows, mask).collect()


def test_select_and_correct_time_intervals(spark):
    rows = long_frame(spark, [("2020-01-01T01:15:27Z", 42.2), ("2020-01-03T08:20:03Z", 18.7), ("2020-01-03T08:20:04Z", 25.9)])
    intervals = [
        {"start": "2020-01-01T01:15:27.000Z", "end": "2020-01-01T01:15:27.000Z", "start_inclusive": True, "end_inclusive": True, "correction_value": 37},
        {"start": "2020-01-03T08:20:02.000Z", "end": "2020-01-03T08:20:04.000Z", "start_inclusive": False, "end_inclusive": False, "correction_value": 42.0},
    ]
    for items in (intervals, intervals * 20):
        assert values(filters.select_time_intervals(rows, items), "result") == [True, True, False]
        assert values(filters.correct_time_intervals(rows, items)) == [37.0, 42.0, 25.9]
    with pytest.raises(FrameError):
        filters.select_time_intervals(rows, [{**intervals[0], "start_inclusive": False}])
    assert values(filters.select_time_intervals(rows, []), "result") == [False] * 3


def test_value_range_check(spark):
    closed = {"min_value": 10.0, "max_value": 20.0, "min_value_inclusive": True, "max_value_inclusive": True}
    opened = {"min_value": 20.0, "max_value": 30.0, "min_value_inclusive": False, "max_value_inclusive": False}
    found = filters.value_range_check(points(spark, [10.0, 20.0, 30.0, None]), {"[10,20]": closed, "(20,30)": opened})
    assert values(found, "[10,20]") == [True, True, False]
    assert values(found, "(20,30)_IS_BELOW") == [True, True, False]
    assert values(found, "_violates_all") == [False, False, True]
    assert values(found, "_violates_any") == [True, True, True]
    with pytest.raises(FrameError):
        filters.value_range_check(points(spark, [1.0]), {"x_IS_BELOW": closed})


def test_restrict_refuses_reversed_bounds(spark):
    with pytest.raises(ValueError):
        filters.restrict_to_time_interval(points(spark, [1.0]), "2020-01-02", "2020-01-01")


def test_drop_duplicates_keeps_the_first(spark):
    rows = points(spark, [3.0, 1.0, 3.0, None, None, 1.0])
    kept = filters.drop_duplicates(rows).orderBy("timestamp").collect()
    assert [(r["timestamp"].second, r["value"]) for r in kept] == [(0, 3.0), (1, 1.0), (3, None)]


def test_merge_matches_null_keys(spark):
    left = spark.createDataFrame([(1, "a"), (None, "b"), (3, "c")], "k int, v string")
    right = spark.createDataFrame([(1, "x"), (None, "y"), (4, "z")], "k int, v string")
    found = {(r["k"], r["v_x"], r["v_y"]) for r in joins.merge_on_column(left, right, "k", "outer").collect()}
    assert found == {(1, "a", "x"), (None, "b", "y"), (3, "c", None), (4, None, "z")}
    with pytest.raises(FrameError):
        joins.merge_on_column(left, right, "k", "cross")


def test_combine_names(spark):
    frame, extra = points(spark, [1.0, 2.0]), points(spark, [5.0])
    assert joins.combine_into_frame(frame, extra).columns[-1] == "0"
    assert joins.combine_into_frame(frame, extra, "value").columns[-1] == "value_1"
    assert values(joins.combine_as_named(frame, extra, "b"), "b") == [5.0, None]


def test_substitution(spark):
    raw = long_frame(spark, [(f"{NOON}{i}Z", float(i)) for i in range(9)])
    extra = [(f"2020-01-01T13:00:0{i}Z", 50.0 + i) for i in range(4)]
    sub = long_frame(spark, [(f"{NOON}1Z", 10.0), (f"{NOON}2Z", 20.0), (f"{NOON}4Z", None), (f"{NOON}5Z", None), (f"{NOON}6Z", None), *extra])
    found = joins.apply_substitution(raw, sub)
    assert values(found) == [0.0, 10.0, 20.0, 3.0, 7.0, 8.0, 50.0, 51.0, 52.0, 53.0]
    counts = {r["class"]: r["count"] for r in charts.substitution_classes(raw, sub).groupBy("class").count().collect()}
    assert counts == {"handled": 10, "replaced": 2, "replacement": 2, "new": 4, "ignored": 3}


def test_time_to_length(spark, layout):
    rows = points(spark, [2.0, 4.0, 6.0])
    found = joins.time_to_length(rows, rows).orderBy("timestamp").collect()
    assert [r["length"] for r in found] == [0.0, 3.0, 8.0]
    assert [r["length"] for r in joins.time_to_length(rows, 2.0).orderBy("timestamp").collect()] == [0.0, 2.0, 4.0]


def test_wide_and_long(spark):
    wide = spark.createDataFrame([(stamp(f"{NOON}0Z"), 1.0, None, 3.0), (stamp(f"{NOON}1Z"), None, 5.0, 6.0)], "timestamp timestamp, a double, b double, c double")
    long = reshape.wide_to_long(wide)
    assert long.count() == 6
    assert sorted(reshape.long_to_wide(long).collect()) == sorted(wide.collect())
    with pytest.raises(Exception, match="duplicate"):
        reshape.long_to_wide(long.unionByName(long)).collect()


def test_append_and_name(spark):
    a, b = points(spark, [1.0, 2.0, 3.0]), points(spark, [4.0, 5.0, 6.0]).drop("metric")
    assert reshape.append_series(a, b, "d").groupBy("metric").count().orderBy("metric").collect() == [("a", 3), ("d", 3)]
    both = reshape.timeseries_frame(b, b)
    assert {r["metric"] for r in both.collect()} == {"metric_0", "metric_1"}
    assert reshape.next_metric_name(both) == "metric_2"


def test_grid(spark):
    found = reshape.grid_2d(spark, 0.0, 1.0, 10.0, 20.0, 3).orderBy("position").collect()
    assert [(r["x"], r["y"]) for r in found][:4] == [(0.0, 10.0), (0.5, 10.0), (1.0, 10.0), (0.0, 15.0)]
    assert [r["value"] for r in reshape.grid_axis(spark, 0.0, 1.0, 3).orderBy("position").collect()] == [0.0, 0.5, 1.0]


def test_regression_of_two(spark):
    fit = aggregates.regression_of_two(points(spark, [1.0, 2.0, 3.0, 4.0]), points(spark, [5.0, 6.0, 9.0, 8.0]))["fit"].first()
    assert (fit["slope"], fit["intercept"]) == (pytest.approx(1.2), pytest.approx(4.0))


def test_scale_without_spread(spark):
    assert values(aggregates.standard_scale(points(spark, [3.0, 3.0, None]))) == [0.0, 0.0, None]


def test_sums_of_nothing(spark):
    assert aggregates.sum_up(points(spark, [None, None])).first()["value"] == 0.0
    rows = points(spark, [None]).withColumn("b", F.lit(2.0))
    assert aggregates.sum_columns(rows, "s").first()["s"] == 2.0


def test_undefined_math_is_null(spark):
    rows = points(spark, [0.0, -1.0, 4.0])
    assert values(arithmetic.apply_unary(rows, "ln"))[:2] == [None, None]
    assert values(arithmetic.apply_unary(rows, "sqrt")) == [0.0, None, 2.0]
    assert values(arithmetic.apply_binary(1.0, rows, "divide")) == [None, -1.0, 0.25]
    assert values(arithmetic.apply_unary(rows, "arcussine")) == [0.0, pytest.approx(-np.pi / 2), None]
    assert values(arithmetic.apply_binary(rows, 2.0, "nth_root")) == [0.0, None, 2.0]


@pytest.mark.parametrize(("a", "b"), [(7.0, -3.0), (-7.0, 3.0), (-7.5, -2.0), (5.0, 5.0)])
def test_floored_modulo(spark, a, b):
    assert values(arithmetic.apply_binary(points(spark, [a]), b, "modulo")) == [a % b]


def test_round_half_to_even(spark):
    assert values(arithmetic.round_values(points(spark, [0.5, 1.5, 2.5, -0.5]))) == [0.0, 2.0, 2.0, 0.0]
    assert values(arithmetic.round_values(points(spark, [1250.0, 1350.0]), -2)) == [1200.0, 1400.0]


def test_frames_are_combined_by_column(spark):
    a = points(spark, [1.0, 2.0]).withColumn("other", F.col("value") * 10)
    found = arithmetic.apply_to_frames(a, a, "add").orderBy("timestamp").collect()
    assert [(r["value"], r["other"]) for r in found] == [(2.0, 20.0), (4.0, 40.0)]


@pytest.mark.parametrize("freq", ["7min", "1h", "2D", "ME", "QE", "MS", "2ME"])
def test_resample_equals_pandas(spark, freq):
    rng = np.random.default_rng(4)
    at = pd.to_datetime("2020-01-30 10:00") + pd.to_timedelta(rng.integers(0, 200 if freq.endswith("min") else 200_000, 60), unit="min")
    frame = pd.Series(rng.random(60), index=at).sort_index()
    want = frame.resample(freq).mean()
    rows = long_frame(spark, [(f"{t.isoformat()}+00:00", float(v)) for t, v in frame.items()])
    alias = {"ME": "M", "QE": "Q", "2ME": "2M"}.get(freq, freq)
    found = resampling.resample(rows, alias).orderBy("timestamp").collect()
    assert [r["timestamp"] for r in found] == [t.to_pydatetime() for t in want.index]
    for r, v in zip(found, want, strict=True):
        assert (r["value"] is None) if np.isnan(v) else r["value"] == pytest.approx(v)


@pytest.mark.parametrize("d", [1, 2, 3, 5])
def test_numeric_grids_equal_pandas(spark, layout, d):
    index = sorted(np.random.default_rng(d).choice(200, 60, replace=False))
    data = pd.Series(np.arange(60.0) ** 1.5, index=index)
    shape = Shape(("metric",), "i", "value")
    rows = spark.createDataFrame([("a", int(i), float(v)) for i, v in data.items()], "metric string, i bigint, value double")
    union = data.reindex(pd.RangeIndex(index[0], index[-1], d).union(data.index))
    ends = pd.RangeIndex(index[0], index[-1] + 1, d)
    means = union.rolling(d, min_periods=1, center=True).mean().reindex(ends)
    lines = union.interpolate("index").reindex(ends)
    for found, want in ((resampling.resample_numeric(rows, d, shape), means), (resampling.interpolate_on_numeric_grid(rows, d, shape), lines)):
        got = {r["i"]: r["value"] for r in found.collect()}
        assert got.keys() == set(want.index)
        for i, v in want.items():
            assert (got[i] is None) if np.isnan(v) else got[i] == pytest.approx(v)


@pytest.mark.parametrize("d", [1, 2, 7])
def test_numeric_grids_are_made_where_they_lie(spark, d):
    """Missing values, a missing key and a wide stretch; the points of the grid are in no join and no shuffle."""
    shape = Shape(("metric",), "i", "value")
    data = {"a": {3: None, 10: 1.0, 11: 5.0, 40: None, 45: 3.0, 30_001: 9.0, 30_003: None}, None: {5: 2.0}, "b": {-4: None, 9: None}}
    flat = [(k, i, v) for k, points in data.items() for i, v in points.items()]
    rows = spark.createDataFrame(flat, "metric string, i bigint, value double").repartition(3)
    made = resampling.resample_numeric(rows, d, shape), resampling.interpolate_on_numeric_grid(rows, d, shape)
    for frame, mean in zip(made, (True, False), strict=True):
        got = {(r["metric"], r["i"]): r["value"] for r in frame.collect()}
        text = frame._jdf.queryExecution().executedPlan().toString()
        assert "FullOuter" not in text
        want = {}
        for key, points in data.items():
            series = pd.Series(points, dtype=float)
            ends = range(min(points), max(points) + 1, d)
            union = series.reindex(sorted({*points, *ends}))
            whole = union.rolling(d, min_periods=1, center=True).mean() if mean else union.interpolate("index")
            want.update({(key, i): whole[i] for i in ends})
        assert got.keys() == want.keys()
        for place, v in want.items():
            assert (got[place] is None) if np.isnan(v) else got[place] == pytest.approx(v), place


GRIDS = [resampling.interpolate_on_numeric_grid, resampling.resample_numeric]


@pytest.mark.parametrize("made", GRIDS)
def test_numeric_grids_shuffle_their_rows_once(spark, made, monkeypatch):
    """Rows are counted as they are read and meet their series once; points and what is made for them stay where they are."""
    counted = []

    def measure(df, *args, **kwargs):
        counted.append(df._jdf.queryExecution().executedPlan().toString())
        return known(df, *args, **kwargs)

    known = blocks.measure
    monkeypatch.setattr(blocks, "measure", measure)
    shape = Shape(("metric",), "i", "value")
    rows = spark.createDataFrame(
        [(f"m{n % 9}", n * 3 + n % 3, None if n % 5 == 0 else n / 7) for n in range(400)], "metric string, i bigint, value double"
    )
    frame = made(rows, 4, shape)
    assert frame.collect()
    plan = frame._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    dealt = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line and "Reused" not in line and "REPARTITION" not in line]
    assert len(counted) == 1 and "Exchange" not in counted[0]
    assert len(dealt) == 1 and "(metric" in dealt[0]


@pytest.mark.parametrize("made", GRIDS)
def test_numeric_grids_stop_at_duplicates(spark, layout, made):
    shape = Shape(("metric",), "i", "value")
    rows = spark.range(120).selectExpr("'a' AS metric", "id * 3 AS i", "id * 0.5D AS value")
    for twice in [("a", 9, None), (None, 4, 1.0), (None, None, None), ("a", None, 2.0)]:
        more = spark.createDataFrame([twice, ("a", 500, 1.0), *([twice] if twice[:2] != ("a", 9) else [])], "metric string, i bigint, value double")
        with pytest.raises(Exception, match="duplicate index"):
            made(rows.unionByName(more), 4, shape).collect()


@pytest.mark.parametrize("made", GRIDS)
def test_numeric_grids_place_a_missing_index_first(spark, layout, made):
    """In every layout; the points between two blocks with a row of missing index between them used to differ."""
    shape = Shape(("metric",), "i", "value")
    at = [int(i) for i in range(-200, 200) if i % 7 in (0, 1, 5)]
    flat = [("a", i, None if i % 4 == 0 else i / 3) for i in at] + [("a", None, 7.0), ("b", None, 4.0), ("b", 5, None), ("b", 12, None)]
    rows = spark.createDataFrame(flat, "metric string, i bigint, value double").repartition(3)
    got = {(r["metric"], r["i"]): r["value"] for r in made(rows, 3, shape).collect()}
    grid = range(at[0], at[-1] + 1, 3)
    assert got.keys() == {("a", i) for i in grid} | {("b", i) for i in range(5, 13, 3)}
    series = pd.Series({-10_000.0: 7.0, **{i: v for k, i, v in flat if k == "a" and i is not None}}, dtype=float)
    union = series.reindex(sorted({*series.index, *grid}))
    whole = union.rolling(3, min_periods=1, center=True).mean() if made is resampling.resample_numeric else series.dropna().iloc[1:].reindex(union.index[1:]).interpolate("index")
    for i in grid:
        assert (got["a", i] is None) if np.isnan(whole[i]) else got["a", i] == pytest.approx(whole[i]), i


@pytest.mark.parametrize("kind", ["decimal(12,2)", "decimal(38,6)", "float", "bigint", "smallint"])
def test_numeric_means_have_the_types_of_averages(spark, kind):
    shape = Shape(("metric",), "i", "value")
    flat = [("a", 0, 1), ("a", 1, 5), ("a", 2, None), ("a", 4, 7), ("a", 9, 4)]
    rows = spark.createDataFrame(flat, "metric string, i bigint, value bigint").withColumn("value", F.col("value").cast(kind))
    found = resampling.resample_numeric(rows, 3, shape)
    places = spark.createDataFrame([(0, 0), (0, 1), (3, 4), (6, 4), (6, 9), (9, 9)], "at bigint, i bigint")
    want = places.join(rows, "i").groupBy("at").agg(F.avg("value").alias("value"))
    assert found.schema["value"].dataType == want.schema["value"].dataType
    assert {r["i"]: r["value"] for r in found.collect()} == {r["at"]: r["value"] for r in want.collect()}


def test_grid_interpolation_uses_exact_hits_only(spark):
    rows = long_frame(spark, [("2020-01-01T00:00:00Z", 1.0), ("2020-01-01T00:00:30Z", 99.0), ("2020-01-01T00:02:00Z", 3.0), ("2020-01-01T00:03:10Z", 7.0)])
    assert values(resampling.interpolate_on_grid(rows, "1min")) == [1.0, 2.0, 3.0, 3.0]


def test_long_grids_come_in_chunks(spark):
    bounds = spark.createDataFrame([("a", 0, 20_000)], "metric string, low bigint, high bigint")
    from tidewell.plans.blocks import grid

    points_at = grid(bounds, ("metric",), "low", "high", 3, "at")
    assert points_at.count() == 6667 and points_at.agg(F.max("at")).first()[0] == 19_998


def test_shift_and_timedelta(spark):
    rows = points(spark, [1.0])
    assert resampling.add_timedelta(rows, "-4s").first()["timestamp"] == stamp("2020-01-01T11:59:56Z").replace(tzinfo=None)
    assert resampling.shift_index(rows, "2h", 3).first()["timestamp"] == stamp("2020-01-01T18:00:00Z").replace(tzinfo=None)


def test_fixed_values_need_agreeing_timestamps(spark):
    rows = points(spark, [1.0]).withColumn("value", F.col("timestamp") + F.expr("INTERVAL 1 SECOND"))
    with pytest.raises(Exception, match="differ"):
        resampling.fixed_values(rows, 1.0).collect()


def test_shifted_table(spark):
    found = windows.timeshifted_table(points(spark, [1.0, 2.0, 3.0]), "1s", -2)
    rows = found.orderBy("timestamp").collect()
    assert [r["shifted_-1_times_1s"] for r in rows] == [1.0, 2.0, 3.0]
    assert [r["shifted_-2_times_1s"] for r in rows] == [2.0, 3.0, None]


def test_attributes(spark, tmp_path):
    rows = attributes.update_series_attributes(points(spark, [1.0]), {"unit": "m", "a": {"b": 1}})
    rows = attributes.update_series_attributes(rows, {"unit": "km"})
    rows.where(F.col("value") > 0).write.parquet(str(tmp_path / "x"))
    assert attributes.series_attributes(spark.read.parquet(str(tmp_path / "x"))) == {"unit": "km", "a": {"b": 1}}


def test_put_in_map(spark):
    rows = spark.sql("SELECT map('a', 1, 'b', 2) AS m")
    found = rows.select(attributes.put_in_map(F.col("m"), F.lit("a"), F.lit(9)).alias("m")).first()["m"]
    assert found == {"a": 9, "b": 2}


def test_correlation_uses_pairwise_rows(spark):
    frame = pd.DataFrame({"a": [1.0, 2, 3, 4, 5], "b": [2.0, 1, np.nan, 3, 9], "c": [np.nan, 1, 4, 2, 2]})
    rows = spark.createDataFrame([tuple(None if np.isnan(v) else v for v in r) for r in frame.to_numpy().tolist()], "a double, b double, c double")
    want = frame.corr()
    for r in charts.correlation_matrix(rows, ["a", "b", "c"]).collect():
        assert r["corr"] == pytest.approx(want.loc[r["x"], r["y"]])


def test_table_widths(spark):
    rows = spark.createDataFrame([(1, "x" * 300, True)], "a int, long_text string, flag boolean")
    found = {r["column"]: r["width"] for r in charts.table_widths(rows).collect()}
    assert found == {"a": 16, "long_text": 200, "flag": 6}
