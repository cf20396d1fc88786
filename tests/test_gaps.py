"""Gap detection, interval algebra and replacement locations."""

from __future__ import annotations

import datetime as dt
import itertools
import random

import pytest
from conftest import UTC, long_frame, stamp
from pyspark.sql import functions as F

from tidewell.catalog import QUERIES
from tidewell.frames import FrameError, update_attributes
from tidewell.operators import gaps, joins, resampling

DAY = "2020-01-01T"
POINTS = [
    ("01:16", 10.0), ("01:18", 10.0), ("01:19", 10.0), ("01:20", 10.0), ("01:22", 20.0), ("01:23", 20.0),
    ("01:25", 20.0), ("08:28", 20.0), ("08:30", 30.0), ("08:31", 30.0), ("16:34", 30.0),
]
INTERVALS = "start_time timestamp, end_time timestamp, start_inclusive boolean, end_inclusive boolean, metric string"


def at(clock: str) -> dt.datetime:
    return stamp(f"{DAY}{clock if clock.count(':') == 2 else clock + ':00'}+00:00")


def series(spark, points):
    return long_frame(spark, [(at(t).isoformat(), v) for t, v in points])


def interval_frame(spark, rows):
    return spark.createDataFrame([(at(a), at(b), i, j, "a") for a, b, i, j in rows], INTERVALS)


def listed(df, *columns):
    rows = df.orderBy("start_time", "end_time").collect()
    return [tuple(r[c] for c in columns) for r in rows]


def clocks(df):
    return [(f"{a:%H:%M}", f"{b:%H:%M}", i, j) for a, b, i, j in listed(df, *gaps.INTERVAL)]


INFO = ("gap_size_in_seconds", "value_to_left", "value_to_right", "mean_left_right")


def test_automatic_frequency(spark, layout):
    info, used = gaps.detect_gaps(series(spark, POINTS))
    assert used.first()["frequency"] == 120_000_000
    assert clocks(info) == [("01:25", "08:28", False, False), ("08:31", "16:34", False, False)]
    assert listed(info, *INFO) == [(25380.0, 20.0, 20.0, 20.0), (28980.0, 30.0, 30.0, 30.0)]


MINUTE_GAPS = [
    (3600.0, None, 10.0, None), (120.0, 10.0, 10.0, 10.0), (120.0, 10.0, 20.0, 15.0), (120.0, 20.0, 20.0, 20.0),
    (25380.0, 20.0, 20.0, 20.0), (120.0, 20.0, 30.0, 25.0), (28980.0, 30.0, 30.0, 30.0),
]


def test_given_frequency_and_range(spark):
    info, used = gaps.detect_gaps(
        series(spark, POINTS), f"{DAY}00:16:00Z", f"{DAY}16:34:00Z", auto_frequency=False, frequency="1min"
    )
    assert used == 60_000_000
    assert listed(info, *INFO) == MINUTE_GAPS
    assert not any(flag for row in listed(info, "start_inclusive", "end_inclusive") for flag in row)


def test_range_and_frequency_from_metadata(spark):
    marked = update_attributes(
        series(spark, POINTS),
        {
            "ref_interval_start_timestamp": f"{DAY}00:16:00.000Z",
            "ref_interval_end_timestamp": f"{DAY}16:34:00.000Z",
            "ref_data_frequency": "1min",
        },
        "timestamp",
    )
    assert listed(gaps.detect_gaps(marked)[0], *INFO) == MINUTE_GAPS


def test_missing_rhythm_points(spark):
    half = series(spark, [("01:16:30", 10.0), ("01:17:30", 10.0), ("01:18:30", 10.0)])
    info, _ = gaps.detect_gaps(
        half, f"{DAY}01:16:00Z", f"{DAY}01:19:00Z", auto_frequency=False, frequency="1min", offset="0s"
    )
    assert clocks(info) == [(t, t, True, True) for t in ("01:16", "01:17", "01:18", "01:19")]
    assert listed(info, *INFO) == [
        (0.0, None, 10.0, None), (0.0, 10.0, 10.0, 10.0), (0.0, 10.0, 10.0, 10.0), (0.0, 10.0, None, None),
    ]


def test_external_gaps(spark, layout):
    points = [*POINTS[:7], ("01:28", 20.0), ("01:30", 30.0), ("01:31", 30.0), ("01:34", 30.0)]
    marks = series(spark, [("01:25", 1.0), ("01:29", 1.0)])
    external = interval_frame(
        spark,
        [("01:01", "01:13", False, False), ("01:14", "01:25", False, False), ("01:31", "01:33", False, False),
         ("01:32", "01:38", False, False)],
    )
    info, used = gaps.detect_gaps(
        series(spark, points), f"{DAY}01:16:00Z", f"{DAY}01:34:00Z", only_external=True,
        gap_timestamps=marks, gap_intervals=external,
    )
    assert used is None
    assert clocks(info) == [("01:16", "01:25", True, True), ("01:29", "01:29", True, True), ("01:31", "01:34", False, True)]
    assert listed(info, *INFO) == [(540.0, None, 20.0, None), (0.0, 20.0, 30.0, 25.0), (180.0, 30.0, None, None)]


def test_contained_interval_does_not_shrink_the_union(spark):
    rows = interval_frame(spark, [("01:00", "01:10", True, True), ("01:02", "01:05", True, True)])
    assert clocks(gaps.merge_intervals(rows)) == [("01:00", "01:10", True, True)]


def test_touching_intervals(spark):
    rows = [("01:00", "01:10", False, False), ("01:10", "01:20", False, False), ("01:20", "01:30", True, False)]
    merged = clocks(gaps.merge_intervals(interval_frame(spark, rows)))
    assert merged == [("01:00", "01:10", False, False), ("01:10", "01:30", False, False)]


def test_merge_against_brute_force(spark, layout):
    rng = random.Random(3)
    rows = []
    for _ in range(120):
        low, length = rng.randrange(0, 1200), rng.choice([0, 0, 1, 2, 5, 30])
        flags = (True, True) if length == 0 else (rng.random() < 0.5, rng.random() < 0.5)
        rows.append((low, low + length, *flags))
    # Half-second marks make open and closed ends visible as points.
    covered = {m for a, b, i, j in rows for m in range(2 * a + (not i), 2 * b + j)} | {2 * a for a, b, i, j in rows if a == b}
    base = at("00:00")
    frame = spark.createDataFrame(
        [(base + dt.timedelta(seconds=a), base + dt.timedelta(seconds=b), i, j, "a") for a, b, i, j in rows], INTERVALS
    )
    found = set()
    for a, b, i, j in listed(gaps.merge_intervals(frame), *gaps.INTERVAL):
        low, high = (int((x - base.replace(tzinfo=None)).total_seconds()) for x in (a, b))
        marks = set(range(2 * low + (not i), 2 * high + j))
        assert not found & marks
        found |= marks
    assert found == covered


def test_too_few_points(spark):
    with pytest.raises(Exception, match="fewer than"):
        gaps.detect_gaps(series(spark, POINTS[:5]))[0].collect()


def test_conflicting_parameters(spark):
    with pytest.raises(FrameError):
        gaps.detect_gaps(series(spark, POINTS), frequency="1min")
    with pytest.raises(FrameError):
        gaps.detect_gaps(series(spark, POINTS), f"{DAY}02:00:00Z", f"{DAY}01:00:00Z")


LOCATIONS = [("01:16:30", "01:25:30", True, True), ("01:29:30", "01:29:30", True, True), ("01:31:30", "01:34:30", False, True)]


def places(df):
    return [f"{r['timestamp']:%H:%M:%S}" for r in df.orderBy("timestamp").collect()]


def test_replacement_locations_start_with_each_gap(spark):
    found = gaps.replacement_locations(interval_frame(spark, LOCATIONS), frequency="2min")
    assert places(found) == [
        "01:16:30", "01:18:30", "01:20:30", "01:22:30", "01:24:30", "01:29:30", "01:33:30",
    ]
    assert {r["value"] for r in found.collect()} == {None}


def test_replacement_locations_on_a_rhythm(spark):
    rows = interval_frame(spark, LOCATIONS)
    wanted = ["01:18:00", "01:20:00", "01:22:00", "01:24:00", "01:29:30", "01:32:00", "01:34:00"]
    assert places(gaps.replacement_locations(rows, frequency="2min", offset="0s")) == wanted
    strict = gaps.replacement_locations(rows, frequency="2min", offset="0s", all_gap_points=False)
    assert places(strict) == [w for w in wanted if w != "01:29:30"]


def test_replacement_rhythm_comes_from_the_first_point(spark):
    data = series(spark, [("01:00:20", 1.0), ("01:10:00", 2.0)])
    rows = interval_frame(spark, [("01:02:00", "01:04:00", False, False)])
    assert places(gaps.replacement_locations(rows, data, frequency="1min")) == ["01:02:20", "01:03:20"]


def test_filling_a_gap_end_to_end(spark):
    data = series(spark, [(f"01:{m:02d}", float(m)) for m in range(20) if m not in (7, 8)])
    info, _ = gaps.detect_gaps(data, auto_frequency=False, frequency="1min")
    locations = gaps.replacement_locations(info, data, frequency="1min")
    filled = joins.apply_substitution(data, resampling.fixed_values(locations, -1.0))
    assert [r["value"] for r in filled.orderBy("timestamp").collect()] == [
        -1.0 if m in (7, 8) else float(m) for m in range(20)
    ]


def test_series_without_points_in_range(spark):
    data = series(spark, POINTS).unionByName(long_frame(spark, [("2020-02-01T00:00:00Z", 5.0)], "b"))
    info, _ = gaps.detect_gaps(data, f"{DAY}01:00:00Z", f"{DAY}02:00:00Z", auto_frequency=False, frequency="1h")
    rows = {r["metric"]: r for r in info.collect()}
    assert rows == {}
    info, _ = gaps.detect_gaps(data, f"{DAY}01:00:00Z", f"{DAY}02:00:00Z", auto_frequency=False, frequency="50min")
    found = info.where(F.col("metric") == "b").collect()
    assert len(found) == 1 and found[0]["value_to_left"] is None and found[0]["gap_size_in_seconds"] == 3600.0
    assert UTC is dt.timezone.utc


def test_expected_frequency_query_takes_all_events_and_the_ends_of_the_range(spark, tmp_path):
    """The first day's beginning and the last day's end are points too; nothing is cut."""
    at = [dt.datetime(2023, 5, 1, 1) + dt.timedelta(minutes=k) for k in range(6)]
    at += [dt.datetime(2025, 5, 1, 1) + dt.timedelta(minutes=k) for k in range(6)]
    rows = spark.createDataFrame([(t, "a", 1.0) for t in at], "ts timestamp_ntz, event_type string, value double")
    rows.write.parquet(f"{tmp_path}/events.parquet")
    steps = sorted(b - a for a, b in itertools.pairwise([dt.datetime(2023, 5, 1), *at, dt.datetime(2025, 5, 2)]))
    found = QUERIES["expected_frequency"](spark, str(tmp_path)).collect()
    assert [(r["metric"], r["frequency"]) for r in found] == [("a", steps[round(12 * 0.9)] // dt.timedelta(microseconds=1))]
