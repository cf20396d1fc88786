"""A series whose key is NULL is a series like any other, in every layout."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from conftest import random_series, to_spark
from tidewell.frames import FrameError
from tidewell.functions import math as m
from tidewell.operators import aggregates, arithmetic, filters, gaps, health, joins, recursive, resampling, windows
from tidewell.sources import files, rest, store

OPERATORS = {
    "standard_scale": aggregates.standard_scale,
    "cumulative_sum": windows.cumulative_sum,
    "moving_time": lambda df: windows.moving_time(df, "mean", "10min"),
    "moving_number": lambda df: windows.moving_number(df, "median", 5),
    "resample": lambda df: resampling.resample(df, "5min"),
    "interpolate_on_grid": lambda df: resampling.interpolate_on_grid(df, "1s"),
    "lowpass": lambda df: recursive.lowpass(df.where("metric is null or metric <> 'single'"), 0.0005),
    "derivative": windows.derivative,
    "count_level_crossings": lambda df: windows.count_level_crossings(df, 50, 2),
    "time_gaps": windows.time_gaps,
    "detect_gaps": lambda df: gaps.detect_gaps(df, percentile=0.9)[0],
    "alerts": lambda df: health.alerts_from_score(df, 45),
    "align": lambda df: joins.align(df, df.withColumn("value", F.col("value") + 1)),
    "summary": aggregates.summary,
    "medians": aggregates.median,
    "thin_out": lambda df: filters.thin_out(df, 20),
    "add": lambda df: arithmetic.apply_binary(df, df, "add"),
}


def as_rows(df):
    def plain(value):
        return round(value, 9) if isinstance(value, float) else value

    return sorted((tuple(plain(v) for v in r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("name", OPERATORS)
def test_null_key_is_a_series(spark, layout, name):
    frame = random_series(seed=11, rows=120, repeated=False)
    rows = to_spark(spark, frame).drop("place")
    run = OPERATORS[name]
    named = as_rows(run(rows).withColumn("metric", F.nullif("metric", F.lit("big"))))
    missing = as_rows(run(rows.withColumn("metric", F.nullif("metric", F.lit("big")))))
    assert missing == named and any(None in r for r in missing)


def test_remainder_is_exact(spark):
    cases = [(1.0, 0.1), (-1.0, 0.1), (1e20, 0.1), (-7.5, 2.0), (7.5, -2.0), (6.0, 3.0), (-6.0, 3.0)]
    df = spark.createDataFrame([*cases, (1.0, 0.0), (None, 1.0)], "a double, b double")
    found = [r["m"] for r in df.select(m.floored_modulo(F.col("a"), F.col("b")).alias("m")).collect()]
    assert found == [*(a % b for a, b in cases), None, None]


def test_few_and_many_intervals_agree(spark):
    day = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
    rows = spark.createDataFrame([("a", day, 1.0), ("a", None, 2.0)], "metric string, timestamp timestamp, value double")
    for count in (1, 17):
        spans = [
            {"start": f"20{10 + i}-01-01", "end": f"20{10 + i}-02-01", "correction_value": 9.0} for i in range(14, 14 + count)
        ]
        hits = {r["timestamp"]: r["result"] for r in filters.select_time_intervals(rows, spans).collect()}
        assert sorted(hits.values()) == [False, True]
        fixed = sorted(r["value"] for r in filters.correct_time_intervals(rows, spans).collect())
        assert fixed == [2.0, 9.0]
        del spans[-1]["correction_value"]
        with pytest.raises(FrameError):
            filters.correct_time_intervals(rows, spans)


def test_sources_refuse_what_they_would_lose(spark, tmp_path):
    header = tmp_path / "h.csv"
    header.write_text("b,a\n1,2\n")
    with pytest.raises(Exception, match="(?i)header|schema"):
        files.read_csv(spark, str(header), "a int, b int").collect()
    broken = tmp_path / "b.csv"
    broken.write_text("a,b\n1,zz\n")
    with pytest.raises(Exception, match="(?i)malformed"):
        files.read_csv(spark, str(broken), "a int, b int").collect()
    frame = spark.createDataFrame([(1, 2.0)], "time int, v double")
    with pytest.raises(FrameError):
        store.store_frame(frame, str(tmp_path), "x", "job")
    with pytest.raises(Exception, match="no dump"):
        list(rest._lines(f"file://{tmp_path}/none", "timeseries", rest.Request(("a",), None, None), []))


def test_equal_rows_are_split_over_blocks(spark, layout):
    at = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
    rows = spark.createDataFrame([("a", at, 1.0)] * 400, "metric string, timestamp timestamp, value double")
    blocks = __import__("tidewell.plans.blocks", fromlist=["lay_out"])
    laid = blocks.lay_out(rows, blocks.Shape(("metric",), "timestamp", "value"))
    if laid.split:
        sizes = [r["count"] for r in laid.df.groupBy(blocks.BLOCK).count().collect()]
        assert max(sizes) < 100 and sum(sizes) == 400
