"""Frequent keys in joins, overlapping intervals, and delivery at most once."""

from __future__ import annotations

import datetime as dt
import random
import time
from collections import Counter

import pytest
from conftest import UTC, long_frame
from pyspark.sql import functions as F

from tidewell.frames import FrameError, Shape
from tidewell.operators import filters, joins, windows
from tidewell.plans import blocks
from tidewell.streaming.consume import consume
from tidewell.streaming.messages import open_stream


@pytest.mark.parametrize("how", ["inner", "left", "right", "outer"])
def test_joins_of_frequent_keys(spark, how):
    """NULL holds a third of both sides, one key is frequent on one side only, one has no partner."""
    rng = random.Random(3)
    left = [(None, i) for i in range(60)] + [("hot", i) for i in range(60, 130)] + [("lone", i) for i in range(130, 180)]
    left += [(f"k{rng.randint(0, 20)}", i) for i in range(180, 230)]
    right = [(None, i) for i in range(45)] + [("hot", i) for i in range(45, 48)] + [("other", i) for i in range(48, 90)]
    right += [(f"k{rng.randint(0, 25)}", i) for i in range(90, 130)]
    a = spark.createDataFrame(left, "key string, v int").repartition(3)
    b = spark.createDataFrame(right, "key string, v int").repartition(3)
    plain = joins.merge_on_column(a, b, "key", how)
    spark.conf.set(blocks.BLOCK_ROWS_CONF, "20")
    assert {r["_key"]: (r["_na"], r["_nb"]) for r in joins._hot_keys(a.withColumnRenamed("key", "_a"), b.withColumnRenamed("key", "_b")).collect()} == {
        None: (60, 45), "hot": (70, 3), "lone": (50, 0), "other": (0, 42)
    }
    spread = joins.merge_on_column(a, b, "key", how)
    assert spread.columns == plain.columns and Counter(spread.collect()) == Counter(plain.collect())
    spark.conf.unset(blocks.BLOCK_ROWS_CONF)


def test_pieces_of_overlapping_intervals():
    rng = random.Random(5)
    for _ in range(200):
        given = [(s, s + rng.randint(-1, 12), rank) for rank, s in enumerate(rng.randint(0, 30) for _ in range(rng.randint(0, 12)))]
        starts, ends, ranks = filters.disjoint_pieces(given)
        assert all(e < s for e, s in zip(ends, starts[1:], strict=False)) and len(starts) <= 2 * len(given)
        for at in range(-2, 50):
            want = max((r for s, e, r in given if s <= at <= e), default=None)
            assert next((r for s, e, r in zip(starts, ends, ranks, strict=True) if s <= at <= e), None) == want


def test_a_hundred_thousand_nested_intervals(spark):
    start, step, count = dt.datetime(2024, 1, 1, tzinfo=UTC), dt.timedelta(seconds=1), 100_000
    items = [
        {"start": (start + k * step).isoformat(), "end": (start + (2 * count - k) * step).isoformat(), "correction_value": k, "end_inclusive": k % 2 == 0}
        for k in range(count)
    ]
    moments = [start + dt.timedelta(seconds=s) for s in (-1, 0, 1, 50_000.5, 99_999, 100_001, 100_002, 150_000, 199_999, 200_000, 200_001)]
    rows = spark.createDataFrame([(m, "a", 1e9) for m in moments] + [(None, "a", 1e9)], "timestamp timestamp, metric string, value double")
    want = Counter()
    for m in moments:
        s = (m - start).total_seconds()
        want[m.replace(tzinfo=None), max((k for k in range(count) if k <= s and (s < 2 * count - k or (s == 2 * count - k and k % 2 == 0))), default=1e9)] += 1
    want[None, 1e9] += 1
    found = filters.correct_time_intervals(rows, items).withColumn("timestamp", F.col("timestamp").cast("timestamp_ntz"))
    assert Counter((r["timestamp"], r["value"]) for r in found.collect()) == want
    assert filters.select_time_intervals(rows, items).where("result").count() == 9


def test_every_interval_may_be_empty_between_ticks(spark):
    at = "2024-01-01T00:00:00.000001Z"
    items = [{"start": "2024-01-01T00:00:00Z", "end": "2024-01-01T00:00:00.000001Z", "start_inclusive": False, "end_inclusive": False, "correction_value": 5}] * 20
    assert not filters.select_time_intervals(long_frame(spark, [(at, 1.0)]), items).first()["result"]
    assert filters.correct_time_intervals(long_frame(spark, [(at, 1.0)]), items).first()["value"] == 1.0


def test_delivery_must_be_known(spark, tmp_path):
    (tmp_path / "in").mkdir()
    stream = open_stream(spark, "text", str(tmp_path / "in"))
    with pytest.raises(FrameError):
        consume(stream, {"v": {"type": "float"}}, lambda df: df, str(tmp_path / "out"), str(tmp_path / "state"), "job", delivery="once")


@pytest.mark.parametrize("delivery, runs", [("at_most_once", 1), ("at_least_once", 2)])
def test_a_failed_batch_runs_again_or_not(spark, tmp_path, delivery, runs):
    from tidewell.catalog.streaming import SINGLE
    from tidewell.streaming.messages import build_messages

    rows = spark.createDataFrame([(float(i),) for i in range(5)], "value double")
    build_messages(rows, SINGLE, "t", "j").select("message").write.text(str(tmp_path / "in"))
    seen = []

    def pipeline(df):
        seen.append(1)
        if len(seen) == 1:
            raise RuntimeError("first")
        return df

    for _ in range(3):
        stream = open_stream(spark, "text", str(tmp_path / "in"))
        query = consume(stream, {"value": {"type": "float"}}, pipeline, str(tmp_path / "out"), str(tmp_path / "state"), "job", delivery=delivery)
        while query.isActive:
            time.sleep(0.05)
    assert len(seen) == runs
    assert (tmp_path / "out").exists() == (delivery == "at_least_once")


def test_one_timestamp_with_a_third_of_the_rows(spark, layout):
    """Rows of a frequent timestamp are spread towards the next one, over block borders."""
    rng = random.Random(8)
    rows = [(100, i) for i in range(60)] + [(rng.randint(0, 400), 60 + i) for i in range(110)]
    micros = [(t * 1_000_000, p) for t, p in rows]
    start = dt.datetime(2024, 1, 1, tzinfo=UTC)
    frame = spark.createDataFrame(
        [(start + dt.timedelta(microseconds=t), "ab"[p % 2], float(p), p) for t, p in micros],
        "timestamp timestamp, metric string, value double, place int",
    ).repartition(4)
    found = windows.merge_distributing_duplicates(frame, "3s", Shape(tie=("place",)))
    distinct = sorted({t for t, _ in micros})
    following = dict(zip(distinct, distinct[1:], strict=False))
    want = {}
    for t in distinct:
        places = sorted(p for u, p in micros if u == t)
        span = min(following.get(t, t + 3_000_000) - t, 3_000_000)
        want |= {p: t + k * span // len(places) for k, p in enumerate(places)}
    got = {r["place"]: r["t"] for r in found.select("place", (F.unix_micros("timestamp") - F.unix_micros(F.lit(start))).alias("t")).collect()}
    assert got == want
