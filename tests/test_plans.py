"""Plans: what must not appear in them, and what must."""

from __future__ import annotations

import pytest
from conftest import random_series, to_spark
from pyspark.sql import functions as F

from tidewell.frames import Shape
from tidewell.operators import arithmetic, filters, windows
from tidewell.plans import blocks
from tidewell.session import scratch_dir

SHAPE = Shape(tie=("place",))


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def split(spark):
    spark.conf.set(blocks.BLOCK_ROWS_CONF, "25")
    yield
    spark.conf.unset(blocks.BLOCK_ROWS_CONF)


@pytest.mark.parametrize(
    "make",
    [
        lambda df: windows.moving_time(df, "mean", "1s", Shape((), tie=("place",))),
        lambda df: windows.moving_number(df, "mean", 5, Shape((), tie=("place",))),
        lambda df: windows.shift_values(df, 2, Shape((), tie=("place",))),
    ],
)
def test_one_long_series_is_not_one_task(spark, split, make):
    """The rows of a series without keys are shuffled by block; only block totals meet in one task."""
    text = plan(make(to_spark(spark, random_series(1))))
    for line_before, line in zip(text.splitlines(), text.splitlines()[1:], strict=False):
        if "SinglePartition" in line_before:
            assert "Aggregate" in line or "Window" in line or "Sort" in line, line
    windows_over_rows = [line for line in text.splitlines() if "Window [" in line and "_block" in line]
    assert windows_over_rows


def test_alignment_shuffles_each_side_once(spark):
    rows = to_spark(spark, random_series(2)).dropDuplicates(["metric", "timestamp"])
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        left, right = blocks.pin(rows), blocks.pin(rows)
        text = plan(arithmetic.apply_binary(left, right, "add", SHAPE))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert text.count("Exchange hashpartitioning") == 2


def test_chained_operators_count_rows_once(spark, monkeypatch):
    calls = []
    real = blocks.measure
    monkeypatch.setattr(blocks, "measure", lambda *a, **k: calls.append(1) or real(*a, **k))
    rows = to_spark(spark, random_series(3))
    smooth = windows.moving_time(rows, "mean", "10s", SHAPE)
    summed = windows.cumulative_sum(filters.drop_missing(smooth, SHAPE), SHAPE)
    windows.consecutive_differences(summed, SHAPE).count()
    assert len(calls) == 1


def test_facts_do_not_outlive_other_rows(spark):
    rows = to_spark(spark, random_series(4))
    blocks.learn(rows, SHAPE, blocks.DEFAULT_BLOCK_ROWS)
    assert blocks.facts_of(rows, SHAPE) is not None
    assert blocks.facts_of(rows.unionByName(rows), SHAPE) is None
    assert blocks.facts_of(rows, Shape(("place",))) is None


def test_facts_table_is_broadcast_only_when_small(spark, monkeypatch):
    rows = to_spark(spark, random_series(5))
    facts = rows.groupBy("metric").agg(F.max("value").alias("top"))
    assert "BroadcastHashJoin" in plan(blocks.join_per_series(rows, facts, ("metric",)))
    monkeypatch.setattr(blocks, "SERIES_BROADCAST", 2)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = blocks.join_per_series(rows, facts, ("metric",))
        assert "Broadcast" not in plan(joined) and joined.count() == rows.count()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_scratch_folder_is_the_named_one(spark):
    assert scratch_dir(spark) == spark.sparkContext.getConf().get("spark.checkpoint.dir")


def test_range_blocks_are_pinned(spark, split):
    laid = blocks.lay_out(to_spark(spark, random_series(6)), SHAPE, by_range=True)
    assert "tidewell-" in plan(laid.df) and "RoundRobin" not in plan(laid.df)


def test_only_long_series_are_cut(spark, split):
    rows = to_spark(spark, random_series(7))
    laid = blocks.lay_out(rows, SHAPE)
    counts = {r["metric"]: r["n"] for r in laid.df.groupBy("metric").agg(F.count_distinct(blocks.BLOCK).alias("n")).collect()}
    assert counts["single"] == 1 and counts["big"] > 5


def test_small_series_are_not_copied(spark, split):
    rows = to_spark(spark, random_series(8))
    facts = blocks.learn(rows, SHAPE, 25, ticks=True)
    ticked = rows.withColumn("_tick", F.unix_micros("timestamp"))
    copies = blocks._copy_to_cells(blocks._with_cells(ticked, SHAPE, facts, 10_000_000), 10_000_000)
    assert copies.where("metric = 'single'").count() == 1
    assert rows.count() < copies.count() < 2 * rows.count()


def test_blocks_of_python_workers_are_small_by_default(spark):
    rows = spark.range(300_000).selectExpr("timestamp_seconds(id) as timestamp", "'a' as metric", "double(id) as value")
    laid = blocks.lay_out(rows, Shape())
    fullest = laid.df.groupBy("metric", blocks.BLOCK).count().agg(F.max("count")).first()[0]
    assert laid.split and fullest <= 150_000
