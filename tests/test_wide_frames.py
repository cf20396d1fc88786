"""Frames of many columns, and artefacts that differ in their columns."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidewell.frames import FrameError, Shape
from tidewell.operators import aggregates, charts
from tidewell.sources import store


def test_correlations_of_many_columns(spark, monkeypatch):
    """Missing values, a constant column, an empty one, and columns far from zero: equal to pandas and to the small plan."""
    rng = np.random.default_rng(8)
    base = rng.normal(0, 1, (400, 5))
    frame = pd.DataFrame({f"c {i}": base[:, i % 5] * (i + 1) + rng.normal(0, 0.5, 400) + 1e6 * (i % 3) for i in range(60)})
    frame = frame.mask(rng.random(frame.shape) < 0.1)
    frame["constant"], frame["empty"] = 3.0, np.nan
    rows = spark.createDataFrame(frame.astype(object).where(frame.notna(), None).values.tolist(), ", ".join(f"`{c}` double" for c in frame.columns)).repartition(5)
    want = frame.corr()
    found = {(r["x"], r["y"]): r["corr"] for r in charts.correlation_matrix(rows, list(frame.columns)).collect()}
    assert len(found) == 62 * 62
    for (x, y), got in found.items():
        assert (got is None) == bool(np.isnan(want.loc[x, y])), (x, y)
        assert got is None or got == pytest.approx(want.loc[x, y], abs=1e-9)
    few = list(frame.columns[:6]) + ["constant", "empty"]
    small = {(r["x"], r["y"]): r["corr"] for r in charts.correlation_matrix(rows, few).collect()}
    monkeypatch.setattr(charts, "MANY_COLUMNS", 2)
    wide = {(r["x"], r["y"]): r["corr"] for r in charts.correlation_matrix(rows, few).collect()}
    assert small.keys() == wide.keys()
    assert all(wide[k] is None if v is None else wide[k] == pytest.approx(v, abs=1e-9) for k, v in small.items())


def test_medians_of_several_columns_in_one_pass(spark):
    rng = np.random.default_rng(4)
    frame = pd.DataFrame({"key": rng.choice(["a", "b"], 200), "x": rng.integers(0, 50, 200), "y": rng.normal(0, 1, 200)})
    frame["y"] = frame["y"].mask(rng.random(200) < 0.2)
    data = [(None if k == "b" else k, int(x), None if np.isnan(y) else float(y)) for k, x, y in frame.itertuples(index=False)]
    rows = spark.createDataFrame(data, "key string, x int, y double").repartition(3).withColumn("z", F.lit(None).cast("double"))
    found = {r["key"]: r[1:] for r in aggregates.median(rows, Shape(("key",), "x", "y"), ["x", "y", "z"]).collect()}
    want = frame.groupby("key")[["x", "y"]].median()
    assert found == {None: (*want.loc["b"], None), "a": (*want.loc["a"], None)}
    whole = aggregates.median(rows, Shape((), "x", "y"), ["x", "y"]).first()
    assert tuple(whole) == (frame["x"].median(), frame["y"].median())


def test_artefacts_of_one_name_may_differ(spark, tmp_path):
    base = str(tmp_path)
    import datetime as dt

    for day, frame in ((1, spark.range(3)), (2, spark.createDataFrame([("a", 1.5)], "s string, v double"))):
        store.store_frame(frame, base, "result", "job 1", dt.datetime(2024, 1, day, tzinfo=dt.timezone.utc))
    assert store.load_frame(spark, base, "result").columns == ["s", "v"]
    assert store.load_frame(spark, base, "result", "2024-01-01T00-00-00.000000", "job 1").count() == 3
    assert store.load_frame(spark, base, "result", job_id="job 1").first()["v"] == 1.5
    with pytest.raises(FrameError):
        store.load_frame(spark, base, "result", job_id="other")
