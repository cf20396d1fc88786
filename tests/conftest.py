from __future__ import annotations

import datetime as dt
import sys
from pathlib import Path

import numpy as np
import pandas as pd
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from tidewell.plans import blocks  # noqa: E402
from tidewell.session import get_session  # noqa: E402

UTC = dt.timezone.utc


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = get_session(
        "tests",
        "local[4]",
        **{
            "spark.sql.shuffle.partitions": "4",
            "spark.driver.memory": "4g",
            "spark.sql.maxMetadataStringLength": "2000",
            "spark.ui.showConsoleProgress": "false",
            "spark.checkpoint.dir": str(tmp_path_factory.mktemp("scratch")),
        },
    )
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()


@pytest.fixture(params=["whole", "cells", "range"])
def layout(request, spark, monkeypatch):
    """The three ways a series is laid out: in one piece, in time cells, in range-sorted parts."""
    if request.param != "whole":
        spark.conf.set(blocks.BLOCK_ROWS_CONF, "25")
    if request.param == "range":
        monkeypatch.setattr(blocks, "HOT_FACTOR", 0)
    yield request.param
    spark.conf.unset(blocks.BLOCK_ROWS_CONF)


def stamp(text: str) -> dt.datetime:
    return dt.datetime.fromisoformat(text.replace("Z", "+00:00"))


def long_frame(spark, rows, metric: str = "a"):
    """Rows of (text timestamp, value) or (text timestamp, metric, value)."""
    full = [(stamp(r[0]), metric if len(r) == 2 else r[1], r[-1]) for r in rows]
    return spark.createDataFrame(full, "timestamp timestamp, metric string, value double")


def random_series(seed: int = 1, rows: int = 400, repeated: bool = True, missing: float = 0.1) -> pd.DataFrame:
    """Unsorted points of three series: one large, one small with bursts, one single point."""
    rng = np.random.default_rng(seed)
    micros = rng.integers(0, 4_000_000_000, rows)
    burst = rng.integers(1_000_000_000, 1_000_500_000, rows // 4)
    at = np.concatenate([micros, burst])
    if not repeated:
        at = np.unique(at)
    else:
        at = np.concatenate([at, at[:20]])
    metric = np.where(rng.random(len(at)) < 0.8, "big", "small")
    value = np.round(rng.normal(50, 20, len(at)), 2)
    value = np.where(rng.random(len(at)) < missing, np.nan, value)
    frame = pd.DataFrame({"timestamp": pd.to_datetime(at, unit="us"), "metric": metric, "value": value})
    single = pd.DataFrame({"timestamp": pd.to_datetime([5], unit="us"), "metric": ["single"], "value": [7.5]})
    frame = pd.concat([frame, single], ignore_index=True).sample(frac=1, random_state=seed, ignore_index=True)
    frame["place"] = np.arange(len(frame))
    return frame


def to_spark(spark, frame: pd.DataFrame):
    rows = [
        (t.to_pydatetime().replace(tzinfo=UTC), m, None if np.isnan(v) else float(v), int(p))
        for t, m, v, p in frame[["timestamp", "metric", "value", "place"]].itertuples(index=False)
    ]
    return spark.createDataFrame(rows, "timestamp timestamp, metric string, value double, place bigint").repartition(3)


def ordered(frame: pd.DataFrame) -> pd.DataFrame:
    return frame.sort_values(["metric", "timestamp", "place"], ignore_index=True)


def by_place(df, column: str = "value") -> dict[int, float | None]:
    return {r["place"]: r[column] for r in df.select("place", column).collect()}


def assert_close(found: dict, expected: dict) -> None:
    assert found.keys() == expected.keys()
    for key, want in expected.items():
        got = found[key]
        if want is None or (isinstance(want, float) and np.isnan(want)):
            assert got is None, (key, got, want)
        else:
            assert got == pytest.approx(want, rel=1e-9, abs=1e-9), key
