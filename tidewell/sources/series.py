"""Reading and writing long time-series tables: range, metrics, columns, thresholds."""

from __future__ import annotations

import datetime as dt
import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewell.frames import FrameError, Shape, nan_to_null, require_columns, update_attributes, validate_multits
from tidewell.functions.durations import positive_duration
from tidewell.operators.filters import parse_instant
from tidewell.operators.resampling import resample


def parse_metrics(text: str | list[str] | None) -> list[str] | None:
    """Metric names from a JSON list or a comma list; ``ALL`` means no filter, nothing means none."""
    if isinstance(text, list):
        return text
    if text is None or not text.strip():
        return []
    if text.strip().upper() == "ALL":
        return None
    if text.strip().startswith("["):
        return [str(m) for m in json.loads(text)]
    return [part.strip() for part in text.split(",") if part.strip()]


def check_mapping(mapping: dict[str, str]) -> dict[str, str]:
    """A column mapping must be invertible."""
    if len(set(mapping.values())) != len(mapping):
        raise FrameError(f"column mapping {mapping} maps two columns to one")
    return mapping


def rename_to_table(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """Frame names to table names."""
    return df.withColumnsRenamed(check_mapping(mapping))


def rename_from_table(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """Table names to frame names."""
    return df.withColumnsRenamed({table: frame for frame, table in check_mapping(mapping).items()})


def relative_range(
    start: dt.datetime | str | None = None,
    end: dt.datetime | str | None = None,
    last: str | None = None,
    now: dt.datetime | None = None,
) -> tuple[dt.datetime | None, dt.datetime | None]:
    """Absolute range, or the last ``5s`` to ``365d`` before ``now``, fixed once for the whole run."""
    if last is not None:
        if start is not None or end is not None:
            raise FrameError("give a relative or an absolute range, not both")
        moment = now or dt.datetime.now(dt.timezone.utc)
        return moment - dt.timedelta(microseconds=positive_duration(last)), moment
    if (start is None) != (end is None):
        raise FrameError("an absolute range needs both ends")
    return parse_instant(start), parse_instant(end)


def read_multits(
    table: DataFrame,
    start: dt.datetime | str | None,
    end: dt.datetime | str | None,
    metrics: str | list[str] | None = "ALL",
    mapping: dict[str, str] | None = None,
    values: tuple[str, ...] = ("value",),
) -> DataFrame:
    """Closed time range and metric choice of a time-series table as a validated long frame.

    The predicates are put on the columns of the table as they are, before any cast, so they
    reach the Parquet or JDBC scan. Range and metrics are kept as metadata of the result.
    """
    low, high = parse_instant(start), parse_instant(end)
    if low is not None and high is not None and low > high:
        raise FrameError(f"the range starts at {start} after its end {end}")
    df = rename_from_table(table, mapping or {})
    require_columns(df, "timestamp", "metric", *values)
    naive = isinstance(df.schema["timestamp"].dataType, T.TimestampNTZType)

    def bound(moment: dt.datetime):
        return F.lit(moment.replace(tzinfo=None)).cast("timestamp_ntz") if naive else F.lit(moment)

    if naive and df.sparkSession.conf.get("spark.sql.session.timeZone") not in ("UTC", "Etc/UTC"):
        raise FrameError("set spark.sql.session.timeZone to UTC: timestamps without a zone are taken as UTC")
    if low is not None:
        df = df.where(F.col("timestamp") >= bound(low))
    if high is not None:
        df = df.where(F.col("timestamp") <= bound(high))
    wanted = parse_metrics(metrics)
    if wanted is not None:
        df = df.where(F.col("metric").isin(wanted) if wanted else F.lit(False))
    frame = validate_multits(nan_to_null(df.select("timestamp", "metric", *values)))
    attributes = {"ref_interval_type": "closed", "ref_metrics": wanted if wanted is not None else "ALL"}
    if low is not None:
        attributes["ref_interval_start_timestamp"] = low.isoformat()
    if high is not None:
        attributes["ref_interval_end_timestamp"] = high.isoformat()
    return update_attributes(frame, attributes, "timestamp")


def prepare_multits(df: DataFrame, mapping: dict[str, str] | None = None, values: tuple[str, ...] = ("value",)) -> DataFrame:
    """Validated rows under the names of the table; other columns are left out."""
    require_columns(df, "timestamp", "metric", *values)
    rows = validate_multits(df).select("timestamp", "metric", *values)
    return rename_to_table(rows, mapping or {})


def append_multits(
    df: DataFrame, path: str, mapping: dict[str, str] | None = None, values: tuple[str, ...] = ("value",),
    appendable: bool = True,
) -> None:
    """Append to a time-series table of files, partitioned by day."""
    if not appendable:
        raise FrameError(f"table {path} is not appendable")
    rows = prepare_multits(df, mapping, values)
    stamp = (mapping or {}).get("timestamp", "timestamp")
    dated = rows.withColumn("date", F.to_date(stamp))
    dated.write.mode("append").partitionBy("date").parquet(path)


def read_resampled(df: DataFrame, frequency: str) -> DataFrame:
    """Source side resampling: first value per bin."""
    return resample(df, frequency, "first")


def write_resampled(df: DataFrame, frequency: str) -> DataFrame:
    """Sink side resampling: mean per bin."""
    return resample(df, frequency, "mean")


def between_thresholds(df: DataFrame, lower: float | None = None, upper: float | None = None, shape: Shape | None = None) -> DataFrame:
    """Rows strictly above ``lower`` and strictly below ``upper``."""
    value = F.col(shape.value if shape else "value")
    if lower is not None:
        df = df.where(value > F.lit(float(lower)))
    if upper is not None:
        df = df.where(value < F.lit(float(upper)))
    return df


def select_columns(df: DataFrame, columns: str | list[str]) -> DataFrame:
    """Columns named by a JSON list; an unknown one is an error."""
    names = json.loads(columns) if isinstance(columns, str) else columns
    require_columns(df, *names)
    return df.select(*names)


def select_metrics(df: DataFrame, metrics: str | list[str]) -> DataFrame:
    """Rows of the named metrics; a metric without rows in the frame is an error."""
    names = parse_metrics(metrics)
    if names is None:
        return df
    found = df.where(F.col("metric").isin(names)).select("metric").distinct()
    known = {row["metric"] for row in found.collect()}
    unknown = [n for n in names if n not in known]
    if unknown:
        raise FrameError(f"unknown metrics {unknown}")
    return df.where(F.col("metric").isin(names))
