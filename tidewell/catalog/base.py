"""Registry of the checked queries: a Spark callable and, where it exists, the same in SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewell.frames import LONG

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

# The long frame of the events table, and its largest value per ten minutes as a second series.
CTE_EVENTS = "e AS (SELECT ts AS timestamp, event_type AS metric, value FROM events)"
CTE_BINS = (
    "l AS (SELECT time_bucket(INTERVAL 10 MINUTE, ts) AS timestamp, event_type AS metric, max(value) AS value "
    "FROM events GROUP BY ALL), "
    "r AS (SELECT timestamp + INTERVAL 10 MINUTE AS timestamp, metric, value FROM l)"
)


def query(name: str, sql: str | None = None, rounded: dict[str, int] | None = None) -> Callable[[Query], Query]:
    """Register a query. ``rounded`` columns are rounded to so many digits on both sides."""
    digits = rounded or {}

    def register(function: Query) -> Query:
        @wraps(function)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return finish(function(spark, sf_dir), digits)

        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = finish_sql(sql, digits)
        return function

    return register


def finish(df: DataFrame, digits: dict[str, int]) -> DataFrame:
    """Timestamps without a zone, chosen columns rounded, no negative zero."""
    columns = []
    for field in df.schema:
        c = F.col(f"`{field.name}`")
        if field.name in digits:
            c = F.round(c, digits[field.name]) + F.lit(0.0)
        elif isinstance(field.dataType, T.TimestampType):
            c = c.cast("timestamp_ntz")
        columns.append(c.alias(field.name))
    return df.select(*columns)


def finish_sql(sql: str, digits: dict[str, int]) -> str:
    if not digits:
        return sql
    parts = ", ".join(f'round("{c}", {d}) + 0.0 AS "{c}"' for c, d in digits.items())
    return f"SELECT * REPLACE ({parts}) FROM ({sql}) q"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a long frame."""
    return table(spark, sf_dir, "events").select(
        F.col("ts").cast("timestamp").alias("timestamp"), F.col("event_type").alias("metric"), "value"
    )


def bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Largest value per metric and ten minutes: a series with gaps and a unique index."""
    rows = events(spark, sf_dir)
    start = F.window("timestamp", "10 minutes")["start"]
    return rows.groupBy(start.alias("timestamp"), "metric").agg(F.max("value").alias("value"))


def shifted_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The series of :func:`bins` ten minutes later, so that the two overlap in part."""
    return bins(spark, sf_dir).withColumn("timestamp", F.col("timestamp") + F.expr("INTERVAL 10 MINUTES"))


def both(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return bins(spark, sf_dir), shifted_bins(spark, sf_dir)


__all__ = ["LONG", "CTE_BINS", "CTE_EVENTS", "ORACLE", "QUERIES", "bins", "both", "events", "query", "shifted_bins", "table"]
