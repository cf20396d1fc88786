"""SQL tables over JDBC, and queries over registered views."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidewell.frames import FrameError, nan_to_null
from tidewell.sources.series import prepare_multits


def jdbc_options(
    url: str, table: str | None = None, query: str | None = None, column: str | None = None,
    lower: object = None, upper: object = None, partitions: int | None = None, **more: str,
) -> dict[str, str]:
    """Options of a JDBC read; with a numeric or time ``column`` it is split into range scans."""
    if (table is None) == (query is None):
        raise FrameError("give a table or a query")
    options = {"url": url, "fetchsize": "10000", **more}
    split = (column, lower, upper, partitions)
    if any(v is not None for v in split):
        if any(v is None for v in split):
            raise FrameError("a partitioned read needs column, lower, upper and partitions")
        options |= {
            "partitionColumn": column, "lowerBound": str(lower), "upperBound": str(upper),
            "numPartitions": str(partitions),
        }
        options["dbtable"] = table if table is not None else f"({query}) q"
    elif table is not None:
        options["dbtable"] = table
    else:
        options["query"] = query
    return options


def read_table(spark: SparkSession, url: str, table: str, **options) -> DataFrame:
    """A whole table; filters and column choices on the result are pushed into the database."""
    return nan_to_null(spark.read.format("jdbc").options(**jdbc_options(url, table, **options)).load())


def read_query(spark: SparkSession, query: str, url: str | None = None, **options) -> DataFrame:
    """A query run by the database, or by Spark over the registered views when no url is given."""
    if url is None:
        return spark.sql(query)
    return nan_to_null(spark.read.format("jdbc").options(**jdbc_options(url, query=query, **options)).load())


def append_table(df: DataFrame, url: str, table: str, **options: str) -> None:
    """Append, creating the table if absent. Commits are per task; see :func:`append_staged`."""
    df.write.mode("append").options(**options).jdbc(url, table)


def replace_table(df: DataFrame, url: str, table: str, **options: str) -> None:
    """Replace the whole table, keeping its definition."""
    df.write.mode("overwrite").option("truncate", "true").options(**options).jdbc(url, table)


def append_staged(df: DataFrame, url: str, table: str, run_sql: Callable[[str], None], **options: str) -> str:
    """All-or-nothing append: fill a staging table from all tasks, then move it in one statement.

    A task that is run twice only touches the staging table, which is dropped on failure.
    """
    stage = f"{table}_stage_{uuid.uuid4().hex[:12]}"
    columns = ", ".join(df.columns)
    try:
        df.write.mode("overwrite").options(**options).jdbc(url, stage)
        run_sql(f"INSERT INTO {table} ({columns}) SELECT {columns} FROM {stage}")
    finally:
        run_sql(f"DROP TABLE {stage}")
    return stage


def append_ts_table(
    df: DataFrame, url: str, table: str, mapping: dict[str, str] | None = None, values: tuple[str, ...] = ("value",),
    appendable: bool = True, **options: str,
) -> None:
    """Append a long frame to a time-series table under the table's column names."""
    if not appendable:
        raise FrameError(f"table {table} is not appendable")
    append_table(prepare_multits(df, mapping, values), url, table, **options)
