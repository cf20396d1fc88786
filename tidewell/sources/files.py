"""CSV and Parquet files, whole directory trees with per-file settings, and file sinks."""

from __future__ import annotations

import datetime as dt
import json
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewell.frames import FrameError, nan_to_null

SETTINGS_SUFFIX = ".settings.json"
TIMESTAMP_FORMAT = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"

# Names of file settings and the Spark option each one stands for.
CSV_OPTIONS = {
    "sep": "sep", "delimiter": "sep", "encoding": "encoding", "quotechar": "quote", "escapechar": "escape",
    "comment": "comment", "na_values": "nullValue", "date_format": "timestampFormat", "na_rep": "nullValue",
    "compression": "compression", "lineterminator": "lineSep", "skipinitialspace": "ignoreLeadingWhiteSpace",
}
#: Settings of the index, which is a column like any other here, so that they change nothing.
IGNORED_CSV_SETTINGS = {"index", "index_col", "parse_dates"}
UNSPLITTABLE = (".zip", ".xz")
BUILT_IN = ("csv", "parquet")


@dataclass(frozen=True)
class FileFormat:
    """A format of the user's, both ways as Spark jobs.

    ``read(spark, paths, schema, settings)`` gives the rows of files with their ``_metadata`` still to be asked for;
    ``write(df, path, mode)`` writes a folder of such files. Either may be missing.
    """

    read: Callable[[SparkSession, list[str], T.StructType | str | None, dict], DataFrame] | None = None
    write: Callable[[DataFrame, str, str], None] | None = None


FILE_FORMATS: dict[str, FileFormat] = {}


def register_file_format(ending: str, file_format: FileFormat) -> None:
    """Use a format for all files with the ending, in data sets and as a sink. ``csv`` and ``parquet`` stay as they are."""
    ending = ending.removeprefix(".").lower()
    if ending in BUILT_IN or not ending or "." in ending:
        raise FrameError(f"a file format can't have the ending {ending!r}")
    FILE_FORMATS[ending] = file_format


def csv_options(settings: dict) -> dict[str, str]:
    """Spark options for CSV settings; an unknown setting is refused rather than dropped.

    The settings in ``IGNORED_CSV_SETTINGS`` are accepted and have no effect.
    """
    options = {"header": "true"}
    for name, val in settings.items():
        if name == "header":
            options["header"] = "false" if val in (None, False) else "true"
        elif name in CSV_OPTIONS:
            options[CSV_OPTIONS[name]] = str(val).lower() if isinstance(val, bool) else str(val)
        elif name not in IGNORED_CSV_SETTINGS:
            raise FrameError(f"CSV setting {name!r} is not supported")
    return options


def read_csv(spark: SparkSession, path: str | list[str], schema: T.StructType | str | None = None, **settings) -> DataFrame:
    """CSV files, plain or compressed with gzip or bzip2. Without a schema one pass infers it.

    The header must agree with the schema in names and order, and a row that does not fit (a malformed
    cell, too many or too few cells) stops the job instead of losing its content.
    """
    paths = [path] if isinstance(path, str) else path
    for p in paths:
        if p.endswith(UNSPLITTABLE):
            raise FrameError(f"{p}: zip and xz archives are not supported, use gzip, bzip2 or plain files")
    reader = spark.read.options(**csv_options(settings)).option("mode", "FAILFAST").option("enforceSchema", "false")
    reader = reader.schema(schema) if schema is not None else reader.option("inferSchema", "true")
    return nan_to_null(reader.csv(paths))


def read_semicolon(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Uploaded files with a header, semicolons and the index in the first column."""
    return read_csv(spark, path, schema, sep=";")


def write_csv(df: DataFrame, path: str, mode: str = "overwrite", **settings) -> None:
    df.write.mode(mode).options(**{"timestampFormat": TIMESTAMP_FORMAT, **csv_options(settings)}).csv(path)


def read_parquet(spark: SparkSession, path: str | list[str]) -> DataFrame:
    paths = [path] if isinstance(path, str) else path
    return nan_to_null(spark.read.parquet(*paths))


def write_parquet(df: DataFrame, path: str, mode: str = "overwrite", partition_by: tuple[str, ...] = ()) -> None:
    df.write.mode(mode).partitionBy(*partition_by).parquet(path)


def _kind(name: str) -> str | None:
    base = name
    for packed in (".gz", ".bz2"):
        base = base.removesuffix(packed)
    ending = base.rsplit(".", 1)[-1]
    return ending if ending in BUILT_IN or (ending in FILE_FORMATS and FILE_FORMATS[ending].read) else None


def find_files(spark: SparkSession, top: str, walk: bool = True) -> DataFrame:
    """Data files below ``top`` with their settings, one row per file.

    The listing reads no data: only the settings files are opened.
    """
    listing = spark.read.format("binaryFile").option("recursiveFileLookup", str(walk).lower()).load(top)
    names = listing.select("path", "length").where(~F.col("path").endswith(SETTINGS_SUFFIX))
    sidecars = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", str(walk).lower())
        .option("pathGlobFilter", f"*{SETTINGS_SUFFIX}")
        .load(top)
        .select(
            F.regexp_replace("path", SETTINGS_SUFFIX.replace(".", r"\.") + "$", "").alias("path"),
            F.col("content").cast("string").alias("settings"),
        )
    )
    files = names.join(sidecars, "path", "left")
    flag = F.get_json_object("settings", "$.loadable")
    return files.select(
        "path",
        "length",
        F.coalesce(flag.cast("boolean"), F.lit(True)).alias("loadable"),
        F.coalesce(F.get_json_object("settings", "$.writable").cast("boolean"), F.lit(False)).alias("writable"),
        F.get_json_object("settings", "$.load_settings").alias("load_settings"),
        F.get_json_object("settings", "$.write_settings").alias("write_settings"),
    )


def read_dataset(
    spark: SparkSession, top: str, schema: T.StructType | str, walk: bool = True
) -> DataFrame:
    """All loadable files of known formats below ``top`` as one frame with their ``file_path``.

    Files are grouped by kind and settings; each group is one distributed read.
    """
    groups: dict[tuple[str, str], list[str]] = {}
    for row in find_files(spark, top, walk).where("loadable").select("path", "load_settings").toLocalIterator():
        kind = _kind(row["path"])
        if kind:
            groups.setdefault((kind, row["load_settings"] or "{}"), []).append(row["path"])
    result = None
    for (kind, settings), paths in sorted(groups.items()):
        if kind == "csv":
            part = read_csv(spark, paths, schema, **json.loads(settings))
        elif kind in FILE_FORMATS:
            part = nan_to_null(FILE_FORMATS[kind].read(spark, paths, schema, json.loads(settings)))
        else:
            part = nan_to_null(spark.read.schema(schema).parquet(*paths))
        part = part.select("*", F.col("_metadata.file_path").alias("file_path"))
        if kind in FILE_FORMATS:
            part = part.drop("_metadata")
        result = part if result is None else result.unionByName(part)
    if result is None:
        raise FrameError(f"no loadable file below {top}")
    return result


def write_generic(df: DataFrame, folder: str, job_id: str, file_name: str | None = None) -> str:
    """A new data set ``<utc now>_<job id>.csv`` in a folder, or one of a given name; returns its path."""
    name = file_name or f"{dt.datetime.now(dt.timezone.utc):%Y-%m-%dT%H%M%S.%f}_{job_id}.csv"
    kind = name.rsplit(".", 1)[-1]
    path = f"{folder.rstrip('/')}/{name}"
    if kind == "csv":
        write_csv(df, path, "errorifexists")
    elif kind == "parquet":
        write_parquet(df, path, "errorifexists")
    elif kind in FILE_FORMATS and FILE_FORMATS[kind].write:
        FILE_FORMATS[kind].write(df, path, "errorifexists")
    else:
        raise FrameError(f"file name {name!r} must end with .csv, .parquet or the ending of a format that can be written")
    return path
