"""Time series, frames and metadata over JSON endpoints, as Spark data sources.

``tidewell_json`` reads newline-delimited records: the requested ids and time range are cut
into partitions that tasks fetch independently. The writer posts one document per batch of
rows and task. Any other base address names a folder of dumps, one folder of line files for each id,
which Spark reads itself: a large file is split over tasks, on any storage that Spark can reach.
"""

from __future__ import annotations

import datetime as dt
import json
import os
import urllib.error
import urllib.parse
import urllib.request
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from itertools import islice

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from tidewell.frames import FrameError, check_schema, is_time, parse_any, require_columns, update_attributes
from tidewell.functions.durations import positive_duration
from tidewell.operators.filters import parse_instant

FORMAT = "tidewell_json"
IDS_PER_REQUEST = 20
ROWS_PER_POST = 5_000
ROWS_PER_BATCH = 20_000
TIMEOUT_SECONDS = 300

# Declared value types and their SQL types.
VALUE_TYPES = {"int": "bigint", "float": "double", "string": "string", "boolean": "boolean", "any": "string"}


@dataclass
class Request(InputPartition):
    ids: tuple[str, ...]
    start: str | None
    end: str | None


def iso(moment: dt.datetime, digits: int = 6) -> str:
    text = moment.astimezone(dt.timezone.utc).strftime("%Y-%m-%dT%H:%M:%S.%f")
    return f"{text}{'0' * (digits - 6)}Z"


def plan_requests(ids: list[str], start: str | None, end: str | None, per_slice: str | None) -> list[Request]:
    """Groups of ids times slices of the closed range; slices do not share a timestamp."""
    groups = [tuple(ids[i : i + IDS_PER_REQUEST]) for i in range(0, len(ids), IDS_PER_REQUEST)]
    low, high = parse_instant(start), parse_instant(end)
    if low is None or high is None or per_slice is None:
        slices = [(start and iso(low), end and iso(high))]
    else:
        if low > high:
            raise FrameError(f"the range starts at {start} after its end {end}")
        step = dt.timedelta(microseconds=positive_duration(per_slice))
        tick, slices, at = dt.timedelta(microseconds=1), [], low
        while at + step <= high:
            slices.append((iso(at), iso(at + step - tick)))
            at += step
        slices.append((iso(at), iso(high)))
    return [Request(group, a, b) for group in groups for a, b in slices]


def _lines(base: str, endpoint: str, request: Request, params: list[tuple[str, str]]) -> Iterator[bytes]:
    query = [("id", ref) for ref in request.ids] + params
    if request.start:
        query.append(("from", request.start))
    if request.end:
        query.append(("to", request.end))
    url = f"{base.rstrip('/')}/{endpoint}?{urllib.parse.urlencode(query)}"
    try:
        response = urllib.request.urlopen(url, timeout=TIMEOUT_SECONDS)  # noqa: S310
    except urllib.error.URLError as error:
        if not (base.startswith("file:") and isinstance(error.reason, FileNotFoundError)):
            raise
        raise FileNotFoundError(f"no dump of {endpoint} in {base}") from error
    with response:
        yield from response


def _typed(value: object, kind: T.DataType) -> object:
    if value is None:
        return None
    if isinstance(kind, T.TimestampType):
        if isinstance(value, (int, float)):
            return dt.datetime.fromtimestamp(value / 1000, dt.timezone.utc)
        return parse_instant(_micros(str(value)))
    if isinstance(kind, T.DoubleType):
        number = float(value)
        return None if number != number else number
    if isinstance(kind, (T.LongType, T.IntegerType)):
        return int(value)
    if isinstance(kind, T.BooleanType):
        return value if isinstance(value, bool) else str(value).strip().lower() in ("true", "1", "yes", "on", "t", "y")
    return value if isinstance(value, str) else json.dumps(value)


def _micros(text: str) -> str:
    """Timestamps hold microseconds; finer digits of the text are cut off."""
    head, dot, tail = text.partition(".")
    if not dot:
        return text
    digits = len(tail) - len(tail.lstrip("0123456789"))
    return f"{head}.{tail[:digits][:6]}{tail[digits:]}"


class JsonReader(DataSourceReader):
    def __init__(self, options: dict[str, str], schema: T.StructType):
        self.base, self.endpoint = options["url"], options["endpoint"]
        self.ids = json.loads(options["ids"])
        self.start, self.end, self.slice = options.get("from"), options.get("to"), options.get("slice")
        self.params = [(k, str(v)) for k, v in json.loads(options.get("params", "{}")).items()]
        self.schema = schema

    def partitions(self) -> list[InputPartition]:
        return plan_requests(self.ids, self.start, self.end, self.slice)

    def read(self, partition: Request) -> Iterator[pa.RecordBatch]:
        """Arrow batches, so that rows reach Spark without a step per row."""
        low, high = parse_instant(partition.start), parse_instant(partition.end)
        schema = to_arrow_schema(self.schema)
        lines = (line for line in _lines(self.base, self.endpoint, partition, self.params) if line.strip())
        while batch := list(islice(lines, ROWS_PER_BATCH)):
            records = [json.loads(line) for line in batch]
            columns = [
                pa.array([_typed(r.get(f.name), f.dataType) for r in records], kind.type)
                for f, kind in zip(self.schema, schema, strict=True)
            ]
            table = pa.RecordBatch.from_arrays(columns, schema=schema)
            if "timestamp" in schema.names:
                stamp = table.column(schema.names.index("timestamp"))
                unknown = pc.is_null(stamp)
                if low is not None:
                    table = table.filter(pc.or_kleene(unknown, pc.greater_equal(stamp, pa.scalar(low, stamp.type))))
                    stamp = table.column(schema.names.index("timestamp"))
                    unknown = pc.is_null(stamp)
                if high is not None:
                    table = table.filter(pc.or_kleene(unknown, pc.less_equal(stamp, pa.scalar(high, stamp.type))))
            yield table


@dataclass
class Posted(WriterCommitMessage):
    rows: int
    files: list[str] = field(default_factory=list)


class JsonWriter(DataSourceWriter):
    """Posts ``body`` rows grouped by ``ref``.

    Dump files get a hidden name per task and attempt, and the job's commit publishes those of the
    attempts that count. A post carries a key made from its content's place in the job, the same in
    every attempt, by which an endpoint can leave out what it has already taken. Rows come sorted by ``ref``, so a
    task holds those of one at a time.
    """

    def __init__(self, options: dict[str, str]):
        self.base, self.endpoint = options["url"], options["endpoint"]
        self.per_post = int(options.get("rowsPerPost", ROWS_PER_POST))
        self.job = uuid.uuid4().hex

    def _post(self, ref: str, records: list[str], files: list[str]) -> None:
        place = f"{self.endpoint}/{urllib.parse.quote(ref, safe='')}" if self.base.startswith("file:") else self.endpoint
        if self.base.startswith("file:"):
            folder = os.path.join(urllib.request.url2pathname(urllib.parse.urlparse(self.base).path), place)
            os.makedirs(folder, exist_ok=True)
            task = TaskContext.get()
            name = f"_{self.job}-{task.partitionId()}-{task.taskAttemptId()}-{len(files)}.ndjson"
            files.append(os.path.join(folder, name))
            with open(files[-1], "w", encoding="utf8") as handle:
                handle.write("\n".join(records) + "\n")
            return
        key = f"{self.job}-{TaskContext.get().partitionId()}-{len(files)}"
        files.append(key)
        with urllib.request.urlopen(self.request(ref, records, key), timeout=TIMEOUT_SECONDS):  # noqa: S310
            pass

    def request(self, ref: str, records: list[str], key: str) -> urllib.request.Request:
        """One post; its key stays the same when a task runs again."""
        url = f"{self.base.rstrip('/')}/{self.endpoint}?{urllib.parse.urlencode({'id': ref})}"
        headers = {"Content-Type": "application/json", "Idempotency-Key": key}
        return urllib.request.Request(url, ("[" + ",".join(records) + "]").encode(), headers, method="POST")  # noqa: S310

    def write(self, iterator: Iterable) -> Posted:
        files: list[str] = []
        count, ref, waiting = 0, None, []
        for row in iterator:
            if waiting and (row["ref"] != ref or len(waiting) >= self.per_post):
                self._post(ref, waiting, files)
                waiting = []
            ref = row["ref"]
            waiting.append(row["body"])
            count += 1
        if waiting:
            self._post(ref, waiting, files)
        return Posted(count, files if self.base.startswith("file:") else [])

    def commit(self, messages: list[Posted | None]) -> None:
        for path in (f for m in messages if m for f in m.files):
            folder, name = os.path.split(path)
            os.replace(path, os.path.join(folder, name.removeprefix("_")))

    def abort(self, messages: list[Posted | None]) -> None:
        for path in (f for m in messages if m for f in m.files):
            os.remove(path)


class JsonSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        kind = VALUE_TYPES[self.options.get("type", "float")]
        return {
            "timeseries": f"timeseriesId string, timestamp timestamp, value {kind}",
            "multitsframe": f"timestamp timestamp, metric string, value {kind}",
            "metadata": "id string, key string, value string",
        }[self.options["endpoint"]]

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return JsonReader(dict(self.options), schema)

    def writer(self, schema: T.StructType, overwrite: bool) -> DataSourceWriter:
        return JsonWriter(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(JsonSource)


def _typed_text(value: Column, kind: T.DataType) -> Column:
    """A field's JSON text as the declared type; what does not fit stops the job."""
    if isinstance(kind, T.TimestampType):
        number = value.rlike(r"^-?[0-9]+(\.[0-9]+)?$")
        millis = F.timestamp_micros((F.when(number, value).cast("decimal(30,6)") * 1000).cast("bigint"))
        return F.when(number, millis).otherwise(F.when(~number, value).cast("timestamp"))
    if isinstance(kind, T.DoubleType):
        return F.nanvl(value.cast("double"), F.lit(None).cast("double"))
    if isinstance(kind, (T.LongType, T.IntegerType)):
        whole = value.rlike(r"^\s*[-+]?[0-9]+\s*$")
        return F.when(whole, F.when(whole, value).cast(kind)).otherwise(F.when(~whole, value).cast("double").cast(kind))
    if isinstance(kind, T.BooleanType):
        return F.lower(F.trim(value)).isin("true", "1", "yes", "on", "t", "y")
    return value.cast(kind)


def _dumped(spark: SparkSession, base: str, endpoint: str, ids: list[str] | DataFrame, schema: T.StructType, start, end) -> DataFrame:
    """The records of the given ids from a folder of dumps, in which an id's folder has its quoted name."""
    try:
        lines = spark.read.option("recursiveFileLookup", "true").text(f"{base.rstrip('/')}/{endpoint}")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        raise FileNotFoundError(f"no dump of {endpoint} in {base}") from error
    folder = F.element_at(F.split("_metadata.file_path", "/"), -2)
    # Quoted once by the writer, and once more in the address of the file.
    named = lines.where(F.trim("value") != "").withColumn("_ref", F.url_decode(F.url_decode(folder)))
    if isinstance(ids, DataFrame):
        wanted = ids.select(F.col(ids.columns[0]).cast("string").alias("_ref")).distinct()
        named = named.join(wanted, "_ref", "left_semi")
    else:
        named = named.where(F.col("_ref").isin(*ids))
    texts = T.StructType([T.StructField(f.name, T.StringType()) for f in schema])
    record = named.select(F.from_json("value", texts, {"mode": "FAILFAST"}).alias("r"))
    rows = record.select(*[_typed_text(F.col("r")[f.name], f.dataType).alias(f.name) for f in schema])
    if "timestamp" in schema.names:
        at = F.col("timestamp")
        if start is not None:
            rows = rows.where(at.isNull() | (at >= F.lit(parse_instant(start))))
        if end is not None:
            rows = rows.where(at.isNull() | (at <= F.lit(parse_instant(end))))
    return rows


def _read(
    spark: SparkSession, url: str, endpoint: str, ids: list[str] | DataFrame, start, end, per_slice, params, kind, schema=None
) -> DataFrame:
    options = {"url": url, "endpoint": endpoint, "type": kind}
    if not url.startswith(("http:", "https:")):
        declared = schema or JsonSource(options).schema()
        declared = T._parse_datatype_string(declared) if isinstance(declared, str) else declared
        return _dumped(spark, url, endpoint, ids, declared, start, end)
    if isinstance(ids, DataFrame):
        raise FrameError("an endpoint takes its ids as a list")
    register(spark)
    options |= {"ids": json.dumps(ids), "params": json.dumps(params or {})}
    options |= {k: v for k, v in (("from", start), ("to", end), ("slice", per_slice)) if v is not None}
    reader = spark.read.format(FORMAT).options(**options)
    return (reader.schema(schema) if schema is not None else reader).load()


def read_timeseries(
    spark: SparkSession, url: str, ids: list[str], start: str, end: str, kind: str = "float",
    params: dict | None = None, per_slice: str | None = None,
) -> DataFrame:
    """Several time series in one frame ``timeseriesId, timestamp, value``."""
    return _read(spark, url, "timeseries", ids, start, end, per_slice, params, kind)


def read_timeseries_grouped(spark: SparkSession, url: str, wanted: list[dict], start: str, end: str) -> dict[str, DataFrame]:
    """Series by id; ids with equal filters and type share one read."""
    groups: dict[tuple[str, str], list[str]] = {}
    for item in wanted:
        key = (json.dumps(item.get("filters") or {}, sort_keys=True), item.get("type", "float"))
        groups.setdefault(key, []).append(item["id"])
    result = {}
    for (filters, kind), ids in groups.items():
        rows = read_timeseries(spark, url, ids, start, end, kind, json.loads(filters))
        for ref in ids:
            result[ref] = rows.where(F.col("timeseriesId") == ref).select("timestamp", "value")
    return result


def read_frame(
    spark: SparkSession, url: str, ref: str, schema: T.StructType | str, params: dict | None = None
) -> DataFrame:
    """A frame; a ``timestamp`` column of the schema is parsed. No records give an empty typed frame."""
    return _read(spark, url, "dataframe", [ref], None, None, None, params, "float", schema)


def read_multitsframe(
    spark: SparkSession, url: str, ref: str, start: str, end: str, kind: str = "float",
    params: dict | None = None, per_slice: str | None = None,
) -> DataFrame:
    """A long frame of a closed time range, which must be given."""
    if start is None or end is None:
        raise FrameError("a long frame needs both ends of the time range")
    rows = _read(spark, url, "multitsframe", [ref], start, end, per_slice, params, kind)
    attributes = {"ref_interval_start_timestamp": start, "ref_interval_end_timestamp": end}
    return update_attributes(rows, attributes, "timestamp")


def read_metadata(spark: SparkSession, url: str, ids: list[str] | DataFrame) -> DataFrame:
    """Key and value rows of the given ids; for dumps the ids may be the first column of a frame, of any size."""
    return _read(spark, url, "metadata", ids, None, None, None, None, "string")


def typed_metadata(rows: DataFrame, types: dict[str, str]) -> DataFrame:
    """One column per declared key, cast to its type; ``any`` is decoded as JSON where possible."""
    def cell(key: str, kind: str) -> Column:
        value = F.max(F.when(F.col("key") == key, F.col("value")))
        return (parse_any(value) if kind == "any" else value.try_cast(VALUE_TYPES[kind])).alias(key)

    return rows.groupBy("id").agg(*[cell(k, t) for k, t in types.items()])


def _nano_text(df: DataFrame, column: str) -> Column:
    return F.concat(F.date_format(F.col(column).cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("000Z"))


def _bodies(df: DataFrame, ref: Column) -> DataFrame:
    cells = []
    for field in df.schema:
        c = F.col(field.name)
        if is_time(df, field.name):
            c = _nano_text(df, field.name)
        elif isinstance(field.dataType, (T.DoubleType, T.FloatType)):
            c = F.when(~F.isnan(c), c)
        cells.append(c.alias(field.name))
    return df.select(ref.alias("ref"), F.to_json(F.struct(*cells), {"ignoreNullFields": "false"}).alias("body"))


def _post(rows: DataFrame, url: str, endpoint: str, ref: Column, options: dict) -> None:
    register(rows.sparkSession)
    _bodies(rows, ref).sortWithinPartitions("ref").write.format(FORMAT).options(url=url, endpoint=endpoint, **options).mode("append").save()


def check_value_type(df: DataFrame, kind: str, column: str = "value") -> None:
    """The column must have the declared type, not merely be castable to it."""
    found = df.schema[column].dataType
    accepted = {
        "int": (T.LongType, T.IntegerType, T.ShortType, T.ByteType),
        "float": (T.DoubleType, T.FloatType),
        "string": (T.StringType,),
        "boolean": (T.BooleanType,),
        "any": (T.DataType,),
    }[kind]
    if not isinstance(found, accepted):
        raise FrameError(f"column {column} is {found.simpleString()}, declared as {kind}")


def write_timeseries(df: DataFrame, url: str, kind: str = "float", **options: str) -> None:
    """Post the series of a frame ``timeseriesId, timestamp, value``."""
    require_columns(df, "timeseriesId", "timestamp", "value")
    if not is_time(df, "timestamp"):
        raise FrameError("the index of a time series must be a timestamp")
    check_value_type(df, kind)
    _post(df.select("timeseriesId", "timestamp", "value"), url, "timeseries", F.col("timeseriesId"), options)


def write_frame(df: DataFrame, url: str, ref: str, **options: str) -> None:
    """Post a frame as records."""
    _post(df, url, "dataframe", F.lit(ref), options)


def write_multitsframe(df: DataFrame, url: str, ref: str, **options: str) -> None:
    """Post a long frame, which must have exactly its three columns and no null keys."""
    check_schema(df, "multitsframe")
    if sorted(df.columns) != ["metric", "timestamp", "value"]:
        raise FrameError(f"a long frame to send has exactly timestamp, metric and value, not {df.columns}")
    good = F.col("timestamp").isNotNull() & F.col("metric").isNotNull()
    message = F.lit("a long frame must not have null in timestamp or metric")
    rows = df.where(F.when(good, True).otherwise(F.raise_error(message).cast("boolean")))
    _post(rows, url, "multitsframe", F.lit(ref), options)


def write_metadata(rows: DataFrame, url: str, **options: str) -> None:
    """Post rows ``id, key, value``, one document each."""
    require_columns(rows, "id", "key", "value")
    _post(rows.select("id", "key", "value"), url, "metadata", F.col("id"), {"rowsPerPost": "1", **options})
