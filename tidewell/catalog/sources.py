"""Readers and writers: tables go out to the scratch folder in one format and come back."""

from __future__ import annotations

import datetime as dt
import json
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewell.catalog.base import CTE_BINS, CTE_EVENTS, bins, events, query, table
from tidewell.frames import update_attributes
from tidewell.functions.user import per_batch, per_series, run_component
from tidewell.operators.aggregates import average
from tidewell.session import scratch_dir
from tidewell.sources import files, payload, rest, series, store, tables

EVENT_SCHEMA = "timestamp timestamp, metric string, value double"
SELECT_EVENTS = f"WITH {CTE_EVENTS} SELECT timestamp, metric, value FROM e"


def _folder(spark) -> str:
    return f"{scratch_dir(spark)}/io-{uuid.uuid4().hex}"


def _put_text(spark, path: str, text: str) -> None:
    """One small file through the file system Spark itself uses for the path."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    target = jvm.org.apache.hadoop.fs.Path(path)
    stream = target.getFileSystem(conf).create(target, False)
    stream.write(bytearray(text, "utf8"))
    stream.close()


@query("csv_write_and_read", SELECT_EVENTS)
def _csv(spark, sf_dir):
    path = _folder(spark)
    files.write_csv(events(spark, sf_dir), path, sep="|", na_rep="-")
    return files.read_csv(spark, path, EVENT_SCHEMA, sep="|", na_values="-")


@query("csv_gzip", SELECT_EVENTS)
def _gzip(spark, sf_dir):
    path = _folder(spark)
    files.write_csv(events(spark, sf_dir), path, compression="gzip")
    return files.read_csv(spark, path, EVENT_SCHEMA)


@query("semicolon_csv_upload", SELECT_EVENTS)
def _semicolon(spark, sf_dir):
    path = _folder(spark)
    files.write_csv(events(spark, sf_dir), path, sep=";")
    return files.read_semicolon(spark, path, EVENT_SCHEMA)


@query("parquet_write_and_read", SELECT_EVENTS)
def _parquet(spark, sf_dir):
    path = _folder(spark)
    files.write_parquet(events(spark, sf_dir), path, partition_by=("metric",))
    return files.read_parquet(spark, path).select("timestamp", "metric", "value")


@query("many_file_dataset", f"WITH {CTE_EVENTS} SELECT timestamp, metric, value FROM e WHERE value <= 100")
def _dataset(spark, sf_dir):
    """Two kinds of files and two separators in one tree; the files of large values are not loadable."""
    top, rows = _folder(spark), events(spark, sf_dir)
    value = F.col("value")
    files.write_csv(rows.where(value <= 20), f"{top}/a")
    files.write_csv(rows.where((value > 20) & (value <= 60)), f"{top}/b/c", sep=";")
    files.write_parquet(rows.where((value > 60) & (value <= 100)), f"{top}/d")
    files.write_csv(rows.where(value > 100), f"{top}/e")
    for row in files.find_files(spark, f"{top}/b/c").collect():
        _put_text(spark, row["path"] + files.SETTINGS_SUFFIX, json.dumps({"load_settings": {"sep": ";"}}))
    for row in files.find_files(spark, f"{top}/e").collect():
        _put_text(spark, row["path"] + files.SETTINGS_SUFFIX, json.dumps({"loadable": False}))
    return files.read_dataset(spark, top, EVENT_SCHEMA).select("timestamp", "metric", "value")


@query("generic_sink_file", SELECT_EVENTS)
def _generic(spark, sf_dir):
    path = files.write_generic(events(spark, sf_dir), _folder(spark), str(uuid.uuid4()), "result.parquet")
    return files.read_parquet(spark, path)


def _read_pairs(spark, paths, schema, settings):
    """Lines of `name=value` pairs, split by the sign that the settings name."""
    pairs = F.str_to_map("value", F.lit(settings.get("between", ";")), F.lit("="))
    lines = spark.read.text(paths).select(pairs.alias("pairs"), "_metadata")
    wanted = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    return lines.select(*[F.col("pairs")[f.name].cast(f.dataType).alias(f.name) for f in wanted], "_metadata")


def _write_pairs(df, path, mode):
    text = F.concat_ws(";", *[F.concat(F.lit(f"{c}="), F.col(c).cast("string")) for c in df.columns])
    df.select(text.alias("value")).write.mode(mode).text(path)


@query("custom_file_format", SELECT_EVENTS)
def _custom_format(spark, sf_dir):
    """A registered format, written as a sink and read as a data set."""
    files.register_file_format("pairs", files.FileFormat(_read_pairs, _write_pairs))
    rows, folder = events(spark, sf_dir), _folder(spark)
    path = files.write_generic(rows, folder, str(uuid.uuid4()), "result.pairs")
    return files.FILE_FORMATS["pairs"].read(spark, [path], rows.schema, {}).select("timestamp", "metric", "value")


@query("sql_table_read", "SELECT * FROM customer")
def _sql_table(spark, sf_dir):
    table(spark, sf_dir, "customer").createOrReplaceTempView("tidewell_customer")
    return tables.read_query(spark, "SELECT * FROM tidewell_customer")


@query(
    "sql_query_read",
    "SELECT c_mktsegment, count(*) AS customers, round(sum(c_acctbal), 2) AS balance FROM customer GROUP BY c_mktsegment",
    {"balance": 2},
)
def _sql_query(spark, sf_dir):
    table(spark, sf_dir, "customer").createOrReplaceTempView("tidewell_customer")
    statement = """SELECT c_mktsegment, count(*) AS customers, round(sum(c_acctbal), 2) AS balance
    FROM tidewell_customer GROUP BY c_mktsegment"""
    return tables.read_query(spark, statement)


MAPPING = {"timestamp": "ts", "metric": "event_type"}


@query(
    "timeseries_table_read",
    f"""WITH {CTE_EVENTS} SELECT timestamp, metric, value FROM e WHERE metric IN ('click', 'view')
    AND timestamp BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-06 12:00:00'""",
)
def _ts_table(spark, sf_dir):
    return series.read_multits(
        table(spark, sf_dir, "events"), "2024-01-05T00:00:00Z", "2024-01-06T12:00:00Z", '["click", "view"]', MAPPING
    )


@query(
    "timeseries_table_append",
    f"WITH {CTE_EVENTS} SELECT timestamp AS ts, metric AS event_type, value, CAST(timestamp AS DATE) AS date FROM e",
)
def _ts_append(spark, sf_dir):
    path, rows = _folder(spark), events(spark, sf_dir)
    series.append_multits(rows.where("value <= 50").withColumn("extra", F.lit(1)), path, MAPPING)
    series.append_multits(rows.where("value > 50"), path, MAPPING)
    return spark.read.parquet(path)


@query("column_mapping", "SELECT ts, event_type, value FROM events")
def _mapping(spark, sf_dir):
    renamed = series.rename_from_table(table(spark, sf_dir, "events"), MAPPING)
    return series.rename_to_table(renamed, MAPPING).select("ts", "event_type", "value")


@query("relative_time_range", f"WITH {CTE_EVENTS} SELECT * FROM e WHERE timestamp BETWEEN TIMESTAMP '2024-01-13' AND TIMESTAMP '2024-01-20'")
def _relative(spark, sf_dir):
    now = dt.datetime(2024, 1, 20, tzinfo=dt.timezone.utc)
    low, high = series.relative_range(last="7d", now=now)
    return series.read_multits(table(spark, sf_dir, "events"), low, high, "ALL", MAPPING)


@query("source_thresholds", f"WITH {CTE_EVENTS} SELECT timestamp, metric, value FROM e WHERE value > 12.31 AND value < 80")
def _thresholds(spark, sf_dir):
    return series.between_thresholds(events(spark, sf_dir), 12.31, 80)


@query("column_and_metric_selection", f"WITH {CTE_EVENTS} SELECT timestamp, value FROM e WHERE metric IN ('error', 'signup')")
def _selection(spark, sf_dir):
    chosen = series.select_metrics(events(spark, sf_dir), ["error", "signup"])
    return series.select_columns(chosen, '["timestamp", "value"]')


# JSON endpoints, as dumps in the scratch folder ----------------------------------------------------


def _dump(spark, rows, endpoint: str, ref: str | None = None) -> str:
    url = f"file://{_folder(spark).removeprefix('file:')}"
    if endpoint == "timeseries":
        rest.write_timeseries(rows.select(F.col("metric").alias("timeseriesId"), "timestamp", "value"), url)
    elif endpoint == "multitsframe":
        rest.write_multitsframe(rows.select("timestamp", "metric", "value"), url, ref)
    else:
        rest.write_frame(rows, url, ref)
    return url


METRICS = ["click", "error", "purchase", "signup", "view"]


@query(
    "rest_timeseries",
    f"""WITH {CTE_EVENTS} SELECT metric AS "timeseriesId", timestamp, value FROM e
    WHERE timestamp BETWEEN TIMESTAMP '2024-01-02' AND TIMESTAMP '2024-01-29'""",
)
def _rest_series(spark, sf_dir):
    url = _dump(spark, events(spark, sf_dir), "timeseries")
    return rest.read_timeseries(spark, url, METRICS, "2024-01-02T00:00:00Z", "2024-01-29T00:00:00Z", per_slice="10d")


@query("rest_multitsframe", SELECT_EVENTS)
def _rest_multits(spark, sf_dir):
    url = _dump(spark, events(spark, sf_dir), "multitsframe", "plant")
    return rest.read_multitsframe(spark, url, "plant", "2024-01-01T00:00:00Z", "2024-02-01T00:00:00Z")


@query("rest_dataframe", "SELECT o_orderkey, o_orderdate AS timestamp, o_totalprice, o_orderpriority FROM orders")
def _rest_frame(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(
        "o_orderkey", F.col("o_orderdate").cast("timestamp").alias("timestamp"), "o_totalprice", "o_orderpriority"
    )
    url = _dump(spark, rows, "dataframe", "orders")
    return rest.read_frame(spark, url, "orders", rows.schema)


@query(
    "rest_metadata",
    """SELECT CAST(n_nationkey AS VARCHAR) AS id, n_name AS name, CAST(n_regionkey AS BIGINT) AS region, n_regionkey = 1 AS west,
    CAST(n_nationkey AS BIGINT) AS code FROM nation""",
)
def _rest_metadata(spark, sf_dir):
    nations = table(spark, sf_dir, "nation")
    pairs = F.array(
        F.struct(F.lit("name").alias("key"), F.col("n_name").alias("value")),
        F.struct(F.lit("region").alias("key"), F.col("n_regionkey").cast("string").alias("value")),
        F.struct(F.lit("west").alias("key"), (F.col("n_regionkey") == 1).cast("string").alias("value")),
        F.struct(F.lit("info").alias("key"), F.to_json(F.struct(F.col("n_nationkey").alias("code"))).alias("value")),
    )
    rows = nations.select(F.col("n_nationkey").cast("string").alias("id"), F.explode(pairs).alias("p")).select("id", "p.*")
    url = f"file://{_folder(spark).removeprefix('file:')}"
    rest.write_metadata(rows, url)
    ids = nations.select(F.col("n_nationkey").cast("string").alias("id"))
    found = rest.read_metadata(spark, url, ids)
    typed = rest.typed_metadata(found, {"name": "string", "region": "int", "west": "boolean", "info": "any"})
    return typed.withColumn("code", F.try_variant_get("info", "$.code", "bigint")).drop("info")


# Documents ---------------------------------------------------------------------------------------


@query("payload_encode_and_decode_series", SELECT_EVENTS)
def _payload_series(spark, sf_dir):
    documents = payload.encode_series(events(spark, sf_dir), part_rows=500)
    return payload.decode_series(documents.drop("part"), "document")


@query("payload_encode_and_decode_frame", f"WITH {CTE_BINS} SELECT metric, timestamp, value, value / 2 AS half FROM l", {"half": 4})
def _payload_frame(spark, sf_dir):
    rows = bins(spark, sf_dir).withColumn("half", F.col("value") / 2)
    documents = payload.encode_frame(rows, part_rows=500)
    schema = T.StructType.fromDDL("value double, half double")
    return payload.decode_frame(documents.drop("part"), "document", schema)


# Stores ------------------------------------------------------------------------------------------


@query(
    "model_store",
    """WITH f AS (SELECT regr_slope(l_extendedprice, l_quantity) AS b, regr_intercept(l_extendedprice, l_quantity) AS a FROM lineitem)
    SELECT l_orderkey, l_linenumber, a + b * l_quantity AS prediction FROM lineitem, f""",
    {"prediction": 4},
)
def _model_store(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_tax")
    base = _folder(spark)
    for tag, column in (("first", "l_tax"), ("second", "l_quantity")):
        features = VectorAssembler(inputCols=[column], outputCol="features").transform(rows)
        model = LinearRegression(labelCol="l_extendedprice", solver="normal").fit(features)
        store.store_model(spark, model, base, "price", tag)
    loaded = store.load_model(spark, base, "price")
    return loaded.transform(features).select("l_orderkey", "l_linenumber", "prediction")


@query("artefact_store", f"WITH {CTE_EVENTS} SELECT timestamp, metric, value FROM e WHERE value > 50")
def _artefact_store(spark, sf_dir):
    base, rows = _folder(spark), events(spark, sf_dir)
    first = dt.datetime(2024, 5, 1, tzinfo=dt.timezone.utc)
    store.store_frame(rows, base, "scores", "job-a", first)
    store.store_frame(rows.where("value > 50"), base, "scores", "job-b", first + dt.timedelta(seconds=1))
    return store.load_frame(spark, base, "scores")


# User functions ----------------------------------------------------------------------------------


@query("custom_component", f"WITH {CTE_EVENTS} SELECT metric, avg(value) AS value FROM e WHERE value > 10 GROUP BY metric", {"value": 7})
def _component(spark, sf_dir):
    def main(*, rows, limit):
        return {"mean": average(rows.where(F.col("value") > limit)), "rest": rows.where(F.col("value") <= limit)}

    return run_component(main, ["mean", "rest"], rows=events(spark, sf_dir), limit=10)["mean"]


@query(
    "user_code_per_series",
    f"""WITH {CTE_EVENTS} SELECT metric, timestamp, value - first_value(value) OVER (PARTITION BY metric ORDER BY timestamp) AS value FROM e""",
    {"value": 5},
)
def _per_series(spark, sf_dir):
    def above_start(pieces: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        start = None
        for piece in pieces:
            if start is None and len(piece):
                start = piece["value"].iloc[0]
            yield piece.assign(value=piece["value"] - start)

    return per_series(events(spark, sf_dir), above_start, EVENT_SCHEMA, pieces=True)


@query("user_code_per_batch", f"WITH {CTE_EVENTS} SELECT timestamp, metric, value * 2 AS value FROM e", {"value": 5})
def _per_batch(spark, sf_dir):
    return per_batch(events(spark, sf_dir), lambda pdf: pdf.assign(value=pdf["value"] * 2), EVENT_SCHEMA)


@query("metadata_through_files", f"""WITH {CTE_EVENTS} SELECT timestamp, metric, value, '{{"unit": "kW"}}' AS attributes FROM e""")
def _metadata(spark, sf_dir):
    path = _folder(spark)
    files.write_parquet(update_attributes(events(spark, sf_dir), {"unit": "kW"}, "timestamp"), path)
    back = spark.read.parquet(path)
    return back.withColumn("attributes", F.lit(back.schema["timestamp"].metadata["attrs"]))


