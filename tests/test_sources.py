"""Readers, writers, documents, stores and message streams."""

from __future__ import annotations

import datetime as dt
import json
import urllib.parse

import pytest
from conftest import long_frame, stamp
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewell.frames import FrameError
from tidewell.functions.user import per_series, register_source
from tidewell.operators.aggregates import fit_regression
from tidewell.sources import files, payload, rest, series, store, tables
from tidewell.streaming.consume import check_inputs, consume
from tidewell.streaming.messages import bind_inputs, build_messages, group_outputs, open_stream, split_value_key

ROWS = [
    ("2023-08-29T11:58:02Z", "a", 1.2), ("2023-08-29T12:27:31Z", "b", 1.3), ("2023-08-29T13:07:46Z", "a", 2.0),
    ("2023-08-29T13:07:46Z", "c", 2.2),
]
MAPPING = {"metric": "tsid", "timestamp": "datetime", "value": "measurement_val"}
START = "2023-08-29T11:00:00Z"


@pytest.fixture
def frame(spark):
    return long_frame(spark, ROWS)


@pytest.mark.parametrize(("metrics", "end", "count"), [("a", "11:58:02", 1), ('["a", "b"]', "12:58:02", 2), ("ALL", "23:58:02", 4), ("", "23:58:02", 0)])
@pytest.mark.parametrize("mapping", [None, MAPPING])
def test_timeseries_table(frame, metrics, end, count, mapping):
    table = series.rename_to_table(frame, mapping or {})
    found = series.read_multits(table, START, f"2023-08-29T{end}Z", metrics, mapping)
    assert found.columns == ["timestamp", "metric", "value"] and found.count() == count
    attrs = json.loads(found.schema["timestamp"].metadata["attrs"])
    assert attrs["ref_interval_start_timestamp"] == "2023-08-29T11:00:00+00:00"
    assert attrs["ref_metrics"] == {"a": ["a"], '["a", "b"]': ["a", "b"], "ALL": "ALL", "": []}[metrics]


def test_predicates_reach_the_scan(spark, frame, tmp_path):
    naive = frame.withColumn("timestamp", F.col("timestamp").cast("timestamp_ntz")).withColumn("extra", F.lit(1))
    naive.write.parquet(str(tmp_path / "t"))
    found = series.read_multits(spark.read.parquet(str(tmp_path / "t")), START, "2023-08-29T12:58:02Z", "a,b")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(timestamp" in plan and "In(metric" in plan
    assert "extra" not in plan.split("ReadSchema:")[1]


def test_mapping_must_be_invertible():
    with pytest.raises(FrameError):
        series.check_mapping({"a": "x", "b": "x"})


def test_append_and_refuse(spark, frame, tmp_path):
    path = str(tmp_path / "t")
    for _ in range(2):
        series.append_multits(frame.withColumn("other", F.lit(1)), path, MAPPING)
    found = spark.read.parquet(path)
    assert set(found.columns) == {"datetime", "tsid", "measurement_val", "date"} and found.count() == 8
    with pytest.raises(FrameError):
        series.append_multits(frame, path, appendable=False)


def test_relative_range():
    now = dt.datetime(2024, 1, 2, tzinfo=dt.timezone.utc)
    assert series.relative_range(last="1d", now=now) == (dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc), now)
    with pytest.raises(FrameError):
        series.relative_range(START, None)


def test_unknown_columns_and_metrics(frame):
    with pytest.raises(FrameError):
        series.select_columns(frame, '["nope"]')
    with pytest.raises(FrameError):
        series.select_metrics(frame, ["a", "z"])
    assert series.between_thresholds(frame, 1.2, 2.2).count() == 2


def test_csv_settings(spark, frame, tmp_path):
    (tmp_path / "f.csv").write_text("index;First;Second\n2020-07-01T00:00:00Z;100.0;\n2020-07-01T01:00:00Z;NaN;140.0\n")
    found = files.read_semicolon(spark, str(tmp_path / "f.csv"), "index timestamp, First double, Second double").collect()
    assert [(r["First"], r["Second"]) for r in found] == [(100.0, None), (None, 140.0)]
    with pytest.raises(FrameError):
        files.csv_options({"engine": "c"})
    with pytest.raises(FrameError):
        files.read_csv(spark, "x.csv.zip")
    with pytest.raises(FrameError):
        files.write_generic(frame, str(tmp_path), "job", "x.xlsx")
    path = files.write_generic(frame, str(tmp_path), "job-7")
    assert path.endswith("_job-7.csv") and files.read_csv(spark, path).count() == 4


def test_jdbc_options():
    options = tables.jdbc_options("jdbc:x", "t", column="id", lower=0, upper=9, partitions=3)
    assert options["dbtable"] == "t" and options["numPartitions"] == "3"
    assert tables.jdbc_options("jdbc:x", query="SELECT 1")["query"] == "SELECT 1"
    split = tables.jdbc_options("jdbc:x", query="SELECT 1", column="id", lower=0, upper=9, partitions=3)
    assert split["dbtable"] == "(SELECT 1) q" and "query" not in split
    for bad in ({}, {"table": "t", "query": "q"}, {"table": "t", "column": "id"}):
        with pytest.raises(FrameError):
            tables.jdbc_options("jdbc:x", **bad)


def test_requests_cover_the_range_once():
    plan = rest.plan_requests([str(i) for i in range(25)], "2024-01-01T00:00:00Z", "2024-01-01T02:30:00Z", "1h")
    assert len(plan) == 2 * 3
    spans = sorted({(p.start, p.end) for p in plan})
    assert spans[0] == ("2024-01-01T00:00:00.000000Z", "2024-01-01T00:59:59.999999Z")
    assert spans[-1][1] == "2024-01-01T02:30:00.000000Z"


def test_endpoint_values(spark, tmp_path):
    folder = tmp_path / "timeseries" / "x"
    folder.mkdir(parents=True)
    lines = ['{"timeseriesId": "x", "timestamp": "2020-01-01T00:00:00.123456789Z", "value": 1}', '{"timeseriesId": "x", "timestamp": 1577840400000, "value": null}']
    (folder / "a.ndjson").write_text("\n".join(lines))
    found = rest.read_timeseries(spark, tmp_path.as_uri(), ["x", "missing"], "2019-12-31T00:00:00Z", "2020-02-01T00:00:00Z").orderBy("timestamp").collect()
    assert [(r["timestamp"].microsecond, r["value"]) for r in found] == [(123456, 1.0), (0, None)]
    grouped = rest.read_timeseries_grouped(spark, tmp_path.as_uri(), [{"id": "x", "type": "int"}], START, "2024-01-01T00:00:00Z")
    assert grouped["x"].count() == 0


def test_endpoint_checks(spark, frame, tmp_path):
    with pytest.raises(FrameError):
        rest.write_multitsframe(frame.withColumn("extra", F.lit(1)), tmp_path.as_uri(), "p")
    with pytest.raises(FrameError):
        rest.check_value_type(frame, "int")
    with pytest.raises(FrameError):
        rest.read_multitsframe(spark, tmp_path.as_uri(), "p", None, None)
    rest.write_multitsframe(frame, tmp_path.as_uri(), "p")
    body = "".join(f.read_text() for f in (tmp_path / "multitsframe" / "p").iterdir())
    assert '"timestamp":"2023-08-29T11:58:02.000000000Z"' in body


def test_series_documents_keep_duplicates_and_order(spark):
    rows = long_frame(spark, [("2020-01-01T00:00:01Z", 2.0), ("2020-01-01T00:00:00Z", 1.0), ("2020-01-01T00:00:01Z", None)])
    text = payload.encode_series(rows).first()["document"]
    data = json.loads(text)
    assert data["__hd_wrapped_data_object__"] == "SERIES" and data["__data_parsing_options__"] == {"orient": "split"}
    assert data["__data__"]["index"][0] == "2020-01-01T00:00:00.000000Z" and data["__data__"]["data"] == [1.0, None, 2.0]
    back = payload.decode_series(spark.createDataFrame([(text,)], "d string"), "d")
    assert sorted(back.select("timestamp", "value").collect(), key=str) == sorted(rows.select("timestamp", "value").collect(), key=str)
    assert [r["part"] for r in payload.encode_series(rows, part_rows=2).orderBy("part").collect()] == [0, 1]


FRAME_DOCUMENTS = [
    '{"x": {"2020-01-01T00:00:00Z": 1.0, "2020-01-01T01:00:00Z": 2.0}, "y": {"2020-01-01T00:00:00Z": null, "2020-01-01T01:00:00Z": 4.0}}',
    '{"x": {"2020-01-01T00:00:00Z": 1.0, "2020-01-01T01:00:00Z": 2.0}, "y": {"2020-01-01T01:00:00Z": 4.0}}',
    '{"__hd_wrapped_data_object__": "DATAFRAME", "__metadata__": {"u": 1}, "__data__": {"columns": ["y", "x"], "index": ["2020-01-01T00:00:00Z", "2020-01-01T01:00:00Z"], "data": [[null, 1.0], [4.0, 2.0]]}, "__data_parsing_options__": {"orient": "split"}}',
    '{"__hd_wrapped_data_object__": "DATAFRAME", "__metadata__": {}, "__data__": {"2020-01-01T00:00:00Z": {"x": 1.0}, "2020-01-01T01:00:00Z": {"y": 4.0, "x": 2.0}}, "__data_parsing_options__": {"orient": "index"}}',
]


@pytest.mark.parametrize("document", FRAME_DOCUMENTS)
def test_frame_documents(spark, document):
    schema = T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])
    rows = payload.decode_frame(spark.createDataFrame([(document,)], "d string"), "d", schema).orderBy("timestamp").collect()
    assert [(r["timestamp"].hour, r["x"], r["y"]) for r in rows] == [(0, 1.0, None), (1, 2.0, 4.0)]


def test_records_and_kinds(spark):
    text = '{"__hd_wrapped_data_object__": "DATAFRAME", "__metadata__": {"u": 1}, "__data__": [{"t": "2020-01-01T00:00:00Z", "x": "1"}], "__data_parsing_options__": {"orient": "records"}}'
    df = spark.createDataFrame([(text,)], "d string")
    schema = T.StructType([T.StructField("t", T.TimestampType()), T.StructField("x", T.DoubleType())])
    row = payload.decode_frame(df, "d", schema, time_index=False).first()
    assert (row["index"], row["x"]) == ("0", 1.0)
    assert df.select(payload.document_metadata(F.col("d")).alias("m")).first()["m"] == '{"u":1}'
    with pytest.raises(Exception, match="expected SERIES"):
        payload.decode_series(df, "d").collect()


def test_model_store(spark, tmp_path):
    rows = spark.createDataFrame([(float(i), 2.0 * i + 1) for i in range(5)], "x double, y double")
    model = fit_regression(rows, ["x"], "y")
    store.store_model(spark, model, str(tmp_path), "m", "v1")
    with pytest.raises(FrameError):
        store.store_model(spark, model, str(tmp_path), "m", "Latest")
    with pytest.raises(FrameError):
        store.load_model(spark, str(tmp_path), "m", "v2")
    scored = store.load_model(spark, str(tmp_path), "m").transform(rows).collect()
    assert [round(r["prediction"], 6) for r in scored] == [2.0 * i + 1 for i in range(5)]


def test_frame_store_never_overwrites(spark, frame, tmp_path):
    now = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
    store.store_frame(frame, str(tmp_path), "f", "j1", now)
    with pytest.raises(Exception, match="already exists"):
        store.store_frame(frame, str(tmp_path), "f", "j1", now)
    store.store_frame(frame.limit(1), str(tmp_path), "f", "j2", now + dt.timedelta(seconds=1))
    assert store.load_frame(spark, str(tmp_path), "f").count() == 1
    assert store.load_frame(spark, str(tmp_path), "f", job_id="j1").count() == 4


def test_long_series_are_refused_for_user_code(spark, frame, layout):
    big = frame.crossJoin(spark.range(40))
    if layout == "whole":
        assert per_series(big, lambda p: p, big.schema).count() == 160
    else:
        with pytest.raises(FrameError):
            per_series(big, lambda p: p, big.schema)


def test_user_code_takes_long_series_in_pieces(spark, layout):
    """Series beyond a block and a batch come in order, each to one call, and none is refused."""
    rows = spark.range(400).selectExpr("timestamp_seconds(1000 - id) as timestamp", "if(id % 5 = 0, null, if(id % 5 = 1, 'b', 'a')) as metric", "double(id) as value")

    def above_start(pieces):
        start = None
        for piece in pieces:
            start = piece["value"].iloc[0] if start is None else start
            yield piece.assign(value=piece["value"] - start)

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        found = per_series(rows.repartition(5), above_start, rows.schema, pieces=True)
        got = {(r["metric"], r["timestamp"]): r["value"] for r in found.collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    last = {"a": 399.0, "b": 396.0, None: 395.0}
    assert got == {(r["metric"], r["timestamp"]): r["value"] - last[r["metric"]] for r in rows.collect()}


def test_registered_source_has_a_name(spark):
    assert register_source(spark, rest.JsonSource) == rest.FORMAT


# Messages --------------------------------------------------------------------------------------------

SINGLE = '{"value": {"value": 4.5, "data_type": "metadata(float)", "output_name": "o"}, "job_id": "j", "message_creation_timestamp": "2024-01-01T00:00:00Z"}'
MULTI = '{"values": {"a": {"value": 1, "data_type": "metadata(int)"}, "b": {"value": "x", "data_type": "metadata(string)"}, "c": {"value": [1, 2]}}, "job_id": "j"}'


def test_value_keys():
    assert split_value_key("id:k:z") == ("id", "k:z") and split_value_key("k") == (None, "k") and split_value_key("") == (None, None)


def test_binding(spark):
    single = spark.createDataFrame([(SINGLE,)], "message string")
    row = bind_inputs(single, {"v": {"type": "float"}}).first()
    assert (row["v"], row["source_job_id"]) == (4.5, "j")
    multi = spark.createDataFrame([(MULTI,), (SINGLE,), ("junk",)], "message string")
    inputs = {"a": {"key": "a", "type": "int"}, "c": {"key": "c"}}
    good, bad = bind_inputs(multi, inputs, "quarantine")
    assert [(r["a"], r["c"]) for r in good.collect()] == [(1, "[1,2]")] and bad.count() == 2
    with pytest.raises(Exception, match="lacks an input"):
        bind_inputs(multi, inputs).collect()


def test_output_rules():
    out = {"column": "x", "type": "float", "name": "x"}
    with pytest.raises(FrameError):
        group_outputs([{**out, "key": "m:a"}, {**out, "key": "m:a"}])
    with pytest.raises(FrameError):
        group_outputs([out, {**out, "key": "a"}])
    assert len(group_outputs([{**out, "key": "m:a"}, {**out, "key": "m:b"}, {**out, "key": "n:a"}])) == 2
    with pytest.raises(FrameError):
        check_inputs({"a": {"key": "m:a"}, "b": {"key": "n:b"}})


def test_stream_stops_or_continues(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "m.txt").write_text(f"{MULTI}\njunk\n")
    inputs = {"a": {"key": "a", "type": "int"}}

    def start(name, **more):
        stream = open_stream(spark, "text", str(tmp_path / "in"))
        return consume(stream, inputs, lambda df: df, str(tmp_path / name), str(tmp_path / f"{name}-state"), "job", **more)

    with pytest.raises(Exception, match="lacks an input"):
        start("strict").awaitTermination(60)
    start("loose", continue_on_error=True, dead_letters=str(tmp_path / "dead")).awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "loose")).count() == 1
    assert [r["message"] for r in spark.read.parquet(str(tmp_path / "dead")).collect()] == ["junk"]


def test_built_message(spark, frame):
    built = build_messages(frame, [{"column": "value", "type": "float", "name": "load"}], "t", "j", stamp(START))
    found = json.loads(built.where("metric = 'b'").first()["message"])
    assert found["value"] == {"value": 1.3, "data_type": "metadata(float)", "output_name": "load"}
    assert (found["transformation_id"], found["message_creation_timestamp"]) == ("t", "2023-08-29T11:00:00.000000Z")


def test_one_dump_file_is_split_over_tasks(spark, tmp_path):
    """Ids with odd signs, bad records, values as text, and one large file in several tasks."""
    folder = tmp_path / "dataframe" / urllib.parse.quote("a/b c+d=é%", safe="")
    folder.mkdir(parents=True)
    lines = [json.dumps({"n": str(i), "x": i / 2, "flag": "Yes", "info": {"k": [i]}, "timestamp": 1000 * i}) for i in range(20_000)]
    (folder / "all.ndjson").write_text("\n".join([*lines, "", "  "]))
    (folder / "_hidden").write_text("not json")
    schema = "n bigint, x double, flag boolean, info string, timestamp timestamp"
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200000")
    rows = rest.read_frame(spark, tmp_path.as_uri(), "a/b c+d=é%", schema)
    assert rows.rdd.getNumPartitions() > 4
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert rows.count() == 20_000 and rows.agg(F.sum("n"), F.sum("x")).first()[:] == (199_990_000, 99_995_000.0)
    last = rows.orderBy(F.desc("n")).first()
    assert (last["flag"], last["info"], last["timestamp"].second) == (True, '{"k":[19999]}', 19_999 % 60)
    ids = spark.createDataFrame([("a/b c+d=é%",), ("none",)], "id string")
    assert rest.read_frame(spark, tmp_path.as_uri(), "other", schema).count() == 0
    assert rest._read(spark, tmp_path.as_uri(), "dataframe", ids, None, None, None, None, "float", schema).count() == 20_000
    with pytest.raises(FileNotFoundError):
        rest.read_metadata(spark, tmp_path.as_uri(), ["x"])
    (folder / "bad.ndjson").write_text('{"n": 1.5}\n{"n": "one"}')
    with pytest.raises(Exception, match="one|CAST"):
        rest.read_frame(spark, tmp_path.as_uri(), "a/b c+d=é%", "n bigint").collect()


def test_posts_carry_a_key_that_stays_the_same():
    writer = rest.JsonWriter({"url": "http://host/api/", "endpoint": "timeseries"})
    one, two = (writer.request("a b", ['{"v":1}', '{"v":2}'], f"{writer.job}-3-0") for _ in range(2))
    assert one.full_url == "http://host/api/timeseries?id=a+b" and one.data == b'[{"v":1},{"v":2}]' and one.method == "POST"
    assert one.headers["Idempotency-key"] == two.headers["Idempotency-key"] == f"{writer.job}-3-0"


def test_registered_file_formats(spark, tmp_path, monkeypatch):
    """Files of a user's format beside CSV files, each group with its own settings."""
    from tidewell.catalog.sources import _read_pairs, _write_pairs

    monkeypatch.setattr(files, "FILE_FORMATS", {})
    schema = "a int, b string"
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "one.csv").write_text("a,b\n1,x\n")
    (tmp_path / "in" / "two.pairs").write_text("a=2;b=y\nb=z")
    (tmp_path / "in" / "three.pairs").write_text("a=4|b=w")
    (tmp_path / "in" / "three.pairs.settings.json").write_text('{"load_settings": {"between": "[|]"}}')
    assert files.read_dataset(spark, str(tmp_path / "in"), schema).count() == 1
    files.register_file_format(".pairs", files.FileFormat(_read_pairs, _write_pairs))
    found = files.read_dataset(spark, str(tmp_path / "in"), schema)
    assert sorted(((r["a"], r["b"], r["file_path"].rsplit("/")[-1]) for r in found.collect()), key=str) == [
        (1, "x", "one.csv"), (2, "y", "two.pairs"), (4, "w", "three.pairs"), (None, "z", "two.pairs")
    ]
    path = files.write_generic(found.select("a", "b"), str(tmp_path), "job", "out.pairs")
    assert files.FILE_FORMATS["pairs"].read(spark, [path], schema, {}).count() == 4
    files.register_file_format("lines", files.FileFormat(read=_read_pairs))
    for bad in (lambda: files.register_file_format("csv", files.FileFormat()), lambda: files.write_generic(found, str(tmp_path), "j", "x.lines")):
        with pytest.raises(FrameError):
            bad()
