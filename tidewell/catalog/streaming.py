"""Message streams: the events travel as JSON messages through files and come back."""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.catalog.base import CTE_EVENTS, query, table
from tidewell.frames import Shape
from tidewell.functions.durations import from_micros
from tidewell.operators.health import alerts_from_score
from tidewell.session import scratch_dir
from tidewell.streaming.consume import consume, publish
from tidewell.streaming.messages import bind_inputs, build_messages, open_stream

SINGLE = [{"column": "value", "type": "float", "name": "load"}]
MULTI = [
    {"column": "metric", "type": "string", "name": "metric", "key": "m1:metric"},
    {"column": "at", "type": "int", "name": "at", "key": "m1:at"},
    {"column": "value", "type": "float", "name": "load", "key": "m1:load"},
]
INPUTS = {
    "metric": {"key": "m1:metric", "type": "string"},
    "at": {"key": "m1:at", "type": "int"},
    "value": {"key": "m1:load", "type": "float"},
}
SERIES = [
    {"column": "metric", "type": "string", "name": "metric", "key": "m1:metric"},
    {"column": "points", "type": "any", "name": "points", "key": "m1:points"},
]
SERIES_INPUTS = {"metric": {"key": "m1:metric", "type": "string"}, "points": {"key": "m1:points", "type": "any"}}


def _folder(spark) -> str:
    return f"{scratch_dir(spark)}/stream-{uuid.uuid4().hex}"


def _rows(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        "event_id", F.col("event_type").alias("metric"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), "value"
    )


def _wait(stream) -> None:
    """A plain wait for an available-now query; its own error comes up here."""
    while stream.isActive:
        time.sleep(0.05)
    if stream.exception() is not None:
        raise stream.exception()


def _mailbox(spark, rows: DataFrame, outputs: list[dict]) -> str:
    """Messages of the given rows as files of one message per line."""
    folder = _folder(spark)
    build_messages(rows, outputs, "trafo-1", "job-1").select("message").write.text(folder)
    return folder


@query("kafka_source_single_value", "SELECT value, 'job-1' AS source_job_id FROM events")
def _single(spark, sf_dir):
    folder, out = _mailbox(spark, _rows(spark, sf_dir).select("value"), SINGLE), _folder(spark)
    stream = open_stream(spark, "text", folder)
    _wait(consume(stream, {"value": {"type": "float"}}, lambda df: df, out, f"{out}-state", "job-2"))
    return spark.read.parquet(out).select("value", "source_job_id")


@query("kafka_source_multi_value", f"WITH {CTE_EVENTS} SELECT metric, timestamp, value FROM e")
def _multi(spark, sf_dir):
    folder, out = _mailbox(spark, _rows(spark, sf_dir), MULTI), _folder(spark)
    _wait(consume(open_stream(spark, "text", folder), INPUTS, lambda df: df, out, f"{out}-state", "job-2"))
    return spark.read.parquet(out).select("metric", from_micros(F.col("at")).alias("timestamp"), "value")


@query("kafka_sink", f"WITH {CTE_EVENTS} SELECT metric, timestamp, value FROM e")
def _sink(spark, sf_dir):
    folder, out = _mailbox(spark, _rows(spark, sf_dir), MULTI), _folder(spark)
    bound = bind_inputs(open_stream(spark, "text", folder), INPUTS)
    _wait(publish(build_messages(bound, MULTI, "trafo-2", "job-3"), "text", out, f"{out}-state"))
    back = bind_inputs(spark.read.text(out).withColumnRenamed("value", "message"), INPUTS)
    return back.select("metric", from_micros(F.col("at")).alias("timestamp"), "value")


@query(
    "consumption_mode",
    f"""WITH {CTE_EVENTS}, f AS (SELECT *, CASE WHEN value > 45 THEN 1 ELSE 0 END AS above FROM e)
    SELECT metric, timestamp, coalesce(above - lag(above) OVER
    (PARTITION BY metric, date_trunc('day', timestamp) ORDER BY timestamp), 0) AS alert, 'job-2' AS job_id FROM f""",
)
def _consume(spark, sf_dir):
    """A message holds one day of one metric; a file of messages at a time gives the same alerts."""
    day = F.floor(F.col("at") / 86_400_000_000)
    points = F.to_json(F.collect_list(F.struct("at", "value"))).alias("points")
    days = _rows(spark, sf_dir).groupBy("metric", day.alias("day")).agg(points)
    folder, out = _mailbox(spark, days.drop("day"), SERIES), _folder(spark)

    def pipeline(df: DataFrame) -> DataFrame:
        listed = F.explode(F.from_json("points", "array<struct<at:bigint,value:double>>"))
        rows = df.select("message_id", "metric", listed.alias("p")).select("message_id", "metric", "p.*")
        rows = rows.withColumn("timestamp", from_micros(F.col("at")))
        return alerts_from_score(rows, 45, Shape(keys=("message_id", "metric")))

    stream = open_stream(spark, "text", folder, maxFilesPerTrigger="1")
    _wait(consume(stream, SERIES_INPUTS, pipeline, out, f"{out}-state", "job-2"))
    return spark.read.parquet(out).select("metric", "timestamp", "alert", "job_id")


@query("delivery_after_restart", "SELECT count(*) AS messages, round(sum(value), 2) AS total FROM events", {"total": 1})
def _restart(spark, sf_dir):
    folder, out = _mailbox(spark, _rows(spark, sf_dir).select("value"), SINGLE), _folder(spark)
    for _ in range(2):
        stream = open_stream(spark, "text", folder)
        _wait(consume(stream, {"value": {"type": "float"}}, lambda df: df, out, f"{out}-state", "job-2"))
    return spark.read.parquet(out).agg(F.count("*").alias("messages"), F.sum("value").alias("total"))


@query(
    "at_most_once_delivery",
    "SELECT count(*) AS messages, round(sum(value), 2) AS total FROM events WHERE event_id % 2 = 1",
    {"total": 1},
)
def _at_most_once(spark, sf_dir):
    """The first batch fails once and is not run again; what comes after it is delivered."""
    rows = _rows(spark, sf_dir)
    folder, out = _mailbox(spark, rows.where("event_id % 2 = 0").select("value"), SINGLE), _folder(spark)
    failed = []

    def pipeline(df: DataFrame) -> DataFrame:
        if not failed:
            failed.append(True)
            raise RuntimeError("the pipeline fails on its first batch")
        return df

    for attempt in range(3):
        if attempt == 2:
            later = build_messages(rows.where("event_id % 2 = 1").select("value"), SINGLE, "trafo-1", "job-1")
            later.select("message").write.mode("append").text(folder)
        stream = open_stream(spark, "text", folder)
        query = consume(stream, {"value": {"type": "float"}}, pipeline, out, f"{out}-state", "job-2", delivery="at_most_once")
        if attempt == 0:
            while query.isActive:
                time.sleep(0.05)
        else:
            _wait(query)
    return spark.read.parquet(out).agg(F.count("*").alias("messages"), F.sum("value").alias("total"))


@query(
    "continue_after_bad_message",
    """SELECT 'good' AS kind, event_id % 10 <> 3 AS fits, count(*) AS messages FROM events WHERE event_id % 10 <> 3 GROUP BY ALL
    UNION ALL SELECT 'bad', false, count(*) FROM events WHERE event_id % 10 = 3""",
)
def _dead_letters(spark, sf_dir):
    rows = _rows(spark, sf_dir)
    good = build_messages(rows, MULTI, "trafo-1", "job-1")
    spoilt = F.when(F.col("event_id") % 10 == 3, F.substring("message", 1, 40)).otherwise(F.col("message"))
    folder, out = _folder(spark), _folder(spark)
    good.select(spoilt.alias("message")).write.text(folder)
    stream = open_stream(spark, "text", folder)
    _wait(consume(stream, INPUTS, lambda df: df, out, f"{out}-state", "job-2", True, f"{out}-bad"))
    kept, dead = spark.read.parquet(out), spark.read.parquet(f"{out}-bad")
    count = F.count("*").alias("messages")
    return (
        kept.agg(count).select(F.lit("good").alias("kind"), F.lit(True).alias("fits"), "messages")
        .unionByName(dead.agg(count).select(F.lit("bad").alias("kind"), F.lit(False).alias("fits"), "messages"))
    )


@query("job_tracing", "SELECT 'job-1' AS source_job_id, 'job-2' AS job_id, count(*) AS messages FROM events")
def _tracing(spark, sf_dir):
    folder, out = _mailbox(spark, _rows(spark, sf_dir), MULTI), _folder(spark)
    _wait(consume(open_stream(spark, "text", folder), INPUTS, lambda df: df, out, f"{out}-state", "job-2"))
    return spark.read.parquet(out).groupBy("source_job_id", "job_id").agg(F.count("*").alias("messages"))
