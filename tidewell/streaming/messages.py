"""The message envelope: typed values travelling in JSON documents."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamReader

from tidewell.frames import FrameError

MESSAGE_ID = "message_id"
VALUE = "struct<value:string,data_type:string,output_name:string>"

# Field names and types of the envelope. Values are kept as JSON text.
ENVELOPE = (
    f"transformation_id string, job_id string, message_creation_timestamp string, value {VALUE}, values map<string,{VALUE}>"
)
VALUE_TYPES = {"int": "bigint", "float": "double", "string": "string", "boolean": "boolean", "any": "string"}


def open_stream(spark: SparkSession, source: str, path_or_topic: str, **options: str) -> DataFrame:
    """Message stream with a string column ``message``, and of Kafka its place as ``message_id``.

    ``source`` is ``kafka`` (with its options, such as ``kafka.bootstrap.servers``) or ``text``
    for a folder of files with one message per line.
    """
    reader: DataStreamReader = spark.readStream.format(source).options(**options)
    if source == "kafka":
        place = F.concat_ws("/", "topic", "partition", "offset").alias(MESSAGE_ID)
        return reader.option("subscribe", path_or_topic).load().select(F.col("value").cast("string").alias("message"), place)
    return reader.load(path_or_topic).select(F.col("value").alias("message"))


def split_value_key(text: str | None) -> tuple[str | None, str | None]:
    """Message id and value key of ``id:key``, split at the first colon; a plain key has no id."""
    if not text:
        return None, None
    ref, colon, key = text.partition(":")
    return (ref, key) if colon else (None, text)


def parse_messages(messages: DataFrame, column: str = "message") -> DataFrame:
    """Envelope fields beside the message; ``envelope`` is NULL for text that is not an envelope."""
    parsed = F.from_json(F.col(column), ENVELOPE, {"mode": "PERMISSIVE"})
    usable = parsed["value"].isNotNull() | parsed["values"].isNotNull()
    return messages.withColumn("envelope", F.when(usable, parsed)).withColumns(
        {
            "source_job_id": F.col("envelope.job_id"),
            "sent": F.try_to_timestamp(F.col("envelope.message_creation_timestamp")),
        }
    )


def single_value(kind: str) -> Column:
    """The one value of a single-value message, typed."""
    return F.col("envelope.value.value").try_cast(VALUE_TYPES[kind])


def value_of(key: str, kind: str) -> Column:
    """The value of one key of a multi-value message, typed; NULL if the key is missing."""
    return F.try_element_at(F.col("envelope.values"), F.lit(key))["value"].try_cast(VALUE_TYPES[kind])


def _has(key: str | None) -> Column:
    if key is None:
        return F.col("envelope.value").isNotNull()
    return F.coalesce(F.array_contains(F.map_keys("envelope.values"), key), F.lit(False))


def bind_inputs(messages: DataFrame, inputs: dict[str, dict], on_missing: str = "fail") -> DataFrame | tuple[DataFrame, DataFrame]:
    """One column per input of a pipeline, all taken from the same message.

    ``inputs`` maps an input name to ``{"key": ..., "type": ...}``; no key means the single
    value. Surplus keys are ignored. A message that lacks a key, or holds no envelope, fails the
    job or is returned apart (``on_missing="quarantine"``).
    """
    parsed = parse_messages(messages)
    keys = {name: split_value_key(spec.get("key"))[1] for name, spec in inputs.items()}
    if any(k is None for k in keys.values()) and len(set(keys.values())) > 1:
        raise FrameError("inputs of one message use either its single value or keys, not both")
    complete = F.col("envelope").isNotNull()
    for key in keys.values():
        complete = complete & _has(key)
    complete = F.coalesce(complete, F.lit(False))
    columns = {}
    for name, spec in inputs.items():
        kind = spec.get("type", "any")
        columns[name] = single_value(kind) if keys[name] is None else value_of(keys[name], kind)

    def bound(df: DataFrame) -> DataFrame:
        return df.withColumns(columns).select(*messages.columns, "source_job_id", "sent", *columns)

    if on_missing == "quarantine":
        return bound(parsed.where(complete)), parsed.where(~complete).select(*messages.columns)
    if on_missing != "fail":
        raise FrameError(f"unknown on_missing {on_missing!r}")
    message = F.concat(F.lit("message lacks an input: "), F.col(messages.columns[0]).cast("string"))
    return bound(parsed.where(F.when(complete, True).otherwise(F.raise_error(message).cast("boolean"))))


def _value_struct(column: str, kind: str, output: str) -> Column:
    return F.struct(
        F.col(column).alias("value"), F.lit(f"metadata({kind})").alias("data_type"), F.lit(output).alias("output_name")
    )


def check_outputs(outputs: list[dict]) -> None:
    """Outputs of one message have distinct keys, or there is one output without a key."""
    keys = [split_value_key(o.get("key"))[1] for o in outputs]
    if None in keys and len(keys) > 1:
        raise FrameError("a single-value output cannot share its message with other outputs")
    if len(set(keys)) != len(keys):
        raise FrameError(f"duplicate message keys {keys}")


def group_outputs(outputs: list[dict]) -> dict[tuple[str, str | None], list[dict]]:
    """Outputs by config and message id: each group travels in one message."""
    groups: dict[tuple[str, str | None], list[dict]] = {}
    for output in outputs:
        ref = split_value_key(output.get("key"))[0]
        groups.setdefault((output.get("config", "default"), ref), []).append(output)
    for group in groups.values():
        check_outputs(group)
    return groups


def build_messages(
    df: DataFrame, outputs: list[dict], transformation_id: str, job_id: str, now: dt.datetime | None = None
) -> DataFrame:
    """One JSON message per row with the outputs of one message; other columns are kept.

    ``outputs`` are ``{"column": ..., "type": ..., "name": ..., "key": ...}``.
    """
    check_outputs(outputs)
    stamp = F.lit(now) if now else F.current_timestamp()
    head = [
        F.lit(transformation_id).alias("transformation_id"),
        F.lit(job_id).alias("job_id"),
        F.date_format(stamp, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("message_creation_timestamp"),
    ]
    cells = [(split_value_key(o.get("key"))[1], _value_struct(o["column"], o["type"], o["name"])) for o in outputs]
    if cells[0][0] is None:
        body = cells[0][1].alias("value")
    else:
        body = F.struct(*[cell.alias(key) for key, cell in cells]).alias("values")
    document = F.to_json(F.struct(*head, body), {"ignoreNullFields": "false"})
    kept = [c for c in df.columns if c not in {"message", *(o["column"] for o in outputs)}]
    return df.select(*kept, document.alias("message"))
