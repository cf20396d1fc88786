"""Running a batch pipeline on every micro-batch of a message stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidewell.frames import FrameError
from tidewell.streaming.messages import MESSAGE_ID, bind_inputs, split_value_key

Pipeline = Callable[[DataFrame], DataFrame]


def check_inputs(inputs: dict[str, dict]) -> None:
    """All inputs come from one topic, one config and one message id."""
    for part in ("topic", "config"):
        if len({spec.get(part) for spec in inputs.values()}) > 1:
            raise FrameError(f"all inputs must have the same {part}")
    if len({split_value_key(spec.get("key"))[0] for spec in inputs.values()}) > 1:
        raise FrameError("all inputs must have the same message id")


def consume(
    messages: DataFrame,
    inputs: dict[str, dict],
    pipeline: Pipeline,
    path: str,
    checkpoint: str,
    job_id: str,
    continue_on_error: bool = False,
    dead_letters: str | None = None,
    once: bool = True,
    delivery: str = "at_least_once",
) -> StreamingQuery:
    """Bind the inputs of every message, run the pipeline on the micro-batch, write its rows.

    A message is a run of its own, so how many of them a micro-batch holds must not matter: the pipeline
    gets them with a column ``message_id`` and uses it as a key of its series
    (``Shape(keys=("message_id", ...))``). Row-wise pipelines need nothing more.

    Progress is committed after a batch is written (at least once). The result folder is
    partitioned by ``job_id`` and ``batch``, and a repeated batch replaces its own partition, so the
    rows are there exactly once, and jobs with a folder in common leave each other's rows alone. Messages that do not fit go to ``dead_letters`` with
    ``continue_on_error``, and stop the query otherwise. Rows carry the job id of their message
    beside ``job_id`` and ``batch``.

    With ``delivery="at_most_once"`` a batch is claimed in a folder beside the checkpoint before it runs. A batch
    that was claimed and did not come to its end is left out after a restart, so nothing runs twice.
    """
    check_inputs(inputs)
    if delivery not in ("at_least_once", "at_most_once"):
        raise FrameError(f"delivery must be at_least_once or at_most_once, not {delivery!r}")
    if continue_on_error and dead_letters is None:
        raise FrameError("continue_on_error needs a folder for dead letters")

    def put(rows: DataFrame, target: str, batch: int) -> None:
        marked = rows.withColumns({"job_id": F.lit(job_id), "batch": F.lit(batch)})
        writer = marked.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        writer.partitionBy("job_id", "batch").parquet(target)

    def claimed(frame: DataFrame, batch: int) -> bool:
        """Claim the batch; False if an earlier run did."""
        claim = frame.sparkSession.range(1).select(F.lit(job_id).alias("job_id"), F.current_timestamp().alias("claimed"))
        try:
            claim.coalesce(1).write.mode("error").parquet(f"{checkpoint.rstrip('/')}-claims/{batch}")
        except AnalysisException as error:
            if error.getCondition() != "PATH_ALREADY_EXISTS":
                raise
            return False
        return True

    def run(frame: DataFrame, batch: int) -> None:
        if delivery == "at_most_once" and not claimed(frame, batch):
            return
        if MESSAGE_ID not in frame.columns:
            number = F.monotonically_increasing_id().cast("string")
            frame = frame.withColumn(MESSAGE_ID, F.concat(F.lit(f"{batch}/"), number))
        if not continue_on_error:
            put(pipeline(bind_inputs(frame, inputs)), path, batch)
            return
        # Both kinds come from the same messages, which are read once.
        held = frame.persist()
        try:
            good, bad = bind_inputs(held, inputs, "quarantine")
            put(bad, dead_letters, batch)
            put(pipeline(good), path, batch)
        finally:
            held.unpersist()

    writer = messages.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def publish(messages: DataFrame, sink: str, target: str, checkpoint: str, once: bool = True, **options: str) -> StreamingQuery:
    """Send a stream of built messages to ``kafka`` (``target`` is the topic) or to text files."""
    rows = messages.select(F.col("message").alias("value"))
    writer = rows.writeStream.format(sink).options(**options).option("checkpointLocation", checkpoint)
    if sink == "kafka":
        writer = writer.option("topic", target)
    else:
        writer = writer.option("path", target)
    return (writer.trigger(availableNow=True) if once else writer).start()
