"""Versioned models and artefacts in a shared folder."""

from __future__ import annotations

import datetime as dt
import importlib

from pyspark.ml.util import MLWritable
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.frames import FrameError

LATEST = "latest"
KEY_COLUMNS = ("time", "job_id")


def _pointer(base: str, name: str) -> str:
    return f"{base.rstrip('/')}/{name}/_pointer"


def store_model(spark: SparkSession, model: MLWritable, base: str, name: str, tag: str) -> str:
    """Save a pyspark.ml model under name and tag and point ``latest`` to it."""
    if tag.lower() == LATEST:
        raise FrameError(f"{LATEST!r} is reserved and cannot be used as a tag")
    path = f"{base.rstrip('/')}/{name}/{tag}"
    model.write().save(path)
    kind = f"{type(model).__module__}:{type(model).__name__}"
    row = spark.createDataFrame([(tag, kind, dt.datetime.now(dt.timezone.utc))], "tag string, kind string, stored timestamp")
    row.coalesce(1).write.mode("append").parquet(_pointer(base, name))
    return path


def load_model(spark: SparkSession, base: str, name: str, tag: str = LATEST):
    """Load the model of a tag, or the one stored last."""
    entries = spark.read.parquet(_pointer(base, name))
    if tag.lower() != LATEST:
        entries = entries.where(F.col("tag") == tag)
    found = entries.agg(F.max_by(F.struct("tag", "kind"), "stored").alias("m")).first()["m"]
    if found is None:
        raise FrameError(f"no model {name} with tag {tag}")
    module, cls = found["kind"].split(":")
    return getattr(importlib.import_module(module), cls).load(f"{base.rstrip('/')}/{name}/{found['tag']}")


def store_frame(df: DataFrame, base: str, name: str, job_id: str, now: dt.datetime | None = None) -> str:
    """Write a frame under a new key of time and job; an existing key is never overwritten.

    Columns named like the parts of the key can't be told from it when read, and are refused.
    """
    taken = [c for c in df.columns if c.lower() in KEY_COLUMNS]
    if taken:
        raise FrameError(f"columns {taken} are reserved for the key of an artefact")
    moment = now or dt.datetime.now(dt.timezone.utc)
    path = f"{base.rstrip('/')}/{name}/time={moment:%Y-%m-%dT%H-%M-%S.%f}/job_id={job_id}"
    df.write.mode("errorifexists").parquet(path)
    return path


def load_frame(spark: SparkSession, base: str, name: str, time: str | None = None, job_id: str | None = None) -> DataFrame:
    """Read the artefact of a key, or the latest one.

    Keys are found by the names of files, without opening any; then the files of one artefact are read, so that
    artefacts of a name may differ in their columns.
    """
    root = f"{base.rstrip('/')}/{name}"
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    pattern = r"/time=([^/]+)/job_id=([^/]+)/[^/]+$"
    keys = listed.select(*[F.regexp_extract("path", pattern, i + 1).alias(c) for i, c in enumerate(KEY_COLUMNS)]).where("time <> ''")
    for column, wanted in zip(KEY_COLUMNS, (time, job_id), strict=True):
        if wanted is not None:
            keys = keys.where(F.col(column) == wanted)
    newest = keys.agg(F.max(F.struct(*KEY_COLUMNS)).alias("k")).first()["k"]
    if newest is None:
        raise FrameError(f"no artefact {name} with time {time} and job {job_id}" if time or job_id else f"no artefact {name}")
    return spark.read.parquet(f"{root}/time={newest['time']}/job_id={newest['job_id']}")
