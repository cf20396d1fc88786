"""Session defaults and the shared scratch folder."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"


def get_session(app: str = "tidewell", master: str | None = None, **conf: str) -> SparkSession:
    """Session with the settings every operator relies on: UTC and adaptive execution."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.ui.enabled": "false",
        **conf,
    }
    for key, val in settings.items():
        builder = builder.config(key, val)
    return builder.getOrCreate()


def scratch_dir(spark: SparkSession) -> str:
    """Folder shared by all executors, as named in ``spark.checkpoint.dir``.

    A local session without the setting gets a temporary folder; a cluster session
    without it is refused, because executors could not see a machine-local path.
    """
    named = spark.conf.get(CHECKPOINT_CONF, None) or spark.sparkContext.getConf().get(CHECKPOINT_CONF)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"set {CHECKPOINT_CONF} to a folder all executors can reach")
    folder = tempfile.mkdtemp(prefix="tidewell-")
    spark.conf.set(CHECKPOINT_CONF, folder)
    return folder
