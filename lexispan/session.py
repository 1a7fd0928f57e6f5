"""Session factory with the settings the engine expects."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def session(master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution and UTC timestamps; ``master`` only for
    local runs, since a cluster's launcher sets it."""
    builder = SparkSession.builder.appName("lexispan")
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.ansi.enabled": "true",
        "spark.ui.enabled": "false",
        # whole texts travel to Python in batches of so many rows: bounds their memory
        "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    } | {k.replace("__", "."): v for k, v in conf.items()}
    for k, v in settings.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage of a result that several outputs read, in the shared folder that
    ``spark.checkpoint.dir`` names. Where it is unset, one machine takes a new folder; a
    cluster is refused, since its machines share none."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not spark.sparkContext.master.startswith("local"):
                raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            folder = tempfile.mkdtemp(prefix="lexispan-checkpoints-")
        spark.sparkContext.setCheckpointDir(folder)
    return df.checkpoint(eager=True)
