"""Small helpers shared by the corpus operators."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space that separates words: space and U+0009 to U+000D.
SPACE_CLASS = r"\x20\x09-\x0D"
WORD = rf"[^{SPACE_CLASS}]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_checkpoints(spark: SparkSession) -> None:
    """Make ``checkpoint()`` usable: the cluster's ``spark.checkpoint.dir`` wins. Where it
    is unset, one machine (``local[...]``) takes a new folder of its own; a cluster has no
    folder that all its machines see, so there it is an error."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="lexispan-checkpoints-")
    sc.setCheckpointDir(folder)


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage in the shared checkpoint folder; survives lost executors."""
    shared_checkpoints(df.sparkSession)
    return df.checkpoint(eager=True)


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Inside, a query's shuffle files go when the query is over, not when the driver happens
    to collect its garbage: for loops that checkpoint and then need none of them."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def text_volume(df: DataFrame, text_col: str = "text") -> tuple[int, int]:
    """(rows, UTF-8 bytes of text): what partition counts are derived from."""
    row = df.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length(F.col(text_col))).alias("b")).first()
    return int(row["n"]), int(row["b"] or 0)


def cells_for(amount: int, per_cell: int, least: int = 1) -> int:
    """How many cells keep each at about ``per_cell``; grows with the input."""
    return max(least, -(-int(amount) // int(per_cell)))
