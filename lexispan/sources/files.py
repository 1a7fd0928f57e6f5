"""Readers and writers of the engine's file formats.

All go through Spark's own sources, so any store that Spark reads will do.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lexispan import schemas
from lexispan.functions import text as T
from lexispan.session import checkpointed

_NAME = "_metadata.file_name"
_PATH = "_metadata.file_path"
ARRAY_ROWS = 100_000  # rows in one file of a JSON array


def read_json_array(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """Files that each hold one JSON array."""
    return spark.read.schema(schema).json(path, multiLine=True)


def write_json_array(df: DataFrame, path: str, order: list[str] | None = None) -> None:
    """One JSON array of all rows, one row a line, in the files of ``path`` by name: up to
    ARRAY_ROWS rows in one file, which is a JSON document then, more in several, which are
    one when put together. Each task writes its range of the order; only the first and the
    last row know that they carry a bracket."""
    rows = checkpointed(df)
    parts = max(1, -(-rows.count() // ARRAY_ROWS))
    rows = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order) if order else rows.repartition(parts)
    text = F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]), {"ignoreNullFields": "false"})
    # places ascend with the partitions; kept, so that they are the same when written
    rows = checkpointed(rows.select(text.alias("value"), F.monotonically_increasing_id().alias("_at")))
    first, last = rows.agg(F.min("_at"), F.max("_at")).first()
    if first is None:
        df.sparkSession.createDataFrame([("[]",)], "value string").coalesce(1).write.mode("overwrite").text(path)
        return
    begin, end = F.when(F.col("_at") == first, "[").otherwise(","), F.when(F.col("_at") == last, "]").otherwise("")
    rows.select(F.concat(begin, "value", end).alias("value")).write.mode("overwrite").text(path)


def read_written_array(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The rows that ``write_json_array`` wrote, however many files they fill."""
    text = spark.read.text(path).where("value <> '[]'")
    bare = F.regexp_replace(F.regexp_replace("value", r"^[\[,]", ""), r"\}\]$", "}")
    return text.select(F.from_json(bare, schema).alias("r")).select("r.*")


def read_snapshots(spark: SparkSession, path: str) -> DataFrame:
    """Dated snapshot files; names that begin with ``_`` are skipped."""
    df = spark.read.schema(schemas.SNAPSHOT).json(path, multiLine=True)
    return df.select("*", F.col(_NAME).alias("file_name")).where(~F.col("file_name").startswith("_"))


def read_records(spark: SparkSession, path: str) -> DataFrame:
    return read_json_array(spark, path, schemas.REGULATION_RECORD)


def read_seed(spark: SparkSession, path: str) -> DataFrame | None:
    """Seed entries; a missing file means there is nothing to load."""
    from pyspark.errors import AnalysisException

    try:
        return read_json_array(spark, path, schemas.SEED)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def read_committee(spark: SparkSession, path: str, skip_sessions: tuple[str, ...] = ()) -> DataFrame:
    """Map of maps -> ``session, title, title_raw, content, stage, file``."""
    text = spark.read.text(path, wholetext=True)
    sessions = text.select(F.explode(F.from_json("value", schemas.COMMITTEE)).alias("session", "records"))
    rows = sessions.select("session", F.explode("records").alias("title", "r")).select("session", "title", "r.*")
    return rows.where(~F.col("session").isin(*skip_sessions)) if skip_sessions else rows


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Text files whose pages are parted by form feeds: ``doc, page_idx, text``."""
    text = spark.read.text(path, wholetext=True).select(F.col(_PATH).alias("doc"), "value")
    return text.select("doc", F.posexplode(F.split("value", "\f")).alias("page_idx", "text"))


def read_plain_lines(spark: SparkSession, path: str) -> DataFrame:
    """``doc, line_no, line`` without page footers."""
    text = spark.read.text(path, wholetext=True).select(F.col(_PATH).alias("doc"), "value")
    rows = text.select("doc", F.posexplode(F.split("value", "\r?\n")).alias("line_no", "line"))
    return rows.where(~T.matches(T.strip(F.col("line")), T.PAGE_FOOTER))


def read_markdown_lines(spark: SparkSession, path: str) -> DataFrame:
    """``doc, line_no, line`` of converted documents: heading marks stripped, blank
    lines dropped, each HTML table kept whole as one wrapped line. Tables are parted
    from the text around them before anything is split at line ends. A document laid out
    in one frame of tables gives its cells' lines instead."""
    from lexispan.operators import markup

    text = spark.read.text(path, wholetext=True).select(F.col(_PATH).alias("doc"), "value")
    framed = markup.framed_lines(text, "doc", "value")
    text = text.where(~markup.is_framed(F.col("value")))
    table = r"(?is)<table\b.*?</table>"
    around = F.transform(F.split("value", table, -1), lambda s: F.transform(F.split(s, "\r?\n"), lambda x: T.strip(F.regexp_replace(x, r"^\s*#{1,6}\s*", ""))))
    wrap = lambda t: F.concat(F.lit('<div class="article-table-wrap">'), F.regexp_replace(t, "(?i)^<table", '<table class="inline-table"'), F.lit("</div>"))
    tables = F.transform(F.regexp_extract_all("value", F.lit(table), F.lit(0)), lambda t: F.array(wrap(t)))
    parts = F.flatten(F.zip_with(around, tables, lambda a, b: F.concat(a, F.coalesce(b, F.array().cast("array<string>")))))
    return text.select("doc", F.posexplode(F.filter(parts, lambda x: x != "")).alias("line_no", "line")).unionByName(framed)


def read_editions(spark: SparkSession, path: str, first: str, last: str, excluded: tuple[str, ...] = ()) -> DataFrame:
    """``path, edition``: one file for each edition date in a window (the first by
    path), parsed from file names; paths that hold an excluded part are skipped."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path")
    for part in excluded:
        files = files.where(~F.contains("path", F.lit(part)))
    files = files.withColumn("edition", T.file_date(F.element_at(F.split("path", "/"), -1)))
    return files.where(F.col("edition").between(first, last)).groupBy("edition").agg(F.min("path").alias("path"))


def file_url(seq: Column, ordinal: Column) -> Column:
    return F.concat(F.lit("/forms/reg"), seq.cast("string"), F.lit("_att"), ordinal.cast("string"), F.lit(".pdf"))


def write_report(df: DataFrame, path: str, section: str) -> None:
    """Tab-separated report, one folder for each section value."""
    df.write.mode("overwrite").partitionBy(section).option("sep", "\t").csv(path)


def write_table(df: DataFrame, path: str) -> None:
    """Full reload of a table."""
    df.write.mode("overwrite").parquet(path)


def read_archive(spark: SparkSession, path: str, sessions: str = "202", suffix: str = ".md") -> DataFrame:
    """Converted committee files below ``session/stage/file``: ``session, stage, rank,
    file, content``. Sessions begin with a year, folders of published output are left
    out, and files that stand in the session itself have the empty stage."""
    from lexispan.operators.reconcile import stage_rank

    text = spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True).select(F.col(_PATH).alias("p"), "value")
    root = path.rstrip("/").rsplit("/", 1)[-1]
    below = F.split(F.regexp_replace(F.url_decode(F.replace("p", F.lit("+"), F.lit("%2B"))), rf"^.*?/\Q{root}\E/", ""), "/")
    rows = text.select(F.get(below, F.lit(0)).alias("session"), F.when(F.size(below) > 2, F.get(below, F.lit(1))).otherwise("").alias("stage"), F.element_at(below, -1).alias("file"), F.col("value").alias("content"))
    rows = rows.where(F.col("session").startswith(sessions) & F.lower("file").endswith(suffix))
    rank = F.when(F.col("stage") == "", F.struct(F.lit(0).alias("major"), F.lit(0).alias("minor"))).otherwise(stage_rank(F.col("stage")))
    return rows.withColumn("rank", rank).where("rank IS NOT NULL")
