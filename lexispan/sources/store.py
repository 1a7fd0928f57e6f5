"""Several tables that change together: readers see a save whole or not at all.

Each save writes the tables it changes to new folders and then one small manifest that names
the folders of all tables; the manifest is what makes it visible, so a save that dies before
leaves nothing but folders that nobody reads. Saves name the version they started from. If
another one came first they are refused, and of two manifests for one version the first
written counts.
"""

from __future__ import annotations

import uuid
from typing import NamedTuple

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexispan.operators import dml
from lexispan.operators.catalog import Book

_MANIFEST = "version long, writer string, tables map<string,string>"


class ConcurrentSave(RuntimeError):
    """Another save came first; read again and repeat."""


class Version(NamedTuple):
    number: int
    writer: str | None
    tables: dict[str, str]  # folder of each table


def current(spark: SparkSession, root: str, number: int | None = None) -> Version:
    """The last version, or the one asked for; an empty store is version 0."""
    try:
        rows = spark.read.schema(_MANIFEST).json(f"{root}/_manifests")
        if number is not None:
            rows = rows.where(F.col("version") == number)
        first = rows.orderBy(F.desc("version"), F.col("_metadata.file_modification_time"), F.col("_metadata.file_name")).first()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        first = None
    if first is None:
        if number:
            raise LookupError(f"no version {number}")
        return Version(0, None, {})
    return Version(first["version"], first["writer"], first["tables"])


def read(spark: SparkSession, root: str, number: int | None = None) -> tuple[int, dict[str, DataFrame]]:
    """(version, tables), all of one version, whatever is saved meanwhile."""
    version = current(spark, root, number)
    return version.number, {name: spark.read.parquet(path) for name, path in version.tables.items()}


def save(spark: SparkSession, root: str, parent: int, tables: dict[str, DataFrame]) -> int:
    """Make ``tables`` the next version after ``parent``; other tables stay as they are."""
    now = current(spark, root)
    if now.number != parent:
        raise ConcurrentSave(f"version {now.number} has come after version {parent}")
    writer = uuid.uuid4().hex
    folders = {name: f"{root}/{name}/{writer}" for name in tables}
    for name, df in tables.items():
        df.write.parquet(folders[name])
    manifest = spark.createDataFrame([(parent + 1, writer, now.tables | folders)], _MANIFEST)
    manifest.coalesce(1).write.mode("append").json(f"{root}/_manifests")
    if current(spark, root, parent + 1).writer != writer:
        raise ConcurrentSave(f"another save of version {parent + 1} was first")
    return parent + 1


def load_book(spark: SparkSession, root: str) -> tuple[int, Book]:
    """(version, book) of a store that ``reload_book`` has filled."""
    number, tables = read(spark, root)
    return number, Book(**tables)


def reload_book(spark: SparkSession, root: str, records: DataFrame) -> int:
    """Replace a book's tables by extracted records, all at once; revisions stay, or begin
    empty."""
    number = current(spark, root)
    tables = {k: v for k, v in dml.load_records(records)._asdict().items() if v is not None}
    if "revisions" not in number.tables:
        key = records.schema["seq"].dataType.simpleString()
        tables["revisions"] = spark.createDataFrame([], f"id long, regulation_id {key}, revised_at string, summary string, created_at string")
        tables["revision_changes"] = spark.createDataFrame([], "revision_id long, article_no int, article_sub_no int, article_title string, old_body string, new_body string, ordinal int")
    return save(spark, root, number.number, tables)


def save_edits(spark: SparkSession, root: str, edits: DataFrame, regulation_id: int, revised_at: str, summary: str | None, created_at: str, chronological: bool = False) -> tuple[int, DataFrame]:
    """(version, changes): an editor's bodies (``id, body``) as one revision, visible whole
    or not at all. Without a changed body nothing is saved and the version stays."""
    number, book = load_book(spark, root)
    new, changes = dml.save_revision(book, regulation_id, revised_at, edits, summary, created_at, chronological)
    if changes.isEmpty():
        return number, changes
    changed = {k: getattr(new, k) for k in ("articles", "amendments", "revisions", "revision_changes")}
    done = save(spark, root, number, changed)
    saved = spark.read.parquet(current(spark, root, done).tables["revision_changes"])
    return done, saved.join(saved.agg(F.max("revision_id").alias("revision_id")), "revision_id", "left_semi")
