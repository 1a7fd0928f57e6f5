"""Nested markup as intervals: tags become rows with their place and table depth, and rows,
cells and layout frames follow from windows over those rows. Texts are cut only where a
cell's place is known; no text is scanned in Python.
"""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from lexispan.functions import text as T

TAG = r"(?i)<(/?)(tr|td|th|table)\b[^>]*>"
#: A page whose whole content is the inner table of a table with one cell.
FRAME = r"(?i)^\s*<table>\s*<tr>\s*<th>\s*<table>\s*"
FRAME_END = r"(?i)\s*</table>\s*</th>\s*</tr>\s*</table>\s*$"


def tags(texts: DataFrame, key: str, text: str) -> DataFrame:
    """``key, n, name, closing, start, stop, depth``: the table tags of each text in order,
    the 0-based characters they span, and how many tables are open before them.

    Tags and the pieces between them alternate, so places are running sums of lengths.
    """
    found = F.regexp_extract_all(F.col(text), F.lit(TAG), F.lit(0))
    between = F.slice(F.split(F.col(text), TAG, -1), F.lit(1), F.size(found))
    pairs = F.zip_with(found, between, lambda t, b: F.struct(t.alias("tag"), F.length(b).alias("gap")))
    rows = texts.where(F.col(text).isNotNull()).select(key, F.posexplode(pairs).alias("n", "p")).select(key, "n", "p.*")
    name, closing = F.lower(F.regexp_extract("tag", TAG, 2)), F.regexp_extract("tag", TAG, 1) != ""
    rows = rows.select(key, "n", name.alias("name"), closing.alias("closing"), "gap", F.length("tag").alias("size"))
    run = Window.partitionBy(key).orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(key).orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    step = F.when(F.col("name") == "table", F.when(F.col("closing"), -1).otherwise(1)).otherwise(0)
    rows = rows.withColumn("stop", F.sum(F.col("gap") + F.col("size")).over(run)).withColumn("depth", F.coalesce(F.sum(step).over(before), F.lit(0)))
    return rows.select(key, "n", "name", "closing", (F.col("stop") - F.col("size")).alias("start"), "stop", "depth")


def spans(rows: DataFrame, keys: list[str], names: list[str], depth: Column | int) -> DataFrame:
    """``keys``, ``first`` and ``last`` (numbers of the tags), ``start, stop`` (what stands
    between them), ``depth``: elements of these names outside deeper tables. An end tag
    closes the start tag just before it; start tags that nothing closes open nothing."""
    rows = rows.where(F.col("name").isin(names) & (F.col("depth") <= depth))
    by = Window.partitionBy(*keys).orderBy("n")
    rows = rows.withColumn("_o", F.lag(F.struct("closing", "n", "stop", "depth")).over(by)).where(F.col("closing") & ~F.col("_o.closing"))
    return rows.select(*keys, F.col("_o.n").alias("first"), F.col("n").alias("last"), F.col("_o.stop").alias("from"), F.col("start").alias("to"), F.col("_o.depth").alias("depth"))


def grid(texts: DataFrame, key: str, text: str, depth: int = 1) -> DataFrame:
    """``key, row, cells``: rows (from 0) and cells of the tables at most ``depth`` deep;
    what a cell holds, further tables included, stays as it is. Keys are distinct."""
    rows = tags(texts, key, text)
    lines = spans(rows, [key], ["tr"], depth).withColumn("row", F.row_number().over(Window.partitionBy(key).orderBy("first")) - 1)
    # rows don't overlap, so the row of a cell's tag is the last one that began before it
    begun = lines.select(key, F.col("first").alias("n"), F.struct("row", "last", "depth").alias("_line"))
    merged = rows.where("name IN ('td', 'th')").join(begun, [key, "n"], "full_outer")
    last = F.last("_line", ignorenulls=True).over(Window.partitionBy(key).orderBy("n").rowsBetween(Window.unboundedPreceding, 0))
    inside = merged.withColumn("_line", last).where("name IS NOT NULL AND n < _line.last").withColumn("row", F.col("_line.row"))
    cells = spans(inside, [key, "row"], ["td", "th"], F.col("_line.depth"))
    held = cells.join(texts.select(key, F.col(text).alias("_text")), key)
    held = held.select(key, "row", "first", F.expr("substring(_text, `from` + 1, `to` - `from`)").alias("cell"))
    made = held.groupBy(key, "row").agg(F.transform(F.array_sort(F.collect_list(F.struct("first", "cell"))), lambda x: x["cell"]).alias("cells"))
    return lines.select(key, "row").join(made, [key, "row"], "left").withColumn("cells", F.coalesce("cells", F.array().cast("array<string>")))


@F.pandas_udf(StringType())
def unescaped(text: pd.Series) -> pd.Series:
    """Character references of HTML as characters."""
    return text.map(html.unescape, na_action="ignore")


def is_framed(text: Column) -> Column:
    return F.coalesce(text.rlike(FRAME), F.lit(False))


def framed_lines(texts: DataFrame, key: str, text: str) -> DataFrame:
    """``key, line_no, line`` of texts that one frame holds (:func:`is_framed`; others give
    nothing): the cells of the inner table's rows, line by line, without any tags."""
    held = texts.where(is_framed(F.col(text))).select(key, F.regexp_replace(F.regexp_replace(T.strip(F.col(text)), FRAME, ""), FRAME_END, "").alias("_inner"))
    rows = grid(held, key, "_inner", depth=0).select(key, "row", F.posexplode("cells").alias("at", "cell"))
    bare = F.regexp_replace(F.regexp_replace("cell", "<br/?>", "\n"), "<[^>]+>", " ")
    lines = rows.select(key, "row", "at", F.posexplode(F.split(bare, "\n")).alias("k", "line"))
    line = F.when(F.contains("line", F.lit("&")), unescaped("line")).otherwise(F.col("line"))
    lines = lines.withColumn("line", T.strip(line)).where("line <> ''")
    return lines.select(key, (F.row_number().over(Window.partitionBy(key).orderBy("row", "at", "k")) - 1).alias("line_no"), "line")
