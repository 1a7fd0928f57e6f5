"""Word boxes of a page: rows, tables and reading order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def word_rows(words: DataFrame, tolerance: float = 3.0) -> DataFrame:
    """Rows of words (``doc, page, x0, y0, word``): a row takes words whose y lies
    within the tolerance of its first word's; adds the row's text in x order. A fold over
    a page's sorted heights finds where rows begin; words are then ranked by those."""
    start = F.struct(F.lit(None).cast("double").alias("anchor"), F.array().cast("array<double>").alias("rows"))

    def step(acc, y):
        new = acc["anchor"].isNull() | (F.abs(y - acc["anchor"]) > tolerance)
        return F.when(new, F.struct(y.alias("anchor"), F.concat(acc["rows"], F.array(y)).alias("rows"))).otherwise(acc)

    heights = words.groupBy("doc", "page").agg(F.array_sort(F.collect_set("y0")).alias("ys"))
    begun = heights.select("doc", "page", F.explode(F.aggregate("ys", start, step, lambda acc: acc["rows"])).alias("y0"))
    rows = words.select("doc", "page", "y0", "x0", "word", F.lit(1).alias("_is")).unionByName(begun.withColumn("_is", F.lit(0)), allowMissingColumns=True)
    by = Window.partitionBy("doc", "page").orderBy("y0", "_is").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("row", (F.sum(1 - F.col("_is")).over(by) - 1).cast("int")).where("_is = 1")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x0", "y0", "word"))), lambda x: x["word"]), " ")
    return rows.groupBy("doc", "page", "row").agg(text.alias("text"), F.min("y0").alias("y0"))


def words_in_tables(words: DataFrame, tables: DataFrame, pad: float = 2.0) -> DataFrame:
    """Words with the first table of their page whose padded box holds their centre
    (null outside all tables); the page is the join key, the box its condition."""
    box = tables.select(F.col("doc").alias("_d"), F.col("page").alias("_p"), "tbl", *[F.col(c).alias(f"_{c}") for c in ("x0", "y0", "x1", "y1")])
    cx, cy = (F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2
    inside = cx.between(F.col("_x0") - pad, F.col("_x1") + pad) & cy.between(F.col("_y0") - pad, F.col("_y1") + pad)
    hits = words.join(box, (F.col("doc") == F.col("_d")) & (F.col("page") == F.col("_p")) & inside, "left")
    keys = words.columns
    return hits.groupBy(*keys).agg(F.min("tbl").alias("tbl"))


def prose_with_markers(words: DataFrame, markers: DataFrame, anchors: DataFrame | None = None) -> DataFrame:
    """Lines of a page outside its tables, with each table's marker text put in at the
    median reading position of its words, or after the last line that holds the
    table's anchor text. ``words``: output of :func:`words_in_tables` with ``block,
    line``; ``markers``: ``doc, page, tbl, marker``."""
    line = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x0", "word"))), lambda x: x["word"]), " ")
    lines = words.where("tbl IS NULL").groupBy("doc", "page", "block", "line").agg(line.alias("text"))
    lines = lines.select("doc", "page", F.struct("block", "line").alias("key"), F.lit(1).alias("side"), F.lit(-1).alias("tbl"), "text")
    keys = F.array_sort(F.collect_list(F.struct("block", "line")))
    spots = words.where("tbl IS NOT NULL").groupBy("doc", "page", "tbl").agg(F.element_at(keys, (F.floor(F.count(F.lit(1)) / 2) + 1).cast("int")).alias("key"))
    spots = spots.withColumn("side", F.lit(0))
    if anchors is not None:
        held = lines.select("doc", "page", F.col("key").alias("_k"), F.col("text").alias("_t")).join(anchors, ["doc", "page"])
        held = held.where(F.contains("_t", "anchor")).groupBy("doc", "page", F.col("tbl").alias("_tbl")).agg(F.max("_k").alias("_k"))
        spots = spots.join(held.withColumnRenamed("_tbl", "tbl"), ["doc", "page", "tbl"], "left")
        spots = spots.withColumn("side", F.when(F.col("_k").isNotNull(), 2).otherwise(0)).withColumn("key", F.coalesce("_k", "key")).drop("_k")
    placed = spots.join(markers, ["doc", "page", "tbl"]).select("doc", "page", "key", "side", "tbl", F.col("marker").alias("text"))
    return lines.unionByName(placed)
