"""Shingle overlap, best-table matching and the trigram index."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexispan.functions import text as T

BROADCAST_ROWS = 500_000  # shingles of attachments that may be broadcast


def shingles(c: Column, n: int = 3) -> Column:
    """Distinct n-character shingles; none for shorter texts. One pass of overlapping
    look-ahead matches (never from inside a surrogate pair): linear in the text."""
    pattern = rf"(?s)(?![\x{{DC00}}-\x{{DFFF}}])(?=(.{{{n}}}))"
    return F.array_distinct(F.regexp_extract_all(c, F.lit(pattern), F.lit(1)))


def containment(needles: Column, text: Column) -> Column:
    """Share of the shingles that a text holds; 0 without shingles."""
    hits = F.size(F.filter(needles, lambda s: F.contains(text, s)))
    return F.when(F.size(needles) > 0, hits / F.size(needles)).otherwise(F.lit(0.0))


def table_text(rows: Column) -> Column:
    """All cells of a table as one text without white space."""
    return T.without_ws(F.array_join(F.flatten(rows), " "))


def best_match(attachments: DataFrame, tables: DataFrame, threshold: float = 0.5, n: int = 3) -> DataFrame:
    """For each attachment (``doc, attachment, start_page, end_page, text``) the table
    (``doc, page, tbl, text``) of its pages with the largest overlap; ties go to the
    first page and table. Below the threshold (above 0) the match is null; so it is
    without shingles or pages.

    Every pair that shares a shingle gets its exact score. Where the attachments' shingles
    are few enough to be sent, they are an index (shingle -> attachments), each table counts
    its shared shingles for itself, and only pairs above the threshold leave it. Otherwise
    they are counted by an equi-join on the shingle. Rows that repeat a key are scored on
    their own.
    """
    if not 0 < threshold <= 1:
        raise ValueError("the threshold lies above 0 and at most at 1")
    needles = attachments.select("doc", "attachment", "start_page", "end_page", shingles(T.without_ws(F.col("text")), n).alias("needles"))
    wanted = int(needles.agg(F.coalesce(F.sum(F.size("needles")), F.lit(0))).first()[0])
    score = _indexed_scores if wanted <= BROADCAST_ROWS else _joined_scores
    scored = score(needles, tables, threshold, n)
    best = scored.groupBy("doc", "attachment").agg(F.min_by(F.struct("page", "tbl", "score"), F.struct(-F.col("score"), "page", "tbl")).alias("b"))
    return attachments.select("doc", "attachment").join(best, ["doc", "attachment"], "left").select("doc", "attachment", "b.page", "b.tbl", "b.score")


def _joined_scores(needles: DataFrame, tables: DataFrame, threshold: float, n: int) -> DataFrame:
    """``doc, attachment, page, tbl, score`` of pairs above the threshold, by joins."""
    needles = needles.withColumn("a_row", F.monotonically_increasing_id())
    wanted = needles.select("doc", "attachment", "start_page", "end_page", "a_row", F.size("needles").alias("size"), F.explode("needles").alias("gram"))
    held = tables.select("doc", "page", "tbl", shingles(T.without_ws(F.col("text")), n).alias("grams"), F.monotonically_increasing_id().alias("t_row"))
    held = held.select("doc", "page", "tbl", "t_row", F.explode("grams").alias("gram"))
    shared = held.join(wanted, ["doc", "gram"]).where(F.col("page").between(F.col("start_page"), F.col("end_page")))
    hits = shared.groupBy("doc", "attachment", "a_row", "size", "page", "tbl", "t_row").agg(F.count(F.lit(1)).alias("hits"))
    return hits.select("doc", "attachment", "page", "tbl", (F.col("hits") / F.col("size")).alias("score")).where(F.col("score") >= threshold)


def _indexed_scores(needles: DataFrame, tables: DataFrame, threshold: float, n: int) -> DataFrame:
    """The same with the attachments' shingles, at most BROADCAST_ROWS, in every task."""
    asked = needles.where(F.size("needles") > 0).toArrow()
    shared = needles.sparkSession.sparkContext.broadcast(asked)
    kinds = {c: f.dataType.simpleString() for f in [*needles.schema, *tables.schema] for c in [f.name]}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = shared.value
        grams = asked["needles"].to_pylist()
        size = np.array([len(g) for g in grams], np.int64)
        index: dict[object, dict[str, list[int]]] = {}
        for k, (doc, own) in enumerate(zip(asked["doc"].to_pylist(), grams, strict=True)):
            of = index.setdefault(doc, {})
            for g in own:
                of.setdefault(g, []).append(k)
        postings = {doc: {g: np.array(ks) for g, ks in of.items()} for doc, of in index.items() if doc is not None}
        low, high = (asked[c].to_pylist() for c in ("start_page", "end_page"))
        for b in batches:
            table, which, score = [], [], []
            for k, (doc, page, text) in enumerate(zip(*(b.column(c).to_pylist() for c in ("doc", "page", "text")), strict=True)):
                of = postings.get(doc)
                if not of or page is None:
                    continue
                met = [of[g] for g in {text[i : i + n] for i in range(len(text) - n + 1)} if g in of]
                if not met:
                    continue
                share = np.bincount(np.concatenate(met), minlength=len(size)) / size
                for a in np.flatnonzero(share >= threshold).tolist():
                    if low[a] is not None and high[a] is not None and low[a] <= page <= high[a]:
                        table.append(k)
                        which.append(a)
                        score.append(float(share[a]))
            at = pa.array(table, pa.int64())
            found = asked["attachment"].combine_chunks().take(pa.array(which, pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column("doc").take(at), found, b.column("page").take(at), b.column("tbl").take(at), pa.array(score, pa.float64())], ["doc", "attachment", "page", "tbl", "score"])

    schema = ", ".join(f"{c} {kinds[c]}" for c in ("doc", "attachment", "page", "tbl")) + ", score double"
    return tables.select("doc", "page", "tbl", T.without_ws(F.col("text")).alias("text")).mapInArrow(run, schema)


def best_match_anywhere(attachments: DataFrame, tables: DataFrame, threshold: float = 0.5, n: int = 3) -> DataFrame:
    """For each attachment (``attachment, text``) the table (``tbl, text``) with the
    largest overlap among all tables: ``best_match`` with all of them on one page."""
    one = F.lit(0)
    out = best_match(
        attachments.select(one.alias("doc"), "attachment", one.alias("start_page"), one.alias("end_page"), "text"),
        tables.select(one.alias("doc"), one.alias("page"), "tbl", "text"), threshold, n)
    return out.select("attachment", "tbl", "score")


def trigram_index(df: DataFrame, key: str, text_col: str = "text", n: int = 3) -> DataFrame:
    """Inverted index: ``gram, key``, one row for each document that holds the gram."""
    return df.select(F.explode(shingles(F.col(text_col), n)).alias("gram"), key)


def trigram_frequencies(df: DataFrame, text_col: str = "text", n: int = 3) -> DataFrame:
    """In how many documents each gram occurs (partial counts before the shuffle)."""
    return df.select(F.explode(shingles(F.col(text_col), n)).alias("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias("n_docs"))


def owner_of_page(pages: DataFrame, records: DataFrame) -> DataFrame:
    """First record (least ``seq``) whose page list holds a page; null if unclaimed."""
    claims = records.select("seq", F.explode("pdf_pages").alias("page")).groupBy("page").agg(F.min("seq").alias("seq"))
    return pages.join(claims, "page", "left")
