"""Pages whose tables are drawn as grids: text with the tables' markup in place, and the two
extraction flows that start from it.

Inputs: ``pages`` (doc, page, text; pages count from 1), ``words`` (doc, page, x0, y0, x1,
y1, word, block, line) and ``tables`` (doc, page, tbl, x0, y0, x1, y1, rows) as a layout
reader finds them. Every step leaves one plain ``line_no`` in each document, so steps that
insert, move or join lines can follow each other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexispan.functions import text as T
from lexispan.operators import layout, records, segment, similar
from lexispan.session import checkpointed

# Headings of standalone statutes, letter-spaced over several lines.
CHAPTER_ALONE, CHAPTER_TITLED, SECTION_ALONE = r"^제\s*(\d+)\s*장\s*$", r"^제\s*(\d+)\s*장\s+(.+)$", r"^제\s*(\d+)\s*절\s*$"
STRUCTURAL = "|".join((T.ARTICLE, CHAPTER_ALONE, CHAPTER_TITLED, SECTION_ALONE))


def page_lines(pages: DataFrame, words: DataFrame, markers: DataFrame, anchors: DataFrame | None = None) -> DataFrame:
    """``doc, page, line_no, line`` of all pages in reading order.

    A page with tables is rebuilt from its words: those inside a table give way to the
    table's markup (``markers``: tables with ``marker``), at their median place or after
    the last line that holds the table's anchor text (``anchors``: doc, page, tbl, anchor).
    Other pages give their text line by line. Of markups at one place the later table's
    comes first.
    """
    tabled = markers.select("doc", "page").distinct()
    placed = layout.words_in_tables(words.join(tabled, ["doc", "page"], "left_semi"), markers)
    rebuilt = layout.prose_with_markers(placed, markers.select("doc", "page", "tbl", "marker"), anchors)
    rebuilt = rebuilt.select("doc", "page", "key.block", "key.line", "side", (-F.col("tbl")).alias("tbl"), F.col("text").alias("_line"))
    plain = pages.join(tabled, ["doc", "page"], "left_anti").select("doc", "page", F.posexplode(F.split("text", "\n")).alias("line", "_line"))
    plain = plain.select("doc", "page", F.lit(0).alias("block"), "line", F.lit(1).alias("side"), F.lit(0).alias("tbl"), "_line")
    rows = segment.renumbered(rebuilt.unionByName(plain), ["page", "block", "line", "side", "tbl"])
    return rows.select("doc", "page", "line_no", F.col("_line").alias("line"))


def continued_markers(pages: DataFrame, markers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pages, markers) where a document's last page only continues its last table: a page
    without tables whose text is no sentence goes into the first cell of the last table's
    last row."""
    of = pages.groupBy("doc").agg(F.max("page").alias("page"))
    last = pages.join(of, ["doc", "page"]).join(markers.select("doc", "page").distinct(), ["doc", "page"], "left_anti")
    text = T.strip(F.col("text"))
    last = last.where((text != "") & ~text.endswith("다.")).join(markers.select("doc").distinct(), "doc", "left_semi")
    tail = markers.groupBy("doc").agg(F.max(F.struct("page", "tbl")).alias("t")).join(last.select("doc", text.alias("_more")), "doc")
    tail = tail.select("doc", "t.page", "t.tbl", "_more")
    grown = markers.join(tail, ["doc", "page", "tbl"], "left")
    grown = grown.withColumn("marker", F.when(F.col("_more").isNotNull(), T.append_to_last_row(F.col("marker"), F.col("_more"))).otherwise(F.col("marker"))).drop("_more")
    return pages.join(last.select("doc", "page"), ["doc", "page"], "left_anti"), grown


def whole_headings(lines: DataFrame) -> DataFrame:
    """Headings whose titles are spread over following lines, and the addenda marker on two
    lines, as one line each; a titled chapter in its plain spelling."""
    order = ["line_no"]
    for alone, word in ((CHAPTER_ALONE, "장"), (SECTION_ALONE, "절")):
        lines = segment.merge_headers(lines, order, alone, STRUCTURAL, word)
    lines = segment.join_split_word(lines, order)
    s = T.strip(F.col("line"))
    titled = F.concat(F.lit("제"), F.regexp_extract(s, T.unicode_re(CHAPTER_TITLED), 1), F.lit("장 "), F.regexp_extract(s, T.unicode_re(CHAPTER_TITLED), 2))
    return lines.withColumn("line", F.when(T.matches(s, CHAPTER_TITLED), titled).otherwise(F.col("line")))


def extract_statutes(pages: DataFrame, words: DataFrame, tables: DataFrame, titles: DataFrame, moving: Column | None = None, anchor: Column | None = None) -> DataFrame:
    """Standalone statutes -> ``doc, seq, toc_title`` of ``titles``, the record's columns and
    ``pdf_pages, table_pages``.

    Tables are real if they have two rows and columns, or one row with a digit. Lines that
    ``moving`` marks go to the end of the segment that the first ``anchor`` line opens.
    Date lines are taken out before headings are put together. Whatever looks like an
    attachment is not kept.
    """
    real = tables.where(T.real_table(F.col("rows"), digit_row=True)).withColumn("marker", T.table_html(F.col("rows")))
    shown, markers = continued_markers(pages, real)
    lines = page_lines(shown, words, markers)
    if moving is not None:
        s = T.strip(F.col("line"))
        moved = segment.relocate(lines, "line_no", moving, anchor, T.matches(s, STRUCTURAL))
        lines = segment.renumbered(moved.drop("line_no"), ["place"]).drop("place")
    dated = T.matches(T.strip(F.col("line")), records.STATUTES.date_line)
    lines = checkpointed(lines.select("doc", "line_no", "line"))  # read twice
    lines = whole_headings(lines.where(~dated)).unionByName(lines.where(dated))
    docs = titles.select("doc", F.lit(records.STATUTES.dialect).alias("dialect"), F.lit(None).cast("string").alias("title_hint"))
    found = records.parse_records(lines, docs).drop("attachments")
    seen = pages.groupBy("doc").agg(F.array_sort(F.collect_list("page")).alias("pdf_pages"))
    tabled = real.groupBy("doc").agg(F.array_sort(F.collect_set("page")).alias("table_pages"))
    return titles.select("doc", "seq", "toc_title").join(found, "doc").join(seen, "doc", "left").join(tabled, "doc", "left")


def patch_book(pages: DataFrame, words: DataFrame, tables: DataFrame, toc: DataFrame, toc_order: list[str], anchors: DataFrame | None = None, **book: object) -> tuple[DataFrame, DataFrame]:
    """(records, owners): a book extracted again with the tables of its pages as markup, and
    for each page with a table the first regulation that has the page (``seq`` null: none).

    ``tables`` may have ``source_url``, the link to the page; ``book`` goes on to
    ``records.extract_book``.
    """
    url = F.col("source_url") if "source_url" in tables.columns else None
    markers = tables.where(T.real_table(F.col("rows"))).withColumn("marker", T.table_html(F.col("rows"), source_url=url))
    lines = page_lines(pages, words, markers, anchors)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n")
    patched = lines.groupBy("doc", "page").agg(text.alias("text")).select("doc", (F.col("page") - 1).alias("page_idx"), "text")
    found = records.extract_book(patched, toc, toc_order, **book)
    key = lambda c: F.struct("doc", c)
    claims = found.select("seq", F.transform("pdf_pages", lambda p: F.struct(F.col("doc"), p.alias("page"))).alias("pdf_pages"))
    owners = similar.owner_of_page(markers.select("doc", "page").distinct().select(key("page").alias("page")), claims)
    return found, owners
