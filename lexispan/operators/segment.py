"""Segmentation of page text into documents, articles, addenda and attachments.

The state machines of a sequential parser become running sums and ignore-null last
values over one total order for each document; nothing orders globally.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexispan.functions import text as T


class Markers(NamedTuple):
    """Regular expressions of structural lines (searched in the stripped line)."""

    chapter: str = T.CHAPTER
    section: str = T.SECTION
    subsection: str = T.SUBSECTION
    article: str = T.ARTICLE
    addenda: str = T.ADDENDA
    attachment: str = T.ATTACHMENT
    date_line: str = T.DATE_LINE
    #: how a heading is written out: pattern groups 1 and 2 around these words
    words: tuple[str, str, str] = ("장", "절", "관")
    enacted: str = "제정"
    addenda_name: str = "부칙"


def _running(keys: list[str], order: list[str]) -> Window:
    return Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)


def _before(keys: list[str], order: list[str]) -> Window:
    return Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)


def ordered_join(value: Column, order: list[str], sep: str = " ") -> Column:
    """Aggregate: values joined in order."""
    rows = F.array_sort(F.collect_list(F.struct(*order, value.alias("_v"))))
    return F.array_join(F.transform(rows, lambda x: x["_v"]), sep)


def lines(pages: DataFrame, text_col: str = "text") -> DataFrame:
    """``doc, page_idx, text`` -> one row a line: ``doc, page_idx, line_no, line``."""
    return pages.select("doc", "page_idx", F.posexplode(F.split(F.col(text_col), "\n")).alias("line_no", "line"))


def first_line(text: Column) -> Column:
    """The first line that isn't blank, stripped; empty for blank pages."""
    return F.coalesce(F.try_element_at(F.filter(F.transform(F.split(text, "\n"), T.strip), lambda x: x != ""), F.lit(1)), F.lit(""))


def islands(pages: DataFrame, header: str = T.RUNNING_HEADER, divider: str = T.DIVIDER, force_new: list[int] | None = None, force_continue: list[int] | None = None) -> DataFrame:
    """Group consecutive pages into documents by their running header's number.

    A page continues its document if its header repeats the number or shows a smaller
    one other than 1, or has no number; blank and divider pages are dropped, as are
    pages before the first header. Adds ``island`` (from 1), ``index_no`` and
    ``header`` of the island. Pages listed in ``force_new`` / ``force_continue`` open
    a document, or stay in the open one, whatever their header says.
    """
    order = ["page_idx"]
    head = first_line(F.col("text"))
    rows = pages.withColumn("header", head).where((F.col("header") != "") & ~T.matches(F.col("header"), divider))
    number = T.group(F.col("header"), header, 1).cast("long")
    forced = F.col("page_idx").isin(force_continue or [])
    opened = F.max(number.isNotNull().cast("int")).over(_before(["doc"], order))
    rows = rows.withColumn("y", F.when(forced & (F.coalesce(opened, F.lit(0)) == 1), None).otherwise(number))
    rows = rows.withColumn("py", F.last("y", ignorenulls=True).over(_before(["doc"], order)))
    y, py = F.col("y"), F.col("py")
    restart = y.isNotNull() & (py.isNull() | F.col("page_idx").isin(force_new or []) | ((y == 1) & (py != 1)))
    rows = rows.withColumn("restart", F.coalesce(restart, F.lit(False)))
    rows = rows.withColumn("seg", F.sum(F.col("restart").cast("int")).over(_running(["doc"], order)))
    rows = rows.withColumn("m", F.max("y").over(_before(["doc", "seg"], order)))
    new = y.isNotNull() & (F.col("restart") | F.coalesce(y > F.col("m"), F.lit(False)))
    rows = rows.withColumn("new", new).withColumn("island", F.sum(F.col("new").cast("int")).over(_running(["doc"], order)))
    rows = rows.where("island > 0")
    by = Window.partitionBy("doc", "island").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = rows.withColumn("index_no", F.first("y").over(by)).withColumn("header", T.normalize_ws(F.first("header").over(by)))
    return rows.drop("y", "py", "restart", "seg", "m", "new")


def header_islands(pages: DataFrame, header: str = T.RUNNING_HEADER, divider: str = T.DIVIDER) -> DataFrame:
    """The simpler grouping: neighbouring pages with exactly the same header text are
    one document; a blank or divider page closes it."""
    order = ["page_idx"]
    head = first_line(F.col("text"))
    rows = pages.withColumn("header", head)
    closed = (F.col("header") == "") | T.matches(F.col("header"), divider)
    rows = rows.withColumn("closed", closed)
    key = F.when(~F.col("closed") & T.matches(F.col("header"), header), T.normalize_ws(F.col("header")))
    rows = rows.withColumn("part", F.sum(F.col("closed").cast("int")).over(_running(["doc"], order))).where("NOT closed")
    rows = rows.withColumn("key", F.last(key, ignorenulls=True).over(_running(["doc", "part"], order))).where("key IS NOT NULL")
    before = F.lag("key").over(Window.partitionBy("doc", "part").orderBy(*order))
    rows = rows.withColumn("new", ~F.coalesce(before == F.col("key"), F.lit(False)))
    rows = rows.withColumn("island", F.sum(F.col("new").cast("int")).over(_running(["doc"], ["part", *order])))
    return rows.drop("closed", "part", "new").withColumnRenamed("key", "index_key")


def content_lines(page_lines: DataFrame, footer: str = T.PAGE_FOOTER) -> DataFrame:
    """Lines after each page's running header (its first line that isn't blank),
    without page footers."""
    text = T.strip(F.col("line"))
    seen = F.sum((text != "").cast("int")).over(_running(["doc", "page_idx"], ["line_no"]))
    rows = page_lines.withColumn("_seen", seen)
    rows = rows.where((F.col("_seen") > 1) | ((F.col("_seen") == 1) & (text == "")))
    return rows.where(~T.matches(text, footer)).drop("_seen")


def front_matter(rows: DataFrame, order: list[str], markers: Markers = Markers(), include_enacted: bool = True) -> DataFrame:
    """``doc, title, enact_date, amend_dates``: what stands before the first
    structural line. Date lines give dates (split at commas, white space removed);
    other lines form the title. The enactment date is the last date of the first line
    that says so; it is among the amendment dates, unless that is switched off."""
    text = T.strip(F.col("line"))
    start = T.matches(text, markers.chapter) | T.matches(text, markers.article) | T.matches(text, markers.addenda)
    rows = rows.withColumn("_s", text)
    rows = rows.withColumn("_body", F.max(start.cast("int")).over(_running(["doc"], order)))
    front = rows.where((F.col("_body") == 0) & (F.col("_s") != ""))
    kind = T.group(F.col("_s"), markers.date_line, 1)
    dates = F.transform(F.split(F.regexp_extract(F.col("_s"), T.unicode_re(markers.date_line), 2), ","), lambda d: F.regexp_replace(F.regexp_replace(d, r"(?U)\s+", ""), r"^\.+|\.+$", ""))
    front = front.withColumn("_kind", kind).withColumn("_dates", F.when(F.col("_kind").isNotNull(), F.filter(dates, lambda d: d != "")))
    parts = F.array_sort(F.collect_list(F.struct(*order, "_kind", "_dates", F.col("_s").alias("_v"))))
    out = front.groupBy("doc").agg(parts.alias("p"))
    titled = F.filter("p", lambda x: x["_kind"].isNull())
    dated = F.filter("p", lambda x: x["_kind"].isNotNull())
    enacted = F.try_element_at(F.filter(dated, lambda x: x["_kind"] == markers.enacted), F.lit(1))
    kept = dated if include_enacted else F.filter(dated, lambda x: x["_kind"] != markers.enacted)
    return out.select(
        "doc",
        T.normalize_ws(F.array_join(F.transform(titled, lambda x: x["_v"]), " ")).alias("title"),
        F.try_element_at(enacted["_dates"], F.lit(-1)).alias("enact_date"),
        F.flatten(F.transform(kept, lambda x: x["_dates"])).alias("amend_dates"),
    )


def structure(rows: DataFrame, order: list[str], markers: Markers = Markers()) -> DataFrame:
    """Classify the non-blank lines of a document's body and carry headings forward.

    Adds ``s`` (stripped line), ``kind`` (C chapter, S section, G subsection, A
    article, B addenda marker, T text), ``in_addenda``, the headings in force
    (``chapter``, ``section``, ``gwan``: a chapter resets the two below, a section the
    one below) and ``seg``, the running number of the line's segment.
    """
    rows = rows.withColumn("s", T.strip(F.col("line"))).where("s <> ''")
    s = F.col("s")
    is_addenda = T.matches(s, markers.addenda)
    rows = rows.withColumn("in_addenda", F.max(is_addenda.cast("int")).over(_running(["doc"], order)) == 1)
    kind = F.when(is_addenda, "B").when(F.col("in_addenda"), "T")
    for name, pattern in (("C", markers.chapter), ("S", markers.section), ("G", markers.subsection), ("A", markers.article)):
        kind = kind.when(T.matches(s, pattern), name)
    rows = rows.withColumn("kind", kind.otherwise("T"))

    def heading(code: str, pattern: str, word: str) -> Column:
        g = lambda n: F.regexp_extract(s, T.unicode_re(pattern), n)
        full = F.concat(F.lit("제"), g(1), F.lit(word + " "), g(2)) if word else s
        return F.when(F.col("kind") == code, T.normalize_ws(full))

    number = lambda code, keys: F.sum((F.col("kind") == code).cast("int")).over(_running(keys, order))
    rows = rows.withColumn("_c", number("C", ["doc"]))
    rows = rows.withColumn("_s", number("S", ["doc", "_c"]))
    carry = lambda c, keys: F.last(c, ignorenulls=True).over(_running(keys, order))
    a, b, c = markers.words
    rows = rows.withColumn("chapter", carry(heading("C", markers.chapter, a), ["doc"]))
    rows = rows.withColumn("section", carry(heading("S", markers.section, b), ["doc", "_c"]))
    rows = rows.withColumn("gwan", carry(heading("G", markers.subsection, c), ["doc", "_c", "_s"]))
    return rows.withColumn("seg", F.sum((F.col("kind") != "T").cast("int")).over(_running(["doc"], order))).drop("_c", "_s")


def articles(structured: DataFrame, order: list[str], markers: Markers = Markers()) -> DataFrame:
    """One row an article, in order: headings, number, sub-number, title and body.

    A segment is an article if its first line is one; lines after a heading and
    before the next article belong to none.
    """
    rows = structured.where("NOT in_addenda")
    first = F.min_by(F.struct("kind", "s", "chapter", "section", "gwan"), F.struct(*order)).alias("h")
    segs = rows.groupBy("doc", "seg").agg(first, T.normalize_ws(ordered_join(F.col("s"), order)).alias("body"))
    segs = segs.where("h.kind = 'A'")
    head = F.col("h.s")
    got = lambda n: T.group(head, markers.article, n)
    has_title = F.regexp_extract(head, T.unicode_re(markers.article), 0).endswith(")")
    return segs.select(
        "doc",
        (F.row_number().over(Window.partitionBy("doc").orderBy("seg")) - 1).alias("ordinal"),
        "h.chapter",
        "h.section",
        "h.gwan",
        got(1).cast("int").alias("no"),
        got(2).cast("int").alias("sub_no"),
        F.when(has_title, F.regexp_extract(head, T.unicode_re(markers.article), 3)).alias("title"),
        "body",
    )


def addenda_lines(structured: DataFrame, order: list[str], markers: Markers = Markers(), keep_separators: bool = True) -> DataFrame:
    """Lines from the first addenda marker on, with ``attachment`` numbers (0: plain
    addenda). The first marker is left out; repeats stay as separators or go."""
    rows = structured.where("in_addenda")
    rows = rows.withColumn("_n", F.sum((F.col("kind") == "B").cast("int")).over(_running(["doc"], order)))
    rows = rows.where((F.col("kind") != "B") | ((F.col("_n") > 1) & F.lit(keep_separators)))
    rows = rows.withColumn("s", F.when(F.col("kind") == "B", F.lit(markers.addenda_name)).otherwise(F.col("s"))).drop("_n")
    mark = T.matches(F.col("s"), markers.attachment)
    return rows.withColumn("is_label", mark).withColumn("attachment", F.sum(mark.cast("int")).over(_running(["doc"], order)))


def addenda(lines_: DataFrame, order: list[str]) -> DataFrame:
    rows = lines_.where("attachment = 0")
    return rows.select("doc", F.col("s").alias("line"), (F.row_number().over(Window.partitionBy("doc").orderBy(*order)) - 1).alias("ordinal"))


def attachments(lines_: DataFrame, order: list[str]) -> DataFrame:
    """One row an attachment: label, lines and the 1-based pages its lines span (null
    without lines)."""
    rows = lines_.where("attachment > 0")
    label = F.min_by("s", F.struct(*order)).alias("label")
    body = F.filter(F.array_sort(F.collect_list(F.struct(*order, "is_label", "s"))), lambda x: ~x["is_label"])
    page = F.when(~F.col("is_label"), F.col("page_idx"))
    out = rows.groupBy("doc", "attachment").agg(label, F.transform(body, lambda x: x["s"]).alias("lines"), (F.min(page) + 1).alias("start_page"), (F.max(page) + 1).alias("end_page"))
    return out.select("doc", (F.col("attachment") - 1).alias("ordinal"), "label", "lines", "start_page", "end_page")


def merge_units(rows: DataFrame, order: list[str], start: str, separator: str = "부칙") -> DataFrame:
    """Rejoin wrapped addenda lines: a unit begins at a line that looks like one, or
    right after a separator or a table."""
    rows = rows.withColumn("s", T.strip(F.col("line"))).where("s <> ''")
    ends = F.contains(F.col("s"), F.lit("<table")) | (F.col("s") == separator)
    after = F.coalesce(F.lag(ends).over(Window.partitionBy("doc").orderBy(*order)), F.lit(False))
    rows = rows.withColumn("_new", T.matches(F.col("s"), start) | after)
    rows = rows.withColumn("unit", F.sum(F.col("_new").cast("int")).over(_running(["doc"], order)))
    return rows.groupBy("doc", "unit").agg(ordered_join(F.col("s"), order).alias("line"))


def merge_headers(rows: DataFrame, order: list[str], start: str, structural: str, word: str) -> DataFrame:
    """Join a heading whose title is spread over the lines below it, up to the next
    structural or blank line."""
    s = T.strip(F.col("line"))
    rows = rows.withColumn("s", s).withColumn("_head", T.matches(s, start))
    stop = F.col("_head") | T.matches(F.col("s"), structural) | (F.col("s") == "")
    rows = rows.withColumn("_part", F.sum(stop.cast("int")).over(_running(["doc"], order)))
    by = Window.partitionBy("doc", "_part").orderBy(*order)
    rows = rows.withColumn("_headed", F.first("_head").over(by)).withColumn("_n", F.row_number().over(by))
    rows = rows.withColumn("_key", F.when(F.col("_headed"), 0).otherwise(F.col("_n")))
    first = F.min(F.struct(*order)).alias("_at")
    lines = F.array_sort(F.collect_list(F.struct(*order, "s")))
    joined = F.array_join(F.transform(F.slice(lines, F.lit(2), F.size(lines)), lambda x: x["s"]), "")
    head = F.min_by("s", F.struct(*order))
    title = F.concat(F.lit("제"), F.regexp_extract(head, T.unicode_re(start), 1), F.lit(word + " "), joined)
    out = rows.groupBy("doc", "_part", "_key").agg(first, F.when(F.first("_headed"), title).otherwise(head).alias("line"))
    return out.select("doc", "_at.*", "line")


def merge_ahead(rows: DataFrame, order: list[str], fragment: str, whole: list[str], reach: int = 3) -> DataFrame:
    """Join a heading that is torn over a line and the next one to ``reach`` lines: as soon
    as a ``fragment`` line and those after it, put together, make one of the ``whole``
    patterns, they become one line. Lines are consumed from the top, so a line that an
    earlier heading took begins none. Result: ``doc``, the order columns, stripped ``line``.

    Of a fragment only its own span is looked at; spans that overlap form chains, and only
    within a chain, which is short, does one choice depend on the one before.
    """
    by = Window.partitionBy("doc").orderBy(*order)
    rows = rows.select("doc", *order, T.strip(F.col("line")).alias("line")).withColumn("_n", F.row_number().over(by))
    joined = [F.col("line")]
    for k in range(1, reach + 1):
        joined.append(F.concat(joined[-1], F.lead("line", k).over(by)))
    span, text = F.lit(None).cast("int"), F.lit(None).cast("string")
    for k in range(reach, 0, -1):
        found = F.lit(False)
        for pattern in whole:
            found = found | T.matches(joined[k], pattern)
        span, text = F.when(found, k).otherwise(span), F.when(found, joined[k]).otherwise(text)
    is_fragment = T.matches(F.col("line"), fragment)
    rows = rows.withColumn("_end", F.when(is_fragment, F.col("_n") + span)).withColumn("_text", text)
    open_ = rows.where("_end IS NOT NULL").select("doc", "_n", "_end")
    order_n = Window.partitionBy("doc").orderBy("_n")
    reached = F.max("_end").over(order_n.rowsBetween(Window.unboundedPreceding, -1))
    open_ = open_.withColumn("_fresh", F.coalesce(F.col("_n") > reached, F.lit(True)).cast("int"))
    open_ = open_.withColumn("_chain", F.sum("_fresh").over(order_n.rowsBetween(Window.unboundedPreceding, 0)))
    chains = open_.groupBy("doc", "_chain").agg(F.array_sort(F.collect_list(F.struct("_n", "_end"))).alias("c"))
    start = F.struct(F.lit(0).alias("end"), F.array().cast("array<int>").alias("taken"))
    free = lambda acc, x: F.when(x["_n"] > acc["end"], F.struct(x["_end"].alias("end"), F.concat(acc["taken"], F.array(x["_n"])).alias("taken"))).otherwise(acc)
    taken = chains.select("doc", F.explode(F.aggregate("c", start, free, lambda acc: acc["taken"])).alias("_n")).withColumn("_takes", F.lit(True))
    rows = rows.join(taken, ["doc", "_n"], "left")
    covered = F.max(F.when(F.col("_takes"), F.col("_end"))).over(order_n.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("_covered", covered).where("_n > coalesce(_covered, 0)")
    return rows.select("doc", *order, F.when(F.col("_takes"), F.col("_text")).otherwise(F.col("line")).alias("line"))


def repaired_lines(rows: DataFrame, order: list[str], name: str = "line_no") -> DataFrame:
    """Converted lines as their sources had them (:func:`text.whole_lines`): ``doc``, the
    line's number from 1 in its document, ``line``."""
    parts = rows.select("doc", *order, F.posexplode(T.whole_lines(F.col("line"))).alias("_part", "line"))
    return parts.select("doc", F.row_number().over(Window.partitionBy("doc").orderBy(*order, "_part")).alias(name), "line")


def join_split_word(rows: DataFrame, order: list[str], first: str = "부", second: str = "칙") -> DataFrame:
    """A word that stands on two lines becomes one line at the first one's place."""
    by = Window.partitionBy("doc").orderBy(*order)
    s = T.strip(F.col("line"))
    rows = rows.withColumn("_begins", (s == first) & F.coalesce(T.strip(F.lead("line").over(by)) == second, F.lit(False)))
    rows = rows.withColumn("_ends", F.coalesce(F.lag("_begins").over(by), F.lit(False))).where("NOT _ends")
    return rows.withColumn("line", F.when(F.col("_begins"), F.lit(first + second)).otherwise(F.col("line"))).drop("_begins", "_ends")


def renumbered(rows: DataFrame, keys: list[Column | str], name: str = "line_no") -> DataFrame:
    """Lines of each document numbered from 1 by ``keys``, so that steps which insert, move
    or join lines can follow each other on one plain order column."""
    return rows.withColumn("_at", F.row_number().over(Window.partitionBy("doc").orderBy(*keys))).drop(name).withColumnRenamed("_at", name)


def blocks(rows: DataFrame, order: list[str], header: str, skip: str | None = None) -> DataFrame:
    """Split at header lines: ``doc, block, title, content``; what precedes the first
    header goes, and so do lines that match ``skip``."""
    s = T.strip(F.col("line"))
    rows = rows.withColumn("_t", T.group(s, header, 1))
    if skip:
        rows = rows.where(F.col("_t").isNotNull() | ~T.matches(F.regexp_replace(s, r"(?U)^#{1,6}\s*", ""), skip))
    rows = rows.withColumn("block", F.sum(F.col("_t").isNotNull().cast("int")).over(_running(["doc"], order))).where("block > 0")
    body = F.filter(F.array_sort(F.collect_list(F.struct(*order, "_t", "line"))), lambda x: x["_t"].isNull())
    out = rows.groupBy("doc", "block").agg(T.strip(F.max("_t")).alias("title"), T.strip(F.array_join(F.transform(body, lambda x: x["line"]), "\n")).alias("content"))
    return out


def toc(rows: DataFrame, order: list[str], top: str = r"^([ⅠⅡⅢⅣ])\.\s*(.*)$", second: str = r"^([A-D])\.\s*(.*)$", entry: str = r"^(\d+)\.\s*(.*)$") -> DataFrame:
    """Entries of a table of contents with the two categories carried down; entries
    without a page number at the end are no entries."""
    s = T.strip(F.col("line"))
    tidy = lambda c: T.normalize_ws(F.replace(c, F.lit("·"), F.lit("")))
    paged = r"^(.*?)\s*(\d+)$"
    is_top = T.matches(s, top)
    is_second = ~is_top & T.matches(s, second)
    rest1 = tidy(F.regexp_extract(s, T.unicode_re(second), 2))
    rows = rows.withColumn("_top", F.when(is_top, T.normalize_ws(F.regexp_extract(s, T.unicode_re(top), 2))))
    rows = rows.withColumn("_second", F.when(is_second, T.strip(F.when(rest1.rlike(paged), F.regexp_extract(rest1, paged, 1)).otherwise(rest1))))
    rows = rows.withColumn("_group", F.sum(is_top.cast("int")).over(_running(["doc"], order)))
    rows = rows.withColumn("l0", F.last("_top", ignorenulls=True).over(_running(["doc"], order)))
    rows = rows.withColumn("l1", F.last("_second", ignorenulls=True).over(_running(["doc", "_group"], order)))
    rest = tidy(F.regexp_extract(s, T.unicode_re(entry), 2))
    rows = rows.where(~is_top & ~is_second & T.matches(s, entry) & rest.rlike(paged))
    return rows.select(
        "doc", *order, "l0", "l1", F.regexp_extract(s, T.unicode_re(entry), 1).alias("index_no"),
        T.strip(F.regexp_extract(rest, paged, 1)).alias("title"), F.regexp_extract(rest, paged, 2).cast("int").alias("page_display"),
    )


def display_pages(page_lines: DataFrame, footer: str = r"^-\s*(\d+)\s*-$") -> DataFrame:
    """Printed page number -> page index: a page's first footer, a number's first page."""
    number = T.group(T.strip(F.col("line")), footer, 1).cast("int")
    rows = page_lines.withColumn("n", number).where("n IS NOT NULL")
    first = rows.groupBy("doc", "page_idx").agg(F.min_by("n", "line_no").alias("page_display"))
    return first.groupBy("doc", "page_display").agg(F.min("page_idx").alias("pdf_index"))


def zip_rows(left: DataFrame, right: DataFrame, key: str, left_order: list[str], right_order: list[str]) -> DataFrame:
    """Positional join inside each key, cut to the shorter side; ``position`` from 0."""
    a = left.withColumn("position", F.row_number().over(Window.partitionBy(key).orderBy(*left_order)) - 1)
    b = right.withColumn("position", F.row_number().over(Window.partitionBy(key).orderBy(*right_order)) - 1)
    return a.join(b, [key, "position"])


def page_ranges(starts: DataFrame, key: str, start: str, last: Column) -> DataFrame:
    """Each entry covers [start, next start - 1]; the last one runs to ``last``."""
    end = F.coalesce(F.lead(start).over(Window.partitionBy(key).orderBy(start)) - 1, last)
    return starts.withColumn("end", end).withColumn("valid", F.col("end") >= F.col(start))


def assign_pages(pages: DataFrame, ranges: DataFrame, key: str, page: str = "page", start: str = "start") -> DataFrame:
    """Pages (``key, page``) -> the entry of ``page_ranges`` that covers each: adds ``start,
    end``, null before the first entry. An as-of fill inside each document: a range join
    on the page number would meet every entry of the document. Of entries with one start
    only a valid one covers a page. Entries without a start cover nothing."""
    entries = ranges.where(F.col("valid") & F.col(start).isNotNull()).select(key, F.col(start).alias(page), F.struct(F.col(start), F.col("end")).alias("_entry"))
    rows = pages.withColumn("_entry", F.lit(None).cast(entries.schema["_entry"].dataType)).unionByName(entries.withColumn("_is", F.lit(0)), allowMissingColumns=True)
    by = Window.partitionBy(key).orderBy(page, F.col("_is").asc_nulls_last())
    rows = rows.withColumn("_last", F.last("_entry", ignorenulls=True).over(by)).where("_is IS NULL")
    inside = F.col(page) <= F.col("_last")["end"]
    return rows.select(*pages.columns, *[F.when(inside, F.col("_last")[c]).alias(c) for c in (start, "end")])


def quality_flags(records: DataFrame) -> DataFrame:
    """Checks of extracted records: no articles, dates glued into the title, a title
    that neither contains nor is contained in its table-of-contents entry."""
    a, b = T.without_ws(F.col("toc_title")), T.without_ws(F.col("parsed_title"))
    return records.select(
        "*",
        (F.col("article_count") == 0).alias("zero_articles"),
        (F.col("parsed_title").rlike(r"(?U)\d") & (F.size("amend_dates") == 0)).alias("glued_dates"),
        ((a != "") & ~F.contains(b, a) & ~F.contains(a, b)).alias("title_mismatch"),
    )


def heading_changes(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Which headings an outline shows before each article: those that changed, a
    chapter change showing the lower ones again."""
    by = Window.partitionBy(key).orderBy(*order)
    differs = lambda c: F.col(c).isNotNull() & ~F.col(c).eqNullSafe(F.lag(c).over(by))
    moved = lambda c: ~F.col(c).eqNullSafe(F.lag(c).over(by))
    rows = rows.withColumn("show_chapter", differs("chapter")).withColumn("_mc", moved("chapter"))
    rows = rows.withColumn("show_section", F.col("section").isNotNull() & (F.col("_mc") | moved("section"))).withColumn("_ms", F.col("_mc") | moved("section"))
    return rows.withColumn("show_gwan", F.col("gwan").isNotNull() & (F.col("_ms") | moved("gwan"))).drop("_mc", "_ms")


def sample_groups(groups: DataFrame, names: list[str], limit: int = 5) -> DataFrame:
    """The first groups (by document and island) whose header holds one of the names."""
    hit = F.exists(F.array(*[F.lit(n) for n in names]), lambda n: F.contains(F.col("header"), n))
    return groups.where(hit).orderBy("doc", "island").limit(limit)


def markdown_tables(rows: DataFrame, order: list[str], addenda: str = r"^부\s*칙$", addenda_name: str = "부칙") -> DataFrame:
    """Pipe tables among lines -> one line of HTML each; other lines stay. A table whose
    first row only says "addenda" is no table: it becomes that word and its cells' text,
    line by line, without page numbers and dividers. Result: ``doc``, the order columns
    of each line's place, ``line``."""
    is_row = T.matches(F.col("line"), r"^\s*\|(.+)\|\s*$")
    rows = rows.withColumn("_row", is_row)
    starts = F.col("_row") & ~F.coalesce(F.lag("_row").over(Window.partitionBy("doc").orderBy(*order)), F.lit(False))
    rows = rows.withColumn("_table", F.sum(starts.cast("int")).over(_running(["doc"], order)))
    other = rows.where("NOT _row").select("doc", *order, "line")
    cells = T.split_row(F.col("line"))
    block = F.array_sort(F.collect_list(F.struct(*order, cells.alias("cells"))))
    tables = rows.where("_row").groupBy("doc", "_table").agg(block.alias("b"))
    tables = tables.withColumn("rows", F.transform("b", lambda x: x["cells"])).withColumn("first", F.col("b")[0])
    divider = lambda c: c.rlike(r"^:?-{2,}:?$")
    second = F.get("rows", F.lit(1))
    has_divider = F.coalesce(F.forall(second, lambda c: divider(c) | (c == "")), F.lit(False))
    heading = T.matches(F.array_join(F.col("rows")[0], ""), addenda)
    body = F.slice("rows", F.when(has_divider, 3).otherwise(2), F.size("rows"))
    tag = lambda name: lambda c: F.concat(F.lit(f"<{name}>"), T.html_escape(c), F.lit(f"</{name}>"))
    tr = lambda cs, name: F.concat(F.lit("<tr>"), F.array_join(F.transform(cs, tag(name)), ""), F.lit("</tr>"))
    html = F.concat(F.lit('<table class="inline-table">'), tr(F.col("rows")[0], "th"), F.array_join(F.transform(body, lambda r: tr(r, "td")), ""), F.lit("</table>"))
    made = tables.where(~heading).select("doc", *[F.col(f"first.{c}").alias(c) for c in order], html.alias("line"))
    kept = lambda cs: F.filter(cs, lambda c: (c != "") & ~c.rlike(T.PAGE_FOOTER) & ~divider(c))
    texts = F.transform("b", lambda x, i: F.struct(*[x[c].alias(c) for c in order], F.when(i == 0, F.lit(addenda_name)).otherwise(F.array_join(kept(x["cells"]), " ")).alias("line")))
    flat = tables.where(heading).select("doc", F.explode(texts).alias("x")).select("doc", "x.*").where("line <> ''")
    return other.unionByName(made).unionByName(flat)


def relocate(rows: DataFrame, order: str, moving: Column, anchor: Column, structural: Column) -> DataFrame:
    """Move the lines that ``moving`` marks to the end of the segment that the first
    ``anchor`` line opens (before the next structural line); without an anchor they are
    dropped. ``order`` is one numeric column; a sort key ``place`` is returned."""
    rows = rows.withColumn("_m", F.coalesce(moving, F.lit(False))).withColumn("_a", F.coalesce(anchor, F.lit(False)) & ~F.col("_m")).withColumn("_s", F.coalesce(structural, F.lit(False)) & ~F.col("_m"))
    start = F.min(F.when(F.col("_a"), F.col(order))).over(Window.partitionBy("doc"))
    rows = rows.withColumn("_from", start)
    end = F.min(F.when(F.col("_s") & (F.col(order) > F.col("_from")), F.col(order))).over(Window.partitionBy("doc"))
    rows = rows.withColumn("_to", end).where(~F.col("_m") | F.col("_from").isNotNull())
    place = F.when(F.col("_m"), F.struct(F.coalesce(F.col("_to").cast("double"), F.lit(float("inf"))).alias("at"), F.lit(0).alias("side"), F.col(order).alias("n")))
    place = place.otherwise(F.struct(F.col(order).cast("double").alias("at"), F.lit(1).alias("side"), F.col(order).alias("n")))
    return rows.withColumn("place", place).drop("_m", "_a", "_s", "_from", "_to")
