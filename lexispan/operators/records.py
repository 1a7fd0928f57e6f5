"""Whole records in one flow: lines of documents in several dialects become nested records.

A dialect is data: one row of a grammar table that is joined to the documents, so one plan
parses documents of all dialects at once. Every line is classified once; that structure is
kept and feeds articles, addenda, attachments, dates and titles, which are grouped by
document before they meet. Nothing orders across documents.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexispan.functions import text as T
from lexispan.operators import segment
from lexispan.session import checkpointed


class Grammar(NamedTuple):
    """How documents of one dialect are written. Patterns are searched in stripped lines
    and have the groups of the given ones."""

    dialect: str
    chapter: str = T.CHAPTER
    section: str = T.SECTION
    subsection: str = T.SUBSECTION
    article: str = T.ARTICLE
    addenda: str = T.ADDENDA
    attachment: str = T.ATTACHMENT
    date_line: str = T.DATE_LINE
    unit: str | None = None  #: how a clause of the addenda begins; without it each line is one
    table_dates: str | None = None  #: dates in table rows of the front matter, groups 1 and 2
    title: str = "lines"  #: front lines joined by blanks, "glued" without, or only the "last"
    listed_dates: bool = True  #: a date line may list several, parted by commas
    spaced_dates: bool = False  #: white space inside a date stays
    dates_anywhere: bool = False  #: date lines are taken out wherever they stand
    addenda_opens_body: bool = True  #: the body may begin with its addenda
    keep_separators: bool = True  #: repeated addenda markers stay as lines
    separators_close: bool = False  #: such a line ends the open attachment
    worded_dates: bool = False  #: without date lines, the dates that the text spells out count


# The conventions of the converted sources.
_LOOSE = {"chapter": r"^제\s*(\d+)\s*장\s*(.*)$", "section": r"^제\s*(\d+)\s*절\s*(.*)$", "subsection": r"^제\s*(\d+)\s*관\s*(.*)$", "attachment": r"^[\[<](별지서식|별표)[^\]>]*[\]>]"}
CLAUSE = r'^(<div class="article-table-wrap"|부칙$|[①-⑳]|\d+\.\s|<별표|\[별표|<서식|\[서식|\(|이\s*(변경\s*)?(학칙|규정)은)'
TABLE_DATES = r"(신설|개정|제정|폐지|전면\s*개정)\s*([\d]{4}\s*\.\s*[\d]{1,2}\s*\.\s*[\d]{1,2})"
TABLE_ROW, TABLE_DIVIDER = r"^\|.*\|$", r"^\|[\s:|-]+\|$"

PAGED = Grammar("paged")
MARKDOWN = Grammar("markdown", **_LOOSE, title="glued", listed_dates=False, spaced_dates=True, dates_anywhere=True, addenda_opens_body=False, keep_separators=False, worded_dates=True)
WRAPPED = MARKDOWN._replace(dialect="wrapped", unit=rf"{CLAUSE}|^[<\[]별지서식", spaced_dates=False, keep_separators=True, separators_close=True)
PLAIN = WRAPPED._replace(dialect="plain", date_line=r"^$()()")
LEGACY = MARKDOWN._replace(dialect="legacy", table_dates=TABLE_DATES, title="last", worded_dates=False)
STATUTES = Grammar("statutes", date_line=r"^(제정|개정)\s*([\d.]+)\.?$", unit=CLAUSE, title="glued", listed_dates=False, dates_anywhere=True, addenda_opens_body=False)
GRAMMARS = (PAGED, MARKDOWN, WRAPPED, PLAIN, LEGACY, STATUTES)

_PATTERNS = ("chapter", "section", "subsection", "article", "addenda", "attachment", "date_line", "unit", "table_dates")


def grammar_table(spark: SparkSession, grammars: tuple[Grammar, ...] = GRAMMARS) -> DataFrame:
    """One row a dialect; a written-down list, so it may be broadcast."""
    rows = [g._replace(**{p: T.unicode_re(getattr(g, p)) if getattr(g, p) else None for p in _PATTERNS}) for g in grammars]
    kinds = {"listed_dates", "spaced_dates", "dates_anywhere", "addenda_opens_body", "keep_separators", "separators_close", "worded_dates"}
    return spark.createDataFrame(rows, ", ".join(f"{f} {'boolean' if f in kinds else 'string'}" for f in Grammar._fields))


def _group(s: Column, pattern: Column, n: int) -> Column:
    return F.nullif(F.call_function("regexp_extract", s, pattern, F.lit(n)), F.lit(""))


def _found(s: Column, pattern: Column) -> Column:
    return F.coalesce(F.call_function("regexp_extract", s, pattern, F.lit(0)) != "", F.lit(False))


def _dates(s: Column, g: Column) -> Column:
    """The dates of a line as an array of (kind, date, whether it may be the line's date of
    enactment: the last of a list); null where it has none."""
    kind, raw = _group(s, g["date_line"], 1), F.call_function("regexp_extract", s, g["date_line"], F.lit(2))
    bare = T.without_ws(raw)
    one = lambda d, last=F.lit(True), k=kind: F.struct(k.alias("kind"), d.alias("date"), last.alias("last"))
    listed = F.filter(F.transform(F.split(bare, ","), lambda d: F.regexp_replace(d, r"^\.+|\.+$", "")), lambda d: d != "")
    single = F.array(one(F.regexp_replace(F.when(g["spaced_dates"], T.strip(raw)).otherwise(bare), r"\.+$", "")))
    of_line = F.when(kind.isNotNull(), F.when(g["listed_dates"], F.transform(listed, lambda d, i: one(d, i + 1 == F.size(listed)))).otherwise(single))
    cells = lambda n: F.call_function("regexp_extract_all", s, g["table_dates"], F.lit(n))
    of_row = F.zip_with(cells(1), cells(2), lambda k, d: one(T.without_ws(d), k=k))
    in_row = g["table_dates"].isNotNull() & T.matches(s, TABLE_ROW)
    return F.coalesce(of_line, F.when(in_row & (F.size(of_row) > 0), of_row))


def classify(lines: DataFrame, docs: DataFrame, grammars: DataFrame, order: list[str]) -> DataFrame:
    """The structure of all lines that aren't blank: ``doc, dialect``, the order columns,
    ``page_idx, s, kind, dates``, headings in force, the running number ``seg`` of the
    segment, and an article's ``no, sub_no, title``.

    Kinds: D date line, F front matter, C S G headings, A article, B addenda marker, U line
    of the addenda, T other text.
    """
    by, before = Window.partitionBy("doc").orderBy(*order), Window.unboundedPreceding
    running, whole = by.rowsBetween(before, 0), Window.partitionBy("doc")
    rows = lines.withColumn("s", T.strip(F.col("line"))).where("s <> ''")
    if "page_idx" not in rows.columns:
        rows = rows.withColumn("page_idx", F.lit(None).cast("int"))
    known = grammars.select("dialect", F.struct(*[c for c in grammars.columns if c != "dialect"]).alias("g"))
    rows = rows.join(docs.select("doc", "dialect"), "doc").join(F.broadcast(known), "dialect")
    s, g = F.col("s"), F.col("g")
    rows = rows.withColumn("dates", _dates(s, g))
    divider = g["table_dates"].isNotNull() & T.matches(s, TABLE_DIVIDER)
    rows = rows.withColumn("_gone", g["dates_anywhere"] & (F.col("dates").isNotNull() | divider))
    opens = _found(s, g["chapter"]) | _found(s, g["article"]) | (g["addenda_opens_body"] & _found(s, g["addenda"]))
    rows = rows.withColumn("_opens", (opens & ~F.col("_gone")).cast("int"))
    never = (F.max("_opens").over(whole) == 0) & ~g["addenda_opens_body"]
    rows = rows.withColumn("_body", ((F.max("_opens").over(running) == 1) | never) & ~F.col("_gone"))
    rows = rows.withColumn("_marker", F.col("_body") & _found(s, g["addenda"]))
    rows = rows.withColumn("in_addenda", F.col("_body") & (F.max(F.col("_marker").cast("int")).over(running) == 1))
    kind = F.when(F.col("_gone") | (~F.col("_body") & F.col("dates").isNotNull()), "D").when(~F.col("_body"), "F").when(F.col("_marker"), "B").when(F.col("in_addenda"), "U")
    for name, pattern in (("C", "chapter"), ("S", "section"), ("G", "subsection"), ("A", "article")):
        kind = kind.when(_found(s, g[pattern]), name)
    rows = rows.withColumn("kind", kind.otherwise("T"))
    carry = lambda c, keys: F.last(c, ignorenulls=True).over(Window.partitionBy("doc", *keys).orderBy(*order).rowsBetween(before, 0))
    heading = lambda code, pattern, word: F.when(F.col("kind") == code, T.normalize_ws(F.concat(F.lit("제"), F.coalesce(_group(s, g[pattern], 1), F.lit("")), F.lit(word), F.coalesce(_group(s, g[pattern], 2), F.lit("")))))
    count = lambda kinds: F.sum(F.col("kind").isin(kinds).cast("int")).over(running)
    rows = rows.withColumns({"_c": count(["C"]), "_cs": count(["C", "S"]), "seg": count(["C", "S", "G", "A", "B"])})
    rows = rows.withColumns({"chapter": carry(heading("C", "chapter", "장 "), []), "section": carry(heading("S", "section", "절 "), ["_c"]), "gwan": carry(heading("G", "subsection", "관 "), ["_cs"])})
    is_article = F.col("kind") == "A"
    titled = F.call_function("regexp_extract", s, g["article"], F.lit(0)).endswith(")")
    return rows.select(
        "doc", "dialect", *order, *[c for c in ["page_idx"] if c not in order], "s", "kind", F.when(F.col("kind") == "D", F.col("dates")).alias("dates"), "chapter", "section", "gwan", "seg",
        F.when(is_article, _group(s, g["article"], 1)).alias("no"), F.when(is_article, _group(s, g["article"], 2)).alias("sub_no"),
        F.when(is_article & titled, F.call_function("regexp_extract", s, g["article"], F.lit(3))).alias("title"),
    )


def _sorted(order: list[str], *values: Column | str) -> Column:
    return F.array_sort(F.collect_list(F.struct(*order, *values)))


def article_lists(structure: DataFrame, order: list[str]) -> DataFrame:
    """``doc, articles``: the segments that an article opens, in order."""
    rows = structure.where("kind IN ('C', 'S', 'G', 'A', 'T')")
    first = F.min_by(F.struct("kind", "chapter", "section", "gwan", "no", "sub_no", "title"), F.struct(*order)).alias("h")
    segs = rows.groupBy("doc", "seg").agg(first, T.normalize_ws(segment.ordered_join(F.col("s"), order)).alias("body")).where("h.kind = 'A'")
    made = F.struct("h.chapter", "h.section", "h.gwan", "h.no", "h.sub_no", "h.title", "body")
    return segs.groupBy("doc").agg(F.transform(_sorted(["seg"], made.alias("a")), lambda x: x["a"]).alias("articles"))


def addenda_lists(structure: DataFrame, grammars: DataFrame, order: list[str]) -> DataFrame:
    """``doc, addenda, attachments``. Wrapped lines are joined to clauses where the dialect
    says how one begins; an attachment takes what follows its label, up to a separator
    where the dialect closes it there; pages are those of its lines, 1-based."""
    running = Window.partitionBy("doc").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    patterns = grammars.select("dialect", F.struct("unit", "attachment", "keep_separators", "separators_close").alias("g"))
    rows = structure.where("kind IN ('B', 'U')").join(F.broadcast(patterns), "dialect")
    g = F.col("g")
    rows = rows.withColumn("_n", F.sum((F.col("kind") == "B").cast("int")).over(running)).where((F.col("kind") == "U") | (g["keep_separators"] & (F.col("_n") > 1)))
    name = F.lit(segment.Markers().addenda_name)
    rows = rows.withColumn("s", F.when(F.col("kind") == "B", name).otherwise(F.col("s")))
    after = F.lag(F.contains("s", F.lit("<table")) | (F.col("s") == name)).over(Window.partitionBy("doc").orderBy(*order))
    fresh = g["unit"].isNull() | F.coalesce(after, F.lit(False)) | _found(F.col("s"), g["unit"]) | _found(F.col("s"), g["attachment"])
    rows = rows.withColumn("unit", F.sum(fresh.cast("int")).over(running))
    units = rows.groupBy("doc", "dialect", "unit").agg(segment.ordered_join(F.col("s"), order).alias("s"), F.min("page_idx").alias("first"), F.max("page_idx").alias("last")).join(F.broadcast(patterns), "dialect")
    label, closing = _found(F.col("s"), g["attachment"]), g["separators_close"] & (F.col("s") == name)
    by = Window.partitionBy("doc").orderBy("unit").rowsBetween(Window.unboundedPreceding, 0)
    units = units.withColumn("label", label & ~closing).withColumn("_turn", F.when(label | closing, label & ~closing))
    units = units.withColumn("open", F.coalesce(F.last("_turn", ignorenulls=True).over(by), F.lit(False))).withColumn("part", F.sum(F.col("label").cast("int")).over(by))
    plain = units.where("NOT open").groupBy("doc").agg(F.transform(_sorted(["unit"], "s"), lambda x: x["s"]).alias("addenda"))
    body = F.filter(_sorted(["unit"], "label", "s"), lambda x: ~x["label"])
    paged = lambda c: F.when(~F.col("label"), F.col(c)) + 1
    parts = units.where("open").groupBy("doc", "part").agg(F.min_by("s", "unit").alias("name"), F.transform(body, lambda x: x["s"]).alias("lines"), F.min(paged("first")).alias("start_page"), F.max(paged("last")).alias("end_page"))
    made = F.struct(F.col("name").alias("label"), "lines", "start_page", "end_page")
    attached = parts.groupBy("doc").agg(F.transform(_sorted(["part"], made.alias("a")), lambda x: x["a"]).alias("attachments"))
    return plain.join(attached, "doc", "full_outer")


def front_lists(structure: DataFrame, order: list[str]) -> DataFrame:
    """``doc, dated`` (kind, date, last), ``front`` (lines) in order."""
    rows = structure.where("kind IN ('D', 'F')").groupBy("doc").agg(_sorted(order, "kind", "s", "dates").alias("p"))
    dated = F.flatten(F.transform(F.filter("p", lambda x: x["dates"].isNotNull()), lambda x: x["dates"]))
    return rows.select("doc", dated.alias("dated"), F.transform(F.filter("p", lambda x: x["kind"] == "F"), lambda x: x["s"]).alias("front"))


def parse_records(lines: DataFrame, docs: DataFrame, grammars: DataFrame | None = None, order: list[str] | None = None) -> DataFrame:
    """``doc, parsed_title, enact_date, amend_dates, article_count, articles, addenda,
    attachments``, one nested record a document.

    ``lines``: ``doc``, the order columns, ``line`` and, where pages are known,
    ``page_idx``; ``docs``: ``doc, dialect`` and ``title_hint`` (null: the title is read).
    Documents of unknown dialects are left out; one without lines has an empty record. The
    enactment date is the last date of the first line that says so and has one.
    """
    order = order or ["line_no"]
    grammars = grammars if grammars is not None else grammar_table(lines.sparkSession)
    structure = checkpointed(classify(lines, docs, grammars, order))
    options = grammars.select("dialect", F.col("title").alias("_title"), F.col("worded_dates").alias("_worded"))
    out = docs.select("doc", "dialect", "title_hint").join(F.broadcast(options), "dialect")
    for part in (front_lists(structure, order), article_lists(structure, order), addenda_lists(structure, grammars, order)):
        out = out.join(part, "doc", "left")
    empty = lambda c, kind: F.coalesce(F.col(c), F.array().cast(kind))
    out = out.withColumns({c: empty(c, structure_type) for c, structure_type in (("front", "array<string>"), ("addenda", "array<string>"), ("articles", out.schema["articles"].dataType), ("attachments", out.schema["attachments"].dataType), ("dated", out.schema["dated"].dataType))})
    joined = lambda sep: T.normalize_ws(F.array_join("front", sep))
    unnumbered = F.regexp_replace(joined(""), r"(?U)^\d+\)\s*", "")
    read = F.when(F.col("_title") == "lines", joined(" ")).when(F.col("_title") == "glued", unnumbered).otherwise(T.clean_title(F.col("front")))
    worded = F.array_distinct(F.flatten(F.transform(F.concat("addenda", F.transform("articles", lambda a: a["body"])), T.worded_dates)))
    spelled = F.col("_worded") & (F.size("dated") == 0)
    # of the first line of enactment with a date its last one
    opening = F.try_element_at(F.filter("dated", lambda d: (d["kind"] == segment.Markers().enacted) & d["last"]), F.lit(1))["date"]
    return out.select(
        "doc", F.coalesce("title_hint", read).alias("parsed_title"), F.when(spelled, F.try_element_at(worded, F.lit(1))).otherwise(opening).alias("enact_date"),
        F.when(spelled, worded).otherwise(F.transform("dated", lambda d: d["date"])).alias("amend_dates"), F.size("articles").alias("article_count"), "articles", "addenda", "attachments",
    )


def book_records(pages: DataFrame, grammars: DataFrame | None = None, dialect: str = PAGED.dialect, contents: list[int] | None = None, **islands: list[int]) -> DataFrame:
    """Pages ``doc, page_idx, text`` of whole books -> a record for each regulation, with
    ``doc, island, index_no, first_header, pdf_pages``. The pages of the table of contents
    (``contents``) count as blank. This is a book's snapshot, titles as printed."""
    text = F.when(F.col("page_idx").isin(contents or []), F.lit("")).otherwise(F.col("text"))
    pages = pages.select("doc", "page_idx", F.coalesce(text, F.lit("")).alias("text"))
    found = checkpointed(segment.islands(pages, **islands))
    key = F.struct("doc", "island")
    kept = segment.content_lines(segment.lines(found.select(key.alias("doc"), "page_idx", "text")))
    heads = found.groupBy(key.alias("doc")).agg(F.first("index_no").alias("index_no"), F.first("header").alias("first_header"), F.array_sort(F.collect_list(F.col("page_idx") + 1)).alias("pdf_pages"))
    docs = heads.select("doc", F.lit(dialect).alias("dialect"), F.lit(None).cast("string").alias("title_hint"))
    records = parse_records(kept, docs, grammars, ["page_idx", "line_no"])
    return records.join(heads, "doc").select("doc.doc", "doc.island", *[c for c in records.columns if c != "doc"], "index_no", "first_header", "pdf_pages")


def extract_book(pages: DataFrame, toc: DataFrame, toc_order: list[str], grammars: DataFrame | None = None, contents: list[int] | None = None, **islands: list[int]) -> DataFrame:
    """A book's pages and its table of contents (``doc, l0, l1, title``) -> the records that
    ``dml.load_records`` takes, with quality flags. The n-th entry names the n-th
    regulation; what exceeds the shorter list is left out. ``seq`` counts inside a book."""
    records = book_records(pages, grammars, contents=contents, **islands)
    entries = toc.select("doc", *toc_order, "l0", "l1", F.col("title").alias("toc_title"))
    zipped = segment.zip_rows(records, entries, "doc", ["island"], toc_order)
    out = zipped.withColumn("seq", (F.col("position") + 1).cast("int")).drop("position", "island", *toc_order)
    return segment.quality_flags(out.withColumn("index_no", F.col("index_no").cast("string")))
