"""All registered queries of the document engine, over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexispan.functions import text as T
from lexispan.operators import catalog, dml, history, layout, markup, reconcile, render, segment, similar, spacing
from lexispan.plans import extraction
from lexispan.plans.tables import book, dotted, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

LETTERS = "a-z"
_LIST = ["id", "seq", "title", "category_l0", "category_l1", "latest_amend"]
#: Structural lines of the driver's documents, in the roles of chapters and articles.
MARKERS = segment.Markers(chapter=r"^(The)(?:[ ,.](.*))?$", section=r"^(In|Of)(?:[ ,.](.*))?$", subsection=r"^(To|And)(?:[ ,.](.*))?$", article=r"^(?:A|On|For|Is)(?:[ ,.]|$)()()()", addenda=r"^Or(?:[ ,.]|$)", attachment=r"^(Th)", words=("", "", ""), addenda_name="--")


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


# --- catalog -------------------------------------------------------------------


def _list(spark: SparkSession, sf_dir: str, sort: str) -> DataFrame:
    page, _ = catalog.list_regulations(book(spark, sf_dir), category_l0="BUILDING", sort=sort, page=2, page_size=20)
    return page.select(*_LIST)


@query
def list_by_seq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _list(spark, sf_dir, "seq")


@query
def list_by_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _list(spark, sf_dir, "abc")


@query
def list_by_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _list(spark, sf_dir, "date")


@query
def list_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, n = catalog.list_regulations(book(spark, sf_dir), category_l0="BUILDING", q="customer#%1_")
    return n.select("total", catalog.total_pages(F.col("total"), 20).alias("pages"))


@query
def list_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.list_titles(book(spark, sf_dir)).select(*_LIST)


@query
def recent_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.recent(book(spark, sf_dir), 10)


@query
def title_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    return part.where(T.like_ascii(F.col("p_name"), "E%_RI")).select("p_partkey", "p_name")


@query
def title_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select("p_partkey", F.col("p_type").alias("title"))
    return catalog.title_filter(part, "  Econ ")


def _body_book(spark: SparkSession, sf_dir: str) -> catalog.Book:
    """documents = articles of their sources; the labels say what is in force."""
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    regs = labels.select(
        F.col("doc_id").alias("id"), F.col("doc_id").alias("seq"), F.concat(F.lit("r"), F.col("doc_id").cast("string")).alias("title"),
        F.when(F.col("quality") == 1, T.IN_FORCE).otherwise("-").alias("status"), F.lit("l0").alias("category_l0"), F.lit(None).cast("string").alias("category_l1"),
    )
    arts = docs.select(F.col("doc_id").alias("regulation_id"), (F.col("doc_id") % 50).cast("int").alias("no"), (F.col("doc_id") % 3).cast("int").alias("sub_no"), F.col("lang").alias("title"), F.col("text").alias("body"), F.lit(0).alias("ordinal"))
    return catalog.Book(regs, articles=arts)


@query
def body_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = catalog.list_bodies(_body_book(spark, sf_dir), "TION the")
    return found.select("regulation_id", "regulation_title", "article_no", "article_sub_no", "article_label", "snippet")


@query
def body_search_snippet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", T.snippet(F.col("html"), "The", 40).alias("snippet"))


@query
def attachment_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = catalog.attachments(book(spark, sf_dir), "urgent")
    return found.select("regulation_id", "regulation_title", F.col("ordinal").cast("long").alias("ordinal"), "label", "has_table")


@query
def revision_range_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = catalog.revisions(book(spark, sf_dir), "customer#", "1995-01-01", "1997-12-31")
    return found.select("id", "regulation_id", "regulation_title", "revised_at", "changed_count")


@query
def revision_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = catalog.revisions(book(spark, sf_dir), None, "1996-01-01", None)
    return catalog.paged(found, catalog.revisions_order(), 2, 20).select("id", "regulation_id", "revised_at", "changed_count")


@query
def revisions_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.revisions_by_date(book(spark, sf_dir))


@query
def detail_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = book(spark, sf_dir)
    nested = catalog.details(b._replace(attachments=None))
    return nested.select("id", "title", F.size("amendments").alias("n_amendments"), F.array_join(F.transform("amendments", lambda x: x["amend_date"]), ",").alias("amendments"))


@query
def joined_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("regulation_id"), F.col("turn").alias("ordinal"), F.col("text").alias("body"))
    out = catalog.joined_bodies(turns)
    return out.select("regulation_id", F.md5("body").alias("body_md5"), F.length("body").alias("n"))


@query
def category_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    supplier, nation, region = (table(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    regs = supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey")).join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    regs = regs.select(
        F.col("s_suppkey").alias("id"), F.col("s_suppkey").alias("seq"), F.col("s_name").alias("title"), F.lit(T.IN_FORCE).alias("status"),
        F.when(F.col("r_name") != "ASIA", F.col("r_name")).alias("category_l0"), F.when(F.col("n_nationkey") % 4 != 0, F.col("n_name")).otherwise("").alias("category_l1"),
    )
    return catalog.tree(catalog.Book(regs), ["EUROPE", "AFRICA"])


# --- titles, versions, dates -------------------------------------------------------


@query
def title_norm_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    left = part.select("p_partkey", F.concat(F.col("p_brand"), F.lit(" ·("), F.col("p_size").cast("string"), F.lit(")")).alias("raw"))
    right = part.where("p_type = 'PROMO'").select(F.col("p_partkey").alias("id"), F.concat(F.col("p_brand"), F.lit(", "), F.col("p_size").cast("string")).alias("title"))
    return reconcile.unique_match(left, right, T.normalize_title(F.col("raw")), T.normalize_title(F.col("title")), "id")


@query
def archive_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    raw = F.concat(F.col("p_type"), F.when(F.col("p_size") % 2 == 0, " 전면개정 (안)").otherwise(" 개정(안) (69회)"), F.when(F.col("p_size") % 3 == 0, "（x）").otherwise(" "))
    return part.select("p_partkey", T.archive_title(raw).alias("title"), T.archive_key(raw).alias("key"))


@query
def version_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", F.floor("value").alias("value"))
    out = history.version_pairs(events, ["user_id", "event_type"], "event_id", "value")
    return out.select("user_id", "event_type", "event_id", "old_value", "value")


@query
def version_diff_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    versions = turns.select(F.col("conv_id").alias("regulation_id"), F.when(F.col("role") == "user", 1).otherwise(2).alias("no"), F.lit(None).cast("int").alias("sub_no"), F.lpad(F.col("turn").cast("string"), 6, "0").alias("date"), F.col("text").alias("body"))
    out = history.article_changes(versions)
    return out.select("regulation_id", "article_no", "revised_at", "method", F.md5("old_body").alias("old_md5"), F.md5("new_body").alias("new_md5"))


def _tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order as an article version that carries amendment tags."""
    orders = table(spark, sf_dir, "orders")
    date = F.date_format("o_orderdate", "yyyy. M. d")
    earlier = F.date_format(F.date_sub(F.col("o_orderdate").cast("date"), 400), "yyyy.MM.dd")
    body = F.concat(F.lit("제3조(목적) "), F.col("o_orderpriority"), F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit(" (개정 "), date, F.lit(")"))).otherwise(""), F.when(F.col("o_orderkey") % 4 == 0, F.concat(F.lit(" (신설 "), earlier, F.lit(", "), date, F.lit(")"))).otherwise(""))
    return orders.select(F.col("o_custkey").alias("regulation_id"), F.col("o_orderkey").alias("version"), F.lit(3).alias("no"), F.lit(None).cast("int").alias("sub_no"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"), body.alias("body"))


@query
def tag_date_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _tagged(spark, sf_dir)
    return rows.select("version", F.array_join(T.tag_dates(F.col("body")), ",").alias("dates"))


@query
def revision_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    changes = history.article_changes(_tagged(spark, sf_dir), order="version")
    return changes.groupBy("regulation_id", "revised_at", "method").agg(F.count(F.lit(1)).alias("n_changes"))


@query
def interval_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").withColumn("day", F.col("ts").cast("date"))
    signups = events.where("event_type = 'signup'").select("event_id", "user_id", "day")
    bought = events.where("event_type = 'purchase'").select("user_id", F.col("day").alias("at"))
    out = reconcile.covered_by(signups, bought, "user_id", "day", T.add_months_28(F.col("day"), 1), "at", "event_id")
    return out.select("event_id", "user_id", "status", F.when(F.col("hits").isNull(), 0).otherwise(F.size("hits")).alias("n_hits"), F.date_format(F.array_min("hits"), "yyyy-MM-dd").alias("first_hit"))


@query
def asof_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").withColumn("day", F.col("ts").cast("date"))
    left = events.where("event_type = 'view'").select("event_id", "user_id", "day")
    right = events.where("event_type = 'purchase'").select("user_id", F.col("day").alias("edition")).distinct()
    out = reconcile.next_edition(left, right, "day", "edition", 5, "user_id")
    return out.select("event_id", "user_id", F.date_format("next", "yyyy-MM-dd").alias("next"))


@query
def anti_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("regulation_id"), dotted("o_orderdate").alias("revised_at"), "o_orderkey", "o_orderstatus")
    existing = orders.where("o_orderstatus = 'F'")
    incoming = orders.where("o_orderstatus <> 'F'")
    return dml.upsert_new(existing, incoming, ["regulation_id", "revised_at"], ["o_orderkey"]).drop("o_orderstatus")


@query
def semi_exists(spark: SparkSession, sf_dir: str) -> DataFrame:
    big = table(spark, sf_dir, "orders").where("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").select("c_custkey", "c_name").join(big, "c_custkey", "left_semi")


@query
def orphan_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'")
    return dml.unmatched(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber"), orders, "l_orderkey", "o_orderkey").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n_lines"))


@query
def first_writer(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "value")
    return history.first_wins(events, ["user_id", "event_type"], ["value", "event_id"])


@query
def last_writer(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "value")
    return reconcile.last_stage(events, ["user_id", "event_type"], ["value", "event_id"])


@query
def stage_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    name = F.when(F.col("o_orderkey") % 5 == 0, F.concat(F.lit("규정집 "), "o_orderstatus")).when(F.col("o_orderkey") % 5 == 1, F.col("o_orderstatus")).otherwise(F.concat((F.col("o_orderkey") % 9).cast("string"), F.lit("-"), (F.col("o_orderkey") % 4).cast("string"), F.col("o_orderstatus")))
    rank = reconcile.stage_rank(name)
    return orders.select("o_orderkey", rank["major"].alias("major"), rank["minor"].alias("minor"))


@query
def committee_crosscheck(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = table(spark, sf_dir, "customer")
    records = customer.select(F.col("c_custkey").alias("record_id"), F.make_date(F.lit(1995), (F.col("c_custkey") % 12 + 1).cast("int"), (F.col("c_custkey") % 28 + 1).cast("int")).alias("session_date"), F.concat(F.lit("우리대학교 "), F.col("c_name"), F.lit(" ・")).alias("title"))
    b = book(spark, sf_dir)
    out = reconcile.crosscheck(records, b.regulations, b.revisions, 9, "우리대학교")
    return out.select("record_id", "regulation_id", "status", F.when(F.col("hits").isNull(), 0).otherwise(F.size("hits")).alias("n_hits"))


@query
def comparison_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    lineitem = table(spark, sf_dir, "lineitem")
    old = F.when(F.col("l_linenumber") == 1, "(신설)").otherwise(F.concat(F.lit("제"), F.col("l_linenumber").cast("string"), F.lit("조("), F.col("l_returnflag"), F.lit(") **old**<br>text")))
    new = F.when(F.col("l_linenumber") == 2, "삭제").otherwise(F.concat(F.lit("제"), F.col("l_linenumber").cast("string"), F.lit("조의2("), F.col("l_linestatus"), F.lit(") <u>new</u>")))
    line = F.concat(F.lit("| "), old, F.lit(" | "), new, F.lit(" |"))
    blocks = lineitem.groupBy("l_orderkey").agg(F.concat(F.lit("|현행규정|개정(안)|\n|---|---|\nnote\n"), F.array_join(F.array_sort(F.collect_list(line)), "\n")).alias("content"))
    out = reconcile.comparison_changes(blocks)
    return out.groupBy("l_orderkey", "article_no", "article_sub_no", "article_title", "old_body", "new_body").agg(F.count(F.lit(1)).alias("n"))


@query
def full_text_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    old = F.when(F.col("turn") % 3 == 0, "").otherwise(F.col("role"))
    new = F.when(F.col("turn") % 5 == 0, "제2조 (현행과 같음)").otherwise(F.col("text"))
    return turns.where(T.full_text(old, new)).select("conv_id", "turn")


@query
def override_coalesce(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation")
    names = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("n_nationkey"), F.col("r_name").alias("title"))
    suppliers = table(spark, sf_dir, "supplier").join(F.broadcast(nation), F.col("s_nationkey") == F.col("n_nationkey"))
    out = history.override(suppliers.select("s_suppkey", "n_nationkey", "n_name"), "n_name", names, ["n_nationkey"], "title")
    return out.select("s_suppkey", history.override_by_pattern(F.col("n_name"), [("^A.*A$", "A-A"), ("^NATION_1", "one")]).alias("name"))


@query
def exclude_tuple(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.when(F.col("l_returnflag") != "N", F.col("l_returnflag")).alias("flag"), "l_quantity")
    reviewed = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("l_orderkey"), F.lit(1).alias("l_linenumber"), F.lit(None).cast("string").alias("flag"))
    out = history.excluded(lines, reviewed, ["l_orderkey", "l_linenumber", "flag"], lines["l_quantity"] > 10)
    return out.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("quantity"))


# --- segmentation -------------------------------------------------------------------


def _event_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    number = (F.floor(F.col("event_id") / 3) % 7 + 1).cast("string")
    text = F.when(F.col("event_type") == "view", "\n continued ").when(F.col("event_type") == "error", "  ").otherwise(F.concat(F.lit("\n"), number, F.lit(".  "), F.col("event_type"), F.lit("\nbody")))
    return events.select(F.col("user_id").alias("doc"), F.col("event_id").alias("page_idx"), text.alias("text"))


@query
def islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = segment.islands(_event_pages(spark, sf_dir))
    return out.select("doc", "page_idx", "island", "index_no", F.col("header").alias("first_header"))


@query
def header_text_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = segment.header_islands(_event_pages(spark, sf_dir))
    return out.select("doc", "page_idx", "island", "index_key")


@query
def page_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = segment.content_lines(segment.lines(_event_pages(spark, sf_dir)))
    return out.select("doc", "page_idx", "line_no", "line")


def _doc_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), F.lit(0).alias("page_idx"), "text")
    return segment.lines(docs)


@query
def forward_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = segment.structure(_doc_lines(spark, sf_dir), ["line_no"], MARKERS).where("NOT in_addenda")
    return out.select("doc", "line_no", "kind", F.md5("chapter").alias("chapter"), F.md5("section").alias("section"), F.md5("gwan").alias("gwan"))


@query
def running_flag_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = segment.articles(segment.structure(_doc_lines(spark, sf_dir), ["line_no"], MARKERS), ["line_no"], MARKERS)
    return out.select("doc", "ordinal", F.md5("chapter").alias("chapter"), F.md5("body").alias("body_md5"))


@query
def addenda_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = segment.addenda_lines(segment.structure(_doc_lines(spark, sf_dir), ["line_no"], MARKERS), ["line_no"], MARKERS)
    return rows.select("doc", "line_no", F.md5("s").alias("line_md5"), "attachment", "is_label")


@query
def attachment_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = segment.addenda_lines(segment.structure(_doc_lines(spark, sf_dir), ["line_no"], MARKERS), ["line_no"], MARKERS)
    out = segment.attachments(rows, ["line_no"])
    return out.select("doc", "ordinal", F.md5("label").alias("label_md5"), F.size("lines").alias("n_lines"), "start_page", "end_page")


@query
def merged_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = segment.merge_units(_doc_lines(spark, sf_dir), ["line_no"], r"^(?:The|In)(?:[ ,.]|$)", "-")
    return out.select("doc", "unit", F.md5("line").alias("line_md5"))


@query
def block_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = segment.blocks(_doc_lines(spark, sf_dir), ["line_no"], r"^(The(?:[ ,.].*)?)$")
    return out.select("doc", "block", F.md5("title").alias("title_md5"), F.md5("content").alias("content_md5"))


@query
def toc_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    line = F.when(F.col("event_type") == "signup", F.concat(F.lit("Ⅱ.  top  "), F.col("event_id").cast("string"))).when(F.col("event_type") == "error", F.concat(F.lit("B. second · "), F.col("event_id").cast("string")))
    line = line.when(F.col("event_type") == "view", "no number").otherwise(F.concat(F.lit("7. entry · x  "), F.col("event_id").cast("string")))
    rows = events.select(F.col("user_id").alias("doc"), "event_id", line.alias("line"))
    return segment.toc(rows, ["event_id"])


@query
def display_page_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("doc"), F.col("l_orderkey").alias("page_idx"), F.col("l_linenumber").alias("line_no"), F.concat(F.lit(" - "), (F.col("l_partkey") % 30).cast("string"), F.lit(" -")).alias("line"))
    lines = lines.groupBy("doc", "page_idx", "line_no").agg(F.min("line").alias("line"))
    return segment.display_pages(lines)


@query
def zip_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("nation"), "s_suppkey")
    right = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nation"), "c_custkey")
    return segment.zip_rows(left, right, "nation", ["s_suppkey"], ["c_custkey"])


@query
def lead_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    starts = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("doc")).agg(F.collect_set((F.col("o_orderkey")).cast("long")).alias("s")).select("doc", F.explode("s").alias("start"))
    return segment.page_ranges(starts, "doc", "start", F.lit(10**9).cast("long"))


@query
def outline_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("reg"), "o_orderkey", F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")).alias("chapter"), F.when(F.col("o_orderkey") % 2 == 0, F.left("o_orderpriority", F.lit(1))).alias("section"), F.lit(None).cast("string").alias("gwan"))
    out = segment.heading_changes(lines, "reg", ["o_orderkey"])
    return out.select("reg", "o_orderkey", "show_chapter", "show_section", "show_gwan")


@query
def front_matter(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_shipdate").alias("d"))
    text = F.when(F.col("l_linenumber") == 1, F.concat(F.lit(" name  of "), F.col("l_orderkey").cast("string"))).when(F.col("l_linenumber") == 2, F.concat(F.lit("제정 "), F.date_format("d", "yyyy. M. d"), F.lit(".")))
    text = text.when(F.col("l_linenumber") == 3, F.concat(F.lit("개정 "), F.date_format("d", "yyyy.MM.dd"), F.lit(", "), F.date_format("d", "yyyy. M"))).when(F.col("l_linenumber") == 4, "제1조(목적) x").otherwise("개정 1999.1.1")
    out = segment.front_matter(lines.select(F.col("l_orderkey").alias("doc"), "l_linenumber", text.alias("line")), ["l_linenumber"])
    return out.select("doc", "title", "enact_date", F.array_join("amend_dates", ",").alias("amend_dates"))


# --- statistics, matching, text -------------------------------------------------------


@query
def bigram_joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spacing.joined_pairs(table(spark, sf_dir, "documents"), "text", LETTERS)


@query
def bigram_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spacing.split_pairs(table(spark, sf_dir, "documents"), "text", LETTERS)


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return spacing.candidates(spacing.joined_pairs(docs, "text", LETTERS), spacing.split_pairs(docs, "text", LETTERS), 15, 0.9, "xq", ("he",))


@query
def bigram_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _candidates(spark, sf_dir).select("pair", "joined", "split")


@query
def spacing_fix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = spacing.close_gaps(docs, _candidates(spark, sf_dir), "text", LETTERS, rounds=4)
    return out.select("doc_id", F.length("text").alias("n"), F.md5("text").alias("text_md5"))


@query
def spacing_corrections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty pairs whose gaps were closed most often."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    pairs = _candidates(spark, sf_dir)
    fixed = spacing.close_gaps(docs, pairs, "text", LETTERS, rounds=4)
    return spacing.correction_counts(docs, fixed, "doc_id", pairs, "text", LETTERS).orderBy(F.desc("n"), "pair").limit(20)


@query
def best_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark item against every document; a page holds a hundred consecutive
    ids, and an item may lie on any page."""
    one, first, last = F.lit(0), F.lit(-(2**62)), F.lit(2**62)
    items = table(spark, sf_dir, "benchmark").select(one.alias("doc"), F.col("item_id").alias("attachment"), first.alias("start_page"), last.alias("end_page"), "text")
    docs = table(spark, sf_dir, "documents").select(one.alias("doc"), F.floor(F.col("doc_id") / 100).alias("page"), F.col("doc_id").alias("tbl"), "text")
    out = similar.best_match(items, docs)
    return out.select("attachment", "page", "tbl", F.round("score", 6).alias("score"))


@query
def best_match_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark item against every document."""
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("attachment"), "text")
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("tbl"), "text")
    return similar.best_match_anywhere(items, docs).withColumn("score", F.round("score", 6))


@query
def shingle_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    by = Window.partitionBy("conv_id").orderBy("turn")
    pairs = turns.withColumn("before", F.lag("text").over(by)).where("before IS NOT NULL")
    score = similar.containment(similar.shingles(T.without_ws(F.col("text"))), T.without_ws(F.col("before")))
    return pairs.select("conv_id", "turn", F.round(score, 6).alias("score"))


@query
def trigram_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar.trigram_frequencies(table(spark, sf_dir, "documents"))


@query
def strip_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.md5(T.clean_cell(F.col("html"))).alias("text_md5"))


@query
def html_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    items = pages.select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit("(?s)<li>(.*?)</li>"), F.lit(1))).alias("at", "item"))
    return items.select("page_id", "at", T.clean_cell(F.col("item")).alias("item"))


@query
def html_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as cells of a table that nests another one, taken apart again."""
    turns = table(spark, sf_dir, "conversations")
    cell = F.concat(F.lit("<tr><td>"), F.col("role"), F.lit("</td><td>"), T.html_escape(F.col("text")), F.lit("<table><tr><td>x</td></tr></table></td></tr>"))
    rows = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", cell.alias("c")))), lambda x: x["c"]), "")
    made = turns.groupBy("conv_id").agg(F.concat(F.lit("<table>"), rows, F.lit("</table>")).alias("html"))
    return markup.grid(made, "conv_id", "html").select("conv_id", "row", F.size("cells").alias("n_cells"), F.md5(F.array_join("cells", "|")).alias("cells_md5"))


@query
def table_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    rows = F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))), lambda x: F.array(x["role"], x["text"]))
    made = turns.groupBy("conv_id").agg(rows.alias("rows"))
    return made.where(T.real_table(F.col("rows")) & ~T.degenerate(F.col("rows"))).select("conv_id", F.md5(T.table_html(F.col("rows"))).alias("html_md5"))


@query
def token_lcs_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    by = Window.partitionBy("conv_id", "role").orderBy("turn")
    pairs = turns.withColumn("before", F.lag("text").over(by)).where("before IS NOT NULL")
    out = pairs.withColumn("d", render.diff_html("before", "text"))
    return out.select("conv_id", "turn", F.md5("d.old_html").alias("old_md5"), F.md5("d.new_html").alias("new_md5"), (F.size(F.split("d.old_html", "diff-del")) - 1).alias("n_deleted"))


@query
def body_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.md5(render.format_body("text")).alias("html_md5"), F.md5(render.display_body("text")).alias("shown_md5"))


@query
def highlight(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _tagged(spark, sf_dir)
    return rows.select("version", T.highlight_amendments(F.col("body")).alias("html"))


@query
def article_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _tagged(spark, sf_dir)
    return rows.select("version", T.strip_article_head(F.col("body"), F.col("no"), F.col("sub_no")).alias("rest"), T.own_title(F.col("body")).alias("own_title"))


@query
def text_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    name = F.concat(F.lit("book "), F.date_format("o_orderdate", "yyyyMM"), F.lit(".pdf"))
    worded = F.date_format("o_orderdate", "yyyy'년 'M'월 'd'일'")
    return orders.select(
        "o_orderkey",
        F.date_format(T.file_date(name), "yyyy-MM-dd").alias("file_date"),
        F.array_join(T.worded_dates(F.concat(worded, F.lit(" 및 "), worded)), ",").alias("worded"),
        F.date_format(T.text_date(F.date_format("o_orderdate", "yyyy.M.d")), "yyyy-MM-dd").alias("parsed"),
        F.date_format(T.add_months_28(F.col("o_orderdate").cast("date"), 9), "yyyy-MM-dd").alias("later"),
    )


# --- updates ------------------------------------------------------------------------


@query
def chronological_reorder(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("regulation_id"), dotted("o_orderdate").alias("amend_date"), "o_orderkey", "o_orderstatus")
    old = history.first_wins(orders.where("o_orderstatus <> 'O'"), ["regulation_id", "amend_date"], ["o_orderkey"]).drop("o_orderkey", "o_orderstatus")
    old = old.withColumn("ordinal", F.row_number().over(Window.partitionBy("regulation_id").orderBy("amend_date")) - 1)
    return dml.insert_chronologically(old, orders.where("o_orderstatus = 'O'"), "regulation_id", "amend_date")


@query
def append_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("regulation_id"), dotted("o_orderdate").alias("amend_date"), "o_orderkey", "o_orderstatus")
    old = history.first_wins(orders.where("o_orderstatus <> 'O'"), ["regulation_id", "amend_date"], ["o_orderkey"]).drop("o_orderkey", "o_orderstatus")
    old = old.withColumn("ordinal", F.row_number().over(Window.partitionBy("regulation_id").orderBy("amend_date")) - 1)
    return dml.append(old, orders.where("o_orderstatus = 'O'"), "regulation_id", "amend_date")


@query
def merge_update_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size", "p_type")
    current = dml.without_keys(part.where("p_type <> 'SMALL'").drop("p_type"), "p_partkey", [3, 5, 7])
    updates = part.where("p_type IN ('SMALL', 'ECONOMY')").select("p_partkey", F.upper("p_name").alias("p_name"), F.when(F.col("p_size") > 20, F.lit(0)).alias("p_size"))
    merged = dml.merge(current, updates, ["p_partkey"], ["p_name", "p_size"])
    mapping = part.where("p_type = 'LARGE'").select(F.col("p_partkey").alias("old"), (-F.col("p_partkey")).alias("new"))
    return dml.renumber(merged, mapping, "p_partkey")


@query
def save_revision_effect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edits of one supplier's parts, as a saved revision's change rows."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.min("l_suppkey").alias("regulation_id"))
    part = table(spark, sf_dir, "part").join(lines, F.col("p_partkey") == F.col("l_partkey"))
    arts = part.select(F.col("p_partkey").alias("id"), "regulation_id", F.col("p_size").alias("no"), F.lit(None).cast("int").alias("sub_no"), F.col("p_brand").alias("title"), F.col("p_name").alias("body"), F.col("p_partkey").cast("int").alias("ordinal"))
    edits = arts.select("id", F.when(F.col("id") % 2 == 0, F.upper("body")).otherwise(F.col("body")).alias("body"))
    b = book(spark, sf_dir)
    b = b._replace(articles=arts, revision_changes=spark.createDataFrame([], "revision_id long, article_no int, article_sub_no int, article_title string, old_body string, new_body string, ordinal int"))
    _, changes = dml.save_revision(b, 1, "2024-01-02", edits, "s", "t")
    return changes.select("revision_id", "article_no", "article_title", "old_body", "new_body", "ordinal")


@query
def dq_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").select("doc_id").distinct().withColumn("labelled", F.lit(1))
    rows = docs.join(labels, "doc_id", "left").select(
        "doc_id", F.coalesce("labelled", F.lit(0)).alias("article_count"), F.col("lang").alias("toc_title"), F.col("text").alias("parsed_title"), F.array().cast("array<string>").alias("amend_dates")
    )
    out = segment.quality_flags(rows)
    return out.select("doc_id", "zero_articles", "glued_dates", "title_mismatch")


@query
def owner_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    records = lines.groupBy(F.col("l_suppkey").alias("seq")).agg(F.collect_set("l_partkey").alias("pdf_pages"))
    pages = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("page"))
    return similar.owner_of_page(pages, records)


@query
def word_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as words: a page an order, x the line number, y the quantity."""
    words = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc"), F.lit(0).alias("page"), F.col("l_linenumber").cast("double").alias("x0"), F.col("l_quantity").alias("y0"), F.col("l_partkey").cast("string").alias("word"))
    return layout.word_rows(words).select("doc", "row", "text", "y0")


@query
def words_in_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    words = lines.groupBy(F.col("l_orderkey").alias("doc"), F.lit(0).alias("page"), F.col("l_linenumber").cast("double").alias("x0"), F.col("l_quantity").alias("y0")).agg(F.count(F.lit(1)).alias("n"))
    words = words.withColumn("x1", F.col("x0") + 1).withColumn("y1", F.col("y0") + 2)
    boxes = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'")
    boxes = boxes.select(F.col("o_orderkey").alias("doc"), F.lit(0).alias("page"), F.explode(F.array(F.lit(0), F.lit(1))).alias("tbl"))
    boxes = boxes.select("doc", "page", "tbl", (F.col("tbl") * 2.0).alias("x0"), F.lit(0.0).alias("y0"), (F.col("tbl") * 2.0 + 3).alias("x1"), F.lit(30.0).alias("y1"))
    out = layout.words_in_tables(words, boxes, 0.25)
    return out.select("doc", "x0", "y0", "n", "tbl")


# --- smaller pieces -------------------------------------------------------------------


@query
def amendment_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = book(spark, sf_dir)
    out = catalog.amendment_links(b._replace(revisions=b.revisions.where("created_at = 'F'")))
    return out.select("regulation_id", "amend_date", "ordinal", "revision_id", "has_revision")


@query
def page_noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    names = [r["r_name"] for r in table(spark, sf_dir, "region").select("r_name").collect()]  # five rows
    body = F.concat(F.lit("제1조 "), F.col("o_orderpriority"), F.lit(" 12. ASIA - 3 - "), F.col("o_orderstatus"))
    return orders.select("o_orderkey", T.page_noise_removed(body, names).alias("body"))


@query
def markdown_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as table rows between text lines of their order."""
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("n")).agg(F.min("l_returnflag").alias("a"), F.min("l_linestatus").alias("b"))
    text = F.when(F.col("n") == 1, "before").when(F.col("n") == 3, "| --- | --- |").otherwise(F.concat(F.lit("| "), "a", F.lit(" | <"), "b", F.lit("> |")))
    return segment.markdown_tables(lines.select("doc", "n", text.alias("line")), ["n"])


@query
def labels_of_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    size = F.col("p_size")
    return part.select(
        "p_partkey",
        T.tighten(F.concat(F.lit("제 "), size.cast("string"), F.lit(" 조 의 2 및 제 3 항"))).alias("tight"),
        T.page_range_label(F.when(size % 3 != 0, size), size + size % 2).alias("pages"),
        T.breadcrumb(F.col("p_name"), F.col("p_type"), F.when(size % 2 == 0, "").otherwise(F.col("p_brand"))).alias("path"),
        T.anchor_id(size, size % 3).alias("anchor"),
        T.append_to_last_row(F.concat(F.lit("<tr><td>x</td></tr><tr><td>"), F.col("p_brand"), F.lit("</td><td>y</td></tr>")), F.col("p_type")).alias("row"),
    )


@query
def sampled_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first five islands whose header names a purchase or a signup."""
    groups = segment.islands(_event_pages(spark, sf_dir)).select("doc", "island", "header").distinct()
    return segment.sample_groups(groups, ["purchase", "signup"]).select("doc", "island", "header")


# --- whole books: loading, snapshots, seeds --------------------------------------


def _changed_book(spark: SparkSession, sf_dir: str) -> catalog.Book:
    """The book with line items as whole change rows."""
    changes = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("revision_id"), F.col("l_linenumber").alias("article_no"), F.lit(None).cast("int").alias("article_sub_no"), F.col("l_returnflag").alias("article_title"),
        F.col("l_linestatus").alias("old_body"), F.col("l_quantity").cast("int").cast("string").alias("new_body"), F.col("l_linenumber").alias("ordinal"),
    )
    return book(spark, sf_dir)._replace(revision_changes=changes)


def _listed(changes: str) -> F.Column:
    return F.array_join(F.transform(changes, lambda x: F.concat_ws(":", x["article_no"].cast("string"), x["article_title"], x["old_body"], x["new_body"])), ",")


@query
def seed_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dml.seed_entries(_changed_book(spark, sf_dir))
    return out.select("regulation_seq", "revised_at", "summary", F.size("changes").alias("n_changes"), _listed("changes").alias("changes"))


@query
def seed_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A book that holds the finished orders as revisions takes in the seed of all orders;
    those of a day it has are not taken again."""
    whole = _changed_book(spark, sf_dir)
    part = whole._replace(revisions=whole.revisions.where(F.col("created_at") == "F"))
    loaded = dml.load_seed(part, dml.seed_entries(whole), "seed")
    return loaded.revisions.select("regulation_id", "revised_at", "summary", "created_at")


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order with line items as a nested record of one regulation."""
    lines = table(spark, sf_dir, "lineitem")
    text = lambda c: F.col(c).cast("string")
    article = F.struct(
        "l_linenumber", F.col("l_returnflag").alias("title"), F.col("l_quantity").cast("int").cast("string").alias("body"),
        F.when(F.col("l_partkey") % 3 == 0, "").otherwise((F.col("l_partkey") % 3).cast("string")).alias("sub_no"),
    )
    of = lines.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(article)).alias("a"), F.array_sort(F.collect_set(F.col("l_suppkey").cast("int"))).alias("pdf_pages"))
    null = F.lit(None).cast("string")
    articles = F.transform("a", lambda x: F.struct(x["title"].alias("chapter"), null.alias("section"), null.alias("gwan"), x["l_linenumber"].cast("string").alias("no"), x["sub_no"].alias("sub_no"), x["title"].alias("title"), x["body"].alias("body")))
    lines_of = lambda flag: F.transform(F.filter("a", lambda x: x["title"] == flag), lambda x: x["body"])
    attachments = F.transform(lines_of("A"), lambda x: F.struct(x.alias("label"), F.array(x).alias("lines")))
    orders = table(spark, sf_dir, "orders").join(of, F.col("o_orderkey") == F.col("l_orderkey"))
    return orders.select(
        F.col("o_orderkey").alias("seq"), F.col("o_orderpriority").alias("toc_title"), text("o_orderstatus").alias("l0"), null.alias("l1"), dotted("o_orderdate").alias("enact_date"),
        "pdf_pages", F.array(dotted("o_orderdate")).alias("amend_dates"), articles.alias("articles"), lines_of("R").alias("addenda"), attachments.alias("attachments"),
    )


@query
def bulk_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested records as flat tables: the articles with their regulation's page span."""
    b = dml.load_records(_records(spark, sf_dir))
    regs = b.regulations.select(F.col("id").alias("regulation_id"), F.col("title").alias("regulation_title"), "source_pages")
    return b.articles.join(regs, "regulation_id").select("regulation_id", "regulation_title", "source_pages", "ordinal", "chapter", "no", "sub_no", "title", "body")


@query
def detail_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loaded records read back with all four child lists."""
    b = dml.load_records(_records(spark, sf_dir))
    b = b._replace(attachments=b.attachments.select("regulation_id", "label", F.lit(None).cast("int").alias("start_page"), F.lit(None).cast("int").alias("end_page"), "lines", F.lit(None).cast("array<string>").alias("rows"), F.lit(None).cast("string").alias("file_url"), "ordinal"))
    joined = lambda c, f: F.array_join(F.transform(c, lambda x: x[f]), ",").alias(c)
    return catalog.details(b).select("id", joined("amendments", "amend_date"), joined("articles", "body"), joined("addenda", "line"), joined("attachments", "label"))


@query
def snapshot_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quarters as snapshots: each order is a record of its customer's regulation, and
    titles differ from the book's in what normalisation removes. Half of the titles stand
    twice in the book, where the later one counts; the book itself is the last version."""
    orders, lines, customer = (table(spark, sf_dir, t) for t in ("orders", "lineitem", "customer"))
    article = F.struct("l_linenumber", F.col("l_quantity").cast("int").alias("q"), F.col("l_returnflag").alias("f"))
    of = lines.where("l_returnflag <> 'A'").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(article)).alias("a"))
    arts = F.transform(F.coalesce("a", F.array()), lambda x: F.struct((x["l_linenumber"] % 3).cast("string").alias("no"), F.lit("").alias("sub_no"), F.concat(x["q"].cast("string"), x["f"]).alias("body")))
    records = orders.join(of, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    records = records.select("o_custkey", F.date_format(F.trunc("o_orderdate", "quarter"), "yyyy.MM.dd").alias("date"), "o_orderkey", F.concat(F.lit("Customer ("), "o_custkey", F.lit(")")).alias("title"), arts.alias("articles"))
    record = F.struct("o_orderkey", "title", F.size("articles").alias("article_count"), "articles")
    snapshots = records.groupBy("o_custkey", "date").agg(F.array_sort(F.collect_list(record)).alias("regulations")).drop("o_custkey")
    book_title = F.concat(F.lit("Customer "), "c_custkey").alias("title")
    regs = customer.select(F.col("c_custkey").alias("id"), book_title)
    regs = regs.unionByName(customer.where("c_custkey % 2 = 0").select((F.col("c_custkey") + 1_000_000_000).alias("id"), book_title))
    live = regs.select(F.col("id").alias("regulation_id"), F.lit(0).alias("no"), F.lit(None).cast("int").alias("sub_no"), F.lit("now").alias("body"))
    return history.snapshot_versions(snapshots, regs, live).select("regulation_id", "date", "no", "sub_no", "body", "live")


@query
def page_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A customer's orders as pages; urgent ones begin an entry, the last of which ends
    ten thousand pages after order 0."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc"), F.col("o_orderkey").cast("long").alias("page"), "o_orderpriority")
    starts = orders.where("o_orderpriority = '1-URGENT'").select("doc", F.col("page").alias("start"))
    return segment.assign_pages(orders.drop("o_orderpriority"), segment.page_ranges(starts, "doc", "start", F.lit(10_000).cast("long")), "doc")


@query
def trigram_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar.trigram_index(table(spark, sf_dir, "benchmark"), "item_id")


@query
def status_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reconcile.status_counts(committee_crosscheck(spark, sf_dir))


QUERIES |= extraction.QUERIES
