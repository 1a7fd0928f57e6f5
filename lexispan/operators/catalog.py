"""Read queries of the rule-book catalog: lists, searches, details and the tree."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexispan.functions import text as T


class Book(NamedTuple):
    """The tables of a rule book; see ``lexispan.schemas``."""

    regulations: DataFrame
    amendments: DataFrame | None = None
    articles: DataFrame | None = None
    addenda: DataFrame | None = None
    attachments: DataFrame | None = None
    revisions: DataFrame | None = None
    revision_changes: DataFrame | None = None


def _chosen(**equal: str | None) -> Column:
    """Conjunction of the equality filters that were given."""
    out = F.lit(True)
    for name, value in equal.items():
        if value:
            out = out & (F.col(name) == value)
    return out


def paged(df: DataFrame, order: list[Column], page: int = 1, page_size: int = 20) -> DataFrame:
    """One page; out-of-range pages are clamped to the first, a negative size means all."""
    df = df.orderBy(*order).offset(max(0, (page - 1) * page_size))
    return df if page_size < 0 else df.limit(page_size)


def total(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("total"))


def total_pages(n: Column, page_size: int) -> Column:
    return F.greatest(F.lit(1), F.ceil(n / page_size))


def latest_amendments(amendments: DataFrame) -> DataFrame:
    return amendments.groupBy("regulation_id").agg(F.max("amend_date").alias("latest_amend"))


def list_titles(book: Book, category_l0: str | None = None, category_l1: str | None = None, q: str | None = None) -> DataFrame:
    """Regulations in force whose title matches, with their latest amendment."""
    regs = book.regulations.where(F.col("status") == T.IN_FORCE).where(_chosen(category_l0=category_l0, category_l1=category_l1))
    if q and q.strip():
        regs = regs.where(T.like_ascii(F.col("title"), q))
    latest = latest_amendments(book.amendments).withColumnRenamed("regulation_id", "id")
    return regs.join(latest, "id", "left").select("id", "seq", "title", "category_l0", "category_l1", "enact_date", "latest_amend")


def list_bodies(book: Book, q: str, category_l0: str | None = None, category_l1: str | None = None) -> DataFrame:
    """Articles whose body matches, each with its label and a snippet."""
    regs = book.regulations.where(F.col("status") == T.IN_FORCE).where(_chosen(category_l0=category_l0, category_l1=category_l1))
    regs = regs.select(F.col("id").alias("regulation_id"), F.col("title").alias("regulation_title"), "category_l0", "category_l1", "seq")
    arts = book.articles.where(T.like_ascii(F.col("body"), q))
    out = arts.join(regs, "regulation_id")
    label = T.article_label(F.col("no"), F.col("sub_no"), F.col("title"))
    return out.select(
        "regulation_id", "regulation_title", "category_l0", "category_l1", F.col("no").alias("article_no"), F.col("sub_no").alias("article_sub_no"),
        label.alias("article_label"), T.snippet(F.col("body"), q).alias("snippet"), "seq", "ordinal",
    )


_SORTS = {
    "seq": lambda: [F.col("seq"), F.col("id")],
    "abc": lambda: [F.col("title"), F.col("id")],
    "date": lambda: [F.col("latest_amend").desc(), F.col("id")],
}


def list_regulations(book: Book, category_l0: str | None = None, category_l1: str | None = None, q: str | None = None, scope: str = "title", sort: str = "seq", page: int = 1, page_size: int = 20) -> tuple[DataFrame, DataFrame]:
    """(one page, total). Ties are broken by id."""
    if scope not in ("title", "body"):
        raise ValueError("scope is title or body")
    if sort not in _SORTS:
        raise ValueError("sort is seq, abc or date")
    if q and scope == "body":
        rows = list_bodies(book, q, category_l0, category_l1)
        return paged(rows, [F.col("seq"), F.col("ordinal"), F.col("regulation_id")], page, page_size).drop("seq", "ordinal"), total(rows)
    rows = list_titles(book, category_l0, category_l1, q)
    return paged(rows, _SORTS[sort](), page, page_size), total(rows)


def recent(book: Book, limit: int = 10) -> DataFrame:
    """The regulations amended last; those never amended don't appear."""
    regs = book.regulations.where(F.col("status") == T.IN_FORCE).select("id", "title")
    latest = latest_amendments(book.amendments).withColumnRenamed("regulation_id", "id")
    return regs.join(latest, "id").orderBy(F.col("latest_amend").desc(), "id").limit(limit)


def attachments(book: Book, q: str | None = None) -> DataFrame:
    """Attachments whose label or regulation title matches, in force or not."""
    regs = book.regulations.select(F.col("id").alias("regulation_id"), F.col("title").alias("regulation_title"), "seq")
    out = book.attachments.join(regs, "regulation_id")
    if q:
        out = out.where(T.like_ascii(F.col("regulation_title"), q) | T.like_ascii(F.col("label"), q))
    has_table = F.when(F.col("rows").isNotNull(), 1).otherwise(0)
    return out.select("regulation_id", "regulation_title", "ordinal", "label", "start_page", "end_page", "file_url", has_table.alias("has_table"), "seq")


def revisions(book: Book, q: str | None = None, date_from: str | None = None, date_to: str | None = None) -> DataFrame:
    """Revisions in an inclusive range of text dates, with their number of changes."""
    out = book.revisions
    if date_from:
        out = out.where(F.col("revised_at") >= date_from.replace("-", "."))
    if date_to:
        out = out.where(F.col("revised_at") <= date_to.replace("-", "."))
    regs = book.regulations.select(F.col("id").alias("regulation_id"), F.col("title").alias("regulation_title"))
    if q:
        regs = regs.where(T.like_ascii(F.col("regulation_title"), q))
    counts = book.revision_changes.groupBy(F.col("revision_id").alias("id")).agg(F.count(F.lit(1)).alias("changed_count"))
    out = out.join(regs, "regulation_id").join(counts, "id", "left")
    return out.select("id", "regulation_id", "regulation_title", "revised_at", "summary", F.coalesce("changed_count", F.lit(0)).alias("changed_count"), "created_at")


def revisions_order() -> list[Column]:
    return [F.col("revised_at").desc(), F.col("created_at").desc(), F.col("id")]


def revisions_by_date(book: Book) -> DataFrame:
    """One row for each regulation and date: the last revision of that date."""
    last = F.max_by(F.struct("id", "summary"), "id").alias("last")
    out = book.revisions.groupBy("regulation_id", "revised_at").agg(last)
    return out.select("regulation_id", "revised_at", F.col("last.id").alias("id"), F.col("last.summary").alias("summary"))


def _children(df: DataFrame, key: str, columns: list[str], name: str) -> DataFrame:
    """One row a parent: its children as an array in ordinal order."""
    rows = F.array_sort(F.collect_list(F.struct("ordinal", *columns)))
    return df.groupBy(key).agg(F.transform(rows, lambda x: F.struct(*[x[c].alias(c) for c in columns])).alias(name))


def details(book: Book, regulation_id: int | None = None) -> DataFrame:
    """Regulations with their ordered amendments, articles, addenda and attachments;
    children are grouped before they are joined, so no join multiplies rows."""
    out = book.regulations
    if regulation_id is not None:
        out = out.where(F.col("id") == regulation_id)
    parts = {
        "amendments": (book.amendments, ["amend_date"]),
        "articles": (book.articles, ["chapter", "section", "gwan", "no", "sub_no", "title", "body"]),
        "addenda": (book.addenda, ["line"]),
        "attachments": (book.attachments, ["label", "start_page", "end_page", "lines", "rows", "file_url"]),
    }
    for name, (df, columns) in parts.items():
        if df is not None:
            if regulation_id is not None:
                df = df.where(F.col("regulation_id") == regulation_id)
            grouped = _children(df, "regulation_id", columns, name).withColumnRenamed("regulation_id", "id")
            out = out.join(grouped, "id", "left").withColumn(name, F.coalesce(name, F.array()))
    return out


def detail(book: Book, regulation_id: int) -> DataFrame:
    """As :func:`details`, for one regulation; an unknown id is an error."""
    out = details(book, regulation_id)
    if out.isEmpty():
        raise LookupError(f"no regulation {regulation_id}")
    return out


def revision_detail(book: Book, revision_id: int) -> DataFrame:
    rev = book.revisions.where(F.col("id") == revision_id)
    if rev.isEmpty():
        raise LookupError(f"no revision {revision_id}")
    changes = book.revision_changes.where(F.col("revision_id") == revision_id)
    grouped = _children(changes, "revision_id", ["article_no", "article_sub_no", "article_title", "old_body", "new_body"], "changes")
    return rev.join(grouped.withColumnRenamed("revision_id", "id"), "id", "left").withColumn("changes", F.coalesce("changes", F.array()))


def joined_bodies(articles: DataFrame) -> DataFrame:
    """All bodies of a regulation as one text, in order."""
    rows = F.array_sort(F.collect_list(F.struct("ordinal", "body")))
    return articles.groupBy("regulation_id").agg(F.array_join(F.transform(rows, lambda x: x["body"]), " ").alias("body"))


def tree(book: Book, order: list[str] | None = None) -> DataFrame:
    """Rows of the two-level category tree, ready to nest: ``l0_rank`` orders the top
    categories (listed ones first, others as first seen), ``l1_rank`` the second
    level (regulations without one come first), ``seq`` the leaves."""
    order = order or ["정관", "학사", "대학원", "일반행정", "부속기관 및 부설기관", "산학협력단"]
    regs = book.regulations.where(F.col("status") == T.IN_FORCE)
    l0 = F.coalesce(F.nullif(F.col("category_l0"), F.lit("")), F.lit(T.NO_CATEGORY))
    l1 = F.coalesce(F.nullif(F.col("category_l1"), F.lit("")), F.lit(T.DIRECT))
    regs = regs.select("id", "seq", "title", l0.alias("l0"), l1.alias("l1"))
    # categories are few: ranks come from one small aggregate, not from a global window
    groups = regs.groupBy("l0", "l1").agg(F.min("seq").alias("first"))
    tops = groups.groupBy("l0").agg(F.min("first").alias("top_first"))
    place = F.array_position(F.array(*[F.lit(x) for x in order]), F.col("l0"))
    known = F.when(place > 0, place).otherwise(len(order) + 1)
    tops = tops.select("l0", F.row_number().over(Window.orderBy(known, "top_first", "l0")).alias("l0_rank"))
    by = Window.partitionBy("l0").orderBy((F.col("l1") != T.DIRECT), "first", "l1")
    groups = groups.select("l0", "l1", F.row_number().over(by).alias("l1_rank"))
    out = regs.join(groups.join(tops, "l0"), ["l0", "l1"])
    return out.select("l0_rank", "l0", "l1_rank", "l1", "seq", "id", "title")


def nested_tree(book: Book, order: list[str] | None = None) -> DataFrame:
    """The tree as one row a top category with an ordered array of its groups."""
    rows = tree(book, order)
    leaves = rows.groupBy("l0_rank", "l0", "l1_rank", "l1").agg(F.array_sort(F.collect_list(F.struct("seq", "id", "title"))).alias("children"))
    return leaves.groupBy("l0_rank", "l0").agg(F.array_sort(F.collect_list(F.struct("l1_rank", F.col("l1").alias("name"), "children"))).alias("groups")).orderBy("l0_rank")


def title_filter(df: DataFrame, q: str | None) -> DataFrame:
    """The editor's filter: lower-case contains; an empty query keeps all."""
    return df.where(F.contains(F.lower("title"), F.lit(q.strip().lower()))) if q and q.strip() else df


def amendment_links(book: Book) -> DataFrame:
    """Amendment dates with the revision that documents each, if there is one."""
    revs = revisions_by_date(book).select("regulation_id", F.col("revised_at").alias("amend_date"), F.col("id").alias("revision_id"))
    out = book.amendments.join(revs, ["regulation_id", "amend_date"], "left")
    return out.withColumn("has_revision", F.col("revision_id").isNotNull())
