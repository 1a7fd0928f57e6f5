"""Updates as pure functions from tables to tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexispan.operators.catalog import Book
from lexispan.session import checkpointed


def insert_chronologically(rows: DataFrame, new: DataFrame, key: str, date: str) -> DataFrame:
    """Add rows whose (key, date) isn't there yet and renumber every touched key's
    ``ordinal``: a new row goes before the first existing one with a later date, else
    to the end; existing rows keep their order among themselves."""
    fresh = new.select(key, date).distinct().join(rows, [key, date], "left_anti")
    placed = fresh.alias("n").join(rows.select(key, F.col(date).alias("_d"), F.col("ordinal").alias("_o")), key, "left")
    later = F.min(F.when(F.col("_d") > F.col(date), F.col("_o")))
    placed = placed.groupBy(key, date).agg(F.coalesce(later - 0.5, F.lit(float("inf"))).alias("_at"))
    both = rows.withColumn("_at", F.col("ordinal").cast("double")).withColumn("_new", F.lit(0)).unionByName(placed.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    by = Window.partitionBy(key).orderBy("_at", "_new", date)
    return both.withColumn("ordinal", F.row_number().over(by) - 1).drop("_at", "_new")


def append(rows: DataFrame, new: DataFrame, key: str, date: str) -> DataFrame:
    """Add rows whose (key, date) isn't there yet after the key's last ordinal."""
    fresh = new.select(key, date).distinct().join(rows, [key, date], "left_anti")
    last = rows.groupBy(key).agg(F.max("ordinal").alias("_last"))
    at = F.row_number().over(Window.partitionBy(key).orderBy(date))
    fresh = fresh.join(last, key, "left").withColumn("ordinal", (F.coalesce("_last", F.lit(-1)) + at).cast("int")).drop("_last")
    return rows.unionByName(fresh, allowMissingColumns=True)


def merge(target: DataFrame, updates: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Update matching rows (non-null new values win) and append the others."""
    u = updates.select(*keys, *[F.col(c).alias(f"_u_{c}") for c in columns])
    out = target.join(u, keys, "left")
    for c in columns:
        out = out.withColumn(c, F.coalesce(f"_u_{c}", c)).drop(f"_u_{c}")
    new = updates.join(target, keys, "left_anti").select(*keys, *columns)
    return out.unionByName(new, allowMissingColumns=True)


def renumber(df: DataFrame, mapping: DataFrame, column: str, old: str = "old", new: str = "new") -> DataFrame:
    """Map a key to its new value where one is given."""
    m = mapping.select(F.col(old).alias("_old"), F.col(new).alias("_new"))
    return df.join(m, F.col(column) == F.col("_old"), "left").withColumn(column, F.coalesce("_new", column)).drop("_old", "_new")


def without_keys(df: DataFrame, column: str, dropped: list, most: int | None = None) -> DataFrame:
    """Rows whose key isn't in a list of obsolete ones (nor above a bound)."""
    out = df.where(~F.coalesce(F.col(column).isin(*dropped), F.lit(False))) if dropped else df
    return out if most is None else out.where(F.col(column) <= most)


def upsert_new(existing: DataFrame, incoming: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """Incoming rows whose key neither exists nor came earlier in the batch."""
    fresh = incoming.join(existing.select(*keys), keys, "left_anti")
    by = Window.partitionBy(*keys).orderBy(*order)
    return fresh.withColumn("_n", F.row_number().over(by)).where("_n = 1").drop("_n")


def save_revision(book: Book, regulation_id: int, revised_at: str, edits: DataFrame, summary: str | None = None, created_at: str | None = None, chronological: bool = False) -> tuple[Book, DataFrame]:
    """Apply edited bodies (``id, body``) to a regulation: (new tables, the changes).

    Unknown ids are ignored and equal bodies are no change. With changes, a revision
    and its ordered changes are added, bodies replaced and the amendment date added if
    it is new - at the end, or in its chronological place. Without, nothing changes.
    """
    revised_at = revised_at.replace("-", ".")
    mine = book.articles.where(F.col("regulation_id") == regulation_id)
    edited = edits.select("id", F.col("body").alias("new_body"))
    changed = mine.join(edited, "id").where(~F.col("body").eqNullSafe(F.col("new_body")))
    # the edits of one request are a bounded list typed by a person
    ordinal = F.row_number().over(Window.orderBy("ordinal", "id")) - 1
    revision_id = F.coalesce(F.max("id"), F.lit(0)) + 1
    head = book.revisions.agg(revision_id.cast("long").alias("revision_id"))
    changes = changed.crossJoin(F.broadcast(head)).select(
        "revision_id", F.col("no").alias("article_no"), F.col("sub_no").alias("article_sub_no"), F.col("title").alias("article_title"),
        F.col("body").alias("old_body"), "new_body", ordinal.cast("int").alias("ordinal"),
    )
    stamp = F.lit(created_at) if created_at else F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssXXX")
    revision = changes.select("revision_id").distinct().select(
        F.col("revision_id").alias("id"), F.lit(regulation_id).cast("long").alias("regulation_id"), F.lit(revised_at).alias("revised_at"),
        F.lit(summary).cast("string").alias("summary"), stamp.alias("created_at"),
    )
    bodies = book.articles.join(changed.select("id", "new_body"), "id", "left").withColumn("body", F.coalesce("new_body", "body")).drop("new_body")
    amended = revision.select("regulation_id", F.col("revised_at").alias("amend_date"))
    add = insert_chronologically if chronological else append
    amendments = add(book.amendments, amended, "regulation_id", "amend_date")
    new = book._replace(
        articles=bodies.select(*book.articles.columns),
        revisions=book.revisions.unionByName(revision, allowMissingColumns=True),
        revision_changes=book.revision_changes.unionByName(changes, allowMissingColumns=True),
        amendments=amendments,
    )
    return new, changes


def numbered(df: DataFrame, key: str, order: list[str], per_cell: int = 100_000) -> DataFrame:
    """Adds gapless ``number`` from 1: rows are numbered inside hash cells of their key and
    order, of about ``per_cell`` rows, and a running sum over the cells' counts (one row a
    cell) gives each cell's start, so no task sees all rows. The input is kept first, since
    it is read for the counts and for the rows."""
    df = checkpointed(df)
    cells = max(1, -(-df.count() // per_cell))
    df = df.withColumn("_cell", F.pmod(F.xxhash64(key, *order), F.lit(cells)).cast("int"))
    counts = df.groupBy("_cell").agg(F.count(F.lit(1)).alias("_n"))
    starts = counts.select("_cell", (F.sum("_n").over(Window.orderBy("_cell")) - F.col("_n")).alias("_start"))
    df = df.withColumn("_at", F.row_number().over(Window.partitionBy("_cell").orderBy(key, *order)))
    return df.join(starts, "_cell").withColumn("number", F.col("_start") + F.col("_at")).drop("_cell", "_at", "_start")


def seed_entries(book: Book) -> DataFrame:
    """Export: revisions with their regulation's number and ordered changes."""
    fields = ["article_no", "article_sub_no", "article_title", "old_body", "new_body", "ordinal"]
    rows = F.array_sort(F.collect_list(F.struct("ordinal", F.struct(*fields).alias("c"))))
    grouped = book.revision_changes.groupBy(F.col("revision_id").alias("id")).agg(F.transform(rows, lambda x: x["c"]).alias("changes"))
    regs = book.regulations.select(F.col("id").alias("regulation_id"), F.col("seq").alias("regulation_seq"))
    out = book.revisions.join(regs, "regulation_id").join(grouped, "id", "left")
    return out.select("regulation_seq", "revised_at", "summary", F.coalesce("changes", F.array()).alias("changes"))


def load_seed(book: Book, seed: DataFrame | None, created_at: str) -> Book:
    """Import seed entries that aren't there yet; loading twice changes nothing. No
    seed is no change; entries of unknown regulations are skipped."""
    if seed is None:
        return book
    regs = book.regulations.select(F.col("id").alias("regulation_id"), F.col("seq").alias("regulation_seq"))
    rows = seed.join(regs, "regulation_seq")
    fresh = upsert_new(book.revisions, rows, ["regulation_id", "revised_at"], ["summary"])
    last = book.revisions.agg(F.coalesce(F.max("id"), F.lit(0)).alias("_last"))
    fresh = numbered(fresh, "regulation_id", ["revised_at"]).crossJoin(F.broadcast(last))
    fresh = fresh.withColumn("id", (F.col("_last") + F.col("number")).cast("long"))
    revisions = fresh.select("id", "regulation_id", "revised_at", "summary", F.lit(created_at).alias("created_at"))
    changes = fresh.select(F.col("id").alias("revision_id"), F.explode("changes").alias("c")).select("revision_id", "c.*")
    dates = fresh.select("regulation_id", F.col("revised_at").alias("amend_date"))
    return book._replace(
        revisions=book.revisions.unionByName(revisions, allowMissingColumns=True),
        revision_changes=book.revision_changes.unionByName(changes, allowMissingColumns=True),
        amendments=insert_chronologically(book.amendments, dates, "regulation_id", "amend_date"),
    )


def load_records(records: DataFrame) -> Book:
    """Nested extraction records -> the flat tables; ids are the sequence numbers, articles
    are numbered from 1."""
    pages = F.array_join(F.when(F.size("pdf_pages") > 0, F.array(F.try_element_at("pdf_pages", F.lit(1)), F.try_element_at("pdf_pages", F.lit(-1)))), "-")
    one = F.col("seq")
    regulations = records.select(
        one.alias("id"), "seq", F.col("toc_title").alias("title"), F.col("l0").alias("category_l0"), F.col("l1").alias("category_l1"),
        F.lit(None).cast("string").alias("department"), "enact_date", F.lit("현행").alias("status"), pages.alias("source_pages"),
    )
    exploded = lambda c: records.select(one.alias("regulation_id"), F.posexplode(c).alias("ordinal", "x"))
    number = lambda c: F.nullif(c, F.lit("")).cast("int")
    articles = numbered(exploded("articles"), "regulation_id", ["ordinal"]).select(
        F.col("number").alias("id"), "regulation_id", "x.chapter", "x.section", "x.gwan", number(F.col("x.no")).alias("no"),
        number(F.col("x.sub_no")).alias("sub_no"), "x.title", "x.body", "ordinal",
    )
    return Book(
        regulations,
        exploded("amend_dates").select("regulation_id", F.col("x").alias("amend_date"), "ordinal"),
        articles,
        exploded("addenda").select("regulation_id", F.col("x").alias("line"), "ordinal"),
        exploded("attachments").select("regulation_id", "x.*", "ordinal"),
    )


def unmatched(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """Foreign-key check: child rows without a parent."""
    return child.join(parent.select(F.col(parent_key).alias("_k")), F.col(child_key) == F.col("_k"), "left_anti")
