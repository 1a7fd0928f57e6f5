"""Reconciliation of revision history with an external committee archive."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexispan.functions import text as T
from lexispan.session import checkpointed

# Words of old/new comparison tables.
OLD_HEADERS = ("현행규정", "현행학칙", "현 행")
NEW_HEADERS = ("개 정 (안)", "개정(안)", "개정학칙", "개정 (안)")
ADDED = ("(신설)", "신설")
REMOVED = ("삭제", "(삭제)")
ARTICLE_ANYWHERE = r"제\s*(\d+)\s*조(?:\s*의\s*(\d+))?(?:\s*\(([^)]*)\))?"
NOT_A_STAGE = r"^(홈페이지|규정집|새 폴더)"
BLOCK_HEADER = r"^#{0,6}\s*\*{0,2}[□◉]\s*(.+?)\*{0,2}\s*$"
COMPARISON_TITLE = r"^\*{0,2}신\s*[·ㆍ]?\s*구\s*조문\s*대비표\*{0,2}$"


def stage_rank(name: Column) -> Column:
    """Sort key struct(major, minor) of a stage folder: numbered ones first; null for
    folders that hold published output."""
    got = lambda n: F.nullif(F.regexp_extract(name, r"^(\d+)(?:[-.](\d+))?", n), F.lit("")).cast("int")
    rank = F.struct(F.coalesce(got(1), F.lit(9999)).alias("major"), F.coalesce(got(2), F.lit(0)).alias("minor"))
    return F.when(~T.matches(name, NOT_A_STAGE), rank)


def last_stage(records: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Last writer wins: the record of the highest stage, file and block."""
    others = [c for c in records.columns if c not in keys]
    out = records.groupBy(*keys).agg(F.max_by(F.struct(*others), F.struct(*order)).alias("r"))
    return out.select(*keys, "r.*")


def unique_match(left: DataFrame, right: DataFrame, left_key: Column, right_key: Column, id_col: str, listed: bool = True) -> DataFrame:
    """Match only where exactly one right row has the key: adds ``match_id`` and
    ``match_status`` (``MATCHED``, ``AMBIGUOUS: ids`` or ``NO MATCH``). Without ``listed``
    ambiguous rows don't name the ids, and only a count and one id a key are joined: a key
    that very many rows share on both sides would write its ids into each of them."""
    grouped = right.groupBy(right_key.alias("_key"))
    if listed:
        ids = grouped.agg(F.array_sort(F.collect_list(id_col)).alias("_ids"))
        n, one, named = F.coalesce(F.size("_ids"), F.lit(0)), F.get("_ids", F.lit(0)), F.array_join(F.col("_ids").cast("array<string>"), ",")
        status = F.concat(F.lit("AMBIGUOUS: "), named)
    else:
        ids = grouped.agg(F.count(id_col).alias("_n"), F.min(id_col).alias("_ids"))
        n, one, status = F.coalesce("_n", F.lit(0)), F.col("_ids"), F.lit("AMBIGUOUS")
    out = left.withColumn("_key", left_key).join(ids, "_key", "left")
    status = F.when(n == 1, "MATCHED").when(n > 1, status).otherwise("NO MATCH")
    return out.withColumn("match_status", status).withColumn("match_id", F.when(n == 1, one)).drop("_key", "_ids", "_n")


def comparison_changes(records: DataFrame, content_col: str = "content") -> DataFrame:
    """Rows of pipe tables -> article changes; keeps the record's other columns and
    adds ``line_no`` and the change's fields. Dividers, header rows, rows with both
    sides empty and rows without an article number are dropped."""
    keep = [c for c in records.columns if c != content_col]
    rows = records.select(*keep, F.posexplode(F.split(content_col, "\n")).alias("line_no", "_l"))
    line = T.strip(F.col("_l"))
    rows = rows.where(line.startswith("|") & ~line.rlike(r"^\|?\s*:?-{2,}"))
    rows = rows.withColumn("_c", T.split_row(line)).where("size(_c) >= 2")
    rows = rows.withColumn("_o", T.clean_cell(F.get("_c", F.lit(0)))).withColumn("_n", T.clean_cell(F.get("_c", F.lit(1))))
    rows = rows.where(~F.col("_o").isin(*OLD_HEADERS) & ~F.col("_n").isin(*NEW_HEADERS) & ((F.col("_o") != "") | (F.col("_n") != "")))
    old = F.when(~F.col("_o").isin(*ADDED), F.nullif("_o", F.lit("")))
    new = F.when(~F.col("_n").isin(*REMOVED), F.nullif("_n", F.lit("")))
    rows = rows.withColumn("old_body", old).withColumn("new_body", new)
    source = F.coalesce("new_body", "old_body")
    got = lambda n: T.group(source, ARTICLE_ANYWHERE, n)
    rows = rows.withColumn("article_no", got(1).cast("int")).where("article_no IS NOT NULL")
    return rows.select(*keep, "line_no", "article_no", got(2).cast("int").alias("article_sub_no"), F.nullif(T.strip(got(3)), F.lit("")).alias("article_title"), "old_body", "new_body")


def covered_by(events: DataFrame, hits: DataFrame, key: str, start: str, end: Column, hit_date: str, id_col: str) -> DataFrame:
    """Interval join: for each event the sorted ``hits`` of its key in [start, end] and
    its status ``covered`` or ``gap``. Hits are counted before the result is joined
    back, so events without any stay."""
    e = events.select(id_col, key, F.col(start).alias("_from"), end.alias("_to"))
    h = hits.select(F.col(key).alias("_key"), F.col(hit_date).alias("_at"))
    found = e.join(h, (F.col(key) == F.col("_key")) & F.col("_at").between(F.col("_from"), F.col("_to")))
    grouped = found.groupBy(id_col).agg(F.array_sort(F.collect_list("_at")).alias("hits"))
    out = events.join(grouped, id_col, "left")
    return out.withColumn("status", F.when(F.col("hits").isNotNull(), "covered").otherwise("gap"))


def next_edition(events: DataFrame, editions: DataFrame, at: str, edition: str, tolerance_days: int, key: str | None = None) -> DataFrame:
    """Forward as-of join: adds ``next``, the first edition on or after each event, null
    beyond the tolerance.

    What comes next depends on the time alone, so distinct times (of each key) are merged
    with the editions and looked ahead in, and the answers are joined back to the events.
    Without a key the times are dealt out in ranges; each range looks ahead in itself, and
    the first edition of the ranges after it (one row a range) is carried in.
    """
    keys = [key] if key else []
    times = events.select(*keys, F.col(at).alias("_t"), F.lit(None).cast(editions.schema[edition].dataType).alias("_e")).where("_t IS NOT NULL").distinct()
    rows = times.unionByName(editions.select(*keys, F.col(edition).alias("_t"), F.col(edition).alias("_e")).where("_t IS NOT NULL").distinct())
    if key:
        ahead = Window.partitionBy(key).orderBy("_t", F.col("_e").asc_nulls_first()).rowsBetween(0, Window.unboundedFollowing)
        found = rows.withColumn("next", F.first("_e", ignorenulls=True).over(ahead))
    else:
        # kept, so that ranges are the same wherever they are read
        rows = checkpointed(rows.repartitionByRange("_t").withColumn("_range", F.spark_partition_id()))
        ahead = Window.partitionBy("_range").orderBy("_t", F.col("_e").asc_nulls_first()).rowsBetween(0, Window.unboundedFollowing)
        later = Window.orderBy("_range").rowsBetween(1, Window.unboundedFollowing)
        firsts = rows.groupBy("_range").agg(F.min("_e").alias("_first"))  # at most spark.sql.shuffle.partitions rows
        carried = firsts.select("_range", F.min("_first").over(later).alias("_carried"))
        found = rows.join(F.broadcast(carried), "_range").withColumn("next", F.coalesce(F.first("_e", ignorenulls=True).over(ahead), "_carried"))
    found = found.where("_e IS NULL").select(*[F.col(k).alias(f"_{k}") for k in keys], "_t", "next")
    found = found.where(F.date_diff(F.col("next"), F.col("_t")) <= tolerance_days)
    same = F.col(at) == F.col("_t")
    for k in keys:
        same = same & events[k].eqNullSafe(F.col(f"_{k}"))
    return events.join(found, same, "left").drop("_t", *[f"_{k}" for k in keys])


def crosscheck(committee: DataFrame, regulations: DataFrame, revisions: DataFrame, months: int = 9, institution: str = "") -> DataFrame:
    """Committee records (``record_id, session_date, title``) against the revisions in
    the months after their meeting: unmatched, covered or gap."""
    regs = regulations.where(F.col("status") == T.IN_FORCE)
    out = unique_match(committee, regs, T.archive_key(F.col("title"), institution), T.archive_key(F.col("title"), institution), "id", listed=False)
    out = out.withColumnRenamed("match_id", "regulation_id").drop("match_status")
    dated = revisions.select("regulation_id", T.text_date(F.col("revised_at")).alias("at"))
    out = covered_by(out, dated, "regulation_id", "session_date", T.add_months_28(F.col("session_date"), months), "at", "record_id")
    return out.withColumn("status", F.when(F.col("regulation_id").isNull(), "unmatched").otherwise(F.col("status")))


def fill_gaps(checked: DataFrame, changes: DataFrame, editions: DataFrame, existing: DataFrame, summary: str, tolerance_days: int = 275) -> DataFrame:
    """Seed entries for gap records: dated at the next edition within the tolerance,
    with the changes that give both bodies in full; keys that exist, or that an
    earlier record of the batch adds, are left out."""
    from lexispan.operators.history import first_wins

    full = changes.where(T.full_text(F.col("old_body"), F.col("new_body")))
    fields = ["article_no", "article_sub_no", "article_title", "old_body", "new_body"]
    rows = F.array_sort(F.collect_list(F.struct("line_no", *fields)))
    numbered = F.transform(rows, lambda x, i: F.struct(*[x[f].alias(f) for f in fields], i.cast("int").alias("ordinal")))
    full = full.groupBy("record_id").agg(numbered.alias("changes"))
    gaps = checked.where("status = 'gap'").select("record_id", F.col("regulation_id").alias("regulation_seq"), "session_date")
    gaps = next_edition(gaps, editions.select("edition"), "session_date", "edition", tolerance_days)
    gaps = gaps.withColumnRenamed("next", "_e").where("_e IS NOT NULL")
    gaps = gaps.withColumn("revised_at", F.date_format("_e", "yyyy.MM.dd"))
    gaps = gaps.join(existing.select("regulation_seq", "revised_at"), ["regulation_seq", "revised_at"], "left_anti").join(full, "record_id")
    gaps = first_wins(gaps, ["regulation_seq", "revised_at"], ["session_date", "record_id"])
    return gaps.select("regulation_seq", "revised_at", F.lit(summary).alias("summary"), "changes")


def status_counts(df: DataFrame, column: str = "status") -> DataFrame:
    """How many rows have each status; null counts as one."""
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
