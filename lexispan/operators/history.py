"""Revision history from dated snapshots: version diffs and their dates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexispan.functions import text as T


def first_wins(df: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    return _one(df, keys, order)


def last_wins(df: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    return _one(df, keys, [F.desc(c) if isinstance(c, str) else c.desc() for c in order])


def _one(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def override(df: DataFrame, column: str, table: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Replace a column where a small table names a value for the row's keys."""
    renamed = table.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col(value).alias("_value"))
    on = F.lit(True)
    for k in keys:
        on = on & df[k].eqNullSafe(F.col(f"_k_{k}"))
    out = df.join(renamed, on, "left")
    return out.withColumn(column, F.coalesce("_value", column)).drop("_value", *[f"_k_{k}" for k in keys])


def override_by_pattern(c: Column, patterns: list[tuple[str, str]]) -> Column:
    """The replacement of the first pattern that is found, else the value itself."""
    out = None
    for pattern, value in patterns:
        hit = T.matches(c, pattern)
        out = F.when(hit, value) if out is None else out.when(hit, value)
    return c if out is None else out.otherwise(c)


def excluded(df: DataFrame, table: DataFrame, keys: list[str], where: Column | None = None) -> DataFrame:
    """Drop rows whose keys (null-safe) stand in a table, if they meet a condition."""
    where = F.lit(True) if where is None else F.coalesce(where, F.lit(False))
    renamed = table.select(*[F.col(k).alias(f"_k_{k}") for k in keys])
    on = where
    for k in keys:
        on = on & df[k].eqNullSafe(F.col(f"_k_{k}"))
    return df.join(renamed, on, "left_anti")


def timeline(snapshots: DataFrame, regulations: DataFrame, title_overrides: list[tuple[str, str]] | None = None) -> DataFrame:
    """Nested snapshots (``date, regulations``) -> ``regulation_id, date, no, sub_no,
    body``, one row for each article version.

    Records without articles are skipped; titles are matched in normalised form (of
    regulations with the same normal form the last counts); of several records of a
    regulation in a snapshot the first counts, of several articles with one number the
    last.
    """
    regs = regulations.select(T.normalize_title(F.col("title")).alias("key"), F.col("id").alias("regulation_id"))
    regs = regs.groupBy("key").agg(F.max("regulation_id").alias("regulation_id"))
    rows = snapshots.select("date", F.posexplode("regulations").alias("at", "r")).where("r.article_count > 0")
    title = override_by_pattern(F.col("r.title"), title_overrides or [])
    rows = rows.withColumn("key", T.normalize_title(title)).join(regs, "key")
    rows = rows.groupBy("regulation_id", "date").agg(F.min_by("r.articles", "at").alias("articles"))
    arts = rows.select("regulation_id", "date", F.posexplode("articles").alias("at", "a"))
    number = lambda c: F.nullif(c, F.lit("")).cast("int")
    arts = arts.select("regulation_id", "date", number(F.col("a.no")).alias("no"), number(F.col("a.sub_no")).alias("sub_no"), "a.body", "at")
    return arts.groupBy("regulation_id", "date", "no", "sub_no").agg(F.max_by("body", "at").alias("body"))


def version_pairs(versions: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """Consecutive present versions of each key whose value differs: adds
    ``old_value``. Versions in which a key is absent are bridged, and neither the first
    nor a missing version is a change."""
    by = Window.partitionBy(*keys).orderBy(order)
    present = versions.where(F.col(value).isNotNull())
    return present.withColumn("old_value", F.lag(value).over(by)).where(F.col("old_value") != F.col(value))


def article_changes(versions: DataFrame, order: str = "date", titles: DataFrame | None = None, exclude: DataFrame | None = None, dates: DataFrame | None = None) -> DataFrame:
    """Change events of ``regulation_id, no, sub_no, date, body`` versions.

    Differences that are only layout noise don't count. A change is dated by the tag
    dates that the new body adds, else by its snapshot (``fallback``); a fallback
    change whose bodies name different topics is a renumbering and doesn't count.
    ``exclude`` lists reviewed artefacts (``regulation_id, observed_at, article_no,
    article_sub_no``), ``dates`` corrected dates (``regulation_id, revised_at,
    corrected``), ``titles`` the articles' present titles.
    """
    pairs = version_pairs(versions, ["regulation_id", "no", "sub_no"], order, "body")
    old, new = F.col("old_value"), F.col("body")
    pairs = pairs.where(T.noise_stripped(old) != T.noise_stripped(new))
    pairs = pairs.withColumn("_d", T.change_date(old, new, F.col("date")))
    pairs = pairs.where((F.col("_d.method") != "fallback") | ~T.titles_conflict(old, new))
    out = pairs.select(
        "regulation_id", F.col("_d.date").alias("revised_at"), F.col("no").alias("article_no"), F.nullif("sub_no", F.lit(0)).alias("article_sub_no"),
        old.alias("old_body"), new.alias("new_body"), F.col("_d.method").alias("method"), F.col("date").alias("observed_at"),
    )
    if exclude is not None:
        out = excluded(out, exclude, ["regulation_id", "observed_at", "article_no", "article_sub_no"], out["method"] == "fallback")
    if dates is not None:
        out = override(out, "revised_at", dates, ["regulation_id", "revised_at"], "corrected")
    if titles is not None:
        named = titles.select(F.col("regulation_id").alias("_r"), F.col("no").alias("_n"), F.col("sub_no").alias("_s"), F.col("title").alias("article_title"))
        on = (out["regulation_id"] == F.col("_r")) & (out["article_no"] == F.col("_n")) & out["article_sub_no"].eqNullSafe(F.nullif("_s", F.lit(0)))
        out = out.join(named, on, "left").drop("_r", "_n", "_s")
    return out


def snapshot_versions(snapshots: DataFrame, regulations: DataFrame, articles: DataFrame, title_overrides: list[tuple[str, str]] | None = None) -> DataFrame:
    """Article versions of all snapshots and, as the last one (``live`` = 1), the current
    articles of the regulations that a snapshot names. The current state is dated by the
    latest snapshot (by date, not by file name)."""
    past = timeline(snapshots, regulations, title_overrides)
    today = snapshots.agg(F.max("date").alias("date"))  # one row
    live = articles.select("regulation_id", "no", "sub_no", "body").crossJoin(F.broadcast(today))
    live = live.join(past.select("regulation_id").distinct(), "regulation_id", "left_semi")
    return past.withColumn("live", F.lit(0)).unionByName(live.withColumn("live", F.lit(1)))


def revision_history(snapshots: DataFrame, regulations: DataFrame, articles: DataFrame, title_overrides: list[tuple[str, str]] | None = None, exclude: DataFrame | None = None, dates: DataFrame | None = None) -> DataFrame:
    """Changes over all snapshots and, as the last version, the current articles."""
    versions = snapshot_versions(snapshots, regulations, articles, title_overrides)
    # a snapshot of the latest day precedes the current state
    versions = versions.withColumn("version", F.struct("date", "live"))
    return article_changes(versions, "version", articles, exclude, dates)


def revisions_from_changes(changes: DataFrame, summary: str) -> DataFrame:
    """Seed entries: one for each regulation and date with its ordered changes."""
    rows = F.array_sort(F.collect_list(F.struct("article_no", F.coalesce("article_sub_no", F.lit(0)).alias("sub"), "observed_at", "article_sub_no", "article_title", "old_body", "new_body")))
    fields = ["article_no", "article_sub_no", "article_title", "old_body", "new_body"]
    numbered = F.transform(rows, lambda x, i: F.struct(*[x[f].alias(f) for f in fields], i.cast("int").alias("ordinal")))
    out = changes.groupBy(F.col("regulation_id").alias("regulation_seq"), "revised_at").agg(numbered.alias("changes"))
    return out.select("regulation_seq", "revised_at", F.lit(summary).alias("summary"), "changes")
