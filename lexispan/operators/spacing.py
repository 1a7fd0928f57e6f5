"""Repair of word spacing from corpus statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HANGUL = "가-힣"
MIN_JOINED = 15
MIN_RATIO = 0.9
# First characters and pairs that are never evidence for joining.
PARTICLES = "이가을를은는의에와과도만며고지자나다라요께아어서로"
MODIFIERS = "본동각전총매신구현타그저"
BLOCKED = ("학교", "본교")


def joined_pairs(df: DataFrame, text_col: str = "text", letters: str = HANGUL) -> DataFrame:
    """``pair, joined``: how often two characters stand side by side inside a run."""
    runs = df.select(F.explode(F.regexp_extract_all(text_col, F.lit(f"[{letters}]+"), F.lit(0))).alias("r"))
    # runs are counted first: pairs are made once for each distinct run
    runs = runs.where(F.length("r") >= 2).groupBy("r").agg(F.count(F.lit(1)).alias("n"))
    pairs = runs.select(F.explode(F.transform(F.sequence(F.lit(1), F.length("r") - 1), lambda i: F.substring(F.col("r"), i, F.lit(2)))).alias("pair"), "n")
    return pairs.groupBy("pair").agg(F.sum("n").alias("joined"))


def split_pairs(df: DataFrame, text_col: str = "text", letters: str = HANGUL) -> DataFrame:
    """``pair, split``: last and first character around the space of two runs."""
    gaps = df.select(F.explode(F.regexp_extract_all(text_col, F.lit(f"[{letters}]+ [{letters}]+"), F.lit(0))).alias("m"))
    return gaps.groupBy(_junction(F.col("m")).alias("pair")).agg(F.count(F.lit(1)).alias("split"))


def _junction(m: F.Column) -> F.Column:
    parts = F.split(m, " ")
    return F.concat(F.right(parts[0], F.lit(1)), F.left(parts[1], F.lit(1)))


def candidates(joined: DataFrame, split: DataFrame, min_joined: int = MIN_JOINED, min_ratio: float = MIN_RATIO, never_first: str = PARTICLES + MODIFIERS, blocked: tuple[str, ...] = BLOCKED) -> DataFrame:
    """Pairs that stand joined often enough, and mostly joined, to close their gaps."""
    rows = split.join(joined, "pair", "left").withColumn("joined", F.coalesce("joined", F.lit(0)))
    rows = rows.where(F.col("joined") >= min_joined).where(F.col("joined") / (F.col("joined") + F.col("split")) >= min_ratio)
    if never_first:
        rows = rows.where(~F.left("pair", F.lit(1)).isin(*never_first))
    if blocked:
        rows = rows.where(~F.col("pair").isin(*blocked))
    return rows


def close_gaps(df: DataFrame, pairs: DataFrame, text_col: str = "text", letters: str = HANGUL, rounds: int = 4) -> DataFrame:
    """Close the gap of every non-overlapping ``run run`` whose junction is a
    candidate, up to ``rounds`` times (a gap skipped by an overlap is met again).

    What a text may close depends on the text alone: the junctions of the distinct texts
    are joined to the candidates once and come back as one set a text, and the rounds run
    inside the row. Rows need no key; rows that are equal, null texts and other columns
    stay as they are.
    """
    text = F.col(text_col)
    # a lookahead finds the gaps of "a b c" that overlap as well
    gaps = F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(f"(?=([{letters}] [{letters}]))"), F.lit(1)), lambda g: F.replace(g, F.lit(" "), F.lit(""))))
    rows = df.withColumn("_text", F.sha2(text, 256))
    found = rows.select("_text", F.explode(gaps).alias("pair")).distinct().join(pairs.select("pair").distinct(), "pair")
    closing = found.groupBy("_text").agg(F.collect_set("pair").alias("_close"))
    pattern = F.lit(f"[{letters}]+ [{letters}]+")

    def once(t: F.Column) -> F.Column:
        fixed = F.transform(F.regexp_extract_all(t, pattern, F.lit(0)), lambda m: F.when(F.array_contains("_close", _junction(m)), F.replace(m, F.lit(" "), F.lit(""))).otherwise(m))
        return F.array_join(F.zip_with(F.split(t, pattern, -1), fixed, lambda between, m: F.concat(between, F.coalesce(m, F.lit("")))), "")

    closed = F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), text, lambda t, _: once(t))
    out = rows.join(closing, "_text", "left").withColumn(text_col, F.when(F.col("_close").isNotNull(), closed).otherwise(text))
    return out.drop("_text", "_close").select(*[F.col(f"`{c}`") for c in df.columns])


def repair(df: DataFrame, text_col: str = "text", letters: str = HANGUL, **settings) -> DataFrame:
    """Statistics over all texts, then the repair of every text."""
    found = candidates(joined_pairs(df, text_col, letters), split_pairs(df, text_col, letters), **settings)
    return close_gaps(df, found, text_col, letters)


def correction_counts(before: DataFrame, after: DataFrame, key: str, pairs: DataFrame, text_col: str = "text", letters: str = HANGUL) -> DataFrame:
    """``pair, n``: how often each candidate's gap was closed, from the texts before and
    after the repair, with ``key`` unique in both."""
    gaps = lambda df, n: df.select(key, F.explode(F.regexp_extract_all(text_col, F.lit(f"(?=([{letters}] [{letters}]))"), F.lit(1))).alias("g")).groupBy("g").agg(F.count(F.lit(1)).alias(n))
    both = gaps(before, "had").join(gaps(after, "has"), "g", "left")
    counts = both.select(F.replace("g", F.lit(" "), F.lit("")).alias("pair"), (F.col("had") - F.coalesce("has", F.lit(0))).alias("n"))
    return counts.join(pairs.select("pair"), "pair").where("n > 0")
