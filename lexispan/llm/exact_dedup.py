"""Exact deduplication with two Bloom passes; DataFrame functions only.

Pass 1 digests every whole text and counts, for each of ``HASHES`` independent
positions of a digest, how many rows hit the position: positions that were hit at
least twice form a bitmap of ``BITS_PER_ROW`` bits a row. Pass 2 probes the bitmap: a
row all of whose positions were hit twice is *possibly repeated*, and only those rows
shuffle by digest; all other rows are certainly unique and pass straight through.

A bitmap is kept as rows of ``_CHUNK`` bits. Up to ``MAX_BITS`` (64 MiB) it is broadcast;
a larger one is joined to the narrow digests by chunk, all of it in one pass. Whole rows
(:func:`exact_dedup`) never meet that join: they probe a bitmap of the digests that do
repeat, broadcast up to 33.5 million such digests. Beyond, rows are written once into one
folder a slice of the digests, without a shuffle, and each slice probes its own bitmap.
"""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from lexispan.llm.common import checkpointed

BITS_PER_ROW = 16
MAX_BITS = 1 << 29
HASHES = 2
HOT_GROUPS = 1000
_CHUNK = 32768  # bits of one bitmap row (bitmap_construct_agg's fixed size)


def normalised(text: Column) -> Column:
    """The text without space and U+0009 to U+000D; null counts as empty."""
    out = F.coalesce(text, F.lit(""))
    for code in (0x20, 0x0A, 0x09, 0x0D, 0x0B, 0x0C):
        out = F.replace(out, F.lit(chr(code)), F.lit(""))
    return out


def digest(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One narrow row a text: id, SHA-256 of the normalised text, code points."""
    return df.select(
        F.col(id_col).alias("doc_id"),
        F.sha2(normalised(F.col(text_col)), 256).alias("text_sha256"),
        F.coalesce(F.length(F.col(text_col)), F.lit(0)).cast("long").alias("n_points"),
    )


def _part(sha: Column, k: int) -> Column:
    """The k-th of the independent 60-bit numbers in a digest."""
    return F.conv(F.substring(sha, 1 + 15 * k, 15), 16, 10).cast("long")


def _bits(n: int) -> int:
    return max(_CHUNK, -(-n * BITS_PER_ROW // _CHUNK) * _CHUNK)


def _positions(sha: Column, bits: int) -> list[Column]:
    """Independent bit positions, from separate parts of the digest."""
    return [F.pmod(_part(sha, k), F.lit(bits)) for k in range(HASHES)]


def _chunk(position: Column) -> Column:
    return F.floor(position / _CHUNK).cast("long")


def _hits(digests: DataFrame, bits: int) -> DataFrame:
    """One row ``p`` a position that a digest hits."""
    return digests.select(F.explode(F.array(*_positions(F.col("text_sha256"), bits))).alias("p"))


def _bitmap(positions: DataFrame, *keys: str) -> DataFrame:
    """Rows ``keys, chunk, bitmap`` with the bits ``p`` set."""
    bit = F.bitmap_bit_position(F.pmod(F.col("p"), F.lit(_CHUNK)) + 1)
    return positions.groupBy(*keys, _chunk(F.col("p")).alias("chunk")).agg(F.bitmap_construct_agg(bit).alias("bitmap"))


def repeat_filter(digests: DataFrame, rows: int) -> tuple[DataFrame, int]:
    """Pass 1: (bitmap rows ``chunk, bitmap`` of positions hit twice or more, bits)."""
    bits = _bits(rows)
    return _bitmap(_hits(digests, bits).groupBy("p").count().where("count >= 2")), bits


def _probe(df: DataFrame, bitmap: DataFrame, bits: int) -> DataFrame:
    """Pass 2: adds ``maybe_repeated``, reading one bit for each position."""
    where = _positions(F.col("text_sha256"), bits)
    lookup = F.broadcast(bitmap) if bits <= MAX_BITS else checkpointed(bitmap).hint("merge")
    hit = F.lit(True)
    for k, p in enumerate(where):
        side = lookup.select(F.col("chunk").alias(f"_c{k}"), F.col("bitmap").alias(f"_b{k}"))
        df = df.withColumn(f"_p{k}", p)
        df = df.join(side, _chunk(F.col(f"_p{k}")) == F.col(f"_c{k}"), "left")
        at = F.pmod(F.col(f"_p{k}"), F.lit(_CHUNK)).cast("int")
        byte = F.conv(F.hex(F.substring(F.col(f"_b{k}"), (at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        bit = F.try_mod(F.floor(byte / F.pow(F.lit(2), F.pmod(at, F.lit(8)))), F.lit(2)) == 1
        # a chunk's bitmap is read where it is joined, so that no row carries it further
        df = df.withColumn(f"_h{k}", F.coalesce(bit, F.lit(False))).drop(f"_c{k}", f"_b{k}", f"_p{k}")
        hit = hit & F.col(f"_h{k}")
    return df.withColumn("maybe_repeated", hit).drop(*[f"_h{k}" for k in range(HASHES)])


def _probed_rows(row: DataFrame, repeated: DataFrame) -> DataFrame:
    """Rows (``row, text_sha256``) with ``maybe_repeated``: false only for digests that are
    not among the distinct ``repeated`` ones. No row shuffles, whatever the sizes."""
    n = repeated.count()
    slices = -(-_bits(n) // MAX_BITS)
    if slices == 1:
        bits = _bits(n)
        return _probe(row, _bitmap(_hits(repeated, bits)), bits)
    bits = -(-_bits(n) // slices // _CHUNK) * _CHUNK
    own = F.pmod(_part(F.col("text_sha256"), HASHES), F.lit(slices)).cast("int")
    hits = repeated.select(own.alias("slice"), F.explode(F.array(*_positions(F.col("text_sha256"), bits))).alias("p"))
    bitmaps = checkpointed(_bitmap(hits, "slice"))
    folder = f"{row.sparkSession.sparkContext.getCheckpointDir()}/slices-{uuid4().hex}"
    row.withColumn("slice", own).write.partitionBy("slice").parquet(folder)
    schema = StructType([*row.schema.fields, StructField("slice", IntegerType())])
    parts = row.sparkSession.read.schema(schema).parquet(folder)
    out = None
    for k in range(slices):
        mine = bitmaps.where(F.col("slice") == k).drop("slice")
        # written before the next slice's bitmap is sent: one bitmap is held at a time
        probed = checkpointed(_probe(parts.where(F.col("slice") == k).drop("slice"), mine, bits))
        out = probed if out is None else out.unionByName(probed)
    return out


def exact_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Of equal texts the row with the most code points in the original text stays,
    then the smallest id. Null texts equal empty ones. A null id is a row like any
    other; among equals it loses to a non-null id, and its group's ``kept`` is true
    only if no other row is preferred. Rows that repeat an id with the same text
    all name that id, and all of them count as kept by this report; use
    :func:`exact_dedup` to keep one row. Extra columns are ignored here. An empty
    table gives an empty result.
    """
    digests = checkpointed(digest(df, id_col, text_col))
    rows = digests.count()
    probed = _probe(digests, *repeat_filter(digests, rows))
    alone = probed.where(~F.col("maybe_repeated")).select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256"
    )
    maybe = probed.where("maybe_repeated").select("doc_id", "text_sha256", "n_points")
    # min keeps the longest original; of equally long ones the smallest id (a null id sorts last)
    best = F.min(F.struct((-F.col("n_points")).alias("n"), F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"))).alias("best")
    groups = maybe.groupBy("text_sha256").agg(F.count(F.lit(1)).alias("group_size"), best)
    groups = groups.select("text_sha256", "group_size", F.col("best.id").alias("keep_id"))
    groups = checkpointed(groups)
    # fewer than HOT_GROUPS groups can hold a HOT_GROUPS-th of all rows: those few are
    # broadcast, so no digest's rows meet in one task; the others shuffle
    hot = F.col("group_size") > rows / HOT_GROUPS
    met = maybe.join(F.broadcast(groups.where(hot)), "text_sha256", "left")
    columns = ["doc_id", "text_sha256", "group_size", "keep_id"]
    rest = met.where("group_size IS NULL").select("doc_id", "text_sha256").join(groups.where(~hot).hint("merge"), "text_sha256")
    joined = met.where("group_size IS NOT NULL").select(*columns).unionByName(rest.select(*columns))
    grouped = joined.select("doc_id", "keep_id", F.col("group_size").cast("long"), F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")
    return alone.unionByName(grouped)


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The input without repeated texts, all columns kept.

    The two passes find the digests that repeat. Rows that a bitmap of those proves
    unique never shuffle; the others meet by digest. One row stays of each group: the
    longest original, then the smallest id; of rows that agree in all three any one.
    Null texts equal empty ones, a null id loses to any other, column names may clash
    with any used here, and an empty table gives an empty result.
    """
    digests = checkpointed(digest(df, id_col, text_col).select("text_sha256"))
    maybe = _probe(digests, *repeat_filter(digests, digests.count())).where("maybe_repeated")
    repeated = checkpointed(maybe.groupBy("text_sha256").count().where("count > 1").select("text_sha256"))
    # the row travels as one struct of numbered fields, so its column names can't clash
    names = {c: f"c{k}" for k, c in enumerate(df.columns)}
    row = df.select(F.struct(*[F.col(f"`{c}`").alias(n) for c, n in names.items()]).alias("row"))
    text, key = F.col(f"row.{names[text_col]}"), F.col(f"row.{names[id_col]}")
    probed = _probed_rows(row.withColumn("text_sha256", F.sha2(normalised(text), 256)), repeated)
    through = probed.where(~F.col("maybe_repeated")).select("row")
    again = probed.where("maybe_repeated")
    rank = F.struct((-F.coalesce(F.length(text), F.lit(0))).alias("n"), key.isNull().alias("none"), key.alias("id"))
    # partial aggregation keeps one row of each digest in every task before the shuffle
    best = again.groupBy("text_sha256").agg(F.min_by("row", rank).alias("row"))
    return through.unionByName(best.select("row")).select(*[F.col(f"row.{n}").alias(c) for c, n in names.items()])
