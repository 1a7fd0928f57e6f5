"""Variable-capacity best-fit packing of documents into training sequences.

Several sequence lengths are permitted. Documents longer than the largest are cut
into whole pieces of that length plus a rest, so nothing is dropped. Pieces are
dealt into hash cells of bounded size and packed cell by cell, longest first:

* best fit: a piece goes into the open bin that it leaves fullest;
* where none has room, a new bin is opened. The sizes are chosen jointly for the cell:
  every opening policy packs the cell's own lengths, and the one whose downsized bins
  cost least is kept. A policy opens either the size whose cost for each token it can
  still be filled with is least, given what the cell has left to pack (ties: the
  smaller size), or the smallest size that holds the piece and is not below a floor
  (each permitted length is a floor once);
* at the end every bin is downsized to the smallest permitted length that holds
  its contents.

A sequence costs its length, a fixed overhead and ``length² / attention``, the work of
attention in tokens' worth: long sequences hold more pieces without a rest, short ones
cost less for each token, so the permitted sizes compete.
"""

from __future__ import annotations

import bisect

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexispan.llm.common import WORD, cells_for, checkpointed

CAPACITIES = (256, 512, 1024, 2048)
SEQUENCE_OVERHEAD = 32
ATTENTION_LENGTH = 12_288  # a sequence this long costs twice its tokens: six times a model width of 2,048
PIECES_PER_CELL = 50_000


def sequence_cost(length, overhead: int = SEQUENCE_OVERHEAD, attention: int = ATTENTION_LENGTH):
    """Cost of sequences of ``length`` (a number or an array), in tokens."""
    return overhead + length + length * length / attention


def best_packing(lengths: np.ndarray, capacities: tuple[int, ...] = CAPACITIES, overhead: int = SEQUENCE_OVERHEAD, attention: int = ATTENTION_LENGTH):
    """The cheapest of the packings that the opening policies give, as :func:`best_fit`
    returns it; of equally cheap ones the first (least cost a token, then larger floors)."""
    made = [best_fit(lengths, capacities, overhead, floor, attention) for floor in (None, *sorted(capacities, reverse=True))]
    return min(made, key=lambda p: float(sequence_cost(p[2], overhead, attention).sum()))


def best_fit(lengths: np.ndarray, capacities: tuple[int, ...] = CAPACITIES, overhead: int = SEQUENCE_OVERHEAD, floor: int | None = None, attention: int = ATTENTION_LENGTH):
    """(bin of each piece, offset in its bin, capacity of each bin after downsizing).

    ``lengths`` are packed in descending order, ties in the given order; every
    length is between 1 and the largest capacity. ``floor``: open the smallest size that
    is at least this and holds the piece; without one, the size of least cost a token.
    """
    caps = sorted(capacities)
    room: list[list[int]] = [[] for _ in range(caps[-1] + 1)]  # open bins by room left
    rooms: list[int] = []  # which rooms have bins, sorted
    bins, offsets, used, cap = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), [], []
    left = int(lengths.sum()) if len(lengths) else 0
    for k in np.argsort(-lengths, kind="stable"):
        n = int(lengths[k])
        i = bisect.bisect_left(rooms, n)
        if i < len(rooms):
            r = rooms[i]
            b = room[r].pop()
            if not room[r]:
                rooms.pop(i)
        else:
            fits = caps[bisect.bisect_left(caps, n) :]
            if floor is None:
                r = min(fits, key=lambda c: (sequence_cost(c, overhead, attention) / min(c, left), c))
            else:
                r = next(c for c in fits if c >= min(floor, caps[-1]))
            b = len(used)
            used.append(0)
            cap.append(r)
        bins[k], offsets[k] = b, used[b]
        used[b] += n
        left -= n
        r -= n
        if r:
            if not room[r]:
                bisect.insort(rooms, r)
            room[r].append(b)
    final = np.array([caps[bisect.bisect_left(caps, u)] for u in used], np.int64)
    return bins, offsets, final


def pieces(df: DataFrame, longest: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a piece: id, content hash, words of the text, piece number, first word, length."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = df.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("content"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("n_words"))
    last = F.greatest(F.ceil(F.col("n_words") / longest), F.lit(1)) - 1
    rows = rows.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), last.cast("long"))))
    rows = rows.withColumn("first_word", F.col("piece") * longest)
    return rows.withColumn("length", F.least(F.lit(longest).cast("long"), F.col("n_words") - F.col("first_word")))


def pack(df: DataFrame, capacities: tuple[int, ...] = CAPACITIES, overhead: int = SEQUENCE_OVERHEAD, id_col: str = "doc_id", text_col: str = "text", attention: int = ATTENTION_LENGTH) -> DataFrame:
    """``doc_id, piece, first_word, length, bin_id, bin_offset, capacity, bin_used``.

    Lengths are words (maximal runs without white space). Texts without words (null
    and empty ones too) keep one row with length 0 and a null bin. Bin ids are
    gapless from 0. Null ids and repeated rows are packed like any other row; equal
    rows get their places in an arbitrary but complete way. Extra columns are
    ignored; an empty table gives an empty result.
    """
    longest = max(capacities)
    rows = checkpointed(pieces(df, longest, id_col, text_col))
    cells = cells_for(rows.count(), PIECES_PER_CELL)
    rows = rows.withColumn("cell", F.pmod(F.xxhash64("doc_id", "content", "piece"), F.lit(cells)).cast("int"))

    def cell(table: pa.Table) -> pa.Table:
        table = table.sort_by([("length", "descending"), ("doc_id", "ascending"), ("content", "ascending"), ("piece", "ascending")])
        bins, offsets, final = best_packing(table["length"].to_numpy(), capacities, overhead, attention)
        used = np.bincount(bins, weights=table["length"].to_numpy(), minlength=len(final)).astype(np.int64)
        out = table.select(["doc_id", "piece", "first_word", "length", "cell"])
        for name, values in (("bin", bins), ("bin_offset", offsets), ("capacity", final[bins]), ("bin_used", used[bins])):
            out = out.append_column(name, pa.array(values, pa.int64()))
        return out

    schema = "doc_id {}, piece long, first_word long, length long, cell int, bin long, bin_offset long, capacity long, bin_used long"
    packed = rows.where("length > 0").groupBy("cell").applyInArrow(cell, schema.format(df.schema[id_col].dataType.simpleString()))
    packed = checkpointed(packed)
    counts = packed.groupBy("cell").agg((F.max("bin") + 1).alias("n"))  # one row a cell
    firsts = counts.select("cell", (F.sum("n").over(Window.orderBy("cell")) - F.col("n")).alias("first_bin"))
    placed = packed.join(firsts, "cell")
    out = ["doc_id", "piece", "first_word", "length", "bin_id", "bin_offset", "capacity", "bin_used"]
    empty = rows.where("length <= 0").select("doc_id", "piece", "first_word", F.lit(0).cast("long").alias("length"), *[F.lit(None).cast("long").alias(c) for c in out[4:]])
    return placed.withColumn("bin_id", F.col("first_bin") + F.col("bin")).select(*out).unionByName(empty)
