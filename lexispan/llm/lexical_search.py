"""Ranked lexical search, reversed: the items are indexed, the documents stream past.

An inverted index over the terms of the items (bounded, so it may be broadcast) meets each
document's term counts. Every task keeps one bounded heap an item; heaps are merged in two
levels. Collection statistics are counted over all documents before.
"""

from __future__ import annotations

import heapq
import math
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexispan.llm import words as W
from lexispan.llm.common import cells_for, checkpointed

#: A term is a longest run of these characters, A to Z lower-cased.
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
TOP = 10
INDEX_BYTES = 16 << 20  # of item texts in one index; more items are worked on in turn
SLICE_BYTES = 2 << 20
PAIRS = 1 << 20  # (document, item) cells of scores held at a time

_FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text: str | None) -> list[str]:
    return TERM.findall((text or "").translate(_FOLD))


class ItemIndex(NamedTuple):
    items: list[tuple]  # the id of each item
    dictionary: pa.Array  # the items' terms as UTF-8
    ends: np.ndarray  # where the postings of each term end
    postings: np.ndarray  # numbers of items


def index_items(rows: list[tuple]) -> ItemIndex:
    """The inverted index of (id, text) rows, each row an item."""
    holders: dict[str, list[int]] = {}
    for k, (_, text) in enumerate(rows):
        for t in dict.fromkeys(terms(text)):
            holders.setdefault(t, []).append(k)
    ends = np.append(0, np.cumsum([len(x) for x in holders.values()])).astype(np.int64)
    dictionary = pa.array([t.encode() for t in holders], pa.large_binary())
    return ItemIndex([i for i, _ in rows], dictionary, ends, np.array([k for x in holders.values() for k in x], np.int64))


class Counted(NamedTuple):
    """Term counts of a slice of documents, only terms of items: sorted by document."""

    length: np.ndarray  # terms of each document, all of them
    doc: np.ndarray
    term: np.ndarray
    tf: np.ndarray


def count_terms(index: ItemIndex, column: pa.Array) -> Counted:
    buf, offsets = W.text_buffer(column)
    upper = (buf >= 65) & (buf <= 90)
    buf = buf + np.uint8(32) * upper
    found = W.words(buf, offsets, W.letter_words())
    code, _ = W.codes(buf, found, index.dictionary)
    at = np.flatnonzero(code >= 0)
    key, tf = np.unique(found.doc()[at] * len(index.dictionary) + code[at], return_counts=True)
    width = max(1, len(index.dictionary))
    return Counted(np.diff(found.first), key // width, key % width, tf)


def _slices(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at, n in W.slices(b.column(column), SLICE_BYTES):
            yield b.slice(at, n)


def collection_statistics(docs: DataFrame, index: ItemIndex, text_col: str) -> tuple[int, int, np.ndarray]:
    """(documents with a term, terms of all documents, documents that hold each indexed
    term). Tasks add up what they read; one row a term and task is shuffled."""
    shared = docs.sparkSession.sparkContext.broadcast(index)
    n_terms = len(index.dictionary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n, total = np.zeros(n_terms, np.int64), 0, 0
        for b in _slices(batches, 0):
            c = count_terms(shared.value, b.column(0))
            df += np.bincount(c.term, minlength=n_terms)
            n, total = n + int((c.length > 0).sum()), total + int(c.length.sum())
        seen = np.flatnonzero(df)
        rows = [[-2, -1, *seen.tolist()], [n, total, *df[seen].tolist()]]
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in rows], ["term", "n"])

    counted = docs.select(F.col(text_col)).mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    got = {r["term"]: r["n"] for r in counted.collect()}  # one row a term of the index
    return got.get(-2, 0), got.get(-1, 0), np.array([got.get(k, 0) for k in range(n_terms)], np.int64)


def weight(n_docs: int, holding: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * holding + 1)))


class Heap:
    """The best (score, least document id) pairs of one item."""

    def __init__(self) -> None:
        self.rows: list[tuple] = []

    def offer(self, score: int, doc: object) -> None:
        row = (score, _Later(doc))
        if len(self.rows) < TOP:
            heapq.heappush(self.rows, row)
        elif row > self.rows[0]:
            heapq.heapreplace(self.rows, row)

    def least(self) -> int:
        return self.rows[0][0] if len(self.rows) == TOP else 1


class _Later:
    """A document id that is smaller the later it ranks: ascending ids, null last."""

    __slots__ = ("doc",)

    def __init__(self, doc: object) -> None:
        self.doc = doc

    def __lt__(self, other: _Later) -> bool:
        if self.doc is None or other.doc is None:
            return self.doc is None and other.doc is not None
        return self.doc > other.doc

    def __eq__(self, other: object) -> bool:
        return isinstance(other, _Later) and self.doc == other.doc


def _search_block(docs: DataFrame, index: ItemIndex, id_col: str, text_col: str) -> DataFrame:
    """``item`` (number), ``doc_id, score``: each task's best documents of each item."""
    n_docs, n_terms, holding = collection_statistics(docs, index, text_col)
    weights = np.array([weight(n_docs, int(k)) for k in holding], np.int64)
    shared = docs.sparkSession.sparkContext.broadcast((index, weights))
    kind = docs.schema[id_col].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, weights = shared.value
        heaps: dict[int, Heap] = {}
        least = np.ones(len(index.items), np.int64)  # a lower score enters no heap
        width, arrow = max(1, len(index.items)), None
        for b in _slices(batches, 1):
            arrow, ids = b.column(0).type, b.column(0)
            c = count_terms(index, b.column(1))
            # in Python's integers: 90 * n * N may pass 64 bits
            m = np.array([10 + 90 * n * n_docs // max(1, n_terms) for n in c.length.tolist()], np.int64)
            gain = weights[c.term] * (1_000_000_000 * c.tf // (1000 * c.tf + 8 * m[c.doc]))
            step = max(1, PAIRS // width)
            for at in range(0, len(ids), step):
                a, z = np.searchsorted(c.doc, [at, at + step])
                size = index.ends[c.term[a:z] + 1] - index.ends[c.term[a:z]]
                item = index.postings[ranges(index.ends[c.term[a:z]], size)]
                score = np.zeros(min(step, len(ids) - at) * width, np.int64)
                np.add.at(score, np.repeat(c.doc[a:z] - at, size) * width + item, np.repeat(gain[a:z], size))
                score = score.reshape(-1, width)
                doc, item = np.nonzero(score >= least)
                best = score[doc, item]
                for d, i, s in zip(doc.tolist(), item.tolist(), best.tolist(), strict=True):
                    heap = heaps.setdefault(i, Heap())
                    if s >= heap.least():
                        heap.offer(s, ids[at + d].as_py())
                        least[i] = heap.least()
        if heaps:
            rows = [(i, x.doc, s) for i, heap in heaps.items() for s, x in heap.rows]
            item, doc, score = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(item, pa.int64()), pa.array(doc, arrow), pa.array(score, pa.int64())], ["item", "doc_id", "score"])

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, f"item long, doc_id {kind.simpleString()}, score long")


def ranges(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... for ``length[0]`` places, then those of start[1], ..."""
    ends = np.cumsum(length)
    total = int(ends[-1]) if len(ends) else 0
    return np.repeat(start - (ends - length), length) + np.arange(total)


def rank_documents(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """``item_id, rank, doc_id, score``: each item's 10 best documents with a score above 0.

    Equal scores rank by ascending document id, null last. Each row of ``items`` is an item
    (so a repeated row repeats its ranking) and each row of ``docs`` a document; null texts
    have no terms; extra columns are ignored; empty tables give an empty result. Two
    readings of the documents for each 16 MiB of item texts: statistics, then scores. What
    is shuffled is at most 10 rows an item and task.
    """
    items = checkpointed(items.select(F.col(item_col).alias("item_id"), F.col(item_text_col).alias("text")))
    size = items.agg(F.sum(F.octet_length("text")), F.count(F.lit(1))).first()
    blocks = cells_for(int(size[0] or 0) + 16 * size[1], INDEX_BYTES)
    block = F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))
    out = None
    for k in range(blocks):
        rows = [tuple(r) for r in items.where(block == k).orderBy("item_id").collect()]
        index = index_items(rows)
        best = _top(_search_block(docs, index, id_col, text_col))
        kind = items.schema["item_id"].dataType.simpleString()
        names = items.sparkSession.createDataFrame([(n, i) for n, i in enumerate(index.items)], f"item long, item_id {kind}")
        best = best.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")  # the items of one index
        out = best if out is None else out.unionByName(best)
    return out


def _top(found: DataFrame) -> DataFrame:
    """The best 10 rows of each item, in two levels: of groups of tasks, then of all."""
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    group = F.floor(F.sqrt(F.spark_partition_id()))  # about 2 sqrt(tasks) at most in a group
    first = found.withColumn("_group", group)
    first = first.withColumn("_r", F.row_number().over(Window.partitionBy("item", "_group").orderBy(*order))).where(F.col("_r") <= TOP)
    rank = F.row_number().over(Window.partitionBy("item").orderBy(*order))
    return first.withColumn("rank", rank).where(F.col("rank") <= TOP).select("item", "rank", "doc_id", "score")
