"""Stupid-backoff language-model scores of every document against all the others.

The n-gram count tables (orders 1 to ``order``) of the whole corpus are partitioned
by hash. Every batch of texts sends its exploded, locally counted n-grams to them,
the buckets join and add up the counts of all batches, and the joined counts come
back and are summed for each document.

A document is scored against the corpus without itself: its own occurrences are
taken off every count. With c the counts of the other documents and N their words,

    S(w | context) = c(context w) / c(context)   if c(context w) > 0
                     ALPHA * S(w | shorter context)   otherwise
    S(w) = c(w) / N,  or  1 / (N + 1) for a word that no other document has,
           times ALPHA for every step back

and contexts never cross documents. ``logscore`` sums ln S over a text's words.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexispan.llm import words as W
from lexispan.llm.common import WORD, cells_for
from lexispan.llm.roundtrip import BUCKET_HASHES, PART_BYTES, deal, round_trip

ORDER = 3
ALPHA = 0.4
BATCH_BYTES = 6 << 20  # larger batches name fewer n-grams twice


def score_documents(df: DataFrame, order: int = ORDER, alpha: float = ALPHA, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_words, n_backed_off, logscore, mean_logscore`` for every row.

    Words are runs without white space, unchanged. ``n_backed_off`` counts words
    scored by a shorter context than the longest available. A null or empty text has
    no words, logscore 0 and a null mean. Rows that share an id are separate
    documents (each is among the others' counts), as are rows with a null id. Extra
    columns are ignored; an empty table gives an empty result. Counts are exact up
    to collisions of 64-bit n-gram hashes (about n * n / 2**65 pairs of n n-grams).
    """
    text = F.col(text_col)
    size = df.agg(F.count(F.lit(1)), F.sum(F.octet_length(text)), F.sum(F.regexp_count(text, F.lit(WORD)))).first()
    n_rows, n_bytes, n_words = (int(x or 0) for x in size)
    batches = deal(df, id_col, text_col, batch_bytes=BATCH_BYTES)
    buckets = cells_for(n_words * order, BUCKET_HASHES, 12)

    def read(texts: pa.Table) -> W.Words:
        return W.words(*W.text_buffer(texts["text"]), W.spaced_words())

    def ask(texts: pa.Table):
        w = read(texts)
        hashes = np.concatenate([W.grams(w, n)[0] for n in range(1, order + 1)])
        hashes.sort()
        head = _heads(hashes[1:] != hashes[:-1], len(hashes))
        return hashes[head], [_sizes(head, len(hashes)).astype(np.uint32)]

    def answer(hashes: np.ndarray, beside: list[np.ndarray], batch: np.ndarray) -> np.ndarray:
        keys = np.argsort(hashes, kind="stable")
        h = hashes[keys]
        head = _heads(h[1:] != h[:-1], len(h))
        total = np.add.reduceat(beside[0][keys].astype(np.int64), head) if len(h) else np.zeros(0, np.int64)
        out = np.empty(len(h), np.int64)
        out[keys] = np.repeat(total, _sizes(head, len(h)))
        return out - beside[0]  # of the other batches: mostly 0, and so small when packed

    def finish(texts: pa.Table, asked: np.ndarray, beside: list[np.ndarray], others: np.ndarray) -> pa.Table:
        total = beside[0].astype(np.int64) + others
        w = read(texts)
        n_docs, m = len(w.first) - 1, len(w.hash)
        doc = w.doc()
        length = np.diff(w.first)
        others = n_words - length  # N without the document itself
        counts = np.zeros((order + 1, m), np.int64)  # of the n-gram that begins at a word
        for n in range(1, order + 1):
            h, at = W.grams(w, n)
            # equal n-grams stand together, and those of one document: positions ascend
            keys = np.argsort(h, kind="stable")
            h, at = h[keys], at[keys]
            change, d = h[1:] != h[:-1], doc[at]
            head, own = _heads(change, len(h)), _heads(change | (d[1:] != d[:-1]), len(h))
            everywhere = total[np.searchsorted(asked, h[head])]
            within = _sizes(own, len(h))
            counts[n, at] = np.repeat(everywhere, _sizes(head, len(h))) - np.repeat(within, within)
        place = np.arange(m) - w.first[doc]
        logs = np.empty(m)
        done = np.zeros(m, bool)
        level = np.minimum(place + 1, order)  # longest n-gram that ends here
        back = np.zeros(m, np.int64)
        for n in range(order, 0, -1):
            now = np.flatnonzero(~done & (level >= n))
            begin = now - n + 1
            c = counts[n, begin]
            over = counts[n - 1, begin] if n > 1 else others[doc[now]]
            hit = c > 0
            logs[now[hit]] = np.log(c[hit] / over[hit])
            done[now[hit]] = True
            back[now[~hit]] += n > 1
        logs[~done] = -np.log(others[doc[~done]] + 1.0)
        logs += back * np.log(alpha)
        sums = np.bincount(doc, weights=logs, minlength=n_docs).astype(np.float64)
        backed = np.bincount(doc, weights=back > 0, minlength=n_docs).astype(np.int64)
        mean = pa.array(sums / np.maximum(length, 1), mask=length == 0)
        return pa.table({"doc_id": texts["doc_id"], "n_words": pa.array(length, pa.int64()), "n_backed_off": backed, "logscore": sums, "mean_logscore": mean})

    kind = df.schema[id_col].dataType.simpleString()
    parts = cells_for(n_bytes + 64 * n_rows, PART_BYTES, 12)
    return round_trip(batches, parts, buckets, ask, answer, finish, f"doc_id {kind}, n_words long, n_backed_off long, logscore double, mean_logscore double")


def _heads(change: np.ndarray, n: int) -> np.ndarray:
    """Where runs of n equal sorted values begin, given where neighbours differ."""
    return np.append(0, np.flatnonzero(change) + 1)[:n]


def _sizes(head: np.ndarray, n: int) -> np.ndarray:
    return np.diff(np.append(head, n)) if n else np.zeros(0, np.int64)
