"""Substring dedup by relative Lempel-Ziv parsing.

The reference of a document is every document with a smaller id. It is cut into blocks
of neighbouring texts (the batches of the round trip), and its index knows, for each
13-word seed, the block that holds the seed's first document. A document is parsed from
left to right into factors (source document, source position, length) and literals:

* index: every block asks for its distinct seeds and learns, for each, the block of an
  earlier document that holds it (range-partitioned by hash, least document first);
* parse: a factor begins at the first seed that the index knows, and goes on while the
  following seeds follow each other in the same block; seeds whose first document lies
  in the document's own block are parsed there. A seed that straddles the end of a factor is
  looked up like any other and begins the next factor, which then overlaps the last:
  so no window at a factor boundary is missed;
* check: the source's words are fetched and compared with the document's, word by
  word. Seeds are hashes and only say where to look; windows whose words differ from
  the source's (two seeds with one hash) are judged by grouping the words themselves.

Factors are at least 13 words long; their union is the set of duplicate spans.
"""

from __future__ import annotations

import hashlib
import zlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lexispan.llm import words as W
from lexispan.llm.common import cells_for, checkpointed, text_volume
from lexispan.llm.roundtrip import BUCKET_HASHES, PART_BYTES, Batches, answered, asked, deal, unpack, values_of

WINDOW = 13
PIECE = 64  # windows of a factor that are fetched together
BROADCAST_HASHES = 100_000  # hashes (8 bytes) of disputed seeds that may be sent to all tasks
_BYTES_PER_WORD = 5  # a cautious guess, for the number of buckets only
_TOP = np.iinfo(np.int64).max  # stands for a null id: later than every other
U = np.uint64
_SPANS = "spans array<struct<from_word:long,to_word:long>>, factors array<struct<from_word:long,length:long,source_id:long,source_word:long>>"
_MORE = "disputed array<struct<at:long,hash:long>>, place long, checksum long, batch long"


def factors(known: np.ndarray, n_words: int, window: int) -> list[tuple[int, int]]:
    """Union of one document's known windows as [from, to) word ranges, given which of
    its seeds start in the reference. Ranges that touch or overlap merge."""
    at = np.flatnonzero(known)
    if not len(at):
        return []
    breaks = np.flatnonzero(np.diff(at) > window)
    first, last = np.append(at[0], at[breaks + 1]), np.append(at[breaks], at[-1])
    return [(int(a), min(int(b) + window, n_words)) for a, b in zip(first, last, strict=True)]


class _Seeds:
    """The seeds of a batch of texts, by position."""

    def __init__(self, texts: pa.Table, window: int, seed_bits: int) -> None:
        self.buf, self.offsets = W.text_buffer(texts["text"])
        self.words = W.words(self.buf, self.offsets, W.spaced_words())
        self.ids = texts["doc_id"].fill_null(_TOP).to_numpy().astype(np.int64)
        hashes, self.at = W.grams(self.words, window)
        spare = U(64 - seed_bits)
        self.hash = hashes >> spare << spare
        self.row = np.searchsorted(self.words.first, self.at, "right") - 1
        self.doc = self.ids[self.row]

    def distinct(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(sorted distinct hashes, the seed with the least document of each, the hash of
        each seed): texts stand in the order of their ids, so the first seed is the least."""
        order = np.argsort(self.hash, kind="stable")
        h = self.hash[order]
        new = np.append(True, h[1:] != h[:-1])[: len(h)]
        number = np.empty(len(h), np.int64)
        number[order] = np.cumsum(new) - 1
        return h[new], order[new], number

    def word_in_text(self, k: np.ndarray) -> np.ndarray:
        """Place of seeds in their own texts."""
        return self.at[k] - self.words.first[self.row[k]]


def _runs(at: np.ndarray, *same: np.ndarray, most: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(first, length) of runs of neighbouring positions with equal ``same``, cut at ``most``."""
    if not len(at):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    head = np.append(True, (np.diff(at) != 1) | np.logical_or.reduce([np.diff(s) != 0 for s in same]))
    if most:
        start = np.flatnonzero(head)
        inside = np.arange(len(at)) - start[np.cumsum(head) - 1]
        head |= inside % most == 0
    first = np.flatnonzero(head)
    return first, np.diff(np.append(first, len(at)))




class _Parse(NamedTuple):
    """Factors of a batch's texts by their first seed's word: windows, source and place in it."""

    at: np.ndarray
    n: np.ndarray
    source_id: np.ndarray
    source_word: np.ndarray

    @staticmethod
    def of(parts: list[tuple]) -> _Parse:
        columns = [np.concatenate([np.asarray(p[k], np.int64) for p in parts]) for k in range(4)]
        order = np.lexsort((columns[1], columns[0]))
        return _Parse(*(c[order] for c in columns))


def _rows(texts: pa.Table, window: int, parse: _Parse, disputed: tuple[np.ndarray, np.ndarray] | None, keep_text: bool) -> dict[str, pa.Array]:
    """The result's columns for a batch, given its factors."""
    buf, text_at = W.text_buffer(texts["text"])
    w = W.words(buf, text_at, W.spaced_words())
    at, n, source, word = parse
    known = np.zeros(len(w.start), bool)
    known[np.repeat(at - (np.cumsum(n) - n), n) + np.arange(n.sum())] = True
    # pieces that go on where the one before ends, in the same source, are one factor
    head = np.append(True, (np.diff(at) != n[:-1]) | (np.diff(word) != n[:-1]) | (np.diff(source) != 0))[: len(at)]
    begin = np.flatnonzero(head)
    length = np.add.reduceat(n, begin) + window - 1 if len(begin) else np.zeros(0, np.int64)
    text_of = np.searchsorted(w.first, at[begin], "right") - 1
    own = at[begin] - w.first[text_of]
    removed, shas, spans, kept_texts = [], [], [], []
    raw = buf.tobytes()
    for d, (a, b) in enumerate(zip(w.first[:-1], w.first[1:], strict=True)):
        found = factors(known[a:b], b - a, window)
        whole = raw[text_at[d] : text_at[d + 1]]
        kept = whole.split()
        gone = 0
        for x, y in reversed(found):
            del kept[x:y]
            gone += y - x
        kept = b" ".join(kept)
        removed.append(gone)
        shas.append(hashlib.sha256(kept).hexdigest())
        spans.append([{"from_word": x, "to_word": y} for x, y in found])
        if keep_text:
            kept_texts.append((kept if gone else whole).decode())
    texts_upto = np.arange(len(w.first))
    columns = {"doc_id": texts["doc_id"], "n_words": pa.array(np.diff(w.first), pa.int64()), "n_removed": pa.array(removed, pa.int64()), "kept_sha256": pa.array(shas, pa.string())}
    columns["spans"] = pa.array(spans, pa.list_(pa.struct([("from_word", pa.int64()), ("to_word", pa.int64())])))
    columns["factors"] = _lists(np.searchsorted(text_of, texts_upto), from_word=own, length=length, source_id=source[begin], source_word=word[begin])
    if keep_text:
        columns["kept_text"] = pa.array(kept_texts, pa.string())
    if disputed is not None:
        k, h = disputed
        columns["disputed"] = _lists(np.searchsorted(k, w.first), at=k, hash=h.view(np.int64))
        columns["place"] = pa.array(texts_upto[:-1], pa.int64())
        columns["checksum"] = pa.array(np.full(len(texts), _checksum(texts)), pa.int64())
    return columns


def _lists(upto: np.ndarray, **fields: np.ndarray) -> pa.Array:
    structs = pa.StructArray.from_arrays([pa.array(x.astype(np.int64)) for x in fields.values()], list(fields))
    return pa.ListArray.from_arrays(pa.array(upto.astype(np.int32)), structs)


def _checksum(texts: pa.Table) -> int:
    """Of the ids and texts of an unpacked batch."""
    buf, offsets = W.text_buffer(texts["text"])
    ids = texts["doc_id"].fill_null(_TOP).to_numpy().astype(np.int64)
    return zlib.crc32(ids.tobytes(), zlib.crc32(offsets.tobytes(), zlib.crc32(buf)))


def _parsed(batches: Batches, kind: str, parts: int, buckets: int, window: int, seed_bits: int) -> DataFrame:
    """The result's rows, with checked factors, by ``batch`` and ``place`` in it; ``disputed``
    names the seeds (word of the batch, hash) whose words differ from their source's, and
    ``checksum`` stands for the batch's texts."""

    def seeds(texts: pa.Table) -> _Seeds:
        return _Seeds(unpack(texts), window, seed_bits)

    def ask(texts: pa.Table):
        s = _Seeds(texts, window, seed_bits)
        hashes, least, _ = s.distinct()
        return hashes, [s.doc[least], s.at[least].astype(np.uint8)]

    def answer(hashes: np.ndarray, beside: list[np.ndarray], batch: np.ndarray) -> np.ndarray:
        """The batch with a seed's first document and the last byte of its place there, if
        that is earlier than the asking batch's own; -1 else."""
        doc, place = beside
        order = np.lexsort((batch, doc, hashes))
        h = hashes[order]
        head = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
        size = np.diff(np.append(head, len(h)))
        least, source = np.repeat(doc[order][head], size), np.repeat((batch << 8 | place)[order][head], size)
        out = np.empty(len(h), np.int64)
        out[order] = np.where(least < doc[order], source, -1)
        return out

    def foreign(s: _Seeds, source: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Seeds that only another batch can hold earlier, as pieces: (seed, windows, batch).
        A jump of the source's place by a multiple of 256 goes unnoticed here."""
        _, least, number = s.distinct()
        source = source[number] if len(number) else np.zeros(0, np.int64)
        k = np.flatnonzero((source >= 0) & (s.doc <= s.doc[least][number]))
        batch, follows = source[k] >> 8, (source[k] - s.at[k]) & 255
        first, n = _runs(s.at[k], batch, follows, most=PIECE)
        return k[first], n, batch[first]

    def want(texts: pa.Table, replies: pa.Table) -> pa.Table:
        if not texts.num_rows:
            z = np.zeros(0, np.int64)
            return _wanted(0, z, z.view(U), z.view(U), z, z)
        s = seeds(texts)
        k, n, source = foreign(s, values_of(replies))
        return _wanted(texts["batch"][0].as_py(), source, s.hash[k], s.hash[k + n - 1], s.at[k], n)

    def fetch(texts: pa.Table, wanted: pa.Table) -> pa.Table:
        """The words from the first seed's place in this block on, ``n`` windows of them (fewer
        where the text ends), with the source's id and the place in it; and where the last
        seed's place is not n - 1 words further, the windows that end there (from ``skip``)."""
        if not texts.num_rows or not wanted.num_rows:
            return _fetched(wanted.slice(0, 0), [], [], [], [])
        s = seeds(texts)
        hashes, least, _ = s.distinct()
        n = wanted["n"].to_numpy().astype(np.int64)
        head, tail = (least[np.searchsorted(hashes, wanted[c].to_numpy().view(U))] for c in ("hash", "tail"))
        end = s.words.first[s.row[head] + 1]
        stop = np.minimum(s.at[head] + n + window - 1, end)
        jump = np.flatnonzero(s.at[tail] != s.at[head] + n - 1)
        first = np.maximum(s.at[tail] - n + 1, s.words.first[s.row[tail]])[jump]
        which = np.append(np.arange(len(n)), jump)
        seed = np.append(head, tail[jump])
        begin, stop = np.append(s.at[head], first), np.append(stop, s.at[tail][jump] + window)
        skip = np.append(np.zeros(len(n), np.int64), n[jump] - 1 - (s.at[tail][jump] - first))
        raw = s.buf.tobytes()
        text = [raw[a:z] for a, z in zip(s.words.start[begin].tolist(), s.words.end[stop - 1].tolist(), strict=True)]
        return _fetched(wanted.take(pa.array(which)), skip, s.doc[seed], begin - s.words.first[s.row[seed]], text)

    def check(texts: pa.Table, found: pa.Table) -> pa.Table:
        """Compare the words of every factor with its source's."""
        batch, texts = texts["batch"][0].as_py(), unpack(texts)
        s = _Seeds(texts, window, seed_bits)
        code, dictionary = W.codes(s.buf, s.words)
        _, least, number = s.distinct()
        asked_for, done = np.zeros(len(s.at), bool), np.zeros(len(s.at), bool)
        # seeds whose first document is in this batch: the source is here
        k = np.flatnonzero(s.doc > s.doc[least][number])
        source = least[number[k]]
        good = np.ones(len(k), bool)
        for j in range(window):
            good &= code[s.at[k] + j] == code[s.at[source] + j]
        asked_for[k], done[k[good]] = True, True
        first, n = _runs(s.at[k[good]], s.at[source[good]] - s.at[k[good]])
        begin = source[good][first]
        parts = [(s.at[k[good][first]], n, s.doc[begin], s.word_in_text(begin))]
        del least, number, source, begin
        # seeds of other blocks: their words came with them
        if found.num_rows:
            skip = found["skip"].fill_null(0).to_numpy()
            place, counts = found["at"].to_numpy() + skip, found["n"].to_numpy().astype(np.int64) - skip
            raw, offsets = W.text_buffer(found["text"].combine_chunks().fill_null(b"").cast(pa.large_string()))
            w = W.words(raw, offsets, W.spaced_words())
            theirs, _ = W.codes(raw, w, dictionary)
            ids, words = found["source_id"].fill_null(_TOP).to_numpy(), found["source_word"].fill_null(0).to_numpy()
            seed = np.searchsorted(s.at, place)
            size = np.minimum(counts + window - 1, np.diff(w.first))
            step = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            equal = code[np.repeat(place, size) + step] == theirs[np.repeat(w.first[:-1], size) + step]
            total = np.append(0, np.cumsum(equal))
            # window j of piece p is known if its words are equal and the source is earlier
            p = np.repeat(np.arange(len(counts)), counts)
            j = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
            inside = j + window <= size[p]
            a = np.where(inside, (np.cumsum(size) - size)[p] + j, 0)
            good = inside & (total[np.minimum(a + window, len(total) - 1)] - total[a] == window) & (ids[p] < s.doc[seed[p]])
            asked_for[seed[p] + j] = True
            good &= ~done[seed[p] + j]
            done[seed[p] + j] |= good
            first, n = _runs(place[p[good]] + j[good], p[good])
            p1, j1 = p[good][first], j[good][first]
            parts.append((place[p1] + j1, n, ids[p1], words[p1] + j1))
        bad = np.flatnonzero(asked_for & ~done)
        disputed = s.at[bad], s.hash[bad]
        del s, code, dictionary
        pa.default_memory_pool().release_unused()
        columns = _rows(texts, window, _Parse.of(parts), disputed, False)
        return pa.table(columns | {"batch": pa.array(np.full(len(texts), batch), pa.int64())})

    asks = asked(batches, buckets, ask).repartition(buckets, "bucket")
    by_batch = batches.packed().repartition(parts, "batch").groupBy("batch")
    replied = answered(asks, answer)
    wanted = by_batch.cogroup(replied.groupBy("batch")).applyInArrow(want, "batch long, source long, hash long, tail long, at long, n int")
    # however many batches want the same words, their block is asked for them once
    once = wanted.select("source", "hash", "tail", "n").distinct()
    fetched = by_batch.cogroup(once.groupBy("source")).applyInArrow(fetch, "source long, hash long, tail long, n int, skip long, source_id long, source_word long, text binary")
    found = wanted.join(fetched, ["source", "hash", "tail", "n"], "left")
    return by_batch.cogroup(found.groupBy("batch")).applyInArrow(check, f"doc_id {kind}, n_words long, n_removed long, kept_sha256 string, {_SPANS}, {_MORE}")


def _wanted(batch: int, source: np.ndarray, hashes: np.ndarray, tail: np.ndarray, at: np.ndarray, n: np.ndarray) -> pa.Table:
    return pa.table(
        {
            "batch": pa.array(np.full(len(source), batch), pa.int64()),
            "source": pa.array(source, pa.int64()),
            "hash": pa.array(hashes.view(np.int64)),
            "tail": pa.array(tail.view(np.int64)),
            "at": pa.array(at.astype(np.int64)),
            "n": pa.array(n.astype(np.int32)),
        }
    )


def _fetched(wanted: pa.Table, skip, ids, words, text: list[bytes]) -> pa.Table:
    columns = [wanted[c] for c in ("source", "hash", "tail", "n")]
    columns += [pa.array(skip, pa.int64()), pa.array(ids, pa.int64()), pa.array(words, pa.int64()), pa.array(text, pa.binary())]
    return pa.table(columns, ["source", "hash", "tail", "n", "skip", "source_id", "source_word", "text"])


def _settled(batches: Batches, parsed: DataFrame, window: int, seed_bits: int) -> DataFrame:
    """``batch, at, source_id, source_word`` of the seeds that start in an earlier document,
    among all whose hash is disputed: those windows are grouped by their words."""
    hashes = checkpointed(parsed.select(F.explode("disputed.hash").alias("hash")).distinct())
    few = hashes.count() <= BROADCAST_HASHES
    chosen = np.sort(np.array([r[0] for r in hashes.collect()], np.int64)) if few else None

    def windows(batch: int, texts: pa.Table) -> pa.Table:
        s = _Seeds(texts, window, seed_bits)
        h = s.hash.view(np.int64)
        k = np.flatnonzero(np.isin(h, chosen)) if few else np.arange(len(h))
        raw = s.buf.tobytes()
        text = [b" ".join(raw[a:z].split()) for a, z in zip(s.words.start[s.at[k]].tolist(), s.words.end[s.at[k] + window - 1].tolist(), strict=True)]
        columns = [pa.array(np.full(len(k), batch), pa.int64()), pa.array(s.at[k], pa.int64()), pa.array(h[k])]
        columns += [pa.array(s.doc[k]), pa.array(s.word_in_text(k), pa.int64()), pa.array(text, pa.binary())]
        return pa.table(columns, ["batch", "at", "hash", "doc", "word", "text"])

    rows = batches.mapped(windows, "batch long, at long, hash long, doc long, word long, text binary")
    if not few:
        rows = rows.join(hashes, "hash", "left_semi")
    rows = checkpointed(rows)
    first = rows.groupBy("text").agg(F.min(F.struct("doc", "word")).alias("first"))
    known = rows.join(first, "text").where("first.doc < doc")
    return known.select("batch", "at", F.col("first.doc").alias("source_id"), F.col("first.word").alias("source_word"))


def dedup_substrings(df: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = True, carry: bool = False, seed_bits: int = 64) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256, spans, factors`` and, if asked for,
    ``kept_text`` (the whole text where nothing goes, else the kept words joined by
    one space) and ``row`` (all other input columns) for every row.

    Words are runs without white space. A word goes if a window of ``window``
    consecutive words that covers it also starts in a document with a smaller id;
    windows are judged on the input. ``factors`` are the parse (first word, length,
    source document and word), ``spans`` their union. Ids are integers. Null and empty
    texts have no words. Rows that share an id count as one document number, so neither
    is earlier than the other and both keep the windows they share; a null id is later
    than every other. Extra columns are ignored; an empty table gives an empty result.
    ``seed_bits``: how much of a seed's hash is used; fewer bits give the same result.

    Where texts are returned or two seeds share a hash, the input is read twice, and has to
    be the same rows in the same partitions (files, tables and checkpoints are); if it
    isn't, the second reading fails.
    """
    n_rows, n_bytes = text_volume(df, text_col)
    parts = cells_for(n_bytes + 64 * n_rows, PART_BYTES, 12)
    buckets = cells_for(n_bytes // _BYTES_PER_WORD, BUCKET_HASHES, 12)
    kind = df.schema[id_col].dataType.simpleString()
    batches = deal(df, id_col, text_col)
    parsed = checkpointed(_parsed(batches, kind, parts, buckets, window, seed_bits))
    result = ["doc_id", "n_words", "n_removed", "kept_sha256", "spans", "factors"]
    none = F.lit(None).cast("long")
    marks = parsed.select("batch", "place", "factors", "checksum", none.alias("at"), none.alias("source_id"), none.alias("source_word"))
    if not parsed.where(F.size("disputed") > 0).isEmpty():
        settled = checkpointed(_settled(batches, parsed, window, seed_bits))
        extra = settled.select("batch", none.alias("place"), F.lit(None).cast(parsed.schema["factors"].dataType).alias("factors"), none.alias("checksum"), "at", "source_id", "source_word")
        marks = marks.unionByName(extra)
        again = settled.select("batch").distinct()
    elif not (keep_text or carry):
        return parsed.select(*result)
    else:
        again = None
    if keep_text or carry:
        packed = deal(df, id_col, text_col, carry).packed()
        same = None
    else:  # only batches with disputed seeds change
        again = checkpointed(again)
        some = F.broadcast(again) if again.count() <= BROADCAST_HASHES else again
        same = parsed.join(some, "batch", "left_anti").select(*result)
        packed, marks = batches.packed().join(some, "batch", "left_semi"), marks.join(some, "batch", "left_semi")

    def finish(texts: pa.Table, marks: pa.Table) -> pa.Table:
        texts = unpack(texts) if texts.num_rows else texts
        rows = marks.filter(pc.is_valid(marks["place"])).sort_by("place").combine_chunks()
        if not rows.num_rows or rows.num_rows != texts.num_rows or rows["checksum"][0].as_py() != _checksum(texts):
            raise RuntimeError("the input has changed since it was parsed; checkpoint it first")
        w = W.words(*W.text_buffer(texts["text"]), W.spaced_words())
        lists = rows["factors"].combine_chunks()
        if isinstance(lists, pa.ChunkedArray):
            lists = lists.chunk(0)
        own = lists.flatten()
        column = lambda c: own.field(c).to_numpy(zero_copy_only=False).astype(np.int64)
        start = np.repeat(w.first[:-1], pc.list_value_length(lists).to_numpy(zero_copy_only=False))
        parts = [(start + column("from_word"), column("length") - window + 1, column("source_id"), column("source_word"))]
        extra = marks.filter(pc.is_null(marks["place"]))
        if extra.num_rows:
            known = np.zeros(len(w.start) + 1, bool)
            known[np.repeat(parts[0][0] - (np.cumsum(parts[0][1]) - parts[0][1]), parts[0][1]) + np.arange(parts[0][1].sum())] = True
            at, source, word = (extra[c].to_numpy() for c in ("at", "source_id", "source_word"))
            new = ~known[at]
            parts.append((at[new], np.ones(new.sum(), np.int64), source[new], word[new]))
        columns = _rows(texts, window, _Parse.of(parts), None, keep_text)
        return pa.table(columns | ({"row": texts["row"]} if carry else {}))

    schema = f"doc_id {kind}, n_words long, n_removed long, kept_sha256 string, {_SPANS}" + ", kept_text string" * keep_text
    if carry:
        others = StructType([f for f in df.schema.fields if f.name != text_col])
        schema += f", row {others.simpleString()}"
    out = packed.repartition(parts, "batch").groupBy("batch").cogroup(marks.groupBy("batch")).applyInArrow(finish, schema)
    return out if same is None else out.unionByName(same)
