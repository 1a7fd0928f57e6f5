"""Hash lookups by a round trip between text batches and hash buckets.

Word n-grams of a corpus are too many to shuffle as rows. Here neighbouring rows form
batches of a few MB, each batch sends one row to each hash bucket - the sorted distinct
n-gram hashes it holds for that bucket, delta-coded and compressed - the bucket answers
every batch with one row, in the same order, and the batch puts the answers back to
its texts:

    rows --deal--> batches --asked--> buckets --answered--> batches --> rows

However often an n-gram occurs, a batch names it once, so a bucket never holds more
than (distinct n-grams in its range) x (batches that hold them), and no key is hot:
rows that are equal share a batch only as far as it has room. Batches and buckets stay
of bounded size while the input grows. A row of an exchange holds one hash at least,
so there are never more of them than distinct hashes of the batches.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexispan.llm import words as W

BATCH_BYTES = 4 << 20
PART_BYTES = 16 << 20  # text of the batches that share a partition
BUCKET_HASHES = 2_000_000
U = np.uint64


def squeeze(values: np.ndarray) -> bytes:
    """Compressed array; bytes of equal significance stand together."""
    raw = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), -1).T
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(raw).tobytes())


def unsqueeze(data: bytes, dtype: type) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(raw.reshape(size, -1).T).view(dtype).reshape(-1)


def squeeze_sorted(values: np.ndarray, spare: int = 0) -> bytes:
    """``spare``: low bits that are zero in all values."""
    return squeeze(np.diff(values >> U(spare), prepend=U(0)))


def unsqueeze_sorted(data: bytes, spare: int = 0) -> np.ndarray:
    return np.cumsum(unsqueeze(data, U), dtype=U) << U(spare)


def bucket_edges(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket's range begins in sorted hashes: buckets + 1 positions."""
    limits = [(k << 64) // buckets for k in range(1, buckets)]
    return np.concatenate([[0], np.searchsorted(hashes, np.array(limits, U)), [len(hashes)]]).astype(np.int64)


def _each(parts: Iterator[pa.RecordBatch], names: list[str], batch_bytes: int) -> Iterator[tuple[int, pa.Table]]:
    """(number, rows) of the batches of one partition."""
    at = TaskContext.get().partitionId() << 32
    held: list[pa.RecordBatch] = []
    size = 0
    for part in parts:
        part = part.select(names)
        for start, n in W.slices(part.column(1), batch_bytes):
            piece = part.slice(start, n)
            more = W.volume(piece.column(1))
            if held and size + more > batch_bytes:
                yield at, pa.Table.from_batches(held).combine_chunks()
                at, held, size = at + 1, [], 0
            held.append(piece)
            size += more
    if held:
        yield at, pa.Table.from_batches(held).combine_chunks()


class Batches(NamedTuple):
    """Runs of neighbouring rows with about ``batch_bytes`` of text each, nothing shuffled.
    They are numbered by input partition and place in it: whoever reads them twice has to
    read the same rows in the same partitions."""

    rows: DataFrame
    names: list[str]
    batch_bytes: int

    def mapped(self, f: Callable[[int, pa.Table], pa.Table], schema: str) -> DataFrame:
        """f(number, texts in order) -> table, for every batch."""
        names, batch_bytes = self.names, self.batch_bytes

        def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch, table in _each(parts, names, batch_bytes):
                yield from f(batch, ordered(table)).combine_chunks().to_batches()

        return self.rows.mapInArrow(run, schema)

    def packed(self) -> DataFrame:
        """``batch, payload``: one row a batch, as a compressed Arrow stream."""
        names, batch_bytes = self.names, self.batch_bytes

        def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            options = pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=5))
            for batch, table in _each(parts, names, batch_bytes):
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, table.schema, options=options) as writer:
                    writer.write_table(table)
                yield pa.RecordBatch.from_arrays([pa.array([batch], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["batch", "payload"])

        return self.rows.mapInArrow(run, "batch long, payload binary")


def deal(df: DataFrame, id_col: str, text_col: str, carry: bool = False, batch_bytes: int = BATCH_BYTES) -> Batches:
    """Batches of id and text and, with ``carry``, the whole row's other columns as a struct."""
    names = ["doc_id", "text"] + ["row"] * carry
    others = [F.struct(*[F.col(f"`{c}`") for c in df.columns if c != text_col]).alias("row")] * carry
    rows = df.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), *others)
    return Batches(rows, names, batch_bytes)


def ordered(texts: pa.Table) -> pa.Table:
    """The texts of a batch in one fixed order: null ids last."""
    columns = texts.set_column(1, "text", texts["text"].cast(pa.large_string())).combine_chunks()
    return columns.sort_by([("doc_id", "ascending"), ("text", "ascending")]).combine_chunks()


def unpack(table: pa.Table) -> pa.Table:
    """The texts of a batch's packed row."""
    return ordered(pa.ipc.open_stream(table["payload"].chunk(0)[0].as_buffer()).read_all())


def _rows(keys: dict[str, list[int]], payloads: list[bytes]) -> pa.Table:
    kinds = {"bucket": pa.int32(), "batch": pa.int64()}
    return pa.table({k: pa.array(v, kinds[k]) for k, v in keys.items()} | {"payload": pa.array(payloads, pa.binary())})


def asked(batches: Batches, buckets: int, ask: Callable) -> DataFrame:
    """``bucket, batch, payload``; ask(texts) -> (sorted distinct hashes, [arrays beside
    them]). Batches ask where their rows are read."""

    def send(batch: int, texts: pa.Table) -> pa.Table:
        hashes, beside = ask(texts)
        edge = bucket_edges(hashes, buckets)
        keys, payloads = {"bucket": [], "batch": []}, []
        for k in np.flatnonzero(np.diff(edge)):
            part = slice(edge[k], edge[k + 1])
            keys["bucket"].append(int(k))
            keys["batch"].append(batch)
            payloads.append(_frame([squeeze_sorted(hashes[part]), *(squeeze(x[part]) for x in beside)], [x.dtype.str for x in beside]))
        del hashes, beside
        pa.default_memory_pool().release_unused()
        return _rows(keys, payloads)

    return batches.mapped(send, "bucket int, batch long, payload binary")


def answered(asks: DataFrame, answer: Callable) -> DataFrame:
    """``batch, bucket, payload``; answer(hashes, [arrays], batch of each) -> an array of
    one value for each hash, given all batches' hashes of a bucket concatenated."""

    def reply(table: pa.Table) -> pa.Table:
        batches = table["batch"].to_numpy()
        bucket = table["bucket"][0].as_py()
        hashes, beside = [], []
        for c in table["payload"].chunks:
            for x in c:
                fields, kinds = _unframe(x.as_py())
                hashes.append(unsqueeze_sorted(fields[0]))
                beside.append([unsqueeze(f, np.dtype(k)) for f, k in zip(fields[1:], kinds, strict=True)])
        counts = [len(h) for h in hashes]
        values = answer(np.concatenate(hashes), [np.concatenate(x) for x in zip(*beside, strict=True)], np.repeat(batches, counts))
        parts = np.split(values, np.cumsum(counts)[:-1])
        return _rows({"batch": batches.tolist(), "bucket": [bucket] * len(batches)}, [_frame([squeeze(p)], [p.dtype.str]) for p in parts])

    return asks.groupBy("bucket").applyInArrow(reply, "batch long, bucket int, payload binary")


def values_of(replies: pa.Table) -> np.ndarray:
    """The answers to a batch, in the order of its sorted hashes."""
    values = []
    if replies.num_rows:
        for x in replies.sort_by("bucket")["payload"].to_pylist():
            fields, kinds = _unframe(x)
            values.append(unsqueeze(fields[0], np.dtype(kinds[0])))
    return np.concatenate(values) if values else np.zeros(0, np.int64)


def round_trip(batches: Batches, parts: int, buckets: int, ask: Callable, answer: Callable, finish: Callable, schema: str) -> DataFrame:
    """Ask, answer and finish(texts, hashes, [arrays], values) -> table of one batch. ``parts``:
    partitions of the batches, so that tasks don't grow with the input.

    ``ask`` is computed again when the answers are back: cheaper than keeping it.
    """

    def end(texts: pa.Table, replies: pa.Table) -> pa.Table:
        texts = unpack(texts)
        hashes, beside = ask(texts)
        pa.default_memory_pool().release_unused()
        return finish(texts, hashes, beside, values_of(replies))

    replied = answered(asked(batches, buckets, ask).repartition(buckets, "bucket"), answer)
    return batches.packed().repartition(parts, "batch").groupBy("batch").cogroup(replied.groupBy("batch")).applyInArrow(end, schema)


def _frame(fields: list[bytes], kinds: list[str]) -> bytes:
    head = np.array([len(kinds), *map(len, fields)], np.int64).tobytes()
    names = "".join(k.ljust(4) for k in kinds).encode()
    return np.int64(len(fields)).tobytes() + head + names + b"".join(fields)


def _unframe(data: bytes) -> tuple[list[bytes], list[str]]:
    n = int(np.frombuffer(data, np.int64, 1)[0])
    n_kinds, *sizes = np.frombuffer(data, np.int64, n + 1, 8).tolist()
    at = 8 * (n + 2)
    kinds = [data[at + 4 * k : at + 4 * k + 4].decode().strip() for k in range(n_kinds)]
    at += 4 * n_kinds
    fields = []
    for s in sizes:
        fields.append(data[at : at + s])
        at += s
    return fields, kinds
