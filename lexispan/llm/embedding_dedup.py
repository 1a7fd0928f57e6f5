"""Near-duplicate vectors by Euclidean p-stable hashing and exact cosine checks.

A normalised vector x falls, in each of L tables, into the bucket named by k
quantised random projections floor((a . x + b) / w). For unit vectors the cosine
threshold is a distance, so the chance that a pair at the threshold shares a bucket
is known. Buckets are wide, since Spark shuffles a vector once a table. A task that holds
a bucket finds its near pairs by inner tables in memory: a vector falls into the inner
bucket named by the lines, of some sets of random ones, on which its projection is greatest. The
chance that a pair meets there is known too; k, L and the inner tables are the cheapest by which a
pair at the threshold meets with probability ``RECALL`` at least (closer pairs far more surely).

Tables are worked off in rounds. A round shuffles about as many bytes as the vectors
have and hands on only counts and links, so disk grows with the input, not with
the number of tables. A bucket above the block size is split into pairs of blocks, which
are dealt to different tasks and, if they are many, to several rounds.

In an inner bucket cosines are matrix products in single precision; those within its
rounding of the threshold are taken again in double precision. Pairs are never written
out: a task adds up link counts (a pair counts only in the first table where it meets)
and hands on a spanning forest of its links, from which components are built.
"""

from __future__ import annotations

import functools
import math
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, FloatType

from lexispan.llm.common import checkpointed, shuffles_dropped
from lexispan.llm.components import components

THRESHOLD = 0.9
RECALL = 0.998
WIDTH = 2.0
BLOCK = 262_144  # vectors of a block; fewer if they are long
BLOCK_VALUES = 16 << 20
ROUND_BYTES = 256 << 20  # a round shuffles so much, or as much as the vectors
TILE, STRIP = 4096, 256
CHUNK = 192  # inner buckets are compared in runs of about so many vectors
PAIRS = 1 << 17
BROADCAST_ROWS = 200_000
#: Microseconds of a vector in a table, in an inner table and on a line, and of a pair: what plans are chosen by.
ROW_US, INNER_US, LINE_US, PAIR_US = 16.0, 0.5, 0.003, 0.004


def _normal(x: float) -> float:
    return 0.5 * math.erfc(-x / math.sqrt(2))


def collision(distance: float, width: float = WIDTH) -> float:
    """Chance that one quantised projection of two points at a distance agrees."""
    c = width / distance
    return 1 - 2 * _normal(-c) - 2 / (math.sqrt(2 * math.pi) * c) * (1 - math.exp(-c * c / 2))


@functools.cache
def corner(lines: int, cosine: float) -> float:
    """Chance that two points have their greatest projection, in absolute value, on the same
    one of so many lines and with the same sign; summed over the two points' values there."""
    r, step = min(cosine, 0.98), 0.02  # nearer points agree more often
    u = np.arange(step / 2, 7, step)
    same, other = (np.exp(-(u[:, None] ** 2 - 2 * c * u[:, None] * u + u**2) / (2 - 2 * r * r)) * step**2 / (2 * math.pi * math.sqrt(1 - r * r)) for c in (r, -r))
    below = 2 * np.pad((same + other).cumsum(axis=0).cumsum(axis=1), ((1, 0), (1, 0)))
    below = (below[1:, 1:] + below[1:, :-1] + below[:-1, 1:] + below[:-1, :-1]) / 4  # at the cells' middles
    return float(2 * lines * (same * below ** (lines - 1)).sum())


class Plan(NamedTuple):
    """Projections of a table and the tables; an inner table's lines and how many such sets of
    lines name a bucket (0: all rows are one), and the inner tables."""

    k: int
    tables: int
    lines: int
    sets: int
    inner: int


@functools.cache
def plan(n: int, threshold: float = THRESHOLD, recall: float = RECALL, group: int = BLOCK // 2) -> Plan:
    """The cheapest plan for n vectors whose buckets hold ``group`` unrelated vectors at most."""
    near, far = collision(math.sqrt(2 - 2 * threshold)), collision(math.sqrt(2))
    group = max(1, min(group, max(2048, n // 32)))
    least = max(1, math.ceil(math.log(max(n, 1) / group) / -math.log(far)))
    best: tuple[float, Plan] | None = None
    for k in range(least, max(least, min(least + 5, 21)) + 1):
        for lines, sets in [(1, 0), *((m, c) for m in (8, 16, 32, 64, 128) for c in (1, 2))]:
            for inner in range(1, 9 if sets else 2):
                meet = near**k * (1 - (1 - corner(lines, threshold) ** sets) ** inner)
                tables = max(1, math.ceil(math.log(1 - recall) / math.log1p(-meet)))
                cost = tables * (ROW_US + inner * (INNER_US + LINE_US * lines * sets + PAIR_US * (n * far**k / (2 * lines) ** sets + CHUNK)))
                if best is None or cost < best[0]:
                    best = cost, Plan(k, tables, lines, sets, inner)
    return best[1]


def plan_tables(n: int, threshold: float = THRESHOLD, recall: float = RECALL) -> tuple[int, int]:
    """(projections for each table, tables) for n vectors."""
    return plan(n, threshold, recall)[:2]


def unit(rows: np.ndarray) -> np.ndarray:
    """Normalised rows; scaled first, so that very large or small values survive."""
    rows = rows.astype(np.float64)
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def _scale(rows: np.ndarray) -> np.ndarray:
    """What makes scaled rows unit vectors."""
    parts = [1 / np.linalg.norm(rows[at : at + 8192].astype(np.float64), axis=1) for at in range(0, len(rows), 8192)]
    return np.concatenate([*parts, np.zeros(0)]).astype(np.float32)


@functools.lru_cache(maxsize=64)
def _lines(dim: int, lines: int, *seed: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Random lines as whole multiples of 1 / step, and shifts."""
    random = np.random.default_rng([dim, lines, *seed])
    step = 2.0 ** (13 - math.ceil(math.log2(1.5 * math.sqrt(dim) + 4)))
    ways = np.rint(random.standard_normal((dim, lines)) * step).astype(np.float32)
    return ways, random.uniform(0, WIDTH, lines).astype(np.float32), step


def _projected(rows: np.ndarray, scale: np.ndarray, seed: list[int], lines: int) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """Slices of the rows, their projections on so many random lines, and the lines' shifts.
    Rows and lines are rounded to fractions whose products add up exactly in single
    precision: a vector has the same projections in whatever company it is hashed."""
    ways, shift, step = _lines(rows.shape[1], lines, *seed)
    for at in range(0, len(rows), 4096):
        part = slice(at, at + 4096)
        whole = np.rint(rows[part] * (scale[part, None] * np.float32(2048))).astype(np.float32, copy=False)
        yield part, (whole @ ways) / np.float32(2048 * step), shift


def _keys(rows: np.ndarray, p: Plan) -> np.ndarray:
    """The key of every row in every table: k cells of three bits."""
    out = np.empty((len(rows), p.tables), _key_kind(p))
    for part, x, shift in _projected(rows, _scale(rows), [0, p.k], p.tables * p.k):
        cells = (np.clip(np.floor((x + shift) / np.float32(WIDTH)), -4, 3) + 4).astype(out.dtype).reshape(len(x), p.tables, p.k)
        out[part] = (cells << (np.arange(p.k) * 3).astype(out.dtype)).sum(axis=2, dtype=out.dtype)
    return out


def _key_kind(p: Plan) -> type:
    return np.uint32 if p.k <= 10 else np.uint64


def _corners(rows: np.ndarray, scale: np.ndarray, place: int, p: Plan) -> np.ndarray:
    """The key of every row in the inner tables of a table: its extreme lines and the signs there."""
    out = np.zeros((len(rows), p.inner), np.uint16)
    for part, x, _ in _projected(rows, scale, [1, place], p.inner * p.sets * p.lines) if p.sets else ():
        x = x.reshape(-1, p.lines)
        line = np.abs(x).argmax(axis=1)
        line = (2 * line + (x[np.arange(len(x)), line] > 0)).reshape(-1, p.inner, p.sets)
        out[part] = (line * (2 * p.lines) ** np.arange(p.sets)).sum(axis=2)
    return out


def _scaled(rows: np.ndarray) -> np.ndarray:
    """Rows times powers of two, which change no cosine, so that the largest value is about 1."""
    return np.ldexp(rows, -np.frexp(np.abs(rows).max(axis=1, keepdims=True))[1])


def _binary(rows: np.ndarray) -> pa.Array:
    """Every row's bytes."""
    rows = np.ascontiguousarray(rows)
    width = rows.shape[1] * rows.itemsize
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(np.arange(len(rows) + 1, dtype=np.int32) * np.int32(width)), pa.py_buffer(rows)])


def _values(column: pa.ChunkedArray, kind: type, width: int) -> np.ndarray:
    """Binary values of equal length as rows of ``width`` numbers."""
    parts = []
    for c in column.chunks:
        ends, data = c.buffers()[1:]
        at = np.frombuffer(ends, np.int32)[c.offset : c.offset + len(c) + 1]
        parts.append(np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8))
    return np.concatenate(parts).view(kind).reshape(-1, width)


def _number_kind(reps: DataFrame) -> type:
    return np.float32 if reps.schema["vector"].dataType.elementType.simpleString() == "float" else np.float64


def _hashed(reps: DataFrame, p: Plan) -> DataFrame:
    """``dim, rep, copies, name, name2, vector, sign``: vectors as bytes; ``sign`` holds the
    keys of all tables one after the other."""
    number = _number_kind(reps)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            t = pa.Table.from_batches([b])
            dims = t["dim"].to_numpy()
            if (dims[1:] != dims[:-1]).any():
                t = t.sort_by("dim")
                dims = t["dim"].to_numpy()
            cuts = np.flatnonzero(np.diff(dims, prepend=-1, append=-1)) if len(dims) else np.zeros(1, int)
            for a, z in zip(cuts[:-1], cuts[1:], strict=True):
                part, d = t.slice(a, z - a), int(dims[a])
                rows = part["vector"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(number).reshape(-1, d)
                rows = _scaled(rows)
                yield pa.RecordBatch.from_arrays(
                    [*(part[c].combine_chunks() for c in ("dim", "rep", "copies", "name", "name2")), _binary(rows), _binary(_keys(rows, p))],
                    ["dim", "rep", "copies", "name", "name2", "vector", "sign"],
                )

    return reps.select("dim", "rep", "copies", "name", "name2", "vector").mapInArrow(project, "dim int, rep long, copies long, name long, name2 long, vector binary, sign binary")


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Whole tasks of a stream that is sorted by ``task``, the hash of ``TASK``."""

    def whole(kept: list[pa.Table]) -> Iterator[pa.Table]:
        t = pa.concat_tables(kept) if len(kept) > 1 else kept[0]
        while len(t):  # tasks might share a hash
            mine = functools.reduce(pc.and_, (pc.equal(t[k], t[k][0]) for k in TASK))
            if pc.all(mine).as_py():
                yield t
                return
            yield t.filter(mine)
            t = t.filter(pc.invert(mine))

    kept: list[pa.Table] = []
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        t = pa.Table.from_batches([b])
        task = b["task"].to_numpy()
        if kept and task[0] != last:
            yield from whole(kept)
            kept = []
        cuts = [0, *(np.flatnonzero(task[1:] != task[:-1]) + 1).tolist(), len(task)]
        for a, z in zip(cuts[:-2], cuts[1:-1], strict=True):
            yield from whole([*kept, t.slice(a, z - a)])
            kept = []
        kept.append(t.slice(cuts[-2]))
        last = task[-1]
    if kept:
        yield from whole(kept)


def _near(rows: np.ndarray, scale: np.ndarray, key: np.ndarray, least: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Pairs of rows of one key, each once, with a cosine of ``least`` at least in single precision."""
    order = np.argsort(key, kind="stable")
    named = key[order]
    starts = np.flatnonzero(np.append(True, named[1:] != named[:-1]))
    sizes = np.diff(starts, append=len(key))
    order = order[np.repeat(sizes > 1, sizes)]
    sizes = sizes[sizes > 1]
    if not len(sizes):
        return
    bucket = np.repeat(np.arange(len(sizes)), sizes)
    starts = np.cumsum(sizes) - sizes
    # whole buckets that begin in the same stretch are compared together
    chunks = starts[np.flatnonzero(np.diff(starts // CHUNK, prepend=-1))]
    held: list[tuple[np.ndarray, ...]] = []
    count = 0
    for s, e in zip(chunks.tolist(), [*chunks[1:].tolist(), len(order)], strict=True):
        of = order[s:e]
        y = (rows[of] * scale[of, None]).astype(np.float32, copy=False)
        for p in range(0, e - s, STRIP):
            for q in range(p, e - s, TILE):
                g = y[p : p + STRIP] @ y[q : q + TILE].T
                if p == q:
                    g.ravel()[:: g.shape[1] + 1] = -2  # each with itself
                if g.max() < least:
                    continue
                some = np.flatnonzero(g.max(axis=1) >= least)
                a, b = np.nonzero(g[some] >= least)
                a = some[a]
                cos, a, b = g[a, b], a + p + s, b + q + s
                some = (b > a) & (bucket[a] == bucket[b])
                if some.any():
                    held.append((order[a[some]], order[b[some]], cos[some]))
                    count += len(held[-1][0])
                    if count > PAIRS:
                        yield from _cut(held)
                        held, count = [], 0
    yield from _cut(held)


def _cut(held: list[tuple[np.ndarray, ...]]) -> Iterator[tuple[np.ndarray, ...]]:
    if held:
        a, b, cos = (np.concatenate(c) for c in zip(*held, strict=True))
        for at in range(0, len(a), PAIRS):
            yield a[at : at + PAIRS], b[at : at + PAIRS], cos[at : at + PAIRS]


def _join(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Give the rows that links connect the least label among them."""
    while len(a):
        u, v = label[a], label[b]
        apart = u != v
        if not apart.any():
            return
        a, b, u, v = a[apart], b[apart], u[apart], v[apart]
        np.minimum.at(label, np.maximum(u, v), np.minimum(u, v))
        while (label[label] != label).any():
            label[:] = label[label]


class _Inner:
    """Keys of a group's rows in the inner tables of any table, made when asked for."""

    def __init__(self, rows: np.ndarray, scale: np.ndarray, p: Plan):
        self.rows, self.scale, self.plan, self.made = rows, scale, p, {}

    def of(self, place: int, at: np.ndarray) -> np.ndarray:
        p = self.plan
        if place not in self.made:
            self.made[place] = np.zeros(len(self.rows), bool), np.empty((len(self.rows), p.inner), np.uint16)
        there, keys = self.made[place]
        if not there[at].all():
            new = np.unique(at[~there[at]])
            keys[new] = _corners(self.rows[new], self.scale[new], place, p)
            there[new] = True
        return keys[at]


def _met(a: np.ndarray, b: np.ndarray, sign: np.ndarray, inner: _Inner) -> np.ndarray:
    """Which pairs share an inner bucket of an earlier table."""
    out = np.zeros(len(a), bool)
    for place in range(sign.shape[1]):
        same = np.flatnonzero(~out & (sign[a, place] == sign[b, place]))
        if len(same):
            out[same] = (inner.of(place, a[same]) == inner.of(place, b[same])).any(axis=1)
    return out


def _compare(threshold: float, p: Plan, number: type):
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _groups(batches):
            place, dim = t["place"][0].as_py(), t["dim"][0].as_py()
            rows = _values(t["vector"], number, dim)
            sign = _values(t["sign"], _key_kind(p), place) if place else np.zeros((len(t), 0), np.uint32)
            no, rep, copies, half = (t[c].to_numpy() for c in ("no", "rep", "copies", "half"))
            if len(t) < 2 or (t["offset"][0].as_py() and (half == half[0]).all()):
                continue
            scale = _scale(rows)
            inner, links, label = _Inner(rows, scale, p), np.zeros(len(t), np.int64), np.arange(len(t))
            keys = inner.of(place, label)
            slack = (dim + 16) * 2.0**-23  # above the rounding of single precision
            for j in range(p.inner):
                for a, b, cos in _near(rows, scale, keys[:, j], threshold - slack):
                    first = (keys[a, :j] != keys[b, :j]).all(axis=1)
                    if t["offset"][0].as_py():
                        first &= half[a] != half[b]  # the blocks themselves are other tasks
                    close = np.flatnonzero(first & (cos < threshold + slack))
                    for at in range(0, len(close), 8192):
                        c = close[at : at + 8192]
                        first[c] = (unit(rows[a[c]]) * unit(rows[b[c]])).sum(axis=1) >= threshold
                    a, b = a[first], b[first]
                    first = ~_met(a, b, sign, inner)
                    a, b = a[first], b[first]
                    links += np.bincount(a, weights=copies[b], minlength=len(t)).astype(np.int64)
                    links += np.bincount(b, weights=copies[a], minlength=len(t)).astype(np.int64)
                    _join(label, a, b)
            root = rep[label]
            some = (links > 0) | (root != rep)
            yield pa.RecordBatch.from_arrays([pa.array(c[some]) for c in (no, rep, root, links)], ["no", "u", "v", "links"])

    return compare


LINKS = "no long, u long, v long, links long"
#: What names a task's rows: two blocks of a bucket, ``offset`` apart, ``first`` of them the first.
TASK = ["place", "dim", "bucket", "offset", "first"]


def _rounds(widths: list[tuple[int, int, int]], limit: float) -> list[list[tuple[int, int, int]]]:
    """Rounds of ``(table, least offset, greatest offset)`` that shuffle about ``limit`` rows,
    from ``(table, blocks, rows)``. Of a bucket's blocks, those that are offset apart (around
    the ring of its blocks) meet in one step: a row is in one task at offset 0, else in two."""
    rounds: list[list[tuple[int, int, int]]] = []
    held = 0
    for place in sorted({w[0] for w in widths}):
        mine = [w for w in widths if w[0] == place]
        for offset in range(max(w[1] for w in mine) // 2 + 1):
            rows = sum(n * (1 if offset in (0, blocks / 2) else 2) for _, blocks, n in mine if blocks // 2 >= offset)
            if not rounds or held + rows > limit:
                rounds.append([])
                held = 0
            held += rows
            if rounds[-1] and rounds[-1][-1][0] == place:
                rounds[-1][-1] = (place, rounds[-1][-1][1], offset)
            else:
                rounds[-1].append((place, offset, offset))
    return rounds


def _dealt(reps: DataFrame, sizes: DataFrame, width: int, turns: list[tuple[int, int, int]]) -> DataFrame:
    """The rows of a round, a copy for each task that needs them."""
    turn = F.explode(F.array(*(F.struct(F.lit(p).alias("place"), F.lit(a).alias("least"), F.lit(z).alias("most")) for p, a, z in turns))).alias("turn")
    rows = reps.select("no", "dim", "rep", "copies", "vector", "sign", turn).select("*", "turn.*").drop("turn")
    rows = rows.withColumn("bucket", F.expr(f"substring(sign, place * {width} + 1, {width})")).withColumn("sign", F.expr(f"substring(sign, 1, place * {width})"))
    rows = rows.join(sizes, ["place", "dim", "bucket"]).where("least <= blocks div 2")
    rows = rows.withColumn("side", F.pmod(F.xxhash64("no"), "blocks").cast("int"))
    rows = rows.withColumn("offset", F.explode(F.expr("sequence(least, int(least(most, blocks div 2)))")))
    # around the ring a block is the first of one pair and the second of another
    ring = "CASE WHEN offset = 0 THEN array(side) WHEN 2 * offset = blocks THEN array(least(side, (side + offset) % blocks)) ELSE array(side, (side + blocks - offset) % blocks) END"
    rows = rows.withColumn("first", F.explode(F.expr(ring)))
    rows = rows.select(F.xxhash64(*TASK).alias("task"), *TASK, (F.col("side") != F.col("first")).cast("int").alias("half"), "no", "rep", "copies", "vector", "sign")
    return rows.repartition("task").sortWithinPartitions("task")


def near_vectors(df: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row.

    Links join rows whose vectors have a cosine of at least ``threshold``, in double
    precision. Vectors that are null, empty, zero or hold null or non-finite
    components link with nothing, nor do vectors of different lengths with each
    other, nor rows with a null id. Equal vectors are compared once and count with
    their number of copies; rows that repeat an id are vectors of
    their own with their own links, and one vertex of the components. Other columns are ignored; an empty table gives an empty result.
    ``df`` is read three times and must give the same rows each time; rows find their
    vector's result by two 64-bit hashes of it.
    """
    v = F.col("vector")
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("vector"))
    number = rows.schema["vector"].dataType.elementType
    if not isinstance(number, (FloatType, DoubleType)):
        number = DoubleType()
        rows = rows.withColumn("vector", v.cast(ArrayType(number)))
    # without lambdas, which Spark doesn't compile; array_contains of what isn't there is null if there are nulls
    infinite, nan = F.lit(math.inf).cast(number), F.lit(math.nan).cast(number)
    most, least = F.array_max(v), F.array_min(v)
    good = (most < infinite) & (least > -infinite) & ((most != 0) | (least != 0)) & (F.array_contains(v, nan) == F.lit(False)) & F.col("vec_id").isNotNull()
    good = F.coalesce(good, F.lit(False))
    rows = rows.withColumn("good", good)
    names = [F.xxhash64("vector").alias("name"), F.xxhash64(F.lit(1), "vector").alias("name2")]
    with shuffles_dropped(df.sparkSession):
        judged = _judged(rows.where("good"), names, threshold, recall)
    linked = rows.where("good").select("vec_id", *names).join(judged.hint("merge"), ["name", "name2"]).select("vec_id", "n_links", "component_id")
    alone = rows.where("NOT good").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = linked.unionByName(alone)
    return out.select("vec_id", "n_links", "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))


def _judged(usable: DataFrame, names: list[Column], threshold: float, recall: float) -> DataFrame:
    """``name, name2, n_links, component_id``: a row for each distinct vector."""
    about = usable.agg(F.approx_count_distinct(names[0]).alias("n"), F.avg(F.size("vector")).alias("dim")).first()
    group = min(BLOCK, int(BLOCK_VALUES / (about["dim"] or 1)))
    p = plan(about["n"], threshold, recall, max(1, group // 2))
    reps = usable.groupBy("vector").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies"))
    number = _number_kind(reps)
    reps = _hashed(reps.select("rep", "copies", "vector", F.size("vector").alias("dim"), *names), p)
    # different vectors may share their least id: a number tells them apart
    reps = checkpointed(reps.withColumn("no", F.monotonically_increasing_id()))
    width = _key_kind(p)().itemsize
    place = F.explode(F.sequence(F.lit(0), F.lit(p.tables - 1))).alias("place")
    sizes = reps.select("dim", "sign", place).select("place", "dim", F.expr(f"substring(sign, place * {width} + 1, {width})").alias("bucket"))
    blocks = F.ceil(F.col("n") / F.least(F.lit(BLOCK), F.greatest(F.lit(1), F.expr(f"{BLOCK_VALUES} div dim")))).cast("int")
    sizes = checkpointed(sizes.groupBy("place", "dim", "bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1").withColumn("blocks", blocks))
    widths = sizes.groupBy("place", "blocks").agg(F.sum("n").alias("rows"), F.count(F.lit(1)).alias("buckets")).collect()
    buckets = Counter()
    for w in widths:
        buckets[w["place"]] += w["buckets"]
    n, values = reps.agg(F.count(F.lit(1)), F.coalesce(F.sum("dim"), F.lit(0))).first()
    limit = max(1.25 * n, ROUND_BYTES / (4 * values / max(n, 1) + 8 * 16))
    found = usable.sparkSession.createDataFrame([], LINKS)
    held = 0
    for turns in _rounds([(w["place"], w["blocks"], w["rows"]) for w in widths], limit):
        places = [t[0] for t in turns]
        mine = sizes.where(F.col("place").isin(places)).select("place", "dim", "bucket", "blocks")
        mine = F.broadcast(mine) if sum(buckets[x] for x in places) <= BROADCAST_ROWS else mine
        new = _dealt(reps, mine, width, turns).mapInArrow(_compare(threshold, p, number), LINKS)
        new = checkpointed(new.groupBy("no", "u", "v").agg(F.sum("links").alias("links")))
        found, held = found.unionByName(new), held + new.count()
        if held > 2 * n:
            found = checkpointed(_settled(found))
            held = found.count()
    joined = components(found.select("u", "v")).withColumnRenamed("vertex", "rep")
    links = found.groupBy("no").agg(F.sum("links").alias("links"))
    reps = reps.select("no", "rep", "copies", "name", "name2").join(links, "no", "left").join(joined, "rep", "left")
    return checkpointed(reps.select("name", "name2", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component_id")))


def _settled(found: DataFrame) -> DataFrame:
    """The same counts and components in few rows: a sum for each vector, a star for each component."""
    stars = components(found.select("u", "v")).select(F.lit(-1).cast("long").alias("no"), F.col("vertex").alias("u"), F.col("component").alias("v"), F.lit(0).cast("long").alias("links"))
    nowhere = F.lit(0).cast("long")
    sums = found.where("no >= 0").groupBy("no").agg(F.sum("links").alias("links")).select("no", nowhere.alias("u"), nowhere.alias("v"), "links")
    return sums.unionByName(stars)
