"""MinHash near-dedup with DartMinHash signatures and exact verification.

Sketching. A document is the multiset of its five-word shingles; a shingle that
occurs c times is a region of weight c. Darts are thrown by hashing into the plane
(weight x rank) of every shingle, one Poisson process of unit rate for each unit
slab of weight, the same for every document that holds the slab. Each dart falls on
one of the signature's coordinates, and a coordinate keeps its earliest (lowest
rank) dart. About k ln k darts are thrown in all, however long the document is: the
rank limit falls as the weight grows. Two signatures agree in a coordinate with
probability equal to the weighted Jaccard similarity.

Joining. Coordinates are banded; documents that share a band are joined to the
least document of the band's bucket, and the components of these candidate links
are verified with exact weighted Jaccard similarities, so no link below the
threshold joins documents. Equal word sequences are collapsed before, and inside a
candidate component only the pairs that can still connect classes are compared.
Large components are verified in blocks by many tasks. A vertex is a word sequence,
so texts that share an id are different vertices.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexispan.llm import words as W
from lexispan.llm.common import checkpointed
from lexispan.llm.components import components

SHINGLE = 5
THRESHOLD = 0.8
BANDS, ROWS = 25, 5  # a pair at the threshold is missed with probability 5e-5
BLOCK_WORDS = 500_000  # words of a candidate component verified at once
BROADCAST_ROWS = 500_000  # ids (8 bytes each) that may be broadcast
SLICE_BYTES = 2 << 20  # text sketched at a time
U = np.uint64


def shingles(texts: pa.ChunkedArray, n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray, W.Words]:
    """(hash, text index, occurrence number within its text) of all shingles.

    A text of one to n - 1 words is one shingle; words are lower-cased A-Z, and
    punctuation separates them.
    """
    buf, offsets = W.text_buffer(texts)
    w = W.words(buf, offsets, W.letter_words())
    doc = w.doc()
    h, at = W.grams(w, n)
    d = doc[at]
    length = np.diff(w.first)
    for m in range(1, n):
        short = np.flatnonzero(length == m)
        if len(short):
            hm, am = W.grams(w, m)
            keep = np.isin(am, w.first[short])
            h, d = np.append(h, hm[keep]), np.append(d, doc[am[keep]])
    order = np.lexsort((h, d))
    h, d = h[order], d[order]
    head = np.ones(len(h), bool)
    head[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
    starts = np.flatnonzero(head)
    occurrence = np.arange(len(h)) - np.repeat(starts, np.diff(np.append(starts, len(h))))
    return h, d, occurrence, w


def _uniform(h: np.ndarray) -> np.ndarray:
    return ((h >> U(11)).astype(np.float64) + 0.5) * 2.0**-53


def dart_minhash(h: np.ndarray, doc: np.ndarray, slab: np.ndarray, n_docs: int, k: int, part: np.ndarray | None = None) -> np.ndarray:
    """Signatures, n_docs x k, of weighted sets given as slabs of weight.

    Row i says that text ``doc[i]`` holds slab number ``slab[i]`` of element ``h[i]``;
    ``part`` is the share of the slab that its weight covers (1 for whole slabs).
    Coordinates that found no dart below the rank limit get more: the limit of their
    texts is doubled until every coordinate has one. Texts without elements keep 0.
    """
    sign = np.zeros((n_docs, k), U)
    rank = np.full((n_docs, k), np.inf)
    if not len(h):
        return sign
    part = np.ones(len(h)) if part is None else part
    weight = np.bincount(doc, weights=part, minlength=n_docs)
    limit = np.where(weight > 0, k * (np.log(k) + 3) / np.maximum(weight, 1e-300), 0.0)
    todo = np.flatnonzero(weight > 0)
    seed = W.mix(h + slab.astype(U) * U(0x9E3779B97F4A7C15))
    active = np.ones(len(h), bool)
    while len(todo):
        sign[todo], rank[todo] = 0, np.inf
        live = np.flatnonzero(active)
        r = np.zeros(len(live))
        state = seed[live]
        while len(live):
            state = W.mix(state + U(0xD1B54A32D192ED03))
            r = r - np.log(_uniform(state))
            keep = r <= limit[doc[live]]
            live, r, state = live[keep], r[keep], state[keep]
            if not len(live):
                break
            dart = W.mix(state ^ U(0x8CB92BA72F3D8DD7))
            hit = _uniform(W.mix(state ^ U(0x3C6EF372FE94F82B))) < part[live]
            _earliest(sign, rank, doc[live[hit]], (dart[hit] % U(k)).astype(np.int64), r[hit], dart[hit])
        todo = todo[np.isinf(rank[todo]).any(axis=1)]
        limit[todo] *= 2
        again = np.zeros(n_docs, bool)
        again[todo] = True
        active = again[doc]
    return sign


def _earliest(sign: np.ndarray, rank: np.ndarray, doc: np.ndarray, coordinate: np.ndarray, r: np.ndarray, dart: np.ndarray) -> None:
    k = sign.shape[1]
    at = doc * k + coordinate
    order = np.lexsort((r, at))
    at, r, dart = at[order], r[order], dart[order]
    first = np.ones(len(at), bool)
    first[1:] = at[1:] != at[:-1]
    at, r, dart = at[first], r[first], dart[first]
    flat_rank, flat_sign = rank.reshape(-1), sign.reshape(-1)
    better = r < flat_rank[at]
    flat_rank[at[better]], flat_sign[at[better]] = r[better], dart[better]


def _sketch(bands: int, rows: int, shingle: int):
    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "row_key", "f1", "f2", "n_words", "bands"]
        for b in batches:
            for at, n in W.slices(b.column(2), SLICE_BYTES):
                texts = b.column(2).slice(at, n)
                h, d, occurrence, w = shingles(texts, shingle)
                sign = dart_minhash(h, d, occurrence, n, bands * rows)
                base = np.arange(1, rows + 1, dtype=U) * U(0x9E3779B97F4A7C15) + U(1)
                keys = W.mix((sign.reshape(n, bands, rows) * base).sum(axis=2, dtype=U) + np.arange(bands, dtype=U))
                length = np.diff(w.first)
                f = [_fingerprint(w, salt) for salt in (0x2545F4914F6CDD1D, 0x9FB21C651E98DF25)]
                lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * bands, pa.int32()), pa.array(keys.reshape(-1).view(np.int64)))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, n), b.column(1).slice(at, n), *(pa.array(x.view(np.int64)) for x in f), pa.array(length, pa.int64()), lists], names)

    return sketch


def _fingerprint(w: W.Words, salt: int) -> np.ndarray:
    """A hash of each text's word sequence."""
    place = (np.arange(len(w.hash)) - w.first[w.doc()]).astype(U)
    mixed = np.zeros(len(w.hash) + 1, U)
    np.cumsum(W.mix(w.hash ^ W.mix(place + U(salt))), dtype=U, out=mixed[1:])
    return W.mix(mixed[w.first[1:]] - mixed[w.first[:-1]] + U(salt))


class _Sets:
    """Shingle multisets of a group of documents, for exact similarities."""

    def __init__(self, texts: pa.ChunkedArray, shingle: int) -> None:
        h, d, occurrence, _ = shingles(texts, shingle)
        self.key = W.mix(h + occurrence.astype(U) * U(0xC2B2AE3D27D4EB4F))  # a multiset as a set
        order = np.lexsort((self.key, d))
        self.key, d = self.key[order], d[order]
        self.first = np.searchsorted(d, np.arange(len(texts) + 1))
        self.size = np.diff(self.first)

    def similar(self, k: int, other: _Sets, threshold: float) -> np.ndarray:
        """Which documents of ``other`` reach the threshold with document k."""
        own = self.key[self.first[k] : self.first[k + 1]]
        if not len(own) or not len(other.key):
            return np.zeros(len(other.size), bool)
        at = np.minimum(np.searchsorted(own, other.key), len(own) - 1)
        common = np.append(0, np.cumsum(own[at] == other.key))
        both = common[other.first[1:]] - common[other.first[:-1]]
        return both >= threshold * (len(own) + other.size - both) - 1e-9


def _connect(sets: _Sets, threshold: float) -> np.ndarray:
    """Class (least index) of each document of a group: exact components. Each
    document outside the largest class so far is compared with all others, so every
    pair that could join two classes is looked at."""
    n = len(sets.size)
    parent = np.arange(n)
    done = np.zeros(n, bool)
    k = 0
    while True:
        linked = np.flatnonzero(sets.similar(k, sets, threshold))
        done[k] = True
        joined = np.isin(parent, np.append(parent[linked], parent[k]))
        parent[joined] = parent[joined].min()
        largest = np.bincount(parent, minlength=n).argmax()
        rest = np.flatnonzero(~done & (parent != largest))
        if not len(rest):
            return parent
        k = int(rest[0])


def _stream(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Whole groups of a stream that is sorted by ``key``."""
    kept: pa.Table | None = None
    for b in batches:
        t = pa.Table.from_batches([b])
        if kept is not None:
            t = pa.concat_tables([kept, t])
        if not t.num_rows:
            continue
        keys = t[key].to_numpy()
        cuts = np.append(0, np.flatnonzero(keys[1:] != keys[:-1]) + 1)
        for a, z in zip(cuts[:-1], cuts[1:], strict=True):
            yield t.slice(a, z - a)
        kept = t.slice(cuts[-1])
    if kept is not None and kept.num_rows:
        yield kept


_LINKS = "u long, v long"


def _links(u: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])


def _verify_small(members: DataFrame, shingle: int, threshold: float) -> DataFrame:
    """Links (to the class's least document) inside components of bounded size."""

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _stream(batches, "component"):
            t = t.sort_by("doc_id")
            ids = t["doc_id"].to_numpy()
            parent = _connect(_Sets(t["text"], shingle), threshold)
            own = np.flatnonzero(parent != np.arange(len(ids)))
            yield _links(ids[own], ids[parent[own]])

    parts = members.repartition("component").sortWithinPartitions("component").select("component", "doc_id", "text")
    return parts.mapInArrow(verify, _LINKS)


def _verify_large(members: DataFrame, shingle: int, threshold: float) -> DataFrame:
    """Links inside components above the block size, exact as well: every member is
    compared with the component's least document; members outside that class meet
    all blocks of the component."""
    members = checkpointed(members)
    pivot = members.groupBy("component").agg(F.min_by(F.struct("doc_id", "text"), "doc_id").alias("p"), F.sum("n_words").alias("w"))
    pivot = pivot.select("component", F.col("p.doc_id").alias("pivot"), F.col("p.text").alias("pivot_text"), F.ceil(F.col("w") / BLOCK_WORDS).cast("int").alias("blocks"))
    pivot = checkpointed(pivot)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            t = pa.Table.from_batches([b]).sort_by("pivot")
            keys = t["pivot"].to_numpy()
            cuts = np.flatnonzero(np.diff(keys, prepend=-1, append=-1)) if len(keys) else np.zeros(1, int)
            for a, z in zip(cuts[:-1], cuts[1:], strict=True):
                part = t.slice(a, z - a)
                yes = _Sets(part["pivot_text"].slice(0, 1), shingle).similar(0, _Sets(part["text"], shingle), threshold)
                yield pa.RecordBatch.from_arrays([part["doc_id"].combine_chunks(), pa.array(yes)], ["doc_id", "linked"])

    # there are fewer large components than (words of all members) / BLOCK_WORDS
    with_pivot = members.join(pivot, "component").select("pivot", "pivot_text", "doc_id", "text")
    linked = checkpointed(with_pivot.mapInArrow(compare, "doc_id long, linked boolean"))
    star = members.join(linked.where("linked"), "doc_id").join(pivot.select("component", "pivot"), "component").select(F.col("doc_id").alias("u"), F.col("pivot").alias("v"))
    rest = members.join(linked.where("not linked").select("doc_id"), "doc_id", "left_semi")
    blocked = members.join(pivot.select("component", "blocks"), "component").withColumn("block", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int"))
    asking = rest.groupBy("component").agg(F.ceil(F.sum("n_words") / BLOCK_WORDS).cast("int").alias("asks"))
    rest = rest.join(asking, "component").join(pivot.select("component", "blocks"), "component")
    rest = rest.withColumn("ask", F.pmod(F.xxhash64("doc_id"), F.col("asks")).cast("int"))
    left = rest.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("component", "ask", "block", "doc_id", "text", F.lit(True).alias("asks"))
    right = blocked.join(asking, "component").withColumn("ask", F.explode(F.sequence(F.lit(0), F.col("asks") - 1))).select("component", "ask", "block", "doc_id", "text", F.lit(False).alias("asks"))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _stream(batches, "task"):
            asks = t["asks"].to_numpy()
            a, b = t.filter(pa.array(asks)), t.filter(pa.array(~asks))
            if not a.num_rows or not b.num_rows:
                continue
            left, right = _Sets(a["text"], shingle), _Sets(b["text"], shingle)
            ids, others = a["doc_id"].to_numpy(), b["doc_id"].to_numpy()
            for k in range(len(ids)):
                found = others[left.similar(k, right, threshold)]
                found = found[found != ids[k]]
                yield _links(np.full(len(found), ids[k]), found)

    tasks = left.unionByName(right).withColumn("task", F.xxhash64("component", "ask", "block"))
    tasks = tasks.repartition("task").sortWithinPartitions("task").select("task", "doc_id", "text", "asks")
    return star.where("u <> v").unionByName(tasks.mapInArrow(verify, _LINKS))


def _numbered(same: DataFrame) -> DataFrame:
    """Adds ``vertex``: the least document of a word sequence. Of several word sequences
    with the same one, all but the first get a hash as their number."""
    shared = same.groupBy("rep").agg(F.min(F.struct("f1", "f2", "n_words")).alias("owner"), F.count(F.lit(1)).alias("n")).where("n > 1").select("rep", "owner")
    shared = checkpointed(shared)
    n_shared = shared.count()
    if not n_shared:
        return same.withColumn("vertex", F.col("rep"))
    if n_shared <= BROADCAST_ROWS:
        shared = F.broadcast(shared)
    number = F.when(F.col("owner").isNull() | (F.col("owner") == F.struct("f1", "f2", "n_words")), F.col("rep")).otherwise(F.xxhash64("f1", "f2", "n_words"))
    return checkpointed(same.join(shared, "rep", "left").withColumn("vertex", number).drop("owner"))


def row_key(doc_id: Column, text: Column) -> Column:
    """One key for the rows with an id and a text; a null text counts as an empty one."""
    return F.xxhash64(doc_id.cast("long"), F.coalesce(text, F.lit("")))


def near_duplicates(df: DataFrame, threshold: float = THRESHOLD, shingle: int = SHINGLE, bands: int = BANDS, rows: int = ROWS, id_col: str = "doc_id", text_col: str = "text", keyed: bool = False) -> DataFrame:
    """``doc_id, class_id, class_size, kept, n_words`` for every row and, if asked for,
    its ``row_key``.

    A class is a connected component of the links with weighted Jaccard similarity
    of at least ``threshold`` over word shingles; its id is its least ``doc_id``, the
    one document that is kept. Words are runs of 0-9, a-z and non-ASCII characters,
    lower-cased A-Z. Texts without words (null and empty ones too) and rows with a
    null id are alone in their class. The vertices are word sequences, so different
    texts that share an id have each their own class; classes may then share an id,
    and of near copies with the least id one word sequence is kept. Extra columns are
    ignored; an empty table gives an empty result.
    """
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    docs = docs.select("doc_id", row_key(F.col("doc_id"), F.col("text")).alias("row_key"), "text")
    sketches = checkpointed(docs.mapInArrow(_sketch(bands, rows, shingle), "doc_id long, row_key long, f1 long, f2 long, n_words long, bands array<long>"))
    usable = sketches.where("n_words > 0 AND doc_id IS NOT NULL")
    # equal word sequences meet first; partial aggregation keeps one row a task
    same = usable.groupBy("f1", "f2", "n_words").agg(F.min(F.struct("doc_id", "row_key")).alias("rep"), F.first("bands").alias("bands"))
    same = checkpointed(same.select("f1", "f2", "n_words", F.col("rep.doc_id").alias("rep"), F.col("rep.row_key").alias("row_key"), "bands"))
    same = _numbered(same)
    banded = same.select("vertex", F.posexplode("bands").alias("band", "key"))
    hubs = banded.groupBy("band", "key").agg(F.min("vertex").alias("hub"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    candidates = banded.join(hubs, ["band", "key"]).where("vertex <> hub").select(F.col("vertex").alias("u"), F.col("hub").alias("v")).distinct()
    groups = checkpointed(components(candidates))
    n_members = groups.count()
    small_side = F.broadcast if n_members <= BROADCAST_ROWS else (lambda x: x)
    sized = groups.join(same.select("vertex", "row_key", "n_words"), "vertex")
    weight = sized.groupBy("component").agg(F.sum("n_words").alias("component_words"))
    sized = checkpointed(sized.join(weight, "component"))
    # the text of each vertex's first row; the checks below know a vertex as doc_id
    members = docs.drop("doc_id").join(small_side(sized), "row_key").drop("row_key").withColumnRenamed("vertex", "doc_id").dropDuplicates(["doc_id"])
    small = members.where(F.col("component_words") <= BLOCK_WORDS)
    links = _verify_small(small, shingle, threshold)
    if not sized.where(F.col("component_words") > BLOCK_WORDS).isEmpty():
        large = members.where(F.col("component_words") > BLOCK_WORDS)
        links = links.unionByName(_verify_large(large, shingle, threshold))
    classes = checkpointed(components(links))
    # the least document of each class, and the vertex that holds it
    firsts = classes.join(same.select("vertex", "rep"), "vertex").groupBy("component").agg(F.min(F.struct("rep", "vertex")).alias("first"))
    classes = classes.join(firsts, "component").select("vertex", "component", F.col("first.rep").alias("class_id"), (F.col("first.vertex") == F.col("vertex")).alias("first"))
    # every representative's class; then its copies' (hot copies: adaptive skew join)
    reps = same.join(classes, "vertex", "left").select("f1", "f2", "n_words", F.coalesce("component", "vertex").alias("class"), F.coalesce("class_id", "rep").alias("class_id"), F.coalesce("first", F.lit(True)).alias("first"))
    placed = usable.select("doc_id", "row_key", "f1", "f2", "n_words").join(checkpointed(reps).hint("merge"), ["f1", "f2", "n_words"])
    placed = checkpointed(placed.select("doc_id", "row_key", "class", "class_id", "n_words", (F.col("first") & (F.col("doc_id") == F.col("class_id"))).alias("kept")))
    sizes = placed.groupBy("class").agg(F.count(F.lit(1)).alias("class_size"))
    out = placed.join(checkpointed(sizes).hint("merge"), "class").drop("class")
    alone = sketches.where("n_words = 0 OR doc_id IS NULL").select("doc_id", "row_key", F.col("doc_id").alias("class_id"), "n_words", F.lit(1).cast("long").alias("class_size"), F.lit(True).alias("kept"))
    out = out.unionByName(alone)
    return out.select("doc_id", "class_id", "class_size", "kept", "n_words", *["row_key"] * keyed)
