"""SentencePiece encoding and decoding with suffix-array matching.

A text is first cut into chunks that no piece can span (every chunk begins with the
spaces before a word). The distinct chunks of a batch are concatenated into one
string, its suffixes are sorted (to the depth of the longest piece), and every piece
of the vocabulary is binary-searched for its range of occurrences. The occurrences
are the edges of all chunks' lattices; sorted by position they are relaxed:

* unigram models: the best-scoring path, start positions in order (Viterbi);
* merge (BPE) models: two neighbouring symbols join if an edge spans both, the best
  piece of a chunk first and the leftmost of equals, until no edge joins neighbours.

A long chunk (text without spaces) is indexed in overlapping blocks first and cut where
no occurrence of a piece spans a boundary of characters: no path or merge crosses such
a place, so the parts are segmented on their own, a block of them at a time.

Both give the ids of the public library for the same model file. Characters outside
every path become byte pieces, where the model has them, or the unknown piece.
"""

from __future__ import annotations

import heapq
import re
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexispan.llm.words import slices

MODEL_PATH = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
BLOCK = 256 << 10  # bytes of distinct chunks indexed at once
MEMORY = 400_000  # chunks remembered by a task
LONG = 256  # symbols of a chunk from which it is merged by a heap
LONG_CHUNK = 16_384  # characters of a chunk from which it is cut at uncrossed places
_SEPARATOR = 0xFE  # never occurs in UTF-8
_NEVER = np.int32(2**31 - 1)


class PieceModel(NamedTuple):
    pieces: list[bytes]  # UTF-8 with the space mark as a plain space; empty: never matched
    scores: np.ndarray
    unigram: bool
    dummy_prefix: bool
    byte_ids: np.ndarray | None  # id of each byte piece
    unk: int
    output: list[bytes]  # what an id decodes to
    apart: bool  # no piece holds a space after another character


def _fields(data: bytes) -> Iterator[tuple[int, bytes | int]]:
    """(number, value) of the fields of a protocol-buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        shift = value = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
            continue
        n = varint() if kind == 2 else {1: 8, 5: 4}[kind]
        yield tag >> 3, data[at : at + n]
        at += n


def load_model(proto: bytes) -> PieceModel:
    """Read a model file: pieces (1), trainer settings (2) and normaliser (3)."""
    pieces, scores, kinds, unigram, prefix = [], [], [], True, True
    for number, value in _fields(proto):
        if number == 1:
            one = dict(_fields(value))
            pieces.append(one[1].decode())
            scores.append(np.frombuffer(one.get(2, b"\0\0\0\0"), "<f4")[0])
            kinds.append(one.get(3, 1))
        elif number == 2:
            kind = dict(_fields(value)).get(3, 1)
            if kind not in (1, 2):
                raise ValueError("only unigram and BPE models are supported")
            unigram = kind == 1
        elif number == 3:
            one = dict(_fields(value))
            prefix = bool(one.get(3, 1))
            if one.get(2) or one.get(4, 1):
                raise ValueError("models that rewrite characters or spaces are not supported")
    plain = [p.replace(SPACE, " ").encode() for p in pieces]
    by_byte = {int(p[3:5], 16): k for k, (p, t) in enumerate(zip(pieces, kinds, strict=True)) if t == 6}
    byte_ids = np.array([by_byte[b] for b in range(256)], np.int32) if len(by_byte) == 256 else None
    if 4 in kinds:
        raise ValueError("models with user-defined pieces are not supported")
    match = [p if t == 1 else b"" for p, t in zip(plain, kinds, strict=True)]
    output = [{1: p, 2: " ⁇ ".encode(), 6: bytes([int(q[3:5], 16)]) if t == 6 else b""}.get(t, b"") for p, q, t in zip(plain, pieces, kinds, strict=True)]
    apart = not any(re.search(rb"[^ ] ", p) for p in match)
    return PieceModel(match, np.array(scores, np.float64), unigram, prefix, byte_ids, kinds.index(2), output, apart)


class Encoder:
    """Encodes batches of texts; remembers the ids of recent chunks."""

    def __init__(self, model: PieceModel) -> None:
        self.model = model
        used = [k for k, p in enumerate(model.pieces) if p]
        used.sort(key=lambda k: model.pieces[k])
        self.depth = max(len(model.pieces[k]) for k in used)
        self.ids = np.array(used, np.int32)
        self.keys = np.array([model.pieces[k] for k in used], f"S{self.depth}")
        self.limits = np.array([model.pieces[k].ljust(self.depth, b"\xff") for k in used], f"S{self.depth}")
        self.lengths = np.array([len(model.pieces[k]) for k in used])
        # rank of a piece when merging: higher scores first, equal scores alike
        self.rank = np.unique(-model.scores[self.ids], return_inverse=True)[1].astype(np.int32)
        self.chunk = re.compile(r" *[^ ]+| +\Z") if model.apart else re.compile(r".+", re.S)
        self.known: dict[str, int] = {}
        self.flat = np.zeros(0, np.int32)
        self.first = np.zeros(1, np.int64)

    def chunks(self, text: str) -> list[str]:
        text = text.replace(SPACE, " ")
        if not text:
            return []
        return self.chunk.findall(" " + text if self.model.dummy_prefix else text)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text."""
        if len(self.known) > MEMORY:
            self.known, self.flat, self.first = {}, np.zeros(0, np.int32), np.zeros(1, np.int64)
        cut = [self.chunks(t) for t in texts]
        new = list(dict.fromkeys(c for cs in cut for c in cs if len(c) < LONG_CHUNK and c not in self.known))
        self._learn(new)
        known, first, flat = self.known, self.first, self.flat
        out = []
        for cs in cut:
            if any(len(c) >= LONG_CHUNK for c in cs):
                out.append(np.concatenate([self._long(c.encode()) if len(c) >= LONG_CHUNK else flat[first[known[c]] : first[known[c] + 1]] for c in cs]))
                continue
            codes = np.array([known[c] for c in cs], np.int64)
            n = first[codes + 1] - first[codes]
            ends = np.cumsum(n)
            at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(first[codes] - (ends - n), n)
            out.append(flat[at])
        return out

    def uncrossed(self, raw: bytes) -> np.ndarray:
        """Places between characters that no occurrence of a piece spans, and both ends."""
        out = [np.zeros(1, np.int64)]
        for at in range(0, len(raw), BLOCK):
            a = max(0, at - self.depth)
            text = np.frombuffer(raw[a : at + BLOCK + self.depth], np.uint8)
            start, piece = self.edges(text)
            n = self.lengths[piece]
            change = np.zeros(len(text) + 1, np.int32)
            np.add.at(change, start + 1, 1)
            np.add.at(change, start + n, -1)
            free = (np.cumsum(change[:-1]) == 0) & ((text & 0xC0) != 0x80)
            place = np.flatnonzero(free) + a
            out.append(place[(place >= max(at, 1)) & (place < at + BLOCK)])
        return np.concatenate([*out, [len(raw)]])

    def _long(self, raw: bytes) -> np.ndarray:
        """Ids of one long chunk, from the parts between uncrossed places."""
        edge = self.uncrossed(raw)
        out, at = [], 0
        while at < len(edge) - 1:
            end = max(at + 1, int(np.searchsorted(edge, edge[at] + BLOCK, "right")) - 1)
            parts = [raw[a:z] for a, z in zip(edge[at:end].tolist(), edge[at + 1 : end + 1].tolist(), strict=True)]
            ids, n = self._segment(parts)
            if self.model.byte_ids is None:  # neighbouring unknown characters are one unknown piece
                first = (np.cumsum(n) - n)[n > 0]
                again = first[(ids[first] == self.model.unk) & (np.append(-1, ids)[first] == self.model.unk)]
                ids = np.delete(ids, again)
                if out and len(ids) and ids[0] == self.model.unk == out[-1][-1]:
                    ids = ids[1:]
            if len(ids):
                out.append(ids)
            at = end
        return np.concatenate(out)

    def _learn(self, chunks: list[str]) -> None:
        raw = [c.encode() for c in chunks]
        parts, at, base = [self.flat], 0, len(self.known)
        counts = []
        while at < len(raw):
            end, size = at, 0
            while end < len(raw) and (end == at or size + len(raw[end]) < BLOCK):
                size += len(raw[end]) + 1
                end += 1
            ids, n = self._segment(raw[at:end])
            parts.append(ids)
            counts.append(n)
            at = end
        self.known.update(zip(chunks, range(base, base + len(chunks)), strict=True))
        self.flat = np.concatenate(parts)
        self.first = np.append(self.first, self.first[-1] + np.cumsum(np.concatenate(counts))) if counts else self.first

    def edges(self, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start, place of the piece in ``ids``) of all occurrences, by start."""
        at = np.flatnonzero((text & 0xC0) != 0x80)
        at = at[text[at] != _SEPARATOR]
        padded = np.append(text, np.full(self.depth, _SEPARATOR, np.uint8))
        windows = np.lib.stride_tricks.sliding_window_view(padded, self.depth)[at]
        suffix = np.ascontiguousarray(windows).view(f"S{self.depth}").reshape(-1)
        order = _suffix_order(windows)
        suffix, at = suffix[order], at[order]
        low, high = np.searchsorted(suffix, self.keys), np.searchsorted(suffix, self.limits)
        n = high - low
        ends = np.cumsum(n)
        start = at[np.arange(ends[-1]) + np.repeat(low - (ends - n), n)]
        piece = np.repeat(np.arange(len(n)), n)
        by_position = np.argsort(start, kind="stable")
        return start[by_position], piece[by_position]

    def _segment(self, raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids of each chunk)."""
        text = np.frombuffer(bytes([_SEPARATOR]).join(raw) + bytes([_SEPARATOR]), np.uint8)
        start, piece = self.edges(text)
        # which piece spans [start, start + length): one cell at most
        table = np.full((len(text), self.depth + 1), -1, np.int32)
        table[start, self.lengths[piece]] = piece
        size = np.array([len(r) for r in raw])
        begin = np.cumsum(size + 1) - size - 1
        symbol = np.flatnonzero(((text & 0xC0) != 0x80) & (text != _SEPARATOR))
        relax = self._best_paths if self.model.unigram else self._merges
        s, e = relax(text, table, symbol, begin, size)
        span = np.where(e - s <= self.depth, table[s, np.minimum(e - s, self.depth)], -1)
        ids = np.where(span >= 0, self.ids[span], self.model.unk).astype(np.int32)
        width = np.ones(len(s), np.int64)
        unknown = span < 0
        if unknown.any() and self.model.byte_ids is not None:
            width[unknown] = (e - s)[unknown]
            place = np.cumsum(width) - width
            out = np.repeat(ids, width)
            inside = np.repeat(unknown, width)
            position = np.repeat(s - place, width) + np.arange(len(out))
            out[inside] = self.model.byte_ids[text[position[inside]]]
            ids = out
        elif unknown.any():  # neighbouring unknown characters are one unknown piece
            chunk = np.searchsorted(begin, s, "right")
            keep = ~(unknown & np.append(False, unknown[:-1] & (chunk[1:] == chunk[:-1])))
            ids, s, width = ids[keep], s[keep], width[keep]
        return ids, np.bincount(np.searchsorted(begin, s, "right") - 1, weights=width, minlength=len(raw)).astype(np.int64)

    def _merges(self, text: np.ndarray, table: np.ndarray, symbol: np.ndarray, begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        chunk = np.searchsorted(begin, symbol, "right") - 1
        end = np.append(symbol[1:], len(text) - 1)
        last = np.append(chunk[1:] != chunk[:-1], True)
        end[last] = (begin + size)[chunk[last]]
        count = np.bincount(chunk, minlength=len(begin))
        done = []
        long = np.flatnonzero(count > LONG)
        for c in long:
            own = chunk == c
            done.append(self._merge_long(table, symbol[own], end[own]))
        live = count[chunk] <= LONG
        s, e, chunk = symbol[live], end[live], chunk[live]

        def rank(left: np.ndarray, right: np.ndarray) -> np.ndarray:
            n = right - left
            p = np.where(n <= self.depth, table[left, np.minimum(n, self.depth)], -1)
            return np.where(p >= 0, self.rank[p], _NEVER)

        join = np.full(len(s), _NEVER, np.int32)  # of a symbol with the next
        same = chunk[1:] == chunk[:-1]
        at = np.flatnonzero(same)
        join[at] = rank(s[at], e[at + 1])
        while len(s):
            head = np.flatnonzero(np.append(True, chunk[1:] != chunk[:-1]))
            width = np.diff(np.append(head, len(s)))
            least = np.minimum.reduceat(join, head)
            stays = np.repeat(least == _NEVER, width)
            if stays.any():
                done.append((s[stays], e[stays]))
                s, e, chunk, join = s[~stays], e[~stays], chunk[~stays], join[~stays]
                continue
            hits = np.flatnonzero(join == np.repeat(least, width))
            own = chunk[hits]
            pick = hits[np.append(True, own[1:] != own[:-1])]  # the leftmost of each chunk
            e[pick] = e[pick + 1]
            keep = np.ones(len(s), bool)
            keep[pick + 1] = False
            now = np.cumsum(keep) - 1
            s, e, chunk, join = s[keep], e[keep], chunk[keep], join[keep]
            for k in (now[pick], now[pick] - 1):
                k = k[k >= 0]
                follow = (k + 1 < len(s)) & (chunk[np.minimum(k + 1, len(s) - 1)] == chunk[k])
                join[k] = _NEVER
                k = k[follow]
                join[k] = rank(s[k], e[k + 1])
        if not done:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        s, e = np.concatenate([d[0] for d in done]), np.concatenate([d[1] for d in done])
        order = np.argsort(s, kind="stable")
        return s[order], e[order]

    def _merge_long(self, table: np.ndarray, s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = len(s)
        start, end, before, after = s.tolist(), e.tolist(), list(range(-1, n - 1)), [*range(1, n), -1]
        heap: list[tuple[int, int, int]] = []

        def offer(k: int) -> None:
            j = after[k]
            if j >= 0 and end[j] - start[k] <= self.depth and (p := table[start[k], end[j] - start[k]]) >= 0:
                heapq.heappush(heap, (int(self.rank[p]), start[k], k, end[j]))

        alive = [True] * n
        for k in range(n):
            offer(k)
        while heap:
            _, _, k, to = heapq.heappop(heap)
            j = after[k]
            if not alive[k] or j < 0 or end[j] != to:
                continue
            end[k], after[k], alive[j] = end[j], after[j], False
            if after[k] >= 0:
                before[after[k]] = k
            offer(k)
            if before[k] >= 0:
                offer(before[k])
        keep = np.array(alive)
        return s[keep], np.array(end)[keep]

    def _best_paths(self, text: np.ndarray, table: np.ndarray, symbol: np.ndarray, begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        scores = self.model.scores[self.ids]
        best = np.full(len(text) + 1, -np.inf)
        back = np.full(len(text) + 1, -1, np.int64)
        best[begin] = 0.0
        unknown = scores.min() - 10.0
        is_symbol = np.zeros(len(text) + 1, bool)
        is_symbol[symbol] = True
        step = np.zeros(len(text) + 1, np.int64)  # bytes of the character
        step[symbol] = np.diff(np.append(symbol, len(text)))
        step[symbol] = np.where(text[np.minimum(symbol + step[symbol] - 1, len(text) - 1)] == _SEPARATOR, step[symbol] - 1, step[symbol])
        lengths = np.unique(self.lengths)
        for t in range(int(size.max(initial=0))):
            at = begin[size > t] + t
            at = at[is_symbol[at]]
            for n in lengths:
                p = table[at, n]
                has = p >= 0
                self._offer(best, back, at[has], at[has] + n, scores[p[has]])
            single = table[at, np.minimum(step[at], self.depth)] < 0
            self._offer(best, back, at[single], at[single] + step[at[single]], np.full(single.sum(), unknown))
        ends, starts = [], []
        now = begin + size
        now = now[size > 0]
        while len(now):
            prior = back[now]
            ends.append(now)
            starts.append(prior)
            now = prior[np.isin(prior, begin, invert=True)]
        if not ends:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        s, e = np.concatenate(starts), np.concatenate(ends)
        order = np.argsort(s, kind="stable")
        return s[order], e[order]

    @staticmethod
    def _offer(best: np.ndarray, back: np.ndarray, start: np.ndarray, end: np.ndarray, gain: np.ndarray) -> None:
        value = best[start] + gain
        better = (value > best[end]) | (back[end] < 0)
        best[end[better]], back[end[better]] = value[better], start[better]


def _suffix_order(windows: np.ndarray) -> np.ndarray:
    """Sorted order of rows of bytes: keys of eight bytes, the first most significant."""
    n, depth = windows.shape
    wide = np.zeros((n, -(-depth // 8) * 8), np.uint8)
    wide[:, :depth] = windows
    return np.lexsort(wide.view(">u8").astype(np.uint64).T[::-1])


def decode(model: PieceModel, ids: np.ndarray) -> str:
    """Text of a sequence of ids; broken byte sequences become U+FFFD."""
    out = model.output
    parts = (b"".join([out[k] for k in ids[a : a + 1_000_000].tolist()]) for a in range(0, len(ids), 1_000_000))
    text = b"".join(parts).decode("utf-8", "replace")
    return text[1:] if model.dummy_prefix and text.startswith(" ") else text


def encode_documents(df: DataFrame, model: PieceModel, id_col: str = "doc_id", text_col: str = "text", digest_only: bool = False) -> DataFrame:
    """``doc_id, n_tokens, ids_crc32, round_trip`` and the ``ids`` themselves, unless
    only the digest is wanted.

    ``ids_crc32`` is the CRC of the ids as little-endian 32-bit integers;
    ``round_trip`` says that decoding gives the text back (texts with U+2581, which
    the format uses for spaces, do not). A null or empty text has no ids. Null and
    repeated ids are encoded like any other row; extra columns are ignored; an empty
    table gives an empty result. No shuffle; a worker holds one slice of texts, its
    chunks and a bounded memory of chunks. Text without spaces is worked on in blocks,
    whatever its length; only a part of it in which pieces overlap without a gap (one
    letter repeated, say) is held whole, at about 170 bytes a byte.
    """
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(model)
        for b in batches:
            for at, n in slices(b.column(1), 4 << 20):
                texts = [t or "" for t in b.column(1).slice(at, n).to_pylist()]
                ids = encoder.encode(texts)
                same = [decode(model, x) == t for x, t in zip(ids, texts, strict=True)]
                columns = {"doc_id": b.column(0).slice(at, n), "n_tokens": pa.array([len(x) for x in ids], pa.int64())}
                columns |= {"ids_crc32": pa.array([zlib.crc32(x.astype("<i4").tobytes()) for x in ids], pa.int64()), "round_trip": pa.array(same, pa.bool_())}
                if not digest_only:
                    ends = np.append(0, np.cumsum([len(x) for x in ids])).astype(np.int32)
                    columns["ids"] = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int32)))
                yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    rows = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_crc32 long, round_trip boolean" + ", ids array<int>" * (not digest_only))


def decode_documents(df: DataFrame, model: PieceModel, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``doc_id, text`` of a table of id sequences; null sequences decode to ''."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [decode(model, np.array(x or [], np.int64)) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return df.select(F.col(id_col).alias("doc_id"), F.col(ids_col).alias("ids")).mapInArrow(run, f"doc_id {kind}, text string")
