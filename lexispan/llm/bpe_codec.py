"""Byte-level BPE: encoding and decoding of whole texts.

The words that occur most often are compiled, with their ids, into a minimal acyclic
transducer: words with a common beginning share states, and so do words whose rest and
remaining ids agree, because ids are put on arcs as early as they are certain. Its
arrays lie in one file that Spark sends to every machine and tasks map into memory. All
distinct words of a slice of texts walk through it at once; words that it lacks are
merged exactly, pair by pair.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import math
import mmap
import os
import struct
import tempfile
import unicodedata
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import pre_tokenizers

from lexispan.llm.common import checkpointed
from lexispan.llm.words import slices

MODEL_PATH = "/opt/tokenizers/byte_bpe_50k.json"
LEXICON_WORDS = 1 << 16  # words compiled into the transducer
LEXICON_BYTES = 32  # words above this length are merged instead
SLICE_BYTES = 2 << 20  # of text worked on at a time
BLOCK = 1 << 20  # characters of a longer text worked on at a time
CACHE_WORDS = 1 << 17  # merged words that a task remembers
COUNTED_WORDS = 1 << 18  # distinct words that a task counts before it hands them on

#: Kinds of characters: other, letter, number, white space.
OTHER, LETTER, NUMBER, SPACE = range(4)

#: Fixed values of the format: what follows an apostrophe in a word of its own.
CONTRACTIONS = ("s", "t", "m", "d", "re", "ve", "ll")


def character_kinds() -> np.ndarray:
    """The kind of every code point. Unicode assigns more letters and numbers each year;
    for those that this Python's tables lack the installed tokenizers library is asked."""
    kinds = np.full(0x110000, OTHER, np.uint8)
    everything = "".join(map(chr, range(0xD800))) + "\0" * 0x800 + "".join(map(chr, range(0xE000, 0x110000)))
    for pattern, kind in ((r"\p{L}+", LETTER), (r"\p{N}+", NUMBER), (r"\s+", SPACE)):
        for m in regex.finditer(pattern, everything):
            kinds[m.start() : m.end()] = kind
    young = [c for c in np.flatnonzero((kinds == LETTER) | (kinds == NUMBER)).tolist() if unicodedata.category(chr(c)) == "Cn"]
    split = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True).pre_tokenize_str("".join(f"a{chr(c)}1" for c in young))
    ends = {end for _, (_, end) in split}
    kinds[young] = [NUMBER if 3 * k + 2 not in ends else LETTER if 3 * k + 1 not in ends else OTHER for k in range(len(young))]
    return kinds


class BpeModel(NamedTuple):
    tokens: tuple[bytes, ...]  # bytes of each id
    byte_ids: tuple[int, ...]  # id of each single byte
    merges: dict[int, tuple[int, int]]  # left id * len(tokens) + right id -> (rank, id)
    specials: dict[str, int]  # tokens found in texts before anything else
    kinds: np.ndarray


def _letters_of_bytes() -> dict[str, int]:
    """The format writes each byte as one visible character: printable Latin-1 as itself,
    the others as the characters from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(0x100 + k): b for k, b in enumerate(hidden)}


def load_model(source: bytes) -> BpeModel:
    """A model from the bytes of a tokenizer file (JSON, byte-level BPE without options)."""
    spec = json.loads(source)
    model, split = spec["model"], spec["pre_tokenizer"]
    plain = not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
    if model["type"] != "BPE" or split["type"] != "ByteLevel" or split["add_prefix_space"] or not split["use_regex"] or spec["normalizer"] or not plain:
        raise ValueError("only plain byte-level BPE is supported")
    specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
    if any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in spec["added_tokens"]):
        raise ValueError("added tokens with options are not supported")
    byte_of, vocab = _letters_of_bytes(), model["vocab"]
    tokens = [b""] * (1 + max([*vocab.values(), *specials.values()]))
    for token, k in vocab.items():
        tokens[k] = bytes(byte_of[c] for c in token) if all(c in byte_of for c in token) else token.encode()
    for token, k in specials.items():
        tokens[k] = token.encode()
    merges = {}
    for rank, pair in enumerate(model["merges"]):
        a, b = pair.split(" ") if isinstance(pair, str) else pair
        merges.setdefault(vocab[a] * len(tokens) + vocab[b], (rank, vocab[a + b]))
    byte_ids = {b: vocab[c] for c, b in byte_of.items()}
    return BpeModel(tuple(tokens), tuple(byte_ids[b] for b in range(256)), merges, specials, character_kinds())


# --- words of a text


def word_starts(kinds: np.ndarray, codes: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """For each character whether a word begins there; ``edges`` marks where texts begin.

    A word is a run of letters, of numbers or of other characters with at most one blank
    before it, a contraction, or white space; the last blank of a run belongs to what
    follows, and so any other last white space stands alone.
    """
    n = len(codes)
    kind = kinds[codes]
    prior = np.empty(n, np.uint8)
    prior[:1], prior[1:] = SPACE, kind[:-1]
    after_blank = np.zeros(n, bool)
    after_blank[1:] = (codes[:-1] == 0x20) & ~edges[1:]
    ends = np.ones(n, bool)  # a text ends behind the character
    ends[:-1] = edges[1:]
    follows = np.zeros(n, bool)  # something other than white space follows in the text
    follows[:-1] = kind[1:] != SPACE
    follows &= ~ends
    space = kind == SPACE
    starts = edges | np.where(space, (prior != SPACE) | follows, (kind != prior) & ~after_blank)
    quote = np.flatnonzero((codes == 0x27) & starts & follows)
    if len(quote):
        for rest in CONTRACTIONS:
            at = quote[quote + len(rest) < n]
            for k, c in enumerate(rest, 1):
                at = at[(codes[at + k] == ord(c)) & ~edges[at + k]]
            starts[at + 1] = False
            end = at + 1 + len(rest)
            starts[end[end < n]] = True
    return starts


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


def blocks(kinds: np.ndarray, text: str, size: int) -> Iterator[str]:
    """The text in blocks of about ``size`` characters, cut only where a word ends whatever
    stands around it: behind letters, numbers and others before another kind."""
    at = 0
    while len(text) - at > size:
        end, cut = at + size, []
        while not len(cut) and end < len(text):
            kind = kinds[_codes(text[at:end])]
            a, b = kind[:-1], kind[1:]
            cut = np.flatnonzero((a != SPACE) & (a != b) & ~((a == OTHER) & (b != SPACE)))
            end += size
        if not len(cut):
            break
        yield text[at : at + cut[-1] + 1]
        at += int(cut[-1]) + 1
    yield text[at:]


def pieces(model: BpeModel, text: str, size: int = BLOCK) -> Iterator[str | int]:
    """The text as strings that can be worked on alone and ids of special tokens."""
    if not any(s in text for s in model.specials):
        yield from blocks(model.kinds, text, size)
        return
    pattern = "|".join(regex.escape(s) for s in sorted(model.specials, key=len, reverse=True))
    at = 0
    for m in regex.finditer(pattern, text):
        yield from blocks(model.kinds, text[at : m.start()], size)
        yield model.specials[m[0]]
        at = m.end()
    yield from blocks(model.kinds, text[at:], size)


def split_words(kinds: np.ndarray, texts: list[str]) -> tuple[pa.Array, np.ndarray]:
    """(the words of all texts as UTF-8, for each text its first word and the end)."""
    sizes = np.array([len(t) for t in texts], np.int64)
    joined = "".join(texts)
    codes = _codes(joined)
    begin = np.cumsum(sizes) - sizes
    edges = np.zeros(len(codes), bool)
    edges[begin[sizes > 0]] = True
    starts = np.flatnonzero(word_starts(kinds, codes, edges))
    first = np.append(np.searchsorted(starts, begin), len(starts))
    raw = np.frombuffer(joined.encode(), np.uint8)
    if len(raw) != len(codes):
        starts = np.flatnonzero((raw & 0xC0) != 0x80)[starts]
    offsets = np.append(starts, len(raw)).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(raw)]), first


def _texts(column: pa.Array) -> list[str]:
    return [t or "" for t in column.to_pylist()]


def _groups(model: BpeModel, texts: list[str]) -> Iterator[list[tuple[int, str | int]]]:
    """(number of the text, piece) in lists of about a slice's volume."""
    group, held = [], 0
    for k, text in enumerate(texts):
        for piece in pieces(model, text):
            group.append((k, piece))
            held += len(piece) if isinstance(piece, str) else 0
            if held >= SLICE_BYTES:
                yield group
                group, held = [], 0
    yield group


# --- merging


def merge(model: BpeModel, word: bytes) -> list[int]:
    """The ids of a word: the pair of least rank, leftmost first, is merged again and again."""
    ids = [model.byte_ids[b] for b in word]
    if len(ids) > 200:
        return _merge_long(model, ids)
    width, merges, none = len(model.tokens), model.merges, (math.inf, -1)
    found = [merges.get(a * width + b, none) for a, b in zip(ids, ids[1:], strict=False)]
    while found:
        best = min(found)
        if best is none:
            break
        k = found.index(best)
        ids[k : k + 2] = [best[1]]
        del found[k]
        if k:
            found[k - 1] = merges.get(ids[k - 1] * width + best[1], none)
        if k < len(found):
            found[k] = merges.get(best[1] * width + ids[k + 1], none)
    return ids


def _merge_long(model: BpeModel, ids: list[int]) -> list[int]:
    """The same with a heap of pairs and linked places, for words of any length."""
    width, merges, n = len(model.tokens), model.merges, len(ids)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = []

    def offer(a: int) -> None:
        b = after[a] if a >= 0 else n
        if a >= 0 and b < n and (m := merges.get(ids[a] * width + ids[b])):
            heapq.heappush(heap, (m[0], a, ids[a], ids[b], m[1]))

    for a in range(n):
        offer(a)
    while heap:
        _, a, left, right, new = heapq.heappop(heap)
        b = after[a]
        if ids[a] != left or b >= n or ids[b] != right:
            continue  # one of the two has been merged meanwhile
        ids[a], ids[b] = new, -1
        after[a] = after[b]
        if after[b] < n:
            before[after[b]] = a
        offer(before[a])
        offer(a)
    return [x for x in ids if x >= 0]


# --- the transducer


def compile_lexicon(entries: dict[bytes, list[int]]) -> bytes:
    """The minimal acyclic transducer of words and their ids, as the bytes of one file:
    a count for each array, then sorted arcs (state * 256 + byte), their targets and
    outputs, the outputs of final states (-1: not final), and the ids that outputs name.
    State 0 is the initial one, output 0 is empty.
    """
    words = sorted(entries)
    register: dict[tuple, int] = {}
    outputs: dict[tuple, int] = {(): 0}

    def state(low: int, high: int, depth: int) -> tuple[tuple, int]:
        """(ids common to the words low to high, which agree up to depth; the state that
        stands for them when those ids are out already)."""
        final, below = None, []
        if len(words[low]) == depth:
            final = tuple(entries[words[low]])
            low += 1
        while low < high:
            byte, end = words[low][depth], low
            while end < high and words[end][depth] == byte:
                end += 1
            below.append((byte, *state(low, end, depth + 1)))
            low = end
        found = [out for _, out, _ in below] + [final] * (final is not None)
        common = () if depth == 0 else found[0][: next((k for k, x in enumerate(zip(*found, strict=False)) if len(set(x)) > 1), min(map(len, found)))]
        cut = len(common)
        name = lambda out: outputs.setdefault(out[cut:], len(outputs))
        signature = (-1 if final is None else name(final), tuple((byte, name(out), target) for byte, out, target in below))
        return common, register.setdefault(signature, len(register))

    root = state(0, len(words), 0)[1] if words else register.setdefault((-1, ()), 0)
    number = {k: k for k in range(len(register))} | {root: 0, 0: root}  # the root takes 0
    keys, targets, outs, finals = [], [], [], [-1] * len(register)
    for (final, arcs), k in register.items():
        finals[number[k]] = final
        for byte, out, target in arcs:
            keys.append(number[k] * 256 + byte)
            targets.append(number[target])
            outs.append(out)
    order = np.argsort(np.array(keys, np.int64), kind="stable")
    ends = np.cumsum([len(x) for x in outputs])
    arrays = [np.array(keys, np.int64)[order], np.array(targets, np.int64)[order], np.array(outs, np.int64)[order], np.array(finals, np.int64), np.append(0, ends), np.array([i for x in outputs for i in x], np.int64)]
    return struct.pack("<6q", *map(len, arrays)) + b"".join(a.astype("<i4").tobytes() for a in arrays)


class Transducer:
    """A compiled lexicon over a buffer, for example a mapped file."""

    def __init__(self, buffer: bytes | mmap.mmap) -> None:
        sizes, at, arrays = struct.unpack_from("<6q", buffer), 48, []
        for n in sizes:
            arrays.append(np.frombuffer(buffer, "<i4", n, at))
            at += 4 * n
        self.keys, self.targets, self.outs, self.finals, self.output_ends, self.ids = arrays

    @classmethod
    def mapped(cls, path: str) -> Transducer:
        with open(path, "rb") as f:
            return cls(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ))

    def find(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(which words it holds, how many ids each has, the ids of those it holds)."""
        n = len(words)
        _, offsets, data = words.buffers()
        offset = np.frombuffer(offsets, np.int32, n + 1, 4 * words.offset)
        data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
        size = np.diff(offset)
        state = np.zeros(n, np.int32)
        now = np.flatnonzero((size > 0) & (size <= LEXICON_BYTES)) if len(self.keys) else np.zeros(0, np.int64)
        said: list[tuple[np.ndarray, np.ndarray]] = []
        held = np.zeros(n, bool)
        depth = 0
        while len(now):
            key = state[now] * 256 + data[offset[now] + depth]
            arc = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = self.keys[arc] == key
            now, arc = now[hit], arc[hit]
            state[now] = self.targets[arc]
            said.append((now, self.outs[arc]))
            depth += 1
            done = now[size[now] == depth]
            held[done] = self.finals[state[done]] >= 0
            now = now[size[now] > depth]
        whole = np.flatnonzero(held)
        said.append((whole, self.finals[state[whole]]))
        word, out = (np.concatenate(x) for x in zip(*said, strict=True))
        told = held[word] & (out > 0)
        order = np.argsort(word[told], kind="stable")  # depths ascend within a word
        word, out = word[told][order], out[told][order]
        length = self.output_ends[out + 1] - self.output_ends[out]
        counts = np.bincount(word, weights=length, minlength=n).astype(np.int64)
        return held, counts, self.ids[ranges(self.output_ends[out], length)]


def ranges(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... for ``length[0]`` places, then those of start[1], ..."""
    ends = np.cumsum(length)
    total = int(ends[-1]) if len(ends) else 0
    return np.repeat(start - (ends - length), length) + np.arange(total)


class Encoder:
    def __init__(self, model: BpeModel, lexicon: Transducer) -> None:
        self.model, self.lexicon = model, lexicon
        self.cache: dict[bytes, list[int]] = {}

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(the ids of all texts, for each text its first place and the end)."""
        parts, counts = [], np.zeros(len(texts), np.int64)
        for group in _groups(self.model, texts):
            ids, ends = self._ids([p if isinstance(p, str) else "" for _, p in group])
            sizes = np.diff(ends)
            special = [k for k, (_, p) in enumerate(group) if not isinstance(p, str)]
            ids = np.insert(ids, ends[special], [group[k][1] for k in special])
            sizes[special] = 1
            np.add.at(counts, [k for k, _ in group], sizes)
            parts.append(ids.astype("<u4"))
        return np.concatenate(parts), np.append(0, np.cumsum(counts))

    def _ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        words, first = split_words(self.model.kinds, texts)
        coded = words.dictionary_encode()
        codes, distinct = coded.indices.to_numpy(zero_copy_only=False), coded.dictionary
        held, counts, ids = self.lexicon.find(distinct)
        start = np.cumsum(counts) - counts
        rest = np.flatnonzero(~held)
        merged = [self._merged(w) for w in distinct.take(pa.array(rest)).to_pylist()]
        counts[rest] = [len(x) for x in merged]
        start[rest] = len(ids) + np.cumsum(counts[rest]) - counts[rest]
        pool = np.concatenate([ids, np.array([i for x in merged for i in x], np.int32)])
        length = counts[codes]
        ends = np.append(0, np.cumsum(length))
        return pool[ranges(start[codes], length)], ends[first]

    def _merged(self, word: bytes) -> list[int]:
        if len(word) > 64:
            return merge(self.model, word)
        ids = self.cache.get(word)
        if ids is None:
            if len(self.cache) >= CACHE_WORDS:
                self.cache.clear()
            ids = self.cache[word] = merge(self.model, word)
        return ids


def decode(model: BpeModel, ids: np.ndarray) -> str:
    """The text of ids; ids that the model lacks are left out, bytes that are no UTF-8
    become U+FFFD."""
    raw = np.frombuffer(b"".join(model.tokens), np.uint8)
    ends = np.cumsum([len(t) for t in model.tokens])
    return Decoder(raw, ends).decode(ids)


class Decoder(NamedTuple):
    raw: np.ndarray
    ends: np.ndarray  # where each token's bytes end

    def decode(self, ids: np.ndarray) -> str:
        out = []
        for at in range(0, len(ids), BLOCK):
            part = ids[at : at + BLOCK].astype(np.int64)
            part = part[part < len(self.ends)]
            start = np.where(part > 0, self.ends[part - 1], 0)
            out.append(self.raw[ranges(start, self.ends[part] - start)].tobytes())
        return b"".join(out).decode("utf-8", "replace")


# --- over tables


def count_words(df: DataFrame, model: BpeModel, text_col: str = "text") -> DataFrame:
    """``word`` (UTF-8), ``n``: how often each word occurs in all texts. Tasks count what
    they read and hand on one row a distinct word, at the latest after 262,144 of them."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, counts = shared.value, {}

        def told() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])

        for b in batches:
            for at, n in slices(b.column(0), SLICE_BYTES):
                for group in _groups(model, _texts(b.column(0).slice(at, n))):
                    words, _ = split_words(model.kinds, [p for _, p in group if isinstance(p, str)])
                    found = words.value_counts()
                    for w, k in zip(found.field(0).to_pylist(), found.field(1).to_pylist(), strict=True):
                        counts[w] = counts.get(w, 0) + k
                    if len(counts) >= COUNTED_WORDS:
                        yield told()
                        counts.clear()
        yield told()

    return df.select(F.col(text_col)).mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def frequent_words(counts: DataFrame, most: int = LEXICON_WORDS) -> list[bytes]:
    """At most ``most`` words of up to 32 bytes, those that occur most often and at least
    twice: all that occur as often as a cut in steps of an eighth of an octave allows."""
    step = F.floor(F.log2("n") * 8).cast("int")
    counts = checkpointed(counts.where((F.col("n") > 1) & (F.octet_length("word") <= LEXICON_BYTES)).withColumn("step", step))
    cut, total = None, 0
    for row in sorted(counts.groupBy("step").count().collect(), key=lambda r: -r["step"]):  # at most 504 rows
        total += row["count"]
        if total > most:
            break
        cut = row["step"]
    return [] if cut is None else [bytes(r["word"]) for r in counts.where(F.col("step") >= cut).select("word").collect()]


def share_lexicon(df: DataFrame, content: bytes) -> str:
    """Have Spark send the lexicon to every machine that runs tasks, also to those that
    join later; the name of the file there."""
    name = f"lexicon-{hashlib.sha256(content).hexdigest()[:24]}"
    if os.path.exists(SparkFiles.get(name)):  # the same words as in an earlier call
        return name
    path = os.path.join(tempfile.mkdtemp(prefix="lexispan-"), name)  # the driver serves it from here
    with open(path, "wb") as f:
        f.write(content)
    df.sparkSession.sparkContext.addFile(path)
    return name


def encode_documents(df: DataFrame, model: BpeModel, id_col: str = "doc_id", text_col: str = "text", lexicon_words: int = LEXICON_WORDS) -> DataFrame:
    """``doc_id, n_tokens, ids``: the ids as little-endian unsigned 32-bit integers.

    A null or empty text has no ids. Null and repeated document ids are encoded like any
    other row; extra columns, whatever their names, are ignored; an empty table gives an
    empty result. Two readings of the texts: one counts words (one shuffle of distinct
    words and counts), the other encodes without a shuffle. A worker holds one slice of
    texts or one block of a long text; only a single word longer than a block is held
    whole. The words of the lexicon do not change any result.
    """
    kind = df.schema[id_col].dataType.simpleString()
    words = frequent_words(count_words(df, model, text_col), lexicon_words)
    name = share_lexicon(df, compile_lexicon({w: merge(model, w) for w in words}))
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shared.value, Transducer.mapped(SparkFiles.get(name)))
        for b in batches:
            for at, n in slices(b.column(1), SLICE_BYTES):
                ids, ends = encoder.encode(_texts(b.column(1).slice(at, n)))
                packed = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((ends * 4).astype(np.int32)), pa.py_buffer(ids)])
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, n), pa.array(np.diff(ends)), packed], ["doc_id", "n_tokens", "ids"])

    rows = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, n_tokens long, ids binary")


def decode_documents(df: DataFrame, model: BpeModel, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """All columns and ``decoded``: the text of the ids that ``encode_documents`` packs.
    Null decodes to ''; a column named like the new one is replaced."""
    shared = df.sparkSession.sparkContext.broadcast((b"".join(model.tokens), np.cumsum([len(t) for t in model.tokens])))
    kept = [f for f in df.schema.fields if f.name != text_col]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), f"`{text_col}` string"])
    place = [f.name for f in kept].index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(np.frombuffer(shared.value[0], np.uint8), shared.value[1])
        for b in batches:
            for at, n in slices(b.column(place), SLICE_BYTES):
                part = b.slice(at, n)
                texts = [decoder.decode(np.frombuffer(x.as_py() or b"", "<u4")) for x in part.column(place)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], [*part.schema.names, text_col])

    return df.select([f.name for f in kept]).mapInArrow(run, schema)
