"""Groups of spelling variants: each word's near words and its more frequent form.

Two words are near if one inserted, deleted or replaced code point turns one into the
other. Of two near words the first half or the rest of the shorter one is untouched, so
words meet in buckets of equal halves. Within a bucket nobody compares words with words:
the bucket is a bit-sliced index, one bitset over its words for each (position, letter),
and a word is looked up by recurrences over whole bitsets that carry the words reached
without an error and those reached with one, at equal or at shifted positions.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexispan.llm.common import cells_for, checkpointed
from lexispan.llm.words import slices

RUN = r"[A-Za-zÀ-ÿ]+"
LEAST_LENGTH = 7  # code points of a word
LEAST_COUNT = 2  # occurrences of a word
FORM_TIMES = 10  # how much more frequent a form is than its variant
VARIANT_EVERY = 31  # a run loses a code point where this divides its checksum
BLOCK_WORDS = 4096  # words of one bit-sliced index
USUAL_LENGTH = 32  # code points; of longer words a block has fewer
CELL_ROWS = 100_000  # rows of buckets dealt to one task
PAIR_WORDS = 1 << 18  # (looked-up word, 64 indexed words) pairs worked on at a time
COUNTED_WORDS = 1 << 18  # distinct words that a task counts before it hands them on
SLICE_BYTES = 2 << 20

_FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def count_words(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``word, n``: occurrences of each word of at least 7 code points in all texts.

    Words are runs of Latin letters with A to Z lower-cased. A run in whose document
    (``<doc_id>:<run>``, a null id counting as the empty text) 31 divides the checksum loses
    the code point that the checksum picks. Tasks count what they read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, counts = re.compile(RUN).findall, {}

        def told() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])

        for b in batches:
            for at, size in slices(b.column(1), SLICE_BYTES):
                for doc, text in zip(b.column(0).slice(at, size).to_pylist(), b.column(1).slice(at, size).to_pylist(), strict=True):
                    own: dict[str, int] = {}
                    for w in find(text or ""):
                        own[w] = own.get(w, 0) + 1
                    start = zlib.crc32(f"{'' if doc is None else doc}:".encode())
                    for w, n in own.items():
                        if len(w) < LEAST_LENGTH:
                            continue
                        w = w.lower() if w.isascii() else w.translate(_FOLD)
                        h = zlib.crc32(w.encode(), start)
                        if h % VARIANT_EVERY == 0:
                            k = h % len(w)
                            w = w[:k] + w[k + 1 :]
                            if len(w) < LEAST_LENGTH:
                                continue
                        counts[w] = counts.get(w, 0) + n
                    if len(counts) >= COUNTED_WORDS:
                        yield told()
                        counts.clear()
        yield told()

    rows = df.select(F.col(id_col).cast("string"), F.col(text_col)).mapInArrow(run, "word string, n long")
    return rows.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)


# --- the bit-sliced index


def _bits(rows: np.ndarray, shape: tuple[int, ...]) -> np.ndarray:
    """Bitsets of ``shape[-1]`` 64-bit words from (index ..., slot) rows, all distinct."""
    flat = np.ravel_multi_index((*rows[:-1], rows[-1] >> 6), shape)
    out = np.zeros(int(np.prod(shape)), np.uint64)
    np.bitwise_or.at(out, flat, np.uint64(1) << (rows[-1] & 63).astype(np.uint64))
    return out.reshape(shape)


def near_pairs(indexed: list[str], asked: list[str], index_bucket: np.ndarray, asked_bucket: np.ndarray, length: int, skip: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places of asked words, places of indexed words) of all near pairs of one bucket.

    Asked words have ``length`` code points, indexed ones ``length`` or one more; both
    bucket arrays ascend. Pairs whose first ``skip`` code points agree are left out where
    ``skip`` is not 0, because the bucket of that first half has them.
    """
    if not indexed or not asked:
        return
    longest = length + 1
    letters = {c: k for k, c in enumerate(sorted({c for w in indexed for c in w}), 1)}
    sizes = np.array([len(w) for w in indexed])
    text = np.array([letters[c] for w in indexed for c in w])
    slot = np.repeat(np.arange(len(indexed)), sizes)
    place = np.arange(len(text)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    blocks = -(-len(indexed) // 64)
    index = _bits(np.stack([place, text, slot]), (longest, len(letters) + 1, blocks))  # letter 0: not in the index
    same = _bits(np.flatnonzero(sizes == length)[None], (blocks,))
    longer = _bits(np.flatnonzero(sizes == longest)[None], (blocks,))
    question = np.array([[letters.get(c, 0) for c in w] for w in asked]).reshape(len(asked), length)

    low, high = np.searchsorted(index_bucket, asked_bucket, "left"), np.searchsorted(index_bucket, asked_bucket, "right")
    first, n_blocks = low >> 6, np.where(high > low, ((high - 1) >> 6) - (low >> 6) + 1, 0)
    ends = np.cumsum(n_blocks)
    at = 0
    while at < len(asked):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIR_WORDS, "right")))
        who = np.repeat(np.arange(at, to), n_blocks[at:to])
        block = np.repeat(first[at:to] - (ends[at:to] - n_blocks[at:to]), n_blocks[at:to]) + np.arange(len(who)) + (ends[at - 1] if at else 0)
        exact = _between(low[who] - block * 64, high[who] - block * 64)  # no error so far
        replaced = inserted = np.zeros(len(who), np.uint64)  # one error so far
        agree = exact
        for i in range(length):
            letter = question[who, i]
            here = index[i, letter, block]
            replaced = (replaced & here) | (exact & ~here)
            inserted = (inserted | exact) & index[i + 1, letter, block]
            exact = exact & here
            if i + 1 == skip:
                agree = exact
        found = (replaced & same[block]) | ((inserted | exact) & longer[block])
        if skip:
            found &= ~agree
        hit = np.flatnonzero(found)
        bit = np.unpackbits(found[hit].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        row, k = np.nonzero(bit)
        yield who[hit][row], block[hit][row] * 64 + k
        at = to


def _between(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """64-bit masks of the places low to high - 1, as far as they lie in 0 to 63."""
    ones = np.uint64(0xFFFFFFFFFFFFFFFF)
    up = lambda n: np.where(n >= 64, ones, (np.uint64(1) << np.clip(n, 0, 63).astype(np.uint64)) - np.uint64(1))
    return up(high) & ~up(low)


def _halves(word: Column, length: Column) -> Column:
    """The two halves by which words meet whose shorter one has ``length`` code points:
    (is it the first half, the half)."""
    half = F.floor(length / 2).cast("int")
    rest = (length - half).cast("int")
    return F.array(F.struct(F.lit(True).alias("front"), F.substring(word, F.lit(1), half).alias("half")), F.struct(F.lit(False).alias("front"), F.right(word, rest).alias("half")))


def near_words(words: DataFrame) -> DataFrame:
    """``word, n`` (distinct words) -> ``word, n_near, form, form_n`` of the words that
    have near words: their number and, of the near word with the largest n (ties: least
    word), word and n.

    Each word is dealt to four buckets, as the shorter and as the longer of a pair. A
    bucket of more than 4,096 words (fewer, if they are long) is dealt out as a grid: each
    block of its words is an index of its own, and each block of its words asks each of
    them, so no task holds it whole.
    """
    length = F.char_length("word")
    met = lambda shorter, of: F.transform(_halves(F.col("word"), of), lambda x: F.struct(of.alias("length"), x["front"].alias("front"), x["half"].alias("half"), F.lit(shorter).alias("asks")))
    rows = words.select("word", "n", F.explode(F.concat(met(True, length), met(False, length - 1))).alias("b")).select("word", "n", "b.*")
    key = ["length", "front", "half"]
    sizes = checkpointed(rows.groupBy(*key).agg(F.count(F.lit(1)).alias("size"), F.count_if("asks").alias("asking")).where("size > 1 AND asking > 0"))
    # buckets with one word have no pairs; those above a block are dealt as grids
    grid = F.ceil(F.col("size") * F.greatest("length", F.lit(USUAL_LENGTH)) / (BLOCK_WORDS * USUAL_LENGTH)).cast("int")
    dealt = rows.join(sizes.select(*key, grid.alias("grid")), key)
    own, every = F.pmod(F.xxhash64("word"), F.col("grid")).cast("int"), F.sequence(F.lit(0), F.col("grid") - 1)
    index = F.transform(every, lambda k: F.struct((own * F.col("grid") + k).alias("block"), F.lit(False).alias("question")))
    asked = F.transform(every, lambda k: F.struct((k * F.col("grid") + own).alias("block"), F.lit(True).alias("question")))
    dealt = dealt.select(*key, "word", "n", F.explode(F.when(F.col("asks"), F.concat(index, asked)).otherwise(index)).alias("g")).select(*key, "word", "n", "g.*")
    cells = cells_for(int(sizes.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]) * 2, CELL_ROWS, words.sparkSession.sparkContext.defaultParallelism)
    dealt = dealt.repartition(cells, *key, "block").sortWithinPartitions("length", "front", "half", "block")
    found = dealt.mapInArrow(_cell, "word string, n_near long, n long, form string, form_n long")
    # of equal n the least word: the smallest (-n, word)
    best = F.min(F.struct((-F.col("form_n")).alias("k"), F.col("form").alias("w")))
    merged = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("best"))
    return merged.select("word", "n_near", F.col("best.w").alias("form"), (-F.col("best.k")).alias("form_n"))


def _cell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Near words of sorted rows ``length, front, half, word, n, block, question``; buckets
    of one length and kind share an index up to 4,096 words."""
    held: list[dict] = []  # whole buckets
    last: list[dict] = []  # the bucket that is still read
    bucket = lambda r: (r["length"], r["front"], r["half"], r["block"])
    for b in batches:
        for r in b.to_pylist():
            if last and bucket(r) != bucket(last[0]):
                if held and (bucket(held[0])[:2] != bucket(last[0])[:2] or len(held) + len(last) > 2 * BLOCK_WORDS or r["length"] * len(held) > 1 << 20):
                    yield _answers(held)
                    held = []
                held += last
                last = []
            last.append(r)
    if held and last and bucket(held[0])[:2] != bucket(last[0])[:2]:
        yield _answers(held)
        held = []
    yield _answers(held + last)


def _answers(rows: list[dict]) -> pa.RecordBatch:
    best: dict[str, list] = {}

    def met(r: dict, other: dict) -> None:
        own = best.setdefault(r["word"], [0, r["n"], other["word"], other["n"]])
        own[0] += 1
        if (-other["n"], other["word"]) < (-own[3], own[2]):
            own[2:] = other["word"], other["n"]

    if rows:
        number: dict[tuple, int] = {}
        of = lambda part: np.array([number.setdefault((r["half"], r["block"]), len(number)) for r in part], np.int64)
        index, asked = [r for r in rows if not r["question"]], [r for r in rows if r["question"]]
        # buckets are numbered as they stand, so both arrays ascend
        for r in rows:
            number.setdefault((r["half"], r["block"]), len(number))
        length, skip = rows[0]["length"], 0 if rows[0]["front"] else rows[0]["length"] // 2
        for a, b in near_pairs([r["word"] for r in index], [r["word"] for r in asked], of(index), of(asked), length, skip):
            for x, y in zip(a.tolist(), b.tolist(), strict=True):
                met(asked[x], index[y])
                if len(index[y]["word"]) > length:  # equal lengths ask each other
                    met(index[y], asked[x])
    columns = [list(best), *([v[k] for v in best.values()] for k in (0, 1, 2, 3))]
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["word", "n_near", "n", "form", "form_n"])


# --- forms


def roots(forms: DataFrame, steps: int) -> DataFrame:
    """``word, form`` -> ``word, root``: forms followed to the last, at most ``steps`` of
    them. Each round doubles the distance."""
    reach = forms.select("word", F.col("form").alias("root"))
    far = 1
    while far < steps:
        onward = reach.select(F.col("word").alias("root"), F.col("root").alias("next"))
        reach = checkpointed(reach.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root")))
        far *= 2
    return reach


def spelling_variants(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of all words of the texts (``count_words``)
    that occur at least twice.

    A word's form is its near word with the largest n (ties: least in code-point order), if
    that n is at least ten times the word's; ``root`` follows forms to the last. Words
    without near words have n_near 0, words without a form null, and they are their own
    root. Null texts have no words; repeated rows count each; extra columns are ignored;
    an empty table gives an empty result.
    """
    words = checkpointed(count_words(df, id_col, text_col))
    near = near_words(words)
    has_form = F.col("form_n") >= FORM_TIMES * F.col("n")
    all_words = checkpointed(words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(has_form, F.col("form")).alias("form"), F.when(has_form, F.col("form_n")).alias("form_n")))
    most = int(words.agg(F.max("n")).first()[0] or 0)
    steps = len(str(most // LEAST_COUNT))  # each step multiplies n by ten at least
    reach = roots(all_words.where("form IS NOT NULL"), steps)
    out = all_words.join(reach, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
