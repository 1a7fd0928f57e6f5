"""Toxicity: a linear-chain conditional random field tags toxic spans.

Fitting (on the driver, from a bounded sample of labelled rows): words whose
document frequencies differ between toxic and other documents become the lexicon.
In toxic documents, spans are labelled: tokens of words that point strongly to
toxicity, and up to ``GAP`` tokens between two of them; all other tokens are clean.
Every token has one feature - its word, or for other words their ending, or their
shape - and the field weighs the token's own feature and those of its neighbours, the
start and the transitions between its two states. It is trained by gradient ascent on
the regularised likelihood (forward-backward). A logistic layer maps a document's
aggregated marginals to its score.

Scoring (Spark): forward-backward marginals over all tokens of whole texts, batch by
batch in Arrow; marginals above one half give the offending character offsets. Texts of
more than ``STRETCH`` tokens are cut into columns that are worked on side by side, and the
messages of the chain are carried across them exactly: each column's transfer matrix gives
what enters it from both sides. So one long text is as cheap a token as many short ones.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexispan.llm.words import slices

TOKEN = re.compile(r"\w+")
SAMPLE_ROWS = 4000  # most labelled texts (pieces of longer ones) that the model is fitted on
PIECE_CHARS = 20_000  # labelled texts are cut into pieces of this length for fitting
LEXICON = 5000  # most words with a weight of their own
ENDINGS = 500  # most endings of other words with a weight of their own
GAP = 2  # tokens between two strong words that belong to their span
STRETCH = 2048  # tokens of a text above which it is cut into columns
COLUMN = 256  # tokens of a column
SEGMENT = 128  # tokens of a training sequence
SEQUENCES = 2048  # training sequences worked on at a time
SLICE_BYTES = 4 << 20  # text scored at a time
CELLS = 1 << 19  # padded tokens scored at a time


class Model(NamedTuple):
    lexicon: dict[str, int]  # word -> feature
    endings: dict[str, int]  # last three letters of another word -> feature
    emission: np.ndarray  # log weights of the toxic state for each feature: own, previous, next token's
    start: float  # log weight of beginning in the toxic state
    transition: np.ndarray  # 2 x 2 log weights
    layer: np.ndarray  # logistic weights of the document features


class _Features(dict):
    """Feature of a token: its word, else its ending, else 1 for numbers and 0; remembers
    a bounded number of tokens."""

    def __init__(self, lexicon: dict[str, int], endings: dict[str, int]) -> None:
        self.lexicon, self.endings = lexicon, endings

    def __missing__(self, token: str) -> int:
        if len(self) > 100_000:
            self.clear()
        w = token.lower()
        k = self.lexicon.get(w)
        if k is None:
            k = 1 if w[0].isdigit() else self.endings.get(w[-3:], 0)
        self[token] = k
        return k

    def of(self, text: str) -> np.ndarray:
        if len(text) < 1 << 20:
            return np.array([self[w] for w in TOKEN.findall(text)], np.int32)
        return np.fromiter((self[m[0]] for m in TOKEN.finditer(text)), np.int32)  # no list of words


def _neighbours(ids: np.ndarray, length: np.ndarray, none: int) -> tuple[np.ndarray, np.ndarray]:
    """Features of the previous and the next token; ``none`` outside the sequence."""
    before, after = np.full_like(ids, none), np.full_like(ids, none)
    before[1:] = ids[:-1]
    after[:-1] = ids[1:]
    after[np.maximum(length - 1, 0), np.arange(ids.shape[1])] = none
    return before, after


def _pad(rows: list[np.ndarray], fill: int) -> np.ndarray:
    out = np.full((max(map(len, rows)), len(rows)), fill, np.int32)
    for k, r in enumerate(rows):
        out[: len(r), k] = r
    return out


def marginals(ids: np.ndarray, length: np.ndarray, emission: np.ndarray, start: float, transition: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """P(toxic) of each token, expected transitions, log partition of each column.

    ``ids``: features, time x sequences, padded below; ``length``: of each column;
    ``emission``: weights of the own feature, or of own, previous and next (rows).
    """
    steps, n = ids.shape
    m = np.exp(transition)
    live = np.arange(steps)[:, None] < length[None, :]
    if emission.ndim == 1:
        r = np.exp(emission)[ids]
    else:
        before, after = _neighbours(ids, length, emission.shape[1] - 1)
        r = np.exp(emission[0][ids] + emission[1][before] + emission[2][after])
    a0, a1, scale = np.empty((steps, n)), np.empty((steps, n)), np.ones((steps, n))
    x0, x1 = np.ones(n), np.full(n, np.exp(start))
    for t in range(steps):
        if t:
            x0, x1 = x0 * m[0, 0] + x1 * m[1, 0], x0 * m[0, 1] + x1 * m[1, 1]
        x1 = x1 * r[t]
        s = x0 + x1
        x0, x1 = x0 / s, x1 / s
        a0[t], a1[t], scale[t] = x0, x1, s
    b0, b1 = np.ones(n), np.ones(n)
    p = np.empty((steps, n))
    pairs = np.zeros((2, 2))
    for t in range(steps - 1, -1, -1):
        if t < steps - 1:
            more = live[t + 1]
            c0, c1 = b0 / scale[t + 1], b1 * r[t + 1] / scale[t + 1]
            pairs += np.array([[np.sum(x * m[i, j] * c * more) for j, c in enumerate((c0, c1))] for i, x in enumerate((a0[t], a1[t]))])
            b0 = np.where(more, m[0, 0] * c0 + m[0, 1] * c1, 1.0)
            b1 = np.where(more, m[1, 0] * c0 + m[1, 1] * c1, 1.0)
        u, v = a0[t] * b0, a1[t] * b1
        p[t] = v / (u + v)
    return np.where(live, p, 0.0), pairs, np.where(live, np.log(scale), 0.0).sum(axis=0)


def _train_chain(ids: np.ndarray, length: np.ndarray, tags: np.ndarray, features: int, rounds: int = 80) -> tuple[np.ndarray, float, np.ndarray]:
    """Adam on the likelihood of the tag sequences, with a weak Gaussian prior. The
    emission weights are 3 x (features + 1): own, previous, next; the last is no token."""
    live = np.arange(len(ids))[:, None] < length[None, :]
    width = features + 1

    def counts(part: slice, weight: np.ndarray) -> np.ndarray:
        places = (ids[:, part], *_neighbours(ids[:, part], length[part], features))
        return np.concatenate([np.bincount(x.ravel(), weights=weight.ravel(), minlength=width) for x in places])

    seen_e = counts(slice(None), (live & (tags > 0)).astype(float))
    follow = live[1:]
    seen_t = np.array([[np.sum((tags[:-1] == i) & (tags[1:] == j) & follow) for j in (0, 1)] for i in (0, 1)], float)
    seen_s = float((tags[0] * live[0]).sum())
    del live, follow
    parts = [slice(k, k + SEQUENCES) for k in range(0, len(length), SEQUENCES)]
    size = 3 * width
    w, low, high = np.zeros(size + 5), np.zeros(size + 5), np.zeros(size + 5)
    w[0], w[size] = -2.0, -2.0
    n = len(length)
    for k in range(1, rounds + 1):
        e, s, t = w[:size].reshape(3, width), w[size], w[size + 1 :].reshape(2, 2)
        g = np.concatenate([seen_e, [seen_s], seen_t.ravel()])
        for part in parts:
            p, pairs, _ = marginals(ids[:, part], length[part], e, s, t)
            g[:size] -= counts(part, p)
            g[size] -= p[0].sum()
            g[size + 1 :] -= pairs.ravel()
        g = (g - 0.05 * w) / n
        low = 0.9 * low + 0.1 * g
        high = 0.98 * high + 0.02 * g * g
        w = w + 0.3 * (low / (1 - 0.9**k)) / (np.sqrt(high / (1 - 0.98**k)) + 1e-8)
    return w[:size].reshape(3, width), float(w[size]), w[size + 1 :].reshape(2, 2)


def _spans(strong: np.ndarray) -> np.ndarray:
    """Strong tokens and the gaps of at most ``GAP`` tokens between two of them."""
    at = np.flatnonzero(strong)
    for a, z in zip(at[:-1], at[1:], strict=True):
        if z - a <= GAP + 1:
            strong[a:z] = True
    return strong


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Newton steps with a weak ridge."""
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(len(w))
        w = w + np.clip(np.linalg.solve(h, x.T @ (y - p) - 0.1 * w), -5, 5)
    return w


def fit(texts: list[str], toxic: np.ndarray) -> Model:
    """Fit on a bounded list of texts and 0/1 labels held by the driver. Without words, or
    without both labels, nothing can be learnt: every text then scores below one half."""
    n1, n0 = max(1, int(toxic.sum())), max(1, int((1 - toxic).sum()))
    by = (Counter(), Counter())
    for t, y in zip(texts, toxic, strict=True):
        by[int(y)].update({w.lower() for w in TOKEN.findall(t)})
    strength = {}
    for w in by[1].keys() | by[0].keys():
        a, b = by[1][w], by[0][w]
        if a + b >= 5:
            odds = np.log((a + 0.5) / (n1 - a + 0.5)) - np.log((b + 0.5) / (n0 - b + 0.5))
            strength[w] = (float(odds / np.sqrt(1 / (a + 0.5) + 1 / (b + 0.5))), float(odds), a)
    chosen = sorted((w for w, x in strength.items() if abs(x[0]) > 1.5), key=lambda w: (-abs(strength[w][0]), w))[:LEXICON]
    lexicon = {w: k for k, w in enumerate(chosen, 2)}
    common: Counter = Counter()
    for w in (by[0].keys() | by[1].keys()) - lexicon.keys():
        common[w[-3:]] += by[0][w] + by[1][w]
    endings = {e: k for k, e in enumerate(sorted(sorted(common), key=lambda e: -common[e])[:ENDINGS], len(chosen) + 2)}
    features = len(chosen) + len(endings) + 2
    strong = np.zeros(features, bool)
    often = max(6, n1 // 100)  # toxic documents that a strong word occurs in, at least
    strong[[lexicon[w] for w in chosen if strength[w][0] > 2.5 and strength[w][1] > 1.5 and strength[w][2] >= often]] = True
    del by, strength, common
    code = _Features(lexicon, endings)
    coded = [code.of(t) for t in texts]
    parts, tags = [], []
    for ids, y in zip(coded, toxic, strict=True):
        for at in range(0, len(ids), SEGMENT):
            parts.append(ids[at : at + SEGMENT])
            tags.append(_spans(strong[parts[-1]]) * int(y))
    if not parts or toxic.min() == toxic.max():
        return Model({}, {}, np.zeros((3, 3)), -2.0, np.zeros((2, 2)), np.array([-1.0, 0, 0, 0]))
    length = np.array([len(x) for x in parts])
    emission, start, transition = _train_chain(_pad(parts, 0), length, _pad(tags, 0), features)
    model = Model(lexicon, endings, emission, start, transition, np.zeros(4))
    rows, _ = _scored(coded, model)
    return model._replace(layer=_logistic(rows, toxic.astype(float)))


def _scored(coded: list[np.ndarray], model: Model, spans: bool = False) -> tuple[np.ndarray, list[np.ndarray]]:
    """(features of each text; if asked for, which tokens of each are toxic)."""
    length = np.array([len(ids) for ids in coded], np.int64)
    most, total = np.zeros(len(coded)), np.zeros(len(coded))
    over = [np.zeros(len(ids), bool) for ids in coded] if spans else []
    for text, begin, p in _tagged(coded, length, model):
        np.maximum.at(most, text, p.max(axis=0, initial=0.0))
        np.add.at(total, text, p.sum(axis=0))
        hit = p > 0.5
        for j in np.flatnonzero(hit.any(axis=0)) if spans else ():
            own = over[text[j]][begin[j] : begin[j] + len(p)]
            own[:] = hit[: len(own), j]
    return np.stack([np.ones(len(coded)), most, np.log1p(total), total / np.maximum(length, 1)], axis=1), over


def _score(features: np.ndarray, model: Model) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(features @ model.layer, -30, 30)))


def _tagged(coded: list[np.ndarray], length: np.ndarray, model: Model) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(which texts, first token, marginals) of some texts or columns of long texts at a time."""
    by_length = np.argsort(length, kind="stable")
    by_length, long = by_length[length[by_length] <= STRETCH], np.flatnonzero(length > STRETCH)
    at = 0
    while at < len(by_length):
        end = at + 1
        while end < len(by_length) and (end + 1 - at) * length[by_length[end]] <= CELLS:
            end += 1
        which = by_length[at:end]
        if length[which].max():
            p, _, _ = marginals(_pad([coded[k] for k in which], 0), length[which], model.emission, model.start, model.transition)
            yield which, np.zeros(len(which), np.int64), p
        at = end
    if len(long):
        yield from _long_tagged(coded, long, model)


def _long_tagged(coded: list[np.ndarray], long: np.ndarray, model: Model) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """As :func:`_tagged`, by columns of ``COLUMN`` tokens: their transfer matrices first,
    from these the messages that enter each column, then the marginals inside."""
    n_columns = np.array([-(-len(coded[k]) // COLUMN) for k in long])
    text = np.repeat(long, n_columns)
    begin = np.concatenate([np.arange(n) * COLUMN for n in n_columns])
    size = np.minimum(np.array([len(ids) for ids in coded], np.int64)[text] - begin, COLUMN)
    m, none = np.exp(model.transition), model.emission.shape[1] - 1
    blocks = [slice(a, a + max(1, CELLS // COLUMN)) for a in range(0, len(text), max(1, CELLS // COLUMN))]

    def weights(block: slice) -> np.ndarray:
        """Weight of the toxic state for each token, time x columns."""
        around = np.full((COLUMN + 2, len(text[block])), none, np.int32)  # one more token on either side
        for j, (k, a, n) in enumerate(zip(text[block], begin[block], size[block], strict=True)):
            low, high = max(a - 1, 0), min(a + n + 1, len(coded[k]))
            around[low - a + 1 : high - a + 1, j] = coded[k][low:high]
        return np.exp(model.emission[0][around[1:-1]] + model.emission[1][around[:-2]] + model.emission[2][around[2:]])

    def moved(x: np.ndarray, t: int, r: np.ndarray, block: slice) -> np.ndarray:
        """Forward message(s) ``x`` (states last but one axis) taken over token ``t``."""
        y = np.stack([x[..., 0, :] * m[0, 0] + x[..., 1, :] * m[1, 0], x[..., 0, :] * m[0, 1] + x[..., 1, :] * m[1, 1]], axis=-2)
        if t == 0:  # nothing leads to a text's first token
            y = np.where(begin[block] == 0, x, y)
        y[..., 1, :] *= r[t]
        y /= y.reshape(-1, y.shape[-1]).sum(axis=0)
        return np.where(t < size[block], y, x)

    transfer = np.empty((len(text), 2, 2))
    for block in blocks:
        r = weights(block)
        x = np.repeat(np.eye(2)[:, :, None], r.shape[1], axis=2)
        for t in range(COLUMN):
            x = moved(x, t, r, block)
        transfer[block] = np.moveaxis(x, 2, 0)
    left, right = np.empty((len(text), 2)), np.empty((len(text), 2))
    for k in range(len(text)):
        x = np.array([1.0, np.exp(model.start)]) if begin[k] == 0 else left[k - 1] @ transfer[k - 1]
        left[k] = x / x.sum()
    for k in range(len(text) - 1, -1, -1):
        last = k + 1 == len(text) or begin[k + 1] == 0
        x = np.ones(2) if last else transfer[k + 1] @ right[k + 1]
        right[k] = x / x.sum()
    for block in blocks:
        r = weights(block)
        forward = np.empty((COLUMN, 2, r.shape[1]))
        x = left[block].T
        for t in range(COLUMN):
            x = forward[t] = moved(x, t, r, block)
        b, p = right[block].T, np.zeros(r.shape)
        for t in range(COLUMN - 1, -1, -1):
            live = t < size[block]
            both = forward[t] * b
            p[t] = np.where(live, both[1] / (both[0] + both[1]), 0.0)
            c0, c1 = b[0], b[1] * r[t]
            c = np.stack([m[0, 0] * c0 + m[0, 1] * c1, m[1, 0] * c0 + m[1, 1] * c1])
            b = np.where(live, c / c.sum(axis=0), b)
        yield text[block], begin[block], p


def _cut(batches: Iterator[pa.RecordBatch], at: int) -> Iterator[pa.RecordBatch]:
    """Batches cut into slices of bounded text, by the column ``at``."""
    for b in batches:
        for start, n in slices(b.column(at), SLICE_BYTES):
            yield b.slice(start, n)


def _coded(column: pa.Array, code: _Features) -> tuple[list[str], list[np.ndarray]]:
    """Texts (null: empty) and the features of their tokens."""
    texts = ["" if t is None else t for t in column.to_pylist()]
    return texts, [code.of(t) for t in texts]


def held_out(doc_id: F.Column, folds: int = 5) -> F.Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(folds)) == 0, F.lit(False))


def fit_from_labels(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Fit on at most ``sample_rows`` labelled texts outside the held-out fold, the first
    by hash of their id; copies of one text count once. A text of more than
    ``PIECE_CHARS`` characters gives a labelled text for each piece of that length, of
    which the sample takes its share; no text is left out for its length."""
    chosen = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    chosen = chosen.groupBy("doc_id").agg(F.max("toxic").alias("y"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    texts = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    # the sample is bounded by its rows, and a row by PIECE_CHARS
    last = F.greatest(F.length("text") - 1, F.lit(0))
    rows = texts.join(F.broadcast(chosen), "doc_id").select("doc_id", "y", "text", F.explode(F.sequence(F.lit(0), last, F.lit(PIECE_CHARS))).alias("at"))
    rows = rows.select("doc_id", "y", F.substring("text", F.col("at") + 1, F.lit(PIECE_CHARS)).alias("text"), "at")
    rows = rows.orderBy(F.xxhash64("doc_id", "at"), "doc_id", "at", "text").limit(sample_rows).select("doc_id", "at", "text", "y")
    rows = rows.toPandas().sort_values(["doc_id", "at", "text"]).drop_duplicates("text")
    return fit(rows["text"].tolist(), (rows["y"].to_numpy() > 0).astype(np.int64))


def tag_toxicity(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, score, predicted, n_toxic_tokens, spans`` for every row.

    ``spans`` are [start, end) character offsets of runs of tokens with marginals
    above one half. A null or empty text has no tokens: its score comes from the
    logistic layer's intercept. Null and repeated ids are scored like any other row;
    extra columns are ignored; an empty table gives an empty result. No shuffle.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def tag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = _Features(model.lexicon, model.endings)
        for b in _cut(batches, 1):
            texts, coded = _coded(b.column(1), code)
            features, over = _scored(coded, model, spans=True)
            score, count = _score(features, model), np.array([x.sum() for x in over], np.int64)
            spans = [_offsets(t, x) if n else [] for t, x, n in zip(texts, over, count, strict=True)]
            columns = [b.column(0), pa.array(score), pa.array((score >= 0.5).astype(np.int32)), pa.array(count)]
            columns.append(pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))))
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "score", "predicted", "n_toxic_tokens", "spans"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(tag, f"doc_id {kind}, score double, predicted int, n_toxic_tokens long, spans array<struct<start:long,end:long>>")


def drop_toxic(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows whose text the model doesn't predict to be toxic, all columns kept;
    nothing shuffles. Rows are judged as by :func:`tag_toxicity`."""
    at = docs.columns.index(text_col)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = _Features(model.lexicon, model.endings)
        for b in _cut(batches, at):
            _, coded = _coded(b.column(at), code)
            yield b.filter(pa.array(_score(_scored(coded, model)[0], model) < 0.5))

    return docs.mapInArrow(keep, docs.schema)


def _offsets(text: str, over: np.ndarray) -> list[dict[str, int]]:
    out: list[dict[str, int]] = []
    previous = False
    for m, bad in zip(TOKEN.finditer(text), over, strict=True):
        if bad and previous:
            out[-1]["end"] = m.end()
        elif bad:
            out.append({"start": m.start(), "end": m.end()})
        previous = bool(bad)
    return out
