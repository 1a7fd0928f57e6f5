import math
import os
import struct

import numpy as np
import pytest

from lexispan.llm import embedding_dedup as E
from lexispan.llm import sentencepiece_codec as S


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, n_links int, vector string")


def brute(rows, threshold=0.9):
    good = {}
    for k, (i, v, *_) in enumerate(rows):
        if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v):
            x = np.array(v, np.float32).astype(float)
            good[k] = x / np.linalg.norm(x)
    parent, links = {r[0]: r[0] for r in rows}, {k: 0 for k in range(len(rows))}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in good:
        for b in good:
            if a < b and len(good[a]) == len(good[b]) and good[a] @ good[b] >= threshold:
                links[a] += 1
                links[b] += 1
                x, y = find(rows[a][0]), find(rows[b][0])
                parent[max(x, y)] = min(x, y)
    return sorted((rows[k][0] if rows[k][0] is not None else -1, links[k], find(rows[k][0]) if rows[k][0] is not None else -1) for k in links)


@pytest.mark.parametrize("block", [1024, 7])
def test_near_vectors_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(E, "BLOCK", block)
    rng = np.random.default_rng(2)
    rows = []
    for g in range(30):
        centre = rng.normal(size=16)
        for _ in range(rng.integers(1, 9)):
            rows.append(centre + rng.normal(scale=rng.choice([0.0, 0.15, 0.3]), size=16))
    rows = [(int(k), [float(x) for x in v]) for k, v in zip(rng.permutation(1000), rows, strict=False)]
    rows += [(2000, None), (2001, []), (2002, [0.0] * 16), (2003, [None] + [1.0] * 15), (2004, [math.nan] + [1.0] * 15), (2005, [math.inf] + [1.0] * 15)]
    rows += [(2006, rows[0][1]), (2007, rows[0][1]), (2008, rows[0][1][:8]), (2009, rows[0][1][:8]), (None, rows[0][1])]
    full = [(i, v, 1, 0, "x") for i, v in rows]
    got = sorted((r["vec_id"] if r["vec_id"] is not None else -1, r["n_links"], r["component_id"] if r["component_id"] is not None else -1) for r in E.near_vectors(vectors(spark, full)).collect())
    want = brute(rows)
    linked = sum(x[1] for x in want)
    missed = linked - sum(x[1] for x in got)
    assert 0 <= missed <= 0.01 * linked
    if not missed:
        assert got == want


def test_repeated_ids_with_different_vectors(spark):
    rows = [(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 0.01]), (3, [0.01, 1.0]), (4, [0.02, 1.0])]
    got = E.near_vectors(vectors(spark, [(i, v, 1, 0, "x") for i, v in rows]))
    assert sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in got.collect()) == [(1, 1, 1), (1, 2, 1), (2, 1, 1), (3, 2, 1), (4, 2, 1)]


def test_no_vectors(spark):
    assert E.near_vectors(vectors(spark, [])).count() == 0
    r = E.near_vectors(vectors(spark, [(3, None, 1, 0, "x")])).first()
    assert (r["n_links"], r["component_id"], r["kept"]) == (0, 3, True)


def test_tables_meet_the_recall():
    near = E.collision(math.sqrt(0.2))
    for n in (1, 500, 10**5, 10**9):
        k, tables = E.plan_tables(n)
        assert 1 - (1 - near**k) ** tables >= E.RECALL
    rng = np.random.default_rng(0)
    a, b = rng.standard_normal(200_000), rng.uniform(0, E.WIDTH, 200_000)
    assert abs((np.floor(b / E.WIDTH) == np.floor((0.5 * a + b) / E.WIDTH)).mean() - E.collision(0.5)) < 0.01


def test_rounds_write_no_more_than_the_vectors(spark, monkeypatch):
    monkeypatch.setattr(E, "ROUND_BYTES", 1, raising=False)
    rng = np.random.default_rng(4)
    x = rng.normal(size=(4000, 64))
    x[3000:] = x[:1000] + rng.normal(scale=0.25, size=(1000, 64))
    x = x.astype(np.float32)
    df = vectors(spark, [(i, v, 1, 0, "x") for i, v in enumerate(x.tolist())]).select("vec_id", "embedding")
    jvm, store = spark.sparkContext._jvm, spark.sparkContext._jsc.sc().statusStore()

    def written():
        stages = store.stageList(None, False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
        return {stages.apply(i).stageId(): stages.apply(i).shuffleWriteBytes() for i in range(stages.size())}

    before = written()
    got = {r["vec_id"]: r["n_links"] for r in E.near_vectors(df).collect()}
    assert max(n for k, n in written().items() if k not in before) <= 2 * x.nbytes
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    want = (u @ u.T >= 0.9).sum(axis=1) - 1
    assert want.sum() > 1000 and all(got[k] <= n for k, n in enumerate(want)) and sum(got.values()) >= 0.99 * want.sum()


def test_keys_are_the_same_in_any_company():
    rng = np.random.default_rng(5)
    for dim in (3, 64, 700):
        p = E.plan(10**6)
        rows = E._scaled(rng.normal(size=(300, dim)).astype(np.float32) * np.float32(1e-30))
        scale = E._scale(rows)
        keys, corners = E._keys(rows, p), E._corners(rows, scale, 2, p)
        for i in (0, 7, 299):
            assert (E._keys(rows[i : i + 1], p) == keys[i]).all() and (E._corners(rows[i : i + 1], E._scale(rows[i : i + 1]), 2, p) == corners[i]).all()


def test_inner_tables_meet_the_recall():
    rng = np.random.default_rng(6)
    a = rng.standard_normal((50_000, 16))
    b = 0.9 * a + math.sqrt(0.19) * rng.standard_normal(a.shape)
    i, j, at = np.abs(a).argmax(axis=1), np.abs(b).argmax(axis=1), np.arange(len(a))
    assert abs(((i == j) & (a[at, i] * b[at, j] > 0)).mean() - E.corner(16, 0.9)) < 0.01
    for n in (1, 3000, 10**5, 10**7, 10**9):
        p = E.plan(n)
        inner = 1 - (1 - E.corner(p.lines, 0.9) ** p.sets) ** p.inner
        assert 1 - (1 - E.collision(math.sqrt(0.2)) ** p.k * inner) ** p.tables >= E.RECALL


def test_blocks_meet_once():
    """Around the ring of a bucket's blocks every two meet in one task."""
    for blocks in range(1, 9):
        met = []
        for _, least, most in [t for r in E._rounds([(0, blocks, 100)], 150) for t in r]:
            for offset in range(least, most + 1):
                met += {tuple(sorted((side, (side + offset) % blocks))) for side in range(blocks)}
        assert sorted(met) == [(i, j) for i in range(blocks) for j in range(i, blocks)]


pieces = pytest.mark.skipif(not os.path.exists(S.MODEL_PATH), reason="no vocabulary file")
HARD = ["", " ", "  a  b ", "日本語テスト", "a\x00b", "x" * 700, " " * 50 + "z", "\n\n\t", "é✓①" * 40, "ab" * 400 + "の" * 5, "don't stop, now!", "▁x▁"]


def _varint(n):
    out = b""
    while True:
        n, low = n >> 7, n & 127
        out += bytes([low | 128 * bool(n)])
        if not n:
            return out


def _field(number, data):
    return _varint(number << 3 | 2) + _varint(len(data)) + data


def unigram_model(proto):
    """The same pieces as a unigram model with log-probability-like scores."""
    out, n = b"", 0
    for number, value in S._fields(proto):
        if number == 1:
            one = dict(S._fields(value))
            kind, n = one.get(3, 1), n + 1
            out += _field(1, _field(1, one[1]) + _varint(2 << 3 | 5) + struct.pack("<f", -math.log(n + 5) if kind == 1 else 0.0) + _varint(3 << 3) + _varint(kind))
        elif number == 3:
            settings = value
    return out + _field(2, b"".join(_varint(k << 3) + _varint(v) for k, v in ((3, 1), (4, n), (35, 1), (40, 0), (41, 1), (42, 2), (43, (1 << 64) - 1)))) + _field(3, settings)


def corpus(spark):
    return [r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()] + HARD


@pieces
def test_encoding_equals_the_library(spark):
    import sentencepiece

    proto = open(S.MODEL_PATH, "rb").read()
    library, model = sentencepiece.SentencePieceProcessor(model_proto=proto), S.load_model(proto)
    texts = corpus(spark)
    got = S.Encoder(model).encode(texts)
    assert [x.tolist() for x in got] == library.encode(texts)
    assert [S.decode(model, x) for x in got] == [t.replace("▁", " ") for t in texts]
    assert [S.decode(model, x) for x in got] == [library.decode(x.tolist()) for x in got]


def unspaced(n):
    """Text without spaces: base64, Chinese, lines and a run of one letter."""
    rng = np.random.default_rng(3)
    import base64

    parts = [base64.b64encode(rng.bytes(n)).decode(), "".join(map(chr, rng.integers(0x4E00, 0x4E80, n // 4))), "line\nof\n\ttext;" * (n // 16), "a" * 3000, "é✓" * 500]
    return "".join(parts)


@pieces
def test_long_texts_without_spaces(monkeypatch):
    import sentencepiece

    proto = open(S.MODEL_PATH, "rb").read()
    library, model = sentencepiece.SentencePieceProcessor(model_proto=proto), S.load_model(proto)
    text = unspaced(40_000)
    monkeypatch.setattr(S, "BLOCK", 20_000)
    texts = [text, "some words " + text[:30_000] + " and more", "short"]
    got = S.Encoder(model).encode(texts)
    assert [x.tolist() for x in got] == library.encode(texts)
    assert [S.decode(model, x) for x in got] == texts


@pieces
def test_unknown_characters_across_cuts():
    """Without byte pieces neighbouring unknown characters are one unknown piece."""
    model = S.load_model(open(S.MODEL_PATH, "rb").read())._replace(byte_ids=None)
    text = "ab" + "\u4e2d\u6587\u5b57" * 6000 + "the" * 3000
    want = S.Encoder(model)._segment([(" " + text).encode()])[0]
    assert (S.Encoder(model).encode([text])[0] == want).all()


@pieces
def test_memory_of_long_text_is_bounded():
    import tracemalloc

    model = S.load_model(open(S.MODEL_PATH, "rb").read())
    encoder = S.Encoder(model)
    peaks = []
    for n in (1_000_000, 4_000_000):
        text = "".join(map(chr, np.random.default_rng(1).integers(0x4E00, 0x5E00, n // 3)))
        tracemalloc.start()
        encoder.encode([text])
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
    assert peaks[1] - peaks[0] < 20 * 3_000_000  # a few bytes for each further byte


@pieces
def test_unigram_paths_score_as_the_library(spark):
    import sentencepiece

    proto = unigram_model(open(S.MODEL_PATH, "rb").read())
    library, model = sentencepiece.SentencePieceProcessor(model_proto=proto), S.load_model(proto)
    assert model.unigram
    texts = corpus(spark)[-60:]
    for text, ids, want in zip(texts, S.Encoder(model).encode(texts), library.encode(texts), strict=True):
        score = lambda x: sum(model.scores[k] for k in x)
        assert ids.tolist() == want or abs(score(ids.tolist()) - score(want)) < 1e-3 * max(1, len(want)) ** 0.5
        assert S.decode(model, ids) == text.replace("▁", " ")


@pieces
def test_documents_round_trip(spark):
    model = S.load_model(open(S.MODEL_PATH, "rb").read())
    rows = [(k, t, 1, "x") for k, t in enumerate([*HARD, None])] + [(None, "again", 1, "x"), (3, "again", 1, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids int, n_tokens string")
    coded = S.encode_documents(df, model)
    back = S.decode_documents(coded, model)
    assert sorted((str(r[0]), r[1]) for r in back.collect()) == sorted((str(k), (t or "").replace("▁", " ")) for k, t, *_ in rows)
    flags = {r["doc_id"]: r["round_trip"] for r in coded.where("doc_id <> 3").collect()}
    assert [k for k, ok in flags.items() if not ok] == [HARD.index("▁x▁")]
    assert S.encode_documents(df.where("false"), model).count() == 0


@pieces
def test_edges_are_all_occurrences():
    model = S.load_model(open(S.MODEL_PATH, "rb").read())
    e = S.Encoder(model)
    raw = " the other theé"
    text = np.frombuffer(raw.encode() + bytes([S._SEPARATOR]), np.uint8)
    start, piece = e.edges(text)
    got = {(int(s), model.pieces[e.ids[p]]) for s, p in zip(start, piece, strict=True)}
    data = raw.encode()
    want = {(k, p) for p in model.pieces if p for k in range(len(data)) if data.startswith(p, k)}
    assert got == want and (np.diff(start) >= 0).all()
