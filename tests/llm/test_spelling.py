import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from lexispan.llm import queries as Q
from lexispan.llm import spelling as S


def counted(rows):
    n = Counter()
    for doc, text in rows:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 31 == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1 :]
            if len(run) >= 7:
                n[run] += 1
    return {w: k for w, k in n.items() if k > 1}


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def brute(rows):
    n = counted(rows)
    links = {w: [] for w in n}
    for w in n:
        for k in range(len(w) + 1):
            links.setdefault(w, [])
    holes = {}
    for w in n:
        for k in range(len(w)):
            holes.setdefault((len(w), k, w[:k] + w[k + 1 :]), set()).add(w)
    for w in n:
        found = set()
        for k in range(len(w)):
            found |= holes[len(w), k, w[:k] + w[k + 1 :]]
            if w[:k] + w[k + 1 :] in n:
                found.add(w[:k] + w[k + 1 :])
        links[w] = found - {w}
    for w in n:
        for o in links[w]:
            if len(o) < len(w):
                links[o] = links[o] | {w}
    form = {}
    for w in n:
        if links[w]:
            best = min(links[w], key=lambda o: (-n[o], o))
            if n[best] >= 10 * n[w]:
                form[w] = best
    out = set()
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out.add((w, form.get(w), root, n[w], len(links[w]), n[form[w]] if w in form else None))
    return out


def rows_of(df):
    return {tuple(r[c] for c in ("word", "form", "root", "n", "n_near", "form_n")) for r in df.collect()}


@pytest.mark.parametrize("length", [2, 7, 8])
def test_recurrences_find_exactly_the_near_words(length):
    rng = random.Random(length)
    word = lambda n: "".join(rng.choice("abé") for _ in range(n))
    words = sorted({word(rng.choice([length, length + 1])) for _ in range(300)})
    asked = [w for w in words if len(w) == length]
    one = lambda x: np.zeros(len(x), np.int64)
    for skip in (0, length // 2):
        got = [(asked[x], words[y]) for a, b in S.near_pairs(words, asked, one(words), one(asked), length, skip) for x, y in zip(a, b, strict=True)]
        want = {(a, b) for a in asked for b in words if near(a, b) and not (skip and a[:skip] == b[:skip])}
        assert len(got) == len(set(got)) and set(got) == want
    assert list(S.near_pairs([], [], one([]), one([]), length, 0)) == []


def test_buckets_keep_words_apart(monkeypatch):
    monkeypatch.setattr(S, "PAIR_WORDS", 2)
    words = [f"{'ab'[k // 100]}word{k:03d}" for k in range(200)]
    bucket = np.repeat([0, 1], 100)
    got = {(x, y) for a, b in S.near_pairs(words, words, bucket, bucket, 8, 0) for x, y in zip(a.tolist(), b.tolist(), strict=True)}
    assert got == {(x, y) for x in range(200) for y in range(200) if bucket[x] == bucket[y] and near(words[x], words[y])}


def generated(seed, n=400):
    rng = random.Random(seed)
    base = ["aaaaaaa", "aaaaaaaa", "straßen", "Éclairée", "spelling", "variants", "abcdefghij", "x" * 50]
    rows = []
    for i in range(n):
        out = []
        for _ in range(30):
            w = list(rng.choice(base))
            for _ in range(rng.choice([0, 0, 0, 0, 1, 1, 2])):
                k = rng.randrange(len(w) + 1)
                w[k : k + rng.randrange(2)] = [rng.choice(["", "a", "b", "é", "ÿ", "÷"])]
            out.append("".join(w).upper() if rng.random() < 0.1 else "".join(w))
        rows.append((i, rng.choice([" ", "\n", "1", "-", "ǅ"]).join(out)))
    return rows


def test_variants_equal_brute_force(spark):
    rows = [*generated(5), (None, "Spelling spelling spellin"), (7, None), (8, ""), (7, "spellingg spellingg"), (7, "spellingg spellingg")]
    df = spark.createDataFrame([(i, t, "w", 3) for i, t in rows], "doc_id long, text string, word string, n int")
    want = brute(rows)
    assert any(w[1] and w[2] != w[1] for w in want)  # some form has a form
    assert rows_of(S.spelling_variants(df)) == want


def test_hot_buckets_are_dealt_as_grids(spark, monkeypatch):
    monkeypatch.setattr(S, "BLOCK_WORDS", 8)
    monkeypatch.setattr(S, "COUNTED_WORDS", 50)
    rows = [*generated(9, 60), (1000, " ".join(f"prefix{a}{b}suffix" for a in "abcdefgh" for b in "abcdefgh") * 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert rows_of(S.spelling_variants(df)) == brute(rows)


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id string, text string")
    out = S.spelling_variants(df)
    assert out.count() == 0 and out.columns == ["word", "form", "root", "n", "n_near", "form_n"]


def test_query_on_whole_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = brute([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert rows_of(Q.op12_spelling_variants(spark, "/root/testdata/sf0.001")) == want
