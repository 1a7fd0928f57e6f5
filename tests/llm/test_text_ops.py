import hashlib
import math
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from lexispan.llm import lm_scoring, minhash_dedup, roundtrip, substring_dedup, toxicity
from lexispan.llm import words as W

SCHEMA = "doc_id long, text string, lang string, size int, row string, payload int"


def docs(spark, texts, ids=None):
    ids = list(range(len(texts))) if ids is None else ids
    return spark.createDataFrame([(i, t, "l", 1, "r", 2) for i, t in zip(ids, texts, strict=True)], SCHEMA)


def split(text):
    return [w for w in (text or "").translate({c: " " for c in range(9, 14)}).split(" ") if w]


def prose(rng, n, vocabulary=60):
    return " ".join(f"w{int(rng.random() ** 2 * vocabulary)}" for _ in range(n))


def passages(seed, n=60):
    rng = random.Random(seed)
    shared = [prose(rng, 40) for _ in range(4)]
    out = []
    for _ in range(n):
        parts = [prose(rng, rng.randint(0, 30), 4000)]
        for _ in range(rng.randint(0, 2)):
            s = rng.choice(shared).split(" ")
            a = rng.randint(0, 20)
            parts += [" ".join(s[a : a + rng.randint(1, 40)]), prose(rng, rng.randint(0, 15), 4000)]
        out.append(rng.choice([" ", "\n", "\t "]).join(parts))
    return out + ["", None, "   ", "one", out[0], out[1], "a b " * 40, "é ü " * 20]


def test_words_and_grams():
    texts = ["a bb\ta", "", None, "é  b", "x"]
    buf, off = W.text_buffer(pa.chunked_array([pa.array(texts[:2]), pa.array(texts[2:], pa.string())]))
    w = W.words(buf, off, W.spaced_words())
    assert w.first.tolist() == [0, 3, 3, 3, 5, 6]
    assert w.hash[0] == w.hash[2] != w.hash[1]
    assert [bytes(buf[a:b]).decode() for a, b in zip(w.start, w.end, strict=True)] == ["a", "bb", "a", "é", "b", "x"]
    h, at = W.grams(w, 2)
    assert at.tolist() == [0, 1, 3]
    rng = random.Random(0)
    text = " ".join(rng.choice("ab") for _ in range(400))
    w = W.words(*W.text_buffer(pa.array([text])), W.spaced_words())
    h, at = W.grams(w, 5)
    real = text.split(" ")
    assert len({tuple(real[k : k + 5]) for k in at}) == len(set(h.tolist()))


def test_squeeze():
    x = np.sort(np.random.default_rng(0).integers(0, 2**63, 1000).astype(np.uint64))
    assert (roundtrip.unsqueeze_sorted(roundtrip.squeeze_sorted(x)) == x).all()
    x = x >> np.uint64(6) << np.uint64(6)
    assert (roundtrip.unsqueeze_sorted(roundtrip.squeeze_sorted(x, 6), 6) == x).all()
    edge = roundtrip.bucket_edges(x, 7)
    assert edge[0] == 0 and edge[-1] == len(x) and (np.diff(edge) >= 0).all()


# --- substring dedup


def brute_windows(texts, ids, n=13):
    rank = [math.inf if i is None else i for i in ids]
    first = {}
    ws = [split(t) for t in texts]
    for r, w in zip(rank, ws, strict=True):
        for k in range(len(w) - n + 1):
            g = tuple(w[k : k + n])
            first[g] = min(first.get(g, math.inf), r)
    out = []
    for i, r, w in zip(ids, rank, ws, strict=True):
        gone = {k + j for k in range(len(w) - n + 1) if first[tuple(w[k : k + n])] < r for j in range(n)}
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return Counter(out)


def test_substring_dedup_equals_brute_force(spark):
    texts = passages(1)
    ids = random.Random(2).sample(range(1000), len(texts) - 2) + [None, 5]
    got = substring_dedup.dedup_substrings(docs(spark, texts, ids)).select("doc_id", "n_words", "n_removed", "kept_sha256")
    assert Counter(tuple(r) for r in got.collect()) == brute_windows(texts, ids)


def test_substring_spans_and_carried_rows(spark):
    long = " ".join(f"p{k}" for k in range(20))
    df = docs(spark, [long, f"x {long} y", "clean  text", None], [1, 2, 3, 3])
    rows = {(r["doc_id"], r["n_words"]): r for r in substring_dedup.dedup_substrings(df, carry=True).collect()}
    r = rows[2, 22]
    assert [tuple(s) for s in r["spans"]] == [(1, 21)] and r["kept_text"] == "x y" and r["row"]["payload"] == 2
    assert rows[3, 2]["kept_text"] == "clean  text" and rows[3, 0]["n_removed"] == 0
    assert substring_dedup.dedup_substrings(docs(spark, [])).count() == 0
    assert substring_dedup.factors(np.array([1, 0, 0, 1, 0, 0, 0, 0, 1], bool), 10, 3) == [(0, 6), (8, 10)]


def source_words(texts, ids, factor):
    """The words a factor copies; ids are unique here."""
    w = split(dict(zip(ids, texts, strict=True))[factor["source_id"]])
    return w[factor["source_word"] : factor["source_word"] + factor["length"]]


@pytest.mark.parametrize("bits", [64, 9])
def test_factors_copy_earlier_documents(spark, bits):
    """With 9-bit seeds nearly every seed meets another one's hash."""
    texts = [t or "" for t in passages(7, 50)]
    ids = random.Random(8).sample(range(1000), len(texts))
    rows = substring_dedup.dedup_substrings(docs(spark, texts, ids), seed_bits=bits).collect()
    got = Counter((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in rows)
    assert got == brute_windows(texts, ids)
    n = 0
    for r in rows:
        own = split(dict(zip(ids, texts, strict=True))[r["doc_id"]])
        covered = set()
        for f in r["factors"]:
            n += 1
            assert f["source_id"] < r["doc_id"] and f["length"] >= 13
            assert own[f["from_word"] : f["from_word"] + f["length"]] == source_words(texts, ids, f)
            covered |= set(range(f["from_word"], f["from_word"] + f["length"]))
        assert covered == {k for s in r["spans"] for k in range(*s)}
    assert n > 10


def test_disputed_seeds_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(substring_dedup, "BROADCAST_HASHES", 0)
    texts = passages(9, 20)
    ids = list(range(len(texts)))
    got = substring_dedup.dedup_substrings(docs(spark, texts, ids), seed_bits=8).select("doc_id", "n_words", "n_removed", "kept_sha256")
    assert Counter(tuple(r) for r in got.collect()) == brute_windows(texts, ids)


def test_substring_batches_and_long_texts(spark):
    """Many small batches, a text of 2 MB and many rows that are equal."""
    rng = random.Random(4)
    long = prose(rng, 300_000, 10**6)
    texts = [long, "x " + " ".join(long.split(" ")[1000:200_000]), *["same " * 30] * 50]
    df = docs(spark, texts, [3, 4] + [5] * 25 + [6] * 25).repartition(5)
    got = substring_dedup.dedup_substrings(df)
    assert Counter((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got.collect()) == brute_windows(texts, [3, 4] + [5] * 25 + [6] * 25)


def test_source_that_jumps_by_256_words(spark):
    """The seeds of document 2 follow each other in document 1 but for one jump that their
    places' last bytes don't show."""
    x, y, filler = ([f"{c}{k}" for k in range(n)] for c, n in (("x", 40), ("y", 30), ("f", 244)))
    texts = [" ".join([*x, *filler, *x[28:], *y]), " ".join(["own", *x, *y, "own"])]
    r = {r["doc_id"]: r for r in substring_dedup.dedup_substrings(docs(spark, texts, [1, 2])).collect()}[2]
    assert r["n_removed"] == 70 and [tuple(s) for s in r["spans"]] == [(1, 71)]
    assert [tuple(f) for f in r["factors"]] == [(1, 40, 1, 0), (29, 42, 1, 284)]


def test_batches_hold_whole_rows(spark):
    df = docs(spark, ["a" * 100, None, "b" * 5000, "c"])
    packed = roundtrip.deal(df, "doc_id", "text", True, batch_bytes=300).packed().collect()
    assert len({r["batch"] for r in packed}) == len(packed)
    texts = [roundtrip.unpack(pa.table({"payload": pa.array([bytes(r["payload"])])})) for r in packed]
    assert sorted((t for x in texts for t in x["text"].to_pylist()), key=len) == ["", "c", "a" * 100, "b" * 5000]
    assert all(x["row"][0]["payload"].as_py() == 2 for x in texts)


# --- language-model scores


def brute_scores(texts):
    ws = [split(t) for t in texts]
    count = lambda w: Counter(tuple(w[k : k + n]) for n in (1, 2, 3) for k in range(len(w) - n + 1))
    own = [count(w) for w in ws]
    every = sum(own, Counter())
    total = sum(map(len, ws))
    out = []
    for w, mine in zip(ws, own, strict=True):
        c = lambda g: every[g] - mine[g]
        score = backed = 0
        for k in range(len(w)):
            top = min(k + 1, 3)
            for n in range(top, 0, -1):
                g = tuple(w[k - n + 1 : k + 1])
                if c(g) > 0:
                    score += math.log(c(g) / (c(g[:-1]) if n > 1 else total - len(w))) + (top - n) * math.log(0.4)
                    break
            else:
                n = 1
                score += math.log(1 / (total - len(w) + 1)) + (top - 1) * math.log(0.4)
            backed += n < top
        out.append((len(w), backed, score))
    return out


def test_lm_scores_equal_brute_force(spark):
    texts = passages(3, 40)
    got = {r["doc_id"]: r for r in lm_scoring.score_documents(docs(spark, texts)).collect()}
    for k, (n, backed, score) in enumerate(brute_scores(texts)):
        r = got[k]
        assert (r["n_words"], r["n_backed_off"]) == (n, backed)
        assert r["logscore"] == pytest.approx(score, abs=1e-6)
        assert r["mean_logscore"] == (pytest.approx(score / n, abs=1e-9) if n else None)
    assert lm_scoring.score_documents(docs(spark, [])).count() == 0
    assert lm_scoring.score_documents(docs(spark, [None, "a a", "a a"], [None, None, 1])).count() == 3
    assert lm_scoring.score_documents(docs(spark, ["", None])).count() == 2


# --- near duplicates


def jaccard(a, b):
    return sum((a & b).values()) / max(1, sum((a | b).values()))


def multiset(text):
    w = [x for x in "".join(c if c.isalnum() else " " for c in (text or "").lower()).split()]
    return Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)] if w else [])


def test_signatures_estimate_weighted_jaccard():
    rng = random.Random(1)
    base = [rng.randint(1, 9) for _ in range(400)]
    a = {k: n for k, n in enumerate(base[:320])}
    b = {k: n for k, n in enumerate(base) if k >= 40}
    h, d, s = [], [], []
    for doc, x in enumerate((a, b)):
        for k, n in x.items():
            h += [k * 2**32 + 12345] * n
            d += [doc] * n
            s += range(n)
    h = W.mix(np.array(h, np.uint64))
    sign = minhash_dedup.dart_minhash(h, np.array(d), np.array(s), 3, 512)
    assert (sign[2] == 0).all() and (sign[:2] != 0).all()
    want = jaccard(Counter(a), Counter(b))
    assert abs((sign[0] == sign[1]).mean() - want) < 0.09
    # a fractional weight covers its share of the last slab
    part = np.where(np.array(d) == 0, 0.5, 1.0)
    sign = minhash_dedup.dart_minhash(h, np.array(d), np.array(s), 2, 512, part)
    assert abs((sign[0] == sign[1]).mean() - 0.5 * want / (0.5 + 0.5 * want)) < 0.2


def near_texts(seed, groups=12):
    rng = random.Random(seed)
    out = []
    for g in range(groups):
        base = [f"g{g}w{rng.randint(0, 5000)}" for _ in range(rng.randint(30, 120))]
        for _ in range(rng.randint(1, 6)):
            t = list(base)
            for _ in range(rng.randint(0, 3)):
                t[rng.randrange(len(t))] = f"new{rng.randint(0, 9999)}"
            out.append(" ".join(t) + rng.choice(["", ".", "  "]))
    return out + ["", None, "!!", "a b", "A  b.", "a b c d e f", "rep " * 300, "rep " * 290]


def brute_classes(texts, ids, threshold=0.8):
    sets = [multiset(t) for t in texts]
    parent = {i: i for i in ids}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for x in range(len(ids)):
        for y in range(x):
            if sets[x] and sets[y] and jaccard(sets[x], sets[y]) >= threshold - 1e-12:
                a, b = find(ids[x]), find(ids[y])
                parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("block", [minhash_dedup.BLOCK_WORDS, 150])
def test_near_duplicates_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(minhash_dedup, "BLOCK_WORDS", block)  # small blocks: the path of large components
    texts = near_texts(11)
    ids = random.Random(3).sample(range(500), len(texts))
    rows = minhash_dedup.near_duplicates(docs(spark, texts, ids)).collect()
    got = {r["doc_id"]: r["class_id"] for r in rows}
    want = brute_classes(texts, ids)
    assert got == want
    sizes = Counter(want.values())
    assert all(r["class_size"] == sizes[r["class_id"]] and r["kept"] == (r["doc_id"] == r["class_id"]) for r in rows)


def test_near_duplicates_edges(spark):
    assert minhash_dedup.near_duplicates(docs(spark, [])).count() == 0
    rows = minhash_dedup.near_duplicates(docs(spark, [None, "", "a b c d e f", "a b c d e f", "a b c d e f"], [None, 1, None, 4, 4])).collect()
    assert sorted((r["doc_id"] or -1, r["class_id"] or -1) for r in rows) == [(-1, -1), (-1, -1), (1, 1), (4, 4), (4, 4)]


def test_texts_that_share_an_id_are_judged_alone(spark):
    words = [f"w{k}" for k in range(40)]
    copy, clean = " ".join(words), " ".join(f"c{k}" for k in range(40))
    other = [f"v{k}" for k in range(40)]
    texts = [" ".join(words + ["end"]), copy, clean, " ".join(other), " ".join(other + ["end"]), clean + " more"]
    data = docs(spark, texts, [1, 7, 7, 7, 9, 7])
    got = sorted((r["doc_id"], texts.index(r["text"])) for r in corpus_pipeline.drop_near_copies(spark, data, "").collect())
    assert len(got) == 3 and got[0] == (1, 0) and (7, 3) in got and {(7, 2), (7, 5)} & set(got)
    rows = minhash_dedup.near_duplicates(data).collect()
    assert Counter((r["doc_id"], r["class_id"], r["class_size"]) for r in rows) == Counter({(1, 1, 2): 1, (7, 1, 2): 1, (7, 7, 2): 3, (9, 7, 2): 1})


def test_components_of_stars_take_no_round(spark, monkeypatch):
    """Stars that point to their least vertex are done; anything else takes rounds."""
    from lexispan.llm import components as C

    rounds = []
    meet = C._meet
    monkeypatch.setattr(C, "_meet", lambda *x: rounds.append(1) or meet(*x))
    kind = "u long, v long"
    stars = [(5, 1), (1, 6), (6, 1), (9, -3), (8, -3), (2, 2)]
    assert dict(C.components(spark.createDataFrame(stars, kind)).collect()) == {1: 1, 5: 1, 6: 1, -3: -3, 8: -3, 9: -3} and not rounds
    assert not C.components(spark.createDataFrame([], kind)).collect() and not rounds
    assert dict(C.components(spark.createDataFrame([(1, 2), (2, 3)], kind)).collect()) == {1: 1, 2: 1, 3: 1} and len(rounds) == 2
    assert dict(C.components(spark.createDataFrame([(7, 4), (7, 5)], kind)).collect()) == {4: 4, 5: 4, 7: 4}


def test_components(spark):
    from lexispan.llm.components import components

    rng = random.Random(8)
    edges = [(rng.randint(0, 150), rng.randint(0, 150)) for _ in range(110)] + [(k, k + 1) for k in range(300, 360)]
    parent = {v: v for e in edges for v in e}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = dict(components(spark.createDataFrame(edges, "u long, v long")).collect())
    assert got == {v: find(v) for e in edges if e[0] != e[1] for v in e}


# --- toxicity


def toxic_corpus(n=400):
    rng = random.Random(6)
    bad = ["idiotx", "scumx", "trashx"]
    texts, labels = [], []
    for _ in range(n):
        w = [f"w{rng.randint(0, 300)}" for _ in range(rng.randint(5, 60))]
        toxic = rng.random() < 0.25
        if toxic:
            for _ in range(rng.randint(1, 4)):
                w.insert(rng.randrange(len(w)), rng.choice(bad))
        texts.append(" ".join(w))
        labels.append(int(toxic))
    return texts, labels


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(0)
    e, s, t = rng.normal(size=4), 0.3, rng.normal(size=(2, 2))
    ids = rng.integers(0, 4, (5, 2)).astype(np.int32)
    length = np.array([5, 3])
    p, pairs, z = toxicity.marginals(ids, length, e, s, t)
    want_pairs = np.zeros((2, 2))
    for col in range(2):
        n = length[col]
        total, mass, trans = 0.0, np.zeros(n), np.zeros((2, 2))
        for code in range(2**n):
            y = [(code >> k) & 1 for k in range(n)]
            v = math.exp(s * y[0] + sum(e[ids[k, col]] * y[k] for k in range(n)) + sum(t[y[k - 1], y[k]] for k in range(1, n)))
            total += v
            mass += v * np.array(y)
            for k in range(1, n):
                trans[y[k - 1], y[k]] += v
        assert p[:n, col] == pytest.approx(mass / total) and (p[n:, col] == 0).all()
        assert z[col] == pytest.approx(math.log(total))
        want_pairs += trans / total
    assert pairs == pytest.approx(want_pairs)


def test_toxicity(spark):
    texts, labels = toxic_corpus()
    df = docs(spark, [*texts, "", None])
    marks = spark.createDataFrame([(k, 1, y) for k, y in enumerate(labels)], "doc_id long, quality int, toxic int")
    model = toxicity.fit_from_labels(df, marks)
    tagged = toxicity.tag_toxicity(df, model)
    rows = {r["doc_id"]: r for r in tagged.withColumn("held", toxicity.held_out(tagged["doc_id"])).collect()}
    held = [k for k in range(len(texts)) if rows[k]["held"]]
    assert 0.1 < len(held) / len(texts) < 0.3
    assert np.mean([rows[k]["predicted"] == labels[k] for k in held]) > 0.97
    for k, t in enumerate(texts):
        assert all(t[s["start"] : s["end"]].split()[0] in ("idiotx", "scumx", "trashx") for s in rows[k]["spans"])
    assert rows[len(texts)]["score"] == rows[len(texts) + 1]["score"] < 0.5
    kept = toxicity.drop_toxic(df, model)
    assert kept.columns == df.columns
    assert {r["doc_id"] for r in kept.collect()} == {k for k, r in rows.items() if not r["predicted"]}
    assert toxicity.tag_toxicity(docs(spark, []), model).count() == 0
    bare = toxicity.fit_from_labels(df, marks.where("false"))
    assert {r["predicted"] for r in toxicity.tag_toxicity(df, bare).collect()} <= {0, 1}
    flipped = marks.selectExpr("doc_id", "quality", "if(pmod(crc32(cast(doc_id as string)), 5) = 0, 1 - toxic, toxic) toxic")
    again = toxicity.fit_from_labels(df, flipped)
    assert (again.emission == model.emission).all()  # held-out labels are never read


def test_neighbours_weigh_in():
    """Own, previous and next weights, against the sum over all tag sequences."""
    rng = np.random.default_rng(1)
    e, s, t = rng.normal(size=(3, 5)), -0.2, rng.normal(size=(2, 2))
    ids, length = rng.integers(0, 4, (4, 2)).astype(np.int32), np.array([4, 2])
    p, _, z = toxicity.marginals(ids, length, e, s, t)
    for col in range(2):
        n = length[col]
        x = [4, *ids[:n, col], 4]
        w = [e[0][x[k]] + e[1][x[k - 1]] + e[2][x[k + 1]] for k in range(1, n + 1)]
        total, mass = 0.0, np.zeros(n)
        for code in range(2**n):
            y = np.array([(code >> k) & 1 for k in range(n)])
            v = math.exp(s * y[0] + float(y @ w) + sum(t[y[k - 1], y[k]] for k in range(1, n)))
            total, mass = total + v, mass + v * y
        assert p[:n, col] == pytest.approx(mass / total) and z[col] == pytest.approx(math.log(total))


def test_columns_carry_the_whole_chain(monkeypatch):
    """Strong transitions, so that far tokens matter: columns and blocks change nothing."""
    rng = np.random.default_rng(4)
    model = toxicity.Model({}, {}, rng.normal(size=(3, 6)) * 0.3, 1.5, np.array([[6.0, 0.0], [0.0, 6.0]]), np.array([-1.0, 2, 0.5, 1]))
    coded = [rng.integers(0, 5, n).astype(np.int32) for n in (0, 3, 9, 16, 17, 40, 63, 200)]
    whole, flags = toxicity._scored(coded, model, spans=True)
    monkeypatch.setattr(toxicity, "STRETCH", 8)
    monkeypatch.setattr(toxicity, "COLUMN", 8)
    for cells in (8, 64, 1 << 19):
        monkeypatch.setattr(toxicity, "CELLS", cells)
        cut, cut_flags = toxicity._scored(coded, model, spans=True)
        assert np.allclose(cut, whole, rtol=0, atol=1e-12)
        assert all((a == b).all() for a, b in zip(flags, cut_flags, strict=True))


def test_long_texts_are_scored_in_stretches(monkeypatch):
    texts, labels = toxic_corpus()
    model = toxicity.fit(texts, np.array(labels))
    rng = random.Random(3)
    long = " ".join(rng.choice(texts) for _ in range(300))
    code = toxicity._Features(model.lexicon, model.endings)
    coded = [code.of(long), code.of("")]
    parts, over = toxicity._scored(coded, model, spans=True)
    monkeypatch.setattr(toxicity, "STRETCH", 10**9)
    whole, at_once = toxicity._scored(coded, model, spans=True)
    assert len(coded[0]) > 4096 and over[0].sum() > 10
    assert (over[0] == at_once[0]).all() and np.allclose(parts, whole, rtol=0, atol=1e-9)
    huge = "fine words here " * 400_000  # 6 MB, read without a list of its words
    assert len(code.of(huge)) == 1_200_000 and (code.of(huge)[:3] == code.of("fine words here")).all()


def test_long_labelled_texts_are_pieces_of_the_sample(spark):
    """No labelled text is left out for its length; clashing names and null ids are fine."""
    texts, labels = toxic_corpus()
    texts = [t + " filler" * 20_000 if k % 10 == 0 else t for k, t in enumerate(texts)]
    rows = [(k, t, y, 0.5, 1) for k, (t, y) in enumerate(zip(texts, labels, strict=True))] + [(None, "scumx", 1, 0.5, 1), (3, "again", 0, 0.5, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, y int, score double, predicted int")
    marks = spark.createDataFrame([(k, 1, y) for k, y in enumerate(labels)], "doc_id long, quality int, toxic int")
    model = toxicity.fit_from_labels(df, marks)
    assert "filler" in model.lexicon or "ler" in model.endings
    out = toxicity.tag_toxicity(df, model)
    assert out.columns == ["doc_id", "score", "predicted", "n_toxic_tokens", "spans"] and out.count() == len(rows)
    assert toxicity.drop_toxic(df, model).columns == df.columns


def test_offsets_of_changed_length_words():
    text = "İdiot and scum"
    over = np.array([True, False, True])
    got = toxicity._offsets(text, over)
    assert [text[s["start"] : s["end"]] for s in got] == ["İdiot", "scum"]
