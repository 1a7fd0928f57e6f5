import functools
import hashlib
import os

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexispan.llm import bpe_codec as B
from lexispan.llm import queries as Q

pytestmark = pytest.mark.skipif(not os.path.exists(B.MODEL_PATH), reason="the vocabulary file isn't here")

HARD = [
    "", " ", "  ", "\n", " \n ", "a\n\nb", "a \t b  c   ", "it's we're I'll they've I'd I'm 't 'tis 'S", "!'s '' ''s '''ll x'y' 're're", "a1b22 c33d", "\r\n x　　y\x85z\xa0'm",
    "<|endoftext|>", "a<|endoftext|> b<|endoftext|><|endoftext|>'s", " <|endoftext|> ", "<|endoftext|", "日本語テキスト 한국어 العربية", "é x​é ", "😀😀 👨‍👩‍👧", "\x00\x01\x1c\x1f a",
    "naïve—“quotes”… ½ ² Ⅷ ٣", "\U00010940 \U0001e6c0a ꟎1", "a" * 700, " the" * 50, "0" * 301, "ab" * 400 + "!" * 300, "x'sy'tz", "' s", "'́s", "\n's", " 's", "\t's\n'd"]


@functools.cache
def loaded():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(B.MODEL_PATH)
    t.no_truncation()
    t.no_padding()
    return B.load_model(open(B.MODEL_PATH, "rb").read()), t


@pytest.fixture
def model():
    return loaded()[0]


@pytest.fixture
def library():
    return loaded()[1]


def encoded(model, texts, words=()):
    e = B.Encoder(model, B.Transducer(B.compile_lexicon({w: B.merge(model, w) for w in words})))
    ids, ends = e.encode(texts)
    return [ids[a:b].tolist() for a, b in zip(ends[:-1], ends[1:], strict=True)]


def wanted(library, texts):
    return [x.ids for x in library.encode_batch(texts, add_special_tokens=False)]


def test_hard_texts_equal_the_library(model, library):
    want = wanted(library, HARD)
    assert encoded(model, HARD) == want
    assert encoded(model, HARD, [b" the", b"the", b"it", b"'s", b"\n"]) == want
    assert [B.decode(model, np.array(x, np.uint32)) for x in want] == [library.decode(x, skip_special_tokens=False) for x in want] == HARD


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=30), st.text(alphabet=" \n'sltdremv!a1é<|>endoftx", max_size=40)), max_size=6))
def test_random_texts_equal_the_library(texts):
    model, library = loaded()
    assert encoded(model, texts, [b" a", b"a"]) == wanted(library, texts)


def test_every_character_is_of_the_librarys_kind(model, library):
    chars = [chr(c) for c in range(0x20000) if not 0xD800 <= c < 0xE000]
    texts = ["".join(f"a{c}1 {c}{c} b" for c in chars[k : k + 4096]) for k in range(0, len(chars), 4096)]
    split = library.pre_tokenizer.pre_tokenize_str
    for t in texts:
        words, _ = B.split_words(model.kinds, [t])
        ends = np.cumsum([len(w.decode()) for w in words.to_pylist()]).tolist()
        assert ends == [span[1] for _, span in split(t)]


def test_blocks_of_a_long_text(model, library):
    text = "".join(f"wörd{k % 97}!? 'll it's\n\n  x{k}" for k in range(3000)) + "z" * 5000 + "日本" * 900
    for size in (50, 1000, 7000):
        parts = list(B.blocks(model.kinds, text, size))
        assert "".join(parts) == text and len(parts) > 3
        joined = [w for p in parts for w in B.split_words(model.kinds, [p])[0].to_pylist()]
        assert joined == B.split_words(model.kinds, [text])[0].to_pylist()
    assert list(B.pieces(model, "a<|endoftext|>b")) == ["a", 50256, "b"]


def test_long_words_merge_as_short_ones_do(model):
    rng = np.random.default_rng(1)
    for n in (2, 50, 180):
        word = bytes(rng.choice(list(b"aabtheing "), n).tolist())
        assert B._merge_long(model, [model.byte_ids[b] for b in word]) == B.merge(model, word)


def test_transducer_is_minimal_and_exact():
    entries = {b"walking": [5, 1, 2], b"talking": [6, 1, 2], b"walk": [5], b"talk": [6], b"x": [9, 9], b"xy": [9]}
    t = B.Transducer(B.compile_lexicon(entries))
    # after w and after t the same words with the same ids remain: the root, a, l, k, -, i, n, g, x
    assert len(t.finals) == 9
    words = [*entries, b"wal", b"walki", b"", b"zz", b"walkingg", b"y"]
    held, counts, ids = t.find(pa.array(words, pa.binary()))
    assert held.tolist() == [True] * 6 + [False] * 6
    assert counts.tolist() == [3, 3, 1, 1, 2, 1] + [0] * 6 and ids.tolist() == [5, 1, 2, 6, 1, 2, 5, 6, 9, 9, 9]
    held, counts, ids = B.Transducer(B.compile_lexicon({})).find(pa.array([b"a"], pa.binary()))
    assert (held.tolist(), counts.tolist(), ids.tolist()) == ([False], [0], [])


def test_decoding_of_odd_ids(model, library):
    broken = [library.token_to_id("Ã"), 50256, library.token_to_id("ł"), 70000]
    assert B.decode(model, np.array(broken, np.uint32)) == library.decode(broken, skip_special_tokens=False)


def test_query_equals_the_library(spark, library):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    got = {r["doc_id"]: r for r in Q.op11_bpe_codec(spark, "/root/testdata/sf0.001").collect()}
    assert got.keys() == rows.keys()
    for i, want in zip(rows, wanted(library, list(rows.values())), strict=True):
        decoded = library.decode(want, skip_special_tokens=False)
        assert got[i]["n_tokens"] == len(want)
        assert got[i]["ids_sha256"] == hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256(decoded.encode()).hexdigest()


def test_odd_rows(spark, model, library):
    texts = [*HARD, None, "same", "same"]
    rows = [(k if k % 5 else None, t, b"x", 1) for k, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids binary, n_tokens int")
    back = B.decode_documents(B.encode_documents(df, model, lexicon_words=100), model)
    want = sorted((-1 if i is None else i, len(x), t or "") for (i, t, *_), x in zip(rows, wanted(library, [t or "" for t in texts]), strict=True))
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], r["n_tokens"], r["decoded"]) for r in back.collect()) == want
    none = B.encode_documents(df.limit(0), model)
    assert none.count() == 0 and none.columns == ["doc_id", "n_tokens", "ids"]


def test_frequent_words(spark, model):
    df = spark.createDataFrame([("a b b c c c",), (None,), ("c c a",)], "text string")
    counts = B.count_words(df, model)
    assert {bytes(r["word"]): r["n"] for r in counts.collect()} == {b"a": 1, b" a": 1, b" b": 2, b" c": 4, b"c": 1}
    assert sorted(B.frequent_words(counts)) == [b" b", b" c"] and B.frequent_words(counts, 1) == [b" c"] and B.frequent_words(counts, 0) == []
    assert B.frequent_words(counts.where(F.lit(False))) == []


def test_the_same_lexicon_is_shared_once(spark):
    content = B.compile_lexicon({b"once": [1]})
    df = spark.range(1)
    assert B.share_lexicon(df, content) == B.share_lexicon(df, content)
