import math
import re
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lexispan.llm import lexical_search as L
from lexispan.llm import queries as Q

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def folded(text):
    return re.findall(TERM, "".join(c.lower() if c.isascii() else c for c in text or ""))


def brute(docs, items):
    counts = [(i, Counter(folded(t))) for i, t in docs]
    n_docs, total = sum(bool(c) for _, c in counts), sum(sum(c.values()) for _, c in counts)
    out = []
    for item, text in items:
        scores = []
        for doc, c in counts:
            score = 0
            for t in set(folded(text)):
                if tf := c[t]:
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * sum(t in x for _, x in counts) + 1)))
                    m = 100 - 90 + 90 * sum(c.values()) * n_docs // total
                    score += w * (1_000_000_000 * tf // (1000 * tf + 8 * m))
            if score > 0:
                scores.append((-score, doc is None, doc or 0, doc))
        out += [(item, k, d, -s) for k, (s, _, _, d) in enumerate(sorted(scores)[:10], 1)]
    return sorted(out, key=str)


def got(df):
    assert df.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted(map(tuple, df.collect()), key=str)


DOCS = [(k, f"common Word{k % 7} word{k % 3} {'again ' * (k % 5)} ÉTÉ{k % 2}") for k in range(60)]
DOCS += [(60, None), (61, ""), (62, "-- !!"), (5, "rare"), (5, "rare"), (None, "rare"), (None, "RARE again"), (70, "common " * 4000), (71, "x\x00y common")]
ITEMS = [(1, "common word1 WORD2"), (2, "rare"), (3, "absent"), (4, None), (None, "again été0 ÉTÉ1"), (2, "rare"), (7, "common common common y"), (8, "")]


def frames(spark, docs, items):
    rows = spark.createDataFrame([(i, t, 1, 0.5, "d") for i, t in docs], "doc_id long, text string, rank int, score double, item_id string")
    return rows.repartition(5), spark.createDataFrame([(i, t, 9) for i, t in items], "item_id long, text string, doc_id int")


def test_ranking_equals_brute_force(spark, monkeypatch):
    docs, items = frames(spark, DOCS, ITEMS)
    want = brute(DOCS, ITEMS)
    assert got(L.rank_documents(docs, items)) == want
    monkeypatch.setattr(L, "INDEX_BYTES", 40)  # several indexes in turn
    monkeypatch.setattr(L, "SLICE_BYTES", 300)
    monkeypatch.setattr(L, "PAIRS", 10)
    assert got(L.rank_documents(docs, items)) == want


def test_empty_tables(spark):
    docs, items = frames(spark, DOCS, ITEMS)
    assert got(L.rank_documents(docs.limit(0), items)) == got(L.rank_documents(docs, items.limit(0))) == []


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 4), st.one_of(st.none(), st.integers(0, 9))), max_size=60))
def test_heap_keeps_the_best(offers):
    heap = L.Heap()
    for score, doc in offers:
        heap.offer(score, doc)
    order = lambda x: (-x[0], x[1] is None, x[1] or 0)
    assert sorted(((s, x.doc) for s, x in heap.rows), key=order) == sorted(offers, key=order)[:10]


def test_terms_equal_the_vectorised_ones():
    import pyarrow as pa

    texts = ["Ab-cD\x7fé É_x9 ﬁx\x00z", None, "", "日本 日本-日本", "{}|~"]
    index = L.index_items([(0, " ".join(t or "" for t in texts))])
    c = L.count_terms(index, pa.array(texts))
    assert c.length.tolist() == [len(folded(t)) for t in texts]
    names = [x.decode() for x in index.dictionary.to_pylist()]
    pairs = {(d, names[t]): n for d, t, n in zip(c.doc.tolist(), c.term.tolist(), c.tf.tolist(), strict=True)}
    assert pairs == {(k, t): n for k, text in enumerate(texts) for t, n in Counter(folded(text)).items()}


@pytest.mark.parametrize("sf", ["sf0.001"])
def test_query_on_whole_tables(spark, sf):
    docs = [tuple(r) for r in spark.read.parquet(f"/root/testdata/{sf}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"/root/testdata/{sf}/benchmark.parquet").select("item_id", "text").collect()]
    assert got(Q.op13_lexical_search(spark, f"/root/testdata/{sf}")) == brute(docs, items)
