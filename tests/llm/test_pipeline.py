import random
import re
from collections import Counter

import numpy as np

import corpus_pipeline
from lexispan.llm import toxicity
from tests.llm.test_text_ops import brute_classes, brute_windows, near_texts, passages, split, toxic_corpus

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def tables(spark, folder):
    rng = random.Random(4)
    toxic, labels = toxic_corpus(250)
    near = near_texts(21, 8)
    texts = toxic + near + passages(9, 30) + [near[0] + " ", toxic[0] + "\n"]
    ids = rng.sample(range(5000), len(texts))
    rows = [(i, t, "en", "s", len(t or "")) for i, t in zip(ids, texts, strict=True)]
    spark.createDataFrame(rows, COLUMNS).write.parquet(f"{folder}/documents.parquet")
    marks = [(i, 1, y) for i, y in zip(ids, labels, strict=False)]
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return rows


def test_stages_against_brute_force(spark, tmp_path):
    folder = str(tmp_path)
    tables(spark, folder)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, folder)
        if k < 4:
            assert out.dtypes == docs.dtypes, name
        out.write.parquet(f"{folder}/{k}")
        kept.append(([tuple(r) for r in docs.collect()], [r.asDict() for r in spark.read.parquet(f"{folder}/{k}").collect()]))
        docs = spark.read.parquet(f"{folder}/{k}")
    # toxicity: what the fitted model predicts, all other rows untouched
    before, after = kept[0]
    start = spark.read.parquet(f"{folder}/documents.parquet")
    model = toxicity.fit_from_labels(start, spark.read.parquet(f"{folder}/labels.parquet"))
    bad = {r["doc_id"] for r in toxicity.tag_toxicity(start, model).where("predicted = 1").collect()}
    assert bad and sorted(r["doc_id"] for r in after) == sorted(r[0] for r in before if r[0] not in bad)
    # exact: the longest original, then the least id
    before, after = kept[1]
    groups = {}
    for r in before:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", r[1] or ""), []).append((-len(r[1] or ""), r[0]))
    assert sorted(r["doc_id"] for r in after) == sorted(min(g)[1] for g in groups.values())
    # near: the least id of each class
    before, after = kept[2]
    classes = brute_classes([r[1] for r in before], [r[0] for r in before])
    assert sorted(r["doc_id"] for r in after) == sorted(i for i, c in classes.items() if i == c)
    # substring: the words that brute force keeps
    before, after = kept[3]
    want = Counter({(i, n - gone): 1 for (i, n, gone, _) in brute_windows([r[1] for r in before], [r[0] for r in before])})
    assert Counter((r["doc_id"], len(split(r["text"]))) for r in after) == want
    untouched = {i for (i, n, gone, _) in brute_windows([r[1] for r in before], [r[0] for r in before]) if not gone}
    texts = {r[0]: r[1] for r in before}
    assert all((texts[r["doc_id"]] or "") == r["text"] and r["n_chars"] == len(r["text"]) for r in after if r["doc_id"] in untouched)
    # packing: every word has its place
    before, after = kept[4]
    placed = Counter()
    for r in after:
        placed[r["doc_id"]] += r["length"]
    assert placed == Counter({r[0]: len(split(r[1])) for r in before})


def test_run_applies_all_stages(spark, tmp_path):
    folder = str(tmp_path)
    tables(spark, folder)
    out = corpus_pipeline.run(spark, folder).toPandas()
    assert len(out) and (np.sort(out["bin_id"].dropna().unique()) == np.arange(out["bin_id"].nunique())).all()


def test_odd_rows_and_empty_tables(spark, tmp_path):
    """Null ids, null and empty texts, a long text, repeated rows and columns with the
    operators' own names pass through every stage."""
    schema = "doc_id long, text string, row string, batch int, payload binary, score double, text_sha256 string, n_words int, kept boolean"
    extra = ("r", 1, b"p", None, "s", None, True)
    passage = " ".join(f"q{k}" for k in range(30))
    texts = [(None, None), (None, "null id"), (1, None), (2, ""), (3, "same row"), (3, "same row"), (4, "w " * 30_000), (5, f"a {passage}"), (6, f"{passage} b c d e f g h i j k l"), (7, "other text")]
    spark.createDataFrame([(i, t, *extra) for i, t in texts], schema).write.parquet(f"{tmp_path}/a/documents.parquet")
    spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/b/documents.parquet")
    for part in "ab":
        rows = [(1, None, 1), (5, 1, None), (None, 1, 1)] if part == "a" else []
        spark.createDataFrame(rows, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/{part}/labels.parquet")
        folder = f"{tmp_path}/{part}"
        docs = spark.read.parquet(f"{folder}/documents.parquet")
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, docs, folder)
            out.write.parquet(f"{folder}/{k}")
            docs = spark.read.parquet(f"{folder}/{k}")
        if part == "b":
            assert docs.isEmpty()
    kept = spark.read.parquet(f"{tmp_path}/a/3")
    assert kept.columns == [f.split(" ")[0] for f in schema.split(", ")]
    got = {(r["doc_id"], r["text"]) for r in kept.collect()}
    assert {(None, "null id"), (3, "same row"), (5, f"a {passage}"), (6, "b c d e f g h i j k l"), (7, "other text"), (4, "w " * 30_000)} <= got
    assert len(got) == 7  # one of the three texts without words stays
