import json

import pytest
from pyspark.sql import functions as F

from lexispan.sources import files, store

RECORD = "seq int, toc_title string, l0 string, l1 string, enact_date string, pdf_pages array<int>, amend_dates array<string>, articles array<struct<chapter string, section string, gwan string, no string, sub_no string, title string, body string>>, addenda array<string>, attachments array<struct<label string, lines array<string>, start_page int, end_page int>>"


def records(spark, body="본문"):
    art = lambda no, text: (None, None, None, no, None, "목적", text)
    return spark.createDataFrame([(1, "학칙", "l", None, "2001.1.1", [1, 2], ["2001.1.1"], [art("1", body), art("2", "둘")], ["끝"], [("[별표 1]", ["x"], 2, 2)]), (2, "내규", "l", "m", None, [3], [], [art("1", "셋")], [], [])], RECORD)


def bodies(tables):
    return sorted(r["body"] for r in tables["articles"].collect())


def test_a_book_is_saved_whole(spark, tmp_path):
    root = str(tmp_path / "book")
    assert store.current(spark, root).number == 0
    assert store.reload_book(spark, root, records(spark)) == 1
    first, tables = store.read(spark, root)
    assert (first, bodies(tables)) == (1, ["둘", "본문", "셋"])
    ids = {r["body"]: r["id"] for r in tables["articles"].collect()}
    edits = spark.createDataFrame([(ids["본문"], "고친 본문"), (ids["둘"], "둘"), (99, "none")], "id long, body string")
    number, changes = store.save_edits(spark, root, edits, 1, "2024-05-06", "까닭", "now")
    assert number == 2 and [(r["article_no"], r["old_body"], r["new_body"], r["ordinal"]) for r in changes.collect()] == [(1, "본문", "고친 본문", 0)]
    _, new = store.read(spark, root)
    assert bodies(new) == ["고친 본문", "둘", "셋"] and bodies(tables) == bodies(store.read(spark, root, 1)[1]) == ["둘", "본문", "셋"]
    assert [(r["regulation_id"], r["revised_at"], r["summary"]) for r in new["revisions"].collect()] == [(1, "2024.05.06", "까닭")]
    assert sorted((r["amend_date"], r["ordinal"]) for r in new["amendments"].where("regulation_id = 1").collect()) == [("2001.1.1", 0), ("2024.05.06", 1)]
    # what isn't changed isn't written again
    a, b = store.current(spark, root, 1).tables, store.current(spark, root, 2).tables
    assert a["regulations"] == b["regulations"] and a["articles"] != b["articles"]
    # equal bodies are no save
    number, changes = store.save_edits(spark, root, spark.createDataFrame([(ids["둘"], "둘")], "id long, body string"), 1, "2024-05-07", None, "now")
    assert number == 2 and changes.isEmpty()
    # a reload keeps the revisions
    assert store.reload_book(spark, root, records(spark, "새 본문")) == 3
    _, again = store.read(spark, root)
    assert bodies(again) == ["둘", "새 본문", "셋"] and again["revisions"].count() == 1
    with pytest.raises(LookupError):
        store.read(spark, root, 9)


def test_a_save_that_dies_is_never_seen(spark, tmp_path):
    root = str(tmp_path / "s")
    store.save(spark, root, 0, {"a": spark.range(3), "b": spark.range(1)})
    broken = spark.range(2).selectExpr("raise_error('broken') AS id")
    with pytest.raises(Exception, match="broken"):
        store.save(spark, root, 1, {"a": spark.range(7), "b": broken})
    number, tables = store.read(spark, root)
    assert (number, tables["a"].count(), tables["b"].count()) == (1, 3, 1)


def test_concurrent_saves(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "s")
    store.save(spark, root, 0, {"a": spark.range(1)})
    store.save(spark, root, 1, {"a": spark.range(2)})
    with pytest.raises(store.ConcurrentSave):
        store.save(spark, root, 1, {"a": spark.range(9)})
    # a writer that looked before the other one's manifest was there is refused afterwards
    look, stale = store.current, store.current(spark, root, 1)
    monkeypatch.setattr(store, "current", lambda s, r, n=None: stale if n is None else look(s, r, n))
    with pytest.raises(store.ConcurrentSave):
        store.save(spark, root, 1, {"a": spark.range(9)})
    monkeypatch.undo()
    number, tables = store.read(spark, root)
    assert (number, tables["a"].count()) == (2, 2)


@pytest.mark.parametrize("rows", [0, 1, 7, 25])
def test_json_arrays_of_any_length(spark, tmp_path, monkeypatch, rows):
    monkeypatch.setattr(files, "ARRAY_ROWS", 4)
    data = [((k * 7) % 25, f'"{k}"]\n[,', None) for k in range(rows)]
    df = spark.createDataFrame(data, "k int, s string, none string").repartition(3)
    out = tmp_path / "out"
    files.write_json_array(df, str(out), ["k"])
    parts = sorted(p for p in out.iterdir() if p.name.startswith("part-"))
    whole = json.loads("".join(p.read_text() for p in parts))
    assert whole == [dict(zip(("k", "s", "none"), r, strict=True)) for r in sorted(data)]
    assert sorted(tuple(r) for r in files.read_written_array(spark, str(out), df.schema).collect()) == sorted(data)
    assert len(parts) == 1 if rows <= 4 else len(parts) > 1
    files.write_json_array(df, str(out))
    assert files.read_written_array(spark, str(out), df.schema).count() == rows


def test_reports_tables_and_editions(spark, tmp_path):
    df = spark.createDataFrame([(1, "a\tb", "matched"), (2, "c", "unmatched")], "seq int, title string, section string")
    files.write_report(df, str(tmp_path / "r"), "section")
    assert sorted(p.name for p in (tmp_path / "r").iterdir() if p.is_dir()) == ["section=matched", "section=unmatched"]
    assert spark.read.option("sep", "\t").csv(str(tmp_path / "r")).count() == 2
    files.write_table(df, str(tmp_path / "t"))
    files.write_table(df.limit(1), str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t")).count() == 1
    for name in ("규정집(2020.3.1).pdf", "하/규정집(2020.3.1) 사본.pdf", "규정집(2021.5.6).pdf", "규정집(2030.1.1).pdf", "초안(2020.9.9).pdf", "none.pdf"):
        (tmp_path / "e" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "e" / name).write_bytes(b"x")
    got = files.read_editions(spark, str(tmp_path / "e"), "2020-01-01", "2022-12-31", ("초안",)).orderBy("edition").collect()
    assert [str(r["edition"]) for r in got] == ["2020-03-01", "2021-05-06"] and "하/" not in got[0]["path"].rsplit("/e/", 1)[1]
    assert spark.range(1).select(files.file_url(F.col("id"), F.col("id"))).first()[0] == "/forms/reg0_att0.pdf"
