import datetime as dt

from pyspark.sql import functions as F

from lexispan.functions import text as T
from lexispan.operators import catalog, segment
from lexispan.sources import files


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).first()["y"]


def test_edition_dates(spark):
    assert one(spark, "2019 책 (개정일 2020.3.1) (2018.1.1).pdf", T.edition_date) == dt.date(2020, 3, 1)
    assert one(spark, "책(2021-12-05).pdf", T.edition_date) == dt.date(2021, 12, 5)
    assert one(spark, "책 2022년 1월 2일.pdf", T.edition_date) == dt.date(2022, 1, 2)
    assert one(spark, "책.pdf", T.edition_date) is None


def test_small_strings(spark):
    assert one(spark, "제 3 조 의 2, 제4 장", T.tighten) == "제3조의2, 제4장"
    assert one(spark, ["1) 규정", "| a |", "개정 2020.1.1", "2. 연구 윤리"], T.clean_title, "array<string>") == "연구 윤리"
    assert one(spark, ["개정 2020.1.1"], T.clean_title, "array<string>") == "개정 2020.1.1"
    assert one(spark, [], T.clean_title, "array<string>") == ""
    assert one(spark, "no table", lambda c: T.append_to_last_row(c, F.lit("x"))) == "no table"
    got = one(spark, "<tr><td>a</td></tr><tr><td>b</td><td>c</td></tr>", lambda c: T.append_to_last_row(c, F.lit("x<\ny")))
    assert got == "<tr><td>a</td></tr><tr><td>b<br>x&lt;<br>y</td><td>c</td></tr>"
    assert one(spark, "a 3. 학칙 시행세칙 b - 12 - c", lambda c: T.page_noise_removed(c, ["학칙", "학칙 시행세칙"])) == "a b  c"


def test_markdown_tables(spark):
    lines = ["x", "| a | b< |", "|---|:--:|", "| 1 | |", "y", "| 부 칙 |", "|---|", "| ① 시행 | - 3 - |", "| - 4 - |"]
    df = spark.createDataFrame([("d", k, x) for k, x in enumerate(lines)], "doc string, n int, line string")
    got = [r["line"] for r in segment.markdown_tables(df, ["n"]).orderBy("n").collect()]
    assert got == ["x", '<table class="inline-table"><tr><th>a</th><th>b&lt;</th></tr><tr><td>1</td><td></td></tr></table>', "y", "부칙", "① 시행"]


def test_relocate(spark):
    lines = ["<table> m", "제54조 a", "b", "제55조 c", "<table> m2"]
    df = spark.createDataFrame([("d", k, x) for k, x in enumerate(lines)] + [("e", 0, "<table> m"), ("e", 1, "x")], "doc string, n int, line string")
    c = F.col("line")
    out = segment.relocate(df, "n", c.startswith("<table>"), c.startswith("제54조"), c.startswith("제"))
    assert [r["line"] for r in out.where("doc = 'd'").orderBy("place").collect()] == ["제54조 a", "b", "<table> m", "<table> m2", "제55조 c"]
    assert [r["line"] for r in out.where("doc = 'e'").collect()] == ["x"]


def test_archive(spark, tmp_path):
    root = tmp_path / "archive"
    for name in ("20200101 a/2-1 안/x.md", "20200101 a/규정집/y.md", "20200101 a/z.md", "other/1/w.md", "20200101 a/1/v.txt"):
        p = root / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(name)
    got = {(r["session"], r["stage"], r["file"], tuple(r["rank"]), r["content"]) for r in files.read_archive(spark, str(root)).collect()}
    assert got == {("20200101 a", "2-1 안", "x.md", (2, 1), "20200101 a/2-1 안/x.md"), ("20200101 a", "", "z.md", (0, 0), "20200101 a/z.md")}


def test_amendment_links(spark):
    b = catalog.Book(
        None,
        spark.createDataFrame([(1, "2020.01.01", 0), (1, "2021.01.01", 1)], "regulation_id long, amend_date string, ordinal int"),
        revisions=spark.createDataFrame([(5, 1, "2020.01.01", "s", "t"), (6, 1, "2020.01.01", "s", "t")], "id long, regulation_id long, revised_at string, summary string, created_at string"),
    )
    got = {(r["amend_date"], r["revision_id"], r["has_revision"]) for r in catalog.amendment_links(b).collect()}
    assert got == {("2020.01.01", 6, True), ("2021.01.01", None, False)}
