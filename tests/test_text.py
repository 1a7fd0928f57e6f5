import datetime as dt
import html
import re

from pyspark.sql import functions as F

from lexispan.functions import text as T


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).first()["y"]


def test_like_folds_ascii_only_and_keeps_wildcards(spark):
    rows = [("Ab%c",), ("É",), (r"a\b",), ("axxb",), (None,)]
    df = spark.createDataFrame(rows, "x string")
    hits = lambda q: [r["x"] for r in df.where(T.like_ascii(F.col("x"), q)).collect()]
    assert hits("aB") == ["Ab%c"]
    assert hits("é") == []
    assert hits("\\b") == [r"a\b"]
    assert sorted(hits("a%b")) == ["Ab%c", r"a\b", "axxb"]
    assert hits("A__B") == ["axxb"]


def test_snippet_like_the_plain_version(spark):
    def plain(body, q, n=40):
        i = body.lower().find(q.lower())
        if i < 0:
            return html.escape(body[: 2 * n]) + ("…" if len(body) > 2 * n else "")
        a, b = max(0, i - n), min(len(body), i + len(q) + n)
        inner = html.escape(body[a:i]) + "<mark>" + html.escape(body[i : i + len(q)]) + "</mark>" + html.escape(body[i + len(q) : b])
        return ("…" if a else "") + inner + ("…" if b < len(body) else "")

    bodies = ["Key at start", "ends with KEY", "<b>" * 40 + "key & 'x'" + "\"y\"" * 30, "nothing " * 30, "", "short"]
    df = spark.createDataFrame([(b,) for b in bodies], "x string").select("x", T.snippet(F.col("x"), "key").alias("y"))
    for r in df.collect():
        assert r["y"] == plain(r["x"], "key")


def test_labels(spark):
    df = spark.createDataFrame([(3, None, None), (3, 0, ""), (3, 2, "목적")], "n int, s int, t string")
    assert [r[0] for r in df.select(T.article_label(F.col("n"), F.col("s"), F.col("t"))).collect()] == ["제3조", "제3조", "제3조의2(목적)"]


def test_tag_dates_and_change_date(spark):
    old, new = "a (개정 2011. 9.23)", "b (개정 2011.9.23, 2020.1.5) [신설 2021.1.1] (2022.1.1)"
    df = spark.createDataFrame([(old, new, "2024-01-02"), (old, old, "2024-01-02"), (None, new, "x")], "o string, n string, d string")
    got = df.select(T.tag_dates(F.col("n")).alias("t"), T.change_date(F.col("o"), F.col("n"), F.col("d")).alias("c")).collect()
    assert got[0]["t"] == ["2011.09.23", "2020.01.05"]
    assert tuple(got[0]["c"]) == ("2020.01.05", "tag")
    assert tuple(got[1]["c"]) == ("2024.01.02", "fallback")
    assert tuple(got[2]["c"]) == ("2020.01.05", "tag-multi")


def test_noise(spark):
    a = "가나​ 다…[표 - 별표 참조] 라·마...  바 "
    assert one(spark, a, T.noise_stripped) == "가나다…라마.바"
    assert one(spark, None, T.noise_stripped) == ""


def test_titles(spark):
    df = spark.createDataFrame([("제3조(목적) x", "제3조 (목적과 범위) y"), ("제3조(목적)", "제3조(벌칙)"), ("x", "제1조(a)")], "o string, n string")
    assert [r[0] for r in df.select(T.titles_conflict(F.col("o"), F.col("n"))).collect()] == [False, True, False]
    assert one(spark, "학칙 개정(안) (69회)", T.archive_title) == "학칙"
    assert one(spark, "우리 대학교 연구 ・윤리", lambda c: T.archive_key(c, "우리대학교")) == "연구윤리"


def test_months_keep_to_day_28(spark):
    f = lambda n: lambda c: T.add_months_28(c, n)
    assert one(spark, dt.date(2023, 5, 31), f(9), "date") == dt.date(2024, 2, 28)
    assert one(spark, dt.date(2023, 12, 1), f(1), "date") == dt.date(2024, 1, 1)


def test_dates(spark):
    assert one(spark, "규정집 202003.pdf", T.file_date) == dt.date(2020, 3, 1)
    assert one(spark, "2020.11.9", T.file_date) == dt.date(2020, 11, 9)
    assert one(spark, "none", T.file_date) is None
    assert one(spark, "2011.09", T.text_date) is None
    assert one(spark, "2011년 9월 3일 및 2012년 10월 11일, 2011년 9월 3일", T.worded_dates) == ["2011.09.03", "2012.10.11"]


def test_cells_and_tables(spark):
    assert one(spark, "| a<br>b | **c**  d |", T.split_row) == ["a<br>b", "**c**  d"]
    assert one(spark, "a<br>b <u>**c**</u>  d ", T.clean_cell) == "a b c d"
    df = spark.createDataFrame([([["a", "1"]],), ([["a\nb\nc\nd", None], ["x", "y"]],), ([["a", "b"]],)], "r array<array<string>>")
    r = F.col("r")
    got = df.select(T.real_table(r), T.real_table(r, digit_row=True), T.degenerate(r)).collect()
    assert [tuple(x) for x in got] == [(False, True, False), (True, True, True), (False, False, False)]
    assert "<td>a<br>b<br>c<br>d</td><td></td>" in df.select(T.table_html(r)).collect()[1][0]


def test_heads_and_highlight(spark):
    df = spark.createDataFrame([("제 3조의 2 (목적) x", 3, 2), ("제3조(목적) x", 3, None), ("제4조 x", 3, None)], "b string, n int, s int")
    assert [r[0] for r in df.select(T.strip_article_head(F.col("b"), F.col("n"), F.col("s"))).collect()] == [" x", " x", "제4조 x"]
    assert one(spark, "a (개정 2011) (b)", T.highlight_amendments) == 'a <span class="amend-tag">(개정 2011)</span> (b)'


def test_full_text(spark):
    df = spark.createDataFrame([("a", "b"), ("", "b"), (None, "b"), ("a", "제1조 (현행과 같음)"), ("a~", "b")], "o string, n string")
    assert [r[0] for r in df.select(T.full_text(F.col("o"), F.col("n"))).collect()] == [True, False, False, False, False]


def test_python_and_spark_white_space_agree(spark):
    s = " a　b  c\t\n"
    assert one(spark, s, T.normalize_ws) == re.sub(r"\s+", " ", s).strip()


def test_converted_and_stored_lines(spark):
    lines = ["1.  2. 둘", "11. 2. 셋", " 1. 2. x", "- ① 항", "-②", "**굵게** 1. 2. y", None]
    df = spark.createDataFrame(list(enumerate(lines)), "k int, s string")
    got = [r["v"] for r in df.select("k", T.list_repairs(F.col("s")).alias("v")).orderBy("k").collect()]
    assert got == ["2. 둘", "11. 2. 셋", " 1. 2. x", "① 항", "②", "굵게 1. 2. y", None]
    glued = spark.createDataFrame([("**시행한다.부칙** 1조",), ("이 부칙",)], "s string").select(T.whole_lines(F.col("s")).alias("v"))
    assert sorted(r["v"] for r in glued.collect()) == [["시행한다.", "부칙 1조"], ["이 부칙"]]
    stored = spark.createDataFrame([(" 제1조\n\n  가\t나 ",), ("",)], "s string").select(T.stored_body(F.col("s")).alias("v"))
    assert sorted(r["v"] for r in stored.collect()) == ["", "제1조 가 나"]
