import datetime as dt
import random
import re

import pytest
from pyspark.sql import functions as F

from lexispan.functions.text import IN_FORCE
from lexispan.operators import catalog, dml, history, reconcile, render, similar, spacing
from lexispan.sources import files


def book(spark):
    regs = [(1, 1, "Alpha rules", "A", None, IN_FORCE), (2, 2, "beta_rules", "B", "x", IN_FORCE), (3, 3, "Gone", "A", None, "폐지"), (4, 4, "alpha two", None, "", IN_FORCE)]
    amend = [(1, "2011.10.01", 0), (1, "2011.9.23", 1), (2, "2020.01.01", 0)]
    arts = [(10, 1, 1, None, "목적", "The KEY <b>", 0), (11, 1, 2, 2, None, "other", 1), (12, 3, 1, None, None, "key", 0)]
    return catalog.Book(
        spark.createDataFrame([(*r[:5], r[5], "e", None, "1-2") for r in regs], "id long, seq long, title string, category_l0 string, category_l1 string, status string, enact_date string, department string, source_pages string"),
        spark.createDataFrame(amend, "regulation_id long, amend_date string, ordinal int"),
        spark.createDataFrame(arts, "id long, regulation_id long, no int, sub_no int, title string, body string, ordinal int").selectExpr("id", "regulation_id", "'c' chapter", "null section", "null gwan", "no", "sub_no", "title", "body", "ordinal"),
        spark.createDataFrame([(1, "부칙", 0)], "regulation_id long, line string, ordinal int"),
        spark.createDataFrame([(1, "form ALPHA", None, 0), (3, "x", [["c"]], 0)], "regulation_id long, label string, rows array<array<string>>, ordinal int").selectExpr("*", "1 start_page", "2 end_page", "array('l') lines", "'u' file_url"),
        spark.createDataFrame([(1, 1, "2020.01.01", "s", "t1"), (2, 1, "2020.01.01", "s2", "t2")], "id long, regulation_id long, revised_at string, summary string, created_at string"),
        spark.createDataFrame([(1, 1, None, "목적", "a", "b", 0)], "revision_id long, article_no int, article_sub_no int, article_title string, old_body string, new_body string, ordinal int"),
    )


def test_lists(spark):
    b = book(spark)
    page, n = catalog.list_regulations(b, q="ALPHA", sort="date")
    assert [(r["id"], r["latest_amend"]) for r in page.collect()] == [(1, "2011.9.23"), (4, None)]
    assert n.first()["total"] == 2
    page, n = catalog.list_regulations(b, q="key", scope="body")
    assert [(r["regulation_id"], r["article_label"], r["snippet"]) for r in page.collect()] == [(1, "제1조(목적)", "The <mark>KEY</mark> &lt;b&gt;")]
    page, _ = catalog.list_regulations(b, page=-3, page_size=2)
    assert [r["id"] for r in page.collect()] == [1, 2]
    with pytest.raises(ValueError):
        catalog.list_regulations(b, sort="x")
    assert [r["id"] for r in catalog.recent(b, 1).collect()] == [2]
    assert {(r["regulation_id"], r["has_table"]) for r in catalog.attachments(b, "alpha").collect()} == {(1, 0)}
    assert [(r["revised_at"], r["id"]) for r in catalog.revisions_by_date(b).collect()] == [("2020.01.01", 2)]
    assert [r["changed_count"] for r in catalog.revisions(b).orderBy("id").collect()] == [1, 0]


def test_detail_and_tree(spark):
    b = book(spark)
    r = catalog.detail(b, 1).first()
    assert [x["amend_date"] for x in r["amendments"]] == ["2011.10.01", "2011.9.23"]
    assert [x["no"] for x in r["articles"]] == [1, 2] and r["addenda"][0]["line"] == "부칙"
    with pytest.raises(LookupError):
        catalog.detail(b, 99)
    with pytest.raises(LookupError):
        catalog.revision_detail(b, 99)
    assert len(catalog.revision_detail(b, 1).first()["changes"]) == 1
    rows = catalog.nested_tree(b, ["B"]).collect()
    assert [r["l0"] for r in rows] == ["B", "A", "(미분류)"]
    assert rows[0]["groups"][0]["name"] == "x" and rows[2]["groups"][0]["name"] == "__direct__"


def test_spacing_equals_the_callback(spark):
    rng = random.Random(2)
    texts = [" ".join("".join(rng.choice("abc") for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(0, 14))) for _ in range(60)] + ["", "a  b", "a\nb c"]
    pairs = {"ab", "ca", "bb"}

    def fix(t):
        def join(m):
            left, right = m[0].split(" ")
            return left + right if left[-1] + right[0] in pairs else m[0]

        for _ in range(4):
            t = re.sub("[a-c]+ [a-c]+", join, t)
        return t

    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    table = spark.createDataFrame([(p,) for p in pairs], "pair string")
    got = {r["id"]: r["text"] for r in spacing.close_gaps(df, table, letters="a-c").collect()}
    assert got == {k: fix(t) for k, t in enumerate(texts)}


def test_spacing_of_repeated_and_null_keys(spark):
    rows = [(1, "a b c d"), (1, "x y z"), (None, "a b"), (None, "a b"), (2, None)]
    df = spark.createDataFrame(rows, "id int, text string")
    out = spacing.close_gaps(df, spark.createDataFrame([("ab",), ("bc",)], "pair string"), letters="a-z")
    assert out.columns == df.columns
    assert sorted((tuple(r) for r in out.collect()), key=str) == sorted([(1, "abc d"), (1, "x y z"), (None, "ab"), (None, "ab"), (2, None)], key=str)


def test_spacing_statistics(spark):
    df = spark.createDataFrame([("가나다 라마 가나",), ("가",), (None,)], "text string")
    assert {(r["pair"], r["joined"]) for r in spacing.joined_pairs(df).collect()} == {("가나", 2), ("나다", 1), ("라마", 1)}
    assert {(r["pair"], r["split"]) for r in spacing.split_pairs(df).collect()} == {("다라", 1)}
    joined = spark.createDataFrame([("xy", 20), ("yz", 14), ("학교", 99)], "pair string, joined long")
    split = spark.createDataFrame([("xy", 2), ("yz", 1), ("학교", 1), ("이다", 1)], "pair string, split long")
    assert [r["pair"] for r in spacing.candidates(joined, split).collect()] == ["xy"]


def test_shingles_and_best_match(spark):
    df = spark.createDataFrame([("abcabc",), ("ab",), ("a😀b😀c",)], "x string")
    got = [sorted(r[0]) for r in df.select(similar.shingles(F.col("x"))).collect()]
    assert got == [["abc", "bca", "cab"], [], sorted(["a😀b", "😀b😀", "b😀c"])]
    atts = spark.createDataFrame([("d", 0, 1, 2, "abcdef"), ("d", 1, 1, 1, "zzzzzz"), ("d", 2, None, None, "abc")], "doc string, attachment int, start_page int, end_page int, text string")
    tabs = spark.createDataFrame([("d", 2, 0, "a b c d e f"), ("d", 1, 0, "abc"), ("d", 1, 1, "abcdef"), ("d", 9, 0, "abcdef")], "doc string, page int, tbl int, text string")
    got = {r["attachment"]: (r["page"], r["tbl"], r["score"]) for r in similar.best_match(atts, tabs).collect()}
    assert got == {0: (1, 1, 1.0), 1: (None, None, None), 2: (None, None, None)}


def test_best_match_anywhere(spark):
    atts = spark.createDataFrame([(250, "abcdef"), (251, "zzzzzz"), (252, "a"), (253, None), (254, "uvwxyz")], "attachment int, text string")
    tabs = spark.createDataFrame([(7, "abc"), (901, "a b c d e f"), (902, "abcdef"), (3, "uvwx"), (3, "uv"), (4, None)], "tbl int, text string")
    got = {r["attachment"]: (r["tbl"], r["score"]) for r in similar.best_match_anywhere(atts, tabs).collect()}
    assert got == {250: (901, 1.0), 251: (None, None), 252: (None, None), 253: (None, None), 254: (3, 0.5)}


@pytest.mark.parametrize("sent", [similar.BROADCAST_ROWS, 0])
def test_best_match_meets_every_table_in_range(spark, monkeypatch, sent):
    monkeypatch.setattr(similar, "BROADCAST_ROWS", sent)
    """Against every pair: random texts, repeated keys, other books and empty tables."""
    import random

    rng = random.Random(5)
    word = lambda k: "".join(rng.choices("abcd", k=k))
    atts = [(rng.choice("de"), i % 25, lo := rng.randint(0, 8), lo + rng.randint(-1, 6), word(rng.randint(0, 14))) for i in range(40)]
    tabs = [(rng.choice("de"), rng.randint(0, 12), i % 50, word(rng.randint(0, 60))) for i in range(80)]
    grams = lambda t: {t[i : i + 3] for i in range(len(t) - 2)}
    want = {}
    for doc, att, lo, hi, text in atts:
        ask = grams(text)
        found = [(-len(ask & grams(t)) / len(ask), page, tbl) for d, page, tbl, t in tabs if d == doc and lo <= page <= hi and ask and 2 * len(ask & grams(t)) >= len(ask)]
        want[doc, att] = min([*found, *([want[doc, att]] if want.get((doc, att)) else [])], default=None)
    a_schema, t_schema = "doc string, attachment int, start_page int, end_page int, text string", "doc string, page int, tbl int, text string"
    a, t = spark.createDataFrame(atts, a_schema), spark.createDataFrame(tabs, t_schema)
    got = {(r["doc"], r["attachment"]): r["score"] and (-r["score"], r["page"], r["tbl"]) for r in similar.best_match(a, t).collect()}
    assert got == want and any(want.values()) and not all(want.values())
    assert {r["score"] for r in similar.best_match(a, t.limit(0)).collect()} == {None}
    assert similar.best_match(a.limit(0), t).count() == 0


def test_best_match_query_meets_shorter_and_longer_documents(spark, tmp_path):
    """No document is out of reach for its length: item 1 lies in one a third as long, item 2
    in one far longer, item 3 in none."""
    import duckdb

    import __spark_entry__

    rng = random.Random(8)
    text = lambda n, of: "".join(rng.choices(of, k=n))
    a, b = text(60, "abcdefgh"), text(20, "ijklmnop")
    spark.createDataFrame([(1, a + " " * 150), (2, b), (3, "0123456789")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = [(5, text(90, "qrst")), (250, a), (301, a + a), (470, text(1500, "uvwx") + b), (9, None)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(tuple(r) for r in __spark_entry__.queries()["best_match"](spark, str(tmp_path)).collect())
    assert got == [(1, 2, 250, 1.0), (2, 4, 470, 1.0), (3, None, None, None)]
    db = duckdb.connect()
    for name in ("benchmark", "documents"):
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    assert sorted(db.execute(__spark_entry__.oracle_sql()["best_match"]).fetchall()) == got


def test_history(spark):
    def snap(date, *regs):
        return (date, "f", [(t, len(a), [("c", None, None, *x) for x in a]) for t, a in regs])

    from lexispan.schemas import SNAPSHOT

    snaps = spark.createDataFrame(
        [
            snap("2020-01-01", ("가 규정", [("1", None, "t", "old"), ("2", "", "t", "same")]), ("빈", [])),
            snap("2021-01-01", ("가규정", [("1", None, "t", "old "), ("2", None, "t", "same (개정 2020.5.5)")]), ("가규정", [("1", None, "t", "duplicate")])),
            snap("2022-01-01", ("가·규정", [("1", None, "t", "new")])),
        ],
        SNAPSHOT,
    )
    regs = spark.createDataFrame([(7, "가 규정")], "id long, title string")
    live = spark.createDataFrame([(7, 1, None, "t", "newest"), (7, 2, None, "t", "same (개정 2020.5.5)")], "regulation_id long, no int, sub_no int, title string, body string")
    got = history.revision_history(snaps, regs, live).orderBy("article_no", "observed_at", "new_body").collect()
    assert [(r["article_no"], r["revised_at"], r["method"], r["old_body"].strip(), r["new_body"], r["article_title"]) for r in got] == [
        (1, "2022.01.01", "fallback", "old", "new", "t"),
        (1, "2022.01.01", "fallback", "new", "newest", "t"),
        (2, "2020.05.05", "tag", "same", "same (개정 2020.5.5)", "t"),
    ]
    exclude = spark.createDataFrame([(7, "2022-01-01", 1, None)], "regulation_id long, observed_at string, article_no int, article_sub_no int")
    dates = spark.createDataFrame([(7, "2020.05.05", "2020.05.06")], "regulation_id long, revised_at string, corrected string")
    got = history.revision_history(snaps, regs, live, exclude=exclude, dates=dates).collect()
    assert [(r["article_no"], r["revised_at"]) for r in got] == [(2, "2020.05.06")]
    seed = history.revisions_from_changes(history.revision_history(snaps, regs, live), "auto").orderBy("revised_at").collect()
    assert [(r["revised_at"], [c["ordinal"] for c in r["changes"]]) for r in seed] == [("2020.05.05", [0]), ("2022.01.01", [0, 1])]


def test_reconcile(spark):
    b = book(spark)
    rec = spark.createDataFrame([(1, dt.date(2019, 5, 1), "우리대학교 Alpha ・rules"), (2, dt.date(2019, 1, 1), "Alpha rules"), (3, dt.date(2019, 1, 1), "Gone")], "record_id long, session_date date, title string")
    got = {r["record_id"]: (r["regulation_id"], r["status"]) for r in reconcile.crosscheck(rec, b.regulations, b.revisions, institution="우리대학교").collect()}
    assert got == {1: (1, "covered"), 2: (1, "gap"), 3: (None, "unmatched")}
    block = "| 현행규정 | 개정(안) | 비고 |\n|---|---|---|\n| 제1조(목적) a | 제1조(목적) **b**<br>c | |\n| (신설) | 제2조의 3 n | |\n| 제4조 x | 삭제 | |\n| | | |\n| no | number |\n| one |"
    changes = reconcile.comparison_changes(spark.createDataFrame([(2, block)], "record_id long, content string")).orderBy("line_no").collect()
    assert [(r["article_no"], r["article_sub_no"], r["article_title"], r["old_body"], r["new_body"]) for r in changes] == [
        (1, None, "목적", "제1조(목적) a", "제1조(목적) b c"), (2, 3, None, None, "제2조의 3 n"), (4, None, None, "제4조 x", None)]
    checked = reconcile.crosscheck(rec, b.regulations, b.revisions, institution="우리대학교")
    editions = spark.createDataFrame([(dt.date(2018, 1, 1),), (dt.date(2019, 10, 3),)], "edition date")
    existing = spark.createDataFrame([], "regulation_seq long, revised_at string")
    fill = lambda days, ex=existing: reconcile.fill_gaps(checked, reconcile.comparison_changes(spark.createDataFrame([(2, block)], "record_id long, content string")), editions, ex, "s", days).collect()
    out = fill(275)
    assert [(r["regulation_seq"], r["revised_at"], len(r["changes"])) for r in out] == [(1, "2019.10.03", 1)]
    assert fill(274) == []
    assert fill(275, spark.createDataFrame([(1, "2019.10.03")], "regulation_seq long, revised_at string")) == []


def test_stages(spark):
    names = ["2-1 x", "10", "최종", "규정집 2020", "2"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    got = {r["n"]: r["r"] and tuple(r["r"]) for r in df.select("n", reconcile.stage_rank(F.col("n")).alias("r")).collect()}
    assert got == {"2-1 x": (2, 1), "10": (10, 0), "최종": (9999, 0), "규정집 2020": None, "2": (2, 0)}


def test_next_edition(spark):
    events = spark.createDataFrame([(1, dt.date(2020, 1, 1)), (2, dt.date(2020, 1, 6)), (3, dt.date(2021, 1, 1))], "id int, d date")
    editions = spark.createDataFrame([(dt.date(2020, 1, 6),), (dt.date(2020, 2, 1),)], "e date")
    got = {r["id"]: r["next"] for r in reconcile.next_edition(events, editions, "d", "e", 5).collect()}
    assert got == {1: dt.date(2020, 1, 6), 2: dt.date(2020, 1, 6), 3: None}


def test_insert_chronologically_equals_the_shift(spark):
    rng = random.Random(9)
    rows, new, want = [], [], set()
    for key in range(40):
        dates = [f"20{rng.randint(10, 30)}.01.01" for _ in range(rng.randint(0, 5))]
        dates = list(dict.fromkeys(sorted(dates) if rng.random() < 0.7 else dates))
        add = f"20{rng.randint(10, 30)}.01.01"
        rows += [(key, d, k) for k, d in enumerate(dates)]
        new.append((key, add))
        if add not in dates:
            at = next((k for k, d in enumerate(dates) if d > add), len(dates))
            dates.insert(at, add)
        want |= {(key, d, k) for k, d in enumerate(dates)}
    df = spark.createDataFrame(rows, "regulation_id int, amend_date string, ordinal int")
    got = dml.insert_chronologically(df, spark.createDataFrame(new, "regulation_id int, amend_date string"), "regulation_id", "amend_date")
    assert {tuple(r) for r in got.select("regulation_id", "amend_date", "ordinal").collect()} == want


def test_save_and_seed(spark):
    b = book(spark)
    same, changes = dml.save_revision(b, 1, "2024-01-02", spark.createDataFrame([(10, "The KEY <b>"), (99, "x")], "id long, body string"))
    assert changes.isEmpty() and same.revisions.count() == 2 and same.amendments.count() == 3
    new, changes = dml.save_revision(b, 1, "2011-10-01", spark.createDataFrame([(10, "changed"), (11, "other")], "id long, body string"), "why", "now")
    assert [(r["revision_id"], r["article_no"], r["old_body"], r["new_body"]) for r in changes.collect()] == [(3, 1, "The KEY <b>", "changed")]
    assert new.amendments.count() == 3 and new.articles.where("id = 10").first()["body"] == "changed"
    new, _ = dml.save_revision(b, 1, "2012-01-01", spark.createDataFrame([(10, "changed")], "id long, body string"))
    assert new.amendments.where("amend_date = '2012.01.01'").first()["ordinal"] == 2
    seed = dml.seed_entries(b)
    fresh = b._replace(revisions=b.revisions.where("false"), revision_changes=b.revision_changes.where("false"))
    once = dml.load_seed(fresh, seed, "now")
    assert once.revisions.count() == 1  # two entries share regulation and date
    twice = dml.load_seed(once, seed, "now")
    assert twice.revisions.count() == 1 and twice.revision_changes.count() == once.revision_changes.count()
    assert dml.load_seed(b, None, "now") is b


def test_numbers_are_gapless(spark):
    df = spark.createDataFrame([(k % 17, str(k)) for k in range(90)], "k int, v string")
    rows = dml.numbered(df, "k", ["v"], per_cell=20).collect()
    assert sorted(r["number"] for r in rows) == list(range(1, 91))


def test_merge_and_renumber(spark):
    t = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    u = spark.createDataFrame([(2, "B"), (3, "C"), (1, None)], "k int, v string")
    assert {tuple(r) for r in dml.merge(t, u, ["k"], ["v"]).collect()} == {(1, "a"), (2, "B"), (3, "C")}
    m = spark.createDataFrame([(1, 9)], "old int, new int")
    assert {r["k"] for r in dml.renumber(t, m, "k").collect()} == {9, 2}
    assert [r["k"] for r in dml.without_keys(t, "k", [1]).collect()] == [2]


def test_render():
    def slow(o, n):
        a, b = re.findall(r"\S+|\s+", o), re.findall(r"\S+|\s+", n)
        dp = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a) - 1, -1, -1):
            for j in range(len(b) - 1, -1, -1):
                dp[i][j] = dp[i + 1][j + 1] + 1 if a[i] == b[j] else max(dp[i + 1][j], dp[i][j + 1])
        left = right = ""
        i = j = 0
        while i < len(a) or j < len(b):
            if i < len(a) and j < len(b) and a[i] == b[j]:
                left, right, i, j = left + a[i], right + b[j], i + 1, j + 1
            elif j == len(b) or (i < len(a) and dp[i + 1][j] >= dp[i][j + 1]):
                left, i = left + f'<span class="diff-del">{a[i]}</span>', i + 1
            else:
                right, j = right + f'<span class="diff-ins">{b[j]}</span>', j + 1
        return left, right

    rng = random.Random(4)
    for _ in range(300):
        o, n = (" ".join(rng.choice("abcd") for _ in range(rng.randint(0, 12))) for _ in range(2))
        assert render.token_diff(o, n) == slow(o, n)
    assert render.token_diff(None, "<") == ("", '<span class="diff-ins">&lt;</span>')
    got = render.formatted("가 (개정 2011. 9. 23) ① 나 1. 다 ② 마 <table><td> 1. x</td></table> 3. z")
    assert got == (
        '가 (개정 2011. 9. 23) <br><span class="hang-marker">①</span> 나 <span class="list-indent">1. 다 </span><br><span class="hang-marker">②</span>'
        ' 마 <table><td> 1. x</td></table> <span class="list-indent">3. z</span>'
    )
    assert render.displayed("a 1. b ① c 2. d") == "a \n1. b \n① c \n  2. d"


def test_files(spark, tmp_path):
    (tmp_path / "2020.json").write_text('{"date": "2020-01-01", "source_file": "f", "regulations": [{"title": "t", "article_count": 1, "articles": [{"no": "1", "body": "b"}]}]}')
    (tmp_path / "_report.json").write_text("{}")
    assert [r["date"] for r in files.read_snapshots(spark, str(tmp_path)).collect()] == ["2020-01-01"]
    assert files.read_seed(spark, str(tmp_path / "none.json")) is None
    md = tmp_path / "a.md"
    md.write_text("## 제1조 x\n\n<table>\n<tr><td>1</td></tr>\n</table>\ntail")
    got = [r["line"] for r in files.read_markdown_lines(spark, str(md)).orderBy("line_no").collect()]
    assert got == ["제1조 x", '<div class="article-table-wrap"><table class="inline-table">\n<tr><td>1</td></tr>\n</table></div>', "tail"]
    c = tmp_path / "c.json"
    c.write_text('{"20200101": {"k": {"title_raw": "t", "content": "x", "stage": "1", "file": "f"}}, "p": {"k": {"content": "y"}}}')
    assert [(r["session"], r["title"], r["content"]) for r in files.read_committee(spark, str(c), ("p",)).collect()] == [("20200101", "k", "x")]
    out = tmp_path / "out"
    files.write_json_array(spark.createDataFrame([(1, "a")], "i int, s string"), str(out))
    assert files.read_json_array(spark, str(out), spark.createDataFrame([], "i int, s string").schema).first()["s"] == "a"
    p = tmp_path / "p.txt"
    p.write_text("1. a\nx\f- 2 -\ny")
    assert files.read_pages(spark, str(p)).count() == 2
    assert [r["line"] for r in files.read_plain_lines(spark, str(p)).collect()][-1] == "y"


def test_json_array_is_ordered_and_split(spark, tmp_path, monkeypatch):
    df = spark.range(3).select((2 - F.col("id")).alias("i"), F.when(F.col("id") != 1, "s").alias("s"))
    files.write_json_array(df, str(tmp_path / "a"), ["i"])
    assert [r["i"] for r in files.read_json_array(spark, str(tmp_path / "a"), df.schema).collect()] == [0, 1, 2]
    monkeypatch.setattr(files, "ARRAY_ROWS", 2)
    files.write_json_array(df, str(tmp_path / "b"), ["i"])
    assert [r["i"] for r in files.read_written_array(spark, str(tmp_path / "b"), df.schema).orderBy("i").collect()] == [0, 1, 2]


def test_records_to_tables(spark):
    from lexispan.schemas import REGULATION_RECORD

    rec = (1, "A", None, "1", "t", "t", "2001.1.1", ["2001.1.1"], 1, [("c", None, None, "3", "2", "x", "b")], ["부칙"], [("l", ["a"], 1, 1, None, None)], [4, 5])
    b = dml.load_records(spark.createDataFrame([rec], REGULATION_RECORD))
    assert b.regulations.first()["source_pages"] == "4-5"
    assert tuple(b.articles.select("no", "sub_no").first()) == (3, 2)
    assert b.attachments.first()["lines"] == ["a"] and b.addenda.count() == 1


def test_loaded_articles_are_numbered_and_statuses_counted(spark):
    from lexispan.schemas import REGULATION_RECORD

    art = ("c", None, None, "3", "", "x", "b")
    recs = [(s, "A", None, "1", "t", "t", "2001.1.1", [], n, [art] * n, [], [], []) for s, n in ((1, 2), (2, 0), (3, 3))]
    b = dml.load_records(spark.createDataFrame(recs, REGULATION_RECORD))
    assert sorted(r["id"] for r in b.articles.collect()) == [1, 2, 3, 4, 5]
    rows = spark.createDataFrame([("gap",), ("gap",), (None,)], "status string")
    assert {(r["status"], r["n"]) for r in reconcile.status_counts(rows).collect()} == {("gap", 2), (None, 1)}
    assert reconcile.status_counts(rows.limit(0)).count() == 0
