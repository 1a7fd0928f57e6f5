import random
import re

from pyspark.sql import functions as F

from lexispan.functions import text as T
from lexispan.operators import boxed, records, segment

TORN = ["제", "제 1", "2", "장", "장총칙", "절 목적", "관", "", "부", "칙", " 제3 ", "본문", "제1장"]
WHOLE = [records.MARKDOWN.chapter, records.MARKDOWN.section, records.MARKDOWN.subsection]
WORDS = "doc string, page int, x0 double, y0 double, x1 double, y1 double, word string, block int, line int"
TABLES = "doc string, page int, tbl int, x0 double, y0 double, x1 double, y1 double, rows array<array<string>>"


def ahead(lines):
    out, i = [], 0
    lines = [x.strip() for x in lines]
    while i < len(lines):
        took = None
        if re.search(r"^제\s*\d*\s*$", lines[i]):
            for k in range(1, 4):
                if i + k < len(lines) and any(re.search(p, "".join(lines[i : i + k + 1])) for p in WHOLE):
                    took = k
                    break
        out.append("".join(lines[i : i + (took or 0) + 1]))
        i += (took or 0) + 1
    return out


def test_look_ahead_consumes_from_the_top(spark):
    rng = random.Random(3)
    docs = {d: [rng.choice(TORN) for _ in range(rng.randrange(40))] for d in range(80)} | {1000: ["제 1", "장총칙", "제1조(목적)"], 1001: ["제"] * 30 + ["1", "장"], 1002: ["제", "1"]}
    df = spark.createDataFrame([(d, n, x) for d, lines in docs.items() for n, x in enumerate(lines)], "doc int, line_no int, line string")
    got = {}
    for r in segment.merge_ahead(df, ["line_no"], r"^제\s*\d*\s*$", WHOLE).orderBy("doc", "line_no").collect():
        got.setdefault(r["doc"], []).append(r["line"])
    for d, lines in docs.items():
        assert got.get(d, []) == ahead(lines), lines
    assert got[1000] == ["제 1장총칙", "제1조(목적)"]


def headings(lines):
    """Headings and split markers put together in one pass."""
    structural = lambda s: re.search(boxed.STRUCTURAL, s.strip())
    out, i = [], 0
    while i < len(lines):
        s = lines[i].strip()
        if s == "부" and i + 1 < len(lines) and lines[i + 1].strip() == "칙":
            out.append("부칙")
            i += 2
            continue
        for pattern, word in ((boxed.CHAPTER_ALONE, "장"), (boxed.SECTION_ALONE, "절")):
            if m := re.search(pattern, s):
                parts, i = [], i + 1
                while i < len(lines) and lines[i].strip() and not structural(lines[i]):
                    parts.append(lines[i].strip())
                    i += 1
                out.append(f"제{m[1]}{word} {''.join(parts)}")
                break
        else:
            m = re.search(boxed.CHAPTER_TITLED, s)
            out.append(f"제{m[1]}장 {m[2]}" if m else lines[i])
            i += 1
    return out


def test_whole_headings_equal_one_pass(spark):
    rng = random.Random(8)
    kinds = ["제 1 장", "제2장  총칙", "총", "칙", "부", "제3절", "제4조(목적) 이", "", "목 적", "규정은"]
    docs = {d: [rng.choice(kinds) for _ in range(rng.randrange(1, 30))] for d in range(60)}
    df = spark.createDataFrame([(d, n, x) for d, lines in docs.items() for n, x in enumerate(lines)], "doc int, line_no int, line string")
    got = {}
    for r in boxed.whole_headings(df).orderBy("doc", "line_no").collect():
        got.setdefault(r["doc"], []).append(r["line"])
    for d, lines in docs.items():
        assert [x.strip() for x in got[d]] == [x.strip() for x in headings(lines)], lines


def words_of(doc, page, lines):
    return [(doc, page, k * 10.0, n * 10.0, k * 10.0 + 9, n * 10.0 + 9, w, 0, n) for n, line in enumerate(lines) for k, w in enumerate(line.split())]


STATUTE = {
    1: "학 칙\n제정 1981.3.1.\n개정 2020.2.2\n제 1 장\n총\n칙\n제1조(목적) 이 학칙은",
    2: "교육을 한다.\n가 나\n다 라\n제2조(조기졸업) 다음과\n제 2 장 입학",
    3: "선교중국어학과 45\n제1절\n모집\n제3조 모집한다.\n부\n칙\n이 학칙은 1999년부터\n시행한다.\n① 둘째\n[별표 1]",
    4: " 신학과, 음악과 ",
}


def test_statutes_with_tables(spark):
    pages = spark.createDataFrame([("s", p, t) for p, t in STATUTE.items()] + [("t", 1, "제1조 끝났다."), ("t", 2, "표 없음")], "doc string, page int, text string")
    words = spark.createDataFrame(words_of("s", 2, STATUTE[2].split("\n")) + words_of("s", 3, STATUTE[3].split("\n")), WORDS)
    grid = [["가", "나"], ["다", "라"]]
    tables = [("s", 2, 0, 0.0, 10.0, 30.0, 29.0, grid), ("s", 3, 0, 0.0, 0.0, 30.0, 9.0, [["선교중국어학과", "45"]]), ("s", 3, 1, 0.0, 60.0, 99.0, 69.0, [["이", "학칙은"]]), ("s", 1, 0, 0.0, 0.0, 99.0, 99.0, [["학", "칙"]])]
    tables = spark.createDataFrame(tables, TABLES)
    titles = spark.createDataFrame([("s", 120, "학칙"), ("t", 121, "짧은 것")], "doc string, seq int, toc_title string")
    moving = F.contains("line", F.lit("선교중국어학과")) & F.contains("line", F.lit("<table"))
    out = boxed.extract_statutes(pages, words, tables, titles, moving, T.matches(F.col("line"), r"^제2조"))
    got = {r["doc"]: r for r in out.collect()}
    s = got["s"]
    table = lambda rows: '<div class="article-table-wrap"><table class="inline-table"><tbody>' + "".join("<tr>" + "".join(f"<td>{c}</td>" for c in r) + "</tr>" for r in rows) + "</tbody></table></div>"
    assert (s["parsed_title"], s["enact_date"], s["amend_dates"], s["pdf_pages"], s["table_pages"]) == ("학 칙", "1981.3.1", ["1981.3.1", "2020.2.2"], [1, 2, 3, 4], [2, 3])
    # the last page continued the last table; the stray row of article 2 went back to it
    assert [(a["chapter"], a["section"], a["no"], a["body"]) for a in s["articles"]] == [
        ("제1장 총칙", None, "1", "제1조(목적) 이 학칙은 교육을 한다. " + table(grid)),
        ("제1장 총칙", None, "2", "제2조(조기졸업) 다음과 " + table([["선교중국어학과<br>신학과, 음악과", "45"]])),
        ("제2장 입학", "제1절 모집", "3", "제3조 모집한다."),
    ]
    assert s["addenda"] == ["이 학칙은 1999년부터 시행한다.", "① 둘째"] and "attachments" not in out.columns
    t = got["t"]
    assert ([a["body"] for a in t["articles"]], t["pdf_pages"], t["table_pages"]) == (["제1조 끝났다. 표 없음"], [1, 2], None)


def test_a_moved_line_without_its_anchor_goes(spark):
    pages = spark.createDataFrame([("s", 1, "제1조 가\n옮김\n제2조 나")], "doc string, page int, text string")
    none = spark.createDataFrame([], TABLES)
    titles = spark.createDataFrame([("s", 1, "x")], "doc string, seq int, toc_title string")
    found = lambda anchor: [a["body"] for a in boxed.extract_statutes(pages, spark.createDataFrame([], WORDS), none, titles, F.col("line") == "옮김", T.matches(F.col("line"), anchor)).first()["articles"]]
    assert found("^제2조") == ["제1조 가", "제2조 나 옮김"] and found("^제9조") == ["제1조 가", "제2조 나"]


def test_patched_book_and_owners(spark):
    texts = ["1. 학칙\n학칙\n제1조 이\nA B\nC D\n규정은", "표지", "2. 내규\n내규\n제1조 <끝>"]
    pages = spark.createDataFrame([("b", k + 1, t) for k, t in enumerate(texts)], "doc string, page int, text string")
    words = spark.createDataFrame([w for k in (0, 2) for w in words_of("b", k + 1, texts[k].split("\n"))], WORDS)
    grid = [["A", "B"], ["C", None]]
    tables = [("b", 1, 0, 0.0, 30.0, 30.0, 49.0, grid), ("b", 3, 0, 500.0, 500.0, 600.0, 600.0, grid), ("b", 9, 0, 0.0, 0.0, 1.0, 1.0, grid), ("b", 2, 0, 0.0, 0.0, 1.0, 1.0, [["A"]])]
    toc = spark.createDataFrame([("b", 1, "l", None, "학칙"), ("b", 2, "l", None, "내규")], "doc string, n int, l0 string, l1 string, title string")
    anchors = spark.createDataFrame([("b", 1, 0, "규정은")], "doc string, page int, tbl int, anchor string")
    run = lambda a: boxed.patch_book(pages, words, spark.createDataFrame(tables, TABLES), toc, ["n"], a)
    html = '<div class="article-table-wrap"><table class="inline-table"><tbody><tr><td>A</td><td>B</td></tr><tr><td>C</td><td></td></tr></tbody></table></div>'
    bodies = lambda found: [r["articles"][0]["body"] for r in found.orderBy("seq").collect()]
    found, owners = run(None)
    assert bodies(found) == [f"제1조 이 {html} 규정은", "제1조 <끝>"]
    assert sorted((r["page"]["page"], r["seq"]) for r in owners.collect() if r["seq"]) == [(1, 1), (3, 2)] and owners.where("seq IS NULL").count() == 1
    assert bodies(run(anchors)[0])[0] == f"제1조 이 규정은 {html}"
