import random
import re

import pytest
from pyspark.sql import functions as F

from lexispan.operators import dml, segment
from lexispan.operators import records as R


def ws(s):
    return re.sub(r"\s+", " ", s).strip()


def fold(lines, g, hint=None):
    """The same record by one pass over (page, line) pairs."""
    lines = [(p, x.strip()) for p, x in lines if x.strip()]
    dated, rest = [], []

    def dates_of(s):
        if m := re.search(g.date_line, s):
            raw = m[2]
            if g.listed_dates:
                ds = [d for d in (re.sub(r"\s+", "", x).strip(".") for x in raw.split(",")) if d]
                return [(m[1], d, k == len(ds) - 1) for k, d in enumerate(ds)]
            return [(m[1], (raw.strip() if g.spaced_dates else re.sub(r"\s+", "", raw)).rstrip("."), True)]
        if g.table_dates and re.search(R.TABLE_ROW, s) and re.findall(g.table_dates, s):
            return [(k, re.sub(r"\s+", "", d), True) for k, d in re.findall(g.table_dates, s)]
        return None

    for p, s in lines:
        found = dates_of(s) if g.dates_anywhere else None
        if found is not None:
            dated += found
        elif not (g.dates_anywhere and g.table_dates and re.search(R.TABLE_DIVIDER, s)):
            rest.append((p, s))
    opening = [g.chapter, g.article] + [g.addenda] * g.addenda_opens_body
    start = next((k for k, (_, s) in enumerate(rest) if any(re.search(x, s) for x in opening)), len(rest) if g.addenda_opens_body else 0)
    front = []
    for _, s in rest[:start]:
        found = None if g.dates_anywhere else dates_of(s)
        if found is None:
            front.append(s)
        else:
            dated += found
    heads, arts, tail, inside, open_ = [None] * 3, [], [], False, False
    for p, s in rest[start:]:
        if re.search(g.addenda, s):
            if inside and g.keep_separators:
                tail.append((p, "부칙"))
            inside = True
        elif inside:
            tail.append((p, s))
        elif m := re.search(g.chapter, s):
            heads, open_ = [ws(f"제{m[1]}장 {m[2]}"), None, None], False
        elif m := re.search(g.section, s):
            heads, open_ = [heads[0], ws(f"제{m[1]}절 {m[2]}"), None], False
        elif m := re.search(g.subsection, s):
            heads, open_ = [*heads[:2], ws(f"제{m[1]}관 {m[2]}")], False
        elif m := re.search(g.article, s):
            arts.append([*heads, *m.groups(), [s]])
            open_ = True
        elif open_:
            arts[-1][-1].append(s)
    arts = [tuple(a[:-1]) + (ws(" ".join(a[-1])),) for a in arts]
    units, forced = [], True
    for p, s in tail:
        if not units or g.unit is None or forced or re.search(g.unit, s) or re.search(g.attachment, s):
            units.append([[p], s])
        else:
            units[-1][0].append(p)
            units[-1][1] += " " + s
        forced = "<table" in s or s == "부칙"
    addenda, atts, current = [], [], None
    for ps, u in units:
        if g.separators_close and u == "부칙":
            current = None
            addenda.append(u)
        elif re.search(g.attachment, u):
            current = [u, [], []]
            atts.append(current)
        elif current is not None:
            current[1].append(u)
            current[2] += ps
        else:
            addenda.append(u)
    paged = lambda ps, f: f(ps) + 1 if ps and ps[0] is not None else None
    atts = [(a, x, paged(ps, min), paged(ps, max)) for a, x, ps in atts]
    title = {"lines": lambda: ws(" ".join(front)), "glued": lambda: re.sub(r"^\d+\)\s*", "", ws("".join(front))), "last": lambda: last_title(front)}[g.title]()
    dates, enacted = [d for _, d, _ in dated], next((d for k, d, last in dated if k == "제정" and last), None)
    if g.worded_dates and not dates:
        for text in addenda + [a[-1] for a in arts]:
            for y, m, d in re.findall(r"(\d{4})\s*년\s*(\d{1,2})\s*월\s*(\d{1,2})\s*일", text):
                if (x := f"{y}.{int(m):02d}.{int(d):02d}") not in dates:
                    dates.append(x)
        enacted = dates[0] if dates else None
    return (hint if hint is not None else title, enacted, dates, len(arts), arts, addenda, atts)


def last_title(front):
    plain = [s for s in front if not re.search(r"^(신설|개정|제정|폐지|전면\s*개정)\s*[\d년월일.\s,]+$", s) and not re.search(r"^\|.*\|$", s)] or front
    named = [x for x in (re.sub(r"^\d+[.\)]\s*", "", s).strip() for s in plain) if x]
    return named[-1] if named else ""


LINES = [
    "제1장 총칙", "제 2 장입학", "제1절  목적", "제2절 ", "제1관 범위", "제1조(목적) 이 규정은", "제 3 조의 2 (정의)", "제4조", "제5조()", "부칙", "부 칙 <2011>", "[별표 1] 표", "<별표 2>", "[별지서식", "1호] 서식",
    "제정 2001. 3. 1.", "개정 2002.3.4, 2003. 5. 6", "전면 개정 2004.1.1", "제정 .", "이 학칙은 1988년 3월 28일부터", "시행한다. 1999년 1월 02일", "① 항이다", "2. 호", "(경과조치) 이", "가나다 라마", "1) 정관", "2. 명칭",
    "| 제정 1998. 09. 01<br>개정 2000. 12. 19 | x |", "| --- | :-: |", "| a | b |", '<div class="article-table-wrap"><table class="inline-table"><tr></tr></table></div>', "", "   ", "\t끝",
]


def generated(seed, g):
    rng = random.Random(seed)
    n = rng.randrange(0, 40)
    body = [rng.choice(LINES) for _ in range(n)]
    if rng.random() < 0.5:
        body = [rng.choice(LINES[15:]) for _ in range(4)] + ["제1조(목적)"] + body
    return [(k // 5 if g.dialect == "paged" else None, x) for k, x in enumerate(body)]


def plain_record(r):
    arts = [tuple(a[c] for c in ("chapter", "section", "gwan", "no", "sub_no", "title", "body")) for a in r["articles"]]
    atts = [(a["label"], a["lines"], a["start_page"], a["end_page"]) for a in r["attachments"]]
    return (r["parsed_title"], r["enact_date"], r["amend_dates"], r["article_count"], arts, r["addenda"], atts)


def test_all_dialects_in_one_flow_equal_a_fold(spark):
    cases = {(g.dialect, k): generated(f"{g.dialect}{k}", g) for g in R.GRAMMARS for k in range(40)}
    rows = [(f"{d}-{k}", n, p, x) for (d, k), lines in cases.items() for n, (p, x) in enumerate(lines)]
    lines = spark.createDataFrame(rows, "doc string, line_no int, page_idx int, line string")
    hints = {key: "이름" if key[0] == "plain" else None for key in cases}
    docs = spark.createDataFrame([(f"{d}-{k}", d, hints[d, k]) for d, k in cases] + [("x", "unknown", None)], "doc string, dialect string, title_hint string")
    got = {r["doc"]: plain_record(r) for r in R.parse_records(lines, docs).collect()}
    grammar = {g.dialect: g for g in R.GRAMMARS}
    assert len(got) == len(cases)
    for (d, k), x in cases.items():
        assert got[f"{d}-{k}"] == fold(x, grammar[d], hints[d, k]), (d, k, x)


def test_no_lines_at_all(spark):
    lines = spark.createDataFrame([], "doc int, line_no int, line string")
    docs = spark.createDataFrame([(1, "paged", None)], "doc int, dialect string, title_hint string")
    assert [plain_record(r) for r in R.parse_records(lines, docs).collect()] == [("", None, [], 0, [], [], [])]


PAGES = ["목차", "1. 학칙\n학칙\n제정 2001.1.1\n제1장 총칙\n제1조(목적) 이\n- 2 -", "1. 학칙\n규정은\n부칙\n끝\n[별표 1]\n표", "Ⅱ. 학사\n", "", "계속\n둘째 쪽", "2. 학칙·내규\n내규\n제정 2002.2.2\n부칙", "3. 남음\n제1조"]
TOC = [("학사", None, "학칙"), ("학사", "내규", "규정집")]


def test_a_book_becomes_records_that_load(spark):
    pages = spark.createDataFrame([("b", k, t) for k, t in enumerate(PAGES)] + [("c", 1, "1. 하나\n제1조"), ("d", 0, None)], "doc string, page_idx int, text string")
    toc = spark.createDataFrame([("b", k, *e) for k, e in enumerate(TOC)] + [("c", 0, "x", "y", "하나")], "doc string, n int, l0 string, l1 string, title string")
    got = {(r["doc"], r["seq"]): r for r in R.extract_book(pages, toc, ["n"], contents=[0]).collect()}
    assert sorted(got) == [("b", 1), ("b", 2), ("c", 1)]
    first, second = got["b", 1], got["b", 2]
    assert (first["toc_title"], first["parsed_title"], first["l1"], first["index_no"], first["pdf_pages"]) == ("학칙", "학칙", None, "1", [2, 3, 6])
    assert first["articles"][0]["body"] == "제1조(목적) 이 규정은" and first["addenda"] == ["끝"]
    assert [tuple(a) for a in first["attachments"]] == [("[별표 1]", ["표", "둘째 쪽"], 3, 6)]
    assert (second["zero_articles"], second["title_mismatch"], second["enact_date"]) == (True, True, "2002.2.2")
    book = dml.load_records(R.extract_book(pages, toc, ["n"], contents=[0]).where("doc = 'b'"))
    assert [tuple(r) for r in book.regulations.orderBy("seq").select("title", "source_pages").collect()] == [("학칙", "2-6"), ("규정집", "7-7")]
    assert book.articles.count() == 1 and book.attachments.count() == 1


def test_a_snapshot_keeps_every_island(spark):
    pages = spark.createDataFrame([("b", k, t) for k, t in enumerate(PAGES)], "doc string, page_idx int, text string")
    got = R.book_records(pages, contents=[0]).orderBy("island").collect()
    assert [(r["island"], r["index_no"], r["first_header"], r["article_count"]) for r in got] == [(1, 1, "1. 학칙", 1), (2, 2, "2. 학칙·내규", 0), (3, 3, "3. 남음", 1)]
