import random
import re

from pyspark.sql import functions as F

from lexispan.functions import text as T
from lexispan.operators import history, layout, segment

ORDER = ["page_idx", "line_no"]


def fold_islands(pages, force_new=(), force_continue=()):
    out, current = [], None
    n = 0
    for idx, text in pages:
        first = next((x.strip() for x in text.split("\n") if x.strip()), "")
        if not first or re.match(T.DIVIDER, first):
            continue
        m = re.match(T.RUNNING_HEADER, first)
        if not m:
            if current is not None:
                out.append((idx, n))
            continue
        y = int(m[1])
        same = current is not None and (idx in force_continue or (idx not in force_new and (y == current or (y < current and y != 1))))
        if not same:
            n, current = n + 1, y
        out.append((idx, n))
    return out


def test_islands_equal_the_fold(spark):
    rng = random.Random(3)
    rows, want = [], set()
    for doc in range(150):
        pages = []
        for idx in range(rng.randint(1, 14)):
            kind = rng.random()
            text = f"\n {rng.randint(1, 5)}.  t\nbody" if kind < 0.7 else rng.choice(["", "plain", "Ⅱ. part"])
            pages.append((idx, text))
        want |= {(doc, *x) for x in fold_islands(pages, {4}, {6})}
        rows += [(doc, *p) for p in pages]
    df = spark.createDataFrame(rows, "doc int, page_idx int, text string")
    got = segment.islands(df, force_new=[4], force_continue=[6]).select("doc", "page_idx", "island")
    assert {tuple(r) for r in got.collect()} == want


def fold_body(lines):
    chapter = section = gwan = None
    arts, addenda, current, in_addenda = [], [], None, False

    def flush():
        nonlocal current
        if current:
            arts.append((*current[:3], current[3], current[4], current[5], " ".join(" ".join(current[6]).split())))
        current = None

    for page, line in lines:
        s = line.strip()
        if not s:
            continue
        if re.match(T.ADDENDA, s):
            flush()
            if in_addenda:
                addenda.append((page, "부칙"))
            in_addenda = True
        elif in_addenda:
            addenda.append((page, s))
        elif m := re.match(T.CHAPTER, s):
            flush()
            chapter, section, gwan = " ".join(f"제{m[1]}장 {m[2]}".split()), None, None
        elif m := re.match(T.SECTION, s):
            flush()
            section, gwan = " ".join(f"제{m[1]}절 {m[2]}".split()), None
        elif m := re.match(T.SUBSECTION, s):
            flush()
            gwan = " ".join(f"제{m[1]}관 {m[2]}".split())
        elif m := re.match(T.ARTICLE, s):
            flush()
            current = (chapter, section, gwan, int(m[1]), int(m[2]) if m[2] else None, m[3], [s])
        elif current:
            current[6].append(s)
    flush()
    plain, atts = [], []
    for page, s in addenda:
        if re.match(T.ATTACHMENT, s):
            atts.append([s, [], []])
        elif atts:
            atts[-1][1].append(s)
            atts[-1][2].append(page)
        else:
            plain.append(s)
    return arts, plain, [(a, b, min(p) + 1 if p else None, max(p) + 1 if p else None) for a, b, p in atts]


def test_structure_equals_the_fold(spark):
    rng = random.Random(7)
    pool = ["제1장 총  칙", "제 2 장 x", "제1절 가", "제1관 나", "제1조(목적) a", "제2조의 3 b", "제3조() c", "text", " more  text ", "", "부 칙", "부칙 <2001>", "[별표 1] t", "[별지서식 제2호]"]
    rows, want = [], {}
    for doc in range(120):
        lines = [(k // 6, k % 6, rng.choice(pool[:11] if rng.random() < 0.8 else pool)) for k in range(rng.randint(0, 24))]
        rows += [(doc, *x) for x in lines]
        want[doc] = fold_body([(p, x) for p, _, x in lines])
    df = spark.createDataFrame(rows, "doc int, page_idx int, line_no int, line string")
    st = segment.structure(df, ORDER).cache()
    arts = {}
    for r in segment.articles(st, ORDER).orderBy("doc", "ordinal").collect():
        arts.setdefault(r["doc"], []).append((r["chapter"], r["section"], r["gwan"], r["no"], r["sub_no"], r["title"], r["body"]))
    tail = segment.addenda_lines(st, ORDER).cache()
    plain, atts = {}, {}
    for r in segment.addenda(tail, ORDER).orderBy("doc", "ordinal").collect():
        plain.setdefault(r["doc"], []).append(r["line"])
    for r in segment.attachments(tail, ORDER).orderBy("doc", "ordinal").collect():
        atts.setdefault(r["doc"], []).append((r["label"], r["lines"], r["start_page"], r["end_page"]))
    for doc, (a, p, t) in want.items():
        assert arts.get(doc, []) == a
        assert plain.get(doc, []) == p
        assert atts.get(doc, []) == t


def test_content_lines_and_front_matter(spark):
    pages = [("d", 0, "\n 1. 규정 \n학칙\n제정 2001. 3. 1.\n개정 2002.1.1, 2003. 4.5\n- 3 -\n"), ("d", 1, "1. 규정\n제1조(목적) x\n개정 2009.1.1")]
    df = spark.createDataFrame(pages, "doc string, page_idx int, text string")
    rows = segment.content_lines(segment.lines(df))
    r = segment.front_matter(rows, ORDER).first()
    assert (r["title"], r["enact_date"], r["amend_dates"]) == ("학칙", "2001.3.1", ["2001.3.1", "2002.1.1", "2003.4.5"])
    r = segment.front_matter(rows, ORDER, include_enacted=False).first()
    assert r["amend_dates"] == ["2002.1.1", "2003.4.5"]


def test_blocks_units_headers_toc(spark):
    lines = ["intro", "□ **가 규정**", "신구조문대비표", "| a |", "", "◉ 나", "x"]
    df = spark.createDataFrame([("d", k, x) for k, x in enumerate(lines)], "doc string, line_no int, line string")
    from lexispan.operators.reconcile import BLOCK_HEADER, COMPARISON_TITLE

    got = segment.blocks(df, ["line_no"], BLOCK_HEADER, COMPARISON_TITLE).orderBy("block").collect()
    assert [(r["title"].strip("*"), r["content"]) for r in got] == [("가 규정", "| a |"), ("나", "x")]
    lines = ["부칙", "①이 규정", "은 시행", "② 다음", "<table>", "tail"]
    df = spark.createDataFrame([("d", k, x) for k, x in enumerate(lines)], "doc string, line_no int, line string")
    got = segment.merge_units(df, ["line_no"], r"^(부칙$|[①-⑳])").orderBy("unit").collect()
    assert [r["line"] for r in got] == ["부칙", "①이 규정 은 시행", "② 다음 <table>", "tail"]
    lines = ["제 1 장", "총", "칙", "제1조 a", "b"]
    df = spark.createDataFrame([("d", k, x) for k, x in enumerate(lines)], "doc string, line_no int, line string")
    got = segment.merge_headers(df, ["line_no"], r"^제\s*(\d+)\s*장$", T.ARTICLE, "장").orderBy("line_no").collect()
    assert [r["line"] for r in got] == ["제1장 총칙", "제1조 a", "b"]
    lines = ["Ⅰ. 정관", "1. 정관 ···· 3", "Ⅱ. 행정", "A. 인사 · 12", "2. 교원 규정 ··· 14", "no page 3.", "3. 없음"]
    df = spark.createDataFrame([("d", k, x) for k, x in enumerate(lines)], "doc string, line_no int, line string")
    got = segment.toc(df, ["line_no"]).orderBy("line_no").collect()
    assert [(r["l0"], r["l1"], r["index_no"], r["title"], r["page_display"]) for r in got] == [("정관", None, "1", "정관", 3), ("행정", "인사", "2", "교원 규정", 14)]


def test_merge_headers_keeps_every_line(spark):
    df = spark.range(10_006).select(F.lit("d").alias("doc"), F.col("id").cast("int").alias("line_no"), F.when(F.col("id") == 0, "제1장").otherwise("x").alias("line"))
    got = segment.merge_headers(df, ["line_no"], r"^제\s*(\d+)\s*장$", T.ARTICLE, "장").collect()
    assert [r["line"] for r in got] == ["제1장 " + "x" * 10_005]


def test_version_pairs_equal_the_carry_forward(spark):
    rng = random.Random(5)
    rows, want = [], set()
    for key in range(60):
        prev = None
        for t in range(8):
            v = rng.choice([None, "a", "b", "c"])
            rows.append((key, t, v))
            if v is not None:
                if prev is not None and v != prev:
                    want.add((key, t, prev, v))
                prev = v
    df = spark.createDataFrame(rows, "k int, t int, v string")
    got = history.version_pairs(df, ["k"], "t", "v").select("k", "t", "old_value", "v")
    assert {tuple(r) for r in got.collect()} == want


def test_word_rows_keep_the_anchor(spark):
    words = [("d", 0, 5.0, 10.0, "b"), ("d", 0, 1.0, 12.9, "a"), ("d", 0, 1.0, 13.1, "c"), ("d", 0, 9.0, 16.0, "d")]
    df = spark.createDataFrame(words, "doc string, page int, x0 double, y0 double, word string")
    got = layout.word_rows(df).orderBy("row").collect()
    assert [r["text"] for r in got] == ["a b", "c d"]


def test_prose_with_markers(spark):
    words = [("d", 0, 0.0, 0.0, 1.0, 1.0, "one", 0, 0), ("d", 0, 2.0, 0.0, 3.0, 1.0, "two", 0, 0), ("d", 0, 0.0, 5.0, 1.0, 6.0, "cell", 1, 0), ("d", 0, 0.0, 9.0, 1.0, 10.0, "end", 2, 0)]
    df = spark.createDataFrame(words, "doc string, page int, x0 double, y0 double, x1 double, y1 double, word string, block int, line int")
    boxes = spark.createDataFrame([("d", 0, 0, 0.0, 5.0, 3.0, 6.0)], "doc string, page int, tbl int, x0 double, y0 double, x1 double, y1 double")
    marks = spark.createDataFrame([("d", 0, 0, "[T]")], "doc string, page int, tbl int, marker string")
    placed = layout.words_in_tables(df, boxes)
    out = layout.prose_with_markers(placed, marks).orderBy("key", "side")
    assert [r["text"] for r in out.collect()] == ["one two", "[T]", "end"]
    anchors = spark.createDataFrame([("d", 0, 0, "end")], "doc string, page int, tbl int, anchor string")
    out = layout.prose_with_markers(placed, marks, anchors).orderBy("key", "side")
    assert [r["text"] for r in out.collect()] == ["one two", "end", "[T]"]


def test_pages_are_assigned_to_the_entry_that_covers_them(spark):
    starts = spark.createDataFrame([("d", 3), ("d", 3), ("d", 6), ("d", None), ("e", 2)], "doc string, start int")
    ranges = segment.page_ranges(starts, "doc", "start", F.lit(8))
    pages = spark.createDataFrame([("d", p) for p in (1, 3, 5, 5, 6, 8, 9, None)] + [("f", 3), (None, 3)], "doc string, page int")
    got = segment.assign_pages(pages, ranges, "doc").collect()
    assert sorted(((r["doc"], r["page"], r["start"], r["end"]) for r in got), key=str) == sorted(
        [("d", 1, None, None), ("d", 3, 3, 5), ("d", 5, 3, 5), ("d", 5, 3, 5), ("d", 6, 6, 8), ("d", 8, 6, 8), ("d", 9, None, None), ("d", None, None, None), ("f", 3, None, None), (None, 3, None, None)], key=str)
    assert segment.assign_pages(pages.limit(0), ranges, "doc").count() == 0
    assert segment.assign_pages(pages, ranges.limit(0), "doc").where("start IS NULL").count() == pages.count()
