"""Queries of whole extraction flows, and their DuckDB SQL.

The driver's tables hold no rule books: a line item becomes a line of one, worded by its
part, and an order becomes a page.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexispan.functions import text as T
from lexispan.operators import boxed, markup, reconcile, records, render, segment
from lexispan.plans.tables import table

#: What line items say, by part number; q is the quantity, f the return flag.
_WORDING = [
    "'제' || q || '장 ' || f", "'제 ' || q || ' 장' || f", "'제' || q || '절  ' || f", "'제' || q || '관 ' || f", "'제' || q || '조(' || f || ') 이'", "'제 ' || q || ' 조의 2 (' || f || ')'", "'제' || q || '조'",
    "CASE WHEN n = 7 THEN '부 칙' ELSE f || ' 칙' END", "CASE WHEN length(q) = 2 AND q >= '40' THEN '부칙 <' || q || '>' ELSE '칙 ' || q END", "'[별표 ' || q || '] ' || f", "'<별표 ' || q || '>'", "'제정 2001. ' || q || '. 3.'",
    "'개정 2002.' || q || '.4, 2003. 5.' || q", "'이 학칙은 19' || q || '년 3월 ' || n || '일부터'", "'| 제정 1998. 9. ' || n || '<br>개정 2000. 12. ' || n || ' | x |'", "'(' || f || ') 항'", "q || '. ' || f", "f || q || ' '",
]
_LINE = "CASE l_partkey % 18 " + " ".join(f"WHEN {k} THEN {x}" for k, x in enumerate(_WORDING)) + " END"
_ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"]


def _worded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items with their ``line``."""
    rows = table(spark, sf_dir, "lineitem").select("l_suppkey", *_ORDER, F.col("l_quantity").cast("int").cast("string").alias("q"), F.col("l_linenumber").alias("n"), F.col("l_returnflag").alias("f"))
    return rows.withColumn("line", F.expr(_LINE)).drop("q", "n", "f")


def _flat(out: DataFrame) -> list[Column]:
    """The lists of records as text, so that any engine can compare them."""
    said = lambda *cs: F.concat_ws("|", *[F.coalesce(c.cast("string"), F.lit("-")) for c in cs])
    listed = lambda c, f: F.array_join(F.transform(c, f), "¶").alias(c)
    return [
        "parsed_title", "enact_date", F.array_join("amend_dates", ",").alias("amend_dates"), F.col("article_count").cast("long").alias("article_count"),
        listed("articles", lambda a: said(*[a[c] for c in ("chapter", "section", "gwan", "no", "sub_no", "title", "body")])), F.array_join("addenda", "¶").alias("addenda"),
        listed("attachments", lambda a: said(a["label"], F.array_join(a["lines"], "+"), a["start_page"], a["end_page"])),
    ]


def parsed_dialects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as documents of six dialects, parsed by one plan; the plain ones bring
    their title along."""
    lines = _worded(spark, sf_dir).withColumnRenamed("l_suppkey", "doc")
    dialect = F.element_at(F.array(*[F.lit(g.dialect) for g in records.GRAMMARS]), (F.col("s_suppkey") % len(records.GRAMMARS) + 1).cast("int"))
    docs = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("doc"), dialect.alias("dialect"), F.when(dialect == "plain", F.col("s_name")).alias("title_hint"))
    out = records.parse_records(lines, docs, order=_ORDER)
    return out.select("doc", *_flat(out))


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as pages of their customer's book: a running header on most, then lines."""
    of = _worded(spark, sf_dir).groupBy("l_orderkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*_ORDER, "line"))), lambda x: x["line"]), "\n").alias("body"))
    orders = table(spark, sf_dir, "orders").join(of, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    header = F.when(F.col("o_orderkey") % 5 == 0, "계속").otherwise(F.concat((F.floor(F.col("o_orderkey") / 2) % 9 + 1).cast("string"), F.lit(".  규정 "), "o_orderstatus"))
    text = F.concat(F.lit("\n"), header, F.lit("\n- 1 -\n"), F.coalesce("body", F.lit("")))
    return orders.select(F.col("o_custkey").alias("doc"), F.col("o_orderkey").alias("page_idx"), text.alias("text"))


def snapshot_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A record for each regulation of each customer's book."""
    out = records.book_records(_pages(spark, sf_dir))
    return out.select("doc", "island", "index_no", "first_header", F.array_join("pdf_pages", ",").alias("pdf_pages"), *_flat(out))


def extracted_book(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with the urgent and high orders as table of contents, and quality flags."""
    out = records.extract_book(_pages(spark, sf_dir), _toc(spark, sf_dir), ["o_orderkey"])
    return out.select("doc", "seq", "l0", "toc_title", "index_no", F.array_join("pdf_pages", ",").alias("pdf_pages"), "zero_articles", "glued_dates", "title_mismatch", *_flat(out))


def _toc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The urgent and high orders as a book's table of contents."""
    toc = table(spark, sf_dir, "orders").where("o_orderpriority IN ('1-URGENT', '2-HIGH')")
    return toc.select(F.col("o_custkey").alias("doc"), "o_orderkey", F.col("o_orderstatus").alias("l0"), F.lit(None).cast("string").alias("l1"), F.concat(F.lit("규정 "), "o_orderstatus").alias("title"))


def _patched(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Books whose every seventh page has a table over its second and third line."""
    pages = _pages(spark, sf_dir).select("doc", (F.col("page_idx") + 1).alias("page"), "text")
    tabled = pages.where("page % 7 = 0")
    lines = tabled.select("doc", "page", F.posexplode(F.split("text", "\n")).alias("line", "_text"))
    words = lines.select("doc", "page", "line", F.posexplode(F.filter(F.split("_text", " "), lambda w: w != "")).alias("k", "word"))
    words = words.select("doc", "page", (F.col("k") * 10.0).alias("x0"), (F.col("line") * 10.0).alias("y0"), (F.col("k") * 10.0 + 9).alias("x1"), (F.col("line") * 10.0 + 9).alias("y1"), "word", F.lit(0).alias("block"), "line")
    cell = F.col("page").cast("string")
    rows = F.array(F.array(cell, F.lit("a<b")), F.array(F.lit(None).cast("string"), F.lit("x")))
    box = lambda x: F.lit(float(x))
    tables = tabled.select("doc", "page", F.lit(0).alias("tbl"), box(-5).alias("x0"), box(40).alias("y0"), box(1e6).alias("x1"), box(59).alias("y1"), rows.alias("rows"), F.concat(F.lit("/forms/p"), cell, F.lit(".pdf")).alias("source_url"))
    return boxed.patch_book(pages, words, tables, _toc(spark, sf_dir), ["o_orderkey"])


def patched_book(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Books extracted with the tables of their pages as markup."""
    out, _ = _patched(spark, sf_dir)
    return out.select("doc", "seq", "l0", "toc_title", "index_no", F.array_join("pdf_pages", ",").alias("pdf_pages"), *_flat(out))


def table_owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which regulation each page with a table belongs to."""
    _, owners = _patched(spark, sf_dir)
    return owners.select("page.doc", "page.page", "seq")


def headings_ahead(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers' lines with torn headings put together: of each line only a part stands."""
    words = F.element_at(F.array(*[F.lit(x) for x in _TORN]), (F.col("l_partkey") % len(_TORN) + 1).cast("int"))
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("doc"), *_ORDER, words.alias("line"))
    loose = records.MARKDOWN
    out = segment.merge_ahead(lines, _ORDER, r"^제\s*\d*\s*$", [loose.chapter, loose.section, loose.subsection])
    return segment.join_split_word(out, _ORDER)


_TORN = ["제", "제 1", "2", "장", "장총칙", "절 목적", "관", "부", "칙", " 제3 ", "본문", "제"]

#: What line items say in a statute, by part number.
_SAID = ["'제 ' || q || ' 장'", "'총'", "'칙'", "'부'", "'제' || q || '장  ' || f", "'제' || q || '절'", "'제' || q || '조(' || f || ') 이'", "''", "'제정 2001.' || q || '.3.'", "'개정 2002.' || q", "'① ' || f", "f || '  ' || q", "'(' || f || ') ' || q", "f", "'학칙은 다.'", "'제5조'"]
_STATUTE = "CASE l_partkey % 16 " + " ".join(f"WHEN {k} THEN {x}" for k, x in enumerate(_SAID)) + " END"
_ANCHOR = r"^제\s*5\s*조"


def statutes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as standalone statutes of seven pages: two pages have a table over their
    second and third line, one of which belongs to article 5, and the last page continues
    the last table."""
    items = table(spark, sf_dir, "lineitem").select("l_suppkey", *_ORDER, F.col("l_quantity").cast("int").cast("string").alias("q"), F.col("l_returnflag").alias("f"))
    of = items.withColumn("said", F.expr(_STATUTE)).groupBy(F.col("l_suppkey").alias("doc"), F.col("l_linenumber").alias("page"))
    pages = of.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*_ORDER, "said"))), lambda x: x["said"]), "\n").alias("text"))
    tabled = pages.where("page IN (2, 3, 4)")
    lines = tabled.select("doc", "page", F.posexplode(F.split("text", "\n")).alias("line", "_text"))
    words = lines.select("doc", "page", "line", F.posexplode(F.filter(F.split("_text", " "), lambda w: w != "")).alias("k", "word"))
    words = words.select("doc", "page", (F.col("k") * 10.0).alias("x0"), (F.col("line") * 10.0).alias("y0"), (F.col("k") * 10.0 + 9).alias("x1"), (F.col("line") * 10.0 + 9).alias("y1"), "word", F.lit(0).alias("block"), "line")
    row = lambda *cs: F.array(*[F.lit(c) for c in cs])
    rows = F.when(F.col("page") == 2, F.array(row("가", "나"), row("다", "라"))).when(F.col("page") == 3, F.array(row("이동", "45"))).otherwise(F.array(row("총", "칙")))
    tables = tabled.select("doc", "page", F.lit(0).alias("tbl"), F.lit(-5.0).alias("x0"), F.lit(10.0).alias("y0"), F.lit(1e6).alias("x1"), F.lit(29.0).alias("y1"), rows.alias("rows"))
    titles = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("doc"), (F.col("s_suppkey") + 120).alias("seq"), F.col("s_name").alias("toc_title"))
    moving = F.contains("line", F.lit("<table")) & F.contains("line", F.lit("이동"))
    out = boxed.extract_statutes(pages, words, tables, titles, moving, F.coalesce(F.col("line").rlike(_ANCHOR), F.lit(False)))
    return out.select("doc", "seq", "toc_title", F.array_join("table_pages", ",").alias("table_pages"), *_flat(out)[:-1])


def next_edition_any(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders and the next day on which a most urgent, finished one was made, whoever's."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("day"), "o_orderpriority", "o_orderstatus", "o_totalprice")
    editions = orders.where("o_orderpriority = '1-URGENT' AND o_orderstatus = 'F' AND o_totalprice > 480000").select(F.col("day").alias("edition"))
    out = reconcile.next_edition(orders.select("o_orderkey", "day"), editions, "day", "edition", 20)
    return out.select("o_orderkey", F.date_format("next", "yyyy-MM-dd").alias("next"))


def framed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as pages in one frame of tables, a row a turn with a small table inside,
    taken apart to lines."""
    turns = table(spark, sf_dir, "conversations")
    row = F.concat(F.lit("<tr><td>"), F.col("role"), F.lit("</td><TD a='1'>"), T.html_escape(F.col("text")), F.lit("<table><tr><td>x</td></tr></table><br>end </td></tr>\n"))
    rows = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", row.alias("r")))), lambda x: x["r"]), "")
    made = turns.groupBy("conv_id").agg(F.concat(F.lit(" <table>\n<tr><th><table>"), rows, F.lit("</table></th></tr> </table> ")).alias("html"))
    return markup.framed_lines(made, "conv_id", "html").select("conv_id", F.col("line_no").cast("long").alias("line_no"), F.md5("line").alias("line_md5"))


_CONVERTED = ["'**제' || q || '조** ' || f", "'1. ' || q || '. ' || f", "'- ① ' || f", "f || ' 한다.부칙'", "'1.  ' || q || '.' || f", "'다.부칙다.부칙'", "q", "' - ②'"]


def repaired_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers' lines with the marks that a converter leaves behind, repaired."""
    items = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("doc"), *_ORDER, F.col("l_quantity").cast("int").cast("string").alias("q"), F.col("l_returnflag").alias("f"))
    said = "CASE l_partkey % 8 " + " ".join(f"WHEN {k} THEN {x}" for k, x in enumerate(_CONVERTED)) + " END"
    return segment.repaired_lines(items.withColumn("line", F.expr(said)), _ORDER)


def clause_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with circled clause marks and item numbers in place of short words."""
    text = F.col("text")
    for word, mark in _CLAUSES.items():
        text = F.regexp_replace(text, f" {word} ", f" {mark} ")
    docs = table(spark, sf_dir, "documents").select("doc_id", text.alias("text"))
    return docs.select("doc_id", F.md5(render.format_body("text")).alias("html_md5"), F.md5(render.display_body("text")).alias("shown_md5"))


_CLAUSES = {"the": "①", "der": "①", "la": "②", "of": "1.", "and": "[ 2. ]", "et": "12.", "die": "3.", "en": "(4. x)"}

QUERIES = {f.__name__: f for f in (parsed_dialects, snapshot_records, extracted_book, patched_book, table_owners, headings_ahead, statutes, next_edition_any, framed_lines, repaired_lines, clause_format)}


# --- SQL ------------------------------------------------------------------------------


def _text(x: str | bool | None) -> str:
    return "NULL" if x is None else str(x).upper() if isinstance(x, bool) else "'" + x.replace("'", "''") + "'"


_GRAMMARS = f"gram({', '.join(records.Grammar._fields)}) AS (VALUES {', '.join('(' + ', '.join(map(_text, g)) + ')' for g in records.GRAMMARS)})"
_WORDED = f"worded AS (SELECT l_suppkey, {', '.join(_ORDER)}, {_LINE} AS line FROM (SELECT *, l_quantity::INT::VARCHAR AS q, l_linenumber AS n, l_returnflag AS f FROM lineitem))"
_SPACE = lambda x, by="' '": rf"trim(regexp_replace({x}, '\s+', {by}, 'g'))"
_BARE = lambda x: _SPACE(x, "''")
_RUN = "(PARTITION BY doc ORDER BY pos ROWS UNBOUNDED PRECEDING)"
_HEAD = lambda name, word: _SPACE(f"'제' || regexp_extract(s, {name}, 1) || '{word} ' || regexp_extract(s, {name}, 2)")
_WORDS_DATE = r"(\d{4})\s*년\s*(\d{1,2})\s*월\s*(\d{1,2})\s*일"
#: From ln(doc, pos, page_idx, s) and docs(doc, dialect, title_hint) to rec(doc, ...).
_RECORDS = rf"""{_GRAMMARS},
l0 AS (SELECT ln.*, gram.*, CASE WHEN regexp_matches(s, date_line) THEN CASE
    WHEN listed_dates THEN list_filter(list_transform(string_split({_BARE("regexp_extract(s, date_line, 2)")}, ','), lambda d: struct_pack(k := regexp_extract(s, date_line, 1), d := trim(d, '.'))), lambda x: x.d <> '')
    ELSE [struct_pack(k := regexp_extract(s, date_line, 1), d := rtrim(CASE WHEN spaced_dates THEN trim(regexp_extract(s, date_line, 2)) ELSE {_BARE("regexp_extract(s, date_line, 2)")} END, '.'))] END
  WHEN regexp_matches(s, '{records.TABLE_ROW}') AND regexp_matches(s, table_dates) THEN list_transform(regexp_extract_all(s, table_dates),
    lambda m: struct_pack(k := regexp_extract(m, '^\S+?(정|개정|지|신설)'), d := {_BARE("regexp_extract(m, '[0-9].*')")})) END AS dates
  FROM ln JOIN docs USING (doc) JOIN gram USING (dialect) WHERE s <> ''),
l1 AS (SELECT *, dates_anywhere AND (dates IS NOT NULL OR (table_dates IS NOT NULL AND regexp_matches(s, '{records.TABLE_DIVIDER}'))) AS gone,
  regexp_matches(s, chapter) OR regexp_matches(s, article) OR (addenda_opens_body AND regexp_matches(s, addenda)) AS opening FROM l0),
l2 AS (SELECT *, NOT gone AND (bool_or(opening AND NOT gone) OVER {_RUN} OR (NOT addenda_opens_body AND NOT bool_or(opening AND NOT gone) OVER (PARTITION BY doc))) AS body FROM l1),
l3 AS (SELECT *, body AND regexp_matches(s, addenda) AS marker FROM l2), l4 AS (SELECT *, body AND bool_or(marker) OVER {_RUN} AS tail FROM l3),
l5 AS (SELECT *, CASE WHEN gone OR (NOT body AND dates IS NOT NULL) THEN 'D' WHEN NOT body THEN 'F' WHEN marker THEN 'B' WHEN tail THEN 'U' WHEN regexp_matches(s, chapter) THEN 'C' WHEN regexp_matches(s, section) THEN 'S'
  WHEN regexp_matches(s, subsection) THEN 'G' WHEN regexp_matches(s, article) THEN 'A' ELSE 'T' END AS kind FROM l4),
l6 AS (SELECT *, sum((kind = 'C')::INT) OVER {_RUN} AS nc, sum((kind IN ('C', 'S'))::INT) OVER {_RUN} AS ns, sum((kind IN ('C', 'S', 'G', 'A', 'B'))::INT) OVER {_RUN} AS seg FROM l5),
l7 AS (SELECT *, last_value(CASE WHEN kind = 'C' THEN {_HEAD("chapter", "장")} END IGNORE NULLS) OVER {_RUN} AS h1,
  last_value(CASE WHEN kind = 'S' THEN {_HEAD("section", "절")} END IGNORE NULLS) OVER (PARTITION BY doc, nc ORDER BY pos ROWS UNBOUNDED PRECEDING) AS h2,
  last_value(CASE WHEN kind = 'G' THEN {_HEAD("subsection", "관")} END IGNORE NULLS) OVER (PARTITION BY doc, ns ORDER BY pos ROWS UNBOUNDED PRECEDING) AS h3 FROM l6),
seg AS (SELECT doc, seg, arg_min(struct_pack(kind, h1, h2, h3, s, article), pos) AS h, {_SPACE("string_agg(s, ' ' ORDER BY pos)")} AS text FROM l7 WHERE kind IN ('C', 'S', 'G', 'A', 'T') GROUP BY ALL),
art AS (SELECT doc, count(*) AS article_count, list(text ORDER BY seg) AS bodies, string_agg(concat_ws('|', coalesce(h.h1, '-'), coalesce(h.h2, '-'), coalesce(h.h3, '-'), regexp_extract(h.s, h.article, 1), coalesce(nullif(regexp_extract(h.s, h.article, 2), ''), '-'),
  CASE WHEN ends_with(regexp_extract(h.s, h.article), ')') THEN regexp_extract(h.s, h.article, 3) ELSE '-' END, text), '¶' ORDER BY seg) AS articles FROM seg WHERE h.kind = 'A' GROUP BY doc),
b0 AS (SELECT *, sum((kind = 'B')::INT) OVER {_RUN} AS nb FROM l7 WHERE kind IN ('B', 'U')),
b1 AS (SELECT * REPLACE (CASE WHEN kind = 'B' THEN '부칙' ELSE s END AS s) FROM b0 WHERE kind = 'U' OR (keep_separators AND nb > 1)),
b2 AS (SELECT *, unit IS NULL OR coalesce(lag(contains(s, '<table') OR s = '부칙') OVER (PARTITION BY doc ORDER BY pos), false) OR regexp_matches(s, unit) OR regexp_matches(s, attachment) AS fresh FROM b1),
b3 AS (SELECT *, sum(fresh::INT) OVER {_RUN} AS u FROM b2),
b4 AS (SELECT doc, u AS pos, attachment, separators_close, string_agg(s, ' ' ORDER BY b3.pos) AS s, min(page_idx) AS p, max(page_idx) AS q FROM b3 GROUP BY ALL),
b5 AS (SELECT *, separators_close AND s = '부칙' AS closing, regexp_matches(s, attachment) AND NOT closing AS label FROM b4),
b6 AS (SELECT *, coalesce(last_value(CASE WHEN label OR closing THEN label END IGNORE NULLS) OVER {_RUN}, false) AS inside, sum(label::INT) OVER {_RUN} AS part FROM b5),
att AS (SELECT doc, part, first(s ORDER BY pos) || '|' || coalesce(string_agg(s, '+' ORDER BY pos) FILTER (NOT label), '') || '|' || coalesce((min(p) FILTER (NOT label) + 1)::VARCHAR, '-') || '|' || coalesce((max(q) FILTER (NOT label) + 1)::VARCHAR, '-') AS a
  FROM b6 WHERE inside GROUP BY ALL),
front AS (SELECT doc, flatten(list(dates ORDER BY pos) FILTER (dates IS NOT NULL)) AS dated, list(s ORDER BY pos) FILTER (kind = 'F') AS lines,
  first(dates[-1].d ORDER BY pos) FILTER (len(dates) > 0 AND dates[1].k = '제정' AND table_dates IS NULL) AS one,
  first(list_filter(dates, lambda x: x.k = '제정')[1].d ORDER BY pos) FILTER (len(list_filter(dates, lambda x: x.k = '제정')) > 0) AS other, any_value(table_dates IS NULL) AS by_line FROM l7 WHERE kind IN ('D', 'F') GROUP BY doc),
rec0 AS (SELECT docs.doc, coalesce(title_hint, CASE gram.title WHEN 'lines' THEN {_SPACE("coalesce(array_to_string(lines, ' '), '')")} WHEN 'glued' THEN regexp_replace({_SPACE("coalesce(array_to_string(lines, ''), '')")}, '^\d+\)\s*', '')
    ELSE coalesce(list_filter(list_transform(CASE WHEN len(list_filter(lines, lambda x: NOT regexp_matches(x, '{records.TABLE_ROW}'))) > 0 THEN list_filter(lines, lambda x: NOT regexp_matches(x, '{records.TABLE_ROW}')) ELSE lines END,
      lambda x: trim(regexp_replace(x, '^\d+[.\)]\s*', ''))), lambda x: x <> '')[-1], '') END) AS parsed_title,
  CASE WHEN by_line THEN one ELSE other END AS enacted, list_transform(coalesce(dated, []), lambda x: x.d) AS given, coalesce(article_count, 0) AS article_count, coalesce(articles, '') AS articles, coalesce(bodies, []) AS bodies, worded_dates
  FROM docs JOIN gram USING (dialect) LEFT JOIN front USING (doc) LEFT JOIN art USING (doc)),
rec1 AS (SELECT *, (SELECT list(s ORDER BY pos) FROM b6 WHERE b6.doc = rec0.doc AND NOT inside) AS ad, (SELECT string_agg(a, '¶' ORDER BY part) FROM att WHERE att.doc = rec0.doc) AS listed FROM rec0),
rec2 AS (SELECT *, list_transform(flatten(list_transform(list_concat(coalesce(ad, []), bodies), lambda t: regexp_extract_all(t, '{_WORDS_DATE}'))),
  lambda d: regexp_extract(d, '{_WORDS_DATE}', 1) || '.' || lpad(regexp_extract(d, '{_WORDS_DATE}', 2), 2, '0') || '.' || lpad(regexp_extract(d, '{_WORDS_DATE}', 3), 2, '0')) AS spelled, worded_dates AND len(given) = 0 AS by_words FROM rec1),
rec AS (SELECT doc, parsed_title, CASE WHEN by_words THEN spelled[1] ELSE enacted END AS enact_date,
  array_to_string(CASE WHEN by_words THEN list_filter(spelled, lambda x, i: list_position(spelled, x) = i) ELSE given END, ',') AS amend_dates, article_count, articles, coalesce(array_to_string(ad, '¶'), '') AS addenda, coalesce(listed, '') AS attachments FROM rec2)"""
_DIALECT_DOCS = f"docs AS (SELECT s_suppkey AS doc, dialect, CASE WHEN dialect = 'plain' THEN s_name END AS title_hint FROM (SELECT *, [{', '.join(_text(g.dialect) for g in records.GRAMMARS)}][s_suppkey % {len(records.GRAMMARS)} + 1] AS dialect FROM supplier))"
_BOOK = rf"""{_WORDED},
pg AS (SELECT o_custkey AS doc, o_orderkey AS page_idx, CASE WHEN o_orderkey % 5 = 0 THEN '계속' ELSE ((o_orderkey // 2) % 9 + 1) || '.  규정 ' || o_orderstatus END AS header, CASE WHEN o_orderkey % 5 <> 0 THEN (o_orderkey // 2) % 9 + 1 END AS y FROM orders),
i0 AS (SELECT *, last_value(y IGNORE NULLS) OVER (PARTITION BY doc ORDER BY page_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS py FROM pg),
i1 AS (SELECT *, coalesce(y IS NOT NULL AND (py IS NULL OR (y = 1 AND py <> 1)), false) AS restart FROM i0),
i2 AS (SELECT *, sum(restart::INT) OVER (PARTITION BY doc ORDER BY page_idx) AS run FROM i1),
i3 AS (SELECT *, max(y) OVER (PARTITION BY doc, run ORDER BY page_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM i2),
i4 AS (SELECT *, sum((y IS NOT NULL AND (restart OR coalesce(y > m, false)))::INT) OVER (PARTITION BY doc ORDER BY page_idx)::BIGINT AS island FROM i3),
islands AS (SELECT * FROM i4 WHERE island > 0),
heads AS (SELECT doc || '/' || island AS key, doc, island, first(y ORDER BY page_idx) AS index_no, {_SPACE("first(header ORDER BY page_idx)")} AS first_header, string_agg((page_idx + 1)::VARCHAR, ',' ORDER BY page_idx) AS pdf_pages FROM islands GROUP BY ALL),
LINES
docs AS (SELECT key AS doc, 'paged' AS dialect, NULL::VARCHAR AS title_hint FROM heads),
{_RECORDS}"""

_PLAIN_LINES = f"""ln AS (SELECT doc || '/' || island AS doc, row_number() OVER (PARTITION BY doc, island ORDER BY page_idx, {", ".join(_ORDER)}) AS pos, page_idx, trim(line) AS s FROM islands JOIN worded ON l_orderkey = page_idx),"""
_TABLE_LINES = rf"""w0 AS (SELECT doc || '/' || island AS doc, page_idx, (page_idx + 1) % 7 = 0 AS boxed, 2 + row_number() OVER (PARTITION BY page_idx ORDER BY {", ".join(_ORDER)}) AS i, line FROM islands JOIN worded ON l_orderkey = page_idx),
w1 AS (SELECT *, CASE WHEN boxed THEN trim(regexp_replace(line, ' +', ' ', 'g')) ELSE trim(line) END AS s FROM w0),
w2 AS (SELECT doc, page_idx, sum(len(string_split(s, ' '))) FILTER (i = 4) AS c4, coalesce(sum(len(string_split(s, ' '))) FILTER (i = 5), 0) AS c5 FROM w1 WHERE boxed AND i IN (4, 5) GROUP BY ALL),
w3 AS (SELECT doc, page_idx, i, 1 AS side, s FROM w1 WHERE NOT boxed OR i NOT IN (4, 5)
  UNION ALL SELECT doc, page_idx, CASE WHEN (c4 + c5) // 2 < c4 THEN 4 ELSE 5 END, 0, '<div class="article-table-wrap"><table class="inline-table"><tbody><tr><td>' || (page_idx + 1) || '</td><td>a&lt;b</td></tr><tr><td></td><td>x</td></tr></tbody></table>'
    || '<a class="table-src-link" href="/forms/p' || (page_idx + 1) || '.pdf" target="_blank">원본 페이지 보기 (PDF)</a></div>' FROM w2),
ln AS (SELECT doc, row_number() OVER (PARTITION BY doc ORDER BY page_idx, i, side) AS pos, page_idx, s FROM w3),"""
_ENTRIES = """toc AS (SELECT o_custkey AS doc, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS seq, o_orderstatus AS l0, '규정 ' || o_orderstatus AS toc_title FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')),
z AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY island) AS seq FROM heads)"""
_STRUCT = "|".join(x.replace("(?:", "(") for x in (boxed.STRUCTURAL,))
_MARKUP = lambda rows: '<div class="article-table-wrap"><table class="inline-table"><tbody>' + rows + "</tbody></table></div>"


def _merged(source: str, out: str, alone: str, word: str) -> str:
    """Headings that stand alone take the lines up to the next structural or blank one."""
    return rf"""{out}0 AS (SELECT *, regexp_matches(trim(s), '{alone}') AS head, regexp_matches(trim(s), '{alone}') OR regexp_matches(trim(s), '{_STRUCT}') OR trim(s) = '' AS stop FROM {source}),
{out}1 AS (SELECT *, sum(stop::INT) OVER {_RUN} AS part FROM {out}0), {out}2 AS (SELECT *, first_value(head) OVER w AS headed, row_number() OVER w AS n FROM {out}1 WINDOW w AS (PARTITION BY doc, part ORDER BY pos)),
{out} AS (SELECT doc, min(pos) AS pos, CASE WHEN headed THEN '제' || regexp_extract(trim(first(s ORDER BY pos)), '{alone}', 1) || '{word} ' || coalesce(string_agg(trim(s), '' ORDER BY pos) FILTER (n > 1), '') ELSE first(s ORDER BY pos) END AS s
  FROM {out}2 GROUP BY doc, part, headed, CASE WHEN headed THEN 0 ELSE n END)"""


_STATUTES = rf"""s0 AS (SELECT l_suppkey AS doc, l_linenumber AS page, row_number() OVER (PARTITION BY l_suppkey, l_linenumber ORDER BY {", ".join(_ORDER)}) - 1 AS i, {_STATUTE} AS line FROM (SELECT *, l_quantity::INT::VARCHAR AS q, l_returnflag AS f FROM lineitem)),
s1 AS (SELECT *, len(list_filter(string_split(line, ' '), lambda x: x <> '')) AS c FROM s0),
more AS (SELECT doc, CASE WHEN NOT ends_with(x, '다.') THEN replace(x, chr(10), '<br>') END AS t FROM (SELECT doc, trim(string_agg(line, chr(10) ORDER BY i), ' ' || chr(10)) AS x FROM s0 WHERE page = 7 GROUP BY doc)),
box AS (SELECT doc, page, coalesce(sum(c) FILTER (i = 1), 0) AS c1, coalesce(sum(c) FILTER (i = 2), 0) AS c2 FROM s1 WHERE page IN (2, 3) GROUP BY ALL),
s2 AS (SELECT doc, page, i, 1 AS side, line AS s FROM s1 WHERE page NOT IN (2, 3, 7) OR (page = 7 AND doc IN (SELECT doc FROM more WHERE t IS NULL)) UNION ALL SELECT doc, page, i, 1, trim(regexp_replace(line, ' +', ' ', 'g')) FROM s1 WHERE page IN (2, 3) AND i NOT IN (1, 2) AND c > 0
  UNION ALL SELECT doc, page, CASE WHEN (c1 + c2) // 2 < c1 THEN 1 ELSE 2 END, 0, CASE page WHEN 2 THEN '{_MARKUP("<tr><td>가</td><td>나</td></tr><tr><td>다</td><td>라</td></tr>")}' ELSE '{_MARKUP("<tr><td>이동@</td><td>45</td></tr>").replace("@", "' || coalesce('<br>' || t, '') || '")}' END FROM box JOIN more USING (doc) WHERE c1 + c2 > 0),
s3 AS (SELECT doc, s, row_number() OVER (PARTITION BY doc ORDER BY page, i, side) AS at0, contains(s, '<table') AND contains(s, '이동') AS m, regexp_matches(trim(s), '{_STRUCT}') AS st FROM s2),
s4 AS (SELECT *, min(at0) FILTER (NOT m AND regexp_matches(s, '{_ANCHOR}')) OVER (PARTITION BY doc) AS a FROM s3),
s5 AS (SELECT *, min(at0) FILTER (NOT m AND st AND at0 > a) OVER (PARTITION BY doc) AS z FROM s4),
s6 AS (SELECT doc, s, row_number() OVER (PARTITION BY doc ORDER BY CASE WHEN m THEN coalesce(z, 1e18) ELSE at0 END, (NOT m)::INT, at0) AS pos FROM s5 WHERE NOT m OR a IS NOT NULL),
body AS (SELECT * FROM s6 WHERE NOT regexp_matches(trim(s), '{records.STATUTES.date_line}')),
{_merged("body", "ch", boxed.CHAPTER_ALONE, "장")}, {_merged("ch", "se", boxed.SECTION_ALONE, "절")},
p0 AS (SELECT *, trim(s) = '부' AND coalesce(lead(trim(s)) OVER w = '칙', false) AS one, trim(s) = '칙' AND coalesce(lag(trim(s)) OVER w = '부', false) AS two FROM se WINDOW w AS (PARTITION BY doc ORDER BY pos)),
p1 AS (SELECT doc, pos, CASE WHEN one THEN '부칙' ELSE s END AS s FROM p0 WHERE NOT two),
ln AS (SELECT doc, pos, NULL::INT AS page_idx, trim(CASE WHEN regexp_matches(trim(s), '{boxed.CHAPTER_TITLED}') THEN regexp_replace(trim(s), '{boxed.CHAPTER_TITLED}', '제\1장 \2') ELSE s END) AS s FROM p1
  UNION ALL SELECT doc, pos, NULL, trim(s) FROM s6 WHERE regexp_matches(trim(s), '{records.STATUTES.date_line}')),
docs AS (SELECT s_suppkey AS doc, 'statutes' AS dialect, NULL::VARCHAR AS title_hint FROM supplier), {_RECORDS}"""
_BOOK, _PATCHED = _BOOK.replace("LINES", _PLAIN_LINES), _BOOK.replace("LINES", _TABLE_LINES)

def _format(text: str) -> str:
    """Clause and item marks of a text, as HTML and as lines to edit. Bracketed spans become
    one character, words are looked at one by one, and the spans are put back."""
    brackets = r"[(\[][^()\[\]]*[)\]]"
    back = lambda c: f"(SELECT array_to_string(list_transform(range(1, len(p) + 1), lambda i: p[i] || coalesce(held[i], '')), '') FROM (SELECT string_split({c}, chr(57344)) AS p))"
    return rf"""WITH d AS (SELECT doc_id, {text} AS text FROM documents),
m AS (SELECT doc_id, regexp_extract_all(text, '{brackets}') AS held, regexp_extract_all(regexp_replace(text, '{brackets}', chr(57344), 'g'), '\S+|\s+') AS t FROM d),
u AS (SELECT doc_id, unnest(range(1, len(t) + 1)) AS i, unnest(t) AS x, len(t) AS n FROM m),
k AS (SELECT *, CASE WHEN regexp_matches(x, '^[①-⑳]$') THEN 'c' WHEN regexp_matches(x, '^[1-9][0-9]?\.$') AND i > 1 AND i < n THEN 'n' END AS kind FROM u),
s AS (SELECT *, kind = 'n' AND coalesce(bool_or(kind = 'c') OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS nested FROM k),
o AS (SELECT *, coalesce(last_value(CASE WHEN kind IS NOT NULL THEN nested END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS open FROM s),
h AS (SELECT doc_id, string_agg(CASE WHEN kind IS NULL THEN x ELSE CASE WHEN open THEN '</span>' ELSE '' END || CASE WHEN nested THEN '<span class="list-indent">' || x ELSE '<br><span class="hang-marker">' || x || '</span>' END END, '' ORDER BY i)
    || CASE WHEN coalesce(last(nested ORDER BY i) FILTER (kind IS NOT NULL), false) THEN '</span>' ELSE '' END AS html,
  string_agg(CASE WHEN kind IS NULL THEN x WHEN nested THEN chr(10) || '  ' || x ELSE chr(10) || x END, '' ORDER BY i) AS shown FROM o GROUP BY doc_id)
SELECT doc_id, md5({back("regexp_replace(coalesce(html, ''), '^<br>', '')")}) AS html_md5, md5({back("regexp_replace(coalesce(shown, ''), '^' || chr(10), '')")}) AS shown_md5 FROM m LEFT JOIN h USING (doc_id)"""


_MARKED = "coalesce(text, '')"
for _word, _mark in _CLAUSES.items():
    _MARKED = f"regexp_replace({_MARKED}, ' {_word} ', ' {_mark} ', 'g')"
_REPAIRED = "CASE l_partkey % 8 " + " ".join(f"WHEN {k} THEN {x}" for k, x in enumerate(_CONVERTED)) + " END"

ORACLES = {
    "body_format": _format("coalesce(text, '')"),
    "clause_format": _format(_MARKED),
    "next_edition_any": """WITH e AS (SELECT DISTINCT o_orderdate::DATE AS e FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'F' AND o_totalprice > 480000),
n AS (SELECT o_orderkey, o_orderdate::DATE AS d, e FROM orders ASOF LEFT JOIN e ON o_orderdate::DATE <= e) SELECT o_orderkey, CASE WHEN e - d <= 20 THEN strftime(e, '%Y-%m-%d') END AS next FROM n""",
    "framed_lines": r"""WITH t AS (SELECT conv_id, turn, role, string_split(text || ' x end', chr(10)) AS l, text FROM conversations),
p AS (SELECT conv_id, turn, 0 AS a, 0::BIGINT AS k, role AS line FROM conversations UNION ALL SELECT conv_id, turn, 1, unnest(range(len(l))), unnest(l) FROM (SELECT conv_id, turn, list_concat(string_split(text || '   x   ', chr(10)), ['end']) AS l FROM conversations)),
q AS (SELECT conv_id, turn, a, k, regexp_replace(line, '^\s+|\s+$', '', 'g') AS line FROM p)
SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, a, k) - 1 AS line_no, md5(line) AS line_md5 FROM q WHERE line <> ''""",
    "repaired_lines": rf"""WITH l AS (SELECT l_suppkey AS doc, {", ".join(_ORDER)}, string_split(regexp_replace(replace(line, '**', ''), '(다\.)부칙', '\1' || chr(10) || '부칙', 'g'), chr(10)) AS p FROM (SELECT *, {_REPAIRED} AS line FROM (SELECT *, l_quantity::INT::VARCHAR AS q, l_returnflag AS f FROM lineitem))),
u AS (SELECT doc, {", ".join(_ORDER)}, unnest(range(len(p))) AS k, unnest(p) AS s FROM l)
SELECT doc, row_number() OVER (PARTITION BY doc ORDER BY {", ".join(_ORDER)}, k)::INT AS line_no, regexp_replace(regexp_replace(s, '^1\.\s+(\d+\.\s)', '\1'), '^-\s*([①-⑳])', '\1') AS line FROM u""",
    "parsed_dialects": f"WITH {_WORDED}, ln AS (SELECT l_suppkey AS doc, row_number() OVER (PARTITION BY l_suppkey ORDER BY {', '.join(_ORDER)}) AS pos, NULL::INT AS page_idx, trim(line) AS s FROM worded), {_DIALECT_DOCS}, {_RECORDS} SELECT * FROM rec",
    "snapshot_records": f"WITH {_BOOK} SELECT heads.doc, island, index_no, first_header, pdf_pages, rec.* EXCLUDE (doc) FROM heads JOIN rec ON rec.doc = key",
    "extracted_book": f"""WITH {_BOOK}, {_ENTRIES}
SELECT z.doc, seq::INT AS seq, l0, toc_title, index_no::VARCHAR AS index_no, pdf_pages, article_count = 0 AS zero_articles, regexp_matches(parsed_title, '[0-9]') AND amend_dates = '' AS glued_dates,
  NOT contains({_BARE("parsed_title")}, {_BARE("toc_title")}) AND NOT contains({_BARE("toc_title")}, {_BARE("parsed_title")}) AS title_mismatch, rec.* EXCLUDE (doc) FROM z JOIN toc USING (doc, seq) JOIN rec ON rec.doc = z.key""",
    "patched_book": f"WITH {_PATCHED}, {_ENTRIES} SELECT z.doc, seq::INT AS seq, l0, toc_title, index_no::VARCHAR AS index_no, pdf_pages, rec.* EXCLUDE (doc) FROM z JOIN toc USING (doc, seq) JOIN rec ON rec.doc = z.key",
    "statutes": f"WITH {_STATUTES} SELECT s_suppkey AS doc, s_suppkey + 120 AS seq, s_name AS toc_title, '2,3' AS table_pages, rec.* EXCLUDE (doc, attachments) FROM rec JOIN supplier ON s_suppkey = rec.doc",
    "table_owners": f"""WITH {_BOOK}, {_ENTRIES} SELECT pg.doc, page_idx + 1 AS page, (SELECT min(seq)::INT FROM z JOIN toc USING (doc, seq) JOIN islands i USING (doc, island) WHERE z.doc = pg.doc AND i.page_idx = pg.page_idx) AS seq FROM pg WHERE (page_idx + 1) % 7 = 0""",
    "headings_ahead": rf"""WITH RECURSIVE l0 AS (SELECT l_suppkey AS doc, {", ".join(_ORDER)}, row_number() OVER (PARTITION BY l_suppkey ORDER BY {", ".join(_ORDER)}) AS n, trim([{", ".join(map(_text, _TORN))}][l_partkey % {len(_TORN)} + 1]) AS s FROM lineitem),
l1 AS (SELECT *, s || lead(s, 1) OVER w AS j1, j1 || lead(s, 2) OVER w AS j2, j2 || lead(s, 3) OVER w AS j3 FROM l0 WINDOW w AS (PARTITION BY doc ORDER BY n)),
cand AS (SELECT doc, n, CASE WHEN regexp_matches(j1, '^제\s*\d+\s*[장절관]') THEN 1 WHEN regexp_matches(j2, '^제\s*\d+\s*[장절관]') THEN 2 WHEN regexp_matches(j3, '^제\s*\d+\s*[장절관]') THEN 3 END AS k, CASE k WHEN 1 THEN j1 WHEN 2 THEN j2 ELSE j3 END AS t
  FROM l1 WHERE regexp_matches(s, '^제\s*\d*\s*$') AND k IS NOT NULL),
pick AS (SELECT doc, min(n) AS n FROM cand GROUP BY doc UNION ALL SELECT p.doc, (SELECT min(c.n) FROM cand c WHERE c.doc = p.doc AND c.n > p.n + (SELECT d.k FROM cand d WHERE d.doc = p.doc AND d.n = p.n)) FROM pick p WHERE p.n IS NOT NULL),
took AS (SELECT cand.* FROM pick JOIN cand USING (doc, n)), gone AS (SELECT doc, n + i AS n FROM took, range(1, 4) r(i) WHERE i <= k),
l2 AS (SELECT l0.* EXCLUDE (s), coalesce(t, s) AS s FROM l0 LEFT JOIN took USING (doc, n) ANTI JOIN gone USING (doc, n)),
l3 AS (SELECT *, s = '부' AND coalesce(lead(s) OVER w = '칙', false) AS first, s = '칙' AND coalesce(lag(s) OVER w = '부', false) AS second FROM l2 WINDOW w AS (PARTITION BY doc ORDER BY n))
SELECT doc, {", ".join(_ORDER)}, CASE WHEN first THEN '부칙' ELSE s END AS line FROM l3 WHERE NOT second""",
}
