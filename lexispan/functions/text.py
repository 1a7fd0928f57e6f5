"""Scalar text functions of the document engine, as Spark column expressions.

Everything here is built from Spark's own functions, so it stays inside generated
code. White space means Unicode white space unless a name says otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Wording and characters of the rule books' own conventions.
IN_FORCE = "현행"
NO_CATEGORY = "(미분류)"
DIRECT = "__direct__"
CHAPTER = r"^제\s*(\d+)\s*장\s+(.*)$"
SECTION = r"^제\s*(\d+)\s*절\s+(.*)$"
SUBSECTION = r"^제\s*(\d+)\s*관\s+(.*)$"
ARTICLE = r"^제\s*(\d+)\s*조(?:의\s*(\d+))?\s*(?:\(([^)]*)\))?"
ADDENDA = r"^부\s*칙$|^부\s*칙\s"
ATTACHMENT = r"^\[(별지서식|별표)[^\]]*\]"
DATE_LINE = r"^(제정|개정|전면\s*개정|폐지|신설)\s*([\d.\s,]+)$"
RUNNING_HEADER = r"^(\d+)\.\s*(.+)$"
PAGE_FOOTER = r"^-\s*\d+\s*-$"
DIVIDER = r"^[ⅠⅡⅢⅣ]\."
AMENDMENT_TAG = r"\(([^()]*?(?:개정|신설|삭제|폐지)[^()]*?)\)"
GLUED_ADDENDA = r"(다\.)(부칙)"
TAG_DATE = r"\d{4}\.\s?\d{1,2}\.\s?\d{1,2}"
OWN_TITLE = r"^제\s*\d+\s*조(?:\s*의\s*\d+)?\s*\(([^)]*)\)"
TABLE_MARKER = "[표 - 별표 참조]"
INTERPUNCTS = r"\x{00B7}\x{2024}\x{2027}\x{2219}\x{30FB}"
ELIDED = r"\(생략\)|\(현행과 같음\)|\(현행과 동일\)|\(현행과같음\)|\(변동\s*(없음|사항 없음)\)|\(현행\s*과\s*같음\)|~|\(항 삭제\)|\(호 삭제\)"

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def unicode_re(pattern: str) -> str:
    """Make \\s, \\d and \\w of a pattern mean Unicode classes, as in Python."""
    return f"(?U){pattern}"


def matches(c: Column, pattern: str) -> Column:
    """Null-safe regex search."""
    return F.coalesce(c.rlike(unicode_re(pattern)), F.lit(False))


def group(c: Column, pattern: str, n: int) -> Column:
    """A capture group; null where the pattern or the group doesn't match."""
    return F.nullif(F.regexp_extract(c, unicode_re(pattern), n), F.lit(""))


def ascii_lower(c: Column) -> Column:
    return F.translate(c, _UPPER, _UPPER.lower())


def like_ascii(c: Column, q: str) -> Column:
    """``LIKE '%q%'`` that folds ASCII case only; % and _ in q stay wildcards and a
    backslash is a plain character."""
    folded = "".join(ch.lower() if ch in _UPPER else ch for ch in q)
    if "%" not in q and "_" not in q:
        return F.contains(ascii_lower(c), F.lit(folded))
    return ascii_lower(c).like("%" + folded.replace("\\", "\\\\") + "%")


def normalize_ws(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def without_ws(c: Column) -> Column:
    return F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\s+", "")


def normalize_title(c: Column) -> Column:
    """Titles without white space, interpuncts, commas and parentheses."""
    return F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)[\s·․,()]", "")


def archive_key(c: Column, institution: str = "") -> Column:
    """Titles without white space, the institution's name in front and interpuncts."""
    bare = without_ws(c)
    if institution:
        bare = F.when(bare.startswith(institution), F.substring(bare, len(institution) + 1, 1 << 30)).otherwise(bare)
    return F.regexp_replace(bare, f"[{INTERPUNCTS}]", "")


def archive_title(c: Column, rounds: int = 4) -> Column:
    """Strip trailing parentheticals and amendment verbs, up to four times: a further
    round changes nothing once one did."""
    out = strip(c)
    for _ in range(rounds):
        out = strip(F.regexp_replace(out, r"(?U)\s*[\(（][^()（）]*[\)）]\s*$", ""))
        out = strip(F.regexp_replace(out, r"(?U)(개정|신설|폐지|수정개정|전면개정|전면개편|변경)+\s*(\(안\)|안)?\s*$", ""))
    return without_ws(out)


def pad_date(c: Column) -> Column:
    """``2011. 9.23`` -> ``2011.09.23``."""
    parts = F.split(F.regexp_replace(c, r"(?U)\s+", ""), r"\.")
    return F.concat_ws(".", F.lpad(F.get(parts, F.lit(0)), 4, "0"), F.lpad(F.get(parts, F.lit(1)), 2, "0"), F.lpad(F.get(parts, F.lit(2)), 2, "0"))


def tag_dates(c: Column, tag: str = AMENDMENT_TAG, date: str = TAG_DATE) -> Column:
    """Distinct dates inside the body's amendment tags, sorted and zero-padded."""
    tags = F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(unicode_re(tag)), F.lit(1))
    dates = F.flatten(F.transform(tags, lambda t: F.regexp_extract_all(t, F.lit(unicode_re(date)), F.lit(0))))
    return F.array_sort(F.array_distinct(F.transform(dates, pad_date)))


def noise_stripped(c: Column) -> Column:
    """What a body says once layout noise is taken away: table markers, white space,
    zero-width and private-use characters, interpuncts and runs of dots."""
    out = F.replace(F.coalesce(c, F.lit("")), F.lit(TABLE_MARKER), F.lit(""))
    out = F.regexp_replace(out, r"(?U)[\s\x{200B}-\x{200D}\x{FEFF}]+", "")
    out = F.regexp_replace(out, r"[\x{E000}-\x{F8FF}]", "")
    out = F.regexp_replace(out, r"[\x{2024}\x{00B7}\x{2027}\x{30FB}]", "")
    return F.regexp_replace(out, r"\.+", ".")


def change_date(old: Column, new: Column, fallback: Column) -> Column:
    """struct(date, method): the latest tag date that only the new body has, else the
    date of observation."""
    fresh = F.array_sort(F.array_except(tag_dates(new), tag_dates(old)))
    n = F.size(fresh)
    date = F.when(n > 0, F.try_element_at(fresh, F.lit(-1))).otherwise(F.replace(fallback, F.lit("-"), F.lit(".")))
    method = F.when(n == 1, "tag").when(n > 1, "tag-multi").otherwise("fallback")
    return F.struct(date.alias("date"), method.alias("method"))


def own_title(c: Column) -> Column:
    return F.nullif(strip(F.regexp_extract(strip(F.coalesce(c, F.lit(""))), unicode_re(OWN_TITLE), 1)), F.lit(""))


def titles_conflict(old: Column, new: Column) -> Column:
    """Both bodies name their own topic, and neither name contains the other."""
    a, b = own_title(old), own_title(new)
    return F.coalesce(~F.contains(a, b) & ~F.contains(b, a), F.lit(False))


def article_label(no: Column, sub_no: Column, title: Column) -> Column:
    has_sub, has_title = F.coalesce(sub_no != 0, F.lit(False)), F.coalesce(title != "", F.lit(False))
    return F.concat(
        F.lit("제"), no.cast("string"), F.lit("조"),
        F.when(has_sub, F.concat(F.lit("의"), sub_no.cast("string"))).otherwise(""),
        F.when(has_title, F.concat(F.lit("("), title, F.lit(")"))).otherwise(""),
    )


def html_escape(c: Column, quotes: bool = True) -> Column:
    pairs = [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")] + [('"', "&quot;"), ("'", "&#x27;")] * quotes
    for a, b in pairs:
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def snippet(body: Column, q: str, context: int = 40) -> Column:
    """The first match with its surroundings, escaped, the match marked; without a
    match the beginning of the body."""
    at = F.locate(q.lower(), F.lower(body))  # 1-based
    n = F.length(body)
    start = F.greatest(at - 1 - context, F.lit(0))
    end = F.least(at - 1 + len(q) + context, n)
    part = lambda a, b: html_escape(F.substring(body, a + 1, b - a))
    found = F.concat(
        F.when(start > 0, "…").otherwise(""),
        part(start, at - 1),
        F.lit("<mark>"),
        part(at - 1, at - 1 + len(q)),
        F.lit("</mark>"),
        part(at - 1 + len(q), end),
        F.when(end < n, "…").otherwise(""),
    )
    missing = F.concat(html_escape(F.substring(body, 1, context * 2)), F.when(n > context * 2, "…").otherwise(""))
    return F.when(at > 0, found).otherwise(missing)


def add_months_28(d: Column, months: int) -> Column:
    """Months later, the day held to 28 at most."""
    m = F.month(d) - 1 + months
    return F.make_date(F.year(d) + F.floor(m / 12).cast("int"), (F.pmod(m, F.lit(12)) + 1).cast("int"), F.least(F.dayofmonth(d), F.lit(28)))


def text_date(c: Column) -> Column:
    """DATE of a dotted text date; null where a part is missing."""
    return F.try_to_date(c, "yyyy.M.d")


def worded_dates(c: Column) -> Column:
    """Dates written as ``YYYY년 M월 D일``, dotted and padded, in order of first mention."""
    found = F.regexp_extract_all(c, F.lit(r"(?U)\d{4}\s*년\s*\d{1,2}\s*월\s*\d{1,2}\s*일"), F.lit(0))
    return F.array_distinct(F.transform(found, lambda d: pad_date(F.regexp_replace(F.regexp_replace(d, "[년월]", "."), "일", ""))))


def clean_cell(c: Column) -> Column:
    """Table-cell text: line breaks to spaces, no tags, bold marks or double spaces."""
    out = F.regexp_replace(c, "<br/?>", " ")
    out = F.regexp_replace(out, "<[^>]+>", "")
    out = F.replace(out, F.lit("**"), F.lit(""))
    return normalize_ws(F.replace(out, F.lit(" "), F.lit(" ")))


def split_row(c: Column) -> Column:
    """Cells of a pipe-table row."""
    bare = F.regexp_replace(F.regexp_replace(strip(c), r"^\|", ""), r"\|$", "")
    return F.transform(F.split(bare, r"\|"), strip)


def list_repairs(c: Column) -> Column:
    """Undo doubled list numbers, bullets before circled numbers and bold marks."""
    out = F.regexp_replace(c, r"(?U)^1\.\s+(\d+\.\s)", "$1")
    out = F.regexp_replace(out, r"(?U)^-\s*([①-⑳])", "$1")
    return F.replace(out, F.lit("**"), F.lit(""))


def whole_lines(c: Column) -> Column:
    """The lines of a converted line: bold marks gone, list numbers repaired, and an addenda
    marker that the conversion glued to the sentence before it on a line of its own."""
    parts = F.split(F.regexp_replace(F.replace(c, F.lit("**"), F.lit("")), GLUED_ADDENDA, "$1\n$2"), "\n")
    return F.transform(parts, list_repairs)


def highlight_amendments(c: Column) -> Column:
    return F.regexp_replace(c, r"([(\[])([^()\[\]]*?(?:개정|신설|삭제|폐지)[^()\[\]]*?)([)\]])", '<span class="amend-tag">$1$2$3</span>')


def strip_article_head(body: Column, no: Column, sub_no: Column) -> Column:
    """Body without its ``제N조[의M][(title)]``, if it is this very article's."""
    head = unicode_re(r"^제\s*(\d+)\s*조(?:\s*의\s*(\d+))?(?:\s*\([^)]*\))?")
    bare = unicode_re(r"^제\s*\d+\s*조(?:\s*\([^)]*\))?")
    same_no = F.regexp_extract(body, head, 1) == no.cast("string")
    has_sub = F.coalesce(sub_no != 0, F.lit(False))
    same_sub = F.regexp_extract(body, head, 2) == sub_no.cast("string")
    return F.when(same_no & has_sub & same_sub, F.regexp_replace(body, head, "")).when(same_no & ~has_sub, F.regexp_replace(body, bare, "")).otherwise(body)


def stored_body(c: Column) -> Column:
    """Edited multi-line text back to the stored form: one line, single spaces."""
    return normalize_ws(c)


def table_html(rows: Column, css_class: str = "inline-table", source_url: Column | None = None) -> Column:
    """Rows of cells as an HTML table in its wrapper."""
    cell = lambda x: F.concat(F.lit("<td>"), F.replace(html_escape(F.coalesce(x, F.lit(""))), F.lit("\n"), F.lit("<br>")), F.lit("</td>"))
    body = F.array_join(F.transform(rows, lambda r: F.concat(F.lit("<tr>"), F.array_join(F.transform(r, cell), ""), F.lit("</tr>"))), "")
    link = F.lit("")
    if source_url is not None:
        link = F.coalesce(F.concat(F.lit('<a class="table-src-link" href="'), source_url, F.lit('" target="_blank">원본 페이지 보기 (PDF)</a>')), F.lit(""))
    return F.concat(F.lit(f'<div class="article-table-wrap"><table class="{css_class}"><tbody>'), body, F.lit("</tbody></table>"), link, F.lit("</div>"))


def real_table(rows: Column, min_rows: int = 2, min_cols: int = 2, digit_row: bool = False) -> Column:
    """Is a detected grid a table: large enough, or (if allowed) one row with a digit."""
    n, m = F.size(rows), F.coalesce(F.array_max(F.transform(rows, F.size)), F.lit(0))
    out = (n >= min_rows) & (m >= min_cols)
    if digit_row:
        out = out | ((n == 1) & (m >= min_cols) & F.exists(F.flatten(rows), lambda c: F.coalesce(c.rlike(r"\d"), F.lit(False))))
    return out


def degenerate(rows: Column, breaks: int = 3) -> Column:
    """Some cell holds so many line breaks that the grid is not a real one."""
    return F.exists(F.flatten(rows), lambda c: F.coalesce(F.length(c) - F.length(F.replace(c, F.lit("\n"), F.lit(""))) >= breaks, F.lit(False)))


def full_text(old: Column, new: Column) -> Column:
    """Both bodies are there and neither elides unchanged parts."""
    return F.coalesce((old != "") & (new != "") & ~old.rlike(ELIDED) & ~new.rlike(ELIDED), F.lit(False))


def file_date(c: Column) -> Column:
    """Date in a file name: ``YYYY.MM.DD`` with glued or missing parts (day 1)."""
    got = lambda n: F.regexp_extract(c, r"(\d{4})[.\-_ ]?(\d{1,2})(?:[.\-_ ]?(\d{1,2}))?", n)
    day = F.coalesce(F.nullif(got(3), F.lit("")), F.lit("1"))
    return F.when(got(1) != "", F.try_to_date(F.concat_ws("-", got(1), got(2), day), "yyyy-M-d"))


def edition_date(c: Column) -> Column:
    """Edition date in a file name: the one in parentheses that says so, else any in
    parentheses, else the first in the name."""
    named = F.regexp_extract(c, r"\(개정일\s*(20\d{2}[^)]*)\)", 1)
    bracketed = F.regexp_extract(c, r"\((20\d{2}[^)]*)\)", 1)
    raw = F.coalesce(F.nullif(named, F.lit("")), F.nullif(bracketed, F.lit("")), c)
    got = lambda n: F.regexp_extract(raw, r"(20\d{2})\D{0,3}(\d{1,2})\D{1,2}(\d{1,2})", n)
    return F.when(got(1) != "", F.try_to_date(F.concat_ws("-", got(1), got(2), got(3)), "yyyy-M-d"))


def tighten(c: Column) -> Column:
    """``제 3 조 의 2`` -> ``제3조의2`` (articles, chapters, sections and items alike)."""
    out = F.regexp_replace(c, r"(?U)제\s+(?=\d+\s*[조장절관항호])", "제")
    out = F.regexp_replace(out, r"(?U)(제\d+)\s+(?=[조장절관항호])", "$1")
    return F.regexp_replace(out, r"(?U)(제\d+[조장절관항호])(?:\s*(의))?(?:\s*(\d+))", "$1$2$3")


def page_range_label(start: Column, end: Column) -> Column:
    """``p.3~5``, ``p.3`` or ``-``."""
    more = F.when((end != 0) & (end != start), F.concat(F.lit("~"), end.cast("string"))).otherwise("")
    return F.when(F.coalesce(start != 0, F.lit(False)), F.concat(F.lit("p."), start.cast("string"), F.coalesce(more, F.lit("")))).otherwise("-")


def breadcrumb(title: Column, *categories: Column, sep: str = " › ") -> Column:
    return F.concat_ws(sep, F.lit("홈"), *[F.nullif(c, F.lit("")) for c in categories], title)


def anchor_id(no: Column, sub_no: Column) -> Column:
    return F.concat_ws("-", F.lit("art"), no.cast("string"), F.nullif(sub_no, F.lit(0)).cast("string"))


def append_to_last_row(markup: Column, extra: Column) -> Column:
    """Put text at the end of the first cell of the last table row; without such a cell
    the markup stays as it is."""
    at = F.length(markup) - F.locate(">rt<", F.reverse(markup)) - 2  # 1-based start of the last <tr>
    has_row = F.locate(">rt<", F.reverse(markup)) > 0
    tail = F.substring(markup, at, F.length(markup))
    end = F.locate("</td>", tail)
    text = F.concat(F.lit("<br>"), F.replace(html_escape(extra), F.lit("\n"), F.lit("<br>")))
    put = F.concat(F.substring(markup, F.lit(1), at - 1), F.substring(tail, F.lit(1), end - 1), text, F.substring(tail, end, F.length(tail)))
    return F.when(has_row & (end > 0), put).otherwise(markup)


def page_noise_removed(c: Column, titles: list[str]) -> Column:
    """Take running headers ``N. title`` (known titles, longest first) and page footers
    out of a body. The titles are a catalog's: a bounded list."""
    names = "|".join("\\Q" + t + "\\E" for t in sorted(set(titles), key=lambda t: (-len(t), t)))
    out = F.regexp_replace(c, rf"(?U)\s?\d{{1,3}}\.\s*(?:{names})\s?", " ") if names else c
    return strip(F.regexp_replace(out, r"(?U)-\s*\d{1,3}\s*-", ""))


def clean_title(front: Column) -> Column:
    """Title among front-matter lines: the last that is neither a date line nor a table
    row (or just the last), without its list number; '' if there is none."""
    plain = F.filter(front, lambda x: ~strip(x).rlike(r"(?U)^(신설|개정|제정|폐지|전면\s*개정)\s*[\d년월일.\s,]+$") & ~strip(x).rlike(r"^\|.*\|$"))
    chosen = F.when(F.size(plain) > 0, plain).otherwise(front)
    bare = F.filter(F.transform(chosen, lambda x: strip(F.regexp_replace(x, r"(?U)^\d+[.\)]\s*", ""))), lambda x: x != "")
    return F.coalesce(F.try_element_at(bare, F.lit(-1)), F.lit(""))
