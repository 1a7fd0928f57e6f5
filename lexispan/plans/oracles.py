"""DuckDB SQL for the registered queries, on the raw tables."""

from __future__ import annotations

from lexispan.plans import extraction

_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _low(x: str) -> str:
    return f"translate({x}, '{_UP}', '{_LOW}')"


def _escape(x: str) -> str:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("''", "&#x27;")):
        x = f"replace({x}, '{a}', '{b}')"
    return x


def _strip(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def _ws(x: str) -> str:
    return rf"trim(regexp_replace({x}, '\s+', ' ', 'g'))"


def _snippet(body: str, q: str, n: int = 40) -> str:
    at, size = f"strpos(lower({body}), '{q.lower()}')", len(q)
    start, end = f"greatest({at} - 1 - {n}, 0)", f"least({at} - 1 + {size} + {n}, length({body}))"
    part = lambda a, b: _escape(f"substring({body}, ({a}) + 1, ({b}) - ({a}))")
    return f"""CASE WHEN {at} > 0 THEN CASE WHEN {start} > 0 THEN '…' ELSE '' END || {part(start, f"{at} - 1")} || '<mark>' || {part(f"{at} - 1", f"{at} - 1 + {size}")} || '</mark>'
  || {part(f"{at} - 1 + {size}", end)} || CASE WHEN {end} < length({body}) THEN '…' ELSE '' END
  ELSE {_escape(f"substring({body}, 1, {2 * n})")} || CASE WHEN length({body}) > {2 * n} THEN '…' ELSE '' END END"""


_REGS = """regs AS (SELECT c_custkey AS id, c_custkey AS seq, c_name AS title, c_mktsegment AS category_l0, CASE WHEN c_nationkey % 5 <> 0 THEN c_nationkey::VARCHAR END AS category_l1,
  c_acctbal >= 0 AS live FROM customer),
latest AS (SELECT o_custkey AS id, max(strftime(o_orderdate, '%Y.%m.%d')) AS latest_amend FROM orders GROUP BY 1)"""
_LIST = f"WITH {_REGS} SELECT id, seq, title, category_l0, category_l1, latest_amend FROM regs LEFT JOIN latest USING (id) WHERE live"
_PAGE = "LIMIT 20 OFFSET 20"
_REVS = "revs AS (SELECT o_orderkey AS id, o_custkey AS regulation_id, strftime(o_orderdate, '%Y.%m.%d') AS revised_at, o_orderpriority AS summary, o_orderstatus AS created_at FROM orders)"
_COUNTS = "counts AS (SELECT l_orderkey AS id, count(*) AS n FROM lineitem GROUP BY 1)"
_LINES = rf"""lines AS (SELECT doc_id AS doc, i - 1 AS line_no, l[i] AS line, {_strip("l[i]")} AS s FROM (SELECT doc_id, string_split(text, chr(10)) AS l, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents))"""
_IS = lambda words, x="s": f"regexp_matches({x}, '^(?:{words})(?:[ ,.]|$)')"
_STRUCTURE = f"""{_LINES},
a AS (SELECT *, max({_IS("Or")}::INT) OVER (PARTITION BY doc ORDER BY line_no) = 1 AS in_addenda FROM lines WHERE s <> ''),
k AS (SELECT *, CASE WHEN {_IS("Or")} THEN 'B' WHEN in_addenda THEN 'T' WHEN {_IS("The")} THEN 'C' WHEN {_IS("In|Of")} THEN 'S' WHEN {_IS("To|And")} THEN 'G' WHEN {_IS("A|On|For|Is")} THEN 'A' ELSE 'T' END AS kind FROM a),
c AS (SELECT *, sum((kind = 'C')::INT) OVER (PARTITION BY doc ORDER BY line_no) AS cn, sum((kind <> 'T')::INT) OVER (PARTITION BY doc ORDER BY line_no) AS seg,
  last_value(CASE WHEN kind = 'C' THEN {_ws("s")} END IGNORE NULLS) OVER (PARTITION BY doc ORDER BY line_no) AS chapter FROM k),
d AS (SELECT *, sum((kind = 'S')::INT) OVER (PARTITION BY doc, cn ORDER BY line_no) AS sn,
  last_value(CASE WHEN kind = 'S' THEN {_ws("s")} END IGNORE NULLS) OVER (PARTITION BY doc, cn ORDER BY line_no) AS section FROM c),
st AS (SELECT *, last_value(CASE WHEN kind = 'G' THEN {_ws("s")} END IGNORE NULLS) OVER (PARTITION BY doc, cn, sn ORDER BY line_no) AS gwan FROM d)"""
_ADDENDA = f"""{_STRUCTURE},
m AS (SELECT *, sum((kind = 'B')::INT) OVER (PARTITION BY doc ORDER BY line_no) AS bn FROM st WHERE in_addenda),
ad AS (SELECT doc, line_no, CASE WHEN kind = 'B' THEN '--' ELSE s END AS s FROM m WHERE kind <> 'B' OR bn > 1),
al AS (SELECT *, regexp_matches(s, '^Th') AS is_label, sum(regexp_matches(s, '^Th')::INT) OVER (PARTITION BY doc ORDER BY line_no) AS attachment FROM ad)"""
_PAGES = r"""pg AS (SELECT user_id AS doc, event_id AS page_idx, CASE event_type WHEN 'view' THEN 'continued' WHEN 'error' THEN '' ELSE ((event_id // 3) % 7 + 1)::VARCHAR || '.  ' || event_type END AS header,
  CASE WHEN event_type NOT IN ('view', 'error') THEN (event_id // 3) % 7 + 1 END AS y FROM events)"""
_TAGGED = """orders_t AS (SELECT o_custkey AS regulation_id, o_orderkey AS version, o_orderdate::DATE AS d, '제3조(목적) ' || o_orderpriority
  || CASE WHEN o_orderkey % 3 = 0 THEN ' (개정 ' || strftime(o_orderdate, '%Y. %-m. %-d') || ')' ELSE '' END
  || CASE WHEN o_orderkey % 4 = 0 THEN ' (신설 ' || strftime(o_orderdate::DATE - 400, '%Y.%m.%d') || ', ' || strftime(o_orderdate, '%Y. %-m. %-d') || ')' ELSE '' END AS body,
  CASE WHEN o_orderkey % 4 = 0 THEN [strftime(o_orderdate::DATE - 400, '%Y.%m.%d'), strftime(o_orderdate, '%Y.%m.%d')] WHEN o_orderkey % 3 = 0 THEN [strftime(o_orderdate, '%Y.%m.%d')] ELSE []::VARCHAR[] END AS dates FROM orders)"""


def _noise(x: str) -> str:
    x = rf"regexp_replace(replace({x}, '[표 - 별표 참조]', ''), '[\s\x{{200B}}-\x{{200D}}\x{{FEFF}}]+', '', 'g')"
    x = rf"regexp_replace({x}, '[\x{{E000}}-\x{{F8FF}}\x{{2024}}\x{{00B7}}\x{{2027}}\x{{30FB}}]', '', 'g')"
    return rf"regexp_replace({x}, '\.+', '.', 'g')"


def _archive_title(x: str) -> str:
    x = _strip(x)
    for _ in range(4):
        x = _strip(rf"regexp_replace({x}, '\s*[\(（][^()（）]*[\)）]\s*$', '')")
        x = _strip(rf"regexp_replace({x}, '(개정|신설|폐지|수정개정|전면개정|전면개편|변경)+\s*(\(안\)|안)?\s*$', '')")
    return rf"regexp_replace({x}, '\s+', '', 'g')"


def _archive_key(x: str) -> str:
    return rf"regexp_replace(regexp_replace({x}, '\s+', '', 'g'), '[\x{{00B7}}\x{{2024}}\x{{2027}}\x{{2219}}\x{{30FB}}]', '', 'g')"


def _months(d: str, n: int) -> str:
    m = f"(month({d}) - 1 + {n})"
    return f"make_date(year({d}) + {m} // 12, {m} % 12 + 1, least(day({d}), 28))"


def _clean(x: str) -> str:
    return _ws(f"replace(replace(regexp_replace(regexp_replace({x}, '<br/?>', ' ', 'g'), '<[^>]+>', '', 'g'), '**', ''), chr(160), ' ')")


def _shingles(x: str, n: int = 3) -> str:
    return f"list_distinct(list_transform(range(1, greatest(length({x}) - {n} + 2, 1)), lambda i: substring({x}, i, {n})))"


def _containment(needles: str, text: str) -> str:
    return f"CASE WHEN len({needles}) > 0 THEN len(list_filter({needles}, lambda g: contains({text}, g))) / len({needles}) ELSE 0.0 END"


_BARE = lambda x: rf"regexp_replace({x}, '\s+', '', 'g')"
_DATED = "SELECT DISTINCT o_custkey AS regulation_id, strftime(o_orderdate, '%Y.%m.%d') AS amend_date FROM orders WHERE o_orderstatus"
_OLD_NEW = f"o AS ({_DATED} <> 'O'), n AS (SELECT * FROM ({_DATED} = 'O') ANTI JOIN o USING (regulation_id, amend_date))"
_PAIRS = """runs AS (SELECT unnest(regexp_extract_all(text, '[a-z]+')) AS r FROM documents),
jp AS (SELECT substring(r, i, 2) AS pair, count(*)::BIGINT AS joined FROM (SELECT r, unnest(range(1, length(r))) AS i FROM runs) GROUP BY 1),
sp AS (SELECT right(string_split(m, ' ')[1], 1) || left(string_split(m, ' ')[2], 1) AS pair, count(*)::BIGINT AS split FROM (SELECT unnest(regexp_extract_all(text, '[a-z]+ [a-z]+')) AS m FROM documents) GROUP BY 1)"""
_CELL = f"'<td>' || replace({_escape('x')}, chr(10), '<br>') || '</td>'"

_CAND = "cand AS (SELECT pair FROM sp JOIN jp USING (pair) WHERE joined >= 15 AND joined / (joined + split) >= 0.9 AND left(pair, 1) NOT IN ('x', 'q') AND pair <> 'he')"


def _round(k: int) -> str:
    """One pass over every non-overlapping pair of runs."""
    t = f"t{k - 1}"
    m = f"regexp_extract_all({t}, '[a-z]+ [a-z]+')"
    return f"""f{k} AS (SELECT doc_id, array_to_string(list_transform(range(1, len(b) + 1), lambda i: b[i] || CASE WHEN m[i] IS NULL THEN '' WHEN list_contains(close,
  regexp_extract(m[i], '([a-z]) ([a-z])', 1) || regexp_extract(m[i], '([a-z]) ([a-z])', 2)) THEN replace(m[i], ' ', '') ELSE m[i] END), '') AS t{k}
  FROM (SELECT doc_id, {m} AS m, regexp_split_to_array({t}, '[a-z]+ [a-z]+') AS b, close FROM f{k - 1}, (SELECT list(pair) AS close FROM cand)))"""


def _gaps(text: str, source: str) -> str:
    return f"""SELECT x[i] || x[i + 2] AS pair, count(*) AS n FROM (SELECT x, unnest(range(1, len(x) - 1)) AS i FROM (SELECT string_split({text}, '') AS x FROM {source}))
WHERE x[i + 1] = ' ' AND regexp_matches(x[i], '^[a-z]$') AND regexp_matches(x[i + 2], '^[a-z]$') GROUP BY 1"""


_FIXED = f"{_PAIRS}, {_CAND}, f0 AS (SELECT doc_id, text AS t0 FROM documents), " + ", ".join(map(_round, (1, 2, 3, 4)))

ORACLES = {
    "list_by_seq": f"{_LIST} AND category_l0 = 'BUILDING' ORDER BY seq, id {_PAGE}",
    "list_by_title": f"{_LIST} AND category_l0 = 'BUILDING' ORDER BY title, id {_PAGE}",
    "list_by_date": f"{_LIST} AND category_l0 = 'BUILDING' ORDER BY latest_amend DESC NULLS LAST, id {_PAGE}",
    "list_total": f"WITH {_REGS} SELECT count(*)::BIGINT AS total, greatest(1, ceil(count(*) / 20))::BIGINT AS pages FROM regs WHERE live AND category_l0 = 'BUILDING' AND {_low('title')} LIKE '%customer#%1_%'",
    "list_all": _LIST,
    "recent_topk": f"WITH {_REGS} SELECT id, title, latest_amend FROM regs JOIN latest USING (id) WHERE live ORDER BY latest_amend DESC, id LIMIT 10",
    "title_search": f"SELECT p_partkey, p_name FROM part WHERE {_low('p_name')} LIKE '%e%_ri%'",
    "title_filter": "SELECT p_partkey, p_type AS title FROM part WHERE contains(lower(p_type), 'econ')",
    "body_search": f"""SELECT d.doc_id AS regulation_id, 'r' || d.doc_id AS regulation_title, (d.doc_id % 50)::INT AS article_no, (d.doc_id % 3)::INT AS article_sub_no,
  '제' || (d.doc_id % 50) || '조' || CASE WHEN d.doc_id % 3 <> 0 THEN '의' || (d.doc_id % 3) ELSE '' END || CASE WHEN lang <> '' THEN '(' || lang || ')' ELSE '' END AS article_label, {_snippet("text", "tion the")} AS snippet
  FROM documents d JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY 1) l USING (doc_id) WHERE quality = 1 AND contains({_low("text")}, 'tion the')""",
    "body_search_snippet": f"SELECT page_id, {_snippet('html', 'The')} AS snippet FROM pages",
    "attachment_search": f"""SELECT o_custkey AS regulation_id, c_name AS regulation_title, o_orderkey AS ordinal, o_orderpriority AS label, (o_orderstatus = 'F')::INT AS has_table
  FROM orders JOIN customer ON o_custkey = c_custkey WHERE {_low("c_name")} LIKE '%urgent%' OR {_low("o_orderpriority")} LIKE '%urgent%'""",
    "revision_range_count": f"""WITH {_REVS}, {_COUNTS} SELECT id, regulation_id, c_name AS regulation_title, revised_at, coalesce(n, 0)::BIGINT AS changed_count FROM revs JOIN customer ON regulation_id = c_custkey LEFT JOIN counts USING (id)
  WHERE {_low("c_name")} LIKE '%customer#%' AND revised_at BETWEEN '1995.01.01' AND '1997.12.31'""",
    "revision_page": f"""WITH {_REVS}, {_COUNTS} SELECT id, regulation_id, revised_at, coalesce(n, 0)::BIGINT AS changed_count FROM revs JOIN customer ON regulation_id = c_custkey LEFT JOIN counts USING (id)
  WHERE revised_at >= '1996.01.01' ORDER BY revised_at DESC, created_at DESC, id {_PAGE}""",
    "revisions_map": f"WITH {_REVS} SELECT regulation_id, revised_at, max(id) AS id, arg_max(summary, id) AS summary FROM revs GROUP BY ALL",
    "detail_nested": """SELECT c_custkey AS id, c_name AS title, count(o_orderkey)::INT AS n_amendments, coalesce(string_agg(strftime(o_orderdate, '%Y.%m.%d'), ',' ORDER BY o_orderkey, o_orderdate), '') AS amendments
  FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY ALL""",
    "joined_bodies": "SELECT conv_id AS regulation_id, md5(string_agg(text, ' ' ORDER BY turn, text)) AS body_md5, length(string_agg(text, ' ' ORDER BY turn, text))::INT AS n FROM conversations GROUP BY 1",
    "category_tree": """WITH r AS (SELECT s_suppkey AS id, s_suppkey AS seq, s_name AS title, CASE WHEN r_name <> 'ASIA' THEN r_name ELSE '(미분류)' END AS l0, CASE WHEN n_nationkey % 4 <> 0 THEN n_name ELSE '__direct__' END AS l1
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
g AS (SELECT l0, l1, min(seq) AS first FROM r GROUP BY ALL), t AS (SELECT l0, min(first) AS f FROM g GROUP BY 1),
t2 AS (SELECT l0, row_number() OVER (ORDER BY CASE l0 WHEN 'EUROPE' THEN 1 WHEN 'AFRICA' THEN 2 ELSE 3 END, f, l0)::INT AS l0_rank FROM t),
g2 AS (SELECT l0, l1, row_number() OVER (PARTITION BY l0 ORDER BY l1 <> '__direct__', first, l1)::INT AS l1_rank FROM g)
SELECT l0_rank, l0, l1_rank, l1, seq, id, title FROM r JOIN g2 USING (l0, l1) JOIN t2 USING (l0)""",
    "title_norm_match": r"""WITH l AS (SELECT p_partkey, p_brand || ' ·(' || p_size || ')' AS raw FROM part), r AS (SELECT p_partkey AS id, p_brand || ', ' || p_size AS title FROM part WHERE p_type = 'PROMO'),
g AS (SELECT regexp_replace(title, '[\s·․,()]', '', 'g') AS k, count(*) AS n, min(id) AS one, string_agg(id::VARCHAR, ',' ORDER BY id) AS ids FROM r GROUP BY 1)
SELECT p_partkey, raw, CASE WHEN n = 1 THEN 'MATCHED' WHEN n > 1 THEN 'AMBIGUOUS: ' || ids ELSE 'NO MATCH' END AS match_status, CASE WHEN n = 1 THEN one END AS match_id
FROM l LEFT JOIN g ON regexp_replace(raw, '[\s·․,()]', '', 'g') = k""",
    "archive_titles": f"""WITH r AS (SELECT p_partkey, p_type || CASE WHEN p_size % 2 = 0 THEN ' 전면개정 (안)' ELSE ' 개정(안) (69회)' END || CASE WHEN p_size % 3 = 0 THEN '（x）' ELSE ' ' END AS raw FROM part)
SELECT p_partkey, {_archive_title("raw")} AS title, {_archive_key("raw")} AS key FROM r""",
    "version_diff": """SELECT * FROM (SELECT user_id, event_type, event_id, lag(floor(value)::BIGINT) OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS old_value, floor(value)::BIGINT AS value FROM events WHERE value IS NOT NULL) WHERE old_value <> value""",
    "version_diff_text": f"""WITH v AS (SELECT conv_id, CASE WHEN role = 'user' THEN 1 ELSE 2 END AS no, turn, text, lag(text) OVER (PARTITION BY conv_id, CASE WHEN role = 'user' THEN 1 ELSE 2 END ORDER BY turn) AS old FROM conversations)
SELECT conv_id AS regulation_id, no AS article_no, lpad(turn::VARCHAR, 6, '0') AS revised_at, 'fallback' AS method, md5(old) AS old_md5, md5(text) AS new_md5 FROM v WHERE old <> text AND {_noise("old")} <> {_noise("text")}""",
    "tag_date_resolve": f"WITH {_TAGGED} SELECT version, array_to_string(dates, ',') AS dates FROM orders_t",
    "revision_history": f"""WITH {_TAGGED}, v AS (SELECT *, lag(body) OVER w AS old, lag(dates) OVER w AS old_dates FROM orders_t WINDOW w AS (PARTITION BY regulation_id ORDER BY version)),
f AS (SELECT *, list_sort(list_filter(dates, lambda x: NOT list_contains(old_dates, x))) AS fresh FROM v WHERE old <> body AND {_noise("old")} <> {_noise("body")})
SELECT regulation_id, CASE WHEN len(fresh) > 0 THEN fresh[-1] ELSE strftime(d, '%Y.%m.%d') END AS revised_at, CASE len(fresh) WHEN 0 THEN 'fallback' WHEN 1 THEN 'tag' ELSE 'tag-multi' END AS method, count(*)::BIGINT AS n_changes FROM f GROUP BY ALL""",
    "interval_coverage": f"""WITH e AS (SELECT *, ts::DATE AS day FROM events), b AS (SELECT user_id, day AS bought FROM e WHERE event_type = 'purchase')
SELECT event_id, e.user_id, CASE WHEN count(bought) > 0 THEN 'covered' ELSE 'gap' END AS status, count(bought)::INT AS n_hits, strftime(min(bought), '%Y-%m-%d') AS first_hit
FROM e LEFT JOIN b ON e.user_id = b.user_id AND bought BETWEEN day AND {_months("day", 1)} WHERE event_type = 'signup' GROUP BY event_id, e.user_id""",
    "asof_forward": """WITH e AS (SELECT *, ts::DATE AS day FROM events), b AS (SELECT user_id, day AS bought FROM e WHERE event_type = 'purchase'),
n AS (SELECT event_id, e.user_id, day, min(bought) AS nxt FROM e LEFT JOIN b ON e.user_id = b.user_id AND bought >= day WHERE event_type = 'view' GROUP BY ALL)
SELECT event_id, user_id, CASE WHEN nxt - day <= 5 THEN strftime(nxt, '%Y-%m-%d') END AS next FROM n""",
    "anti_upsert": """WITH o AS (SELECT o_custkey AS regulation_id, strftime(o_orderdate, '%Y.%m.%d') AS revised_at, o_orderkey, o_orderstatus FROM orders),
f AS (SELECT * FROM o WHERE o_orderstatus <> 'F' AND NOT EXISTS (SELECT 1 FROM o x WHERE x.o_orderstatus = 'F' AND x.regulation_id = o.regulation_id AND x.revised_at = o.revised_at))
SELECT regulation_id, revised_at, min(o_orderkey) AS o_orderkey FROM f GROUP BY ALL""",
    "semi_exists": "SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)",
    "orphan_check": "SELECT l_orderkey, count(*)::BIGINT AS n_lines FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey AND o_orderstatus = 'F') GROUP BY 1",
    "first_writer": "SELECT user_id, event_type, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY value, event_id) = 1",
    "last_writer": "SELECT user_id, event_type, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY value DESC, event_id DESC) = 1",
    "stage_ranks": """SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN NULL WHEN 1 THEN 9999 ELSE o_orderkey % 9 END::INT AS major, CASE o_orderkey % 5 WHEN 0 THEN NULL WHEN 1 THEN 0 ELSE o_orderkey % 4 END::INT AS minor FROM orders""",
    "committee_crosscheck": f"""WITH {_REGS}, c AS (SELECT c_custkey AS record_id, make_date(1995, (c_custkey % 12 + 1)::INT, (c_custkey % 28 + 1)::INT) AS d, c_name FROM customer),
g AS (SELECT title, count(*) AS n, min(id) AS id FROM regs WHERE live GROUP BY 1), m AS (SELECT record_id, d, CASE WHEN n = 1 THEN id END AS regulation_id FROM c LEFT JOIN g ON title = c_name)
SELECT record_id, regulation_id, CASE WHEN regulation_id IS NULL THEN 'unmatched' WHEN count(o_orderkey) > 0 THEN 'covered' ELSE 'gap' END AS status, count(o_orderkey)::INT AS n_hits
FROM m LEFT JOIN orders ON o_custkey = regulation_id AND o_orderdate::DATE BETWEEN d AND {_months("d", 9)} GROUP BY record_id, regulation_id""",
    "comparison_rows": """SELECT l_orderkey, l_linenumber::INT AS article_no, CASE WHEN l_linenumber = 2 THEN NULL ELSE 2 END::INT AS article_sub_no, CASE WHEN l_linenumber = 2 THEN l_returnflag ELSE l_linestatus END AS article_title,
  CASE WHEN l_linenumber <> 1 THEN '제' || l_linenumber || '조(' || l_returnflag || ') old text' END AS old_body, CASE WHEN l_linenumber <> 2 THEN '제' || l_linenumber || '조의2(' || l_linestatus || ') new' END AS new_body, count(*)::BIGINT AS n FROM lineitem GROUP BY ALL""",
    "full_text_filter": "SELECT conv_id, turn FROM conversations WHERE turn % 3 <> 0 AND turn % 5 <> 0 AND role <> '' AND text <> '' AND NOT contains(text, '~') AND NOT contains(role, '~')",
    "override_coalesce": """SELECT s_suppkey, CASE WHEN regexp_matches(n, '^A.*A$') THEN 'A-A' WHEN regexp_matches(n, '^NATION_1') THEN 'one' ELSE n END AS name
FROM (SELECT s_suppkey, coalesce(r_name, n_name) AS n FROM supplier JOIN nation ON s_nationkey = n_nationkey LEFT JOIN region ON r_regionkey = n_nationkey)""",
    "exclude_tuple": """SELECT l_orderkey, count(*)::BIGINT AS n, sum(l_quantity) AS quantity FROM lineitem l WHERE NOT (l_linenumber = 1 AND l_returnflag = 'N' AND l_quantity > 10 AND EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey AND o_orderpriority = '1-URGENT')) GROUP BY 1""",
    "islands": f"""WITH {_PAGES}, a AS (SELECT *, last_value(y IGNORE NULLS) OVER (PARTITION BY doc ORDER BY page_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS py FROM pg WHERE header <> ''),
b AS (SELECT *, coalesce(y IS NOT NULL AND (py IS NULL OR (y = 1 AND py <> 1)), false) AS restart FROM a),
c AS (SELECT *, sum(restart::INT) OVER (PARTITION BY doc ORDER BY page_idx) AS seg FROM b),
d AS (SELECT *, max(y) OVER (PARTITION BY doc, seg ORDER BY page_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM c),
e AS (SELECT *, sum((y IS NOT NULL AND (restart OR coalesce(y > m, false)))::INT) OVER (PARTITION BY doc ORDER BY page_idx)::BIGINT AS island FROM d)
SELECT doc, page_idx, island, first_value(y) OVER w AS index_no, {_ws("first_value(header) OVER w")} AS first_header FROM e WHERE island > 0 WINDOW w AS (PARTITION BY doc, island ORDER BY page_idx)""",
    "header_text_islands": f"""WITH {_PAGES}, a AS (SELECT *, sum((header = '')::INT) OVER (PARTITION BY doc ORDER BY page_idx) AS part FROM pg),
b AS (SELECT *, last_value(CASE WHEN y IS NOT NULL THEN {_ws("header")} END IGNORE NULLS) OVER (PARTITION BY doc, part ORDER BY page_idx) AS index_key FROM a WHERE header <> ''),
c AS (SELECT *, coalesce(lag(index_key) OVER (PARTITION BY doc, part ORDER BY page_idx) <> index_key, true) AS fresh FROM b WHERE index_key IS NOT NULL)
SELECT doc, page_idx, sum(fresh::INT) OVER (PARTITION BY doc ORDER BY page_idx)::BIGINT AS island, index_key FROM c""",
    "page_content": "SELECT user_id AS doc, event_id AS page_idx, CASE WHEN event_type = 'view' THEN NULL ELSE 2 END::INT AS line_no, 'body' AS line FROM events WHERE event_type NOT IN ('view', 'error')",
    "forward_fill": f"WITH {_STRUCTURE} SELECT doc, line_no::INT AS line_no, kind, md5(chapter) AS chapter, md5(section) AS section, md5(gwan) AS gwan FROM st WHERE NOT in_addenda",
    "running_flag_segments": f"""WITH {_STRUCTURE}, g AS (SELECT doc, seg, arg_min(kind, line_no) AS k, arg_min(struct_pack(c := chapter), line_no).c AS chapter, {_ws("string_agg(s, ' ' ORDER BY line_no)")} AS body FROM st WHERE NOT in_addenda GROUP BY ALL)
SELECT doc, (row_number() OVER (PARTITION BY doc ORDER BY seg) - 1)::INT AS ordinal, md5(chapter) AS chapter, md5(body) AS body_md5 FROM g WHERE k = 'A'""",
    "addenda_segments": f"WITH {_ADDENDA} SELECT doc, line_no::INT AS line_no, md5(s) AS line_md5, attachment::BIGINT AS attachment, is_label FROM al",
    "attachment_segments": f"""WITH {_ADDENDA} SELECT doc, (attachment - 1)::BIGINT AS ordinal, md5(arg_min(s, line_no)) AS label_md5, sum((NOT is_label)::INT)::INT AS n_lines, CASE WHEN sum((NOT is_label)::INT) > 0 THEN 1 END AS start_page,
  CASE WHEN sum((NOT is_label)::INT) > 0 THEN 1 END AS end_page FROM al WHERE attachment > 0 GROUP BY doc, attachment""",
    "merged_units": f"""WITH {_LINES}, a AS (SELECT *, {_IS("The|In")} OR coalesce(lag(contains(s, '<table') OR s = '-') OVER (PARTITION BY doc ORDER BY line_no), false) AS fresh FROM lines WHERE s <> ''),
b AS (SELECT *, sum(fresh::INT) OVER (PARTITION BY doc ORDER BY line_no)::BIGINT AS unit FROM a) SELECT doc, unit, md5(string_agg(s, ' ' ORDER BY line_no)) AS line_md5 FROM b GROUP BY ALL""",
    "block_split": f"""WITH {_LINES}, a AS (SELECT *, sum({_IS("The")}::INT) OVER (PARTITION BY doc ORDER BY line_no)::BIGINT AS block FROM lines)
SELECT doc, block, md5(max(CASE WHEN {_IS("The")} THEN s END)) AS title_md5, md5({_strip("coalesce(string_agg(CASE WHEN NOT " + _IS("The") + " THEN line END, chr(10) ORDER BY line_no), '')")}) AS content_md5 FROM a WHERE block > 0 GROUP BY ALL""",
    "toc_entries": """WITH a AS (SELECT user_id AS doc, event_id, event_type, sum((event_type = 'signup')::INT) OVER (PARTITION BY user_id ORDER BY event_id) AS g FROM events),
b AS (SELECT *, last_value(CASE WHEN event_type = 'signup' THEN 'top ' || event_id END IGNORE NULLS) OVER (PARTITION BY doc ORDER BY event_id) AS l0,
  last_value(CASE WHEN event_type = 'error' THEN 'second' END IGNORE NULLS) OVER (PARTITION BY doc, g ORDER BY event_id) AS l1 FROM a)
SELECT doc, event_id, l0, l1, '7' AS index_no, 'entry x' AS title, event_id::INT AS page_display FROM b WHERE event_type NOT IN ('signup', 'error', 'view')""",
    "display_page_map": """WITH l AS (SELECT l_suppkey AS doc, l_orderkey AS page_idx, l_linenumber AS line_no, min(' - ' || (l_partkey % 30) || ' -') AS line FROM lineitem GROUP BY ALL),
f AS (SELECT doc, page_idx, arg_min(regexp_extract(line, '(\\d+)', 1)::INT, line_no) AS page_display FROM l GROUP BY ALL) SELECT doc, page_display, min(page_idx) AS pdf_index FROM f GROUP BY ALL""".replace("\\\\", "\\"),
    "zip_join": """WITH a AS (SELECT s_nationkey AS nation, s_suppkey, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1 AS position FROM supplier), b AS (SELECT c_nationkey AS nation, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS position FROM customer)
SELECT nation, position::INT AS position, s_suppkey, c_custkey FROM a JOIN b USING (nation, position)""",
    "lead_range": 'WITH s AS (SELECT DISTINCT o_custkey AS doc, o_orderkey AS start FROM orders), e AS (SELECT doc, start, coalesce(lead(start) OVER (PARTITION BY doc ORDER BY start) - 1, 1000000000)::BIGINT AS "end" FROM s) SELECT doc, start, "end", "end" >= start AS valid FROM e',
    "outline_changes": """WITH o AS (SELECT o_custkey AS reg, o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN o_orderstatus END AS c, CASE WHEN o_orderkey % 2 = 0 THEN left(o_orderpriority, 1) END AS s FROM orders),
p AS (SELECT *, lag(c) OVER w AS pc, lag(s) OVER w AS ps FROM o WINDOW w AS (PARTITION BY reg ORDER BY o_orderkey))
SELECT reg, o_orderkey, c IS NOT NULL AND c IS DISTINCT FROM pc AS show_chapter, s IS NOT NULL AND (c IS DISTINCT FROM pc OR s IS DISTINCT FROM ps) AS show_section, false AS show_gwan FROM p""",
    "front_matter": """WITH l AS (SELECT l_orderkey, l_linenumber, min(l_shipdate) AS d FROM lineitem GROUP BY ALL), a AS (SELECT *, max((l_linenumber = 4)::INT) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS started FROM l),
f AS (SELECT *, CASE l_linenumber WHEN 1 THEN NULL WHEN 2 THEN [strftime(d, '%Y.%-m.%-d')] WHEN 3 THEN [strftime(d, '%Y.%m.%d'), strftime(d, '%Y.%-m')] ELSE ['1999.1.1'] END AS dates FROM a WHERE started = 0)
SELECT l_orderkey AS doc, CASE WHEN bool_or(l_linenumber = 1) THEN 'name of ' || l_orderkey ELSE '' END AS title, max(CASE WHEN l_linenumber = 2 THEN dates[1] END) AS enact_date,
  coalesce(string_agg(array_to_string(dates, ','), ',' ORDER BY l_linenumber), '') AS amend_dates FROM f GROUP BY l_orderkey""",
    "bigram_joined": f"WITH {_PAIRS} SELECT pair, joined FROM jp",
    "bigram_split": f"WITH {_PAIRS} SELECT pair, split FROM sp",
    "bigram_candidates": f"WITH {_PAIRS} SELECT pair, joined, split FROM sp JOIN jp USING (pair) WHERE joined >= 15 AND joined / (joined + split) >= 0.9 AND left(pair, 1) NOT IN ('x', 'q') AND pair <> 'he'",
    "spacing_fix": f"WITH {_FIXED} SELECT doc_id, length(t4) AS n, md5(t4) AS text_md5 FROM f4",
    "spacing_corrections": f"""WITH {_FIXED}, had AS ({_gaps("text", "documents")}), has AS ({_gaps("t4", "f4")}),
c AS (SELECT pair, had.n - coalesce(has.n, 0) AS n FROM had LEFT JOIN has USING (pair) JOIN cand USING (pair)) SELECT pair, n::BIGINT AS n FROM c WHERE n > 0 ORDER BY n DESC, pair LIMIT 20""",
    "word_rows": """WITH RECURSIVE w AS (SELECT l_orderkey AS doc, l_linenumber::DOUBLE AS x0, l_quantity AS y0, l_partkey::VARCHAR AS word,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity, l_linenumber, l_partkey::VARCHAR) AS k FROM lineitem),
r AS (SELECT doc, x0, y0, word, k, y0 AS anchor, 0 AS n FROM w WHERE k = 1
  UNION ALL SELECT w.doc, w.x0, w.y0, w.word, w.k, CASE WHEN abs(w.y0 - r.anchor) > 3 THEN w.y0 ELSE r.anchor END, r.n + (abs(w.y0 - r.anchor) > 3)::INT FROM r JOIN w ON w.doc = r.doc AND w.k = r.k + 1)
SELECT doc, n AS "row", string_agg(word, ' ' ORDER BY x0, y0, word) AS text, min(y0) AS y0 FROM r GROUP BY doc, n""",
    "best_match": f"""WITH a AS (SELECT item_id, {_shingles(_BARE("text"))} AS n FROM benchmark), d AS (SELECT doc_id AS tbl, floor(doc_id / 100)::BIGINT AS page, {_BARE("text")} AS t FROM documents),
s AS (SELECT item_id, page, tbl, {_containment("n", "t")} AS score FROM a CROSS JOIN d),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, page, tbl) = 1)
SELECT a.item_id AS attachment, page, tbl, round(score, 6) AS score FROM a LEFT JOIN (SELECT * FROM b WHERE score >= 0.5) b USING (item_id)""",
    "best_match_all": f"""WITH a AS (SELECT item_id, {_shingles(_BARE("text"))} AS n FROM benchmark), d AS (SELECT doc_id AS tbl, {_BARE("text")} AS t FROM documents),
s AS (SELECT item_id, tbl, {_containment("n", "t")} AS score FROM a CROSS JOIN d),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, tbl) = 1)
SELECT a.item_id AS attachment, tbl, round(score, 6) AS score FROM a LEFT JOIN (SELECT * FROM b WHERE score >= 0.5) b USING (item_id)""",
    "shingle_overlap": f"""WITH a AS (SELECT conv_id, turn, {_shingles(_BARE("text"))} AS n, {_BARE("lag(text) OVER (PARTITION BY conv_id ORDER BY turn)")} AS old FROM conversations)
SELECT conv_id, turn, round({_containment("n", "old")}, 6) AS score FROM a WHERE old IS NOT NULL""",
    "trigram_index": f"SELECT gram, count(*)::BIGINT AS n_docs FROM (SELECT unnest({_shingles('text')}) AS gram FROM documents) GROUP BY 1",
    "strip_tags": f"SELECT page_id, md5({_clean('html')}) AS text_md5 FROM pages",
    "html_items": f"SELECT page_id, (i - 1)::INT AS at, {_clean('l[i]')} AS item FROM (SELECT page_id, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT page_id, regexp_extract_all(html, '(?s)<li>(.*?)</li>', 1) AS l FROM pages))",
    "html_rows": f"""SELECT conv_id, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1)::INT AS "row", 2 AS n_cells, md5(role || '|' || {_escape("text")} || '<table><tr><td>x</td></tr></table>') AS cells_md5 FROM conversations""",
    "table_html": f"""WITH t AS (SELECT conv_id, count(*) AS n, max(length(text) - length(replace(text, chr(10), ''))) AS br,
  string_agg('<tr>' || (SELECT {_CELL} FROM (SELECT role AS x)) || (SELECT {_CELL} FROM (SELECT text AS x)) || '</tr>', '' ORDER BY turn, role, text) AS h FROM conversations GROUP BY 1)
SELECT conv_id, md5('<div class="article-table-wrap"><table class="inline-table"><tbody>' || h || '</tbody></table></div>') AS html_md5 FROM t WHERE n >= 2 AND br < 3""",
    "highlight": rf"""WITH {_TAGGED} SELECT version, regexp_replace(body, '([(\[])([^()\[\]]*?(?:개정|신설|삭제|폐지)[^()\[\]]*?)([)\]])', '<span class="amend-tag">\1\2\3</span>', 'g') AS html FROM orders_t""",
    "article_heads": f"WITH {_TAGGED} SELECT version, substring(body, length('제3조(목적)') + 1) AS rest, '목적' AS own_title FROM orders_t",
    "text_dates": f"""SELECT o_orderkey, strftime(date_trunc('month', o_orderdate), '%Y-%m-01') AS file_date, strftime(o_orderdate, '%Y.%m.%d') AS worded, strftime(o_orderdate, '%Y-%m-%d') AS parsed, strftime({_months("o_orderdate", 9)}, '%Y-%m-%d') AS later FROM orders""",
    "chronological_reorder": f"WITH {_OLD_NEW} SELECT regulation_id, amend_date, (row_number() OVER (PARTITION BY regulation_id ORDER BY amend_date) - 1)::INT AS ordinal FROM (SELECT * FROM o UNION ALL SELECT * FROM n)",
    "append_dates": f"""WITH {_OLD_NEW} SELECT regulation_id, amend_date, (row_number() OVER (PARTITION BY regulation_id ORDER BY late, amend_date) - 1)::INT AS ordinal FROM (SELECT *, 0 AS late FROM o UNION ALL SELECT *, 1 FROM n)""",
    "merge_update_append": """WITH m AS (SELECT coalesce(c.p_partkey, u.p_partkey) AS k, coalesce(upper(u.p_name), c.p_name) AS p_name, CASE WHEN u.p_size > 20 THEN 0 ELSE c.p_size END AS p_size, coalesce(c.p_type, u.p_type) AS t
  FROM (SELECT * FROM part WHERE p_type <> 'SMALL' AND p_partkey NOT IN (3, 5, 7)) c FULL JOIN (SELECT * FROM part WHERE p_type IN ('SMALL', 'ECONOMY')) u USING (p_partkey))
SELECT CASE WHEN t = 'LARGE' THEN -k ELSE k END AS p_partkey, p_name, p_size::INT AS p_size FROM m""",
    "save_revision_effect": """WITH l AS (SELECT l_partkey, min(l_suppkey) AS s FROM lineitem GROUP BY 1), p AS (SELECT * FROM part JOIN l ON p_partkey = l_partkey WHERE s = 1 AND p_partkey % 2 = 0 AND upper(p_name) <> p_name)
SELECT (SELECT max(o_orderkey) + 1 FROM orders) AS revision_id, p_size AS article_no, p_brand AS article_title, p_name AS old_body, upper(p_name) AS new_body, (row_number() OVER (ORDER BY p_partkey) - 1)::INT AS ordinal FROM p""",
    "dq_flags": r"""WITH d AS (SELECT doc_id, regexp_replace(lang, '\s+', '', 'g') AS a, text AS t FROM documents)
SELECT doc_id, doc_id NOT IN (SELECT doc_id FROM labels) AS zero_articles, regexp_matches(t, '\d') AS glued_dates, a <> '' AND NOT contains(regexp_replace(t, '\s+', '', 'g'), a) AND NOT contains(a, regexp_replace(t, '\s+', '', 'g')) AS title_mismatch FROM d""",
    "amendment_links": f"""WITH {_REVS}, m AS (SELECT regulation_id, revised_at, max(id) AS revision_id FROM revs WHERE created_at = 'F' GROUP BY ALL)
SELECT r.regulation_id, r.revised_at AS amend_date, r.id::INT AS ordinal, revision_id, revision_id IS NOT NULL AS has_revision FROM revs r LEFT JOIN m USING (regulation_id, revised_at)""",
    "page_noise": "SELECT o_orderkey, '제1조 ' || o_orderpriority || CASE WHEN EXISTS (SELECT 1 FROM region WHERE r_name = 'ASIA') THEN '  ' ELSE ' 12. ASIA  ' END || o_orderstatus AS body FROM orders",
    "markdown_tables": """WITH l AS (SELECT l_orderkey AS doc, l_linenumber AS n, min(l_returnflag) AS a, min(l_linestatus) AS b FROM lineitem GROUP BY ALL),
p AS (SELECT *, n - row_number() OVER (PARTITION BY doc ORDER BY n) AS g0 FROM l WHERE n <> 1), t AS (SELECT doc, n, a, b FROM p),
q AS (SELECT doc, min(n) AS n, string_agg('<tr><X>' || CASE WHEN n = 3 THEN '---' ELSE a END || '</X><X>' || CASE WHEN n = 3 THEN '---' ELSE '&lt;' || b || '&gt;' END || '</X></tr>', '' ORDER BY n) FILTER (true) AS h, list(n ORDER BY n) AS ns FROM t GROUP BY doc),
c AS (SELECT doc, n, string_split(h, '</tr>') AS rs, ns FROM q)
SELECT doc, n, '<table class="inline-table">' || replace(rs[1], 'X>', 'th>') || '</tr>' || array_to_string(list_transform(list_filter(list_zip(rs[2:], ns[2:]), lambda z: z[1] <> '' AND z[2] IS NOT NULL AND NOT (z[2] = 3 AND ns[2] = 3)), lambda z: replace(z[1], 'X>', 'td>') || '</tr>'), '') || '</table>' AS line FROM c
UNION ALL SELECT doc, n, 'before' FROM l WHERE n = 1""",
    "labels_of_parts": """SELECT p_partkey, '제' || p_size || '조의2 및 제3항' AS tight, CASE WHEN p_size % 3 = 0 THEN '-' WHEN p_size % 2 = 0 THEN 'p.' || p_size ELSE 'p.' || p_size || '~' || (p_size + 1) END AS pages,
  '홈 › ' || p_type || CASE WHEN p_size % 2 = 0 THEN '' ELSE ' › ' || p_brand END || ' › ' || p_name AS path, 'art-' || p_size || CASE WHEN p_size % 3 = 0 THEN '' ELSE '-' || (p_size % 3) END AS anchor,
  '<tr><td>x</td></tr><tr><td>' || p_brand || '<br>' || p_type || '</td><td>y</td></tr>' AS row FROM part""",
    "sampled_groups": f"""SELECT DISTINCT doc, island, first_header AS header FROM (WITH {_PAGES}, a AS (SELECT *, last_value(y IGNORE NULLS) OVER (PARTITION BY doc ORDER BY page_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS py FROM pg WHERE header <> ''),
b AS (SELECT *, coalesce(y IS NOT NULL AND (py IS NULL OR (y = 1 AND py <> 1)), false) AS restart FROM a),
c AS (SELECT *, sum(restart::INT) OVER (PARTITION BY doc ORDER BY page_idx) AS seg FROM b),
d AS (SELECT *, max(y) OVER (PARTITION BY doc, seg ORDER BY page_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM c),
e AS (SELECT *, sum((y IS NOT NULL AND (restart OR coalesce(y > m, false)))::INT) OVER (PARTITION BY doc ORDER BY page_idx)::BIGINT AS island FROM d)
SELECT doc, page_idx, island, first_value(y) OVER w AS index_no, {_ws("first_value(header) OVER w")} AS first_header FROM e WHERE island > 0 WINDOW w AS (PARTITION BY doc, island ORDER BY page_idx)) WHERE contains(first_header, 'purchase') OR contains(first_header, 'signup') ORDER BY doc, island LIMIT 5""",
    "owner_pages": "SELECT p_partkey AS page, min(l_suppkey) AS seq FROM part LEFT JOIN lineitem ON l_partkey = p_partkey GROUP BY 1",
    "words_in_tables": """WITH w AS (SELECT l_orderkey AS doc, l_linenumber::DOUBLE AS x0, l_quantity AS y0, count(*)::BIGINT AS n FROM lineitem GROUP BY ALL)
SELECT doc, x0, y0, n, CASE WHEN doc NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') OR y0 + 1 NOT BETWEEN -0.25 AND 30.25 THEN NULL WHEN x0 + 0.5 BETWEEN -0.25 AND 3.25 THEN 0 WHEN x0 + 0.5 BETWEEN 1.75 AND 5.25 THEN 1 END AS tbl FROM w""",
}

_CHANGES = """ch AS (SELECT l_orderkey, count(*)::INT AS n_changes, string_agg(l_linenumber || ':' || l_returnflag || ':' || l_linestatus || ':' || l_quantity::INT, ',' ORDER BY l_linenumber, l_returnflag, l_linestatus, (l_quantity::INT)::VARCHAR) AS changes FROM lineitem GROUP BY 1)"""
_RECORDS = """ar AS (SELECT l_orderkey AS o, l_linenumber, l_returnflag AS title, (l_quantity::INT)::VARCHAR AS body, nullif(l_partkey % 3, 0)::INT AS sub_no, coalesce(nullif(l_partkey % 3, 0)::VARCHAR, '') AS sub,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_returnflag, (l_quantity::INT)::VARCHAR, coalesce(nullif(l_partkey % 3, 0)::VARCHAR, '')) - 1 AS ordinal FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders))"""
ORACLES |= {
    "seed_export": f"""WITH {_CHANGES} SELECT c_custkey AS regulation_seq, strftime(o_orderdate, '%Y.%m.%d') AS revised_at, o_orderpriority AS summary, coalesce(n_changes, 0)::INT AS n_changes, coalesce(changes, '') AS changes
FROM orders JOIN customer ON c_custkey = o_custkey LEFT JOIN ch ON l_orderkey = o_orderkey""",
    "seed_import": """WITH r AS (SELECT o_custkey AS regulation_id, strftime(o_orderdate, '%Y.%m.%d') AS revised_at, o_orderpriority AS summary, o_orderstatus AS created_at FROM orders)
SELECT * FROM r WHERE created_at = 'F' UNION ALL
SELECT regulation_id, revised_at, min(summary), 'seed' FROM r WHERE regulation_id IN (SELECT c_custkey FROM customer) AND (regulation_id, revised_at) NOT IN (SELECT (regulation_id, revised_at) FROM r WHERE created_at = 'F') GROUP BY ALL""",
    "bulk_load": f"""WITH {_RECORDS}, pg AS (SELECT l_orderkey AS o, min(l_suppkey) || '-' || max(l_suppkey) AS source_pages FROM lineitem GROUP BY 1)
SELECT o AS regulation_id, o_orderpriority AS regulation_title, source_pages, ordinal::INT AS ordinal, title AS chapter, l_linenumber::INT AS "no", sub_no, title, body FROM ar JOIN pg USING (o) JOIN orders ON o_orderkey = o""",
    "detail_children": f"""WITH {_RECORDS} SELECT o AS id, strftime(any_value(o_orderdate), '%Y.%m.%d') AS amendments, string_agg(body, ',' ORDER BY ordinal) AS articles,
  coalesce(string_agg(body, ',' ORDER BY ordinal) FILTER (title = 'R'), '') AS addenda, coalesce(string_agg(body, ',' ORDER BY ordinal) FILTER (title = 'A'), '') AS attachments FROM ar JOIN orders ON o_orderkey = o GROUP BY o""",
    "snapshot_versions": """WITH k AS (SELECT c_custkey AS cust, CASE WHEN c_custkey % 2 = 0 THEN c_custkey + 1000000000 ELSE c_custkey END AS regulation_id FROM customer),
a AS (SELECT l_orderkey, l_linenumber, l_quantity::INT AS q, l_returnflag AS f FROM lineitem WHERE l_returnflag <> 'A'),
r AS (SELECT o_custkey, strftime(date_trunc('quarter', o_orderdate), '%Y.%m.%d') AS date, min(o_orderkey) AS o FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM a) GROUP BY ALL),
n AS (SELECT regulation_id, date, (l_linenumber % 3)::INT AS "no", q || f AS body, row_number() OVER (PARTITION BY o, l_linenumber % 3 ORDER BY l_linenumber DESC, q DESC, f DESC) AS rn FROM r JOIN k ON cust = o_custkey JOIN a ON l_orderkey = o)
SELECT regulation_id, date, "no", NULL::INT AS sub_no, body, 0 AS live FROM n WHERE rn = 1 UNION ALL
SELECT DISTINCT regulation_id, (SELECT max(strftime(date_trunc('quarter', o_orderdate), '%Y.%m.%d')) FROM orders), 0, NULL::INT, 'now', 1 FROM n""",
    "page_assignment": """WITH p AS (SELECT o_custkey AS doc, o_orderkey AS page, o_orderpriority = '1-URGENT' AS s FROM orders), e AS (SELECT doc, page AS start, coalesce(lead(page) OVER (PARTITION BY doc ORDER BY page) - 1, 10000)::BIGINT AS "end" FROM p WHERE s)
SELECT p.doc, page, start, "end" FROM p LEFT JOIN e ON e.doc = p.doc AND page BETWEEN start AND "end\"""",
    "trigram_postings": f"SELECT unnest({_shingles('text')}) AS gram, item_id FROM benchmark",
    "status_histogram": f"SELECT status, count(*)::BIGINT AS n FROM ({ORACLES['committee_crosscheck']}) GROUP BY 1",
}

#: Token diff by the whole table of common lengths: rows from the last old token upwards,
#: then the walk from the beginning.
_DIFF = rf"""WITH RECURSIVE p AS (SELECT conv_id, turn, lag(text) OVER (PARTITION BY conv_id, role ORDER BY turn) AS old, text AS new FROM conversations),
t AS (SELECT conv_id, turn, regexp_extract_all(old, '\S+|\s+') AS a, regexp_extract_all(new, '\S+|\s+') AS b FROM p WHERE old IS NOT NULL),
r AS (SELECT conv_id, turn, a, b, len(a) AS i, list_transform(range(len(b) + 1), lambda j: 0) AS below FROM t
  UNION ALL SELECT conv_id, turn, a, b, i - 1, list_reverse(list_reduce(list_prepend([0], list_transform(range(len(b), 0, -1), lambda j: [CASE WHEN b[j] = a[i] THEN below[j + 1] + 1 ELSE below[j] END])),
    lambda acc, x: list_append(acc, greatest(acc[-1], x[1])))) FROM r WHERE i > 0),
w AS (SELECT conv_id, turn, 0 AS i, 0 AS j, 0 AS k, ''::VARCHAR AS kind FROM t
  UNION ALL SELECT w.conv_id, w.turn, w.i + (step <> 'ins')::INT, w.j + (step <> 'del')::INT, w.k + 1, step FROM (
    SELECT w.conv_id, w.turn, w.i, w.j, w.k, CASE WHEN w.i < len(here.a) AND w.j < len(here.b) AND here.a[w.i + 1] = here.b[w.j + 1] THEN 'same' WHEN w.j = len(here.b) OR (w.i < len(here.a) AND next.below[w.j + 1] >= here.below[w.j + 2]) THEN 'del' ELSE 'ins' END AS step
    FROM w JOIN r here ON here.conv_id = w.conv_id AND here.turn = w.turn AND here.i = w.i LEFT JOIN r next ON next.conv_id = w.conv_id AND next.turn = w.turn AND next.i = w.i + 1 WHERE w.i < len(here.a) OR w.j < len(here.b)) w)
SELECT t.conv_id, t.turn, md5(coalesce(string_agg(CASE kind WHEN 'del' THEN '<span class="diff-del">' || x || '</span>' ELSE x END, '' ORDER BY k) FILTER (kind <> 'ins'), '')) AS old_md5,
  md5(coalesce(string_agg(CASE kind WHEN 'ins' THEN '<span class="diff-ins">' || y || '</span>' ELSE y END, '' ORDER BY k) FILTER (kind <> 'del'), '')) AS new_md5, count(*) FILTER (kind = 'del')::INT AS n_deleted
FROM t LEFT JOIN (SELECT w.*, replace(replace(replace(t.a[i], '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS x, replace(replace(replace(t.b[j], '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS y FROM w JOIN t USING (conv_id, turn) WHERE k > 0) s USING (conv_id, turn) GROUP BY t.conv_id, t.turn"""

ORACLES |= extraction.ORACLES
ORACLES["token_lcs_diff"] = _DIFF
