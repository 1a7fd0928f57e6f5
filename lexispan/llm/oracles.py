"""DuckDB SQL for the corpus queries that SQL can express."""

from __future__ import annotations

import re

from lexispan.llm.license_scan import BASE_PHRASES, TEMPLATES, WORD_RE, each_template, fold, tokens

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _template_regex(template: str) -> str:
    """The template over words that each end with one space."""
    out, at = "", 0
    for m in [*re.finditer(r"<<(.*?)>>", template), None]:
        out += "".join(f"{re.escape(w)} " for w in tokens(template[at : m.start() if m else len(template)]))
        if m is None:
            return out
        at = m.end()
        kind = m[1].split(";")[0]
        low, high = re.search(r"match=(\d+)-(\d+)", m[1]).groups() if kind == "var" else ("", "")
        out += {"beginOptional": "(?:", "endOptional": ")?", "var": f"(?:[^ ]+ ){{{low},{high}}}"}[kind]


def _op1() -> str:
    phrase = []
    for p, label in BASE_PHRASES.items():
        w = fold(p).split(" ")
        test = " AND ".join(f"w[i + {k + 1}] = '{x}'" for k, x in enumerate(w))
        phrase.append((f"list_filter(range(greatest(len(w) - {len(w) - 1}, 0)), lambda i: {test})", label))
    base = ", ".join(f"CASE WHEN len(p{k}) > 0 THEN '{label}' END" for k, (_, label) in enumerate(phrase))
    more = ", ".join(f"CASE WHEN regexp_matches(line, '(^| ){_template_regex(t)}') THEN '{label}' END" for label, t in each_template(TEMPLATES))
    joined = lambda x: f"array_to_string(list_sort(list_distinct(list_filter([{x}], lambda l: l IS NOT NULL))), ',')"
    return f"""
WITH a AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{WORD_RE}') AS w FROM documents),
b AS (SELECT doc_id, w, array_to_string(w, ' ') || ' ' AS line, {", ".join(f"{x} AS p{k}" for k, (x, _) in enumerate(phrase))} FROM a),
c AS (SELECT doc_id, len(w)::BIGINT AS n_words, list_concat({", ".join(f"p{k}" for k in range(len(phrase)))}) AS p,
  {joined(base)} AS base_labels, {joined(base + ", " + more)} AS labels FROM b)
SELECT doc_id, n_words, len(p)::BIGINT AS n_base, list_min(p)::BIGINT AS first_word, list_max(p)::BIGINT AS last_word, base_labels, labels,
  CASE WHEN labels = '' THEN 0.0 ELSE 1 - pow(0.5, len(string_split(labels, ','))) END::DOUBLE AS score FROM c"""


_OP5 = r"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256, length(coalesce(text, '')) AS n FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, (count(*) OVER (PARTITION BY text_sha256))::BIGINT AS group_size,
  doc_id = first_value(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256 ORDER BY n DESC, doc_id)"""

_OP2 = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
n AS (SELECT sum(len(w)) AS total FROM d),
t AS (SELECT doc_id, len(w) AS m, i, w[i] AS a, w[i - 1] || ' ' || w[i] AS b, w[i - 2] || ' ' || w[i - 1] || ' ' || w[i] AS c
  FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d)),
k AS (SELECT doc_id, m, i,
  count(*) OVER (PARTITION BY a) - count(*) OVER (PARTITION BY a, doc_id) AS c1,
  CASE WHEN i > 1 THEN count(*) OVER (PARTITION BY b) - count(*) OVER (PARTITION BY b, doc_id) END AS c2,
  CASE WHEN i > 2 THEN count(*) OVER (PARTITION BY c) - count(*) OVER (PARTITION BY c, doc_id) END AS c3 FROM t),
l AS (SELECT *, lag(c1) OVER o AS p1, lag(c2) OVER o AS p2 FROM k WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
s AS (SELECT doc_id,
  CASE WHEN c3 > 0 THEN ln(c3 / p2)
       WHEN c2 > 0 THEN ln(c2 / p1) + (i > 2)::INT * ln(0.4)
       WHEN c1 > 0 THEN ln(c1 / (total - m)) + least(i - 1, 2) * ln(0.4)
       ELSE ln(1 / (total - m + 1)) + least(i - 1, 2) * ln(0.4) END AS v,
  NOT (coalesce(c3, 0) > 0 OR (i = 2 AND c2 > 0) OR i = 1) AS backed FROM l, n)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(x.b, 0)::BIGINT AS n_backed_off, round(coalesce(x.v, 0), 4) AS logscore, round(x.v / len(d.w), 7) AS mean_logscore
FROM d LEFT JOIN (SELECT doc_id, sum(backed::INT) AS b, sum(v) AS v FROM s GROUP BY doc_id) x USING (doc_id)"""

_OP9 = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT doc_id, i, array_to_string(w[i : i + 12], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d)),
hit AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY g) AS least FROM p) WHERE least < doc_id),
gone AS (SELECT DISTINCT doc_id, i + k AS i FROM hit, range(13) r(k)),
words AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS word FROM d),
kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY i) AS t FROM words ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, (len(d.w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)"""

_OP3 = """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) > 0
  AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS u, b.vec_id AS w FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.9),
reach AS (SELECT vec_id AS u, vec_id AS w FROM embeddings UNION SELECT reach.u, l.w FROM reach JOIN l ON l.u = reach.w),
c AS (SELECT u AS vec_id, min(w) AS component_id FROM reach GROUP BY u)
SELECT vec_id, (SELECT count(*) FROM l WHERE l.u = c.vec_id)::BIGINT AS n_links, component_id, vec_id = component_id AS kept FROM c"""

_OP12 = f"""
WITH RECURSIVE crc AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda a, _: CASE WHEN a % 2 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)) AS t),
runs AS (SELECT doc_id, run, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[a-z\u00C0-\u00FF]+')) AS run FROM documents)
  WHERE length(run) >= 7 GROUP BY ALL),
summed AS (SELECT run, n, xor(list_reduce(list_prepend(4294967295, list_transform(range(length(x) // 2), lambda i: ('0x' || substr(x, 2 * i + 1, 2))::BIGINT)),
  lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS h FROM (SELECT run, n, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || run)) AS x FROM runs), crc),
words AS (SELECT word, sum(n)::BIGINT AS n FROM (SELECT n, CASE WHEN h % 31 = 0 THEN run[: h % length(run)] || run[h % length(run) + 2 :] ELSE run END AS word FROM summed) WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
holes AS (SELECT word, n, length(word) AS m, k, word[: k] || word[k + 2 :] AS rest FROM (SELECT word, n, unnest(range(length(word))) AS k FROM words)),
pairs AS (SELECT DISTINCT a.word, b.word AS other, b.n FROM holes a JOIN holes b ON a.m = b.m AND a.k = b.k AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT h.word, w.word, w.n FROM holes h JOIN words w ON w.word = h.rest UNION SELECT w.word, h.word, h.n FROM holes h JOIN words w ON w.word = h.rest),
best AS (SELECT word, count(*) AS n_near, first(other ORDER BY n DESC, other) AS other, max(n) AS form_n FROM pairs GROUP BY word),
f AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN form_n >= 10 * w.n THEN other END AS form, CASE WHEN form_n >= 10 * w.n THEN form_n END AS form_n FROM words w LEFT JOIN best USING (word)),
chain AS (SELECT word, word AS root, 0 AS far FROM f UNION ALL SELECT c.word, f.form, far + 1 FROM chain c JOIN f ON f.word = c.root WHERE f.form IS NOT NULL)
SELECT f.word, form, last.root, n, n_near::BIGINT AS n_near, form_n FROM f JOIN (SELECT word, arg_max(root, far) AS root FROM chain GROUP BY word) last USING (word)"""

_TERM = "[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"
_OP13 = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{_TERM}') AS t FROM documents),
s AS (SELECT count(*) FILTER (len(t) > 0) AS N, sum(len(t))::BIGINT AS L FROM d),
b AS (SELECT row_number() OVER () AS b, item_id, list_distinct(regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{_TERM}')) AS t FROM benchmark),
p AS (SELECT b, item_id, unnest(t) AS term FROM b),
tf AS (SELECT r, doc_id, long, term, count(*) AS tf FROM (SELECT r, doc_id, len(t)::BIGINT AS long, unnest(t) AS term FROM d) SEMI JOIN p USING (term) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * N + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM tf, s GROUP BY term, N),
scores AS (SELECT b, item_id, r, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + ((90 * long * N) // L)))))::BIGINT AS score
  FROM tf JOIN w USING (term) JOIN p USING (term), s GROUP BY ALL)
SELECT item_id, row_number() OVER (PARTITION BY b ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score FROM scores WHERE score > 0
QUALIFY rank <= 10"""

ORACLES = {"op1_license_scan": _op1(), "op2_lm_scoring": _OP2, "op3_embedding_dedup": _OP3, "op5_exact_dedup": _OP5, "op9_substring_dedup": _OP9, "op12_spelling_variants": _OP12, "op13_lexical_search": _OP13}
