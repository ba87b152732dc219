"""DuckDB SQL for the queries that SQL can express, by plain and exact means."""

from __future__ import annotations

from tidemark.llm import license_scan as lic
from tidemark.llm import line_templates as lines
from tidemark.llm import secrets
from tidemark.llm.neardup import SHINGLE_WORDS, SIMILAR

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_WORDY = "list_filter({}, lambda x: regexp_matches(x, '\\pL'))"
LINE_DEDUP = f"""
WITH t AS (SELECT DISTINCT doc_id, coalesce(text, '') AS text FROM documents),
u AS (SELECT doc_id, text, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM t),
s AS (SELECT *, trim(line, ' ') AS raw, list_transform(string_split(trim(line, ' '), ' '), lambda x: CASE WHEN regexp_matches(x, '[0-9]') THEN '<*>' ELSE x END) AS tokens FROM u),
l AS (SELECT *, raw <> '' AS real, array_to_string(tokens, ' ') AS masked, contains(array_to_string(tokens, ' '), '<*>') AND len({_WORDY.format("tokens")}) < {lines.WORDS} AS alone FROM s),
h AS (SELECT tokens, masked, text, [CAST(len(tokens) AS VARCHAR)] || tokens[1:{lines.LEADING}] AS leaf FROM l WHERE real AND NOT alone GROUP BY ALL),
w AS (SELECT leaf, tokens, masked, count(*) AS texts FROM h GROUP BY ALL),
f AS (SELECT leaf FROM w GROUP BY leaf HAVING count(*) > 1 AND sum(texts) >= {lines.MIN_DOCUMENTS}),
v AS (SELECT leaf, masked, tokens, len(tokens) - {lines.LEADING} - greatest(1, len(tokens) // {lines.VARIABLE_SHARE}) AS n_kept FROM w JOIN f USING (leaf)),
p AS (SELECT leaf, masked, n_kept, unnest(tokens) AS token, unnest(range(len(tokens))) AS place FROM v WHERE n_kept >= {lines.WORDS}),
q AS (SELECT *, count(*) OVER (PARTITION BY leaf, place, token) AS have FROM p WHERE place >= {lines.LEADING}),
r AS (SELECT *, row_number() OVER (PARTITION BY leaf, masked ORDER BY have DESC, place) AS rn FROM q),
c AS (SELECT leaf, masked, list(token) AS words, string_agg(place || ' ' || token, ' ' ORDER BY place) AS constant FROM r WHERE rn <= n_kept GROUP BY ALL),
m AS (SELECT masked, 'leaf ' || array_to_string(leaf, ' ') || ': ' || constant AS template FROM c WHERE len({_WORDY.format("words")}) >= {lines.WORDS}),
k AS (SELECT l.doc_id, l.text, l.pos, CASE WHEN l.alone THEN 'alone ' || raw ELSE coalesce(m.template, 'own ' || l.masked) END AS template FROM l LEFT JOIN m ON m.masked = l.masked AND NOT l.alone WHERE real
      UNION ALL SELECT doc_id, text, pos, 'words ' || raw FROM l WHERE real AND len(tokens) >= {lines.LONG}),
g AS (SELECT template, min((doc_id, pos)) AS first FROM k GROUP BY template HAVING count(DISTINCT text) >= CASE WHEN template LIKE 'words %' THEN {lines.MIN_LONG} ELSE {lines.MIN_DOCUMENTS} END),
x AS (SELECT DISTINCT doc_id, text, pos FROM k JOIN g USING (template) WHERE (doc_id, pos) <> first),
o AS (SELECT l.doc_id, l.text, string_agg(line, chr(10) ORDER BY pos) FILTER (x.pos IS NULL) AS kept, CAST(count(*) AS INT) AS n_lines, CAST(count(x.pos) AS INT) AS n_dropped FROM l LEFT JOIN x USING (doc_id, text, pos) GROUP BY ALL)
SELECT d.doc_id, CASE WHEN n_dropped = 0 THEN d.text ELSE coalesce(kept, '') END AS text, n_lines, n_dropped FROM documents d JOIN o ON d.doc_id = o.doc_id AND coalesce(d.text, '') = o.text
"""

NEAR_DUPLICATES = f"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS rid, doc_id, list_filter(string_split_regex({_LOWER}, '[\\x09-\\x0D\\x20]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT rid, doc_id, list_distinct([array_to_string(w[i:i + {SHINGLE_WORDS - 1}], ' ') FOR i IN range(1, greatest(len(w) - {SHINGLE_WORDS - 1}, 1) + 1)]) AS shingles FROM d WHERE len(w) > 0),
x AS (SELECT rid, unnest(shingles) AS g FROM s),
c AS (SELECT a.rid AS r1, b.rid AS r2, count(*) AS shared FROM x a JOIN x b USING (g) WHERE a.rid < b.rid GROUP BY ALL),
e AS (SELECT a.doc_id AS u, b.doc_id AS v FROM c JOIN s a ON a.rid = r1 JOIN s b ON b.rid = r2 WHERE {SIMILAR[1]} * shared >= {SIMILAR[0]} * (len(a.shingles) + len(b.shingles) - shared)),
sym AS (SELECT u, v FROM e UNION SELECT v, u FROM e),
reach(u, v) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.u, sym.v FROM reach r JOIN sym ON sym.u = r.v),
m AS (SELECT u AS doc_id, min(v) AS component_id FROM reach GROUP BY u)
SELECT d.doc_id, coalesce(len(shingles), 0) AS n_shingles, component_id, d.doc_id = component_id AS kept FROM d LEFT JOIN s USING (rid) JOIN m ON m.doc_id = d.doc_id
"""


def _literal(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _at(phrase: str) -> str:
    parts = " AND ".join(f"w[i + {k}] = '{x}'" for k, x in enumerate(phrase.split()))
    return f"list_filter(range(1, len(w) + 1), lambda i: {parts})"


_K = lic.K
_WORDS = f"list_filter(string_split_regex({_LOWER}, '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')"
_NOTICES = ", ".join(f"({i}, {_literal(label)}, {_literal(notice)})" for i, (label, notice) in enumerate(lic.TEMPLATES))
LICENSES = f"""
WITH d AS (SELECT row_number() OVER () AS uid, doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT *, {", ".join(f"{_at(phrase)} AS {label}" for phrase, label in lic.BASE)} FROM d),
base AS (SELECT *, {" || ".join(label for _, label in lic.BASE)} AS places, list_sort(list_filter([{", ".join(f"CASE WHEN len({label}) > 0 THEN '{label}' END" for _, label in lic.BASE)}], lambda x: x IS NOT NULL)) AS bl FROM b),
n AS (SELECT template, label, {_WORDS} AS w FROM (VALUES {_NOTICES}) q(template, label, text)),
ng AS (SELECT template, label, len(w) AS size, w[i:i + {_K - 1}] AS g, i - 1 AS template_at FROM (SELECT *, unnest(range(1, len(w) - {_K - 2})) AS i FROM n)),
dg AS (SELECT uid, w[i:i + {_K - 1}] AS g, i - 1 AS place FROM (SELECT *, unnest(range(1, greatest(len(w) - {_K - 2}, 1))) AS i FROM d)),
h AS (SELECT uid, template, label, size, place, template_at, place - template_at AS diagonal FROM dg JOIN ng USING (g)),
v AS (SELECT uid, template, label, size, diagonal, min(place) AS low, max(place) + {_K - 1} AS high, list(DISTINCT template_at) AS votes FROM h GROUP BY ALL),
c AS (SELECT *, CASE WHEN abs(diagonal - lag(diagonal) OVER o) > least({lic.MERGE_SHIFT}, size - 1) OR low - lag(high) OVER o > {lic.MERGE_GAP} THEN 1 ELSE 0 END AS parted FROM v WINDOW o AS (PARTITION BY uid, template ORDER BY low, diagonal)),
e AS (SELECT *, sum(parted) OVER (PARTITION BY uid, template ORDER BY low, diagonal) AS span FROM c),
s AS (SELECT uid, template, label, size, span, min(low) AS first, max(high) AS last, flatten(list(votes)) AS votes FROM e GROUP BY ALL),
k AS (SELECT *, len(list_distinct(flatten(list_transform(votes, lambda x: range(x, x + {_K}))))) / size AS covered FROM s),
f AS (SELECT uid, list(DISTINCT label) AS found, max(covered) AS covered, count(*) AS n_spans FROM k WHERE covered >= {lic.MIN_COVERED} AND last - first + 1 <= size * {lic.MAX_STRETCH} GROUP BY uid)
SELECT doc_id, len(w) AS n_words, len(places) AS n_base, list_min(places) - 1 AS first_word, list_max(places) - 1 AS last_word, array_to_string(bl, ',') AS base_labels,
       array_to_string(list_sort(list_distinct(bl || coalesce(found, []))), ',') AS labels, CAST(greatest(coalesce(covered, 0), CASE WHEN len(places) > 0 THEN 1 ELSE 0 END) AS DOUBLE) AS score, coalesce(n_spans, 0) AS n_spans
FROM base LEFT JOIN f USING (uid)
"""

SQL = {"op1_secrets": secrets.SQL, "op2_line_dedup": LINE_DEDUP, "op7_near_duplicates": NEAR_DUPLICATES, "op9_license_scan": LICENSES}
