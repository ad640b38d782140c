"""The same questions in DuckDB SQL, for the queries that SQL can express."""

from __future__ import annotations

from . import urlrules
from .exactdedup import OP11_SQL
from .infill import OP12_SQL
from .merkle import OP13_SQL
from .mixing import OP9_SQL

_GOOD = "embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND vec_id IS NOT NULL"

OP3_SQL = f"""
WITH v AS (SELECT vec_id, row_number() OVER () AS row, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings WHERE {_GOOD}),
s AS (SELECT q.row, q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score FROM v q JOIN v c ON len(q.v) = len(c.v) AND q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id, score FROM s WINDOW w AS (PARTITION BY row ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= 5
"""

_ESCAPED = r"regexp_replace({}, '([<\[])(~*)(\||/s>|s>|INST\]|/INST\])', '\1~\2\3', 'g')"
OP4_SQL = f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, k, r, '</s>[INST] ok [/INST]' FROM (VALUES (0, 'user'), (1, 'assistant')) x(k, r))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(22 + length({_ESCAPED.format("role")}) + length({_ESCAPED.format("text")})) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id
"""

_REACHED = """reached AS (SELECT {id} AS id, {id} AS root FROM nodes UNION SELECT e.b, r.root FROM reached r JOIN edges e ON e.a = r.id),
lowest AS (SELECT id, min(root) AS component_id FROM reached GROUP BY id)"""

OP5_SQL = f"""
WITH RECURSIVE nodes AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings WHERE {_GOOD} AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
edges AS (SELECT p.vec_id AS a, q.vec_id AS b FROM nodes p JOIN nodes q ON len(p.v) = len(q.v) AND p.vec_id <> q.vec_id WHERE list_cosine_similarity(p.v, q.v) >= 0.95),
{_REACHED.format(id="vec_id")}
SELECT vec_id, (SELECT count(*) FROM edges WHERE a = vec_id) AS n_links, coalesce(component_id, vec_id) AS component_id, coalesce(component_id, vec_id) = vec_id AS kept
FROM embeddings LEFT JOIN lowest ON id = vec_id
"""

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"
OP8_SQL = f"""
WITH RECURSIVE words AS (SELECT doc_id, {_WORDS} AS w FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(w) >= 5 THEN list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM words),
nodes AS (SELECT doc_id, len(s) AS n FROM sets WHERE len(s) > 0),
held AS (SELECT doc_id, len(s) AS n, unnest(list_transform(s, lambda x: hash(x))) AS g FROM sets),
shared AS (SELECT * FROM held WHERE g IN (SELECT g FROM held GROUP BY g HAVING count(*) > 1)),
met AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k, any_value(x.n + y.n) AS n FROM shared x JOIN shared y ON x.g = y.g AND x.doc_id < y.doc_id AND 100 * least(x.n, y.n) >= 80 * greatest(x.n, y.n) GROUP BY ALL),
linked AS (SELECT a, b FROM met WHERE 100 * k >= 80 * (n - k)),
edges AS (SELECT a, b FROM linked UNION ALL SELECT b, a FROM linked),
{_REACHED.format(id="doc_id")}
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, CASE WHEN len(s.s) > 0 THEN coalesce(component_id, s.doc_id) ELSE s.doc_id END AS component_id FROM sets s LEFT JOIN lowest ON id = s.doc_id
"""

_SEGMENTS = r"list_transform(list_filter(string_split({text}, '{by}'), lambda x: x <> ''), lambda x: '{mark}' || CASE WHEN regexp_matches(x, '^[0-9]+(\.[a-z]+)?$') THEN '#' ELSE x END)"
_RULES = ", ".join(f"('{verdict}', '{host}', '{path}')" for verdict, host, path in urlrules.RULES)
_SUBSETS = "unnest(list_transform(range(1, CAST(pow(2, len(t)) AS BIGINT)), lambda m: list_filter(t, lambda x, i: (m >> (i - 1)) % 2 = 1)))"
OP7_SQL = f"""
WITH u AS (SELECT page_id, row_number() OVER () AS row, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host, coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
fit AS (SELECT row, arg_max(h || p, length(h || p)) AS rule, arg_max(v, length(h || p)) AS verdict FROM u JOIN (VALUES {_RULES}) r(v, h, p) ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY row),
tokens AS (SELECT u.*, rule, verdict, list_distinct(list_concat({_SEGMENTS.format(text="host", by=".", mark="h:")}, {_SEGMENTS.format(text="path", by="/", mark="p:")})) AS tokens FROM u LEFT JOIN fit USING (row)),
total AS (SELECT count(*) AS n, ceil({urlrules.MIN_SUPPORT}::DOUBLE * count(*)) AS least, coalesce(CASE WHEN count(*) FILTER (verdict = 'block') > count(*) FILTER (verdict = 'allow') THEN 'block' END, 'allow') AS usual FROM fit),
often AS (SELECT coalesce(list(x), []) AS items FROM (SELECT x FROM (SELECT unnest(tokens) AS x FROM tokens WHERE verdict IS NOT NULL) GROUP BY x HAVING count(*) >= (SELECT least FROM total))),
kept AS (SELECT row, verdict, list_sort(list_filter(tokens, lambda x: list_contains(items, x))) AS t FROM tokens, often),
subsets AS (SELECT row, verdict, {_SUBSETS} AS s FROM kept),
seen AS (SELECT s, count(*) AS n, count(*) FILTER (verdict = 'allow') AS allow, count(*) FILTER (verdict = 'block') AS block FROM subsets WHERE verdict IS NOT NULL GROUP BY s),
mined AS (SELECT s, v, k / seen.n::DOUBLE AS c, k / total.n::DOUBLE AS f FROM (SELECT s, n, unnest(['allow', 'block']) AS v, unnest([allow, block]) AS k FROM seen) seen, total WHERE k >= least AND k / seen.n::DOUBLE >= {urlrules.MIN_CONFIDENCE}::DOUBLE),
best AS (SELECT row, arg_max(v, (c, f, -len(s), v)) AS v FROM subsets JOIN mined USING (s) WHERE verdict IS NULL GROUP BY row)
SELECT page_id, host, path, rule, coalesce(verdict, v, usual) AS verdict FROM tokens LEFT JOIN best USING (row), total
"""

ORACLE = {
    "op3_topk": OP3_SQL, "op4_chat": OP4_SQL, "op5_neardup": OP5_SQL, "op7_urlrules": OP7_SQL, "op8_jaccard": OP8_SQL, "op9_mixing": OP9_SQL,
    "op11_exactdedup": OP11_SQL, "op12_infill": OP12_SQL, "op13_merkle": OP13_SQL,
}
