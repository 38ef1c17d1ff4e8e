"""The operators' queries in DuckDB SQL. None for the trained ones (1, 9), for 4, whose last document per source SQL would have to pick in
rounds, and for 6, where a plain set join over all lines is too slow; tests hold those against brute force."""

from __future__ import annotations

from .licenses import COVERAGE, DRIFT, PHRASES, TEMPLATES, K
from .sharding import lookup_table

_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _words(text: str, pattern: str) -> str:
    return f"regexp_extract_all({_LOWER.format(f'coalesce({text}, $$$$)')}, '{pattern}')"


_DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_BASE32 = f"list_reduce(list_transform(range(0, 32), lambda k: substr('{_DIGITS}', CAST(1 + ((('0x' || substr(sha1(encode(h)), CAST(1 + 5 * (k // 4) AS BIGINT), 5))::BIGINT >> (15 - 5 * (k % 4))) & 31) AS BIGINT), 1)), lambda a, b: a || b)"

WARC = f"""SELECT page_id, octet_length(encode(h))::BIGINT AS payload_bytes, {_BASE32} AS payload_digest, CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> top THEN top END AS refers_to
FROM (SELECT page_id, coalesce(html, '') AS h, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS top FROM pages)"""

TOP_K = """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS query_id, b.vec_id, list_sum(list_transform(list_zip(a.q, b.q), lambda p: p[1] * p[2]))::BIGINT AS score FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0)
SELECT * FROM (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM s) WHERE rank <= 5"""

JACCARD = f"""WITH RECURSIVE w AS (SELECT doc_id, {_words('text', r'[^\x20\x09-\x0D]+')} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 4 THEN list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
l AS (SELECT x.doc_id AS a, y.doc_id AS b FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id JOIN n p ON p.doc_id = x.doc_id JOIN n q ON q.doc_id = y.doc_id
  GROUP BY x.doc_id, y.doc_id, p.n, q.n HAVING 100 * count(*) >= 85 * (p.n + q.n - count(*))),
r(a, b) AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(w.doc_id, m.least)::BIGINT AS component_id FROM w LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT a AS doc_id, min(b) AS least FROM r GROUP BY 1) m USING (doc_id)"""


def sharding(shards: tuple[str, ...], size: int) -> str:
    table = ",".join(map(str, lookup_table(shards, size)))
    names = ",".join(f"'{s}'" for s in shards)
    return f"""WITH t AS (SELECT unnest(string_split('{table}', ',')::INTEGER[]) AS k, unnest(range(0, {size})) AS slot), n AS (SELECT unnest([{names}]) AS shard, unnest(range(0, {len(shards)})) AS k)
SELECT doc_id, d.slot, shard FROM (SELECT doc_id, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT % {size} AS slot FROM documents) d JOIN t USING (slot) JOIN n USING (k)"""


DECONTAMINATION = f"""WITH d AS (SELECT doc_id, {_words('text', _ALNUM)} AS w FROM documents), b AS (SELECT item_id::VARCHAR AS item, {_words('text', _ALNUM)} AS w FROM benchmark),
bw AS (SELECT DISTINCT item, least(10, len(w)) AS n, unnest(list_transform(range(1, len(w) - least(10, len(w)) + 2), lambda i: array_to_string(w[i:i + least(10, len(w)) - 1], ' '))) AS g FROM b WHERE len(w) > 0),
dw AS (SELECT doc_id, n, unnest(range(1, len(w) - n + 2)) AS i, unnest(list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(w[i:i + n - 1], ' '))) AS g FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n),
m AS (SELECT doc_id, i, dw.n, item FROM dw JOIN bw ON dw.g = bw.g AND dw.n = bw.n),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM m) GROUP BY 1),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM m) GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)"""

_VALUES = ", ".join("('{}', '{}')".format(a, b.replace("'", "''")) for a, b in TEMPLATES)
_BASE = " UNION ALL ".join(f"SELECT doc_id, i - 1 AS spot, '{label}' AS label FROM (SELECT doc_id, w, unnest(range(1, len(w) - {len(p.split()) - 2})) AS i FROM d WHERE list_contains(w, '{p.split()[-1]}')) WHERE w[i:i + {len(p.split()) - 1}] = {p.split()!r}" for p, label in PHRASES)
LICENSES = f"""WITH d AS (SELECT doc_id, {_words('text', _ALNUM)} AS w FROM documents), base AS ({_BASE}),
t AS (SELECT label, w, len(w) - {K - 1} AS n_grams FROM (SELECT label, {_words('body', _ALNUM)} AS w FROM (VALUES {_VALUES}) v(label, body))),
tg AS (SELECT label, n_grams, unnest(range(1, n_grams + 1)) AS place, unnest(list_transform(range(1, n_grams + 1), lambda i: array_to_string(w[i:i + {K - 1}], ' '))) AS g FROM t),
dg AS (SELECT doc_id, unnest(range(1, len(w) - {K - 2})) AS spot, unnest(list_transform(range(1, len(w) - {K - 2}), lambda i: array_to_string(w[i:i + {K - 1}], ' '))) AS g FROM d WHERE len(w) >= {K}),
v AS (SELECT doc_id, label, n_grams, spot - place AS diagonal, place FROM dg JOIN tg USING (g)),
x AS (SELECT doc_id, label, n_grams, diagonal, coalesce(diagonal - lag(diagonal) OVER (PARTITION BY doc_id, label ORDER BY diagonal) > {DRIFT}, false)::INTEGER AS fresh FROM (SELECT DISTINCT doc_id, label, n_grams, diagonal FROM v)),
y AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id, label ORDER BY diagonal) AS passage FROM x),
z AS (SELECT doc_id, label, count(DISTINCT place) / n_grams AS coverage FROM v JOIN y USING (doc_id, label, n_grams, diagonal) GROUP BY doc_id, label, n_grams, passage HAVING count(DISTINCT place) / n_grams >= {COVERAGE}),
b AS (SELECT doc_id, count(*) AS n_base, min(spot) AS first_word, max(spot) AS last_word FROM base GROUP BY 1),
bl AS (SELECT doc_id, string_agg(label, ',' ORDER BY label) AS base_labels FROM (SELECT DISTINCT doc_id, label FROM base) GROUP BY 1),
al AS (SELECT doc_id, string_agg(label, ',' ORDER BY label) AS labels FROM (SELECT doc_id, label FROM base UNION SELECT doc_id, label FROM z) GROUP BY 1),
c AS (SELECT doc_id, max(coverage) AS coverage FROM z GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(coverage, 0.0)::DOUBLE END AS score
FROM d LEFT JOIN b USING (doc_id) LEFT JOIN bl USING (doc_id) LEFT JOIN al USING (doc_id) LEFT JOIN c USING (doc_id)"""
