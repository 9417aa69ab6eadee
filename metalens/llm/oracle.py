"""DuckDB SQL with the same rows as the registered queries, where SQL can express them."""

from __future__ import annotations

#: Words [^\x20\x09-\x0D]+ of each document's text; one row a document.
_WORDS = r"""
docs AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
split AS (SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM docs)"""

OP2 = f"""
WITH {_WORDS},
windows AS (
  SELECT doc_id, i AS pos, array_to_string(w[i:i + 19], ' ') AS win
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM split)),
again AS (
  SELECT doc_id, pos FROM (SELECT doc_id, pos, row_number() OVER (PARTITION BY win ORDER BY doc_id, pos) AS nth FROM windows)
  WHERE nth > 1),
gone AS (SELECT DISTINCT doc_id, p FROM (SELECT doc_id, unnest(range(pos, pos + 20)) AS p FROM again)),
lost AS (SELECT doc_id, list(p) AS ps FROM gone GROUP BY doc_id)
SELECT s.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(ps), 0) AS BIGINT) AS n_removed,
       sha256(array_to_string(list_filter(w, lambda x, i: ps IS NULL OR NOT list_contains(ps, i)), ' ')) AS kept_sha256
FROM split s LEFT JOIN lost USING (doc_id)
"""

#: Rules of one or two tokens are counted directly; FP-growth must find the same.
OP4 = r"""
WITH cut AS (SELECT page_id, url, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
page AS (
  SELECT page_id, url, coalesce(rest, '') AS rest,
         translate(regexp_extract(coalesce(rest, ''), '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
parts AS (SELECT page_id, url, host, path, rest, string_split(host, '.') AS labels FROM page),
tokens AS (
  SELECT page_id, url, path, CASE WHEN host = '' THEN [] ELSE list_distinct(
    list_transform(range(1, len(labels) + 1), lambda i: 'host=' || array_to_string(labels[i:], '.'))
    || list_transform(regexp_extract_all(host, '[^.\-]+'), lambda x: 'word=' || x)
    || list_transform(regexp_extract_all(path, '/([^/]+)', 1), lambda x: 'path=' || regexp_replace(x, '[0-9]+', '0', 'g'))
    || list_transform(regexp_extract_all(regexp_extract(rest, '^[^?#]*\?([^#]*)', 1), '(?:^|&)([^=&]+)', 1), lambda x: 'key=' || x)
    || list_filter(['type=' || regexp_extract(path, '\.([A-Za-z0-9]+)$', 1)], lambda x: x <> 'type=')
    || list_filter(['scheme=' || lower(regexp_extract(url, '^([A-Za-z]+)://', 1))], lambda x: x <> 'scheme=')) END AS ts
  FROM parts),
known AS (SELECT doc_id, coalesce(bool_or(quality = 0 OR toxic = 1), false) AS bad FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
labelled AS (
  SELECT t.page_id, ts, bad FROM tokens t
  JOIN known k ON k.doc_id = TRY_CAST(regexp_extract(path, '/([0-9]{1,18})(?:[/.]|$)', 1) AS BIGINT)),
size AS (SELECT count(*) AS n, greatest(ceil(greatest(0.002, 10.0 / count(*)) * count(*)), 1) AS least FROM labelled HAVING count(*) >= 10),
one AS (SELECT page_id, bad, unnest(ts) AS t FROM labelled),
sets AS (
  SELECT t AS a, t AS b, count(*) AS n, count(*) FILTER (WHERE bad) AS n_bad FROM one GROUP BY t
  UNION ALL
  SELECT x.t, y.t, count(*), count(*) FILTER (WHERE x.bad) FROM one x JOIN one y ON x.page_id = y.page_id AND x.t < y.t GROUP BY ALL),
rules AS (SELECT a, b FROM sets, size WHERE n_bad >= least AND n_bad >= 0.8 * sets.n),
blocked AS (SELECT DISTINCT page_id FROM tokens, rules WHERE list_contains(ts, a) AND list_contains(ts, b)),
given AS (
  SELECT page_id, max_by(rule, len(rule)) AS rule, max_by(verdict, len(rule)) AS verdict
  FROM page JOIN (VALUES ('net', '/', 'net/', 'block'), ('example.net', '/en/', 'example.net/en/', 'allow'),
                         ('example.com', '/de/', 'example.com/de/', 'block'), ('org', '/fr/', 'org/fr/', 'allow')) r(h, p, rule, verdict)
    ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
  GROUP BY page_id)
SELECT p.page_id, host, path, rule, coalesce(verdict, CASE WHEN b.page_id IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict
FROM page p LEFT JOIN given USING (page_id) LEFT JOIN blocked b USING (page_id)
"""

OP5 = rf"""
WITH {_WORDS},
lines AS (
  SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM docs)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
windows AS (
  SELECT doc_id, i AS pos, array_to_string(w[i:i + 7], ' ') AS win
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM split)),
twice AS (SELECT doc_id, pos FROM (SELECT doc_id, pos, count(*) OVER (PARTITION BY doc_id, win) AS c FROM windows) WHERE c > 1),
repeats AS (
  SELECT doc_id, count(DISTINCT p) AS n_repeat_words
  FROM (SELECT doc_id, unnest(range(pos, pos + 8)) AS p FROM twice) GROUP BY doc_id),
stats AS (
  SELECT s.doc_id, CAST(len(w) AS BIGINT) AS n_words,
         CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
         CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
         CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words,
         len(list_filter(w, lambda x: regexp_matches(x, '\p{{Lu}}') AND NOT regexp_matches(x, '\p{{Ll}}'))) AS n_upper,
         len(list_filter(w, lambda x, i: i > 1 AND x = w[i - 1])) AS n_echo
  FROM split s LEFT JOIN lines USING (doc_id) LEFT JOIN repeats USING (doc_id)),
judged AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM stats)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR word_chars < 3 * n_words OR word_chars > 10 * n_words OR 10 * n_symbols > n_words
            OR 2 * n_dup_lines > n_lines OR 2 * n_upper > n_words OR 10 * n_echo > 3 * n_words) AS kept
FROM judged
"""


def _normal_words(table: str, key: str) -> str:
    lower = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return rf"SELECT {key}, regexp_extract_all({lower}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM {table}"


OP8 = f"""
WITH split AS ({_normal_words('documents', 'doc_id')}),
items AS ({_normal_words('benchmark', 'item_id')} WHERE item_id IS NOT NULL),
known AS (
  SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS win
  FROM (SELECT item_id, w, least(10, len(w)) AS n, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM items WHERE len(w) > 0)),
widths AS (SELECT DISTINCT n FROM known),
windows AS (
  SELECT doc_id, n, i AS pos, array_to_string(w[i:i + n - 1], ' ') AS win
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM split CROSS JOIN widths)),
hits AS (SELECT doc_id, pos, windows.n, item_id FROM windows JOIN known ON windows.win = known.win AND windows.n = known.n),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(pos, pos + n)) AS p FROM hits) GROUP BY doc_id),
found AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id)
SELECT s.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM split s LEFT JOIN covered USING (doc_id) LEFT JOIN found USING (doc_id)
"""

OP9 = """
WITH page AS (
  SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
first AS (SELECT payload_digest, min(page_id) AS first FROM page WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT page_id, payload_bytes, p.payload_digest, CASE WHEN first IS NOT NULL AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM page p LEFT JOIN first f USING (payload_digest)
"""

#: crc32 is spelled out bit by bit; its last bit, inverted at the end, says which rows are touched.
OP11 = """
WITH RECURSIVE fields AS (
  SELECT *, list_reduce([4294967295] || list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT)),
                        lambda c, b: list_reduce([xor(c, b)] || range(8), lambda y, k: xor(y >> 1, (y & 1) * 3988292384))) & 1 = 1 AS touched,
         coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
         || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') AS head
  FROM documents),
texts AS (SELECT *, CASE WHEN touched THEN replace(text, chr(10), '') ELSE text END AS other FROM fields),
leaves AS (
  SELECT doc_id, source, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf, sha256(head || coalesce(strlen(other) || ':' || other, '-')) AS now,
         row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS idx, count(*) OVER (PARTITION BY source) AS n FROM texts),
low AS (
  SELECT 0 AS level, source, idx, n, leaf AS digest FROM leaves
  UNION ALL
  SELECT level + 1, source, idx // 3, (n + 2) // 3, sha256(string_agg(digest, '' ORDER BY idx)) FROM low WHERE n > 1 GROUP BY level, source, idx // 3, n),
subroots AS (SELECT source, level AS depth, digest, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS idx, count(*) OVER () AS n FROM low WHERE n = 1),
high AS (
  SELECT 0 AS level, idx, n, digest FROM subroots
  UNION ALL
  SELECT level + 1, idx // 3, (n + 2) // 3, sha256(string_agg(digest, '' ORDER BY idx)) FROM high WHERE n > 1 GROUP BY level, idx // 3, n),
runs AS (
  SELECT coalesce(source, '') AS s, source IS NULL AS missing, level, idx // 3 AS run, list(digest ORDER BY idx) AS kids FROM low WHERE n > 1 GROUP BY source, level, idx // 3
  UNION ALL
  SELECT coalesce(source, ''), source IS NULL, depth + h.level, x.run, kids
  FROM subroots b, (SELECT level, idx // 3 AS run, list(digest ORDER BY idx) AS kids FROM high WHERE n > 1 GROUP BY level, idx // 3) h
  JOIN (SELECT idx AS leaf, level, idx // CAST(power(3, level + 1) AS BIGINT) AS run FROM (SELECT idx FROM subroots) t(idx), (SELECT DISTINCT level FROM high WHERE n > 1) l) x
    ON h.level = x.level AND h.run = x.run
  WHERE x.leaf = b.idx),
fold AS (
  SELECT doc_id, coalesce(l.source, '') AS s, l.source IS NULL AS missing, 0 AS level, l.idx, b.depth, b.idx AS place, now AS x, '' AS proof
  FROM leaves l JOIN subroots b ON l.source IS NOT DISTINCT FROM b.source
  UNION ALL
  SELECT doc_id, f.s, f.missing, f.level + 1, CASE WHEN f.level + 1 = depth THEN place ELSE f.idx // 3 END, depth, place,
         sha256(array_to_string(list_transform(kids, lambda d, i: CASE WHEN i = f.idx % 3 + 1 THEN x ELSE d END), '')),
         proof || array_to_string(list_filter(kids, lambda d, i: i <> f.idx % 3 + 1), '')
  FROM (SELECT * REPLACE (CASE WHEN level = 0 AND depth = 0 THEN place ELSE idx END AS idx) FROM fold) f
  JOIN runs r ON r.s = f.s AND r.missing = f.missing AND r.level = f.level AND r.run = f.idx // 3),
ends AS (SELECT doc_id, max_by(x, level) AS folded_root, sha256(max_by(proof, level)) AS proof_sha256 FROM fold GROUP BY doc_id)
SELECT l.doc_id, leaf, b.digest AS subroot, r.digest AS root, proof_sha256, folded_root, folded_root = r.digest AS verified
FROM leaves l JOIN subroots b ON l.source IS NOT DISTINCT FROM b.source JOIN ends USING (doc_id), (SELECT digest FROM high WHERE n = 1) r
"""

def _lloyd(rounds: int = 5, k: int = 40, seed: int = 2) -> str:
    """Clustering by measuring every distance; 64 * distance + number orders centroids by distance, then number."""
    steps = []
    for r in range(rounds + 1):
        steps.append(f"""
near{r} AS MATERIALIZED (
  SELECT vec_id, min(64 * d + c) AS best
  FROM (SELECT vec_id, c, sum((x.v - m.v) * (x.v - m.v)) AS d FROM x JOIN m{r} m USING (p) GROUP BY vec_id, c) GROUP BY vec_id)""")
        if r < rounds:
            steps.append(f"""
m{r + 1} AS MATERIALIZED (
  SELECT m.c, m.p, coalesce((s - ((s % n) + n) % n) // n, m.v) AS v
  FROM m{r} m LEFT JOIN (SELECT best % 64 AS c, p, sum(v) AS s, count(*) AS n FROM near{r} JOIN x USING (vec_id) GROUP BY best % 64, p) USING (c, p))""")
    return f"""
WITH kept AS MATERIALIZED (
  SELECT vec_id, list_transform(embedding, lambda e: CAST(floor(256 * CAST(e AS DOUBLE)) AS BIGINT)) AS vs FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = 64),
x AS MATERIALIZED (SELECT vec_id, unnest(vs) AS v, generate_subscripts(vs, 1) AS p FROM kept),
first AS (SELECT row_number() OVER (ORDER BY sha256('{seed}:' || vec_id)) - 1 AS c, vs FROM kept ORDER BY sha256('{seed}:' || vec_id) LIMIT {k}),
m0 AS MATERIALIZED (SELECT c, unnest(vs) AS v, generate_subscripts(vs, 1) AS p FROM first),{",".join(steps)},
own AS (SELECT vec_id, CAST(best % 64 AS INTEGER) AS cluster, CAST(best // 64 AS BIGINT) AS distance FROM near{rounds}),
names AS (SELECT CAST(c AS INTEGER) AS cluster, sha256(string_agg(CAST(v AS VARCHAR), ',' ORDER BY p)) AS centroid_sha256 FROM m{rounds} GROUP BY c)
SELECT vec_id, cluster, distance, CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia,
       CAST(sum(distance) OVER () AS BIGINT) AS inertia, centroid_sha256
FROM own JOIN names USING (cluster)
"""


ORACLE = {"op2_substring": OP2, "op4_url_filter": OP4, "op5_quality_rules": OP5, "op8_decontaminate": OP8, "op9_warc": OP9,
          "op11_merkle": OP11, "op13_centroids": _lloyd()}
