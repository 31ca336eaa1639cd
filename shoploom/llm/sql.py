"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from .mixing import BLOCK_ROWS, SHARES

_MIX = f"""
WITH RECURSIVE keyed AS (
  SELECT doc_id, source, coalesce(source, '') AS src,
         ('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 15))::BIGINT AS h
  FROM documents),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY src ORDER BY h, doc_id) - 1 AS rank FROM keyed),
roots AS (SELECT src, greatest(1, CAST(floor(sqrt(count(*))) AS BIGINT)) AS root FROM keyed GROUP BY src),
weights AS (
  SELECT src, greatest(1, CAST(({2 * SHARES} * root + sum(root) OVER ()) // (2 * sum(root) OVER ()) AS BIGINT)) AS w FROM roots),
shape AS (
  SELECT list(src ORDER BY src) AS srcs, list(w // g ORDER BY src) AS cs, CAST(sum(w // g) AS BIGINT) AS slots
  FROM weights, (SELECT list_reduce(list(w), lambda a, b: gcd(a, b)) AS g FROM weights) HAVING count(*) > 0),
edf AS (
  SELECT srcs, cs, slots, CAST(0 AS BIGINT) AS t, list_transform(cs, lambda c: CAST(0 AS BIGINT)) AS done, CAST(NULL AS BIGINT) AS pick FROM shape
  UNION ALL
  SELECT srcs, cs, slots, t + 1, list_transform(done, lambda d, i: CASE WHEN i = p THEN d + 1 ELSE d END), p
  FROM (SELECT *, list_min(list_filter(list_transform(cs, lambda c, i: CASE
            WHEN done[i] < c AND floor(done[i]::HUGEINT * slots // c) <= t
            THEN (((done[i] + 1) * slots + c - 1) // c) * 1000000 + i END), lambda x: x IS NOT NULL)) % 1000000 AS p
        FROM edf WHERE t < slots)),
placed AS (
  SELECT srcs[pick] AS src, cs[pick] AS turns, slots, t - 1 AS place, row_number() OVER (PARTITION BY pick ORDER BY t) - 1 AS turn FROM edf WHERE pick IS NOT NULL),
blocks AS (SELECT *, rank // {BLOCK_ROWS} AS block FROM ranked)
SELECT doc_id, source, block, block // turns * slots + place AS slot, (block // turns * slots + place) * {BLOCK_ROWS} + rank % {BLOCK_ROWS} AS position
FROM blocks b JOIN placed p ON b.src = p.src AND b.block % p.turns = p.turn
"""

_URLS = r"""
WITH RECURSIVE cut AS (
  SELECT *, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) END AS rest FROM pages),
named AS (
  SELECT *, coalesce(translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path,
         regexp_extract(rest, '^[^?#]*\?([^#]*)', 1) AS query
  FROM cut),
addressed AS (
  SELECT *, host || path || CASE WHEN q <> '' THEN '?' || q ELSE '' END AS node
  FROM (SELECT *, coalesce(array_to_string(list_filter(string_split(query, '&'), lambda p: p <> '' AND NOT starts_with(p, 'utm_')), '&'), '') AS q FROM named)),
tags AS (
  SELECT node, host, path, unnest(list_concat(
    list_transform(list_filter(regexp_extract_all(html, '(?i)<link\b[^>]*>'), lambda t: regexp_matches(t, '(?i)\brel\s*=\s*["'']?canonical\b')), lambda t: regexp_extract(t, '(?i)\bhref\s*=\s*["'']?([^"''\s>]+)', 1)),
    list_transform(list_filter(regexp_extract_all(html, '(?i)<meta\b[^>]*>'), lambda t: regexp_matches(t, '(?i)\bhttp-equiv\s*=\s*["'']?refresh\b')), lambda t: regexp_extract(t, '(?i)\burl\s*=\s*["'']?([^"''\s>;]+)', 1)))) AS link
  FROM addressed WHERE contains(url, '://')),
targets AS (
  SELECT node AS a, substr(full_url, instr(full_url, '://') + 3) AS rest FROM (
    SELECT node, CASE WHEN contains(link, '://') THEN link WHEN starts_with(link, '//') THEN 'http:' || link
      WHEN starts_with(link, '/') THEN 'http://' || host || link
      ELSE 'http://' || host || regexp_extract(path, '^(.*/)', 1) || link END AS full_url
    FROM tags WHERE link <> '')),
edges AS (
  SELECT a, h || p || CASE WHEN q <> '' THEN '?' || q ELSE '' END AS b FROM (
    SELECT a, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS h,
      regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS p,
      coalesce(array_to_string(list_filter(string_split(regexp_extract(rest, '^[^?#]*\?([^#]*)', 1), '&'), lambda x: x <> '' AND NOT starts_with(x, 'utm_')), '&'), '') AS q
    FROM targets)),
both_ways AS (SELECT a, b FROM edges WHERE a <> b UNION SELECT b, a FROM edges WHERE a <> b),
reach AS (SELECT a AS node, a AS other FROM both_ways UNION SELECT r.node, e.b FROM reach r JOIN both_ways e ON r.other = e.a),
member AS (SELECT node, min(other) AS component FROM reach GROUP BY node),
ruled AS (SELECT *, regexp_extract(node, '^([^/?#]*)', 1) AS host, regexp_extract(node, '^[^/?#]*([^?#]*)', 1) AS path FROM member),
rules(what, h, p) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
flags AS (
  SELECT component, bool_or(what = 'block') AS any_block, bool_or(what = 'allow') AS any_allow FROM (
    SELECT r.node, r.component, arg_max(what, length(h) + length(p)) AS what
    FROM ruled r LEFT JOIN rules ON (r.host = h OR ends_with(r.host, '.' || h)) AND starts_with(r.path, p)
    GROUP BY r.node, r.component) GROUP BY component),
judged AS (
  SELECT page_id, host, path, CASE WHEN contains(url, '://') THEN node END AS node,
    CASE WHEN (host = 'www.example.com' OR ends_with(host, '.www.example.com')) AND starts_with(path, '/en/') THEN 'www.example.com/en/'
         WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/en/') THEN 'example.com/en/'
         WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/es/') THEN 'net/es/'
         WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/fr/') THEN 'net/fr/'
         WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/') THEN 'com/' END AS rule
  FROM addressed)
SELECT j.page_id, j.host, j.path, j.rule,
  CASE WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
       WHEN any_block AND NOT coalesce(any_allow, false) THEN 'block' ELSE 'allow' END AS verdict,
  coalesce(m.component, j.node) AS component
FROM judged j LEFT JOIN member m ON j.node = m.node LEFT JOIN flags f ON m.component = f.component
"""

def _codes_sql(parts: int = 16, entries: int = 64, rounds: int = 2) -> str:
    """Every part against every entry of its position."""
    steps, book = [], "b0"
    nearest = lambda book: f"""SELECT p.id, p.position, p.v, min_by(b.entry, (d, b.entry)) AS entry, min(d) AS d
      FROM (SELECT p.id, p.position, p.v, b.entry, list_sum(list_transform(p.v, lambda x, i: (x - b.v[i]) * (x - b.v[i]))) AS d FROM parts p JOIN {book} b USING (position)) p, (SELECT p.entry) b GROUP BY 1, 2, 3"""  # noqa: E731
    for k in range(1, rounds + 1):
        steps.append(f"a{k} AS ({nearest(book)})")
        steps.append(f"""m{k} AS (SELECT position, entry, list(m ORDER BY place) AS v FROM (
          SELECT position, entry, place, CAST(sum(v[place]) // count(*) - CASE WHEN sum(v[place]) % count(*) < 0 THEN 1 ELSE 0 END AS BIGINT) AS m FROM a{k}, (SELECT unnest(range(1, (SELECT max(len(v)) + 1 FROM parts))) AS place) GROUP BY 1, 2, 3) GROUP BY 1, 2)""")
        steps.append(f"b{k} AS (SELECT b.position, b.entry, coalesce(m.v, b.v) AS v FROM {book} b LEFT JOIN m{k} m ON b.position = m.position AND b.entry = m.entry)")
        book = f"b{k}"
    steps.append(f"coded AS (SELECT id, string_agg(lower(printf('%02x', entry)), '' ORDER BY position) AS code, CAST(sum(d) AS BIGINT) AS error FROM ({nearest(book)}) GROUP BY 1)")
    return f"""
WITH kept AS (
  SELECT row_number() OVER (ORDER BY vec_id, embedding) AS id, vec_id, label, list_transform(embedding, lambda e: CAST(floor(256 * CAST(e AS DOUBLE)) AS BIGINT)) AS x
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0),
parts AS (SELECT id, position, x[position * len(x) // {parts} + 1 : (position + 1) * len(x) // {parts}] AS v FROM kept, (SELECT unnest(range({parts})) AS position)),
b0 AS (SELECT position, id - 1 AS entry, v FROM parts WHERE id <= {entries}),
{", ".join(steps)}
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY position, entry)) FROM {book}) AS codebooks_sha256
FROM kept JOIN coded USING (id)
"""


ORACLES = {"op13_vector_codes": _codes_sql(), "op7_mix_sources": _MIX, "op10_url_filter": _URLS}
