"""DuckDB statements of the training-data queries that SQL can express."""

from __future__ import annotations

OP3 = r"""
WITH u AS (
  SELECT page_id,
         coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1),
                  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path
  FROM pages)
SELECT page_id, host, path,
       CASE WHEN ('.' || host) LIKE '%.example.com' AND starts_with(path, '/de/') THEN 'example.com/de/'
            WHEN ('.' || host) LIKE '%.example.net' AND starts_with(path, '/en/') THEN 'example.net/en/'
            WHEN ('.' || host) LIKE '%.org' AND starts_with(path, '/fr/') THEN 'org/fr/'
            WHEN ('.' || host) LIKE '%.net' AND starts_with(path, '/') THEN 'net/' END AS rule,
       CASE WHEN ('.' || host) LIKE '%.example.com' AND starts_with(path, '/de/') THEN 'block'
            WHEN ('.' || host) LIKE '%.example.net' AND starts_with(path, '/en/') THEN 'allow'
            WHEN ('.' || host) LIKE '%.org' AND starts_with(path, '/fr/') THEN 'allow'
            WHEN ('.' || host) LIKE '%.net' AND starts_with(path, '/') THEN 'block' ELSE 'allow' END AS verdict
FROM u
"""

OP6 = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
  FROM embeddings
  WHERE embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS query_id, b.vec_id,
         CAST(list_sum(list_transform(range(1, len(a.q) + 1), lambda i: a.q[i] * b.q[i])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
       vec_id, score
FROM s QUALIFY rank <= 5
"""

OP12 = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[a-z\x{80}-\x{10FFFF}]+') AS words
  FROM documents),
t AS MATERIALIZED (SELECT rid, lang, source, unnest(words) AS term FROM d),
kept AS MATERIALIZED (SELECT lang, term FROM t GROUP BY lang, term HAVING count(DISTINCT rid) >= 3),
v AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS MATERIALIZED (
  SELECT lang, source, term, count(*) AS c FROM t JOIN kept USING (lang, term) GROUP BY lang, source, term),
n AS (SELECT lang, source, coalesce(sum(c), 0) AS n FROM g LEFT JOIN c USING (lang, source) GROUP BY lang, source),
p AS MATERIALIZED (
  SELECT n.lang, n.source, kept.term, coalesce(c.c, 0) AS c,
         1 + CAST(1000000000 AS HUGEINT) * (coalesce(c.c, 0) + 1) // CAST(n.n + v.v AS HUGEINT) AS p
  FROM n JOIN kept ON n.lang = kept.lang JOIN v ON n.lang = v.lang
  LEFT JOIN c ON c.lang = n.lang AND c.source = n.source AND c.term = kept.term),
q AS (
  SELECT p.lang, p.term, 1 + CAST(1000000000 AS HUGEINT) * (sum(p.c) + 1) // CAST(any_value(m.n) + any_value(v.v) AS HUGEINT) AS q
  FROM p JOIN (SELECT lang, sum(n) AS n FROM n GROUP BY lang) m ON p.lang = m.lang JOIN v ON p.lang = v.lang
  GROUP BY p.lang, p.term),
sums AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source
  GROUP BY a.lang, a.source, b.source),
found AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
  UNION ALL
  SELECT p.lang, p.source, 'term', p.term, (p.p - q.q) * (p.p - q.q) // q.q
  FROM p JOIN q ON p.lang = q.lang AND p.term = q.term WHERE p.c > 0 AND p.p > q.q)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value,
       CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
FROM found QUALIFY part = 'pair' OR rank <= 200
"""


def op13(parts: int = 4, width: int = 16, entries: int = 256, rounds: int = 4) -> str:
    """The rounds written out; vectors of ``parts * width`` components."""
    nearest = """a{r} AS MATERIALIZED (
  SELECT p.rid, p.part, any_value(p.x) AS x,
         min(CAST(list_inner_product(p.x, p.x) - 2 * list_inner_product(p.x, b.x) + list_inner_product(b.x, b.x) AS BIGINT)
             * {entries} + b.entry) AS k
  FROM p JOIN b{r} b ON p.part = b.part GROUP BY p.rid, p.part)"""
    replaced = """b{s} AS MATERIALIZED (
  SELECT b.part, b.entry, coalesce(u.x, b.x) AS x
  FROM b{r} b LEFT JOIN (
    SELECT part, entry, list(floor(total / n) ORDER BY pos) AS x
    FROM (SELECT part, k % {entries} AS entry, pos, sum(x[pos]) AS total, count(*) AS n
          FROM a{r}, range(1, {width} + 1) t(pos) GROUP BY part, k % {entries}, pos)
    GROUP BY part, entry) u ON u.part = b.part AND u.entry = b.entry)"""
    steps = [piece.format(r=r, s=r + 1, width=width, entries=entries)
             for r in range(rounds) for piece in (nearest, replaced)] + [nearest.format(r=rounds, entries=entries)]
    return f"""
WITH e AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS q
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
r AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, q) AS rid, vec_id, label, q FROM e),
p AS MATERIALIZED (
  SELECT rid, part, list_slice(q, part * {width} + 1, part * {width} + {width}) AS x FROM r, range({parts}) t(part)),
b0 AS (SELECT part, rid - 1 AS entry, x FROM p WHERE rid <= {entries}),
{", ".join(steps)},
coded AS (
  SELECT r.vec_id, r.label, string_agg(printf('%02x', CAST(k % {entries} AS INTEGER)), '' ORDER BY part) AS code,
         CAST(sum(k // {entries}) AS BIGINT) AS error
  FROM a{rounds} a JOIN r ON a.rid = r.rid GROUP BY r.rid, r.vec_id, r.label),
books AS (
  SELECT sha256(string_agg(CAST(CAST(v AS BIGINT) AS VARCHAR), ',' ORDER BY part, entry, pos)) AS codebooks_sha256
  FROM (SELECT part, entry, unnest(x) AS v, unnest(range(1, {width} + 1)) AS pos FROM b{rounds}))
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
FROM coded, books
"""


ORACLE = {"op3_url_filters": OP3, "op6_exact_topk": OP6, "op12_source_divergence": OP12, "op13_vector_codes": op13()}
