"""DuckDB SQL of vector codes and the conversation trie, kept in a plain form."""


def _round(number: int) -> str:
    """Assignment by the codebooks of the round before, and the codebooks it gives."""
    return f"""
 far{number} AS (SELECT c.r, c.p, b.e, CAST(sum((c.x - b.x) * (c.x - b.x)) AS BIGINT) AS d FROM comp c JOIN book{number} b ON b.p = c.p AND b.j = c.j GROUP BY ALL),
 near{number} AS MATERIALIZED (SELECT r, p, arg_min(e, d * 64 + e) AS e, min(d) AS d FROM far{number} GROUP BY ALL),
 mean{number} AS (SELECT n.p, n.e, c.j, CAST(floor(CAST(sum(c.x) AS DOUBLE) / count(*)) AS BIGINT) AS x FROM near{number} n JOIN comp c ON c.r = n.r AND c.p = n.p GROUP BY ALL),
 book{number + 1} AS MATERIALIZED (SELECT b.p, b.e, b.j, coalesce(m.x, b.x) AS x FROM book{number} b LEFT JOIN mean{number} m ON m.p = b.p AND m.e = b.e AND m.j = b.j),"""


OP12 = f"""WITH kept AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS r, vec_id, label, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 256) AS BIGINT)) AS v
  FROM embeddings WHERE len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
 flat AS (SELECT r, unnest(v) AS x, generate_subscripts(v, 1) - 1 AS k, CAST(len(v) / 16 AS BIGINT) AS w FROM kept),
 comp AS MATERIALIZED (SELECT r, CAST(floor(k / w) AS BIGINT) AS p, k % w AS j, x FROM flat),
 book0 AS MATERIALIZED (SELECT p, r - 1 AS e, j, x FROM comp WHERE r <= 64),{_round(0)}{_round(1)}
 far2 AS (SELECT c.r, c.p, b.e, CAST(sum((c.x - b.x) * (c.x - b.x)) AS BIGINT) AS d FROM comp c JOIN book2 b ON b.p = c.p AND b.j = c.j GROUP BY ALL),
 near2 AS (SELECT r, p, arg_min(e, d * 64 + e) AS e, min(d) AS d FROM far2 GROUP BY ALL),
 coded AS (SELECT r, string_agg(printf('%02x', e), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM near2 GROUP BY r)
 SELECT k.vec_id, c.code, c.error, CAST(sum(c.error) OVER (PARTITION BY k.label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY p, e, j)) FROM book2) AS codebooks_sha256
 FROM kept k JOIN coded c ON c.r = k.r"""

# CRC-32, bit by bit.
_CRC32 = """xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(1, length(s) + 1), lambda i: CAST(ascii(substr(s, i, 1)) AS BIGINT))),
   lambda c, b: list_reduce(list_prepend(xor(c, b), [CAST(0 AS BIGINT) FOR k IN range(8)]), lambda x, z: xor(x >> 1, 3988292384 * (x & 1)))), CAST(4294967295 AS BIGINT))"""

OP13 = f"""WITH turns AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
   row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS place FROM conversations WHERE conv_id IS NOT NULL),
 sizes AS (SELECT conv_id, CAST(conv_id AS VARCHAR) AS s, max(place) AS n FROM turns GROUP BY ALL),
 asked AS (SELECT conv_id, n, {_CRC32} % 6 AS h, conv_id - conv_id % 100 AS head FROM sizes),
 plan AS MATERIALIZED (SELECT a.conv_id, a.n, a.h, a.head, least(a.h, coalesce(g.n, 0)) AS taken FROM asked a LEFT JOIN sizes g ON g.conv_id = a.head),
 made AS (SELECT p.conv_id, p.taken + t.place - p.h AS depth, t.role, t.text FROM plan p JOIN turns t ON t.conv_id = p.conv_id AND t.place > p.h
   UNION ALL SELECT p.conv_id, t.place, t.role, t.text FROM plan p JOIN turns t ON t.conv_id = p.head AND t.place <= p.taken),
 paths AS MATERIALIZED (SELECT conv_id, depth, length(text) AS chars,
   string_agg(md5(length(role) || ':' || role || text), '') OVER (PARTITION BY conv_id ORDER BY depth) AS path FROM made
   UNION ALL SELECT conv_id, 0, 0, '' FROM plan),
 lengths AS (SELECT conv_id, max(depth) AS length FROM paths GROUP BY ALL),
 nodes AS MATERIALIZED (SELECT p.path, min(p.depth) AS depth, min(p.conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * max(p.chars) AS own,
   coalesce(string_agg(CASE WHEN p.depth = l.length THEN CAST(p.conv_id AS VARCHAR) END, ',' ORDER BY p.conv_id), '') AS ends FROM paths p JOIN lengths l USING (conv_id) GROUP BY p.path),
 linked AS (SELECT c.*, p.conv_id AS parent_conv_id, (SELECT count(*) FROM nodes k WHERE k.depth = c.depth + 1 AND left(k.path, CAST(32 * c.depth AS BIGINT)) = c.path) AS n_children
   FROM nodes c LEFT JOIN nodes p ON p.depth = c.depth - 1 AND p.path = left(c.path, CAST(greatest(32 * c.depth - 32, 0) AS BIGINT))),
 ups AS (SELECT left(path, unnest(range(0, CAST(32 * depth + 1 AS BIGINT), 32))) AS path, own, n_children FROM linked),
 sums AS (SELECT path, CAST(sum(own) AS BIGINT) AS saved_tokens, count(*) FILTER (n_children = 0) AS n_leaves FROM ups GROUP BY ALL)
 SELECT n.conv_id, n.depth, n.parent_conv_id, n.n_convs, n.n_children, s.n_leaves, s.saved_tokens, sha256(n.ends) AS ends_sha256 FROM linked n JOIN sums s USING (path)"""
