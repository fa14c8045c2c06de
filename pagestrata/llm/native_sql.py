"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from pagestrata.llm import mixing, quality, secrets
from pagestrata.llm.common import BLANK, WORD


def mix_sql(documents: str = "documents", more: str = "") -> str:
    """CTEs that end in ``mixed``: every row with size, source_size, target, whole and taken."""
    return f"""
measured AS (
  SELECT doc_id, text, source, len(regexp_extract_all(coalesce(text, ''), '{WORD}'))::BIGINT AS size,
         md5('{mixing.SEED}:' || coalesce(doc_id::VARCHAR, '')) AS seeded
  FROM {documents}),
sized AS (SELECT source, sum(size)::BIGINT AS source_size FROM measured GROUP BY source),
weighed AS (
  SELECT source, source_size, source_size * {mixing.MAX_EPOCHS}::DOUBLE AS cap,
         (CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END)::DOUBLE AS weight
  FROM sized),
levels AS (
  SELECT *, cap / weight AS ratio,
         (sum(source_size) OVER () * {mixing.BUDGET}::DOUBLE
          - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM weighed),
targeted AS (
  SELECT source, source_size, least(cap, (SELECT level FROM levels WHERE level <= ratio ORDER BY ratio, level LIMIT 1) * weight) AS target FROM levels),
repeats AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target)::BIGINT // source_size ELSE 0 END AS whole FROM targeted),
mixed AS (
  SELECT m.*, r.source_size, r.target, r.whole,
         (r.whole * m.size + greatest(0, least(m.size, floor(r.target)::BIGINT - r.whole * r.source_size
           - coalesce(sum(m.size) OVER (PARTITION BY m.source ORDER BY m.seeded, m.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))))::BIGINT AS taken
  FROM measured m JOIN repeats r ON m.source IS NOT DISTINCT FROM r.source)"""


OP10 = f"WITH {mix_sql()} SELECT doc_id, size, source_size, target, taken FROM mixed"


def _hist(name: str) -> str:
    p = quality.CLASSES[name].replace("'", "''")
    return f"(length(joined) - length(regexp_replace(joined, '{p}', '', 'g')))"


def _divergence(left: str, right: str) -> str:
    return f"""sqrt(greatest(0, (SELECT sum((CASE WHEN p > 0 THEN p * log2(p / ((p + q) / 2)) ELSE 0 END
      + CASE WHEN q > 0 THEN q * log2(q / ((p + q) / 2)) ELSE 0 END) / 2)
      FROM (SELECT unnest({left}) / list_sum({left}) AS p, unnest({right}) / list_sum({right}) AS q))))"""


OP7 = f"""
WITH split AS (
  SELECT row_number() OVER () AS r, doc_id, lang, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{WORD}') AS ws FROM documents),
windows AS (SELECT r, i, array_to_string(ws[i:i + 7], ' ') AS win FROM (SELECT r, ws, unnest(range(1, len(ws) - 6)) AS i FROM split)),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, win) AS n FROM windows) WHERE n > 1),
repeats AS (SELECT r, sum(least(8, coalesce(i - last, 8)))::BIGINT AS n_repeat_words
  FROM (SELECT r, i, lag(i) OVER (PARTITION BY r ORDER BY i) AS last FROM twice) GROUP BY r),
base AS (
  SELECT s.*, array_to_string(ws, '') AS joined, len(ws)::BIGINT AS n_words, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
         list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{WORD}')) AS lines
  FROM split s LEFT JOIN repeats USING (r)),
failed AS (SELECT *, (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed FROM base),
classed AS (
  SELECT *, [{_hist('vowels')}, {_hist('letters')} - {_hist('vowels')}, {_hist('digits')}, {_hist('points')},
             length(joined) - {_hist('letters')} - {_hist('digits')} - {_hist('points')}]::DOUBLE[] AS own FROM failed),
keyed AS (SELECT lang AS k, own, ws FROM classed WHERE lang IS NOT NULL UNION ALL SELECT NULL, own, ws FROM classed),
ref_classes AS (SELECT k, [sum(own[1]), sum(own[2]), sum(own[3]), sum(own[4]), sum(own[5])] AS ref_own FROM keyed GROUP BY k),
counts AS (SELECT k, w, count(*) AS n FROM (SELECT k, lower(unnest(ws)) AS w FROM keyed) GROUP BY k, w),
ranked AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY n DESC, w) AS rank, sum(n) OVER (PARTITION BY k) AS total FROM counts),
refs AS (
  SELECT k, list(w ORDER BY rank) AS ref_words, list_append(list(n::DOUBLE ORDER BY rank), (any_value(total) - sum(n))::DOUBLE) AS ref_counts
  FROM ranked WHERE rank <= {quality.COMMON} GROUP BY k),
refs2 AS (SELECT refs.k, ref_words, ref_counts, ref_own FROM refs JOIN ref_classes c ON refs.k IS NOT DISTINCT FROM c.k),
counted AS (
  SELECT c.*, ref_own, ref_counts, list_transform(ref_words, lambda w: len(list_filter(ws, lambda x: lower(x) = w))::DOUBLE) AS times
  FROM classed c LEFT JOIN refs2 ON refs2.k IS NOT DISTINCT FROM c.lang),
apart AS (
  SELECT *, list_append(times, n_words - list_sum(times)) AS hist FROM counted)
SELECT doc_id, n_words, length(joined)::BIGINT AS word_chars,
       (length(text) - length(regexp_replace(text, '{quality.SYMBOLS}', '', 'g')))::BIGINT AS n_symbols,
       (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND (n_words < {quality.MIN_WORDS}
         OR ({_divergence('own', 'ref_own')} <= {quality.MAX_CLASS} AND {_divergence('hist', 'ref_counts')} <= {quality.MAX_WORDS})) AS kept
FROM apart"""


def _spans(kind: int, pattern: str, least: int, group: int) -> str:
    p = pattern.replace("'", "''")
    return f"""SELECT r, {kind} AS kind, gaps + before AS s, gaps + before + length(whole) AS e, val FROM (
  SELECT r, i, whole[i] AS whole, val[i] AS val, list_sum(list_transform(parts[1:i], lambda x: length(x))) AS gaps,
         coalesce(list_sum(list_transform(whole[1:i - 1], lambda x: length(x))), 0) AS before
  FROM (SELECT r, parts, whole, val, unnest(range(1, len(whole) + 1)) AS i FROM (
    SELECT r, string_split_regex(text, '{p}') AS parts, regexp_extract_all(text, '{p}') AS whole, regexp_extract_all(text, '{p}', {group}) AS val FROM d)))
  WHERE length(val) >= {least}"""


def _pairs(source: str) -> str:
    return f"""SELECT v[i:i + 1] AS pair, count(*) AS n FROM (SELECT v, unnest(range(1, length(v))) AS i FROM ({source}))
  WHERE regexp_full_match(v[i:i + 1], '[A-Za-z0-9+/_=-]{{2}}') GROUP BY ALL"""


def _strip(expression: str) -> str:
    for pattern in (secrets.ASSIGN, secrets.ACCESS, secrets.HEX):
        expression = f"regexp_replace({expression}, '{pattern.replace(chr(39), chr(39) * 2)}', ' ', 'g')"
    return expression


_LISTED = "coalesce(string_agg(name || ':' || s || ':' || e, ',' ORDER BY s, kind), '')"
OP6 = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
base AS MATERIALIZED ({_spans(0, secrets.ASSIGN, 6, 2)} UNION ALL {_spans(1, secrets.ACCESS, 20, 0)} UNION ALL {_spans(2, secrets.HEX, 0, 0)}),
sample AS (SELECT {_strip('text')} AS text FROM d ORDER BY md5(coalesce(doc_id::VARCHAR, '')), text LIMIT {secrets.SAMPLE}),
randoms AS ({_pairs('SELECT val AS v FROM base')}),
plains AS ({_pairs(f"SELECT v FROM (SELECT unnest(regexp_extract_all(text, '{WORD}')) AS v FROM sample) WHERE regexp_full_match(v, '{secrets.ORDINARY}')")}),
letters AS (SELECT unnest(string_split('{secrets.ALPHABET}', '')) AS c),
cells AS (
  SELECT a.c AS a, b.c AS b, coalesce(x.n, 0) AS rn, coalesce(p.n, 0) AS pn
  FROM letters a, letters b LEFT JOIN randoms x ON x.pair = a.c || b.c LEFT JOIN plains p ON p.pair = a.c || b.c),
ratios AS (
  SELECT a || b AS pair, floor(1000 * (
    ln((rn + {secrets.LEAN} * (sum(rn) OVER (PARTITION BY b) + 1) / (sum(rn) OVER () + {len(secrets.ALPHABET)})) / (sum(rn) OVER (PARTITION BY a) + {secrets.LEAN}))
    - ln((pn + {secrets.LEAN} * (sum(pn) OVER (PARTITION BY b) + 1) / (sum(pn) OVER () + {len(secrets.ALPHABET)})) / (sum(pn) OVER (PARTITION BY a) + {secrets.LEAN}))) + 0.5)::BIGINT AS ratio FROM cells),
runs AS MATERIALIZED ({_spans(3, secrets.TOKEN, secrets.RUN, 0)}),
free AS (SELECT row_number() OVER () AS k, * FROM runs u WHERE regexp_matches(val, '[0-9]') AND regexp_matches(val, '[A-Za-z]')
  AND NOT EXISTS (SELECT 1 FROM base b WHERE b.r = u.r AND b.s < u.e AND u.s < b.e)),
scored AS (SELECT k, sum(ratio) AS total FROM (SELECT k, val[i:i + 1] AS pair FROM (SELECT k, val, unnest(range(1, length(val))) AS i FROM free)) JOIN ratios USING (pair) GROUP BY k),
spans AS (
  SELECT r, kind, s, e FROM base UNION ALL
  SELECT r, kind, s, e FROM free JOIN scored USING (k) WHERE total >= {int(1000 * secrets.MIN_RATIO)} * (length(val) - 1)),
named AS (SELECT *, {list(secrets.KINDS)}[kind + 1] AS name FROM spans),
per AS (
  SELECT r, count(*) FILTER (kind = 0) AS a, count(*) FILTER (kind = 1) AS c, count(*) FILTER (kind = 2) AS h, {_LISTED} AS spans,
         coalesce(string_agg(name || ':' || s || ':' || e, ',' ORDER BY s, kind) FILTER (kind < 3), '') AS base FROM named GROUP BY r)
SELECT doc_id, coalesce(a, 0)::BIGINT AS n_assign, coalesce(c, 0)::BIGINT AS n_access, coalesce(h, 0)::BIGINT AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN per USING (r)"""


OP5 = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
windows AS (SELECT r, i, md5(substr(h, 2 * i + 1, 400)) AS win FROM (SELECT r, h, unnest(range(0, len(h) // 2 - 199)) AS i FROM d WHERE len(h) >= 400)),
twice AS (SELECT r, i FROM windows WHERE win IN (SELECT win FROM windows GROUP BY win HAVING count(*) > 1)),
marked AS (SELECT r, i, coalesce(i > lag(i) OVER (PARTITION BY r ORDER BY i) + 200, true) AS opens FROM twice),
numbered AS (SELECT r, i, sum(opens::INT) OVER (PARTITION BY r ORDER BY i) AS span FROM marked),
spans AS (SELECT r, min(i) AS s, max(i) + 200 AS e FROM numbered GROUP BY r, span),
gaps AS (SELECT r, s, e, coalesce(lag(e) OVER (PARTITION BY r ORDER BY s), 0) AS after FROM spans),
per AS (SELECT r, sum(e - s) AS gone, count(*) AS n, max(e) AS last, string_agg(substr(h, 2 * after + 1, 2 * (s - after)), '' ORDER BY s) AS kept FROM gaps JOIN d USING (r) GROUP BY r)
SELECT doc_id, (len(h) // 2)::BIGINT AS n_bytes, coalesce(gone, 0)::BIGINT AS n_removed, coalesce(n, 0)::BIGINT AS n_spans,
       sha256(unhex(CASE WHEN per.r IS NULL THEN h ELSE kept || substr(h, 2 * last + 1) END)) AS kept_sha256
FROM d LEFT JOIN per USING (r)"""
