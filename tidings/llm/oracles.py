"""DuckDB SQL for the queries that SQL can express, written apart from the operators."""

from __future__ import annotations

from tidings.llm.secrets import BASE, MORE

LINES = """WITH d AS (SELECT row_number() OVER () AS rn, doc_id, coalesce(text, '') AS text FROM documents),
l AS (SELECT rn, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM d),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
f AS (SELECT key FROM k WHERE key <> '' GROUP BY 1 HAVING count(DISTINCT rn) >= 10)
SELECT d.doc_id, n_lines, n_dropped, sha256(coalesce(kept, '')) AS kept_sha256
FROM d JOIN (
  SELECT rn, count(*) AS n_lines, count(f.key) AS n_dropped, string_agg(line, chr(10) ORDER BY i) FILTER (f.key IS NULL) AS kept
  FROM k LEFT JOIN f ON f.key = k.key GROUP BY 1) USING (rn)"""


def _secrets() -> str:
    parts = []
    for place, r in enumerate(BASE + MORE):
        regex = r.regex.replace("'", "''")
        parts.append(
            f"SELECT rn, {place} AS place, '{r.kind}' AS kind, list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS start, length(m[i]) AS size, length(v[i]) AS worth, {r.least} AS least "
            f"FROM (SELECT *, unnest(generate_series(1, len(m))) AS i FROM (SELECT rn, regexp_extract_all(text, '{regex}') AS m, regexp_extract_all(text, '{regex}', {r.group}) AS v, regexp_split_to_array(text, '{regex}') AS g FROM d))"
        )
    shown = "string_agg(kind || ':' || CAST(start AS BIGINT) || ':' || CAST(start + size AS BIGINT), ',' ORDER BY start, place)"
    counts = ", ".join(f"count(kind) FILTER (place = {k}) AS n_{r.kind}" for k, r in enumerate(BASE))
    return f"""WITH d AS (SELECT row_number() OVER () AS rn, doc_id, coalesce(text, '') AS text FROM documents),
s AS (SELECT * FROM ({' UNION ALL '.join(parts)}) WHERE worth >= least)
SELECT any_value(d.doc_id) AS doc_id, {counts}, sha256(coalesce({shown} FILTER (place < {len(BASE)}), '')) AS base_sha256, coalesce({shown} FILTER (place IS NOT NULL), '') AS spans
FROM d LEFT JOIN s USING (rn) GROUP BY d.rn"""


CHAT = """WITH r AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(8 + length(role) + length(text) + length(regexp_replace(role, '[^\\\\<\\[\\n]', '', 'g')) + length(regexp_replace(text, '[^\\\\<\\[]', '', 'g'))) AS BIGINT) AS formatted_chars
FROM r GROUP BY 1"""

FILTERS = """WITH RECURSIVE letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS l),
orders(o) AS (SELECT l FROM letters UNION ALL SELECT o || l FROM orders, letters WHERE NOT contains(o, l)),
w AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
m AS (SELECT doc_id, text, min(doc_id) OVER (PARTITION BY text) AS least, part, {'A': len(words) < 200, 'B': 100 * len(list_distinct(words)) < 50 * len(words),
    'C': 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text), 'D': regexp_matches(text, '[#$%&*|]')} AS f FROM w),
g AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS bad FROM labels GROUP BY 1),
d AS (SELECT part, concat(CASE WHEN f['A'] THEN 'A' END, CASE WHEN f['B'] THEN 'B' END, CASE WHEN f['C'] THEN 'C' END, CASE WHEN f['D'] THEN 'D' END, CASE WHEN doc_id > least THEN 'E' END) AS fails,
    coalesce(good, false) AS good, coalesce(bad, false) AS bad FROM m LEFT JOIN g USING (doc_id)),
c AS (SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (bad) AS bad FROM d GROUP BY 1, 2),
s AS (SELECT c.*, o, step, o[step:step] AS filter, contains(fails, o[step:step]) AS hit, regexp_matches(o[1:step - 1], '[-' || fails || ']') AS gone
  FROM c, orders, generate_series(1, 5) AS t(step) WHERE length(o) = 5)
SELECT part, o AS filter_order, CAST(step AS INTEGER) AS step, filter, CAST(coalesce(sum(n) FILTER (NOT hit AND NOT gone), 0) AS BIGINT) AS kept, CAST(coalesce(sum(n) FILTER (hit AND NOT gone), 0) AS BIGINT) AS removed,
  CAST(coalesce(sum(n) FILTER (hit AND gone), 0) AS BIGINT) AS redundant, CAST(coalesce(sum(n) FILTER (fails = filter), 0) AS BIGINT) AS unique_fails,
  CAST(coalesce(sum(good) FILTER (hit AND NOT gone), 0) AS BIGINT) AS good_lost, CAST(coalesce(sum(bad) FILTER (hit AND NOT gone), 0) AS BIGINT) AS toxic_lost,
  CAST(sum(coalesce(sum(n) FILTER (hit AND NOT gone), 0)) OVER (PARTITION BY part, filter) AS BIGINT) AS shapley
FROM s GROUP BY part, o, step, filter"""


def _clusters(k: int = 40, rounds: int = 5, size: int = 64, seed: int = 2) -> str:
    parts = [
        f"v AS MATERIALIZED (SELECT row_number() OVER () AS rn, vec_id, list_transform(embedding, lambda a: CAST(floor(256 * CAST(a AS DOUBLE)) AS BIGINT)) AS x FROM embeddings WHERE len(embedding) = {size} AND len(list_filter(embedding, lambda a: a IS NOT NULL AND isfinite(a))) = {size})",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('{seed}:' || vec_id)) - 1 AS c, x AS y FROM v QUALIFY c < {k})",
    ]
    for r in range(rounds + 1):
        parts.append(f"a{r} AS MATERIALIZED (SELECT rn, min((CAST(list_sum(list_transform(list_zip(x, y), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT), c)) AS best FROM v, c{r} GROUP BY 1)")
        if r < rounds:
            parts.append(f"s{r} AS (SELECT c, i, sum(a) AS s, count(*) AS n FROM (SELECT best[2] AS c, unnest(x) AS a, generate_subscripts(x, 1) AS i FROM a{r} JOIN v USING (rn)) GROUP BY 1, 2)")
            parts.append(f"c{r + 1} AS MATERIALIZED (SELECT c, coalesce(z, y) AS y FROM c{r} LEFT JOIN (SELECT c, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS z FROM s{r} GROUP BY 1) USING (c))")
    return f"""WITH {", ".join(parts)}
SELECT vec_id, CAST(c AS INTEGER) AS cluster, best[1] AS distance, CAST(sum(best[1]) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia, CAST(sum(best[1]) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(y, ',')) AS centroid_sha256
FROM a{rounds} JOIN v USING (rn) JOIN c{rounds} ON c = best[2]"""


ORACLES = {"op4_secrets": _secrets(), "op6_lines": LINES, "op10_chat": CHAT, "op12_filters": FILTERS, "op13_clusters": _clusters()}
