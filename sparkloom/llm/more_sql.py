"""DuckDB SQL of the url filter and of the repair of conversations."""

from __future__ import annotations

_UPPER, _LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ'", "'abcdefghijklmnopqrstuvwxyz'"


def _level(order: int) -> str:
    """Counts, contexts and smoothed chances of the grams of one order."""
    n, c, p = f"n{order}", f"c{order}", f"p{order}"
    width = 32 ** (order + 1)
    lower = f"p{order - 1}" if order else None
    chance = ", ".join(
        f"CASE WHEN coalesce({c}.c{s}, 0) > 0 THEN (coalesce({n}.n{s}, 0) + {c}.t{s} * {below}) / ({c}.c{s} + {c}.t{s}) ELSE {below} END AS p{s}"
        for s in "ar"
        for below in [f"{lower}.p{s}" if lower else "(1.0 / 32)::DOUBLE"]
    )
    join = f"JOIN {lower} ON {lower}.gram = w.gram % {32**order}" if lower else ""
    return f"""
{n} AS (SELECT gram % {width} AS gram, count(*) FILTER (accepted) AS na, count(*) FILTER (NOT accepted) AS nr FROM taught WHERE NOT held_out GROUP BY 1),
{c} AS (SELECT gram // 32 AS context, sum(na)::DOUBLE AS ca, sum(nr)::DOUBLE AS cr, count(*) FILTER (na > 0)::DOUBLE AS ta, count(*) FILTER (nr > 0)::DOUBLE AS tr FROM {n} GROUP BY 1),
{p} AS (SELECT w.gram, {chance} FROM (SELECT DISTINCT gram % {width} AS gram FROM g) w
  LEFT JOIN {n} ON {n}.gram = w.gram LEFT JOIN {c} ON {c}.context = w.gram // 32 {join}),"""


OP11_SQL = rf"""
WITH u AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), {_UPPER}, {_LOWER}) AS host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
r AS (SELECT DISTINCT host, path, host || path AS text, CASE
    WHEN (host = 'www.example.com' OR ends_with(host, '.www.example.com')) AND starts_with(path, '/en/') THEN 'www.example.com/en/'
    WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/en/') THEN 'example.com/en/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/es/') THEN 'net/es/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/fr/') THEN 'net/fr/'
    WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/') THEN 'com/' END AS rule FROM u),
f AS (SELECT *, rule IN ('www.example.com/en/', 'com/') AS accepted, ('0x' || substr(md5(text), 1, 8))::BIGINT % 5 = 0 AS held_out FROM r),
s AS (SELECT text, list_transform(string_split(translate(regexp_replace(translate(text, {_UPPER}, {_LOWER}), '[^a-z0-9./-]', '_', 'g'), '0123456789./-', repeat('{{', 10) || '|' || chr(125) || '~') || '`', ''), lambda x: ascii(x) & 31) AS s FROM f),
i AS (SELECT text, s, unnest(range(1, len(s) + 1)) AS i FROM s),
g AS (SELECT text, (s[i] + CASE WHEN i > 1 THEN 32 * s[i - 1] ELSE 0 END + CASE WHEN i > 2 THEN 1024 * s[i - 2] ELSE 0 END + CASE WHEN i > 3 THEN 32768 * s[i - 3] ELSE 0 END)::BIGINT AS gram FROM i),
taught AS (SELECT gram, accepted, held_out FROM g JOIN f USING (text) WHERE rule IS NOT NULL),{"".join(map(_level, range(4)))}
scored AS (SELECT text, avg(ln(pa / pr)) AS score FROM g JOIN p3 USING (gram) GROUP BY 1),
bins AS (SELECT floor(score * 64)::BIGINT AS bin, count(*) FILTER (accepted) AS na, count(*) FILTER (NOT accepted) AS nr FROM scored JOIN f USING (text) WHERE held_out AND rule IS NOT NULL GROUP BY 1),
errors AS (SELECT greatest(least(0, bin), max(bin) OVER o + 1) AS least, round(coalesce(sum(na) OVER o, 0) / sum(na) OVER () + 1 - coalesce(sum(nr) OVER o, 0) / sum(nr) OVER (), 12) AS error, sum(na) OVER () * sum(nr) OVER () AS both_kinds
  FROM bins WINDOW o AS (ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT coalesce((SELECT least FROM errors WHERE both_kinds > 0 ORDER BY error, abs(least), least LIMIT 1), 0) AS least)
SELECT page_id, host, path, rule, CASE WHEN rule IS NULL THEN CASE WHEN floor(score * 64) >= t.least THEN 'allow' ELSE 'block' END WHEN accepted THEN 'allow' ELSE 'block' END AS verdict,
  round(score, 6) AS score FROM u JOIN f USING (host, path) JOIN scored USING (text), t"""


def _steps() -> str:
    """Rows (state, row's initial or null, edit, letters, cost, next state): up to three insertions, then one edit of a row."""
    after = {0: 2, 1: 2, 2: 3, 3: 2}
    kept = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}
    rows = []
    for start in range(4):
        state = start
        for inserted in range(4):
            letters, cost = "I" * inserted, 3 * inserted
            rows.append((start, None, "D", letters + "D", cost + 4, state))
            rows.append((start, None, "R", letters + "R", cost + 3, after[state]))
            rows += [(start, role, "K", letters + "K", cost, to) for (s, role), to in kept.items() if s == state]
            state = after[state]
    quoted = lambda x: "NULL" if x is None else str(x) if isinstance(x, int) else f"'{x}'"
    return ", ".join(f"({', '.join(map(quoted, r))})" for r in rows)


_CRC = (
    "xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split(k, ''), lambda x: ascii(x)::UBIGINT)), lambda c, b: "
    "list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]::UBIGINT[]), lambda v, z: xor(v >> 1, 3988292384::UBIGINT * (v & 1)))), 4294967295::UBIGINT)"
)

OP13_SQL = rf"""
WITH RECURSIVE k AS (SELECT coalesce(conv_id::VARCHAR, ' ') AS c, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
m AS (SELECT c, turn, role, text, {_CRC} % 20 AS m FROM k),
x AS (SELECT c, turn, CASE WHEN m = 4 THEN 'user' ELSE role END AS role, CASE WHEN m = 1 THEN '' WHEN m = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(CASE WHEN m = 3 THEN [1, 2] ELSE [1] END) AS copy FROM m WHERE m <> 0),
o AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, role, md5(length(role)::VARCHAR || ':' || role || text)) AS n FROM x),
e AS (SELECT *, row_number() OVER (PARTITION BY c, role, text ORDER BY n) > 1 AS again, NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank,
    NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') AS cut, CASE WHEN left(role, 1) IN ('s', 'u', 'a') THEN left(role, 1) ELSE '?' END AS ini FROM o),
d AS (SELECT *, blank OR again AS gone, ini || lead(ini) OVER (PARTITION BY c ORDER BY n) AS pair FROM e),
r AS (SELECT c, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (again AND NOT blank) AS duplicate,
    count(*) FILTER (cut AND NOT gone) AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal, max(n) AS rows FROM d GROUP BY c),
t(s, ini, edit, letters, cost, s2) AS (VALUES {_steps()}),
p(c, n, s, best) AS (SELECT c, 0::BIGINT, 0, '000000' FROM r UNION ALL
  SELECT d.c, d.n, t.s2, min(lpad((substr(best, 1, 6)::INTEGER + t.cost + CASE WHEN d.cut AND t.edit <> 'D' THEN 3 ELSE 0 END)::VARCHAR, 6, '0') || substr(best, 7) || t.letters)
  FROM p JOIN d ON d.c = p.c AND d.n = p.n + 1 JOIN t ON t.s = p.s AND (t.ini IS NULL OR t.ini = d.ini) AND (t.edit = 'D' OR NOT d.gone) GROUP BY d.c, d.n, t.s2),
b AS (SELECT p.c, min(CASE s WHEN 1 THEN lpad((substr(best, 1, 6)::INTEGER + 6)::VARCHAR, 6, '0') || substr(best, 7) || 'II'
    WHEN 2 THEN lpad((substr(best, 1, 6)::INTEGER + 3)::VARCHAR, 6, '0') || substr(best, 7) || 'I' ELSE best END) AS best FROM p JOIN r ON r.c = p.c AND p.n = r.rows GROUP BY p.c),
a AS (SELECT c, substr(best, 1, 6)::BIGINT AS cost, substr(best, 7) AS audit FROM b),
l AS (SELECT c, audit, unnest(range(1, length(audit) + 1)) AS i FROM a),
w AS (SELECT c, i, substr(audit, i, 1) AS letter, length(replace(substr(audit, 1, i), 'I', '')) AS n FROM l),
y AS (SELECT w.c, w.letter, d.role, d.text, d.ini, row_number() OVER (PARTITION BY w.c ORDER BY i) AS j FROM w LEFT JOIN d ON d.c = w.c AND d.n = w.n WHERE w.letter <> 'D'),
z AS (SELECT *, max(CASE WHEN j = 1 AND letter = 'K' AND ini = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY c) AS headed FROM y),
h AS (SELECT c, sha256(string_agg(CASE WHEN letter = 'K' THEN role WHEN (j - headed) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN letter = 'I' THEN '' ELSE text END, chr(10) ORDER BY j)) AS h FROM z GROUP BY c),
q AS (SELECT DISTINCT conv_id, coalesce(conv_id::VARCHAR, ' ') AS c FROM conversations)
SELECT conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
  coalesce(illegal, 0)::BIGINT AS illegal, coalesce(cost, 0)::BIGINT AS cost, coalesce(audit, '') AS audit, coalesce(h, sha256('')) AS repaired_sha256
FROM q LEFT JOIN r ON q.c = r.c LEFT JOIN a ON q.c = a.c LEFT JOIN h ON q.c = h.c"""
