"""DuckDB SQL of speech chunks: of whole texts, and of replies that come as deltas."""

from __future__ import annotations

from sparkloom.operators.chunks import CLOSERS, OPENERS, SOFT, STRONG


def _class(marks: str) -> str:
    return "[" + "".join("\\" + m if m in "[]^-\\" else m for m in marks).replace("'", "''") + "]"


TAIL = f"^{_class(CLOSERS)}*{_class(STRONG)}*"
OPENS = rf"^\s*(?:{'|'.join(OPENERS)})"
ALL = STRONG + SOFT


def _marks(text: str) -> str:
    """All marks of ``text`` (place, whether strong, end of the closers and terminators after them, whether an opener follows)."""
    places = f"list_filter(range(1, length({text}) + 1), lambda i: contains('{ALL}', {text}[i]))"
    ends = f"list_transform({places}, lambda i: {{'i': i, 'strong': contains('{STRONG}', {text}[i]), 'e': i + length(regexp_extract(substr({text}, i + 1), '{TAIL}'))}})"
    return f"list_transform({ends}, lambda x: {{'i': x.i, 'strong': x.strong, 'e': x.e, 'free': NOT regexp_matches(substr({text}, x.e + 1, 40), '{OPENS}')}})"


def _said(piece: str) -> str:
    strip = lambda x: rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"
    return strip(f"ltrim({strip(piece)}, '{ALL}')")


def _found(start: str, first: str) -> str:
    """strong, soft and any mark where the text could be cut after ``start``, from the list ``m``."""
    least = f"CASE WHEN {first} THEN 3 ELSE 8 END"
    return f"""list_filter(m, lambda x: x.strong AND x.free AND x.i > {start} AND x.e - {start} >= {least})[1].e - {start} AS strong,
      list_filter(m, lambda x: NOT x.strong AND x.free AND x.i > {start} AND x.e - {start} BETWEEN 16 AND 60)[-1].e - {start} AS soft,
      list_filter(m, lambda x: x.i - {start} > {least} AND x.i - {start} <= 100)[-1].e - {start} AS any_mark"""


CUT = """CASE WHEN strong <= 60 THEN strong WHEN size >= 60 AND soft IS NOT NULL THEN soft WHEN size >= 60 AND strong IS NOT NULL THEN strong
      WHEN size >= 100 THEN coalesce(any_mark, 100) END"""

CHUNKS_SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, text, {_marks("text")} AS m FROM documents WHERE text IS NOT NULL),
w(doc_id, pos, n, said) AS (SELECT doc_id, 0::BIGINT, 0, NULL::VARCHAR FROM d UNION ALL
  SELECT doc_id, pos + cut, n + (said <> '')::INTEGER, said FROM (
    SELECT doc_id, pos, n, cut, {_said("substr(text, pos + 1, cut)")} AS said FROM (
      SELECT doc_id, pos, n, text, {CUT} AS cut FROM (SELECT w.doc_id, w.pos, w.n, d.text, length(d.text) - w.pos AS size, {_found("w.pos", "w.n = 0")} FROM w JOIN d ON d.doc_id = w.doc_id)
    ) WHERE cut IS NOT NULL)),
e AS (SELECT doc_id, max(pos) AS pos FROM w GROUP BY doc_id),
a AS (SELECT doc_id, pos, said FROM w WHERE said <> '' UNION ALL SELECT e.doc_id, 1000000000000, {_said("substr(d.text, e.pos + 1)")} FROM e JOIN d ON d.doc_id = e.doc_id),
r AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS i, count(*) OVER (PARTITION BY doc_id) AS k, said FROM a WHERE said <> '')
SELECT doc_id, i::INTEGER AS chunk_index, said AS chunk, i = k - 1 AS is_final FROM r"""

STREAM_CHUNKS_SQL = f"""
WITH RECURSIVE t AS (SELECT conv_id || '/' || turn AS reply, text, (length(text) + 149) // 150 AS n_deltas FROM conversations WHERE trim(text) <> ''),
w(reply, step, k, b, n, said) AS (SELECT reply, 0, 0::BIGINT, '', 0, NULL::VARCHAR FROM t UNION ALL
  SELECT reply, step + 1, k + (cut IS NULL)::INTEGER, CASE WHEN cut IS NOT NULL THEN substr(b, cut + 1) WHEN k < n_deltas THEN b || substr(text, k * 150 + 1, 150) ELSE '' END,
    n + coalesce(said <> '', false)::INTEGER, said FROM (
    SELECT *, CASE WHEN cut IS NOT NULL THEN {_said("substr(b, 1, cut)")} WHEN k = n_deltas THEN {_said("b")} END AS said FROM (
      SELECT *, {CUT} AS cut FROM (SELECT *, length(b) AS size, {_found("0", "n = 0")} FROM (
        SELECT w.reply, w.step, w.k, w.b, w.n, t.text, t.n_deltas, {_marks("w.b")} AS m FROM w JOIN t ON t.reply = w.reply WHERE w.k <= t.n_deltas))))),
r AS (SELECT reply, row_number() OVER (PARTITION BY reply ORDER BY step) - 1 AS i, count(*) OVER (PARTITION BY reply) AS k, said FROM w WHERE said <> '')
SELECT reply, i::INTEGER AS chunk_index, said AS chunk, i = k - 1 AS is_final FROM r"""
