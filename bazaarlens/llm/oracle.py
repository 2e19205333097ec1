"""DuckDB SQL of the queries that SQL can express."""

from __future__ import annotations

from bazaarlens.llm.chat import DEFAULT
from bazaarlens.llm.queries import SAMPLE_TEXT
from bazaarlens.llm.warc import BASE32


def _escaped(column: str) -> str:
    out = f"replace({column}, '\\', '\\\\')"
    for marker in DEFAULT.control:
        out = f"replace({out}, '{marker}', '{marker[0]}\\{marker[1:]}')"
    return out


def _chat() -> str:
    around = " ".join(f"WHEN '{role}' THEN {len(a) + len(b)}" for role, (a, b) in DEFAULT.turns.items())
    other = sum(map(len, DEFAULT.other))
    allowed = ", ".join(f"'{state}>{role}'" for state, role in DEFAULT.order)
    accepting = ", ".join(f"'{state}'" for state in DEFAULT.accepting)
    order = "ORDER BY turn NULLS FIRST, role, text"
    return f"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '{SAMPLE_TEXT}'), (-7, 1, 'assistant', '{SAMPLE_TEXT}')
), turns AS (
  SELECT *, coalesce(lag(role) OVER (PARTITION BY conv_id {order}), 'start') || '>' || role AS step,
    CASE role {around} ELSE {other} + length({_escaped('role')}) END + length({_escaped('text')}) AS chars
  FROM rows
), digests AS (
  SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' {order}) AS all_text,
    string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' {order}) AS loss,
    sum(chars)::BIGINT AS formatted_chars, bool_and(step IN ({allowed})) AND last(role {order}) IN ({accepting}) AS valid
  FROM turns GROUP BY conv_id
)
SELECT conv_id, n_turns, sha256(all_text) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256,
  formatted_chars, valid
FROM digests
"""


_WARC = f"""
WITH rows AS (
  SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex FROM pages
), winners AS (
  SELECT html, max(page_id) AS response FROM rows GROUP BY html
), digits AS (
  SELECT rows.*, response, list_transform(range(40), lambda i: strpos('123456789abcdef', substr(hex, i + 1, 1))) AS nibbles
  FROM rows JOIN winners USING (html)
), bits AS (
  SELECT *, flatten(list_transform(nibbles, lambda n: [(n >> 3) & 1, (n >> 2) & 1, (n >> 1) & 1, n & 1])) AS b FROM digits
)
SELECT page_id, strlen(html) AS payload_bytes,
  list_aggregate(list_transform(range(32), lambda i: substr('{BASE32}',
    1 + 16 * b[5 * i + 1] + 8 * b[5 * i + 2] + 4 * b[5 * i + 3] + 2 * b[5 * i + 4] + b[5 * i + 5], 1)), 'string_agg', '') AS payload_digest,
  CASE WHEN page_id IS DISTINCT FROM response THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM response THEN response END AS refers_to,
  true AS verified
FROM bits
"""

# The exact search; the codes' error bounds leave no neighbour out in practice.
_NEAREST = """
WITH v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND NOT list_contains(list_transform(embedding, lambda x: x IS NULL OR NOT isfinite(x)), true)
    AND list_contains(list_transform(embedding, lambda x: x <> 0), true)
), pairs AS (
  SELECT q.vec_id AS query_id, v.vec_id AS vec_id,
    sqrt(list_reduce(list_transform(range(1, len(q.e) + 1), lambda i: (q.e[i] - v.e[i]) * (q.e[i] - v.e[i])), lambda s, x: s + x)) AS score
  FROM (SELECT vec_id, min(e) AS e FROM v WHERE vec_id % 100 = 0 GROUP BY vec_id) AS q JOIN v ON q.vec_id <> v.vec_id AND len(q.e) = len(v.e)
), ranked AS (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id)::INTEGER AS rank, vec_id, score FROM pairs
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
"""

# All phrases spelled out, counted and cut; chr(11) to chr(13) are the other line breaks.
_COLLOCATIONS = """
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
    unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[.,;:!?' || chr(10) || chr(11) || chr(12) || chr(13) || ']')) AS piece
  FROM documents
), spans AS (
  SELECT lang, list_filter(regexp_split_to_array(piece, '[ ' || chr(9) || ']'), lambda w: w <> '') AS ws FROM pieces
), phrases AS (
  SELECT lang, size, unnest(list_transform(range(1, len(ws) - size + 2), lambda i: array_to_string(ws[i : i + size - 1], ' '))) AS phrase
  FROM spans, (SELECT unnest(range(1, 6)) AS size) AS sizes
), counts AS (
  SELECT lang, phrase, any_value(size) AS size, count(*) AS f FROM phrases GROUP BY lang, phrase
), totals AS (
  SELECT lang, sum(f)::BIGINT AS n FROM counts WHERE size = 1 GROUP BY lang
), candidates AS (
  SELECT lang, phrase, size, f AS a, string_split(phrase, ' ') AS ws FROM counts WHERE size >= 2 AND f >= 100
), cuts AS (
  SELECT *, unnest(range(1, size)) AS k FROM candidates
), scored AS (
  SELECT c.lang, c.phrase, c.a, c.k, x.f AS l, y.f AS r, t.n,
    ((1000 * c.a::HUGEINT * t.n::HUGEINT) // (x.f::HUGEINT * y.f::HUGEINT))::BIGINT AS score
  FROM cuts AS c JOIN totals AS t USING (lang)
    JOIN counts AS x ON x.lang = c.lang AND x.phrase = array_to_string(c.ws[1 : c.k], ' ')
    JOIN counts AS y ON y.lang = c.lang AND y.phrase = array_to_string(c.ws[c.k + 1 :], ' ')
), lowest AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), inner_parts AS (
  SELECT lang, a, size, ws, unnest(range(2, size)) AS m FROM candidates
), covers AS (
  SELECT lang, unnest(list_transform(range(1, size - m + 2), lambda i: array_to_string(ws[i : i + m - 1], ' '))) AS phrase, a AS f
  FROM inner_parts
), kept AS (
  SELECT * FROM lowest AS x
  WHERE NOT EXISTS (SELECT 1 FROM covers AS c WHERE c.lang = x.lang AND c.phrase = x.phrase AND 100 * c.f >= 100 * x.a)
), ranked AS (
  SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM kept
)
SELECT * FROM ranked WHERE rank <= 2000
"""

ORACLES = {
    "op2_nearest_neighbours": _NEAREST,
    "op4_chat_formatting": _chat(),
    "op10_warc": _WARC,
    "op12_collocations": _COLLOCATIONS,
}
