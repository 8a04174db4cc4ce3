"""DuckDB SQL for the queries that SQL can express on whole tables."""

from __future__ import annotations

from tidemark.llm.chat import CONTROL, END, TEXT, TURN


def _regex(text: str) -> str:
    return "".join("\\" + c if c in "\\|[]/<>.^$*+?(){}" and c not in "<>/" else c for c in text)


_ESCAPED = "|".join(["\\\\", *map(_regex, CONTROL)]).replace("'", "''")
_ORDER = "ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST"

CHAT = f"""WITH t AS (
  SELECT conv_id, turn, role, text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(coalesce(role, '') || chr(10) || coalesce(text, '') || chr(10), '' {_ORDER})) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(coalesce(text, ''), '' {_ORDER}) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum({len(TURN + TEXT + END)} + length(coalesce(role, '')) + length(coalesce(text, ''))
    + len(regexp_extract_all(coalesce(role, ''), '{_ESCAPED}')) + len(regexp_extract_all(coalesce(text, ''), '{_ESCAPED}')))::BIGINT AS formatted_chars
FROM t GROUP BY conv_id"""

LINKS = """WITH RECURSIVE v AS (
  SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.9),
reach AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b),
least AS (SELECT a, min(b) AS c FROM reach GROUP BY a)
SELECT vec_id, (SELECT count(*) FROM links WHERE links.a = vec_id) AS n_links, coalesce(c, vec_id) AS component_id, vec_id = coalesce(c, vec_id) AS kept
FROM embeddings LEFT JOIN least ON least.a = vec_id"""

WORDS = """WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
win AS (SELECT doc_id, k, array_to_string(ws[k : k + 12], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS k FROM w)),
first AS (SELECT g, min(doc_id) AS m FROM win GROUP BY g),
gone AS (SELECT DISTINCT doc_id, unnest(range(k, k + 13)) AS p FROM win JOIN first USING (g) WHERE m < doc_id),
words AS (SELECT doc_id, unnest(ws) AS x, unnest(range(1, len(ws) + 1)) AS p FROM w),
kept AS (SELECT words.doc_id, count(*) AS n, string_agg(x, ' ' ORDER BY words.p) AS t FROM words LEFT JOIN gone ON gone.doc_id = words.doc_id AND gone.p = words.p WHERE gone.p IS NULL GROUP BY words.doc_id)
SELECT doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (doc_id)"""

BYTES = """WITH h AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
win AS (SELECT doc_id, k, substr(x, 2 * k + 1, 100) AS g FROM (SELECT doc_id, x, unnest(range(0, length(x) // 2 - 49)) AS k FROM h)),
first AS (SELECT g, min(doc_id) AS m FROM win GROUP BY g),
hits AS (SELECT doc_id, k, coalesce(k > lag(k) OVER (PARTITION BY doc_id ORDER BY k) + 50, true) AS new FROM win JOIN first USING (g) WHERE m < doc_id),
runs AS (SELECT doc_id, min(k) AS a, max(k) + 50 AS b FROM (SELECT doc_id, k, sum(new::INT) OVER (PARTITION BY doc_id ORDER BY k) AS i FROM hits) GROUP BY doc_id, i),
per AS (SELECT doc_id, count(*) AS n, sum(b - a) AS gone, list_concat([0], list(b ORDER BY a)) AS starts, list(a ORDER BY a) AS stops FROM runs GROUP BY doc_id),
parts AS (SELECT doc_id, x, unnest(starts) AS s, unnest(list_append(stops, length(x) // 2)) AS e FROM per JOIN h USING (doc_id)),
kept AS (SELECT doc_id, string_agg(substr(x, 2 * s + 1, 2 * (e - s)), '' ORDER BY s) AS t FROM parts GROUP BY doc_id)
SELECT doc_id, (length(x) // 2)::BIGINT AS n_bytes, coalesce(gone, 0)::BIGINT AS n_removed, coalesce(n, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(t, x))) AS kept_sha256
FROM h LEFT JOIN per USING (doc_id) LEFT JOIN kept USING (doc_id)"""


def oracle_sql() -> dict[str, str]:
    return {"op2_pivots": LINKS, "op3_chat_masks": CHAT, "op6_block_anchors": WORDS, "op9_column_suffixes": BYTES}
