"""The registered ``opN`` queries, with DuckDB SQL for those that SQL can express; tests hold the others against brute force."""

from __future__ import annotations

from . import cdc, chat, decontaminate, ego, lm, packing, separators, simhash, suffixes, toxicity

QUERIES = {
    "op1_ngram_lm": lm.query,
    "op2_latent_decontamination": decontaminate.query,
    "op3_separator_scan": separators.query,
    "op4_gear_chunks": cdc.query,
    "op5_sum_of_squares_packing": packing.query,
    "op6_suffix_merge": suffixes.query,
    "op7_simhash": simhash.query,
    "op8_chat_roundtrip": chat.query,
    "op9_toxicity": toxicity.query,
    "op10_ego_join": ego.query,
}

#: The template of ``chat``: control strings get a backslash behind the first two characters.
_CHAT = r'''WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, k, r, '<|im_end|><|im_start|>assistant ok' FROM (VALUES (0, 'user'), (1, 'assistant')) v(k, r)),
w AS (SELECT *, regexp_replace(text, '<\|(\\*)(im_start|im_end)\|>', '<|\\\1\2|>', 'g') AS written,
  CASE WHEN contains(role, chr(92)) OR contains(role, chr(10)) OR regexp_matches(role, '<\|(\\*)(im_start|im_end)\|>')
       THEN regexp_replace(replace(replace(role, chr(92), chr(92) || chr(92)), chr(10), chr(92) || 'n'), '<\|(\\*)(im_start|im_end)\|>', '<|\\\1\2|>', 'g') ELSE role END AS head FROM t)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length(head) + length(written) + length('<|im_start|>' || chr(10) || '<|im_end|>' || chr(10))) AS BIGINT) AS formatted_chars
FROM w GROUP BY conv_id'''

_VECTORS = '''WITH RECURSIVE v AS MATERIALIZED (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
u AS MATERIALIZED (SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS size FROM v
  WHERE len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_dot_product(e, e) > 0),
l AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_dot_product(a.e, b.e) / a.size / b.size >= 0.9),
r AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b),
c AS (SELECT a AS vec_id, min(b) AS component_id FROM r GROUP BY a), n AS (SELECT a AS vec_id, count(*) AS n FROM l GROUP BY a)
SELECT v.vec_id, coalesce(n.n, 0) AS n_links, c.component_id, v.vec_id = c.component_id AS kept FROM v JOIN c USING (vec_id) LEFT JOIN n USING (vec_id)'''

#: Windows of 100 bytes are taken from stretches of 1,000, as substrings of very long strings are slow.
_REPEATS = '''WITH d AS MATERIALIZED (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
c AS (SELECT doc_id, 1000 * k AS base, substr(h, 1 + 2000 * k, 2198) AS part FROM (SELECT doc_id, h, unnest(range(CAST(greatest(ceil((length(h) / 2 - 99) / 1000), 0) AS BIGINT))) AS k FROM d)),
w AS MATERIALIZED (SELECT doc_id, base + i AS s, md5_number(substr(part, 1 + 2 * i, 200)) AS x FROM (SELECT doc_id, base, part, unnest(range(least(1000, length(part) // 2 - 99))) AS i FROM c)),
f AS (SELECT x, min((doc_id, s)) AS first FROM w GROUP BY x HAVING count(*) > 1),
l AS MATERIALIZED (SELECT doc_id, s FROM w JOIN f USING (x) WHERE (doc_id, s) <> first),
e AS (SELECT doc_id, s, s > max(s + 100) OVER (PARTITION BY doc_id ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS apart FROM l),
g AS (SELECT doc_id, s, sum(CASE WHEN apart IS DISTINCT FROM false THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY s) AS k FROM e),
sp AS MATERIALIZED (SELECT doc_id, k, min(s) AS a, max(s) + 100 AS b FROM g GROUP BY doc_id, k),
kept AS (SELECT doc_id, a AS upto, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS since FROM sp UNION ALL SELECT d.doc_id, length(h) // 2, coalesce(max(b), 0) FROM d LEFT JOIN sp USING (doc_id) GROUP BY d.doc_id, h)
SELECT d.doc_id, length(any_value(h)) // 2 AS n_bytes, length(any_value(h)) // 2 - CAST(sum(upto - since) AS BIGINT) AS n_removed, count(*) - 1 AS n_spans,
  sha256(unhex(string_agg(substr(h, 1 + 2 * since, 2 * (upto - since)), '' ORDER BY since, upto))) AS kept_sha256 FROM d JOIN kept USING (doc_id) GROUP BY d.doc_id'''

ORACLES: dict[str, str] = {"op6_suffix_merge": _REPEATS, "op8_chat_roundtrip": _CHAT, "op10_ego_join": _VECTORS}
