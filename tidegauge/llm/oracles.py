"""DuckDB SQL of the queries that SQL can express."""

from __future__ import annotations

import string

WORD = r"'[^\x20\x09-\x0D]+'"
TERM = r"'[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'"
_LOWER = f"translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}')"


def _reach(links: str, nodes: str) -> str:
    """Components of ``links(u, v)``, given both ways, over ``nodes(u)``."""
    return f"""reach AS (SELECT u, u AS r FROM {nodes} UNION SELECT l.u, reach.r FROM reach JOIN {links} l ON l.v = reach.u),
comp AS (SELECT u, min(r) AS component_id FROM reach GROUP BY 1)"""


ORACLES: dict[str, str] = {}

ORACLES["op1_ngram_jaccard"] = f"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER}, {WORD}) AS w FROM documents),
s AS (SELECT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM w WHERE len(w) >= 5)
  UNION SELECT doc_id, array_to_string(w, ' ') FROM w WHERE len(w) BETWEEN 1 AND 4),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS shared FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT u, v FROM p JOIN n a ON a.doc_id = u JOIN n b ON b.doc_id = v WHERE 100 * shared >= 75 * (a.n + b.n - shared)),
nodes AS (SELECT DISTINCT doc_id AS u FROM documents),
{_reach('links', 'nodes')}
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, component_id FROM documents d LEFT JOIN n USING (doc_id) JOIN comp ON comp.u = d.doc_id"""

ORACLES["op3_mixing"] = f"""WITH z AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), {WORD}))::BIGINT AS size FROM documents),
t AS (SELECT source, sum(size)::BIGINT AS source_size FROM z GROUP BY 1),
a AS (SELECT *, [3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS w, (source_size * 2)::DOUBLE AS cap,
  sum(source_size) OVER ()::DOUBLE * 1.5::DOUBLE AS budget FROM t),
l AS (SELECT *, row_number() OVER f AS place, (budget - coalesce(sum(cap) OVER (f ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(w) OVER (f ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM a WINDOW f AS (ORDER BY cap / w, source NULLS LAST)),
g AS (SELECT source, source_size, budget, least(cap, coalesce((SELECT arg_min(level, place) FROM l WHERE level <= cap / w) * w, cap)) AS target FROM l),
q AS (SELECT z.doc_id, z.size, source_size, target, budget, sum(z.size) OVER (PARTITION BY z.source ORDER BY md5(z.doc_id::VARCHAR || 'mix'), z.doc_id, z.size ROWS UNBOUNDED PRECEDING)::BIGINT AS e
  FROM z JOIN g ON z.source IS NOT DISTINCT FROM g.source),
v AS (SELECT q.*, (e + k * source_size) / target AS fin FROM q, range(2) r(k) WHERE size > 0 AND target > 0),
c AS (SELECT max(fin) AS cut FROM (SELECT fin, budget, sum(size) OVER (ORDER BY fin) AS total FROM v) WHERE total <= budget)
SELECT doc_id, size, source_size, target, (CASE WHEN target > 0 AND cut IS NOT NULL THEN
  (CASE WHEN e / target <= cut THEN size ELSE 0 END) + (CASE WHEN (e + source_size) / target <= cut THEN size ELSE 0 END) ELSE 0 END)::BIGINT AS taken FROM q, c"""

_SAID = r"'\### Assistant: </turn> ok'"
ORACLES["op4_chat"] = f"""WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', {_SAID} UNION ALL SELECT -7, 1, 'assistant', {_SAID})
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length('<|turn:' || role || '|>') + length(replace(replace(text, '<\\', '<\\\\'), '<|', '<\\|')) + length('<|end|>'))::BIGINT AS formatted_chars
FROM t GROUP BY 1""".replace("\\\\", "\\")

ORACLES["op5_warc_fixity"] = """WITH r AS (SELECT page_id, floor(page_id / 4096)::BIGINT AS shard,
  'WARC/1.1' || n || 'WARC-Type: response' || n || 'WARC-Record-ID: <urn:page:' || page_id || '>' || n || 'WARC-Target-URI: ' || coalesce(url, '') || n
  || 'Content-Type: text/html' || n || 'Content-Length: ' || strlen(coalesce(html, '')) || n || n || coalesce(html, '') || n || n AS record
  FROM pages, (SELECT chr(13) || chr(10) AS n)),
h AS (SELECT page_id, shard, strlen(record)::BIGINT AS length, sha256(record) AS sha256 FROM r)
SELECT page_id, shard, (sum(length) OVER (PARTITION BY shard ORDER BY page_id, sha256 ROWS UNBOUNDED PRECEDING) - length)::BIGINT AS "offset", length, sha256,
  (page_id % 89 = 7) AS damaged FROM h"""

ORACLES["op7_embedding_dedup"] = f"""WITH RECURSIVE e AS (SELECT vec_id, embedding::DOUBLE[] AS x, label FROM embeddings),
links AS (SELECT a.vec_id AS u, b.vec_id AS v FROM e a JOIN e b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.x, b.x) >= 0.93),
n AS (SELECT u, count(*) AS n FROM links GROUP BY 1),
nodes AS (SELECT vec_id AS u FROM e),
{_reach('links', 'nodes')}
SELECT vec_id, coalesce(n.n, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept FROM e LEFT JOIN n ON n.u = vec_id JOIN comp ON comp.u = vec_id"""

ORACLES["op9_substring_dedup"] = f"""WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), {WORD}) AS w FROM documents),
g AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM w WHERE len(w) >= 50)),
f AS (SELECT g, min(doc_id) AS m FROM g GROUP BY 1 HAVING min(doc_id) < max(doc_id)),
c AS (SELECT DISTINCT doc_id, i + k AS i FROM g JOIN f USING (g), range(50) t(k) WHERE m < doc_id),
a AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS x FROM w),
k AS (SELECT a.doc_id, string_agg(x, ' ' ORDER BY a.i) AS kept, count(*) AS n FROM a ANTI JOIN c ON a.doc_id = c.doc_id AND a.i = c.i GROUP BY 1)
SELECT w.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(k.n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN k USING (doc_id)"""

ORACLES["op11_fill_in_middle"] = r"""WITH t AS (SELECT doc_id, coalesce(text, '') AS x, sha256('1:' || doc_id) AS h FROM documents),
d AS (SELECT doc_id, x, length(x)::BIGINT AS n, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM t),
f AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
  CASE WHEN n = 0 OR contains(x, '<P>') OR contains(x, '<S>') OR contains(x, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM d),
p AS (SELECT *, '<P>' || substr(x, 1, a) AS p, '<M>' || substr(x, a + 1, b - a) AS m, '<S>' || substr(x, b + 1) AS s FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN x WHEN 'psm' THEN p || s || m ELSE s || p || m END) AS output_sha256, sha256(x) AS restored_sha256 FROM p"""

ORACLES["op12_lexical_search"] = rf"""WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, {TERM}) AS w FROM documents),
b AS (SELECT DISTINCT item_id, unnest(regexp_extract_all({_LOWER}, {TERM})) AS t FROM benchmark),
n AS (SELECT count(*)::BIGINT AS n_docs, sum(len(w))::BIGINT AS n_terms FROM d WHERE len(w) > 0),
u AS (SELECT doc_id, n, t, count(*)::BIGINT AS tf FROM (SELECT doc_id, len(w)::BIGINT AS n, unnest(w) AS t FROM d) GROUP BY ALL),
k AS (SELECT t, count(*) AS df FROM u WHERE t IN (SELECT t FROM b) GROUP BY 1),
g AS (SELECT t, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS w FROM k, n),
s AS (SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * u.n * n_docs) // n_terms))))::BIGINT AS score FROM b JOIN g USING (t) JOIN u USING (t), n GROUP BY 1, 2)
SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INT AS rank, doc_id, score FROM s WHERE score > 0
QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 10"""
