"""Check SQL (DuckDB) of the corpus queries that SQL can express, written from their contracts."""

from __future__ import annotations

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

# turns whose text holds the end mark are escaped, all others are plain; roles are always escaped
CHAT = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), c AS (
  SELECT *, contains(text, '</turn>') AS marked,
    length(text) - length(replace(text, '\', '')) + (length(text) - length(replace(text, '###', ''))) // 3 + (length(text) - length(replace(text, '</turn>', ''))) // 7 AS marks,
    length(role) - length(replace(replace(role, '\', ''), ':', '')) + (length(role) - length(replace(role, '###', ''))) // 3 + (length(role) - length(replace(role, '</turn>', ''))) // 7 AS role_marks
  FROM t
), g AS (
  SELECT conv_id, count(*) AS n_turns,
    string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS said,
    coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn NULLS FIRST, role, text), '') AS learnt,
    sum(4 + length(role) + role_marks + 2 + length(text) + CASE WHEN marked THEN marks + 1 ELSE 0 END + 8) AS formatted_chars,
    max(CASE WHEN marked THEN 1 ELSE 0 END) AS escape_level
  FROM c GROUP BY conv_id
)
SELECT conv_id, n_turns, sha256(said) AS turns_sha256, length(learnt) AS loss_chars, sha256(learnt) AS loss_sha256,
  CAST(formatted_chars AS BIGINT) AS formatted_chars, CAST(escape_level AS INTEGER) AS escape_level FROM g
"""

HAMMING = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x > 0) AS bits FROM embeddings WHERE embedding IS NOT NULL),
p AS (
  SELECT q.vec_id AS query_id, v.vec_id, list_sum(list_transform(range(1, len(v.bits) + 1), lambda i: CASE WHEN q.bits[i] <> v.bits[i] THEN 1 ELSE 0 END)) AS distance
  FROM v AS q, v WHERE q.vec_id % 50 = 0
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank FROM p)
SELECT query_id, vec_id, CAST(distance AS INTEGER) AS distance, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 10
"""

VECTORS = """
WITH RECURSIVE v AS (
  SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS x FROM embeddings
), u AS (
  SELECT vec_id, x, sqrt(list_sum(list_transform(x, lambda a: a * a))) AS norm FROM v
  WHERE x IS NOT NULL AND NOT list_bool_or(list_transform(x, lambda a: a IS NULL OR isnan(a) OR isinf(a)))
), e AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM u AS a, u AS b
  WHERE a.vec_id <> b.vec_id AND a.norm > 0 AND b.norm > 0 AND list_dot_product(a.x, b.x) / (a.norm * b.norm) >= 0.95
), r(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
n AS (SELECT a, count(*) AS n FROM e GROUP BY a), m AS (SELECT a, min(b) AS low FROM r GROUP BY a)
SELECT v.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, least(v.vec_id, coalesce(m.low, v.vec_id)) AS component_id,
  least(v.vec_id, coalesce(m.low, v.vec_id)) = v.vec_id AS kept
FROM v LEFT JOIN n ON n.a = v.vec_id LEFT JOIN m ON m.a = v.vec_id
"""

NGRAMS = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}'), '[^\x20\x09-\x0D]+') AS words FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(words[i : least(i + 4, len(words))], ' ') AS gram
  FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 4, 1) + 1)) AS i FROM w WHERE len(words) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS both FROM s AS a JOIN s AS b ON a.gram = b.gram AND a.doc_id <> b.doc_id GROUP BY ALL
), e AS (
  SELECT o.a, o.b FROM o JOIN n AS x ON x.doc_id = o.a JOIN n AS y ON y.doc_id = o.b WHERE 100 * o.both >= 80 * (x.n + y.n - o.both)
), r(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
m AS (SELECT a, min(b) AS low FROM r GROUP BY a)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(w.doc_id, coalesce(m.low, w.doc_id)) AS component_id
FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN m ON m.a = w.doc_id
"""

LEVELS = 12  # of eight-ary foldings, more than any table here needs


def _tree_levels(name: str, levels: int = LEVELS) -> str:
    """From nodes ``name0`` (tree, pos, digest, n): all levels, each node's siblings, and walkers ``name_w0`` (id, tree, pos, x, sib) led up."""
    out = []
    for k in range(levels):
        out.append(f"""{name}{k + 1} AS (
  SELECT tree, pos // 8 AS pos, CASE WHEN n > 1 THEN sha256(string_agg(digest, '' ORDER BY pos)) ELSE any_value(digest) END AS digest, (n + 7) // 8 AS n
  FROM {name}{k} GROUP BY tree, pos // 8, n
), {name}_s{k} AS (
  SELECT tree, pos, n,
    coalesce(string_agg(digest, '') OVER (PARTITION BY tree, pos // 8 ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
    coalesce(string_agg(digest, '') OVER (PARTITION BY tree, pos // 8 ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r
  FROM {name}{k}
), {name}_w{k + 1} AS (
  SELECT id, w.tree, w.pos // 8 AS pos, CASE WHEN s.n > 1 THEN sha256(l || x || r) ELSE x END AS x, CASE WHEN s.n > 1 THEN sib || l || r ELSE sib END AS sib
  FROM {name}_w{k} AS w JOIN {name}_s{k} AS s ON w.tree = s.tree AND w.pos = s.pos
)""")
    return ", ".join(out)


def _field(name: str) -> str:
    return f"coalesce(octet_length(encode({name}::VARCHAR))::VARCHAR || ':' || {name}::VARCHAR, '-')"


_HEAD = " || ".join(_field(c) for c in ("doc_id", "source", "lang", "n_chars"))
_CRC32 = """xor(list_reduce(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT), lambda c, b:
    list_reduce(range(8), lambda s, i: CASE WHEN s & 1 = 1 THEN xor(s >> 1, 3988292384) ELSE s >> 1 END, xor(c, b)), 4294967295::BIGINT), 4294967295::BIGINT)"""

MERKLE = f"""
WITH d AS (
  SELECT doc_id, coalesce('=' || lang, '') AS tree, sha256({_HEAD} || {_field("text")}) AS leaf,
    CASE WHEN {_CRC32} % 3 = 0 THEN sha256({_HEAD} || {_field(f"translate(text, '{UPPER}', '{UPPER.lower()}')")}) END AS changed FROM documents
), p AS (
  SELECT *, row_number() OVER (ORDER BY tree, doc_id, leaf) AS id, row_number() OVER (PARTITION BY tree ORDER BY doc_id, leaf) - 1 AS pos, count(*) OVER (PARTITION BY tree) AS n FROM d
), a0 AS (SELECT tree, pos, leaf AS digest, n FROM p), a_w0 AS (SELECT id, tree, pos, coalesce(changed, leaf) AS x, '' AS sib FROM p),
{_tree_levels("a")},
b0 AS (SELECT '' AS tree, row_number() OVER (ORDER BY tree) - 1 AS pos, digest, count(*) OVER () AS n, tree AS name FROM a{LEVELS}),
b_w0 AS (SELECT w.id, '' AS tree, b0.pos, w.x, w.sib FROM a_w{LEVELS} AS w JOIN b0 ON b0.name = w.tree),
{_tree_levels("b")}
SELECT p.doc_id, p.leaf, b0.digest AS subroot, r.digest AS root, sha256(w.sib) AS proof_sha256, w.x AS folded_root, w.x = r.digest AS verified
FROM p JOIN b_w{LEVELS} AS w ON w.id = p.id JOIN b0 ON b0.name = p.tree, b{LEVELS} AS r
"""

SQL = {"op13_merkle_manifest": MERKLE, "op1_chat_format": CHAT, "op2_ngram_join": NGRAMS, "op4_hamming_topk": HAMMING, "op9_cap_filter_dedup": VECTORS}
