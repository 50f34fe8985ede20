"""SQL of the operators that SQL can express, beside their queries."""

from __future__ import annotations

# Whole shares of the sources of ``documents``; others get mixing.DEFAULT_SHARE.
SHARES = {f"src{i}": 1 + i % 5 for i in range(20)}

_COMPONENTS = """
reach AS (
  SELECT id, id AS r FROM nodes
  UNION SELECT x.id, l.b FROM reach x JOIN both_ways l ON x.r = l.a
),
lowest AS (SELECT id, min(r) AS component_id FROM reach GROUP BY id)
"""

_JOIN = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents
),
s AS (
  SELECT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')))
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s
  FROM w
),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (
  SELECT a, b FROM c JOIN n x ON c.a = x.doc_id JOIN n y ON c.b = y.doc_id WHERE 100 * c >= 75 * (x.n + y.n - c)
),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
nodes AS (SELECT doc_id AS id FROM documents),
""" + _COMPONENTS + """
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, l.component_id
FROM documents d LEFT JOIN n ON d.doc_id = n.doc_id JOIN lowest l ON d.doc_id = l.id
"""

_VECTORS = """
WITH RECURSIVE v AS (
  SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
),
links AS (
  SELECT x.id AS a, y.id AS b FROM v x JOIN v y ON x.id < y.id AND len(x.e) = len(y.e) WHERE list_cosine_similarity(x.e, y.e) >= 0.95
),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
nodes AS (SELECT vec_id AS id FROM embeddings),
""" + _COMPONENTS + """
SELECT e.vec_id, coalesce(k.n, 0) AS n_links, l.component_id, e.vec_id = l.component_id AS kept
FROM embeddings e JOIN lowest l ON e.vec_id = l.id LEFT JOIN (SELECT a, count(*) AS n FROM both_ways GROUP BY a) k ON e.vec_id = k.a
"""

# A recursion over the slots of a frame, for each phase in which the same sources are left.
_MIX = """
WITH RECURSIVE shares(source, n) AS (VALUES {shares}),
ranked AS (
  SELECT doc_id, source, coalesce('=' || source, '') AS k,
    row_number() OVER (PARTITION BY source ORDER BY md5(coalesce(CAST(doc_id AS VARCHAR), '')), doc_id) - 1 AS r
  FROM documents
),
blocks AS (
  SELECT k, coalesce(max(s.n), 1) AS share, (count(*) + 63) // 64 AS blocks
  FROM ranked LEFT JOIN shares s ON ranked.source = s.source GROUP BY k
),
cuts AS (SELECT 0 AS f UNION SELECT blocks // share FROM blocks UNION SELECT blocks // share + 1 FROM blocks),
phases AS (
  SELECT f, list(greatest(0, least(share, blocks - f * share)) ORDER BY k) AS m, sum(least(blocks, f * share)) AS beg,
    CAST(sum(greatest(0, least(share, blocks - f * share))) AS BIGINT) AS frame
  FROM cuts CROSS JOIN blocks GROUP BY f HAVING sum(greatest(0, least(share, blocks - f * share))) > 0
),
edf AS (
  SELECT f, m, beg, frame, CAST(0 AS BIGINT) AS t, list_transform(m, lambda x: CAST(0 AS BIGINT)) AS took, CAST(0 AS BIGINT) AS pick, CAST(0 AS BIGINT) AS nth FROM phases
  UNION ALL
  SELECT f, m, beg, frame, t + 1, list_transform(took, lambda n, s: CASE WHEN s = p THEN n + 1 ELSE n END), p, took[p]
  FROM (SELECT *, list_min(list_transform(range(1, len(m) + 1), lambda s: CASE WHEN took[s] < m[s] AND (took[s] * frame) // m[s] <= t
          THEN ((took[s] + 1) * frame + m[s] - 1) // m[s] * 100000 + s ELSE 9000000000000000 END)) % 100000 AS p
        FROM edf WHERE t < frame)
),
slots AS (
  SELECT f, beg, frame, CAST(m[pick] AS BIGINT) AS m, nth, t - 1 AS slot, list_extract((SELECT list(k ORDER BY k) FROM blocks), pick) AS k FROM edf WHERE t > 0
),
placed AS (
  SELECT r.doc_id, r.source, r.k, r.r // 64 AS block, r.r % 64 AS mix_row, b.share,
    (SELECT max(f) FROM phases p WHERE p.f <= (r.r // 64) // b.share) AS f
  FROM ranked r JOIN blocks b ON r.k = b.k
)
SELECT p.doc_id, p.source, CAST(p.block AS BIGINT) AS mix_block,
  CAST(s.beg + (p.block // p.share - p.f) * s.frame + (s.nth * s.frame) // s.m AS BIGINT) AS mix_release,
  CAST(s.beg + (p.block // p.share - p.f) * s.frame + ((s.nth + 1) * s.frame + s.m - 1) // s.m AS BIGINT) AS mix_deadline,
  CAST(s.beg + (p.block // p.share - p.f) * s.frame + s.slot AS BIGINT) AS mix_slot, CAST(p.mix_row AS BIGINT) AS mix_row
FROM placed p JOIN slots s ON s.f = p.f AND s.k = p.k AND s.nth = p.block % p.share
""".format(shares=", ".join(f"('{s}', {n})" for s, n in SHARES.items()))

_MANIFEST = """
WITH RECURSIVE
crc_table AS (
  SELECT list(list_reduce(list_concat([i], range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) ORDER BY i) AS t
  FROM range(256) r(i)
),
rows AS (
  SELECT doc_id, source, lang, n_chars, text, coalesce(n_chars IS NOT NULL AND xor(4294967295, list_reduce(
      list_concat([4294967295::BIGINT], list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
      lambda c, x: xor(t[(xor(c, x) & 255) + 1], c >> 8))) % 7 = 0, false) AS touched
  FROM documents, crc_table
),
fields AS (
  SELECT lang, doc_id, touched, unnest([0, 1]) AS more,
    list_transform([doc_id::VARCHAR, source, lang, (n_chars::HUGEINT + unnest([0, 1]))::VARCHAR, text],
      lambda x: CASE WHEN x IS NULL THEN '-' ELSE strlen(x)::VARCHAR || ':' || x END) AS f
  FROM rows
),
hashed AS (SELECT lang, doc_id, touched, more, sha256(array_to_string(f, '')) AS h FROM fields WHERE more = 0 OR touched),
leaves AS (
  SELECT a.lang, a.doc_id, a.h AS leaf, coalesce(b.h, a.h) AS start,
    row_number() OVER (PARTITION BY a.lang ORDER BY a.doc_id NULLS FIRST, a.h) - 1 AS pos
  FROM hashed a LEFT JOIN hashed b ON b.more = 1 AND a.doc_id = b.doc_id
  WHERE a.more = 0
),
nodes AS (
  SELECT lang, 0 AS lvl, pos, leaf AS d, count(*) OVER (PARTITION BY lang) AS n FROM leaves
  UNION ALL
  SELECT lang, lvl + 1, pos // 2, sha256(d || coalesce(beside, '')), (n + 1) // 2
  FROM (SELECT *, lead(d) OVER (PARTITION BY lang ORDER BY pos) AS beside FROM nodes WHERE n > 1) WHERE pos % 2 = 0
),
subroots AS (
  SELECT lang, d AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS place, count(*) OVER () AS n FROM nodes WHERE n = 1
),
top AS (
  SELECT 0 AS lvl, place AS pos, subroot AS d, n FROM subroots
  UNION ALL
  SELECT lvl + 1, pos // 2, sha256(d || coalesce(beside, '')), (n + 1) // 2
  FROM (SELECT *, lead(d) OVER (ORDER BY pos) AS beside FROM top WHERE n > 1) WHERE pos % 2 = 0
),
steps AS (
  SELECT l.lang, l.pos, k.lvl AS step, s.d, (l.pos >> k.lvl) & 1 = 1 AS after
  FROM leaves l JOIN (SELECT DISTINCT lang, lvl FROM nodes WHERE n > 1) k ON l.lang IS NOT DISTINCT FROM k.lang
  LEFT JOIN nodes s ON s.lang IS NOT DISTINCT FROM l.lang AND s.lvl = k.lvl AND s.pos = xor(l.pos >> k.lvl, 1)
  UNION ALL
  SELECT l.lang, l.pos, 1000 + k.lvl, s.d, (r.place >> k.lvl) & 1 = 1
  FROM leaves l JOIN subroots r ON l.lang IS NOT DISTINCT FROM r.lang CROSS JOIN (SELECT DISTINCT lvl FROM top WHERE n > 1) k
  LEFT JOIN top s ON s.lvl = k.lvl AND s.pos = xor(r.place >> k.lvl, 1)
),
proofs AS (SELECT lang, pos, list({'d': d, 'after': after} ORDER BY step) AS p FROM steps GROUP BY lang, pos),
folded AS (
  SELECT l.lang, l.doc_id, l.leaf, array_to_string(list_transform(p.p, lambda x: x.d), '') AS siblings,
    list_reduce(list_concat([{'d': l.start, 'after': false}], coalesce(p.p, [])), lambda a, x: {'d': sha256(
      CASE WHEN x.d IS NULL THEN a.d WHEN x.after THEN x.d || a.d ELSE a.d || x.d END), 'after': false}).d AS folded_root
  FROM leaves l LEFT JOIN proofs p ON l.lang IS NOT DISTINCT FROM p.lang AND l.pos = p.pos
)
SELECT f.doc_id, f.leaf, r.subroot, t.d AS root, sha256(coalesce(f.siblings, '')) AS proof_sha256, f.folded_root, f.folded_root = t.d AS verified
FROM folded f JOIN subroots r ON f.lang IS NOT DISTINCT FROM r.lang CROSS JOIN (SELECT d FROM top WHERE n = 1) t
"""

SQL = {"op6_mixing": _MIX, "op7_ngram_jaccard_join": _JOIN, "op10_embedding_near_dedup": _VECTORS, "op13_merkle_manifest": _MANIFEST}
