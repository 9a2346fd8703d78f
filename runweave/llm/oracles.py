"""DuckDB SQL with the rows of the queries over trees and repeated strings."""

from __future__ import annotations

WORDS = r"[^\x20\x09-\x0D]+"


def crc32_sql(text: str) -> str:
    """Unsigned CRC-32 of an ASCII text, bit by bit."""
    byte = "list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))"
    codes = f"list_transform(string_split({text}, ''), lambda c: ascii(c)::BIGINT)"
    return f"xor(list_reduce(list_concat([4294967295::BIGINT], {codes}), lambda a, b: {byte}), 4294967295)"


def _leaf(size: str) -> str:
    fields = [f"coalesce(octet_length(encode({f}::VARCHAR))::VARCHAR || ':' || {f}::VARCHAR, '-')" for f in ("doc_id", "source", "lang", size, "text")]
    return f"sha256({' || '.join(fields)})"


MANIFEST_SQL = f"""
WITH RECURSIVE leaves AS (
  SELECT doc_id, coalesce('=' || lang, '') AS part, {_leaf("n_chars")} AS leaf,
         CASE WHEN {crc32_sql("doc_id::VARCHAR")} % 7 = 0 THEN {_leaf("(n_chars + 1)")} END AS tampered
  FROM documents),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY part ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY part) AS n FROM leaves),
nodes AS (
  SELECT part, 0 AS lvl, idx, n, leaf AS node FROM placed
  UNION ALL
  SELECT part, lvl + 1, idx // 2, any_value(n + 1) // 2, sha256(string_agg(node, '' ORDER BY idx)) FROM nodes WHERE n > 1 GROUP BY part, lvl, idx // 2),
parts AS (SELECT part, node AS subroot, row_number() OVER (ORDER BY encode(part)) - 1 AS idx, count(*) OVER () AS n FROM nodes WHERE n = 1),
tops AS (
  SELECT 0 AS lvl, idx, n, subroot AS node FROM parts
  UNION ALL
  SELECT lvl + 1, idx // 2, any_value(n + 1) // 2, sha256(string_agg(node, '' ORDER BY idx)) FROM tops WHERE n > 1 GROUP BY lvl, idx // 2),
heights AS (SELECT part, max(lvl) AS height FROM nodes GROUP BY part),
tree AS (
  SELECT part, lvl, idx, node FROM nodes WHERE n > 1
  UNION ALL
  SELECT p.part, h.height + t.lvl, t.idx, t.node FROM parts p JOIN heights h USING (part), tops t WHERE t.n > 1),
way AS (
  SELECT p.part, p.idx AS leaf_idx, p.doc_id, p.leaf, s.subroot, 0 AS lvl, p.idx AS slot, h.height, s.idx AS part_idx, coalesce(p.tampered, p.leaf) AS folded, '' AS proof
  FROM placed p JOIN parts s USING (part) JOIN heights h USING (part)
  UNION ALL
  SELECT part, leaf_idx, doc_id, leaf, subroot, lvl + 1, slot // 2, height, part_idx,
         CASE WHEN sib IS NULL THEN sha256(folded) WHEN slot % 2 = 1 THEN sha256(sib || folded) ELSE sha256(folded || sib) END, proof || coalesce(sib, '')
  FROM (
    SELECT w.* EXCLUDE (slot), CASE WHEN w.lvl = w.height THEN w.part_idx ELSE w.slot END AS slot, t.node AS sib, (SELECT max(lvl) FROM tops) AS top
    FROM way w LEFT JOIN tree t ON t.part = w.part AND t.lvl = w.lvl AND t.idx = xor(CASE WHEN w.lvl = w.height THEN w.part_idx ELSE w.slot END, 1)
    WHERE w.lvl < w.height + (SELECT max(lvl) FROM tops))),
root AS (SELECT node AS root FROM tops WHERE n = 1)
SELECT w.doc_id, w.leaf, w.subroot, r.root, sha256(w.proof) AS proof_sha256, w.folded AS folded_root, w.folded = r.root AS verified
FROM way w, root r WHERE w.lvl = w.height + (SELECT max(lvl) FROM tops)
"""

TRIE_SQL = f"""
WITH RECURSIVE turns AS (
  SELECT conv_id AS conv, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
convs AS (SELECT conv, conv - conv % 20 AS base, {crc32_sql("conv::VARCHAR")} % 4 AS h, count(*) AS turns FROM turns GROUP BY conv),
known AS (SELECT c.*, least(c.h, coalesce(b.turns, 0)) AS k FROM convs c LEFT JOIN convs b ON b.conv = c.base),
built AS (
  SELECT c.conv, t.pos AS depth, t.role, t.text FROM known c JOIN turns t ON t.conv = c.base AND t.pos <= c.h
  UNION ALL
  SELECT c.conv, t.pos - c.h + c.k, t.role, t.text FROM known c JOIN turns t ON t.conv = c.conv AND t.pos > c.h),
ways AS (
  SELECT conv, 0 AS depth, sha256('') AS node, 0 AS words FROM known
  UNION ALL
  SELECT w.conv, b.depth, sha256(w.node || ':' || octet_length(encode(b.role)) || ':' || b.role || b.text), len(regexp_extract_all(b.text, '{WORDS}'))
  FROM ways w JOIN built b ON b.conv = w.conv AND b.depth = w.depth + 1),
stops AS (SELECT conv, max(depth) AS len FROM ways GROUP BY conv),
nodes AS (
  SELECT w.depth, w.node, min(w.conv) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(w.words) AS saved,
         sha256(coalesce(string_agg(w.conv::VARCHAR, ',' ORDER BY w.conv) FILTER (WHERE w.depth = s.len), '')) AS ends_sha256
  FROM ways w JOIN stops s USING (conv) GROUP BY w.depth, w.node),
linked AS (
  SELECT n.*, p.conv_id AS parent_conv_id
  FROM nodes n LEFT JOIN ways w ON w.conv = n.conv_id AND w.depth = n.depth - 1 LEFT JOIN nodes p ON p.depth = w.depth AND p.node = w.node),
counted AS (SELECT l.*, (SELECT count(*) FROM linked c WHERE c.depth = l.depth + 1 AND c.parent_conv_id = l.conv_id) AS n_children FROM linked l),
up AS (
  SELECT a.depth, a.node, sum(CASE WHEN d.n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum(d.saved) AS saved_tokens
  FROM counted d JOIN ways a ON a.conv = d.conv_id AND a.depth <= d.depth GROUP BY a.depth, a.node)
SELECT c.conv_id, c.depth::BIGINT AS depth, c.parent_conv_id, c.n_convs::BIGINT AS n_convs, c.n_children::BIGINT AS n_children,
       u.n_leaves::BIGINT AS n_leaves, u.saved_tokens::BIGINT AS saved_tokens, c.ends_sha256
FROM counted c JOIN up u USING (depth, node)
"""

#: Bytes are two hexadecimal digits each, so that strings of bytes can be cut at any place.
REPEATS_SQL = """
WITH docs AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS digits, octet_length(encode(coalesce(text, ''))) AS n_bytes, row_number() OVER (ORDER BY doc_id NULLS FIRST) AS no FROM documents),
starts AS (SELECT no, digits, unnest(range(n_bytes - 99)) AS pos FROM docs WHERE n_bytes >= 100),
strings AS (SELECT no, pos, md5(substr(digits, 2 * pos + 1, 200)) AS string FROM starts),
repeated AS (SELECT no, pos FROM (SELECT no, pos, row_number() OVER (PARTITION BY string ORDER BY no, pos) AS nth FROM strings) WHERE nth > 1),
marked AS (SELECT no, pos, CASE WHEN pos - lag(pos) OVER (PARTITION BY no ORDER BY pos) <= 100 THEN 0 ELSE 1 END AS begins FROM repeated),
runs AS (
  SELECT no, min(pos) AS a, max(pos) + 100 AS b FROM (SELECT *, sum(begins) OVER (PARTITION BY no ORDER BY pos) AS run FROM marked) GROUP BY no, run),
gaps AS (
  SELECT no, coalesce(lag(b) OVER (PARTITION BY no ORDER BY a), 0) AS a, a AS b FROM runs
  UNION ALL SELECT d.no, coalesce(max(r.b), 0), any_value(d.n_bytes) FROM docs d LEFT JOIN runs r USING (no) GROUP BY d.no),
kept AS (SELECT g.no, string_agg(substr(d.digits, 2 * g.a + 1, 2 * (g.b - g.a)), '' ORDER BY g.a, g.b) AS digits FROM gaps g JOIN docs d USING (no) GROUP BY g.no),
sums AS (SELECT no, sum(b - a) AS n_removed, count(*) AS n_spans FROM runs GROUP BY no)
SELECT d.doc_id, d.n_bytes::BIGINT AS n_bytes, coalesce(s.n_removed, 0)::BIGINT AS n_removed, coalesce(s.n_spans, 0)::BIGINT AS n_spans, sha256(unhex(k.digits)) AS kept_sha256
FROM docs d JOIN kept k USING (no) LEFT JOIN sums s USING (no)
"""
