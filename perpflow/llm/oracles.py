"""DuckDB twins of the queries that plain SQL can express."""

from __future__ import annotations

#: Strings of 100 bytes as 200 hexadecimal digits; the first of equal strings in (doc_id, start) order stays.
REPEATS = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, unnest(range(0, len(h) // 2 - 99)) AS s, h FROM d WHERE len(h) >= 200),
k AS (SELECT doc_id, s, md5_number(substr(h, 2 * s + 1, 200)) AS g FROM w),
r AS (SELECT doc_id, s FROM k QUALIFY row_number() OVER (PARTITION BY g ORDER BY doc_id, s) > 1),
m AS (SELECT *, CASE WHEN s <= lag(s) OVER (PARTITION BY doc_id ORDER BY s) + 100 THEN 0 ELSE 1 END AS fresh FROM r),
i AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY s) AS run FROM m),
spans AS (SELECT doc_id, run, min(s) AS a, max(s) + 100 AS b FROM i GROUP BY doc_id, run),
cuts AS (SELECT doc_id, b AS a, coalesce(lead(a) OVER (PARTITION BY doc_id ORDER BY a), NULL) AS b FROM (SELECT doc_id, a, b FROM spans UNION ALL SELECT doc_id, -1, 0 FROM d)),
kept AS (SELECT c.doc_id, string_agg(substr(h, 2 * c.a + 1, 2 * (coalesce(c.b, len(h) // 2) - c.a)), '' ORDER BY c.a) AS h FROM cuts c JOIN d ON d.doc_id = c.doc_id GROUP BY c.doc_id),
sums AS (SELECT doc_id, sum(b - a) AS n, count(*) AS k FROM spans GROUP BY doc_id)
SELECT d.doc_id, (len(d.h) // 2)::BIGINT AS n_bytes, coalesce(sums.n, 0)::BIGINT AS n_removed, coalesce(sums.k, 0)::BIGINT AS n_spans,
  sha256(unhex(kept.h)) AS kept_sha256
FROM d JOIN kept ON kept.doc_id = d.doc_id LEFT JOIN sums ON sums.doc_id = d.doc_id"""

COMPONENTS = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) END AS sh FROM w),
e AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS g FROM s),
p AS (SELECT a.doc_id AS u, b.doc_id AS v, a.n AS nu, b.n AS nv, count(*) AS k FROM e a JOIN e b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT u, v FROM p WHERE 100 * k >= 80 * (nu + nv - k)),
both_ways AS (SELECT u, v FROM l UNION ALL SELECT v, u FROM l),
r AS (SELECT doc_id, doc_id AS c FROM s UNION SELECT b.v, r.c FROM r JOIN both_ways b ON b.u = r.doc_id)
SELECT s.doc_id, len(s.sh)::BIGINT AS n_shingles, min(r.c)::BIGINT AS component_id FROM s JOIN r ON r.doc_id = s.doc_id GROUP BY s.doc_id, len(s.sh)"""

NEAR_DUPLICATES = f"SELECT *, doc_id = component_id AS kept FROM ({COMPONENTS.replace('80 *', '85 *')})"

CHAT = r"""
WITH c AS (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
p AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) = 1 AS last,
   sum(15 + length(role) + length(replace(replace(replace(text, '\', '\\'), '#', '\#'), '</turn>', '\</turn>'))) OVER (PARTITION BY conv_id ORDER BY turn) AS chars FROM c)
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  (sum(chars) FILTER (WHERE role = 'assistant' OR last))::BIGINT AS formatted_chars
FROM p GROUP BY conv_id"""


def _crc32(number: str) -> str:
    """SQL of the unsigned crc32 of a number written in decimal."""
    step = "CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END"
    digits = f"list_transform(string_split(CAST({number} AS VARCHAR), ''), lambda s: CAST(ascii(s) AS BIGINT))"
    return (f"xor(list_reduce(list_prepend(4294967295::BIGINT, {digits}), "
            f"lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, i: {step})), 4294967295)")


TRIE = f"""
WITH RECURSIVE t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos,
    coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, count(*) AS own, {_crc32('conv_id')} % 9 AS h, conv_id - conv_id % 5 AS base FROM t GROUP BY conv_id),
p AS (SELECT c.*, least(c.h, coalesce(b.own, 0)) AS lent FROM c LEFT JOIN c b ON b.conv_id = c.base),
r AS (SELECT p.conv_id, t.pos, role, text FROM p JOIN t ON t.conv_id = p.base AND t.pos <= p.lent
  UNION ALL SELECT p.conv_id, t.pos - p.h + p.lent, role, text FROM p JOIN t ON t.conv_id = p.conv_id AND t.pos > p.h),
l AS (SELECT p.conv_id, count(r.pos) AS n FROM p LEFT JOIN r ON r.conv_id = p.conv_id GROUP BY p.conv_id),
x AS (SELECT conv_id, pos AS depth, octet_length(encode(text)) AS bytes,
    list({{'r': role, 't': text}}) OVER (PARTITION BY conv_id ORDER BY pos) AS path FROM r
  UNION ALL SELECT conv_id, 0, 0, [] FROM l),
g AS (SELECT depth, path, min(conv_id) AS rep, count(*) AS n_convs, min(bytes) AS bytes FROM x GROUP BY depth, path),
m AS (SELECT x.conv_id, x.depth, g.rep, g.n_convs, g.bytes FROM x JOIN g ON g.depth = x.depth AND g.path = x.path),
k AS (SELECT m.conv_id, m.depth, q.rep AS parent, m.n_convs, m.bytes FROM m LEFT JOIN m q ON q.conv_id = m.conv_id AND q.depth = m.depth - 1 WHERE m.conv_id = m.rep),
f AS (SELECT k.*, coalesce(s.n, 0) AS n_children FROM k LEFT JOIN (SELECT parent, depth - 1 AS depth, count(*) AS n FROM k WHERE depth > 0 GROUP BY ALL) s
  ON s.parent = k.conv_id AND s.depth = k.depth),
u AS (SELECT a.rep AS conv_id, a.depth, sum(CASE WHEN f.n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((f.n_convs - 1) * f.bytes) AS saved
  FROM f JOIN m a ON a.conv_id = f.conv_id AND a.depth <= f.depth GROUP BY ALL),
e AS (SELECT m.rep AS conv_id, m.depth, sha256(string_agg(CAST(m.conv_id AS VARCHAR), ',' ORDER BY m.conv_id)) AS h FROM m JOIN l ON l.conv_id = m.conv_id AND l.n = m.depth GROUP BY ALL)
SELECT f.conv_id, f.depth::BIGINT AS depth, f.parent AS parent_conv_id, f.n_convs::BIGINT AS n_convs, f.n_children::BIGINT AS n_children,
  u.n_leaves::BIGINT AS n_leaves, u.saved::BIGINT AS saved_tokens, coalesce(e.h, sha256('')) AS ends_sha256
FROM f JOIN u ON u.conv_id = f.conv_id AND u.depth = f.depth LEFT JOIN e ON e.conv_id = f.conv_id AND e.depth = f.depth"""


def _leaf(text: str) -> str:
    fields = ["doc_id", "source", "lang", "n_chars", text]
    parts = [f"CASE WHEN {f} IS NULL THEN '-' ELSE octet_length(encode(CAST({f} AS VARCHAR))) || ':' || CAST({f} AS VARCHAR) END" for f in fields]
    return f"sha256({' || '.join(parts)})"


MERKLE = f"""
WITH RECURSIVE d AS (SELECT doc_id, source, {_leaf('text')} AS leaf, {_leaf("replace(text, chr(10), '')")} AS other, {_crc32('doc_id')} % 2 = 0 AS hit FROM documents),
n AS (SELECT source, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS tree FROM (SELECT DISTINCT source FROM d)),
b AS (SELECT n.tree, row_number() OVER (PARTITION BY n.tree ORDER BY d.doc_id NULLS FIRST, leaf, other) - 1 AS idx, doc_id, leaf, CASE WHEN hit THEN other ELSE leaf END AS used
  FROM d JOIN n ON n.source IS NOT DISTINCT FROM d.source),
v AS (SELECT tree, 0 AS lvl, idx, leaf AS dig, count(*) OVER (PARTITION BY tree) AS c FROM b
  UNION ALL (SELECT tree, lvl, idx, dig, count(*) OVER (PARTITION BY tree) FROM
    (SELECT tree, lvl + 1 AS lvl, idx // 3 AS idx, sha256(string_agg(dig, '' ORDER BY idx)) AS dig FROM v WHERE c > 1 GROUP BY tree, lvl, idx // 3))),
s AS (SELECT tree, dig FROM v WHERE c = 1),
w AS (SELECT 0 AS lvl, tree AS idx, dig, count(*) OVER () AS c FROM s
  UNION ALL (SELECT lvl, idx, dig, count(*) OVER () FROM
    (SELECT lvl + 1 AS lvl, idx // 3 AS idx, sha256(string_agg(dig, '' ORDER BY idx)) AS dig FROM w WHERE c > 1 GROUP BY lvl, idx // 3))),
steps AS (SELECT b.tree, b.idx AS place, v.lvl, 0 AS upper, v.idx, v.dig, b.idx // CAST(pow(3, v.lvl) AS BIGINT) AS own FROM b JOIN v ON v.tree = b.tree AND v.c > 1
    AND v.idx // 3 = b.idx // CAST(pow(3, v.lvl + 1) AS BIGINT)
  UNION ALL SELECT b.tree, b.idx, w.lvl, 1, w.idx, w.dig, b.tree // CAST(pow(3, w.lvl) AS BIGINT) FROM b JOIN w ON w.c > 1
    AND w.idx // 3 = b.tree // CAST(pow(3, w.lvl + 1) AS BIGINT)),
sib AS (SELECT tree, place, upper, lvl, coalesce(string_agg(dig, '' ORDER BY idx) FILTER (WHERE idx < own), '') AS l,
    coalesce(string_agg(dig, '' ORDER BY idx) FILTER (WHERE idx > own), '') AS r FROM steps GROUP BY tree, place, upper, lvl),
paths AS (SELECT b.tree, b.idx, b.used, coalesce(list({{'l': sib.l, 'r': sib.r}} ORDER BY upper, lvl) FILTER (WHERE sib.l IS NOT NULL), []) AS p
  FROM b LEFT JOIN sib ON sib.tree = b.tree AND sib.place = b.idx GROUP BY b.tree, b.idx, b.used),
fold AS (SELECT tree, idx, 0 AS i, used AS dig, p FROM paths
  UNION ALL SELECT tree, idx, i + 1, sha256(p[i + 1].l || dig || p[i + 1].r), p FROM fold WHERE i < len(p))
SELECT b.doc_id, b.leaf, s.dig AS subroot, w.dig AS root, sha256(array_to_string(list_transform(f.p, lambda x: x.l || x.r), '')) AS proof_sha256,
  f.dig AS folded_root, f.dig = w.dig AS verified
FROM b JOIN s ON s.tree = b.tree JOIN fold f ON f.tree = b.tree AND f.idx = b.idx AND f.i = len(f.p) JOIN w ON w.c = 1"""
