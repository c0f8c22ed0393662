"""DuckDB SQL of the operators of this subpackage that SQL can express."""

from __future__ import annotations

from kindred.llm.mixing import BLOCK, whole_weights
from kindred.llm.sharding import CELLS, VNODES

_HOST = r"translate(regexp_extract({0}, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_REST = "CASE WHEN instr({0}, '://') > 0 THEN substr({0}, instr({0}, '://') + 3) ELSE '' END"

#: Components over canonical and refresh links by a recursive walk; targets as absolute, "//" or "/" ones.
URL_FILTER = (
    r"""WITH RECURSIVE rules AS (SELECT r[1] AS verdict, r[2] AS rhost, r[3] AS rpath FROM (SELECT unnest([{{rules}}]) AS x), LATERAL (SELECT [x[1], x[2], x[3]] AS r)),
 p AS (SELECT page_id, url, coalesce({rest}, '') AS rest, regexp_extract(html, '<link\b[^>]*\brel\s*=\s*["'']?canonical\b[^>]*>', 0, 'i') AS link, regexp_extract(html, '<meta\b[^>]*\bhttp-equiv\s*=\s*["'']?refresh\b[^>]*>', 0, 'i') AS meta FROM pages),
 u AS (SELECT page_id, url, {host} AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path, nullif({host}, '') || regexp_extract(rest, '^[^/?#]+([^#]*)', 1) AS address, link, meta FROM p),
 t AS (SELECT address, host, unnest([regexp_extract(link, '\bhref\s*=\s*["'']?([^"''\s>]+)', 1, 'i'), regexp_extract(meta, '\burl\s*=\s*["'']?([^"''\s>]+)', 1, 'i')]) AS target FROM u),
 f AS (SELECT address AS a, CASE WHEN regexp_matches(target, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN target WHEN starts_with(target, '//') THEN 'http:' || target WHEN starts_with(target, '/') THEN 'http://' || host || target END AS target FROM t WHERE target <> '' AND address IS NOT NULL),
 e AS (SELECT DISTINCT a, {thost} || regexp_extract({trest}, '^[^/?#]+([^#]*)', 1) AS b FROM f WHERE target IS NOT NULL),
 pair AS (SELECT a, b FROM e WHERE a <> b UNION SELECT b, a FROM e WHERE a <> b),
 reach AS (SELECT a, a AS b FROM pair UNION SELECT r.a, x.b FROM reach r JOIN pair x ON r.b = x.a),
 named AS (SELECT address, host, path FROM u WHERE address IS NOT NULL UNION SELECT b, regexp_extract(b, '^[^/?#]*'), regexp_extract(b, '^[^/?#]*([^?#]*)', 1) FROM pair),
 ruled AS (SELECT address, rhost || rpath AS rule, verdict FROM named JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) QUALIFY row_number() OVER (PARTITION BY address ORDER BY length(rhost || rpath) DESC, verdict) = 1),
 blocked AS (SELECT DISTINCT reach.a AS address FROM reach JOIN ruled ON reach.b = ruled.address WHERE verdict = 'block')
 SELECT page_id, coalesce(host, '') AS host, coalesce(path, '') AS path, rule, coalesce(verdict, CASE WHEN address IN (SELECT address FROM blocked) THEN 'block' ELSE 'allow' END) AS verdict FROM u LEFT JOIN ruled USING (address)"""
).format(rest=_REST.format("url"), host=_HOST.format("rest"), trest=_REST.format("target"), thost=_HOST.format(_REST.format("target")))

#: CRC-32 of a text's bytes, from the table that follows from the polynomial.
_CRC_TABLE = "crc AS (SELECT list(v ORDER BY i) AS tb FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS v FROM range(256) r(i)))"
_CRC = "xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode({0})), '..'), lambda x: ('0x' || x)::BIGINT)), lambda a, b: xor(a >> 8, tb[1 + (xor(a, b) & 255)])), 4294967295)"


def SHARDING(shards: int) -> str:
    """Each hop takes waiting intervals of ranks in the order of their cells while their shard has room."""
    hops, placed = [], []
    for h in range(shards):
        before = "SELECT cell, 0::BIGINT AS lo, n AS hi FROM cells" if h == 0 else f"SELECT cell, lo + take AS lo, hi FROM t{h - 1} WHERE lo + take < hi"
        used = "0" if h == 0 else "coalesce((SELECT sum(take) FROM (" + " UNION ALL ".join(f"SELECT shard, take FROM t{k}" for k in range(h)) + ") z WHERE z.shard = s.shard), 0)"
        hops.append(
            f"w{h} AS ({before}), s{h} AS (SELECT s.shard, room, {used} AS used FROM shards s), "
            f"t{h} AS (SELECT w.cell, lo, hi, c.shard, used, coalesce(sum(hi - lo) OVER (PARTITION BY c.shard ORDER BY w.cell ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead, "
            f"greatest(0, least(hi - lo, room - used - ahead)) AS take FROM w{h} w JOIN clock c ON c.cell = w.cell AND c.hop = {h} JOIN s{h} s ON s.shard = c.shard)"
        )
        placed.append(f"SELECT cell, lo, lo + take AS hi, shard, used + ahead AS slot, {h} AS hops FROM t{h} WHERE take > 0")
    return f"""WITH {_CRC_TABLE},
 d AS (SELECT doc_id, octet_length(encode(coalesce(text, ''))) + 1 AS size, {_CRC.format("coalesce(text, '')")} AS text_crc32 FROM documents, crc),
 k AS (SELECT *, concat_ws('/', 'tie', text_crc32, size) AS ties FROM d),
 x AS (SELECT *, md5(coalesce(doc_id::VARCHAR, ties)) AS h, md5(ties) AS th, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, ties)), 1, 4))::BIGINT AS cell FROM k),
 ranked AS (SELECT *, row_number() OVER (PARTITION BY cell ORDER BY substr(th, 1, 2), h, doc_id::VARCHAR NULLS FIRST, th) - 1 AS r FROM x),
 cells AS (SELECT cell, count(*) AS n FROM x GROUP BY cell),
 shards AS (SELECT s.i AS shard, (SELECT count(*) FROM x) // {shards} + CASE WHEN s.i < (SELECT count(*) FROM x) % {shards} THEN 1 ELSE 0 END AS room FROM range({shards}) s(i)),
 nodes AS (SELECT s.i AS shard, ('0x' || substr(md5(s.i || '/' || v.i), 1, 4))::BIGINT AS pos FROM range({shards}) s(i), range({VNODES}) v(i)),
 clock AS (SELECT cell, shard, row_number() OVER (PARTITION BY cell ORDER BY min((pos - cell + {CELLS}) % {CELLS}), shard) - 1 AS hop FROM cells, nodes GROUP BY cell, shard),
 {", ".join(hops)},
 placed AS ({" UNION ALL ".join(placed)})
 SELECT doc_id, size, text_crc32, 'rows' AS law, p.shard::INT AS shard, CAST(p.slot + r - p.lo AS BIGINT) AS slot, NULL::INT AS grown_shard, c.shard::INT AS ring_shard, hops::INT AS hops
 FROM ranked JOIN placed p ON p.cell = ranked.cell AND r >= p.lo AND r < p.hi JOIN clock c ON c.cell = ranked.cell AND c.hop = 0"""


def MIXING(weights: dict, default: float = 1) -> str:
    """One step of the recursion takes one slot: earliest deadline first among released blocks."""
    whole = whole_weights({**weights, None: default})
    case = " ".join(f"WHEN 's{s}' THEN {w}" for s, w in whole.items() if s is not None)
    low = "start + (ks[i] * total) // ws[i]"
    due = "start + ((ks[i] + 1) * total + ws[i] - 1) // ws[i]"
    best = f"list_min(list_filter(list_transform(range(1, len(ws) + 1), lambda i: CASE WHEN lf[i] > 0 AND {low} <= t THEN {{'due': {due}, 'i': i, 'low': {low}}} END), lambda x: x IS NOT NULL))"
    live = "list_sum(list_transform(range(1, len(ws) + 1), lambda i: CASE WHEN {0} > 0 THEN ws[i] ELSE 0 END))"
    return f"""WITH RECURSIVE r AS (SELECT doc_id, source, coalesce('s' || source, 'n') AS s, row_number() OVER (PARTITION BY coalesce('s' || source, 'n') ORDER BY md5(concat_ws('/', 'mix', doc_id::VARCHAR)), doc_id) - 1 AS rk FROM documents),
 src AS (SELECT s, count(*) AS n, (count(*) + {BLOCK - 1}) // {BLOCK} AS nb, (CASE s {case} ELSE {whole[None]} END)::BIGINT AS w, row_number() OVER (ORDER BY s) AS i FROM r GROUP BY s),
 init AS (SELECT list(w ORDER BY i) AS ws, list(nb ORDER BY i) AS lf, list(0::BIGINT ORDER BY i) AS ks, list(0::BIGINT ORDER BY i) AS done, sum(w)::BIGINT AS total FROM src),
 run AS (SELECT 0::BIGINT AS t, 0::BIGINT AS start, 0 AS phase, ws, lf, ks, done, total, {best} AS pick FROM (SELECT *, 0::BIGINT AS t, 0::BIGINT AS start FROM init)
  UNION ALL
  SELECT t, start, phase, ws, lf, ks, done, total, {best} FROM (
   SELECT t + 1 AS t, CASE WHEN over THEN t + 1 ELSE start END AS start, phase + over::INT AS phase, ws, lf2 AS lf, CASE WHEN over THEN list_transform(ks, lambda k: 0::BIGINT) ELSE ks2 END AS ks, done2 AS done, CASE WHEN over THEN {live.format("lf2[i]")}::BIGINT ELSE total END AS total FROM (
    SELECT *, lf[pick.i] = 1 AS over, list_transform(lf, lambda v, j: v - (j = pick.i)::INT) AS lf2, list_transform(ks, lambda v, j: v + (j = pick.i)::INT) AS ks2, list_transform(done, lambda v, j: v + (j = pick.i)::INT) AS done2 FROM run WHERE pick IS NOT NULL)) WHERE list_sum(lf) > 0),
 slots AS (SELECT t, pick.i AS i, done[pick.i] AS blk, pick.low AS low, pick.due AS due, phase FROM run WHERE pick IS NOT NULL),
 sized AS (SELECT slots.*, s, coalesce(sum(least({BLOCK}, n - blk * {BLOCK})) OVER (ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM slots JOIN src USING (i))
 SELECT doc_id, source, t AS mix_slot, blk AS mix_block, low AS mix_release, due AS mix_deadline, phase::INT AS mix_phase, CAST(before + rk % {BLOCK} AS BIGINT) AS mix_position FROM r JOIN sized ON r.s = sized.s AND r.rk // {BLOCK} = blk"""
