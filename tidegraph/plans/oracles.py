"""DuckDB SQL for the graph engine's queries, over the same tables."""

from tidegraph.functions.codecs import MOVED_1047, MOVED_LATIN

#: Blocks, units, terminators and edges of the program encoding.
BASE = """
WITH RECURSIVE b AS (
  SELECT user_id AS unit, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id)::BIGINT - 1 AS pos, event_id, event_type,
         CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events),
x AS (SELECT *, k % 4 AS cell, k % 3 AS action, (k + 1) % 4 AS source, upper(event_type) AS literal FROM b),
l AS (SELECT unit, max(pos) AS last FROM b GROUP BY unit),
t AS (
  SELECT unit, pos, CASE event_type WHEN 'click' THEN 'BRANCH_TRUE' WHEN 'error' THEN CASE WHEN k % 10 = 0 THEN 'HALT' ELSE 'INVOKE_NORMAL' END ELSE 'JUMP' END AS kind,
         CASE WHEN event_type = 'signup' AND k % 10 = 0 AND pos > k % 5 THEN pos - k % 5 ELSE pos + 1 END AS target FROM b
  UNION ALL SELECT unit, pos, 'BRANCH_FALSE', pos + 2 + k % 3 FROM b WHERE event_type = 'click'),
e AS (
  SELECT t.unit, pos AS src, CASE WHEN kind = 'HALT' THEN -2 WHEN target > last THEN -1 ELSE target END::BIGINT AS dst,
         CASE WHEN kind <> 'HALT' AND target > last THEN 'RETURN' ELSE kind END AS kind FROM t JOIN l USING (unit)),
i AS (SELECT DISTINCT unit, src, dst FROM e WHERE dst >= 0),
r AS (SELECT unit, 0::BIGINT AS pos FROM l UNION SELECT i.unit, i.dst FROM r JOIN i ON i.unit = r.unit AND i.src = r.pos)
"""
#: Values with the block that made them: a fact of cell -1 says that a block is reached.
SUPPORT = """,
vs(unit, pos, cell, val, prod) AS (
  SELECT unit, 0::BIGINT, c, CASE WHEN c = -1 THEN '' ELSE '?' END, -1::BIGINT FROM l, (SELECT unnest([-1, 0, 1, 2, 3])::BIGINT AS c)
  UNION
  SELECT i.unit, i.dst, o.cell, o.val, o.prod
  FROM vs JOIN x ON x.unit = vs.unit AND x.pos = vs.pos JOIN i ON i.unit = vs.unit AND i.src = vs.pos,
       LATERAL (SELECT vs.cell AS cell, vs.val AS val, vs.prod AS prod WHERE vs.cell = -1 OR vs.cell <> x.cell
                UNION ALL SELECT x.cell, CASE WHEN x.action = 0 THEN x.literal ELSE '?' END, x.pos WHERE vs.cell = -1 AND x.action <> 1
                UNION ALL SELECT x.cell, vs.val, vs.prod WHERE x.action = 1 AND vs.cell = x.source) o),
v AS (SELECT DISTINCT unit, pos, cell, val FROM vs WHERE cell <> -1)
"""
CANDIDATES = SUPPORT + """,
c AS (SELECT unit, pos, cell, count(DISTINCT val) FILTER (val <> '?') AS n, bool_or(val = '?') AS open,
             coalesce(string_agg(val, '|' ORDER BY val) FILTER (val <> '?'), '') AS vals FROM v GROUP BY unit, pos, cell)
"""
SITES = SUPPORT + """,
s AS (
  SELECT p.unit, p.pos, q.pos IS NOT NULL AS reached, CASE WHEN q.pos IS NOT NULL THEN h.n END AS n, CASE WHEN q.pos IS NOT NULL THEN h.open END AS open,
         CASE WHEN q.pos IS NULL THEN 'UNREACHABLE' WHEN h.open AND h.n > 0 THEN 'PARTIAL' WHEN h.open THEN 'OPEN' WHEN h.n > 0 THEN 'CLOSED' ELSE 'OTHER' END AS status
  FROM (SELECT unit, pos FROM x WHERE event_type = 'purchase') p LEFT JOIN r q ON q.unit = p.unit AND q.pos = p.pos
  LEFT JOIN (SELECT unit, pos, count(*) FILTER (val <> '?') AS n, bool_or(val = '?') AS open FROM v WHERE cell = 0 GROUP BY unit, pos) h ON h.unit = p.unit AND h.pos = p.pos),
k AS (SELECT s.unit, s.pos, v.val AS name FROM s JOIN v ON v.unit = s.unit AND v.pos = s.pos AND v.cell = 0 WHERE s.reached AND v.val <> '?' AND regexp_matches(v.val, '^[A-Z_$][A-Z0-9_@#$]{0,7}$'))
"""
ISSUES = """,
ii AS (SELECT unit, pos, 'OPEN_CONTROL' AS code FROM x WHERE event_type = 'purchase' AND k % 25 = 0
       UNION ALL SELECT unit, pos, 'ABNORMAL_END' FROM x WHERE event_type = 'error' AND k % 10 = 0
       UNION ALL SELECT unit, pos, 'UNBOUNDED_EFFECT' FROM x WHERE action = 2 AND k > 90)
"""
RANGES = """,
w AS (SELECT unit, cell AS base, pos, k % 16 AS s, k % 16 + length(event_type) AS f FROM x)
"""
SEGMENTS = RANGES + """,
p AS (SELECT DISTINCT unit, base, unnest([s, f]) AS edge FROM w),
g AS (SELECT unit, base, edge AS "start", lead(edge) OVER (PARTITION BY unit, base ORDER BY edge) AS "end" FROM p)
"""
ALIASES = """,
a AS (SELECT unit, pos AS id, CASE WHEN k % 35 = 0 THEN pos + 1 ELSE pos - (k % 7 + 1) END AS of FROM x WHERE k % 5 = 0),
ac AS (SELECT unit, id, of FROM a UNION SELECT ac.unit, ac.id, a.of FROM ac JOIN a ON a.unit = ac.unit AND a.id = ac.of),
ar AS (SELECT ac.unit, ac.id, ac.of AS root FROM ac LEFT JOIN a ON a.unit = ac.unit AND a.id = ac.of WHERE a.id IS NULL)
"""
STACKS = """,
m AS (SELECT *, CASE WHEN event_type = 'error' AND k % 4 = 0 AND k % 10 <> 0 THEN 'C' WHEN event_type = 'view' AND k % 2 = 0 THEN 'R' ELSE '-' END AS mark FROM x),
st(unit, pos, stack) AS (
  SELECT unit, 0::BIGINT, '' FROM l
  UNION
  SELECT i.unit, i.dst, CASE WHEN m.mark = 'C' THEN st.stack || '/' || m.pos WHEN m.mark = 'R' AND st.stack <> '' THEN regexp_replace(st.stack, '/[0-9]+$', '') ELSE st.stack END
  FROM st JOIN m ON m.unit = st.unit AND m.pos = st.pos JOIN i ON i.unit = st.unit AND i.src = st.pos
  WHERE NOT (m.mark = 'C' AND contains(st.stack || '/', '/' || m.pos || '/')))
"""
#: Edges with abnormal outcomes, and the blocks that each entry reaches.
OUTCOMES = """,
hs AS (SELECT unit, pos AS handler, pos - 3 - k // 3 AS first, pos - 1 AS last FROM x WHERE event_type = 'purchase' AND k % 2 = 0),
fs AS (SELECT x.unit, x.pos, arg_min(h.handler, (h.last - h.first, -h.handler)) AS handler FROM x LEFT JOIN hs h ON h.unit = x.unit AND x.pos BETWEEN h.first AND h.last
       WHERE x.event_type = 'error' AND x.k % 2 = 1 GROUP BY x.unit, x.pos),
oe AS (SELECT unit, src, dst, CASE WHEN kind = 'HALT' THEN 'CONTROL_EXIT' ELSE kind END AS kind FROM e
       UNION ALL SELECT unit, pos, coalesce(handler, -3), CASE WHEN handler IS NULL THEN 'CONTROL_EXIT' ELSE 'EXCEPTION' END FROM fs),
re(unit, entry, pos) AS (SELECT unit, pos, pos FROM x WHERE pos = 0 OR event_type = 'signup' AND k % 5 = 0
       UNION SELECT re.unit, re.entry, oe.dst FROM re JOIN oe ON oe.unit = re.unit AND oe.src = re.pos AND oe.dst >= 0),
eg AS (SELECT DISTINCT re.unit, re.entry, src, CASE WHEN dst >= 0 THEN dst END AS dst, CASE dst WHEN -1 THEN 'NORMAL' WHEN -2 THEN 'HALT' WHEN -3 THEN 'PROPAGATE' END AS "exit", kind
       FROM re JOIN oe ON oe.unit = re.unit AND oe.src = re.pos)
"""
#: Blocks under unknown control, and occurrences with their status.
QUALIFIED = SUPPORT + """,
oc AS (SELECT p.unit, p.pos AS src, q.pos AS dst FROM x p JOIN x q ON p.unit = q.unit WHERE p.event_type = 'purchase' AND p.k % 25 = 0 AND q.event_type = 'signup' AND q.k % 10 = 0),
un(unit, pos) AS (SELECT DISTINCT oc.unit, oc.dst FROM oc JOIN r ON r.unit = oc.unit AND r.pos = oc.src
       UNION SELECT un.unit, a.dst FROM un JOIN (SELECT unit, src, dst FROM i UNION SELECT unit, src, dst FROM oc) a ON a.unit = un.unit AND a.src = un.pos),
qs AS (SELECT x.unit, x.pos, CASE WHEN l.last < 1 THEN 'CONTROL_UNAVAILABLE' WHEN un.pos IS NOT NULL THEN 'POSSIBLE_UNDER_UNKNOWN_CONTROL' WHEN r.pos IS NOT NULL THEN 'QUALIFIED_POSSIBLE' ELSE 'NOT_QUALIFIED' END AS status
       FROM x JOIN l USING (unit) LEFT JOIN r ON r.unit = x.unit AND r.pos = x.pos LEFT JOIN un ON un.unit = x.unit AND un.pos = x.pos WHERE event_type = 'purchase'),
qo AS (SELECT vs.unit, vs.pos, vs.val, coalesce(p.action = 0, false) AND un.pos IS NULL AS closed FROM vs LEFT JOIN x p ON p.unit = vs.unit AND p.pos = vs.prod LEFT JOIN un ON un.unit = vs.unit AND un.pos = vs.prod WHERE vs.cell = 0),
qq AS (SELECT qs.unit, qs.pos, status, coalesce(string_agg(DISTINCT val, '|' ORDER BY val) FILTER (val <> '?' AND status IN ('QUALIFIED_POSSIBLE', 'POSSIBLE_UNDER_UNKNOWN_CONTROL')), '') AS names,
              count(DISTINCT val) FILTER (val <> '?' AND status IN ('QUALIFIED_POSSIBLE', 'POSSIBLE_UNDER_UNKNOWN_CONTROL')) AS n, status <> 'QUALIFIED_POSSIBLE' OR NOT coalesce(bool_and(closed), false) AS remainder
       FROM qs LEFT JOIN qo ON qo.unit = qs.unit AND qo.pos = qs.pos GROUP BY qs.unit, qs.pos, status)
"""
#: Each shape of expression written out, over snapshots of the two cells that it may read: s, of the source, and c, of the block's own.
EXPRESSIONS = """,
g AS (SELECT x.unit, x.pos, x.k % 7 AS shape, x.k, x.literal, x.source, x.cell FROM x),
av AS (SELECT unit, pos, cell, CASE WHEN val <> '?' THEN val END AS val FROM v),
al AS (SELECT g.unit, g.pos, c AS cell, av.val FROM g, (SELECT unnest([0, 1, 2, 3])::BIGINT AS c) LEFT JOIN av ON av.unit = g.unit AND av.pos = g.pos AND av.cell = c),
am AS (SELECT unit, pos, cell, count(*) AS m, min(val) AS only FROM al GROUP BY ALL),
sn AS (
  SELECT g.*, al.val AS s, NULL AS c FROM g JOIN al ON al.unit = g.unit AND al.pos = g.pos AND al.cell = g.source WHERE shape IN (1, 2, 4, 6)
  UNION ALL SELECT g.*, NULL, al.val FROM g JOIN al ON al.unit = g.unit AND al.pos = g.pos AND al.cell = g.cell WHERE shape = 5
  UNION ALL SELECT g.*, NULL, NULL FROM g WHERE shape = 0
  UNION ALL SELECT g.*, al.val, CASE WHEN y.m = 1 THEN y.only END FROM g JOIN al ON al.unit = g.unit AND al.pos = g.pos AND al.cell = g.source
            JOIN am y ON y.unit = g.unit AND y.pos = g.pos AND y.cell = g.cell JOIN am z ON z.unit = g.unit AND z.pos = g.pos AND z.cell = g.source WHERE shape = 3 AND (z.m > 1 OR y.m = 1)
  UNION ALL SELECT g.*, CASE WHEN z.m = 1 THEN z.only END, al.val FROM g JOIN al ON al.unit = g.unit AND al.pos = g.pos AND al.cell = g.cell
            JOIN am y ON y.unit = g.unit AND y.pos = g.pos AND y.cell = g.cell JOIN am z ON z.unit = g.unit AND z.pos = g.pos AND z.cell = g.source WHERE shape = 3 AND y.m > 1),
er AS (
  SELECT unit, pos, CASE shape
    WHEN 0 THEN literal
    WHEN 1 THEN coalesce(rpad(s, (2 + k % 7)::INT, ' '), repeat(chr(65533), 2 + k % 7))
    WHEN 2 THEN s || '-' || k
    WHEN 3 THEN CASE WHEN k % 4 + 1 + k % 5 <= length(s || c) THEN substr(s || c, k % 4 + 1, 1 + k % 5) ELSE repeat(chr(65533), 1 + k % 5) END
    WHEN 4 THEN s
    WHEN 5 THEN CASE WHEN k % 2 = 0 THEN repeat('*', 1 + k % 3) ELSE repeat(chr(65533), 1 + k % 3) END || c
    ELSE s || s END AS val FROM sn
  UNION ALL SELECT unit, pos, rpad(literal, (k % 9)::INT, ' ') FROM g WHERE shape = 4),
ev AS (SELECT DISTINCT unit, pos, coalesce(val, '?') AS val FROM er)
"""
#: Definitions byte by byte: must-writes kill the bytes that they write, may-writes nothing, anywhere-writes are of all bytes.
BYTES = """,
y AS MATERIALIZED (SELECT unit, pos, cell, k % 16 AS s, k % 16 + length(event_type) AS f, CASE WHEN action <> 2 THEN 0 WHEN k > 90 THEN 2 ELSE 1 END AS how FROM x),
n AS MATERIALIZED (SELECT unnest(range(0, 4))::BIGINT AS base), u AS MATERIALIZED (SELECT base, unnest(range(0, 32))::BIGINT AS byte FROM n),
wr AS MATERIALIZED (SELECT y.unit, y.pos, u.base, u.byte FROM y JOIN u ON u.base = y.cell AND u.byte >= s AND u.byte < f WHERE how <> 2 UNION ALL SELECT y.unit, y.pos, u.base, u.byte FROM y, u WHERE how = 2),
di AS MATERIALIZED (SELECT i.unit, i.dst, wr.base, wr.byte, wr.pos FROM r JOIN wr ON wr.unit = r.unit AND wr.pos = r.pos JOIN i ON i.unit = r.unit AND i.src = r.pos),
bd(unit, pos, base, byte, def) AS (
  (SELECT unit, 0::BIGINT, base, byte, -1::BIGINT FROM l, u UNION SELECT * FROM di)
  UNION SELECT i.unit, i.dst, bd.base, bd.byte, bd.def FROM bd JOIN y ON y.unit = bd.unit AND y.pos = bd.pos JOIN i ON i.unit = bd.unit AND i.src = bd.pos
        WHERE NOT (how = 0 AND y.cell = bd.base AND bd.byte >= s AND bd.byte < f))
"""
_MADE = """
      SELECT q.unit, q.entry, q.ec, q.ev, q.ep, q.pos, o.cell, o.val, o.prod, cl."to", cl.back, en.pos IS NOT NULL AS ends
      FROM {path} q JOIN x ON x.unit = q.unit AND x.pos = q.pos LEFT JOIN cl ON cl.unit = q.unit AND cl.pos = q.pos LEFT JOIN en ON en.unit = q.unit AND en.pos = q.pos,
           LATERAL (SELECT q.cell AS cell, q.val AS val, q.prod AS prod WHERE q.cell = -1 OR q.cell <> x.cell
                    UNION ALL SELECT x.cell, CASE WHEN x.action = 0 THEN x.literal ELSE '?' END, x.pos WHERE q.cell = -1 AND x.action <> 1
                    UNION ALL SELECT x.cell, q.val, q.prod WHERE x.action = 1 AND q.cell = x.source) o"""
_BACK = """
    SELECT a.unit, a.entry, a.ec, a.ev, a.ep, a.back, b.cell, b.val, b.prod FROM ({a}) a JOIN ({b}) b
    ON a.unit = b.unit AND a."to" = b.entry AND a.cell = b.ec AND a.val = b.ev AND a.prod = b.ep
    WHERE a."to" IS NOT NULL AND a.back IS NOT NULL AND b."to" IS NULL AND b.ends AND b.entry <> -1"""
_NEW, _ALL = _MADE.format(path="ac"), _MADE.format(path="recurring.ac")
#: Facts of activations: a call's facts at a procedure's entry meet those at its exits, new ones with all and all with new ones.
ACTIVATIONS = f""",
cl AS (SELECT unit, pos, pos + 2 + k % 7 AS "to", CASE WHEN pos < last THEN pos + 1 END AS back FROM x JOIN l USING (unit) WHERE event_type = 'error' AND k % 4 = 0 AND k % 10 <> 0 AND pos + 2 + k % 7 <= last),
en AS (SELECT unit, pos FROM x WHERE event_type = 'view' AND k % 2 = 0),
ac(unit, entry, ec, ev, ep, pos, cell, val, prod) USING KEY (unit, entry, ec, ev, ep, pos, cell, val, prod) AS (
  SELECT unit, -1::BIGINT, -1::BIGINT, '', -1::BIGINT, 0::BIGINT, c, CASE WHEN c = -1 THEN '' ELSE '?' END, -1::BIGINT FROM l, (SELECT unnest([-1, 0, 1, 2, 3])::BIGINT AS c)
  UNION
  (SELECT n.unit, n.entry, n.ec, n.ev, n.ep, i.dst, n.cell, n.val, n.prod FROM ({_NEW}) n JOIN i ON i.unit = n.unit AND i.src = n.pos WHERE n."to" IS NULL AND (NOT n.ends OR n.entry = -1)
   UNION SELECT unit, "to", cell, val, prod, "to", cell, val, prod FROM ({_NEW}) WHERE "to" IS NOT NULL
   UNION {_BACK.format(a=_NEW, b=_ALL)}
   UNION {_BACK.format(a=_ALL, b=_NEW)})),
ar AS (SELECT DISTINCT unit, entry, pos FROM ac WHERE cell = -1)
"""
GRAPH = """
WITH RECURSIVE g AS (
  SELECT DISTINCT 'o' || l_orderkey AS src, 'p' || l_partkey AS dst FROM lineitem
  UNION SELECT 'p' || l_partkey, 's' || l_suppkey FROM lineitem WHERE l_linenumber = 1
  UNION SELECT 's' || l_suppkey, 'p' || (l_suppkey * 7) FROM lineitem WHERE l_suppkey % 10 = 0)
"""
RULES = """
WITH RECURSIVE u AS (
  SELECT DISTINCT 'o' || l_orderkey AS rule, 'p' || l_partkey AS premise, 'o' || l_orderkey AS head FROM lineitem
  UNION SELECT 'r' || l_partkey || '.' || l_suppkey, 's' || l_suppkey, 'p' || l_partkey FROM lineitem),
seeds AS (SELECT 's' || s_suppkey AS node FROM supplier WHERE s_acctbal > 9500),
parts AS (SELECT node FROM seeds UNION SELECT head FROM u JOIN seeds ON premise = node WHERE rule LIKE 'r%'),
orders_ AS (SELECT head AS node FROM u LEFT JOIN parts ON premise = node WHERE rule LIKE 'o%' GROUP BY head HAVING count(*) = count(parts.node)),
held AS (SELECT node FROM parts UNION SELECT node FROM orders_)
"""
UPPER = "translate(text, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ')"
WORDS = "WITH w AS (SELECT doc_id, unnest(string_split(text, ' ')) AS word FROM documents)"

SQL = {
    "reach_by_kind": BASE + "SELECT event_type, count(r.pos) AS reached, count(*) - count(r.pos) AS unreached FROM x LEFT JOIN r ON r.unit = x.unit AND r.pos = x.pos GROUP BY event_type",
    "cfg_nodes": BASE + """SELECT unit, kind, pos, (row_number() OVER (PARTITION BY unit ORDER BY kind, pos) - 1)::BIGINT AS ordinal FROM (
        SELECT unit, 'SEQUENCE' AS kind, pos FROM b UNION ALL SELECT unit, unnest(['ENTRY', 'NORMAL_EXIT']), 0 FROM l UNION ALL SELECT unit, 'HALT_EXIT', pos FROM t WHERE kind = 'HALT')""",
    "cfg_edges": BASE + "SELECT unit, src, dst, kind FROM e",
    "cfg_entry_edges": BASE + "SELECT unit, NULL::BIGINT AS src, 0::BIGINT AS dst, 'ENTRY' AS kind FROM l",
    "cfg_edge_kind_counts": BASE + "SELECT kind, count(*) AS n, round(count(*)::DOUBLE / sum(count(*)) OVER (), 9) AS share FROM e GROUP BY kind",
    "cfg_invalid_edges": BASE + "SELECT unit, src, dst, kind FROM e WHERE (kind = 'RETURN') <> (dst = -1) OR (kind = 'HALT') <> (dst = -2)",
    "cfg_invalid_edges_mutated": BASE + """SELECT unit, src, dst, kind FROM (SELECT unit, src, CASE WHEN src % 97 = 3 THEN dst + 1000000 ELSE dst END AS dst, kind FROM e) q
        WHERE CASE kind WHEN 'RETURN' THEN dst <> -1 WHEN 'HALT' THEN dst <> -2 ELSE NOT EXISTS (SELECT 1 FROM b WHERE b.unit = q.unit AND b.pos = q.dst) END""",
    "cfg_duplicate_edges": BASE + "SELECT unit, src, dst, 'ANY' AS kind, count(*) AS n FROM e GROUP BY unit, src, dst HAVING count(*) > 1",
    "cfg_count_mismatches": BASE + """SELECT b.unit, b.pos AS src, CASE WHEN event_type = 'click' THEN 2 ELSE 1 END::BIGINT AS asked, coalesce(n, 0) AS got
        FROM b LEFT JOIN (SELECT unit, src, count(*) AS n FROM e GROUP BY unit, src) q ON q.unit = b.unit AND q.src = b.pos WHERE coalesce(n, 0) <> CASE WHEN event_type = 'click' THEN 2 ELSE 1 END""",
    "cfg_count_mismatches_mutated": BASE + """SELECT b.unit, b.pos AS src, CASE WHEN event_type = 'click' THEN 2 ELSE 1 END::BIGINT AS asked, coalesce(n, 0) AS got
        FROM b LEFT JOIN (SELECT unit, src, count(*) AS n FROM e WHERE src % 97 <> 3 GROUP BY unit, src) q ON q.unit = b.unit AND q.src = b.pos WHERE coalesce(n, 0) <> CASE WHEN event_type = 'click' THEN 2 ELSE 1 END""",
    "open_control_edges": BASE + "SELECT p.unit, p.pos AS src, q.pos AS dst FROM x p JOIN x q ON p.unit = q.unit WHERE p.event_type = 'purchase' AND p.k % 25 = 0 AND q.event_type = 'signup' AND q.k % 10 = 0",
    "projection_issues": BASE + ISSUES + "SELECT * FROM ii",
    "build_status": BASE + ISSUES + """SELECT l.unit, CASE WHEN n IS NULL THEN 'COMPLETE' ELSE 'PARTIAL' END AS inventory,
        CASE WHEN last < 1 THEN 'INVALID' WHEN o THEN 'UNSUPPORTED_CONTROL' WHEN n > 0 THEN 'PARTIAL' ELSE 'COMPLETE' END AS status
        FROM l LEFT JOIN (SELECT unit, count(*) AS n, bool_or(code = 'OPEN_CONTROL') AS o FROM ii GROUP BY unit) q USING (unit)""",
    "unsupported_capabilities": "SELECT event_type, count(*) AS n FROM events WHERE event_type NOT IN ('view', 'click', 'purchase') GROUP BY event_type",
    "reach_blocks": BASE + "SELECT unit, pos FROM r",
    "unreachable_blocks": BASE + "SELECT unit, pos FROM b EXCEPT SELECT unit, pos FROM r",
    "reach_bits": BASE + """SELECT unit, pos, bit_or(bit)::BIGINT AS state FROM (SELECT unit, pos, 1 AS bit FROM r UNION ALL
        SELECT p.unit, q.pos, 2 FROM x p JOIN x q ON p.unit = q.unit JOIN r ON r.unit = p.unit AND r.pos = p.pos
        WHERE p.event_type = 'purchase' AND p.k % 25 = 0 AND q.event_type = 'signup' AND q.k % 10 = 0) GROUP BY unit, pos""",
    "reverse_reach": BASE + ", z AS (SELECT DISTINCT unit, src AS pos FROM e WHERE dst < 0 UNION SELECT i.unit, i.src FROM z JOIN i ON i.unit = z.unit AND i.dst = z.pos) SELECT unit, pos FROM z",
    "reaching_definitions": BASE + """,
        d(unit, pos, cell, def) AS (SELECT unit, 0::BIGINT, c, -1::BIGINT FROM l, (SELECT unnest([-1, 0, 1, 2, 3])::BIGINT AS c) UNION
          SELECT i.unit, i.dst, o.cell, o.def FROM d JOIN x ON x.unit = d.unit AND x.pos = d.pos JOIN i ON i.unit = d.unit AND i.src = d.pos,
          LATERAL (SELECT d.cell AS cell, d.def AS def WHERE d.cell = -1 OR d.cell <> x.cell UNION ALL SELECT x.cell, x.pos WHERE d.cell = -1) o)
        SELECT unit, pos, cell, def AS def_pos FROM d WHERE cell <> -1""",
    "possible_values": BASE + SUPPORT + "SELECT * FROM v",
    "value_support": BASE + SUPPORT + "SELECT unit, pos, cell, val, prod AS producer_pos FROM vs WHERE cell <> -1",
    "value_candidates": BASE + CANDIDATES + "SELECT * FROM c",
    "budgeted_candidates": BASE + """,
        bv(unit, pos, cell, val, depth) AS (
          SELECT unit, 0::BIGINT, c, CASE WHEN c = -1 THEN '' ELSE '?' END, 0 FROM l, (SELECT unnest([-1, 0, 1, 2, 3])::BIGINT AS c)
          UNION
          SELECT i.unit, i.dst, o.cell, o.val, depth + 1
          FROM bv JOIN x ON x.unit = bv.unit AND x.pos = bv.pos JOIN i ON i.unit = bv.unit AND i.src = bv.pos,
               LATERAL (SELECT bv.cell AS cell, bv.val AS val WHERE bv.cell = -1 OR bv.cell <> x.cell
                        UNION ALL SELECT x.cell, CASE WHEN x.action = 0 THEN x.literal ELSE '?' END WHERE bv.cell = -1 AND x.action <> 1
                        UNION ALL SELECT x.cell, bv.val WHERE x.action = 1 AND bv.cell = x.source) o
          WHERE depth < 8),
        bf AS (SELECT unit, pos, cell, val, min(depth) AS depth FROM bv GROUP BY ALL),
        bl AS (SELECT unit, max(depth) = 8 AS limited FROM bf GROUP BY unit)
        SELECT unit, pos, cell, count(*) FILTER (val <> '?') AS n, bool_or(val = '?') OR any_value(limited) AS open, any_value(limited) AS limited, coalesce(string_agg(val, '|' ORDER BY val) FILTER (val <> '?'), '') AS vals
        FROM bf JOIN bl USING (unit) WHERE cell <> -1 GROUP BY unit, pos, cell""",
    "derived_nations": """WITH RECURSIVE i AS (SELECT DISTINCT l_orderkey AS o, l_partkey AS p, l_suppkey AS s FROM lineitem), op AS MATERIALIZED (SELECT DISTINCT o, p FROM i),
        ps AS MATERIALIZED (SELECT DISTINCT p, s FROM i), os AS MATERIALIZED (SELECT DISTINCT o, s FROM i JOIN orders ON o_orderkey = o WHERE o_orderpriority = '1-URGENT'),
        w AS MATERIALIZED (SELECT o, count(*) AS n FROM op GROUP BY o),
        d(kind, id, val) USING KEY (kind, id, val) AS (
          SELECT 's', s_suppkey::BIGINT, s_nationkey::VARCHAR FROM supplier WHERE s_acctbal > 0
          UNION
          (SELECT 'p', ps.p::BIGINT, d.val FROM d JOIN ps ON d.kind = 's' AND d.id = ps.s WHERE d.val <> (ps.p % 100)::VARCHAR
           UNION SELECT 's', os.s::BIGINT, d.val FROM d JOIN os ON d.kind = 'o' AND d.id = os.o WHERE d.val LIKE '1%'
           UNION SELECT 'o', op.o::BIGINT, a.val FROM op JOIN recurring.d a ON a.kind = 'p' AND a.id = op.p
                 JOIN (SELECT op.o FROM op JOIN (SELECT DISTINCT id FROM recurring.d WHERE kind = 'p') b ON b.id = op.p JOIN w ON w.o = op.o GROUP BY op.o, w.n HAVING count(*) = w.n) f ON f.o = op.o
                 WHERE EXISTS (SELECT 1 FROM d)))
        SELECT kind || id AS node, val FROM d""",
    "closed_everywhere": BASE + CANDIDATES + "SELECT unit, cell, count(*) AS n FROM c WHERE NOT open AND (unit, cell) NOT IN (SELECT (unit, cell) FROM c WHERE open AND pos > 0) GROUP BY unit, cell",
    "replay_points": BASE + """SELECT unit, pos, cell, val FROM (SELECT unit, pos, cell, last_value(CASE WHEN action = 0 THEN literal END IGNORE NULLS)
        OVER (PARTITION BY unit, pos // 8, cell ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS val FROM x) WHERE val IS NOT NULL""",
    "last_writes": BASE + """SELECT unit, run, cell, pos, CASE action WHEN 0 THEN literal WHEN 1 THEN 'copy of ' || source ELSE '?' END AS val
        FROM (SELECT *, pos // 8 AS run, row_number() OVER (PARTITION BY unit, pos // 8, cell ORDER BY pos DESC) AS n FROM x) WHERE n = 1""",
    "stack_contexts": BASE + STACKS + "SELECT unit, pos, stack FROM st",
    "recursive_activations": BASE + STACKS + "SELECT st.unit, st.pos, stack FROM st JOIN m ON m.unit = st.unit AND m.pos = st.pos WHERE mark = 'C' AND contains(stack || '/', '/' || st.pos || '/')",
    "entry_graphs": BASE + OUTCOMES + "SELECT * FROM eg",
    "entry_exit_counts": BASE + OUTCOMES + """SELECT unit, entry, count(DISTINCT src) FILTER ("exit" = 'NORMAL') AS normal, count(DISTINCT src) FILTER ("exit" = 'HALT') AS halt,
        count(DISTINCT src) FILTER ("exit" = 'PROPAGATE') AS propagate FROM eg GROUP BY unit, entry""",
    "qualified_occurrences": BASE + QUALIFIED + "SELECT * FROM qq",
    "byte_definitions": BASE + BYTES + """, z AS (SELECT *, byte - row_number() OVER (PARTITION BY unit, pos, base, def ORDER BY byte) AS island FROM bd),
        zr AS MATERIALIZED (SELECT unit, pos, base, def, min(byte) AS first, max(byte) + 1 AS past FROM z GROUP BY unit, pos, base, def, island)
        SELECT zr.unit, zr.pos, zr.base, def AS def_pos, first AS "start", past AS "end", CASE WHEN def < 0 OR how = 0 THEN 'must' WHEN how = 1 THEN 'may' ELSE 'anywhere' END AS strength
        FROM zr LEFT JOIN y ON y.unit = zr.unit AND y.pos = zr.def""",
    "bytes_surely_written": BASE + BYTES + "SELECT r.unit, r.pos, base, 32 - count(byte) AS n FROM r CROSS JOIN n LEFT JOIN (SELECT * FROM bd WHERE def = -1) USING (unit, pos, base) GROUP BY ALL HAVING count(byte) < 32",
    "expression_values": BASE + SUPPORT + EXPRESSIONS + "SELECT unit, pos, val FROM ev",
    "expression_assignments": BASE + SUPPORT + EXPRESSIONS + """SELECT unit, pos, count(*) FILTER (NOT unsure) AS n, bool_or(unsure) AS open, coalesce(string_agg(val, '|' ORDER BY val) FILTER (NOT unsure), '') AS vals
        FROM (SELECT *, val = '?' OR contains(val, chr(65533)) AS unsure FROM ev) GROUP BY unit, pos""",
    "activation_values": BASE + ACTIVATIONS + "SELECT DISTINCT unit, pos, cell, val, prod AS producer_pos FROM ac WHERE cell <> -1",
    "activation_reach": BASE + ACTIVATIONS + "SELECT * FROM ar",
    "exit_summaries": BASE + ACTIVATIONS + f"""SELECT DISTINCT unit, entry, ec AS entry_cell, ev AS entry_val, cell, val FROM ({_MADE.format(path="ac")}) WHERE ends AND "to" IS NULL AND entry <> -1""",
    "unique_contexts": BASE + ACTIVATIONS + """,
        st AS (SELECT ar.unit, ar.entry, ar.pos, cl."to" FROM ar JOIN cl ON cl.unit = ar.unit AND cl.pos = ar.pos),
        one AS (SELECT unit, "to", min(entry) AS entry, min(pos) AS pos FROM st GROUP BY unit, "to" HAVING count(*) = 1),
        u(unit, entry, callers) AS (SELECT DISTINCT unit, entry, '' FROM ar WHERE entry = -1 UNION ALL SELECT one.unit, one."to", u.callers || '/' || one.pos FROM u JOIN one ON one.unit = u.unit AND one.entry = u.entry)
        SELECT ar.unit, ar.pos, CASE WHEN count(*) = 1 THEN max(callers) END AS callers FROM ar LEFT JOIN u ON u.unit = ar.unit AND u.entry = ar.entry GROUP BY ar.unit, ar.pos""",
    "segments": BASE + SEGMENTS + 'SELECT unit, base, "start", "end" FROM g WHERE "end" IS NOT NULL',
    "covered_segments": BASE + SEGMENTS + 'SELECT g.unit, g.base, "start", "end", count(*) AS n FROM g JOIN w ON g.unit = w.unit AND g.base = w.base AND "start" < f AND s < "end" GROUP BY ALL',
    "overlapping_writes": BASE + RANGES + """, spans AS (SELECT unit, base, s, f, count(*) AS n FROM w GROUP BY ALL)
        SELECT a.unit, a.base, a.s AS "start", a.f AS "end", a.n AS n, b.s AS other_start, b.f AS other_end, b.n AS other_n FROM spans a JOIN spans b
        ON a.unit = b.unit AND a.base = b.base AND a.s < b.f AND b.s < a.f AND (a.s < b.s OR a.s = b.s AND (a.f < b.f OR a.f = b.f AND a.n > 1))""",
    "literal_runs": BASE + """SELECT unit, literal, min(pos) AS "start", count(*) AS n FROM (
        SELECT unit, literal, pos, pos - row_number() OVER (PARTITION BY unit, literal ORDER BY pos) AS island FROM x) GROUP BY unit, literal, island""",
    "contradictory_literals": BASE + """SELECT unit, cell, count(DISTINCT literal) AS n FROM (
        SELECT unit, cell, event_type, arg_min(literal, pos) AS literal FROM x WHERE action = 0 GROUP BY ALL) GROUP BY unit, cell HAVING count(DISTINCT literal) > 1""",
    "occurrence_conflicts": BASE + "SELECT unit, event_type, k, count(*) AS n_occurrences, 1 AS n_operations FROM x GROUP BY unit, event_type, k HAVING count(*) > 1",
    "coverage_differences": BASE + SEGMENTS + """, cov AS (SELECT DISTINCT g.unit, g.base, "start", "end" FROM g JOIN w ON g.unit = w.unit AND g.base = w.base AND "start" < f AND s < "end"),
        seg AS (SELECT unit, base, "start", "end" FROM g WHERE "end" IS NOT NULL)
        SELECT *, 'received' AS side FROM (SELECT * FROM cov EXCEPT ALL SELECT * FROM seg) UNION ALL SELECT *, 'expected' FROM (SELECT * FROM seg EXCEPT ALL SELECT * FROM cov)""",
    "assumption_labels": BASE + """SELECT unit, pos, labels FROM (SELECT unit, pos, concat_ws(',', CASE WHEN action = 1 THEN 'SOURCE_CELL_IS_CLOSED' END, CASE WHEN action = 2 THEN 'EFFECT_IS_BOUNDED' END,
        CASE WHEN event_type = 'purchase' AND k % 25 = 0 THEN 'CONTROL_IS_CLOSED' END) AS labels FROM x) WHERE labels <> ''""",
    "coalesced_ranges": BASE + RANGES + """SELECT unit, base, min(s) AS "start", max(f) AS "end" FROM (
        SELECT *, sum(new) OVER (PARTITION BY unit, base ORDER BY s, f ROWS UNBOUNDED PRECEDING) AS island FROM (
        SELECT *, CASE WHEN s <= max(f) OVER (PARTITION BY unit, base ORDER BY s, f ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS new FROM (SELECT DISTINCT unit, base, s, f FROM w))) GROUP BY unit, base, island""",
    "copy_components": BASE + """, y AS (SELECT unit, source AS p, cell AS q FROM x WHERE action = 1 UNION SELECT unit, cell, source FROM x WHERE action = 1),
        z AS (SELECT unit, c AS cell, c AS seen FROM l, (SELECT unnest([0, 1, 2, 3])::BIGINT AS c) UNION SELECT z.unit, z.cell, y.q FROM z JOIN y ON y.unit = z.unit AND y.p = z.seen)
        SELECT unit, cell, min(seen) AS component FROM z GROUP BY unit, cell""",
    "alias_closure": BASE + ALIASES + "SELECT * FROM ar",
    "alias_cycles": BASE + ALIASES + "SELECT unit, id FROM a WHERE (unit, id) NOT IN (SELECT (unit, id) FROM ar)",
    "call_sites": BASE + SITES + "SELECT * FROM s",
    "call_candidates": BASE + SITES + "SELECT * FROM k",
    "call_edges": BASE + SITES + "SELECT unit, name, count(DISTINCT pos) AS n_sites FROM k GROUP BY unit, name",
    "site_classification": BASE + SITES + "SELECT status, count(*) AS n, round(count(*)::DOUBLE / (SELECT count(*) FROM s), 9) AS ratio FROM s GROUP BY status",
    "target_resolution": BASE + SITES + """SELECT name, length(name) || ':' || name || length(authority) || ':' || authority AS key, n_units, n_sites, authority FROM (
        SELECT name, count(DISTINCT unit) AS n_units, count(DISTINCT (unit, pos)) AS n_sites, string_agg(DISTINCT a, '+' ORDER BY a) AS authority FROM (
        SELECT name, unit, pos, 'COMPUTED' AS a FROM k UNION ALL SELECT literal, unit, pos, 'LITERAL' FROM x WHERE action = 0 AND event_type = 'signup') GROUP BY name)""",
    "unresolved_sites": BASE + SITES + "SELECT unit, pos FROM s WHERE reached AND (unit, pos) NOT IN (SELECT (unit, pos) FROM k)",
    "conditional_values": BASE + SITES + "SELECT s.unit, s.pos, val FROM s JOIN v ON v.unit = s.unit AND v.pos = s.pos WHERE reached AND status <> 'CLOSED' AND cell = 1 AND val <> '?'",
    "file_sites": BASE + SUPPORT + """SELECT x.unit, x.pos, name, CASE WHEN name IS NULL THEN 'UNKNOWN' WHEN k < 10 THEN 'EXPLICIT' ELSE 'DEFAULT' END AS route
        FROM x JOIN (SELECT unit, pos, CASE WHEN val <> '?' AND regexp_matches(val, '^[A-Z0-9$@#]{1,8}$') THEN val END AS name FROM v WHERE cell = 2) q ON q.unit = x.unit AND q.pos = x.pos WHERE event_type = 'view' AND k < 30""",
    "source_dependencies": """SELECT CASE WHEN name LIKE 'www.%' THEN 'COPYBOOK' WHEN name LIKE 'm.%' THEN 'DECLARATION' WHEN name LIKE 'blog.%' THEN 'SQL_INCLUDE' ELSE 'TABLE' END AS kind, name, count(*) AS n, bool_or(partial) AS remainder
        FROM (SELECT regexp_extract(url, '//([^/:]+)', 1) AS name, contains(url, '?') AS partial FROM pages) GROUP BY name""",
    "proof_closure": GRAPH + ", z AS (SELECT 'o' || o_orderkey AS node FROM orders WHERE o_orderstatus = 'P' UNION SELECT dst FROM z JOIN g ON src = node) SELECT node FROM z",
    "and_closure": RULES + "SELECT node FROM held",
    "assumed_only": RULES + "SELECT DISTINCT head AS node FROM u EXCEPT SELECT node FROM held",
    "text_fit": "SELECT doc_id, rpad(text, 40, '*') AS value FROM documents",
    "text_slice": "SELECT doc_id, CASE WHEN length(text) >= 30 THEN substring(text, 6, 25) END AS value FROM documents",
    "text_fill_concat": "SELECT doc_id, repeat('-', (length(text) % 7)::INT) || text AS value FROM documents",
    "text_trim": "SELECT doc_id, '[' || trim(text, ' ') || ']' AS value FROM documents",
    "text_upper_ascii": f"SELECT doc_id, {UPPER} AS value FROM documents",
    "text_sha256": "SELECT doc_id, sha256(text) AS value FROM documents",
    "text_key": "SELECT doc_id, length(text) || ':' || text || length(source) || ':' || source AS value FROM documents",
    "text_ascii": r"SELECT doc_id, CASE WHEN regexp_full_match(text, '[\x00-\x7F]*', 's') THEN hex(text) END AS value FROM documents",
    "text_1047": f"""SELECT doc_id, CASE WHEN regexp_full_match(text, '[\\x{{0}}-\\x{{FF}}]*', 's') THEN
        array_to_string(list_transform(string_split(translate(text, '{MOVED_1047.replace("'", "''")}', '{MOVED_LATIN.replace("'", "''")}'), ''), lambda c: format('{{:02X}}', unicode(c))), '') END AS value FROM documents""",
    "is_digits": WORDS + " SELECT doc_id, count(*) FILTER (regexp_full_match(word, '[0-9]+')) AS n_digits, count(*) AS n FROM w GROUP BY doc_id",
    "name_rules": WORDS + f""", p AS (SELECT {UPPER.replace('text', 'word')} AS raw FROM w), q AS (SELECT raw, CASE WHEN length(raw) <= 8 THEN rtrim(raw, ' ') END AS name FROM p)
        SELECT rule, name, count(*) AS n FROM (
          SELECT 'call' AS rule, name FROM q WHERE regexp_matches(name, '^[A-Z_$][A-Z0-9_@#$]{{0,7}}$')
          UNION ALL SELECT 'transaction', name FROM q WHERE regexp_matches(name, '^[A-Z0-9$@#]{{1,8}}$')
          UNION ALL SELECT 'file', rtrim(raw, ' ') FROM q WHERE length(raw) <= 8 AND regexp_matches(rtrim(raw, ' '), '^[A-Z0-9$@#]{{1,8}}$')) GROUP BY rule, name""",
    "truth_tables": """SELECT a, b, ((a & b & 2) | ((a | b) & 1)) AS both_hold, (((a | b) & 2) | (a & b & 1)) AS either_holds, (((a & 2) >> 1) | ((a & 1) << 1)) AS negated
        FROM (SELECT unnest([1, 2, 3]) AS a), (SELECT unnest([1, 2, 3]) AS b)""",
    "padded_equality": "SELECT n_nationkey, n_nationkey % 3 <> 2 AS result FROM nation",
    "candidate_equality": BASE + CANDIDATES + """SELECT p.unit, p.pos, CASE WHEN p.open OR q.open THEN 3 WHEN NOT list_has_any(string_split(p.vals, '|'), string_split(q.vals, '|')) THEN 1 WHEN p.n = 1 AND q.n = 1 THEN 2 ELSE 3 END AS result
        FROM c p JOIN c q ON p.unit = q.unit AND p.pos = q.pos AND p.cell = 0 AND q.cell = 1""",
    "numeric_comparison": """SELECT o_orderkey, CASE WHEN p IS NULL THEN 3 WHEN p < 150000 THEN 2 ELSE 1 END AS lt, CASE WHEN p IS NULL THEN 3 WHEN p >= 150000 THEN 2 ELSE 1 END AS ge,
        CASE WHEN p IS NULL THEN 3 WHEN p = 150000 THEN 2 ELSE 1 END AS eq, CASE WHEN p IS NULL THEN 3 WHEN p <> 150000 THEN 2 ELSE 1 END AS ne
        FROM (SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN o_totalprice::DECIMAL(18, 2) END AS p FROM orders)""",
    "artifact_receipts": "SELECT page_id, strlen(html) AS n_bytes, sha256(html) AS sha256, CASE WHEN strlen(html) <= 1048576 THEN 'DELIVERED' ELSE 'RESOURCE_LIMIT' END AS status FROM pages",
    "evidence_rows": "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events WHERE json_keys(props) = ['k']",
    "invalid_evidence_mutated": "SELECT event_id FROM events WHERE event_id % 50 IN (1, 2, 3) OR props IS NULL OR json_keys(props) <> ['k']",
    "invalid_evidence": "SELECT event_id FROM events WHERE props IS NULL OR json_keys(props) <> ['k']",
    "cfg_documents": BASE + """SELECT unit, '{"unit":' || unit || ',"transitions":[' || string_agg('{"src":' || src || ',"dst":' || dst || ',"kind":"' || kind || '"}', ',' ORDER BY src, dst, kind) || ']}' AS document,
        max(CASE kind WHEN 'HALT' THEN 3 WHEN 'INVOKE_NORMAL' THEN 2 ELSE 1 END)::BIGINT AS version FROM e GROUP BY unit""",
    "timing_stats": """SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean, round(median(value), 6) AS median,
        max(CASE WHEN total >= 20 AND rank = ceil(total * 95 / 100) THEN value END) AS p95, min(value) AS low, max(value) AS high, max(CASE WHEN rank = total THEN event_id END) AS slowest
        FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY value, event_id) AS rank, count(*) OVER (PARTITION BY event_type) AS total FROM events) GROUP BY event_type""",
    "vector_diff": """WITH h AS (SELECT event_type AS key, floor(value)::BIGINT AS value, event_id % 2 AS half FROM events),
        a AS (SELECT key, value FROM h WHERE half = 0), z AS (SELECT key, value FROM h WHERE half = 1),
        p AS (SELECT key, count(*) AS lost FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM z) GROUP BY key), q AS (SELECT key, count(*) AS gained FROM (SELECT * FROM z EXCEPT ALL SELECT * FROM a) GROUP BY key)
        SELECT key, coalesce(lost, 0) AS lost, coalesce(gained, 0) AS gained FROM p FULL JOIN q USING (key)""",
    "gap_report": BASE + ISSUES + "SELECT code, count(*) AS occurrences, count(DISTINCT unit) AS n_units FROM ii GROUP BY code",
}
_REQUESTS = """,
rq AS (SELECT 'values' AS batch, 'calls' AS consumer, unit, pos, 0::BIGINT AS cell FROM x WHERE event_type = 'purchase'
       UNION ALL SELECT 'values', 'files', unit, pos, k % 2 FROM x WHERE k < 50 AND event_type IN ('purchase', 'view')
       UNION ALL SELECT 'regions', 'audit', unit, pos, cell FROM x WHERE event_type = 'error')
"""
SQL["query_dedup"] = BASE + _REQUESTS + "SELECT batch, count(*) AS raw, count(DISTINCT (unit, pos, cell)) AS distinct_queries FROM rq GROUP BY batch"
SQL["request_status"] = BASE + SUPPORT + _REQUESTS + """SELECT batch, consumer, CASE WHEN batch <> 'values' THEN 'NOT_STARTED' WHEN n IS NULL THEN 'UNREACHABLE' ELSE 'COMPLETE' END AS status,
    count(*) AS requests, coalesce(sum(CASE WHEN batch = 'values' THEN n END), 0)::BIGINT AS facts
    FROM (SELECT DISTINCT * FROM rq) q LEFT JOIN (SELECT unit, pos, cell, count(*) AS n FROM v GROUP BY ALL) f USING (unit, pos, cell) GROUP BY ALL"""
SQL |= {
    "demanded_cells": BASE + """, z AS (SELECT unit, 0::BIGINT AS cell FROM l UNION SELECT x.unit, x.source FROM z JOIN x ON x.unit = z.unit AND x.cell = z.cell AND x.action = 1) SELECT unit, cell FROM z""",
    "separation_premises": BASE + """, m AS (SELECT DISTINCT unit, event_type, k // 20 AS premise, cell FROM x)
        SELECT a.unit, a.cell AS a, b.cell AS b, count(*) AS n FROM m a JOIN m b ON a.unit = b.unit AND a.event_type = b.event_type AND a.premise = b.premise AND a.cell < b.cell GROUP BY ALL""",
    "local_control_rules": BASE + """, q AS (SELECT x.*, last FROM x JOIN l USING (unit)), c AS (SELECT * FROM q WHERE event_type = 'error' AND k % 4 = 0 AND k % 10 <> 0)
        SELECT unit, pos, 'INVOKE' AS rule, pos + 1 AS to FROM c WHERE pos < last UNION ALL SELECT unit, pos, 'RESUME', pos + 2 FROM c WHERE pos + 2 <= last
        UNION ALL SELECT unit, pos, 'BOUNDARY', pos FROM q WHERE event_type = 'view' AND k % 2 = 0 UNION ALL SELECT unit, pos, 'UNWIND', 0 FROM q WHERE event_type = 'error' AND k % 10 = 0""".replace("AS to", 'AS "to"'),
    "byte_images": BASE + SEGMENTS + """, h AS (SELECT g.unit, g.base, "start", "end", max(pos) AS pos FROM g JOIN w ON g.unit = w.unit AND g.base = w.base AND s < "end" AND "start" < f GROUP BY ALL),
        n AS (SELECT *, CASE WHEN lag(pos) OVER o = pos AND lag("end") OVER o = "start" THEN 0 ELSE 1 END AS new FROM h WINDOW o AS (PARTITION BY unit, base ORDER BY "start")),
        p2 AS (SELECT *, sum(new) OVER (PARTITION BY unit, base ORDER BY "start" ROWS UNBOUNDED PRECEDING) AS part FROM n)
        SELECT unit, base, min("start") AS "start", max("end") AS "end", pos FROM p2 GROUP BY unit, base, part, pos""",
    "closed_on_all_ways": BASE + CANDIDATES + """, asked AS (SELECT unit, dst, count(*) AS n FROM i GROUP BY ALL), held AS (SELECT i.unit, i.dst, c.cell, count(*) AS n FROM i JOIN c ON c.unit = i.unit AND c.pos = i.src AND NOT c.open GROUP BY ALL)
        SELECT held.unit, held.dst AS pos, cell FROM held JOIN asked ON held.unit = asked.unit AND held.dst = asked.dst AND held.n = asked.n""",
    "system_context": BASE + SUPPORT + """SELECT x.unit, x.pos, CASE WHEN k >= 50 THEN 'EXPLICIT' ELSE 'DEFAULT' END AS mode, CASE WHEN k >= 50 THEN coalesce(names, '') END AS candidates
        FROM x LEFT JOIN (SELECT unit, pos, string_agg(DISTINCT val[1:4], '|' ORDER BY val[1:4]) AS names FROM v WHERE cell = 3 AND val <> '?' GROUP BY ALL) q ON q.unit = x.unit AND q.pos = x.pos WHERE event_type = 'view'""",
    "proof_cycles": """WITH RECURSIVE s AS (SELECT s_suppkey AS proof, unnest([s_suppkey * 7, s_suppkey * 11 % ((SELECT max(s_suppkey) FROM supplier) + 1)]) AS needs FROM supplier),
        w AS (SELECT DISTINCT proof, needs FROM s WHERE needs <= (SELECT max(s_suppkey) FROM supplier) AND proof % 5 <> 4),
        z AS (SELECT proof, needs FROM w UNION SELECT z.proof, w.needs FROM z JOIN w ON w.proof = z.needs),
        y AS (SELECT DISTINCT proof FROM z WHERE proof = needs)
        SELECT proof FROM y UNION SELECT z.proof FROM z JOIN y ON z.needs = y.proof""",
}
