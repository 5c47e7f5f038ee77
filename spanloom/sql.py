"""DuckDB SQL of the derived trace, for the oracle: common table expressions by name."""

from __future__ import annotations

from spanloom.derive import STEMS
from spanloom.functions.classify import GRAPH_RULES, KERNEL_RULES


def case(column: str, rules: list[tuple[str, str]], default: str) -> str:
    arms = " ".join(f"WHEN regexp_matches({column}, '{p}', 'i') THEN '{c}'" for c, p in rules)
    return f"CASE {arms} ELSE '{default}' END"


PARTS = {
    "o": ("SELECT o_orderkey, o_custkey, replace(o_orderpriority, ' ', '_') AS module_type, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS r FROM orders", []),
    "nodes": (
        """SELECT *, module_type || '_' || instance_id AS name, ts + dur AS e,
  tid * 1000 + CASE WHEN parent_id IS NULL THEN 0 ELSE ts // 1000 END AS preorder FROM (
  SELECT CAST(o_orderkey AS BIGINT) AS node_id, CAST(-1 - o_custkey AS BIGINT) AS parent_id, module_type, CAST(r AS BIGINT) AS instance_id, CAST(o_custkey AS BIGINT) AS tid, CAST(1000*r AS BIGINT) AS ts, CAST(900 AS BIGINT) AS dur FROM o
  UNION ALL
  SELECT CAST(-1 - o_custkey AS BIGINT), CAST(NULL AS BIGINT), 'CustomerModel', CAST(o_custkey AS BIGINT), CAST(o_custkey AS BIGINT), CAST(1000 AS BIGINT), CAST(1000*max(r) AS BIGINT) FROM o GROUP BY o_custkey)""",
        ["o"],
    ),
    "lines": ("SELECT l.*, p_type, p_name, p_size, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS n FROM lineitem l JOIN part ON l_partkey = p_partkey", []),
    "kernels": (
        f"""SELECT CAST(l_orderkey*100 + n AS BIGINT) AS correlation, ({STEMS})[p_size % 10 + 1] || '_' || p_type || '_' || l_returnflag AS name, CAST(l_quantity AS BIGINT) AS dur,
  CAST(o_custkey AS BIGINT) AS tid, CAST(1000*r + 10*n AS BIGINT) AS ts, CAST(l_orderkey AS BIGINT) AS node_id, CAST(n AS BIGINT) AS n,
  '[[' || CAST(l_quantity AS BIGINT) || ', ' || p_size || '], [' || p_size || ', ' || l_linenumber || ']]' AS dims,
  CAST(l_quantity AS BIGINT) AS m, p_size AS kk, l_linenumber AS nn
  FROM lines JOIN o ON l_orderkey = o_orderkey""",
        ["lines", "o"],
    ),
    "details": (f"SELECT *, {case('name', KERNEL_RULES, 'other')} AS category FROM kernels", ["kernels"]),
    "markers": ("SELECT CAST(6000*r_regionkey AS BIGINT) AS s, CAST(6000*r_regionkey + 4000 AS BIGINT) AS e, CASE WHEN r_regionkey % 2 = 0 THEN 'prefill' ELSE 'decode' END AS phase FROM region", []),
    "launches": ("SELECT correlation, tid, ts, correlation AS seq, 'runtime' AS kind FROM kernels WHERE n % 5 <> 0 UNION ALL SELECT correlation, tid, ts + 1, correlation, 'driver' FROM kernels WHERE n % 2 = 0", ["kernels"]),
    "ops": ("SELECT CAST(event_id AS BIGINT) AS op_id, CAST(user_id AS BIGINT) AS tid, CAST(event_id % 25000 AS BIGINT) AS ts, CAST(floor(value) AS BIGINT) AS dur, event_type AS name FROM events", []),
    "anc": ("SELECT node_id AS ancestor, node_id AS node, 0 AS dist FROM nodes UNION ALL SELECT parent_id, node_id, 1 FROM nodes WHERE parent_id IS NOT NULL", ["nodes"]),
    "totals": ("SELECT ancestor AS node_id, CAST(coalesce(sum(d.dur), 0) AS BIGINT) AS total_us, count(d.dur) AS total_count FROM anc LEFT JOIN details d ON d.node_id = anc.node GROUP BY ancestor", ["anc", "details"]),
    "phases": (
        """SELECT node_id, phase FROM (
  SELECT n.node_id, CASE WHEN n.ts <= m.e THEN m.phase END AS phase, row_number() OVER (PARTITION BY n.node_id ORDER BY m.s DESC) AS q
  FROM nodes n JOIN markers m ON m.s <= n.ts WHERE n.parent_id IS NOT NULL) z WHERE q = 1 AND phase IS NOT NULL""",
        ["nodes", "markers"],
    ),
    "sides": (
        """SELECT CASE WHEN node_id % 2 = 0 THEN 'a' ELSE 'b' END AS side, node_id, correlation AS seq, dur AS us,
  CASE WHEN node_id % 2 = 1 AND name LIKE 'fp8%' THEN 'gemm' ELSE category END AS category,
  CASE WHEN node_id % 2 = 1 AND name LIKE 'fp8%' THEN 'hipblaslt GEMM (128x64x32)' WHEN node_id % 2 = 1 AND name LIKE 'flash%' THEN 'triton::fused_' || name ELSE name END AS short FROM details""",
        ["details"],
    ),
    "aggs": ("SELECT side, short, arg_min(category, seq) AS category, CAST(sum(us) AS BIGINT) AS us, count(*) AS n FROM sides GROUP BY side, short", ["sides"]),
    "deltas": (
        """SELECT coalesce(a.short, b.short) AS short, coalesce(a.category, b.category) AS category, coalesce(a.us, 0) AS base_us, coalesce(b.us, 0) AS target_us, coalesce(b.us, 0) - coalesce(a.us, 0) AS delta_us,
  coalesce(a.n, 0) AS base_n, coalesce(b.n, 0) AS target_n FROM (SELECT * FROM aggs WHERE side = 'a') a FULL JOIN (SELECT * FROM aggs WHERE side = 'b') b ON a.short = b.short""",
        ["aggs"],
    ),
    "gk": (f"SELECT node_id AS correlation, correlation AS seq, name, ts, dur, {case('name', GRAPH_RULES, 'X')} AS kind, CAST(row_number() OVER (PARTITION BY node_id ORDER BY ts, correlation) - 1 AS BIGINT) AS pos, count(*) OVER (PARTITION BY node_id) AS size FROM kernels", ["kernels"]),
    "segs": (
        """SELECT correlation, seg, min(pos) AS first, count(*) AS n, bool_or(kind = 'ATTN' AND comms >= 2) AS attn, bool_or(kind = 'MOE' AND comms >= 2) AS moe, bool_or(comms >= 2) AS known FROM (
  SELECT *, CASE WHEN comms < 2 THEN 0 ELSE s END AS seg FROM (
    SELECT *, coalesce(sum(CAST(kind = 'COMM' AS BIGINT)) OVER (PARTITION BY correlation ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s, sum(CAST(kind = 'COMM' AS BIGINT)) OVER (PARTITION BY correlation) AS comms FROM gk)) GROUP BY correlation, seg""",
        ["gk"],
    ),
}


def query(body: str, *parts: str, recursive: str = "") -> str:
    """The body with the tables it names, and theirs, before it."""
    done: dict[str, str] = {}

    def add(p: str) -> None:
        if p not in done:
            for need in PARTS[p][1]:
                add(need)
            done[p] = f"{p} AS ({PARTS[p][0]})"

    for p in parts:
        add(p)
    ctes = [*done.values(), *([recursive] if recursive else [])]
    return f"WITH {'RECURSIVE ' if recursive else ''}{', '.join(ctes)} {body}" if ctes else body
