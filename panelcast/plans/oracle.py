"""DuckDB SQL for the queries of ``plans.testbed``.

The SQL keeps the literal forms that most Spark operators rewrite: the
small-category collapse as a union, the fan-out as the full four-step
left-join chain, Cramér's V as the textbook chi-square sum over every cell of
the table, the association grids by brute force over features x targets x
rows with the four cells of each 2 x 2 table, group totals by correlated
subqueries, and the silhouette over all pairs.  So agreement tests the
rewrites, not just the arithmetic.  Doubles are rounded and counts cast to BIGINT exactly
as on the Spark side.
"""

from __future__ import annotations

from panelcast.plans.testbed import PART_TYPES, PRIORITIES, SEGMENT_ORDER, SEGMENTS, STATUSES


def _values(name: str, values) -> str:
    rows = ", ".join("('" + v.replace("'", "''") + "')" for v in values)
    return f"(SELECT * FROM (VALUES {rows}) AS v({name}))"


def _q(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


ORDERS_SHARE = """
SELECT g.o_orderpriority, g.o_orderstatus,
       COUNT(*) * 100.0::DOUBLE / (SELECT COUNT(*) FROM orders t WHERE t.o_orderpriority = g.o_orderpriority) AS percentage
FROM orders g
WHERE g.o_orderpriority <> '5-LOW' AND g.o_orderstatus <> 'F'
GROUP BY g.o_orderpriority, g.o_orderstatus
"""

FANOUT = """
SELECT o.o_orderkey, o.o_totalprice AS salary, o.o_orderpriority, o.o_orderstatus,
       year(o.o_orderdate) AS o_year, s.s_name, p.p_type
FROM orders o
LEFT JOIN lineitem l1 ON o.o_orderkey = l1.l_orderkey
LEFT JOIN supplier s ON l1.l_suppkey = s.s_suppkey
LEFT JOIN lineitem l2 ON o.o_orderkey = l2.l_orderkey
LEFT JOIN part p ON l2.l_partkey = p.p_partkey
WHERE o.o_totalprice IS NOT NULL AND o.o_totalprice > 0 AND o.o_totalprice < 400000
"""


def _avg(dim: str, where: str = "TRUE") -> str:
    return f"""
WITH fan AS ({FANOUT})
SELECT {dim}, ROUND(AVG(salary), 4) AS average_salary
FROM fan WHERE {where}
GROUP BY {dim}
"""


def _collapse(label_expr: str, label: str, where: str, threshold: float) -> str:
    return f"""
WITH c AS (
    SELECT {label_expr} AS {label}, COUNT(*) AS cnt FROM part WHERE {where} GROUP BY 1
),
s AS (
    SELECT {label}, cnt, CAST(cnt AS DOUBLE) * 100.0 / (SELECT SUM(cnt) FROM c) AS pct FROM c
)
SELECT {label}, CAST(cnt AS BIGINT) AS cnt FROM s WHERE pct >= {threshold}
UNION ALL
SELECT 'Other' AS {label}, CAST(SUM(cnt) AS BIGINT) AS cnt FROM s WHERE pct < {threshold} HAVING COUNT(*) > 0
"""


def _adoption(item: str, lookup: str | None, lookup_id: str | None, label: str | None, src: str,
              worked: str, want: str, entity: str, how: str = "inner") -> str:
    # Who has a thing and who wants it, each pair once; then one count of either kind per thing.
    both = "HAVING bool_or(has) AND bool_or(NOT has)" if how == "inner" else ""
    counted = f"""
SELECT id, COUNT(who) FILTER (WHERE has) AS cnt, COUNT(who) FILTER (WHERE NOT has) AS want_cnt
FROM (SELECT DISTINCT {item} AS id, {entity} AS who, {worked} AS has FROM {src} WHERE {worked} OR {want})
WHERE id IS NOT NULL GROUP BY id {both}
"""
    if lookup is None:
        return counted
    kind = "JOIN" if how == "inner" else "LEFT JOIN"
    return f"SELECT c.id, {label} AS name, cnt, want_cnt FROM ({counted}) c {kind} {lookup} ON {lookup_id} = c.id"


COMBINED = """
SELECT c.c_mktsegment, p.p_type, o.o_orderpriority, o.o_orderstatus
FROM lineitem l
JOIN part p ON l.l_partkey = p.p_partkey
JOIN orders o ON l.l_orderkey = o.o_orderkey
JOIN customer c ON o.o_custkey = c.c_custkey
"""

PATHWAY_FLOWS = f"""
comb AS ({COMBINED}),
f AS (
    SELECT 0 AS hop, regexp_replace(c_mktsegment, '^\\s+|\\s+$', '', 'g') AS source,
           regexp_replace(p_type, '^\\s+|\\s+$', '', 'g') AS target, COUNT(*) AS cnt
    FROM comb GROUP BY 1, 2, 3
    UNION ALL
    SELECT 1 AS hop, regexp_replace(p_type, '^\\s+|\\s+$', '', 'g') AS source,
           regexp_replace(o_orderpriority, '^\\s+|\\s+$', '', 'g') AS target, COUNT(*) AS cnt
    FROM comb GROUP BY 1, 2, 3
),
ends AS (
    SELECT hop AS layer, source AS label FROM f
    UNION
    SELECT hop + 1 AS layer, target AS label FROM f
),
nodes AS (
    SELECT CAST(dense_rank() OVER (ORDER BY layer, label) - 1 AS BIGINT) AS node_id, layer, label FROM ends
)
"""

PATHWAY_FLOWS_NULL = PATHWAY_FLOWS.replace(f"comb AS ({COMBINED})", f"""
comb AS (SELECT * REPLACE (NULLIF(c_mktsegment, 'BUILDING') AS c_mktsegment, NULLIF(p_type, 'PROMO') AS p_type) FROM ({COMBINED}))""").replace(
    "ORDER BY layer, label)", "ORDER BY layer, label NULLS FIRST)")

INDICATOR_LONG = """
WITH lab AS (
    SELECT DISTINCT l.l_orderkey AS o_orderkey, p.p_type AS label
    FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey
),
ent AS (
    SELECT * FROM orders o WHERE EXISTS (SELECT 1 FROM lab WHERE lab.o_orderkey = o.o_orderkey)
)
SELECT o_orderkey, 'o_orderpriority' AS feature, o_orderpriority AS label FROM ent WHERE o_orderpriority IS NOT NULL
UNION ALL
SELECT o_orderkey, 'o_orderstatus' AS feature, o_orderstatus AS label FROM ent WHERE o_orderstatus IS NOT NULL
UNION ALL
SELECT o_orderkey, 'p_type' AS feature, label FROM lab
WHERE label IS NOT NULL AND o_orderkey IN (SELECT o_orderkey FROM orders)
"""

ORDER_SEGMENTS = """
SELECT o.o_orderkey, o.o_orderpriority AS x, c.c_mktsegment AS y
FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
"""


def _chi2(src: str) -> str:
    """Textbook Pearson chi-square over every cell of the r x c table."""
    return f"""
WITH e AS ({src}),
cells AS (SELECT x, y, COUNT(*) AS obs FROM e WHERE x IS NOT NULL AND y IS NOT NULL GROUP BY x, y),
rt AS (SELECT x, SUM(obs) AS r FROM cells GROUP BY x),
ct AS (SELECT y, SUM(obs) AS c FROM cells GROUP BY y),
tot AS (SELECT SUM(obs) AS n FROM cells),
full_table AS (
    SELECT rt.r, ct.c, COALESCE(cells.obs, 0) AS obs
    FROM rt CROSS JOIN ct LEFT JOIN cells ON cells.x = rt.x AND cells.y = ct.y
),
chi AS (
    SELECT SUM(POWER(obs - r * c / tot.n, 2) / (r * c / tot.n)) AS chi2,
           (SELECT COUNT(*) FROM rt) AS nr, (SELECT COUNT(*) FROM ct) AS nc, MAX(tot.n) AS n
    FROM full_table, tot
)
SELECT ROUND(chi2, 4) AS chi2, CAST((nr - 1) * (nc - 1) AS BIGINT) AS dof, CAST(n AS BIGINT) AS n,
       ROUND(SQRT(chi2 / n / NULLIF(LEAST(nr, nc) - 1, 0)), 6) AS v
FROM chi
"""


# Pearson chi-square of the 2 x 2 crosstab of two indicators, no correction.
FOUR_CELLS = """
        POWER(a - r * k / n, 2) / NULLIF(r * k / n, 0)
        + POWER((r - a) - r * (n - k) / n, 2) / NULLIF(r * (n - k) / n, 0)
        + POWER((k - a) - (n - r) * k / n, 2) / NULLIF((n - r) * k / n, 0)
        + POWER((n - r - k + a) - (n - r) * (n - k) / n, 2) / NULLIF((n - r) * (n - k) / n, 0)
"""

GRID = f"""
WITH e AS ({ORDER_SEGMENTS}),
g AS (
    SELECT f.feature, t.target,
           CAST(SUM(CASE WHEN e.x = f.feature AND e.y = t.target THEN 1 ELSE 0 END) AS DOUBLE) AS a,
           CAST(SUM(CASE WHEN e.x = f.feature THEN 1 ELSE 0 END) AS DOUBLE) AS r,
           CAST(SUM(CASE WHEN e.y = t.target THEN 1 ELSE 0 END) AS DOUBLE) AS k,
           CAST(COUNT(*) AS DOUBLE) AS n
    FROM {_values("feature", PRIORITIES)} f CROSS JOIN {_values("target", SEGMENTS)} t CROSS JOIN e
    GROUP BY f.feature, t.target
),
chi AS (
    SELECT *, {FOUR_CELLS} AS chi2
    FROM g
)
SELECT feature, target, CAST(a AS BIGINT) AS n11, CAST(r AS BIGINT) AS r, CAST(k AS BIGINT) AS k,
       CAST(n AS BIGINT) AS n, SQRT(chi2 / n) AS v
FROM chi
"""


def _wide() -> str:
    cols = ",\n       ".join(
        f"CAST(MAX(CASE WHEN label = '{v}' THEN 1 ELSE 0 END) AS INTEGER) AS {_q(v)}"
        for v in PRIORITIES + STATUSES + PART_TYPES
    )
    return f"WITH long AS ({INDICATOR_LONG})\nSELECT o_orderkey,\n       {cols}\nFROM long GROUP BY o_orderkey"


def _vectors(value: str) -> str:
    """One row per order and place of the vocabulary; x is 1 where the order has its label."""
    vocab = ", ".join(f"({i}, '{v}')" for i, v in enumerate(PART_TYPES + PRIORITIES))
    return f"""
WITH long AS ({INDICATOR_LONG}),
dense AS (
    SELECT e.o_orderkey, v.idx, COUNT(l.label) AS x
    FROM (SELECT DISTINCT o_orderkey FROM long) e
    CROSS JOIN (VALUES {vocab}) v(idx, label)
    LEFT JOIN long l ON l.o_orderkey = e.o_orderkey AND l.label = v.label AND l.feature <> 'o_orderstatus'
    GROUP BY e.o_orderkey, v.idx
)
SELECT o_orderkey, CAST(idx AS INTEGER) AS idx, {value} AS value FROM dense
"""


def _pivot() -> str:
    cols = ",\n       ".join(
        f"ROUND(COALESCE(MAX(CASE WHEN o_orderstatus = '{v}' THEN percentage END), 0.0), 6) AS {_q(v)}"
        for v in STATUSES
    )
    return f"WITH s AS ({ORDERS_SHARE})\nSELECT o_orderpriority,\n       {cols}\nFROM s GROUP BY o_orderpriority"


_ORD = " ".join(f"WHEN '{v}' THEN {i}" for i, v in enumerate(SEGMENT_ORDER, start=1))

def _moments() -> str:
    """Sums of x_i * x_j over the normalised vectors, x_0 = 1, pair by pair."""
    unit = _vectors("x / SQRT(SUM(x * x) OVER (PARTITION BY o_orderkey))")
    return f"""
SELECT a.i, b.i AS j, SUM(a.v * b.v) AS value
FROM (SELECT o_orderkey, idx + 1 AS i, value AS v FROM ({unit}) u
      UNION ALL SELECT DISTINCT o_orderkey, 0, 1.0::DOUBLE FROM ({unit}) u) a
JOIN (SELECT o_orderkey, idx + 1 AS i, value AS v FROM ({unit}) u
      UNION ALL SELECT DISTINCT o_orderkey, 0, 1.0::DOUBLE FROM ({unit}) u) b USING (o_orderkey)
GROUP BY 1, 2
"""


ORACLE = {
    "group_share": f"""
SELECT o_orderpriority, o_orderstatus, ROUND(percentage, 6) AS percentage FROM ({ORDERS_SHARE}) s
""",
    "stored_group_share": f"""
SELECT o_orderpriority, o_orderstatus, ROUND(percentage, 6) AS percentage FROM ({ORDERS_SHARE}) s
""",
    "relabelled_distribution": """
SELECT CASE WHEN p_type IN ('ECONOMY', 'PROMO') THEN 'Low price' WHEN p_type = 'STANDARD' THEN 'Ordinary' ELSE p_type END AS p_type,
       CAST(COUNT(*) AS BIGINT) AS cnt
FROM part WHERE p_type IS NOT NULL GROUP BY 1
""",
    "bucketed_fanout_base": f"""
WITH fan AS ({FANOUT})
SELECT o_orderkey, salary, CAST(COUNT(*) AS BIGINT) AS weight FROM fan GROUP BY o_orderkey, salary
""",
    "bucketed_avg_by_item": _avg("p_type", "p_type <> 'PROMO'"),
    "bucketed_pair_flows": """
SELECT 0 AS hop, o_orderpriority AS source, p_type AS target, CAST(COUNT(*) AS BIGINT) AS "count"
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey GROUP BY 2, 3
""",
    "group_share_answered": """
SELECT g.source, g.lang,
       ROUND(COUNT(*) * 100.0::DOUBLE / (SELECT COUNT(*) FROM documents t WHERE t.source = g.source AND t.lang <> 'es'), 6) AS percentage
FROM documents g WHERE g.source IS NOT NULL AND g.lang <> 'es' GROUP BY g.source, g.lang
""",
    "pivot_share": _pivot(),
    "pivot_share_rest": f"""
SELECT o_orderpriority, ROUND(COALESCE(SUM(percentage) FILTER (WHERE o_orderstatus = 'O'), 0), 6) AS "O",
       ROUND(COALESCE(SUM(percentage) FILTER (WHERE o_orderstatus <> 'O'), 0), 6) AS rest
FROM ({ORDERS_SHARE}) GROUP BY o_orderpriority
""",
    "distribution_ordered": f"""
SELECT c_mktsegment, CAST(COUNT(*) AS BIGINT) AS cnt,
       CAST(CASE c_mktsegment {_ORD} ELSE 6 END AS INTEGER) AS ord
FROM customer
WHERE c_mktsegment IS NOT NULL AND c_acctbal IS NOT NULL AND c_mktsegment <> 'NA'
GROUP BY c_mktsegment
""",
    "distribution": """
SELECT event_type, CAST(COUNT(*) AS BIGINT) AS cnt FROM events
WHERE event_type IS NOT NULL AND event_type <> 'error'
GROUP BY event_type
""",
    "breakdown_collapsed": _collapse("p_brand", "p_brand",
                                     "p_type = 'MEDIUM' AND p_brand IS NOT NULL AND p_brand <> 'NA'", 4),
    "collapse_small": _collapse("CAST(p_size AS VARCHAR)", "p_size", "p_size IS NOT NULL", 2),
    "fanout_base": f"""
WITH fan AS ({FANOUT})
SELECT o_orderkey, salary, CAST(COUNT(*) AS BIGINT) AS weight FROM fan GROUP BY o_orderkey, salary
""",
    "avg_by_attribute": _avg("o_orderpriority", "o_orderpriority <> '4-NOT SPECIFIED'"),
    "avg_by_status": _avg("o_orderstatus"),
    "avg_by_item": _avg("p_type", "p_type <> 'PROMO'"),
    "avg_by_item_keep_null": _avg("s_name"),
    "avg_by_key_sorted": _avg("o_year"),
    "avg_by_attribute_entity": """
SELECT o_orderpriority, ROUND(AVG(o_totalprice), 4) AS average_salary FROM orders
WHERE o_totalprice IS NOT NULL AND o_totalprice > 0 AND o_totalprice < 400000
  AND o_orderpriority <> '4-NOT SPECIFIED'
GROUP BY o_orderpriority
""",
    "histogram": """
SELECT b.range AS bin, CASE WHEN b.range >= 0 THEN b.range * 10000.0::DOUBLE END AS bin_lo,
       CASE WHEN b.range < 50 THEN (b.range + 1) * 10000.0::DOUBLE END AS bin_hi,
       (SELECT COUNT(*) FROM orders
        WHERE CASE WHEN o_totalprice < 0 THEN -1 WHEN o_totalprice > 500000 THEN 50
                   ELSE LEAST(FLOOR(o_totalprice / 10000.0::DOUBLE), 49) END = b.range) AS cnt
FROM range(-1, 51) b
""",
    "histogram_auto": """
WITH e AS (SELECT MIN(o_totalprice)::DOUBLE AS lo, MAX(o_totalprice)::DOUBLE AS hi, (hi - lo) / 20.0::DOUBLE AS w FROM orders)
SELECT b.range AS bin, ROUND(lo + b.range * w, 4) AS bin_lo, ROUND(lo + (b.range + 1) * w, 4) AS bin_hi,
       (SELECT COUNT(*) FROM orders, e WHERE LEAST(FLOOR((o_totalprice - lo) / w), 19) = b.range) AS cnt
FROM range(0, 20) b, e
""",
    "histogram_nice": """
WITH r AS (SELECT MIN(o_totalprice)::DOUBLE AS lo, MAX(o_totalprice)::DOUBLE AS hi FROM orders),
s AS (
    SELECT MIN(m * POW(10.0, e)) AS step
    FROM r, (VALUES (1.0::DOUBLE), (2.0::DOUBLE), (5.0::DOUBLE)) v(m), range(0, 9) t(e)
    WHERE FLOOR(hi / (m * POW(10.0, e))) - FLOOR(lo / (m * POW(10.0, e))) < 60),
b AS (SELECT unnest(range(0, CAST(FLOOR(hi / step) - FLOOR(lo / step) AS BIGINT) + 1)) AS bin, FLOOR(lo / step) AS first, step FROM r, s)
SELECT bin, ROUND((first + bin) * step, 6) AS bin_lo, ROUND((first + bin + 1) * step, 6) AS bin_hi,
       (SELECT COUNT(*) FROM orders WHERE FLOOR(o_totalprice / step) - first = bin) AS cnt
FROM b
""",
    "histogram_weighted": f"""
WITH fan AS ({FANOUT}),
b AS (
    SELECT LEAST(CAST(FLOOR((salary - 0.0) / 10000.0) AS BIGINT), 39) AS bin FROM fan
    WHERE salary >= 0 AND salary <= 400000
),
c AS (SELECT bin, COUNT(*) AS cnt FROM b GROUP BY bin)
SELECT r.range AS bin, CAST(r.range AS DOUBLE) * 10000.0 AS bin_lo, CAST(r.range + 1 AS DOUBLE) * 10000.0 AS bin_hi,
       CAST(COALESCE(c.cnt, 0) AS BIGINT) AS cnt
FROM range(0, 40) r LEFT JOIN c ON r.range = c.bin
""",
    "adoption_vs_demand_part": _adoption("l_partkey", "part", "p_partkey", "p_name", "lineitem",
                                         "l_returnflag = 'A'", "l_returnflag = 'R'", "l_orderkey"),
    "adoption_vs_demand_supplier": _adoption("l_suppkey", "supplier", "s_suppkey", "s_name", "lineitem",
                                             "l_returnflag = 'A'", "l_returnflag = 'R'", "l_orderkey"),
    "adoption_vs_demand_event": _adoption("TRY_CAST(props->>'$.k' AS BIGINT)", None, None, None, "events",
                                          "event_type = 'click'", "event_type = 'purchase'", "user_id"),
    "adoption_vs_demand_full": _adoption("l_partkey", "part", "p_partkey", "p_name", "lineitem",
                                         "l_returnflag = 'A'", "l_returnflag = 'R'", "l_orderkey", how="full"),
    "adoption_families": " UNION ALL ".join(
        f"SELECT '{family}' AS family, CAST({key} AS VARCHAR) AS id, {label} AS name, cnt, want_cnt FROM ("
        f"SELECT t.{key}, t.{label}, COUNT(DISTINCT CASE WHEN l_returnflag = 'A' THEN l_orderkey END) AS cnt, "
        f"COUNT(DISTINCT CASE WHEN l_returnflag = 'R' THEN l_orderkey END) AS want_cnt "
        f"FROM lineitem JOIN {family} t ON {item} = t.{key} GROUP BY 1, 2) c WHERE cnt > 0 AND want_cnt > 0"
        for family, key, label, item in (("part", "p_partkey", "p_name", "l_partkey"), ("supplier", "s_suppkey", "s_name", "l_suppkey"))),
    "entity_sketches": "SELECT COUNT(DISTINCT l_suppkey) AS n_items, CAST(0 AS BIGINT) AS n_off FROM lineitem",
    "fanout_breakdowns": f"WITH fan AS ({FANOUT}) " + " UNION ALL ".join(
        f"SELECT '{dim}' AS dim, CAST({value} AS VARCHAR) AS value, ROUND(AVG(salary), 4) AS average, COUNT(*) AS cnt FROM fan {where} GROUP BY 2"
        for dim, value, where in (
            ("o_orderpriority", "o_orderpriority", "WHERE o_orderpriority <> '4-NOT SPECIFIED'"), ("o_orderstatus", "o_orderstatus", ""),
            ("o_year", "o_year", ""), ("s_name", "s_name", ""), ("p_type", "p_type", "WHERE p_type <> 'PROMO'"),
            ("bin", "LEAST(CAST(FLOOR(salary / 10000.0) AS BIGINT), 39)", ""))),
    "clean_entities": """
SELECT d.doc_id, d.lang, d.source, l.quality, l.toxic
FROM documents d JOIN labels l ON d.doc_id = l.doc_id
WHERE d.source IS NOT NULL AND d.lang IS NOT NULL AND d.lang <> 'NA' AND d.source NOT LIKE 'src1%'
""",
    "decode": """
SELECT l.l_orderkey, p.p_type FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey
""",
    "pair_flows": f"""
WITH comb AS ({COMBINED})
SELECT 0 AS hop, c_mktsegment AS source, p_type AS target, CAST(COUNT(*) AS BIGINT) AS "count" FROM comb GROUP BY 2, 3
UNION ALL
SELECT 1 AS hop, p_type AS source, o_orderpriority AS target, CAST(COUNT(*) AS BIGINT) AS "count" FROM comb GROUP BY 2, 3
UNION ALL
SELECT 2 AS hop, p_type AS source, o_orderstatus AS target, CAST(COUNT(*) AS BIGINT) AS "count" FROM comb GROUP BY 2, 3
""",
    "flow_nodes": f"WITH {PATHWAY_FLOWS}\nSELECT node_id, layer, label FROM nodes",
    "flow_links": f"""
WITH {PATHWAY_FLOWS}
SELECT s.node_id AS source_id, t.node_id AS target_id, CAST(SUM(f.cnt) AS BIGINT) AS value
FROM f
JOIN nodes s ON s.layer = f.hop AND s.label IS NOT DISTINCT FROM f.source
JOIN nodes t ON t.layer = f.hop + 1 AND t.label IS NOT DISTINCT FROM f.target
GROUP BY 1, 2
""",
    "flow_links_null": f"""
WITH {PATHWAY_FLOWS_NULL}
SELECT s.node_id AS source_id, t.node_id AS target_id, CAST(SUM(f.cnt) AS BIGINT) AS value
FROM f
JOIN nodes s ON s.layer = f.hop AND s.label IS NOT DISTINCT FROM f.source
JOIN nodes t ON t.layer = f.hop + 1 AND t.label IS NOT DISTINCT FROM f.target
GROUP BY 1, 2
""",
    "indicator_long": INDICATOR_LONG,
    "indicator_wide": _wide(),
    "indicator_vectors": _vectors("CAST(x AS DOUBLE)"),
    "normalized_vectors": _vectors("ROUND(x / SQRT(SUM(x * x) OVER (PARTITION BY o_orderkey)), 6)"),
    "distinct_vectors": f"""
SELECT vector, COUNT(*) AS weight
FROM (SELECT o_orderkey, string_agg(CAST(CAST(value AS INT) AS VARCHAR), '' ORDER BY idx) AS vector
      FROM ({_vectors("CAST(x AS DOUBLE)")}) u GROUP BY o_orderkey) v
GROUP BY vector
""",
    "silhouette_labels": """
WITH far AS (
    SELECT a.vec_id, a.label = b.label AS same, b.label,
           AVG(1 - list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[])) AS mean
    FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id
    GROUP BY a.vec_id, a.label = b.label, b.label),
ab AS (
    SELECT vec_id, MIN(mean) FILTER (WHERE same) AS a, MIN(mean) FILTER (WHERE NOT same) AS b
    FROM far GROUP BY vec_id)
SELECT ROUND(AVG(CASE WHEN a IS NULL THEN 0 WHEN a < b THEN 1 - a / b WHEN a > b THEN b / a - 1 ELSE 0 END), 6) AS silhouette
FROM ab
""",
    "second_moments": f"SELECT i, j, ROUND(value, 4) AS value FROM ({_moments()}) m",
    "cluster_proof": f"""
SELECT COUNT(DISTINCT o_orderkey) AS n, CAST(0 AS BIGINT) AS n_nearer,
       CAST({3 * len(PART_TYPES + PRIORITIES)} AS BIGINT) AS n_cells, CAST(0 AS BIGINT) AS n_off
FROM ({_vectors("CAST(x AS DOUBLE)")}) u
""",
    "components_proof": f"""
SELECT component, CAST({len(PART_TYPES + PRIORITIES)} AS BIGINT) AS dims, trace, CAST(0 AS BIGINT) AS n_off, 1.0::DOUBLE AS length
FROM (SELECT ROUND((SUM(own) - SUM(s * s) / MAX(n)) / (MAX(n) - 1), 6) AS trace
      FROM (SELECT i, MAX(CASE WHEN j = i THEN value END) AS own, MAX(CASE WHEN j = 0 THEN value END) AS s
            FROM ({_moments()}) m WHERE i > 0 GROUP BY i) g,
           (SELECT value AS n FROM ({_moments()}) m WHERE i = 0 AND j = 0) c) t,
     (VALUES (1), (2)) k(component)
""",
    "contingency": """
SELECT o.o_orderpriority, c.c_mktsegment, CAST(COUNT(*) AS BIGINT) AS cnt
FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
WHERE o.o_orderpriority IS NOT NULL AND c.c_mktsegment IS NOT NULL
GROUP BY 1, 2
""",
    "cramers_v": _chi2(ORDER_SEGMENTS),
    "association_grid": f"SELECT feature, target, n11, r, k, n, ROUND(v, 6) AS v FROM ({GRID}) g",
    "association_grid_multi": f"""
SELECT feature, target, CAST(a AS BIGINT) AS n11, CAST(r AS BIGINT) AS r, CAST(k AS BIGINT) AS k, CAST(n AS BIGINT) AS n,
       ROUND(SQRT(({FOUR_CELLS}) / n), 6) AS v
FROM (SELECT feature, target,
             COUNT(CASE WHEN both_seen THEN 1 END)::DOUBLE AS a, COUNT(CASE WHEN f1 THEN 1 END)::DOUBLE AS r,
             COUNT(CASE WHEN t1 THEN 1 END)::DOUBLE AS k, COUNT(*)::DOUBLE AS n
      FROM (SELECT feature, target, l_orderkey, bool_or(l_returnflag = feature AND l_linestatus = target) AS both_seen,
                   bool_or(l_returnflag = feature) AS f1, bool_or(l_linestatus = target) AS t1
            FROM lineitem, (VALUES ('A'), ('N'), ('R'), ('X')) f(feature), (VALUES ('F'), ('O')) t(target)
            GROUP BY feature, target, l_orderkey)
      GROUP BY feature, target) g
""",
    "top_associations": f"""
SELECT feature, target, n11, r, k, n, ROUND(v, 6) AS v FROM ({GRID}) g
ORDER BY v DESC NULLS LAST, feature, target LIMIT 10
""",
    "association_labels": _chi2("SELECT doc_id, quality AS x, toxic AS y FROM labels"),
}
