"""Queries over the lineage relation and around it, on the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import lineage as L
from ..operators.closure import closure
from ..operators.metrics import kappa, prf, sample_candidates, set_prf
from ..operators.retrieval import bm25, budget_pack, chunks, code_chunks, top_ranked
from ..operators.versions import latest_version
from ..session import durable
from ..sources.repository import Scope, run_order
from .hierarchies import node_id
from .registry import Registry
from .tables import table

query = Registry()


def edges(spark: SparkSession, d: str) -> DataFrame:
    held = latest_version(table(spark, d, "edges"), "edge_id")
    ends = {c: F.coalesce(node_id(c), F.when(F.col(c).isNotNull(), F.lit(L.UNRESOLVED))) for c in ("source", "right_source", "target")}
    return held.withColumns(ends)


_FORM = r"CASE WHEN {c} IS NULL THEN NULL WHEN starts_with(x_{c}, '<unresolved>') THEN '<unresolved>' WHEN starts_with(x_{c}, 'table:') THEN lower(x_{c}) ELSE x_{c} END"
_TRIM = r"replace(regexp_replace({c}, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g'), '\', '/')"
EDGES = f"""
WITH RECURSIVE held0 AS (
  SELECT *, {_TRIM.replace("{c}", "source")} AS x_source, {_TRIM.replace("{c}", "right_source")} AS x_right_source, {_TRIM.replace("{c}", "target")} AS x_target
  FROM edges QUALIFY row_number() OVER (PARTITION BY edge_id ORDER BY ingested_ts DESC NULLS LAST) = 1
), e AS (
  SELECT * EXCLUDE (source, right_source, target, x_source, x_right_source, x_target), {_FORM.format(c="source")} AS source, {_FORM.format(c="right_source")} AS right_source, {_FORM.format(c="target")} AS target FROM held0
)
"""
_TABLE_LINKS = EDGES + """
, tl AS (SELECT DISTINCT r.graph_id, r.source AS src, w.target AS dst FROM e r JOIN e w ON r.graph_id = w.graph_id AND r.file = w.file AND r.kind = 'reads' AND w.kind = 'writes' WHERE r.source <> w.target)
"""


# ---- tables of a graph ---------------------------------------------------------------------------


@query(EDGES + """, t AS (SELECT graph_id, source AS tbl, true AS r, false AS w FROM e WHERE kind = 'reads' AND source IS NOT NULL UNION ALL SELECT graph_id, target, false, true FROM e WHERE kind = 'writes' AND target IS NOT NULL)
SELECT graph_id, tbl AS "table", CASE WHEN bool_or(r) AND bool_or(w) THEN 'mid' WHEN bool_or(w) THEN 'sink' ELSE 'source' END AS tier FROM t GROUP BY ALL""")
def table_tiers(spark, d):
    return L.table_tiers(edges(spark, d))


@query(EDGES + """, t AS (SELECT graph_id, source AS tbl, file, ordinal, 'r' AS how FROM e WHERE kind = 'reads' AND source LIKE 'table:%' UNION ALL SELECT graph_id, target, file, ordinal, 'w' FROM e WHERE kind = 'writes' AND target LIKE 'table:%'),
f AS (SELECT graph_id, tbl, how, file, min(ordinal) AS pos FROM t WHERE file IS NOT NULL GROUP BY ALL)
SELECT graph_id, tbl AS "table", coalesce(string_agg(file, ';' ORDER BY pos, file) FILTER (how = 'w'), '') AS written_by, coalesce(string_agg(file, ';' ORDER BY pos, file) FILTER (how = 'r'), '') AS read_by FROM f GROUP BY ALL""")
def merge_tables(spark, d):
    return L.merged_tables(edges(spark, d)).select("graph_id", "table", F.array_join("written_by", ";").alias("written_by"), F.array_join("read_by", ";").alias("read_by"))


@query(EDGES + """, t AS (SELECT graph_id, source AS id, file, ordinal, 'r' AS how FROM e WHERE kind = 'reads' AND source LIKE 'ext:%' UNION ALL SELECT graph_id, target, file, ordinal, 'w' FROM e WHERE kind = 'writes' AND target LIKE 'ext:%'),
f AS (SELECT graph_id, id, how, file, min(ordinal) AS pos FROM t WHERE file IS NOT NULL GROUP BY ALL)
SELECT graph_id, id AS external, coalesce(string_agg(file, ';' ORDER BY pos, file) FILTER (how = 'w'), '') AS written_by, coalesce(string_agg(file, ';' ORDER BY pos, file) FILTER (how = 'r'), '') AS read_by FROM f GROUP BY ALL""")
def merge_external(spark, d):
    """Files and streams outside the catalog, with the files of the repository that touch them."""
    return L.merged_tables(edges(spark, d), "ext:").select("graph_id", F.col("table").alias("external"), F.array_join("written_by", ";").alias("written_by"), F.array_join("read_by", ";").alias("read_by"))


@query(_TABLE_LINKS + """, up AS (SELECT graph_id, src, dst FROM tl UNION SELECT up.graph_id, up.src, tl.dst FROM up JOIN tl ON tl.graph_id = up.graph_id AND tl.src = up.dst)
SELECT graph_id, src AS seed, dst AS node FROM up""")
def table_impact(spark, d):
    links = durable(L.table_links(edges(spark, d)), "links")
    return closure(links, links.select("graph_id", F.col("src").alias("seed"), F.col("src").alias("node")), group="graph_id").select("graph_id", "seed", "node")


@query(EDGES + """, ends AS (SELECT graph_id, source AS id FROM e UNION SELECT graph_id, right_source FROM e UNION SELECT graph_id, target FROM e),
w AS (SELECT DISTINCT graph_id, target AS id FROM e)
SELECT graph_id, id FROM ends WHERE id IS NOT NULL AND id LIKE 'df:%' AND NOT EXISTS (SELECT 1 FROM w WHERE w.graph_id = ends.graph_id AND w.id = ends.id)""")
def orphan_nodes(spark, d):
    """Intermediate nodes that nothing produces."""
    e = edges(spark, d)
    ends = e.select("graph_id", F.explode(F.array("source", "right_source", "target")).alias("id")).filter("id like 'df:%'").distinct()
    return ends.join(e.select("graph_id", F.col("target").alias("id")).filter("id is not null").distinct(), ["graph_id", "id"], "left_anti")


@query("SELECT p_partkey FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity > 45)")
def orphan_parts(spark, d):
    return table(spark, d, "part").select("p_partkey").join(table(spark, d, "lineitem").filter("l_quantity > 45").select(F.col("l_partkey").alias("p_partkey")), "p_partkey", "left_anti")


@query(EDGES + """, dup AS (SELECT graph_id, edge_id FROM edges GROUP BY ALL HAVING count(*) > 1),
ends AS (SELECT graph_id, source AS id FROM e UNION SELECT graph_id, right_source FROM e)
SELECT 'duplicate id' AS problem, graph_id, edge_id AS id FROM dup
UNION ALL SELECT 'dangling end', graph_id, id FROM ends WHERE id IS NOT NULL AND NOT starts_with(id, '<unresolved>') AND NOT starts_with(id, 'table:') AND NOT starts_with(id, 'ext:') AND NOT EXISTS (SELECT 1 FROM e w WHERE w.graph_id = ends.graph_id AND w.target = ends.id)""")
def integrity_checks(spark, d):
    """Edge ids that occur twice in the raw readings, and intermediate nodes that are read though nothing makes them."""
    return L.integrity(table(spark, d, "edges").select("graph_id", "edge_id"), edges(spark, d))


# ---- provenance and impact -----------------------------------------------------------------------

_STEPS = EDGES + """
, comp AS (
  SELECT DISTINCT graph_id, target AS node, output_col AS col, source AS from_node, c AS from_col FROM (SELECT * FROM e WHERE kind = 'derives' AND output_col IS NOT NULL) LEFT JOIN LATERAL unnest(source_cols) AS u(c) ON true
  UNION SELECT graph_id, target, a.output, source, a.input FROM e, unnest(aggs) AS u(a) WHERE kind = 'aggregates' AND a.output IS NOT NULL
  UNION SELECT graph_id, target, k, source, k FROM e, unnest(group_keys) AS u(k) WHERE kind = 'aggregates' AND k IS NOT NULL
), computed_keys AS (SELECT DISTINCT graph_id, node, col FROM comp),
pass AS (
  SELECT DISTINCT graph_id, target AS node, source AS from_node, CASE WHEN kind = 'projects' THEN kept_cols END AS only_cols FROM e
  WHERE (kind IN ('derives', 'filters', 'reads', 'writes', 'projects') OR (kind = 'opaque_transform' AND is_passthrough)) AND source IS NOT NULL
  UNION SELECT graph_id, target, source, NULL FROM e WHERE kind = 'joins' AND source IS NOT NULL
  UNION SELECT graph_id, target, right_source, NULL FROM e WHERE kind = 'joins' AND right_source IS NOT NULL AND coalesce(join_type, '') NOT IN ('left_semi', 'left_anti')
), writes AS (SELECT DISTINCT graph_id, target AS tbl, source AS node FROM e WHERE kind = 'writes' AND target IS NOT NULL),
closed AS (SELECT DISTINCT graph_id, target AS node FROM e WHERE kind = 'aggregates' OR (kind = 'projects' AND kept_cols IS NOT NULL)),
scope AS (
  SELECT graph_id, tbl, node FROM writes
  UNION SELECT s.graph_id, s.tbl, p.from_node FROM scope s JOIN pass p ON p.graph_id = s.graph_id AND p.node = s.node
    WHERE NOT starts_with(p.from_node, 'table:') AND NOT starts_with(p.from_node, 'ext:') AND NOT EXISTS (SELECT 1 FROM closed c WHERE c.graph_id = s.graph_id AND c.node = s.node)
), named AS (SELECT graph_id, node, col FROM comp UNION SELECT graph_id, target, c FROM e, unnest(kept_cols) AS u(c) WHERE kind = 'projects'),
base_cols AS (SELECT DISTINCT s.graph_id, s.tbl, n.col FROM scope s JOIN named n ON n.graph_id = s.graph_id AND n.node = s.node WHERE n.col IS NOT NULL),
onto AS (
  SELECT DISTINCT s.graph_id, s.tbl, p.from_node AS up FROM scope s JOIN pass p ON p.graph_id = s.graph_id AND p.node = s.node
  WHERE (starts_with(p.from_node, 'table:') OR starts_with(p.from_node, 'ext:')) AND NOT starts_with(s.node, 'table:') AND NOT starts_with(s.node, 'ext:') AND NOT EXISTS (SELECT 1 FROM closed c WHERE c.graph_id = s.graph_id AND c.node = s.node)
  UNION SELECT graph_id, tbl, node FROM writes WHERE starts_with(node, 'table:') OR starts_with(node, 'ext:')
), above AS (SELECT graph_id, tbl, up FROM onto UNION SELECT a.graph_id, a.tbl, o.up FROM above a JOIN onto o ON o.graph_id = a.graph_id AND o.tbl = a.up),
wanted AS (SELECT graph_id, tbl, col FROM base_cols UNION SELECT a.graph_id, a.tbl, b.col FROM above a JOIN base_cols b ON b.graph_id = a.graph_id AND b.tbl = a.up),
step AS (
  SELECT graph_id, node, col, from_node, from_col, CAST(NULL AS VARCHAR[]) AS only_cols, 1 AS how FROM comp WHERE from_col IS NOT NULL
  UNION ALL SELECT graph_id, node, NULL, from_node, NULL, only_cols, 2 FROM pass
), walk AS (
  SELECT w.graph_id, w.tbl, x.col AS column_name, w.node, x.col FROM writes w JOIN wanted x ON x.graph_id = w.graph_id AND x.tbl = w.tbl
  UNION
  SELECT k.graph_id, k.tbl, k.column_name, s.from_node, coalesce(s.from_col, k.col) FROM walk k JOIN step s ON s.graph_id = k.graph_id AND s.node = k.node
  WHERE NOT starts_with(k.node, 'table:') AND NOT starts_with(k.node, 'ext:')
    AND ((s.how = 1 AND s.col = k.col) OR (s.how = 2 AND (s.only_cols IS NULL OR list_contains(s.only_cols, k.col)) AND NOT EXISTS (SELECT 1 FROM computed_keys c WHERE c.graph_id = k.graph_id AND c.node = k.node AND c.col = k.col)))
), prov AS (SELECT DISTINCT graph_id, tbl, column_name, node AS from_table, col AS from_column FROM walk WHERE starts_with(node, 'table:') OR starts_with(node, 'ext:'))
"""


@query(_STEPS + """SELECT graph_id, tbl AS "table", column_name AS "column", from_table, from_column FROM prov""")
def provenance_sources(spark, d):
    return L.provenance(edges(spark, d)).drop("role")


@query(_STEPS + """
, role_of AS (
  SELECT DISTINCT graph_id, target AS node, output_col AS col, source AS from_node, c AS from_col, 'derived' AS role FROM (SELECT * FROM e WHERE kind = 'derives' AND output_col IS NOT NULL) LEFT JOIN LATERAL unnest(source_cols) AS u(c) ON true
  UNION SELECT graph_id, target, a.output, source, a.input, 'aggregate' FROM e, unnest(aggs) AS u(a) WHERE kind = 'aggregates' AND a.output IS NOT NULL
  UNION SELECT graph_id, target, k, source, k, 'group_key' FROM e, unnest(group_keys) AS u(k) WHERE kind = 'aggregates' AND k IS NOT NULL
), rstep AS (
  SELECT graph_id, node, col, from_node, from_col, role, CAST(NULL AS VARCHAR[]) AS only_cols, 1 AS how FROM role_of WHERE from_col IS NOT NULL
  UNION ALL SELECT graph_id, node, NULL, from_node, NULL, NULL, only_cols, 2 FROM pass
), rwalk AS (
  SELECT w.graph_id, w.tbl, x.col AS column_name, w.node, x.col, 'passthrough' AS role, 0 AS round FROM writes w JOIN wanted x ON x.graph_id = w.graph_id AND x.tbl = w.tbl
  UNION
  SELECT k.graph_id, k.tbl, k.column_name, s.from_node, coalesce(s.from_col, k.col), CASE WHEN k.role = 'passthrough' THEN coalesce(s.role, k.role) ELSE k.role END, k.round + 1 FROM rwalk k JOIN rstep s ON s.graph_id = k.graph_id AND s.node = k.node
  WHERE k.round < 60 AND NOT starts_with(k.node, 'table:') AND NOT starts_with(k.node, 'ext:')
    AND ((s.how = 1 AND s.col = k.col) OR (s.how = 2 AND (s.only_cols IS NULL OR list_contains(s.only_cols, k.col)) AND NOT EXISTS (SELECT 1 FROM computed_keys c WHERE c.graph_id = k.graph_id AND c.node = k.node AND c.col = k.col)))
), first_seen AS (SELECT *, min(round) OVER (PARTITION BY graph_id, tbl, column_name, node, col) AS soonest FROM rwalk)
SELECT graph_id, tbl AS "table", column_name AS "column", min(role) AS role, node AS from_table, col AS from_column FROM first_seen WHERE round = soonest AND (starts_with(node, 'table:') OR starts_with(node, 'ext:')) GROUP BY ALL""")
def provenance_roles(spark, d):
    return L.provenance(edges(spark, d))


@query(_STEPS + """
, fwd AS (SELECT DISTINCT graph_id, regexp_replace(from_table, '^(table|ext):', '') || '.' || from_column AS src, regexp_replace(tbl, '^(table|ext):', '') || '.' || column_name AS dst FROM prov),
reach AS (SELECT graph_id, src, dst FROM fwd UNION SELECT r.graph_id, r.src, f.dst FROM reach r JOIN fwd f ON f.graph_id = r.graph_id AND f.src = r.dst)
SELECT graph_id, src AS seed, CAST(count(*) AS BIGINT) AS impacted FROM reach GROUP BY ALL""")
def column_impact_counts(spark, d):
    """How many columns a change of each source column reaches."""
    fwd = durable(L.forward_index(L.provenance(edges(spark, d))), "forward")
    reach = closure(fwd, fwd.select("graph_id", F.col("src").alias("seed"), F.col("src").alias("node")), group="graph_id")
    return reach.groupBy("graph_id", "seed").agg(F.count("*").alias("impacted"))


@query(_STEPS + """
, before AS (
  SELECT graph_id, tbl, node, 1 AS depth FROM writes
  UNION SELECT s.graph_id, s.tbl, p.from_node, s.depth + 1 FROM before s JOIN pass p ON p.graph_id = s.graph_id AND p.node = s.node
    WHERE s.depth < 60 AND NOT starts_with(s.node, 'table:') AND NOT starts_with(s.node, 'ext:') AND NOT EXISTS (SELECT 1 FROM closed c WHERE c.graph_id = s.graph_id AND c.node = s.node)
), made AS (
  SELECT graph_id, target AS node, output_col AS col, 'derive' AS op, CASE WHEN window_spec IS NOT NULL THEN coalesce(array_to_string(window_spec.partition_cols, ','), '') || '|' || coalesce(array_to_string(window_spec.order_cols, ','), '') || '|' || coalesce(window_spec.frame, '') ELSE '' END AS win FROM e WHERE kind = 'derives' AND output_col IS NOT NULL
  UNION SELECT graph_id, target, a.output, coalesce(a.op, ''), '' FROM e, unnest(aggs) AS u(a) WHERE kind = 'aggregates' AND a.output IS NOT NULL
  UNION SELECT graph_id, target, k, 'group_key', '' FROM e, unnest(group_keys) AS u(k) WHERE kind = 'aggregates' AND k IS NOT NULL
), near AS (SELECT b.graph_id, b.tbl, m.col, m.op, m.win, row_number() OVER (PARTITION BY b.graph_id, b.tbl, m.col ORDER BY b.depth, m.op, m.win) AS n FROM before b JOIN made m ON m.graph_id = b.graph_id AND m.node = b.node)
SELECT graph_id, tbl AS "table", col AS "column", op, nullif(win, '') AS "window" FROM near WHERE n = 1""")
def provenance_operations(spark, d):
    """What computes each column of a written table nearest to it, and over which window."""
    return L.operations(edges(spark, d))


@query(_STEPS + """SELECT graph_id, tbl AS "table", array_to_string(list_sort(list(DISTINCT column_name)), ',') AS columns FROM prov GROUP BY ALL""")
def columns_by_table(spark, d):
    """The columns of every written table that are known where they come from."""
    return L.columns_by_table(L.provenance(edges(spark, d))).withColumn("columns", F.array_join("columns", ","))


@query(EDGES + """, c AS (SELECT graph_id, edge_id, target, output_col, r.cond AS cond FROM e, unnest(rule_logic) AS u(r) WHERE r IS NOT NULL AND r.cond IS NOT NULL),
s AS (SELECT graph_id, edge_id, target, f.field AS output_col, r.cond AS cond FROM e, unnest(struct_fields) AS u(f), unnest(f.rule_logic) AS v(r) WHERE f IS NOT NULL AND r IS NOT NULL AND r.cond IS NOT NULL),
x AS (SELECT * FROM c UNION ALL SELECT * FROM s WHERE cond <> 'otherwise'), p AS (SELECT graph_id, cond, count(*) AS uses, count(DISTINCT edge_id) AS n_edges, count(DISTINCT target) AS targets FROM x WHERE cond <> 'otherwise' GROUP BY ALL)
SELECT graph_id, 'P' || substr(md5(cond), 1, 10) AS predicate_id, cond, uses, n_edges, targets FROM p""")
def predicate_use(spark, d):
    """The predicates of rules, each once in a graph under an id that its text gives, with how often and by how many edges and nodes it is used."""
    return L.predicate_use(edges(spark, d))


_FLOW = "WITH RECURSIVE s AS (SELECT event_type AS src, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS dst FROM events), l AS (SELECT DISTINCT src, dst FROM s WHERE dst IS NOT NULL)"


@query(_FLOW + ", up AS (SELECT src, dst FROM l UNION SELECT up.src, l.dst FROM up JOIN l ON l.src = up.dst) SELECT src AS seed, dst AS node FROM up")
def closure_event_flow(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    links = table(spark, d, "events").select(F.col("event_type").alias("src"), F.lead("event_type").over(w).alias("dst")).filter("dst is not null").distinct()
    return closure(links, links.select(F.col("src").alias("seed"), F.col("src").alias("node"))).select("seed", "node")


_DAG = """WITH RECURSIVE l AS (
  SELECT DISTINCT 's' || l_suppkey AS src, 'p' || l_partkey AS dst FROM lineitem UNION SELECT 'p' || l_partkey, 'o' || l_orderkey FROM lineitem UNION SELECT 'o' || o_orderkey, 'c' || o_custkey FROM orders
)"""


def _dag(spark, d):
    li, o = table(spark, d, "lineitem"), table(spark, d, "orders")
    key = lambda letter, c: F.concat(F.lit(letter), F.col(c).cast("string"))
    parts = [li.select(key("s", "l_suppkey").alias("src"), key("p", "l_partkey").alias("dst")), li.select(key("p", "l_partkey").alias("src"), key("o", "l_orderkey").alias("dst")), o.select(key("o", "o_orderkey").alias("src"), key("c", "o_custkey").alias("dst"))]
    return parts[0].union(parts[1]).union(parts[2])  # the closure counts repeated links once


@query(_DAG + ", up AS (SELECT 's1' AS node, 0 AS depth UNION SELECT l.dst, up.depth + 1 FROM up JOIN l ON l.src = up.node) SELECT node, CAST(min(depth) AS INT) AS depth FROM up WHERE depth > 0 GROUP BY node")
def blast_radius_supplier(spark, d):
    return closure(_dag(spark, d), spark.createDataFrame([("s1", "s1")], "seed string, node string")).select("node", "depth")


@query(_DAG + ", up AS (SELECT 'c1' AS node, 0 AS depth UNION SELECT l.src, up.depth + 1 FROM up JOIN l ON l.dst = up.node) SELECT node, CAST(min(depth) AS INT) AS depth FROM up WHERE depth > 0 GROUP BY node")
def upstream_customer(spark, d):
    return closure(_dag(spark, d), spark.createDataFrame([("c1", "c1")], "seed string, node string"), reverse=True).select("node", "depth")


_SEED_NODES = ["main.sales.orders.amount", "main.sales.orders_raw.amount", "main.hr.people.name", "other.sales.orders.total", "main.crm.people.name"]
_SEED_CASES = [("exact", "main.sales.orders", "amount"), ("suffix", "orders_raw", "amount"), ("substring", "order", "amount"), ("case", "MAIN.Sales.Orders", "amount"), ("ambiguous", "people", "name"), ("qualified", "hr.people", "name"), ("conflict", "dev.sales.orders", "amount"), ("bare", "", "total"), ("missing", "main.sales.orders", "nothing")]


@query("""SELECT * FROM (VALUES ('exact', 'main.sales.orders.amount', 'qualified'), ('suffix', 'main.sales.orders_raw.amount', 'qualified'), ('substring', 'main.sales.orders.amount', 'unqualified_heuristic'), ('substring', 'main.sales.orders_raw.amount', 'unqualified_heuristic'),
  ('case', 'main.sales.orders.amount', 'qualified'), ('ambiguous', 'main.hr.people.name', 'ambiguous'), ('ambiguous', 'main.crm.people.name', 'ambiguous'), ('qualified', 'main.hr.people.name', 'qualified'),
  ('conflict', 'main.sales.orders.amount', 'unqualified_heuristic'), ('conflict', 'main.sales.orders_raw.amount', 'unqualified_heuristic'), ('bare', 'other.sales.orders.total', 'unqualified_heuristic'), ('missing', NULL, 'unresolved')) AS t("case", node, status)""")
def seed_resolution_cases(spark, d):
    nodes = spark.createDataFrame([(n,) for n in _SEED_NODES], "node string")
    return L.resolve_seeds(nodes, spark.createDataFrame(_SEED_CASES, "`case` string, `table` string, `column` string"))


# ---- snapshots of one repository against each other ----------------------------------------------

_SNAPSHOTS = EDGES + """
, g AS (SELECT repo, graph_id, max(extracted_ts) AS seen_at FROM e GROUP BY ALL), o AS (SELECT repo, graph_id, row_number() OVER (PARTITION BY repo ORDER BY seen_at DESC, graph_id DESC) AS n FROM g),
k AS (SELECT DISTINCT e.repo, o.n, kind, regexp_replace(coalesce(target, ''), '^(df:[^:]*):[^:]*:', '\\1:') AS node FROM e JOIN o ON o.graph_id = e.graph_id AND o.repo = e.repo WHERE o.n <= 2)
"""


def _snapshots(spark, d):
    e = edges(spark, d)
    at = e.groupBy("repo", "graph_id").agg(F.max("extracted_ts").alias("at"))
    ranked = at.withColumn("n", F.row_number().over(Window.partitionBy("repo").orderBy(F.desc("at"), F.desc("graph_id")))).filter("n <= 2").drop("at")
    node = F.regexp_replace(F.coalesce("target", F.lit("")), r"^(df:[^:]*):[^:]*:", "$1:")
    held = e.join(ranked, ["repo", "graph_id"]).withColumn("node", node)
    return held.filter("n = 2"), held.filter("n = 1")


@query(_SNAPSHOTS + """, a AS (SELECT repo, kind, node FROM k WHERE n = 2), b AS (SELECT repo, kind, node FROM k WHERE n = 1)
SELECT repo, kind, node, CASE WHEN a_node IS NULL THEN 'added' WHEN b_node IS NULL THEN 'removed' ELSE 'same' END AS change FROM (SELECT coalesce(a.repo, b.repo) AS repo, coalesce(a.kind, b.kind) AS kind, coalesce(a.node, b.node) AS node, a.node AS a_node, b.node AS b_node
  FROM a FULL JOIN b ON a.repo = b.repo AND a.kind = b.kind AND a.node = b.node)""")
def graph_diff(spark, d):
    old, new = _snapshots(spark, d)
    return L.compare(old, new, ["repo", "kind", "node"])


@query(_SNAPSHOTS + """, a AS (SELECT DISTINCT repo, kind, node FROM k WHERE n = 2), b AS (SELECT DISTINCT repo, kind, node FROM k WHERE n = 1)
SELECT coalesce(a.repo, b.repo) AS repo, count(*) FILTER (a.node IS NOT NULL AND b.node IS NOT NULL) AS matched, count(*) FILTER (b.node IS NULL) AS missing, count(*) FILTER (a.node IS NULL) AS extra FROM a FULL JOIN b ON a.repo = b.repo AND a.kind = b.kind AND a.node = b.node GROUP BY ALL""")
def compare_edges(spark, d):
    old, new = _snapshots(spark, d)
    c = L.compare(old, new, ["repo", "kind", "node"])
    return c.groupBy("repo").agg(F.count_if(F.col("change") == "same").alias("matched"), F.count_if(F.col("change") == "removed").alias("missing"), F.count_if(F.col("change") == "added").alias("extra"))


@query(_SNAPSHOTS + """, a AS (SELECT DISTINCT repo, kind, node FROM k WHERE n = 2), b AS (SELECT DISTINCT repo, kind, node FROM k WHERE n = 1),
f AS (SELECT coalesce(a.kind, b.kind) AS kind, a.node IS NOT NULL AS t, b.node IS NOT NULL AS p FROM a FULL JOIN b ON a.repo = b.repo AND a.kind = b.kind AND a.node = b.node),
s AS (SELECT kind, count(*) FILTER (t AND p) AS tp, count(*) FILTER (NOT t AND p) AS fp, count(*) FILTER (t AND NOT p) AS fn FROM f GROUP BY ROLLUP (kind)),
r AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 1.0 END AS p, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 1.0 END AS r FROM s)
SELECT kind, tp, fp, fn, round(p, 6) AS precision, round(r, 6) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0.0 END, 6) AS f1 FROM r""")
def prf_by_kind(spark, d):
    """The last snapshot of each repository measured against the one before."""
    old, new = _snapshots(spark, d)
    key = F.concat_ws("|", "repo", "node").alias("key")
    return set_prf(old.select("kind", key), new.select("kind", key), "kind", "key")


@query()
def diff_breaking(spark, d):
    """Columns that the last snapshot of a repository no longer provides though others depended on them."""
    old, new = _snapshots(spark, d)
    was, now = L.forward_index(L.provenance(old.withColumn("graph_id", F.col("repo")))), L.forward_index(L.provenance(new.withColumn("graph_id", F.col("repo"))))
    nodes = lambda f: f.select("graph_id", F.explode(F.array("src", "dst")).alias("node")).distinct()
    gone = nodes(was).join(nodes(now), ["graph_id", "node"], "left_anti")
    return L.breaking(gone, was)


# ---- agreement, grades, seals --------------------------------------------------------------------

_JUDGED = "SELECT * FROM judge_records QUALIFY row_number() OVER (PARTITION BY record_id ORDER BY ingested_ts DESC NULLS LAST) = 1"


def _judged(spark, d):
    return latest_version(table(spark, d, "judge_records"), "record_id").withColumn("judge", F.lower(F.trim("judge")))


@query(f"""WITH j AS ({_JUDGED}), c AS (SELECT lower(trim(judge)) AS judge, count(*) FILTER (author = 0 AND judge_label = 0) AS n00, count(*) FILTER (author = 0 AND judge_label = 1) AS n01, count(*) FILTER (author = 1 AND judge_label = 0) AS n10, count(*) FILTER (author = 1 AND judge_label = 1) AS n11
  FROM j WHERE author IN (0, 1) AND judge_label IN (0, 1) GROUP BY ALL), r AS (SELECT *, (n00 + n11) / (n00 + n01 + n10 + n11) AS po, ((n00 + n01) * (n00 + n10) + (n10 + n11) * (n01 + n11)) / CAST((n00 + n01 + n10 + n11) * (n00 + n01 + n10 + n11) AS DOUBLE) AS pe FROM c)
SELECT judge, n00, n01, n10, n11, round(po, 6) AS observed, round(CASE WHEN pe < 1 THEN (po - pe) / (1 - pe) ELSE 1.0 END, 6) AS kappa FROM r""")
def kappa_judges(spark, d):
    return kappa(_judged(spark, d), ["judge"], "author", "judge_label")


@query(f"""WITH j AS ({_JUDGED}) SELECT record_id, author, corrected_author, CAST(corrected_author <> author AS BOOLEAN) AS changed FROM j WHERE corrected_author IS NOT NULL AND author IS NOT NULL""")
def relabel(spark, d):
    return _judged(spark, d).filter("corrected_author is not null and author is not null").select("record_id", "author", "corrected_author", (F.col("corrected_author") != F.col("author")).alias("changed"))


@query(f"""WITH j AS ({_JUDGED}), s AS (SELECT lower(trim(bench)) AS bench, count(*) FILTER (author = 1 AND judge_label = 1) AS tp, count(*) FILTER (author = 0 AND judge_label = 1) AS fp, count(*) FILTER (author = 1 AND judge_label = 0) AS fn FROM j WHERE author IN (0, 1) AND judge_label IN (0, 1) GROUP BY ROLLUP (lower(trim(bench)))),
r AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 1.0 END AS p, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 1.0 END AS r FROM s)
SELECT bench, tp, fp, fn, round(p, 6) AS precision, round(r, 6) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0.0 END, 6) AS f1 FROM r""")
def judged_impact(spark, d):
    """Judges' impact labels measured against the author's, by bench and pooled."""
    held = _judged(spark, d).withColumn("bench", F.lower(F.trim("bench"))).filter("author in (0, 1) and judge_label in (0, 1)")
    return prf(held, ["bench"], F.col("author") == 1, F.col("judge_label") == 1)


@query(f"""WITH j AS ({_JUDGED}), n AS (SELECT record_id, bench, change_col, candidate, judge_label, row_number() OVER (PARTITION BY bench, change_col, judge_label ORDER BY md5('7:' || record_id), record_id) AS n FROM j WHERE judge_label IN (0, 1))
SELECT record_id, bench, change_col, candidate, judge_label FROM n WHERE judge_label = 1 OR n <= 8""")
def sampled_candidates(spark, d):
    held = _judged(spark, d).filter("judge_label in (0, 1)")
    return sample_candidates(held, ["bench", "change_col"], "judge_label", "record_id").select("record_id", "bench", "change_col", "candidate", "judge_label")


_QA = "SELECT * FROM qa_results QUALIFY row_number() OVER (PARTITION BY result_id ORDER BY ingested_ts DESC NULLS LAST) = 1"


def _qa(spark, d):
    return latest_version(table(spark, d, "qa_results").select("result_id", "run_id", "model", "category", "difficulty", "context_mode", "context_tokens", "prompt_tokens", "score", "ingested_ts"), "result_id")


@query(f"""WITH q AS ({_QA}) SELECT lower(difficulty) AS difficulty, count(*) AS n, CAST(sum(score) AS BIGINT) AS earned, 2 * count(*) AS possible, round(sum(score) / (2.0 * count(*)), 6) AS accuracy, count(*) FILTER (score = 2) AS correct, count(*) FILTER (score = 1) AS partial, count(*) FILTER (score = 0) AS incorrect
FROM q WHERE score IS NOT NULL GROUP BY GROUPING SETS ((lower(difficulty)), ())""")
def qa_score(spark, d):
    held = _qa(spark, d).filter("score is not null").withColumn("difficulty", F.lower("difficulty"))
    s = F.col("score")
    return held.groupingSets([["difficulty"], []], "difficulty").agg(F.count("*").alias("n"), F.sum(s).alias("earned"), (2 * F.count("*")).alias("possible"), F.round(F.sum(s) / (2.0 * F.count("*")), 6).alias("accuracy"), F.count_if(s == 2).alias("correct"), F.count_if(s == 1).alias("partial"), F.count_if(s == 0).alias("incorrect"))


@query(f"""WITH q AS ({_QA}) SELECT model, context_mode, CAST(sum(score) AS BIGINT) AS earned, count(score) AS graded, round(100.0 * sum(score) / (2 * count(score)), 4) AS pct FROM q WHERE score IS NOT NULL GROUP BY ROLLUP (model, context_mode)""")
def grade_tables(spark, d):
    held = _qa(spark, d).filter("score is not null")
    return held.rollup("model", "context_mode").agg(F.sum("score").alias("earned"), F.count("score").alias("graded"), F.round(100.0 * F.sum("score") / (2 * F.count("score")), 4).alias("pct"))


@query(f"""WITH q AS ({_QA}), m AS (SELECT model, context_mode, 100.0 * sum(score) / (2 * count(score)) AS pct FROM q WHERE score IS NOT NULL AND model IS NOT NULL AND context_mode IS NOT NULL GROUP BY ALL),
w AS (SELECT *, max(pct) OVER (PARTITION BY model) AS best FROM m) SELECT model, context_mode, round(pct, 4) AS pct, round(pct - best, 4) AS delta, CAST(rank() OVER (PARTITION BY model ORDER BY round(pct, 4) DESC) AS INT) AS place FROM w""")
def grade_deltas(spark, d):
    """How far each context mode is from the best one of its model."""
    held = _qa(spark, d).filter("score is not null and model is not null and context_mode is not null")
    pct = held.groupBy("model", "context_mode").agg((100.0 * F.sum("score") / (2 * F.count("score"))).alias("pct"))
    w = Window.partitionBy("model")
    return pct.select("model", "context_mode", F.round("pct", 4).alias("pct"), F.round(F.col("pct") - F.max("pct").over(w), 4).alias("delta"), F.rank().over(w.orderBy(F.desc(F.round("pct", 4)))).alias("place"))


@query(f"""WITH q AS ({_QA}), m AS (SELECT model, lower(difficulty) AS difficulty, score FROM q WHERE score IS NOT NULL AND model IS NOT NULL)
SELECT model, CAST(sum(score) FILTER (difficulty = 'easy') AS BIGINT) AS easy, CAST(sum(score) FILTER (difficulty = 'medium') AS BIGINT) AS medium, CAST(sum(score) FILTER (difficulty = 'hard') AS BIGINT) AS hard FROM m GROUP BY ALL""")
def grade_pivot(spark, d):
    held = _qa(spark, d).filter("score is not null and model is not null").withColumn("difficulty", F.lower("difficulty"))
    return held.groupBy("model").pivot("difficulty", ["easy", "medium", "hard"]).agg(F.sum("score"))


@query(f"""WITH q AS ({_QA}) SELECT context_mode, CAST(sum(context_tokens) AS BIGINT) AS context, CAST(sum(prompt_tokens) AS BIGINT) AS prompt, count(*) AS n FROM q GROUP BY ALL""")
def token_usage(spark, d):
    return _qa(spark, d).groupBy("context_mode").agg(F.sum("context_tokens").alias("context"), F.sum("prompt_tokens").alias("prompt"), F.count("*").alias("n"))


@query("""WITH m AS (SELECT split_file, sealed, num_questions, sha256 FROM split_manifest WHERE split_file IS NOT NULL QUALIFY row_number() OVER (PARTITION BY split_file ORDER BY sealed_at DESC NULLS LAST) = 1),
seals AS (SELECT split_file, count(*) AS n_seals, count(DISTINCT sha256) AS n_digests FROM split_manifest WHERE split_file IS NOT NULL GROUP BY ALL),
q AS (SELECT question_key, split_file, sha256(coalesce(question, '')) AS h FROM questions QUALIFY row_number() OVER (PARTITION BY question_key ORDER BY ingested_ts DESC NULLS LAST) = 1),
a AS (SELECT split_file, count(*) AS n, CAST(sum(CAST('0x' || substr(h, 1, 12) AS BIGINT)) AS VARCHAR) || '-' || CAST(sum(CAST('0x' || substr(h, 13, 12) AS BIGINT)) AS VARCHAR) AS digest FROM q WHERE split_file IS NOT NULL GROUP BY ALL)
SELECT m.split_file, m.sealed, m.num_questions, m.sha256, n_seals, n_digests > 1 AS resealed_differently, coalesce(a.n, 0) AS actual, a.digest, CASE WHEN a.n IS NULL THEN 'missing' WHEN m.num_questions IS NULL THEN 'undeclared' WHEN a.n = m.num_questions THEN 'ok' ELSE 'changed' END AS state
FROM m JOIN seals USING (split_file) LEFT JOIN a USING (split_file)""")
def seal_verify(spark, d):
    """Each split as it was sealed last (with whether an earlier seal had another sha256) against its questions now: their number, and a digest of their hashes' sums that needs no order."""
    manifest = table(spark, d, "split_manifest").select("split_file", "sealed", "num_questions", "sha256", "sealed_at").filter("split_file is not null")
    m = latest_version(manifest, "split_file", "sealed_at").drop("sealed_at")
    seals = manifest.groupBy("split_file").agg(F.count("*").alias("n_seals"), (F.countDistinct("sha256") > 1).alias("resealed_differently"))
    q = latest_version(table(spark, d, "questions").select("question_key", "split_file", "question", "ingested_ts"), "question_key").filter("split_file is not null")
    h = F.sha2(F.coalesce("question", F.lit("")), 256)
    part = lambda at: F.sum(F.conv(F.substring("h", at, 12), 16, 10).cast("decimal(38,0)")).cast("string")
    a = q.select("split_file", h.alias("h")).groupBy("split_file").agg(F.count("*").alias("n"), F.concat_ws("-", part(1), part(13)).alias("digest"))
    state = F.when(F.col("n").isNull(), "missing").when(F.col("num_questions").isNull(), "undeclared").when(F.col("n") == F.col("num_questions"), "ok").otherwise("changed")
    whole = m.join(seals, "split_file").join(a, "split_file", "left")
    return whole.select("split_file", "sealed", "num_questions", "sha256", "n_seals", "resealed_differently", F.coalesce("n", F.lit(0)).alias("actual"), "digest", state.alias("state"))


# ---- sources, chunks, retrieval, lines -----------------------------------------------------------


@query(r"""SELECT file_id, rel_path FROM source_files WHERE (regexp_matches(rel_path, '^(?:[^/]+/)*bronze/[^/]*\.py$') OR regexp_matches(rel_path, '^(?:[^/]+/)*silver/[^/]*\.sql$')) AND NOT regexp_matches(rel_path, '^(?:[^/]+/)*[^/]*_daily\.[^/]*$')""")
def scope_filter(spark, d):
    scope = Scope(include=["**/bronze/*.py", "**/silver/*.sql"], exclude=["**/*_daily.*"])
    return table(spark, d, "source_files").filter(scope.matches("rel_path")).select("file_id", "rel_path")


@query(r"""SELECT file_id, CAST(CASE WHEN regexp_matches(lower(rel_path), '(?:^|/)(?:config|conf)/') OR regexp_matches(lower(rel_path), '(?:^|/)(?:config|settings|constants)\.py$') THEN 0 WHEN regexp_matches(lower(rel_path), '(?:^|/)_resources/') THEN 1 WHEN regexp_matches(lower(rel_path), '(?:^|/)ddl/') OR lower(rel_path) LIKE '%.sql' THEN 2
  WHEN regexp_matches(lower(rel_path), '(?:^|/)bronze/') THEN 3 WHEN regexp_matches(lower(rel_path), '(?:^|/)silver/') THEN 4 WHEN regexp_matches(lower(rel_path), '(?:^|/)gold/') THEN 5 ELSE 9 END AS INT) AS run_order FROM source_files""")
def run_order_tiers(spark, d):
    return table(spark, d, "source_files").select("file_id", run_order("rel_path").alias("run_order"))


@query(r"""WITH p AS (SELECT doc_id, CAST(i - 1 AS INT) AS chunk, regexp_split_to_array(text, '\n\s*\n')[i] AS paragraph FROM documents, unnest(range(1, len(regexp_split_to_array(text, '\n\s*\n')) + 1)) AS u(i) WHERE text IS NOT NULL),
l AS (SELECT doc_id, chunk, CAST(i - 1 AS INT) AS line, string_split(paragraph, chr(10))[i] AS body FROM p, unnest(range(1, len(string_split(paragraph, chr(10))) + 1)) AS u(i) WHERE length(trim(paragraph)) > 0),
w AS (SELECT doc_id, chunk, line, body, CAST(floor(coalesce(sum(ceil(length(body) / 4)) OVER (PARTITION BY doc_id, chunk ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / 220) AS INT) AS part FROM l)
SELECT doc_id, chunk, part, md5(string_agg(body, chr(10) ORDER BY line)) AS body_md5, CAST(ceil(length(string_agg(body, chr(10) ORDER BY line)) / 4) AS BIGINT) AS tokens FROM w GROUP BY ALL""")
def chunk_documents(spark, d):
    return chunks(table(spark, d, "documents"), "doc_id", "text").select("doc_id", "chunk", "part", F.md5("body").alias("body_md5"), "tokens")


@query(r"""WITH f AS (SELECT file_id, rel_path, replace(replace(content, chr(13) || chr(10), chr(10)), chr(13), chr(10)) AS body FROM source_files WHERE lower(rel_path) LIKE '%.py' AND content IS NOT NULL AND file_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY file_id ORDER BY ingested_ts DESC NULLS LAST) = 1),
l AS (SELECT file_id, CAST(i AS INT) AS line, string_split(body, chr(10))[i] AS text FROM f, unnest(range(1, len(string_split(body, chr(10))) + 1)) AS u(i)),
m AS (SELECT *, CASE WHEN regexp_matches(text, '^# COMMAND -+[ \t]*$') THEN 2 WHEN regexp_matches(text, '^(?:async[ ]+def|def|class)[ ]') THEN 1 ELSE 0 END AS mark FROM l),
c AS (SELECT *, sum(CASE WHEN mark > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY file_id ORDER BY line) AS chunk FROM m)
SELECT file_id, CAST(chunk AS BIGINT) AS chunk, min(line) AS first_line, max(line) AS last_line, md5(string_agg(text, chr(10) ORDER BY line)) AS body_md5, CASE max(mark) WHEN 2 THEN 'cell' WHEN 1 THEN 'definition' ELSE 'head' END AS kind FROM c GROUP BY ALL""")
def chunk_code(spark, d):
    """Python sources by notebook cell and top-level definition."""
    files = latest_version(table(spark, d, "source_files").select("file_id", "rel_path", "content", "ingested_ts").filter("content is not null and lower(rel_path) like '%.py'"), "file_id").filter("file_id is not null")
    return code_chunks(files, "file_id", "content")


_ASKED = [(1, "which tables does the join key reach"), (2, "rename of a column in the silver layer"), (3, "rows arrived late after the incremental run"), (4, "ask the reviewer why the window picks the latest")]
_BM25 = r"""WITH t AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z_][a-z0-9_]*')) AS term FROM documents), tf AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY ALL),
ln AS (SELECT doc_id, CAST(len(regexp_extract_all(lower(coalesce(text, '')), '[a-z_][a-z0-9_]*')) AS DOUBLE) AS n FROM documents), st AS (SELECT count(*) AS cnt, avg(n) AS av FROM ln),
q AS (SELECT DISTINCT query_id, unnest(regexp_extract_all(lower(query), '[a-z_][a-z0-9_]*')) AS term FROM (VALUES (1, 'which tables does the join key reach'), (2, 'rename of a column in the silver layer'), (3, 'rows arrived late after the incremental run'), (4, 'ask the reviewer why the window picks the latest')) AS v(query_id, query)),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
s AS (SELECT query_id, tf.doc_id, sum(ln(1 + (st.cnt - df.df + 0.5) / (df.df + 0.5)) * tf.tf * 2.5 / (tf.tf + 1.5 * (0.25 + 0.75 * ln.n / st.av))) AS score FROM q JOIN tf USING (term) JOIN df USING (term) JOIN ln ON ln.doc_id = tf.doc_id CROSS JOIN st GROUP BY ALL),
r AS (SELECT query_id, doc_id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, doc_id) AS rank FROM s)
"""


def _ranked(spark, d):
    asked = spark.createDataFrame(_ASKED, "query_id int, query string")
    return bm25(table(spark, d, "documents").select("doc_id", "text"), asked).withColumn("score", F.round("score", 6))


@query(_BM25 + "SELECT query_id, doc_id, score, CAST(rank AS INT) AS rank FROM r WHERE rank <= 20")
def bm25_topk(spark, d):
    return top_ranked(_ranked(spark, d), "query_id", "doc_id", 20)


@query(_BM25 + """, k AS (SELECT query_id, r.doc_id, r.score, CAST(ceil(length(text) / 4) AS BIGINT) AS tokens FROM r JOIN documents USING (doc_id)), u AS (SELECT *, sum(tokens) OVER (PARTITION BY query_id ORDER BY score DESC, doc_id ROWS UNBOUNDED PRECEDING) AS running, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS n FROM k)
SELECT query_id, doc_id, tokens, CAST(running AS BIGINT) AS running FROM u WHERE running <= 3000 OR n = 1""")
def retrieval_budget(spark, d):
    sized = _ranked(spark, d).join(table(spark, d, "documents").select("doc_id", F.ceil(F.length("text") / 4).cast("bigint").alias("tokens")), "doc_id")
    return budget_pack(sized, "query_id", [F.desc("score"), F.col("doc_id")], "tokens", 3000).select("query_id", "doc_id", "tokens", "running")


@query("SELECT lower(trim(lang)) AS lang, count(*) AS n, CAST(sum(ceil(length(text) / 4)) AS BIGINT) AS tokens FROM documents GROUP BY ALL")
def token_totals(spark, d):
    return table(spark, d, "documents").groupBy(F.lower(F.trim("lang")).alias("lang")).agg(F.count("*").alias("n"), F.sum(F.ceil(F.length("text") / 4)).cast("bigint").alias("tokens"))


@query("""WITH f AS (SELECT event_type, min(event_id) AS first_id FROM events GROUP BY ALL) SELECT event_type, 'T' || CAST(dense_rank() OVER (ORDER BY first_id) AS VARCHAR) AS symbol FROM f""")
def dense_symbol_ids(spark, d):
    first = table(spark, d, "events").groupBy("event_type").agg(F.min("event_id").alias("first_id"))
    # one row an event type: a handful
    return first.select("event_type", F.concat(F.lit("T"), F.dense_rank().over(Window.orderBy("first_id")).cast("string")).alias("symbol"))


@query(EDGES + """SELECT edge_id, concat_ws('|', upper(substr(kind, 1, 1)), coalesce(source, ''), coalesce(right_source, ''), coalesce(target, ''), coalesce(output_col, ''), coalesce(array_to_string(source_cols, ','), ''), coalesce(array_to_string(group_keys, ','), '')) AS line FROM e""")
def compact_lines(spark, d):
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    listed = lambda c: F.coalesce(F.array_join(c, ","), F.lit(""))
    return edges(spark, d).select("edge_id", F.concat_ws("|", F.upper(F.substring("kind", 1, 1)), text("source"), text("right_source"), text("target"), text("output_col"), listed("source_cols"), listed("group_keys")).alias("line"))


QUERIES, SQL = query.queries, query.sql
