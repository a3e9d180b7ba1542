"""Problem 1: the trees and cycles of the lineage graphs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.hierarchy import cycles, descendants, hierarchy
from ..operators.versions import latest_version
from .tables import table


def node_id(column: str) -> Column:
    """An id in its compared form; null where it names no node."""
    trimmed = F.regexp_replace(F.regexp_replace(column, r"^[\s\p{Z}]+|[\s\p{Z}]+$", ""), r"\\", "/")
    form = F.when(trimmed.startswith("table:"), F.lower(trimmed)).otherwise(trimmed)
    return F.when(~form.startswith("<unresolved>"), form)


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = table(spark, sf_dir, "edges").select("edge_id", "graph_id", "source", "target", "ingested_ts")
    held = latest_version(edges, "edge_id")
    return held.select("graph_id", node_id("source").alias("source"), node_id("target").alias("target"))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hierarchy(links(spark, sf_dir), details=False).select("graph_id", "node_id", "root_id")


def p1_hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hierarchy(links(spark, sf_dir))


def p1_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return descendants(links(spark, sf_dir))


def p1_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cycles(hierarchy(links(spark, sf_dir), details=False))


_UP = r"""
WITH RECURSIVE held AS (
  SELECT graph_id, source, target FROM edges
  QUALIFY row_number() OVER (PARTITION BY edge_id ORDER BY ingested_ts DESC NULLS LAST) = 1
), trimmed AS (
  SELECT graph_id,
    replace(regexp_replace(source, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g'), '\', '/') AS s,
    replace(regexp_replace(target, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g'), '\', '/') AS t
  FROM held
), formed AS (
  SELECT graph_id,
    CASE WHEN starts_with(s, '<unresolved>') THEN NULL WHEN starts_with(s, 'table:') THEN lower(s) ELSE s END AS s,
    CASE WHEN starts_with(t, '<unresolved>') THEN NULL WHEN starts_with(t, 'table:') THEN lower(t) ELSE t END AS t
  FROM trimmed
), nodes AS (
  SELECT DISTINCT graph_id, n AS node FROM (SELECT graph_id, s AS n FROM formed UNION ALL SELECT graph_id, t FROM formed) WHERE n IS NOT NULL
), par AS (
  SELECT graph_id, t AS node, min(s) AS parent FROM formed WHERE s IS NOT NULL AND t IS NOT NULL GROUP BY ALL
), up AS (
  SELECT graph_id, node, parent AS anc FROM par
  UNION
  SELECT up.graph_id, up.node, par.parent FROM up JOIN par ON par.graph_id = up.graph_id AND par.node = up.anc
), ring AS (
  SELECT graph_id, node FROM up WHERE node = anc
)
"""

_DOWN = _UP + """
, ring_root AS (SELECT r.graph_id, r.node, min(up.anc) AS root FROM ring r JOIN up ON up.graph_id = r.graph_id AND up.node = r.node GROUP BY ALL),
rp AS (
  SELECT graph_id, node, root, node AS path, 0 AS pos FROM ring_root WHERE node = root
  UNION ALL SELECT rp.graph_id, p.node, rp.root, rp.path || ' > ' || p.node, rp.pos + 1
  FROM rp JOIN par p ON p.graph_id = rp.graph_id AND p.parent = rp.node JOIN ring k ON k.graph_id = p.graph_id AND k.node = p.node WHERE p.node <> rp.root
), ring_length AS (SELECT graph_id, root, count(*) AS len FROM rp GROUP BY ALL),
start_at AS (
  SELECT n.graph_id, n.node, CAST(NULL AS VARCHAR) AS parent, n.node AS root, false AS on_cycle, n.node AS path, n.node AS entry FROM nodes n LEFT JOIN par ON par.graph_id = n.graph_id AND par.node = n.node WHERE par.parent IS NULL
  UNION ALL SELECT rp.graph_id, rp.node, par.parent, rp.root, true, rp.path, rp.node FROM rp JOIN par ON par.graph_id = rp.graph_id AND par.node = rp.node
), down AS (
  SELECT graph_id, node, parent, root, 0 AS depth, on_cycle, false AS below_cycle, path, entry FROM start_at
  UNION ALL SELECT d.graph_id, p.node, p.parent, d.root, d.depth + 1, false, d.on_cycle OR d.below_cycle, d.path || ' > ' || p.node, d.entry
  FROM down d JOIN par p ON p.graph_id = d.graph_id AND p.parent = d.node WHERE NOT EXISTS (SELECT 1 FROM ring k WHERE k.graph_id = p.graph_id AND k.node = p.node)
)
"""

SQL = {
    "p1_hierarchy": _DOWN + """
, below AS (SELECT graph_id, anc, count(*) AS n FROM up WHERE node <> anc GROUP BY ALL)
SELECT d.graph_id, d.node AS node_id, d.parent AS parent_id, d.root AS root_id, CAST(d.depth AS INT) AS depth, d.on_cycle, d.below_cycle, CAST(coalesce(b.n, 0) AS BIGINT) AS n_descendants, d.path
FROM down d LEFT JOIN below b ON b.graph_id = d.graph_id AND b.anc = d.node
""",
    "p1_descendants": _DOWN + """
SELECT u.graph_id, u.anc AS ancestor_id, u.node AS descendant_id, CAST(CASE WHEN a.on_cycle THEN d.depth + (e.pos - r.pos + l.len) % l.len ELSE d.depth - a.depth END AS INT) AS distance
FROM up u JOIN down d ON d.graph_id = u.graph_id AND d.node = u.node JOIN down a ON a.graph_id = u.graph_id AND a.node = u.anc
LEFT JOIN rp r ON r.graph_id = u.graph_id AND r.node = u.anc LEFT JOIN rp e ON e.graph_id = u.graph_id AND e.node = d.entry LEFT JOIN ring_length l ON l.graph_id = u.graph_id AND l.root = r.root
WHERE u.node <> u.anc
""",
    "p1_found": _UP + """
, top AS (
  SELECT up.graph_id, up.node,
    min(up.anc) FILTER (ring.node IS NOT NULL) AS ring_root,
    min(up.anc) FILTER (par.node IS NULL) AS tree_root
  FROM up LEFT JOIN ring ON ring.graph_id = up.graph_id AND ring.node = up.anc
  LEFT JOIN par ON par.graph_id = up.graph_id AND par.node = up.anc
  GROUP BY up.graph_id, up.node
)
SELECT n.graph_id, n.node AS node_id, coalesce(top.ring_root, top.tree_root, n.node) AS root_id
FROM nodes n LEFT JOIN top ON top.graph_id = n.graph_id AND top.node = n.node
""",
    "p1_cycles": _UP + """
, on_ring AS (
  SELECT up.graph_id, up.node, min(up.anc) AS cycle_id, bool_or(up.node = up.anc) AS is_on
  FROM up JOIN ring ON ring.graph_id = up.graph_id AND ring.node = up.anc GROUP BY ALL
)
SELECT graph_id, cycle_id, CAST(count(*) FILTER (is_on) AS BIGINT) AS length, CAST(count(*) FILTER (NOT is_on) AS BIGINT) AS n_below
FROM on_ring GROUP BY ALL
""",
}

QUERIES = {"p1_found": p1_found, "p1_hierarchy": p1_hierarchy, "p1_descendants": p1_descendants, "p1_cycles": p1_cycles}
