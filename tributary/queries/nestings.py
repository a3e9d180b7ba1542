"""Problem 5: the nested objects of edges as flat tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.nested import Shape, flatten_objects, list_items
from ..operators.versions import latest_version
from .tables import table


def edge_shapes() -> list[Shape]:
    rules = Shape("rule_logic", texts=("cond", "value"))
    fields = Shape("struct_fields", texts=("field", "kind", "value"), lists=("source_cols",), below=[rules])
    fields.below.append(fields)
    window = Shape("window_spec", many=False, texts=("frame",), lists=("partition_cols", "order_cols"))
    return [window, rules, fields]


def objects(spark: SparkSession, sf_dir: str, with_attributes: bool = True) -> DataFrame:
    edges = table(spark, sf_dir, "edges").select("edge_id", "window_spec", "rule_logic", "struct_fields", "raw_detail", "ingested_ts")
    found = flatten_objects(latest_version(edges, "edge_id"), "edge_id", edge_shapes(), "raw_detail", with_attributes)
    return found.withColumnRenamed("key", "edge_id")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return objects(spark, sf_dir, with_attributes=False).select("edge_id", "object_path")


def p5_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All objects with their texts; of their lists, which are the rows of ``p5_list_items``, the number of elements."""
    whole = objects(spark, sf_dir)
    lists = ["partition_cols", "order_cols", "source_cols"]
    return whole.select(*(c for c in whole.columns if c not in lists), *(F.when(F.col(c).isNotNull(), F.size(c)).cast("bigint").alias(f"n_{c}") for c in lists))


def p5_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return objects(spark, sf_dir).filter("object_kind = 'window_spec'").select("edge_id", "object_path", "frame")


def p5_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return objects(spark, sf_dir).filter("object_kind = 'rule_logic'").select("edge_id", "object_path", "parent_path", "position", "cond", "value")


def p5_struct_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return objects(spark, sf_dir).filter("object_kind = 'struct_fields'").select("edge_id", "object_path", "parent_path", "position", "depth", "field", "kind", "value")


def p5_list_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole = objects(spark, sf_dir).withColumnRenamed("edge_id", "key")
    return list_items(whole, ["partition_cols", "order_cols", "source_cols"]).withColumnRenamed("key", "edge_id")


_OBJECTS = """
WITH RECURSIVE held AS (
  SELECT * FROM edges QUALIFY row_number() OVER (PARTITION BY edge_id ORDER BY ingested_ts DESC NULLS LAST) = 1
), docs AS (
  SELECT edge_id, CASE WHEN window_spec IS NULL AND rule_logic IS NULL AND struct_fields IS NULL THEN CAST(raw_detail AS JSON)
    ELSE to_json({'window_spec': window_spec, 'rule_logic': rule_logic, 'struct_fields': struct_fields}) END AS j
  FROM held
), parts AS (
  SELECT edge_id, CAST(NULL AS VARCHAR) AS parent_path, 0 AS depth, n AS kind, json_extract(j, '$.' || n) AS j
  FROM docs, (VALUES ('rule_logic'), ('struct_fields')) AS t(n)
), top_level AS (
  SELECT edge_id, parent_path, depth, kind, CAST(p AS INT) AS position, CASE WHEN json_type(j) = 'OBJECT' THEN j ELSE json_extract(j, '$[' || p || ']') END AS j
  FROM parts, unnest(range(CAST(CASE json_type(j) WHEN 'OBJECT' THEN 1 WHEN 'ARRAY' THEN json_array_length(j) ELSE 0 END AS BIGINT))) AS u(p)
), obj AS (
  SELECT edge_id, parent_path, kind || '[' || position || ']' AS object_path, depth, kind, position, j FROM top_level WHERE json_type(j) = 'OBJECT'
  UNION ALL
  SELECT edge_id, parent_path, object_path, depth, kind, CAST(p AS INT) AS position, j FROM (
    SELECT o.edge_id, o.object_path AS parent_path, o.object_path || '.' || n || '[' || p || ']' AS object_path, o.depth + 1 AS depth, n AS kind, p,
      CASE WHEN json_type(json_extract(o.j, '$.' || n)) = 'OBJECT' THEN json_extract(o.j, '$.' || n) ELSE json_extract(o.j, '$.' || n || '[' || p || ']') END AS j
    FROM obj o, (VALUES ('rule_logic'), ('struct_fields')) AS t(n),
      unnest(range(CAST(CASE json_type(json_extract(o.j, '$.' || n)) WHEN 'OBJECT' THEN 1 WHEN 'ARRAY' THEN json_array_length(json_extract(o.j, '$.' || n)) ELSE 0 END AS BIGINT))) AS u(p)
    WHERE o.kind = 'struct_fields'
  ) WHERE json_type(j) = 'OBJECT'
), win AS (
  SELECT edge_id, 'window_spec' AS object_path, json_extract(j, '$.window_spec') AS j FROM docs WHERE json_type(json_extract(j, '$.window_spec')) = 'OBJECT'
)
"""

_WHOLE = _OBJECTS + """
, whole AS (
  SELECT edge_id, object_path, parent_path, kind AS object_kind, position, depth, j FROM obj
  UNION ALL SELECT edge_id, object_path, NULL, 'window_spec', 0, 0, j FROM win
), lists AS (SELECT edge_id, object_path, object_kind, n AS list_name, json_extract(j, '$.' || n) AS l FROM whole, (VALUES ('partition_cols'), ('order_cols'), ('source_cols')) AS t(n)
  WHERE (n = 'source_cols') = (object_kind = 'struct_fields') AND object_kind <> 'rule_logic')
"""


def _text(name: str, *kinds: str) -> str:
    return f"CASE WHEN object_kind IN ({', '.join(repr(k) for k in kinds)}) THEN json_extract_string(j, '$.{name}') END AS \"{name}\""


def _length(name: str, kind: str) -> str:
    value = f"json_extract(j, '$.{name}')"
    return f"CASE WHEN object_kind = '{kind}' THEN CASE json_type({value}) WHEN 'ARRAY' THEN CAST(json_array_length({value}) AS BIGINT) WHEN 'NULL' THEN NULL ELSE CASE WHEN {value} IS NOT NULL THEN 1 END END END AS n_{name}"


SQL = {
    "p5_objects": _WHOLE + f"""SELECT edge_id, object_path, parent_path, object_kind, position, depth, {_text("frame", "window_spec")}, {_text("cond", "rule_logic")}, {_text("value", "rule_logic", "struct_fields")},
  {_text("field", "struct_fields")}, {_text("kind", "struct_fields")}, {_length("partition_cols", "window_spec")}, {_length("order_cols", "window_spec")}, {_length("source_cols", "struct_fields")} FROM whole""",
    "p5_list_items": _WHOLE + """
SELECT edge_id, object_path, list_name, CAST(p AS INT) AS position, CASE WHEN json_type(l) = 'ARRAY' THEN json_extract_string(l, '$[' || p || ']') ELSE json_extract_string(l, '$') END AS item
FROM lists, unnest(range(CAST(CASE json_type(l) WHEN 'ARRAY' THEN json_array_length(l) WHEN 'NULL' THEN 0 ELSE 1 END AS BIGINT))) AS u(p)
WHERE l IS NOT NULL AND CASE WHEN json_type(l) = 'ARRAY' THEN json_extract_string(l, '$[' || p || ']') ELSE json_extract_string(l, '$') END IS NOT NULL""",
    "p5_found": _OBJECTS + "SELECT edge_id, object_path FROM obj UNION ALL SELECT edge_id, object_path FROM win",
    "p5_windows": _OBJECTS + "SELECT edge_id, object_path, json_extract_string(j, '$.frame') AS frame FROM win",
    "p5_rules": _OBJECTS + "SELECT edge_id, object_path, parent_path, position, json_extract_string(j, '$.cond') AS cond, json_extract_string(j, '$.value') AS value FROM obj WHERE kind = 'rule_logic'",
    "p5_struct_fields": _OBJECTS + "SELECT edge_id, object_path, parent_path, position, depth, json_extract_string(j, '$.field') AS field, json_extract_string(j, '$.kind') AS kind, json_extract_string(j, '$.value') AS value FROM obj WHERE kind = 'struct_fields'",
}

QUERIES = {"p5_found": p5_found, "p5_objects": p5_objects, "p5_windows": p5_windows, "p5_rules": p5_rules, "p5_struct_fields": p5_struct_fields, "p5_list_items": p5_list_items}
