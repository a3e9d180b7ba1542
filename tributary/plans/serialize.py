"""Compact texts of a lineage graph: JSON, a line language with interned symbols, an outline, and a page.

These are for one graph at a time and are read by people or put into prompts; the lines are made in Spark
and only the finished, ordered lines are collected.
"""

from __future__ import annotations

import html
import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.lineage import predicate_use

_SHORT = {"reads": "R", "writes": "W", "derives": "D", "filters": "F", "projects": "P", "joins": "J", "aggregates": "A", "opaque_transform": "O"}
LEGEND = {"R": "read", "W": "write", "D": "derive a column", "F": "filter", "P": "project", "J": "join", "A": "aggregate", "O": "opaque step"}


def _escaped(c: Column) -> Column:
    return F.regexp_replace(F.coalesce(c.cast("string"), F.lit("")), r"([|\\\n])", " ")


def _listed(name: str) -> Column:
    return F.coalesce(F.array_join(name, ","), F.lit(""))


def symbols(edges: DataFrame) -> DataFrame:
    """(id, symbol): tables T0.., other nodes D0.., numbered by their first appearance."""
    ends = edges.select("ordinal", F.posexplode(F.array("source", "right_source", "target")).alias("place", "id")).filter("id is not null")
    first = ends.groupBy("id").agg(F.min(F.struct("ordinal", "place")).alias("first"))
    letter = F.when(F.col("id").startswith("table:") | F.col("id").startswith("ext:"), "T").otherwise("D")
    numbered = first.withColumn("letter", letter).withColumn("n", F.row_number().over(Window.partitionBy("letter").orderBy("first", "id")) - 1)
    return numbered.select("id", F.concat("letter", F.col("n").cast("string")).alias("symbol"))


def edge_lines(edges: DataFrame) -> DataFrame:
    """(ordinal, line): one line an edge, its ends as symbols."""
    names = symbols(edges)
    held = edges
    for end in ("source", "right_source", "target"):
        held = held.join(names.select(F.col("id").alias(end), F.col("symbol").alias(f"{end}_symbol")), end, "left")
    pair = F.array_join(F.transform("join_keys", lambda k: F.concat(k["l"], F.lit("="), k["r"])), ",")
    agg = F.array_join(F.transform("aggs", lambda a: F.concat(a["output"], F.lit("<-"), F.coalesce(a["op"], F.lit("?")), F.lit("("), F.coalesce(a["input"], F.lit("*")), F.lit(")"))), ",")
    rule = F.array_join(F.transform("rule_logic", lambda r: F.concat(F.coalesce(r["cond"], F.lit("")), F.lit("=>"), F.coalesce(r["value"], F.lit("")))), ";")
    window = F.when(F.col("window_spec").isNotNull(), F.concat(F.lit("by "), F.coalesce(F.array_join("window_spec.partition_cols", ","), F.lit("")), F.lit(" order "), F.coalesce(F.array_join("window_spec.order_cols", ","), F.lit("")), F.coalesce(F.concat(F.lit(" "), "window_spec.frame"), F.lit(""))))
    detail = (
        F.when(F.col("kind") == "derives", F.concat_ws("|", _escaped(F.col("output_col")), _listed("source_cols"), _escaped(window), _escaped(rule)))
        .when(F.col("kind") == "joins", F.concat_ws("|", _escaped(F.col("join_type")), _escaped(pair)))
        .when(F.col("kind") == "aggregates", F.concat_ws("|", _listed("group_keys"), _escaped(agg)))
        .when(F.col("kind") == "projects", _listed("kept_cols"))
        .when(F.col("kind") == "filters", _listed("referenced_cols"))
        .when(F.col("kind") == "writes", _escaped(F.col("write_mode")))
        .when(F.col("kind") == "opaque_transform", F.concat_ws("|", _escaped(F.col("opaque_operator")), F.when(F.col("is_passthrough"), "pass").otherwise("unknown")))
        .otherwise("")
    )
    short = F.coalesce(*[F.when(F.col("kind") == k, F.lit(v)) for k, v in _SHORT.items()], F.lit("?"))
    line = F.concat_ws("|", short, F.coalesce("source_symbol", F.lit("?")), F.coalesce("right_source_symbol", F.lit("")), F.coalesce("target_symbol", F.lit("?")), detail)
    return held.select("ordinal", "edge_id", line.alias("line"))


def _column(df: DataFrame, name: str, order: list) -> list:
    return [r[0] for r in df.orderBy(*order).select(name).collect()]


def line_language(edges: DataFrame, provenance: DataFrame, warnings: DataFrame | None = None, predicates: DataFrame | None = None) -> str:
    """Sections of tables, nodes, provenance, predicates with their use, rules, edges and warnings; each predicate stands once under its id. Names that are no columns of a table (qualified ones) are left out of the provenance."""
    names = symbols(edges)
    shown = names.select("symbol", F.concat_ws("|", "symbol", "id").alias("line"))
    prov = provenance.filter(~F.col("column").contains(".")).groupBy("table", "column").agg(F.array_join(F.array_sort(F.collect_set(F.concat(F.regexp_replace("from_table", "^(?:table|ext):", ""), F.lit("."), "from_column"))), ",").alias("origin"), F.min("role").alias("role"))
    lines = ["@TABLES", *_column(shown.filter("symbol like 'T%'"), "line", [F.length("symbol"), "symbol"]), "@NODES", *_column(shown.filter("symbol like 'D%'"), "line", [F.length("symbol"), "symbol"])]
    lines += ["@PROV", *_column(prov.select("table", "column", F.concat_ws("|", "table", "column", "role", "origin").alias("line")), "line", ["table", "column"])]
    if {"rule_logic", "struct_fields"} <= set(edges.columns):
        used = predicate_use(edges)
        lines += ["@PREDS", *_column(used.select("predicate_id", F.concat_ws("|", "predicate_id", _escaped(F.col("cond"))).alias("line")).distinct(), "line", ["predicate_id"])]
        lines += ["@PUSE", *_column(used.groupBy("predicate_id").agg(F.sum("uses").alias("n"), F.sum("targets").alias("t")).select("predicate_id", F.concat_ws("|", "predicate_id", "n", "t").alias("line")), "line", ["predicate_id"])]
        rule = F.transform("rule_logic", lambda r: F.concat(F.when(r["cond"] == "otherwise", "else").otherwise(F.concat(F.lit("P"), F.substring(F.md5(r["cond"]), 1, 10))), F.lit(">"), _escaped(F.coalesce(r["value"], F.lit("")))))
        ruled = edges.filter("rule_logic is not null").select("ordinal", "edge_id", F.concat_ws("|", F.coalesce("output_col", F.lit("")), F.array_join(rule, ";")).alias("line"))
        lines += ["@RULES", *_column(ruled, "line", ["ordinal", "edge_id"])]
    if predicates is not None:
        entry = F.concat("label", F.lit("="), F.lit("P"), F.substring(F.md5("predicate"), 1, 10))
        held = predicates.groupBy("file", "var").agg(F.array_join(F.array_sort(F.collect_set(entry)), ";").alias("entries"))
        lines += ["@PDICTS", *_column(held.select("file", "var", F.concat_ws("|", "var", "entries").alias("line")), "line", ["file", "var"])]
    lines += ["@EDGES", *_column(edge_lines(edges), "line", ["ordinal", "edge_id"])]
    if warnings is not None:
        lines += ["@WARN", *_column(warnings.select(F.concat_ws("|", F.coalesce("file", F.lit("")), F.coalesce(F.col("lineno").cast("string"), F.lit("")), "category", _escaped(F.col("message"))).alias("line")), "line", ["line"])]
    return "\n".join(lines) + "\n"


def compact_graph(edges: DataFrame, provenance: DataFrame, warnings: DataFrame | None = None, most_null_fields: int = 30) -> dict:
    """Legend, tables with inline provenance, edges without empty parts, and warnings; long runs of null struct fields become a count."""
    null = lambda f: (f["kind"] == "lit") & (F.coalesce(f["value"], F.lit("None")).isin("None", "null"))
    trimmed = edges
    if "struct_fields" in edges.columns:
        nulls = F.size(F.filter("struct_fields", null))
        trimmed = edges.withColumn("n_null_fields", F.when(nulls > most_null_fields, nulls)).withColumn("struct_fields", F.when(F.col("n_null_fields").isNotNull(), F.filter("struct_fields", lambda f: ~null(f))).otherwise(F.col("struct_fields")))
    text = trimmed.select("ordinal", F.to_json(F.struct(*[c for c in trimmed.columns if c not in ("edge_id", "graph_id", "repo", "ingested_ts", "extracted_ts", "extractor_version", "raw_detail")])).alias("json"))
    tables: dict[str, dict] = {}
    for r in provenance.orderBy("table", "column", "from_table", "from_column").collect():
        held = tables.setdefault(r["table"], {}).setdefault(r["column"], {"role": r["role"], "from": []})
        held["from"].append(f"{r['from_table']}.{r['from_column']}")
    out = {"legend": LEGEND, "tables": tables, "edges": [{k: v for k, v in json.loads(t).items() if v not in ([], "")} for t in _column(text, "json", ["ordinal"])]}
    if warnings is not None:
        out["warnings"] = [r.asDict() for r in warnings.orderBy("file", "lineno").collect()]
    return out


def outline(provenance: DataFrame) -> str:
    """One line a table: its columns with their roles and origins."""
    item = F.concat("column", F.lit("<-"), F.array_join(F.array_sort(F.collect_set(F.concat_ws(".", "from_table", "from_column"))), "+"))
    columns = provenance.groupBy("table", "column").agg(item.alias("item"))
    return "\n".join(_column(columns.groupBy("table").agg(F.concat(F.col("table"), F.lit(": "), F.array_join(F.array_sort(F.collect_list("item")), "; ")).alias("line")), "line", ["table"])) + "\n"


def impact_report(target: str, column: str | None, columns: list[str], tables: list[str], seed_status: str) -> dict:
    """What a change reaches. Coverage is never complete: finding nothing does not make a change safe."""
    status = "cannot_determine" if seed_status == "unresolved" else "impact_detected" if columns or tables else "no_impact_detected"
    return {"target": target if column is None else f"{target}.{column}", "impacted_columns": sorted(columns), "impacted_tables": sorted(tables), "seed_resolution": seed_status, "status": status, "coverage_complete": False, "note": "Static lineage may miss dependencies; an empty result is not a proof of safety."}


def page(edges: DataFrame, tiers: DataFrame, title: str = "Lineage") -> str:
    """A self-contained page: tables in three columns by tier, as an SVG with links from reads to writes."""
    tier = {r["table"]: r["tier"] for r in tiers.collect()}
    place = {"source": 0, "mid": 1, "sink": 2}
    spots: dict[str, tuple[int, int]] = {}
    rows = [0, 0, 0]
    for name in sorted(tier):
        column = place[tier[name]]
        spots[name] = (40 + 380 * column, 40 + 34 * rows[column])
        rows[column] += 1
    from ..operators.lineage import table_links

    links = [(r["src"], r["dst"]) for r in table_links(edges).orderBy("src", "dst").collect()]
    shapes = [f'<path d="M{spots[a][0] + 300},{spots[a][1] + 12} C{spots[a][0] + 345},{spots[a][1] + 12} {spots[b][0] - 45},{spots[b][1] + 12} {spots[b][0]},{spots[b][1] + 12}" fill="none" stroke="#888"/>' for a, b in links if a in spots and b in spots]
    boxes = [f'<g><rect x="{x}" y="{y}" width="300" height="24" rx="4" class="{tier[n]}"/><text x="{x + 8}" y="{y + 16}">{html.escape(n.partition(":")[2][-44:])}</text><title>{html.escape(n)}</title></g>' for n, (x, y) in spots.items()]
    style = "text{font:12px monospace}.source{fill:#dbe9f6}.mid{fill:#f3ecd2}.sink{fill:#dff0df}"
    return f'<!doctype html><meta charset="utf-8"><title>{html.escape(title)}</title><style>{style}</style><svg xmlns="http://www.w3.org/2000/svg" width="1200" height="{60 + 34 * max([1, *rows])}">{"".join(shapes)}{"".join(boxes)}</svg>'
