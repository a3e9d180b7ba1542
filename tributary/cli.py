"""Command line: extract, context, impact, diff and compare over folders of sources."""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .extract.assemble import lineage_of
from .extract.symbols import Registry
from .operators.closure import closure
from .operators.lineage import compare, edge_key, forward_index, graph_changes, provenance, resolve_seeds, table_links, table_tiers
from .plans.serialize import compact_graph, impact_report, line_language, outline, page
from .session import durable, get_session
from .sources.repository import Scope, scan_repository


def scope_of(args) -> Scope:
    """The repository's own file or the named one, then a file of globs, then the command line."""
    config = Path(args.config) if args.config else Path(args.folder) / ".lineage" / "scope.json"
    scope = Scope.load(config) if config.exists() else Scope()
    if args.include_from:
        scope = scope.merged(Scope(include=[x.strip() for x in Path(args.include_from).read_text().splitlines() if x.strip() and not x.startswith("#")]))
    return scope.merged(Scope(args.scope_dir or [], args.include or [], args.exclude or []))


def load(spark, args, folder: str) -> dict[str, DataFrame]:
    files, missing = scan_repository(spark, str(Path(folder).resolve()), scope_of(args))
    registry = Registry.load(Path(folder) / ".lineage" / "helpers.json", Path(folder) / ".lineage" / "sinks.json")
    found = lineage_of(spark, files, registry)
    found["warnings"] = found["warnings"].unionByName(missing.withColumn("lineno", F.lit(None).cast("int")))
    return found


def impact(spark, edges: DataFrame, table: str, column: str | None) -> dict:
    if column is None:
        links = table_links(edges)
        name = F.lower(F.regexp_replace("src", "^(?:table|ext):", ""))
        seeds = links.filter((name == table.lower()) | name.endswith("." + table.lower())).select(F.lit("s").alias("seed"), F.col("src").alias("node"))
        found = [r["node"] for r in closure(links, seeds).select("node").distinct().collect()]
        return impact_report(table, None, [], found, "qualified" if not seeds.isEmpty() else "unresolved")
    fwd = forward_index(provenance(edges))
    nodes = fwd.select(F.col("src").alias("node")).union(fwd.select("dst")).distinct()
    seeds = resolve_seeds(nodes, spark.createDataFrame([("s", table, column)], "`case` string, `table` string, `column` string"))
    status = seeds.first()["status"]
    reach = [r["node"] for r in closure(fwd, seeds.filter("node is not null").select(F.col("case").alias("seed"), "node")).select("node").distinct().collect()]
    return impact_report(table, column, reach, sorted({n.rpartition(".")[0] for n in reach}), status)


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="tributary", description=__doc__)
    parser.add_argument("command", choices=["extract", "context", "impact", "diff", "compare"])
    parser.add_argument("folder")
    parser.add_argument("other", nargs="?", help="the newer folder for diff and compare")
    parser.add_argument("--output")
    parser.add_argument("--format", choices=["parquet", "json", "lines", "outline", "html"], default="lines")
    parser.add_argument("--table")
    parser.add_argument("--column")
    parser.add_argument("--question")
    parser.add_argument("--strict", action="store_true")
    parser.add_argument("--config")
    parser.add_argument("--include-from")
    for name in ("--scope-dir", "--include", "--exclude"):
        parser.add_argument(name, action="append")
    args = parser.parse_args(argv)
    spark = get_session()
    found = load(spark, args, args.folder)
    edges = found["edges"]
    if args.command == "extract":
        if args.format == "parquet":
            for name, frame in found.items():
                frame.write.mode("overwrite").parquet(f"{args.output or 'lineage'}/{name}")
            return 0
        prov = provenance(edges)
        text = {"json": lambda: json.dumps(compact_graph(edges, prov, found["warnings"]), indent=1), "outline": lambda: outline(prov), "html": lambda: page(edges, table_tiers(edges), args.folder), "lines": lambda: line_language(edges, prov, found["warnings"], found["predicates"])}[args.format]()
    elif args.command == "context":
        graph = json.dumps(compact_graph(edges, provenance(edges), found["warnings"]), separators=(",", ":"))
        text = f"# Lineage of {args.folder}\n\nThe graph below was read from source text; unresolved parts are marked.\n\n```json\n{graph}\n```\n" + (f"\n## Question\n\n{args.question}\n" if args.question else "")
    elif args.command == "impact":
        text = json.dumps(impact(spark, edges, args.table or "", args.column), indent=1)
    elif args.command == "diff":
        newer = load(spark, args, args.other)["edges"]
        told, n = [], 0
        for r in durable(graph_changes(edges, newer), "changes").orderBy("part", "change", "id").toLocalIterator():
            n += 1
            told.append(f"{r['change']} {r['part']}: {r['id']}" + (f" ({'breaks' if r['change'] == 'removed' else 'reaches'} {r['n_downstream']})" if r["n_downstream"] else ""))
        text = "\n".join([f"{n} changes", *told]) + "\n"
        if args.strict and n:
            sys.stdout.write(text)
            return 1
    else:
        newer = load(spark, args, args.other)["edges"]
        key = lambda e: e.select(edge_key().alias("key"))
        changes = compare(key(edges), key(newer), ["key"]).filter("change <> 'same'").orderBy("key").collect()
        text = "\n".join(f"{r['change']}: {r['key']}" for r in changes) + "\n"
        if args.strict and changes:
            sys.stdout.write(text)
            return 1
    Path(args.output).write_text(text) if args.output else sys.stdout.write(text)
    return 0


if __name__ == "__main__":
    sys.exit(main())
