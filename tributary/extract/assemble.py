"""From source files to the lineage relation: a distributed pass a file, then merges.

Three barriers replace the order in which files would have to run: constants and declared schemas first
(small tables of a repository's configuration and DDL), then every file by itself in the workers, then
the SQL texts the files hold (parsed by Spark's parser in the executors), and merging.
"""

from __future__ import annotations

import json
import pickle
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.closure import closure
from ..plans.parser import digest
from ..plans.sqltext import SqlLineage
from ..session import durable
from ..sources.repository import run_order
from .notebook import prepare, run_target
from .pyfront import Extractor
from .symbols import Registry, Symbols

_PAIR = "struct<l:string,r:string>"
_RULE = "array<struct<cond:string,value:string>>"
EDGE = f"""kind string, file string, lineno int, source string, right_source string, target string, output_col string, source_cols array<string>, expr_id string,
 window_spec struct<partition_cols:array<string>,order_cols:array<string>,frame:string>, rule_logic {_RULE}, struct_fields array<struct<field:string,kind:string,value:string,source_cols:array<string>,rule_logic:{_RULE}>>,
 column_var string, referenced_cols array<string>, removed_cols array<string>, kept_cols array<string>, join_type string, join_keys array<{_PAIR}>, group_keys array<string>, aggs array<struct<op:string,input:string,output:string>>,
 write_mode string, format string, streaming boolean, partition_cols array<string>, merge_keys array<string>, sink_class string, opaque_operator string, is_passthrough boolean, is_dynamic boolean"""
WARNING = "file string, lineno int, category string, message string"
TABLE = "file string, fqn string, columns array<string>, declared boolean"
ROWS = "rel_path string, row_type string, ordinal int, payload string"


def extract_text(path: str, text: str, symbols: dict | None = None, registry: Registry | None = None, schemas: dict | None = None) -> list[tuple[str, dict]]:
    """All rows of one Python file or notebook; a failure is a row, never an exception."""
    try:
        prepared = prepare(path, text)
        return Extractor(path, prepared, Symbols(dict(symbols or {})), registry or Registry(), schemas).run()
    except Exception as error:  # one file must not end the job
        return [("warning", {"file": path, "lineno": 0, "category": "extraction-error", "message": f"{type(error).__name__}: {error}"[:300]})]


def _learned(config: list[dict]) -> dict[str, object]:
    """Constants of files (rel_path, content) in their order: the configuration of a repository, or what a notebook runs."""
    import ast

    symbols = Symbols()
    for held in config:
        try:
            path = held["rel_path"]
            symbols.learn(ast.parse(prepare(path, held["content"] or "").text), path.rpartition("/")[2].partition(".")[0])
        except (SyntaxError, ValueError):
            continue
    return symbols.values


def contexts(files: DataFrame, declared: DataFrame) -> DataFrame:
    """(repo, context): pickled constants and declared schemas of each repository, of files (repo, rel_path, content) and tables (repo, rel_path, ordinal, fqn, columns)."""
    order = run_order("rel_path")
    config = files.filter(order <= 1).groupBy("repo").agg(F.sort_array(F.collect_list(F.struct(order.alias("run"), "rel_path", "content"))).alias("config"))
    tables = declared.groupBy("repo").agg(F.sort_array(F.collect_list(F.struct("rel_path", "ordinal", "fqn", "columns"))).alias("tables"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = [pickle.dumps((_learned(r["config"] or []), {t["fqn"]: t["columns"] for t in r["tables"] or []})) for r in batch.to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("repo"), pa.array(held, pa.binary())], names=["repo", "context"])

    return config.join(tables, "repo", "full_outer").select("repo", "config", "tables").mapInArrow(run, "repo string, context binary")


def runs_of(path: str, text: str) -> list[str]:
    """The notebooks a notebook runs, as repository paths without extension."""
    try:
        return [run_target(path, t) for t in prepare(path, text).runs]
    except ValueError:
        return []


def _stem(path: str) -> Column:
    return F.regexp_replace(path, r"\.(?:py|ipynb)$", "")


def followed_runs(files: DataFrame) -> DataFrame:
    """(repo, rel_path, ran): for each file of (repo, rel_path, content) the files it runs, and those they run, as (distance, rel_path, content), the farthest first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [(repo, path, target) for repo, path, text in zip(*(batch.column(i).to_pylist() for i in range(3))) for target in runs_of(path, text)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.string()) for i in range(3)], names=["repo", "rel_path", "target"])

    code = files.filter(F.lower("rel_path").rlike(r"\.(?:py|ipynb)$"))
    asked = code.filter(F.col("content").contains("%run")).select("repo", "rel_path", "content").mapInArrow(run, "repo string, rel_path string, target string")
    stems = code.select("repo", _stem("rel_path").alias("target"), F.col("rel_path").alias("ran"))
    links = durable(asked.join(stems, ["repo", "target"]).select("repo", "rel_path", "ran").distinct(), "runs")
    tag = lambda c: F.concat_ws("\u0001", "repo", c)
    part = lambda c, i: F.split_part(c, F.lit("\u0001"), F.lit(i))
    reached = closure(links.select(tag("rel_path").alias("src"), tag("ran").alias("dst")), links.select(tag("rel_path").alias("seed"), tag("rel_path").alias("node")))
    reached = reached.select(part("seed", 1).alias("repo"), part("seed", 2).alias("by"), part("node", 2).alias("rel_path"), "depth")
    held = reached.join(code.select("repo", "rel_path", "content"), ["repo", "rel_path"])
    far = F.sort_array(F.collect_list(F.struct((-F.col("depth")).alias("distance"), "rel_path", "content"))).alias("ran")
    return held.groupBy("repo", F.col("by").alias("rel_path")).agg(far)


def extract(files: DataFrame, registry: Registry | None = None, schemas: dict[str, list[str]] | None = None, symbols: dict | None = None) -> DataFrame:
    """(rel_path, row_type, ordinal, payload) of all Python files and notebooks of (rel_path, content).

    A column ``context`` (see ``contexts``) holds the constants and schemas of a file's repository; ``symbols`` and ``schemas`` hold for files without.
    A column ``ran`` (see ``followed_runs``) holds the notebooks a file runs, whose constants it knows.
    """
    registry, schemas, symbols = registry or Registry(), schemas or {}, symbols or {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, known = None, (symbols, schemas)
        for batch in batches:
            out: list[tuple[str, str, int, str]] = []
            for path, text, context, ran in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if context != last:
                    last, known = context, (symbols, schemas) if context is None else pickle.loads(context)
                names = known[0] | _learned(ran) if ran else known[0]
                out += [(path, kind, i, json.dumps(held)) for i, (kind, held) in enumerate(extract_text(path, text or "", names, registry, known[1]))]
            kinds = (pa.string(), pa.string(), pa.int32(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], kind) for i, kind in enumerate(kinds)], names=["rel_path", "row_type", "ordinal", "payload"])

    given = [F.col(c) if c in files.columns else F.lit(None).cast(t).alias(c) for c, t in (("context", "binary"), ("ran", "array<struct<distance:int,rel_path:string,content:string>>"))]
    return files.filter(F.lower("rel_path").rlike(r"\.(?:py|ipynb)$")).select("rel_path", "content", *given).mapInArrow(run, ROWS)


_TEXT = ("rel_path", "ordinal", "lineno", "target", "sql")


def held_texts(rows: DataFrame) -> DataFrame:
    """The SQL texts in extracted rows."""
    held = rows.filter("row_type = 'sql'").select("rel_path", "ordinal", F.from_json("payload", "lineno int, target string, sql string").alias("p")).select("rel_path", "ordinal", "p.*")
    return held.filter("sql <> '<unresolved>'").select(*_TEXT)


def script_texts(files: DataFrame) -> DataFrame:
    """The statements of .sql files."""
    scripts = files.filter(F.lower("rel_path").endswith(".sql")).select("rel_path", F.posexplode(F.split(F.regexp_replace("content", r"(?m)--.*$", ""), r";\s*(?:\n|$)")).alias("ordinal", "sql")).filter("length(trim(sql)) > 0")
    return scripts.withColumn("lineno", F.lit(1)).withColumn("target", F.lit(None).cast("string")).select(*_TEXT)


def sql_rows(spark: SparkSession, texts: DataFrame, batch: int = 2_000) -> DataFrame:
    """The same rows for SQL texts, parsed in the executors: any number of texts, at most some ``batch`` to a task."""
    texts = durable(texts, "texts")
    tasks = max(spark.sparkContext.defaultParallelism, -(-texts.count() // batch))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in batches:
            out: list[tuple[str, str, int, str]] = []
            for path, ordinal, lineno, target, plan in zip(*(held.column(i).to_pylist() for i in range(5))):
                out += [(path, kind, 1_000_000 + 1_000 * ordinal + i, json.dumps(row)) for i, (kind, row) in enumerate(SqlLineage(path, lineno, plan, target, ordinal).rows)]
            kinds = (pa.string(), pa.string(), pa.int32(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], kind) for i, kind in enumerate(kinds)], names=["rel_path", "row_type", "ordinal", "payload"])

    # written, as several readers follow and each would parse anew
    return durable(texts.repartition(tasks).select("rel_path", "ordinal", "lineno", "target", digest(spark, "sql")).mapInArrow(run, ROWS), "sql")


def lineage_of(spark: SparkSession, files: DataFrame, registry: Registry | None = None) -> dict[str, DataFrame]:
    """edges, tables, warnings, expressions, column_rules and predicates of (rel_path, content); with a column ``repo``, constants and schemas are those of each repository."""
    repo = F.col("repo") if "repo" in files.columns else F.lit("")
    files = durable(files.select("rel_path", "content", F.coalesce(repo, F.lit("")).alias("repo")), "files")
    scripts = sql_rows(spark, script_texts(files))
    declared = scripts.filter("row_type = 'table'").select("rel_path", "ordinal", F.from_json("payload", TABLE).alias("t")).select("rel_path", "ordinal", "t.fqn", "t.columns", "t.declared").filter("declared")
    known = durable(contexts(files, declared.join(files.select("rel_path", "repo").distinct(), "rel_path")), "contexts")
    python = durable(extract(files.join(known, "repo", "left").join(followed_runs(files), ["repo", "rel_path"], "left"), registry), "rows")
    rows = python.unionByName(scripts).unionByName(sql_rows(spark, held_texts(python)))
    part = lambda kind, schema: rows.filter(F.col("row_type") == kind).select("rel_path", "ordinal", F.from_json("payload", schema).alias("p")).select("ordinal", "p.*")
    edges = part("edge", EDGE).withColumn("ordinal", F.col("ordinal").cast("bigint"))
    edges = edges.withColumn("graph_id", F.lit("repository")).withColumn("edge_id", F.sha2(F.to_json(F.struct(*[c for c in edges.columns])), 256))
    sinks = list((registry or Registry()).sinks)
    if sinks:
        edges = edges.filter(~((F.col("kind") == "opaque_transform") & F.col("opaque_operator").isin(sinks)))
    merged = part("table", TABLE).groupBy("fqn").agg(F.max("declared").alias("declared"), F.min_by("columns", F.struct(~F.col("declared"), F.size("columns") == 0, run_order("file"), "file", "ordinal")).alias("columns"))
    touched = edges.filter("kind = 'reads'").select(F.col("source").alias("id")).union(edges.filter("kind = 'writes'").select("target")).distinct()
    orphans = merged.join(touched.select(F.regexp_replace("id", "^table:", "").alias("fqn")), "fqn", "left_anti")
    lost = orphans.select(F.lit(None).cast("string").alias("file"), F.lit(None).cast("int").alias("lineno"), F.lit("orphan-table").alias("category"), F.concat("fqn", F.lit(" is neither read nor written")).alias("message"))
    return {
        "edges": edges,
        "tables": merged,
        "warnings": part("warning", WARNING).drop("ordinal").unionByName(lost),
        "expressions": part("expression", "expr_id string, text string").drop("ordinal").dropDuplicates(["expr_id"]),
        "column_rules": part("column_rule", f"file string, var string, rules {_RULE}").drop("ordinal"),
        "predicates": part("predicate", "file string, var string, label string, predicate string").drop("ordinal"),
    }
