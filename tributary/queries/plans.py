"""Lineage of real pipelines over the star schema, and extraction of the source table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..extract.assemble import extract, lineage_of
from ..operators.closure import closure
from ..operators.lineage import forward_index
from ..operators.versions import latest_version
from ..plans.planmode import control_rows, provenance_frame
from .lineage import edges
from .registry import Registry
from .tables import table

query = Registry()


def customer_value(spark: SparkSession, d: str) -> DataFrame:
    """A small medallion: orders joined to customers, revenue by nation, and quartiles."""
    o, c = table(spark, d, "orders"), table(spark, d, "customer")
    joined = o.join(c, o.o_custkey == c.c_custkey, "left").withColumn("net", F.col("o_totalprice") * 0.9)
    by = joined.groupBy("c_nationkey").agg(F.sum("net").alias("revenue"), F.countDistinct("o_custkey").alias("buyers"))
    w = Window.partitionBy(F.lit(1)).orderBy(F.desc("revenue"))  # one row a nation
    return by.withColumn("quartile", F.ntile(4).over(w)).withColumn("tier", F.when(F.col("quartile") == 1, "top").otherwise("rest"))


@query("""SELECT * FROM (VALUES ('customer_value', 'c_nationkey', 'passthrough', 'customer', 'c_nationkey'), ('customer_value', 'revenue', 'aggregate', 'orders', 'o_totalprice'), ('customer_value', 'buyers', 'aggregate', 'orders', 'o_custkey'),
  ('customer_value', 'quartile', 'aggregate', 'orders', 'o_totalprice'), ('customer_value', 'tier', 'aggregate', 'orders', 'o_totalprice')) AS t("table", "column", role, from_table, from_column)""")
def provenance_golden(spark, d):
    return provenance_frame(spark, {"customer_value": customer_value(spark, d)}).drop("graph_id")


@query("SELECT * FROM (VALUES ('customer_value.revenue'), ('customer_value.quartile'), ('customer_value.tier')) AS t(node)")
def impact_golden(spark, d):
    fwd = forward_index(provenance_frame(spark, {"customer_value": customer_value(spark, d)}))
    return closure(fwd, spark.createDataFrame([("s", "orders.o_totalprice")], "seed string, node string")).select("node")


@query("SELECT * FROM (VALUES ('customer_value', 'customer', 'c_custkey'), ('customer_value', 'customer', 'c_nationkey'), ('customer_value', 'orders', 'o_custkey')) AS t(\"table\", from_table, from_column)")
def control_golden(spark, d):
    """Columns that decide the rows and groups of the pipeline, apart from its values."""
    return spark.createDataFrame(control_rows(customer_value(spark, d), "customer_value"), "`table` string, from_table string, from_column string")


@query()
def extract_static(spark, d):
    """Edges of every file of the source table: Python, notebooks, the SQL texts they hold, and .sql files."""
    files = latest_version(table(spark, d, "source_files").select("file_id", "repo", "rel_path", "content", "ingested_ts"), "file_id").select("repo", F.concat_ws("/", "repo", "rel_path").alias("rel_path"), "content")
    found = lineage_of(spark, files)["edges"]
    return found.select(F.col("ordinal").cast("int"), "kind", "file", "lineno", "source", "target", "output_col", F.array_join("source_cols", ",").alias("source_cols"), "write_mode", "join_type")


@query()
def extract_warnings(spark, d):
    """What extraction could not understand, by category."""
    files = latest_version(table(spark, d, "source_files").select("file_id", "repo", "rel_path", "content", "ingested_ts"), "file_id").select(F.concat_ws("/", "repo", "rel_path").alias("rel_path"), "content")
    held = extract(files, symbols={}).filter("row_type = 'warning'").select(F.from_json("payload", "category string").alias("w"))
    return held.groupBy(F.col("w.category").alias("category")).agg(F.count("*").alias("n"))


@query()
def compact_json(spark, d):
    """Every edge as JSON without its empty parts."""
    e = edges(spark, d)
    return e.select("edge_id", F.to_json(F.struct(*[c for c in e.columns if c not in ("edge_id", "raw_detail", "ingested_ts", "extracted_ts")])).alias("json"))


QUERIES, SQL = query.queries, query.sql
