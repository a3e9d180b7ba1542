"""Incremental lineage: changed source files are read as a stream and their rows replaced."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..extract.assemble import ROWS, extract
from ..extract.symbols import Registry
from ..operators.versions import latest_version

FILES = "rel_path string, content string, modified_ts timestamp"


def refresh(spark: SparkSession, incoming: str, store: str, checkpoint: str, registry: Registry | None = None, available_now: bool = True):
    """Start a query that reads new files (rel_path, content, modified_ts) in ``incoming`` and appends the rows of each to ``store``.

    Each batch is one version: readers take, of each file, the rows of its latest batch. A batch that is
    repeated after a failure writes the same folder again.
    """
    stream = spark.readStream.schema(FILES).parquet(incoming)

    def upsert(batch: DataFrame, number: int) -> None:
        held = latest_version(batch, "rel_path", "modified_ts")
        rows = extract(held, registry, symbols={})
        # a file without rows still replaces its older version
        marks = held.select("rel_path", F.lit("file").alias("row_type"), F.lit(-1).alias("ordinal"), F.lit("{}").alias("payload"))
        rows.unionByName(marks).write.mode("overwrite").parquet(f"{store}/batch={number}")

    writer = stream.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="30 seconds")).start()


def current(spark: SparkSession, store: str) -> DataFrame:
    """The rows of the latest version of each file."""
    whole = spark.read.schema(f"{ROWS}, batch int").parquet(store)
    last = whole.groupBy("rel_path").agg(F.max("batch").alias("batch"))
    return whole.join(last, ["rel_path", "batch"]).filter("row_type <> 'file'").drop("batch")
