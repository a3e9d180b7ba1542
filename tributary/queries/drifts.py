"""Problem 3: one table of all evaluation records, and what changed from file to file."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.drift import approved_names, drift, ingest, parse_records, replay
from ..operators.versions import latest_version
from ..session import durable
from .tables import table

TARGET = {
    "id": "string", "category": "string", "difficulty": "string", "message": "string", "notes": "string", "meta.context_mode": "string",
    "meta.context_tokens": "bigint", "prompt_tokens": "bigint", "elapsed_s": "double", "score": "bigint", "sealed": "boolean", "graph_evidence": "array<string>",
}


def parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = table(spark, sf_dir, "run_records").select("record_id", "feed", "file_name", "run_ts", "line_no", "payload", "ingested_ts")
    return parse_records(latest_version(records, "record_id"))


def p3_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drift(parsed(spark, sf_dir))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drift(parsed(spark, sf_dir)).select("file_name", "change_kind", "field", "new_field")


def p3_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All records in the target schema; fields it does not know, and values that do not cast, in ``_rescued``.

    Records are ingested under the target's own names first; then the renames of the drift report are approved, and
    what was rescued under those names is replayed into the typed columns.
    """
    whole = durable(parsed(spark, sf_dir), "parsed")
    own = {field.rpartition(".")[2]: (kind, [field]) for field, kind in TARGET.items()}
    held = durable(ingest(whole, own), "ingested")
    names = durable(approved_names(drift(whole), whole, list(TARGET)), "names").withColumnRenamed("feed", "__feed")
    named = held.join(names, F.col("feed").eqNullSafe(F.col("__feed")), "left").drop("__feed")
    return replay(named, {field.rpartition(".")[2]: (kind, F.col("names")[field]) for field, kind in TARGET.items()}).drop("names")


SQL: dict[str, str] = {}

QUERIES = {"p3_found": p3_found, "p3_changes": p3_changes, "p3_records": p3_records}
