"""Small column helpers of lineage pipelines."""

from __future__ import annotations

from pyspark.sql import DataFrame


def rename_with_suffix(df: DataFrame, suffix: str) -> DataFrame:
    """All columns renamed with a suffix, in one projection."""
    return df.toDF(*[c + suffix for c in df.columns])
