"""One row per key: the version rule."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def latest_version(df: DataFrame, keys: str | list[str], order: str = "ingested_ts", ties: list[str] = ()) -> DataFrame:
    """The row with the greatest ``order`` of each key; rows whose key is null are kept as they are.

    The rank filter is pushed below the shuffle (a limit of one row per key and map task), so a key
    that was sent again a million times sends a row per task only. A null ``order`` loses against any
    value; ties are settled by ``ties`` and are otherwise arbitrary, as tied rows are alike. An empty
    table gives an empty table.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    rank = "__rank_of_version"
    window = Window.partitionBy(*keys).orderBy(F.col(order).desc_nulls_last(), *[F.col(t).desc_nulls_last() for t in ties])
    present = F.lit(True)
    for key in keys:
        present = present & F.col(key).isNotNull()
    kept = df.filter(present).withColumn(rank, F.row_number().over(window)).filter(F.col(rank) == 1).drop(rank)
    # A null in a non-nullable key cannot occur, and Catalyst then drops this branch.
    return kept.unionByName(df.filter(~present)) if any(df.schema[k].nullable for k in keys) else kept
