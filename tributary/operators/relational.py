"""Compositions of relational operators that Spark has no single name for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rule_value(predicates: dict[str, str]) -> Column:
    """The label of the first predicate that holds, in order; null if none does."""
    return F.coalesce(*[F.when(F.expr(p), F.lit(label)) for label, p in predicates.items()])


def upsert(target: DataFrame, source: DataFrame, keys: list[str]) -> DataFrame:
    """The merge of a table: rows of ``source`` replace those of ``target`` with their keys, others are added.

    A source that names a key twice gives both rows, as an append would; a null key never matches.
    """
    kept = target.join(source.select(*keys), keys, "left_anti")
    return kept.unionByName(source.select(*target.columns))


def asof_join(left: DataFrame, right: DataFrame, keys: list[str], at: str, take: list[str]) -> DataFrame:
    """Each left row with the columns ``take`` of the last right row of its keys that is not later.

    One shuffle by key: both sides are laid in one stream and the last seen value is carried on. Left
    rows without such a right row have nulls; of right rows at one time the greatest values hold.
    """
    packed = F.struct(*[F.col(c) for c in take]).alias("__seen")
    a = left.withColumns({"__side": F.lit(1), "__row": F.struct(*left.columns)}).select(*keys, at, "__side", "__row", F.lit(None).cast(right.select(packed).schema[0].dataType).alias("__seen"))
    b = right.select(*keys, at, F.lit(0).alias("__side"), F.lit(None).cast(left.select(F.struct(*left.columns).alias("r")).schema[0].dataType).alias("__row"), packed)
    order = Window.partitionBy(*keys).orderBy(F.col(at), F.col("__side"), F.col("__seen")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    carried = a.unionByName(b).withColumn("__last", F.last("__seen", ignorenulls=True).over(order)).filter("__side = 1")
    return carried.select("__row.*", *[F.col(f"__last.{c}").alias(c) for c in take])
