"""Agreement and accuracy measures as conditional aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def prf(df: DataFrame, by: list[str], truth: Column, predicted: Column) -> DataFrame:
    """tp, fp, fn, precision, recall and f1 by group and over all (null group); 0 of 0 counts as 1."""
    sums = df.rollup(*by).agg(F.count_if(truth & predicted).alias("tp"), F.count_if(~truth & predicted).alias("fp"), F.count_if(truth & ~predicted).alias("fn"))
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(1.0)
    p, r = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return sums.select(*by, "tp", "fp", "fn", F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0), 6).alias("f1"))


def set_prf(truth: DataFrame, found: DataFrame, by: str, key: str) -> DataFrame:
    """The same over two sets of keys."""
    a, b = truth.select(by, key).distinct().withColumn("t", F.lit(True)), found.select(by, key).distinct().withColumn("p", F.lit(True))
    both = a.join(b, [by, key], "full_outer").fillna(False, ["t", "p"])
    return prf(both, [by], F.col("t"), F.col("p"))


def kappa(df: DataFrame, by: list[str], a: str, b: str) -> DataFrame:
    """Confusion of two 0/1 ratings, observed and chance agreement, and kappa (1 where chance agreement is 1)."""
    x, y = F.col(a), F.col(b)
    cells = df.filter(x.isin(0, 1) & y.isin(0, 1)).groupBy(*by).agg(F.count_if((x == 0) & (y == 0)).alias("n00"), F.count_if((x == 0) & (y == 1)).alias("n01"), F.count_if((x == 1) & (y == 0)).alias("n10"), F.count_if((x == 1) & (y == 1)).alias("n11"))
    n = F.col("n00") + F.col("n01") + F.col("n10") + F.col("n11")
    observed = (F.col("n00") + F.col("n11")) / n
    chance = ((F.col("n00") + F.col("n01")) * (F.col("n00") + F.col("n10")) + (F.col("n10") + F.col("n11")) * (F.col("n01") + F.col("n11"))) / (n * n)
    value = F.when(chance < 1, (observed - chance) / (1 - chance)).otherwise(1.0)
    return cells.select(*by, "n00", "n01", "n10", "n11", F.round(observed, 6).alias("observed"), F.round(value, 6).alias("kappa"))


def sample_candidates(df: DataFrame, group: list[str], label: str, key: str, negatives: int = 8, seed: int = 7) -> DataFrame:
    """All positives and at most ``negatives`` negatives of each group, chosen by a seeded hash; a sampling operator."""
    from pyspark.sql import Window

    order = Window.partitionBy(*group, label).orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))), key)
    return df.withColumn("__n", F.row_number().over(order)).filter((F.col(label) == 1) | (F.col("__n") <= negatives)).drop("__n")
