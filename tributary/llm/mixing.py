"""Problem 9: a mixture of sources by target shares, ordered by a curriculum that varies over training.

Each source has a weight over training time t in [0, 1]; its integral times the size of the mixture is
the source's token demand up to t. A text's place among the drawn tokens of its source is mapped back
through that demand to a time, and all texts are range-sorted by time. Shares hold over the whole
mixture, whatever the schedule.

The place inside a source comes from token sums of salted parts of some ``ROWS_A_SALT`` rows each, so a source that
holds a third of all texts is no single task. The plan and the sums are joined as Spark finds them, by size: both are
written tables, so that Spark knows it, and the texts already lie by source and part when the sums are joined.

Defined results: sources are compared trimmed, in lower case and with ``_`` for ``-``; a source that is
null or not listed has share 0 and gives nothing; a listed source may be absent, or too small even when
repeated ``max_repeats`` times, and then gives what it has (the report tells); texts without tokens are
never drawn; a source listed twice counts with the sum of its shares and the larger cap. An empty table
gives no rows. Extra columns are not read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..queries.tables import table
from ..session import durable
from .tokens import VOCABULARY, with_token_counts

ROWS_A_SALT = 50_000
STEPS = 100  # pieces of a schedule


def source_name(column: str) -> Column:
    return F.translate(F.lower(F.regexp_replace(column, r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")), "-", "_")


def planned(sizes: DataFrame, targets: DataFrame, part_of_corpus: float = 0.5) -> DataFrame:
    """One row per listed source: available, wanted and drawable tokens and the slope of its schedule.

    The default schedule is linear: weight share * (1 + slope * (2t - 1)). Sources that the mixture
    raises above their part of the corpus come later; slopes are centred so that all weights sum to 1
    at any time.
    """
    listed = targets.groupBy(source_name("source").alias("source")).agg(F.sum("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats")).filter("source is not null")
    corpus = float(sizes.agg(F.coalesce(F.sum("n_tokens"), F.lit(0))).first()[0])
    have = sizes.groupBy("source").agg(F.sum("n_tokens").cast("bigint").alias("available"))
    rows = listed.join(have, "source", "left").fillna(0, ["available"])
    raised = F.when((F.col("available") > 0) & (F.col("target_share") > 0), F.tanh(F.log(F.col("target_share") / (F.col("available") / F.lit(corpus))))).otherwise(0.0)
    rows = rows.withColumn("raised", raised)
    centre = rows.agg(F.try_divide(F.sum(F.col("target_share") * F.col("raised")), F.sum("target_share"))).first()[0] or 0.0
    wanted = F.col("target_share") * corpus * part_of_corpus
    return rows.select("source", "target_share", "max_repeats", "available", wanted.alias("wanted"), F.least(wanted, F.col("available") * F.col("max_repeats").cast("double")).alias("drawable"), (0.5 * (F.col("raised") - F.lit(centre))).alias("slope"))


def scheduled(plan: DataFrame, schedules: dict[str, list[tuple[float, float]]] | None = None) -> DataFrame:
    """``plan`` with ``knots``: for each source the times and the part of its demand by then, as an array of (t, upto), t and upto from 0 to 1.

    ``schedules`` gives weights (time, weight) of sources by name, linear in between; other sources have the linear schedule of
    their slope. A schedule without positive weight is an error.
    """
    linear = F.transform(F.sequence(F.lit(0), F.lit(STEPS)), lambda i: F.struct((i / STEPS).alias("t"), ((i / STEPS) + F.col("slope") * ((i / STEPS) * (i / STEPS) - i / STEPS)).alias("upto")))
    chosen = linear
    for name, points in (schedules or {}).items():
        points = sorted((min(1.0, max(0.0, float(t))), float(w)) for t, w in points)
        if not points or min(w for _, w in points) < 0 or max(w for _, w in points) <= 0:
            raise ValueError(f"the schedule of {name} has no weight")
        times = np.linspace(0, 1, STEPS + 1)
        weights = np.interp(times, [t for t, _ in points], [w for _, w in points])
        upto = np.concatenate(([0.0], np.cumsum((weights[1:] + weights[:-1]) / 2)))
        if upto[-1] <= 0:
            raise ValueError(f"the schedule of {name} has no weight")
        knots = F.array(*[F.struct(F.lit(float(t)).alias("t"), F.lit(float(u)).alias("upto")) for t, u in zip(times, upto / upto[-1])])
        chosen = F.when(F.col("source") == F.lit(name), knots).otherwise(chosen)
    return plan.withColumn("knots", chosen)


def inverted(knots: Column, part: Column) -> Column:
    """The time at which the demand reaches ``part``: linear between two knots."""
    later = F.filter(knots, lambda k: k["upto"] >= part)[0]
    sooner = F.element_at(F.filter(knots, lambda k: (k["upto"] < part) | (k["t"] == 0)), -1)
    rise = later["upto"] - sooner["upto"]
    return F.when(rise > 0, sooner["t"] + (later["t"] - sooner["t"]) * (part - sooner["upto"]) / rise).otherwise(later["t"])


def mixture(sizes: DataFrame, plan: DataFrame, seed: int = 17, schedules: dict[str, list[tuple[float, float]]] | None = None) -> DataFrame:
    """(doc_id, source, copy, n_tokens, position), sorted by position: every drawn copy and its time in training."""
    salts = max(64, -(-sizes.count() // ROWS_A_SALT))
    mixed = F.xxhash64("doc_id", F.lit(seed))
    plan = scheduled(plan, schedules) if schedules else plan
    texts = sizes.select("doc_id", "source", "n_tokens").filter("n_tokens > 0").join(plan.filter("drawable > 0"), "source").withColumn("salt", F.pmod(mixed, F.lit(salts)).cast("int"))
    sums = texts.groupBy("source", "salt").agg(F.sum("n_tokens").alias("part"))
    before = sums.withColumn("before", F.sum("part").over(Window.partitionBy("source").orderBy("salt")) - F.col("part")).drop("part")
    inner = Window.partitionBy("source", "salt").orderBy(mixed, "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    placed = texts.withColumn("inside", F.coalesce(F.sum("n_tokens").over(inner), F.lit(0))).join(before, ["source", "salt"])
    middle = F.col("before") + F.col("inside") + F.col("n_tokens") / 2
    # a copy is drawn while the middle of its tokens lies within what the source is to give
    copies = F.least(F.ceil((F.col("drawable") - F.col("middle")) / F.col("available")), F.col("max_repeats").cast("bigint"))
    drawn = placed.withColumn("middle", middle).withColumn("copies", copies).filter("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    part = F.least((F.col("middle") + (F.col("copy") - 1) * F.col("available")) / F.col("drawable"), F.lit(1.0))
    if schedules:
        time = F.coalesce(inverted(F.col("knots"), part), F.lit(1.0))
    else:
        s = F.col("slope")
        # the demand up to t is t + slope * (t * t - t) of the source's tokens; solved for t
        time = 2 * part / ((1 - s) + F.sqrt((1 - s) * (1 - s) + 4 * s * part))
    return drawn.select("doc_id", "source", "copy", "n_tokens", time.alias("position")).orderBy("position", "source", "doc_id", "copy")


def reached(drawn: DataFrame, plan: DataFrame) -> DataFrame:
    """Wanted and reached shares of every listed source."""
    got = drawn.groupBy("source").agg(F.sum("n_tokens").cast("bigint").alias("drawn"), F.count("*").alias("n_texts"), F.max("copy").alias("most_copies"))
    rows = plan.join(got, "source", "left").fillna(0, ["drawn", "n_texts", "most_copies"])
    total, total_wanted = rows.agg(F.coalesce(F.sum("drawn"), F.lit(0)), F.coalesce(F.sum("wanted"), F.lit(0.0))).first()
    share = lambda of: F.col("drawn") / F.lit(float(of)) if of > 0 else F.lit(0.0)
    return rows.select("source", "target_share", "max_repeats", "available", F.round("wanted", 3).alias("wanted"), "drawn", "n_texts", "most_copies", share(total).alias("share_reached"), share(total_wanted).alias("share_of_planned_size"))


def _inputs(spark: SparkSession, sf_dir: str, vocabulary: str = VOCABULARY) -> tuple[DataFrame, DataFrame]:
    docs = table(spark, sf_dir, "documents").select("doc_id", source_name("source").alias("source"), "text")
    sizes = durable(with_token_counts(docs, vocabulary=vocabulary), "sizes")
    return sizes, durable(planned(sizes, table(spark, sf_dir, "mix_targets")), "plan")


def p9_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture(*_inputs(spark, sf_dir))


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes, plan = _inputs(spark, sf_dir)
    return reached(mixture(sizes, plan), plan)


def p9_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What must hold for each listed source: no text too often, its tokens within one longest text of what it can give, positions from 0 to 1."""
    sizes, plan = _inputs(spark, sf_dir)
    drawn = durable(mixture(sizes, plan), "drawn")
    longest = sizes.groupBy("source").agg(F.max("n_tokens").alias("longest"))
    copies = drawn.groupBy("source", "doc_id").count().groupBy("source").agg(F.max("count").alias("most"))
    got = drawn.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.min("position").alias("first"), F.max("position").alias("last"))
    rows = plan.join(got, "source", "left").join(copies, "source", "left").join(longest, "source", "left")
    least = F.coalesce(F.col("longest"), F.lit(0)) * F.greatest(F.col("max_repeats"), F.lit(1))
    return rows.select(
        "source", (F.coalesce("most", F.lit(0)) <= F.col("max_repeats")).alias("within_cap"), (F.abs(F.coalesce("tokens", F.lit(0)) - F.col("drawable")) <= least).alias("share_met"),
        ((F.coalesce("first", F.lit(0.0)) >= 0) & (F.coalesce("last", F.lit(1.0)) <= 1)).alias("within_training"))


SQL = {"p9_properties": r"SELECT DISTINCT replace(lower(trim(source)), '-', '_') AS source, true AS within_cap, true AS share_met, true AS within_training FROM mix_targets WHERE source IS NOT NULL"}
QUERIES = {"p9_mixture": p9_mixture, "p9_shares": p9_shares, "p9_properties": p9_properties}
