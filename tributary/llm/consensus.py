"""Problem 2: consensus from several annotators' labels.

Expectation-maximisation over items with labels 0 and 1: every judge has a confusion matrix, and the
prior of an item's label comes from a ridge-regularised logistic model of the item's features, fitted
jointly. An iteration is one pass over the items, which are stored once with their labels side by side;
only sums come back: four numbers a judge, two a feature bucket and the likelihood. The first pass starts from the
votes, and every third is made from parameters that are extrapolated from the two steps before (squared extrapolation,
SQUAREM), so that a third of the passes of plain EM are enough; a pass whose likelihood falls is taken back. It ends when
neither likelihood nor parameters move; a fit that has not after ``ROUNDS`` passes says so in a warning.

Defined results: labels other than 0 and 1 and rows without judge or item do not count; of several usable
labels by one judge for an item the latest holds (on a tie of times the greater record id); an item
without usable label has no consensus unless it was corrected; a correction overrules. Names are compared
in lower case without outer blanks. An empty table gives no rows. Up to ``HELD_JUDGES`` judges their confusion
matrices (32 bytes each) are held by every task; beyond it they are a table that is joined to the labels in every pass,
with the same result.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.versions import latest_version
from ..queries.tables import table
from ..session import durable

BUCKETS = 512
HELD_JUDGES = 500_000
ROUNDS = 90
ITEM = ["bench", "change_col", "candidate"]


def _plain(column: str) -> Column:
    return F.lower(F.regexp_replace(column, r"^[\s\p{Z}]+|[\s\p{Z}]+$", ""))


def usable_labels(records: DataFrame) -> DataFrame:
    """(item, judge, label): one label of each judge for each item."""
    named = records.select(*(_plain(c).alias(c) for c in ITEM), _plain("judge").alias("judge"), F.col("judge_label").alias("label"), "judged_ts", "record_id")
    fit = named.filter(F.col("label").isin(0, 1) & F.col("judge").isNotNull() & F.coalesce(*ITEM).isNotNull())
    return latest_version(fit, [*ITEM, "judge"], "judged_ts", ["record_id"]).select(*ITEM, "judge", "label")


def item_features(buckets: int = BUCKETS) -> Column:
    """Hash buckets of the words of an item's names; the last bucket is the constant."""
    parts = F.concat(
        F.array(F.concat(F.lit("b:"), F.coalesce("bench", F.lit("")))),
        F.transform(F.split(F.coalesce("change_col", F.lit("")), r"[^\p{L}]+"), lambda w: F.concat(F.lit("c:"), w)),
        F.transform(F.split(F.coalesce("candidate", F.lit("")), r"[^\p{L}]+"), lambda w: F.concat(F.lit("t:"), w)),
    )
    hashed = F.transform(parts, lambda w: F.pmod(F.xxhash64(w), F.lit(buckets - 1)).cast("int"))
    return F.array_distinct(F.concat(hashed, F.array(F.lit(buckets - 1))))


class Model:
    """Confusion matrices (judge, truth, label) and weights of the label prior."""

    def __init__(self, n_judges: int, buckets: int):
        self.rates = np.tile(np.array([[0.7, 0.3], [0.3, 0.7]]), (n_judges, 1, 1))
        self.weights = np.zeros(buckets)
        self.converged, self.passes = False, 0

    def flat(self) -> np.ndarray:
        """All parameters, unbounded: logits of the rates and the weights."""
        return np.concatenate([np.log(self.rates[:, :, 1] / self.rates[:, :, 0]).ravel(), self.weights])

    def set(self, flat: np.ndarray) -> None:
        n = 2 * len(self.rates)
        one = 1 / (1 + np.exp(-np.clip(flat[:n], -12, 12))).reshape(-1, 2)
        self.rates, self.weights = np.stack([1 - one, one], axis=2), flat[n:].copy()

    def posterior(self, owner: np.ndarray, judge: np.ndarray, label: np.ndarray, f_owner: np.ndarray, feature: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, float]:
        """Probability of label 1 with and without the judges' labels, and the log likelihood of the labels."""
        score = np.bincount(f_owner, weights=self.weights[feature], minlength=n)
        log = np.log(self.rates)
        one, none = (np.bincount(owner, weights=log[judge, t, label], minlength=n) for t in (1, 0))
        squash = lambda x: 1 / (1 + np.exp(-np.clip(x, -500, 500)))
        # log(p * e^one + (1 - p) * e^none) with p = squash(score)
        likelihood = np.logaddexp(one - np.logaddexp(0, -score), none - np.logaddexp(0, score))
        return squash(score + one - none), squash(score), float(likelihood.sum())

    def sums(self, q: np.ndarray, prior: np.ndarray, owner, judge, label, f_owner, feature) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        counts = np.zeros_like(self.rates)
        np.add.at(counts[:, 1], (judge, label), q[owner])
        np.add.at(counts[:, 0], (judge, label), 1 - q[owner])
        slope = np.bincount(feature, weights=(q - prior)[f_owner], minlength=len(self.weights))
        # the number of features of an item bounds the curvature of the whole by that of each
        width = np.bincount(f_owner, minlength=len(q))
        curve = np.bincount(feature, weights=0.25 * width[f_owner], minlength=len(self.weights))
        return counts, slope, curve

    def penalty(self, ridge: float) -> float:
        """What the priors of the parameters take from the likelihood."""
        smooth = np.array([[2.0, 1.0], [1.0, 2.0]])
        return float(0.5 * ridge * (self.weights[:-1] ** 2).sum() + 0.5e-3 * self.weights[-1] ** 2 - (smooth * np.log(self.rates)).sum())

    def step(self, counts: np.ndarray, slope: np.ndarray, curve: np.ndarray, ridge: float) -> float:
        """The next parameters; returns the largest change."""
        smooth = counts + np.array([[2.0, 1.0], [1.0, 2.0]])
        rates = smooth / smooth.sum(axis=2, keepdims=True)
        pull = np.full(len(self.weights), ridge)
        pull[-1] = 1e-3  # the constant is the share of label 1 and is not shrunk
        weights = self.weights + (slope - pull * self.weights) / (curve + pull)
        change = max(np.abs(rates - self.rates).max(initial=0), np.abs(weights - self.weights).max(initial=0))
        self.rates, self.weights = rates, weights
        return float(change)


def _ragged(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    return pa.compute.list_parent_indices(column).to_numpy().astype(np.int64), pa.compute.list_flatten(column).to_numpy().astype(np.int64)


def _arrays(batch: pa.RecordBatch):
    owner, judge = _ragged(batch.column("judges"))
    _, label = _ragged(batch.column("labels"))
    f_owner, feature = _ragged(batch.column("features"))
    return owner, judge, label, f_owner, feature


def _pass(items: DataFrame, model: Model, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """One pass over (judges, labels, features) rows: label counts of the judges, slope and curvature of the weights, log likelihood."""
    shared = items.sparkSession.sparkContext.broadcast(model)
    n_judges = len(model.rates)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = shared.value
        total = None
        for batch in batches:
            if not batch.num_rows:
                continue
            arrays = _arrays(batch)
            q, prior, likelihood = now.posterior(*arrays, batch.num_rows)
            part = (*now.sums(q, prior, *arrays), np.array([likelihood]))
            total = part if total is None else tuple(a + b for a, b in zip(total, part))
        if total is not None:
            flat = np.concatenate([t.ravel() for t in total])
            used = np.flatnonzero(flat)
            yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(flat[used])], names=["at", "value"])

    sums = items.select("judges", "labels", "features").mapInArrow(run, "at bigint, value double").groupBy("at").agg(F.sum("value").alias("value")).toPandas()
    shared.unpersist()
    flat = np.zeros(4 * n_judges + 2 * buckets + 1)
    flat[sums["at"].to_numpy(dtype=np.int64)] = sums["value"].to_numpy(dtype=float)
    return flat[: 4 * n_judges].reshape(n_judges, 2, 2), flat[4 * n_judges : 4 * n_judges + buckets], flat[4 * n_judges + buckets : -1], float(flat[-1])


def fit(items: DataFrame, n_judges: int, buckets: int = BUCKETS, ridge: float = 20.0, rounds: int = ROUNDS, tolerance: float = 1e-3, extrapolate: bool = True) -> Model:
    """Fit by EM over (judges, labels, features) rows; ``extrapolate=False`` is plain EM."""
    model = Model(n_judges, buckets)
    last, steps = -np.inf, []  # what is reached, and the parameters before each plain step since the last extrapolation
    safe = None
    while model.passes < rounds:
        before = model.flat()
        counts, slope, curve, likelihood = _pass(items, model, buckets)
        model.passes += 1
        reached = likelihood - model.penalty(ridge)
        if safe is not None and reached < last - 1e-9 * abs(last):
            model.set(safe)  # the extrapolated parameters are worse than those they came from
            safe, steps = None, []
            continue
        change = model.step(counts, slope, curve, ridge)
        if change < tolerance and safe is None:
            model.converged = True
            break
        safe, last = None, max(last, reached)
        steps.append(before)
        if extrapolate and len(steps) == 2:
            first, now = steps[1] - steps[0], model.flat() - steps[1]
            bend = np.linalg.norm(now - first)
            if bend > 0:
                length = min(-1.0, -np.linalg.norm(first) / bend)
                safe = model.flat()
                model.set(steps[0] - 2 * length * first + length * length * (now - first))
            steps = []
    if not model.converged:
        warnings.warn(f"the fit still moved after {rounds} passes", stacklevel=2)
    return model


def consensus(records: DataFrame, buckets: int = BUCKETS, ridge: float = 20.0) -> tuple[DataFrame, DataFrame]:
    """(items, judges): consensus of every item with its certainty and agreement; reliability of every judge."""
    spark = records.sparkSession
    records = durable(records, "records")
    labels = durable(usable_labels(records), "labels")
    counted = durable(labels.groupBy("judge").agg(F.count("*").alias("n")), "judges")
    if counted.count() > HELD_JUDGES:
        judged, judges = _joined(labels, counted, buckets, ridge)
        return _reported(records, judged), judges
    names = counted.orderBy("judge").toPandas()
    numbers = spark.createDataFrame([(j, i) for i, j in enumerate(names["judge"])], "judge string, number int")
    numbered = labels.join(F.broadcast(numbers) if len(names) <= 100_000 else numbers, "judge")
    # an item has a handful of labels, one a judge
    items = numbered.groupBy(*ITEM).agg(F.array_sort(F.collect_list(F.struct("number", "label"))).alias("votes"))
    items = durable(items.select(*ITEM, F.col("votes.number").alias("judges"), F.col("votes.label").alias("labels"), item_features(buckets).alias("features")), "items")
    model = fit(items, len(names), buckets, ridge)
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            q, _, _ = shared.value.posterior(*_arrays(batch), batch.num_rows)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ITEM), pa.array(q), batch.column("labels")], names=[*ITEM, "probability", "labels"])

    judged = items.mapInArrow(run, "bench string, change_col string, candidate string, probability double, labels array<int>")
    right = model.rates[:, 1, 1], model.rates[:, 0, 0]
    rows = [(str(j), int(k), float(s), float(t), float((s + t) / 2)) for j, k, s, t in zip(names["judge"], names["n"], *right)]
    judges = spark.createDataFrame(rows, "judge string, n_labels bigint, right_on_1 double, right_on_0 double, reliability double")
    return _reported(records, judged), judges


def _reported(records: DataFrame, judged: DataFrame) -> DataFrame:
    """Every item with author, correction, consensus, its probability and the agreement of its labels."""
    own = records.select(*(_plain(c).alias(c) for c in ITEM), F.when(F.col("author").isin(0, 1), F.col("author")).alias("author"), F.when(F.col("corrected_author").isin(0, 1), F.col("corrected_author")).alias("corrected"))
    own = own.filter(F.coalesce(*ITEM).isNotNull()).groupBy(*ITEM).agg(F.max("author").alias("author"), F.max("corrected").alias("corrected"))
    a, b = own.alias("a"), judged.alias("b")
    same = F.lit(True)
    for c in ITEM:
        same = same & F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    joined = a.join(b, same, "left").select(*(F.col(f"a.{c}").alias(c) for c in ITEM), "author", "corrected", "probability", "labels")
    voted = F.when(F.col("probability").isNotNull(), (F.col("probability") >= 0.5).cast("int"))
    label = F.coalesce("corrected", voted)
    n = F.coalesce(F.size("labels"), F.lit(0))
    with_label = joined.withColumn("consensus", label).withColumn("n_labels", n)
    agree = F.aggregate("labels", F.lit(0), lambda s, x: s + (x == F.col("consensus")).cast("int"))
    ones = F.aggregate("labels", F.lit(0), lambda s, x: s + x)
    pairs = F.when(n > 1, (ones * (ones - 1) + (n - ones) * (n - ones - 1)) / (n * (n - 1)))
    whole = with_label.select(*ITEM, "author", "corrected", "consensus", F.round("probability", 6).alias("probability"), "n_labels", F.when(n > 0, agree / n).alias("agreement"), pairs.alias("pair_agreement"))
    return whole


def _joined(labels: DataFrame, counted: DataFrame, buckets: int, ridge: float, rounds: int = ROUNDS, tolerance: float = 1e-3) -> tuple[DataFrame, DataFrame]:
    """The same model where judges are too many to hold: (judged items, judges); plain EM with the rates as a table."""
    shrink = np.full(buckets, ridge)
    shrink[-1] = 1e-3
    named = labels.withColumn("item", F.sha2(F.concat_ws("\u0001", *(F.coalesce(c, F.lit("\u0002")) for c in ITEM)), 256))
    items = durable(named.groupBy("item").agg(*(F.first(c).alias(c) for c in ITEM)).withColumn("features", item_features(buckets)), "items")
    votes = durable(named.select("item", "judge", "label"), "votes")
    rates = counted.select("judge", F.lit(0.7).alias("r1"), F.lit(0.7).alias("r0"))  # right on 1, right on 0
    weights = np.zeros(buckets)
    for _ in range(rounds):
        one = F.log(F.when(F.col("label") == 1, F.col("r1")).otherwise(1 - F.col("r1")))
        none = F.log(F.when(F.col("label") == 1, 1 - F.col("r0")).otherwise(F.col("r0")))
        odds = votes.join(rates, "judge").groupBy("item").agg(F.sum(one - none).alias("odds"))
        table_ = F.array(*[F.lit(float(w)) for w in weights])
        score = F.aggregate("features", F.lit(0.0), lambda s, f: s + F.element_at(table_, f + 1))
        q = durable(items.join(odds, "item").withColumn("score", score).select("item", *ITEM, "features", "odds", "score", (1 / (1 + F.exp(-(F.col("score") + F.col("odds"))))).alias("q"), (1 / (1 + F.exp(-F.col("score")))).alias("prior")), "posterior")
        width = F.size("features")
        sums = q.select(F.explode("features").alias("f"), (F.col("q") - F.col("prior")).alias("slope"), (0.25 * width).alias("curve")).groupBy("f").agg(F.sum("slope"), F.sum("curve")).toPandas().to_numpy()  # one row a bucket
        slope, curve = np.zeros(buckets), np.zeros(buckets)
        slope[sums[:, 0].astype(int)], curve[sums[:, 0].astype(int)] = sums[:, 1], sums[:, 2]
        fresh = weights + (slope - shrink * weights) / (curve + shrink)
        on = lambda label, of: F.sum(F.when(F.col("label") == label, of).otherwise(0.0))
        c = votes.join(q.select("item", "q"), "item").groupBy("judge").agg(on(1, F.col("q")).alias("c11"), on(0, F.col("q")).alias("c10"), on(1, 1 - F.col("q")).alias("c01"), on(0, 1 - F.col("q")).alias("c00"))
        moved = durable(c.join(rates, "judge").select("judge", ((F.col("c11") + 2) / (F.col("c11") + F.col("c10") + 3)).alias("r1"), ((F.col("c00") + 2) / (F.col("c00") + F.col("c01") + 3)).alias("r0"), F.col("r1").alias("o1"), F.col("r0").alias("o0")), "rates")
        change = max(float(np.abs(fresh - weights).max()), *moved.agg(F.max(F.abs(F.col("r1") - F.col("o1"))), F.max(F.abs(F.col("r0") - F.col("o0")))).first())
        weights, rates = fresh, moved.select("judge", "r1", "r0")
        if change < tolerance:
            break
    else:
        warnings.warn(f"the fit still moved after {rounds} passes", stacklevel=2)
    given = votes.groupBy("item").agg(F.array_sort(F.collect_list("label")).alias("labels"))
    judged = q.join(given, "item").select(*ITEM, F.col("q").alias("probability"), "labels")
    judges = counted.join(rates, "judge").select("judge", F.col("n").alias("n_labels"), F.col("r1").alias("right_on_1"), F.col("r0").alias("right_on_0"), ((F.col("r1") + F.col("r0")) / 2).alias("reliability"))
    return judged, judges


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latest_version(table(spark, sf_dir, "judge_records").select("record_id", "judge", *ITEM, "author", "judge_label", "corrected_author", "judged_ts", "ingested_ts"), "record_id")


def p2_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return consensus(_records(spark, sf_dir))[0]


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return consensus(_records(spark, sf_dir))[0].filter("consensus <> author").select(*ITEM)


def p2_judges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return consensus(_records(spark, sf_dir))[1]


def p2_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per bench: observed agreement of two labels of an item, that expected by chance, and alpha (1 = full agreement)."""
    labels = usable_labels(_records(spark, sf_dir))
    items = labels.groupBy(*ITEM).agg(F.count("*").alias("n"), F.sum("label").alias("ones")).filter("n > 1")
    disagree = 2.0 * F.col("ones") * (F.col("n") - F.col("ones")) / (F.col("n") - 1)
    sums = items.groupBy("bench").agg(F.count("*").alias("items"), F.sum("n").alias("labels"), F.sum("ones").alias("ones"), F.sum(disagree).alias("observed"))
    observed = F.col("observed") / F.col("labels")
    expected = 2.0 * F.col("ones") * (F.col("labels") - F.col("ones")) / (F.col("labels") * (F.col("labels") - 1))
    return sums.select("bench", "items", "labels", F.round(1 - observed, 6).alias("agreement"), F.when(expected > 0, F.round(1 - observed / expected, 6)).otherwise(1.0).alias("alpha"))


SQL = {
    "p2_agreement": r"""
WITH held AS (SELECT * FROM judge_records QUALIFY row_number() OVER (PARTITION BY record_id ORDER BY ingested_ts DESC NULLS LAST) = 1),
l AS (
  SELECT lower(trim(bench)) AS bench, lower(trim(change_col)) AS cc, lower(trim(candidate)) AS ca, lower(trim(judge)) AS judge, judge_label AS label FROM held
  WHERE judge_label IN (0, 1) QUALIFY row_number() OVER (PARTITION BY lower(trim(bench)), lower(trim(change_col)), lower(trim(candidate)), lower(trim(judge)) ORDER BY judged_ts DESC NULLS LAST, record_id DESC) = 1
), i AS (SELECT bench, count(*) AS n, CAST(sum(label) AS BIGINT) AS ones FROM l GROUP BY bench, cc, ca HAVING count(*) > 1),
s AS (SELECT bench, count(*) AS items, CAST(sum(n) AS BIGINT) AS labels, CAST(sum(ones) AS BIGINT) AS ones, sum(2.0 * ones * (n - ones) / CAST(n - 1 AS DOUBLE)) AS observed FROM i GROUP BY bench)
SELECT bench, items, labels, round(1 - observed / labels, 6) AS agreement,
  CASE WHEN ones > 0 AND ones < labels THEN round(1 - (observed / labels) / (CAST(2.0 AS DOUBLE) * ones * (labels - ones) / (CAST(labels AS DOUBLE) * (labels - 1))), 6) ELSE 1.0 END AS alpha
FROM s
""",
}
QUERIES = {"p2_found": p2_found, "p2_consensus": p2_consensus, "p2_judges": p2_judges, "p2_agreement": p2_agreement}
