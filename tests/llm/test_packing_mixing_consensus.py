import functools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tributary.llm.consensus import ITEM, consensus
from tributary.llm.mixing import mixture, planned, reached
from tributary.llm.packing import fill, packed, patterns, slots
from tributary.llm.tokens import VOCABULARY, count, encoder, with_token_counts


def test_tokens(spark):
    texts = ["", None, "join the tables", "ünï 漢字 `a_b`\n\n  x", "word " * 60_000]
    held = open(VOCABULARY, "rb").read()
    encode = encoder(held).encode_ordinary
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "7 as n_tokens")
    got = {r.doc_id: r.n_tokens for r in with_token_counts(df).collect()}
    assert got == {i: len(encode(t)) if t else 0 for i, t in enumerate(texts)} and count(encode, texts[4]) == len(encode(texts[4]))
    assert with_token_counts(df.limit(0)).count() == 0


def test_patterns_use_up_the_histogram():
    rnd = np.random.default_rng(2)
    for capacity, n in ((64, 3000), (256, 500), (16, 10)):
        histogram = np.bincount(rnd.integers(1, capacity + 1, n), minlength=capacity + 1)
        found = patterns(histogram, capacity)
        used = np.zeros_like(histogram)
        for need, times in found:
            assert sum(s * m for s, m in need.items()) <= capacity and times > 0
            for s, m in need.items():
                used[s] += m * times
        assert (used == histogram).all()
        containers = sum(t for _, t in found)
        assert containers <= 1.02 * np.ceil((histogram * np.arange(capacity + 1)).sum() / capacity) + 1 or n < 100
    assert patterns(np.zeros(9, dtype=int), 8) == [] and slots([], 8) == {}


def test_packed(spark):
    rnd = random.Random(4)
    sizes = [(i, rnd.choice([3, 3, 3, 70, 99, 100, 101, 250, rnd.randint(1, 120)])) for i in range(400)] + [(900, 0), (901, 1000), (None, 5), (7, 9)]
    df = spark.createDataFrame(sizes, "doc_id long, n_tokens int").selectExpr("*", "1 as salt", "2 as rank")
    got = packed(df, capacity=100).toPandas()
    assert got.groupby("container_id").n_tokens.sum().max() <= 100
    assert got.n_tokens.sum() == sum(s for _, s in sizes)
    for doc, part in got[got.doc_id.isin([901])].groupby("doc_id"):
        assert sorted(part.first_token) == list(range(0, 1000, 100))
    assert got[got.doc_id == 900].n_tokens.tolist() == [0]
    assert (got.groupby("doc_id").size() == 1)[[d for d, s in sizes if d is not None and d != 7 and s <= 100]].all()
    f = fill(packed(df, capacity=100), 100).toPandas()
    assert len(f) <= 1.05 * np.ceil(f.used.sum() / 100) and packed(df.limit(0), 100).count() == 0


def test_mixture(spark):
    rnd = random.Random(6)
    sizes = [(i, s, rnd.randint(1, 60)) for i, s in enumerate(rnd.choices(["big", "mid", "tiny", None, "unlisted"], [60, 25, 5, 5, 5], k=1500))] + [(5000, "mid", 0)]
    df = spark.createDataFrame(sizes, "doc_id long, source string, n_tokens int").selectExpr("*", "1 as available", "'x' as slope")
    targets = spark.createDataFrame([("BIG ", 0.3, 2), ("mid", 0.4, 3), ("tiny", 0.2, 2), ("absent", 0.1, 4), (None, 0.0, 1)], "source string, target_share double, max_repeats int")
    plan = planned(df.select("doc_id", "source", "n_tokens"), targets)
    drawn = mixture(df, plan).toPandas()
    assert drawn.position.is_monotonic_increasing and drawn.position.between(0, 1).all()
    assert set(drawn.source) == {"big", "mid", "tiny"} and 5000 not in set(drawn.doc_id)
    report = {r.source: r for r in reached(mixture(df, plan), plan).collect()}
    for name, cap in (("big", 2), ("mid", 3), ("tiny", 2)):
        assert drawn[drawn.source == name].groupby("doc_id").size().max() <= cap
    for name in ("big", "mid"):
        assert abs(report[name].drawn - report[name].wanted) <= 60
    assert report["tiny"].drawn == 2 * report["tiny"].available and report["absent"].drawn == 0
    # over any part of training a source's tokens follow its schedule: half of time gives half within the slope
    early = drawn[drawn.position < 0.5].groupby("source").n_tokens.sum() / drawn.groupby("source").n_tokens.sum()
    assert early["tiny"] < early["big"]
    assert mixture(df.limit(0), planned(df.limit(0).select("doc_id", "source", "n_tokens"), targets)).count() == 0


def test_schedules(spark):
    sizes = spark.createDataFrame([(i, s, 10) for i in range(2000) for s in ("a", "b")], "doc_id long, source string, n_tokens int").withColumn("doc_id", F.xxhash64("doc_id", "source"))
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.5, 1)], "source string, target_share double, max_repeats int")
    plan = planned(sizes, targets)
    drawn = mixture(sizes, plan, schedules={"a": [(0.0, 0.0), (0.5, 0.0), (0.5001, 1.0), (1.0, 1.0)]}).toPandas()
    late = drawn[drawn.source == "a"]
    assert late.position.min() > 0.48 and abs(late.n_tokens.sum() - 10_000) <= 10 and abs((late.position < 0.75).mean() - 0.5) < 0.02
    even = drawn[drawn.source == "b"]
    assert abs((even.position < 0.5).mean() - 0.5) < 0.1
    one, two = (mixture(sizes, plan, schedules=x).toPandas().sort_values("doc_id").position.to_numpy() for x in (None, {"none": [(0, 1)]}))
    assert np.abs(one - two).max() < 1e-3
    with pytest.raises(ValueError):
        mixture(sizes, plan, schedules={"a": [(0, 0)]})


def test_hot_sizes_are_split(spark, monkeypatch):
    from tributary.llm import packing

    monkeypatch.setattr(packing, "ROWS_A_SALT", 3)
    df = spark.createDataFrame([(i, 40 if i % 3 else 20) for i in range(300)], "doc_id long, n_tokens int")
    got = packed(df, capacity=100).toPandas()
    assert len(got) == 300 and got.groupby("container_id").n_tokens.sum().max() <= 100 and got.container_id.nunique() == 100


RECORD = "record_id long, judge string, bench string, change_col string, candidate string, author int, judge_label int, corrected_author int, judged_ts timestamp, extra string"


def votes(n_items=300, seed=9):
    from datetime import datetime, timedelta

    rnd = random.Random(seed)
    skill = {"good": 0.97, "fair": 0.85, "also": 0.9, "noise": 0.5, "liar": 0.1, "ok": 0.88}
    data, truth, n = [], {}, 0
    for item in range(n_items):
        truth[f"c{item}"] = t = int(rnd.random() < 0.35)
        for judge in rnd.sample(list(skill), 5):
            n += 1
            label = t if rnd.random() < skill[judge] else 1 - t
            data.append((n, rnd.choice([judge, judge.upper(), f" {judge}"]), "B", "x.y", f"C{item} ", 1 - t if item % 10 == 0 else t, label, None, datetime(2024, 1, 1) + timedelta(hours=n), ""))
    data += [(9001, "good", "b", "x.y", "c0", None, 9, None, datetime(2025, 1, 1), ""), (9002, None, "b", "x.y", "c0", None, 1, None, datetime(2025, 1, 1), ""), (9003, "good", "b", "x.y", "fixed", 0, 0, 1, datetime(2024, 1, 1), ""), (9004, "fair", "b", "x.y", "silent", 1, None, None, datetime(2024, 1, 1), "")]
    return skill, truth, data


def test_consensus_recovers_truth(spark):
    skill, truth, data = votes()
    items, judges = consensus(spark.createDataFrame(data, RECORD))
    got = {r.candidate: r for r in items.collect()}
    assert sum(got[c].consensus == t for c, t in truth.items()) >= 290
    assert got["fixed"].consensus == 1 and got["silent"].consensus is None and 0 <= got["c1"].agreement <= 1
    by = {r.judge: r.reliability for r in judges.collect()}
    assert set(by) == set(skill) and by["good"] > 0.9 and by["liar"] < 0.25 and abs(by["noise"] - 0.5) < 0.15
    assert ITEM == ["bench", "change_col", "candidate"]


@pytest.mark.filterwarnings("ignore:the fit still moved")
def test_forms_of_the_fit_agree(spark, monkeypatch):
    """Extrapolated and plain fits end at the same parameters; the joined form takes the same steps as the plain one."""
    from tributary.llm import consensus as module

    _, _, data = votes(80, 3)
    df = spark.createDataFrame(data, RECORD).coalesce(1)
    fits, plain, joined = [], module.fit, module._joined

    def judges(held=None, **extra):
        monkeypatch.setattr(module, "fit", lambda *a, **k: fits.append(plain(*a, **{**k, **extra})) or fits[-1])
        monkeypatch.setattr(module, "_joined", functools.partial(joined, **extra))
        monkeypatch.setattr(module, "HELD_JUDGES", 500_000 if held is None else held)
        items, found = consensus(df)
        return sorted(map(tuple, found.collect())), items

    fast, slow = judges(tolerance=1e-4, rounds=200)[0], judges(tolerance=1e-4, rounds=200, extrapolate=False)[0]
    assert fits[0].converged and fits[1].converged and fits[0].passes < fits[1].passes
    few = judges(tolerance=0, rounds=5, extrapolate=False)[0]
    table, items = judges(held=0, tolerance=0, rounds=5)
    for one, other, near in ((fast, slow, 0.02), (few, table, 1e-6)):
        for a, b in zip(one, other):
            assert a[:2] == b[:2] and a[2:] == pytest.approx(b[2:], abs=near)
    assert items.filter("consensus is not null").count() == 82 - 1


@pytest.mark.parametrize("n", [0])
def test_consensus_empty(spark, n):
    items, judges = consensus(spark.createDataFrame([], RECORD))
    assert items.count() == n and judges.count() == n
