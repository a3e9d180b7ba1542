import random
import re
from itertools import combinations

import numpy as np
from conftest import rows

from tributary.llm.fingerprints import winnow
from tributary.llm.overlap import TILE, Overlap, least_common, rarest, split_roles, tiles
from tributary.llm.spans import FingerprintIndex, document_pairs, links, shared_pairs, shared_spans, text_classes, verified


def corpus(seed=3, n=40):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdefgh ") for _ in range(rnd.randint(2, 9)))
    passages = ["".join(word() for _ in range(60)) for _ in range(5)]
    texts = []
    for i in range(n):
        text = "".join(word() for _ in range(rnd.randint(0, 80)))
        if rnd.random() < 0.6:
            p = rnd.choice(passages)
            size = rnd.choice([150, 199, 200, 201, 260])
            begin = rnd.randint(0, max(0, len(p) - size))
            text += p[begin : begin + size] + word() + "é𝄞"
        texts.append(text)
    return [*enumerate(texts), (100, None), (101, ""), (102, "x" * 500), (103, "x" * 450), (105, texts[0]), (106, passages[0] * 2), (107, passages[0] * 2), (108, passages[0] + "#" + passages[1] + "!" + passages[0]), (109, passages[0] + "*" + passages[1] + "?" + passages[0]), (None, passages[0]), (104, texts[0] + "tail")]


def brute(docs, span=200):
    where = {}
    for i, t in docs:
        if i is not None and t:
            for p in range(len(t) - span + 1):
                where.setdefault(t[p : p + span], {}).setdefault(i, []).append(p)
    pairs, marks = set(), {}
    for held in where.values():
        if len(held) > 1:
            pairs |= set(combinations(sorted(held), 2))
            for i, places in held.items():
                marks.setdefault(i, set()).update(q + k for q in places for k in range(span))
    return pairs, {i: len(m) for i, m in marks.items()}


def test_pairs_and_spans(spark):
    docs = corpus()
    df = spark.createDataFrame(docs, "doc_id long, text string")
    pairs, marks = brute(docs)
    assert len(pairs) > 5
    classes = text_classes(df)
    stretches = shared_pairs(df, classes, batches=4, fanout=2)
    got = [tuple(r) for r in document_pairs(stretches, classes).collect()]
    assert len(got) == len(set(got)) and set(got) == pairs
    assert {r.doc_id: r.n_links for r in links(stretches, classes).collect() if r.n_links} == {i: sum(i in p for p in pairs) for i in {x for p in pairs for x in p}}
    text = dict(docs)
    for r in stretches.collect():
        a, b = text[r.doc_id_a], text[r.doc_id_b]
        assert r.length >= 200 and a[r.start_a : r.start_a + r.length] == b[r.start_b : r.start_b + r.length]
        for x, y in ((r.start_a - 1, r.start_b - 1), (r.start_a + r.length, r.start_b + r.length)):
            assert min(x, y) < 0 or x >= len(a) or y >= len(b) or a[x] != b[y]
    sums = {}
    for r in shared_spans(df).collect():
        sums[r.doc_id] = sums.get(r.doc_id, 0) + r.length
    assert sums == marks
    assert shared_pairs(df.limit(0), text_classes(df.limit(0))).count() == 0 and shared_spans(df.limit(0)).count() == 0


def test_index_compacts(spark):
    docs = [(i, f"{i} " * 30 + "".join(chr(97 + (k * k) % 26) for k in range(300))) for i in range(6)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    index = FingerprintIndex(spark, fanout=2, buckets=2)
    found = [index.add(df.filter(f"doc_id = {i}")) for i in range(6)]
    assert len(index.runs) <= 2
    whole = found[0]
    for f in found[1:]:
        whole = whole.unionByName(f)
    assert verified(whole, df).select("doc_id_a", "doc_id_b").distinct().count() == 15
    index.drop()


def test_winnow_guarantee():
    rnd = random.Random(1)
    core = "".join(rnd.choice("abc") for _ in range(200))
    for cut in (1 << 20, 300):
        from tributary.llm import fingerprints

        fingerprints.PIECE = cut
        row, pos, h = winnow(["zz" * 90 + core + "q" * 250, core, "y" * 120 + core], 200, 100)
        common = set(h[row == 0]) & set(h[row == 1]) & set(h[row == 2])
        assert common and len(np.unique(row)) == 3
    fingerprints.PIECE = 1 << 20


def test_overlap_is_exact(spark):
    rnd = random.Random(5)
    vocabulary = [f"w{i}" for i in range(60)]
    base = [rnd.sample(vocabulary, rnd.randint(3, 15)) for _ in range(25)]
    data = []
    for i in range(120):
        words = list(rnd.choice(base))
        for _ in range(rnd.randint(0, 4)):
            words[rnd.randrange(len(words))] = rnd.choice(vocabulary)
        rnd.shuffle(words)
        data.append((i, rnd.choice(["train", "test", "heldout", "other"]), " ".join(words) + rnd.choice([".", " ?", "  !"])))
    data += [(200, "train", None), (201, "test", ""), (202, "test", "..."), (203, "train", "same same SAME"), (204, "test", "Same")]
    data += [(210 + i, "train", "the long text says " + " ".join(base[i]) + " and goes on") for i in range(8)] + [(220 + i, "test", " ".join(base[i])) for i in range(8)]
    df = spark.createDataFrame(data, "question_key long, role string, question string").selectExpr("*", "1 as side", "'x' as running")
    sets = {i: (r, set(re.findall(r"\w+", (t or "").lower()))) for i, r, t in data}
    want = {(a, b) for a, (ra, x) in sets.items() for b, (rb, y) in sets.items() if ra == "train" and rb in ("test", "heldout") and x and y and 10 * len(x & y) >= 7 * len(x | y)}
    running = {i: re.findall(r"\w+", (t or "").lower()) for i, r, t in data}
    train = [f" {' '.join(w)} " for i, w in running.items() if sets[i][0] == "train" and w]
    covered = {}
    for i, words in running.items():
        if sets[i][0] in ("test", "heldout"):
            marks = set()
            for a, b in tiles(words):
                if any(f" {' '.join(words[a:b])} " in t for t in train):
                    marks |= set(range(a, b))
            covered[i] = len(marks)
    for sizes in ({}, {"shard_characters": 700, "block_characters": 400}):
        overlap = Overlap(df, **sizes)
        got = overlap.pairs().select("train_key", "eval_key").collect()
        assert len(got) == len(set(got)) and {tuple(r) for r in got} == want and (203, 204) in want
        whole = {r.question_key: r for r in overlap.evaluated().collect()}
        assert {i: r.covered for i, r in whole.items()} == covered and max(covered.values()) > TILE
        assert {i: r.partners for i, r in whole.items()} == {i: sum(b == i for _, b in want) for i in covered}
        assert all(whole[220 + i].covered == whole[220 + i].n_words for i in range(8))
    empty = Overlap(df.limit(0))
    assert empty.pairs().count() == 0 and empty.evaluated().count() == 0


def test_rarest_words_lose_no_pair():
    """Sets that share 0.7 have enough of the rarest words of one in the other, for every way to place what differs."""
    rnd = random.Random(8)
    for _ in range(20_000):
        common, other = rnd.randint(1, 14), rnd.randint(0, 6)
        if 10 * common < 7 * (common + other):
            continue
        owner = [2] * common + [rnd.randint(0, 1) for _ in range(other)]
        rnd.shuffle(owner)
        a, b = ([i for i, o in enumerate(owner) if o in (side, 2)] for side in (0, 1))
        first = [s[: rarest(len(s), 0.7)] for s in (a, b)]
        assert set(first[0]) & set(first[1])
        assert len(set(first[0]) & set(b)) >= len(first[0]) - (len(a) - least_common(len(a), len(b), 0.7))


def test_tiles():
    assert [tiles(["w"] * n) for n in (0, 2, 5, 7, 10)] == [[], [(0, 2)], [(0, 5)], [(0, 5), (2, 7)], [(0, 5), (5, 10)]]


def test_roles(spark):
    from datetime import datetime

    df = spark.createDataFrame([("a", " Train ", datetime(2024, 1, 1)), ("a", "TEST", datetime(2024, 2, 1)), (None, "x", datetime(2024, 1, 1))], "split_file string, split_role string, sealed_at timestamp")
    assert rows(split_roles(df)) == [("a", "test")]
