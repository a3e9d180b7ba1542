from datetime import datetime

import pytest
from conftest import rows
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tributary.operators.hierarchy import cycles, descendants, hierarchy
from tributary.operators.versions import latest_version

LINK = "graph_id string, source string, target string, extra int"


def test_latest_version(spark):
    t = [datetime(2024, 1, d) for d in (1, 2)]
    df = spark.createDataFrame([("a", t[0], 1), ("a", t[1], 2), ("b", None, 3), ("b", t[0], 4), (None, t[0], 5), (None, t[1], 6)], "k string, ingested_ts timestamp, v int")
    assert rows(latest_version(df, "k").select("v")) == [(2,), (4,), (5,), (6,)]
    assert latest_version(df.limit(0), "k").count() == 0


def brute(links):
    """Node to (root, depth, on_cycle) by following the smallest parent."""
    parent, nodes = {}, set()
    for g, s, t in links:
        nodes |= {(g, x) for x in (s, t) if x is not None}
        if s is not None and t is not None:
            parent[g, t] = min(parent.get((g, t), (g, s)), (g, s))
    out = {}
    for node in nodes:
        path, x = [], node
        while x not in path and x in parent:
            path.append(x)
            x = parent[x]
        if x in path:
            ring = path[path.index(x) :]
            out[node] = (min(ring)[1], path.index(x), node in ring)
        else:
            out[node] = (x[1], len(path), False)
    return out


@pytest.mark.parametrize("group_rows", [500_000, 0])
def test_hierarchy_cases(spark, group_rows):
    links = [("g", "a", "b"), ("g", "b", "c"), ("g", "a", "b"), ("g", None, "lone"), ("g", "x", "y"), ("g", "y", "x"), ("g", "y", "z"), ("g", "s", "s"), ("h", "a", "q"), ("g", "c", ""), (None, "n", "m"), ("g", "b", "two"), ("g", "a", "two")]
    df = spark.createDataFrame([(*x, 1) for x in links], LINK)
    got = hierarchy(df, group_rows=group_rows).collect()
    want = brute([x for x in links if x[0]])
    assert {(r.graph_id, r.node_id): (r.root_id, r.depth, r.on_cycle) for r in got} == want
    by = {(r.graph_id, r.node_id): r for r in got}
    assert by["g", "c"].path == "a > b > c" and by["g", "a"].n_descendants == 4 and by["g", "z"].below_cycle
    assert by["g", "x"].n_descendants == 2 and by["g", "two"].parent_id == "a"
    pairs = {(r.graph_id, r.ancestor_id, r.descendant_id): r.distance for r in descendants(df, group_rows=group_rows).collect()}
    assert pairs["g", "a", "c"] == 2 and pairs["g", "x", "z"] == 2 and ("g", "s", "s") not in pairs and pairs["g", "x", "y"] == 1
    assert {(r.cycle_id, r.length, r.n_below) for r in cycles(hierarchy(df, group_rows=group_rows, details=False)).collect()} == {("x", 2, 1), ("s", 1, 0)}


def test_hierarchy_empty(spark):
    empty = spark.createDataFrame([], LINK)
    assert hierarchy(empty).count() == 0 and descendants(empty).count() == 0


def test_deep_chain_and_hot_group(spark):
    links = [("g", f"n{i:04}", f"n{i + 1:04}", 0) for i in range(11)] + [("g", "n0000", f"leaf{i}", 0) for i in range(200)]
    df = spark.createDataFrame(links, LINK)
    near, far = (hierarchy(df, group_rows=n).select("node_id", "root_id", "depth", "path", "n_descendants") for n in (10_000, 10))
    assert rows(near) == rows(far)
    assert near.filter("node_id = 'n0011'").first().depth == 11


def test_cycle_paths_in_both_forms(spark):
    ring = [f"r{i}" for i in (3, 0, 4, 1, 2)]
    links = [("g", a, b, 0) for a, b in zip(ring, ring[1:] + ring[:1])] + [("g", "r4", "low", 0), ("g", "low", "leaf", 0), ("g", "s", "s", 0), ("g", "s", "t", 0), ("g", "a", "b", 0), ("h", "y", "x", 0), ("h", "x", "y", 0)]
    df = spark.createDataFrame(links, LINK)
    near, far = (hierarchy(df, group_rows=n) for n in (10_000, 0))
    assert rows(near.select("graph_id", "node_id", "parent_id", "root_id", "path")) == rows(far.select("graph_id", "node_id", "parent_id", "root_id", "path"))
    assert rows(near.select("node_id", "depth", "on_cycle", "below_cycle", "n_descendants")) == rows(far.select("node_id", "depth", "on_cycle", "below_cycle", "n_descendants"))
    path = {r.node_id: r.path for r in far.collect()}
    assert path["r3"] == "r0 > r4 > r1 > r2 > r3" and path["leaf"] == "r0 > r4 > low > leaf" and path["t"] == "s > t"
    assert {r.path for r in hierarchy(df, group_rows=0, details=False).collect()} == {None}


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.sampled_from("gh"), st.sampled_from([*"abcdef", None]), st.sampled_from([*"abcdef", None])), min_size=1, max_size=14))
def test_hierarchy_random(spark, links):
    df = spark.createDataFrame([(*x, 1) for x in links], LINK)
    got = {(r.graph_id, r.node_id): (r.root_id, r.depth, r.on_cycle) for r in hierarchy(df).collect()}
    assert got == brute(links)


def test_forms_agree_on_random_graphs(spark):
    """All columns of both forms, over many random graphs with cycles, repeated links and nulls."""
    import random

    rnd = random.Random(12)
    links = []
    for g in range(60):
        names = [f"n{i}" for i in range(rnd.randint(1, 9))]
        links += [(f"g{g}", rnd.choice([*names, None]), rnd.choice(names), 0) for _ in range(rnd.randint(1, 12))]
    df = spark.createDataFrame(links, LINK)
    near, far = (hierarchy(df, group_rows=n) for n in (10_000, 0))
    assert sorted(map(str, near.collect())) == sorted(map(str, far.select(*near.columns).collect())) and near.filter("on_cycle").count() > 20
    assert rows(descendants(df)) == rows(descendants(df, group_rows=0))
