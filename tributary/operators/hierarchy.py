"""Parent-child links to full hierarchies.

Every link names a parent and a child inside a group. Level-wise frontier joins start at the nodes
without parent and extend root, depth and path by one level a step; nodes that no frontier reaches
lie on a cycle or below one.

Two physical forms of the same frontier join give the same rows:

* groups up to ``group_rows`` links are sent to one task each (many to a task) and walked level by
  level over integer node numbers in Arrow and NumPy arrays;
* larger groups are walked with distributed joins, several levels to a job, so that no task ever
  holds a whole group.

Defined results: a null id makes no node (an empty one does); a node named by several parents hangs on the one
with the smallest id (byte order), repeated links count once; a node on a cycle has depth 0 and the
smallest id of its cycle as root, nodes below a cycle count their depth from it. An empty table gives
no rows. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import durable, partitions

NODE_SCHEMA = "graph_id string, node_id string, parent_id string, root_id string, depth int, on_cycle boolean, below_cycle boolean, n_descendants bigint, path string"
PAIR_SCHEMA = "graph_id string, ancestor_id string, descendant_id string, distance int"
CHUNK_ROWS = 400_000
GROUP_ROWS = 500_000
SEPARATOR = " > "


class _Forest:
    """Integer form of the links of some whole groups."""

    def __init__(self, table: pa.Table):
        group = table.column("graph_id").combine_chunks()
        sep = "\x00"
        parent, child = (pc.binary_join_element_wise(group, table.column(c).combine_chunks(), sep) for c in ("parent", "child"))
        both = pa.chunked_array([parent, child]).combine_chunks()
        coded = both.drop_null().unique()
        order = pc.sort_indices(coded)
        self.keys = coded.take(order)  # in byte order: the number of a node is its rank
        spot = pc.index_in(both, self.keys)
        n = len(parent)
        numbers = pc.fill_null(spot, -1).to_numpy(zero_copy_only=False).astype(np.int64)
        up, down = numbers[:n], numbers[n:]
        self.n = len(self.keys)
        linked = (up >= 0) & (down >= 0)
        self.parent = np.full(self.n, self.n, dtype=np.int64)
        np.minimum.at(self.parent, down[linked], up[linked])
        self.parent[self.parent == self.n] = -1

    def walk(self) -> None:
        """Depth and root of every node, level by level from the roots."""
        n, parent = self.n, self.parent
        order = np.argsort(parent, kind="stable")
        starts = np.searchsorted(parent[order], np.arange(n + 1))
        self.root, self.depth = np.full(n, -1, dtype=np.int64), np.full(n, -1, dtype=np.int32)
        self.levels: list[np.ndarray] = []
        self.cyclic = np.zeros(n, dtype=bool)
        roots = np.flatnonzero(parent < 0)
        self.root[roots] = roots
        self._descend(roots, order, starts)
        rest = np.flatnonzero(self.depth < 0)
        self.below = np.zeros(n, dtype=bool)
        if len(rest):
            jump = np.where(parent < 0, np.arange(n), parent)
            least = np.arange(n)
            step = 1
            while step <= len(rest):
                least[rest] = np.minimum(least[rest], least[jump[rest]])
                jump[rest] = jump[jump[rest]]
                step *= 2
            on = np.unique(jump[rest])  # a cycle maps onto itself, so these are all nodes on cycles
            ring = np.zeros(n, dtype=bool)
            ring[on] = True
            self.cyclic = ring
            self.root[on] = least[on]
            self._descend(on, order, starts)
            self.below[rest] = ~ring[rest]

    def _descend(self, frontier: np.ndarray, order: np.ndarray, starts: np.ndarray) -> None:
        self.depth[frontier] = 0
        level = 0
        while len(frontier):
            self.levels.append(frontier)
            lo, counts = starts[frontier], starts[frontier + 1] - starts[frontier]
            total = int(counts.sum())
            if not total:
                break
            at = np.repeat(lo - np.concatenate(([0], np.cumsum(counts)[:-1])), counts) + np.arange(total)
            reached, origin = order[at], np.repeat(frontier, counts)
            fresh = self.depth[reached] < 0
            reached, origin = reached[fresh], origin[fresh]
            level += 1
            self.depth[reached] = level
            self.root[reached] = self.root[origin]
            frontier = reached

    def split(self) -> tuple[list[str], list[str]]:
        pairs = [k.split("\x00", 1) for k in self.keys.to_pylist()]
        return [p[0] for p in pairs], [p[1] for p in pairs]

    def cycle_length(self) -> np.ndarray:
        """Length of the cycle on which or below which a node lies, else 0."""
        sizes = np.bincount(self.root[self.cyclic], minlength=self.n) if self.n else np.zeros(0, dtype=np.int64)
        return np.where(self.cyclic | self.below, sizes[self.root], 0)

    def descendants(self) -> np.ndarray:
        count = np.zeros(self.n, dtype=np.int64)
        tree = self.parent >= 0
        for level in reversed(self.levels):
            moving = level[tree[level] & ~self.cyclic[level]]
            np.add.at(count, self.parent[moving], count[moving] + 1)
        if self.cyclic.any():  # everything on and below a cycle descends from each of its nodes
            ring = np.flatnonzero(self.cyclic)
            whole = np.bincount(self.root[ring], weights=count[ring] + 1, minlength=self.n).astype(np.int64)
            count[ring] = whole[self.root[ring]] - 1
        return count

    def paths(self, names: list[str]) -> list[str]:
        path = list(names)
        for start in np.flatnonzero(self.cyclic & (self.root == np.arange(self.n))):
            # around a cycle, from its smallest id along the links
            ring = [int(start)]
            while (up := int(self.parent[ring[-1]])) != start:
                ring.append(up)
            for before, node in zip([ring[0], *ring[:0:-1]], ring[:0:-1]):
                path[node] = path[before] + SEPARATOR + names[node]
        for level in self.levels:
            for node in level.tolist():
                if self.depth[node] > 0:
                    path[node] = path[self.parent[node]] + SEPARATOR + names[node]
        return path


def _whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of whole groups, from batches that are sorted by group."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        if rows >= CHUNK_ROWS:
            last = held[-1].column("graph_id")[-1].as_py()
            same = pc.equal(batch.column("graph_id"), last)
            cut = batch.num_rows if pc.all(same).as_py() else pc.index(same, False).as_py()
            held.append(batch.slice(0, cut))
            if cut < batch.num_rows:
                yield pa.Table.from_batches(held)
                held, rows = [], 0
                batch = batch.slice(cut)
            else:
                continue
        held.append(batch)
        rows += batch.num_rows
    if held:
        yield pa.Table.from_batches(held)


def _local_nodes(details: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_groups(batches):
            forest = _Forest(table)
            forest.walk()
            if not forest.n:
                continue
            groups, names = forest.split()
            name = pa.array(names, pa.string())
            up = pa.array(forest.parent, mask=forest.parent < 0)
            columns = {
                "graph_id": pa.array(groups, pa.string()),
                "node_id": name,
                "parent_id": name.take(up),
                "root_id": name.take(pa.array(forest.root)),
                "depth": pa.array(forest.depth, pa.int32()),
                "on_cycle": pa.array(forest.cyclic),
                "below_cycle": pa.array(forest.below),
                "n_descendants": pa.array(forest.descendants(), pa.int64()) if details else pa.nulls(forest.n, pa.int64()),
                "path": pa.array(forest.paths(names), pa.string()) if details else pa.nulls(forest.n, pa.string()),
            }
            yield from pa.table(columns).to_batches(max_chunksize=20_000)

    return run


def _local_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for table in _whole_groups(batches):
        forest = _Forest(table)
        forest.walk()
        if not forest.n:
            continue
        groups, names = forest.split()
        group, name = pa.array(groups, pa.string()), pa.array(names, pa.string())
        far = np.where(forest.cyclic | forest.below, forest.depth + forest.cycle_length() - 1, forest.depth)
        node = np.flatnonzero(far >= 1)
        above, distance = forest.parent[node], 1
        while len(node):
            columns = {"graph_id": group.take(pa.array(node)), "ancestor_id": name.take(pa.array(above)), "descendant_id": name.take(pa.array(node)), "distance": pa.array(np.full(len(node), distance), pa.int32())}
            yield from pa.table(columns).to_batches(max_chunksize=50_000)
            distance += 1
            keep = far[node] >= distance
            node, above = node[keep], forest.parent[above[keep]]


def _links(df: DataFrame, group: str, parent: str, child: str) -> DataFrame:
    links = df.select(*(F.col(c).cast("string").alias(n) for c, n in ((group, "graph_id"), (parent, "parent"), (child, "child"))))
    return links.filter(F.col("graph_id").isNotNull() & (F.col("parent").isNotNull() | F.col("child").isNotNull()))


def _split_by_size(links: DataFrame, group_rows: int) -> tuple[DataFrame, DataFrame | None]:
    """The links of groups that fit one task, and those of the others or None."""
    large = links.groupBy("graph_id").count().filter(F.col("count") > group_rows).select("graph_id")
    large = durable(large)
    if large.isEmpty():
        return links, None
    return links.join(large, "graph_id", "left_anti"), links.join(large, "graph_id", "left_semi")


def _sorted_groups(links: DataFrame) -> DataFrame:
    return links.repartition(partitions(links.sparkSession), "graph_id").sortWithinPartitions("graph_id")


def _parents(links: DataFrame) -> DataFrame:
    """(graph_id, node, parent or null), one row per node; hot nodes are pre-aggregated map-side."""
    ends = links.select("graph_id", F.explode(F.array(
        F.struct(F.col("child").alias("node"), F.when(F.col("child").isNotNull(), F.col("parent")).alias("parent")),
        F.struct(F.col("parent").alias("node"), F.lit(None).cast("string").alias("parent")),
    )).alias("end")).select("graph_id", "end.*").filter("node is not null")
    return ends.groupBy("graph_id", "node").agg(F.min("parent").alias("parent"))


def _ring_paths(ring: DataFrame, size: int) -> DataFrame:
    """(graph_id, node, path) of the nodes on cycles: around each cycle along the links, from its smallest id, by pointer doubling."""
    part = ring.select("graph_id", "node", F.when(F.col("node") != F.col("root"), F.col("parent")).alias("up"), F.col("node").alias("path"))
    step = 1
    while step < size:
        above = part.select("graph_id", F.col("node").alias("up"), F.col("up").alias("next"), F.col("path").alias("before"))
        part = durable(part.join(above, ["graph_id", "up"], "left").select("graph_id", "node", F.col("next").alias("up"), F.concat_ws(SEPARATOR, "before", "path").alias("path")))
        step *= 2
    return part.select("graph_id", "node", "path")


def _frontier_nodes(links: DataFrame, details: bool = True, levels_per_job: int = 8) -> DataFrame:
    """The distributed frontier walk for groups of any size."""
    own = F.col("node") if details else F.lit(None).cast("string")
    nodes = durable(_parents(links))
    children = nodes.filter("parent is not null").select("graph_id", F.col("parent").alias("up"), "node")
    no = F.lit(False)
    seed = nodes.filter("parent is null").select("graph_id", "node", F.lit(None).cast("string").alias("parent"), F.col("node").alias("root"), F.lit(0).alias("depth"), no.alias("on_cycle"), no.alias("below_cycle"), own.alias("path"))

    def descend(seed: DataFrame, below) -> DataFrame:
        found, frontier = [seed], seed
        while True:
            job, step = [], frontier
            for _ in range(levels_per_job):
                step = step.withColumnRenamed("node", "up").drop("parent").join(children, ["graph_id", "up"]).select(
                    "graph_id", "node", F.col("up").alias("parent"), "root", (F.col("depth") + 1).alias("depth"), F.lit(False).alias("on_cycle"), F.lit(below).alias("below_cycle"), F.concat("path", F.lit(SEPARATOR), "node").alias("path"))
                if below:
                    step = step.join(rings.select("graph_id", "node"), ["graph_id", "node"], "left_anti")
                job.append(step)
            every = job[0]
            for more in job[1:]:
                every = every.unionByName(more)
            every = durable(every)
            deepest = every.agg(F.max("depth")).first()[0]
            if deepest is None:
                break
            found.append(every)
            frontier = every.filter(F.col("depth") == F.lit(deepest))
            if deepest % levels_per_job:
                break
        whole = found[0]
        for part in found[1:]:
            whole = whole.unionByName(part)
        return whole

    forest = durable(descend(seed, False))
    rest = durable(nodes.join(forest.select("graph_id", "node"), ["graph_id", "node"], "left_anti"))
    size = rest.count()
    if size:
        jump = rest.select("graph_id", "node", F.col("parent").alias("to"), F.least("node", "parent").alias("least"))
        step = 1
        while step <= size:  # pointer doubling over the nodes no frontier reached
            on = jump.select("graph_id", F.col("node").alias("to"), F.col("to").alias("next"), F.col("least").alias("next_least"))
            jump = durable(jump.join(on, ["graph_id", "to"]).select("graph_id", "node", F.col("next").alias("to"), F.least("least", "next_least").alias("least")))
            step *= 2
        rings = durable(jump.select("graph_id", F.col("to").alias("node")).distinct().join(jump.drop("to"), ["graph_id", "node"]))
        ring = rings.join(nodes, ["graph_id", "node"]).select("graph_id", "node", "parent", F.col("least").alias("root"), F.lit(0).alias("depth"), F.lit(True).alias("on_cycle"), no.alias("below_cycle"), own.alias("path"))
        if details:
            longest = ring.groupBy("graph_id", "root").count().agg(F.max("count")).first()[0]
            ring = durable(ring.drop("path").join(_ring_paths(ring, longest), ["graph_id", "node"]))
        forest = forest.unionByName(descend(ring, True))
    return forest.select("graph_id", F.col("node").alias("node_id"), F.col("parent").alias("parent_id"), F.col("root").alias("root_id"), "depth", "on_cycle", "below_cycle", F.lit(None).cast("bigint").alias("n_descendants"), "path")


def hierarchy(df: DataFrame, group: str = "graph_id", parent: str = "source", child: str = "target", details: bool = True, group_rows: int = GROUP_ROWS) -> DataFrame:
    """One row per node: root, depth, parent, cycle marks and, with ``details``, path and number of descendants.

    The path of a node on a cycle leads around the cycle from its smallest id; paths below extend it.
    In groups above ``group_rows`` links the number of descendants is counted from ``descendants``.
    """
    small, large = _split_by_size(durable(_links(df, group, parent, child), "links"), group_rows)
    nodes = _sorted_groups(small).mapInArrow(_local_nodes(details), NODE_SCHEMA)
    if large is None:
        return nodes
    far = _frontier_nodes(large, details)
    if details:
        counts = _frontier_pairs(large).groupBy("graph_id", F.col("ancestor_id").alias("node_id")).agg(F.count("*").alias("n"))
        far = far.join(counts, ["graph_id", "node_id"], "left").withColumn("n_descendants", F.coalesce("n", F.lit(0))).drop("n").select(*nodes.columns)
    return nodes.unionByName(far)


def _frontier_pairs(links: DataFrame) -> DataFrame:
    """Ancestor pairs of large groups, one distance a step."""
    up = durable(_parents(links).filter("parent is not null"))
    pairs = up.select("graph_id", F.col("parent").alias("ancestor_id"), F.col("node").alias("descendant_id"), F.lit(1).alias("distance")).filter("ancestor_id <> descendant_id")
    found, frontier = None, durable(pairs)
    while not frontier.isEmpty():
        found = frontier if found is None else found.unionByName(frontier)
        step = frontier.join(up.withColumnRenamed("node", "ancestor_id"), ["graph_id", "ancestor_id"]).select("graph_id", F.col("parent").alias("ancestor_id"), "descendant_id", (F.col("distance") + 1).alias("distance"))
        frontier = durable(step.filter("ancestor_id <> descendant_id").join(found.select("graph_id", "ancestor_id", "descendant_id"), ["graph_id", "ancestor_id", "descendant_id"], "left_anti"))
    return frontier if found is None else found


def descendants(df: DataFrame, group: str = "graph_id", parent: str = "source", child: str = "target", group_rows: int = GROUP_ROWS) -> DataFrame:
    """Every (ancestor, descendant) pair with its distance; on a cycle each node is above every other one."""
    small, large = _split_by_size(durable(_links(df, group, parent, child), "links"), group_rows)
    pairs = _sorted_groups(small).mapInArrow(_local_pairs, PAIR_SCHEMA)
    return pairs if large is None else pairs.unionByName(_frontier_pairs(large))


def cycles(nodes: DataFrame) -> DataFrame:
    """One row per cycle of the result of ``hierarchy``: its smallest id, its length and how many nodes hang below."""
    marked = nodes.filter("on_cycle or below_cycle")
    return marked.groupBy("graph_id", F.col("root_id").alias("cycle_id")).agg(F.sum(F.col("on_cycle").cast("bigint")).alias("length"), F.sum(F.col("below_cycle").cast("bigint")).alias("n_below"))
