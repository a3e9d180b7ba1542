"""Transitive closure of links from many seeds at once.

With a group column, groups of up to ``group_rows`` links are walked whole, many to a task, seed by seed; larger groups, and
links without groups, are walked by frontier joins, one round for all seeds together. Both give the same rows.
A round moves the frontier only: while that has few rows (it is counted as it is written) it is broadcast to the
links where they lie, and only beyond that the links are shuffled once and kept by node for all later rounds.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import durable, partitions

GROUP_ROWS = 200_000
#: Rows of a frontier, or of what was found, that are broadcast: of two names each, some tens of megabytes.
BROADCAST_ROWS = 100_000
BROADCAST_LENGTH = 256


def closure(links: DataFrame, seeds: DataFrame, reverse: bool = False, max_depth: int | None = None, group: str | None = None, group_rows: int = GROUP_ROWS) -> DataFrame:
    """(seed, node, depth), after ``group`` if given, of every node that links (src, dst) lead to from the seeds (seed, node), at its least depth.

    Nodes seen before are dropped, so cycles end. A seed is in its own result only if a cycle leads back to it. Null ends
    (or groups) make no link; repeated links and seeds count once; without links or seeds the result is empty.
    """
    a, b = ("dst", "src") if reverse else ("src", "dst")
    if group is None:
        steps = links.select(F.col(a).alias("node"), F.col(b).alias("next"))
        return _rounds(steps.filter("node is not null and next is not null"), seeds.select("seed", "node"), ["seed", "node"], ["node"], max_depth).select("seed", "node", "depth")
    steps = durable(links.select(F.col(group).alias("of"), F.col(a).alias("node"), F.col(b).alias("next")).filter("of is not null and node is not null and next is not null").distinct(), "links")
    begun = durable(seeds.select(F.col(group).alias("of"), "seed", "node").filter("of is not null and node is not null").distinct(), "seeds")
    large = durable(steps.groupBy("of").count().filter(F.col("count") > group_rows).select("of"), "large")
    if large.isEmpty():
        found = _whole_groups(steps, begun, max_depth)
    else:
        far = lambda df: df.join(large, "of", "left_semi")
        near = lambda df: df.join(large, "of", "left_anti")
        found = _whole_groups(near(steps), near(begun), max_depth).unionByName(_rounds(far(steps), far(begun), ["of", "seed", "node"], ["of", "node"], max_depth))
    return found.select(F.col("of").alias(group), "seed", "node", "depth")


def _whole_groups(steps: DataFrame, seeds: DataFrame, max_depth: int | None) -> DataFrame:
    schema = "of string, seed string, node string, depth int"

    def walk(ahead: dict[str, list[str]], node: str) -> Iterator[tuple[str, int]]:
        seen, frontier, depth = set(), [node], 0
        while frontier and (max_depth is None or depth < max_depth):
            depth += 1
            fresh = {n for f in frontier for n in ahead.get(f, ())} - seen
            seen |= fresh
            for n in fresh:
                yield n, depth
            frontier = list(fresh)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, ahead, seed_of, least, out = None, {}, None, {}, []

        def batch() -> pa.RecordBatch:
            kinds = (pa.string(), pa.string(), pa.string(), pa.int32())
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], names=["of", "seed", "node", "depth"])

        for part in batches:
            for of, kind, x, y in zip(*(part.column(i).to_pylist() for i in range(4))):
                if of != last or (kind == 1 and x != seed_of):
                    out += [(last, seed_of, n, d) for n, d in least.items()]
                    least, seed_of = {}, None
                if of != last:
                    last, ahead = of, {}
                if kind == 0:
                    ahead.setdefault(x, []).append(y)
                    continue
                seed_of = x
                for n, d in walk(ahead, y):  # a seed may begin at several nodes
                    least[n] = min(least.get(n, d), d)
                if len(out) > 50_000:
                    yield batch()
                    out = []
        out += [(last, seed_of, n, d) for n, d in least.items()]
        yield batch()

    rows = steps.select("of", F.lit(0).alias("kind"), F.col("node").alias("x"), F.col("next").alias("y")).unionByName(seeds.select("of", F.lit(1).alias("kind"), F.col("seed").alias("x"), F.col("node").alias("y")))
    return rows.repartition(partitions(rows.sparkSession), "of").sortWithinPartitions("of", "kind", "x").mapInArrow(run, schema)


def _rounds(steps: DataFrame, seeds: DataFrame, state: list[str], at: list[str], max_depth: int | None) -> DataFrame:
    """The walk by frontier joins; ``state`` are the columns of a reached node, ``at`` those that links are looked up by."""

    def small(df: DataFrame, rows: int) -> DataFrame:
        return F.broadcast(df) if rows <= BROADCAST_ROWS else df

    def measured(df: DataFrame) -> tuple[DataFrame, int]:
        """Written rows with their number; long names count as several rows."""
        held = durable(df, "frontier")
        n, size = held.agg(F.count("*"), F.coalesce(F.sum(sum((F.length(c) for c in state), F.lit(0))), F.lit(0))).first()
        return held, n and max(n, -(-size // BROADCAST_LENGTH))

    frontier, rows = measured(seeds.select(*state).distinct())
    found, total, depth, kept = None, 0, 0, None
    while rows and (max_depth is None or depth < max_depth):
        depth += 1
        if rows > BROADCAST_ROWS and kept is None:
            kept = durable(steps.distinct().repartition(partitions(steps.sparkSession), *at), "links")
        reached = (kept or steps).join(small(frontier.select(*state), rows), at).select(*[c for c in state if c != "node"], F.col("next").alias("node")).distinct()
        if found is not None:
            reached = reached.join(small(found.select(*state), total), state, "left_anti")
        frontier, rows = measured(reached.withColumn("depth", F.lit(depth)))
        if rows:
            found = frontier if found is None else found.unionByName(frontier)
            total += rows
    return found if found is not None else seeds.select(*state).withColumn("depth", F.lit(0)).limit(0)
