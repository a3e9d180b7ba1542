"""Problem 8: texts into containers of fixed capacity.

Sizes are reduced to a histogram (at most ``capacity`` numbers, whatever the data). Combinations of up
to three sizes that fill a container exactly are enumerated, and non-negative least squares finds how
often each is used to explain the histogram; the counts are rounded and what they leave is packed
greedily, longest first, still on the histogram. The result is a short list of patterns with repeat
counts; the texts then find their slot by their rank among the texts of their size, which is counted in
salted parts of some ``ROWS_A_SALT`` rows each, so a size that a third of the texts have is no single task.

Defined results: a text above the capacity is split into full pieces and a rest; null and empty texts
have size 0 and go to container 0 without using room; every text has at least one piece; rows that
repeat an id are packed one by one. An empty table gives no rows. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..queries.tables import table
from ..session import durable
from .tokens import VOCABULARY, with_token_counts

CAPACITY = 2048
ROWS_A_SALT = 50_000


def combinations(capacity: int, grid: int | None = None) -> np.ndarray:
    """Rows of three sizes, 0 for none, that sum to the capacity: all pairs, and triples whose middle size is on a grid."""
    grid = grid or max(1, capacity // 64)
    one = np.arange((capacity + 1) // 2, capacity)
    rows = [np.stack([one, capacity - one, np.zeros_like(one)], axis=1)]
    for middle in range(grid, capacity - 1, grid):
        a = np.arange((capacity - middle + 1) // 2, capacity - middle)
        rows.append(np.stack([a, np.full_like(a, middle), capacity - middle - a], axis=1))
    return np.unique(np.sort(np.concatenate(rows), axis=1)[:, ::-1], axis=0)


def repeat_counts(histogram: np.ndarray, combos: np.ndarray, rounds: int = 150) -> np.ndarray:
    """Non-negative least squares of the combinations against the histogram by accelerated projected gradients.

    Long sizes weigh more: what is left of short ones is easily packed.
    """
    size = len(histogram)
    weight = np.sqrt(np.arange(size) / (size - 1))
    weight[0] = 0
    target = histogram * weight

    def image(x: np.ndarray) -> np.ndarray:
        return sum(np.bincount(combos[:, i], weights=x, minlength=size) for i in range(3)) * weight

    def pull(r: np.ndarray) -> np.ndarray:
        r = r * weight
        return r[combos].sum(axis=1)

    x = np.ones(len(combos))
    for _ in range(20):  # the largest eigenvalue gives the step
        x = pull(image(x))
        norm = np.linalg.norm(x)
        x /= norm
    x = np.zeros(len(combos))
    y, t = x.copy(), 1.0
    for _ in range(rounds):
        new = np.maximum(0, y - pull(image(y) - target) / norm)
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y = new + (t - 1) / t_new * (new - x)
        x, t = new, t_new
    return x


def patterns(histogram: np.ndarray, capacity: int) -> list[tuple[dict[int, int], int]]:
    """(sizes with their multiplicity, repeats) that use up the histogram exactly."""
    left = histogram.astype(np.int64).copy()
    left[0] = 0
    out: list[tuple[dict[int, int], int]] = []
    if left[capacity]:
        out.append(({capacity: 1}, int(left[capacity])))
        left[capacity] = 0
    if left.any():
        combos = combinations(capacity)
        usable = np.all((left[combos] > 0) | (combos == 0), axis=1)
        combos = combos[usable]
        if len(combos):
            x = repeat_counts(left, combos)
            # rounded along the running sum, so that small counts do not all vanish
            whole = np.diff(np.floor(np.concatenate(([0.0], np.cumsum(x))) + 0.5)).astype(np.int64)
            for i in np.flatnonzero(whole):
                need: dict[int, int] = {}
                for s in combos[i].tolist():
                    if s:
                        need[s] = need.get(s, 0) + 1
                times = min(int(whole[i]), *(int(left[s]) // m for s, m in need.items()))
                if times > 0:
                    out.append((need, times))
                    for s, m in need.items():
                        left[s] -= m * times
    sizes = np.flatnonzero(left)
    while len(sizes):
        need, room = {}, capacity
        spare = dict(zip(sizes.tolist(), left[sizes].tolist()))
        at = len(sizes)
        while room and at:
            at = int(np.searchsorted(sizes[:at], room, side="right"))
            if not at:
                break
            s = int(sizes[at - 1])
            take = min(room // s, spare[s])
            need[s] = take
            room -= take * s
            at -= 1
        times = min(int(left[s]) // m for s, m in need.items())
        out.append((need, times))
        for s, m in need.items():
            left[s] -= m * times
        sizes = np.flatnonzero(left)
    return out


def slots(found: list[tuple[dict[int, int], int]], capacity: int) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each size: first rank, multiplicity and first container of the patterns that use it."""
    at, base = {}, 0
    rows: dict[int, list[tuple[int, int, int]]] = {}
    for need, times in found:
        for s, m in need.items():
            start = at.get(s, 0)
            rows.setdefault(s, []).append((start, m, base))
            at[s] = start + m * times
        base += times
    return {s: tuple(np.array(c, dtype=np.int64) for c in zip(*r)) for s, r in rows.items()}


def packed(sizes: DataFrame, capacity: int = CAPACITY, id_column: str = "doc_id", size_column: str = "n_tokens") -> DataFrame:
    """(id, piece, first_token, n_tokens, container_id) of every text or piece."""
    spark = sizes.sparkSession
    size = F.col(size_column)
    last = F.when(size > 0, F.ceil(size / capacity) - 1).otherwise(0)
    pieces = sizes.select(F.col(id_column).cast("bigint").alias("doc_id"), size.alias("size"), F.explode(F.sequence(F.lit(0), last.cast("int"))).alias("piece"))
    pieces = pieces.select("doc_id", "piece", (F.col("piece") * capacity).alias("first_token"), F.least(F.col("size") - F.col("piece") * capacity, F.lit(capacity)).cast("int").alias("n_tokens"))
    pieces = durable(pieces, "pieces")
    of_size = pieces.groupBy("n_tokens").count().toPandas()  # capacity + 1 rows at most
    histogram = np.zeros(capacity + 1, dtype=np.int64)
    histogram[of_size["n_tokens"].to_numpy(dtype=np.int64)] = of_size["count"].to_numpy(dtype=np.int64)
    shared = spark.sparkContext.broadcast(slots(patterns(histogram, capacity), capacity))
    salts = max(16, -(-int(histogram.max(initial=0)) // ROWS_A_SALT))
    pieces = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)).cast("int"))
    # one row a size and salt: a thousandth of the pieces or less in the sizes that have many
    counts = durable(pieces.groupBy("n_tokens", "salt").count(), "counts")
    before = Window.partitionBy("n_tokens").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("n_tokens", "salt", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("offset"))
    order = Window.partitionBy("n_tokens", "salt").orderBy("doc_id", "piece")
    # the pieces are not shuffled again for this join: they lie by size and salt
    ranked = pieces.withColumn("inside", F.row_number().over(order) - 1).join(offsets, ["n_tokens", "salt"]).withColumn("rank", F.col("inside") + F.col("offset"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = shared.value
        for batch in batches:
            size, rank = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("n_tokens", "rank"))
            container = np.zeros(len(size), dtype=np.int64)
            order = np.argsort(size, kind="stable")
            values, starts = np.unique(size[order], return_index=True)
            for value, part in zip(values.tolist(), np.split(order, starts[1:])):
                if value:
                    first, many, base = places[value]
                    i = np.searchsorted(first, rank[part], side="right") - 1
                    container[part] = base[i] + (rank[part] - first[i]) // many[i]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("doc_id", "piece", "first_token", "n_tokens")] + [pa.array(container)], names=["doc_id", "piece", "first_token", "n_tokens", "container_id"])

    return ranked.mapInArrow(run, "doc_id bigint, piece int, first_token int, n_tokens int, container_id bigint")


def fill(assigned: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Used tokens, number of texts or pieces and filled part of each container."""
    used = F.sum("n_tokens").cast("bigint")
    return assigned.groupBy("container_id").agg(used.alias("used"), F.count("*").alias("n_pieces"), F.round(used / capacity, 6).alias("filled"))


def _sizes(spark: SparkSession, sf_dir: str, vocabulary: str = VOCABULARY) -> DataFrame:
    return with_token_counts(table(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary=vocabulary)


def p8_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(_sizes(spark, sf_dir))


def p8_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill(packed(_sizes(spark, sf_dir)))


def p8_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers used against the fewest conceivable, and the part of all room that is used."""
    whole = fill(packed(_sizes(spark, sf_dir))).agg(F.count("*").alias("containers"), F.sum("used").alias("tokens"))
    return whole.select("containers", "tokens", F.ceil(F.col("tokens") / CAPACITY).alias("fewest"), F.round(F.col("tokens") / (F.col("containers") * CAPACITY), 6).alias("filled"))


def p8_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What must hold of any packing: every text is there once and whole, pieces only where a text is longer than a container, no container too full, few wasted."""
    sizes = durable(_sizes(spark, sf_dir), "sizes")
    found = durable(packed(sizes), "packed")
    texts = found.groupBy("doc_id").agg(F.count("*").alias("pieces"), F.sum("n_tokens").alias("n"), F.max(F.col("first_token") + F.col("n_tokens")).alias("upto"))
    both = sizes.select("doc_id", F.coalesce("n_tokens", F.lit(0)).alias("size")).join(texts, "doc_id", "full_outer")
    right = (F.col("size") == F.col("n")) & (F.col("size") == F.col("upto")) & (F.col("pieces") == F.greatest(F.lit(1), F.ceil(F.col("size") / CAPACITY)))
    whole = both.agg(F.count("*").alias("texts"), F.count_if(~F.coalesce(right, F.lit(False))).alias("wrong_texts"))
    boxes = fill(found).agg(F.count_if(F.col("used") > CAPACITY).alias("too_full"), (F.count("*") <= F.greatest(F.lit(1), F.ceil(1.01 * F.sum("used") / CAPACITY + 1))).alias("within_a_hundredth"))
    return whole.withColumn("one", F.lit(1)).join(boxes.withColumn("one", F.lit(1)), "one").drop("one")


SQL = {"p8_properties": "SELECT count(*) AS texts, CAST(0 AS BIGINT) AS wrong_texts, CAST(0 AS BIGINT) AS too_full, true AS within_a_hundredth FROM documents"}
QUERIES = {"p8_containers": p8_containers, "p8_fill": p8_fill, "p8_summary": p8_summary, "p8_properties": p8_properties}
