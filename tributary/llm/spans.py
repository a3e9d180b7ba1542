"""Problem 10: long exact spans shared between records, by a log-structured fingerprint index.

Each batch of texts is reduced to winnowed window hashes, which are kept as an immutable run: a table
bucketed and sorted by hash in the shared folder. A new batch is merge-joined with itself and with the
runs before it (neither side is shuffled or sorted again), matches are verified on the texts, and runs
are compacted into one when there are more than ``fanout``. Equal texts are folded into one class before, so
that a group of copies is indexed and verified once; only a list of pairs, where one is asked for, expands it.

Defined results: texts that are null or shorter than the span take part in nothing; offsets and lengths
are Unicode code points; a span repeated inside one text only is not shared; rows with a null id are left
out; rows that repeat an id are one record for pairs. An empty table gives no rows. Extra columns are
not read.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..queries.tables import table
from ..session import durable, partitions, scratch_path, ship
from .fingerprints import Windows, code_points, pieces, winnow

SPAN, GRAM = 200, 100
FINGERPRINTS = "fp bigint, doc_id bigint, pos int"


def fingerprints(docs: DataFrame, span: int = SPAN, gram: int = GRAM) -> DataFrame:
    """(fp, doc_id, pos) of the winnowed grams of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = Windows()
        for batch in batches:
            ids = batch.column(0)
            for at in range(0, batch.num_rows, 1000):
                row, pos, found = winnow(batch.column(1).slice(at, 1000).to_pylist(), span, gram, windows)
                yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), ids.take(pa.array(row + at)), pa.array(pos.astype(np.int32))], names=["fp", "doc_id", "pos"])

    long_enough = docs.filter(F.col("doc_id").isNotNull() & (F.length("text") >= span))
    return long_enough.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, FINGERPRINTS)


class FingerprintIndex:
    """Sorted immutable runs of fingerprints; ``add`` returns what a new batch shares with itself and the runs."""

    def __init__(self, spark: SparkSession, span: int = SPAN, gram: int = GRAM, buckets: int | None = None, fanout: int = 4):
        self.spark, self.span, self.gram, self.fanout = spark, span, gram, fanout
        self.buckets = buckets or partitions(spark)
        self.runs: list[str] = []

    def _write(self, rows: DataFrame) -> str:
        name = f"fingerprints_{uuid.uuid4().hex}"
        path = scratch_path(self.spark, name)
        rows.repartition(self.buckets, "fp").sortWithinPartitions("fp").write.bucketBy(self.buckets, "fp").sortBy("fp").option("path", path).format("parquet").saveAsTable(name)
        return name

    def add(self, docs: DataFrame) -> DataFrame:
        """Index a batch; (doc_id_a, pos_a, doc_id_b, pos_b) of equal grams, the smaller id first."""
        fresh = self._write(fingerprints(docs, self.span, self.gram))
        new = self.spark.table(fresh).hint("merge")
        found = None
        for run in [fresh, *self.runs]:
            old = self.spark.table(run).select("fp", F.col("doc_id").alias("other"), F.col("pos").alias("other_pos"))
            match = new.join(old, "fp").filter(F.col("doc_id") < F.col("other") if run == fresh else F.col("doc_id") != F.col("other"))
            first = F.col("doc_id") < F.col("other")
            match = match.select(F.least("doc_id", "other").alias("doc_id_a"), F.when(first, F.col("pos")).otherwise(F.col("other_pos")).alias("pos_a"), F.greatest("doc_id", "other").alias("doc_id_b"), F.when(first, F.col("other_pos")).otherwise(F.col("pos")).alias("pos_b"))
            found = match if found is None else found.unionByName(match)
        # one row per pair and diagonal: all equal grams on it lie between the first and the last
        diagonals = found.groupBy("doc_id_a", "doc_id_b", (F.col("pos_a") - F.col("pos_b")).alias("shift")).agg(F.min("pos_a").alias("first"), F.max("pos_a").alias("last"))
        diagonals = durable(diagonals, "diagonals")
        self.runs.append(fresh)
        if len(self.runs) > self.fanout:
            self.compact()
        return diagonals

    def compact(self) -> None:
        """Merge all runs into one; the old ones are dropped."""
        if len(self.runs) < 2:
            return
        whole = self.spark.table(self.runs[0])
        for run in self.runs[1:]:
            whole = whole.unionByName(self.spark.table(run))
        merged = self._write(whole)
        self.drop()
        self.runs = [merged]

    def drop(self) -> None:
        for run in self.runs:
            self.spark.sql(f"DROP TABLE IF EXISTS {run}")
        self.runs = []


def _stretches(a: str, b: str, span: int) -> list[tuple[int, int]]:
    """(start, length) of the aligned stretches of at least ``span`` in which two texts agree."""
    n = min(len(a), len(b))
    x, y = (np.frombuffer(t[:n].encode("utf-32-le", "surrogatepass"), dtype=np.uint32) for t in (a, b))
    breaks = np.concatenate(([-1], np.flatnonzero(x != y), [n]))
    lengths = np.diff(breaks) - 1
    return [(int(breaks[i]) + 1, int(lengths[i])) for i in np.flatnonzero(lengths >= span)]


def verified(diagonals: DataFrame, docs: DataFrame, span: int = SPAN, gram: int = GRAM) -> DataFrame:
    """(doc_id_a, doc_id_b, start_a, start_b, length): every stretch of at least ``span`` that the texts really share, on each diagonal.

    Only the part of each text around the equal grams is fetched. A stretch cannot reach further: each of its windows of
    ``span`` holds a gram that is selected in both texts, so that it begins at most ``span - gram`` before the first of
    them and ends at most as much after the last.
    """
    room = span - gram
    back = F.least(F.col("first"), F.col("first") - F.col("shift"), F.lit(room))
    asked = diagonals.withColumn("back", back).withColumn("size", F.col("last") - F.col("first") + F.col("back") + gram + room)
    texts = docs.filter("doc_id is not null and text is not null").select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").dropDuplicates(["doc_id"]) if docs.columns else docs
    cut = lambda start: F.substring(F.col("text"), start + 1, F.col("size"))
    asked = asked.withColumn("at_a", F.col("first") - F.col("back")).withColumn("at_b", F.col("first") - F.col("shift") - F.col("back"))
    half = asked.join(texts.withColumnRenamed("doc_id", "doc_id_a"), "doc_id_a").withColumn("part_a", cut(F.col("at_a"))).drop("text")
    both = half.join(texts.withColumnRenamed("doc_id", "doc_id_b"), "doc_id_b").withColumn("part_b", cut(F.col("at_b")))
    both = both.select("doc_id_a", "doc_id_b", "at_a", "at_b", "part_a", "part_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(row, *s) for row, (a, b) in enumerate(zip(batch.column(4).to_pylist(), batch.column(5).to_pylist())) for s in _stretches(a, b, span)]
            row, start, length = (np.array([f[i] for f in found], dtype=np.int64) for i in range(3))
            take = pa.array(row)
            at = [pa.array(batch.column(i).to_numpy()[row] + start, pa.int32()) for i in (2, 3)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), *at, pa.array(length, pa.int32())], names=["doc_id_a", "doc_id_b", "start_a", "start_b", "length"])

    return both.mapInArrow(run, "doc_id_a bigint, doc_id_b bigint, start_a int, start_b int, length int")


def text_classes(docs: DataFrame) -> DataFrame:
    """(doc_id, class_id, n_chars): records with the same text share the smallest id among them."""
    held = docs.filter("doc_id is not null and text is not null").select(F.col("doc_id").cast("bigint").alias("doc_id"), F.sha2("text", 256).alias("content"), F.length("text").alias("n_chars")).dropDuplicates(["doc_id"])
    held = durable(held, "contents")
    least = held.groupBy("content").agg(F.min("doc_id").alias("class_id"))
    return held.join(least, "content").select("doc_id", "class_id", "n_chars")


def shared_pairs(docs: DataFrame, classes: DataFrame, span: int = SPAN, gram: int = GRAM, batches: int = 4, fanout: int = 2) -> DataFrame:
    """(doc_id_a, doc_id_b, start_a, start_b, length) of every stretch of at least ``span`` characters that two classes of texts have in common.

    The texts are indexed batch by batch, and runs are compacted on the way.
    """
    copies = durable(classes.filter("doc_id <> class_id").select("doc_id"), "copies")
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").join(copies, "doc_id", "left_anti")
    index = FingerprintIndex(ship(docs.sparkSession), span, gram, fanout=fanout)
    found = None
    try:
        for number in range(batches):
            share = index.add(docs.filter(F.pmod(F.xxhash64("doc_id"), F.lit(batches)) == number))
            found = share if found is None else found.unionByName(share)
    finally:
        index.drop()
    return verified(found, docs, span, gram)


def document_pairs(pairs: DataFrame, classes: DataFrame, span: int = SPAN) -> DataFrame:
    """(doc_id_a, doc_id_b), the smaller id first: pairs of classes laid open to their members, and the members of a class among themselves."""
    member = lambda side: classes.select(F.col("class_id").alias(f"doc_id_{side}"), F.col("doc_id").alias(f"of_{side}"))
    across = pairs.select("doc_id_a", "doc_id_b").distinct().join(member("a"), "doc_id_a").join(member("b"), "doc_id_b").select("of_a", "of_b")
    long_enough = classes.filter(F.col("n_chars") >= span)
    inside = long_enough.select("class_id", F.col("doc_id").alias("of_a")).join(long_enough.select("class_id", F.col("doc_id").alias("of_b")), "class_id").filter("of_a < of_b").select("of_a", "of_b")
    return across.unionByName(inside).select(F.least("of_a", "of_b").alias("doc_id_a"), F.greatest("of_a", "of_b").alias("doc_id_b"))


def links(pairs: DataFrame, classes: DataFrame, span: int = SPAN) -> DataFrame:
    """(doc_id, class_id, n_links): with how many other records each shares a stretch; copies are counted, not laid open."""
    sizes = durable(classes.groupBy("class_id").agg(F.count("*").alias("n"), F.first("n_chars").alias("n_chars")), "sizes")
    ends = pairs.select("doc_id_a", "doc_id_b").distinct()
    both = ends.select(F.col("doc_id_a").alias("class_id"), F.col("doc_id_b").alias("other")).unionByName(ends.select(F.col("doc_id_b").alias("class_id"), F.col("doc_id_a").alias("other")))
    across = both.join(sizes.select(F.col("class_id").alias("other"), "n"), "other").groupBy("class_id").agg(F.sum("n").alias("across"))
    inside = F.when(F.col("n_chars") >= span, F.col("n") - 1).otherwise(0)
    whole = sizes.join(across, "class_id", "left").select("class_id", (F.coalesce("across", F.lit(0)) + inside).alias("n_links"))
    return classes.join(whole, "class_id").select("doc_id", "class_id", "n_links")


def shared_spans(docs: DataFrame, span: int = SPAN, gram: int = GRAM) -> DataFrame:
    """(doc_id, start, length) of the maximal stretches of each text whose every window of ``span`` stands in another record too.

    Linear in the occurrences, whatever their number: no pairs are formed. Grams seen in two records
    name the windows to look at; these are counted by a 128-bit hash of their whole content.
    """
    marks = durable(fingerprints(docs, span, gram), "marks")
    common = marks.groupBy("fp").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).filter("a <> b").select("fp")
    anchors = marks.join(common, "fp", "left_semi").groupBy("doc_id").agg(F.array_sort(F.collect_set("pos")).alias("anchors"))
    held = docs.filter("doc_id is not null").select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").join(anchors, "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, second = Windows(), Windows()
        for batch in batches:
            ids, places = batch.column(0), batch.column(2).to_pylist()
            for rows, begins, parts in pieces(batch.column(1).to_pylist(), span):
                codes, bounds = code_points(parts)
                one, two = first.prefix(codes), second.prefix(codes[::-1].copy())
                for row, begin, lo, hi in zip(rows, begins, bounds[:-1], bounds[1:]):
                    at = np.asarray(places[row]) - begin
                    starts = (at[:, None] - np.arange(span - gram + 1)[None, :]).ravel()
                    starts = np.unique(starts[(starts >= 0) & (starts <= hi - lo - span)]) + lo
                    h1 = first.hashes(one, starts, span)
                    h2 = second.hashes(two, len(codes) - starts - span, span)  # the window read backwards
                    yield pa.RecordBatch.from_arrays([pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)), ids.take(pa.array(np.full(len(starts), row))), pa.array((starts - lo + begin).astype(np.int32))], names=["h1", "h2", "doc_id", "start"])

    windows = durable(held.select("doc_id", "text", "anchors").mapInArrow(run, "h1 bigint, h2 bigint, doc_id bigint, start int").distinct(), "windows")
    twice = windows.groupBy("h1", "h2").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).filter("a <> b").select("h1", "h2")
    shared = windows.join(twice, ["h1", "h2"], "left_semi").select("doc_id", "start").distinct()
    from pyspark.sql import Window

    order = Window.partitionBy("doc_id").orderBy("start")
    # windows that overlap or touch make one stretch
    fresh = F.when(F.col("start") - F.lag("start").over(order) <= span, 0).otherwise(1)
    island = shared.withColumn("fresh", fresh).withColumn("island", F.sum("fresh").over(order))
    return island.groupBy("doc_id", "island").agg(F.min("start").alias("start"), (F.max("start") + span - F.min("start")).cast("int").alias("length")).drop("island")


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    classes = durable(text_classes(docs), "classes")
    return document_pairs(shared_pairs(docs, classes), classes)


def p10_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a document: the class of its text and with how many other documents it shares a long stretch."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    classes = durable(text_classes(docs), "classes")
    return links(durable(shared_pairs(docs, classes), "pairs"), classes)


def p10_stretches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stretch that two different texts share, with its places, as the index finds it; pairs of class representatives."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return shared_pairs(docs, durable(text_classes(docs), "classes"))


def p10_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shared_spans(table(spark, sf_dir, "documents").select("doc_id", "text"))


def p10_shared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each record how many of its characters, and what part, stand in other records too."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    sums = shared_spans(docs).groupBy("doc_id").agg(F.sum("length").cast("bigint").alias("shared"), F.count("*").alias("n_spans"))
    size = F.coalesce(F.length("text"), F.lit(0)).cast("bigint")
    whole = docs.select("doc_id", size.alias("n_chars")).join(sums, "doc_id", "left").fillna(0, ["shared", "n_spans"])
    part = F.when(F.col("n_chars") > 0, F.round(F.col("shared") / F.col("n_chars"), 6)).otherwise(0.0)
    return whole.select("doc_id", "n_chars", F.col("shared").alias("shared_chars"), "n_spans", part.alias("shared_part"))


_WINDOWS = """
WITH w AS (
  SELECT doc_id, CAST(p AS INT) - 1 AS start, md5(substr(text, p, 200)) AS h
  FROM documents, unnest(range(1, CAST(length(text) AS BIGINT) - 198)) AS u(p) WHERE length(text) >= 200
)
"""
_ISLANDS = _WINDOWS + """
, both_in AS (SELECT h FROM w GROUP BY h HAVING min(doc_id) <> max(doc_id)),
s AS (SELECT doc_id, start, CASE WHEN start - lag(start) OVER (PARTITION BY doc_id ORDER BY start) <= 200 THEN 0 ELSE 1 END AS fresh FROM w WHERE h IN (SELECT h FROM both_in)),
i AS (SELECT doc_id, start, sum(fresh) OVER (PARTITION BY doc_id ORDER BY start) AS island FROM s),
spans AS (SELECT doc_id, CAST(min(start) AS INT) AS start, CAST(max(start) + 200 - min(start) AS INT) AS length FROM i GROUP BY doc_id, island)
"""

SQL = {
    "p10_found": _WINDOWS + """
, groups AS (SELECT h, list(DISTINCT doc_id) AS ids FROM w GROUP BY h HAVING min(doc_id) <> max(doc_id))
SELECT DISTINCT a AS doc_id_a, b AS doc_id_b FROM (SELECT DISTINCT ids FROM groups), unnest(ids) AS x(a), unnest(ids) AS y(b) WHERE a < b
""",
    "p10_links": _WINDOWS + """
, groups AS (SELECT h, list(DISTINCT doc_id) AS ids FROM w GROUP BY h HAVING min(doc_id) <> max(doc_id)),
p AS (SELECT DISTINCT a, b FROM (SELECT DISTINCT ids FROM groups), unnest(ids) AS x(a), unnest(ids) AS y(b) WHERE a <> b),
n AS (SELECT a, count(*) AS k FROM p GROUP BY a)
SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS class_id, CAST(coalesce(k, 0) AS BIGINT) AS n_links FROM documents LEFT JOIN n ON a = doc_id WHERE text IS NOT NULL
""",
    "p10_stretches": _WINDOWS + """
, c AS (SELECT min(doc_id) AS doc_id FROM documents WHERE text IS NOT NULL GROUP BY text),
v AS (SELECT w.* FROM w JOIN c USING (doc_id)),
m AS (SELECT DISTINCT a.doc_id AS doc_id_a, b.doc_id AS doc_id_b, a.start AS pa, b.start AS pb, a.start - b.start AS shift FROM v a JOIN v b ON a.h = b.h AND a.doc_id < b.doc_id),
i AS (SELECT *, pa - row_number() OVER (PARTITION BY doc_id_a, doc_id_b, shift ORDER BY pa) AS island FROM m)
SELECT doc_id_a, doc_id_b, CAST(min(pa) AS INT) AS start_a, CAST(min(pb) AS INT) AS start_b, CAST(max(pa) - min(pa) + 200 AS INT) AS length FROM i GROUP BY doc_id_a, doc_id_b, shift, island
""",
    "p10_spans": _ISLANDS + "SELECT * FROM spans",
    "p10_shared": _ISLANDS + """
, t AS (SELECT doc_id, sum(length) AS n, count(*) AS k FROM spans GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(length(d.text), 0) AS BIGINT) AS n_chars, CAST(coalesce(t.n, 0) AS BIGINT) AS shared_chars, CAST(coalesce(t.k, 0) AS BIGINT) AS n_spans,
  CASE WHEN length(d.text) > 0 THEN round(coalesce(t.n, 0) / length(d.text), 6) ELSE 0.0 END AS shared_part
FROM documents d LEFT JOIN t USING (doc_id)
""",
}

QUERIES = {"p10_found": p10_found, "p10_links": p10_links, "p10_stretches": p10_stretches, "p10_spans": p10_spans, "p10_shared": p10_shared}
