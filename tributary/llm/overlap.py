"""Problem 6: the same or near-same records across splits, by Aho-Corasick scans.

Evaluation records are normalised to their words in lower case as they follow each other (the running form) and cut
into passages. The passages of a shard of records make one automaton, which scans the running form of the training
texts; matched intervals are merged into the part of each evaluation record that stands in training texts
(``coverage``), and into the part of a record that one text covers.

Passages are tiles of ``TILE`` consecutive words (the last one ends with the record; a shorter record is one tile),
matched wherever they stand in the training text, so that a record inside a longer text is seen. As near-sameness is
measured on sets of words and their order may change, the rarest words of a record are passages too: of its n
distinct words in one order for all records, rare ones first, the first n - ceil(t * n) + 1. Two sets that share t of
their union share one of these on either side, and a text of m words must hold all but n - c of them, where c is the
least number of common words; so pairs are chosen where that many of the rarest words are matched, none is lost, and
the sets of words of the chosen ones are compared.

Volume: each training text goes only to the shards that own one of its passages, as a join of passage hashes tells;
shards and blocks hold a bounded amount of text, and a block has at least as much text as the shard that joins it, so that what
is shuffled grows with the texts and the matches and not with their product. Exact copies (the same running form)
are folded into one class before. Only the ``LISTED`` most frequent words, up to ``LISTED_LENGTH`` characters long,
are sent to all tasks; they stand last in the order of words, by count, and all others first by their hash.

Defined results: words are maximal runs of letters, digits and underscores in lower case; a record
without words has no overlap with any; the role of a split is that of its latest sealing, without outer
blanks and in lower case; records without split or key are left out; a pair is given once. Empty tables
give no rows. Extra columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.versions import latest_version
from ..queries.tables import table
from ..session import durable

SIMILAR = 0.7
TILE = 5
SHARD_CHARACTERS = 4_000_000
BLOCK_CHARACTERS = 8_000_000
LISTED = 20_000
LISTED_LENGTH = 64


def tokens_of(column: str):
    """The words of a text in their order."""
    return F.regexp_extract_all(F.lower(column), F.lit(r"([\p{L}\p{N}_]+)"), F.lit(1))


def least_common(n, m, similar: float):
    """The least number of common words of near-same sets of n and m words."""
    return np.ceil(similar / (1 + similar) * (n + m) - 1e-9).astype(np.int64)


def rarest(n: int, similar: float) -> int:
    """How many of n words, from the rarest on, are passages."""
    return n - math.ceil(similar * n - 1e-9) + 1


def tiles(tokens: list[str]) -> list[tuple[int, int]]:
    """(begin, end) of the tiles of a record."""
    n = len(tokens)
    if n <= TILE:
        return [(0, n)] if n else []
    return [(i, i + TILE) for i in range(0, n - TILE + 1, TILE)] + ([(n - TILE, n)] if n % TILE else [])


def frequent_words(texts: DataFrame, column: str = "running", listed: int = LISTED) -> dict[str, int]:
    """The most frequent words with their rank from the rarest on: at most ``listed`` words of ``LISTED_LENGTH`` characters."""
    words = texts.select(F.explode(F.array_distinct(F.split(F.trim(column), " "))).alias("word")).filter(F.length("word") <= LISTED_LENGTH)
    top = words.groupBy("word").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "word").limit(listed).collect()
    return {r["word"]: len(top) - i for i, r in enumerate(top)}


def prepared(texts: DataFrame, listed: dict[str, int], similar: float, short: list[int]) -> DataFrame:
    """(side, class, running, rare, routes): the running form, its rarest words and the hashes of the passages.

    ``short`` are the lengths of evaluation records of less than a tile.
    """
    import xxhash

    shared = texts.sparkSession.sparkContext.broadcast(listed)
    lengths = [TILE, *short]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank, h = shared.value, xxhash.xxh64_intdigest
        for batch in batches:
            rare, routes = [], []
            for side, text in zip(batch.column("side").to_pylist(), batch.column("running").to_pylist()):
                words = text.split(" ")[1:-1]
                order = sorted(set(words), key=lambda w: (rank.get(w, 0), h(w), w))
                order = order[: rarest(len(order), similar)]
                if side == "eval":
                    spans = [words[a:b] for a, b in tiles(words)]
                else:
                    spans = [words[i : i + k] for k in lengths for i in range(len(words) - k + 1)]
                own = {*order, *(" ".join(s) for s in spans)}
                rare.append(" ".join(order))
                routes.append(np.unique(np.fromiter((h(p) for p in own), np.uint64, len(own))).astype(np.int64))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("side", "class", "running")), pa.array(rare, pa.string()), pa.array(routes, pa.list_(pa.int64()))], names=["side", "class", "running", "rare", "routes"])

    return texts.select("side", "class", "running").mapInArrow(run, "side string, class binary, running string, rare string, routes array<bigint>")


def matched(records: pd.DataFrame, texts: pd.DataFrame, similar: float) -> pd.DataFrame:
    """Scan the texts by the automaton of the records: near-same pairs (train, eval, similarity, covered) and merged intervals (eval, begin, end)."""
    import ahocorasick

    numbers: dict[str, int] = {}
    owners: list[list[int]] = []  # of the passages that are rare words of a record
    sets, parts_of, n_tiles, n_words = [], [], [], []
    for i, (running, rare) in enumerate(zip(records["running"], records["rare"])):
        words = running.split(" ")[1:-1]
        sets.append(frozenset(words))
        own = [(a, b, f" {' '.join(words[a:b])} ") for a, b in tiles(words)]
        n_tiles.append(len(own))
        n_words.append(len(words))
        first = set(rare.split(" "))
        own += [(a, a + 1, f" {w} ") for a, w in enumerate(words) if w in first]
        for _, _, passage in own:
            if passage not in numbers:
                numbers[passage] = len(owners)
                owners.append([])
        for word in first:
            owners[numbers[f" {word} "]].append(i)
        parts_of.append([((a, b), numbers[p]) for a, b, p in own])
    keys = records["class"].tolist()
    n = np.array([len(s) for s in sets], dtype=np.int64)
    first_n = np.array([rarest(int(c), similar) for c in n], dtype=np.int64)
    owned = [np.array(o, dtype=np.int64) for o in owners]
    seen: set[int] = set()
    pairs: list[tuple[bytes, bytes, float, float]] = []
    if numbers:
        automaton = ahocorasick.Automaton()
        for passage, number in numbers.items():
            automaton.add_word(passage, number)
        automaton.make_automaton()
        for text, running in zip(texts["class"], texts["running"]):
            hit = {p for _, p in automaton.iter(running)}
            if not hit:
                continue
            seen |= hit
            near, count = np.unique(np.concatenate([owned[p] for p in hit]), return_counts=True)
            mine = frozenset(running.split(" ")[1:-1])
            m = len(mine)
            least = first_n[near] - (n[near] - least_common(n[near], m, similar))
            for i in near[(count >= least) & (n[near] >= similar * m - 1e-9) & (similar * n[near] <= m + 1e-9)].tolist():
                both = len(mine & sets[i])
                union = m + len(sets[i]) - both
                if both >= similar * union - 1e-9:
                    covered = sum(b - a for a, b in merge([span for span, p in parts_of[i] if p in hit]))
                    pairs.append((text, keys[i], both / union, covered / n_words[i]))
    merged = []
    for i, key in enumerate(keys):
        merged += [(key, a, b) for a, b in merge([span for span, p in parts_of[i][: n_tiles[i]] if p in seen])]
    return pd.concat([pd.DataFrame(pairs, columns=["train", "eval", "similarity", "covered"]), pd.DataFrame(merged, columns=["eval", "begin", "end"]).astype({"begin": "Int32", "end": "Int32"})])[["train", "eval", "similarity", "covered", "begin", "end"]]


def merge(intervals: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(intervals):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def scan(texts: DataFrame, similar: float = SIMILAR, shard_characters: int = SHARD_CHARACTERS, block_characters: int = BLOCK_CHARACTERS) -> DataFrame:
    """(train, eval, similarity, covered) of near-same classes, and (eval, begin, end) of the matched intervals of each, from (side, class, running)."""
    size = texts.filter("side = 'eval'").agg(
        F.sum(F.length("running").cast("bigint")).alias("n"), F.collect_set(F.when(F.size(F.split("running", " ")) < TILE + 2, F.size(F.split("running", " ")) - 2)).alias("short")).first()
    shards = max(1, -(-(size["n"] or 0) // shard_characters))
    known = durable(prepared(texts, frequent_words(texts), similar, sorted(size["short"])), "texts")
    shard = F.pmod(F.xxhash64("class"), F.lit(shards)).cast("int")
    records = known.filter("side = 'eval'").withColumn("shard", shard)
    train = known.filter("side = 'train'")
    owned = records.select(F.explode("routes").alias("route"), "shard").distinct()
    routed = train.select("class", F.explode("routes").alias("route")).join(owned, "route").select("class", "shard").distinct()
    sent = durable(routed.join(train.select("class", "running"), "class"), "sent")
    total = sent.agg(F.sum(F.length("running").cast("bigint"))).first()[0] or 0
    blocks = max(1, -(-total // (shards * block_characters)))
    # a block has more text than the shard it is joined with, so copies of shards do not outgrow the texts
    sent = sent.withColumn("block", F.pmod(F.xxhash64("class", F.lit(2)), F.lit(blocks)).cast("int"))
    ready = records.select("class", "running", "rare", "shard", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    schema = "train binary, eval binary, similarity double, covered double, begin int, end int"
    return sent.groupBy("shard", "block").cogroup(ready.groupBy("shard", "block")).applyInPandas(lambda t, r: matched(r, t, similar), schema)


def split_roles(manifest: DataFrame) -> DataFrame:
    """(split_file, role) of the latest sealing."""
    held = latest_version(manifest.filter("split_file is not null"), "split_file", "sealed_at")
    return held.select("split_file", F.lower(F.regexp_replace("split_role", r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")).alias("role"))


def labelled_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    questions = table(spark, sf_dir, "questions").select("question_key", "split_file", "benchmark", "question", "ingested_ts")
    held = latest_version(questions, "question_key").filter("question_key is not null")
    roles = split_roles(table(spark, sf_dir, "split_manifest").select("split_file", "split_role", "sealed_at"))
    # the manifest has one row a split; Spark broadcasts it where it is small
    return held.join(roles, "split_file").select("question_key", "split_file", "benchmark", "role", "question")


class Overlap:
    """The overlap of training and evaluation records of (question_key, role, question and what else a report needs)."""

    def __init__(self, records: DataFrame, similar: float = SIMILAR, evaluation_roles: tuple[str, ...] = ("heldout", "test"), **sizes: int):
        side = F.when(F.col("role") == "train", "train").when(F.col("role").isin(*evaluation_roles), "eval")
        words = tokens_of("question")
        running = F.when(F.size(words) > 0, F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" ")))
        named = records.withColumn("side", side).filter("side is not null").withColumn("running", running).drop("question")
        self.records = durable(named.withColumn("class", F.substring(F.unhex(F.sha2("running", 256)), 1, 16)), "records")
        held = self.records.filter("running is not null")
        texts = durable(held.groupBy("side", "class").agg(F.first("running").alias("running")), "classes")
        self.found = durable(scan(texts, similar, **sizes), "found")

    def members(self, side: str, *columns: str) -> DataFrame:
        return self.records.filter((F.col("side") == side) & F.col("class").isNotNull()).select(F.col("class").alias(side), *columns)

    def pairs(self) -> DataFrame:
        """(train_key, eval_key, similarity, covered) of all members of near-same classes."""
        links = self.found.filter("train is not null").select("train", "eval", "similarity", "covered")
        key = F.col("question_key")
        return links.join(self.members("train", key.alias("train_key")), "train").join(self.members("eval", key.alias("eval_key")), "eval")

    def coverage(self) -> DataFrame:
        """(eval class, covered, spans): matched words and merged intervals of each evaluation text."""
        parts = self.found.filter("begin is not null").groupBy("eval").agg(F.array_sort(F.collect_set(F.struct("begin", "end"))).alias("parts"))
        start = F.struct(F.lit(0).alias("covered"), F.lit(0).alias("spans"), F.lit(-1).alias("upto"))

        def step(state, part):
            fresh = part["begin"] > state["upto"]
            return F.struct(
                (state["covered"] + F.greatest(F.lit(0), part["end"] - F.greatest(part["begin"], state["upto"]))).alias("covered"),
                (state["spans"] + fresh.cast("int")).alias("spans"), F.greatest(state["upto"], part["end"]).alias("upto"))

        return parts.select("eval", F.aggregate("parts", start, step).alias("s")).select("eval", "s.covered", "s.spans")

    def partners(self) -> DataFrame:
        """(eval class, partners, best): training members and the greatest similarity; classes are counted, not expanded."""
        sizes = self.members("train").groupBy("train").agg(F.count("*").alias("n"))
        return self.found.filter("train is not null").join(sizes, "train").groupBy("eval").agg(F.sum("n").alias("partners"), F.max("similarity").alias("best"))

    def evaluated(self, *columns: str) -> DataFrame:
        """Every evaluation record with its words, covered words, spans, partners and best similarity."""
        whole = self.records.filter("side = 'eval'").select("question_key", *columns, F.col("class").alias("eval"), F.coalesce(F.size(F.split("running", " ")) - 2, F.lit(0)).alias("n_words"))
        whole = whole.join(self.coverage(), "eval", "left").join(self.partners(), "eval", "left")
        return whole.select("question_key", *columns, "n_words", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("covered", "spans")), F.coalesce("partners", F.lit(0)).cast("bigint").alias("partners"), F.coalesce("best", F.lit(0.0)).alias("best"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = Overlap(labelled_questions(spark, sf_dir)).pairs()
    return pairs.select(F.least("train_key", "eval_key").alias("question_key_a"), F.greatest("train_key", "eval_key").alias("question_key_b"))


def p6_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of each evaluation question stands in training questions, and how many near-same partners it has."""
    return Overlap(labelled_questions(spark, sf_dir)).evaluated().select("question_key", "n_words", "covered", "spans", "partners")


def p6_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per evaluation split and benchmark: records, how many overlap with training, and how many of their words stand there."""
    whole = Overlap(labelled_questions(spark, sf_dir)).evaluated("split_file", "benchmark", "role")
    return whole.groupBy("split_file", "benchmark", "role").agg(
        F.count("*").alias("questions"), F.count_if(F.col("partners") > 0).alias("overlapping"), F.sum("partners").alias("pairs"), F.count_if(F.col("best") >= 1).alias("same_words"),
        F.sum("n_words").alias("words"), F.sum("covered").alias("covered_words"), F.count_if((F.col("n_words") > 0) & (F.col("covered") == F.col("n_words"))).alias("covered_whole"))


_PAIRS = r"""
WITH held AS (SELECT * FROM questions WHERE question_key IS NOT NULL QUALIFY row_number() OVER (PARTITION BY question_key ORDER BY ingested_ts DESC NULLS LAST) = 1),
roles AS (SELECT split_file, lower(trim(split_role)) AS role FROM split_manifest WHERE split_file IS NOT NULL QUALIFY row_number() OVER (PARTITION BY split_file ORDER BY sealed_at DESC NULLS LAST) = 1),
q AS (SELECT question_key, split_file, benchmark, role, x, list_distinct(x) AS w FROM (SELECT question_key, split_file, benchmark, role, regexp_extract_all(lower(question), '[\p{L}\p{N}_]+') AS x FROM held JOIN roles USING (split_file))),
pairs AS (
  SELECT t.question_key AS t, e.question_key AS e, len(list_intersect(t.w, e.w)) AS c, len(t.w) + len(e.w) AS n
  FROM q t JOIN q e ON t.role = 'train' AND e.role IN ('heldout', 'test') AND len(t.w) > 0 AND len(e.w) > 0 AND len(t.w) * 10 >= len(e.w) * 7 AND len(e.w) * 10 >= len(t.w) * 7
), hits AS (SELECT t, e, c / (n - c) AS s FROM pairs WHERE c * 10 >= (n - c) * 7)
"""
_COVERAGE = _PAIRS + """
, tile AS (
  SELECT DISTINCT question_key, k AS b, ' ' || array_to_string(x[k + 1 : k + least(len(x), 5)], ' ') || ' ' AS passage, k + least(len(x), 5) AS f
  FROM (SELECT question_key, x, unnest(list_distinct(list_append(CASE WHEN len(x) > 5 THEN range(0, len(x) - 4, 5) ELSE [0] END, greatest(len(x) - 5, 0)))) AS k FROM q WHERE role IN ('heldout', 'test') AND len(x) > 0)
), texts AS (SELECT DISTINCT ' ' || array_to_string(x, ' ') || ' ' AS running FROM q WHERE role = 'train' AND len(x) > 0),
passages AS (SELECT passage FROM (SELECT DISTINCT passage FROM tile) p WHERE EXISTS (SELECT 1 FROM texts WHERE contains(running, passage))),
word AS (SELECT DISTINCT question_key, unnest(range(b, f)) AS at FROM tile JOIN passages USING (passage)),
edge AS (SELECT t.question_key, t.b, t.f, max(t.f) OVER (PARTITION BY t.question_key ORDER BY t.b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM tile t JOIN passages USING (passage)),
span AS (SELECT question_key, count(*) AS spans FROM edge WHERE before IS NULL OR b > before GROUP BY question_key),
cov AS (SELECT question_key, count(*) AS covered FROM word GROUP BY question_key),
per AS (SELECT e, count(*) AS p, max(s) AS best FROM hits GROUP BY e),
whole AS (
  SELECT q.question_key, split_file, benchmark, role, coalesce(len(x), 0) AS n_words, coalesce(covered, 0) AS covered, coalesce(spans, 0) AS spans, coalesce(p, 0) AS partners, coalesce(best, 0) AS best
  FROM q LEFT JOIN cov USING (question_key) LEFT JOIN span USING (question_key) LEFT JOIN per ON per.e = q.question_key WHERE role IN ('heldout', 'test')
)
"""
SQL = {
    "p6_found": _PAIRS + "SELECT least(t, e) AS question_key_a, greatest(t, e) AS question_key_b FROM hits",
    "p6_coverage": _COVERAGE + "SELECT question_key, CAST(n_words AS INT) AS n_words, CAST(covered AS INT) AS covered, CAST(spans AS INT) AS spans, CAST(partners AS BIGINT) AS partners FROM whole",
    "p6_report": _COVERAGE + """
SELECT split_file, benchmark, role, count(*) AS questions, count(*) FILTER (partners > 0) AS overlapping, CAST(sum(partners) AS BIGINT) AS pairs, count(*) FILTER (best >= 1) AS same_words,
  CAST(sum(n_words) AS BIGINT) AS words, CAST(sum(covered) AS BIGINT) AS covered_words, count(*) FILTER (n_words > 0 AND covered = n_words) AS covered_whole
FROM whole GROUP BY split_file, benchmark, role
""",
}
QUERIES = {"p6_found": p6_found, "p6_coverage": p6_coverage, "p6_report": p6_report}
