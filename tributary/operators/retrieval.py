"""Chunks, BM25 ranking and packing into a token budget."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

K1, B = 1.5, 0.75


def terms(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, term) of every identifier of a text, in lower case."""
    return df.select(key, F.explode(F.regexp_extract_all(F.lower(text), F.lit("([a-z_][a-z0-9_]*)"), F.lit(1))).alias("term"))


def bm25(documents: DataFrame, queries: DataFrame, key: str = "doc_id", text: str = "text", query_key: str = "query_id", query: str = "query") -> DataFrame:
    """(query_id, doc_id, score) of every document that shares a term with a query.

    idf = ln(1 + (N - df + 0.5) / (df + 0.5)); k1 = 1.5, b = 0.75. Only the terms of the queries are
    counted past the first aggregation; a repeated query term counts once. Documents without text have
    length 0 and match nothing.
    """
    held = terms(documents, key, text).groupBy(key, "term").agg(F.count("*").alias("tf"))
    lengths = documents.select(key, F.size(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("([a-z_][a-z0-9_]*)"), F.lit(1))).cast("double").alias("len"))
    n, average = lengths.agg(F.count("*"), F.avg("len")).first()
    wanted = terms(queries, query_key, query).distinct()
    hits = held.join(wanted, "term")
    df = held.join(wanted.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log(1 + (F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.lit(average or 1.0)))
    return hits.join(df, "term").join(lengths, key).groupBy(query_key, key).agg(F.sum(idf * weight).alias("score"))


def top_ranked(scored: DataFrame, by: str, key: str, k: int) -> DataFrame:
    w = Window.partitionBy(by).orderBy(F.desc("score"), key)
    return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def budget_pack(ranked: DataFrame, by: str, order: list, tokens: str, budget: int) -> DataFrame:
    """The rows of each group, in order, as long as their tokens fit; the first always."""
    w = Window.partitionBy(by).orderBy(*order)
    so_far = F.sum(tokens).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return ranked.withColumn("running", so_far).withColumn("__n", F.row_number().over(w)).filter((F.col("running") <= budget) | (F.col("__n") == 1)).drop("__n")


def chunks(df: DataFrame, key: str, text: str, most_tokens: int = 220) -> DataFrame:
    """(key, chunk, part, body, tokens): paragraphs of a text, those above ``most_tokens`` cut into windows of lines.

    A text is split at blank lines; tokens are estimated as a quarter of the characters. A line longer than
    a window stays whole. Null texts give no chunk.
    """
    paragraphs = df.select(key, F.posexplode(F.split(text, r"\n\s*\n")).alias("chunk", "paragraph")).filter("length(trim(paragraph)) > 0")
    lines = paragraphs.select(key, "chunk", F.posexplode(F.split("paragraph", "\n")).alias("line", "body"))
    size = F.ceil(F.length("body") / 4)
    w = Window.partitionBy(key, "chunk").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    placed = lines.withColumn("part", F.floor(F.coalesce(F.sum(size).over(w), F.lit(0)) / most_tokens).cast("int"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "body"))), lambda x: x["body"]), "\n")
    return placed.groupBy(key, "chunk", "part").agg(joined.alias("body")).withColumn("tokens", F.ceil(F.length("body") / 4).cast("bigint"))


def code_chunks(files: DataFrame, key: str, text: str) -> DataFrame:
    """(key, chunk, first_line, last_line, body_md5, kind) of Python text: cut before each notebook cell mark and each top-level definition.

    Null texts give no rows, an empty one a single empty chunk.
    """
    lines = files.select(key, F.posexplode(F.split(F.regexp_replace(text, r"\r\n|\r", "\n"), "\n", -1)).alias("line", "body")).withColumn("line", F.col("line") + 1)
    mark = F.when(F.col("body").rlike(r"^# COMMAND -+[ \t]*$"), 2).when(F.col("body").rlike(r"^(?:async +def|def|class) "), 1).otherwise(0)
    order = Window.partitionBy(key).orderBy("line")  # the lines of one file
    cut = lines.withColumn("mark", mark).withColumn("chunk", F.sum((F.col("mark") > 0).cast("bigint")).over(order))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "body"))), lambda x: x["body"]), "\n")
    kind = F.when(F.max("mark") == 2, "cell").when(F.max("mark") == 1, "definition").otherwise("head")
    return cut.groupBy(key, "chunk").agg(F.min("line").alias("first_line"), F.max("line").alias("last_line"), F.md5(body).alias("body_md5"), kind.alias("kind"))
