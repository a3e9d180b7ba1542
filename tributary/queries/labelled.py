"""A small repository whose edges are labelled by hand, for what extraction finds in source text: precision and recall against the labels."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..extract.assemble import lineage_of
from ..extract.symbols import Registry
from ..operators import lineage as L
from ..operators.closure import closure
from ..operators.metrics import set_prf
from ..session import durable
from .registry import Registry as Queries

query = Queries()

FILES = {
    "config/settings.py": 'CATALOG = "main"\nSILVER = CATALOG + ".silver"\nMIN_SIZE = 10\nclass Tables:\n    ORDERS = "main.raw.orders"\n',
    "other/settings_of_others.py": 'TABLE = "wrong.table"\n',
    "ddl/tables.sql": "-- declared\nCREATE TABLE main.raw.people (id STRING, city STRING, born DATE);\nCREATE TABLE IF NOT EXISTS main.raw.visits (person STRING, day DATE, minutes INT);\n",
    "common/names.py": 'AREA = "north"\n',
    "bronze/load.py": '''from pyspark.sql import functions as F
def load(folder, table):
    return spark.read.json(folder).withColumn("seen", F.current_timestamp()).write.mode("append").saveAsTable(table)
load("/landing/visits", "main.raw.visits")
load("s3://drop/people", "main.raw.people")
''',
    "silver/people.py": '''from config.settings import SILVER
from config import settings
import other.settings_of_others as others
from pyspark.sql import functions as F, Window
people = spark.table("main.raw.people")
kept = people.filter(F.col("born") > "1900-01-01").withColumn("year", F.year("born"))
w = Window.partitionBy("city").orderBy(F.desc("born"))
ranked = kept.withColumn("n", F.row_number().over(w))
named = ranked.select("id", F.upper("city").alias("town"), "year", "n")
named.write.mode("overwrite").saveAsTable(f"{SILVER}.people")
odd = spark.table(others.MISSING)
big = spark.table(settings.Tables.ORDERS).where("amount > 5 and state = 'x'")
''',
    "silver/visits.py": '''# Databricks notebook source
# MAGIC %run ../common/names
# COMMAND ----------
from pyspark.sql import functions as F
visits = spark.table("main.raw.visits")
known = spark.table("main.silver.people")
seen = visits.join(known, visits["person"] == known["id"], "left_semi")
sized = seen.withColumn("size", F.when(F.col("minutes") > 60, "long").when(F.col("minutes") > 10, "mid").otherwise("short"))
# COMMAND ----------
by = sized.groupBy("person").agg(F.sum("minutes").alias("total"), F.countDistinct("day").alias("days"))
by.write.insertInto(f"main.{AREA}.visits")
wide = sized.groupBy("person").pivot("size", ["long", "short"]).agg(F.sum("minutes"))
wide.write.format("delta").save("/out/wide")
''',
    "gold/job.py": '''from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
class Job:
    def __init__(self):
        self.session = SparkSession.builder.appName("job").getOrCreate()
        self.base = self.session.table("main.north.visits")
    def clean(self, df: DataFrame) -> DataFrame:
        return df.dropDuplicates(["person"])
    def run(self):
        top = self.clean(self.base).orderBy(F.desc("total")).limit(5)
        top.write.saveAsTable("main.gold.top")
def unused(frame: DataFrame):
    late = frame.drop("total", "days")
    late.write.parquet("/out/late")
def shout(df):
    return df.withColumn("loud", F.upper("person"))
session = SparkSession.getActiveSession()
told = session.table("main.gold.top").transform(shout)
''',
    "gold/pipes.py": '''from pyspark import pipelines as dp
from pyspark.sql.functions import col, sha1
@dp.table(name="main.gold.hashed")
def hashed():
    return spark.readStream.table("main.silver.people").withColumn("key", sha1(col("id")))
@dp.materialized_view()
def cities():
    return dp.read("hashed_source").select(col("town"))
''',
    "gold/query.ipynb": json.dumps({"cells": [
        {"cell_type": "markdown", "source": ["# title"]},
        {"cell_type": "code", "source": ["q = spark.sql('''WITH t AS (SELECT town, count(*) AS n FROM main.silver.people GROUP BY town)\n", "SELECT town, n * 2 AS twice FROM t WHERE n > 3''')\n"]},
        {"cell_type": "code", "source": ["pair = spark.createDataFrame([(1, 2)]).toDF('a', 'b')\n", "q.unionByName(q).writeStream.format('delta').toTable('main.gold.towns')"]},
    ]}),
    "gold/more.sql": "INSERT INTO main.gold.sums SELECT p.town, v.total FROM main.silver.people p JOIN main.north.visits v ON p.id = v.person;\nCREATE OR REPLACE TABLE main.gold.copy AS SELECT * FROM main.gold.sums;\nMERGE INTO main.gold.aim AS a USING main.gold.sums AS s ON a.town = s.town WHEN MATCHED THEN UPDATE SET *;\n",
    "gold/sinks.py": '''from shop.sinks import KeyedSink
from shop.tools import suffix_all, keeps, mystery
raw = spark.table("main.raw.people")
tail = suffix_all(raw.select("id", "city"), "_p")
sink = KeyedSink(table="main.gold.keyed", keys=["id_p"])
sink.run(keeps(tail))
lost = mystery(tail)
flat = tail.toDF("who", "where")
filled = flat.na.fill("?")
both = filled.crossJoin(lost).rollup("who").count()
''',
}

# Labels, one edge a line: kind | file | from | to | what. Nodes are named by their variable, unnamed ones and those of
# SQL texts are "_"; what: derives output<columns, filters columns, joins right:type:left=right, aggregates keys:output=op(input),
# projects +kept or -removed, writes mode, opaque operator.
LABELS = """
reads | bronze/load.py | ext:/landing/visits | _ |
derives | bronze/load.py | _ | _ | seen<
writes | bronze/load.py | _ | table:main.raw.visits | append
reads | bronze/load.py | ext:s3://drop/people | _ |
writes | bronze/load.py | _ | table:main.raw.people | append
reads | silver/people.py | table:main.raw.people | people |
filters | silver/people.py | people | _ | born
derives | silver/people.py | _ | kept | year<born
derives | silver/people.py | kept | ranked | n<city,born
derives | silver/people.py | ranked | named | town<city
projects | silver/people.py | ranked | named | +id,town,year,n
writes | silver/people.py | named | table:main.silver.people | overwrite
reads | silver/people.py | <unresolved> | odd |
reads | silver/people.py | table:main.raw.orders | _ |
filters | silver/people.py | _ | big | amount,state
reads | silver/visits.py | table:main.raw.visits | visits |
reads | silver/visits.py | table:main.silver.people | known |
joins | silver/visits.py | visits | seen | known:left_semi:person=id
derives | silver/visits.py | seen | sized | size<minutes
aggregates | silver/visits.py | sized | by | person:days=countDistinct(day),total=sum(minutes)
writes | silver/visits.py | by | table:main.north.visits | error
aggregates | silver/visits.py | sized | wide | person:long=sum(minutes),long=sum(size),short=sum(minutes),short=sum(size)
writes | silver/visits.py | wide | ext:/out/wide | error
reads | gold/job.py | table:main.north.visits | self.base |
opaque_transform | gold/job.py | self.base | _ | dropDuplicates
opaque_transform | gold/job.py | _ | _ | orderBy
opaque_transform | gold/job.py | _ | top | limit
writes | gold/job.py | top | table:main.gold.top | error
projects | gold/job.py | <unresolved> | late | -total,days
writes | gold/job.py | late | ext:/out/late | error
reads | gold/job.py | table:main.gold.top | _ |
derives | gold/job.py | _ | _ | loud<person
reads | gold/pipes.py | table:main.silver.people | _ |
derives | gold/pipes.py | _ | _ | key<id
writes | gold/pipes.py | _ | table:main.gold.hashed | overwrite
reads | gold/pipes.py | table:hashed_source | _ |
projects | gold/pipes.py | _ | _ | +town
writes | gold/pipes.py | _ | table:cities | overwrite
reads | gold/query.ipynb | table:main.silver.people | _ |
aggregates | gold/query.ipynb | _ | t | town:n=count(*)
filters | gold/query.ipynb | t | _ | n
derives | gold/query.ipynb | _ | q | twice<n
projects | gold/query.ipynb | _ | q | +town,twice
reads | gold/query.ipynb | <unresolved> | _ |
opaque_transform | gold/query.ipynb | _ | pair | toDF
opaque_transform | gold/query.ipynb | q | _ | unionByName
writes | gold/query.ipynb | _ | table:main.gold.towns | append
reads | gold/more.sql | table:main.silver.people | _ |
reads | gold/more.sql | table:main.north.visits | _ |
joins | gold/more.sql | _ | _ | _:inner:id=person
projects | gold/more.sql | _ | _ | +town,total
writes | gold/more.sql | _ | table:main.gold.sums | append
reads | gold/more.sql | table:main.gold.sums | _ |
opaque_transform | gold/more.sql | _ | _ | select *
writes | gold/more.sql | _ | table:main.gold.copy | overwrite
writes | gold/more.sql | _ | table:main.gold.aim | merge
reads | gold/sinks.py | table:main.raw.people | raw |
projects | gold/sinks.py | raw | _ | +id,city
derives | gold/sinks.py | _ | tail | id_p<id
derives | gold/sinks.py | _ | tail | city_p<city
opaque_transform | gold/sinks.py | tail | _ | keeps
writes | gold/sinks.py | _ | table:main.gold.keyed | merge
opaque_transform | gold/sinks.py | tail | lost | mystery
derives | gold/sinks.py | tail | flat | who<id_p
derives | gold/sinks.py | tail | flat | where<city_p
opaque_transform | gold/sinks.py | flat | filled | na.fill
joins | gold/sinks.py | filled | _ | lost:cross:
aggregates | gold/sinks.py | _ | both | who:count=count(*)
"""

REGISTRY = Registry({"suffix_all": {"kind": "suffix_rename", "suffix_arg": 1}, "keeps": {"kind": "passthrough"}}, {"KeyedSink": {"target_kwarg": "table", "merge_keys_kwarg": "keys", "default_mode": "merge"}})


def labels() -> list[tuple[str, ...]]:
    return [tuple(part.strip() for part in line.split(" |")) for line in LABELS.strip().split("\n")]


def labelled_edges(spark: SparkSession) -> DataFrame:
    """The edges that extraction finds in the repository, in the form of the labels."""
    e = lineage_of(spark, spark.createDataFrame(list(FILES.items()), "rel_path string, content string"), REGISTRY)["edges"]

    def node(column: str):
        name = F.regexp_extract(column, r"^df:.*:([^:@]*)(?:@\d+)?$", 1)
        return F.when(F.col(column).startswith("df:"), F.when(name.rlike(r"^(?:_|_\d+|sql\d+_\d+)$"), "_").otherwise(name)).otherwise(F.col(column))

    listed = lambda c: F.coalesce(F.array_join(c, ","), F.lit(""))
    keys = F.array_join(F.transform("join_keys", lambda k: F.concat(k["l"], F.lit("="), k["r"])), ",")
    aggs = F.array_join(F.array_sort(F.transform("aggs", lambda a: F.concat(a["output"], F.lit("="), a["op"], F.lit("("), a["input"], F.lit(")")))), ",")
    what = (
        F.when(F.col("kind") == "derives", F.concat("output_col", F.lit("<"), listed("source_cols")))
        .when(F.col("kind") == "filters", listed("referenced_cols"))
        .when(F.col("kind") == "joins", F.concat(node("right_source"), F.lit(":"), "join_type", F.lit(":"), F.coalesce(keys, F.lit(""))))
        .when(F.col("kind") == "aggregates", F.concat(listed("group_keys"), F.lit(":"), aggs))
        .when(F.col("kind") == "projects", F.when(F.col("kept_cols").isNotNull(), F.concat(F.lit("+"), listed("kept_cols"))).otherwise(F.concat(F.lit("-"), listed("removed_cols"))))
        .when(F.col("kind") == "writes", F.coalesce("write_mode", F.lit("")))
        .when(F.col("kind") == "opaque_transform", F.col("opaque_operator"))
        .otherwise(F.lit(""))
    )
    return e.select("kind", "file", node("source").alias("from_node"), node("target").alias("to_node"), what.alias("what")).distinct()


_TRUTH = "SELECT DISTINCT * FROM (VALUES " + ", ".join("(" + ", ".join("'" + p.replace("'", "''") + "'" for p in row) + ")" for row in labels()) + ") AS t(kind, file, from_node, to_node, what)"


@query(_TRUTH)
def extraction_edges(spark, d):
    """Every edge of the labelled repository: the labels themselves are the expected rows."""
    return labelled_edges(spark)


@query(f"""WITH t AS ({_TRUTH}) SELECT kind, count(*) AS tp, CAST(0 AS BIGINT) AS fp, CAST(0 AS BIGINT) AS fn, CAST(1 AS DOUBLE) AS precision, CAST(1 AS DOUBLE) AS recall, CAST(1 AS DOUBLE) AS f1 FROM t GROUP BY ROLLUP (kind)""")
def extraction_scored(spark, d):
    """Precision and recall of extraction by kind of edge, and over all."""
    key = F.concat_ws("|", "file", "from_node", "to_node", "what").alias("key")
    truth = spark.createDataFrame(labels(), "kind string, file string, from_node string, to_node string, what string")
    return set_prf(truth.select("kind", key), durable(labelled_edges(spark), "found").select("kind", key), "kind", "key")


# ---- scenarios ---------------------------------------------------------------------------------------------

# What a change of a column reaches, labelled by hand: scenario | seed | columns reached.
IMPACT = """
born | main.raw.people.born | main.silver.people.year main.silver.people.n main.gold.hashed.year main.gold.hashed.n
city | main.raw.people.city | main.silver.people.town main.silver.people.n main.gold.hashed.town main.gold.hashed.n main.gold.towns.town main.gold.sums.town main.gold.copy.town main.gold.aim.town main.gold.keyed.city_p
minutes | main.raw.visits.minutes | main.north.visits.total main.gold.top.total main.gold.sums.total main.gold.copy.total main.gold.aim.total /out/wide.long /out/wide.short
day | main.raw.visits.day | main.north.visits.days main.gold.top.days
nothing | main.raw.people.shoe_size |
"""

# Edits of one file: name | file | text | its replacement | breaking columns that go | columns that come.
EDITS = [
    ("rename used column", "silver/people.py", 'F.upper("city").alias("town")', 'F.upper("city").alias("place")', "main.silver.people.town", "main.silver.people.place main.gold.hashed.place"),
    ("drop used column", "silver/people.py", '"year", "n")', '"n")', "main.silver.people.year", ""),
    ("add column", "silver/visits.py", 'F.countDistinct("day").alias("days")', 'F.countDistinct("day").alias("days"), F.max("day").alias("last")', "", "main.north.visits.last main.gold.top.last"),
    ("drop unused column", "gold/sinks.py", 'raw.select("id", "city")', 'raw.select("id")', "", ""),
    ("change a threshold", "silver/visits.py", "> 60", "> 90", "", ""),
    ("comment", "gold/job.py", "from pyspark.sql import functions as F\n", "from pyspark.sql import functions as F\n# no change\n", "", ""),
]


def _lines(text: str) -> list[list[str]]:
    return [[p.strip() for p in line.split("|")] for line in text.strip().split("\n")]


def repositories(spark: SparkSession, held: dict[str, dict[str, str]]) -> DataFrame:
    """Edges of several repositories (name to files), each a graph of its own."""
    rows = [(f"{name}/{path}", text, name) for name, files in held.items() for path, text in files.items()]
    found = lineage_of(spark, spark.createDataFrame(rows, "rel_path string, content string, repo string"), REGISTRY)["edges"]
    inner = lambda c: F.regexp_replace(c, r"^df:[^/]*/", "df:")
    return found.withColumns({"graph_id": F.split_part("file", F.lit("/"), F.lit(1)), "source": inner("source"), "right_source": inner("right_source"), "target": inner("target")})


def _impact_truth() -> list[tuple[str, str, str]]:
    return [(name, seed, node) for name, seed, nodes in _lines(IMPACT) for node in nodes.split()]


def _values(rows, columns: str) -> str:
    return "SELECT * FROM (VALUES " + ", ".join("(" + ", ".join("'" + str(p).replace("'", "''") + "'" for p in row) + ")" for row in rows) + f") AS t({columns})"


@query(_values(_impact_truth(), "scenario, seed, node"))
def impact_scenarios(spark, d):
    """What each scenario's seed reaches: the hand labels are the expected rows."""
    fwd = durable(L.forward_index(L.provenance(repositories(spark, {"main": FILES}))), "forward")
    seeds = spark.createDataFrame([(name, seed) for name, seed, _ in _lines(IMPACT)], "seed string, node string")
    reach = closure(fwd.select("src", "dst"), seeds).select(F.col("seed").alias("scenario"), "node")
    return reach.join(seeds.withColumnRenamed("seed", "scenario").withColumnRenamed("node", "seed"), "scenario").select("scenario", "seed", "node")


@query("WITH t AS (" + _values(_impact_truth(), "scenario, seed, node") + ") SELECT scenario, count(*) AS tp, CAST(0 AS BIGINT) AS fp, CAST(0 AS BIGINT) AS fn, CAST(1 AS DOUBLE) AS precision, CAST(1 AS DOUBLE) AS recall, CAST(1 AS DOUBLE) AS f1 FROM t GROUP BY ROLLUP (scenario)")
def impact_eval(spark, d):
    """Seeded closures scored against the labelled scenarios, by scenario and pooled."""
    truth = spark.createDataFrame(_impact_truth(), "scenario string, seed string, node string")
    return set_prf(truth, durable(impact_scenarios(spark, d), "reach"), "scenario", "node")


@query(_values([(name, "removed", c, "breaking") for name, _, _, _, gone, _ in EDITS for c in gone.split()] + [(name, "added", c, "addition") for name, *_, come in EDITS for c in come.split()], "scenario, change, id, verdict"))
def diff_eval(spark, d):
    """Edits of the repository: columns that go though others depend on them, and columns that come; the hand labels are the expected rows."""
    edited = {name.replace(" ", "_"): {**FILES, path: FILES[path].replace(old, new)} for name, path, old, new, _, _ in EDITS}
    new = durable(repositories(spark, edited), "edited")
    before = repositories(spark, {"before": FILES})
    names = spark.createDataFrame([(n,) for n in edited], "name string")
    old = before.drop("graph_id").join(F.broadcast(names)).withColumnRenamed("name", "graph_id").select(*new.columns)
    found = L.graph_changes(old, new).filter("part = 'column' and (change = 'added' or n_downstream > 0)")
    return found.select(F.translate("graph_id", "_", " ").alias("scenario"), "change", "id", F.when(F.col("change") == "removed", "breaking").otherwise("addition").alias("verdict"))


QUERIES, SQL = query.queries, query.sql
