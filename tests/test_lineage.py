import json

import pytest
from conftest import rows
from pyspark.sql import functions as F

from tributary.cli import impact, main
from tributary.extract.assemble import EDGE, extract, lineage_of, script_texts, sql_rows
from tributary.extract.notebook import prepare, run_target
from tributary.extract.symbols import Registry
from tributary.operators import lineage as L
from tributary.operators.closure import closure
from tributary.operators.metrics import kappa, set_prf
from tributary.operators.relational import asof_join, upsert
from tributary.operators.retrieval import bm25, budget_pack, chunks
from tributary.plans.planmode import PlanLineage, provenance_rows
from tributary.plans.serialize import compact_graph, line_language, outline, page
from tributary.session import durable
from tributary.sources.repository import Scope, glob_regex, scan_repository

PIPELINE = '''# Databricks notebook source
# MAGIC %run ../config/setup
# COMMAND ----------
# MAGIC %md
# MAGIC # a title
# COMMAND ----------
from pyspark.sql import functions as F, Window
from shop.tools import suffix_all, mystery
from shop.sinks import MergeSink
RULES = {"big": F.col("amount") > 100, "late": F.col("days") > 3}
orders = spark.table(f"{CATALOG}.sales.orders")
people = spark.read.table("main.sales.people").filter(F.col("active")).filter(F.col("age") > 18)
joined = orders.join(people, (orders["pid"] == people["pid"]) & (orders["d"] == people["d"]), "leftouter").cache()
ranked = joined.withColumn("rn", F.row_number().over(Window.partitionBy("pid").orderBy(F.col("ts").desc())))
tiered = ranked.withColumn("tier", F.when(RULES["big"], "big").when(F.col("days") > 9, "late").otherwise("x"))
out = tiered.groupby("pid").agg(F.sum("amount").alias("total"))
sink = MergeSink(table="main.gold.totals", keys=["pid"])
sink.run(out)
boxes = orders.select("pid", F.array(F.struct(F.lit("a").alias("kind"), F.col("amount").alias("value"))).alias("parts"))
boxes.write.parquet("/data/boxes")
other = mystery(orders)
pairs = orders.crossJoin(people)
def load(path):
    return spark.read.json(path).withColumn("src", F.lit("x"))
events = load("/landing/events")
'''


@pytest.fixture(scope="module")
def found(spark):
    files = [("config/setup.py", 'CATALOG = "main"\n'), ("silver/p.py", PIPELINE), ("ddl/t.sql", "CREATE TABLE main.sales.orders (pid STRING, amount DECIMAL(18,2), days INT, ts TIMESTAMP, d DATE);\nCREATE TABLE main.lost (a INT);"), ("bad.py", "x = ("), ("n.ipynb", json.dumps({"cells": [{"cell_type": "markdown", "source": ["x = ("]}, {"cell_type": "code", "source": ["%sql\n", "select 1"]}, {"cell_type": "code", "source": ["a = spark.table('main.t')\n", "a.write.mode('append').saveAsTable('main.u')"]}]}))]
    return lineage_of(spark, spark.createDataFrame(files, "rel_path string, content string"), Registry({"suffix_all": {"kind": "suffix_rename", "suffix_arg": 1}}, {"MergeSink": {"target_kwarg": "table", "merge_keys_kwarg": "keys", "default_mode": "merge"}}))


def test_extraction(found):
    edges = {(r.kind, r.file, r.lineno): r for r in found["edges"].collect()}
    p = "silver/p.py"
    assert edges["reads", p, 12].source == "table:main.sales.people" and edges["reads", p, 11].source == "table:main.sales.orders"
    assert found["edges"].filter(f"kind = 'filters' and file = '{p}'").count() == 2
    join = found["edges"].filter(f"kind = 'joins' and file = '{p}' and lineno = 13").first()
    assert join.join_type == "left" and [(k.l, k.r) for k in join.join_keys] == [("pid", "pid"), ("d", "d")]
    assert edges["derives", p, 14].window_spec.partition_cols == ["pid"] and edges["derives", p, 14].window_spec.order_cols == ["ts desc"]
    rules = edges["derives", p, 15].rule_logic
    assert [r.cond for r in rules] == ["F.col('amount') > 100", "F.col('days') > 9", "otherwise"]
    agg = edges["aggregates", p, 16]
    assert agg.group_keys == ["pid"] and agg.aggs[0].output == "total"
    write = found["edges"].filter("kind = 'writes' and target = 'table:main.gold.totals'").first()
    assert write.write_mode == "merge" and write.merge_keys == ["pid"] and write.sink_class == "MergeSink"
    box = found["edges"].filter("output_col = 'parts'").first()
    assert [(f.field, f.kind) for f in box.struct_fields] == [("kind", "lit"), ("value", "col")]
    assert found["edges"].filter("target = 'ext:/data/boxes'").count() == 1
    assert found["edges"].filter("join_type = 'cross'").count() == 1
    assert found["edges"].filter("source = 'ext:/landing/events'").count() == 1
    assert found["edges"].filter("target = 'table:main.u' and source like '%cell2%'").count() == 1
    categories = {r.category for r in found["warnings"].collect()}
    assert {"syntax-error", "opaque-call-fallback", "orphan-table"} <= categories
    assert found["predicates"].count() == 2


def test_provenance_impact_and_texts(spark, found):
    prov = durable(L.provenance(found["edges"]))
    assert ("table:main.gold.totals", "total", "aggregate", "table:main.sales.orders", "amount") in rows(prov.drop("graph_id"))
    report = impact(spark, found["edges"], "sales.orders", "amount")
    assert report["status"] == "impact_detected" and "main.gold.totals.total" in report["impacted_columns"] and report["coverage_complete"] is False
    assert impact(spark, found["edges"], "nowhere", "amount_x")["status"] == "cannot_determine"
    assert "main.u" in str(impact(spark, found["edges"], "main.t", None)["impacted_tables"])
    text = line_language(found["edges"], prov, found["warnings"], found["predicates"])
    named = next(x for x in text.split("\n") if x.endswith("F.col('amount') > 100") and x.startswith("P")).split("|")[0]
    assert f"{named}>'big';" in text.split("@RULES")[1] and f"big={named}" in text.split("@PDICTS")[1] and f"{named}|1|1" in text.split("@PUSE")[1]
    ops = {(r.table, r.column): r.op for r in L.operations(found["edges"]).collect()}
    assert ops["table:main.gold.totals", "total"] == "sum" and ops["table:main.gold.totals", "pid"] == "group_key"
    assert "@PROV" in text and "main.gold.totals" in text and "|J|" not in text.split("@EDGES")[0]
    assert compact_graph(found["edges"], prov)["tables"]["table:main.gold.totals"]["total"]["role"] == "aggregate"
    assert "total<-" in outline(prov) and "<svg" in page(found["edges"], L.table_tiers(found["edges"]))
    key = found["edges"].select(L.edge_key(True).alias("key"))
    assert L.compare(key, key, ["key"]).filter("change <> 'same'").count() == 0


def test_walks_agree(spark):
    kinds = "graph_id string, kind string, source string, right_source string, target string, output_col string, source_cols array<string>, aggs array<struct<op:string,input:string,output:string>>, group_keys array<string>, kept_cols array<string>, is_passthrough boolean"
    e = lambda kind, s, t, **h: ("g", kind, s, h.get("r"), t, h.get("o"), h.get("c"), h.get("a"), h.get("k"), h.get("keep"), h.get("p"))
    edges = spark.createDataFrame([e("reads", "table:a", "d1"), e("reads", "table:b", "d2"), e("joins", "d1", "d3", r="d2"), e("derives", "d3", "d4", o="x", c=["u", "v"]), e("derives", "d3", "d4", o="none", c=[]), e("opaque_transform", "d4", "d5", p=False), e("filters", "d4", "d6"), e("aggregates", "d6", "d7", a=[("sum", "x", "s")], k=["u"]), e("writes", "d7", "table:t"), e("writes", "d5", "table:lost"), e("projects", "d4", "d8", keep=["x"]), e("writes", "d8", "table:p"), e("writes", "table:a", "table:copy")], kinds)
    near, far = rows(L.provenance(edges)), rows(L.provenance(edges, group_rows=0))
    assert near == far
    assert ("g", "table:t", "s", "aggregate", "table:b", "v") in near and ("g", "table:p", "x", "derived", "table:a", "u") in near
    assert not [r for r in near if r[1] == "table:lost"] and not L.provenance(edges.limit(0)).collect()


def test_extract_static_is_whole(spark, tmp_path):
    from datetime import datetime

    from tributary.queries.plans import QUERIES

    code = 'spark.table(f"{CATALOG}.t").write.saveAsTable("u")\nq = spark.sql("SELECT a, count(*) AS n FROM held GROUP BY a")\n'
    files = [("1", "x", "config/setup.py", 'CATALOG = "one"\n'), ("2", "x", "job.py", code), ("3", "y", "conf/c.py", 'CATALOG = "two"\n'), ("4", "y", "job.py", code), ("5", "z", "job.py", code), ("6", "z", "s.sql", "INSERT INTO aim SELECT b FROM origin;\nSELECT 1 FROM")]
    spark.createDataFrame([(*f, datetime(2024, 1, 1)) for f in files], "file_id string, repo string, rel_path string, content string, ingested_ts timestamp").write.parquet(f"{tmp_path}/source_files.parquet")
    edges = QUERIES["extract_static"](spark, str(tmp_path)).collect()
    reads = {(e.file, e.source) for e in edges if e.kind == "reads"}
    assert {("x/job.py", "table:one.t"), ("y/job.py", "table:two.t"), ("z/job.py", "<unresolved>"), ("z/s.sql", "table:origin")} <= reads
    assert {e.file for e in edges if e.source == "table:held"} == {"x/job.py", "y/job.py", "z/job.py"}
    assert [(e.target, e.write_mode) for e in edges if e.file == "z/s.sql" and e.kind == "writes"] == [("table:aim", "append")]


def test_sql_texts_in_batches(spark):
    files = spark.createDataFrame([(f"f{i}.sql", f"SELECT a{i} AS b FROM t{i}") for i in range(7)], "rel_path string, content string")
    got = sql_rows(spark, script_texts(files), batch=3).filter("row_type = 'table'")
    assert rows(got.select("rel_path", F.get_json_object("payload", "$.fqn"))) == [(f"f{i}.sql", f"t{i}") for i in range(7)]


def lineage_of_texts(spark, monkeypatch, *texts):
    """(row_type, payload) by text; none of them may come to the driver."""
    from pyspark.sql.classic.dataframe import DataFrame

    held = spark.createDataFrame([(f"f{i}.sql", 0, 3, None, t) for i, t in enumerate(texts)], "rel_path string, ordinal int, lineno int, target string, sql string")
    with monkeypatch.context() as patch:
        for way in ("toLocalIterator", "collect", "toPandas", "toArrow", "take"):
            patch.setattr(DataFrame, way, lambda *_: pytest.fail("the driver asked for rows"))
        got = sql_rows(spark, held)
    out = [[] for _ in texts]
    for r in got.orderBy("rel_path", "ordinal").collect():
        out[int(r.rel_path[1:-4])].append((r.row_type, json.loads(r.payload)))
    return out


def test_sql_texts_are_parsed_in_the_executors(spark, monkeypatch):
    ranked = "CREATE TABLE u AS WITH c AS (SELECT a, rank() OVER (PARTITION BY p ORDER BY q DESC) AS r FROM t) SELECT CASE WHEN r > 1 THEN a ELSE 0 END AS x FROM c JOIN d USING (a) WHERE r < 9"
    merged = "MERGE INTO m.n AS t USING s ON t.id = s.key AND t.v > 1 WHEN MATCHED THEN UPDATE SET t.v = s.v"
    first, second, third, fourth = lineage_of_texts(spark, monkeypatch, ranked, merged, "CREATE TABLE o (k INT, `l m` STRING)", "SELEC a")
    edges = {e["kind"]: e for kind, e in first if kind == "edge" and e.get("output_col") != "r"}
    assert next(e for kind, e in first if e.get("output_col") == "r")["window_spec"] == {"partition_cols": ["p"], "order_cols": ["q desc"], "frame": None}
    assert edges["derives"]["source_cols"] == ["r", "a"] and edges["derives"]["rule_logic"] == [{"cond": "(r > 1)", "value": "a"}, {"cond": "otherwise", "value": "0"}]
    assert edges["joins"]["join_keys"] == [{"l": "a", "r": "a"}] and edges["filters"]["referenced_cols"] == ["r"]
    assert (edges["writes"]["target"], edges["writes"]["write_mode"]) == ("table:u", "overwrite")
    assert [(e["target"], e["merge_keys"]) for kind, e in second if e.get("kind") == "writes"] == [("table:m.n", ["id"])]
    assert [e["columns"] for kind, e in third if kind == "table" and e["declared"]] == [["k", "l m"]]
    assert [(kind, e["category"]) for kind, e in fourth] == [("warning", "sql-parse-error")]


def test_odd_sql_texts_are_rows(spark, monkeypatch):
    deep = " UNION ALL ".join(f"SELECT a FROM t{i}" for i in range(3000))
    function, union, long, plain = lineage_of_texts(spark, monkeypatch, "INSERT INTO u SELECT id FROM range(9)", deep, "SELECT " + " + ".join(["a"] * 3000) + " AS s FROM t", "SELECT a FROM t")
    assert [e["target"] for kind, e in function if e.get("kind") == "writes"] == ["table:u"] and "warning" in {kind for kind, _ in function}
    assert union and long and [e["kind"] for kind, e in plain if kind == "edge"] == ["reads", "projects"]


def edges_of(text, path="p.py", **known):
    from tributary.extract.assemble import extract_text

    return [held for kind, held in extract_text(path, text, **known) if kind == "edge"], [held for kind, held in extract_text(path, text, **known) if kind == "warning"]


def test_long_predicates_differ(spark):
    ids = set()
    for last in ("1", "2"):
        parts = " & ".join(f"(F.col('column_{i}') > {i})" for i in range(200))
        found, _ = edges_of(f"a = spark.table('t').filter({parts} & (F.col('z') > {last}))")
        ids.add(found[-1]["expr_id"])
    assert len(ids) == 2


def test_calls_of_any_depth_and_in_circles():
    deep = "def f0(x):\n    return x.filter('a > 1')\n" + "".join(f"def f{i}(x):\n    return f{i - 1}(x)\n" for i in range(1, 30)) + "f29(spark.table('t')).write.saveAsTable('u')\n"
    found, _ = edges_of(deep)
    assert [e["kind"] for e in found] == ["reads", "filters", "writes"]
    found, _ = edges_of("def f(x):\n    return g(x)\ndef g(x):\n    return f(x.limit(1))\nf(spark.table('t')).write.saveAsTable('u')\n")
    assert {e["kind"] for e in found} >= {"reads", "writes"}


def test_constants_belong_to_their_module():
    found, warnings = edges_of("import config, other\na = spark.table(config.TABLE)\nb = spark.table(other.TABLE)\nTABLE = 'mine'\nc = spark.table(TABLE)\n", symbols={"config.TABLE": "x", "TABLE": "x"})
    assert [e["source"] for e in found] == ["table:x", "<unresolved>", "table:mine"]


def test_bodies_are_never_silent():
    found, _ = edges_of("class A:\n    def m(self):\n        self.spark.table('h.i').write.saveAsTable('j')\n")
    assert [e["kind"] for e in found] == ["reads", "writes"]
    found, _ = edges_of("session = SparkSession.builder.getOrCreate()\ntry:\n    x = 1\nexcept Exception:\n    session.table('e.f').show()\n")
    assert [e["source"] for e in found] == ["table:e.f"]
    found, warnings = edges_of("d = spark.table('t').groupBy('k').pivot('m').agg(F.sum('v').alias('s'))\ne = d.toDF('a', 'b')\n")
    assert found[1]["group_keys"] == ["k"] and found[1]["is_dynamic"] and len(warnings) == 2


def test_extraction_never_raises(spark):
    files = spark.createDataFrame([("a.py", None), ("b.ipynb", "{nope"), ("c.py", "\x00"), ("d.py", "df = df.x().y\n" * 50)], "rel_path string, content string")
    assert extract(files, symbols={}).filter("row_type = 'warning'").count() >= 2
    assert extract(files.limit(0), symbols={}).count() == 0


def test_notebooks_and_scope(spark, tmp_path):
    assert prepare("a.py", PIPELINE).runs == ["../config/setup"] and run_target("silver/p.py", "../config/setup") == "config/setup"
    assert glob_regex("**/a*.py") == r"^(?:[^/]+/)*a[^/]*\.py$"
    for name in ("bronze/a.py", "bronze/deep/b.py", "node_modules/c.py", ".git/d.py", "x.txt"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("x = 1")
    files, missing = scan_repository(spark, str(tmp_path), Scope(["bronze", "absent"], [], ["**/b.py"]))
    assert rows(files.select("rel_path")) == [("bronze/a.py",)] and missing.count() == 1
    assert Scope(include=["a"]).merged(Scope(include=["b", "a"])).include == ["a", "b"]


def test_cli(spark, tmp_path, capsys):
    (tmp_path / "p.py").write_text('a = spark.table("m.t").withColumn("c", F.col("x") + 1)\na.write.saveAsTable("m.u")\n')
    assert main(["extract", str(tmp_path)]) == 0 and "m.u" in capsys.readouterr().out
    assert main(["compare", str(tmp_path), str(tmp_path), "--strict"]) == 0
    newer = tmp_path / "newer"
    newer.mkdir()
    (newer / "p.py").write_text('a = spark.table("m.t").withColumn("d", F.col("x") + 1)\na.write.saveAsTable("m.u")\n')
    (tmp_path / "older").mkdir()
    (tmp_path / "older" / "p.py").write_text((tmp_path / "p.py").read_text())
    capsys.readouterr()
    assert main(["diff", str(tmp_path / "older"), str(newer)]) == 0
    told = capsys.readouterr().out
    assert told.startswith("4 changes") and "removed column: m.u.c" in told and "added column: m.u.d" in told
    assert main(["diff", str(newer), str(newer), "--strict"]) == 0


def test_closure(spark):
    links = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), (None, "a"), ("d", None)], "src string, dst string")
    seeds = spark.createDataFrame([("s", "a"), ("t", "d")], "seed string, node string")
    assert rows(closure(links, seeds)) == [("s", "a", 3), ("s", "b", 1), ("s", "c", 2), ("s", "d", 3)]
    assert rows(closure(links, seeds.filter("seed = 't'"), reverse=True).select("node")) == [("a",), ("b",), ("c",)]
    assert closure(links.limit(0), seeds).count() == 0


def test_closure_in_groups_and_forms(spark, monkeypatch):
    import random

    from tributary.operators import closure as module

    rnd = random.Random(4)
    links = [(rnd.choice("gh"), f"n{rnd.randint(0, 14)}", f"n{rnd.randint(0, 14)}") for _ in range(40)] + [(None, "n0", "n1"), ("g", None, "n1")]
    seeds = [(g, f"s{k}", f"n{rnd.randint(0, 14)}") for g in "gh" for k in (0, 1, 1, 2)]
    df = spark.createDataFrame(links, "graph_id string, src string, dst string").selectExpr("*", "1 as depth")
    of = spark.createDataFrame(seeds, "graph_id string, seed string, node string").selectExpr("*", "1 as of")
    want = {}
    for g, s, node in seeds:
        frontier, depth, seen = {node}, 0, set()
        while frontier:
            depth += 1
            frontier = {b for x, a, b in links if x == g and a in frontier and b} - seen
            seen |= frontier
            for n in frontier:
                want[g, s, n] = min(want.get((g, s, n), depth), depth)
    for rows_in_task, broadcast in ((200_000, 100_000), (0, 100_000), (0, 0)):
        monkeypatch.setattr(module, "BROADCAST_ROWS", broadcast)
        got = rows(closure(df, of, group="graph_id", group_rows=rows_in_task))
        assert got == sorted((g, s, n, d) for (g, s, n), d in want.items())
    assert rows(closure(df, of, group="graph_id", max_depth=1)) == sorted((g, s, n, d) for (g, s, n), d in want.items() if d == 1)
    assert closure(df.limit(0), of, group="graph_id").count() == 0


def test_seeds(spark):
    from tributary.queries.lineage import SQL, seed_resolution_cases

    import duckdb

    assert sorted(map(str, rows(seed_resolution_cases(spark, "").select("case", F.coalesce("node", F.lit("")), "status")))) == sorted(map(str, [(a, b or "", c) for a, b, c in duckdb.sql(SQL["seed_resolution_cases"]).fetchall()]))


def test_plan_mode(spark):
    from pyspark.sql import Window

    a = spark.createDataFrame([(1, 2.0, [1, 2])], "k int, v double, xs array<int>")
    df = a.withColumn("w", F.row_number().over(Window.partitionBy("k").orderBy("v"))).select("k", (F.col("v") + 1).alias("v1"), "w", F.explode("xs").alias("x"))
    roles = {(c, r, f) for _, c, r, _, f in provenance_rows(df, "t")}
    assert {("k", "passthrough", "k"), ("v1", "derived", "v"), ("w", "window", "v"), ("w", "window", "k"), ("x", "derived", "xs")} == roles
    both = a.select("k").union(a.select(F.col("v").cast("int")))
    assert {f for *_, f in provenance_rows(both, "t")} == {"k", "v"}
    marked = PlanLineage(a.withColumn("u", F.udf(lambda x: x)("k")))
    assert dict((n, k in marked.udfs) for n, k in marked.output)["u"]


def test_relational_helpers(spark):
    l = spark.createDataFrame([(1, 5, "x"), (1, 1, "y"), (2, 5, None)], "k int, t int, tag string")
    r = spark.createDataFrame([(1, 2, "a"), (1, 5, "b"), (1, 9, "c")], "k int, t int, v string")
    assert sorted(((x.k, x.t, x.v) for x in asof_join(l, r, ["k"], "t", ["v"]).collect()), key=str) == [(1, 1, None), (1, 5, "b"), (2, 5, None)]
    target = spark.createDataFrame([(1, "a"), (2, "b"), (None, "n")], "k int, v string")
    assert sorted(map(str, upsert(target, spark.createDataFrame([(2, "B"), (3, "C")], "k int, v string"), ["k"]).collect())) == sorted(map(str, [*spark.createDataFrame([(1, "a"), (None, "n"), (2, "B"), (3, "C")], "k int, v string").collect()]))


def test_metrics_and_retrieval(spark):
    t = spark.createDataFrame([("a", "1"), ("a", "2"), ("b", "3")], "kind string, key string")
    p = spark.createDataFrame([("a", "1"), ("c", "9")], "kind string, key string")
    got = {r.kind: (r.tp, r.fp, r.fn, r.precision, r.recall) for r in set_prf(t, p, "kind", "key").collect()}
    assert got["a"] == (1, 0, 1, 1.0, 0.5) and got["b"] == (0, 0, 1, 1.0, 0.0) and got[None] == (1, 1, 2, 0.5, pytest.approx(0.333333))
    k = spark.createDataFrame([("j", 0, 0), ("j", 0, 0), ("m", 1, 1), ("m", 0, 1), ("m", None, 1)], "judge string, a int, b int")
    assert {r.judge: r.kappa for r in kappa(k, ["judge"], "a", "b").collect()} == {"j": 1.0, "m": 0.0}
    docs = spark.createDataFrame([(1, "join the table table"), (2, "nothing here"), (3, None), (4, "")], "doc_id long, text string")
    assert [r.doc_id for r in bm25(docs, spark.createDataFrame([(1, "table join")], "query_id int, query string")).collect()] == [1]
    packed = budget_pack(spark.createDataFrame([(1, 1, 900), (1, 2, 50), (2, 1, 10), (2, 2, 20), (2, 3, 90)], "q int, n int, tokens int"), "q", [F.col("n")], "tokens", 100)
    assert rows(packed.select("q", "n")) == [(1, 1), (2, 1), (2, 2)]
    assert chunks(spark.createDataFrame([(1, "a\n\nb\nc"), (2, None)], "id int, text string"), "id", "text").count() == 2


def test_streaming_refresh(spark, tmp_path):
    from datetime import datetime

    from tributary.streaming.refresh import FILES, current, refresh

    def put(n, text):
        spark.createDataFrame([("p.py", text, datetime(2024, 1, n))], FILES).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        refresh(spark, str(tmp_path / "in"), str(tmp_path / "store"), str(tmp_path / "ck")).awaitTermination()
        return {json.loads(r.payload)["target"] for r in current(spark, str(tmp_path / "store")).filter("row_type = 'edge'").collect()}

    assert put(1, 'a = spark.table("t")') == {"df:p.py:1:a"}
    assert put(2, 'b = spark.table("t")') == {"df:p.py:1:b"}
    assert put(3, "x = 1") == set()
    assert EDGE.startswith("kind")
