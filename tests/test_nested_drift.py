import json
from datetime import datetime

from conftest import rows

from tributary.operators.drift import approved_names, drift, ingest, parse_records, replay
from tributary.operators.nested import flatten_objects, list_items
from tributary.queries.nestings import edge_shapes

SCHEMA = """edge_id string, depth int, window_spec struct<partition_cols:array<string>,order_cols:array<string>,frame:string>, rule_logic array<struct<cond:string,value:string>>,
 struct_fields array<struct<field:string,kind:string,value:string,source_cols:array<string>,rule_logic:array<struct<cond:string,value:string>>>>, raw_detail string"""


def test_flatten(spark):
    deep = {"struct_fields": {"field": "a", "struct_fields": [None, {"field": "b", "rule_logic": {"cond": "x", "value": 1}}, 7]}, "other": {"z": 1}}
    data = [
        ("e1", 9, ([], [], None), [("c", "v"), None, ("d", None)], [("f", "lit", "1", ["s", None], [("p", "q")]), None], None),
        ("e2", 9, None, None, None, json.dumps(deep)),
        ("e3", 9, None, None, None, "{broken"),
        ("e4", 9, None, [], None, json.dumps(deep)),
        ("e5", 9, None, None, None, "[1]"),
        ("e6", 9, None, None, None, None),
        (None, 9, None, None, None, '{"window_spec": {}}'),
    ]
    found = flatten_objects(spark.createDataFrame(data, SCHEMA), "edge_id", edge_shapes(), "raw_detail")
    assert sorted(((r.key or "", r.object_path) for r in found.collect())) == sorted([
        ("e1", "window_spec"), ("e1", "rule_logic[0]"), ("e1", "rule_logic[2]"), ("e1", "struct_fields[0]"), ("e1", "struct_fields[0].rule_logic[0]"),
        ("e2", "struct_fields[0]"), ("e2", "struct_fields[0].struct_fields[1]"), ("e2", "struct_fields[0].struct_fields[1].rule_logic[0]"), ("", "window_spec")])
    inner = found.filter("object_path like '%struct_fields[1].rule_logic[0]'").first()
    assert (inner.parent_path, inner.depth, inner.value) == ("struct_fields[0].struct_fields[1]", 2, "1")
    assert rows(list_items(found, ["source_cols"])) == [("e1", "struct_fields[0]", "source_cols", 0, "s")]
    assert flatten_objects(spark.createDataFrame([], SCHEMA), "edge_id", edge_shapes(), "raw_detail").count() == 0


def walked(text):
    """Objects of a JSON text by plain recursion: (path, attributes)."""
    def reject(x):
        raise ValueError(x)

    try:
        whole = json.loads(text, parse_constant=reject)
    except (ValueError, RecursionError):
        return []
    out = []

    def under(value, name, prefix, below):
        many = value if isinstance(value, list) else [value] if isinstance(value, dict) else []
        for i, x in enumerate(many):
            if isinstance(x, dict):
                path = f"{prefix}{name}[{i}]"
                out.append((path, {k: x[k] if isinstance(x[k], str) else json.dumps(x[k]) for k in ("field", "kind", "cond", "value") if k in x and x[k] is not None and (k in ("cond", "value")) <= (name == "rule_logic" or k == "value") and (k in ("field", "kind")) <= (name == "struct_fields")}))
                if below:
                    under(x.get("rule_logic"), "rule_logic", path + ".", False)
                    under(x.get("struct_fields"), "struct_fields", path + ".", True)

    if isinstance(whole, dict):
        if isinstance(whole.get("window_spec"), dict):
            out.append(("window_spec", {}))
        under(whole.get("rule_logic"), "rule_logic", "", False)
        under(whole.get("struct_fields"), "struct_fields", "", True)
    return out


def test_texts_keep_to_their_own_keys(spark):
    import random

    rnd = random.Random(5)

    def rules():
        held = [{"cond": rnd.choice(["a > 1", 'q"x', "é\n"]), "value": rnd.choice(["1", None, 2])} for _ in range(rnd.randint(0, 3))]
        return held[0] if held and rnd.random() < 0.1 else held

    def fields(depth):
        return [None if rnd.random() < 0.1 else {"field": "f", "kind": "lit", "source_cols": ["s"], "rule_logic": rules(), **({"struct_fields": fields(depth - 1)} if depth and rnd.random() < 0.5 else {})} for _ in range(rnd.randint(0, 3))]

    texts = ['{"struct_fields":[{"field":"a"}', "]}", '{"rule_logic":[{"cond":"x"},', '{"rule_logic":[{"cond":"y"}]}]}', '{"rule_logic":[]} {"rule_logic":[{"cond":"z"}]}', "", "{}", " { } ", "1,2", "[", '{"rule_logic":[{"cond":"\\ud83d"}]}', '{"__row": 3, "rule_logic":[{"cond":"r"}]}', '{"rule_logic":[{"cond":"d"}],"rule_logic":[]}', '{"rule_logic": "text"}', '{"rule_logic":[{"cond": NaN}]}', '{"rule_logic":[{"cond":"raw\nline"}]}']
    for _ in range(600):
        text = json.dumps({**({"rule_logic": rules()} if rnd.random() < 0.5 else {}), **({"struct_fields": fields(4)} if rnd.random() < 0.6 else {}), **({"window_spec": {"frame": None}} if rnd.random() < 0.2 else {}), "other": [{"z": 1}]}, indent=rnd.choice([None, None, 2]))
        texts.append(text[: rnd.randint(1, len(text))] if rnd.random() < 0.02 else text)
    rnd.shuffle(texts)
    for part in (texts, [t for t in texts if len(walked(t)) > 0]):
        df = spark.createDataFrame([(str(i), 0, None, None, None, t) for i, t in enumerate(part)], SCHEMA)
        got = {(r.key, r.object_path): {k: r[k] for k in ("field", "kind", "cond", "value") if r[k] is not None} for r in flatten_objects(df, "edge_id", edge_shapes(), "raw_detail").collect()}
        want = {(str(i), path): {k: v.replace("\ud83d", "\ufffd") for k, v in held.items()} for i, t in enumerate(part) for path, held in walked(t)}
        assert got == want and len(got) > 500


RUN = "record_id long, feed string, file_name string, run_ts timestamp, line_no int, payload string, fields int"


def test_drift_and_ingest(spark):
    t = [datetime(2024, 1, d) for d in range(1, 5)]
    files = {
        "f1": [{"id": "Q1", "notes": "late join missing from the list", "score": 1, "x": {"n": 5}}, {"id": "Q2", "notes": "shared run missing from the list", "score": None, "x": {"n": 6}}],
        "f2": [{"id": "Q1", "remarks": "late key missing from the list", "score": 2, "x": {"n": 5.0}}, {"id": "Q2", "remarks": "wide set missing from the list", "score": "2", "x": {"n": 7.5}}, {"id": "Q3", "remarks": None, "score": 1, "x": {"n": 1.5}}],
        "f3": [{"id": "Q1", "remarks": "a b", "Score": 2}],
    }
    data = [(i, "feed", name, t[k], i, json.dumps(p), 0) for k, (name, ps) in enumerate(files.items()) for i, p in enumerate(ps)]
    data += [(90, "feed", "f3", t[2], 9, "{cut", 0), (91, "feed", "f3", t[2], 10, None, 0), (92, "feed", "f3", t[2], 11, "[1]", 0), (93, "solo", "s1", t[0], 1, '{"a": NaN}', 0)]
    parsed = parse_records(spark.createDataFrame(data, RUN))
    got = rows(drift(parsed).select("file_name", "change_kind", "field", "new_field"))
    assert got == sorted([("f2", "renamed", "notes", "remarks"), ("f2", "retyped", "x.n", ""), ("f3", "renamed", "score", "Score"), ("f3", "removed", "x.n", "")])
    typed = ingest(parsed, {"id": ("string", ["id"]), "notes": ("string", ["notes", "remarks"]), "score": ("bigint", ["score"])})
    by = {(r.file_name, r.line_no): r for r in typed.collect()}
    assert by["f2", 0].notes == "late key missing from the list" and by["f2", 1].score == 2
    assert json.loads(by["f1", 0]._rescued) == {"x.n": 5} and by["f3", 9]._error == "{cut" and by["s1"[:2], 1]._error == '{"a": NaN}'
    later = {(r.file_name, r.line_no): r for r in replay(typed, {"score": ("bigint", ["Score"])}).collect()}
    assert later["f3", 0].score == 2 and later["f3", 0]._rescued is None and later["f1", 0].score == 1
    assert drift(parse_records(spark.createDataFrame([], RUN))).count() == 0


def test_every_rename_is_approved(spark, tmp_path):
    from tributary.queries.drifts import QUERIES

    t = [datetime(2024, 1, d) for d in (1, 2)]
    text = [f"late {w} missing from the list" for w in ("join", "key", "set", "run")]
    files = [("one", "f1", t[0], "notes"), ("one", "f2", t[1], "remarks"), ("two", "g1", t[0], "remarks"), ("three", "h1", t[0], "notes")]
    data = [(f"{name}-{i}", feed, name, when, i, json.dumps({"id": f"Q{i}", field: x}), when) for feed, name, when, field in files for i, x in enumerate(text)]
    data.append(("null", None, "n1", t[0], 0, json.dumps({"notes": "of no feed"}), t[0]))
    spark.createDataFrame(data, "record_id string, feed string, file_name string, run_ts timestamp, line_no int, payload string, ingested_ts timestamp").write.parquet(f"{tmp_path}/run_records.parquet")
    got = QUERIES["p3_records"](spark, str(tmp_path)).collect()
    assert len(got) == 17 and all(r.notes is not None and r._rescued is None for r in got)


def test_names_by_score_in_each_feed(spark):
    report = spark.createDataFrame([("x", "renamed", "a", "n", 0.8), ("x", "renamed", "b", "n", 0.9), ("x", "renamed", "n", "m", 0.8), ("y", "renamed", "a", "n", 1.2), ("y", "added", "q", "", None)], "feed string, change_kind string, field string, new_field string, score double")
    feeds = spark.createDataFrame([("x",), ("y",), ("z",)], "feed string")
    got = {r.feed: r.names for r in approved_names(report, feeds, ["a", "b"]).collect()}
    assert got == {"x": {"a": ["a"], "b": ["b", "n", "m"]}, "y": {"a": ["a", "n", "m"], "b": ["b"]}, "z": {"a": ["a", "n", "m"], "b": ["b"]}}


def test_files_are_numbered_in_time_whatever_the_feed(spark):
    import random

    from tributary.operators.drift import numbered

    rnd = random.Random(3)
    files = [(rnd.choice("aaaab"), f"f{i:03}", rnd.choice([None, datetime(2024, 1, rnd.randint(1, 9))]), {"x": "string"}) for i in range(200)]
    df = spark.createDataFrame(files, "feed string, file_name string, run_ts timestamp, schema map<string,string>")
    got = {r.seq: (r.feed, r.run_ts, r.file_name) for r in numbered(df).collect()}
    assert sorted(got) == list(range(200))
    for feed in "ab":
        assert [got[k][1:] for k in sorted(got) if got[k][0] == feed] == sorted(((t, n) for f, n, t, _ in files if f == feed), key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        seqs = [k for k in sorted(got) if got[k][0] == feed]
        assert seqs == list(range(seqs[0], seqs[0] + len(seqs)))
    assert numbered(df.limit(0)).count() == 0


def test_long_names_differ_at_the_end(spark):
    t = [datetime(2024, 1, d) for d in (1, 2)]
    stem = "b" + "e" * 120
    data = [(1, "f", "a", t[0], 1, json.dumps({"k": "x", stem + "fst": 1}), 0), (2, "f", "b", t[1], 1, json.dumps({"k": "x", stem + "gnd": 700}), 0)]
    got = rows(drift(parse_records(spark.createDataFrame(data, RUN))).select("change_kind", "field", "new_field"))
    assert got == [("added", stem + "gnd", ""), ("removed", stem + "fst", "")]
