"""Records whose fields drift between files: rescue-column ingestion and a report of every change.

``parse_records`` turns each JSON payload into a flat map of dotted paths to JSON texts. ``ingest``
enforces a target schema on it: approved names of a target field are cast to its type, and whatever is
unknown or does not cast stays, as JSON, in ``_rescued``. ``replay`` moves rescued values into the typed
columns once their names are approved.

The report is read off the same rescue step: ``rescue`` ingests each file of a feed into the schema of the file
before it (and that file into the schema of the next one), with the JSON types of the values in place of casts.
A rescued field that the target does not know was added (or, the other way round, removed), one whose values
have another type was retyped, and a removed and an added field with the same contents are one renamed field; the
renames are what ``approved_names`` promotes.

Defined results: a payload that is null or no JSON is kept with its text in ``_error`` and takes no part
in the comparison; one that is JSON but no object has no fields; a name that occurs twice in one object
counts with its last value; an empty object has no fields; a field whose values are all null is present
and has no type, and is never retyped; of equally frequent types the first of integer, decimal, string,
boolean, list holds. Files with the same time are ordered by name. An empty table gives no rows.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import durable, partitions


class _Point(str):
    """A number written with a point or an exponent, as it was written."""


def _reject(constant: str):
    raise ValueError(constant)


def _decoder() -> json.JSONDecoder:
    return json.JSONDecoder(parse_float=_Point, parse_constant=_reject)


def _flat(value: dict, prefix: str, out: dict[str, tuple[str, str]]) -> None:
    for name, held in value.items():
        path = prefix + name
        if isinstance(held, dict):
            _flat(held, path + ".", out)
        elif held is None:
            out[path] = ("null", "null")
        elif isinstance(held, bool):
            out[path] = ("boolean", "true" if held else "false")
        elif isinstance(held, int):
            out[path] = ("integer", str(held))
        elif isinstance(held, _Point):
            out[path] = ("decimal", str(held))
        elif isinstance(held, str):
            out[path] = ("string", held)
        else:
            out[path] = ("list", json.dumps(held, ensure_ascii=False, sort_keys=True))


def parse_records(df: DataFrame, payload: str = "payload") -> DataFrame:
    """``df`` with ``fields`` (path to type and text) and ``_error`` in place of the payload."""
    keep = [c for c in df.columns if c not in (payload, "fields", "_error")]
    pair = T.StructType([T.StructField("type", T.StringType()), T.StructField("text", T.StringType())])
    schema = T.StructType(df.select(*keep).schema.fields).add("fields", T.MapType(T.StringType(), pair)).add("_error", T.StringType())
    kind = pa.map_(pa.string(), pa.struct([("type", pa.string()), ("text", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = _decoder().decode
        for batch in batches:
            fields, errors = [], []
            for text in batch.column(payload).to_pylist():
                out: dict[str, tuple[str, str]] = {}
                try:
                    value = decode(text)
                    if isinstance(value, dict):
                        _flat(value, "", out)
                    errors.append(None)
                except (ValueError, TypeError, RecursionError):
                    out = {}
                    errors.append("" if text is None else text)
                fields.append([(k, {"type": t, "text": v}) for k, (t, v) in out.items()])
            columns = [batch.column(c) for c in keep] + [pa.array(fields, kind), pa.array(errors, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=[*keep, "fields", "_error"])

    return df.mapInArrow(run, schema)


def _json(value: Column) -> Column:
    """The JSON text of a (type, text) pair."""
    quoted = F.regexp_extract(F.to_json(F.struct(value["text"].alias("v"))), r'(?s)^\{"v":(.*)\}$', 1)
    return F.when(value["type"] == "string", quoted).otherwise(value["text"])


def _rescued(fields: Column) -> Column:
    entries = F.transform(F.map_entries(fields), lambda e: F.concat(F.regexp_extract(F.to_json(F.struct(e["key"].alias("v"))), r'(?s)^\{"v":(.*)\}$', 1), F.lit(": "), _json(e["value"])))
    return F.when(F.size(fields) > 0, F.concat(F.lit("{"), F.array_join(F.array_sort(entries), ", "), F.lit("}")))


def _castable(kind: str, data_type: str) -> bool:
    """Whether values of a JSON type may be cast at all; a string may hold a number, but no number is taken for text."""
    accepted = {"string": {"string"}, "boolean": {"boolean", "string"}, "bigint": {"integer", "string"}, "int": {"integer", "string"}, "double": {"integer", "decimal", "string"}}
    return kind in accepted.get(data_type, {"list"})


def _taken(target: dict[str, tuple[str, list[str] | Column]]) -> dict[str, Column]:
    """For each target field the value and path of the first approved path in ``fields`` that casts."""
    taken: dict[str, Column] = {}
    for name, (data_type, paths) in target.items():
        def option(path: Column) -> Column:
            entry = F.element_at("fields", path)
            allowed = entry["type"].isin([k for k in ("string", "boolean", "integer", "decimal", "list") if _castable(k, data_type)])
            cast = F.when(allowed, F.from_json(entry["text"], data_type) if data_type.startswith("array") else entry["text"].try_cast(data_type))
            return F.when(cast.isNotNull() | (entry["type"] == "null"), F.struct(cast.alias("value"), path.alias("path")))

        none = F.lit(None).cast(f"struct<value:{data_type},path:string>")
        if isinstance(paths, Column):
            present = F.filter(paths, lambda p: F.map_contains_key("fields", p))
            taken[name] = F.coalesce(F.try_element_at(F.filter(F.transform(present, lambda p: option(p)), lambda o: o.isNotNull()), F.lit(1)), none)
        else:
            taken[name] = F.coalesce(*[option(F.lit(path)) for path in paths], none)
    return taken


def ingest(parsed: DataFrame, target: dict[str, tuple[str, list[str] | Column]]) -> DataFrame:
    """Typed columns of ``target`` (name to type and approved paths, first match holds) and ``_rescued``.

    Paths may be an array column, where they differ between records. An approved path whose value does not cast
    stays in ``_rescued`` beside the unknown ones.
    """
    return _typed(parsed, target, [c for c in parsed.columns if c not in ("fields", "_error", "_rescued", *target)], {})


def replay(table: DataFrame, target: dict[str, tuple[str, list[str] | Column]]) -> DataFrame:
    """Promote rescued fields: cast the values of approved paths in ``_rescued`` into the columns of ``target`` and take them out of it.

    Values that do not cast stay rescued; a value the column already has is not replaced, and what would have
    replaced it stays rescued too. Columns that the table lacks are added.
    """
    keep = [c for c in table.columns if c not in ("_rescued", "_error", *target)]
    old = {name: F.col(f"`{name}`") for name in target if name in table.columns}
    held = table.select(*keep, *old.values(), "_rescued", F.col("_error").alias("__error"))
    parsed = parse_records(held, "_rescued").withColumn("_error", F.col("__error")).drop("__error")
    return _typed(parsed, target, keep, old)


def _typed(parsed: DataFrame, target: dict, keep: list[str], old: dict[str, Column]) -> DataFrame:
    taken = _taken(target)
    fresh = {name: F.when(old[name].isNull(), F.col(f"`__taken_{name}`")) if name in old else F.col(f"`__taken_{name}`") for name in target}
    held = parsed.withColumns({f"__taken_{name}": column for name, column in taken.items()})
    consumed = F.filter(F.array(*[fresh[name]["path"] for name in target]), lambda p: p.isNotNull())
    held = held.withColumn("__consumed", consumed)
    rest = F.map_filter("fields", lambda k, _: ~F.array_contains(F.col("__consumed"), k))
    typed = [F.coalesce(old[name], fresh[name]["value"]).alias(name) if name in old else fresh[name]["value"].alias(name) for name in target]
    return held.select(*keep, *typed, _rescued(rest).alias("_rescued"), "_error")


# ---- comparison of files -------------------------------------------------------------------------

_TYPES = ["integer", "decimal", "string", "boolean", "list"]


def schemas(parsed: DataFrame) -> DataFrame:
    """(feed, file_name, run_ts, schema): each field of a file with the type of most of its non-null values, 'null' without any.

    A file of broken payloads only has an empty schema.
    """
    fields = F.explode_outer(F.when(F.col("_error").isNull(), F.col("fields"))).alias("field", "value")
    counts = [F.count_if(F.col("value.type") == t).alias(t) for t in _TYPES]
    whole = parsed.select("feed", "file_name", "run_ts", fields).groupBy("feed", "file_name", "field").agg(*counts, F.min("run_ts").alias("run_ts"))
    best = F.greatest(*_TYPES)
    chosen = F.coalesce(*[F.when((F.col(t) == best) & (best > 0), F.lit(t)) for t in _TYPES], F.lit("null"))
    entries = F.collect_list(F.when(F.col("field").isNotNull(), F.struct("field", chosen.alias("type"))))
    return whole.groupBy("feed", "file_name").agg(F.min("run_ts").alias("run_ts"), F.map_from_entries(entries).alias("schema"))


def numbered(files: DataFrame) -> DataFrame:
    """``files`` with ``seq``: consecutive numbers of the files of each feed in time, by one range sort, so that a feed of any size is split."""
    spark = files.sparkSession
    order = [F.col("feed"), F.col("run_ts").asc_nulls_first(), F.col("file_name")]
    held = durable(files.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order).withColumn("__id", F.monotonically_increasing_id()), "files")
    part = F.shiftright("__id", 33)
    sizes = {r[0]: r[1] for r in held.groupBy(part).count().collect()}  # one row a partition
    start, begins = 0, []
    for number in sorted(sizes):
        begins += [F.lit(number), F.lit(start)]
        start += sizes[number]
    begin = F.create_map(*begins)[part] if begins else F.lit(0)
    return held.select(*files.columns, (begin + F.col("__id").bitwiseAND((1 << 33) - 1)).cast("bigint").alias("seq"))


def neighbours(files: DataFrame) -> DataFrame:
    """(feed, file_name, seq, own, before, after, next_file): the schemas of each file, of the one before it and of the one after it."""
    one = lambda by, **held: files.select("feed", (F.col("seq") + by).alias("seq"), *(F.col(c).alias(n) if c else F.lit(None).cast(t).alias(n) for n, (c, t) in held.items()))
    schema = "map<string,string>"
    whole = one(0, file_name=("file_name", ""), own=("schema", ""), before=(None, schema), after=(None, schema), next_file=(None, "string"))
    whole = whole.unionByName(one(1, file_name=(None, "string"), own=(None, schema), before=("schema", ""), after=(None, schema), next_file=(None, "string")))
    whole = whole.unionByName(one(-1, file_name=(None, "string"), own=(None, schema), before=(None, schema), after=("schema", ""), next_file=("file_name", "")))
    held = whole.groupBy("feed", "seq").agg(*(F.first(c, ignorenulls=True).alias(c) for c in ("file_name", "own", "before", "after", "next_file")))
    return held.filter("own is not null")


def rescue(parsed: DataFrame, near: DataFrame) -> DataFrame:
    """What ingestion into the neighbouring file's schema rescues: (feed, seq, file_name, change_kind, field, old_type, new_type, type, text).

    ``seq`` and ``file_name`` are those of the later file of the two.
    """
    held = parsed.filter("_error is null").select("feed", "file_name", "fields").join(near, ["feed", "file_name"])
    entries = F.map_entries("fields")
    known = lambda schema, e: F.map_contains_key(schema, e["key"])
    typed = lambda schema, e: F.nullif(F.element_at(schema, e["key"]), F.lit("null"))
    row = lambda e, kind, later, old, new: F.struct(
        (F.col("seq") + later).alias("seq"), F.col("next_file" if later else "file_name").alias("file_name"), F.lit(kind).alias("change_kind"), e["key"].alias("field"), old.alias("old_type"), new.alias("new_type"), e["value"]["type"].alias("type"), e["value"]["text"].alias("text"))
    none = F.lit(None).cast("string")
    rescued = F.concat(
        F.when(F.col("before").isNull(), F.array()).otherwise(F.transform(F.filter(entries, lambda e: ~known("before", e)), lambda e: row(e, "added", 0, none, typed("own", e)))),
        F.when(F.col("before").isNull(), F.array()).otherwise(F.transform(F.filter(entries, lambda e: known("before", e) & (typed("before", e) != typed("own", e))), lambda e: row(e, "retyped", 0, typed("before", e), typed("own", e)))),
        F.when(F.col("after").isNull(), F.array()).otherwise(F.transform(F.filter(entries, lambda e: ~known("after", e)), lambda e: row(e, "removed", 1, typed("own", e), none))),
    )
    return held.select("feed", F.explode(rescued).alias("r")).select("feed", "r.*")


def _name_parts(field: str) -> list[str]:
    """Lower-case words of a path, camel case split."""
    return [w for w in re.split(r"[\W_]+", re.sub(r"([a-z0-9])([A-Z])", r"\1_\2", field).lower()) if len(w) > 1]


def _skeleton(word: str) -> str:
    return word[0] + re.sub("[aeiou]", "", word[1:])


def _features() -> Column:
    """Words and shapes of a text, magnitude of a number, each with a mark for what it is of; and an empty one for every value."""
    text = F.col("text")
    words = F.transform(F.array_distinct(F.split(F.lower(text), r"[^\p{L}\p{N}]+")), lambda w: F.concat(F.lit("w:"), w))
    shape = F.regexp_replace(F.regexp_replace(F.regexp_replace(text, r"\p{Lu}?\p{Ll}+|\p{Lu}+", "a"), r"\d+", "9"), r"a(?: a)+", "a+")
    magnitude = F.floor(F.log2(F.abs(text.try_cast("double")) + 1))
    numbers = F.array(F.lit(""), F.concat(F.lit("m:"), F.coalesce(magnitude.cast("string"), F.lit(""))), F.concat(F.lit("t:"), "type"))
    texts = F.array_union(F.filter(words, lambda w: F.length(w) > 2), F.array(F.lit(""), F.concat(F.lit("s:"), shape), F.concat(F.lit("t:"), F.when(F.col("type") == "boolean", "type").otherwise("text"))))
    return F.when((F.col("type") == "null") | (F.col("change_kind") == "retyped"), F.array(F.lit(""))).when(F.col("type").isin("integer", "decimal"), numbers).otherwise(texts)


def _score(field: str, old: str | None, new_field: str, new: str | None, content: float) -> float:
    """How surely a removed and an added field are one: the cosine of their contents and what their names share.

    Where contents say little (numbers, truth values) the names must share a word.
    """
    a, b = _name_parts(field), _name_parts(new_field)
    shared = max(len(set(a) & set(b)), len({_skeleton(w) for w in a} & {_skeleton(w) for w in b}))
    within = bool(a and b) and (a[-1] in b[-1] or b[-1] in a[-1])
    name = max(shared / max(min(len(a), len(b)), 1), 1.0 if within else 0.0)
    if old is None or new is None:
        return 0.6 * name if name >= 1 else 0.0
    text, number = {"string", "list"}, {"integer", "decimal"}
    textual = old in text and new in text
    if not (old == new or textual or (old in number and new in number)):
        return 0.5 * content + 0.3 if name >= 1 else 0.0
    if textual:
        return content + 0.5 * name
    return 0.5 * content + name if name > 0 else 0.0


_CHANGE = "feed string, file_name string, change_kind string, field string, new_field string, old_type string, new_type string, score double"


def _decided(same: float):
    """The changes of each pair of files from its changed fields (with the squared norm of their features) and the products of the features of two."""

    def changes(key: tuple, fields: list, dots: dict) -> Iterator[tuple]:
        feed, file_name = key
        gone, come = {}, {}
        for kind, field, old, new, norm in fields:
            if kind == "retyped":
                yield feed, file_name, kind, field, "", old, new, None
            else:
                (gone if kind == "removed" else come)[field] = (old if kind == "removed" else new, norm)
        first: dict[str, tuple] = {}
        for a, (old, norm) in gone.items():
            for b, (new, other) in come.items():
                score = _score(a, old, b, new, dots.get((a, b), 0.0) / (norm * other) ** 0.5 if norm and other else 0.0)
                if score >= same - 1e-9:
                    first[a] = min(first.get(a, (1,)), (-score, a, b))
        best: dict[str, tuple] = {}
        for score, a, b in first.values():
            best[b] = min(best.get(b, (1,)), (score, a, b))
        for score, a, b in best.values():
            yield feed, file_name, "renamed", a, b, gone.pop(a)[0], come.pop(b)[0], -score
        for field, (old, _) in gone.items():
            yield feed, file_name, "removed", field, "", old, None, None
        for field, (new, _) in come.items():
            yield feed, file_name, "added", field, "", None, new, None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("feed", "seq", "file_name", "change_kind", "field", "other", "old_type", "new_type", "value")
        kinds = [pa.string()] * 7 + [pa.float64()]
        spot, key, fields, dots, out = None, ("", ""), [], {}, []

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], names=[c.split(" ")[0] for c in _CHANGE.split(", ")])

        for part in batches:
            for feed, seq, file_name, kind, field, other, old, new, value in zip(*(part.column(n).to_pylist() for n in names)):
                if (feed, seq) != spot:
                    out += changes(key, fields, dots)
                    spot, fields, dots = (feed, seq), [], {}
                if other is None:
                    key = (feed, file_name)
                    fields.append((kind, field, old, new, value))
                else:
                    dots[field, other] = value
            if len(out) > 10_000:
                yield batch()
                out = []
        out += changes(key, fields, dots)
        yield batch()

    return run


def drift(parsed: DataFrame, same: float = 0.75) -> DataFrame:
    """(feed, file_name, change_kind, field, new_field, old_type, new_type, score) of each file against the one before it.

    A removed and an added field make a rename if what was rescued of them agrees: the cosine of their words,
    value shapes and magnitudes, together with what their names share, reaches ``same``. Each field is part of
    one rename at most, the best.
    """
    parsed = durable(parsed, "parsed")
    near = durable(neighbours(numbered(schemas(parsed))), "schemas")
    counted = ["feed", "seq", "file_name", "change_kind", "field", "old_type", "new_type"]
    features = durable(rescue(parsed, near).select(*counted, F.explode(_features()).alias("feature")).groupBy(*counted, "feature").agg(F.count("*").cast("double").alias("weight")), "rescued")
    said = features.filter("feature <> ''")
    gone, come = (said.filter(F.col("change_kind") == k) for k in ("removed", "added"))
    dots = gone.select("feed", "seq", "feature", "field", "weight").join(come.select("feed", "seq", "feature", F.col("field").alias("other"), F.col("weight").alias("also")), ["feed", "seq", "feature"])
    dots = dots.groupBy("feed", "seq", "field", "other").agg(F.sum(F.col("weight") * F.col("also")).alias("value"))
    norms = features.groupBy(*counted).agg(F.sum(F.when(F.col("feature") != "", F.col("weight") * F.col("weight")).otherwise(0.0)).alias("value"))
    whole = norms.unionByName(dots, allowMissingColumns=True)
    return whole.repartition(partitions(parsed.sparkSession), "feed", "seq").sortWithinPartitions("feed", "seq").mapInArrow(_decided(same), _CHANGE)


def _owners(edges: list[tuple[int, float, str, str]], fields: list[str]) -> dict[str, tuple[str, int]]:
    """Name to its target field and its rank there: from the target names on, of all renames that reach a new name the first in (preference, best score) holds."""
    near: dict[str, list[tuple[int, float, str]]] = {}
    for preference, score, a, b in edges:
        near.setdefault(a, []).append((preference, -score, b))
        near.setdefault(b, []).append((preference, -score, a))
    found = {f: (f, 0) for f in fields}
    count = dict.fromkeys(fields, 0)
    open_ = [(p, s, f, other) for f in fields for p, s, other in near.get(f, [])]
    heapq.heapify(open_)
    while open_:
        _, _, known, other = heapq.heappop(open_)
        if other in found:
            continue
        owner = found[known][0]
        count[owner] += 1
        found[other] = (owner, count[owner])
        for p, s, more in near.get(other, []):
            if more not in found:
                heapq.heappush(open_, (p, s, other, more))
    return found


def approved_names(report: DataFrame, feeds: DataFrame, fields: list[str]) -> DataFrame:
    """(feed, names): for each feed the names every target field went by, as a map from field to names, from all renames of a drift report.

    A name that renames of a feed link to several fields goes with the best score in that feed; what
    only other feeds renamed comes after that, with the best score among them.
    """
    renames = report.filter("change_kind = 'renamed'").groupBy("feed", "field", "new_field").agg(F.max("score").alias("score"))
    edges = F.sort_array(F.collect_list(F.struct("field", "new_field", "score"))).alias("edges")
    every = renames.groupBy("field", "new_field").agg(F.max("score").alias("score")).agg(edges).select(F.col("edges").alias("others"))
    feeds = feeds.select("feed").distinct()
    own = renames.groupBy("feed").agg(edges)
    whole = feeds.join(own, feeds["feed"].eqNullSafe(own["feed"]), "left").select(feeds["feed"], "edges").crossJoin(every)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in zip(*(batch.column(i).to_pylist() for i in (1, 2))):
                edges = [(k, e["score"], e["field"], e["new_field"]) for k, held in enumerate(row) for e in held or []]
                names: dict[str, list[tuple[int, str]]] = {}
                for name, (owner, rank) in _owners(edges, fields).items():
                    names.setdefault(owner, []).append((rank, name))
                out.append([(f, [n for _, n in sorted(held)]) for f, held in names.items()])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.map_(pa.string(), pa.list_(pa.string())))], names=["feed", "names"])

    return whole.mapInArrow(run, "feed string, names map<string,array<string>>")
