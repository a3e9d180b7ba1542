"""Deeply nested records to related flat tables.

A ``Shape`` names an object or array of objects, its attributes and the shapes below it (itself
included). Columns are flattened in Arrow: the offsets of a list give the number of children of each
parent, list_parent_indices gives the parent of each child, and keys and paths follow with ``take``;
no row is looked at alone. JSON text of the same objects is read by Arrow's own JSON reader into such columns, a batch
of texts at once and to the depth that the batch has, and goes through the same kernels; every text carries its
number into the parse, so that none can take another's place. Only texts that are less regular (a lone object in place of an
array, a number in place of a text, what is no JSON) are parsed by themselves and flattened level by level.

Defined results: a null element keeps its position and makes no row, as does an element that is no
object; a lone object in place of an array has position 0; null and empty arrays give no rows; a
present single object gives a row even if everything in it is null; a JSON text that does not parse,
or is no object, gives no rows; the text counts only where all typed columns of its row are null.
Rows with a null key keep their objects under the null key. Extra columns are not read.
"""

from __future__ import annotations

import io
import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.json as pj
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass
class Shape:
    """An object, or an array of objects (``many``), with text attributes and attributes that are lists of text."""

    name: str
    many: bool = True
    texts: tuple[str, ...] = ()
    lists: tuple[str, ...] = ()
    below: list[Shape] = field(default_factory=list)


def attributes(shapes: list[Shape]) -> tuple[list[str], list[str]]:
    """All text and list attributes of the shapes, each once."""
    texts, lists, seen, todo = {}, {}, set(), list(shapes)
    while todo:
        shape = todo.pop(0)
        if id(shape) not in seen:
            seen.add(id(shape))
            texts |= dict.fromkeys(shape.texts)
            lists |= dict.fromkeys(shape.lists)
            todo += shape.below
    return list(texts), list(lists)


def object_schema(shapes: list[Shape], with_attributes: bool = True) -> str:
    base = "key string, object_path string, parent_path string, object_kind string, position int, depth int"
    if not with_attributes:
        return base
    texts, lists = attributes(shapes)
    return ", ".join([base, *(f"`{t}` string" for t in texts), *(f"`{c}` array<string>" for c in lists)])


_TEXT, _LIST = pa.string(), pa.list_(pa.string())


class _Emitter:
    def __init__(self, shapes: list[Shape], with_attributes: bool):
        self.texts, self.lists = attributes(shapes) if with_attributes else ([], [])

    def batch(self, shape: Shape, key: pa.Array, path: pa.Array, parent: pa.Array, position: np.ndarray, depth: int, get: Callable[[str, pa.DataType], pa.Array]) -> pa.RecordBatch:
        n = len(key)
        columns = [key, path, parent, pa.array([shape.name], _TEXT).take(pa.array(np.zeros(n, dtype=np.int8))), pa.array(position, pa.int32()), pa.array(np.full(n, depth), pa.int32())]
        names = ["key", "object_path", "parent_path", "object_kind", "position", "depth"]
        for kind, own, every in ((_TEXT, shape.texts, self.texts), (_LIST, shape.lists, self.lists)):
            for name in every:
                columns.append(get(name, kind) if name in own else pa.nulls(n, kind))
                names.append(name)
        return pa.RecordBatch.from_arrays(columns, names=names)


def _paths(parent: pa.Array, shape: Shape, position: np.ndarray) -> pa.Array:
    at = pa.array(position).cast(_TEXT)
    own = pc.binary_join_element_wise(pa.scalar(f"{shape.name}["), at, pa.scalar("]"), "") if shape.many else pa.array([shape.name] * len(position), _TEXT)
    below = pc.binary_join_element_wise(parent, own, ".")  # null at the top
    return pc.coalesce(below, own)


def _typed(emitter: _Emitter, shape: Shape, column: pa.Array, key: pa.Array, parent: pa.Array, depth: int) -> Iterator[pa.RecordBatch]:
    """Objects of an Arrow column and all below it; ``key`` and ``parent`` belong to the rows of the column."""
    if pa.types.is_list(column.type) or pa.types.is_large_list(column.type):
        owner = pc.list_parent_indices(column)
        counts = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        items = pc.list_flatten(column)
        starts = np.concatenate(([0], np.cumsum(counts)[:-1])) if len(counts) else np.zeros(0, dtype=np.int64)
        position = np.arange(len(items)) - np.repeat(starts, counts)
    else:
        owner, items, position = pa.array(np.arange(len(column))), column, np.zeros(len(column), dtype=np.int64)
    there = items.is_valid()
    if not pc.any(there).as_py():
        return
    spot = pa.array(np.flatnonzero(there.to_numpy(zero_copy_only=False)))
    owner, items, position = owner.take(spot), items.take(spot), position[spot.to_numpy()]
    key, parent = key.take(owner), parent.take(owner)
    path = _paths(parent, shape, position)
    fields = {f.name for f in items.type}

    def get(name: str, kind: pa.DataType) -> pa.Array:
        return pc.struct_field(items, name).cast(kind) if name in fields else pa.nulls(len(items), kind)

    yield emitter.batch(shape, key, path, parent, position, depth, get)
    for lower in shape.below:
        if lower.name in fields:
            yield from _typed(emitter, lower, pc.struct_field(items, lower.name), key, path, depth + 1)


def _reject(constant: str):
    raise ValueError(constant)


def parse_text(text: str | None):
    """The parsed text, None where it is null or no JSON."""
    try:
        return None if text is None else json.loads(text, parse_constant=_reject)
    except (ValueError, RecursionError):
        return None


_ROW = "__row"
#: A block of texts that Arrow does not read as a whole is halved down to this size.
LEAST_BLOCK = 64
MOST_BRACKETS = 20_000


class _Reader:
    """Reads JSON texts of regular objects into Arrow columns of the shapes."""

    def __init__(self, shapes: list[Shape]):
        self.shapes = shapes
        every, todo = {}, list(shapes)
        while todo:
            shape = todo.pop()
            if id(shape) not in every:
                every[id(shape)] = shape
                todo += shape.below
        texts, lists = attributes(shapes)
        names = lambda found: "|".join(pc.replace_substring_regex(n, r"([^A-Za-z0-9_])", r"\\\1").as_py() for n in sorted(found)) or "$^"
        many, single = ({s.name for s in every.values() if s.many is m} for m in (True, False))
        # what Arrow would not read as the shape has it, by the first sign of the value behind a name
        self.odd = "|".join((
            rf'"(?:{names(many)})"\s*:\s*[^\[\sn]', rf'"(?:{names(single)})"\s*:\s*[^{{\sn]', rf'"(?:{names(texts)})"\s*:\s*[^"\sn]', rf'"(?:{names(lists)})"\s*:\s*[^\[\sn]', rf'"{_ROW}"', r"^\s*[^{\s]", r"^\s*\{\s*\}", r"^\s*$"))
        self.recursive = [s.name for s in every.values() if s in s.below]

    def regular(self, texts: pa.Array) -> np.ndarray:
        odd = pc.or_(pc.match_substring_regex(texts, self.odd), pc.greater(pc.count_substring_regex(texts, r"[\[{]"), MOST_BRACKETS))
        return ~odd.to_numpy(zero_copy_only=False)

    def type_of(self, shape: Shape, depth: int) -> pa.DataType:
        fields = [pa.field(n, _TEXT) for n in shape.texts] + [pa.field(n, _LIST) for n in shape.lists]
        fields += [pa.field(low.name, self.type_of(low, depth - 1)) for low in shape.below if depth > 0 or low.name not in self.recursive]
        return pa.list_(pa.struct(fields)) if shape.many else pa.struct(fields)

    def blocks(self, texts: pa.Array, rows: np.ndarray) -> Iterator[tuple[np.ndarray, pa.Table | None]]:
        """(rows, columns) of blocks of texts; None in place of columns where the texts must be parsed by themselves."""
        if not len(rows):
            return
        table = self._read(texts)
        if table is not None or len(rows) <= LEAST_BLOCK:
            yield rows, table
        else:
            half = len(rows) // 2
            yield from self.blocks(texts[:half], rows[:half])
            yield from self.blocks(texts[half:], rows[half:])

    def _read(self, texts: pa.Array) -> pa.Table | None:
        deepest = max((pc.max(pc.count_substring(texts, f'"{name}"')).as_py() or 0 for name in self.recursive), default=0)
        number = pa.array(np.arange(len(texts))).cast(_TEXT)
        bodies = pc.replace_substring_regex(texts, r"^\s*\{", "", max_replacements=1)
        lines = pc.binary_join_element_wise(pa.scalar(f'{{"{_ROW}": '), number, pa.scalar(", "), bodies, pa.scalar("\n"), "")
        held = lines.buffers()
        data = held[2][: np.frombuffer(held[1], dtype=np.int32)[len(lines)]] if not lines.offset else "".join(lines.to_pylist()).encode()
        schema = pa.schema([pa.field(_ROW, pa.int64()), *(pa.field(s.name, self.type_of(s, deepest)) for s in self.shapes)])
        options = pj.ParseOptions(explicit_schema=schema, newlines_in_values=True, unexpected_field_behavior="ignore")
        try:
            table = pj.read_json(io.BytesIO(data), pj.ReadOptions(use_threads=False, block_size=len(data) + 1024), options)
        except (pa.ArrowInvalid, pa.ArrowNotImplementedError):
            return None
        # each object must be the one its text begins: then no text took part in another's
        same = table.num_rows == len(texts) and table.column(_ROW).null_count == 0 and bool((table.column(_ROW).to_numpy() == np.arange(len(texts))).all())
        return table if same else None


def _as_text(value) -> str | None:
    if value is None:
        return None
    text = value if isinstance(value, str) else json.dumps(value, ensure_ascii=False)
    try:
        text.encode()
    except UnicodeEncodeError:  # half of a pair of \\u escapes
        return text.encode("utf-16", "surrogatepass").decode("utf-16", "replace")
    return text


def _as_list(value) -> list | None:
    return None if value is None else [_as_text(v) for v in value] if isinstance(value, list) else [_as_text(value)]


def _parsed(emitter: _Emitter, shape: Shape, objects: list[dict], key: pa.Array, parent: pa.Array, depth: int) -> Iterator[pa.RecordBatch]:
    """The same over parsed JSON; ``objects`` hold the shape, ``key`` and ``parent`` belong to them."""
    held = [o.get(shape.name) for o in objects]
    if shape.many:
        counts = np.fromiter((len(v) if isinstance(v, list) else isinstance(v, dict) for v in held), np.int64, len(held))
        items = [x for v in held for x in (v if isinstance(v, list) else (v,) if isinstance(v, dict) else ())]
    else:
        counts, items = np.ones(len(held), dtype=np.int64), held
    starts = np.concatenate(([0], np.cumsum(counts)[:-1])) if len(counts) else np.zeros(0, dtype=np.int64)
    position = np.arange(len(items)) - np.repeat(starts, counts)
    owner = np.repeat(np.arange(len(held)), counts)
    spot = np.fromiter((isinstance(x, dict) for x in items), bool, len(items))
    if not spot.any():
        return
    items = [x for x in items if isinstance(x, dict)]
    position, take = position[spot], pa.array(owner[spot])
    key, parent = key.take(take), parent.take(take)
    path = _paths(parent, shape, position)

    def get(name: str, kind: pa.DataType) -> pa.Array:
        return pa.array([(_as_text if kind is _TEXT else _as_list)(x.get(name)) for x in items], kind)

    yield emitter.batch(shape, key, path, parent, position, depth, get)
    for lower in shape.below:
        yield from _parsed(emitter, lower, items, key, path, depth + 1)


def flatten_objects(df: DataFrame, key: str, shapes: list[Shape], json_column: str | None = None, with_attributes: bool = True) -> DataFrame:
    """One row per nested object of the columns that ``shapes`` name, or of the JSON text where these are null.

    Columns: key, object_path, parent_path (null at the top), object_kind, position, depth and, with
    ``with_attributes``, every attribute of every shape (null where another shape has it).
    """
    names = [s.name for s in shapes]
    wanted = [*names, *([json_column] if json_column else [])]
    some = F.lit(False)
    for name in wanted:
        some = some | F.col(name).isNotNull()
    cut = df.filter(some).select(F.col(key).cast("string").alias("__key"), *wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        emitter, reader = _Emitter(shapes, with_attributes), _Reader(shapes)
        for batch in batches:
            keys = batch.column("__key").cast(_TEXT)
            empty = pa.nulls(batch.num_rows, _TEXT)
            typed = np.zeros(batch.num_rows, dtype=bool)
            for shape in shapes:
                column = batch.column(shape.name)
                typed |= column.is_valid().to_numpy(zero_copy_only=False)
                yield from _typed(emitter, shape, column, keys, empty, 0)
            if json_column:
                raw = batch.column(json_column)
                spot = np.flatnonzero(raw.is_valid().to_numpy(zero_copy_only=False) & ~typed)
                texts = raw.take(pa.array(spot)).cast(_TEXT)
                regular = reader.regular(texts)
                alone = [spot[~regular]]
                for rows, table in reader.blocks(texts.filter(pa.array(regular)), spot[regular]):
                    if table is None:
                        alone.append(rows)
                        continue
                    own = keys.take(pa.array(rows))
                    for shape in shapes:
                        yield from _typed(emitter, shape, table.column(shape.name).combine_chunks(), own, empty[: len(rows)], 0)
                rest = np.concatenate(alone)
                parsed = [parse_text(t) for t in raw.take(pa.array(rest)).to_pylist()]
                whole = np.fromiter((isinstance(o, dict) for o in parsed), bool, len(parsed))
                take = pa.array(rest[whole])
                objects = [o for o in parsed if isinstance(o, dict)]
                for shape in shapes:
                    yield from _parsed(emitter, shape, objects, keys.take(take), empty.take(take), 0)

    return cut.mapInArrow(run, object_schema(shapes, with_attributes))


def list_items(objects: DataFrame, lists: list[str]) -> DataFrame:
    """The elements of list attributes as a table of their own: (key, object_path, list_name, position, item); null items keep their position."""
    parts = [objects.select("key", "object_path", F.lit(name).alias("list_name"), F.posexplode(name).alias("position", "item")) for name in lists]
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole.filter("item is not null")
