"""Lineage edges of one Python file, from its syntax tree.

Statements are evaluated in order: an expression that yields a DataFrame yields the id of its node, and each
method called on one emits the typed edge of what it does. Functions of the same file, methods of a class on ``self``
included, are evaluated where they are called, with their arguments bound; functions and methods that nothing in the file calls are
evaluated after it, where parameters that are DataFrames have an unresolved node. Decorated pipeline functions write
the table they are named after. What is not understood is an edge or a warning, never silence.
"""

from __future__ import annotations

import ast
import hashlib

from .notebook import Prepared
from .symbols import UNRESOLVED, Registry, Symbols

# Spellings of join types, write modes and path prefixes.
JOIN_TYPES = {
    "inner": "inner", "cross": "cross", "left": "left", "leftouter": "left", "left_outer": "left", "right": "right", "rightouter": "right", "right_outer": "right", "full": "full", "outer": "full", "fullouter": "full", "full_outer": "full",
    "semi": "left_semi", "leftsemi": "left_semi", "left_semi": "left_semi", "anti": "left_anti", "leftanti": "left_anti", "left_anti": "left_anti",
}
MODES = {"overwrite": "overwrite", "append": "append", "merge": "merge", "ignore": "ignore", "error": "error", "errorifexists": "error"}
PATHS = ("/", "s3://", "s3a://", "abfss://", "abfs://", "wasbs://", "dbfs:/", "gs://", "hdfs://", "file:")
FORMATS = ("csv", "json", "parquet", "orc", "text", "avro", "delta", "jdbc")
PIPELINE_DECORATORS = ("table", "view", "materialized_view", "create_table", "create_streaming_table", "create_materialized_view", "temporary_view")
KEEPING = ("orderBy", "sort", "limit", "distinct", "dropDuplicates", "drop_duplicates", "union", "unionByName", "unionAll", "intersect", "exceptAll", "subtract", "sample", "repartition", "coalesce", "cache", "persist", "checkpoint", "alias", "fillna", "hint", "withWatermark", "dropna", "sortWithinPartitions")
AGGREGATES = ("count", "sum", "avg", "mean", "max", "min")
SESSIONS = ("spark", "dlt", "dp", "sqlContext")
#: Calls of the functions of one file that are looked into; beyond it a call is opaque and says so.
MOST_INLINED = 10_000


def expr_id(text: str) -> str:
    """An id that depends on the text alone, so equal expressions of different files are one."""
    return "x" + hashlib.sha256(text.encode()).hexdigest()[:16]


class Frame:
    """A DataFrame node: its id and its columns, if known."""

    def __init__(self, node: str, columns: list[str] | None = None, keys: list[str] | None = None):
        self.node, self.columns, self.keys = node, columns, keys
        self.pivoted: list[str] | None = None  # the columns a pivot gives, empty if only the data tell


class Extractor:
    def __init__(self, path: str, prepared: Prepared, symbols: Symbols, registry: Registry, schemas: dict[str, list[str]] | None = None):
        self.path, self.prepared, self.symbols, self.registry = path, prepared, symbols, registry
        self.schemas = schemas or {}
        self.rows: list[tuple[str, dict]] = []
        self.frames: dict[str, Frame] = {}
        self.columns: dict[str, ast.AST] = {}
        self.windows: dict[str, dict] = {}
        self.predicates: dict[str, dict[str, ast.AST]] = {}
        self.sinks: dict[str, tuple[str, ast.Call]] = {}
        self.lists: dict[str, list[ast.AST]] = {}
        self.functions: dict[str, ast.FunctionDef] = {}
        self.imported: set[str] = set()
        self.sessions: set[str] = set(SESSIONS)
        self.stack: list[ast.FunctionDef] = []
        self.entered: set[int] = set()
        self.inlinings = self.serial = 0

    # -- rows ---------------------------------------------------------------------------------------

    def warn(self, line: int, category: str, message: str) -> None:
        self.rows.append(("warning", {"file": self.path, "lineno": line, "category": category, "message": message}))

    def edge(self, kind: str, line: int, **held) -> None:
        self.rows.append(("edge", {"kind": kind, "file": self.path, "lineno": line, **{k: v for k, v in held.items() if v is not None}}))

    def node(self, line: int, name: str | None = None) -> str:
        self.serial += 1
        at = f"cell{self.prepared.cell_of(line - 1)}:" if self.path.lower().endswith(".ipynb") else ""
        return f"df:{self.path}:{at}{line}:{name or f'_{self.serial}'}"

    def keep(self, text: str) -> str:
        key = expr_id(text)
        self.rows.append(("expression", {"expr_id": key, "text": text}))
        return key

    # -- file ---------------------------------------------------------------------------------------

    def run(self) -> list[tuple[str, dict]]:
        try:
            tree = ast.parse(self.prepared.text)
        except (SyntaxError, ValueError) as error:
            self.warn(getattr(error, "lineno", 0) or 0, "syntax-error", str(error))
            return self.rows
        self.symbols.imports(tree)
        self.symbols.learn(tree)
        for item in ast.walk(tree):
            if isinstance(item, (ast.Import, ast.ImportFrom)):
                self.imported |= {(a.asname or a.name).split(".")[0] for a in item.names}
            elif isinstance(item, ast.FunctionDef):
                self.functions[item.name] = item
        self.block(tree.body)
        called = {n.func.id if isinstance(n.func, ast.Name) else n.func.attr for n in ast.walk(tree) if isinstance(n, ast.Call) and isinstance(n.func, (ast.Name, ast.Attribute))}
        for later in (called, set()):  # those that others call come last, if nothing that was evaluated called them
            self.uncalled(tree.body, later)
        for var, node in self.columns.items():
            if rules := self.rules(node):
                self.rows.append(("column_rule", {"file": self.path, "var": var, "rules": rules}))
        for var, held in self.predicates.items():
            for label, predicate in held.items():
                self.rows.append(("predicate", {"file": self.path, "var": var, "label": label, "predicate": ast.unparse(predicate)}))
        return self.rows

    def block(self, body: list[ast.stmt]) -> Frame | None:
        """Statements in order; the frame that a return gives."""
        given = None
        for item in body:
            if isinstance(item, ast.FunctionDef):
                self.pipeline_function(item)
            elif isinstance(item, ast.ClassDef):
                self.block([x for x in item.body if not isinstance(x, (ast.FunctionDef, ast.AsyncFunctionDef))])
            elif isinstance(item, (ast.Assign, ast.AnnAssign)) and item.value is not None:
                targets = item.targets if isinstance(item, ast.Assign) else [item.target]
                name = self.dotted(targets[0]) if len(targets) == 1 else None
                if name and (isinstance(targets[0], ast.Name) or name.startswith("self.")):
                    self.assign(name, item.value)
                else:
                    self.evaluate(item.value)
            elif isinstance(item, ast.Expr):
                if not self.append(item.value):
                    self.evaluate(item.value)
            elif isinstance(item, ast.Return):
                given = self.evaluate(item.value) if item.value is not None else None
            elif isinstance(item, (ast.If, ast.For, ast.While, ast.With, ast.Try, ast.AsyncFor, ast.AsyncWith)):
                handlers = [x for h in getattr(item, "handlers", []) for x in h.body]
                for part in (item.body, handlers, getattr(item, "orelse", []), getattr(item, "finalbody", [])):
                    found = self.block(part or [])
                    given = found or given
            elif isinstance(item, ast.Match):
                for case in item.cases:
                    given = self.block(case.body) or given
        return given

    def uncalled(self, body: list[ast.stmt], later: set[str]) -> None:
        """The functions and methods that were not evaluated so far, each by itself; what methods keep in ``self`` lasts for their class."""
        for item in body:
            if isinstance(item, ast.ClassDef):
                kept = dict(self.frames)
                self.uncalled(item.body, later)
                self.frames = kept
            elif isinstance(item, (ast.FunctionDef, ast.AsyncFunctionDef)):
                if id(item) not in self.entered and item.name not in later:
                    self.inlined(item, None, None)
                self.uncalled(item.body, later)
            else:
                for part in ("body", "orelse", "finalbody"):
                    held = getattr(item, part, None)
                    if isinstance(held, list):
                        self.uncalled(held, later)

    def append(self, node: ast.AST) -> bool:
        if isinstance(node, ast.Call) and isinstance(node.func, ast.Attribute) and node.func.attr in ("append", "extend") and isinstance(node.func.value, ast.Name) and node.func.value.id in self.lists:
            self.lists[node.func.value.id] += node.args
            return True
        return False

    def assign(self, name: str, value: ast.AST) -> None:
        if isinstance(value, (ast.List, ast.Tuple)):
            self.lists[name] = list(value.elts)
            return
        if isinstance(value, ast.Dict) and value.keys and all(isinstance(k, ast.Constant) for k in value.keys):
            self.predicates[name] = {str(k.value): v for k, v in zip(value.keys, value.values)}
            return
        if self.is_session(value):
            self.sessions.add(name)
            return
        if isinstance(value, ast.Call):
            called = self.dotted(value.func)
            if called and self.registry.sink(called):
                self.sinks[name] = (called, value)
                return
            if isinstance(value.func, ast.Name) and value.func.id in self.functions and self.returned_dict(value.func.id) is not None:
                self.predicates[name] = self.returned_dict(value.func.id)
                return
        window = self.window(value)
        if window:
            self.windows[name] = window
            return
        frame = self.evaluate(value, name)
        if frame is not None:
            self.frames[name] = frame
            self.columns.pop(name, None)
        elif not isinstance(value, ast.Constant):
            self.columns[name] = value

    def returned_dict(self, name: str) -> dict[str, ast.AST] | None:
        for item in self.functions[name].body:
            if isinstance(item, ast.Return) and isinstance(item.value, ast.Dict) and item.value.keys and all(isinstance(k, ast.Constant) for k in item.value.keys):
                return {str(k.value): v for k, v in zip(item.value.keys, item.value.values)}
        return None

    def pipeline_function(self, item: ast.FunctionDef) -> None:
        """A decorated pipeline function writes a table named by the decorator or after itself."""
        for mark in item.decorator_list:
            call = mark if isinstance(mark, ast.Call) else None
            name = self.dotted(call.func if call else mark)
            if name and name.rpartition(".")[2] in PIPELINE_DECORATORS and "." in name:
                keywords = {k.arg: k.value for k in call.keywords} if call else {}
                target = self.symbols.text(keywords["name"]) if "name" in keywords else item.name
                frame = self.inlined(item, None, None)
                if frame is not None:
                    self.edge("writes", item.lineno, source=frame.node, target=f"table:{target}", write_mode="overwrite", streaming="stream" in name)
                    self.table(target, frame.columns)
                return

    def table(self, name: str, columns: list[str] | None = None, declared: bool = False) -> None:
        self.rows.append(("table", {"file": self.path, "fqn": name, "columns": columns or [], "declared": declared}))

    # -- expressions that are DataFrames ------------------------------------------------------------

    def dotted(self, node: ast.AST) -> str | None:
        if isinstance(node, ast.Name):
            return node.id
        if isinstance(node, ast.Attribute):
            base = self.dotted(node.value)
            return f"{base}.{node.attr}" if base else None
        return None

    def chain(self, node: ast.AST) -> tuple[ast.AST, list[tuple[str, ast.Call | None]]]:
        """(base, steps in call order) of a fluent expression; a step without call is a bare accessor."""
        steps = []
        while True:
            if isinstance(node, ast.Call) and isinstance(node.func, ast.Attribute):
                steps.append((node.func.attr, node))
                node = node.func.value
            elif isinstance(node, ast.Attribute):
                steps.append((node.attr, None))
                node = node.value
            else:
                return node, steps[::-1]

    def is_session(self, node: ast.AST) -> bool:
        """Whether an expression gives a session: a known one, or what a session builder or getter gives."""
        if (self.dotted(node) or "") in self.sessions:
            return True
        base, steps = self.chain(node)
        made = ("getOrCreate", "getActiveSession", "active", "newSession")
        return bool(steps) and steps[-1][0] in made and isinstance(base, ast.Name) and (base.id in self.sessions or any(w.endswith("SparkSession") for w in (base.id, *(m for m, _ in steps))))

    def session(self, base: ast.AST, steps) -> tuple[str, list] | None:
        """(name of the session, steps after it) of a chain that begins at a session."""
        if not isinstance(base, ast.Name) or not steps:
            return None
        if base.id in self.sessions:
            return base.id, steps
        if steps[0][1] is None and (f"{base.id}.{steps[0][0]}" in self.sessions or (base.id in ("self", "cls") and steps[0][0] == "spark")):
            return "spark", steps[1:]
        for i, (method, call) in enumerate(steps[:-1]):
            if call is not None and self.is_session(call):
                return "spark", steps[i + 1 :]
        return None

    def evaluate(self, node: ast.AST, name: str | None = None) -> Frame | None:
        base, steps = self.chain(node)
        begun = self.session(base, steps)
        if begun and begun[1]:
            return self.source(begun[0], begun[1], node, name)
        if isinstance(base, ast.Name) and base.id in ("self", "cls") and steps:
            method, call = steps[0]
            if call is not None and method in self.functions and self.may_enter(self.functions[method], call):
                frame = self.inlined(self.functions[method], call, name if len(steps) == 1 else None)
                return self.steps(frame, steps[1:], name) if frame is not None else None
            if call is None and f"self.{method}" in self.frames:
                return self.steps(self.frames[f"self.{method}"], steps[1:], name)
            if call is None and f"self.{method}" in self.sinks and len(steps) > 1:
                return self.sink_call(*self.sinks[f"self.{method}"], steps[1:])
        if isinstance(base, ast.Name) and base.id in self.sinks and steps:
            return self.sink_call(*self.sinks[base.id], steps)
        if isinstance(base, ast.Name) and base.id in self.frames:
            return self.steps(self.frames[base.id], steps, name)
        if isinstance(base, ast.Call):
            called = self.dotted(base.func)
            if called and self.registry.sink(called) and steps:
                return self.sink_call(called, base, steps)
            frame = self.call(base, called, name if not steps else None)
            if frame is not None:
                return self.steps(frame, steps, name)
        if isinstance(node, ast.Call):
            dotted = self.dotted(node.func)
            if dotted and isinstance(base, ast.Name) and base.id in self.imported:
                return self.call(node, dotted, name)
        return None

    def arguments(self, call: ast.Call) -> list[Frame]:
        """The frames among the arguments, names or chains."""
        found = []
        for a in [*call.args, *(k.value for k in call.keywords)]:
            a = a.value if isinstance(a, ast.Starred) else a
            frame = self.frames.get(self.dotted(a) or "")
            if frame is None and isinstance(a, ast.Call):
                base, steps = self.chain(a)
                starts = isinstance(base, ast.Name) and (base.id in self.frames or base.id in ("self", "cls")) or self.session(base, steps) or (isinstance(base, ast.Call) and (self.dotted(base.func) or "") in {*self.functions, *self.imported})
                if starts:
                    frame = self.evaluate(a)
            if frame is not None:
                found.append(frame)
        return found

    def call(self, call: ast.Call, called: str | None, name: str | None) -> Frame | None:
        """A function call that may give a frame: a function of the file, a registered helper, or an opaque one."""
        if called in self.functions and self.may_enter(self.functions[called], call):
            return self.inlined(self.functions[called], call, name)
        frames = self.arguments(call) if called else []
        if not frames:
            return None
        if called.rpartition(".")[2] == "broadcast":  # a hint
            return frames[0]
        helper = self.registry.helper(called)
        target = self.node(call.lineno, name)
        if helper and helper.get("kind") == "suffix_rename":
            place = helper.get("suffix_arg", 1)
            given = next((k.value for k in call.keywords if k.arg == place), None) if isinstance(place, str) else call.args[place] if len(call.args) > place else None
            suffix = self.symbols.text(given)
            for column in frames[0].columns or []:
                self.edge("derives", call.lineno, source=frames[0].node, target=target, output_col=column + suffix, source_cols=[column], removed_cols=[column], expr_id=self.keep(f"rename({column} → {column}{suffix})"))
            if not frames[0].columns:
                self.edge("opaque_transform", call.lineno, source=frames[0].node, target=target, opaque_operator=called, is_passthrough=True)
            return Frame(target, [c + suffix for c in frames[0].columns] if frames[0].columns else None)
        passes = bool(helper) and helper.get("kind") == "passthrough"
        self.edge("opaque_transform", call.lineno, source=frames[0].node, target=target, opaque_operator=called, is_passthrough=passes)
        if not passes:
            self.warn(call.lineno, "opaque-call-fallback", f"{called} is not registered; its columns are unknown")
        return Frame(target, frames[0].columns if passes else None)

    def may_enter(self, function: ast.FunctionDef, call: ast.Call) -> bool:
        """A function that is being evaluated is not entered again; nor is any after very many calls."""
        if self.inlinings >= MOST_INLINED:
            self.warn(call.lineno, "opaque-call-fallback", f"{function.name} is not looked into after {MOST_INLINED} calls")
            return False
        return all(f is not function for f in self.stack)

    def inlined(self, function: ast.FunctionDef, call: ast.Call | None, name: str | None) -> Frame | None:
        """Evaluate a function of the file where it is called, its parameters bound to the arguments; without a call to unresolved nodes."""
        self.entered.add(id(function))
        self.inlinings += 1
        parameters = [*function.args.posonlyargs, *function.args.args]
        if parameters and parameters[0].arg in ("self", "cls"):
            parameters = parameters[1:]
        names = [a.arg for a in parameters]
        defaults = dict(zip(names[len(names) - len(function.args.defaults) :], function.args.defaults)) | {a.arg: d for a, d in zip(function.args.kwonlyargs, function.args.kw_defaults) if d is not None}
        given_args = {**dict(zip(names, call.args)), **{k.arg: k.value for k in call.keywords if k.arg}} if call else {}
        outer = self.frames, self.symbols.values, self.columns, self.sessions
        frames, values, sessions = dict(self.frames), dict(self.symbols.values), set(self.sessions)
        for a in [*parameters, *function.args.kwonlyargs]:
            parameter, argument = a.arg, given_args.get(a.arg, defaults.get(a.arg))
            kind = (self.dotted(a.annotation) or "").rpartition(".")[2] if a.annotation is not None else ""
            if kind == "SparkSession":
                sessions.add(parameter)
            frames.pop(parameter, None)
            values.pop(parameter, None)
            if argument is None:
                if kind == "DataFrame" or parameter == "df" or parameter.endswith("_df"):
                    frames[parameter] = Frame(UNRESOLVED)
                continue
            frame = self.evaluate(argument) if not isinstance(argument, ast.Constant) else None
            if frame is not None:
                frames[parameter] = frame
            value = self.symbols.value(argument)
            if value is not None:
                values[parameter] = value
        self.frames, self.symbols.values, self.columns, self.sessions = frames, values, dict(self.columns), sessions
        self.stack.append(function)
        given = self.block(function.body)
        self.stack.pop()
        lasting = {k: v for k, v in self.frames.items() if k.startswith("self.")}
        opened = {k for k in self.sessions if k.startswith("self.")}
        self.frames, self.symbols.values, self.columns, self.sessions = outer
        self.frames.update(lasting)
        self.sessions |= opened
        return given

    def source(self, base: str, steps, node: ast.AST, name: str | None) -> Frame | None:
        """A chain from the session: a read, a query, or what follows one."""
        streaming, fmt = base in ("dlt", "dp") and steps[0][0] == "read_stream", None
        for i, (method, call) in enumerate(steps):
            line = call.lineno if call else node.lineno
            if method == "readStream":
                streaming = True
            elif method == "format" and call and call.args:
                fmt = self.symbols.text(call.args[0])
            elif method in ("table", "load", "read", "read_stream", *FORMATS) and call is not None:
                first = call.args[0] if call.args else next((k.value for k in call.keywords if k.arg in ("path", "tableName")), None)
                where = self.symbols.text(first)
                rest = steps[i + 1 :]
                target = self.node(line, name if not rest else None)
                is_path = method in FORMATS or where.startswith(PATHS)
                source = UNRESOLVED if where == UNRESOLVED else f"{'ext' if is_path else 'table'}:{where}"
                self.edge("reads", line, source=source, target=target, streaming=streaming, format=fmt or (method if method in FORMATS else None))
                if not is_path and where != UNRESOLVED:
                    self.table(where)
                return self.steps(Frame(target, self.schemas.get(where)), rest, name)
            elif method == "sql" and call is not None:
                text = self.symbols.text(call.args[0]) if call.args else UNRESOLVED
                rest = steps[i + 1 :]
                target = self.node(line, name if not rest else None)
                self.rows.append(("sql", {"file": self.path, "lineno": line, "target": target, "sql": text}))
                if text == UNRESOLVED:
                    self.warn(line, "sql-parse-error", "the query text is not constant")
                return self.steps(Frame(target), rest, name)
            elif method in ("createDataFrame", "range") and call is not None:
                rest = steps[i + 1 :]
                target = self.node(line, name if not rest else None)
                self.edge("reads", line, source=UNRESOLVED, target=target)
                return self.steps(Frame(target), rest, name)
        return None

    def sink_call(self, called: str, made: ast.Call, steps) -> None:
        known = self.registry.sink(called)
        method, call = steps[-1]
        if call is None:
            return None
        frames = self.arguments(call) or [f for f in (self.evaluate(a) for a in call.args) if f is not None]
        held = {k.arg: k.value for k in [*made.keywords, *call.keywords] if k.arg}
        target = self.symbols.text(held.get(known.get("target_kwarg", "table")))
        mode = self.symbols.text(held[known["mode_kwarg"]]) if known.get("mode_kwarg") in held else known.get("default_mode", "overwrite")
        keys = self.symbols.value(held.get(known.get("merge_keys_kwarg"))) if known.get("merge_keys_kwarg") in held else None
        for frame in frames:
            self.edge("writes", call.lineno, source=frame.node, target=f"table:{target}" if target != UNRESOLVED else UNRESOLVED, write_mode=MODES.get(mode, UNRESOLVED), sink_class=called, merge_keys=[keys] if isinstance(keys, str) else keys)
            self.table(target, frame.columns)
        return None

    # -- methods ------------------------------------------------------------------------------------

    def steps(self, frame: Frame, steps, name: str | None) -> Frame | None:
        write: dict | None = None
        nulls = False
        for i, (method, call) in enumerate(steps):
            last = i == len(steps) - 1
            if method == "na" and call is None:
                nulls = True
                continue
            if nulls and call is not None:  # fill, drop and replace of nulls keep the columns
                target = self.node(call.lineno, name if last else None)
                self.edge("opaque_transform", call.lineno, source=frame.node, target=target, opaque_operator=f"na.{method}", is_passthrough=True)
                frame, nulls = Frame(target, frame.columns), False
                continue
            if method in ("write", "writeStream") or (method == "writeTo" and call):
                write = {"streaming": method == "writeStream", "write_mode": "append" if method != "write" else "error", "to": self.symbols.text(call.args[0]) if method == "writeTo" and call.args else None}
                continue
            if write is not None:
                if call is not None and self.writing(frame, method, call, write):
                    return None
                continue
            if call is None:
                continue
            frame = self.method(frame, method, call, name if last else None)
            if frame is None:
                return None
        return frame if write is None else None

    def writing(self, frame: Frame, method: str, call: ast.Call, write: dict) -> bool:
        first = call.args[0] if call.args else None
        if method == "mode":
            write["write_mode"] = MODES.get(self.symbols.text(first).lower(), UNRESOLVED)
        elif method == "format":
            write["format"] = self.symbols.text(first)
        elif method == "partitionBy":
            write["partition_cols"] = self.names(call.args)
        elif method in ("saveAsTable", "save", "insertInto", "table", "toTable", "start", "parquet", "csv", "json", "orc", "text", "create", "createOrReplace", "append", "overwritePartitions"):
            where = write.pop("to", None) or self.symbols.text(first)
            if method in ("create", "createOrReplace", "overwritePartitions"):
                write["write_mode"] = "overwrite"
            is_path = method in ("parquet", "csv", "json", "orc", "text") or where.startswith(PATHS)
            keywords = {k.arg: k.value for k in call.keywords}
            if "mode" in keywords:
                write["write_mode"] = MODES.get(self.symbols.text(keywords["mode"]).lower(), UNRESOLVED)
            if is_path and method in FORMATS:
                write.setdefault("format", method)
            self.edge("writes", call.lineno, source=frame.node, target=UNRESOLVED if where == UNRESOLVED else f"{'ext' if is_path else 'table'}:{where}", **write)
            if where != UNRESOLVED and not is_path:
                self.table(where, frame.columns)
            return True
        return False

    def method(self, frame: Frame, method: str, call: ast.Call, name: str | None) -> Frame | None:
        line, target = call.lineno, self.node(call.lineno, name)
        columns = frame.columns
        if method == "withColumn" and len(call.args) == 2:
            out = self.symbols.text(call.args[0])
            self.derive(frame, target, line, out, call.args[1])
            return Frame(target, None if columns is None else [*[c for c in columns if c != out], out])
        if method == "withColumns" and call.args and isinstance(call.args[0], ast.Dict):
            outs = [self.symbols.text(k) for k in call.args[0].keys]
            for out, value in zip(outs, call.args[0].values):
                self.derive(frame, target, line, out, value)
            return Frame(target, None if columns is None else [*[c for c in columns if c not in outs], *outs])
        if method == "withColumnRenamed" and len(call.args) == 2:
            a, b = (self.symbols.text(x) for x in call.args)
            self.edge("derives", line, source=frame.node, target=target, output_col=b, source_cols=[a], removed_cols=[a], expr_id=self.keep(f"rename({a} → {b})"))
            return Frame(target, None if columns is None else [b if c == a else c for c in columns])
        if method in ("select", "selectExpr"):
            return self.select(frame, target, line, self.unpacked(call.args), method == "selectExpr")
        if method == "drop":
            gone = self.names(call.args)
            self.edge("projects", line, source=frame.node, target=target, removed_cols=gone)
            return Frame(target, None if columns is None else [c for c in columns if c not in gone])
        if method in ("filter", "where") and call.args:
            predicate = call.args[0]
            self.edge("filters", line, source=frame.node, target=target, expr_id=self.keep(self.shown(predicate)), referenced_cols=self.refs(predicate))
            return Frame(target, columns)
        if method in ("join", "crossJoin") and call.args:
            return self.join(frame, target, line, call, method)
        if method in ("groupBy", "groupby", "rollup", "cube"):
            keys = [c for a in self.unpacked(call.args) for c in (self.refs(a) or [self.symbols.text(a)])]
            return Frame(frame.node, columns, keys)
        if method == "pivot" and frame.keys is not None and call.args:
            grouped = Frame(frame.node, columns, frame.keys)
            given = self.unpacked(call.args[1:]) or self.unpacked([k.value for k in call.keywords if k.arg == "values"])
            held = [self.symbols.value(v) for v in given]
            grouped.pivoted = [str(v) for v in held] if held and all(v is not None for v in held) else []
            grouped.keys = [*frame.keys]
            grouped.pivot_column = (self.refs(call.args[0]) or [self.symbols.text(call.args[0])])[0]
            return grouped
        if method == "toDF":
            return self.renamed(frame, target, call)
        if method == "transform" and call.args and isinstance(call.args[0], ast.Name) and call.args[0].id in self.functions and self.may_enter(self.functions[call.args[0].id], call):
            function = self.functions[call.args[0].id]
            held = self.frames.get("__transformed")
            self.frames["__transformed"] = frame
            bound = ast.Call(func=call.args[0], args=[ast.Name(id="__transformed", ctx=ast.Load()), *call.args[1:]], keywords=call.keywords, lineno=line, col_offset=0)
            given = self.inlined(function, bound, name)
            self.frames.pop("__transformed", None)
            if held is not None:
                self.frames["__transformed"] = held
            return given
        if frame.keys is not None and method in ("agg", *AGGREGATES):
            return self.aggregate(frame, target, line, call, method)
        if method == "agg":
            return self.aggregate(Frame(frame.node, columns, []), target, line, call, method)
        if method in ("count", "collect", "show", "first", "take", "toPandas", "createOrReplaceTempView", "printSchema", "isEmpty", "foreachPartition", "unpersist"):
            return None
        if method in KEEPING:
            others = [f.node for f in self.arguments(call)]
            for source in [frame.node, *others]:
                self.edge("opaque_transform", line, source=source, target=target, opaque_operator=method, is_passthrough=True)
            return Frame(target, columns)
        self.edge("opaque_transform", line, source=frame.node, target=target, opaque_operator=method, is_passthrough=False)
        self.warn(line, "opaque-call-fallback", f"what {method} does to the columns is not known")
        return Frame(target)

    def renamed(self, frame: Frame, target: str, call: ast.Call) -> Frame:
        """``toDF``: every column by position under a new name."""
        names = [self.symbols.text(a) for a in self.unpacked(call.args)]
        if frame.columns is not None and len(names) == len(frame.columns):
            for old, new in zip(frame.columns, names):
                self.edge("derives", call.lineno, source=frame.node, target=target, output_col=new, source_cols=[old], removed_cols=[old] if old not in names else [], expr_id=self.keep(f"rename({old} → {new})"))
        else:
            self.edge("opaque_transform", call.lineno, source=frame.node, target=target, opaque_operator="toDF", is_passthrough=False)
            self.warn(call.lineno, "opaque-call-fallback", "toDF renames columns that are not known")
        return Frame(target, names if UNRESOLVED not in names else None)

    def unpacked(self, args: list[ast.AST]) -> list[ast.AST]:
        """Arguments with lists, and starred lists of the file, laid open."""
        out: list[ast.AST] = []
        for a in args:
            a = a.value if isinstance(a, ast.Starred) else a
            if isinstance(a, (ast.List, ast.Tuple)):
                out += self.unpacked(a.elts)
            elif isinstance(a, ast.Name) and a.id in self.lists:
                out += self.unpacked(self.lists[a.id])
            else:
                out.append(a)
        return out

    def names(self, args: list[ast.AST]) -> list[str]:
        return [c for a in self.unpacked(args) for c in ([self.symbols.text(a)] if self.symbols.value(a) is not None else self.refs(a) or [UNRESOLVED])]

    def select(self, frame: Frame, target: str, line: int, items: list[ast.AST], texts: bool) -> Frame:
        outs: list[str] = []
        star = False
        for item in items:
            text = self.symbols.value(item)
            if isinstance(text, str):
                body, _, alias = text.partition(" as ") if texts else (text, "", "")
                if text == "*":
                    star = True
                    continue
                out = (alias or body).strip()
                if texts and alias:
                    self.edge("derives", line, source=frame.node, target=target, output_col=out, source_cols=[body.strip()], expr_id=self.keep(body.strip()))
                outs.append(out.rpartition(".")[2])
                continue
            bare = self.bare_column(item)
            if bare == "*":
                star = True
            elif bare:
                outs.append(bare)
            else:
                out, value = self.aliased(item)
                self.derive(frame, target, line, out, value)
                outs.append(out)
        if star:
            outs = [*[c for c in frame.columns or [] if c not in outs], *outs]
            if frame.columns is None:
                self.edge("opaque_transform", line, source=frame.node, target=target, opaque_operator="select", is_passthrough=True)
                return Frame(target)
        self.edge("projects", line, source=frame.node, target=target, kept_cols=outs)
        return Frame(target, outs)

    def bare_column(self, node: ast.AST) -> str | None:
        """The name, where the expression is a column as it is."""
        if isinstance(node, ast.Call) and self.dotted(node.func) in ("F.col", "col", "functions.col", "F.column", "column") and node.args:
            held = self.symbols.text(node.args[0])
            return held.rpartition(".")[2] if held != UNRESOLVED else None
        if isinstance(node, ast.Subscript) and isinstance(node.value, ast.Name) and node.value.id in self.frames:
            held = self.symbols.text(node.slice)
            return held if held != UNRESOLVED else None
        if isinstance(node, ast.Attribute) and isinstance(node.value, ast.Name) and node.value.id in self.frames:
            return node.attr
        return None

    def aliased(self, node: ast.AST) -> tuple[str, ast.AST]:
        if isinstance(node, ast.Call) and isinstance(node.func, ast.Attribute) and node.func.attr in ("alias", "name") and node.args:
            return self.symbols.text(node.args[0]), node.func.value
        return UNRESOLVED, node

    def derive(self, frame: Frame, target: str, line: int, out: str, value: ast.AST) -> None:
        window = self.over(value)
        refs = self.refs(value)
        if window:
            bare = [c.split(" ")[0] for c in window["order_cols"]]
            refs = list(dict.fromkeys([*window["partition_cols"], *bare, *refs]))
        rules = self.rules(value) or None
        fields = self.struct(value) or None
        variable = value.id if isinstance(value, ast.Name) else None
        self.edge("derives", line, source=frame.node, target=target, output_col=out, source_cols=refs, expr_id=self.keep(self.shown(value)), window_spec=window, rule_logic=rules, struct_fields=fields, column_var=variable)

    def join(self, frame: Frame, target: str, line: int, call: ast.Call, method: str) -> Frame:
        held = {k.arg: k.value for k in call.keywords}
        right_node = call.args[0]
        right = self.evaluate(right_node) or Frame(UNRESOLVED)
        on = held.get("on") or (call.args[1] if len(call.args) > 1 else None)
        how = held.get("how") or (call.args[2] if len(call.args) > 2 else None)
        kind = "cross" if method == "crossJoin" or self.always(on) or (on is None and how is None and method == "join") else JOIN_TYPES.get(self.symbols.text(how).lower(), UNRESOLVED) if how is not None else "inner"
        keys, shared = self.join_keys(on)
        self.edge("joins", line, source=frame.node, right_source=right.node, target=target, join_type=kind, join_keys=[{"l": a, "r": b} for a, b in keys], expr_id=self.keep(self.shown(on)) if on is not None else None)
        if kind in ("left_semi", "left_anti"):
            return Frame(target, frame.columns)
        if frame.columns is None or right.columns is None:
            return Frame(target)
        return Frame(target, [*frame.columns, *[c for c in right.columns if c not in shared and c not in frame.columns]])

    def always(self, node: ast.AST | None) -> bool:
        return isinstance(node, ast.Call) and self.dotted(node.func) in ("F.lit", "lit") and bool(node.args) and self.symbols.value(node.args[0]) is True

    def join_keys(self, on: ast.AST | None) -> tuple[list[tuple[str, str]], list[str]]:
        """(pairs of equal columns, names that the result has once)."""
        if on is None:
            return [], []
        held = self.symbols.value(on)
        if isinstance(held, str):
            return [(held, held)], [held]
        if isinstance(held, list) and all(isinstance(x, str) for x in held):
            return [(x, x) for x in held], held
        if isinstance(on, ast.List):
            return [p for x in on.elts for p in self.join_keys(x)[0]], []
        if isinstance(on, ast.BinOp) and isinstance(on.op, ast.BitAnd):
            return self.join_keys(on.left)[0] + self.join_keys(on.right)[0], []
        if isinstance(on, ast.Compare) and len(on.ops) == 1 and isinstance(on.ops[0], ast.Eq):
            a, b = self.refs(on.left), self.refs(on.comparators[0])
            if len(a) == len(b) == 1:
                return [(a[0], b[0])], []
        return [], []

    def aggregate(self, frame: Frame, target: str, line: int, call: ast.Call, method: str) -> Frame:
        keys, aggs, dynamic = frame.keys or [], [], False
        if method != "agg":
            given = self.names(call.args)
            aggs = [{"op": method, "input": c, "output": f"{method}({c})"} for c in given] or [{"op": method, "input": "*", "output": "count"}] if method == "count" or given else []
            dynamic = not aggs
        for item in self.unpacked(call.args) if method == "agg" else []:
            if isinstance(item, ast.Dict):
                for k, v in zip(item.keys, item.values):
                    column, op = self.symbols.text(k), self.symbols.text(v)
                    aggs.append({"op": op, "input": column, "output": f"{op}({column})"})
                continue
            if not isinstance(item, ast.Call):
                dynamic = True
                continue
            out, value = self.aliased(item)
            called = next((self.dotted(n.func) for n in ast.walk(value) if isinstance(n, ast.Call) and (self.dotted(n.func) or "").rpartition(".")[2] not in ("col", "column", "lit", "round", "when", "coalesce", "expr", "")), None)
            op = (called or UNRESOLVED).rpartition(".")[2]
            strings = [self.symbols.text(a) for n in ast.walk(value) if isinstance(n, ast.Call) and (self.dotted(n.func) or "").rpartition(".")[2] == op for a in n.args if isinstance(self.symbols.value(a), str)]
            inputs = list(dict.fromkeys([*self.refs(value), *strings])) or ["*"]
            aggs += [{"op": op, "input": c, "output": out} for c in inputs]
        if frame.pivoted is not None:
            # one column a value and aggregate, from the pivoted column and the aggregate's input
            several = len({a["output"] for a in aggs}) > 1
            aggs = [{"op": a["op"], "input": c, "output": f"{v}_{a['output']}" if several else v} for v in frame.pivoted for a in aggs for c in (a["input"], frame.pivot_column)]
            dynamic = dynamic or not frame.pivoted
        if dynamic:
            self.warn(line, "dynamic-aggregation", "the aggregates are computed when the program runs")
        self.edge("aggregates", line, source=frame.node, target=target, group_keys=keys, aggs=aggs, is_dynamic=dynamic)
        return Frame(target, None if dynamic else [*keys, *dict.fromkeys(a["output"] for a in aggs)])

    # -- columns ------------------------------------------------------------------------------------

    def shown(self, node: ast.AST) -> str:
        return ast.unparse(node)

    def refs(self, node: ast.AST | None, seen: frozenset = frozenset()) -> list[str]:
        """Columns an expression names, through column variables and predicate dictionaries."""
        found: dict[str, None] = {}

        def visit(n: ast.AST) -> None:
            bare = self.bare_column(n)
            if bare:
                found[bare] = None
                return
            if isinstance(n, ast.Call):
                called = (self.dotted(n.func) or "").rpartition(".")[2]
                if called == "expr" and n.args:
                    for word in self.words(self.symbols.text(n.args[0])):
                        found[word] = None
                    return
                if isinstance(n.func, ast.Attribute) and n.func.attr == "over":
                    visit(n.func.value)
                    return
                direct = isinstance(n.func, ast.Attribute) and isinstance(n.func.value, ast.Name) and n.func.value.id in ("F", "functions")
                if direct and called not in ("lit", "when", "expr", "to_date", "date_format", "regexp_replace", "regexp_extract", "split", "lag", "lead") or (direct and called in ("lag", "lead", "to_date", "date_format", "regexp_replace", "regexp_extract", "split")):
                    for a in n.args[: 1 if called in ("lag", "lead", "to_date", "date_format", "regexp_replace", "regexp_extract", "split") else None]:
                        held = self.symbols.value(a) if not isinstance(a, ast.Name) or a.id not in self.columns else None
                        if isinstance(held, str) and called not in ("concat_ws", "array_contains", "struct_field"):
                            found[held] = None
            if isinstance(n, ast.Subscript) and isinstance(n.value, ast.Name) and n.value.id in self.predicates:
                held = self.predicates[n.value.id].get(self.symbols.text(n.slice))
                if held is not None and n.value.id not in seen:
                    for c in self.refs(held, seen | {n.value.id}):
                        found[c] = None
                return
            if isinstance(n, ast.Name) and n.id in self.columns and n.id not in seen:
                for c in self.refs(self.columns[n.id], seen | {n.id}):
                    found[c] = None
                return
            for child in ast.iter_child_nodes(n):
                visit(child)

        if node is not None:
            if isinstance(self.symbols.value(node), str):
                return self.words(self.symbols.text(node))
            visit(node)
        return list(found)

    def words(self, text: str) -> list[str]:
        """Column names in a SQL expression: words that are no keyword, function or literal."""
        import re

        bare = re.sub(r"'(?:[^'\\]|\\.)*'|\"[^\"]*\"", " ", text)
        return list(dict.fromkeys(w for w in re.findall(r"(?<![\w.])(?:\w+\.)*([A-Za-z_]\w*)(?!\s*\()(?![\w])", bare) if w.lower() not in _SQL_WORDS))

    def rules(self, node: ast.AST, seen: frozenset = frozenset()) -> list[dict]:
        """The ordered conditions and values of a when-chain, the default last."""
        if isinstance(node, ast.Name) and node.id in self.columns and node.id not in seen:
            return self.rules(self.columns[node.id], seen | {node.id})
        if isinstance(node, ast.Call) and (self.dotted(node.func) or "").rpartition(".")[2] == "array":
            return self.array_of_whens(node)
        base, steps = self.chain(node)
        parts = []
        for method, call in steps:
            if call is None:
                continue
            if method == "when" and len(call.args) == 2:
                parts.append({"cond": self.condition(call.args[0]), "value": ast.unparse(call.args[1])})
            elif method == "otherwise" and call.args and parts:
                parts.append({"cond": "otherwise", "value": ast.unparse(call.args[0])})
        if isinstance(base, ast.Call) and isinstance(base.func, ast.Name) and base.func.id == "when" and len(base.args) == 2:
            parts.insert(0, {"cond": self.condition(base.args[0]), "value": ast.unparse(base.args[1])})
        return parts

    def condition(self, node: ast.AST) -> str:
        if isinstance(node, ast.Subscript) and isinstance(node.value, ast.Name) and node.value.id in self.predicates:
            held = self.predicates[node.value.id].get(self.symbols.text(node.slice))
            if held is not None:
                return ast.unparse(held)
        return ast.unparse(node)

    def array_of_whens(self, node: ast.Call) -> list[dict]:
        for a in node.args:
            inner = a.value if isinstance(a, ast.Starred) else a
            if isinstance(inner, (ast.ListComp, ast.GeneratorExp)) and len(inner.generators) == 1:
                over = inner.generators[0].iter
                over = over.func.value if isinstance(over, ast.Call) and isinstance(over.func, ast.Attribute) else over
                if isinstance(over, ast.Name) and over.id in self.predicates:
                    return [{"cond": ast.unparse(p), "value": repr(label)} for label, p in self.predicates[over.id].items()]
        return []

    def struct(self, node: ast.AST) -> list[dict]:
        """Fields of a struct, or of the structs of an array."""
        base, steps = self.chain(node)
        if steps and steps[-1][0] in ("alias", "cast", "name") and steps[-1][1] is not None:
            return self.struct(steps[-1][1].func.value)
        if not isinstance(node, ast.Call):
            return self.struct(self.columns[node.id]) if isinstance(node, ast.Name) and node.id in self.columns else []
        called = (self.dotted(node.func) or "").rpartition(".")[2]
        if called == "array":
            return [f for a in self.unpacked(node.args) for f in self.struct(a)]
        if called != "struct":
            return []
        fields = []
        for item in self.unpacked(node.args):
            out, value = self.aliased(item)
            bare = self.bare_column(value) or (self.symbols.value(value) if isinstance(self.symbols.value(value), str) else None)
            literal = isinstance(value, ast.Call) and (self.dotted(value.func) or "").rpartition(".")[2] == "lit"
            kind = "lit" if literal else "col" if bare else "expr"
            fields.append({"field": out if out != UNRESOLVED else bare or UNRESOLVED, "kind": kind, "value": ast.unparse(value.args[0] if literal and value.args else value), "source_cols": [] if literal else [bare] if bare else self.refs(value), "rule_logic": self.rules(value) or None})
        return fields

    def window(self, node: ast.AST) -> dict | None:
        base, steps = self.chain(node)
        if not (isinstance(base, ast.Name) and (base.id == "Window" or base.id in self.windows)) or not steps:
            return None
        spec = dict(self.windows.get(base.id, {"partition_cols": [], "order_cols": [], "frame": None}))
        for method, call in steps:
            if call is None:
                continue
            if method == "partitionBy":
                spec["partition_cols"] = self.names(call.args)
            elif method == "orderBy":
                spec["order_cols"] = [self.ordered(a) for a in self.unpacked(call.args)]
            elif method in ("rowsBetween", "rangeBetween"):
                spec["frame"] = f"{method[:-7]} between {' and '.join(ast.unparse(a) for a in call.args)}"
        return spec

    def ordered(self, node: ast.AST) -> str:
        base, steps = self.chain(node)
        suffix = next((m for m, _ in reversed(steps) if m in ("desc", "asc", "desc_nulls_first", "desc_nulls_last", "asc_nulls_first", "asc_nulls_last")), "")
        name = (self.refs(node) or self.names([node]) or [UNRESOLVED])[0]
        return f"{name} {suffix}".strip()

    def over(self, node: ast.AST) -> dict | None:
        """The window of an ``over``, named or written in place."""
        for n in ast.walk(node):
            if isinstance(n, ast.Call) and isinstance(n.func, ast.Attribute) and n.func.attr == "over" and n.args:
                given = n.args[0]
                return self.windows.get(given.id) if isinstance(given, ast.Name) else self.window(given)
        return None


# Words of SQL expressions that name no column.
_SQL_WORDS = frozenset("and or not in is null like rlike ilike between case when then else end cast as interval day days month months year years hour hours true false distinct asc desc over partition by order string int bigint double date timestamp decimal boolean from exists".split())
