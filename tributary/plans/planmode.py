"""Exact column lineage, read from the analyzed plan of a DataFrame.

Every attribute of an analyzed plan has an expression id, so columns are followed by id and never by
name. Only the plan is read, on the driver; nothing runs. Needs the classic (JVM) session.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

RANK = {"passthrough": 0, "group_key": 1, "derived": 2, "window": 3, "aggregate": 4}


def _seq(held) -> list:
    return [held.apply(i) for i in range(held.size())]


def _leaf_name(plan) -> str:
    name = plan.nodeName()
    if name == "LogicalRelation":
        table = plan.catalogTable()
        if table.isDefined():
            return table.get().identifier().unquotedString()
        paths = _seq(plan.relation().location().rootPaths())
        last = paths[0].getName()
        return last.rpartition(".")[0] or last
    if "Relation" in name or name == "Range":
        try:
            return plan.name()
        except Exception:  # a relation without a name
            return name.lower()
    return name.lower()


class PlanLineage:
    """sources: expression id to {(table, column): role}; udfs: ids that pass through Python or Scala functions."""

    def __init__(self, df: DataFrame):
        self.sources: dict[int, dict[tuple[str, str], str]] = {}
        self.control: set[tuple[str, str]] = set()
        self.udfs: set[int] = set()
        plan = df._jdf.queryExecution().analyzed()
        self.visit(plan)
        self.output = [(a.name(), a.exprId().id()) for a in _seq(plan.output())]

    def refs(self, expression) -> set[int]:
        return {a.exprId().id() for a in _seq(expression.references().toSeq())}

    def has(self, expression, words: tuple[str, ...]) -> bool:
        if any(w in expression.getClass().getSimpleName() for w in words):
            return True
        return any(self.has(c, words) for c in _seq(expression.children()))

    def define(self, named, grouping: set[int] = frozenset()) -> None:
        kind = named.getClass().getSimpleName()
        if kind != "Alias":
            return
        child = named.child()
        role = "passthrough" if child.getClass().getSimpleName() == "AttributeReference" else "window" if self.has(child, ("WindowExpression",)) else "aggregate" if self.has(child, ("AggregateExpression",)) else "derived"
        key = named.exprId().id()
        out = self.sources.setdefault(key, {})
        for ref in self.refs(child):
            for source, own in self.sources.get(ref, {}).items():
                new = role if RANK[role] >= RANK[own] else own
                out[source] = max(out.get(source, new), new, key=RANK.get)
            if ref in self.udfs:
                self.udfs.add(key)
        if self.has(child, ("PythonUDF", "ScalaUDF")):
            self.udfs.add(key)

    def visit(self, plan) -> None:
        children = _seq(plan.children())
        for child in children:
            self.visit(child)
        name = plan.nodeName()
        if not children:
            table = _leaf_name(plan)
            for a in _seq(plan.output()):
                self.sources[a.exprId().id()] = {(table, a.name()): "passthrough"}
            return
        if name == "Project":
            for e in _seq(plan.projectList()):
                self.define(e)
        elif name == "Aggregate":
            for e in _seq(plan.aggregateExpressions()):
                self.define(e)
        elif name == "Window":
            for e in _seq(plan.windowExpressions()):
                self.define(e)
        elif name in ("Union", "Intersect", "Except", "Intersect All", "Except All"):
            for i, a in enumerate(_seq(plan.output())):
                out: dict[tuple[str, str], str] = {}
                for child in children:
                    out |= self.sources.get(_seq(child.output())[i].exprId().id(), {})
                self.sources[a.exprId().id()] = out
        elif name == "Generate":
            given = {s: "derived" for r in self.refs(plan.generator()) for s in self.sources.get(r, {})}
            for a in _seq(plan.generatorOutput()):
                self.sources[a.exprId().id()] = dict(given)
        elif name == "Expand":
            for i, a in enumerate(_seq(plan.output())):
                out = self.sources.setdefault(a.exprId().id(), {})
                for row in _seq(plan.projections()):
                    for ref in self.refs(row.apply(i)):
                        for s in self.sources.get(ref, {}):
                            out.setdefault(s, "group_key")
        if name in ("Filter", "Join", "Aggregate"):
            held = plan.condition() if name == "Filter" else None
            if name == "Join" and plan.condition().isDefined():
                held = plan.condition().get()
            for e in [held] if held is not None else _seq(plan.groupingExpressions()) if name == "Aggregate" else []:
                for ref in self.refs(e):
                    self.control |= set(self.sources.get(ref, {}))


def provenance_rows(df: DataFrame, table: str) -> list[tuple[str, str, str, str, str]]:
    """(table, column, role, from_table, from_column) of a DataFrame that is written as ``table``."""
    held = PlanLineage(df)
    rows = []
    for name, key in held.output:
        for (source, column), role in sorted(held.sources.get(key, {}).items()):
            rows.append((table, name, role, source, column))
    return rows


def control_rows(df: DataFrame, table: str) -> list[tuple[str, str, str]]:
    """(table, from_table, from_column): columns that decide which rows there are or how they are grouped, apart from the values."""
    return [(table, t, c) for t, c in sorted(PlanLineage(df).control)]


def provenance_frame(spark: SparkSession, written: dict[str, DataFrame]) -> DataFrame:
    """Provenance of several written tables, in the form ``operators.lineage.forward_index`` takes."""
    rows = [("plan", t, c, r, ft, fc) for name, df in written.items() for t, c, r, ft, fc in provenance_rows(df, name)]
    return spark.createDataFrame(rows, "graph_id string, `table` string, `column` string, role string, from_table string, from_column string")
