"""Lineage edges of SQL text, from Catalyst's own parser; unresolved plans, so no catalog is needed."""

from __future__ import annotations

import json

from ..extract.pyfront import expr_id

_PASS = ("Sort", "GlobalLimit", "LocalLimit", "Distinct", "Deduplicate", "Sample", "Repartition", "RepartitionByExpression", "Offset", "UnresolvedHint", "WithWindowDefinition", "UnresolvedOrderBy", "Tail")


class SqlLineage:
    """Edges, tables and warnings of one SQL text whose result is the node ``target`` (none for a statement)."""

    def __init__(self, path: str, line: int, digest: str, target: str | None, number: int = 0):
        """``digest`` is what ``parser.digest`` gives for the text; ``number`` tells the texts of one file apart in the ids of their nodes."""
        self.path, self.line, self.rows, self.serial, self.number = path, line, [], 0, number
        self.ctes: dict[str, tuple[str, list[str] | None]] = {}
        held = json.loads(digest)
        self.nodes: list[dict] = []
        if "parse_error" in held:
            self.warning("sql-parse-error", held["parse_error"].split("\n")[0])
        elif "error" in held:
            self.warning("extraction-error", held["error"])
        else:
            self.nodes = held
            try:
                self.statement(held[0], target)
            except Exception as error:  # one text must not end the job
                self.warning("extraction-error", f"{type(error).__name__}: {error}")

    def warning(self, category: str, message: str) -> None:
        self.rows.append(("warning", {"file": self.path, "lineno": self.line, "category": category, "message": message[:300]}))

    def edge(self, kind: str, **held) -> None:
        self.rows.append(("edge", {"kind": kind, "file": self.path, "lineno": self.line, **{k: v for k, v in held.items() if v is not None}}))

    def fresh(self, name: str = "") -> str:
        self.serial += 1
        return f"df:{self.path}:{self.line}:{f'{name}@{self.number}' if name else f'sql{self.number}_{self.serial}'}"

    def table(self, name: str, columns: list[str] | None = None, declared: bool = False) -> None:
        self.rows.append(("table", {"file": self.path, "fqn": name, "columns": columns or [], "declared": declared}))

    def statement(self, plan: dict, target: str | None) -> None:
        name = plan["kind"]
        if name in ("CreateTable", "ReplaceTable"):
            self.table(self.identifier(self.nodes[plan["name"]]), plan["columns"], True)
        elif name in ("CreateTableAsSelect", "ReplaceTableAsSelect", "CreateView"):
            self.write(self.identifier(self.nodes[plan["name"]]), self.nodes[plan["query"]], "overwrite")
        elif name == "CreateViewCommand":
            self.write(plan["identifier"], self.nodes[plan["query"]], "overwrite")
        elif name == "InsertIntoStatement":
            self.write(self.identifier(self.nodes[plan["name"]]), self.nodes[plan["query"]], "overwrite" if plan["overwrite"] else "append")
        elif name == "MergeIntoTable":
            node, _ = self.relation(self.nodes[plan["query"]])
            aim = self.identifier(self.nodes[plan["name"]])
            self.edge("writes", source=node, target=f"table:{aim}", write_mode="merge", merge_keys=[a for a, _ in plan["pairs"]])
            self.table(aim)
        elif target or name in ("Project", "Aggregate", "UnresolvedWith", "Union", "Filter", "Join"):
            self.relation(plan, target)

    def children(self, plan: dict) -> list[dict]:
        return [self.nodes[i] for i in plan["children"]]

    def identifier(self, plan: dict) -> str:
        if "parts" in plan:
            return ".".join(plan["parts"])
        children = self.children(plan)
        return self.identifier(children[0]) if children else "<unresolved>"

    def write(self, aim: str, query: dict, mode: str) -> None:
        node, columns = self.relation(query)
        self.edge("writes", source=node, target=f"table:{aim}", write_mode=mode)
        self.table(aim, columns)

    def relation(self, plan: dict, target: str | None = None) -> tuple[str, list[str] | None]:
        """(node, columns if known) of a query plan; ``target`` names the node of its outermost step."""
        name = plan["kind"]
        children = self.children(plan)
        if name == "UnresolvedWith":
            for held in plan["ctes"]:
                cte = held["name"]
                self.ctes[cte.lower()] = self.relation(self.nodes[held["plan"]], self.fresh(cte))
            return self.relation(children[0], target)
        if name == "UnresolvedRelation":
            where = ".".join(plan["parts"])
            if where.lower() in self.ctes:
                node, columns = self.ctes[where.lower()]
                if target:
                    self.edge("opaque_transform", source=node, target=target, opaque_operator="select", is_passthrough=True)
                    return target, columns
                return node, columns
            node = target or self.fresh()
            self.edge("reads", source=f"table:{where}", target=node)
            self.table(where)
            return node, None
        if name in ("SubqueryAlias", "UnresolvedSubqueryColumnAliases") or (name in _PASS and not target):
            return self.relation(children[0], target)
        if name in ("OneRowRelation", "UnresolvedInlineTable", "LocalRelation"):
            return target or self.fresh(), None
        if name in ("Union", "Intersect", "Except"):
            node = target or self.fresh()
            columns = None
            for child in children:
                source, own = self.relation(child)
                columns = columns or own
                self.edge("opaque_transform", source=source, target=node, opaque_operator=name.lower(), is_passthrough=True)
            return node, columns
        if name == "Join":
            (left, a), (right, b) = self.relation(children[0]), self.relation(children[1])
            node = target or self.fresh()
            kind = plan["join"].lower().replace("outer", "").strip().replace(" ", "_").replace("full_", "full")
            keys = [(c, c) for c in plan.get("using", [])] or plan.get("pairs", [])
            self.edge("joins", source=left, right_source=right, target=node, join_type=kind, join_keys=[{"l": x, "r": y} for x, y in keys])
            return node, None if a is None or b is None else list(dict.fromkeys([*a, *b]))
        if not children:  # a table function, or a command whose result is used
            self.warning("opaque-call-fallback", f"the inputs of {name} are not known")
            return target or self.fresh(), None
        source, columns = self.relation(children[0])
        node = target or self.fresh()
        if name in ("Filter", "UnresolvedHaving"):
            condition = plan["condition"]
            text = condition["sql"]
            self.rows.append(("expression", {"expr_id": expr_id(text), "text": text}))
            self.edge("filters", source=source, target=node, expr_id=expr_id(text), referenced_cols=condition["names"])
            return node, columns
        if name in ("Project", "Aggregate"):
            return self.projection(plan, name, source, columns, node)
        self.edge("opaque_transform", source=source, target=node, opaque_operator=name, is_passthrough=name in _PASS)
        return node, columns if name in _PASS else None

    def projection(self, plan: dict, name: str, source: str, columns: list[str] | None, node: str) -> tuple[str, list[str] | None]:
        keys = plan.get("keys", [])
        outs, aggs, star = [], [], False
        for item in plan["items"]:
            if item["item"] == "UnresolvedStar":
                star = True
                continue
            alias = "alias" in item
            plain = item["kind"] == "UnresolvedAttribute"
            refs, text, call, window = item["names"], item["sql"], item.get("call"), item.get("window")
            out = item["alias"] if alias else refs[-1] if plain else text
            outs.append(out)
            if name == "Aggregate" and call is not None and window is None and not (plain and out in keys):
                op = ".".join(call).lower()
                aggs += [{"op": op, "input": c, "output": out} for c in refs or ["*"]]
            elif not plain or (alias and refs and refs[0] != out):
                self.rows.append(("expression", {"expr_id": expr_id(text), "text": text}))
                self.edge("derives", source=source, target=node, output_col=out, source_cols=refs, expr_id=expr_id(text), window_spec=self.window(window), rule_logic=item.get("rules"))
        if name == "Aggregate":
            self.edge("aggregates", source=source, target=node, group_keys=keys, aggs=aggs)
            return node, outs
        if star:
            self.edge("opaque_transform", source=source, target=node, opaque_operator="select *", is_passthrough=True)
            return node, None if columns is None else list(dict.fromkeys([*columns, *outs]))
        self.edge("projects", source=source, target=node, kept_cols=outs)
        return node, outs

    def window(self, spec: dict | None) -> dict | None:
        if not spec:  # none, or one defined elsewhere
            return None
        parts = [n for e in spec["partition"] for n in e["names"]]
        order = [" ".join([*e["names"], "desc" if "DESC" in e["sql"] else "asc"]) for e in spec["order"]]
        frame = spec["frame"]
        return {"partition_cols": parts, "order_cols": order, "frame": None if "Unspecified" in frame or "unspecified" in frame else frame}
