"""Constants of a repository, and what is registered about its helpers and sinks."""

from __future__ import annotations

import ast
import json
from dataclasses import dataclass, field
from pathlib import Path

UNRESOLVED = "<unresolved>"


@dataclass
class Symbols:
    """Names with known values; lookups of unknown ones give the unresolved mark."""

    values: dict[str, object] = field(default_factory=dict)

    def learn(self, tree: ast.AST, module: str | None = None) -> None:
        """Top-level assignments of one name, and those in classes as ``Class.NAME``, to values that can be worked out, in order.

        With ``module`` they are known as ``module.NAME`` too, which is how a file that imports the module asks for them.
        """
        for owner, node in [("", n) for n in getattr(tree, "body", [])] + [(f"{c.name}.", n) for c in getattr(tree, "body", []) if isinstance(c, ast.ClassDef) for n in c.body]:
            target = node.targets[0] if isinstance(node, ast.Assign) and len(node.targets) == 1 else node.target if isinstance(node, ast.AnnAssign) else None
            if isinstance(target, ast.Name):
                value = self.value(node.value)
                if value is not None:
                    for prefix in ("", f"{module}.") if module else ("",):
                        self.values[f"{prefix}{owner}{target.id}"] = value

    def imports(self, tree: ast.AST) -> None:
        """Names under which a file imports modules with known values, or such values."""
        for node in ast.walk(tree):
            if isinstance(node, ast.Import):
                for a in node.names:
                    self._known_as(a.name.rpartition(".")[2], a.asname or a.name)
            elif isinstance(node, ast.ImportFrom):
                module = (node.module or "").rpartition(".")[2]
                for a in node.names:
                    if f"{module}.{a.name}" in self.values:
                        self.values[a.asname or a.name] = self.values[f"{module}.{a.name}"]
                    self._known_as(a.name, a.asname or a.name)
                    self._known_as(f"{module}.{a.name}", a.asname or a.name)

    def _known_as(self, name: str, alias: str) -> None:
        if name != alias:
            self.values |= {f"{alias}.{k[len(name) + 1 :]}": v for k, v in self.values.items() if k.startswith(f"{name}.")}

    def value(self, node: ast.AST | None) -> object | None:
        if isinstance(node, ast.Constant):
            return node.value
        if isinstance(node, ast.Name):
            return self.values.get(node.id)
        if isinstance(node, ast.Attribute):
            owner = _dotted(node.value)  # a name of another module or class is not this one's
            return self.values.get(f"{owner}.{node.attr}") if owner else None
        if isinstance(node, ast.UnaryOp) and isinstance(node.op, ast.USub):
            held = self.value(node.operand)
            return -held if isinstance(held, (int, float)) else None
        if isinstance(node, ast.JoinedStr):
            parts = [self.value(v.value if isinstance(v, ast.FormattedValue) else v) for v in node.values]
            return None if any(p is None for p in parts) else "".join(str(p) for p in parts)
        if isinstance(node, ast.BinOp) and isinstance(node.op, ast.Add):
            a, b = self.value(node.left), self.value(node.right)
            return a + b if isinstance(a, str) and isinstance(b, str) else None
        if isinstance(node, (ast.List, ast.Tuple)):
            held = [self.value(v) for v in node.elts]
            return None if any(v is None for v in held) else held
        return None

    def text(self, node: ast.AST | None) -> str:
        held = self.value(node)
        return held if isinstance(held, str) else UNRESOLVED


def _dotted(node: ast.AST) -> str | None:
    if isinstance(node, ast.Name):
        return node.id
    if isinstance(node, ast.Attribute):
        owner = _dotted(node.value)
        return f"{owner}.{node.attr}" if owner else None
    return None


@dataclass
class Registry:
    """helpers: function to {kind: passthrough or suffix_rename, suffix_arg}; sinks: class to {target_kwarg, mode_kwarg, merge_keys_kwarg, default_mode}."""

    helpers: dict[str, dict] = field(default_factory=dict)
    sinks: dict[str, dict] = field(default_factory=dict)

    @classmethod
    def load(cls, helpers: str | Path | None, sinks: str | Path | None) -> Registry:
        read = lambda p: json.loads(Path(p).read_text()) if p and Path(p).exists() else {}
        return cls(read(helpers), read(sinks))

    def helper(self, name: str) -> dict | None:
        return self.helpers.get(name) or self.helpers.get(name.rpartition(".")[2])

    def sink(self, name: str) -> dict | None:
        return self.sinks.get(name) or self.sinks.get(name.rpartition(".")[2])
