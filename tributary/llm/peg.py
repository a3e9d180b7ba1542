"""Packrat parsing of parsing-expression grammars over tokens.

A grammar is text: ``name: alternatives`` with ``/`` for ordered choice, ``* + ?`` for repetition,
``& !`` for lookahead, quoted text for a token of that text and CAPITALS for a token class. It is
compiled to Python functions; named rules are memoised by position, and the first tokens of an
alternative are computed so that hopeless ones are skipped. Parsing only recognises: it returns the
furthest position at which a token failed, or none where the whole input was consumed.
"""

from __future__ import annotations

import re

_PART = re.compile(r"\s*(?:(?P<lit>'[^']+')|(?P<name>[A-Za-z_]\w*)|(?P<op>[()/*+?&!]))")
_RULE = re.compile(r"^(\w+):", re.M)


class Node:
    """An expression: kind, and its text or parts."""

    __slots__ = ("first", "kind", "nullable", "parts", "text")

    def __init__(self, kind: str, text: str = "", parts: list[Node] | None = None):
        self.kind, self.text, self.parts = kind, text, parts or []
        self.first: frozenset = frozenset()
        self.nullable = kind in ("star", "opt", "and", "not")


def read(grammar: str) -> dict[str, Node]:
    rules: dict[str, Node] = {}
    heads = list(_RULE.finditer(grammar))
    for head, following in zip(heads, [*heads[1:], None]):
        body = grammar[head.end() : following.start() if following else len(grammar)]
        parts = [m for m in _PART.finditer(re.sub(r"#.*", "", body))]
        node, at = _choice(parts, 0)
        if at != len(parts):
            raise ValueError(f"rule {head.group(1)}: {parts[at].group()!r} is out of place")
        rules[head.group(1)] = node
    return rules


def _choice(parts, at):
    options = []
    while True:
        items = []
        while at < len(parts) and parts[at].group("op") not in ("/", ")"):
            item, at = _suffixed(parts, at)
            items.append(item)
        options.append(items[0] if len(items) == 1 else Node("seq", parts=items))
        if at < len(parts) and parts[at].group("op") == "/":
            at += 1
            continue
        return (options[0] if len(options) == 1 else Node("choice", parts=options)), at


def _suffixed(parts, at):
    op = parts[at].group("op")
    if op in ("&", "!"):
        item, at = _suffixed(parts, at + 1)
        return Node("and" if op == "&" else "not", parts=[item]), at
    if op == "(":
        item, at = _choice(parts, at + 1)
        at += 1
    elif parts[at].group("lit"):
        item, at = Node("token", parts[at].group("lit")[1:-1]), at + 1
    else:
        name = parts[at].group("name")
        item, at = Node("token" if name.isupper() else "rule", name), at + 1
    while at < len(parts) and parts[at].group("op") in ("*", "+", "?"):
        item = Node({"*": "star", "+": "plus", "?": "opt"}[parts[at].group("op")], parts=[item])
        at += 1
    return item, at


def _analyse(rules: dict[str, Node]) -> None:
    """First tokens and nullability, to a fixed point."""
    every: list[Node] = []

    def collect(node):
        every.append(node)
        for part in node.parts:
            collect(part)

    for node in rules.values():
        collect(node)
    changed = True
    while changed:
        changed = False
        for node in every:
            first, nullable = node.first, node.nullable
            if node.kind == "token":
                first = frozenset([node.text])
            elif node.kind == "rule":
                first, nullable = rules[node.text].first, rules[node.text].nullable
            elif node.kind in ("star", "opt", "plus"):
                first = node.parts[0].first
                nullable = nullable or node.parts[0].nullable
            elif node.kind == "choice":
                first = frozenset().union(*(p.first for p in node.parts))
                nullable = any(p.nullable for p in node.parts)
            elif node.kind == "seq":
                first, nullable = frozenset(), True
                for part in node.parts:
                    if part.kind not in ("and", "not"):
                        first |= part.first
                    if not part.nullable:
                        nullable = False
                        break
            if (first, nullable) != (node.first, node.nullable):
                node.first, node.nullable, changed = first, nullable, True


class _Compiler:
    def __init__(self, rules: dict[str, Node]):
        self.rules, self.lines, self.sets, self.n = rules, [], {}, 0

    def first_set(self, node: Node) -> str:
        return self.sets.setdefault(node.first, f"S{len(self.sets)}")

    def function(self, node: Node) -> str:
        """Define a function for the node; its name."""
        if node.kind == "rule":
            return f"r_{node.text}"
        self.n += 1
        name = f"f{self.n}"
        body = self.body(node)
        self.lines += [f" def {name}(p):", "  nonlocal far", *body]
        return name

    def step(self, node: Node, pad: str, fail: str) -> list[str]:
        """Lines that move p over the node, or run ``fail``."""
        if node.kind == "token":
            return [f"{pad}if T[p] != {node.text!r}:", f"{pad} if p > far: far = p", f"{pad} {fail}", f"{pad}p += 1"]
        if node.kind == "seq":
            return [line for part in node.parts for line in self.step(part, pad, fail)]
        if node.kind == "opt" and not node.parts[0].nullable:
            name = self.function(node.parts[0])
            return [f"{pad}if T[p] in {self.first_set(node.parts[0])}:", f"{pad} q = {name}(p)", f"{pad} if q >= 0: p = q", f"{pad}elif p > far: far = p"]
        if node.kind in ("star", "plus") and not node.parts[0].nullable:
            name, first = self.function(node.parts[0]), self.first_set(node.parts[0])
            lines = [] if node.kind == "star" else [f"{pad}p = {name}(p) if T[p] in {first} else -1 - p", f"{pad}if p < 0:", f"{pad} if -1 - p > far: far = -1 - p", f"{pad} {fail}"]
            return [*lines, f"{pad}while T[p] in {first}:", f"{pad} q = {name}(p)", f"{pad} if q < 0: break", f"{pad} p = q", f"{pad}if p > far: far = p"]
        if node.kind in ("and", "not"):
            # what a lookahead meets is no failure of the input
            name = self.function(node.parts[0])
            want = "<" if node.kind == "and" else ">="
            return [f"{pad}keep = far", f"{pad}q = {name}(p)", f"{pad}far = keep", f"{pad}if q {want} 0:", f"{pad} if p > far: far = p", f"{pad} {fail}"]
        name = self.function(node)
        guard = [] if node.nullable else [f"{pad}if T[p] not in {self.first_set(node)}:", f"{pad} if p > far: far = p", f"{pad} {fail}"]
        return [*guard, f"{pad}p = {name}(p)", f"{pad}if p < 0: {fail}"]

    def body(self, node: Node) -> list[str]:
        if node.kind == "choice":
            lines = ["  t = T[p]"]
            for part in node.parts:
                if part.kind == "token":
                    lines += [f"  if t == {part.text!r}: return p + 1"]
                    continue
                name = self.function(part)
                guard = "" if part.nullable else f"if t in {self.first_set(part)}: "
                lines += [f"  q = {name}(p)" if not guard else f"  {guard}q = {name}(p)", "  else: q = -1" if guard else "  pass", "  if q >= 0: return q"]
            return [*lines, "  if p > far: far = p", "  return -1"]
        return [*self.step(node, "  ", "return -1"), "  return p"]

    def source(self, start: str) -> str:
        for name, node in self.rules.items():
            inner = self.function(node) if node.kind != "rule" else f"r_{node.text}"
            self.lines += [f" m_{name} = {{}}", f" def r_{name}(p):", f"  q = m_{name}.get(p)", f"  if q is None: q = m_{name}[p] = {inner}(p)", "  return q"]
        head = [f"{name} = {set(first)!r}" for first, name in self.sets.items()]
        return "\n".join([*head, "def parse(T):", " far = 0", *self.lines, f" end = r_{start}(0)", " return None if end >= 0 and T[end] == 'EOF' else max(far, end)"])


def compiled(grammar: str, start: str):
    """parse(tokens) of a grammar: None for a whole match, else the furthest failing token. ``tokens`` end with 'EOF'."""
    rules = read(grammar)
    _analyse(rules)
    space: dict = {}
    exec(compile(_Compiler(rules).source(start), "<grammar>", "exec"), space)  # the source is made of the grammar's own text
    return space["parse"]
