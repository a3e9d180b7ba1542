"""JSON: tokens and grammar."""

from __future__ import annotations

import re

GRAMMAR = """
text: value
value: object / array / STRING / NUMBER / 'true' / 'false' / 'null'
object: '{' (member (',' member)*)? '}'
member: STRING ':' value
array: '[' (value (',' value)*)? ']'
"""

_TOKEN = re.compile(r"""[ \t\r\n]*(?:([{}\[\],:])|("(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*")|(-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?)|(true|false|null)(?![A-Za-z0-9_])|(\Z)|(.))""", re.S | re.A)


def tokens(text: str) -> tuple[list[str], list[int], str]:
    """(token classes, offsets, cause of a lexical failure)."""
    kinds, at, pos = [], [], 0
    match = _TOKEN.match
    while True:
        m = match(text, pos)
        group = m.lastindex
        start = m.start(group)
        at.append(start)
        if group == 5:
            kinds.append("EOF")
            return kinds, at, ""
        if group == 6:
            kinds += ["BAD", "EOF"]
            at.append(start)
            return kinds, at, "unterminated string" if text[start] == '"' else "character"
        kinds.append(m.group(group) if group in (1, 4) else "STRING" if group == 2 else "NUMBER")
        pos = m.end()
