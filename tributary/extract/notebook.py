"""Notebook exports and notebooks to plain Python."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field

# Cell languages and magics whose content is no Python.
FOREIGN = ("%md", "%sql", "%sh", "%r", "%scala", "%fs", "%pip")
_COMMAND = re.compile(r"^# COMMAND -+\s*$")
_MAGIC = re.compile(r"^# MAGIC ?")


@dataclass
class Prepared:
    """Python text whose line numbers are kept, the first line of each cell, and the notebooks it runs."""

    text: str
    cells: list[int] = field(default_factory=list)
    runs: list[str] = field(default_factory=list)

    def cell_of(self, line: int) -> int:
        """Number of the cell a line lies in, from 0."""
        return max((i for i, first in enumerate(self.cells) if first <= line), default=0)


def _magic_cell(lines: list[str], runs: list[str]) -> list[str]:
    """A cell of magics: runs are noted, foreign languages blanked, other content kept."""
    body = [_MAGIC.sub("", line) for line in lines]
    head = next((b.strip() for b in body if b.strip()), "")
    if head.startswith("%run"):
        runs.append(head[4:].strip().strip("\"'"))
        return [""] * len(lines)
    word = head.split(None, 1)[0] if head else ""
    if word in FOREIGN:
        return [""] * len(lines)
    return ["" if b.lstrip().startswith("%") else b for b in body]


def prepare_python(text: str) -> Prepared:
    out, cells, runs, cell = [], [0], [], []

    def close() -> None:
        magic = any(_MAGIC.match(line) for line in cell)
        code = any(line.strip() and not line.startswith("#") for line in cell)
        out.extend(_magic_cell(["" if line.startswith("#") and not _MAGIC.match(line) else line for line in cell], runs) if magic and not code else ["" if _MAGIC.match(line) else line for line in cell])

    for line in text.splitlines():
        if _COMMAND.match(line):
            close()
            out.append("")
            cells.append(len(out))
            cell = []
        else:
            cell.append(line)
    close()
    return Prepared("\n".join(out) + "\n", cells, runs)


def prepare_notebook(text: str) -> Prepared:
    held = json.loads(text)
    out, cells, runs = [], [], []
    for cell in held.get("cells", []):
        cells.append(len(out))
        if cell.get("cell_type") != "code":
            continue
        source = cell.get("source") or ""
        lines = ("".join(source) if isinstance(source, list) else source).splitlines()
        stripped = [_MAGIC.sub("", line) for line in lines]
        head = next((s.strip() for s in stripped if s.strip()), "")
        if head.startswith("%"):
            stripped = _magic_cell(stripped, runs)
        out += ["" if s.lstrip().startswith(("%", "!")) else s for s in stripped]
    return Prepared("\n".join(out) + "\n", cells, runs)


def prepare(path: str, text: str) -> Prepared:
    return prepare_notebook(text) if path.lower().endswith(".ipynb") else prepare_python(text)


def run_target(path: str, target: str) -> str:
    """The path a ``%run`` names, relative to the notebook that runs it."""
    parts = path.split("/")[:-1] if not target.startswith("/") else []
    for piece in target.strip("/").split("/"):
        if piece == "..":
            parts = parts[:-1]
        elif piece not in (".", ""):
            parts.append(piece)
    return "/".join(parts)
