"""Window hashes of texts in NumPy: a rolling polynomial over code points, thinned by winnowing.

Of every window of ``span`` characters at least the ``gram`` of least hash is selected, so two texts
with ``span`` characters in common always share a selected hash at the same place of the passage.
"""

from __future__ import annotations

import numpy as np

PIECE = 1 << 20  # characters hashed at once
_BASE = 0x9E3779B97F4A7C15 | 1
_U = np.uint64


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, so that neighbouring values have unrelated images."""
    x = x ^ (x >> _U(30))
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = pow(_BASE, -1, 1 << 64)
    up, down = np.full(n, _BASE, dtype=_U), np.full(n, inverse, dtype=_U)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


class Windows:
    """Hashes of the character windows of many texts laid end to end."""

    def __init__(self, longest: int = PIECE):
        self.up, self.down = _powers(longest + 1)

    def prefix(self, codes: np.ndarray) -> np.ndarray:
        if len(codes) + 1 > len(self.up):
            self.up, self.down = _powers(len(codes) + 1)
        out = np.zeros(len(codes) + 1, dtype=_U)
        np.cumsum(mixed(codes.astype(_U) + _U(1)) * self.up[: len(codes)], out=out[1:])
        return out

    def hashes(self, prefix: np.ndarray, start: np.ndarray | slice, length: int) -> np.ndarray:
        """Hash of the window of ``length`` characters at each start (a slice means all starts)."""
        if isinstance(start, slice):
            n = len(prefix) - length
            return mixed((prefix[length:] - prefix[:n]) * self.down[:n])
        return mixed((prefix[start + length] - prefix[start]) * self.down[start])


def _sliding(values: np.ndarray, width: int, fold: np.ufunc, fill: int) -> np.ndarray:
    """Fold of values[i : i + width] for each i with a whole window (two passes over blocks)."""
    n = len(values)
    blocks = -(-n // width)
    padded = np.full(blocks * width, fill, dtype=values.dtype)
    padded[:n] = values
    grid = padded.reshape(blocks, width)
    head = fold.accumulate(grid, axis=1).reshape(-1)
    tail = fold.accumulate(grid[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    m = n - width + 1
    return fold(tail[:m], head[width - 1 : width - 1 + m])


def pieces(texts: list[str | None], span: int, limit: int = PIECE):
    """(rows, starts in text, code points, bounds) of groups of texts; a text above ``limit`` goes in pieces that overlap by span - 1."""
    rows, begins, parts, size = [], [], [], 0
    for row, text in enumerate(texts):
        if text is None or len(text) < span:
            continue
        for begin in range(0, max(1, len(text) - span + 1), limit):
            part = text[begin : begin + limit + span - 1]
            if size and size + len(part) > limit:
                yield rows, begins, parts
                rows, begins, parts, size = [], [], [], 0
            rows.append(row)
            begins.append(begin)
            parts.append(part)
            size += len(part)
    if rows:
        yield rows, begins, parts


def code_points(parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    codes = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    return codes, np.concatenate(([0], np.cumsum([len(p) for p in parts])))


def winnow(texts: list[str | None], span: int, gram: int, windows: Windows | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, position, hash) of the selected grams of all texts; texts shorter than ``span`` have none."""
    windows = windows or Windows()
    width = span - gram + 1
    out_row, out_pos, out_hash = [], [], []
    for rows, begins, parts in pieces(texts, span):
        codes, bounds = code_points(parts)
        hashes = windows.hashes(windows.prefix(codes), slice(None), gram)
        least = _sliding(hashes, width, np.minimum, 2**64 - 1)
        whole = np.zeros(len(least), dtype=bool)
        for a, b in zip(bounds[:-1], bounds[1:]):
            whole[a : b - span + 1] = True
        least[~whole] = 0  # windows across two texts select nothing
        pad = np.zeros(width - 1, dtype=_U)
        best = _sliding(np.concatenate((pad, least, pad)), width, np.maximum, 0)
        chosen = np.flatnonzero((best == hashes) & (hashes > 0))
        which = np.searchsorted(bounds, chosen, side="right") - 1
        out_row.append(np.asarray(rows)[which])
        out_pos.append(chosen - bounds[which] + np.asarray(begins)[which])
        out_hash.append(hashes[chosen])
    if not out_row:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=_U)
    return np.concatenate(out_row), np.concatenate(out_pos), np.concatenate(out_hash)
