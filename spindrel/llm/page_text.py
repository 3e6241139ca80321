"""Scanned pages as text in reading order, and a folded form in which misread letters look alike."""

from __future__ import annotations

import re
import unicodedata
from itertools import accumulate

import numpy as np

_gap = re.compile(r"(?<=\S) {3,}(?=\S)")
#: Pixels by which left edges of one column may differ.
EDGE = 90


def segments(text: str, x0: np.ndarray | None, y0: np.ndarray | None) -> list[tuple[int, int]]:
    """``(start, end)`` of the runs of ``text`` that lie in one column of one line, in reading order: column by column, each from
    top to bottom. Lines that run over two columns are cut at their wide gaps. Without a layout (null, or not one box a line) the
    delivered order stays, with second halves of joined lines behind the first ones."""
    lines = text.split("\n")
    start = [0, *accumulate([len(x) + 1 for x in lines])]
    laid = x0 is not None and y0 is not None and len(x0) == len(lines) and len(y0) == len(lines)
    column, height = None, None
    if laid and len(lines) > 1:
        xs = np.sort(x0)
        edges = np.concatenate([xs[:1], xs[1:][xs[1:] - xs[:-1] > EDGE]])
        column, height = np.searchsorted(edges, x0 + EDGE // 2, side="right"), y0
    if "   " not in text:
        order = range(len(lines)) if column is None else np.lexsort((height, column)).tolist()
        return [(start[k], start[k + 1] - 1) for k in order if lines[k]]
    found = []  # column, height, line, start, end
    for k, line in enumerate(lines):
        c, y, at, lo = int(column[k]) if column is not None else 1, int(height[k]) if height is not None else k, start[k], 0
        for m in _gap.finditer(line) if "   " in line else ():
            found.append((c, y, k, at + lo, at + m.start()))
            c, lo = c + 1, m.end()
        found.append((c, y, k, at + lo, at + len(line)))
    found.sort(key=lambda s: s[:3])
    return [(s[3], s[4]) for s in found if s[4] > s[3]]


# Letters that are read for each other, by the one they are folded to; and pairs that are read for one letter.
_ALIKE = {"e": "ec", "i": "ril1j|!", "t": "tf", "o": "oa0", "n": "nu", "h": "hb8", "s": "s5", "g": "gq"}
_PAIRS = (("cl", "d"), ("rn", "m"), ("vv", "w"))


def _letters() -> dict[int, str | None]:
    """Letters in lower case without their accents, digits and line breaks, and nothing for other characters of the western blocks."""
    out: dict[int, str | None] = {}
    for c in [*range(0x250), *range(0x2000, 0x2070)]:
        x = chr(c)
        base = unicodedata.normalize("NFD", x.lower())[0]
        out[c] = base if base.isalnum() or x in "|!" else None
    out[10] = "\n"
    return {**out, ord("ß"): "ss", ord("æ"): "ae", ord("œ"): "oe", ord("Æ"): "ae", ord("Œ"): "oe"}


LETTERS = _letters()
ALIKE = {ord(c): to for to, all_ in _ALIKE.items() for c in all_}


def fold(text: str) -> str:
    """Letters, digits and line breaks only, those that are read for each other alike."""
    t = text.translate(LETTERS)
    for a, b in _PAIRS:
        t = t.replace(a, b)
    return t.translate(ALIKE)
