"""Splitting oversized items at natural boundaries.

Each item has a boundary strength at every position. A sparse table answers range-maximum queries over the strengths, so the
strongest cut in each permissible window of lengths is found in constant time; ties go to the right, and the next piece steps
back by the overlap where the cut is no natural boundary.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

LIMIT, OVERLAP = 512, 32
#: Strengths: the end of a chain, a low-complexity linker of small residues, and no boundary at all.
CHAIN_END, LINKER, NONE = 3, 1, 0
_letters = re.compile(r"[A-Za-z]+")
_mark = re.compile("[^A-Za-z\\s\\d*\\-\u00ad\u200b-\u200f\u2060\ufeff]")


class SparseTable:
    """Positions of range maxima, the rightmost of equals."""

    def __init__(self, strength: np.ndarray) -> None:
        self.s = strength
        self.rows = [np.arange(len(strength), dtype=np.int32)]
        half = 1
        while 2 * half <= len(strength):
            a, b = self.rows[-1][: -half or None], self.rows[-1][half:]
            a = a[: len(b)]
            self.rows.append(np.where(self.s[b] >= self.s[a], b, a))
            half *= 2

    def best(self, lo: int, hi: int) -> int:
        """The position of the greatest strength in ``lo..hi``, both included; the rightmost of equals."""
        k = (hi - lo + 1).bit_length() - 1
        a, b = int(self.rows[k][lo]), int(self.rows[k][hi - (1 << k) + 1])
        return b if self.s[b] >= self.s[a] else a


    def all_from(self, least: int) -> list[int]:
        """All positions of a strength of ``least`` or more, by range maxima: the best of a range, then of what lies before and behind."""
        out, stack = [], [(0, len(self.s) - 1)]
        while stack:
            lo, hi = stack.pop()
            if lo > hi:
                continue
            at = self.best(lo, hi)
            if self.s[at] >= least:
                out.append(at)
                stack += [(lo, at - 1), (at + 1, hi)]
        return sorted(out)


def chain_starts(text: str) -> tuple[str, list[int]]:
    """Residues of a cell in upper case, and where chains start: after each mark that isn't white space, a digit, a gap or a stop.
    Chains without residues don't count."""
    parts, starts, n, pos = [], [], 0, 0
    fresh = True
    for m in _letters.finditer(text):
        if _mark.search(text, pos, m.start()):
            fresh = True
        if fresh:
            starts.append(n)
            fresh = False
        parts.append(m[0])
        n += len(m[0])
        pos = m.end()
    return "".join(parts).upper(), starts


def strengths(residues: str, starts: Sequence[int]) -> np.ndarray:
    """Strength of a cut before each residue (and after the last): chain ends first, then linkers (a glycine, serine or proline on
    both sides, as in the loops between domains), then anywhere."""
    s = np.zeros(len(residues) + 1, np.int8)
    small = np.isin(np.frombuffer(residues.encode("ascii"), np.uint8), np.frombuffer(b"GSP", np.uint8))
    s[1:-1][small[1:] & small[:-1]] = LINKER
    s[[x for x in starts if x]] = CHAIN_END
    s[len(residues)] = CHAIN_END
    return s


def pieces(strength: np.ndarray, limit: int = LIMIT, overlap: int = OVERLAP, natural: int = CHAIN_END, table: SparseTable | None = None) -> list[tuple[int, int, int]]:
    """``(start, end, strength of the cut at its end)`` of consecutive pieces of at most ``limit``. Cuts of strength ``natural`` or
    more leave no overlap; after others the next piece starts ``overlap`` earlier, never before the last natural cut."""
    n = len(strength) - 1
    if n <= 0:
        return []
    if not 0 <= overlap < limit:
        raise ValueError("the overlap must be smaller than the limit")
    if n <= limit:
        return [(0, n, int(strength[n]))]
    table, out, start, floor = table or SparseTable(strength), [], 0, 0
    while True:
        if n - start <= limit:
            out.append((start, n, int(strength[n])))
            return out
        # The next cut lies behind the overlap, so every piece gets further; the best one, the rightmost of equals.
        lo = min(max(start, out[-1][1] if out else 0) + 1, start + limit)
        at = table.best(lo, start + limit)
        if strength[at] < natural:
            # Not at the price of tiny pieces: in the upper half of the window.
            at = table.best(max(lo, start + limit // 2 + 1), start + limit)
        out.append((start, at, int(strength[at])))
        start = at if strength[at] >= natural else max(at - overlap, floor)
        if strength[at] >= natural:
            floor = at


def chains_of_residues(residues: DataFrame) -> DataFrame:
    """``(id, changes)``: for each protein of ``residues`` the residue ids at which the chain differs from the residue before;
    repeated rows count once, null chains are a chain of their own."""
    r = residues.where("graph_id is not null and residue_id is not null").groupBy("graph_id", "residue_id").agg(F.min(F.coalesce("chain_id", F.lit(""))).alias("chain"))
    before = F.lag("chain").over(Window.partitionBy("graph_id").orderBy("residue_id"))
    return r.withColumn("b", before).where("b is not null and b <> chain").groupBy(F.col("graph_id").alias("id")).agg(F.sort_array(F.collect_list(F.col("residue_id").cast("int"))).alias("changes"))


def cut_proteins(proteins: DataFrame, residues: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """Pieces ``(id, piece, chain_no, start, end, residues, natural)`` of the proteins with more than ``limit`` residues, and
    ``chains``, all chain starts of the protein.

    Chains start at marks in the cell and, where a mark is missing, where ``residues.chain_id`` changes. A null sequence, or one
    of at most ``limit`` residues, gives no row. Repeated ids must be dropped before. A sequence of any length is cut whole.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for i, t, changes in zip(b["id"].tolist(), b["t"], b["changes"]):
                seq, starts = chain_starts(t)
                if len(seq) <= limit:
                    continue
                if changes is not None:
                    starts = sorted({*starts, *(int(x) for x in changes if 0 < x < len(seq))})
                s = strengths(seq, starts)
                table = SparseTable(s)
                found = pieces(s, limit, overlap, table=table)
                starts = [0, *(x for x in table.all_from(CHAIN_END) if 0 < x < len(seq))]
                number = np.searchsorted(starts, [s for s, _, _ in found], side="right") - 1
                rows += [(i, k, int(c), s, e, seq[s:e], w >= CHAIN_END, starts) for k, ((s, e, w), c) in enumerate(zip(found, number))]
            yield pd.DataFrame(rows, columns=["id", "piece", "chain_no", "start", "end", "residues", "natural", "chains"])

    p = proteins.select(F.col("protein_id").cast("long").alias("id"), F.col("sequence").cast("string").alias("t")).where(F.col("id").isNotNull() & (F.length("t") > limit))
    joined = p.join(chains_of_residues(residues.join(p.select(F.col("id").alias("graph_id")), "graph_id", "left_semi")), "id", "left")
    return joined.mapInPandas(run, "id long, piece int, chain_no int, start int, end int, residues string, natural boolean, chains array<int>")
