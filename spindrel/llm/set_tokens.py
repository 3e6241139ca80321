"""Token sets for set joins: five-residue stretches, a table of how frequent each token is, and bitmaps of token sets.

The frequency table has a fixed number of cells (``CELLS`` bytes, whatever the data's size), covers every row, and is the only
thing that is broadcast. It holds rounded logarithms of counts: enough to put rare tokens first and to tell hot ones.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Cells of the frequency table and of its ranges, residues of a stretch, and 64-bit words of a bitmap.
CELLS, RANGE, STRETCH, WORDS = 1 << 22, 1 << 14, 5, 16
_MIX = np.uint64(0x9E3779B97F4A7C15)


def stretches(residues: str, k: int = STRETCH) -> np.ndarray:
    """The distinct stretches of ``k`` letters of an upper-case text as sorted numbers, 5 bits a letter."""
    a = np.frombuffer(residues.encode("ascii"), np.uint8).astype(np.int64) & 31
    n = len(a) - k + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    out = np.zeros(n, np.int64)
    for i in range(k):
        out = (out << 5) | a[i : i + n]
    return np.unique(out)


def mixed(tokens: np.ndarray) -> np.ndarray:
    """Well-mixed 64-bit hashes of numbers."""
    x = tokens.astype(np.uint64)
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(31))) * _MIX
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return x ^ (x >> np.uint64(32))


def cell_of(tokens: np.ndarray) -> np.ndarray:
    return (mixed(tokens) & np.uint64(CELLS - 1)).astype(np.int64)


def bitmap(tokens: np.ndarray, words: int = WORDS) -> np.ndarray:
    bit = ((mixed(tokens) >> np.uint64(40)) % np.uint64(64 * words)).astype(np.int64)
    b = np.zeros(8 * words, np.uint8)
    np.bitwise_or.at(b, bit >> 3, (1 << (bit & 7)).astype(np.uint8))
    return b


def ones(words: np.ndarray) -> np.ndarray:
    """Set bits in rows of 64-bit words."""
    return np.bitwise_count(words).sum(axis=-1, dtype=np.int64)


def level_of(count: np.ndarray) -> np.ndarray:
    """0 for cells without a count, else 1 + 8 log2(count), rounded up, at most 255."""
    with np.errstate(divide="ignore"):
        return np.where(count > 0, np.minimum(255, 1 + np.ceil(8 * np.log2(count))), 0).astype(np.uint8)


def cell_table(rows: DataFrame, add: Callable[[np.ndarray, np.ndarray, pa.RecordBatch], None], tops: int = 0) -> np.ndarray:
    """``1 + tops`` rows of ``CELLS`` bytes: levels of counts, and largest values. ``add(counts, tops, batch)`` enters a batch of
    ``rows``. Partitions add up their own cells, ranges of cells are added up apart, each as one compressed row a partition, and
    ``CELLS`` bytes a row of the table reach the driver, however many rows there are."""
    spark, parts = rows.sparkSession, CELLS // RANGE
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, top = np.zeros(CELLS, np.int64), np.zeros((tops, CELLS), np.uint8)
        for b in batches:
            for lo in range(0, len(b), 2_000):
                add(counts, top, b.slice(lo, 2_000))
        live = np.flatnonzero(counts.reshape(parts, RANGE).any(axis=1))
        pack = lambda k: zlib.compress(counts[k * RANGE : (k + 1) * RANGE].tobytes(), 1)
        for lo in range(0, len(live), 64):
            of = live[lo : lo + 64].tolist()
            yield pa.RecordBatch.from_pydict({"range": pa.array(of, pa.int32()), "n": pa.array([pack(k) for k in of], pa.binary()), "top": pa.array([zlib.compress(top[:, k * RANGE : (k + 1) * RANGE].tobytes(), 1) for k in of], pa.binary())})

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[np.ndarray]] = {}
        for b in batches:
            for k, c, t in zip(b.column("range").to_pylist(), b.column("n").to_pylist(), b.column("top").to_pylist()):
                c, t = np.frombuffer(zlib.decompress(c), np.int64), np.frombuffer(zlib.decompress(t), np.uint8)
                held[k] = [held[k][0] + c, np.maximum(held[k][1], t)] if k in held else [c, t]
        yield pa.RecordBatch.from_pydict({"range": pa.array(list(held), pa.int32()), "bytes": pa.array([level_of(c).tobytes() + t.tobytes() for c, t in held.values()], pa.binary())})

    table = np.zeros((1 + tops, CELLS), np.uint8)
    ranges = rows.mapInArrow(count, "range int, n binary, top binary").repartitionById(n, F.pmod("range", F.lit(n)).cast("int"))
    for r in ranges.mapInArrow(total, "range int, bytes binary").collect():
        table[:, r["range"] * RANGE : (r["range"] + 1) * RANGE] = np.frombuffer(bytes(r["bytes"]), np.uint8).reshape(1 + tops, RANGE)
    return table


def frequency_table(sets: DataFrame) -> np.ndarray:
    """For each cell the level of how many sets of ``sets (tokens array<long>)`` have a token there. Counts cover all rows."""

    def add(counts: np.ndarray, _: np.ndarray, b: pa.RecordBatch) -> None:
        at, n = np.unique(cell_of(b.column("tokens").flatten().to_numpy(zero_copy_only=False)), return_counts=True)
        counts[at] += n

    return cell_table(sets.select("tokens").where(F.size("tokens") > 0), add)[0]


def most(level: np.ndarray) -> np.ndarray:
    """The greatest count that a level of the table stands for."""
    return np.where(level == 0, 0.0, np.exp2((level.astype(np.float64) - 1) / 8))
