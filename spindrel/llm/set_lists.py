"""Lists of sets under shared tokens, as set joins exchange and read them.

A set moves once a bucket, not once a token: with its id, size, bitmap, and those of its posted tokens that fall into the bucket, as
arrays. A row of the exchange holds some hundred sets of a bucket, packed and compressed, and a task builds all lists of a bucket at
once. Buckets are exchanged in rounds, each of which moves no more than a few times what the tokens take; a round's files go with it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrel.llm.set_tokens import mixed, ones
from spindrel.session import dropped, small_batches, written

#: Postings that a bucket holds on average, at most; sets that one token may bring together in one list (more go in blocks, block
#: against block); rows, list members and pairs that a task handles at a time.
BUCKET, BLOCK, ROWS, SLAB, PAIRS = 1_000_000, 4096, 1_000, 100_000, 400_000
#: Bits of bitmaps; a set gets the least width that is two and a half times its size, the last one any size.
WIDTHS = (512, 1024, 2048, 4096, 16384, 65536)
#: Bytes that a round may move whatever the tokens' number, and for each token; rows of the exchange that a task takes at a time.
ROUND, ROUND_TOKEN, PACKS = 256_000_000, 8, 100


def expand(a: np.ndarray, na: np.ndarray, b: np.ndarray, nb: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of the ranges ``a .. a + na`` and ``b .. b + nb``, range pair by range pair, some ``PAIRS`` at a time."""
    count = na * nb
    ends = np.cumsum(count)
    lo = 0
    while lo < len(count):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + PAIRS, side="right")))
        c = count[lo:hi]
        owner = np.repeat(np.arange(lo, hi), c)
        k = np.arange(int(c.sum())) - np.repeat(np.cumsum(c) - c, c)
        width = nb[owner]
        yield a[owner] + k // width, b[owner] + k % width
        lo = hi


def width_of(n: np.ndarray) -> np.ndarray:
    """For each size the number of its width in ``WIDTHS``."""
    return np.minimum(np.searchsorted(np.array(WIDTHS) * 2 // 5, n), len(WIDTHS) - 1)


def packed_bits(owner: np.ndarray, hashes: np.ndarray, n: np.ndarray) -> list[bytes]:
    """The bitmap of each of the sets 0 .. len(n) - 1, whose tokens' hashes are given with their owners."""
    kind, out = width_of(n), np.empty(len(n), object)
    for k, width in enumerate(WIDTHS):
        mine = np.flatnonzero(kind == k)
        if not len(mine):
            continue
        row = np.full(len(n), -1)
        row[mine] = np.arange(len(mine))
        r = row[owner]
        at = r >= 0
        r, bit = r[at], ((hashes[at] >> np.uint64(40)) % np.uint64(width)).astype(np.int64)
        step = max(1, (1 << 24) // width)
        for lo in range(0, len(mine), step):
            part = np.zeros((min(step, len(mine) - lo), width), bool)
            inside = (r >= lo) & (r < lo + step)
            part[r[inside] - lo, bit[inside]] = True
            packed = np.packbits(part, axis=1, bitorder="little")
            for i, x in zip(mine[lo : lo + step], packed):
                out[i] = x.tobytes()
    return out.tolist()


class Bitmaps:
    """Bitmaps of sets at all widths that they have; the narrowest one for all."""

    def __init__(self, bits: pa.Array | list[bytes], n: np.ndarray) -> None:
        bits = pa.array(bits, pa.binary()) if isinstance(bits, list) else bits
        first = np.frombuffer(bits.buffers()[1], np.int32)[bits.offset : bits.offset + len(bits)].astype(np.int64) if len(bits) else np.zeros(0, np.int64)
        flat = np.frombuffer(bits.buffers()[2], np.uint8) if len(bits) else np.zeros(0, np.uint8)
        # Bitmaps are of whole 64-bit words, one after the other.
        base = int(first[0]) if len(first) else 0
        flat, first = flat[base : base + (len(flat) - base) // 8 * 8].view(np.uint64), (first - base) // 8
        self.n, self.kind = n, width_of(n)
        self.at, self.words = [], []
        for k, width in enumerate(WIDTHS):
            mine = np.flatnonzero(self.kind >= k)
            if k and not len(mine):
                break
            words = np.zeros((len(mine), width // 64), np.uint64)
            for own in np.unique(self.kind[mine]):
                of = np.flatnonzero(self.kind[mine] == own)
                step = max(1, (1 << 24) // WIDTHS[own])
                for lo in range(0, len(of), step):
                    some = of[lo : lo + step]
                    full = flat[first[mine[some]][:, None] + np.arange(WIDTHS[own] // 64)].reshape(len(some), -1, width // 64)
                    words[some] = np.bitwise_or.reduce(full, axis=1)  # places are remainders, so a wide bitmap folds to a narrow one
            at = np.full(len(n), -1)
            at[mine] = np.arange(len(mine))
            self.at.append(at)
            self.words.append(words)
        self.spare = [n[np.flatnonzero(self.kind >= k)] - ones(w) for k, w in enumerate(self.words)]

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """The most tokens that sets ``i`` and ``j`` can share: shared bits, and tokens that share a bit with others of their set."""
        out = np.empty(len(i), np.int64)
        kind = np.minimum(self.kind[i], self.kind[j])
        for k, (at, words, spare) in enumerate(zip(self.at, self.words, self.spare)):
            mine = np.flatnonzero(kind == k)
            step = max(1, 16_000_000 // words.shape[1] // 8)
            for lo in range(0, len(mine), step):
                m = mine[lo : lo + step]
                a, b = at[i[m]], at[j[m]]
                out[m] = ones(words[a] & words[b]) + np.minimum(spare[a], spare[b])
        return out


def flattened(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The values of a list column, and the number of each row's."""
    n = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    return column.flatten().to_numpy(zero_copy_only=False), n


def blocked(token: np.ndarray, ids: np.ndarray, most: np.ndarray, side: int | None, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """Keys of lists for postings of ``token`` by sets ``ids``, and which posting each comes from. A token that ``most`` sets may have,
    more than ``block``, has a list for each pair of blocks of sets; within one table (``side`` None) for each unordered pair,
    else for a block of the left (0) and one of the right side (1)."""
    blocks = np.ceil(most / block).astype(np.int64)
    copy = np.repeat(np.arange(len(token)), blocks)
    other = np.arange(len(copy)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    mine = ((mixed(ids) >> np.uint64(8)) % blocks.astype(np.uint64)).astype(np.int64)[copy]
    p, q = (np.minimum(mine, other), np.maximum(mine, other)) if side is None else (mine, other) if side == 0 else (other, mine)
    key = mixed(token[copy])
    hot = blocks[copy] > 1
    with np.errstate(over="ignore"):
        key[hot] = mixed((key[hot] + p[hot].astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F) + q[hot].astype(np.uint64) * np.uint64(0x165667B19E3779F9)).astype(np.int64))
    return key, copy


def slices(batches: Iterator[pa.RecordBatch], rows: int = ROWS) -> Iterator[pa.RecordBatch]:
    """The rows of batches again, ``rows`` at a time, whatever the size of the batches."""
    held: list[pa.RecordBatch] = []
    n = 0
    for b in batches:
        while len(b):
            part, b = b.slice(0, rows - n), b.slice(rows - n)
            held.append(part)
            n += len(part)
            if n == rows:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, n = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


PACKED = "bucket int, data binary"
_PLACE = pa.schema([("bucket", pa.int32()), ("data", pa.binary())])


def bucketed(owner: np.ndarray, key: np.ndarray, values: dict[str, np.ndarray], buckets: int, part: tuple[int, int], fixed: Callable[[np.ndarray], dict[str, pa.Array]]) -> pa.RecordBatch:
    """One row a bucket of ``part``, from its first to before its second: the sets there, packed, with the columns that ``fixed``
    gives for them and arrays of their keys and of ``values``."""
    bucket = (key % np.uint64(buckets)).astype(np.int64)
    at = np.flatnonzero((bucket >= part[0]) & (bucket < part[1]))
    order = at[np.lexsort((owner[at], bucket[at]))]
    owner, bucket, key = owner[order], bucket[order], key[order]
    if not len(owner):
        return pa.RecordBatch.from_pylist([], _PLACE)
    new = np.flatnonzero(np.concatenate([[True], (owner[1:] != owner[:-1]) | (bucket[1:] != bucket[:-1])]))
    offsets = pa.array(np.append(new, len(owner)).astype(np.int32))
    columns = {**fixed(owner[new]), "keys": pa.ListArray.from_arrays(offsets, pa.array((key >> np.uint64(33)).astype(np.int32)))}  # lists that share a key only give more to check
    for name, v in values.items():
        columns[name] = pa.ListArray.from_arrays(offsets, pa.array(v[order]))
    rows, of = pa.RecordBatch.from_pydict(columns), bucket[new]
    cuts = np.concatenate([[0], np.flatnonzero(of[1:] != of[:-1]) + 1, [len(of)]])
    return pa.RecordBatch.from_arrays([pa.array(of[cuts[:-1]].astype(np.int32)), pa.array([_packed(rows.slice(lo, hi - lo)) for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist())], pa.binary())], schema=_PLACE)


def _packed(rows: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(rows)
    return sink.getvalue().to_pybytes()


def exchanged(rows: DataFrame, n: int, part: tuple[int, int]) -> DataFrame:
    """Packed rows of the buckets of ``part``, a bucket in one partition; sorted where a partition has several."""
    parts = min(n, part[1] - part[0])
    out = rows.repartitionById(parts, F.pmod("bucket", F.lit(parts)).cast("int"))
    return out if parts == part[1] - part[0] else out.sortWithinPartitions("bucket")


def by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Whole buckets, unpacked, of batches of packed rows sorted by bucket."""
    held: list[pa.RecordBatch] = []
    at = None
    for b in batches:
        for k, data in zip(b.column("bucket").to_pylist(), b.column("data")):
            if k != at and held:
                yield pa.Table.from_batches(held)
                held = []
            at = k
            held += pa.ipc.open_stream(data.as_buffer()).read_all().to_batches()
    if held:
        yield pa.Table.from_batches(held)


def number_of_buckets(postings: int, partitions: int, cores: int) -> int:
    """So many that a bucket holds some ``BUCKET`` postings at most, and that all cores have work, but no more: each holds its sets anew."""
    return max(1, min(partitions, 2 * cores), -(-postings // BUCKET))


def rounds(sets: int, tokens: int, postings: int, buckets: int) -> list[tuple[int, int]]:
    """Ranges of buckets, one a round, such that a round moves about ``ROUND_TOKEN`` bytes a token, or ``ROUND`` if that is more.
    A set moves a posting at most for each of its tokens, so the number of rounds stays below a bound whatever the number of sets."""
    sets = max(1, sets)
    rows = sets * buckets * -np.expm1(-postings / sets / buckets)
    moved = rows * (20 + 0.5 * tokens / sets) + 8 * postings
    r = int(min(buckets, max(1, np.ceil(moved / max(ROUND, ROUND_TOKEN * tokens)))))
    return [(k * buckets // r, (k + 1) * buckets // r) for k in range(r)]


def met(rows: Callable[[tuple[int, int]], DataFrame], meet: Callable, columns: tuple[str, str], n: int, of: list[tuple[int, int]]) -> DataFrame:
    """The different pairs that ``meet`` finds in the buckets of packed ``rows(part)``, written: round by round, each round's shuffle
    files gone before the next."""
    schema = ", ".join(f"{c} long" for c in columns)
    found = []
    for part in of:
        r = rows(part)
        with small_batches(r.sparkSession, PACKS):
            found.append(written(exchanged(r, n, part).mapInArrow(meet, schema).distinct(), "pairs"))
    if len(found) == 1:
        return found[0]
    out = written(reduce(DataFrame.unionByName, found).distinct(), "pairs")
    for x in found:
        dropped(x)
    return out
