"""Same or near-same records across splits: a weighted cosine join of one split's records with another's.

Inverted lists of term weights hold, of each normed vector, only the rarest terms: a vector stops being indexed where what is left
of it can't reach the threshold any more, by its residual norm or by the other side's maximum weights. Pairs that meet under a
term are dropped where weights, residual norms or the vectors' largest weights bound the dot product below the threshold. The dot
products of the others are computed exactly, and counts are grouped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrel.llm import set_lists as L
from spindrel.llm.near_copies import met_only
from spindrel.llm.set_tokens import cell_of, cell_table, frequency_table, mixed, most
from spindrel.session import dropped, small_batches, written

_EPS = 1e-9
#: Slack of bounds from weights sent as floats.
_FLOAT = 1e-6
_VECTOR = "id long, terms array<long>, weights array<double>"
#: How much more the square of the rarest term's weight is than that of the most frequent one's, where weights come from rarity.
SPREAD = 1.2


def _lists(values: np.ndarray, n: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), pa.array(values))


def unit(ids: pa.Array, t: np.ndarray, w: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    """Vectors of length 1 with their terms in ascending order, from terms and weights of rows with ``n`` of them."""
    owner = np.repeat(np.arange(len(n)), n)
    length = np.sqrt(np.bincount(owner, w * w, len(n)))
    order = np.lexsort((t, owner))
    order = order[length[owner[order]] > 0]
    live = length > 0
    return pa.RecordBatch.from_pydict({"id": ids.filter(pa.array(live)), "terms": _lists(t[order], n[live]), "weights": _lists(w[order] / length[owner[order]], n[live])})


def normed(vectors: DataFrame) -> DataFrame:
    """Vectors ``(id, terms, weights)`` scaled to length 1, their terms in ascending order; vectors without terms or weight are
    left out. Terms of a vector must be distinct and weights positive."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, len(whole), L.ROWS):
                b = whole.slice(lo, L.ROWS)
                (t, n), (w, _) = L.flattened(b.column("terms")), L.flattened(b.column("weights"))
                yield unit(b.column("id"), t, w, n)

    return vectors.where(F.size("terms") > 0).select("id", "terms", "weights").mapInArrow(run, _VECTOR)


def rarity_weights(left: DataFrame, right: DataFrame, spread: float = SPREAD) -> tuple[DataFrame, DataFrame]:
    """Sets ``(id, tokens)`` of both sides as vectors of length 1: before they are scaled, the square of a token's weight goes from 1 for those that most sets have to
    ``spread`` for the rarest, by a table of all rows of both sides."""
    both = left.select("tokens").unionByName(right.select("tokens"))
    table = both.sparkSession.sparkContext.broadcast(frequency_table(both))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level = table.value
        top = max(1, int(level.max()))
        for whole in batches:
            for lo in range(0, len(whole), L.ROWS):
                b = whole.slice(lo, L.ROWS)
                t, n = L.flattened(b.column("tokens"))
                yield unit(b.column("id"), t, np.sqrt(spread - (spread - 1) * level[cell_of(t)] / top), n)

    weigh = lambda s: s.select("id", "tokens").where(F.size("tokens") > 0).mapInArrow(run, _VECTOR)
    return weigh(left), weigh(right)


def least_cosine(similarity: float, spread: float = SPREAD) -> float:
    """The least cosine of two sets of that Jaccard similarity whose tokens' squared weights lie between 1 and ``spread``: what both
    have may weigh least and what either lacks most, and the product of the lengths is largest where both lack as much."""
    return 2 / (2 + spread * (1 / similarity - 1))


def term_tables(left: DataFrame, right: DataFrame) -> np.ndarray:
    """Three rows of ``CELLS`` bytes: how frequent terms are, and the largest weight of a term in either side, rounded up. Of fixed
    size, over all rows."""

    def add(counts: np.ndarray, top: np.ndarray, b: pa.RecordBatch) -> None:
        (t, n), (w, _) = L.flattened(b.column("terms")), L.flattened(b.column("weights"))
        cells, weight = cell_of(t), np.minimum(255, np.ceil(w * 255)).astype(np.uint8)
        at, c = np.unique(cells, return_counts=True)
        counts[at] += c
        side = np.repeat(b.column("side").to_numpy(), n)
        for k in (0, 1):
            np.maximum.at(top[k], cells[side == k], weight[side == k])

    return cell_table(left.withColumn("side", F.lit(0)).unionByName(right.withColumn("side", F.lit(1))), add, 2)


def _index(tables, side: int, threshold: float, buckets: int, part: tuple[int, int], block: int):
    """The indexed part of each vector: packed rows ``(side, id, n, top, bits, keys, w, rest)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level, other = tables.value[0], tables.value[2 - side]
        for b in L.slices(batches):
            ids = b.column("id").to_numpy(zero_copy_only=False)
            (terms, n), (w, _) = L.flattened(b.column("terms")), L.flattened(b.column("weights"))
            owner = np.repeat(np.arange(len(n)), n)
            cells, h = cell_of(terms), mixed(terms)
            bits = np.array(L.packed_bits(owner, h, n), object)
            top = np.zeros(len(n))
            np.maximum.at(top, owner, w)
            # By vector, then rarity, then hash; equal hashes stay in the order of the terms.
            order = np.argsort(owner.astype(np.uint64) << np.uint64(52) | level[cells].astype(np.uint64) << np.uint64(44) | h >> np.uint64(20), kind="stable")
            t, w, c = terms[order], w[order], cells[order]

            def behind(x: np.ndarray) -> np.ndarray:
                """Sums of ``x`` from each place to the vector's end."""
                upto = np.cumsum(x)
                first = np.cumsum(n) - n
                ends = upto[np.cumsum(n) - 1]
                return ends[owner] - upto + x if len(first) else x

            before2 = behind(w * w)
            after = np.sqrt(np.maximum(0.0, before2 - w * w))
            heaviest = behind(w * (other[c] / 255.0))
            # Indexed as long as this term and those behind it can reach the threshold; terms the other side lacks hold no list.
            at = np.flatnonzero((np.minimum(np.sqrt(before2), heaviest) >= threshold - _EPS) & (other[c] > 0))
            own = owner[at]
            key, copy = L.blocked(t[at], ids[own], most(level[c[at]]), side, block)
            fixed = lambda s, ids=ids, n=n, bits=bits, top=top: {
                "side": pa.array(np.full(len(s), side, np.int32)), "id": pa.array(ids[s]), "n": pa.array(n[s].astype(np.int32)), "top": pa.array(top[s]), "bits": pa.array(bits[s].tolist(), pa.binary())
            }
            yield L.bucketed(own[copy], key, {"w": w[at][copy].astype(np.float32), "rest": after[at][copy].astype(np.float32)}, buckets, part, fixed)

    return run


def _probe(threshold: float):
    """Candidate pairs of the lists of each bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in L.by_bucket(batches):
            t = t.sort_by("side").combine_chunks()
            ids, n, top = t.column("id").to_numpy(), t.column("n").to_numpy().astype(np.int64), t.column("top").to_numpy()
            n_left = int((t.column("side").to_numpy() == 0).sum())
            key, count = L.flattened(t.column("keys").chunk(0))
            (w, _), (rest, _) = L.flattened(t.column("w").chunk(0)), L.flattened(t.column("rest").chunk(0))
            maps = L.Bitmaps(t.column("bits").chunk(0), n)
            owner = np.repeat(np.arange(len(n)), count)
            order = np.argsort(key, kind="stable")  # sets come by side
            key, owner, w, rest = key[order], owner[order], w[order], rest[order]
            start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
            stop = np.append(start[1:], len(key))
            lefts = np.concatenate([[0], np.cumsum(owner < n_left)])
            mid = start + lefts[stop] - lefts[start]
            live = (mid > start) & (stop > mid)
            start, mid, stop = start[live], mid[live], stop[live]
            for i, j in L.expand(start, mid - start, mid, stop - mid):
                ok = w[i] * w[j] + rest[i] * rest[j] >= threshold - _FLOAT
                code = np.unique(owner[i[ok]] * len(n) + owner[j[ok]])
                x, y = np.divmod(code, len(n))
                ok = maps.common(x, y) * top[x] * top[y] >= threshold - _EPS
                if ok.any():
                    yield pa.RecordBatch.from_pydict({"l": pa.array(ids[x[ok]]), "r": pa.array(ids[y[ok]])})

    return run


def cosine_join(left: DataFrame, right: DataFrame, threshold: float, block: int = L.BLOCK, scaled: bool = False) -> DataFrame:
    """``(l, r, cosine, shared)``: all pairs of a row of ``left`` and a row of ``right`` (``id``, ``terms``, ``weights``) whose cosine
    is ``threshold`` (over 0) or more, with the number of terms both have. Ids must be unique on a side; rows without terms pair
    with nothing; all terms of all rows count. Equal vectors should be collapsed before, for their pairs are quadratic. ``scaled``: the vectors have length 1 and ascending terms already."""
    if not 0 < threshold <= 1:
        raise ValueError("the threshold must be over 0 and at most 1")
    spark = left.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    left, right = (written(x.select("id", "terms", "weights") if scaled else normed(x), "vectors") for x in (left, right))
    tables = spark.sparkContext.broadcast(term_tables(left, right))
    count, total = left.select(F.size("terms").alias("n")).unionByName(right.select(F.size("terms").alias("n"))).agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    postings = total * 2 // 3  # about what is indexed
    buckets = L.number_of_buckets(postings, n, spark.sparkContext.defaultParallelism)

    def lists(part: tuple[int, int]) -> DataFrame:
        return left.mapInArrow(_index(tables, 0, threshold, buckets, part, block), L.PACKED).unionByName(right.mapInArrow(_index(tables, 1, threshold, buckets, part, block), L.PACKED))

    pairs = L.met(lists, _probe(threshold), ("l", "r"), n, L.rounds(count, total, postings, buckets))

    def dot(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            (tl, nl), (wl, _), (tr, nr), (wr, _) = (L.flattened(b.column(c)) for c in ("tl", "wl", "tr", "wr"))
            # Terms of both vectors of a pair side by side: equal neighbours are shared.
            pair = np.concatenate([np.repeat(np.arange(len(b)), nl), np.repeat(np.arange(len(b)), nr)])
            t, w = np.concatenate([tl, tr]), np.concatenate([wl, wr])
            order = np.lexsort((t, pair))
            pair, t, w = pair[order], t[order], w[order]
            at = np.flatnonzero((t[1:] == t[:-1]) & (pair[1:] == pair[:-1]))
            cosine = np.bincount(pair[at], w[at] * w[at + 1], len(b))
            shared = np.bincount(pair[at], minlength=len(b))
            ok = cosine >= threshold - _EPS
            yield pa.RecordBatch.from_pydict({"l": b.column("l").filter(pa.array(ok)), "r": b.column("r").filter(pa.array(ok)), "cosine": pa.array(cosine[ok]), "shared": pa.array(shared[ok].astype(np.int32))})

    full = pairs.join(met_only(left, pairs, "l").toDF("l", "tl", "wl"), "l").join(met_only(right, pairs, "r").toDF("r", "tr", "wr"), "r")
    with small_batches(spark):
        met = written(full.mapInArrow(dot, "l long, r long, cosine double, shared int"), "met")
    for x in (left, right, pairs):
        dropped(x)
    return met


def overlap_counts(met: DataFrame, held: DataFrame, train: DataFrame) -> DataFrame:
    """Grouped counts by field, split and source of the held-out record: how many of its records have a train record like them, and
    how many pairs that are. ``met (field, l, r)``: classes of equal records that are alike, once each; ``held (field, id, l,
    split, source)`` and ``train (field, id, r)``: their members. Classes are counted, never expanded into pairs of members."""
    size = train.groupBy("field", "r").agg(F.count("*").alias("n_train"))
    of = met.join(size, ["field", "r"]).groupBy("field", "l").agg(F.sum("n_train").alias("n_train"))
    mine = held.groupBy("field", "l", "split", "source").agg(F.count("*").alias("n"))
    return mine.join(of, ["field", "l"]).groupBy("field", "split", "source").agg(F.sum("n").alias("n_records"), F.sum(F.col("n") * F.col("n_train")).alias("n_pairs"))
