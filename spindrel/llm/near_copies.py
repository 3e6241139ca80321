"""Near-duplicate records with small edits: all pairs of token sets whose Jaccard similarity reaches a threshold.

Sets that reach the threshold share one of their rarest tokens, so sets meet under those tokens only. The sets under a token form a
signature tree, whatever their number: nodes hold the OR of their members' token bitmaps, ranges of sizes, and the most tokens that
may follow; a dual traversal of the tree with itself drops node pairs whose largest possible overlap is too small. The trees of all
tokens of a bucket are built and traversed level by level together. What is left is checked exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrel.llm import set_lists as L
from spindrel.llm.set_tokens import cell_of, frequency_table, mixed, most, ones
from spindrel.session import maybe_broadcast, small_enough, written

#: Members of a leaf, and children of a node.
LEAF, FAN = 8, 4


def needed(na: np.ndarray, nb: np.ndarray, threshold: float) -> np.ndarray:
    """The overlap that two sets of these sizes need."""
    return np.ceil(threshold / (1 + threshold) * (na + nb) - 1e-9)


class SignatureTrees:
    """One tree for each list of sets; members are sorted by list, then size. ``bits``, ``size``, ``spare`` (tokens that share a bit) and
    ``rest`` (tokens from the list's token on) belong to members."""

    def __init__(self, start: np.ndarray, stop: np.ndarray, bits: np.ndarray, size: np.ndarray, spare: np.ndarray, rest: np.ndarray) -> None:
        #: Levels from the leaves up: OR of bitmaps, least and greatest size, most spare, most rest; where a node's children begin and end.
        self.levels: list[tuple[np.ndarray, ...]] = []
        self.roots: list[np.ndarray] = []
        below, fan = (bits, size, size, spare, rest), LEAF
        while len(start):
            nodes = -(-(stop - start) // fan)
            of = np.repeat(np.arange(len(start)), nodes)
            at = start[of] + fan * (np.arange(len(of)) - np.repeat(np.cumsum(nodes) - nodes, nodes))
            end = np.minimum(at + fan, stop[of])
            OR, least, greatest, sp, re = below
            level = (np.bitwise_or.reduceat(OR, at, axis=0), np.minimum.reduceat(least, at), np.maximum.reduceat(greatest, at), np.maximum.reduceat(sp, at), np.maximum.reduceat(re, at))
            self.levels.append((*level, at, end))
            stop = np.cumsum(nodes)
            start = stop - nodes
            self.roots.append(start[nodes == 1])
            # Trees whose root this is go no further; the others' nodes are the children of the next level.
            start, stop, fan, below = start[nodes > 1], stop[nodes > 1], FAN, level

    def pairs(self, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Member pairs ``i < j`` of leaves that the dual traversal leaves, some at a time."""
        a = b = np.zeros(0, np.int64)
        for k in range(len(self.levels) - 1, -1, -1):
            OR, least, greatest, spare, rest, start, stop = self.levels[k]
            a, b = np.concatenate([a, self.roots[k]]), np.concatenate([b, self.roots[k]])
            kept = []
            for lo in range(0, len(a), L.PAIRS // 16):
                i, j = a[lo : lo + L.PAIRS // 16], b[lo : lo + L.PAIRS // 16]
                need = needed(least[i], least[j], threshold)
                ok = (greatest[i] >= threshold * least[j]) & (greatest[j] >= threshold * least[i]) & (np.minimum(rest[i], rest[j]) >= need)
                i, j, need = i[ok], j[ok], need[ok]
                ok = ones(OR[i] & OR[j]) + np.minimum(spare[i], spare[j]) >= need
                kept.append((i[ok], j[ok]))
            a, b = (np.concatenate([x[s] for x in kept]) if kept else np.zeros(0, np.int64) for s in (0, 1))
            if k == 0:
                for i, j in L.expand(start[a], stop[a] - start[a], start[b], stop[b] - start[b]):
                    up = i < j
                    yield i[up], j[up]
                return
            met = list(L.expand(start[a], stop[a] - start[a], start[b], stop[b] - start[b]))
            a, b = (np.concatenate([x[s] for x in met]) if met else np.zeros(0, np.int64) for s in (0, 1))
            up = a <= b
            a, b = a[up], b[up]


def _postings(table, threshold: float, buckets: int, part: tuple[int, int], block: int):
    """Each set in the buckets of its rare tokens: packed rows ``(id, n, bits, keys, pos)`` with the tokens' places by rarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level = table.value
        for b in L.slices(batches):
            ids = b.column("id").to_numpy(zero_copy_only=False)
            tokens, n = L.flattened(b.column("tokens"))
            owner = np.repeat(np.arange(len(n)), n)
            cells, h = level[cell_of(tokens)], mixed(tokens)
            bits = np.array(L.packed_bits(owner, h, n), object)
            # By set, then rarity, then hash; equal hashes stay in the order of the tokens.
            order = np.argsort(owner.astype(np.uint64) << np.uint64(52) | cells.astype(np.uint64) << np.uint64(44) | h >> np.uint64(20), kind="stable")
            pos = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
            # A set needs no more of its rarest tokens than leave the smallest overlap it can have with any partner.
            probe = n - np.ceil(threshold * n - 1e-9).astype(np.int64) + 1
            keep = (pos < probe[owner]) & (cells[order] > 1)  # a cell that counted one token has no second set
            at, pos, own = order[keep], pos[keep], owner[keep]
            key, copy = L.blocked(tokens[at], ids[own], most(cells[at]), None, block)
            fixed = lambda s, ids=ids, n=n, bits=bits: {"id": pa.array(ids[s]), "n": pa.array(n[s].astype(np.int32)), "bits": pa.array(bits[s].tolist(), pa.binary())}
            yield L.bucketed(own[copy], key, {"pos": pos[copy].astype(np.int32)}, buckets, part, fixed)

    return run


def candidates(ids: np.ndarray, n: np.ndarray, bits: pa.Array | list[bytes], owner: np.ndarray, key: np.ndarray, pos: np.ndarray, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of set numbers that may reach the threshold, by the trees of all lists of a bucket; a pair may come more than once.
    Sets are in the order of their sizes, and postings in that of their sets.

    Of a pair that reaches it, the first token (by rarity) that both have leaves in either set as many tokens as the pair must share.
    """
    maps = L.Bitmaps(bits, n)
    order = np.argsort(key, kind="stable")  # sets come by size
    key, owner, pos = key[order], owner[order], pos[order]
    start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    stop = np.append(start[1:], len(key))
    many = stop - start > 1
    start, stop = start[many], stop[many]
    ends = np.cumsum(stop - start)
    lo = 0
    while lo < len(start):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + L.SLAB, side="right")))
        s, e = start[lo:hi], stop[lo:hi]
        lo = hi
        at = np.concatenate([np.arange(x, y) for x, y in zip(s.tolist(), e.tolist())])
        size = e - s
        e = np.cumsum(size)
        own, p = owner[at], pos[at]
        own_n = n[own]
        trees = SignatureTrees(e - size, e, maps.words[0][own], own_n, maps.spare[0][maps.at[0][own]], own_n - p)
        for i, j in trees.pairs(threshold):
            x, y = own[i], own[j]
            need = needed(n[x], n[y], threshold)
            ok = (ids[x] != ids[y]) & (n[x] >= threshold * n[y]) & (n[y] >= threshold * n[x]) & (n[x] - p[i] >= need) & (n[y] - p[j] >= need)
            code = np.unique(np.minimum(x[ok], y[ok]) * len(n) + np.maximum(x[ok], y[ok]))
            x, y = np.divmod(code, len(n))
            ok = maps.common(x, y) >= needed(n[x], n[y], threshold)
            if ok.any():
                yield x[ok], y[ok]


def _meet(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in L.by_bucket(batches):
            t = t.sort_by("n").combine_chunks()
            ids, n = t.column("id").to_numpy(), t.column("n").to_numpy().astype(np.int64)
            key, count = L.flattened(t.column("keys").chunk(0))
            pos, _ = L.flattened(t.column("pos").chunk(0))
            for x, y in candidates(ids, n, t.column("bits").chunk(0), np.repeat(np.arange(len(n)), count), key, pos.astype(np.int64), threshold):
                a, b = ids[x], ids[y]
                yield pa.RecordBatch.from_pydict({"a": pa.array(np.minimum(a, b)), "b": pa.array(np.maximum(a, b))})

    return run


def similar_sets(sets: DataFrame, threshold: float = 0.8, block: int = L.BLOCK) -> DataFrame:
    """``(a, b, similarity)`` with ``a < b``: all pairs of rows of ``sets (id long, tokens array<long>, distinct)`` whose Jaccard
    similarity is ``threshold`` or more. Ids must be unique and tokens in ascending order; rows without tokens pair with nothing; sets are compared whole.

    Meant for distinct sets: collapse equal ones first (:func:`near_copy_pairs` does), for their pairs are quadratic. A token that
    most sets share is met last and, where it is met, in blocks of about ``block`` sets, block against block.
    """
    spark = sets.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sets = sets.where(F.size("tokens") > 0)
    count, total = sets.agg(F.count("*"), F.coalesce(F.sum(F.size("tokens")), F.lit(0))).first()
    table = spark.sparkContext.broadcast(frequency_table(sets))
    postings = int(total * (1 - threshold))
    buckets = L.number_of_buckets(postings, n, spark.sparkContext.defaultParallelism)
    posted = lambda part: sets.select("id", "tokens").mapInArrow(_postings(table, threshold, buckets, part, block), L.PACKED)
    pairs = L.met(posted, _meet(threshold), ("a", "b"), n, L.rounds(count, total, postings, buckets))
    return exact_similarity(pairs, sets.select("id", "tokens"), threshold)


def exact_similarity(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """``pairs (a, b)`` whose sets reach the threshold, with their similarity. Only sets that stand in a pair are moved."""
    left, right = met_only(sets, pairs, "a").toDF("a", "ta"), met_only(sets, pairs, "b").toDF("b", "tb")
    both = F.size(F.array_intersect("ta", "tb"))
    j = pairs.join(left, "a").join(right, "b").withColumn("both", both).withColumn("either", F.size("ta") + F.size("tb") - F.col("both"))
    return j.where(F.col("both") >= F.lit(threshold) * F.col("either")).select("a", "b", (F.col("both") / F.col("either")).alias("similarity"))


def met_only(rows: DataFrame, pairs: DataFrame, side: str) -> DataFrame:
    """``rows (id, ...)`` whose id stands in ``pairs`` on that side: dropped where they are read if the ids are few enough to send, else
    in the join to come."""
    ids = pairs.select(F.col(side).alias("id")).distinct()
    return rows.join(F.broadcast(ids), "id", "left_semi") if small_enough(ids) else rows


def distinct_sets(sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(reps, members)``: each different set once, under the smallest id with it, and ``(id, rep)`` for all rows."""
    two = [F.xxhash64("tokens").alias("p"), F.xxhash64(F.lit(1), "tokens").alias("q")]  # 128 bits of a set
    s = sets.select("id", *two)
    rep = s.groupBy("p", "q").agg(F.min("id").alias("rep"))
    members = written(s.join(rep, ["p", "q"]).select("id", "rep"), "members")
    others = members.where("id <> rep").select("id")
    reps = written(sets.select("id", "tokens").join(maybe_broadcast(others), "id", "left_anti"), "sets")  # in place where copies are few
    return reps, members


def near_copy_pairs(sets: DataFrame, threshold: float = 0.8, block: int = L.BLOCK) -> DataFrame:
    """``(id_a, id_b)``, smaller id first, of all rows of ``sets`` that reach the threshold, rows with equal sets included."""
    reps, members = distinct_sets(sets.where(F.size("tokens") > 0))
    a, b = members.select(F.col("id").alias("x"), F.col("rep").alias("a")), members.select(F.col("id").alias("y"), F.col("rep").alias("b"))
    across = similar_sets(reps, threshold, block).select("a", "b").join(a, "a").join(b, "b")
    equal = a.join(members.select(F.col("id").alias("y"), F.col("rep").alias("a")), "a").where("x < y")
    every = across.select("x", "y").unionByName(equal.select("x", "y"))
    return every.select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))


def near_copy_groups(sets: DataFrame, threshold: float = 0.8) -> DataFrame:
    """``(id, group_id, n_links)``: the connected group of each row, named by its smallest id, and the number of different sets
    that its set reaches the threshold with. Copies of a set share its links and aren't expanded."""
    from spindrel.llm.splits import connected_components

    reps, members = distinct_sets(sets.where(F.size("tokens") > 0))
    links = written(similar_sets(reps, threshold).select("a", "b"), "links")
    comps = connected_components(links.select(F.col("a").alias("src"), F.col("b").alias("dst")))
    degree = links.select(F.col("a").alias("rep")).unionByName(links.select(F.col("b").alias("rep"))).groupBy("rep").agg(F.count("*").alias("n"))
    m = members.join(comps.withColumnRenamed("id", "rep"), "rep", "left").join(degree, "rep", "left")
    return m.select("id", F.coalesce("component", "rep").alias("group_id"), F.coalesce("n", F.lit(0)).cast("long").alias("n_links"))
