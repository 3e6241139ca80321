"""Duplicates hidden by formatting differences.

Recursive radix partitioning on canonical bytes: ranges of the bytes go to one task each; a bucket that holds too much is split by
further bytes until each fits; each bucket's texts are then counted in a trie with counters where a text ends. Texts are counted
within partitions first, so a text with any number of copies moves as one row a partition.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrel.functions.smiles import canonical
from spindrel.session import written

#: Rows of partial counts that a bucket may hold, bytes by which an oversized bucket is split, and texts a partition counts at once.
BUCKET_ROWS, STEP, HELD = 20_000, 4, 100_000


def canonical_table(records: DataFrame, id_col: str, text_col: str, form: Callable[[str | None], str | None], keep: Sequence[str] = ()) -> DataFrame:
    """``(id, key, keep...)``: the canonical bytes of each text, and columns carried along; null ids, null texts and texts of which nothing is left are left out."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            keys = [form(x) if isinstance(x, str) else None for x in b["t"]]
            yield pd.DataFrame({"id": b["id"], "key": [k.encode("utf-8", "surrogatepass") if k else None for k in keys], **{c: b[c] for c in keep}})

    src = records.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("t"), *keep).where("id is not null and t is not null")
    more = "".join(f", `{c}` {t}" for c, t in src.dtypes if c in keep)
    return src.mapInPandas(run, "id long, key binary" + more).where("key is not null")


def _partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    held: dict[bytes, list[int]] = {}

    def out() -> pd.DataFrame:
        return pd.DataFrame({"key": list(held), "n": [v[0] for v in held.values()], "lo": [v[1] for v in held.values()]})

    for b in batches:
        for k, i in zip(b["key"], b["id"].tolist()):
            v = held.get(k)
            if v is None:
                held[k] = [1, i]
            else:
                v[0] += 1
                if i < v[1]:
                    v[1] = i
        if len(held) > HELD:
            yield out()
            held.clear()
    if held:
        yield out()


class Trie:
    """Byte strings in steps of ``STEP`` bytes, with ``[count, smallest id]`` where one ends."""

    def __init__(self) -> None:
        self.root: dict = {}

    def add(self, key: bytes, n: int, lo: int) -> None:
        node = self.root
        for i in range(0, len(key), STEP):
            node = node.setdefault(key[i : i + STEP], {})
        end = node.get(None)
        if end is None:
            node[None] = [n, lo]
        else:
            end[0] += n
            end[1] = min(end[1], lo)

    def items(self) -> Iterator[tuple[bytes, int, int]]:
        stack = [(b"", self.root)]
        while stack:
            prefix, node = stack.pop()
            for k, v in node.items():
                if k is None:
                    yield prefix, v[0], v[1]
                else:
                    stack.append((prefix + k, v))


def split_bucket(rows: list[tuple[bytes, int, int]], depth: int, most: int) -> Iterator[list[tuple[bytes, int, int]]]:
    """The buckets of ``rows (key, n, lo)``, whose keys have their first ``depth`` bytes in common: as they are where they fit, else
    split by their next bytes, after those that all share, and so on. Keys that end there come first, with one text a bucket."""
    stack = [(rows, depth)]
    while stack:
        rows, depth = stack.pop()
        if len(rows) <= most:
            yield rows
            continue
        low, high = min(r[0] for r in rows), max(r[0] for r in rows)
        if low == high:
            yield rows  # one text, however often: a counter
            continue
        while low[depth : depth + STEP] == high[depth : depth + STEP]:
            depth += STEP
        parts: dict[bytes, list[tuple[bytes, int, int]]] = {}
        for r in rows:
            parts.setdefault(r[0][depth : depth + STEP], []).append(r)
        stack += [(parts[k], depth + STEP if len(k) == STEP else depth) for k in sorted(parts, reverse=True)]


def counted_texts(keys: DataFrame, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """``(key, n, lo)``: each canonical text once, with the number of its copies and their smallest id. ``keys``: ``(id, key)``.

    The first partitioning is by ranges of the bytes, as many as the session has shuffle partitions, cut by Spark from a sample of
    partial counts; equal texts always share one. Within its task a range is split by further bytes until each bucket fits. No list of
    buckets leaves its task.
    """
    partial = written(keys.mapInPandas(_partial, "key binary, n long, lo long"), "counts")
    n = int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple[bytes, int, int]] = []

        def out(rows: list[tuple[bytes, int, int]]) -> Iterator[pd.DataFrame]:
            for bucket in split_bucket(rows, 0, bucket_rows):
                trie = Trie()
                for r in bucket:
                    trie.add(*r)
                yield pd.DataFrame(list(trie.items()), columns=["key", "n", "lo"])

        for b in batches:
            held += zip(b["key"], b["n"].tolist(), b["lo"].tolist())
            # Rows come in the order of their bytes, so all but the last text are complete.
            if len(held) > 4 * bucket_rows:
                last = held[-1][0]
                done = len(held)
                while done and held[done - 1][0] == last:
                    done -= 1
                yield from out(held[:done])
                held = held[done:]
        if held:
            yield from out(held)

    return partial.repartitionByRange(n, "key").sortWithinPartitions("key").mapInPandas(count, "key binary, n long, lo long")


def collapsed(records: DataFrame, id_col: str, text_col: str, form: Callable[[str | None], str | None] = canonical) -> DataFrame:
    """One row for each text: ``(id, text, n_copies)`` with the smallest id of its copies and the canonical text. An id that is
    delivered again must be dropped before; a null or blank text makes no row."""
    c = counted_texts(written(canonical_table(records, id_col, text_col, form), "canonical"))
    return c.select(F.col("lo").alias("id"), F.col("key").cast("string").alias("text"), F.col("n").alias("n_copies"))


def copy_pairs(records: DataFrame, id_col: str, text_col: str, form: Callable[[str | None], str | None] = canonical) -> DataFrame:
    """``(id_a, id_b)``: for each copy the smallest id among its copies, and its own; the smallest itself left out."""
    keys = written(canonical_table(records, id_col, text_col, form), "canonical")
    many = counted_texts(keys).where("n > 1").select("key", F.col("lo").alias("id_a"))
    return keys.join(many, "key").where("id <> id_a").select("id_a", F.col("id").alias("id_b"))
