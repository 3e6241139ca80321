"""Filling fixed-capacity containers with texts, by their lengths in tokens.

Shortest-pack-first over the length histogram: lengths are placed longest first into the packs with the most room, so whole groups
of equal packs are handled as one pattern with a count. The histogram and the patterns have a size that the capacity bounds, not
the number of texts; texts then find their pattern by their rank among texts of the same length.
"""

from __future__ import annotations

import base64
import os
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spindrel.session import written

#: Tokens of a container, where the vocabulary lies (a file that every executor sees, or one sent by ``SparkContext.addFile``), and texts
#: of one length that are ranked together, about.
CAPACITY, VOCABULARY, RANKED = 2048, "/opt/tokenizers/byte_bpe_50k.tiktoken", 50_000
# Fixed value: how this public vocabulary's tokenizer parts text before it merges bytes.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Letters that are encoded at a time; longer texts are parted before a blank between words, which no token spans.
_PART = 200_000
_encodings: dict[str, object] = {}


def encoding(path: str):
    """The tokenizer, read once a process."""
    if path not in _encodings:
        import tiktoken
        from pyspark import SparkFiles

        sent = SparkFiles.get(os.path.basename(path))
        path, key = (sent if os.path.exists(sent) else path), path

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        _encodings[key] = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encodings[path]


def token_counts(documents: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """``(doc_id, n_tokens)`` of every row; null texts count as empty. Special tokens in a text are ordinary text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(vocabulary)
        for b in batches:
            n = [count(enc, t) for t in b["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(n, pa.int64())], names=["doc_id", "n_tokens"])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, n_tokens long")


def count(enc, text: str | None) -> int:
    if not text:
        return 0
    total, at = 0, 0
    while len(text) - at > _PART:
        cut = at + _PART
        while cut > at + 1 and not (text[cut] == " " and text[cut - 1].isalnum() and cut + 1 < len(text) and text[cut + 1].isalpha()):
            cut -= 1
        if cut <= at + 1:
            break
        total += len(enc.encode_ordinary(text[at:cut]))
        at = cut
    return total + len(enc.encode_ordinary(text[at:]))


def patterns(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, list[tuple[int, int]]]]:
    """``(packs, [(length, times)])``: how many packs hold which lengths. Lengths go longest first into the packs with the most
    room; only where none has room for a length are new packs opened, with as many of it as fit."""
    room: defaultdict[int, list[list]] = defaultdict(list)
    for length in sorted((x for x, n in histogram.items() if n > 0), reverse=True):
        if not 0 < length <= capacity:
            raise ValueError(f"the length {length} doesn't fit")
        left = histogram[length]
        while left:
            most = max((r for r in room if room[r]), default=0)
            if most < length:
                times = capacity // length
                full, some = divmod(left, times)
                if full:
                    room[capacity - times * length].append([full, [(length, times)]])
                if some:
                    room[capacity - some * length].append([1, [(length, some)]])
                break
            packs, held = room[most].pop()
            # As many as fit where texts are left for all these packs, else one each, as far as they go.
            times = max(1, min(most // length, left // packs))
            used = min(packs, left)
            if used < packs:
                room[most].append([packs - used, held])
            room[most - times * length].append([used, [*held, (length, times)]])
            left -= used * times
    return [(packs, held) for r in sorted(room) for packs, held in room[r]]


def _places(found: list[tuple[int, list[tuple[int, int]]]]) -> dict[int, np.ndarray]:
    """For each length its runs of ranks: first rank, packs of the run, first container, order and offset of its first place."""
    out: dict[int, list[tuple[int, ...]]] = defaultdict(list)
    taken: dict[int, int] = defaultdict(int)
    container = 0
    for packs, held in found:
        order = offset = 0
        for length, times in held:
            out[length].append((taken[length], packs, container, order, offset))
            taken[length] += packs * times
            order += times
            offset += length * times
        container += packs
    return {k: np.array(v, np.int64) for k, v in out.items()}


def packed(documents: DataFrame, capacity: int = CAPACITY, vocabulary: str = VOCABULARY) -> DataFrame:
    """``(container_id, place, offset, doc_id, piece, token_start, token_end)``: where each text lies. ``place`` is its order in the
    container, ``offset`` the container's token where it begins, ``token_start`` to ``token_end`` (exclusive) its extent.

    Only a text longer than ``capacity`` is split, into pieces of ``capacity`` and a rest. Null and empty texts hold no token and
    lie nowhere. Repeated rows are packed as often as they come; a null id is kept. An empty table gives an empty one.
    """
    spark = documents.sparkSession
    n = F.col("n_tokens")
    counted = token_counts(documents, vocabulary).where(n > 0)
    split = counted.select("doc_id", n, F.explode(F.sequence(F.lit(0), F.floor((n - 1) / capacity).cast("int"))).alias("piece"))
    start = F.col("piece").cast("long") * capacity
    pieces = split.select("doc_id", "piece", start.alias("token_start"), F.least(n, start + capacity).alias("token_end"))
    pieces = pieces.withColumn("length", (F.col("token_end") - F.col("token_start")).cast("int"))
    pieces = written(pieces, "pieces")
    # A length is ranked in as many slices as its texts need; a row a length, then a row a slice, reach the driver.
    n_of = [0] * (capacity + 1)
    for r in pieces.groupBy("length").count().collect():
        n_of[r["length"]] = -(-r["count"] // RANKED)
    slices = F.element_at(F.array(*[F.lit(max(1, x)) for x in n_of]), F.col("length") + 1)
    pieces = pieces.withColumn("slice", F.pmod(F.xxhash64("doc_id", "piece"), slices).cast("int"))
    sliced = pieces.groupBy("length", "slice").count().toPandas().sort_values(["length", "slice"])
    sliced["first"] = sliced.groupby("length")["count"].cumsum() - sliced["count"]
    histogram = {int(k): int(v) for k, v in sliced.groupby("length")["count"].sum().items()}
    places = spark.sparkContext.broadcast((_places(patterns(histogram, capacity)), {(int(a), int(b)): int(c) for a, b, c in zip(sliced["length"], sliced["slice"], sliced["first"])}))
    rank = F.row_number().over(Window.partitionBy("length", "slice").orderBy("doc_id", "piece")) - 1
    ranked = pieces.withColumn("rank", rank.cast("long"))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        runs, first = places.value
        for b in batches:
            out = np.zeros((3, len(b)), np.int64)
            lengths, slices, ranks = b["length"].to_numpy(), b["slice"].to_numpy(), b["rank"].to_numpy()
            for key in set(zip(lengths.tolist(), slices.tolist())):
                mine = (lengths == key[0]) & (slices == key[1])
                run, r = runs[key[0]], ranks[mine] + first[key]
                at = run[np.searchsorted(run[:, 0], r, side="right") - 1]
                times, pack = np.divmod(r - at[:, 0], at[:, 1])
                out[:, mine] = at[:, 2] + pack, at[:, 3] + times, at[:, 4] + times * key[0]
            yield pd.DataFrame({"container_id": out[0], "place": out[1], "offset": out[2], "doc_id": b["doc_id"], "piece": b["piece"], "token_start": b["token_start"], "token_end": b["token_end"]})

    return ranked.mapInPandas(place, "container_id long, place long, offset long, doc_id long, piece int, token_start long, token_end long")
