"""The queries over the operators of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrel.functions.smiles import canonical
from spindrel.llm.copies import canonical_table, collapsed, copy_pairs
from spindrel.llm.cross_split import cosine_join, least_cosine, overlap_counts, rarity_weights, unit
from spindrel.llm.leaks import leaks
from spindrel.llm.near_copies import distinct_sets, near_copy_groups, near_copy_pairs
from spindrel.llm.packing import packed
from spindrel.llm.pieces import chain_starts, cut_proteins
from spindrel.llm.pii import personal_information, without_personal_information
from spindrel.llm.set_tokens import stretches
from spindrel.llm.sql import P1_FOUND, P3_FOUND, P6_FOUND
from spindrel.llm.splits import grouped_split, linked_groups, read_split, registry_keys
from spindrel.session import dropped, table, written

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


def once(df: DataFrame, id_col: str, *cols: str) -> DataFrame:
    """Repeated deliveries of a record counted once: the one loaded first, ties by content."""
    first = df.where(F.col(id_col).isNotNull()).groupBy(id_col).agg(F.min(F.struct("loaded_at", *cols)).alias("r"))
    return first.select(id_col, *[F.col(f"r.{c}").alias(c) for c in cols])


def smiles_once(spark, d):
    return once(table(spark, d, "smiles"), "sample_id", "smiles", "depositor", "source_ref", "source", "split")


def smiles_groups(spark, d):
    s = written(smiles_once(spark, d), "smiles")
    return s, linked_groups(s, "sample_id", registry_keys(s, table(spark, d, "nodes")))


@query("p1_found", P1_FOUND)
def p1_found(spark, d):
    s, groups = smiles_groups(spark, d)
    g = written(groups, "groups")
    now = s.select(F.col("sample_id").alias("id"), read_split("split").alias("split")).where("split is not null")
    mixed = g.join(now, "id").groupBy("component").agg(F.min("split").alias("a"), F.max("split").alias("b")).where("a <> b").select("component")
    return g.join(mixed, "component", "left_semi").select(F.col("id").alias("sample_id"))


@query("p1_split")
def p1_split(spark, d):
    _, groups = smiles_groups(spark, d)
    return grouped_split(written(groups, "groups")).select(F.col("id").alias("sample_id"), F.col("component").alias("group_id"), "split")


@query("p2_found")
def p2_found(spark, d):
    return copy_pairs(smiles_once(spark, d), "sample_id", "smiles")


@query("p2_collapsed")
def p2_collapsed(spark, d):
    return collapsed(smiles_once(spark, d), "sample_id", "smiles").withColumnRenamed("id", "sample_id")


def proteins_once(spark, d):
    return once(table(spark, d, "sequences"), "protein_id", "sequence", "source", "split")


def stretch_sets(proteins, *keep):
    """``(id, tokens, keep...)``: the distinct stretches of five residues of each protein, chain marks and letter case ignored."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"id": b["protein_id"], "tokens": [stretches(chain_starts(t)[0]) for t in b["sequence"]], **{c: b[c] for c in keep}})

    return proteins.where("sequence is not null").select("protein_id", "sequence", *keep).mapInPandas(run, "id long, tokens array<long>" + "".join(f", {c} string" for c in keep))


#: Similarity of proteins at which the tables' cases begin.
PROTEIN_SIMILARITY = 0.5


@query("p3_found", P3_FOUND)
def p3_found(spark, d):
    sets = written(stretch_sets(proteins_once(spark, d)), "tokens")
    pairs = near_copy_pairs(sets, PROTEIN_SIMILARITY)
    dropped(sets)
    return pairs


@query("p3_groups")
def p3_groups(spark, d):
    return near_copy_groups(written(stretch_sets(proteins_once(spark, d)), "tokens"), PROTEIN_SIMILARITY).withColumnRenamed("id", "protein_id")


def text_vectors(keys):
    """``(id, terms, weights)`` of canonical texts as vectors of length 1: their components and stretches of eight letters, weighted
    by the root of how often they occur."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, len(whole), 1_000):
                b = whole.slice(lo, 1_000)
                terms, counts = [], []
                for k in b.column("key").to_pylist():
                    a = np.frombuffer(b"\x00" + k + b"\x00", np.uint8)
                    a = np.concatenate([a, np.zeros(max(0, 8 - len(a)), np.uint8)])
                    words = np.lib.stride_tricks.sliding_window_view(a, 8).copy().view(np.int64).ravel()
                    t, c = np.unique(np.concatenate([words, np.array([hash_bytes(x) for x in k.split(b".")], np.int64)]), return_counts=True)
                    terms.append(t)
                    counts.append(c)
                if terms:
                    yield unit(b.column("id"), np.concatenate(terms), np.sqrt(np.concatenate(counts)), np.array([len(x) for x in terms]))

    return keys.select("id", "key").mapInArrow(run, "id long, terms array<long>, weights array<double>")


def hash_bytes(x: bytes) -> int:
    import hashlib

    return int.from_bytes(hashlib.blake2b(x, digest_size=8).digest(), "little", signed=True)


def flat(text):
    return canonical(text, stereo=False)


def cross_split_classes(spark, d):
    """``(met, held, train)`` of both fields: which classes of equal records of a held-out and of the train split are alike, by the
    cosine join, and the members of the classes."""
    s = smiles_once(spark, d).withColumn("split", read_split("split")).where("split is not null")
    keys = written(canonical_table(s, "sample_id", "smiles", flat, ("split", "source")), "flat")
    part = {t: keys.where((F.col("split") == "train") == F.lit(t)) for t in (False, True)}
    rep = {t: written(part[t].groupBy("key").agg(F.min("id").alias("rep")), "texts") for t in (False, True)}
    near = cosine_join(*(text_vectors(rep[t].select(F.col("rep").alias("id"), "key")) for t in (False, True)), 0.9999, scaled=True)
    met = near.join(rep[False].toDF("ka", "l"), "l").join(rep[True].toDF("kb", "r"), "r").where("ka = kb").select(F.lit("smiles").alias("field"), "l", "r")
    held = part[False].join(rep[False], "key").select(F.lit("smiles").alias("field"), "id", F.col("rep").alias("l"), "split", "source")
    train = part[True].join(rep[True], "key").select(F.lit("smiles").alias("field"), "id", F.col("rep").alias("r"))

    p = proteins_once(spark, d).withColumn("split", read_split("split")).where("split is not null")
    sets = written(stretch_sets(p, "split", "source").where(F.size("tokens") > 0), "tokens")
    side = {t: sets.where((F.col("split") == "train") == F.lit(t)) for t in (False, True)}
    reps, members = zip(*(distinct_sets(side[t].select("id", "tokens")) for t in (False, True)))
    where = written(side[False].select("id", "split", "source"), "held")
    dropped(sets)  # before the join: the sets stand in their representatives
    near = cosine_join(*rarity_weights(*reps), least_cosine(PROTEIN_SIMILARITY), scaled=True)
    n = [r.select(F.col("id").alias(c), F.size("tokens").alias(f"n{c}")) for r, c in zip(reps, "lr")]
    close = near.join(n[0], "l").join(n[1], "r").where(F.col("shared") >= PROTEIN_SIMILARITY * (F.col("nl") + F.col("nr") - F.col("shared")))
    field = F.lit("sequences").alias("field")
    met = met.unionByName(close.select(field, "l", "r"))
    held = held.unionByName(members[0].join(where, "id").select(field, "id", F.col("rep").alias("l"), "split", "source"))
    train = train.unionByName(members[1].select(field, "id", F.col("rep").alias("r")))
    return met, held, train


@query("p5_found")
def p5_found(spark, d):
    met, held, train = cross_split_classes(spark, d)
    pairs = met.join(held.select("field", F.col("id").alias("a"), "l"), ["field", "l"]).join(train.select("field", F.col("id").alias("b"), "r"), ["field", "r"])
    return pairs.select("field", F.least("a", "b").alias("id_a"), F.greatest("a", "b").alias("id_b"))


@query("p5_counts")
def p5_counts(spark, d):
    return overlap_counts(*cross_split_classes(spark, d))


@query("p6_found", P6_FOUND)
def p6_found(spark, d):
    cut = cut_proteins(proteins_once(spark, d), table(spark, d, "residues"))
    return cut.where("piece = 0").select(F.col("id").alias("protein_id"), F.explode("chains").alias("at")).select("protein_id", F.col("at").cast("long").alias("chain_start"))


@query("p6_pieces")
def p6_pieces(spark, d):
    cut = cut_proteins(proteins_once(spark, d), table(spark, d, "residues"))
    return cut.select(F.col("id").alias("protein_id"), "piece", "chain_no", F.col("start").cast("long").alias("start_pos"), F.col("end").cast("long").alias("end_pos"), "residues", "natural")


def found_leaks(spark, d):
    return leaks(table(spark, d, "documents"), table(spark, d, "heldout_items"))


@query("p8_found")
def p8_found(spark, d):
    return found_leaks(spark, d).select("doc_id", "item_id")


@query("p8_passages")
def p8_passages(spark, d):
    return found_leaks(spark, d)


@query("p9_found")
def p9_found(spark, d):
    return personal_information(table(spark, d, "documents")).select("doc_id", "pii_type", "start_pos")


@query("p9_redacted")
def p9_redacted(spark, d):
    return without_personal_information(table(spark, d, "documents"))


@query("p7_containers")
def p7_containers(spark, d):
    return packed(table(spark, d, "documents"))
