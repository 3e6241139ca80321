"""Molecules from SMILES as tables of atoms and bonds, and checks on them. Each bond gives two directed edges."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrel.functions.smiles import NUMBER, parse, write

_GRAPH = (
    "id long, atoms array<struct<atom_type:int,formal_charge:int,explicit_hs:int,aromatic:boolean,isotope:int,chiral:string,atom_map:int>>, "
    "bonds array<struct<a:int,b:int,order:double,stereo:string>>"
)
# The largest valence of an uncharged atom by its number.
VALENCE = {1: 1, 5: 3, 6: 4, 7: 3, 8: 2, 9: 1, 14: 4, 15: 5, 16: 6, 17: 1, 35: 1, 53: 7}


def parsed(records: DataFrame, id_col: str = "sample_id", smiles_col: str = "smiles", strict: bool = False, form: Callable[[str], str | None] = str.strip) -> DataFrame:
    """One row a record with its atoms and bonds; a text that can't be read is left out, or an error if ``strict``. ``form`` tidies a
    text before it is read, such as :func:`spindrel.functions.smiles.canonical` where texts are written unevenly."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for i, t in zip(b["id"].tolist(), b["s"]):
                g = parse(form(t)) if isinstance(t, str) else None
                if g is None:
                    if strict:
                        raise ValueError(f"no SMILES: {t!r}")
                    continue
                rows.append((i, g[0], g[1]))
            yield pd.DataFrame(rows, columns=["id", "atoms", "bonds"])

    return records.select(F.col(id_col).cast("long").alias("id"), F.col(smiles_col).alias("s")).mapInPandas(run, _GRAPH)


def atoms(graphs: DataFrame) -> DataFrame:
    a = graphs.select(F.col("id").alias("graph_id"), F.posexplode("atoms").alias("node_id", "x"))
    return a.select("graph_id", F.col("node_id").cast("long").alias("node_id"), "x.*")


def bonds(graphs: DataFrame) -> DataFrame:
    """Directed edges, each bond in both directions one after the other."""
    b = graphs.select(F.col("id").alias("graph_id"), F.posexplode("bonds").alias("k", "x"))
    both = F.explode(F.array(F.struct(F.lit(0).alias("d"), F.col("x.a").alias("i"), F.col("x.b").alias("o")), F.struct(F.lit(1).alias("d"), F.col("x.b").alias("i"), F.col("x.a").alias("o"))))
    e = b.withColumn("e", both)
    return e.select("graph_id", (2 * F.col("k") + F.col("e.d")).cast("long").alias("edge_id"), F.col("e.i").cast("long").alias("node_in"), F.col("e.o").cast("long").alias("node_out"), F.col("x.order").alias("bond_order"))


def valences(graphs: DataFrame) -> DataFrame:
    """Sum of bond orders of each atom, rounded; 0 for single atoms. Counted within each molecule's row, so no table of atoms is joined
    with one of bonds, whose sizes can't be told from that of the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, len(whole), 1_000):
                b = whole.slice(lo, 1_000)
                n, m = (b.column(c).value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("atoms", "bonds"))
                atom, bond = b.column("atoms").flatten(), b.column("bonds").flatten()
                x, y, order = (pc.struct_field(bond, c).to_numpy(zero_copy_only=False) for c in ("a", "b", "order"))
                first = np.cumsum(n) - n
                at = np.repeat(first, m)
                total = np.bincount(at + x, order, n.sum()) + np.bincount(at + y, order, n.sum())
                yield pa.RecordBatch.from_pydict({
                    "graph_id": pa.array(np.repeat(b.column("id").to_numpy(zero_copy_only=False), n)), "node_id": pa.array(np.arange(len(atom)) - np.repeat(first, n)),
                    "atom_type": pc.struct_field(atom, "atom_type"), "formal_charge": pc.struct_field(atom, "formal_charge"), "valence": pa.array(np.floor(total + 0.5).astype(np.int64)),
                })

    return graphs.select("id", "atoms", "bonds").mapInArrow(run, "graph_id long, node_id long, atom_type int, formal_charge int, valence long")


def valid(graphs: DataFrame, unknown: bool | None = None) -> DataFrame:
    """``(graph_id, valid)``: no atom beyond its valence; charged nitrogen may have four. An atom without a known valence is an
    error, unless ``unknown`` says what such a molecule is."""
    table = F.create_map(*[F.lit(x) for kv in VALENCE.items() for x in kv])
    most = F.when((F.col("atom_type") == 7) & (F.col("formal_charge") == 1), 4).otherwise(F.try_element_at(table, F.col("atom_type")))
    other = F.raise_error(F.concat(F.lit("no valence is known for atom "), F.col("atom_type").cast("string"))).cast("boolean") if unknown is None else F.lit(unknown)
    return valences(graphs).groupBy("graph_id").agg(F.min(F.when(most.isNull(), other).otherwise(F.col("valence") <= most)).alias("valid"))


def neutral(a: DataFrame) -> DataFrame:
    """Atoms with charge 1 only where nitrogen has a valence over three, no explicit hydrogens."""
    return a.withColumn("formal_charge", F.when((F.col("atom_type") == 7) & (F.col("valence") > 3), 1).otherwise(0))


def reactions(records: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(id, reactant, agent, product)`` of ``reactant>agent>product`` texts with three parts."""
    p = F.split(F.col(text_col), ">")
    return records.where(F.size(p) == 3).select(F.col(id_col).alias("id"), p[0].alias("reactant"), p[1].alias("agent"), p[2].alias("product"))


def symbol_numbers(spark) -> DataFrame:
    return spark.createDataFrame([(k, v) for k, v in NUMBER.items()], "symbol string, atom_type int")


def to_smiles(graphs: DataFrame) -> DataFrame:
    """``(graph_id, smiles)``: each molecule as text again, without stereo marks."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        order = ("atom_type", "formal_charge", "explicit_hs", "aromatic", "isotope", "chiral", "atom_map")
        for b in batches:
            text = [write([tuple(a[c] for c in order) for a in atoms_], [(x["a"], x["b"], x["order"], x["stereo"]) for x in bonds_]) for atoms_, bonds_ in zip(b["atoms"], b["bonds"])]
            yield pd.DataFrame({"graph_id": b["id"], "smiles": text})

    return graphs.mapInPandas(run, "graph_id long, smiles string")


# Usual valences of uncharged atoms by their number, for implied hydrogens.
USUAL = {5: (3,), 6: (4,), 7: (3, 5), 8: (2,), 9: (1,), 14: (4,), 15: (3, 5), 16: (2, 4, 6), 17: (1,), 34: (2, 4, 6), 35: (1,), 53: (1,)}
_ATOM = "graph_id long, node_id long, atom_type int, formal_charge int, aromatic boolean, chirality int, degree int, total_hs int, valence int, hybrid int, in_ring boolean, ring_sizes array<int>"
_BOND = "graph_id long, bond_id long, node_in long, node_out long, bond_order double, direction int, conjugated boolean, in_ring boolean"


def _around(n: int, bonds_: list) -> list[list[tuple[int, int]]]:
    out: list[list[tuple[int, int]]] = [[] for _ in range(n)]
    for k, x in enumerate(bonds_):
        out[x["a"]].append((x["b"], k))
        out[x["b"]].append((x["a"], k))
    return out


def ring_of(near: list[list[tuple[int, int]]], a: int, b: int, bond: int) -> int:
    """Atoms of the smallest ring through a bond, 0 if none: the shortest way from one end to the other without it."""
    seen, front, size = {a}, [a], 1
    while front:
        size += 1
        nxt = []
        for x in front:
            for y, k in near[x]:
                if k == bond or y in seen:
                    continue
                if y == b:
                    return size
                seen.add(y)
                nxt.append(y)
        front = nxt
    return 0


def scaffold_atoms(n: int, bonds_: list) -> set[int]:
    """Atoms of rings, of what links them, and those bound to them by a double bond; none in a molecule without rings."""
    near = _around(n, bonds_)
    kept = set(range(n))
    loose = [x for x in kept if len(near[x]) < 2]
    degree = [len(x) for x in near]
    while loose:
        x = loose.pop()
        if x not in kept:
            continue
        kept.discard(x)
        for y, _ in near[x]:
            degree[y] -= 1
            if y in kept and degree[y] < 2:
                loose.append(y)
    return kept | {y for x in kept for y, k in near[x] if bonds_[k]["order"] == 2.0 and y not in kept} if kept else set()


def graph_key(atoms_: list, bonds_: list, kept: set[int]) -> str:
    """A key that is the same for molecules with the same atoms and bonds among ``kept``, however numbered: colours refined by their
    neighbours' until no more differ. Rare regular graphs that differ may share one. Empty for no atoms."""
    if not kept:
        return ""
    near: dict[int, list[tuple[int, float]]] = {x: [] for x in kept}
    for x in bonds_:
        if x["a"] in kept and x["b"] in kept:
            near[x["a"]].append((x["b"], x["order"]))
            near[x["b"]].append((x["a"], x["order"]))
    digest = lambda x: hashlib.blake2b(repr(x).encode(), digest_size=12).hexdigest()
    colour = {x: digest((atoms_[x]["atom_type"], atoms_[x]["formal_charge"], bool(atoms_[x]["aromatic"]))) for x in kept}
    different = 0
    while len(set(colour.values())) > different:
        different = len(set(colour.values()))
        colour = {x: digest((colour[x], sorted((o, colour[y]) for y, o in near[x]))) for x in kept}
    return digest(sorted(colour.values()))


def scaffolds(graphs: DataFrame) -> DataFrame:
    """``(graph_id, scaffold, molecule)``: keys of each molecule's scaffold (empty without rings) and of the whole molecule; stereo
    marks, isotopes and atom maps don't count."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            keys = [(graph_key(x, y, scaffold_atoms(len(x), y)), graph_key(x, y, set(range(len(x))))) for x, y in zip(b["atoms"], b["bonds"])]
            yield pd.DataFrame({"graph_id": b["id"], "scaffold": [k for k, _ in keys], "molecule": [k for _, k in keys]})

    return graphs.mapInPandas(run, "graph_id long, scaffold string, molecule string")


def _hydrogens(atom, valence: float) -> int:
    usual = USUAL.get(atom["atom_type"])
    if atom["explicit_hs"] or usual is None or atom["formal_charge"] or atom["isotope"] or atom["chiral"] or atom["atom_map"]:
        return atom["explicit_hs"]
    need = next((v for v in usual if v >= valence), usual[-1])
    return max(0, int(need - valence))


def _describe(i: int, atoms_: list, bonds_: list) -> tuple[list[tuple], list[tuple]]:
    near = _around(len(atoms_), bonds_)
    rings = [ring_of(near, x["a"], x["b"], k) for k, x in enumerate(bonds_)]
    manifold = [any(x["order"] > 1 for x in (bonds_[k] for _, k in near[n])) for n in range(len(atoms_))]
    rows = []
    for n, a in enumerate(atoms_):
        order = [bonds_[k]["order"] for _, k in near[n]]
        # An aromatic atom's bonds count as one double bond more than single ones.
        valence = int(len(order) + 1 if a["aromatic"] and any(o == 1.5 for o in order) and a["atom_type"] in (6, 7) else sum(order) + 0.5 if not a["aromatic"] else len(order))
        hs = _hydrogens(a, valence)
        hybrid = 1 if not order and a["atom_type"] == 1 else 2 if 3.0 in order or order.count(2.0) > 1 else 3 if 2.0 in order or a["aromatic"] else 4
        rows.append((i, n, a["atom_type"], a["formal_charge"], bool(a["aromatic"]), {"@@": 1, "@": 2}.get(a["chiral"], 3 if a["chiral"] else 0), len(order), hs, valence, hybrid, any(rings[k] for _, k in near[n]), sorted({rings[k] for _, k in near[n] if rings[k]})))
    links = [(i, k, x["a"], x["b"], x["order"], {"/": 1, "\\": 2}.get(x["stereo"], 0), x["order"] == 1.5 or x["order"] == 1.0 and manifold[x["a"]] and manifold[x["b"]], bool(rings[k])) for k, x in enumerate(bonds_)]
    return rows, links


def described(graphs: DataFrame, level: str = "atom") -> DataFrame:
    """Atoms (or bonds) with what features need: hydrogens implied by usual valences, rings through them and their sizes, hybrid
    orbitals from bond orders. Perceived by these rules alone, no toolkit: lone pairs don't conjugate."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in (_ATOM if level == "atom" else _BOND).split(", ")]
        for b in batches:
            rows = [r for i, x, y in zip(b["id"].tolist(), b["atoms"], b["bonds"]) for r in _describe(i, list(x), list(y))[0 if level == "atom" else 1]]
            yield pd.DataFrame(rows, columns=names)

    return graphs.mapInPandas(run, _ATOM if level == "atom" else _BOND)


def reaction_graphs(records: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(id, reactant_atoms, reactant_bonds, product_atoms, product_bonds)`` of reactions both sides of which can be read; others are
    left out, the pair whole."""
    r = reactions(records, id_col, text_col)
    side = lambda c: parsed(r, "id", c).select("id", F.col("atoms").alias(f"{c}_atoms"), F.col("bonds").alias(f"{c}_bonds"))
    return side("reactant").join(side("product"), "id")


def protein_ligands(samples: DataFrame, form: Callable[[str], str | None] = str.strip) -> tuple[DataFrame, DataFrame]:
    """``(samples, sizes)``: samples ``(sample_id, sequence, smiles, split, ...)`` that have a sequence and whose ligand can be read, with
    its ``atoms`` and ``bonds``, and how many of each split are left."""
    g = parsed(samples.select("sample_id", "smiles"), "sample_id", "smiles", form=form).withColumnRenamed("id", "sample_id")
    kept = samples.where(F.length("sequence") > 0).join(g, "sample_id")
    return kept, kept.groupBy("split").agg(F.count("*").alias("n"))
