"""Features of atoms, bonds and residues as arrays of one-hot places, by name."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from spindrel.functions.scores import one_hot
from spindrel.functions.sequence import RESIDUES

# The elements that have a place of their own, and how many places the other descriptors have.
ATOMS = ("H", "B", "C", "N", "O", "F", "Mg", "Si", "P", "S", "Cl", "Cu", "Zn", "Se", "Br", "Sn", "I")
DEGREES, HYDROGENS, LEAST_CHARGE, CHARGES, CHIRALITIES, VALENCES, HYBRIDS = 7, 7, -5, 11, 4, 8, 9
BONDS = (1.0, 2.0, 3.0, 1.5)


def place_in(values: tuple, x: Column) -> Column:
    """The place of ``x`` among literal values, -1 if it isn't there."""
    return F.coalesce(F.array_position(F.array(*[F.lit(v) for v in values]), x), F.lit(0)).cast("int") - 1


def _atoms() -> dict[str, Column]:
    from spindrel.functions.smiles import NUMBER

    flag = lambda c: F.array(F.col(c).cast("int"))
    size = lambda n: F.array_contains("ring_sizes", n).cast("int")
    some = F.array_contains("ring_sizes", 3) | F.array_contains("ring_sizes", 4) | F.array_contains("ring_sizes", 5) | F.array_contains("ring_sizes", 6)
    one = {
        "symbol": one_hot(place_in(tuple(NUMBER[a] for a in ATOMS), F.col("atom_type")), len(ATOMS), True),
        "chirality": one_hot(F.col("chirality"), CHIRALITIES),
        "degree": one_hot(F.col("degree"), DEGREES, True),
        "total_degree": one_hot(F.col("degree") + F.col("total_hs"), DEGREES, True),
        "charge": one_hot(F.col("formal_charge") - LEAST_CHARGE, CHARGES, True),
        "hydrogens": one_hot(F.col("total_hs"), HYDROGENS, True),
        "valence": one_hot(F.col("valence") + F.col("total_hs"), VALENCES, True),
        "hybrid": one_hot(F.col("hybrid"), HYBRIDS),
        "aromatic": flag("aromatic"),
        "ring": flag("in_ring"),
        "rings": F.array(F.col("in_ring").cast("int"), *[size(n) for n in (3, 4, 5, 6)], (F.col("in_ring") & ~some).cast("int")),
    }
    sets = {
        "atom_symbol": ("symbol",),
        "atom_default": ("symbol", "chirality", "total_degree", "charge", "hydrogens", "hybrid", "aromatic", "ring"),
        "atom_center_identification": ("symbol", "hydrogens", "total_degree", "valence", "aromatic", "ring"),
        "atom_synthon_completion": ("symbol", "hydrogens", "total_degree", "rings"),
        "atom_explicit_property_prediction": ("symbol", "degree", "valence", "charge", "aromatic"),
        "atom_property_prediction": ("symbol", "degree", "hydrogens", "valence", "charge", "aromatic"),
        "atom_pretrain": ("symbol", "chirality"),
    }
    return {name: F.concat(*[one[x] for x in parts]) for name, parts in sets.items()}


def _bonds() -> dict[str, Column]:
    kind = one_hot(place_in(BONDS, F.col("bond_order")), len(BONDS))
    direction = one_hot(F.col("direction"), 3)
    flag = lambda c: F.array(F.col(c).cast("int"))
    return {"bond_default": F.concat(kind, direction, flag("conjugated")), "bond_property_prediction": F.concat(kind, flag("conjugated"), flag("in_ring")), "bond_pretrain": F.concat(kind, direction)}


def features(name: str) -> Column:
    """The features of that name: of atoms and bonds as :func:`spindrel.sources.molecules.described` gives them, or of a
    ``residue_type`` (``residue_symbol``, ``residue_default``). An unknown name is an error."""
    if name in ("residue_symbol", "residue_default"):
        return one_hot(F.col("residue_type"), len(RESIDUES), True)
    known = _atoms() if name.startswith("atom_") else _bonds()
    if name not in known:
        raise KeyError(f"unknown features: {name}; known are {', '.join(known)}")
    return known[name]
