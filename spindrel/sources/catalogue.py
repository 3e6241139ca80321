"""Public datasets that the sources here can load, as declarations: kind, form, targets and split. No file is fetched."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Name, form of its files, targets (``*`` for all numeric columns, ``-`` for none), how it is split (``-`` for not at all).
_CATALOGUE = {
    "molecule": """
        BACE csv Class -
        BBBP csv p_np -
        CEP csv PCE -
        ChEMBLFiltered csv * -
        ClinTox csv FDA_APPROVED,CT_TOX -
        Delaney csv solubility -
        FreeSolv csv expt -
        HIV csv HIV_active -
        Lipophilicity csv exp -
        Malaria csv activity -
        MOSES csv SPLIT column
        MUV csv * -
        OPV csv * file
        PCQM4M csv homolumogap -
        PubChem110m smiles - -
        QM8 csv+sdf * -
        QM9 csv+sdf * -
        SIDER csv * -
        Tox21 csv * -
        ToxCast csv * -
        ZINC250k csv logP,qed -
        ZINC2m smiles - -
    """,
    "reaction": "USPTO50k csv class stratified",
    "node": """
        CiteSeer tsv label -
        Cora tsv label -
        PubMed tsv label -
    """,
    "triplet": """
        FB15k tsv - file
        FB15k237 tsv - file
        Hetionet tsv - file
        WN18 tsv - file
        WN18RR tsv - file
        YAGO310 tsv - file
    """,
    "protein": """
        AlphaFoldDB pdb - range
        BetaLactamase lmdb scaled_effect1 file
        BinaryLocalization lmdb localization file
        EnzymeCommission pdb * file
        Fluorescence lmdb log_fluorescence file
        Fold lmdb fold_label file
        GeneOntology pdb * file
        ProteinNet lmdb tertiary,valid_mask file
        SecondaryStructure lmdb ss3,valid_mask file
        Solubility lmdb solubility file
        Stability lmdb stability_score file
        SubcellularLocalization lmdb localization file
    """,
    "protein_pair": """
        HumanPPI lmdb interaction file
        PPIAffinity lmdb interaction file
        YeastPPI lmdb interaction file
    """,
    "protein_ligand": """
        BindingDB lmdb affinity file
        PDBBind lmdb affinity file
    """,
}
#: The function of :mod:`spindrel.sources` that reads a kind of dataset, and the column its samples are known by.
READERS = {
    "molecule": ("read_csv_targets", "smiles"),
    "reaction": ("reactions", "reaction"),
    "node": ("read_nodes", "node_id"),
    "triplet": ("read_triplets", "h"),
    "protein": ("fasta", "sequence"),
    "protein_pair": ("paired_residues", "sample_id"),
    "protein_ligand": ("protein_ligands", "sample_id"),
}


def catalogue(spark: SparkSession) -> DataFrame:
    """``(name, kind, form, targets, split, reader, id_column)``, a row a dataset."""
    rows = []
    for kind, text in _CATALOGUE.items():
        for line in text.strip().splitlines():
            name, form, targets, split = line.split()
            rows.append((name, kind, form, None if targets == "-" else targets, None if split == "-" else split, *READERS[kind]))
    return spark.createDataFrame(rows, "name string, kind string, form string, targets string, split string, reader string, id_column string")
