"""Readers and writers of triplet files, node files, CSV with targets, FASTA and PDB text, and partitioned Parquet."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spindrel.operators.ordered import numbered
from spindrel.session import maybe_broadcast


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """``(file, line, value)`` of text files, lines counted from 0 within each file. Large files are read in blocks by many tasks: lines
    are numbered within a block, in the order in which its task reads them, after those of the blocks before it (a row a block)."""
    t = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_b"), "value").withColumn("_i", F.monotonically_increasing_id())
    before = Window.partitionBy("file").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    blocks = t.groupBy("file", "_b").agg(F.count("*").alias("n")).select("file", "_b", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_a"))
    at = F.row_number().over(Window.partitionBy("file", "_b").orderBy("_i")) - 1
    return t.withColumn("_k", at).join(blocks, ["file", "_b"]).select("file", (F.col("_a") + F.col("_k")).cast("long").alias("line"), "value")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """``(file, value)``: lines of text files, plain, ``.gz`` or ``.bz2`` (as Spark reads them), or of the members of ``.zip`` files, which
    are opened one to a task."""
    if not path.endswith(".zip"):
        return spark.read.text(path).select(F.col("_metadata.file_name").alias("file"), "value")

    def members(batches):
        import io
        import zipfile

        import pandas as pd

        for b in batches:
            for data in b["content"]:
                with zipfile.ZipFile(io.BytesIO(data)) as z:
                    for name in z.namelist():
                        with z.open(name) as f:
                            lines = io.TextIOWrapper(f, "utf-8", "replace").read().splitlines()
                            yield pd.DataFrame({"file": [name] * len(lines), "value": lines})

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(members, "file string, value string")


def line_counts(spark: SparkSession, path: str) -> DataFrame:
    """``(file, n)``: how many lines each file has; files without any have no row."""
    return read_lines(spark, path).groupBy("file").agg(F.count("*").alias("n"))


def first_seen_ids(tokens: DataFrame) -> DataFrame:
    """``(token, id)`` in the order of first appearance: ``tokens (token, at long)``, places unique. One row a token is ranked."""
    f = tokens.groupBy("token").agg(F.min("at").alias("at"))
    return numbered(f, "at", name="id").select("token", "id")


def place(file: Column | int, line: Column | str, side: Column | int) -> Column:
    """The place of a token as one number: file, line (below 2^41), and side."""
    as_col = lambda x: x if isinstance(x, Column) else F.lit(x)
    return as_col(file).cast("long") * (1 << 42) + F.col(line).cast("long") * 2 + as_col(side).cast("long")


def triplets(rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Triplets of ids and the vocabularies of entities and relations from ``rows (file_ord, line, h, r, t)`` of tokens; ids by first
    appearance, heads before tails of a line."""
    at = lambda k: place(F.col("file_ord"), "line", k)
    ent = first_seen_ids(rows.select(F.col("h").alias("token"), at(0).alias("at")).unionByName(rows.select(F.col("t").alias("token"), at(1).alias("at"))))
    rel = first_seen_ids(rows.select(F.col("r").alias("token"), at(0).alias("at")))
    j = rows.join(ent.toDF("h", "hi"), "h").join(ent.toDF("t", "ti"), "t").join(maybe_broadcast(rel.toDF("r", "ri")), "r")
    return j.select("file_ord", "line", F.col("hi").alias("h"), F.col("ti").alias("t"), F.col("ri").alias("r")), ent, rel


def read_triplets(spark: SparkSession, paths: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Tab-separated files of head, relation and tail that share their vocabularies."""
    out = None
    for i, p in enumerate(paths):
        f = F.split("value", "\t")
        d = numbered_lines(spark, p).where(F.size(f) == 3).select(F.lit(i).alias("file_ord"), "line", f[0].alias("h"), f[1].alias("r"), f[2].alias("t"))
        out = d if out is None else out.unionByName(d)
    return triplets(out)


def contiguous(vocabulary: DataFrame) -> DataFrame:
    """``vocabulary (token, id)`` checked: tokens and ids unique, ids 0 to n - 1; an error if not."""
    c = vocabulary.agg(F.count("*").alias("n"), F.countDistinct("id").alias("i"), F.countDistinct("token").alias("t"), F.max("id").alias("m"), F.min("id").alias("l")).first()
    if c["n"] and not (c["n"] == c["i"] == c["t"] == c["m"] + 1 and c["l"] == 0):
        raise ValueError("ids must be 0 to n - 1, each token once")
    return vocabulary


def read_csv_targets(spark: SparkSession, path: str, targets: list[str] | None = None, text: str | None = "smiles") -> DataFrame:
    """A CSV with header: the text column and numeric targets (all others by default), empty or unreadable ones as NaN; rows whose
    cells are all empty are left out. Only the named columns are read."""
    raw = spark.read.csv(path, header=True)
    targets = targets or [c for c in raw.columns if c != text]
    cols = [*([text] if text else []), *targets]
    some = F.coalesce(*[F.when(F.trim(c) != "", F.lit(True)) for c in cols], F.lit(False))
    num = lambda c: F.coalesce(F.expr(f"try_cast(`{c}` as double)"), F.lit(float("nan"))).alias(c)
    return raw.where(some).select(*([F.col(text)] if text else []), *[num(c) for c in targets])


def read_nodes(spark: SparkSession, node_path: str, edge_path: str) -> tuple[DataFrame, DataFrame]:
    """Nodes ``(node_id, token, feature, label)`` and edges from headerless tab-separated files; nodes that only edges name have
    features of 0 and label 0."""
    n = numbered_lines(spark, node_path).withColumn("f", F.split("value", "\t")).where(F.size("f") > 2)
    e = numbered_lines(spark, edge_path).withColumn("f", F.split("value", "\t")).where(F.size("f") == 2)
    node = n.select(F.col("f")[0].alias("token"), "line", F.transform(F.slice("f", F.lit(2), F.size("f") - 2), lambda x: x.cast("double")).alias("feature"), F.element_at("f", -1).alias("label_token"))
    at = lambda k: place(k, "line", 0)
    ends = e.select(F.explode(F.array(F.struct(F.col("f")[0].alias("token"), F.lit(0).alias("side")), F.struct(F.col("f")[1].alias("token"), F.lit(1).alias("side")))).alias("x"), "line")
    ids = first_seen_ids(node.select("token", at(0).alias("at")).unionByName(ends.select("x.token", place(1, "line", F.col("x.side")).alias("at"))))
    labels = first_seen_ids(node.select(F.col("label_token").alias("token"), at(0).alias("at"))).toDF("label_token", "label")
    width = node.agg(F.max(F.size("feature"))).first()[0] or 0
    full = ids.join(node.join(maybe_broadcast(labels), "label_token", "left"), "token", "left")
    nodes = full.select(F.col("id").alias("node_id"), "token", F.coalesce("feature", F.array_repeat(F.lit(0.0), width)).alias("feature"), F.coalesce("label", F.lit(0)).cast("long").alias("label"))
    edges = e.select(F.col("f")[0].alias("a"), F.col("f")[1].alias("b")).join(ids.toDF("a", "node_in"), "a").join(ids.toDF("b", "node_out"), "b").select("node_in", "node_out")
    return nodes, edges


def fasta(lines: DataFrame) -> DataFrame:
    """``(file, record, name, sequence)`` of ``lines (file, line, value)``: lines between headers joined in order; blank lines and text
    before the first header are left out."""
    w = Window.partitionBy("file").orderBy("line")
    head = F.col("value").startswith(">")
    r = lines.withColumn("record", F.sum(head.cast("long")).over(w)).where("record > 0")
    g = r.groupBy("file", "record").agg(F.max(F.when(head, F.trim(F.expr("substring(value, 2)")))).alias("name"), F.sort_array(F.collect_list(F.when(~head, F.struct("line", F.trim("value").alias("s"))))).alias("z"))
    return g.select("file", (F.col("record") - 1).alias("record"), "name", F.concat_ws("", F.transform("z", lambda x: x["s"])).alias("sequence"))


def pdb_atoms(lines: DataFrame) -> DataFrame:
    """Atoms of PDB text by its fixed columns; lines of other records, and atoms without numbers where they belong, are left out."""
    cut = lambda a, n: F.trim(F.substring("value", a, n))
    num = lambda a, n, t: F.expr(f"try_cast(trim(substring(value, {a}, {n})) as {t})")
    kind = F.trim(F.substring("value", 1, 6))
    d = lines.where(kind.isin("ATOM", "HETATM"))
    d = d.select("file", "line", (kind == "HETATM").alias("hetero"), num(7, 5, "long").alias("serial"), cut(13, 4).alias("atom_name"), cut(18, 3).alias("residue"), cut(22, 1).alias("chain_id"), num(23, 4, "int").alias("residue_number"), cut(27, 1).alias("insertion_code"), num(31, 8, "double").alias("x"), num(39, 8, "double").alias("y"), num(47, 8, "double").alias("z"), num(55, 6, "double").alias("occupancy"), num(61, 6, "double").alias("b_factor"), cut(77, 2).alias("element"))
    return d.where("x is not null and y is not null and z is not null and residue_number is not null")


def pdb_residues(atoms: DataFrame) -> DataFrame:
    """Atoms with ``residue_id``, which rises whenever chain, number, insertion code or name changes from one atom to the next."""
    w = Window.partitionBy("file").orderBy("line")
    key = F.struct("chain_id", "residue_number", "insertion_code", "residue")
    fresh = (F.lag(key).over(w).isNull() | (F.lag(key).over(w) != key)).cast("long")
    return atoms.withColumn("_f", fresh).withColumn("residue_id", F.sum("_f").over(w) - 1).drop("_f")


def pdb_lines(atoms: DataFrame) -> DataFrame:
    """``(file, line, value)``: atoms as fixed-width text again."""
    name = F.when(F.length("atom_name") < 4, F.concat(F.lit(" "), F.rpad("atom_name", 3, " "))).otherwise(F.col("atom_name"))
    v = F.format_string("%-6s%5d %-4s %3s %1s%4d%1s   %8.3f%8.3f%8.3f%6.2f%6.2f          %2s", F.when(F.col("hetero"), "HETATM").otherwise("ATOM"), "serial", name, "residue", "chain_id", "residue_number", F.when(F.col("insertion_code") == "", " ").otherwise(F.col("insertion_code")), "x", "y", "z", F.coalesce("occupancy", F.lit(1.0)), F.coalesce("b_factor", F.lit(0.0)), "element")
    return atoms.select("file", "line", v.alias("value"))


def write_by(df: DataFrame, path: str, *by: str) -> None:
    """Parquet parted by columns; rows of one part are gathered in as many files as their size needs."""
    df.write.mode("overwrite").partitionBy(*by).parquet(path)


def file_md5(path: str, chunk: int = 1 << 20) -> str:
    h = hashlib.md5(usedforsecurity=False)
    with open(path, "rb") as f:
        while b := f.read(chunk):
            h.update(b)
    return h.hexdigest()


def literal(c):
    """A cell as a number if it reads as one, else null; texts stay in their own column."""
    return F.expr(f"try_cast(`{c}` as double)")


def literal_kind(c: Column) -> Column:
    """What a cell reads as: ``none``, ``bool``, ``int``, ``float``, ``list``, ``dict``, or ``text``."""
    t = F.trim(c)
    kind = F.when(t == "None", "none").when(t.isin("True", "False"), "bool").when(t.rlike(r"^[+-]?[0-9]+$"), "int")
    kind = kind.when(t.rlike(r"^[+-]?([0-9]+\.[0-9]*|\.[0-9]+|[0-9]+(?=[eE]))([eE][+-]?[0-9]+)?$"), "float")
    return kind.when(t.rlike(r"^\[.*\]$"), "list").when(t.rlike(r"^\{.*\}$"), "dict").otherwise("text")
