"""Loading physical CSV lines, parted into typed rows and rejected lines with their reason.

Structural indexing: the bytes of a whole Arrow batch lie in one buffer; a mask of quotes and the parity of its running sum tell
which commas delimit fields, and line offsets where records end. Quotes, counts and types are then checked column by column, on
Arrow arrays; only SMILES go through a parser, text by text.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrel.functions.smiles import problem

REASONS = ("quoting", "column_count", "bad_smiles", "bad_target")
_NUMBER = r"^[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?$"
#: Kinds of fields: Spark type, and the reason that a value of another kind gives.
KINDS = {"smiles": ("string", "bad_smiles"), "text": ("string", None), "number": ("double", "bad_target"), "flag": ("int", "bad_target")}


@dataclass(frozen=True)
class Field:
    """A column of the files: ``smiles`` (never empty), ``text``, ``number`` or ``flag`` (0 or 1); the others may be empty, and are null then."""

    name: str
    kind: str = "text"


FIELDS = (Field("smiles", "smiles"), Field("name"), Field("solubility", "number"), Field("affinity", "number"), Field("toxic", "flag"), Field("assay"))


def structural_index(lines: pa.StringArray) -> tuple[pa.StringArray, np.ndarray, np.ndarray]:
    """All fields of all lines in order, how many each line has, and whether its quotes close. Nulls are empty lines."""
    lines = lines.fill_null("").cast(pa.large_string())
    n = pc.binary_length(lines).to_numpy(zero_copy_only=False).astype(np.int64)
    at = np.concatenate([[0], np.cumsum(n)])
    offset = int(np.frombuffer(lines.buffers()[1], np.int64)[lines.offset]) if len(lines) else 0
    buf = np.frombuffer(lines.buffers()[2] or b"", np.uint8)[offset : offset + at[-1]]
    quotes = np.concatenate([[0], np.cumsum(buf == 34, dtype=np.int64)])
    closed = ((quotes[at[1:]] - quotes[at[:-1]]) & 1) == 0
    comma = np.flatnonzero(buf == 44)
    line = np.searchsorted(at, comma, side="right") - 1
    delimits = ((quotes[comma] - quotes[at[line]]) & 1) == 0
    comma, line = comma[delimits], line[delimits]
    count = 1 + np.bincount(line, minlength=len(n))
    # Starts and ends rise from field to field, so both can be sorted apart; without its delimiters the buffer holds the fields.
    size = np.sort(np.concatenate([comma, at[1:]])) - np.sort(np.concatenate([at[:-1], comma + 1]))
    kept = np.ones(len(buf), bool)
    kept[comma] = False
    bounds = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
    fields = pa.LargeStringArray.from_buffers(len(size), pa.py_buffer(bounds), pa.py_buffer(buf[kept].tobytes()))
    return fields, count, closed


def unquoted(fields: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The values of fields, and whether their quotes are well placed: around the whole field, doubled within."""
    t = pc.utf8_trim_whitespace(fields)
    quoted = pc.match_substring(t, '"')
    some = np.flatnonzero(quoted.to_numpy(zero_copy_only=False))
    ok = np.ones(len(t), bool)
    if not len(some):
        return t, ok
    q = t.take(pa.array(some))
    whole = pc.and_(pc.and_(pc.starts_with(q, '"'), pc.ends_with(q, '"')), pc.greater_equal(pc.binary_length(q), 2))
    inner = pc.utf8_slice_codeunits(q, 1, -1)
    single = pc.match_substring(pc.replace_substring(inner, '""', ""), '"')
    ok[some] = pc.and_(whole, pc.invert(single)).to_numpy(zero_copy_only=False)
    return pc.replace_with_mask(t, quoted, pc.utf8_trim_whitespace(pc.replace_substring(inner, '""', '"'))), ok


def is_wrong(kind: str, values: pa.Array) -> np.ndarray:
    """Which values of a column aren't of its kind."""
    if kind == "smiles":
        return np.array([problem(x) is not None for x in values.to_pylist()], bool)
    if kind == "number":
        return pc.and_(pc.not_equal(values, ""), pc.invert(pc.match_substring_regex(values, _NUMBER))).to_numpy(zero_copy_only=False)
    if kind == "flag":
        return pc.invert(pc.is_in(values, pa.array(["", "0", "1"], values.type))).to_numpy(zero_copy_only=False)
    return np.zeros(len(values), bool)


def typed(kind: str, values: pa.Array) -> pa.Array:
    if kind == "number":
        return pa.array([float(x) if x else None for x in values.to_pylist()], pa.float64())
    if kind == "flag":
        return pa.array([int(x) if x else None for x in values.to_pylist()], pa.int32())
    return pc.if_else(pc.equal(values, ""), None, values).cast(pa.string())


def check_lines(lines: pa.StringArray, fields: Sequence[Field] = FIELDS) -> tuple[np.ndarray, list[pa.Array], np.ndarray, np.ndarray]:
    """Numbers of the valid lines, their columns as text, numbers of the rejected lines, and which of ``REASONS`` rejects each; skipped
    lines are in neither."""
    cells, count, closed = structural_index(lines)
    values, ok = unquoted(cells)
    first = np.cumsum(count) - count
    reason = np.full(len(count), -1)
    if not len(count):
        return np.zeros(0, np.int64), [values] * len(fields), np.zeros(0, np.int64), np.zeros(0, np.int64)
    filled = np.logical_or.reduceat(pc.greater(pc.binary_length(values), 0).to_numpy(zero_copy_only=False), first)
    bad_quotes = ~closed | ~np.logical_and.reduceat(ok, first)
    skipped = ~filled & ~bad_quotes
    reason[count != len(fields)] = 1
    reason[bad_quotes] = 0
    left = np.flatnonzero((reason < 0) & ~skipped)
    columns = [values.take(pa.array(first[left] + j)) for j in range(len(fields))]
    for want in REASONS[2:]:
        for f, v in zip(fields, columns):
            if KINDS[f.kind][1] == want:
                wrong = is_wrong(f.kind, v)
                reason[left[wrong & (reason[left] < 0)]] = REASONS.index(want)
    good = reason[left] < 0
    rejected = np.flatnonzero((reason >= 0) & ~skipped)
    return left[good], [c.filter(pa.array(good)) for c in columns], rejected, reason[rejected]


def parted_rows(raw: DataFrame, id_col: str = "raw_id", line_col: str = "raw_line", fields: Sequence[Field] = FIELDS) -> DataFrame:
    """One row for each line that isn't empty: its id, typed ``fields`` and a null ``reason``, or null fields and the first reason that
    applies.

    Null and blank lines, and lines of empty fields only, are skipped. A null id stays null. Repeated lines come out as often as
    they come in; an empty table gives an empty table; other columns of ``raw`` are not read. Lines of any length are checked
    whole. Narrow: no shuffle, one pass.
    """
    names = np.array(REASONS, object)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            valid, columns, rejected, why = check_lines(b.column("line"), fields)
            ids = b.column("id")
            out = {"raw_id": ids.take(pa.array(np.concatenate([valid, rejected]).astype(np.int64)))}
            for f, c in zip(fields, columns):
                c = typed(f.kind, c)
                out[f.name] = pa.concat_arrays([c, pa.nulls(len(rejected), c.type)])
            out["reason"] = pa.array([None] * len(valid) + names[why].tolist(), pa.string())
            yield pa.RecordBatch.from_pydict(out)

    schema = ", ".join(["raw_id long", *(f"`{f.name}` {KINDS[f.kind][0]}" for f in fields), "reason string"])
    src = raw.select(F.col(id_col).cast("long").alias("id"), F.col(line_col).cast("string").alias("line"))
    return src.mapInArrow(run, schema)


def valid_rows(raw: DataFrame, fields: Sequence[Field] = FIELDS) -> DataFrame:
    return parted_rows(raw, fields=fields).where("reason is null").drop("reason")


def rejected_rows(raw: DataFrame, fields: Sequence[Field] = FIELDS) -> DataFrame:
    return parted_rows(raw, fields=fields).where("reason is not null").select("raw_id", "reason")


def read_csv_lines(spark, path: str) -> DataFrame:
    """Physical lines of CSV files as ``raw_rows``; ``raw_id`` is unique and grows within a part of a file that one task reads."""
    return spark.read.text(path).select(F.monotonically_increasing_id().alias("raw_id"), F.col("_metadata.file_name").alias("file_name"), F.col("value").alias("raw_line"))
