import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from spindrel.llm.pieces import CHAIN_END, SparseTable, chain_starts, cut_proteins, pieces, strengths


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 4), min_size=1, max_size=60), st.data())
def test_range_maximum_like_brute_force(values, data):
    s = np.array(values, np.int8)
    lo = data.draw(st.integers(0, len(s) - 1))
    hi = data.draw(st.integers(lo, len(s) - 1))
    top = max(values[lo : hi + 1])
    assert SparseTable(s).best(lo, hi) == max(i for i in range(lo, hi + 1) if values[i] == top)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from([0, 0, 0, 1, 3]), min_size=2, max_size=200), st.integers(2, 20), st.integers(0, 9))
def test_pieces_cover_all_and_obey_limit(values, limit, overlap):
    overlap = min(overlap, limit // 2 - 1) if limit > 3 else 0
    s = np.array(values, np.int8)
    s[-1] = CHAIN_END
    out = pieces(s, limit, overlap)
    assert out[0][0] == 0 and out[-1][1] == len(s) - 1
    for (a, b, w), (c, d, _) in zip(out, out[1:]):
        assert 0 < b - a <= limit and d > b
        natural = [p for p in range(1, b + 1) if s[p] >= CHAIN_END]
        assert c == (b if w >= CHAIN_END else max(b - overlap, max(natural, default=0)))


def test_chain_marks():
    assert chain_starts("acd EF\n  51 G-H*") == ("ACDEFGH", [0])
    assert chain_starts(" . AC//DE | : F\n/\n  101 /GX:") == ("ACDEFGX", [0, 2, 4, 5])
    assert chain_starts("::") == ("", []) and chain_starts("") == ("", [])
    s = strengths("AGSAAA", [0, 4])
    assert s.tolist() == [0, 0, 1, 0, 3, 0, 3]


def test_no_overlap_beyond_limit():
    with pytest.raises(ValueError):
        pieces(np.zeros(10, np.int8), 3, 3)


def test_cut_proteins(spark):
    p = spark.createDataFrame(
        [(1, "A" * 600, "x"), (2, "A" * 300 + "." + "C" * 300, "x"), (3, "A" * 512, "x"), (4, None, "x"), (5, "A" * 100 + "C" * 500, "x"), (6, "G" * 20_000, "x"), (None, "A" * 900, "x")],
        "protein_id long, sequence string, chain_id string",
    )
    r = spark.createDataFrame([(5, i, "H" if i < 100 else "L") for i in range(600)] + [(5, 3, "H"), (None, 1, "A"), (2, 0, None)], "graph_id long, residue_id long, chain_id string")
    rows = cut_proteins(p, r).collect()
    got = {}
    for x in sorted(rows, key=lambda x: (x.id, x.piece)):
        got.setdefault(x.id, []).append((x.start, x.end, x.chain_no, x.natural))
        assert len(x.residues) == x.end - x.start <= 512
    assert got[1] == [(0, 512, 0, False), (480, 600, 0, True)]
    assert got[2] == [(0, 300, 0, True), (300, 600, 1, True)]
    assert got[5] == [(0, 100, 0, True), (100, 600, 1, True)]
    assert set(got) == {1, 2, 5, 6} and len(got[6]) == 42
    assert cut_proteins(p.limit(0), r.limit(0)).count() == 0
