import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from spindrel.llm import packing
from spindrel.llm.packing import VOCABULARY, count, encoding, packed, patterns

SHAPE = "doc_id long, text string, piece string, length int"


@settings(max_examples=80, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(0, 50), max_size=20))
def test_patterns_hold_every_length_within_capacity(histogram):
    found = patterns(histogram, 64)
    held: dict[int, int] = {}
    for packs, parts in found:
        assert packs > 0 and sum(x * t for x, t in parts) <= 64
        for x, t in parts:
            held[x] = held.get(x, 0) + packs * t
    assert held == {k: v for k, v in histogram.items() if v}
    total, packs = sum(k * v for k, v in histogram.items()), sum(p for p, _ in found)
    assert packs <= 2 * -(-total // 64)


def test_lengths_that_cannot_fit():
    with pytest.raises(ValueError):
        patterns({65: 1}, 64)


def check(rows, capacity, sizes):
    boxes: dict[int, list] = {}
    for r in rows:
        assert 0 < r.token_end - r.token_start <= capacity
        boxes.setdefault(r.container_id, []).append(r)
    for box in boxes.values():
        box.sort(key=lambda r: r.place)
        at = 0
        for k, r in enumerate(box):
            assert r.place == k and r.offset == at
            at += r.token_end - r.token_start
        assert at <= capacity
    assert set(boxes) == set(range(len(boxes)))
    got: dict[int, list] = {}
    for r in rows:
        got.setdefault(r.doc_id, []).append((r.token_start, r.token_end))
    for i, n in sizes.items():
        parts = sorted(got.pop(i, []))
        assert sum(b - a for a, b in parts) == n and (n <= capacity) <= (len(parts) <= 1)
        assert all(b == c for (_, b), (c, _) in zip(parts, parts[1:]))
    assert not got
    return len(boxes)


def test_packed_on_spark(spark, monkeypatch):
    monkeypatch.setattr(packing, "RANKED", 3)
    enc = encoding(VOCABULARY)
    docs = [(i, "word " * (i % 37) + "end", "x", 1) for i in range(200)] + [(1000, "many words " * 300, "", 0), (1001, None, "", 0), (1002, "", "", 0)]
    sizes = {i: len(enc.encode_ordinary(t)) if t else 0 for i, t, _, _ in docs}
    rows = packed(spark.createDataFrame(docs, SHAPE), 128).collect()
    n = check(rows, 128, sizes)
    assert n <= 1.05 * sum(sizes.values()) / 128 + 1
    assert packed(spark.createDataFrame([], SHAPE)).count() == 0


def test_null_ids_and_repeated_rows(spark):
    rows = packed(spark.createDataFrame([(None, "a b c", "", 0), (5, "x y", "", 0), (5, "x y", "", 0)], SHAPE), 16).collect()
    assert sorted((r.doc_id or 0) for r in rows) == [0, 5, 5] and len({(r.container_id, r.place) for r in rows}) == 3


def test_long_texts_count_as_a_whole(monkeypatch):
    enc = encoding(VOCABULARY)
    t = "Some words, 12 of them, and more:  lines\nof them. " * 200
    whole = len(enc.encode_ordinary(t))
    monkeypatch.setattr(packing, "_PART", 100)
    assert count(enc, t) == whole and count(enc, "") == 0 and count(enc, "x" * 500) == len(enc.encode_ordinary("x" * 500))
    assert count(enc, "<|endoftext|>") == len(enc.encode_ordinary("<|endoftext|>"))
