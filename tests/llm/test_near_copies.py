import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from spindrel.llm import near_copies, set_lists
from spindrel.llm.cross_split import cosine_join, least_cosine, overlap_counts, rarity_weights
from spindrel.llm.near_copies import near_copy_groups, near_copy_pairs
from spindrel.llm.set_tokens import bitmap, frequency_table, mixed, most, ones, stretches

SHAPE = "id long, tokens array<long>"


def jaccard(sets, t):
    return {(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and len(sets[a] & sets[b]) >= t * len(sets[a] | sets[b])}


def family(seed, n=120, base=12, hot=5):
    rng = np.random.default_rng(seed)
    sets = {}
    for i in range(n):
        core = set(np.random.default_rng(i % base).integers(0, 5000, 40).tolist())
        drop = set(rng.choice(sorted(core), int(rng.integers(0, 14)), replace=False).tolist())
        sets[i] = (core - drop) | set(rng.integers(0, 5000, int(rng.integers(0, 8))).tolist()) | set(range(9000, 9000 + hot))
    sets[n], sets[n + 1] = set(), set(sets[0])
    return sets


@pytest.mark.parametrize("threshold,block,hot", [(0.5, 4096, 5), (0.8, 4096, 0), (0.6, 16, 60)])
def test_pairs_like_brute_force(spark, threshold, block, hot):
    sets = family(1, hot=hot)
    df = spark.createDataFrame([(i, sorted(x)) for i, x in sets.items()], SHAPE)
    assert {(r.id_a, r.id_b) for r in near_copy_pairs(df, threshold, block).collect()} == jaccard(sets, threshold)


@settings(max_examples=3, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.sets(st.integers(0, 12), max_size=6), min_size=1, max_size=14))
def test_small_sets_with_ties(spark, sets):
    sets = dict(enumerate(sets))
    df = spark.createDataFrame([(i, sorted(x)) for i, x in sets.items()], SHAPE)
    assert {(r.id_a, r.id_b) for r in near_copy_pairs(df, 0.5).collect()} == jaccard(sets, 0.5)


def test_groups_and_empty(spark):
    sets = {1: {1, 2, 3, 4}, 2: {1, 2, 3, 4}, 3: {1, 2, 3, 5}, 4: {9}, 5: set()}
    df = spark.createDataFrame([(i, sorted(x)) for i, x in sets.items()], SHAPE)
    assert {(r.id, r.group_id, r.n_links) for r in near_copy_groups(df, 0.5).collect()} == {(1, 1, 1), (2, 1, 1), (3, 1, 1), (4, 4, 0)}
    assert near_copy_pairs(df.limit(0)).count() == 0


def test_tokens():
    assert len(stretches("ABCDE")) == 1 and len(stretches("ABCD")) == 0 and len(stretches("AAAAAAAA")) == 1 and len(stretches("ABCDEF" * 3)) == 6
    t = stretches("ACDEFGHIKLMNPQRSTVWY" * 20)
    assert ones(bitmap(t).view(np.uint64)) <= len(t)
    assert all(most(np.array([1 + np.ceil(8 * np.log2(c))]))[0] >= c for c in (1, 2, 3, 100, 12345))


def test_frequency_table_counts_all(spark):
    table = frequency_table(spark.createDataFrame([(i, [7, i + 100]) for i in range(64)], SHAPE))
    from spindrel.llm.set_tokens import cell_of

    assert table[cell_of(np.array([7]))[0]] == 1 + 8 * 6 and table[cell_of(np.array([100]))[0]] == 1


@pytest.mark.parametrize("threshold,block,weighted", [(2 / 3, 4096, False), (0.7, 8, True), (1.0, 4096, True)])
def test_cosine_join_like_brute_force(spark, threshold, block, weighted):
    sets = {i: s for i, s in family(2, n=60).items()}
    rng = np.random.default_rng(3)
    idf = dict(enumerate(rng.random(10_000) + 0.1))
    vec = {i: {t: (idf[t] if weighted else 1.0) for t in s} for i, s in sets.items()}
    df = spark.createDataFrame([(i, list(v), list(map(float, v.values()))) for i, v in vec.items()], "id long, terms array<long>, weights array<double>")
    left, right = df.where("id % 3 = 0"), df.where("id % 3 <> 0")
    length = {i: sum(w * w for w in v.values()) ** 0.5 for i, v in vec.items()}
    want = {}
    for a in vec:
        for b in vec:
            if a % 3 == 0 and b % 3 and vec[a] and vec[b]:
                c = sum(w * vec[b].get(t, 0) for t, w in vec[a].items()) / length[a] / length[b]
                if c >= threshold - 1e-9:
                    want[a, b] = c
    got = {(r.l, r.r): r.cosine for r in cosine_join(left, right, threshold, block).collect()}
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-9 for k in got)


def test_cosine_join_edges(spark):
    df = spark.createDataFrame([(1, [5], [2.0]), (2, [], []), (3, None, None)], "id long, terms array<long>, weights array<double>")
    assert [(r.l, r.r, r.shared) for r in cosine_join(df, df, 0.5).collect()] == [(1, 1, 1)]
    assert cosine_join(df.limit(0), df, 0.5).count() == 0
    with pytest.raises(ValueError):
        cosine_join(df, df, 0)
    met = spark.createDataFrame([("f", 1, 8), ("f", 1, 9)], "field string, l long, r long")
    held = spark.createDataFrame([("f", 1, 1, "test", None), ("f", 2, 1, "test", None), ("f", 3, 3, "test", None)], "field string, id long, l long, split string, source string")
    train = spark.createDataFrame([("f", 8, 8), ("f", 9, 9), ("f", 10, 9)], "field string, id long, r long")
    assert [tuple(r) for r in overlap_counts(met, held, train).collect()] == [("f", "test", None, 2, 6)]


def test_rarity_weights_lose_no_similar_pair(spark):
    sets = family(5, n=80)
    df = spark.createDataFrame([(i, sorted(x)) for i, x in sets.items()], SHAPE)
    a, b = rarity_weights(df.where("id % 2 = 0"), df.where("id % 2 = 1"))
    got = {tuple(sorted((r.l, r.r))) for r in cosine_join(a, b, least_cosine(0.5)).collect()}
    assert {(x, y) for x, y in jaccard(sets, 0.5) if (x + y) % 2} <= got
    assert least_cosine(0.5, 1.0) == pytest.approx(2 / 3) and least_cosine(1.0) == 1


def test_all_pairs_come_from_the_trees(monkeypatch):
    """Without the dual traversal nothing is found; with it, all that brute force finds, in lists of any length."""
    rng = np.random.default_rng(4)
    base = [rng.choice(5000, 60, replace=False) for _ in range(40)]
    sets = [np.unique(np.concatenate([rng.choice(x, int(rng.integers(40, 60)), replace=False), rng.integers(0, 5000, 5)])) for x in base for _ in range(6)]
    sets.sort(key=len)
    n = np.array([len(x) for x in sets])
    tokens = np.concatenate(sets)
    owner = np.repeat(np.arange(len(n)), n)
    bits = set_lists.packed_bits(owner, mixed(tokens), n)
    # All tokens posted under 7 keys, in the order of the tokens: long lists, trees of several levels.
    pos = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
    args = (np.arange(len(n)), n, bits, owner, (tokens % 7).astype(np.int64), np.zeros_like(pos), 0.5)
    want = {(i, j) for i in range(len(n)) for j in range(i + 1, len(n)) if len(np.intersect1d(sets[i], sets[j])) >= 0.5 * len(np.union1d(sets[i], sets[j]))}
    got = {(min(a, b), max(a, b)) for x, y in near_copies.candidates(*args) for a, b in zip(x.tolist(), y.tolist())}
    assert want and want <= got and len(got) < len(n) * (len(n) - 1) // 4
    monkeypatch.setattr(near_copies.SignatureTrees, "pairs", lambda *_: iter(()))
    assert list(near_copies.candidates(*args)) == []


def test_exchange_is_bounded_whatever_the_partitions(spark, monkeypatch):
    """A set stands in as many buckets as postings and cores need, not in one for each partition; rounds move a share of them each."""
    assert set_lists.number_of_buckets(10_000, 200, 4) == 8 and set_lists.number_of_buckets(87_000_000, 200, 4) == 87
    parts = set_lists.rounds(500_000, 170_000_000, 85_000_000, 85)
    assert 1 < len(parts) < 10 and [k for a, b in parts for k in range(a, b)] == list(range(85))
    assert len(set_lists.rounds(10**9, 34 * 10**10, 17 * 10**10, 170_000)) < 16 and set_lists.rounds(0, 0, 0, 8) == [(0, 8)]
    sets = family(6)
    df = spark.createDataFrame([(i, sorted(x)) for i, x in sets.items()], SHAPE)
    monkeypatch.setattr(set_lists, "ROUND", 1_000)
    monkeypatch.setattr(set_lists, "ROUND_TOKEN", 1)
    assert {(r.id_a, r.id_b) for r in near_copy_pairs(df, 0.5).collect()} == jaccard(sets, 0.5)


def test_wide_and_narrow_bitmaps():
    rng = np.random.default_rng(7)
    sets = [np.unique(rng.integers(0, 10**6, int(k))) for k in (1, 200, 300, 700, 1500, 5000, 40_000)]
    sets += [x[: len(x) - len(x) // 9] for x in sets]
    n = np.array([len(x) for x in sets])
    bits = set_lists.packed_bits(np.repeat(np.arange(len(n)), n), mixed(np.concatenate(sets)), n)
    maps = set_lists.Bitmaps(bits, n)
    i, j = (x.ravel() for x in np.meshgrid(np.arange(len(n)), np.arange(len(n))))
    both = np.array([len(np.intersect1d(sets[a], sets[b])) for a, b in zip(i, j)])
    assert (maps.common(i, j) >= both).all() and len(bits[2]) == 1024 // 8 and (maps.common(i, j) < n[i])[both == 0].any()


def test_vectors_go_when_their_join_is_done(spark):
    import os

    from spindrel.session import shared_dir

    df = spark.createDataFrame([(1, [5, 6], [2.0, 1.0]), (2, [5], [1.0])], "id long, terms array<long>, weights array<double>")
    there = lambda: {x for x in os.listdir(f"{shared_dir(spark)}/spindrel") if x.startswith(("vectors-", "pairs-"))}
    cosine_join(df, df, 0.5)
    before = there()
    cosine_join(df, df, 0.5)
    assert there() == before
