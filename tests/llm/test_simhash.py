import numpy as np
import pytest

import brute
from tidemark.llm import simhash
from tidemark.llm.components import components, forest


def some(rng, n, words=1):
    base = rng.integers(0, 1 << 63, (20, words), dtype=np.uint64)
    out = base[rng.integers(0, 20, n)]
    for _ in range(2):
        out[np.arange(n), rng.integers(0, words, n)] ^= np.uint64(1) << rng.integers(0, 64, n).astype(np.uint64)
    return np.unique(out, axis=0)


def near(prints, radius):
    distance = np.bitwise_count(prints[:, None] ^ prints[None]).sum(axis=2)
    return {(int(i), int(j)) for i, j in np.argwhere(distance <= radius) if i < j}


def labels(links, n):
    root = list(range(n))
    for a, b in links:
        low, high = sorted((root[a], root[b]))
        root = [low if r == high else r for r in root]
    return root


@pytest.mark.parametrize("n,words", [(3, 1), (100, 1), (700, 1), (90, 4)])
@pytest.mark.parametrize("radius", [0, 1, 2, 3, 5])
def test_bit_sliced_block(n, words, radius):
    prints = some(np.random.default_rng(n), n, words)
    for q in range(min(len(prints), 40)):
        want = np.flatnonzero(np.bitwise_count(prints ^ prints[q]).sum(axis=1) <= radius)
        assert simhash.within(simhash.planes(prints), len(prints), prints[q], radius).tolist() == want.tolist()
    u, v = simhash.joined(prints, radius)
    pairs = near(prints, radius)
    found = {tuple(sorted(x)) for x in zip(u.tolist(), v.tolist(), strict=True)}
    assert found <= pairs and labels(found, len(prints)) == labels(pairs, len(prints))


def test_blocks_of_small_groups():
    rng = np.random.default_rng(9)
    prints = some(rng, 300)
    edges = np.unique(np.concatenate([[0, len(prints)], rng.integers(0, len(prints), 90)]))
    u, v = simhash.joined_small(prints, edges, 2)
    group = np.searchsorted(edges, np.arange(len(prints)), "right")
    assert set(zip(u.tolist(), v.tolist(), strict=True)) == {(a, b) for a, b in near(prints, 2) if group[a] == group[b]}


def test_confirmed_links_only():
    prints = some(np.random.default_rng(2), 200)
    u, v = simhash.joined(prints, 4, lambda q, found: found[(found + q) % 3 == 0])
    pairs = {(a, b) for a, b in near(prints, 4) if (a + b) % 3 == 0}
    assert labels(zip(u.tolist(), v.tolist(), strict=True), len(prints)) == labels(pairs, len(prints))


def test_forest():
    u, v = forest(np.array([5, 4, 9, 7]), np.array([4, 3, 8, 9]))
    assert dict(zip(u.tolist(), v.tolist(), strict=True)) == {5: 3, 4: 3, 9: 7, 8: 7}


def test_components(spark):
    rng = np.random.default_rng(5)
    a, b = rng.integers(0, 400, 300), rng.integers(0, 400, 300)
    path = list(range(1000, 1100))
    links = [*zip(a.tolist(), b.tolist(), strict=True), *zip(path, path[1:], strict=False)]
    root = {}

    def find(i):
        root.setdefault(i, i)
        while root[i] != i:
            i = root[i]
        return i

    for x, y in links:
        p, q = find(x), find(y)
        root[max(p, q)] = min(p, q)
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "u long, v long").repartition(5)).collect()}
    assert got == {i: find(i) for i in got}
    assert {x for link in links if link[0] != link[1] for x in link} <= set(got)


def test_links_join_all_near_fingerprints_with_split_groups(spark):
    rng = np.random.default_rng(6)
    base = int(rng.integers(0, 1 << 62))
    prints = {0, base} | {base ^ (1 << int(i)) ^ (1 << int(j)) for i, j in rng.integers(0, 63, (150, 2))} | {int(x) for x in rng.integers(-(1 << 62), 1 << 62, 50)}
    df = simhash.block_members(spark.createDataFrame([(x,) for x in prints], "node long"), 2)
    want = brute.linked({x: x & (1 << 64) - 1 for x in prints})
    for group in (1 << 15, 16):
        got = {r.node: r.root for r in components(simhash.links(df, None, 2, group)).collect()}
        assert {x: got.get(x, x) for x in prints} == want


ROWS = [
    (1, "a b c d e", "x"), (2, "A B c d e", "x"), (2, "A B c d e", "x"), (3, None, "y"), (4, "", None), (5, "   \n", "y"),
    (None, "a b c d e", "z"), (6, "one two", "z"), (7, "word " * 30000, "z"), (8, None, None),
]


def test_cluster_edges(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string, fingerprint string")
    found, n = simhash.cluster(df)
    assert found.columns == ["doc_id", "fingerprint", "_fingerprint", "component_id"]
    got = sorted((str(r.doc_id), r[n["component_id"]]) for r in found.collect())
    assert got == sorted([("1", 1), ("2", 1), ("2", 1), ("None", 1), ("3", 3), ("4", 3), ("5", 3), ("8", 3), ("6", 6), ("7", 7)])
    kept = simhash.keep_one(df).collect()
    assert sorted(str(r.doc_id) for r in kept) == ["1", "3", "6", "7"]
    assert kept[0].asDict().keys() == {"doc_id", "text", "fingerprint"}
    assert simhash.cluster(df.limit(0))[0].count() == 0
    assert simhash.keep_one(spark.createDataFrame([(None, "x y z"), (None, "x y z"), (None, "u v w")], "doc_id long, text string")).count() == 2
