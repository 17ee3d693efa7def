"""Nearest neighbours and inner products against brute force."""

import numpy as np
import pandas as pd
import pytest

from emend.llm import ann, topk


def table(spark, x, ids=None):
    ids = range(len(x)) if ids is None else ids
    rows = [(int(i), [None if v is None else float(v) for v in r] if r is not None else None, "clash") for i, r in zip(ids, x, strict=True)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, v string")


def odd_rows(spark, base):
    nan, inf = float("nan"), float("inf")
    extra = spark.createDataFrame([(700, None), (800, [0.0] * 8), (900, [nan] + [1.0] * 7), (1000, [inf] + [1.0] * 7), (1100, [None] + [1.0] * 7), (1200, [1.0, 2.0]), (None, [1.0] * 8), (1300, [])], "vec_id long, embedding array<float>")
    return base.select("vec_id", "embedding").union(extra)


def brute(x, ids, k, score, highest):
    out = {}
    for q in ids[ids % 100 == 0]:
        s = score(x, x[ids == q][0])
        own = [(-v if highest else v, int(i), v) for v, i in zip(s, ids, strict=True) if i != q]
        out[int(q)] = [(i, v) for _, i, v in sorted(own)[:k]]
    return out


def results(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
    return out


def distance(x, q):
    return np.sqrt(((x - q) ** 2).sum(1))


def test_chi_square():
    assert abs(ann.chi_square_below(15.507, 8) - 0.95) < 1e-4 and abs(ann.stop_ratio(8, 0.05) - 15.507) < 1e-2


def test_tree_covers_every_point():
    x = np.random.RandomState(0).randn(500, 4)
    dims, values = ann.split_tree(x[:200], 3)
    leaf = ann.leaf_of(x, dims, values)
    assert leaf.min() >= 0 and leaf.max() < 8 and np.bincount(leaf[:200]).min() > 10
    assert sorted(np.concatenate(list(ann.boxes_of(x, np.arange(500), 16))).tolist()) == list(range(500))


def test_nearest_recall(spark):
    x = np.random.RandomState(1).randn(3000, 16).astype(np.float32).astype(float)
    x[50:80] = x[49]  # copies
    got, want = results(ann.nearest(table(spark, x))), brute(x, np.arange(3000), 10, distance, False)
    assert got.keys() == want.keys()
    hit = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hit >= 0.9 * sum(map(len, want.values()))
    for q, found in got.items():
        d = distance(x, x[q])
        assert len(found) == 10 and found == sorted(found, key=lambda p: (p[1], p[0])) and all(v == pytest.approx(d[i], rel=1e-12) for i, v in found)


def test_many_cells_recall(spark, monkeypatch):
    monkeypatch.setattr(ann, "CELL_ROWS", 800)
    x = np.random.RandomState(2).randn(3000, 12).astype(np.float32).astype(float)
    got, want = results(ann.nearest(table(spark, x))), brute(x, np.arange(3000), 10, distance, False)
    assert sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want) >= 0.9 * 10 * len(want)


def test_products_are_exact(spark, monkeypatch):
    monkeypatch.setattr(topk, "CELL_ROWS", 2000)
    rng = np.random.RandomState(3)
    x = (rng.randn(2500, 8) * rng.choice([0.5, 1, 3], (2500, 1))).astype(np.float32).astype(float)
    x[5:60] = x[4]  # ties
    x[100] = 0
    whole = np.floor(1024 * x)
    want = brute(whole, np.arange(2500), 10, lambda a, q: (a @ q).astype(int), True)
    assert results(topk.top_products(table(spark, x))) == want


def test_cover_tree():
    x = np.round(np.random.RandomState(4).randn(700, 6) * 100)
    tree = topk.CoverTree(x)
    assert sorted(np.concatenate(tree.own).tolist()) == list(range(700))

    def below(n):
        return np.concatenate([tree.own[n], *(below(c) for c in tree.children[n])])

    for n in range(len(tree.centre)):
        own = below(n).astype(int)
        assert sorted(own) == sorted(tree.below[n]) and np.sqrt(((x[own] - tree.centres[n]) ** 2).sum(1)).max() <= tree.radii[n] * (1 + 1e-9)
        centres = tree.centres[tree.children[n]]
        if len(centres) > 1:  # a net: centres are as far apart as the points below are from theirs
            apart = np.sqrt(((centres[:, None] - centres) ** 2).sum(2))[np.triu_indices(len(centres), 1)].min()
            assert apart >= tree.radii[tree.children[n]].max() * (1 - 1e-9)


def clusters(n=6000, d=64, k=80, spread=0.05, seed=0):
    rng = np.random.RandomState(seed)
    centres = rng.randn(k, d)
    return centres[rng.randint(0, k, n)] / np.sqrt(d) + rng.randn(n, d) * spread


def whole_search(x, ids, k=10):
    at = np.flatnonzero(ids % 100 == 0)
    return topk.DualSearch(topk.CoverTree(x[at], topk.QUERY_LEAF), topk.CoverTree(x), ids[at], ids, np.full(len(at), -np.inf), k)


def test_bounds_hold():
    rng = np.random.RandomState(8)
    x = np.floor(rng.randn(400, 3) * rng.choice([1, 30, 900], (400, 1)))
    x[7] = 0
    q, d = topk.CoverTree(x[:60], 2), topk.CoverTree(x)
    search = topk.DualSearch(q, d, np.empty(0, np.int64), np.arange(400), np.full(60, -np.inf), 5)
    for n in range(len(q.centre)):
        top = search.bounds(n, np.arange(len(d.centre)))
        for m in range(len(d.centre)):
            assert (x[q.below[n]] @ x[d.below[m]].T).max() <= top[m]


def test_trees_prune_on_clusters(spark):
    x = np.floor(1024 * clusters())
    ids = np.arange(len(x))
    search = whole_search(x, ids)
    share = search.compared / len(search.qids) / len(x)
    assert share < 0.2
    want = brute(x, ids, 10, lambda a, q: (a @ q).astype(int), True)
    assert {int(q): list(zip(*(c.tolist() for c in f))) for q, f in zip(search.qids, search.found, strict=True)} == want
    t = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").where("embedding is not null").collect()
    rows = sorted((r.vec_id, r.embedding) for r in t if r.embedding and len(r.embedding) == 64 and None not in r.embedding)
    y = np.floor(1024 * np.array([v for _, v in rows], float))
    even = whole_search(y, np.array([i for i, _ in rows]))
    print(f"pairs compared: {share:.1%} on clusters, {even.compared / len(even.qids) / len(y):.1%} on embeddings")
    assert even.compared < len(even.qids) * len(y)


def test_the_stopping_test_stops():
    x = clusters(seed=1)
    ids = np.arange(len(x))
    y = ann.projected(x, ann.projection(x.shape[1]))
    tree, ratio, verified, hit = ann.ProjectedTree(y), ann.stop_ratio(), 0, 0
    want = brute(x, ids, 10, distance, False)
    for q in want:
        got, _, n = ann.neighbours(tree, x, ids, x[q], y[q], q, 10, ratio)
        verified += n
        hit += len(set(got.tolist()) & {i for i, _ in want[q]})
    assert verified < 0.2 * len(want) * len(x) and hit >= 0.9 * 10 * len(want)


def test_projected_neighbours_come_in_order():
    y = np.random.RandomState(3).randn(1500, 4)
    tree = ann.ProjectedTree(y)
    parts = list(tree.in_order(y[5] + 0.1))
    dist, points = np.concatenate([d for d, _ in parts]), np.concatenate([p for _, p in parts])
    assert sorted(points.tolist()) == list(range(1500)) and (np.diff(dist) >= 0).all()


def test_many_copies_of_one_vector(spark):
    rng = np.random.RandomState(6)
    x = rng.randn(1200, 8)
    x[rng.permutation(1200)[:500]] = x[0]
    want = brute(x, np.arange(1200), 10, distance, False)
    got = results(ann.nearest(table(spark, x)))
    assert got.keys() == want.keys() and all([i for i, _ in got[q]] == [i for i, _ in want[q]] for q in want if (x[q] == x[0]).all())


def test_large_numbers_stay_exact():
    a = np.array([[2.0**40, 3.0]])
    assert topk.products(a, np.array([[2.0**20, 1.0]]))[0, 0] == 2**60 + 3


@pytest.mark.parametrize("search", [ann.nearest, topk.top_products])
def test_odd_vectors(spark, search):
    x = np.random.RandomState(5).randn(120, 8)
    got = results(search(odd_rows(spark, table(spark, x))))
    zero = {800} if search is topk.top_products else set()
    assert set(got) == {0, 100} | zero and all(len(v) == 10 for v in got.values())
    few = results(search(table(spark, x[:4], [0, 1, 2, 3])))
    assert len(few[0]) == 3
    assert search(table(spark, x).limit(0)).count() == 0
    twice = table(spark, x[[0, 0, 1, 1]], [0, 0, 1, 1])
    assert [i for i, _ in results(search(twice))[0]] == [1, 1]
    assert results(search(table(spark, x[:1], [0]))) == {}


def test_empty_parts():
    none = pd.DataFrame({"vec_id": [], "v": [], "y": [], "reach": [], "floor": []})
    assert len(ann._search(none, none, 10, 9.0)) == 0 and len(topk._search(none, none, 10)) == 0
