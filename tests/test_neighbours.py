"""Pruned neighbours, components by block passes, ranges by jumps: each against its plain form."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from emend.operators import lowrank, neighbours, retrieval, vectors


def frame(spark, x, name="vec"):
    return spark.createDataFrame([(i, [float(c) for c in r]) for i, r in enumerate(x)], f"id long, {name} array<double>")


def clustered(n, groups, d=16, seed=0, spread=0.05):
    r = np.random.RandomState(seed)
    return r.standard_normal((groups, d))[r.randint(groups, size=n)] + spread * r.standard_normal((n, d))


def plain_top(a, b, k):
    unit = lambda x: x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    likeness = np.round(unit(a) @ unit(b).T, 9) + 0.0
    return [np.lexsort((np.arange(len(b)), -row))[:k].tolist() for row in likeness]


@pytest.mark.parametrize("x", [np.random.RandomState(1).standard_normal((150, 8)), clustered(300, 12), np.vstack([np.zeros((2, 6)), np.ones((40, 6)), np.random.RandomState(3).standard_normal((60, 6))])])
def test_pruned_neighbours_are_exact(spark, monkeypatch, x):
    monkeypatch.setattr(vectors, "QUERY_BLOCK", 10)
    monkeypatch.setattr(neighbours, "PER_PIVOT", 12)
    monkeypatch.setattr(neighbours, "QUERY_BLOCK", 30)
    monkeypatch.setattr(neighbours, "TRAIN_BLOCK", 16)
    rows = frame(spark, x)
    found = {}
    for r in vectors.cosine_top(rows, rows, 4).collect():
        found.setdefault(r["query"], {})[r["rank"]] = r["id"]
    assert [[found[q][n] for n in (1, 2, 3, 4)] for q in range(len(x))] == plain_top(x, x, 4)


def test_few_rows_and_empty_sides(spark, monkeypatch):
    monkeypatch.setattr(vectors, "QUERY_BLOCK", 1)
    rows = frame(spark, np.eye(3))
    assert vectors.cosine_top(rows, rows, 5).count() == 9
    assert vectors.cosine_top(rows, rows.limit(0), 5).count() == 0


def test_cells_without_a_neighbour_are_left_out(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "PER_PIVOT", 10)
    rows = frame(spark, clustered(600, 20, seed=4)).select("id", vectors.unit(F.col("vec")).alias("v"))
    assert neighbours.compared_share(rows, rows, 3) < 0.35


@pytest.mark.parametrize("shape", [(300, 20), (40, 700), (5, 9)])
def test_leading_components_agree_with_the_whole_matrix(spark, monkeypatch, shape):
    x = np.random.RandomState(5).standard_normal(shape) * np.linspace(3, 1, shape[1]) + 2
    got = lowrank.leading(frame(spark, x), 3)
    centred = x - x.mean(0)
    _, size, want = np.linalg.svd(centred, full_matrices=False)
    assert np.allclose(np.abs((got.rows * want[:3]).sum(1)), 1, atol=1e-9)
    assert np.allclose(got.explained, size[:3] ** 2 / (size**2).sum()) and np.allclose(got.rows @ got.rows.T, np.eye(3))
    if shape[1] > vectors.WIDE:
        assert np.allclose(vectors.principal(frame(spark, x), 3).rows, got.rows)


def test_blocks_that_are_held_stay_few(spark, monkeypatch):
    monkeypatch.setattr(lowrank, "BLOCKS", 3)
    monkeypatch.setattr(lowrank, "BEYOND", 2)
    x = np.random.RandomState(6).standard_normal((200, 60)) * np.linspace(2, 1, 60)
    want = np.linalg.svd(x - x.mean(0), full_matrices=False)[2][:2]
    assert np.allclose(np.abs((lowrank.leading(frame(spark, x), 2).rows * want).sum(1)), 1, atol=1e-6)


def test_rows_of_less_rank_than_asked(spark):
    x = np.outer(np.arange(10.0), [1, 2, 0, 0])
    got = lowrank.leading(frame(spark, x), 3)
    assert len(got.rows) == 1 and np.allclose(got.rows[0], np.array([1, 2, 0, 0]) / 5**0.5) and np.allclose(got.explained, 1)


def plain_ranges(weights, shards):
    n, shards, out, start = len(weights), max(1, min(shards, len(weights))), [], 0
    share = max(1, -(-sum(weights) // shards))
    while len(out) < shards - 1:
        total, at = 0, start
        while at < n and (total := total + weights[at]) < share:
            at += 1
        if at + 1 >= n or n - at - 1 < shards - len(out) - 1:
            break
        out.append((len(out), start, at + 1))
        start = at + 1
    return [*out, (len(out), start, n)]


@pytest.mark.parametrize("shards", [1, 2, 3, 8, 33, 100])
def test_ranges_by_jumps(spark, monkeypatch, shards):
    weights = np.random.RandomState(shards).randint(0, 9, size=90).tolist()
    rows = spark.createDataFrame(list(enumerate(weights)), "idx long, weight long")
    got = [tuple(r) for r in retrieval.balanced_ranges(rows, shards).orderBy("shard").collect()]
    assert got == plain_ranges(weights, shards)


def test_blocks_in_turns(spark, monkeypatch):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(300, 8))
    v /= np.linalg.norm(v, axis=1)[:, None]
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, v array<double>").cache()
    top = lambda: sorted((r.query, r["rank"], r.id, r.similarity) for r in neighbours.pruned_cosine_top(rows, rows, 3).collect())
    monkeypatch.setattr(neighbours, "QUERY_BLOCK", 50)
    want = top()
    kept, real = [], neighbours.stored
    monkeypatch.setattr(neighbours, "stored", lambda df, label: kept.append(label) or real(df, label))
    monkeypatch.setattr(neighbours, "SENT_AT_ONCE", 1_000)
    got = top()
    assert [r[:3] for r in got] == [r[:3] for r in want] and len(got) == 900
    assert kept.count("met") > 2


def test_a_query_is_sent_once_for_all_cells_of_a_group(spark, monkeypatch):
    """Sent once for each of 256 cells, the copies of vectors that can't be pruned were most of the work."""
    monkeypatch.setattr(neighbours, "PER_PIVOT", 5)
    cells = neighbours.Cells(np.eye(8), np.arange(8), *(np.zeros(8),) * 2, np.full(8, 5))
    assert len(set(neighbours._groups(cells, 20))) == 2 and len(set(neighbours._groups(cells, 50_000))) == 1
    batch = pd.DataFrame({"cells": [[0, 1, 7], [], [5]]})
    row, of, own = neighbours._routes(batch, cells, neighbours._groups(cells, 20))
    assert list(zip(row.tolist(), of.tolist(), [x.tolist() for x in own], strict=True)) == [(0, 0, [0, 1]), (0, 1, [7]), (2, 1, [5])]


@pytest.mark.parametrize("k", [1, 3, 50])
def test_candidates_in_single_precision_lose_nothing(k):
    r = np.random.RandomState(k)
    b = np.round(r.standard_normal((3000, 8)), 1)
    b[:400] = b[400:800]  # ties
    b[5] = 0
    b /= np.maximum(np.linalg.norm(b, axis=1), 1e-12)[:, None]
    a = b[:300]
    row, column, similarity = vectors.best_of(a, b, k)
    assert column.reshape(300, k).tolist() == plain_top(a, b, k)
    assert np.allclose(similarity, (a[row] * b[column]).sum(1))
    floor = similarity.reshape(300, k)[:, -1]
    assert [x.tolist() for x in vectors.best_of(a, b, k, floor)[:2]] == [row.tolist(), column.tolist()]


def test_the_length_of_a_vector_is_computed_once(spark):
    """Named in the lambda, it was computed for each value: quadratic in the dimensions."""
    rows = frame(spark, np.vstack([np.random.RandomState(2).standard_normal((5, 6)), np.zeros((1, 6))])).union(spark.createDataFrame([(9, None)], "id long, vec array<double>"))
    out = rows.select("id", vectors.unit(F.col("vec")).alias("v"))
    for r in out.collect():
        own = next(x["vec"] for x in rows.collect() if x["id"] == r["id"])
        assert r["v"] is None if own is None else np.allclose(r["v"], np.array(own) / max(np.linalg.norm(own), 1e-12))
    assert "array(greatest(" in out._jdf.queryExecution().optimizedPlan().toString().lower()
