"""Approximate nearest neighbours: Gaussian (2-stable) projections to few dimensions, indexed by a kd-tree.

The squared projected distance of two vectors over their squared distance follows a chi-square law with as many degrees of freedom as there are
projected dimensions. The tree gives a query its projected neighbours in order, and each is verified by its true distance; the search
stops when the next one is so far that a vector nearer than the kth found would be projected there with a small probability only.

The upper levels of the tree, placed by a bounded sample, are the cells in which all vectors are stored; the lower levels are built in the cell's task.
A query is first searched in its own cell; its kth distance then says which other cells the test can't rule out.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, exp, log2

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable
from .vectors import CELL_ROWS, best, cells_for, matrix, meet, queries_of, sample, valid

#: Projected dimensions (even), vectors in a box of the tree, and the probability that the test leaves for missing one.
DIMENSIONS, BOX, MISS = 16, 64, 0.06
#: Projected neighbours that are verified between two tests.
STEP = 32


def chi_square_below(x: float, m: int) -> float:
    """Probability that a chi-square number of m (even) degrees of freedom is at most x."""
    term, total = 1.0, 1.0
    for i in range(1, m // 2):
        term *= x / 2 / i
        total += term
    return 1 - exp(-x / 2) * total


def stop_ratio(m: int = DIMENSIONS, miss: float = MISS) -> float:
    """Squared projected over squared true distance that a vector exceeds with probability `miss`."""
    low, high = 0.0, 20.0 * m
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if chi_square_below(mid, m) < 1 - miss else (low, mid)
    return high


def projected(x: np.ndarray, project: np.ndarray) -> np.ndarray:
    """Rounded, so that equal vectors are projected alike whatever block they come in."""
    return np.round(x @ project, 9)


def slack(p: np.ndarray) -> float:
    """What rounding may add to a squared projected distance."""
    return 1e-7 * (1 + float((p * p).sum()) ** 0.5)


def projection(d: int, m: int = DIMENSIONS, seed: int = 5) -> np.ndarray:
    return np.random.RandomState(seed).standard_normal((d, m))


def split_tree(points: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The widest dimension and its median for each inner node, in heap order."""
    dims, values = np.zeros((1 << depth) - 1, np.int64), np.zeros((1 << depth) - 1)
    parts = [points]
    for level in range(depth):
        nxt = []
        for k, p in enumerate(parts):
            node = (1 << level) - 1 + k
            if len(p):
                dims[node] = int(np.argmax(np.ptp(p, axis=0)))
                values[node] = float(np.median(p[:, dims[node]]))
            right = p[:, dims[node]] > values[node]
            nxt += [p[~right], p[right]]
        parts = nxt
    return dims, values


def leaf_of(points: np.ndarray, dims: np.ndarray, values: np.ndarray) -> np.ndarray:
    node = np.zeros(len(points), np.int64)
    for _ in range(int(log2(len(dims) + 1))):
        node = 2 * node + 1 + (points[np.arange(len(points)), dims[node]] > values[node])
    return node - len(dims)


def boxes_of(points: np.ndarray, order: np.ndarray, size: int = BOX) -> Iterator[np.ndarray]:
    """The points of each box of a kd-tree over points[order]."""
    stack = [order]
    while stack:
        own = stack.pop()
        if len(own) <= size:
            yield own
            continue
        values = points[own][:, int(np.argmax(np.ptp(points[own], axis=0)))]
        half = np.argpartition(values, len(own) // 2)
        stack += [own[half[: len(own) // 2]], own[half[len(own) // 2 :]]]


def gaps(q: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Squared distance of q to each box."""
    off = np.maximum(np.maximum(low - q, q - high), 0)
    return (off * off).sum(1)


class ProjectedTree:
    """The boxes of a kd-tree over projected points."""

    def __init__(self, y: np.ndarray):
        self.y, self.boxes = y, list(boxes_of(y, np.arange(len(y))))
        self.low, self.high = (np.array([f(y[b], axis=0) for b in self.boxes]) for f in (np.min, np.max))

    def in_order(self, p: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(squared projected distances, points) by rising distance, a part at a time: all that lie before the next box that isn't open."""
        near = gaps(p, self.low, self.high)
        order = np.argsort(near, kind="stable")
        points, dist, at, step = np.empty(0, np.int64), np.empty(0), 0, 2
        while at < len(order):
            own = np.concatenate([self.boxes[b] for b in order[at : at + step]])
            at, step = at + step, 2 * step
            points, dist = np.concatenate((points, own)), np.concatenate((dist, ((self.y[own] - p) ** 2).sum(1)))
            ready = dist <= (near[order[at]] if at < len(order) else np.inf)
            rank = np.argsort(dist[ready], kind="stable")
            yield dist[ready][rank], points[ready][rank]
            points, dist = points[~ready], dist[~ready]


def neighbours(tree: ProjectedTree, x: np.ndarray, ids: np.ndarray, q: np.ndarray, p: np.ndarray, own_id: int, k: int, ratio: float, reach: float = np.inf) -> tuple[np.ndarray, np.ndarray, int]:
    """(ids, distances) of the k nearest found, nearest first, and how many vectors were verified. reach: a kth distance that is known already."""
    got, dist, kth, verified, more = np.empty(0, np.int64), np.empty(0), reach, 0, slack(p)
    for far, points in tree.in_order(p):
        for at in range(0, len(points), STEP):
            if far[at] > ratio * kth * kth + more:
                return got, dist, verified
            own = points[at : at + STEP]
            own = own[ids[own] != own_id]
            verified += len(own)
            got, dist = np.concatenate((got, ids[own])), np.concatenate((dist, np.sqrt(((x[own] - q) ** 2).sum(1))))
            keep = np.lexsort((got, dist))[:k]
            got, dist = got[keep], dist[keep]
            if len(got) == k:
                kth = min(reach, float(dist[-1]))
    return got, dist, verified


def _search(asked: pd.DataFrame, rows: pd.DataFrame, k: int, ratio: float) -> pd.DataFrame:
    out = {"query_id": [], "vec_id": [], "score": []}
    if len(asked) and len(rows):
        ids, x, tree = rows["vec_id"].to_numpy(np.int64), matrix(rows["v"]), ProjectedTree(matrix(rows["y"]))
        for qid, q, p, reach in zip(asked["vec_id"], asked["v"], asked["y"], asked["reach"], strict=True):
            got, dist, _ = neighbours(tree, x, ids, q, p, qid, k, ratio, reach)
            out["query_id"].append(np.full(len(got), qid)), out["vec_id"].append(got), out["score"].append(dist)
    return pd.DataFrame({c: np.concatenate(v) if v else np.empty(0, np.float64 if c == "score" else np.int64) for c, v in out.items()})


_FOUND = "query_id bigint, vec_id bigint, score double"


def nearest(vectors: DataFrame, k: int = 10, every: int = 100, dimensions: int = DIMENSIONS, miss: float = MISS) -> DataFrame:
    """vectors (vec_id, embedding, ...) -> query_id, rank, vec_id, score: for each row whose vec_id is divisible by `every` its k nearest others found.

    Rows that take no part: see vectors.valid(); zero vectors too. Fewer than k others: all. Equal distances: smaller vec_id first. Repeated rows are
    each a candidate, one query; a row never finds its own id. An empty table gives an empty result. Other columns don't matter.
    """
    spark = vectors.sparkSession
    own = valid(vectors, zero=False)
    if not (n := own.count()):
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    cells_ = cells_for(n, CELL_ROWS // 4)
    some = sample(own, cells_, n)
    project, ratio, depth = projection(some.shape[1], dimensions), stop_ratio(dimensions, miss), ceil(log2(cells_))
    dims, values = split_tree(projected(some, project), depth)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            y = projected(matrix(rows["v"]), project) if len(rows) else np.empty((0, dimensions))
            yield rows.assign(cell=leaf_of(y, dims, values).astype(np.int32), y=list(y))

    cells = durable(own.mapInPandas(place, "vec_id bigint, v array<double>, cell int, y array<double>"), "cells")
    edges = [f(F.col("y")[i]).alias(f"{name}{i}") for name, f in (("low", F.min), ("high", F.max)) for i in range(dimensions)]
    found = cells.groupBy("cell").agg(*edges).orderBy("cell").collect()  # a row for each cell
    names = np.array([r["cell"] for r in found], np.int32)
    low, high = (np.array([[r[f"{x}{i}"] for i in range(dimensions)] for r in found]) for x in ("low", "high"))

    queries = durable(queries_of(cells, every), "queries")
    search = lambda asked, rows: _search(asked, rows, k, ratio)
    first = durable(meet(queries.withColumn("reach", F.lit(float("inf"))), cells, search, _FOUND), "first")
    kth = best(first, k, False).groupBy("query_id").agg(F.when(F.count("*") >= k, F.max("score")).otherwise(float("inf")).alias("reach"))

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            parts = []
            for i, (p, reach, own_cell) in enumerate(zip(rows["y"], rows["reach"], rows["cell"], strict=True)):
                to = names[(gaps(p, low, high) <= ratio * reach * reach + slack(p)) & (names != own_cell)]
                parts.append(pd.DataFrame({"i": i, "to": to}))
            if parts:
                to = pd.concat(parts)
                out = rows.iloc[to["i"].to_numpy(int)].reset_index(drop=True)
                out["cell"] = to["to"].to_numpy(np.int32)
                yield out

    asked = queries.join(kth.withColumnRenamed("query_id", "vec_id"), "vec_id", "left").na.fill({"reach": float("inf")})
    asked = durable(asked.select("vec_id", "v", "cell", "y", "reach").mapInPandas(route, "vec_id bigint, v array<double>, cell int, y array<double>, reach double"), "routed")
    return best(first.union(meet(asked, cells, search, _FOUND)), k, False)


def op4_nearest(spark, sf_dir: str) -> DataFrame:
    from .common import table

    return nearest(table(spark, sf_dir, "embeddings"))
