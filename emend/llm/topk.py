"""Exact top-k by inner product: dual-tree search over cover trees.

Queries and data are indexed together: centres that cover a bounded sample are the top level of the tree, each vector lies under the nearest, and below it the
cell's task builds cover trees of the cell's data and of the queries that come. Two bounds hold for a query node (centre a, radius r, largest
norm A) and a data node (centre b, radius s, largest norm B): the inner product is at most <a, b> + r|b| + s|a| + r s, and, as the radii bound
angles too, at most A B cos(angle of a and b less both angles), or 0 if that is negative. A pair of nodes is left out if the lesser one is below the
worst kth score of the node's queries. Every query meets its own cell first; its kth score then rules out other cells.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable
from .vectors import CELL_ROWS, best, cells_for, matrix, meet, queries_of, sample, valid

#: Points up to which a node of data, or of queries, is not divided; children of a node at most; points that are compared between two looks at the kth scores.
LEAF, QUERY_LEAF, CHILDREN, CHUNK = 24, 1, 24, 512
#: Cells at most: the greedy choice of their centres is quadratic.
MOST_CENTRES = 1_024


class CoverTree:
    """Nodes as arrays: centre (a point), radius, largest norm, largest angle to the centre, children, points of leaves.

    The children of a node are a net of its points: each centre is the point farthest from those before, the node's own centre first, until they cover all
    points within half the node's radius or there are CHILDREN of them. Centres are then at least as far apart as the points are from the nearest,
    and every point lies under that one. A node's radius is the distance of its farthest point, so single points have radius 0.
    """

    def __init__(self, points: np.ndarray, leaf: int = LEAF):
        self.points, self.leaf = points, leaf
        self.norm = np.sqrt((points**2).sum(1)) if len(points) else np.empty(0)
        self.centre: list[int] = []
        self.radius: list[float] = []
        self.children: list[np.ndarray] = []
        self.own: list[np.ndarray] = []
        self.below: list[np.ndarray] = []
        if len(points):
            middle = int(((points - points.mean(0)) ** 2).sum(1).argmin())
            self._node(np.arange(len(points)), middle, np.sqrt(((points - points[middle]) ** 2).sum(1)))
        self.centres, self.radii = points[self.centre], np.array(self.radius)
        self.norms = self.norm[self.centre]
        self.most = np.array([self.norm[b].max() for b in self.below])
        self.angles = np.array([self._angle(n) for n in range(len(self.centre))])

    def _angle(self, n: int) -> float:
        """The largest angle between the centre and a point below; a half turn where one has no direction."""
        own = self.below[n]
        if self.norms[n] == 0 or self.norm[own].min() == 0:
            return np.pi
        cos = self.points[own] @ self.centres[n] / (self.norm[own] * self.norms[n])
        return float(np.arccos(np.clip(cos.min(), -1, 1))) + 1e-7

    def _node(self, own: np.ndarray, centre: int, dist: np.ndarray) -> int:
        me, radius = len(self.centre), float(dist.max())
        self.centre.append(centre), self.radius.append(radius * (1 + 1e-12)), self.children.append(np.empty(0, np.int64)), self.own.append(own), self.below.append(own)
        if len(own) <= self.leaf or radius == 0:
            return me
        nearest, to, centres = np.zeros(len(own), np.int64), dist.copy(), [centre]
        while len(centres) < CHILDREN and to.max() > radius / 2:
            new = int(own[to.argmax()])
            d = np.sqrt(((self.points[own] - self.points[new]) ** 2).sum(1))
            nearer = d < to
            nearest[nearer], to[nearer] = len(centres), d[nearer]
            centres.append(new)
        self.children[me] = np.array([self._node(own[at], c, to[at]) for k, c in enumerate(centres) if (at := nearest == k).any()])
        self.own[me] = np.empty(0, np.int64)
        return me


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of whole numbers, exact: as doubles where these hold them, else as 64-bit integers."""
    if a.shape[1] * float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) < 2.0**53:
        return (a @ b.T).astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64).T


class DualSearch:
    """Queries' k best among the data. `compared` counts the pairs whose product was taken."""

    def __init__(self, queries: CoverTree, data: CoverTree, qids: np.ndarray, ids: np.ndarray, floor: np.ndarray, k: int):
        self.q, self.d, self.qids, self.ids, self.k = queries, data, qids, ids, k
        self.floor = floor  # a score that the query's kth is known to reach
        self.found = [(np.empty(0, np.int64), np.empty(0, np.int64)) for _ in qids]
        self.compared = 0
        if len(qids) and len(ids):
            self.visit(0, np.array([0]))

    def bounds(self, node: int, others: np.ndarray) -> np.ndarray:
        """No inner product of points below the query node and the data nodes is larger."""
        q, d = self.q, self.d
        r, s = q.radii[node], d.radii[others]
        inner = d.centres[others] @ q.centres[node]
        ball = inner + r * d.norms[others] + s * q.norms[node] + r * s
        length = d.norms[others] * q.norms[node]
        apart = np.arccos(np.clip(inner / np.where(length > 0, length, 1), -1, 1)) - q.angles[node] - d.angles[others]
        cone = q.most[node] * d.most[others] * np.where(length > 0, np.maximum(np.cos(np.clip(apart, 0, np.pi)), 0), 1)
        top = np.minimum(ball, cone)
        return top + 1e-9 * np.abs(ball) + 1e-6

    def visit(self, node: int, frontier: np.ndarray) -> None:
        q, d = self.q, self.d
        top = self.bounds(node, frontier)
        ok = top >= self.floor[q.below[node]].min()
        frontier, top = frontier[ok], top[ok]
        if not len(frontier):
            return
        if len(q.children[node]):
            frontier = np.concatenate([d.children[f] if len(d.children[f]) else [f] for f in frontier])
            for c in q.children[node]:
                self.visit(c, frontier)
            return
        own, seen = q.own[node], -1
        if not np.isfinite(self.floor[own]).all():  # first down to the best leaf, so that there are scores to prune by
            seen = int(frontier[top.argmax()])
            while len(kids := d.children[seen]):
                seen = int(kids[self.bounds(node, kids).argmax()])
            self.compare(node, d.own[seen])
        leaves, tops = [], []
        while len(frontier):
            ok = top >= self.floor[own].min()
            frontier, top = frontier[ok], top[ok]
            leaf = np.array([not len(d.children[f]) for f in frontier], bool)
            leaves.append(frontier[leaf]), tops.append(top[leaf])
            frontier = np.concatenate([d.children[f] for f in frontier[~leaf]]) if not leaf.all() else frontier[:0]
            top = self.bounds(node, frontier)
        leaves, tops = np.concatenate(leaves), np.concatenate(tops)
        order = np.argsort(-tops, kind="stable")
        order = order[leaves[order] != seen]
        leaves, tops, at = leaves[order], tops[order], 0
        part = np.cumsum([len(d.own[f]) for f in leaves]) // CHUNK
        while at < len(leaves) and tops[at] >= self.floor[own].min():
            upto = int(np.searchsorted(part, part[at], "right"))
            upto = at + int(np.searchsorted(-tops[at:upto], -self.floor[own].min(), "right"))
            self.compare(node, np.concatenate([d.own[f] for f in leaves[at:upto]]))
            at = upto

    def compare(self, node: int, points: np.ndarray) -> None:
        own = self.q.own[node]
        if self.q.radii[node] > 0:  # a single point is a data node of radius 0
            top = self.d.points[points] @ self.q.centres[node] + self.q.radii[node] * self.d.norm[points]
            points = points[top + 1e-9 * np.abs(top) + 1e-6 >= self.floor[own].min()]
        self.compared += len(own) * len(points)
        scores = products(self.q.points[own], self.d.points[points])
        for i, row in zip(own, scores, strict=True):
            ok = (row >= self.floor[i]) & (self.ids[points] != self.qids[i])
            if not ok.any():
                continue
            ids, got = np.concatenate((self.found[i][0], self.ids[points][ok])), np.concatenate((self.found[i][1], row[ok]))
            keep = np.lexsort((ids, -got))[: self.k]
            self.found[i] = ids[keep], got[keep]
            if len(keep) == self.k:
                self.floor[i] = max(self.floor[i], float(got[keep[-1]]))


def _search(asked: pd.DataFrame, rows: pd.DataFrame, k: int) -> pd.DataFrame:
    out = {"query_id": [], "vec_id": [], "score": []}
    if len(asked) and len(rows):
        q, d = CoverTree(matrix(asked["v"]), QUERY_LEAF), CoverTree(matrix(rows["v"]))
        qids = asked["vec_id"].to_numpy(np.int64)
        dual = DualSearch(q, d, qids, rows["vec_id"].to_numpy(np.int64), asked["floor"].to_numpy(np.float64).copy(), k)
        for i, (ids, scores) in enumerate(dual.found):
            out["query_id"].append(np.full(len(ids), qids[i])), out["vec_id"].append(ids), out["score"].append(scores)
    return pd.DataFrame({c: np.concatenate(v) if v else np.empty(0, np.int64) for c, v in out.items()}, dtype=np.int64)


def cover_centres(points: np.ndarray, most: int) -> np.ndarray:
    """Centres that cover the points with the least radius that greedy choice of the farthest point reaches."""
    chosen = [0]
    to = ((points - points[0]) ** 2).sum(1)
    while len(chosen) < most and to.max() > 0:
        chosen.append(int(to.argmax()))
        to = np.minimum(to, ((points - points[chosen[-1]]) ** 2).sum(1))
    return points[chosen]


_FOUND = "query_id bigint, vec_id bigint, score bigint"
_NONE = float("-inf")


def top_products(vectors: DataFrame, k: int = 10, every: int = 100, scale: int = 1024) -> DataFrame:
    """vectors (vec_id, embedding, ...) -> query_id, rank, vec_id, score: for each row whose vec_id is divisible by `every` the k others of highest
    inner product, components as floor(scale * x).

    Rows that take no part: see vectors.valid(); zero vectors do. Fewer than k others: all. Equal scores: smaller vec_id first. Repeated rows are
    each a candidate, one query; a row never finds its own id. An empty table gives an empty result. Other columns don't matter.
    """
    spark = vectors.sparkSession
    own = valid(vectors, zero=True).withColumn("v", F.transform("v", lambda x: F.floor(x * scale).cast("double")))
    if not (n := own.count()):
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")
    cells_ = min(MOST_CENTRES, cells_for(n, CELL_ROWS // 4))
    centres = cover_centres(sample(own, cells_, n), cells_)
    length = (centres**2).sum(1)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            x = matrix(rows["v"]) if len(rows) else np.empty((0, centres.shape[1]))
            near = np.argmin(length - 2 * x @ centres.T, axis=1) if len(rows) else np.empty(0)
            yield rows.assign(cell=near.astype(np.int32), away=np.sqrt(((x - centres[near.astype(int)]) ** 2).sum(1)))

    cells = durable(own.mapInPandas(place, "vec_id bigint, v array<double>, cell int, away double"), "cells")
    radius = {r["cell"]: r["away"] for r in cells.groupBy("cell").agg(F.max("away").alias("away")).collect()}  # a row for each cell
    names = np.array(sorted(radius), np.int32)
    radii, at = np.array([radius[c] for c in names]), centres[names]

    queries = durable(queries_of(cells, every), "queries")
    search = lambda asked, rows: _search(asked, rows, k)
    first = durable(meet(queries.withColumn("floor", F.lit(_NONE)), cells, search, _FOUND), "first")
    kth = best(first, k, True).groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score").cast("double")).otherwise(_NONE).alias("floor"))

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            if not len(rows):
                continue
            x, floor, home = matrix(rows["v"]), rows["floor"].to_numpy(), rows["cell"].to_numpy()
            top = x @ at.T + np.sqrt((x**2).sum(1))[:, None] * radii  # a query is a node of radius 0 here
            i, j = np.nonzero((top + 1e-9 * np.abs(top) + 1e-6 >= floor[:, None]) & (names != home[:, None]))
            out = rows.iloc[i].reset_index(drop=True)
            out["cell"] = names[j]
            yield out

    asked = queries.join(kth.withColumnRenamed("query_id", "vec_id"), "vec_id", "left").na.fill({"floor": _NONE})
    asked = durable(asked.select("vec_id", "v", "cell", "floor").mapInPandas(route, "vec_id bigint, v array<double>, cell int, floor double"), "routed")
    return best(first.union(meet(asked, cells, search, _FOUND)), k, True)


def op6_top_products(spark, sf_dir: str) -> DataFrame:
    from .common import table

    return top_products(table(spark, sf_dir, "embeddings"))


OP6_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM pairs)
SELECT query_id, r::INTEGER AS rank, vec_id, score FROM ranked WHERE r <= 10
"""
