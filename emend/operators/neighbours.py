"""Exact cosine neighbours of many queries, with cells of rows that can't hold a neighbour left unread.

Training rows go to the cell of their nearest pivot. An angle between a query and a row is at least the angle to the row's pivot less that of the row, so a cell's
least and largest angle bound all its similarities. Each query meets its nearest cell first; its kth similarity there says which other cells it has to meet.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored
from .vectors import best_of

#: Pivots at most, and rows for each pivot at least.
PIVOTS, PER_PIVOT = 256, 500
#: Rows of a block on either side of a product, and values of a row from which blocks have fewer rows. Cells share a block, as each block of one side is sent to each of the other.
QUERY_BLOCK, TRAIN_BLOCK, WIDE = 20_000, 50_000, 256
#: Queries of a block at least, where few would leave cores without a block.
LEAST_BLOCK = 500
#: Share of a block's pairs of queries and cells from which all are compared by one product.
DENSE = 0.5
#: Rows that are sent to blocks at once, copies counted: what is on disk at a time stays bounded, while the pairs to be compared may grow with the square of the table.
SENT_AT_ONCE = 4_000_000
#: Angles and similarities are taken to be this much off.
SLACK = 1e-6
#: Less than any similarity.
NONE = -2.0
#: The cell of rows without a length of one (zero vectors), which every query meets.
APART = -1
_FOUND = "query bigint, id bigint, similarity double"


@dataclass(frozen=True)
class Cells:
    """Pivots by number, and of each cell in use the least and largest angle of its rows and how many there are."""

    pivots: np.ndarray
    number: np.ndarray
    low: np.ndarray
    high: np.ndarray
    rows: np.ndarray

    def angles(self, v: np.ndarray) -> np.ndarray:
        return np.arccos(np.clip(v @ self.pivots.T, -1.0, 1.0))

    def bounds(self, v: np.ndarray) -> np.ndarray:
        """The most that a row of each cell in use can be like each vector."""
        to = self.angles(v)[:, np.maximum(self.number, 0)]
        nearest = np.maximum(np.maximum(to - self.high, self.low - to) - SLACK, 0.0)
        out = np.cos(np.minimum(nearest, np.pi)) + SLACK
        out[:, self.number == APART] = 1.0
        out[_apart(v)] = 1.0
        return out


def _apart(v: np.ndarray) -> np.ndarray:
    return np.abs(np.linalg.norm(v, axis=1) - 1.0) > SLACK


def _matrix(batch: pd.DataFrame) -> np.ndarray:
    return np.stack(batch["v"].to_numpy()).astype(float)


def _in_cells(train: DataFrame) -> tuple[DataFrame, Cells]:
    """train (id, v) with the cell of each row, stored; pivots are the rows with the smallest digests."""
    n = max(1, min(PIVOTS, -(-train.count() // PER_PIVOT)))
    chosen = train.orderBy(F.xxhash64("id"), "id").limit(n).collect()  # PIVOTS rows at most
    pivots = np.array([r["v"] for r in chosen])
    blank = np.zeros(0)

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cells = Cells(pivots, blank, blank, blank, blank)
        for b in batches:
            if len(b):
                v = _matrix(b)
                angles = cells.angles(v)
                own = angles.argmin(1)
                yield b.assign(cell=np.where(_apart(v), APART, own).astype(np.int32), angle=angles[np.arange(len(b)), own])

    dealt = stored(train.hint("rebalance").mapInPandas(assign, "id bigint, v array<double>, cell int, angle double"), "cells")
    each = dealt.groupBy("cell").agg(F.min("angle").alias("low"), F.max("angle").alias("high"), F.count("*").alias("n")).orderBy("cell").collect()  # a row for each pivot
    column = lambda c, kind: np.array([r[c] for r in each], dtype=kind)
    return dealt, Cells(pivots, column("cell", int), column("low", float), column("high", float), column("n", int))


def _groups(cells: Cells, block: int) -> np.ndarray:
    """The group of each cell in use: cells in a row of `block` rows at most, or one larger cell."""
    out, at, held = np.zeros(len(cells.number), int), 0, 0
    for i, n in enumerate(cells.rows):
        if held and held + n > block:
            at, held = at + 1, 0
        out[i], held = at, held + n
    return out


def _routes(batch: pd.DataFrame, cells: Cells, group: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Of a batch of queries (cells) each row with each group that it meets, and its cells there."""
    own = batch["cells"].to_numpy()
    flat = np.concatenate([np.asarray(c, int) for c in own]) if len(own) else np.zeros(0, int)
    if not len(flat):
        return flat, flat, []
    row, of = np.repeat(np.arange(len(own)), [len(c) for c in own]), group[np.searchsorted(cells.number, flat)]
    order = np.lexsort((of, row))
    row, of, flat = row[order], of[order], flat[order]
    start = np.flatnonzero(np.concatenate(([True], (row[1:] != row[:-1]) | (of[1:] != of[:-1]))))
    return row[start], of[start], np.split(flat, start[1:])


def _cells_top(k: int):
    """Queries (id, v, floor, cells) and rows (id, v, cell) of a group -> for each query the k best of its cells, or those that reach its floor."""

    def top(queries: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        if not len(queries) or not len(rows):
            return pd.DataFrame({"query": [], "id": [], "similarity": []}).astype({"query": "int64", "id": "int64", "similarity": "float64"})
        rows = rows.sort_values(["id", "cell"], kind="stable")
        a, b, floor = _matrix(queries), _matrix(rows), queries["floor"].to_numpy(float)
        number, cell = np.unique(rows["cell"].to_numpy(), return_inverse=True)
        asked = np.concatenate([np.asarray(c, int) for c in queries["cells"]])
        place = np.minimum(np.searchsorted(number, asked), len(number) - 1)
        here = number[place] == asked  # a large cell's block may lack some
        met = np.zeros((len(a), len(number)), bool)
        met[np.repeat(np.arange(len(a)), [len(c) for c in queries["cells"]])[here], place[here]] = True
        if met.mean() >= DENSE:  # what is found in a cell that the query need not meet, or has met, hides nothing that is among its k best
            found = best_of(a, b, k, floor)
            kept = met[found[0], cell[found[1]]]
            parts = [tuple(x[kept] for x in found)]
        else:
            parts = []
            for c in range(len(number)):
                own, of = np.flatnonzero(met[:, c]), np.flatnonzero(cell == c)
                if len(own):
                    row, column, similarity = best_of(a[own], b[of], k, floor[own])
                    parts.append((own[row], of[column], similarity))
        row, column, similarity = (np.concatenate([p[i] for p in parts] or [np.zeros(0, int)]) for i in range(3))
        return pd.DataFrame({"query": queries["id"].to_numpy(np.int64)[row], "id": rows["id"].to_numpy(np.int64)[column], "similarity": similarity.astype(float)})

    return top


def _met(routed: DataFrame, dealt: DataFrame, cells: Cells, k: int) -> DataFrame:
    """routed (id, v, cells: those that a query meets, floor: what a row must reach) against the rows of these cells, block by block: a few best for each query and block.

    Cells are met in groups, so that a query is sent once for all of its cells in a group and not once for each.
    """
    spark = routed.sparkSession
    share = min(1.0, WIDE / cells.pivots.shape[1])
    n_query, n_train = (max(1, int(n * share)) for n in (QUERY_BLOCK, TRAIN_BLOCK))
    group = _groups(cells, n_train)
    rows = np.bincount(group, cells.rows)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n = np.zeros(len(rows), int)
        for b in batches:
            n += np.bincount(_routes(b, cells, group)[1], minlength=len(rows))
        yield pd.DataFrame({"group": np.arange(len(rows)), "n": n})

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            row, of, own = _routes(b, cells, group)
            for lo in range(0, len(row), 10_000):
                at = row[lo : lo + 10_000]
                part = b.iloc[at]
                yield pd.DataFrame({"id": part["id"].to_numpy(), "v": part["v"].to_numpy(), "floor": part["floor"].to_numpy(), "group": of[lo : lo + 10_000], "cells": own[lo : lo + 10_000]})

    counted = routed.select("cells").mapInPandas(count, "group int, n bigint").groupBy("group").agg(F.sum("n").alias("n"))
    asked = {r["group"]: r["n"] for r in counted.where("n > 0").collect()}  # a row for each group
    blocks = sum(-(-n // n_query) * -(-rows[g] // n_train) for g, n in asked.items())
    n_query = max(1, min(n_query, max(LEAST_BLOCK, int(n_query * blocks / (3 * spark.sparkContext.defaultParallelism)))))
    copies = lambda turns: [(g, -(-n // (turns * n_query)), int(-(-rows[g] // n_train))) for g, n in asked.items()]
    turns = max(1, -(-int(sum(asked[g] * n_t + rows[g] * n_q for g, n_q, n_t in copies(1))) // SENT_AT_ONCE))
    sizes = F.broadcast(spark.createDataFrame(copies(turns), "group int, n_q int, n_t int"))
    block = lambda n, salt: F.pmod(F.xxhash64("id", F.lit(salt)), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    groups = F.broadcast(spark.createDataFrame([(int(c), int(g)) for c, g in zip(cells.number, group, strict=True)], "cell int, group int"))

    def found(at: int) -> DataFrame:
        """Of the queries whose turn it is."""
        own = routed.where(F.pmod(F.xxhash64("id", F.lit(3)), F.lit(turns)) == at).mapInPandas(route, "id bigint, v array<double>, floor double, group int, cells array<int>")
        q = own.join(sizes, "group").select("id", "v", "floor", "cells", "group", block("n_q", 1).alias("qb"), every("n_t").alias("tb"))
        t = dealt.join(groups, "cell").join(sizes, "group").select("id", "v", "cell", "group", block("n_t", 2).alias("tb"), every("n_q").alias("qb"))
        return q.groupBy("group", "qb", "tb").cogroup(t.groupBy("group", "qb", "tb")).applyInPandas(_cells_top(k), _FOUND)

    if not asked:
        return spark.createDataFrame([], _FOUND)
    return found(0) if turns == 1 else reduce(DataFrame.union, (stored(found(at), "met") for at in range(turns)))


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query").orderBy(F.desc("similarity"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _searched(queries: DataFrame, train: DataFrame, k: int) -> tuple[DataFrame, DataFrame, DataFrame, Cells]:
    """(rows found at home, further routes, cells of the training rows, their bounds)."""
    dealt, cells = _in_cells(train)
    enough = np.flatnonzero((cells.rows >= k) & (cells.number != APART))
    homes = enough if len(enough) else np.arange(len(cells.number))

    def home(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                at = homes[cells.bounds(_matrix(b))[:, homes].argmax(1)]
                if (cells.number[homes] != APART).all():  # of cells with equal bounds the one with the nearest pivot
                    at = homes[cells.angles(_matrix(b))[:, cells.number[homes]].argmin(1)]
                yield b.assign(cells=[[int(c)] for c in cells.number[at]], floor=NONE)

    kind = "id bigint, v array<double>, cells array<int>, floor double"
    first = stored(queries.hint("rebalance").mapInPandas(home, kind), "homes")
    near = stored(_best(_met(first, dealt, cells, k), k), "near")
    floor = near.groupBy("query").agg(F.when(F.count("*") >= k, F.min("similarity")).otherwise(F.lit(NONE)).alias("floor"))

    def further(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                open_ = cells.bounds(_matrix(b)) >= b["floor"].to_numpy()[:, None] - 1e-8
                own = np.array([c[0] for c in b["cells"]])
                open_ &= cells.number[None, :] != own[:, None]
                yield pd.DataFrame({"id": b["id"], "v": b["v"], "cells": [cells.number[o].astype(int).tolist() for o in open_], "floor": b["floor"]})

    routed = first.drop("floor").join(floor.withColumnRenamed("query", "id"), "id").mapInPandas(further, kind)
    return near, stored(routed, "routes"), dealt, cells


def pruned_cosine_top(queries: DataFrame, train: DataFrame, k: int) -> DataFrame:
    """queries (id, v), train (id, v), vectors of length one -> query, rank, id, similarity: the k most similar, ties to the smaller id.

    Zero vectors are like nothing (0) and are compared with everything. An empty side gives no rows.
    """
    if train.isEmpty() or queries.isEmpty():
        return train.sparkSession.createDataFrame([], f"{_FOUND}, rank int")
    near, routed, dealt, cells = _searched(queries, train, k)
    return _best(near.drop("rank").unionByName(_met(routed, dealt, cells, k)), k)


def compared_share(queries: DataFrame, train: DataFrame, k: int) -> float:
    """The share of all pairs that pruned_cosine_top() compares."""
    _, routed, _, cells = _searched(queries, train, k)
    size = F.create_map(*(F.lit(int(x)) for pair in zip(cells.number, cells.rows, strict=True) for x in pair))
    own = routed.select(F.aggregate("cells", F.lit(0).cast("bigint"), lambda s, c: s + F.element_at(size, c)).alias("n"))
    total = own.agg(F.sum("n").alias("n"), F.count("*").alias("queries")).first()
    homes = int(cells.rows.max()) * total["queries"]  # at most the largest cell each
    return (total["n"] + homes) / (total["queries"] * int(cells.rows.sum()))
