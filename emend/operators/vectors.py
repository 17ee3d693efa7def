"""Linear algebra over columns of arrays: pooling, scaling, principal components, directions, cosine neighbours."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The most queries that go to all tasks.
QUERY_BLOCK = 2_000
#: Dimensions up to which tasks sum the whole matrix of second moments.
WIDE = 512


# --- columns ------------------------------------------------------------------


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Column) -> Column:
    """Divided by its length, or by 1e-12 if that is less."""
    n = F.greatest(norm(a), F.lit(1e-12))
    return F.get(F.transform(F.array(n), lambda n: F.transform(a, lambda x: x.cast("double") / n)), F.lit(0))  # so bound, the length is computed once, not for each value


def minus(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x.cast("double") - y.cast("double"))


def plus(a: Column, b: Column, factor: float = 1.0) -> Column:
    """A steering vector added: a + factor * b."""
    return F.zip_with(a, b, lambda x, y: x.cast("double") + factor * y.cast("double"))


def plus_by_sign(a: Column, b: Column) -> Column:
    """A steering vector added on the side on which a lies."""
    side = F.signum(dot(a, b))
    return F.zip_with(a, b, lambda x, y: x.cast("double") + side * y.cast("double"))


def array_of(values: np.ndarray) -> Column:
    return F.array(*(F.lit(float(v)) for v in values))


def projected(a: Column, direction: Column) -> Column:
    """Length of a along a direction."""
    return dot(a, direction) / norm(direction)


# --- pooling ------------------------------------------------------------------


def mean_vectors(rows: DataFrame, keys: list[str], vector: str = "vec", firsts: tuple[str, ...] = (), order: str | None = None) -> DataFrame:
    """Mean of the vectors of a group, and of some columns the value of its first row; summed partially before the shuffle."""
    v = array_to_vector(F.transform(vector, lambda x: x.cast("double")))
    first = [F.min_by(c, order).alias(c) for c in firsts]
    return rows.groupBy(*keys).agg(vector_to_array(Summarizer.mean(v)).alias(vector), F.count("*").alias("n"), *first)


@dataclass(frozen=True)
class Moments:
    n: int
    mean: np.ndarray
    deviation: np.ndarray  # of the population


def moments(rows: DataFrame, vector: str = "vec") -> Moments:
    """One row goes to the driver."""
    v = array_to_vector(F.transform(vector, lambda x: x.cast("double")))
    s = rows.select(Summarizer.metrics("count", "mean", "variance").summary(v).alias("s")).select("s.count", "s.mean", "s.variance").first()
    n = s["count"]
    return Moments(n, s["mean"].toArray(), np.sqrt(s["variance"].toArray() * (n - 1) / max(n, 1)))


def scaled(vector: Column, m: Moments) -> Column:
    """Less the mean, over the population deviation; a column that doesn't vary is only centred."""
    by = np.where(m.deviation > 0, m.deviation, 1.0)
    return F.zip_with(minus(vector, array_of(m.mean)), array_of(by), lambda x, d: x / d)


@dataclass(frozen=True)
class Components:
    mean: np.ndarray
    rows: np.ndarray  # components x dimensions
    explained: np.ndarray


def principal(rows: DataFrame, k: int, vector: str = "vec") -> Components:
    """Principal components from the matrix of second moments, which tasks sum over their rows: the driver gets d rows of d numbers. Vectors of over
    WIDE numbers are multiplied block by block instead, so that no task holds d x d numbers.

    Signs: the largest entry of a component is positive.
    """
    first = rows.select(F.size(vector).alias("d")).first()
    if first is not None and first["d"] > WIDE:
        from .lowrank import leading

        return leading(rows, k, vector)

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for b in batches:
            if len(b):
                x = np.stack(b[vector].to_numpy()).astype(float)
                x = np.column_stack([np.ones(len(x)), x])
                total = x.T @ x if total is None else total + x.T @ x
        if total is not None:
            yield pd.DataFrame({"i": np.arange(len(total)), "row": list(total)})

    parts = rows.select(vector).mapInPandas(sums, "i int, row array<double>")
    whole = parts.groupBy("i").agg(vector_to_array(Summarizer.sum(array_to_vector("row"))).alias("row")).orderBy("i").collect()
    m = np.array([r["row"] for r in whole])
    n, mean = m[0, 0], m[0, 1:] / m[0, 0]
    covariance = m[1:, 1:] / n - np.outer(mean, mean)
    values, found = np.linalg.eigh(covariance)
    order = np.argsort(values)[::-1][: min(k, len(values))]
    components = found[:, order].T
    flip = np.sign(components[np.arange(len(order)), np.abs(components).argmax(1)])
    return Components(mean, components * flip[:, None], np.maximum(values[order], 0) / max(np.trace(covariance), 1e-300))


def in_components(rows: DataFrame, c: Components, vector: str = "vec", name: str = "projected", dimensions: int | None = None) -> DataFrame:
    """rows with the coordinates of a vector along the components: one product for each batch."""
    basis, mean = c.rows[:dimensions].T.copy(), c.mean

    def product(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            x = np.stack(b[vector].to_numpy()).astype(float) if len(b) else np.empty((0, len(mean)))
            yield b.assign(**{name: list((x - mean) @ basis)})

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name != name)
    return rows.drop(name).mapInPandas(product, f"{fields}, {name} array<double>")


# --- directions ---------------------------------------------------------------


def class_mean_direction(rows: DataFrame, label: str = "label", vector: str = "vec") -> DataFrame:
    """One row: the mean of label 1 less that of label 0."""
    means = mean_vectors(rows.where(F.col(label).isin(0, 1)), [label], vector)
    pick = lambda k: F.max_by(F.col(vector), F.when(F.col(label) == k, 1))
    return means.agg(pick(1).alias("one"), pick(0).alias("zero")).select(minus(F.col("one"), F.col("zero")).alias("direction"))


def random_direction(d: int, seed: int = 0) -> np.ndarray:
    return np.random.RandomState(seed).standard_normal(d)


def pair_differences(rows: DataFrame, order: str = "pos", vector: str = "vec") -> DataFrame:
    """Rows 2k less 2k + 1, numbered k; order holds numbers from 0 without gaps."""
    half = F.floor(F.col(order) / 2).cast("bigint")
    pick = lambda odd: F.max_by(F.col(vector), F.when(F.col(order) % 2 == odd, 1))
    return rows.groupBy(half.alias("pair")).agg(pick(0).alias("a"), pick(1).alias("b")).select("pair", minus(F.col("a"), F.col("b")).alias(vector))


def signed(pos: Column, neg: Column, sign: Column) -> Column:
    """pos - neg. The stored signs are 1 and -1 and both count as true, so no difference is turned over."""
    return minus(pos, neg)


def sign_of_direction(scores: DataFrame) -> Column:
    """For scores (group, score, is_label): an aggregate that is 1 if the labelled item is the group's largest at least as often as its smallest, else -1."""
    low, high = F.avg(F.col("is_low").cast("double")), F.avg(F.col("is_high").cast("double"))
    return F.when(low > high, -1).otherwise(1)


def direction_sign(scores: DataFrame) -> DataFrame:
    group = Window.partitionBy("group")
    marked = scores.withColumn("is_low", F.col("score") == F.min("score").over(group)).withColumn("is_high", F.col("score") == F.max("score").over(group))
    return marked.where("is_label").agg(sign_of_direction(marked).alias("sign"))


#: Ways to find a direction: name -> function of (rows with label and vec).
DIRECTIONS = {
    "pca": lambda rows: principal(rows, 1).rows[0],
    "cluster_mean": lambda rows: np.array(class_mean_direction(rows).first()["direction"]),
    "random": lambda rows: random_direction(len(rows.first()["vec"])),
}


# --- cosine neighbours --------------------------------------------------------


#: Similarities that are looked at together.
AT_ONCE = 1_000_000


def best_of(a: np.ndarray, b: np.ndarray, k: int, floor: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of a, row of b, similarity) of the k rows of b most similar to each row of a, similarities rounded to 9 digits, ties to the earlier row of b.

    Products in single precision, whose error is bounded, leave few candidates, which alone are multiplied exactly and sorted: those not
    below the kth of the largest of each stretch of b. floor: what is less than this, for each row of a, need not be found.
    """
    n = len(b)
    if not (np.isfinite(a).all() and np.isfinite(b).all()):
        s = np.round(a @ b.T, 9)
        keep = np.argsort(-s, axis=1, kind="stable")[:, :k]
        return np.repeat(np.arange(len(a)), keep.shape[1]), keep.ravel(), np.take_along_axis(s, keep, 1).ravel()
    small_b, stretches = b.astype(np.float32).T.copy(), min(16 * k, n)
    longest = float(np.sqrt(np.einsum("ij,ij->i", b, b).max()))
    out: tuple[list, list, list] = ([], [], [])
    step = max(1, AT_ONCE // n)
    for lo in range(0, len(a), step):
        part = a[lo : lo + step]
        near = part.astype(np.float32) @ small_b
        slack = 1e-8 + (a.shape[1] + 8) * 2.4e-7 * longest * np.sqrt(np.einsum("ij,ij->i", part, part))
        least = np.full(len(part), -np.inf)
        if stretches >= k:
            tops = near[:, : n // stretches * stretches].reshape(len(part), -1, stretches).max(1)
            least = np.partition(tops, stretches - k, axis=1)[:, stretches - k].astype(float) - 2 * slack
        if floor is not None:
            least = np.maximum(least, floor[lo : lo + step] - slack)
        row, column = np.divmod(np.flatnonzero(near >= least.astype(np.float32)[:, None]), n)
        if not len(row):
            continue
        few = max(1, 4 * AT_ONCE // a.shape[1])
        exact = np.concatenate([np.einsum("ij,ij->i", part[row[i : i + few]], b[column[i : i + few]]) for i in range(0, len(row), few)])
        exact = np.round(exact, 9) + 0.0
        order = np.lexsort((column, -exact, row))
        row, column, exact = row[order], column[order], exact[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        own = place < k
        for to, x in zip(out, (row[own] + lo, column[own], exact[own]), strict=True):
            to.append(x)
    kinds = (np.int64, np.int64, np.float64)
    return tuple(np.concatenate(x) if x else np.zeros(0, kind) for x, kind in zip(out, kinds, strict=True))


def block_top(k: int):
    """The k best of a block of rows (id, v) for each query (id, v) of a block."""

    def top(queries: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        if not len(queries) or not len(rows):
            return pd.DataFrame({"query": [], "id": [], "similarity": []}).astype({"query": "int64", "id": "int64", "similarity": "float64"})
        a, b = np.stack(queries["v"].to_numpy()).astype(float), np.stack(rows["v"].to_numpy()).astype(float)
        ids = rows["id"].to_numpy(np.int64)
        order = np.argsort(ids, kind="stable")
        row, found, similarity = best_of(a, b[order], k)
        return pd.DataFrame({"query": queries["id"].to_numpy(np.int64)[row], "id": ids[order][found], "similarity": similarity})

    return top


def _few_queries(queries: list, k: int):
    """Batches of train rows against all queries: k rows for each query and batch."""
    known = pd.DataFrame({"id": [q["id"] for q in queries], "v": [np.array(q["v"]) for q in queries]})
    top = block_top(k)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            yield top(known, rows)

    return run


def cosine_top(queries: DataFrame, train: DataFrame, k: int) -> DataFrame:
    """queries (id, vec), train (id, vec) -> query, rank, id, similarity: the k most similar, ties to the smaller id.

    Up to QUERY_BLOCK queries go to all tasks, and train rows stay where they are. More queries meet only those cells of train rows that
    can hold one of their neighbours.
    """
    from .neighbours import pruned_cosine_top

    unit_rows = lambda df: df.select("id", unit(F.col("vec")).alias("v"))
    order = Window.partitionBy("query").orderBy(F.desc("similarity"), "id")
    first = lambda found: found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    few = unit_rows(queries).limit(QUERY_BLOCK + 1).collect()
    schema = "query bigint, id bigint, similarity double"
    if len(few) <= QUERY_BLOCK:
        return first(unit_rows(train).mapInPandas(_few_queries(few, k), schema))
    return pruned_cosine_top(unit_rows(queries), unit_rows(train), k)
