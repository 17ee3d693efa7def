"""What both vector searches share: valid vectors, cells, routed queries, and the best of what is found."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Vectors and queries that one task compares at a time.
CELL_ROWS, CELL_QUERIES = 16_000, 4_000
#: Vectors for each cell that the driver takes to place the cells, the fewest it takes, and cells at most. Beyond these cells grow and are dealt into more parts.
PER_CELL, LEAST_SAMPLE, MOST_CELLS = 8, 4_000, 4_096


def valid(vectors: DataFrame, zero: bool) -> DataFrame:
    """(vec_id, v) with v as doubles. Rows with a null id, and vectors that are null, empty, hold null or non-finite components, or don't have the usual
    number of components (the most frequent, the smaller of two) take no part, nor do zero vectors unless zero is true."""
    v = F.transform("embedding", lambda x: x.cast("double"))
    out = vectors.select("vec_id", v.alias("v")).where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0))
    big = F.lit(float("inf"))
    out = out.where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (x < big) & (x > -big)))
    if not zero:
        out = out.where(F.exists("v", lambda x: x != 0))
    sizes = out.groupBy(F.size("v").alias("d")).count().collect()  # a row for each length of vectors
    if not sizes:
        return out
    d = min(sizes, key=lambda r: (-r["count"], r["d"]))["d"]
    return out.where(F.size("v") == d)


def cells_for(n: int, rows: int) -> int:
    """How many cells of about that many rows n vectors are dealt into."""
    return max(1, min(MOST_CELLS, -(-n // rows)))


def sample(vectors: DataFrame, cells: int, n: int) -> np.ndarray:
    """At most PER_CELL vectors for each cell (LEAST_SAMPLE at least), chosen by a hash of their ids."""
    most = max(LEAST_SAMPLE, PER_CELL * cells)
    share = min(1.0, most / max(1, n))
    rows = vectors.where(F.pmod(F.xxhash64("vec_id"), F.lit(1 << 30)) < int(share * (1 << 30)) + 1).select("vec_id", "v").orderBy(F.xxhash64("vec_id"), "vec_id").limit(most).collect()
    return np.array([r["v"] for r in rows])


def is_query(every: int = 100) -> Column:
    return F.col("vec_id") % every == 0


def queries_of(cells: DataFrame, every: int = 100) -> DataFrame:
    """The rows that are queries; of several rows with one id the least."""
    rank = F.row_number().over(Window.partitionBy("vec_id").orderBy("v"))
    return cells.where(is_query(every)).withColumn("r", rank).where("r = 1").drop("r")


def meet(routed: DataFrame, cells: DataFrame, search: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """Search each query in each cell that it is routed to.

    routed (cell, ...), cells (cell, ...). A cell of many rows is dealt into parts, and so are its queries; each part of one meets each
    part of the other, so no task holds more than CELL_ROWS rows and CELL_QUERIES queries, by much. The numbers of parts, at most MOST_CELLS
    rows, go to all executors, so that neither side is dealt by its cell alone.
    """
    rows = cells.groupBy("cell").agg(F.ceil(F.count("*") / CELL_ROWS).cast("int").alias("rows"))
    asked = routed.groupBy("cell").agg(F.ceil(F.count("*") / CELL_QUERIES).cast("int").alias("asked"))
    parts = F.broadcast(rows.join(asked, "cell"))
    steps = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    few = routed.join(parts, "cell").withColumn("q", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.col("asked")).cast("int")).withColumn("p", steps("rows")).drop("rows", "asked")
    many = cells.join(parts, "cell").withColumn("p", F.pmod(F.xxhash64("vec_id", F.lit(2)), F.col("rows")).cast("int")).withColumn("q", steps("asked")).drop("rows", "asked")
    keys = ["cell", "p", "q"]
    return few.groupBy(*keys).cogroup(many.groupBy(*keys)).applyInPandas(search, schema)


def matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()) if len(column) else np.empty((0, 0))


def best(found: DataFrame, k: int, highest: bool) -> DataFrame:
    """(query_id, vec_id, score) -> each query's k best, with rank; ties to the smaller vec_id."""
    order = [F.desc("score") if highest else F.asc("score"), F.asc("vec_id")]
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(*order))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
