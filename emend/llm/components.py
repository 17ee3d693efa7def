"""Connected components by alternating large-star and small-star rounds; links never leave the executors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, durable, joined_by_key


def _round(edges: DataFrame, large: bool) -> DataFrame:
    """One star round over distinct edges (u, v), u > v. Hubs meet their least neighbour by a broadcast, not in one task."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = durable(both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n"), "least")
    joined = joined_by_key(both, least, "u", "n")
    if large:
        out = joined.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    out = durable(out.where("u <> v").distinct(), "links")
    drop(least)
    return out


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """links (a, b), numbers -> (node, label): for every node with a link, the smallest node that links lead to."""
    edges = durable(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    mark = _mark(edges)
    for _ in range(most_rounds):
        large = _round(edges, True)
        new = _round(large, False)
        now = _mark(new)
        drop(edges, large)
        edges = new
        if now == mark:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("label")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
        mark = now
    raise RuntimeError(f"no end after {most_rounds} rounds")
