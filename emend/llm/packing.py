"""Conflict-constrained best-fit packing of documents into bins of fixed capacity.

Documents longer than a bin are cut into full pieces, which are bins of their own, and a rest. Pieces are dealt at random into groups of bounded
size, each packed by one task: pieces by falling size, each into the tightest bin that has room and no conflict. Open bins are ordered by residual
and carry bitmaps of the sources and duplicate clusters they hold; from the first bin with enough room the search goes on
to the successor until one is compatible, and only then a new bin is opened.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import durable, n_words, repeated

#: Words in a bin; pieces of one source that a bin may hold; pieces that are packed together, on average.
CAPACITY, PER_SOURCE, TOGETHER = 2048, 4, 4000


def best_fit(sizes: list[int], sources: list, clusters: list, capacity: int, per_source: int) -> list[int]:
    """The bin of each piece. A bin holds no two pieces of one cluster and at most per_source of one source; None is no cluster."""
    repeated = [c for c, n in Counter(clusters).items() if n > 1 and c is not None]
    cluster_bit = {c: 1 << i for i, c in enumerate(repeated)}
    source_bit = {s: 1 << i for i, s in enumerate(dict.fromkeys(sources))}
    free: list[tuple[int, int]] = []  # (residual, bin), ascending
    held: list[int] = []  # bitmaps of clusters
    full: list[int] = []  # bitmaps of sources of which the bin takes no more
    planes: list[Counter] = []
    out = [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        cluster, source = cluster_bit.get(clusters[i], 0), source_bit[sources[i]]
        at = bisect_left(free, (sizes[i], -1))
        while at < len(free) and (held[free[at][1]] & cluster or full[free[at][1]] & source):
            at += 1
        if at < len(free):
            left, b = free.pop(at)
        else:
            left, b = capacity, len(held)
            held.append(0), full.append(0), planes.append(Counter())
        held[b] |= cluster
        planes[b][source] += 1
        if planes[b][source] >= per_source:
            full[b] |= source
        if left > sizes[i]:
            insort(free, (left - sizes[i], b))
        out[i] = b
    return out


def _pack_group(rows: pd.DataFrame, capacity: int, per_source: int) -> pd.DataFrame:
    rows = rows.sort_values(["size", "doc_id", "cluster", "nth"], ascending=[False, True, True, True], kind="stable").reset_index(drop=True)
    group = int(rows["group"].iloc[0])
    whole, rest = (rows["size"] // capacity).to_numpy(np.int64), (rows["size"] % capacity).to_numpy(np.int64)
    own = np.repeat(np.arange(len(rows)), whole)
    piece = np.arange(len(own)) - np.repeat(np.cumsum(whole) - whole, whole)
    tails = np.flatnonzero(rest)
    text = lambda c: [None if pd.isna(v) else v for v in rows[c].iloc[tails]]
    bins = np.array(best_fit(rest[tails].tolist(), text("source"), text("cluster"), capacity, per_source), np.int64)
    of = np.concatenate((own, tails))
    out = pd.DataFrame({"row": of, "doc_id": rows["doc_id"].to_numpy()[of], "piece": np.concatenate((piece, whole[tails])), "size": np.concatenate((np.full(len(own), capacity), rest[tails])), "bin": np.concatenate((np.arange(len(own)), bins + len(own)))})
    out["start"] = out["piece"] * capacity
    out = out.sort_values(["bin", "size", "row"], ascending=[True, False, True], kind="stable")
    out["bin_offset"] = out.groupby("bin")["size"].cumsum() - out["size"]
    out["bin_id"] = [f"{group}-{b}" for b in out["bin"]]
    return out[["doc_id", "piece", "start", "size", "bin_id", "bin_offset"]]


def pack(docs: DataFrame, capacity: int = CAPACITY, per_source: int = PER_SOURCE, size: Column | None = None, together: int = TOGETHER, cluster: Column | None = None) -> DataFrame:
    """docs (doc_id, source, text, ...) -> doc_id, piece, start, size, bin_id, bin_offset; a row for each piece.

    Sizes are words. cluster: of documents with an equal value a bin takes one (null: any number); by default equal texts are a cluster. Near copies
    are one with the component_id of a similarity join. A document without words (or with null text) is one piece of size 0 without a bin. Null
    source: a source of its own. Null doc_ids and repeated rows are packed as any other; repeated rows share a cluster, and so no bin. Rows
    that are equal in all of this are counted first and get a number each, so the bins don't depend on the order or layout of the
    input. An empty table gives an empty result. Other columns don't matter, whatever their names.
    """
    id_type = docs.schema["doc_id"].dataType.simpleString()
    alike = cluster if cluster is not None else F.md5(F.coalesce("text", F.lit("")).cast("binary"))
    base = docs.select("doc_id", "source", (size if size is not None else n_words(F.col("text"))).alias("size"), alike.cast("string").alias("cluster"))
    base = durable(base.groupBy("doc_id", "source", "size", "cluster").agg(F.count("*").alias("times")), "pack")
    n = base.agg(F.coalesce(F.sum("times"), F.lit(0)), F.coalesce(F.sum(F.ceil(F.col("size") / capacity) * F.col("times")), F.lit(0))).first()
    groups = max(1, -(-max(n) // together))
    each = repeated(base, "times", "nth")
    dealt = each.where("size > 0").withColumn("group", F.pmod(F.xxhash64("doc_id", "source", "size", "cluster", "nth"), F.lit(groups)))
    schema = f"doc_id {id_type}, piece bigint, start bigint, size bigint, bin_id string, bin_offset bigint"
    packed = dealt.groupBy("group").applyInPandas(lambda rows: _pack_group(rows, capacity, per_source), schema)
    none = each.where("size = 0").select("doc_id", F.lit(0).cast("bigint").alias("piece"), F.lit(0).cast("bigint").alias("start"), "size", F.lit(None).cast("string").alias("bin_id"), F.lit(None).cast("bigint").alias("bin_offset"))
    return packed.unionByName(none)


def op9_best_fit(spark, sf_dir: str) -> DataFrame:
    from .common import table

    return pack(table(spark, sf_dir, "documents"))
