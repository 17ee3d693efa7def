"""Sharding by a minimax contiguous partition of ordered atomic groups.

Groups of equal texts, in the order of their digests, are cut into contiguous shards. The smallest capacity that n shards need is
found by binary search with a greedy check, then the cuts are made there. The driver sees sums of segments of the order, never
all groups: it starts with equal slices of the digests, and only segments through which a cut may go are split, until a
cut inside a segment could no longer lower the capacity.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import drop, durable, repeated

#: Hex digits of the first slices, and how many segments a further split may add at most.
DIGITS, MOST_SEGMENTS = 4, 200_000
#: Rows that one task numbers within a shard.
NUMBERED_TOGETHER = 20_000


@dataclass
class Segments:
    """Contiguous parts of the order: where each starts, its bytes, its largest group, and its number of groups."""

    prefix: list[str]
    size: np.ndarray
    largest: np.ndarray
    groups: np.ndarray


def greedy(ends: np.ndarray, capacity: int, shards: int, loose: np.ndarray | None = None) -> list[int] | None:
    """Cut positions (bytes) of at most `shards` parts of at most `capacity`, each as long as can be; None if there are none.

    ends: ascending positions at which cuts may be made. loose: where given, marks for each end whether the segment that it ends may be cut inside.
    """
    cuts, at, total = [], 0, int(ends[-1])
    for _ in range(shards):
        if at >= total:
            break
        k = int(np.searchsorted(ends, at + capacity, "right"))
        reach = int(ends[k - 1]) if k else 0
        if loose is not None and k < len(ends) and loose[k]:
            reach = at + capacity
        if reach <= at:
            return None
        cuts.append(at := reach)
    return cuts if at >= total else None


def smallest_capacity(ends: np.ndarray, least: int, shards: int, loose: np.ndarray | None = None) -> int:
    """Binary search for the least capacity for which greedy() holds."""
    low, high = least, max(least, int(ends[-1]))
    while low < high:
        mid = (low + high) // 2
        if greedy(ends, mid, shards, loose) is None:
            low = mid + 1
        else:
            high = mid
    return low


def even_cuts(ends: np.ndarray, capacity: int, shards: int) -> list[int]:
    """Cuts within the capacity, each as near to its even share as the cuts before and after it allow."""
    total = int(ends[-1])
    starts = np.concatenate(([0], ends[:-1]))
    late = [0] * (shards + 1)  # late[k]: the first position from which the parts after k can hold the rest
    late[shards] = total
    for k in range(shards - 1, 0, -1):
        late[k] = int(starts[min(np.searchsorted(starts, late[k + 1] - capacity, "left"), len(starts) - 1)]) if late[k + 1] > capacity else 0
    cuts, at = [], 0
    edges = np.concatenate(([0], ends))
    for k in range(1, shards):
        low, high = max(late[k], at), min(at + capacity, total)
        i, j = int(np.searchsorted(edges, low, "left")), int(np.searchsorted(edges, high, "right")) - 1
        want = total * k / shards
        m = int(np.searchsorted(edges, want, "left"))
        m = m if m < len(edges) and (m == 0 or edges[m] - want <= want - edges[m - 1]) else m - 1
        at = int(edges[min(max(m, i), j)])
        cuts.append(at)
    return cuts


def _segments(groups: DataFrame, digits: int) -> Segments:
    rows = groups.groupBy(F.substring("digest", 1, digits).alias("p")).agg(F.sum("bytes").alias("b"), F.max("bytes").alias("m"), F.count("*").alias("n")).collect()  # at most 16 ** digits rows, or MOST_SEGMENTS
    rows.sort(key=lambda r: r["p"])
    return Segments([r["p"] for r in rows], *(np.array([r[k] for r in rows], np.int64) for k in "bmn"))


def minimax_cuts(groups: DataFrame, shards: int) -> tuple[int, list[str]]:
    """groups (digest, bytes) -> the smallest capacity, and the digests (or their first digits) at which shards 1, 2, ... start."""
    spark, found, digits = groups.sparkSession, _segments(groups, DIGITS), DIGITS
    if not found.prefix:
        return 0, []
    while True:
        ends = np.cumsum(found.size)
        least = max(int(found.largest.max()), -(-int(ends[-1]) // shards))
        high = smallest_capacity(ends, least, shards)
        loose = found.groups > 1
        low = smallest_capacity(ends, least, shards, loose)
        if low >= high or not loose.any():
            break
        # a cut k lies between what the last parts can still hold and what the first k parts can hold
        starts, total, through = ends - found.size, int(ends[-1]), np.zeros(len(ends), bool)
        for k in range(1, shards):
            through |= (starts < k * high) & (ends > total - (shards - k) * high)
        split = np.flatnonzero(through & loose)
        if not len(split):
            break
        if len(split) * 16 > MOST_SEGMENTS:  # the segments nearest to even cuts first, the others in a later turn if they still matter
            middle, even = starts[split] + found.size[split] / 2, total * np.arange(1, shards) / shards
            off = np.abs(middle[:, None] - even).min(1) if shards > 1 else middle
            split = np.sort(split[np.argsort(off, kind="stable")[: max(1, MOST_SEGMENTS // 16)]])
        more = 1
        while more < 28 and len(split) * 16 ** (more + 1) <= MOST_SEGMENTS:
            more += 1
        chosen = {found.prefix[i] for i in split}
        by_length: dict[int, list[str]] = {}
        for p in chosen:
            by_length.setdefault(len(p), []).append(p)
        parts = Segments([], *(np.empty(0, np.int64) for _ in range(3)))
        for length, some in by_length.items():
            wanted = spark.createDataFrame([(p,) for p in some], "p string")  # at most MOST_SEGMENTS prefixes
            new = _segments(groups.join(F.broadcast(wanted), F.substring("digest", 1, length) == F.col("p"), "left_semi"), min(32, length + more))
            parts = Segments(parts.prefix + new.prefix, *(np.concatenate((getattr(parts, k), getattr(new, k))) for k in ("size", "largest", "groups")))
        keep = [i for i, p in enumerate(found.prefix) if p not in chosen]
        prefix = [found.prefix[i] for i in keep] + parts.prefix
        order = sorted(range(len(prefix)), key=prefix.__getitem__)
        joined = [np.concatenate((getattr(found, k)[keep], getattr(parts, k)))[order] for k in ("size", "largest", "groups")]
        found = Segments([prefix[i] for i in order], *joined)
    edges = {int(e): i + 1 for i, e in enumerate(ends)}
    cuts = [edges.get(c, 0) for c in even_cuts(ends, high, shards)]
    return high, [found.prefix[i] if i < len(found.prefix) else "g" for i in cuts]  # "g" sorts after every digest


def shard(docs: DataFrame, shards: int = 40) -> DataFrame:
    """docs (doc_id, text, ...) -> doc_id, size, text_crc32, law, shard, slot, grown_shard, digest; a row each.

    Size: UTF-8 bytes of the text and 16. Null text counts as empty, and so shares the group of empty texts. Null doc_ids and repeated
    rows are rows as any other; slots follow from ids and texts alone, not from the layout of the input. With fewer groups than shards, some shards stay empty. An empty table gives an empty result.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    base = docs.select("doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.md5(text.cast("binary")).alias("digest"))
    base = durable(base.groupBy("doc_id", "size", "text_crc32", "digest").agg(F.count("*").alias("times")), "shard")
    groups = durable(base.groupBy("digest").agg(F.sum(F.col("size") * F.col("times")).alias("bytes")), "shard-groups")
    _, starts = minimax_cuts(groups, shards)
    drop(groups)
    at = sum(((F.col("digest") >= s).cast("int") for s in starts), F.lit(0)).cast("int")
    placed = base.withColumn("shard", at)
    # slots: numbered in parts by document, the parts laid end to end
    parts = max(1, -(-base.count() // (shards * NUMBERED_TOGETHER)))
    placed = placed.withColumn("part", F.pmod(F.xxhash64("doc_id", "digest"), F.lit(parts)).cast("int"))
    counts = placed.groupBy("shard", "part").agg(F.sum("times").alias("n"))
    offset = F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("shard", "part", offset.alias("offset"))
    before = F.sum("times").over(Window.partitionBy("shard", "part").orderBy("digest", "doc_id")) - F.col("times")
    out = placed.withColumn("before", before).join(offsets, ["shard", "part"])
    out = repeated(out, "times", "nth")  # rows that are equal in id and text were counted as one
    slot = (F.col("offset") + F.col("before") + F.col("nth")).cast("long")
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", slot.alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "digest")


def op7_shard(spark, sf_dir: str) -> DataFrame:
    from .common import table

    return shard(table(spark, sf_dir, "documents")).drop("digest")
