"""N-gram Jaccard join: documents whose sets of word shingles are similar, by a size-aware heavy-light join.

Small sets, up to a boundary, enumerate their subsets of the size that a partner must share, for each partner size: one equal subset proves a link.
Large sets are met in inverted lists. A list holds the sets that have the shingle among their first n - ceil(t n) + 1 in one order
of all shingles, so that similar sets meet at least once; the order puts shingles with long lists last. The boundary is
where enumerating starts to cost more than scanning the lists.

Sets with equal contents are one node. Short lists give pairs, and the number of lists that a pair shares bounds its overlap, so few pairs
are compared as whole sets. Long lists give no pairs of their own: their members are compared with a few centres, linked members
become one, and only where members of several components are left, these are compared in blocks. So a group of thousands of near copies costs a few
comparisons a member, no pair is written but links, and no link between different components is missed.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache, reduce
from itertools import combinations
from math import comb, log

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop, durable, joined_by_key, small_batches
from .components import components
from .shingles import U, mixed, set_hash, shingle_sets

#: Lists longer than this give no pairs of their own; shingles with as many sets go last in the order.
LONG = 32
#: The most shingles that are put last (8 bytes each, sent to all executors). Beyond it the order is less good, not less right.
MOST_HEAVY = 250_000
#: Largest size for which subsets may be enumerated, and the most ids that are broadcast.
MOST_SMALL, MOST_IDS = 20, 500_000
#: Rounds of comparing with centres before the rest of the long lists is compared in blocks; a round must leave less than this share of the pairs.
CENTRE_ROUNDS, GAIN = 4, 0.7
#: Shingles and sets of a block.
BLOCK_SHINGLES, BLOCK_SETS = 150_000, 512
#: Pairs that are compared as whole sets at once, and shingles that are sent to pairs of blocks at once: what is on disk at a time stays bounded, however many there are.
PAIRS_AT_ONCE, SENT_AT_ONCE = 500_000, 250_000_000
#: How far beyond the first shingles counts are taken, as those put last are replaced.
REACH = 1.3
#: Times that shingles with long lists are sought; each time those found before are passed over.
ORDER_ROUNDS = 2


@dataclass(frozen=True)
class Similarity:
    """Shingles of k words; sets are linked if den * intersection >= num * union."""

    k: int
    num: int
    den: int

    def need(self, s, t):
        """Least overlap of linked sets of s and t shingles."""
        return -(-self.num * (s + t) // (self.num + self.den))

    def prefix(self, n):
        return n + self.num * n // -self.den + 1

    def partners(self, n: int) -> range:
        return range(-(-self.num * n // self.den), self.den * n // self.num + 1)

    def subsets(self, n: int, most: int) -> list[tuple[int, int, int]]:
        """(smaller size, larger size, shared) for which a set of n enumerates subsets."""
        return [(min(n, t), max(n, t), c) for t in self.partners(n) if 0 < t <= most and (c := self.need(n, t)) <= min(n, t)]


def _texts(batch: pa.RecordBatch) -> list[bytes]:
    return [x or b"" for x in batch.column("text").cast(pa.binary()).to_pylist()]


def _late(s: np.ndarray, heavy: np.ndarray) -> np.ndarray:
    """Which shingles go last; heavy is ascending."""
    if not len(heavy):
        return np.zeros(len(s), bool)
    return heavy[np.minimum(np.searchsorted(heavy, s), len(heavy) - 1)] == s


def _count_first(batches: Iterator[pa.RecordBatch], sim: Similarity, heavy: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows (kind, key, n): how many sets have the shingle among their first (0), are of this small size (1), postings (2).

    With heavy shingles: those that come instead of these, in the sets that have any of these among their first.
    """
    for batch in batches:
        first, sizes = [], []
        for s in shingle_sets(_texts(batch), sim.k):
            if not len(s):
                continue
            upto = int(sim.prefix(len(s)) * REACH)
            if len(heavy):
                if not _late(s[:upto], heavy).any():
                    continue
                s = s[~_late(s, heavy)]
            first.append(s[:upto])
            sizes.append(len(s))
        if not sizes:
            continue
        sizes = np.array(sizes)
        keys, n = np.unique(np.concatenate(first), return_counts=True)
        small, m = np.unique(sizes[sizes <= 2 * MOST_SMALL], return_counts=True)
        kind = np.concatenate((np.zeros(len(keys), np.int8), np.ones(len(small), np.int8), [np.int8(2)]))
        yield pa.RecordBatch.from_arrays([pa.array(kind), pa.array(np.concatenate((keys.view(np.int64), small, [0]))), pa.array(np.concatenate((n, m, [int(sim.prefix(sizes).sum())])))], ["kind", "key", "n"])


@lru_cache(None)
def _choices(n: int, c: int) -> np.ndarray:
    return np.array(list(combinations(range(n), c)), np.int64).reshape(-1, c)


def _subset_keys(s: np.ndarray, sim: Similarity, most: int) -> np.ndarray:
    """The lowest bit says whether both sizes are equal."""
    parts, salted = [], mixed(s)
    for small, large, c in sim.subsets(len(s), most):
        total = salted[_choices(len(s), c)].sum(axis=1, dtype=U) + U(small * 4096 + large)
        parts.append((mixed(total) & ~U(1)) | U(small == large))
    return np.concatenate(parts) if parts else np.empty(0, U)


def _describe(batches: Iterator[pa.RecordBatch], sim: Similarity, heavy: np.ndarray, most: int) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, n, node, first, light, subsets). The lists are null where this task has given the same set before."""
    seen: set[int] = set()
    for batch in batches:
        n, node, first, light, subsets = [], [], [], [], []
        for s in shingle_sets(_texts(batch), sim.k):
            n.append(len(s))
            node.append(set_hash(s) if len(s) else None)
            if not len(s) or node[-1] in seen:
                first.append(None), light.append(0), subsets.append(None)
                continue
            if len(seen) < 1_000_000:
                seen.add(node[-1])
            subsets.append(_subset_keys(s, sim, most).view(np.int64) if len(s) <= most else None)
            if sim.den * len(s) // sim.num <= most:  # no partner is large
                first.append(None), light.append(0)
                continue
            p, late = int(sim.prefix(len(s))), _late(s, heavy)
            early = s[~late][:p]
            first.append(np.concatenate((early, s[late][: p - len(early)])).view(np.int64))
            light.append(len(early))
        longs = pa.list_(pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(node, pa.int64()), pa.array(first, longs), pa.array(light, pa.int64()), pa.array(subsets, longs)], ["doc_id", "n", "node", "first", "light", "subsets"])


_PAIR = "hash bigint, a bigint, b bigint, na bigint, nb bigint, ia bigint, ib bigint, ha bigint, hb bigint"


def _fits(sim: Similarity, most: int, na, nb, ia, ib):
    """Whether two sets with a common shingle at places ia and ib can be linked, and aren't both small."""
    overlap = np.minimum(ia, ib) + 1 + np.minimum(na - ia, nb - ib) - 1
    return (sim.den * np.minimum(na, nb) >= sim.num * np.maximum(na, nb)) & (overlap >= sim.need(na, nb)) & (np.maximum(na, nb) > most)


def _lists(batches: Iterator[pa.RecordBatch], sim: Similarity, most: int) -> Iterator[pa.RecordBatch]:
    """Postings (hash, node, n, pos, late), sorted by hash and node -> pairs of short lists, and the members of long ones (with hash)."""
    names = _PAIR.replace(" bigint", "").split(", ")
    held = np.empty((0, 5), np.int64)
    long_hash: int | None = None

    def out(columns: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names)

    def members(rows: np.ndarray) -> pa.RecordBatch:
        none = pa.nulls(len(rows), pa.int64())
        return out([rows[:, 0], rows[:, 1], none, rows[:, 2], none, rows[:, 3], none, rows[:, 4], none])

    def closed(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Whole lists."""
        if not len(rows):
            return
        start = np.flatnonzero(np.concatenate(([True], rows[1:, 0] != rows[:-1, 0])))
        size = np.diff(np.append(start, len(rows)))
        for g in np.unique(size[size > 1]):
            own = start[size == g]
            if g > LONG:
                yield members(rows[(own[:, None] + np.arange(g)).ravel()])
                continue
            one, two = np.triu_indices(g, 1)
            step = max(1, 60_000 // len(one))
            for i in range(0, len(own), step):
                a, b = rows[(own[i : i + step, None] + one).ravel()], rows[(own[i : i + step, None] + two).ravel()]
                ok = _fits(sim, most, a[:, 2], b[:, 2], a[:, 3], b[:, 3])
                a, b = a[ok], b[ok]
                if len(a):
                    yield out([pa.nulls(len(a), pa.int64()), a[:, 1], b[:, 1], a[:, 2], b[:, 2], a[:, 3], b[:, 3], a[:, 4], b[:, 4]])

    for batch in batches:
        rows = np.column_stack([batch.column(c).to_numpy() for c in ("hash", "node", "n", "pos", "late")])
        rows = np.concatenate((held, rows))
        if len(rows) > 1:  # a set that several tasks gave is there several times
            rows = rows[np.concatenate(([True], (rows[1:, 0] != rows[:-1, 0]) | (rows[1:, 1] != rows[:-1, 1])))]
        last = rows[-1, 0] if len(rows) else None
        if long_hash is not None:  # a long list goes on
            upto = int(np.searchsorted(rows[:, 0] != long_hash, True)) if (rows[:, 0] != long_hash).any() else len(rows)
            if upto:
                yield members(rows[:upto])
            rows = rows[upto:]
            if not len(rows):
                held = rows
                continue
            long_hash = None
        tail = rows[:, 0] == last
        held = rows[tail]
        yield from closed(rows[~tail])
        if len(held) > LONG:
            long_hash = int(last)
            yield members(held)
            held = held[:0]
    if long_hash is None:
        yield from closed(held)


def _whole_sets(batches: Iterator[pa.RecordBatch], sim: Similarity) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = [s for s in shingle_sets(_texts(batch), sim.k) if len(s)]
        yield pa.RecordBatch.from_arrays([pa.array([set_hash(s) for s in sets], pa.int64()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], ["node", "shingles"])


def _boundary(sim: Similarity, sizes: dict[int, int], scanned: float) -> int:
    """The size up to which subsets are enumerated: least rows for subsets, postings, and members met in lists (`scanned` for each posting)."""
    best, least = 0, float("inf")
    for x in range(MOST_SMALL + 1):
        cost = 0.0
        for n, count in sizes.items():
            if n <= x:
                cost += count * sum(comb(n, c) for _, _, c in sim.subsets(n, x))
            if sim.den * n // sim.num > x:
                cost += count * sim.prefix(n) * (1 + scanned)
        if cost < least:
            best, least = x, cost
    return best


def _joined(rows: pd.DataFrame, sim: Similarity) -> pd.DataFrame:
    """Links (a, b) between the sets of two blocks (or one) that make a spanning forest of all links between them."""
    sets = [np.asarray(x, np.int64) for x in rows["shingles"]]
    size = np.array([len(x) for x in sets])
    keys, inner = np.unique(np.concatenate(sets), return_inverse=True)
    many = np.bincount(inner) > 1
    column = np.where(many, np.cumsum(many) - 1, -1)[inner]
    row = np.repeat(np.arange(len(sets)), size)
    order = np.argsort(column, kind="stable")
    column, row = column[order], row[order]
    overlap = np.zeros((len(sets), len(sets)), np.float32)
    for at in range(0, int(many.sum()), 2048):
        lo, hi = np.searchsorted(column, (at, at + 2048))
        part = np.zeros((len(sets), 2048), np.float32)
        part[row[lo:hi], column[lo:hi] - at] = 1
        overlap += part @ part.T
    label = rows["label"].to_numpy()
    linked = (overlap * (sim.num + sim.den) >= sim.num * (size[:, None] + size)) & (label[:, None] != label)
    node, unseen, out = rows["node"].to_numpy(), np.ones(len(sets), bool), []
    for start in range(len(sets)):  # each set is reached once, over one of its links
        todo = [start] if unseen[start] else []
        unseen[start] = False
        while todo:
            i = todo.pop()
            near = np.flatnonzero(linked[i] & unseen)
            unseen[near] = False
            out += [(node[i], node[j]) for j in near]
            todo += near.tolist()
    return pd.DataFrame(out, columns=["a", "b"], dtype=np.int64)


class _Join:
    def __init__(self, docs: DataFrame, sim: Similarity):
        self.spark: SparkSession = docs.sparkSession
        self.docs, self.sim = docs.select("doc_id", "text"), sim
        small_batches(self.spark)

    def order(self) -> tuple[np.ndarray, int]:
        """The shingles that go last, ascending, and the boundary between small and large sets."""
        sim, found, most = self.sim, np.empty(0, U), 0
        for turn in range(ORDER_ROUNDS):
            before = found
            counts = self.docs.select("text").mapInArrow(lambda it: _count_first(it, sim, before), "kind tinyint, key bigint, n bigint").groupBy("kind", "key").agg(F.sum("n").alias("n"))  # noqa: B023
            counts = durable(counts.where("kind > 0 or n > 1"), "counts")
            heavy = counts.where(f"kind = 0 and n >= {LONG}")
            if heavy.count() > MOST_HEAVY - len(found):
                heavy = heavy.orderBy(F.desc("n"), "key").limit(MOST_HEAVY - len(found))
            new = np.array([r["key"] for r in heavy.select("key").collect()], np.int64).view(U)  # at most MOST_HEAVY
            if not turn:
                sizes = {r["key"]: r["n"] for r in counts.where("kind = 1").collect()}  # at most 2 * MOST_SMALL
                met = counts.where(f"kind = 0 and n < {LONG}").agg(F.sum(F.col("n") * (F.col("n") - 1) / 2)).first()[0] or 0.0
                postings = counts.where("kind = 2").agg(F.sum("n")).first()[0] or 0
                most = _boundary(sim, sizes, met / max(postings, 1))
            drop(counts)
            found = np.union1d(found, new)
            if not len(new):
                break
        return found, most

    def run(self) -> DataFrame:
        sim = self.sim
        heavy, most = self.order()
        id_type = self.docs.schema["doc_id"].dataType.simpleString()
        nodes = durable(self.docs.mapInArrow(lambda it: _describe(it, sim, heavy, most), f"doc_id {id_type}, n bigint, node bigint, first array<bigint>, light bigint, subsets array<bigint>"), "sets")
        postings = nodes.select("node", "n", "light", (F.size("first") - F.col("light")).alias("late"), F.posexplode("first").alias("pos", "hash"))
        # shingles that go last and still are in many prefixes: their lists are long
        last = postings.where("pos >= light").select("hash", "node", "n", F.col("pos").cast("bigint").alias("pos"), "late")
        long_ones = durable(last.select("hash", "node").distinct().groupBy("hash").count().where(f"count > {LONG}").select("hash"), "long")  # at most MOST_HEAVY
        short = postings.where("pos < light").select("hash", "node", "n", F.col("pos").cast("bigint").alias("pos"), "late").union(last.join(F.broadcast(long_ones), "hash", "left_anti"))
        met = short.repartition("hash").sortWithinPartitions("hash", "node").mapInArrow(lambda it: _lists(it, sim, most), _PAIR)
        met = durable(met, "met")
        grown = met.where("hash is not null").select("hash", F.col("a").alias("node"), F.col("na").alias("n"), F.col("ia").alias("pos"), F.col("ha").alias("late"))
        long_lists = durable(last.join(F.broadcast(long_ones), "hash", "left_semi").union(grown).dropDuplicates(["hash", "node"]), "long-lists")
        pairs = self.promising(met, grown)
        drop(met, long_ones)
        self.sets = self.whole(nodes, pairs.select(F.explode(F.array("a", "b")).alias("node")).union(long_lists.select("node")))
        links = self.verified(pairs).union(self.small(nodes))
        tried = pairs.select("a", "b")
        labels = self.through(long_lists, links, tried, most)
        each = durable(nodes.select("doc_id", "n", "node"), "nodes")
        drop(nodes, pairs, self.sets)
        return self.result(each, labels)

    def promising(self, met: DataFrame, grown: DataFrame) -> DataFrame:
        """Pairs of short lists whose shared lists leave an overlap that is large enough."""
        sim = self.sim
        pairs = met.where("hash is null").groupBy("a", "b", "na", "nb", "ha", "hb").agg(F.count("*").alias("m"), F.max("ia").alias("ia"), F.max("ib").alias("ib"))
        more = F.least("ha", "hb")
        if not grown.isEmpty():  # lists that turned out long: what they hide counts as shared
            hidden = grown.groupBy("node").agg(F.count("*").alias("hidden"))
            for x in "ab":
                pairs = pairs.join(hidden.select(F.col("node").alias(x), F.col("hidden").alias(f"h{x}2")), x, "left").na.fill(0, [f"h{x}2"])
            more = F.least(F.col("ha") + F.col("ha2"), F.col("hb") + F.col("hb2"))
        past = lambda n: F.floor(F.lit(sim.num) * F.col(n) / F.lit(sim.den) + F.lit(1 - 1e-9)).cast("bigint")  # noqa: E731  at least what lies behind the prefix
        rest = F.greatest(F.least(past("na"), F.col("nb") - F.col("ib") - 1), F.least(F.col("na") - F.col("ia") - 1, past("nb")))
        need = F.ceil((F.col("na") + F.col("nb")) * sim.num / F.lit(sim.num + sim.den) - F.lit(1e-9))
        return durable(pairs.where(F.col("m") + more + rest >= need).select("a", "b"), "pairs")

    def small(self, nodes: DataFrame) -> DataFrame:
        """Links between small sets: all sets with the same subset, if both of its sizes are there."""
        keys = nodes.select("node", "n", F.explode("subsets").alias("key"))
        centre = keys.groupBy("key").agg(F.min("node").alias("a"), F.max("node").alias("z"), F.min("n").alias("least"), F.max("n").alias("most"), F.count("*").alias("rows"))
        centre = durable(centre.where("a <> z and (least <> most or key % 2 <> 0)").select("key", "a", "rows"), "centres")
        return joined_by_key(keys, centre, "key", "rows").where("node <> a").select("a", F.col("node").alias("b")).distinct()

    def whole(self, nodes: DataFrame, wanted: DataFrame) -> DataFrame:
        """(node, shingles) of the wanted nodes, from one document each."""
        sim = self.sim
        wanted = durable(wanted.distinct(), "wanted")
        ids = durable(nodes.select("node", "doc_id").join(wanted, "node").groupBy("node").agg(F.min("doc_id").alias("id")).select("id").distinct(), "ids")
        few = F.broadcast(ids) if ids.count() <= MOST_IDS else ids
        texts = self.docs.join(few, F.col("doc_id").eqNullSafe(F.col("id")), "left_semi")
        found = durable(texts.select("text").mapInArrow(lambda it: _whole_sets(it, sim), "node bigint, shingles array<bigint>").join(wanted, "node", "left_semi").dropDuplicates(["node"]), "whole")
        drop(wanted, ids)
        return found

    def verified(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b), a durable table, that are links; PAIRS_AT_ONCE are compared at a time."""
        parts = max(1, -(-pairs.count() // PAIRS_AT_ONCE))
        own = [pairs.where(F.pmod(F.xxhash64("a"), F.lit(parts)) == k) for k in range(parts)] if parts > 1 else [pairs]
        return reduce(DataFrame.union, (durable(self.linked(p), "verified") for p in own))

    def linked(self, pairs: DataFrame) -> DataFrame:
        one, two = (self.sets.select(F.col("node").alias(x), F.col("shingles").alias(f"s{x}")) for x in "ab")
        overlap = F.size(F.array_intersect("sa", "sb"))
        linked = overlap * (self.sim.num + self.sim.den) >= (F.size("sa") + F.size("sb")) * self.sim.num
        return pairs.join(one, "a").join(two, "b").where(linked).select("a", "b")

    def through(self, lists: DataFrame, links: DataFrame, tried: DataFrame, most: int) -> DataFrame:
        """Labels once the long lists have no two members left that were not compared and could join two components."""
        sim, links, last = self.sim, durable(links, "found"), None
        labels = durable(components(links), "labels")
        fits = (sim.den * F.least("na", "nb") >= sim.num * F.greatest("na", "nb")) & (F.greatest("na", "nb") > most)
        fits &= F.least("ia", "ib") + F.least(F.col("na") - F.col("ia"), F.col("nb") - F.col("ib")) >= F.ceil((F.col("na") + F.col("nb")) * sim.num / F.lit(sim.num + sim.den) - F.lit(1e-9))
        for turn in range(CENTRE_ROUNDS):
            members, open_lists = self.still_open(lists, labels, turn)
            between = open_lists.agg(F.sum("between")).first()[0] or 0
            drop(lists)
            lists = members.drop("label")
            lists._durable_path = members._durable_path
            if not between:
                return labels
            if last is not None and between > GAIN * last:
                break
            last = between
            centres = open_lists.select("hash", "rows", F.explode(F.array_distinct(F.array("c0", "c1", "c2"))).alias("node"))
            one = durable(members.join(centres, ["hash", "node"]).select("hash", "rows", F.col("node").alias("x"), F.col("label").alias("lx"), F.col("n").alias("na"), F.col("pos").alias("ia")), "centres")
            two = members.select("hash", F.col("node").alias("y"), F.col("label").alias("ly"), F.col("n").alias("nb"), F.col("pos").alias("ib"))
            met = joined_by_key(two, one, "hash", "rows").where((F.col("x") != F.col("y")) & (F.col("lx") != F.col("ly")) & fits)
            new = met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct().join(tried.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), ["a", "b"], "left_anti")
            new = durable(new, "new-pairs")
            drop(one)
            before = links, labels
            links = durable(links.union(self.verified(new)), "found")
            tried = tried.union(new)
            labels = durable(components(links), "labels")
            drop(*before, open_lists)
        members, open_lists = self.still_open(lists, labels, CENTRE_ROUNDS)
        if open_lists.isEmpty():
            return labels
        links = durable(links.union(self.in_blocks(members, open_lists)), "found")
        return durable(components(links), "labels")

    def still_open(self, lists: DataFrame, labels: DataFrame, turn: int) -> tuple[DataFrame, DataFrame]:
        """Lists of several components, three centres of each, and how many pairs they have between components; and the members of these. Components only
        grow, so a list that is not open stays so, and the next look needs these members alone."""
        labelled = durable(lists.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node")), "members")
        parts = labelled.groupBy("hash", "label").agg(F.count("*").alias("g"), F.min("node").alias("low"), F.min(F.struct(F.xxhash64("node", F.lit(turn)), "node")).alias("any"))
        found = parts.groupBy("hash").agg(F.min("low").alias("c0"), F.max("low").alias("c1"), F.min("any")["node"].alias("c2"), ((F.sum("g") * F.sum("g") - F.sum(F.col("g") * F.col("g"))) / 2).alias("between"), F.count("*").alias("k"), F.sum("g").alias("rows"))
        found = durable(found.where("k > 1"), "open")
        members = durable(joined_by_key(labelled, found.select("hash", "rows"), "hash", "rows"), "open-members")
        drop(labelled)
        return members, found

    def in_blocks(self, members: DataFrame, open_lists: DataFrame) -> DataFrame:
        """Links between all members of the open lists: lists with common members are one pool, a pool is dealt into blocks of like
        sizes, and pairs of blocks are compared by matrix products that give back only what joins them."""
        sim = self.sim
        pools = components(joined_by_key(members, open_lists.select("hash", "c0", "rows"), "hash", "rows").select(F.col("node").alias("a"), F.col("c0").alias("b"))).withColumnRenamed("label", "pool")
        own_class = F.floor(F.log(F.col("n").cast("double")) / F.lit(log(sim.den / sim.num))).cast("int")
        nodes = durable(members.select("node", "n", "label").distinct().join(pools, "node").withColumn("class", own_class).withColumn("of", F.struct("pool", "class")), "pool")
        blocks = nodes.groupBy("of").agg(F.greatest(F.ceil(F.sum("n") / BLOCK_SHINGLES), F.ceil(F.count("*") / BLOCK_SETS)).cast("int").alias("salts"), F.count("*").alias("rows"))
        # each class of a pool with the blocks of the classes beside it
        near = blocks.select(F.explode(F.array(*(F.struct(F.col("of.pool").alias("pool"), (F.col("of.class") + d).alias("class")) for d in (-1, 0, 1)))).alias("of"), F.struct(F.col("of.class").alias("class"), "salts").alias("x"))
        near = near.groupBy("of").agg(F.collect_list("x").alias("others"))  # three at most
        known = durable(blocks.join(near, "of"), "blocks")
        own = joined_by_key(nodes, known, "of", "rows").withColumn("block", F.struct("class", F.pmod(F.xxhash64("node"), F.col("salts")).cast("int").alias("salt")))
        met = own.withColumn("x", F.explode("others")).withColumn("salt2", F.explode(F.sequence(F.lit(0), F.col("x.salts") - 1)))
        other = F.struct(F.col("x.class").alias("class"), F.col("salt2").alias("salt"))
        met = met.select("pool", F.least("block", other).alias("lo"), F.greatest("block", other).alias("hi"), "node", "label")
        sent = known.select("of", F.aggregate("others", F.lit(0), lambda n, x: n + x["salts"]).alias("copies"))
        sent = nodes.groupBy("of").agg(F.sum("n").alias("n")).join(sent, "of").agg(F.coalesce(F.sum(F.col("n") * F.col("copies")), F.lit(0))).first()[0]
        parts = max(1, -(-sent // SENT_AT_ONCE))
        met = met.withColumn("turn", F.pmod(F.xxhash64("pool", "lo", "hi"), F.lit(parts)))
        each = lambda k: met.where(F.col("turn") == k).drop("turn").join(self.sets, "node")
        own = (each(k).groupBy("pool", "lo", "hi").applyInPandas(lambda rows: _joined(rows, sim), "a bigint, b bigint") for k in range(parts))
        return reduce(DataFrame.union, (durable(links, "block-links") for links in own))

    def result(self, nodes: DataFrame, labels: DataFrame) -> DataFrame:
        """Each document with the least id of its component: first that of equal sets, then that of linked ones."""
        each = nodes.select("doc_id", F.col("n").alias("n_shingles"), "node")
        own = durable(each.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("least"), F.count("*").alias("rows")), "least")
        known = durable(own.join(labels, "node"), "labelled")
        least = durable(known.groupBy("label").agg(F.min("least").alias("first"), F.count("*").alias("nodes")), "first")
        first = joined_by_key(known.select("node", "label", "rows"), least, "label", "nodes").select("node", F.col("first").alias("least"), "rows")
        first = durable(first.union(own.join(labels, "node", "left_anti").select("node", "least", "rows")), "components")
        drop(own, known, least)
        linked = joined_by_key(each.where("node is not null"), first, "node", "rows").select("doc_id", "n_shingles", F.col("least").alias("component_id"))
        return linked.unionByName(each.where("node is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))


def jaccard_components(docs: DataFrame, k: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """docs (doc_id, text, ...) -> doc_id, n_shingles, component_id; a row each.

    A document's set: its distinct shingles of k words (A-Z as a-z); with fewer words the whole sequence as one. Two documents are linked when
    den * intersection >= num * union; component_id is the smallest doc_id that links lead to. Documents without words, or with
    null text, have 0 shingles and are alone. Repeated rows and equal texts are linked. Rows with a null doc_id link as others do, but don't give
    the smallest id; a component of such rows alone has a null id. An empty table gives an empty result. Sets and
    shingles are known by 64-bit hashes. Other columns don't matter, whatever their names.
    """
    return _Join(docs, Similarity(k, num, den)).run()


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .common import table

    return jaccard_components(table(spark, sf_dir, "documents"), k=4, num=85, den=100)


#: All pairs that share a shingle, and what links reach: for tables that a single machine holds.
OP2_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) >= 4 THEN list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM words),
sizes AS (SELECT doc_id, len(s)::BIGINT AS n FROM sets),
each AS (SELECT doc_id, hash(unnest(s)) AS g FROM sets),
met AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM each a JOIN each b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT x, y FROM met JOIN sizes a ON a.doc_id = x JOIN sizes b ON b.doc_id = y WHERE 100 * c >= 85 * (a.n + b.n - c)),
ends AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reached AS (SELECT x, y FROM ends UNION SELECT r.x, b.y FROM reached r JOIN ends b ON r.y = b.x)
SELECT doc_id, n AS n_shingles, least(doc_id, coalesce(min(y), doc_id)) AS component_id FROM sizes LEFT JOIN reached ON x = doc_id GROUP BY doc_id, n
"""
