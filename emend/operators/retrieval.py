"""Choosing demonstrations: neighbours of error sites, random correct examples, how many a sentence gets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import words
from ..session import stored
from .ordering import numbered, running, running_sums
from .vectors import cosine_top


def short_enough(text: Column, most: int = 200) -> Column:
    return F.size(words(text)) <= most


def last_vector(rows: DataFrame) -> DataFrame:
    """rows (text, seq, vec): one vector for each text, that of its last row. The similarity index may be keyed by text; later tables (larger
    seq) then replace earlier ones."""
    return rows.groupBy("text").agg(F.max_by("vec", "seq").alias("vec"))


def site_neighbours(sites: DataFrame, train: DataFrame, k: int, floor: int = 0, by_text: bool = False) -> DataFrame:
    """sites (line_no, site_id, pc1, vec), train (id, text, label, key, vec) -> line_no, site_rank, rank, id, text, label, key, similarity.

    k or the floor, whichever is more. Sites of a line go by falling |pc1|. Training texts of over 200 words take no part. by_text: vectors of both sides are
    looked up by key (sites have one then), in one index in which test sites come after, and so over, training sites.
    """
    rows = train.where(short_enough(F.col("key")))
    if by_text:
        seq = lambda side, c: F.struct(F.lit(side).alias("side"), F.col(c).cast("bigint").alias("at")).alias("seq")
        both = train.select(F.col("key").alias("text"), seq(0, "id"), "vec").union(sites.select(F.col("key").alias("text"), seq(1, "site_id"), "vec"))
        shared = last_vector(both).withColumnRenamed("text", "key")
        rows, sites = rows.drop("vec").join(shared, "key"), sites.drop("vec").join(shared, "key")
    found = cosine_top(sites.select(F.col("site_id").alias("id"), "vec"), rows.select("id", "vec"), max(k, floor))
    order = Window.partitionBy("line_no").orderBy(F.abs("pc1").desc(), "site_id")
    ranked = sites.withColumn("site_rank", F.row_number().over(order)).select("line_no", "site_id", "site_rank")
    return found.join(ranked, found["query"] == ranked["site_id"]).join(rows.select("id", "text", "label", "key"), "id").select("line_no", "site_rank", "rank", "id", "text", "label", "key", "similarity")


def drawn_number(key: Column, draw: Column | int, seed: int) -> Column:
    """A whole number below 2 ** 52 for each key and draw, from a digest that other engines have too."""
    parts = F.concat_ws("|", key.cast("string"), (draw if isinstance(draw, Column) else F.lit(draw)).cast("string"), F.lit(str(seed)))
    return F.conv(F.substring(F.md5(parts.cast("binary")), 1, 13), 16, 10).cast("bigint")


def sampled(lines: DataFrame, pool: DataFrame, n: int, key: str = "line_no", seed: int = 0) -> DataFrame:
    """For each line n different rows of a pool (id, ...), each set of n as likely as any other: lines (key) x n with the pool's columns and `draw`.

    Rows of the pool have places from 0 without gaps. Draw d takes a place among the first N - n + d, or the last of these if that place is
    taken already: n places that differ, in one pass over n numbers. A pool of fewer than n rows gives all of them to each line.
    """
    size = pool.agg(F.least(F.count("*"), F.lit(n)).alias("__k"), F.count("*").alias("__size"))
    asked = lines.select(key).crossJoin(F.broadcast(size))  # one row

    def step(acc: Column, d: Column) -> Column:
        last = F.col("__size") - F.col("__k") + d - 1
        at = F.pmod(drawn_number(F.col(key), d, seed), last + 1)
        return F.concat(acc, F.array(F.when(F.array_contains(acc, at), last).otherwise(at)))

    draws = F.when(F.col("__k") > 0, F.sequence(F.lit(1).cast("bigint"), F.col("__k"))).otherwise(F.array().cast("array<bigint>"))
    places = F.aggregate(draws, F.array().cast("array<bigint>"), step)
    asked = asked.select(key, F.posexplode(places).alias("draw", "place")).withColumn("draw", F.col("draw") + 1)
    return asked.join(numbered(pool, ["id"], "place"), "place").drop("place")


def drawn(lines: DataFrame, pool: DataFrame, n: int, key: str = "line_no", seed: int = 0) -> DataFrame:
    """For each line n rows of a pool (id, ...), drawn with replacement: each draw is a place of its own."""
    size = pool.agg(F.count("*").alias("size"))
    placed = numbered(pool, ["id"], "place")
    asked = lines.select(key).withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(n)))).crossJoin(F.broadcast(size))  # one row
    return asked.withColumn("place", F.pmod(drawn_number(F.col(key), F.col("draw"), seed), F.col("size"))).drop("size").join(placed, "place").drop("place")


def random_sign(key: Column, seed: int = 0) -> Column:
    return F.when(F.pmod(drawn_number(key, 0, seed), F.lit(2)) == 0, 1).otherwise(-1)


def min_max(value: Column, *keys: str) -> Column:
    """0 to 1 within a group; all equal: 1."""
    group = Window.partitionBy(*keys)
    low, high = F.min(value).over(group), F.max(value).over(group)
    return F.when(low == high, 1.0).otherwise((value - low) / F.nullif(high - low, F.lit(0.0)))


def merged_examples(examples: DataFrame, n: int, key: str = "line_no") -> DataFrame:
    """examples (key, data_item_id, similarity, ...): one for each item, similarities summed, by falling similarity; if these are fewer than n, items
    that occurred several times are repeated, a round of all such items at a time."""
    item = examples.groupBy(key, "data_item_id").agg(F.sum("similarity").alias("similarity"), F.count("*").alias("times"))
    item = item.withColumn("turn", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))))
    order = Window.partitionBy(key).orderBy("turn", F.desc("similarity"), "data_item_id")
    return item.withColumn("rank", F.row_number().over(order)).withColumn("items", F.count(F.when(F.col("turn") == 1, 1)).over(Window.partitionBy(key))).where((F.col("turn") == 1) | (F.col("rank") <= n)).drop("items")


def limits(rows: DataFrame, least: int, most: int, average: float, order: str = "idx") -> DataFrame:
    """rows (order, available) with `limit`: largest-remainder shares of a total.

    Each gets least to most (as far as available); the total is average (at most `most`) times the rows, rounded half to even and kept
    within these bounds. What goes beyond the least is dealt in proportion to what a row can still take; what rounding leaves goes to the largest
    fraction, then capacity, then available, then the earlier row. Totals are one small row; the leftovers are cut by rank.
    """
    least = max(0, min(least, most))
    low, high = F.least(F.lit(least), F.col("available")), F.least(F.lit(most), F.col("available"))
    rows = rows.withColumn("low", low.cast("bigint")).withColumn("capacity", (high - low).cast("bigint")).persist()  # two numbers a row, read several times
    total = rows.agg(F.sum("low").alias("low_total"), F.sum("capacity").alias("room"), F.count("*").alias("n"))
    target = F.greatest(F.col("low_total"), F.least(F.bround(F.lit(min(max(0.0, average), float(most))) * F.col("n")).cast("bigint"), F.col("low_total") + F.col("room")))
    total = total.withColumn("remaining", target - F.col("low_total"))
    out = rows.crossJoin(F.broadcast(total))  # one row
    raw = F.coalesce(F.try_divide((F.col("remaining") * F.col("capacity")).cast("double"), F.col("room").cast("double")), F.lit(0.0))
    out = out.withColumn("raw", raw).withColumn("add", F.least(F.col("capacity"), F.floor("raw").cast("bigint")))
    out = out.withColumn("fraction", F.col("raw") - F.col("add"))
    # rows with one number available are alike but for their place: a few such groups are ranked, and only the last one that gets something is put in order
    alike = out.where((F.col("capacity") > F.col("add")) & (F.col("fraction") > 0)).groupBy("fraction", "capacity", "available").agg(F.count("*").alias("k"))
    left = out.agg((F.max("remaining") - F.sum("add")).alias("left"))
    upto = F.sum("k").over(Window.orderBy(F.desc("fraction"), F.desc("capacity"), F.desc("available")))
    alike = alike.withColumn("upto", upto).crossJoin(F.broadcast(left))  # one row
    served = alike.where(F.col("upto") - F.col("k") < F.col("left")).select("available", (F.col("left") - F.col("upto") + F.col("k")).alias("take"), (F.col("upto") <= F.col("left")).alias("all"))
    own = out.join(F.broadcast(served), "available")  # a row for each number available
    cut = numbered(own.where("not all").select(order, "take"), [order], "place").where(F.col("place") < F.col("take"))
    extra = own.where("all").select(order).union(cut.select(order)).withColumn("extra", F.lit(1))
    out = out.join(extra, order, "left")
    return out.select(*(c for c in rows.columns if c not in ("low", "capacity")), (F.col("low") + F.col("add") + F.coalesce("extra", F.lit(0))).alias("limit"))


def limit_stats(rows: DataFrame) -> DataFrame:
    """One row: least, most and mean of the limits."""
    return rows.agg(F.min("limit").alias("least"), F.max("limit").alias("most"), F.avg("limit").alias("mean"))


def first_examples(examples: DataFrame, limits_: DataFrame, key: str = "line_no") -> DataFrame:
    """examples (key, rank, ...) up to each line's limit."""
    return examples.join(limits_.select(key, "limit"), key).where(F.col("rank") <= F.col("limit")).drop("limit")


def example_lists(neighbours: DataFrame, correct: DataFrame, source: str, key: str = "line_no") -> DataFrame:
    """neighbours and sampled correct examples -> (key, in_domain_examples), in the order in which a limit cuts them: sites, neighbours of each, correct ones."""
    near = neighbours.select(key, F.col("site_rank").cast("bigint").alias("a"), F.col("rank").cast("bigint").alias("b"), F.col("id").cast("bigint").alias("id"), "text", "label", F.col("key").alias("k"), F.col("similarity").cast("double").alias("similarity"))
    last = correct.select(key, F.lit(1 << 40).cast("bigint").alias("a"), F.col("draw").cast("bigint").alias("b"), F.lit(-1).cast("bigint").alias("id"), "text", "label", F.lit("Cor").alias("k"), F.lit(0.0).alias("similarity"))
    both = near.unionByName(last)
    own = F.struct("id", "text", "label", F.lit(source).alias("from"), F.col("k").alias("key"), "similarity")
    return both.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("a", "b", own.alias("x")))), lambda e: e["x"]).alias("in_domain_examples"))


def retrieval_rows(lines: DataFrame, examples: DataFrame, test: str, key: str = "line_no") -> DataFrame:
    """A row for each sentence, also those without sites: id, from, text, key_in_domain, in_domain_examples, key_cross_domain, cross_domain_examples."""
    kind = examples.schema["in_domain_examples"].dataType.simpleString()
    none = F.array().cast(kind)
    out = lines.join(examples, key, "left")
    return out.select(F.concat_ws("_", F.col(key).cast("string"), F.lit(test)).alias("id"), F.lit(test).alias("from"), F.col("src").alias("text"), F.lit("").alias("key_in_domain"), F.coalesce("in_domain_examples", none).alias("in_domain_examples"), F.lit("").alias("key_cross_domain"), none.alias("cross_domain_examples"))


def retrieval_stats(rows: DataFrame) -> DataFrame:
    """One row: sentences, examples, correct ones, and both for each sentence."""
    n, good = F.size("in_domain_examples"), F.size(F.filter("in_domain_examples", lambda e: e["text"] == e["label"]))
    out = rows.agg(F.count("*").alias("sentences"), F.sum(n).alias("examples"), F.sum(good).alias("correct"))
    return out.withColumn("per_sentence", F.try_divide("examples", "sentences")).withColumn("correct_per_sentence", F.try_divide("correct", "sentences"))


def balanced_ranges(weights: DataFrame, shards: int, order: str = "idx") -> DataFrame:
    """weights (order: numbers from 0 without gaps, weight: not negative) -> shard, start, end: contiguous ranges, closed as soon as they reach the even share.

    The range that would begin at a row ends where the running sum first reaches the share from there: one running count over rows and beginnings in
    the order of their sums gives the next beginning of every row. Jumps of 1, 2, 4, ... ranges then give all beginnings from row 0 in log2(shards) joins.
    """
    spark = weights.sparkSession
    kind = "shard int, start bigint, end bigint"
    total = weights.agg(F.count("*").alias("n"), F.sum("weight").alias("w")).first()
    n = total["n"]
    if not n:
        return spark.createDataFrame([], kind)
    shards = max(1, min(shards, n))
    share = max(1, -(-total["w"] // shards))
    cuts = _beginnings(weights, shards, order, share, n) if shards > 1 else []
    out, start = [], 0
    for at in cuts[: shards - 1]:
        if n - at < shards - len(out) - 1:  # too few rows would stay for the other ranges
            break
        out.append((len(out), start, at))
        start = at
    return spark.createDataFrame([*out, (len(out), start, n)], kind)


def _beginnings(weights: DataFrame, shards: int, order: str, share: int, n: int) -> list[int]:
    """Where the ranges after the first would begin, shards at most."""
    sums = stored(running(weights.select(F.col(order).cast("bigint").alias("i"), "weight"), F.col("weight"), ["i"], "upto"), "sums")
    wanted = sums.select("i", (F.col("upto") - F.col("weight") + share).alias("at"), F.lit(0).alias("row"))
    both = wanted.union(sums.select("i", "upto", F.lit(1)))
    counted = running_sums(both, {"before": F.col("row")}, ["at", "row"])
    jump = stored(counted.where("row = 0").select("i", (F.col("before") + 1).alias("to")).where(F.col("to") < n), "jumps")
    reached, step = weights.sparkSession.range(1).select(F.lit(0).alias("k"), F.col("id").alias("i")), 1
    while True:
        reached = reached.union(F.broadcast(reached).join(jump, "i").select((F.col("k") + step).alias("k"), F.col("to").alias("i")))  # shards rows at most
        step *= 2
        if step >= shards:
            return [r["i"] for r in reached.where("k > 0").orderBy("k").collect()]
        jump = stored(jump.join(jump.select(F.col("i").alias("to"), F.col("to").alias("next")), "to").select("i", F.col("next").alias("to")), "jumps")


def modulo_shard(index: Column, shards: int) -> Column:
    return F.pmod(index, F.lit(shards))


def merged_shards(*shards: DataFrame, index: str = "__original_index") -> DataFrame:
    """All shards' rows, with an error for an index that is there twice or not at all."""
    rows = shards[0]
    for s in shards[1:]:
        rows = rows.unionByName(s, allowMissingColumns=True)
    audit = rows.agg(F.count("*").alias("n"), F.count_distinct(index).alias("d"), F.max(index).alias("m")).first()
    if audit["n"] != audit["d"]:
        raise ValueError("an index is there twice")
    if audit["n"] and audit["m"] + 1 != audit["n"]:
        raise ValueError(f"missing: {[r[0] for r in missing(rows, index, audit['m'] + 1).limit(10).collect()]}")
    return rows


def missing(rows: DataFrame, index: str, n: int) -> DataFrame:
    return rows.sparkSession.range(n).toDF(index).join(rows.select(index), index, "left_anti")


def joined_by_id(rows: DataFrame, retrieved: DataFrame) -> DataFrame:
    """Rows with the retrieval row of their id; a row without one is an error when it is read."""
    out = rows.join(retrieved.select("id", *(c for c in retrieved.columns if c not in rows.columns)), "id", "left")
    first = next(c for c in retrieved.columns if c not in rows.columns)
    return out.withColumn(first, F.when(F.col(first).isNotNull(), F.col(first)).otherwise(F.raise_error(F.concat(F.lit("no retrieval row for "), F.col("id")))))


def dataset_relation(spec: str, rows: DataFrame) -> DataFrame:
    """`test:train1,train2;...` as (test, train), for the names that rows (from) have."""
    spark = rows.sparkSession
    one = spark.range(1).select(F.explode(F.split(F.lit(spec), ";")).alias("part"))
    pair = F.split("part", ":")
    relation = one.select(F.trim(F.get(pair, F.lit(0))).alias("test"), F.explode(F.split(F.get(pair, F.lit(1)), ",")).alias("train")).withColumn("train", F.trim("train"))
    return relation.join(rows.select(F.col("from").alias("train")).distinct(), "train", "left_semi")


def unknown_names(wanted: DataFrame, known: DataFrame) -> DataFrame:
    return wanted.select("name").exceptAll(known.select("name"))


def pool(*sources: DataFrame) -> DataFrame:
    """All training rows; the row that stands for a missing split left out."""
    from ..sources.readers import not_blank

    out = sources[0]
    for s in sources[1:]:
        out = out.unionByName(s, allowMissingColumns=True)
    return not_blank(out)


#: Ways to choose examples without a similarity index.
STRATEGIES = {"random": drawn, "default": drawn, "sample": sampled}


def tail_split(rows: DataFrame, test_percent: float, valid_percent: float = 0.0, order: str = "line_no") -> DataFrame:
    """rows with `split`: the last percents of the order are test, those before them valid."""
    n = rows.agg(F.count("*").alias("n"))
    place = F.col(order) / F.col("n")
    cut, cut2 = 1 - test_percent / 100, 1 - (test_percent + valid_percent) / 100
    return rows.crossJoin(F.broadcast(n)).withColumn("split", F.when(place >= cut, "test").when(place >= cut2, "valid").otherwise("train")).drop("n")  # one row


def best_row(rows: DataFrame, metric: str, largest: bool = True) -> DataFrame:
    """The one row of a log whose metric is best; rows without it don't count."""
    known = rows.where(F.col(metric).isNotNull())
    pick = F.max_by if largest else F.min_by
    return known.agg(pick(F.struct(*rows.columns), F.col(metric)).alias("r")).where("r is not null").select("r.*")
