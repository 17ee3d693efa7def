"""Mixing sources to target weights by Pareto order sampling. DataFrame functions only.

A source whose target is more than its size takes whole copies of every document first. What is left of the target, R words, goes to a sample
of fixed size in which a document's inclusion probability is proportional to its words s: p = min(1, c s), with c so that the p s
of the source add up to R. Documents of probability 1 are certain copies. The others are ranked by their random odds over
their inclusion odds, q = (u / (1 - u)) / (p / (1 - p)), and taken by rising q until the next one would pass R; then the
order goes on among those that still fit what is left, and the last place goes to the next document that brings the source nearer to its target.

Order within a source is never sorted as a whole: q maps to (0, 1), equal slices of that are summed first, and only the slice in which the cut
falls is put in order. What was taken is told by the ranks at which cuts fell, a few numbers for each source.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import drop, durable, n_words

#: Slices of the rank within a source at least, and documents of a slice, about.
SLICES, PER_SLICE = 4096, 20_000
#: Times that the order is cut: once among all, then among those that fit what is left.
CUTS = 3
#: 13 hex digits of the digest are 52 bits, which a double holds.
_HEX_DIGITS, _RANGE = 13, float(1 << 52)


def uniform(key: Column, seed: int) -> Column:
    """A number in (0, 1) that depends on key and seed alone."""
    digits = F.substring(F.md5(F.concat(F.coalesce(key.cast("string"), F.lit("")), F.lit(f"#{seed}")).cast("binary")), 1, _HEX_DIGITS)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / F.lit(_RANGE)


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: Fraction = Fraction(3, 2), most: int = 2) -> DataFrame:
    """sizes (source, source_size) -> with target: the shared total by weight, no source above `most` times its size.

    Sources by code point, null last, get the weights in turn. Pouring the total in by weight, sources fill up in the order
    of most * size / weight; the level is the first at which the rest of the total, spread over those not yet full, overflows none.
    """
    alone = Window.partitionBy()
    order = Window.orderBy(F.col("source").asc_nulls_last())
    out = sizes.withColumn("nth", F.row_number().over(order))
    turn = (F.col("nth") - 1) % len(weights)
    out = out.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (turn + 1).cast("int")).cast("double"))
    out = out.withColumn("cap", (F.col("source_size") * most).cast("double"))
    total = F.sum("source_size").over(alone) * share.numerator / F.lit(float(share.denominator))
    filling = Window.orderBy(F.col("cap") / F.col("weight"), "nth")
    before = F.coalesce(F.sum("cap").over(filling.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    after = F.sum("weight").over(filling.rowsBetween(0, Window.unboundedFollowing))
    out = out.withColumn("level", (total - before) / after)
    level = F.min(F.when(F.col("level") <= F.col("cap") / F.col("weight"), F.struct(F.col("cap") / F.col("weight"), "nth", "level")))
    return out.withColumn("level", level.over(alone)["level"]).select("source", "source_size", F.coalesce(F.least("cap", F.col("weight") * F.col("level")), F.col("cap")).alias("target"))


def proportional(sizes: DataFrame) -> DataFrame:
    """sizes (sid, rest, size, n: documents of that size) -> sid, c, left: p = min(1, c * size) gives the rest; left is what certain documents leave of it.

    From the largest size down: those before are certain, and c spreads what they leave over the squares of the others. The first size that this
    doesn't make certain too ends the search. A source is a window of its distinct sizes.
    """
    down = Window.partitionBy("sid").orderBy(F.desc("size"))
    words = F.col("n") * F.col("size")
    out = sizes.withColumn("before", F.coalesce(F.sum(words).over(down.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    out = out.withColumn("squares", F.sum(words.cast("double") * F.col("size")).over(down.rowsBetween(0, Window.unboundedFollowing)))
    out = out.withColumn("c", (F.col("rest") - F.col("before")) / F.col("squares"))
    best = F.max(F.when(F.col("c") * F.col("size") < 1, F.struct("size", "c", (F.col("rest") - F.col("before")).alias("left"))))
    return out.groupBy("sid").agg(best.alias("b")).select("sid", "b.c", "b.left")


def _with(state: DataFrame, found: DataFrame) -> DataFrame:
    """state (sid, ...) with the columns of found (sid, ...), a row at most for each sid; null where it has none. Rows meet in a grouping: unlike a
    join, that builds no table to broadcast, which takes megabytes of the driver for a few rows, time after time."""
    both = state.unionByName(found, allowMissingColumns=True)
    return both.groupBy("sid").agg(*(F.max(c).alias(c) for c in both.columns if c != "sid"))


def _next_cut(ranked: DataFrame, state: DataFrame, turn: int) -> DataFrame:
    """state with cut{turn}, the rank at which the sum of the sizes still open passes what is left (null: it never does), and left{turn + 1}."""
    fits = _open(turn) if turn == 0 else _open(turn) & (F.col("size") <= F.col(f"left{turn}"))
    own = ranked.join(state, "sid").where(fits).select("sid", "slice", "size", F.col(f"left{turn}").alias("left"))
    sums = own.groupBy("sid", "slice", "left").agg(F.sum("size").alias("words"))
    sums = sums.withColumn("upto", F.sum("words").over(Window.partitionBy("sid").orderBy("slice")))
    # the slice of a source in which the sum passes, and what comes before it
    at = sums.groupBy("sid").agg(F.min(F.when(F.col("upto") > F.col("left"), F.struct("slice", (F.col("upto") - F.col("words")).alias("before")))).alias("at"), F.max("upto").alias("all"))
    at = durable(_with(state, at), "mix-slices")
    inside = ranked.join(at.where("at is not null").withColumn("slice", F.col("at.slice")), ["sid", "slice"]).where(fits).select("sid", "rank", "size", F.col(f"left{turn}").alias("left"), F.col("at.before").alias("before"))
    sofar = F.col("before") + F.sum("size").over(Window.partitionBy("sid").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))
    inside = inside.withColumn("sofar", sofar).groupBy("sid").agg(F.min(F.when(F.col("sofar") > F.col("left"), F.col("rank"))).alias(f"cut{turn}"), F.max(F.when(F.col("sofar") <= F.col("left"), F.col("sofar"))).alias("got"))
    got = F.when(F.col("at").isNull(), F.coalesce("all", F.lit(0))).otherwise(F.coalesce("got", F.col("at.before")))
    out = durable(_with(at, inside).withColumn(f"left{turn + 1}", F.col(f"left{turn}") - got).drop("at", "all", "got"), "mix-cuts")
    drop(at)
    return out


def _taken(turn: int) -> Column:
    """Taken at the cut of that turn; rows of the source's state are joined."""
    fits = F.lit(True) if turn == 0 else F.col("size") <= F.col(f"left{turn}")
    return fits & (F.col(f"cut{turn}").isNull() | (F.col("rank") < F.col(f"cut{turn}")))


def _open(turns: int) -> Column:
    """Not taken at any of the first cuts."""
    out = F.col("rank").isNotNull()
    for t in range(turns):
        out = out & ~_taken(t)
    return out


def _ranked(rows: DataFrame, state: DataFrame, seed: int) -> DataFrame:
    """rows (doc_id, source, size, row_no, ...) with their source's state, p and rank; the rank is null where nothing is drawn for."""
    p = F.when(F.col("size") == 0, 0.0).otherwise(F.least(F.lit(1.0), F.coalesce(F.col("c") * F.col("size"), F.lit(1.0))))
    u = uniform(F.col("doc_id"), seed)
    q = (u / (1 - u)) / (F.col("p") / (1 - F.col("p")))
    out = rows.join(state, F.col("source").eqNullSafe(F.col("of"))).drop("of").withColumn("p", p)
    out = out.withColumn("z", F.when((F.col("p") > 0) & (F.col("p") < 1), q / (1 + q)))
    return out.withColumn("rank", F.when(F.col("z").isNotNull(), F.struct("z", "row_no")))


def cuts(base: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: Fraction = Fraction(3, 2), most: int = 2, seed: int = 20) -> DataFrame:
    """base (doc_id, source, size, row_no), a stored table -> a row for each source: of (the source), its size, target, whole copies, c, and where the order was cut."""
    slices = max(SLICES, base.count() // PER_SLICE)
    targets = source_targets(base.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most)
    whole = F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(most))).otherwise(0).cast("long")
    rest = F.when(F.col("whole") < most, F.greatest(F.col("target") - F.col("whole") * F.col("source_size"), F.lit(0.0))).otherwise(0.0)
    targets = targets.withColumn("whole", whole).withColumn("rest", rest).withColumn("sid", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    targets = durable(targets.withColumnRenamed("source", "of"), "mix-targets")
    known = base.where("size > 0").join(targets, F.col("source").eqNullSafe(F.col("of")))
    odds = proportional(known.groupBy("sid", "rest", "size").agg(F.count("*").alias("n")))
    state = durable(_with(targets.drop("rest"), odds).withColumn("left0", F.coalesce("left", F.lit(0.0))).drop("left"), "mix-odds")
    ranked = _ranked(base, state, seed).where("rank is not null")
    ranked = durable(ranked.select("sid", "size", F.floor(F.col("z") * slices).cast("int").alias("slice"), "rank"), "mix-ranks")
    stale = [targets]
    for turn in range(CUTS):
        stale.append(state)
        state = _next_cut(ranked, state, turn)
    left = ranked.join(state, "sid").where(_open(CUTS) & (F.col("size") < 2 * F.col(f"left{CUTS}")))
    out = durable(_with(state, left.groupBy("sid").agg(F.min("rank")["row_no"].alias("last"))).drop("sid"), "mix-state")
    drop(ranked, state, *stale)
    return out


def with_copies(rows: DataFrame, state: DataFrame, seed: int = 20) -> DataFrame:
    """rows (doc_id, source, size, row_no, ...) with source_size, target, p and copies, told by their source's state alone."""
    drawn = F.when(F.col("rank").isNull(), F.col("p") == 1).otherwise(~_open(CUTS) | F.coalesce(F.col("row_no") == F.col("last"), F.lit(False)))
    out = _ranked(rows, state, seed).withColumn("copies", F.col("whole") + drawn.cast("long"))
    return out.select(*rows.columns, "source_size", "target", "p", "copies")


def mix(docs: DataFrame, *, size: Column | None = None, weights: tuple[int, ...] = (3, 1, 2), share: Fraction = Fraction(3, 2), most: int = 2, seed: int = 20) -> DataFrame:
    """docs (doc_id, source, text, ...) -> doc_id, size, source_size, target, copies, taken, p.

    A row each: taken is copies times size, 0 to `most` copies; p is the inclusion probability of the copy that is drawn for. Null source: a source of its
    own, last. Null or empty text: size 0, taken 0. Null doc_id: a document whose random number is that of the empty id. Repeated rows
    count each for itself, with one random number. An empty table gives an empty result. Other columns don't matter, whatever their names.
    """
    base = durable(docs.select("doc_id", "source", (size if size is not None else n_words(F.col("text"))).alias("size"), F.monotonically_increasing_id().alias("row_no")), "mix")
    out = with_copies(base, cuts(base, weights, share, most, seed), seed)
    return out.select("doc_id", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), "p")


def op5_mix(spark, sf_dir: str) -> DataFrame:
    from .common import table

    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def _cuts_sql() -> str:
    """The cuts, one after the other: each a running sum over what is open in the order of z."""
    out = "open0 AS (SELECT *, z IS NOT NULL AS open, left0 AS left_ FROM ranked),\n"
    for t in range(CUTS):
        fits = "open" if t == 0 else "open AND size <= left_"
        out += f"""sum{t} AS (SELECT *, {fits} AND sum(CASE WHEN {fits} THEN size ELSE 0 END) OVER (PARTITION BY sid ORDER BY z, row_no ROWS UNBOUNDED PRECEDING) <= left_ AS now FROM open{t}),
open{t + 1} AS (SELECT * EXCLUDE (now, open, left_), open AND NOT now AS open, left_ - sum(CASE WHEN now THEN size ELSE 0 END) OVER (PARTITION BY sid) AS left_ FROM sum{t}),
"""
    return out


OP5_SQL = rf"""
WITH base AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         (('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || '#20'), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0 AS u,
         row_number() OVER () AS row_no
  FROM documents),
sizes AS (SELECT source, sum(size)::BIGINT AS source_size FROM base GROUP BY source),
weighed AS (
  SELECT *, (CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END)::DOUBLE AS weight, row_number() OVER (ORDER BY source NULLS LAST) AS nth,
         source_size * 2.0::DOUBLE AS cap, sum(source_size) OVER () * 3 / 2.0::DOUBLE AS total FROM sizes),
levels AS (
  SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY cap / weight, nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
            / sum(weight) OVER (ORDER BY cap / weight, nth ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM weighed),
targets AS (
  SELECT source, source_size, coalesce(least(cap, weight * (SELECT arg_min(level, (cap / weight, nth)) FROM levels WHERE level <= cap / weight)), cap) AS target FROM levels),
parts AS (
  SELECT *, CASE WHEN source_size > 0 THEN least(floor(target / source_size), 2)::BIGINT ELSE 0 END AS whole, row_number() OVER (ORDER BY source NULLS LAST) AS sid FROM targets),
rests AS (SELECT *, CASE WHEN whole < 2 THEN greatest(target - whole * source_size, 0.0) ELSE 0.0 END AS rest FROM parts),
known AS (SELECT b.*, sid, source_size, target, whole, rest FROM base b JOIN rests r ON b.source IS NOT DISTINCT FROM r.source),
counted AS (SELECT sid, rest, size, count(*) AS n FROM known WHERE size > 0 GROUP BY ALL),
spread AS (
  SELECT sid, size, rest - coalesce(sum(n * size) OVER (PARTITION BY sid ORDER BY size DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS left0,
         sum(n * size * size) OVER (PARTITION BY sid ORDER BY size DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::DOUBLE AS squares FROM counted),
odds AS (SELECT sid, arg_max(left0 / squares, size) AS c, arg_max(left0, size) AS left0 FROM spread WHERE left0 / squares * size < 1 GROUP BY sid),
chances AS (
  SELECT k.*, coalesce(left0, 0.0) AS left0, CASE WHEN size = 0 THEN 0.0 ELSE least(1.0::DOUBLE, coalesce(c * size, 1.0)) END AS p FROM known k LEFT JOIN odds USING (sid)),
ranked AS (
  SELECT *, CASE WHEN p > 0 AND p < 1 THEN (u / (1 - u)) / (p / (1 - p)) / (1 + (u / (1 - u)) / (p / (1 - p))) END AS z FROM chances),
{_cuts_sql()}last_ AS (SELECT sid, arg_min(row_no, (z, row_no)) AS last FROM open{CUTS} WHERE open AND size < 2 * left_ GROUP BY sid)
SELECT doc_id, size, source_size, target,
       (whole + CASE WHEN z IS NULL THEN (p = 1)::INTEGER ELSE (NOT open OR coalesce(row_no = last, false))::INTEGER END)::BIGINT * size AS taken
FROM open{CUTS} LEFT JOIN last_ USING (sid)
"""
