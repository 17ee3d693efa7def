"""One order of a whole table, in many parts."""

import random

import pytest
from pyspark.sql import functions as F

from emend.operators import ordering, retrieval


@pytest.fixture(autouse=True)
def small_parts(monkeypatch):
    monkeypatch.setattr(ordering, "PER_BUCKET", 50)


def made(n, seed=0):
    rng = random.Random(seed)
    return [(f"{i}_bea" if i % 3 else None, rng.choice(["x", "y"]), i, rng.randrange(-5, 9), rng.random()) for i in range(n)]


COLUMNS = "id string, same string, no long, w int, share double"


def test_text_ids(spark):
    rows = made(1003)
    got = ordering.numbered(spark.createDataFrame(rows, COLUMNS).repartition(7), ["id", "no"], "place").collect()
    want = sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[2]))
    assert [tuple(r)[:5] for r in sorted(got, key=lambda r: r.place)] == want and [r.place for r in sorted(got, key=lambda r: r.place)] == list(range(1003))


def test_a_constant_first_key_is_cut_by_the_others(spark):
    rows = spark.createDataFrame(made(1000), COLUMNS).withColumn("same", F.lit("x"))
    parts = ordering._in_parts(rows, ["same", F.desc("no")], [])
    assert parts.groupBy("__part").count().agg(F.max("count")).first()[0] < 200
    got = ordering.numbered(rows, ["same", F.desc("no")], "place").collect()
    assert all(r.place == 999 - r.no for r in got)


def test_rows_that_are_equal_in_all_keys(spark):
    rows = spark.createDataFrame([("x",)] * 1000, "id string")
    assert ordering._in_parts(rows, ["id"], []).groupBy("__part").count().agg(F.max("count")).first()[0] < 200
    assert sorted(r.place for r in ordering.numbered(rows, ["id"], "place").collect()) == list(range(1000))


def test_running_sums(spark):
    rows = made(700, 3)
    got = ordering.running_sums(spark.createDataFrame(rows, COLUMNS).repartition(5), {"a": F.col("w"), "n": F.lit(1), "s": F.col("share")}, ["same", "no"]).collect()
    a = n = s = 0
    for r, want in zip(sorted(got, key=lambda r: r.n), sorted(rows, key=lambda r: (r[1], r[2])), strict=True):
        a, n, s = a + want[3], n + 1, s + want[4]
        assert (r.id, r.a, r.n) == (want[0], a, n) and abs(r.s - s) < 1e-9


def test_sampling_from_a_large_pool_with_text_ids(spark):
    pool = spark.createDataFrame([(f"x{i:05}",) for i in range(400)], "id string")
    lines = spark.range(60).toDF("line_no")
    found = retrieval.sampled(lines, pool, 5).collect()
    assert len(found) == 300 and len({(r.line_no, r.id) for r in found}) == 300 and len({r.id for r in found}) > 150
    assert retrieval.drawn(lines, pool, 5).count() == 300


def test_no_rows(spark):
    assert ordering.numbered(spark.range(0), ["id"], "place").collect() == []
    assert ordering.running(spark.range(0), F.col("id"), ["id"], "s").collect() == []
