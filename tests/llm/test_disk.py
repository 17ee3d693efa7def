"""What stays on disk while an operator runs."""

import random

import pytest
from pyspark.sql import functions as F

from emend import session
from emend.llm import jaccard
from emend.llm.common import durable
from emend.session import stored

from test_set_operators import corpus, plain_components


def shuffle_files(spark):
    files = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().getAllFiles()
    return {files.apply(i).getName() for i in range(files.size()) if files.apply(i).getName().startswith("shuffle")}


@pytest.mark.parametrize("write", [durable, stored])
def test_a_stored_table_leaves_no_shuffle_files(spark, write):
    before = shuffle_files(spark)
    out = write(spark.range(10_000).groupBy((F.col("id") % 999).alias("k")).count(), "t")
    assert out.count() == 999
    left = shuffle_files(spark) - before
    assert len([f for f in left if f.endswith(".data")]) <= 2  # of the count alone


@pytest.mark.parametrize("write", [durable, stored])
def test_a_write_lets_a_full_driver_collect_garbage(spark, monkeypatch, write):
    beans = spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()
    full = lambda: sum(beans.get(i).getCollectionCount() for i in range(beans.size()) if "Old" in beans.get(i).getName())
    for name, value in (("HEAP_SHARE", 0.0), ("COLLECT_SECONDS", 0.0), ("_collected", 0.0)):
        monkeypatch.setattr(session, name, value)
    before = full()
    write(spark.range(10).toDF("k"), "t")
    assert full() > before
    monkeypatch.setattr(session, "HEAP_SHARE", 1.0)
    before = full()
    write(spark.range(10).toDF("k"), "t")
    assert full() == before


def test_open_lists_are_computed_once(spark):
    lists = spark.createDataFrame([(1, n, 10, 0, 0) for n in range(40)] + [(2, n, 10, 0, 0) for n in range(5)], "hash long, node long, n long, pos long, late long")
    labels = spark.createDataFrame([(n, 0) for n in range(30)], "node long, label long")
    join = jaccard._Join(spark.createDataFrame([], "doc_id long, text string"), jaccard.Similarity(5, 4, 5))
    members, found = join.still_open(lists, labels, 0)
    assert [r["hash"] for r in found.collect()] == [1] and members.count() == 40
    assert "Join" not in members._jdf.queryExecution().executedPlan().toString()


def test_pairs_and_blocks_are_compared_in_parts(spark, monkeypatch):
    rows = corpus(3)
    rng = random.Random(5)
    base = [f"x{rng.randrange(500)}" for _ in range(60)]
    for i in range(60):  # a group whose members are close to the threshold
        own = list(base)
        for _ in range(rng.randrange(8)):
            own[rng.randrange(60)] = f"y{rng.randrange(9)}"
        rows.append((10_000 + i, " ".join(own)))
    for name, value in (("PAIRS_AT_ONCE", 7), ("SENT_AT_ONCE", 2_000), ("CENTRE_ROUNDS", 1), ("LONG", 4), ("BLOCK_SETS", 8)):
        monkeypatch.setattr(jaccard, name, value)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), 4, 85, 100).collect()}
    assert got == plain_components(rows, 4, 85, 100)
