from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from emend.operators import hints, models, prompts, retrieval, vectors


def vectors_df(spark, x):
    return spark.createDataFrame(pd.DataFrame({"id": np.arange(len(x)), "vec": [v.tolist() for v in x]}), "id long, vec array<double>")


@pytest.mark.parametrize(("average", "want"), [(8, [0, 1, 5, 10]), (3, [0, 1, 4, 7])])
def test_limits(spark, average, want):
    rows = spark.createDataFrame(list(enumerate([0, 1, 5, 12])), "idx long, available long")
    assert [r["limit"] for r in retrieval.limits(rows, 2, 10, average).orderBy("idx").collect()] == want


def test_limits_sum_to_the_clamped_target(spark):
    rng = np.random.RandomState(0)
    have = rng.randint(0, 15, 40).tolist()
    got = [r["limit"] for r in retrieval.limits(spark.createDataFrame(list(enumerate(have)), "idx long, available long"), 2, 10, 5.0).orderBy("idx").collect()]
    low, high = [min(2, a) for a in have], [min(10, a) for a in have]
    assert all(a <= g <= b for a, g, b in zip(low, got, high, strict=True))
    assert sum(got) == max(sum(low), min(200, sum(high)))


def test_balanced_ranges(spark):
    rows = spark.createDataFrame(list(enumerate([1, 1, 4, 1])), "idx long, weight long")
    assert [(r.start, r.end) for r in retrieval.balanced_ranges(rows, 2).orderBy("shard").collect()] == [(0, 3), (3, 4)]
    many = spark.createDataFrame(list(enumerate([3] * 50)), "idx long, weight long")
    found = retrieval.balanced_ranges(many, 7).orderBy("shard").collect()
    assert found[0].start == 0 and found[-1].end == 50 and all(a.end == b.start for a, b in zip(found, found[1:]))
    assert retrieval.balanced_ranges(rows.limit(0), 3).count() == 0


def test_min_max(spark):
    rows = spark.createDataFrame([(0, 0.2), (0, 0.5), (0, 0.8), (1, 0.3), (1, 0.3)], "k int, s double")
    got = [round(r.v, 6) for r in rows.select("k", "s", retrieval.min_max(F.col("s"), "k").alias("v")).orderBy("k", "s").collect()]
    assert got == [0.0, 0.5, 1.0, 1.0, 1.0]


def test_cosine_top_is_exact(spark):
    x = np.random.RandomState(1).randn(60, 8)
    got = vectors.cosine_top(vectors_df(spark, x[:10]), vectors_df(spark, x), 4).collect()
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    for q in range(10):
        want = np.lexsort((np.arange(60), -np.round(u @ u[q], 9)))[:4].tolist()
        assert [r.id for r in sorted((r for r in got if r["query"] == q), key=lambda r: r["rank"])] == want and want[0] == q


def test_scaling_and_components(spark):
    x = np.random.RandomState(2).randn(100, 5) @ np.diag([5, 3, 2, 1, 0]) + 2
    df = vectors_df(spark, x)
    m = vectors.moments(df)
    assert np.allclose(m.mean, x.mean(0)) and np.allclose(m.deviation, x.std(0))
    z = np.array([r.v for r in df.select("id", vectors.scaled(F.col("vec"), m).alias("v")).orderBy("id").collect()])
    dev = np.where(x.std(0) > 1e-12, x.std(0), 1)
    assert np.allclose(z, (x - x.mean(0)) / dev)
    c = vectors.principal(df, 3)
    assert (np.diff(c.explained) <= 1e-12).all() and (c.explained >= 0).all()
    got = np.array([r.projected for r in vectors.in_components(df, c).orderBy("id").collect()])
    _, s, v = np.linalg.svd(x - x.mean(0), full_matrices=False)
    assert np.allclose(np.abs(got), np.abs((x - x.mean(0)) @ v[:3].T), atol=1e-8)
    assert np.allclose(c.explained, (s**2 / (s**2).sum())[:3])


def test_directions(spark):
    rows = spark.createDataFrame([(1, [1.0, 2.0]), (1, [3.0, 4.0]), (0, [1.0, 1.0])], "label int, vec array<double>")
    assert vectors.class_mean_direction(rows).first().direction == [1.0, 2.0]
    pairs = spark.createDataFrame([(0, [3.0]), (1, [1.0]), (2, [5.0]), (3, [7.0])], "pos long, vec array<double>")
    assert [(r.pair, r.vec) for r in vectors.pair_differences(pairs).orderBy("pair").collect()] == [(0, [2.0]), (1, [-2.0])]
    scores = spark.createDataFrame([(0, 1.0, True), (0, 0.0, False), (1, 2.0, True), (1, 5.0, False), (2, 3.0, True), (2, 1.0, False)], "group int, score double, is_label boolean")
    assert vectors.direction_sign(scores).first().sign == 1
    assert set(vectors.DIRECTIONS) == {"pca", "cluster_mean", "random"} and len(vectors.DIRECTIONS["random"](rows)) == 2
    assert rows.select(vectors.plus(F.col("vec"), F.col("vec"), 2.0).alias("v")).first().v == [3.0, 6.0]
    assert rows.select(vectors.plus_by_sign(F.col("vec"), F.array(F.lit(-1.0), F.lit(0.0))).alias("v")).first().v == [2.0, 2.0]


def test_sampling(spark):
    lines, pool = spark.range(50).toDF("line_no"), spark.range(200).toDF("id")
    got = retrieval.sampled(lines, pool, 3).collect()
    by_line = {k: [r.id for r in got if r.line_no == k] for k in range(50)}
    assert all(len(v) == 3 == len(set(v)) for v in by_line.values()) and len({r.id for r in got}) > 60
    assert sorted(map(tuple, got)) == sorted(map(tuple, retrieval.sampled(lines, pool, 3).collect()))
    assert retrieval.drawn(lines, pool, 2).count() == 100
    # every row of a small pool can be drawn, and pairs are as likely as any other
    small = spark.range(40).toDF("id")
    drawn = retrieval.sampled(spark.range(4000).toDF("line_no"), small, 2).collect()
    times = Counter(r.id for r in drawn)
    assert len(times) == 40 and all(140 < n < 260 for n in times.values())
    pairs = {}
    for r in drawn:
        pairs.setdefault(r.line_no, set()).add(r.id)
    assert len({frozenset(p) for p in pairs.values()}) > 700
    assert retrieval.sampled(lines, spark.range(2).toDF("id"), 3).count() == 100 and retrieval.sampled(lines, small.limit(0), 3).count() == 0
    assert {r.s for r in lines.select(retrieval.random_sign(F.col("line_no")).alias("s")).collect()} == {1, -1}


def test_shards_are_audited(spark):
    rows = spark.createDataFrame([(0,), (1,), (3,)], "__original_index long")
    with pytest.raises(ValueError, match="2"):
        retrieval.merged_shards(rows)
    with pytest.raises(ValueError, match="twice"):
        retrieval.merged_shards(rows, rows)
    assert retrieval.merged_shards(rows, spark.createDataFrame([(2,)], "__original_index long")).count() == 4


def test_examples_merge_and_repeat(spark):
    rows = spark.createDataFrame([(0, 7, 0.5), (0, 7, 0.4), (0, 8, 0.6), (1, 9, 1.0)], "line_no long, data_item_id long, similarity double")
    got = [(r.line_no, r.data_item_id) for r in retrieval.merged_examples(rows, 3).orderBy("line_no", "rank").collect()]
    assert got == [(0, 7), (0, 8), (0, 7), (1, 9)]


def test_neighbours_and_rows(spark):
    train = spark.createDataFrame([(i, f"t{i}", f"l{i}", f"t{i}\td", [float(i), 1.0]) for i in range(6)], "id long, text string, label string, key string, vec array<double>")
    sites = spark.createDataFrame([(0, 10, 0.1, [1.0, 1.0]), (0, 11, -0.9, [5.0, 1.0])], "line_no long, site_id long, pc1 double, vec array<double>")
    near = retrieval.site_neighbours(sites, train, 2, 3)
    assert near.count() == 6 and near.where("site_rank = 1 and rank = 1").first().id == 5
    keyed = sites.withColumn("key", F.when(F.col("site_id") == 10, "t5\td").otherwise("other"))
    by_text = retrieval.site_neighbours(keyed, train, 2, by_text=True)
    assert by_text.count() == 4 and [r.id for r in by_text.where("site_rank = 2").orderBy("rank").collect()] == [1, 5]  # the test site's vector stands for the training site of that key
    lines = spark.createDataFrame([(0, "a"), (1, "b")], "line_no long, src string")
    pool = train.select("id", "text", F.col("text").alias("label"))
    lists = retrieval.example_lists(near, retrieval.sampled(lines, pool, 1), "train")
    rows = retrieval.retrieval_rows(lines, lists, "test").orderBy("id").collect()
    assert [len(r.in_domain_examples) for r in rows] == [7, 1] and rows[0].in_domain_examples[-1].key == "Cor" and rows[0].id == "0_test"
    stats = retrieval.retrieval_stats(retrieval.retrieval_rows(lines, lists, "test")).first()
    assert (stats.examples, stats.correct) == (8, 2)
    with pytest.raises(Exception, match="no retrieval row"):
        retrieval.joined_by_id(spark.createDataFrame([("9_test",)], "id string"), retrieval.retrieval_rows(lines, lists, "test").drop("text")).collect()


@pytest.mark.parametrize(
    ("old", "new", "kind"),
    [("the", "a", "determiner or article"), ("in", "on", "preposition"), ("recieve", "receive", "spelling"), ("walk", "walked", "word form"), ("teh", "the", "word choice"), (",", ".", "punctuation"), ("Cat", "cat", "spacing or tokenization"), ("go there", "there go", "word order"), ("", "", "")],
)
def test_kinds_of_change(old, new, kind):
    assert hints.kind_of_change(old, new) == kind


def test_hints(spark):
    rows = spark.createDataFrame(
        [(0, 1, 1, "a the b", "a a b", "k", 0.9, "x"), (0, 2, 2, "see the b", "see a b", "k", 0.5, "x"), (0, 3, -1, "q", "q", "Cor", 0.0, "x"), (1, 1, 4, "same", "same", "k", 0.2, "x")],
        "line_no long, rank int, id long, text string, label string, key string, similarity double, `from` string",
    )
    voted = hints.votes(rows)
    top = hints.ranked_types(voted).collect()
    assert [(r.line_no, r.hint_type, r.votes, r.best_span) for r in top] == [(0, "determiner or article", 2, "the -> a")]
    text = {r.line_no: r.description for r in hints.descriptions(voted).collect()}
    assert "the -> a" in text[0]
    assert {r.line_no: r.description == "" for r in hints.descriptions(voted, "span").collect()} == {0: False, 1: True}
    assert hints.descriptions(voted, most=0).where("description <> ''").count() == 0
    outside = hints.votes(rows.withColumn("from", F.lit("bea")), annotator=lambda a, b: ("verb tense", "x -> y"))
    assert {r.hint_type for r in outside.where("id = 1").collect()} == {"verb tense"}
    assert not hints.allowed("a -> b", True) and hints.allowed("abc -> abd", True) and hints.span("a", "a", "k\tf g") == "f g"


def test_islands_and_models(spark):
    rows = spark.createDataFrame([(0, 0, "p q", 0), (0, 1, "p q", 1), (0, 2, "r", 0), (0, 3, "p q", 9)], "line_no long, pos long, prompt string, at int")
    runs = prompts.prompt_batches(rows, "prompt", "pos", "at", "line_no").orderBy("island").collect()
    assert [(r.prompt, r.positions) for r in runs] == [("p q", [0, 1]), ("r", [0]), ("p q", [9])]
    states = models.hidden_states(prompts.prompt_batches(rows, "prompt", "pos", "at", "line_no"), models.stub_encoder, -1, "prompt").orderBy("island", "pos").collect()
    assert len(states) == 4 and states[1].vec == states[3].vec  # a position outside is read at the edge
    asked = spark.createDataFrame([("1", "He go .")], "id string, text string")
    own = spark.createDataFrame([(0, "1", "He go .")], "line_no long, id string, text string")
    examples = spark.createDataFrame([(0, 1, "a", "b", "")], "line_no long, rank int, text string, label string, description string")
    for chat in (True, False):
        p = prompts.final_prompts(own, examples, prompts.TEMPLATES["min_edit"], chat=chat)
        assert models.generated(p, models.stub_generator).first().response == "<corrected sentence>He go .</corrected sentence>"
    assert asked.count() == 1
    kept = prompts.prompt(prompts.TEMPLATES["zero_shot"], F.array().cast("array<struct<text:string,label:string,description:string>>"), F.lit("s"), prefill=True)
    assert spark.range(1).select(kept.alias("v")).first().v.endswith("<corrected sentence>")
    assert len(spark.range(1).select(prompts.messages(prompts.TEMPLATES["min_edit"], F.lit("x"), False).alias("v")).first().v) == 1


def test_relations_and_splits(spark):
    rows = spark.createDataFrame([("t1",), ("t2",)], "`from` string")
    assert {tuple(r) for r in retrieval.dataset_relation("a:t1,t2;b:t3", rows).select("test", "train").collect()} == {("a", "t1"), ("a", "t2")}
    parts = retrieval.tail_split(spark.range(10).toDF("line_no"), 20, 10).groupBy("split").count().collect()
    assert {r.split: r["count"] for r in parts} == {"train": 7, "valid": 1, "test": 2}
    assert retrieval.unknown_names(spark.createDataFrame([("x",), ("y",)], "name string"), spark.createDataFrame([("x",)], "name string")).collect()[0].name == "y"


def test_numbers_and_sums_over_buckets(spark, monkeypatch):
    from emend.operators import ordering

    monkeypatch.setattr(ordering, "PER_BUCKET", 30)
    rng = np.random.RandomState(8)
    rows = [(int(a), i, int(w)) for i, (a, w) in enumerate(zip(rng.randint(0, 40, 300), rng.randint(0, 9, 300), strict=True))]
    df = spark.createDataFrame(rows, "a long, b long, w long")
    got = [tuple(r) for r in ordering.numbered(ordering.running(df, F.col("w"), ["a", "b"], "s"), ["a", "b"], "n").orderBy("n").collect()]
    assert [g[:3] for g in got] == sorted(rows) and [g[4] for g in got] == list(range(300))
    assert [g[3] for g in got] == np.cumsum([w for *_, w in sorted(rows)]).tolist()
    down = ordering.numbered(df, [F.desc("a"), "b"], "n").orderBy("n").collect()
    assert [(r.a, r.b) for r in down] == sorted(((a, b) for a, b, _ in rows), key=lambda x: (-x[0], x[1]))
    assert ordering.numbered(df.limit(0), ["a"], "n").count() == 0
    many = spark.createDataFrame([(i, i % 13) for i in range(400)], "idx long, available long")
    for average in (2.5, 4.0, 7.3):
        assert retrieval.limits(many, 1, 9, average).agg(F.sum("limit")).first()[0] == max(sum(min(1, i % 13) for i in range(400)), min(round(average * 400), sum(min(9, i % 13) for i in range(400))))
