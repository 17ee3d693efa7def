"""The choice of annotators over running totals, and distances of long sentences, against plain versions."""

import random

import pytest

from emend.operators import m2


def one_by_one(rows, beta=0.5):
    """Sentences in order, each with the annotator of the highest F so far."""
    total, out, by_sent = (0, 0, 0), [], {}
    for sent, *rest in sorted(rows):
        by_sent.setdefault(sent, []).append(rest)
    for sent, options in sorted(by_sent.items()):
        sums = [tuple(t + x for t, x in zip(total, o[1:], strict=True)) for o in options]
        at = max(range(len(options)), key=lambda i: (m2.f_score(*sums[i], beta), sums[i][0], -(sums[i][1] + beta * beta * sums[i][2]), -i))
        total = sums[at]
        out.append((sent, *options[at]))
    return out


def made(n, seed, most=4, step=1):
    rng = random.Random(seed)
    rows = []
    for sent in range(0, n * step, step):
        proposed = rng.choice([0, 0, 1, 2, 5])
        for a in range(rng.randrange(1, most + 1)):
            gold = rng.choice([0, 1, 2, 3, 7])
            rows.append((sent, a, rng.randrange(0, min(proposed, gold) + 1), proposed, gold))
    return rows


@pytest.mark.parametrize("seed,replayed,rounds,per_part", [(1, 100_000, 3, 500_000), (2, 7, 1, 500_000), (3, 25, 2, 40), (4, 10, 0, 60)])
def test_choices_as_one_by_one(spark, monkeypatch, seed, replayed, rounds, per_part):
    from emend.operators import ordering

    monkeypatch.setattr(m2, "REPLAYED", replayed)
    monkeypatch.setattr(m2, "ROUNDS", rounds)
    monkeypatch.setattr(ordering, "PER_BUCKET", per_part)
    n = 400 if replayed > 1000 else 60
    rows = made(n, seed, step=3)
    stats = spark.createDataFrame(rows, "sent_idx long, annotator int, correct long, proposed long, gold long").repartition(4)
    assert sorted(map(tuple, m2.chosen(stats).collect())) == one_by_one(rows)


def test_most_choices_are_settled_by_bounds(spark):
    from pyspark.sql import functions as F

    rows = made(3000, 9)
    before = {"correct": 50_000, "proposed": 90_000, "gold": 120_000}
    stats = spark.createDataFrame(rows, "sent_idx long, annotator int, correct long, proposed long, gold long").groupBy("sent_idx").agg(F.array_sort(F.collect_list(F.struct("annotator", "correct", "proposed", "gold"))).alias("o"))
    low, high = ({f: F.lit(v + d) for f, v in before.items()} for d in (0, 2000))
    settled = stats.where(m2._settled(F.col("o"), low, high, 0.5).isNotNull()).count()
    assert settled > 2000


def test_no_sentences_and_ties(spark):
    kind = "sent_idx long, annotator int, correct long, proposed long, gold long"
    assert m2.chosen(spark.createDataFrame([], kind)).collect() == []
    rows = [(s, a, 0, 0, 0) for s in range(5) for a in range(3)]
    assert sorted(map(tuple, m2.chosen(spark.createDataFrame(rows, kind)).collect())) == one_by_one(rows)


@pytest.mark.parametrize("seed", range(6))
def test_distances_in_a_band(monkeypatch, seed):
    rng = random.Random(seed)
    words = "abcdefgh"[: rng.choice([2, 8])]
    source = [rng.choice(words) for _ in range(rng.randrange(0, 70))]
    target = [w for w in source if rng.random() > 0.1] + [rng.choice(words) for _ in range(rng.randrange(0, 20))]
    for change in (1, 2):
        want = m2._steps(source, target, change)
        monkeypatch.setattr(m2, "FEW_CELLS", -1)
        assert m2._steps(source, target, change) == want
        monkeypatch.undo()
        assert len(source) * len(target) > 2000 or want is not None


def test_a_long_sentence(monkeypatch):
    source = [f"w{i % 9}" for i in range(3000)]
    gold = [m2.Gold(i, i + 1, source[i], (source[i] + "§",)) for i in range(3, 3000, 7)]
    said = [w + "§" if i % 14 == 3 else w for i, w in enumerate(source)]
    assert m2.counts(" ".join(source), " ".join(said), gold) == (215, 215, 429)
