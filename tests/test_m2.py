import pandas as pd
import pytest

from emend.operators import m2
from emend.sources import readers

#: The published example of the format: three sentences, two annotators.
GOLD = """S The cat sat at mat .
A 3 4|||Prep|||on|||REQUIRED|||-NONE-|||0
A 4 4|||ArtOrDet|||the||a|||REQUIRED|||-NONE-|||0

S The dog .
A 1 2|||NN|||dogs|||REQUIRED|||-NONE-|||0
A -1 -1|||noop|||-NONE-|||-NONE-|||-NONE-|||1

S Giant otters is an apex predator .
A 2 3|||SVA|||are|||REQUIRED|||-NONE-|||0
A 3 4|||ArtOrDet|||-NONE-|||REQUIRED|||-NONE-|||0
A 5 6|||NN|||predators|||REQUIRED|||-NONE-|||0
A 1 2|||NN|||otter|||REQUIRED|||-NONE-|||1
"""
SYSTEM = ["A cat sat on the mat .", "The dog .", "Giant otters are apex predator ."]


def lines(spark, text):
    return spark.createDataFrame([("f", i, v) for i, v in enumerate(text.split("\n"))], "file string, line_no long, value string")


def test_published_example(spark):
    said = spark.createDataFrame(list(enumerate(SYSTEM)), "sent_idx long, hypothesis string")
    row = m2.corpus_score(readers.m2_annotations(lines(spark, GOLD)).join(said, "sent_idx")).first()
    assert (row.correct, row.proposed, row.gold) == (4, 5, 5)
    assert (round(row.precision, 4), round(row.recall, 4), round(row.f, 4)) == (0.8, 0.8, 0.8)


def test_own_example():
    assert m2.counts("He go to school .", "He goes to the school .", [m2.Gold(1, 2, "go", ("goes",))]) == (1, 2, 1)
    assert m2.f_score(0, 0, 0) == 1.0


@pytest.mark.parametrize("text", ["a b c d", "the cat sat on the mat .", "x"])
def test_nothing_proposed(text):
    assert m2.counts(text, text, [])[1] == 0


def test_isolated_substitutions_are_all_found():
    gold = [m2.Gold(1, 2, "b", ("B",)), m2.Gold(5, 6, "f", ("F",))]
    assert m2.counts("a b c d e f g h", "a B c d e F g h", gold) == (2, 2, 2)
    assert m2.counts("a b c d e f g h", "a B c d e F g h", gold, ignore_case=True) == (0, 0, 2)


def test_running_choice_looks_at_totals(spark):
    stats = spark.createDataFrame([(0, 0, 0, 0, 1), (0, 1, 0, 0, 0), (1, 0, 1, 1, 1)], "sent_idx long, annotator int, correct long, proposed long, gold long")
    for running in (True, False):
        assert {(r.sent_idx, r.annotator) for r in m2.chosen(stats, running=running).collect()} == {(0, 1), (1, 0)}


def test_edit_rows_read_back(spark):
    rows = spark.createDataFrame([(0, "He go to school", "He goes to the school"), (1, "same", "same")], "sent_idx long, source string, target string")
    text = "\n".join(r.value for r in m2.m2_text(m2.edit_rows(rows)).orderBy("sent_idx").collect())
    assert "A 1 2|||UNK|||goes|||" in text and text.count("S ") == 2
    back = readers.m2_annotations(lines(spark, text))
    said = rows.selectExpr("sent_idx", "target as hypothesis")
    assert m2.corpus_score(back.join(said, "sent_idx")).first().f == 1.0


def test_m2_pairs(spark):
    text = "S a b c\nA 0 1|||U||||||REQUIRED|||-NONE-|||0\nA 2 3|||R|||x y|||REQUIRED|||-NONE-|||1\nA 1 2|||noop|||q|||REQUIRED|||-NONE-|||0\n\nS last one\n"
    rows = readers.m2_pairs(lines(spark, text)).orderBy("line_no").collect()
    assert [(r.src, r.tgt) for r in rows] == [("a b c", "b x y"), ("last one", "last one")]
    assert [(c.idx_src, c.idx_tgt) for c in rows[0].corrections] == [([0], []), ([2], [1, 2])]
    assert [r.value for r in readers.m2_sources(lines(spark, text)).orderBy("line_no").collect()] == ["a b c", "last one"]


def test_running_choice_agrees_with_one_pass(spark):
    import random

    rng, rows = random.Random(2), []
    for sent in range(200):
        for annotator in range(rng.choice([1, 1, 1, 2, 3])):
            proposed, gold = rng.randrange(5), rng.randrange(5)
            rows.append((sent, annotator, rng.randint(0, min(proposed, gold)), proposed, gold))
    total, want = (0, 0, 0), []
    for sent in range(200):
        own = [r for r in rows if r[0] == sent]
        after = [tuple(t + x for t, x in zip(total, r[2:], strict=True)) for r in own]
        best = max(range(len(own)), key=lambda i: (m2.f_score(*after[i]), after[i][0], -(after[i][1] + 0.25 * after[i][2]), -i))
        total = after[best]
        want.append(own[best])
    stats = spark.createDataFrame(rows, "sent_idx long, annotator int, correct long, proposed long, gold long")
    assert sorted(tuple(r) for r in m2.chosen(stats).collect()) == want


def test_annotators_and_repeated_sentences_share_a_lattice(spark, monkeypatch):
    made = []
    real = m2.lattice
    edits = [(0, 1, "a", ["x"])]
    frames = [pd.DataFrame({"sent_idx": [0, 0, 1, 1], "annotator": [0, 1, 0, 1], "source": ["a b"] * 4, "hypothesis": ["x b"] * 4, "edits": [[dict(zip(("s", "e", "orig", "corr"), e, strict=True)) for e in edits], []] * 2})]
    monkeypatch.setattr(m2, "lattice", lambda *a: made.append(a) or real(*a))

    class Rows:
        def select(self, *names):
            return self

        def mapInPandas(self, run, kind):
            return pd.concat(run(iter(frames)))

    got = m2.sentence_counts(Rows())
    assert got[["correct", "proposed", "gold"]].values.tolist() == [[1, 1, 1], [0, 1, 0]] * 2
    assert len(made) == 1


def test_changes_that_stand_apart_are_counted_as_by_the_lattice():
    """Most sentences need no lattice, which took nearly all of the time."""
    import random

    rng, plain = random.Random(5), 0
    for _ in range(6000):
        source = [rng.choice("abcdefghij") for _ in range(rng.randint(1, 18))]
        every, first = rng.choice([2, 4, 5, 7]), rng.randrange(4)
        words = [w.upper() if i % every == first and rng.random() < 0.9 else w for i, w in enumerate(source)]
        if rng.random() < 0.1:
            words.insert(rng.randrange(len(words)), rng.choice("abX"))
        gold = []
        for _ in range(rng.randrange(4)):
            start = rng.randrange(-1, len(source))
            end = min(len(source), start + rng.choice([0, 1, 1, 1, 1, 2]))
            gold.append(m2.Gold(start, end, " ".join(source[max(start, 0) : end]), tuple(rng.choice([[" ".join(source[max(start, 0) : end]).upper()], ["", "x"], ["a"], [" ".join(source[max(start, 0) : end])]]))))
        if rng.random() < 0.7:
            gold.sort(key=lambda g: (g.start, g.end))
        for most, ignore in ((2, False), (2, True), (0, False), (1, False)):
            at = m2.plain_changes(source, words, most)
            found = None if at is None else m2.plain_counts(source, words, at, [(g.start, g.end, g.original, g.corrections) for g in gold], most, ignore)
            if found is not None:
                plain += bool(at)
                assert found == m2.counts(" ".join(source), " ".join(words), gold, most, ignore), (source, words, gold, most, ignore)
    assert plain > 1000
