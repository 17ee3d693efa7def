import time

from hypothesis import given, settings
from hypothesis import strategies as st
import pytest
from pyspark.sql import functions as F

from emend.functions import tags as T
from emend.operators import edits

WORDS = st.lists(st.sampled_from("a b the The THE cat cats in to into well known well-known Walk walked x-y x y".split()), min_size=1, max_size=9).map(" ".join)


@settings(max_examples=300, deadline=None)
@given(WORDS, WORDS)
def test_tags_give_back_the_target(source, target):
    made = edits.decode(edits.align(source, target))
    assert "".join(made.split()) == "".join(target.split())


@settings(max_examples=50, deadline=None)
@given(WORDS)
def test_equal_sentences_keep_all(source):
    assert all(t == [T.KEEP] for _, t in edits.align(source, source))


@pytest.mark.parametrize(
    ("source", "target", "tag"),
    [
        ("hello", ["Hello"], "$TRANSFORM_CASE_CAPITAL"), ("Hello", ["hello"], "$TRANSFORM_CASE_LOWER"), ("abc", ["ABC"], "$TRANSFORM_CASE_UPPER"),
        ("cats", ["cat"], T.SINGULAR), ("cat", ["cats"], T.PLURAL), ("well-known", ["well", "known"], T.SPLIT), ("a", ["a"], T.KEEP), ("a", ["b"], None),
    ],
)
def test_transforms(source, target, tag):
    assert T.transform(source, target) == tag
    if tag:
        assert T.applied(source, tag) == " ".join(target)


def test_verb_vocabulary():
    encode, decode = T.verb_tables([("go", "goes", "VB", "VBZ"), ("go", "went", "VB", "VBD")])
    assert T.transform("go", ["goes"], encode) == "$TRANSFORM_VERB_VB_VBZ"
    assert T.applied("go", "$TRANSFORM_VERB_VB_VBD", decode) == "went"


def test_merges_and_insertions():
    assert T.merge(["in", "to"], ["into"]) == T.MERGE_SPACE
    assert T.merge(["well", "known"], ["well-known"]) == T.MERGE_HYPHEN
    assert T.merge(["a", "b"], ["b", "a"]) == T.MERGE_SWAP
    assert edits.align("b", "a b")[0] == (T.START, ["$APPEND_a"])
    assert edits.decode([(T.START, [T.KEEP]), ("a", [T.MERGE_SWAP]), ("b", [T.KEEP])]) == "b a"
    assert edits.align("a SEPL|||SEPR", "b") is None


def test_large_blocks_still_round_trip():
    source, target = " ".join(f"s{i}" for i in range(60)), " ".join(f"t{i}" for i in range(45))
    assert edits.decode(edits.align(source, target)) == target


def test_sites_fall_into_one_bucket_each():
    gold, pred = edits.align("He go to school", "He goes to the school"), edits.align("He go to school", "He going to school")
    found = edits.sites(gold, pred, "He goes to the school", "He going to school")
    assert {b for s, b, *_ in found if s == "pred"} <= {"tp", "tpf", "tn", "fp", "fn"}
    assert ("pred", "tpf") in {f[:2] for f in found}
    same = edits.sites(gold, gold, "He goes to the school", "He goes to the school")
    assert not {"fn", "tpf"} & {b for s, b, *_ in same if s == "pred"}
    assert all("ADD_SUF" in d for s, b, _, _, d in same if b == "fp")
    with pytest.raises(ValueError):
        edits.sites(gold, gold[:-1], "a", "a")


def test_hyphen_variants_differ_in_positions():
    items = edits.align("a-b-c d", "a b c d")
    build, retrieve = (edits.sites(items, items, "a b c d", "a b c d", v) for v in ("build", "retrieve"))
    assert len([s for s in build if s[:2] == ("gold", "pos")]) == 3 and len([s for s in retrieve if s[:2] == ("gold", "pos")]) == 2


def test_cyclic_pairs(spark):
    df = lambda n, x: spark.createDataFrame([(0, i, f"{x}{i}") for i in range(n)], "line_no long, rank int, v string")
    pairs = lambda p, n: sorted((r.pos_v, r.neg_v) for r in edits.cyclic_pairs(df(p, "p"), df(n, "n")).collect())
    assert pairs(2, 4) == [("p0", "n1"), ("p0", "n3"), ("p1", "n2")]
    assert pairs(3, 2) == [("p0", "n1")]
    assert pairs(0, 4) == []


def test_with_tags_and_prefixes(spark):
    rows = spark.createDataFrame([(0, "He go to school .", "He goes to the school ."), (1, "same", "same"), (2, None, "x")], "line_no long, src string, tgt string")
    tagged = edits.with_tags(rows)
    assert {r.line_no for r in tagged.collect()} == {0, 1}
    sites = edits.exploded_sites(edits.with_sites(tagged.withColumn("pred_items", F.col("items")).withColumn("pred_tgt", F.col("tgt"))), "line_no")
    cut = edits.prefixes(rows, sites.where("side = 'gold'").drop("side")).where("bucket = 'pos'").orderBy("rank").collect()
    assert cut[0].src_prefix == "He go" and cut[0].tgt_prefix == "He goes"
    assert all(not r.src_prefix.endswith(".") for r in cut)
    line = tagged.select(T.tagged_line(F.col("items")).alias("l")).withColumn("back", T.tagged_items(F.col("l")))
    assert [r.back for r in line.collect()] == [r["items"] for r in tagged.collect()]


def test_edits_applied(spark):
    rows = spark.createDataFrame([(["a", "b", "c"], [(0, 1, "$REPLACE_x"), (1, 1, "$APPEND_y"), (1, 2, ""), (2, 3, "$TRANSFORM_CASE_UPPER")])], "t array<string>, e array<struct<start:int,end:int,label:string>>")
    assert rows.select(edits.edits_applied(F.col("t"), F.col("e")).alias("v")).first().v == "x y C"
    merged = spark.createDataFrame([(["in", "to", "it"], [(0, 2, "$MERGE_SPACE")])], "t array<string>, e array<struct<start:int,end:int,label:string>>")
    assert merged.select(edits.edits_applied(F.col("t"), F.col("e")).alias("v")).first().v == "into it"


def test_site_rows_are_those_of_two_passes(spark):
    rows = [(0, "a b c", "a x c", "a b c"), (1, "the cat sat", "the cats sat down", "the cats sat down"), (2, "a-b c", "a b c d", "a b d"), (3, None, "x", "x"), (4, "same", "same", "same"), (5, "SEPL|||SEPR", "x", "x")]
    df = spark.createDataFrame(rows, "line_no long, src string, tgt string, pred_tgt string")
    one = sorted(map(str, edits.numbered_sites(edits.site_rows(df, "line_no"), "line_no").collect()))
    tagged = edits.with_tags(df)
    guess = edits.with_tags(df.select("line_no", "src", F.col("pred_tgt").alias("tgt"))).select("line_no", F.col("items").alias("pred_items"))
    two = edits.exploded_sites(edits.with_sites(tagged.join(guess, "line_no")), "line_no")
    assert one == sorted(map(str, two.collect())) and len(one) > 8
    assert edits.site_rows(df.limit(0), "line_no").count() == 0


#: source, target, tags of the start token and of each token. By hand: equal stretches are kept, a changed stretch is cut into spans at the least number of letters that
#: differ, a span's tag is the first that makes it of its token, what is over is appended.
BY_HAND = [
    ("a b c", "a b c", "K K K K"), ("a b c", "a c", "K K D K"), ("a c", "a b c", "K A_b K"), ("b c", "a b c", "A_a K K"), ("a b", "a b c d", "K K A_c,A_d"), ("a", "", "K D"), ("", "a", "A_a"),
    ("the cat", "The cat", "K T_CASE_CAPITAL K"), ("the cat", "THE cat", "K T_CASE_UPPER K"), ("THE cat", "the cat", "K T_CASE_LOWER K"), ("iphone x", "iPhone x", "K T_CASE_CAPITAL_1 K"), ("abc x", "ABc x", "K T_CASE_UPPER_-1 K"),
    ("one cat here", "one cats here", "K K T_AGREEMENT_PLURAL K"), ("two cats here", "two cat here", "K K T_AGREEMENT_SINGULAR K"), ("a well-known b", "a well known b", "K K T_SPLIT_HYPHEN K"), ("x-y-z", "x y z", "K T_SPLIT_HYPHEN"),
    ("in to it", "into it", "K M_SPACE K K"), ("well known it", "well-known it", "K M_HYPHEN K K"), ("b a", "a b", "A_a K D"), ("go home", "went home", "K R_went K"), ("he go to", "he goes to", "K K R_goes K"),
    ("x y z", "x q z", "K K R_q K"), ("see teh dog", "see the dog", "K K R_the K"), ("I has it", "I have it", "K K R_have K"), ("a b c d", "d", "K D D D K"), ("same same", "same", "K K D"), ("a", "a a", "K A_a"),
    ("cat", "Cats", "K R_Cats"), ("cat sat", "cats Sat", "K T_AGREEMENT_PLURAL T_CASE_CAPITAL"), ("abcdef x", "abcdex y x", "K R_abcdex,A_y K"), ("in the in", "in a in", "K K R_a K"),
]
NAMES = {"K": "$KEEP", "D": "$DELETE", "A": "$APPEND", "R": "$REPLACE", "T": "$TRANSFORM", "M": "$MERGE"}


@pytest.mark.parametrize(("source", "target", "want"), BY_HAND)
def test_tags_by_hand(source, target, want):
    tags = [[NAMES[t[0]] + t[1:] for t in own.split(",")] for own in want.split(" ")]
    # a merge leaves its second token alone
    assert [g for _, g in edits.align(source, target)] == tags


def test_a_long_block_is_aligned_like_a_short_one():
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(41)]
    found = edits.align(" ".join(words), " ".join(["NEW", *(w.upper() for w in words)]))
    assert [g for _, g in found] == [["$APPEND_NEW"], *[["$TRANSFORM_CASE_UPPER"]] * 41]


def test_cyclic_computes_its_sides_once(spark):
    """A lambda that computed the positives anew for each negative would take minutes here."""
    numbers = F.sequence(F.lit(0), F.col("n"))
    p, n = (F.filter(numbers, lambda x: x % 2 == r) for r in (0, 1))
    began = time.time()
    got = spark.createDataFrame([(40_000,)], "n int").select(F.explode(edits.cyclic(p, n)).alias("x")).agg(F.count("*"), F.sum("x.pos"), F.sum("x.neg")).first()
    assert tuple(got) == (19_999, sum(range(0, 39_998, 2)), sum(range(3, 40_001, 2)))
    assert time.time() - began < 20
