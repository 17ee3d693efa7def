import pytest
from pyspark.sql import functions as F

from emend.functions import tags, text
from emend.operators import cleanup


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


S, E = text.ANSWER_START, text.ANSWER_END


@pytest.mark.parametrize(
    ("response", "found"),
    [(f"x y{E} junk {S}z{E}", "x y"), (f"{S}z{E}", "z"), (f"{S}{E}", "src"), ("none", "src"), (f"{E}{S} q {E}", "q"), (f"{S}open", "src"), ("", "src")],
)
def test_tagged_answers(spark, response, found):
    assert value(spark, text.extract_answer(F.lit(response), F.lit("src"))) == found
    strict = value(spark, text.tagged(F.lit(response)))
    assert strict == (None if found == "src" else found)


def test_legacy_and_split_answers(spark):
    legacy = lambda r: value(spark, text.legacy_answer(F.lit(r), F.lit("src")))
    assert legacy(f"a {S} b {E}") == "b" and legacy(f"{S}No errors found{E}") == "src" and legacy("x") == "src" and legacy(f"{S} {E}") == "src"
    split = lambda r, s: value(spark, text.split_answer(F.lit(r), F.lit(s), "###"))
    assert split("a###hello###b", "hallo") == "hello" and split("a###h###b", "hallo") == "hallo" and split("a###b", "c") == "c" and split("a###b###c", "") == ""
    assert value(spark, text.between_tags(F.lit("a<b>c</b>d"), "<b>", "</b>")) == "c"
    with pytest.raises(NotImplementedError):
        text.answer(F.lit("a"), F.lit("b"), "other")


def test_spaces(spark):
    assert value(spark, text.clean_space(F.lit(" a  b\r\nc "))) == "a b c"
    assert value(spark, text.runtime_line(F.lit("a(b)\nc"), F.lit("ronacc_readerbench"))) == "a (b) c"
    assert value(spark, text.runtime_line(F.lit("a(b)\nc"), F.lit("conll14"))) == "a(b) c"
    assert value(spark, text.without_doubles(F.lit("a a b b a"))) == "a b a"
    assert value(spark, text.join_clitics(F.lit("I do n't know"))) == "I don't know"
    assert value(spark, text.join_clitics(F.lit("'s a"))) == "'s a"


def test_chains(spark):
    assert value(spark, text.conll_text(F.lit("a - b (c) ' q ' x"))).split() == "a-b ( c ) 'q' x".split()
    assert value(spark, text.bea_text(F.lit("5 % they have n't"))) == "5% they haven't"
    with pytest.raises(NotImplementedError):
        text.postprocessed(F.lit("a"), "unknown")
    with pytest.raises(NotImplementedError):
        text.postprocessed(F.lit("a"), "conll14", ("bea19",))
    for dataset in text.PLANS:
        assert value(spark, text.postprocessed(F.lit("A b, c."), dataset)) is not None


TREEBANK = [
    ("Don't stop, he cannot.", False, "Don 't stop , he cannot ."), ("Don't stop, he cannot.", True, "Do n't stop , he can not ."), ("Mr. Smith paid $3.50 at 5 p.m. today.", False, "Mr. Smith paid $ 3.50 at 5 p.m. today ."),
    ("wait... what--no?", False, "wait ... what -- no ?"), ("1,000 apples,pears and 3,x", False, "1,000 apples , pears and 3 , x"), ("a|b and/or c", False, "a -PIPE- b and / or c"), ("(see [this] {that})", True, "-LRB- see -LSB- this -RSB- -LCB- that -RCB- -RRB-"),
    ('He said "yes" twice', True, "He said `` yes '' twice"), ("John's dog", False, "John 's dog"), ("in fig. 3 it", False, "in fig. 3 it"), ("the end. Then", False, "the end . Then"), ("They'll see we've", True, "They 'll see we 've"), ("", False, ""), ("...", False, "..."),
]


def test_treebank(spark):
    rows = spark.createDataFrame([(i, *r) for i, r in enumerate(TREEBANK)], "i long, line string, ptb boolean, want string")
    got = rows.select("line", "want", F.when(F.col("ptb"), text.treebank(F.col("line"), ptb=True)).otherwise(text.treebank(F.col("line"))).alias("got")).collect()
    for r in got:
        assert r.got == r.want, r.line
    assert value(spark, text.treebank(F.lit("l'eau est là, 3,5."), "fr")).split() == ["l'", "eau", "est", "là", ",", "3,5", "."]
    assert value(spark, text.treebank(F.lit(" a  b "), "de")) == "a b"
    assert value(spark, text.token_offset(F.lit("He cannot go"), F.lit(9))) == 2


def test_sentences_are_packed(spark):
    assert value(spark, text.pack_sentences(F.lit("a b. c d. e f g h. i"), 4)) == ["a b. c d.", "e f g h.", "i"]


@pytest.mark.parametrize(("token", "yes"), [("", True), (",", True), ("()", True), ("...", False), ("a.", False)])
def test_punctuation(spark, token, yes):
    assert value(spark, tags.is_punctuation(F.lit(token))) is yes


def test_chinese_punctuation(spark):
    assert value(spark, tags.is_punctuation(F.lit("，"), "zh")) is True and value(spark, tags.is_punctuation(F.lit("中"), "zh")) is False
    assert value(spark, text.strip_blanks(F.lit("中 文"))) == "中文"


@pytest.mark.parametrize(("src", "pred", "kept"), [(4, 54, True), (4, 55, False), (100, 175, True), (100, 176, False)])
def test_length_guard(spark, src, pred, kept):
    got = value(spark, cleanup.length_guard(F.lit("x " * pred), F.lit("y " * src)))
    assert got.startswith("x") is kept


def test_likeness():
    assert cleanup.likeness("abcd", "abxd") == 0.75 and cleanup.likeness("", " ") == 1.0
    assert cleanup.likeness("word " * 900, "word " * 900) == 1.0


def test_cleanup_rules(spark):
    rows = spark.createDataFrame(
        [("1", "a b c", f"{S}a b d{E}"), ("2", "a b c", "<erroneous sentence>a</erroneous sentence>" + f"{S}x{E}"), ("3", "a b c", f"{S}a b c (question){E}"), ("4", "a b c", f"{S}zzzzzzzz{E}"), ("5", "a b c", "No errors found"), ("6", None, None)],
        "id string, text string, response string",
    )
    got = {r.id: (r.prediction, r.postprocess_reason) for r in cleanup.cleaned(rows, cleanup.threshold("conll14")).collect()}
    assert got["1"] == ("a b c", "char_lt_0.70") or got["1"] == ("a b d", "kept")
    assert got["2"] == ("a b c", "tagbad_or_no_correction") and got["3"] == ("a b c", "comment_or_no_correction_in_prediction")
    assert got["4"] == ("a b c", "char_lt_0.70") and got["5"][1] == "tagbad_or_no_correction" and got["6"] == ("", "kept")
    with pytest.raises(ValueError):
        cleanup.threshold("other")


def test_dataset_of_a_path(spark):
    of = lambda p: value(spark, cleanup.dataset_of(F.lit(p)))
    assert of("/x/BEA19/p.jsonl") == "bea19" and of("/x/out-conll14.txt") == "conll14" and of("/x/y") == ""


def test_case_tags_agree_with_plain_ones(spark):
    words = ["abc", "ABC", "Abc", "aBC", "abC", "ABc", "x", "X", "cats", "cat", "a-b", "a b"]
    pairs = spark.createDataFrame([(a, b) for a in words[:-1] for b in words], "a string, b string")
    for r in pairs.withColumn("t", tags.token_tag(F.col("a"), F.col("b"))).collect():
        plain = tags.transform(r.a, r.b.split(" ")) or tags.REPLACE + r.b
        assert r.t == plain, (r.a, r.b)


def test_long_texts_are_cut_and_packed(spark):
    rows = spark.createDataFrame([("7", " a b. c d! e f g h i? j", "L")], "id string, text string, label string")
    got = [tuple(r) for r in text.cut_long(rows, "wilocness", 6).collect()]
    assert got == [("7#0#P", "a b. c d!", "L"), ("7#1#P", " e f g h i?", "L"), ("7#2#P", " j", "L")]
    chinese = spark.createDataFrame([("1", "甲，乙。丙")], "id string, text string")
    assert [tuple(r) for r in text.cut_long(chinese, "mucgec", 99, F.length).collect()] == [("1#0#P", "甲，乙。"), ("1#1#P", "丙")]
    assert [r.id for r in text.cut_long(chinese, "fangzhenggrammar", 3, F.length).collect()] == ["1#0#，", "1#1#P", "1#2#P"]
    with pytest.raises(NotImplementedError):
        text.cut_long(rows, "other", 5)


def test_small_helpers(spark):
    from emend.functions.registry import register_functions
    from emend.operators import edits, m2, retrieval

    assert value(spark, text.normalized(F.lit("A A b"), {"b": "c"})) == "a c"
    assert value(spark, text.repaired(F.lit("it\x92s"))) == "it\u2019s"
    assert value(spark, text.is_ascii(F.lit("abc"))) is True and value(spark, text.is_ascii(F.lit("ä"))) is False
    assert "likeness" in register_functions(spark) and spark.sql("SELECT likeness('abcd', 'abxd') AS v").first().v == 0.75
    items = spark.createDataFrame([([("$START", ["$KEEP"]), ("a", ["$DELETE"])],)], "items array<struct<token:string,tags:array<string>>>")
    assert [tuple(e) for e in items.select(edits.tags_as_edits(F.col("items")).alias("e")).first().e] == [(0, 1, ["$DELETE"])]
    assert m2.token_distance("a b".split(), "a c".split()) == 2 and m2.token_distance("a b".split(), "a c".split(), 1) == 1
    assert m2.shrunk(2, 5, "the big cat", "the small cat") == (3, 4, "big", "small")
    log = spark.createDataFrame([(1, 0.5), (2, 0.9), (3, None)], "step int, f double")
    assert retrieval.best_row(log, "f").first().step == 2 and retrieval.best_row(log, "f", False).first().step == 1


def test_sql_names(spark):
    from emend.functions import registry

    names = registry.register_functions(spark)
    assert {"clean_space", "conll_text", "likeness", "between_tags"} <= set(names)
    rows = [(" a \t b\n", "x <b>y</b> z"), ("he 's ( here ) - now ' ok ' ", "no"), ("It 's 50 % have n't", "<b></b>"), ("", "")]
    df = spark.createDataFrame(rows, "t string, m string")
    df.createOrReplaceTempView("texts_to_call")
    got = spark.sql("SELECT clean_space(t) AS a, strip_white(t) AS b, conll_text(t) AS c, bea_text(t) AS d, between_tags(m, '<b>', '</b>') AS e, word_count(t) AS n FROM texts_to_call").collect()
    want = df.select(text.clean_space(F.col("t")).alias("a"), text.strip(F.col("t")).alias("b"), text.conll_text(F.col("t")).alias("c"), text.bea_text(F.col("t")).alias("d"), text.between_tags(F.col("m"), "<b>", "</b>").alias("e"), F.size(text.words(F.col("t"))).alias("n")).collect()
    assert sorted(map(str, got)) == sorted(map(str, want))
    assert spark.sql("SELECT likeness('abc', 'abc') AS r, agreement_tag('cat', 'cats') AS g").first() == (1.0, "$TRANSFORM_AGREEMENT_PLURAL")
