import gzip
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from emend.operators import models
from emend.plans import config, stages
from emend.sources import readers, sinks
from emend.streaming import resume


def write(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_lines(spark, tmp_path):
    a = write(tmp_path / "a.txt", "x\r\n\ny\n")
    assert [(r.line_no, r.value) for r in readers.lines(spark, a).orderBy("line_no").collect()] == [(0, "x"), (1, ""), (2, "y")]
    with gzip.open(tmp_path / "b.gz", "wt") as f:
        f.write("p\nq\n")
    assert readers.lines(spark, str(tmp_path / "b.gz")).count() == 2
    assert readers.lines(spark, str(tmp_path / "missing")).count() == 0
    assert readers.nonblank(readers.lines(spark, a)).count() == 2
    assert [r.block for r in readers.paragraphs(readers.lines(spark, a)).orderBy("line_no").collect()] == [0, 1]


def test_many_blocks_are_numbered_as_one_file(spark, tmp_path):
    path = write(tmp_path / "big.txt", "".join(f"line {i}\n" for i in range(5000)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        assert readers.lines(spark, path).where(F.col("value") != F.concat(F.lit("line "), F.col("line_no").cast("string"))).count() == 0
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_parallel_and_alternating(spark, tmp_path):
    s, t, short = write(tmp_path / "s", "a  b\n\nc\n"), write(tmp_path / "t", "A b\nx\nC\n"), write(tmp_path / "u", "A\n")
    assert [(r.src, r.tgt) for r in readers.parallel(spark, s, t).orderBy("line_no").collect()] == [("a b", "A b"), ("", "x"), ("c", "C")]
    assert readers.parallel(spark, s, t, drop_blank=True).count() == 2
    with pytest.raises(Exception, match="different numbers"):
        readers.parallel(spark, s, short).collect()
    alt = write(tmp_path / "alt", "Good one\nbad  one\nT\nS\n")
    assert [(r.src, r.tgt) for r in readers.alternating(readers.lines(spark, alt)).orderBy("line_no").collect()] == [("bad one", "Good one"), ("S", "T")]
    with pytest.raises(Exception, match="odd number"):
        readers.alternating(readers.lines(spark, short)).collect()


def test_marked_mistakes(spark, tmp_path):
    path = write(tmp_path / "et", "x <mistake><original> a b </original>\n<correction>a\nc</correction></mistake> <mistake><original></original><correction>q</correction></mistake>")
    assert [(r.src, r.tgt) for r in readers.marked_mistakes(spark, path).collect()] == [("a b", "a\nc")]


def test_json(spark, tmp_path):
    path = write(tmp_path / "test.json", json.dumps([{"id": "1", "text": "a", "labels": ["b"]}, {"text": "c"}]))
    rows = readers.corpus_json(spark, path, "d").collect()
    assert rows[0].label == "b" and rows[1].id is not None and rows[1].label is None
    assert readers.dataset_split(spark, str(tmp_path), "d", "infer").count() == 2 and readers.dataset_split(spark, str(tmp_path), "d", "train").count() == 0
    with pytest.raises(Exception, match="no label"):
        readers.required_labels(readers.corpus_json(spark, path, "d")).collect()
    assert readers.not_blank(sinks.blank_split(spark, "d")).count() == 0
    assert readers.standard(readers.corpus_json(spark, path, "d"), "d").columns == ["id", "from", "text", "label"]


def test_valid_prefix(spark):
    want = spark.createDataFrame([(i, str(i), f"t{i}") for i in (0, 1, 2, 3)], "line_no long, id string, text string")
    stored = lambda *ids: spark.createDataFrame([(i, json.dumps({"id": x, "text": f"t{i}"}) if x != "!" else "{bad") for i, x in enumerate(ids)], "line_no long, value string")
    for ids, n in ((("0", "1", "x", "3"), 2), (("0", "!", "2"), 1), (("0", "1", "2", "3", "4"), 4), ((), 0)):
        rows = stored(*ids) if ids else spark.createDataFrame([], "line_no long, value string")
        kept, todo = resume.resumed(want, rows)
        assert (kept.count(), todo.count()) == (n, 4 - n)


def test_verbs_and_registry(spark, tmp_path):
    path = write(tmp_path / "v.txt", "go_goes:VB_VBZ\n")
    assert readers.verb_forms(spark, path).first() == ("go", "goes", "VB", "VBZ") and readers.verb_forms(spark, None).count() == 0
    with pytest.raises(FileNotFoundError):
        readers.label_path(spark, str(tmp_path / "x"))
    sinks.write_table(spark.range(3), str(tmp_path / "t"))
    readers.register(spark, {"t_view": str(tmp_path / "t")})
    assert spark.table("t_view").count() == 3


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(1, " b "), (0, "a\nx")], "line_no long, prediction string")
    sinks.write_lines(rows, str(tmp_path / "l"), "prediction")
    assert [r.value for r in readers.lines(spark, str(tmp_path / "l")).orderBy("line_no").collect()] == ["a x", "b"]
    path = sinks.write_submission(rows, str(tmp_path / "z"), "bea19", expected=2)
    assert zipfile.ZipFile(path).read("bea19.txt").decode().splitlines()[-1] == "b"
    with pytest.raises(AssertionError):
        sinks.write_submission(rows, str(tmp_path / "z"), "bea19", expected=config.SUBMISSION_LINES)
    sinks.write_json(rows, str(tmp_path / "j"))
    sinks.write_json(rows.limit(0), str(tmp_path / "j"))  # kept
    assert spark.read.json(str(tmp_path / "j")).count() == 2
    sinks.write_parallel(spark.createDataFrame([(0, "s", "t")], "line_no long, src string, tgt string"), str(tmp_path / "p"))
    assert readers.parallel(spark, str(tmp_path / "p.src"), str(tmp_path / "p.tgt")).first().tgt == "t"
    sinks.write_predictions(rows.withColumn("postprocess_reason", F.lit("kept")), str(tmp_path / "o"))
    assert spark.read.json(str(tmp_path / "o/output.stats")).first()["count"] == 2


def test_config(spark):
    assert config.language("et").correct_examples == 4 and config.model("qwen25").retrieve_dim == 256
    assert config.run_matrix(spark).count() == 30
    assert config.run_of({"hints": "yes", "batch": "4"}).hints is True
    for bad in (lambda: config.language("x"), lambda: config.model("x"), lambda: config.run_of({"x": 1})):
        with pytest.raises(ValueError):
            bad()


def test_stage_runner(spark, tmp_path):
    plan = [stages.Stage("a", str(tmp_path / "a"), lambda s, t: s.range(3)), stages.Stage("b", str(tmp_path / "b"), lambda s, t: t["a"].where("id > 0"))]
    tables, log = stages.run_stages(spark, plan)
    assert tables["b"].count() == 2 and log == ["made a", "made b"]
    assert stages.run_stages(spark, plan)[1] == ["kept a", "kept b"]
    assert stages.run_stages(spark, [stages.Stage("c", str(tmp_path / "c"), plan[0].make)], dry=True)[1] == ["would make c"]
    assert stages.enabled("final", "retrieval") and not stages.enabled("cache", "retrieval")


def test_a_whole_run(spark, tmp_path):
    m2_file = write(tmp_path / "train.m2", "".join(f"S He go to school number {i} .\nA 1 2|||V|||goes|||REQUIRED|||-NONE-|||0\n\nS All is well here {i} .\n\n" for i in range(6)))
    corpus = stages.prepare_wilocness(spark, m2_file)
    assert corpus.count() == 12 and corpus.orderBy("line_no").first().id == "0_wilocness"
    pairs = corpus.select("line_no", F.col("text").alias("src"), F.col("label").alias("tgt"))
    sites = stages.site_vectors(pairs, models.stub_encoder, -1, "en").cache()
    assert sites.count() == 6 and sites.first().key.endswith("go -> goes")
    lines = pairs.where("line_no < 4")
    test_sites = stages.site_vectors(lines, models.stub_encoder, -1, "en")
    stored = lambda name, df: (sinks.write_table(df, str(tmp_path / name)), spark.read.parquet(str(tmp_path / name)))[1]  # noqa: E731  as the stage runner does
    pairs, lines, sites, test_sites = (stored(n, df) for n, df in (("pairs", pairs), ("lines", lines), ("sites", sites), ("test_sites", test_sites)))
    rows = stored("retrieval", stages.retrieved(lines, test_sites, sites, pairs, config.language("en"), 5, config.Run()))
    got = {r.id: len(r.in_domain_examples) for r in rows.collect()}
    assert got == {"0_conll14": 6, "1_conll14": 2, "2_conll14": 6, "3_conll14": 2}
    asked = stages.final_prompts(rows, config.Run(hints=True, template="hinted"))
    answers = stored("answers", stages.answered(asked, models.stub_generator, "conll14"))
    assert {r.postprocess_reason for r in answers.collect()} == {"kept"}
    gold = readers.m2_annotations(readers.lines(spark, m2_file)).where("sent_idx < 4")
    said = answers.select(F.split("id", "_")[0].cast("bigint").alias("line_no"), "prediction")
    score = stages.scored(said, gold, config.language("en")).first()
    assert (score.correct, score.proposed, score.gold) == (0, 0, 2)
    with pytest.raises(NotImplementedError):
        stages.scored(said, gold, config.language("ro"))


def test_one_call_runs_all_stages(spark, tmp_path):
    def changing_generator():
        plain = models.stub_generator()
        return lambda prompts: [a.replace("He go ", "He goes ") for a in plain(prompts)]

    m2_file = write(tmp_path / "train.m2", "".join(f"S He go to school number {i} .\nA 1 2|||V|||goes|||REQUIRED|||-NONE-|||0\n\nS All is well here {i} .\n\n" for i in range(6)))
    corpus = stages.prepare_wilocness(spark, m2_file)
    sinks.write_table(corpus.select("line_no", F.col("text").alias("src"), F.col("label").alias("tgt")), str(tmp_path / "pairs"))
    pairs = spark.read.parquet(str(tmp_path / "pairs"))
    gold = readers.m2_annotations(readers.lines(spark, m2_file)).where("sent_idx < 4")
    model = config.Model("stub", 5, -1)
    for run in (config.Run(), config.Run(by_text=True, hints=True, template="hinted")):
        folder = str(tmp_path / f"run-{run.by_text}")
        args = (spark, folder, pairs.where("line_no < 4").select("line_no", "src"), pairs, config.language("en"), model, models.stub_encoder, changing_generator, run, gold)
        tables, log = stages.whole_run(*args)
        assert log == [f"made {n}" for n in ("initial", "cache", "test_sites", "retrieval", "final", "score")]
        assert tables["initial"].count() == tables["final"].count() == 4 and tables["test_sites"].count() == 2
        assert {r.id: len(r.in_domain_examples) for r in tables["retrieval"].collect()} == {"0_conll14": 6, "1_conll14": 2, "2_conll14": 6, "3_conll14": 2}
        score = tables["score"].first()
        assert (score.correct, score.proposed, score.gold) == (2, 2, 2)
        assert all(x.startswith("kept") for x in stages.whole_run(*args)[1])


def test_other_recipes(spark, tmp_path):
    src, tgt = write(tmp_path / "s", "Das ist ein Haus\n"), write(tmp_path / "t", "Das ist ein Haus .\n")
    assert stages.prepare_falko_merlin(spark, src, tgt).first().label == "Das ist ein Haus ."
    assert stages.prepare_ronacc(spark, write(tmp_path / "ro", "Bun(a)\nBuna\n")).first().label == "Bun ( a )"
    assert stages.prepare_estgec(spark, write(tmp_path / "et", "<mistake><original>a</original><correction>b</correction>")).first().label == "b"
    assert stages.prepare_bea19(spark, src).first().id == "0_bea19"
    assert stages.prepare_conll14(spark, write(tmp_path / "c.m2", "S x y\nA 0 1|||a|||b|||R|||-NONE-|||0\n\nS z\n")).count() == 2


def test_streamed_answers_are_given_once(spark, tmp_path):
    asked = lambda n: spark.createDataFrame([(f"{n}", f"Sentence: s{n}")], "id string, sentence string")
    folder, out, checkpoint = (str(tmp_path / x) for x in ("in", "out", "cp"))
    run = lambda: resume.stream_answers(spark, folder, "id string, sentence string", lambda df: models.generated(df, models.stub_generator), out, checkpoint).awaitTermination(60)
    asked(1).coalesce(1).write.mode("append").parquet(folder)
    run()
    asked(2).coalesce(1).write.mode("append").parquet(folder)
    run()
    run()
    rows = spark.read.json(out)
    assert sorted(r.id for r in rows.collect()) == ["1", "2"]
    assert resume.progress(rows, 4).first().share == 0.5


def test_aligned_tables_states_and_labels(spark, tmp_path):
    rows = lambda *v: spark.createDataFrame(list(enumerate(v)), "line_no long, value string")
    both = readers.aligned(src=rows("He go", "x"), tgt=rows("He goes", "x"), pred=rows("He go", "x"))
    assert both.columns == ["line_no", "src", "tgt", "pred"] and both.count() == 2
    with pytest.raises(Exception, match="different numbers"):
        readers.aligned(a=rows("p", "q"), b=rows("p")).collect()
    lines = stages.label_lines(both.select("line_no", "src", "tgt")).orderBy("line_no").collect()
    assert lines[0].label == "$STARTSEPL|||SEPR$KEEP HeSEPL|||SEPR$KEEP goSEPL|||SEPR$REPLACE_goes" and lines[1].label.count("$KEEP") == 2
    assert readers.dataset_state(spark, str(tmp_path)) == "missing"
    write(tmp_path / "data.json", "[]")
    assert readers.dataset_state(spark, str(tmp_path)) == "raw"
    for split in ("train", "valid", "test"):
        write(tmp_path / f"{split}.json", "[]")
    assert readers.dataset_state(spark, str(tmp_path)) == "split"
