"""Files read in several splits: blocks of lines and JSON arrays."""

import json
import random

import pytest

from emend.sources import readers, sinks


def plain_blocks(lines):
    out, block, open_ = [], -1, False
    for i, v in enumerate(lines):
        if v.strip(" "):
            block += not open_
            out.append((i, v, block))
        open_ = bool(v.strip(" "))
    return out


@pytest.mark.parametrize("together", [1, 2, 7, 1000])
def test_paragraphs_in_chunks(spark, monkeypatch, together):
    monkeypatch.setattr(readers, "TOGETHER", together)
    rng = random.Random(together)
    files = {f: [rng.choice(["", " ", "x", "y z", "S a"]) for _ in range(60)] for f in ("a", "b")} | {"c": ["", ""], "d": ["x"]}
    rows = spark.createDataFrame([(f, i, v) for f, lines in files.items() for i, v in enumerate(lines)], "file string, line_no long, value string").repartition(3)
    got = readers.paragraphs(rows).collect()
    for f, lines in files.items():
        assert sorted((r.line_no, r.value, r.block) for r in got if r.file == f) == plain_blocks(lines)


def test_an_m2_file_in_small_splits(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(readers, "TOGETHER", 10)
    lines = [x for i in range(80) for x in (f"S a{i} b c", f"A 0 1|||R|||x{i}|||REQUIRED|||-NONE-|||0", *[f"A 1 2|||R|||y|||REQUIRED|||-NONE-|||1"] * (i % 2), "")]
    (tmp_path / "m2").write_text("\n".join(lines) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    try:
        rows = readers.lines(spark, str(tmp_path / "m2"))
        assert rows.count() == len(lines)
        got = readers.m2_pairs(rows).orderBy("line_no").collect()
        assert [(r.line_no, r.src, r.tgt) for r in got] == [(i, f"a{i} b c", f"x{i} {'y' if i % 2 else 'b'} c") for i in range(80)]
        gold = readers.m2_annotations(rows).collect()
        assert sorted((r.sent_idx, r.annotator, r.edits[0].corr[0]) for r in gold) == sorted([(i, 0, f"x{i}") for i in range(80)] + [(i, 1, "y") for i in range(1, 80, 2)])
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_lines_in_several_files_are_one(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(sinks, "LINES_A_FILE", 100)
    rows = spark.createDataFrame([(i, f"v{i}") for i in range(950)], "line_no long, value string").repartition(5)
    sinks.write_lines(rows, str(tmp_path / "out"))
    assert len(list((tmp_path / "out").glob("part-*"))) > 5
    got = readers.lines(spark, str(tmp_path / "out"), joined=True).collect()
    assert sorted((r.line_no, r.value) for r in got) == [(i, f"v{i}") for i in range(950)]


ROWS = [
    {"id": 1007, "text": 'a "quoted" } brace { and \\ back', "labels": ["l1", "l2"]},
    {"text": "plain", "label": "l", "src_tokens": ["}", "]", "\\", '"', "{["]},
    {"id": "x", "text": "\\\\", "labels": []},
    {"id": "", "text": "line\nbreak é😀", "label": None, "other": {"deep": [{"a": {"b": "}"}}, {}]}},
    {"text": "}{" * 200},
    {},
]


@pytest.mark.parametrize("layout", ["one line", "indented", "rows"])
@pytest.mark.parametrize("together", [3, 100_000])
def test_a_json_array_in_any_layout(spark, monkeypatch, tmp_path, layout, together):
    monkeypatch.setattr(readers, "TOGETHER", together)
    many = ROWS * 5
    text = {"one line": json.dumps(many), "indented": json.dumps(many, indent=2, ensure_ascii=False), "rows": "[" + ",\n".join(map(json.dumps, many)) + "]\n"}[layout]
    (tmp_path / "a.json").write_text(text)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200")
    try:
        assert spark.read.text(str(tmp_path / "a.json"), lineSep="}").rdd.getNumPartitions() > 3
        values = [json.loads(r.value) for r in readers.json_rows(spark, str(tmp_path / "a.json")).orderBy("row_no").collect()]
        assert values == many
        rows = {r.id: r for r in readers.corpus_json(spark, str(tmp_path / "a.json"), "d").collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert rows["1007"].label == "l1" and rows["1"].src_tokens == ["}", "]", "\\", '"', "{["] and rows["x"].label is None and rows[""].text == "line\nbreak é😀"
    assert all(r["from"] == "d" for r in rows.values())


@pytest.mark.parametrize("text", ["[]", " [ ]\n", ""])
def test_an_array_without_rows(spark, tmp_path, text):
    (tmp_path / "a.json").write_text(text)
    assert [(r.id, r.text) for r in readers.corpus_json(spark, str(tmp_path / "a.json"), "d").collect()] == [(readers.BLANK_ID, readers.BLANK_TEXT)]


def test_sides_in_several_files_are_read_side_by_side(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(sinks, "LINES_A_FILE", 50)
    rows = spark.createDataFrame([(i, f"s{i}", f"t{i}") for i in range(220)], "line_no long, src string, tgt string").repartition(3)
    sinks.write_parallel(rows, str(tmp_path / "p"))
    got = readers.parallel(spark, str(tmp_path / "p.src"), str(tmp_path / "p.tgt")).collect()
    assert sorted(map(tuple, got)) == [(i, f"s{i}", f"t{i}") for i in range(220)]


def test_json_array_in_several_compressed_files(spark, tmp_path):
    rows = [{"id": str(i), "text": ["plain", "a } b", "c\"}{[", "", "\\"][i % 5] * (i % 4), "labels": [{"x": "}"}] if i % 2 else []} for i in range(23)]
    text = [("[" if i == 0 else ",") + json.dumps(r) for i, r in enumerate(rows)] + ["]"]
    lines = spark.createDataFrame([(i, v) for i, v in enumerate(text)], "line_no long, value string")
    sinks.write_lines(lines, str(tmp_path / "a"), compression="gzip", a_file=5)
    assert len(list((tmp_path / "a").glob("*.gz"))) > 2
    assert [json.loads(r.value) for r in readers.json_rows(spark, str(tmp_path / "a")).orderBy("row_no").collect()] == rows


def test_blocks_and_pieces_are_made_once(spark, tmp_path):
    """What follows reads stored blocks; computed anew for each look, all texts were moved several times."""
    lines = spark.createDataFrame([("f", i, v) for i, v in enumerate(["S a b", "A 0 1|||R|||x|||REQUIRED|||-NONE-|||0", "", "S c", ""])], "file string, line_no long, value string")
    out = readers.m2_pairs(lines.repartition(3))
    assert sorted((r.src, r.tgt) for r in out.collect()) == [("a b", "x b"), ("c", "c")]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "LogicalRDD" not in plan and plan.count("Relation") == 2  # blocks, for their numbers and for themselves


def test_json_pieces_are_not_sent_through_the_driver(spark, tmp_path):
    """A table with a row for each piece is a small file, which Spark would broadcast; with millions of rows the driver's memory was full."""
    rows = [{"id": str(i), "text": "a \\ \" } b"} for i in range(50)]
    (tmp_path / "a.json").write_text(json.dumps(rows))
    out = readers.json_rows(spark, str(tmp_path / "a.json"))
    assert [json.loads(r.value) for r in out.orderBy("row_no").collect()] == rows
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and plan.count("SortMergeJoin") >= 2
