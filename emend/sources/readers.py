"""Readers of correction corpora. Every reader gives a DataFrame with explicit columns; order is a column (line_no), never a position."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import clean_space
from ..session import stored, unstored

#: Text of the row that stands for a missing split.
BLANK_ID, BLANK_TEXT = "-1", "Intentionally blank."
#: Edit types of the M2 format that change nothing.
SKIPPED_EDITS = ("noop", "UNK", "Um")

CORPUS = "id string, text string, src_tokens array<string>, label string, labels array<string>, tgt_tokens array<string>"
EXAMPLE = "struct<id:bigint,text:string,label:string,from:string,key:string,similarity:double>"
RETRIEVAL = f"id string, `from` string, text string, key_in_domain string, in_domain_examples array<{EXAMPLE}>, key_cross_domain string, cross_domain_examples array<{EXAMPLE}>"
PREDICTION = "id string, text string, label string, prediction string, response string, __original_index bigint"


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path of any file system is there and holds something."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs.exists(where) and (fs.getFileStatus(where).isDirectory() or fs.getFileStatus(where).getLen() > 0)


# --- lines --------------------------------------------------------------------


def lines(spark: SparkSession, path: str, joined: bool = False, ends: str | None = None) -> DataFrame:
    """(file, line_no, value): every line of every file, gzip or not, numbered from 0 within its file.

    Blocks of a file are numbered on their own and laid end to end, so a large file needs no single task; lines are stored once and not moved. joined: the files of a folder are
    one file, in the order of their names. ends: what ends a line, if not a line break. A missing file has no lines.
    """
    options = {"lineSep": ends} if ends else {}
    try:
        raw = spark.read.text(path, **options).select("value", F.col("_metadata.file_path").alias("of"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], "file string, line_no bigint, value string")
    raw = stored(raw.withColumn("file", F.lit(path) if joined else F.col("of")), "lines")
    path_stored = raw._stored_path
    if ends and joined:  # the line break at the end of a file that others follow is no line of its own
        last = raw.groupBy("of").agg(F.max(F.struct("block", "at")).alias("last"))
        last = last.withColumn("more", F.lead("of").over(Window.orderBy("of")).isNotNull())  # a row for each file
        raw = raw.join(F.broadcast(last), "of").where(~(F.col("more") & (F.struct("block", "at") == F.col("last")) & F.col("value").rlike(r"^\s*\z"))).drop("last", "more")
    counts = raw.groupBy("file", "of", "block").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("file").orderBy("of", "block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inner = F.col("at") - F.col("first")  # a block is read by one task, its lines one after the other
    out = raw.join(F.broadcast(counts.select("file", "of", "block", "first", before.alias("before"))), ["file", "of", "block"]).withColumn("inner", inner)  # a row for each block
    value = F.col("value") if ends else F.regexp_replace("value", r"\r$", "")
    out = out.select("file", (F.col("before") + F.col("inner")).cast("bigint").alias("line_no"), value.alias("value"))
    out._stored_path = path_stored
    return out


#: Lines, or blocks, of a file that one task looks at together.
TOGETHER = 100_000


def _chunk(at: str) -> Column:
    return F.floor(F.col(at) / TOGETHER)


def before_in_file(rows: DataFrame, at: str, weights: dict[str, Column]) -> DataFrame:
    """rows (file, at, ...) with, for each name, the sum of its weight over all rows of the file before this one.

    A file is summed in chunks of TOGETHER places, of which each gives one row to what is summed over whole files.
    """
    own = rows.withColumn("__chunk", _chunk(at)).withColumns({f"__{n}": w for n, w in weights.items()})
    inner = Window.partitionBy("file", "__chunk").orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    chunks = own.groupBy("file", "__chunk").agg(*(F.sum(f"__{n}").alias(f"__all_{n}") for n in weights))
    upto = Window.partitionBy("file").orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
    chunks = chunks.select("file", "__chunk", *(F.coalesce(F.sum(f"__all_{n}").over(upto), F.lit(0)).alias(f"__before_{n}") for n in weights))
    out = own.withColumns({f"__inner_{n}": F.coalesce(F.sum(f"__{n}").over(inner), F.lit(0)) for n in weights}).join(chunks, ["file", "__chunk"])
    return out.select(*rows.columns, *((F.col(f"__before_{n}") + F.col(f"__inner_{n}")).cast("bigint").alias(n) for n in weights))


def nonblank(rows: DataFrame) -> DataFrame:
    """Stripped lines that aren't blank; line_no stays that of the file."""
    return rows.withColumn("value", F.regexp_replace("value", r"(?U)^\s+|\s+$", "")).where("value <> ''")


def paragraphs(rows: DataFrame) -> DataFrame:
    """(file, line_no, value) with `block`, the number of the paragraph; blank lines part paragraphs and are left out.

    Each chunk of a file counts the paragraphs that begin in it; whether its first line begins one depends on the last line of the chunk before. So
    a chunk is known by how it begins, how it ends and how many begin, and these are put together in order.
    """
    own = rows.withColumn("__blank", F.trim("value") == "").withColumn("__chunk", _chunk("line_no"))
    order = Window.partitionBy("file", "__chunk").orderBy("line_no")
    own = own.withColumn("__first", (~F.col("__blank") & F.coalesce(F.lag("__blank").over(order), F.lit(True))).cast("int"))
    chunks = own.groupBy("file", "__chunk").agg(F.sum("__first").alias("starts"), F.min_by("__blank", "line_no").alias("head"), F.max_by("__blank", "line_no").alias("tail"))
    along = Window.partitionBy("file").orderBy("__chunk")
    chunks = chunks.withColumn("__goes_on", (~F.col("head") & ~F.coalesce(F.lag("tail").over(along), F.lit(True))).cast("int"))
    chunks = chunks.withColumn("__before", F.coalesce(F.sum(F.col("starts") - F.col("__goes_on")).over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    out = own.withColumn("__inner", F.sum("__first").over(order)).join(chunks.select("file", "__chunk", "__goes_on", "__before"), ["file", "__chunk"])
    return out.where(~F.col("__blank")).select(*rows.columns, (F.col("__before") + F.col("__inner") - F.col("__goes_on") - 1).alias("block"))


def zipped(left: DataFrame, right: DataFrame, cleaned: bool = True, strict: bool = True) -> DataFrame:
    """(line_no, src, tgt) of two line tables; strict: a line that one side lacks is an error when it is read."""
    one, two = left.select("line_no", F.col("value").alias("src")), right.select("line_no", F.col("value").alias("tgt"))
    out = one.join(two, "line_no", "full_outer")
    if strict:
        both = F.col("src").isNotNull() & F.col("tgt").isNotNull()
        out = out.withColumn("src", F.when(both, F.col("src")).otherwise(F.raise_error(F.lit("the files have different numbers of lines")).cast("string")))
    return out.select("line_no", clean_space(F.col("src")).alias("src"), clean_space(F.col("tgt")).alias("tgt")) if cleaned else out


def parallel(spark: SparkSession, source: str, target: str, cleaned: bool = True, drop_blank: bool = False) -> DataFrame:
    out = zipped(lines(spark, source, joined=True), lines(spark, target, joined=True), cleaned)
    return out.where("trim(src) <> '' and trim(tgt) <> ''") if drop_blank else out


def aligned(**tables: DataFrame) -> DataFrame:
    """(line_no, a column for each table) of line tables; a line that one of them lacks is an error when it is read."""
    names, out = list(tables), None
    for name, rows in tables.items():
        own = rows.select("line_no", F.col("value").alias(name))
        out = own if out is None else out.join(own, "line_no", "full_outer")
    there = F.lit(True)
    for name in names:
        there = there & F.col(name).isNotNull()
    checked = F.when(there, F.col(names[0])).otherwise(F.raise_error(F.lit("the files have different numbers of lines")).cast("string"))
    return out.withColumn(names[0], checked)


def alternating(rows: DataFrame) -> DataFrame:
    """(line_no, src, tgt) from lines of which line 2k is the target and line 2k + 1 the source; an odd number of lines is an error."""
    pair = F.floor(F.col("line_no") / 2).cast("bigint")
    pick = lambda odd: F.max(F.when(F.col("line_no") % 2 == odd, F.col("value")))
    out = rows.groupBy(pair.alias("line_no")).agg(pick(1).alias("src"), pick(0).alias("tgt"))
    checked = F.when(F.col("src").isNotNull(), F.col("src")).otherwise(F.raise_error(F.lit("an odd number of lines")).cast("string"))
    return out.select("line_no", clean_space(checked).alias("src"), clean_space(F.col("tgt")).alias("tgt"))


#: Fixed value: a mistake with its correction in the Estonian training files.
MISTAKE = r"(?s)<mistake>\s*<original>\s*(.*?)\s*</original>\s*<correction>\s*(.*?)\s*</correction>"


def mistakes(texts: DataFrame) -> DataFrame:
    """texts (value: a whole file) -> (line_no, src, tgt) of all marked mistakes with both sides."""
    strip = lambda c: F.regexp_replace(c, r"(?U)^\s+|\s+$", "")
    found = F.arrays_zip(F.regexp_extract_all("value", F.lit(MISTAKE), F.lit(1)).alias("src"), F.regexp_extract_all("value", F.lit(MISTAKE), F.lit(2)).alias("tgt"))
    out = texts.select(F.posexplode(found).alias("line_no", "x")).select(F.col("line_no").cast("bigint"), strip(F.col("x.src")).alias("src"), strip(F.col("x.tgt")).alias("tgt"))
    return out.where("src <> '' and tgt <> ''")


def marked_mistakes(spark: SparkSession, path: str) -> DataFrame:
    return mistakes(spark.read.text(path, wholetext=True))


# --- M2 -----------------------------------------------------------------------


def m2_sources(rows: DataFrame) -> DataFrame:
    """(line_no, value): the sentences of an M2 file."""
    return rows.where(F.col("value").startswith("S ")).select("line_no", F.substring("value", F.lit(3), F.length("value")).alias("value"))


def _m2_fields(lines: Column) -> Column:
    """The fields of edit lines. Each step is bound by a transform() of its own, as what a lambda names several times would be split anew each time."""
    parts = F.transform(lines, lambda v: F.split(F.substring(v, F.lit(3), F.length(v)), r"\|\|\|"))
    placed = F.transform(parts, lambda p: F.struct(p.alias("p"), F.split(F.trim(F.get(p, F.lit(0))), r"\s+").alias("at")))
    fields = lambda x: F.struct(
        F.get(x["at"], F.lit(0)).cast("int").alias("s"),
        F.get(x["at"], F.lit(1)).cast("int").alias("e"),
        F.get(x["p"], F.lit(1)).alias("type"),
        F.get(x["p"], F.lit(2)).alias("text"),
        F.element_at(x["p"], -1).cast("int").alias("annotator"),
    )
    return F.transform(placed, fields)


def m2_blocks(rows: DataFrame) -> DataFrame:
    """(file, block, sentences array<string>, edits array<struct<s,e,type,text,annotator>>), both in order.

    Lines and blocks are stored, as what follows looks at them several times, and each look would move all texts again.
    """
    rows = stored(rows.select("file", "line_no", "value"), "m2-lines")
    stripped = paragraphs(rows).withColumn("value", F.regexp_replace("value", r"(?U)^\s+|\s+$", ""))
    kept = stripped.where(F.col("value").rlike("^[SA] ")).groupBy("file", "block").agg(F.array_sort(F.collect_list(F.struct("line_no", "value"))).alias("own"))
    kept = stored(kept, "m2-blocks")
    unstored(rows)
    pick = lambda mark: F.transform(F.filter("own", lambda x: x["value"].startswith(mark)), lambda x: x["value"])
    return kept.select("file", "block", F.transform(pick("S "), lambda v: F.substring(v, F.lit(3), F.length(v))).alias("sentences"), _m2_fields(pick("A ")).alias("edits"))


def edited(tokens: Column, edits: Column) -> Column:
    """struct<tokens, shift, corrections> after all edits (s, e, type, text) in order; positions are those of the source.

    An empty text or -NONE- deletes the span, else it takes its place. corrections: idx_src, idx_tgt, corr_type.
    """
    numbers = lambda a, b: F.when(b > a, F.sequence(a, b - 1)).otherwise(F.array().cast("array<int>"))
    kind = "array<struct<idx_src:array<int>,idx_tgt:array<int>,corr_type:string>>"
    start = F.struct(tokens.alias("tokens"), F.lit(0).alias("shift"), F.array().cast(kind).alias("corrections"))

    def step(acc: Column, e: Column) -> Column:
        removed = e["text"].isNull() | e["text"].isin("", "-NONE-")
        new = F.when(removed, F.array().cast("array<string>")).otherwise(F.split(e["text"], " "))
        at, upto = acc["shift"] + e["s"], acc["shift"] + e["e"]
        out = F.concat(F.slice(acc["tokens"], F.lit(1), F.greatest(at, F.lit(0))), new, F.slice(acc["tokens"], upto + 1, F.greatest(F.size(acc["tokens"]) - upto, F.lit(0))))
        one = F.struct(numbers(e["s"], e["e"]).alias("idx_src"), F.when(removed, F.array().cast("array<int>")).otherwise(numbers(at, at + F.size(new))).alias("idx_tgt"), e["type"].alias("corr_type"))
        return F.struct(out.alias("tokens"), (acc["shift"] + F.size(new) - (e["e"] - e["s"])).alias("shift"), F.concat(acc["corrections"], F.array(one)).alias("corrections"))

    kept = F.filter(edits, lambda e: ~e["type"].isin(*SKIPPED_EDITS))
    return F.aggregate(kept, start, step)


def m2_pairs(rows: DataFrame) -> DataFrame:
    """(line_no, src, tgt, src_tokens, tgt_tokens, corrections) of an M2 file; the edits of all annotators are applied, in order."""
    out = before_in_file(m2_blocks(rows), "block", {"line_no": F.lit(1)})
    out = out.withColumn("src_tokens", F.split(F.element_at("sentences", -1), " ")).withColumn("made", F.get(F.transform(F.array("src_tokens"), lambda t: edited(t, F.col("edits"))), F.lit(0)))
    return out.select("file", "line_no", F.trim(F.array_join("src_tokens", " ")).alias("src"), F.trim(F.array_join("made.tokens", " ")).alias("tgt"), "src_tokens", F.col("made.tokens").alias("tgt_tokens"), F.col("made.corrections").alias("corrections"))


def m2_annotations(rows: DataFrame) -> DataFrame:
    """(sent_idx, source, annotator, edits array<struct<s,e,orig,corr>>): gold edits, annotators apart.

    A noop leaves its annotator with an empty list; a sentence without annotators has annotator 0. Several sentences of a block share its edits, those
    within the tokens so far. Alternative corrections are parted by two bars, -NONE- is the empty one.
    """
    blocks = before_in_file(m2_blocks(rows), "block", {"before": F.size("sentences")})
    all_words = F.split(F.array_join("sentences", " "), r"\s+")
    corrections = lambda e: F.transform(F.split(e["text"], r"\|\|"), lambda c: F.when(c == "-NONE-", "").otherwise(F.trim(c)))
    said = lambda words: F.transform("edits", lambda e: F.struct(F.when(e["type"] == "noop", -1).otherwise(e["s"]).alias("s"), F.when(e["type"] == "noop", -1).otherwise(e["e"]).alias("e"), F.when(e["e"] > e["s"], F.array_join(F.slice(words, F.greatest(e["s"], F.lit(0)) + 1, F.greatest(e["e"] - e["s"], F.lit(0))), " ")).otherwise("").alias("orig"), corrections(e).alias("corr"), e["annotator"].alias("annotator")))
    made = F.get(F.transform(F.array(all_words), said), F.lit(0))  # so bound, words are split once for all edits, not anew for each
    whole = blocks.withColumn("made", made).withColumn("annotator", F.explode(F.when(F.size("edits") > 0, F.array_distinct(F.transform("edits", lambda e: e["annotator"]))).otherwise(F.array(F.lit(0)))))
    each = whole.select("file", "before", "annotator", "made", F.col("sentences"), F.posexplode("sentences").alias("at", "source"))
    upto = F.aggregate(F.slice("sentences", F.lit(1), F.col("at") + 1), F.lit(0), lambda n, x: n + F.size(F.split(x, r"\s+")))
    each = each.withColumn("upto", upto)
    edits = F.transform(F.filter("made", lambda e: (e["annotator"] == F.col("annotator")) & (e["s"] >= 0) & (e["e"] >= 0) & (e["s"] <= F.col("upto")) & (e["e"] <= F.col("upto"))), lambda e: F.struct(e["s"].alias("s"), e["e"].alias("e"), e["orig"].alias("orig"), e["corr"].alias("corr")))
    return each.select("file", (F.col("before") + F.col("at")).cast("bigint").alias("sent_idx"), F.trim("source").alias("source"), "annotator", edits.alias("edits"))


# --- JSON ---------------------------------------------------------------------


def json_rows(spark: SparkSession, path: str) -> DataFrame:
    """(row_no, value): the objects of a JSON array, as text, however the file is laid out and however long it is. The files of a folder are one array, cut between rows.

    The file is cut at closing braces, wherever these stand. What a piece does to the state (inside a string or not, how deep) is known from the piece for both
    ways in which it may begin, so that two running sums give the state at each of its ends; a brace that leads back to the array ends a row. Tables with a
    row for each piece are small as files and large in memory, so they are merged with the texts: none is sent through the driver.
    """
    read = lines(spark, path, joined=True, ends="}")
    pieces = read.withColumn("file", F.lit(""))  # there is one
    bare = F.regexp_replace("value", r"(?s)\\.", "")  # without escaped signs, quotes among them
    parts = F.split(bare, '"')
    without = lambda text, signs: F.length(F.regexp_replace(text, signs, ""))  # noqa: E731  removing the few signs, not each of the many others
    count = lambda text: without(text, r"[\]}]+") - without(text, r"[\[{]+")
    # what stands outside strings if the piece begins outside one: every second part from the first; else from the second
    deeper = lambda odd: F.aggregate(F.transform(parts, lambda x, i: F.when(i % 2 == odd, count(x)).otherwise(0)), F.lit(0), lambda a, x: a + x)
    pieces = stored(pieces.select("file", "line_no", "value", (F.size(parts) - 1).alias("quotes"), deeper(0).alias("outside"), deeper(1).alias("inside")), "json-pieces")
    unstored(read)
    # the state is found without the texts, which are moved once
    own = stored(before_in_file(pieces.drop("value"), "line_no", {"before": F.col("quotes")}), "json-quotes").withColumn("begins", F.col("before") % 2)
    closed = ((F.col("begins") + F.col("quotes")) % 2 == 0).cast("int")  # the brace after the piece stands outside strings
    own = own.withColumn("closed", closed).withColumn("deeper", F.when(F.col("begins") == 0, F.col("outside")).otherwise(F.col("inside")))
    own = stored(before_in_file(own.select("file", "line_no", "closed", "deeper"), "line_no", {"depth": F.col("deeper") - F.col("closed")}), "json-depths")
    own = own.select("file", "line_no", ((F.col("closed") == 1) & (F.col("depth") + F.col("deeper") == 2)).cast("int").alias("ends"))
    own = before_in_file(own, "line_no", {"row_no": F.col("ends")})
    sizes = own.groupBy("file", "row_no").agg(F.count("*").alias("n"))
    own = stored(own.join(sizes.hint("merge"), ["file", "row_no"]), "json-rows")
    whole = pieces.select("file", "line_no", "value").join(own.hint("merge"), ["file", "line_no"])
    # a row of one piece is whole; the part after the last row has no end; rows are as long as their pieces
    ended = F.col("ends") > 0  # also part of the value, so that no later filter on it is moved before the join, to pieces that are no rows
    one = whole.where((F.col("n") == 1) & ended).select("row_no", F.when(ended, F.array(F.struct("line_no", "value"))).alias("own"))
    more = pieces.select("file", "line_no", "value").join(own.where("n > 1").hint("merge"), ["file", "line_no"])
    more = more.groupBy("row_no").agg(F.max("ends").alias("ends"), F.array_sort(F.collect_list(F.struct("line_no", "value"))).alias("own")).where("ends = 1").drop("ends")
    whole = one.unionByName(more)
    text = F.concat(F.array_join(F.transform("own", lambda x: x["value"]), "}"), F.lit("}"))
    return whole.select("row_no", F.regexp_replace(text, r"^[\s\[,\x{feff}]+", "").alias("value"))


def corpus_json(spark: SparkSession, path: str, dataset: str) -> DataFrame:
    """A JSON array of rows; a missing id becomes the row's number, the target is label, else the first of labels. An array without rows gives the row that stands for a missing split."""
    raw = json_rows(spark, path).select("row_no", F.from_json("value", CORPUS, {"mode": "FAILFAST"}).alias("j")).select("row_no", "j.*")
    none = spark.range(1).select(F.lit(BLANK_ID).alias("id"), F.lit(BLANK_TEXT).alias("text")).join(raw.agg(F.count("*").alias("n")).where("n = 0"))  # one row each
    raw = raw.unionByName(none.drop("n"), allowMissingColumns=True)
    out = raw.withColumn("id", F.coalesce("id", F.col("row_no").cast("string"))).withColumn("label", F.coalesce("label", F.get("labels", F.lit(0))))
    return out.drop("row_no").withColumn("from", F.lit(dataset))


def required_labels(rows: DataFrame) -> DataFrame:
    """Rows, with an error where one has no target."""
    return rows.withColumn("label", F.when(F.col("label").isNotNull(), F.col("label")).otherwise(F.raise_error(F.lit("a row has no label")).cast("string")))


def standard(rows: DataFrame, dataset: str) -> DataFrame:
    """(id, from, text[, label])."""
    own = ["label"] if "label" in rows.columns else []
    return rows.select(F.col("id").cast("string").alias("id"), F.lit(dataset).alias("from"), "text", *own)


def not_blank(rows: DataFrame) -> DataFrame:
    """Without the row that stands for a missing split."""
    return rows.where(F.col("text") != BLANK_TEXT)


#: Names under which a split is asked for, and stored.
SPLITS = {"train": "train", "valid": "valid", "validation": "valid", "dev": "valid", "test": "test", "infer": "test"}


def split_path(spark: SparkSession, folder: str, split: str) -> str | None:
    """The file of a split, if it is there; a folder with one raw file gives that for any split."""
    name = SPLITS[split]
    for candidate in (f"{folder}/{name}.json", f"{folder}/{name}.jsonl", f"{folder}/{name}.parquet", f"{folder}/data.json"):
        if exists(spark, candidate):
            return candidate
    return None


def dataset_state(spark: SparkSession, folder: str) -> str:
    """split: a file for each split; raw: one file that is to be split; partial: some splits; missing."""
    there = [s for s in ("train", "valid", "test") if any(exists(spark, f"{folder}/{s}.{e}") for e in ("json", "jsonl", "parquet"))]
    if len(there) == 3:
        return "split"
    return "partial" if there else "raw" if exists(spark, f"{folder}/data.json") else "missing"


def dataset_split(spark: SparkSession, folder: str, dataset: str, split: str) -> DataFrame:
    """One split; empty where it is missing."""
    path = split_path(spark, folder, split)
    if path is None:
        return spark.createDataFrame([], T._parse_datatype_string(CORPUS)).withColumn("from", F.lit(dataset))
    return not_blank(corpus_json(spark, path, dataset))


def levels(rows: DataFrame, level: str, split: str) -> DataFrame:
    """Rows of one proficiency level (A, B, C, N or all) and split, of a table that is stored by both: only its folders are read."""
    out = rows.where(F.col("split") == SPLITS.get(split, split))
    return out if level == "all" else out.where(F.col("level") == level)


def retrieval(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RETRIEVAL).json(path)


def predictions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PREDICTION).json(path)


def numbered_json(rows: DataFrame, schema: str = "id string, text string") -> DataFrame:
    """lines() of JSON -> (line_no, ok, parsed fields, value); ok is false where a line can't be parsed."""
    parsed = F.from_json("value", schema + ", _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    return rows.select("line_no", "value", parsed.alias("j")).select("line_no", "value", (F.col("j._bad").isNull() & F.col("j").isNotNull()).alias("ok"), "j.*").drop("_bad")


def valid_prefix(expected: DataFrame, found: DataFrame) -> DataFrame:
    """The longest beginning of found (line_no, id, text, ok, ...) that agrees with expected (line_no, id, text)."""
    want = expected.select("line_no", F.col("id").alias("want_id"), F.col("text").alias("want_text"))
    both = found.join(want, "line_no", "left")
    text_differs = F.col("text").isNotNull() & F.col("want_text").isNotNull() & (F.col("text") != F.col("want_text"))
    bad = ~F.col("ok") | F.col("want_id").isNull() | ~F.col("id").eqNullSafe(F.col("want_id")) | text_differs
    first = both.where(bad).agg(F.min("line_no").alias("first_bad"))
    return found.crossJoin(F.broadcast(first)).where(F.col("first_bad").isNull() | (F.col("line_no") < F.col("first_bad"))).drop("first_bad")  # one row


def verb_forms(spark: SparkSession, path: str | None) -> DataFrame:
    """(word_from, word_to, tag_from, tag_to) of a vocabulary file, `w1_w2:tag1_tag2` a line; none if there is no file."""
    rows = lines(spark, path) if path and exists(spark, path) else spark.createDataFrame([], "file string, line_no bigint, value string")
    parts = F.split("value", ":")
    words, tags = F.split(F.get(parts, F.lit(0)), "_"), F.split(F.get(parts, F.lit(1)), "_")
    return nonblank(rows).select(F.get(words, F.lit(0)).alias("word_from"), F.get(words, F.lit(1)).alias("word_to"), F.get(tags, F.lit(0)).alias("tag_from"), F.get(tags, F.lit(1)).alias("tag_to"))


def vector_cache(spark: SparkSession, folder: str, table: str) -> DataFrame:
    """`pair_vectors` or `site_vectors` of a stored cache."""
    return spark.read.parquet(f"{folder}/{table}")


def label_path(spark: SparkSession, prefix: str) -> str:
    if not exists(spark, f"{prefix}.label"):
        raise FileNotFoundError(f"{prefix}.label")
    return f"{prefix}.label"


def register(spark: SparkSession, folders: dict[str, str]) -> None:
    """Temporary views of stored tables, by name."""
    for name, path in folders.items():
        spark.read.parquet(path).createOrReplaceTempView(name)
