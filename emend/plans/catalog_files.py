"""Further registered queries: what readers and writers give back, answers, prompts, retrieval, and scores of derived edits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import tags, text
from ..operators import cleanup, edits, hints, m2, models, prompts, retrieval, vectors
from ..operators.ordering import numbered
from ..session import stored, work_dir
from ..sources import readers, sinks
from ..streaming import resume
from .catalog import PAIRS_SQL, SENTENCES_SQL, pairs, query, sentences, table

_CLEAN = r"trim(regexp_replace({0}, '\s+', ' ', 'g'))"
_TURNS_SQL = "t AS (SELECT row_number() OVER (ORDER BY conv_id, turn) - 1 AS line_no, conv_id, turn, role, text FROM conversations)"


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conversations with line_no, their number."""
    return numbered(table(spark, sf_dir, "conversations"), ["conv_id", "turn"], "line_no")


# --- files --------------------------------------------------------------------


@query(f"WITH {_TURNS_SQL} SELECT line_no, {_CLEAN.format('text')} AS src, {_CLEAN.format('role')} AS tgt FROM t WHERE trim(text) <> ''")
def parallel_files(spark, sf_dir):
    """Two files of lines, written and read side by side; pairs with a blank side left out."""
    path = work_dir(spark, "parallel")
    sinks.write_parallel(turns(spark, sf_dir).select("line_no", F.col("text").alias("src"), F.col("role").alias("tgt")), path)
    return readers.parallel(spark, f"{path}.src", f"{path}.tgt", drop_blank=True)


@query(f"WITH {_TURNS_SQL} SELECT line_no, trim(regexp_replace(trim(text, ' '), '[\\r\\n]+', ' ', 'g')) AS body, role, conv_id::VARCHAR AS conv FROM t")
def aligned_files(spark, sf_dir):
    """Three files of lines, put together by line."""
    own = turns(spark, sf_dir)
    found = {}
    for name, value in (("body", F.col("text")), ("role", F.col("role")), ("conv", F.col("conv_id").cast("string"))):
        path = work_dir(spark, name)
        sinks.write_lines(own.select("line_no", value.alias("value")), path)
        found[name] = readers.lines(spark, path, joined=True)
    return readers.aligned(**found).withColumn("body", F.trim("body"))


@query("SELECT doc_id::VARCHAR AS id, text, source AS label, upper(lang) AS prediction, lang || ' ' || source AS response, doc_id AS __original_index FROM documents")
def prediction_files(spark, sf_dir):
    """Answers written as JSON lines and read by their schema."""
    path, docs = work_dir(spark, "predictions"), table(spark, sf_dir, "documents")
    response = F.when(F.col("lang").isNotNull() & F.col("source").isNotNull(), F.concat_ws(" ", "lang", "source"))
    sinks.write_json(docs.select(F.col("doc_id").cast("string").alias("id"), "text", F.col("source").alias("label"), F.upper("lang").alias("prediction"), response.alias("response"), F.col("doc_id").alias("__original_index")), path)
    return readers.predictions(spark, path)


@query(f"WITH {_TURNS_SQL}, v AS (SELECT role || line_no AS word_from, conv_id || 'x' AS word_to, 'VB' AS tag_from, 'VB' || turn AS tag_to FROM t) SELECT * FROM v")
def verb_form_files(spark, sf_dir):
    """A vocabulary of word and tag pairs, written as lines and read back."""
    path, own = work_dir(spark, "verbs"), turns(spark, sf_dir)
    line = F.concat("role", F.col("line_no").cast("string"), F.lit("_"), F.col("conv_id").cast("string"), F.lit("x:VB_VB"), F.col("turn").cast("string"))
    sinks.write_lines(own.select("line_no", line.alias("value")), path)
    return readers.verb_forms(spark, path).select("word_from", "word_to", "tag_from", "tag_to")


@query(f"WITH {_TURNS_SQL} SELECT conv_id, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1)::BIGINT AS line_no, role AS src, 'x' || turn AS tgt FROM t")
def marked_mistakes(spark, sf_dir):
    """Mistakes with their corrections in marked text, a text for each conversation."""
    mark = F.concat(F.lit("<mistake>\n <original> "), "role", F.lit(" </original>\n<correction>x"), F.col("turn").cast("string"), F.lit(" </correction></mistake>\n"))
    own = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", mark.alias("m")))), lambda x: x["m"]), "").alias("value"))
    # places are counted within a text; its key goes along in front of each source
    keyed = own.withColumn("value", F.replace(F.col("value"), F.lit("<original> "), F.concat(F.lit("<original> "), F.col("conv_id").cast("string"), F.lit("#"))))
    parts = F.split("src", "#", 2)
    return readers.mistakes(keyed.select("value")).select(F.get(parts, F.lit(0)).cast("bigint").alias("conv_id"), "line_no", F.get(parts, F.lit(1)).alias("src"), "tgt")


@query("""WITH r AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rank, text FROM conversations)
SELECT conv_id || '_test' AS id, 'test' AS "from", count(*)::INTEGER AS n, string_agg(text, '|' ORDER BY rank) FILTER (WHERE rank <= 3) AS firsts, conv_id::VARCHAR AS text FROM r GROUP BY conv_id""")
def retrieval_files(spark, sf_dir):
    """Turns as demonstrations of their conversation, as rows of a retrieval file, written, read, joined by id and cut to three."""
    own = numbered_turns(spark, sf_dir)
    near = own.select("line_no", F.lit(1).alias("site_rank"), "rank", F.col("turn").alias("id"), "text", F.col("role").alias("label"), F.col("role").alias("key"), F.lit(0.5).alias("similarity"))
    none = spark.createDataFrame([], "line_no bigint, draw int, text string, label string")
    lines = own.select("line_no").distinct().withColumn("src", F.col("line_no").cast("string"))
    path = work_dir(spark, "retrieval")
    sinks.write_json(retrieval.retrieval_rows(lines, retrieval.example_lists(near, none, "turns"), "test"), path)
    rows = lines.select(F.concat_ws("_", "src", F.lit("test")).alias("id"))
    found = retrieval.joined_by_id(rows, readers.retrieval(spark, path))
    firsts = F.array_join(F.transform(F.slice("in_domain_examples", 1, 3), lambda e: e["text"]), "|")
    return found.select("id", "from", F.size("in_domain_examples").alias("n"), firsts.alias("firsts"), "text")


def numbered_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns with line_no, their conversation, and rank, from 1."""
    from pyspark.sql import Window

    return table(spark, sf_dir, "conversations").withColumn("line_no", F.col("conv_id")).withColumn("rank", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")))


@query("""WITH r AS (SELECT conv_id, count(*) AS n, count(*) FILTER (WHERE text = role) AS same FROM conversations GROUP BY conv_id)
SELECT count(*) AS sentences, sum(n)::BIGINT AS examples, sum(same)::BIGINT AS correct, round(sum(n) / count(*), 9) AS per_sentence, round(sum(same) / count(*), 9) AS correct_per_sentence FROM r""")
def retrieval_statistics(spark, sf_dir):
    own = numbered_turns(spark, sf_dir)
    near = own.select("line_no", F.lit(1).alias("site_rank"), "rank", F.col("turn").alias("id"), "text", F.col("role").alias("label"), F.col("role").alias("key"), F.lit(0.5).alias("similarity"))
    none = spark.createDataFrame([], "line_no bigint, draw int, text string, label string")
    lines = own.select("line_no").distinct().withColumn("src", F.lit(""))
    out = retrieval.retrieval_stats(retrieval.retrieval_rows(lines, retrieval.example_lists(near, none, "turns"), "test"))
    return out.select("sentences", "examples", "correct", F.round("per_sentence", 9).alias("per_sentence"), F.round("correct_per_sentence", 9).alias("correct_per_sentence"))


@query(f"WITH {_TURNS_SQL}, h AS (SELECT count(*) // 2 AS half FROM t) SELECT line_no, line_no < half AS kept FROM t, h")
def resumed_run(spark, sf_dir):
    """A run of which the first half is stored: what is kept, and what is still to do."""
    own = turns(spark, sf_dir).select("line_no", F.col("line_no").cast("string").alias("id"), "text")
    path, half = work_dir(spark, "stored"), own.count() // 2
    stored = own.where(F.col("line_no") < half).select("line_no", F.to_json(F.struct("id", "text", F.lit("p").alias("prediction"), F.lit("r").alias("response"))).alias("value"))
    sinks.write_lines(stored, path)
    kept, todo = resume.resumed(own, readers.lines(spark, path, joined=True))
    return kept.select("line_no", F.lit(True).alias("kept")).union(todo.select("line_no", F.lit(False).alias("kept")))


@query("""WITH d AS (SELECT *, row_number() OVER (ORDER BY doc_id) - 1 AS row_no FROM documents)
SELECT CASE WHEN doc_id % 2 = 0 THEN doc_id::VARCHAR ELSE row_no::VARCHAR END AS id, 'docs' AS "from", text, CASE WHEN doc_id % 3 = 0 THEN lang ELSE source END AS label FROM d""")
def json_array(spark, sf_dir):
    """Documents as one JSON array, written as a file and read again in parallel; every second one has no id, some have no label but labels."""
    docs = numbered(table(spark, sf_dir, "documents"), ["doc_id"], "line_no")
    own = F.struct(F.when(F.col("doc_id") % 2 == 0, F.col("doc_id")).alias("id"), "text", F.split("text", " ").alias("src_tokens"), F.when(F.col("doc_id") % 3 == 0, F.col("lang")).alias("label"), F.array("source", "lang").alias("labels"))
    rows = docs.select("line_no", F.concat(F.when(F.col("line_no") == 0, "[").otherwise(","), F.to_json(own)).alias("value"))
    path, end = work_dir(spark, "array"), docs.agg(F.count("*").alias("line_no")).withColumn("value", F.when(F.col("line_no") == 0, "[]").otherwise("]"))
    sinks.write_lines(rows.unionByName(end), path, compression="gzip", a_file=5_000)
    return readers.standard(readers.corpus_json(spark, path, "docs"), "docs").select("id", "from", "text", "label")


# --- text and answers ---------------------------------------------------------


@query(r"""WITH f AS (SELECT page_id, url, html, strpos(html, '<title>') AS s FROM pages),
g AS (SELECT *, split_part(substr(html, s + 7), '<title>', 1) AS after FROM f), h AS (SELECT *, regexp_replace(split_part(after, '</title', 1), '^\s+|\s+$', '', 'g') AS found FROM g)
SELECT page_id, CASE WHEN s > 0 AND contains(html, '</title') AND NOT contains(html, 'No errors found') AND found <> '' THEN found ELSE url END AS legacy,
  regexp_replace(html, '^\s+|\s+$', '', 'g') AS normal, html AS "no" FROM h""")
def legacy_answers(spark, sf_dir):
    """Answers between tags by the older rule, stripped, and as they are."""
    pages = table(spark, sf_dir, "pages")
    return pages.select("page_id", text.legacy_answer(F.col("html"), F.col("url"), "<title>", "</title>").alias("legacy"), text.answer(F.col("html"), F.col("url"), "normal").alias("normal"), text.answer(F.col("html"), F.col("url"), "no").alias("no"))


_CP1252 = "".join(map(chr, (c for c in range(0x80, 0xA0) if c not in (0x81, 0x8D, 0x8F, 0x90, 0x9D))))


@query(rf"""SELECT doc_id, md5(replace(text, ' ', '')) AS no_blanks, regexp_full_match(text, '[\x00-\x7F]*') AS ascii, md5(translate(text, '{_CP1252}', '{_CP1252.encode("latin-1").decode("cp1252").replace("'", "''")}')) AS repaired FROM documents""")
def repaired_texts(spark, sf_dir):
    c = F.col("text")
    md5 = lambda x: F.md5(x.cast("binary"))
    return table(spark, sf_dir, "documents").select("doc_id", md5(text.strip_blanks(c)).alias("no_blanks"), text.is_ascii(c).alias("ascii"), md5(text.repaired(c)).alias("repaired"))


@query(rf"""WITH {SENTENCES_SQL}
SELECT doc_id, sent, list_reduce(tokens, lambda acc, x: CASE WHEN x IN ('n''t', '''d', '''ll', '''m', '''re', '''s', '''ve') THEN acc || x ELSE acc || ' ' || x END) AS joined,
  lower(replace(array_to_string(list_filter(tokens, lambda x, i: i = 1 OR x <> tokens[i - 1]), ' '), 'the', 'THE')) AS normal FROM sentences""")
def joined_clitics(spark, sf_dir):
    """Clitics joined to the token before them; and without doubled tokens, in lower case."""
    return sentences(spark, sf_dir).select("doc_id", "sent", text.join_clitics(F.col("src")).alias("joined"), text.normalized(F.col("src"), {"the": "THE"}).alias("normal"))


@query(rf"""WITH {SENTENCES_SQL}, l AS (SELECT doc_id, sent, array_to_string(list_transform(tokens, lambda x: x || 'SEPL|||SEPR$KEEP'), ' ') AS line, src, len(tokens)::INTEGER AS n FROM sentences WHERE NOT contains(src, 'SEPL'))
SELECT doc_id, sent, md5(line) AS line_md5, src AS back, n FROM l""")
def tagged_lines(spark, sf_dir):
    """Lines of the tag format, and the tokens read from them again."""
    items = F.transform("tokens", lambda t: F.struct(t.alias("token"), F.array(F.lit(tags.KEEP)).alias("tags")))
    rows = sentences(spark, sf_dir).where(tags.is_taggable(F.col("src")) & ~F.contains("src", F.lit("SEPL"))).select("doc_id", "sent", tags.tagged_line(items).alias("line"))
    back = rows.withColumn("items", tags.tagged_items(F.col("line")))
    return back.select("doc_id", "sent", F.md5(F.col("line").cast("binary")).alias("line_md5"), F.array_join(F.transform("items", lambda x: x["token"]), " ").alias("back"), F.size(F.filter("items", lambda x: F.get(x["tags"], F.lit(0)) == tags.KEEP)).alias("n"))


# --- prompts ------------------------------------------------------------------

_FEW = prompts.TEMPLATES["few_shot"]


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


@query(f"""SELECT conv_id, turn, 'Sentence: ' || text || chr(10) || 'Correction: ' || role AS reading,
  md5({_quoted(_FEW.prompt.partition('{examples}')[0])} || 'Sentence: ' || role || chr(10) || '{_FEW.answer_start}' || text || '{_FEW.answer_end}' || chr(10) || chr(10) || 'Sentence: ' || text || chr(10)) AS prompt_md5,
  md5({_quoted(_FEW.system + chr(10))} || text) AS flat_md5 FROM conversations""")
def prompt_texts(spark, sf_dir):
    """Each turn in a prompt with one demonstration, and as one text after the system's."""
    rows = table(spark, sf_dir, "conversations")
    examples = F.array(F.struct(F.col("role").alias("text"), F.col("text").alias("label")))
    md5 = lambda x: F.md5(x.cast("binary"))
    flat = F.concat(F.get(prompts.messages(_FEW, F.col("text")), F.lit(0))["content"], F.lit("\n"), F.get(prompts.messages(_FEW, F.col("text")), F.lit(1))["content"])
    return rows.select("conv_id", "turn", prompts.reading_prompt(F.col("text"), F.col("role")).alias("reading"), md5(prompts.prompt(_FEW, examples, F.col("text"))).alias("prompt_md5"), md5(flat).alias("flat_md5"))


@query(rf"SELECT conv_id, turn, {_CLEAN.format('text')} AS answer FROM conversations")
def generated_answers(spark, sf_dir):
    """Prompts answered by the stand-in model, which gives back the sentence (a whole text, its line breaks folded); the answer is read from its tags."""
    rows = table(spark, sf_dir, "conversations")
    asked = rows.select("conv_id", "turn", F.concat(F.lit("Sentence: "), text.clean_space(F.col("text"))).alias("sentence"))
    out = models.generated(asked, models.stub_generator)
    return out.select("conv_id", "turn", text.clean_space(text.between_tags(F.col("response"), text.ANSWER_START, text.ANSWER_END)).alias("answer"))


# --- choosing -----------------------------------------------------------------


@query("""WITH p AS (SELECT doc_id AS id, row_number() OVER (ORDER BY doc_id) - 1 AS place FROM documents), n AS (SELECT count(*) AS n FROM documents),
d AS (SELECT conv_id, turn, unnest([1, 2]) AS draw FROM conversations), k AS (SELECT DISTINCT conv_id, draw FROM d),
a AS (SELECT conv_id, draw, ('0x' || substr(md5(conv_id || '|' || draw || '|0'), 1, 13))::BIGINT % n AS place, CASE WHEN ('0x' || substr(md5(conv_id || '|0|5'), 1, 13))::BIGINT % 2 = 0 THEN 1 ELSE -1 END AS sign FROM k, n)
SELECT conv_id, draw::INTEGER AS draw, id, sign FROM a JOIN p USING (place)""")
def drawn_with_replacement(spark, sf_dir):
    """Two documents for each conversation, each draw for itself, and a random sign."""
    lines = table(spark, sf_dir, "conversations").select("conv_id").distinct()
    out = retrieval.drawn(lines, table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id")), 2, "conv_id")
    return out.select("conv_id", "draw", "id", retrieval.random_sign(F.col("conv_id"), 5).alias("sign"))


@query("""WITH i AS (SELECT conv_id, role, sum(turn + 0.5) AS similarity, count(*) AS times FROM conversations GROUP BY conv_id, role),
e AS (SELECT conv_id, role, similarity, unnest(range(1, times + 1)) AS turn FROM i),
r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, similarity DESC, role) AS rank FROM e)
SELECT conv_id, rank::INTEGER AS rank, role FROM r WHERE turn = 1 OR rank <= 5""")
def merged_examples(spark, sf_dir):
    """One demonstration for each role of a conversation, repeated in rounds up to five."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", F.col("role").alias("data_item_id"), (F.col("turn") + 0.5).alias("similarity"))
    return retrieval.merged_examples(rows, 5, "conv_id").select("conv_id", "rank", F.col("data_item_id").alias("role"))


@query("""WITH n AS (SELECT count(*) AS n FROM documents), r AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS line_no FROM documents)
SELECT doc_id, CASE WHEN line_no / n >= 0.8 THEN 'test' WHEN line_no / n >= 0.7 THEN 'valid' ELSE 'train' END AS split FROM r, n""")
def tail_split(spark, sf_dir):
    rows = numbered(table(spark, sf_dir, "documents").select("doc_id"), ["doc_id"], "line_no")
    return retrieval.tail_split(rows, 20, 10).select("doc_id", "split")


@query("""WITH p AS (SELECT doc_id, ['/a/conll14/x.json', '/b/bea19_run/out.json', '/c/estgec/y', '/none/z.json', '/d/Falko_Merlin/q'][doc_id % 5 + 1] AS path FROM documents)
SELECT doc_id, ['conll14', '', 'estgec', '', 'falko_merlin'][doc_id % 5 + 1] AS dataset, doc_id % 5 = 0 AS english FROM p""")
def dataset_names(spark, sf_dir):
    """The dataset that a path names, and whether its name is that of an English source."""
    paths = F.array(*map(F.lit, ("/a/conll14/x.json", "/b/bea19_run/out.json", "/c/estgec/y", "/none/z.json", "/d/Falko_Merlin/q")))
    rows = table(spark, sf_dir, "documents").select("doc_id", F.get(paths, (F.col("doc_id") % 5).cast("int")).alias("path"))
    out = rows.withColumn("dataset", cleanup.dataset_of(F.col("path")))
    return out.select("doc_id", "dataset", hints.is_english(F.col("dataset")).alias("english"))


# --- vectors ------------------------------------------------------------------


@query("""WITH r AS (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS pos, embedding FROM embeddings), p AS (SELECT a.pos // 2 AS pair, a.embedding AS x, b.embedding AS y FROM r a JOIN r b ON a.pos % 2 = 0 AND b.pos = a.pos + 1)
SELECT pair, unnest(range(len(x)))::INTEGER AS i, round(unnest(list_transform(list_zip(x, y), lambda z: z[1]::DOUBLE - z[2]::DOUBLE)), 6) AS d FROM p""")
def pair_differences(spark, sf_dir):
    rows = numbered(table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("vec")), ["vec_id"], "pos")
    out = vectors.pair_differences(rows).where("vec is not null")
    return out.select("pair", F.posexplode("vec").alias("i", "d")).select("pair", "i", F.round("d", 6).alias("d"))


# --- scores of derived edits --------------------------------------------------

#: Tokens up to which derived systems change a sentence; longer ones they leave as they are, since a lattice of many changes among few words has millions of arcs.
CHANGED_UPTO = 200
#: How many places of a sentence leave a rest when divided: of all sentences, and of those that a system changes.
_EVERY = "greatest(0, (len(tokens) - {1} + {0} - 1) // {0})".format
_SAID = f"CASE WHEN len(tokens) > {CHANGED_UPTO} THEN 0 ELSE {{}} END".format


def _mark(x, sign: str = "§"):
    return F.concat(x, F.lit(sign))


def _said(rest: int = 3):
    """What a system makes of a sentence: every fourteenth token marked; long ones stay as they are."""
    return F.array_join(F.transform("tokens", lambda x, i: F.when((F.size("tokens") <= CHANGED_UPTO) & (i % 14 == rest), _mark(x)).otherwise(x)), " ")


def _edits(where, sign: str = "§"):
    """Gold edits that mark the tokens at some places."""
    edit = lambda x, i: F.when(where(i), F.struct(i.alias("s"), (i + 1).alias("e"), x.alias("orig"), F.array(_mark(x, sign)).alias("corr")))
    return F.filter(F.transform("tokens", edit), lambda e: e.isNotNull())


@query(rf"""WITH {SENTENCES_SQL},
c AS (SELECT sum({_SAID(_EVERY(14, 3))})::BIGINT AS correct, sum({_EVERY(7, 3)})::BIGINT AS gold FROM sentences)
SELECT correct, correct AS proposed, gold, 1.0::DOUBLE AS precision, round(correct / gold, 9) AS recall, round(1.25 * (correct / gold) / (0.25 + correct / gold), 9) AS f FROM c""")
def m2_derived(spark, sf_dir):
    """All sentences; the annotator changes every seventh token, and the system does every second of these changes."""
    own = sentences(spark, sf_dir).select(F.xxhash64("doc_id", "sent").alias("sent_idx"), F.col("src").alias("source"), _said().alias("hypothesis"), F.lit(0).alias("annotator"), _edits(lambda i: i % 7 == 3).alias("edits"))
    out = m2.corpus_score(edits.spread(own))
    return out.select("correct", "proposed", "gold", "precision", F.round("recall", 9).alias("recall"), F.round("f", 9).alias("f"))


@query(rf"""WITH {SENTENCES_SQL},
o AS (SELECT doc_id, sent, {_SAID(_EVERY(14, 3))} AS p, [{{'c': {_SAID(_EVERY(14, 3))}, 'g': {_EVERY(7, 3)}}}, {{'c': {_SAID(_EVERY(28, 3))}, 'g': {_EVERY(28, 3)}}}, {{'c': {_SAID(_EVERY(42, 3))} + {_SAID(_EVERY(42, 17))}, 'g': {_EVERY(42, 3)} + {_EVERY(42, 17)}}}, {{'c': 0, 'g': {_EVERY(7, 3)}}}][1:2 + sent % 3] AS o FROM sentences),
l AS (SELECT list({{'cc': 0::BIGINT, 'pp': 0::BIGINT, 'gg': 0::BIGINT, 'p': p::BIGINT, 'o': list_transform(o, lambda x: {{'c': x.c::BIGINT, 'g': x.g::BIGINT}})}} ORDER BY doc_id, sent) AS l FROM o),
r AS (SELECT list_reduce(list_prepend({{'cc': 0::BIGINT, 'pp': 0::BIGINT, 'gg': 0::BIGINT, 'p': 0::BIGINT, 'o': [{{'c': 0::BIGINT, 'g': 0::BIGINT}}]}}, l), lambda a, x: list_transform([list_reverse_sort(list_transform(x.o, lambda y, i: {{'f': CASE WHEN 0.25 * (a.gg + y.g) + a.pp + x.p > 0 THEN 1.25::DOUBLE * (a.cc + y.c) / (0.25::DOUBLE * (a.gg + y.g) + (a.pp + x.p)) ELSE 1.0::DOUBLE END, 'c': a.cc + y.c, 'd': -(0.25::DOUBLE * (a.gg + y.g) + a.pp + x.p), 'i': -i, 'g': a.gg + y.g}}))[1]], lambda b: {{'cc': b.c, 'pp': a.pp + x.p, 'gg': b.g, 'p': 0::BIGINT, 'o': x.o}})[1]) AS t FROM l)
SELECT t.cc AS correct, t.pp AS proposed, t.gg AS gold, round(t.cc / t.pp, 9) AS precision, round(t.cc / t.gg, 9) AS recall, round(1.25 * t.cc / (0.25 * t.gg + t.pp), 9) AS f FROM r""")
def m2_running(spark, sf_dir):
    """All sentences, in order, with two to four annotators: each sentence takes the one that serves the corpus best so far."""
    own = sentences(spark, sf_dir, dealt=True).select(F.shiftleft("doc_id", 24).bitwiseOR(F.col("sent")).alias("sent_idx"), "sent", F.col("src").alias("source"), _said().alias("hypothesis"), "tokens")
    gold = F.array(_edits(lambda i: i % 7 == 3), _edits(lambda i: i % 28 == 3), _edits(lambda i: (i % 42).isin(3, 17)), _edits(lambda i: i % 7 == 3, "#"))
    own = own.select("sent_idx", "source", "hypothesis", F.posexplode(F.slice(gold, F.lit(1), F.col("sent") % 3 + 2)).alias("annotator", "edits"))
    out = m2.corpus_score(own)
    return out.select("correct", "proposed", "gold", *(F.round(c, 9).alias(c) for c in ("precision", "recall", "f")))


def _block_lines(rows, *edits_):
    """rows (doc_id, sent, src, ...) as lines of an M2 file for each document: a sentence, its edits, a blank line."""
    block = F.concat(F.array(F.concat(F.lit("S "), "src")), *edits_, F.array(F.lit("")))
    whole = rows.select("doc_id", "sent", block.alias("lines")).groupBy("doc_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("sent", "lines"))), lambda x: x["lines"])).alias("lines"))
    return whole.select(F.col("doc_id").cast("string").alias("file"), F.posexplode("lines").alias("line_no", "value")).withColumn("line_no", F.col("line_no").cast("bigint"))


def _edit_line(start, end, kind, said, annotator: int):
    return F.concat(F.lit("A "), start.cast("string"), F.lit(" "), end.cast("string"), F.lit(f"|||{kind}|||"), said, F.lit(f"|||REQUIRED|||-NONE-|||{annotator}"))


@query(rf"""WITH {SENTENCES_SQL}, own AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY sent) - 1 AS line_no FROM sentences WHERE NOT contains(src, '|'))
SELECT doc_id, line_no, src, trim(array_to_string(flatten(list_transform(tokens, lambda x, i: CASE WHEN (i - 1) % 11 = 5 THEN [] WHEN (i - 1) % 7 = 3 THEN ['X||Y', 'z'] ELSE [x] END)), ' ')) AS tgt FROM own""")
def m2_apply(spark, sf_dir):
    """Sentences of a document as blocks of an M2 file, with deletions, alternatives of several tokens, and an edit of a type that says nothing."""
    rows = sentences(spark, sf_dir).where(~F.contains("src", F.lit("|")))
    edit = lambda x, i: F.when(i % 11 == 5, _edit_line(i, i + 1, "U", F.lit("-NONE-"), 0)).when(i % 7 == 3, _edit_line(i, i + 1, "R", F.lit("X||Y z"), 0))
    made = F.filter(F.transform("tokens", edit), lambda e: e.isNotNull())
    found = readers.m2_pairs(_block_lines(rows, made, F.array(F.lit("A -1 -1|||noop|||-NONE-|||REQUIRED|||-NONE-|||1"))))
    return found.select(F.col("file").cast("bigint").alias("doc_id"), "line_no", "src", "tgt")


@query(rf"""WITH {SENTENCES_SQL}, o AS (SELECT doc_id, sent, {_SAID(_EVERY(14, 3))} AS p, unnest([{{'a': 0, 'c': {_SAID(_EVERY(14, 3))}, 'g': {_EVERY(7, 3)}}}, {{'a': 1, 'c': {_SAID(_EVERY(28, 3))}, 'g': {_EVERY(28, 3)}}}], recursive := true) FROM sentences WHERE NOT contains(src, '|')),
f AS (SELECT *, CASE WHEN 0.25 * g + p > 0 THEN 1.25 * c / (0.25 * g + p) ELSE 1.0 END AS f FROM o),
t AS (SELECT sum(c)::BIGINT AS c, sum(p)::BIGINT AS p, sum(g)::BIGINT AS g FROM (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY doc_id, sent ORDER BY f DESC, c DESC, p + 0.25 * g, a) = 1))
SELECT c AS correct, p AS proposed, g AS gold, round(c / p, 9) AS precision, round(c / g, 9) AS recall, round(1.25 * c / (0.25 * g + p), 9) AS f FROM t""")
def m2_score(spark, sf_dir):
    """Sentences with two annotators, read from M2 files, each scored by the annotator that suits it best."""
    rows = sentences(spark, sf_dir, dealt=True).where(~F.contains("src", F.lit("|")))

    def own(where, annotator: int):
        found = F.filter(F.transform("tokens", lambda x, i: F.when(where(i), _edit_line(i, i + 1, "R", _mark(x), annotator))), lambda e: e.isNotNull())
        return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit(f"A -1 -1|||noop|||-NONE-|||REQUIRED|||-NONE-|||{annotator}")))

    gold = readers.m2_annotations(_block_lines(rows, own(lambda i: i % 7 == 3, 0), own(lambda i: i % 28 == 3, 1)))
    said = readers.before_in_file(rows.select(F.col("doc_id").cast("string").alias("file"), F.col("sent").cast("bigint").alias("sent"), _said().alias("hypothesis")), "sent", {"sent_idx": F.lit(1)})
    both = gold.join(said, ["file", "sent_idx"]).withColumn("sent_idx", F.xxhash64("file", "sent_idx")).drop("file")
    both = stored(both, "m2-both")  # what is read is moved apart from what is scored
    out = m2.corpus_score(both, running=False)
    return out.select("correct", "proposed", "gold", *(F.round(c, 9).alias(c) for c in ("precision", "recall", "f")))


@query(rf"WITH {PAIRS_SQL} SELECT trim(src) AS src, trim(CASE WHEN len(tokens) > {CHANGED_UPTO} THEN src ELSE tgt END) AS tgt, count(*) AS n FROM good WHERE NOT contains(src, '|') GROUP BY ALL")
def m2_written(spark, sf_dir):
    """All derived pairs written as edits into one M2 file, long sentences without edits, read and applied again. The format can't hold a bar in a token."""
    rows = pairs(spark, sf_dir).where(~F.contains("src", F.lit("|"))).withColumn("tgt", F.when(F.size("tokens") > CHANGED_UPTO, F.col("src")).otherwise(F.col("tgt"))).groupBy("src", "tgt").agg(F.count("*").alias("n"))
    rows = stored(numbered(rows, ["src", "tgt"], "sent_idx"), "pairs")
    blocks = m2.m2_text(m2.edit_rows(edits.spread(rows.select("sent_idx", F.col("src").alias("source"), F.col("tgt").alias("target")))))
    lines = blocks.select("sent_idx", F.posexplode(F.split(F.replace("value", F.lit("|||UNK|||"), F.lit("|||R|||")), "\n")).alias("at", "value"))  # an unknown type would be skipped
    path = work_dir(spark, "m2")
    sinks.write_lines(numbered(stored(lines, "m2-lines"), ["sent_idx", "at"], "line_no"), path)
    back = readers.m2_pairs(readers.lines(spark, path, joined=True))
    return back.join(rows.select(F.col("sent_idx").alias("line_no"), "n"), "line_no").groupBy("src", "tgt").agg(F.sum("n").alias("n"))
