"""All registered queries of the library and their SQL.

Sentences: the texts of `documents`, cut after sentence signs and at line breaks. Derived pairs: a sentence and what it becomes when, counting tokens from 0, token i is
left out for i % 11 = 5, lower-cased for i % 7 = 3 and doubled for i % 13 = 6, the first rule that fits; both engines make them by the same rule.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import tags, text, tokens
from ..operators import cleanup, edits, hints, lowrank, m2, neighbours, prompts, retrieval, vectors
from ..operators.ordering import numbered, running_sums
from ..sources import readers

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- shared inputs ------------------------------------------------------------


def sentences(spark: SparkSession, sf_dir: str, dealt: bool = False) -> DataFrame:
    """(doc_id, sent, src, tokens). dealt: documents are dealt evenly first, which moves less than dealing what is made of their sentences."""
    cut = F.split(F.regexp_replace(F.col("text"), r"([.!?])\s+", "$1\n"), "\n+")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = (edits.spread(docs) if dealt else docs).select("doc_id", F.posexplode(cut).alias("sent", "raw"))
    return out.select("doc_id", "sent", text.clean_space(F.col("raw")).alias("src")).where("src <> ''").withColumn("tokens", F.split("src", " "))


def _changed(tokens: Column) -> Column:
    one = lambda x, i: F.when(i % 11 == 5, F.array().cast("array<string>")).when(i % 7 == 3, F.array(F.lower(x))).when(i % 13 == 6, F.array(x, x)).otherwise(F.array(x))
    return F.array_join(F.flatten(F.transform(tokens, one)), " ")


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, sent, src, tgt), tgt not empty."""
    return sentences(spark, sf_dir).withColumn("tgt", _changed(F.col("tokens"))).where("tgt <> ''")


SENTENCES_SQL = r"""cut AS (
  SELECT doc_id, string_split_regex(regexp_replace(text, '([.!?])\s+', '\1' || chr(10), 'g'), '\n+') AS parts FROM documents),
raw AS (SELECT doc_id, (unnest(range(len(parts))))::INTEGER AS sent, unnest(parts) AS part FROM cut),
clean AS (SELECT doc_id, sent, trim(regexp_replace(part, '\s+', ' ', 'g')) AS src FROM raw),
sentences AS (SELECT *, string_split(src, ' ') AS tokens FROM clean WHERE src <> '')"""
PAIRS_SQL = (
    SENTENCES_SQL
    + r""", pairs AS (
  SELECT doc_id, sent, src, tokens, array_to_string(flatten(list_transform(tokens, lambda x, i: CASE WHEN (i - 1) % 11 = 5 THEN [] WHEN (i - 1) % 7 = 3 THEN [lower(x)] WHEN (i - 1) % 13 = 6 THEN [x, x] ELSE [x] END)), ' ') AS tgt
  FROM sentences WHERE len(tokens) > 0),
good AS (SELECT * FROM pairs WHERE tgt <> '')"""
)

# --- text ---------------------------------------------------------------------


@query(r"SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS clean FROM documents")
def clean_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.clean_space(F.col("text")).alias("clean"))


@query(rf"WITH {SENTENCES_SQL} SELECT doc_id, sent, len(tokens)::INTEGER AS n_tokens FROM sentences WHERE len(tokens) BETWEEN 6 AND 200")
def min_token_filter(spark, sf_dir):
    n = F.size("tokens")
    return sentences(spark, sf_dir).where((n > 5) & (n <= 200)).select("doc_id", "sent", n.alias("n_tokens"))


@query(r"""WITH t AS (SELECT doc_id, string_split(trim(regexp_replace(text, '\s+', ' ', 'g')), ' ') AS w FROM documents WHERE trim(regexp_replace(text, '\s+', ' ', 'g')) <> '')
SELECT doc_id, doc_id || '_documents' AS id, len(w)::INTEGER AS n_tokens, w[1] AS first_token, w[-1] AS last_token FROM t""")
def tokenized_rows(spark, sf_dir):
    out = table(spark, sf_dir, "documents").select("doc_id", F.concat_ws("_", F.col("doc_id").cast("string"), F.lit("documents")).alias("id"), text.words(F.col("text")).alias("w"))
    return out.where(F.size("w") > 0).select("doc_id", "id", F.size("w").alias("n_tokens"), F.get("w", F.lit(0)).alias("first_token"), F.element_at("w", -1).alias("last_token"))


@query(r"""SELECT doc_id, trim(replace(replace(text, chr(10), ' '), chr(13), ' '), ' ') AS flat,
  replace(replace(replace(trim(replace(replace(text, chr(10), ' '), chr(13), ' '), ' '), '(', ' ( '), '  ', ' '), '( ', '(') AS bracketed FROM documents""")
def runtime_lines(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", text.runtime_line(F.col("text"), F.lit("conll14")).alias("flat"), text.runtime_line(F.col("text"), F.lit("ronacc_readerbench")).alias("bracketed"))


@query(r"""WITH a AS (SELECT doc_id, regexp_replace(text, ' ''\s?((?:m )|(?:ve )|(?:ll )|(?:s )|(?:d ))', '''\1', 'g') AS t FROM documents)
SELECT doc_id,
  regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, ' '' (.*?) '' ', ' ''\1'' ', 'g'), ' - ', '-', 'g'), ' / ', '/', 'g'), '([\]\[\(\){}<>])', ' \1 ', 'g'), '\s+', ' ', 'g') AS conll,
  regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '(\d)\s+%', '\1%', 'g'), '((?:have)|(?:has)) n''t', '\1n''t', 'g'), '^-', '- '), '\s+', ' ', 'g') AS bea FROM a""")
def regex_retokenize(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", text.conll_text(F.col("text")).alias("conll"), text.bea_text(F.col("text")).alias("bea"))


@query(rf"""WITH {SENTENCES_SQL}
SELECT doc_id, sent, array_to_string(list_filter(tokens, lambda x, i: i = 1 OR x <> tokens[i - 1]), ' ') AS single FROM sentences""")
def without_doubles(spark, sf_dir):
    return sentences(spark, sf_dir).select("doc_id", "sent", text.without_doubles(F.col("src")).alias("single"))


@query(r"""WITH f AS (SELECT page_id, html, strpos(html, '<title>') AS s, strpos(html, '</title>') AS e FROM pages),
g AS (SELECT *, CASE WHEN s > 0 THEN substr(html, s + 7) END AS rest FROM f),
h AS (SELECT *, CASE WHEN e > 0 AND (s = 0 OR e < s) THEN nullif(regexp_replace(left(html, e - 1), '^\s+|\s+$', '', 'g'), '') END AS before,
  CASE WHEN strpos(rest, '</title>') > 0 THEN nullif(regexp_replace(left(rest, strpos(rest, '</title>') - 1), '^\s+|\s+$', '', 'g'), '') END AS inside FROM g)
SELECT page_id, coalesce(before, inside) AS strict, coalesce(before, inside, url) AS answer, split_part(CASE WHEN s > 0 THEN rest ELSE h.html END, '</title>', 1) AS between_tags
FROM h JOIN pages USING (page_id)""")
def tag_extract(spark, sf_dir):
    found = text.tagged(F.col("html"), "<title>", "</title>")
    return table(spark, sf_dir, "pages").select("page_id", found.alias("strict"), F.coalesce(found, "url").alias("answer"), text.between_tags(F.col("html"), "<title>", "</title>").alias("between_tags"))


@query(r"""WITH p AS (SELECT conv_id, turn, text, role, string_split(text, '. ') AS parts FROM conversations)
SELECT conv_id, turn, CASE WHEN len(parts) >= 3 AND length(trim(parts[2], ' ')) / nullif(length(role), 0) BETWEEN 0.5 AND 2.0 THEN trim(parts[2], ' ') ELSE role END AS answer FROM p""")
def splitter_extract(spark, sf_dir):
    """The middle of three parts, where it is about as long as a short reference text (here the role)."""
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", text.split_answer(F.col("text"), F.col("role"), ". ").alias("answer"))


@query(rf"""WITH {SENTENCES_SQL}, u AS (SELECT doc_id, sent, unnest(tokens) AS token FROM sentences)
SELECT token, contains('!"#$%&''()*+,-./:;<=>?@[\]^_`{{|}}~', token) AS is_punctuation, count(*) AS n FROM u GROUP BY token""")
def punct_predicate(spark, sf_dir):
    rows = sentences(spark, sf_dir).select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    return rows.select("token", tags.is_punctuation(F.col("token")).alias("is_punctuation"), "n")


@query(rf"""WITH {SENTENCES_SQL}, u AS (SELECT doc_id, sent, tokens, unnest(range(len(tokens)))::INTEGER AS pos FROM sentences)
SELECT doc_id, sent, pos, md5(array_to_string(tokens[1:pos + 1], ' ')) AS prefix_md5 FROM u WHERE NOT contains('!"#$%&''()*+,-./:;<=>?@[\]^_`{{|}}~', tokens[pos + 1])""")
def prefix_truncation(spark, sf_dir):
    rows = sentences(spark, sf_dir).select("doc_id", "sent", "src", F.posexplode("tokens").alias("pos", "token")).where(~tags.is_punctuation(F.col("token")))
    return rows.select("doc_id", "sent", "pos", F.md5(text.prefix(F.col("src"), F.col("pos")).cast("binary")).alias("prefix_md5"))


# --- tags ---------------------------------------------------------------------

_NEXT_SQL = rf"""WITH {SENTENCES_SQL}, u AS (SELECT unnest(tokens) AS token, unnest(list_concat(tokens[2:], [NULL])) AS word FROM sentences),
d AS (SELECT token, word, count(*) AS n FROM u WHERE word IS NOT NULL GROUP BY token, word)"""


@query(
    _NEXT_SQL
    + r""", c AS (SELECT *, upper(left(token, 1)) || lower(substr(token, 2)) AS cap, left(token, 1) || upper(substr(token, 2, 1)) || lower(substr(token, 3)) AS cap1, upper(left(token, length(token) - 1)) || right(token, 1) AS up1 FROM d)
SELECT token, word, n, CASE WHEN token = word THEN '$KEEP'
  WHEN lower(token) = lower(word) AND word = lower(token) THEN '$TRANSFORM_CASE_LOWER' WHEN lower(token) = lower(word) AND word = cap THEN '$TRANSFORM_CASE_CAPITAL'
  WHEN lower(token) = lower(word) AND word = upper(token) THEN '$TRANSFORM_CASE_UPPER' WHEN lower(token) = lower(word) AND word = cap1 THEN '$TRANSFORM_CASE_CAPITAL_1'
  WHEN lower(token) = lower(word) AND word = up1 THEN '$TRANSFORM_CASE_UPPER_-1'
  WHEN token = word || 's' THEN '$TRANSFORM_AGREEMENT_SINGULAR' WHEN token || 's' = word THEN '$TRANSFORM_AGREEMENT_PLURAL' ELSE '$REPLACE_' || word END AS tag FROM c"""
)
def token_tags(spark, sf_dir):
    """The tag for each two tokens that stand side by side."""
    own = sentences(spark, sf_dir).select(F.explode(F.arrays_zip(F.col("tokens").alias("token"), F.slice("tokens", F.lit(2), F.size("tokens")).alias("word"))).alias("x"))
    rows = own.select("x.token", "x.word").where("word is not null").groupBy("token", "word").agg(F.count("*").alias("n"))
    return rows.withColumn("tag", tags.token_tag(F.col("token"), F.col("word")))


_APPLY_SQL = rf"""WITH {SENTENCES_SQL}, u AS (SELECT unnest(tokens) AS token FROM sentences), d AS (SELECT token, count(*) AS n FROM u GROUP BY token)
SELECT token, n, replace(upper(left(token, 1)), 'ẞ', 'SS') || lower(substr(token, 2)) AS capital, left(token, 1) || replace(upper(substr(token, 2, 1)), 'ẞ', 'SS') || lower(substr(token, 3)) AS capital_1,
  replace(upper(left(token, length(token) - 1)), 'ẞ', 'SS') || right(token, 1) AS upper_1, replace(token, '-', ' ') AS split, token || 's' AS plural, left(token, length(token) - 1) AS singular FROM d"""


@query(_APPLY_SQL)
def applied_tags(spark, sf_dir):
    rows = sentences(spark, sf_dir).select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    made = {"capital": tags.CASE + "CAPITAL", "capital_1": tags.CASE + "CAPITAL_1", "upper_1": tags.CASE + "UPPER_-1", "split": tags.SPLIT, "plural": tags.PLURAL, "singular": tags.SINGULAR}
    return rows.select("token", "n", *(tags.applied_column(F.col("token"), F.lit(t)).alias(c) for c, t in made.items()))


@query(rf"WITH {PAIRS_SQL} SELECT doc_id, sent, src, tgt FROM good WHERE NOT contains(src || tgt, 'SEPL')")
def edit_round_trip(spark, sf_dir):
    """Derived pairs whose tags give back the target: all of them."""
    out = edits.with_tags(pairs(spark, sf_dir))
    return out.select("doc_id", "sent", "src", "tgt")


@query()
def edit_tags(spark, sf_dir):
    """How often each kind of tag is used over all derived pairs."""
    tag = F.explode(F.flatten(F.transform("items", lambda x: x["tags"])))
    rows = edits.with_tags(pairs(spark, sf_dir)).select(tag.alias("tag"))
    return rows.groupBy(F.regexp_replace("tag", r"^\$(APPEND|REPLACE)_.*", r"\$$1").alias("kind")).agg(F.count("*").alias("n"))


@query()
def edit_sites(spark, sf_dir):
    """Error sites of all derived pairs, by side and bucket."""
    rows = pairs(spark, sf_dir).withColumn("pred_tgt", F.col("tgt"))
    return edits.site_rows(rows, "doc_id", "sent").groupBy("side", "bucket").agg(F.count("*").alias("n"), F.count_distinct("diff").alias("diffs"))


# --- joins --------------------------------------------------------------------


@query("""WITH n AS (SELECT *, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS next_role, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS next_text FROM conversations)
SELECT conv_id, turn, text AS src, next_text AS tgt FROM n WHERE role = 'user' AND next_role = 'assistant'""")
def alternating_pairs(spark, sf_dir):
    """A user's turn with the assistant's answer after it."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    rows = table(spark, sf_dir, "conversations").withColumn("next_role", F.lead("role").over(w)).withColumn("tgt", F.lead("text").over(w))
    return rows.where("role = 'user' and next_role = 'assistant'").select("conv_id", "turn", F.col("text").alias("src"), "tgt")


@query("""WITH ordered AS (SELECT row_number() OVER (ORDER BY conv_id, turn) - 1 AS line_no, text FROM conversations)
SELECT line_no // 2 AS line_no, trim(regexp_replace(max(CASE WHEN line_no % 2 = 1 THEN text END), '\\s+', ' ', 'g')) AS src, trim(regexp_replace(max(CASE WHEN line_no % 2 = 0 THEN text END), '\\s+', ' ', 'g')) AS tgt
FROM ordered GROUP BY line_no // 2 HAVING count(*) = 2""".replace("\\\\s", "\\s"))
def alternating_lines(spark, sf_dir):
    """All turns, read as lines of which every first is a target and every second its source."""
    rows = numbered(table(spark, sf_dir, "conversations"), ["conv_id", "turn"], "line_no").select("line_no", F.col("text").alias("value"))
    whole = rows.withColumn("mates", F.count("*").over(Window.partitionBy(F.floor(F.col("line_no") / 2)))).where("mates = 2").drop("mates")
    return readers.alternating(whole)


@query("""SELECT d.doc_id, coalesce(quality, -1) AS quality, coalesce(toxic, -1) AS toxic, n_chars, d.doc_id IS NOT NULL AND l.doc_id IS NULL AS unlabelled FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""")
def positional_join(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    out = docs.select("doc_id", "n_chars").join(labels.withColumn("there", F.lit(True)), "doc_id", "left")
    return out.select("doc_id", F.coalesce("quality", F.lit(-1)).alias("quality"), F.coalesce("toxic", F.lit(-1)).alias("toxic"), "n_chars", F.col("there").isNull().alias("unlabelled"))


@query("SELECT i AS doc_id FROM range(0, (SELECT max(doc_id) + 10 FROM documents)) t(i) ANTI JOIN labels l ON l.doc_id = i")
def missing_index(spark, sf_dir):
    """Numbers up to nine beyond the last document that no label has."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    n = docs.agg(F.max("doc_id")).first()[0] + 10
    return retrieval.missing(labels, "doc_id", n)


_CAPITAL_SQL = rf"""WITH {SENTENCES_SQL}, u AS (SELECT doc_id, sent, unnest(range(len(tokens))) AS pos, unnest(tokens) AS token FROM sentences),
r AS (SELECT doc_id, sent, pos, token <> lower(token) AS capital, row_number() OVER (PARTITION BY doc_id, sent, token <> lower(token) ORDER BY pos) - 1 AS rank, count(*) FILTER (WHERE token <> lower(token)) OVER (PARTITION BY doc_id, sent) AS n FROM u),
q AS (SELECT doc_id, sent, pos, (rank - 1) % n AS turn FROM r WHERE NOT capital AND rank >= 1 AND n > 0),
p AS (SELECT doc_id, sent, pos, rank AS turn FROM r WHERE capital)
SELECT doc_id, sent, count(*) AS pairs, md5(string_agg(p.pos || '-' || q.pos, ',' ORDER BY q.pos)) AS pairs_md5 FROM q JOIN p USING (doc_id, sent, turn) GROUP BY doc_id, sent"""


def _listed_pairs(pairs: Column) -> list[Column]:
    """How many pairs (pos, neg) a sentence has, and the digest of their list in the order of the negatives."""
    listed = F.array_join(F.transform(F.array_sort(F.transform(pairs, lambda x: F.struct(x["neg"].alias("neg"), x["pos"].alias("pos")))), lambda x: F.concat_ws("-", x["pos"].cast("string"), x["neg"].cast("string"))), ",")
    return [F.size(pairs).cast("bigint").alias("pairs"), F.md5(listed.cast("binary")).alias("pairs_md5")]


@query(_CAPITAL_SQL)
def cyclic_pairing(spark, sf_dir):
    """Within each sentence, capitalised tokens as positives and the others as negatives; all pairs of a sentence in one row."""
    capital = lambda t: t != F.lower(t)
    marked = F.transform("tokens", lambda t, i: F.struct(i.alias("i"), capital(t).alias("capital")))
    places = lambda marked, yes: F.transform(F.filter(marked, lambda m: m["capital"] == F.lit(yes)), lambda m: m["i"])
    found = F.transform(F.array(marked), lambda m: edits.cyclic(places(m, True), places(m, False)))
    listed = F.transform(F.filter(found, lambda x: F.size(x) > 0), lambda x: F.struct(*_listed_pairs(x)))  # no lists, or that of the sentence
    return sentences(spark, sf_dir).select("doc_id", "sent", F.inline(listed))


@query(_CAPITAL_SQL)
def cyclic_pairing_rows(spark, sf_dir):
    """The same from two tables of sites."""
    rows = sentences(spark, sf_dir).select(F.struct("doc_id", "sent").alias("line"), F.posexplode("tokens").alias("pos", "token")).withColumn("capital", F.col("token") != F.lower("token"))
    side = lambda yes: rows.where(F.col("capital") == yes).select("line", "pos", F.col("pos").alias("rank"))
    rows = edits.cyclic_pairs(side(True), side(False), "line").groupBy("line").agg(F.collect_list(F.struct(F.col("pos_pos").alias("pos"), F.col("neg_pos").alias("neg"))).alias("x"))
    return rows.select("line.doc_id", "line.sent", *_listed_pairs(F.col("x")))


@query("""WITH m AS (SELECT conv_id, turn, role, CASE WHEN role IS DISTINCT FROM lag(role) OVER (PARTITION BY conv_id ORDER BY turn) OR row_number() OVER (PARTITION BY conv_id ORDER BY turn) = 1 THEN 1 ELSE 0 END AS f FROM conversations)
SELECT conv_id, turn, role, sum(f) OVER (PARTITION BY conv_id ORDER BY turn)::BIGINT AS island FROM m""")
def prompt_islands(spark, sf_dir):
    return prompts.islands(table(spark, sf_dir, "conversations"), "role", "turn", "conv_id").select("conv_id", "turn", "role", "island")


@query("""SELECT text, max_by(doc_id, doc_id) AS last_doc, count(*) AS n FROM documents GROUP BY text""")
def text_lookup(spark, sf_dir):
    """An index keyed by text: of equal texts the last one stays."""
    docs = table(spark, sf_dir, "documents").select("text", F.col("doc_id").alias("seq"), F.col("doc_id").alias("vec"))
    n = docs.groupBy("text").agg(F.count("*").alias("n"))
    return retrieval.last_vector(docs).join(n, "text").select("text", F.col("vec").alias("last_doc"), "n")


@query("""WITH r AS (SELECT unnest(string_split('en:src0,src1;de:src2, src3', ';')) AS part), p AS (SELECT trim(split_part(part, ':', 1)) AS test, trim(unnest(string_split(split_part(part, ':', 2), ','))) AS train FROM r)
SELECT test, train, doc_id FROM p JOIN documents ON source = train""")
def relation_join(spark, sf_dir):
    """Datasets and the sources that serve them, joined with their rows."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("from"))
    relation = retrieval.dataset_relation("en:src0,src1;de:src2, src3", docs)
    return docs.join(F.broadcast(relation), docs["from"] == relation["train"]).select("test", "train", "doc_id")


@query("SELECT doc_id, source FROM documents UNION ALL SELECT doc_id, 'labels' AS source FROM labels")
def union_sources(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", F.lit("").alias("text"))
    return retrieval.pool(docs, table(spark, sf_dir, "labels").select("doc_id", F.lit("labels").alias("source"), F.lit("").alias("text"))).select("doc_id", "source")


@query("SELECT doc_id, text FROM documents")
def shard_merge(spark, sf_dir):
    """Four shards by number, put together again and audited."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("__original_index"), F.col("doc_id"), "text")
    shards = [docs.where(retrieval.modulo_shard(F.col("__original_index"), 4) == s) for s in range(4)]
    return retrieval.merged_shards(*shards).drop("__original_index")


@query("""WITH o AS (SELECT row_number() OVER (ORDER BY conv_id, turn) - 1 AS line_no, conv_id::VARCHAR AS id, text FROM conversations),
bad AS (SELECT coalesce(min(line_no), 9223372036854775807) AS first_bad FROM o WHERE contains(text, 'token') OR line_no = (SELECT count(*) // 2 FROM o))
SELECT line_no, id FROM o WHERE line_no < (SELECT first_bad FROM bad)""")
def valid_prefix(spark, sf_dir):
    """Stored rows up to the first that isn't what was asked; here the middle row, and rows with a certain word, are spoilt."""
    turns = table(spark, sf_dir, "conversations")
    want = numbered(turns, ["conv_id", "turn"], "line_no").select("line_no", F.col("conv_id").cast("string").alias("id"), "text")
    found = want.withColumn("id", F.when(F.col("line_no") == turns.count() // 2, "?").otherwise(F.col("id"))).withColumn("ok", ~F.contains("text", F.lit("token")))
    return readers.valid_prefix(want, found).select("line_no", "id")


# --- vectors ------------------------------------------------------------------


@query("""WITH u AS (SELECT label, unnest(range(len(embedding)))::INTEGER AS i, unnest(embedding)::DOUBLE AS x FROM embeddings)
SELECT label, i, round(avg(x), 6) AS mean FROM u GROUP BY label, i""")
def mean_pool_by_group(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").withColumnRenamed("embedding", "vec")
    pooled = vectors.mean_vectors(rows, ["label"])
    return pooled.select("label", F.posexplode("vec").alias("i", "x")).select("label", "i", F.round("x", 6).alias("mean"))


_TOP_SQL = """WITH s AS (SELECT q.vec_id AS query, t.vec_id AS id, round(list_cosine_similarity(q.embedding::DOUBLE[], t.embedding::DOUBLE[]), 9) AS similarity FROM embeddings q JOIN embeddings t ON q.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY similarity DESC, id)::INTEGER AS rank FROM s), top AS (SELECT * FROM r WHERE rank <= 4)"""


@query(_TOP_SQL + " SELECT query, rank, id, round(similarity, 6) AS similarity FROM top")
def cosine_topk(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    return vectors.cosine_top(rows.where("id % 100 = 0"), rows, 4).select("query", "rank", "id", F.round("similarity", 6).alias("similarity"))


@query(_TOP_SQL + " SELECT query, id, round(CASE WHEN min(similarity) OVER w = max(similarity) OVER w THEN 1.0 ELSE (similarity - min(similarity) OVER w) / nullif(max(similarity) OVER w - min(similarity) OVER w, 0) END, 5) AS scaled FROM top WINDOW w AS (PARTITION BY query)")
def minmax_similarity(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    top = vectors.cosine_top(rows.where("id % 100 = 0"), rows, 4)
    return top.select("query", "id", F.round(retrieval.min_max(F.col("similarity"), "query"), 5).alias("scaled"))


@query(_TOP_SQL.replace(" AND q.vec_id % 100 = 0", "").replace(" ON q.vec_id % 100 = 0", " ON true").replace("rank <= 4", "rank <= 3") + " SELECT query, rank, id, round(similarity, 6) AS similarity FROM top")
def cosine_all(spark, sf_dir):
    """The three nearest vectors of every vector, itself among them."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), vectors.unit(F.col("embedding")).alias("v"))
    return neighbours.pruned_cosine_top(rows, rows, 3).select("query", "rank", "id", F.round("similarity", 6).alias("similarity"))


_DIRECTION_SQL = """WITH u AS (SELECT label, unnest(range(len(embedding)))::INTEGER AS i, unnest(embedding)::DOUBLE AS x FROM embeddings WHERE label IN (0, 1)),
d AS (SELECT i, avg(x) FILTER (WHERE label = 1) - avg(x) FILTER (WHERE label = 0) AS v FROM u GROUP BY i)"""


@query(_DIRECTION_SQL + " SELECT i, round(v, 6) AS v FROM d")
def class_mean_direction(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").withColumnRenamed("embedding", "vec")
    return vectors.class_mean_direction(rows).select(F.posexplode("direction").alias("i", "v")).select("i", F.round("v", 6).alias("v"))


@query(_DIRECTION_SQL + ", n AS (SELECT sqrt(sum(v * v)) AS n FROM d), e AS (SELECT vec_id, unnest(range(len(embedding)))::INTEGER AS i, unnest(embedding)::DOUBLE AS x FROM embeddings) SELECT vec_id, round(sum(x * v) / any_value(n), 5) AS score FROM e JOIN d USING (i), n GROUP BY vec_id")
def project_direction(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").withColumnRenamed("embedding", "vec")
    direction = vectors.class_mean_direction(rows)
    return rows.crossJoin(F.broadcast(direction)).select("vec_id", F.round(vectors.projected(F.col("vec"), F.col("direction")), 5).alias("score"))  # one row


@query("""WITH e AS (SELECT vec_id, unnest(range(len(embedding)))::INTEGER AS i, unnest(embedding)::DOUBLE AS x FROM embeddings), m AS (SELECT i, avg(x) AS mean, stddev_pop(x) AS dev FROM e GROUP BY i)
SELECT vec_id, i, round((x - mean) / CASE WHEN dev > 0 THEN dev ELSE 1 END, 4) + 0.0 AS z FROM e JOIN m USING (i)""")
def standard_scale(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").withColumnRenamed("embedding", "vec")
    m = vectors.moments(rows)
    return rows.select("vec_id", F.posexplode(vectors.scaled(F.col("vec"), m)).alias("i", "z")).select("vec_id", "i", (F.round("z", 4) + 0.0).alias("z"))


_COVARIANCE_SQL = """u AS (SELECT vec_id, unnest(range(len(embedding)))::INTEGER AS i, unnest(embedding)::DOUBLE AS x FROM embeddings), mean AS (SELECT i, avg(x) AS m FROM u GROUP BY i),
z AS MATERIALIZED (SELECT vec_id, i, x - m AS x FROM u JOIN mean USING (i)), own AS (SELECT vec_id, list(x ORDER BY i) AS v FROM z GROUP BY vec_id),
entry AS (SELECT a.i, b.i AS j, sum(a.x * b.x) / (SELECT count(*) FROM embeddings) AS x FROM z a JOIN z b USING (vec_id) GROUP BY a.i, b.i),
line AS (SELECT i, list(x ORDER BY j) AS r FROM entry GROUP BY i), c0 AS MATERIALIZED (SELECT list(r ORDER BY i) AS m FROM line)"""


def _component_sql(n: int) -> str:
    """Tables p{n} (v), the nth component by squaring the matrix c{n - 1} again and again, and c{n}, the matrix without it."""
    square = "list_transform(m, lambda r: list_transform(m, lambda s: list_dot_product(r, s)))"
    largest = "list_max(list_transform(m, lambda r: list_max(list_transform(r, lambda x: abs(x)))))"
    scaled = lambda rows: f"SELECT step, list_transform(m, lambda r: list_transform(r, lambda x: x / n)) AS m FROM (SELECT step, m, {largest} AS n FROM ({rows}))"
    return f"""s{n}(step, m) AS ({scaled(f'SELECT 0 AS step, m FROM c{n - 1}')} UNION ALL {scaled(f'SELECT step + 1 AS step, {square} AS m FROM s{n} WHERE step < 40')}),
g{n} AS (SELECT unnest(m) AS r FROM s{n} WHERE step = 40), h{n} AS MATERIALIZED (SELECT r FROM g{n} ORDER BY list_dot_product(r, r) DESC LIMIT 1),
t{n} AS (SELECT list_transform(r, lambda x: x / sqrt(list_dot_product(r, r))) AS v FROM h{n}),
p{n} AS MATERIALIZED (SELECT list_transform(v, lambda x: x * CASE WHEN list_max(v) >= -list_min(v) THEN 1.0 ELSE -1.0 END) AS v FROM t{n}),
l{n} AS MATERIALIZED (SELECT v, list_dot_product(v, list_transform(m, lambda r: list_dot_product(r, v))) AS l FROM p{n}, c{n - 1}),
c{n} AS MATERIALIZED (SELECT list_transform(m, lambda r, i: list_transform(r, lambda x, j: x - l * v[i] * v[j])) AS m FROM c{n - 1}, l{n})"""


_COMPONENTS_SQL = f"WITH RECURSIVE {_COVARIANCE_SQL}, {', '.join(map(_component_sql, (1, 2, 3)))}, y AS (SELECT vec_id, " + ", ".join(f"list_dot_product(own.v, p{n}.v) AS pc{n}" for n in (1, 2, 3)) + " FROM own, p1, p2, p3)"


@query(_COMPONENTS_SQL + " SELECT vec_id, row_number() OVER (ORDER BY round(abs(pc1), 9) DESC, vec_id) AS rank, round(pc1, 5) + 0.0 AS pc1, round(pc2, 5) + 0.0 AS pc2, round(pc3, 5) + 0.0 AS pc3 FROM y")
def pca_project(spark, sf_dir):
    """The rank of each vector by its first principal component, and its first three coordinates."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("vec"))
    out = vectors.in_components(rows, vectors.principal(rows, 3), "vec", "projected")
    return _ranked_by_component(out)


@query(_COMPONENTS_SQL + " SELECT vec_id, row_number() OVER (ORDER BY round(abs(pc1), 9) DESC, vec_id) AS rank, round(pc1, 5) + 0.0 AS pc1, round(pc2, 5) + 0.0 AS pc2, round(pc3, 5) + 0.0 AS pc3 FROM y")
def low_rank_project(spark, sf_dir):
    """The same by block passes over the rows."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("vec"))
    return _ranked_by_component(vectors.in_components(rows, lowrank.leading(rows, 3), "vec", "projected"))


def _ranked_by_component(out: DataFrame) -> DataFrame:
    first = F.round(F.abs(F.get("projected", F.lit(0))), 9)
    ranked = numbered(out, [first.desc(), "vec_id"], "rank")
    return ranked.select("vec_id", (F.col("rank") + 1).alias("rank"), *((F.round(F.get("projected", F.lit(i)), 5) + 0.0).alias(f"pc{i + 1}") for i in range(3)))


# --- choosing and scoring -----------------------------------------------------


@query("""WITH r AS (SELECT conv_id AS idx, count(*) AS available FROM conversations GROUP BY conv_id),
b AS (SELECT *, least(2, available) AS low, least(10, available) - least(2, available) AS capacity FROM r),
t AS (SELECT sum(low) AS low_total, sum(capacity) AS room, count(*) AS n FROM b),
g AS (SELECT *, greatest(low_total, least(round_even(4.5 * n, 0), low_total + room)) - low_total AS remaining FROM t),
a AS (SELECT b.*, remaining, CASE WHEN room > 0 THEN remaining * capacity / room ELSE 0 END AS raw FROM b, g),
f AS (SELECT *, least(capacity, floor(raw)) AS add, raw - least(capacity, floor(raw)) AS fraction FROM a),
k AS (SELECT *, remaining - sum(add) OVER () AS leftover, row_number() OVER (ORDER BY CASE WHEN capacity > add AND fraction > 0 THEN 0 ELSE 1 END, fraction DESC, capacity DESC, available DESC, idx) AS r FROM f)
SELECT idx, available, (low + add + CASE WHEN capacity > add AND fraction > 0 AND r <= leftover THEN 1 ELSE 0 END)::BIGINT AS "limit" FROM k""")
def dynamic_limits(spark, sf_dir):
    """How many demonstrations each conversation gets, its turns being what is available; 4.5 on average."""
    rows = table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("idx")).agg(F.count("*").alias("available"))
    return retrieval.limits(rows, 2, 10, 4.5)


@query(r"""SELECT doc_id, sent, row_number() OVER o - 1 AS place, sum(length(src)) OVER (o ROWS UNBOUNDED PRECEDING)::BIGINT AS letters FROM (WITH """ + SENTENCES_SQL + """ SELECT *, md5(src) AS digest FROM sentences) WINDOW o AS (ORDER BY digest, doc_id DESC, sent)""")
def ordered_sentences(spark, sf_dir):
    """All sentences in the order of their digests, numbered, with the letters up to each."""
    rows = sentences(spark, sf_dir).select("doc_id", "sent", F.md5(F.col("src").cast("binary")).alias("digest"), F.length("src").alias("n"))
    out = running_sums(rows, {"place": F.lit(1), "letters": F.col("n")}, ["digest", F.desc("doc_id"), "sent"])
    return out.select("doc_id", "sent", (F.col("place") - 1).alias("place"), "letters")


@query("""WITH pool AS (SELECT doc_id AS id, row_number() OVER (ORDER BY doc_id) - 1 AS place FROM documents), n AS (SELECT count(*) AS n FROM documents),
h AS (SELECT doc_id, n, ('0x' || substr(md5(doc_id || '|1|0'), 1, 13))::BIGINT % (n - 1) AS a, ('0x' || substr(md5(doc_id || '|2|0'), 1, 13))::BIGINT % n AS b FROM documents, n),
d AS (SELECT doc_id, 1 AS draw, a AS place FROM h UNION ALL SELECT doc_id, 2, CASE WHEN a = b THEN n - 1 ELSE b END FROM h)
SELECT doc_id, draw::INTEGER AS draw, id FROM d JOIN pool USING (place)""")
def sample_without_replacement(spark, sf_dir):
    """Two different documents for each document."""
    docs = table(spark, sf_dir, "documents").select("doc_id")
    return retrieval.sampled(docs, docs.select(F.col("doc_id").alias("id")), 2, "doc_id").select("doc_id", "draw", "id")


@query(r"""WITH RECURSIVE w AS (SELECT doc_id AS idx, greatest(1, len(string_split(trim(regexp_replace(text, '\s+', ' ', 'g')), ' ')) // 2) AS weight FROM documents),
s AS (SELECT idx, sum(weight) OVER (ORDER BY idx) AS upto FROM w), t AS (SELECT count(*) AS n, ceil(sum(weight) / 8) AS share FROM w),
chain AS (SELECT a.idx, a.upto, min(b.idx) AS after FROM s a, t, s b WHERE b.idx > a.idx AND b.upto - a.upto >= share GROUP BY a.idx, a.upto),
r AS (
  SELECT 0 AS shard, 0::BIGINT AS start, (SELECT min(idx) FROM s, t WHERE upto >= share) AS last
  UNION ALL SELECT shard + 1, last + 1, after FROM r LEFT JOIN chain ON idx = last WHERE shard < 7 AND last IS NOT NULL)
SELECT shard::INTEGER AS shard, start, CASE WHEN shard = 7 OR last IS NULL THEN (SELECT n FROM t) ELSE last + 1 END AS "end" FROM r""")
def balanced_ranges(spark, sf_dir):
    """Eight ranges of documents of about as many words each."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("idx"), F.greatest(F.lit(1), F.floor(F.size(text.words(F.col("text"))) / 2)).alias("weight"))
    return retrieval.balanced_ranges(docs, 8)


@query(rf"""WITH {PAIRS_SQL}, p AS (SELECT doc_id, sent, src, CASE WHEN sent % 3 = 0 THEN repeat(tgt || ' ', 3) || tgt || repeat(' x', 60) ELSE tgt END AS pred FROM good),
n AS (SELECT *, len(string_split_regex(trim(src), '\s+')) AS s, len(string_split_regex(trim(pred), '\s+')) AS p FROM p)
SELECT doc_id, sent, md5(CASE WHEN p > greatest(floor(s * 1.75), s + 50) THEN src ELSE pred END) AS guarded FROM n""")
def length_guard(spark, sf_dir):
    """Every third answer is made several times too long."""
    long = F.concat(F.repeat(F.concat("tgt", F.lit(" ")), F.lit(3)), F.col("tgt"), F.lit(" x" * 60))
    rows = pairs(spark, sf_dir).withColumn("pred", F.when(F.col("sent") % 3 == 0, long).otherwise(F.col("tgt")))
    return rows.select("doc_id", "sent", F.md5(cleanup.length_guard(F.col("pred"), F.col("src")).cast("binary")).alias("guarded"))


def _responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Derived pairs as model answers of several kinds."""
    body = F.when(F.col("sent") % 5 == 4, F.concat(F.lit("No corrections needed. "), "tgt")).when(F.col("sent") % 5 == 3, F.concat(F.lit("<corrected sentence>"), "tgt", F.lit(" (question)"), F.lit("</corrected sentence>")))
    body = body.when(F.col("sent") % 5 == 2, F.concat(F.lit("<erroneous sentence>"), "src", F.lit("</erroneous sentence><corrected sentence>"), "tgt", F.lit("</corrected sentence>"))).otherwise(F.concat(F.lit("<corrected sentence>"), "tgt", F.lit("</corrected sentence> done")))
    return pairs(spark, sf_dir).select("doc_id", "sent", F.col("src").alias("text"), body.alias("response"))


_REASONS_SQL = rf"""WITH {PAIRS_SQL}, r AS (SELECT doc_id, sent, src, tgt, CASE WHEN sent % 5 IN (2, 4) OR regexp_matches(tgt, '(?i)\b(?:no\s+corrections?\s+needed|no\s+correction|not\s+grammatically\s+incorrect|not\s+incorrect|no\s+errors?\s+found)\b|ei\s+vaja') THEN 'tagbad_or_no_correction'
  WHEN sent % 5 = 3 THEN 'comment_or_no_correction_in_prediction' ELSE 'kept' END AS reason FROM good)"""


@query(_REASONS_SQL + " SELECT doc_id, sent, reason, md5(CASE WHEN reason = 'kept' THEN tgt ELSE src END) AS prediction FROM r")
def cleanup_rules(spark, sf_dir):
    out = cleanup.cleaned(_responses(spark, sf_dir), 0.0, with_ratio=False)
    return out.select("doc_id", "sent", F.col("postprocess_reason").alias("reason"), F.md5(F.col("prediction").cast("binary")).alias("prediction"))


@query(_REASONS_SQL + " SELECT reason, count(*) AS n FROM r GROUP BY ROLLUP (reason)")
def cleanup_reasons(spark, sf_dir):
    return cleanup.reason_counts(cleanup.cleaned(_responses(spark, sf_dir), 0.0, with_ratio=False))


@query()
def cleanup_likeness(spark, sf_dir):
    """The rules with the least likeness of letters, counted."""
    return cleanup.reason_counts(cleanup.cleaned(_responses(spark, sf_dir), cleanup.threshold("estgec")))


@query(rf"WITH {PAIRS_SQL} SELECT doc_id, count(*) AS n, round(avg((trim(src) <> trim(tgt))::INTEGER), 9) AS purity FROM good GROUP BY doc_id")
def edited_purity(spark, sf_dir):
    rows = pairs(spark, sf_dir).withColumn("id", F.col("sent"))
    return rows.groupBy("doc_id").agg(F.count("*").alias("n"), F.round(hints.purity("doc_id", "src", "tgt"), 9).alias("purity"))


@query("""WITH c AS (SELECT count(*) FILTER (WHERE quality = 1 AND toxic = 1) AS correct, count(*) FILTER (WHERE toxic = 1) AS proposed, count(*) FILTER (WHERE quality = 1) AS gold FROM labels),
p AS (SELECT *, coalesce(correct / nullif(proposed, 0), 1.0) AS p, coalesce(correct / nullif(gold, 0), 1.0) AS r FROM c)
SELECT correct, proposed, gold, round(p, 9) AS precision, round(r, 9) AS recall, round(coalesce(1.25 * p * r / nullif(0.25 * p + r, 0), 0.0), 9) AS f FROM p""")
def scores_prf(spark, sf_dir):
    yes = lambda cond: F.count(F.when(cond, 1))
    labels = table(spark, sf_dir, "labels")
    out = labels.agg(yes((F.col("quality") == 1) & (F.col("toxic") == 1)).alias("correct"), yes(F.col("toxic") == 1).alias("proposed"), yes(F.col("quality") == 1).alias("gold"))
    p, r = m2.precision(F.col("correct"), F.col("proposed")), m2.recall(F.col("correct"), F.col("gold"))
    return out.select("*", F.round(p, 9).alias("precision"), F.round(r, 9).alias("recall"), F.round(m2.f_from_pr(p, r), 9).alias("f"))


@query()
def vote_types(spark, sf_dir):
    """Hint types of all derived pairs, and how often each is voted for."""
    rows = pairs(spark, sf_dir).select(F.col("doc_id").alias("line_no"), F.col("sent").alias("id"), F.col("src").alias("text"), F.col("tgt").alias("label"), F.lit("").alias("key"), F.lit(1.0).alias("similarity"), F.lit("documents").alias("from"))
    return hints.ranked_types(hints.votes(edits.spread(rows)), most=3).groupBy("hint_type", "rank").agg(F.count("*").alias("documents"), F.sum("votes").alias("votes"))


_TYPES = ("R:VERB:SVA", "M:DET", "U:PUNCT", "R:NOUN:NUM", "R:SPELL", "R:WO", "R:OTHER", "R:VERB", "R:ADV")


@query("""WITH t AS (SELECT doc_id, ['R:VERB:SVA', 'M:DET', 'U:PUNCT', 'R:NOUN:NUM', 'R:SPELL', 'R:WO', 'R:OTHER', 'R:VERB', 'R:ADV'][doc_id % 9 + 1] AS error_type FROM documents),
h AS (SELECT unnest(['R:VERB:SVA', 'M:DET', 'U:PUNCT', 'R:NOUN:NUM', 'R:SPELL', 'R:WO', 'R:OTHER', 'R:VERB', 'R:ADV']) AS error_type, unnest(['subject-verb agreement', 'determiner or article', 'punctuation', 'noun number', 'spelling', 'word order', 'word choice', 'verb usage', 'adverb']) AS hint)
SELECT doc_id, error_type, hint FROM t JOIN h USING (error_type)""")
def error_type_hints(spark, sf_dir):
    kinds = F.array(*map(F.lit, _TYPES))
    rows = table(spark, sf_dir, "documents").select("doc_id", F.get(kinds, (F.col("doc_id") % len(_TYPES)).cast("int")).alias("error_type"))
    return rows.withColumn("hint", hints.error_type_hint(F.col("error_type")))


@query(r"""WITH RECURSIVE cut AS (SELECT doc_id, string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)) AS parts FROM documents WHERE text IS NOT NULL),
each AS (SELECT doc_id, unnest(range(len(parts))) AS i, unnest(parts) AS sentence FROM cut),
counted AS (SELECT doc_id, i, sentence, CASE WHEN trim(regexp_replace(sentence, '\s+', ' ', 'g')) = '' THEN 0 ELSE len(string_split(trim(regexp_replace(sentence, '\s+', ' ', 'g')), ' ')) END AS n FROM each),
run AS (
  SELECT doc_id, i, 0 AS part, n FROM counted WHERE i = 0
  UNION ALL
  SELECT c.doc_id, c.i, CASE WHEN r.n + c.n <= 100 THEN r.part ELSE r.part + 1 END, CASE WHEN r.n + c.n <= 100 THEN r.n + c.n ELSE c.n END FROM run r JOIN counted c ON c.doc_id = r.doc_id AND c.i = r.i + 1)
SELECT doc_id, part::INTEGER AS part, string_agg(sentence, ' ' ORDER BY i) AS value FROM run JOIN counted USING (doc_id, i) GROUP BY doc_id, part""")
def packed_sentences(spark, sf_dir):
    """Texts cut into sentences that are put together again within 100 words."""
    parts = text.pack_sentences(F.col("text"), 100)
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(parts).alias("part", "value"))


def _treebank_sql(ptb: bool) -> str:
    quoted = lambda s: s.replace("'", "''")
    line = r"' ' || regexp_replace(text, '^\s+|\s+$', '', 'g') || ' '"
    for pattern, new in text.treebank_rules("en", ptb):
        line = f"regexp_replace({line}, '{quoted(pattern)}', '{quoted(new).replace('$', chr(92))}', 'g')"
    short = ", ".join(f"'{x}'" for x in text.ABBREVIATIONS["en"])
    return rf"""(SELECT doc_id, array_to_string(list_transform(own, lambda w, i: CASE WHEN w LIKE '%.' AND NOT regexp_full_match(w, '\.+') AND NOT (contains(left(w, length(w) - 1), '.') AND regexp_matches(w, '[a-zA-Z]'))
  AND left(w, length(w) - 1) NOT IN ({short}) AND NOT coalesce(regexp_matches(own[i + 1], '^\d'), false) THEN left(w, length(w) - 1) || ' .' ELSE w END), ' ') AS line
  FROM (SELECT doc_id, string_split(trim(regexp_replace({line}, '\s+', ' ', 'g')), ' ') AS own FROM documents))"""


_FINAL_SQL = r"trim(regexp_replace(replace(regexp_replace({0}.line, '''\s+''', '''''', 'g'), '-CONTRACT-', ''''), '\s+', ' ', 'g'))"


@query(f"SELECT doc_id, {_FINAL_SQL.format('a')} AS plain, {_FINAL_SQL.format('b')} AS ptb FROM {_treebank_sql(False)} a JOIN {_treebank_sql(True)} b USING (doc_id)")
def treebank_tokens(spark, sf_dir):
    """The scorer's tokens, without and with the treebank's brackets, quotes and contractions."""
    return table(spark, sf_dir, "documents").select("doc_id", text.treebank(F.col("text")).alias("plain"), text.treebank(F.col("text"), ptb=True).alias("ptb"))


#: The rules of functions/tokens.py written out for an engine without looking around: a cut that needs a letter on both sides is made twice, since matches share letters.
_PEELED_SQL = r"""SELECT doc_id, string_agg(regexp_replace(lead, '(\.{2,}|(?s:.))', '\1 ', 'g') || mid || ' ' || regexp_replace(rest, '(\.{2,}|(?s:.))', '\1 ', 'g'), ' ' ORDER BY i) AS line FROM (
  SELECT doc_id, i, lead, CASE WHEN point THEN bare || '.' WHEN regexp_full_match(bare, '(https?://|www\.)(?s:.)*|[\p{L}\p{N}._+-]+@[\p{L}\p{N}-]+(\.[\p{L}\p{N}-]+)+') THEN bare ELSE CUT END AS mid, CASE WHEN point THEN substr(tail, 2) ELSE tail END AS rest
  FROM (SELECT *, (lower(bare) IN (SHORT) OR regexp_full_match(bare, '(\p{L}\.)*\p{L}')) AND tail LIKE '.%' AND tail NOT LIKE '..%' AS point
    FROM (SELECT doc_id, i, left(w, length(w) - length(body)) AS lead, bare, substr(body, length(bare) + 1) AS tail
      FROM (SELECT *, rtrim(body, ')]}>"''`“”„«»‘’%—–,;:!?([{<*&#$£€….') AS bare
        FROM (SELECT doc_id, i, w, ltrim(w, '([{<"''`“”„«»‘’‚§%=—–,;:!?)]}>*&#$£€…') AS body
          FROM (SELECT doc_id, unnest(ws) AS w, unnest(range(len(ws))) AS i FROM (SELECT doc_id, string_split_regex(text, '[ \x09-\x0D]+') AS ws FROM documents)))))))
  GROUP BY doc_id"""
_PEELED_SHORT = {
    "en": "'mr', 'mrs', 'ms', 'dr', 'prof', 'st', 'jr', 'sr', 'vs', 'etc', 'inc', 'ltd', 'co', 'corp', 'no', 'jan', 'feb', 'mar', 'apr', 'aug', 'sept', 'oct', 'nov', 'dec'",
    "de": "'bzw', 'usw', 'ca', 'dr', 'prof', 'nr', 'str', 'vgl', 'evtl', 'ggf', 'inkl', 'zzgl', 'hr', 'fr', 'jan', 'feb', 'aug', 'sept', 'okt', 'nov', 'dez'",
    "et": "'jne', 'nt', 'lk', 'vt', 'jt', 'st', 'nr', 'dr', 'prof', 'hr', 'pr', 'tel', 'u', 'saj'",
    "ro": "'dl', 'dna', 'dvs', 'nr', 'str', 'pag', 'etc', 'dr', 'prof', 'art', 'alin', 'jud', 'bd'",
}
_CUT_DASHES, _CUT_LONG = r"(\p{L})(--|[-–—~])(\p{L})", r"(\p{L})(--|—)(\p{L})"
_CUT_BOTH = r"\1 \2 \3"
#: Pattern, what it gives, and how often it is applied.
_PEELED_CUTS = {
    "en": ((r"(?i)(\p{L})(n[''’]t|[''’](?:s|m|d|ll|re|ve))([^\p{L}]|$)", r"\1 \2\3", 2), (r"(?i)^(can)(not)$", r"\1 \2", 1)),
    "ro": (
        (r"(?i)^(s|m|v|i|l|c|n|d|le|mi|ți|și|nu|de|din|într|dintr|printr|te|ne|se)-(\p{L})", r"\1- \2", 1),
        (r"(?i)(\p{L})-(l|o|i|le|mi|ți|și|mă|te|ne|vă|se|a|ul|ului)$", r"\1 -\2", 1),
    ),
}
_PEELED_ALL = (
    (r"(\.{2,})", r" \1 ", 1),
    (r"(\p{Ll})\.(\p{Lu})", r"\1 . \2", 2),
    (r"(\p{L}),(\p{L})", r"\1 , \2", 2),
    (r"([\p{L}\p{Nd}])([:<>=/])(\p{L})", _CUT_BOTH, 2),
    (r"(\p{Nd})([+*^])(\p{Nd})", _CUT_BOTH, 2),
    (r"^(\p{Nd}+(?:[.,]\p{Nd}+)*)(km|m|cm|mm|kg|g|mg|l|ml|h|min|s)$", r"\1 \2", 1),
)


def _peeled_sql(lang: str) -> str:
    cut = "bare"
    for pattern, new, times in (*_PEELED_CUTS.get(lang, ()), *_PEELED_ALL, (_CUT_DASHES if lang in ("en", "et") else _CUT_LONG, _CUT_BOTH, 2)):
        for _ in range(times):
            cut = f"regexp_replace({cut}, '{pattern}', '{new}', 'g')"
    return _PEELED_SQL.replace("CUT", cut).replace("SHORT", _PEELED_SHORT[lang])


_PEELED_LINE = "CASE WHEN text IS NOT NULL THEN trim(regexp_replace(coalesce({0}.line, ''), ' +', ' ', 'g')) END AS {0}"


@query(
    f"SELECT d.doc_id, {', '.join(_PEELED_LINE.format(c) for c in _PEELED_SHORT)} FROM documents d "
    + " ".join(f"LEFT JOIN ({_peeled_sql(c)}) {c} ON {c}.doc_id = d.doc_id" for c in _PEELED_SHORT)
)
def peeled_tokens(spark, sf_dir):
    """Every text in the tokens of each language that has rules."""
    return table(spark, sf_dir, "documents").select("doc_id", *(tokens.peeled_line(F.col("text"), c).alias(c) for c in tokens.INFIXES))
