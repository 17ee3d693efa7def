"""Stages of a correction run as functions of DataFrames, and a runner that keeps what is already stored."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import tags, text
from ..operators import cleanup, edits, hints, m2, models, prompts, retrieval, vectors
from ..operators.ordering import numbered
from ..sources import readers, sinks
from .config import Language, Run

#: Fixed value: the order of the stages of a run.
ORDER = ("initial", "cache", "retrieval", "final", "score")


@dataclass(frozen=True)
class Stage:
    """A name, where its table is stored, and how it is made from the tables of the stages before."""

    name: str
    path: str
    make: Callable[[SparkSession, dict[str, DataFrame]], DataFrame]


def enabled(name: str, start: str = ORDER[0], stop: str = ORDER[-1]) -> bool:
    return ORDER.index(start) <= ORDER.index(name) <= ORDER.index(stop)


def run_stages(spark: SparkSession, stages: list[Stage], overwrite: bool = False, dry: bool = False, start: str | None = None, stop: str | None = None) -> tuple[dict[str, DataFrame], list[str]]:
    """The stages' tables, and what was done with each. A stored table is read, not made again, unless overwritten."""
    tables: dict[str, DataFrame] = {}
    log = []
    names = [s.name for s in stages]
    own = slice(names.index(start) if start else 0, names.index(stop) + 1 if stop else None)
    for s in stages[own]:
        if readers.exists(spark, s.path) and not overwrite:
            log.append(f"kept {s.name}")
        elif dry:
            log.append(f"would make {s.name}")
            continue
        else:
            sinks.write_table(s.make(spark, tables), s.path, overwrite=True)
            if not readers.exists(spark, s.path):
                raise OSError(f"{s.path} was not written")
            log.append(f"made {s.name}")
        tables[s.name] = spark.read.parquet(s.path)
    return tables, log


# --- preparation --------------------------------------------------------------


def corpus_rows(pairs: DataFrame, dataset: str, tokens: bool = True) -> DataFrame:
    """pairs (line_no, src[, tgt]) as corpus rows; ids are `line_dataset`."""
    out = pairs.withColumn("id", F.concat_ws("_", F.col("line_no").cast("string"), F.lit(dataset))).withColumn("text", text.clean_space(F.col("src")))
    if tokens:
        out = out.withColumn("src_tokens", text.words(F.col("text")))
    if "tgt" in pairs.columns:
        out = out.withColumn("label", text.clean_space(F.col("tgt"))).withColumn("labels", F.array("label"))
        if tokens:
            out = out.withColumn("tgt_tokens", text.words(F.col("label")))
    return out.select("line_no", *(c for c in ("id", "text", "src_tokens", "label", "labels", "tgt_tokens") if c in out.columns))


def prepare_conll14(spark: SparkSession, m2_path: str) -> DataFrame:
    found = readers.m2_sources(readers.lines(spark, m2_path)).select(F.col("line_no").alias("at"), F.col("value").alias("src"))
    sources = numbered(found, ["at"], "line_no").select("line_no", "src")
    return corpus_rows(sources, "conll14")


def prepare_bea19(spark: SparkSession, path: str) -> DataFrame:
    return corpus_rows(readers.lines(spark, path).select("line_no", F.col("value").alias("src")), "bea19")


def prepare_wilocness(spark: SparkSession, m2_path: str, least_tokens: int = 6) -> DataFrame:
    """Training pairs of at least six source tokens."""
    rows = corpus_rows(readers.m2_pairs(readers.lines(spark, m2_path)), "wilocness")
    return rows.where(F.size("src_tokens") >= least_tokens)


def prepare_falko_merlin(spark: SparkSession, source: str, target: str, dataset: str = "falko_merlin_train") -> DataFrame:
    return corpus_rows(readers.parallel(spark, source, target), dataset)


def prepare_ronacc(spark: SparkSession, path: str, dataset: str = "ronacc_readerbench_train") -> DataFrame:
    pairs = readers.alternating(readers.lines(spark, path))
    spaced = lambda c: text.retokenized(text.space_brackets(F.col(c)), "ro")
    return corpus_rows(pairs.select("line_no", spaced("src").alias("src"), spaced("tgt").alias("tgt")), dataset)


def prepare_estgec(spark: SparkSession, path: str, dataset: str = "estgec_train") -> DataFrame:
    pairs = readers.marked_mistakes(spark, path)
    own = lambda c: text.retokenized(F.col(c), "et")
    return corpus_rows(pairs.select("line_no", own("src").alias("src"), own("tgt").alias("tgt")), dataset)


#: Recipes by the language's code: what a training corpus is made of.
RECIPES = {"en": prepare_wilocness, "bea19": prepare_wilocness, "de": prepare_falko_merlin, "ro": prepare_ronacc, "et": prepare_estgec}


def label_lines(pairs: DataFrame) -> DataFrame:
    """pairs (line_no, src, tgt) -> (line_no, src, tgt, label): the tagged line of each pair whose tags give back its target."""
    return edits.with_tags(pairs).withColumn("label", tags.tagged_line(F.col("items"))).drop("items")


# --- a run --------------------------------------------------------------------


def site_pairs(pairs: DataFrame, lang: str, variant: str = "build") -> DataFrame:
    """pairs (line_no, src, tgt) -> line_no, diff_id, diff and the positive and negative prefix of each pair of sites."""
    tagged = edits.with_tags(pairs).withColumn("pred_items", F.col("items")).withColumn("pred_tgt", F.col("tgt"))
    rows = edits.exploded_sites(edits.with_sites(tagged, variant), "line_no").where("side = 'gold'").drop("side")
    cut = edits.prefixes(pairs, rows, lang)
    pick = lambda b: cut.where(F.col("bucket") == b).select("line_no", "rank", "diff", "src_prefix", "tgt_prefix")
    found = edits.cyclic_pairs(pick("pos"), pick("neg"))
    return found.select("line_no", F.col("pos_rank").alias("diff_id"), F.col("pos_diff").alias("diff"), F.col("neg_rank").alias("neg_id"), F.col("pos_tgt_prefix").alias("positive"), F.col("neg_tgt_prefix").alias("negative"))


def site_vectors(pairs: DataFrame, encoder, layer: int, lang: str, variant: str = "build") -> DataFrame:
    """pairs (line_no, src, tgt) -> site_id, line_no, diff_id, vec, key, label: one vector for each changed place, the mean over its pairs."""
    found = site_pairs(pairs, lang, variant).join(pairs.select("line_no", "src", "tgt"), "line_no")
    full = found.withColumn("prompt", prompts.reading_prompt(F.col("src"), F.col("tgt")))
    offset = F.size(text.words(F.regexp_replace("prompt", r"(?s)\nCorrection: .*$", "\nCorrection: ")))
    last = lambda c: (offset + F.size(text.words(F.col(c))) - 1).cast("int")
    batches = full.withColumn("read", F.array(last("positive"), last("negative"))).groupBy("line_no", "prompt").agg(F.array_sort(F.collect_list(F.struct("diff_id", "neg_id", "diff", "read"))).alias("own"))
    batches = batches.withColumn("positions", F.flatten(F.transform("own", lambda x: x["read"])))
    states = models.alternating_sides(models.hidden_states(batches.select("line_no", "own", "prompt", "positions"), encoder, layer, "prompt"))
    sides = states.groupBy("line_no", "pair").agg(F.max_by("vec", F.when(F.col("side") == "pos", 1)).alias("p"), F.max_by("vec", F.when(F.col("side") == "neg", 1)).alias("n"), F.first("own").alias("own"))
    each = sides.select("line_no", F.get("own", F.col("pair"))["diff_id"].alias("diff_id"), F.get("own", F.col("pair"))["diff"].alias("diff"), "pair", vectors.minus(F.col("p"), F.col("n")).alias("vec"))
    pooled = vectors.mean_vectors(each, ["line_no", "diff_id"], "vec", ("diff",), "pair").drop("n")
    named = pooled.join(pairs.select("line_no", "src", "tgt"), "line_no")
    return named.select(F.xxhash64("line_no", "diff_id").alias("site_id"), "line_no", "diff_id", "vec", F.concat_ws("\t", "src", "diff").alias("key"), F.concat_ws("\t", "src", "tgt").alias("label"))


def test_vectors(lines: DataFrame, predictions: DataFrame, encoder, layer: int, lang: str) -> DataFrame:
    """site_vectors() of the test side: lines (line_no, src) against what was predicted for them (line_no, prediction), not against their targets.

    The tags of the first predictions say where the sites are. Lines without a prediction, or with an empty one, have none.
    """
    said = predictions.select("line_no", F.col("prediction").alias("tgt")).where("trim(tgt) <> ''")
    return site_vectors(lines.select("line_no", "src").join(said, "line_no"), encoder, layer, lang, "retrieve")


def retrieved(lines: DataFrame, test_sites: DataFrame, train_sites: DataFrame, train_pairs: DataFrame, lang: Language, dimensions: int, run: Run) -> DataFrame:
    """Retrieval rows for lines (line_no, src): scaled, projected, nearest sites, and correct examples at random.

    run.by_text: vectors of both sides are looked up by their key, and where a test site has the key of a training site, its vector stands for both.
    """
    m = vectors.moments(train_sites)
    scale = lambda df: df.withColumn("vec", vectors.scaled(F.col("vec"), m))
    basis = vectors.principal(scale(train_sites), max(dimensions, 5))
    both = [vectors.in_components(scale(df), basis, "vec", "projected", dimensions) for df in (test_sites, train_sites)]
    test = both[0].select("line_no", "site_id", "key", F.get("projected", F.lit(0)).alias("pc1"), F.col("projected").alias("vec"))
    parts = F.split("label", "\t")
    train = both[1].select(F.col("site_id").alias("id"), F.get(parts, F.lit(0)).alias("text"), F.get(parts, F.lit(1)).alias("label"), "key", F.col("projected").alias("vec"))
    near = retrieval.site_neighbours(test, train, lang.top_k, run.demo_floor, run.by_text)
    right = train_pairs.where("src = tgt").select(F.col("line_no").alias("id"), F.col("src").alias("text"), F.col("tgt").alias("label"))
    correct = retrieval.sampled(lines, right, lang.correct_examples, seed=0)
    return retrieval.retrieval_rows(lines, retrieval.example_lists(near, correct, lang.train), lang.test)


def final_prompts(retrieved_rows: DataFrame, run: Run) -> DataFrame:
    """Prompts of retrieval rows: limits, min-max similarities, hints, template."""
    rows = retrieved_rows.withColumn("line_no", F.split("id", "_")[0].cast("bigint")).withColumn("available", F.size("in_domain_examples"))
    limit = retrieval.limits(rows.select(F.col("line_no").alias("idx"), "available"), run.least_examples, run.most_examples, run.average_examples)
    each = rows.select("line_no", F.posexplode("in_domain_examples").alias("p", "e")).select("line_no", (F.col("p") + 1).alias("rank"), "e.*")
    each = each.withColumn("similarity", retrieval.min_max(F.col("similarity"), "line_no"))
    kept = retrieval.first_examples(each, limit.withColumnRenamed("idx", "line_no"))
    about = hints.descriptions(hints.votes(kept), run.hint_mode, least=run.hint_purity, most=run.most_hints) if run.hints else None
    return prompts.final_prompts(rows.select("line_no", "id", "text"), kept.withColumn("description", F.col("key")), prompts.TEMPLATES[run.template], about, chat=run.chat)


def answered(prompt_rows: DataFrame, generator, dataset: str, batch: int = 8) -> DataFrame:
    """Prompts -> cleaned predictions."""
    return cleanup.cleaned(models.generated(prompt_rows, generator, batch=batch), cleanup.threshold(dataset))


def scored(predictions: DataFrame, annotations: DataFrame, lang: Language, external: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """predictions (line_no, prediction) against gold annotations by the language's scorer; other scorers are passed in."""
    if lang.scorer == "m2":
        guarded = cleanup.scorable(predictions, annotations.select(F.col("sent_idx").alias("line_no"), F.col("source").alias("value")).distinct())
        rows = annotations.join(guarded.select(F.col("line_no").alias("sent_idx"), F.col("prediction").alias("hypothesis")), "sent_idx")
        return m2.corpus_score(rows)
    if external is None:
        raise NotImplementedError(f"{lang.code} is scored by an outside tool")
    return external(predictions)


def whole_run(spark: SparkSession, folder: str, lines: DataFrame, train_pairs: DataFrame, lang: Language, model: Model, encoder, generator, run: Run = Run(), annotations: DataFrame | None = None, overwrite: bool = False) -> tuple[dict[str, DataFrame], list[str]]:
    """All stages of a run over lines (line_no, src) and training pairs (line_no, src, tgt), each stored in the folder: first predictions, vectors of the
    training side, retrieval, final predictions and, with gold annotations, the score. What is stored is not made again.
    """
    numbered_lines = lines.select("line_no", "src", F.concat_ws("_", F.col("line_no").cast("string"), F.lit(lang.test)).alias("id"), F.col("src").alias("text"))
    plain = F.array().cast("array<struct<text:string,label:string>>")

    def initial(spark: SparkSession, t: dict[str, DataFrame]) -> DataFrame:
        asked = numbered_lines.withColumn("sentence", prompts.prompt(prompts.TEMPLATES["zero_shot"], plain, F.col("text")))
        return answered(asked, generator, lang.test if lang.test in cleanup.LIKENESS else "conll14", run.batch)

    def final(spark: SparkSession, t: dict[str, DataFrame]) -> DataFrame:
        out = answered(final_prompts(t["retrieval"], run), generator, lang.test if lang.test in cleanup.LIKENESS else "conll14", run.batch)
        return out.withColumn("line_no", F.split("id", "_")[0].cast("bigint"))

    plan = [
        Stage("initial", f"{folder}/initial", initial),
        Stage("cache", f"{folder}/cache", lambda spark, t: site_vectors(train_pairs, encoder, model.layer, lang.code)),
        Stage("test_sites", f"{folder}/test_sites", lambda spark, t: test_vectors(lines, t["initial"], encoder, model.layer, lang.code)),
        Stage("retrieval", f"{folder}/retrieval", lambda spark, t: retrieved(lines, t["test_sites"], t["cache"], train_pairs, lang, model.retrieve_dim, run)),
        Stage("final", f"{folder}/final", final),
    ]
    if annotations is not None and lang.scorer == "m2":
        plan.append(Stage("score", f"{folder}/score", lambda spark, t: scored(t["final"].select("line_no", "prediction"), annotations, lang)))
    return run_stages(spark, plan, overwrite)
