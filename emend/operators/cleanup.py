"""Model answers made fit for scoring: guards, rules with reasons, statistics."""

from __future__ import annotations

from functools import reduce
from operator import or_

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.matching import Matcher
from ..functions.text import extract_answer, strip, words

#: Least likeness of an answer to its source, by dataset.
LIKENESS = {"conll14": 0.70, "bea19": 0.70, "falko_merlin": 0.70, "ronacc_readerbench": 0.96, "estgec": 0.96}
#: Phrases by which a model says that there is nothing to correct, or comments.
NOTHING = r"(?i)\b(?:no\s+corrections?\s+needed|no\s+correction|not\s+grammatically\s+incorrect|not\s+incorrect|no\s+errors?\s+found)\b|ei\s+vaja"
COMMENT = r"(?i)\([^)]*(?:see\s+on|küsimus|question|no\s+correction|not\s+grammatically|ei\s+vaja)[^)]*\)"


def length_guard(prediction: Column, source: Column, factor: float = 1.75, more: int = 50) -> Column:
    """The source where an answer has more tokens than both factor times the source's and `more` above it."""
    p, s = F.size(words(prediction)), F.size(words(source))
    return F.when(p > F.greatest(F.floor(s * factor), s + more), source).otherwise(prediction)


def likeness(a: str, b: str) -> float:
    """Share of matching letters, white space apart; 1 for two empty texts."""
    a, b = "".join((a or "").split()), "".join((b or "").split())
    return Matcher(a, b).ratio() if a or b else 1.0


@F.pandas_udf(T.DoubleType())
def likeness_column(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([likeness(x, y) for x, y in zip(a, b, strict=True)], dtype=float)


def dataset_of(path: Column) -> Column:
    """The dataset whose name is a folder of the path, else is in the file's name; empty if none."""
    low = F.lower(path)
    parts, name = F.split(low, "/"), F.element_at(F.split(low, "/"), -1)
    by_folder = F.coalesce(*(F.when(F.array_contains(parts, d), F.lit(d)) for d in LIKENESS))
    by_name = F.coalesce(*(F.when(F.contains(name, F.lit(d)), F.lit(d)) for d in LIKENESS))
    return F.coalesce(by_folder, by_name, F.lit(""))


def threshold(dataset: str) -> float:
    if dataset not in LIKENESS:
        raise ValueError(f"no threshold for {dataset!r}; known: {', '.join(sorted(LIKENESS))}")
    return LIKENESS[dataset]


def cleaned(rows: DataFrame, least: float, with_ratio: bool = True) -> DataFrame:
    """rows (text, response, ...) with prediction_raw, prediction and postprocess_reason.

    In order: the tag of the erroneous sentence before that of the answer, or a phrase that nothing is to correct, in the response; such a phrase or a comment in the
    answer; too little likeness; kept. All but the last give the source. The costly ratio is computed only where the cheap rules say nothing.
    """
    response = F.coalesce("response", F.lit(""))
    out = rows.withColumn("__source", strip(F.coalesce("text", F.lit("")))).withColumn("__low", F.lower(response)).withColumn("prediction_raw", extract_answer(response, F.col("__source")))
    low, answer = F.col("__low"), F.col("prediction_raw")
    has = lambda where, *parts: reduce(or_, (F.contains(where, F.lit(p)) for p in parts))  # noqa: E731  what the costly patterns can't do without
    nothing = lambda text, where: has(where, "correct", "error", "vaja") & text.rlike(NOTHING)
    wrong, right = F.locate("<erroneous sentence>", low), F.locate("<corrected sentence>", low)
    bad = ((wrong > 0) & ((right == 0) | (wrong < right))) | nothing(response, low)
    said = nothing(answer, F.lower(answer)) | (has(answer, "(") & answer.rlike(COMMENT))
    out = out.withColumn("postprocess_reason", F.when(bad, "tagbad_or_no_correction").when(said, "comment_or_no_correction_in_prediction")).drop("__low")
    if with_ratio:
        ratio = likeness_column(F.when(F.col("postprocess_reason").isNull(), F.col("__source")), F.when(F.col("postprocess_reason").isNull(), F.col("prediction_raw")))
        out = out.withColumn("__ratio", ratio)
        out = out.withColumn("postprocess_reason", F.coalesce("postprocess_reason", F.when(F.col("__ratio") < least, f"char_lt_{least:.2f}"))).drop("__ratio")
    out = out.withColumn("postprocess_reason", F.coalesce("postprocess_reason", F.lit("kept")))
    kept = strip(F.col("prediction_raw"))
    return out.withColumn("prediction", F.when((F.col("postprocess_reason") == "kept") & (kept != ""), kept).otherwise(F.col("__source"))).drop("__source")


def reason_counts(rows: DataFrame) -> DataFrame:
    """(reason, n), the total with a null reason."""
    return rows.rollup(F.col("postprocess_reason").alias("reason")).agg(F.count("*").alias("n"))


def renamed_for_scoring(rows: DataFrame) -> DataFrame:
    names = {"text": "src", "prediction": "predict", "label": "tgt"}
    return rows.withColumnsRenamed({k: v for k, v in names.items() if k in rows.columns})


def scorable(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """predictions (line_no, prediction) guarded by sources (line_no, value); different numbers of lines are an error."""
    both = rows.join(sources.select("line_no", F.col("value").alias("__src")), "line_no", "full_outer")
    src = F.when(F.col("__src").isNotNull() & F.col("prediction").isNotNull(), F.col("__src")).otherwise(F.raise_error(F.lit("predictions and sources have different numbers of lines")).cast("string"))
    return both.withColumn("prediction", length_guard(F.col("prediction"), src)).drop("__src")
