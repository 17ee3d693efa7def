"""Hierarchical language identification: the family first, then one-versus-one linear SVMs within it.

Features are the frequencies of hashed byte trigrams of the whole text (A-Z as a-z, other ASCII signs as blanks), so a decision is the mean
of one weight for each place of the text, summed by blocks. Families are those of linguistics. Both levels are linear SVMs with squared
hinge loss, one for each pair of families, then for each pair of languages of one family; each is trained in a group of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import drop, durable, small_batches

#: Training texts of one language at most: the only sample. Whole texts are read, in training as in prediction.
PER_LANGUAGE = 800
#: Hashed features.
FEATURES = 4096
#: Bytes of text that are looked up together.
BLOCK = 1 << 18
#: What a text without a letter gets.
UNKNOWN = "und"

_fold = np.full(256, 32, np.uint8)
_fold[128:] = np.arange(128, 256)
_fold[97:123] = np.arange(97, 123)
_fold[65:91] = np.arange(97, 123)
#: A letter of any script.
LETTER = r"\p{L}"
_LETTER = regex.compile(LETTER)


def trigrams(data: bytes) -> np.ndarray:
    """Feature of each place of the text; runs of blanks count as they are."""
    x = _fold[np.frombuffer(b" " + data + b" ", np.uint8)].astype(np.uint32)
    if len(x) < 3:
        return np.empty(0, np.int64)
    code = (x[:-2] * np.uint32(0x9E3779B1) ^ x[1:-1] * np.uint32(0x85EBCA77) ^ x[2:] * np.uint32(0xC2B2AE3D)) * np.uint32(0x27D4EB2F)
    blank = (x[:-2] == 32) & (x[1:-1] == 32)
    return np.where(blank, 0, (code >> np.uint32(20)) % np.uint32(FEATURES - 1) + 1).astype(np.int64)


def counted(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(features, how often) of a whole text."""
    codes = trigrams(text)
    counts = np.bincount(codes[codes > 0], minlength=FEATURES)
    found = np.flatnonzero(counts)
    return found, counts[found]


def frequencies(counts: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    out = np.zeros((len(counts), FEATURES), np.float32)
    for row, (found, n) in zip(out, counts, strict=True):
        row[found] = n / max(1, n.sum())
    return out


def linear_svm(x: np.ndarray, y: np.ndarray, penalty: float = 1e-4, rounds: int = 200) -> tuple[np.ndarray, float]:
    """Weights and bias for labels +-1: squared hinge loss, accelerated gradient descent."""
    y = y.astype(x.dtype)
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(x.dtype)
    w, b, v, c = np.zeros(x.shape[1], x.dtype), 0.0, np.zeros(x.shape[1], x.dtype), 0.0
    step = 1.0 / (2 * (float((weight * (np.einsum("ij,ij->i", x, x) + 1)).sum()) + penalty))
    for i in range(rounds):
        slack = np.maximum(0, 1 - y * (x @ v + c)) * y * weight
        w2, b2 = v + step * (2 * (x.T @ slack) - penalty * v), c + step * 2 * slack.sum()
        v, c = w2 + i / (i + 3) * (w2 - w), b2 + i / (i + 3) * (b2 - b)
        w, b = w2, b2
    return w, float(b)


@dataclass
class Model:
    """languages; the family of each; for each decision its two sides (families, then languages), weights and bias."""

    languages: list[str]
    family: list[int]
    sides: list[tuple[str, int, int]]
    weights: np.ndarray  # FEATURES x decisions
    bias: np.ndarray

    def predict(self, texts: list[bytes], letters: np.ndarray) -> tuple[list[str], np.ndarray]:
        margins = np.zeros((len(texts), len(self.sides)))
        i = 0
        while i < len(texts):
            parts, held, j = [], 0, i
            while j < len(texts) and (j == i or held + len(texts[j]) <= BLOCK):
                parts.append(trigrams(texts[j]))
                held += len(texts[j]) + 2
                j += 1
            codes = np.concatenate(parts)
            at = np.cumsum([0, *map(len, parts)])
            for d in range(len(self.sides)):
                upto = np.concatenate(([0.0], np.cumsum(self.weights[codes, d])))
                margins[i:j, d] = upto[at[1:]] - upto[at[:-1]]
            real = np.concatenate(([0], np.cumsum(codes > 0)))
            margins[i:j] /= np.maximum(1, real[at[1:]] - real[at[:-1]])[:, None]
            i = j
        margins += self.bias
        return self.decide(margins, letters)

    def decide(self, margins: np.ndarray, letters: np.ndarray) -> tuple[list[str], np.ndarray]:
        """Votes among families, then among the languages of the family that won; equal votes go to the larger sum of margins, then to the first."""
        sure = 1 / (1 + np.exp(-4 * np.clip(np.abs(margins), 0, 20)))
        families = sorted(set(self.family))
        won, scores = self._vote("family", families, margins, sure)
        at = np.zeros(len(margins), np.int64)
        for f in families:
            own, rows = [k for k, g in enumerate(self.family) if g == f], won == f
            best, chance = self._vote("language", own, margins[rows], sure[rows])
            at[rows] = best
            scores[rows] *= chance
        scores = np.where(letters, scores, 0.0)
        return [self.languages[k] if ok else UNKNOWN for k, ok in zip(at, letters, strict=True)], scores

    def _vote(self, level: str, options: list[int], margins: np.ndarray, sure: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each row the option that wins most duels, and the least sure of these."""
        place = {o: i for i, o in enumerate(options)}
        duels = [(d, place[a], place[b]) for d, (at, a, b) in enumerate(self.sides) if at == level and a in place and b in place]
        votes, sums = np.zeros((2, len(margins), len(options)))
        for d, a, b in duels:
            first = margins[:, d] >= 0
            votes[:, a] += first
            votes[:, b] += ~first
            sums[:, a] += margins[:, d]
            sums[:, b] -= margins[:, d]
        best = np.lexsort((np.broadcast_to(-np.arange(len(options)), votes.shape), sums, votes), axis=1)[:, -1]
        chance = np.ones(len(margins))
        for d, a, b in duels:
            own = np.where((margins[:, d] >= 0) == (best == a), sure[:, d], 1 - sure[:, d])
            chance = np.where((best == a) | (best == b), np.minimum(chance, own), chance)
        return np.array(options)[best], chance


#: Families of languages by their ISO 639-1 codes. A language that isn't listed is a family of its own.
FAMILIES = {
    "Germanic": "af da de en fo fy is lb nb nl nn no sv yi",
    "Romance": "ca es fr gl it la oc pt rm ro sc",
    "Slavic": "be bg bs cs hr mk pl ru sh sk sl sr uk",
    "Baltic": "lt lv",
    "Celtic": "br cy ga gd gv",
    "Uralic": "et fi hu se",
    "Turkic": "az kk ky tk tr tt ug uz",
    "Indo-Aryan": "bn gu hi mr ne pa si ur",
    "Iranian": "fa ku ps tg",
    "Semitic": "am ar he mt",
    "Sinitic": "yue zh",
    "Austronesian": "id jv mg ms su tl",
    "Bantu": "ln lg rw sn st sw xh zu",
    "Dravidian": "kn ml ta te",
}
_FAMILY = {code: family for family, codes in FAMILIES.items() for code in codes.split()}


def families_of(names: list[str]) -> list[int]:
    """For each language the number of its family."""
    found = [_FAMILY.get(n.lower().split("-")[0].split("_")[0], f"={n}") for n in names]
    order = sorted(set(found))
    return [order.index(f) for f in found]


#: Frequencies are small; this makes margins of 1 reachable under the penalty.
SCALE = 60.0


def duel(counts: list[tuple[np.ndarray, np.ndarray]], first: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights and bias that tell the texts of the first side from the others."""
    x = frequencies(counts)  # in single precision and never copied
    x *= np.float32(SCALE)
    w, c = linear_svm(x, np.where(first, 1.0, -1.0))
    return w.astype(np.float64) * SCALE, c


def duels(names: list[str]) -> list[tuple[str, int, int]]:
    """(level, one, other): all pairs of families, then those of languages of one family."""
    family = families_of(names)
    pairs = lambda level, options: [(level, a, b) for i, a in enumerate(options) for b in options[i + 1 :]]
    return pairs("family", sorted(set(family))) + [d for d in pairs("language", list(range(len(names)))) if family[d[1]] == family[d[2]]]


def model_of(names: list[str], results: list[tuple[np.ndarray, float]]) -> Model:
    """The model of these results of duels(names)."""
    weights = np.array([w for w, _ in results]).T if results else np.zeros((FEATURES, 0))
    weights[0] = 0
    return Model(names, families_of(names), duels(names), np.ascontiguousarray(weights), np.array([c for _, c in results]))


def train(counts: list[tuple[np.ndarray, np.ndarray]], languages: list[str]) -> Model:
    """The model of these texts, all of them here: for few texts."""
    names = sorted(set(languages))
    y, family, results = np.array([names.index(v) for v in languages]), np.array(families_of(names)), []
    for level, a, b in duels(names):
        label = family[y] if level == "family" else y
        own = np.flatnonzero((label == a) | (label == b))
        results.append(duel([counts[i] for i in own], label[own] == a))
    return model_of(names, results)


def held_out(doc_id: Column, folds: int = 5) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds == 0


def training_sample(docs: DataFrame, per_language: int = PER_LANGUAGE) -> DataFrame:
    """At most per_language labelled texts of each language: those with the smallest digests of their text."""
    known = docs.where(F.col("lang").isNotNull() & F.col("text").rlike(LETTER))
    rows = known.select("lang", F.md5(F.col("text").cast("binary")).alias("k")).groupBy("lang", "k").agg(F.lit(1).alias("one"))
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # a row for each language
    if not counts:
        return known.select("lang", "text").limit(0)
    # digests are even: a share of them is a sample of known size, from which the first rows are taken
    share = F.lit(0.0)
    for lang, n in counts.items():
        share = F.when(F.col("lang") == lang, F.lit(min(1.0, 1.5 * per_language / n + 50 / n))).otherwise(share)
    few = known.select("lang", "text", F.md5(F.col("text").cast("binary")).alias("k")).where(F.conv(F.substring("k", 1, 8), 16, 10).cast("double") / float(1 << 32) < share)
    few = few.dropDuplicates(["lang", "k"])
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("k"))
    return few.withColumn("r", rank).where(F.col("r") <= per_language).select("lang", "k", "text")


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        own = [counted((x or "").encode()) for x in batch.column("text").to_pylist()]
        columns = [pa.array([c[i].astype(np.int64).tobytes() for c in own], pa.binary()) for i in (0, 1)]
        yield pa.RecordBatch.from_arrays([batch.column("lang"), batch.column("k"), *columns], ["lang", "k", "found", "n"])


def _settled(rows: pd.DataFrame) -> pd.DataFrame:
    """A duel's texts (nth, first, lang, k, found, n) -> its weights and bias."""
    rows = rows.sort_values(["lang", "k"])
    counts = [tuple(np.frombuffer(v, np.int64) for v in pair) for pair in zip(rows["found"], rows["n"], strict=True)]
    w, c = duel(counts, rows["first"].to_numpy(bool))
    return pd.DataFrame({"nth": [rows["nth"].iloc[0]], "weights": [w.tobytes()], "bias": [c]})


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE) -> Model:
    """docs (text, lang, ...): a model of the languages of the labelled rows. Executors count the features of the sample's whole texts and settle
    the duels, each in one group of per_language texts a language at most; the driver gets weights alone."""
    small_batches(docs.sparkSession)
    sample = durable(training_sample(docs, per_language).mapInArrow(_counts, "lang string, k string, found binary, n binary"), "languages")
    names = sorted(r["lang"] for r in sample.select("lang").distinct().collect())
    if len(names) < 2:
        drop(sample)
        return model_of(names, [])
    family, sides = families_of(names), []
    for nth, (level, a, b) in enumerate(duels(names)):
        for i, lang in enumerate(names):
            own = family[i] if level == "family" else i
            if own in (a, b):
                sides.append((lang, nth, own == a))
    meets = docs.sparkSession.createDataFrame(sides, "lang string, nth int, first boolean")  # by language and duel, few
    found = sample.join(F.broadcast(meets), "lang").groupBy("nth").applyInPandas(_settled, "nth int, weights binary, bias double").collect()
    drop(sample)
    return model_of(names, [(np.frombuffer(r["weights"]), r["bias"]) for r in sorted(found, key=lambda r: r["nth"])])


def _predict(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [x or "" for x in batch.column("text").to_pylist()]
        letters = np.array([_LETTER.search(t) is not None for t in texts], bool)
        names, scores = model.predict([t.encode() for t in texts], letters) if model.languages else ([UNKNOWN] * len(texts), np.zeros(len(texts)))
        rest = [batch.column(k) for k in range(batch.num_columns)]
        yield pa.RecordBatch.from_arrays([*rest, pa.array(names, pa.string()), pa.array(scores, pa.float64())], [*batch.schema.names, "lang_pred", "score"])


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """docs (text, ...) -> the same rows and columns with lang_pred and score (0 to 1).

    Null text, or one without a letter: `und` with score 0. A model of one language always gives it, one of none always `und`. Repeated
    rows get equal predictions; null ids and an empty table need nothing special. Columns named as the two new ones are replaced.
    """
    small_batches(docs.sparkSession)
    docs = docs.drop("lang_pred", "score")
    schema = T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return docs.mapInArrow(lambda it: _predict(it, model), schema)


def op3_language_id(spark, sf_dir: str) -> DataFrame:
    from .common import table

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", held_out(F.col("doc_id")))
    model = fit(docs.where(~F.col("held_out")))
    return identify(docs.select("doc_id", "held_out", "text"), model).drop("text")
