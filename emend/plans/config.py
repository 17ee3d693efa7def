"""Settings of runs: languages, models, retrieval, final prompts."""

from __future__ import annotations

from dataclasses import asdict, dataclass, fields

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Language:
    code: str
    test: str
    train: str
    source: str
    cache: str
    correct_examples: int
    top_k: int
    scorer: str | None
    submission: bool = False


@dataclass(frozen=True)
class Model:
    key: str
    retrieve_dim: int
    layer: int


@dataclass(frozen=True)
class Run:
    """What a run can be told; nothing is read from the environment."""

    split: str = "infer"
    demo_floor: int = 3
    least_examples: int = 2
    most_examples: int = 10
    average_examples: float = 8.0
    hints: bool = False
    hint_mode: str = "auto"
    hint_purity: float = 0.6
    most_hints: int = 2
    template: str = "min_edit"
    prefill: bool = False
    chat: bool = True
    batch: int = 8
    seed: int = 88
    by_text: bool = False


#: Languages and their corpora; examples per sentence and neighbours per site; who scores.
LANGUAGES = {
    "en": Language("en", "conll14", "wilocness", "wilocness", "en", 2, 4, "m2"),
    "bea19": Language("bea19", "bea19", "wilocness", "wilocness", "en", 2, 4, None, True),
    "de": Language("de", "falko_merlin", "falko_merlin_train", "falko_merlin", "de", 2, 4, "m2"),
    "ro": Language("ro", "ronacc_readerbench", "ronacc_readerbench_train", "ronacc_readerbench", "ronacc_readerbench", 2, 4, "external"),
    "et": Language("et", "estgec", "estgec_train", "estgec", "et", 4, 4, "external"),
}
MODELS = {"llama31": Model("llama31", 128, -21), "qwen25": Model("qwen25", 256, -12)}
SEEDS = (88, 111, 222)
#: Fixed value: lines of the English submission.
SUBMISSION_LINES = 4477


def language(code: str) -> Language:
    if code not in LANGUAGES:
        raise ValueError(f"unknown language {code!r}; known: {sorted(LANGUAGES)}")
    return LANGUAGES[code]


def model(key: str) -> Model:
    if key not in MODELS:
        raise ValueError(f"unknown model {key!r}; known: {sorted(MODELS)}")
    return MODELS[key]


def run_of(settings: dict[str, object]) -> Run:
    """Settings by name, unknown ones an error, texts turned into the field's type."""
    kinds = {f.name: type(getattr(Run(), f.name)) for f in fields(Run)}
    if unknown := settings.keys() - kinds.keys():
        raise ValueError(f"unknown settings: {sorted(unknown)}")
    truth = {"1": True, "true": True, "yes": True, "0": False, "false": False, "no": False}
    cast = lambda k, v: truth[str(v).lower()] if kinds[k] is bool else kinds[k](v)
    return Run(**{k: cast(k, v) for k, v in settings.items()})


def run_matrix(spark: SparkSession) -> DataFrame:
    """Every model, language and seed. Retrieval doesn't depend on the seed, so one table serves all of them."""
    return spark.createDataFrame([{**asdict(m), **asdict(v), "seed": s} for m in MODELS.values() for v in LANGUAGES.values() for s in SEEDS], "key string, retrieve_dim int, layer int, code string, test string, train string, source string, cache string, correct_examples int, top_k int, scorer string, submission boolean, seed int")
