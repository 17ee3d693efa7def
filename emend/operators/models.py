"""Where outside models plug in: hidden states of a text at token positions, and generated answers.

A backend is made once in each Python worker by a factory and sees batches. The stubs answer by a rule, so that pipelines run and can be tested without a model.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Hidden states: (text, positions, layer) -> an array for each position.
Encoder = Callable[[str, list[int], int], np.ndarray]
#: Answers for a batch of prompts.
Generator = Callable[[list[str]], list[str]]


def stub_encoder(dimensions: int = 16) -> Encoder:
    """Vectors that depend on the text's prefix up to the position, and the layer, only."""

    def encode(text: str, positions: list[int], layer: int) -> np.ndarray:
        tokens = text.split()
        out = []
        for p in positions:
            at = min(max(p, 0), max(len(tokens) - 1, 0))  # a position outside is read at the edge
            seed = hashlib.sha256(f"{layer}|{' '.join(tokens[: at + 1])}".encode()).digest()
            out.append(np.frombuffer((seed * (dimensions // 4 + 1))[: dimensions * 8], np.uint64).astype(float) / 2.0**64 - 0.5)
        return np.array(out)

    return encode


def stub_generator(marked: bool = True) -> Generator:
    """Gives back the last `Sentence:` of a prompt, as an answer in tags."""

    def generate(prompts: list[str]) -> list[str]:
        last = [p.rpartition("Sentence: ")[2].split("\n")[0] for p in prompts]
        return [f"<corrected sentence>{s}</corrected sentence>" if marked else s for s in last]

    return generate


@lru_cache(4)
def _made(factory: Callable) -> object:
    """One backend in each worker process."""
    return factory()


ENCODERS: dict[str, Callable[[], Encoder]] = {"stub": stub_encoder}
GENERATORS: dict[str, Callable[[], Generator]] = {"stub": stub_generator}


def hidden_states(batches: DataFrame, factory: Callable[[], Encoder], layer: int, text: str = "text", positions: str = "positions") -> DataFrame:
    """prompt_batches() -> its columns but the text, with pos (place in positions) and vec: one forward pass for each row."""
    kept = [f for f in batches.schema.fields if f.name not in (text, positions)]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = _made(factory)
        for rows in parts:
            own = [encode(t, list(p), layer) for t, p in zip(rows[text], rows[positions], strict=True)]
            times = [len(v) for v in own]
            out = rows[[f.name for f in kept]].loc[rows.index.repeat(times)].reset_index(drop=True)
            yield out.assign(pos=[i for n in times for i in range(n)], vec=[v.astype(np.float32) for o in own for v in o])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    return batches.mapInPandas(run, f"{schema}, pos int, vec array<float>")


def alternating_sides(states: DataFrame) -> DataFrame:
    """Even places are positive, odd ones negative: the rows with `pair` and `side`."""
    return states.withColumn("pair", F.floor(F.col("pos") / 2).cast("int")).withColumn("side", F.when(F.col("pos") % 2 == 0, "pos").otherwise("neg"))


def as_text(prompts: DataFrame, column: str = "sentence") -> DataFrame:
    """Chat prompts as one text, contents parted by line breaks."""
    if prompts.schema[column].dataType.typeName() == "array":
        return prompts.withColumn(column, F.array_join(F.transform(column, lambda m: m["content"]), "\n"))
    return prompts


def generated(prompts: DataFrame, factory: Callable[[], Generator], column: str = "sentence", batch: int = 8) -> DataFrame:
    """prompts with `response`; a batch of prompts goes to the model at a time."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        generate = _made(factory)
        for rows in parts:
            texts = rows["__text"].tolist()
            yield rows.drop(columns="__text").assign(response=[r for i in range(0, len(texts), batch) for r in generate(texts[i : i + batch])])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in prompts.schema.fields)
    own = as_text(prompts.withColumn("__text", F.col(column)), "__text")
    return own.mapInPandas(run, f"{fields}, response string")
