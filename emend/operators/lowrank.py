"""Leading principal components without a matrix of dimensions by dimensions.

A block of random directions is multiplied by the covariance, pass after pass over the rows; the components are the best ones in the space of all blocks so far
(block Krylov space, Rayleigh-Ritz), and passes end when what is left over of each is small. A task holds its rows' batch and d x block numbers, the driver
d x (block * BLOCKS): once that many blocks are held, the best directions alone go on.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame

from .vectors import Components, moments

#: Directions beyond those asked for; blocks held; passes over the rows at most.
BEYOND, BLOCKS, PASSES = 8, 8, 100


def _times(rows: DataFrame, vector: str, mean: np.ndarray, block: np.ndarray) -> tuple[np.ndarray, float]:
    """(sum of x (x . block), sum of x . x) over all rows x less the mean, summed by task."""
    d, width = block.shape

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, squares, some = np.zeros((d, width)), 0.0, False
        for b in batches:
            if len(b):
                x = np.stack(b[vector].to_numpy()).astype(float) - mean
                total += x.T @ (x @ block)
                squares += float((x * x).sum())
                some = True
        if some:
            yield pd.DataFrame({"i": np.arange(d + 1), "row": [*total, np.array([squares] + [0.0] * (width - 1))]})

    parts = rows.select(vector).mapInPandas(sums, "i int, row array<double>")
    whole = parts.groupBy("i").agg(vector_to_array(Summarizer.sum(array_to_vector("row"))).alias("row")).orderBy("i").collect()  # d + 1 rows
    out = np.array([r["row"] for r in whole])
    return out[:d], float(out[d, 0])


def _new_directions(block: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """What a block adds to an orthonormal basis, orthonormal."""
    scale = np.linalg.norm(block) or 1.0
    for _ in range(2):  # once more, as the first time leaves rounding errors
        block = block - basis @ (basis.T @ block)
    left, size, _ = np.linalg.svd(block, full_matrices=False)
    left = left[:, size > 1e-10 * scale]
    left -= basis @ (basis.T @ left)
    return np.linalg.qr(left)[0] if left.shape[1] else left


def leading(rows: DataFrame, k: int, vector: str = "vec", tolerance: float = 1e-10, seed: int = 0) -> Components:
    """The first k principal components, as principal() gives them. Exact up to the tolerance: what is left of each, over the largest variance.

    Rows have no null vector and one length. Directions without variance are left out.
    """
    m = moments(rows, vector)
    d = len(m.mean)
    k = min(k, d)
    basis = np.linalg.qr(np.random.RandomState(seed).standard_normal((d, min(d, k + BEYOND))))[0]
    block, images = basis, np.empty((d, 0))
    for _ in range(PASSES):
        image, trace = _times(rows, vector, m.mean, block)
        image, trace = image / m.n, trace / m.n
        images = np.hstack([images, image])
        small = basis.T @ images
        values, turn = np.linalg.eigh((small + small.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        found = basis @ turn[:, :k]
        rest = np.linalg.norm(images @ turn[:, :k] - found * values[:k], axis=0)
        block = _new_directions(image, basis)
        if rest.max() <= tolerance * max(values[0], 1e-300) or not block.shape[1]:
            break
        if basis.shape[1] + block.shape[1] > BLOCKS * (k + BEYOND) and d > BLOCKS * (k + BEYOND):
            keep = turn[:, : k + BEYOND]
            basis, images = basis @ keep, images @ keep
            block = _new_directions(block, basis)
        basis = np.hstack([basis, block])
    else:
        raise RuntimeError(f"components aren't settled after {PASSES} passes")
    values = np.maximum(values[:k], 0)
    here = values > 1e-12 * max(values[0], 1e-300)
    components = np.linalg.qr(found[:, here])[0].T
    flip = np.sign(components[np.arange(len(components)), np.abs(components).argmax(1)])
    return Components(m.mean, components * flip[:, None], values[here] / max(trace, 1e-300))
