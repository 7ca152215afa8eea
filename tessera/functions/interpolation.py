"""Interpolation of a few vectors: linear, normalised and spherical."""

from __future__ import annotations

from collections.abc import Sequence
from functools import partial

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import vectors as V

METHODS = ("lerp", "nlerp", "slerp", "slerp-sequential")


def _checked(vectors: Sequence[Sequence[float]], weights: Sequence[float]) -> tuple[np.ndarray, np.ndarray]:
    if not len(vectors) or len(vectors) != len(weights):
        raise ValueError("as many weights as vectors are needed, and at least one")
    if len({len(v) for v in vectors}) != 1:
        raise ValueError("the vectors differ in length")
    return np.asarray(vectors, float), np.asarray(weights, float)


def lerp(vectors: Sequence[Sequence[float]], weights: Sequence[float]) -> np.ndarray:
    """The weighted mean."""
    v, w = _checked(vectors, weights)
    if w.sum() == 0:
        raise ValueError("the weights add up to zero")
    return (w / w.sum()) @ v


def nlerp(vectors: Sequence[Sequence[float]], weights: Sequence[float]) -> np.ndarray:
    """The weighted mean, to length one."""
    v = lerp(vectors, weights)
    size = np.linalg.norm(v)
    if size == 0:
        raise ValueError("the mean has no length")
    return v / size


def slerp_pair(a: np.ndarray, b: np.ndarray, t: float) -> np.ndarray:
    """The point at share t of the arc from a to b; of vectors on one line, of the line between them."""
    sizes = np.linalg.norm(a) * np.linalg.norm(b)
    if sizes == 0:
        raise ValueError("a vector has no length")
    angle = np.arccos(np.clip(a @ b / sizes, -1, 1))
    if np.sin(angle) < 1e-9:
        return (1 - t) * a + t * b
    return (np.sin((1 - t) * angle) * a + np.sin(t * angle) * b) / np.sin(angle)


def slerp(vectors: Sequence[Sequence[float]], weights: Sequence[float], *, sequential: bool = False) -> np.ndarray:
    """Neighbours meet pairwise, round by round, an odd one waits; a meeting carries half of both weights.  Or one after the other."""
    v, w = _checked(vectors, weights)
    level = list(zip(v, w.tolist(), strict=True))

    def meet(left, right):
        (a, p), (b, q) = left, right
        if p + q == 0:
            raise ValueError("two weights add up to zero")
        return slerp_pair(a, b, q / (p + q)), (p + q) / 2

    if sequential:
        point, sum_ = level[0]
        for b, q in level[1:]:
            if sum_ + q == 0:
                raise ValueError("two weights add up to zero")
            point, sum_ = slerp_pair(point, b, q / (sum_ + q)), sum_ + q
        return point
    while len(level) > 1:
        paired = [meet(*level[k : k + 2]) for k in range(0, len(level) - 1, 2)]
        level = paired + level[len(level) // 2 * 2 :]
    return level[0][0]


def interpolate(method: str, vectors: Sequence[Sequence[float]], weights: Sequence[float]) -> np.ndarray:
    if method not in METHODS:
        raise ValueError(f"unknown method {method!r}; one of {', '.join(METHODS)}")
    return {"lerp": lerp, "nlerp": nlerp, "slerp": slerp, "slerp-sequential": partial(slerp, sequential=True)}[method](vectors, weights)


def mean_vectors(rows: DataFrame, keys: Sequence[str], *, vector: str = "embedding", weight: str | None = None, by: str = "count", normalise: bool = False) -> DataFrame:
    """(keys, vector): for each group sum(weight * v) / n, with n the number of rows (`by` count) or the sum of weights (`by` weight).

    Sums are taken part by part of the vectors, combined before the shuffle, so that a group may be of any size.
    """
    if by not in ("count", "weight"):
        raise ValueError("by is count or weight")
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    parts = rows.where(F.col(vector).isNotNull()).select(*keys, w.alias("w_"), F.posexplode(V.doubles(vector)).alias("p_", "x_"))
    sums = parts.groupBy(*keys, "p_").agg((F.sum(F.col("w_") * F.col("x_")) / (F.count("*") if by == "count" else F.sum("w_"))).alias("y_"))
    joined = sums.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("p_", "y_"))).alias("all_"))
    v = F.transform("all_", lambda x: x["y_"])
    return joined.select(*keys, (V.normalised(v) if normalise else v).alias(vector))
