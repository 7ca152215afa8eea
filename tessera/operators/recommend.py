"""Recommendation: search by what lies between the vectors of given documents."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.interpolation import interpolate
from tessera.functions.scoring import ScoreModifiers
from tessera.operators.search import tensor_search

#: Vectors that one recommendation is made of, at most: they come to the driver, where their order counts.
MOST_VECTORS = 10_000


def given_weights(documents: Sequence[str] | Mapping[str, float]) -> dict[str, float]:
    weights = {x: float(w) for x, w in documents.items()} if isinstance(documents, Mapping) else {x: 1.0 for x in documents}
    if not weights:
        raise ValueError("at least one document is needed")
    if not any(weights.values()):
        raise ValueError("all weights are zero")
    return weights


def interest(chunks: DataFrame, documents: Sequence[str] | Mapping[str, float], *, fields: Sequence[str] | None = None, method: str | None = None, normalised: bool = True) -> np.ndarray:
    """The vector that stands for the documents: slerp on an index of normalised vectors, else lerp, if no method is named."""
    weights = given_weights(documents)
    used = [x for x, w in weights.items() if w]
    mine = chunks.where(F.col("_id").isin(*weights))
    known = {r[0] for r in mine.select("_id").distinct().collect()}
    if absent := [x for x in weights if x not in known]:
        raise ValueError(f"no such documents: {', '.join(absent)}")
    if fields is not None:
        mine = mine.where(F.col("field").isin(*fields))
    rows = mine.where(F.col("_id").isin(*used) & F.col("embedding").isNotNull()).select("_id", "field", "chunk_idx", "embedding").limit(MOST_VECTORS + 1).collect()
    if len(rows) > MOST_VECTORS:
        raise ValueError(f"more than {MOST_VECTORS} vectors")
    if bare := set(used) - {x["_id"] for x in rows}:
        raise ValueError(f"documents without vectors: {', '.join(sorted(bare))}")
    rows.sort(key=lambda x: (used.index(x["_id"]), x["field"], x["chunk_idx"]))
    point = interpolate(method or ("slerp" if normalised else "lerp"), [x["embedding"] for x in rows], [weights[x["_id"]] for x in rows])
    size = np.linalg.norm(point)
    return point / size if normalised and size > 0 else point


def recommend(
    chunks: DataFrame, documents: Sequence[str] | Mapping[str, float], *, docs: DataFrame | None = None, fields: Sequence[str] | None = None, method: str | None = None, normalised: bool = True, exclude: bool = True,
    where: Column | None = None, metric: str = "prenormalized-angular", modifiers: ScoreModifiers | None = None, limit: int = 10, offset: int = 0,
) -> DataFrame:
    """The page of a tensor search by interest(); the given documents, also those of weight zero, are left out if `exclude`."""
    query = interest(chunks, documents, fields=fields, method=method, normalised=normalised)
    rest = chunks.where(~F.col("_id").isin(*given_weights(documents))) if exclude else chunks
    return tensor_search(rest, query.tolist(), docs=docs, metric=metric, fields=fields, where=where, modifiers=modifiers, limit=limit, offset=offset)
