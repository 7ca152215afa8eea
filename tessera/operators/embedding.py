"""From documents to chunks with vectors, and from queries to vectors."""

from __future__ import annotations

import hashlib
from collections.abc import Mapping, Sequence
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.functions import vectors as V
from tessera.functions.interpolation import mean_vectors


class Embedder(Protocol):
    """What makes vectors of texts.  It is sent to tasks, where it gets batches."""

    dimensions: int

    def __call__(self, texts: Sequence[str]) -> np.ndarray: ...


class HashEmbedder:
    """A vector for each text that depends on the text alone: even random numbers from a hash of it.  For tests and for plans without a model."""

    def __init__(self, dimensions: int = 32):
        self.dimensions = dimensions

    def __call__(self, texts: Sequence[str]) -> np.ndarray:
        seeds = (int.from_bytes(hashlib.sha256(x.encode()).digest()[:8], "little") for x in texts)
        return np.stack([np.random.default_rng(x).uniform(-1, 1, self.dimensions) for x in seeds]) if len(texts) else np.zeros((0, self.dimensions))


class NoModel:
    """For an index whose vectors are all supplied."""

    def __init__(self, dimensions: int):
        self.dimensions = dimensions

    def __call__(self, texts: Sequence[str]) -> np.ndarray:
        raise ValueError("this index has no model: vectors must be supplied")


def chunked(docs: DataFrame, fields: Sequence[str], *, by: str = "sentence", length: int = 2, overlap: int = 0, keep: Sequence[str] = ()) -> DataFrame:
    """(_id, field, chunk_idx, chunk) of text fields, and the columns to `keep`; null fields have none."""
    each = [F.struct(F.lit(x).alias("field"), X.split_text(F.col(f"`{x}`"), by=by, length=length, overlap=overlap).alias("chunks")) for x in fields]
    rows = docs.select("_id", *keep, F.explode(F.array(*each)).alias("f"))
    return rows.select("_id", "f.field", *keep, F.posexplode("f.chunks").alias("chunk_idx", "chunk"))


def embedded(chunks: DataFrame, embedder: Embedder, *, prefix: str | None = None, normalise: bool = True) -> DataFrame:
    """`chunks` with embeddings where they have none (or no such column); each distinct text is embedded once."""
    if "embedding" not in chunks.columns:
        chunks = chunks.withColumn("embedding", F.lit(None).cast("array<float>"))
    texts = chunks.where(F.col("embedding").isNull() & F.col("chunk").isNotNull()).select("chunk").distinct()

    def run(frames):
        for frame in frames:
            if len(frame):
                v = np.asarray(embedder([(prefix or "") + x for x in frame["chunk"]]), float)
                if normalise:
                    size = np.linalg.norm(v, axis=1, keepdims=True)
                    v = np.divide(v, size, out=v, where=size > 0)
                yield pd.DataFrame({"chunk": frame["chunk"], "made": list(v.astype(np.float32))})

    made = texts.mapInPandas(run, "chunk string, made array<float>")
    return chunks.join(made, "chunk", "left").withColumn("embedding", F.coalesce("embedding", "made")).select(*chunks.columns)


def pooled(tokens: DataFrame, keys: Sequence[str], *, how: str = "mean", place: str = "place", vector: str = "embedding") -> DataFrame:
    """(keys, embedding) from vectors of tokens (keys, place, embedding[, mask]): the mean of those with a mask above 0, or `cls`, the first one's."""
    if how not in ("mean", "cls"):
        raise ValueError(f"unknown pooling {how!r}; mean or cls")
    if how == "cls":
        return tokens.groupBy(*keys).agg(F.min_by(vector, place).alias(vector))
    return mean_vectors(tokens.where(F.col("mask") > 0) if "mask" in tokens.columns else tokens, keys, vector=vector)


def combined(parts: DataFrame, weights: Mapping[str, float], *, name: str, normalise: bool = True) -> DataFrame:
    """(_id, field, chunk_idx, chunk, embedding) of a field that is put together of others.

    Of `parts` (_id, field, chunk, embedding) the mean of weight * vector over the fields that a document has; a
    part of several chunks counts by the mean of them.  The chunk is the parts as JSON.
    """
    rows = parts.where(F.col("field").isin(*weights))
    weight = F.element_at(F.create_map(*(y for k, w in weights.items() for y in (F.lit(k), F.lit(float(w))))), F.col("field"))
    whole = mean_vectors(rows, ["_id", "field"]).withColumn("weight", weight)
    text = rows.groupBy("_id").agg(F.to_json(F.map_from_entries(F.array_sort(F.array_distinct(F.collect_list(F.struct("field", "chunk")))))).alias("chunk")) if "chunk" in rows.columns else None
    made = mean_vectors(whole, ["_id"], weight="weight", normalise=normalise)
    out = made if text is None else made.join(text, "_id")
    return out.select("_id", F.lit(name).alias("field"), F.lit(0).alias("chunk_idx"), (F.lit(None).cast("string") if text is None else F.col("chunk")).alias("chunk"), "embedding")


def custom_vectors(docs: DataFrame, field: str, *, dimensions: int, normalise: bool = True) -> DataFrame:
    """Chunks of a field of (content, vector); a vector of another length, or of zeros where it has to be normalised, ends the job."""
    v = V.doubles(F.col(field)["vector"])
    bad = ~V.has_length(v, dimensions) | (V.norm(v) == 0 if normalise else F.lit(False))
    checked = F.when(bad, F.raise_error(F.concat(F.lit(f"{field} has a bad vector in document "), F.coalesce("_id", F.lit("null"))))).otherwise(V.normalised(v) if normalise else v)
    return docs.where(F.col(field).isNotNull()).select("_id", F.lit(field).alias("field"), F.lit(0).alias("chunk_idx"), F.coalesce(F.col(field)["content"], F.lit("")).alias("chunk"), checked.alias("embedding"))


def query_vector(parts: Sequence[tuple[Sequence[float], float]], *, dimensions: int, normalise: bool = True) -> list[float]:
    """The mean of weight * vector over all parts (texts, context and custom vectors), to length one if the index is normalised."""
    if not parts:
        raise ValueError("a query needs a text or a vector")
    if any(len(v) != dimensions for v, _ in parts):
        raise ValueError(f"every vector needs {dimensions} parts")
    mean = np.mean([float(w) * np.asarray(v, float) for v, w in parts], axis=0)
    size = np.linalg.norm(mean)
    return (mean / size if normalise and size > 0 else mean).tolist()


def embed_query(query: str | Mapping[str, float] | None, embedder: Embedder, *, context: Sequence[tuple[Sequence[float], float]] = (), prefix: str | None = None, normalise: bool = True) -> list[float]:
    """The vector of a text, of weighted texts, or of up to 64 weighted vectors beside them."""
    if len(context) > 64:
        raise ValueError("a context has at most 64 vectors")
    if isinstance(query, str) and context:
        raise ValueError("context goes with weighted texts, or with no text")
    texts = {query: 1.0} if isinstance(query, str) else dict(query or {})
    made = np.asarray(embedder([(prefix or "") + x for x in texts]), float) if texts else []
    if normalise:
        made = [v / (np.linalg.norm(v) or 1.0) for v in made]
    return query_vector([*zip(made, texts.values(), strict=True), *context], dimensions=embedder.dimensions, normalise=normalise)
