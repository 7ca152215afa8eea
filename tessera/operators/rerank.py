"""Ranking a page anew by its chunks."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.operators.embedding import chunked
from tessera.operators.lexical import words_of

#: From a batch of chunks to their scores.
Scorer = Callable[[Sequence[str]], Sequence[float]]


def overlap_score(query: str):
    """Share of the query's words that a chunk has, as a Column of `chunk`."""
    words = sorted(set(words_of(query)))
    return F.size(F.array_intersect(X.tokens(F.col("chunk")), F.array(*map(F.lit, words)))) / F.lit(float(max(1, len(words))))


def scored_by(chunks: DataFrame, scorer: Scorer) -> DataFrame:
    """`chunks` with the scores of a model that runs in tasks, batch by batch."""

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(scorer(texts.tolist()), dtype="float64")

    return chunks.withColumn("score", score("chunk"))


def rerank(hits: DataFrame, fields: Sequence[str], *, query: str | None = None, scorer: Scorer | None = None, highlights: int = 1) -> DataFrame:
    """`hits` (_id, _score, fields) by their best chunk's score.

    Adds _rerank_score in place of _score, both blends with the old score, and the best `highlights` chunks. Chunks are
    two sentences; hits without any of the fields leave; if none has one, or `fields` is empty, that is an error.
    """
    fields = [x for x in fields if x in hits.columns]
    if not fields:
        raise ValueError("reranking needs a field that the hits have")
    kept = [x for x in hits.columns if x != "_highlights"]
    whole = F.struct(*(F.col(f"`{x}`") for x in kept)).alias("hit_")  # goes along with its chunks, so that the hits are found once
    chunks = chunked(hits.select("_id", *(F.col(f"`{x}`") for x in fields if x != "_id"), whole), fields, keep=("hit_",)).where(F.trim("chunk") != "")
    chunks = scored_by(chunks, scorer) if scorer else chunks.withColumn("score", overlap_score(query or "").cast("double"))
    place = F.row_number().over(Window.partitionBy("_id").orderBy(F.desc("score"), "field", "chunk_idx"))
    best = chunks.withColumn("place", place).where(F.col("place") <= highlights)
    best = best.groupBy("_id").agg(F.max("score").alias("new_"), F.array_sort(F.collect_list(F.struct("place", "field", "chunk"))).alias("best_"), F.first("hit_").alias("hit_"))
    joined = best.select("hit_.*", "new_", "best_")
    return joined.select(
        *(x for x in joined.columns if x not in ("_score", "new_", "best_")), F.col("new_").alias("_score"), (F.col("new_") * F.col("_score")).alias("_multiplied"), (F.col("new_") + F.col("_score")).alias("_added"),
        F.transform("best_", lambda x: F.create_map(x["field"], x["chunk"])).alias("_highlights"),
    ).orderBy(F.desc("_score"), "_id")
