"""Approximate tensor search by random projections, for vectors of length one."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import BucketedRandomProjectionLSH, BucketedRandomProjectionLSHModel
from pyspark.ml.functions import array_to_vector
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import vectors as V
from tessera.operators.search import check_page, nearest_documents, page


def projections(chunks: DataFrame, *, width: float = 0.5, tables: int = 8, seed: int = 7) -> tuple[BucketedRandomProjectionLSHModel, DataFrame]:
    """A model of random projections and the chunks with their buckets: to be written once and searched often."""
    rows = chunks.where(F.col("embedding").isNotNull()).withColumn("v_", array_to_vector(V.doubles("embedding")))
    model = BucketedRandomProjectionLSH(inputCol="v_", outputCol="buckets_", bucketLength=width, numHashTables=tables, seed=seed).fit(rows)
    return model, model.transform(rows)


def approximate_search(model: BucketedRandomProjectionLSHModel, index: DataFrame, query: Sequence[float], *, metric: str = "prenormalized-angular", limit: int = 10, offset: int = 0, explored: int = 200) -> DataFrame:
    """(_id, _score, _highlights) of one page of the `explored` chunks whose buckets are nearest to the query's, ranked by exact scores.

    For vectors of length one the order by Euclidean distance, which the buckets keep, is that by angle.
    """
    check_page(limit, offset)
    near = model.approxNearestNeighbors(index, Vectors.dense(list(query)), max(explored, limit + offset))
    scored = near.select("_id", "field", V.closeness(metric, V.doubles("embedding"), V.literal(query)).alias("_score"), "chunk")
    return page(nearest_documents(scored), limit, offset)
