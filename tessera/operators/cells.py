"""Tensor search over cells: chunks are stored by their nearest centre, and a query reads few of the cells.

A cell knows its centre and its radius, the largest distance of a member.  By the triangle inequality they bound the best score that any
member can have, so that cells whose bound stays below the page's last score are left out and the page is exact.
Cells are partitions of a Parquet folder: those left out are not even listed as files to read.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import vectors as V
from tessera.operators import search as S

#: Metrics whose scores a cell bounds.
BOUNDED = ("euclidean", "angular", "dotproduct", "prenormalized-angular")
#: Cells of an index at most: what a query brings to the driver is a row for each.
MOST_CELLS = 4096
#: Rows that centres are fitted on; every row is stored.
FIT_ROWS = 100_000
#: Scores are doubles summed in other orders: bounds are wider by this.
SLACK = 1e-9
#: The schema of what measured() gives, and the cell_ of rows that every query reads.
CENTRES = "cell_ int, centre array<double>, radius double, rows long"
NOT_DEALT = -1


def _place(metric: str, vector: Column) -> Column:
    """Where a vector lies among the cells: angles don't depend on lengths."""
    return V.normalised(vector) if metric == "angular" else vector


def dealt(chunks: DataFrame, *, metric: str = "prenormalized-angular", cells: int = 256, fit_rows: int = FIT_ROWS, steps: int = 10, seed: int = 7) -> tuple[DataFrame, list[list[float]]]:
    """`chunks` (_id, field, chunk_idx, chunk, embedding) with cell_, and the centres by number.

    The centres are those of k-means over about `fit_rows` rows.  Rows without a vector are left out, since no search finds them.
    Fewer different vectors than cells make fewer cells; an empty table makes none.
    """
    if metric not in BOUNDED:
        raise ValueError(f"cells know the metrics {', '.join(BOUNDED)}")
    if not 1 <= cells <= MOST_CELLS:
        raise ValueError(f"1 to {MOST_CELLS} cells")
    rows = chunks.where(F.col("embedding").isNotNull()).withColumn("place_", _place(metric, V.doubles("embedding")))
    count = rows.count()
    if not count:
        return rows.drop("place_").withColumn("cell_", F.lit(0)), []
    few = F.pmod(F.xxhash64("_id", "field", "chunk_idx", F.lit(seed)), F.lit(1 << 30)) < int(fit_rows / count * (1 << 30))
    some = rows if count <= fit_rows else rows.where(few)
    model = KMeans(k=cells, maxIter=steps, seed=seed, featuresCol="v_", predictionCol="cell_").fit(some.select(array_to_vector("place_").alias("v_")))
    found = model.transform(rows.withColumn("v_", array_to_vector("place_"))).drop("v_", "place_")
    return found, [[float(x) for x in c] for c in model.clusterCenters()]


def measured(rows: DataFrame, centres: list[list[float]], metric: str) -> DataFrame:
    """(cell_, centre, radius, rows) of the cells that have rows."""
    spark = rows.sparkSession
    known = F.broadcast(spark.createDataFrame([*enumerate(centres)], "cell_ int, centre array<double>"))
    placed = rows.select("cell_", _place(metric, V.doubles("embedding")).alias("place_")).join(known, "cell_")
    far = placed.groupBy("cell_").agg(F.max(V.distance("euclidean", F.col("place_"), F.col("centre"))).alias("radius"), F.count("*").alias("rows"))
    return far.join(known, "cell_").select("cell_", "centre", "radius", "rows")


def write_cells(chunks: DataFrame, rows_path: str, centres_path: str, *, metric: str = "prenormalized-angular", **options) -> None:
    """Stores `chunks` by cell at `rows_path`, one partition for each, and then the cells at `centres_path`.

    A cell of many rows is written by several tasks.  Options: see dealt().
    """
    rows, centres = dealt(chunks, metric=metric, **options)
    # Ranges of (cell, document) are even however large a cell is, and a cell's rows stay in few files.
    rows.repartitionByRange("cell_", "_id").write.partitionBy("cell_").parquet(rows_path)
    stored = chunks.sparkSession.read.schema(rows.schema).parquet(rows_path)
    measured(stored, centres, metric).coalesce(1).write.parquet(centres_path)


@dataclass(frozen=True)
class Cells:
    """Chunks with cell_, and of each cell its number, centre and radius."""

    chunks: DataFrame
    metric: str
    cells: np.ndarray
    centres: np.ndarray
    radii: np.ndarray

    @staticmethod
    def of_rows(rows: DataFrame, known: DataFrame, metric: str) -> Cells:
        """From what dealt() and measured() give, or what write_cells() has stored, for the same metric."""
        found = known.orderBy("cell_").collect()  # MOST_CELLS rows at most
        return Cells(rows, metric, np.array([x["cell_"] for x in found], int), np.array([x["centre"] for x in found], float, ndmin=2)[: len(found)], np.array([x["radius"] for x in found], float))

    def bounds(self, query: Sequence[float]) -> np.ndarray:
        """The best score that a member of each cell can have."""
        q = np.array([float(x) for x in query])
        if self.metric == "angular" and np.linalg.norm(q) > 0:
            q = q / np.linalg.norm(q)
        if not len(self.cells):
            return np.zeros(0)
        far = np.linalg.norm(self.centres - q, axis=1)
        most = self.centres @ q + np.linalg.norm(q) * self.radii
        most += SLACK * (1 + np.linalg.norm(q) * (self.radii + np.linalg.norm(self.centres, axis=1)))
        if self.metric == "euclidean":
            best = 1 / (1 + np.maximum(far - self.radii - SLACK * (1 + far + self.radii), 0))
        elif self.metric == "angular":
            best = 1 / (1 + np.arccos(np.clip(most, -1, 1)))
        else:
            best = most if self.metric == "dotproduct" else np.where(most < 2, 1 / np.maximum(2 - most, SLACK), np.inf)
        return np.where(np.isnan(best), np.inf, best)  # nothing is known of a cell with a member that is no number

    def of(self, some: np.ndarray) -> DataFrame:
        """The chunks of some cells, by a filter on the folder's partitions, and those that are not dealt yet."""
        return self.chunks.where(F.col("cell_").isin(NOT_DEALT, *(int(x) for x in self.cells[some]))).drop("cell_")


def _last_score(chunks: DataFrame, query: Sequence[float], metric: str, fields: Sequence[str] | None, docs: DataFrame | None, where: Column | None, nth: int) -> float | None:
    """The score of the nth best document, or None if there are fewer: one number comes to the driver."""
    best = S.tensor_scores(chunks, query, metric=metric, fields=fields).groupBy("_id").agg(F.max("_score").alias("_score"))
    if where is not None:
        best = best.join(docs.where(where).select("_id"), "_id", "left_semi")
    found = best.orderBy(F.desc("_score")).limit(nth).agg(F.count("_score").alias("n"), F.min("_score").alias("last")).first()
    return found["last"] if found["n"] == nth else None


def needed(
    index: Cells, query: Sequence[float], *, docs: DataFrame | None = None, fields: Sequence[str] | None = None, where: Column | None = None, documents: int = 10, probes: int = 8, exact: bool = True
) -> np.ndarray:
    """Places in `index` of the cells to read for the best `documents`: the `probes` of the best bounds and, if `exact`, those that could still hold one."""
    bounds = index.bounds(query)
    order = np.argsort(-bounds, kind="stable")
    chosen = order[: max(1, probes)]
    if exact and len(chosen) < len(order):
        last = _last_score(index.of(chosen), query, index.metric, fields, docs, where, documents)
        chosen = order if last is None else order[(bounds[order] >= last - SLACK) | (np.arange(len(order)) < len(chosen))]
    return chosen


def cell_search(
    index: Cells, query: Sequence[float], *, docs: DataFrame | None = None, fields: Sequence[str] | None = None, where: Column | None = None, limit: int = 10, offset: int = 0,
    probes: int = 8, exact: bool = True,
) -> DataFrame:
    """As search.tensor_search, without modifiers: (_id, _score, _highlights[, fields of docs]) of one page.

    First the `probes` cells of the best bounds are read.  If `exact`, the score at the page's end then tells which other cells
    could still hold a row of the page, and those are read as well; otherwise the page is that of the probed cells, and
    may lack rows.  An angle with a zero vector is an error, as it is there.
    """
    S.check_page(limit, offset)
    if where is not None and docs is None:
        raise ValueError("a filter needs documents")
    if len(index.centres) and len(query) != index.centres.shape[1]:
        raise ValueError(f"the index has vectors of {index.centres.shape[1]} numbers, the query {len(query)}")
    some = needed(index, query, docs=docs, fields=fields, where=where, documents=limit + offset, probes=probes, exact=exact)
    return S.tensor_search(index.of(some), query, docs=docs, metric=index.metric, fields=fields, where=where, limit=limit, offset=offset)
