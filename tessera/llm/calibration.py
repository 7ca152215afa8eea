"""Isotonic calibration of scores from counts by bin, and the split of labelled rows."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bins of raw scores: what reaches the driver is at most one row for each.
BINS = 4096
#: Labelled rows that a model is fitted on; of more, those with the smallest hashes of doc_id.
FIT_ROWS = 200_000


def id_remainder(doc_id: Column, of: int) -> Column:
    """crc32(doc_id as text) mod `of`."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(of))


def bounded(labelled: DataFrame, rows: int = FIT_ROWS) -> DataFrame:
    """`labelled` (doc_id, ...), or about `rows` of it if it has more."""
    count = labelled.count()
    if count <= rows:
        return labelled
    return labelled.where(F.pmod(F.xxhash64("doc_id", F.lit(77)), F.lit(1 << 30)) < int(rows / count * (1 << 30)))


def isotonic(x: np.ndarray, ones: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of a rising curve of the share of ones, by pooling adjacent violators; shares are drawn half a row to the middle."""
    pools: list[list[float]] = []
    for at, one, n in zip(x.tolist(), ones.tolist(), rows.tolist(), strict=True):
        pools.append([at, at, one, n])
        while len(pools) > 1 and pools[-2][2] * pools[-1][3] >= pools[-1][2] * pools[-2][3]:
            _, hi, one, n = pools.pop()
            pools[-1] = [pools[-1][0], hi, pools[-1][2] + one, pools[-1][3] + n]
    knots, values = [], []
    for lo, hi, one, n in pools:
        share = (one + 0.5) / (n + 1)
        knots += [lo, hi] if hi > lo else [lo]
        values += [share] * (2 if hi > lo else 1)
    return np.array(knots), np.maximum.accumulate(np.array(values)) if values else np.array(values)


def calibrated(scored: DataFrame, low: float, high: float, bins: int = BINS) -> tuple[np.ndarray, np.ndarray]:
    """The isotonic curve of `scored` (raw, label) over bins of raw from `low` to `high`; without rows the curve is one half."""
    place = F.least(F.greatest(F.floor((F.col("raw") - low) / (high - low) * bins), F.lit(0)), F.lit(bins - 1))
    counts = scored.groupBy(place.alias("bin")).agg(F.sum("label").alias("ones"), F.count("*").alias("rows")).orderBy("bin").toPandas()
    if not len(counts):
        return np.array([low]), np.array([0.5])
    return isotonic(low + (counts["bin"].to_numpy(float) + 0.5) * (high - low) / bins, counts["ones"].to_numpy(float), counts["rows"].to_numpy(float))
