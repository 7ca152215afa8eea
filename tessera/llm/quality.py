"""A quality classifier: kernel ridge regression by random Fourier features over document statistics.

Statistics of whole texts (nothing else is an input) are standardised and mapped to cosines of random
projections, whose inner products approximate a Gaussian kernel.  Tasks sum the
normal equations of their labelled rows; the sums are of fixed size, and the driver solves them.
Each of two folds is scored by the model of the other one, and these scores give the isotonic
curve from raw scores to probabilities.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.calibration import FIT_ROWS, bounded, calibrated
from tessera.llm.cutting import cut
from tessera.llm.words import column_bytes, slices, word_hashes, word_spans

STATISTICS = (
    "log words", "log bytes", "word length", "word length spread", "long words", "upper", "lower", "digits", "stops", "marks", "beyond ascii", "blank",
    "distinct words", "words as before", "distinct pairs", "log lines", "distinct lines", "lone marks", "words ending in marks", "most frequent word",
)
#: Random features, the width of the kernel in standard deviations, the ridge for each row, the seed.
FEATURES, WIDTH, RIDGE, SEED = 256, 3.0, 1e-3, 20_240_501

_KIND = np.zeros(256, np.int64)  # 0 other ASCII marks
_KIND[ord("A") : ord("Z") + 1] = 1
_KIND[ord("a") : ord("z") + 1] = 2
_KIND[ord("0") : ord("9") + 1] = 3
_KIND[[ord(x) for x in ".,;:!?'\"()-"]] = 4
_KIND[128:] = 5
_KIND[[*range(33)]] = 6


def _share(hit: np.ndarray, owner: np.ndarray, rows: int, of: np.ndarray) -> np.ndarray:
    return np.bincount(owner, hit, rows) / np.maximum(of, 1)


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of STATISTICS for each document; all 0 for one without words."""
    out = np.zeros((len(offsets) - 1, len(STATISTICS)))
    for a, b in slices(offsets):
        part, bounds, rows = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], b - a
        starts, ends, first = word_spans(part, bounds)
        if not len(starts):
            continue
        hashes = word_hashes(part, starts, ends, lower=True)
        size = np.diff(bounds)
        words = np.diff(first)
        owner = np.repeat(np.arange(rows), words)
        kind = _KIND[part]
        byte_owner = np.repeat(np.arange(rows), size)
        kinds = np.bincount(byte_owner * 7 + kind, minlength=rows * 7).reshape(rows, 7) / np.maximum(size, 1)[:, None]
        length = (ends - starts).astype(float)
        mean = np.bincount(owner, length, rows) / np.maximum(words, 1)
        spread = np.sqrt(np.maximum(np.bincount(owner, length**2, rows) / np.maximum(words, 1) - mean**2, 0))
        order = np.lexsort((hashes, owner))
        h, o = hashes[order], owner[order]
        new = np.concatenate(([True], (h[1:] != h[:-1]) | (o[1:] != o[:-1])))
        runs = np.diff(np.append(np.flatnonzero(new), len(h)))
        often = np.zeros(rows)
        np.maximum.at(often, o[new], runs)
        again = np.concatenate(([False], (hashes[1:] == hashes[:-1]) & (owner[1:] == owner[:-1])))
        pairs = hashes[:-1] * np.uint64(0x9E3779B97F4A7C15) + hashes[1:]
        inner = owner[1:] == owner[:-1]
        pairs, pair_owner = pairs[inner], owner[1:][inner]
        order = np.lexsort((pairs, pair_owner))
        p, q = pairs[order], pair_owner[order]
        new_pair = np.concatenate(([True], (p[1:] != p[:-1]) | (q[1:] != q[:-1]))) if len(p) else np.zeros(0, bool)
        # Lines: a sum of their bytes' codes by place tells them apart.
        breaks = np.flatnonzero(part == 10)
        line_at = np.unique(np.concatenate((bounds[:-1][size > 0], breaks + 1)))
        line_at = line_at[line_at < len(part)]
        weight = (part.astype(np.uint64) + np.uint64(1)) * ((np.arange(len(part)) - np.repeat(line_at, np.diff(np.append(line_at, len(part))))).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1))
        lines = np.add.reduceat(weight, line_at)
        line_owner = np.searchsorted(bounds, line_at, "right") - 1
        order = np.lexsort((lines, line_owner))
        x, y = lines[order], line_owner[order]
        new_line = np.concatenate(([True], (x[1:] != x[:-1]) | (y[1:] != y[:-1])))
        line_count = np.bincount(line_owner, minlength=rows)
        tail = kind[ends - 1]
        block = out[a:b]
        block[:, 0], block[:, 1] = np.log1p(words), np.log1p(size)
        block[:, 2], block[:, 3] = mean, spread
        block[:, 4] = _share(length > 20, owner, rows, words)
        block[:, 5:12] = kinds[:, [1, 2, 3, 4, 0, 5, 6]]
        block[:, 12] = np.bincount(o[new], minlength=rows) / np.maximum(words, 1)
        block[:, 13] = _share(again, owner, rows, words)
        block[:, 14] = np.bincount(q[new_pair], minlength=rows) / np.maximum(words - 1, 1)
        block[:, 15] = np.log1p(line_count)
        block[:, 16] = np.bincount(y[new_line], minlength=rows) / np.maximum(line_count, 1)
        block[:, 17] = _share((length <= 2) & ((tail == 0) | (tail == 4)), owner, rows, words)
        block[:, 18] = _share((tail == 0) | (part[ends - 1] == ord("!")), owner, rows, words)
        block[:, 19] = often / np.maximum(words, 1)
        block[words == 0] = 0
    return out


def _measured(batches):
    for batch in batches:
        x = statistics(*column_bytes(batch.column(1)))
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel()))
        yield pa.RecordBatch.from_arrays([batch.column(0), lists], ["doc_id", "x"])


def document_statistics(docs: DataFrame) -> DataFrame:
    """(doc_id, x): STATISTICS of each row of `docs` (doc_id, text, ...)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(_measured, "doc_id long, x array<double>")


class Fourier:
    """Standardised statistics to random Fourier features."""

    def __init__(self, mean: np.ndarray, deviation: np.ndarray, features: int, width: float, seed: int):
        draw = np.random.default_rng(seed)
        self.mean, self.deviation = mean, np.where(deviation > 1e-9, deviation, 1.0)
        self.turns = draw.normal(0, 1 / width, (len(mean), features))
        self.phase = draw.uniform(0, 2 * np.pi, features)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.deviation, -5, 5)
        waves = np.cos(z @ self.turns + self.phase) * np.sqrt(2 / len(self.phase))
        return np.hstack((waves, np.ones((len(x), 1))))


def _summed(fourier: Fourier):
    def run(frames):
        size = len(fourier.phase) + 2
        sums, some_rows = np.zeros((2, size, size)), False
        for frame in frames:
            if len(frame):
                some_rows = True
                rows = np.hstack((fourier(np.stack(frame["x"].to_list())), frame[["label"]].to_numpy(float)))
                for fold in (0, 1):
                    some = rows[frame["fold"].to_numpy() == fold]
                    sums[fold] += some.T @ some
        if some_rows:
            yield pd.DataFrame({"fold": np.repeat([0, 1], size), "row": np.tile(np.arange(size), 2), "sums": list(sums.reshape(2 * size, size))})

    return run


def _added(rows: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"fold": rows["fold"].iloc[:1], "row": rows["row"].iloc[:1], "sums": [np.sum(rows["sums"].to_list(), axis=0)]})


def _solved(sums: np.ndarray, ridge: float) -> np.ndarray:
    """The ridge weights from the summed products of features, intercept and label; the intercept is free."""
    left, right, n = sums[:-1, :-1], sums[:-1, -1], sums[-2, -2]
    penalty = np.eye(len(left)) * (ridge * n + 1e-6)
    penalty[-1, -1] = 1e-9
    return np.linalg.solve(left + penalty, right)


def _raw(fourier: Fourier, weights: np.ndarray):
    """Raw scores; weights[fold] for a row's fold."""

    def run(frames):
        for frame in frames:
            if len(frame):
                fold = frame["fold"].to_numpy()
                yield pd.DataFrame({"raw": np.einsum("ij,ij->i", fourier(np.stack(frame["x"].to_list())), weights[fold]), "label": frame["label"]})

    return run


class Model:
    """Fitted scores: features, weights and the calibration curve; without a fit every score is one half."""

    def __init__(self, fourier: Fourier | None = None, weights: np.ndarray | None = None, knots: np.ndarray | None = None, values: np.ndarray | None = None):
        self.fourier, self.weights, self.knots, self.values = fourier, weights, knots, values

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return np.full(len(x), 0.5) if self.fourier is None else np.interp(self.fourier(x) @ self.weights, self.knots, self.values)


def _final(model: Model):
    def run(frames):
        for frame in frames:
            if len(frame):
                yield pd.DataFrame({"doc_id": frame["doc_id"].astype("Int64"), "score": model(np.stack(frame["x"].to_list()))})

    return run


def fit(measured: DataFrame, labels: DataFrame, *, label: str = "quality", features: int = FEATURES, width: float = WIDTH, ridge: float = RIDGE, seed: int = SEED, fit_rows: int = FIT_ROWS) -> Model:
    """The model of the labels (doc_id, label) over document_statistics()."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("double").alias("label")).where("doc_id is not null and label is not null")
    fold = F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(2)).cast("int")
    fitted = cut(bounded(measured.join(known, "doc_id"), fit_rows).select("x", "label", fold.alias("fold")))
    size = len(STATISTICS)
    moments = fitted.select(*(F.avg(F.get("x", F.lit(k))).alias(f"m{k}") for k in range(size)), *(F.stddev_pop(F.get("x", F.lit(k))).alias(f"d{k}") for k in range(size))).first()
    if moments[0] is None:
        return Model()
    fourier = Fourier(np.array(moments[:size]), np.array(moments[size:]), features, width, seed)
    summed = fitted.mapInPandas(_summed(fourier), "fold int, row int, sums array<double>").groupBy("fold", "row").applyInPandas(_added, "fold int, row int, sums array<double>")
    whole = np.zeros((2, features + 2, features + 2))
    for part in summed.collect():  # features + 2 rows for each fold, whatever the input
        whole[part["fold"], part["row"]] = part["sums"]
    one = [_solved(x, ridge) for x in (whole[1], whole[0])]  # a fold's rows are scored by the other fold's model
    knots, values = calibrated(fitted.mapInPandas(_raw(fourier, np.stack(one)), "raw double, label double"), -1.0, 2.0)
    return Model(fourier, _solved(whole.sum(axis=0), ridge), knots, values)


def quality_scores(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """(doc_id, score) for each row of `docs` (doc_id, text, ...): the probability of label 1.

    `labels` has (doc_id, label); rows with nulls are left out, and of more than about `fit_rows` labelled
    documents those with the smallest hashes of doc_id are taken.  Null and empty texts have
    statistics of 0 and get the score of that point.  Without any label all scores are 0.5.  Rows
    may repeat and doc_id may be null; other columns are ignored.  Options: see fit().
    """
    measured = cut(document_statistics(docs))
    return measured.mapInPandas(_final(fit(measured, labels, **options)), "doc_id long, score double")


def _good(model: Model, least: float):
    def run(batches):
        for batch in batches:
            scores = model(statistics(*column_bytes(batch.column(batch.schema.get_field_index("text")))))
            yield batch.filter(pa.array(scores >= least))

    return run


def keep_good(docs: DataFrame, labels: DataFrame, least: float = 0.5, **options) -> DataFrame:
    """The rows of `docs`, all columns as they were, that score `least` or more.  No text is shuffled."""
    return docs.mapInArrow(_good(fit(cut(document_statistics(docs)), labels, **options), least), docs.schema)
