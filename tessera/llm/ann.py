"""Approximate nearest neighbours by a permutation index.

A vector is represented by its nearest pivots in order.  Vectors are dealt into blocks by a hash of
their id; a block's inverted file has for each pivot the vectors that name it and the place at which
they do.  A query reads the lists of its own pivots only and adds up what shared pivots take off the footrule
distance of the two orders (a pivot that only one names counts as named one place after
the last).  Of all vectors about `rerank` times the square root of their number, those that are nearest by
footrule, are ranked anew by exact distances: of each block its share.  The nearest of all blocks are the result.

A list has named / pivots of a block's vectors, so that a query touches named * named / pivots entries for each vector:
four with the given numbers, and the exact distances grow with the root of the table.  Every query goes to every block,
since blocks are no regions; a copy of one vector that is repeated a million times is in all of them.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.cutting import cut

#: Pivots, a bounded sample: of the distinct vectors those with the smallest hashes of their smallest ids; of small tables an eighth, but so many at least.
PIVOTS, LEAST_PIVOTS = 1024, 16
#: Pivots that a vector names.
NAMED = 64
#: Vectors that are ranked by exact distances, for each root of the table's size, and rows of a block at least.
RERANK, LEAST = 12.0, 32
#: Vectors of a block and queries of a group that meet in one task.
BLOCK_ROWS, QUERY_ROWS = 32_768, 4096


def usable(vectors: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """(vec_id, v) with v as doubles: one row for each id, all of the most frequent length, none null, zero, or with null or non-finite parts."""
    v = F.col(vector).cast("array<double>")
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), v.alias("v")).where("vec_id is not null and v is not null")
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.where(F.coalesce(fine, F.lit(False)) & F.exists("v", lambda x: x != 0))
    size = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.where(F.size("v") == (size["n"] if size else 0)).groupBy("vec_id").agg(F.min("v").alias("v"))


def orders(x: np.ndarray, pivots: np.ndarray, named: int) -> np.ndarray:
    """The numbers of each row's nearest pivots, nearest first, ties to smaller numbers."""
    far = (pivots**2).sum(axis=1)[None] - 2 * x @ pivots.T
    if named < far.shape[1]:
        # those not farther than the last named one, which may be more if there are ties
        last = np.partition(far, named - 1, axis=1)[:, named - 1 : named]
        far = np.where(far <= last, far, np.inf)
    return np.argsort(far, axis=1, kind="stable")[:, :named].astype(np.uint16)


def _named(pivots: np.ndarray, named: int):
    def run(frames):
        for frame in frames:
            if len(frame):
                x = np.stack(frame["v"].to_list())
                order = np.concatenate([orders(x[a : a + 1024], pivots, named) for a in range(0, len(x), 1024)])
                yield pd.DataFrame({"vec_id": frame["vec_id"], "v": [r.tobytes() for r in x], "order": [r.tobytes() for r in order]})

    return run


def inverted_file(named: np.ndarray, pivots: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each pivot its list: bounds (pivots + 1), and rows and places of all lists in one."""
    flat = named.ravel()
    order = np.argsort(flat, kind="stable")
    bounds = np.searchsorted(flat[order], np.arange(pivots + 1))
    return bounds, order // named.shape[1], (order % named.shape[1]).astype(np.int32)


def _searched(pivots: int, k: int, part: float, least: int):
    def run(block: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"query_id": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})
        if not len(block) or not len(queries):
            return empty
        block = block.sort_values("vec_id", kind="stable")
        # Equal vectors are one entry of the lists; of their ids only the k + 1 smallest can be a result.
        entry = pd.factorize(block["v"])[0]
        block = block[block.groupby(entry).cumcount().to_numpy() <= k]
        entry, heads = pd.factorize(block["v"])
        first = np.unique(entry, return_index=True)[1]
        ids = block["vec_id"].to_numpy()
        order = np.argsort(entry, kind="stable")
        members, at = ids[order], np.searchsorted(entry[order], np.arange(len(heads) + 1))
        x = np.frombuffer(b"".join(heads), np.float64).reshape(len(heads), -1)
        named = np.frombuffer(b"".join(block["order"].iloc[first]), np.uint16).reshape(len(heads), -1)
        bounds, rows, places = inverted_file(named, pivots)
        width, take = named.shape[1], min(len(heads), max(least, int(np.ceil(len(heads) * part))))
        out = []
        for query, v, order in zip(queries["vec_id"].tolist(), queries["v"], queries["order"], strict=True):
            saved = np.zeros(len(heads), np.int32)
            for place, pivot in enumerate(np.frombuffer(order, np.uint16).tolist()):
                a, b = bounds[pivot], bounds[pivot + 1]
                saved[rows[a:b]] += width - np.maximum(places[a:b], place)
            chosen = np.argpartition(-saved, take - 1)[:take] if take < len(heads) else np.arange(len(heads))
            far = np.sqrt(((x[chosen] - np.frombuffer(v, np.float64)) ** 2).sum(axis=1))
            near = chosen[far <= np.partition(far, min(k, len(far) - 1))[min(k, len(far) - 1)]]
            counts = at[near + 1] - at[near]
            flat = np.repeat(at[near] - (np.cumsum(counts) - counts), counts) + np.arange(int(counts.sum()))
            found, score = members[flat], np.repeat(np.sqrt(((x[near] - np.frombuffer(v, np.float64)) ** 2).sum(axis=1)), counts)
            found, score = found[found != query], score[found != query]
            best = np.lexsort((found, score))[:k]
            out.append(pd.DataFrame({"query_id": query, "vec_id": found[best], "score": score[best]}))
        return pd.concat(out, ignore_index=True) if out else empty

    return run


def nearest(
    vectors: DataFrame, *, k: int = 10, vec_id: str = "vec_id", vector: str = "embedding", every: int = 100, pivots: int = PIVOTS, named: int = NAMED, rerank: float = RERANK, least: int = LEAST, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """(query_id, rank, vec_id, score): for each vector whose id is divisible by `every` its k nearest found among the others.

    Score is the Euclidean distance in double precision; ties go to the smaller id.  Vectors that are
    null, zero, or have null or non-finite parts take no part, nor do those of another
    length than most, or without an id; of rows that share an id the smallest vector is taken.  Fewer
    candidates than k are all returned; an empty table gives an empty result.  Other columns are ignored.
    """
    schema = "query_id long, rank int, vec_id long, score double"
    known = cut(usable(vectors, vec_id, vector))
    count = known.count()
    wanted = min(pivots, max(LEAST_PIVOTS, count // 8))
    sample = known.groupBy("v").agg(F.min("vec_id").alias("vec_id")).orderBy(F.xxhash64("vec_id", F.lit(3)), "vec_id").limit(wanted).collect()
    if not sample:
        return vectors.sparkSession.createDataFrame([], schema)
    centres = np.array([x["v"] for x in sample])
    index = known.mapInPandas(_named(centres, min(named, len(centres))), "vec_id long, v binary, order binary")
    index = cut(index)
    queries = index.where(F.col("vec_id") % every == 0)
    blocks, groups = -(-count // block_rows), -(-queries.count() // QUERY_ROWS)
    if not groups:
        return vectors.sparkSession.createDataFrame([], schema)
    block = F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).alias("block")
    group = F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(groups)).alias("group")
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    left = index.select("vec_id", "v", "order", block, each(groups).alias("group"))
    right = queries.select("vec_id", "v", "order", each(blocks).alias("block"), group)
    found = left.groupBy("block", "group").cogroup(right.groupBy("block", "group")).applyInPandas(_searched(len(centres), k, min(1.0, rerank / count**0.5), least), "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
