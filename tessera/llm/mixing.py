"""Mixing sources to target weights by entropy balancing.

The rate r of each document, between 0 and `most` copies, is the one of largest entropy relative to
an even rate under a token constraint for each source: sum(size * r) = target.  The convex dual has
one multiplier for each source, and its solution tilts the rates exponentially,
r = most * e^z / (1 + e^z) with z = multiplier * size / mean size.  Newton steps, kept inside
brackets, solve all sources' duals at once over counts by (source, size); the counts
don't grow with copies of documents and no multiplier leaves the executors.  The rates become whole
copies by carrying the rounding error from size to size within a source, largest sizes first,
so that a source misses its target by about half of its smallest documents.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.cutting import cut

WEIGHTS = (3.0, 1.0, 2.0)
#: Documents of one (source, size) that are ranked in one task.
RANKED_ROWS = 1024
#: Newton steps at most, and the relative miss of a target at which they end.
STEPS, NEAR = 60, 1e-9


def word_count(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(totals: DataFrame, *, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, source_size, target) from (source, source_size), one row each.

    The sources, by code point with null last, weigh `weights` in turn and share `share` times all sizes;
    a target stops at `most` times its source's size and the excess is shared again by weight.
    What each source gets for a unit of weight is the one level at which the stopped targets
    and the others add up; it is found from sums over sources in the order in which they stop.
    """
    order = Window.orderBy(F.col("source").isNull(), F.encode("source", "UTF-8"))
    turn = (F.row_number().over(order) - 1) % len(weights)
    weight = F.element_at(F.array(*map(F.lit, map(float, weights))), (turn + 1).cast("int"))
    limit = most * F.col("source_size")
    stops = Window.orderBy("stop", F.col("source").isNull(), F.encode("source", "UTF-8"))
    whole = Window.partitionBy()
    sized = totals.withColumn("weight", weight).withColumn("limit", limit.cast("double")).withColumn("stop", F.col("limit") / F.col("weight"))
    before = stops.rowsBetween(Window.unboundedPreceding, -1)
    sized = sized.withColumn("left", share * F.sum("source_size").over(whole) - F.coalesce(F.sum("limit").over(before), F.lit(0.0)))
    sized = sized.withColumn("level", F.col("left") / (F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
    level = F.max(F.when(F.col("level") < F.col("stop"), F.col("level"))).over(whole)
    return sized.withColumn("at", level).select("source", "source_size", F.least("limit", F.coalesce(F.col("at") * F.col("weight"), F.col("limit"))).alias("target"))


def _rate(most: float) -> Column:
    return F.lit(most) / (1 + F.exp(-F.col("tilt") * F.col("size") / F.col("mean")))


def balanced_rates(counts: DataFrame, targets: DataFrame, *, most: float = 2.0) -> DataFrame:
    """(source, size, docs, target, rate): the tilted rate of documents by source and size, from (source, size, docs) and source_targets().

    A source whose target is all that it can give has the rate `most`, one without target 0.
    """
    base = counts.where("size > 0").join(targets.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    base = cut(base)
    dual = base.groupBy("source").agg((F.sum(F.col("size") * F.col("docs")) / F.sum("docs")).alias("mean"), F.first("target").alias("target"), F.first("source_size").alias("source_size"))
    dual = cut(dual.withColumn("tilt", F.lit(0.0)).withColumn("low", F.lit(-60.0)).withColumn("high", F.lit(60.0)).withColumn("miss", F.lit(1.0)))
    inside = (F.col("target") > 0) & (F.col("target") < most * F.col("source_size"))
    for _ in range(STEPS):
        tilted = base.join(dual.select(F.col("source").alias("s"), "mean", "tilt"), F.col("source").eqNullSafe(F.col("s")))
        r = _rate(most)
        words = F.col("size") * F.col("docs")
        sums = tilted.groupBy(F.col("source").alias("s")).agg(F.sum(words * r).alias("got"), F.sum(words * r * (1 - r / most) * F.col("size") / F.col("mean")).alias("slope"))
        step = dual.join(sums, F.col("source").eqNullSafe(F.col("s"))).drop("s").withColumn("miss", F.when(inside, F.abs(F.col("got") / F.col("target") - 1)).otherwise(0.0))
        step = step.withColumn("low", F.when(F.col("got") < F.col("target"), F.col("tilt")).otherwise(F.col("low"))).withColumn("high", F.when(F.col("got") >= F.col("target"), F.col("tilt")).otherwise(F.col("high")))
        newton = F.col("tilt") + (F.col("target") - F.col("got")) / F.greatest("slope", F.lit(1e-300))
        middle = (F.col("low") + F.col("high")) / 2
        moved = F.when((newton > F.col("low")) & (newton < F.col("high")), newton).otherwise(middle)
        dual = cut(step.withColumn("tilt", F.when(F.col("miss") <= NEAR, F.col("tilt")).otherwise(moved)).select(*dual.columns))
        if dual.where(F.col("miss") > NEAR).isEmpty():
            break
    solved = base.join(dual.select(F.col("source").alias("s"), "mean", "tilt"), F.col("source").eqNullSafe(F.col("s")))
    rate = F.when(F.col("target") <= 0, 0.0).when(F.col("target") >= most * F.col("source_size"), float(most)).otherwise(_rate(most))
    # Sums of parts in another order differ in the last digits; reruns must not.
    return solved.select("source", "size", "docs", "target", F.round(rate, 9).alias("rate"))


def _whole_copies(most: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        """Copies for each size of one source: the words that rounding leaves go on to the next smaller size."""
        rows = rows.sort_values("size", ascending=False)
        owed, copies = 0.0, []
        for size, docs, rate in zip(rows["size"].tolist(), rows["docs"].tolist(), rows["rate"].tolist(), strict=True):
            owed += size * docs * rate
            n = min(max(round(owed / size), 0), most * docs)
            owed -= n * size
            copies.append(n)
        return rows.assign(copies=copies)[["source", "size", "docs", "copies"]]

    return run


def _row_hash() -> Column:
    return F.xxhash64("text", "source")


def mix(docs: DataFrame, *, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, most: int = 2) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, row_hash): for each row of `docs` how often the mix takes it, 0 to `most` times.

    `docs` has doc_id, text and source; other columns are ignored.  A null text has no words; documents
    without words are never taken.  A null source is a source of its own, the last one.  Rows that repeat are
    documents of their own; which of equal sizes are taken more often is decided by a hash of
    doc_id, text and source, and for rows that are equal in these does not matter.  Reruns agree.  An empty table gives an empty result.
    """
    counted = cut(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), _row_hash().alias("row_hash")))
    counts = counted.groupBy("source", "size").agg(F.count("*").alias("docs"))
    totals = counts.groupBy("source").agg(F.sum(F.col("size") * F.col("docs")).alias("source_size"))
    targets = cut(source_targets(totals, weights=weights, share=share, most=most))
    rates = balanced_rates(counts, targets, most=most)
    whole = rates.groupBy("source").applyInPandas(_whole_copies(most), "source string, size long, docs long, copies long")
    by_size = cut(whole.select(F.col("source").alias("s"), F.col("size").alias("z"), "docs", "copies"))
    same = F.col("source").eqNullSafe(F.col("s")) & (F.col("size") == F.col("z"))
    # Of a (source, size) each document has copies / docs rounded down; the first of them by hash have one more.
    # The ranks are counted in parts of about RANKED_ROWS, as one size may hold a third of all documents.
    part = F.pmod(F.xxhash64("doc_id", "row_hash", F.lit(1)), F.ceil(F.col("docs") / RANKED_ROWS))
    dealt = counted.where("size > 0").join(by_size, same).select("doc_id", "row_hash", "source", "size", "docs", "copies", part.alias("part"))
    parts = dealt.groupBy("source", "size", "part").agg(F.count("*").alias("rows"))
    ahead = Window.partitionBy("source", "size").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(F.col("source").alias("s"), F.col("size").alias("z"), F.col("part").alias("p"), F.coalesce(F.sum("rows").over(ahead), F.lit(0)).alias("ahead"))
    own = Window.partitionBy("source", "size", "part").orderBy(F.xxhash64("doc_id", "row_hash", F.lit(2)), "doc_id", "row_hash")
    ranked = dealt.withColumn("rank", F.row_number().over(own)).join(parts, same & (F.col("part") == F.col("p")))
    extra = F.col("ahead") + F.col("rank") <= F.col("copies") % F.col("docs")
    taken = ranked.select("doc_id", "row_hash", "source", "size", (F.floor(F.col("copies") / F.col("docs")) + extra.cast("long")).alias("copies"))
    taken = taken.unionByName(counted.where("size = 0").withColumn("copies", F.lit(0).cast("long")))
    targets = targets.select(F.col("source").alias("t"), "source_size", "target")
    return taken.join(targets, F.col("source").eqNullSafe(F.col("t")), "left").select("doc_id", "source", "size", "source_size", "target", "copies", "row_hash")


def take_copies(docs: DataFrame, mixed: DataFrame) -> DataFrame:
    """`docs` with every row as often as mix(docs) takes it; columns as they were, whatever they are called.

    A row is known by doc_id, null or not, and by a hash of text and source.  Rows that are equal in these are the same to
    the mix: one of them stands for all and comes as often as all together.
    """
    id_, none_ = F.coalesce("doc_id", F.lit(0)).alias("id_"), F.col("doc_id").isNull().alias("none_")
    keys = ["id_", "none_", "own_"]
    sums = mixed.where("copies > 0").groupBy(id_, none_, F.col("row_hash").alias("own_")).agg(F.sum("copies").alias("times_"))
    rows = docs.select(F.struct(*(F.col(f"`{x}`") for x in docs.columns)).alias("row_"), id_, none_, _row_hash().alias("own_"))
    taken = rows.join(sums, keys).withColumn("number_", F.row_number().over(Window.partitionBy(*keys).orderBy("times_"))).where("number_ = 1")
    return taken.withColumn("time_", F.explode(F.sequence(F.lit(1).cast("long"), "times_"))).select("row_.*")
