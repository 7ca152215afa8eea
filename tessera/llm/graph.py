"""Connected components of a graph that stays on the executors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.cutting import cut


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): for every node of an edge the smallest node that it reaches.

    In each round every node takes the smallest label among its own and its neighbours', then
    the label of its label, and edges whose ends have come together leave the graph.  Labels
    only fall, each group by `min` is combined before the shuffle, and the number of rounds is
    logarithmic in practice because labels jump along labels.  Self loops and repeated edges
    are harmless; null ends are ignored.  Without edges the result is empty.
    """
    ends = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a is not null and b is not null")
    both = cut(ends.unionByName(ends.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = cut(both.groupBy(F.col("a").alias("node")).agg(F.min(F.least("a", "b")).alias("label")))
    while True:
        near = both.join(labels.select(F.col("node").alias("a"), "label"), "a").groupBy(F.col("b").alias("node")).agg(F.min("label").alias("near"))
        lower = labels.join(near, "node", "left").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        above = lower.select(F.col("node").alias("label"), F.col("label").alias("above"))
        jumped = cut(lower.join(above, "label", "left").select("node", "old", F.least("label", "above").alias("label")))
        if jumped.where("label < old").isEmpty():
            return jumped.select("node", F.col("label").alias("component"))
        labels = jumped.select("node", "label")
