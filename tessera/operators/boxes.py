"""Boxes of pictures as rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as X


def best_boxes(boxes: DataFrame, keys: Sequence[str], *, box: str = "box", ties: Sequence[str] = (), least_area: float = 0.0, most_ratio: float | None = None, top: int) -> DataFrame:
    """The rows of each group's `top` best boxes that are large enough and not too long, with their `place` from 0.

    Best scores come first, ties by the columns `ties`, which should part rows; nulls last.  A group may have any
    number of rows: each task keeps `top` rows of a group before they are shuffled.
    """
    order = Window.partitionBy(*keys).orderBy(F.col(f"{box}.score").desc_nulls_last(), *(F.col(x).asc_nulls_last() for x in ties))
    fitting = boxes.where(X.box_fits(F.col(box), least_area=least_area, most_ratio=most_ratio))
    return fitting.withColumn("place", F.row_number().over(order)).where(F.col("place") <= top).withColumn("place", F.col("place") - 1)
