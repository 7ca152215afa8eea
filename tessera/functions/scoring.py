"""Score modifiers: a product over and a sum of fields that a document has."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class ScoreModifiers:
    """Weights by field; `field.key` is a key of a map field.  Of repeated fields the last weight counts."""

    multiply: Mapping[str, float] = field(default_factory=dict)
    add: Mapping[str, float] = field(default_factory=dict)

    def __post_init__(self):
        if not self.multiply and not self.add:
            raise ValueError("score modifiers need at least one field")
        if "_id" in {*self.multiply, *self.add}:
            raise ValueError("_id can't be a score modifier")

    @classmethod
    def of(cls, request: dict) -> ScoreModifiers:
        """From {"multiply_score_by": [{"field_name", "weight"}], "add_to_score": [...]}; the weight is 1 if left out."""
        unknown = {*request} - {"multiply_score_by", "add_to_score"}
        if unknown:
            raise ValueError(f"unknown score modifier lists: {', '.join(sorted(unknown))}")
        fold = lambda rows: {x["field_name"]: float(x.get("weight", 1)) for x in rows}
        return cls(fold(request.get("multiply_score_by", ())), fold(request.get("add_to_score", ())))


def field_value(frame: DataFrame, name: str, *, strict: bool) -> Column | None:
    """The number that a document has for a field, or None if the table has no such field and `strict` is off."""
    kinds = {x.name: x.dataType for x in frame.schema}
    if name in kinds and isinstance(kinds[name], T.NumericType | T.BooleanType):
        return F.col(f"`{name}`").cast("double")
    head, _, key = name.partition(".")
    if key and isinstance(kinds.get(head), T.MapType):
        return F.try_element_at(F.col(f"`{head}`"), F.lit(key)).cast("double")
    if strict:
        raise ValueError(f"{name} is no numeric field or key of a map of numbers")
    return None


def modified(frame: DataFrame, score: Column, modifiers: ScoreModifiers | None, *, strict: bool = True) -> Column:
    """(product of weight * value) * score + sum of weight * value, over the fields that a document has; 0 counts as a value."""
    if modifiers is None:
        return score
    product, added = F.lit(1.0), F.lit(0.0)
    for name, weight in modifiers.multiply.items():
        value = field_value(frame, name, strict=strict)
        product = product if value is None else product * F.coalesce(F.lit(weight) * value, F.lit(1.0))
    for name, weight in modifiers.add.items():
        value = field_value(frame, name, strict=strict)
        added = added if value is None else added + F.coalesce(F.lit(weight) * value, F.lit(0.0))
    return product * score + added
