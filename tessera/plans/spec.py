"""What an index is: its fields, what they can be used for, its model and its settings."""

from __future__ import annotations

import json
import re
from collections.abc import Mapping
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.vectors import METRICS

#: Kinds of fields and the Spark types that hold them.
KINDS: dict[str, T.DataType] = {
    "text": T.StringType(), "bool": T.BooleanType(), "int": T.IntegerType(), "long": T.LongType(), "float": T.FloatType(), "double": T.DoubleType(),
    "array<text>": T.ArrayType(T.StringType()), "array<int>": T.ArrayType(T.IntegerType()), "array<long>": T.ArrayType(T.LongType()), "array<float>": T.ArrayType(T.FloatType()), "array<double>": T.ArrayType(T.DoubleType()),
    "map<text, int>": T.MapType(T.StringType(), T.IntegerType()), "map<text, long>": T.MapType(T.StringType(), T.LongType()), "map<text, float>": T.MapType(T.StringType(), T.FloatType()), "map<text, double>": T.MapType(T.StringType(), T.DoubleType()),
    "image_pointer": T.StringType(), "video_pointer": T.StringType(), "audio_pointer": T.StringType(),
    "multimodal_combination": T.MapType(T.StringType(), T.DoubleType()),
    "custom_vector": T.StructType([T.StructField("content", T.StringType()), T.StructField("vector", T.ArrayType(T.FloatType()))]),
}
FEATURES = ("lexical_search", "score_modifier", "filter")
RESERVED = ("_id", "_score", "_tensor_score", "_lexical_score", "_highlights", "_tensor_facets", "_found")
MODES = ("structured", "semi-structured", "unstructured")
_NUMBERS = ("int", "long", "float", "double")


@dataclass(frozen=True)
class Field:
    name: str
    kind: str
    features: tuple[str, ...] = ()
    dependent_fields: Mapping[str, float] | None = None

    def __post_init__(self):
        if not re.fullmatch(r"[a-zA-Z_][a-zA-Z0-9_]*", self.name) or self.name in RESERVED:
            raise ValueError(f"{self.name!r} can't be the name of a field")
        if self.kind not in KINDS:
            raise ValueError(f"{self.name}: unknown kind {self.kind!r}")
        if unknown := {*self.features} - {*FEATURES}:
            raise ValueError(f"{self.name}: unknown features {', '.join(sorted(unknown))}")
        if "lexical_search" in self.features and self.kind not in ("text", "array<text>", "custom_vector"):
            raise ValueError(f"{self.name}: only text can be searched by keywords")
        if "score_modifier" in self.features and self.kind not in _NUMBERS and not self.kind.startswith("map<"):
            raise ValueError(f"{self.name}: only numbers can change scores")
        if "filter" in self.features and (self.kind.startswith("map<") or self.kind == "multimodal_combination"):
            raise ValueError(f"{self.name} can't be filtered by")
        if self.features and self.kind in ("image_pointer", "video_pointer", "audio_pointer", "multimodal_combination") and (self.kind == "multimodal_combination" or self.kind == "image_pointer" and {*self.features} - {"filter"}):
            raise ValueError(f"{self.name}: {self.kind} has no features")
        if (self.kind == "multimodal_combination") != bool(self.dependent_fields):
            raise ValueError(f"{self.name}: a combination, and nothing else, has dependent fields")

    @property
    def sql_type(self) -> T.DataType:
        return KINDS[self.kind]


@dataclass(frozen=True)
class IndexSpec:
    """Settings with their usual defaults."""

    name: str
    fields: tuple[Field, ...] = ()
    tensor_fields: tuple[str, ...] = ()
    mode: str = "semi-structured"
    model: str = "hash"
    dimensions: int = 32
    normalize_embeddings: bool = True
    distance_metric: str = "prenormalized-angular"
    split_method: str = "sentence"
    split_length: int = 2
    split_overlap: int = 0
    video_window: tuple[float, float] = (20.0, 3.0)
    audio_window: tuple[float, float] = (10.0, 3.0)
    filter_string_max_length: int = 50
    query_prefix: str | None = None
    chunk_prefix: str | None = None
    version: int = 1
    settings: Mapping[str, object] = field(default_factory=dict)

    def __post_init__(self):
        if not re.fullmatch(r"[a-zA-Z_-][a-zA-Z0-9_-]*", self.name):
            raise ValueError(f"{self.name!r} can't be the name of an index")
        if self.mode not in MODES:
            raise ValueError(f"unknown mode {self.mode!r}")
        if self.distance_metric not in METRICS:
            raise ValueError(f"unknown metric {self.distance_metric!r}")
        names = [x.name for x in self.fields]
        if len(names) != len({*names}):
            raise ValueError("two fields have one name")
        if self.mode == "structured" and (unknown := {*self.tensor_fields} - {*names}):
            raise ValueError(f"tensor fields that are no fields: {', '.join(sorted(unknown))}")
        if "_id" in self.tensor_fields:
            raise ValueError("_id can't be a tensor field")
        for x in self.fields:
            if x.kind in ("multimodal_combination", "custom_vector") and x.name not in self.tensor_fields:
                raise ValueError(f"{x.name} has to be a tensor field")
            for y in x.dependent_fields or ():
                if y not in names:
                    raise ValueError(f"{x.name}: {y} is no field")

    def schema(self) -> T.StructType:
        """Of the documents; each field's metadata has its kind and features."""
        rows = [T.StructField("_id", T.StringType(), False)]
        return T.StructType(rows + [T.StructField(x.name, x.sql_type, True, {"kind": x.kind, "features": list(x.features)}) for x in self.fields])

    def with_feature(self, feature: str) -> list[str]:
        return [x.name for x in self.fields if feature in x.features]

    def rules(self) -> dict[str, Column]:
        """What a row of documents has to hold, by name: see operators.documents.validated."""
        out = {"_id is missing or empty": F.length("_id") > 0}
        for x in self.fields:
            if x.kind == "int":
                out[f"{x.name} is out of range"] = F.col(f"`{x.name}`").isNull() | (F.col(f"`{x.name}`") > -(2**31))
            if x.kind in ("float", "array<float>"):
                low = lambda v: F.abs(v.cast("double")) <= 3.4028235e38
                out[f"{x.name} is out of range"] = F.col(f"`{x.name}`").isNull() | (low(F.col(f"`{x.name}`")) if x.kind == "float" else F.forall(f"`{x.name}`", low))
            if x.kind == "custom_vector":
                own, v = F.col(f"`{x.name}`"), F.col(f"`{x.name}`")["vector"]
                out[f"{x.name} has a vector of another length"] = own.isNull() | (F.size(v) == self.dimensions)
                out[f"{x.name} has a vector with missing parts"] = own.isNull() | F.forall(v, lambda y: y.isNotNull() & ~F.isnan(y) & (F.abs(y) < float("inf")))
                if self.normalize_embeddings:
                    out[f"{x.name} has a vector without length"] = own.isNull() | F.exists(v, lambda y: y != 0)
        return out

    def grown(self, docs: DataFrame, *, most: int = 100) -> IndexSpec:
        """With the fields that `docs` has and the spec has not; up to `most` of those of text are searchable.

        Text can be searched and filtered by, bools and lists filtered by, numbers also change scores, maps of numbers change scores.
        """
        if self.mode == "structured":
            return self
        known = {x.name for x in self.fields}
        kinds = {k.simpleString(): name for name, k in KINDS.items() if "pointer" not in name and name not in ("multimodal_combination", "custom_vector")}
        new = []
        for x in docs.schema:
            if x.name in known or x.name == "_id" or x.dataType.simpleString() not in kinds:
                continue
            kind = kinds[x.dataType.simpleString()]
            features = ("lexical_search", "filter") if kind == "text" else ("score_modifier",) if kind.startswith("map<") else ("filter", "score_modifier") if kind in _NUMBERS else ("filter",)
            new.append(Field(x.name, kind, features))
        if not new:
            return self
        if len(self.with_feature("lexical_search")) + sum("lexical_search" in x.features for x in new) > most:
            raise ValueError(f"an index has at most {most} fields that can be searched by keywords")
        return replace(self, fields=(*self.fields, *new), version=self.version + 1)

    def to_json(self) -> str:
        return json.dumps(asdict(self), sort_keys=True)

    @classmethod
    def from_json(cls, text: str) -> IndexSpec:
        x = json.loads(text)
        x["fields"] = tuple(Field(**y | {"features": tuple(y["features"])}) for y in x["fields"])
        return cls(**x | {k: tuple(x[k]) for k in ("tensor_fields", "video_window", "audio_window")})
