"""Vector algebra as Columns: everything stays in the JVM."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Distance metrics of an index.
METRICS = ("euclidean", "angular", "dotproduct", "prenormalized-angular", "geodegrees", "hamming")
#: Kilometres of the mean earth radius, for geodegrees.
EARTH_KM = 6371.0088


def literal(values: Sequence[float]) -> Column:
    """A vector of doubles that is the same for all rows: part of the plan, no join."""
    return F.array(*(F.lit(float(x)) for x in values))


def doubles(v: Column | str) -> Column:
    return (F.col(v) if isinstance(v, str) else v).cast("array<double>")


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def norm(v: Column) -> Column:
    return F.sqrt(total(F.transform(v, lambda x: x * x)))


def scaled(v: Column, by: Column) -> Column:
    return F.transform(v, lambda x: x * by)


def added(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def normalised(v: Column) -> Column:
    """v / |v|; a zero vector stays as it is."""
    size = norm(v)
    return F.when(size > 0, F.transform(v, lambda x: x / size)).otherwise(v)


def rounded(x: Column, digits: int) -> Column:
    """x rounded half away from zero; what is rounded to zero keeps its sign, as in IEEE arithmetic and in DuckDB."""
    return F.round(F.abs(x), digits) * F.signum(x)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (norm(a) * norm(b))


def _clipped(x: Column) -> Column:
    return F.greatest(F.least(x, F.lit(1.0)), F.lit(-1.0))


def distance(metric: str, a: Column, b: Column) -> Column:
    """The distance of two vectors; for dotproduct the negative product, so that smaller is nearer.

    geodegrees takes (latitude, longitude) in degrees and gives kilometres; hamming counts differing bits
    of parts that are read as bytes.
    """
    if metric == "euclidean":
        return F.sqrt(total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y))))
    if metric == "angular":
        return F.acos(_clipped(cosine(a, b)))
    if metric == "prenormalized-angular":
        return 1 - dot(a, b)
    if metric == "dotproduct":
        return -dot(a, b)
    if metric == "hamming":
        bits = F.zip_with(a, b, lambda x, y: F.bit_count(x.cast("long").bitwiseXOR(y.cast("long")).bitwiseAND(F.lit(255).cast("long"))).cast("double"))
        return total(bits)
    if metric == "geodegrees":
        lat_a, lon_a, lat_b, lon_b = (F.radians(F.get(v, F.lit(k))) for v in (a, b) for k in (0, 1))
        half = F.pow(F.sin((lat_b - lat_a) / 2), 2) + F.cos(lat_a) * F.cos(lat_b) * F.pow(F.sin((lon_b - lon_a) / 2), 2)
        return 2 * EARTH_KM * F.asin(F.sqrt(F.least(half, F.lit(1.0))))
    raise ValueError(f"unknown metric {metric!r}; one of {', '.join(METRICS)}")


def closeness(metric: str, a: Column, b: Column) -> Column:
    """The score of a distance: 1 / (1 + distance), for dotproduct the product itself."""
    far = distance(metric, a, b)
    return -far if metric == "dotproduct" else 1 / (1 + far)


def has_length(v: Column, length: int) -> Column:
    return F.coalesce(F.size(v) == length, F.lit(False))
