"""Column expressions over array vectors."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, functions as F


def as_double(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(as_double(a), as_double(b), lambda x, y: x * y)
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def norm(a: Column) -> Column:
    squares = F.transform(as_double(a), lambda x: x * x)
    return F.sqrt(F.aggregate(squares, F.lit(0.0), lambda acc, x: acc + x))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (norm(a) * norm(b))


def unit(a: Column) -> Column:
    """The vector scaled to length one; a zero vector becomes nulls."""
    length = norm(a)
    return F.transform(as_double(a), lambda x: x / F.nullif(length, F.lit(0.0)))


def mean_vector(v: Column) -> Column:
    """Element-wise mean as one mergeable aggregate, with no explode."""
    return vector_to_array(Summarizer.mean(array_to_vector(as_double(v))))


def quantised_text(v: Column, scale: int) -> Column:
    """Integers joined by commas: a text form with no floating-point formatting."""
    ints = F.transform(as_double(v), lambda x: F.round(x * scale).cast("bigint").cast("string"))
    return F.array_join(ints, ",")
