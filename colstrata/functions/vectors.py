"""Distances and codes of array<float> columns, as Column expressions in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(pairs: Column) -> Column:
    return F.aggregate(pairs, F.lit(0.0), lambda acc, x: acc + x)


def doubles(v: Column) -> Column:
    return F.transform(v, lambda x: x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def l2(a: Column, b: Column) -> Column:
    """Squared Euclidean distance."""
    return _sum(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))))


def inner_product(a: Column, b: Column) -> Column:
    """1 - a . b"""
    return 1.0 - dot(a, b)


def normalised(v: Column) -> Column:
    """The vector over its length; a zero vector stays."""
    n = F.sqrt(dot(v, v))
    return F.when(n > 0, F.transform(v, lambda x: x.cast("double") / n)).otherwise(doubles(v))


def cosine(a: Column, b: Column) -> Column:
    """1 - cosine similarity."""
    return 1.0 - dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


DISTANCES = {"l2": l2, "ip": inner_product, "cosine": cosine}


def codes8(v: Column, least: Column, most: Column) -> Column:
    """Codes from 0 to 255 over the range of all values."""
    return F.transform(v, lambda x: F.greatest(F.lit(0), F.least(F.lit(255), F.round(255.0 * (x.cast("double") - least) / (most - least)).cast("int"))))


def sign_bits(v: Column) -> Column:
    """1 for elements above 0."""
    return F.transform(v, lambda x: (x > 0).cast("int"))


def sign_distance(a: Column, b: Column) -> Column:
    """Mismatched bits less matched ones."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.when(x != y, 1).otherwise(-1)), F.lit(0), lambda acc, x: acc + x)
