"""Expressions on ARRAY<FLOAT|DOUBLE> columns, accumulated in double."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x))


def unit(a: Column, eps: float = 1e-12) -> Column:
    length = norm(a) + F.lit(eps)
    return F.transform(a, lambda x: x.cast("double") / length)


def distance(a: Column, b: Column) -> Column:
    squares = F.zip_with(a, b, lambda x, y: F.pow(x.cast("double") - y.cast("double"), 2))
    return F.sqrt(F.aggregate(squares, F.lit(0.0), lambda acc, x: acc + x))
