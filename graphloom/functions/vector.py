"""Arithmetic of array<double> columns; higher-order functions, so all of it stays in the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x)


def squared_distance(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)))


def distance(a: Column, b: Column) -> Column:
    return F.sqrt(squared_distance(a, b))


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def subtract(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def add(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def scale(a: Column, by: Column) -> Column:
    return F.transform(a, lambda x: x * by)


#: Edge features of two vectors. `l2` squares element by element; it is no norm.
EDGE_FEATURES: dict[str, Callable[[Column, Column], Column]] = {
    "hadamard": lambda a, b: F.zip_with(a, b, lambda x, y: x * y),
    "average": lambda a, b: F.zip_with(a, b, lambda x, y: (x + y) / 2),
    "l1": lambda a, b: F.zip_with(a, b, lambda x, y: F.abs(x - y)),
    "l2": lambda a, b: F.zip_with(a, b, lambda x, y: (x - y) * (x - y)),
}


def one_hot(label: Column, classes: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(classes - 1)), lambda i: (i == label).cast("int"))


def repeat(value: Column, n: int) -> Column:
    """A scalar as an n-tuple; an array as it is given."""
    return F.array_repeat(value, n)


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))
