"""Distances of two equal-length arrays, and the similarity threshold, as columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# The short metric names and what they stand for.
METRICS = {"eu": "euclid", "ma": "manhattan", "mi": "minkowski", "dtw": "dtw"}


def _fold(terms: Column) -> Column:
    return F.aggregate(terms, F.lit(0.0), lambda acc, x: acc + x)


def euclid(a: Column, b: Column) -> Column:
    return F.sqrt(_fold(F.zip_with(a, b, lambda x, y: (x - y) * (x - y))))


def manhattan(a: Column, b: Column) -> Column:
    return _fold(F.zip_with(a, b, lambda x, y: F.abs(x - y)))


def minkowski(a: Column, b: Column, p: float = 2.0) -> Column:
    terms = F.zip_with(a, b, lambda x, y: F.pow(F.abs(x - y), F.lit(float(p))))
    return F.pow(_fold(terms), F.lit(1.0 / p))


def metric_name(metric: str) -> str:
    if metric not in METRICS:
        raise ValueError(f"unknown metric {metric!r}; one of {', '.join(METRICS)}")
    return METRICS[metric]


def pair_distance(a: Column, b: Column, metric: str = "eu", p: float = 2.0) -> Column:
    """Distance column for a short metric name; an unknown name raises."""
    name = metric_name(metric)
    if name == "euclid":
        return euclid(a, b)
    if name == "manhattan":
        return manhattan(a, b)
    if name == "minkowski":
        return minkowski(a, b, p)
    from .warping import dtw

    return dtw(a, b)


def similarity_radius(length: Column, st: float) -> Column:
    """Two windows of ``length`` points are similar up to this distance."""
    return F.sqrt(length.cast("double")) * F.lit(float(st)) / 2
