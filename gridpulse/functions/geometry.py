"""Polygon helpers on nested coordinate arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def outer_ring(geometry: Column | str) -> Column:
    geometry = F.col(geometry) if isinstance(geometry, str) else geometry
    return geometry["coordinates"][0]


def _ring_mean(ring: Column, axis: int) -> Column:
    total = F.aggregate(ring, F.lit(0.0), lambda acc, point: acc + point[axis])
    return F.try_divide(total, F.size(ring).cast("double"))


def ring_mean_lon(geometry: Column | str) -> Column:
    """Mean longitude of the outer ring's listed vertices; the closing vertex counts twice."""
    return _ring_mean(outer_ring(geometry), 0)


def ring_mean_lat(geometry: Column | str) -> Column:
    return _ring_mean(outer_ring(geometry), 1)
