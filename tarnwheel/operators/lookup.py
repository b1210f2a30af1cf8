"""Lookup tables on grids of one to three axes, with values in row-major order."""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(axes: list[Column], values: Column) -> Column:
    """Whether every axis is there and the number of values is the product of their sizes."""
    size = F.lit(1)
    for a in axes:
        size = size * F.size(a)
    there = F.lit(True)
    for a in axes:
        there = there & a.isNotNull() & (F.size(a) > 0)
    return F.coalesce(there & (F.size(values) == size), F.lit(False))


def _below(c: Column):
    return lambda a: a < c


def interpolate(axes: list[Column], values: Column, at: list[Column]) -> Column:
    """Multilinear interpolation at a point; coordinates beyond an axis are held to its ends; null if the table is not usable."""
    if not 1 <= len(axes) <= 3 or len(axes) != len(at):
        raise ValueError("one to three axes, and as many coordinates")
    low, weight = [], []
    for axis, c in zip(axes, at):
        c = F.greatest(F.least(c.cast("double"), F.element_at(axis, -1)), F.element_at(axis, 1))
        up = F.size(F.filter(axis, _below(c)))  # the first point that is not below
        i = F.greatest(up - 1, F.lit(0))
        lo, hi = F.get(axis, i), F.get(axis, up)
        span = hi - lo
        low.append(i)
        weight.append(F.when(up == 0, 1.0).otherwise(F.when(span > 0, (hi - c) / span).otherwise(0.0)))
    out = F.lit(0.0)
    for corner in product((1, 0), repeat=len(axes)):
        w, place = F.lit(1.0), F.lit(0)
        for d, take in enumerate(corner):
            w = w * (weight[d] if take else 1.0 - weight[d])
            place = place * F.size(axes[d]) + (low[d] if take else low[d] + 1)
        out = out + F.when(w != 0, w * F.get(values, place)).otherwise(0.0)
    return F.when(usable(axes, values), out)


def with_template(tables: DataFrame, templates: DataFrame, key: str, axes: list[str]) -> DataFrame:
    """tables with each missing axis taken from its template (by key); `ready` tells whether the table can be used."""
    t = templates.select(key, *(F.col(a).alias("_" + a) for a in axes))
    j = tables.join(t, key, "left")
    j = j.select(*(c for c in tables.columns if c not in axes), *(F.coalesce(a, "_" + a).alias(a) for a in axes))
    return j.withColumn("ready", usable([F.col(a) for a in axes], F.col("values")))
