"""Intervals, medians and buckets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def ci95(rate: Column, n: Column) -> tuple[Column, Column]:
    """Normal 95 % interval of a proportion, held to 0..1; (0, 0) for no observations."""
    se = F.sqrt(F.greatest(rate * (1 - rate), F.lit(0.0)) / F.greatest(n, F.lit(1)))
    some = n > 0
    return F.when(some, F.greatest(F.lit(0.0), rate - 1.96 * se)).otherwise(0.0), F.when(some, F.least(F.lit(1.0), rate + 1.96 * se)).otherwise(0.0)


def rounded(c: Column, digits: int) -> Column:
    """A double rounded as SQL does: it times 10^digits to the nearest whole number, halves up. ``F.round`` goes
    by the shortest digits instead, so it takes 995 / 1600, a double below 0.621875, up."""
    return F.round(c * 10.0**digits) / 10.0**digits


def share(part: Column, whole: Column, digits: int = 4) -> Column:
    """Rounded ratio; null where the whole is 0."""
    return rounded(F.try_divide(part, whole), digits)


def bucket(value: Column, edges: Sequence[tuple[float, str]]) -> Column:
    """Label of the first edge above the value, else the last label."""
    out = F
    for edge, label in edges:
        out = out.when(value < edge, F.lit(label))
    return out.otherwise(F.lit(edges[-1][1]))
