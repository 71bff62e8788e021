"""Weights: what combines alternatives (plus) and what combines arcs of a path (times)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INF = float("inf")


class Tropical:
    """min and +; zero is infinity, one is 0."""

    name, code = "tropical", 0
    zero, one = INF, 0.0
    idempotent = True

    @staticmethod
    def plus(weight: str | Column) -> Column:
        """The aggregate over a group's weights."""
        return F.min(weight)

    @staticmethod
    def times(a: Column, b: Column) -> Column:
        return F.when(is_zero(a) | is_zero(b), F.lit(INF)).otherwise(a + b)


class Log(Tropical):
    """-ln(e^-a + e^-b) and +. Sums that underflow fall back to the smallest weight."""

    name, code = "log", 1
    idempotent = False

    @staticmethod
    def plus(weight: str | Column) -> Column:
        w = F.col(weight) if isinstance(weight, str) else weight
        total = F.sum(F.exp(-w))
        return F.when(total > 0, -F.log(total)).otherwise(F.min(w))


SEMIRINGS = {s.name: s for s in (Tropical, Log)}


def is_zero(weight: Column) -> Column:
    """Both infinities count as zero."""
    return F.abs(weight) == F.lit(INF)


def weight_text(weight: Column) -> Column:
    """inf, or the shortest decimal: whole numbers without a point."""
    return F.when(is_zero(weight), F.lit("inf")).when(weight == F.floor(weight), F.floor(weight).cast("string")).otherwise(weight.cast("string"))
