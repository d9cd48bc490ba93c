"""Frames as arrays of pixels, row after row: all of these stay within a row, so that nothing is shuffled."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from framelake.functions.numbers import divided


def mean(a: Column) -> Column:
    return divided(F.aggregate(a, F.lit(0.0), lambda s, v: s + v), F.size(a).cast("double"))


def std(a: Column) -> Column:
    """The population's standard deviation, about the mean that is found first."""
    of = lambda m: F.sqrt(divided(F.aggregate(a, F.lit(0.0), lambda s, v: s + (v - m) * (v - m)), F.size(a).cast("double")))
    return F.element_at(F.transform(F.array(mean(a)), of), 1)


def window(a: Column, width: Column, top: int, left: int, rows: Column, columns: Column) -> Column:
    """The pixels of a rectangle."""
    return F.flatten(F.transform(F.sequence(F.lit(0), rows - 1), lambda y: F.slice(a, (y + top) * width + left + 1, columns)))


def binned(a: Column, width: Column, height: Column, bins: int) -> Column:
    """Means of squares of bins x bins pixels."""
    across, down = (width / bins).cast("int"), (height / bins).cast("int")

    def one(i: Column) -> Column:
        y, x = F.floor(i / across).cast("int") * bins, (i % across) * bins
        return mean(F.flatten(F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda d: F.slice(a, (y + d) * width + x + 1, F.lit(bins)))))

    return F.transform(F.sequence(F.lit(0), across * down - 1), one)
