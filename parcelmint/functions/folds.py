"""Folds over arrays in linear time."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), where value is worked out once however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


#: Elements of a run and levels of runs in running(): work grows with the elements up to RUN ** (LEVELS + 1) of them.
RUN, LEVELS = 64, 3


def running(values: Column, first: Column, combine: Callable[[Column, Column], Column], levels: int = LEVELS) -> Column:
    """For each of an array's values, the combination of first and all values before it, in order.

    An array that grows by one is copied each time, so it is made in short runs: the runs' own combinations are
    treated in the same way, which tells where each run begins.
    """

    def fold(run: Column, start: Column) -> Column:
        zero = F.struct(start.alias("at"), F.slice(run, 1, 0).alias("out"))
        return F.aggregate(run, zero, lambda s, v: F.struct(combine(s["at"], v).alias("at"), F.concat(s["out"], F.array(s["at"])).alias("out")), lambda s: s["out"])

    if levels == 0:
        return fold(values, first)

    def runs(v: Column) -> Column:
        last = F.greatest(F.ceil(F.size(v) / RUN) - 1, F.lit(0))
        return F.transform(F.sequence(F.lit(0).cast("long"), last), lambda i: F.slice(v, (i * RUN + 1).cast("int"), F.lit(RUN)))

    def joined(cut: Column) -> Column:
        begins = running(F.transform(cut, lambda r: F.aggregate(F.slice(r, 2, RUN), F.get(r, F.lit(0)), combine)), first, combine, levels - 1)
        return F.flatten(F.zip_with(cut, begins, fold))

    return let(let(values, runs), joined)
