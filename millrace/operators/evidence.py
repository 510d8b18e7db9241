"""Bounded evidence texts: which lines fit a token budget."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def fitting_prefix(sizes: Column, budget: Column) -> Column:
    """The largest number of leading items whose sizes sum to at most budget."""
    start = F.struct(F.lit(0).alias("k"), F.lit(0).cast("bigint").alias("used"), F.lit(True).alias("go"))

    def step(acc: Column, x: Column) -> Column:
        used = acc["used"] + x
        fits = acc["go"] & (used <= budget)
        return F.struct((acc["k"] + fits.cast("int")).alias("k"), used.alias("used"), fits.alias("go"))

    return F.aggregate(sizes, start, step, lambda a: a["k"])


def total(sizes: Column) -> Column:
    return F.aggregate(sizes, F.lit(0).cast("bigint"), lambda a, x: a + x)


def allocate(added: Column, deleted: Column, budget: Column) -> Column:
    """Struct (n_add, n_del): leading added and deleted lines, by arrays of their
    sizes, that share a budget.

    All, if they fit.  Otherwise the added lines get their proportion of the
    budget, the deleted ones what these leave, and the added ones then what
    those leave.
    """
    sums = F.struct(total(added).alias("a"), total(deleted).alias("d"))

    def share(t: Column) -> Column:
        part = F.floor(budget * t["a"] / F.greatest(t["a"] + t["d"], F.lit(1))).cast("bigint")
        left = budget - total(F.slice(added, 1, fitting_prefix(added, part)))
        kept = lambda kd: F.struct(fitting_prefix(added, budget - total(F.slice(deleted, 1, kd))).alias("n_add"), kd.alias("n_del"))
        return F.when(t["a"] + t["d"] <= budget, F.struct(F.size(added).alias("n_add"), F.size(deleted).alias("n_del"))).otherwise(once(fitting_prefix(deleted, left), kept))

    return once(sums, share)


def once(x: Column, use: Callable[[Column], Column]) -> Column:
    """use(x) with x computed once, however often it is used."""
    return F.transform(F.array(x), use)[0]
