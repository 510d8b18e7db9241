"""Running sums and ranks over all rows of a large group, without a window
that puts the group into one task."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.keys import fresh


def running_sum(df: DataFrame, by: Sequence[str], digest: Column, value: Column, tie: Sequence[str], name: str = "before", digits: int = 3) -> DataFrame:
    """df with column name: the sum of value over the rows of the same group
    (by) that come before the row in the order (digest, tie).

    digest is a hex text spread evenly (a hash), so its first digits cut every
    group into 16**digits slices of like size.  Sums per slice (a table bounded
    by groups x 16**digits) give each slice its offset; the window inside a
    slice sees only that slice.  Null values count as 0.  Ties of digest and
    tie columns are broken arbitrarily but consistently within one run only, so
    give a unique tie.  Grouping treats null as a level.
    """
    taken = [*df.columns, name]
    own = lambda c: fresh(taken, f"__{c}")
    d, s, v, i, o = (own(c) for c in ("digest", "slice", "value", "inner", "offset"))
    work = df.withColumns({d: digest, v: F.coalesce(value.cast("double"), F.lit(0.0))}).withColumn(s, F.substring(d, 1, digits))
    keys = list(by)
    before = Window.partitionBy(*keys).orderBy(s).rowsBetween(Window.unboundedPreceding, -1)
    slices = work.groupBy(*keys, s).agg(F.sum(v).alias(o)).withColumn(o, F.coalesce(F.sum(o).over(before), F.lit(0.0)))
    named = {c: own(f"key{k}") for k, c in enumerate([*keys, s])}
    slices = slices.select(*[F.col(c).alias(n) for c, n in named.items()], o)
    on = F.lit(True)
    for c, n in named.items():
        on = on & F.col(c).eqNullSafe(F.col(n))
    inner = Window.partitionBy(*keys, s).orderBy(d, *tie).rowsBetween(Window.unboundedPreceding, -1)
    summed = work.withColumn(i, F.coalesce(F.sum(v).over(inner), F.lit(0.0))).join(slices, on)
    return summed.withColumn(name, F.col(o) + F.col(i)).select(*df.columns, name)


#: Rows of a slice of the sequence, and the most slices.
SLICE_ROWS, MOST_SLICES = 1_000_000, 256


def sequence_slice(df: DataFrame, seq: str, rows: int = SLICE_ROWS) -> Column | None:
    """The slice of a row, 0 upwards in the order of seq, where all rows of df are
    cut into slices of about so many rows: no group has more than that in one.
    Store the rows with their slice before running_before is applied.  None if
    one slice holds them all."""
    n = min(MOST_SLICES, df.count() // rows + 1)
    if n == 1:
        return None
    cuts = df.agg(F.percentile_approx(seq, [k / n for k in range(1, n)], 10 * n)).first()[0] or []
    return reduce(Column.__add__, [(F.col(seq) > F.lit(c)).cast("int") for c in sorted(set(cuts))], F.lit(0))


def running_before(df: DataFrame, by: Sequence[str], seq: str, slice_column: str | None, sums: dict[str, Column], last: dict[str, Column] | None = None) -> DataFrame:
    """df with, for each name of sums, the sum over the earlier rows of the same
    group (0 for none), and for each of last, the value of the row just before
    (null for none).

    Earlier is by seq, unique in a group.  Windows run inside a slice of a
    group; sums per group and slice carry over.  Without a slice column every
    group is one slice.
    """
    last = last or {}
    keys = list(by)
    if slice_column is None:
        whole = Window.partitionBy(*keys).orderBy(seq).rowsBetween(Window.unboundedPreceding, -1)
        return df.select(*df.columns, *[F.coalesce(F.sum(c).over(whole), F.lit(0)).alias(n) for n, c in sums.items()], *[F.last(F.struct(c.alias("v"))).over(whole)["v"].alias(n) for n, c in last.items()])
    inner = Window.partitionBy(*keys, slice_column).orderBy(seq).rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy(*keys).orderBy(slice_column).rowsBetween(Window.unboundedPreceding, -1)
    per = df.groupBy(*keys, slice_column).agg(*[F.sum(c).alias(f"__s_{n}") for n, c in sums.items()], *[F.max_by(F.struct(c.alias("v")), F.col(seq)).alias(f"__l_{n}") for n, c in last.items()])
    carried = per.select(*keys, slice_column, *[F.sum(f"__s_{n}").over(before).alias(f"__o_{n}") for n in sums], *[F.last(f"__l_{n}").over(before).alias(f"__p_{n}") for n in last])
    out = df.withColumns({f"__i_{n}": F.sum(c).over(inner) for n, c in sums.items()} | {f"__j_{n}": F.last(F.struct(c.alias("v"))).over(inner) for n, c in last.items()}).join(carried, [*keys, slice_column])
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return out.select(*df.columns, *[(zero(f"__o_{n}") + zero(f"__i_{n}")).alias(n) for n in sums], *[F.coalesce(F.col(f"__j_{n}"), F.col(f"__p_{n}"))["v"].alias(n) for n in last])
