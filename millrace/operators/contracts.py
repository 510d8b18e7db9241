"""Table contracts as queries: what violates them, and how often."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class ContractError(ValueError):
    """A table breaks its contract."""


def repeated_keys(df: DataFrame, *key: str) -> DataFrame:
    """Keys that occur more than once, with n; a null part counts as a value."""
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def missing_parents(child: DataFrame, column: str, parent: DataFrame, key: str) -> DataFrame:
    """Distinct non-null references without a parent row."""
    refs = child.select(F.col(column).alias("ref")).filter("ref is not null").distinct()
    return refs.join(parent.select(F.col(key).alias("ref")).distinct(), "ref", "left_anti")


def set_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows that only one side has, counting repetitions, with side a or b."""
    return a.exceptAll(b).withColumn("side", F.lit("a")).unionByName(b.exceptAll(a).withColumn("side", F.lit("b")))


def forbid_columns(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """df, unless it has a column of one of the names (in any letter case)."""
    bad = sorted({c for c in df.columns if c.lower() in {n.lower() for n in names}})
    if bad:
        raise ContractError(f"forbidden columns: {', '.join(bad)}")
    return df


def require_columns(df: DataFrame, names: Sequence[str]) -> DataFrame:
    gone = sorted(set(names) - set(df.columns))
    if gone:
        raise ContractError(f"missing columns: {', '.join(gone)}")
    return df


def require_empty(violations: DataFrame, what: str) -> None:
    """An error with up to five examples if there is any violation."""
    rows = violations.limit(5).collect()
    if rows:
        raise ContractError(f"{what}: {rows}")


def require_known(df: DataFrame, column: str, values: Sequence[object]) -> DataFrame:
    """df, unless one of the values to act on doesn't occur in the column."""
    there = {r[0] for r in df.filter(F.col(column).isin(*values)).select(column).distinct().collect()}
    gone = sorted(str(v) for v in set(values) - there)
    if gone:
        raise ContractError(f"{column} has no {', '.join(gone)}")
    return df


def join_one_to_one(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """left joined to right on key, after checking that both have the same keys,
    once each."""
    for side, df in (("left", left), ("right", right)):
        require_empty(repeated_keys(df, key), f"repeated {key} on the {side}")
    require_empty(set_difference(left.select(key), right.select(key)), f"different {key} sets")
    return left.join(right, key)


def join_many_to_one(left: DataFrame, right: DataFrame, key: str, complete: bool = False) -> DataFrame:
    """left with the columns of the one right row of its key; complete: every
    left row must have one."""
    require_empty(repeated_keys(right, key), f"repeated {key} on the right")
    if complete:
        require_empty(missing_parents(left, key, right, key), f"{key} without a row on the right")
    return left.join(right, key, "left")


def overlap(train: DataFrame, target: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(key, n): distinct non-null values of each key that both sides have."""
    parts = None
    for k in keys:
        both = train.select(F.col(k).alias("v")).filter("v is not null").distinct().join(target.select(F.col(k).alias("v")).distinct(), "v", "left_semi")
        one = both.agg(F.count(F.lit(1)).alias("n")).select(F.lit(k).alias("key"), "n")
        parts = one if parts is None else parts.unionByName(one)
    return parts


def first_failure(rules: Sequence[tuple[str, Column]]) -> Column:
    """The reason of the first rule that a row breaks, in the order given; null
    if it keeps all.  A rule is a reason and the condition that breaks it; an
    unknown condition doesn't."""
    reason = F.lit(None).cast("string")
    for name, broken in reversed(rules):
        reason = F.when(F.coalesce(broken, F.lit(False)), name).otherwise(reason)
    return reason


def waterfall(df: DataFrame, steps: Sequence[tuple[str, Column]]) -> DataFrame:
    """One row: n rows, per step the rows that pass all earlier steps but not
    it, and those that pass all (eligible).  Unknown doesn't pass."""
    left, sums = F.lit(True), [F.count(F.lit(1)).alias("n")]
    for name, passes in steps:
        ok = F.coalesce(passes, F.lit(False))
        sums.append(F.count_if(left & ~ok).alias(name))
        left = left & ok
    return df.agg(*sums, F.count_if(left).alias("eligible"))
