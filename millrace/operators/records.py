"""Records brought into one form, those refused with their reason, and views of
them by role and domain."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.keys import fresh
from millrace.operators.contracts import ContractError, first_failure, require_columns


def canonicalise(df: DataFrame, forms: Mapping[str, Column], rules: Sequence[tuple[str, Column]], key: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected): df with the columns of forms in their canonical form,
    and the rows as they came with the reason of the first rule they break.

    forms: column by name, over the columns of df; rules: reason and the
    condition that breaks it, over the canonical columns; an unknown condition
    doesn't break a rule.  Where key is given, of accepted rows with the same
    key only one that comes first in canonical form stays, and different rows
    of one key are all rejected (repeated_key).
    """
    reason = fresh([*df.columns, *forms], "reason")
    raw = {c: fresh([*df.columns, *forms, reason], f"__raw_{c}") for c in df.columns}
    both = df.select(*[F.col(f"`{c}`").alias(raw[c]) for c in df.columns], *[F.col(f"`{c}`") for c in df.columns if c not in forms], *[x.alias(n) for n, x in forms.items()])
    both = both.withColumn(reason, first_failure(rules))
    names = [c for c in df.columns if c not in forms] + list(forms)
    fine = both.filter(F.col(reason).isNull()).select(*names)
    bad = both.filter(F.col(reason).isNotNull()).select(*[F.col(raw[c]).alias(c) for c in df.columns], reason)
    if not key:
        return fine, bad
    fine = fine.distinct()
    twice = fine.groupBy(*key).agg(F.count(F.lit(1)).alias("__n")).filter("__n > 1").select(*key)
    again = fine.join(twice, list(key), "left_semi")
    known = [c for c in names if c in df.columns]
    again = again.select(*[F.col(c).cast(df.schema[c].dataType).alias(c) if c in known else F.lit(None).cast(df.schema[c].dataType).alias(c) for c in df.columns], F.lit("repeated_key").alias(reason))
    return fine.join(twice, list(key), "left_anti"), bad.unionByName(again)


def project(df: DataFrame, columns: Sequence[str], forbidden: Sequence[str] = ()) -> DataFrame:
    """df with the listed columns alone; it is an error if one is missing or is
    also forbidden (in any letter case), as a label among inputs."""
    both = sorted({c for c in columns if c.lower() in {f.lower() for f in forbidden}})
    if both:
        raise ContractError(f"forbidden columns: {', '.join(both)}")
    return require_columns(df, columns).select(*columns)


def role_view(df: DataFrame, roles: Mapping[str, Sequence[object]]) -> DataFrame:
    """The rows whose columns have one of the values that the role allows; a null
    is never allowed."""
    allowed = F.lit(True)
    for column, values in roles.items():
        allowed = allowed & F.coalesce(F.col(column).isin(*values), F.lit(False))
    return df.filter(allowed)


def eligibility(df: DataFrame, rules: Sequence[tuple[str, Column]], name: str = "reason") -> DataFrame:
    """df with the reason why a row isn't eligible, null if it is."""
    return df.withColumn(fresh(df.columns, name), first_failure(rules))
