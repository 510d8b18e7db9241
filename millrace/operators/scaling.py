"""Fitted feature transforms and linear scores."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.numbers import is_finite, sigmoid, signed_log


def fit_scaler(df: DataFrame, columns: Sequence[str], transform: Callable[[Column], Column] = signed_log) -> DataFrame:
    """(name, median, mean, std) per column: the median of the transformed finite
    values, then mean and population deviation with the gaps filled by it.  A
    deviation of 0 becomes 1; a column without values has median 0."""
    x = lambda c: F.when(is_finite(F.col(c)), transform(F.col(c).cast("double")))
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("name"), x(c).alias("x")) for c in columns])).alias("e")).select("e.*")
    g = long.groupBy("name").agg(F.percentile("x", F.lit(0.5)).alias("m"), F.count(F.lit(1)).alias("n"), F.count("x").alias("k"), F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("q"))
    m = F.coalesce("m", F.lit(0.0))
    gaps = F.col("n") - F.col("k")
    mean = (F.coalesce("s", F.lit(0.0)) + gaps * m) / F.col("n")
    var = (F.coalesce("q", F.lit(0.0)) + gaps * m * m) / F.col("n") - mean * mean
    std = F.sqrt(F.greatest(var, F.lit(0.0)))
    return g.select("name", m.alias("median"), mean.alias("mean"), F.when(std < 1e-9, 1.0).otherwise(std).alias("std"))


def apply_scaler(df: DataFrame, columns: Sequence[str], scaler: Mapping[str, tuple[float, float, float]], transform: Callable[[Column], Column] = signed_log, suffix: str = "_z", indicators: bool = False) -> DataFrame:
    """df with <column><suffix>: transformed, gaps filled with the median,
    standardised; indicators adds <column>_missing."""
    new = {}
    for c in columns:
        median, mean, std = scaler[c]
        x = F.when(is_finite(F.col(c)), transform(F.col(c).cast("double"))).otherwise(F.lit(median))
        new[c + suffix] = (x - F.lit(mean)) / F.lit(std)
        if indicators:
            new[f"{c}_missing"] = (~is_finite(F.col(c))).cast("double")
    return df.withColumns(new)


def linear_score(columns: Sequence[str], weights: Sequence[float], intercept: float) -> Column:
    """Sigmoid of a weighted sum."""
    z = F.lit(float(intercept))
    for c, w in zip(columns, weights, strict=True):
        z = z + F.col(c) * F.lit(float(w))
    return sigmoid(z)


def collect_scaler(fitted: DataFrame) -> dict[str, tuple[float, float, float]]:
    """The parameters as numbers: one row per feature."""
    return {r["name"]: (r["median"], r["mean"], r["std"]) for r in fitted.collect()}


def train_logistic(train: DataFrame, valid: DataFrame, columns: Sequence[str], label: str, cs: Sequence[float] = (0.01, 0.1, 1.0, 10.0)):
    """(model, columns, ap): the logistic regression of the grid with the best
    average precision on valid; of equal ones the first.  Both tables need rows
    of both classes.  Columns must be standardised and without gaps."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    from millrace.operators.ranking import ap_auc

    pack = VectorAssembler(inputCols=list(columns), outputCol="__x")
    rows = pack.transform(train).select("__x", F.col(label).cast("double").alias("__y"))
    n = rows.agg(F.count(F.lit(1)).alias("n"), F.sum("__y").alias("p")).first()
    if not n["p"] or n["p"] == n["n"]:
        raise ValueError("training rows of both classes are needed")
    best = None
    for c in cs:
        model = LogisticRegression(featuresCol="__x", labelCol="__y", regParam=1.0 / (c * n["n"]), elasticNetParam=0.0, standardization=False, maxIter=200).fit(rows)
        scored = model.transform(pack.transform(valid)).select(F.col(label).alias("__y"), vector_to_array("probability")[1].alias("__s"))
        ap = ap_auc(scored, [], "__s", "__y", None).first()["ap"]
        if ap is not None and (best is None or ap > best[1]):
            best = (model, ap)
    if best is None:
        raise ValueError("validation rows with positives are needed")
    return best[0], pack, best[1]
