"""Ranking metrics, exact and tie-aware, for any grouping.

All metrics come from one table: rows and positives per group and distinct
score, with running totals from the highest score down.  Equal scores are
collapsed before the shuffle, and the running totals are taken in slices of the
score range, so a single group may be as large as the whole table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.keys import salted_digest
from millrace.operators.prefix import running_sum

SLICES = 64


def _nullsafe(left: DataFrame, right: DataFrame, by: Sequence[str], how: str = "inner") -> DataFrame:
    """A join on columns that may be null, which match each other."""
    renamed = right.select(*[F.col(c).alias(f"__j{i}") for i, c in enumerate(by)], *[c for c in right.columns if c not in by])
    on = F.lit(True)
    for i, c in enumerate(by):
        on = on & F.col(c).eqNullSafe(F.col(f"__j{i}"))
    return left.join(renamed, on, how).drop(*[f"__j{i}" for i in range(len(by))])


def score_table(df: DataFrame, by: Sequence[str], score: str, label: str) -> DataFrame:
    """(by..., score, tp, n, ctp, cn, p, t): positives and rows at each distinct
    score, their running totals from the top, and the totals of the group.

    Rows with a null or not finite score or a null label don't count.  Without
    grouping columns the whole table is one group.
    """
    by = list(by)
    s = F.col(score).cast("double")
    rows = df.filter(s.isNotNull() & ~F.isnan(s) & (F.abs(s) < F.lit(float("inf"))) & F.col(label).isNotNull())
    per = rows.groupBy(*by, (s + F.lit(0.0)).alias("score")).agg(F.sum(F.col(label).cast("double")).alias("tp"), F.count(F.lit(1)).cast("double").alias("n"))
    cuts = per.groupBy(*by).agg(F.array_distinct(F.percentile_approx("score", [k / SLICES for k in range(1, SLICES)], 1000)).alias("cuts"), F.sum("tp").alias("p"), F.sum("n").alias("t"))
    placed = _nullsafe(per, cuts, by).withColumn("slice", F.size(F.filter("cuts", lambda c: c > F.col("score")))).drop("cuts")
    sums = placed.groupBy(*by, "slice").agg(F.sum("tp").alias("stp"), F.sum("n").alias("sn"))
    before = Window.partitionBy(*by).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(*by, "slice", F.coalesce(F.sum("stp").over(before), F.lit(0.0)).alias("otp"), F.coalesce(F.sum("sn").over(before), F.lit(0.0)).alias("on"))
    inner = Window.partitionBy(*by, "slice").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)
    out = placed.withColumns({"wtp": F.sum("tp").over(inner), "wn": F.sum("n").over(inner)})
    out = _nullsafe(out, offsets, [*by, "slice"])
    return out.select(*by, "score", "tp", "n", (F.col("otp") + F.col("wtp")).alias("ctp"), (F.col("on") + F.col("wn")).alias("cn"), "p", "t")


def _round(c: Column, digits: int | None) -> Column:
    return c if digits is None else F.round(c, digits)


def ap_auc(df: DataFrame, by: Sequence[str], score: str, label: str, digits: int | None = 6) -> DataFrame:
    """(by..., n, positives, ap, auc).

    ap: the step-wise average precision over distinct scores, null without
    positives and 1 if all are.  auc: with ties at half, null unless both
    classes occur.
    """
    ap = F.sum(F.col("tp") / F.nullif(F.col("p"), F.lit(0.0)) * F.col("ctp") / F.col("cn"))
    neg = F.col("t") - F.col("p")
    below = neg - (F.col("cn") - F.col("ctp")) + (F.col("n") - F.col("tp")) / 2
    auc = F.sum(F.col("tp") * below / F.nullif(F.col("p") * neg, F.lit(0.0)))
    g = score_table(df, by, score, label).groupBy(*by).agg(F.max("t").alias("n"), F.max("p").alias("positives"), ap.alias("ap"), auc.alias("auc"))
    return g.select(*by, F.col("n").cast("bigint").alias("n"), F.col("positives").cast("bigint").alias("positives"), _round(F.col("ap"), digits).alias("ap"), _round(F.col("auc"), digits).alias("auc"))


def boundary(table: DataFrame, by: Sequence[str], q: float) -> DataFrame:
    """(by..., k, cut, above_tp, slots, tied, tied_tp, p): the score at which the
    best k = max(1, ceil(n q)) rows end, and what lies above and at it."""
    k = F.greatest(F.lit(1.0), F.ceil(F.col("t") * F.lit(float(q))).cast("double"))
    at = table.withColumn("k", F.least(k, F.col("t"))).filter((F.col("cn") >= F.col("k")) & (F.col("cn") - F.col("n") < F.col("k")))
    return at.select(*by, F.col("k").cast("bigint").alias("k"), F.col("score").alias("cut"), (F.col("ctp") - F.col("tp")).alias("above_tp"), (F.col("k") - (F.col("cn") - F.col("n"))).alias("slots"), F.col("n").alias("tied"), F.col("tp").alias("tied_tp"), "p")


def recall_expected(df: DataFrame, by: Sequence[str], score: str, label: str, q: float, digits: int | None = 6) -> DataFrame:
    """(by..., k, recall, precision) among the best share q, where rows tied at
    the border count by their expected share.  recall is null without positives."""
    b = boundary(score_table(df, by, score, label), by, q)
    hit = F.col("above_tp") + F.col("tied_tp") * F.col("slots") / F.col("tied")
    return b.select(*by, "k", _round(hit / F.nullif(F.col("p"), F.lit(0.0)), digits).alias("recall"), _round(hit / F.col("k"), digits).alias("precision"))


def recall_hashed(df: DataFrame, by: Sequence[str], identity: str, score: str, label: str, q: float, salt: str, digits: int | None = 6) -> DataFrame:
    """(by..., k, recall, precision, tied): as recall_expected, but rows tied at
    the border are taken in the order of SHA-256(salt:id), whatever their label.
    tied is the number of rows at the border score."""
    by = list(by)
    b = boundary(score_table(df, by, score, label), by, q)
    at = _nullsafe(df.select(*by, F.col(identity).alias("__id"), (F.col(score).cast("double") + F.lit(0.0)).alias("__s"), F.col(label).cast("double").alias("__y")), b, by)
    at = at.filter((F.col("__s") == F.col("cut")) & F.col("__y").isNotNull())
    ranked = running_sum(at, by, salted_digest(salt, F.col("__id")), F.lit(1.0), ["__id"], "__rank")
    hit = F.max("above_tp") + F.sum(F.when(F.col("__rank") < F.col("slots"), F.col("__y")).otherwise(0.0))
    g = ranked.groupBy(*by).agg(F.max("k").alias("k"), hit.alias("hit"), F.max("p").alias("p"), F.max("tied").cast("bigint").alias("tied"))
    return g.select(*by, "k", _round(F.col("hit") / F.nullif(F.col("p"), F.lit(0.0)), digits).alias("recall"), _round(F.col("hit") / F.col("k"), digits).alias("precision"), "tied")


def best_threshold(df: DataFrame, by: Sequence[str], score: str, label: str, digits: int | None = 6) -> DataFrame:
    """(by..., threshold, f1): the score at or above which F1 is largest, of
    equal ones the highest; null without positives."""
    f1 = F.when(F.col("p") > 0, 2 * F.col("ctp") / (F.col("cn") + F.col("p")))
    t = score_table(df, by, score, label).withColumn("f1", f1)
    g = t.groupBy(*by).agg(F.max(F.when(F.col("f1").isNotNull(), F.struct("f1", "score"))).alias("b"))
    return g.select(*by, F.col("b.score").alias("threshold"), _round(F.col("b.f1"), digits).alias("f1"))


def at_threshold(df: DataFrame, by: Sequence[str], score: str, label: str, threshold: Column, digits: int | None = 6) -> DataFrame:
    """(by..., tp, fp, fn, tn, precision, recall, f1) of score >= threshold; a
    quotient of nothing is 0."""
    hit = F.coalesce(F.col(score) >= threshold, F.lit(False))
    y = F.col(label) == 1
    g = df.filter(F.col(label).isNotNull() & F.col(score).isNotNull()).groupBy(*by).agg(F.count_if(hit & y).alias("tp"), F.count_if(hit & ~y).alias("fp"), F.count_if(~hit & y).alias("fn"), F.count_if(~hit & ~y).alias("tn"))
    part = lambda a, b: F.coalesce(F.col(a) / F.nullif(F.col(a) + F.col(b), F.lit(0)), F.lit(0.0))
    f1 = F.coalesce(2.0 * F.col("tp") / F.nullif(2 * F.col("tp") + F.col("fp") + F.col("fn"), F.lit(0)), F.lit(0.0))
    return g.select(*by, "tp", "fp", "fn", "tn", _round(part("tp", "fp"), digits).alias("precision"), _round(part("tp", "fn"), digits).alias("recall"), _round(f1, digits).alias("f1"))


def metric_bundle(df: DataFrame, by: Sequence[str], identity: str, score: str, label: str, salt: str, q: float = 0.1, min_group: int = 0) -> DataFrame:
    """(by..., n, positives, prevalence, ap, auc, recall, precision, tied, lift,
    note) per group.

    A group of fewer than min_group rows, or without positives or negatives,
    has null metrics where they mean nothing, and the reason in note.  lift is
    ap over prevalence.
    """
    base = ap_auc(df, by, score, label, None)
    r = recall_hashed(df, by, identity, score, label, q, salt, None)
    j = _nullsafe(base, r.drop("k"), by, "left")
    small = F.col("n") < F.lit(min_group)
    prevalence = F.col("positives") / F.col("n")
    note = F.when(small, "group too small").when(F.col("positives") == 0, "nothing to rank").when(F.col("positives") == F.col("n"), "only positives")
    keep = lambda c: F.round(F.when(~small, c), 6)
    return j.select(
        *by, "n", "positives", F.round(prevalence, 6).alias("prevalence"), keep(F.col("ap")).alias("ap"), keep(F.col("auc")).alias("auc"),
        keep(F.col("recall")).alias("recall"), keep(F.col("precision")).alias("precision"), F.when(~small, F.col("tied")).alias("tied"), keep(F.col("ap") / F.nullif(prevalence, F.lit(0.0))).alias("lift"), note.alias("note"),
    )


def mid_ranks(df: DataFrame, by: Sequence[str], value: str, name: str) -> DataFrame:
    """df with the average rank (from 1, ascending) of value among equals in its
    group; null values get none."""
    by = list(by)
    counts = score_table(df.withColumn("__one", F.lit(0)), by, value, "__one").select(*by, F.col("score").alias("__v"), (F.col("t") - F.col("cn") + (F.col("n") + 1) / 2).alias(name))
    return _nullsafe(df.withColumn("__v", F.col(value).cast("double") + F.lit(0.0)), counts, [*by, "__v"], "left").drop("__v")


def spearman(df: DataFrame, by: Sequence[str], x: str, y: str, digits: int | None = 6) -> DataFrame:
    """(by..., n, rho): rank correlation with average ranks; null where either
    side is constant.  Rows with a null or not finite side don't count."""
    fine = lambda c: F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) & (F.abs(F.col(c).cast("double")) < F.lit(float("inf")))
    rows = df.filter(fine(x) & fine(y)).select(*by, x, y)
    ranked = mid_ranks(mid_ranks(rows, by, x, "__rx"), by, y, "__ry")
    rho = F.covar_pop("__rx", "__ry") / F.nullif(F.stddev_pop("__rx") * F.stddev_pop("__ry"), F.lit(0.0))  # corr fails on a constant side
    spread = (F.min("__rx") < F.max("__rx")) & (F.min("__ry") < F.max("__ry"))
    return ranked.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), _round(F.when(spread, rho), digits).alias("rho"))
