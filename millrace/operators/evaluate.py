"""Evaluation across models, deployments and resampled clusters."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.durable import cut
from millrace.functions.keys import digest_uniform
from millrace.operators.prefix import running_sum
from millrace.operators.ranking import SLICES, ap_auc, score_table


def success_subset(predictions: DataFrame, identity: str, model: str, ok: Column) -> DataFrame:
    """The ids that succeeded in every model that occurs."""
    models = predictions.agg(F.count_distinct(model).alias("__all"))
    per = predictions.groupBy(identity).agg(F.count_distinct(F.when(ok, F.col(model))).alias("__ok"))
    return per.join(F.broadcast(models)).filter(F.col("__ok") == F.col("__all")).select(identity)


def coverage(predictions: DataFrame, identity: str, model: str, ok: Column, labels: DataFrame, label: str) -> DataFrame:
    """(model, n_ok, n_failed, n_missing, positives_lost) over the labelled ids:
    an id is ok if any of its rows is, failed if it has rows but none is."""
    per = predictions.groupBy(model, identity).agg(F.max(F.coalesce(ok, F.lit(False))).alias("ok"))
    per = per.join(labels, identity)
    total = labels.agg(F.count(F.lit(1)).alias("__n"), F.sum(label).alias("__p"))
    g = per.groupBy(model).agg(F.count_if("ok").alias("n_ok"), F.count_if(~F.col("ok")).alias("n_failed"), F.coalesce(F.sum(F.when(F.col("ok"), F.col(label))), F.lit(0)).alias("kept"))
    return g.join(F.broadcast(total)).select(model, "n_ok", "n_failed", (F.col("__n") - F.col("n_ok") - F.col("n_failed")).alias("n_missing"), (F.col("__p") - F.col("kept")).cast("bigint").alias("positives_lost"))


def noisy_or(score: Column) -> Column:
    """1 - prod(1 - score) as a mergeable aggregate; a score of 1 gives 1."""
    sure = F.max(F.when(score >= 1, 1.0).otherwise(0.0)) == 1.0
    return F.when(sure, 1.0).otherwise(1 - F.exp(F.sum(F.log1p(-F.when(score < 1, score)))))


def aggregate_scores(mapping: DataFrame, scores: DataFrame, unit: str, item: str, score: str, by: Sequence[str] = ()) -> DataFrame:
    """(by..., unit, n_items, n_scored, max_score, mean_score, noisy_or) over the
    distinct pairs of the mapping; items without a score are counted, then left
    out.  by: columns of scores, such as the model; every unit then has a row for
    each of their values (not null, and few: they are broadcast)."""
    pairs = mapping.select(unit, item).filter(F.col(unit).isNotNull() & F.col(item).isNotNull()).distinct()
    s = F.when(F.col(score).isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(score))))  # greatest and least skip nulls
    aggregates = [F.count(score).alias("n_scored"), F.max(s).alias("max_score"), F.avg(s).alias("mean_score"), noisy_or(s).alias("noisy_or")]
    if not by:
        return pairs.join(scores, item, "left").groupBy(unit).agg(F.count(F.lit(1)).alias("n_items"), *aggregates)
    units = pairs.groupBy(unit).agg(F.count(F.lit(1)).alias("n_items")).crossJoin(F.broadcast(scores.select(*by).distinct()))
    got = pairs.join(scores, item).groupBy(*by, unit).agg(*aggregates)
    return units.join(got, [*by, unit], "left").select(*by, unit, "n_items", F.coalesce("n_scored", F.lit(0)).alias("n_scored"), "max_score", "mean_score", "noisy_or")


def best_of(df: DataFrame, by: Sequence[str], choice: str, value: str, order: str) -> DataFrame:
    """The choice with the largest value in each group; of equal ones that which
    comes first in order."""
    return df.groupBy(*by).agg(F.max_by(F.struct(choice, value), F.struct(F.col(value), -F.col(order))).alias("__b")).select(*by, f"__b.{choice}", f"__b.{value}")


def draw_clusters(clusters: DataFrame, cluster: str, replicates: int, seed: int) -> DataFrame:
    """(cluster, times): how often each cluster is drawn in each replicate, as an
    array of replicates counts.

    Every replicate draws as many clusters, with replacement, as there are.  Draw
    k of replicate r is the cluster numbered floor(u C) of C, where u comes from
    the SHA-256 of seed:r:k and clusters are numbered by the SHA-256 of their
    name, so the draws depend on the names alone and are made where the
    clusters are.
    """
    names = clusters.select(F.col(cluster).cast("string").alias("__c")).filter("__c is not null").distinct()
    numbered = running_sum(names, [], F.sha2("__c", 256), F.lit(1), ["__c"], "__k").withColumn("__k", F.col("__k").cast("bigint"))
    total = names.agg(F.count(F.lit(1)).alias("__n"))
    slots = numbered.select(F.col("__k").alias("__slot")).join(F.broadcast(total)).withColumn("__r", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))))
    u = digest_uniform(F.sha2(F.concat_ws(":", F.lit(str(seed)), F.col("__r"), F.col("__slot")), 256))
    drawn = slots.select("__r", F.floor(u * F.col("__n")).alias("__k")).groupBy("__k", "__r").agg(F.count(F.lit(1)).cast("int").alias("__t"))
    per = drawn.groupBy("__k").agg(F.map_from_entries(F.collect_list(F.struct("__r", "__t"))).alias("__m"))
    times = F.transform(F.sequence(F.lit(0), F.lit(replicates - 1)), lambda r: F.coalesce(F.try_element_at("__m", r), F.lit(0)))
    return numbered.join(per, "__k").select(F.col("__c").alias(cluster), times.alias("times"))


def bootstrap_values(df: DataFrame, model: str, score: str, label: str, cluster: str, replicates: int = 200, seed: int = 0) -> DataFrame:
    """(model, replicate, ap): average precision in each replicate of resampled
    clusters, null without positives.

    The rows are first summed up per model, cluster and score, and every model
    is cut into slices of its scores, so that one model may be the whole table.
    A slice weighs its sums by all replicates at once; sums over slices give it
    what lies above.  Models are resampled with the same draws.
    """
    rows = df.filter(F.col(score).isNotNull() & F.col(label).isNotNull() & F.col(cluster).isNotNull()).select(F.col(model).alias("__m"), F.col(cluster).cast("string").alias("__c"), F.col(score).cast("double").alias("__s"), F.col(label).cast("double").alias("__y"))
    sums = cut(rows.groupBy("__m", "__c", "__s").agg(F.sum("__y").alias("tp"), F.count(F.lit(1)).cast("double").alias("n")))
    cuts = sums.groupBy("__m").agg(F.array_distinct(F.percentile_approx("__s", [k / SLICES for k in range(1, SLICES)], 1000)).alias("cuts"))
    placed = sums.join(cuts, "__m").select("__m", F.size(F.filter("cuts", lambda c: c > F.col("__s"))).alias("slice"), "__c", "__s", "tp", "n")
    placed = placed.repartition("__m", "slice").join(cut(draw_clusters(sums.select("__c"), "__c", replicates, seed)), "__c")
    kind = df.schema[model].dataType.simpleString()

    def weighed(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Scores of a slice from the top, and the positives and rows of each, by replicate."""
        score, at = np.unique(-t["__s"].to_numpy(), return_inverse=True)
        times = t["times"].combine_chunks().flatten().to_numpy().reshape(t.num_rows, -1)
        out = []
        for c in ("tp", "n"):
            sums, x = np.zeros((len(score), times.shape[1])), t[c].to_numpy()
            for k in range(0, len(x), 10_000):
                np.add.at(sums, at[k : k + 10_000], times[k : k + 10_000] * x[k : k + 10_000, None])
            out.append(sums)
        return score, out[0], out[1]

    def totals(t: pa.Table) -> pa.Table:
        _, tp, n = weighed(t)
        return pa.table({"__m": t["__m"][:1], "slice": t["slice"][:1], "stp": pa.array([tp.sum(0)]), "sn": pa.array([n.sum(0)])})

    def above(t: pa.Table) -> pa.Table:
        order = np.argsort(t["slice"].to_numpy())
        tp, n = (np.array(t[c].to_pylist())[order] for c in ("stp", "sn"))
        before = lambda x: pa.array(list(np.cumsum(x, 0) - x))
        return pa.table({"__m": t["__m"], "slice": t["slice"].take(pa.array(order)), "otp": before(tp), "on": before(n), "p": pa.array([tp.sum(0)] * len(order))})

    def part(t: pa.Table) -> pa.Table:
        _, tp, n = weighed(t)
        otp, on, p = (np.array(t[c][0].as_py()) for c in ("otp", "on", "p"))
        with np.errstate(divide="ignore", invalid="ignore"):
            ap = np.nansum(tp / p * (otp + np.cumsum(tp, 0)) / (on + np.cumsum(n, 0)), 0)
        return pa.table({"__m": t["__m"][:1], "ap": pa.array([np.where(p > 0, ap, np.nan)])})

    sliced = placed.groupBy("__m", "slice").applyInArrow(totals, f"__m {kind}, slice int, stp array<double>, sn array<double>")
    offsets = sliced.groupBy("__m").applyInArrow(above, f"__m {kind}, slice int, otp array<double>, on array<double>, p array<double>")
    parts = placed.join(offsets, ["__m", "slice"]).groupBy("__m", "slice").applyInArrow(part, f"__m {kind}, ap array<double>")
    flat = parts.select(F.col("__m").alias(model), F.posexplode("ap").alias("replicate", "ap")).groupBy(model, "replicate").agg(F.sum("ap").alias("ap"))
    return cut(flat.withColumn("ap", F.when(~F.isnan("ap"), F.col("ap"))))


def bootstrap_ap(df: DataFrame, model: str, score: str, label: str, cluster: str, replicates: int = 200, seed: int = 0, level: float = 0.95) -> DataFrame:
    """(model, ap, low, high, n_used): average precision and the percentile
    interval over resampled clusters (bootstrap_values).

    Replicates without positives are left out and n_used tells how many were
    used.
    """
    rows = df.filter(F.col(score).isNotNull() & F.col(label).isNotNull() & F.col(cluster).isNotNull())
    per = bootstrap_values(rows, model, score, label, cluster, replicates, seed)
    tail = (1 - level) / 2
    interval = per.filter("ap is not null").groupBy(model).agg(F.percentile("ap", F.lit(tail)).alias("low"), F.percentile("ap", F.lit(1 - tail)).alias("high"), F.count(F.lit(1)).alias("n_used"))
    own = ap_auc(rows, [model], score, label, None).select(model, "ap").join(interval, model, "left")
    return own.select(model, *[F.round(c, 9).alias(c) for c in ("ap", "low", "high")], "n_used")  # sums in another order differ in the last digits


def paired_difference(per: DataFrame, base: str, model: str, replicate: str, value: str) -> DataFrame:
    """(model, mean_difference, low, high, share_not_above) of value against the
    base model, paired by replicate; replicates in which either is null are left
    out."""
    ref = per.filter(F.col(model) == base).select(replicate, F.col(value).alias("__b"))
    diff = per.filter(F.col(model) != base).join(ref, replicate).withColumn("__d", F.col(value) - F.col("__b")).filter("__d is not null")
    return diff.groupBy(model).agg(F.avg("__d").alias("mean_difference"), F.percentile("__d", F.lit(0.025)).alias("low"), F.percentile("__d", F.lit(0.975)).alias("high"), F.avg((F.col("__d") <= 0).cast("double")).alias("share_not_above"))


def seed_pairs(runs: DataFrame, base: str, model: str, seed: str, value: str) -> DataFrame:
    """(model, n_pairs, mean_difference, sd): value of each run against those of
    the base model, paired by seed if both have the same seeds, otherwise every
    run with every other (sd null for one pair)."""
    seeds = F.array_sort(F.collect_set(seed))
    per = runs.groupBy(model).agg(seeds.alias("__seeds"))
    of = per.filter(F.col(model) == base).select(F.col("__seeds").alias("__base_seeds"))
    ref = runs.filter(F.col(model) == base).select(F.col(seed).alias("__seed"), F.col(value).alias("__b"))
    same = F.col("__seeds") == F.col("__base_seeds")
    pairs = runs.filter(F.col(model) != base).join(per, model).join(F.broadcast(of)).join(ref, ~same | (F.col(seed) == F.col("__seed")))
    d = F.col(value) - F.col("__b")
    return pairs.filter(d.isNotNull()).groupBy(model).agg(F.count(F.lit(1)).alias("n_pairs"), F.avg(d).alias("mean_difference"), F.stddev_samp(d).alias("sd"))


__all__ = ["aggregate_scores", "best_of", "bootstrap_ap", "bootstrap_values", "coverage", "draw_clusters", "noisy_or", "paired_difference", "score_table", "seed_pairs", "success_subset"]
