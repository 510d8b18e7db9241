"""Splits by time, by exclusion and by quota, and hash samples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.keys import digest_uniform, salted_digest
from millrace.operators.dedup import components
from millrace.operators.prefix import running_sum

#: Reason codes of the temporal split, as consumers know them.
CROSSES, LATE, DUPLICATE = "crosses_split", "label_late", "duplicate_patch"


def nested_fraction(identity: Column, salt: str, fraction: float) -> Column:
    """Whether a record falls in the fraction: smaller fractions are contained
    in larger ones under the same salt."""
    return digest_uniform(salted_digest(salt, identity), 15) < F.lit(float(fraction))


def hash_sample(df: DataFrame, identity: str, salt: str, n: int) -> DataFrame:
    """The n records with the least salted digest: a top-n over the partitions,
    not a full sort.  Ties of repeated records go by identity."""
    return df.withColumn("__d", salted_digest(salt, F.col(identity))).orderBy("__d", identity).limit(n).drop("__d")


def quota_rows(df: DataFrame, identity: str, salt: str, share: float) -> DataFrame:
    """df with chosen: true for exactly round(share x n) records (half to even)
    of the least salted digest."""
    total = df.agg(F.bround(F.count(F.lit(1)) * F.lit(share), 0).alias("__quota"))
    ranked = running_sum(df, [], salted_digest(salt, F.col(identity)), F.lit(1.0), [identity], "__rank")
    return ranked.join(F.broadcast(total)).withColumn("chosen", F.col("__rank") < F.col("__quota")).drop("__rank", "__quota")


def quota_groups(df: DataFrame, identity: str, group: str, salt: str, share: float) -> DataFrame:
    """df with chosen: whole groups, in the order of the digest of their least
    identity, as long as fewer than round(share x n) records were chosen before."""
    groups = df.groupBy(group).agg(F.min(identity).alias("__first"), F.count(F.lit(1)).alias("__size"))
    total = df.agg(F.bround(F.count(F.lit(1)) * F.lit(share), 0).alias("__quota"))
    ranked = running_sum(groups, [], salted_digest(salt, F.col("__first")), F.col("__size"), ["__first"], "__before")
    picked = ranked.join(F.broadcast(total)).select(F.col(group).alias("__g"), (F.col("__before") < F.col("__quota")).alias("chosen"))
    return df.join(picked, F.col(group).eqNullSafe(F.col("__g"))).drop("__g")


def budget_cut(df: DataFrame, salt: str, identity: str, size: str, budget: float) -> DataFrame:
    """The records, in digest order, before which less than the budget was used:
    the record that crosses the budget is the last one taken."""
    return running_sum(df, [], salted_digest(salt, F.col(identity)), F.col(size), [identity], "__before").filter(F.col("__before") < F.lit(float(budget))).drop("__before")


def role_by_time(time: Column, train_before: str, valid_before: str) -> Column:
    t1, t2 = F.lit(train_before).cast("timestamp"), F.lit(valid_before).cast("timestamp")
    return F.when(time < t1, "train").when(time < t2, "valid").otherwise("test")


def temporal_split(df: DataFrame, identity: str, time: str, label_time: str, patch: str, ties: Sequence[str], train_before: str, valid_before: str) -> DataFrame:
    """(identity, role, reason): records dealt to train, valid and test by time.

    A component of records that share a tie or patch and falls into more than
    one role is rejected whole (crosses_split).  Of the rest, a label that
    wasn't there at the cutoff of its role (train, valid) is rejected
    (label_late); an unknown label time is too.  Of the records left in a
    component, the first by (time, identity) with a patch keeps it, the others
    are rejected (duplicate_patch).  Rejected late records don't claim a patch.
    A null patch is no duplicate.  reason is null where the record is kept.
    A record may have several rows that differ in their ties alone: it is tied
    through each of them and dealt once.
    """
    comp = components(df, identity, [*ties, patch])
    rows = df.select(identity, time, label_time, patch).distinct().withColumn("role", role_by_time(F.col(time), train_before, valid_before))
    rows = rows.join(comp, identity)
    spread = rows.groupBy("component").agg((F.min("role") < F.max("role")).alias("crosses"))
    rows = rows.join(spread, "component")
    cutoff = F.when(F.col("role") == "train", F.lit(train_before).cast("timestamp")).when(F.col("role") == "valid", F.lit(valid_before).cast("timestamp"))
    late = cutoff.isNotNull() & F.coalesce(F.col(label_time) > cutoff, F.lit(True))
    rows = rows.withColumn("__fine", ~F.col("crosses") & ~late).withColumn("__late", late)
    first = rows.filter("__fine").groupBy("component", patch).agg(F.min(F.struct(time, identity))[identity].alias("__first")).withColumnsRenamed({"component": "__c", patch: "__p"})
    rows = rows.join(first, (F.col("component") == F.col("__c")) & (F.col(patch) == F.col("__p")), "left")
    reason = F.when(F.col("crosses"), CROSSES).when(F.col("__late"), LATE).when(F.col(patch).isNotNull() & (F.col("__first") != F.col(identity)), DUPLICATE)
    return rows.select(identity, "role", reason.alias("reason"))


def controlled_exclusions(keys: DataFrame, identity: str, split: str, exact: str, code: str) -> DataFrame:
    """(identity, reason) of training records whose exact or code key also stands
    in another split; exact comes before code."""
    other = keys.filter(F.col(split) != "train")
    e = other.select(F.col(exact).alias("__e")).filter("__e is not null").distinct().withColumn("__he", F.lit(True))
    c = other.select(F.col(code).alias("__c")).filter("__c is not null").distinct().withColumn("__hc", F.lit(True))
    train = keys.filter(F.col(split) == "train").join(e, F.col(exact) == F.col("__e"), "left").join(c, F.col(code) == F.col("__c"), "left")
    reason = F.when(F.col("__he"), "exact_duplicate_in_eval").when(F.col("__hc"), "code_duplicate_in_eval")
    return train.select(identity, reason.alias("reason")).filter("reason is not null")


def near_duplicate_leak(rows: DataFrame, split: str, key: str, label: str) -> DataFrame:
    """(split, n, n_matched, n_agree): evaluation records whose key stands in the
    training split, and those whose label is that of the training majority
    (half to even).  A null label matches as any other but never agrees."""
    build = rows.filter((F.col(split) == "train") & F.col(key).isNotNull()).groupBy(key).agg(F.bround(F.avg(label), 0).alias("__major"), F.count(F.lit(1)).alias("__there"))
    probe = rows.filter(F.col(split) != "train").join(build, key, "left")
    return probe.groupBy(split).agg(F.count(F.lit(1)).alias("n"), F.count("__there").alias("n_matched"), F.count_if(F.col("__major") == F.col(label)).alias("n_agree"))


def first_per(df: DataFrame, by: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """The first row of every group in an order; Spark limits each group before
    the shuffle."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter("__n = 1").drop("__n")
