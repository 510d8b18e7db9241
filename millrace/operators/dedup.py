"""Duplicate keys, groups of duplicates and their connected components."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.durable import cut


def lines_of(edits: DataFrame, identity: str, order: str, op: str, text: str) -> DataFrame:
    """(identity, added, deleted): the lines of each record by operation, in
    their order (equal places by text).  A record's lines are one value here."""
    pick = lambda kind: F.transform(F.array_sort(F.collect_list(F.when(F.col(op) == kind, F.struct(order, text)))), lambda x: x[text])
    return edits.groupBy(identity).agg(pick("add").alias("added"), pick("delete").alias("deleted"))


def _lists(*parts: Column) -> Column:
    """A digest of lists of texts that no regrouping of their items shares."""
    item = lambda x: F.concat(F.length(F.coalesce(x, F.lit(""))).cast("string"), F.lit(":"), F.coalesce(x, F.lit("")))
    return F.sha2(F.concat_ws("\u001e", *[F.array_join(F.transform(p, item), "\u001f") for p in parts]), 256)


def duplicate_keys(records: DataFrame, identity: str, message: str, lines: DataFrame) -> DataFrame:
    """(identity, exact_key, code_key, normalized_key, n_add, n_del).

    exact: message and lines as they are; code: the lines alone, null without
    lines; normalized: message and lines without surrounding or repeated white
    space, lines in code-point order.
    """
    squeeze = lambda x: F.trim(F.regexp_replace(x, r"(?U)\s+", " "))
    r = records.select(identity, F.coalesce(message, F.lit("")).alias("__m")).join(lines, identity, "left")
    empty = F.array().cast("array<string>")
    a, b = F.coalesce("added", empty), F.coalesce("deleted", empty)
    tidy = lambda x: F.array_sort(F.transform(x, squeeze))
    return r.select(
        identity, _lists(F.array("__m"), a, b).alias("exact_key"), F.when(F.size(a) + F.size(b) > 0, _lists(a, b)).alias("code_key"),
        _lists(F.array(squeeze(F.col("__m"))), tidy(a), tidy(b)).alias("normalized_key"), F.size(a).alias("n_add"), F.size(b).alias("n_del"),
    )


def group_statistics(keys: DataFrame, names: Sequence[str], split: str, label: str) -> DataFrame:
    """(key, n_rows, n_groups, n_cross_split, n_label_conflicts) of the groups of
    more than one row that share a key; null keys don't count.  All keys are
    counted in one pass."""
    long = keys.select(F.explode(F.array(*[F.struct(F.lit(n).alias("key"), F.col(n).alias("value")) for n in names])).alias("k"), split, label).select("k.key", "k.value", split, label).filter("value is not null")
    g = long.groupBy("key", "value").agg(F.count(F.lit(1)).alias("n"), F.min(split).alias("s0"), F.max(split).alias("s1"), F.min(label).alias("l0"), F.max(label).alias("l1"))
    many = F.col("n") > 1
    return g.groupBy("key").agg(
        F.coalesce(F.sum(F.when(many, F.col("n"))), F.lit(0)).alias("n_rows"), F.count_if(many).alias("n_groups"), F.count_if(many & (F.col("s0") < F.col("s1"))).alias("n_cross_split"), F.count_if(many & (F.col("l0") < F.col("l1"))).alias("n_label_conflicts")
    )


def cross_split_pairs(keys: DataFrame, key: str, split: str) -> DataFrame:
    """(pair, n): groups of equal keys that span two splits, per unordered pair
    of split names; a group counts once for each pair."""
    g = keys.filter(F.col(key).isNotNull() & F.col(split).isNotNull()).groupBy(key).agg(F.array_sort(F.collect_set(split)).alias("s")).filter(F.size("s") > 1)
    a = g.select("s", F.posexplode("s").alias("i", "a"))
    b = a.select("a", F.explode(F.slice("s", F.col("i") + 2, F.size("s"))).alias("b"))
    return b.groupBy(F.concat_ws("-", "a", "b").alias("pair")).agg(F.count(F.lit(1)).alias("n"))


def components(df: DataFrame, identity: str, keys: Sequence[str]) -> DataFrame:
    """(identity, component): records joined through equal values of any key;
    the component is named by its least identity.  Null values join nothing.

    Labels are lowered to the least of each key value and then to the label of
    that label (pointer jumping), so long chains close in few rounds; both steps
    are mergeable minima and joins.
    """
    pairs = df.select(F.col(identity).alias("id"), F.explode(F.array(*[F.when(F.col(k).isNotNull(), F.concat(F.lit(f"{i}:"), F.col(k).cast("string"))) for i, k in enumerate(keys)])).alias("k")).filter("id is not null and k is not null").distinct()
    shared = pairs.groupBy("k").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("k")
    pairs = cut(pairs.join(shared, "k"))
    label = cut(df.select(F.col(identity).alias("id")).filter("id is not null").distinct().withColumn("c", F.col("id")))
    while True:
        near = pairs.join(label, "id")
        least = near.groupBy("k").agg(F.min("c").alias("m"))
        low = pairs.join(least, "k").groupBy("id").agg(F.min("m").alias("m"))
        lowered = cut(label.join(low, "id", "left").select("id", F.least("c", F.coalesce("m", "c")).alias("n"), "c"))
        over = lowered.select(F.col("id").alias("n"), F.col("n").alias("top"))
        new = cut(lowered.join(over, "n").select("id", F.least("n", "top").alias("c"), (F.least("n", "top") != F.col("c")).alias("moved")))
        done = new.filter("moved").isEmpty()
        label = new.select("id", "c")
        if done:
            return label.select(F.col("id").alias(identity), F.col("c").alias("component"))


def column_profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(name, n_null, n_nan, n_negative, low, median, high) of numeric columns in
    one pass; nulls and NaN don't enter the last three."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("x")) for c in columns])).alias("e")).select("e.*")
    fine = F.when(~F.isnan("x"), F.col("x"))
    return long.groupBy("name").agg(
        F.count_if(F.col("x").isNull()).alias("n_null"), F.count_if(F.isnan("x")).alias("n_nan"), F.count_if(fine < 0).alias("n_negative"), F.min(fine).alias("low"), F.percentile(fine, F.lit(0.5)).alias("median"), F.max(fine).alias("high")
    )


def content_counts(records: DataFrame, message: str, n_add: str, n_del: str) -> DataFrame:
    """One row: records, empty messages, add-only, delete-only, without lines,
    and the median numbers of lines."""
    a, b = F.col(n_add), F.col(n_del)
    return records.agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.trim(F.coalesce(message, F.lit(""))) == "").alias("empty_message"), F.count_if((a > 0) & (b == 0)).alias("add_only"), F.count_if((a == 0) & (b > 0)).alias("delete_only"),
        F.count_if((a == 0) & (b == 0)).alias("no_lines"), F.percentile(a, F.lit(0.5)).alias("median_add"), F.percentile(b, F.lit(0.5)).alias("median_del"),
    )
