"""Splits in which related records stay together."""

from __future__ import annotations

import uuid
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.durable import children, cut, ensure_checkpoint_dir
from millrace.operators.prefix import running_sum
from millrace.sources.writers import commit_generation, current_generation

#: A component of at least this share of all records is placed singly; there
#: can be no more than its inverse.
SINGLE_SHARE = 1 / 200
#: The fractional part of the golden ratio, whose multiples modulo
#: 1 fill the unit interval evenly at any length, and the inverse of the plastic
#: ratio, which shifts the sequence from band to band.
GOLDEN, PLASTIC = 0.6180339887498949, 0.7548776662466927


def spanning_forest(edges: DataFrame, a: str, b: str, known: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Boruvka contraction: (vertex, root) of every vertex and the forest (a, b).

    known: (vertex, root) of a forest that is there already; only edges between
    its trees and to new vertices are then contracted, and the forest is what
    they add.

    Each round every component picks its least outgoing edge (by hash, then
    ends: a strict order, so picks form trees but for pairs that pick the same
    edge), the picked trees are contracted by pointer jumping, and edges within
    a component and parallel edges go.  Components at least halve each round.
    All steps are joins and mergeable minima over labels; the state of each
    round is written to the shared checkpoint folder.  Root is the least label
    of the tree's closing pair.  Null ends are ignored; loops only name their
    vertex.  Both results are empty for an empty table.
    """
    pairs = edges.select(F.col(a).cast("string").alias("a"), F.col(b).cast("string").alias("b")).filter(F.col("a").isNotNull() & F.col("b").isNotNull()).distinct()
    pairs = cut(pairs.withColumn("w", F.xxhash64("a", "b")))
    roots = pairs.select(F.col("a").alias("vertex")).union(pairs.select("b")).distinct().withColumn("root", F.col("vertex"))
    if known is not None:
        roots = roots.select("vertex").union(known.select("vertex")).distinct().join(known.select("vertex", F.col("root").alias("__r")), "vertex", "left").select("vertex", F.coalesce("__r", "vertex").alias("root"))
    roots = cut(roots)
    live = pairs.filter("a <> b").select(F.col("a").alias("u"), F.col("b").alias("v"), "w", "a", "b")
    if known is not None:
        of = lambda c, e: roots.select(F.col("vertex").alias(e), F.col("root").alias(c))
        live = live.drop("u", "v").join(of("u", "a"), "a").join(of("v", "b"), "b").filter("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"), F.struct("w", "a", "b").alias("e"))
        live = cut(live.groupBy("u", "v").agg(F.min("e").alias("e")).select("u", "v", "e.w", "e.a", "e.b"))
    forest = live.select("a", "b").limit(0)
    while not live.isEmpty():
        ends = live.select("u", F.struct("w", "a", "b", "v").alias("e")).union(live.select("v", F.struct("w", "a", "b", F.col("u").alias("v"))))
        picked = cut(ends.groupBy("u").agg(F.min("e").alias("e")).select("u", F.col("e.v").alias("up"), F.col("e.a").alias("a"), F.col("e.b").alias("b")))
        forest = forest.union(picked.select("a", "b").distinct())
        up = _contract(picked.select("u", "up"))
        roots = cut(roots.join(up.withColumnRenamed("u", "root"), "root", "left").select("vertex", F.coalesce("up", "root").alias("root")))
        live = live.join(up.select("u", F.col("up").alias("nu")), "u").join(up.select(F.col("u").alias("v"), F.col("up").alias("nv")), "v")
        live = live.filter("nu <> nv").select(F.least("nu", "nv").alias("u"), F.greatest("nu", "nv").alias("v"), F.struct("w", "a", "b").alias("e"))
        live = cut(live.groupBy("u", "v").agg(F.min("e").alias("e")).select("u", "v", "e.w", "e.a", "e.b"))
    return roots, forest


def stored_forest(edges: DataFrame, a: str, b: str, folder: str) -> DataFrame:
    """(vertex, root) of a forest kept below folder (of any file system that all
    executors share): what is there is extended by the edges, which need only be
    the new ones, and written as the next generation before it is used.  The
    component of a vertex only ever grows."""
    spark = edges.sparkSession
    base = folder.rstrip("/")
    known = current_generation(spark, f"{base}/roots") if children(spark, f"{base}/roots") else None
    roots, forest = spanning_forest(edges, a, b, known)
    if known is not None:
        forest = forest.unionByName(current_generation(spark, f"{base}/forest"))
    commit_generation(forest, f"{base}/forest")
    commit_generation(roots, f"{base}/roots")
    return current_generation(spark, f"{base}/roots")


def _contract(up: DataFrame) -> DataFrame:
    """(u, root) from (u, up), whose only cycles are pairs that point at each
    other; the smaller of such a pair is the root."""
    over = up.select(F.col("u").alias("up"), F.col("up").alias("top"))
    step = F.when((F.col("top") == F.col("u")) & (F.col("u") < F.col("up")), F.col("u")).otherwise(F.col("up"))
    up = cut(up.join(over, "up").select("u", step.alias("up")))
    while True:
        over = up.select(F.col("u").alias("up"), F.col("up").alias("top"))
        jumped = cut(up.join(over, "up").select("u", F.col("top").alias("up"), (F.col("top") != F.col("up")).alias("moved")))
        moved = jumped.filter("moved").isEmpty()
        up = jumped.select("u", "up")
        if moved:
            return up


def deal(components: DataFrame, root: str, size: str, shares: Mapping[str, float], seed: str = "millrace") -> DataFrame:
    """components with column split.

    Components of at least SINGLE_SHARE of all records (at most 200) are placed
    one by one, largest first: among the splits that still want so many, where
    the largest part of the share is wanting, else where most is.  The others are
    stratified by size (bands of powers of two), ordered by a seeded hash
    within each band and dealt out in turn by their position, so every split
    gets its share of every size, up to the share still wanting after the large
    ones.  Shares are proportions (their sum need not be 1).  A table without
    rows gives none.
    """
    whole = sum(shares.values())
    if whole <= 0 or min(shares.values()) < 0:
        raise ValueError("shares must not be negative, and not all zero")
    total = components.agg(F.sum(size)).first()[0] or 0
    bound = F.lit(total * SINGLE_SHARE)
    wanting = {s: p / whole * total for s, p in shares.items()}
    single: dict[str, str] = {}
    for r in components.filter(F.col(size) >= bound).orderBy(F.desc(size), root).collect():
        fits = [s for s in wanting if wanting[s] >= r[size]]
        best = max(fits, key=lambda s: (wanting[s] / shares[s], shares[s], s)) if fits else max(wanting, key=lambda s: (wanting[s], s))
        wanting[best] -= r[size]
        single[r[root]] = best
    left = {s: max(w, 0.0) for s, w in wanting.items()}
    rest = sum(left.values()) or 1.0
    spark = components.sparkSession
    placed = spark.createDataFrame(list(single.items()) or [], "root string, split string").withColumnRenamed("root", root)
    large = components.filter(F.col(size) >= bound).join(placed, root, "left")
    small = components.filter(F.col(size) < bound).withColumn("__band", F.floor(F.log2(F.col(size).cast("double"))))
    ranked = running_sum(small, ["__band"], F.sha2(F.concat_ws(":", F.lit(seed), F.col(root)), 256), F.lit(1.0), [root], "__at")
    u = (F.col("__at") + F.lit(0.5)) * F.lit(GOLDEN) + F.col("__band") * F.lit(PLASTIC)
    u = u - F.floor(u)
    split, edge = F.lit(None).cast("string"), 0.0
    bounds: list[tuple[float, str]] = []
    for s, w in left.items():
        edge += w / rest
        bounds.append((edge, s))
    chosen = next((s for e, s in reversed(bounds) if left[s] > 0), next(iter(shares)))
    split = F.lit(chosen)
    for e, s in reversed(bounds):
        if left[s] > 0:
            split = F.when(u < F.lit(e), s).otherwise(split)
    return large.unionByName(ranked.withColumn("split", split).drop("__at", "__band"))


def assign_splits(records: DataFrame, id_column: str, ties: DataFrame, tie_id: str, tie_group: str, shares: Mapping[str, float], seed: str = "millrace", folder: str | None = None) -> DataFrame:
    """(id, component, n_records, split) for every distinct id of records and ties.

    The spanning forest is kept below folder (a new one in the session's shared
    checkpoint folder, if not given); a later run with the same folder contracts
    only the ties that it adds, and keeps the components that were tied.

    Ids that share a group, directly or through other ids, get one split.  Ids
    and groups compare as given; null ids are left out and null groups tie
    nothing.  Repeated rows count once.  Extra columns are ignored.
    """
    tied = ties.select(F.col(tie_id).alias("i"), F.col(tie_group).alias("g")).filter(F.col("i").isNotNull() & F.col("g").isNotNull())
    roots = stored_forest(_bipartite(tied), "a", "b", folder or _new_folder(records))
    ids = records.select(F.col(id_column).alias("i")).union(ties.select(F.col(tie_id))).filter(F.col("i").isNotNull()).distinct()
    own = roots.filter(F.col("vertex").startswith("i:")).select(F.substring("vertex", 3, 1 << 30).alias("i"), "root")
    members = cut(ids.join(own, "i", "left").select("i", F.coalesce("root", F.concat(F.lit("i:"), F.col("i"))).alias("component")))
    sizes = cut(members.groupBy("component").agg(F.count(F.lit(1)).alias("n_records")))
    dealt = deal(sizes, "component", "n_records", shares, seed)
    return members.join(dealt, "component").select(F.col("i").alias(id_column), "component", "n_records", "split")


def _new_folder(df: DataFrame) -> str:
    return f"{ensure_checkpoint_dir(df.sparkSession).rstrip('/')}/forest-{uuid.uuid4().hex}"


def _bipartite(tied: DataFrame) -> DataFrame:
    """Ids and groups as vertices: a group of any size costs one edge a row."""
    return tied.select(F.concat(F.lit("i:"), F.col("i")).alias("a"), F.concat(F.lit("g:"), F.col("g")).alias("b"))


def torn_groups(ties: DataFrame, tie_id: str, tie_group: str, splits: DataFrame, split_id: str, split: str, folder: str | None = None) -> DataFrame:
    """(group) of every group whose related ids stand in more than one split.
    The forest is kept as in assign_splits.

    Relation carries on through shared ids and groups.  Ids without a split
    relate others and don't count.  Null ids, groups and splits are ignored.
    """
    tied = ties.select(F.col(tie_id).alias("i"), F.col(tie_group).alias("g")).filter(F.col("i").isNotNull() & F.col("g").isNotNull())
    roots = stored_forest(_bipartite(tied), "a", "b", folder or _new_folder(ties))
    stand = splits.select(F.concat(F.lit("i:"), F.col(split_id)).alias("vertex"), F.col(split).alias("s")).filter(F.col("vertex").isNotNull() & F.col("s").isNotNull())
    torn = roots.join(stand, "vertex").groupBy("root").agg(F.min("s").alias("lo"), F.max("s").alias("hi")).filter("lo <> hi").select("root")
    groups: Column = F.substring("vertex", 3, 1 << 30)
    return roots.filter(F.col("vertex").startswith("g:")).join(torn, "root", "left_semi").select(groups.alias(tie_group))
