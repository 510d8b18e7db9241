"""The N best items of every group."""

from __future__ import annotations

from bisect import insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


class Heaps:
    """Bounded heaps, one per group, of distinct items with their best score.

    The last kept entry of a full heap is its threshold; a row below it cannot
    matter.  Merging the Heaps of parts of the data gives the Heaps of the
    whole, since an item that is beaten by n others in a part is beaten by the
    same n in the whole.  Entries are (-score, item), so that their order is
    that of the result; strings compare by code point, as in Spark.
    """

    def __init__(self, n: int):
        self.n = n
        self.of: dict[str, list[tuple[float, str]]] = {}
        self.floor: dict[str, float] = {}

    def add(self, group: str, item: str, score: float) -> None:
        best = self.of.setdefault(group, [])
        entry = (-score, item)
        if len(best) == self.n and entry >= best[-1]:
            return
        for k, (_, other) in enumerate(best):
            if other == item:
                if entry >= best[k]:
                    return
                del best[k]
                break
        insort(best, entry)
        if len(best) > self.n:
            best.pop()
        if len(best) == self.n:
            self.floor[group] = -best[-1][0]

    def rows(self) -> Iterator[tuple[str, str, float]]:
        for group, best in self.of.items():
            for lost, item in best:
                yield group, item, -lost


def partial_heaps(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    """Heaps of one partition.  Rows below the threshold of their group are
    dropped a batch at a time; only the rest is handled singly."""
    heaps = Heaps(n)
    for batch in batches:
        if not batch.num_rows:
            continue
        groups = pc.dictionary_encode(batch.column(0))
        names = groups.dictionary.to_pylist()
        codes = groups.indices.to_numpy(zero_copy_only=False)
        scores = batch.column(2).to_numpy(zero_copy_only=False)
        floor = np.array([heaps.floor.get(g, -np.inf) for g in names])
        keep = np.flatnonzero(scores >= floor[codes])
        order = keep[np.argsort(-scores[keep], kind="stable")]  # best first, so that thresholds rise early
        items = batch.column(1).take(pa.array(order)).to_pylist()
        for code, item, score in zip(codes[order].tolist(), items, scores[order].tolist(), strict=True):
            group = names[code]
            if score >= heaps.floor.get(group, -np.inf):
                heaps.add(group, item, score)
    out: list[tuple[str, str, float]] = []
    for row in heaps.rows():
        out.append(row)
        if len(out) == 10_000:
            yield _batch(out)
            out = []
    if out:
        yield _batch(out)


def _batch(rows: list[tuple[str, str, float]]) -> pa.RecordBatch:
    g, i, s = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(g, pa.string()), pa.array(i, pa.string()), pa.array(s, pa.float64())], names=["grp", "item", "score"])


def top_n(df: DataFrame, group: str, item: str, score: str, n: int) -> DataFrame:
    """(group, item, score, rank) of the n best distinct items of every group.

    Items are ordered by score from high to low, then by item from low to high
    (code points).  An item counts once, with its highest score.  Rows with a
    null group, item or score, or a score that is not finite, do not count.  A
    group with fewer than n items gives all; a group without a valid row gives
    none.  Group and item compare as given, so normalise identifiers before.

    Each input partition keeps a bounded heap per group, so at most n rows per
    group and partition are shuffled, however large the group; the heaps are
    merged by the same rule.
    """
    if n < 1:
        raise ValueError("n must be at least 1")
    x = F.col(score).cast("double")
    rows = df.select(F.col(group).cast("string").alias("grp"), F.col(item).cast("string").alias("item"), (x + F.lit(0.0)).alias("score"))
    rows = rows.filter(F.col("grp").isNotNull() & F.col("item").isNotNull() & F.col("score").isNotNull() & ~F.isnan("score") & (F.abs("score") < F.lit(float("inf"))))
    heaps = rows.mapInArrow(lambda batches: partial_heaps(batches, n), "grp string, item string, score double")
    merged = heaps.groupBy("grp", "item").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("grp").orderBy(F.desc("score"), "item"))
    return merged.withColumn("rank", rank).filter(F.col("rank") <= n).select(F.col("grp").alias(group), F.col("item").alias(item), F.col("score").alias(score), "rank")

