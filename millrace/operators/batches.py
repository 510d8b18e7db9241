"""Plans of batches: which records a training run sees, and in what order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions.keys import fresh
from millrace.operators.prefix import running_sum


def update_windows(items: DataFrame, identity: str, tokens: str, window: int, budget: int, seed: str) -> DataFrame:
    """(window, place, epoch, identity, tokens): a fixed sequence of windows of so
    many items each, over seeded permutations of all items one after the other,
    until their tokens reach the budget; the window that reaches it is the last.

    A permutation is the order of SHA-256 of seed:epoch:item, so it doesn't
    depend on the partitioning, and positions and tokens so far are running sums
    in slices of it.  Items with a null id or null tokens take no part; without
    any token there is no window.  A window may run over the end of an epoch.
    """
    if window < 1 or budget < 1:
        raise ValueError("window and budget must be positive")
    rows = items.select(F.col(identity).alias("id"), F.col(tokens).cast("bigint").alias("tokens")).filter("id is not null and tokens is not null")
    n, total = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("tokens"), F.lit(0))).first()
    if not total:
        return rows.select(F.lit(0).cast("bigint").alias("window"), F.lit(0).cast("bigint").alias("place"), F.lit(0).alias("epoch"), F.col("id").alias(identity), "tokens").limit(0)
    epochs = -(-budget // total) + -(-window // n)
    rows = rows.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(int(epochs) - 1))))
    digest = F.sha2(F.concat_ws(":", F.lit(seed), F.col("epoch"), F.col("id")), 256)
    placed = running_sum(rows, ["epoch"], digest, F.lit(1.0), ["id"], "at")
    placed = running_sum(placed, ["epoch"], digest, F.col("tokens"), ["id"], "so_far")
    place = F.col("epoch").cast("bigint") * F.lit(n) + F.col("at").cast("bigint")
    placed = placed.select((F.floor(place / F.lit(window))).cast("bigint").alias("window"), place.alias("place"), "epoch", F.col("id").alias(identity), "tokens", (F.col("epoch").cast("bigint") * F.lit(total) + F.col("so_far").cast("bigint")).alias("so_far"))
    kept = placed.groupBy("window").agg(F.min("so_far").alias("start"), F.count(F.lit(1)).alias("k")).filter((F.col("start") < budget) & (F.col("k") == window)).select("window")
    return placed.join(kept, "window").select("window", "place", "epoch", identity, "tokens")


def batch_runs(lengths: list[tuple[int, int]], budget: int) -> list[tuple[int, int, int, int]]:
    """(first position, end, items a batch, number of the first batch) of runs of
    equal batches, over items sorted by length, given as (length, items) in that
    order.  A batch takes items while their number times the longest stays
    within the budget, and one at least.  A run of equal lengths is cut up by
    arithmetic, so the work is in the distinct lengths, not in the items."""
    runs: list[tuple[int, int, int, int]] = []
    steps, at = [], 0
    for length, n in lengths:
        steps.append((at, at + n, max(length, 1)))
        at += n
    batch, pos, k = 0, 0, 0
    while pos < at:
        while steps[k][1] <= pos:
            k += 1
        own = max(1, budget // steps[k][2])
        whole = (steps[k][1] - pos) // own
        if whole:
            runs.append((pos, pos + whole * own, own, batch))
            pos, batch = pos + whole * own, batch + whole
            continue
        end, j = steps[k][1], k + 1
        while j < len(steps):
            fits = min(steps[j][1], pos + budget // steps[j][2])
            end = max(end, fits)
            if fits < steps[j][1]:
                break
            j += 1
        runs.append((pos, end, end - pos, batch))
        pos, batch = end, batch + 1
    return runs


#: Most distinct lengths; their table is made on the driver.
MOST_LENGTHS = 1_000_000


def length_batches(items: DataFrame, identity: str, length: str, budget: int) -> DataFrame:
    """(batch, identity, length): items sorted by length in batches whose padded
    size, items times the longest, stays within the budget; an item longer than
    the budget is a batch of its own.

    Equal lengths go by SHA-256 of the id.  Null ids and lengths take no part.
    Lengths are counted first; the batches follow from the counts.
    """
    if budget < 1:
        raise ValueError("budget must be positive")
    rows = items.select(F.col(identity).alias("id"), F.greatest(F.col(length).cast("bigint"), F.lit(0).cast("bigint")).alias("length")).filter(F.col("id").isNotNull() & F.col(length).isNotNull())
    counts = [(r["length"], r["n"]) for r in rows.groupBy("length").agg(F.count(F.lit(1)).alias("n")).orderBy("length").limit(MOST_LENGTHS + 1).collect()]
    if len(counts) > MOST_LENGTHS:
        raise ValueError("too many distinct lengths; round them up")
    runs = batch_runs(counts, budget)
    parts, at, r = [], 0, 0
    for value, n in counts:
        while r < len(runs) and runs[r][1] <= at:
            r += 1
        j = r
        while j < len(runs) and runs[j][0] < at + n:
            parts.append((value, at, *runs[j]))
            j += 1
        at += n
    spark = items.sparkSession
    where = spark.createDataFrame(parts, "length bigint, base bigint, first bigint, end bigint, size bigint, batch0 bigint")
    placed = running_sum(rows, ["length"], F.sha2(F.col("id").cast("string"), 256), F.lit(1.0), ["id"], fresh(rows.columns, "at"))
    position = F.col("base") + F.col("at").cast("bigint")
    joined = placed.join(F.broadcast(where), "length").withColumn("position", position).filter((F.col("position") >= F.col("first")) & (F.col("position") < F.col("end")))
    return joined.select((F.col("batch0") + F.floor((F.col("position") - F.col("first")) / F.col("size"))).cast("bigint").alias("batch"), F.col("id").alias(identity), "length")
