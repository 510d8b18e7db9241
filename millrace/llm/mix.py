"""A mix of sources with given shares of all tokens.

Documents of equal text are one document that belongs to every source in which
it stands.  Documents are summed up by the set of sources they belong to, their
membership pattern; a min-cost flow on the driver, over patterns and sources
only, decides how many tokens of each pattern count for which source and how
often patterns repeat; documents are then chosen by a seeded hash on the
cluster.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.durable import cut
from millrace.functions.keys import id_key, salted_digest
from millrace.operators.prefix import running_sum

#: The flow is solved for at most so many patterns, and for no more sources.
MOST = 10_000
SEPARATOR = "\u0001"


def min_cost_flow(supply: Mapping[str, int], member: Mapping[str, Sequence[str]], repeats: Mapping[str, int], quota: Mapping[str, int]) -> dict[tuple[str, str], int]:
    """Tokens of each pattern that count for each source: the largest total
    flow under the quotas, and of those the one with the least cost.

    A pattern's tokens may be used up to the largest number of repeats of its
    sources, for one source up to that source's; the k-th use of the same
    tokens costs k squared, so use is spread before it is repeated.  Successive
    shortest augmenting paths on the residual graph.
    """
    cap: dict[tuple[str, str, int], int] = {}
    cost: dict[tuple[str, str, int], int] = {}
    out: dict[str, list[tuple[str, str, int]]] = {}

    def arc(u: str, v: str, k: int, c: int, w: int) -> None:
        cap[u, v, k], cost[u, v, k] = c, w
        cap[v, u, ~k], cost[v, u, ~k] = 0, -w
        out.setdefault(u, []).append((u, v, k))
        out.setdefault(v, []).append((v, u, ~k))

    for p, tokens in supply.items():
        for k in range(max((repeats[s] for s in member[p]), default=0)):
            arc("from", f"p{p}", k, tokens, (k + 1) ** 2)
        for s in member[p]:
            arc(f"p{p}", f"s{s}", 0, tokens * repeats[s], 0)
    for s, q in quota.items():
        arc(f"s{s}", "to", 0, q, 0)
    while True:
        best, via = {"from": 0}, {}
        queue = ["from"]
        while queue:
            nxt = []
            for u in queue:
                for a in out.get(u, ()):
                    d = best[u] + cost[a]
                    if cap[a] > 0 and d < best.get(a[1], math.inf):
                        best[a[1]], via[a[1]] = d, a
                        nxt.append(a[1])
            queue = list(dict.fromkeys(nxt))
        if "to" not in via:
            break
        path, node = [], "to"
        while node != "from":
            path.append(via[node])
            node = via[node][0]
        push = min(cap[a] for a in path)
        for u, v, k in path:
            cap[u, v, k] -= push
            cap[v, u, ~k] += push
    return {(p, s): used for p in supply for s in member[p] if (used := cap[f"s{s}", f"p{p}", ~0]) > 0}


def quotas(total: float, shares: Mapping[str, float]) -> dict[str, int]:
    whole = sum(shares.values())
    return {s: int(total * w / whole) for s, w in shares.items()} if whole > 0 else dict.fromkeys(shares, 0)


def largest_total(supply: Mapping[str, int], member: Mapping[str, Sequence[str]], repeats: Mapping[str, int], shares: Mapping[str, float]) -> float:
    """The largest number of tokens at which every source reaches its share."""
    wanted = {s: w for s, w in shares.items() if w > 0}
    if not wanted:
        return 0.0
    room = {s: sum(t for p, t in supply.items() if s in member[p]) * repeats[s] for s in wanted}
    high = min(room[s] / (w / sum(wanted.values())) for s, w in wanted.items())
    full = lambda t: sum(min_cost_flow(supply, member, repeats, q := quotas(t, wanted)).values()) >= sum(q.values())
    if full(high):
        return high
    low = 0.0
    for _ in range(40):
        mid = (low + high) / 2
        low, high = (mid, high) if full(mid) else (low, mid)
    return low


class Mix:
    """The mix of documents (id, source, text, tokens) by targets (source,
    target_share, max_repeats).

    selection: (id, source, tokens, uses), one row per chosen document and the
    source it counts for.  report: (source, target_share, actual_share, tokens,
    available_tokens, n_documents, n_uses) of every target source.

    total: size of the mix in tokens; without it, the largest at which every
    source that has tokens reaches its share.  Sources without tokens reach 0,
    and the others share the whole in proportion.  A given total that can't be
    reached is filled as far as repeats allow, and the report shows it.  A share
    is met to within half a document at either end of its run.  Beyond most
    membership patterns the heaviest are kept as they are, and a document of
    another counts for one of its sources, chosen by a hash of its text.  Sources compare
    without case and surrounding space.  Documents without a source, of a
    source without a target, or without tokens are never chosen.  Target rows
    of the same source are added up (the largest max_repeats holds); a null
    share is 0, a null max_repeats 1.  Of equal texts in one source the one
    with the smallest id is used.
    """

    def __init__(self, documents: DataFrame, id_column: str, targets: DataFrame, total: float | None = None, seed: str = "millrace", most: int = MOST):
        spark = documents.sparkSession
        rows = targets.select(id_key(F.col("source")).alias("source"), F.coalesce("target_share", F.lit(0.0)).alias("w"), F.coalesce("max_repeats", F.lit(1)).alias("r"))
        wanted = rows.filter("source is not null").groupBy("source").agg(F.sum("w").alias("w"), F.max("r").alias("r")).orderBy("source").limit(MOST + 1).collect()
        if len(wanted) > most:
            raise ValueError(f"more than {MOST} target sources")
        self.shares = {r["source"]: float(r["w"]) for r in wanted}
        repeats = {r["source"]: max(0, int(r["r"])) for r in wanted}
        goal = spark.createDataFrame([(s, w) for s, w in self.shares.items()], "source string, target_share double")

        docs = documents.select(F.col(id_column).alias("id"), id_key(F.col("source")).alias("source"), F.sha2("text", 256).alias("text"), "tokens").filter(F.col("tokens") > 0)
        docs = docs.join(F.broadcast(goal.select("source")), "source", "left_semi")
        held = docs.groupBy("text", "source").agg(F.min("id").alias("id"), F.max("tokens").alias("tokens"))
        units = held.groupBy("text").agg(F.array_sort(F.collect_list(F.struct("source", "id"))).alias("in"), F.max("tokens").alias("tokens"))
        units = cut(units.select("text", "tokens", "in", F.array_join(F.col("in.source"), SEPARATOR).alias("pattern")))
        heavy = units.groupBy("pattern").agg(F.sum("tokens").alias("tokens"))
        patterns = heavy.limit(most + 1).collect()
        if len(patterns) > most:
            kept = heavy.orderBy(F.desc("tokens"), "pattern").limit(max(most - len(wanted), 0)).select(F.col("pattern").alias("kept"))
            one = F.get(F.col("in.source"), F.pmod(F.xxhash64("text"), F.size("in")).cast("int"))
            units = cut(units.join(F.broadcast(kept), F.col("pattern") == F.col("kept"), "left").withColumn("pattern", F.coalesce("kept", one)).drop("kept"))
            patterns = units.groupBy("pattern").agg(F.sum("tokens").alias("tokens")).collect()
        supply = {r["pattern"]: int(r["tokens"]) for r in sorted(patterns, key=lambda r: r["pattern"])}
        member = {p: p.split(SEPARATOR) for p in supply}
        available = {s: w for s, w in self.shares.items() if repeats[s] > 0 and any(s in m for m in member.values())}
        self.total = largest_total(supply, member, repeats, available) if total is None else float(total)
        flow = min_cost_flow(supply, member, repeats, quotas(self.total, available))

        runs, at = [], dict.fromkeys(supply, 0)
        for (p, s), used in sorted(flow.items()):
            runs.append((p, s, float(at[p]), float(at[p] + used), float(supply[p])))
            at[p] += used
        spans = spark.createDataFrame(runs, "pattern string, source string, lo double, hi double, whole double")
        placed = running_sum(units, ["pattern"], salted_digest(seed, F.col("text")), F.col("tokens"), ["text"])
        middle = F.col("before") + F.col("tokens") / 2
        uses = (F.ceil((F.col("hi") - middle) / F.col("whole")) - F.ceil((F.col("lo") - middle) / F.col("whole"))).cast("bigint")
        chosen = placed.join(F.broadcast(spans), "pattern").withColumn("uses", uses).filter("uses > 0")
        own = F.filter("in", lambda x: x["source"] == F.col("source"))[0]["id"]
        self.selection = chosen.select(own.alias(id_column), "source", F.col("tokens").cast("bigint").alias("tokens"), "uses")

        used = self.selection.groupBy("source").agg(F.sum(F.col("tokens") * F.col("uses")).alias("tokens"), F.count(F.lit(1)).alias("n_documents"), F.sum("uses").alias("n_uses"))
        stock = held.groupBy("source").agg(F.sum("tokens").alias("available_tokens"))
        reached = used.agg(F.sum("tokens").alias("all"))
        nought = lambda c: F.coalesce(c, F.lit(0)).cast("bigint").alias(c)
        self.report = (
            goal.join(used, "source", "left").join(stock, "source", "left").join(F.broadcast(reached))
            .select("source", "target_share", (F.coalesce("tokens", F.lit(0)) / F.greatest("all", F.lit(1))).alias("actual_share"), *[nought(c) for c in ("tokens", "available_tokens", "n_documents", "n_uses")])
        )
