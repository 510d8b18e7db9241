import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from millrace.llm.topn import Heaps, top_n

SHAPE = "g string, i string, s double"


def brute(rows, n):
    best = {}
    for g, i, s in rows:
        if None not in (g, i, s) and s == s and abs(s) != float("inf"):
            best[g, i] = max(best.get((g, i), s), s)
    out = {}
    for (g, i), s in best.items():
        out.setdefault(g, []).append((-s, i))
    return sorted((g, i, -s, k + 1) for g, v in out.items() for k, (s, i) in enumerate(sorted(v)[:n]))


def got(df, n):
    return sorted(tuple(r) for r in top_n(df, "g", "i", "s", n).collect())


def test_ties_repeats_nulls_and_infinities(spark):
    rows = [("a", "x", 1.0), ("a", "y", 1.0), ("a", "z", 1.0), ("a", "w", 1.0), ("a", "x", 0.5), ("a", "q", float("nan")), ("a", "r", float("inf")), ("a", None, 9.0), (None, "x", 9.0), ("b", "x", None), ("c", "", -0.0), ("c", "é", 0.0), ("c", "z", 0.0)] * 3
    df = spark.createDataFrame(rows, SHAPE).repartition(5)
    assert got(df, 3) == brute(rows, 3)
    assert got(df.limit(0), 3) == []


def test_skewed_groups(spark):
    rnd = random.Random(1)
    rows = [(rnd.choice(["hot"] * 30 + [f"g{k}" for k in range(20)]), f"i{rnd.randrange(400)}", rnd.randrange(50) / 7) for _ in range(6000)]
    df = spark.createDataFrame(rows, SHAPE).repartition(7)
    for n in (1, 3, 10):
        assert got(df, n) == brute(rows, n)


def test_extra_columns_with_clashing_names(spark):
    df = spark.createDataFrame([("a", "x", 1.0)], SHAPE).withColumns({"rank": F.lit(5), "grp": F.lit(6), "item": F.lit(7), "score": F.lit(8)})
    assert top_n(df, "g", "i", "s", 2).columns == ["g", "i", "s", "rank"]
    assert top_n(df, "g", "i", "s", 2).count() == 1


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.sampled_from("ab"), st.text("xyzé", max_size=2), st.integers(-3, 3).map(float)), max_size=40), st.integers(1, 4), st.integers(0, 40))
def test_heaps_merge(rows, n, cut):
    def heaps(part):
        h = Heaps(n)
        for r in part:
            h.add(*r)
        return list(h.rows())

    whole = Heaps(n)
    for r in heaps(rows[:cut]) + heaps(rows[cut:]):
        whole.add(*r)
    assert sorted(whole.rows()) == sorted((g, i, s) for g, i, s, _ in brute(rows, n))
