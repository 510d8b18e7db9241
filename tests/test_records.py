import random

import pytest
from pyspark.sql import functions as F

from millrace.operators import batches as B
from millrace.operators import records as C
from millrace.operators.contracts import ContractError


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_canonicalise(spark):
    df = spark.createDataFrame([("A ", 1, "x"), (" a", 1, "x"), ("b", 2, "x"), ("b", 3, "y"), (None, 1, "x"), ("c", None, "x"), ("d", -1, "x"), ("", 1, None)], "id string, n int, `reason` string")
    forms = {"id": F.nullif(F.lower(F.trim("id")), F.lit(""))}
    rules = [("no_id", F.col("id").isNull()), ("negative", F.col("n") < 0)]
    good, bad = C.canonicalise(df, forms, rules, ["id"])
    assert sorted((r["id"], r["n"]) for r in good.collect()) == [("a", 1), ("c", None)]
    assert sorted((str(r["id"]), str(r["n"]), r["reason_1"]) for r in bad.collect()) == [("", "1", "no_id"), ("None", "1", "no_id"), ("b", "2", "repeated_key"), ("b", "3", "repeated_key"), ("d", "-1", "negative")]
    every, _ = C.canonicalise(df, forms, rules)
    assert every.count() == 5
    good, bad = C.canonicalise(df.limit(0), forms, rules, ["id"])
    assert good.count() == bad.count() == 0


def test_views(spark):
    df = spark.createDataFrame([("a", "public", "train", 1), ("b", "public", None, 0), ("c", "internal", "train", 1)], "id string, v string, s string, label int")
    assert rows_of(C.role_view(df, {"v": ["public"], "s": ["train"]})) == [("a", "public", "train", 1)]
    assert C.project(df, ["id", "v"], ["label"]).columns == ["id", "v"]
    for columns, forbidden in ((["id", "Label"], ["label"]), (["id", "other"], [])):
        with pytest.raises(ContractError):
            C.project(df, columns, forbidden)
    got = C.eligibility(df.withColumnRenamed("label", "reason"), [("no_split", F.col("s").isNull()), ("private", F.col("v") != "public")])
    assert rows_of(got.select("id", "reason_1")) == [("a", None), ("b", "no_split"), ("c", "private")]


def test_update_windows(spark):
    rnd = random.Random(4)
    items = [(f"i{k}", rnd.randrange(1, 50)) for k in range(37)]
    df = spark.createDataFrame([*items, (None, 3), ("n", None)], "id string, t int")
    got = B.update_windows(df.repartition(3), "id", "t", 5, 2500, "s").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, B.update_windows(df.coalesce(1), "id", "t", 5, 2500, "s").collect()))
    windows = {}
    for r in got:
        windows.setdefault(r["window"], []).append(r)
    assert sorted(windows) == list(range(len(windows))) and all(len(w) == 5 for w in windows.values())
    sums = [sum(r["t" if "t" in r.__fields__ else "tokens"] for r in windows[k]) for k in sorted(windows)]
    assert sum(sums) >= 2500 > sum(sums[:-1])
    places = sorted((r["place"], r["id"]) for r in got)
    assert [p for p, _ in places] == list(range(len(places)))
    assert len({i for p, i in places if p < 37}) == 37  # an epoch holds every item once
    assert B.update_windows(df.limit(0), "id", "t", 5, 100, "s").count() == 0


def greedy(lengths, budget):
    out, batch = [], []
    for x in sorted(lengths):
        if batch and (len(batch) + 1) * max(x, 1) > budget:
            out.append(batch)
            batch = []
        batch.append(x)
    return [*out, batch] if batch else out


@pytest.mark.parametrize("seed", range(6))
def test_batch_runs(seed):
    rnd = random.Random(seed)
    lengths = [rnd.choice([0, 1, 2, 3, rnd.randrange(60), 150]) for _ in range(rnd.randrange(1, 300))]
    budget = rnd.choice([1, 7, 40, 100])
    counts = sorted({x: lengths.count(x) for x in lengths}.items())
    flat, want = sorted(lengths), greedy(lengths, budget)
    got = []
    for first, end, size, batch in B.batch_runs(counts, budget):
        assert batch == len(got)
        got += [flat[k : k + size] for k in range(first, end, size)]
    assert got == want


def test_length_batches(spark):
    rnd = random.Random(8)
    items = [(k, rnd.choice([1, 5, 5, 9, 30, 200])) for k in range(400)]
    df = spark.createDataFrame([*items, (None, 3), (999, None)], "id long, n int")
    got = {}
    for r in B.length_batches(df, "id", "n", 60).collect():
        got.setdefault(r["batch"], []).append(r["length"])
    assert [sorted(got[k]) for k in sorted(got)] == greedy([n for _, n in items], 60)
    assert B.length_batches(df.limit(0), "id", "n", 60).count() == 0
