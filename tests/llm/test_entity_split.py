import random
from collections import defaultdict

from pyspark.sql import functions as F

from millrace.llm.entity_split import assign_splits, deal, spanning_forest, stored_forest, torn_groups


def components(edges):
    up = {}

    def find(x):
        up.setdefault(x, x)
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in edges:
        up[find(a)] = find(b)
    out = defaultdict(set)
    for x in list(up):
        out[find(x)].add(x)
    return {frozenset(v) for v in out.values()}


def check(spark, edges):
    df = spark.createDataFrame(edges, "a string, b string")
    roots, forest = spanning_forest(df, "a", "b")
    got = defaultdict(set)
    for r in roots.collect():
        got[r["root"]].add(r["vertex"])
    real = [(a, b) for a, b in edges if a and b]
    assert {frozenset(v) for v in got.values()} == components(real)
    tree = [tuple(r) for r in forest.collect()]
    assert len(tree) == sum(map(len, got.values())) - len(got)
    assert components(tree + [(a, a) for a in {x for e in real for x in e}]) == components(real)


def test_forest_of_random_graphs(spark):
    rnd = random.Random(4)
    check(spark, [(f"v{rnd.randrange(60)}", f"v{rnd.randrange(60)}") for _ in range(45)])


def test_chain_star_and_odd_rows(spark):
    chain = [(f"c{k:02d}", f"c{k + 1:02d}") for k in range(40)]
    check(spark, chain + [("hub", f"s{k}") for k in range(50)] + [("x", "x"), ("hub", "s1"), (None, "y"), ("y", None)])


def test_empty(spark):
    roots, forest = spanning_forest(spark.createDataFrame([], "a string, b string"), "a", "b")
    assert roots.count() == 0 and forest.count() == 0


SHARES = {"train": 0.8, "valid": 0.1, "test": 0.1}


def test_splits_keep_the_tied_together_and_their_shares(spark):
    rnd = random.Random(5)
    ties = [(f"i{k}", f"g{rnd.randrange(400)}" if k % 3 else None) for k in range(3000)] + [(f"i{k}", f"g{k % 400}x") for k in range(0, 3000, 50)] + [(None, "g1"), ("i1", "g1")]
    ids = spark.createDataFrame([(f"i{k}", 1) for k in range(3500)] + [("i1", 1), (None, 1)], "id string, split int")
    tied = spark.createDataFrame(ties, "id string, g string")
    got = assign_splits(ids, "id", tied, "id", "g", SHARES).collect()
    assert len(got) == 3500 and len({r["id"] for r in got}) == 3500
    split = {r["id"]: r["split"] for r in got}
    by = defaultdict(set)
    for i, g in ties:
        if i and g:
            by[g].add(split[i])
    assert all(len(v) == 1 for v in by.values())
    for s, p in SHARES.items():
        assert abs(sum(v == s for v in split.values()) / 3500 - p) < 0.03
    again = assign_splits(ids.repartition(3), "id", tied.repartition(2), "id", "g", SHARES).collect()
    assert {r["id"]: r["split"] for r in again} == split


def test_deal_stratifies_by_size(spark):
    sizes = [(f"r{k}", 2 ** (k % 6)) for k in range(6000)]
    got = deal(spark.createDataFrame(sizes, "root string, size long"), "root", "size", SHARES)
    for r in got.groupBy("size").pivot("split").count().collect():
        assert abs(r["train"] - 800) < 15 and abs(r["valid"] - 100) < 15 and abs(r["test"] - 100) < 15
    one = deal(spark.createDataFrame([("r", 10)], "root string, size long"), "root", "size", SHARES).collect()
    assert [r["split"] for r in one] == ["train"]
    assert deal(spark.createDataFrame([], "root string, size long"), "root", "size", SHARES).count() == 0


def test_torn_groups(spark):
    ties = spark.createDataFrame([("a", "g1"), ("b", "g1"), ("b", "g2"), ("c", "g2"), ("d", "g3"), ("e", "g3"), ("f", None), (None, "g3")], "id string, g string")
    splits = spark.createDataFrame([("a", "train"), ("c", "test"), ("d", "train"), ("e", "train"), ("f", "test"), ("zz", "test")], "id string, split string")
    assert sorted(r[0] for r in torn_groups(ties, "id", "g", splits, "id", "split").collect()) == ["g1", "g2"]
    assert torn_groups(ties.filter(F.lit(False)), "id", "g", splits, "id", "split").count() == 0


def test_forest_is_kept_and_extended(spark, tmp_path):
    rnd = random.Random(11)
    edges = [(f"v{rnd.randrange(120)}", f"v{rnd.randrange(120)}") for _ in range(90)]
    frame = lambda e: spark.createDataFrame(e, "a string, b string")
    seen = []
    for k in (0, 30, 60):
        roots = stored_forest(frame(edges[k : k + 30]), "a", "b", str(tmp_path / "f"))
        got = defaultdict(set)
        for r in roots.collect():
            got[r["root"]].add(r["vertex"])
        now = {frozenset(v) for v in got.values()}
        assert now == components(edges[: k + 30])
        assert all(any(old <= new for new in now) for old in seen)
        seen = now
        tree = [tuple(r) for r in spark.read.parquet(str(tmp_path / "f" / "forest" / f"gen-{k // 30 + 1:06d}")).collect()]
        assert len(tree) == sum(map(len, now)) - len(now)
    empty = stored_forest(frame(edges).limit(0), "a", "b", str(tmp_path / "f"))
    assert empty.count() == sum(map(len, seen))


def test_splits_with_a_kept_forest(spark, tmp_path):
    ties = spark.createDataFrame([("a", "g"), ("b", "g"), ("c", "h")], "i string, g string")
    records = ties.select("i")
    shares = {"train": 0.5, "test": 0.5}
    assign_splits(records, "i", ties, "i", "g", shares, folder=str(tmp_path / "s"))
    more = spark.createDataFrame([("c", "g"), ("d", None)], "i string, g string")
    got = {r["i"]: r["component"] for r in assign_splits(records, "i", more, "i", "g", shares, folder=str(tmp_path / "s")).collect()}
    assert got["a"] == got["b"] == got["c"] != got["d"]
