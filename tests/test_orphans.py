from datetime import datetime as dt

from pyspark.sql import functions as F

from millrace.operators.orphans import ForeignKey, Table, check_references, find_orphans, orphan_report


def test_reasons(spark):
    parent = spark.createDataFrame(
        [("a", False, None, None), ("B ", False, None, None), ("gone", True, None, None), ("late", False, None, dt(2024, 2, 1)), ("ends", False, dt(2024, 1, 15), None), ("two", True, None, None), ("two", False, None, None), ("a", False, None, None), (None, False, None, None)],
        "k string, dead boolean, dead_at timestamp, since timestamp",
    )
    child = spark.createDataFrame([(" A", dt(2024, 1, 10)), ("b", None), ("gone", dt(2024, 1, 1)), ("late", dt(2024, 1, 10)), ("late", dt(2024, 2, 1)), ("late", None), ("ends", dt(2024, 1, 14)), ("ends", dt(2024, 1, 15)), ("none", None), ("two", None), (None, None), (" \t", None)], "r string, at timestamp")
    t = Table(parent, deleted=F.col("dead"), deleted_at=F.col("dead_at"), available_at=F.col("since"))
    got = [(r["r"], r["at"], r["reason"]) for r in check_references(child, F.col("r"), F.col("at"), t, "k").collect()]
    assert len(got) == 12
    bad = sorted((r, str(at), why) for r, at, why in got if why)
    assert bad == [("ends", "2024-01-15 00:00:00", "deleted"), ("gone", "2024-01-01 00:00:00", "deleted"), ("late", "2024-01-10 00:00:00", "late"), ("none", "None", "absent")]


def chain(spark):
    a = spark.createDataFrame([("a1", None), ("a2", "missing")], "id string, up string")
    b = spark.createDataFrame([("b1", "a1"), ("b2", "a2"), ("b2", "a2"), ("b3", "nowhere")], "id string, a string")
    c = spark.createDataFrame([("c1", "b1"), ("c2", "b2"), ("c3", "b3"), ("c4", "b4"), ("c5", None)], "id string, b string")
    tables = {"a": Table(a), "b": Table(b), "c": Table(c)}
    keys = [ForeignKey("a", "up", "a", "id"), ForeignKey("b", "a", "a", "id"), ForeignKey("c", "b", "b", "id")]
    return find_orphans(tables, keys, {"a": ["id"], "b": ["id"], "c": ["id"]})


def test_cascade(spark):
    got = sorted((r["record"][0], r["kind"], r["reason"], r["depth"]) for r in chain(spark).collect())
    assert got == [("a2", "direct", "absent", 0), ("b2", "inherited", "parent", 1), ("b3", "direct", "absent", 0), ("c2", "inherited", "parent", 2), ("c3", "inherited", "parent", 1), ("c4", "direct", "absent", 0)]


def test_cycle_ends_and_report(spark):
    n = spark.createDataFrame([("x", "y"), ("y", "x"), ("z", "gone"), ("w", "z"), ("v", "w")], "id string, up string")
    found = find_orphans({"n": Table(n)}, [ForeignKey("n", "up", "n", "id")], {"n": ["id"]})
    assert sorted((r["record"][0], r["depth"]) for r in found.collect()) == [("v", 2), ("w", 1), ("z", 0)]
    assert [(r["ref_table"], r["month"], r["n_direct"], r["n_inherited"]) for r in orphan_report(found).collect()] == [("n", None, 1, 2)]


def test_empty_tables(spark):
    e = spark.createDataFrame([], "id string, up string")
    assert find_orphans({"n": Table(e)}, [ForeignKey("n", "up", "n", "id")], {"n": ["id"]}).count() == 0


def test_cascade_over_the_tables(spark, small):
    from millrace.plans.quality import p2_cascade

    got = {(r["table"], r["ref_table"]): (r["d"], r["i"]) for r in p2_cascade(spark, small).groupBy("table", "ref_table").agg(F.sum("n_direct").alias("d"), F.sum("n_inherited").alias("i")).collect()}
    assert got["predictions", "features"][1] > 0 and got["predictions", "features"][0] == 0
    assert got["features", "changes"][0] > 0 and all(i == 0 for (t, _), (_, i) in got.items() if t != "predictions")
