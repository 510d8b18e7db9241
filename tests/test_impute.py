import math

import pytest
from pyspark.sql import functions as F

from millrace.operators.impute import NumericField, fill_category, fill_numeric


def frame(spark, rows, extra=""):
    return spark.createDataFrame(rows, f"id string, g string, t string, x double{extra}")


def field():
    return NumericField("x", F.lit(0.0), F.lit(100.0))


def test_group_and_time_effects_with_shrinkage(spark):
    rows = [(f"{g}{t}{k}", g, t, 10.0 * "abcd".index(g) + 5.0 * int(t) + (k % 3 - 1) * 0.1 + 20) for g in "abcd" for t in "012" for k in range(6)]
    rows += [("m1", "a", "2", None), ("m2", "d", "0", float("nan")), ("m3", "d", "2", -5.0), ("m4", "new", "1", float("inf")), ("m5", None, None, 1000.0)]
    out = {r["id"]: r for r in fill_numeric(frame(spark, rows), [field()], ["g", "t"]).collect()}
    assert len(out) == len(rows)
    for i, g, t, x in rows[:-5]:
        assert out[i]["x"] == x and not out[i]["x_filled"]
    assert all(out[m]["x_filled"] for m in ("m1", "m2", "m3", "m4", "m5"))
    assert math.isclose(out["m1"]["x"], 30.0, abs_tol=0.5)
    assert math.isclose(out["m2"]["x"], 50.0, abs_tol=0.5)
    assert math.isclose(out["m3"]["x"], 60.0, abs_tol=0.5)
    assert math.isclose(out["m4"]["x"], 40.0, abs_tol=0.5)  # unknown group: mean and period
    assert math.isclose(out["m5"]["x"], 40.0, abs_tol=0.5)


def test_a_group_of_few_is_shrunk(spark):
    rows = [(f"r{k}", f"g{k % 20}", "t", 50.0 + (k % 7 - 3) * 5 + (k % 20)) for k in range(400)] + [("lone", "odd", "t", 99.0), ("want", "odd", "t", None)]
    got = {r["id"]: r["x"] for r in fill_numeric(frame(spark, rows), [field()], ["g"]).collect()}
    assert 58.0 < got["want"] < 98.0


def test_empty_all_missing_and_clashing_names(spark):
    assert fill_numeric(frame(spark, []), [field()], ["g", "t"]).count() == 0
    none = fill_numeric(frame(spark, [("a", "g", "t", None)] * 3), [field()], ["g", "t"]).collect()
    assert [r["x"] for r in none] == [0.0] * 3 and all(r["x_filled"] for r in none)
    clash = frame(spark, [("a", "g", "t", 1.0, "kept"), ("b", "g", "t", None, "kept")], ", X_Filled string")
    out = fill_numeric(clash, [field()], ["g"])
    assert out.columns == ["id", "g", "t", "x", "X_Filled", "x_filled_1"]
    assert sorted((r["X_Filled"], r["x_filled_1"]) for r in out.collect()) == [("kept", False), ("kept", True)]


def test_limits_are_kept(spark):
    f = NumericField("x", F.lit(0.0), F.when(F.col("t") == "lo", 3.0), 0.5, lambda v: F.log1p(v), lambda m: F.expm1(m))
    rows = [("a", "g", "hi", 80.0), ("b", "g", "hi", 90.0), ("c", "g", "lo", 3.4), ("d", "g", "lo", 3.6), ("e", "g", "hi", None)]
    out = {r["id"]: r for r in fill_numeric(frame(spark, rows), [f], ["g"]).collect()}
    assert not out["c"]["x_filled"] and out["d"]["x_filled"] and out["d"]["x"] == 3.0
    assert 0 < out["e"]["x"] < 100


def test_categories(spark):
    rows = [(str(k), "p" if k % 2 else "q", "m", "Java" if k % 2 else " go") for k in range(20)] + [("x", "p", "m", None), ("y", "q", "m", "  "), ("z", "new", "other", "")]
    df = spark.createDataFrame(rows, "id string, g string, t string, c string")
    got = {r["id"]: (r["c"], r["c_filled"]) for r in fill_category(df, "c", ["g", "t"]).collect()}
    assert got["x"] == ("java", True) and got["y"] == ("go", True)
    assert got["z"] == ("go", True)  # equal shares: the smaller category
    assert got["1"] == ("Java", False) and got["0"] == (" go", False)
    void = spark.createDataFrame([("a", "g", "t", None)], df.schema)
    assert [(r["c"], r["c_filled"]) for r in fill_category(void, "c", ["g"]).collect()] == [(None, True)]


def test_correlated_factors_count_once(spark):
    """Month and group say the same: 45 of 100 there are b, 5 of 900 elsewhere."""
    rows = [(f"h{k}", "g", "t", "b" if k < 45 else "a") for k in range(100)] + [(f"r{k}", f"g{k % 7}", f"t{k % 7}", "b" if k < 5 else "a") for k in range(900)]
    rows += [("x", "g", "t", None), ("y", None, "t9", None)]
    got = {r["id"]: r["c"] for r in fill_category(spark.createDataFrame(rows, "id string, g string, t string, c string"), "c", ["g", "t"]).collect()}
    assert (got["x"], got["y"]) == ("a", "a")
    rows = [r if r[3] != "a" or r[1] != "g" or int(r[0][1:]) % 3 else (*r[:3], "b") for r in rows]
    got = {r["id"]: r["c"] for r in fill_category(spark.createDataFrame(rows, "id string, g string, t string, c string"), "c", ["g", "t"]).collect()}
    assert got["x"] == "b" and got["y"] == "a"


def test_many_categories_are_an_error(spark):
    df = spark.range(2101).select(F.col("id").cast("string").alias("c"), F.lit("g").alias("g"))
    with pytest.raises(ValueError, match="categories"):
        fill_category(df, "c", ["g"])
    assert fill_category(df.limit(0), "c", ["g"]).count() == 0


def test_held_out_values_are_predicted_better_than_by_the_mean(spark, medium):
    from millrace.plans.tables import table

    f = table(spark, medium, "features").filter("age between 0 and 20000").withColumn("g", F.split("change_id", ":")[0])
    hidden = f.withColumn("true", F.col("age")).withColumn("age", F.when(F.crc32("change_id") % 5 == 0, None).otherwise(F.col("age")))
    age = NumericField("age", F.lit(0.0), F.lit(20000.0), 0.0, lambda v: F.log1p(v), lambda m: F.expm1(m))
    out = fill_numeric(hidden, [age], ["g"]).filter("age_filled")
    mean = hidden.agg(F.avg(F.log1p("age"))).first()[0]
    r = out.agg(F.avg((F.log1p("age") - F.log1p("true")) ** 2).alias("e"), F.avg((F.lit(mean) - F.log1p("true")) ** 2).alias("m")).first()
    assert r["e"] < 0.9 * r["m"]
