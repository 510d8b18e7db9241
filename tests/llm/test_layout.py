from pyspark.sql import functions as F

from millrace.llm import layout
from millrace.llm.layout import collapse_layout, flat, flat_lines

KIDS = "id string, op string, text string"


def run(spark, records, kids):
    df = collapse_layout(spark.createDataFrame(records, "id string, message string"), "id", "message", spark.createDataFrame(kids, KIDS), "id", "op", "text")
    return {r["id"]: (r["representative"], r["n_copies"]) for r in df.collect()}


RECORDS = [("b", "Fix: the Bug\n\nmore"), ("a", "MORE\r\nfix the bug"), ("c", "fix thebug! \nmore\nmore"), ("d", "fix the bug"), ("n", None), ("e", ""), ("f", " 　.\n"), ("s", "Straße"), ("t", "STRASSE"), ("w", "other")]
EDITS = [("a", "add", "x = 1;"), ("a", "add", "y"), ("b", "ADD ", "Y"), ("b", "add", "X=1"), ("b", "add", "  "), ("c", "add", "x=1"), ("c", "add", "x=1"), ("c", "add", "«y»"), ("d", "add", "x = 1"), ("d", "add", "y"), ("zz", "add", "stray"), (None, "add", "q"), ("w", "delete", "x"), ("s", None, "k"), ("t", None, "K")]


def test_layout_is_disregarded(spark):
    got = run(spark, RECORDS, EDITS)
    assert [got[k][0] for k in "abcd"] == ["a", "a", "a", "d"]
    assert got["a"][1] == 3 and got["d"][1] == 1
    assert {got[k] for k in "nef"} == {("e", 3)}
    assert got["t"] == got["s"] == ("s", 2) and got["w"] == ("w", 1)


def test_kind_and_content_count(spark):
    got = run(spark, [("a", "m"), ("b", "m"), ("c", "m")], [("a", "add", "x"), ("b", "delete", "x"), ("c", "add", "x y")])
    assert {v for v in got.values()} == {("a", 1), ("b", 1), ("c", 1)}


def test_wide_records_have_the_same_digest_tree(spark, monkeypatch):
    monkeypatch.setattr(layout, "WIDE", 20)
    lines = [f"line {k}" for k in range(50)]
    kids = [("a", "add", x) for x in lines] + [("b", "add", x.upper()) for x in reversed(lines)] + [("b", "add", lines[0])] * 5
    kids += [("c", "add", x) for x in lines[:-1]] + [("d", "add", "one")] * 30 + [("e", "add", "One")]
    got = run(spark, [(k, "m") for k in "abcde"], kids)
    assert got == {"a": ("a", 2), "b": ("a", 2), "c": ("c", 1), "d": ("d", 2), "e": ("d", 2)}


def test_collisions_of_digests_are_told_apart(spark, monkeypatch):
    same = F.struct(F.lit(1).cast("bigint").alias("x"), F.lit(2).cast("bigint").alias("y"))
    monkeypatch.setattr(layout, "_digest", lambda *v: F.when(v[0].isNull(), same).otherwise(same))
    got = run(spark, RECORDS, EDITS)
    assert [got[k][0] for k in "abcd"] == ["a", "a", "a", "d"] and got["w"] == ("w", 1)


def test_empty_tables_and_repeated_rows(spark):
    assert run(spark, [], []) == {}
    assert run(spark, [("a", "m"), ("a", "m"), (None, "m")], [])["a"][0] == "a"


def test_clashing_names(spark):
    records = spark.createDataFrame([("a", "m", 1), ("b", "M", 2)], "id string, message string, root int").withColumns({"lines": F.lit(1), "representative": F.lit("r"), "n_copies": F.lit(9)})
    kids = spark.createDataFrame([("a", "add", "x", 1)], KIDS + ", leaf int")
    assert collapse_layout(records, "id", "message", kids, "id", "op", "text").count() == 2


def test_text_functions(spark):
    row = spark.createDataFrame([(" Ünï code—“q” \t\x1f_-", "b A.\n\n a ")], "x string, y string").select(flat(F.col("x")), flat_lines(F.col("y"))).first()
    assert row[0] == "ünïcodeq" and row[1] == ["a", "b"]
