import math

import pytest
from pyspark.sql import functions as F

from millrace.functions import numbers as N
from millrace.functions import text as T
from millrace.functions import times as Z


def one(spark, expr, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'string' if v is None or isinstance(v, str) else 'array<int>' if v and isinstance(v[0], int) else 'array<string>'}" for k, v in values.items()))
    return df.select(expr.alias("r")).first()["r"]


@pytest.mark.parametrize("line, ext, want", [
    ("while (left_over > 0x1F) { // drain", ".kt", "while ( left over > 0x1F ) {"),
    ('log("a // b"); // c', ".go", 'log ( "a / / b" ) ;'),
    ("/** doc", ".java", ""), ("* more doc", ".php", ""), ("  // only", ".go", ""), ("n -= 2   # less", ".bash", "n - = 2"), ("#!/bin/sh", ".sh", ""), ("a.b() // kept", ".xyz", "a . b ( ) / / kept"),
    ('"open // literal', ".ts", '"open / / literal'), (r'"a\"//b" // c', ".ts", '"a \\ " / / b"'), ("a / b", ".c", "a / b"), ("", ".c", ""),
    ("int x = 1; // y", ".cxx", "int x = 1 ;"), ("int x = 1; // y", ".dart", "int x = 1 ;"), ("val x = 1 // y", ".kts", "val x = 1"),
])
def test_clean_line(spark, line, ext, want):
    assert one(spark, T.clean_line(F.col("a"), F.col("b")), a=line, b=ext) == want


def test_messages_paths_and_labels(spark):
    assert one(spark, T.clean_message(F.col("a")), a="Drop stale rows [OPAL-7]\ngit-svn-id: x\nTwice") == "Drop stale rows [ OPAL - 7 ] Twice"
    assert [one(spark, T.extension(F.col("a")), a=x) for x in ("a/b.C.Java", "x/.bashrc", "y.", "z")] == [".java", "", "", ""]
    assert [one(spark, T.renamed_to(F.col("a")), a=x) for x in ("a/{b => c}/d", "a/{b => }/d", "x => y", "p")] == ["a/c/d", "a/d", "y", "p"]
    assert (one(spark, T.subsystem(F.col("a")), a="a/b/c"), one(spark, T.directory(F.col("a")), a="a/b/c"), one(spark, T.directory(F.col("a")), a="c")) == ("a", "a/b", "")
    assert [one(spark, T.binary_label(F.col("a")), a=x) for x in (" TRUE", "1.0", "0", "false", "", "2", None)] == [1, 1, 0, 0, None, None, None]
    assert one(spark, T.is_repository(F.col("a")), a="a/..") is False and one(spark, T.is_repository(F.col("a")), a="a/b.c") is True
    assert one(spark, T.says_fix(F.col("a")), a="a BUG") is True


DIFF = """diff --git a/x/Queue.java b/x/Queue.java
index 1..2 100644
--- a/x/Queue.java
+++ b/x/Queue.java
@@ -1,2 +1,2 @@ f()
-old
+new
++ n;
diff --git a/b.bin b/b.bin
Binary files a/b.bin and b/b.bin differ
diff --git a/go.sum b/go.sum
@@ -1 +1 @@
-a
+b
@@ -9 +9 @@
+c"""


def test_patch_statistics(spark):
    df = spark.createDataFrame([("d", DIFF), ("e", ""), ("n", None), ("loose", "@@ -1 +1 @@\n+x")], "id string, diff string")
    got = {r["id"]: r for r in T.patch_statistics(df, "id", "diff").collect()}
    d = got["d"]
    assert (d["added"], d["deleted"], d["files"], d["directories"], d["binary"], d["hunks"]) == (4, 2, 3, 2, 1, 3)
    assert math.isclose(d["entropy"], 1.0)
    assert (got["e"]["files"], got["e"]["entropy"], got["n"]["files"], got["loose"]["files"], got["loose"]["added"]) == (0, 0.0, 0, 1, 1)


def test_diffs(spark):
    c = one(spark, T.clean_diff(F.col("a")), a=DIFF)
    assert (c["kept"], c["skipped_binary"], c["skipped_lock"], c["hunks"]) == (1, 1, 1, 1)
    assert [u.count("@@ ") > 0 for u in one(spark, T.hunk_units(F.col("a")), a=DIFF)] == [True, False, True, True]
    moved = DIFF.replace("index 1..2", "index 3..4").replace("-1,2 +1,2", "-7,2 +9,2")
    assert one(spark, T.normalize_patch(F.col("a")), a=DIFF) == one(spark, T.normalize_patch(F.col("a")), a=moved.replace("\n", "\r\n"))
    assert one(spark, T.patch_key(F.col("a")), a=DIFF) == one(spark, T.patch_key(F.col("a")), a=moved.replace("+new", "+ n e w"))
    assert one(spark, T.patch_key(F.col("a")), a="no change") is None
    assert one(spark, T.message_key(F.col("a")), a="short") is None
    assert one(spark, T.message_key(F.col("a")), a=" A long  Message, really") == one(spark, T.message_key(F.col("a")), a="a LONG message, really ")


def test_rendering(spark):
    assert one(spark, T.render(F.col("m"), F.col("a"), F.col("d")), m="msg", a=["a"], d=["b"]) == "msg\n+ a\n- b"
    assert one(spark, T.head_tail(F.col("a"), 5, [99]), a=[1, 2, 3, 4, 5, 6]) == [1, 2, 99, 5, 6]
    assert one(spark, T.head_tail(F.col("a"), 2, [99]), a=[1, 2, 3]) == [1, 2] and one(spark, T.head_tail(F.col("a"), 3, [9]), a=[1, 2, 3]) == [1, 2, 3]
    replies = {'{"score": 50}': 0.5, '```json\n{"score": 1.25}\n```': 0.0125, '```\n{"score": 3}```': 0.03, '```json {"score": 3}```': None, '{"score": true}': None, '{"score": 101}': None, '{"score": -1}': None, '{"score": "5"}': None, '{"score": 5, "x": 1}': None, "no": None}
    assert {k: one(spark, T.parse_score(F.col("a"), "score"), a=k) for k in replies} == replies
    assert one(spark, T.parse_score(F.col("a")), a='{"risk_score": 5e1}') == 0.5


def test_header_paths(spark):
    headers = {
        "diff --git a/x y/A b.java b/x y/A b.java": "x y/A b.java", "diff --git a/old.c b/src/new.c": "src/new.c", "diff --git a/b/c b/b/c": "b/c",
        'diff --git "a/q\\303.c" "b/q\\303.c"': "q\\303.c", "diff --git one two": "two",
    }
    assert {k: one(spark, T.header_path(F.col("a")), a=k) for k in headers} == headers


def test_times_and_numbers(spark):
    ok = {"2024-01-01T00:00:00Z": True, "2024-01-01T09:00:00+09:00": True, "1704067200": True, "2024-01-01T00:00:00": False, "x": False}
    assert {k: one(spark, Z.utc(F.col("a")).isNotNull(), a=k) for k in ok} == ok
    assert one(spark, F.unix_timestamp(Z.utc(F.col("a"))), a="2024-01-01T09:00:00+0900") == 1704067200
    assert one(spark, Z.iso_week(F.col("a").cast("timestamp")), a="2021-01-02") == "2020-W53"
    assert one(spark, Z.window_complete(F.col("a").cast("timestamp"), F.lit(None).cast("timestamp"), 3), a="2021-01-02") is False
    assert math.isclose(one(spark, N.entropy_bits(F.col("a").cast("array<double>")), a=[2, 0, 2]), 1.0)
    assert N.evaluation_points(10, 3) == [4, 7, 10]
    assert one(spark, N.softmax_first(F.lit(-1000.0), F.lit(-1000.0)), a="x") == 0.5


def test_sigmoid_keeps_gaps(spark):
    df = spark.createDataFrame([(None,), (float("nan"),), (0.0,), (9999.0,)], "z double")
    assert [r["s"] for r in df.select(N.sigmoid(F.col("z")).alias("s")).collect()] == [None, None, 0.5, 1.0]
