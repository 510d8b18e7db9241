import json
import os
import zipfile

import pytest
from pyspark.sql import functions as F

from millrace.operators.contracts import ContractError
from millrace.sources import readers as I
from millrace.sources import writers as O
from millrace.streaming.scoring import labels_in_time, score_stream, windowed_counts


def test_label_sheet(spark, tmp_path):
    p = tmp_path / "l.csv"
    p.write_text("﻿change_id,label\na,1\nb,0\nc,\n")
    assert {r["change_id"]: r["label"] for r in I.read_labels(spark, str(p)).collect()} == {"a": 1, "b": 0, "c": None}
    p.write_text("change_id,label\na,maybe\n")
    with pytest.raises(ContractError):
        I.read_labels(spark, str(p))


def test_manifest_with_files(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "a.diff").write_text("+x")
    (tmp_path / "big").write_text("x" * (I.LARGEST_FILE + 1))
    (tmp_path / "m.csv").write_text("id,diff_path\n1,d/a.diff\n2,../x\n3,big\n4,none\n5,/etc/passwd\n")
    got = {r["id"]: (r["content"], r["reason"]) for r in I.read_manifest(spark, str(tmp_path / "m.csv"), ["id", "diff_path"]).collect()}
    assert got == {"1": ("+x", None), "2": (None, "path_escapes"), "3": (None, "file_too_large"), "4": (None, "file_missing"), "5": (None, "path_escapes")}


def test_jsonl_and_zip(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"a": 1}\n\n{"a": 2}\n')
    assert sorted(r["a"] for r in I.read_jsonl(spark, str(tmp_path / "a.jsonl"), "a int").collect()) == [1, 2]
    (tmp_path / "b.jsonl").write_text("[1]\nno\n")
    with pytest.raises(Exception, match="(?i)malformed|FAILFAST"):
        I.read_jsonl(spark, str(tmp_path / "b.jsonl"), "a int").collect()
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.writestr("x.csv", "a,b\n1,2\n")
    assert I.read_zip_csv(str(tmp_path / "z.zip"), "x.csv") == [{"a": "1", "b": "2"}]
    with zipfile.ZipFile(tmp_path / "bad.zip", "w") as z:
        z.writestr("../x.csv", "a\n1\n")
    with pytest.raises(ContractError):
        I.read_zip_csv(str(tmp_path / "bad.zip"), "../x.csv")


def test_split_jsonl(spark, tmp_path):
    (tmp_path / "c.jsonl").write_text('{"a": 1}\n\n[1]\nno\n{"a": "x"}\n{"b": 2}\n')
    rows, bad = I.split_jsonl(spark, str(tmp_path / "c.jsonl"), "a int")
    assert sorted((r["a"] for r in rows.collect()), key=str) == [1, None]
    assert sorted(r["line"] for r in bad.collect()) == ["[1]", "no", '{"a": "x"}'] and bad.first()["file"].endswith("c.jsonl")


def test_archives(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "z.zip", "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("x.csv", "a\n" + "1\n" * 50_000)
    with pytest.raises(ContractError, match="too large"):
        I.read_zip_csv(str(tmp_path / "z.zip"), "x.csv")
    with pytest.raises(ContractError, match="expected"):
        I.read_zip_csv(str(tmp_path / "z.zip"), "x.csv", sha256="0" * 64)
    files = {"a/b.txt": b"one", "c": b""}
    I.write_bundle(files, str(tmp_path / "t.tar"))
    I.write_bundle(dict(reversed(files.items())), str(tmp_path / "u.tar"))
    assert I.read_bundle(str(tmp_path / "t.tar")) == files and (tmp_path / "t.tar").read_bytes() == (tmp_path / "u.tar").read_bytes()
    (tmp_path / "v.tar").write_bytes((tmp_path / "t.tar").read_bytes().replace(b"one", b"two"))
    with pytest.raises(ContractError, match="manifest"):
        I.read_bundle(str(tmp_path / "v.tar"))
    with pytest.raises(ContractError, match="unsafe"):
        I.write_bundle({"../x": b""}, str(tmp_path / "w.tar"))


def test_commit_scan(spark):
    log = spark.createDataFrame([("c1||ann|100\nFirst\n\ndiff --git a/x b/x\n@@ -1 +1 @@\n-a\n+b\n",), ("c2|c1|bob|200\nSecond\nbody\n",), ("c3|c1 c2|bob|300\nMerge",)], "block string")
    commits = I.parse_commits(log, "block").withColumn("time", F.timestamp_seconds("at"))
    got = {r["commit"]: (list(r["parents"]), r["dev"], r["at"], r["message"], r["diff"]) for r in commits.collect()}
    assert got["c1"] == ([], "ann", 100, "First", "diff --git a/x b/x\n@@ -1 +1 @@\n-a\n+b") and got["c2"] == (["c1"], "bob", 200, "Second\nbody", "")
    pick = lambda **k: sorted(r["commit"] for r in I.select_commits(commits, "time", **k).collect())
    assert pick(parents="parents") == ["c1", "c2"] and pick(most=1, parents="parents") == ["c2"] and pick(since="1970-01-01 00:03:20") == ["c2", "c3"] and pick(until="1970-01-01 00:03:20") == ["c1"]


def test_generations_and_canonical_rows(spark, tmp_path):
    df = spark.createDataFrame([(2, None, "é"), (1, 0.5, "x")], "b int, a double, c string")
    O.write_canonical(df, str(tmp_path / "rows"))
    assert sorted(r["value"] for r in spark.read.text(str(tmp_path / "rows")).collect()) == ['{"a":0.5,"b":1,"c":"x"}', '{"a":null,"b":2,"c":"é"}']
    with pytest.raises(FileExistsError):
        O.write_canonical(df, str(tmp_path / "rows"))
    folder = str(tmp_path / "gen")
    O.commit_generation(df, folder)
    O.commit_generation(df.limit(1), folder)
    assert O.current_generation(spark, folder).count() == 1 and spark.read.parquet(folder + "/gen-000001").count() == 2
    assert O.fingerprint({"b": 1, "a": [1, "é"]}) == O.fingerprint({"a": [1, "é"], "b": 1}) != O.fingerprint({"a": [1], "b": 1})
    with pytest.raises(ValueError):
        O.fingerprint(float("nan"))


def test_git_logs(spark):
    log = spark.createDataFrame([("s1|ann|100\n3\t1\tsrc/{a => b}/x.py\n-\t-\timg.png\n\n",), ("s2|bob|200\n",)], "block string")
    assert sorted(tuple(r) for r in I.parse_numstat(log, F.col("block")).collect()) == [("s1", "ann", 100, "img.png", 0, 0), ("s1", "ann", 100, "src/b/x.py", 3, 1)]
    patch = "diff --git a/a.py b/a.py\n--- a/a.py\n+++ b/a.py\n@@ -1 +1 @@\n-old\n+++new\ndiff --git a/g b/g\ndeleted file\n--- a/g\n+++ /dev/null\n@@ -1 +0,0 @@\n-gone"
    got = I.parse_patches(spark.createDataFrame([("s", patch), ("t", None)], "id string, p string"), "id", "p").collect()
    assert [tuple(r) for r in got] == [("s", "a.py", "delete", 0, "old"), ("s", "a.py", "add", 1, "++new"), ("s", "g", "delete", 2, "gone")]


def test_runs(spark, tmp_path):
    for k, (v, t, s) in enumerate([("m", 1, "finished"), ("m", 2, "finished"), ("m", 3, "failed")]):
        (tmp_path / f"r{k}.json").write_text(json.dumps({"variant_id": v, "seed": 1, "finished_at": t, "status": s, "metrics": {"ap": t / 10}}, indent=1))
    assert [r["metrics"]["ap"] for r in I.read_runs(spark, str(tmp_path / "*.json")).collect()] == [0.2]


def test_seal_and_resume(spark, tmp_path):
    df = spark.createDataFrame([("a", 1.0), ("b", None)], "id string, s double")
    path = str(tmp_path / "p")
    digest = O.seal(df, path, {"run": "r"})
    assert O.content_digest(O.unseal(spark, path)) == digest == O.content_digest(df.repartition(3))
    with pytest.raises(Exception, match="(?i)exists"):
        O.seal(df, path, {})
    spark.createDataFrame([("c", 2.0)], df.schema).write.mode("append").parquet(path)
    with pytest.raises(ContractError):
        O.unseal(spark, path)
    seen = []

    def score(rows):
        seen.append(sorted(r["id"] for r in rows.collect()))
        return rows.withColumn("score", F.lit(1.0))

    out = str(tmp_path / "scores")
    O.append_remaining(df.limit(1).select("id"), score, out, "id")
    assert O.append_remaining(df.select("id"), score, out, "id").count() == 2 and seen == [["a"], ["b"]]


def test_verify_files(spark, tmp_path):
    import hashlib

    (tmp_path / "f").mkdir()
    for n in ("ok", "odd", "extra"):
        (tmp_path / "f" / n).write_text(n)
    m = spark.createDataFrame([("ok", hashlib.sha256(b"ok").hexdigest()), ("odd", "0" * 64), ("gone", "0" * 64)], "path string, sha256 string")
    assert {r["path"]: r["problem"] for r in I.verify_files(spark, str(tmp_path / "f"), m).collect()} == {"odd": "changed", "extra": "not_listed", "gone": "missing"}


def test_streams(spark, tmp_path):
    src, sink, check = (str(tmp_path / n) for n in ("src", "sink", "check"))
    shape = "change_id string, at timestamp"
    rows = lambda *ids: spark.createDataFrame([(i, None) for i in ids], "change_id string, at string").withColumn("at", F.lit("2024-01-01").cast("timestamp"))
    rows("a", "b", "a").coalesce(1).write.mode("append").parquet(src)

    def run():
        stream = spark.readStream.schema(shape).parquet(src)
        score_stream(stream, lambda d: d.withColumn("score", F.length("change_id")), "change_id", "at", sink, check).awaitTermination(120)

    run()
    rows("c", "a").coalesce(1).write.mode("append").parquet(src)
    run()
    assert sorted(r["change_id"] for r in spark.read.parquet(sink).collect()) == ["a", "b", "c"]
    stream = spark.readStream.schema(shape).parquet(src)
    joined = labels_in_time(stream, spark.readStream.schema(shape).parquet(src).withColumnRenamed("at", "known"), "change_id", "at", "known")
    counts = windowed_counts(stream, "at", "change_id")
    assert joined.isStreaming and counts.columns == ["start", "change_id", "n"]


def test_reports_and_demo(spark, tmp_path):
    demo = I.synthetic_changes(spark, 120)
    assert demo.count() == 120 and demo.groupBy("group_id").count().filter("count <> 2").count() == 0
    O.write_report(demo.limit(3), str(tmp_path / "r.csv"))
    with pytest.raises(FileExistsError):
        O.write_report(demo.limit(3), str(tmp_path / "r.csv"))
    O.write_json(str(tmp_path / "m.json"), {"b": 1, "a": "é"})
    assert json.loads((tmp_path / "m.json").read_text()) == {"a": "é", "b": 1} and not [f for f in os.listdir(tmp_path) if f.endswith(".part")]
