from pyspark.sql import functions as F

from millrace.operators.prefix import running_sum


def test_equals_a_plain_running_sum(spark):
    rows = [("a" if k % 3 else None, str(k), float(k % 5) if k % 7 else None) for k in range(200)]
    df = spark.createDataFrame(rows, "g string, k string, v double")
    digest = F.sha2("k", 256)
    got = running_sum(df, ["g"], digest, F.col("v"), ["k"]).withColumn("d", digest).collect()
    for g in ("a", None):
        at = 0.0
        for r in sorted((r for r in got if r["g"] == g), key=lambda r: r["d"]):
            assert r["before"] == at
            at += r["v"] or 0.0
    assert len(got) == 200
    assert running_sum(df.limit(0), ["g"], digest, F.col("v"), ["k"]).count() == 0
