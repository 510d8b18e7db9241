import pytest
from pyspark.sql import functions as F

from millrace.llm.sample import permuted, stable_sample

IDS = [f"p{k % 5}:{k * 2654435761 % (1 << 64):016x}" for k in range(3000)]


def frame(spark, ids):
    return spark.createDataFrame([(i,) for i in ids], "change_id string")


def pick(spark, ids, rate=0.2, parts=4):
    return {r[0] for r in stable_sample(frame(spark, ids).repartition(parts), "change_id", rate).collect()}


def test_same_in_every_partitioning_and_stable_as_data_grow(spark):
    first = pick(spark, IDS[:1000])
    assert first == pick(spark, list(reversed(IDS[:1000])), parts=1)
    assert first <= pick(spark, IDS)
    assert pick(spark, IDS) & set(IDS[:1000]) == first
    assert first <= pick(spark, IDS[:1000], 0.5)
    assert 450 < len(pick(spark, IDS)) < 750


def test_spellings_and_repeats_count_once(spark):
    odd = [f"  {i.upper()}\t" for i in IDS[:500]]
    assert pick(spark, odd + IDS[:500]) == pick(spark, IDS[:500])
    assert stable_sample(frame(spark, odd + IDS[:500]), "change_id", 1.0).count() == 500


def test_edges(spark):
    assert pick(spark, [], 0.5) == set()
    assert pick(spark, [None, "", "  "], 1.0) == set()
    assert pick(spark, IDS[:50], 0.0) == set()
    assert pick(spark, ["no colon", "x:nothex", "y:" + "f" * 40], 1.0) == {"no colon", "x:nothex", "y:" + "f" * 40}
    with pytest.raises(ValueError):
        stable_sample(frame(spark, []), "change_id", 1.5)


def test_permutation_has_no_collision(spark):
    df = spark.range(20000).select(F.format_string("%016x", "id").alias("h"))
    out = df.select(permuted(F.col("h"), F.lit("t"), "s").alias("p")).distinct()
    assert out.count() == 20000
    assert out.filter("p.l between 0 and 4294967295 and p.r between 0 and 4294967295").count() == 20000


def test_extra_columns_with_clashing_names(spark):
    df = frame(spark, IDS[:20]).withColumn("__p", F.lit(1)).withColumn("l", F.lit(2))
    assert stable_sample(df, "change_id", 1.0).count() == 20
