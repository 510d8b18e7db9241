import random
import re

import numpy as np
from pyspark.sql import functions as F

from millrace.llm import overlap
from millrace.llm.overlap import Overlaps, prefixes


def words(texts):
    return {w for t in texts for w in re.findall(r"[^\W_]+", (t or "").lower())}


def brute(rows, sides, t):
    texts = {}
    for i, x in rows:
        texts.setdefault(i, []).append(x)
    sets = {i: words(v) for i, v in texts.items()}
    out = set()
    for a, s in sides:
        for b, r in sides:
            if s != "train" and r == "train" and a != b and a in sets and b in sets and s in ("valid", "test"):
                x, y = sets[a], sets[b]
                if not x | y or len(x & y) >= t * len(x | y) - 1e-9:
                    out.add((min(a, b), max(a, b)))
    return out


def run(spark, rows, sides, t=0.8):
    o = Overlaps(spark.createDataFrame(rows, "id string, text string").repartition(4), spark.createDataFrame(sides, "id string, split string"), "train", ("valid", "test"), t)
    return o


def pairs(o):
    return {(r["id_a"], r["id_b"]) for r in o.record_pairs().collect()}


def corpus(seed, n, vocabulary, lengths):
    rnd = random.Random(seed)
    rows, sides = [], []
    base = []
    for k in range(n):
        if base and rnd.random() < 0.4:
            text = list(rnd.choice(base))
            for _ in range(rnd.randrange(0, 4)):
                text[rnd.randrange(len(text))] = f"w{rnd.randrange(vocabulary)}"
        else:
            text = [f"w{int(vocabulary * rnd.random() ** 3)}" for _ in range(rnd.randrange(*lengths))]
        base.append(text)
        rows.append((f"r{k}", " ".join(text)))
        sides.append((f"r{k}", rnd.choice(["train", "train", "valid", "test"])))
    return rows, sides


def test_equals_all_pairs(spark):
    for seed, t in ((1, 0.8), (2, 0.6)):
        rows, sides = corpus(seed, 300, 80, (3, 25))
        assert pairs(run(spark, rows, sides, t)) == brute(rows, sides, t)


def test_hot_copies_several_rows_and_odd_cases(spark):
    rows = [(f"h{k}", "The same STOCK message") for k in range(60)] + [("h0", "message, the"), ("e1", None), ("e2", " ... "), ("e3", ""), ("x", "alone here"), ("both", "alone here"), ("no", "alone here"), ("o", "alone here")]
    sides = [(f"h{k}", "train" if k % 2 else "test") for k in range(60)] + [("e1", "train"), ("e2", "valid"), ("e3", "train"), ("x", "test"), ("both", "train"), ("both", "valid"), ("o", "elsewhere"), ("ghost", "train")]
    o = run(spark, rows, sides)
    assert pairs(o) == brute(rows, sides, 0.8)
    touched = {r["id"] for r in o.touched().collect()}
    assert touched == {f"h{k}" for k in range(0, 60, 2)} | {"e2", "x", "both"}


def test_threshold_is_inclusive(spark):
    rows = [("a", "a b c d"), ("b", "a b c d e"), ("c", "a b c x y")]
    assert pairs(run(spark, rows, [("a", "train"), ("b", "test"), ("c", "test")])) == {("a", "b")}


def test_empty(spark):
    o = Overlaps(spark.createDataFrame([], "id string, text string"), spark.createDataFrame([], "id string, split string"), "train", ("test",))
    assert pairs(o) == set() and o.touched().count() == 0


def test_wide_records(spark, monkeypatch):
    monkeypatch.setattr(overlap, "WIDE", 10)
    rows = [("a", f"w{k % 12} W{k}") for k in range(40)] + [("b", f"w{k}") for k in range(40)] + [("c", "w1 w2")]
    assert pairs(run(spark, rows, [("a", "train"), ("b", "test"), ("c", "test")])) == {("a", "b")}


def test_similar_pairs_share_a_prefix_word():
    rnd = random.Random(7)
    counts = np.ones((2, overlap.BUCKETS), np.int32)
    for t in (0.5, 0.8, 0.9):
        for _ in range(300):
            x = {rnd.randrange(1 << 40) for _ in range(rnd.randrange(1, 30))}
            y = set(rnd.sample(sorted(x), max(1, len(x) - rnd.randrange(3)))) | {rnd.randrange(1 << 40) for _ in range(rnd.randrange(3))}
            if len(x & y) >= t * len(x | y):
                flat = np.array([*sorted(x), *sorted(y)], np.int64)
                rec, _, word = prefixes(flat, np.array([0, len(x), len(x) + len(y)]), np.array([True, False]), counts, t)
                assert set(word[rec == 0].tolist()) & set(word[rec == 1].tolist())


def test_clashing_names(spark):
    texts = spark.createDataFrame([("a", "x y"), ("b", "y x")], "id string, text string").withColumns({"words": F.lit(1), "train": F.lit(2), "x": F.lit(3)})
    sides = spark.createDataFrame([("a", "train"), ("b", "test")], "id string, split string").withColumn("words", F.lit(0))
    assert pairs(Overlaps(texts, sides, "train", ("test",))) == {("a", "b")}
