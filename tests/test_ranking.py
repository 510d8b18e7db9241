import random

import pytest
from pyspark.sql import functions as F

from millrace.operators import ranking as R

SHAPE = "g string, id string, y int, s double"


def frame(spark, y, s, g="g"):
    return spark.createDataFrame([(g, f"c{k}", a, float(b)) for k, (a, b) in enumerate(zip(y, s, strict=True))], SHAPE)


def brute(y, s):
    p, n = sum(y), len(y)
    ap = auc = None
    if p:
        ap, before = 0.0, 0
        for t in sorted(set(s), reverse=True):
            tp, cn = sum(a for a, b in zip(y, s, strict=True) if b >= t), sum(b >= t for b in s)
            ap += (tp - before) / p * tp / cn
            before = tp
    if 0 < p < n:
        pairs = [(1.0 if a > b else 0.5 if a == b else 0.0) for a, q in zip(s, y, strict=True) if q for b, r in zip(s, y, strict=True) if not r]
        auc = sum(pairs) / len(pairs)
    return ap, auc


def test_ap_and_auc_by_group(spark):
    rnd = random.Random(1)
    rows, want = [], {}
    for g, n, levels in (("a", 200, 10), ("b", 500, 1000), (None, 50, 3)):
        y, s = [int(rnd.random() < 0.3) for _ in range(n)], [rnd.randrange(levels) / 7 for _ in range(n)]
        want[g] = brute(y, s)
        rows += [(g, f"{g}{k}", a, b) for k, (a, b) in enumerate(zip(y, s, strict=True))]
    rows += [("a", "x", 1, None), ("a", "x", None, 1.0), ("a", "x", 1, float("nan")), ("a", "x", 0, float("inf"))]
    got = {r["g"]: r for r in R.ap_auc(spark.createDataFrame(rows, SHAPE), ["g"], "s", "y", None).collect()}
    assert set(got) == set(want)
    for g, (ap, auc) in want.items():
        assert got[g]["ap"] == pytest.approx(ap) and got[g]["auc"] == pytest.approx(auc)


@pytest.mark.parametrize("y, s, ap, auc", [([1, 1, 0, 0], [1, 0.9, 0, 0], 1.0, 1.0), ([0, 0], [1, 2], None, None), ([1] * 3, [1, 2, 3], 1.0, None), ([1, 1] + [0] * 18, [0.5] * 20, 0.1, 0.5), ([1, 0, 1, 0], [0.9, 0.8, 0.7, 0.7], None, None)])
def test_small_cases(spark, y, s, ap, auc):
    r = R.ap_auc(frame(spark, y, s), ["g"], "s", "y").first()
    want = brute(y, s)
    assert (r["ap"], r["auc"]) == tuple(None if v is None else pytest.approx(v, abs=1e-6) for v in want)
    if ap is not None:
        assert (r["ap"], r["auc"]) == (ap, auc)


def test_empty_cohort(spark):
    assert R.ap_auc(frame(spark, [], []), ["g"], "s", "y").count() == 0
    r = R.ap_auc(frame(spark, [], []), [], "s", "y").first()
    assert r["ap"] is None and r["auc"] is None


def test_tie_rules(spark):
    flat = frame(spark, [1, 1] + [0] * 18, [0.5] * 20)
    r = R.recall_expected(flat, ["g"], "s", "y", 0.1).first()
    assert (r["k"], r["recall"], r["precision"]) == (2, 0.1, 0.1)
    ten = frame(spark, [1] + [0] * 9, [0.5] * 10)
    a = R.recall_hashed(ten, ["g"], "id", "s", "y", 0.1, "salt").first()
    assert (a["k"], a["tied"]) == (1, 10)
    chosen = min((f"c{k}" for k in range(10)), key=lambda i: __import__("hashlib").sha256(f"salt:{i}".encode()).hexdigest())
    flipped = spark.createDataFrame([("g", f"c{k}", int(f"c{k}" == chosen), 0.5) for k in range(10)], SHAPE)
    assert R.recall_hashed(flipped, ["g"], "id", "s", "y", 0.1, "salt").first()["recall"] == 1.0


def test_thresholds(spark):
    r = R.best_threshold(frame(spark, [1, 0, 1, 0, 0, 1], [0.9, 0.8, 0.6, 0.4, 0.3, 0.2]), ["g"], "s", "y").first()
    assert r["threshold"] == 0.6
    r = R.best_threshold(frame(spark, [1, 0, 1, 0], [0.9, 0.8, 0.7, 0.1]), ["g"], "s", "y").first()
    assert (r["threshold"], r["f1"]) == (0.7, 0.8)
    assert R.best_threshold(frame(spark, [0, 0], [1, 2]), ["g"], "s", "y").first()["threshold"] is None
    t = R.at_threshold(frame(spark, [1, 0, 1], [0.9, 0.6, 0.2]), ["g"], "s", "y", F.lit(0.5)).first()
    assert (t["tp"], t["fp"], t["fn"], t["tn"], t["f1"]) == (1, 1, 1, 0, 0.5)
    assert R.at_threshold(frame(spark, [0], [0.1]), ["g"], "s", "y", F.lit(0.5)).first()["precision"] == 0.0


def test_bundle_notes(spark):
    rows = frame(spark, [0] * 10, range(10), "none").union(frame(spark, [1] * 10, range(10), "all")).union(frame(spark, [1, 0], [1, 2], "few"))
    got = {r["g"]: r for r in R.metric_bundle(rows, ["g"], "id", "s", "y", "x", 0.1, 5).collect()}
    assert got["none"]["note"] == "nothing to rank" and got["none"]["ap"] is None
    assert got["all"]["note"] == "only positives" and (got["all"]["ap"], got["all"]["auc"]) == (1.0, None)
    assert got["few"]["note"] == "group too small" and got["few"]["ap"] is None


def test_rank_correlation(spark):
    df = spark.createDataFrame([("g", float(k), float(k // 2)) for k in range(10)] + [("flat", 1.0, float(k)) for k in range(3)] + [("g", None, 1.0)], "g string, x double, y double")
    got = {r["g"]: r for r in R.spearman(df, ["g"], "x", "y").collect()}
    assert got["g"]["n"] == 10 and 0.97 < got["g"]["rho"] < 1 and got["flat"]["rho"] is None
