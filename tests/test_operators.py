import hashlib
import math
import random

import pytest
from pyspark.sql import functions as F

from millrace.functions import ngrams as N
from millrace.functions import text as T
from millrace.operators import contracts as C
from millrace.operators import dedup as D
from millrace.operators import evaluate as E
from millrace.operators import evidence as V
from millrace.operators import retrieval as Q
from millrace.operators import scaling as A
from millrace.operators import splitting as S
from millrace.operators.history import history_features


def test_components(spark):
    df = spark.createDataFrame([("a", "x", None), ("b", "y", "k"), ("c", "x", "k"), ("d", "z", None), ("e", None, None)], "id string, p string, q string")
    assert {r["id"]: r["component"] for r in D.components(df, "id", ["p", "q"]).collect()} == {"a": "a", "b": "a", "c": "a", "d": "d", "e": "e"}
    chain = spark.createDataFrame([(f"n{k:03d}", str(k // 2), str((k + 1) // 2)) for k in range(120)], "id string, p string, q string")
    assert {r["component"] for r in D.components(chain, "id", ["p", "q"]).collect()} == {"n000"}
    assert D.components(df.limit(0), "id", ["p", "q"]).count() == 0


def test_duplicate_keys(spark):
    edits = spark.createDataFrame([("a", 1, "add", "x"), ("a", 2, "add", "y"), ("b", 9, "add", "y"), ("b", 3, "add", "x"), ("c", 1, "add", "y "), ("c", 2, "add", " x")], "id string, n int, op string, text string")
    records = spark.createDataFrame([("a", "m"), ("b", "m"), ("c", " m"), ("d", None)], "id string, message string")
    got = {r["id"]: r for r in D.duplicate_keys(records, "id", "message", D.lines_of(edits, "id", "n", "op", "text")).collect()}
    assert got["a"]["exact_key"] == got["b"]["exact_key"] != got["c"]["exact_key"]
    assert got["a"]["normalized_key"] == got["c"]["normalized_key"] and got["d"]["code_key"] is None and got["d"]["n_add"] == 0


def test_group_quota_and_nesting(spark):
    ids = spark.createDataFrame([(f"i{k:03d}", f"g{k // 4}") for k in range(400)], "id string, g string")
    rows = S.quota_rows(ids, "id", "s", 0.05).filter("chosen").count()
    assert rows == 20
    groups = S.quota_groups(ids, "id", "g", "s", 0.05)
    assert groups.groupBy("g").agg(F.countDistinct("chosen").alias("n")).filter("n > 1").count() == 0
    assert 16 <= groups.filter("chosen").count() <= 32
    many = spark.range(3000).select(F.col("id").cast("string").alias("id"))
    quarter, half = (many.filter(S.nested_fraction(F.col("id"), "s", f)) for f in (0.25, 0.5))
    assert quarter.join(half, "id", "left_anti").count() == 0 and 0.22 < quarter.count() / 3000 < 0.28 and 0.46 < half.count() / 3000 < 0.54
    sizes = spark.createDataFrame([(str(k), 10) for k in range(20)], "id string, n int")
    assert S.budget_cut(sizes, "s", "id", "n", 95).count() == 10 and S.budget_cut(sizes, "s", "id", "n", 100).count() == 10


def test_temporal_split(spark):
    rows = [("a", "2024-01-01", "2024-01-02", "p1", "g1"), ("b", "2024-01-03", "2024-01-04", "p1", None), ("c", "2024-01-05", "2024-03-01", "p2", None), ("d", "2024-01-06", "2024-01-07", "p2", None), ("e", "2024-02-10", "2024-02-11", "p3", "g2"), ("f", "2024-03-10", None, "p4", "g2"), ("h", "2024-03-11", None, "p5", None), ("i", "2024-01-07", None, "p6", None), ("j", "2024-02-12", "2024-02-13", None, None)]
    df = spark.createDataFrame(rows, "id string, at string, seen string, patch string, g string").withColumns({"at": F.col("at").cast("timestamp"), "seen": F.col("seen").cast("timestamp")})
    got = {r["id"]: (r["role"], r["reason"]) for r in S.temporal_split(df, "id", "at", "seen", "patch", ["g"], "2024-02-01", "2024-03-01").collect()}
    assert got == {"a": ("train", None), "b": ("train", "duplicate_patch"), "c": ("train", "label_late"), "d": ("train", None), "e": ("valid", "crosses_split"), "f": ("test", "crosses_split"), "h": ("test", None), "i": ("train", "label_late"), "j": ("valid", None)}


def test_temporal_split_through_every_group(spark, tmp_path):
    from millrace.plans.duplicates import temporal_split

    rows = [("a", "2024-01-01", "g1"), (" A", "2024-01-01", " G2"), ("b", "2024-09-01", "g2"), ("c", "2024-01-02", None), ("c", "2024-01-02", None)]
    m = spark.createDataFrame(rows, "id string, at string, group_id string").select("id", F.col("at").cast("timestamp").alias("prediction_at"), F.col("at").cast("timestamp").alias("label_available_at"), "group_id")
    m.write.parquet(str(tmp_path / "internal_manifest.parquet"))
    spark.createDataFrame([("a", "p1"), ("b", None), ("c", None)], "change_id string, content_hash string").write.parquet(str(tmp_path / "changes.parquet"))
    got = sorted((r["change_id"], r["role"], r["reason"]) for r in temporal_split(spark, str(tmp_path)).collect())
    assert got == [("a", "train", "crosses_split"), ("b", "valid", "crosses_split"), ("c", "train", None)]


def test_exclusions_and_leak(spark):
    k = spark.createDataFrame([("a", "train", "x", "c1", 1), ("b", "train", "y", "c2", 0), ("c", "test", "x", "c9", 1), ("d", "valid", "z", "c2", 1), ("e", "train", "q", None, 0)], "id string, split string, exact string, code string, y int")
    assert {r["id"]: r["reason"] for r in S.controlled_exclusions(k, "id", "split", "exact", "code").collect()} == {"a": "exact_duplicate_in_eval", "b": "code_duplicate_in_eval"}
    leak = {r["split"]: tuple(r)[1:] for r in S.near_duplicate_leak(k, "split", "code", "y").collect()}
    assert leak == {"test": (1, 0, 0), "valid": (1, 1, 0)}


def test_leak_without_labels(spark):
    k = spark.createDataFrame([("train", "x", None), ("train", "y", 1), ("train", "y", None), ("test", "x", 1), ("test", "y", None), ("test", "y", 1), ("test", "z", 1), ("test", None, None)], "split string, code string, y int")
    assert [tuple(r) for r in S.near_duplicate_leak(k, "split", "code", "y").collect()] == [("test", 5, 3, 1)]


def test_leak_of_all(spark, tmp_path):
    from millrace.plans.duplicates import leak_of_all

    def put(name, rows, schema):
        spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / f"{name}.parquet"))

    put("splits", [("a", "train", "upstream-provided"), (" B", "Test ", "upstream-provided"), ("c", "test", "upstream-provided"), ("d", "test", "upstream-provided")], "change_id string, split string, split_version string")
    put("changes", [("a", "the same message of a change"), ("b", "The same  message of a change"), ("c", "short"), ("d", None)], "change_id string, message string")
    put("edits", [("a", 1, "add", "x = 1"), ("a", 2, "add", "y"), ("c", 2, "add", "y"), ("c", 1, "add", " x=1"), ("c", 1, "add", " x=1"), ("d", 1, "add", " ")], "change_id string, line_order int, op string, text string")
    put("internal_manifest", [("d", 1)], "id string, label int")
    assert sorted(tuple(r) for r in leak_of_all(spark, str(tmp_path)).collect()) == [("change", "test", 3, 1, 0), ("message", "test", 3, 1, 0)]


def test_history_of_a_busy_file_and_author(spark):
    """Half of all rows are one file's and one author's; slices and blocks are
    far smaller.  Held against a pass over the commits in their order."""
    rnd = random.Random(3)
    commits, files = [], []
    for k in range(300):
        dev = "bot" if k % 2 else f"d{rnd.randrange(40)}"
        commits.append((f"c{k}", k, dev, 1_600_000_000 + k * 50_000 + rnd.randrange(-90_000, 90_000)))
        for f in {"hot.lock", *(f"f{rnd.randrange(30)}" for _ in range(rnd.randrange(3)))} if k % 4 else {"hot.lock"}:
            files.append((f"c{k}", f, f[0], f[:2], rnd.randrange(9), rnd.randrange(5)))
    a = spark.createDataFrame(commits, "commit string, seq long, dev string, at long")
    b = spark.createDataFrame(files, "commit string, file string, subsystem string, dir string, added long, deleted long")
    got = {r["commit"]: r for r in history_features(a, b, slice_rows=60, block=7, few=10).collect()}
    assert len(got) == 300
    state = {}
    for c, k, dev, at in commits:
        mine = [r for r in files if r[0] == c]
        r = got[c]
        loc = [sum(x[4] - x[5] for x in files if x[1] == f[1] and int(x[0][1:]) < k) for f in mine]
        authors = {d for f in mine for d, n in state.get(f[1], [])}
        ages = [(at - state[f[1]][-1][1]) / 86400 if f[1] in state else 0.0 for f in mine]
        before = [x for x in commits if x[1] < k and x[2] == dev]
        assert (r["ndev"], r["nuc"], r["exp"]) == (len(authors), sum(len(state.get(f[1], [])) for f in mine), len(before))
        assert math.isclose(r["lt"], sum(loc) / len(loc), abs_tol=1e-9) and math.isclose(r["age"], sum(ages) / len(ages), abs_tol=1e-9)
        assert math.isclose(r["rexp"], sum(1 / ((at - x[3]) / 86400 / 365 + 1) for x in before), rel_tol=1e-9)
        assert r["sexp"] == sum(sum(x[2] == dev and any(g[0] == x[0] and g[2] == s for g in files) for x in before) for s in {f[2] for f in mine})
        for f in mine:
            state.setdefault(f[1], []).append((dev, at))


def test_history_of_four_commits(spark):
    base, day = 1_600_000_000, 86_400
    commits = spark.createDataFrame([("1", 1, "ann", base), ("2", 2, "bob", base + 2 * day), ("4", 4, "ann", base + 4 * day)], "commit string, seq long, dev string, at long")
    files = spark.createDataFrame([("1", "core/A.java", 3, 0), ("2", "core/A.java", 2, 1), ("4", "core/A.java", 1, 0), ("4", "web/b.py", 2, 0)], "commit string, file string, added int, deleted int").withColumns({"subsystem": T.subsystem(F.col("file")), "dir": T.directory(F.col("file"))})
    got = {r["commit"]: r for r in history_features(commits, files).collect()}
    two, last = got["2"], got["4"]
    assert (two["nf"], two["la"], two["ld"], two["lt"], two["ndev"], two["nuc"], two["exp"], two["age"]) == (1, 2, 1, 3.0, 1, 1, 0, 2.0)
    assert (last["nf"], last["ns"], last["nd"], last["ndev"], last["nuc"], last["exp"], last["sexp"]) == (2, 2, 2, 2, 2, 1, 1)
    assert math.isclose(last["entropy"], math.log2(3) - 2 / 3) and math.isclose(last["age"], 1.0) and math.isclose(last["rexp"], 1 / (4 / 365 + 1))
    assert history_features(commits.limit(0), files).count() == 0


def test_budget(spark):
    def cut(a, d, b):
        row = spark.createDataFrame([(a, d)], "a array<bigint>, d array<bigint>").select(V.allocate(F.col("a"), F.col("d"), F.lit(b).cast("bigint")).alias("k")).first()["k"]
        return row["n_add"], row["n_del"]

    assert cut([5, 5], [5], 100) == (2, 1) and cut([], [], 5) == (0, 0) and cut([50], [], 5) == (0, 0)
    a, d = cut([10] * 50, [10] * 50, 100)
    assert a > 0 and d > 0 and (a + d) * 10 <= 100


def test_scaler_and_linear_score(spark):
    df = spark.createDataFrame([(None, 1.0), (float("nan"), 2.0)], "a double, b double")
    fitted = A.collect_scaler(A.fit_scaler(df, ["a", "b"], lambda x: x))
    assert fitted["a"] == (0.0, 0.0, 1.0) and fitted["b"] == (1.5, 1.5, 0.5)
    z = A.apply_scaler(df, ["a", "b"], fitted, lambda x: x, indicators=True).orderBy("b").collect()
    assert [r["b_z"] for r in z] == [-1.0, 1.0] and [r["a_missing"] for r in z] == [1.0, 1.0]
    assert A.apply_scaler(df, ["b"], fitted, lambda x: x).select(A.linear_score(["b_z"], [0.0], 0.0).alias("s")).first()["s"] == 0.5


def test_logistic_regression_learns(spark):
    rnd = random.Random(3)
    rows = [(x := rnd.gauss(0, 1), int(x + rnd.gauss(0, 0.5) > 0.5)) for _ in range(300)]
    df = spark.createDataFrame(rows, "x double, y int")
    _, _, ap = A.train_logistic(df, df, ["x"], "y", (0.1, 1.0))
    assert ap > 0.8
    with pytest.raises(ValueError):
        A.train_logistic(df.filter("y = 0"), df, ["x"], "y")


def test_deployments_and_coverage(spark):
    m = spark.createDataFrame([("d", "a"), ("d", "b"), ("d", "b"), ("d", "none"), ("e", "c"), (None, "a")], "u string, i string")
    s = spark.createDataFrame([("a", 0.5), ("b", 0.5), ("c", 1.0)], "i string, s double")
    got = {r["u"]: r for r in E.aggregate_scores(m, s, "u", "i", "s").collect()}
    assert (got["d"]["n_items"], got["d"]["n_scored"], got["d"]["max_score"]) == (3, 2, 0.5) and math.isclose(got["d"]["noisy_or"], 0.75) and got["e"]["noisy_or"] == 1.0
    p = spark.createDataFrame([("a", "m", "ok"), ("b", "m", "failed"), ("a", "n", "ok"), ("b", "n", "ok")], "id string, m string, st string")
    y = spark.createDataFrame([("a", 0), ("b", 1), ("c", 1)], "id string, y int")
    assert [r["id"] for r in E.success_subset(p, "id", "m", F.col("st") == "ok").collect()] == ["a"]
    assert {r["m"]: tuple(r)[1:] for r in E.coverage(p, "id", "m", F.col("st") == "ok", y, "y").collect()} == {"m": (1, 1, 1, 2), "n": (2, 0, 1, 1)}


def test_deployments_of_every_variant(spark, small):
    from millrace.plans.evaluation import deployment_scores_all

    m = spark.createDataFrame([("d", "a"), ("d", "b"), ("d", "b"), ("e", "c")], "u string, i string")
    s = spark.createDataFrame([("v", "a", 0.5), ("v", "b", 0.5), ("w", "c", 1.5)], "m string, i string, s double")
    got = {(r["m"], r["u"]): tuple(r)[2:6] for r in E.aggregate_scores(m, s, "u", "i", "s", ["m"]).collect()}
    assert got == {("v", "d"): (2, 2, 0.5, 0.5), ("v", "e"): (1, 0, None, None), ("w", "d"): (2, 0, None, None), ("w", "e"): (1, 1, 1.0, 1.0)}
    ok = spark.read.parquet(f"{small}/predictions.parquet").filter("status = 'ok' and score is not null and not isnan(score) and abs(score) < double('inf')")
    assert deployment_scores_all(spark, small).select("variant_id").distinct().count() == ok.select("variant_id").distinct().count() > 1


def test_bootstrap(spark):
    rnd = random.Random(2)
    rows = [(m, f"c{k % 12}", int(rnd.random() < 0.3), rnd.random()) for m in ("a", "b") for k in range(240)]
    df = spark.createDataFrame(rows, "m string, c string, y int, s double")
    one = {r["m"]: tuple(r) for r in E.bootstrap_ap(df, "m", "s", "y", "c", 60, 1).collect()}
    assert one == {r["m"]: tuple(r) for r in E.bootstrap_ap(df.repartition(3), "m", "s", "y", "c", 60, 1).collect()}
    assert all(low <= ap <= high and n == 60 for _, ap, low, high, n in one.values())
    per = spark.createDataFrame([("a", 1, 0.5), ("a", 2, 0.6), ("b", 1, 0.4), ("b", 2, 0.7)], "m string, r int, v double")
    d = E.paired_difference(per, "a", "m", "r", "v").first()
    assert math.isclose(d["mean_difference"], 0.0, abs_tol=1e-12) and d["share_not_above"] == 0.5


def test_draws(spark):
    names = spark.createDataFrame([(f"c{k}",) for k in range(40)] * 2 + [(None,)], "c string")
    got = {r["c"]: r["times"] for r in E.draw_clusters(names.repartition(5), "c", 30, 3).collect()}
    assert got == {r["c"]: r["times"] for r in E.draw_clusters(names.coalesce(1), "c", 30, 3).collect()}
    assert len(got) <= 40 and all(sum(t[r] for t in got.values()) == 40 for r in range(30))
    assert 0.3 < sum(t == 0 for v in got.values() for t in v) / (30 * len(got)) < 0.45
    assert E.draw_clusters(names.limit(0), "c", 5, 3).count() == 0


def test_bootstrap_of_one_large_score(spark):
    """Half of all rows have one score: the replicates are those of brute force."""
    rows = [("m", f"c{k % 30}", k % 3 == 0, 0.5 if k % 2 else k / 5000) for k in range(4000)]
    df = spark.createDataFrame([(m, c, int(y), s) for m, c, y, s in rows], "m string, c string, y int, s double")
    times = {r["c"]: r["times"] for r in E.draw_clusters(df, "c", 4, 9).collect()}
    got = {r["replicate"]: r["ap"] for r in E.bootstrap_values(df, "m", "s", "y", "c", 4, 9).collect()}
    for r in range(4):
        per = {}
        for _, c, y, s in rows:
            tp, n = per.get(s, (0, 0))
            w = times[c][r] if c in times else 0
            per[s] = (tp + w * y, n + w)
        positives = sum(tp for tp, _ in per.values())
        ap = ctp = cn = 0
        for s in sorted(per, reverse=True):
            ctp, cn = ctp + per[s][0], cn + per[s][1]
            ap += per[s][0] / positives * ctp / cn if cn else 0
        assert math.isclose(got[r], ap, rel_tol=1e-9)


def test_seed_pairs(spark):
    runs = spark.createDataFrame([("a", 1, 0.5), ("a", 2, 0.7), ("b", 1, 0.6), ("b", 2, 0.9), ("c", 9, 0.6)], "m string, seed int, v double")
    got = {r["m"]: (r["n_pairs"], round(r["mean_difference"], 9), r["sd"] and round(r["sd"], 9)) for r in E.seed_pairs(runs, "a", "m", "seed", "v").collect()}
    assert got == {"b": (2, 0.15, round(0.1 / math.sqrt(2), 9)), "c": (2, 0.0, round(0.2 / math.sqrt(2), 9))}


def test_paired_bootstrap_values(spark):
    rows = [(m, f"c{k % 6}", k % 2, float(k % 2) if m == "a" else 0.5) for m in ("a", "b") for k in range(36)]
    df = spark.createDataFrame(rows + [("a", "c6", 1, 0.9), ("b", "c6", 0, 0.9)], "m string, c string, y int, s double")
    per = E.bootstrap_values(df, "m", "s", "y", "c", 30, 1)
    by = {}
    for r in per.collect():
        by.setdefault(r["replicate"], {})[r["m"]] = r["ap"]
    gaps = [v["a"] - v["b"] for v in by.values() if v["a"] is not None and v["b"] is not None]
    d = E.paired_difference(per, "b", "m", "replicate", "ap").first()
    assert math.isclose(d["mean_difference"], sum(gaps) / len(gaps)) and math.isclose(d["share_not_above"], sum(g <= 0 for g in gaps) / len(gaps))


def test_retrieval(spark):
    items = spark.createDataFrame([(f"i{k}", [math.cos(k / 9), math.sin(k / 9)], k % 2) for k in range(30)], "id string, v array<double>, y int")
    got = Q.class_neighbours(items.filter("id = 'i3'"), items, "id", "v", "y", 2, "s").collect()
    assert {(r["label"], r["item"]) for r in got} == {(0, "i2"), (0, "i4"), (1, "i1"), (1, "i5")} and len(got) == 4
    docs = spark.createDataFrame([("a", "abcd abcd"), ("b", "abcd"), ("c", None), ("d", "xy"), ("e", "zzzz")], "id string, t string")
    w = Q.tfidf(docs, "id", "t").collect()
    norms = {}
    for r in w:
        norms[r["id"]] = norms.get(r["id"], 0) + r["weight"] ** 2
    assert set(norms) == {"a", "b"} and all(math.isclose(v, 1.0) for v in norms.values())


def test_ngrams_of_lots():
    """Counts of many texts at once are those of each, in any alphabet."""
    r = random.Random(4)
    vast = "".join(map(chr, range(0x4E00, 0x4E00 + 6400)))
    texts = ["".join(r.choice(a) for _ in range(r.randrange(60))) for a in ("ab \n", "xyz\0\t  ", "\xe9€\U0001f600a", vast) for _ in range(40)] + [None, "", "ab", "abc", vast, vast + "abc"]
    want = [N.char_ngrams(t or "") for t in texts]
    having, times = {}, {}
    for terms, h, n in N.count_ngrams(texts, 3, 5):
        for t, x, y in zip(terms.to_pylist(), h.tolist(), n.tolist(), strict=True):
            having[t], times[t] = having.get(t, 0) + x, times.get(t, 0) + y
    assert having == {t: sum(t in w for w in want) for t in having} and times == dict(sum(want, N.Counter()))
    known = sorted(having)[::3]
    at = 0
    for sizes, places, counts in N.Vocabulary(known, 3, 5).counts(texts):
        ends = sizes.cumsum()
        for e, n in zip(ends, sizes, strict=True):
            assert {known[p]: c for p, c in zip(places[e - n : e], counts[e - n : e], strict=True)} == {t: c for t, c in want[at].items() if t in set(known)}
            at += 1
    assert at == len(texts)


def test_text_neighbours(spark, monkeypatch):
    """Brute force in the place of lots, common and rare terms and blocks of queries; nulls, copies and ties."""
    r = random.Random(7)
    words = ["alpha", "beta", "gamma", "delta", "omega", "sigma", "kappa", "zeta"]
    rows = [(k, " ".join(r.choice(words) for _ in range(r.randrange(1, 5))), r.choice("xyz")) for k in range(150)] + [(150, None, "x"), (151, "", "y"), (152, "alpha beta", None), (153, "qq", "z")]
    df = spark.createDataFrame(rows, "id long, t string, y string")
    texts = {k: N.char_ngrams(t or "") for k, t, _ in rows}
    df_of = N.Counter(g for c in texts.values() for g in c)
    idf = {g: math.log((1 + len(rows)) / (1 + n)) + 1 for g, n in df_of.items() if n >= 2}
    vectors = {}
    for k, c in texts.items():
        w = {g: n * idf[g] for g, n in c.items() if g in idf}
        norm = math.sqrt(sum(x * x for x in w.values()))
        vectors[k] = {g: x / norm for g, x in w.items()}
    want = set()
    for q, qt, _ in rows:
        if q % 5 == 0:
            for y in "xyz":
                near = [(-(round(sum(x * vectors[i].get(g, 0) for g, x in vectors[q].items()), 6) + 0.0), hashlib.sha256(f"s:{i}".encode()).hexdigest(), i) for i, t, c in rows if c == y and i != q and (t is None or t != qt)]
                want |= {(q, y, i, -s + 0.0, k + 1) for k, (s, _, i) in enumerate(sorted(near)[:3])}
    for common, most in ((0.06, 6144), (0.4, 20), (2, 0)):
        for name, value in (("COMMON", common), ("COMMON_MOST", most), ("ASKED", 8)):
            monkeypatch.setattr(Q, name, value)
        got = Q.text_neighbours(F.col("id") % 5 == 0, df, "id", "t", "y", 3, "s").collect()
        assert {tuple(x) for x in got} == want


def test_vocabulary_is_chosen_on_the_executors(spark):
    """Tasks don't each send the driver as many terms as are kept."""
    rows = spark.range(4000).select("id", F.sha2((F.col("id") % 2000).cast("string"), 512).alias("t")).repartition(4)
    conf, limit = spark.sparkContext._jsc.sc().conf(), "spark.driver.maxResultSize"
    before = conf.get(limit, "1g")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    conf.set(limit, "400k")
    try:
        weights = Q.tfidf(rows, "id", "t", max_features=5000)
    finally:
        conf.set(limit, before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    counts = N.Counter()
    for k in range(2000):
        counts.update(N.char_ngrams(hashlib.sha512(str(k).encode()).hexdigest()))
    assert {r["term"] for r in weights.select("term").distinct().collect()} == {*sorted(counts, key=lambda t: (-counts[t], t))[:5000]}


def test_contracts(spark):
    a = spark.createDataFrame([("x", 1), ("y", 2)], "id string, v int")
    b = spark.createDataFrame([("x", 5), ("y", 6)], "id string, w int")
    assert C.join_one_to_one(a, b, "id").count() == 2
    for bad in (b.union(b), b.limit(1)):
        with pytest.raises(C.ContractError):
            C.join_one_to_one(a, bad, "id")
    with pytest.raises(C.ContractError):
        C.join_many_to_one(a.withColumn("id", F.lit("q")), b, "id", complete=True)
    with pytest.raises(C.ContractError):
        C.forbid_columns(a.withColumnRenamed("v", "Label"), ["label"])
    with pytest.raises(C.ContractError):
        C.require_known(a, "id", ["x", "nowhere"])
    assert {r["key"]: r["n"] for r in C.overlap(a, b.withColumn("v", F.lit(2)), ["id", "v"]).collect()} == {"id": 2, "v": 1}
    w = C.waterfall(a, [("not_x", F.col("id") == "x"), ("not_big", F.col("v") > 5)]).first()
    assert (w["n"], w["not_x"], w["not_big"], w["eligible"]) == (2, 1, 1, 0)
    r = a.select(C.first_failure([("one", F.col("v") == 1), ("any", F.lit(True)), ("null", F.lit(None).cast("boolean"))]).alias("r")).collect()
    assert [x["r"] for x in r] == ["one", "any"]
