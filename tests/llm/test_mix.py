import random

from pyspark.sql import functions as F

from millrace.llm.mix import Mix, largest_total, min_cost_flow, quotas

DOCS, GOALS = "doc_id long, source string, text string, tokens long", "source string, target_share double, max_repeats int"


def documents(n=3000, seed=1):
    rnd = random.Random(seed)
    rows = [(k, rnd.choice(["a"] * 20 + ["b"] * 5 + ["c", " C ", None, "z"]), f"text {k}", rnd.randrange(1, 60)) for k in range(n)]
    return rows + [(n, "a", None, 0), (n + 1, "a", "", 0), (n + 2, "a", "text 1", 5)]


def test_shares_and_caps(spark):
    goals = spark.createDataFrame([("a", 0.5, 1), ("b", 0.3, 3), ("c", 0.15, 4), ("none", 0.05, 2)], GOALS)
    docs = spark.createDataFrame(documents(), DOCS)
    m = Mix(docs, "doc_id", goals)
    report = {r["source"]: r for r in m.report.collect()}
    for s, w in (("a", 0.5), ("b", 0.3), ("c", 0.15)):
        assert abs(report[s]["actual_share"] - w / 0.95) < 0.01, report[s]
    assert report["none"]["actual_share"] == 0 and report["none"]["available_tokens"] == 0
    rows = m.selection.collect()
    cap = {"a": 1, "b": 3, "c": 4}
    assert all(1 <= r["uses"] <= cap[r["source"]] for r in rows)
    assert len({(r["doc_id"], r["source"]) for r in rows}) == len(rows)
    again = Mix(docs.repartition(7), "doc_id", goals)
    assert {tuple(r) for r in again.selection.collect()} == {tuple(r) for r in rows}


def test_overlapping_sources(spark):
    rows = [(k, "a", f"shared {k}", 10) for k in range(50)] + [(100 + k, "b", f"shared {k}", 10) for k in range(50)] + [(200 + k, "a", f"own {k}", 10) for k in range(20)]
    goals = spark.createDataFrame([("a", 0.5, 1), ("b", 0.5, 1)], GOALS)
    m = Mix(spark.createDataFrame(rows, DOCS), "doc_id", goals)
    got = m.selection.collect()
    text = {r[0]: r[2] for r in rows}
    assert all(r["uses"] == 1 for r in got)
    assert len({text[r["doc_id"]] for r in got}) == len(got)  # no text for both sources
    assert abs(m.total - 700) < 2
    assert abs(sum(r["tokens"] for r in got if r["source"] == "b") - 350) <= 10


def test_given_total_beyond_reach_and_empty(spark):
    goals = spark.createDataFrame([("a", 1.0, 2), ("a", 0.0, None), (None, 0.4, 1)], GOALS)
    m = Mix(spark.createDataFrame([(1, "A", "x", 10), (2, "a", "y", 10)], DOCS), "doc_id", goals, total=1000)
    assert sum(r["tokens"] * r["uses"] for r in m.selection.collect()) == 40
    none = Mix(spark.createDataFrame([], DOCS), "doc_id", goals)
    assert none.selection.count() == 0 and [r["tokens"] for r in none.report.collect()] == [0]
    nothing = Mix(spark.createDataFrame([(1, "A", "x", 10)], DOCS), "doc_id", goals.limit(0))
    assert nothing.selection.count() == 0 and nothing.report.count() == 0


def test_flow_spreads_before_it_repeats():
    flow = min_cost_flow({"p": 10, "q": 10}, {"p": ["s"], "q": ["s"]}, {"s": 3}, {"s": 30})
    assert flow[("p", "s")] + flow[("q", "s")] == 30 and max(flow.values()) <= 20
    assert largest_total({"p": 10}, {"p": ["s"]}, {"s": 3}, {"s": 0.5}) == 30
    assert quotas(10, {}) == {}


def test_clashing_names(spark):
    docs = spark.createDataFrame([(1, "a", "x", 10)], DOCS).withColumns({"pattern": F.lit(1), "uses": F.lit(2), "before": F.lit(3)})
    assert Mix(docs, "doc_id", spark.createDataFrame([("a", 1.0, 1)], GOALS)).selection.count() == 1


def test_more_patterns_than_the_flow_takes(spark):
    rnd = random.Random(6)
    names = [f"s{k}" for k in range(7)]
    rows = [(10 * k + j, s, f"text {k}", 10) for k in range(900) for j, s in enumerate(rnd.sample(names, rnd.randrange(1, 5)))]
    goals = spark.createDataFrame([(s, 1 / 7, 2) for s in names], GOALS)
    m = Mix(spark.createDataFrame(rows, DOCS), "doc_id", goals, most=20)
    report = {r["source"]: r["actual_share"] for r in m.report.collect()}
    assert all(abs(report[s] - 1 / 7) < 0.01 for s in names)
    text = {r[0]: r[2] for r in rows}
    uses = {}
    for r in m.selection.collect():
        uses[text[r["doc_id"]]] = uses.get(text[r["doc_id"]], 0) + r["uses"]
    assert max(uses.values()) <= 2
    assert abs(sum(uses.values()) - 1800) < 40  # nothing is dropped: every text is used twice
