"""History features, deployments, coverage, scaling, evidence and retrieval."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.functions import times as Z
from millrace.functions.keys import id_key
from millrace.functions.numbers import is_finite
from millrace.operators import contracts as C
from millrace.operators import evaluate as E
from millrace.operators import evidence as V
from millrace.operators import ranking as R
from millrace.operators import retrieval as Q
from millrace.operators import scaling as A
from millrace.operators.history import history_features
from millrace.plans.metrics import SCORED, labels, scored, scores
from millrace.plans.tables import table

PERIOD = ("2023-01-01", "2025-07-01")
SCALED = ("ns", "nd", "nf", "entropy", "la", "ld", "lt", "fix", "ndev", "age", "nuc", "exp", "rexp", "sexp")
WEIGHTS = (0.1, 0.1, 0.2, 0.3, 0.5, 0.1, -0.2, 0.1, 0.2, -0.1, 0.2, -0.3, 0.1, -0.1)


def history(spark: SparkSession, d: str) -> DataFrame:
    """Orders as commits: parts are files, suppliers their directories, customers authors."""
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("commit"), (F.unix_timestamp("o_orderdate") * 10_000_000 + F.col("o_orderkey")).alias("seq"), F.col("o_custkey").alias("dev"), F.unix_timestamp("o_orderdate").alias("at"))
    f = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("commit"), F.col("l_partkey").alias("file"), F.pmod(F.col("l_partkey"), F.lit(7)).alias("subsystem"), F.pmod(F.col("l_partkey"), F.lit(49)).alias("dir"), F.col("l_quantity").alias("added"), F.col("l_linenumber").alias("deleted"))
    h = history_features(o, f)
    return h.select("commit", "ns", "nd", "nf", "la", "ld", *[F.round(c, 6).alias(c) for c in ("entropy", "lt", "age", "rexp")], "ndev", "nuc", "exp", "sexp")


HISTORY = """
WITH f AS (SELECT l_orderkey AS c, l_partkey AS file, max(l_partkey % 7) AS sub, max(l_partkey % 49) AS dir, sum(l_quantity)::DOUBLE AS a, sum(l_linenumber)::DOUBLE AS d FROM lineitem GROUP BY 1, 2),
r AS (SELECT f.*, o_custkey AS dev, epoch(o_orderdate)::BIGINT AS tt, epoch(o_orderdate)::BIGINT * 10000000 + c AS q FROM f JOIN orders ON o_orderkey = c),
h AS (SELECT *, coalesce(sum(a - d) OVER w, 0) AS loc, count(*) OVER w AS uses, last_value(tt) OVER w AS la FROM r WINDOW w AS (PARTITION BY file ORDER BY q ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT c, sum(a + d) AS t FROM r GROUP BY 1),
own AS (SELECT h.c, count(DISTINCT sub) AS ns, count(DISTINCT dir) AS nd, count(*) AS nf, sum(a) AS la, sum(d) AS ld, abs(round(coalesce(sum(CASE WHEN a + d > 0 THEN (a + d) / t * log2((a + d) / t) END), 0), 6)) AS entropy, round(avg(loc), 6) AS lt,
        round(sum(coalesce((tt - la) / 86400.0::DOUBLE, 0)) / count(*), 6) AS age, sum(uses)::BIGINT AS nuc FROM h JOIN t USING (c) GROUP BY h.c),
fd AS (SELECT file, dev, min(q) AS first FROM r GROUP BY 1, 2),
nd AS (SELECT r.c, count(DISTINCT fd.dev) AS ndev FROM r JOIN fd ON fd.file = r.file AND fd.first < r.q GROUP BY 1),
cm AS (SELECT DISTINCT c, q, dev, tt FROM r),
ex AS (SELECT x.c, count(y.c) AS exp, round(coalesce(sum(1.0::DOUBLE / ((x.tt - y.tt) / 86400.0::DOUBLE / 365.0 + 1.0)), 0), 6) AS rexp FROM cm x LEFT JOIN cm y ON y.dev = x.dev AND y.q < x.q GROUP BY 1),
sb AS (SELECT DISTINCT c, q, dev, sub FROM r),
sx AS (SELECT x.c, count(y.c) AS sexp FROM sb x LEFT JOIN sb y ON y.dev = x.dev AND y.sub = x.sub AND y.q < x.q GROUP BY 1)
SELECT own.c AS "commit", ns, nd, nf, la, ld, entropy, lt, age, rexp, coalesce(ndev, 0) AS ndev, nuc, exp, sexp FROM own LEFT JOIN nd USING (c) JOIN ex USING (c) JOIN sx USING (c)
"""


def _deployments(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "deployments").distinct()


def _steps() -> list:
    return [
        ("outside_period", Z.in_period(F.col("deployed_at"), *PERIOD)), ("window_incomplete", Z.window_complete(F.col("deployed_at"), F.col("observation_end"), 14)),
        ("label_unknown", is_finite(F.col("label"))), ("linkage_low", F.col("linkage_confidence") >= 0.9),
    ]


def waterfall(spark: SparkSession, d: str) -> DataFrame:
    return C.waterfall(_deployments(spark, d), _steps())


ELIGIBLE = f"""
dd AS (SELECT DISTINCT * FROM deployments),
w AS (SELECT *, deployed_at >= TIMESTAMP '{PERIOD[0]}' AND deployed_at < TIMESTAMP '{PERIOD[1]}' AS a, coalesce(observation_end >= deployed_at + INTERVAL 14 DAY, false) AS b,
      label IS NOT NULL AND NOT isnan(label) AND NOT isinf(label) AS c, coalesce(linkage_confidence >= 0.9, false) AS e FROM dd)
"""


def _unit_scores(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "mapping").select(id_key(F.col("deployment_id")).alias("deployment_id"), id_key(F.col("change_id")).alias("change_id"))
    s = scored(spark, d).filter("variant_id = 'b0-lr'").select("change_id", "score")
    return E.aggregate_scores(m, s, "deployment_id", "change_id", "score")


def _variant_scores(spark: SparkSession, d: str) -> DataFrame:
    """Scores of every variant and deployment; a change needs no label of its own."""
    m = table(spark, d, "mapping").select(id_key(F.col("deployment_id")).alias("deployment_id"), id_key(F.col("change_id")).alias("change_id"))
    return E.aggregate_scores(m, scores(spark, d), "deployment_id", "change_id", "score", ["variant_id"])


def deployment_scores(spark: SparkSession, d: str) -> DataFrame:
    return _unit_scores(spark, d).select("deployment_id", "n_items", "n_scored", *[F.round(c, 10).alias(c) for c in ("max_score", "mean_score", "noisy_or")])


def deployment_scores_all(spark: SparkSession, d: str) -> DataFrame:
    return _variant_scores(spark, d).select("variant_id", "deployment_id", "n_items", "n_scored", *[F.round(c, 10).alias(c) for c in ("max_score", "mean_score", "noisy_or")])


UNITS = """
mp AS (SELECT DISTINCT nullif(lower(regexp_replace(deployment_id, '^\\s+|\\s+$', '', 'g')), '') AS deployment_id, nullif(lower(regexp_replace(change_id, '^\\s+|\\s+$', '', 'g')), '') AS change_id FROM mapping),
us AS (SELECT deployment_id, count(*) AS n_items, count(score) AS n_scored, max((CASE WHEN score IS NOT NULL THEN greatest(0, least(1, score)) END)) AS max_score, avg((CASE WHEN score IS NOT NULL THEN greatest(0, least(1, score)) END)) AS mean_score, 1 - product(1 - (CASE WHEN score IS NOT NULL THEN greatest(0, least(1, score)) END)) AS noisy_or
       FROM mp LEFT JOIN (SELECT * FROM x WHERE variant_id = 'b0-lr') USING (change_id) WHERE deployment_id IS NOT NULL AND change_id IS NOT NULL GROUP BY 1)
"""

VARIANT_UNITS = """
mp AS (SELECT DISTINCT nullif(lower(regexp_replace(deployment_id, '^\\s+|\\s+$', '', 'g')), '') AS deployment_id, nullif(lower(regexp_replace(change_id, '^\\s+|\\s+$', '', 'g')), '') AS change_id FROM mapping),
us AS (SELECT variant_id, deployment_id, count(*) AS n_items, count(score) AS n_scored, max((CASE WHEN score IS NOT NULL THEN greatest(0, least(1, score)) END)) AS max_score, avg((CASE WHEN score IS NOT NULL THEN greatest(0, least(1, score)) END)) AS mean_score, 1 - product(1 - (CASE WHEN score IS NOT NULL THEN greatest(0, least(1, score)) END)) AS noisy_or
       FROM mp CROSS JOIN (SELECT DISTINCT variant_id FROM s) LEFT JOIN s USING (variant_id, change_id) WHERE deployment_id IS NOT NULL AND change_id IS NOT NULL GROUP BY 1, 2)
"""


def _eligible(spark: SparkSession, d: str, units: DataFrame | None = None) -> DataFrame:
    ok = F.lit(True)
    for _, c in _steps():
        ok = ok & F.coalesce(c, F.lit(False))
    return _deployments(spark, d).filter(ok).withColumn("deployment_id", id_key(F.col("deployment_id"))).join(_unit_scores(spark, d) if units is None else units, "deployment_id")


def deployment_metrics(spark: SparkSession, d: str) -> DataFrame:
    return R.ap_auc(_eligible(spark, d).withColumn("y", F.col("label").cast("int")).filter("service is not null"), ["service"], "max_score", "y")


def deployment_metrics_all(spark: SparkSession, d: str) -> DataFrame:
    return R.ap_auc(_eligible(spark, d, _variant_scores(spark, d)).withColumn("y", F.col("label").cast("int")).filter("service is not null"), ["variant_id", "service"], "max_score", "y")


def deployment_months(spark: SparkSession, d: str) -> DataFrame:
    return _deployments(spark, d).groupBy(Z.month(F.col("deployed_at")).alias("month")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("label") == 1).alias("positives"))


def size_bias(spark: SparkSession, d: str) -> DataFrame:
    return R.spearman(_eligible(spark, d).withColumn("all", F.lit("eligible")), ["all"], "max_score", "n_items")


def size_bias_all(spark: SparkSession, d: str) -> DataFrame:
    return R.spearman(_eligible(spark, d, _variant_scores(spark, d)), ["variant_id"], "max_score", "n_items")


def success_subset(spark: SparkSession, d: str) -> DataFrame:
    return E.success_subset(table(spark, d, "predictions").withColumn("change_id", id_key(F.col("change_id"))), "change_id", "variant_id", _ok())


def _ok():
    return (F.col("status") == "ok") & is_finite(F.col("score"))


OK = "status = 'ok' AND score IS NOT NULL AND NOT isnan(score) AND NOT isinf(score)"


def coverage_table(spark: SparkSession, d: str) -> DataFrame:
    return E.coverage(table(spark, d, "predictions").withColumn("change_id", id_key(F.col("change_id"))), "change_id", "variant_id", _ok(), labels(spark, d), "label")


def common_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Metrics of all variants on the changes that succeeded in each."""
    return R.ap_auc(scored(spark, d).join(success_subset(spark, d), "change_id", "left_semi"), ["variant_id"], "score", "label")


def replicates(spark: SparkSession, d: str) -> DataFrame:
    """Mean and sample deviation of average precision over seeds."""
    p = table(spark, d, "predictions").filter(_ok()).groupBy("variant_id", "seed", id_key(F.col("change_id")).alias("change_id")).agg(F.max("score").alias("score"))
    per = R.ap_auc(p.join(labels(spark, d), "change_id"), ["variant_id", "seed"], "score", "label", None)
    return per.groupBy("variant_id").agg(F.count("ap").alias("n_seeds"), F.round(F.avg("ap"), 6).alias("mean_ap"), F.round(F.stddev_samp("ap"), 6).alias("sd_ap"))


def best_seed(spark: SparkSession, d: str) -> DataFrame:
    """The seed with the best average precision (3 places), of equal ones the least."""
    p = table(spark, d, "predictions").filter(_ok()).groupBy("variant_id", "seed", id_key(F.col("change_id")).alias("change_id")).agg(F.max("score").alias("score"))
    per = R.ap_auc(p.join(labels(spark, d), "change_id"), ["variant_id", "seed"], "score", "label", 3).filter("ap is not null")
    return E.best_of(per, ["variant_id"], "seed", "ap", "seed")


SEEDS = "ps AS (SELECT variant_id, seed, lower(trim(change_id)) AS change_id, max(score) AS score FROM predictions WHERE " + OK + " GROUP BY 1, 2, 3), y AS (SELECT ps.*, l.label FROM ps JOIN l USING (change_id))"


def bootstrap(spark: SparkSession, d: str) -> DataFrame:
    return E.bootstrap_ap(scored(spark, d), "variant_id", "score", "label", "project", 200, 7)


def paired_bootstrap(spark: SparkSession, d: str) -> DataFrame:
    """Each variant's average precision against that of b0-lr, on the same draws
    of projects and the changes that succeeded in every variant."""
    per = E.bootstrap_values(scored(spark, d).join(success_subset(spark, d), "change_id", "left_semi"), "variant_id", "score", "label", "project", 200, 7)
    per = per.withColumn("ap", F.round("ap", 12))  # sums in another order differ in the last digits
    p = E.paired_difference(per, "b0-lr", "variant_id", "replicate", "ap")
    return p.select("variant_id", *[F.round(c, 10).alias(c) for c in ("mean_difference", "low", "high", "share_not_above")])


def _weeks(spark: SparkSession, d: str) -> DataFrame:
    """The ISO week of each change's prediction, by its first manifest row."""
    return table(spark, d, "internal_manifest").groupBy(id_key(F.col("id")).alias("change_id")).agg(Z.iso_week(F.min("prediction_at")).alias("week"))


def week_bootstrap(spark: SparkSession, d: str) -> DataFrame:
    """As paired_bootstrap, over weeks instead of projects, on all changes and on
    those outside the largest project."""
    rows = scored(spark, d).join(success_subset(spark, d), "change_id", "left_semi").join(_weeks(spark, d), "change_id")
    largest = rows.groupBy("project").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "project").limit(1).select(F.col("project").alias("largest"))
    subsets = F.when(F.col("project") == F.col("largest"), F.array(F.lit("all"))).otherwise(F.array(F.lit("all"), F.lit("without_largest")))
    rows = rows.join(F.broadcast(largest)).withColumn("subset", F.explode(subsets))
    out = None
    for name in ("all", "without_largest"):
        per = E.bootstrap_values(rows.filter(F.col("subset") == name), "variant_id", "score", "label", "week", 200, 7).withColumn("ap", F.round("ap", 12))
        one = E.paired_difference(per, "b0-lr", "variant_id", "replicate", "ap").select(F.lit(name).alias("subset"), "variant_id", *[F.round(c, 10).alias(c) for c in ("mean_difference", "low", "high", "share_not_above")])
        out = one if out is None else out.unionByName(one)
    return out


def row_bootstrap(spark: SparkSession, d: str) -> DataFrame:
    """Intervals of average precision over resampled changes."""
    return E.bootstrap_ap(scored(spark, d), "variant_id", "score", "label", "change_id", 50, 7)


def _seed_scores(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "predictions").filter(_ok()).groupBy("variant_id", "seed", id_key(F.col("change_id")).alias("change_id")).agg(F.max("score").alias("score"))
    return p.join(labels(spark, d), "change_id").withColumn("project", F.split("change_id", ":")[0])


def seed_paired(spark: SparkSession, d: str) -> DataFrame:
    """Average precision of each variant against b0-lr, run by run, with the
    interval of the mean over seeds on resampled projects."""
    rows = _seed_scores(spark, d)
    runs = R.ap_auc(rows, ["variant_id", "seed"], "score", "label", None)
    pairs = E.seed_pairs(runs, "b0-lr", "variant_id", "seed", "ap")
    per = E.bootstrap_values(rows.withColumn("run", F.concat_ws("#", "variant_id", "seed")), "run", "score", "label", "project", 200, 7)
    per = per.groupBy(F.split("run", "#")[0].alias("variant_id"), "replicate").agg(F.round(F.avg("ap"), 12).alias("ap"))
    interval = E.paired_difference(per, "b0-lr", "variant_id", "replicate", "ap").select("variant_id", "low", "high", "share_not_above")
    return pairs.join(interval, "variant_id").select("variant_id", "n_pairs", *[F.round(c, 8).alias(c) for c in ("mean_difference", "sd", "low", "high", "share_not_above")])


def _draws_sql(source: str, cluster: str, n: int, name: str = "") -> str:
    """CTEs d{name}(c, r, times) of n replicates over the clusters of a source."""
    return f"""
k{name} AS (SELECT c, row_number() OVER (ORDER BY sha256(c), c) - 1 AS k, count(*) OVER () AS n FROM (SELECT DISTINCT {cluster} AS c FROM {source})),
u{name} AS (SELECT r, floor(('0x' || substr(sha256('7:' || r || ':' || k), 1, 12))::BIGINT / 281474976710656.0::DOUBLE * n)::BIGINT AS k FROM k{name}, range({n}) AS t(r)),
d{name} AS (SELECT c, r, count(*)::DOUBLE AS times FROM u{name} JOIN k{name} USING (k) GROUP BY 1, 2)"""


def _values_sql(source: str, cluster: str, model: str, name: str = "") -> str:
    """CTE v{name}(model, r, ap) over the draws d{name}."""
    return f"""
g{name} AS (SELECT {model} AS model, r, score, sum(label * times) AS tp, sum(times) AS n FROM {source} s JOIN d{name} ON d{name}.c = s.{cluster} GROUP BY ALL),
c{name} AS (SELECT *, sum(tp) OVER w AS ctp, sum(n) OVER w AS cn, sum(tp) OVER (PARTITION BY model, r) AS p FROM g{name} WINDOW w AS (PARTITION BY model, r ORDER BY score DESC)),
v{name} AS (SELECT model, r, round(sum(tp / nullif(p, 0) * ctp / cn), 12) AS ap FROM c{name} GROUP BY 1, 2)"""


def _paired_sql(v: str, places: int = 10) -> str:
    return f"""SELECT a.model AS variant_id, round(avg(a.ap - b.ap), {places}) AS mean_difference, round(quantile_cont(a.ap - b.ap, 0.025), {places}) AS low, round(quantile_cont(a.ap - b.ap, 0.975), {places}) AS high,
  round(avg((a.ap - b.ap <= 0)::INT::DOUBLE), {places}) AS share_not_above FROM {v} a JOIN {v} b ON a.r = b.r AND b.model = 'b0-lr' WHERE a.model <> 'b0-lr' AND a.ap - b.ap IS NOT NULL GROUP BY 1"""


def _interval_sql(cluster: str, n: int) -> str:
    return f"""WITH {SCORED}, {_draws_sql("x", cluster, n, "b")}, {_values_sql("x", cluster, "variant_id", "b")},
g AS (SELECT variant_id, score, sum(label)::DOUBLE AS tp, count(*)::DOUBLE AS n FROM x GROUP BY ALL),
c AS (SELECT *, sum(tp) OVER w AS ctp, sum(n) OVER w AS cn, sum(tp) OVER (PARTITION BY variant_id) AS p FROM g WINDOW w AS (PARTITION BY variant_id ORDER BY score DESC)),
own AS (SELECT variant_id, sum(tp / nullif(p, 0) * ctp / cn) AS ap FROM c GROUP BY 1),
q AS (SELECT model, quantile_cont(ap, 0.025) AS low, quantile_cont(ap, 0.975) AS high, count(ap) AS n_used FROM vb GROUP BY 1)
SELECT variant_id, round(own.ap, 9) AS ap, round(low, 9) AS low, round(high, 9) AS high, n_used FROM own LEFT JOIN q ON model = variant_id"""


COMMON = f"cok AS (SELECT lower(trim(change_id)) AS change_id FROM predictions WHERE {OK} GROUP BY 1 HAVING count(DISTINCT variant_id) = (SELECT count(DISTINCT variant_id) FROM predictions)), z AS (SELECT x.* FROM x JOIN cok USING (change_id))"
WEEKS = "wk AS (SELECT lower(trim(id)) AS change_id, strftime(min(prediction_at), '%G-W%V') AS week FROM internal_manifest GROUP BY 1), zw AS (SELECT z.*, week FROM z JOIN wk USING (change_id)), big AS (SELECT project FROM zw GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1), zo AS (SELECT * FROM zw WHERE project <> (SELECT project FROM big))"
BOOTSTRAPS = {
    "bootstrap_ap": _interval_sql("project", 200), "bootstrap_rows": _interval_sql("change_id", 50),
    "bootstrap_paired": f"WITH {SCORED}, {COMMON}, {_draws_sql('z', 'project', 200)}, {_values_sql('z', 'project', 'variant_id')} {_paired_sql('v')}",
    "bootstrap_weeks": f"WITH {SCORED}, {COMMON}, {WEEKS}, {_draws_sql('zw', 'week', 200, '1')}, {_values_sql('zw', 'week', 'variant_id', '1')}, {_draws_sql('zo', 'week', 200, '2')}, {_values_sql('zo', 'week', 'variant_id', '2')} SELECT 'all' AS subset, * FROM ({_paired_sql('v1')}) UNION ALL SELECT 'without_largest', * FROM ({_paired_sql('v2')})",
    "bootstrap_seeds": f"""WITH {SCORED}, {SEEDS}, yp AS (SELECT *, variant_id || '#' || seed AS run, split_part(change_id, ':', 1) AS project FROM y), {_draws_sql('yp', 'project', 200)}, {_values_sql('yp', 'project', 'run', 'x').replace('dx', 'd')},
v AS (SELECT split_part(model, '#', 1) AS model, r, round(avg(ap), 12) AS ap FROM vx GROUP BY ALL), iv AS ({_paired_sql('v', 8)}),
g0 AS (SELECT variant_id, seed, score, sum(label)::DOUBLE AS tp, count(*)::DOUBLE AS n FROM yp GROUP BY ALL),
c0 AS (SELECT *, sum(tp) OVER w AS ctp, sum(n) OVER w AS cn, sum(tp) OVER (PARTITION BY variant_id, seed) AS p FROM g0 WINDOW w AS (PARTITION BY variant_id, seed ORDER BY score DESC)),
ra AS (SELECT variant_id, seed, sum(tp / nullif(p, 0) * ctp / cn) AS ap FROM c0 GROUP BY ALL),
sl AS (SELECT variant_id, list_sort(list(DISTINCT seed)) AS seeds FROM ra GROUP BY 1),
pr AS (SELECT a.variant_id, a.ap - b.ap AS d FROM ra a JOIN sl USING (variant_id) JOIN ra b ON b.variant_id = 'b0-lr' AND a.variant_id <> 'b0-lr' AND (a.seed = b.seed OR sl.seeds <> (SELECT seeds FROM sl WHERE variant_id = 'b0-lr')) WHERE a.ap - b.ap IS NOT NULL)
SELECT variant_id, count(*) AS n_pairs, round(avg(d), 8) AS mean_difference, round(stddev_samp(d), 8) AS sd, any_value(low) AS low, any_value(high) AS high, any_value(share_not_above) AS share_not_above FROM pr JOIN iv USING (variant_id) GROUP BY 1""",
}


def iso_weeks(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy(Z.iso_week(F.col("ts")).alias("week"), Z.month(F.col("ts")).alias("month")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("user_id").alias("n_users"))


def scaler(spark: SparkSession, d: str) -> DataFrame:
    return A.fit_scaler(table(spark, d, "features"), SCALED).select("name", *[F.round(c, 6).alias(c) for c in ("median", "mean", "std")])


SCALER = "u AS (" + " UNION ALL ".join(f"SELECT '{c}' AS name, CASE WHEN {c} IS NOT NULL AND NOT isnan({c}) AND NOT isinf({c}) THEN sign({c}) * ln(1 + abs({c})) END AS x FROM features" for c in SCALED) + """),
md AS (SELECT name, coalesce(quantile_cont(x, 0.5), 0) AS m FROM u GROUP BY 1), sc AS (SELECT name, max(m) AS median, avg(coalesce(x, m)) AS mean, CASE WHEN stddev_pop(coalesce(x, m)) < 1e-9 THEN 1 ELSE stddev_pop(coalesce(x, m)) END AS std FROM u JOIN md USING (name) GROUP BY 1)"""


def linear(spark: SparkSession, d: str) -> DataFrame:
    features = table(spark, d, "features")
    fitted = A.collect_scaler(A.fit_scaler(features, SCALED))
    z = A.apply_scaler(features, SCALED, fitted)
    return z.select("change_id", F.round(A.linear_score([c + "_z" for c in SCALED], WEIGHTS, -1.0), 6).alias("score"))


LINEAR = f"WITH {SCALER}, v AS (" + " UNION ALL ".join(f"SELECT change_id, '{c}' AS name, {w} AS w, CASE WHEN {c} IS NOT NULL AND NOT isnan({c}) AND NOT isinf({c}) THEN sign({c}) * ln(1 + abs({c})) END AS x FROM features" for c, w in zip(SCALED, WEIGHTS, strict=True)) + """)
SELECT change_id, round(1 / (1 + exp(-(-1.0::DOUBLE + sum(w::DOUBLE * (coalesce(x, median) - mean) / std)))), 6) AS score FROM v JOIN sc USING (name) GROUP BY 1"""


def logistic(spark: SparkSession, d: str) -> DataFrame:
    """Scores of a logistic regression on the features, its grid judged on valid."""
    s = table(spark, d, "splits").filter(id_key(F.col("split_version")) == "upstream-provided").select(id_key(F.col("change_id")).alias("change_id"), id_key(F.col("split")).alias("split")).distinct()
    rows = table(spark, d, "features").join(s, "change_id").join(labels(spark, d), "change_id")
    train = rows.filter("split = 'train'")
    fitted = A.collect_scaler(A.fit_scaler(train, SCALED))
    names = [c + "_z" for c in SCALED]
    z = lambda part: A.apply_scaler(rows.filter(F.col("split") == part), SCALED, fitted).select("change_id", "label", *names)
    model, pack, _ = A.train_logistic(z("train"), z("valid"), names, "label")
    from pyspark.ml.functions import vector_to_array

    return model.transform(pack.transform(z("test")).withColumnRenamed("__x", "__x")).select("change_id", vector_to_array("probability")[1].alias("score"), "label")


def neighbours(spark: SparkSession, d: str) -> DataFrame:
    """The three nearest vectors of each label for every hundredth vector, against all."""
    e = table(spark, d, "embeddings")
    return Q.class_neighbours(e.filter(F.col("vec_id") % 100 == 0), e, "vec_id", "embedding", "label", 3, "near").select("query", "label", "item", "similarity", F.col("rank").cast("bigint").alias("rank"))


NEIGHBOURS = """
WITH n AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v, sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) AS n FROM embeddings),
s AS (SELECT a.vec_id AS query, b.label, b.vec_id AS item, round(list_dot_product(a.v, b.v) / (a.n * b.n), 6) AS similarity FROM n a JOIN n b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query, label ORDER BY similarity DESC, sha256('near:' || item::VARCHAR)) AS rank FROM s) SELECT * FROM r WHERE rank <= 3
"""


def tokens(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "edits").select("change_id", "line_order", T.tokenize(F.col("text")).alias("tokens"), T.extension(F.col("file_id")).alias("ext")).distinct()


def messages(spark: SparkSession, d: str) -> DataFrame:
    m = T.clean_message(F.coalesce("message", F.lit("")))
    return table(spark, d, "changes").select("change_id", m.alias("message"), T.says_fix(F.col("message")).alias("fix"), T.message_key(F.col("message")).alias("key"))


SPACE = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]+"


def _tokens_sql(column: str) -> str:
    return f"trim(regexp_replace(regexp_replace(replace({column}, '_', ' '), '" + r"([.,;:(){}\[\]+\-*/=<>&|?@%^~\\])', ' \1 ', 'g'), '" + SPACE + "', ' ', 'g'), ' ')"


def evidence(spark: SparkSession, d: str) -> DataFrame:
    """Lines of each change that fit 60 words, and the text they make."""
    e = table(spark, d, "edits").groupBy("change_id").agg(F.array_sort(F.collect_list(F.struct("line_order", "op", "text"))).alias("e"))
    pick = lambda op: F.transform(F.filter("e", lambda x: x["op"] == op), lambda x: x["text"])
    words = lambda a: F.transform(a, lambda x: F.size(F.split(x, " ")).cast("bigint"))
    rows = e.select("change_id", pick("add").alias("a"), pick("delete").alias("d")).withColumn("k", V.allocate(words(F.col("a")), words(F.col("d")), F.lit(60).cast("bigint")))
    return rows.select("change_id", F.size("a").alias("n_add"), F.size("d").alias("n_del"), F.col("k.n_add").alias("kept_add"), F.col("k.n_del").alias("kept_del"), F.sha2(T.render(F.lit(""), F.slice("a", 1, F.col("k.n_add")), F.slice("d", 1, F.col("k.n_del"))), 256).alias("text"))


EVIDENCE = """
WITH e AS (SELECT change_id, op, text, len(string_split(text, ' ')) AS w, row_number() OVER (PARTITION BY change_id, op ORDER BY line_order, text) AS r FROM edits),
c AS (SELECT *, sum(w) OVER (PARTITION BY change_id, op ORDER BY r) AS cw FROM e),
t AS (SELECT change_id, coalesce(sum(w) FILTER (op = 'add'), 0)::BIGINT AS a, coalesce(sum(w) FILTER (op = 'delete'), 0)::BIGINT AS d, count(*) FILTER (op = 'add') AS n_add, count(*) FILTER (op = 'delete') AS n_del FROM e GROUP BY 1),
p1 AS (SELECT t.*, a + d <= 60 AS fits, coalesce(max(cw) FILTER (op = 'add' AND cw <= floor(60 * a / greatest(a + d, 1)::DOUBLE)), 0) AS ua FROM t JOIN c USING (change_id) GROUP BY ALL),
p2 AS (SELECT p1.*, count(*) FILTER (op = 'delete' AND cw <= 60 - ua) AS kd, coalesce(max(cw) FILTER (op = 'delete' AND cw <= 60 - ua), 0) AS ud FROM p1 JOIN c USING (change_id) GROUP BY ALL),
p3 AS (SELECT p2.*, count(*) FILTER (op = 'add' AND cw <= 60 - ud) AS ka FROM p2 JOIN c USING (change_id) GROUP BY ALL),
k AS (SELECT change_id, n_add, n_del, CASE WHEN fits THEN n_add ELSE ka END AS ka, CASE WHEN fits THEN n_del ELSE kd END AS kd FROM p3)
SELECT k.change_id, n_add::INT AS n_add, n_del::INT AS n_del, ka::INT AS kept_add, kd::INT AS kept_del,
       sha256(coalesce(string_agg(CASE WHEN op = 'add' THEN '+ ' ELSE '- ' END || text, chr(10) ORDER BY op, r) FILTER ((op = 'add' AND r <= ka) OR (op = 'delete' AND r <= kd)), '')) AS text FROM k JOIN c USING (change_id) GROUP BY ALL
"""


def document_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """The two documents of each source most like every hundredth document, by
    character n-grams, against all; copies of its text left out."""
    docs = table(spark, d, "documents").select("doc_id", "text", id_key(F.col("source")).alias("source"))
    got = Q.text_neighbours(F.col("doc_id") % 100 == 0, docs, "doc_id", "text", "source", 2, "near")
    return got.select("query", "label", "item", "similarity", F.col("rank").cast("bigint").alias("rank"))


DOCUMENT_NEIGHBOURS = r"""
WITH m AS (SELECT doc_id AS id, text, nullif(lower(trim(source)), '') AS label, regexp_replace(text, '[\s\x0b\x1c-\x1f\x{85}\p{Z}]{2,}', ' ', 'g') AS t FROM documents),
g AS (SELECT id, unnest(flatten([list_transform(range(1, greatest(length(t) - k + 2, 1)), lambda p: substring(t, p, k)) for k in [3, 4, 5]])) AS term FROM m WHERE t IS NOT NULL),
f AS (SELECT id, term, count(*) AS tf FROM g GROUP BY ALL),
v AS (SELECT term, count(*) AS df, sum(tf) AS c FROM f GROUP BY 1 HAVING count(*) >= 2 ORDER BY c DESC, term LIMIT 50000),
w AS (SELECT id, term, tf * (ln((1 + (SELECT count(*) FROM m)) / (1 + df)::DOUBLE) + 1) AS w FROM f JOIN v USING (term)),
n AS (SELECT id, sqrt(sum(w * w)) AS n FROM w GROUP BY 1),
u AS (SELECT id, term, w / n AS w FROM w JOIN n USING (id)),
d AS (SELECT a.id AS query, b.id AS item, sum(a.w * b.w) AS x FROM u a JOIN u b USING (term) WHERE a.id % 100 = 0 GROUP BY 1, 2),
p AS (SELECT a.id AS query, b.label, b.id AS item, round(coalesce(x, 0), 6) AS similarity FROM m a JOIN m b ON a.id % 100 = 0 AND a.id <> b.id AND b.label IS NOT NULL AND (a.text IS NULL OR b.text IS NULL OR a.text <> b.text) LEFT JOIN d ON d.query = a.id AND d.item = b.id),
r AS (SELECT *, row_number() OVER (PARTITION BY query, label ORDER BY similarity DESC, sha256('near:' || item::VARCHAR)) AS rank FROM p) SELECT * FROM r WHERE rank <= 2
"""


def tfidf(spark: SparkSession, d: str) -> DataFrame:
    """Character n-gram weights of the messages; the vocabulary is that of the training changes."""
    s = table(spark, d, "splits").filter((id_key(F.col("split_version")) == "upstream-provided") & (id_key(F.col("split")) == "train")).select(id_key(F.col("change_id")).alias("change_id")).distinct().withColumn("fit", F.lit(True))
    m = table(spark, d, "changes").select("change_id", "message").join(s, "change_id", "left").withColumn("fit", F.coalesce("fit", F.lit(False)))
    w = Q.tfidf(m, "change_id", "message", F.col("fit"))
    return w.groupBy("change_id").agg(F.count(F.lit(1)).alias("n_terms"), F.round(F.max("weight"), 5).alias("top"), F.round(F.sum("weight"), 5).alias("total"))


TFIDF = r"""
WITH s AS (SELECT DISTINCT lower(trim(change_id)) AS change_id FROM splits WHERE lower(trim(split_version)) = 'upstream-provided' AND lower(trim(split)) = 'train'),
m AS (SELECT change_id, regexp_replace(message, '[\s\x0b\x{85}\p{Z}]{2,}', ' ', 'g') AS t, s.change_id IS NOT NULL AS fit FROM changes LEFT JOIN s USING (change_id)),
g AS (SELECT change_id, fit, unnest(flatten([list_transform(range(1, greatest(length(t) - k + 2, 1)), lambda p: substring(t, p, k)) for k in [3, 4, 5]])) AS term FROM m WHERE t IS NOT NULL),
f AS (SELECT change_id, fit, term, count(*) AS tf FROM g GROUP BY ALL),
v AS (SELECT term, count(*) AS df, sum(tf) AS c FROM f WHERE fit GROUP BY 1 HAVING count(*) >= 2 ORDER BY c DESC, term LIMIT 50000),
w AS (SELECT change_id, tf * (ln((1 + (SELECT count(*) FROM m WHERE fit)) / (1 + df)::DOUBLE) + 1) AS w FROM f JOIN v USING (term)),
n AS (SELECT change_id, sqrt(sum(w * w)) AS n FROM w GROUP BY 1)
SELECT change_id, count(*) AS n_terms, round(max(w / n), 5) AS top, round(sum(w / n), 5) AS total FROM w JOIN n USING (change_id) GROUP BY 1
"""

QUERIES = {
    "history_features": history, "eligibility_waterfall": waterfall, "deployment_scores": deployment_scores, "deployment_metrics": deployment_metrics, "deployment_months": deployment_months, "size_bias": size_bias,
    "deployment_scores_all": deployment_scores_all, "deployment_metrics_all": deployment_metrics_all, "size_bias_all": size_bias_all,
    "success_subset": success_subset, "coverage_table": coverage_table, "common_metrics": common_metrics, "replicate_mean_sd": replicates, "best_seed": best_seed, "bootstrap_ap": bootstrap, "bootstrap_paired": paired_bootstrap, "bootstrap_weeks": week_bootstrap, "bootstrap_rows": row_bootstrap, "bootstrap_seeds": seed_paired, "iso_week_clusters": iso_weeks,
    "scaler_params": scaler, "linear_score": linear, "logistic_score": logistic, "class_neighbours": neighbours, "tokenize_text": tokens, "clean_message": messages, "evidence_allocation": evidence, "char_tfidf": tfidf, "document_neighbours": document_neighbours,
}
_AP = "round(sum(tp / nullif(p, 0) * ctp / cn), 6) AS ap, round(sum(tp * ((t - p) - (cn - ctp) + (n - tp) / 2) / nullif(p * (t - p), 0)), 6) AS auc"


def _sums(by: str, source: str) -> str:
    from millrace.plans.metrics import cumulated

    return cumulated(by, source)


ORACLES = {
    "history_features": HISTORY,
    "eligibility_waterfall": f"WITH {ELIGIBLE} SELECT count(*) AS n, count(*) FILTER (NOT a) AS outside_period, count(*) FILTER (a AND NOT b) AS window_incomplete, count(*) FILTER (a AND b AND NOT c) AS label_unknown, count(*) FILTER (a AND b AND c AND NOT e) AS linkage_low, count(*) FILTER (a AND b AND c AND e) AS eligible FROM w",
    "deployment_scores": f"WITH {SCORED}, {UNITS} SELECT deployment_id, n_items, n_scored, round(max_score, 10) AS max_score, round(mean_score, 10) AS mean_score, round(noisy_or, 10) AS noisy_or FROM us",
    "deployment_metrics": f"WITH {SCORED}, {UNITS}, {ELIGIBLE}, z AS (SELECT service, label::INT AS label, max_score AS score FROM w JOIN us ON us.deployment_id = lower(trim(w.deployment_id)) WHERE a AND b AND c AND e AND service IS NOT NULL AND max_score IS NOT NULL), {_sums('service', 'z')} SELECT service, max(t)::BIGINT AS n, max(p)::BIGINT AS positives, {_AP} FROM c GROUP BY 1".replace("w AS (SELECT *,", "w AS (SELECT *,").replace(" AND c AND e AND service", " AND w.c AND e AND service"),
    "deployment_months": "SELECT strftime(deployed_at, '%Y-%m') AS month, count(*) AS n, count(*) FILTER (label = 1) AS positives FROM (SELECT DISTINCT * FROM deployments) GROUP BY 1",
    "size_bias": f"WITH {SCORED}, {UNITS}, {ELIGIBLE}, z AS (SELECT max_score AS s, n_items AS k FROM w JOIN us ON us.deployment_id = lower(trim(w.deployment_id)) WHERE a AND b AND c AND e AND max_score IS NOT NULL), q AS (SELECT rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2.0::DOUBLE AS a, rank() OVER (ORDER BY k) + (count(*) OVER (PARTITION BY k) - 1) / 2.0::DOUBLE AS b FROM z) SELECT 'eligible' AS \"all\", count(*) AS n, round(corr(a, b), 6) AS rho FROM q",
    "deployment_scores_all": f"WITH {SCORED}, {VARIANT_UNITS} SELECT variant_id, deployment_id, n_items, n_scored, round(max_score, 10) AS max_score, round(mean_score, 10) AS mean_score, round(noisy_or, 10) AS noisy_or FROM us",
    "deployment_metrics_all": f"WITH {SCORED}, {VARIANT_UNITS}, {ELIGIBLE}, z AS (SELECT variant_id, service, label::INT AS label, max_score AS score FROM w JOIN us ON us.deployment_id = lower(trim(w.deployment_id)) WHERE a AND b AND w.c AND e AND service IS NOT NULL AND max_score IS NOT NULL), {_sums('variant_id, service', 'z')} SELECT variant_id, service, max(t)::BIGINT AS n, max(p)::BIGINT AS positives, {_AP} FROM c GROUP BY 1, 2",
    "size_bias_all": f"WITH {SCORED}, {VARIANT_UNITS}, {ELIGIBLE}, z AS (SELECT variant_id, max_score AS s, n_items AS k FROM w JOIN us ON us.deployment_id = lower(trim(w.deployment_id)) WHERE a AND b AND c AND e AND max_score IS NOT NULL), q AS (SELECT variant_id, rank() OVER (PARTITION BY variant_id ORDER BY s) + (count(*) OVER (PARTITION BY variant_id, s) - 1) / 2.0::DOUBLE AS a, rank() OVER (PARTITION BY variant_id ORDER BY k) + (count(*) OVER (PARTITION BY variant_id, k) - 1) / 2.0::DOUBLE AS b FROM z) SELECT variant_id, count(*) AS n, CASE WHEN min(a) < max(a) AND min(b) < max(b) THEN round(corr(a, b), 6) END AS rho FROM q GROUP BY 1",
    "success_subset": f"WITH p AS (SELECT lower(trim(change_id)) AS change_id, variant_id, {OK} AS ok FROM predictions) SELECT change_id FROM p WHERE ok GROUP BY 1 HAVING count(DISTINCT variant_id) = (SELECT count(DISTINCT variant_id) FROM p)",
    "coverage_table": f"WITH {SCORED}, q AS (SELECT variant_id, lower(trim(p.change_id)) AS change_id, bool_or(coalesce({OK}, false)) AS ok FROM predictions p GROUP BY 1, 2), j AS (SELECT q.*, label FROM q JOIN l USING (change_id)) SELECT variant_id, count(*) FILTER (ok) AS n_ok, count(*) FILTER (NOT ok) AS n_failed, (SELECT count(*) FROM l) - count(*) AS n_missing, ((SELECT sum(label) FROM l) - coalesce(sum(label) FILTER (ok), 0))::BIGINT AS positives_lost FROM j GROUP BY 1",
    "common_metrics": f"WITH {SCORED}, ok AS (SELECT change_id FROM s GROUP BY 1 HAVING count(*) = (SELECT count(DISTINCT variant_id) FROM predictions)), z AS (SELECT x.* FROM x JOIN ok USING (change_id)), {_sums('variant_id', 'z')} SELECT variant_id, max(t)::BIGINT AS n, max(p)::BIGINT AS positives, {_AP} FROM c GROUP BY 1",
    "replicate_mean_sd": f"WITH {SCORED}, {SEEDS}, {_sums('variant_id, seed', 'y')}, a AS (SELECT variant_id, seed, sum(tp / nullif(p, 0) * ctp / cn) AS ap FROM c GROUP BY 1, 2) SELECT variant_id, count(ap) AS n_seeds, round(avg(ap), 6) AS mean_ap, round(stddev_samp(ap), 6) AS sd_ap FROM a GROUP BY 1",
    "best_seed": f"WITH {SCORED}, {SEEDS}, {_sums('variant_id, seed', 'y')}, a AS (SELECT variant_id, seed, round(sum(tp / nullif(p, 0) * ctp / cn), 3) AS ap FROM c GROUP BY 1, 2) SELECT variant_id, seed, ap FROM a WHERE ap IS NOT NULL QUALIFY row_number() OVER (PARTITION BY variant_id ORDER BY ap DESC, seed) = 1",
    "iso_week_clusters": "SELECT strftime(ts, '%G-W%V') AS week, strftime(ts, '%Y-%m') AS month, count(*) AS n, count(DISTINCT user_id) AS n_users FROM events GROUP BY 1, 2",
    "scaler_params": f"WITH {SCALER} SELECT name, round(median, 6) AS median, round(mean, 6) AS mean, round(std, 6) AS std FROM sc",
    "linear_score": LINEAR, "class_neighbours": NEIGHBOURS,
    "tokenize_text": "SELECT DISTINCT change_id, line_order, " + _tokens_sql("text") + r" AS tokens, CASE WHEN file_id IS NOT NULL THEN lower(regexp_extract(regexp_extract(file_id, '[^/]*$'), '^.+(\.[^.]+)$', 1)) END AS ext FROM edits",
    "clean_message": r"WITH m AS (SELECT change_id, message, array_to_string(list_filter(string_split(coalesce(message, ''), chr(10)), lambda x: NOT starts_with(x, 'git-svn-id:')), chr(10)) AS t FROM changes), k AS (SELECT *, trim(regexp_replace(lower(message), '" + SPACE + r"', ' ', 'g'), ' ') AS q FROM m) SELECT change_id, " + _tokens_sql("t") + " AS message, coalesce(regexp_matches(message, '(?i)fix|bug'), false) AS fix, CASE WHEN length(q) >= 20 THEN sha256(q) END AS key FROM k",
    "evidence_allocation": EVIDENCE, "char_tfidf": TFIDF, "document_neighbours": DOCUMENT_NEIGHBOURS, **BOOTSTRAPS,
}
