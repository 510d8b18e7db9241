"""Ranking metrics of the predictions against the manifest's labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.keys import id_key
from millrace.operators import ranking as R
from millrace.plans.tables import table

SALT = "rank-v1"


def labels(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "internal_manifest").groupBy(id_key(F.col("id")).alias("change_id")).agg(F.max("label").alias("label"))


def scores(spark: SparkSession, d: str) -> DataFrame:
    """One finite score per variant and change, of the rows that succeeded."""
    p = table(spark, d, "predictions").filter((F.col("status") == "ok") & F.col("score").isNotNull() & ~F.isnan("score") & (F.abs("score") < F.lit(float("inf"))))
    return p.groupBy("variant_id", id_key(F.col("change_id")).alias("change_id")).agg(F.max("score").alias("score"))


def scored(spark: SparkSession, d: str) -> DataFrame:
    return scores(spark, d).join(labels(spark, d), "change_id").withColumn("project", F.split("change_id", ":")[0])


SCORED = """
l AS (SELECT lower(trim(id)) AS change_id, max(label)::BIGINT AS label FROM internal_manifest GROUP BY 1),
s AS (SELECT variant_id, lower(trim(change_id)) AS change_id, max(score) AS score FROM predictions
      WHERE status = 'ok' AND score IS NOT NULL AND NOT isnan(score) AND NOT isinf(score) GROUP BY 1, 2),
x AS (SELECT s.*, l.label, split_part(s.change_id, ':', 1) AS project FROM s JOIN l USING (change_id))
"""


def cumulated(by: str, source: str = "x") -> str:
    return f"""
g AS (SELECT {by}, score, sum(label)::DOUBLE AS tp, count(*)::DOUBLE AS n FROM {source} GROUP BY ALL),
c AS (SELECT *, sum(tp) OVER w AS ctp, sum(n) OVER w AS cn, sum(tp) OVER (PARTITION BY {by}) AS p, sum(n) OVER (PARTITION BY {by}) AS t
      FROM g WINDOW w AS (PARTITION BY {by} ORDER BY score DESC))
"""


AP_AUC = "round(sum(tp / nullif(p, 0) * ctp / cn), 6) AS ap, round(sum(tp * ((t - p) - (cn - ctp) + (n - tp) / 2) / nullif(p * (t - p), 0)), 6) AS auc"
BORDER = "b AS (SELECT * FROM (SELECT *, greatest(1, ceil(t * 0.1::DOUBLE)) AS k FROM c) WHERE cn >= k AND cn - n < k)"


def by_variant(spark: SparkSession, d: str) -> DataFrame:
    return R.ap_auc(scored(spark, d), ["variant_id"], "score", "label")


def by_project(spark: SparkSession, d: str) -> DataFrame:
    return R.ap_auc(scored(spark, d), ["variant_id", "project"], "score", "label")


def expected_ties(spark: SparkSession, d: str) -> DataFrame:
    return R.recall_expected(scored(spark, d), ["variant_id"], "score", "label", 0.1)


def hash_ties(spark: SparkSession, d: str) -> DataFrame:
    return R.recall_hashed(scored(spark, d), ["variant_id"], "change_id", "score", "label", 0.1, SALT)


HASH_TIES = """
h AS (SELECT x.*, row_number() OVER (PARTITION BY variant_id{more} ORDER BY score DESC, sha256('rank-v1:' || change_id)) AS r FROM x),
k AS (SELECT variant_id{more}, greatest(1, ceil(count(*) * 0.1::DOUBLE))::BIGINT AS k, sum(label)::DOUBLE AS p FROM x GROUP BY ALL),
z AS (SELECT h.*, k.k, k.p FROM h JOIN k USING (variant_id{more})),
cut AS (SELECT variant_id{more}, score AS cut FROM z WHERE r = k),
tie AS (SELECT variant_id{more}, count(*)::BIGINT AS tied FROM x JOIN cut USING (variant_id{more}) WHERE x.score = cut GROUP BY ALL)
"""


def f1_threshold(spark: SparkSession, d: str) -> DataFrame:
    return R.best_threshold(scored(spark, d), ["variant_id"], "score", "label")


def confusion(spark: SparkSession, d: str) -> DataFrame:
    return R.at_threshold(scored(spark, d), ["variant_id"], "score", "label", F.lit(0.5))


def bundle(spark: SparkSession, d: str) -> DataFrame:
    return R.metric_bundle(scored(spark, d), ["variant_id", "project"], "change_id", "score", "label", SALT, 0.1, 30)


def rank_correlation(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "features").select(id_key(F.col("change_id")).alias("change_id"), "la")
    return R.spearman(scored(spark, d).join(f, "change_id"), ["variant_id"], "score", "la")


def coverage_check(spark: SparkSession, d: str) -> DataFrame:
    """How well the share of delivered lines alone ranks the labels, per split."""
    lines = table(spark, d, "edits").groupBy(id_key(F.col("change_id")).alias("change_id")).agg(F.count(F.lit(1)).alias("lines"))
    f = table(spark, d, "features").select(id_key(F.col("change_id")).alias("change_id"), "la", "ld")
    s = table(spark, d, "splits").filter(id_key(F.col("split_version")) == "upstream-provided").select(id_key(F.col("change_id")).alias("change_id"), id_key(F.col("split")).alias("split")).distinct()
    rows = f.join(labels(spark, d), "change_id").join(s, "change_id").join(lines, "change_id", "left").withColumn("coverage", (F.coalesce("lines", F.lit(0)) + 1) / (F.col("la") + F.col("ld") + 1))
    metrics = R.ap_auc(rows.withColumn("low", -F.col("coverage")), ["split"], "low", "label", 3)
    half = lambda y: F.round(F.percentile(F.when(F.col("label") == y, F.col("coverage")), F.lit(0.5)), 3)
    return metrics.join(rows.groupBy("split").agg(half(1).alias("median_positive"), half(0).alias("median_negative")), "split")


def project_prior(spark: SparkSession, d: str) -> DataFrame:
    """Positive share of each project's training changes as a score of the test changes."""
    s = table(spark, d, "splits").filter(id_key(F.col("split_version")) == "upstream-provided").select(id_key(F.col("change_id")).alias("change_id"), id_key(F.col("split")).alias("split")).distinct()
    rows = labels(spark, d).join(s, "change_id").withColumn("project", F.split("change_id", ":")[0])
    prior = rows.filter("split = 'train'").groupBy("project").agg(F.avg("label").alias("prior"))
    return R.ap_auc(rows.filter("split = 'test'").join(prior, "project"), [], "prior", "label").withColumn("split", F.lit("test"))


SPLIT = "sp AS (SELECT DISTINCT lower(trim(change_id)) AS change_id, lower(trim(split)) AS split FROM splits WHERE lower(trim(split_version)) = 'upstream-provided')"

QUERIES = {
    "ranking_by_variant": by_variant, "ranking_by_project": by_project, "recall_expected_ties": expected_ties, "recall_hash_ties": hash_ties, "best_f1_threshold": f1_threshold,
    "at_threshold": confusion, "metric_bundle": bundle, "rank_correlation": rank_correlation, "coverage_check": coverage_check, "project_prior": project_prior,
}
ORACLES = {
    "ranking_by_variant": f"WITH {SCORED}, {cumulated('variant_id')} SELECT variant_id, max(t)::BIGINT AS n, max(p)::BIGINT AS positives, {AP_AUC} FROM c GROUP BY 1",
    "ranking_by_project": f"WITH {SCORED}, {cumulated('variant_id, project')} SELECT variant_id, project, max(t)::BIGINT AS n, max(p)::BIGINT AS positives, {AP_AUC} FROM c GROUP BY 1, 2",
    "recall_expected_ties": f"""WITH {SCORED}, {cumulated('variant_id')}, {BORDER} SELECT variant_id, k::BIGINT AS k,
        round((ctp - tp + tp * (k - (cn - n)) / n) / nullif(p, 0), 6) AS recall, round((ctp - tp + tp * (k - (cn - n)) / n) / k, 6) AS precision FROM b""",
    "recall_hash_ties": f"""WITH {SCORED}, {HASH_TIES.format(more='')} SELECT variant_id, max(k) AS k, round(sum(label) FILTER (r <= k) / nullif(max(p), 0), 6) AS recall,
        round(sum(label) FILTER (r <= k) / max(k)::DOUBLE, 6) AS precision, max(tied) AS tied FROM z JOIN tie USING (variant_id) GROUP BY 1""",
    "best_f1_threshold": f"""WITH {SCORED}, {cumulated('variant_id')} SELECT variant_id, score AS threshold, round(2 * ctp / (cn + p), 6) AS f1 FROM c WHERE p > 0
        QUALIFY row_number() OVER (PARTITION BY variant_id ORDER BY 2 * ctp / (cn + p) DESC, score DESC) = 1""",
    "at_threshold": f"""WITH {SCORED}, q AS (SELECT variant_id, count(*) FILTER (score >= 0.5 AND label = 1) AS tp, count(*) FILTER (score >= 0.5 AND label <> 1) AS fp,
        count(*) FILTER (score < 0.5 AND label = 1) AS fn, count(*) FILTER (score < 0.5 AND label <> 1) AS tn FROM x GROUP BY 1)
        SELECT *, round(coalesce(tp / nullif(tp + fp, 0)::DOUBLE, 0), 6) AS precision, round(coalesce(tp / nullif(tp + fn, 0)::DOUBLE, 0), 6) AS recall, round(coalesce(2.0::DOUBLE * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1 FROM q""",
    "metric_bundle": f"""WITH {SCORED}, {cumulated('variant_id, project')}, {HASH_TIES.format(more=', project')},
        m AS (SELECT variant_id, project, max(t)::BIGINT AS n, max(p)::BIGINT AS positives, sum(tp / nullif(p, 0) * ctp / cn) AS ap, sum(tp * ((t - p) - (cn - ctp) + (n - tp) / 2) / nullif(p * (t - p), 0)) AS auc FROM c GROUP BY 1, 2),
        r AS (SELECT variant_id, project, sum(label) FILTER (r <= k) / nullif(max(p), 0) AS recall, sum(label) FILTER (r <= k) / max(k)::DOUBLE AS precision, max(tied) AS tied FROM z JOIN tie USING (variant_id, project) GROUP BY 1, 2)
        SELECT variant_id, project, n, positives, round(positives / n::DOUBLE, 6) AS prevalence, round(CASE WHEN n >= 30 THEN ap END, 6) AS ap, round(CASE WHEN n >= 30 THEN auc END, 6) AS auc,
        round(CASE WHEN n >= 30 THEN recall END, 6) AS recall, round(CASE WHEN n >= 30 THEN precision END, 6) AS precision, CASE WHEN n >= 30 THEN tied END AS tied,
        round(CASE WHEN n >= 30 THEN ap / nullif(positives / n::DOUBLE, 0) END, 6) AS lift,
        CASE WHEN n < 30 THEN 'group too small' WHEN positives = 0 THEN 'nothing to rank' WHEN positives = n THEN 'only positives' END AS note
        FROM m LEFT JOIN r USING (variant_id, project)""",
    "rank_correlation": f"""WITH {SCORED}, y AS (SELECT x.*, la FROM x JOIN features f ON lower(trim(f.change_id)) = x.change_id WHERE la IS NOT NULL AND NOT isnan(la)),
        k AS (SELECT variant_id, rank() OVER (PARTITION BY variant_id ORDER BY score) + (count(*) OVER (PARTITION BY variant_id, score) - 1) / 2.0::DOUBLE AS a,
        rank() OVER (PARTITION BY variant_id ORDER BY la) + (count(*) OVER (PARTITION BY variant_id, la) - 1) / 2.0::DOUBLE AS b FROM y)
        SELECT variant_id, count(*) AS n, CASE WHEN min(a) < max(a) AND min(b) < max(b) THEN round(corr(a, b), 6) END AS rho FROM k GROUP BY 1""",
    "coverage_check": f"""WITH {SCORED}, {SPLIT}, e AS (SELECT lower(trim(change_id)) AS change_id, count(*) AS lines FROM edits GROUP BY 1),
        y AS (SELECT sp.split, label, (coalesce(lines, 0) + 1) / (la + ld + 1) AS coverage, -((coalesce(lines, 0) + 1) / (la + ld + 1)) AS score FROM features f JOIN l ON l.change_id = lower(trim(f.change_id)) JOIN sp ON sp.change_id = l.change_id LEFT JOIN e ON e.change_id = l.change_id),
        {cumulated('split', 'y')}, m AS (SELECT split, max(t)::BIGINT AS n, max(p)::BIGINT AS positives, {AP_AUC.replace('6)', '3)')} FROM c GROUP BY 1)
        SELECT m.*, round(quantile_cont(coverage, 0.5) FILTER (label = 1), 3) AS median_positive, round(quantile_cont(coverage, 0.5) FILTER (label = 0), 3) AS median_negative FROM m JOIN y USING (split) GROUP BY ALL""",
    "project_prior": f"""WITH {SCORED}, {SPLIT}, r AS (SELECT *, split_part(change_id, ':', 1) AS project FROM l JOIN sp USING (change_id)), q AS (SELECT project, avg(label) AS score FROM r WHERE split = 'train' GROUP BY 1),
        y AS (SELECT r.split, label, score FROM r JOIN q USING (project) WHERE r.split = 'test'), {cumulated('split', 'y')} SELECT split, max(t)::BIGINT AS n, max(p)::BIGINT AS positives, {AP_AUC} FROM c GROUP BY 1""",
}
