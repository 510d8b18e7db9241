"""Choices and completeness checks over projects, runs and sheets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.functions.keys import id_key, salted_digest
from millrace.functions.numbers import is_finite
from millrace.functions.text import binary_label
from millrace.operators.splitting import first_per
from millrace.plans.metrics import labels
from millrace.plans.tables import table

CHARS = "SELECT {by}, count(*) AS n, round(avg(n_chars), 4) AS mean, round(quantile_cont(n_chars::DOUBLE, 0.99), 4) AS p99, max(n_chars) AS longest FROM documents WHERE {by} IS NOT NULL GROUP BY 1"


def primary_language(spark: SparkSession, d: str) -> DataFrame:
    """The most frequent language of each project; of equal ones that seen first."""
    c = table(spark, d, "changes").select("project_id", id_key(F.col("language")).alias("language"), "authored_at_unix").filter("language is not null")
    n = c.groupBy("project_id", "language").agg(F.count(F.lit(1)).alias("n"), F.min("authored_at_unix").alias("first"))
    return n.groupBy("project_id").agg(F.max_by(F.struct("language", "n"), F.struct(F.col("n"), -F.col("first"), F.col("language"))).alias("b")).select("project_id", "b.language", "b.n")


def balanced_demos(spark: SparkSession, d: str) -> DataFrame:
    """Five training changes of each label, by salted hash."""
    s = table(spark, d, "splits").filter((id_key(F.col("split_version")) == "upstream-provided") & (id_key(F.col("split")) == "train")).select(id_key(F.col("change_id")).alias("change_id")).distinct()
    rows = labels(spark, d).join(s, "change_id").withColumn("h", salted_digest("demo", F.col("change_id")))
    rank = F.row_number().over(Window.partitionBy("label").orderBy("h"))
    return rows.withColumn("rank", rank).filter("rank <= 5").select("label", "change_id", F.col("rank").cast("bigint").alias("rank"))


def reproduction(spark: SparkSession, d: str) -> DataFrame:
    """Largest difference between the scores of two seeds, over the changes both have."""
    fine = (F.col("status") == "ok") & is_finite(F.col("score"))
    p = table(spark, d, "predictions").filter(fine).groupBy("variant_id", "seed", id_key(F.col("change_id")).alias("change_id")).agg(F.max("score").alias("score"))
    other = p.select("variant_id", "change_id", F.col("seed").alias("other"), F.col("score").alias("again"))
    both = p.join(other, ["variant_id", "change_id"]).filter("seed < other")
    return both.groupBy("variant_id", "seed", "other").agg(F.count(F.lit(1)).alias("n"), F.round(F.max(F.abs(F.col("score") - F.col("again"))), 6).alias("largest"))


def completeness(spark: SparkSession, d: str) -> DataFrame:
    """State of every pair of a variant and a seed that occur: complete if all rows
    succeeded, partial, failed, or missing."""
    p = table(spark, d, "predictions").select("variant_id", "seed", "status")
    seeds = p.agg(F.collect_set("seed").alias("seeds"))  # the seeds of a study are few
    wanted = p.select("variant_id").distinct().join(F.broadcast(seeds)).select("variant_id", F.explode("seeds").alias("seed"))
    runs = p.groupBy("variant_id", "seed").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("status") == "ok").alias("ok"))
    state = F.when(F.col("n").isNull(), "missing").when(F.col("ok") == F.col("n"), "complete").when(F.col("ok") > 0, "partial").otherwise("failed")
    return wanted.join(runs, ["variant_id", "seed"], "left").select("variant_id", "seed", state.alias("state"))


def text_lengths(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").filter("source is not null")
    return docs.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("n_chars"), 4).alias("mean"), F.round(F.percentile("n_chars", F.lit(0.99)), 4).alias("p99"), F.max("n_chars").alias("longest"))


def first_sheet(spark: SparkSession, d: str) -> DataFrame:
    """The first sheet on which each change stands."""
    s = table(spark, d, "label_sheet").select(id_key(F.col("change_id")).alias("change_id"), "sheet_no").filter("change_id is not null")
    return first_per(s, ["change_id"], ["sheet_no"])


def label_states(spark: SparkSession, d: str) -> DataFrame:
    """Labels of the sheets as they count: 1, 0, unlabelled or undecided."""
    x = F.lower(F.btrim(F.coalesce("label", F.lit(""))))
    state = F.when(x == "", "unlabelled").otherwise(F.coalesce(binary_label(F.col("label")).cast("string"), F.lit("undecided")))
    return table(spark, d, "label_sheet").groupBy("sheet_no", state.alias("state")).agg(F.count(F.lit(1)).alias("n"))


def exclude_project(spark: SparkSession, d: str) -> DataFrame:
    """Predictions kept and left out, where the largest project is held out."""
    largest = table(spark, d, "changes").groupBy("project_id").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "project_id").limit(1).select(F.col("project_id").alias("out"))
    p = table(spark, d, "predictions").select("variant_id", F.split("change_id", ":")[0].alias("project")).join(F.broadcast(largest))
    return p.groupBy("variant_id").agg(F.count_if(F.col("project") != F.col("out")).alias("n_kept"), F.count_if(F.col("project") == F.col("out")).alias("n_left_out"))


QUERIES = {
    "primary_language": primary_language, "balanced_demos": balanced_demos, "reproduction_check": reproduction, "run_completeness": completeness, "text_lengths": text_lengths,
    "first_sheet": first_sheet, "label_states": label_states, "holdout_counts": exclude_project,
}
_OK = "status = 'ok' AND score IS NOT NULL AND NOT isnan(score) AND NOT isinf(score)"
ORACLES = {
    "primary_language": "WITH n AS (SELECT project_id, nullif(lower(trim(language)), '') AS language, count(*) AS n, min(authored_at_unix) AS f FROM changes GROUP BY 1, 2) SELECT project_id, language, n FROM n WHERE language IS NOT NULL QUALIFY row_number() OVER (PARTITION BY project_id ORDER BY n DESC, f, language DESC) = 1",
    "balanced_demos": "WITH s AS (SELECT DISTINCT lower(trim(change_id)) AS change_id FROM splits WHERE lower(trim(split_version)) = 'upstream-provided' AND lower(trim(split)) = 'train'), l AS (SELECT lower(trim(id)) AS change_id, max(label) AS label FROM internal_manifest GROUP BY 1), r AS (SELECT label, change_id, row_number() OVER (PARTITION BY label ORDER BY sha256('demo:' || change_id)) AS rank FROM l JOIN s USING (change_id)) SELECT * FROM r WHERE rank <= 5",
    "reproduction_check": f"WITH p AS (SELECT variant_id, seed, lower(trim(change_id)) AS change_id, max(score) AS score FROM predictions WHERE {_OK} GROUP BY 1, 2, 3) SELECT a.variant_id, a.seed, b.seed AS other, count(*) AS n, round(max(abs(a.score - b.score)), 6) AS largest FROM p a JOIN p b ON a.variant_id = b.variant_id AND a.change_id = b.change_id AND a.seed < b.seed GROUP BY 1, 2, 3",
    "run_completeness": "WITH w AS (SELECT * FROM (SELECT DISTINCT variant_id FROM predictions) CROSS JOIN (SELECT DISTINCT seed FROM predictions)), r AS (SELECT variant_id, seed, count(*) AS n, count(*) FILTER (status = 'ok') AS ok FROM predictions GROUP BY 1, 2) SELECT variant_id, seed, CASE WHEN n IS NULL THEN 'missing' WHEN ok = n THEN 'complete' WHEN ok > 0 THEN 'partial' ELSE 'failed' END AS state FROM w LEFT JOIN r USING (variant_id, seed)",
    "text_lengths": CHARS.format(by="source"),
    "first_sheet": "SELECT lower(regexp_replace(change_id, '^\\s+|\\s+$', '', 'g')) AS change_id, min(sheet_no) AS sheet_no FROM label_sheet GROUP BY 1",
    "label_states": "WITH x AS (SELECT sheet_no, lower(regexp_replace(coalesce(label, ''), '^\\s+|\\s+$', '', 'g')) AS x FROM label_sheet) SELECT sheet_no, CASE WHEN x = '' THEN 'unlabelled' WHEN x IN ('1', 'true', '1.0') THEN '1' WHEN x IN ('0', 'false', '0.0') THEN '0' ELSE 'undecided' END AS state, count(*) AS n FROM x GROUP BY 1, 2",
    "holdout_counts": "WITH o AS (SELECT project_id FROM changes GROUP BY 1 ORDER BY count(*) DESC, project_id LIMIT 1) SELECT variant_id, count(*) FILTER (split_part(change_id, ':', 1) <> (SELECT project_id FROM o)) AS n_kept, count(*) FILTER (split_part(change_id, ':', 1) = (SELECT project_id FROM o)) AS n_left_out FROM predictions GROUP BY 1",
}
