"""Records, roles, coverage and plans of batches over the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.functions.keys import id_key
from millrace.functions.numbers import is_finite
from millrace.operators import batches as B
from millrace.operators import evidence as V
from millrace.operators import ranking as R
from millrace.operators import records as C
from millrace.plans.evaluation import EVIDENCE
from millrace.plans.metrics import SCORED, labels, scored
from millrace.plans.tables import table

INPUTS = ("id", "repository", "commit_sha", "group_id", "prediction_at", "input_available_at", "message", "synthetic")
LABELS = ("id", "label", "label_type", "label_status", "label_available_at")


def _rules():
    blank = lambda c: F.coalesce(F.trim(F.col(c)), F.lit("")) == ""
    return [
        ("no_id", F.col("id").isNull()), ("no_group", F.col("group_id").isNull()), ("no_message", blank("message")), ("bad_commit", ~T.is_commit_hash(F.col("commit_sha"))), ("bad_repository", ~T.is_repository(F.col("repository"))),
        ("bad_label", F.col("label").isNull()), ("status_mismatch", (F.col("label") == 1) != (F.col("label_status") == "confirmed_positive")),
        ("late_input", F.col("input_available_at") > F.col("prediction_at")), ("early_label", F.col("label_available_at") < F.col("prediction_at")),
    ]


def canonical(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Manifest rows in canonical form, and those refused."""
    m = table(spark, d, "internal_manifest")
    forms = {"id": id_key(F.col("id")), "group_id": id_key(F.col("group_id")), "commit_sha": F.lower("commit_sha"), "label": T.binary_label(F.col("label")), "message": T.squeeze(F.col("message"))}
    return C.canonicalise(m, forms, _rules())


def record_rejects(spark: SparkSession, d: str) -> DataFrame:
    return canonical(spark, d)[1].groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def record_inputs(spark: SparkSession, d: str) -> DataFrame:
    """Inputs of the accepted records, without what only labels may hold."""
    return C.project(canonical(spark, d)[0], INPUTS, [c for c in LABELS if c != "id"]).distinct().select("id", "repository", "group_id", F.sha2("message", 256).alias("message"))


def record_labels(spark: SparkSession, d: str) -> DataFrame:
    return C.project(canonical(spark, d)[0], LABELS).distinct().groupBy("label_type", "label").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("id").alias("n_ids"))


def role_counts(spark: SparkSession, d: str) -> DataFrame:
    """Changes a role may read: training on public ones of the provided training
    split, evaluation on internal ones of the others."""
    changes = table(spark, d, "changes").select(id_key(F.col("change_id")).alias("change_id"), id_key(F.col("visibility")).alias("visibility"))
    s = table(spark, d, "splits").filter(id_key(F.col("split_version")) == "upstream-provided").select(id_key(F.col("change_id")).alias("change_id"), id_key(F.col("split")).alias("split")).distinct()
    rows = changes.join(s, "change_id")
    parts = {"train": {"visibility": ["public"], "split": ["train"]}, "evaluate": {"visibility": ["internal"], "split": ["valid", "test"]}}
    out = None
    for role, allowed in parts.items():
        one = C.role_view(rows, allowed).groupBy("visibility", "split").agg(F.count(F.lit(1)).alias("n")).withColumn("role", F.lit(role))
        out = one if out is None else out.unionByName(one)
    return out


def _sides(spark: SparkSession, d: str) -> DataFrame:
    """(change_id, a, d): the added and deleted lines of each change in order."""
    e = table(spark, d, "edits").groupBy("change_id").agg(F.array_sort(F.collect_list(F.struct("line_order", "op", "text"))).alias("e"))
    pick = lambda op: F.transform(F.filter("e", lambda x: x["op"] == op), lambda x: x["text"])
    return e.select("change_id", pick("add").alias("a"), pick("delete").alias("d"))


def pool_eligibility(spark: SparkSession, d: str) -> DataFrame:
    """Why changes can't take part in matching messages to code."""
    rows = table(spark, d, "changes").select(id_key(F.col("change_id")).alias("change_id"), "message").join(table(spark, d, "edits").select(id_key(F.col("change_id")).alias("change_id")).distinct().withColumn("code", F.lit(True)), "change_id", "left")
    got = C.eligibility(rows, [("empty_message", F.coalesce(T.squeeze(F.col("message")), F.lit("")) == ""), ("no_code", F.col("code").isNull())])
    return got.groupBy(F.coalesce("reason", F.lit("eligible")).alias("reason")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct(F.when(F.col("reason").isNull(), F.lower(T.squeeze(F.col("message"))))).alias("n_messages"))


def evidence_coverage(spark: SparkSession, d: str) -> DataFrame:
    """How much of the changes' lines fits 60 words."""
    words = lambda a: F.transform(a, lambda x: F.size(F.split(x, " ")).cast("bigint"))
    rows = _sides(spark, d).withColumn("k", V.allocate(words(F.col("a")), words(F.col("d")), F.lit(60).cast("bigint")))
    a, x, ka, kx = F.size("a"), F.size("d"), F.col("k.n_add"), F.col("k.n_del")
    ratio = lambda kept, whole: F.round(F.sum(kept) / F.greatest(F.sum(whole), F.lit(1)), 6)
    used = V.total(words(F.slice("a", 1, ka))) + V.total(words(F.slice("d", 1, kx)))
    return rows.agg(
        F.count(F.lit(1)).alias("n"), F.count_if((ka < a) | (kx < x)).alias("truncated"), ratio(ka, a).alias("add_kept_ratio"), ratio(kx, x).alias("del_kept_ratio"),
        F.count_if((ka == a) & (kx == x)).alias("all_kept"), F.round(F.percentile(used, F.lit(0.5)), 4).alias("words_median"),
    )


def corpus_counters(spark: SparkSession, d: str) -> DataFrame:
    """Documents and words of each repository, and what is skipped: empty texts,
    and those whose text an earlier document has."""
    rows = table(spark, d, "documents").select("doc_id", F.coalesce(id_key(F.col("repo")), F.lit("(none)")).alias("repo"), "text")
    empty = F.coalesce(T.squeeze(F.col("text")), F.lit("")) == ""
    rows = rows.select("doc_id", "repo", empty.alias("empty"), F.sha2("text", 256).alias("h"), F.when(~empty, F.size(F.split(T.squeeze(F.col("text")), " "))).otherwise(0).alias("words"))
    first = rows.filter("not empty").groupBy("h").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    g = rows.join(first, ["h", "doc_id"], "left").groupBy("repo")
    kept = F.coalesce(F.col("first"), F.lit(False))
    return g.agg(F.count_if(kept).alias("n"), F.coalesce(F.sum(F.when(kept, F.col("words"))), F.lit(0)).cast("bigint").alias("n_words"), F.count_if("empty").alias("skipped_empty"), F.count_if(~F.col("empty") & ~kept).alias("skipped_duplicate"))


def access_ledger(spark: SparkSession, d: str) -> DataFrame:
    """The distinct states, seeds and score meanings that each variant's rows hold."""
    p = table(spark, d, "predictions")
    listed = lambda c: F.array_join(F.array_sort(F.collect_set(F.col(c).cast("string"))), ",")  # noqa: E731  (few by design)
    return p.groupBy("variant_id").agg(listed("status").alias("states"), listed("seed").alias("seeds"), listed("score_semantics").alias("semantics"))


def score_uniqueness(spark: SparkSession, d: str) -> DataFrame:
    """Distinct scores of each variant, and the share of its most frequent one."""
    s = scored(spark, d).groupBy("variant_id", "score").agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("p"))
    return s.groupBy("variant_id").agg(F.count(F.lit(1)).alias("n_scores"), F.sum("n").alias("n"), F.sum("p").cast("bigint").alias("positives"), F.round(F.max("n") / F.sum("n"), 6).alias("top_share"))


def by_language(spark: SparkSession, d: str) -> DataFrame:
    """Metrics by language, for groups of at least 20 labelled changes."""
    lang = table(spark, d, "changes").select(id_key(F.col("change_id")).alias("change_id"), F.coalesce(id_key(F.col("language")), F.lit("(none)")).alias("language"))
    return R.ap_auc(scored(spark, d).join(lang, "change_id"), ["variant_id", "language"], "score", "label").filter("n >= 20")


def project_seeds(spark: SparkSession, d: str) -> DataFrame:
    """Average precision of each variant and project, the mean over seeds, where
    a seed has at least 2 positives."""
    fine = (F.col("status") == "ok") & is_finite(F.col("score"))
    p = table(spark, d, "predictions").filter(fine).groupBy("variant_id", "seed", id_key(F.col("change_id")).alias("change_id")).agg(F.max("score").alias("score"))
    rows = p.join(labels(spark, d), "change_id").withColumn("project", F.split("change_id", ":")[0])
    per = R.ap_auc(rows, ["variant_id", "project", "seed"], "score", "label", None).filter("positives >= 2")
    return per.groupBy("variant_id", "project").agg(F.count(F.lit(1)).alias("n_seeds"), F.round(F.avg("ap"), 6).alias("mean_ap"))


def time_order(spark: SparkSession, d: str) -> DataFrame:
    """Whether the test changes of each project are its latest: the chance that one
    is later than another change, and the share before the 99th percentile of
    the others."""
    s = table(spark, d, "splits").filter(id_key(F.col("split_version")) == "upstream-provided").select(id_key(F.col("change_id")).alias("change_id"), id_key(F.col("split")).alias("split")).distinct()
    rows = table(spark, d, "changes").select(id_key(F.col("change_id")).alias("change_id"), "project_id", F.col("authored_at_unix").cast("double").alias("at")).filter("at is not null").join(s, "change_id").withColumn("test", (F.col("split") == "test").cast("int"))
    auc = R.ap_auc(rows, ["project_id"], "at", "test").select("project_id", "n", F.col("auc").alias("p_test_later"))
    cut = rows.filter("test = 0").groupBy("project_id").agg(F.percentile("at", F.lit(0.99)).alias("p99"))
    share = rows.filter("test = 1").join(cut, "project_id").groupBy("project_id").agg(F.round(F.avg((F.col("at") < F.col("p99")).cast("double")), 6).alias("test_before_p99"))
    return auc.join(share, "project_id", "left")


def windows_plan(spark: SparkSession, d: str) -> DataFrame:
    """Windows of 32 documents until 300,000 characters."""
    return B.update_windows(table(spark, d, "documents").select("doc_id", "n_chars"), "doc_id", "n_chars", 32, 300_000, "plan")


def length_plan(spark: SparkSession, d: str) -> DataFrame:
    """Batches of documents of like length, within 20,000 characters."""
    return B.length_batches(table(spark, d, "documents").filter("n_chars > 0"), "doc_id", "n_chars", 20_000)


def prompt_fit(spark: SparkSession, d: str) -> DataFrame:
    """How many hunks of each change, in the order of their first line, fit 80
    words beside up to 20 words of its message."""
    e = table(spark, d, "edits").select(id_key(F.col("change_id")).alias("change_id"), F.coalesce("file_id", F.lit("")).alias("f"), F.coalesce("hunk_id", F.lit("")).alias("h"), "line_order", "text")
    hunks = e.groupBy("change_id", "f", "h").agg(F.min("line_order").alias("at"), F.sum(F.size(F.split("text", " "))).cast("bigint").alias("size"))
    units = hunks.groupBy("change_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "f", "h", "size"))), lambda x: x["size"]).alias("sizes"))
    m = table(spark, d, "changes").select(id_key(F.col("change_id")).alias("change_id"), T.squeeze(F.coalesce("message", F.lit(""))).alias("m"))
    words = F.when(F.col("m") == "", 0).otherwise(F.size(F.split("m", " "))).cast("bigint")
    rows = m.select("change_id", words.alias("w")).join(units, "change_id").withColumn("kept_words", F.least("w", F.lit(20).cast("bigint")))
    rows = rows.withColumn("kept", V.fitting_prefix(F.col("sizes"), F.lit(80).cast("bigint") - F.col("kept_words")))
    used = F.col("kept_words") + V.total(F.slice("sizes", 1, F.col("kept")))
    return rows.select("change_id", F.size("sizes").alias("n_hunks"), "kept", used.alias("used"), ((F.col("kept") < F.size("sizes")) | (F.col("kept_words") < F.col("w"))).alias("truncated"))


_ID = "lower(regexp_replace({}, '^\\s+|\\s+$', '', 'g'))"
_UP = "s0 AS (SELECT DISTINCT lower(trim(change_id)) AS change_id, lower(trim(split)) AS split FROM splits WHERE lower(trim(split_version)) = 'upstream-provided')"
_SQ = "trim(regexp_replace({}, '[\\s\\x0b\\x1c-\\x1f\\x{{85}}\\p{{Z}}]+', ' ', 'g'), ' ')"
_MANIFEST = f"""
m AS (SELECT nullif({_ID.format("id")}, '') AS id, nullif({_ID.format("group_id")}, '') AS group_id, lower(commit_sha) AS commit_sha, repository, {_SQ.format("message")} AS message, label, label_type, label_status, prediction_at, input_available_at, label_available_at, synthetic FROM internal_manifest),
r AS (SELECT *, CASE WHEN id IS NULL THEN 'no_id' WHEN group_id IS NULL THEN 'no_group' WHEN coalesce(message, '') = '' THEN 'no_message' WHEN NOT coalesce(regexp_matches(commit_sha, '^[0-9a-f]{{7,64}}$'), false) THEN 'bad_commit'
  WHEN NOT coalesce(regexp_matches(repository, '^[A-Za-z0-9_.-]+/[A-Za-z0-9_.-]+$'), false) THEN 'bad_repository' WHEN label IS NULL OR label NOT IN (0, 1) THEN 'bad_label' WHEN (label = 1) <> (label_status = 'confirmed_positive') THEN 'status_mismatch'
  WHEN input_available_at > prediction_at THEN 'late_input' WHEN label_available_at < prediction_at THEN 'early_label' END AS reason FROM m)"""

QUERIES = {
    "record_rejects": record_rejects, "record_inputs": record_inputs, "record_labels": record_labels, "role_counts": role_counts, "pool_eligibility": pool_eligibility, "evidence_coverage": evidence_coverage,
    "corpus_counters": corpus_counters, "access_ledger": access_ledger, "score_uniqueness": score_uniqueness, "metrics_by_language": by_language, "project_seed_means": project_seeds, "project_time_order": time_order,
    "update_windows": windows_plan, "length_batches": length_plan, "prompt_fit": prompt_fit,
}
_GROUPED = """g AS (SELECT {by}, score, sum(label)::DOUBLE AS tp, count(*)::DOUBLE AS n FROM {source} GROUP BY ALL),
c AS (SELECT *, sum(tp) OVER w AS ctp, sum(n) OVER w AS cn, sum(tp) OVER (PARTITION BY {by}) AS p, sum(n) OVER (PARTITION BY {by}) AS t FROM g WINDOW w AS (PARTITION BY {by} ORDER BY score DESC))"""
_METRICS = "max(t)::BIGINT AS n, max(p)::BIGINT AS positives, round(sum(tp / nullif(p, 0) * ctp / cn), 6) AS ap, round(sum(tp * ((t - p) - (cn - ctp) + (n - tp) / 2) / nullif(p * (t - p), 0)), 6) AS auc"
ORACLES = {
    "record_rejects": f"WITH {_MANIFEST} SELECT reason, count(*) AS n FROM r WHERE reason IS NOT NULL GROUP BY 1",
    "record_inputs": f"WITH {_MANIFEST}, i AS (SELECT DISTINCT id, repository, commit_sha, group_id, prediction_at, input_available_at, message, synthetic FROM r WHERE reason IS NULL) SELECT id, repository, group_id, sha256(message) AS message FROM i",
    "record_labels": f"WITH {_MANIFEST}, i AS (SELECT DISTINCT id, label, label_type, label_status, label_available_at FROM r WHERE reason IS NULL) SELECT label_type, label, count(*) AS n, count(DISTINCT id) AS n_ids FROM i GROUP BY 1, 2",
    "role_counts": f"WITH {_UP}, x AS (SELECT lower(trim(visibility)) AS visibility, split FROM changes JOIN s0 ON s0.change_id = lower(trim(changes.change_id))) SELECT 'train' AS role, visibility, split, count(*) AS n FROM x WHERE visibility = 'public' AND split = 'train' GROUP BY ALL UNION ALL SELECT 'evaluate', visibility, split, count(*) FROM x WHERE visibility = 'internal' AND split IN ('valid', 'test') GROUP BY ALL",
    "pool_eligibility": f"WITH x AS (SELECT {_SQ.format('message')} AS m, lower(trim(change_id)) IN (SELECT lower(trim(change_id)) FROM edits) AS code FROM changes), y AS (SELECT *, CASE WHEN coalesce(m, '') = '' THEN 'empty_message' WHEN NOT code THEN 'no_code' ELSE 'eligible' END AS reason FROM x) SELECT reason, count(*) AS n, count(DISTINCT lower(m)) FILTER (reason = 'eligible') AS n_messages FROM y GROUP BY 1",
    "evidence_coverage": EVIDENCE.split("SELECT k.change_id")[0] + """, z AS (SELECT k.change_id, n_add, n_del, ka, kd, coalesce(sum(w) FILTER ((op = 'add' AND r <= ka) OR (op = 'delete' AND r <= kd)), 0)::DOUBLE AS used FROM k JOIN c USING (change_id) GROUP BY ALL)
SELECT count(*) AS n, count(*) FILTER (ka < n_add OR kd < n_del) AS truncated, round(sum(ka)::DOUBLE / greatest(sum(n_add), 1), 6) AS add_kept_ratio, round(sum(kd)::DOUBLE / greatest(sum(n_del), 1), 6) AS del_kept_ratio, count(*) FILTER (ka = n_add AND kd = n_del) AS all_kept, round(quantile_cont(used, 0.5), 4) AS words_median FROM z""",
    "corpus_counters": f"WITH x AS (SELECT doc_id, coalesce(nullif({_ID.format('repo')}, ''), '(none)') AS repo, text, {_SQ.format('text')} AS q FROM documents), y AS (SELECT *, coalesce(q, '') = '' AS e, row_number() OVER (PARTITION BY coalesce(q, '') = '', text ORDER BY doc_id) = 1 AS f FROM x) SELECT repo, count(*) FILTER (NOT e AND f) AS n, coalesce(sum(len(string_split(q, ' '))) FILTER (NOT e AND f), 0)::BIGINT AS n_words, count(*) FILTER (e) AS skipped_empty, count(*) FILTER (NOT e AND NOT f) AS skipped_duplicate FROM y GROUP BY 1",
    "access_ledger": "SELECT variant_id, array_to_string(list_sort(list(DISTINCT status::VARCHAR)), ',') AS states, array_to_string(list_sort(list(DISTINCT seed::VARCHAR)), ',') AS seeds, array_to_string(list_sort(list(DISTINCT score_semantics::VARCHAR)), ',') AS semantics FROM predictions GROUP BY 1",
    "score_uniqueness": f"WITH {SCORED}, g AS (SELECT variant_id, score, count(*) AS n, sum(label) AS p FROM x GROUP BY 1, 2) SELECT variant_id, count(*) AS n_scores, sum(n)::BIGINT AS n, sum(p)::BIGINT AS positives, round(max(n) / sum(n)::DOUBLE, 6) AS top_share FROM g GROUP BY 1",
    "metrics_by_language": f"WITH {SCORED}, z AS (SELECT x.*, coalesce(nullif({_ID.format('language')}, ''), '(none)') AS language FROM x JOIN changes ON lower(trim(changes.change_id)) = x.change_id), {_GROUPED.format(by='variant_id, language', source='z')} SELECT variant_id, language, {_METRICS} FROM c GROUP BY 1, 2 HAVING max(t) >= 20",
    "project_seed_means": f"WITH {SCORED}, ps AS (SELECT variant_id, seed, lower(trim(change_id)) AS change_id, max(score) AS score FROM predictions WHERE status = 'ok' AND score IS NOT NULL AND NOT isnan(score) AND NOT isinf(score) GROUP BY 1, 2, 3), z AS (SELECT ps.*, label, split_part(change_id, ':', 1) AS project FROM ps JOIN l USING (change_id)), {_GROUPED.format(by='variant_id, project, seed', source='z')}, q AS (SELECT variant_id, project, seed, max(p) AS p, sum(tp / nullif(p, 0) * ctp / cn) AS ap FROM c GROUP BY 1, 2, 3 HAVING max(p) >= 2) SELECT variant_id, project, count(*) AS n_seeds, round(avg(ap), 6) AS mean_ap FROM q GROUP BY 1, 2",
    "project_time_order": f"WITH {_UP}, z AS (SELECT project_id, authored_at_unix::DOUBLE AS score, (split = 'test')::INT AS label FROM changes JOIN s0 ON s0.change_id = lower(trim(changes.change_id)) WHERE authored_at_unix IS NOT NULL), {_GROUPED.format(by='project_id', source='z')}, a AS (SELECT project_id, {_METRICS} FROM c GROUP BY 1), k AS (SELECT project_id, quantile_cont(score, 0.99) AS p99 FROM z WHERE label = 0 GROUP BY 1), b AS (SELECT project_id, round(avg((score < p99)::INT::DOUBLE), 6) AS test_before_p99 FROM z JOIN k USING (project_id) WHERE label = 1 GROUP BY 1) SELECT project_id, n, auc AS p_test_later, test_before_p99 FROM a LEFT JOIN b USING (project_id)",
    "update_windows": """WITH t AS (SELECT count(*) AS n, sum(n_chars) AS total FROM documents), x AS (SELECT doc_id, n_chars AS tokens, e::INT AS epoch FROM documents, range((SELECT (300000 + total::BIGINT - 1) // total::BIGINT + (31 + n) // n FROM t)) AS r(e)),
o AS (SELECT *, row_number() OVER w - 1 AS place, sum(tokens) OVER w - tokens AS so_far FROM x WINDOW w AS (ORDER BY epoch, sha256('plan:' || epoch || ':' || doc_id))), y AS (SELECT *, place // 32 AS win FROM o),
k AS (SELECT win FROM y GROUP BY 1 HAVING min(so_far) < 300000 AND count(*) = 32) SELECT win AS "window", place, epoch, doc_id, tokens FROM y JOIN k USING (win)""",
    "prompt_fit": f"""WITH h AS (SELECT lower(trim(change_id)) AS change_id, coalesce(file_id, '') AS f, coalesce(hunk_id, '') AS h, min(line_order) AS ord, sum(len(string_split(text, ' ')))::BIGINT AS size FROM edits GROUP BY 1, 2, 3),
m AS (SELECT lower(trim(change_id)) AS change_id, {_SQ.format("coalesce(message, '')")} AS m FROM changes), w AS (SELECT change_id, CASE WHEN m = '' THEN 0 ELSE len(string_split(m, ' ')) END AS w FROM m),
c AS (SELECT h.*, w.w, least(w.w, 20) AS kw, sum(size) OVER (PARTITION BY change_id ORDER BY ord, f, h) AS cum FROM h JOIN w USING (change_id))
SELECT change_id, count(*)::INT AS n_hunks, count(*) FILTER (cum <= 80 - kw)::INT AS kept, (max(kw) + coalesce(max(cum) FILTER (cum <= 80 - kw), 0))::BIGINT AS used, bool_or(cum > 80 - kw) OR max(kw) < max(w) AS truncated FROM c GROUP BY 1""",
}
