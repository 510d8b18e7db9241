"""Duplicates, splits, samples and contracts over the project's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.functions.keys import id_key
from millrace.operators import contracts as C
from millrace.operators import dedup as D
from millrace.operators import splitting as S
from millrace.plans.metrics import labels
from millrace.plans.tables import table

TRAIN_BEFORE, VALID_BEFORE = "2024-07-01", "2025-03-01"
FEATURES = ("ns", "nd", "nf", "entropy", "la", "ld", "lt", "fix", "ndev", "age", "nuc", "exp", "rexp", "sexp")


def _lines(spark: SparkSession, d: str) -> DataFrame:
    return D.lines_of(table(spark, d, "edits").select("change_id", "line_order", "op", "text"), "change_id", "line_order", "op", "text")


def line_aggregate(spark: SparkSession, d: str) -> DataFrame:
    joined = lambda c: F.sha2(F.array_join(c, "\n"), 256)
    return _lines(spark, d).select("change_id", F.size("added").alias("n_add"), F.size("deleted").alias("n_del"), joined("added").alias("added"), joined("deleted").alias("deleted"))


def _keys(spark: SparkSession, d: str) -> DataFrame:
    changes = table(spark, d, "changes").select("change_id", "message")
    s = table(spark, d, "splits").filter(id_key(F.col("split_version")) == "upstream-provided").select(id_key(F.col("change_id")).alias("change_id"), id_key(F.col("split")).alias("split")).distinct()
    return D.duplicate_keys(changes, "change_id", "message", _lines(spark, d)).join(s, "change_id").join(labels(spark, d), "change_id", "left")


KEYS = r"""
ln AS (SELECT change_id, coalesce(list(text ORDER BY line_order, text) FILTER (op = 'add'), []) AS a, coalesce(list(text ORDER BY line_order, text) FILTER (op = 'delete'), []) AS d FROM edits GROUP BY 1),
sp AS (SELECT DISTINCT lower(trim(change_id)) AS change_id, lower(trim(split)) AS split FROM splits WHERE lower(trim(split_version)) = 'upstream-provided'),
l AS (SELECT lower(trim(id)) AS change_id, max(label) AS label FROM internal_manifest GROUP BY 1),
k AS (SELECT c.change_id, sp.split, l.label, {'m': coalesce(message, ''), 'a': a, 'd': d}::VARCHAR AS exact_key, CASE WHEN len(a) + len(d) > 0 THEN {'a': a, 'd': d}::VARCHAR END AS code_key,
      {'m': trim(regexp_replace(coalesce(message, ''), '[\s\x0b\x{85}\p{Z}]+', ' ', 'g')), 'a': list_sort(list_transform(a, lambda x: trim(regexp_replace(x, '[\s\x0b\x{85}\p{Z}]+', ' ', 'g')))), 'd': list_sort(list_transform(d, lambda x: trim(regexp_replace(x, '[\s\x0b\x{85}\p{Z}]+', ' ', 'g'))))}::VARCHAR AS normalized_key,
      len(a)::INT AS n_add, len(d)::INT AS n_del, message
      FROM changes c JOIN ln USING (change_id) JOIN sp USING (change_id) LEFT JOIN l USING (change_id))
"""


def dup_groups(spark: SparkSession, d: str) -> DataFrame:
    return D.group_statistics(_keys(spark, d), ["exact_key", "code_key", "normalized_key"], "split", "label")


def cross_split_pairs(spark: SparkSession, d: str) -> DataFrame:
    return D.cross_split_pairs(_keys(spark, d), "normalized_key", "split")


def dup_components(spark: SparkSession, d: str) -> DataFrame:
    """Components of changes with the same code or message, that are larger than one."""
    k = _keys(spark, d).join(table(spark, d, "changes").select("change_id", F.when(F.length("message") >= 20, F.lower("message")).alias("text")), "change_id")
    c = D.components(k, "change_id", ["code_key", "text"])
    return c.join(k.select("change_id", "split"), "change_id").groupBy("component").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("split").alias("n_splits")).filter("n > 1")


def content_counts(spark: SparkSession, d: str) -> DataFrame:
    k = D.duplicate_keys(table(spark, d, "changes").select("change_id", "message"), "change_id", "message", _lines(spark, d))
    return D.content_counts(k.join(table(spark, d, "changes").select("change_id", "message"), "change_id"), "message", "n_add", "n_del")


def column_profile(spark: SparkSession, d: str) -> DataFrame:
    p = D.column_profile(table(spark, d, "features"), FEATURES)
    return p.select("name", "n_null", "n_nan", "n_negative", *[F.round(c, 6).alias(c) for c in ("low", "median", "high")])


def split_counts(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "splits").filter(id_key(F.col("split_version")) == "upstream-provided").select(id_key(F.col("change_id")).alias("change_id"), id_key(F.col("split")).alias("split")).distinct()
    rows = s.join(labels(spark, d), "change_id", "left").withColumn("project", F.split("change_id", ":")[0])
    return rows.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.sum("label").cast("bigint").alias("positives"), F.round(F.avg("label"), 4).alias("prevalence"), F.countDistinct("project").alias("n_projects"))


def split_label_counts(spark: SparkSession, d: str) -> DataFrame:
    return _keys(spark, d).filter("label is not null").groupBy(F.concat_ws("/", "split", F.col("label").cast("string")).alias("cell")).agg(F.count(F.lit(1)).alias("n"))


def split_time(spark: SparkSession, d: str) -> DataFrame:
    """Time range of each split, and whether it ends before the next begins."""
    t = _keys(spark, d).select("change_id", "split").join(table(spark, d, "changes").select("change_id", "authored_at_unix"), "change_id")
    g = t.groupBy("split").agg(F.min("authored_at_unix").alias("first"), F.max("authored_at_unix").alias("last"), F.round(F.percentile("authored_at_unix", F.lit(0.99)), 3).alias("p99"))
    ends = g.agg(F.max(F.when(F.col("split") == "train", F.col("last"))).alias("t"), F.min(F.when(F.col("split") == "valid", F.col("first"))).alias("v0"), F.max(F.when(F.col("split") == "valid", F.col("last"))).alias("v"), F.min(F.when(F.col("split") == "test", F.col("first"))).alias("s0"))
    return g.join(F.broadcast(ends)).select("split", "first", "last", "p99", ((F.col("t") < F.col("v0")) & (F.col("v") < F.col("s0"))).alias("time_ordered"))


def _manifest(spark: SparkSession, d: str) -> DataFrame:
    """One row for each change and group it stands under."""
    m = table(spark, d, "internal_manifest").select(id_key(F.col("id")).alias("change_id"), "prediction_at", "label_available_at", id_key(F.col("group_id")).alias("grp"))
    one = m.groupBy("change_id").agg(F.min("prediction_at").alias("prediction_at"), F.max("label_available_at").alias("label_available_at"))
    one = one.join(table(spark, d, "changes").select("change_id", F.col("content_hash").alias("patch")), "change_id")
    return one.join(m.select("change_id", "grp").filter("grp is not null").distinct(), "change_id", "left")


def temporal_split(spark: SparkSession, d: str) -> DataFrame:
    return S.temporal_split(_manifest(spark, d), "change_id", "prediction_at", "label_available_at", "patch", ["grp"], TRAIN_BEFORE, VALID_BEFORE)


def temporal_split_reasons(spark: SparkSession, d: str) -> DataFrame:
    return temporal_split(spark, d).groupBy("role", F.coalesce("reason", F.lit("kept")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


_TEMPORAL = f"""
WITH RECURSIVE q AS (SELECT lower(trim(id)) AS change_id, min(prediction_at) AS pt, max(label_available_at) AS la, min(nullif(lower(regexp_replace(group_id, '^\\s+|\\s+$', '', 'g')), '')) AS grp FROM internal_manifest GROUP BY 1),
m AS (SELECT q.*, content_hash AS patch, CASE WHEN pt < TIMESTAMP '{TRAIN_BEFORE}' THEN 'train' WHEN pt < TIMESTAMP '{VALID_BEFORE}' THEN 'valid' ELSE 'test' END AS role FROM q JOIN changes c USING (change_id)),
p AS (SELECT change_id, 'g' || grp AS k FROM m WHERE grp IS NOT NULL UNION SELECT change_id, 'p' || patch FROM m WHERE patch IS NOT NULL),
e AS (SELECT DISTINCT a.k AS x, b.k AS y FROM p a JOIN p b USING (change_id)),
r(x, y) AS (SELECT x, y FROM e UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x),
h AS (SELECT r.x AS k, min(p.change_id) AS root FROM r JOIN p ON p.k = r.y GROUP BY 1),
o AS (SELECT m.change_id, coalesce(min(root), m.change_id) AS component FROM m LEFT JOIN p USING (change_id) LEFT JOIN h USING (k) GROUP BY m.change_id),
z AS (SELECT m.*, component, min(role) OVER (PARTITION BY component) < max(role) OVER (PARTITION BY component) AS crosses,
      CASE role WHEN 'train' THEN coalesce(la > TIMESTAMP '{TRAIN_BEFORE}', true) WHEN 'valid' THEN coalesce(la > TIMESTAMP '{VALID_BEFORE}', true) ELSE false END AS late FROM m JOIN o USING (change_id)),
f AS (SELECT *, row_number() OVER (PARTITION BY component, patch, crosses OR late ORDER BY pt, change_id) AS k FROM z),
y AS (SELECT change_id, role, CASE WHEN crosses THEN 'crosses_split' WHEN late THEN 'label_late' WHEN patch IS NOT NULL AND k > 1 THEN 'duplicate_patch' END AS reason FROM f)
"""


def exclusions(spark: SparkSession, d: str) -> DataFrame:
    return S.controlled_exclusions(_keys(spark, d), "change_id", "split", "exact_key", "code_key")


def leak_by_message(spark: SparkSession, d: str) -> DataFrame:
    """Evaluation changes whose message (20 characters or more, lower case, single spaces) stands in the training split."""
    m = F.trim(F.regexp_replace(F.lower("message"), r"\s+", " "))
    k = table(spark, d, "changes").select("change_id", F.when(F.length(m) >= 20, m).alias("key"))
    rows = _keys(spark, d).select("change_id", "split", "label").filter("label is not null").join(k, "change_id")
    return S.near_duplicate_leak(rows, "split", "key", "label")


def leak_of_all(spark: SparkSession, d: str) -> DataFrame:
    """Evaluation changes whose message or whose changed lines (without white
    space) stand in the training split, labelled or not; a label counts for
    n_agree alone.  A line delivered twice is one."""
    key = id_key(F.col("change_id")).alias("change_id")
    s = table(spark, d, "splits").filter(id_key(F.col("split_version")) == "upstream-provided").select(key, id_key(F.col("split")).alias("split")).distinct()
    messages = table(spark, d, "changes").select(key, T.message_key(F.col("message")).alias("message"))
    lines = table(spark, d, "edits").select(key, "line_order", "op", "text").distinct().groupBy("change_id").agg(F.array_sort(F.collect_list(F.struct("line_order", "op", "text"))).alias("e"))
    contents = lines.select("change_id", T.content_key(F.transform("e", lambda x: x["text"])).alias("change"))
    rows = s.join(messages, "change_id").join(contents, "change_id", "left").join(labels(spark, d), "change_id", "left")
    kinds = [S.near_duplicate_leak(rows.select("split", "label", k), "split", k, "label").select(F.lit(k).alias("kind"), "split", "n", "n_matched", "n_agree") for k in ("change", "message")]
    return kinds[0].unionByName(kinds[1])


def nested_sample(spark: SparkSession, d: str) -> DataFrame:
    rows = _keys(spark, d).select("change_id", "split")
    half, quarter = S.nested_fraction(F.col("change_id"), "s", 0.5), S.nested_fraction(F.col("change_id"), "s", 0.25)
    return rows.select("change_id", ((F.col("split") != "train") | half).alias("in_half"), ((F.col("split") != "train") | quarter).alias("in_quarter"))


def hash_topn(spark: SparkSession, d: str) -> DataFrame:
    return S.hash_sample(table(spark, d, "changes").select("change_id", "project_id"), "change_id", "pick", 50)


def quota_rows(spark: SparkSession, d: str) -> DataFrame:
    return S.quota_rows(table(spark, d, "changes").select("change_id"), "change_id", "dev", 0.05)


def quota_groups(spark: SparkSession, d: str) -> DataFrame:
    return S.quota_groups(table(spark, d, "changes").select("change_id", "content_hash").filter("content_hash is not null"), "change_id", "content_hash", "dev", 0.05).select("change_id", "chosen")


def budget_cut(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").filter("n_chars > 0").select(F.col("doc_id").cast("string").alias("doc"), "n_chars")
    return S.budget_cut(docs, "corpus", "doc", "n_chars", 200_000)


def contract_violations(spark: SparkSession, d: str) -> DataFrame:
    """Violations of keys and references, one row per contract."""
    changes, features, edits, splits, manifest, sheet = (table(spark, d, t) for t in ("changes", "features", "edits", "splits", "internal_manifest", "label_sheet"))
    key = lambda df, c: df.select(id_key(F.col(c)).alias("k"))
    c = key(changes, "change_id")
    checks = {
        "changes_unique": C.repeated_keys(c, "k"), "features_unique": C.repeated_keys(key(features, "change_id"), "k"), "splits_unique": C.repeated_keys(splits.select("change_id", "split_version"), "change_id", "split_version"),
        "features_equal_changes": C.set_difference(key(features, "change_id"), c), "edits_reference": C.missing_parents(key(edits, "change_id"), "k", c, "k"), "manifest_reference": C.missing_parents(key(manifest, "id"), "k", c, "k"),
        "sheet_reference": C.missing_parents(key(sheet, "change_id"), "k", c, "k"), "input_after_prediction": manifest.filter("input_available_at > prediction_at"), "label_before_prediction": manifest.filter("label_available_at < prediction_at"),
    }
    rows = [v.agg(F.count(F.lit(1)).alias("n")).select(F.lit(k).alias("contract"), "n") for k, v in checks.items()]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


_K = "lower(regexp_replace({c}, '^\\s+|\\s+$', '', 'g'))"
QUERIES = {
    "line_aggregate": line_aggregate, "dup_groups": dup_groups, "cross_split_pairs": cross_split_pairs, "dup_components": dup_components, "content_counts": content_counts, "column_profile": column_profile,
    "split_counts": split_counts, "split_label_counts": split_label_counts, "split_time": split_time, "temporal_split": temporal_split, "temporal_split_reasons": temporal_split_reasons, "controlled_exclusions": exclusions, "near_dup_leak": leak_by_message, "near_dup_leak_all": leak_of_all,
    "nested_fraction": nested_sample, "hash_topn": hash_topn, "quota_rows": quota_rows, "quota_groups": quota_groups, "token_budget": budget_cut, "contract_violations": contract_violations,
}
ORACLES = {
    "line_aggregate": """SELECT change_id, count(*) FILTER (op = 'add')::INT AS n_add, count(*) FILTER (op = 'delete')::INT AS n_del, sha256(coalesce(string_agg(text, chr(10) ORDER BY line_order, text) FILTER (op = 'add'), '')) AS added,
        sha256(coalesce(string_agg(text, chr(10) ORDER BY line_order, text) FILTER (op = 'delete'), '')) AS deleted FROM edits GROUP BY 1""",
    "dup_groups": "WITH " + KEYS + """, u AS (SELECT 'exact_key' AS key, exact_key AS v, split, label FROM k UNION ALL SELECT 'code_key', code_key, split, label FROM k UNION ALL SELECT 'normalized_key', normalized_key, split, label FROM k),
        g AS (SELECT key, v, count(*) AS n, count(DISTINCT split) AS s, count(DISTINCT label) AS y FROM u WHERE v IS NOT NULL GROUP BY 1, 2)
        SELECT key, coalesce(sum(n) FILTER (n > 1), 0)::BIGINT AS n_rows, count(*) FILTER (n > 1) AS n_groups, count(*) FILTER (n > 1 AND s > 1) AS n_cross_split, count(*) FILTER (n > 1 AND y > 1) AS n_label_conflicts FROM g GROUP BY 1""",
    "cross_split_pairs": "WITH " + KEYS + """, g AS (SELECT DISTINCT normalized_key AS v, split FROM k) SELECT a.split || '-' || b.split AS pair, count(*) AS n FROM g a JOIN g b ON a.v = b.v AND a.split < b.split GROUP BY 1""",
    "dup_components": "WITH RECURSIVE " + KEYS + """, p AS (SELECT change_id, 'c' || code_key AS v FROM k WHERE code_key IS NOT NULL UNION SELECT change_id, 'm' || lower(message) FROM k WHERE length(message) >= 20),
        e AS (SELECT DISTINCT a.v AS x, b.v AS y FROM p a JOIN p b USING (change_id)), r(x, y) AS (SELECT x, y FROM e UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x),
        h AS (SELECT r.x AS v, min(p.change_id) AS root FROM r JOIN p ON p.v = r.y GROUP BY 1), o AS (SELECT change_id, min(root) AS component FROM p JOIN h USING (v) GROUP BY 1)
        SELECT component, count(*) AS n, count(DISTINCT split) AS n_splits FROM o JOIN k USING (change_id) GROUP BY 1 HAVING count(*) > 1""",
    "content_counts": """WITH e AS (SELECT change_id, count(*) FILTER (op = 'add') AS a, count(*) FILTER (op = 'delete') AS d FROM edits GROUP BY 1), x AS (SELECT message, coalesce(a, 0) AS a, coalesce(d, 0) AS d FROM changes LEFT JOIN e USING (change_id))
        SELECT count(*) AS n, count(*) FILTER (trim(coalesce(message, '')) = '') AS empty_message, count(*) FILTER (a > 0 AND d = 0) AS add_only, count(*) FILTER (a = 0 AND d > 0) AS delete_only, count(*) FILTER (a = 0 AND d = 0) AS no_lines, quantile_cont(a, 0.5) AS median_add, quantile_cont(d, 0.5) AS median_del FROM x""",
    "column_profile": "WITH u AS (" + " UNION ALL ".join(f"SELECT '{c}' AS name, {c} AS x FROM features" for c in FEATURES) + """), y AS (SELECT *, CASE WHEN NOT isnan(x) THEN x END AS f FROM u)
        SELECT name, count(*) FILTER (x IS NULL) AS n_null, count(*) FILTER (isnan(x)) AS n_nan, count(*) FILTER (f < 0) AS n_negative, round(min(f), 6) AS low, round(quantile_cont(f, 0.5), 6) AS median, round(max(f), 6) AS high FROM y GROUP BY 1""",
    "split_counts": "WITH " + KEYS + " SELECT sp.split, count(*) AS n, sum(label)::BIGINT AS positives, round(avg(label), 4) AS prevalence, count(DISTINCT split_part(change_id, ':', 1)) AS n_projects FROM sp LEFT JOIN l USING (change_id) GROUP BY 1",
    "split_label_counts": "WITH " + KEYS + " SELECT split || '/' || label::VARCHAR AS cell, count(*) AS n FROM k WHERE label IS NOT NULL GROUP BY 1",
    "split_time": "WITH " + KEYS + """, g AS (SELECT split, min(authored_at_unix) AS first, max(authored_at_unix) AS last, round(quantile_cont(authored_at_unix::DOUBLE, 0.99), 3) AS p99 FROM sp JOIN changes USING (change_id) GROUP BY 1)
        SELECT *, (SELECT max(last) FILTER (split = 'train') < min(first) FILTER (split = 'valid') AND max(last) FILTER (split = 'valid') < min(first) FILTER (split = 'test') FROM g) AS time_ordered FROM g""",
    "temporal_split": _TEMPORAL + "SELECT * FROM y",
    "temporal_split_reasons": _TEMPORAL + "SELECT role, coalesce(reason, 'kept') AS reason, count(*) AS n FROM y GROUP BY 1, 2",
    "controlled_exclusions": "WITH " + KEYS + """ SELECT change_id, CASE WHEN exact_key IN (SELECT exact_key FROM k WHERE split <> 'train') THEN 'exact_duplicate_in_eval' ELSE 'code_duplicate_in_eval' END AS reason FROM k
        WHERE split = 'train' AND (exact_key IN (SELECT exact_key FROM k WHERE split <> 'train') OR code_key IN (SELECT code_key FROM k WHERE split <> 'train' AND code_key IS NOT NULL))""",
    "near_dup_leak": "WITH " + KEYS + r""", m AS (SELECT split, label, trim(regexp_replace(lower(message), '\s+', ' ', 'g')) AS t FROM k WHERE label IS NOT NULL), n AS (SELECT split, label, CASE WHEN length(t) >= 20 THEN t END AS t FROM m),
        b AS (SELECT t, round_even(avg(label), 0) AS y FROM n WHERE split = 'train' AND t IS NOT NULL GROUP BY 1) SELECT split, count(*) AS n, count(y) AS n_matched, count(*) FILTER (y = label) AS n_agree FROM n LEFT JOIN b USING (t) WHERE split <> 'train' GROUP BY 1""",
    "near_dup_leak_all": r"""WITH sp AS (SELECT DISTINCT lower(trim(change_id)) AS change_id, lower(trim(split)) AS split FROM splits WHERE lower(trim(split_version)) = 'upstream-provided'),
        l AS (SELECT lower(trim(id)) AS change_id, max(label) AS label FROM internal_manifest GROUP BY 1),
        m AS (SELECT lower(trim(change_id)) AS change_id, trim(regexp_replace(lower(message), '[\s\x0b\x1c-\x1f\x{85}\p{Z}]+', ' ', 'g')) AS t FROM changes),
        e AS (SELECT DISTINCT lower(trim(change_id)) AS change_id, line_order, op, text, regexp_replace(text, '[\s\x0b\x1c-\x1f\x{85}\p{Z}]+', '', 'g') AS t FROM edits),
        b AS (SELECT change_id, string_agg(t, chr(10) ORDER BY line_order, op, text) AS t FROM e WHERE t <> '' GROUP BY 1),
        u AS (SELECT 'message' AS kind, change_id, CASE WHEN length(t) >= 20 THEN t END AS t FROM m UNION ALL SELECT 'change', m.change_id, b.t FROM m LEFT JOIN b USING (change_id)),
        n AS (SELECT u.*, split, label FROM u JOIN sp USING (change_id) LEFT JOIN l USING (change_id)),
        g AS (SELECT kind, t, round_even(avg(label), 0) AS y, true AS there FROM n WHERE split = 'train' AND t IS NOT NULL GROUP BY 1, 2)
        SELECT kind, split, count(*) AS n, count(there) AS n_matched, count(*) FILTER (y = label) AS n_agree FROM n LEFT JOIN g USING (kind, t) WHERE split <> 'train' GROUP BY 1, 2""",
    "nested_fraction": "WITH " + KEYS + """, u AS (SELECT change_id, split, ('0x' || substr(sha256('s:' || change_id), 1, 15))::BIGINT::DOUBLE / pow(16, 15) AS u FROM k) SELECT change_id, split <> 'train' OR u < 0.5 AS in_half, split <> 'train' OR u < 0.25 AS in_quarter FROM u""",
    "hash_topn": "SELECT change_id, project_id FROM changes ORDER BY sha256('pick:' || change_id) LIMIT 50",
    "quota_rows": "SELECT change_id, row_number() OVER (ORDER BY sha256('dev:' || change_id)) <= round_even((SELECT count(*) FROM changes) * 0.05::DOUBLE, 0) AS chosen FROM changes",
    "quota_groups": """WITH c AS (SELECT change_id, content_hash FROM changes WHERE content_hash IS NOT NULL), g AS (SELECT content_hash, min(change_id) AS f, count(*) AS n FROM c GROUP BY 1),
        b AS (SELECT content_hash, coalesce(sum(n) OVER (ORDER BY sha256('dev:' || f) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM g) SELECT change_id, b < round_even((SELECT count(*) FROM c) * 0.05::DOUBLE, 0) AS chosen FROM c JOIN b USING (content_hash)""",
    "token_budget": """WITH x AS (SELECT doc_id::VARCHAR AS doc, n_chars, sum(n_chars) OVER (ORDER BY sha256('corpus:' || doc_id::VARCHAR)) - n_chars AS b FROM documents WHERE n_chars > 0) SELECT doc, n_chars FROM x WHERE b < 200000""",
    "contract_violations": f"""WITH c AS (SELECT {_K.format(c='change_id')} AS k FROM changes)
        SELECT 'changes_unique' AS contract, (SELECT count(*) FROM (SELECT k FROM c GROUP BY 1 HAVING count(*) > 1)) AS n
        UNION ALL SELECT 'features_unique', (SELECT count(*) FROM (SELECT {_K.format(c='change_id')} FROM features GROUP BY 1 HAVING count(*) > 1))
        UNION ALL SELECT 'splits_unique', (SELECT count(*) FROM (SELECT change_id FROM splits GROUP BY change_id, split_version HAVING count(*) > 1))
        UNION ALL SELECT 'features_equal_changes', (SELECT count(*) FROM ((SELECT {_K.format(c='change_id')} FROM features EXCEPT ALL SELECT k FROM c) UNION ALL (SELECT k FROM c EXCEPT ALL SELECT {_K.format(c='change_id')} FROM features)))
        UNION ALL SELECT 'edits_reference', (SELECT count(DISTINCT {_K.format(c='change_id')}) FROM edits WHERE {_K.format(c='change_id')} NOT IN (SELECT k FROM c))
        UNION ALL SELECT 'manifest_reference', (SELECT count(DISTINCT {_K.format(c='id')}) FROM internal_manifest WHERE {_K.format(c='id')} NOT IN (SELECT k FROM c))
        UNION ALL SELECT 'sheet_reference', (SELECT count(DISTINCT {_K.format(c='change_id')}) FROM label_sheet WHERE {_K.format(c='change_id')} NOT IN (SELECT k FROM c))
        UNION ALL SELECT 'input_after_prediction', (SELECT count(*) FROM internal_manifest WHERE input_available_at > prediction_at)
        UNION ALL SELECT 'label_before_prediction', (SELECT count(*) FROM internal_manifest WHERE label_available_at < prediction_at)""",
}
