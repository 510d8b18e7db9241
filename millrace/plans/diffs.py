"""Unified diffs made of the edits, and what is read off them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.functions.keys import id_key
from millrace.functions.numbers import is_finite
from millrace.plans.tables import table


def diffs(spark: SparkSession, d: str) -> DataFrame:
    """(change_id, diff): the edits of each change as a unified diff, files and
    hunks in the order of their first lines; the version file is named as a lock
    file, and edits without a file stand under one name."""
    e = table(spark, d, "edits").select(
        id_key(F.col("change_id")).alias("change_id"), F.replace(F.coalesce("file_id", F.lit("unnamed")), F.lit("versions.lock"), F.lit("yarn.lock")).alias("f"), F.coalesce("hunk_id", F.lit("")).alias("h"),
        "line_order", "op", F.concat(F.when(F.col("op") == "add", "+").otherwise("-"), "text").alias("line"),
    )
    ordered = lambda *c: F.array_sort(F.collect_list(F.struct(*c)))
    hunks = e.groupBy("change_id", "f", "h").agg(F.min("line_order").alias("at"), F.array_join(F.transform(ordered("line_order", "op", "line"), lambda x: x["line"]), "\n").alias("body"))
    hunks = hunks.select("change_id", "f", "at", "h", F.concat(F.lit("@@ -1 +1 @@ "), "h", F.lit("\n"), "body").alias("body"))
    files = hunks.groupBy("change_id", "f").agg(F.min("at").alias("at"), F.array_join(F.transform(ordered("at", "h", "body"), lambda x: x["body"]), "\n").alias("body"))
    files = files.select("change_id", "at", "f", F.concat(F.lit("diff --git a/"), "f", F.lit(" b/"), "f", F.lit("\n--- a/"), "f", F.lit("\n+++ b/"), "f", F.lit("\n"), "body").alias("body"))
    return files.groupBy("change_id").agg(F.array_join(F.transform(ordered("at", "f", "body"), lambda x: x["body"]), "\n").alias("diff"))


DIFFS = """
e AS (SELECT lower(trim(change_id)) AS change_id, replace(coalesce(file_id, 'unnamed'), 'versions.lock', 'yarn.lock') AS f, coalesce(hunk_id, '') AS h, line_order, op, text, CASE WHEN op = 'add' THEN '+' ELSE '-' END || text AS line FROM edits),
hu AS (SELECT change_id, f, h, min(line_order) AS ord, '@@ -1 +1 @@ ' || h || chr(10) || string_agg(line, chr(10) ORDER BY line_order, op, line) AS body FROM e GROUP BY 1, 2, 3),
fi AS (SELECT change_id, f, min(ord) AS ord, count(*) AS hunks, 'diff --git a/' || f || ' b/' || f || chr(10) || '--- a/' || f || chr(10) || '+++ b/' || f || chr(10) || string_agg(body, chr(10) ORDER BY ord, h, body) AS body FROM hu GROUP BY 1, 2)
"""


def diff_statistics(spark: SparkSession, d: str) -> DataFrame:
    s = T.patch_statistics(diffs(spark, d), "change_id", "diff")
    return s.select("change_id", "added", "deleted", "files", "directories", F.abs(F.round("entropy", 6)).alias("entropy"), "binary", "hunks")


def diff_clean(spark: SparkSession, d: str) -> DataFrame:
    """Diffs without lock files, the units they can be cut into, and a digest."""
    rows = diffs(spark, d).select("change_id", F.explode(F.array(T.clean_diff(F.col("diff")))).alias("c"))
    return rows.select("change_id", "c.kept", "c.skipped_binary", "c.skipped_lock", "c.hunks", F.size(T.hunk_units(F.col("c.text"))).alias("units"), F.sha2("c.text", 256).alias("text"))


def diff_keys(spark: SparkSession, d: str) -> DataFrame:
    """Keys by which equal patches are known."""
    return diffs(spark, d).select("change_id", T.patch_key(F.col("diff")).alias("lines_key"), F.sha2(T.normalize_patch(F.col("diff")), 256).alias("patch_key"))


def message_ends(spark: SparkSession, d: str) -> DataFrame:
    """The lengths of each message's words, cut to twelve from both ends."""
    m = table(spark, d, "changes").select(id_key(F.col("change_id")).alias("change_id"), T.squeeze(F.coalesce("message", F.lit(""))).alias("m"))
    ids = F.transform(F.filter(F.split("m", " "), lambda w: w != ""), lambda w: F.length(w))
    return m.select("change_id", F.array_join(T.head_tail(ids, 12, [-1, -1]).cast("array<string>"), ",").alias("ends"))


def reply_scores(spark: SparkSession, d: str) -> DataFrame:
    """Scores as replies of a model, of several seeds in as many forms, read back."""
    p = table(spark, d, "predictions").filter(is_finite(F.col("score")) & F.col("score").between(0, 1)).select("variant_id", "seed", F.round(F.col("score") * 100, 3).cast("decimal(9,3)").alias("s"))
    text = F.col("s").cast("string")
    plain = F.concat(F.lit('{"risk_score": '), text, F.lit("}"))
    kind = F.pmod("seed", F.lit(4))
    reply = F.when(kind == 0, plain).when(kind == 1, F.concat(F.lit("```json\n"), plain, F.lit("\n```"))).when(kind == 2, F.concat(F.lit("Score: "), text)).otherwise(F.concat(F.lit('{"risk_score": '), text, F.lit(', "why": "x"}')))
    return p.withColumn("x", T.parse_score(reply)).groupBy("variant_id", "seed").agg(F.count(F.lit(1)).alias("n"), F.count("x").alias("n_read"), F.round(F.avg("x"), 6).alias("mean"))


_WS = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]"
QUERIES = {"diff_statistics": diff_statistics, "diff_clean": diff_clean, "diff_keys": diff_keys, "message_ends": message_ends, "reply_scores": reply_scores}
ORACLES = {
    "diff_statistics": f"""WITH {DIFFS}, c AS (SELECT change_id, f, count(*) AS n FROM e GROUP BY 1, 2), t AS (SELECT change_id, sum(n) AS t FROM c GROUP BY 1),
en AS (SELECT change_id, round(abs(sum(n / t::DOUBLE * log2(n / t::DOUBLE))), 6) AS entropy FROM c JOIN t USING (change_id) GROUP BY 1)
SELECT e.change_id, count(*) FILTER (op = 'add') AS added, count(*) FILTER (op = 'delete') AS deleted, count(DISTINCT f) AS files, count(DISTINCT regexp_extract(f, '^(.*)/[^/]*$', 1)) AS directories, any_value(entropy) AS entropy, 0::BIGINT AS binary, count(DISTINCT (f, h)) AS hunks FROM e JOIN en USING (change_id) GROUP BY 1""",
    "diff_clean": f"""WITH {DIFFS}, k AS (SELECT *, regexp_matches(f, '(^|/)yarn\\.lock$') AS lock FROM fi)
SELECT change_id, count(*) FILTER (NOT lock)::INT AS kept, 0 AS skipped_binary, count(*) FILTER (lock)::INT AS skipped_lock, coalesce(sum(hunks) FILTER (NOT lock), 0)::INT AS hunks, coalesce(sum(hunks) FILTER (NOT lock), 0)::INT AS units, sha256(coalesce(string_agg(body, chr(10) ORDER BY ord, f, body) FILTER (NOT lock), '')) AS text FROM k GROUP BY 1""",
    "diff_keys": f"""WITH {DIFFS}, di AS (SELECT change_id, string_agg(body, chr(10) ORDER BY ord, f, body) AS diff FROM fi GROUP BY 1),
li AS (SELECT change_id, list_filter(list_transform(list_filter(string_split(diff, chr(10)), lambda x: regexp_matches(x, '^[+-]') AND NOT regexp_matches(x, '^(\\+\\+\\+|---)')), lambda x: regexp_replace(substr(x, 2), '{_WS}+', '', 'g')), lambda x: x <> '') AS l,
  array_to_string(list_transform(string_split(diff, chr(10)), lambda x: regexp_replace(regexp_replace(x, '^@@.*?@@', '@@'), '{_WS}+$', '')), chr(10)) AS n FROM di)
SELECT change_id, CASE WHEN len(l) > 0 THEN sha256(array_to_string(l, chr(10))) END AS lines_key, sha256(regexp_replace(n, '^{_WS}+|{_WS}+$', '', 'g')) AS patch_key FROM li""",
    "message_ends": f"""WITH m AS (SELECT lower(trim(change_id)) AS change_id, list_transform(list_filter(string_split(trim(regexp_replace(coalesce(message, ''), '{_WS}+', ' ', 'g'), ' '), ' '), lambda x: x <> ''), lambda x: length(x)) AS l FROM changes)
SELECT change_id, array_to_string(CASE WHEN len(l) <= 12 THEN l ELSE l[1:5] || [-1, -1] || l[len(l) - 4:] END, ',') AS ends FROM m""",
    "reply_scores": "WITH p AS (SELECT variant_id, seed, round(score * 100, 3)::DECIMAL(9, 3)::DOUBLE / 100 AS x FROM predictions WHERE score IS NOT NULL AND NOT isnan(score) AND NOT isinf(score) AND score BETWEEN 0 AND 1) SELECT variant_id, seed, count(*) AS n, count(*) FILTER (seed % 4 < 2) AS n_read, round(avg(x) FILTER (seed % 4 < 2), 6) AS mean FROM p GROUP BY 1, 2",
}
