"""Missing values and dangling references (problems 1 and 2)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.keys import id_key
from millrace.operators.impute import NumericField, fill_category, fill_numeric
from millrace.operators.orphans import ForeignKey, Table, find_orphans, orphan_report
from millrace.plans.tables import table

#: Largest possible age in days, and the tolerance above the largest entropy.
MAX_AGE, ENTROPY_SLACK = 20_000.0, 1e-6


def _fields() -> list[NumericField]:
    bits = F.when(F.col("nf") >= 1, F.log2("nf")).when(F.col("nf") >= 0, F.lit(0.0))
    return [
        NumericField("entropy", F.lit(0.0), bits, ENTROPY_SLACK, lambda x: F.when(bits > 0, x / bits), lambda m: m * bits, 0.0),
        NumericField("age", F.lit(0.0), F.lit(MAX_AGE), 0.0, lambda x: F.log1p(x), lambda m: F.expm1(m), 0.0),
    ]


def filled_features(spark: SparkSession, d: str) -> DataFrame:
    changes = (
        table(spark, d, "changes")
        .select(id_key(F.col("change_id")).alias("__id"), id_key(F.col("project_id")).alias("__project"), F.date_format(F.timestamp_seconds("authored_at_unix"), "yyyy-MM").alias("__month"))
        .groupBy("__id")
        .agg(F.min("__project").alias("__project"), F.min("__month").alias("__month"))
    )
    features = table(spark, d, "features")
    joined = features.join(changes, id_key(features["change_id"]) == changes["__id"], "left")
    return fill_numeric(joined, _fields(), ["__project", "__month"]).drop("__id", "__project", "__month")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    filled = filled_features(spark, d)
    field = F.explode(F.array_compact(F.array(F.when(F.col("entropy_filled"), F.lit("entropy")), F.when(F.col("age_filled"), F.lit("age")))))
    return filled.select(id_key(F.col("change_id")).alias("change_id"), field.alias("field")).distinct()


P1_FOUND_SQL = """
WITH f AS (SELECT lower(regexp_replace(change_id, '^\\s+|\\s+$', '', 'g')) AS change_id, entropy, age, nf FROM features)
SELECT DISTINCT change_id, 'entropy' AS field FROM f
WHERE entropy IS NULL OR isnan(entropy) OR isinf(entropy) OR entropy < 0 OR entropy > log2(nf) + 0.000001
UNION
SELECT DISTINCT change_id, 'age' FROM f WHERE age IS NULL OR isnan(age) OR isinf(age) OR age < 0 OR age > 20000
"""


def p1_filled(spark: SparkSession, d: str) -> DataFrame:
    return filled_features(spark, d).select(id_key(F.col("change_id")).alias("change_id"), F.col("nf"), F.round("entropy", 6).alias("entropy"), F.round("age", 6).alias("age"), "entropy_filled", "age_filled")


def p1_language(spark: SparkSession, d: str) -> DataFrame:
    """The category of every change, its language, filled from its project and month."""
    changes = table(spark, d, "changes").select("change_id", "project_id", "language", F.date_format(F.timestamp_seconds("authored_at_unix"), "yyyy-MM").alias("month"))
    return fill_category(changes, "language", ["project_id", "month"]).select("change_id", id_key(F.col("language")).alias("language"), "language_filled")


P1_LANGUAGE_SQL = """
WITH c AS (SELECT change_id, project_id, strftime(to_timestamp(authored_at_unix) AT TIME ZONE 'UTC', '%Y-%m') AS month,
                  nullif(lower(trim(language)), '') AS lang FROM changes),
p AS (SELECT * FROM c WHERE lang IS NOT NULL),
share AS (SELECT lang, count(*)::DOUBLE / (SELECT count(*) FROM p) AS share FROM p GROUP BY 1),
a AS (SELECT project_id, lang, count(*)::DOUBLE AS n FROM p GROUP BY 1, 2), ta AS (SELECT project_id, sum(n) AS n FROM a GROUP BY 1),
b AS (SELECT month, lang, count(*)::DOUBLE AS n FROM p GROUP BY 1, 2), tb AS (SELECT month, sum(n) AS n FROM b GROUP BY 1),
w AS (SELECT DISTINCT project_id, month FROM c WHERE lang IS NULL),
s AS (SELECT w.project_id, w.month, share.lang,
             round(ln(share) + ln((coalesce(a.n, 0) / share + 5) / (coalesce(ta.n, 0) + 5)) + ln((coalesce(b.n, 0) / share + 5) / (coalesce(tb.n, 0) + 5)), 9) AS score
      FROM w CROSS JOIN share LEFT JOIN a ON a.project_id = w.project_id AND a.lang = share.lang LEFT JOIN ta ON ta.project_id = w.project_id
      LEFT JOIN b ON b.month = w.month AND b.lang = share.lang LEFT JOIN tb ON tb.month = w.month
      WHERE a.n IS NOT NULL OR b.n IS NOT NULL OR share.lang = (SELECT lang FROM share ORDER BY share DESC, lang LIMIT 1)),
best AS (SELECT project_id, month, lang FROM (SELECT *, row_number() OVER (PARTITION BY project_id, month ORDER BY score DESC, lang) AS k FROM s) WHERE k = 1)
SELECT c.change_id, coalesce(c.lang, best.lang) AS language, c.lang IS NULL AS language_filled
FROM c LEFT JOIN best ON c.lang IS NULL AND best.project_id = c.project_id AND best.month = c.month
"""


def mapping_orphans(spark: SparkSession, d: str) -> DataFrame:
    changes, deployments, mapping = (table(spark, d, t) for t in ("changes", "deployments", "mapping"))
    tables = {
        "changes": Table(changes.select("change_id", "visibility", "available_at"), deleted=id_key(F.col("visibility")) == "deleted", available_at=F.col("available_at")),
        "deployments": Table(deployments.select("deployment_id", "deleted_at", "recorded_at"), deleted_at=F.col("deleted_at"), available_at=F.col("recorded_at")),
        "mapping": Table(mapping, time=F.col("mapped_at")),
    }
    keys = [ForeignKey("mapping", "change_id", "changes", "change_id"), ForeignKey("mapping", "deployment_id", "deployments", "deployment_id")]
    return find_orphans(tables, keys, {"mapping": ["change_id", "deployment_id"]})


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    both = F.col("record")[0].isNotNull() & F.col("record")[1].isNotNull()
    return mapping_orphans(spark, d).filter(both).select(F.col("record")[0].alias("change_id"), F.col("record")[1].alias("deployment_id"), "ref_field").distinct()


_P2_REFS = """
m AS (SELECT DISTINCT nullif(lower(regexp_replace(change_id, '^\\s+|\\s+$', '', 'g')), '') AS change_id,
             nullif(lower(regexp_replace(deployment_id, '^\\s+|\\s+$', '', 'g')), '') AS deployment_id, mapped_at FROM mapping),
c AS (SELECT lower(trim(change_id)) AS id, lower(trim(visibility)) = 'deleted' AS gone, available_at FROM changes),
x AS (SELECT DISTINCT lower(trim(deployment_id)) AS id, deleted_at, recorded_at FROM deployments),
r AS (SELECT m.*, 'change_id' AS ref_field, 'changes' AS ref_table FROM m LEFT JOIN c ON c.id = m.change_id
      WHERE m.change_id IS NOT NULL AND (c.id IS NULL OR c.gone OR coalesce(c.available_at > m.mapped_at, false))
      UNION ALL
      SELECT m.*, 'deployment_id', 'deployments' FROM m LEFT JOIN x ON x.id = m.deployment_id
      WHERE m.deployment_id IS NOT NULL AND (x.id IS NULL OR coalesce(x.deleted_at <= m.mapped_at, false) OR coalesce(x.recorded_at > m.mapped_at, false)))
"""
P2_FOUND_SQL = f"WITH {_P2_REFS} SELECT DISTINCT change_id, deployment_id, ref_field FROM r WHERE change_id IS NOT NULL AND deployment_id IS NOT NULL"


def p2_report(spark: SparkSession, d: str) -> DataFrame:
    return orphan_report(mapping_orphans(spark, d))


P2_REPORT_SQL = f"WITH {_P2_REFS} SELECT ref_table, strftime(mapped_at, '%Y-%m') AS month, count(*)::BIGINT AS n_direct, 0::BIGINT AS n_inherited FROM r GROUP BY 1, 2"

def p2_cascade(spark: SparkSession, d: str) -> DataFrame:
    """Orphaned references of every table, per referencing and referenced table
    and month: a prediction needs the features of its change, and these the
    change, so that predictions inherit from features of absent changes."""
    t = {name: table(spark, d, name) for name in ("changes", "deployments", "mapping", "features", "predictions", "edits", "documents", "label_sheet")}
    tables = {
        "changes": Table(t["changes"], deleted=id_key(F.col("visibility")) == "deleted", available_at=F.col("available_at")),
        "deployments": Table(t["deployments"], deleted_at=F.col("deleted_at"), available_at=F.col("recorded_at")),
        "mapping": Table(t["mapping"], time=F.col("mapped_at")),
        "documents": Table(t["documents"], time=F.col("created_at")),
        **{name: Table(t[name]) for name in ("features", "predictions", "edits", "label_sheet")},
    }
    identity = {
        "mapping": ["change_id", "deployment_id"], "features": ["change_id"], "predictions": ["change_id", "variant_id", "seed", "run_id"],
        "edits": ["change_id", "op", "line_order"], "documents": ["doc_id"], "label_sheet": ["sheet_no", "change_id"],
    }
    keys = [ForeignKey("mapping", "change_id", "changes", "change_id"), ForeignKey("mapping", "deployment_id", "deployments", "deployment_id"), ForeignKey("predictions", "change_id", "features", "change_id")]
    keys += [ForeignKey(child, "change_id", "changes", "change_id") for child in ("features", "edits", "documents", "label_sheet")]
    found = find_orphans(tables, keys, identity)
    return found.groupBy("table", "ref_table", F.date_format("time", "yyyy-MM").alias("month")).agg(F.count_if(F.col("kind") == "direct").alias("n_direct"), F.count_if(F.col("kind") == "inherited").alias("n_inherited"))


_KEY = r"nullif(lower(regexp_replace({}::VARCHAR, '^\s+|\s+$', '', 'g')), '')"


def _refs_sql(child: str, column: str, parent: str, time: str, identity: str, late: str) -> str:
    ids = ", ".join(_KEY.format(c) for c in identity.split())
    ref, own = _KEY.format(column), _KEY.format("change_id")
    return f"""SELECT DISTINCT '{child}' AS tbl, '{parent}' AS ref_table, row({ids})::VARCHAR AS rec, {own} AS own, {ref} AS ref_key, {time} AS written,
  NOT EXISTS (FROM parents p WHERE p.tbl = '{parent}' AND p.k = {ref} AND NOT p.gone {late}) AS bad FROM {child} WHERE {ref} IS NOT NULL"""


_LATE = "AND NOT coalesce(p.gone_at <= {0}, false) AND NOT coalesce(p.since > {0}, false)"
_NO_TIME = "NULL::TIMESTAMP"
P2_CASCADE_SQL = f"""
WITH RECURSIVE parents AS (
  SELECT 'changes' AS tbl, {_KEY.format("change_id")} AS k, lower(trim(visibility)) = 'deleted' AS gone, {_NO_TIME} AS gone_at, available_at AS since FROM changes
  UNION ALL SELECT 'deployments', {_KEY.format("deployment_id")}, false, deleted_at, recorded_at FROM deployments
  UNION ALL SELECT 'features', {_KEY.format("change_id")}, false, NULL, NULL FROM features),
refs AS ({" UNION ALL ".join([
    _refs_sql("mapping", "change_id", "changes", "mapped_at", "change_id deployment_id", _LATE.format("mapping.mapped_at")),
    _refs_sql("mapping", "deployment_id", "deployments", "mapped_at", "change_id deployment_id", _LATE.format("mapping.mapped_at")),
    _refs_sql("predictions", "change_id", "features", _NO_TIME, "change_id variant_id seed run_id", ""),
    _refs_sql("features", "change_id", "changes", _NO_TIME, "change_id", ""),
    _refs_sql("edits", "change_id", "changes", _NO_TIME, "change_id op line_order", ""),
    _refs_sql("documents", "change_id", "changes", "created_at", "doc_id", _LATE.format("documents.created_at")),
    _refs_sql("label_sheet", "change_id", "changes", _NO_TIME, "sheet_no change_id", ""),
])}),
o(tbl, ref_table, rec, own, ref_key, written, inherited) AS (
  SELECT tbl, ref_table, rec, own, ref_key, written, 0 FROM refs WHERE bad
  UNION SELECT r.tbl, r.ref_table, r.rec, r.own, r.ref_key, r.written, 1 FROM o JOIN refs r ON r.ref_table = o.tbl AND r.ref_key = o.own WHERE NOT r.bad)
SELECT tbl AS "table", ref_table, strftime(written, '%Y-%m') AS month, (count(*) - sum(inherited))::BIGINT AS n_direct, sum(inherited)::BIGINT AS n_inherited FROM o GROUP BY 1, 2, 3
"""

QUERIES = {"p1_found": p1_found, "p1_filled": p1_filled, "p1_language": p1_language, "p2_found": p2_found, "p2_report": p2_report, "p2_cascade": p2_cascade}
ORACLES = {"p1_found": P1_FOUND_SQL, "p1_language": P1_LANGUAGE_SQL, "p2_found": P2_FOUND_SQL, "p2_report": P2_REPORT_SQL, "p2_cascade": P2_CASCADE_SQL}
