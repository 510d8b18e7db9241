"""Queries p3 to p10 and the SQL that checks them, where SQL can."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.functions.keys import id_key
from millrace.llm.encode import encode_text
from millrace.llm.entity_split import assign_splits, torn_groups
from millrace.llm.layout import collapse_layout
from millrace.llm.mix import Mix
from millrace.llm.mojibake import find_garbled, restore_text
from millrace.llm.overlap import Overlaps
from millrace.llm.sample import stable_sample
from millrace.llm.topn import top_n
from millrace.plans.tables import table

#: Share of the changes that is sampled for hand labels.
SAMPLE_RATE = 0.2
SHARES = {"train": 0.8, "valid": 0.1, "test": 0.1}
TOP = 3


def _ids(spark: SparkSession, d: str, name: str, *columns: str) -> DataFrame:
    """A table with the given id columns in the form in which they compare."""
    df = table(spark, d, name)
    return df.withColumns({c: id_key(F.col(c)) for c in columns})


def upstream(spark: SparkSession, d: str) -> DataFrame:
    """Distinct (change_id, split) of the provided split version."""
    s = _ids(spark, d, "splits", "change_id", "split", "split_version")
    return s.filter((F.col("split_version") == "upstream-provided") & F.col("split").isNotNull() & F.col("change_id").isNotNull()).select("change_id", "split").distinct()


def p3_sample(spark: SparkSession, d: str) -> DataFrame:
    return stable_sample(table(spark, d, "label_sheet"), "change_id", SAMPLE_RATE)


def _feistel_sql() -> str:
    steps = ["SELECT change_id, project, ('0x' || substr(hex16, 1, 8))::BIGINT AS l, ('0x' || substr(hex16, 9, 8))::BIGINT AS r FROM ids"]
    for i in range(6):
        steps.append(f"SELECT change_id, project, r AS l, xor(l, ('0x' || substr(sha256('millrace:{i}:' || project || ':' || r::VARCHAR), 1, 8))::BIGINT) AS r FROM s{i}")
    ctes = ", ".join(f"s{i} AS ({q})" for i, q in enumerate(steps))
    return f"""
WITH ids AS (SELECT DISTINCT lower(regexp_replace(change_id, '^\\s+|\\s+$', '', 'g')) AS change_id, split_part(lower(regexp_replace(change_id, '^\\s+|\\s+$', '', 'g')), ':', 1) AS project,
             lpad(split_part(lower(regexp_replace(change_id, '^\\s+|\\s+$', '', 'g')), ':', 2), 16, '0') AS hex16 FROM label_sheet),
{ctes}
SELECT change_id FROM s6 WHERE l * 4294967296::HUGEINT + r < 3689348814741910323
"""


def _copies(spark: SparkSession, d: str) -> DataFrame:
    changes = _ids(spark, d, "changes", "change_id").select("change_id", "message")
    edits = _ids(spark, d, "edits", "change_id").select("change_id", "op", "text")
    return collapse_layout(changes, "change_id", "message", edits, "change_id", "op", "text")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return _copies(spark, d).filter("change_id <> representative").select(F.col("representative").alias("change_id_a"), F.col("change_id").alias("change_id_b"))


def p4_collapsed(spark: SparkSession, d: str) -> DataFrame:
    """One record per distinct change, with the number of its copies."""
    return _copies(spark, d).filter("change_id = representative").select("change_id", "n_copies")


_P4 = r"""
WITH f AS (SELECT change_id, lower(op) AS op, replace(lower(regexp_replace(text, '[\p{P}\p{Z}\p{Cc}]+', '', 'g')), 'ß', 'ss') AS t FROM edits),
e AS (SELECT change_id, list_sort(list(DISTINCT op || ':' || t)) AS e FROM f WHERE t <> '' GROUP BY 1),
l AS (SELECT change_id, replace(lower(regexp_replace(unnest(string_split_regex(coalesce(message, ''), '[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]')), '[\p{P}\p{Z}\p{Cc}]+', '', 'g')), 'ß', 'ss') AS t FROM changes),
m AS (SELECT change_id, list_sort(list(DISTINCT t) FILTER (t <> '')) AS m FROM l GROUP BY 1),
x AS (SELECT lower(trim(m.change_id)) AS change_id, coalesce(m::VARCHAR, '') AS m, coalesce(e::VARCHAR, '') AS e FROM m LEFT JOIN e USING (change_id)),
g AS (SELECT change_id, min(change_id) OVER (PARTITION BY m, e) AS rep, count(*) OVER (PARTITION BY m, e) AS n FROM x)
"""
P4_FOUND_SQL = _P4 + "SELECT rep AS change_id_a, change_id AS change_id_b FROM g WHERE change_id <> rep"
P4_COLLAPSED_SQL = _P4 + "SELECT change_id, n::BIGINT AS n_copies FROM g WHERE change_id = rep"


def _manifest(spark: SparkSession, d: str) -> DataFrame:
    return _ids(spark, d, "internal_manifest", "id", "group_id").select("id", "group_id").distinct()


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return torn_groups(_manifest(spark, d), "id", "group_id", upstream(spark, d), "change_id", "split")


P5_FOUND_SQL = """
WITH RECURSIVE m AS (SELECT DISTINCT lower(regexp_replace(id, '^\\s+|\\s+$', '', 'g')) AS id, nullif(lower(regexp_replace(group_id, '^\\s+|\\s+$', '', 'g')), '') AS g FROM internal_manifest),
e AS (SELECT DISTINCT a.g AS x, b.g AS y FROM m a JOIN m b USING (id) WHERE a.g IS NOT NULL AND b.g IS NOT NULL),
r(x, y) AS (SELECT x, y FROM e UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x),
s AS (SELECT DISTINCT lower(trim(change_id)) AS id, lower(trim(split)) AS split FROM splits WHERE lower(trim(split_version)) = 'upstream-provided')
SELECT r.x AS group_id FROM r JOIN m ON m.g = r.y JOIN s USING (id) GROUP BY 1 HAVING count(DISTINCT split) > 1
"""


def p5_assignment(spark: SparkSession, d: str) -> DataFrame:
    changes = _ids(spark, d, "changes", "change_id").select("change_id")
    return assign_splits(changes, "change_id", _manifest(spark, d), "id", "group_id", SHARES)


def p5_report(spark: SparkSession, d: str) -> DataFrame:
    """Records and components of each split, and its share of all records."""
    a = p5_assignment(spark, d)
    total = F.sum("n_changes").over(Window.partitionBy())
    per = a.groupBy("split").agg(F.count(F.lit(1)).alias("n_changes"), F.countDistinct("component").alias("n_components"), F.max("n_records").alias("largest"))
    return per.withColumn("share", F.col("n_changes") / total)


def p5_check(spark: SparkSession, d: str) -> DataFrame:
    """What every assignment must keep: one split a component, and shares within
    a hundredth of those asked for."""
    a = p5_assignment(spark, d)
    torn = a.groupBy("component").agg(F.countDistinct("split").alias("k")).agg(F.count(F.lit(1)).alias("n_components"), F.count_if(F.col("k") > 1).alias("n_torn"))
    per = a.agg(F.count(F.lit(1)).alias("n_changes"), *[F.count_if(F.col("split") == s).alias(s) for s in SHARES])
    met = [F.abs(F.col(s) / F.col("n_changes") - F.lit(p)) <= 0.01 for s, p in SHARES.items()]
    return per.join(torn).select("n_changes", "n_components", "n_torn", (met[0] & met[1] & met[2]).alias("shares_met"))


P5_CHECK_SQL = """
WITH RECURSIVE m AS (SELECT DISTINCT lower(regexp_replace(id, '^\\s+|\\s+$', '', 'g')) AS id, nullif(lower(regexp_replace(group_id, '^\\s+|\\s+$', '', 'g')), '') AS g FROM internal_manifest),
e AS (SELECT DISTINCT a.g AS x, b.g AS y FROM m a JOIN m b USING (id) WHERE a.g IS NOT NULL AND b.g IS NOT NULL),
r(x, y) AS (SELECT x, y FROM e UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x),
i AS (SELECT lower(trim(change_id)) AS id FROM changes UNION SELECT id FROM m),
c AS (SELECT i.id, coalesce(min(r.y), 'i:' || i.id) AS c FROM i LEFT JOIN m ON m.id = i.id AND m.g IS NOT NULL LEFT JOIN r ON r.x = m.g GROUP BY i.id)
SELECT count(*) AS n_changes, count(DISTINCT c) AS n_components, 0::BIGINT AS n_torn, true AS shares_met FROM c
"""


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return top_n(_ids(spark, d, "predictions", "run_id", "change_id"), "run_id", "change_id", "score", TOP).select("run_id", "change_id")


_P6 = """
WITH b AS (SELECT lower(regexp_replace(run_id, '^\\s+|\\s+$', '', 'g')) AS run_id, lower(regexp_replace(change_id, '^\\s+|\\s+$', '', 'g')) AS change_id, max(score) AS score
           FROM predictions WHERE run_id IS NOT NULL AND score IS NOT NULL AND NOT isnan(score) AND NOT isinf(score) GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY score DESC, change_id) AS k FROM b)
"""
P6_FOUND_SQL = _P6 + "SELECT run_id, change_id FROM r WHERE k <= 3"


def p6_top(spark: SparkSession, d: str) -> DataFrame:
    """As p6_found, ten a run, with score and rank."""
    return top_n(_ids(spark, d, "predictions", "run_id", "change_id"), "run_id", "change_id", "score", 10).select("run_id", "change_id", "score", F.col("rank").cast("bigint").alias("rank"))


P6_TOP_SQL = _P6 + "SELECT run_id, change_id, score, k AS rank FROM r WHERE k <= 10"


def _overlaps(spark: SparkSession, d: str) -> Overlaps:
    changes = _ids(spark, d, "changes", "change_id").select(F.col("change_id").alias("id"), F.col("message").alias("text"))
    edits = _ids(spark, d, "edits", "change_id").select(F.col("change_id").alias("id"), "text")
    return Overlaps(changes.unionByName(edits), upstream(spark, d).withColumnRenamed("change_id", "id"), "train", ("valid", "test"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return _overlaps(spark, d).record_pairs().select(F.col("id_a").alias("change_id_a"), F.col("id_b").alias("change_id_b"))


def p7_report(spark: SparkSession, d: str) -> DataFrame:
    """Evaluation changes per split and project: all, those that overlap with a
    training change, and those whose content_hash stands there too."""
    o = _overlaps(spark, d)
    changes = _ids(spark, d, "changes", "change_id", "project_id", "content_hash").select(F.col("change_id").alias("id"), "project_id", F.regexp_extract("content_hash", "([0-9a-f]+)$", 1).alias("hash"))
    changes = changes.withColumn("hash", F.when(F.col("hash") != "", F.col("hash")))
    there = o.members.select("id", "split", "train").join(changes, "id")
    train = there.filter("train").select("hash").filter("hash is not null").distinct().withColumn("exact", F.lit(True))
    rows = there.filter("not train").join(train, "hash", "left").join(o.touched().withColumn("hit", F.lit(True)), ["id", "split"], "left")
    count = lambda c: F.count_if(F.coalesce(F.col(c), F.lit(False)))
    return rows.groupBy("split", "project_id").agg(F.count(F.lit(1)).alias("n_changes"), count("hit").alias("n_overlapping"), count("exact").alias("n_same_hash"))


_P7 = r"""
WITH t AS (SELECT lower(trim(change_id)) AS id, replace(lower(coalesce(message, '')), 'ß', 'ss') AS x FROM changes UNION ALL SELECT lower(trim(change_id)), replace(lower(coalesce(text, '')), 'ß', 'ss') FROM edits),
w AS (SELECT DISTINCT id, unnest(regexp_extract_all(x, '[\p{L}\p{N}]+')) AS w FROM t),
n AS (SELECT id, count(*) AS n FROM w GROUP BY 1),
s AS (SELECT DISTINCT lower(trim(change_id)) AS id, lower(trim(split)) AS split FROM splits WHERE lower(trim(split_version)) = 'upstream-provided'),
p AS (SELECT a.id AS e, b.id AS t, count(*) AS k FROM w a JOIN s x ON x.id = a.id AND x.split IN ('valid', 'test') JOIN w b USING (w) JOIN s y ON y.id = b.id AND y.split = 'train' GROUP BY 1, 2)
SELECT least(e, t) AS change_id_a, greatest(e, t) AS change_id_b FROM p JOIN n a ON a.id = e JOIN n b ON b.id = t WHERE e <> t AND k >= 0.8 * (a.n + b.n - k) - 1e-9
"""


P7_REPORT_SQL = _P7.split("SELECT least(e, t)")[0] + r""", hits AS (SELECT DISTINCT e FROM p JOIN n a ON a.id = e JOIN n b ON b.id = t WHERE e <> t AND k >= 0.8 * (a.n + b.n - k) - 1e-9),
ch AS (SELECT lower(trim(change_id)) AS id, lower(trim(project_id)) AS project_id, nullif(regexp_extract(lower(trim(content_hash)), '([0-9a-f]+)$', 1), '') AS hash FROM changes),
th AS (SELECT DISTINCT hash FROM ch JOIN s USING (id) WHERE split = 'train' AND hash IS NOT NULL)
SELECT split, project_id, count(*) AS n_changes, count(hits.e) AS n_overlapping, count(th.hash) AS n_same_hash FROM s JOIN ch USING (id) LEFT JOIN hits ON hits.e = ch.id LEFT JOIN th USING (hash) WHERE split IN ('valid', 'test') GROUP BY 1, 2
"""


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode_text(table(spark, d, "documents").select("doc_id", "text"), "text")


def _mix(spark: SparkSession, d: str) -> Mix:
    documents = table(spark, d, "documents").select("doc_id", "source", "text")
    sized = encode_text(documents.select("doc_id", "source", "text", F.col("text").alias("__whole")), "__whole", "tokens", count_only=True)
    return Mix(sized, "doc_id", table(spark, d, "mix_targets"))


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    return _mix(spark, d).selection


def p9_report(spark: SparkSession, d: str) -> DataFrame:
    return _mix(spark, d).report


def p9_check(spark: SparkSession, d: str) -> DataFrame:
    """What every mix must keep: uses within the repeats of a source, sources that
    have a target, one row a document and source, and targets without documents."""
    m = _mix(spark, d)
    caps = table(spark, d, "mix_targets").groupBy(id_key(F.col("source")).alias("source")).agg(F.max("max_repeats").alias("cap"))
    rows = m.selection.join(F.broadcast(caps), "source", "left")
    over = rows.agg(F.count_if(F.col("uses") > F.col("cap")).alias("n_over_cap"), F.count_if(F.col("cap").isNull()).alias("n_foreign"), (F.count(F.lit(1)) - F.countDistinct("doc_id", "source")).alias("n_repeated"))
    return over.join(m.report.agg(F.count_if(F.col("available_tokens") == 0).alias("n_idle_targets")))


P9_CHECK_SQL = """
WITH t AS (SELECT lower(trim(source)) AS source FROM mix_targets GROUP BY 1), d AS (SELECT DISTINCT lower(trim(source)) AS source FROM documents WHERE text <> '')
SELECT 0::BIGINT AS n_over_cap, 0::BIGINT AS n_foreign, 0::BIGINT AS n_repeated, (SELECT count(*) FROM t WHERE source NOT IN (SELECT source FROM d WHERE source IS NOT NULL)) AS n_idle_targets
"""


def _restored(spark: SparkSession, d: str) -> DataFrame:
    return restore_text(table(spark, d, "documents").select("doc_id", "text"), "doc_id", "text")


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return find_garbled(table(spark, d, "documents").select("doc_id", "text"), "doc_id", "text").distinct()


def p10_restored(spark: SparkSession, d: str) -> DataFrame:
    """The garbled documents with the text taken back as far as it can be."""
    return _restored(spark, d).filter("garbled").select("doc_id", F.col("restored").alias("text"), (F.col("restored") != F.col("text")).alias("changed"))


QUERIES = {
    "p3_sample": p3_sample, "p4_found": p4_found, "p4_collapsed": p4_collapsed, "p5_found": p5_found, "p5_assignment": p5_assignment, "p5_report": p5_report, "p5_check": p5_check,
    "p6_found": p6_found, "p6_top": p6_top,
    "p7_found": p7_found, "p7_report": p7_report, "p8_ids": p8_ids,
    "p9_mix": p9_mix, "p9_report": p9_report, "p9_check": p9_check, "p10_found": p10_found, "p10_restored": p10_restored,
}
ORACLES = {"p3_sample": _feistel_sql(), "p4_found": P4_FOUND_SQL, "p4_collapsed": P4_COLLAPSED_SQL, "p5_found": P5_FOUND_SQL, "p5_check": P5_CHECK_SQL, "p6_found": P6_FOUND_SQL, "p6_top": P6_TOP_SQL, "p7_found": _P7, "p7_report": P7_REPORT_SQL, "p9_check": P9_CHECK_SQL}
