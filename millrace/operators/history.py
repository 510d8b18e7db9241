"""Features of a change from what came before it.

History goes by the sequence of the changes, not by their time stamps: each
feature sees the state before its own change.  Running sums are taken in slices
of the sequence, so neither a file nor an author that holds a large part of all
rows makes a task of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.durable import cut
from millrace.operators.prefix import SLICE_ROWS, running_before, sequence_slice


def history_features(commits: DataFrame, files: DataFrame, slice_rows: int = SLICE_ROWS, block: int = 1000, few: int = 1000) -> DataFrame:
    """(commit, ns, nd, nf, la, ld, entropy, lt, ndev, age, nuc, exp, rexp, sexp).

    commits: commit, seq, dev, at (seconds); files: commit, file, subsystem,
    dir, added, deleted, one row per file of a commit (several are added up).
    Commits without files have no row and are no history.

    ns, nd, nf: subsystems, directories, files.  la, ld: lines.  entropy: in
    bits over the files' changed lines.  lt: mean of the files' lines so far,
    negative if more went than came.  ndev: distinct earlier authors of any of
    the files.  age: days since each file's last change, files without one
    counting 0, over all files.  nuc: earlier changes of the files, summed.
    exp, rexp, sexp: the author's earlier commits; those weighted by 1 / (age in
    years + 1), a commit dated exactly a year later counting 0; those in each of the commit's subsystems, summed.
    """
    f = files.groupBy("commit", "file").agg(F.max("subsystem").alias("subsystem"), F.max("dir").alias("dir"), F.sum(F.coalesce("added", F.lit(0))).cast("double").alias("a"), F.sum(F.coalesce("deleted", F.lit(0))).cast("double").alias("d"))
    own_slice = sequence_slice(commits, "seq", slice_rows)
    part = None if own_slice is None else "slice"
    rows = cut(f.join(commits.select("commit", "seq", "dev", "at", F.lit(0).alias("slice") if own_slice is None else own_slice.alias("slice")), "commit"))
    first = rows.groupBy("file", "dev").agg(F.min("seq").alias("seq")).withColumn("new", F.lit(True))
    rows = rows.join(first, ["file", "dev", "seq"], "left")
    rows = cut(running_before(rows, ["file"], "seq", part, {"loc": F.col("a") - F.col("d"), "uses": F.lit(1), "devs": F.when(F.col("new"), 1).otherwise(0)}, {"last_at": F.col("at")}))
    churn = F.col("a") + F.col("d")
    total, logs = F.sum(churn), F.sum(F.when(churn > 0, churn * F.log2(churn)))
    own = rows.groupBy("commit").agg(
        F.countDistinct("subsystem").alias("ns"), F.countDistinct("dir").alias("nd"), F.count(F.lit(1)).alias("nf"), F.sum("a").alias("la"), F.sum("d").alias("ld"),
        F.coalesce(F.log2(F.nullif(total, F.lit(0.0))) - logs / total, F.lit(0.0)).alias("entropy"), F.avg("loc").alias("lt"), (F.sum(F.coalesce((F.col("at") - F.col("last_at")) / 86400.0, F.lit(0.0))) / F.count(F.lit(1))).alias("age"), F.sum("uses").alias("nuc"),
    )
    counted = rows.select("commit", "seq", "dev", "at", "slice").distinct()
    dev = running_before(counted, ["dev"], "seq", part, {"exp": F.lit(1)})
    subs = rows.select("commit", "seq", "dev", "subsystem", "slice").distinct()
    sexp = running_before(subs, ["dev", "subsystem"], "seq", part, {"n": F.lit(1)}).groupBy("commit").agg(F.sum("n").alias("sexp"))
    dev = cut(dev.select("commit", "seq", "dev", "at", "exp"))
    out = own.join(_earlier_authors(rows, first, few), "commit").join(dev.select("commit", "exp"), "commit").join(_recent(dev, block), "commit").join(sexp, "commit")
    return out.select("commit", "ns", "nd", "nf", "la", "ld", "entropy", "lt", "ndev", "age", "nuc", "exp", "rexp", "sexp")


def _earlier_authors(rows: DataFrame, first: DataFrame, few: int) -> DataFrame:
    """(commit, ndev): the earlier authors of a commit's files.

    Where no file has more than few, all are listed and counted.  Otherwise those
    of the file with most of them are only counted, as the running number of
    first touches; those of the other files are looked up there, and count if
    they aren't among them.
    """
    anchor = rows.groupBy("commit").agg(F.max(F.struct("devs", "file")).alias("m"), F.count(F.lit(1)).alias("k")).select("commit", F.col("m.devs").alias("devs"), F.col("m.file").alias("anchor"), "k")
    by_file = first.select("file", F.col("dev").alias("by"), F.col("seq").alias("since"))
    listed = rows.join(anchor.filter((F.col("k") > 1) & (F.col("devs") <= few)).select("commit"), "commit").select("commit", "seq", "file")
    listed = listed.join(by_file, "file").filter("since < seq").groupBy("commit").agg(F.countDistinct("by").alias("all"))
    others = rows.join(anchor.filter((F.col("k") > 1) & (F.col("devs") > few)).select("commit", "anchor"), "commit").filter((F.col("file") != F.col("anchor")) & (F.col("devs") > 0)).select("commit", "seq", "file", "anchor")
    theirs = others.join(by_file, "file").filter("since < seq").select("commit", "seq", "anchor", "by").distinct()
    there = first.select(F.col("file").alias("anchor"), F.col("dev").alias("by"), F.col("seq").alias("since"))
    more = theirs.join(there, ["anchor", "by"], "left").filter("since is null or since >= seq").groupBy("commit").agg(F.count(F.lit(1)).alias("more"))
    return anchor.join(more, "commit", "left").join(listed, "commit", "left").select("commit", F.coalesce("all", F.col("devs") + F.coalesce("more", F.lit(0))).cast("bigint").alias("ndev"))


def _recent(dev: DataFrame, block: int) -> DataFrame:
    """(commit, rexp).  The commits of an author are cut into blocks, and every
    block meets itself and the earlier ones one by one, so that no row holds
    more than a block and the pairs of a busy author are spread over tasks."""
    blocks = dev.withColumn("b", F.floor(F.col("exp") / F.lit(block))).groupBy("dev", "b").agg(F.array_sort(F.collect_list(F.struct("seq", "at", "commit"))).alias("x"))
    blocks = cut(blocks)
    earlier = blocks.select("dev", F.col("b").alias("eb"), F.col("x.at").alias("times"))
    now = blocks.select("dev", "b", F.col("x.at").alias("at"), F.col("x.commit").alias("commit"))
    kind = dev.schema["commit"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, sums = [], []
            same = batch.column("same").to_pylist()
            for k, own in enumerate(same):
                at, times = (np.asarray(batch.column(c)[k].values.to_numpy(zero_copy_only=False), np.float64) for c in ("at", "times"))
                total = np.zeros(len(at))
                for i in range(0, len(at), 256):
                    years = (at[i : i + 256, None] - times[None, :]) / 86400.0 / 365.0 + 1.0
                    with np.errstate(divide="ignore", invalid="ignore"):
                        part = np.where((years == 0) | np.isnan(years), 0.0, 1.0 / years)
                    if own:
                        part = np.where(np.arange(len(times))[None, :] < np.arange(i, i + len(part))[:, None], part, 0.0)
                    total[i : i + 256] = part.sum(1)
                ids.append(batch.column("commit")[k].values)
                sums.append(total)
            if ids:
                yield pa.RecordBatch.from_arrays([pa.concat_arrays(ids), pa.array(np.concatenate(sums))], names=["commit", "rexp"])

    pairs = now.join(earlier, "dev").filter("eb <= b").select("commit", "at", "times", (F.col("eb") == F.col("b")).alias("same"))
    shape = T.StructType([T.StructField("commit", kind), T.StructField("rexp", T.DoubleType())])
    return pairs.mapInArrow(run, shape).groupBy("commit").agg(F.sum("rexp").alias("rexp"))
