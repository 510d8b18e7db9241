"""Same or nearly same records across splits.

An exact set-similarity join between the records of two sides.  Words are
ordered from rare to frequent; two sets of Jaccard similarity t or more share
a word among the first s - ceil(t s) + 1 of each, so only these prefixes are
joined, under filters of length, position and a bit signature, all of which
lose no pair.  Survivors are verified on the whole sets.  Records of equal sets
form a class and are joined as one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.durable import cut
from millrace.llm.layout import fold

#: Fixed value: the longest runs of letters and digits.
WORD = r"[\p{L}\p{N}]+"
#: Word counts are kept per bucket of word hashes, on a scale of STEPS to a power
#: of two: a table of fixed size (2 MB) that orders words, whatever the
#: vocabulary.  Sharing a bucket or a step only shifts a word in the order.
BUCKETS, STEPS = 1 << 20, 4
#: A record with more rows of text than this has its words gathered through a
#: distinct first, so that no task holds all its text.
WIDE = 100_000
#: Candidate sets of at most so many rows (16 bytes each) are broadcast.
SMALL = 200_000


def word_sets(texts: DataFrame) -> DataFrame:
    """(id, words) from (id, text): the sorted distinct 64-bit hashes of the
    words of all texts of an id, letter case ignored.  Null texts have none."""
    t = texts.select("id", F.coalesce("text", F.lit("")).alias("text"))
    found = lambda x: F.regexp_extract_all(fold(x), F.lit(WORD), F.lit(0))
    hashed = lambda ws: F.array_sort(F.transform(F.array_distinct(ws), lambda w: F.xxhash64(w)))
    wide = cut(t.groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > WIDE).select("id"))
    few = t if wide.isEmpty() else t.join(wide, "id", "left_anti")
    sets = few.groupBy("id").agg(hashed(found(F.array_join(F.collect_list("text"), "\n"))).alias("words"))
    if wide.isEmpty():
        return sets
    lots = t.join(wide, "id", "left_semi").select("id", F.explode(F.transform(F.array_distinct(found(F.col("text"))), lambda w: F.xxhash64(w))).alias("w")).distinct()
    return sets.unionByName(lots.groupBy("id").agg(F.array_sort(F.collect_set("w")).alias("words")))


def _flat(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    at = lists.offsets.to_numpy()
    return lists.values.to_numpy(zero_copy_only=False)[at[0] : at[-1]], (at - at[0]).astype(np.int64)


def _side_counts(sets: DataFrame) -> np.ndarray:
    """How frequent the words of each bucket are on either side, 0 for none."""
    words = sets.select("train", F.explode("words").alias("w")).groupBy(F.col("w").bitwiseAND(BUCKETS - 1).cast("int").alias("bucket"))
    step = lambda n: F.when(n > 0, 1 + F.floor(STEPS * F.log2(n))).otherwise(0).cast("short")
    got = words.agg(step(F.count_if(~F.col("train"))).alias("e"), step(F.count_if("train")).alias("t")).toArrow()
    counts = np.zeros((2, BUCKETS), np.uint8)
    for side, c in enumerate(("e", "t")):
        counts[side, got["bucket"].to_numpy()] = got[c].to_numpy()
    return counts


def prefixes(words: np.ndarray, at: np.ndarray, train: np.ndarray, counts: np.ndarray, t: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(record, position, word) of the prefix words that the other side has."""
    size = np.diff(at)
    rec = np.repeat(np.arange(len(size)), size)
    bucket = words & (BUCKETS - 1)
    mine = counts[:, bucket]
    order = np.lexsort((words, np.maximum(mine[0], mine[1]), rec))
    pos = np.arange(len(words)) - np.repeat(at[:-1], size)
    keep = pos < (size - np.ceil(t * size - 1e-9).astype(np.int64) + 1)[rec]
    other = np.where(train[rec], mine[0][order], mine[1][order])
    keep &= other > 0
    return rec[keep], pos[keep], words[order][keep]


def signatures(words: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits per record: bit h mod 128 of every word hash h."""
    bit = (words >> 20) & 127
    out = []
    for half in (0, 1):
        ones = np.where(bit >> 6 == half, np.left_shift(np.uint64(1), (bit & 63).astype(np.uint64)), np.uint64(0))
        sig = np.zeros(len(at) - 1, np.uint64)
        full = np.flatnonzero(np.diff(at) > 0)
        if full.size:
            sig[full] = np.bitwise_or.reduceat(ones, at[:-1][full])
        out.append(sig.view(np.int64))
    return out[0], out[1]


PREFIX = "word bigint, x bigint, y bigint, size int, pos int, s0 bigint, s1 bigint"


def overlap_classes(sets: DataFrame, t: float) -> DataFrame:
    """Distinct (ex, ey, tx, ty): digests of a word set of the evaluation side
    and another of the training side with a similarity of t or more.

    sets: (x, y, words, train), one row a record, x and y the digest of words.
    Records of one side with equal sets are taken once, before their prefixes
    are made, so the join by words stays one that AQE can split where a word is
    frequent.
    """
    if not 0 < t <= 1:
        raise ValueError("t must lie in (0, 1]")
    spark = sets.sparkSession
    counts = spark.sparkContext.broadcast(_side_counts(sets))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words, at = _flat(b.column(2))
            train = b.column(3).to_numpy(zero_copy_only=False).astype(bool)
            rec, pos, word = prefixes(words, at, train, counts.value, t)
            s0, s1 = signatures(words, at)
            if rec.size:
                x, y = (b.column(k).to_numpy() for k in (0, 1))
                size = np.diff(at).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(v) for v in (word, x[rec], y[rec], size[rec], pos.astype(np.int32), s0[rec], s1[rec])], names=["word", "x", "y", "size", "pos", "s0", "s1"])

    classes = sets.filter(F.size("words") > 0).select("x", "y", "words", "train").dropDuplicates(["x", "y", "train"])
    side = lambda train, p: classes.filter(F.col("train") == train).mapInArrow(run, PREFIX).select("word", *[F.col(c).alias(f"{p}{c}") for c in ("x", "y", "size", "pos", "s0", "s1")])
    e, r = side(False, "e"), side(True, "t")
    both = F.col("esize") + F.col("tsize")
    need = F.ceil(F.lit(t / (1 + t)) * both - F.lit(1e-9))
    other = (F.col("ex") != F.col("tx")) | (F.col("ey") != F.col("ty"))
    length = (F.col("esize") >= F.lit(t) * F.col("tsize") - F.lit(1e-9)) & (F.col("tsize") >= F.lit(t) * F.col("esize") - F.lit(1e-9))
    # at the first common word of a pair, what is left of either set bounds what is common
    place = F.least(F.col("esize") - F.col("epos"), F.col("tsize") - F.col("tpos")) >= need
    differ = F.bit_count(F.col("es0").bitwiseXOR(F.col("ts0"))) + F.bit_count(F.col("es1").bitwiseXOR(F.col("ts1")))
    pairs = e.join(r, "word").filter(other & length & place & (differ <= both - 2 * need)).select("ex", "ey", "tx", "ty").distinct()
    pairs = cut(pairs)

    ends = pairs.select(F.col("ex").alias("x"), F.col("ey").alias("y")).union(pairs.select("tx", "ty")).distinct()
    if pairs.count() <= SMALL // 2:
        ends = F.broadcast(ends)
    whole = cut(sets.select("x", "y", "words").join(ends, ["x", "y"], "left_semi").groupBy("x", "y").agg(F.first("words").alias("words")))
    of = lambda p: whole.select(F.col("x").alias(f"{p}x"), F.col("y").alias(f"{p}y"), F.col("words").alias(f"{p}w"))
    checked = pairs.join(of("e"), ["ex", "ey"]).join(of("t"), ["tx", "ty"])
    common = F.size(F.array_intersect("ew", "tw"))
    union = F.size("ew") + F.size("tw") - common
    return checked.filter(common >= F.lit(t) * union - F.lit(1e-9)).select("ex", "ey", "tx", "ty")


class Overlaps:
    """Overlaps between the training records and the others.

    texts: (id, text), any number of rows an id; sides: (id, split), distinct;
    train: name of the training split, evaluation: names of the others.  Splits
    of any other name don't take part.  An id in both sides takes part in both
    and isn't paired with itself.  Ids without words all have the empty set,
    are equal to each other and like no other.  Two different words are taken
    for one only if their 64-bit hashes agree.
    """

    def __init__(self, texts: DataFrame, sides: DataFrame, train: str, evaluation: tuple[str, ...], t: float = 0.8):
        wanted = sides.filter(F.col("split").isin(train, *evaluation)).select("id", "split").distinct()
        w = F.col("words")
        sets = word_sets(texts).join(wanted, "id")
        sets = sets.select("id", "split", (F.col("split") == train).alias("train"), F.xxhash64(F.lit(0), w).alias("x"), F.xxhash64(F.lit(1), w).alias("y"), "words")
        self.sets = cut(sets)
        self.pairs = cut(overlap_classes(self.sets, t))
        self.members = self.sets.select("id", "split", "train", "x", "y")
        self.t = t

    def class_pairs(self) -> DataFrame:
        """(ex, ey, tx, ty) of overlapping classes, equal ones included."""
        both = self.members.groupBy("x", "y").agg(F.max("train").alias("t"), F.min("train").alias("e")).filter("t and not e").select("x", "y")
        return self.pairs.union(both.select("x", "y", "x", "y"))

    def record_pairs(self) -> DataFrame:
        """(id_a, id_b), id_a < id_b, of every overlap of a training record and
        another.  Its size is that of the result, so it is made last."""
        e = self.members.filter("not train").select(F.col("x").alias("ex"), F.col("y").alias("ey"), F.col("id").alias("e"))
        r = self.members.filter("train").select(F.col("x").alias("tx"), F.col("y").alias("ty"), F.col("id").alias("t"))
        pairs = self.class_pairs().join(e, ["ex", "ey"]).join(r, ["tx", "ty"]).filter("e <> t")
        return pairs.select(F.least("e", "t").alias("id_a"), F.greatest("e", "t").alias("id_b")).distinct()

    def touched(self) -> DataFrame:
        """(id, split) of every evaluation record with an overlap."""
        hit = self.class_pairs().select(F.col("ex").alias("x"), F.col("ey").alias("y")).distinct()
        return self.members.filter("not train").join(hit, ["x", "y"], "left_semi").select("id", "split")

