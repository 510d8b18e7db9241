"""Nearest records of each class, over dense vectors or character n-grams."""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.durable import cut, spread
from millrace.functions.keys import salted_digest
from millrace.functions.ngrams import Vocabulary, count_ngrams


#: Queries and items of a block.
QUERY_BLOCK, ITEM_BLOCK = 256, 4096
PACK = ("id", "label", "content", "tie", "at", "index", "value")


def _packed(rows: DataFrame, block: int, least: int) -> DataFrame:
    """Rows (id, label, content, tie, index, value: a sparse vector) in blocks of
    about so many, each one row of arrays; at makes its vectors' ends."""
    n = max(least, -(-rows.count() // block))
    cells = F.struct(*[c for c in PACK if c != "at"])
    packs = rows.withColumn("b", F.pmod(F.xxhash64("id", F.lit("block")), F.lit(n))).groupBy("b").agg(F.collect_list(cells).alias("x"))
    return packs.select(
        "b", *[F.col(f"x.{c}").alias(c) for c in ("id", "label", "content", "tie")], F.transform("x.index", lambda v: F.size(v)).alias("at"), F.flatten("x.index").alias("index"), F.flatten("x.value").alias("value"),
    )


def _best_of_blocks(queries: DataFrame, items: DataFrame, k: int, kind: T.DataType, label_kind: T.DataType) -> DataFrame:
    """(query, label, item, similarity, tie): the k best items of each class for
    every query in every pair of a block of queries and one of items.  A pair is
    one row; it is a product of vectors, done over Arrow batches."""
    cores = queries.sparkSession.sparkContext.defaultParallelism
    q, i = _packed(queries, QUERY_BLOCK, 1), _packed(items, ITEM_BLOCK, cores)
    n = max(1, -(-queries.count() // QUERY_BLOCK))
    left = cut(q.select(*[F.col(c).alias(f"q_{c}") for c in ("b", *PACK)]))
    pairs = i.withColumn("q_b", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint")))).join(left, "q_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                row = {c: b.column(c)[r].values for c in b.schema.names if c not in ("b", "q_b")}
                out = _meet(row, k)
                if out[0]:
                    rows = [row["q_id"].take(pa.array(out[0])), row["label"].take(pa.array(out[1])), row["id"].take(pa.array(out[1])), pa.array(out[2]), row["tie"].take(pa.array(out[1]))]
                    yield pa.RecordBatch.from_arrays(rows, names=["query", "label", "item", "similarity", "tie"])

    shape = T.StructType([T.StructField("query", kind), T.StructField("label", label_kind), T.StructField("item", kind), T.StructField("similarity", T.DoubleType()), T.StructField("tie", T.StringType())])
    return pairs.mapInArrow(run, shape)


def _meet(row: dict[str, pa.Array], k: int) -> tuple[list[int], list[int], list[float]]:
    """Positions of queries and of their best items in a pair of blocks."""
    sizes, index, value = (row[c].to_numpy(zero_copy_only=False) for c in ("at", "index", "value"))
    ends = np.cumsum(sizes)
    starts = ends - sizes
    q_sizes, q_index, q_value = (row[f"q_{c}"].to_numpy(zero_copy_only=False) for c in ("at", "index", "value"))
    q_ends = np.cumsum(q_sizes)
    width = int(max(index.max(initial=-1), q_index.max(initial=-1))) + 1
    labels = row["label"].to_pylist()
    classes = [np.array([n for n, y in enumerate(labels) if y == c]) for c in dict.fromkeys(labels) if c is not None]
    ids, contents, ties = row["id"].to_pylist(), row["content"].to_pylist(), np.array(row["tie"].to_pylist())
    out: tuple[list[int], list[int], list[float]] = ([], [], [])
    full = np.flatnonzero(sizes)
    for n, (qid, qcontent) in enumerate(zip(row["q_id"].to_pylist(), row["q_content"].to_pylist(), strict=True)):
        at = slice(q_ends[n] - q_sizes[n], q_ends[n])
        dense = np.zeros(width)
        dense[q_index[at]] = q_value[at]
        near = np.zeros(len(ids))
        if full.size:
            near[full] = np.add.reduceat(dense[index] * value, starts[full])
        near = np.round(near, 6) + 0.0
        barred = np.fromiter((x == qid or (qcontent is not None and c == qcontent) for x, c in zip(ids, contents, strict=True)), bool, len(ids))
        for members in classes:
            m = members[~barred[members]]
            if len(m) > k:
                m = m[near[m] >= np.partition(near[m], len(m) - k)[len(m) - k]]
            m = m[np.lexsort((ties[m], -near[m]))[:k]]
            out[0].extend([n] * len(m))
            out[1].extend(m.tolist())
            out[2].extend(near[m].tolist())
    return out


def neighbours_by_class(queries: DataFrame, items: DataFrame, k: int) -> DataFrame:
    """(query, label, item, similarity, rank): the k items of each class whose
    vectors are most like the query's, the query itself and items of equal
    content left out.

    Both tables are (id, label, content, tie, index, value): index and value make
    a sparse vector of length 1, so that similarity is the cosine, rounded to 6
    places; equal ones go by tie.  Null labels are no class, and null contents
    equal none.  Every query meets every item, in as many pairs of blocks as the
    tables ask for; only k a query, class and pair are merged.
    """
    best = _best_of_blocks(queries, items, k, items.schema["id"].dataType, items.schema["label"].dataType)
    order = Window.partitionBy("query", "label").orderBy(F.desc("similarity"), "tie")
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query", "label", "item", "similarity", "rank")


def class_neighbours(queries: DataFrame, items: DataFrame, identity: str, vector: str, label: str, k: int, salt: str) -> DataFrame:
    """neighbours_by_class over dense vectors; equal similarities go by SHA-256 of
    salt:item."""

    def rows(df: DataFrame) -> DataFrame:
        x = F.col(vector).cast("array<double>")
        norm = F.sqrt(F.aggregate(x, F.lit(0.0), lambda a, y: a + y * y))
        unit = F.transform(x, lambda y: y / F.coalesce(F.nullif(norm, F.lit(0.0)), F.lit(1.0)))
        steps = F.when(F.size(x) > 0, F.sequence(F.lit(0), F.size(x) - 1)).otherwise(F.array().cast("array<int>"))
        empty = F.array()
        return df.select(
            F.col(identity).alias("id"), F.col(label).alias("label"), F.lit(None).cast("string").alias("content"), salted_digest(salt, F.col(identity)).alias("tie"),
            F.coalesce(steps, empty.cast("array<int>")).alias("index"), F.coalesce(unit, empty.cast("array<double>")).alias("value"),
        )

    return neighbours_by_class(rows(queries), rows(items), k)


#: Queries that meet a text at once, and texts of a task.
ASKED, TASK_TEXTS = 4096, 32_768
#: Terms in more of the texts are multiplied as a dense matrix, at most so many.
COMMON, COMMON_MOST = 0.06, 6144
#: Products of sparse terms taken at once.
PRODUCTS = 1 << 18


def text_neighbours(queries: Column, df: DataFrame, identity: str, text: str, label: str, k: int, salt: str, fit: Column | None = None) -> DataFrame:
    """neighbours_by_class over character n-gram tf-idf (tfidf), for the rows of
    df where queries holds, against all; rows of the same text are left out as
    copies of the query.

    Only texts are moved: each task gets a block of queries and then a share of
    the texts, weighs both with the vocabulary and keeps the k best.  It holds the
    vectors of its queries and of one lot of texts.
    """
    terms, idf, common = _vocabulary(df, text, fit)
    spark = df.sparkSession
    rows = df.select(F.col(identity).alias("id"), F.col(label).alias("label"), F.col(text).cast("string").alias("text"), F.coalesce(queries, F.lit(False)).alias("asks"))
    n, asked = rows.agg(F.count(F.lit(1)), F.count_if("asks")).first()
    cores = spark.sparkContext.defaultParallelism
    blocks, shares = max(1, -(-asked // ASKED)), cores * max(1, -(-n // (TASK_TEXTS * cores)))
    pick = lambda m: F.pmod(F.xxhash64("id", F.lit("block")), F.lit(m)).cast("int")
    every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    cells = ["id", "label", "text", F.coalesce(F.col("id").cast("string"), F.lit("")).alias("key")]
    sides = rows.filter("asks").select(*cells, F.lit(True).alias("asks"), pick(blocks).alias("block"), every(shares).alias("share"))
    sides = sides.union(rows.select(*cells, F.lit(False).alias("asks"), every(blocks).alias("block"), pick(shares).alias("share")))
    met = sides.repartitionById(blocks * shares, F.col("block") * shares + F.col("share")).sortWithinPartitions(F.desc("asks")).drop("block", "share")
    known = spark.sparkContext.broadcast((terms, idf, common))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, weights, often = known.value
        vocabulary, meeting, first = Vocabulary(names, LOW, HIGH), None, []
        for b in batches:
            asks = b.column("asks")
            first.append(b.filter(asks))
            items = b.filter(pc.invert(asks))
            if items.num_rows:
                meeting = meeting or _Meeting(pa.Table.from_batches(first), vocabulary, weights, often, k, salt)
                first.clear()
                meeting.take(items)
        if meeting and meeting.best is not None:
            yield from meeting.best.select(["query", "label", "item", "similarity"]).combine_chunks().to_batches()

    fields = [("query", rows.schema["id"].dataType), ("label", rows.schema["label"].dataType), ("item", rows.schema["id"].dataType), ("similarity", T.DoubleType())]
    best = met.mapInArrow(run, T.StructType([T.StructField(*f) for f in fields]))
    order = Window.partitionBy("query", "label").orderBy(F.desc("similarity"), salted_digest(salt, F.col("item")))
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


class _Meeting:
    """A block of queries and the k best items of each class so far.

    Similarities are first taken in single precision, the common terms as a
    product of matrices; those that could be among the k best are then summed
    again in double precision.
    """

    def __init__(self, queries: pa.Table, vocabulary: Vocabulary, idf: np.ndarray, often: np.ndarray, k: int, salt: str):
        self.vocabulary, self.idf, self.k, self.salt, self.best = vocabulary, idf, k, salt, None
        self.ids, self.n = queries["id"].combine_chunks(), queries.num_rows
        self.same: dict[object, list[int]] = defaultdict(list)
        for q, (i, t) in enumerate(zip(self.ids.to_pylist(), queries["text"].to_pylist(), strict=True)):
            self.same[0, i].append(q)
            if t is not None:
                self.same[1, t].append(q)
        lots = [*self._weighed(queries["text"].to_pylist())]
        sizes, index, value = (np.concatenate([x[c] for x in lots]) if lots else np.zeros(0, int) for c in range(3))
        ends = np.cumsum(sizes)
        self.vectors = [(index[a:z], value[a:z]) for a, z in zip(ends - sizes, ends, strict=True)]
        self.longest = int(sizes.max(initial=0))
        top = np.argsort(-often, kind="stable")[:COMMON_MOST]
        top = top[often[top] > COMMON]
        self.column = np.full(len(idf), -1, np.int32)
        self.column[top] = np.arange(len(top))
        of, column = np.repeat(np.arange(self.n, dtype=np.int32), sizes), self.column[index]
        dense = column >= 0
        self.common = np.zeros((self.n, len(top)), np.float32)
        self.common[of[dense], column[dense]] = value[dense]
        order = np.argsort(index[~dense], kind="stable")
        self.rare, self.rare_value = of[~dense][order], value[~dense][order].astype(np.float32)
        self.rare_ends = np.cumsum(np.bincount(index[~dense], minlength=len(idf)))
        self.full, self.steps = np.zeros(len(idf)), np.arange(PRODUCTS + self.n)
        self.classes: dict[object, int] = {}
        self.least: list[np.ndarray] = []

    def _weighed(self, texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        for sizes, places, times in self.vocabulary.counts(texts):
            of, w = np.repeat(np.arange(len(sizes)), sizes), times * self.idf[places]
            yield sizes, places, w / np.sqrt(np.bincount(of, w * w, len(sizes)))[of]

    def take(self, items: pa.RecordBatch) -> None:
        at = 0
        for sizes, index, value in self._weighed(items.column("text").to_pylist()):
            self._lot(items.slice(at, len(sizes)), sizes, index, value)
            at += len(sizes)

    def _near(self, sizes: np.ndarray, index: np.ndarray, value: np.ndarray) -> np.ndarray:
        """Similarities of a lot's items (rows) to the queries, in single precision."""
        of, column = np.repeat(np.arange(len(sizes)), sizes), self.column[index]
        dense = column >= 0
        x = np.zeros((len(sizes), self.common.shape[1]), np.float32)
        x[of[dense], column[dense]] = value[dense]
        near = x @ self.common.T
        of, index, value = of[~dense], index[~dense], value[~dense].astype(np.float32)
        many = self.rare_ends[index] - np.where(index > 0, self.rare_ends[index - 1], 0)
        some = many > 0
        of, many, value, ends = of[some], many[some], value[some], self.rare_ends[index[some]]
        total = np.cumsum(many)
        cuts = np.unique(np.searchsorted(total, np.arange(0, total[-1] if len(total) else 0, PRODUCTS), "right")) if len(total) else []
        for a, z in zip(cuts, [*cuts[1:], len(total)], strict=True):
            m = many[a:z]
            flat = np.repeat(ends[a:z] - np.cumsum(m), m) + self.steps[: m.sum()]
            low, high = of[a], of[z - 1] + 1
            cell = np.repeat((of[a:z] - low) * self.n, m) + self.rare.take(flat)
            near[low:high] += np.bincount(cell, np.repeat(value[a:z], m) * self.rare_value.take(flat), (high - low) * self.n).reshape(-1, self.n)
        return near

    def _lot(self, items: pa.RecordBatch, sizes: np.ndarray, index: np.ndarray, value: np.ndarray) -> None:
        if not self.n:
            return
        near = self._near(sizes, index, value)
        for i, (x, t) in enumerate(zip(items.column("id").to_pylist(), items.column("text").to_pylist(), strict=True)):
            for q in (*self.same.get((0, x), ()), *(self.same.get((1, t), ()) if t is not None else ())):
                near[i, q] = -9
        # twice the largest error of a sum in single precision, and of two roundings to 6 places
        slack = 4 * (min(sizes.max(initial=0), self.longest) + 8) * 2.0**-24 + 2e-6
        members = defaultdict(list)
        for i, y in enumerate(items.column("label").to_pylist()):
            if y is not None:
                members[y].append(i)
        hits = []
        for y, own in members.items():
            c = self.classes.setdefault(y, len(self.classes))
            if c == len(self.least):
                self.least.append(np.full(self.n, -1.0))
            part, least = near[own], self.least[c]
            if len(own) > self.k and least.min() < 0:
                least = np.maximum(least, np.partition(part, len(own) - self.k, axis=0)[len(own) - self.k])
            i, q = np.nonzero((part >= least - slack) & (part > -5))
            hits.append((np.array(own)[i], q, np.full(len(i), c)))
        if not hits:
            return
        i, q, c = (np.concatenate(x) for x in zip(*hits, strict=True))
        order = np.argsort(i, kind="stable")
        i, q, c = i[order], q[order], c[order]
        if len(i):
            self._merge(items, i, q, c, self._exact(i, q, sizes, index, value))

    def _exact(self, items: np.ndarray, queries: np.ndarray, sizes: np.ndarray, index: np.ndarray, value: np.ndarray) -> np.ndarray:
        """Similarities of pairs, which are in the order of their items."""
        out, starts = np.zeros(len(items)), np.cumsum(sizes) - sizes
        cuts = np.flatnonzero(np.concatenate(([True], items[1:] != items[:-1], [True])))
        for a, z in zip(cuts[:-1], cuts[1:], strict=True):
            at = slice(starts[items[a]], starts[items[a]] + sizes[items[a]])
            self.full[index[at]] = value[at]
            for h in range(a, z):
                own, weights = self.vectors[queries[h]]
                out[h] = self.full[own] @ weights
            self.full[index[at]] = 0
        return np.round(out, 6) + 0.0

    def _merge(self, items: pa.RecordBatch, i: np.ndarray, q: np.ndarray, c: np.ndarray, similarity: np.ndarray) -> None:
        """The k best of each query and class among those so far and new pairs."""
        above = similarity >= np.array(self.least)[c, q]
        i, q, c, similarity = i[above], q[above], c[above], similarity[above]
        ties = [hashlib.sha256(f"{self.salt}:{x}".encode()).digest() for x in items.column("key").to_pylist()]
        take = pa.array(i)
        new = pa.table({
            "query": self.ids.take(pa.array(q)), "label": items.column("label").take(take), "item": items.column("id").take(take), "similarity": similarity,
            "tie": pa.array(ties, pa.binary(32)).take(take), "cell": c * self.n + q,
        })
        both = pa.concat_tables([self.best, new]).combine_chunks() if self.best is not None else new
        cell, near = both["cell"].to_numpy(), both["similarity"].to_numpy()
        tie = np.array(both["tie"].to_pylist(), "S32")
        order = np.lexsort((tie, -near, cell))
        cell = cell[order]
        starts = np.flatnonzero(np.concatenate((np.ones(min(len(cell), 1), bool), cell[1:] != cell[:-1])))
        at = np.arange(len(cell)) - np.repeat(starts, np.diff(starts, append=len(cell)))
        self.best = both.take(pa.array(order[at < self.k]))
        last = at == self.k - 1
        rows, columns = np.divmod(cell[last], self.n)
        for r in np.unique(rows):
            self.least[r][columns[rows == r]] = near[order[last]][rows == r]


#: Shortest and longest n-grams, texts that a term must be in, and terms kept.
LOW, HIGH, MIN_DF, MAX_FEATURES = 3, 5, 2, 50_000


def tfidf(df: DataFrame, identity: str, text: str, fit: Column | None = None, low: int = LOW, high: int = HIGH, min_df: int = MIN_DF, max_features: int = MAX_FEATURES) -> DataFrame:
    """(identity, term, weight): character n-gram tf-idf, rows of length 1.

    Vocabulary and document frequencies come from the rows where fit holds
    (all, if not given): terms in at least min_df rows, of those the
    max_features with most occurrences, equal ones by term.  idf is
    ln((1 + n) / (1 + df)) + 1.  Null texts and texts shorter than low have no
    terms.

    Rows are counted over Arrow batches.  Only counts per term are shuffled; the
    vocabulary, at most max_features terms, is chosen on the executors, then
    broadcast, and each row is weighed where it lies.
    """
    terms, idf, _ = _vocabulary(df, text, fit, low, high, min_df, max_features)
    rows = spread(df.select(F.col(identity).alias("id"), F.col(text).cast("string").alias("text")))
    known = df.sparkSession.sparkContext.broadcast((terms, idf))
    kind = T.StructType([T.StructField(identity, rows.schema["id"].dataType), T.StructField("term", T.StringType()), T.StructField("weight", T.DoubleType())])

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, weights = known.value
        vocabulary, spelled = Vocabulary(names, low, high), pa.array(names, pa.string())
        for b in batches:
            at = 0
            for sizes, places, times in vocabulary.counts(b.column(1).to_pylist()):
                of, w = np.repeat(np.arange(len(sizes)), sizes), times * weights[places]
                w = w / np.sqrt(np.bincount(of, w * w, len(sizes)))[of]
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at + of)), spelled.take(pa.array(places)), pa.array(w)], names=[identity, "term", "weight"])
                at += len(sizes)

    return rows.mapInArrow(weigh, kind)


def _vocabulary(df: DataFrame, text: str, fit: Column | None = None, low: int = LOW, high: int = HIGH, min_df: int = MIN_DF, max_features: int = MAX_FEATURES) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The terms of tfidf, their idf and the share of rows they are in.

    A histogram of the counts tells which terms can be among those kept; they are
    ordered on an executor, since ordering them for the driver would send it
    max_features terms from every task.
    """
    rows = df.filter(F.lit(True) if fit is None else fit).select(F.col(text).cast("string").alias("text"))
    n = rows.count()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for terms, having, times in count_ngrams(b.column(0).to_pylist(), low, high):
                yield pa.RecordBatch.from_arrays([terms, pa.array(having), pa.array(times)], names=["term", "df", "all"])

    counts = spread(rows).mapInArrow(count, "term string, df bigint, all bigint").groupBy("term").agg(F.sum("df").alias("df"), F.sum("all").alias("all"))
    counts = cut(counts.filter(F.col("df") >= min_df).withColumn("size", F.floor(F.log2("all") * 64)))
    least, above = -1, 0
    for r in sorted(counts.groupBy("size").count().collect(), reverse=True):
        least, above = r["size"], above + r["count"]
        if above >= max_features:
            break
    kept = cut(counts.filter(F.col("size") >= least).orderBy(F.desc("all"), "term").limit(max_features).select("term", "df")).toArrow()
    having = kept["df"].to_numpy().astype(float)
    return kept["term"].to_pylist(), np.log((1 + n) / (1 + having)) + 1, having / max(n, 1)
