"""Token ids of whole texts by a byte-level BPE vocabulary.

Speculate and verify: greedy longest match proposes the tokens of a word; the
proposal is the BPE result exactly if every pair of neighbours is compatible,
that is, if BPE on the bytes of the two tokens gives back the two.  Pairs are
tested a batch at a time with array operations on the merge tables; only words
with a failing pair are merged step by step.
"""

from __future__ import annotations

import base64
import heapq
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.durable import spread

#: Folder of the public vocabulary files.
TOKENIZERS = os.environ.get("MILLRACE_TOKENIZERS", "/opt/tokenizers")

#: The pattern that cuts text into words before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Distinct words that a worker remembers before it starts afresh.
WORDS_KEPT = 400_000
#: Words longer than this many bytes aren't remembered.
LONG_WORD = 64
SHIFT = 20


class ByteBpe:
    """Tables of a vocabulary whose ids rise with the rank of their merge.

    ranks: bytes of each token by id (single bytes have the smallest ids).
    """

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.longest = max(map(len, ranks), default=1)
        n = max(ranks.values(), default=-1) + 1
        left, right = np.arange(n), np.arange(n)
        pairs: dict[tuple[int, int], int] = {}
        for token, i in ranks.items():
            if len(token) > 1:
                a, b = self._parts(token, i)
                left[i], right[i] = a, b
                pairs[a, b] = i
        self.left, self.right = left, right
        self.pairs = pairs
        keys = np.fromiter(((a << SHIFT) | b for a, b in pairs), np.int64, len(pairs))
        made = np.fromiter(pairs.values(), np.int64, len(pairs))
        order = np.argsort(keys)
        self.pair_keys, self.pair_made = keys[order], made[order]
        #: Lengths of tokens by their first two bytes, long ones first.
        by: dict[bytes, set[int]] = {}
        for token in ranks:
            by.setdefault(token[:2], set()).add(len(token))
        self.lengths = {k: sorted(v, reverse=True) for k, v in by.items()}
        self.word = regex.compile(PATTERN)
        self.known: dict[str, tuple[int, ...]] = {}
        self.compatible: dict[int, bool] = {}

    @classmethod
    def from_tiktoken(cls, text: bytes) -> ByteBpe:
        return cls({base64.b64decode(a): int(b) for a, b in (line.split() for line in text.splitlines() if line)})

    def _parts(self, token: bytes, i: int) -> tuple[int, int]:
        """The two tokens whose merge makes token: what is left of its bytes
        after all merges of lower rank."""
        ids = self._merge([self.ranks[token[k : k + 1]] for k in range(len(token))], token, i)
        if len(ids) != 2:
            raise ValueError(f"token {i} is not a merge of two tokens of lower rank")
        return ids[0], ids[1]

    def _merge(self, ids: list[int], word: bytes, below: int | None = None) -> list[int]:
        """Merge the lowest-ranked pair, the leftmost of equals, until none is
        left (of rank under below)."""
        ends = list(range(1, len(word) + 1))
        starts = [0, *ends[:-1]]
        rank = self.ranks.get
        joined = [rank(word[starts[k] : ends[k + 1]]) for k in range(len(ids) - 1)]
        while joined:
            best, at = None, -1
            for k, r in enumerate(joined):
                if r is not None and (best is None or r < best):
                    best, at = r, k
            if best is None or (below is not None and best >= below):
                break
            ids[at : at + 2] = [best]
            ends[at : at + 2] = [ends[at + 1]]
            del starts[at + 1]
            del joined[at]
            if at < len(joined):
                joined[at] = rank(word[starts[at] : ends[at + 1]])
            if at > 0:
                joined[at - 1] = rank(word[starts[at - 1] : ends[at]])
        return ids

    def exact(self, word: bytes) -> list[int]:
        """BPE of one word.  Long words are merged with a heap over a linked
        list, so that their cost stays near linear."""
        if len(word) <= LONG_WORD:
            return self._merge([self.ranks[word[k : k + 1]] for k in range(len(word))], word)
        ids = [self.ranks[word[k : k + 1]] for k in range(len(word))]
        nxt, prv = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1))
        get = self.pairs.get
        heap = [(m, k, ids[k], ids[k + 1]) for k in range(len(ids) - 1) if (m := get((ids[k], ids[k + 1]))) is not None]
        heapq.heapify(heap)
        end = len(ids)
        while heap:
            m, k, a, b = heapq.heappop(heap)
            j = nxt[k]
            if ids[k] != a or j >= end or ids[j] != b:
                continue
            ids[k], ids[j] = m, -1
            nxt[k] = nxt[j]
            if nxt[j] < end:
                prv[nxt[j]] = k
            for p in (prv[k], k):
                if p >= 0 and nxt[p] < end and (m2 := get((ids[p], ids[nxt[p]]))) is not None:
                    heapq.heappush(heap, (m2, p, ids[p], ids[nxt[p]]))
        out, k = [], 0
        while k < end:
            out.append(ids[k])
            k = nxt[k]
        return out

    def propose(self, word: bytes) -> list[int]:
        """Greedy longest match from the left."""
        out, at, n, ranks, lengths = [], 0, len(word), self.ranks, self.lengths
        while at < n:
            for size in lengths.get(word[at : at + 2], (1,)):
                if size <= n - at and (i := ranks.get(word[at : at + size])) is not None:
                    out.append(i)
                    at += size
                    break
            else:
                out.append(ranks[word[at : at + 1]])
                at += 1
        return out

    def verify(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """Whether each pair of tokens is compatible.

        BPE keeps the border between two tokens unless some merge across it
        comes before the merge that closed the border from either side.  The
        border is undone one merge at a time, the later one first: at each step
        the tokens that then met must not form a pair of a rank lower than the
        merges already undone.
        """
        ok = np.ones(len(first), bool)
        live = np.arange(len(first))
        a, b = first.astype(np.int64), second.astype(np.int64)
        limit = np.full(len(first), np.iinfo(np.int64).max)
        while live.size:
            key = (a << SHIFT) | b
            at = np.searchsorted(self.pair_keys, key)
            at[at == len(self.pair_keys)] = 0
            hit = self.pair_keys[at] == key if len(self.pair_keys) else np.zeros(live.size, bool)
            bad = hit & (self.pair_made[at] < limit) if len(self.pair_keys) else hit
            ok[live[bad]] = False
            take_a = a > b  # the later merge; of equal ones the right one, which was made second
            can_a, can_b = self.left[a] != a, self.left[b] != b
            use_a = (take_a & can_a) | (~can_b & can_a)
            use_b = ~use_a & can_b
            # a merge on the left with rank r precedes pairs of rank >= r; one on the right, made after its left neighbours of equal rank, those > r
            limit = np.where(use_a, a, np.where(use_b, b + 1, limit))
            a = np.where(use_a, self.right[a], a)
            b = np.where(use_b, self.left[b], b)
            go = ~bad & (use_a | use_b)
            live, a, b, limit = live[go], a[go], b[go], limit[go]
        return ok

    def learn(self, words: list[str]) -> None:
        """Ids of new words into known."""
        split: list[tuple[str, bytes, list[int]]] = []
        unseen: set[int] = set()
        for w in words:
            raw = w.encode("utf-8", "surrogatepass")
            if (i := self.ranks.get(raw)) is not None:
                self.known[w] = (i,)
                continue
            ids = self.propose(raw)
            split.append((w, raw, ids))
            for x, y in zip(ids, ids[1:], strict=False):
                k = (x << SHIFT) | y
                if k not in self.compatible:
                    unseen.add(k)
        if unseen:
            keys = np.fromiter(unseen, np.int64, len(unseen))
            fine = self.verify(keys >> SHIFT, keys & ((1 << SHIFT) - 1))
            if len(self.compatible) > 4 * WORDS_KEPT:
                self.compatible.clear()
                for _, _, ids in split:  # pairs just cleared
                    pair = np.array([(x << SHIFT) | y for x, y in zip(ids, ids[1:], strict=False)], np.int64)
                    self.compatible.update(zip(pair.tolist(), self.verify(pair >> SHIFT, pair & ((1 << SHIFT) - 1)).tolist(), strict=True))
            self.compatible.update(zip(keys.tolist(), fine.tolist(), strict=True))
        good = self.compatible
        for w, raw, ids in split:
            for x, y in zip(ids, ids[1:], strict=False):
                if not good[(x << SHIFT) | y]:
                    ids = self.exact(raw)
                    break
            self.known[w] = tuple(ids)

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Offsets and ids of the texts; null and empty texts have no ids."""
        cut = [self.word.findall(t) if t else [] for t in texts]
        if len(self.known) > WORDS_KEPT:
            self.known.clear()
        fresh = {w for ws in cut for w in ws if w not in self.known}
        if fresh:
            self.learn(list(fresh))
        known = self.known
        ids: list[int] = []
        ends = [0]
        for ws in cut:
            for w in ws:
                ids += known[w]
            ends.append(len(ids))
        for w in fresh:
            if len(w) > LONG_WORD:
                del known[w]
        return np.array(ends, np.int64), np.array(ids, np.int32)


def load(path: str) -> ByteBpe:
    with open(path, "rb") as f:
        return ByteBpe.from_tiktoken(f.read())


_LOADED: dict[int, ByteBpe] = {}


def encoder(raw: bytes) -> ByteBpe:
    """The tables of a vocabulary, made once a worker."""
    key = hash(raw)
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = ByteBpe.from_tiktoken(raw)
    return _LOADED[key]


#: Characters of text that are encoded together.
CHUNK = 4_000_000


def encode_text(df: DataFrame, text: str, ids: str = "ids", vocabulary: str = "byte_bpe_50k", folder: str | None = None, count_only: bool = False) -> DataFrame:
    """df without its text column and with ids: the token ids of the text, as
    an array of integers (count_only: their number as a bigint).

    Every text is encoded whole and without special tokens; their strings in a
    text are ordinary text.  Null and empty texts give an empty array (0).  A
    column already called like the result is replaced.  The vocabulary file is
    read on the driver and broadcast (under 1 MB, fixed), so executors need no
    copy.  Rows are moved only
    where a small table would leave cores idle.
    """
    spark = df.sparkSession
    with open(os.path.join(folder or TOKENIZERS, f"{vocabulary}.tiktoken"), "rb") as f:
        raw = spark.sparkContext.broadcast(f.read())
    keep = [c for c in df.columns if c.lower() not in (text.lower(), ids.lower())]
    kind = "bigint" if count_only else "array<int>"
    schema = df.select(*keep, F.lit(None).cast(kind).alias(ids)).schema
    arrow_kind = pa.int64() if count_only else pa.list_(pa.int32())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(raw.value)
        for whole in batches:
            start = 0
            texts = whole.column(whole.schema.get_field_index("__text"))
            sizes = [0 if v is None else v for v in pc.binary_length(texts).to_pylist()]
            while start < whole.num_rows:  # few texts at a time where they are long
                end, size = start, 0
                while end < whole.num_rows and (end == start or size + sizes[end] <= CHUNK):
                    size += sizes[end]
                    end += 1
                part = whole.slice(start, end - start)
                ends, flat = bpe.encode(texts.slice(start, end - start).to_pylist())
                got = pa.array(np.diff(ends)) if count_only else pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat))
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in range(len(keep))), got.cast(arrow_kind)], names=[*keep, ids])
                start = end

    return spread(df.select(*keep, F.col(text).cast("string").alias("__text"))).mapInArrow(run, schema)

