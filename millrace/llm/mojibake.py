"""Text that was read in a wrong character encoding, found and restored.

A smoothed character trigram model is trained on the distinct clean words of the
whole corpus that hold a character beyond ASCII.  Every such word is taken back
through each chain of encodings under which it can be decoded, up to MAX_DEPTH
steps, and the likeliest reading wins if it beats the word as it stands by a
margin.

Which words are clean isn't known beforehand, so the model is trained in passes.
The first leaves out words that decode as UTF-8 and words with a reading that far
more documents hold.  Then every word is scored against its readings, its own
share of the counts left out, and enters the next pass with the probability that
it is clean; no word is barred for good.  The margin is validated on words held
out in the same way, against the same words garbled on purpose.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.durable import cut, spread

#: Encodings in which bytes are read (wrongly), those in which
#: text was written, and pairs of the two that occur beside UTF-8.
SINGLE = ("latin-1", "cp1252", "cp1250", "cp1251", "cp1254", "cp437", "cp850", "cp866", "mac_roman", "koi8_r", "iso8859_2", "iso8859_5", "iso8859_9", "iso8859_15")
MULTI = ("cp932", "gb18030", "cp949", "big5", "euc_jp")
ASIAN = ("cp932", "euc_jp", "cp949", "gb18030", "big5")
CYRILLIC = ("cp1251", "koi8_r", "cp866", "iso8859_5")
WESTERN = ("latin-1", "cp1252", "cp437", "cp850", "mac_roman")
OTHER_LATIN = ("cp1250", "iso8859_2", "cp1254", "iso8859_9")
MAX_DEPTH = 3

#: Parts of a document in which counts are kept, so that sums don't depend on
#: their order.
UNIT = 1024
#: Most entries of each level of the model (16 to 24 bytes each).  Beyond it the
#: rarest trigrams and pairs, less than one of which can tell two readings
#: apart, are left to the level below, as in any pruned model.
MODEL_SIZE = 2_000_000
#: Log odds before the word is seen, against its being garbled; how many times
#: more documents hold a reading that makes a word look garbled by itself, or
#: the reverse; the power with which the odds fall with the documents that hold a
#: word for each that holds its reading (a source may be garbled as a whole);
#: passes after the first.
PRIOR, FAR, WIDE, PASSES = 7.0, 10, 3.0, 2
#: Nats that every step of a chain after the first must bring, and at most by
#: how much rare chains must do better than the most frequent one.
STEP, SPREAD = 3.0, 4.0
#: Nats of a character with two characters before it, all ASCII: the same in
#: every reading, so that pure ASCII words need no counts.
ASCII_LOG = -3.0
#: Margins in nats that are tried, and the documents that must hold a word, more
#: than hold any reading of it, for it to be taken as clean there.
GRID, HELD_OUT = tuple(np.arange(7.0, 20.5, 0.5)), 3

GAP = r"[\t\n\x0B\f\r ]+"
WORD = re.compile(r"[^\t\n\x0b\x0c\r ]+")
RUN = re.compile(r"[^\x00-\x7f]+")
LOST = re.compile("[\ufffd\x80-\x9f]")
NOT_PLAIN = re.compile("[\x00-\x1f\x7f-\x9f\ufffd\ue000-\uf8ff]")
#: Words of one text that gain at least HINT nats by the same chain may hold it
#: together, if the sum is POOLED times the margin.
HINT, POOLED = 3.0, 1.5
#: Words remembered by a worker before it starts afresh; most bytes of preferred
#: readings that are sent to the workers.
KEPT, SWAP_BYTES = 300_000, 32 << 20


@lru_cache(None)
def _byte_of(codec: str) -> dict[int, int]:
    """Characters of a single-byte encoding by code point; bytes without a
    character stand for the control of the same number, as decoders leave them."""
    table = {}
    for b in range(256):
        try:
            c = bytes([b]).decode(codec)
        except UnicodeDecodeError:
            c = chr(b)
        table.setdefault(ord(c), b)
    for b in range(0x80, 0xA0):
        table.setdefault(b, b)
    return table


def to_bytes(s: str, codec: str) -> bytes | None:
    """The bytes that were read as s, or null if none give s."""
    if codec in MULTI:
        try:
            return s.encode(codec)
        except UnicodeEncodeError:
            return None
    try:
        return s.encode(codec)
    except UnicodeEncodeError:
        table = _byte_of(codec)
    try:
        return bytes([table[ord(c)] for c in s])
    except KeyError:
        return None


def _from_bytes(b: bytes, codec: str) -> str | None:
    try:
        return b.decode(codec)
    except UnicodeDecodeError:
        return None


def _plain(s: str) -> bool:
    """Neither controls nor lost or private characters."""
    return NOT_PLAIN.search(s) is None


def utf8_readings(token: str) -> dict[str, str]:
    """Readings of a token whose runs beyond ASCII were UTF-8, by the encoding
    in which they were read.  Runs that weren't stay as they are."""
    runs = [r for r in RUN.findall(token) if len(r) > 1]
    out: dict[str, str] = {}
    if not runs:
        return out
    for codec in SINGLE + MULTI:
        hit = False

        def back(m: re.Match, codec: str = codec) -> str:
            nonlocal hit
            run = m.group()
            if len(run) < 2:
                return run
            raw = to_bytes(run, codec)
            new = raw and _from_bytes(raw, "utf-8")
            if not new or "\ufffd" in new:
                return run
            hit = True
            return new

        new = RUN.sub(back, token)
        if hit and new not in out.values():
            out[f"{codec}>utf-8"] = new
    return out


def _pairs() -> list[tuple[str, str]]:
    pairs = [(r, w) for r in ("latin-1", "cp1252") for w in (*CYRILLIC, *OTHER_LATIN, *ASIAN, "cp437", "cp850", "mac_roman")]
    pairs += [(r, w) for r in CYRILLIC for w in CYRILLIC if r != w]
    pairs += [(r, w) for r in (*CYRILLIC, "cp437", "cp850", "mac_roman", *OTHER_LATIN) for w in ("latin-1", "cp1252") if r != w]
    pairs += [(r, w) for r in ("cp437", "cp850", "mac_roman") for w in OTHER_LATIN]
    pairs += [(r, w) for r in ("cp1250", "cp1254") for w in ("cp1254", "cp1250", *CYRILLIC, *ASIAN) if r != w]
    pairs += [(r, w) for r in ASIAN for w in ASIAN if r != w]
    return pairs


PAIRS = _pairs()


def byte_readings(token: str) -> dict[str, str]:
    """Readings of a token that was written in another encoding than UTF-8."""
    out: dict[str, str] = {}
    raws = {r: to_bytes(token, r) for r in {r for r, _ in PAIRS}}
    seen: dict[tuple[bytes, str], str | None] = {}
    for r, w in PAIRS:
        raw = raws[r]
        if raw is None:
            continue
        if (raw, w) not in seen:
            seen[raw, w] = _from_bytes(raw, w)
        new = seen[raw, w]
        if new is not None and new != token and _plain(new):
            out.setdefault(f"{r}>{w}", new)
    return out


def readings(token: str) -> dict[str, str]:
    """All other readings of a token, by chain, up to MAX_DEPTH steps: UTF-8 any
    number of times, another encoding only as the first writing (the last step)."""
    found: dict[str, str] = {}
    level = {"": token}
    for depth in range(MAX_DEPTH):
        new: dict[str, str] = {}
        for chain, s in level.items():
            for c, r in utf8_readings(s).items():
                if r != token and r not in new.values():
                    new[f"{chain} {c}".strip()] = r
            for c, r in byte_readings(s).items() if s is token or not s.isascii() else ():
                if r != token and r not in found.values():
                    found[f"{chain} {c}".strip()] = r
        found = {c: s for c, s in new.items()} | {c: s for c, s in found.items() if s not in new.values()}
        level = new
        if not level:
            break
    return {c: r for c, r in found.items() if _plain(r)}


def steps(chain: str) -> int:
    return chain.count(" ") + 1


def _bare(token: str, reading: str, chain: str) -> bool:
    """Whether a chain without UTF-8 rests on too little to hold by one word
    alone: the word has fewer than two letters either way, or, with an encoding
    of two bytes a character, its reading has none beyond ASCII in a row."""
    last = chain.rsplit(" ", 1)[-1]
    if last.endswith("utf-8"):
        return False
    if any(e in MULTI for e in last.split(">")):
        return max((sum(c.isalpha() for c in run) for run in RUN.findall(reading)), default=0) < 2
    return max(sum(map(str.isalpha, token)), sum(map(str.isalpha, reading))) < 2 or not any(c.isalpha() for s in (token, reading) for c in s if c > "\x7f")


def suspect(token: str, options: dict[str, str]) -> bool:
    """Whether the first pass must not learn a token: it has lost or control
    characters, or something in it decodes as UTF-8."""
    return LOST.search(token) is not None or any(c.endswith(">utf-8") for c in options)


def weight(n: np.ndarray) -> np.ndarray:
    """Weight of a word that n documents hold: one, and little more for many, so
    that the model grows with the vocabulary and not with repetition."""
    return np.where(n > 0, 1 + np.log(np.maximum(n, 1)), 0.0)


BITS = np.uint64(21)
MASK = np.uint64((1 << 21) - 1)


def trigrams(strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the trigrams of every string, padded, and where each string starts."""
    c = np.frombuffer("".join(f"  {s} " for s in strings).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    n = np.fromiter((len(s) + 1 for s in strings), np.int64, len(strings))
    starts = np.cumsum(n) - n
    keys = (c[:-2] << (BITS * np.uint64(2))) | (c[1:-1] << BITS) | c[2:]
    first = starts + 2 * np.arange(len(strings))  # two positions lie between strings
    keep = np.ones(len(keys), bool)
    keep[(first[1:, None] + np.array([-2, -1])).ravel()] = False
    return keys[keep], starts


class Counts:
    """Sums by sorted key."""

    def __init__(self, keys: np.ndarray, sums: np.ndarray, kinds: np.ndarray):
        order = np.argsort(keys)
        self.keys, self.sums, self.kinds = keys[order], sums[order].astype(np.float64) / UNIT, kinds[order].astype(np.float64)

    def __call__(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(self.keys):
            return np.zeros(len(keys)), np.zeros(len(keys))
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        hit = self.keys[at] == keys
        return np.where(hit, self.sums[at], 0.0), np.where(hit, self.kinds[at], 0.0)


class Model:
    """Log probability of words under interpolated character trigrams: each level
    gives the one below as many counts as it has seen kinds of successors."""

    def __init__(self, tri: Counts, pair: Counts, one: Counts, chains: dict[str, int]):
        self.tri, self.pair, self.one = tri, pair, one
        self.total = float(one.sums.sum())
        most = max(chains.values(), default=0) + UNIT
        self.dear = {c: min(SPREAD, float(np.log(most / (n + UNIT)))) for c, n in chains.items()}
        self.rare = min(SPREAD, float(np.log(most / UNIT)))
        self.known: dict[str, tuple[float, str, str, bool] | None] = {}
        self.complete = False

    def scores(self, strings: list[str], own: np.ndarray | None = None) -> np.ndarray:
        """Log probabilities; own: the share of each string itself in the counts,
        which is left out."""
        if not strings:
            return np.zeros(0)
        keys, starts = trigrams(strings)
        off = np.zeros(len(keys)) if own is None else np.repeat(own, np.diff(np.append(starts, len(keys))))
        ab, bx, b, x = keys >> BITS, keys & ((MASK << BITS) | MASK), (keys >> BITS) & MASK, keys & MASK
        c3 = np.maximum(self.tri(keys)[0] - off, 0)
        c2, t2 = self.pair(ab)
        cbx, _ = self.pair(bx)
        c1, t1 = self.one(b)
        cx, _ = self.one(x)
        p1 = (np.maximum(cx - off, 0) + 0.1) / (self.total + 0.1 * 1_114_112)
        p2 = (np.maximum(cbx - off, 0) + np.maximum(t1, 1) * p1) / (np.maximum(np.maximum(c1 - off, cbx - off), 0) + np.maximum(t1, 1))
        p3 = (np.minimum(c3, c2) + np.maximum(t2, 1) * p2) / (np.maximum(c2 - off, c3) + np.maximum(t2, 1))
        ascii_only = (keys & np.uint64((0x1FFF80 << 42) | (0x1FFF80 << 21) | 0x1FFF80)) == 0
        return np.add.reduceat(np.where(ascii_only, ASCII_LOG, np.log(p3)), starts)

    def cost(self, chain: str) -> float:
        return STEP * (steps(chain) - 1) + self.dear.get(chain, self.rare)

    def best(self, tokens: list[str], options: list[dict[str, str]], own: np.ndarray | None = None) -> list[tuple[float, str, str, bool] | None]:
        """For each token its likeliest other reading: log odds less the cost of
        the chain, reading, chain, and whether that rests on too little alone."""
        flat = [s for t, o in zip(tokens, options, strict=True) for s in (t, *o.values())]
        off = np.zeros(len(flat))
        sizes = np.fromiter((1 + len(o) for o in options), np.int64, len(options))
        first = np.cumsum(sizes) - sizes
        if own is not None and len(first):
            off[first] = own
        got = self.scores(flat, off)
        out: list[tuple[float, str, str, bool] | None] = []
        for t, o, at in zip(tokens, options, first, strict=True):
            if not o:
                out.append(None)
                continue
            gains = [float(got[at + 1 + k] - got[at]) - self.cost(c) for k, c in enumerate(o)]
            k = int(np.argmax(gains))
            chain = list(o)[k]
            out.append((gains[k], o[chain], chain, _bare(t, o[chain], chain)))
        return out

    def restore(self, texts: list[str | None], margin: float) -> tuple[list[bool], list[str | None]]:
        """Whether each text is garbled, and the text with every garbled token
        restored where it can be.

        A chain holds in a text if one token gains the margin by it, or several
        distinct tokens of at least HINT together gain POOLED margins.  Where a
        chain holds, all tokens that gain anything by it are restored."""
        words = [[w for w in WORD.findall(t) if not w.isascii()] if t and not t.isascii() else [] for t in texts]
        if len(self.known) > KEPT and not self.complete:
            self.known.clear()
        new = [] if self.complete else list({w for ws in words for w in ws if w not in self.known})
        for k in range(0, len(new), 2000):
            part = new[k : k + 2000]
            self.known.update((w, g if g and g[0] > 0 else None) for w, g in zip(part, self.best(part, [readings(w) for w in part]), strict=True))
        known = self.known
        found, out = [], []
        for t, ws in zip(texts, words, strict=True):
            some = {w: g for w in ws if (g := known.get(w)) is not None}
            held: set[str] = set()
            pooled: dict[str, list[float]] = {}
            for gain, _, chain, bare in some.values():
                if gain >= margin and not bare:
                    held.add(chain)
                if gain >= HINT:
                    pooled.setdefault(chain, []).append(gain)
            held |= {c for c, gains in pooled.items() if len(gains) > 1 and sum(gains) >= POOLED * margin}
            if held:
                swap = {w: g[1] for w, g in some.items() if g[2] in held}
                out.append(WORD.sub(lambda m, swap=swap: swap.get(m.group(), m.group()), t))
            else:
                out.append(t)
            found.append(bool(held) or (bool(ws) and LOST.search(t) is not None))
        return found, out


def word_table(texts: DataFrame, text: str) -> DataFrame:
    """(token, n, suspect, rival, chains, readings) of every distinct word with a
    character beyond ASCII: n documents hold it, rival documents the most
    frequent of its other readings."""
    words = F.filter(F.split(F.col(text), GAP), lambda w: w.rlike(r"[^\x00-\x7F]"))
    counts = texts.filter(F.col(text).rlike(r"[^\x00-\x7F]")).select(F.explode(F.array_distinct(words)).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            tokens = b.column(0).to_pylist()
            options = [readings(t) for t in tokens]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array([suspect(t, o) for t, o in zip(tokens, options, strict=True)], pa.bool_()), pa.array([list(o) for o in options], pa.list_(pa.string())), pa.array([list(o.values()) for o in options], pa.list_(pa.string()))],
                names=["token", "n", "suspect", "chains", "readings"],
            )

    table = cut(spread(counts).mapInArrow(run, "token string, n bigint, suspect boolean, chains array<string>, readings array<string>"))
    attested = table.select("token", F.explode("readings").alias("reading")).join(table.select(F.col("token").alias("reading"), F.col("n").alias("rival")), "reading")
    rivals = attested.groupBy("token").agg(F.max("rival").alias("rival"))
    return cut(table.join(rivals, "token", "left").withColumn("rival", F.coalesce("rival", F.lit(0))).withColumn("clean", F.when(F.col("suspect") | (F.col("rival") >= FAR * F.col("n")), 0.0).otherwise(1.0)))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(trigram, sum) of a table of (token, n, clean), summed by batch."""
    for b in batches:
        n, clean = b.column(1).to_numpy(), b.column(2).to_numpy()
        sums = np.rint(weight(n) * clean * UNIT).astype(np.int64)
        tokens = [t for t, s in zip(b.column(0).to_pylist(), sums, strict=True) if s > 0]
        if not tokens:
            continue
        keys, starts = trigrams(tokens)
        per = np.repeat(sums[sums > 0], np.diff(np.append(starts, len(keys))))
        kinds, at = np.unique(keys, return_inverse=True)
        total = np.zeros(len(kinds), np.int64)
        np.add.at(total, at, per)
        yield pa.RecordBatch.from_arrays([pa.array(kinds.astype(np.int64)), pa.array(total)], names=["key", "sum"])


def _pruned(level: DataFrame, size: int) -> DataFrame:
    """The level without its rarest keys, if it has more than size."""
    have = level.groupBy(F.floor(F.log2("sum")).alias("power")).agg(F.count(F.lit(1)).alias("k")).collect()
    kept, least = 0, 0
    for r in sorted(have, key=lambda r: -r["power"]):
        kept += r["k"]
        if kept > size:
            least = 2 ** (r["power"] + 1)
            break
    return level.filter(F.col("sum") >= least) if least else level


def train(words: DataFrame, size: int = MODEL_SIZE) -> Model:
    """The model of the words, each counted with its probability of being clean,
    and the costs of chains from the words that aren't."""
    table = cut(words.select("token", "n", "clean").mapInArrow(_count, "key bigint, sum bigint").groupBy("key").agg(F.sum("sum").alias("sum")))
    pairs = table.groupBy(F.shiftright("key", 21).alias("key")).agg(F.sum("sum").alias("sum"), F.count(F.lit(1)).alias("kinds"))
    last, first = F.struct(F.col("key").bitwiseAND(int(MASK)).alias("key"), "sum", F.lit(0).alias("kinds")), F.struct(F.shiftright("key", 21).alias("key"), F.lit(0).cast("bigint").alias("sum"), F.lit(1).alias("kinds"))
    ones = pairs.select(F.inline(F.array(last, first))).groupBy("key").agg(F.sum("sum").alias("sum"), F.sum("kinds").alias("kinds"))
    levels = [table.withColumn("kinds", F.lit(0).cast("bigint")), pairs, ones]
    if table.count() > size:
        levels[:2] = [_pruned(level, size) for level in levels[:2]]
    got = reduce(DataFrame.unionAll, [level.select("key", "sum", "kinds", F.lit(k).alias("level")) for k, level in enumerate(levels)]).toArrow()
    key, total, kinds, at = (got[c].to_numpy() for c in ("key", "sum", "kinds", "level"))
    out = [Counts(key[at == k].astype(np.uint64), total[at == k], kinds[at == k]) for k in range(3)]
    chains = {}
    if "chain" in words.columns:
        chains = {r["chain"]: r["n"] for r in words.filter("clean < 1").groupBy("chain").agg(F.sum(F.rint((1 - F.col("clean")) * UNIT)).cast("bigint").alias("n")).collect() if r["chain"]}
    return Model(*out, chains)

#: Chains by which tokens are garbled to validate the margin.
SPOIL = (("utf-8", "cp1252"), ("utf-8", "latin-1"), ("utf-8", "cp437"), ("utf-8", "mac_roman"), ("utf-8", "cp1251"), ("cp1251", "koi8_r"), ("koi8_r", "cp1251"), ("cp1251", "latin-1"), ("cp1250", "cp1252"), ("cp1254", "cp1252"), ("cp949", "latin-1"), ("cp932", "latin-1"))


def spoil(token: str, chain: tuple[str, str]) -> str | None:
    """A token written in one encoding and read in another, or null."""
    try:
        raw = token.encode(chain[0])
    except UnicodeEncodeError:
        return None
    back = {b: chr(c) for c, b in _byte_of(chain[1]).items()} if chain[1] not in MULTI else None
    new = "".join(back[x] for x in raw) if back else None
    return new if new != token else None


def judge(words: DataFrame, model: Model) -> DataFrame:
    """The words with their chance of being clean under the model, which leaves
    each out of its own counts, the chain of the likeliest other reading, its
    gain less what speaks against it in the numbers of documents (odds), and, for a
    word garbled on purpose, the gain of the word itself (null where the word can't
    be garbled, or isn't known to be clean).  Where too few letters speak, or far
    more documents hold the word than its reading, the numbers alone decide."""
    shared = words.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            tokens, n, clean = b.column("token").to_pylist(), b.column("n").to_numpy(), b.column("clean").to_numpy()
            options = [dict(zip(c, r, strict=True)) for c, r in zip(b.column("chains").to_pylist(), b.column("readings").to_pylist(), strict=True)]
            got = m.best(tokens, options, clean * weight(n))
            gains = np.array([g[0] if g else -np.inf for g in got])
            lost = np.array([LOST.search(t) is not None for t in tokens], bool)
            known = (n >= HELD_OUT) & (n > b.column("rival").to_numpy()) & ~lost
            bad = [spoil(t, SPOIL[sum(map(ord, t)) % len(SPOIL)]) if k else None for t, k in zip(tokens, known, strict=True)]
            at = [k for k, s in enumerate(bad) if s]
            back: list[float | None] = [None] * len(tokens)
            for k, g in zip(at, m.best([bad[k] for k in at], [readings(bad[k]) for k in at]), strict=True):
                back[k] = g[0] if g and g[1] == tokens[k] else -1e9
            few, rival = np.array([bool(g and g[3]) for g in got], bool), b.column("rival").to_numpy()
            odds = gains - WIDE * np.maximum(np.log(n / (rival + 1)), 0)
            odds = np.where((few & (rival < FAR * n)) | ((rival > 0) & (n >= FAR * rival)), -1e9, np.where(few, 1e9, np.maximum(odds, -1e9)))
            chance = 1 / (1 + np.exp(np.clip(odds - PRIOR, -50, 50)))
            chance = np.where(lost | (chance < 0.05), 0.0, chance)
            yield pa.RecordBatch.from_arrays(
                [b.column("token"), b.column("n"), b.column("rival"), b.column("chains"), b.column("readings"), pa.array(chance), pa.array([g[2] if g else None for g in got], pa.string()), pa.array(odds), pa.array(back, pa.float64())],
                names=["token", "n", "rival", "chains", "readings", "clean", "chain", "odds", "back"],
            )

    columns = words.select("token", "n", "rival", "chains", "readings", "clean")
    return cut(columns.mapInArrow(run, "token string, n bigint, rival bigint, chains array<string>, readings array<string>, clean double, chain string, odds double, back double"))


def validated_margin(words: DataFrame) -> float:
    """The margin of GRID with the fewest errors on all words that more documents
    hold than any of their readings: words changed as they stand (each counts
    tenfold, since clean words are the rule), and garbled ones not brought back."""
    known = words.filter((F.col("n") >= HELD_OUT) & (F.col("n") > F.col("rival")) & ~F.col("token").rlike("[\ufffd\x80-\x9f]"))
    errors = [F.count_if((F.col("odds") >= m) & (F.col("odds") < 1e9)) for m in GRID] + [F.count_if(F.col("back") < m) for m in GRID]
    row = known.agg(F.count(F.lit(1)), F.count("back"), *errors).first()
    if not row[0] or not row[1]:
        return float(GRID[0])
    wrong, missed = np.array(row[2 : 2 + len(GRID)]), np.array(row[2 + len(GRID) :])
    return float(GRID[int(np.argmin(10 * wrong / row[0] + missed / row[1]))])


def fit(texts: DataFrame, text: str) -> tuple[Model, float]:
    """The model after all passes, and its margin.  If the readings it prefers
    are few enough, it knows them; otherwise workers find them as they need
    them."""
    words = word_table(texts, text)
    for _ in range(PASSES):
        words = judge(words, train(words))
    model = train(words)
    shared = texts.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            tokens = b.column(0).to_pylist()
            options = [dict(zip(c, r, strict=True)) for c, r in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
            got = [(t, *g) for t, g in zip(tokens, m.best(tokens, options), strict=True) if g and g[0] > 0]
            yield pa.RecordBatch.from_pylist([dict(zip(SWAP, r, strict=True)) for r in got], SWAP_SCHEMA)

    swaps = cut(words.select("token", "chains", "readings").mapInArrow(run, "token string, gain double, reading string, chain string, bare boolean"))
    size = swaps.agg(F.sum(F.octet_length("token") + F.octet_length("reading") + F.octet_length("chain"))).first()[0] or 0
    if size <= SWAP_BYTES:
        model.known = {r["token"]: (r["gain"], r["reading"], r["chain"], r["bare"]) for r in swaps.toLocalIterator()}
        model.complete = True
    return model, validated_margin(words)


SWAP = ("token", "gain", "reading", "chain", "bare")
SWAP_SCHEMA = pa.schema([("token", pa.string()), ("gain", pa.float64()), ("reading", pa.string()), ("chain", pa.string()), ("bare", pa.bool_())])


def _fitted(df: DataFrame, id_column: str, text: str, margin: float | None) -> tuple[DataFrame, Broadcast, float]:
    rows = spread(df.select(F.col(id_column).alias("id"), F.col(text).cast("string").alias("text")))
    model, validated = fit(rows, "text")
    return rows, df.sparkSession.sparkContext.broadcast(model), float(validated if margin is None else margin)


def restore_text(df: DataFrame, id_column: str, text: str, margin: float | None = None) -> DataFrame:
    """(id, garbled, restored, text) of every row of df.

    garbled: some part of the text was read in a wrong encoding, whether or not
    it can be restored; a replacement character or a C1 control is garbled in
    any case.  restored: the text with the garbled parts taken back, otherwise
    the text itself.  Null and empty texts aren't garbled, repeated ids and texts
    are judged row by row.  Model and margin (unless given) come from every word
    of all texts.  Words too short to tell stay as they are.
    """
    rows, shared, limit = _fitted(df, id_column, text, margin)
    schema = T.StructType([T.StructField("id", rows.schema["id"].dataType), T.StructField("garbled", T.BooleanType()), T.StructField("restored", T.StringType()), T.StructField("text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for b in batches:
            found, out = model.restore(b.column(1).to_pylist(), limit)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.bool_()), pa.array(out, pa.string()), b.column(1)], names=["id", "garbled", "restored", "text"])

    return rows.mapInArrow(run, schema).select(F.col("id").alias(id_column), "garbled", "restored", F.col("text").alias(text))


def find_garbled(df: DataFrame, id_column: str, text: str, margin: float | None = None) -> DataFrame:
    """(id) of the rows that restore_text calls garbled; texts of ASCII characters
    alone, which can't be, stay on the JVM."""
    rows, shared, limit = _fitted(df, id_column, text, margin)
    schema = T.StructType([T.StructField("id", rows.schema["id"].dataType)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for b in batches:
            found, _ = model.restore(b.column(1).to_pylist(), limit)
            yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(found, pa.bool_()))], names=["id"])

    return rows.filter(F.col("text").rlike(r"[^\x00-\x7F]")).mapInArrow(run, schema).select(F.col("id").alias(id_column))
