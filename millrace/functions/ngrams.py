"""Character n-grams of texts, counted as numbers over many texts at once."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa

#: Characters and texts of a lot, the texts that are taken at once.
LOT, LOT_TEXTS = 1 << 20, 2048


def char_ngrams(text: str, low: int = 3, high: int = 5) -> Counter[str]:
    """Counts of the n-grams of low to high characters, runs of white space
    taken as one space."""
    t = _collapsed(text)
    return Counter(t[k : k + n] for n in range(low, high + 1) for k in range(len(t) - n + 1))


def _collapsed(text: str) -> str:
    return re.sub(r"\s{2,}", " ", text)


def _lots(texts: Iterable[str | None], high: int, size: int, most: int) -> Iterator[list[str]]:
    part, n = [], 0
    for t in texts:
        part.append(_collapsed(t or ""))
        n += len(part[-1])
        if n >= size or len(part) >= most:
            yield from _fitting(part, high)
            part, n = [], 0
    if part:
        yield from _fitting(part, high)


def _points(part: list[str]) -> np.ndarray:
    return np.frombuffer("".join(part).encode("utf-32-le"), np.uint32)


def _seen(points: np.ndarray) -> np.ndarray:
    seen = np.zeros(int(points.max(initial=0)) + 1, bool)
    seen[points] = True
    return seen


def _fitting(part: list[str], high: int) -> Iterator[list[str]]:
    """part in pieces whose texts' numbers and n-grams fit 63 bits together; a
    single text may not."""
    if len(part) > 1 and len(part) * int(_seen(_points(part)).sum()) ** high >= 1 << 63:
        yield from _fitting(part[: len(part) // 2], high)
        yield from _fitting(part[len(part) // 2 :], high)
    else:
        yield part


def _runs(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of a sorted array, and how often each occurs."""
    starts = np.flatnonzero(np.concatenate((np.ones(min(len(x), 1), bool), x[1:] != x[:-1])))
    return x[starts], np.diff(starts, append=len(x))


class _Coded:
    """A lot: each character as its place in the lot's own alphabet, each n-gram
    as a number in that base."""

    def __init__(self, part: list[str]):
        points = _points(part)
        seen = _seen(points)
        self.alphabet = np.flatnonzero(seen)
        self.place = np.where(seen, np.cumsum(seen) - 1, -1)
        self.codes = self.place[points]
        self.text = np.repeat(np.arange(len(part)), np.fromiter(map(len, part), np.int64, len(part)))
        self.base = len(self.alphabet)

    def windows(self, low: int, high: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(n, n-grams, the texts they are in)."""
        grams = self.codes
        for n in range(1, high + 1):
            if n > 1:
                grams = grams[:-1] * self.base + self.codes[n - 1 :]
            if n >= low:
                whole = self.text[: len(grams)] == self.text[n - 1 :]
                yield n, grams[whole], self.text[: len(grams)][whole]

    def spelled(self, grams: np.ndarray, n: int) -> pa.Array:
        points = np.empty((len(grams), n), np.uint32)
        for k in range(n - 1, -1, -1):
            grams, digit = np.divmod(grams, max(self.base, 1))
            points[:, k] = self.alphabet[digit]
        width = (1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000)).sum(axis=1)
        ends = np.concatenate(([0], np.cumsum(width))).astype(np.int32)
        return pa.StringArray.from_buffers(len(ends) - 1, pa.py_buffer(ends), pa.py_buffer(points.tobytes().decode("utf-32-le").encode()))


def _vast(part: list[str], high: int) -> bool:
    return len(part) == 1 and len(part[0]) >= 1 << (62 // high) and len(set(part[0])) ** high >= 1 << 63


def count_ngrams(texts: Iterable[str | None], low: int, high: int) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """(terms, texts they are in, occurrences), by lots: a term may come again."""
    for part in _lots(texts, high, 2 * LOT, LOT):
        if _vast(part, high):
            many = char_ngrams(part[0], low, high)
            yield pa.array(list(many), pa.string()), np.ones(len(many), np.int64), np.fromiter(many.values(), np.int64, len(many))
            continue
        lot = _Coded(part)
        for n, grams, text in lot.windows(low, high):
            own = lot.base**n
            pairs, _ = _runs(np.sort(text * own + grams))
            terms, times = _runs(np.sort(grams))
            yield lot.spelled(terms, n), _runs(np.sort(pairs % own))[1] if len(pairs) else times, times


class Vocabulary:
    """Terms by place, found in texts."""

    def __init__(self, terms: list[str], low: int, high: int):
        self.low, self.high, self.at = low, high, {t: k for k, t in enumerate(terms)}
        self.by_length = {}
        for n in range(low, high + 1):
            own = [t for t in terms if len(t) == n]
            self.by_length[n] = np.fromiter((self.at[t] for t in own), np.int32, len(own)), _points(own).reshape(-1, n)

    def _known(self, lot: _Coded, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Sorted numbers of the terms that the lot's alphabet can spell, and their places."""
        places, points = self.by_length[n]
        codes = np.where(points < len(lot.place), lot.place[np.minimum(points, len(lot.place) - 1)], -1)
        can = (codes >= 0).all(axis=1)
        grams = np.zeros(int(can.sum()), np.int64)
        for k in range(n):
            grams = grams * lot.base + codes[can, k]
        order = np.argsort(grams)
        return grams[order], places[can][order]

    def counts(self, texts: Iterable[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For each lot of texts, in their order: (number of terms of each text;
        their places and counts, one text after the other)."""
        for part in _lots(texts, self.high, LOT, LOT_TEXTS):
            if _vast(part, self.high):
                found = {self.at[g]: c for g, c in char_ngrams(part[0], self.low, self.high).items() if g in self.at}
                yield np.array([len(found)]), np.fromiter(found, np.int32, len(found)), np.fromiter(found.values(), np.int64, len(found))
                continue
            lot = _Coded(part)
            cells = [(np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int64))]
            for n, grams, text in lot.windows(self.low, self.high):
                known, places = self._known(lot, n)
                if len(known) and len(grams):
                    own = lot.base**n
                    pairs, times = _runs(np.sort(text * own + grams))
                    texts_of, pairs = np.divmod(pairs, own)
                    near = np.minimum(np.searchsorted(known, pairs), len(known) - 1)
                    hit = known[near] == pairs
                    cells.append((texts_of[hit], places[near[hit]], times[hit]))
            text, places, times = (np.concatenate(x) for x in zip(*cells, strict=True))
            order = np.argsort(text, kind="stable")
            yield np.bincount(text, minlength=len(part)), places[order], times[order]
