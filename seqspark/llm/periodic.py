"""Runs of periodic words, found by internal pattern matching.

The words of many texts stand in one sequence, each named by its text too, so that nothing matches across texts. Names of all stretches of
1, 2, 4, ... words come from prefix doubling, which sorts the suffix array as it goes and re-sorts only what is not yet told apart: a
block's name is where its occurrences begin in that array. A wavelet tree over the array answers, for every aligned dyadic block at once, where
the block occurs next in the windows beside it. One or two occurrences are candidate periods as they are; more form an arithmetic progression,
the block is then itself periodic, and the ends of its stretch and of the progression's give the candidates. Every candidate is
extended both ways by the names, exactly.

Why nothing is lost: a run of period q and length >= max(24, 3 q) holds an aligned block of 8 words (q < 16), or of L = 2**k words
(L <= q < 2 L), that still lies q words before the run's end, so that it occurs again q words on.

Words are ``[^\\x20\\x09-\\x0D]+``. Edge cases: null and empty texts have no words and no runs; a null id is no reason to rewrite a text;
repeated rows are separate rows; an empty table gives none; other columns are left out. Texts are worked on whole: memory grows with
the longest text, about 30 bytes a word for each doubling that it needs.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqspark.llm import textnp
from seqspark.llm.common import spread

#: A run has at least LEAST words and at least POWER times its period.
LEAST, POWER = 24, 3
#: Words of the smallest block, as a power of two. LEAST >= 3 * 2**SMALLEST makes it meet all periods below 2**(SMALLEST + 1).
SMALLEST = 3

SCHEMA = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


class Names:
    """Names of all stretches of 2**k items of a sequence: equal where the stretches are, and the place in the suffix array where those begin.
    A stretch that reaches beyond the sequence is like no other. The last level has no two equal names."""

    def __init__(self, items: np.ndarray):
        n = len(items)
        self.suffixes = np.argsort(items, kind="stable").astype(np.int32)
        sorted_items = items[self.suffixes]
        slots, keys, held = np.arange(n), sorted_items, self.suffixes
        name = np.zeros(n, np.int32)
        self.levels: list[np.ndarray] = []
        #: Slots of the suffix array, by level, whose stretch is found elsewhere too.
        self.shared: list[np.ndarray] = []
        span = 1
        while True:
            new = np.ones(len(slots) + 1, bool)
            np.not_equal(keys[1:], keys[:-1], out=new[1:-1])
            begins = np.maximum.accumulate(np.where(new[:-1], np.arange(len(slots)), 0))
            name[held] = slots[begins]
            self.levels.append(name)
            slots = slots[~(new[:-1] & new[1:])]
            self.shared.append(slots)
            if not len(slots):
                return
            held = self.suffixes[slots]
            after = held + span
            inside = after < n
            keys = (name[held].astype(np.int64) << 32) | np.where(inside, name[np.where(inside, after, 0)] + 1, 0)
            order = np.argsort(keys, kind="stable")
            keys, held = keys[order], held[order]
            self.suffixes[slots] = held
            name, span = name.copy(), 2 * span

    def forward(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many items from a on are those from b on (a < b)."""
        n, a, b, begin = len(self.suffixes), a.copy(), b.copy(), a
        for k in range(len(self.levels) - 1, -1, -1):
            name, inside = self.levels[k], b < n
            same = inside & (name[np.where(inside, a, 0)] == name[np.where(inside, b, n - 1)])
            same &= a != b
            a += same * np.int64(1 << k)
            b += same * np.int64(1 << k)
        return a - begin

    def backward(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many items before a are those before b (a < b)."""
        a, b, begin = a.copy(), b.copy(), a
        for k in range(len(self.levels) - 1, -1, -1):
            name, step = self.levels[k], np.int64(1 << k)
            inside = a >= step
            same = inside & (name[np.where(inside, a - step, 0)] == name[np.where(inside, b - step, 0)])
            same &= inside
            a -= same * step
            b -= same * step
        return begin - a


class WaveletTree:
    """Order statistics over ranges of a sequence of whole numbers, for many ranges at once. A level keeps a bit a value and a count every 64."""

    def __init__(self, values: np.ndarray):
        self.n_bits = max(1, int(values.max(initial=0)).bit_length())
        self.levels: list[tuple[np.ndarray, np.ndarray, int]] = []
        for bit in range(self.n_bits - 1, -1, -1):
            ones = (values >> bit) & 1 == 1
            packed = np.packbits(np.concatenate([ones, np.zeros(64 - len(ones) % 64, bool)]), bitorder="little").view(np.uint64)
            counts = np.zeros(len(packed) + 1, np.int64)
            np.cumsum(np.bitwise_count(packed), out=counts[1:])
            self.levels.append((packed, counts, int(len(ones) - ones.sum())))
            values = np.concatenate([values[~ones], values[ones]])

    @staticmethod
    def _ones(level: tuple[np.ndarray, np.ndarray, int], i: np.ndarray) -> np.ndarray:
        packed, counts, _ = level
        word, bit = i >> 6, (i & 63).astype(np.uint64)
        return counts[word] + np.bitwise_count(packed[word] & ((np.uint64(1) << bit) - np.uint64(1)))

    def below(self, low: np.ndarray, high: np.ndarray, value: np.ndarray) -> np.ndarray:
        """How many of the values at low to high are below value."""
        found = np.where(value >> self.n_bits > 0, high - low, 0)
        low, high = np.where(found > 0, 0, low), np.where(found > 0, 0, high)
        for bit, level in zip(range(self.n_bits - 1, -1, -1), self.levels, strict=True):
            a, b = self._ones(level, low), self._ones(level, high)
            one = (value >> bit) & 1 == 1
            found = found + np.where(one, (high - low) - (b - a), 0)
            low, high = np.where(one, level[2] + a, low - a), np.where(one, level[2] + b, high - b)
        return found

    def nth(self, low: np.ndarray, high: np.ndarray, n: np.ndarray) -> np.ndarray:
        """The n-th least, from 0, of the values at low to high."""
        value = np.zeros(len(low), np.int64)
        for bit, level in zip(range(self.n_bits - 1, -1, -1), self.levels, strict=True):
            a, b = self._ones(level, low), self._ones(level, high)
            zeros = (high - low) - (b - a)
            one = n >= zeros
            n = np.where(one, n - zeros, n)
            value = value | (one.astype(np.int64) << bit)
            low, high = np.where(one, level[2] + a, low - a), np.where(one, level[2] + b, high - b)
        return value


def candidates(names: Names) -> tuple[np.ndarray, np.ndarray]:
    """(places, periods): what the dyadic blocks' occurrences in the windows beside them suggest."""
    places, periods = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    if len(names.levels) <= SMALLEST + 1:
        return places[0], periods[0]
    shared = names.shared[SMALLEST]
    tree = WaveletTree(names.suffixes[shared].astype(np.int64))

    def suggest(at: np.ndarray, period: np.ndarray, good: np.ndarray) -> None:
        places.append(at[good])
        periods.append(period[good])

    for k in range(SMALLEST, len(names.levels) - 1):
        size, name = np.int64(1 << k), names.levels[k]
        block = np.arange(0, len(name), size)
        sizes = np.bincount(name[names.suffixes[names.shared[k]]], minlength=len(name))
        block = block[sizes[name[block]] > 1]
        if not len(block):
            continue
        low = np.searchsorted(shared, name[block])
        high = low + sizes[name[block]]
        first = tree.below(low, high, block + size)
        if k == SMALLEST:  # the window from the block's own place: the next occurrence is one period on
            near = tree.below(low, high, block + 1)
            some = near < first
            suggest(block[some], tree.nth(low[some], high[some], near[some]) - block[some], np.ones(int(some.sum()), bool))
        n = tree.below(low, high, block + 2 * size) - first
        some = n > 0
        block, low, high, first, n = block[some], low[some], high[some], first[some], n[some]
        one = tree.nth(low, high, first)
        suggest(block, one - block, n <= 2)
        more = n > 1
        block, one, n = block[more], one[more], n[more]
        two = tree.nth(low[more], high[more], first[more] + 1)
        suggest(block, two - block, n == 2)
        many = n > 2
        block, one, step = block[many], one[many], (two - one)[many]
        for shift in (names.forward(one, one + step) + one - names.forward(block, block + step) - block, one - names.backward(one, one + step) - block + names.backward(block, block + step)):
            suggest(block, shift, (shift >= size) & (shift < 2 * size))
    return np.concatenate(places), np.concatenate(periods)


def runs(items: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of every run of a sequence, by start, then period."""
    none = np.zeros(0, np.int64)
    if len(items) < LEAST:
        return none, none, none
    names = Names(items)
    place, period = candidates(names)
    start = place - names.backward(place, place + period)
    end = place + period + names.forward(place, place + period)
    good = end - start >= np.maximum(LEAST, POWER * period)
    found = np.unique(np.stack([start[good], end[good], period[good]], axis=1), axis=0)
    least = np.ones(len(found), bool)  # of one stretch the smallest period counts; the others are its multiples
    least[1:] = (found[1:, :2] != found[:-1, :2]).any(axis=1)
    found = found[least]
    found = found[np.lexsort((found[:, 2], found[:, 0]))]
    return found[:, 0], found[:, 1] - found[:, 0], found[:, 2]


def woven(doc_id: int | None, n: int) -> np.ndarray | None:
    """For a tenth of the ids: which word each of the n words becomes, so that the text ends in a periodic stretch; else None."""
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    place = np.arange(n)
    return np.where(place >= a, a + (place - a) % p, place)


def _best(start: np.ndarray, length: np.ndarray, period: np.ndarray) -> tuple[int, int, int] | None:
    """The run of the greatest exact length / period; of equal ones the first, then that of the smallest period."""
    best = None
    for s, n, q in zip(start.tolist(), length.tolist(), period.tolist(), strict=True):
        if best is None or n * best[2] > best[1] * q:
            best = s, n, q
    return best


def _hex(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def collapsed(docs: DataFrame, weave: bool = False) -> DataFrame:
    """doc_id, n_runs, the run of the highest exponent, and digests of all runs and of the text without what repeats its first period. With
    ``weave`` a tenth of the texts, chosen by id, is first made periodic (``woven``)."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            for i, j, data, offsets in textnp.slices(batch.column("text")):
                begins, ends, first = textnp.words(data, offsets)
                items = textnp.word_hashes(data, begins, ends)
                of = np.repeat(np.arange(j - i), np.diff(first))
                order = np.arange(len(items))
                if weave:
                    for k, doc_id in enumerate(ids[i:j]):
                        new = woven(doc_id, int(first[k + 1] - first[k]))
                        if new is not None:
                            order[first[k] : first[k + 1]] = new + first[k]
                items = textnp.mixed(items[order] + of.astype(np.uint64) * np.uint64(0xA24BAED4963EE407))
                start, length, period = runs(items)
                dropped = np.zeros(len(items) + 1, np.int64)
                np.add.at(dropped, start + period, 1)
                np.subtract.at(dropped, start + length, 1)
                kept = np.cumsum(dropped[:-1]) == 0
                cuts = np.searchsorted(start, first)
                raw, rows = data.tobytes(), []
                for k, doc_id in enumerate(ids[i:j]):
                    mine, place = slice(cuts[k], cuts[k + 1]), slice(first[k], first[k + 1])
                    words = raw[offsets[k] : offsets[k + 1]].split()
                    s, n, q = start[mine] - first[k], length[mine], period[mine]
                    stay = order[place][kept[place]] - first[k]
                    words = words if len(stay) == len(words) and (stay[1:] > stay[:-1]).all() else [words[w] for w in stay.tolist()]
                    best = _best(s, n, q) or (None, None, None)
                    listed = "".join(f"{a},{b},{c}\n" for a, b, c in zip(s.tolist(), n.tolist(), q.tolist(), strict=True))
                    rows.append((doc_id, len(s), *best, 1000 * best[1] // best[2] if best[2] else None, _hex(listed.encode()), _hex(b" ".join(words))))
                columns = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if m < 6 else pa.string()) for m, c in enumerate(columns)], [c.split()[0] for c in SCHEMA.split(", ")])

    return spread(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))).mapInArrow(found, SCHEMA)
