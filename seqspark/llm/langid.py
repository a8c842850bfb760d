"""Language identification by a bidirectional gated recurrent network over bytes.

The network is small (``HIDDEN`` units a direction), is trained in numpy by backpropagation through time, and gives every
byte of a text a distribution over the languages. A document's probabilities are the mean over its bytes.

Training uses at most ``per_language`` different documents of each language (those of lowest hash of id and text; repeated rows count once) and at
most ``max_rows`` in all, shared evenly by the languages, and one stretch of ``train_bytes`` bytes of each; those stretches are all that reaches
the driver. Every language that has a text is learned; more than ``max_rows`` of them are an error. A character with a byte that no training
stretch has says nothing: all languages are equally likely there. Every document is then labelled whole, in stretches of ``STEPS`` bytes, thousands of them
side by side; either network starts ``WARM`` bytes before its stretch (or at the text's end), so it has read what stands there.

Edge cases: a text that is null or has no letter is ``und`` with score 0; without any labelled row every text is ``und``; repeated rows get
equal labels; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seqspark.llm import textnp
from seqspark.llm.common import held_out, spread

HIDDEN = 8
STEPS, WARM = 240, 16
TRAIN_BYTES, PER_LANGUAGE, MAX_ROWS = 1024, 300, 20_000
#: Stretches that are labelled side by side.
_WIDE = 1024


def _gru(table: np.ndarray, u: np.ndarray, bias: np.ndarray, steps: np.ndarray, cache: list | None = None) -> np.ndarray:
    """States [time, units, stretches] for bytes [time, stretches]. table: [256, 3 units] of input terms (update, reset, new);
    u: [3 units, units]; bias: [units] of the recurrent new term."""
    h_n, n = u.shape[1], steps.shape[1]
    h = np.zeros((h_n, n), np.float32)
    out = np.empty((len(steps), h_n, n), np.float32)
    for t, byte in enumerate(steps):
        a = table[byte].T
        b = u @ h
        gates = a[: 2 * h_n] + b[: 2 * h_n]
        gates *= 0.5
        np.tanh(gates, out=gates)
        gates *= 0.5
        gates += 0.5
        z, r = gates[:h_n], gates[h_n:]
        un = b[2 * h_n :] + bias[:, None]
        new = r * un
        new += a[2 * h_n :]
        np.tanh(new, out=new)
        if cache is not None:
            cache.append((h, z, r, un, new))
        h = new + z * (h - new)
        out[t] = h
    return out


def _gru_back(u: np.ndarray, steps: np.ndarray, cache: list, d_out: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Gradients of (table, u, bias) from those of the states, back through time."""
    h_n, n = u.shape[1], steps.shape[1]
    d_u, d_bias = np.zeros_like(u), np.zeros(h_n, np.float32)
    d_in = np.empty((len(steps), 3 * h_n, n), np.float32)
    carry = np.zeros((h_n, n), np.float32)
    for t in range(len(steps) - 1, -1, -1):
        h, z, r, un, new = cache[t]
        d = d_out[t] + carry
        d_new = d * (1 - z) * (1 - new * new)
        d_in[t, :h_n] = d * (h - new) * z * (1 - z)
        d_in[t, h_n : 2 * h_n] = d_new * un * r * (1 - r)
        d_in[t, 2 * h_n :] = d_new
        through = d_in[t].copy()
        through[2 * h_n :] *= r
        d_bias += through[2 * h_n :].sum(axis=1)
        d_u += through @ h.T
        carry = d * z + u.T @ through
    flat, at = d_in.transpose(1, 0, 2).reshape(3 * h_n, -1), steps.reshape(-1)
    d_table = np.stack([np.bincount(at, row, 256) for row in flat], axis=1).astype(np.float32)
    return d_table, d_u, d_bias


class ByteTagger:
    """params: table, u and bias of the forward and the backward network, then head [languages, 2 units] and its bias."""

    def __init__(self, languages: list[str], seed: int = 3, hidden: int = HIDDEN) -> None:
        random = np.random.default_rng(seed)
        small = lambda *shape: random.normal(0, 0.3, shape).astype(np.float32)
        self.languages = languages
        self.seen = np.ones(256, bool)
        self.params = [small(256, 3 * hidden), small(3 * hidden, hidden), np.zeros(hidden, np.float32)]
        self.params += [small(256, 3 * hidden), small(3 * hidden, hidden), np.zeros(hidden, np.float32)]
        self.params += [small(len(languages), 2 * hidden), np.zeros(len(languages), np.float32)]

    def states(self, steps: np.ndarray, lengths: np.ndarray | None = None, caches: tuple[list, list] | tuple[None, None] = (None, None)) -> np.ndarray:
        """lengths: of the stretches, where they differ; the backward network begins at each one's last byte."""
        ahead = _gru(*self.params[:3], steps, caches[0])
        if lengths is None or (lengths == len(steps)).all():
            return np.concatenate([ahead, _gru(*self.params[3:6], steps[::-1], caches[1])[::-1]], axis=1)
        turned = (lengths - 1 - np.arange(len(steps))[:, None]) % len(steps)
        back = _gru(*self.params[3:6], np.take_along_axis(steps, turned, 0))
        return np.concatenate([ahead, np.take_along_axis(back, turned[:, None, :], 0)], axis=1)

    def probabilities(self, states: np.ndarray) -> np.ndarray:
        """[time, languages, stretches]"""
        odds = self.params[6] @ states + self.params[7][None, :, None]
        odds -= odds.max(axis=1, keepdims=True)
        np.exp(odds, out=odds)
        odds /= odds.sum(axis=1, keepdims=True)
        return odds

    def fit(self, stretches: np.ndarray, labels: np.ndarray, updates: int = 400, batch: int = 128, steps: int = 48, rate: float = 0.02, seed: int = 4) -> ByteTagger:
        """stretches: [rows, bytes], filled with 0. Adam on the mean cross entropy of all positions."""
        random = np.random.default_rng(seed)
        self.seen = np.bincount(stretches.reshape(-1), minlength=256) > 0
        m, s = [np.zeros_like(p) for p in self.params], [np.zeros_like(p) for p in self.params]
        h = self.params[2].size
        length = (stretches > 0).sum(axis=1)
        for update in range(1, updates + 1):
            pick = random.integers(0, len(stretches), batch)
            start = (random.random(batch) * np.maximum(length[pick] - steps, 1)).astype(np.int64)
            byte = stretches[pick[:, None], start[:, None] + np.arange(steps)].T
            caches: tuple[list, list] = ([], [])
            states = self.states(byte, caches=caches)
            d_odds = self.probabilities(states)
            d_odds[:, labels[pick], np.arange(batch)] -= 1
            d_odds *= (byte > 0)[:, None, :] / max(1, int((byte > 0).sum()))
            d_states = self.params[6].T @ d_odds
            grads = [*_gru_back(self.params[1], byte, caches[0], d_states[:, :h])]
            grads += [*_gru_back(self.params[4], byte[::-1], caches[1], d_states[::-1, h:])]
            grads += [np.einsum("tcn,thn->ch", d_odds, states, optimize=True), d_odds.sum(axis=(0, 2))]
            size = np.sqrt(sum(float((g * g).sum()) for g in grads))
            for p, g, a, b in zip(self.params, grads, m, s, strict=True):
                g = g * min(1.0, 1.0 / max(size, 1e-9))
                a += 0.1 * (g - a)
                b += 0.01 * (g * g - b)
                p -= (rate * (1 - update / (updates + 1)) * (a / (1 - 0.9**update)) / (np.sqrt(b / (1 - 0.99**update)) + 1e-8)).astype(np.float32)
        return self

    def strange(self, data: np.ndarray) -> np.ndarray:
        """The bytes of characters with a byte that was not in training."""
        character = np.cumsum((data & 0xC0) != 0x80)
        return np.isin(character, character[~self.seen[data]])

    def label(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each text of a slice: (sums [texts, languages] of the probabilities of its bytes, how many of its bytes are labelled as
        each language)."""
        n, c = len(offsets) - 1, len(self.languages)
        sums, votes = np.zeros((n, c)), np.zeros((n, c), np.int64)
        pieces = (np.diff(offsets) + STEPS - 1) // STEPS
        owner = np.repeat(np.arange(n), pieces)
        within = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        start = offsets[owner] + within * STEPS
        end = np.minimum(offsets[owner + 1], start + STEPS)
        # what is read: the stretch and what stands around it in its own text
        low, high = np.maximum(offsets[owner], start - WARM), np.minimum(offsets[owner + 1], end + WARM)
        order = np.argsort(high - low, kind="stable")
        padded = np.concatenate([data, np.zeros(STEPS + 2 * WARM, np.uint8)])
        strange = np.concatenate([self.strange(data), np.zeros(STEPS + 2 * WARM, bool)])
        for at in range(0, len(owner), _WIDE):
            rows = order[at : at + _WIDE]
            t = np.arange(int((high - low)[rows].max()))[:, None]
            byte = np.where(t < high[rows] - low[rows], padded[low[rows] + t], 0)
            p = self.probabilities(self.states(byte, high[rows] - low[rows]))
            live = (t >= start[rows] - low[rows]) & (t < end[rows] - low[rows])
            known = ~strange[low[rows] + t]
            p = np.where(known[:, None, :], p, np.float32(1 / c)) if not known.all() else p
            best = p.argmax(axis=1)
            p *= live[:, None, :]
            np.add.at(sums, owner[rows], p.sum(axis=0).T)
            for k in range(c):
                np.add.at(votes[:, k], owner[rows], ((best == k) & live & known).sum(axis=0))
        return sums, votes


def training_stretches(docs: DataFrame, per_language: int, max_rows: int, train_bytes: int) -> tuple[list[str], list[tuple[str, bytes]]]:
    """(languages, rows of (language, bytes)) of documents that are not held out."""
    known = docs.where(F.col("lang").isNotNull() & (F.length("text") > 0) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.select("lang", "text", F.xxhash64("doc_id", "text").alias("row"))
    counts = known.groupBy("lang").agg(F.approx_count_distinct("row").alias("n")).orderBy(F.desc("n"), "lang").limit(max_rows + 1).collect()
    if len(counts) > max_rows:
        raise ValueError(f"more than {max_rows} languages: set max_rows")
    if not counts:
        return [], []
    each = min(per_language, max_rows // len(counts))
    rates = docs.sparkSession.createDataFrame([(r["lang"], min(1.0, (1.5 * each + 30) / max(1, r["n"]))) for r in counts], "lang string, rate double")
    draw = F.pmod(F.col("row"), F.lit(1_000_003)) / 1_000_003
    at = F.pmod(F.xxhash64(F.col("row"), F.lit(1)), F.greatest(F.length("text") - train_bytes, F.lit(1))) + 1
    stretch = F.substring(F.col("text").substr(at.cast("int"), F.lit(train_bytes)).cast("binary"), 1, train_bytes)
    drawn = known.join(F.broadcast(rates), "lang").where(draw < F.col("rate")).select("lang", "row", stretch.alias("stretch")).distinct()
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.pmod("row", F.lit(1_000_003)), "row", "stretch"))
    found = drawn.withColumn("place", place).where(F.col("place") <= each).orderBy("lang", "place").collect()
    names = sorted(r["lang"] for r in counts)
    if lacking := set(names) - {r["lang"] for r in found}:
        raise ValueError(f"no training text of {sorted(lacking)[:10]}")
    return names, [(r["lang"], bytes(r["stretch"])) for r in found]


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE, max_rows: int = MAX_ROWS, train_bytes: int = TRAIN_BYTES) -> ByteTagger | None:
    languages, rows = training_stretches(docs, per_language, max_rows, train_bytes)
    if not rows:
        return None
    stretches = np.zeros((len(rows), train_bytes + STEPS), np.uint8)
    for i, (_, data) in enumerate(rows):
        stretches[i, : len(data)] = np.frombuffer(data, np.uint8)
    # every language equally often
    labels = np.array([languages.index(lang) for lang, _ in rows])
    size = min(int(np.bincount(labels, minlength=len(languages)).max()), max(1, max_rows // len(languages)))
    even = np.concatenate([np.resize(np.flatnonzero(labels == k), size) for k in range(len(languages)) if (labels == k).any()])
    return ByteTagger(languages).fit(stretches[even], labels[even])


def languages(docs: DataFrame, model: ByteTagger | None) -> DataFrame:
    """doc_id, lang_pred, score (the pooled probability of that language), share (of the bytes that are labelled so)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    ascii_letters = np.zeros(256, bool)
    ascii_letters[65:91] = ascii_letters[97:123] = True

    def labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = shared.value
        for batch in batches:
            for i, j, data, offsets in textnp.slices(batch.column("text")):
                size = np.diff(offsets)
                found = np.concatenate([[0], np.cumsum(ascii_letters[data])])
                lettered = np.diff(found[offsets]) > 0
                for k in np.flatnonzero(~lettered & (size > 0)):
                    lettered[k] = any(x.isalpha() for x in data[offsets[k] : offsets[k + 1]].tobytes().decode())
                if tagger is None:
                    lettered[:] = False
                pred, score, share = np.full(j - i, "und", object), np.zeros(j - i), np.zeros(j - i)
                if lettered.any():
                    sums, votes = tagger.label(data, offsets)
                    best = sums.argmax(axis=1)
                    rows = np.arange(len(best))
                    pred[lettered] = np.array(tagger.languages, object)[best[lettered]]
                    score[lettered] = (sums[rows, best] / np.maximum(size, 1))[lettered]
                    share[lettered] = (votes[rows, best] / np.maximum(size, 1))[lettered]
                arrays = [batch.column("doc_id").slice(i, j - i), pa.array(pred, pa.string()), pa.array(np.clip(score, 0, 1)), pa.array(share)]
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "lang_pred", "score", "share"])

    rows = spread(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")))
    return rows.mapInArrow(labelled, "doc_id long, lang_pred string, score double, share double")


def identify(docs: DataFrame, per_language: int = PER_LANGUAGE, max_rows: int = MAX_ROWS, train_bytes: int = TRAIN_BYTES) -> DataFrame:
    """languages() of a model fitted on the documents that are not held out, with held_out."""
    return languages(docs, fit(docs, per_language, max_rows, train_bytes)).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "share")
