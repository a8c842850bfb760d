"""Quality scores from a factorisation machine over hashed words, structure statistics and metadata.

score = sigmoid(bias + <w, x> + sum over factors of ((sum v x)**2 - sum (v x)**2) / 2): all pairwise interactions in time
linear in a text's distinct words. Words (lower-cased A-Z) are hashed to ``BUCKETS`` and scaled to length 1; the
statistics are standardised on the sample; the metadata is ``n_chars``, where the table has it.

It is fitted on at most ``max_rows`` labelled documents, those of lowest hash of doc_id; their hashed
features, not their texts, reach the driver. Both label values weigh the same in sum, so a rare one counts; factors, decay and epochs
are chosen on labelled documents that are held back from the fit. All documents are scored, whole.

Edge cases: null and empty texts have no words and are scored by their statistics; a null n_chars counts as 0; without
labels of both values every score is the share of label 1 (0.5 without any label); repeated rows are scored
alike; of labels of one doc_id the greatest counts, and of its labelled rows those of lowest digest, so a refit sees the same sample;
an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqspark.llm import rules, textnp
from seqspark.llm.common import held_out, spread

BUCKETS = 1 << 15
THRESHOLD = 0.7
STATISTICS = 10
#: Tried pairs of factors and of the decay of words; the decay of statistics; the rate of factors to that of weights.
SETTINGS = ((6, 1e-4), (2, 1e-4), (6, 1e-2))
STATISTICS_DECAY = 1e-3
FACTOR_RATE = 0.25
#: Parts that are held back in turn; of a sample of MANY_ROWS, only the first is.
FOLDS, MANY_ROWS, PATIENCE = 4, 1000, 4


def features(data: np.ndarray, offsets: np.ndarray, n_chars: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(buckets, values, first, statistics) of the texts of a slice: the words of text i are first[i] to first[i + 1]."""
    n = len(offsets) - 1
    lower = textnp.LOWER[data]
    starts, ends, first = textnp.words(lower, offsets)
    buckets = (textnp.word_hashes(lower, starts, ends) % np.uint64(BUCKETS)).astype(np.int64)
    keys, counts = np.unique(np.repeat(np.arange(n), np.diff(first)) * BUCKETS + buckets, return_counts=True)
    first = np.searchsorted(keys, np.arange(n + 1) * BUCKETS)
    values = counts.astype(np.float32)
    norm = np.sqrt(_sums(values * values, first))
    values /= np.repeat(np.maximum(norm, 1e-9), np.diff(first))
    m = {k: v.astype(np.float64) for k, v in rules.measure(data, offsets).items()}
    words = np.maximum(m["n_words"], 1)
    distinct = np.diff(first)
    size = np.diff(offsets)
    statistics = np.stack([
        np.log1p(m["n_words"]), np.log1p(n_chars), m["word_chars"] / words, np.minimum(m["n_symbols"] / words, 3), m["n_dup_lines"] / np.maximum(m["n_lines"], 1),
        m["n_repeat_words"] / words, m["n_upper"] / np.maximum(m["n_letters"], 1), distinct / words, np.log1p(m["n_lines"]), m["n_letters"] / np.maximum(size, 1),
    ], axis=1)
    return keys % BUCKETS, values, first, statistics.astype(np.float32)


def _sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of values from first[i] to first[i + 1]."""
    total = np.zeros((len(values) + 1, *values.shape[1:]), np.float64)
    np.cumsum(values, axis=0, out=total[1:])
    return np.diff(total[first], axis=0)


@dataclass
class FactorisationMachine:
    """weights and factors: one row a bucket, then one a statistic."""

    bias: float
    weights: np.ndarray
    factors: np.ndarray
    mean: np.ndarray
    scale: np.ndarray

    def scaled(self, statistics: np.ndarray) -> np.ndarray:
        return np.clip((statistics - self.mean) / self.scale, -4, 4).astype(np.float32)

    def parts(self, buckets: np.ndarray, values: np.ndarray, first: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(log-odds, sums of factors) of each text."""
        w, v = self.weights[:BUCKETS], self.factors[:BUCKETS]
        vx = v[buckets] * values[:, None]
        linear = _sums(w[buckets] * values, first) + x @ self.weights[BUCKETS:]
        own = self.factors[BUCKETS:]
        sums = _sums(vx, first) + x @ own
        squares = _sums((vx * vx).sum(axis=1), first) + (x * x) @ (own * own).sum(axis=1)
        return self.bias + linear + ((sums * sums).sum(axis=1) - squares) / 2, sums

    def score(self, buckets: np.ndarray, values: np.ndarray, first: np.ndarray, statistics: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.parts(buckets, values, first, self.scaled(statistics))[0], -35, 35)))


@dataclass
class _Sample:
    """The rows of a sample as arrays."""

    label: np.ndarray
    buckets: list[np.ndarray]
    values: list[np.ndarray]
    statistics: np.ndarray

    @classmethod
    def of(cls, rows: list) -> _Sample:
        array = lambda name, kind: [np.frombuffer(r[name], kind) for r in rows]
        return cls(np.array([r["label"] for r in rows], np.float64), array("buckets", np.int32), array("values", np.float32), np.stack(array("statistics", np.float32)))

    def some(self, pick: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(buckets, values, first) of some rows."""
        first = np.concatenate([[0], np.cumsum([len(self.buckets[i]) for i in pick])])
        return np.concatenate([self.buckets[i] for i in pick]), np.concatenate([self.values[i] for i in pick]), first


def _trained(d: _Sample, rows: np.ndarray, held: np.ndarray, factors: int, decay: float, epochs: int, rate: float = 0.02, seed: int = 5) -> tuple[FactorisationMachine, list[float]]:
    """(model of some rows, loss on the held-back ones after each epoch). Adam on the logistic loss; both values weigh the same in
    sum. Words decay by ``decay``, statistics by ``STATISTICS_DECAY``. It ends early when the loss has not sunk for PATIENCE epochs."""
    random = np.random.default_rng(seed)
    size = BUCKETS + STATISTICS
    share, label = d.label[rows].mean(), d.label
    weight = np.where(label == 1, 0.5 / share, 0.5 / (1 - share))
    start = random.normal(0, 0.05, (size, factors)).astype(np.float32)
    model = FactorisationMachine(0.0, np.zeros(size, np.float32), start, d.statistics[rows].mean(axis=0), d.statistics[rows].std(axis=0) + 1e-3)
    x = model.scaled(d.statistics)
    all_ = np.concatenate([model.weights[:, None], model.factors], axis=1)
    m, s, step = np.zeros_like(all_), np.zeros_like(all_), 0
    # products of factors move twice as fast as weights, and there are many of them
    rates = np.array([rate] + [FACTOR_RATE * rate] * factors)
    asked = d.some(held) if len(held) else None
    losses: list[float] = []
    batch = min(64, max(8, len(rows) // 8))
    for _ in range(epochs):
        order = rows[random.permutation(len(rows))]
        for at in range(0, len(order), batch):
            pick = order[at : at + batch]
            model.weights, model.factors = all_[:, 0], all_[:, 1:]
            b, v, first = d.some(pick)
            odds, sums = model.parts(b, v, first, x[pick])
            error = weight[pick] * (1 / (1 + np.exp(-np.clip(odds, -35, 35))) - label[pick]) / len(pick)
            spread_ = np.repeat(np.arange(len(pick)), np.diff(first))
            hit, place = np.unique(b, return_inverse=True)
            gradient = np.zeros((len(hit) + STATISTICS, 1 + factors), np.float64)
            ev = error[spread_] * v
            for c in range(1 + factors):
                each = ev if c == 0 else ev * (sums[spread_, c - 1] - all_[b, c] * v)
                gradient[: len(hit), c] = np.bincount(place, each, len(hit))
            own = x[pick] * error[:, None]
            gradient[len(hit) :, 0] = own.sum(axis=0)
            gradient[len(hit) :, 1:] = own.T @ sums - ((x[pick] ** 2) * error[:, None]).sum(axis=0)[:, None] * all_[BUCKETS:, 1:]
            touched = np.concatenate([hit, np.arange(BUCKETS, size)])
            gradient[: len(hit)] += decay * all_[hit]
            gradient[len(hit) :] += STATISTICS_DECAY * all_[BUCKETS:]
            step += 1
            m[touched] = 0.9 * m[touched] + 0.1 * gradient
            s[touched] = 0.99 * s[touched] + 0.01 * gradient**2
            all_[touched] -= (rates * (m[touched] / (1 - 0.9**step)) / (np.sqrt(s[touched] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
            model.bias -= rate * float(error.sum())
        model.weights, model.factors = all_[:, 0], all_[:, 1:]
        if asked is not None:
            odds = model.parts(*asked, x[held])[0]
            losses.append(float((weight[held] * np.logaddexp(0, np.where(label[held] == 1, -odds, odds))).mean()))
            if len(losses) - 1 - int(np.argmin(losses)) >= PATIENCE:
                break
    model.weights, model.factors = np.ascontiguousarray(all_[:, 0]), np.ascontiguousarray(all_[:, 1:])
    return model, losses


def fit(rows: list) -> FactorisationMachine:
    """The model of rows (buckets, values and statistics as the bytes of arrays, label), in numpy. Factors, decay and number of epochs are
    those of least loss on rows that are held back in turn (FOLDS parts of each value, the first of them where there are many rows)."""
    label = np.array([r["label"] for r in rows], np.float64)
    n_least = int(min((label == 0).sum(), (label == 1).sum())) if len(label) else 0
    if not n_least:
        size = BUCKETS + STATISTICS
        share = min(max(label.mean() if len(label) else 0.5, 1e-6), 1 - 1e-6)
        return FactorisationMachine(float(np.log(share / (1 - share))), np.zeros(size, np.float32), np.zeros((size, 1), np.float32), np.zeros(STATISTICS), np.ones(STATISTICS))
    d, everything = _Sample.of(rows), np.arange(len(rows))
    epochs = 24 if len(rows) < MANY_ROWS else 12
    factors, decay, best = *SETTINGS[0], epochs // 2
    folds = min(FOLDS, n_least)
    if folds > 1:
        fold = np.zeros(len(rows), np.int64)
        for value in (0, 1):
            fold[label == value] = np.arange((label == value).sum()) % folds
        turns = range(folds if len(rows) < MANY_ROWS else 1)
        least = np.inf
        for tried in SETTINGS:
            runs = [_trained(d, everything[fold != k], everything[fold == k], *tried, epochs)[1] for k in turns]
            losses = np.mean([r[: min(map(len, runs))] for r in runs], axis=0)
            if losses.min() < least:
                (factors, decay), least, best = tried, losses.min(), int(losses.argmin()) + 1
    return _trained(d, everything, everything[:0], factors, decay, best)[0]


def _inputs(docs: DataFrame) -> DataFrame:
    n_chars = F.coalesce(F.col("n_chars").cast("long"), F.lit(0)) if "n_chars" in docs.columns else F.lit(0).cast("long")
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.greatest(n_chars, F.lit(0)).alias("n_chars"))


def sample(docs: DataFrame, labels: DataFrame, label: str, max_rows: int) -> list:
    """Features and labels of at most max_rows labelled documents that are not held out."""
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy(F.col("doc_id").cast("long").alias("_id")).agg(F.max(label).cast("int").alias("label"))
    known = known.orderBy(F.xxhash64("_id"), "_id").limit(max_rows)
    rows = _inputs(docs).join(F.broadcast(known), F.col("doc_id") == F.col("_id")).drop("_id")

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offsets in textnp.slices(batch.column("text")):
                part = batch.slice(i, j - i)
                buckets, values, first, statistics = features(data, offsets, part.column("n_chars").to_numpy())
                edges = list(zip(first[:-1], first[1:], strict=True))
                arrays = [part.column("doc_id"), part.column("label"), pa.array([buckets[a:b].astype(np.int32).tobytes() for a, b in edges], pa.binary())]
                arrays += [pa.array([values[a:b].tobytes() for a, b in edges], pa.binary()), pa.array([x.tobytes() for x in statistics], pa.binary())]
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "label", "buckets", "values", "statistics"])

    made_rows = rows.mapInArrow(made, "doc_id long, label int, buckets binary, values binary, statistics binary")
    # an id may have many rows, so the bound is taken again, in an order that does not depend on how the rows are stored
    order = [F.xxhash64("doc_id"), "doc_id", F.md5("buckets"), F.md5("statistics")]
    return made_rows.orderBy(*order).limit(max_rows).collect()


def scored(docs: DataFrame, model: FactorisationMachine) -> DataFrame:
    """doc_id, score of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offsets in textnp.slices(batch.column("text")):
                part = batch.slice(i, j - i)
                found = shared.value.score(*features(data, offsets, part.column("n_chars").to_numpy()))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(found, pa.float64())], ["doc_id", "score"])

    return spread(_inputs(docs)).mapInArrow(score, "doc_id long, score double")


def quality(docs: DataFrame, labels: DataFrame, label: str = "quality", max_rows: int = 4000) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    out = scored(docs, fit(sample(docs, labels, label, max_rows)))
    predicted = (F.col("score") >= THRESHOLD).cast("int")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", predicted.alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame, max_rows: int = 4000) -> DataFrame:
    """The documents, all columns, without those that the classifier rejects; scored in one pass over the rows."""
    model = fit(sample(docs, labels, "quality", max_rows))
    shared, columns = docs.sparkSession.sparkContext.broadcast(model), docs.columns

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(columns.index("text")).cast(pa.string())
            sizes = batch.column(columns.index("n_chars")).cast(pa.int64()).fill_null(0).to_numpy() if "n_chars" in columns else np.zeros(batch.num_rows)
            for i, j, data, offsets in textnp.slices(texts):
                found = shared.value.score(*features(data, offsets, np.maximum(sizes[i:j], 0)))
                yield batch.slice(i, j - i).filter(pa.array(found >= THRESHOLD))

    return spread(docs).mapInArrow(keep, docs.schema)
