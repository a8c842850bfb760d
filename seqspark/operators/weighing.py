"""Rewards of every row of a grid of weights, without a row for each pair of a score and a candidate.

A chunk of rows is scored for all candidates at once in numpy, so what is shuffled are packed scores: those of one range of scores and one block of
candidates meet in a task, whatever the number of rows. Ranks go on from the counts of the ranges above. The driver holds a few numbers a candidate.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seqspark.functions import scalars as S
from seqspark.operators import metrics
from seqspark.sources.io import written

#: Rows of a chunk and of a range of scores, about; candidates that share a task.
ROWS, BLOCK = 10_000, 86


def _scores(table: pa.Table, weights: np.ndarray, total: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each candidate's place and the scores of a chunk's rows."""
    z = [table[f"_z{i}"].to_numpy() for i in range(weights.shape[1])]
    for c, w in enumerate(weights):
        x = sum((w[i] * z[i] for i in range(len(z))), 0.0) / total[c]
        yield c, 1 / (1 + np.exp(-np.clip(x, -35.0, 35.0)))


def _labels(table: pa.Table) -> np.ndarray:
    """1, 0, or -1 where there is none."""
    return table["label"].fill_null(-1).to_numpy().astype(np.int8)


def _centred(p: np.ndarray, t: float) -> np.ndarray:
    t = max(min(t, 1 - 1e-6), 1e-6)
    return np.clip(np.where(p < t, 0.5 * p / t, 0.5 + 0.5 * (p - t) / (1 - t)), 0.0, 1.0)


def _by_idx(table: pa.Table) -> pa.Table:
    return table.combine_chunks().sort_by("idx")


def rewards(parts: DataFrame, grid: DataFrame, names: Sequence[str], max_fpr: float = 0.05, count: int = 1, fraction: float = 0.16, spread: float = 0.05, rows: int = ROWS, block: int = BLOCK) -> DataFrame:
    """candidate, threshold, reward and its parts of each row of a small grid of weights: as ``blends.rewarded`` of ``blends.candidate_scores``.

    Rows with equal parts tie; they stay in one range. Places among ties go by idx, as chunks are ranges of it."""
    given = grid.select("candidate", *names).orderBy("candidate").collect()
    ids = [r["candidate"] for r in given]
    weights = np.array([[float(r[n]) for n in names] for r in given])
    total = weights.sum(axis=1)
    prior = sum((float(w) * F.col(f"_z{i}") for i, w in enumerate(weights[0])), F.lit(0.0)) / float(total[0])  # cuts ranges for all, near enough

    logits = written(parts.select("idx", F.col("label").cast("int").alias("label"), *[S.logit(F.col(n)).alias(f"_z{i}") for i, n in enumerate(names)]))
    n_ranges = max(1, -(-logits.count() // rows))
    chunked = written(logits.repartitionByRange(n_ranges, "idx").withColumn("chunk", F.spark_partition_id()))
    chunks = chunked.groupBy("chunk")
    at = chunked.select(S.sigmoid(prior).alias("p")).stat.approxQuantile("p", [(k + 1) / n_ranges for k in range(n_ranges - 1)], 0.2 / n_ranges) if n_ranges > 1 else []
    cuts = np.array(sorted(set(at)), dtype=float)

    def counted(table: pa.Table) -> pa.Table:
        label, out = _labels(table), []
        for c, p in _scores(table, weights, total):
            where = np.searchsorted(cuts, p)
            n, pos, neg = (np.bincount(x, minlength=len(cuts) + 1) for x in (where, where[label == 1], where[label == 0]))
            out.extend((c, int(r), int(n[r]), int(pos[r]), int(neg[r])) for r in np.flatnonzero(n))
        return pa.Table.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], names=["c", "range", "n", "pos", "neg"])

    per = chunks.applyInArrow(counted, "c long, range long, n long, pos long, neg long").groupBy("c", "range").agg(*[F.sum(x).alias(x) for x in ("n", "pos", "neg")])
    whole = Window.partitionBy("c")  # a row a range
    above = whole.orderBy(F.desc("range")).rowsBetween(Window.unboundedPreceding, -1)
    sums = {f"{x}_above": F.coalesce(F.sum(x).over(above), F.lit(0)) for x in ("n", "pos", "neg")} | {f"{x}_all": F.sum(x).over(whole) for x in ("n", "pos", "neg")}
    per = written(per.withColumns(sums))

    # the two negatives that the threshold lies between: their ranges, and their places in them from the lowest up
    place = (F.col("neg_all") - 1) * (1 - max_fpr)
    below = F.col("neg_all") - F.col("neg_above") - F.col("neg")
    edges = [F.when((edge >= below) & (edge < below + F.col("neg")), F.struct(F.col("range"), (edge - below).alias("at"))) for edge in (F.floor(place), F.ceil(place))]
    facts = per.groupBy("c").agg(*[F.max(f"{x}_all").alias(x) for x in ("n", "pos", "neg")], *[F.max(e).alias(k) for e, k in zip(edges, ("low", "high"), strict=True)]).collect()
    fact = {r["c"]: r for r in facts}
    wanted = {c: {(e["range"], e["at"]) for e in (r["low"], r["high"]) if e is not None} for c, r in fact.items()}

    def gathered(table: pa.Table) -> pa.Table:
        negative, out = _labels(table) == 0, []
        for c, p in _scores(table, weights, total):
            p = p[negative]
            where = np.searchsorted(cuts, p)
            out.extend((c, r, p[where == r].tobytes()) for r in {r for r, _ in wanted[c]})
        cs, rs, xs = zip(*out, strict=True) if out else ((), (), ())
        return pa.Table.from_arrays([pa.array(cs, pa.int64()), pa.array(rs, pa.int64()), pa.array(xs, pa.binary())], names=["c", "range", "scores"])

    def placed(table: pa.Table) -> pa.Table:
        c, r = table["c"][0].as_py(), table["range"][0].as_py()
        x = np.sort(np.concatenate([np.frombuffer(b.as_buffer(), float) for b in table["scores"].combine_chunks()]))
        at = sorted(a for q, a in wanted[c] if q == r)
        return pa.Table.from_arrays([pa.array([c] * len(at), pa.int64()), pa.array([r] * len(at), pa.int64()), pa.array(at, pa.int64()), pa.array(x[at])], names=["c", "range", "at", "score"])

    found = chunks.applyInArrow(gathered, "c long, range long, scores binary").groupBy("c", "range").applyInArrow(placed, "c long, range long, at long, score double")
    known = {(r["c"], r["range"], r["at"]): r["score"] for r in found.collect()}  # two a candidate
    thresholds = []
    for c in range(len(ids)):
        r = fact.get(c)
        if r is None or r["low"] is None:
            thresholds.append(0.5)
            continue
        low, high = (known[c, r[k]["range"], r[k]["at"]] for k in ("low", "high"))
        part = (r["neg"] - 1) * (1 - max_fpr)
        thresholds.append(low + (high - low) * (part - np.floor(part)))

    def centred(table: pa.Table) -> pa.Table:
        out = []
        for c, p in _scores(table, weights, total):
            s = _centred(p, thresholds[c])
            lows = s[s < 0.5]
            top = np.partition(lows, len(lows) - count - 1)[-count - 1 :] if len(lows) > count + 1 else lows
            out.append((c, int((s >= 0.5).sum()), float(s.max()), float(s.min()), top.tolist()))
        cs, called, most, least, tops = zip(*out, strict=True)
        return pa.Table.from_arrays([pa.array(cs, pa.int64()), pa.array(called, pa.int64()), pa.array(most), pa.array(least), pa.array(tops, pa.list_(pa.float64()))], names=["c", "called", "most", "least", "lows"])

    served = chunks.applyInArrow(centred, "c long, called long, most double, least double, lows array<double>").groupBy("c").agg(
        F.sum("called").alias("called"), (F.max("most") - F.min("least")).alias("wide"), F.slice(F.sort_array(F.flatten(F.collect_list("lows")), False), 1, count + 1).alias("lows")
    )
    plan: dict[int, Mapping] = {}
    for r in served.collect():
        n = fact[r["c"]]["n"]
        least, budget = min(count, n), max(1, int(np.floor(fraction * n)))
        lifts = r["called"] < least and r["wide"] >= spread
        lows = r["lows"][least - r["called"] :] if lifts else r["lows"]
        plan[r["c"]] = {"least": least, "budget": budget, "lifts": lifts, "over": (least if lifts else r["called"]) - budget, "floor": min(lows[0] if lows else 0.45, 0.499)}

    def packed(table: pa.Table) -> pa.Table:
        table = _by_idx(table)
        label, chunk = _labels(table), table["chunk"][0].as_py()
        out, held = [], {}
        for c, p in _scores(table, weights, total):
            order = np.argsort(-p, kind="stable")
            p, y = p[order], label[order]
            ends = np.searchsorted(-p, -cuts, side="left") if len(cuts) else np.zeros(0, int)  # rows above each cut
            for r in range(len(cuts) + 1):
                first, last = (ends[r] if r < len(cuts) else 0), (ends[r - 1] if r else len(p))
                if last > first:
                    held.setdefault(r, []).append((c, p[first:last], y[first:last]))
            if (c + 1) % block == 0 or c + 1 == len(weights):
                out.extend((r, c // block, chunk, [x[0] for x in xs], [len(x[1]) for x in xs], np.concatenate([x[1] for x in xs]).tobytes(), np.concatenate([x[2] for x in xs]).tobytes()) for r, xs in held.items())
                held = {}
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.binary()]
        return pa.Table.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["range", "block", "chunk", "cs", "sizes", "scores", "labels"])

    def measured(left: pa.Table, right: pa.Table) -> pa.Table:
        pieces: dict[int, list] = {}
        for b in left.sort_by("chunk").to_batches():
            for k in range(b.num_rows):
                p, y, start = np.frombuffer(b["scores"][k].as_buffer(), float), np.frombuffer(b["labels"][k].as_buffer(), np.int8), 0
                for c, size in zip(b["cs"][k].as_py(), b["sizes"][k].as_py(), strict=True):
                    pieces.setdefault(c, []).append((p[start : start + size], y[start : start + size]))
                    start += size
        out = []
        for r in right.to_pylist():
            c = r["c"]
            p, y = (np.concatenate([x[k] for x in pieces[c]]) for k in (0, 1))
            order = np.argsort(-p, kind="stable")  # ties stay in the order of idx
            p, y, how = p[order], y[order], plan[c]
            s, first = _centred(p, thresholds[c]), r["n_above"] + np.arange(len(p))
            if how["lifts"]:
                s = np.where((first < how["least"]) & (s < 0.5), np.clip(0.5 + 0.01 * (how["least"] - first) / how["least"], 0.0, 1.0), s)
            if how["over"] > 0:
                beyond = first - how["budget"]
                squeezed = how["floor"] + (0.5 - how["floor"]) * (how["over"] - beyond) / (how["over"] + 1)
                s = np.where((s >= 0.5) & (beyond >= 0), np.clip(squeezed, 0.0, 1.0), s)
            last = np.flatnonzero(np.append(s[1:] != s[:-1], True))  # of each distinct score
            tp, fp = (r[f"{k}_above"] + np.cumsum(y == v)[last] for k, v in (("pos", 1), ("neg", 0)))
            gained = np.diff(tp, prepend=r["pos_above"])
            precision = float((gained * (tp / np.maximum(tp + fp, 1))).sum())
            within = fp <= max_fpr * r["neg_all"]
            called = s >= 0.5
            out.append((c, precision, int(tp[within].max()) if within.any() else 0, int((called & (y == 1)).sum()), int((called & (y == 0)).sum())))
        kinds = [pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.int64()]
        return pa.Table.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["c", "precision", "reached", "hits", "alarms"])

    scored = chunks.applyInArrow(packed, "range long, block long, chunk long, cs array<long>, sizes array<long>, scores binary, labels binary")
    counts = per.withColumn("block", F.floor(F.col("c") / block))
    steps = scored.groupBy("range", "block").cogroup(counts.groupBy("range", "block")).applyInArrow(measured, "c long, precision double, reached long, hits long, alarms long")
    sums_ = steps.groupBy("c").agg(F.sum("precision").alias("precision"), F.max("reached").alias("reached"), F.sum("hits").alias("hits"), F.sum("alarms").alias("alarms"))
    some = [(c, ids[c], float(thresholds[c]), r["n"], r["pos"], r["neg"]) for c, r in fact.items()]
    named = parts.sparkSession.createDataFrame(some, "c long, candidate long, threshold double, n long, p long, q long")  # a row a candidate
    p, q = F.nullif("p", F.lit(0)), F.nullif("q", F.lit(0))
    out = sums_.join(F.broadcast(named), "c").select(
        "candidate", "threshold", (F.col("precision") / p).alias("ap"), F.when(q.isNotNull(), F.col("reached") / p).alias("recall_at_fpr"),
        (F.col("alarms") / q).alias("hard_fpr"), (F.col("hits") / p).alias("hard_recall"), ((F.col("hits") + F.col("alarms")) / (F.col("p") + F.col("q"))).alias("positive_rate"),
    )
    return out.withColumn("reward", metrics.reward(F.col("ap"), F.col("recall_at_fpr"), F.col("hard_fpr")))
