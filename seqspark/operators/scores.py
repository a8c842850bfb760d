"""Scores within a batch: ranks, remapping, minimum and budget of positive calls, blends, the serve chain.

Tables have batch_id, idx (the place in the batch, which breaks ties) and score. A batch is one request, so its windows are bounded by it.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqspark.functions import scalars as S

EMPTY_SCORE = 0.1


def rank01(score: str = "score", by: tuple[str, ...] = ("batch_id",)) -> Column:
    """Rank in the batch, from 0 to 1; 0 in a batch of one."""
    batch = Window.partitionBy(*by)
    n = F.count("*").over(batch)
    return F.when(n <= 1, 0.0).otherwise((F.row_number().over(batch.orderBy(score, "idx")) - 1) / (n - 1))


def batch_rank(scores: DataFrame, fraction: float = 0.125, min_batch: int = 4) -> DataFrame:
    """Scores remapped by rank so that the top fraction of each batch lies above 0.5. Rows with ``is_live`` false (empty groups) are not
    ranked and get EMPTY_SCORE."""
    span = min(0.8, 0.5 / (1 - fraction) * 0.98)
    low = 0.5 - (1 - fraction) * span
    live = F.col("is_live") if "is_live" in scores.columns else F.lit(True)
    rows = scores.withColumn("_live", live)
    n = F.count("*").over(Window.partitionBy("batch_id", "_live"))
    mapped = S.clamp01(low + rank01(by=("batch_id", "_live")) * span)
    out = F.when(~F.col("_live"), EMPTY_SCORE).when(n < min_batch, F.col("score")).otherwise(mapped)
    return rows.withColumn("score", out).drop("_live")


def min_positives(scores: DataFrame, count: int = 1, spread: float = 0.05) -> DataFrame:
    """The top ``count`` lifted above 0.5 where fewer are and the batch is not flat."""
    if count <= 0:
        return scores
    batch = Window.partitionBy("batch_id")
    n, positive = F.count("*").over(batch), F.sum((F.col("score") >= 0.5).cast("int")).over(batch)
    k = F.least(F.lit(count), n)
    flat = F.max("score").over(batch) - F.min("score").over(batch) < spread
    place = F.row_number().over(batch.orderBy(F.desc("score"), "idx")) - 1
    lifted = F.when((place < k) & (F.col("score") < 0.5), 0.5 + 0.01 * (k - place) / k).otherwise(F.col("score"))
    return scores.withColumn("score", F.when((positive >= k) | flat, F.col("score")).otherwise(S.clamp01(lifted)))


def positive_budget(scores: DataFrame, fraction: float = 0.16) -> DataFrame:
    """At most the fraction of each batch stays at 0.5 or above; the rest of the positives is squeezed below, in order."""
    if fraction >= 1:
        return scores
    batch = Window.partitionBy("batch_id")
    above = F.col("score") >= 0.5
    k = F.greatest(F.lit(1), F.floor(F.lit(fraction) * F.count("*").over(batch)))
    m = F.sum(above.cast("int")).over(batch) - k
    low = F.least(F.coalesce(F.max(F.when(~above, F.col("score"))).over(batch), F.lit(0.45)), F.lit(0.499))
    place = F.row_number().over(batch.orderBy(F.desc("score"), "idx")) - 1 - k
    squeezed = low + (0.5 - low) * (m - place) / (m + 1)
    return scores.withColumn("score", F.when(above & (m > 0) & (place >= 0), S.clamp01(squeezed)).otherwise(F.col("score")))


def served(scores: DataFrame, threshold: Column, count: int = 1, fraction: float = 0.16) -> DataFrame:
    """Recentred at the threshold, empty groups fixed, at least count and at most the fraction of positives."""
    rows = scores.withColumn("score", S.recentred(F.col("score"), threshold))
    if "is_live" in scores.columns:
        rows = rows.withColumn("score", F.when(F.col("is_live"), F.col("score")).otherwise(EMPTY_SCORE))
    return positive_budget(min_positives(rows, count), fraction)


def soft_vote(weights: Mapping[str, float]) -> Column:
    """Weighted mean of probability columns."""
    return sum((F.col(c) * w for c, w in weights.items()), F.lit(0.0)) / sum(weights.values())


def log_odds_blend(weights: Mapping[str, float]) -> Column:
    return S.sigmoid(sum((S.logit(F.col(c)) * w for c, w in weights.items()), F.lit(0.0)) / sum(weights.values()))


def rank_blend(weights: Mapping[str, float]) -> Column:
    """Weighted mean of ranks within the batch."""
    return sum((rank01(c) * w for c, w in weights.items()), F.lit(0.0)) / sum(weights.values())


def neutral_on_failure(score: Column) -> Column:
    return F.coalesce(score, F.lit(0.5))
