"""Which blend weights serve best: every candidate is scored, thresholded, served and rewarded by itself."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqspark.functions import scalars as S
from seqspark.operators import metrics
from seqspark.operators.prefix import running_by_value
from seqspark.sources.io import written


def candidate_scores(parts: DataFrame, grid: DataFrame, names: list[str]) -> DataFrame:
    """candidate, idx, label, score: the log-odds blend of the parts by each row of a small grid of weights."""
    logits = parts.select("idx", "label", *[S.logit(F.col(n)).alias(f"_z_{n}") for n in names])
    cores = parts.sparkSession.sparkContext.defaultParallelism
    if parts.rdd.getNumPartitions() < cores:  # every row becomes as many as the grid has: few splits would do all that work
        logits = logits.repartition(cores, "idx")
    both = logits.crossJoin(F.broadcast(grid))
    total = sum((F.col(n) for n in names), F.lit(0))
    z = sum((F.col(n) * F.col(f"_z_{n}") for n in names), F.lit(0.0)) / total
    return both.select("candidate", "idx", "label", S.sigmoid(z).alias("score"))


def rewarded(blended: DataFrame, max_fpr: float = 0.05, count: int = 1, fraction: float = 0.16, spread: float = 0.05) -> DataFrame:
    """candidate, threshold, reward and its parts of the served scores of each candidate: as ``scores.served`` and the metrics would give.

    All rows are placed once, by ranges of scores, and written. Serving keeps their order, so thresholds, positives, budgets and the metrics of the
    served scores are sums and extremes over places: no candidate sorts its rows in one task."""
    rows = blended.select("candidate", "idx", "label", "score").withColumn("one", F.lit(1).cast("long"))
    sums = {"place": "one", "tp": "label"}
    like = blended.where("candidate = 0")  # the prior: where its scores lie, the others' do too, near enough to cut ranges
    rows = written(running_by_value(rows, ["candidate"], "score", sums, {"n": "one", "p": "label"}, descending=True, of=like, then=[F.asc("idx")]).drop("one"))
    negatives = F.col("n") - F.col("p")
    rank = F.when(F.col("label") == 0, negatives - (F.col("place") - F.col("tp")))  # of a negative, from the lowest up
    at = (negatives - 1) * (1 - max_fpr)
    low, high = (F.max(F.when(rank == edge, F.col("score"))) for edge in (F.floor(at), F.ceil(at)))
    ends = rows.groupBy("candidate").agg(low.alias("low"), high.alias("high"), F.max(at - F.floor(at)).alias("part"))
    thresholds = ends.select("candidate", F.coalesce(F.col("low") * (1 - F.col("part")) + F.col("high") * F.col("part"), F.lit(0.5)).alias("threshold"))
    thresholds = written(thresholds)  # a row a candidate

    centred = rows.join(F.broadcast(thresholds), "candidate").withColumn("s", S.recentred(F.col("score"), F.col("threshold")))
    least = F.least(F.lit(count), F.col("n"))
    facts = centred.groupBy("candidate").agg(
        F.sum((F.col("s") >= 0.5).cast("long")).alias("called"), (F.max("s") - F.min("s")).alias("wide"), F.max(least).alias("least"), F.max(F.greatest(F.lit(1), F.floor(fraction * F.col("n")))).alias("budget"),
        F.max(F.when(F.col("s") < 0.5, F.col("s"))).alias("below"), F.max(F.when((F.col("s") < 0.5) & (F.col("place") > least), F.col("s"))).alias("below_lifted"),
    )
    lifts = (F.col("called") < F.col("least")) & (F.col("wide") >= spread)
    facts = facts.withColumn("lifts", lifts).withColumn("over", F.when(lifts, F.col("least")).otherwise(F.col("called")) - F.col("budget"))
    facts = facts.withColumn("floor", F.least(F.coalesce(F.when(F.col("lifts"), F.col("below_lifted")).otherwise(F.col("below")), F.lit(0.45)), F.lit(0.499)))

    known = centred.join(F.broadcast(facts), "candidate")
    first = F.col("place") - 1
    lifted = F.when(F.col("lifts") & (first < F.col("least")) & (F.col("s") < 0.5), S.clamp01(0.5 + 0.01 * (F.col("least") - first) / F.col("least"))).otherwise(F.col("s"))
    known = known.withColumn("s", lifted)
    beyond = first - F.col("budget")
    squeezed = F.col("floor") + (0.5 - F.col("floor")) * (F.col("over") - beyond) / (F.col("over") + 1)
    known = known.withColumn("s", F.when((F.col("s") >= 0.5) & (F.col("over") > 0) & (beyond >= 0), S.clamp01(squeezed)).otherwise(F.col("s")))

    steps = known.groupBy("candidate", "s").agg(F.sum("label").alias("pos"), F.sum(1 - F.col("label")).alias("neg"), F.max("tp").alias("tp"), F.max("place").alias("place"), F.max("p").alias("p"), F.max(negatives).alias("n"))
    steps = steps.withColumn("fp", F.col("place") - F.col("tp"))
    called = F.col("s") >= 0.5
    hard = steps.groupBy("candidate").agg(
        (F.sum(F.when(called, F.col("neg")).otherwise(0)) / F.max("n")).alias("hard_fpr"), (F.sum(F.when(called, F.col("pos")).otherwise(0)) / F.max("p")).alias("hard_recall"),
        (F.sum(F.when(called, F.col("pos") + F.col("neg")).otherwise(0)) / F.sum(F.col("pos") + F.col("neg"))).alias("positive_rate"),
    )
    ranked = metrics.metrics_of_steps(steps, ["candidate"], max_fpr).join(hard, "candidate").join(F.broadcast(thresholds), "candidate")
    return ranked.withColumn("reward", metrics.reward(F.col("ap"), F.col("recall_at_fpr"), F.col("hard_fpr")))


def chosen(rewards: DataFrame, margin: float = 0.002) -> DataFrame:
    """The best candidate (lowest id on ties) if it beats the prior (0) by more than the margin, else the prior."""
    best = rewards.orderBy(F.desc("reward"), "candidate").limit(1).select(F.col("candidate").alias("best"), F.col("reward").alias("best_reward"))
    prior = rewards.where("candidate = 0").select(F.col("reward").alias("prior_reward"))
    both = best.crossJoin(prior)
    wins = F.col("best_reward") > F.col("prior_reward") + margin
    return both.select(F.when(wins, F.col("best")).otherwise(F.lit(0)).alias("candidate"), "best_reward", "prior_reward")


def linear_sweep(rows: DataFrame, first: str, second: str, weights: list[float]) -> DataFrame:
    """w, auc of (1 - w) first + w second for each weight."""
    spark = rows.sparkSession
    grid = spark.createDataFrame([(float(w),) for w in weights], "w double")
    both = rows.select("label", first, second).crossJoin(F.broadcast(grid))
    blended = both.select("w", "label", ((1 - F.col("w")) * F.col(first) + F.col("w") * F.col(second)).alias("score"))
    return metrics.ranking_metrics(blended, ["w"]).select("w", "auc")
