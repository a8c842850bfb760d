"""Exact ranking metrics over (label, score), by any grouping.

Scores first sum to one row a distinct score, so ties are exact; what stands before a score comes from running sums over ranges
(``prefix.running_by_value``), so one very large group is no single task. Thresholds and rank correlations are read off the same counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqspark.operators.prefix import running_by_value


def score_steps(scores: DataFrame, by: list[str]) -> DataFrame:
    """A row a distinct score: pos, neg, and cumulative tp, fp from the highest score down; p, n are the totals."""
    steps = scores.groupBy(*by, "score").agg(F.sum("label").alias("pos"), F.sum(1 - F.col("label")).alias("neg"))
    return running_by_value(steps, by, "score", {"tp": "pos", "fp": "neg"}, {"p": "pos", "n": "neg"}, descending=True, of=scores)


def ranking_metrics(scores: DataFrame, by: list[str], max_fpr: float = 0.05) -> DataFrame:
    """by, n_rows, n_pos, auc, ap, recall_at_fpr; null where a class is missing."""
    return metrics_of_steps(score_steps(scores, by), by, max_fpr)


def metrics_of_steps(steps: DataFrame, by: list[str], max_fpr: float = 0.05) -> DataFrame:
    """ranking_metrics of what ``score_steps`` makes."""
    area = F.sum(F.col("neg") * (F.col("tp") - F.col("pos") / 2)) / (F.max("p") * F.max("n"))
    precision = F.col("tp") / (F.col("tp") + F.col("fp"))
    reached = F.max(F.when(F.col("fp") <= max_fpr * F.col("n"), F.col("tp") / F.col("p")).otherwise(0.0))
    some = (F.max("p") > 0) & (F.max("n") > 0)
    return steps.groupBy(*by).agg(
        F.sum(F.col("pos") + F.col("neg")).alias("n_rows"), F.sum("pos").alias("n_pos"), F.when(some, area).alias("auc"),
        F.when(F.max("p") > 0, F.sum(F.col("pos") * precision) / F.max("p")).alias("ap"), F.when(some, reached).alias("recall_at_fpr"),
    )


def hard_metrics(scores: DataFrame, by: list[str], at: float = 0.5) -> DataFrame:
    """by, hard_fpr, hard_recall, positive_rate of the decision score >= at."""
    called = (F.col("score") >= at).cast("double")
    return scores.groupBy(*by).agg(
        F.avg(F.when(F.col("label") == 0, called)).alias("hard_fpr"), F.avg(F.when(F.col("label") == 1, called)).alias("hard_recall"), F.avg(called).alias("positive_rate")
    )


def reward(ap: Column, recall: Column, fpr: Column, weights: tuple[float, float, float] = (0.35, 0.30, 0.35), cliff: float = 0.10) -> Column:
    """Weighted mean of average precision, recall at the allowed FPR, and safety (1 without false positives, 0 at the cliff)."""
    safety = F.greatest(F.lit(0.0), 1 - fpr / cliff)
    return weights[0] * ap + weights[1] * recall + weights[2] * safety


def _negative_steps(scores: DataFrame, by: list[str]) -> DataFrame:
    """by, score, upto (negatives at or below the score), n (negatives) over the distinct scores."""
    negative = F.when((F.col("label") == 0) & F.col("score").isNotNull(), 1).otherwise(0)
    steps = scores.groupBy(*by, "score").agg(F.sum(negative).alias("neg"))
    return running_by_value(steps, by, "score", {"upto": "neg"}, {"n": "neg"}, of=scores)


def order_threshold(scores: DataFrame, by: list[str], max_fpr: float = 0.05) -> DataFrame:
    """by, threshold: just above the ceil(n (1 - max_fpr))-th negative; 0.5 without negatives."""
    place = F.least(F.col("n"), F.greatest(F.ceil(F.col("n") * (1 - max_fpr)), F.lit(1)))
    chosen = F.min(F.when((F.col("n") > 0) & (F.col("upto") >= place), F.col("score"))) + 1e-9
    return _negative_steps(scores, by).groupBy(*by).agg(F.coalesce(chosen, F.lit(0.5)).alias("threshold"))


def quantile_threshold(scores: DataFrame, by: list[str], max_fpr: float = 0.05) -> DataFrame:
    """by, threshold: the interpolated quantile of the negatives; 0.5 without negatives."""
    at = (F.col("n") - 1) * (1 - max_fpr)
    some = F.col("n") > 0
    low, high = (F.min(F.when(some & (F.col("upto") > edge), F.col("score"))) for edge in (F.floor(at), F.ceil(at)))
    both = _negative_steps(scores, by).groupBy(*by).agg(low.alias("_low"), high.alias("_high"), F.max(at - F.floor(at)).alias("_part"))
    return both.select(*by, F.coalesce(F.col("_low") * (1 - F.col("_part")) + F.col("_high") * F.col("_part"), F.lit(0.5)).alias("threshold"))


def release_report(scores: DataFrame, min_rows: int = 20) -> DataFrame:
    """A row a release with enough rows and both classes: all metrics and the reward."""
    out = ranking_metrics(scores, ["release"]).join(hard_metrics(scores, ["release"]), "release")
    out = out.where((F.col("n_rows") >= min_rows) & (F.col("n_pos") > 0) & (F.col("n_pos") < F.col("n_rows")))
    return out.withColumn("reward", reward(F.col("ap"), F.col("recall_at_fpr"), F.col("hard_fpr")))


def report_summary(report: DataFrame) -> DataFrame:
    """n_releases, mean, size-weighted mean, min and max reward, worst FPR."""
    return report.agg(
        F.count("*").alias("n_releases"), F.avg("reward").alias("mean_reward"), (F.sum(F.col("reward") * F.col("n_rows")) / F.sum("n_rows")).alias("weighted_reward"),
        F.min("reward").alias("min_reward"), F.max("reward").alias("max_reward"), F.max("hard_fpr").alias("worst_fpr"),
    )


def feature_long(rows: DataFrame, keys: list[str], features: list[str]) -> DataFrame:
    """keys, feature, value."""
    return rows.unpivot(keys, features, "feature", "value")


def feature_shift(live: DataFrame, bench: DataFrame) -> DataFrame:
    """feature, mu_live, mu_bench, sd_bench, z of two long tables (feature, value)."""
    a = live.groupBy("feature").agg(F.avg("value").alias("mu_live"))
    b = bench.groupBy("feature").agg(F.avg("value").alias("mu_bench"), F.stddev_pop("value").alias("sd_bench"))
    return a.join(b, "feature").withColumn("z", F.abs(F.col("mu_live") - F.col("mu_bench")) / (F.col("sd_bench") + 1e-9))


def steady_features(shift: DataFrame, max_z: float = 5.0) -> DataFrame:
    return shift.where(F.col("z") <= max_z).select("feature")


def rank_correlations(rows: DataFrame, min_rows: int = 8) -> DataFrame:
    """feature, release, rho: Spearman's correlation of value and label (0 or 1) by average ranks; constant features have none.

    One row a distinct value: its mid-rank is what stands before it and half of itself, and the labels have two ranks, told by their counts."""
    keys = ["feature", "release"]
    values = rows.groupBy(*keys, "value").agg(F.count("*").alias("k"), F.sum(F.col("label").cast("long")).alias("k1"))
    values = running_by_value(values, keys, "value", {"upto": "k"}, {"n": "k", "n1": "k1"}, of=rows)
    n, n1 = F.col("n"), F.col("n1")
    x = F.col("upto") - (F.col("k") - 1) / 2 - (n + 1) / 2
    low, high = -n1 / 2, (n - n1) / 2  # the labels' ranks less the mean rank
    agreed = F.sum(x * ((F.col("k") - F.col("k1")) * low + F.col("k1") * high))
    spread = F.sum(F.col("k") * x * x)
    out = values.groupBy(*keys).agg(F.max("n").alias("n"), F.max("n1").alias("n1"), agreed.alias("sxy"), spread.alias("sxx"))
    syy = (n - n1) * low * low + n1 * high * high
    out = out.where((n >= min_rows) & (n1 > 0) & (n1 < n) & (F.col("sxx") > 0))
    return out.select(*keys, (F.col("sxy") / F.sqrt(F.col("sxx") * syy)).alias("rho"))


def steady_signs(correlations: DataFrame, min_releases: int = 4, min_rho: float = 0.04, agree: float = 0.70) -> DataFrame:
    """feature, mean_rho, sign (0 where it is weak or unsteady)."""
    mean = F.avg("rho").over(Window.partitionBy("feature"))
    rows = correlations.withColumn("mean_rho", mean).withColumn("same", (F.signum("rho") == F.signum("mean_rho")).cast("double"))
    out = rows.groupBy("feature").agg(F.first("mean_rho").alias("mean_rho"), F.count("*").alias("n"), F.avg("same").alias("agreement"))
    steady = (F.col("n") >= min_releases) & (F.abs("mean_rho") >= min_rho) & (F.col("agreement") >= agree)
    return out.select("feature", "mean_rho", F.when(steady, F.signum("mean_rho").cast("int")).otherwise(0).alias("sign"))


def attention_pool(rows: DataFrame, weight: str, features: list[str]) -> DataFrame:
    """Per group, the softmax-weighted and the plain mean of features; weight is a column of logits."""
    top = F.max(weight).over(Window.partitionBy("group_id"))
    rows = rows.withColumn("_w", F.exp(F.col(weight) - top))
    pooled = [(F.sum(F.col("_w") * F.col(c)) / F.sum("_w")).alias(f"att_{c}") for c in features]
    return rows.groupBy("group_id").agg(*pooled, *[F.avg(c).alias(f"avg_{c}") for c in features])


def profile(groups: DataFrame) -> DataFrame:
    """Rows, positives, releases and hands a group (median, tenth and ninetieth percentile) of a labelled set."""
    return groups.agg(
        F.count("*").alias("n_groups"), F.sum("label").alias("n_pos"), F.countDistinct("release").alias("n_releases"),
        *[F.percentile("n_hands", q).alias(f"hands_p{int(q * 100)}") for q in (0.1, 0.5, 0.9)],
    )
