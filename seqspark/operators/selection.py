"""Which rows, releases, candidates and columns take part; which model may replace another."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def before_release(rows: DataFrame, release: str) -> DataFrame:
    return rows.where(F.col("release") < release)


def of_release(rows: DataFrame, release: str) -> DataFrame:
    return rows.where(F.col("release") == release)


def holdout(rows: DataFrame) -> DataFrame:
    """rows with is_holdout: the validation split where there is one, else the newest release."""
    facts = rows.agg(F.max("release").alias("_newest"), F.max((F.col("split") == "validation").cast("int")).alias("_split"))
    rows = rows.crossJoin(F.broadcast(facts))
    return rows.withColumn("is_holdout", F.when(F.col("_split") == 1, F.col("split") == "validation").otherwise(F.col("release") == F.col("_newest"))).drop("_newest", "_split")


def eligible_releases(rows: DataFrame, min_rows: int = 20) -> DataFrame:
    """release, n_rows, n_pos of the releases with enough rows and both classes."""
    out = rows.groupBy("release").agg(F.count("*").alias("n_rows"), F.sum("label").alias("n_pos"))
    return out.where((F.col("n_rows") >= min_rows) & (F.col("n_pos") > 0) & (F.col("n_pos") < F.col("n_rows")))


def eligible_folds(rows: DataFrame, min_train: int = 60) -> DataFrame:
    """release, n_train of the releases before which there are enough rows of both classes."""
    per = rows.groupBy("release").agg(F.count("*").alias("n"), F.sum("label").alias("pos"))
    past = Window.partitionBy(F.lit(1)).orderBy("release").rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("n_train", F.coalesce(F.sum("n").over(past), F.lit(0))).withColumn("pos_train", F.coalesce(F.sum("pos").over(past), F.lit(0)))
    return per.where((F.col("n_train") >= min_train) & (F.col("pos_train") > 0) & (F.col("pos_train") < F.col("n_train"))).select("release", "n_train")


def latest_releases(rows: DataFrame, k: int) -> DataFrame:
    return rows.select("release").distinct().orderBy(F.desc("release")).limit(k)


def release_order(rows: DataFrame, order: str) -> DataFrame:
    """release, first_idx, size, in the order in which releases are first seen."""
    return rows.groupBy("release").agg(F.min(order).alias("first_idx"), F.count("*").alias("size"))


def grouped_folds(rows: DataFrame, k: int) -> DataFrame:
    """release, n, fold: whole releases dealt to k folds by falling size, back and forth, so that folds are even."""
    per = rows.groupBy("release").agg(F.count("*").alias("n"))
    place = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.desc("n"), "release")) - 1
    per = per.withColumn("_p", place)
    turn = F.floor(F.col("_p") / k) % 2
    return per.select("release", "n", F.when(turn == 0, F.col("_p") % k).otherwise(k - 1 - F.col("_p") % k).cast("int").alias("fold"))


def covered(rows: DataFrame, column: str) -> DataFrame:
    return rows.where(F.col(column).isNotNull())


def best(candidates: DataFrame, *order) -> DataFrame:
    return candidates.orderBy(*order).limit(1)


def empty_groups(features: DataFrame, columns: list[str]) -> DataFrame:
    """features with is_live: some column is not 0."""
    return features.withColumn("is_live", F.greatest(*[F.abs(F.coalesce(c, F.lit(0.0))) for c in columns]) > 0)


def without(columns: list[str], parts: list[str] = (), names: list[str] = ()) -> list[str]:
    """Columns whose name holds none of the parts and is none of the names."""
    return [c for c in columns if c not in names and not any(p in c for p in parts)]


def feature_views(columns: list[str]) -> dict[str, list[str]]:
    """The hero's features, those of all actors and redundancy, and both."""
    wide = [c for c in columns if c.startswith(("hf_", "rp_"))]
    return {"PH": [c for c in columns if c not in wide], "V2": wide, "UN": list(columns)}


def gate_reasons(metrics: DataFrame, max_fpr: float = 0.06, min_rate: float = 0.02) -> DataFrame:
    """metrics with reasons: why a candidate fails on its own figures."""
    failed = F.array(
        F.when(F.col("safety") <= 0, "safety"), F.when(F.col("hard_fpr") >= max_fpr, "hard_fpr"),
        F.when(F.col("positive_rate") < min_rate, "positive_rate"), F.when(F.col("hard_recall") <= 0, "hard_recall"),
    )
    return metrics.withColumn("reasons", F.filter(failed, lambda x: x.isNotNull()))


def promotion(candidates: DataFrame, baseline: DataFrame, epsilon: float = 0.002, fpr_gain: float = 0.010, allowed_drop: float = 0.010) -> DataFrame:
    """candidates (gate_reasons' result, with forced) with regression and accepted, against a baseline of one row or none.

    A lower reward is a regression, unless the FPR is better by fpr_gain and the drop is at most allowed_drop. Accepted is what is
    forced, has no reason against it, or has nothing to replace.
    """
    base = baseline.select(F.col("reward").alias("base_reward"), F.col("hard_fpr").alias("base_fpr"), F.lit(1).alias("_one"))
    rows = candidates.withColumn("_one", F.lit(1)).join(F.broadcast(base), "_one", "left").drop("_one")
    drop, gain = F.col("base_reward") - F.col("reward"), F.col("base_fpr") - F.col("hard_fpr")
    excused = (gain >= fpr_gain) & (drop <= allowed_drop)
    rows = rows.withColumn("regression", F.coalesce((drop > epsilon) & ~excused, F.lit(False)))
    clean = (F.size("reasons") == 0) & ~F.col("regression")
    return rows.withColumn("accepted", F.col("forced") | clean | F.col("base_reward").isNull())


def newest(snapshots: DataFrame, order: str, keep: int = 10) -> DataFrame:
    return snapshots.orderBy(F.desc(order)).limit(keep)


def worst_case(metrics: DataFrame) -> DataFrame:
    """Gate figures: the worse of walk-forward and out-of-fold."""
    return metrics.select(
        "*", F.greatest("wf_hard_fpr", "oof_hard_fpr").alias("hard_fpr"), F.least("wf_safety", "oof_safety").alias("safety"),
        F.least("wf_hard_recall", "oof_hard_recall").alias("hard_recall"), F.least("wf_positive_rate", "oof_positive_rate").alias("positive_rate"),
    )


def decisions(promoted: DataFrame, at: str) -> DataFrame:
    """The record of a promotion (promotion's result): one row a candidate with its figures, reasons, verdict and time, to be appended to a history."""
    return promoted.select(F.lit(at).cast("timestamp").alias("decided_at"), "model", "reward", "hard_fpr", "reasons", "regression", "forced", "accepted")
