"""Boosted trees with gradients of our own: a ranker by average precision within releases, and trees that keep the signs of features.

A round takes each row's gradient and curvature at its score so far and fits MLlib's regression tree on their quotient, weighted by the curvature,
so a leaf's mean is a Newton step. A fitted tree is a small tree of cuts, written as a column: scoring is one expression. The driver holds trees, never rows.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, replace

from pyspark.ml import Pipeline
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import DecisionTreeRegressor
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqspark.operators import sets
from seqspark.plans.learners import Scorer, feature_stages

#: Steps between the least and the greatest score within which the ranker tells scores apart: what it holds of a release is bounded by them.
STEPS = 512


@dataclass(frozen=True)
class Node:
    """A leaf (no children), or a cut: values up to ``threshold`` go left. ``value`` is the mean of the rows that reach the node."""

    value: float
    feature: int = -1
    threshold: float = 0.0
    left: Node | None = None
    right: Node | None = None


def tree_of(model) -> Node:
    """The cuts of a fitted regression tree on continuous features."""

    def of(node) -> Node:
        if node.subtreeDepth() == 0:
            return Node(float(node.prediction()))
        cut = node.split()
        return Node(float(node.prediction()), int(cut.featureIndex()), float(cut.threshold()), of(node.leftChild()), of(node.rightChild()))

    return of(model._java_obj.rootNode())


def value_of(tree: Node, x: Column) -> Column:
    """The value of the leaf that an array of features reaches."""
    if tree.left is None:
        return F.lit(tree.value)
    return F.when(x[tree.feature] <= tree.threshold, value_of(tree.left, x)).otherwise(value_of(tree.right, x))


def leaves(tree: Node) -> list[float]:
    return [tree.value] if tree.left is None else leaves(tree.left) + leaves(tree.right)


def _clipped(tree: Node, low: float, high: float) -> Node:
    value = min(max(tree.value, low), high)
    return replace(tree, value=value) if tree.left is None else replace(tree, value=value, left=_clipped(tree.left, low, high), right=_clipped(tree.right, low, high))


def signed(tree: Node, signs: Sequence[int]) -> Node:
    """The tree with leaves that keep the signs: of a cut of a feature with sign 1 no leaf on the left is above one on the right, with -1 none below.

    From the leaves up: where a cut breaks its sign, its two sides are clipped at the mean of its rows. Clipping keeps the order of leaves, so
    what holds below still holds."""
    if tree.left is None:
        return tree
    tree = replace(tree, left=signed(tree.left, signs), right=signed(tree.right, signs))
    sign, far = signs[tree.feature], float("inf")
    if sign > 0 and max(leaves(tree.left)) > min(leaves(tree.right)):
        return replace(tree, left=_clipped(tree.left, -far, tree.value), right=_clipped(tree.right, tree.value, far))
    if sign < 0 and min(leaves(tree.left)) < max(leaves(tree.right)):
        return replace(tree, left=_clipped(tree.left, tree.value, far), right=_clipped(tree.right, -far, tree.value))
    return tree


def _margin(trees: Sequence[Node], rate: float, x: Column) -> Column:
    return sum((rate * value_of(t, x) for t in trees), F.lit(0.0))


def boost(rows: DataFrame, gradients: Callable[[DataFrame], DataFrame], rounds: int, depth: int, rate: float, seed: int, signs: Sequence[int] | None = None) -> list[Node]:
    """The trees of some rounds over rows with ``features`` (a vector). ``gradients`` gives rows with ``margin`` the columns ``g`` and ``h``, the
    slope upwards and the curvature; rows without curvature do not count. With signs each tree keeps them."""
    trees: list[Node] = []
    for i in range(rounds):
        now = gradients(rows.withColumn("margin", _margin(trees, rate, vector_to_array("features")))).where("h > 0")
        now = now.select("features", (F.col("g") / F.col("h")).alias("_step"), F.col("h").alias("_curvature"))
        tree = tree_of(DecisionTreeRegressor(labelCol="_step", weightCol="_curvature", maxDepth=depth, seed=seed + i).fit(now))
        trees.append(tree if signs is None else signed(tree, signs))
    return trees


def rank_gradients(rows: DataFrame, steps: int = STEPS) -> DataFrame:
    """release, step, label, score, g, h: the lambda gradients of rows with release, margin, label (0 or 1), for each release, step and label.

    For each pair of a positive and a negative of one release, the change in average precision if they changed places, times the logistic slope (g) and
    curvature (h) of their difference in score; g is negative for negatives. Scores within a step are one, their mean, and its rows are spread evenly over the
    places that they take up together. The change is a difference of a term of the one and a term of the other, so pairs are summed step against
    step, and a release is a row of at most ``steps`` + 1 steps, whatever its size. Releases without both labels give no rows; those of a null release or label do not count."""
    rows = rows.where("release IS NOT NULL AND label IS NOT NULL AND margin IS NOT NULL")
    ends = rows.agg(F.min("margin").alias("low"), F.max("margin").alias("high")).first()
    low, width = ends["low"] or 0.0, max((ends["high"] or 0.0) - (ends["low"] or 0.0), 1e-12) / steps
    per = rows.groupBy("release", F.floor((F.col("margin") - low) / width).alias("step")).agg(
        F.count("*").alias("k"), F.sum(F.col("label").cast("double")).alias("pos"), F.avg("margin").alias("score")
    )
    above = Window.partitionBy("release").orderBy(F.desc("step")).rowsBetween(Window.unboundedPreceding, -1)  # at most a row a step
    before = lambda c: F.coalesce(F.sum(c).over(above), F.lit(0.0))
    per = per.withColumn("_k", before("k")).withColumn("_m", before("pos")).withColumn("neg", F.col("k") - F.col("pos"))
    per = per.withColumn("r", F.col("_k") + (F.col("k") + 1) / 2)
    per = per.withColumn("_c", before(F.col("pos") / F.col("r")))
    # what a swap changes: a negative's terms if it stands above (na) or below (nb) the positive, the positive's likewise (pb, pa)
    m_n, c_n = F.col("_m") + F.col("pos") / 2, F.col("_c") + F.col("pos") / 2 / F.col("r")
    m_p, c_p = F.col("_m") + (F.col("pos") + 1) / 2, F.col("_c") + (F.col("pos") - 1) / 2 / F.col("r")
    per = per.withColumn("na", (m_n + 1) / F.col("r") - c_n).withColumn("pb", m_p / F.col("r") - c_p)
    per = per.withColumn("pa", m_p / F.col("r") - c_p - 1 / F.col("r")).withColumn("nb", m_n / F.col("r") - c_n)
    # within a step the upper and the lower of two stand at a third and two thirds of it
    upper, lower, third = F.col("_k") + (F.col("k") + 1) / 3, F.col("_k") + 2 * (F.col("k") + 1) / 3, F.col("pos") / 3
    same = (F.col("_m") + third + 1) / upper - (F.col("_m") + 2 * third + 1) / lower + third / F.col("r")
    per = per.withColumn("same", same)
    one = F.struct("step", "score", "pos", "neg", "na", "nb", "pa", "pb", "same")
    whole = per.groupBy("release").agg(F.collect_list(one).alias("all"), F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"))
    mine = whole.where("n_pos > 0 AND n_neg > 0").withColumn("x", F.explode("all"))
    x, y = F.col("x"), "all"

    def summed(label: int, curvature: bool) -> Column:
        def term(t: Column) -> Column:
            over = x["step"] > t["step"]  # the row's own step is the higher one
            if label:
                change = F.when(over, x["pa"] - t["nb"]).when(x["step"] < t["step"], t["na"] - x["pb"]).otherwise(x["same"])
                slope = 1 / (1 + F.exp(x["score"] - t["score"]))
            else:
                change = F.when(over, x["na"] - t["pb"]).when(x["step"] < t["step"], t["pa"] - x["nb"]).otherwise(x["same"])
                slope = 1 / (1 + F.exp(t["score"] - x["score"]))
            return (t["neg"] if label else t["pos"]) * F.abs(change) * (slope * (1 - slope) if curvature else slope)

        total = F.aggregate(y, F.lit(0.0), lambda s, t: s + term(t)) / F.col("n_pos")
        return total if label or curvature else -total

    sides = [F.struct(F.lit(k).alias("label"), x["pos" if k else "neg"].alias("n"), summed(k, False).alias("g"), summed(k, True).alias("h")) for k in (0, 1)]
    out = mine.select("release", x["step"].alias("step"), x["score"].alias("score"), F.explode(F.array(*sides)).alias("s"))
    out = out.where("s.n > 0").select("release", "step", F.col("s.label").alias("label"), "score", F.col("s.g").alias("g"), F.col("s.h").alias("h"))
    return out.withColumn("_low", F.lit(low)).withColumn("_width", F.lit(width))


def _with_rank_gradients(rows: DataFrame, steps: int) -> DataFrame:
    found = rank_gradients(rows, steps)
    low, width = F.col("_low"), F.col("_width")
    named = found.select(F.col("release").alias("_release"), F.col("step").alias("_step"), F.col("label").alias("_label"), "g", "h", low, width)
    same = (F.col("release") == F.col("_release")) & (F.col("label") == F.col("_label")) & (F.floor((F.col("margin") - low) / width) == F.col("_step"))
    return rows.join(named, same)


def lambda_ranker(columns: Sequence[str], rounds: int = 10, depth: int = 3, rate: float = 0.3, seed: int = 5, to: str = "score", steps: int = STEPS) -> Callable[[DataFrame], Scorer]:
    """Trees boosted towards the average precision within each release; the score is the sigmoid of their sum. Missing features are the median; each release counts
    alike, and without one that has both labels nothing can be learned, which is an error."""

    def fitted(train: DataFrame) -> Scorer:
        stages = Pipeline(stages=feature_stages(columns, scaled=False)).fit(train)
        rows = stages.transform(train).select("release", "label", "features").persist()
        try:
            if rows.groupBy("release").agg(F.countDistinct("label").alias("n")).where("n = 2").isEmpty():
                raise ValueError("no release has rows of both labels")
            trees = boost(rows, lambda r: _with_rank_gradients(r, steps), rounds, depth, rate, seed)
        finally:
            rows.unpersist()
        return _scorer(stages, trees, rate, to)

    return fitted


def _scorer(stages, trees: Sequence[Node], rate: float, to: str) -> Scorer:
    def score(rows: DataFrame) -> DataFrame:
        p = 1 / (1 + F.exp(-_margin(trees, rate, vector_to_array("features"))))
        return stages.transform(rows).select(*[c for c in rows.columns if c != to], p.alias(to))

    return score


def _logistic(rows: DataFrame) -> DataFrame:
    p = 1 / (1 + F.exp(-F.col("margin")))
    return rows.withColumn("g", F.col("weight") * (F.col("label") - p)).withColumn("h", F.col("weight") * p * (1 - p))


def monotone_trees(
    columns: Sequence[str], signs: Mapping[str, int], seeds: Sequence[int] = (1, 2, 3), rounds: int = 10, depth: int = 3, rate: float = 0.3, to: str = "score", keys: Sequence[str] = ("group_id",)
) -> Callable[[DataFrame], Scorer]:
    """A committee of boosted trees, each on a bootstrap of the rows drawn by their keys, whose score never falls when a feature moves the way of its
    sign. Features of sign 0 are left out; missing ones are the median. Averaged over the seeds; without any signed feature all scores are 0.5."""
    used = [c for c in columns if signs.get(c, 0)]

    def fitted(train: DataFrame) -> Scorer:
        if not used:
            return lambda rows: rows.withColumn(to, F.lit(0.5))
        stages = Pipeline(stages=feature_stages(used, scaled=False)).fit(train)
        rows = stages.transform(train).select("label", "features", *[k for k in keys if k != "label"]).where("label IS NOT NULL").persist()
        try:
            members = [boost(sets.bootstrap(rows, s, keys), _logistic, rounds, depth, rate, s, [signs[c] for c in used]) for s in seeds]
        finally:
            rows.unpersist()

        def score(rows: DataFrame) -> DataFrame:
            x = vector_to_array("features")
            p = sum((1 / (1 + F.exp(-_margin(trees, rate, x))) for trees in members), F.lit(0.0)) / len(members)
            return stages.transform(rows).select(*[c for c in rows.columns if c != to], p.alias(to))

        return score

    return fitted
