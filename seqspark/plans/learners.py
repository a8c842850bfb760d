"""Learners, out-of-fold and walk-forward plans, ensembles and searches with MLlib, on feature tables of named double columns.

A fitted scorer is a function of a DataFrame that adds one probability column. Fits run on the cluster; what loops here are folds,
releases and candidates, whose number does not grow with the rows. Fits that do not need each other's results run side by side (``at_once``).
"""

from __future__ import annotations

import random
import threading
from collections.abc import Callable, Iterable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from functools import partial, reduce

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import DecisionTreeClassifier, GBTClassifier, LinearSVC, LogisticRegression, MultilayerPerceptronClassifier, RandomForestClassifier
from pyspark.ml.feature import PCA, Imputer, StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Matrices
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqspark.functions import scalars as S
from seqspark.operators import metrics, scores, selection, sets
from seqspark.sources.io import written

Scorer = Callable[[DataFrame], DataFrame]

#: How many pipelines are fitted at a time. A fit is many short jobs one after the other, so one alone leaves most cores idle; each keeps its rows
#: cached while it lasts, so there is a bound.
FITS_AT_ONCE = 6
_SLOTS = threading.BoundedSemaphore(FITS_AT_ONCE)
#: Held by fits that call LAPACK on the driver (components, bounded coefficients): it sets itself up at its first call, and a second call meanwhile does
#: not converge.
_LAPACK = threading.Lock()


def at_once(calls: Iterable[Callable]) -> list:
    """What the calls return, in their order. They run side by side, in threads that inherit the session's job settings."""
    session = SparkSession.active()
    calls = [inheritable_thread_target(session)(c) for c in calls]
    with ThreadPoolExecutor(max(1, len(calls))) as pool:
        return [f.result() for f in [pool.submit(c) for c in calls]]


def fitted_pipeline(stages: list, train: DataFrame) -> PipelineModel:
    first = next((i + 1 for i, s in enumerate(stages) if isinstance(s, PCA)), 0)
    with _SLOTS:
        if not first:
            return Pipeline(stages=stages).fit(train)
        with _LAPACK:
            head = Pipeline(stages=stages[:first]).fit(train)
        tail = Pipeline(stages=stages[first:]).fit(head.transform(train))
        return PipelineModel([*head.stages, *tail.stages])


def feature_stages(columns: Sequence[str], scaled: bool = True, components: int | None = None) -> list:
    """Median imputation, one vector, scaling, principal components."""
    filled = [f"{c}_filled" for c in columns]
    stages = [Imputer(inputCols=list(columns), outputCols=filled, strategy="median"), VectorAssembler(inputCols=filled, outputCol="raw", handleInvalid="keep")]
    last = "raw"
    if scaled:
        stages.append(StandardScaler(inputCol=last, outputCol="scaled", withMean=True))
        last = "scaled"
    if components:
        stages.append(PCA(inputCol=last, outputCol="components", k=min(components, len(columns))))
        last = "components"
    stages[-1].setOutputCol("features")
    return stages


#: Name -> (estimator of a seed, whether features are scaled, principal components).
REGISTRY: dict[str, tuple[Callable, bool, int | None]] = {
    "logistic": (lambda seed, n: LogisticRegression(maxIter=100, regParam=0.01), True, None),
    "logistic_l1": (lambda seed, n: LogisticRegression(maxIter=100, regParam=0.01, elasticNetParam=1.0), True, None),
    "logistic_pca": (lambda seed, n: LogisticRegression(maxIter=100, regParam=0.01), True, 8),
    "svm": (lambda seed, n: LinearSVC(maxIter=50, regParam=0.01), True, None),
    "forest": (lambda seed, n: RandomForestClassifier(numTrees=40, maxDepth=6, seed=seed), False, None),
    "extra_trees": (lambda seed, n: RandomForestClassifier(numTrees=40, maxDepth=6, bootstrap=False, featureSubsetStrategy="sqrt", seed=seed), False, None),
    "boosted": (lambda seed, n: GBTClassifier(maxIter=20, maxDepth=3, stepSize=0.1, seed=seed), False, None),
    "boosted_deep": (lambda seed, n: GBTClassifier(maxIter=15, maxDepth=5, stepSize=0.1, subsamplingRate=0.8, seed=seed), False, None),
    "boosted_fine": (lambda seed, n: GBTClassifier(maxIter=15, maxDepth=3, maxBins=64, stepSize=0.1, seed=seed), False, None),
    "boosted_sampled": (lambda seed, n: GBTClassifier(maxIter=20, maxDepth=3, featureSubsetStrategy="onethird", seed=seed), False, None),
    "mlp": (lambda seed, n: MultilayerPerceptronClassifier(layers=[n, 16, 2], maxIter=60, seed=seed), True, None),
    "mlp_pca": (lambda seed, n: MultilayerPerceptronClassifier(layers=[min(n, 8), 8, 2], maxIter=60, seed=seed), True, 8),
}


def fit(name: str, train: DataFrame, columns: Sequence[str], seed: int = 1) -> PipelineModel:
    """A fitted learner of the registry. Where train has a column ``weight``, rows count by it."""
    make, scaled, components = REGISTRY[name]
    estimator = make(seed, len(columns)).setLabelCol("label").setFeaturesCol("features")
    if "weight" in train.columns:
        estimator = estimator.setWeightCol("weight")
    return fitted_pipeline([*feature_stages(columns, scaled, components), estimator], train)


def scored(model: PipelineModel, rows: DataFrame, to: str = "score") -> DataFrame:
    """rows with the probability of label 1 (a margin through the sigmoid where the learner has no probability)."""
    keep = rows.columns
    out = model.transform(rows)
    p = vector_to_array("probability")[1] if "probability" in out.columns else 1 / (1 + F.exp(-vector_to_array("rawPrediction")[1]))
    return out.select(*[c for c in keep if c != to], p.alias(to))


def out_of_fold(fit_one: Callable[[DataFrame], Scorer], rows: DataFrame, k: int = 3) -> DataFrame:
    """rows with what a model that has not seen their release adds to them. The rows are written with their folds once, and nothing stays cached."""
    folds = selection.grouped_folds(rows, k).select("release", "fold")
    rows = written(rows.join(F.broadcast(folds), "release"))

    def part(i: int) -> DataFrame:
        seen, held = (rows.where(c).drop("fold") for c in (F.col("fold") != i, F.col("fold") == i))
        return fit_one(seen)(held)

    return reduce(DataFrame.unionByName, at_once(partial(part, i) for i in range(k)))


def learner(name: str, columns: Sequence[str], seed: int = 1, to: str = "score") -> Callable[[DataFrame], Scorer]:
    def fit_one(train: DataFrame) -> Scorer:
        model = fit(name, train, columns, seed)
        return lambda rows: scored(model, rows, to)

    return fit_one


def calibrated(fit_one: Callable[[DataFrame], Scorer], k: int = 3) -> Callable[[DataFrame], Scorer]:
    """Platt scaling: a logistic regression of the label on out-of-fold scores."""

    def fitted(train: DataFrame) -> Scorer:
        oof, whole = at_once([lambda: out_of_fold(fit_one, train, k), lambda: fit_one(train)])
        line = fitted_pipeline([VectorAssembler(inputCols=["score"], outputCol="features"), LogisticRegression(labelCol="label")], oof)
        return lambda rows: scored(line, whole(rows))

    return fitted


def soft_vote(members: Mapping[str, tuple[Callable[[DataFrame], Scorer], float]]) -> Callable[[DataFrame], Scorer]:
    """Weighted mean of members' probabilities; each member adds a column of its name."""

    def fitted(train: DataFrame) -> Scorer:
        fits = dict(zip(members, at_once(partial(f, train) for f, _ in members.values()), strict=True))

        def score(rows: DataFrame) -> DataFrame:
            for f in fits.values():
                rows = f(rows)
            return rows.withColumn("score", scores.soft_vote({n: w for n, (_, w) in members.items()})).drop(*fits)

        return score

    return fitted


def stacked(members: Mapping[str, Callable[[DataFrame], Scorer]], k: int = 3, to: str = "score") -> Callable[[DataFrame], Scorer]:
    """A logistic regression over members' out-of-fold scores; each member adds a column of its name."""
    names = list(members)

    def fitted(train: DataFrame) -> Scorer:
        oof, whole = at_once([lambda: out_of_fold(together(members.values()), train, k).select("label", *names), lambda: together(members.values())(train)])
        meta = fitted_pipeline([VectorAssembler(inputCols=names, outputCol="features"), LogisticRegression(labelCol="label", regParam=0.01)], written(oof))
        return lambda rows: scored(meta, whole(rows), to).drop(*names)

    return fitted


def together(members: Iterable[Callable[[DataFrame], Scorer]]) -> Callable[[DataFrame], Scorer]:
    """Members that are fitted on the same rows and each add a column."""
    members = list(members)

    def fitted(train: DataFrame) -> Scorer:
        fits = at_once(partial(f, train) for f in members)
        return lambda rows: reduce(lambda out, f: f(out), fits, rows)

    return fitted


def signed_committee(columns: Sequence[str], signs: Mapping[str, int], seeds: Sequence[int] = (1, 2, 3), to: str = "score", keys: Sequence[str] = ("group_id",)) -> Callable[[DataFrame], Scorer]:
    """Logistic regressions on samples of the rows, drawn by their keys, whose coefficients keep each feature's sign (0: left out), averaged.
    Where no feature has a sign, every row is neutral (0.5)."""
    used = [c for c in columns if signs.get(c, 0)]
    if not used:
        return lambda train: lambda rows: rows.withColumn(to, F.lit(0.5))

    def fitted(train: DataFrame) -> Scorer:
        low = Matrices.dense(1, len(used), [0.0 if signs[c] > 0 else float("-inf") for c in used])
        high = Matrices.dense(1, len(used), [float("inf") if signs[c] > 0 else 0.0 for c in used])

        def one(seed: int) -> PipelineModel:
            regression = LogisticRegression(labelCol="label", maxIter=100, lowerBoundsOnCoefficients=low, upperBoundsOnCoefficients=high)
            with _LAPACK:
                return Pipeline(stages=[*feature_stages(used), regression]).fit(train.where(sets.drawn(seed, *keys) < 0.8))

        models = at_once(partial(one, seed) for seed in seeds)

        def score(rows: DataFrame) -> DataFrame:
            for i, m in enumerate(models):
                rows = scored(m, rows, f"_m{i}")
            names = [f"_m{i}" for i in range(len(models))]
            return rows.withColumn(to, scores.soft_vote(dict.fromkeys(names, 1.0))).drop(*names)

        return score

    return fitted


def feature_ends(train: DataFrame, columns: Sequence[str]) -> dict[str, tuple]:
    """The least and the greatest value of each feature (None without any), in one pass."""
    ends = train.agg(*[f(c).alias(f"{c}_{k}") for c in columns for k, f in (("low", F.min), ("high", F.max))]).first()
    return {c: (ends[f"{c}_low"], ends[f"{c}_high"]) for c in columns}


def random_cuts(train: DataFrame, columns: Sequence[str], cuts: int, seed: int, ends: Mapping[str, tuple] | None = None) -> dict[str, list[float]]:
    """For each feature some cut points, drawn between its least and its greatest value by the seed and the name. ``ends``: those, where they are known."""
    out = {}
    for c, (low, high) in (ends or feature_ends(train, columns)).items():
        draw = random.Random(f"{seed}:{c}")
        out[c] = sorted(draw.uniform(low, high) for _ in range(cuts)) if low is not None and low < high else []
    return out


def random_cut_trees(columns: Sequence[str], trees: int = 8, cuts: int = 5, depth: int = 6, seed: int = 1, to: str = "score") -> Callable[[DataFrame], Scorer]:
    """Trees that may cut a feature only at points drawn for that tree, averaged. Each is fitted on all rows (by weight, where there is a column
    weight) and on the features' places among their cut points; a missing value lies below all. All places are one array, so a tree
    adds one expression to a plan, not one a feature and cut."""

    def placed(rows: DataFrame, points: Mapping[str, list[float]]) -> DataFrame:
        edges = F.array(*[F.array(*[F.lit(p) for p in points[c]]).cast("array<double>") for c in columns])
        place = F.zip_with(F.array(*[F.col(c).cast("double") for c in columns]), edges, lambda x, e: F.size(F.filter(e, lambda p: x > p)).cast("double"))
        return rows.withColumn("_cut", array_to_vector(place))

    def fitted(train: DataFrame) -> Scorer:
        ends = feature_ends(train, columns)

        def one(t: int) -> tuple[dict[str, list[float]], PipelineModel]:
            points = random_cuts(train, columns, cuts, seed * 1000 + t, ends)
            tree = DecisionTreeClassifier(labelCol="label", featuresCol="_cut", maxDepth=depth, maxBins=max(cuts + 1, 8), seed=seed)
            tree = tree.setWeightCol("weight") if "weight" in train.columns else tree
            return points, fitted_pipeline([tree], placed(train, points))

        fits = at_once(partial(one, t) for t in range(trees))

        def score(rows: DataFrame) -> DataFrame:
            for t, (points, model) in enumerate(fits):
                rows = scored(model, placed(rows, points), f"_t{t}").drop("_cut")
            names = [f"_t{t}" for t in range(trees)]
            return rows.withColumn(to, scores.soft_vote(dict.fromkeys(names, 1.0))).drop(*names)

        return score

    return fitted


def subspace_ensemble(columns: Sequence[str], n: int = 6, share: float = 0.5, seed: int = 7, to: str = "score", keys: Sequence[str] = ("group_id",)) -> Callable[[DataFrame], Scorer]:
    """Trees of random cuts and boosted trees by turns, each on a bootstrap of the rows, drawn by their keys, and a share of the features, averaged."""

    def fitted(train: DataFrame) -> Scorer:

        def member(i: int) -> Scorer:
            some = sets.subspace(columns, share, seed + i)
            one = learner("boosted", some, seed + i, f"_e{i}") if i % 2 else random_cut_trees(some, 3, seed=seed + i, to=f"_e{i}")
            return one(sets.bootstrap(train, seed + i, keys).select("label", "weight", *some))

        fits = at_once(partial(member, i) for i in range(n))

        def score(rows: DataFrame) -> DataFrame:
            for f in fits:
                rows = f(rows)
            names = [f"_e{i}" for i in range(n)]
            return rows.withColumn(to, scores.soft_vote(dict.fromkeys(names, 1.0))).drop(*names)

        return score

    return fitted


def pairwise_ranker(columns: Sequence[str], per_positive: int = 8, seed: int = 5) -> Callable[[DataFrame], Scorer]:
    """A linear ranker: logistic regression without intercept on differences of a positive and a negative of one release. Each positive
    meets at most ``per_positive`` negatives, which hashes choose from the buckets of its release."""

    def fitted(train: DataFrame) -> Scorer:
        stages = Pipeline(stages=feature_stages(columns)).fit(train)
        rows = stages.transform(train).select("release", "group_id", "label", vector_to_array("features").alias("x"))
        # negatives are dealt to buckets of about per_positive rows, and a positive meets one bucket
        counts = rows.where("label = 0").groupBy("release").agg(F.greatest(F.lit(1), F.round(F.count("*") / per_positive)).cast("long").alias("buckets"))
        rows = rows.join(F.broadcast(counts), "release").withColumn("bucket", F.pmod(F.xxhash64(F.lit(seed), "group_id"), F.col("buckets")))
        a, b = rows.where("label = 1").alias("a"), rows.where("label = 0").alias("b")
        pairs = a.join(b, (F.col("a.release") == F.col("b.release")) & (F.col("a.bucket") == F.col("b.bucket")))
        difference = F.zip_with(F.col("a.x"), F.col("b.x"), lambda p, q: p - q)
        up = pairs.select(F.lit(1).alias("label"), difference.alias("d"))
        both = up.unionByName(up.select(F.lit(0).alias("label"), F.transform("d", lambda v: -v).alias("d")))
        model = LogisticRegression(featuresCol="features", fitIntercept=False, regParam=0.01).fit(both.select("label", array_to_vector("d").alias("features")))
        weights = F.array(*[F.lit(float(w)) for w in model.coefficients])

        def score(rows: DataFrame) -> DataFrame:
            x = vector_to_array("features")
            dot = F.aggregate(F.zip_with(x, weights, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
            return stages.transform(rows).select(*rows.columns, dot.alias("score"))

        return score

    return fitted


def pooled_hands(hand_rows: DataFrame, groups: DataFrame, features: Sequence[str], gate: str) -> DataFrame:
    """Attention-pooled and mean hand features of each group, with its label and release."""
    return metrics.attention_pool(hand_rows, gate, list(features)).join(groups, "group_id")


@dataclass
class FoldReport:
    """Walk-forward results: scores (all scored rows, served) and report (a row a release)."""

    scores: DataFrame
    report: DataFrame
    thresholds: dict[str, float] = field(default_factory=dict)


def walk_forward(fit_one: Callable[[DataFrame], Scorer], rows: DataFrame, latest: int = 3, min_train: int = 60, max_fpr: float = 0.05) -> FoldReport:
    """For each of the latest releases: fit on the releases before, take the threshold from the training rows' scores, serve the release as
    one batch. The rows are written once, and nothing stays cached."""
    return _walked(fit_one, written(rows), latest, min_train, max_fpr)


def _walked(fit_one: Callable[[DataFrame], Scorer], rows: DataFrame, latest: int = 3, min_train: int = 60, max_fpr: float = 0.05) -> FoldReport:
    eligible = {r["release"] for r in selection.eligible_folds(rows, min_train).collect()}
    walked = [r for r in sorted(r["release"] for r in selection.latest_releases(rows, latest).collect()) if r in eligible]
    if not walked:
        raise ValueError("no release has enough rows of both classes before it")

    def one(release: str) -> tuple[float, DataFrame]:
        train = selection.before_release(rows, release)
        score = fit_one(train)
        t = metrics.quantile_threshold(written(score(train).select("label", "score")), [], max_fpr).first()["threshold"]
        batch = score(selection.of_release(rows, release)).withColumn("batch_id", F.lit(release)).withColumn("idx", F.col("group_id"))
        return t, scores.served(batch.select("batch_id", "idx", "group_id", "release", "label", "score"), F.lit(float(t)))

    found = at_once(partial(one, r) for r in walked)
    served = reduce(DataFrame.unionByName, [batch for _, batch in found])
    return FoldReport(served, metrics.release_report(served), {r: t for r, (t, _) in zip(walked, found, strict=True)})


def compare(candidates: Mapping[str, Callable[[DataFrame], Scorer]], rows: DataFrame, **settings) -> DataFrame:
    """candidate and the walk-forward summary of each, best mean reward first. The rows are featurised once for all."""
    rows = written(rows)
    out = None
    for name, fit_one in candidates.items():
        one = metrics.report_summary(_walked(fit_one, rows, **settings).report).withColumn("candidate", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out.orderBy(F.desc("mean_reward"), "candidate")


def random_search(base: str, space: Mapping[str, Sequence], trials: int, rows: DataFrame, columns: Sequence[str], k: int = 3, seed: int = 3) -> DataFrame:
    """trial, params, auc of seeded draws of a learner's parameters, by out-of-fold AUC over release folds."""
    import json
    import random

    from pyspark.ml.evaluation import BinaryClassificationEvaluator
    from pyspark.ml.tuning import CrossValidator

    make, scaled, components = REGISTRY[base]
    estimator = make(seed, len(columns)).setLabelCol("label").setFeaturesCol("features")
    draw = random.Random(seed)
    maps = [{estimator.getParam(p): draw.choice(list(v)) for p, v in space.items()} for _ in range(trials)]
    folds = rows.join(F.broadcast(selection.grouped_folds(rows, k).select("release", "fold")), "release")
    pipeline = Pipeline(stages=[*feature_stages(columns, scaled, components), estimator])
    search = CrossValidator(estimator=pipeline, estimatorParamMaps=maps, evaluator=BinaryClassificationEvaluator(labelCol="label"), numFolds=k, foldCol="fold", parallelism=2)
    found = search.fit(folds)
    result = [(i, json.dumps({p.name: v for p, v in m.items()}, sort_keys=True), float(auc)) for i, (m, auc) in enumerate(zip(maps, found.avgMetrics, strict=True))]
    return rows.sparkSession.createDataFrame(result, "trial int, params string, auc double").orderBy(F.desc("auc"), "trial")


def deployed(fit_one: Callable[[DataFrame], Scorer], rows: DataFrame, k: int = 3, max_fpr: float = 0.05) -> tuple[Scorer, float]:
    """The winner fitted on all rows, with the threshold of its out-of-fold scores."""
    threshold = metrics.quantile_threshold(out_of_fold(fit_one, rows, k), [], max_fpr).first()["threshold"]
    return fit_one(rows), float(threshold)


def four_parts(columns: Sequence[str], signs: Mapping[str, int], k: int = 3, members: int = 6) -> dict[str, Callable[[DataFrame], Scorer]]:
    """The four components, each on its view of the features: a stack and the signed committee on the hero's, a perceptron on all, the subspace
    ensemble of so many members on those of all actors. Each adds a column of its name."""
    view = selection.feature_views(list(columns))
    ph = view["PH"] or view["UN"]
    return {
        "stack": stacked({"_s_logistic": learner("logistic", ph, to="_s_logistic"), "_s_forest": learner("forest", ph, to="_s_forest")}, k, "stack"),
        "mono": signed_committee(ph, signs, to="mono"),
        "mlp": learner("mlp_pca", view["UN"], to="mlp"),
        "drse": subspace_ensemble(view["V2"] or view["UN"], members, to="drse"),
    }


def hybrid(tabular: Callable[[DataFrame], Scorer], pooled: Callable[[DataFrame], Scorer], weight: float = 0.6) -> Callable[[DataFrame], Scorer]:
    """A linear blend of a learner on group features (adds tabular) and one on pooled hand features (adds pooled)."""

    def fitted(train: DataFrame) -> Scorer:
        one, two = tabular(train), pooled(train)
        return lambda rows: served_by(two(one(rows)), "hybrid", {"tabular": weight, "pooled": 1 - weight}).drop("tabular", "pooled")

    return fitted


def blend_kind(kind: str, weights: Mapping[str, float]):
    """The column that serves a model of a kind: one score, a vote, a hybrid of two, a rank blend, or log odds."""
    if kind == "single":
        return F.col(next(iter(weights)))
    kinds = {"vote": scores.soft_vote, "hybrid": scores.soft_vote, "rank_blend": scores.rank_blend, "log_odds": scores.log_odds_blend}
    if kind not in kinds:
        raise ValueError(f"no model is of kind {kind}; there are single, {', '.join(kinds)}")
    return kinds[kind](weights)


def served_by(rows: DataFrame, kind: str, weights: Mapping[str, float]) -> DataFrame:
    """rows with the score of a model of a kind, from the columns of its members."""
    return rows.withColumn("score", blend_kind(kind, weights))


def served_from(rows: DataFrame, model: PipelineModel, serving: Mapping) -> DataFrame:
    """rows scored and recentred as a written model's row of metadata says (read_model's two results); a single model scores alone."""
    weights = serving["weights"]
    if serving["kind"] == "single":
        rows = scored(model, rows, next(iter(weights)))
    out = served_by(rows, serving["kind"], weights)
    return out.withColumn("score", S.recentred(F.col("score"), F.lit(float(serving["threshold"]))))
