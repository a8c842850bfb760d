"""A search over a learner's settings that stops early: successive halving over release folds."""

from __future__ import annotations

import json
import math
import random
from collections.abc import Mapping, Sequence

from pyspark.ml import Pipeline
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.tuning import CrossValidator
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqspark.operators import selection, sets
from seqspark.plans.learners import REGISTRY, feature_stages


def drawn_settings(space: Mapping[str, Sequence | tuple], trials: int, seed: int) -> list[dict]:
    """Seeded draws, all different. A list is drawn from evenly; a tuple (low, high) of floats by its logarithm. An error where the space has fewer."""
    draw, out = random.Random(seed), []
    for _ in range(100 * trials):
        one = {n: math.exp(draw.uniform(math.log(v[0]), math.log(v[1]))) if isinstance(v, tuple) else draw.choice(list(v)) for n, v in sorted(space.items())}
        if one not in out:
            out.append(one)
        if len(out) == trials:
            return out
    raise ValueError(f"the space has no {trials} different settings")


def rungs(trials: int, eta: int = 3, most: int = 3) -> list[tuple[int, float]]:
    """(settings, share of the rows) of each rung: 1/eta of the settings go on to eta times the rows; the last rung has all rows."""
    counts = [trials]
    while len(counts) < most and counts[-1] > 1:
        counts.append(math.ceil(counts[-1] / eta))
    return [(n, float(eta) ** -(len(counts) - 1 - i)) for i, n in enumerate(counts)]


def halved_search(
    base: str, space: Mapping[str, Sequence | tuple], trials: int, rows: DataFrame, columns: Sequence[str], k: int = 2, eta: int = 3, most: int = 3, seed: int = 3, parallelism: int = 4, keys: Sequence[str] = ("group_id",)
) -> DataFrame:
    """rung, share, n_rows, trial, params, auc, promoted: all that was tried, by out-of-fold AUC over ``k`` folds of whole releases.

    A rung fits the settings that are left on a share of the rows, drawn by their keys, so a later rung holds the rows of an earlier one; its best go on, of
    equal ones those drawn first. Features are imputed and scaled once a rung, over its rows. Settings of the last rung are not promoted."""
    make, scaled, components = REGISTRY[base]
    settings = drawn_settings(space, trials, seed)
    folds = selection.grouped_folds(rows, k).select("release", "fold")
    rows = rows.join(F.broadcast(folds), "release").withColumn("_drawn", sets.drawn(seed, *keys))
    plan, left, result = rungs(trials, eta, most), list(range(trials)), []
    for rung, (_, share) in enumerate(plan):
        some = rows if share == 1 else rows.where(F.col("_drawn") < share)
        ready = Pipeline(stages=feature_stages(columns, scaled, components)).fit(some).transform(some).select("features", "label", "fold").persist()
        try:
            n_rows = ready.count()
            estimator = make(seed, len(columns)).setLabelCol("label").setFeaturesCol("features")
            maps = [{estimator.getParam(p): v for p, v in settings[t].items()} for t in left]
            search = CrossValidator(estimator=estimator, estimatorParamMaps=maps, evaluator=BinaryClassificationEvaluator(labelCol="label"), numFolds=k, foldCol="fold", parallelism=parallelism)
            found = dict(zip(left, map(float, search.fit(ready).avgMetrics), strict=True))
        finally:
            ready.unpersist()
        ranked = sorted(found, key=lambda t: (-found[t], t))
        left = ranked[: plan[rung + 1][0]] if rung + 1 < len(plan) else []
        result += [(rung, share, n_rows, t, json.dumps(settings[t], sort_keys=True), found[t], t in left) for t in ranked]
    out = rows.sparkSession.createDataFrame(result, "rung int, share double, n_rows long, trial int, params string, auc double, promoted boolean")
    return out.orderBy("rung", F.desc("auc"), "trial")
