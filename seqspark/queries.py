"""The registered queries over the library's own operators. Each takes (spark, sf_dir); doubles are given to six digits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seqspark.functions import scalars as S
from seqspark.operators import blends, groups, hands, metrics, redundancy, sanitise, scores, selection, sets, weighing
from seqspark.oracles import ORACLES  # noqa: F401
from seqspark.plans import boosting, features, learners, release, search
from seqspark.sources import io, tables, views
from seqspark.streaming import jobs, requests
from seqspark.streaming import pool as pools

FLAGSHIP = "signature_scores"
QUERIES: dict = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles to some digits; -0 is 0."""
    return df.select(*[(F.round(c, digits) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


@query
def hand_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """HF1-HF17, FLT1-FLT3, JN2, JN3: the hero's 44 features of every hand."""
    return rounded(hands.hand_features(views.hourly(spark, sf_dir)), 9)


@query
def actor_features(spark, sf_dir):
    """HX1-HX9: 28 features of all actors of every hand."""
    return rounded(hands.actor_features(views.hourly(spark, sf_dir)), 9)


@query
def hand_statistics(spark, sf_dir):
    """GA1: mean, deviation and quartiles of the 44 by group."""
    return rounded(groups.hand_statistics(hands.hand_features(views.hourly(spark, sf_dir))), 9)


@query
def group_consistency(spark, sf_dir):
    """GA2-GA5."""
    return rounded(groups.consistency(hands.hand_features(views.hourly(spark, sf_dir))))


@query
def pooled_sizes(spark, sf_dir):
    """GA6-GA8, PRJ8-PRJ10, JN5."""
    return rounded(groups.pooled_sizes(views.hourly(spark, sf_dir)))


@query
def policy(spark, sf_dir):
    """GX8, GX9, HF18."""
    return rounded(groups.policy(views.hourly(spark, sf_dir)))


@query
def actor_statistics(spark, sf_dir):
    """HX10: seven statistics of the 28 by group."""
    return rounded(groups.actor_statistics(hands.actor_features(views.hourly(spark, sf_dir))), 9)


@query
def actor_group(spark, sf_dir):
    """HX11-HX15."""
    return rounded(groups.actor_group(views.short(spark, sf_dir)))


@query
def group_vectors(spark, sf_dir):
    """GX10, GX11: the whole vector but for its two compressed sizes, which ``compression_measures`` has."""
    return rounded(groups.group_features(views.short(spark, sf_dir), with_compression=False))


@query
def asked_features(spark, sf_dir):
    """SURVEY 2.14: two features of the registry and one of its user's, and nothing else aggregated."""
    share = features.Feature("bet_share", "action", ("action_type",), lambda: F.avg(F.col("action_type").isin("bet", "raise").cast("double")))
    return rounded(features.Registry().having(share).plan(views.short(spark, sf_dir), ["mean_aggr_frac", "bet_share", "hf_hand_count"]))


@query
def bootstrap_weights(spark, sf_dir):
    """ST6: how often three bootstraps draw each order, whatever the partitions are."""
    orders = views.table(spark, sf_dir, "orders").select("o_orderkey")
    parts = [sets.bootstrap(orders, seed, ["o_orderkey"]).withColumn("seed", F.lit(seed).cast("long")) for seed in (1, 2, 3)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query
def hand_tensor(spark, sf_dir):
    """SRC8, PRJ20: the first 40 hands of each group, standardised."""
    first = hands.first_hands(hands.hand_features(views.short(spark, sf_dir)))
    return rounded(hands.standardised(first, ["n_actions", "aggr_frac", "stack_bb", "total_pot_bb"]).select("group_id", "hand_id", F.col("place").cast("long").alias("place"), "n_actions", "aggr_frac", "stack_bb", "total_pot_bb"), 4)


@query
def signatures(spark, sf_dir):
    """SIG1, PRJ4, PRJ7, JN4."""
    return redundancy.signatures(views.short(spark, sf_dir))


@query
def signature_shares(spark, sf_dir):
    """SIG2, SIG4, SIG6."""
    return rounded(redundancy.signature_shares(redundancy.signatures(views.short(spark, sf_dir))))


def _signature_scores(spark, sf_dir) -> DataFrame:
    shares = redundancy.signature_shares(redundancy.signatures(views.short(spark, sf_dir)))
    return redundancy.signature_scores(shares)


@query
def signature_scores(spark, sf_dir):
    """SIG3, SIG5, PRJ3, PRJ14, WN2, SM2's batch twin: each group's score, remapped by rank within its batch."""
    rows = _signature_scores(spark, sf_dir).select("group_id", "score", F.col("score").alias("raw_score"))
    rows = rows.withColumn("batch_id", F.floor(F.col("group_id") / 100)).withColumn("idx", F.col("group_id"))
    return rounded(scores.batch_rank(rows).select("group_id", "batch_id", "raw_score", "score"))


@query
def redundancy_measures(spark, sf_dir):
    """RP1-RP5, RP8, RP9, JN7, ST2: with the bounds of RP2 and RP8, as its SQL has them. ``group_vectors`` has the measures without."""
    bounds = {"max_hands": redundancy.MAX_HANDS, "max_actions": redundancy.MAX_ACTIONS}
    return rounded(redundancy.redundancy_features(views.short(spark, sf_dir), with_compression=False, **bounds))


@query
def compression_measures(spark, sf_dir):
    """RP6, RP7 (rows only)."""
    return redundancy.compressibility(redundancy._rich(views.short(spark, sf_dir)))


@query
def scalar_codes(spark, sf_dir):
    """PRJ1, PRJ2, PRJ4, PRJ5, PRJ6, PRJ7, PRJ9, PRJ11: codes, defaults and grids of every event."""
    e = views.table(spark, sf_dir, "events")
    units = F.round(F.col("value") * 100).cast("long") / 1000
    return rounded(e.select(
        "event_id", S.size_code(units).alias("size_code"), S.pot_bucket(units).alias("pot_bucket"), S.street_ordinal(F.element_at(F.array(*[F.lit(s) for s in S.STREETS]), (F.col("event_id") % 5 + 1).cast("int"))).cast("long").alias("street_no"),
        S.action_code(F.upper(views._map(views.EVENT_ACTIONS, F.col("event_type")))).alias("action_code"), S.snapped(units, S.EXACT_GRID).alias("exact"), S.snapped(units, S.VISIBLE_GRID).alias("visible"),
        S.snapped(units, S.FRACTION_GRID).alias("fraction"), S.or_default((F.col("event_id") % 3).cast("double"), 0.02).alias("or_default"), S.number(F.get_json_object("props", "$.k")).alias("k"), S.number(F.col("event_type"), -1.0).alias("no_number"),
        S.relative_position((F.col("user_id") % 6).cast("int"), (F.col("event_id") % 4).cast("int"), F.lit(6)).alias("position"),
    ))


@query
def calibration(spark, sf_dir):
    """PRJ13-PRJ15, SM3: logits, anchors and recentring of part scores."""
    m = views.scored(spark, sf_dir)
    missing = F.when(F.col("idx") % 7 == 0, F.lit(None)).otherwise(F.col("mono"))
    return rounded(m.select(
        "idx", S.logit(F.col("stack")).alias("logit"), S.sigmoid(S.logit(F.col("stack"))).alias("again"), S.anchored(F.col("mlp")).alias("anchored"),
        S.recentred(F.col("drse"), F.lit(0.4)).alias("recentred"), scores.neutral_on_failure(missing).alias("neutral"),
    ))


@query
def action_mix_by_customer(spark, sf_dir):
    """GA2, GA7 over many groups: actions, their entropy and the concentration of sizes by customer."""
    rows = views.customers(spark, sf_dir)
    per = rows.groupBy("group_id", "release", "label").agg(
        F.countDistinct("hand_id").alias("n_hands"), F.count("*").alias("n_actions"), F.avg("size").alias("mean_size"), F.stddev_pop("size").alias("std_size"),
        F.percentile("size", 0.5).alias("median_size"), F.avg(F.col("action_type").isin("bet", "raise").cast("double")).alias("aggr_frac"),
    )
    mix = groups.concentration(rows, ["group_id"], "action_type", "action")
    sizes = groups.concentration(rows, ["group_id"], "size", "size")
    return rounded(per.join(mix, "group_id").join(sizes, "group_id", "left"))


@query
def customer_bigrams(spark, sf_dir):
    """WN7, WN8: switches, longest runs and pair entropy of each customer's orders."""
    rows = views.customers(spark, sf_dir)
    rows = rows.select("group_id", "hand_id", "action_idx", "action_type").repartition(views.parts_of(spark, views.table(spark, sf_dir, "lineitem")), "group_id")  # all that follows is by customer
    order = Window.partitionBy("group_id", "hand_id").orderBy("action_idx")
    rows = rows.withColumn("after", F.lead("action_type").over(order)).withColumn("changed", (F.col("action_type") != F.lag("action_type").over(order)).cast("int"))
    rows = rows.withColumn("run", F.sum(F.coalesce("changed", F.lit(0))).over(order))
    runs = rows.groupBy("group_id", "hand_id", "run").count().groupBy("group_id").agg(F.max("count").alias("longest_run"))
    pairs = rows.where("after IS NOT NULL").withColumn("pair", F.concat_ws(">", "action_type", "after"))
    grams = groups.concentration(pairs, ["group_id"], "pair", "pair")
    switches = rows.groupBy("group_id").agg(F.avg(F.col("changed").cast("double")).alias("switch_rate"))
    return rounded(switches.join(runs, "group_id").join(grams, "group_id", "left"))


@query
def rank_positions(spark, sf_dir):
    """WN1, ML17: ranks within batches and the rank blend."""
    m = views.scored(spark, sf_dir)
    ranks = {f"r_{p}": scores.rank01(p) for p in views.PARTS}
    return rounded(m.withColumns(ranks).select("idx", *ranks, scores.rank_blend(dict(zip(views.PARTS, (3.0, 2.0, 1.0, 2.0), strict=True))).alias("blend")))


@query
def blended_scores(spark, sf_dir):
    """ML15, ML18, JN9: weighted mean and log-odds blend."""
    m = views.scored(spark, sf_dir)
    w = dict(zip(views.PARTS, (3.0, 2.0, 1.0, 2.0), strict=True))
    return rounded(m.select("idx", scores.soft_vote(w).alias("vote"), scores.log_odds_blend(w).alias("log_odds")))


@query
def served_scores(spark, sf_dir):
    """ML21, PRJ15, WN3-WN5, FLT9: recentred, empty groups fixed, minimum and budget of positive calls."""
    m = views.scored(spark, sf_dir).select("batch_id", "idx", "score", (F.col("idx") % 11 != 0).alias("is_live"))
    return rounded(scores.served(m, F.lit(0.55)).select("batch_id", "idx", "score"))


@query
def lifted_scores(spark, sf_dir):
    """WN3: batches without positives get two."""
    m = views.scored(spark, sf_dir).select("batch_id", "idx", (F.col("score") * 0.45).alias("score"))
    return rounded(scores.min_positives(m, 2))


@query
def ranking_metrics(spark, sf_dir):
    """AG1-AG3 by release, on scores with ties."""
    m = views.scored(spark, sf_dir).select("release", "label", F.col("tied").alias("score"))
    return rounded(metrics.ranking_metrics(m, ["release"]))


@query
def hard_metrics(spark, sf_dir):
    """AG4."""
    return rounded(metrics.hard_metrics(views.scored(spark, sf_dir), ["release"]))


@query
def fpr_thresholds(spark, sf_dir):
    """AG5, AG6."""
    m = views.scored(spark, sf_dir)
    order = metrics.order_threshold(m, ["release"]).withColumnRenamed("threshold", "by_order")
    return rounded(order.join(metrics.quantile_threshold(m, ["release"]).withColumnRenamed("threshold", "by_quantile"), "release"), 12)


@query
def release_report(spark, sf_dir):
    """AG7, AG9, FLT6."""
    return rounded(metrics.release_report(views.scored(spark, sf_dir)))


@query
def report_summary(spark, sf_dir):
    """AG8, AG9's roll-up."""
    return rounded(metrics.report_summary(metrics.release_report(views.scored(spark, sf_dir))))


@query
def score_correlation(spark, sf_dir):
    """AG13."""
    return rounded(views.scored(spark, sf_dir).groupBy("release").agg(F.corr("stack", "mono").alias("r_stack_mono"), F.corr("mlp", "drse").alias("r_mlp_drse")))


def _long(spark, sf_dir, keys: list[str]) -> DataFrame:
    m = views.scored(spark, sf_dir)
    wide = m.select(*keys, *[F.col("embedding")[k].cast("double").alias(f"f{k}") for k in range(64)])
    return metrics.feature_long(wide, keys, [f"f{k}" for k in range(64)])


@query
def feature_shift(spark, sf_dir):
    """AG11, PRJ18: shift of each feature between the newest release and the rest."""
    rows = _long(spark, sf_dir, ["release"])
    shift = metrics.feature_shift(rows.where("release = '7'"), rows.where("release <> '7'"))
    return rounded(shift.withColumn("kept", F.col("z") <= 5))


@query
def most_shifted(spark, sf_dir):
    """WN10: the twelve features that have shifted most."""
    rows = _long(spark, sf_dir, ["release"])
    return rounded(metrics.feature_shift(rows.where("release = '7'"), rows.where("release <> '7'")).select("feature", "z").orderBy(F.desc("z"), "feature").limit(12))


@query
def rank_correlations(spark, sf_dir):
    """AG12: Spearman's correlation of each feature and the label by release."""
    return rounded(metrics.rank_correlations(_long(spark, sf_dir, ["release", "label"])))


@query
def steady_signs(spark, sf_dir):
    """AG12: features whose sign is steady over releases."""
    return rounded(metrics.steady_signs(metrics.rank_correlations(_long(spark, sf_dir, ["release", "label"]))))


@query
def attention_pooling(spark, sf_dir):
    """AG15: softmax-weighted pooling of hands."""
    rows = hands.hand_features(views.short(spark, sf_dir)).select("group_id", "aggr_frac", "total_pot_bb", "n_actions")
    return rounded(metrics.attention_pool(rows, "aggr_frac", ["total_pot_bb", "n_actions"]))


@query
def set_profile(spark, sf_dir):
    """AG14."""
    rows = views.customers(spark, sf_dir).groupBy("group_id", "release", "label").agg(F.countDistinct("hand_id").alias("n_hands"))
    return rounded(metrics.profile(rows))


@query
def eligible_releases(spark, sf_dir):
    """FLT6, FLT7, WN11, WN12: releases with enough rows, rows before each, newest and first seen."""
    m = views.scored(spark, sf_dir)
    newest = selection.latest_releases(m, 3).withColumn("is_newest", F.lit(True))
    out = selection.eligible_releases(m).join(selection.eligible_folds(m), "release", "left").join(selection.release_order(m, "idx"), "release")
    return out.join(newest, "release", "left").withColumn("is_newest", F.coalesce("is_newest", F.lit(False)))


@query
def release_folds(spark, sf_dir):
    """ML1: whole releases dealt to folds."""
    return selection.grouped_folds(views.customers(spark, sf_dir).select("release"), 3)


@query
def holdout_rows(spark, sf_dir):
    """FLT5: the newest release is held out."""
    m = views.scored(spark, sf_dir).withColumn("split", F.lit("train"))
    return selection.holdout(m).groupBy("release", "is_holdout").agg(F.count("*").alias("n"))


@query
def deduplicated(spark, sf_dir):
    """ST3, JN8, SM1's batch twin: the first hand of each signature that earlier groups have not shown."""
    signed = redundancy.signatures(views.short(spark, sf_dir))
    seen, fresh = signed.where("group_id < 2"), signed.where("group_id >= 2")
    return sets.first_of_each(fresh, "signature", "hand_id", None, seen).select("hand_id", "signature")


@query
def resampled_groups(spark, sf_dir):
    """ST4, ST5: groups of 20 and 40 hands drawn from customers of one release and label."""
    rows = views.customers(spark, sf_dir).select("release", "label", "group_id", "hand_id").distinct()
    rows = rows.withColumn("n_hands", F.count("*").over(Window.partitionBy("group_id")))
    return sets.resampled(rows, [20, 40], 2)


@query
def unioned_groups(spark, sf_dir):
    """ST1: native and drawn groups together, by origin."""
    rows = views.customers(spark, sf_dir).select("release", "label", "group_id", "hand_id").distinct()
    drawn = sets.resampled(rows.withColumn("n_hands", F.count("*").over(Window.partitionBy("group_id"))), [20, 40], 2)
    both = sets.with_resampled(rows, drawn)
    return both.groupBy("release", "label", "size").agg(F.count("*").alias("n"))


@query
def hand_dropout(spark, sf_dir):
    """ST7."""
    rows = views.customers(spark, sf_dir).select("group_id", "hand_id").distinct()
    return sets.hand_dropout(rows)


#: Weights in steps of .02: the range of each part, and the weights that serve now.
GRID = {"stack": (10, 20), "mono": (5, 15), "mlp": (10, 21), "drse": (5, 15)}
PRIOR = {"stack": 15, "mono": 11, "mlp": 14, "drse": 10}


@query
def weight_rewards(spark, sf_dir):
    """ST8, JN10, ML20: every candidate weight vector thresholded, served and rewarded by itself, and the one that is chosen."""
    grid = sets.weight_grid(spark, GRID, PRIOR)
    rewards = weighing.rewards(views.scored(spark, sf_dir), grid, list(views.PARTS))
    out = io.written(rounded(grid.join(rewards.select("candidate", "threshold", "reward"), "candidate"), 5))
    pick = blends.chosen(out).select(F.col("candidate").alias("chosen"))
    out = out.crossJoin(F.broadcast(pick)).withColumn("is_chosen", F.col("candidate") == F.col("chosen")).drop("chosen")
    return out.withColumns({c: F.col(c).cast("long") for c in ("candidate", *GRID)})


@query
def linear_sweep(spark, sf_dir):
    """ML19: AUC of linear blends."""
    return rounded(blends.linear_sweep(views.scored(spark, sf_dir), "stack", "mlp", [0.2, 0.3, 0.4, 0.5]))


def _model_metrics(spark, sf_dir) -> DataFrame:
    m = views.scored(spark, sf_dir)
    long = m.unpivot(["idx", "release", "label"], list(views.PARTS), "model", "score")
    out = metrics.ranking_metrics(long, ["model"]).join(metrics.hard_metrics(long, ["model"]), "model")
    out = out.withColumn("safety", F.greatest(F.lit(0.0), 1 - F.col("hard_fpr")))
    return out.withColumn("reward", metrics.reward(F.col("ap"), F.col("recall_at_fpr"), F.col("hard_fpr")))


@query
def promotion(spark, sf_dir):
    """PG1-PG3, JN11: which model may replace the first one."""
    rows = _model_metrics(spark, sf_dir)
    candidates = selection.gate_reasons(rows.where("model <> 'stack'").withColumn("forced", F.col("model") == "drse"))
    out = selection.promotion(candidates, rows.where("model = 'stack'"))
    return rounded(out.select("model", "reward", "hard_fpr", F.array_join("reasons", ",").alias("reasons"), "regression", "accepted"))


@query
def newest_snapshots(spark, sf_dir):
    """PG5: the ten newest orders stand for snapshots."""
    return selection.newest(views.table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey")


@query
def flattened_conversations(spark, sf_dir):
    """SRC6: nested turns to rows with their places and back, by conversation."""
    c = views.table(spark, sf_dir, "conversations")
    nested = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", F.length("text").alias("size")))).alias("turns"))
    flat = nested.select("conv_id", F.posexplode("turns").alias("place", "t"))
    return flat.groupBy("conv_id").agg(F.count("*").alias("n_turns"), F.sum(F.col("place") * F.col("t.size")).alias("weighted_size"), F.max_by("t.role", "place").alias("last_role"))


@query
def sanitised_actions(spark, sf_dir):
    """SAN1: seats renamed, sizes snapped and jittered, a window of the actions."""
    return rounded(sanitise.sanitised(views.hourly(spark, sf_dir).actions))


@query
def aligned_scores(spark, sf_dir):
    """JN6, FLT8: hand features beside pooled ones, every group in both."""
    rows = hands.hand_features(views.short(spark, sf_dir))
    a = groups.consistency(rows).select("group_id", "vpip_mean", "win_rate")
    b = metrics.attention_pool(rows, "aggr_frac", ["n_actions"])
    return rounded(selection.covered(sanitise.aligned(a, b, "group_id"), "vpip_mean"))


@query
def gate_figures(spark, sf_dir):
    """AG10: the worse of two evaluations of each model: on even and on odd releases."""
    m = views.scored(spark, sf_dir)
    long = m.unpivot(["idx", "release", "label"], list(views.PARTS), "model", "score")
    names = ["hard_fpr", "hard_recall", "positive_rate"]
    even, odd = (metrics.hard_metrics(long.where(F.col("release").cast("int") % 2 == k), ["model"]) for k in (0, 1))
    a = even.select("model", *[F.col(c).alias(f"wf_{c}") for c in names], (1 - F.col("hard_fpr")).alias("wf_safety"))
    b = odd.select("model", *[F.col(c).alias(f"oof_{c}") for c in names], (1 - F.col("hard_fpr")).alias("oof_safety"))
    return rounded(selection.worst_case(a.join(b, "model")).select("model", "safety", *names))


def _vectors(spark, sf_dir) -> tuple[DataFrame, list[str]]:
    m = views.scored(spark, sf_dir)
    columns = [f"f{k}" for k in range(64)]
    return m.select("group_id", "release", "label", *[F.col("embedding")[k].cast("double").alias(c) for k, c in enumerate(columns)]), columns


@query
def walk_forward(spark, sf_dir):
    """ML3, ML7, PRJ19, FLT4, FLT7, AG6, AG9 (rows only): a logistic regression fitted on the releases before each of the latest two."""
    rows, columns = _vectors(spark, sf_dir)
    return learners.walk_forward(learners.learner("logistic", columns), rows, latest=2).scores


@query
def out_of_fold_forest(spark, sf_dir):
    """ML1, ML2, ML8 (rows only)."""
    rows, columns = _vectors(spark, sf_dir)
    return learners.out_of_fold(learners.learner("forest", columns), rows, 2).select("group_id", "release", "label", "score")


@query
def ranked_pairs(spark, sf_dir):
    """ML12, JN12 (rows only): a linear ranker over pairs within releases."""
    rows, columns = _vectors(spark, sf_dir)
    return learners.pairwise_ranker(columns)(rows)(rows).select("group_id", "release", "label", "score")


@query
def rank_gradients(spark, sf_dir):
    """ML12: the gradients and curvatures by which a ranker moves rows within a release, at scores that tie."""
    m = views.scored(spark, sf_dir).select("release", "label", F.col("tied").alias("margin"))
    return rounded(boosting.rank_gradients(m).select("release", F.round("score", 6).alias("score"), "label", "g", "h"), 9)


@query
def lambda_scores(spark, sf_dir):
    """ML12, AG2 (rows only): the ranker boosted on average precision within releases, fitted on the releases before the two that it scores."""
    rows, columns = _vectors(spark, sf_dir)
    score = boosting.lambda_ranker(columns)(selection.before_release(rows, "6"))
    return score(rows.where("release >= '6'")).select("group_id", "release", "label", "score")


@query
def monotone_scores(spark, sf_dir):
    """ML13, AG12: trees that keep the steady signs of the features. Of each release the rows, and those whose score falls (none may) when all features
    move the way of their signs."""
    rows, columns = _vectors(spark, sf_dir)
    signs = metrics.steady_signs(metrics.rank_correlations(metrics.feature_long(rows.drop("group_id"), ["release", "label"], columns)))
    known = {r["feature"]: r["sign"] for r in signs.collect()}
    score = boosting.monotone_trees(columns, known, seeds=(1, 2), rounds=6)(rows)
    moved = score(rows.withColumns({c: F.col(c) + 0.05 * s for c, s in known.items()})).select("group_id", F.col("score").alias("after"))
    both = score(rows).select("group_id", "release", "score").join(moved, "group_id")
    return both.groupBy("release").agg(F.count("*").alias("n_rows"), F.count_if(F.col("after") < F.col("score")).alias("n_lowered"))


@query
def searched_rungs(spark, sf_dir):
    """ML22: fifty settings of a logistic regression by successive halving. Of each rung the settings, those that go on, and the rows that they are tried on."""
    rows, columns = _vectors(spark, sf_dir)
    found = search.halved_search("logistic", {"regParam": (1e-4, 10.0), "elasticNetParam": [0.0, 0.5, 1.0], "maxIter": [10, 20, 40]}, 50, rows, columns)
    return found.groupBy("rung").agg(F.count("*").alias("n_trials"), F.count_if("promoted").alias("n_promoted"), F.max("n_rows").alias("n_rows"))


@query
def streamed_counts(spark, sf_dir):
    """SM1's machinery on events: a stream of the table, counted by hour and type with a watermark."""
    events = spark.readStream.schema(views.table(spark, sf_dir, "events").schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/event*.parquet")
    events = events.withColumn("ts", F.col("ts").cast("timestamp"))
    rows = jobs.collected(jobs.event_counts(events, "ts"), "complete")
    return rows.select(F.date_format("window.start", "yyyy-MM-dd HH").alias("hour"), "event_type", "n", F.round("total", 4).alias("total"))


@query
def captured_stream(spark, sf_dir):
    """SM1: the first row of each user and type that a stream shows, kept over restarts; the keys held are those of the last 60 days."""
    events = spark.readStream.schema(views.table(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/event*.parquet")
    keyed = events.select(F.concat_ws("/", "user_id", "event_type").alias("key"), F.col("ts").cast("timestamp").alias("ts"))
    return jobs.collected(jobs.captured(keyed, "key", ("ts", "60 days")), "append").select("key")


def _arriving(df: DataFrame, order: str, n: int) -> DataFrame:
    """A stream of a table in n files by ranges of a column of whole numbers, one file a trigger, in order."""
    spark = df.sparkSession
    path = io.scratch(spark, "arriving")
    low, high = df.agg(F.min(order), F.max(order)).first()
    for k in range(n if low is not None else 0):
        part = F.floor((F.col(order) - low) * n / (high - low + 1))
        df.where(part == k).coalesce(1).write.mode("append").parquet(path)
    if low is None:
        df.write.parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


@query
def streamed_scores(spark, sf_dir):
    """SM2, SM3: the rows of five requests arrive in three pieces each; state holds a request until it is whole, then it is remapped by rank once.
    Failures are neutral first."""
    vectors = views.table(spark, sf_dir, "embeddings").select((F.col("vec_id") % 5).alias("batch_id"), F.col("vec_id").alias("idx"), "embedding")
    sizes = vectors.groupBy("batch_id").agg(F.count("*").alias("n_rows"))
    rows = _arriving(vectors.join(sizes, "batch_id"), "idx", 3)

    def score(rows: DataFrame) -> DataFrame:
        p = 1 / (1 + F.exp(-10 * F.col("embedding")[0].cast("double")))
        return rows.select("batch_id", "idx", "n_rows", F.when(F.col("idx") % 13 != 0, F.round(p, 9)).alias("score"))

    path, mark = io.scratch(spark, "scores"), io.scratch(spark, "mark")
    requests.score_requests(rows, score, path, mark).awaitTermination()
    return rounded(spark.read.parquet(path).select("batch_id", "idx", "score"))


@query
def bounded_pool(spark, sf_dir):
    """SM1: a stream of events in three pieces fills a pool of the first row of each user and type that holds 300 at most."""
    events = views.table(spark, sf_dir, "events").select("event_id", F.concat_ws("/", "user_id", "event_type").alias("key"))
    path, mark = io.scratch(spark, "pool"), io.scratch(spark, "mark")
    pools.capture(_arriving(events, "event_id", 3), "key", "event_id", path, mark, cap=300).awaitTermination()
    return pools.pool(spark, path, events.schema).select("key", "event_id")


@query
def single_group_scores(spark, sf_dir):
    """SM5: each group arrives as a request of its own, so that ranks change nothing; failures are neutral."""
    vectors = spark.readStream.schema(views.table(spark, sf_dir, "embeddings").schema).parquet(f"{sf_dir}/embedding*.parquet")
    rows = vectors.select(F.col("vec_id").alias("batch_id"), F.lit(0).alias("idx"), "embedding")

    def score(batch: DataFrame) -> DataFrame:
        p = 1 / (1 + F.exp(-10 * F.col("embedding")[1].cast("double")))
        return batch.select("batch_id", "idx", F.when(F.col("batch_id") % 17 != 0, F.round(p, 9)).alias("score"))

    path, mark = io.scratch(spark, "scores"), io.scratch(spark, "mark")
    jobs.score_batches(rows, score, path, mark).start().awaitTermination()
    return rounded(spark.read.parquet(path).select("batch_id", "score"))


@query
def captured_drift(spark, sf_dir):
    """SM4, WN10: a stream's vectors are captured, all of them, each once, and the moments of their features go on with every micro-batch; then the twelve features
    of the newest release that have shifted most, from the moments alone."""
    names = [f"f{k}" for k in range(64)]
    wide = views.table(spark, sf_dir, "embeddings").select("vec_id", *[F.col("embedding")[k].cast("double").alias(n) for k, n in enumerate(names)])
    live, bench = wide.where("vec_id % 8 = 7"), wide.where("vec_id % 8 <> 7")
    path, mark = io.scratch(spark, "pool"), io.scratch(spark, "mark")
    pools.capture(_arriving(live, "vec_id", 2), "vec_id", "vec_id", path, mark, cap=None, features=names).awaitTermination()
    shift = pools.shift_by_moments(pools.newest_moments(spark, path), pools.moments(bench, names))
    return rounded(shift.select("feature", "z").orderBy(F.desc("z"), "feature").limit(12))


@query
def range_snapped(spark, sf_dir):
    """JN5: every event's value at the nearest point of the grid, by a range join."""
    e = views.table(spark, sf_dir, "events").select("event_id", (F.round(F.col("value") * 100).cast("long") / 1000).alias("units"))
    return S.snapped_by_join(e, "units", S.EXACT_GRID, "point").select("event_id", "point")


@query
def promotion_history(spark, sf_dir):
    """PG4, SNK5: decisions appended to a history, which is read again."""
    rows = _model_metrics(spark, sf_dir)
    candidates = selection.gate_reasons(rows.where("model <> 'stack'").withColumn("forced", F.col("model") == "drse"))
    decided = selection.promotion(candidates, rows.where("model = 'stack'"))
    path = io.scratch(spark, "history")
    for at in ("2026-01-01 00:00:00", "2026-01-02 00:00:00"):
        io.write_table(selection.decisions(decided, at), path, append=True)
    out = spark.read.parquet(path)
    return out.select(F.date_format("decided_at", "yyyy-MM-dd").alias("day"), "model", F.array_join("reasons", ",").alias("reasons"), "accepted")


@query
def live_groups(spark, sf_dir):
    """FLT9, JN8: groups with a feature that is not 0, without those that the first release has shown."""
    m = views.scored(spark, sf_dir).select("idx", "release", F.when(F.col("idx") % 9 != 0, F.col("stack")).alias("a"), F.lit(0.0).alias("b"))
    live = selection.empty_groups(m, ["a", "b"])
    return sets.not_seen(live, m.where("release = '0'"), "idx").select("idx", "is_live")


@query
def best_candidate(spark, sf_dir):
    """WN9: the part score of the highest area, then of the highest precision."""
    rows = rounded(_model_metrics(spark, sf_dir))
    return selection.best(rows, F.desc("auc"), F.desc("ap"), "model").select("model", "auc", "ap")


@query
def kept_features(spark, sf_dir):
    """PRJ18: the features of which the shift is at most half a deviation, and how their number compares."""
    rows = _long(spark, sf_dir, ["release"])
    shift = metrics.feature_shift(rows.where("release = '7'"), rows.where("release <> '7'"))
    return metrics.steady_features(rounded(shift), 0.1)


@query
def platt_scores(spark, sf_dir):
    """ML5 (rows only): a logistic regression calibrated on its out-of-fold scores."""
    rows, columns = _vectors(spark, sf_dir)
    return learners.calibrated(learners.learner("logistic", columns), 2)(rows)(rows).select("group_id", "release", "label", "score")


@query
def stacked_scores(spark, sf_dir):
    """ML16, ML7, ML8 (rows only): a logistic regression over the out-of-fold scores of two learners."""
    rows, columns = _vectors(spark, sf_dir)
    members = {"_l": learners.learner("logistic", columns, to="_l"), "_f": learners.learner("forest", columns, to="_f")}
    return learners.stacked(members, 2)(rows)(rows).select("group_id", "release", "label", "score")


@query
def signed_scores(spark, sf_dir):
    """ML13 (rows only): a committee whose coefficients keep the steady signs of the features."""
    rows, columns = _vectors(spark, sf_dir)
    signs = metrics.steady_signs(metrics.rank_correlations(metrics.feature_long(rows.drop("group_id"), ["release", "label"], columns)))
    known = {r["feature"]: r["sign"] for r in signs.collect()}
    return learners.signed_committee(columns, known)(rows)(rows).select("group_id", "release", "label", "score")


@query
def subspace_scores(spark, sf_dir):
    """ML14, ST6 (rows only): trees on samples of the rows and shares of the features."""
    rows, columns = _vectors(spark, sf_dir)
    return learners.subspace_ensemble(columns, n=2)(rows)(rows).select("group_id", "release", "label", "score")


@query
def deployed_scores(spark, sf_dir):
    """ML26 (rows only): the winner fitted on all rows, recentred at the threshold of its out-of-fold scores."""
    rows, columns = _vectors(spark, sf_dir)
    score, threshold = learners.deployed(learners.learner("logistic", columns), rows, 2)
    return score(rows).select("group_id", "release", "label", S.recentred(F.col("score"), F.lit(threshold)).alias("score"))


@query
def hybrid_scores(spark, sf_dir):
    """ML24, ML25, AG15 (rows only): a learner on group measures and one on pooled hands, blended."""
    seq = views.short(spark, sf_dir)
    rows = hands.hand_features(seq)
    facts = groups.consistency(rows).select("group_id", "vpip_mean", "aggr_consistency", "action_entropy", (F.col("group_id") % 3).cast("string").alias("release"), (F.col("group_id") % 2).cast("int").alias("label"))
    pooled = learners.pooled_hands(rows.select("group_id", "aggr_frac", "total_pot_bb", "n_actions"), facts, ["total_pot_bb", "n_actions"], "aggr_frac")
    one = learners.learner("logistic", ["vpip_mean", "aggr_consistency", "action_entropy"], to="tabular")
    two = learners.learner("logistic", ["att_total_pot_bb", "att_n_actions", "avg_total_pot_bb", "avg_n_actions"], to="pooled")
    return learners.hybrid(one, two)(pooled)(pooled).select("group_id", "release", "label", "score")


@query
def four_part_scores(spark, sf_dir):
    """ML27, JN9, ML18, PRJ17 (rows only): the four components on their views, blended in log odds by the weights that serve."""
    rows, columns = _vectors(spark, sf_dir)
    rows = io.written(rows.repartition("group_id"))  # every fit reads them, in even parts
    signs = metrics.steady_signs(metrics.rank_correlations(metrics.feature_long(rows.drop("group_id"), ["release", "label"], columns)))
    parts = learners.four_parts(columns, {r["feature"]: r["sign"] for r in signs.collect()}, 2)
    out = learners.together(parts.values())(rows)(rows)
    return learners.served_by(out, "log_odds", PRIOR).select("group_id", "release", "label", "score")


def _released(seq: tables.Sequences, name: Column) -> DataFrame:
    """Groups nested, written as releases of a name each and read again. A group's label says that at least two fifths of its actions are bets or raises."""
    active = F.avg(F.col("action_type").isin("bet", "raise").cast("double")) >= 0.4
    facts = seq.actions.groupBy("group_id").agg(active.cast("int").alias("label")).withColumn("split", F.lit("train"))
    facts = facts.withColumn("release", name)
    spark = facts.sparkSession
    path = io.scratch(spark, "releases")
    io.write_releases(tables.nested(seq).join(facts, "group_id"), path)
    return io.read_releases(spark, path, lines=True)


@query
def loaded_hands(spark, sf_dir):
    """SRC2, SRC6, JN2, JN3 by the loader itself: nested releases are written, read, taken apart, and give the hero's features; hands are known by their places."""
    loaded = _released(views.hourly(spark, sf_dir), F.substring("group_id", 9, 1))
    return rounded(hands.hand_features(tables.sequences_of(loaded)).withColumn("hand_id", F.col("hand_id").cast("long")), 9)


#: What the release gate's candidates see: the hero's measures, and those of all actors.
GATE_FEATURES = (
    "mean_aggr_frac", "mean_fold_rate", "mean_call_rate", "aggr_consistency", "action_entropy",
    "hf_mean_aggr_share", "hf_mean_raise_share", "hf_mean_check_share", "hf_std_aggr_share", "hf_mean_action_entropy",
)


@query
def release_gate(spark, sf_dir):
    """SRC2 to PG4 in one run (AG10, FLT4, JN9, ML1, ML3, ML18, ML27, PG1, PG2, PRJ17): release files, vectors, the four components on their own views against a logistic
    regression, the gate, and the history read again. Of the candidate the groups walked and out of fold, and whether its figures are shares."""
    groups_ = _released(views.short(spark, sf_dir, 20), (F.col("group_id") % 4).cast("string"))
    rows = release.labelled_features(groups_, GATE_FEATURES)
    candidates = {"single": learners.learner("logistic", GATE_FEATURES), "parts": release.blended_parts(GATE_FEATURES, PRIOR)}
    figures = release.judged(candidates, rows, latest=1, min_train=10)
    path = io.scratch(spark, "history")
    release.promoted(figures, "single", path, "2026-01-01 00:00:00", forced=("parts",))
    held = spark.read.parquet(path).select("model", "accepted", F.date_format("decided_at", "yyyy-MM-dd").alias("day"))
    share = lambda c: F.coalesce(F.col(c).between(0, 1), F.lit(False))
    sound = share("hard_fpr") & share("hard_recall") & share("positive_rate") & share("safety") & share("reward")
    figures = figures.select("model", F.col("wf_n_rows").alias("n_walked"), F.col("oof_n_rows").alias("n_oof"), sound.alias("sound"))
    return held.join(figures, "model").select("model", "day", "accepted", "n_walked", "n_oof", "sound")
