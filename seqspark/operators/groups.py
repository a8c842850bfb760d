"""Features of each group of hands, from the hand features and the steps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqspark.functions import scalars as S
from seqspark.operators import redundancy
from seqspark.operators.hands import ACTOR_FEATURES, HAND_FEATURES, KEYS, actor_features, actor_steps, doubles, hand_features, prepared, steps
from seqspark.sources.tables import Sequences

_MIX = ("fold_rate", "call_rate", "check_rate", "raise_rate", "bet_rate")
_MIX_SUM = "(" + " + ".join(f"avg({c})" for c in _MIX) + ")"
_MIX_TERM = "CASE WHEN avg({0}) > 0 THEN avg({0}) / " + _MIX_SUM + " * ln(avg({0}) / " + _MIX_SUM + ") ELSE 0 END"

#: Name -> aggregate over a group's hand features.
CONSISTENCY = {
    "group_hands": "count(*)",
    "total_actions": "sum(n_actions)",
    "vpip_mean": "avg(vpip)",
    "vpip_std": "stddev_pop(vpip)",
    "mean_roundness": "avg(roundness)",
    "showdown_rate": "avg(saw_showdown)",
    "win_rate": "avg(won)",
    "aggr_consistency": "1 - stddev_pop(aggr_frac)",
    "distinct_size_frac": "coalesce(count(DISTINCT CASE WHEN mean_size_bb > 0 THEN rint(mean_size_bb * 100) / 100 END) / nullif(count_if(mean_size_bb > 0), 0), 0)",
    "action_entropy": "-(" + " + ".join(_MIX_TERM.format(c) for c in _MIX) + ")",
    "size_bb_global_cv": "coalesce(stddev_pop(CASE WHEN mean_size_bb > 0 THEN mean_size_bb END) / avg(CASE WHEN mean_size_bb > 0 THEN mean_size_bb END), 0)",
    "pot_ratio_global_cv": "coalesce(stddev_pop(CASE WHEN mean_pot_ratio > 0 THEN mean_pot_ratio END) / avg(CASE WHEN mean_pot_ratio > 0 THEN mean_pot_ratio END), 0)",
}

_EDGES = ("pot_ratio < 0.4", "pot_ratio >= 0.4 AND pot_ratio < 0.6", "pot_ratio >= 0.6 AND pot_ratio < 0.8", "pot_ratio >= 0.8 AND pot_ratio < 1.1", "pot_ratio >= 1.1")
#: Name -> aggregate over a group's sized actions (of hands with a known hero).
POOLED = {
    **{f"pot_hist_{i}": f"coalesce(count_if({e}) / nullif(count(pot_ratio), 0), 0)" for i, e in enumerate(_EDGES)},
    "distinct_pot_frac": "coalesce(count(DISTINCT rint(pot_ratio * 10) / 10) / nullif(count(pot_ratio), 0), 0)",
    "distinct_size_bb_frac": "coalesce(count(DISTINCT rint(size_bb * 10) / 10) / nullif(count(size_bb), 0), 0)",
    "n_aggr_pool": "count(pot_ratio)",
    "coarse_bucket_diversity": "coalesce(count(DISTINCT visible) / nullif(count(size_bb), 0), 0)",
}
STATS = ("mean", "std", "q25", "q75")
ACTOR_STATS = ("mean", "std", "min", "max", "q10", "q50", "q90")


def _statistics(features: DataFrame, stats: tuple[str, ...], columns: list[str], prefix: str = "", approximate: bool = False) -> DataFrame:
    """Statistics of columns by group. All quantiles of a column come from one sorted copy of its values (or one sketch)."""
    plain = {"mean": F.avg, "std": F.stddev_pop, "min": F.min, "max": F.max}
    quantiles = [s for s in stats if s not in plain]
    points = F.array(*[F.lit(int(s[1:]) / 100) for s in quantiles])
    at = (lambda c: F.percentile_approx(c, points, 10_000)) if approximate else (lambda c: F.percentile(c, points))
    sums = [plain[s](c).cast("double").alias(f"{prefix}{s}_{c}") for s in stats if s in plain for c in columns]
    out = features.groupBy("group_id").agg(*sums, *[at(c).alias(f"_q_{c}") for c in columns])
    named = {f"{prefix}{s}_{c}": F.get(f"_q_{c}", F.lit(i)).cast("double") for i, s in enumerate(quantiles) for c in columns}
    return out.select("group_id", *[named.get(n, F.col(n)).alias(n) for n in (f"{prefix}{s}_{c}" for s in stats for c in columns)])


def hand_statistics(features: DataFrame, approximate: bool = False) -> DataFrame:
    """Mean, deviation and quartiles of the 44 hand features by group. ``approximate`` takes sketches of the quartiles, for groups too
    large to sort."""
    return _statistics(features, STATS, HAND_FEATURES, approximate=approximate)


def consistency(features: DataFrame) -> DataFrame:
    return features.groupBy("group_id").agg(*doubles(CONSISTENCY))


def concentration(rows: DataFrame, keys: list[str], value: str, prefix: str) -> DataFrame:
    """keys, {prefix}_entropy, {prefix}_modal of the distribution of a value (nulls left out)."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("c"))
    n = F.sum("c")
    entropy = F.ln(n) - F.sum(F.col("c") * F.ln("c")) / n
    return counts.groupBy(*keys).agg(entropy.alias(f"{prefix}_entropy"), (F.max("c") / n).alias(f"{prefix}_modal"))


def pooled_sizes(seq: Sequences) -> DataFrame:
    """Distribution of the hero's sizes and pot shares over a group: group_id and 14 features; groups without any are absent."""
    rows = steps(seq).where("size_bb IS NOT NULL OR pot_ratio IS NOT NULL")
    rows = rows.withColumn("visible", F.when(F.col("size_bb").isNotNull(), S.snapped(F.col("size_bb"), S.VISIBLE_GRID)))
    rows = rows.withColumn("fraction", F.when(F.col("pot_ratio").isNotNull(), S.snapped(F.col("pot_ratio"), S.FRACTION_GRID)))
    rows = rows.withColumn("size_tenth", S.half_even(F.col("size_bb"), 1)).select("group_id", "pot_ratio", "size_bb", "visible", "fraction", "size_tenth")
    out = rows.groupBy("group_id").agg(*doubles(POOLED))
    hist = [F.col(f"pot_hist_{i}") for i in range(5)]
    out = out.withColumn("pot_modal_dominance", F.greatest(*hist))
    out = out.withColumn("pot_ratio_entropy", -sum((F.when(h > 0, h * F.ln(h)).otherwise(0.0) for h in hist), F.lit(0.0)))
    for value, prefix in (("visible", "coarse_bucket"), ("fraction", "coarse_potfrac"), ("size_tenth", "size_bb")):
        part = concentration(rows, ["group_id"], value, prefix)
        out = out.join(part, "group_id", "left").fillna(0.0, [f"{prefix}_entropy", f"{prefix}_modal"])
    # potfrac is only defined where there are sizes
    some = F.col("distinct_size_bb_frac") > 0
    out = out.withColumn("coarse_potfrac_ent", F.when(some, F.col("coarse_potfrac_entropy")).otherwise(0.0))
    out = out.withColumn("coarse_potfrac_modal", F.when(some, F.col("coarse_potfrac_modal")).otherwise(0.0))
    return out.withColumnRenamed("coarse_bucket_entropy", "coarse_bucket_ent").drop("coarse_potfrac_entropy", "size_bb_modal")


def policy(seq: Sequences) -> DataFrame:
    """How far the hero's action follows from its context (street, facing, pot bucket), and from the action before: eight features."""
    hero = steps(seq).where("hero").select(*KEYS, "action_idx", "street", "facing", "pot_bucket", "action_type")
    context = ["group_id", "street", "facing", "pot_bucket"]
    by_action = hero.groupBy(*context, "action_type").agg(F.count("*").alias("c"))
    n = F.sum("c")
    per = by_action.groupBy(*context).agg(n.alias("n"), F.max("c").alias("top"), (F.ln(n) - F.sum(F.col("c") * F.ln("c")) / n).alias("h"))
    total = F.sum("n")
    out = per.groupBy("group_id").agg(
        (F.sum(F.col("n") * F.col("h")) / total).alias("cond_action_entropy"), F.avg((F.col("top") / F.col("n") >= 0.8).cast("double")).alias("policy_determinism"),
        (F.count("*") / total).alias("context_coverage"), (F.sum("top") / total).alias("mean_context_repeat"), total.cast("double").alias("n_decisions"),
    )
    out = out.join(concentration(hero, ["group_id"], "action_type", "unconditional_action").drop("unconditional_action_modal"), "group_id", "left")
    after = F.lead("action_type").over(Window.partitionBy(*KEYS).orderBy("action_idx"))
    pairs = hero.withColumn("after", after).where("after IS NOT NULL").withColumn("pair", F.concat_ws(">", "action_type", "after"))
    repeats = pairs.groupBy("group_id").agg(F.avg((F.col("action_type") == F.col("after")).cast("double")).alias("repeat_action_rate"))
    grams = concentration(pairs, ["group_id"], "pair", "bigram").drop("bigram_modal")
    return out.join(grams, "group_id", "left").join(repeats, "group_id", "left").fillna(0.0)


def actor_statistics(features: DataFrame) -> DataFrame:
    """Seven statistics of the 28 actor features by group."""
    return _statistics(features, ACTOR_STATS, ACTOR_FEATURES, "hf_")


def _line(column: str) -> Column:
    """A column of the ordered steps, joined."""
    return F.array_join(F.transform("steps", lambda x: x[column]), ".")


def actor_group(seq: Sequences) -> DataFrame:
    """The 18 features of a group's hands as a whole: stacks, raises and calls, repeated signatures, rates, size."""
    units = seq.hands.select(*KEYS, "bb")
    stacks = seq.players.where("starting_stack IS NOT NULL AND starting_stack <> 0").join(units, KEYS).withColumn("s", F.col("starting_stack") / F.col("bb"))
    stacks = stacks.groupBy("group_id").agg(
        F.avg("s").alias("hf_stack_mean_bb"), F.stddev_pop("s").alias("hf_stack_std_bb"), F.aggregate(F.percentile("s", F.array(F.lit(0.75), F.lit(0.25))), F.lit(None).cast("double"), lambda a, q: F.coalesce(a - q, q)).alias("hf_stack_iqr_bb")
    )
    rows = actor_steps(seq)
    role = F.when(F.col("hero"), "H").otherwise("o")
    index = redundancy.grid_index(F.col("norm_bb")).cast("string")
    rows = rows.select(*KEYS, "action_idx", "action_type", "street", "raise_to", "call_to", "n_same_action", "n", "hero", role.alias("role"), index.alias("cell"))
    ordered = F.array_sort(F.collect_list(F.struct("action_idx", *[F.coalesce(c, F.lit("?")).alias(c) for c in ("action_type", "role", "street", "cell")])))
    per = rows.groupBy(*KEYS).agg(
        ordered.alias("steps"), F.count("raise_to").alias("raises"), F.count("call_to").alias("calls"), F.count("*").alias("n"),
        F.avg(F.ln("n") - F.ln("n_same_action")).alias("entropy"), F.avg(F.col("action_type").isin("bet", "raise").cast("double")).alias("aggr"), F.max("hero").alias("hero"),
    )
    names = {"action_sig": "action_type", "role_sig": "role", "street_sig": "street", "bucket_sig": "cell"}
    per = per.select("*", *[_line(c).alias(name) for name, c in names.items()]).drop("steps")
    per = seq.hands.select(*KEYS).join(per, KEYS, "left").fillna("", list(names)).fillna(0, ["raises", "calls", "n"]).fillna(0.0, ["entropy", "aggr"]).fillna(False, ["hero"])
    total = F.sum("n")
    out = per.groupBy("group_id").agg(
        F.coalesce(F.sum("raises") / F.nullif(total, F.lit(0)), F.lit(0.0)).alias("hf_raise_to_share"), F.coalesce(F.sum("calls") / F.nullif(total, F.lit(0)), F.lit(0.0)).alias("hf_call_to_share"),
        F.avg((F.col("aggr") > 0.5).cast("double")).alias("hf_high_aggr_rate"), F.avg((F.col("entropy") < 0.5).cast("double")).alias("hf_low_entropy_rate"),
        F.avg((~F.col("hero")).cast("double")).alias("hf_zero_hero_rate"), F.count("*").cast("double").alias("hf_hand_count"), F.log1p(F.count("*")).alias("hf_hand_count_log"),
    )
    for name in names:
        counts = per.groupBy("group_id", name).agg(F.count("*").alias("c"))
        share = counts.groupBy("group_id").agg((F.max("c") / F.sum("c")).alias(f"hf_{name}_top"), (F.count("*") / F.sum("c")).alias(f"hf_{name}_uniq"))
        out = out.join(share, "group_id")
    return out.join(stacks, "group_id", "left").fillna(0.0, ["hf_stack_mean_bb", "hf_stack_std_bb", "hf_stack_iqr_bb"])


def group_features(seq: Sequences, with_compression: bool = True) -> DataFrame:
    """The whole vector: 176 statistics and 36 measures of the hero's play (0 where no hero is known), 214 of all actors, 7 of redundancy.
    The steps are written once and read by every frame."""
    seq = prepared(seq)
    hands = hand_features(seq)
    out = seq.hands.select("group_id").distinct()
    # the mean roundness is both a statistic and a measure; the latter's name is longer here, so that names differ
    measures = consistency(hands).withColumnRenamed("mean_roundness", "mean_roundness_of_hands")
    for part in (hand_statistics(hands), measures, pooled_sizes(seq), policy(seq), actor_statistics(actor_features(seq)), actor_group(seq)):
        out = out.join(part, "group_id", "left")
    out = out.fillna(0.0)
    return out.join(redundancy.redundancy_features(seq, with_compression), "group_id", "left")
