"""Features of each hand: the hero's 44 (``hand_features``) and 28 of all actors (``actor_features``).

Both read the actions once, add what depends on order with windows over a hand, and end in one aggregation by hand: all of it shares one
shuffle by (group_id, hand_id). Aggregates are SQL expressions by name, so they are a select list that Catalyst plans as a whole.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seqspark.functions import scalars as S
from seqspark.sources.io import written
from seqspark.sources.tables import Sequences

KEYS = ["group_id", "hand_id"]

_AGGR = "action_type IN ('bet', 'raise')"
_STREET_AGGR = "coalesce(count_if(hero AND street = '{0}' AND {1}) / nullif(count_if(hero AND street = '{0}'), 0), 0)"
_N = "greatest(1, count_if(hero))"

#: Name -> aggregate over a hand's steps (all actors; hero marks the hero's).
HAND_AGGREGATES = {
    "n_actions": "count_if(hero)",
    "vpip": "least(1, count_if(hero AND street = 'preflop' AND action_type IN ('call', 'bet', 'raise')))",
    "pfr": f"least(1, count_if(hero AND street = 'preflop' AND {_AGGR}))",
    "folded_pre": "least(1, count_if(hero AND street = 'preflop' AND action_type = 'fold'))",
    "n_pre_raises": "count_if(hero AND street = 'preflop' AND action_type = 'raise')",
    **{f"{a}_rate": f"count_if(hero AND action_type = '{a}') / {_N}" for a in ("fold", "call", "check", "raise", "bet")},
    "aggression": f"count_if(hero AND {_AGGR}) / greatest(1, count_if(hero AND action_type IN ('call', 'check')))",
    "aggr_frac": f"count_if(hero AND {_AGGR}) / {_N}",
    "pre_aggr": _STREET_AGGR.format("preflop", _AGGR),
    "flop_aggr": _STREET_AGGR.format("flop", _AGGR),
    "turn_aggr": _STREET_AGGR.format("turn", _AGGR),
    "river_aggr": _STREET_AGGR.format("river", _AGGR),
    "fold_to_bet": "coalesce(count_if(hero AND facing AND action_type = 'fold') / nullif(count_if(hero AND facing), 0), 0)",
    "faced_bet": "count_if(hero AND facing)",
    "max_street": "coalesce(max(CASE WHEN hero THEN street_ord END), 0)",
    "mean_size_bb": "coalesce(avg(size_bb), 0)",
    "std_size_bb": "coalesce(stddev_pop(size_bb), 0)",
    "min_size_bb": "coalesce(min(size_bb), 0)",
    "max_size_bb": "coalesce(max(size_bb), 0)",
    "mean_pot_ratio": "coalesce(avg(pot_ratio), 0)",
    "std_pot_ratio": "coalesce(stddev_pop(pot_ratio), 0)",
    "roundness": "coalesce(avg(round_flag), 0)",
    "n_aggr_actions": f"count_if(hero AND {_AGGR})",
    "check_raise": f"count_if(hero AND before = 'check' AND {_AGGR})",
    "bet_fold": "CASE WHEN min(CASE WHEN hero AND action_type = 'bet' THEN action_idx END) < max(CASE WHEN hero AND action_type = 'fold' THEN action_idx END) THEN 1 ELSE 0 END",
    "call_raise": "count_if(hero AND before = 'call' AND action_type = 'raise')",
    "limp_reraise": "count_if(hero AND before = 'call' AND action_type = 'raise' AND street = 'preflop')",
}
#: Name -> expression over the aggregates and the hand's own columns.
HAND_DERIVED = {
    "vpip_pfr_gap": "vpip - pfr",
    "postflop_aggr": "(flop_aggr + turn_aggr + river_aggr) / 3",
    "saw_flop": "CASE WHEN max_street >= 1 THEN 1 ELSE 0 END",
    "saw_turn": "CASE WHEN max_street >= 2 THEN 1 ELSE 0 END",
    "saw_river": "CASE WHEN max_street >= 3 THEN 1 ELSE 0 END",
    "saw_showdown": "CASE WHEN showdown THEN 1 ELSE 0 END",
    "n_board_streets": "n_board",
    "won": "CASE WHEN hero_won THEN 1 ELSE 0 END",
    "stack_bb": "hero_stack / bb",
    "rel_pos": "coalesce((((hero_seat - button_seat) % greatest(1, n_seats)) + greatest(1, n_seats)) % greatest(1, n_seats) / greatest(1, n_seats), 0.5)",
    "n_players": "n_seats",
    "total_pot_bb": "total_pot / bb",
    "size_cv": "CASE WHEN mean_size_bb > 0 THEN std_size_bb / mean_size_bb ELSE 0 END",
}
HAND_FEATURES = [*HAND_AGGREGATES, *HAND_DERIVED]

#: The same of all actors; n is the number of actions of the hand.
ACTOR_AGGREGATES = {
    "action_entropy": "avg(ln(n) - ln(n_same_action))",
    "actor_entropy": "avg(ln(n) - ln(n_same_seat))",
    "street_entropy": "avg(ln(n) - ln(n_same_street))",
    "action_switch": "coalesce(count_if(action_idx_in > 1 AND action_changed) / nullif(count(*) - 1, 0), 0)",
    "actor_switch": "coalesce(count_if(action_idx_in > 1 AND seat_changed) / nullif(count(*) - 1, 0), 0)",
    "action_run": "max(action_run_length) / count(*)",
    "actor_run": "max(seat_run_length) / count(*)",
    "pot_delta_mean": "avg(pot_after_bb - pot_before_bb)",
    "pot_growth": "coalesce(max(CASE WHEN action_idx_in = n THEN pot_after_bb END) / nullif(max(CASE WHEN action_idx_in = 1 AND pot_before_bb > 0 THEN pot_before_bb END), 0), 0)",
    "pot_monotonic": "count_if(pot_after_bb - pot_before_bb >= 0) / count(*)",
    "hero_share": "count_if(hero) / count(*)",
    "n_distinct_actors": "count(DISTINCT coalesce(cast(seat AS string), '-'))",
    "n_streets": "count(DISTINCT coalesce(street, '-'))",
    "n_actions": "count(*)",
    "bucket_amt_mean": "coalesce(avg(bucket), 0)",
    "nonzero_amt_share": "count(bucket) / count(*)",
    **{f"{a}_share": f"count_if(action_type = '{a}') / greatest(1, count_if(action_type IN ('call', 'check', 'fold', 'bet', 'raise')))" for a in ("call", "check", "fold", "bet", "raise")},
    "aggr_share": f"count_if({_AGGR}) / greatest(1, count_if(action_type IN ('call', 'check', 'fold', 'bet', 'raise')))",
    "preflop_share": "count_if(street = 'preflop') / count(*)",
    "postflop_share": "count_if(street IS NULL OR street <> 'preflop') / count(*)",
    "bucket_entropy": "coalesce(avg(CASE WHEN bucket IS NOT NULL THEN ln(n_bucketed) - ln(n_same_bucket) END), 0)",
    "bucket_amt_std": "coalesce(stddev_pop(bucket), 0)",
    "pot_before_bb": "avg(pot_before_bb)",
    "pot_after_bb": "avg(pot_after_bb)",
}
ACTOR_FEATURES = list(ACTOR_AGGREGATES)


def doubles(spec: dict[str, str]) -> list:
    return [F.expr(f"CAST({e} AS double)").alias(name) for name, e in spec.items()]


def steps(seq: Sequences) -> DataFrame:
    """The actions with their hand's hero and unit, and what depends on the order: facing (the last action of another actor before the
    hero's, since the hero's last one, was a bet or raise), before (the hero's action before, on the same street)."""
    if seq.stepped is not None:
        return seq.stepped
    rows = seq.actions.join(seq.hands.select(*KEYS, "hero_seat", "bb"), KEYS)
    hero, aggr = F.coalesce(F.col("seat") == F.col("hero_seat"), F.lit(False)), F.col("action_type").isin("bet", "raise")
    rows = rows.withColumn("hero", hero).withColumn("street_ord", S.street_ordinal(F.col("street")))
    hand = Window.partitionBy(*KEYS).orderBy("action_idx")
    said = F.when(F.col("hero"), False).when(aggr, True).when(F.col("action_type").isin("call", "check", "fold"), False)
    facing = F.last(said, ignorenulls=True).over(hand.rowsBetween(Window.unboundedPreceding, -1))
    line = Window.partitionBy(*KEYS, "hero", "street").orderBy("action_idx")
    rows = rows.withColumn("facing", F.col("hero") & F.coalesce(facing, F.lit(False)))
    rows = rows.withColumn("before", F.when(F.col("hero"), F.lag("action_type").over(line)))
    sized = F.col("hero") & aggr
    rows = rows.withColumn("pot_ratio", F.when(sized, S.ratio(F.col("amount"), F.col("pot_before"))))
    rows = rows.withColumn("size_bb", F.when(sized & (F.col("norm_bb") > 0), F.col("norm_bb")))
    rows = rows.withColumn("round_flag", F.when(F.col("size_bb").isNotNull(), S.roundness(F.col("size_bb"), F.col("pot_ratio"))))
    return rows.withColumn("pot_bucket", S.pot_bucket(F.col("pot_before") / F.col("bb")))


def hand_features(seq: Sequences) -> DataFrame:
    """group_id, hand_id and 44 features of every hand whose hero is known, also of hands without actions."""
    hands = seq.hands.where("hero_seat IS NOT NULL")
    own = ["hero_seat", "bb", "button_seat", "hero_stack", "total_pot", "showdown"]
    hands = hands.select(*KEYS, *own, F.col("n_players").alias("n_seats"), F.col("n_board_streets").alias("n_board"), F.col("won").alias("hero_won"))
    found = steps(seq).groupBy(*KEYS).agg(*doubles(HAND_AGGREGATES))
    out = hands.join(found, KEYS, "left").fillna(0.0, list(HAND_AGGREGATES))
    out = out.select("*", *doubles({k: v for k, v in HAND_DERIVED.items()}))
    return out.select(*KEYS, *HAND_FEATURES)


def actor_steps(seq: Sequences) -> DataFrame:
    """The actions with counts of equal ones in their hand, runs, and amounts snapped to the grid."""
    if seq.stepped is not None:
        return seq.stepped
    rows = steps(seq)
    hand = Window.partitionBy(*KEYS)
    order = hand.orderBy("action_idx")
    same = lambda c: F.count("*").over(Window.partitionBy(*KEYS, c))
    rows = rows.withColumn("n", F.count("*").over(hand)).withColumn("action_idx_in", F.row_number().over(order))
    rows = rows.withColumn("n_same_action", same("action_type")).withColumn("n_same_seat", same("seat")).withColumn("n_same_street", same("street"))
    for name, c in (("action", "action_type"), ("seat", "seat")):
        rows = rows.withColumn(f"{name}_changed", ~F.col(c).eqNullSafe(F.lag(c).over(order)))
        rows = rows.withColumn(f"{name}_run", F.sum(F.col(f"{name}_changed").cast("int")).over(order))
        rows = rows.withColumn(f"{name}_run_length", same(f"{name}_run"))
    rows = rows.withColumn("bucket", F.when(F.col("norm_bb") > 0, S.snapped(F.col("norm_bb"), S.EXACT_GRID)))
    rows = rows.withColumn("n_bucketed", F.count("bucket").over(hand)).withColumn("n_same_bucket", same("bucket"))
    return rows.withColumn("pot_before_bb", F.col("pot_before") / F.col("bb")).withColumn("pot_after_bb", F.col("pot_after") / F.col("bb"))


def prepared(seq: Sequences) -> Sequences:
    """seq with its steps as a written table: actions are shuffled by hand once, and what reads them afterwards shuffles a row a hand."""
    hands = written(seq.hands)
    stepped = written(actor_steps(replace(seq, hands=hands)))
    return Sequences(stepped.select(*seq.actions.columns), hands, seq.players, stepped)


def actor_features(seq: Sequences) -> DataFrame:
    """group_id, hand_id and 28 features of all actors, 0 for hands without actions."""
    found = actor_steps(seq).groupBy(*KEYS).agg(*doubles(ACTOR_AGGREGATES))
    return seq.hands.select(*KEYS).join(found, KEYS, "left").fillna(0.0, ACTOR_FEATURES)


def first_hands(features: DataFrame, n: int = 40) -> DataFrame:
    """The first n hands of each group: what a padded tensor of hands holds."""
    place = F.row_number().over(Window.partitionBy("group_id").orderBy("hand_id"))
    return features.withColumn("place", place).where(F.col("place") <= n)


def standardised(features: DataFrame, columns: list[str]) -> DataFrame:
    """Columns less their mean over their population deviation, both over rows that are not all 0; rows that are stay 0."""
    some = F.greatest(*[F.abs(F.col(c)) for c in columns]) > 0
    sums = features.where(some).agg(*[F.avg(c).alias(f"_m_{c}") for c in columns], *[F.stddev_pop(c).alias(f"_s_{c}") for c in columns])
    rows = features.withColumn("_some", some).crossJoin(F.broadcast(sums))
    scaled = [F.when(F.col("_some"), (F.col(c) - F.col(f"_m_{c}")) / (F.col(f"_s_{c}") + 1e-6)).otherwise(0.0).alias(c) for c in columns]
    return rows.select(*[c for c in features.columns if c not in columns], *scaled)
