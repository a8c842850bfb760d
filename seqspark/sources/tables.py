"""Normalised tables of grouped sequences, and how nested records become them.

A group is a bag of hands that share a focus seat (the hero), a hand an ordered list of actions. Records are read with the declared
schema; a missing number and 0 mean the same.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seqspark.functions import scalars as S

def _struct(**kinds: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in kinds.items()])


_INT, _STR, _DBL = T.IntegerType(), T.StringType(), T.DoubleType()
ACTION = _struct(
    actor_seat=_INT, action_type=_STR, street=_STR, amount=_DBL, normalized_amount_bb=_DBL, pot_before=_DBL, pot_after=_DBL, raise_to=_DBL, call_to=_DBL
)
PLAYER = _struct(seat=_INT, player_uid=_STR, starting_stack=_DBL)
HAND = _struct(
    metadata=_struct(hero_seat=_INT, bb=_DBL, button_seat=_INT),
    players=T.ArrayType(PLAYER),
    actions=T.ArrayType(ACTION),
    outcome=_struct(winners=T.ArrayType(_STR), payouts=T.MapType(_STR, _DBL), total_pot=_DBL, showdown=T.BooleanType()),
    streets=T.ArrayType(_struct(street=_STR, board_cards=T.ArrayType(_STR))),
)
#: A number of the table of actions -> its name in a record.
_ACTION_NUMBERS = {"amount": "amount", "norm_bb": "normalized_amount_bb", "pot_before": "pot_before", "pot_after": "pot_after", "raise_to": "raise_to", "call_to": "call_to"}


@dataclass
class Sequences:
    """actions: group_id, hand_id, action_idx, seat, action_type, street, amount, norm_bb, pot_before, pot_after, raise_to, call_to.
    hands: group_id, hand_id, hero_seat, bb, button_seat, n_players, hero_stack, won, total_pot, showdown, n_board_streets, street_shape.
    players: group_id, hand_id, seat, player_uid, starting_stack.
    stepped: the actions with what depends on their order, where that is already there (``hands.prepared``)."""

    actions: DataFrame
    hands: DataFrame
    players: DataFrame
    stepped: DataFrame | None = None


def flatten_actions(groups: DataFrame) -> DataFrame:
    """Nested hands (group_id, hands) to one row an action, with its place."""
    hands = groups.select("group_id", F.posexplode("hands").alias("hand_id", "hand"))
    rows = hands.select("group_id", "hand_id", F.posexplode("hand.actions").alias("action_idx", "a"))
    return rows.select(
        "group_id", "hand_id", "action_idx", F.col("a.actor_seat").alias("seat"), "a.action_type", "a.street", _zero("a.amount").alias("amount"),
        _zero("a.normalized_amount_bb").alias("norm_bb"), _zero("a.pot_before").alias("pot_before"), _zero("a.pot_after").alias("pot_after"), "a.raise_to", "a.call_to",
    )


def flatten_players(groups: DataFrame) -> DataFrame:
    hands = groups.select("group_id", F.posexplode("hands").alias("hand_id", "hand"))
    rows = hands.select("group_id", "hand_id", F.posexplode("hand.players").alias("place", "p"))
    return rows.select("group_id", "hand_id", "place", "p.seat", "p.player_uid", "p.starting_stack")


def flatten_hands(groups: DataFrame) -> DataFrame:
    """One row a hand: its metadata, the hero's player (the first one with the hero's seat), who won."""
    hands = groups.select("group_id", F.posexplode("hands").alias("hand_id", "h"))
    hero = F.col("h.metadata.hero_seat")
    player = F.get(F.filter("h.players", lambda p: p["seat"] == hero), F.lit(0))
    uid, winners, payouts = player["player_uid"], F.col("h.outcome.winners"), F.col("h.outcome.payouts")
    won = F.coalesce(F.array_contains(winners, hero.cast("string")), F.lit(False)) | F.coalesce(F.array_contains(winners, uid), F.lit(False))
    won = won | F.coalesce(F.try_element_at(payouts, uid) > 0, F.lit(False))
    shape = F.array_join(F.transform("h.streets", lambda s: S.street_code(s["street"])), "")
    boards = F.size(F.filter("h.streets", lambda s: F.size(F.coalesce(s["board_cards"], F.array())) > 0))
    return hands.select(
        "group_id", "hand_id", hero.alias("hero_seat"), S.or_default(F.col("h.metadata.bb"), 0.02).alias("bb"), F.col("h.metadata.button_seat").alias("button_seat"),
        F.coalesce(F.size(F.coalesce("h.players", F.array().cast(T.ArrayType(PLAYER)))), F.lit(0)).alias("n_players"), F.coalesce(player["starting_stack"], F.lit(0.0)).alias("hero_stack"),
        won.alias("won"), _zero("h.outcome.total_pot").alias("total_pot"), F.coalesce("h.outcome.showdown", F.lit(False)).alias("showdown"),
        F.greatest(F.coalesce(boards, F.lit(0)), F.lit(0)).alias("n_board_streets"), F.coalesce(shape, F.lit("")).alias("street_shape"),
    )


def sequences_of(groups: DataFrame) -> Sequences:
    return Sequences(flatten_actions(groups), flatten_hands(groups), flatten_players(groups))


def nested(seq: Sequences) -> DataFrame:
    """group_id and its hands as nested records, which ``sequences_of`` takes apart again: hands in order of their ids (which become places), actions in
    theirs, players by seat. A hand that was won names the hero's seat as winner; a hand's streets are those of its shape, with a card on
    as many of the later ones as had a board. A group is one record, as in the files, so its hands come together."""
    keys = ["group_id", "hand_id"]
    action = F.struct(
        F.col("seat").cast("int").alias("actor_seat"), "action_type", "street", *[F.col(c).cast("double").alias(n) for c, n in _ACTION_NUMBERS.items()]
    )
    player = F.struct(F.col("seat").cast("int").alias("seat"), "player_uid", F.col("starting_stack").cast("double").alias("starting_stack"))
    acts = seq.actions.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("action_idx", action.alias("x")))).alias("acts"))
    seats = seq.players.groupBy(*keys).agg(F.array_sort(F.collect_list(player)).alias("players"))
    late = lambda s, i: F.when(i > F.size("letters") - 1 - F.col("n_board_streets"), F.array(F.lit("?"))).otherwise(F.array().cast("array<string>"))
    street = F.create_map(*[F.lit(x) for name, code in S.STREET_CODES.items() for x in (code, name)])
    rows = seq.hands.join(acts, keys, "left").join(seats, keys, "left").withColumn("letters", F.filter(F.split("street_shape", ""), lambda x: x != ""))
    winners = F.when(F.col("won"), F.array(F.col("hero_seat").cast("string"))).otherwise(F.array().cast("array<string>"))
    hand = F.struct(
        F.struct(F.col("hero_seat").cast("int").alias("hero_seat"), F.col("bb").cast("double").alias("bb"), F.col("button_seat").cast("int").alias("button_seat")).alias("metadata"),
        F.coalesce("players", F.array().cast(T.ArrayType(PLAYER))).alias("players"),
        F.coalesce(F.transform("acts", lambda a: a["x"]), F.array().cast(T.ArrayType(ACTION))).alias("actions"),
        F.struct(winners.alias("winners"), F.lit(None).cast("map<string,double>").alias("payouts"), F.col("total_pot").cast("double").alias("total_pot"), "showdown").alias("outcome"),
        F.transform("letters", lambda x, i: F.struct(street[x].alias("street"), late(x, i).alias("board_cards"))).alias("streets"),
    )
    # the hand's record holds a map, which has no order, so the ids alone are sorted
    packed = F.collect_list(F.struct("hand_id", hand.alias("h")))
    order = F.array_sort(packed, lambda a, b: F.when(a["hand_id"] < b["hand_id"], -1).when(a["hand_id"] > b["hand_id"], 1).otherwise(0))
    return rows.groupBy("group_id").agg(F.transform(order, lambda x: x["h"]).cast(T.ArrayType(HAND)).alias("hands"))


def _zero(name: str) -> Column:
    return F.coalesce(name, F.lit(0.0))
