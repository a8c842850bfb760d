import json
import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from seqspark.operators import groups, hands, metrics, redundancy, scores, selection, sets
from seqspark.sources import io, views
from seqspark.sources.tables import HAND, sequences_of
from pyspark.sql import types as T

GROUP = T.StructType([T.StructField("group_id", T.StringType()), T.StructField("hands", T.ArrayType(HAND))])


def action(seat, kind, street="preflop", amount=0.0, before=1.0, after=1.0):
    return {"actor_seat": seat, "action_type": kind, "street": street, "amount": amount, "normalized_amount_bb": amount, "pot_before": before, "pot_after": after, "raise_to": None, "call_to": None}


def hand(actions, hero=1, bb=1.0, button=0, winners=("1",), players=((1, "u1", 50.0), (2, "u2", 80.0))):
    return {
        "metadata": {"hero_seat": hero, "bb": bb, "button_seat": button},
        "players": [{"seat": s, "player_uid": u, "starting_stack": x} for s, u, x in players],
        "actions": actions,
        "outcome": {"winners": list(winners), "payouts": {}, "total_pot": 6.0, "showdown": True},
        "streets": [{"street": "preflop", "board_cards": []}, {"street": "flop", "board_cards": ["x"]}],
    }


def frame(spark, **named):
    return spark.createDataFrame([(k, v) for k, v in named.items()], GROUP)


def test_one_hand_by_hand(spark):
    acts = [action(2, "raise", amount=3.0), action(1, "call", amount=3.0), action(1, "check", "flop"), action(2, "bet", "flop", 4.0), action(1, "raise", "flop", 5.0, before=10.0), action(1, "fold", "turn")]
    row = hands.hand_features(sequences_of(frame(spark, g=[hand(acts)]))).first().asDict()
    expected = {
        "n_actions": 4, "vpip": 1, "pfr": 0, "vpip_pfr_gap": 1, "fold_rate": 0.25, "raise_rate": 0.25, "aggression": 0.5, "flop_aggr": 0.5, "faced_bet": 2, "fold_to_bet": 0, "check_raise": 1, "bet_fold": 0,
        "max_street": 2, "saw_turn": 1, "saw_river": 0, "mean_size_bb": 5, "mean_pot_ratio": 0.5, "roundness": 1, "won": 1, "stack_bb": 50, "rel_pos": 0.5, "n_players": 2, "total_pot_bb": 6, "n_board_streets": 1,
    }
    assert {k: row[k] for k in expected} == expected


def test_hands_without_a_hero_or_actions(spark):
    seq = sequences_of(frame(spark, a=[hand([], hero=None)], b=[hand([])], c=[hand([action(2, "bet")], bb=0.0)]))
    found = {r["group_id"]: r for r in hands.hand_features(seq).collect()}
    assert set(found) == {"b", "c"}
    assert found["b"]["n_actions"] == 0 and found["c"]["stack_bb"] == 50.0 / 0.02
    actors = {r["group_id"]: r for r in hands.actor_features(seq).collect()}
    assert set(actors) == {"a", "b", "c"} and actors["b"]["action_entropy"] == 0


def test_whole_vector_of_degenerate_groups(spark):
    seq = sequences_of(frame(spark, a=[hand([], hero=None)], b=[hand([action(1, "bet", amount=2.0)]), hand([action(1, "bet", amount=2.0)])]))
    rows = {r["group_id"]: r.asDict() for r in groups.group_features(seq).collect()}
    assert len(rows["a"]) == 434 and None not in rows["a"].values()
    assert rows["a"]["rp_vendi_frac"] == 1 and rows["b"]["rp_exact_dup_frac_action"] == 0.5 and rows["b"]["hf_hand_count"] == 2


def test_redundancy_of_all_hands_and_actions(spark):
    kinds, streets = ("bet", "call", "check", "fold", "raise"), ("preflop", "flop", "turn", "river")
    draw = random.Random(4)
    # what is new begins at the 71st hand and after more than 4,000 actions; some hands have no pair of actions
    lines = [[("preflop", "check")] * 60] * 70 + [[(draw.choice(streets), draw.choice(kinds)) for _ in range(n)] for n in (0, 1, 1, 2, 2, 3, 3, 4, 5, 6, 8, 12)] + [[("flop", "bet"), ("flop", "call")]] * 3
    assert sum(map(len, lines[:70])) > redundancy.MAX_ACTIONS
    sets_ = [set(zip(x, x[1:], strict=False)) for x in lines]
    alike = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    rows = [sum(alike(a, b) for j, b in enumerate(sets_) if i != j) for i, a in enumerate(sets_)]
    w = [(r + 1) / (sum(rows) + len(rows)) for r in rows]
    flat = [kind for x in lines for _, kind in x]
    pairs, firsts = Counter(zip(flat, flat[1:], strict=False)), Counter(flat[:-1])
    expected = {
        "rp_pair_jaccard_mean": sum(rows) / len(rows) / (len(rows) - 1), "rp_vendi_frac": math.exp(-sum(x * math.log(x) for x in w)) / len(w),
        "rp_entropy_rate": -sum(c * math.log2(c / firsts[a]) for (a, _), c in pairs.items()) / pairs.total(),
    }
    seq = sequences_of(frame(spark, g=[hand([action(1, kind, street, 2.0) for street, kind in x]) for x in lines], one=[hand([action(1, "bet")])]))
    found = {r["group_id"]: r.asDict() for r in redundancy.redundancy_features(seq, with_compression=False).collect()}
    assert {k: found["g"][k] for k in expected} == pytest.approx(expected, abs=1e-9)
    assert found["one"]["rp_pair_jaccard_mean"] == 0 and found["one"]["rp_vendi_frac"] == 1
    blocks = {r["group_id"]: r.asDict() for r in redundancy.pairwise(redundancy._rich(seq), block=3).collect()}
    assert {k: blocks["g"][k] for k in list(expected)[:2]} == pytest.approx({k: expected[k] for k in list(expected)[:2]}, abs=1e-9)


def test_signatures_and_scores(spark):
    same = [hand([action(1, "bet", amount=2.0), action(2, "fold")]) for _ in range(3)]
    seq = sequences_of(frame(spark, a=same))
    signed = redundancy.signatures(seq)
    assert {r["signature"] for r in signed.collect()} == {"pf#pBm.pF0"}
    score = redundancy.signature_scores(redundancy.signature_shares(signed)).first()
    assert score["top_share"] == 1 and score["score"] == 1.0
    empty = redundancy.group_scores(spark.createDataFrame([("a",), ("z",)], "group_id string"), redundancy.signature_scores(redundancy.signature_shares(signed)))
    assert empty.where("group_id = 'z'").first()["score"] == 0.5


def ranked(spark, *scores_):
    return spark.createDataFrame([(0, i, float(s)) for i, s in enumerate(scores_)], "batch_id int, idx int, score double")


def values(df):
    return [r["score"] for r in df.orderBy("idx").collect()]


def test_small_batches_are_not_ranked(spark):
    assert values(scores.batch_rank(ranked(spark, 0.3, 0.9, 0.1))) == [0.3, 0.9, 0.1]
    four = values(scores.batch_rank(ranked(spark, 0.3, 0.3, 0.3, 0.3)))
    assert four == sorted(four) and len(set(four)) == 4
    assert spark.range(1).select(F.lit(0).alias("batch_id"), F.lit(0).alias("idx"), F.lit(0.7).alias("score")).withColumn("r", scores.rank01()).first()["r"] == 0


def test_min_positives_and_budget(spark):
    assert values(scores.min_positives(ranked(spark, 0.1, 0.4), 1)) == [0.1, 0.51]
    assert values(scores.min_positives(ranked(spark, 0.40, 0.41), 1)) == [0.40, 0.41]
    out = values(scores.positive_budget(ranked(spark, 0.9, 0.8, 0.7, 0.2)))
    assert out[0] == 0.9 and 0.2 < out[2] < out[1] < 0.5 and out[3] == 0.2


def test_metrics_without_a_class(spark):
    rows = spark.createDataFrame([(1, 0.4), (1, 0.9)], "label int, score double")
    m = metrics.ranking_metrics(rows, []).first()
    assert m["auc"] is None and m["ap"] == 1
    assert metrics.order_threshold(rows, []).first()["threshold"] == 0.5
    assert metrics.quantile_threshold(rows, []).first()["threshold"] == 0.5


def test_promotion_without_a_baseline(spark):
    rows = spark.createDataFrame([("x", 0.5, 0.01, 0.9, 0.1, 0.3, False)], "model string, reward double, hard_fpr double, safety double, positive_rate double, hard_recall double, forced boolean")
    clean = selection.gate_reasons(rows)
    none = rows.where("false")
    assert selection.promotion(clean, none).first()["accepted"]
    better = rows.withColumn("reward", F.lit(0.9))
    assert not selection.promotion(clean, better).first()["accepted"]


def test_releases_are_paired_by_place(spark, tmp_path):
    doc = {"chunks": [{"split": "train", "chunks": [[hand([])], [hand([]), hand([])]], "groundTruth": [0, 1]}, {"chunks": [[hand([])]], "groundTruth": [1]}]}
    (tmp_path / "2024-01-02.json").write_text(json.dumps(doc))
    rows = io.read_releases(spark, str(tmp_path)).orderBy("group_id").collect()
    assert [(r["release"], r["split"], r["label"], len(r["hands"])) for r in rows] == [("2024-01-02", "train", 0, 1), ("2024-01-02", "train", 1, 2), ("2024-01-02", "train", 1, 1)]


def test_captures_are_unwrapped(spark, tmp_path):
    for name, doc in {"a": [hand([])], "b": {"hands": [hand([])]}, "c": {"chunk": [hand([])]}, "d": {"hands": []}}.items():
        (tmp_path / f"{name}.json").write_text(json.dumps(doc))
    assert sorted(r["group_id"] for r in io.read_captures(spark, str(tmp_path)).collect()) == ["a", "b", "c"]


def test_weight_grid_has_the_prior_once(spark):
    grid = sets.weight_grid(spark, {"a": (0, 3), "b": (0, 3), "c": (0, 4)}, {"a": 1, "b": 1, "c": 2}, 4).collect()
    assert [r for r in grid if r["candidate"] == 0][0].asDict() == {"candidate": 0, "a": 1, "b": 1, "c": 2}
    assert sum((r["a"], r["b"], r["c"]) == (1, 1, 2) for r in grid) == 1 and all(r["a"] + r["b"] + r["c"] == 4 for r in grid)


def test_feature_cache_and_views(spark, tmp_path):
    rows = spark.createDataFrame([("g", "r1", 1.0)], "group_id string, release string, x double")
    for _ in range(2):
        assert io.cached_features(spark, str(tmp_path / "f"), lambda: rows).count() == 1
    assert selection.feature_views(["x", "hf_y", "rp_z"]) == {"PH": ["x"], "V2": ["hf_y", "rp_z"], "UN": ["x", "hf_y", "rp_z"]}
    assert selection.without(["mean_x", "q25_x", "y"], ["q25"], ["y"]) == ["mean_x"]


@pytest.mark.parametrize("rate", [0.0, 0.25, 1.0])
def test_dropout_keeps_small_groups(spark, rate):
    rows = spark.createDataFrame([("a", i) for i in range(4)] + [("b", i) for i in range(40)], "group_id string, hand_id int")
    left = {r["group_id"]: r["n"] for r in sets.hand_dropout(rows, rate).groupBy("group_id").agg(F.count("*").alias("n")).collect()}
    assert left["a"] == 4 and (left["b"] == 40 if rate in (0.0, 1.0) else 5 <= left["b"] < 40)


def test_loaded_groups_are_sanitised(spark, tmp_path):
    import json

    from seqspark.operators import sanitise
    from seqspark.sources import io

    action = lambda seat, kind: {"actor_seat": seat, "action_type": kind, "street": "preflop", "normalized_amount_bb": 2.6}
    hand = {"metadata": {"hero_seat": 4, "bb": 1.0}, "actions": [action(4, "call"), action(9, "raise"), action(4, "fold")]}
    (tmp_path / "2026-01-01.json").write_text(json.dumps({"chunks": [{"split": "train", "chunks": [[hand], [hand, hand]], "groundTruth": [0, 1]}]}))
    rows = sanitise.sanitised_groups(io.read_releases(spark, str(tmp_path))).collect()
    assert len(rows) == 9 and {r["seat"] for r in rows} == {0, 1} and {r["release"] for r in rows} == {"2026-01-01"} and {r["label"] for r in rows} == {0, 1}
    assert all(abs(r["norm_bb"] - 3) <= 0.15 for r in rows)


def test_first_of_each_breaks_ties(spark):
    rows = spark.createDataFrame([("a", 1, "y"), ("a", 1, "x"), ("b", 2, "z"), (None, 0, "n")], "k string, o int, v string")
    assert sorted(tuple(r) for r in sets.first_of_each(rows, "k", "o").collect()) == [("a", 1, "x"), ("b", 2, "z")]


def test_equal_groups_have_equal_keys(spark):
    groups = spark.createDataFrame([(1, ["a", "b"]), (2, ["a", "b"]), (3, ["b", "a"])], "group_id int, hands array<string>")
    keys = {r["group_id"]: r["k"] for r in groups.select("group_id", sets.content_key(groups).alias("k")).collect()}
    assert keys[1] == keys[2] != keys[3]


def test_equal_sizes_round_as_doubles(spark):
    """4.475 is below its half as a double, so it is one size with 4.47; 93.5 hundredths are even at 94 (F3)."""
    names = {"n_actions", "vpip", "roundness", "saw_showdown", "won", "aggr_frac", "mean_pot_ratio", "fold_rate", "call_rate", "check_rate", "raise_rate", "bet_rate"}
    rows = spark.createDataFrame([(1, 4.475), (1, 4.47), (2, 0.9349999999999999), (2, 0.94)], "group_id int, mean_size_bb double")
    rows = rows.select("*", *[F.lit(0.5).alias(n) for n in sorted(names)])
    assert {r["group_id"]: r["distinct_size_frac"] for r in groups.consistency(rows).collect()} == {1: 0.5, 2: 0.5}


def test_parts_grow_with_the_rows(spark):
    """What a task holds stays the same (F5)."""
    few = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert views.parts_of(spark, spark.range(10), 100) == few and views.parts_of(spark, spark.range(1001), 100) == 11
