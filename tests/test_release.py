import pytest
from pyspark.sql import functions as F

from seqspark.operators import metrics, selection
from seqspark.plans import learners, release
from seqspark.sources import io, tables, views
from tests.compare import DATA

X = ["own_a", "own_b", "hf_c", "hf_d"]
WEIGHTS = {"stack": 15, "mono": 11, "mlp": 14, "drse": 10}


@pytest.fixture(scope="module")
def rows(spark):
    noise = lambda k: F.pmod(F.xxhash64("id", F.lit(k)), F.lit(1000)) / 1000
    df = spark.range(160).select("id", F.col("id").alias("group_id"), (F.col("id") % 4).cast("string").alias("release"), F.lit("train").alias("split"))
    df = df.withColumn("label", (F.pmod(F.xxhash64("id"), F.lit(2)) == 1).cast("int"))
    return df.withColumns({c: F.col("label") * (0.9 if i % 2 == 0 else -0.5) + noise(i) for i, c in enumerate(X)}).drop("id")


def plain(df, *drop):
    return sorted(map(repr, df.drop(*drop).collect()))


def test_nested_hands_come_apart_as_they_were(spark):
    seq = views.short(spark, DATA, 50)
    again = tables.sequences_of(tables.nested(seq))
    assert again.hands.count() == seq.hands.count() and again.actions.count() == seq.actions.count()
    columns = ["group_id", "seat", "action_type", "street", "amount", "norm_bb", "pot_before", "pot_after", "raise_to", "call_to"]
    assert plain(again.actions.select(columns)) == plain(seq.actions.select(columns))
    columns = ["group_id", "hero_seat", "bb", "button_seat", "n_players", "hero_stack", "won", "total_pot", "showdown", "n_board_streets", "street_shape"]
    assert plain(again.hands.select(columns)) == plain(seq.hands.select(columns))
    columns = ["group_id", "seat", "player_uid", "starting_stack"]
    assert plain(again.players.select(columns)) == plain(seq.players.select(columns))


def test_releases_of_lines_split_and_keep_their_groups(spark, tmp_path):
    seq = views.short(spark, DATA, 100)
    names = F.when(F.col("group_id") % 2 == 0, "2024-01-01").when(F.col("group_id") < 6, "b c/ü")
    groups = tables.nested(seq).select(F.col("group_id").cast("string").alias("group_id"), "hands", names.alias("release"), F.lit("validation").alias("split"), F.lit(1).alias("label"))
    groups = groups.withColumn("label", F.when(F.col("group_id") != "3", F.col("label"))).withColumn("hands", F.when(F.col("group_id") != "4", F.col("hands")))
    io.write_releases(groups.withColumn("file", F.lit("x")).repartition(3), str(tmp_path / "r"))
    back = io.read_releases(spark, str(tmp_path / "r"), lines=True)
    kept = groups.where("group_id NOT IN ('3', '4')")
    columns = ["group_id", "release", "split", "label", "hands"]
    assert back.columns == columns and plain(back) == plain(kept.select(columns))


def test_no_groups_at_all(spark, tmp_path):
    seq = views.short(spark, DATA, 100)
    none = tables.nested(tables.Sequences(seq.actions, seq.hands.where("false"), seq.players)).selectExpr("group_id", "hands", "'a' AS release", "'train' AS split", "1 AS label")
    assert none.count() == 0
    assert release.labelled_features(none, ["mean_aggr_frac", "hf_hand_count"]).count() == 0


def test_the_parts_see_their_own_views(rows):
    views_ = selection.feature_views(X)
    assert views_ == {"PH": X[:2], "V2": X[2:], "UN": X}
    out = release.blended_parts(X, WEIGHTS)(rows)(rows)
    assert set(out.columns) == {*rows.columns, "score"} and metrics.ranking_metrics(out, []).first()["auc"] > 0.85
    # the committee sees the hero's columns only: changing those of all actors leaves its score
    mono = learners.four_parts(X, {c: 1 if i % 2 == 0 else -1 for i, c in enumerate(X)})["mono"](rows)
    assert plain(mono(rows).select("group_id", "mono")) == plain(mono(rows.withColumn("hf_c", F.lit(9.0))).select("group_id", "mono"))


def test_gate_and_history(rows, spark, tmp_path):
    candidates = {"base": learners.learner("logistic", X[3:]), "new": learners.learner("logistic", X)}
    figures = release.judged(candidates, rows, latest=2)
    found = {r["model"]: r for r in figures.collect()}
    assert set(found) == {"base", "new"} and all(r["wf_n_rows"] == 80 and r["oof_n_rows"] == 160 for r in found.values())
    assert all(r["hard_fpr"] == max(r["wf_hard_fpr"], r["oof_hard_fpr"]) and r["safety"] == min(r["wf_safety"], r["oof_safety"]) for r in found.values())
    path = str(tmp_path / "history")
    for day in ("2026-01-01", "2026-01-02"):
        release.promoted(figures, "base", path, day, forced=("new",) if day.endswith("02") else ())
    held = spark.read.parquet(path).orderBy("decided_at").collect()
    assert [r["model"] for r in held] == ["new", "new"] and held[1]["accepted"] and not held[0]["forced"]
    assert held[0]["accepted"] == (not held[0]["reasons"] and not held[0]["regression"])


def test_scores_out_of_fold_nest(rows):
    members = {"_a": learners.learner("logistic", X[:2], to="_a"), "_b": learners.learner("logistic", X[2:], to="_b")}
    out = learners.out_of_fold(learners.stacked(members, 2), rows, 2)
    assert out.count() == 160 and metrics.ranking_metrics(out, []).first()["auc"] > 0.85


def test_a_committee_without_signs_is_neutral(rows):
    assert {r["score"] for r in learners.signed_committee(X, {})(rows)(rows).select("score").collect()} == {0.5}


def test_groups_are_parsed_once_and_few_features_derive_only_what_they_need(spark, monkeypatch):
    from seqspark.operators import hands

    made, own = [], release.written
    keep = lambda df: made.append(own(df)) or made[-1]
    monkeypatch.setattr(release, "written", keep)
    monkeypatch.setattr(hands, "written", keep)
    names = ["mean_aggr_frac", "hf_mean_action_entropy"]
    nested = tables.nested(views.short(spark, DATA, 100)).withColumns({"release": F.lit("a"), "split": F.lit("train"), "label": F.lit(1)})
    out = release.labelled_features(nested, names)
    assert [f.columns for f in made if "hands" in f.columns] == [nested.columns]
    assert not any("action_run_length" in f.columns for f in made)
    found = release.Registry().plan(hands.prepared(tables.sequences_of(nested)), names)
    values = lambda df: {r[0]: tuple(round(x, 9) for x in r[1:]) for r in df.select("group_id", *names).collect()}
    assert values(out) == values(found) and len(values(out)) > 1
