"""Hands made comparable: seats renamed by first appearance, sizes snapped and jittered, a short window of the actions kept."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqspark.functions import scalars as S
from seqspark.sources.tables import flatten_actions
from seqspark.operators.hands import KEYS


def _draw(seed: int, *keys: str) -> Column:
    """A number from 0 to 2**32 - 1 by MD5 of the seed and the keys."""
    digest = F.md5(F.concat_ws(":", F.lit(seed), *[F.col(k).cast("string") for k in keys]))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")


def sanitised(actions: DataFrame, jitter: float = 0.05, shortest: int = 5, longest: int = 8, seed: int = 13) -> DataFrame:
    """group_id, hand_id, place, seat, action_type, street, norm_bb of a drawn window of shortest to longest actions of each hand (all, if it
    has fewer). Sizes are the nearest grid point, changed by at most the jitter; the seats of a hand are 0, 1, ... as they first act."""
    hand = Window.partitionBy(*KEYS)
    rows = actions.withColumn("_first", F.min("action_idx").over(Window.partitionBy(*KEYS, "seat")))
    rows = rows.withColumn("_alias", F.dense_rank().over(hand.orderBy("_first")) - 1)
    rows = rows.withColumn("_at", F.row_number().over(hand.orderBy("action_idx")) - 1).withColumn("_n", F.count("*").over(hand))
    length = shortest + _draw(seed, *KEYS) % (longest - shortest + 1)
    rows = rows.withColumn("_length", F.least(length, F.col("_n")))
    rows = rows.withColumn("_start", _draw(seed + 1, *KEYS) % (F.col("_n") - F.col("_length") + 1))
    kept = rows.where((F.col("_at") >= F.col("_start")) & (F.col("_at") < F.col("_start") + F.col("_length")))
    noise = 1 + jitter * (2 * (_draw(seed + 2, *KEYS, "action_idx") / 2**32) - 1)
    size = F.when(F.col("norm_bb") > 0, S.snapped(F.col("norm_bb"), S.VISIBLE_GRID) * noise).otherwise(0.0)
    return kept.select(
        *KEYS, (F.col("_at") - F.col("_start")).cast("long").alias("place"), F.col("_alias").cast("long").alias("seat"), "action_type", "street", size.alias("norm_bb")
    )


def aligned(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """a and b side by side by key; fails when a key of one is missing in the other."""
    missing = a.select(key).join(b.select(key), key, "left_anti").unionByName(b.select(key).join(a.select(key), key, "left_anti"))
    lost = missing.count()
    if lost:
        raise ValueError(f"{lost} keys without a partner")
    return a.join(b, key)


def sanitised_groups(groups: DataFrame) -> DataFrame:
    """The sanitised actions of loaded groups (group_id, hands, and what tells them apart), with their release, split and label."""
    keep = [c for c in ("release", "split", "label") if c in groups.columns]
    return sanitised(flatten_actions(groups)).join(groups.select("group_id", *keep), "group_id")
