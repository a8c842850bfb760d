"""Unions, de-duplication, resampling and grids over group tables. What is drawn is drawn by hashes of keys, so reruns agree."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def content_key(groups: DataFrame) -> Column:
    """SHA-256 of the hands as JSON: equal groups have equal keys."""
    return F.sha2(F.to_json(F.struct(*[F.col(c) for c in groups.columns if c == "hands"])), 256)


def first_of_each(rows: DataFrame, key: str, order: str, limit: int | None = None, seen: DataFrame | None = None) -> DataFrame:
    """The first row of each key that is not in ``seen`` (its keys), at most ``limit`` by order; of rows that tie, the least."""
    whole = F.struct(*[F.col(c) for c in rows.columns])
    first = rows.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("_key")).agg(F.min_by(whole, F.struct(order, whole)).alias("_row"))
    out = first.select("_row.*")
    if seen is not None:
        out = out.join(seen.select(F.col(key).alias("_seen")), F.col(key) == F.col("_seen"), "left_anti")
    return out.orderBy(order).limit(limit) if limit is not None else out


def not_seen(rows: DataFrame, seen: DataFrame, key: str) -> DataFrame:
    return rows.join(seen.select(key).distinct(), key, "left_anti")


def shuffled(seed: int, *keys: str) -> Column:
    """A sort key that shuffles rows: MD5 of the seed and the keys."""
    return F.md5(F.concat_ws(":", F.lit(seed), *[F.col(k).cast("string") for k in keys]))


def resampled(hands: DataFrame, sizes: Sequence[int], draws: int, seed: int = 7, cycles: int = 3, by: Sequence[str] = ("release", "label")) -> DataFrame:
    """Groups of set sizes from the hands of groups that agree in ``by`` (hands: those columns, group_id, hand_id, n_hands of the group).

    For each size and draw the groups stand in a shuffled order, ``cycles`` times over; their hands are taken one after the other until
    the size is reached. -> by, size, draw, place, group_id, hand_id. Classes with fewer than two groups give none.
    """
    by = list(by)
    groups = hands.select(*by, "group_id", "n_hands").distinct()
    many = groups.groupBy(*by).agg(F.count("*").alias("_n")).where("_n >= 2").drop("_n")
    plan = groups.join(many, by)
    plan = plan.withColumn("size", F.explode(F.array(*[F.lit(s) for s in sizes]))).withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    plan = plan.withColumn("cycle", F.explode(F.sequence(F.lit(0), F.lit(cycles - 1)))).withColumn("key", shuffled(seed, "size", "draw", "group_id"))
    order = Window.partitionBy(*by, "size", "draw").orderBy("cycle", "key", "group_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    plan = plan.withColumn("begin", F.sum("n_hands").over(order) - F.col("n_hands")).where("begin < size")
    place = F.row_number().over(Window.partitionBy(*by, "group_id").orderBy("hand_id")) - 1
    numbered = hands.select(*by, "group_id", "hand_id").withColumn("in_group", place)
    out = plan.join(numbered, [*by, "group_id"]).withColumn("place", F.col("begin") + F.col("in_group")).where("place < size")
    return out.select(*by, "size", "draw", "place", "group_id", "hand_id")


def with_resampled(native: DataFrame, drawn: DataFrame) -> DataFrame:
    return native.unionByName(drawn, allowMissingColumns=True)


def hand_dropout(hands: DataFrame, rate: float = 0.25, least: int = 5, seed: int = 11) -> DataFrame:
    """Each hand is left out with a chance of ``rate``; a group that would keep fewer than ``least`` keeps all."""
    rows = hands.withColumn("_stays", drawn(seed, "group_id", "hand_id") >= rate)
    left = F.sum(F.col("_stays").cast("int")).over(Window.partitionBy("group_id"))
    return rows.withColumn("_left", left).where(F.col("_stays") | (F.col("_left") < least)).drop("_stays", "_left")


def weight_grid(spark: SparkSession, ranges: dict[str, tuple[int, int]], prior: dict[str, int], total: int = 50) -> DataFrame:
    """Integer weights of the parts that add up to ``total``, each in its range; the prior has id 0 and is there once. The last part takes
    what is left."""
    *free, last = list(ranges)
    grid = spark.range(1).select()
    for part in free:
        low, high = ranges[part]
        grid = grid.withColumn(part, F.explode(F.sequence(F.lit(low), F.lit(high))))
    grid = grid.withColumn(last, F.lit(total) - sum((F.col(p) for p in free), F.lit(0)))
    low, high = ranges[last]
    is_prior = [F.col(p) == w for p, w in prior.items()]
    other = is_prior[0]
    for c in is_prior[1:]:
        other = other & c
    grid = grid.where(F.col(last).between(low, high) & ~other)
    grid = grid.withColumn("candidate", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(*ranges)))
    first = spark.createDataFrame([(0, *[prior[p] for p in ranges])], "candidate int, " + ", ".join(f"{p} int" for p in ranges))
    return first.unionByName(grid)


def drawn(seed: int, *keys: str) -> Column:
    """A number from 0 to 1 that the seed and the row's keys decide, whatever partition the row is in."""
    return F.conv(F.substring(shuffled(seed, *keys), 1, 8), 16, 10).cast("double") / 2**32


def poisson(draw: Column) -> Column:
    """How often a row is drawn in a bootstrap: the Poisson count, of mean 1, at a number from 0 to 1 (12 at most, beyond which lie 6e-11)."""
    upto, below = F.lit(0), 0.0
    for k in range(12):
        below += math.exp(-1) / math.factorial(k)
        upto = upto + (draw >= below).cast("int")
    return upto


def bootstrap(rows: DataFrame, seed: int, keys: Sequence[str] = ("group_id",)) -> DataFrame:
    """The rows that a bootstrap draws, once each, with ``weight``: how often. Rows of equal keys are drawn together, and another partitioning
    draws the same."""
    return rows.withColumn("weight", poisson(drawn(seed, *keys)).cast("double")).where("weight > 0")


def subspace(columns: Sequence[str], share: float, seed: int) -> list[str]:
    """A seeded choice of columns."""
    import random

    return sorted(random.Random(seed).sample(list(columns), max(1, round(share * len(columns)))))
