"""Repetition among a group's hands: signatures, exact and approximate duplicates, compressibility."""

from __future__ import annotations

import gzip
import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seqspark.functions import scalars as S
from seqspark.operators.hands import KEYS
from seqspark.sources.io import written
from seqspark.sources.tables import Sequences

#: The reference's bounds of the pairwise and sequential measures. Hands and actions have none unless a caller asks for it.
MAX_HANDS, MAX_SYMBOLS, MAX_ACTIONS = 60, 300, 4000
#: Different pair sets of a group that meet in one block.
BLOCK = 1000
FEATURES = ("rp_pair_jaccard_mean", "rp_vendi_frac", "rp_exact_dup_frac_action", "rp_exact_dup_frac_rich", "rp_gzip_ratio", "rp_lz76_norm", "rp_entropy_rate")


def grid_index(x: Column) -> Column:
    """The place of the nearest point of the exact grid."""
    points = F.array(*[F.lit(g) for g in S.EXACT_GRID])
    return F.array_min(F.transform(points, lambda g, i: F.struct(F.abs(g - x).alias("d"), i.alias("i"))))["i"]


def signatures(seq: Sequences) -> DataFrame:
    """group_id, hand_id, street_shape, signature: the shape, #, then a token of street, action and size an action, in order."""
    token = F.concat(S.street_code(F.col("street")), S.action_code(F.col("action_type")), S.size_code(F.col("norm_bb")))
    steps = seq.actions.groupBy(*KEYS).agg(F.array_sort(F.collect_list(F.struct("action_idx", token.alias("token")))).alias("steps"))
    line = F.array_join(F.transform("steps", lambda x: x["token"]), ".")
    hands = seq.hands.select(*KEYS, "street_shape").join(steps, KEYS, "left")
    return hands.select(*KEYS, "street_shape", F.concat("street_shape", F.lit("#"), F.coalesce(line, F.lit(""))).alias("signature"))


def signature_shares(signed: DataFrame) -> DataFrame:
    """group_id, n_hands, top_share, unique_share, repeat_mass (hands whose signature is found again), street_uniformity."""
    counts = signed.groupBy("group_id", "signature").agg(F.count("*").alias("c"))
    n = F.sum("c")
    shares = counts.groupBy("group_id").agg(
        n.alias("n_hands"), (F.max("c") / n).alias("top_share"), (F.count("*") / n).alias("unique_share"), (F.sum(F.when(F.col("c") >= 2, F.col("c")).otherwise(0)) / n).alias("repeat_mass")
    )
    shapes = signed.groupBy("group_id", "street_shape").agg(F.count("*").alias("c")).groupBy("group_id").agg((F.max("c") / n).alias("street_uniformity"))
    return shares.join(shapes, "group_id")


def signature_scores(shares: DataFrame, street_weight: float = 0.18, low: float = 0.30, high: float = 0.90, floor: float = 0.05) -> DataFrame:
    """shares with concentration and score."""
    concentration = S.clamp01(0.45 * F.col("top_share") + 0.35 * F.col("repeat_mass") + 0.20 * (1 - F.col("unique_share")))
    raw = S.clamp01((1 - street_weight) * F.col("concentration") + street_weight * F.col("street_uniformity"))
    return shares.withColumn("concentration", concentration).withColumn("score", S.anchored(raw, low, high, floor))


def group_scores(groups: DataFrame, scored: DataFrame, empty: float = 0.5) -> DataFrame:
    """Every group's score; one without hands gets ``empty``."""
    return groups.join(scored, "group_id", "left").withColumn("score", F.coalesce("score", F.lit(empty)))


def _rich(seq: Sequences) -> DataFrame:
    """A row a hand: its number in the group, actions, streets and cells in order."""
    steps = seq.actions.groupBy(*KEYS).agg(
        F.array_sort(F.collect_list(F.struct("action_idx", F.coalesce("action_type", F.lit("?")).alias("a"), F.coalesce("street", F.lit("?")).alias("s"), grid_index(F.col("norm_bb")).alias("b")))).alias("steps")
    )
    hands = seq.hands.select(*KEYS).join(steps, KEYS, "left")
    hands = hands.withColumn("actions", F.coalesce(F.transform("steps", lambda x: x["a"]), F.array().cast("array<string>")))
    hands = hands.withColumn("rich", F.coalesce(F.transform("steps", lambda x: F.concat_ws("|", x["s"], x["a"], x["b"].cast("string"))), F.array().cast("array<string>")))
    group = Window.partitionBy("group_id")
    return hands.withColumn("place", F.row_number().over(group.orderBy("hand_id")) - 1).withColumn("n", F.count("*").over(group)).drop("steps")


def exact_duplicates(hands: DataFrame) -> DataFrame:
    return hands.groupBy("group_id").agg(
        F.count("*").alias("n_hands"), (1 - F.countDistinct(F.array_join("actions", ".")) / F.count("*")).alias("rp_exact_dup_frac_action"),
        (1 - F.countDistinct(F.array_join("rich", ".")) / F.count("*")).alias("rp_exact_dup_frac_rich"),
    )


def pairwise(hands: DataFrame, max_hands: int | None = None, block: int = BLOCK) -> DataFrame:
    """Mean Jaccard similarity of the pair sets of a group's hands, and the diversity of their similarity mass.

    Every hand counts: those with equal sets are one row with their number, and a group's different sets meet in pairs of blocks, so that
    a key of the join has about block * block pairs however large the group is. With ``max_hands`` only so many evenly chosen hands count."""
    if max_hands is not None:
        stride = F.greatest(F.lit(1), F.floor(F.col("n") / max_hands)).cast("int")
        hands = hands.where((F.col("place") % stride == 0) & (F.col("place") / stride < max_hands))
    grams = F.when(F.size("rich") < 2, F.array().cast("array<string>")).otherwise(
        F.array_sort(F.array_distinct(F.transform(F.sequence(F.lit(0), F.greatest(F.size("rich") - 2, F.lit(0))), lambda i: F.concat_ws(">", F.get("rich", i), F.get("rich", i + 1)))))
    )
    sets = written(hands.select("group_id", "hand_id", grams.alias("grams")).groupBy("group_id", "grams").agg(F.min("hand_id").alias("id"), F.count("*").alias("c")))
    blocks = sets.groupBy("group_id").agg(F.ceil(F.count("*") / block).alias("blocks"))
    some = sets.where(F.size("grams") > 0).join(blocks, "group_id").withColumn("at", F.pmod(F.xxhash64("id"), "blocks"))
    one = some.select("group_id", F.col("at").alias("i"), F.explode(F.sequence("at", F.col("blocks") - 1)).alias("j"), *[F.col(c).alias(f"{c}_a") for c in ("id", "c", "grams")])
    other = some.select("group_id", F.explode(F.sequence(F.lit(0).cast("long"), "at")).alias("i"), F.col("at").alias("j"), *[F.col(c).alias(f"{c}_b") for c in ("id", "c", "grams")])
    met = one.join(other, ["group_id", "i", "j"]).where("i < j OR id_a < id_b").withColumn("common", F.size(F.array_intersect("grams_a", "grams_b"))).where("common > 0")
    met = met.withColumn("s", F.col("common") / (F.size("grams_a") + F.size("grams_b") - F.col("common")))
    # both directions, so that each hand has its row sum; a hand is 1 to each of its copies and 0 to hands that no pair is shared with
    ways = F.array(*[F.struct(F.col(f"id_{x}").alias("id"), F.col(f"c_{x}").alias("c"), (F.col("s") * F.col(f"c_{y}")).alias("s")) for x, y in ("ab", "ba")])
    sims = met.select("group_id", F.inline(ways)).unionByName(sets.select("group_id", "id", "c", (F.col("c") - 1).cast("double").alias("s")))
    mass = sims.groupBy("group_id", "id", "c").agg(F.sum("s").alias("row"))
    # w = (row + 1) / total, and -sum(w ln w) over the hands = ln total - sum((row + 1) ln(row + 1)) / total
    n, x = F.sum("c"), F.col("row") + 1
    total = F.sum(F.col("c") * x)
    spread = F.exp(F.ln(total) - F.sum(F.col("c") * x * F.ln(x)) / total) / n
    return mass.groupBy("group_id").agg((F.sum(F.col("c") * F.col("row")) / F.nullif(n * (n - 1), F.lit(0))).alias("rp_pair_jaccard_mean"), S.clamp01(spread).alias("rp_vendi_frac"))


def entropy_rate(seq: Sequences, max_actions: int | None = None) -> DataFrame:
    """Order-1 conditional entropy in bits of a group's actions, hands one after the other; with ``max_actions``, of the first so many."""
    group = Window.partitionBy("group_id").orderBy("hand_id", "action_idx")
    rows = seq.actions.select("group_id", "hand_id", "action_idx", F.coalesce("action_type", F.lit("?")).alias("a"))
    if max_actions is not None:
        rows = rows.withColumn("place", F.row_number().over(group)).where(F.col("place") <= max_actions)
    pairs = rows.withColumn("b", F.lead("a").over(group)).where("b IS NOT NULL").groupBy("group_id", "a", "b").agg(F.count("*").alias("c"))
    pairs = pairs.withColumn("of", F.sum("c").over(Window.partitionBy("group_id", "a")))
    return pairs.groupBy("group_id").agg((-F.sum(F.col("c") * F.log2(F.col("c") / F.col("of"))) / F.sum("c")).alias("rp_entropy_rate"))


@F.pandas_udf(T.DoubleType())
def gzip_ratio(lines: pd.Series) -> pd.Series:
    """Size of a group's compressed lines together over the sum of the sizes of each alone."""
    size = lambda s: len(gzip.compress(s.encode(), 5))
    return lines.map(lambda group: size("#".join(group)) / (sum(size(s) for s in group) or 1))


def phrases(s: str) -> int:
    """Phrases of the 1976 Lempel-Ziv parsing: each is the shortest string that does not begin earlier in the text."""
    n, at, count = len(s), 0, 0
    while at < n:
        size = 1
        while at + size <= n and s.find(s[at : at + size], 0, at + size - 1) >= 0:
            size += 1
        count += 1
        at += size
    return count


@F.pandas_udf(T.DoubleType())
def lz76(texts: pd.Series) -> pd.Series:
    """Phrases over n / log2 n."""
    return texts.map(lambda s: phrases(s) / (len(s) / math.log2(len(s))) if len(s) > 1 else 0.0)


def compressibility(hands: DataFrame) -> DataFrame:
    """gzip ratio of the hands' street letters, phrase rate of the first MAX_SYMBOLS action letters. One bounded string a hand goes to
    Python."""
    streets = F.array_join(F.transform("rich", lambda x: F.substring(x, 1, 1)), "")
    letters = F.array_join(F.transform(F.slice("actions", 1, MAX_SYMBOLS), lambda x: F.substring(x, 1, 1)), "")
    rows = hands.select("group_id", "place", F.when(streets == "", "-").otherwise(streets).alias("line"), letters.alias("letters"))
    ordered = F.array_sort(F.collect_list(F.struct("place", "line", F.when(F.col("place") < MAX_SYMBOLS, F.col("letters")).alias("letters"))))
    rows = rows.groupBy("group_id").agg(ordered.alias("x"))
    rows = rows.select("group_id", F.transform("x", lambda x: x["line"]).alias("lines"), F.substring(F.array_join(F.transform("x", lambda x: x["letters"]), ""), 1, MAX_SYMBOLS).alias("letters"))
    return rows.select("group_id", gzip_ratio("lines").alias("rp_gzip_ratio"), lz76("letters").alias("rp_lz76_norm"))


def redundancy_features(seq: Sequences, with_compression: bool = True, max_hands: int | None = None, max_actions: int | None = None) -> DataFrame:
    """group_id and the seven measures, over all hands and actions unless bounds are given; a group of fewer than two hands has fixed ones."""
    hands = _rich(seq)
    out = exact_duplicates(hands).join(pairwise(hands, max_hands), "group_id", "left").join(entropy_rate(seq, max_actions), "group_id", "left")
    if with_compression:
        out = out.join(compressibility(hands), "group_id", "left")
    few = F.col("n_hands") < 2
    fixed = {"rp_vendi_frac": 1.0, "rp_gzip_ratio": 1.0}
    names = [c for c in FEATURES if c in out.columns]
    return out.select("group_id", *[F.when(few, F.lit(fixed.get(c, 0.0))).otherwise(F.coalesce(c, F.lit(0.0))).alias(c) for c in names])
