"""Scalar building blocks: defaults, clamps, codes, grids, calibration curves. All return columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The grids that amounts are snapped to, the pot fractions that count as round, and the code letters.
EXACT_GRID = (0.0, 0.5, 1.0, 1.5, 2.0, 3.0, 4.0, 6.0, 8.0, 12.0, 16.0, 24.0, 36.0, 56.0, 84.0, 126.0)
VISIBLE_GRID = (0.0, 0.5, 1.0, 1.5, 2.0, 3.0, 4.0, 6.0, 8.0, 12.0, 16.0, 24.0, 32.0, 48.0, 64.0, 100.0)
FRACTION_GRID = (0.0, 0.33, 0.5, 0.66, 0.75, 1.0, 1.5, 2.0)
ROUND_FRACTIONS = (0.25, 0.33, 0.4, 0.5, 0.6, 0.66, 0.75, 1.0, 1.25, 1.5, 2.0)
STREETS = ("preflop", "flop", "turn", "river", "showdown")
ACTION_CODES = {"fold": "F", "check": "K", "call": "C", "bet": "B", "raise": "R", "allin": "A", "all_in": "A"}
STREET_CODES = {"preflop": "p", "flop": "f", "turn": "t", "river": "r"}


def _lookup(table: dict) -> Column:
    return F.create_map(*[F.lit(x) for pair in table.items() for x in pair])


def or_default(x: Column, default: float) -> Column:
    """x, or the default where it is null or 0."""
    return F.coalesce(F.nullif(x, F.lit(0.0)), F.lit(default))


def number(x: Column, default: float = 0.0) -> Column:
    """A lenient cast: what is no number is the default."""
    return F.coalesce(x.try_cast("double"), F.lit(default))


def clamp01(x: Column) -> Column:
    return F.greatest(F.least(x, F.lit(1.0)), F.lit(0.0))


def size_code(x: Column) -> Column:
    return F.when(x <= 0, "0").when(x <= 1, "s").when(x <= 3, "m").when(x <= 8, "l").otherwise("x")


def pot_bucket(x: Column) -> Column:
    return F.when(x < 5, 0).when(x < 15, 1).when(x < 40, 2).otherwise(3)


def street_ordinal(street: Column) -> Column:
    return F.coalesce(_lookup({s: i for i, s in enumerate(STREETS)})[street], F.lit(0))


def action_code(action: Column) -> Column:
    return F.coalesce(_lookup(ACTION_CODES)[F.lower(F.coalesce(action, F.lit("")))], F.lit("?"))


def street_code(street: Column) -> Column:
    return F.coalesce(_lookup(STREET_CODES)[F.lower(F.coalesce(street, F.lit("")))], F.lit("?"))


def snapped(x: Column, grid: Sequence[float]) -> Column:
    """The nearest grid point; the first of two that are equally near."""
    points = F.array(*[F.lit(float(g)) for g in grid])
    return F.array_min(F.transform(points, lambda g, i: F.struct(F.abs(g - x).alias("d"), i.alias("i"), g.alias("g"))))["g"]


def snapped_by_join(rows: DataFrame, value: str, grid: Sequence[float], to: str) -> DataFrame:
    """rows with the nearest grid point of a column, as a range join: the grid is a small table of (low, high] intervals, which is broadcast."""
    points = [float(g) for g in grid]
    edges = [float("-inf"), *((a + b) / 2 for a, b in zip(points[:-1], points[1:], strict=True)), float("inf")]
    table = rows.sparkSession.createDataFrame(list(zip(edges[:-1], edges[1:], points, strict=True)), f"_low double, _high double, {to} double")
    within = (F.col(value) > F.col("_low")) & (F.col(value) <= F.col("_high"))
    return rows.join(F.broadcast(table), within, "left").drop("_low", "_high")


def half_even(x: Column, digits: int) -> Column:
    """x to some digits, halves to even, as binary doubles round: 4.475 * 100 is below 447.5, while bround takes the decimal that is printed."""
    return F.rint(x * 10.0**digits) / 10.0**digits


def ratio(amount: Column, pot: Column) -> Column:
    """amount / pot, null unless both are above 0."""
    return F.when((amount > 0) & (pot > 0), amount / pot)


def roundness(size: Column, fraction: Column) -> Column:
    """1 where a size is near a half unit or its share of the pot is near a round one, else 0."""
    half = (size > 0) & (F.abs(F.rint(size * 2) / 2 - size) < 0.02)
    near = F.exists(F.array(*[F.lit(f) for f in ROUND_FRACTIONS]), lambda f: F.abs(f - fraction) < 0.02)
    return F.when(half | (F.coalesce(fraction, F.lit(0.0)) > 0) & near, 1.0).otherwise(0.0)


def relative_position(hero: Column, button: Column, seats: Column) -> Column:
    n = F.greatest(seats, F.lit(1))
    return F.coalesce(F.pmod(hero - button, n) / n, F.lit(0.5))


def logit(p: Column) -> Column:
    q = F.greatest(F.least(p, F.lit(1 - 1e-6)), F.lit(1e-6))
    return F.ln(q / (1 - q))


def sigmoid(z: Column) -> Column:
    return 1 / (1 + F.exp(-F.greatest(F.least(z, F.lit(35.0)), F.lit(-35.0))))


def anchored(x: Column, low: float = 0.30, high: float = 0.90, floor: float = 0.05) -> Column:
    """[low, high] to [0.5, 1], below to [floor, 0.5]; six digits."""
    below = floor + (0.5 - floor) * (x / max(low, 1e-6))
    between = 0.5 + 0.5 * (x - low) / max(high - low, 1e-6)
    return F.round(clamp01(F.when(x <= low, below).when(x >= high, 1.0).otherwise(between)), 6)


def recentred(p: Column, threshold: Column) -> Column:
    """A monotone map that takes the threshold to 0.5."""
    t = F.greatest(F.least(threshold, F.lit(1 - 1e-6)), F.lit(1e-6))
    return clamp01(F.when(p < t, 0.5 * p / t).otherwise(0.5 + 0.5 * (p - t) / (1 - t)))
