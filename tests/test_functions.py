import math

import pytest
from pyspark.sql import functions as F

from seqspark.functions import scalars as S
from seqspark.operators.redundancy import phrases


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("x", "code"), [(-1.0, "0"), (0.0, "0"), (0.5, "s"), (1.0, "s"), (3.0, "m"), (8.0, "l"), (8.1, "x")])
def test_size_code(spark, x, code):
    assert one(spark, S.size_code(F.lit(x))) == code


@pytest.mark.parametrize("x", [0.25, 0.1, 5.0, 20.0, 30.0, 1000.0, 0.75])
def test_snapped_is_the_first_nearest(spark, x):
    expected = min(S.EXACT_GRID, key=lambda g: (abs(g - x), S.EXACT_GRID.index(g)))
    assert one(spark, S.snapped(F.lit(x), S.EXACT_GRID)) == expected


def test_defaults_and_lenient_numbers(spark):
    assert one(spark, S.or_default(F.lit(0.0), 0.02)) == 0.02
    assert one(spark, S.or_default(F.lit(None).cast("double"), 0.02)) == 0.02
    assert one(spark, S.number(F.lit("x"), 3.0)) == 3.0
    assert one(spark, S.number(F.lit("2.5"))) == 2.5


def test_logit_and_sigmoid_are_clipped(spark):
    assert one(spark, S.logit(F.lit(0.0))) == pytest.approx(math.log(1e-6 / (1 - 1e-6)))
    assert one(spark, S.sigmoid(F.lit(1000.0))) == pytest.approx(1 / (1 + math.exp(-35)))


def test_recentred_takes_the_threshold_to_a_half(spark):
    assert one(spark, S.recentred(F.lit(0.3), F.lit(0.3))) == 0.5
    assert one(spark, S.recentred(F.lit(1.0), F.lit(0.3))) == 1.0


def test_roundness(spark):
    assert one(spark, S.roundness(F.lit(2.51), F.lit(None).cast("double"))) == 1.0
    assert one(spark, S.roundness(F.lit(2.3), F.lit(0.66))) == 1.0
    assert one(spark, S.roundness(F.lit(2.3), F.lit(0.45))) == 0.0


def test_unknown_codes(spark):
    assert one(spark, S.action_code(F.lit("dance"))) == "?"
    assert one(spark, S.street_code(F.lit(None).cast("string"))) == "?"
    assert one(spark, S.relative_position(F.lit(2), F.lit(None).cast("int"), F.lit(6))) == 0.5


@pytest.mark.parametrize(("text", "n"), [("0001101001000101", 6), ("aaaa", 2), ("abab", 3), ("abc", 3), ("a", 1)])
def test_lempel_ziv_phrases(text, n):
    assert phrases(text) == n
