import pytest
from pyspark.sql import functions as F

from seqspark.operators import blends, weighing

NAMES = ["a", "b"]


@pytest.mark.parametrize("apart", [0.0, 0.4])
def test_packed_ranges_give_what_sorted_candidates_give(spark, apart):
    """ties, several chunks and ranges, blocks of one or two candidates; with labels apart more are called than the budget, so ranks are squeezed."""
    x = lambda k: (F.col("idx") * k) % 53 / 110.0 + F.col("label") * apart
    parts = spark.range(300).withColumnRenamed("id", "idx").withColumn("label", (F.col("idx") % 5 < 2).cast("int")).select("idx", "label", x(7).alias("a"), x(19).alias("b"))
    grid = spark.createDataFrame([(0, 10, 10), (1, 15, 5), (2, 3, 17)], "candidate int, a int, b int")
    want = {r["candidate"]: r.asDict() for r in blends.rewarded(blends.candidate_scores(parts, grid, NAMES)).collect()}
    got = {r["candidate"]: r.asDict() for r in weighing.rewards(parts, grid, NAMES, rows=40, block=2).collect()}
    assert got.keys() == want.keys()
    for c, row in got.items():
        assert all(abs(row[k] - want[c][k]) < 1e-9 for k in row), (row, want[c])
