"""Running sums over groups of any size, without a window task for a whole group.

Rows are dealt out by ranges of (group, order) and written. Each range is summed by itself; what stands before it comes from one row a
range and group. So no task holds more than a range, however large one group is, and rows that tie stay together.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqspark.sources.io import written


def running(rows: DataFrame, by: Sequence[str], order: Sequence[Column], sums: Mapping[str, str], totals: Mapping[str, str] | None = None) -> DataFrame:
    """rows with, for each of ``sums`` (name: column), the sum of the column from the group's first row up to this one, and for each of
    ``totals`` the group's sum. ``order`` has to tell the rows of a group apart where it matters which comes first. Null is a group of its own."""
    totals = dict(totals or {})
    placed = written(rows.repartitionByRange(*[F.col(c) for c in by], *order).withColumn("_part", F.spark_partition_id()))
    ranges = placed.groupBy(*by, "_part").agg(*[F.sum(c).alias(f"_r_{n}") for n, c in {**sums, **totals}.items()])
    group = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))  # a row a range
    before = group.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    named = {c: f"_k{i}" for i, c in enumerate([*by, "_part"])}
    ranges = ranges.select(*[F.col(c).alias(k) for c, k in named.items()], *[F.coalesce(F.sum(f"_r_{n}").over(before), F.lit(0)).alias(f"_b_{n}") for n in sums], *[F.sum(f"_r_{n}").over(group).alias(f"_t_{n}") for n in totals])
    inside = Window.partitionBy(*by, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = placed.withColumns({f"_i_{n}": F.sum(c).over(inside) for n, c in sums.items()})
    same = reduce(and_, [F.col(c).eqNullSafe(F.col(k)) for c, k in named.items()])
    return placed.join(ranges, same).select(*rows.columns, *[(F.col(f"_i_{n}") + F.col(f"_b_{n}")).alias(n) for n in sums], *[F.col(f"_t_{n}").alias(n) for n in totals])


def running_by_value(rows: DataFrame, by: Sequence[str], value: str, sums: Mapping[str, str], totals: Mapping[str, str] | None = None, descending: bool = False, of: DataFrame | None = None, then: Sequence[Column] = ()) -> DataFrame:
    """As ``running`` in the order of a column of numbers, in one plan that writes nothing; ``then`` orders what ties within a group. Ranges are cut at
    approximate quantiles of the column over all groups, so that none has many more rows than another. ``of`` are the rows that ``rows`` sum up, which are cheaper to take quantiles of. Nulls come first, or
    last in descending order."""
    totals = dict(totals or {})
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cuts = (rows if of is None else of).stat.approxQuantile(value, [(k + 1) / n for k in range(n - 1)], 0.5 / n) if n > 1 else []
    bounds = F.array(*[F.lit(float(c)) for c in sorted(set(cuts))]).cast("array<double>")
    rows_in = rows.withColumn("_range", F.size(F.filter(bounds, lambda b: b < F.col(value))))
    ordered = (lambda c: F.desc(c)) if descending else (lambda c: F.asc(c))
    ranges = rows_in.groupBy(*by, "_range").agg(*[F.sum(c).alias(f"_r_{k}") for k, c in {**sums, **totals}.items()])
    group = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))  # a row a range
    before = group.orderBy(ordered("_range")).rowsBetween(Window.unboundedPreceding, -1)
    named = {c: f"_k{i}" for i, c in enumerate([*by, "_range"])}
    ranges = ranges.select(*[F.col(c).alias(k) for c, k in named.items()], *[F.coalesce(F.sum(f"_r_{k}").over(before), F.lit(0)).alias(f"_b_{k}") for k in sums], *[F.sum(f"_r_{k}").over(group).alias(f"_t_{k}") for k in totals])
    inside = Window.partitionBy(*by, "_range").orderBy(ordered(value), *then).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = rows_in.withColumns({f"_i_{k}": F.sum(c).over(inside) for k, c in sums.items()})
    same = reduce(and_, [F.col(c).eqNullSafe(F.col(k)) for c, k in named.items()])
    return placed.join(ranges, same).select(*rows.columns, *[(F.col(f"_i_{k}") + F.col(f"_b_{k}")).alias(k) for k in sums], *[F.col(f"_t_{k}").alias(k) for k in totals])
