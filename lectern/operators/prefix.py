"""Running sums and places within groups of any size: in two levels, so that no task has a whole group.

Rows are dealt to parts of their group. A part's total is one aggregated row; sums over the earlier parts' totals (a row a part) give each part
where it begins; within a part a window does the rest.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.operators.joins import attached, cut

#: Places of one part.
PART = 8_192


def running(rows: DataFrame, group: Sequence[str], place: str, amounts: Mapping[str, Column], before: bool = False, part: int = PART) -> DataFrame:
    """rows with, for each name of amounts, the sum of that amount over the group's rows up to their own (before: without their own), in the order of place.

    place: a whole number that tells a group's rows apart and leaves few gaps, such as a line's number; it deals the rows to parts. Nulls count 0, and a null
    group is a group. rows is read twice: cut it before if it is costly."""
    group, names = list(group), list(amounts)
    dealt = rows.withColumns({f"__{n}": F.coalesce(a, F.lit(0)) for n, a in amounts.items()} | {"__part": F.floor(F.col(place) / part), "__first": F.lit(False)})
    totals = dealt.groupBy(*group, "__part").agg(*[F.sum(f"__{n}").alias(f"__{n}") for n in names])
    earlier = Window.partitionBy(*group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    begins = totals.select(*group, "__part", *[F.coalesce(F.sum(f"__{n}").over(earlier), F.lit(0)).alias(f"__{n}") for n in names], F.lit(True).alias("__first"))
    # What came before a part stands in it as a row before all others.
    inside = Window.partitionBy(*group, "__part").orderBy(F.desc("__first"), place).rowsBetween(Window.unboundedPreceding, -1 if before else Window.currentRow)
    summed = dealt.unionByName(begins, allowMissingColumns=True).withColumns({n: F.coalesce(F.sum(f"__{n}").over(inside), F.lit(0)) for n in names})
    return summed.where(~F.col("__first")).drop("__part", "__first", *[f"__{n}" for n in names])


def numbered(rows: DataFrame, group: Sequence[str], order: Sequence[Column | str], name: str) -> DataFrame:
    """rows with their place in their group, from 1, in the given order, which must tell a group's rows apart. Rows are sorted by ranges of (group, order)."""
    group = list(group)
    ranges = rows.repartitionByRange(*group, *order).sortWithinPartitions(*group, *order)
    placed = cut(ranges.withColumn("__at", F.monotonically_increasing_id()))
    # __at is a range's number and the place in it.
    part = F.shiftright("__at", 33)
    counts = placed.groupBy(*group, part.alias("__part")).agg(F.min("__at").alias("__from"), F.count(F.lit(1)).alias("__n"))
    earlier = Window.partitionBy(*group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    begins = cut(counts.select(*group, "__part", (F.coalesce(F.sum("__n").over(earlier), F.lit(0)) - F.col("__from") + 1).alias("__shift")))
    return attached(placed.withColumn("__part", part), begins, [*group, "__part"]).withColumn(name, (F.col("__at") + F.col("__shift")).cast("int")).drop("__at", "__part", "__shift")
