"""Places of rows in their groups, and exact percentiles, where a group may hold most rows of a table."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.scratch import stored

#: Rows that a task orders, on average.
SLICE_ROWS = 200_000


def numbered(df: DataFrame, by: list[str], order: list[str], place: str = "place", total: str = "total", weight: Column | None = None, most: int | None = None) -> DataFrame:
    """df with each row's place (from 0) in its group, nulls first, and the group's number of rows; a row may stand for ``weight`` of them.

    A table of several slices is cut into ranges of (group, order), written once; a slice's rows are numbered by themselves and
    begin where the group's slices before it end. Rows equal in ``order`` go by a hash of all columns, rows equal in all
    take any place. Null values of ``by`` are a group. ``most``: a number that
    the rows of df don't exceed, where one is known.
    """
    n = max(1, math.ceil((df.count() if most is None else most) / SLICE_ROWS))
    each = F.lit(1) if weight is None else weight
    before = lambda w: F.sum(each).over(w.rowsBetween(Window.unboundedPreceding, 0)) - each
    if n == 1:
        w = Window.partitionBy(*by)
        return df.withColumns({place: before(w.orderBy(*order)).cast("long"), total: F.sum(each).over(w)})
    hashable = [c for c, kind in df.dtypes if not kind.startswith("map")]
    tied = df.withColumn("_tie", F.xxhash64(*(f"`{c}`" for c in hashable)))
    cut = stored(tied.repartitionByRange(n, *by, *order, "_tie").withColumn("_slice", F.spark_partition_id().cast("long")))
    counts = cut.groupBy(*by, "_slice").agg(F.sum(each).alias("_n"))
    group = Window.partitionBy(*by)  # a row for each slice that holds some of the group
    starts = counts.select(*(F.col(c).alias(f"_by{i}") for i, c in enumerate(by)), F.col("_slice").alias("_at"), (F.sum("_n").over(group.orderBy("_slice")) - F.col("_n")).alias("_start"), F.sum("_n").over(group).alias(total))
    own = cut.withColumn("_own", before(Window.partitionBy(*by, "_slice").orderBy(*order, "_tie")))
    both = F.col("_slice") == F.col("_at")
    for i, c in enumerate(by):
        both = both & F.col(c).eqNullSafe(F.col(f"_by{i}"))
    return own.join(starts, both).select(*(f"`{c}`" for c in df.columns), (F.col("_own") + F.col("_start")).cast("long").alias(place), total)


def part_of(place: Column, total: Column, n: int) -> Column:
    """The part (from 1) of n near-equal consecutive ones that a place lies in; the first ones are larger by one row."""
    size, more = F.floor(total / n), total % n
    wide = more * (size + 1)
    return F.when(place < wide, F.floor(place / (size + 1))).otherwise(more + F.floor((place - wide) / F.greatest(size, F.lit(1)))).cast("long") + 1


def percentiles(df: DataFrame, by: list[str], value: str, at: dict[str, float], most: int | None = None) -> DataFrame:
    """by and the exact, interpolated percentiles of each group's values that aren't null; a group without any has no row.

    Equal values are counted first; a group's different values are numbered in slices, and a task sends on what stands beside
    its percentiles. ``most`` is as in ``numbered``.
    """
    values = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("_rows"))
    places = numbered(values, by, [value], weight=F.col("_rows"), most=df.count() if most is None else most)
    found = []
    for name, q in at.items():
        exact = q * (F.col("total") - 1)
        low, share = F.floor(exact), exact - F.floor(exact)
        mine = lambda k: F.max(F.when((F.col("place") <= k) & (k < F.col("place") + F.col("_rows")), F.col(value)))
        first, then = mine(low), mine(low + 1)
        weight = F.max(share)
        found.append(F.when(weight == 0, first).otherwise(first * (1 - weight) + then * weight).alias(name))
    return places.groupBy(*by).agg(*found)
