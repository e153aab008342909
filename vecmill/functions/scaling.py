"""Columns of a vector table brought to mean 0 and deviation 1."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def standardised(vectors: DataFrame) -> DataFrame:
    """id, vec with each coordinate less its mean, over its population deviation (1 where that is 0).

    The statistics, a row for each coordinate, become constants of the plan, so the vectors themselves aren't shuffled.
    """
    stats = vectors.select(F.posexplode("vec").alias("pos", "x")).groupBy("pos").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s")).orderBy("pos").collect()
    if not stats:
        return vectors.select("id", "vec")
    mean, std = (F.array(*[F.lit(r[c]) for r in stats]) for c in "ms")
    return vectors.select("id", F.transform("vec", lambda x, i: (x - F.get(mean, i)) / F.when(F.get(std, i) == 0, 1.0).otherwise(F.get(std, i))).alias("vec"))
