"""How good an index is: recall, wrong partitions, boundary queries, percentiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..functions.ranks import percentiles
from . import knn
from .index import Index


def recall(found: DataFrame, truth: DataFrame, k: int, by: list[str] | None = None) -> DataFrame:
    """recall of each query (and of each value of ``by``): neighbours found among the true first k, over k; 0 where none is."""
    by = by or []
    gt = truth.where(F.col("rank") <= k).select("qid", "id")
    hits = found.where(F.col("rank") <= k).join(gt, ["qid", "id"]).groupBy(*by, "qid").agg((F.count(F.lit(1)) / k).alias("recall"))
    groups = gt.select("qid").distinct()
    if by:
        groups = groups.crossJoin(F.broadcast(found.select(*by).distinct()))
    return groups.join(hits, [*by, "qid"], "left").select(*by, "qid", F.coalesce("recall", F.lit(0.0)).alias("recall"))


def violations(index: Index) -> DataFrame:
    """One row: checked, violations and rate of members whose nearest centroid isn't their partition's."""
    own = knn.nearest(index.postings.withColumnRenamed("cluster", "held"), index.centroids, index.config.metric)
    bad = F.count_if(F.col("cluster") != F.col("held"))
    return own.agg(F.count(F.lit(1)).alias("checked"), bad.alias("violations"), F.when(F.count(F.lit(1)) > 0, bad / F.count(F.lit(1))).otherwise(0.0).alias("violation_rate"))


def summary(index: Index) -> DataFrame:
    """One row: partitions with members, vectors, sizes (smallest, largest, mean, population std), and the rate of members in a wrong partition."""
    n = index.sizes().agg(F.count(F.lit(1)).alias("partitions"), F.sum("n").alias("vectors"), F.min("n").alias("smallest"), F.max("n").alias("largest"), F.avg("n").alias("mean"), F.stddev_pop("n").alias("std"))
    return n.join(F.broadcast(violations(index).select("violation_rate")))


def boundary_scores(queries: DataFrame, centroids: dict[int, list[float]]) -> DataFrame:
    """qid and score: angle to the nearest centroid over that to the next, by inner product (1: on the boundary)."""
    two = knn.nearest(queries.select(F.col("qid").alias("id"), "vec"), centroids, "ip", second=True)
    return two.select(F.col("id").alias("qid"), V.boundary_score(V.angle(-F.col("distance")), V.angle(-F.col("distance2"))).alias("score"))


def boundary_queries(scores: DataFrame, least: float, n: int) -> DataFrame:
    """Queries scoring at least ``least``; where these are fewer than n, the n highest scores (ties to the smaller qid)."""
    enough = scores.where(F.col("score") >= least)
    return enough if enough.limit(n).count() >= n else scores.orderBy(F.desc("score"), "qid").limit(n)


def boundary_split(results: DataFrame, share: float = 0.25) -> DataFrame:
    """group (boundary or interior), n, recall, p50, p99 of results (qid, score, recall, latency): the cut is the 1 - share percentile."""
    cut = percentiles(results, [], "score", {"cut": 1 - share})
    return _split(results.join(F.broadcast(cut)), F.col("cut"))


def boundary_split_at(results: DataFrame, least: float = 0.85) -> DataFrame:
    """The same with a fixed cut; a side without results has no row."""
    return _split(results, F.lit(least))


def _split(results: DataFrame, cut: Column) -> DataFrame:
    sides = results.withColumn("side", F.when(F.col("score") >= cut, "boundary").otherwise("interior"))
    means = sides.groupBy("side").agg(F.count(F.lit(1)).alias("n"), F.avg("recall").alias("recall"))
    return means.join(percentiles(sides, ["side"], "latency", {"p50": 0.5, "p99": 0.99}), "side", "left")


def distribution(x: str) -> list[Column]:
    """min, p25, p50, p75, p90 and max of a column."""
    p = lambda q: F.percentile(x, F.lit(q))
    return [F.min(x).alias("min"), p(0.25).alias("p25"), p(0.5).alias("p50"), p(0.75).alias("p75"), p(0.9).alias("p90"), F.max(x).alias("max")]


#: The percentiles of a latency.
LATENCIES = {"p50": 0.5, "p95": 0.95, "p99": 0.99, "p999": 0.999}
