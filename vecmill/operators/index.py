"""The inverted-file index as tables, and the search over it.

A member's place in its partition is its rank by id; it isn't stored, since only splits and reports ask for it.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import vectors as V
from ..functions.arrow import matrix
from ..functions.ranks import numbered
from ..sources.scratch import stored
from . import kmeans, knn, probing


@dataclass(frozen=True)
class IndexConfig:
    """Parameters of an index and its upkeep; split and merge bounds are fixed when it is built.

    ``seeding``: start from the first ids (``first``) or from vectors far from each other (``spread``). A policy rebuilds each ``rebuild_every`` operations and rebalances each ``rebalance_every`` inserts, after the batch that reaches them.
    """

    nlist: int = 16
    rounds: int = 3
    metric: str = "l2"
    split_factor: float = 2.0
    merge_factor: float = 0.25
    rebuild_every: int = 1000
    rebalance_k: int = 10
    rebalance_every: int = 100
    neighbours: int = 5
    seeding: str = "first"

    def __post_init__(self):
        if self.metric not in ("l2", "ip"):
            raise ValueError(f"unknown metric {self.metric!r}")
        if self.seeding not in ("first", "spread"):
            raise ValueError(f"unknown seeding {self.seeding!r}")


#: Ids that are sent to all tasks; more are joined.
FEW_IDS = 100_000


@dataclass(frozen=True)
class Change:
    """Members of ``clusters`` and ids of ``gone`` (id) go, then ``rows`` come."""

    rows: DataFrame | None = None
    clusters: tuple[int, ...] = ()
    gone: DataFrame | None = None


def without(rows: DataFrame, gone: DataFrame) -> DataFrame:
    """Rows whose id isn't in ``gone``; up to FEW_IDS of these are sent to where the rows are."""
    ids = gone.select("id").where("id is not null").distinct()
    few = ids.limit(FEW_IDS + 1).count() <= FEW_IDS
    return rows.join(F.broadcast(ids) if few else ids, "id", "left_anti")


@dataclass(frozen=True)
class Index:
    """postings (id, cluster, vec): every live vector in exactly one partition; centroids by cluster, empty ones too.

    ``changes``: what has been done to the postings since they were read or written, in order; None where all are new.
    """

    postings: DataFrame
    centroids: dict[int, list[float]]
    config: IndexConfig
    split_above: float
    merge_below: float
    counters: dict[str, int] = field(default_factory=dict)
    changes: tuple[Change, ...] | None = None

    def changed(self, rows: DataFrame | None = None, clusters: list[int] | None = None, gone: DataFrame | None = None) -> Index:
        """Without all members of some partitions and without some ids, and with ``rows`` (id, cluster, vec); nothing else is shuffled."""
        now = self.postings.select("id", "cluster", "vec")
        if clusters:
            now = now.where(~F.col("cluster").isin(clusters))
        if gone is not None:
            now = without(now, gone)
        if rows is not None:
            rows = rows.select("id", F.col("cluster").cast("long").alias("cluster"), "vec")
            now = now.union(rows)
        change = Change(rows, tuple(clusters or ()), gone)
        return replace(self, postings=now, changes=None if self.changes is None else (*self.changes, change))

    def clusters(self) -> DataFrame:
        """cluster, n, a, s and centroid; an empty partition has n = 0."""
        spark = self.postings.sparkSession
        table = centroid_table(spark, self.centroids)
        return table.join(kmeans.statistics(self.postings), "cluster", "left").select("cluster", F.coalesce("n", F.lit(0)).alias("n"), "a", F.coalesce("s", F.lit(0.0)).alias("s"), "centroid")

    def sizes(self) -> DataFrame:
        return self.postings.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))

    def members(self) -> dict[int, int]:
        """Members of each partition that has any."""
        return {r["cluster"]: r["n"] for r in self.sizes().collect()}

    def counted(self, **more: int) -> Index:
        return replace(self, counters={**self.counters, **{k: self.counters.get(k, 0) + v for k, v in more.items()}})


def centroid_table(spark: SparkSession, centroids: dict[int, list[float]]) -> DataFrame:
    return spark.createDataFrame([(c, list(map(float, v))) for c, v in sorted(centroids.items())], "cluster long, centroid array<double>")


def in_order(postings: DataFrame) -> DataFrame:
    """id, cluster, pos, n and vec: with the place of each id in its partition, in order of id, and the partition's size."""
    return numbered(postings.select("id", "cluster", "vec"), ["cluster"], ["id"], "pos", "n").select("id", "cluster", "pos", "n", "vec")


def build(vectors: DataFrame, config: IndexConfig = IndexConfig(), centroids: dict[int, list[float]] | None = None) -> Index:
    """Cluster the vectors (id, vec), and assign each to its nearest centroid."""
    start = kmeans.seeds if config.seeding == "spread" else kmeans.first_seeds
    centroids = centroids or kmeans.lloyd(vectors, start(vectors, config.nlist), config.rounds)
    postings = knn.nearest(vectors.select("id", "vec"), centroids, config.metric).select("id", "cluster", "vec")
    n, k = vectors.count(), max(1, len(centroids))
    return Index(postings, centroids, config, config.split_factor * n / k, config.merge_factor * n / k)


def write(index: Index, path: str, mode: str = "errorifexists") -> None:
    """Postings partitioned by cluster, so that a probe reads only the folders it needs (Spark splits large partitions into files); the centroids, with bounds and counters, are written last."""
    index.postings.select("id", "vec", "cluster").hint("rebalance", "cluster").write.mode(mode).partitionBy("cluster").parquet(f"{path}/postings")
    table = centroid_table(index.postings.sparkSession, index.centroids)
    own = {"split_above": F.lit(float(index.split_above)), "merge_below": F.lit(float(index.merge_below)), "counters": F.lit(json.dumps(index.counters))}
    table.withColumns(own).write.mode(mode).parquet(f"{path}/centroids")


def read(spark: SparkSession, path: str, config: IndexConfig = IndexConfig()) -> Index:
    """A written index, with the bounds and counters it had."""
    rows = spark.read.parquet(f"{path}/centroids").collect()
    postings = spark.read.schema("id long, vec array<double>, cluster long").parquet(f"{path}/postings").select("id", "cluster", "vec")
    return Index(postings, {r["cluster"]: list(r["centroid"]) for r in rows}, config, rows[0]["split_above"], rows[0]["merge_below"], json.loads(rows[0]["counters"]), ())


def _found(queries: DataFrame, index: Index, k: int, nprobes: list[int]) -> DataFrame:
    """qid, level, id, distance: k candidates a query of the partitions that come to the probes of each level, from the one before it on."""
    probed = knn.probes(queries, index.centroids, max(nprobes), index.config.metric)
    level = F.size(F.filter(F.array(*map(F.lit, sorted(nprobes))), lambda n: n < F.col("rank"))).cast("long")
    return probing.among(probed.select("qid", "cluster", level.alias("level")), queries, index.postings, index.members, k, index.config.metric)


def search(queries: DataFrame, index: Index, k: int = 100, nprobe: int = 8) -> DataFrame:
    """qid, rank, id, distance: the k nearest among the members of the nprobe nearest partitions, best first, ties to the smaller id."""
    return knn.ranked(_found(queries, index, k, [nprobe]).drop("level"), k)


def sweep(queries: DataFrame, index: Index, k: int, nprobes: list[int]) -> DataFrame:
    """nprobe, qid, rank, id, distance for each of several nprobes, from one scan of the most that any needs."""
    levels = sorted(set(nprobes))
    found = _found(queries, index, k, levels)
    each = found.withColumn("nprobe", F.explode(F.slice(F.array(*map(F.lit, levels)), F.col("level").cast("int") + 1, len(levels))))
    w = Window.partitionBy("nprobe", "qid").orderBy("distance", "id")
    return each.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= k).select("nprobe", "qid", "rank", "id", "distance")


def radii(index: Index) -> dict[int, float]:
    """The distance of each partition's farthest member from its centroid: a row for each partition, none for an empty one."""
    table = F.create_map(*[x for c, v in index.centroids.items() for x in (F.lit(c).cast("long"), F.array(*map(F.lit, v)))])
    far = F.sqrt(V.squared_l2(F.col("vec"), table[F.col("cluster")]))
    return {r["cluster"]: r["far"] for r in index.postings.groupBy("cluster").agg(F.max(far).alias("far")).collect()}


def bounded(queries: DataFrame, index: Index, k: int, nprobe: int = 1) -> tuple[DataFrame, DataFrame]:
    """Exact neighbours (qid, rank, id, distance) among all members, and the partitions asked for them (qid, cluster, level).

    A member of a partition is no nearer than the centroid less the partition's radius (by inner product: no better than the
    centroid's product plus the query's length times the radius). Level 0 asks the nprobe nearest partitions; level 1 those
    whose bound doesn't exclude a neighbour better than the k-th found there, and all where fewer than k were found.
    """
    metric, reach, held = index.config.metric, radii(index), index.members
    names = np.array(sorted(reach), np.int64)
    table = np.array([index.centroids[c] for c in names.tolist()], np.float64)
    radius = np.array([reach[c] for c in names.tolist()])
    queries = queries.where("vec is not null").select("qid", "vec")
    if not len(names):
        return knn.ranked(queries.sparkSession.createDataFrame([], knn.NEIGHBOURS), k), queries.sparkSession.createDataFrame([], "qid long, cluster long, level long")
    first = knn.probes(queries, {c: index.centroids[c] for c in names.tolist()}, nprobe, metric).select("qid", "cluster", F.lit(0).cast("long").alias("level"))
    near = stored(probing.among(first, queries, index.postings, held, k, metric))
    kth = knn.ranked(near.drop("level"), k).groupBy("qid").agg(F.when(F.count(F.lit(1)) >= k, F.max("distance")).alias("kth"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            q, last = matrix(batch.column(1)), batch.column(2).to_numpy(zero_copy_only=False)
            last = np.where(np.isnan(last), np.inf, last)
            length = np.sqrt((q * q).sum(1))[:, None]
            slack = 1e-9 * (1 + length + np.sqrt((table * table).sum(1)) + radius)  # more than rounding takes
            if metric == "ip":
                least = -(q @ table.T) - length * (radius + slack) - slack
                may = least <= last[:, None]
            else:
                apart = np.sqrt(np.maximum((q * q).sum(1)[:, None] + (table * table).sum(1) - 2 * (q @ table.T), 0))
                may = apart - radius - np.sqrt(slack) <= np.sqrt(np.maximum(last, 0))[:, None]
            row, at = np.nonzero(may)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), pa.array(names[at]), pa.array(np.ones(len(row), np.int64))], ["qid", "cluster", "level"])

    due = queries.join(kth, "qid", "left").select("qid", "vec", "kth").mapInArrow(run, "qid long, cluster long, level long")
    more = stored(due.join(first.select("qid", "cluster"), ["qid", "cluster"], "left_anti").select("qid", "cluster", "level"))
    found = near.union(probing.among(more, queries, index.postings, held, k, metric))
    return knn.ranked(found.drop("level"), k), first.union(more)
