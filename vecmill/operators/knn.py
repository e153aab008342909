"""Exact nearest neighbours of a query set, in blocks."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.arrow import blocks, matrix
from ..functions.arrow import nearest as nearest_rows

#: Queries and vectors that meet in one task; a query set of one block is sent to every task of the base. A base block is sent to
#: each block of queries: these are larger, MOST at most, where there are more than TASKS meetings.
QUERY_BLOCK, BASE_BLOCK = 2_000, 20_000
MOST, TASKS = 20_000, 96
#: Queries and vectors of a matrix product, which bounds the matrix of distances.
CHUNK = 1_000
NEIGHBOURS = "qid long, id long, distance double"


class _Best:
    """The k nearest so far of each query; ties go to the smaller id."""

    def __init__(self, q: np.ndarray, k: int, metric: str):
        self.q, self.k, self.metric = q, k, metric
        self.d, self.ids = np.zeros((len(q), 0)), np.zeros((len(q), 0), np.int64)

    def add(self, ids: np.ndarray, x: np.ndarray) -> None:
        for a in range(0, len(ids), CHUNK):
            full = self.d.shape[1] == self.k
            found = [nearest_rows(self.q[b : b + CHUNK], x[a : a + CHUNK], ids[a : a + CHUNK], self.k, self.metric, self.d[b : b + CHUNK, -1] if full else None) for b in range(0, len(self.q), CHUNK)]
            d, near = (np.vstack(c) for c in zip(*found, strict=True))
            if full:
                rows = np.flatnonzero(near[:, 0] < np.iinfo(np.int64).max)
                d, near = np.hstack([self.d[rows], d[rows]]), np.hstack([self.ids[rows], near[rows]])
                order = np.lexsort((near, d))[:, : self.k]
                self.d[rows], self.ids[rows] = np.take_along_axis(d, order, 1), np.take_along_axis(near, order, 1)
                continue
            d, near = np.hstack([self.d, d]), np.hstack([self.ids, near])
            order = np.lexsort((near, d))[:, : self.k]
            self.d, self.ids = np.take_along_axis(d, order, 1), np.take_along_axis(near, order, 1)

    def columns(self, qids: np.ndarray) -> list[pa.Array]:
        return [pa.array(np.repeat(qids, self.ids.shape[1])), pa.array(self.ids.ravel()), pa.array(self.d.ravel())]


def exact(queries: DataFrame, base: DataFrame, k: int, metric: str = "l2", exclude_self: bool = False) -> DataFrame:
    """qid, rank (from 1), id and distance of the k nearest of base (id, vec) to each of queries (qid, vec).

    Squared L2, or the negative inner product for ``ip``; ties go to the smaller id; null vectors are no neighbours and ask
    for none. Up to QUERY_BLOCK queries go to where the base is, which isn't shuffled: each task keeps k candidates a query.
    More meet it in blocks, each pair in one task. The candidates of a query are ranked together.
    """
    queries, base = queries.where("vec is not null"), base.where("vec is not null")
    few = queries.select("qid", "vec").limit(QUERY_BLOCK + 1).collect()
    if len(few) <= QUERY_BLOCK:
        return ranked(_scanned(few, base, k + exclude_self, metric, exclude_self), k)
    nb = max(1, math.ceil(base.count() / BASE_BLOCK))
    nq = blocks(queries.count(), nb, QUERY_BLOCK, MOST, TASKS)
    part = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = queries.select("qid", F.col("vec").alias("qvec"), part("qid", nq).alias("qb"), every(nb).alias("bb"))
    right = base.select("id", "vec", part("id", nb).alias("bb"), every(nq).alias("qb"))
    keep = k + exclude_self

    def block(q: pa.Table, b: pa.Table) -> pa.Table:
        best = _Best(matrix(q["qvec"]), keep, metric)
        if len(q) and len(b):
            best.add(b["id"].to_numpy(), matrix(b["vec"]))
        return pa.table(best.columns(q["qid"].to_numpy()), ["qid", "id", "distance"])

    found = left.groupBy("qb", "bb").cogroup(right.groupBy("qb", "bb")).applyInArrow(block, NEIGHBOURS)
    if exclude_self:
        found = found.where("qid <> id")
    return ranked(found, k)


def _scanned(few: list, base: DataFrame, k: int, metric: str, exclude_self: bool) -> DataFrame:
    """qid, id, distance: the k nearest to each of a few queries among the rows of every task."""
    qids, q = np.array([r["qid"] for r in few], np.int64), np.array([r["vec"] for r in few], np.float64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = _Best(q, k, metric)
        for batch in batches:
            if len(batch) and len(qids):
                best.add(batch.column(0).to_numpy(), matrix(batch.column(1)))
        yield pa.RecordBatch.from_arrays(best.columns(qids), ["qid", "id", "distance"])

    found = base.select("id", "vec").mapInArrow(run, NEIGHBOURS)
    return found.where("qid <> id") if exclude_self else found


def ranked(candidates: DataFrame, k: int) -> DataFrame:
    """The k nearest candidates (qid, id, distance) of each query, with their rank."""
    w = Window.partitionBy("qid").orderBy("distance", "id")
    return candidates.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= k).select("qid", "rank", "id", "distance")


def nearest(vectors: DataFrame, centroids: dict[int, list[float]], metric: str = "l2", second: bool = False) -> DataFrame:
    """vectors (id, vec, ...) with cluster and distance of the nearest centroid (and cluster2, distance2 of the next).

    The centroids are the index's own, bounded by its number of partitions; ties go to the smaller cluster, and a lone centroid
    has no next one (null). A row whose vector is null has no nearest centroid and is left out.
    """
    names = np.array(sorted(centroids), np.int64)
    table = np.array([centroids[c] for c in names.tolist()], np.float64)
    extra = ["cluster", "distance"] + ["cluster2", "distance2"] * second

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            d, near = nearest_rows(matrix(batch.column(batch.schema.get_field_index("vec"))), table, names, 1 + second, metric)
            columns = [pa.array(c) for i in range(near.shape[1]) for c in (near[:, i], d[:, i])]
            columns += [pa.nulls(len(batch), pa.int64()), pa.nulls(len(batch), pa.float64())] * (1 + second - near.shape[1])
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], [*batch.schema.names, *extra])

    kept = vectors.where("vec is not null").drop(*extra)
    schema = kept
    for name in extra:
        schema = schema.withColumn(name, F.lit(None).cast("long" if name.startswith("cluster") else "double"))
    return kept.mapInArrow(run, schema.schema)


def probes(queries: DataFrame, centroids: dict[int, list[float]], nprobe: int, metric: str = "l2") -> DataFrame:
    """qid, qvec and the nprobe nearest clusters, a row each, with rank and distance."""
    names = np.array(sorted(centroids), np.int64)
    table = np.array([centroids[c] for c in names.tolist()], np.float64)
    n = min(nprobe, len(names))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            d, near = nearest_rows(matrix(batch.column(1)), table, names, n, metric)
            take = batch.take(pa.array(np.repeat(np.arange(len(batch)), n)))
            yield pa.RecordBatch.from_arrays([*take.columns, pa.array(np.tile(np.arange(1, n + 1), len(batch))), pa.array(near.ravel()), pa.array(d.ravel())], ["qid", "qvec", "rank", "cluster", "distance"])

    return queries.where("vec is not null").select("qid", F.col("vec").alias("qvec")).mapInArrow(run, "qid long, qvec array<double>, rank long, cluster long, distance double")
