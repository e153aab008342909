"""Nearest members of chosen partitions: each query meets the partitions that it asks for, and no task more than a slice of one.

Up to FEW queries go to where the members are, which aren't shuffled, and only the partitions that some query asks for are
read. More queries meet slices of partitions in blocks. Either way a task returns k candidates a query and level.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.arrow import blocks as blocks_of
from ..functions.arrow import matrix
from ..functions.arrow import nearest as nearest_rows

#: Queries that are sent to all tasks, or that a task holds; members of a slice. A slice is sent to each block of the queries that
#: ask for its partition: these are larger, MOST at most, where there are more than TASKS meetings.
FEW, SLICE = 2_000, 20_000
MOST, TASKS = 20_000, 96
#: Queries and members of a matrix product.
CHUNK = 1_000
CANDIDATES = "qid long, level long, id long, distance double"


class Best:
    """The k nearest so far of each (query, level); ties go to the smaller id."""

    def __init__(self, n: int, k: int):
        self.d, self.ids, self.k = np.full((n, k), np.nan), np.full((n, k), np.iinfo(np.int64).max), k

    def add(self, rows: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray, metric: str) -> None:
        for a in range(0, len(ids), CHUNK):
            for b in range(0, len(rows), CHUNK):
                own = rows[b : b + CHUNK]
                d, near = nearest_rows(q[b : b + CHUNK], x[a : a + CHUNK], ids[a : a + CHUNK], self.k, metric, self.d[own, -1])
                some = near[:, 0] < np.iinfo(np.int64).max
                own = own[some]
                d, near = np.hstack([self.d[own], d[some]]), np.hstack([self.ids[own], near[some]])
                order = np.lexsort((near, d))[:, : self.k]  # places without a member come last: not a number, largest id
                self.d[own], self.ids[own] = np.take_along_axis(d, order, 1), np.take_along_axis(near, order, 1)

    def rows(self, qids: np.ndarray, levels: np.ndarray) -> list[pa.Array]:
        some = self.ids < np.iinfo(np.int64).max
        return [pa.array(np.repeat(qids, self.k)[some.ravel()]), pa.array(np.repeat(levels, self.k)[some.ravel()]), pa.array(self.ids[some]), pa.array(self.d[some])]


def among(asked: DataFrame, queries: DataFrame, postings: DataFrame, sizes: Callable[[], dict[int, int]], k: int, metric: str) -> DataFrame:
    """CANDIDATES: of each query (qid, vec) and level the k nearest of the members (id, cluster, vec) of the partitions asked (qid, cluster, level).

    ``sizes`` gives the members of each partition, where there are many queries. A partition is asked once by a query, at one level.
    """
    queries = queries.where("vec is not null").select("qid", "vec")
    few = queries.limit(FEW + 1).collect()
    return _few(few, asked, postings, k, metric) if len(few) <= FEW else _many(asked, queries, postings, sizes(), k, metric)


def _few(few: list, asked: DataFrame, postings: DataFrame, k: int, metric: str) -> DataFrame:
    at = {r["qid"]: i for i, r in enumerate(few)}
    q = np.array([r["vec"] for r in few], np.float64)
    pairs = [(r["cluster"], at[r["qid"]], r["level"]) for r in asked.select("cluster", "qid", "level").collect() if r["qid"] in at]  # partitions a query, FEW queries
    keys = sorted({(row, level) for _, row, level in pairs})
    place = {key: i for i, key in enumerate(keys)}
    lists: dict[int, list[tuple[int, int]]] = {}
    for c, row, level in pairs:
        lists.setdefault(c, []).append((place[row, level], row))
    of = {c: tuple(np.array(x, np.int64).T) for c, x in lists.items()}
    qids = np.array([few[row]["qid"] for row, _ in keys], np.int64)
    levels = np.array([level for _, level in keys], np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(len(keys), k)
        for batch in batches:
            if not len(batch):
                continue
            ids, cluster, x = batch.column(0).to_numpy(), batch.column(1).to_numpy(), matrix(batch.column(2))
            order = np.argsort(cluster, kind="stable")
            for own in np.split(order, np.flatnonzero(np.diff(cluster[order])) + 1):
                rows, row = of[int(cluster[own[0]])]
                best.add(rows, q[row], ids[own], x[own], metric)
        yield pa.RecordBatch.from_arrays(best.rows(qids, levels), ["qid", "level", "id", "distance"])

    if not of:
        return postings.sparkSession.createDataFrame([], CANDIDATES)
    return postings.where(F.col("cluster").isin(list(of))).where("id is not null").select("id", "cluster", "vec").mapInArrow(run, CANDIDATES)


def _many(asked: DataFrame, queries: DataFrame, postings: DataFrame, sizes: dict[int, int], k: int, metric: str) -> DataFrame:
    """Slices of partitions meet blocks of the queries that ask for them; both are spread by hashes."""
    asking = {r["cluster"]: r["n"] for r in asked.groupBy("cluster").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row for each partition
    if not asking:
        return postings.sparkSession.createDataFrame([], CANDIDATES)
    parts = {c: max(1, math.ceil(sizes.get(c, 0) / SLICE)) for c in asking}
    total = sum(parts.values())
    count = lambda of: F.create_map(*[F.lit(v).cast("long") for c in asking for v in (c, of[c])])[F.col("cluster")]
    slices, blocks = count(parts), count({c: blocks_of(n, total, FEW, MOST, TASKS) for c, n in asking.items()})
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n - 1))
    part = lambda key, n: F.pmod(F.xxhash64(key), n)
    left = asked.join(queries, "qid").withColumn("block", part("qid", blocks)).select("qid", "level", F.col("vec").alias("qvec"), "cluster", "block", every(slices).alias("slice"))
    right = postings.where(F.col("cluster").isin(list(asking))).where("id is not null").withColumn("slice", part("id", slices)).select("id", "vec", "cluster", "slice", every(blocks).alias("block"))

    def meet(q: pa.Table, b: pa.Table) -> pa.Table:
        best = Best(len(q), k)
        if len(q) and len(b):
            best.add(np.arange(len(q)), matrix(q["qvec"]), b["id"].to_numpy(), matrix(b["vec"]), metric)
        return pa.table(best.rows(q["qid"].to_numpy(), q["level"].to_numpy()), ["qid", "level", "id", "distance"])

    keys = ("cluster", "slice", "block")
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(meet, CANDIDATES)
