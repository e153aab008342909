"""k-means whose result doesn't depend on the order of rows, and its objective."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import vectors as V
from ..functions.arrow import matrix, paired
from ..functions.ranks import numbered
from ..sources.scratch import stored
from .knn import nearest

#: Coordinates are summed as integers of this unit, so that sums are the same in any order; what is smaller counts as 0.
UNIT = 1e9
#: Sums are kept in two parts, of this base, and the magnitude of a coordinate is bounded so that neither overflows in a task.
BASE, LARGEST = 2.0**30, 2.0**49


def _parts(assigned: DataFrame) -> DataFrame:
    """cluster, n, high and low of rows (cluster, vec): a task's sums as whole numbers of UNIT in two parts, a row for each cluster."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            cluster = batch.column(0).to_numpy()
            x = matrix(batch.column(1))
            if not (np.abs(x) < LARGEST).all():
                raise ValueError("a coordinate isn't finite or is too large to sum")
            x = np.floor(x * UNIT + 0.5)
            high = np.floor(x / BASE)
            names, at = np.unique(cluster, return_inverse=True)
            sums = np.zeros((2, len(names), x.shape[1]), np.int64)
            for part, of in zip(sums, (high, x - high * BASE), strict=True):
                np.add.at(part, at, of.astype(np.int64))
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(np.bincount(at)), pa.array(list(sums[0]), longs), pa.array(list(sums[1]), longs)], ["cluster", "n", "high", "low"])

    return assigned.where("vec is not null").select("cluster", "vec").mapInArrow(partial, "cluster long, n long, high array<long>, low array<long>")


def _totals(parts: DataFrame) -> DataFrame:
    """cluster, pos, x: the whole-number sum of each coordinate."""
    whole = lambda c: F.sum(F.col(f"x.{c}").cast("decimal(20,0)"))
    total = whole("high") * F.lit(int(BASE)).cast("decimal(10,0)") + whole("low")
    return parts.select("cluster", F.posexplode(F.arrays_zip("high", "low")).alias("pos", "x")).groupBy("cluster", "pos").agg(total.alias("x"))


def statistics(assigned: DataFrame) -> DataFrame:
    """cluster, n, a (vector sum) and s (its squared norm) of rows (cluster, vec); partial sums leave each task as a row a cluster.

    Rows whose vector is null don't count; coordinates of 2**49 or more, or that aren't finite, are refused.
    """
    parts = _parts(assigned)
    counts = parts.groupBy("cluster").agg(F.sum("n").alias("n"))
    sums = _totals(parts).withColumn("x", F.col("x").cast("double") / UNIT)
    a = F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda p: p["x"])
    return counts.join(sums.groupBy("cluster").agg(a.alias("a")), "cluster").withColumn("s", V.squared_norm(F.col("a")))


def whole_sums(assigned: DataFrame) -> dict[int, tuple[int, list[int]]]:
    """Members and whole-number sums of the clusters that have members: as many rows as the index has partitions."""
    parts = stored(_parts(assigned))
    n = {r["cluster"]: r["n"] for r in parts.groupBy("cluster").agg(F.sum("n").alias("n")).collect()}
    sums: dict[int, dict[int, int]] = {c: {} for c in n}
    for r in _totals(parts).collect():
        sums[r["cluster"]][r["pos"]] = int(r["x"])
    return {c: (n[c], [v for _, v in sorted(sums[c].items())]) for c in n}


def means(stats: DataFrame) -> dict[int, list[float]]:
    """Centroids of the clusters that have members: as many rows as the index has partitions."""
    return {r["cluster"]: [x / r["n"] for x in r["a"]] for r in stats.where("n > 0").collect()}


def first_seeds(vectors: DataFrame, k: int) -> dict[int, list[float]]:
    """The vectors of the k smallest ids, as clusters 0 to k - 1."""
    return {i: list(r["vec"]) for i, r in enumerate(vectors.select("id", "vec").where("vec is not null").orderBy("id").limit(k).collect())}


def _uniform(key: Column, salt: str) -> Column:
    """In (0, 1), from the first 13 hex digits of a hash: the same for a key wherever it is taken."""
    digits = F.substring(F.md5(F.concat_ws(":", key.cast("string"), F.lit(salt))), 1, 13)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / 2.0**52


def _uniforms(keys: list[int], salt: str) -> np.ndarray:
    return np.array([(int(hashlib.md5(f"{k}:{salt}".encode()).hexdigest()[:13], 16) + 0.5) / 2.0**52 for k in keys])


def candidates(vectors: DataFrame, k: int, rounds: int = 3, over: float = 2.0, seed: int = 42) -> dict[int, list[float]]:
    """Vectors far from each other, by id: one, and in each round ``over`` x k more, each drawn by its squared distance to those before.

    A draw takes the smallest of exponential variables whose rate is the squared distance, made from a hash of the id: the
    same vectors at any partitioning. A round scans the table once; 1 + rounds x over x k vectors come to the driver. Fewer
    come where fewer are different. Null vectors and null ids don't take part.
    """
    v = vectors.where("vec is not null and id is not null").select("id", "vec")
    taken = {r["id"]: list(r["vec"]) for r in v.orderBy(_uniform(F.col("id"), f"{seed}:0"), "id").limit(1).collect()}
    for i in range(rounds if taken else 0):
        far = nearest(v, taken).where("distance > 0")
        key = -F.log(_uniform(F.col("id"), f"{seed}:{i + 1}")) / F.col("distance")
        taken |= {r["id"]: list(r["vec"]) for r in far.orderBy(key, "id").limit(round(over * k)).select("id", "vec").collect()}
    return taken


def seeds(vectors: DataFrame, k: int, rounds: int = 3, over: float = 2.0, seed: int = 42) -> dict[int, list[float]]:
    """k start centroids by squared-distance sampling: ``candidates``, weighed by how many vectors are nearest to each, and of these k by the same draw.

    What is drawn from the candidates is drawn on the driver, one after the other; fewer than k different vectors make fewer.
    """
    found = candidates(vectors, k, rounds, over, seed)
    weight = {r["cluster"]: r["n"] for r in nearest(vectors.where("id is not null").select("id", "vec"), found).groupBy("cluster").agg(F.count(F.lit(1)).alias("n")).collect()} if found else {}
    ids = sorted(weight)
    x = np.array([found[i] for i in ids])
    least, out = np.ones(len(ids)), []
    for step in range(min(k, len(ids))):
        rate = np.array([weight[i] for i in ids]) * least
        if not (rate > 0).any():
            break
        with np.errstate(divide="ignore"):
            best = int(np.argmin(-np.log(_uniforms(ids, f"{seed}:seed{step}")) / rate))
        d = paired(x, np.broadcast_to(x[best], x.shape), "l2")
        least = d if step == 0 else np.minimum(least, d)
        out.append(x[best].tolist())
    return dict(enumerate(out))


def lloyd(vectors: DataFrame, seeds: dict[int, list[float]], rounds: int) -> dict[int, list[float]]:
    """Centroids after so many rounds of assignment by L2 and averaging; a cluster without members stays."""
    now = dict(seeds)
    for _ in range(rounds):
        now |= means(statistics(nearest(vectors, now)))
    return now


def spherical(vectors: DataFrame, seeds: dict[int, list[float]], rounds: int) -> dict[int, list[float]]:
    """The same by inner product with centroids brought to length 1; a zero mean and an empty cluster stay."""
    now = dict(seeds)
    for _ in range(rounds):
        for c, m in means(statistics(nearest(vectors, now, "ip"))).items():
            norm = float(np.sqrt(np.dot(m, m)))
            now[c] = [x / norm for x in m] if norm > 0 else now[c]
    return now


def mllib(vectors: DataFrame, k: int, rounds: int = 25, seed: int = 42, cosine: bool = False) -> dict[int, list[float]]:
    """Centroids of Spark's own k-means, seeded by k-means||."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    data = vectors.select(array_to_vector("vec").alias("features"))
    model = KMeans(k=k, maxIter=rounds, seed=seed, distanceMeasure="cosine" if cosine else "euclidean").fit(data)
    return {i: c.tolist() for i, c in enumerate(model.clusterCenters())}


def local_samples(postings: DataFrame, size: int, seed: int = 42) -> DataFrame:
    """cluster, id, vec, side: up to ``size`` members, in order of a hash, of each partition of max(8, size // 2) or more, in two random halves."""
    key = lambda salt: F.md5(F.concat_ws(":", F.col("id").cast("string"), F.lit(salt), F.lit(seed).cast("string")))
    of = numbered(postings.select("id", "cluster", "vec").withColumn("_key", key("member")), ["cluster"], ["_key", "id"], "_r", "n")
    kept = of.where((F.col("n") >= max(8, size // 2)) & (F.col("_r") < size))
    half = F.row_number().over(Window.partitionBy("cluster").orderBy(key("side"), "id")) > F.floor(F.least("n", F.lit(size)) / 2)
    return kept.select("cluster", "id", "vec", half.cast("int").alias("side"))


def sse(assigned: DataFrame) -> DataFrame:
    """One row: sse, the sum of squared norms less the sum of s/n over the clusters."""
    points = assigned.agg(F.sum(V.squared_norm(F.col("vec"))).alias("points"))
    parts = statistics(assigned).agg(F.sum(F.col("s") / F.col("n")).alias("parts"))
    return points.join(F.broadcast(parts)).select((F.col("points") - F.col("parts")).alias("sse"))
