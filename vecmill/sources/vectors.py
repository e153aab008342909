"""Where vectors come from and results go: Parquet, .npy folders, record archives; JSON and CSV results; generated vectors."""

from __future__ import annotations

import io
import json
import tarfile
from collections.abc import Iterator
from datetime import UTC, datetime

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..functions.arrow import lists
from ..functions.ranks import numbered
from ..operators import knn
from . import npy
from .scratch import exists, write_text


def from_table(table: DataFrame, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """id and vec (doubles) of a table of embeddings."""
    return table.select(F.col(key).cast("long").alias("id"), V.doubles(F.col(column)).alias("vec"))


def read(spark: SparkSession, path: str, form: str = "parquet", most: int | None = None, **names: str) -> DataFrame:
    """Vectors in one of the forms; ``most`` keeps ids below it."""
    if form == "parquet":
        out = from_table(spark.read.parquet(path), **names)
    elif form == "npy":
        out = _npy(spark, path)
    else:
        raise ValueError(f"unknown form {form!r}")
    return out if most is None else out.where(F.col("id") < most)


def until(tables: list[DataFrame], quota: int) -> DataFrame:
    """id, vec and source (the place of its table): whole tables in turn while the quota isn't met, and the smallest ids of the one that meets it."""
    out, left = None, quota
    for i, table in enumerate(tables):
        if out is not None and left <= 0:
            break
        n = table.count()
        part = table if n <= left else table.orderBy("id").limit(max(0, left))
        part = part.select("id", "vec", F.lit(i).cast("long").alias("source"))
        out, left = part if out is None else out.union(part), left - n
    return out


def _npy(spark: SparkSession, path: str) -> DataFrame:
    """Rows of the matrix in a .npy file or a folder of parts, numbered in order; tasks read ranges of rows (``sources.npy``)."""
    spark.dataSource.register(npy.NpySource)
    return spark.read.format("npy").load(path)


def records(spark: SparkSession, path: str, width: int = 6) -> DataFrame:
    """path, member, place, vec: float32 records from the .bin members of tar archives; members of another size are skipped."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, raw in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                with tarfile.open(fileobj=io.BytesIO(raw.as_py())) as tar:
                    for member in tar:
                        body = tar.extractfile(member).read() if member.isfile() and member.name.endswith(".bin") else b""
                        if not body or len(body) % (4 * width):
                            continue
                        m = np.frombuffer(body, np.float32).reshape(-1, width)
                        yield pa.RecordBatch.from_arrays([pa.array([name] * len(m)), pa.array([member.name] * len(m)), pa.array(np.arange(len(m))), lists(m)], ["path", "member", "place", "vec"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "path string, member string, place long, vec array<double>")


def truth(base: DataFrame, queries: DataFrame, stored: DataFrame | None, k: int, metric: str = "l2") -> DataFrame:
    """Stored neighbours (qid, rank, id) where each is a row of base and every query has k; computed otherwise."""
    if stored is not None:
        first = stored.where(F.col("rank") <= k)
        enough = first.join(base.select("id"), "id").groupBy("qid").count().where(F.col("count") >= k)
        if queries.select("qid").join(enough, "qid", "left_anti").isEmpty():
            return first.select("qid", "rank", "id")
    return knn.exact(queries, base, k, metric).select("qid", "rank", "id")


def train_and_queries(vectors: DataFrame, n_train: int, n_queries: int) -> tuple[DataFrame, DataFrame]:
    """The first n_train ids, and the n_queries after them, numbered anew."""
    i = F.col("id")
    return vectors.where(i < n_train), vectors.where((i >= n_train) & (i < n_train + n_queries)).select((i - n_train).alias("qid"), "vec")


def write_dataset(train: DataFrame, queries: DataFrame, neighbours: DataFrame, path: str, overwrite: bool = False, **about: str) -> None:
    """Three Parquet tables, and metadata.json with their sizes, the dimension and what ``about`` says; what is there already stays unless ``overwrite``."""
    spark = train.sparkSession
    for name, table in (("train", train), ("queries", queries), ("truth", neighbours)):
        table.write.mode("overwrite" if overwrite else "ignore").parquet(f"{path}/{name}")
    if overwrite or not exists(spark, f"{path}/metadata.json"):
        written = {name: spark.read.parquet(f"{path}/{name}") for name in ("train", "queries", "truth")}
        width = written["train"].select(F.max(F.size("vec"))).first()[0]
        k = written["truth"].select(F.max("rank")).first()[0]
        sizes = {"n_train": written["train"].count(), "n_queries": written["queries"].count(), "dimension": width or 0, "gt_k": k or 0}
        write_text(spark, f"{path}/metadata.json", json.dumps({**about, **sizes, "created_utc": datetime.now(UTC).isoformat()}, indent=2))


def write_report(table: DataFrame, path: str, form: str = "csv") -> None:
    """A result table (a row for each method and setting) as one CSV with a header, or as JSON lines."""
    one = table.coalesce(1).write.mode("overwrite")
    one.option("header", True).csv(path) if form == "csv" else one.json(path)


def read_results(spark: SparkSession, paths: list[str], key: list[str]) -> DataFrame:
    """JSON results of several files; a later file's row replaces an earlier one's of the same key."""
    from ..plans.reports import last_wins

    return last_wins([spark.read.option("multiLine", True).json(p) for p in paths], key)


def _uniform(*keys) -> Column:
    """In (0, 1), the same for the same keys."""
    return (F.pmod(F.xxhash64(*keys), F.lit(1 << 52)) + 0.5) / float(1 << 52)


def normal(*keys) -> Column:
    """Standard normal by Box and Muller, the same for the same keys at any partitioning."""
    return F.sqrt(-2 * F.log(_uniform(*keys, F.lit("r")))) * F.cos(2 * np.pi * _uniform(*keys, F.lit("a")))


#: Clusters, spread, drift and seed of the generated datasets.
PROFILES = {
    "core50": {"clusters": 64, "std": 0.34, "drift": 0.28, "seed": 1501},
    "ScanNetCLIP": {"clusters": 80, "std": 0.42, "drift": 0.36, "seed": 2602},
    "Ego4D": {"clusters": 72, "std": 0.48, "drift": 0.45, "seed": 3703},
}


def profiled(spark: SparkSession, profile: str, n: int, dim: int = 64) -> DataFrame:
    """``generated`` by a named profile."""
    if profile not in PROFILES:
        raise ValueError(f"unknown profile {profile!r}")
    return generated(spark, n, dim, **PROFILES[profile])


def sharded(spark: SparkSession, paths: list[str], quota: int, allow_less: bool = False, **names: str) -> DataFrame:
    """id (from 0, in order of shard and of the rows' own ids in it) and vec of the first ``quota`` rows of Parquet shards; too few are an error unless ``allow_less``."""
    out = None
    for i, p in enumerate(paths):
        table = spark.read.parquet(p)
        key, column = names.get("key", "vec_id"), names.get("column", "embedding")
        one = table.select(F.lit(i).alias("shard"), F.col(key).cast("long").alias("row"), V.doubles(F.col(column)).alias("vec"))
        out = one if out is None else out.union(one)
    rows = numbered(out, [], ["shard", "row"]).where(F.col("place") < quota).select(F.col("place").alias("id"), "vec")
    if not allow_less and rows.count() < quota:
        raise ValueError(f"the shards hold fewer than {quota} rows")
    return rows


def generated(spark: SparkSession, n: int, dim: int = 64, clusters: int = 64, std: float = 0.34, drift: float = 0.28, seed: int = 1501) -> DataFrame:
    """id, cluster, vec: unit vectors around random centres of uneven (log-normal) weight; later ones of every fourth cluster are displaced by ``drift``."""
    weight = np.exp(np.random.default_rng(seed).normal(size=clusters))
    edges = np.cumsum(weight / weight.sum())[:-1].tolist()
    u = _uniform(F.col("id"), F.lit(seed))
    cluster = F.size(F.filter(F.array(*map(F.lit, edges)), lambda e: e < F.col("u"))).cast("long") if edges else F.lit(0).cast("long")
    moved = (F.col("cluster") % 4 == 0) & (F.col("id") >= n // 2)
    part = lambda j: normal(F.col("cluster"), j, F.lit(seed)) + std * normal(F.col("id"), j, F.lit(seed + 1)) + F.when(moved, drift * normal(F.col("cluster"), j, F.lit(seed + 2))).otherwise(0.0)
    rows = spark.range(n).withColumn("u", u).withColumn("cluster", cluster)
    return rows.select("id", "cluster", V.unit(F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), part)).alias("vec"))


def boundary_mixtures(spark: SparkSession, centroids: dict[int, list[float]], n: int, noise: float = 0.15, seed: int = 7) -> DataFrame:
    """qid, vec: unit mixtures, between 0.35 and 0.65, of two centroids picked by hash, plus noise."""
    names = sorted(centroids)
    table = F.array(*[F.array(*map(F.lit, centroids[c])) for c in names])
    pick = lambda salt: F.pmod(F.xxhash64("id", F.lit(seed), F.lit(salt)), F.lit(len(names))).cast("int")
    a = pick("a")
    b = F.pmod(a + 1 + F.pmod(F.xxhash64("id", F.lit(seed), F.lit("b")), F.lit(max(1, len(names) - 1))).cast("int"), F.lit(len(names)))
    t = 0.35 + 0.3 * _uniform(F.col("id"), F.lit(seed), F.lit("t"))
    rows = spark.range(n).select("id", t.alias("t"), F.get(table, a).alias("x"), F.get(table, b).alias("y"))
    mixed = F.zip_with("x", "y", lambda p, q: F.col("t") * p + (1 - F.col("t")) * q)
    noisy = F.transform(mixed, lambda v, j: v + noise * normal(F.col("id"), j, F.lit(seed)))
    return rows.select(F.col("id").alias("qid"), V.unit(noisy).alias("vec"))


def around_centroids(spark: SparkSession, centroids: dict[int, list[float]], n: int, noise: float = 0.25, seed: int = 11) -> DataFrame:
    """qid, vec: unit vectors near centroids picked by hash."""
    names = sorted(centroids)
    table = F.array(*[F.array(*map(F.lit, centroids[c])) for c in names])
    pick = F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(len(names))).cast("int")
    noisy = F.transform("x", lambda v, j: v + noise * normal(F.col("id"), j, F.lit(seed)))
    return spark.range(n).select("id", F.get(table, pick).alias("x")).select(F.col("id").alias("qid"), V.unit(noisy).alias("vec"))
