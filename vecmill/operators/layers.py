"""Versions of an index that share their files: a version adds what has changed, and a reader merges.

A layer is a table of members, with the partitions and the ids that it takes from the layers before it. A batch of updates
writes a layer of the batch's size, a split one of the partition's size; the rest of the index stays where it is. A version
lists its layers, and is there once its own small table is wholly written: what a writer leaves that stopped before is
never read. After MOST_LAYERS layers, or when these hold as many members as the first, all is written anew as one layer.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import children, exists, remove
from .index import FEW_IDS, Index, IndexConfig, centroid_table

#: Layers of a version.
MOST_LAYERS = 8


@dataclass(frozen=True)
class Layer:
    """Its folder, its numbers of members and of ids that are gone, and the partitions that are dealt anew."""

    name: str
    rows: int
    gone: int = 0
    clusters: tuple[int, ...] = ()


def _write(path: str, rows: DataFrame | None, gone: DataFrame | None, clusters: tuple[int, ...], whole: bool) -> Layer:
    name = uuid.uuid4().hex
    at, n, ids = f"{path}/layers/{name}", 0, 0
    if rows is not None:
        spark = rows.sparkSession
        table = rows.select("id", "vec", F.col("cluster").cast("long").alias("cluster"))
        if whole:  # a folder for each partition, large ones in several files
            table.hint("rebalance", "cluster").write.partitionBy("cluster").parquet(f"{at}/rows")
        else:
            table.sortWithinPartitions("cluster").write.parquet(f"{at}/rows")
        n = _rows(spark, at).count()
    if gone is not None:
        gone.select("id").where("id is not null").distinct().write.parquet(f"{at}/gone")
        ids = gone.sparkSession.read.parquet(f"{at}/gone").count()
    return Layer(name, n, ids, clusters)


def _rows(spark: SparkSession, at: str) -> DataFrame:
    return spark.read.schema("id long, vec array<double>, cluster long").parquet(f"{at}/rows")


def save(index: Index, path: str, version: int, before: list[Layer] | None = None) -> list[Layer]:
    """Write a version: the index's changes on top of the layers ``before`` that it was read from, or all of it; its layers.

    ``before`` and the changes belong together: an index whose postings are all new, or that wasn't read here, is written whole.
    """
    spark = index.postings.sparkSession
    changes = index.changes if before else None
    layers = None
    if changes is not None and len(before) + len(changes) <= MOST_LAYERS:
        layers = [*before, *(_write(path, c.rows, c.gone, c.clusters, False) for c in changes)]
        layers = [x for x in layers if x.rows or x.gone or x.clusters]
        if sum(x.rows + x.gone for x in layers[1:]) >= max(1, layers[0].rows) if layers else True:
            layers = None  # the layers above the first cost as much as that one
    if layers is None:
        layers = [_write(path, index.postings, None, (), True)]
    own = {"split_above": F.lit(float(index.split_above)), "merge_below": F.lit(float(index.merge_below)), "counters": F.lit(json.dumps(index.counters)), "layers": F.lit(json.dumps([asdict(x) for x in layers]))}
    centroid_table(spark, index.centroids).withColumns(own).coalesce(1).write.mode("overwrite").parquet(f"{path}/versions/{version}")
    return layers


def merged(spark: SparkSession, path: str, layers: list[Layer]) -> DataFrame:
    """id, cluster and vec of the members that no later layer takes: partitions by a filter at each layer's scan, ids by a join."""
    out = None
    for i, x in enumerate(layers):
        if not x.rows:
            continue
        taken = sorted({c for later in layers[i + 1 :] for c in later.clusters})
        rows = _rows(spark, f"{path}/layers/{x.name}")
        if taken:
            rows = rows.where(~F.col("cluster").isin(taken))
        rows = rows.select("id", "cluster", "vec", F.lit(i).alias("_layer"))
        out = rows if out is None else out.union(rows)
    if out is None:
        return spark.createDataFrame([], "id long, cluster long, vec array<double>")
    gone = [(i, x) for i, x in enumerate(layers) if x.gone]
    if gone:
        ids = None
        for i, x in gone:
            one = spark.read.schema("id long").parquet(f"{path}/layers/{x.name}/gone").select(F.col("id").alias("_gone"), F.lit(i).alias("_at"))
            ids = one if ids is None else ids.union(one)
        last = ids.groupBy("_gone").agg(F.max("_at").alias("_at"))
        few = sum(x.gone for _, x in gone) <= FEW_IDS
        out = out.join(F.broadcast(last) if few else last, (F.col("id") == F.col("_gone")) & (F.col("_layer") < F.col("_at")), "left_anti")
    return out.select("id", "cluster", "vec")


def load(spark: SparkSession, path: str, version: int, config: IndexConfig = IndexConfig()) -> tuple[Index, list[Layer]] | None:
    """A version and its layers; None where it isn't wholly written."""
    at = f"{path}/versions/{version}"
    if not exists(spark, f"{at}/_SUCCESS"):
        return None
    rows = spark.read.parquet(at).collect()  # a row for each partition
    layers = [Layer(**{**x, "clusters": tuple(x["clusters"])}) for x in json.loads(rows[0]["layers"])]
    centroids = {r["cluster"]: list(r["centroid"]) for r in rows}
    index = Index(merged(spark, path, layers), centroids, config, rows[0]["split_above"], rows[0]["merge_below"], json.loads(rows[0]["counters"]), ())
    return index, layers


def versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the versions that have been begun."""
    return [int(v) for v in children(spark, f"{path}/versions")]


def compacted(spark: SparkSession, path: str, version: int, to: int, config: IndexConfig = IndexConfig()) -> list[Layer]:
    """A version written again as version ``to``, in one layer."""
    index, _ = load(spark, path, version, config)
    return save(replace(index, changes=None), path, to)


def vacuum(spark: SparkSession, path: str, keep: int) -> int:
    """Delete versions before ``keep`` and the layers that no version from there on lists; the number of layers deleted.

    For times when no other writer is at work: what a writer hasn't listed yet would go.
    """
    named: set[str] = set()
    for version in versions(spark, path):
        if version < keep:
            remove(spark, f"{path}/versions/{version}")
        elif found := load(spark, path, version):
            named |= {x.name for x in found[1]}
    old = [x for x in children(spark, f"{path}/layers") if x not in named]
    for name in old:
        remove(spark, f"{path}/layers/{name}")
    return len(old)
