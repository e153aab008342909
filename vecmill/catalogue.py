"""All queries of the vector-search part, with the SQL that gives the same rows where SQL can express them.

Every query runs over the whole table. Searches ask for every row whose id is divisible by 50. Report operators, whose
natural input is a table of timings, read ``events`` as one: event_type as method, user_id % 5 as dataset.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import catalogue_sql as S
from .functions import text as T
from .functions import vectors as V
from .functions.scaling import standardised
from .operators import kernels, kmeans, knn, layers, maintenance, positions, quality, serial
from .operators.index import Index, IndexConfig, bounded, build, centroid_table, in_order, search, sweep
from .operators.index import read as read_index
from .operators.index import write as write_index
from .plans import reports
from .sources import npy
from .sources.scratch import scratch_path, stored
from .sources.vectors import PROFILES, around_centroids, boundary_mixtures, from_table, profiled, train_and_queries, truth, until, write_dataset, write_report
from .sources.vectors import read as read_vectors
from .streaming import workload

Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}
_sql: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _queries[f.__name__] = f
        if sql:
            _sql[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return from_table(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors(spark, sf_dir).where(F.col("id") % 50 == 0).select(F.col("id").alias("qid"), "vec")


def indexed(spark: SparkSession, sf_dir: str, metric: str = "l2") -> Index:
    return build(vectors(spark, sf_dir), IndexConfig(metric=metric))


def half_indexed(spark: SparkSession, sf_dir: str, config: IndexConfig = IndexConfig()) -> tuple[Index, DataFrame, int]:
    """The index of the first half, the rest as a stream, and its length."""
    first, rest, n = workload.offsets(vectors(spark, sf_dir))
    return build(first, config), rest, n


def r6(x: str | Column) -> Column:
    return F.round(F.col(x) if isinstance(x, str) else x, 6)


def coordinates(df: DataFrame, *keys: str, column: str = "vec", digits: int | None = 9) -> DataFrame:
    """A vector column as rows (pos from 0, x)."""
    rows = df.select(*keys, F.posexplode(column).alias("pos", "x"))
    return rows.select(*keys, F.col("pos").cast("long").alias("pos"), (F.col("x") if digits is None else F.round("x", digits)).alias("x"))


def located(index: Index) -> DataFrame:
    return index.postings.select("id", "cluster")


def largest(index: Index) -> int:
    return index.sizes().orderBy(F.desc("n"), "cluster").first()["cluster"]


# ---------------------------------------------------------------- exact search
@query(S.exact("l2"))
def exact_knn_l2(spark, sf_dir):
    return knn.exact(asked(spark, sf_dir), vectors(spark, sf_dir), 10).select("qid", "rank", "id", r6("distance").alias("distance"))


@query(S.exact("ip"))
def exact_knn_ip(spark, sf_dir):
    return knn.exact(asked(spark, sf_dir), vectors(spark, sf_dir), 10, "ip").select("qid", "rank", "id", r6("distance").alias("distance"))


def _bounded(spark, sf_dir, metric):
    found, _ = bounded(asked(spark, sf_dir), indexed(spark, sf_dir, metric), 10)
    return found.select("qid", "rank", "id", r6("distance").alias("distance"))


@query(S.exact("l2"))
def bounded_knn_l2(spark, sf_dir):
    """Exact neighbours from the partitions that the bounds of their balls don't exclude."""
    return _bounded(spark, sf_dir, "l2")


@query(S.exact("ip"))
def bounded_knn_ip(spark, sf_dir):
    return _bounded(spark, sf_dir, "ip")


@query(S.exact("l2", live=True))
def knn_live(spark, sf_dir):
    first, rest, n = workload.offsets(vectors(spark, sf_dir))
    live = first.union(rest.where(workload.live_at(F.col("place"), n)).drop("place"))
    return knn.exact(asked(spark, sf_dir), live, 10).select("qid", "rank", "id", r6("distance").alias("distance"))


# ---------------------------------------------------------------- functions on vectors
@query(S.UNIT)
def unit_normalize(spark, sf_dir):
    v = vectors(spark, sf_dir).select("id", V.unit(V.scale(F.col("vec"), (F.col("id") % 7).cast("double"))).alias("vec"))
    return coordinates(v, "id")


@query(S.STANDARD)
def standardize(spark, sf_dir):
    return coordinates(standardised(vectors(spark, sf_dir)), "id", digits=6)


@query(S.PAIRS)
def vector_functions(spark, sf_dir):
    """Each vector with the next one by id: inner product, squared distance, norm, and coordinates of sum, difference, middle and 32-bit value."""
    v = vectors(spark, sf_dir)
    pair = v.join(v.select((F.col("id") - 1).alias("id"), F.col("vec").alias("y")), "id")
    x, y = F.col("vec"), F.col("y")
    total = lambda c: r6(V.total(c))
    return pair.select("id", r6(V.dot(x, y)).alias("dot"), r6(V.squared_l2(x, y)).alias("l2"), r6(V.squared_norm(x)).alias("norm"), total(V.add(x, y)).alias("added"), total(V.subtract(x, y)).alias("subtracted"), total(V.midpoint(x, y)).alias("middle"), total(V.narrow(V.scale(x, F.lit(2.0))).cast("array<double>")).alias("narrowed"))


# ---------------------------------------------------------------- clustering and the index
@query(S.centroids("SELECT cluster, unnest(centroid) AS x, generate_subscripts(centroid, 1) - 1 AS pos FROM c3"))
def lloyd_centroids(spark, sf_dir):
    v = vectors(spark, sf_dir)
    return coordinates(centroid_table(spark, kmeans.lloyd(v, kmeans.first_seeds(v, 16), 3)), "cluster", column="centroid", digits=None)


@query(S.spherical())
def spherical_centroids(spark, sf_dir):
    v = vectors(spark, sf_dir)
    return coordinates(centroid_table(spark, kmeans.spherical(v, kmeans.first_seeds(v, 16), 3)), "cluster", column="centroid")


@query(S.seeded(0))
def seeded_centroids(spark, sf_dir):
    """Start centroids by squared-distance sampling."""
    return coordinates(centroid_table(spark, kmeans.seeds(vectors(spark, sf_dir), 16)), "cluster", column="centroid")


@query(S.seeded(3))
def seeded_spherical_centroids(spark, sf_dir):
    """These after three rounds of spherical k-means."""
    v = vectors(spark, sf_dir)
    return coordinates(centroid_table(spark, kmeans.spherical(v, kmeans.seeds(v, 16), 3)), "cluster", column="centroid")


@query()
def mllib_centroids(spark, sf_dir):
    """k-means|| by MLlib, whose seeding SQL can't repeat."""
    return coordinates(centroid_table(spark, kmeans.mllib(vectors(spark, sf_dir), 16)), "cluster", column="centroid")


@query(S.assign("l2"))
def assign_l2(spark, sf_dir):
    index = indexed(spark, sf_dir)
    return knn.nearest(vectors(spark, sf_dir), index.centroids).select("id", "cluster", r6("distance").alias("distance"))


@query(S.assign("ip"))
def assign_ip(spark, sf_dir):
    index = indexed(spark, sf_dir)
    return knn.nearest(vectors(spark, sf_dir), index.centroids, "ip").select("id", "cluster", r6("distance").alias("distance"))


@query(S.index("SELECT cluster, count(*) AS n FROM post GROUP BY cluster"))
def cluster_sizes(spark, sf_dir):
    return indexed(spark, sf_dir).sizes()


@query(S.index("SELECT id, cluster, pos FROM post"))
def posting_lists(spark, sf_dir):
    """The index written to disk, partitioned by cluster, and read again."""
    path = scratch_path(spark)
    write_index(indexed(spark, sf_dir), path)
    return in_order(read_index(spark, path).postings).select("id", "cluster", "pos")


@query(S.ENTRY)
def cluster_entry(spark, sf_dir):
    entry = indexed(spark, sf_dir).clusters()
    return entry.select("cluster", "n", r6("s").alias("s"), r6(V.total(F.coalesce("a", F.array().cast("array<double>")))).alias("a_total"))


@query(S.index("SELECT round(sum(list_inner_product(vec, vec)) - (SELECT sum(s / n) FROM stat), 6) AS sse FROM post", stats=True))
def sse(spark, sf_dir):
    return kmeans.sse(indexed(spark, sf_dir).postings).select(r6("sse").alias("sse"))


# ---------------------------------------------------------------- probed search
@query(S.probed("SELECT qid, rank, cluster, round(d, 6) + 0.0 AS distance FROM probe WHERE rank <= 4", "l2"))
def probe_clusters(spark, sf_dir):
    found = knn.probes(asked(spark, sf_dir), indexed(spark, sf_dir).centroids, 4)
    return found.select("qid", "rank", "cluster", r6("distance").alias("distance"))


@query(S.ivf("l2"))
def ivf_search_l2(spark, sf_dir):
    return search(asked(spark, sf_dir), indexed(spark, sf_dir), 10, 4).select("qid", "rank", "id", r6("distance").alias("distance"))


@query(S.ivf("ip"))
def ivf_search_ip(spark, sf_dir):
    return search(asked(spark, sf_dir), indexed(spark, sf_dir, "ip"), 10, 4).select("qid", "rank", "id", r6("distance").alias("distance"))


@query(S.RECALL)
def recall_at_k(spark, sf_dir):
    q, v = asked(spark, sf_dir), vectors(spark, sf_dir)
    return quality.recall(search(q, indexed(spark, sf_dir), 10, 4), knn.exact(q, v, 10), 10).select("qid", r6("recall").alias("recall"))


@query(S.FRONTIER)
def recall_frontier(spark, sf_dir):
    q, v = asked(spark, sf_dir), vectors(spark, sf_dir)
    found = quality.recall(sweep(q, indexed(spark, sf_dir), 10, [1, 2, 4, 8, 16]), knn.exact(q, v, 10), 10, by=["nprobe"])
    return found.groupBy(F.col("nprobe").cast("long").alias("nprobe")).agg(r6(F.avg("recall")).alias("recall"))


@query(S.VIOLATIONS)
def npa_violations(spark, sf_dir):
    """Of an index whose centroids have moved to their members' means since the members were assigned."""
    index = indexed(spark, sf_dir)
    moved = replace(index, centroids={**index.centroids, **kmeans.means(kmeans.statistics(index.postings))})
    return quality.violations(moved).select("checked", "violations", r6("violation_rate").alias("violation_rate"))


@query(S.NEIGHBOURS)
def topl_neighbors(spark, sf_dir):
    return maintenance.neighbours(indexed(spark, sf_dir), 5).select("cluster", "rank", "neighbour", r6("distance").alias("distance"))


@query(S.SUMMARY)
def index_summary(spark, sf_dir):
    """Of an index whose centroids have moved to their members' means since the members were assigned."""
    index = indexed(spark, sf_dir)
    moved = replace(index, centroids={**index.centroids, **kmeans.means(kmeans.statistics(index.postings))})
    return quality.summary(moved).select("partitions", "vectors", "smallest", "largest", *(r6(c).alias(c) for c in ("mean", "std", "violation_rate")))


@query(S.AFTER_DELETES)
def sweep_after_deletes(spark, sf_dir):
    """Recall by nprobe after tail inserts and then deletes of the oldest quarter of the first half; truth is as before the deletes."""
    q, v = asked(spark, sf_dir), vectors(spark, sf_dir)
    index, rest, n = half_indexed(spark, sf_dir)
    after = maintenance.inserted(index, rest)
    after = replace(after, postings=after.postings.where(F.col("id") >= F.lit((v.count() - n) // 4)))
    found = quality.recall(sweep(q, after, 10, [1, 4, 16]), knn.exact(q, v, 10), 10, by=["nprobe"])
    return found.groupBy(F.col("nprobe").cast("long").alias("nprobe")).agg(r6(F.avg("recall")).alias("recall"))


@query(S.SAMPLES)
def local_samples(spark, sf_dir):
    return kmeans.local_samples(indexed(spark, sf_dir).postings, 24).select("cluster", "id", "side")


@query(S.QUOTA)
def quota_union(spark, sf_dir):
    """Ids that leave 1, then 2, then 0 over 3, until half as many as there are vectors."""
    v = vectors(spark, sf_dir)
    return until([v.where(F.col("id") % 3 == i) for i in (1, 2, 0)], v.count() // 2).select("id", "source")


# ---------------------------------------------------------------- upkeep
@query(S.MERGE)
def merge_target(spark, sf_dir):
    index = indexed(spark, sf_dir)
    return maintenance.merge_targets(replace(index, merge_below=3 * index.merge_below))


@query(S.MERGED)
def merge_relabel(spark, sf_dir):
    index = indexed(spark, sf_dir)
    return located(maintenance.merge(replace(index, merge_below=3 * index.merge_below)))


@query(S.index("SELECT id, cluster, CAST(pos >= n // 2 AS INTEGER) AS side FROM (SELECT *, count(*) OVER (PARTITION BY cluster) AS n FROM post) WHERE n >= 4"))
def split_halves(spark, sf_dir):
    return maintenance.halves(indexed(spark, sf_dir).postings).select("id", "cluster", "side")


@query(S.CDKM)
def cdkm_split(spark, sf_dir):
    """The two sides of every partition after five passes of coordinate descent."""
    halved = maintenance.halves(indexed(spark, sf_dir).postings)
    return maintenance.sides(halved).select("id", "cluster", "side")


@query(S.LLOYD_SPLIT)
def lloyd_split(spark, sf_dir):
    halved = maintenance.halves(indexed(spark, sf_dir).postings)
    return maintenance.sides(halved, kernels.two_means, 10).select("id", "cluster", "side")


@query(S.LIRE)
def lire_repair(spark, sf_dir):
    """The largest partition split by two-means, then its neighbourhood's members to their nearest centroids."""
    index = indexed(spark, sf_dir)
    return located(maintenance.lire_split(index, [largest(index)], around=5))


@query(S.LIRE_SWEEP)
def lire_l_sweep(spark, sf_dir):
    index = indexed(spark, sf_dir)
    target, rows = largest(index), []
    for around in (0, 1, 2, 5, 10):
        rows.append((around, maintenance.lire_split(index, [target], around=around).counters.get("reassigned", 0)))
    return spark.createDataFrame(rows, "around long, reassigned long")


@query(S.GAINS)
def cdkm_gains(spark, sf_dir):
    """For each vector what it is worth to its partition, what it would add to the next nearest, and the change if it moved there."""
    index = indexed(spark, sf_dir)
    stats = index.clusters().select("cluster", "n", "a", "s")
    two = knn.nearest(vectors(spark, sf_dir), index.centroids, second=True).withColumn("rho", V.squared_norm(F.col("vec")))
    other = stats.select(F.col("cluster").alias("cluster2"), F.col("n").alias("n2"), F.col("a").alias("a2"), F.col("s").alias("s2"))
    both = two.join(F.broadcast(stats), "cluster").join(F.broadcast(other), "cluster2")  # a row for each partition
    both = both.withColumn("xa", V.dot(F.col("vec"), F.col("a"))).withColumn("xa2", V.dot(F.col("vec"), F.col("a2")))
    c = F.col
    delta = V.move_delta(c("n"), c("s"), c("xa"), c("n2"), c("s2"), c("xa2"), c("rho"), F.lit(False))
    return both.select("id", r6(V.stay_gain(c("n"), c("s"), c("xa"), c("rho"))).alias("stay"), r6(V.join_gain(c("n2"), c("s2"), c("xa2"), c("rho"))).alias("joined"), r6(delta).alias("delta"))


@query(S.SAMPLE)
def boundary_sample(spark, sf_dir):
    found = maintenance.boundary_sample(indexed(spark, sf_dir), (0, 1), 2, 4)
    return found.select("cluster", "rank", "id", r6("gap").alias("gap"))


@query()
def bs_cdkm(spark, sf_dir):
    index = indexed(spark, sf_dir)
    return located(maintenance.boundary_split(index, largest(index)))


@query()
def sr_cdkm(spark, sf_dir):
    index = indexed(spark, sf_dir)
    return located(maintenance.sampled_repair(index, largest(index)))


@query()
def local_cdkm(spark, sf_dir):
    index = indexed(spark, sf_dir)
    big = largest(index)
    after, new = maintenance.split(index, [big])
    return located(maintenance.local_repair(after, (big, new[big])))


@query()
def local_cdkm_all(spark, sf_dir):
    """Every partition of over 1.2 times the mean split, and the splits' neighbourhoods repaired in rounds that share no partition."""
    index = indexed(spark, sf_dir)
    above = 1.2 * index.split_above / index.config.split_factor
    return located(maintenance.local_split(index, sorted(r["cluster"] for r in index.sizes().where(F.col("n") > above).collect())))


@query(S.MEM_ONLY)
def mem_only_split(spark, sf_dir):
    """The largest partition in its two halves, then its neighbourhood's members to the nearest of all centroids."""
    index = indexed(spark, sf_dir)
    return located(maintenance.mem_only_split(index, [largest(index)]))


@query()
def live_means_repair(spark, sf_dir):
    """A split's neighbourhood in one pass to the nearest mean, means following every move."""
    index = indexed(spark, sf_dir)
    big = largest(index)
    after, new = maintenance.split(index, [big], passes=0)
    return located(maintenance.local_repair(after, (big, new[big]), live_means=True))


@query(S.DEDRIFT)
def dedrift_select(spark, sf_dir):
    return maintenance.rebalance_choice(indexed(spark, sf_dir))


@query(S.REBALANCED)
def dedrift(spark, sf_dir):
    return located(maintenance.rebalance(indexed(spark, sf_dir)))


@query(S.index("SELECT id, cluster FROM post", source="live"))
def rebuild(spark, sf_dir):
    first, rest, n = workload.offsets(vectors(spark, sf_dir))
    return located(build(first.union(rest.where(workload.live_at(F.col("place"), n)).drop("place")), IndexConfig()))


@query(S.UPDATED)
def update_centroids(spark, sf_dir):
    index, rest, _ = half_indexed(spark, sf_dir)
    return coordinates(centroid_table(spark, maintenance.inserted(index, rest, move_centroids=True).centroids), "cluster", column="centroid", digits=None)


@query(S.FROZEN)
def frozen_insert(spark, sf_dir):
    index, rest, _ = half_indexed(spark, sf_dir)
    return located(maintenance.inserted(index, rest))


@query(S.ONE_BY_ONE)
def one_by_one_insert(spark, sf_dir):
    """The second half inserted one by one: each moves its partition's centroid before the next is judged."""
    index, rest, _ = half_indexed(spark, sf_dir)
    return located(serial.one_by_one(index, rest.withColumn("seq", F.col("id"))))


@query(S.FROZEN)
def frozen_stream(spark, sf_dir):
    """The same by Structured Streaming: vectors arrive as files, each is assigned once."""
    index, rest, _ = half_indexed(spark, sf_dir)
    path = scratch_path(spark)
    rest.select("id", "vec").repartition(4, "id").write.parquet(f"{path}/in")
    stream = spark.readStream.schema("id long, vec array<double>").option("maxFilesPerTrigger", 2).parquet(f"{path}/in")
    found = workload.assigned_stream(stream, index).select("id", "cluster")
    found.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    return located(index).union(spark.read.schema("id long, cluster long").parquet(f"{path}/out"))


def _followed(spark: SparkSession, sf_dir: str, measure: workload.Measure | None = None) -> str:
    """The FIFO log of the second half, and every query in one of its batches, by Structured Streaming in batches of a tenth; where it is written."""
    v = vectors(spark, sf_dir)
    first, rest, n = workload.offsets(v)
    path, batch = scratch_path(spark), -(-n // 10)
    log = workload.fifo_log(rest, 10, batch).join(rest.select("id", "vec"), "id").select("seq", "batch", "op", "id", F.when(F.col("op") == "insert", F.col("vec")).alias("vec"))
    ask = v.where(F.col("id") % 50 == 0).select(F.col("id").alias("seq"), (F.floor(F.col("id") / 50) % 10).alias("batch"), F.lit("query").alias("op"), "id", "vec")
    log = log.union(ask).withColumn("batch", F.col("batch").cast("int"))
    for i in range(10):  # a stream of files takes them in the order in which they were written
        log.where(F.col("batch") == i).coalesce(1).write.mode("append").parquet(f"{path}/log")
    ops = spark.readStream.schema(workload.OPS).option("maxFilesPerTrigger", 1).parquet(f"{path}/log")
    workload.follow(ops, build(first, IndexConfig()), f"{path}/index", f"{path}/state", measure=measure).awaitTermination()
    return f"{path}/index"


@query(S.policy(moved=False))
def layered_stream(spark, sf_dir):
    """Where a stream of inserts and deletes leaves the vectors: each version of the index adds a layer."""
    return located(workload.latest(spark, _followed(spark, sf_dir), IndexConfig()))


@query(S.OBSERVED)
def observed_stream(spark, sf_dir):
    """What is measured after each batch of the stream."""
    found = workload.measures(spark, _followed(spark, sf_dir, workload.Measure(10, 8)))
    return found.select("batch", "inserts", "deletes", "queries", "vectors", r6("recall").alias("recall"), r6("boundary").alias("boundary"))


@query(S.NPY)
def npy_round_trip(spark, sf_dir):
    """Vectors written as .npy parts of 32-bit numbers, read in ranges."""
    path = scratch_path(spark)
    npy.write(vectors(spark, sf_dir), f"{path}/set", name="embeddings", distance="l2")
    return coordinates(read_vectors(spark, f"{path}/set", "npy"), "id", digits=None)


@query(S.DATASET)
def dataset_round_trip(spark, sf_dir):
    """Nine tenths of the vectors as training set, the rest as queries, with their neighbours: written and read again."""
    v, path = vectors(spark, sf_dir), scratch_path(spark)
    n = v.count()
    train, queries = train_and_queries(v, n - n // 10, n // 10)
    write_dataset(train, queries, truth(train, queries, None, 5), f"{path}/set", name="embeddings")
    back = [spark.read.parquet(f"{path}/set/{t}") for t in ("train", "queries", "truth")]
    return truth(back[0], back[1], back[2], 5)


@query(S.LATENCIES)
def written_reports(spark, sf_dir):
    """The latency summary written as CSV and as JSON; numbers are read back from the one, counts from the other."""
    path, table = scratch_path(spark), latency_percentiles(spark, sf_dir)
    write_report(table, f"{path}/csv")
    write_report(table, f"{path}/json", "json")
    numbers = spark.read.option("header", True).schema(table.schema).csv(f"{path}/csv").drop("n")
    return numbers.join(spark.read.schema(table.schema).json(f"{path}/json").select("method", "n"), "method")


def _after(name: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        index, rest, n = half_indexed(spark, sf_dir, IndexConfig(rebuild_every=100))
        return located(maintenance.policy(name)(index, rest, rest.where(~workload.live_at(F.col("place"), n)).select("id")))

    run.__name__ = f"policy_{name}"
    return run


for _name in ("lire", "scdkm", "memonly", "localcdkm"):
    query()(_after(_name))
query(S.REBALANCED_STREAM)(_after("dedrift"))
query(S.policy(moved=False))(_after("frozen"))
query(S.index("SELECT id, cluster FROM post", source="live"))(_after("rebuild"))


# ---------------------------------------------------------------- workloads
@query(S.LOG)
def fifo_log(spark, sf_dir):
    _, rest, _ = workload.offsets(vectors(spark, sf_dir))
    return workload.fifo_log(rest, 10, 50)


@query(S.LIVE)
def fifo_live_set(spark, sf_dir):
    first, rest, n = workload.offsets(vectors(spark, sf_dir))
    return first.select("id").union(rest.where(workload.live_at(F.col("place"), n)).select("id"))


@query(S.MIXED)
def mixed_workload_recall(spark, sf_dir):
    index, rest, n = half_indexed(spark, sf_dir)
    queries = asked(spark, sf_dir).withColumn("turn", F.floor(F.col("qid") / 50))
    found = workload.mixed_recall(vectors(spark, sf_dir), queries, index, rest, n)
    return found.select("round", "qid", r6("recall").alias("recall"))


@query()
def mixed_op_log(spark, sf_dir):
    """45 % inserts, 45 % queries and 10 % deletes in an order that a hash gives."""
    n = vectors(spark, sf_dir).count()
    return workload.mixed_log(max(1, n // 2), max(1, n), (0.45, 0.45, 0.1), 4 * n, 200, spark)


@query()
def generated_vectors(spark, sf_dir):
    """As many vectors as the table has, by each profile."""
    n, out = vectors(spark, sf_dir).count(), None
    for name in PROFILES:
        one = profiled(spark, name, n, 16).withColumn("profile", F.lit(name))
        out = one if out is None else out.union(one)
    return out.select("profile", "id", "cluster", r6(V.squared_norm(F.col("vec"))).alias("norm"))


@query()
def generated_boundary_queries(spark, sf_dir):
    index = indexed(spark, sf_dir)
    return quality.boundary_queries(quality.boundary_scores(boundary_mixtures(spark, index.centroids, vectors(spark, sf_dir).count()), index.centroids), 0.85, 50)


@query()
def boundary_vs_random(spark, sf_dir):
    """Mean recall by nprobe of a tenth as many mixtures of two centroids as there are vectors, and of as many vectors around centroids."""
    index, v = indexed(spark, sf_dir, "ip"), vectors(spark, sf_dir)
    n, out = max(1, v.count() // 10), None
    for kind, made in (("boundary", boundary_mixtures(spark, index.centroids, n)), ("random", around_centroids(spark, index.centroids, n))):
        made = stored(made)
        swept = stored(sweep(made, index, 10, [1, 2, 4, 8, 16]).select("nprobe", "qid", "rank", "id"))  # each is read twice
        found = quality.recall(swept, stored(knn.exact(made, v, 10, "ip").select("qid", "rank", "id")), 10, by=["nprobe"])
        one = found.groupBy(F.lit(kind).alias("kind"), F.col("nprobe").cast("long").alias("nprobe")).agg(F.count(F.lit(1)).alias("n"), r6(F.avg("recall")).alias("recall"))
        out = one if out is None else out.union(one)
    return out


# ---------------------------------------------------------------- boundary
def _scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = indexed(spark, sf_dir)
    return quality.boundary_scores(vectors(spark, sf_dir).withColumnRenamed("id", "qid"), index.centroids)


@query(S.scores("SELECT qid, round(score, 6) AS score FROM score"))
def boundary_score(spark, sf_dir):
    return _scores(spark, sf_dir).select("qid", r6("score").alias("score"))


@query(S.BOUNDARY_SPLIT)
def boundary_split(spark, sf_dir):
    results = _scores(spark, sf_dir).withColumn("recall", (F.col("qid") % 11) / 10.0).withColumn("latency", (F.col("qid") * 37 % 101).cast("double"))
    return quality.boundary_split(results).select("side", "n", *(r6(c).alias(c) for c in ("recall", "p50", "p99")))


@query(S.BOUNDARY_SPLIT_AT)
def boundary_split_at(spark, sf_dir):
    """The same with the cut at a score of 0.97."""
    results = _scores(spark, sf_dir).withColumn("recall", (F.col("qid") % 11) / 10.0).withColumn("latency", (F.col("qid") * 37 % 101).cast("double"))
    return quality.boundary_split_at(results, 0.97).select("side", "n", *(r6(c).alias(c) for c in ("recall", "p50", "p99")))


@query(S.BOUNDARY_RECALL)
def boundary_vs_asked(spark, sf_dir):
    """Mean recall at nprobe 2 of the 20 queries nearest to a boundary and of those asked elsewhere."""
    v, index = vectors(spark, sf_dir), indexed(spark, sf_dir)
    near = quality.boundary_queries(_scores(spark, sf_dir), 2.0, 20).select("qid").join(v.withColumnRenamed("id", "qid"), "qid")
    out = None
    for kind, q in (("boundary", near), ("asked", asked(spark, sf_dir))):
        found = quality.recall(search(q, index, 10, 2), knn.exact(q, v, 10), 10)
        one = found.agg(F.lit(kind).alias("kind"), F.count(F.lit(1)).alias("n"), r6(F.avg("recall")).alias("recall"))
        out = one if out is None else out.union(one)
    return out


@query(S.scores("SELECT qid, round(score, 6) AS score FROM score WHERE score.score >= 0.95"))
def boundary_queries_at(spark, sf_dir):
    """As many as score 0.95 or more, which are over 20."""
    return quality.boundary_queries(_scores(spark, sf_dir), 0.95, 20).select("qid", r6("score").alias("score"))


@query(S.scores("SELECT qid, round(score, 6) AS score FROM score ORDER BY score.score DESC, qid LIMIT 20"))
def boundary_queries(spark, sf_dir):
    return quality.boundary_queries(_scores(spark, sf_dir), 2.0, 20).select("qid", r6("score").alias("score"))


# ---------------------------------------------------------------- reports
def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select(F.col("event_id").alias("seq"), F.col("event_type").alias("method"), (F.col("user_id") % 5).alias("dataset"), (F.col("user_id") % 3).alias("seed"), "value")


def r9(x: str | Column) -> Column:
    """Means of values with few decimals are often ties at the sixth."""
    return F.round(F.col(x) if isinstance(x, str) else x, 9)


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: r9(c) for c in columns})


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """method, cost, recall and qps of each method: mean, 90th percentile and count of its values."""
    return results(spark, sf_dir).groupBy("method").agg(F.avg("value").alias("cost"), F.percentile("value", F.lit(0.9)).alias("recall"), F.count(F.lit(1)).cast("double").alias("qps"))


@query(S.LATENCIES)
def latency_percentiles(spark, sf_dir):
    out = reports.latency_summary(results(spark, sf_dir), ["method"])
    return rounded(out, "mean", "std", "p50", "p95", "p99", "p999")


@query(S.STREAM)
def stream_summary(spark, sf_dir):
    """Batches of 100 results; a batch's qps is 0 where its number leaves 0 over 7."""
    batch = F.floor(F.col("seq") / 100)
    each = results(spark, sf_dir).groupBy("method", batch.alias("batch")).agg(F.avg("value").alias("recall"), F.max("value").alias("latency"))
    out = reports.stream_summary(each.withColumn("qps", (F.col("batch") % 7).cast("double")), ["method"], 10)
    return rounded(out, "recall", "qps", "p50", "p95", "p99", "p999")


@query(S.traces("SELECT method, dataset, part, round(mean, 9) AS mean, round(p99, 9) AS p99 FROM trace"))
def progress_windows(spark, sf_dir):
    return rounded(reports.windows(results(spark, sf_dir), ["method", "dataset"], "seq"), "mean", "p99")


@query(S.TRACE_ENVELOPE)
def trace_envelope(spark, sf_dir):
    return rounded(reports.trace_envelope(reports.windows(results(spark, sf_dir), ["method", "dataset"], "seq")), "mean", "low", "high")


@query(S.CDF)
def empirical_cdf(spark, sf_dir):
    out = reports.distribution(results(spark, sf_dir), ["method"], "value", "seq")
    return out.select("seq", "method", "value", F.round("share", 9).alias("share"))


@query(S.ENVELOPE)
def envelope(spark, sf_dir):
    each = results(spark, sf_dir).groupBy("method", "seed", "dataset").agg(F.avg("value").alias("value"))
    return rounded(reports.envelope(each, ["method", "seed"], "value"), "mean", "low", "high")


@query(S.SEEDS)
def seed_summary(spark, sf_dir):
    each = results(spark, sf_dir).groupBy("method", "seed").agg(F.avg("value").alias("recall"), F.count(F.lit(1)).cast("double").alias("qps"))
    return rounded(reports.over_seeds(each, ["recall", "qps"]), "recall_mean", "recall_std", "qps_mean", "qps_std")


@query(S.BUDGETS)
def budget_sweep(spark, sf_dir):
    middle = _candidates(spark, sf_dir).agg(F.avg("cost").alias("budget"))
    budgets = spark.createDataFrame([(-1.0,), (1e9,)], "budget double").union(middle)
    return rounded(reports.best_within(_candidates(spark, sf_dir), budgets), "budget", "recall")


@query(S.SPEEDUP)
def speedup_summary(spark, sf_dir):
    each = results(spark, sf_dir).groupBy("method", "dataset").agg(F.avg("value").alias("value"))
    return rounded(reports.speedups(each, "click", "view", "value"), "mean", "low", "high")


@query(S.LOOKUP)
def nprobe_lookup(spark, sf_dir):
    """From each method's parallel arrays (dataset, mean): the value nearest to 2.4, the one at exactly 3, and none at 9."""
    each = results(spark, sf_dir).groupBy("method", "dataset").agg(F.avg("value").alias("value"))
    arrays = each.groupBy("method").agg(F.array_sort(F.collect_list(F.struct("dataset", "value"))).alias("z"))
    k, v = F.col("z")["dataset"], F.col("z")["value"]
    return arrays.select("method", r9(T.nearest_value(k, v, 2.4)).alias("nearest"), r9(T.exact_value(k, v, 3)).alias("at_3"), r9(T.exact_value(k, v, 9)).alias("at_9"))


def _named(spark: SparkSession, sf_dir: str) -> DataFrame:
    """dataset, method, metric, value: the events' types stand for methods, figures of their values for metrics."""
    means = results(spark, sf_dir).groupBy("dataset", "method").agg(F.avg("value").alias("maintenance"), F.max("value").alias("p99"), F.count(F.lit(1)).cast("double").alias("reassigned"), F.min("value").alias("recall"))
    as_named = {"click": "lire", "view": "scdkm", "signup": "frozen", "error": "lire_l0", "purchase": "lire_l5"}
    shown = F.create_map(*[F.lit(x) for kv in as_named.items() for x in kv])
    same = {"maintenance": ("maintenance", "qps", "violations"), "p99": ("p99", "delete_p99", "query_p99"), "reassigned": ("reassigned",), "recall": ("recall",)}
    each = F.explode(F.array(*(F.struct(F.lit(n).alias("metric"), F.col(c).alias("value")) for c, ns in same.items() for n in ns))).alias("r")
    return means.select("dataset", shown[F.col("method")].alias("method"), each).select("dataset", "method", "r.*")


@query(S.CLAIMS)
def claim_summary(spark, sf_dir):
    """Four sections over the datasets (drift: those from 2 on); no event stands for rebuilding, so that its recall is null."""
    return rounded(reports.claim_summary(_named(spark, sf_dir), {"drift": F.col("dataset") >= 2}), "value")


@query(S.BASELINES)
def baseline_rows(spark, sf_dir):
    """Of three baselines one is missing everywhere."""
    found = reports.baselines(_named(spark, sf_dir).where("not (dataset = 1 and method = 'lire_l0')"), {"lire_l0": "LIRE-0", "lire_l5": "LIRE-5", "rebuild": "Rebuild"}, ["reassigned", "maintenance"])
    return rounded(found, "reassigned", "maintenance")


@query(S.POSITIONS)
def list_positions(spark, sf_dir):
    """Places in the posting lists after the FIFO log, in two batches: deletes move the last member into the hole."""
    index, rest, n = half_indexed(spark, sf_dir)
    log = workload.fifo_log(rest, 10, -(-n // 2))
    cluster = knn.nearest(rest.select("id", "vec"), index.centroids).select("id", "cluster")
    ops, places = log.join(cluster, "id"), in_order(index.postings).select("id", "cluster", "pos")
    for i in range(2):
        places = stored(positions.updated(places, ops.where(F.col("batch") == i)))
    return places


@query(S.FLAT)
def flattened_rows(spark, sf_dir):
    """From parallel arrays of each method's hundred consecutive results."""
    batch = F.floor(F.col("seq") / 100)
    each = results(spark, sf_dir).groupBy("method", batch.alias("batch")).agg(F.array_sort(F.collect_list("seq")).alias("seqs"), F.transform(F.array_sort(F.collect_list(F.struct("seq", "value"))), lambda z: z["value"]).alias("values"))
    return reports.flattened(each, ["method", "batch"], ["seqs", "values"]).withColumnsRenamed({"seqs": "seq", "values": "value"})


@query(S.KEYS)
def method_keys(spark, sf_dir):
    label = F.concat(F.lit("My-"), F.initcap("method"), F.lit("_L"), F.col("dataset").cast("string"))
    n = results(spark, sf_dir).groupBy("method", "dataset").agg(F.count(F.lit(1)).alias("n"))
    named = n.withColumn("label", label)
    return named.select("label", T.method_key(F.col("label")).alias("key"), T.neighbourhood_size(F.col("label")).cast("long").alias("size"), T.relabel(F.col("label"), "My-", "Our ").alias("shown"), T.fixed(F.col("n") / 8.0).alias("text"))


@query(S.LAST)
def last_result_wins(spark, sf_dir):
    """Two result tables, the second of which replaces the methods that it has."""
    first = results(spark, sf_dir).groupBy("method").agg(F.count(F.lit(1)).alias("n"))
    second = results(spark, sf_dir).where("dataset = 1 and method in ('click', 'view')").groupBy("method").agg(F.count(F.lit(1)).alias("n"))
    return reports.last_wins([first, second], ["method"])


def _curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors of a sample of each partition in two random halves, after so many passes: a task holds one, of the mean size of partitions or 256 members."""
    import pyarrow as pa

    from .functions.arrow import matrix

    steps = [0, 1, 2, 3, 5, 8, 10, 15, 20]

    def run(rows):
        rows = rows.sort_by("id")
        both = kernels.curves(matrix(rows["vec"]), rows["side"].to_numpy().astype(int), steps)
        flat = [(rows["cluster"][0].as_py(), m, t, x) for m, xs in both.items() for t, x in zip(steps, xs, strict=True)]
        return pa.table([pa.array(c) for c in zip(*flat, strict=True)], ["cluster", "method", "t", "sse"])

    index = indexed(spark, sf_dir)
    sizes = index.members().values()
    return kmeans.local_samples(index.postings, min(256, max(16, sum(sizes) // len(sizes)))).groupBy("cluster").applyInArrow(run, "cluster long, method string, t long, sse double")


@query()
def cdkm_vs_lloyd(spark, sf_dir):
    """Relative error after each number of passes, by both methods, over all partitions."""
    out = reports.paired(reports.relative(_curves(spark, sf_dir), ["cluster", "method"]), "cluster", "t")
    return rounded(out, "cdkm_mean", "lloyd_mean", "better", "gap")
